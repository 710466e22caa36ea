"""Exact deduplication with stateful streaming.

Every call appends its rows to a table of arrivals: identifier, digest, the
normalised text, and a locator (batch and row) under which the text is found
again.  A stream over the arrivals keeps one state entry per digest, without
expiry, in RocksDB: the smallest identifier and the oldest arrival, their
locators, and the count.  A named
state folder holds arrivals and state for later calls, which see all that
arrived before.  Where a digest was hit more than once, the full bytes are
fetched by their locators and compared, so two texts that merely share a digest
never merge.  Partial aggregation in front of each shuffle keeps a hot group at
one record per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import Scratch, fresh_path, partitions, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # Stores of a finished stream leave the executors' memory soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # Without it every store reserves megabytes of disk, however few keys it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of hits up to this many rows (about 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def normalised(text: Column) -> Column:
    """White-space runs (space, tab, LF, VT, FF, CR) become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What the stream reads of an arrival.
_NARROW = "id {kind}, digest {digest}, locator bigint, batch int"


def _committed(spark: SparkSession, root: str) -> set[int]:
    """Batches of calls that came to their end."""
    return {int(p.rpartition("=")[2]) for p in partitions(spark, f"{root}/committed/batch=*")}


def _rolled_back(spark: SparkSession, root: str, schema: str, files_per_trigger: int) -> int:
    """Undo what a failed call left in a state folder; the number of the next batch.

    The rows of such a call may be in the state already, which can't forget
    them; so the state is built anew from the arrivals of the other calls.
    """
    done = _committed(spark, root)
    left = [p for p in partitions(spark, f"{root}/arrivals/batch=*") if int(p.rpartition("=")[2]) not in done]
    if left:
        for path in [*left, f"{root}/state", f"{root}/seen"]:
            remove(spark, path)
        if done:
            _state_of(spark, root, schema, max(done), files_per_trigger)
    return max(done, default=-1) + 1


def _state_of(spark: SparkSession, root: str, schema: str, batch: int, files_per_trigger: int) -> DataFrame:
    """Run new arrivals through the keyed state; a row for each of their digests with its first arrival and count so far."""
    out = f"{root}/seen/batch={batch}"
    seen = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/arrivals")
        .groupBy("digest")
        .agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "batch", "locator")).alias("first"), F.min(F.struct("batch", "locator")).alias("oldest"), F.count(F.lit(1)).alias("n"))
    )

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/epoch={epoch}")

    with _settings(spark, STATE_CONF):
        query = (
            seen.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    # An entry is written again whenever it changes: its count only grows, its first arrivals only fall.
    updates = spark.read.schema(seen.schema).parquet(f"{out}/epoch=*")
    return updates.groupBy("digest").agg(F.min("first").alias("first"), F.min("oldest").alias("oldest"), F.max("n").alias("n"))


def located(spark: SparkSession, state: str, places: DataFrame) -> DataFrame:
    """Texts of arrivals by their locators (batch, locator): the columns of ``places`` and body."""
    content = spark.read.schema("locator bigint, body string, batch int").parquet(f"{state}/arrivals")
    return places.join(content, ["batch", "locator"])


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int = 1000,
    keep: tuple[str, ...] = (),
    state: str | None = None,
) -> DataFrame:
    """Groups of equal texts.

    Texts are equal when their normalised forms are the same bytes.  Returns a
    row per input row: ``id_col``, the columns named in ``keep`` (narrow ones,
    they go through the shuffles), keep_id, group_size, kept, text_sha256.
    ``state`` names a folder that all executors share: rows of earlier calls
    with the same folder count in the groups, and lead them if their id is
    smaller; only the rows of this call are returned.  Without it each call
    stands alone.  A batch counts once its call has ended: what a failed call
    left behind is undone by the next one.  Calls on one folder take turns.

    * null text: as empty; all empty texts form one group;
    * very long texts: compared whole;
    * null id: the row counts in its group and leads it only if no row has an id;
    * repeated rows (same id and text): one of them is kept, the first to arrive;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    root = (state or fresh_path(spark, "exact-arrivals")).rstrip("/")
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"), carried.alias("carried"))
    arrived = source.select("id", digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("sha"), F.monotonically_increasing_id().alias("locator"), "carried", "body")
    kinds = dict(arrived.dtypes)
    narrow = _NARROW.format(kind=kinds["id"], digest=kinds["digest"])
    batch = _rolled_back(spark, root, narrow, files_per_trigger) if state else 0
    path = f"{root}/arrivals/batch={batch}"
    arrived.write.option("compression", "zstd").parquet(path)
    arrivals = spark.read.schema(arrived.schema).parquet(path).withColumn("batch", F.lit(batch))
    found = _state_of(spark, root, narrow, batch, files_per_trigger)
    found = scratch.save(found, "state")
    hits = found.filter("n > 1").select("digest", "oldest.batch", "oldest.locator")
    few = hits.count() <= BROADCAST_ROWS
    own = arrivals.join(F.broadcast(hits.select("digest")) if few else hits.select("digest"), "digest", "left_semi").select("digest", "body")
    # Full bytes of the hits: those of this call, and the oldest of earlier ones, which the others of them were compared with.
    if batch:
        own = own.unionByName(located(spark, root, hits.filter(F.col("batch") < batch)).select("digest", "body"))
    texts = own.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    collisions = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    if batch:
        collisions = collisions.unionByName(spark.read.schema(collisions.schema).parquet(f"{root}/collisions").join(arrivals.select("digest"), "digest", "left_semi")).distinct()
    collisions = scratch.save(collisions, "collisions")
    if state:  # later calls know that these digests stand for several texts
        collisions.write.mode("append").parquet(f"{root}/collisions")
    rows = arrivals.drop("body").join(found.drop("oldest").hint("shuffle_merge"), "digest")
    if not collisions.isEmpty():
        # Equal digest, different bytes: the whole text decides for these rows.
        every = spark.read.schema(arrivals.schema).parquet(f"{root}/arrivals") if batch else arrivals
        rows = rows.join(collisions, "digest", "left_anti").unionByName(_by_text(scratch, every, arrivals, collisions))
    if state:
        spark.range(1).write.mode("overwrite").parquet(f"{root}/committed/batch={batch}")
    return rows.select(
        F.col("id").alias(id_col),
        *[F.col("carried")[c].alias(c) for c in keep],
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("batch") == F.col("first.batch")) & (F.col("locator") == F.col("first.locator"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _by_text(scratch: Scratch, every: DataFrame, own: DataFrame, collisions: DataFrame) -> DataFrame:
    """Rows of this call with colliding digests, grouped by their whole texts over all arrivals."""
    colliding = every.select("id", "digest", "batch", "locator", "body").join(collisions, "digest", "left_semi")
    groups = colliding.groupBy("body").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "batch", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))
    rows = own.join(collisions, "digest", "left_semi")
    return scratch.save(rows.join(groups, "body").drop("body"), "by-text")
