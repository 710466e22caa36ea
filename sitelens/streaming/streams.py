"""Streaming twins of the batch operators; each is tested against its batch form."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.robots import admitted_urls


def stream_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """ST5: running events per owner and calendar month; one number is kept for each."""
    dated = events.withWatermark("ts", lateness)
    return dated.groupBy(F.col("owner_id"), F.date_trunc("month", F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("pages"))


def stream_audit(pages: DataFrame, rules: list, path: str, checkpoint: str) -> StreamingQuery:
    """ST1: findings of arriving page evidence, appended.  Term counts need a page only, so each batch is whole."""
    from ..operators.rules import evaluate_rules
    from ..operators.scoring import issues

    def audit(batch: DataFrame, epoch: int) -> None:
        issues(evaluate_rules(batch, rules)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return pages.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, as operators with a state processor need it, for the time of the block.

    Batches without data are off: state that expires asks for them without end,
    so a stream over what is there would never come to its end.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def add(batch: DataFrame, epoch: int) -> None:
        # An epoch that is retried writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_rows(rows: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """ST2: the first writer of a key wins, however late a replay comes; keys are state without expiry, so no epoch reads those before it."""
    return _append(rows.dropDuplicates(key), path, checkpoint)


def stream_new_rows_within(rows: DataFrame, key: list[str], at: str, lateness: str, path: str, checkpoint: str) -> StreamingQuery:
    """ST2 with bounded state: keys are forgotten once the watermark, ``lateness`` behind the newest ``at``, has passed them.

    A replay within that time adds nothing; a later one is dropped as late.
    """
    return _append(rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key), path, checkpoint)


def stream_discover(links: DataFrame, known: DataFrame, path: str, checkpoint: str, max_depth: int = 8) -> StreamingQuery:
    """ST4: each crawl's new addresses, once, with the depth of their first arrival; addresses seen are keyed state."""
    return _append(admitted_urls(links, max_depth).join(known.select("crawl_id", "normalized_url").distinct(), ["crawl_id", "normalized_url"], "left_anti").dropDuplicates(["crawl_id", "normalized_url"]), path, checkpoint)


class AlertGate(StatefulProcessor):
    """Lets an event through if more than ``hours`` hours lie between it and the last of its rule that was let through.

    The state of a rule is that last time.  It expires ``hours`` after it was
    written, when it can't hold back an event of the day any more; rules that
    fell silent leave nothing behind.
    """

    def __init__(self, hours: float = 24, expires: bool = True):
        self.gap, self.expires = timedelta(hours=hours), expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp", ttlDurationMs=int(self.gap.total_seconds() * 1000) if self.expires else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A rule's rows of one trigger come in batches, in no order.  What is barred by the stored time goes at once;
        # of the rest number and time are ordered over the whole trigger, whose size maxFilesPerTrigger bounds.
        last = self.last.get()[0] if self.last.exists() else None
        parts = []
        for chunk in rows:
            times = chunk["detected_at"]
            if last is not None and pd.Timestamp(last).tzinfo is None:
                last = pd.Timestamp(last, tz=times.dt.tz)
            parts.append(chunk.loc[times > last + self.gap if last is not None else slice(None), ["event_id", "detected_at"]])
        every = pd.concat(parts).sort_values(["detected_at", "event_id"])
        times, kept, at = every["detected_at"], [], 0
        while at < len(every):
            kept.append(at)
            last = times.iloc[at]
            at = int(times.searchsorted(last + self.gap, side="right"))
        if kept:
            self.last.update((last.to_pydatetime(),))
        yield every.iloc[kept].assign(rule_id=key[0])[["event_id", "rule_id", "detected_at"]]

    def close(self) -> None:
        pass


def stream_alerts(candidates: DataFrame, hours: float = 24, expires: bool = True) -> DataFrame:
    """ST3: events (event_id, rule_id, detected_at) that pass their rule's gate.

    ``expires`` is for candidates that arrive about when they are detected;
    without it, for replays of old ones, a rule's state stays.
    """
    schema = "event_id bigint, rule_id bigint, detected_at timestamp"
    mode = "processingTime" if expires else "none"
    return candidates.groupBy("rule_id").transformWithStateInPandas(AlertGate(hours, expires), schema, outputMode="append", timeMode=mode)
