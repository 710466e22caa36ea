"""The corpus pipeline: documents through stages of the operators in ``sitelens.llm``.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last one returns token ids.  A row is a document: stages
decide by row, so null ids and repeated ids or rows lose nothing but what the
stage means to drop.  Null texts are empty ones (the language stage drops
them); very long texts are processed whole; an empty table gives an empty one;
other columns of the table go along unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.exact import exact_dedup
from sitelens.llm.language import UNKNOWN, fit, held_out, identify
from sitelens.llm.minhash import near_duplicates
from sitelens.llm.mixing import mix
from sitelens.llm.pieces import encode
from sitelens.llm.queries import MIX_WEIGHTS, mix_levels, vocabulary
from sitelens.plans.durable import Scratch

#: Share of the tokens that the mixture takes.
MIX_SHARE = 0.9


#: Names the row of a written table: ids may be null, repeated, or shared by several texts.
ROW = "_row"
#: Dropped rows are broadcast up to this many (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with the number of their row, written so that each reading finds the same numbers."""
    return Scratch(docs.sparkSession, "numbered").save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents but the dropped rows."""
    dropped = Scratch(rows.sparkSession, "dropped").save(dropped.select(ROW), "rows")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped.hint("shuffle_merge")
    return rows.join(dropped, ROW, "left_anti").select([c for c in rows.columns if c != ROW])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no text, no letters) go; only those, even if no row teaches a language."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return identify(docs, model, keep=rest).filter(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; a row without an id only if none has one."""
    rows = _numbered(docs)
    return _without(rows, exact_dedup(rows, keep=(ROW,)).filter("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays; every row is a document."""
    rows = _numbered(docs)
    found = near_duplicates(rows, id_col=ROW).select(ROW, "component_id")
    placed = Scratch(spark, "near").save(rows.select(ROW, "doc_id").join(found, ROW), "placed")
    firsts = placed.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", ROW)).alias("first"))
    return _without(rows, placed.join(firsts.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their share of nine tenths of the tokens; no document is repeated.  Rows without an id are drawn by their text."""
    rows = _numbered(docs)
    drawn = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256)))
    plan = mix(drawn, mix_levels(), MIX_WEIGHTS, F.floor(F.col("total") * MIX_SHARE), epochs=1, seed=17, keep=(ROW,))
    return _without(rows, plan.filter("copies = 0"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document: those of the model's merges, those of the best path of its lattice, and the scores of the four best."""
    found = encode(docs, vocabulary("piece_bpe_32k.model"), n=4, keep=("lang", "source"), merged=True)
    return found.select("doc_id", "lang", "source", "merged_ids", "ids", F.size("ids").cast("bigint").alias("n_pieces"), F.transform("n_best", lambda p: p["score"]).alias("scores"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The stages learn a language model and search a piece lattice, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
