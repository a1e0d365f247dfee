"""Documents to training shards: language, near duplicates, decontamination, mixing, sharding.

All stages take a table of documents with doc_id, text, lang, source and any further columns, and return a row for each
document that stays, with the same columns; the last adds its own. An empty table gives an empty one. Further columns may
have any names: they travel as one, so none clashes with what an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.llm.decontamination import contamination
from percola.llm.language import Model, identify, training_texts
from percola.llm.mixing import mix
from percola.llm.near_dedup import drop_near_duplicates
from percola.llm.sharding import shard
from percola.session import Staged, ship


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that none clashes with what an operator adds."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_row"))


def _unpacked(docs: DataFrame, columns: list[str]) -> list:
    return [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is `und`; a null lang takes the predicted one.

    Null text, or one without a letter, is `und` and goes; so do all if no lang is given to learn from. Each row of a
    null or repeated doc_id is judged by its own text.
    """
    ship(spark)
    packed = _packed(docs)
    found = identify(packed, Model.fit_passes(training_texts(docs)), keep=packed.columns).where("lang_pred <> 'und'")
    own = dict(zip(docs.columns, _unpacked(found, docs.columns), strict=True))
    if "lang" in own:
        own["lang"] = F.coalesce(own["lang"], "lang_pred").alias("lang")
    return found.select(*own.values())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of the least doc_id, of each near-duplicate component (five words, similarity 0.8).

    Documents without a word are near to nothing and stay, as do rows without a doc_id. Of rows that repeat a doc_id one
    stays, the one with the least hash; they tie the components of their texts together.
    """
    ship(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are contaminated by the benchmark: with a hit word, and 5 % of the words or more hit.

    Null or wordless text is never contaminated. Each row of a null or repeated doc_id is judged by its own text. Null
    item_ids and texts of the benchmark are ignored.
    """
    ship(spark)
    packed = _packed(docs)
    found = contamination(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=packed.columns).where(~F.col("contaminated"))
    return found.select(*_unpacked(found, docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, sources weighing 5, 2, 1 in turn.

    Documents without a word are taken at their source's rate too. A null source is a source of its own; null or repeated
    doc_ids keep each row its own place (see `mixing.mix`).
    """
    ship(spark)
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, checksum, shard and slot; an input column of one of these names is replaced.

    Null text counts 16 bytes and has no checksum. Copies that the mix made have one key: they share a shard, in different slots.
    """
    ship(spark)
    return shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language models and hash splitters have no SQL; tests/llm/test_pipeline_stages.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    staged = Staged(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged.put(stage(spark, docs, sf_dir), name)
    return docs
