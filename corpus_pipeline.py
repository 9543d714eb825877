"""From raw documents to shards: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, mixing, near_dups, sharding, toxicity
from strandmill.llm.queries import ENTROPY, REPEATS, SHARDS
from strandmill.llm.tables import cut, table


def plain(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with the columns a stage does not name as c0, c1, ..: they clash with no operator's own."""
    return docs.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored like others, null ids are never held out; rows come back with all their columns, an empty table stays empty.
    """
    rows = plain(docs, "doc_id", "text")
    judged = toxicity.toxicity(rows, table(spark, sf_dir, "labels"))
    return judged.where(~F.col("_toxic")).select(*rows.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id.  Rows without id, and texts without words, stay."""
    return near_dups.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth.

    Null and empty texts have no words and stay; ids do not matter; rows come back with all their columns.
    """
    rows = plain(docs, "text")
    judged = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("_contaminated")).select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again until the mixture has its weights.  A null source is a source."""
    return mixing.mixed_documents(docs, ENTROPY, REPEATS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; given columns of these names are left out.  Nulls and repeated rows are rows like others."""
    docs = docs.drop("shard", "slot")
    rows = plain(docs, "doc_id", "source", "n_chars", "text")
    out = sharding.shuffle_to_shards(rows, [F.col(c) for c in ("doc_id", "source", "n_chars", "text")], SHARDS, rows.count())
    return out.select(*rows.columns, "_shard", "_slot").toDF(*docs.columns, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained classifier and a sketch have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written down before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = cut(docs)
    return docs
