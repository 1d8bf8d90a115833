"""From raw documents to packed sequences: toxicity, line dedup, Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which
:func:`run` writes as Parquet and reads again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadtide.llm import jaccard, line_dedup, mixing, packing, toxicity
from quadtide.llm._store import Store
from quadtide.llm.queries import lexicon, read

#: Packing and the Bayesian join cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, store: Store | None = None) -> DataFrame:
    """Documents that score 0.5 or more go. The lexicon is learnt from the labels of the table in sf_dir."""
    return toxicity.reject(docs, lexicon(spark, sf_dir, store))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, store: Store | None = None) -> DataFrame:
    """Later repeats of runs of lines go; the documents stay, and n_chars follows the text."""
    return _sized(line_dedup.dedup_lines(docs, store=store).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, store: Store | None = None) -> DataFrame:
    """One document of each group stays, that with the least doc_id."""
    return jaccard.keep_one(docs, store=store)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, store: Store | None = None) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(mixing.mix(docs, store=store))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, store: Store | None = None) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack(docs, store=store)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents in sf_dir.

    A stage's intermediate tables go once its result is stored, and its result once the next one's is.
    """
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        work, result = Store(spark), Store(spark)
        docs = result.table(stage(spark, docs, sf_dir, work), name.replace(" ", "-"))
        work.delete()
        if held:
            held.delete()
        held = result
    return STAGES[-1][1](spark, docs, sf_dir)
