"""Training-data pipeline over ``documents``: five stages, each a call of one operator of ``tessera.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``; the last returns the packed
pieces. Rows without a doc_id stay (no decision can name them); rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, linededup, packing, simhash
from tessera.llm.common import stored
from tessera.sources.tables import load

#: A document is rejected by language ID if no language is more likely than all others together.
MIN_LANGUAGE_SCORE = 0.5


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids(doc_id)``."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("__gone"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; a missing ``lang`` is filled in with the prediction."""
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model, carry=docs.columns, pred_col="__pred", score_col="__score")
    kept = found.where((F.col("__pred") != langid.UNKNOWN) & (F.col("__score") > MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__pred")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document holds too, once five documents hold them.

    ``n_chars`` follows the text; a null text stays null.
    """
    index = linededup.build(docs, min_docs=5, min_chars=40)
    out = linededup.drop_repeated(index, docs, added=("__lines", "__dropped", "__kept"))
    changed = F.col("__dropped") > 0
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    found = simhash.near_duplicates(docs, shingle=4, max_bits=4)
    return without(docs, found.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``."""
    return without(docs, decontam.find_leaks(docs, load(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, capacity=1024, vocabulary="byte_bpe_50k", end_id=0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language ID, SimHash and tokens have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one returns."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
