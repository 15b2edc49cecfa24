"""From raw documents to packed training sequences, stage by stage.

Language identification, line deduplication, near-duplicates, mixing to target weights,
packing. Each stage takes all that the one before it kept, and between stages rows are
written and read again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.llm import language_id, lines, minhash, mixing, packing
from lumenta.llm.common import documents, stored

#: Least posterior probability of a document's best language; below it the document is rejected, as are those without letters.
SURE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null lang gets the predicted one."""
    seen = language_id.predict(docs, language_id.fit(docs))
    lang = F.coalesce("lang", "lang_pred")
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*[lang.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those of which nothing is left go."""
    cut = lines.deduplicated(docs)
    return cut.where((F.size("removed") == 0) | (F.regexp_count("text", F.lit("[^ \t-\r]")) > 0)).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 of their five-word shingles."""
    return minhash.representatives(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("line_dedup", cut_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: SQL can express neither the lattices of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
