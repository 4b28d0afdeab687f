"""The corpus pipeline: quality rules, near-duplicates, substring dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs, whatever they are beside doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm import bpe, decontaminate, near_dedup, quality, substring_dedup
from fieldlark.llm.common import release, release_paths, stash, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty ones do) or that the learned list rejects go."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), docs["text"].alias("text"))
    kept = quality.statistics(whole).where(~F.col("base_failed") & quality.verdict(rules))
    return kept.select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays: the smallest doc_id, once.

    Documents without words, and those with a null doc_id, all stay; rows that share a doc_id go only with a
    document that they equal nearly. No documents: none.
    """
    return near_dedup.survivors(docs, n=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages stay in the first document that has them.

    Null texts stay null, and documents with a null doc_id stay as they are.
    """
    spans = substring_dedup.repeats(docs.select("doc_id", "text"))
    return substring_dedup.remove(docs, spans)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in benchmark windows go; null and empty ones have no words and stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document; a null text has no tokens."""
    import public_tokenizers  # here, so that the other stages do without it

    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


#: Tables that the stage before has left, which its result read from.
_LEFT: set[str] = set()


def _after_the_last(stage: Stage) -> Stage:
    """``stage``, which releases what the stage before has left: as a stage begins, the result of the one before has been written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(_LEFT)
        before = written()
        out = stage(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT.update(written() - before)
        return out

    return run


STAGES = [
    (name, _after_the_last(stage))
    for name, stage in (("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontamination), ("byte_bpe", byte_bpe))
]
#: The stages learn, hash and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
