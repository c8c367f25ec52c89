"""A corpus pipeline of five stages over ``documents``, each from an operator of ``tonelake.llm``.

Toxic documents go, one document of each near-duplicate class stays, words in repeated passages are
removed, documents that contain benchmark items go, and what is left is encoded by BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.bpe import bpe_encode, digests
from tonelake.llm.common import read, small_batches, written
from tonelake.llm.contamination import contained_items
from tonelake.llm.neardup import one_of_each_class
from tonelake.llm.queries import WINDOW, remainder, word_bpe_path
from tonelake.llm.substrings import suffix_dedup
from tonelake.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.3 or more. Null and empty texts stay."""
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    return drop_toxic(docs, fit_toxicity(docs, labels, remainder("doc_id", 4) == 2), 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class: that of the least doc_id."""
    return one_of_each_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in windows that repeat; changed texts are their kept words joined by one space."""
    small_batches(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    # carried under names of its own, as any column may share one with the operator's results
    named = docs.select("doc_id", "text", *[docs[c].alias(f"carried_{i}") for i, c in enumerate(rest)])
    kept = suffix_dedup(named, WINDOW, carry=tuple(f"carried_{i}" for i in range(len(rest))), whole=True)
    back = {c: F.col(f"carried_{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in rest:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item. Texts are keyed by their digest, so documents without an id count too."""
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    keyed = docs.select(F.struct("*").alias("row"), digest.alias("key"))
    texts = docs.select(digest.alias("key"), docs["text"])
    found = contained_items(texts, read(spark, sf_dir, "benchmark", "item_id", "text"), key="key")
    return keyed.join(found.select("key").distinct(), "key", "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text that is left."""
    return digests(bpe_encode(docs, word_bpe_path()))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Toxicity and BPE are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what one returns is a table in the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
