"""A training corpus from `documents`: five stages, each over all that the one before has kept.

Part of the quillspark.llm subpackage. Every stage takes (spark, docs, sf_dir); all but the last
return the columns of `documents`. SQL can express neither the language models nor the redaction,
so there is no SQL for the whole; tests/llm holds the stages against brute force on a small table.

Defined results: null, empty and letterless texts go in the first stage, as do texts of no known language and, if no row has a language, all;
texts of any length are read whole; of texts that tie as near duplicates the smallest doc_id stays, and of a doc_id that comes several times
all rows stay or go together in that stage; rows with null lang or source are kept like others; an empty table gives no rows; other columns are kept up to the
last stage, but for those whose names an operator's result has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import encode_documents
from quillspark.llm.common import materialized, table
from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.language_id import drop_rejected, fit_models
from quillspark.llm.near_dedup import drop_near_duplicates
from quillspark.llm.pii import redact_pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the others go. All labelled rows are learned from: the held-out third is op10's."""
    return drop_rejected(docs, fit_models(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of weight."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return redact_pii(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gives the text back."""
    done = encode_documents(docs)
    return done.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
