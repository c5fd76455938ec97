"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage keeps a defined result for nulls in any column, repeated rows and empty tables; the docstrings say which. What a
stage writes for itself is deleted when a later stage begins, unless that stage's input still reads it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import jaccard, mixing, packing, quality, secretscan
from tremor.llm.common import collecting, delete, documents, stage
from tremor.llm.registry import tokenizer_path

_left: dict[str, list[str]] = {}


def _stage_of(f):
    """A stage that first deletes what earlier ones have left behind."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        reads = docs.inputFiles() if left else []
        free = [p for p in left if not any(p.partition(":")[2].lstrip("/") in r for r in reads)]
        delete(spark, free)
        with collecting() as made:
            out = f(spark, docs, sf_dir)
        left[:] = [p for p in left if p not in free] + made
        return out

    return run_stage


@_stage_of
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts are scored like any other; repeated rows are judged alike and each kept or not; of an empty table
    nothing is left.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage_of
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest id stays.

    Texts without words are linked with nothing and stay, null ones too; rows that repeat an id share its fate; an empty
    table stays empty.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


@_stage_of
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark.

    Null texts stay null, rows without secrets stay as they are, repeated rows are each treated, an empty table stays empty.
    """
    return secretscan.redacted(docs)


@_stage_of
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of text that the mix of sources takes.

    A null source is one of its own; null and empty texts have no words to take, so they go; repeated rows are documents of
    their own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


@_stage_of
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset.

    Null texts count as empty; rows that repeat an id are documents of their own; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("secret scans", secret_stage), ("mixing sources", mixing_stage), ("best-fit packing", packing_stage)]

#: The classifier, the pseudorandom mix and the packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with collecting() as written:
                docs = stage(docs, f"stage{k}")
            delete(spark, before)
            before = written
    _left.pop(spark.sparkContext.applicationId, None)  # the result still reads the last stage's tables
    return docs
