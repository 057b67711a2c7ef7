"""The corpus pipeline, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner may write it as Parquet and read it again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from psephos.llm import mixing, packing, quality, secrets, simhash
from psephos.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What passes the base and the learned rules stays, with all its columns, whatever their names.

    Null and empty texts have no words and go; texts are judged whole, however long; repeated rows are judged each; an empty table stays empty.  Nulls in other columns do not matter.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    out, name = quality.judged(docs, rules)
    return out.where(out[name]["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id (of rows that share it, the first by text), with all its columns, whatever their names.

    Five-word shingles; a link is a Jaccard similarity of the sets of shingles of 0.8 or more, computed from the whole texts.  Sketches of 256 bits only propose whom to compare: sets with
    similarity 0.8 differ in 39 bits on average, with a standard deviation of 5.7, so up to 60 are proposed.  Every pair that differs in up to 31 bits meets under one of the 120 masks
    for certain, and one that differs at random in 39 with a chance of 0.99.

    Null and empty texts are equal, so one of them stays; repeated rows are copies; a null doc_id names no group, and comes after others; an empty table stays empty.
    """
    return simhash.one_of_each(docs, shingle=5, radius=7, segments=2, words=4, most=60, jaccard=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; every document stays, repeated rows as well, with all its columns, whatever their names.

    Null and empty texts stay as they are; texts are read whole, however long; an empty table stays empty.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it, with all their columns, whatever their names.

    A null source is a source of its own, the last; null and empty texts have no words and are never taken; equal hash keys go by id and size; an empty table stays empty.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of 4096 tokens.

    Null and empty texts are one piece with the end id; longer texts than a sequence are cut; repeated rows are packed each; ties between sequences do not change their number; an
    empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]
#: The learned rules, sketches and tokens are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, "stage") if k < len(STAGES) else docs
    return docs
