"""From raw documents to packed training sequences.

Each stage works on all that the one before kept: the quality classifier rejects documents, of equal texts one stays, of each
group of linked near copies one stays, contaminated documents go, and the rest is packed. All but the last return the
columns of documents. ``run`` writes each stage's result to the shared folder, and the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embergrid.llm import decontaminate, exact_dedup, jaccard, langid, packing, quality
from embergrid.llm.common import staged, table


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns as the registered query does, from two thirds of the labels.

    Null, empty and very long texts have a score as any other; each row is judged on its own, so repeated rows and ids go or stay alike; without labels all have the score 0.5 and
    stay; an empty table stays empty; columns are those of docs, whatever their names."""
    labels = table(spark, sf_dir, "labels").where(langid.remainder(3) != 1)
    return quality.keep_good(docs, quality.fit(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: that with the most code points, then the smallest id (null last).

    Null and empty texts are one group; texts of any length are compared whole; repeated rows leave one; columns are those of docs."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays.

    Null and empty texts link with nothing and stay; texts of any length count with all their shingles; of rows that tie on the smallest id those of one text stay; columns are
    those of docs."""
    return jaccard.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % or more of their words in benchmark windows go; all others stay as they are.

    Null and empty texts have no words and stay; texts of any length are matched whole; each row is judged on its own; without benchmark items all stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids, packed: a row a piece, as the registered query returns them.

    A null or empty text is its end id alone; a text of any length becomes as many pieces as it needs; repeated rows and ids are packed each on its own; no document gives no piece."""
    return packing.pack_documents(docs, special=True)


STAGES = [
    ("quality", good_texts),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]
ORACLE_SQL = None  # a learned classifier and packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
