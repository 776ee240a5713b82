"""A corpus from documents: toxic texts out, near duplicates out, benchmark passages out, secrets masked, sources mixed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller may write and read
again as the next one's docs.  All but the last return the columns of ``documents``.  Each stage works on all its predecessor kept.

- toxicity: rows that score 0.5 or more go (operator 4, trained from ``labels``);
- near duplicates: of each group the smallest doc_id stays (operator 8 on five-word shingles, similarity 0.8);
- decontamination: rows with a window of ten words of ``benchmark`` go (operator 9);
- secrets: every secret is replaced by ``<SECRET>``, rows stay (operator 5);
- mixing: the rows of the mix, once for each copy, with ``epoch`` and ``mix_order`` (operator 2).

Null and empty texts pass the first four stages and are in no mix; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import decontaminate, mixing, secret_scan, simhash, toxicity
from quotemill.llm.common import stored
from quotemill.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(docs, mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Learned scores and suffix arrays are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), like=name)
    return STAGES[-1][1](spark, docs, sf_dir)
