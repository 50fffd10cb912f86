"""Fixtures of the corpus tests."""

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang, source]) to a table with the columns of documents."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

    def build(rows, partitions=2):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def clashing():
    """The same table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "score lang_pred held_out n_words n_removed kept kept_sha256 kept_text fingerprint component_id labels piece start length row block bin cleaned word ids refs known tokens".split()

    def build(df, keep=()):
        return df.select("*", *[F.lit(k).cast(DoubleType() if k % 2 else StringType()).alias(n) for k, n in enumerate(names) if n not in keep])

    return build
