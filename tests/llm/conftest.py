import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    b = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC"))
    s = b.getOrCreate()
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def table(spark):
    """Makes a documents table from texts, with ids from 0, or from (id, text) pairs."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return make


AWKWARD = [None, "", " ", "\n\n", "a", "word " * 30, "x" * 5000, "é ü ñ 語 \U0001f600   \x1c z",
           "same text", "same text", "One. Two? Three!\nFour.", "%41%zz \\u0041 QUtJQQ== " * 3,
           (None, "id is null"), (None, None), (3, "id used twice"), (3, "id used twice")]


@pytest.fixture
def awkward(table):
    """Nulls, empty and long texts, ties, repeated rows."""
    return table(AWKWARD)


@pytest.fixture
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
