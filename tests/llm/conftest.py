"""Fixtures of odd documents: nulls, empty and long texts, ties, repeats, clashing columns."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_docs import CLASHING, SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.withColumns({name: F.lit(f"{name}!") for name in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
