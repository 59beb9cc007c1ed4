"""Batches sent to Python: bounded by bytes, and by the session's own limit where it has one."""

import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.session import BATCH_LIMIT, ship


def _largest(df):
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    return df.mapInArrow(run, "n long").first()[0]


def test_batches_are_bounded(spark):
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 500).cast("binary").alias("text"))
    session = spark.newSession()
    ship(session)
    assert session.conf.get(BATCH_LIMIT) == "8m"
    assert _largest(session.range(0, 6000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 500).cast("binary").alias("text"))) < 9 << 20 < _largest(texts)


def test_own_limit_stays(spark):
    session = spark.newSession()
    session.conf.set(BATCH_LIMIT, "1m")
    ship(session)
    assert session.conf.get(BATCH_LIMIT) == "1m"
