"""Batches that end at some bytes, and what the operators of the pipeline leave of a session's settings."""

import pyarrow as pa
import pytest

from millrace.llm import batches, cotraining, packing, secret_scan

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)
    if before is not None:
        spark.conf.set(LIMIT, before)


@pytest.fixture
def sizes():
    def work(some):
        for batch in some:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sum(map(len, batch.column("text").to_pylist()))])], ["n", "size"])

    return work


def test_batches_end_at_some_bytes(spark, unset, sizes):
    rows = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 500000) text")
    got = batches.in_batches(rows, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 60 and len(got) > 5
    assert max(r.size for r in got) <= batches.BATCH_BYTES + 500_000
    wide = spark.range(0, 3, 1, 1).selectExpr("repeat('x', 6000000) text")
    assert sorted(r.n for r in batches.in_batches(wide, sizes, "n long, size long").collect()) == [1, 1, 1]
    assert batches.in_batches(rows.where("false"), sizes, "n long, size long").count() == 0


@pytest.mark.parametrize("operator", [packing.token_pieces, secret_scan.redact, lambda docs: cotraining.accepted(docs, cotraining.Model(None))])
def test_operators_limit_batches(spark, docs, unset, operator):
    rows = docs((1, "a text"), (2, None), (None, ""))
    assert operator(rows).count() == 3
    assert spark.conf.get(LIMIT) == str(batches.BATCH_BYTES)


def test_a_size_that_the_session_has_stays(spark, unset, sizes):
    spark.conf.set(LIMIT, "1000000")
    batches.limit_batches(spark)
    assert spark.conf.get(LIMIT) == "1000000"
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 100000) text")
    assert max(r.size for r in batches.in_batches(rows, sizes, "n long, size long").collect()) <= 1_100_000
