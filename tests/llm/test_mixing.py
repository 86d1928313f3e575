"""Rates so high that the chance of no copy underflows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing


@pytest.mark.parametrize("rate", [1, 20, 500, 744, 1000, 100_000])
def test_high_rates(spark, rate):
    rows = [(k, "x", "src0") for k in range(400)] + [(1000 + k, "y" * (20 * rate - 4), "src1") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    (found,) = mixing.source_rates(docs, "source", "text", {"src0": 0.2}, mixing.ALPHA, 1.0).filter("key = '=src0'").collect()
    assert abs(found.rate - rate) < 1e-6 and abs(found.cdf[-1] - 1) < 1e-8 and len(found.cdf) < 24 * rate**0.5 + 40 and (np.diff(found.cdf) >= 0).all()
    u = np.array([x.u for x in docs.filter("source = 'src0'").select(mixing.uniform(mixing.SEED, F.col("doc_id")).alias("u")).collect()])
    counts = found.least + np.searchsorted(found.cdf, u, side="right")
    assert abs(counts.mean() - rate) < 5 * (rate / 400) ** 0.5 and 0.6 < counts.var() / rate < 1.5
    if rate <= 1000:
        made = mixing.mix(docs, targets={"src0": 0.2}).filter("source = 'src0'").groupBy("doc_id").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        assert tuple(made) == (counts.sum(), (counts**2).sum())


def test_rates_beyond_32_bits(spark, monkeypatch):
    """Chances sum to 1 and copies are counted in blocks, whose lists stay short."""
    docs = spark.createDataFrame([(k, "x", "src0") for k in range(20)], "doc_id long, text string, source string")
    (found,) = mixing.source_rates(docs, "source", "text", {"src0": 1.0}, mixing.ALPHA, 1e10).collect()
    assert found.rate == 1e10 and abs(found.cdf[-1] - 1) < 1e-7 and len(found.cdf) < 24 * 1e5 + 40
    middle = found.least + np.searchsorted(found.cdf, 0.5)
    assert abs(middle - 1e10) < 2 and abs(found.least + np.searchsorted(found.cdf, 0.841344746) - 1e10 - 1e5) < 1000
    counts = [0, 1, 99_999, 100_000, 100_001, 10**10 + 7]
    rows = spark.createDataFrame([(n,) for n in counts], "n long")
    blocks = rows.filter("n > 0").selectExpr("n", f"explode(sequence(0L, (n - 1) div {mixing.COPIES})) as block").selectExpr("n", f"least(n, (block + 1) * {mixing.COPIES}) - block * {mixing.COPIES} as size")
    assert {x.n: (x.m, x.most) for x in blocks.groupBy("n").agg(F.sum("size").alias("m"), F.max("size").alias("most")).collect()} == {n: (n, min(n, mixing.COPIES)) for n in counts[1:]}
    monkeypatch.setattr(mixing, "COPIES", 7)
    got = mixing.numbered(spark.createDataFrame([(n,) for n in (0, 1, 6, 7, 8, 14, 50)], "n long"), "n", "copy").groupBy("n").agg(F.sort_array(F.collect_list("copy")).alias("all")).collect()
    assert {x.n: x.all for x in got} == {n: list(range(1, n + 1)) for n in (1, 6, 7, 8, 14, 50)}


def test_chances(spark):
    """Against exact fractions, at small and large rates."""
    ks, rates = [0, 1, 5, 15, 16, 17, 40, 300], [0.01, 0.5, 7.25, 16.0, 250.0]
    rows = [(float(k), r) for k in ks for r in rates]
    got = [x[0] for x in spark.createDataFrame(rows, "k double, r double").coalesce(1).select(mixing.chance(F.col("k"), F.col("r"))).collect()]
    want = [math.exp(k * math.log(r) - r - math.lgamma(k + 1)) for k, r in rows]
    assert all(abs(a - b) <= 1e-11 * b + 1e-300 for a, b in zip(got, want))


def test_tables_of_rates_too_large_to_broadcast(spark, monkeypatch):
    """Hot sources are broadcast, the others join by a shuffle; the draw stays the same."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', int(id % 50)) as text", "if(id % 3 = 0, 'big', if(id % 7 = 0, null, concat('s', id % 400))) as source", "7 as copy_no")
    rows = lambda: sorted(tuple(x) for x in mixing.mix(docs).select("doc_id", "copy_no", "copy_no_1", "shuffle_key").collect())
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_CHANCES", 2000)
    monkeypatch.setattr(mixing, "HOT_SHARE", 10)
    assert rows() == want and want and {x[1] for x in want} == {7}


def test_rate_of_zero(spark):
    docs = spark.createDataFrame([(1, "x", "src0"), (2, "y", "src1")], "doc_id long, text string, source string")
    (found,) = mixing.source_rates(docs, "source", "text", {"src0": 0.0}, mixing.ALPHA, 1.0).filter("key = '=src0'").collect()
    assert found.cdf[0] == 1 and mixing.mix(docs, targets={"src0": 0.0}).filter("source = 'src0'").count() == 0
