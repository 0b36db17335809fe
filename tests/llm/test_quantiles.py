import math
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from quirework.llm import quantiles as Q

R = "doc_id string, region_id string, region_type string, raw_text string, region_confidence double, engine_used string, ocr_at timestamp, value_e4 int"


def nearest_rank(v, p):
    return sorted(v)[max(1, math.ceil(p * len(v) / 100)) - 1]


def by_value(df):
    return df.where("v between 0 and 16383").groupBy("g", F.col("v").cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def test_exact_percentiles_and_bounded_estimates(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab") if i % 3 else "hot", max(0, min(16383, int(rnd.gauss(8000, 2500)))) if i % 2 else rnd.randrange(16384)) for i in range(30000)]
    df = spark.createDataFrame([*rows, (None, 5), ("a", None), ("a", -1), ("a", 99999)], "g string, v int")
    ranked = Q.ranks(Q.sketch(df, ["g"], F.col("v")), ["g"], Q.PCTS)
    own = {g: [v for x, v in rows if x == g] for g in {"a", "b", "hot"}} | {None: [5]}
    estimates = {(r.g, r.pct): r for r in ranked.collect()}
    assert {(r.total, r.left_out) for r in estimates.values()} == {(len(v), 3 if g == "a" else 0) for g, v in own.items()}
    for (g, p), r in estimates.items():
        v = sorted(own[g])
        rank = max(1, math.ceil(p * len(v) / 100))
        below, upto = sum(x < r.estimate for x in v), sum(x <= r.estimate for x in v)
        assert below - r.rank_error < rank <= upto + r.rank_error and r.lo <= r.estimate <= r.hi
    for r in Q.verify(by_value(df), ["g"], ranked).collect():
        assert r.ok == (r.estimate == nearest_rank(own[r.g], r.pct))
    got = {(r.g, r.pct): r.exact for r in Q.exact(by_value(df), ["g"], ranked).collect()}
    missed = 0
    for (g, p), v in got.items():
        assert v in (None, nearest_rank(own[g], p))
        missed += v is None
    assert len(got) == 20 and missed <= 1


def test_doubles(spark):
    rnd = random.Random(2)
    inf = float("inf")
    values = [rnd.gauss(0, 1) * 10 ** rnd.randint(-8, 8) for _ in range(20000)] + [0.0, -0.0, inf, -inf, 5e-324, -5e-324, 1.7e308]
    code = Q.encode(values, 63)
    assert [v for _, v in sorted(zip(code.tolist(), values))] == sorted(values)
    for bits in (24, 32, 63):
        back = Q.decode(Q.encode(values, bits), bits)
        finite = np.isfinite(values) & (np.abs(values) > 1e-300)
        assert (np.abs(back - values)[finite] <= 2.0 ** (12 - bits) * np.abs(values)[finite]).all() and (np.sign(back) == np.sign(values))[finite].all()
        assert (np.diff(Q.decode(np.sort(Q.encode(values, bits)), bits)[1:-1]) >= 0).all()
    df = spark.createDataFrame([("g", v) for v in values] + [("g", float("nan")), ("g", None), ("few", -2.5), ("few", 3.0), ("few", 3.0)], "g string, v double")
    got = {(r.g, r.pct): r for r in Q.ranks(Q.sketch(df, ["g"], F.col("v"), bits=32, doubles=True), ["g"], Q.PCTS, bits=32, doubles=True).collect()}
    v = sorted(values)
    for p in Q.PCTS:
        r, rank = got["g", p], max(1, math.ceil(p * len(v) / 100))
        assert (r.total, r.left_out) == (len(v), 2) and 0 < r.rank_error < 0.05 * len(v)
        assert abs(sum(x < r.estimate for x in v) - rank) <= r.rank_error + 1
        near = 2.0**-19 * abs(v[rank - 1])
        assert r.lo - near <= v[rank - 1] <= r.hi + near
    assert (got["few", 25].estimate, got["few", 50].estimate, got["few", 50].rank_error) == (-2.5, 3.0, 0)


def test_merging_and_deleting(spark):
    df = spark.createDataFrame([("g", i % 5000, i % 3) for i in range(9000)], "g string, v int, day int")
    for few in (0, 10**6):
        make = lambda d, by=("g",), w=None: Q.sketch(d, list(by), F.col("v"), w, few=few)
        whole = make(df)
        assert sorted(Q.merge(make(df, ("g", "day")), ["g"]).collect()) == sorted(whole.collect())
        gone = make(df.where("day = 2"), w=F.lit(-1))
        assert sorted(Q.merge(whole.unionByName(gone), ["g"]).collect()) == sorted(make(df.where("day < 2")).collect())
    # a dense and a plain sketch add up
    two = Q.merge(Q.sketch(df.where("day = 0"), ["g"], F.col("v"), few=0).unionByName(Q.sketch(df.where("day > 0"), ["g"], F.col("v"), few=10**6)), ["g"])
    r = {x.pct: x for x in Q.ranks(two, ["g"], Q.PCTS).collect()}
    assert r[50].total == 9000 and abs(r[50].estimate - nearest_rank([i % 5000 for i in range(9000)], 50)) <= r[50].rank_error


def test_regions(spark):
    row = lambda i, c, t="x", kind=" Cell", engine="A ": ("d", str(i), kind, t, c, engine, None, 1)
    rows = [row(0, 0.5), row(0, 0.5), row(1, 0.7), row(2, 1.5), row(3, None), row(4, float("nan")), row(5, 0.1, ""), row(6, 0.1, None), row(7, 1.0, kind=None), row(8, 0.3, "x" * 100000, "b", None)]
    got = {(r.engine_used, r.region_type, r.pct): r.value_e4 for r in Q.found(spark.createDataFrame(rows, R)).collect()}
    assert got["a", "cell", 50] == 5000 and got["a", "cell", 75] == 7000 and got["a", None, 5] == 10000 and got[None, "b", 95] == 3000 and len(got) == 15
    assert Q.found(spark.createDataFrame([], R)).collect() == []


def test_days_follow_the_same_rows(spark):
    """Daily sketches, merged, speak of the rows that p6_found counts."""
    day = lambda d: datetime(2025, 1, d)
    rows = [("d", str(i), "cell", "x", i / 200, "a", day(1 + i % 9), 1) for i in range(200)]
    rows += [("d", "0", "cell", "x", 0.9, "a", day(1), 1), ("d", "1", "cell", "", 0.9, "a", day(3), 1)]  # a repeated row, one without text
    r = {x.pct: x for x in Q.daily_estimates(spark.createDataFrame(rows, R)).collect()}
    want = [0.9, *(i / 200 for i in range(1, 200))]
    assert all(x.total == 200 and x.rank_error == 0 and abs(x.estimate - nearest_rank(want, p)) < 1e-6 for p, x in r.items())
