import random

from pyspark.sql import functions as F

from quirework.operators import hashing, knowledge


def test_pairs_by_brute_force(spark):
    rnd = random.Random(3)
    codes = set()
    for bits in (64, 256):
        for _ in range(60):
            x = rnd.getrandbits(bits)
            codes.add(f"{x:0{bits // 4}x}")
            for _ in range(3):
                y = x
                for b in rnd.sample(range(bits), rnd.randint(0, 14)):
                    y ^= 1 << b
                codes.add(f"{y:0{bits // 4}x}")
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in codes for b in codes if a < b and len(a) == len(b)}
    want = {x for x in want if x[2] <= 10}
    df = spark.createDataFrame([(c,) for c in [*codes, *codes]] + [(None,)], "hash string")
    assert {tuple(r) for r in hashing.similar_pairs(df).collect()} == want and len(want) > 50
    assert hashing.similar_pairs(df.limit(0)).collect() == []


def test_spellings(spark):
    df = spark.createDataFrame([(" 0XAB12\n",), ("aaaa",), ("",), (None,), ("xyz",), ("0x",)], "h string")
    assert [r[0] for r in df.select(hashing.normal(F.col("h"))).collect()] == ["ab12", None, None, None, None, None]


def test_nearest_by_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(90)] + [(200, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {(r.query, r.rank): r.other for r in hashing.nearest(df, "vec_id", "embedding", 3, F.col("vec_id") % 20 == 0).collect()}
    for q in range(0, 90, 20):
        order = sorted((sum((a - b) ** 2 for a, b in zip(rows[q][1], r[1])), r[0]) for r in rows[:90] if r[0] != q)
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in order[:3]]
    assert knowledge.vote(df.limit(0)).collect() == []


def test_pack_round_trip(spark, sf, tmp_path):
    k = spark.read.parquet(f"{sf}/knowledge.parquet")
    knowledge.export_pack(k, "p", f"{tmp_path}/p")
    back = knowledge.import_pack(spark, f"{tmp_path}/p", k.select(*knowledge.ENTRY).schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, k.select(*knowledge.ENTRY).collect()))
