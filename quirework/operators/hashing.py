"""Perceptual hashes as hex text: distances, and exact similarity joins by bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def normal(c: Column) -> Column:
    """Hex digits in lower case without white space around and 0x; null for missing, malformed or one-digit patterns."""
    h = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "^0x", "")
    return F.when(h.rlike("^[0-9a-f]+$") & ~h.rlike(r"^(.)\1*$"), h)


def words(code: Column) -> Column:
    """Hex digits as 16-bit numbers, four digits each."""
    return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(4)), lambda i: F.conv(F.substr(code, i, F.lit(4)), 16, 10).cast("int"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bands(code: Column, bits: int, n: int) -> Column:
    """The hash cut into n bands of nearly equal width as numbers, from its 16-bit words."""
    ends = [round(i * bits / n) for i in range(n + 1)]
    out = []
    for lo, hi in zip(ends, ends[1:]):
        value = F.lit(0).cast("bigint")
        for at in range(lo // 16, -(-hi // 16)):  # the part of each word that lies in the band
            a, b = max(lo, at * 16), min(hi, at * 16 + 16)
            part = F.shiftright(F.get(code, F.lit(at)).cast("bigint"), at * 16 + 16 - b).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
            value = F.shiftleft(value, b - a).bitwiseOR(part)
        out.append(value)
    return F.array(*out)


def similar_pairs(codes: DataFrame, max_distance: int = 10) -> DataFrame:
    """(hash_a, hash_b, distance), hash_a < hash_b: different hashes of equal length within the distance, all of them.

    A hash cut into m bands that is within distance d of another agrees with it in some band up to d // m bits. Every
    band value goes out once for the one side and with every pattern of that many bits for the other, so the pairs
    meet in an equi-join; the exact distance decides. Long hashes have d + 1 bands, which must agree in full, as long as
    these are at least 16 bits wide; shorter ones bands of 16 bits. ``codes`` has a column hash; repeated and null ones
    count once and not at all. Bands that very many different hashes share are split by the skew join of AQE.
    """
    h = codes.select("hash").where("hash is not null").distinct().withColumn("w", words(F.col("hash"))).withColumn("m", F.size("w"))
    lengths = [r["m"] for r in h.select("m").distinct().collect()]  # one row per length of hash
    out = None
    for m in lengths:
        n = max_distance + 1 if (max_distance + 1) * 16 <= m * 16 else m
        near = min(16, max_distance // n)
        masks = sorted(sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(16), k))
        own = h.where(F.col("m") == m).withColumn("v", bands(F.col("w"), m * 16, n) if n != m else F.col("w").cast("array<bigint>"))
        base = own.select(F.col("hash").alias("hash_b"), F.col("w").alias("wb"), F.posexplode("v").alias("band", "v"))
        probe = own.select(F.col("hash").alias("hash_a"), F.col("w").alias("wa"), F.posexplode("v").alias("band", "v0"))
        probe = probe.select("hash_a", "wa", "band", F.explode(F.transform(F.array(*[F.lit(x).cast("bigint") for x in masks]), lambda x: x.bitwiseXOR(F.col("v0")))).alias("v"))
        p = probe.join(base, ["band", "v"]).where("hash_a < hash_b").withColumn("distance", distance(F.col("wa"), F.col("wb"))).where(F.col("distance") <= max_distance)
        p = p.select("hash_a", "hash_b", "distance").distinct()
        out = p if out is None else out.unionByName(p)
    return out if out is not None else codes.sparkSession.createDataFrame([], "hash_a string, hash_b string, distance int")


def grid_bits(embedding: Column) -> tuple[Column, Column]:
    """ahash and dhash bits of an 8x8 grid, over whole millionths so that sums are exact."""
    q = F.transform(embedding, lambda x: F.floor(x.cast("double") * 1000000).cast("bigint"))
    total = F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x)
    a = F.array_join(F.transform(q, lambda x: F.when(x * 64 > total, "1").otherwise("0")), "")
    d = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: i % 8 < 7), lambda i: F.when(F.element_at(q, i + 2) > F.element_at(q, i + 1), "1").otherwise("0")), "")
    return a, d


def nearest(df: DataFrame, key: str, vector: str, k: int, is_query: Column, label: str | None = None) -> DataFrame:
    """(query, other, sq_distance, rank, label): the k nearest other rows of every query row, exact, in whole millionths.

    Query rows meet all rows in blocks: a block of queries and a block of rows are one task's work, so no task
    holds more than two blocks; per block only k rows per query go on.
    """
    cols = [F.col(key).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 1000000).cast("bigint")).alias("v"), (F.col(label) if label else F.lit(None)).cast("int").alias("label")]
    src = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n = src.count()
    nb = max(1, -(-n // (BLOCK * 4)))
    rows = src.select(*cols).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(nb))).groupBy("b").agg(F.collect_list(F.struct("id", "v", "label")).alias("r"))
    qs = src.where(is_query).select(*cols[:2])
    nq = max(1, -(-n // (BLOCK * 20)))
    qs = qs.withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nq))).groupBy("q").agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    pairs = qs.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint")))).join(rows, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, p in pdf.iterrows():
                size = max((len(x["v"]) for x in p["r"]), default=0)
                r = [x for x in p["r"] if len(x["v"]) == size]
                q = [x for x in p["qs"] if len(x["v"]) == size]
                if not r or not q:
                    continue
                ids, v, lab = np.array([x["id"] for x in r]), np.array([list(x["v"]) for x in r], np.int64), [x["label"] for x in r]
                for x in q:
                    d = ((v - np.array(list(x["v"]), np.int64)) ** 2).sum(1)
                    d = np.where(ids == x["id"], np.iinfo(np.int64).max, d)
                    best = np.lexsort((ids, d))[: k + 1]
                    best = [i for i in best if ids[i] != x["id"]][:k]
                    yield pd.DataFrame({"query": x["id"], "other": ids[best], "sq_distance": d[best], "label": pd.array([lab[i] for i in best], "Int32")})

    from pyspark.sql import Window

    got = pairs.mapInPandas(run, "query bigint, other bigint, sq_distance bigint, label int")
    w = Window.partitionBy("query").orderBy("sq_distance", "other")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
