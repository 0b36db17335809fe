"""Percentiles per group from dyadic Count-sketches.

A value is encoded as a code of ``bits`` bits in the same order: a whole number as itself, a double as the first bits of
its ordered binary form (``encode``). Level l counts the dyadic intervals of length 2^l; a level with few intervals is
counted exactly, a larger one by a signed sketch of ``depth`` rows of ``width`` cells. The cells of all levels are rows
(group, level, row, cell, count): sketches of partitions, files or days are merged by adding counts, and rows with
weight -1 delete. A group with few different values in a partition sends these instead of cells (level SPARSE); values
that have no code are counted (level LEFT_OUT). A percentile descends the levels, taking the left half of an interval
if it holds enough rows. The rank error is below ``slack`` times the group's root of squared counts over sqrt(width),
added up over the sketched levels; ``ranks`` gives the interval of values that this leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import squeeze
from quirework.session import cut

CELLS = "level int, row int, cell bigint, n bigint"
SPARSE, LEFT_OUT = -1, -2
#: Up to so many different values of a group in a partition go as they are.
FEW = 128
MAX_GROUPS_HELD = 256


def encode(v: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` (at most 63) of the bits of a double, ordered like the numbers; NaN gives -1. Of the 64 bits
    12 are sign and exponent, so numbers that differ by more than 2^(12 - bits) of their size get different codes."""
    v = np.asarray(v, np.float64) + 0.0  # one zero
    raw = v.view(np.int64)
    ordered = np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63))).view(np.uint64)
    return np.where(np.isnan(v), np.int64(-1), (ordered >> np.uint64(64 - bits)).astype(np.int64))


def decode(code: np.ndarray, bits: int) -> np.ndarray:
    """The number of a code nearest to zero."""
    ordered = np.asarray(code, np.int64).astype(np.uint64) << np.uint64(64 - bits)
    negative = ordered < np.uint64(2**63)
    rest = np.uint64((1 << (64 - bits)) - 1)
    raw = np.where(negative, ~(ordered | rest), ordered ^ np.uint64(2**63))
    return np.where(negative, raw | np.uint64(2**63), raw).view(np.float64)


def _mix(x: np.ndarray, level: int, row: int) -> np.ndarray:
    """64-bit finaliser of (value, level, row): the hash must be the same in every partition and on every day."""
    seed = (level * 1009 + row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    h = x.astype(np.uint64) ^ np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def _place(node: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(node, level, row)
    return (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def _exact_level(level: int, bits: int, width: int, depth: int) -> bool:
    return (1 << (bits - level)) <= width * depth


def sketch(df: DataFrame, groups: Sequence[str], value: Column, weight: Column | None = None, bits: int = 14, width: int = 1024, depth: int = 5, doubles: bool = False, few: int = FEW) -> DataFrame:
    """Cells per group: groups + (level, row, cell, n). ``value`` is a whole number in [0, 2^bits) or, with ``doubles``,
    any number; null values, NaN and whole numbers out of range are counted as left out. A null weight does not
    count. Each partition adds up its cells before the shuffle; a group that holds most rows so sends at most one set
    of cells per partition."""
    groups = list(groups)
    src = df.select(*groups, value.cast("double" if doubles else "bigint").alias("_v"), (weight if weight is not None else F.lit(1)).cast("bigint").alias("_w")).where("_w is not null")
    fields = [src.schema[g] for g in groups]

    def cells_of(key: tuple, u: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        out_of = u < 0
        parts = [(LEFT_OUT, 0, np.zeros(1, np.int64), count[out_of].sum(keepdims=True))]
        u, count = u[~out_of], count[~out_of]
        if u.size <= few:
            parts.append((SPARSE, 0, u, count))
        for level in range(bits + 1) if u.size > few else ():
            node = u >> level
            if _exact_level(level, bits, width, depth):
                parts.append((level, 0, node, count))
            else:
                for row in range(depth):
                    cell, sign = _place(node, level, row, width)
                    parts.append((level, row, cell, sign * count))
        frames = []
        for level, row, cell, n in parts:
            c, i = np.unique(cell, return_inverse=True)
            n = np.bincount(i, weights=n, minlength=c.size).astype(np.int64)
            frames.append(pd.DataFrame({"level": np.int32(level), "row": np.int32(row), "cell": c.astype(np.int64), "n": n})[n != 0])
        out = pd.concat(frames, ignore_index=True)
        for i, g in enumerate(groups):
            out.insert(i, g, [key[i]] * len(out))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict[int, int]] = {}
        size = 0
        for pdf in batches:
            v = pdf["_v"].to_numpy(np.float64, na_value=np.nan)
            pdf["_c"] = encode(v, bits) if doubles else np.where((v >= 0) & (v < 2.0**bits), np.nan_to_num(v), -1).astype(np.int64)
            for key, part in pdf.groupby(groups, dropna=False, sort=False):
                key = tuple(None if k is None or k != k else k for k in key)
                own = held.setdefault(key, {})
                u, inv = np.unique(part["_c"].to_numpy(), return_inverse=True)
                size -= len(own)
                for x, n in zip(u.tolist(), np.bincount(inv, weights=part["_w"].to_numpy()).astype(np.int64).tolist()):
                    own[x] = own.get(x, 0) + n
                size += len(own)
            if len(held) > MAX_GROUPS_HELD or size > 1_000_000:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held: dict) -> Iterator[pd.DataFrame]:
        for key, own in held.items():
            yield cells_of(key, np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))

    return merge(src.mapInPandas(run, T.StructType(fields + T._parse_datatype_string(CELLS).fields)), groups)


def merge(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sum of sketches: of a union of days, partitions or deletions."""
    return cells.groupBy(*groups, "level", "row", "cell").agg(F.sum("n").alias("n")).where("n <> 0")


def ranks(cells: DataFrame, groups: Sequence[str], pcts: Sequence[int], bits: int = 14, width: int = 1024, depth: int = 5, doubles: bool = False, slack: float = 4.0) -> DataFrame:
    """Percentiles from the cells: groups + (pct, total, left_out, rank_error, estimate, lo, hi). The cells of a group are
    bounded by levels x depth x width and FEW a partition, whatever the group's size. The percentile lies between lo and
    hi but for a small chance (values of all groups' noise beyond ``slack``). Groups with no value that counts give none."""
    groups = list(groups)
    number = "double" if doubles else "bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels: dict[int, object] = {}
        plain, plain_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left_out = 0
        for level, part in pdf.groupby("level"):
            if level == LEFT_OUT:
                left_out = int(part["n"].sum())
            elif level == SPARSE:
                order = np.argsort(part["cell"].to_numpy())
                plain, plain_n = part["cell"].to_numpy()[order], part["n"].to_numpy()[order]
            elif _exact_level(level, bits, width, depth):
                levels[level] = dict(zip(part["cell"].tolist(), part["n"].tolist()))
            else:
                m = np.zeros((depth, width), np.int64)
                m[part["row"].to_numpy(), part["cell"].to_numpy()] = part["n"].to_numpy()
                levels[level] = m
        upto = np.concatenate([[0], np.cumsum(plain_n)])
        total = sum(levels.get(bits, {}).values()) + int(upto[-1])
        columns = [*groups, "pct", "total", "left_out", "rank_error", "estimate", "lo", "hi"]
        if total <= 0:
            return pd.DataFrame(columns=columns)

        def count(level: int, node: int) -> int:
            a, b = np.searchsorted(plain, [node << level, (node + 1) << level])
            n = int(upto[b] - upto[a])
            own = levels.get(level)
            if own is None:
                return n
            if isinstance(own, dict):
                return n + own.get(node, 0)
            got = []
            for row in range(depth):
                c, s = _place(np.array([node], np.int64), level, row, width)
                got.append(int(own[row, c[0]] * s[0]))
            return n + max(0, int(np.median(got)))

        def descend(rank: int) -> int:
            node = 0
            for level in range(bits - 1, -1, -1):
                left = count(level, 2 * node)
                node = 2 * node if rank <= left else 2 * node + 1
                rank -= 0 if node % 2 == 0 else left
            return node

        # the noise of one sketched level is at most sqrt(sum of squares / width); sketched levels add up
        noise = sqrt(sum(float((m.astype(float) ** 2).sum()) / depth / width for m in levels.values() if not isinstance(m, dict)))
        err = 0 if noise == 0 else int(slack * noise) + 1
        rows = []
        for p in pcts:
            rank = max(1, -(-p * total // 100))
            found = descend(rank)
            lo = descend(rank - err) if rank - err > 0 else 0
            hi = descend(rank + err) if rank + err <= total else (1 << bits) - 1
            rows.append((p, total, left_out, err, found, min(lo, hi, found), max(lo, hi, found)))
        out = pd.DataFrame(rows, columns=columns[len(groups) :])
        if doubles:
            for c in ("estimate", "lo", "hi"):
                out[c] = decode(out[c].to_numpy(np.int64), bits)
        for i, g in enumerate(groups):
            out.insert(i, g, [pdf[g].iloc[0]] * len(out))
        return out

    schema = T.StructType([cells.schema[g] for g in groups] + T._parse_datatype_string(f"pct int, total bigint, left_out bigint, rank_error bigint, estimate {number}, lo {number}, hi {number}").fields)
    return cells.groupBy(*groups).applyInPandas(run, schema)


def verify(counted: DataFrame, groups: Sequence[str], ranked: DataFrame) -> DataFrame:
    """ranked + ok: whether the estimate is exactly the percentile, told by the number of rows below and up to it.
    ``counted`` has groups + (_v, _n), the rows by value, added up before the shuffle."""
    groups = list(groups)
    wide = ranked.groupBy(*groups).agg(F.collect_list(F.struct("pct", "total", "estimate", "lo", "hi")).alias("_q"))
    j = counted.join(wide, [counted[g].eqNullSafe(wide[g]) for g in groups]).select(*[counted[g] for g in groups], "_v", "_n", F.explode("_q").alias("q")).select(*groups, "_v", "_n", "q.*")
    n = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)) * 100
    j = j.groupBy(*groups, "pct", "total", "estimate", "lo", "hi").agg(n(F.col("_v") < F.col("estimate")).alias("_below"), n(F.col("_v") <= F.col("estimate")).alias("_upto"))
    want = F.col("pct") * F.col("total")
    return j.withColumn("ok", (F.col("_upto") >= want) & ((F.col("_below") < want) | (F.col("_below") == 0))).drop("_below", "_upto")


def exact(counted: DataFrame, groups: Sequence[str], ranked: DataFrame) -> DataFrame:
    """Exact percentile inside the interval that the sketch leaves: groups + (pct, estimate, exact), null where the
    percentile lies outside. Values below the interval are added up, those inside counted one by one."""
    groups = list(groups)
    wide = ranked.groupBy(*groups).agg(F.collect_list(F.struct("pct", "total", "estimate", "lo", "hi")).alias("_q"))
    j = counted.join(wide, [counted[g].eqNullSafe(wide[g]) for g in groups]).select(*[counted[g] for g in groups], "_v", "_n", F.explode("_q").alias("q"))
    j = j.where(F.col("_v") <= F.col("q.hi")).select(*groups, "q.*", F.when(F.col("_v") >= F.col("q.lo"), F.col("_v")).otherwise(-1).alias("_v"), "_n")
    j = j.groupBy(*groups, "pct", "total", "estimate", "_v").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*groups, "pct").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("_ok", F.sum("_n").over(w) * 100 >= F.col("pct") * F.col("total"))
    return j.groupBy(*groups, "pct", "estimate").agg(F.min(F.when(F.col("_ok"), F.col("_v"))).alias("exact")).withColumn("exact", F.when(F.col("exact") >= 0, F.col("exact")))


PCTS = (5, 25, 50, 75, 95)


def confidences(region_ocr: DataFrame) -> DataFrame:
    """(engine_used, region_type, day, confidence, value_e4) of the regions that count, each (doc_id, region_id) once: its
    latest usable row."""
    c = F.col("region_confidence")
    good = region_ocr.where((c >= 0) & (c <= 1) & (F.regexp_replace("raw_text", r"\s+", "") != ""))
    row = F.struct("ocr_at", squeeze(F.col("engine_used")).alias("engine_used"), squeeze(F.col("region_type")).alias("region_type"), F.round(c * 10000).cast("int").alias("value_e4"), c.alias("confidence"))
    r = good.select("doc_id", "region_id", row.alias("r")).groupBy("doc_id", "region_id").agg(F.max("r").alias("r"))
    return r.select("r.engine_used", "r.region_type", F.to_date("r.ocr_at").alias("day"), "r.confidence", "r.value_e4")


def found(region_ocr: DataFrame) -> DataFrame:
    """The sketch's estimates, each checked by an exact count of the rows below it; one that fails the check is found by
    counting inside its interval, and if it is not there either, over the whole range."""
    groups = ["engine_used", "region_type"]
    values = confidences(region_ocr)
    ranked = cut(ranks(sketch(values, groups, F.col("value_e4")), groups, PCTS))
    counted = values.groupBy(*groups, F.col("value_e4").cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    checked = cut(verify(counted, groups, ranked))
    good = checked.where("ok").select(*groups, "pct", F.col("estimate").cast("int").alias("value_e4"))
    wrong = checked.where("not ok")
    if wrong.isEmpty():
        return good
    got = exact(counted, groups, wrong)
    missed = got.where("exact is null").withColumnsRenamed({g: f"_{g}" for g in groups}).select(*[f"_{g}" for g in groups], F.col("pct").alias("_pct"))
    outside = wrong.join(missed, [wrong[g].eqNullSafe(missed[f"_{g}"]) for g in groups] + [wrong["pct"] == missed["_pct"]], "left_semi")
    again = exact(counted, groups, outside.withColumns({"lo": F.lit(0).cast("bigint"), "hi": F.lit(1 << 14).cast("bigint")}))
    rest = got.where("exact is not null").unionByName(again)
    return good.unionByName(rest.select(*groups, "pct", F.col("exact").cast("int").alias("value_e4")))


def daily_estimates(region_ocr: DataFrame, bits: int = 32) -> DataFrame:
    """Sketches of the confidences of separate days as doubles, merged, and the percentiles with their bounds that they
    give without a second look at the rows."""
    groups = ["engine_used", "region_type"]
    daily = sketch(confidences(region_ocr), [*groups, "day"], F.col("confidence"), bits=bits, doubles=True)
    return ranks(merge(daily, groups), groups, PCTS, bits=bits, doubles=True)
