"""The k most similar vectors for every vector.

Vectors are spread over cells, the regions of centres fitted on a bounded sample and shifted so that the cells hold
about equally many. Each cell is a shard with a hierarchical small-world graph (a cell that turns out larger is split
into several). A vector is indexed in the cell of its first centre; there it is searched from its own node, and in the
cells of its next centres from above: in a number of cells, a share of all or all (``probes=None``). The lists of the
shards are merged. Three probes find what is really alike (cosine of 0.95 and more), as such vectors share their first
centres; the nearest of vectors that have nothing alike may lie in any cell, so for them the probes must grow with the
number of cells. ``exact=True`` compares with every vector of every cell instead of walking the graphs. Equal vectors
are one node; their ids are put back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.graph import Hnsw
from quirework.session import cut

K = 5
CELL_ROWS = 4096
#: A cell that holds more is split into shards, which are all searched.
SHARD_ROWS = 6144
#: The centres are fitted on a sample of about so many ids for each, at least SAMPLE_ROWS in all.
MAX_CENTRES = 8192
SAMPLE_PER_CENTRE = 8
SAMPLE_ROWS = 4096
#: Probes and beam for what is alike, and for the nearest of every vector (a share of the cells).
PROBES = 3
EF = 32
SHARE = 0.7
WIDE_EF = 96
#: About so many vectors from other cells are searched in a shard at a time; more come in several blocks.
GUEST_ROWS = 32768
SPREAD_BYTES = 32 << 20
FIELDS = {"histogram_signature": (256, True), "ssim_features": (48, False)}


def unit_rows(column: pa.ChunkedArray | pa.Array, size: int, non_negative: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit float32 rows) of the lists that count: ``size`` finite values, not all zero, none negative
    where that is asked. Null, short, long and impossible lists do not count."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(a.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == size)
    if not rows.size:
        return rows, np.zeros((0, size), np.float32)
    flat = a.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, size)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    if non_negative:
        ok &= (x >= 0).all(1)
    rows, x = rows[ok], x[ok]
    x = x / np.abs(x).max(1, keepdims=True)  # before squaring, for values near the ends of the range
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return rows, x.astype(np.float32)


class Cells:
    """Centres of the cells of one field, with the offsets that balance them, and how often each is first or a later
    choice in the sample, as numbers of shards and blocks."""

    def __init__(self, sample: np.ndarray, n: int, cell_rows: int, probes: float | None):
        _, first = np.unique(sample, axis=0, return_index=True)  # repeated rows are one point
        x = sample[np.sort(first)]
        k = max(1, min(MAX_CENTRES, -(-n // cell_rows), len(x)))
        self.centres, self.offset = x[:k].copy(), np.zeros(k, np.float32)
        self.shards, self.blocks = np.ones(k, np.int64), np.ones(k, np.int64)
        if k > 1:
            self._fit(x)
        self.probes = n_probes(probes, k)
        if len(x):
            ranked = self.rank(x)
            times = n / len(x)
            self.shards = np.maximum(1, np.ceil(np.bincount(ranked[:, 0], minlength=k) * times / SHARD_ROWS)).astype(np.int64)
            guests = np.bincount(ranked[:, 1:].ravel(), minlength=k) * times
            self.blocks = np.maximum(1, np.ceil(guests / GUEST_ROWS)).astype(np.int64)

    def _fit(self, x: np.ndarray, moves: int = 6, rounds: int = 24) -> None:
        """Spherical means, then offsets that push cells above their share away: the step of a cell shrinks when it
        goes from too large to too small or back. The best of the rounds counts."""
        k = len(self.centres)
        step, before, best = np.zeros(k), np.zeros(k), (np.inf, self.offset)
        for r in range(moves + rounds):
            home, spread = [], []
            for at in range(0, len(x), 2048):
                s = x[at : at + 2048] @ self.centres.T - self.offset
                home.append(s.argmax(1))
                if r == moves:  # how far apart the first two choices of the points are
                    two = np.partition(s, k - 2, axis=1)[:, -2:]
                    spread.append(two[:, 1] - two[:, 0])
            own = np.concatenate(home)
            count = np.bincount(own, minlength=k)
            if r < moves:
                order = np.argsort(own, kind="stable")
                has = np.flatnonzero(count)
                c = np.add.reduceat(x[order], (np.cumsum(count) - count)[has], axis=0)
                self.centres[has] = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                continue
            if count.max() < best[0]:
                best = count.max(), self.offset.copy()
            if r == moves:
                gap = np.concatenate(spread)
                near = np.bincount(own, weights=gap, minlength=k) / np.maximum(count, 1)
                step = np.where(near > 0, near, gap.mean()) / 4
            over = np.sign(count * (k / len(x)) - 1) * (np.abs(count * (k / len(x)) - 1) > 0.05)
            step = np.where(over * before < 0, step / 2, step * 1.2)
            before = over
            self.offset = (self.offset + over * step).astype(np.float32)
        self.offset = best[1]

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The cells of a vector's first centres, in order."""
        k = len(self.centres)
        if k <= 1:
            return np.zeros((len(x), 1), np.int64)
        out = []
        for at in range(0, len(x), 2048):
            s = x[at : at + 2048] @ self.centres.T - self.offset
            top = np.argpartition(-s, self.probes - 1, axis=1)[:, : self.probes]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, self.probes), np.int64)


def fit_cells(df: DataFrame, key: str, fields: dict, n: int, cell_rows: int, probes: float | None) -> list[Cells]:
    """Cells per field from the ids whose hash falls in the sample; rows of one id count once."""
    want = max(SAMPLE_ROWS, SAMPLE_PER_CENTRE * min(MAX_CENTRES, -(-n // cell_rows)))
    share = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(1, n)))
    got = df.where(share).groupBy(key).agg(*[F.min(f).cast("array<float>").alias(f) for f in fields]).select(F.xxhash64(key).alias("_h"), key, *fields).orderBy("_h", key).drop("_h").toArrow()
    return [Cells(unit_rows(got[f], size, neg)[1], n, cell_rows, probes) for f, (size, neg) in fields.items()]


def n_probes(probes: float | None, cells: int) -> int:
    """Cells to search: an int is their number, a float a share of all but at least PROBES, None all."""
    if isinstance(probes, float):
        probes = max(PROBES, math.ceil(probes * cells))
    return min(probes or cells, cells)


def search_shard(pdf: pd.DataFrame, size: int, k: int, ef: int = EF, least: float | None = None, exact: bool = False) -> tuple[np.ndarray, list, list]:
    """(ids, lists of neighbours, lists of similarities) of one shard: its own vectors and those that probe it."""
    vec = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, size)
    ids = pdf["id"].to_numpy(object)
    own = pdf["own"].to_numpy(bool)
    # equal vectors are one node with the smallest id; own rows come before guests
    order = np.lexsort((ids.astype(str), ~own))
    _, first = np.unique(np.stack([pdf["h1"].to_numpy(), pdf["h2"].to_numpy()], 1)[order], axis=0, return_index=True)
    rows = order[np.sort(first)]
    index, guests = rows[own[rows]], rows[~own[rows]]
    if not index.size:
        return ids[:0], [], []
    nodes = np.ascontiguousarray(vec[index])
    rows = np.concatenate([index, guests])
    if exact:
        found = [nearest(nodes, vec[rows[at : at + 1024]], np.arange(at, at + 1024), k) for at in range(0, len(rows), 1024)]
    else:
        g = Hnsw(nodes)
        found = [g.search_own(k, max(8, ef // 4))] + ([g.search(vec[guests], k, ef)] if guests.size else [])
    near, sim = (np.concatenate(x) for x in zip(*found))
    some = np.flatnonzero(((near >= 0) & (sim >= (-2 if least is None else least - 1e-4))).any(1))
    out_n, out_s = [], []
    for at in range(0, len(some), 4096):
        r = some[at : at + 4096]
        precise = np.einsum("nkd,nd->nk", nodes[np.maximum(near[r], 0)].astype(np.float64), vec[rows[r]].astype(np.float64))
        keep = (near[r] >= 0) & (sim[r] >= (-2 if least is None else least - 1e-4))
        names = ids[index[np.maximum(near[r], 0)]]
        out_n += [a[m].tolist() for a, m in zip(names, keep)]
        out_s += [a[m].tolist() for a, m in zip(precise, keep)]
    return ids[rows[some]], out_n, out_s


def nearest(nodes: np.ndarray, q: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(node numbers, similarities) of the k most similar nodes by full comparison; a query that is a node, by its
    number, is not its own neighbour."""
    s = q @ nodes.T
    r = np.arange(len(q))
    own = numbers[: len(q)] < len(nodes)
    s[r[own], numbers[: len(q)][own]] = -np.inf
    c = min(k, len(nodes))
    top = np.argpartition(-s, c - 1, axis=1)[:, :c]
    sim = np.take_along_axis(s, top, 1)
    near = np.full((len(q), k), -1, np.int64)
    out = np.full((len(q), k), -np.inf, np.float32)
    near[:, :c], out[:, :c] = np.where(np.isfinite(sim), top, -1), sim
    return near, out


def neighbours(df: DataFrame, key: str = "entry_id", fields: dict | None = None, k: int = K, probes: float | None = SHARE, cell_rows: int = CELL_ROWS, ef: int = WIDE_EF, least: float | None = None, exact: bool = False) -> DataFrame:
    """(field_name, id, other, sim, rank): the k most similar other ids of every id, per vector field.

    Ids count once (their rows carry the same vector); ids without a usable vector neither query nor answer. Ties
    go to the smaller id. Null ids do not count. Only the probed cells are searched, and there with a beam of ef, so
    some of the k may be missed and others come out instead; fewer than k come out where the probed cells hold fewer
    or, with ``least``, where fewer are that similar. With ``exact`` all cells are compared in full and nothing is
    missed, at a cost that grows with the square of the rows.
    """
    fields = fields or FIELDS
    names = list(fields)
    df = df.select(key, *fields).where(F.col(key).isNotNull())
    n = df.count()
    cells = fit_cells(df, key, fields, n, cell_rows, None if exact else probes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for f, name in enumerate(names):
                rows, x = unit_rows(b.column(1 + f), *fields[name])
                if not rows.size:
                    continue
                # within a batch equal vectors go on once, with the smallest id
                h = np.stack([b.column(1 + len(names) + 2 * f + i).to_numpy() for i in (0, 1)], 1)[rows]
                order = np.argsort(ids[rows].astype(str), kind="stable")
                _, first = np.unique(h[order], axis=0, return_index=True)
                keep = order[first]
                rows, x, h = rows[keep], x[keep], h[keep]
                ranked = cells[f].rank(x)
                step = max(1, SPREAD_BYTES // (x.shape[1] * 4 * ranked.shape[1]))
                for i in range(0, len(x), step):
                    yield from copies(f, ids[rows[i : i + step]], x[i : i + step], h[i : i + step], ranked[i : i + step])

    def copies(f: int, ids: np.ndarray, x: np.ndarray, h: np.ndarray, ranked: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The vectors once for every shard they go to: to their own shard, there to every block of guests, and to all
        other shards of the probed cells as guests, to the block of their hash (equal vectors stay together)."""
        m, size = len(x), x.shape[1] * 4
        vec = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        shards, blocks = cells[f].shards, cells[f].blocks
        home = ranked[:, 0]
        mine = np.abs(h[:, 1]) % shards[home]
        at, cell, shard, block, own = [], [], [], [], []

        def put(rows: np.ndarray, c: np.ndarray, s: np.ndarray, b: np.ndarray, o: bool) -> None:
            for out, a in zip((at, cell, shard, block, own), (rows, c, s, b, np.full(len(rows), o))):
                out.append(a)

        for b in range(int(blocks[home].max())):
            r = np.flatnonzero(blocks[home] > b)
            put(r, home[r], mine[r], np.full(len(r), b), True)
        for j in range(ranked.shape[1]):
            c = ranked[:, j]
            for s in range(int(shards[c].max())):
                r = np.flatnonzero((shards[c] > s) & ((j > 0) | (mine != s)))
                put(r, c[r], np.full(len(r), s), np.abs(h[r, 0]) % blocks[c[r]], False)
        again = np.concatenate(at)
        take = pa.array(again)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(again), f, np.int32)), *[pa.array(np.concatenate(a).astype(np.int32)) for a in (cell, shard, block)], pa.array(np.concatenate(own)), pa.array(ids, pa.string()).take(take), pa.array(h[:, 0]).take(take), pa.array(h[:, 1]).take(take), vec.take(take)],
            names=["field", "cell", "shard", "block", "own", "id", "h1", "h2", "vec"],
        )

    def search(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, others, sims = search_shard(pdf, fields[names[int(key_[0])]][0], k, ef, least, exact)
        return pd.DataFrame({"field": np.full(len(ids), int(key_[0]), np.int32), "id": ids, "others": pd.Series(others, dtype=object), "sims": pd.Series(sims, dtype=object)})

    def hashes(f: int, name: str) -> list[Column]:
        return [F.xxhash64(F.col(name)).alias(f"h1_{f}"), F.xxhash64(F.lit(f + 1), F.col(name)).alias(f"h2_{f}")]

    hashed = df.select(key, *names, *[h for f, name in enumerate(names) for h in hashes(f, name)])
    rows = hashed.mapInArrow(spread, "field int, cell int, shard int, block int, own boolean, id string, h1 bigint, h2 bigint, vec binary")
    where = ["field", "cell", "shard", "block"]
    n_tasks = sum(int((c.shards * c.blocks).sum()) for c in cells)
    rows = rows.repartition(max(1, min(2 * n_tasks, 20_000)), *where)
    lists = rows.groupBy(*where).applyInPandas(search, "field int, id string, others array<string>, sims array<double>")
    best = lists.groupBy("field", "id").agg(F.flatten(F.collect_list(F.arrays_zip("others", "sims"))).alias("x"))
    near = best.select("field", "id", F.explode("x").alias("x")).select("field", "id", F.col("x.others").alias("other"), F.col("x.sims").alias("sim"))

    # ids of equal vectors: the smallest k+1 of each class stand for it
    klass = None
    for f, (size, neg) in enumerate(fields.values()):
        col = F.col(names[f])
        fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.lit(not neg) | (x >= 0))) & F.exists(col, lambda x: x != 0)
        one = df.where((F.size(col) == size) & fine).select(F.lit(f).alias("field"), F.xxhash64(col).alias("h1"), F.xxhash64(F.lit(f + 1), col).alias("h2"), F.col(key).alias("id"))
        klass = one if klass is None else klass.unionByName(one)
    klass = klass.distinct()
    w = Window.partitionBy("field", "h1", "h2").orderBy("id")
    top = klass.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    heads = top.groupBy("field", "h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    multi = cut(klass.join(heads, ["field", "h1", "h2"]).select("field", "id", F.col("ids")[0].alias("rep"), "ids"))
    if not multi.isEmpty():
        near = expand(near, multi)
    w = Window.partitionBy("field", "id").orderBy(F.desc("sim"), "other")
    out = near.where("id <> other").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("field") + 1)
    return out.select(label.alias("field_name"), "id", "other", "sim", "rank")


def expand(near: DataFrame, multi: DataFrame) -> DataFrame:
    """Lists of representatives to lists of ids. multi: (field, id, rep, ids) of ids with equal vectors."""
    heads = multi.groupBy("field", "rep").agg(F.first("ids").alias("ids"))
    there = near.join(heads.withColumnRenamed("rep", "other"), ["field", "other"], "left")
    there = there.select("field", "id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "sim")
    members = multi.select("field", F.col("rep").alias("id"), F.col("id").alias("member"))
    copied = there.join(members, ["field", "id"], "left").select("field", F.coalesce("member", "id").alias("id"), "other", "sim")
    same = multi.select("field", "id", F.explode("ids").alias("other"), F.lit(1.0).alias("sim"))
    return copied.unionByName(same)


def found(knowledge: DataFrame, least: float = 0.95) -> DataFrame:
    """Pairs with cosine similarity of at least ``least`` of which one is among the other's five most similar."""
    n = neighbours(knowledge, probes=PROBES, ef=EF, least=least).where(F.col("sim") >= least)
    return n.select("field_name", F.least("id", "other").alias("entry_a"), F.greatest("id", "other").alias("entry_b")).distinct()
