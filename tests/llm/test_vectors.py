import numpy as np

from quirework.llm import graph
from quirework.llm import neighbours as N
from quirework.llm.graph import Hnsw, Nsw

V = {"v": (4, False)}


def clusters(n, d, seed=0, size=8, noise=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(-(-n // size), d))
    x = np.repeat(c, size, 0)[:n] + noise * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_graph_search_recall():
    x = clusters(3000, 32)
    index, q = x[::2], x[1::2][:300]
    g = Hnsw(np.ascontiguousarray(index))
    got, sim = g.search(q, 3, 32)
    want = np.argsort(-(q @ index.T), axis=1)[:, :3]
    assert np.mean([len(set(a) & set(b)) / 3 for a, b in zip(got, want)]) >= 0.9
    assert np.allclose(sim[:, 0], np.take_along_axis(q @ index.T, got[:, :1], 1)[:, 0], atol=1e-5)


def test_own_nodes_are_found_in_the_graph():
    x = clusters(3000, 32)
    got, sim = Hnsw(x).search_own(5, 16)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want)]) >= 0.99 and (got != np.arange(3000)[:, None]).all()
    got, sim = Hnsw(x[:3]).search_own(5, 16)
    assert sorted(got[0].tolist()) == [-1, -1, -1, 1, 2] and (sim[0][got[0] < 0] == -np.inf).all()


def test_cells_are_balanced_and_large_ones_split():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16)) + np.where(np.arange(6000)[:, None] % 3 == 0, 6.0, 0.0)  # a third in one direction
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = N.Cells(x, 6000, 300, 2)
    assert len(c.centres) == 20 and np.bincount(c.rank(x)[:, 0], minlength=20).max() <= 2 * 300
    assert (N.Cells(x[:50], 10 * N.SHARD_ROWS, 10**9, 2).shards == 10).all()


def test_split_shards_and_full_comparison(spark, monkeypatch):
    """Cells of several shards, searched by graph and in full: the latter misses nothing."""
    x = clusters(900, 4, noise=0.3)
    df = spark.createDataFrame([(f"{i:05d}", [float(a) for a in r]) for i, r in enumerate(x)], "entry_id string, v array<double>")
    monkeypatch.setattr(N, "SHARD_ROWS", 100)
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    for exact in (False, True):
        got = {}
        for r in N.neighbours(df, fields=V, cell_rows=300, exact=exact, probes=None).collect():
            got.setdefault(int(r.id), set()).add(int(r.other))
        recall = np.mean([len(got[i] & set(want[i])) / 5 for i in range(len(x))])
        assert recall == 1.0 if exact else recall >= 0.95


def test_graph_of_few_and_of_equal_vectors():
    for x in (np.eye(4, dtype=np.float32)[:1], np.repeat(np.eye(4, dtype=np.float32)[:1], 300, 0)):
        g = Hnsw(x)
        got, _ = g.search(x[:2], 5, 16)
        assert (got[:, 0] >= 0).all()


def test_all_pairs_recall(spark):
    x = clusters(3000, 4, noise=0.02)
    df = spark.createDataFrame([(f"{i:05d}", [float(a) for a in r]) for i, r in enumerate(x)], "entry_id string, v array<double>")
    got = {}
    for r in N.neighbours(df, fields=V, cell_rows=500).collect():
        got.setdefault(int(r.id), {})[int(r.other)] = r.sim
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in range(len(x))]) >= 0.9
    assert all(abs(sim - s[i, j]) < 1e-6 for i, o in got.items() for j, sim in o.items())


def test_recall_of_vectors_with_nothing_alike(spark, monkeypatch):
    """Thirty cells; the guests of a cell come in several blocks."""
    x = np.random.default_rng(3).normal(size=(3000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "entry_id string, v array<double>")
    monkeypatch.setattr(N, "GUEST_ROWS", 1000, raising=False)
    got = {}
    for r in N.neighbours(df, fields={"v": (12, False)}, cell_rows=100).collect():
        got.setdefault(int(r.id), set()).add(int(r.other))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert all(len(o) == 5 for o in got.values())
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(len(x))]) >= 0.9


def test_dirty_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1, 0, 0, 0], 1), ("b", [1, 0, 0, 0], 1), ("c", [0.9, 0.1, 0, 0], 1), ("c", [0.9, 0.1, 0, 0], 1), ("d", None, 1), ("e", [0.0] * 4, 1), (None, [1.0] * 4, 1), ("f", [nan, 1, 1, 1], 1), ("g", [1.0], 1), ("h", [], 1), ("i", [inf, 1, 1, 1], 1), ("j", [None, 1.0, 1, 1], 1), ("k", [1e300, 0, 0, 0], 1)]
    rows = [(e, None if v is None else [None if x is None else float(x) for x in v], n) for e, v, n in rows]
    df = spark.createDataFrame(rows, "entry_id string, v array<double>, sim int")
    got = {(r.id, r.other): (round(r.sim, 4), r["rank"]) for r in N.neighbours(df, fields=V).collect()}
    assert {a for a, _ in got} == {"a", "b", "c", "k"}
    assert got["a", "b"] == (1.0, 1) and got["a", "k"] == (1.0, 2) and got["a", "c"] == (0.9939, 3) and got["k", "a"][0] == 1.0
    assert N.neighbours(df.limit(0), fields=V).collect() == []


def test_hot_class_of_equal_vectors(spark):
    """A third of the rows are one vector: every id still gets its five, the smallest ids of the class."""
    x = clusters(200, 4, noise=0.01)
    rows = [(f"h{i:03d}", [0.5, 0.5, 0.5, 0.5]) for i in range(100)] + [(f"x{i:03d}", [float(a) for a in r]) for i, r in enumerate(x)]
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows, "entry_id string, v array<double>"), fields=V, cell_rows=50).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert len(got) == 300 and all(len(v) == 5 for v in got.values())
    assert [o for _, o in sorted(got["h050"])] == ["h000", "h001", "h002", "h003", "h004"]
    assert [o for _, o in sorted(got["h002"])] == ["h000", "h001", "h003", "h004", "h005"]


def flip(words, bits, n, rng):
    out = words.copy()
    for i in range(len(out)):
        for b in rng.choice(bits, n, replace=False):
            out[i, b // 64] ^= np.uint64(1 << int(b % 64))
    return out


def test_bit_graph_recall():
    rng = np.random.default_rng(5)
    for bits in (64, 256):
        w = rng.integers(0, 2**64, size=(3000, bits // 64), dtype=np.uint64)
        g = Nsw.build(w, bits)
        assert g.tune(10) >= 0.95
        q = flip(w[:500], bits, 10, rng)
        r, node, d = g.within(q, 10)
        hit = {(int(a), int(b)) for a, b in zip(r, node)}
        assert np.mean([(i, i) in hit for i in range(500)]) >= 0.95 and (d <= 10).all()


def test_queries_without_possible_answer_are_not_searched():
    rng = np.random.default_rng(8)
    w = rng.integers(0, 2**64, size=(2000, 4), dtype=np.uint64)
    g = Nsw.build(w, 256)
    q = np.concatenate([flip(w[:300], 256, 10, rng), rng.integers(0, 2**64, size=(300, 4), dtype=np.uint64)])
    ok = g.possible(q, 10)
    assert set(range(300)) <= set(ok.tolist()) and len(ok) < 330


def test_bit_graph_widens_for_crowds():
    """More answers than any beam: none is cut."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, size=(1, 4), dtype=np.uint64)
    w = np.unique(np.concatenate([flip(np.repeat(base, 900, 0), 256, 3, rng), rng.integers(0, 2**64, size=(1500, 4), dtype=np.uint64)]), axis=0)
    g = Nsw.build(np.ascontiguousarray(w[rng.permutation(len(w))]), 256)
    g.tune(10)
    r, _, _ = g.within(base, 10)
    assert len(r) == int((np.bitwise_count(w ^ base).sum(1) <= 10).sum()) >= 890


def test_segment_below_the_goal_is_compared_exhaustively():
    rng = np.random.default_rng(7)
    w = rng.integers(0, 2**64, size=(2000, 1), dtype=np.uint64)
    g = Nsw.build(w, 64)
    g.nbrs[:] = -1  # no beam gets anywhere
    assert g.tune(10) == 1.0
    q = flip(w[:300], 64, 10, rng)
    r, node, d = g.within(q, 10)
    dist = np.bitwise_count(q[:, None, 0] ^ w[None, :, 0])
    assert sorted(zip(r.tolist(), node.tolist())) == sorted(map(tuple, np.argwhere(dist <= 10).tolist()))


def test_distances_are_taken_in_bounded_pieces(monkeypatch):
    """No step of a search holds the vectors of all its candidates at once; what is found is the same."""
    v = clusters(3000, 32)
    g = Hnsw(v)
    whole, most = g.search(v[:600], 5), []
    monkeypatch.setattr(graph, "PIECE_BYTES", 64 * 32 * 4, raising=False)
    monkeypatch.setitem(graph.METRICS, "cosine", lambda x, y: most.append(len(x)) or graph.cosine(x, y))
    pieces = g.search(v[:600], 5)
    assert max(most) == 64 and all(np.array_equal(a, b) for a, b in zip(whole, pieces))
