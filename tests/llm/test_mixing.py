import math
from collections import Counter

from quirework.llm import mixing as M

D, T = "doc_id bigint, source string, text string, size int", "source string, target_weight double, max_repeats int"


def test_shares_and_repeats(spark):
    docs = [(i, " A " if i % 2 else "a", "w " * 20, 1) for i in range(3000)] + [(10_000 + i, "b", "w " * 20, 1) for i in range(300)] + [(20_000 + i, "c", "w " * 20, 1) for i in range(40)] + [(1, None, "x", 1), (2, "a", None, 1), (3, "other", "x", 1)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 3), ("gone", 0.1, 5)], T)
    plan = M.Plan(spark.createDataFrame(docs, D), targets)
    r = {x.source: x for x in plan.report().collect()}
    assert (r["a"].size, r["b"].size, r["c"].size, r["gone"].size) == (60000, 6000, 800, 0)
    assert {s: x.short for s, x in r.items()} == {"a": False, "b": False, "c": True, "gone": True}
    rows = plan.records().collect()
    uses = Counter(x.doc_id for x in rows)
    assert max(uses[i] for i in range(10_000, 10_300)) <= 4 and {uses[i] for i in range(20_000, 20_040)} == {3}
    placed = sum(x.tokens for x in rows)
    assert abs(r["a"].actual_share - r["a"].placed_tokens / placed) < 1e-12 and r["gone"].placed_tokens == 0
    # what is not short comes within its slots' rounding and a document of its weight
    assert abs(r["a"].placed_tokens - 0.5 * 66800) < 6 * plan.block + 20 and abs(r["b"].placed_tokens - 0.3 * 66800) < 6 * plan.block + 20
    # every stretch of the schedule is close to the weights
    slots = sorted((x.slot, x.source) for x in plan.slots.collect())
    assert len(slots) == plan.n_slots <= 4 * M.RESOLUTION
    for at in range(0, len(slots) - 50, 50):
        assert abs(sum(s == "a" for _, s in slots[at : at + 50]) - 25) <= 3
    assert sorted(x.source for x in M.found(spark.createDataFrame(docs, D), targets).collect()) == ["c", "gone"]


def test_points_keep_to_their_share(spark):
    """The rounding that ``exhausted`` allows for is never exceeded."""
    for w in (0.003, 0.07, 0.31, 0.619):
        rows = [{"source": "a", "target_weight": 0.2}, {"source": "b", "target_weight": w}, {"source": "c", "target_weight": 1 - w}]
        for n in (10, 999, 6000):
            got = Counter(r.source for r in M.schedule(rows, n, spark).collect())
            assert all(abs(got[r["source"]] - n * r["target_weight"] / 1.2) < math.log2(n + 1) + 2 for r in rows)


def test_long_documents_do_not_shift_shares(spark):
    docs = [(i, "a", "w " * (3000 if i % 10 == 0 else 5), 1) for i in range(200)] + [(1000 + i, "b", "w " * 7, 1) for i in range(9000)]
    plan = M.Plan(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 5)], T), resolution=64)
    for r in plan.report().collect():
        assert abs(r.placed_tokens - r.planned_slots * plan.block) <= 3000 and abs(r.actual_share - 0.5) < 0.05


def test_every_placed_document_comes_out(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(i, "a", "w " * (i % 50), 1) for i in range(400)] + [(1000 + i, "b", "w " * 30, 1) for i in range(60)] + [(None, "a", "null id", 1)], D)
    plan = M.Plan(docs, spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], T), resolution=20)
    assert plan.buckets == 9
    slots = {p.slot: p for p in plan.filled().collect()}
    rows = plan.records().collect()
    own = {}
    for r in rows:
        own.setdefault(r.slot, []).append(r)
    for slot, p in slots.items():
        mine = sorted(own.get(slot, []), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine))) and (p.n_docs, p.tokens) == (len(mine), sum(r.tokens for r in mine))
        assert {(r.source, r.visit) for r in mine} <= {(p.source, p.visit)}
    assert len({(r.doc_id, r.repeat) for r in rows}) == len(rows) and max(Counter(r.doc_id for r in rows).values()) <= 3
    assert all(r.tokens == (2 if r.doc_id is None else r.doc_id % 50 if r.doc_id < 1000 else 30) for r in rows)
    # the documents of a source come in the same order in every pass
    b = sorted((r.repeat, r.slot, r.position, r.doc_id) for r in rows if r.source == "b")
    first = [x[3] for x in b if x[0] == 0]
    assert all([x[3] for x in b if x[0] == k] == first[: sum(x[0] == k for x in b)] for k in range(3))


def test_empty(spark):
    docs, targets = spark.createDataFrame([], D), spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)], T)
    plan = M.Plan(docs, targets)
    assert plan.records().collect() == [] and plan.filled().collect() == [] and {r.source: r.actual_share for r in plan.report().collect()} == {"a": None, "b": None}
    assert M.found(docs, targets).collect() == [] and M.found(docs, targets.limit(0)).collect() == []
