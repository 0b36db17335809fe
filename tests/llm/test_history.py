import random
from datetime import datetime

from quirework.llm import history as H


def near(a, b, r=10):
    return len(a) == len(b) and (int(a, 16) ^ int(b, 16)).bit_count() <= r


def make(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        bits = rnd.choice([64, 256])
        x = rnd.getrandbits(bits)
        out.append(f"{x:0{bits // 4}x}")
        for b in rnd.sample(range(bits), rnd.randint(1, 12)):
            x ^= 1 << b
        out.append(f"{x:0{bits // 4}x}")
    return out


E = "entry_id string, phash string, dhash string, name string"
P = f"pack_id string, received_at timestamp, entries array<struct<{E.replace(' string', ':string')}>>"


def test_pairs_by_brute_force(spark):
    codes = make(150, 1)
    rnd = random.Random(2)
    k = [(f"k{i}", c if i % 7 else f" 0X{c.upper()}\n", rnd.choice([None, codes[0]]), "x") for i, c in enumerate(codes[:150])]
    p = [(f"p{i}", c, rnd.choice([None, codes[0]]), "x") for i, c in enumerate(codes[150:])] + [(f"q{i}", codes[i], None, "x") for i in range(0, 150, 9)]
    packs = [("a", None, p[:80]), ("a", datetime(2025, 3, 1), p[:80]), ("b", datetime(2025, 9, 1), p[80:]), ("c", None, None), ("d", None, [])]
    got = {tuple(r) for r in H.found(spark.createDataFrame(k, E), spark.createDataFrame(packs, P)).collect()}
    clean = lambda c: c.strip().lower().removeprefix("0x")
    rows = [(*r, False) for r in k] + [(*r, True) for r in p]
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] != b[0] and (a[4] or b[4]) and near(clean(a[1]), clean(b[1])) and (a[2] is None or b[2] is None or near(a[2], b[2]))}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 50


def test_nothing_to_match(spark):
    k = spark.createDataFrame([("a", "0000000000000000", None, "x"), ("b", None, None, "x"), ("c", "zz", None, "x")], E)
    p = spark.createDataFrame([("p", None, [("d", "0000000000000000", None, "x"), (None, "12ab34cd56ef7890", None, "x")])], P)
    assert H.found(k, p).collect() == [] and H.found(k.limit(0), p.limit(0)).collect() == []


def test_index_grows_by_batches(spark, tmp_path):
    codes = make(120, 3)
    batches = [codes[i : i + 60] for i in range(0, 240, 60)]
    index = H.HistoryIndex(spark, str(tmp_path), compact_every=3)
    df = lambda b: spark.createDataFrame([(c,) for c in b] + [(None,)], "code string")
    assert index.search(df(batches[0])).collect() == []
    for n, b in enumerate(batches):
        got = {(r.a, r.b) for r in index.search(df(b)).collect()}
        want = {(x, y) for x in b for old in batches[:n] for y in old if near(x, y)}
        assert got <= want and len(got) >= 0.95 * len(want)
        index.add(df(b), f"batch {n}")
        index.add(df(b), f"batch {n}")  # done again: nothing changes
    assert len(index.folders) == 2 and index.shards().agg({"n": "sum"}).first()[0] == len(set(codes))
    again = {(r.a, r.b) for r in H.HistoryIndex(spark, str(tmp_path)).search(df(codes)).collect()}
    assert {(c, c) for c in codes} <= again and {(a, b) for a in codes for b in codes if near(a, b)} == again
    index.vacuum()
    assert sorted(x.name for x in (tmp_path / "shards").iterdir()) == sorted(index.folders)
    assert {(r.a, r.b) for r in index.search(df(codes)).collect()} == again


def test_full_segments_are_not_rebuilt(spark, tmp_path, monkeypatch):
    codes = make(150, 5)
    monkeypatch.setattr(H, "segment_size", lambda bits: 100)
    index = H.HistoryIndex(spark, str(tmp_path), compact_every=3)
    df = lambda b: spark.createDataFrame([(c,) for c in b], "code string")
    index.add(df(codes[:240]))
    before = {tuple(r) for r in index.shards().select("segment", "n").where("n > 50").collect()}
    index.add(df(codes[240:270]))
    index.add(df(codes[270:]))
    after = {tuple(r) for r in index.shards().select("segment", "n").collect()}
    assert before and before <= after and sum(n for _, n in after) == len(set(codes))
    assert {(r.a, r.b) for r in index.search(df(codes)).collect()} == {(a, b) for a in codes for b in codes if near(a, b)}


def test_index_opened_again_gives_entries(spark, tmp_path):
    E2 = "entry_id string, code string, dhash string"
    c = make(6, 4)
    far = f"{int(c[0], 16) ^ (2**40 - 1):0{len(c[0])}x}"
    first = [("a", c[0], c[0]), ("b", c[2], None), ("c", c[4], c[4]), (None, c[6], None)]
    H.HistoryIndex(spark, str(tmp_path), compact_every=2).add(spark.createDataFrame(first, E2), "first")
    # what a step that broke off has left does not count
    (tmp_path / "shards/b1").mkdir(parents=True)
    (tmp_path / "entries/b1").mkdir()
    index = H.HistoryIndex(spark, str(tmp_path), compact_every=2)
    assert index.batches == {"first": 0}
    second = spark.createDataFrame([("n", " 0x" + c[0].upper(), c[0]), ("m", c[0], far), ("o", c[2], far), ("a", c[0], c[0])], E2)
    assert {tuple(r) for r in index.feed(second, "second").collect()} == {("a", "n"), ("b", "o")}
    index = H.HistoryIndex(spark, str(tmp_path), compact_every=2)
    assert index.batches == {"first": 0, "second": 1} and index.entries().count() == 7
    assert {tuple(r) for r in index.feed(second, "second").collect()} == {("a", "n"), ("b", "o")}
    assert index.entries().count() == 7
    assert {tuple(r) for r in index.feed(spark.createDataFrame([("z", c[4], None)], E2)).collect()} == {("c", "z")}


def test_index_folder_of_a_query(spark, sf, tmp_path):
    """The index that p4_found builds stays where a path is given, and the same call again changes nothing."""
    k, p = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("knowledge", "knowledge_packs"))
    want = {tuple(r) for r in H.found(k, p, str(tmp_path), period="yyyy-MM", compact_every=2).collect()}
    state = H.HistoryIndex(spark, str(tmp_path))
    assert len(want) > 5 and {tuple(r) for r in H.found(k, p, str(tmp_path), period="yyyy-MM", compact_every=2).collect()} == want
    assert H.HistoryIndex(spark, str(tmp_path)).version == state.version


def test_words_round_trip():
    for bits in (64, 256, 40):
        codes = [f"{random.Random(i).getrandbits(bits):0{bits // 4}x}" for i in range(5)]
        assert H.to_codes(H.to_words(codes, bits), bits) == codes
