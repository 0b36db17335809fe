import pytest

from quirework.llm import ocr_repair as O

L = {w: 10 for w in "the a of from been report journal instrument water-tight part-payment by-law has good read road window which under merchant first committee in at to".split()}
COLS = "doc_id string, region_id string, region_type string, page_number int, raw_text string, ocr_at timestamp, defect string"


def run(spark, rows):
    lexicon = spark.createDataFrame([*L.items(), (None, 1), ("Good", 3)], "word string, freq int")
    return sorted((r.doc_id, r.region_id, r.token_idx, r.defect, r.repaired) for r in O.found(spark.createDataFrame(rows, COLS), lexicon).collect())


def para(text, region="p1", kind="Paragraph ", page=3):
    return ("d", region, kind, page, text, None, "x")


EDGE = [para("Journal of the Velmora Society", f"h{i}", "header", i) for i in range(3)] + [para("- 9 -", "f1", "footer", 3)]


def test_kinds(spark):
    text = "The instr-\nJOURNAL OF THE VELM0RA SOCIETY 9\n- 9 -\nument, by-\nlaw fr0m wat-\ner-tight tbe Velmora Rep0rt 1450 A10/4.\nPart-\npayment 9ood.\n- 10 -\n9"
    got = [x[2:] for x in run(spark, [*EDGE, para(text), para(text), para(text, "c", "cell")])]
    assert got == [(1, "hyphen", "instrument"), (2, "header", ""), (8, "page_number", ""), (14, "misread", "from"), (15, "hyphen", "water-tight"), (17, "misread", "the"), (19, "misread", "report"), (24, "misread", "good"), (28, "page_number", "")]


def test_header_of_a_volume_that_shows_none(spark):
    other = [(f"v{i}", "h", "header", 1, f"Ledger of the {n} Board", None, "x") for i, n in enumerate(("Haldrip Seed", "Morvask Rain", "Cavestry Lake"))]
    got = run(spark, [*other, ("z", "p", "paragraph", 1, "a report\nLedger of the Tibraith Storage Board 12\nhas been\nxiv", None, "x")])
    assert got == [("z", "p", 2, "header", ""), ("z", "p", 11, "page_number", "")]


def test_dirty_rows(spark):
    rows = [para(None), para(""), para("\n \n", "p2"), para("rep0rt", "p3", None), ("d", None, "paragraph", 1, "rep0rt", None, "x"), para("- -\n-", "p4"), para("rep0rt " * 20000, "p5", page=None)]
    got = run(spark, rows)
    assert {x[1] for x in got} == {"p5"} and len(got) == 20000
    assert run(spark, []) == []


def test_distance_and_candidates():
    ix = O.DeleteIndex(L)
    for read, word in (("frorn", "from"), ("journál", "journal"), ("ﬁrst", "first"), ("vvindow", "window"), ("uncler", "under"), ("rnerchant", "merchant"), ("cornmittee", "committee"), ("0f", "of"), ("wa+er-tight", "water-tight")):
        assert ix.candidates(read)[0][0] == word, read
    for read in ("velmora", "no", "zz", "xylophone", "q" * 60):
        assert ix.candidates(read) == []
    assert [w for w, _, _ in ix.candidates("r0ad")] == ["road"]
    assert O.weighted_distance("the", "the") == 0 and O.weighted_distance("abc", "xyz") == float("inf")


def test_context_decides(spark):
    rows = [para("a road to the window. a road to " * 5, "c"), para("a r?ad".replace("?", "o") + "\nin raad to", "p")]
    got = [x for x in run(spark, rows) if x[1] == "p"]
    assert got and got[0][4] in ("road", "read")


def test_page_values():
    assert [O.page_value(x) for x in ("- 12 -", "[7]", "Page 31", "p. 5", "xiv", "— 44 —", "12 men", "iiii", "99.")] == [12, 7, 31, 5, 14, 44, None, None, 99]


def test_paragraphs(spark):
    lexicon = spark.createDataFrame(list(L.items()), "word string, freq int")
    rows = [*EDGE, para("The instr-\n- 9 -\nument, fr0m\nRep0rt has."), para("good", "p2"), para("a", "c", "cell")]
    got = {r.region_id: (r.text, r.n_repairs) for r in O.paragraphs(spark.createDataFrame(rows, COLS), lexicon).collect()}
    assert got == {"p1": ("The instrument, from Report has.", 4), "p2": ("good", 0)}


def test_large_lexicon_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_LEXICON", 1)
    with pytest.raises(ValueError):
        O.load_lexicon(spark.createDataFrame([("a", 1), ("b", 1)], "word string, freq int"))
