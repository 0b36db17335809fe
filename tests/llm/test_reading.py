import json

import numpy as np

from quirework.llm import reading as R

EASY, HARD = "We see the sun. You get the map.", " ".join(["The multidimensional characterisation asymptotically underestimates"] * 5) + "."


def percent(*cells):
    return "\n".join(f"# %% [{kind}]{' In[1]' if kind == 'code' else ''}\n{text}" for kind, text in cells)


def test_prose_only():
    body = "# Heading words\n\nOne **two** _three_.\nFour five\n\n- Six?\n- Seven!\n\n| a | b |\n\n$$ x_{i} = \\alpha $$\n\n```\nfor word in code\n```\n\n[link text](notes/a.md) ![i](data:abc)"
    want = [["One", "two", "three"], ["Four", "five"], ["Six"], ["Seven"]]
    assert R.sentences(percent(("markdown", body), ("code", "not this"), ("output", "nor this."))) == want
    for source in (body, body.splitlines(True)):
        assert R.sentences(json.dumps({"cells": [{"cell_type": "code", "source": "no"}, {"cell_type": "markdown", "source": source}, None]})) == want
    whole = json.dumps({"cells": [{"cell_type": "markdown", "source": body}, {"cell_type": "code", "source": "x"}]})
    assert R.sentences(whole[:-20]) == want
    assert R.sentences(None) == R.sentences("") == R.sentences("no cells at all.") == R.sentences("{") == []
    assert R.sentences(percent(("markdown", "Version 3.5 is out."))) == [["Version", "is", "out"]]


def test_bands():
    assert R.band(1, 18, 108) == "advanced" and R.band(1, 17, 170) is None and R.band(1, 18, 107) is None
    assert R.band(1, 9, 45) == "basic" and R.band(1, 10, 30) is None and R.band(1, 9, 46) is None and R.band(0, 0, 0) is None


def test_levels(spark):
    docs = [(i, percent(("markdown", EASY if i % 2 else HARD)), 1) for i in range(40)] + [(100, None, 1), (101, "", 1), (102, percent(("code", "x")), 1), (103, percent(("markdown", EASY * 3000)), 1), (None, percent(("markdown", EASY)), 1)]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, level int")
    labels = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "a", 5), (3, "a", None), (4, "a", 9), (None, "a", 3)], "doc_id bigint, grader string, grade int")
    got = {r.doc_id: (r.level, r.band) for r in R.levels(df, labels).collect()}
    assert got[1] == (1, "basic") and got[2] == (5, "advanced") and got[100] == got[101] == got[102] == (None, None) and got[103] == (1, "basic")
    found = R.found(df, labels).collect()
    assert len(found) == len({tuple(r) for r in found}) == 42
    # without labels the seeds do, without documents nothing comes
    assert R.found(df, labels.limit(0)).count() == 42 and R.found(df.limit(0), labels).collect() == []


def test_texts_that_are_no_notebooks():
    assert R.sentences("One two. Three", cells=False) == [["One", "two"], ["Three"]] and R.sentences("One two.") == []


def test_a_side_without_training_texts(spark):
    """Only easy texts are known: the averages alone tell the demanding ones."""
    docs = spark.createDataFrame([(i, percent(("markdown", EASY if i else HARD))) for i in range(30)], "doc_id bigint, text string")
    few = R.train(docs.where("doc_id > 0"), spark.createDataFrame([(1, "a", 1)], "doc_id bigint, grader string, grade int"))
    R_train, R.train = R.train, lambda *a, **k: few
    try:
        got = {tuple(r) for r in R.found(docs, None).collect()}
    finally:
        R.train = R_train
    assert (0, "advanced") in got and len(got) == 30


def test_accuracy_on_held_out_labels(spark):
    """Labels of one half of the documents train, the agreed extremes of the other half are told apart."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/level_labels.parquet").where("grade in (1, 5)")
    got = R.levels(d.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", "grade").distinct(), "doc_id").where("level is not null").collect()
    assert len(got) >= 5 and sum(abs(r.level - r.grade) <= 1 for r in got) >= 0.8 * len(got)


def test_every_document_trains(spark):
    """More documents and labels than any bounded sample held; words beyond the vocabulary count together."""
    n = 20_100
    df = spark.range(n).selectExpr("id doc_id", f"'{percent(('markdown', EASY))}' text")
    words, logp, prior = R.train(df, df.selectExpr("doc_id", "'a' grader", "3 grade"), vocabulary=2)
    assert abs(prior - np.log(np.array([n + 1, 1, n + 1, 1, 1]) / (2 * n + 5))).max() < 1e-9
    assert list(words) == ["the", "get"] and abs(logp[:, 0] - np.log((n * np.array([2, 1, 5]) + 0.5) / (8 * n + 1.5))).max() < 1e-9


def test_compared_documents_do_not_train(spark, monkeypatch):
    docs = spark.createDataFrame([(i, percent(("markdown", EASY))) for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "a", 1) for i in range(6)], "doc_id bigint, grader string, grade int")
    seen, train = [], R.train
    monkeypatch.setattr(R, "train", lambda d, *a, **k: seen.append({r.doc_id for r in d.collect()}) or train(d, *a, **k))
    assert [tuple(r) for r in R.accuracy(docs, labels).collect()] == [(1, 3, 3, 3)] and seen == [{0, 2, 4, 6, 7}]


def test_counts_sent_on_early_add_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, percent(("markdown", EASY if i % 2 else HARD))) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "a", 3) for i in range(9)], "doc_id bigint, grader string, grade int")
    whole = R.train(docs, labels)
    monkeypatch.setattr(R, "HELD_COUNTS", 1)
    parts = R.train(docs, labels)
    assert whole[0] == parts[0] and np.array_equal(whole[1], parts[1]) and np.array_equal(whole[2], parts[2])
