import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from quirework.functions import json_index as J
from quirework.operators import nested
from quirework.session import table
from tests.oracle import connect

F = nested.REGION_FIELDS


def brute(text):
    """The same rows by the parser of the standard library and plain recursion."""
    out = []

    def value(field, v, parent, path, element):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
            return value(field, v, parent, path, element) if isinstance(v, (dict, list, str)) else None
        if isinstance(v, list):
            for i, x in enumerate(v):
                value(field, x, parent, f"{path}/{i}" if path else str(i), True)
        elif isinstance(v, dict):
            own = path if element else (f"{path}/0" if path else "0")
            out.append((field, parent, own))
            walk(v, own)

    def walk(o, node):
        if isinstance(o, dict):
            for k, v in o.items():
                value(k, v, node, node, False) if k in F else walk(v, node)
        elif isinstance(o, list):
            for x in o:
                walk(x, node)

    try:
        walk(json.loads(text.strip().strip("﻿").strip()), "")
    except ValueError:
        pass
    return sorted(out)


def rows(*texts):
    out = [[] for _ in texts]
    r = nested.walk(texts, range(len(texts)), F)
    for key, field, parent, path in zip(r.keys, r.fields, r.parents, r.paths):
        out[key].append((F[field], parent, path))
    return [sorted(x) for x in out]


leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6) | st.sampled_from(['{"chars": [null, {}]}', '[{"words": {}}]', '"[{}]"', "{", "[1"])
tree = st.recursive(leaf, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from([*F, "a", "b\"\\", "é"]), c, max_size=4), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(tree, min_size=1, max_size=4), st.booleans())
def test_rows_as_by_recursion(trees, ascii_only):
    texts = [json.dumps(x, ensure_ascii=ascii_only) for x in trees]
    assert rows(*texts) == [brute(x) for x in texts]


@settings(max_examples=400, deadline=None)
@given(tree, st.integers(0, 10_000), st.sampled_from(list('{}[]:,"\\ 01a-\n\t') + [""]))
def test_validity_as_by_the_parser(x, at, put):
    text = json.dumps(x)
    at %= len(text) + 1
    text = text[:at] + put + text[at + (put == "") :]
    try:
        json.loads(text.strip())
        good = True
    except ValueError:
        good = False
    # neighbours that are broken in other ways do not matter
    assert bool(J.build(['{"a":"', text, "[1", '"\\']).valid[1]) == good


def test_forms():
    got = rows('﻿ {"regions": {"words": "[null, {\\"chars\\": {}}]"}} \n', '{"regions": [{', "", '{"regions": null}', '[{"x": {"regions": [[{}], {}]}}]')
    assert got[0] == [("chars", "0/1", "0/1/0"), ("regions", "", "0"), ("words", "0", "0/1")]
    assert got[1:4] == [[], [], []]
    assert got[4] == [("regions", "", "0/0"), ("regions", "", "1")]


def test_deep_and_long():
    deep = '{"children":[' * 3000 + "]}" * 3000
    got = rows(deep)[0]
    assert len(got) == 2999 and max(got, key=lambda r: len(r[2]))[2] == "/".join(["0"] * 2999)
    long = json.dumps({"regions": [{"raw_text": "x" * 5_000_000}]})
    assert rows(long)[0] == [("regions", "", "0")]


def test_table(spark, sf):
    want = sorted({(r, *x) for r, p in connect(sf).execute("select record_id, payload from raw_results").fetchall() if p for x in brute(p)})
    assert sorted(map(tuple, nested.found(table(spark, sf, "raw_results")).collect())) == want


def test_empty_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([Row(record_id=1, payload=None, field_name="x", node_path="y"), Row(record_id=None, payload='{"words": {}}', field_name="x", node_path="y")], "record_id bigint, payload string, field_name string, node_path string")
    assert [tuple(r) for r in nested.found(df.unionAll(df)).collect()] == [(None, "words", "", "0")]
    assert nested.found(df.limit(0)).collect() == []


def test_values_and_parents(spark):
    text = '{"regions": [{"region_id": "a", "text": null, "wor\\u0064s": [{"text": "x\\n\\"y", "confidence": "0.5", "bbox": [1, 2]}], "children": {"chars": [{"char": "\\ud83d\\ude00"}], "type": " Cell ", "is_corrected": true}}]}'
    rows = [(1, text, 2), (1, text.replace("Cell", "Table"), 1), (2, "{", 1), (3, None, None)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, received_at int")
    got = {(r.field_name, r.parent_field, r.parent_path, r.node_path): r for r in nested.flat_tables(df).collect()}
    assert set(got) == {("regions", "", "", "0"), ("words", "regions", "0", "0/0"), ("children", "regions", "0", "0/0"), ("chars", "children", "0/0", "0/0/0")}
    r, w, c, h = (next(v for k, v in got.items() if k[0] == f) for f in ("regions", "words", "children", "chars"))
    assert (r.region_id, r.text) == ("a", None) and (w.text, w.confidence, w.bbox_text) == ('x\n"y', 0.5, "[1,2]")
    assert (c.type, c.is_corrected) == ("cell", True) and h.text == "\U0001f600"
    assert [r.parent_field for r in nested.flat_table(df, "chars").collect()] == ["children"]
    assert nested.flat_table(df.limit(0), "words").collect() == []
