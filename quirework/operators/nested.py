"""Deeply nested records to related flat tables.

``flatten`` takes rows that hold a JSON text and emits one row for every object that sits in one of the
wanted array fields, at any depth, with a link to its parent. All work is a narrow map over Arrow batches:
no shuffle, no schema inference, and one text never meets another text's rows. Within a batch the tokens of
all texts go through together, one nesting level at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions import json_index as J

CHUNK_BYTES = 4 << 20


@dataclass
class Task:
    """A text to walk: the caller's key, and for a text found inside a string the place where it stands."""

    text: str
    key: object
    field: int = -1
    parent_field: int = -1
    parent: str = ""
    path: str = ""
    element: bool = False


@dataclass
class Rows:
    """Columns of the objects found: number of the text, field, parent's field, paths, and the wanted values."""

    keys: list = field(default_factory=list)
    fields: list[int] = field(default_factory=list)
    parent_fields: list[int] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    values: list[list[str | None]] = field(default_factory=list)


def _walk(tasks: list[Task], fields: Sequence[str], values: Sequence[str], out: Rows) -> list[Task]:
    """Rows of the texts, added to ``out``; the texts found inside strings, which need another round."""
    ix = J.build([t.text for t in tasks])
    n = ix.kind.size
    again: list[Task] = []
    if not n:
        return again
    of_field = ix.key_codes(fields)
    in_object = (ix.container >= 0) & (ix.kind[np.maximum(ix.container, 0)] == J.OPEN_OBJ)
    wanted = (ix.kind == J.OPEN_OBJ) | (ix.kind == J.OPEN_ARR) | (ix.kind == J.STRING)
    tokens = np.flatnonzero(wanted & ~ix.is_key & ix.valid[ix.doc])
    tokens = tokens[np.argsort(ix.depth[tokens], kind="stable")]
    ends = np.searchsorted(ix.depth[tokens], np.arange(int(ix.depth[tokens[-1]]) + 2)) if tokens.size else [0]

    # paths by number: those of the tasks' places and parents first
    m = len(tasks)
    paths = [t.path for t in tasks] + [t.parent for t in tasks]
    start = {a: np.array([getattr(t, a) for t in tasks], np.int64) for a in ("field", "parent_field", "element")}
    # per bracket: the field it belongs to, the nearest node's field and path, the path so far
    own, up_field, up, at = (np.full(n, -1, np.int64) for _ in range(4))
    node_row = np.full(n, -1, np.int64)
    first_row = len(out.keys)

    def longer(before: np.ndarray, position: np.ndarray) -> np.ndarray:
        """New paths, each a known one and a position."""
        numbers = np.arange(len(paths), len(paths) + before.size)
        paths.extend([f"{paths[b]}/{p}" if paths[b] else str(p) for b, p in zip(before.tolist(), position.tolist())])
        return numbers

    for lo, hi in zip(ends[:-1], ends[1:]):
        tok = tokens[lo:hi]
        if not tok.size:
            continue
        kind, doc, holder = ix.kind[tok], ix.doc[tok], ix.container[tok]
        root, c = holder < 0, np.maximum(holder, 0)
        f = np.where(root, start["field"][doc], np.where(in_object[tok], of_field[tok], own[c]))
        pf = np.where(root, start["parent_field"][doc], up_field[c])
        parent = np.where(root, doc + m, up[c])
        path = np.where(root, doc, at[c])
        element = np.where(root, start["element"][doc] != 0, ~in_object[tok])
        inner = np.flatnonzero(~root & element & (f >= 0))
        path[inner] = longer(path[inner], ix.position[tok[inner]])
        lone = np.flatnonzero((kind == J.OPEN_OBJ) & (f >= 0) & ~element)
        path[lone] = longer(path[lone], np.zeros(lone.size, np.int64))
        is_obj = kind == J.OPEN_OBJ
        node = is_obj & (f >= 0)
        r = np.flatnonzero(node)
        node_row[tok[r]] = np.arange(len(out.keys), len(out.keys) + r.size)
        out.keys.extend([tasks[d].key for d in doc[r].tolist()])
        out.fields.extend(f[r].tolist())
        out.parent_fields.extend(pf[r].tolist())
        out.parents.extend([paths[p] for p in parent[r].tolist()])
        out.paths.extend([paths[p] for p in path[r].tolist()])
        own[tok] = np.where(is_obj, -1, f)
        up_field[tok] = np.where(node, f, pf)
        up[tok] = np.where(node, path, parent)
        at[tok] = np.where(node, path, np.where(is_obj, parent, path))
        for i in np.flatnonzero((kind == J.STRING) & (f >= 0)).tolist():
            t = tasks[doc[i]]
            said = json.loads(ix.text(tok[i]))
            if said.lstrip(J.AROUND)[:1] in ("{", "[", '"'):
                again.append(Task(said, t.key, int(f[i]), int(pf[i]), paths[parent[i]], paths[path[i]], bool(element[i])))
    if values:
        for column in out.values:
            column.extend([None] * (len(out.keys) - first_row))
        codes = ix.key_codes(values)
        for i in np.flatnonzero((codes >= 0) & (node_row[np.maximum(ix.container, 0)] >= 0) & ix.valid[ix.doc]).tolist():
            out.values[codes[i]][node_row[ix.container[i]]] = ix.value(i)
    return again


def walk(texts: Sequence[str | None], keys: Sequence, fields: Sequence[str], values: Sequence[str] = ()) -> Rows:
    """The objects of the texts that sit in the fields; strings that hold JSON count as what they say."""
    todo = [Task(t, k) for t, k in zip(texts, keys) if t]
    rows = Rows(values=[[] for _ in values])
    while todo:
        part, size = [], 0
        while todo and (not part or size + len(todo[-1].text) <= CHUNK_BYTES):
            part.append(todo.pop())
            size += len(part[-1].text)
        todo += _walk(part, fields, values, rows)
    return rows


def flatten(df: DataFrame, key: str, text: str, fields: Sequence[str], values: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """One row for every object in a field named in ``fields``, at any depth of the JSON column ``text``.

    Columns: the key, field_name, parent_field, parent_path, node_path, and ``v_<name>`` for every name in ``values``:
    that field of the object as text, null where it is missing or null; with ``order``, that value of the input row
    as ``_order``. node_path joins the positions from the outermost array inwards by ``/``, counted from 0 over all
    elements; parent_path is the nearest enclosing row's node_path or '', parent_field the field that row sits in or ''.
    A lone object counts as an array of one and a string as the JSON it holds. Null, empty or invalid texts give no
    rows; repeated input rows and an object under a repeated field name give repeated rows, which the caller removes.
    Of a repeated field in ``values`` the last counts. Other columns are ignored.
    """
    kind = df.schema[key].dataType
    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([order.alias("_order")] if order is not None else [])).where(F.col("_text").isNotNull())
    names = [key, "field_name", "parent_field", "parent_path", "node_path", *[f"v_{v}" for v in values]]
    schema = T.StructType([T.StructField(names[0], kind)] + [T.StructField(x, T.StringType()) for x in names[1:]] + ([T.StructField("_order", src.schema["_order"].dataType)] if order is not None else []))
    labels = pa.array([*fields, ""])
    ordered = order is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = walk(part.column(1).to_pylist(), range(part.num_rows), fields, values)
                if not rows.keys:
                    continue
                take = pa.array(rows.keys, pa.int64())
                # -1 names the last label
                label = lambda x: labels.take(pa.array(np.where(np.array(x, np.int64) < 0, len(fields), x)))
                columns = [part.column(0).take(take), label(rows.fields), label(rows.parent_fields), pa.array(rows.parents, pa.string()), pa.array(rows.paths, pa.string())]
                columns += [pa.array(v, pa.string()) for v in rows.values]
                if ordered:
                    columns.append(part.column(2).take(take))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return src.mapInArrow(run, schema)


REGION_FIELDS = ("regions", "children", "words", "chars")


def found(raw_results: DataFrame) -> DataFrame:
    """All nested objects of the payloads with their links, each once (a record may be delivered twice)."""
    return flatten(raw_results, "record_id", "payload", REGION_FIELDS).select("record_id", "field_name", "parent_path", "node_path").distinct()


VALUES = ("region_id", "type", "region_type", "text", "char", "raw_text", "corrected_text", "is_corrected", "confidence", "region_confidence", "page_number", "bbox", "image_path")


def flat_tables(raw_results: DataFrame) -> DataFrame:
    """The typed rows of all levels, told apart by field_name: one walk over the payloads serves the four tables.

    Of a record delivered more than once the latest delivery gives the row, of equally late ones that with the greater MD5."""
    rows = flatten(raw_results, "record_id", "payload", REGION_FIELDS, VALUES, F.struct("received_at", F.md5("payload").alias("h")))
    v = lambda *names: F.coalesce(*[F.col(f"v_{x}") for x in names])
    number = lambda kind, *names: F.expr(f"try_cast(coalesce({', '.join('v_' + x for x in names)}) as {kind})")
    rows = rows.select(
        "record_id", "field_name", "parent_field", "parent_path", "node_path", v("region_id").alias("region_id"), F.lower(F.trim(v("type", "region_type"))).alias("type"),
        v("text", "char", "raw_text").alias("text"), v("corrected_text").alias("corrected_text"), number("boolean", "is_corrected").alias("is_corrected"),
        number("double", "confidence", "region_confidence").alias("confidence"), number("int", "page_number").alias("page_number"), F.regexp_replace(v("bbox"), r"\s", "").alias("bbox_text"), v("image_path").alias("image_path"), "_order",
    )
    w = Window.partitionBy("record_id", "field_name", "parent_field", "node_path").orderBy(F.desc("_order"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_order")


def flat_table(raw_results: DataFrame, level: str) -> DataFrame:
    """Typed flat table of one level: regions, children, words or chars. parent_field and parent_path name the parent's row."""
    return flat_tables(raw_results).where(F.col("field_name") == level).drop("field_name")
