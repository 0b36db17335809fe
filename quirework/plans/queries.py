"""Registry of the core queries: name -> (callable, SQL or None).

Stand-ins: the texts of ``documents`` folded to rasters serve as pages, the words' boxes as regions, the 64 numbers
of ``embeddings`` as 8x8 patches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import bbox as B
from quirework.operators import assess, hashing, knowledge, layout, nested, ocr
from quirework.session import table as t
from quirework.sources import images
from quirework.streaming import feedback

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAGE_W, PAGE_H = 2480, 3508


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_NESTED = """p0 as (select distinct record_id, row_number() over (partition by record_id order by received_at desc nulls last, md5(payload) desc) rn, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) p from raw_results where payload is not null),
    p1 as (select record_id, rn, case when json_valid(p) then p::json end v from p0),
    walk as (
      select record_id, rn, cast('' as varchar) f, cast('' as varchar) pf, cast('' as varchar) parent, cast('' as varchar) path, false element, false node, v from p1 where v is not null
      union all
      select record_id, rn, f, pf, parent, path, element, node, v from (
        -- the members of an object; an object in a wanted field is a node
        select record_id, rn, case when k in ({fields}) then k else '' end f, case when node then f else pf end pf, path parent, path, false element, false node, json_extract(v, '$."' || replace(k, '"', '\\"') || '"') v
        from (select *, unnest(json_keys(v)) k from walk where json_type(v) = 'OBJECT' and (node or f = ''))
        union all
        select record_id, rn, f, pf, parent, case when element then path when path = '' then '0' else path || '/0' end, true, true, v from walk where json_type(v) = 'OBJECT' and f <> '' and not node
        union all
        select record_id, rn, f, pf, parent, case when f = '' then path when path = '' then i::varchar else path || '/' || i end, true, false, json_extract(v, '$[' || i || ']')
        from (select *, unnest(range(0, json_array_length(v)::bigint)) i from walk where json_type(v) = 'ARRAY')
        union all
        select record_id, rn, f, pf, parent, path, element, false, case when json_valid(v ->> '$') then (v ->> '$')::json end from walk where json_type(v) = 'VARCHAR' and f <> '')
      where v is not null),
    nodes as (select record_id, rn, f, pf, parent, path, v from walk where node)"""


def _nested(fields: Sequence[str], select: str) -> str:
    """SQL over the table nodes: every object in one of the fields, with its links and its JSON value."""
    return f"with recursive {_NESTED.replace('{fields}', ', '.join(repr(x) for x in fields))} {select}"


register("p3_found", lambda s, d: nested.found(t(s, d, "raw_results")), _nested(nested.REGION_FIELDS, "select distinct record_id, f as field_name, parent as parent_path, path as node_path from nodes"))
_LEVEL = """, one as (select *, row_number() over (partition by record_id, f, pf, path order by rn) n from nodes)
    select record_id, pf as parent_field, parent as parent_path, path as node_path, v ->> '$.region_id' region_id, lower(trim(coalesce(v ->> '$.type', v ->> '$.region_type'))) "type",
    coalesce(v ->> '$.text', v ->> '$.char', v ->> '$.raw_text') "text", v ->> '$.corrected_text' corrected_text, try_cast(v ->> '$.is_corrected' as boolean) is_corrected,
    try_cast(coalesce(v ->> '$.confidence', v ->> '$.region_confidence') as double) confidence, try_cast(v ->> '$.page_number' as int) page_number,
    regexp_replace(v ->> '$.bbox', '\\s', '', 'g') bbox_text, v ->> '$.image_path' image_path from one where n = 1 and f = """
for _field in nested.REGION_FIELDS:
    register(f"p3_{_field}", lambda s, d, f=_field: nested.flat_table(t(s, d, "raw_results"), f), _nested(nested.REGION_FIELDS, "select 1")[: -len(" select 1")] + f"{_LEVEL}'{_field}'")

# ---- pages: scores of text rasters

_PX = """
    chars as (select doc_id, regexp_extract_all(text, '(?s).') c from documents where text <> ''),
    px0 as (select doc_id, cast(ceil(len(c) / 80.0) as int) h, unnest(range(0, cast(ceil(len(c) / 80.0) as bigint) * 80)) i, c from chars),
    px as (select doc_id, h, cast(i // 80 as int) y, cast(i % 80 as int) x, cast(case when i < len(c) then least(unicode(c[i + 1]), 255) else 32 end as bigint) v from px0)"""
_LAP = """
    lap as (select doc_id, coalesce(lag(v) over r, lead(v) over r) + coalesce(lead(v) over r, lag(v) over r)
      + coalesce(lag(v) over k, lead(v) over k, v) + coalesce(lead(v) over k, lag(v) over k, v) - 4 * v l, v
      from px window r as (partition by doc_id, y order by x), k as (partition by doc_id, x order by y))"""
_NOISE = """
    g1 as (select doc_id, h, y, x, v, 6 * v + 4 * (coalesce(lag(v) over r, lead(v) over r) + coalesce(lead(v) over r, lag(v) over r))
      + (case x when 0 then lead(v, 2) over r when 1 then v else lag(v, 2) over r end) + (case x when 79 then lag(v, 2) over r when 78 then v else lead(v, 2) over r end) a
      from px window r as (partition by doc_id, y order by x)),
    g2 as (select doc_id, v, (6 * a + 4 * (case when h = 1 then 2 * a else coalesce(lag(a) over k, lead(a) over k) + coalesce(lead(a) over k, lag(a) over k) end)
      + (case when h <= 2 then a when y = 0 then lead(a, 2) over k when y = 1 then a else lag(a, 2) over k end)
      + (case when h <= 2 then a when y = h - 1 then lag(a, 2) over k when y = h - 2 then a else lead(a, 2) over k end) + 128) >> 8 g
      from g1 window k as (partition by doc_id, x order by y))"""
_SCORES = f"""{_PX}, {_LAP}, {_NOISE},
    lm as (select doc_id, count(*) n, cast(sum(l) as bigint) l1, cast(sum(l * l) as bigint) l2, cast(sum(v) as bigint) s1, cast(sum(v * v) as bigint) s2 from lap group by 1),
    nm as (select doc_id, cast(sum(abs(v - g)) as bigint) ns from g2 group by 1),
    sc as (select doc_id, (n * l2 - l1 * l1)::double / (n * n)::double blur, sqrt((n * s2 - s1 * s1)::double / (n * n)::double) contrast, ns::double / (n * 255)::double noise from lm join nm using (doc_id)),
    fl as (select doc_id, blur < 100 is_blurry, noise > 0.02 is_noisy, contrast < 50 is_low_contrast, false needs_deskew from sc),
    pq as (select *, is_blurry or is_noisy or is_low_contrast enhancement_needed, is_blurry::int + is_noisy::int + is_low_contrast::int issues from fl)"""


def _pages(s: SparkSession, d: str) -> DataFrame:
    return assess.flags(assess.scores(assess.text_moments(t(s, d, "documents"))))


register(
    "blur_moments", lambda s, d: assess.text_moments(t(s, d, "documents")).select("doc_id", "n", "lap_sum", "lap_sq"),
    f"with {_PX}, {_LAP} select doc_id, count(*) n, cast(sum(l) as bigint) lap_sum, cast(sum(l * l) as bigint) lap_sq from lap group by 1",
)
register(
    "contrast_moments", lambda s, d: assess.text_moments(t(s, d, "documents")).select("doc_id", "n", F.col("sum").alias("v_sum"), F.col("sq").alias("v_sq"), "dark"),
    f"with {_PX} select doc_id, count(*) n, cast(sum(v) as bigint) v_sum, cast(sum(v * v) as bigint) v_sq, count(*) filter (v <= 180) dark from px group by 1",
)
register(
    "noise_abs_sum", lambda s, d: assess.text_moments(t(s, d, "documents")).select("doc_id", "noise_sum"),
    f"with {_PX}, {_NOISE} select doc_id, cast(sum(abs(v - g)) as bigint) noise_sum from g2 group by 1",
)
register("intensity_histogram", lambda s, d: assess.text_histogram(t(s, d, "documents")), f"with {_PX} select doc_id, cast(v as int) v, count(*) n from px group by 1, 2")
register(
    "otsu_threshold", lambda s, d: assess.text_moments(t(s, d, "documents")).select("doc_id", "otsu"),
    f"""with {_PX}, h as (select doc_id, v, count(*) n from px group by 1, 2),
    c as (select doc_id, v, sum(n) over w w0, sum(n * v) over w s0, sum(n) over (partition by doc_id) t, sum(n * v) over (partition by doc_id) s from h window w as (partition by doc_id order by v)),
    sc as (select doc_id, v, case when t > w0 then (s0 * t - s * w0)::double * (s0 * t - s * w0)::double / (w0 * (t - w0))::double else 0 end q from c),
    b as (select doc_id, v, q, row_number() over (partition by doc_id order by q desc, v) r from sc)
    select doc_id, cast(case when q > 0 then v else 0 end as int) otsu from b where r = 1""",
)
register(
    "page_quality", lambda s, d: _pages(s, d).select("doc_id", "is_blurry", "is_noisy", "is_low_contrast", "needs_deskew", "enhancement_needed", "quality"),
    f"with {_SCORES} select doc_id, is_blurry, is_noisy, is_low_contrast, needs_deskew, enhancement_needed, case when issues = 0 then 'good' when issues <= 2 then 'acceptable' else 'poor' end quality from pq",
)
register(
    "enhancement_plan", lambda s, d: assess.enhancement_plan(_pages(s, d)).select("doc_id", F.array_join("ops", ",").alias("ops")),
    f"with {_SCORES} select doc_id, concat_ws(',', case when is_noisy then 'denoise' end, case when is_low_contrast then 'contrast' end, case when is_blurry then 'sharpen' end) ops from pq",
)
register(
    "document_flags",
    lambda s, d: assess.document_flags(_pages(s, d).join(t(s, d, "documents").select("doc_id", "repo"), "doc_id"), "repo").withColumn("recommended", F.array_join("recommended", ",")),
    f"""with {_SCORES}, g as (select repo, count(*) page_count, bool_or(is_blurry) b, bool_or(is_noisy) n, bool_or(is_low_contrast) l, bool_or(enhancement_needed) e from pq join documents using (doc_id) group by 1)
    select repo, page_count, b any_is_blurry, n any_is_noisy, l any_is_low_contrast, false any_needs_deskew, e any_enhancement_needed,
    concat_ws(',', case when b then 'sharpen' end, case when n then 'denoise' end, case when l then 'contrast_enhancement' end) recommended from g""",
)
register(
    "assessment_summary", lambda s, d: assess.summary(_pages(s, d)),
    f"with {_SCORES} select count(*) pages, count(*) filter (is_blurry) is_blurry, count(*) filter (is_noisy) is_noisy, count(*) filter (is_low_contrast) is_low_contrast, count(*) filter (needs_deskew) needs_deskew from pq",
)
register(
    "has_content", lambda s, d: assess.text_moments(t(s, d, "documents")).select("doc_id", (F.col("dark") * 500 > F.col("n")).alias("has_content")),
    f"with {_PX} select doc_id, count(*) filter (v <= 180) * 500 > count(*) has_content from px group by 1",
)

# ---- layout on raster rows and on the boxes of words

_LINES = """lines as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 y from (select doc_id, regexp_extract_all(text, '(?s).{1,80}') l from documents where text <> '')),
    profile as (select doc_id, cast(y as int) y, cast(length(regexp_replace(line, '[\\x00-\\x20]', '', 'g')) as int) ink from lines)"""
register("projection_profile", lambda s, d: layout.projection(t(s, d, "documents")), f"with {_LINES} select doc_id, y, ink from profile")
register(
    "count_distinct_lines", lambda s, d: layout.count_lines(layout.projection(t(s, d, "documents")), ["doc_id"], "y", "ink", 64),
    f"with {_LINES}, r as (select doc_id, ink > 64 and lag(ink) over (partition by doc_id order by y) <= 64 up from profile) select doc_id, count(*) filter (up) n_lines from r group by 1",
)
register(
    "merge_nearby", lambda s, d: layout.merge_nearby(layout.projection(t(s, d, "documents")).where("ink > 64").select("doc_id", "y"), ["doc_id"], "y", 2),
    f"""with {_LINES}, p as (select doc_id, y, case when y - lag(y) over (partition by doc_id order by y) <= 2 then 0 else 1 end b from profile where ink > 64),
    g as (select doc_id, y, sum(b) over (partition by doc_id order by y) run from p) select doc_id, cast(floor(median(y)) as int) y from g group by doc_id, run""",
)

_REGIONS = """r0 as (select doc_id, region_id, lower(trim(region_type)) "type", page_number, raw_text, region_confidence, corrected_text, is_corrected, engine_used,
      row_number() over (partition by doc_id, region_id order by ocr_at desc nulls last, region_type desc nulls last, page_number desc nulls last, raw_text desc nulls last) n from region_ocr),
    regions as (select * from r0 where n = 1),
    wb as (select doc_id, region_id, min(bbox.x1) x, min(bbox.y1) y, max(bbox.x2) x2, max(bbox.y2) y2 from words where bbox is not null group by 1, 2),
    boxes as (select r.doc_id, r.region_id, r."type", r.page_number, x, y, x2 - x w, y2 - y h from regions r join wb using (doc_id, region_id))"""


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return layout.region_boxes(t(s, d, "words"), t(s, d, "region_ocr"))


register(
    "bbox_algebra",
    lambda s, d: _boxes(s, d).select("doc_id", "region_id", B.x2(F.col("bbox")).alias("x2"), B.y2(F.col("bbox")).alias("y2"), B.area(F.col("bbox")).alias("area"), B.aspect_ratio(F.col("bbox")).alias("aspect_ratio")),
    f"with {_REGIONS} select doc_id, region_id, x + w x2, y + h y2, cast(w as bigint) * h area, case when h > 0 then w::double / h::double else 0.0 end aspect_ratio from boxes",
)
register(
    "crop_bounds",
    lambda s, d: _boxes(s, d).select("doc_id", "region_id", B.padded(F.col("bbox"), 4, F.lit(PAGE_W), F.lit(PAGE_H)).alias("c")).select("doc_id", "region_id", "c.*"),
    f"with {_REGIONS} select doc_id, region_id, greatest(0, x - 4) x1, greatest(0, y - 4) y1, least({PAGE_W}, x + w + 4) x2, least({PAGE_H}, y + h + 4) y2 from boxes",
)
register("count_by_type", lambda s, d: layout.count_by_type(_boxes(s, d)), f'with {_REGIONS} select "type", count(*) n from boxes group by 1')
register(
    "regions_for_page", lambda s, d: _boxes(s, d).where("page_number = 3").select("doc_id", "region_id", "type"),
    f'with {_REGIONS} select doc_id, region_id, "type" from boxes where page_number = 3',
)
register(
    "regions_of_type", lambda s, d: _boxes(s, d).where("type = 'table'").select("doc_id", "region_id", "page_number"),
    f"with {_REGIONS} select doc_id, region_id, page_number from boxes where \"type\" = 'table'",
)
register(
    "region_ids", lambda s, d: layout.region_ids(_boxes(s, d)).select("doc_id", "region_id", "new_id"),
    f"""with {_REGIONS}, k as (select *, row_number() over (partition by doc_id, "type" order by page_number, y, x, region_id) k from boxes)
    select doc_id, region_id, "type" || '_' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0') new_id from k""",
)
register(
    "page_zones", lambda s, d: layout.zones(_boxes(s, d), PAGE_W, PAGE_H),
    f"""with {_REGIONS}, z as (select doc_id, page_number, coalesce(min(y) filter ("type" = 'table'), {int(PAGE_H * 0.12)}) header_bottom, coalesce(max(y + h) filter ("type" = 'table'), {int(PAGE_H * 0.9)}) footer_top from boxes group by 1, 2)
    select *, header_bottom >= 20 has_header, footer_top < {PAGE_H - 20} has_footer from z""",
)
_GUARDS = f"""cast(w as bigint) * h >= 2000 and w >= 20 and h >= 20 and not (w > 0.9 * {PAGE_W} and h > 0.9 * {PAGE_H}) and cast(w as bigint) * h <= 0.85 * {PAGE_W} * {PAGE_H}
    and not ((x < 20 or x + w > {PAGE_W - 20}) and w < 60 and h > 0.2 * {PAGE_H}) and not ((y < 20 or y + h > {PAGE_H - 20}) and h < 60 and w > 0.2 * {PAGE_W})"""
register(
    "text_block_guards", lambda s, d: layout.block_guards(_boxes(s, d), PAGE_W, PAGE_H).select("doc_id", "region_id"),
    f"with {_REGIONS} select doc_id, region_id from boxes where {_GUARDS}",
)


def _classified(s: SparkSession, d: str) -> DataFrame:
    ink = t(s, d, "words").where("bbox is not null").groupBy("doc_id", "region_id").agg(F.sum((F.col("bbox.x2") - F.col("bbox.x1")).cast("bigint") * (F.col("bbox.y2") - F.col("bbox.y1"))).alias("ink"))
    b = layout.block_guards(_boxes(s, d), PAGE_W, PAGE_H).join(ink, ["doc_id", "region_id"])
    return layout.classify(b, F.col("ink").cast("double") / B.area(F.col("bbox")).cast("double"), PAGE_W, PAGE_H).select("doc_id", "region_id", "block")


register(
    "classify_block", _classified,
    f"""with {_REGIONS}, ink as (select doc_id, region_id, sum(cast(bbox.x2 - bbox.x1 as bigint) * (bbox.y2 - bbox.y1)) ink from words where bbox is not null group by 1, 2)
    select doc_id, region_id, case when w::double / h > 0.4 and w::double / h < 2.5 and ink::double / (cast(w as bigint) * h)::double < 0.03 then 'image'
      when y < 0.15 * {PAGE_H} and abs(x + w / 2.0 - {PAGE_W / 2}) < 0.1 * {PAGE_W} and h > 20 then 'title' else 'paragraph' end block
    from boxes join ink using (doc_id, region_id) where {_GUARDS}""",
)

_SEPS = _REGIONS + "".join(
    f""", {a}0 as (select distinct doc_id, region_id, bbox.{a}1 - b.{a} p from words join (select * from boxes where "type" = 'table') b using (doc_id, region_id) where bbox is not null),
    {a}1 as (select *, case when p - lag(p) over (partition by doc_id, region_id order by p) <= 20 then 0 else 1 end s from {a}0),
    {a}2 as (select *, sum(s) over (partition by doc_id, region_id order by p) run from {a}1),
    {a}s as (select doc_id, region_id, cast(floor(median(p)) as int) {a} from {a}2 group by doc_id, region_id, run)"""
    for a in ("x", "y")
)
_SPANS = """, xi as (select doc_id, region_id, x, lead(x) over w x_to, row_number() over w - 1 j from xs window w as (partition by doc_id, region_id order by x)),
    yi as (select doc_id, region_id, y, lead(y) over w y_to, row_number() over w - 1 i from ys window w as (partition by doc_id, region_id order by y)),
    c as (select * from yi join xi using (doc_id, region_id) where x_to is not null and y_to is not null)"""
_CELL = "select doc_id, region_id, cast(i as int) i, cast(j as int) j, x + 2 x, y + 2 y, greatest(1, x_to - x - 4) width, greatest(1, y_to - y - 4) height from {0} where x_to - x >= 8 and y_to - y >= 8"


def _grid(s: SparkSession, d: str, merged: int | None) -> DataFrame:
    ys, xs = layout.table_separators(t(s, d, "words"), t(s, d, "region_ocr"))
    return layout.grid(ys, xs, ["doc_id", "region_id"], merged).withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")})


register("cell_grid", lambda s, d: _grid(s, d, None), f"with {_SEPS}{_SPANS} {_CELL.format('c')}")
register(
    "merged_column", lambda s, d: _grid(s, d, 1),
    f"""with {_SEPS}{_SPANS}, m as (select doc_id, region_id, min(y) y, max(y_to) y_to, max(i) i, x, x_to, j from c where j = 1 and i >= 1 group by doc_id, region_id, x, x_to, j),
    u as (select doc_id, region_id, y, y_to, i, x, x_to, j from c where not (j = 1 and i >= 1) union all select doc_id, region_id, y, y_to, i, x, x_to, j from m) {_CELL.format('u')}""",
)


def _edges(s: SparkSession, d: str) -> DataFrame:
    xs = layout.table_separators(t(s, d, "words"), t(s, d, "region_ocr"))[1]
    w = _boxes(s, d).select("doc_id", "region_id", F.col("bbox.width").alias("w"))
    return layout.column_edges(xs.join(w, ["doc_id", "region_id"]), ["doc_id", "region_id"], F.col("w")).withColumn("xs", F.array_join("xs", ","))


register(
    "column_edge_repair", _edges,
    f"""with {_SEPS}, a as (select doc_id, region_id, list(x order by x) l from xs group by 1, 2)
    select doc_id, region_id, array_to_string(list_concat(case when l[1] > 20 then [0] else [] end, l, case when w > l[-1] + 20 then [w] else [] end), ',') xs from a join boxes using (doc_id, region_id)""",
)

# ---- extraction


def _extract(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "doc_ocr").select("doc_id", "page_count").distinct()
    j = _boxes(s, d).join(docs, "doc_id", "left")
    path = F.when(F.col("page_number").between(1, F.col("page_count")), F.concat(F.lit("layouts/"), "doc_id", F.lit("/"), "region_id", F.lit(".png")))
    return j.select("doc_id", "region_id", path.alias("image_path"))


register(
    "extract_join", _extract,
    f"with {_REGIONS} select b.doc_id, region_id, case when page_number between 1 and page_count then 'layouts/' || b.doc_id || '/' || region_id || '.png' end image_path from boxes b left join (select distinct doc_id, page_count from doc_ocr) d on d.doc_id = b.doc_id",
)


def _gate(s: SparkSession, d: str) -> DataFrame:
    """Children of nested regions keep their path only if the parent has a box."""
    rows = nested.flatten(t(s, d, "raw_results"), "record_id", "payload", ("regions", "children"), ("bbox",))
    rows = rows.select("record_id", "field_name", "parent_path", "node_path", F.col("v_bbox").isNotNull().alias("own")).groupBy("record_id", "field_name", "parent_path", "node_path").agg(F.max("own").alias("own"))
    up = rows.select("record_id", F.col("node_path").alias("parent_path"), F.col("own").alias("up")).groupBy("record_id", "parent_path").agg(F.max("up").alias("up"))
    return rows.join(up, ["record_id", "parent_path"], "left").select("record_id", "field_name", "node_path", (F.col("own") & ((F.col("parent_path") == "") | F.coalesce("up", F.lit(False)))).alias("has_image"))


register(
    "parent_path_gate", _gate,
    _nested(("regions", "children"), "select 1")[: -len(" select 1")]
    + """, own as (select record_id, f, parent, path, bool_or(coalesce(json_type(v, '$.bbox'), 'NULL') <> 'NULL') o from nodes group by all),
    up as (select record_id, path parent, bool_or(o) u from own group by all)
    select record_id, f as field_name, path as node_path, o and (parent = '' or coalesce(u, false)) has_image from own left join up using (record_id, parent)""",
)

# ---- OCR results

_WORDS = """w0 as (select doc_id, region_id, word_idx, max(struct_pack(a := coalesce(text, ''), b := case when isnan(confidence) then null else confidence end)) z, text, confidence from words group by doc_id, region_id, word_idx, text, confidence),
    w1 as (select doc_id, region_id, word_idx, text, confidence, row_number() over (partition by doc_id, region_id, word_idx order by text desc nulls last, confidence desc nulls last) n from w0),
    w as (select doc_id, region_id, word_idx, trim(text) text, case when confidence >= 0 and confidence <= 1 then confidence end c from w1 where n = 1 and trim(text) <> ''),
    rr as (select doc_id, region_id, count(*) n_words, string_agg(text, ' ' order by word_idx) text,
      cast(case when count(c) > 0 then floor((2 * sum(cast(round(c * 10000) as bigint)) + count(c)) // (2 * count(c))) else 0 end as bigint) confidence_e4 from w group by 1, 2)"""
register(
    "ocr_words", lambda s, d: ocr.clean_words(t(s, d, "words")).select("doc_id", "region_id", "word_idx", "text", ocr.e4(F.col("confidence")).alias("confidence_e4")),
    f"with {_WORDS} select doc_id, region_id, word_idx, text, cast(round(c * 10000) as bigint) confidence_e4 from w",
)
_WORDS_ONE = """wr as (select distinct doc_id, region_id, word_idx, text, bbox.x1 bx1, bbox.y1 by1 from words)"""
register("region_results", lambda s, d: ocr.region_results(t(s, d, "words")), f"with {_WORDS} select doc_id, region_id, n_words, text, confidence_e4 from rr")
register(
    "document_results", lambda s, d: ocr.document_results(t(s, d, "words"), t(s, d, "region_ocr")),
    f"""with {_REGIONS}, {_WORDS}, j as (select r.doc_id, r.page_number, n_words, confidence_e4 c from regions r left join rr on rr.doc_id = r.doc_id and rr.region_id = r.region_id)
    select doc_id, coalesce(max(page_number), 0) page_count, count(*) n_regions, cast(coalesce(sum(n_words), 0) as bigint) total_words,
    cast(case when count(n_words) > 0 then (2 * sum(c) filter (n_words > 0) + count(n_words)) // (2 * count(n_words)) else 0 end as bigint) mean_confidence_e4,
    count(*) filter (coalesce(c, 0) < 8000) doubtful_region_count from j group by 1""",
)
register(
    "doubtful_regions", lambda s, d: ocr.doubtful(t(s, d, "region_ocr")),
    f'with {_REGIONS} select doc_id, region_id, "type" region_type, page_number from regions where coalesce(case when isnan(region_confidence) then 0 else region_confidence end, 0) < 0.8',
)
register("final_text", lambda s, d: ocr.final_text(t(s, d, "region_ocr")), f"with {_REGIONS} select doc_id, region_id, case when is_corrected then corrected_text else raw_text end final_text from regions")
register(
    "confidence_levels", lambda s, d: ocr.confidence_levels(t(s, d, "words"), t(s, d, "region_ocr")),
    f"""with {_REGIONS}, {_WORDS}, j as (select w.doc_id, r."type" region_type, cast(round(c * 10000) as bigint) c from w join regions r on r.doc_id = w.doc_id and r.region_id = w.region_id where c is not null)
    select cast(grouping_id(doc_id, region_type) as bigint) "level", doc_id, region_type, count(*) n_words, cast((2 * sum(c) + count(*)) // (2 * count(*)) as bigint) confidence_e4 from j group by grouping sets ((doc_id, region_type), (region_type), ())""",
)
register(
    "review_units", lambda s, d: ocr.review_units(t(s, d, "words"), t(s, d, "region_ocr")),
    f"""with {_REGIONS}, {_WORDS} select doc_id, region_id, 'word' unit, word_idx from w where coalesce(c, 0) < 0.8
    union all select doc_id, region_id, 'cell', null from regions r where "type" = 'cell' and coalesce(case when isnan(region_confidence) then 0 else region_confidence end, 0) < 0.8
      and not exists (select 1 from w where w.doc_id = r.doc_id and w.region_id = r.region_id)""",
)

# ---- hashes and knowledge

_Q = "list_transform(embedding, lambda x: cast(floor(x::double * 1000000) as bigint))"


def _grid_hash(s: SparkSession, d: str) -> DataFrame:
    a, h = hashing.grid_bits(F.col("embedding"))
    return t(s, d, "embeddings").select("vec_id", a.alias("ahash"), h.alias("dhash"))


register(
    "grid_hashes", _grid_hash,
    f"""with q as (select vec_id, {_Q} q from embeddings) select vec_id, array_to_string(list_transform(q, lambda x: case when x * 64 > list_sum(q) then '1' else '0' end), '') ahash,
    array_to_string(list_transform(list_filter(range(0, 63), lambda i: i % 8 < 7), lambda i: case when q[i + 2] > q[i + 1] then '1' else '0' end), '') dhash from q""",
)
register(
    "hash_similar_pairs", lambda s, d: hashing.similar_pairs(t(s, d, "knowledge").select(hashing.normal(F.col("phash")).alias("hash"))),
    """with h0 as (select distinct regexp_replace(lower(regexp_replace(phash, '^\\s+|\\s+$', '', 'g')), '^0x', '') h from knowledge where phash is not null),
    h as (select h, from_hex(h)::bit b from h0 where h <> '' and replace(h, h[1], '') <> '')
    select a.h hash_a, b.h hash_b, cast(bit_count(xor(a.b, b.b)) as int) distance from h a join h b on length(a.h) = length(b.h) and a.h < b.h where bit_count(xor(a.b, b.b)) <= 10""",
)
register(
    "nearest_patches",
    lambda s, d: hashing.nearest(t(s, d, "embeddings"), "vec_id", "embedding", 5, F.col("vec_id") % 20 == 0).select(F.col("query").alias("vec_id"), "other", "sq_distance", "rank"),
    f"""with q as (select vec_id, {_Q} q from embeddings), p as (select a.vec_id, b.vec_id other, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as bigint) sq_distance
      from q a join q b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, cast(row_number() over (partition by vec_id order by sq_distance, other) as int) "rank" from p)
    select * from r where "rank" <= 5""",
)
register(
    "knn_label", lambda s, d: knowledge.vote(t(s, d, "embeddings")),
    f"""with q as (select vec_id, label, {_Q} q from embeddings), p as (select a.vec_id, b.label, b.vec_id other, list_sum(list_transform(list_zip(a.q, b.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) d
      from q a join q b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by vec_id order by d, other) k from p),
    v as (select vec_id, label, count(*) n from r where k <= 5 group by 1, 2) select vec_id, label from (select *, row_number() over (partition by vec_id order by n desc, label) k from v) where k = 1""",
)
_E = "entry_id, phash, dhash, ocr_value, region_type, source_document, validation_count, last_validated, created_at, learned_confidence"
register(
    "knowledge_merge", lambda s, d: knowledge.merge(t(s, d, "knowledge"), t(s, d, "knowledge_packs")),
    f"""with k as (select {_E} from knowledge union select {", ".join("e." + x.strip() for x in _E.split(","))} from (select unnest(entries) e from knowledge_packs)),
    r as (select *, row_number() over (partition by entry_id order by last_validated desc nulls last, created_at desc nulls last, ocr_value desc nulls last) n from k where entry_id is not null)
    select entry_id, count(*) n_rows, cast(coalesce(sum(validation_count) filter (validation_count >= 1), 0) as bigint) validation_count, max(last_validated) last_validated, min(created_at) created_at, max(ocr_value) filter (n = 1) ocr_value from r group by 1""",
)
register(
    "pack_check", lambda s, d: knowledge.pack_check(t(s, d, "knowledge_packs")),
    "select distinct pack_id, version, coalesce(len(entries), 0)::int n_entries, entry_count, coalesce(len(entries), 0) = coalesce(entry_count, -1) matches from knowledge_packs",
)
register(
    "feedback_latest", lambda s, d: knowledge.latest_feedback(t(s, d, "events")),
    "with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k, count(*) over (partition by user_id, event_type) n_events from events) select user_id, event_type, ts, event_id, value, n_events from r where k = 1",
)
_WINDOWED = "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n_events, cast(sum(cast(round(value * 100) as bigint)) as bigint) value_cents from events group by 1, 2"
register("feedback_windowed", lambda s, d: knowledge.windowed_feedback(t(s, d, "events")), _WINDOWED)
register("stream_feedback_windowed", lambda s, d: feedback.run_once(feedback.windowed(feedback.read_events(s, f"{d}/events.parquet")), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), _WINDOWED)


def _stream_latest(s: SparkSession, d: str) -> DataFrame:
    out = feedback.run_once(feedback.latest_per_user(feedback.read_events(s, f"{d}/events.parquet")), "update")
    return out.groupBy("user_id").agg(F.max_by("event_id", "n_events").alias("event_id"), F.max("n_events").alias("n_events"))


register(
    "stream_feedback_latest", _stream_latest,
    "with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k, count(*) over (partition by user_id) n_events from events) select user_id, event_id, n_events from r where k = 1",
)
register(
    "json_roundtrip", lambda s, d: t(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("props")),
    "select event_id, cast(json_extract(props, '$.k') as int) k, '{\"k\":' || cast(json_extract(props, '$.k') as int) || '}' props from events",
)
register(
    "engine_page_counts", lambda s, d: t(s, d, "doc_ocr").groupBy(F.lower(F.trim("engine_used")).alias("engine_used")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("page_count").alias("pages")),
    "select lower(trim(engine_used)) engine_used, count(*) n_docs, cast(sum(page_count) as bigint) pages from doc_ocr group by 1",
)
register(
    "source_dispatch", lambda s, d: t(s, d, "doc_ocr").select("doc_id", F.when(F.lower("source_path").endswith(".pdf"), "pdf").otherwise("image").alias("reader")),
    "select doc_id, case when lower(source_path) like '%.pdf' then 'pdf' else 'image' end reader from doc_ocr",
)


def _page_sheet(s: SparkSession, d: str) -> DataFrame:
    """Rebuilt pages: the final texts of a page's regions by kind, in reading order."""
    r = ocr.final_text(t(s, d, "region_ocr")).join(_boxes(s, d), ["doc_id", "region_id"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("bbox.y", "bbox.x", "region_id", "final_text"))), lambda x: x["final_text"])
    return r.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_regions"), F.array_join(order, "\n").alias("text"))


register(
    "rebuild_pages", _page_sheet,
    f"""with {_REGIONS} select b.doc_id, b.page_number, count(*) n_regions, coalesce(string_agg(case when is_corrected then corrected_text else raw_text end, chr(10) order by y, x, b.region_id), '') "text" from boxes b join regions r on r.doc_id = b.doc_id and r.region_id = b.region_id group by 1, 2""",
)


def raster_pages(documents: DataFrame) -> DataFrame:
    """Text rasters as page images, for the vectorised operators."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for i, x in zip(pdf["doc_id"], pdf["text"]):
                g = assess.text_raster(x)
                rows.append((str(i), 1, g.shape[0], g.shape[1], 1, g.tobytes(), f"documents/{i}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "height", "width", "n_channels", "data", "source_path"])

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, images.PAGES)


# ---- images: the text rasters through the vectorised operators


def _raster(s: SparkSession, d: str) -> DataFrame:
    return raster_pages(t(s, d, "documents"))


register("page_assessment", lambda s, d: assess.assess(_raster(s, d)))
register("detected_regions", lambda s, d: layout.detect(_raster(s, d)))
register("region_crops", lambda s, d: layout.crops(layout.detect(_raster(s, d)), _raster(s, d)).select("doc_id", "region_id", "type", "height", "width", "image_path"))
register("page_hashes", lambda s, d: assess.page_hashes(_raster(s, d)))
register(
    "page_metadata", lambda s, d: images.page_metadata(_raster(s, d)),
    f"""with {_PX}, z as (select doc_id, max(h) h from px group by 1) select cast(doc_id as varchar) doc_id, 1 page_number, 0 page_index, 80 width_px, h height_px,
    80 * 72.0::double / 300.0::double width_pt, h * 72.0::double / 300.0::double height_pt, 0 rotation from z""",
)
register(
    "morphology", lambda s, d: assess.morphology(t(s, d, "documents")),
    f"""with {_PX}, k as (select doc_id, h, y, x, case when v > 32 then 1 else 0 end a from px),
    dx as (select *, max(a) over (partition by doc_id, y order by x rows between 1 preceding and 1 following) m from k),
    d as (select *, max(m) over (partition by doc_id, x order by y rows between 1 preceding and 1 following) dil from dx),
    ox as (select *, min(a) over (partition by doc_id, y order by x rows between 1 preceding and 1 following) m2 from d),
    p as (select *, max(m2) over (partition by doc_id, y order by x rows between 1 preceding and 1 following) op from ox)
    select doc_id, cast(sum(a) as bigint) dark, cast(sum(dil) as bigint) dilated, cast(sum(op) as bigint) opened from p group by 1""",
)

# ---- boxes, confidences, results as JSON

register(
    "box_forms",
    lambda s, d: t(s, d, "words").where("bbox is not null").select("doc_id", "region_id", "word_idx", B.from_corners(F.col("bbox")).alias("b"), "bbox").distinct()
    .select("doc_id", "region_id", "word_idx", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.width").alias("width"), F.col("b.height").alias("height"), B.corners(F.col("b"))["x2"].alias("x2"), B.corners(F.col("b"))["y2"].alias("y2"), F.array_join(F.array(*[
        B.of_polygon(F.array(*[F.struct((F.col(f"bbox.{a}") + 0.75).alias("x"), (F.col(f"bbox.{b}") + 0.25).alias("y")) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]))[c] for c in ("x1", "y1", "x2", "y2")
    ]), ",").alias("around")),
    """select distinct doc_id, region_id, word_idx, bbox.x1 x, bbox.y1 y, bbox.x2 - bbox.x1 width, bbox.y2 - bbox.y1 height, bbox.x2 x2, bbox.y2 y2,
    concat_ws(',', least(bbox.x1, bbox.x2), least(bbox.y1, bbox.y2), greatest(bbox.x1, bbox.x2), greatest(bbox.y1, bbox.y2)) around from words where bbox is not null""",
)
register(
    "percent_confidence",
    lambda s, d: t(s, d, "words").where("confidence is not null and not isnan(confidence)").select(F.when(F.col("word_idx") % 7 == 0, F.lit(-1.0)).otherwise(F.round(F.col("confidence") * 100)).alias("percent")).distinct().select("percent", ocr.percent_confidence(F.col("percent")).alias("confidence")),
    """select distinct percent, case when percent = -1 then 0 else greatest(0, percent / 100) end confidence from (select case when word_idx % 7 = 0 then -1.0 else round(confidence * 100) end::double percent from words where confidence is not null and not isnan(confidence))""",
)
register(
    "confidence_by_unit", lambda s, d: ocr.confidence_by_unit(t(s, d, "region_ocr")),
    f"""with {_REGIONS.replace("region_confidence,", "region_confidence, char_confidence, word_confidence,", 1)}, u as (unpivot (select "type", char_confidence, word_confidence, region_confidence from regions) on char_confidence, word_confidence, region_confidence into name unit value c)
    select "type" region_type, replace(unit, '_confidence', '') unit, count(*) n, cast(floor((2 * sum(cast(round(c * 10000) as bigint)) + count(*)) // (2 * count(*))) as bigint) confidence_e4 from u where c >= 0 and c <= 1 group by 1, 2""",
)
_BOX_JSON = "struct<doc_id:string,region_id:string,type:string,page_number:int,bbox:struct<x:int,y:int,width:int,height:int>>"
register(
    "layout_json", lambda s, d: _boxes(s, d).select(F.from_json(F.to_json(F.struct("doc_id", "region_id", "type", "page_number", "bbox")), _BOX_JSON).alias("j")).select("j.doc_id", "j.region_id", "j.type", "j.page_number", "j.bbox.x", "j.bbox.y", "j.bbox.width", "j.bbox.height"),
    f'with {_REGIONS} select doc_id, region_id, "type", page_number, x, y, w width, h height from boxes',
)

# ---- regions against each other

register(
    "types_by_count", lambda s, d: layout.count_by_type(_boxes(s, d)).select(F.row_number().over(Window.orderBy(F.desc("n"), "type")).alias("rank"), "type", "n").orderBy("rank"),
    f'with {_REGIONS}, c as (select "type", count(*) n from boxes group by 1) select cast(row_number() over (order by n desc, "type" nulls first) as int) "rank", "type", n from c',
)
register(
    "overlapping_regions", lambda s, d: layout.overlapping(_boxes(s, d)),
    f"""with {_REGIONS} select a.doc_id, a.page_number, a.region_id, b.region_id other_id, cast(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as bigint) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) area
    from boxes a join boxes b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.region_id < b.region_id where a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h""",
)
register(
    "regions_outside_tables", lambda s, d: layout.outside(_boxes(s, d)).select("doc_id", "region_id", "type"),
    f"""with {_REGIONS} select doc_id, region_id, "type" from boxes a where "type" not in ('table', 'header', 'footer') and not exists (select 1 from boxes b where b.doc_id = a.doc_id and b.page_number = a.page_number
    and b."type" in ('table', 'header', 'footer') and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)""",
)
register(
    "rebuild_tables", lambda s, d: layout.table_rows(t(s, d, "words"), t(s, d, "region_ocr")),
    f"""with {_SEPS}, {_WORDS_ONE}, p as (select w.doc_id, w.region_id, word_idx, trim(text) text, bx1 - b.x x, by1 - b.y y from wr w join boxes b using (doc_id, region_id) where "type" = 'table' and bx1 is not null and trim(text) <> ''),
    ly as (select doc_id, region_id, list(y order by y) l from ys group by all), lx as (select doc_id, region_id, list(x order by x) l from xs group by all),
    c as (select p.doc_id, p.region_id, word_idx, text, list_position(list_transform(ly.l, lambda e: abs(e - p.y)), list_min(list_transform(ly.l, lambda e: abs(e - p.y)))) - 1 i, list_position(list_transform(lx.l, lambda e: abs(e - p.x)), list_min(list_transform(lx.l, lambda e: abs(e - p.x)))) - 1 j from p join ly using (doc_id, region_id) join lx using (doc_id, region_id)),
    g as (select doc_id, region_id, i, j, string_agg(text, ' ' order by word_idx, text) t from c group by all)
    select doc_id, region_id, cast(i as int) i, cast(count(*) as int) n_cells, string_agg(t, ' | ' order by j) "text" from g group by 1, 2, 3""",
)
register("table_workbooks", lambda s, d: images.workbooks(layout.table_rows(t(s, d, "words"), t(s, d, "region_ocr")).withColumn("_o", F.struct("region_id", "i").cast("string")), "doc_id", "_o", ["region_id", "i", "text"]).select("doc_id", (F.length("xlsx") > 0).alias("written")))

# ---- learning from reviews

register(
    "import_defaults", lambda s, d: knowledge.import_defaults(t(s, d, "knowledge_packs")),
    """with e as (select coalesce(created_at, date_trunc('day', received_at)) at_, unnest(entries) e from knowledge_packs),
    f as (select e.entry_id entry_id, e.ocr_value ocr_value, cast(coalesce(e.created_at, at_) as timestamp) created_at, e.last_validated lv, coalesce(e.validation_count, 0) validation_count,
      coalesce(case when isnan(e.learned_confidence) then null else e.learned_confidence end, 0.5) learned_confidence from e where e.entry_id is not null)
    select distinct entry_id, ocr_value, created_at, coalesce(greatest(lv, created_at), created_at) last_validated, validation_count, learned_confidence from f""",
)
_REVIEWED = """r as (select doc_id, region_id, raw_text, corrected_text, min(ocr_at) a, max(ocr_at) b from region_ocr where is_corrected and corrected_text is not null and raw_text is not null and doc_id is not null and region_id is not null group by 1, 2, 3, 4),
    n as (select raw_text, corrected_text, count(*) validation_count, min(a) created_at, max(b) last_validated from r group by 1, 2),
    rev as (select 'review-' || md5(raw_text || chr(31) || corrected_text) entry_id, corrected_text ocr_value, validation_count, created_at, last_validated, validation_count::double / (sum(validation_count) over (partition by raw_text))::double learned_confidence from n)"""
register("reviewed_entries", lambda s, d: knowledge.reviewed(t(s, d, "region_ocr")), f"with {_REVIEWED} select * from rev")
register(
    "review_upsert", lambda s, d: knowledge.upsert(t(s, d, "knowledge"), knowledge.reviewed(t(s, d, "region_ocr"))),
    f"""with {_REVIEWED}, both_ as (select entry_id, ocr_value, validation_count, created_at, last_validated, learned_confidence, 0 new from knowledge where entry_id is not null union all select *, 1 from rev),
    per as (select entry_id, new, max(validation_count) filter (validation_count >= 1) v, min(created_at) c from both_ group by 1, 2),
    top as (select *, row_number() over (partition by entry_id order by last_validated desc nulls last, new desc, ocr_value desc nulls last, learned_confidence desc nulls last) k from both_)
    select entry_id, top.ocr_value, cast(coalesce(v, 0) as bigint) validation_count, c created_at, top.last_validated, top.learned_confidence
    from (select entry_id, sum(v) v, min(c) c from per group by 1) join top using (entry_id) where k = 1""",
)
register("forest_label", lambda s, d: knowledge.forest(t(s, d, "embeddings")))
