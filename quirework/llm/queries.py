"""Registry of this package's queries: name -> (callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import history, mixing, neighbours, ocr_repair, packing, quantiles, reading, survivors
from quirework.session import table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: neighbours.found(t(s, d, "knowledge")),
    "p1_neighbours": lambda s, d: neighbours.neighbours(t(s, d, "knowledge")),
    "p2_found": lambda s, d: survivors.found(t(s, d, "knowledge")),
    "p2_consensus": lambda s, d: survivors.consensus_values(t(s, d, "knowledge")),
    "p4_found": lambda s, d: history.found(t(s, d, "knowledge"), t(s, d, "knowledge_packs")),
    "p5_found": lambda s, d: ocr_repair.found(t(s, d, "region_ocr"), t(s, d, "lexicon")),
    "p5_paragraphs": lambda s, d: ocr_repair.paragraphs(t(s, d, "region_ocr"), t(s, d, "lexicon")),
    "p6_found": lambda s, d: quantiles.found(t(s, d, "region_ocr")),
    "p6_daily_estimates": lambda s, d: quantiles.daily_estimates(t(s, d, "region_ocr")),
    "p7_found": lambda s, d: packing.found(t(s, d, "documents")),
    "p7_containers": lambda s, d: packing.pack(t(s, d, "documents")),
    "p7_check": lambda s, d: packing.check(packing.pack(t(s, d, "documents"))),
    "p7_fill": lambda s, d: packing.fill_report(packing.pack(t(s, d, "documents"))),
    "p8_found": lambda s, d: mixing.found(t(s, d, "documents"), t(s, d, "mix_targets")),
    "p8_schedule": lambda s, d: mixing.Plan(t(s, d, "documents"), t(s, d, "mix_targets")).filled(),
    "p8_records": lambda s, d: mixing.Plan(t(s, d, "documents"), t(s, d, "mix_targets")).records(),
    "p8_report": lambda s, d: mixing.Plan(t(s, d, "documents"), t(s, d, "mix_targets")).report(),
    "p9_found": lambda s, d: reading.found(t(s, d, "documents"), t(s, d, "level_labels")),
    "p9_levels": lambda s, d: reading.levels(t(s, d, "documents"), t(s, d, "level_labels")),
    "p9_accuracy": lambda s, d: reading.accuracy(t(s, d, "documents"), t(s, d, "level_labels")),
    "p9_profile": lambda s, d: reading.profile(t(s, d, "documents"), t(s, d, "level_labels")),
}

_TOKENS = "len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^ \\t\\n\\r\\f\\v]'))"
_HASH = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '^0x', '')"

_MIX = f"""m as (select lower(trim(source)) source, max(target_weight) w, max(max_repeats) r from mix_targets where source is not null group by 1),
        d as (select doc_id, lower(trim(source)) source, {_TOKENS} tokens, md5(coalesce(cast(doc_id as varchar), text)) h from documents where source is not null and text is not null and lower(trim(source)) in (select source from m)),
        z as (select m.source, w, r, cast(coalesce(sum(tokens), 0) as bigint) size from m left join d on d.source = m.source group by all),
        k as (select cast(sum(size) as bigint) total, greatest(1, (cast(sum(size) as bigint) + {mixing.RESOLUTION} * count(*) - 1) // ({mixing.RESOLUTION} * count(*))) b from z),
        e as (select source, cast(sum(round(coalesce(w, 0) * {mixing.PARTS})) over (order by source) as double) hi, cast(sum(round(coalesce(w, 0) * {mixing.PARTS})) over () as double) whole, round(coalesce(w, 0) * {mixing.PARTS}) own from z),
        p0 as (select i slot, (i + 0.5::double) * {mixing.GOLDEN}::double x from (select unnest(range(0, (total + b - 1) // b)) i from k)),
        p as (select slot, (x - floor(x)) x from p0),
        slots as (select slot, source, row_number() over (partition by source order by slot) - 1 visit from (select slot, (select min_by(source, hi) from e where own > 0 and hi > p.x * e.whole) source from p)),
        n as (select source, count(*) planned from slots group by 1),
        st as (select d.*, size, r, coalesce(planned, 0) planned, b, cast(coalesce(sum(tokens) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) before
          from d join z using (source) left join n on n.source = d.source, k),
        pl0 as (select doc_id, source, tokens, h, before, size, b, unnest(range(0, greatest(0, least(r, cast(ceil((planned * b - before)::double / greatest(size, 1)) as bigint))))) k from st),
        placed as (select doc_id, source, tokens, h, k * size + before start, cast(k as int) as "repeat", (k * size + before) // b visit from pl0)"""

SQL: dict[str, str] = {
    "p7_check": f"select count(*) n_documents, count(*) filter (n > 4096) n_split, cast(sum(greatest(1, (n + 4095) // 4096)) as bigint) n_parts, cast(sum(n) as bigint) tokens, cast(0 as bigint) n_overfull, cast(0 as bigint) n_split_needlessly from (select coalesce({_TOKENS}, 0) n from documents)",
    "p8_schedule": f"with {_MIX} select slot, s.source, s.visit, count(placed.tokens) n_docs, cast(coalesce(sum(placed.tokens), 0) as bigint) tokens from slots s left join placed on placed.source = s.source and placed.visit = s.visit group by all",
    "p8_records": f"""with {_MIX} select slot, cast(row_number() over (partition by placed.source, placed.visit order by start, h, doc_id, tokens) - 1 as int) position, doc_id, placed.source, placed.visit, "repeat", tokens from placed join slots using (source, visit)""",
    "p8_report": f"""with {_MIX}, t as (select source, sum(tokens) n from placed group by 1)
        select z.source, w target_weight, r max_repeats, size, coalesce(planned, 0) planned_slots, cast(coalesce(t.n, 0) as bigint) placed_tokens, coalesce(t.n, 0)::double / nullif(sum(t.n) over (), 0)::double actual_share, coalesce(w * total > r * size, false) short
        from z left join n on n.source = z.source left join t on t.source = z.source, k""",
    "p4_found": f"""
        with raw as (select entry_id, phash, dhash, false n from knowledge union all select e.entry_id, e.phash, e.dhash, true from (select unnest(entries) e from knowledge_packs)),
        k as (select entry_id, {_HASH.format('phash')} p, {_HASH.format('dhash')} d, n from raw),
        e as (select entry_id, p, case when d <> '' and replace(d, d[1], '') <> '' then d end d, bool_or(n) n from k where entry_id is not null and p <> '' and replace(p, p[1], '') <> '' group by all)
        select distinct least(a.entry_id, b.entry_id) entry_a, greatest(a.entry_id, b.entry_id) entry_b from e a join e b
        on a.n and a.entry_id <> b.entry_id and length(a.p) = length(b.p) and bit_count(xor(from_hex(a.p)::bit, from_hex(b.p)::bit)) <= 10
        and (a.d is null or b.d is null or (length(a.d) = length(b.d) and bit_count(xor(from_hex(a.d)::bit, from_hex(b.d)::bit)) <= 10))""",
    "p1_found": """
        with e as (select entry_id, any_value(histogram_signature) h, any_value(ssim_features) s from knowledge group by 1),
        v as (select 'histogram_signature' f, entry_id, h x from e where len(h) = 256 and len(list_filter(h, lambda y: isfinite(y) and y >= 0)) = 256 and len(list_filter(h, lambda y: y <> 0)) > 0
              union all select 'ssim_features', entry_id, s from e where len(s) = 48 and len(list_filter(s, lambda y: isfinite(y))) = 48 and len(list_filter(s, lambda y: y <> 0)) > 0),
        p as (select a.f, a.entry_id a, b.entry_id b, list_cosine_similarity(a.x, b.x) c from v a join v b on a.f = b.f and a.entry_id <> b.entry_id),
        r as (select *, row_number() over (partition by f, a order by c desc, b) n from p)
        select distinct f as field_name, least(a, b) entry_a, greatest(a, b) entry_b from r where n <= 5 and c >= 0.95""",
    "p6_found": """
        with ok as (
          select doc_id, region_id, max(struct_pack(a := ocr_at, e := lower(trim(engine_used)), t := lower(trim(region_type)), v := cast(round(region_confidence * 10000) as int))) r
          from region_ocr where region_confidence >= 0 and region_confidence <= 1 and not isnan(region_confidence) and trim(raw_text) <> ''
          group by doc_id, region_id),
        h as (select r.e e, r.t t, r.v v, count(*) n from ok group by all),
        c as (select *, sum(n) over (partition by e, t order by v) upto, sum(n) over (partition by e, t) total from h)
        select e as engine_used, t as region_type, p.pct as pct, min(v) as value_e4
        from c, (select unnest([5, 25, 50, 75, 95]) pct) p where upto * 100 >= p.pct * total group by all""",
    "p7_found": f"select distinct doc_id from documents where {_TOKENS} > 4096",
    "p8_found": f"""
        with s as (select lower(trim(source)) source, sum({_TOKENS}) size from documents where source is not null and text is not null group by 1),
        j as (select m.source, m.target_weight w, m.max_repeats r, coalesce(s.size, 0) size from mix_targets m left join s on s.source = m.source)
        select source from j where w * (select sum(size) from j) > r * size""",
    "p2_found": f"""
        with recursive k as (select entry_id, {_HASH.format('phash')} p, {_HASH.format('dhash')} d, ocr_value, validation_count, last_validated, created_at, learned_confidence from knowledge),
        r as (select entry_id, ocr_value, validation_count, last_validated, created_at, learned_confidence,
              case when p <> '' and replace(p, p[1], '') <> '' then p end p, case when d <> '' and replace(d, d[1], '') <> '' then d end d from k),
        keys as (select distinct 'p' || p k, entry_id from r where p is not null union select distinct 'd' || d, entry_id from r where d is not null),
        edges as (select distinct a.entry_id a, b.entry_id b from keys a join keys b using (k) where a.entry_id <> b.entry_id),
        reach as (select a as node, a as other from (select distinct a from edges) union select reach.node, edges.b from reach join edges on reach.other = edges.a),
        g as (select node entry_id, min(other) group_id from reach group by node),
        u as (select group_id, r.entry_id, case when regexp_matches(ocr_value, '[\\pL\\p{{Nd}}]') then ocr_value end o,
              case when learned_confidence between 0 and 1 then learned_confidence end l, case when validation_count >= 1 then validation_count end v,
              case when last_validated >= created_at and last_validated < timestamp '2026-01-01' then last_validated end t from r join g using (entry_id)),
        w as (
          select group_id, 'learned_confidence' field_name, entry_id, row_number() over (partition by group_id order by l desc, entry_id) n from u where l is not null
          union all select group_id, 'validation_count', entry_id, row_number() over (partition by group_id order by v desc, entry_id) from u where v is not null
          union all select group_id, 'last_validated', entry_id, row_number() over (partition by group_id order by t desc, entry_id) from u where t is not null
          union all select group_id, 'ocr_value', entry_id, row_number() over (partition by group_id order by l desc nulls last, v desc nulls last, t desc nulls last, entry_id) from u where o is not null)
        select group_id, field_name, entry_id from w where n = 1""",
}
