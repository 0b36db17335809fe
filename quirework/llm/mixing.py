"""Sources mixed to target weights.

Slot i of the mix belongs to the source whose share of the cumulative weights holds the i-th point of the
golden-ratio sequence, so every stretch of the mix is close to the target shares. A slot stands for a block of equal
tokens: the r-th slot of a source takes the documents that begin within the r-th block of the source's stream, which
is its documents in the order of a hash, again and again, at most max_repeats times. Documents are never split, so a
long one reaches into later blocks, whose slots then hold the fewer; what a source places so follows its slots to
within one document. Slots beyond the end of the stream stay empty: the source is exhausted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import n_tokens, squeeze
from quirework.session import cut

GOLDEN = 0.6180339887498949
#: Slots of the mix for each source; a block is the total divided by the slots, whatever the size of the corpus.
RESOLUTION = 512
#: Weights are compared as whole parts of this.
PARTS = 10**12
CHUNK = 65536
BUCKET_ROWS = 65536
MAX_SOURCES = 10_000


def sized(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, h) of the documents of the sources in ``targets``; null source or text do not count. h
    orders the documents of a source: the hash of doc_id, of the text where that is null."""
    # the table of targets is a bounded configuration (load_targets checks it), so it may be broadcast
    t = targets.select("source")
    d = docs.where("source is not null and text is not null").select("doc_id", squeeze(F.col("source")).alias("source"), "text")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text"))
    return d.join(F.broadcast(t), "source", "left_semi").select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), h.alias("h"))


def load_targets(mix_targets: DataFrame) -> DataFrame:
    """One row per source: normalised name, weight and repeats; more than MAX_SOURCES rows are an error, not cut."""
    t = mix_targets.where("source is not null").groupBy(squeeze(F.col("source")).alias("source")).agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    rows = t.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return mix_targets.sparkSession.createDataFrame(rows, t.schema)


def sizes(docs_sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source of the targets with its size in tokens and documents, 0 if it has no document."""
    own = docs_sized.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    return targets.join(own, "source", "left").withColumns({"size": F.coalesce("size", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})


def schedule(rows: list, n_slots: int, spark) -> DataFrame:
    """Slots (slot, source, visit): the source of each of the ``n_slots`` points; visit counts a source's slots from 0."""
    weights = [(r["source"], round(PARTS * float(r["target_weight"] or 0))) for r in rows]
    weights = [(s, w) for s, w in weights if w > 0]
    names = [s for s, _ in weights]
    ends = np.cumsum([w for _, w in weights]).astype(np.float64)
    slots = spark.range(0, n_slots if names else 0).select(F.col("id").alias("slot"))
    if not names:
        return slots.select("slot", F.lit(None).cast("string").alias("source"), F.lit(0).cast("bigint").alias("visit"))

    @F.pandas_udf("string")
    def owner(slot: pd.Series) -> pd.Series:
        point = (slot.to_numpy(np.float64) + 0.5) * GOLDEN
        point -= np.floor(point)
        return pd.Series(np.array(names, object)[np.searchsorted(ends[:-1], point * ends[-1], side="right")])

    slots = slots.withColumn("source", owner("slot")).withColumn("_chunk", F.floor(F.col("slot") / CHUNK))
    per = slots.groupBy("_chunk", "source").agg(F.count(F.lit(1)).alias("_n"))
    base = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_chunk", "source", F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_chunk", "source").orderBy("slot")) - 1
    return slots.withColumn("_own", own).join(per, ["_chunk", "source"]).select("slot", "source", (F.col("_base") + F.col("_own")).alias("visit"))


class Plan:
    """Sizes, schedule and report of one mix. Everything kept on the driver is one row per source."""

    def __init__(self, docs: DataFrame, mix_targets: DataFrame, total: int | None = None, resolution: int = RESOLUTION):
        self.spark = docs.sparkSession
        targets = load_targets(mix_targets)
        self.docs = cut(sized(docs, targets))  # four short columns; the texts are read once
        rows = sizes(self.docs, targets).orderBy("source").collect()  # one row per source, bounded by MAX_SOURCES
        whole = sum(r["size"] for r in rows)
        self.total = whole if total is None else total
        self.block = max(1, -(-self.total // (resolution * max(1, len(rows)))))
        self.n_slots = -(-self.total // self.block)
        self.slots = schedule(rows, self.n_slots, self.spark)
        planned = {r["source"]: r["n"] for r in self.slots.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
        schema = "source string, target_weight double, max_repeats int, size bigint, n_docs bigint, planned_slots bigint"
        self.sources = self.spark.createDataFrame([(r["source"], r["target_weight"], r["max_repeats"], r["size"], r["n_docs"], planned.get(r["source"], 0)) for r in rows], schema)
        self.buckets = max(1, -(-max([r["n_docs"] for r in rows], default=0) // BUCKET_ROWS))

    def placed(self) -> DataFrame:
        """(doc_id, source, tokens, h, start, repeat, visit): every document placed; start is where it begins in the
        source's repeated stream. Running sums go by ranges of the hash, so no source is gathered in one task."""
        bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * self.buckets / F.lit(2**32))
        d = self.docs.withColumn("_b", bucket)
        per = d.groupBy("source", "_b").agg(F.sum("tokens").alias("_s"))
        w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("source", "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
        inner = Window.partitionBy("source", "_b").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_own", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(per, ["source", "_b"])
        d = d.join(F.broadcast(self.sources.select("source", "max_repeats", "size", "planned_slots")), "source").withColumn("before", F.col("_base") + F.col("_own"))
        # how often the stream passes the document before the planned blocks or the allowed repeats end
        passes = F.ceil((F.col("planned_slots") * self.block - F.col("before")) / F.greatest(F.col("size"), F.lit(1)))
        times = F.greatest(F.least(passes, F.col("max_repeats").cast("bigint")), F.lit(0)).cast("int")
        d = d.withColumn("_t", times).where("_t > 0").select("doc_id", "source", "tokens", "h", "before", "size", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("repeat"))
        start = F.col("repeat").cast("bigint") * F.col("size") + F.col("before")
        return d.select("doc_id", "source", "tokens", "h", start.alias("start"), "repeat", F.floor(start / self.block).cast("bigint").alias("visit"))

    def records(self) -> DataFrame:
        """The mix itself: (slot, position, doc_id, source, visit, repeat, tokens), one row for every document placed. In
        the order (slot, position) the rows are the combined records."""
        order = Window.partitionBy("source", "visit").orderBy("start", "h", "doc_id", "tokens")
        d = self.placed().withColumn("position", F.row_number().over(order) - 1)
        return d.join(self.slots, ["source", "visit"]).select("slot", "position", "doc_id", "source", "visit", "repeat", "tokens")

    def filled(self) -> DataFrame:
        """Every slot: (slot, source, visit, n_docs, tokens), 0 where no document begins in its block."""
        per = self.placed().groupBy("source", "visit").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens"))
        zero = F.lit(0).cast("bigint")
        return self.slots.join(per, ["source", "visit"], "left").select("slot", "source", "visit", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("tokens", zero).alias("tokens"))

    def supply(self) -> DataFrame:
        """The sources with reachable_slots, the blocks that the stream with all its repeats fills; exhausted: planned
        slots come to the end of the stream or to within the schedule's rounding of it; and short."""
        reach = F.col("max_repeats").cast("bigint") * F.col("size") / F.lit(self.block)
        # of n golden-ratio points a stretch holds its share to within less than log2(n) + 2
        slack = math.ceil(math.log2(self.n_slots + 1)) + 2
        s = self.sources.withColumn("reachable_slots", F.least(F.ceil(F.coalesce(reach, F.lit(0.0))), F.col("planned_slots")))
        s = s.withColumn("exhausted", F.col("planned_slots") + slack >= F.coalesce(reach, F.lit(0.0)))
        short = F.coalesce(F.col("target_weight") * F.lit(float(self.total)) > F.col("max_repeats") * F.col("size"), F.lit(False))
        return s.withColumn("short", F.col("exhausted") & short)

    def report(self) -> DataFrame:
        """Per source: target_weight, max_repeats, size, planned_slots, placed_tokens, actual_share and short."""
        per = self.placed().groupBy("source").agg(F.sum("tokens").alias("placed_tokens"))
        r = self.supply().join(per, "source", "left").withColumn("placed_tokens", F.coalesce("placed_tokens", F.lit(0).cast("bigint")))
        share = F.col("placed_tokens") / F.nullif(F.sum("placed_tokens").over(Window.partitionBy()), F.lit(0).cast("bigint"))
        return r.select("source", "target_weight", "max_repeats", "size", "planned_slots", "placed_tokens", share.alias("actual_share"), "short")


def found(docs: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Sources that cannot reach their weight: those whose planned slots exhaust their stream, then exactly by
    target_weight x total > max_repeats x size. An empty corpus gives none."""
    return Plan(docs, mix_targets).supply().where("short").select("source")
