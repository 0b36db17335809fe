"""Containers of fixed capacity filled by best-two-fit.

Items of one block are packed in one task: a bin is filled greedily with the largest item that fits, then its
smallest item is replaced by the two unpacked items that together fit the widened gap more tightly. Sizes are
whole numbers up to the capacity, so a block is a table of counts per size and its memory does not depend on
how skewed the sizes are. Blocks hold about ``block_items`` items each and are spread by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import n_tokens


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item; sizes are between 0 and the capacity. Items of size 0 go to bin 0."""
    sizes = np.asarray(sizes, np.int64)
    bins = np.full(sizes.size, -1, np.int64)
    bins[sizes == 0] = 0
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    count = np.bincount(sizes[order], minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])  # where a size begins in order
    taken = np.zeros(capacity + 1, np.int64)
    idx = np.arange(capacity + 1)
    # floor_of[s]: the largest size at most s with unpacked items, 0 for none
    floor_of = np.maximum.accumulate(np.where(count > 0, idx, 0))

    def take(s: int) -> int:
        count[s] -= 1
        if not count[s]:
            below = floor_of[s - 1]
            e = s
            stop = np.flatnonzero(count[s + 1 :])
            e = s + 1 + stop[0] if stop.size else capacity + 1
            floor_of[s:e] = below
        item = order[first[s] + taken[s]]
        taken[s] += 1
        return item

    def give_back(s: int) -> None:
        taken[s] -= 1
        count[s] += 1
        if count[s] == 1:
            stop = np.flatnonzero(count[s + 1 :])
            e = s + 1 + stop[0] if stop.size else capacity + 1
            floor_of[s:e] = s

    bin_no = 0
    while floor_of[capacity]:
        gap, content = capacity, []
        while gap and (s := int(floor_of[gap])):
            content.append((s, take(s)))
            gap -= s
        if gap and content:
            s, item = content[-1]  # greedy takes sizes in falling order, so the last is the smallest
            room = gap + s
            a = idx[1 : room // 2 + 1]
            a = a[count[a] > 0]
            if a.size:
                b = floor_of[room - a]
                alone = (b == a) & (count[a] < 2)
                b = np.where(alone, floor_of[a - 1], b)
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > s:
                    # the replaced item is the last one taken of its size
                    give_back(s)
                    content[-1:] = [(int(a[best]), -1), (int(b[best]), -1)]
                    content[-2:] = [(x, take(x)) for x, _ in content[-2:]]
        for _, item in content:
            bins[item] = bin_no
        bin_no += 1
    return bins


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, part, bin) of every part: an item that no empty bin can take whole is split into full bins and a rest,
    which is packed like an item. Parts are in the order of items."""
    sizes = np.asarray(sizes, np.int64)
    full = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - full * capacity
    packed = np.flatnonzero((rest > 0) | (full == 0))
    bins = best_two_fit(rest[packed], capacity)
    of_full = np.repeat(np.arange(sizes.size), full)
    part = np.arange(of_full.size) - np.repeat(np.cumsum(full) - full, full)
    item = np.concatenate([of_full, packed])
    part = np.concatenate([part, full[packed]])
    bins = np.concatenate([np.arange(of_full.size) + (bins.max(initial=-1) + 1), bins])
    order = np.lexsort((part, item))
    return item[order], part[order], bins[order]


def pack(docs: DataFrame, capacity: int = 4096, block_items: int = 16384) -> DataFrame:
    """Containers for documents: (doc_id, part, n_parts, tokens, container_id).

    A document that an empty container cannot hold is split into full parts, which are containers of their own, and a
    rest; any other stays whole (n_parts 1). Null or empty texts have 0 tokens and ride in the block's first container.
    Rows without doc_id are packed like others and spread like others; doc_id should identify a row, repeated rows are
    packed as items of their own. Columns besides doc_id and text are ignored. An empty table gives no rows.
    """
    # the number of rows decides the number of blocks; a count of rows reads no column
    blocks = max(1, -(-docs.count() // block_items))
    key = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), F.col("doc_id").isNull())
    sized = docs.select("doc_id", F.coalesce(n_tokens(F.col("text")), F.lit(0)).alias("_n"), F.pmod(key, F.lit(blocks)).alias("_block"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "_n"], kind="stable").reset_index(drop=True)
        sizes = pdf["_n"].to_numpy(np.int64)
        item, part, bins = place(sizes, capacity)
        n_parts = np.bincount(item, minlength=sizes.size)[item]
        names = np.char.add(f"{key[0]}-", np.arange(bins.max(initial=0) + 1).astype(str)).astype(object)
        tokens = np.minimum(capacity, sizes[item] - part * capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy()[item], "part": part.astype(np.int32), "n_parts": n_parts.astype(np.int32), "tokens": tokens.astype(np.int32), "container_id": names[bins]})

    # as many tasks as blocks: the rows are few bytes, so joined by size they would all be one task's
    return sized.repartition(blocks, "_block").groupBy("_block").applyInPandas(run, "doc_id bigint, part int, n_parts int, tokens int, container_id string")


def check(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row of what must hold of every packing: documents, those split, parts, tokens, containers over the capacity
    (none) and documents split although they fit (none)."""
    per = packed.groupBy("container_id").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum((F.col("part") == 0).cast("int")).alias("d"), F.sum(((F.col("part") == 0) & (F.col("n_parts") > 1)).cast("int")).alias("s"),
        F.sum(((F.col("part") == 0) & (F.col("n_parts") > 1) & (F.col("tokens") < capacity)).cast("int")).alias("w"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total("d").alias("n_documents"), total("s").alias("n_split"), total("n").alias("n_parts"), total("t").alias("tokens"), total((F.col("t") > capacity).cast("int")).alias("n_overfull"), total("w").alias("n_split_needlessly"))


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Containers, tokens and unused share over all containers."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        (F.lit(1.0) - F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )


def found(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """Documents that the packing could not place whole."""
    return pack(docs, capacity).where("part = 0 and n_parts > 1").select("doc_id").distinct()
