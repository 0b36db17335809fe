"""New batches against all history: near-duplicate hashes by graph index shards.

The history is kept as segments, each with a navigable small-world graph over its different hashes (one row of
flat arrays per segment). ``HistoryIndex`` keeps the segments and the entries behind them in a folder: a new batch
becomes segments of its own, its hashes are searched in them and in the segments of all batches before it, and what
the beams find within the radius is compared exactly. On schedule the small segments are merged; full ones are never
read again except to be searched, so no step works through the history once more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import clean_hash
from quirework.llm.graph import Nsw
from quirework.session import ensure_checkpoint_dir

RADIUS = 10
SHARD = "bits int, segment bigint, n int, ef int, recall double, words binary, nbrs binary"
ENTRY = "entry_id string, p string, d string"
NEAR = "a string, b string, d int"
QUERY_ROWS = 32768


def to_words(codes: list[str], bits: int) -> np.ndarray:
    """Hex strings of one length as rows of 64-bit words, padded with zeros."""
    size = -(-bits // 64) * 16
    raw = bytes.fromhex("".join(c.ljust(size, "0") for c in codes))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(codes), size // 16)


def to_codes(words: np.ndarray, bits: int) -> list[str]:
    raw, size = words.astype(">u8").tobytes().hex(), words.shape[1] * 16
    return [raw[i : i + bits // 4] for i in range(0, len(raw), size)]


def segment_size(bits: int) -> int:
    """Short codes have weak bands and need wider beams in larger graphs."""
    return 8192 if bits <= 64 else 16384


def build_shards(codes: DataFrame, n_segments: int, radius: int = RADIUS) -> DataFrame:
    """Graph shards of (bits, segment, code); codes repeated within a segment count once. Every segment is its own task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = int(key[0])
        words = to_words(sorted(set(pdf["code"])), bits)
        words = np.ascontiguousarray(words[np.random.default_rng(len(words)).permutation(len(words))])
        g = Nsw.build(words, bits)
        recall = g.tune(radius)
        return pd.DataFrame({"bits": [bits], "segment": [key[1]], "n": [len(words)], "ef": [g.ef], "recall": [recall], "words": [words.tobytes()], "nbrs": [g.nbrs.tobytes()]})

    return codes.repartition(max(1, 2 * n_segments), "bits", "segment").groupBy("bits", "segment").applyInPandas(run, SHARD)


def load(row: pd.Series) -> Nsw:
    g = Nsw(np.frombuffer(row["words"], np.uint64).reshape(row["n"], -1), int(row["bits"]), ef=int(row["ef"]))
    g.nbrs = np.frombuffer(row["nbrs"], np.int32).reshape(row["n"], -1)
    return g


def search(shards: DataFrame, queries: DataFrame, n_shards: dict[int, int], counts: dict[int, int], radius: int = RADIUS) -> DataFrame:
    """(a, b, d): for every query code a all codes b of the shards, of its length, that the graphs find within radius.

    n_shards and counts hold the numbers of shards and queries by length. Queries come in blocks; a block meets each
    shard of its length once, and there only those of its queries are searched that can have an answer in the shard
    (``Nsw.possible``). Blocks are small enough to give every core work and at most QUERY_ROWS long.
    """
    spark = queries.sparkSession
    cores = max(2, spark.sparkContext.defaultParallelism)
    blocks = {b: max(-(-c // QUERY_ROWS), min(-(-c // 512), -(-2 * cores // n_shards[b]))) for b, c in counts.items() if c and n_shards.get(b)}
    if not blocks:
        return spark.createDataFrame([], NEAR)
    n_blocks = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("bits")].cast("bigint")
    keys = ["bits", "segment", "block"]
    s = shards.where(F.col("bits").isin(*blocks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    # the codes go to every segment of their length, the segments to every block: each pair meets in one task
    segments = shards.where(F.col("bits").isin(*blocks)).groupBy("bits").agg(F.collect_list("segment").alias("segments"))
    q = queries.join(F.broadcast(segments), "bits").select("bits", F.explode("segments").alias("segment"), F.pmod(F.xxhash64("code"), n_blocks).alias("block"), "code")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(right["code"].to_numpy(object))
        if not len(left) or not len(codes):
            return pd.DataFrame({"a": [], "b": [], "d": []})
        g = load(left.iloc[0])
        qi, node, d = g.within(to_words(list(codes), g.bits), radius)
        names = np.array(to_codes(g.words[node], g.bits), object)
        return pd.DataFrame({"a": codes[qi.astype(np.int64)], "b": names, "d": d.astype(np.int32)})

    n = max(1, sum(n * n_shards[b] for b, n in blocks.items()))
    return s.repartition(n, *keys).groupBy(*keys).cogroup(q.repartition(n, *keys).groupBy(*keys)).applyInPandas(run, NEAR)


def words_of(code: str) -> F.Column:
    """Hex digits as an array of 32-bit numbers, for exact comparison in the JVM."""
    return F.expr(f"transform(sequence(0, cast(ceil(length({code}) / 8) as int) - 1), i -> cast(conv(substring({code}, i * 8 + 1, 8), 16, 10) as bigint))")


def hamming(a: str, b: str) -> F.Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def link(e: DataFrame, near: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (entry_a, entry_b) of entries (entry_id, p, d, from_pack) whose phashes are linked and whose dhashes, if
    both are there, agree; the first code of a link must be that of a pack's entry."""
    e = e.withColumn("dw", words_of("d"))
    side = lambda x: e.select(F.col("p").alias(x), F.col("entry_id").alias(f"e{x}"), F.col("d").alias(f"d{x}"), F.col("dw").alias(f"w{x}"), F.col("from_pack").alias(f"f{x}"))
    j = near.select("a", "b").join(side("a").where("fa"), "a").join(side("b"), "b").where("ea <> eb")
    ok = F.col("da").isNull() | F.col("db").isNull() | ((F.length("da") == F.length("db")) & (hamming("wa", "wb") <= radius))
    return j.where(ok).select(F.least("ea", "eb").alias("entry_a"), F.greatest("ea", "eb").alias("entry_b")).distinct()


def found(knowledge: DataFrame, packs: DataFrame, path: str | None = None, period: str = "yyyy-QQQ", compact_every: int = 3) -> DataFrame:
    """Pairs of entries of which one comes with a pack and repeats or nearly repeats the other.

    ``knowledge`` is the first batch of an index; the packs come in batches by the ``period`` of receipt (those without
    a time first), each searched against all before it and itself, then added. Packs that come twice, null entries, ids
    and phashes give nothing. The index is built in ``path`` and stays there; without one it is built in the
    checkpoint folder, where the entries and the codes found stay as long as the result may be read.
    """
    spark = knowledge.sparkSession
    ensure_checkpoint_dir(spark)
    index = HistoryIndex(spark, path or f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}", compact_every=compact_every)
    columns = [F.col("phash").alias("code"), "dhash"]
    when = F.coalesce(F.date_format("received_at", period), F.lit("")).alias("at")
    e = packs.select(when, F.explode("entries").alias("e")).select("at", "e.entry_id", "e.phash", "e.dhash")
    periods = sorted(r["at"] for r in packs.select(when).distinct().collect())  # one row per period
    index.add(knowledge.select("entry_id", *columns), "knowledge")
    for at in periods:
        index.feed_codes(e.where(F.col("at") == at).select("entry_id", *columns), f"packs-{at}")
    batches = [b for b in index.batches if b != "knowledge"]
    near = index.near(batches)
    rows = index.entries(["knowledge"]).withColumn("from_pack", F.lit(False)).unionByName(index.entries(batches).withColumn("from_pack", F.lit(True)))
    out = link(rows.groupBy("entry_id", "p", "d").agg(F.max("from_pack").alias("from_pack")), near, index.radius)
    if path is None:
        index.delete("shards")
    return out


class HistoryIndex:
    """Segments and entries in Parquet folders: ``feed`` gives a batch's matching entries and adds it, ``search`` only
    looks, ``add`` only adds, ``compact`` merges small segments.

    A manifest, written last and replaced as a whole, names the batches accepted, their folders of entries and the
    folders of segments with the number of codes in each. So an index opened on its folder goes on where the last
    complete step ended; a step that broke off left nothing in the manifest and is done again over its own remains,
    and a batch id that is there already is searched again but not added. One driver writes at a time. Full segments
    (more than half of ``segment_size``) are never rebuilt.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = RADIUS, compact_every: int = 16):
        self.spark, self.path, self.radius, self.compact_every = spark, path, radius, compact_every
        state = self._read() or {"version": 0, "batches": {}, "folders": {}}
        self.version: int = state["version"]
        #: batch id -> number of its folders
        self.batches: dict[str, int] = state["batches"]
        #: folder of segments -> number of codes by length of hash and segment, as [bits, segment, n]
        self.folders: dict[str, list] = state["folders"]

    # ---- files

    def _hadoop(self, name: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def _read(self) -> dict | None:
        fs, at = self._hadoop("manifest")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n[1:-5]) for n in names if n.startswith("m") and n.endswith(".json") and n[1:-5].isdigit()]
        if not numbers:
            return None
        _, at = self._hadoop(f"manifest/m{max(numbers)}.json")
        return json.loads("\n".join(self.spark.sparkContext.wholeTextFiles(at.toString(), 1).values().collect()))

    def _write(self) -> None:
        """The state under the next number: written beside, then renamed."""
        self.version += 1
        text = json.dumps({"version": self.version, "batches": self.batches, "folders": self.folders})
        fs, part = self._hadoop(f"manifest/part-{self.version}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(part, self._hadoop(f"manifest/m{self.version}.json")[1])
        fs.delete(self._hadoop(f"manifest/m{self.version - 2}.json")[1], False)

    def delete(self, name: str = "") -> None:
        fs, at = self._hadoop(name)
        fs.delete(at, True)

    # ---- content

    def shards(self) -> DataFrame | None:
        at = [f"{self.path}/shards/{name}" for name in self.folders]
        return self.spark.read.schema(SHARD).parquet(*at) if at else None

    def n_shards(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for bits, _, _ in (x for rows in self.folders.values() for x in rows):
            out[bits] = out.get(bits, 0) + 1
        return out

    def entries(self, batches: list[str] | None = None) -> DataFrame:
        """(entry_id, p, d) of the batches, or of all."""
        at = [f"{self.path}/entries/b{n}" for b, n in self.batches.items() if batches is None or b in batches]
        return self.spark.read.schema(ENTRY).parquet(*at) if at else self.spark.createDataFrame([], ENTRY)

    def near(self, batches: list[str]) -> DataFrame:
        """(a, b, d) that ``feed_codes`` found for the batches."""
        at = [f"{self.path}/near/b{n}" for b, n in self.batches.items() if b in batches]
        return self.spark.read.schema(NEAR).parquet(*at) if at else self.spark.createDataFrame([], NEAR)

    # ---- steps

    def _codes(self, e: DataFrame) -> DataFrame:
        return e.select(F.col("p").alias("code")).distinct().withColumn("bits", F.length("code") * 4)

    def _clean(self, batch: DataFrame) -> DataFrame:
        """(entry_id, p, d) of a batch; one without entry_id or dhash has only codes."""
        own = [F.col(c) if c in batch.columns else F.lit(None).cast("string").alias(c) for c in ("entry_id", "dhash")]
        e = batch.select(own[0], clean_hash(F.col("code")).alias("p"), clean_hash(own[1]).alias("d")).where("p is not null")
        return (e.where("entry_id is not null") if "entry_id" in batch.columns else e).distinct()

    def search(self, codes: DataFrame) -> DataFrame:
        """(a, b, d) of the codes (code) against all segments; the index stays as it is."""
        q = self._codes(self._clean(codes.select("code")))
        counts = {r["bits"]: r["count"] for r in q.groupBy("bits").count().collect()}  # one row per length of hash
        s = self.shards()
        return self.spark.createDataFrame([], NEAR) if s is None else search(s, q, self.n_shards(), counts, self.radius)

    def _stage(self, batch: DataFrame, number: int) -> tuple[DataFrame, dict[int, int], list]:
        """The batch's entries and segments in its folders; its codes, their number by length, its segments."""
        self._clean(batch).write.mode("overwrite").parquet(f"{self.path}/entries/b{number}")
        q = self._codes(self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/b{number}"))
        counts = {r["bits"]: r["count"] for r in q.groupBy("bits").count().collect()}  # one row per length of hash
        segments = self._build(q, counts, f"b{number}")
        return q, counts, segments

    def _build(self, codes: DataFrame, counts: dict[int, int], folder: str) -> list:
        """Segments of (bits, code) of nearly equal size, written to the folder: [bits, segment, n] of each."""
        n_seg = {b: -(-c // segment_size(b)) for b, c in counts.items()}
        if not n_seg:
            return []
        number = F.create_map(*[F.lit(x) for kv in n_seg.items() for x in kv])[F.col("bits")]
        # no two segments of the index have the same number
        segment = F.lit((self.version + 1) << 32).cast("bigint") + F.pmod(F.xxhash64("code", F.lit(7)), number)
        seg = codes.select("bits", segment.alias("segment"), "code")
        seen = Observation()
        made = build_shards(seg, sum(n_seg.values()), self.radius).observe(seen, F.collect_list(F.struct("bits", "segment", "n")).alias("rows"))
        made.write.mode("overwrite").parquet(f"{self.path}/shards/{folder}")
        return [[r["bits"], r["segment"], r["n"]] for r in seen.get["rows"]]  # one row per segment

    def _accept(self, batch_id: str, number: int, segments: list) -> None:
        self.batches[batch_id] = number
        if segments:
            self.folders[f"b{number}"] = segments
        self._write()
        if sum(name.startswith("b") for name in self.folders) >= self.compact_every:
            self.compact()

    def add(self, batch: DataFrame, batch_id: str | None = None) -> None:
        """The batch (code and, for ``feed``, entry_id and dhash) as new segments. A batch id that is there is left."""
        number = max(self.batches.values(), default=-1) + 1
        batch_id = batch_id or f"#{number}"
        if batch_id not in self.batches:
            self._accept(batch_id, number, self._stage(batch, number)[2])

    def feed_codes(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """(a, b, d) of the codes of the batch (entry_id, code, dhash) near those of the index and each other, kept in
        the folder; then the batch is added."""
        number = max(self.batches.values(), default=-1) + 1
        batch_id = batch_id or f"#{number}"
        if batch_id not in self.batches:
            q, counts, segments = self._stage(batch, number)
            n, shards = self.n_shards(), self.shards()
            for bits, _, _ in segments:
                n[bits] = n.get(bits, 0) + 1
            if segments:
                own = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards/b{number}")
                shards = own if shards is None else shards.unionByName(own)
            near = search(shards, q, n, counts, self.radius) if counts else self.spark.createDataFrame([], NEAR)
            near.write.mode("overwrite").parquet(f"{self.path}/near/b{number}")
            self._accept(batch_id, number, segments)
        return self.near([batch_id])

    def feed(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Pairs (entry_a, entry_b) of the batch's entries (entry_id, code, dhash) with those before it and with each
        other, whose phashes and, if both are there, dhashes lie within the radius; then the batch is added. A batch
        that was fed before gives its pairs again."""
        batch_id = batch_id or f"#{max(self.batches.values(), default=-1) + 1}"
        near = self.feed_codes(batch, batch_id)
        number = self.batches[batch_id]
        before = self.entries([b for b, n in self.batches.items() if n < number]).withColumn("from_pack", F.lit(False))
        return link(before.unionByName(self.entries([batch_id]).withColumn("from_pack", F.lit(True))), near, self.radius)

    def compact(self) -> None:
        """Merge the small segments, by length of hash, into full ones; the others stay as they are. The folders that
        held only merged segments are left to ``vacuum``."""
        small = {(name, bits, seg): n for name, rows in self.folders.items() for bits, seg, n in rows if 2 * n <= segment_size(bits)}
        by_bits: dict[int, int] = {}
        for (_, bits, _), n in small.items():
            by_bits[bits] = by_bits.get(bits, 0) + n
        if len(small) < 2:
            return

        def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, row in pdf.iterrows():
                    yield pd.DataFrame({"bits": np.int32(row["bits"]), "code": to_codes(np.frombuffer(row["words"], np.uint64).reshape(row["n"], -1), int(row["bits"]))})

        parts = []
        for name in sorted({k[0] for k in small}):
            s = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards/{name}")
            parts.append(s.where(" or ".join(f"(bits = {b} and segment = {g})" for n, b, g in small if n == name)))
        codes = parts[0]
        for p in parts[1:]:
            codes = codes.unionByName(p)
        codes = codes.select("bits", "n", "words").mapInPandas(names, "bits int, code string").distinct()
        folder = f"c{self.version + 1}"
        merged = self._build(codes, by_bits, folder)
        kept = {}
        for name, rows in self.folders.items():
            rest = [x for x in rows if (name, x[0], x[1]) not in small]
            if len(rest) == len(rows):
                kept[name] = rows
            elif rest:
                # full segments beside small ones move along, unread but for copying
                self.spark.read.schema(SHARD).parquet(f"{self.path}/shards/{name}").where(" or ".join(f"(bits = {b} and segment = {g})" for b, g, _ in rest)).write.mode("overwrite").parquet(f"{self.path}/shards/{folder}{name}")
                kept[folder + name] = rest
        self.folders = kept | ({folder: merged} if merged else {})
        self._write()

    def vacuum(self) -> None:
        """Delete folders of segments that no manifest names; nobody may be reading an older state."""
        fs, at = self._hadoop("shards")
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName() not in self.folders:
                fs.delete(x.getPath(), True)
