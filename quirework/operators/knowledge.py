"""Learned corrections: votes of nearest entries, merged packs and the feedback that updates them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.hashing import nearest

ENTRY = ["entry_id", "phash", "dhash", "ocr_value", "region_type", "source_document", "validation_count", "last_validated", "created_at", "learned_confidence"]


def vote(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Label by the k nearest other rows, for every row whose id is divisible by 20; ties to the smaller label."""
    n = nearest(embeddings, "vec_id", "embedding", k, F.col("vec_id") % 20 == 0, "label")
    v = n.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("query").agg(F.min(F.struct(-F.col("n"), "label")).alias("m")).select(F.col("query").alias("vec_id"), F.col("m.label").alias("label"))


def pack_entries(packs: DataFrame) -> DataFrame:
    return packs.select(F.explode("entries").alias("e")).select("e.*").where("entry_id is not null")


def merge(knowledge: DataFrame, packs: DataFrame) -> DataFrame:
    """Knowledge and packs by entry_id: validations of the different rows added up, the latest validation, the first
    creation. Rows delivered twice count once; validations below 1 add nothing."""
    k = knowledge.select(*ENTRY).unionByName(pack_entries(packs).select(*ENTRY)).where("entry_id is not null").distinct()
    v = F.col("validation_count")
    return k.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.when(v >= 1, v)), F.lit(0)).cast("bigint").alias("validation_count"),
        F.max("last_validated").alias("last_validated"), F.min("created_at").alias("created_at"), F.max_by("ocr_value", F.struct("last_validated", "created_at", "ocr_value")).alias("ocr_value"),
    )


def pack_check(packs: DataFrame) -> DataFrame:
    """Packs, each delivery once, with the entries they hold against the number they state."""
    p = packs.select("pack_id", "version", F.coalesce(F.size("entries"), F.lit(0)).alias("n_entries"), "entry_count").distinct()
    return p.withColumn("matches", F.coalesce(F.col("n_entries") == F.col("entry_count"), F.lit(False)))


def latest_feedback(events: DataFrame) -> DataFrame:
    """The latest event of each user and type, the greatest id among equal times."""
    e = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("e"), F.count(F.lit(1)).alias("n_events"))
    return e.select("user_id", "event_type", "e.ts", "e.event_id", "e.value", "n_events")


def windowed_feedback(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type; works on batch and streaming input."""
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "value_cents")


#: JSON keeps microseconds only if told to
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def export_pack(knowledge: DataFrame, pack_id: str, path: str) -> None:
    """Entries as a portable pack of JSON lines."""
    knowledge.select(F.lit(pack_id).alias("pack_id"), F.lit("1.0").alias("version"), *ENTRY).write.mode("overwrite").options(**TIMES).json(path)


def import_pack(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**TIMES).json(path)


def import_defaults(packs: DataFrame) -> DataFrame:
    """Entries of packs as they are taken in: created_at, where missing, is the pack's, else the day of receipt;
    last_validated, where missing or before that, is created_at; counts start from 0 and confidence from 0.5."""
    e = packs.select(F.coalesce("created_at", F.date_trunc("day", "received_at")).alias("_at"), F.explode("entries").alias("e")).where("e.entry_id is not null")
    e = e.select("e.entry_id", "e.ocr_value", F.coalesce("e.created_at", "_at").cast("timestamp_ntz").alias("created_at"), "e.last_validated", F.coalesce("e.validation_count", F.lit(0)).alias("validation_count"), F.coalesce(F.nanvl("e.learned_confidence", F.lit(None).cast("double")), F.lit(0.5)).alias("learned_confidence"))
    return e.withColumn("last_validated", F.coalesce(F.greatest("last_validated", "created_at"), "created_at")).distinct()


def reviewed(region_ocr: DataFrame) -> DataFrame:
    """Corrections of reviewers as entries: one per text read and text given instead, with how often and when it was
    given, and as confidence its share of all corrections of that reading."""
    r = region_ocr.where("is_corrected and corrected_text is not null and raw_text is not null and doc_id is not null and region_id is not null")
    r = r.select("doc_id", "region_id", "raw_text", "corrected_text", "ocr_at").groupBy("doc_id", "region_id", "raw_text", "corrected_text").agg(F.min("ocr_at").alias("a"), F.max("ocr_at").alias("b"))
    n = r.groupBy("raw_text", "corrected_text").agg(F.count(F.lit(1)).alias("validation_count"), F.min("a").alias("created_at"), F.max("b").alias("last_validated"))
    total = n.groupBy("raw_text").agg(F.sum("validation_count").alias("_n"))
    n = n.join(total, "raw_text").withColumn("learned_confidence", F.col("validation_count") / F.col("_n"))
    return n.select(F.concat(F.lit("review-"), F.md5(F.concat_ws("\x1f", "raw_text", "corrected_text"))).alias("entry_id"), F.col("corrected_text").alias("ocr_value"), "validation_count", "created_at", "last_validated", "learned_confidence")


def upsert(knowledge: DataFrame, entries: DataFrame) -> DataFrame:
    """Knowledge after a review: known entries add up their validations and take the later value and confidence, new
    ones come in. Rows of one entry_id in either table are first made one; null ids do not count."""
    cols = ["entry_id", "ocr_value", "validation_count", "created_at", "last_validated", "learned_confidence"]
    both = knowledge.select(*cols, F.lit(0).alias("_new")).unionByName(entries.select(*cols, F.lit(1).alias("_new"))).where("entry_id is not null")
    latest = F.struct(F.col("last_validated").isNotNull().alias("k"), "last_validated", "_new", "ocr_value", "learned_confidence")
    per = both.groupBy("entry_id", "_new").agg(F.max(F.when(F.col("validation_count") >= 1, F.col("validation_count"))).cast("bigint").alias("v"), F.min("created_at").alias("created_at"), F.max(latest).alias("l"))
    u = per.groupBy("entry_id").agg(F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("validation_count"), F.min("created_at").alias("created_at"), F.max("l").alias("l"))
    return u.select("entry_id", "l.ocr_value", "validation_count", "created_at", "l.last_validated", "l.learned_confidence")


def forest(embeddings: DataFrame, trees: int = 20, max_train: int = 20_000) -> DataFrame:
    """Labels by a random forest for every row whose id is divisible by 20, trained on at most max_train of the other
    rows, the first by a hash of the id. Rows without id, label or vector neither train nor are labelled."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = embeddings.where("vec_id is not null and embedding is not null and label is not null").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    train = rows.where("vec_id % 20 <> 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train)
    model = RandomForestClassifier(numTrees=trees, seed=7, maxDepth=8).fit(train)
    return model.transform(rows.where("vec_id % 20 = 0")).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
