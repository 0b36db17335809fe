"""One surviving record per group of duplicates.

Groups are the connected components of rows that share an id or a hash. Per field the best usable value survives;
``consensus`` builds the group's value from all its values by progressive alignment of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import clean_hash
from quirework.session import cut

FAN = 64


def connected(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of undirected ``links`` (a, b): (node, root), root being the component's smallest node.

    Alternates large-star and small-star steps: every node's larger neighbours, then its smaller ones, are hung on
    the smallest. Minima are combined before the shuffle and hot hubs are left to the skew join of AQE; each round
    is written to the shared checkpoint folder. Self links and nulls do not count.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = cut(links.where("a is not null and b is not null and a <> b").select(high.alias("u"), low.alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        # stars: no node has two parents, no parent has a parent
        role = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        role = role.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r"))
        if role.where("c > 1 or (c = 1 and r = 1)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def groups(rows: DataFrame) -> DataFrame:
    """rows with a ``node`` column plus group_id: those of groups with at least two entry_ids.

    ``rows`` must have entry_id, phash, dhash (raw). A row without entry_id can link others but names none.
    """
    r = rows.withColumns({"_p": clean_hash(F.col("phash")), "_d": clean_hash(F.col("dhash"))})
    r = r.withColumn("node", F.coalesce("entry_id", F.concat(F.lit("￿"), F.coalesce("_p", F.lit("")), F.lit("|"), F.coalesce("_d", F.lit("")))))
    keys = r.select("node", F.explode(F.array(F.concat(F.lit("p"), "_p"), F.concat(F.lit("d"), "_d"))).alias("k")).where("k is not null").distinct()
    hubs = keys.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub <> far").select("k", "hub")
    roots = connected(keys.join(hubs, "k").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    member = r.join(roots, "node").withColumn("group_id", F.col("root"))
    size = member.where("entry_id is not null").groupBy("root").agg(F.min("entry_id").alias("_lo"), F.max("entry_id").alias("_hi")).where("_lo <> _hi")
    return member.join(size, "root").withColumn("group_id", F.col("_lo")).drop("_p", "_d", "_lo", "_hi", "root")


def usable(df: DataFrame) -> dict[str, Column]:
    """Column per field: the value where it is usable, else null."""
    c = F.col
    return {
        "ocr_value": F.when(c("ocr_value").rlike(r"[\p{L}\p{Nd}]"), c("ocr_value")),
        "learned_confidence": F.when((c("learned_confidence") >= 0) & (c("learned_confidence") <= 1), c("learned_confidence")),
        "validation_count": F.when(c("validation_count") >= 1, c("validation_count")),
        "last_validated": F.when((c("last_validated") >= c("created_at")) & (c("last_validated") < F.lit("2026-01-01").cast("timestamp")), c("last_validated")),
    }


def survivors(knowledge: DataFrame) -> DataFrame:
    """One row per group: group_id and per field a struct (entry_id, value) of the row that supplies it, null if no
    row has a usable value. Ties go to the smallest entry_id; repeated rows change nothing. All fields are chosen
    in one aggregation that is combined before the shuffle, so a hot group costs no more than others."""
    cols = ["entry_id", "phash", "dhash", "ocr_value", "validation_count", "last_validated", "created_at", "learned_confidence"]
    g = groups(knowledge.select(*cols)).where("entry_id is not null")
    u = usable(g)
    g = g.select("group_id", "entry_id", *[v.alias(f"u_{k}") for k, v in u.items()])
    micros = F.unix_micros(F.col("u_last_validated").cast("timestamp_ltz"))
    far = F.lit(9e18)
    down = {"learned_confidence": -F.col("u_learned_confidence"), "validation_count": -F.col("u_validation_count").cast("double"), "last_validated": -micros.cast("double")}
    last = {k: F.coalesce(v, far) for k, v in down.items()}
    aggs = []
    for f in ("learned_confidence", "validation_count", "last_validated"):
        key = -micros if f == "last_validated" else down[f]
        aggs.append(F.min(F.when(F.col(f"u_{f}").isNotNull(), F.struct(key.alias("k"), "entry_id", F.col(f"u_{f}").alias("value")))).alias(f))
    key = F.struct(last["learned_confidence"].alias("a"), last["validation_count"].alias("b"), F.coalesce(-micros, F.lit(2**62)).alias("c"), "entry_id", F.col("u_ocr_value").alias("value"))
    aggs.append(F.min(F.when(F.col("u_ocr_value").isNotNull(), key)).alias("ocr_value"))
    best = g.groupBy("group_id").agg(*aggs)
    return best.select("group_id", *[F.when(F.col(f).isNotNull(), F.struct(F.col(f)["entry_id"].alias("entry_id"), F.col(f)["value"].alias("value"))).alias(f) for f in u])


def found(knowledge: DataFrame) -> DataFrame:
    s = survivors(knowledge)
    fields = ("ocr_value", "validation_count", "last_validated", "learned_confidence")
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["entry_id"].alias("entry_id")) for f in fields])
    return s.select("group_id", F.explode(each).alias("x")).select("group_id", "x.field_name", "x.entry_id").where("entry_id is not null")


# ---- token-level consensus

Profile = list[dict[str, float]]  # per column: token -> weight; '' is a gap


def align(a: Profile, b: Profile) -> Profile:
    """Progressive alignment step: two profiles to one, by dynamic programming on the shared weight of columns."""
    wa, wb = (max((sum(c.values()) for c in p), default=0.0) for p in (a, b))
    n, m = len(a), len(b)

    def alike(x: dict[str, float], y: dict[str, float]) -> float:
        if len(x) > len(y):
            x, y = y, x
        return sum(w * y.get(t, 0.0) for t, w in x.items() if t) / ((wa * wb) or 1.0)

    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            score[i][j] = max(score[i + 1][j + 1] + alike(a[i], b[j]) + 1e-6, score[i + 1][j], score[i][j + 1])
    out: Profile = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and score[i][j] == score[i + 1][j + 1] + alike(a[i], b[j]) + 1e-6:
            x, y, i, j = a[i], b[j], i + 1, j + 1
        elif j >= m or (i < n and score[i][j] == score[i + 1][j]):
            x, y, i = a[i], {"": wb}, i + 1
        else:
            x, y, j = {"": wa}, b[j], j + 1
        c = dict(x)
        for t, w in y.items():
            c[t] = c.get(t, 0.0) + w
        out.append(c)
    return out


def vote(p: Profile) -> list[str]:
    """The heaviest token of each column, ties to the smallest; columns won by the gap are left out."""
    return [t for t in (min(c, key=lambda t: (-c[t], t)) for c in p) if t]


def token_distance(a: Sequence[str], b: Sequence[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def consensus(values: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, consensus, value): the tokens that win the vote, and the existing value closest to them.

    Equal values are first added up, so a group costs by its different values. Groups with more than FAN different
    values are aligned in a tree of parts of FAN: no task gets more than FAN profiles, and a profile of a part is as
    long as its longest alignment. Null values and values without a token do not count; weights of null count as 0.
    Ties of the final choice go to the greater weight, then the smaller value.
    """
    v = values.select(F.col(group).alias("g"), F.trim(F.col(value)).alias("v"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")).where("v <> ''")
    v = cut(v.groupBy("g", "v").agg((F.sum("w") + F.lit(1e-3)).alias("w")))
    prof = v.select("g", F.xxhash64("v").alias("h"), F.transform(F.split("v", r"\s+"), lambda t: F.create_map(t, F.col("w"))).alias("p"))
    schema = "g string, h bigint, p array<map<string,double>>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [[dict(c) for c in p] for p in pdf.sort_values("h")["p"]]
        parts.sort(key=lambda p: -max((sum(c.values()) for c in p), default=0))
        acc = parts[0]
        for p in parts[1:]:
            acc = align(acc, p)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "h": [pdf["h"].min()], "p": [acc]})

    largest = v.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    while largest > 1:
        parts = -(-largest // FAN)
        keyed = prof.withColumn("_s", F.pmod(F.xxhash64("h", F.lit(largest)), F.lit(max(1, parts * 2 if parts > 1 else 1))))
        prof = cut(keyed.groupBy("g", "_s").applyInPandas(lambda pdf: fold(pdf), schema))
        largest = prof.groupBy("g").count().agg(F.max("count")).first()[0] or 0

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "c": [vote([dict(c) for c in p]) for p in pdf["p"]]})

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["d"] = [token_distance(v.split(), list(c)) for v, c in zip(pdf["v"], pdf["c"])]
            yield pdf

    j = v.join(prof.mapInPandas(voted, "g string, c array<string>"), "g").select("g", "v", "w", "c").mapInPandas(far, "g string, v string, w double, c array<string>, d int")
    return j.groupBy("g").agg(F.min(F.struct("d", -F.col("w"), "v")).alias("m"), F.first(F.array_join("c", " ")).alias("consensus")).select(F.col("g").alias(group), "consensus", F.col("m")["v"].alias(value))


def consensus_values(knowledge: DataFrame) -> DataFrame:
    """Consensus of ocr_value per duplicate group, tokens voting with the row's usable learned_confidence."""
    cols = ["entry_id", "phash", "dhash", "ocr_value", "validation_count", "last_validated", "created_at", "learned_confidence"]
    g = groups(knowledge.select(*cols)).where("entry_id is not null")
    u = usable(g)
    return consensus(g.select("group_id", u["ocr_value"].alias("ocr_value"), u["learned_confidence"].alias("_w")), "group_id", "ocr_value", "_w")
