"""Reading level of documents.

Smoothed unigram language models, one per grade 1 (easy) .. 5 (demanding), are trained on labelled documents and on
documents whose averages are extreme (formula seeds); a document gets the grade with the highest posterior. Beside
it come the averages of words per sentence and letters per word over the whole document's prose, and the band that
these averages define.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = (1, 2, 3, 4, 5)
#: Words beyond the most frequent of the training texts count together as one word; ``vocabulary`` of ``levels``.
MAX_VOCABULARY = 50_000
#: Counts that a training task holds before it sends them on.
HELD_COUNTS = 200_000
SMOOTHING = 0.5

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|<?https?://[^\s>]+>?")
_CODE = re.compile(r"`[^`\n]+`")
_TAG = re.compile(r"</?[A-Za-z][^>\n]*>")
_DROP = re.compile(r"^[ \t]*(?:#{1,6}(?:[ \t].*)?|\|.*|.*\|[ \t]*|[-=:| \t]{3,})$", re.M)
_BREAK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*+]|\d+[.)])[ \t])|[.!?…]+(?=[\s\"'”’»)\]*_]|$)")
_WORD = re.compile(r"[^\W\d_]+")


def text_cells(text: str) -> list[str]:
    """Sources of the text cells of a notebook, in either form; a text without cells gives none. The form is told by
    the text itself, as nb_format may be wrong. Of broken JSON the complete text cells are read."""
    if text.lstrip()[:1] == "{":
        try:
            cells = json.loads(text).get("cells") or []
        except (ValueError, AttributeError, RecursionError):
            cells = []
            for m in re.finditer(r'\{"cell_type":\s*"markdown"', text):
                try:
                    cells.append(json.JSONDecoder().raw_decode(text, m.start())[0])
                except ValueError:
                    continue
        out = []
        for c in cells if isinstance(cells, list) else []:
            if isinstance(c, dict) and c.get("cell_type") == "markdown":
                s = c.get("source") or ""
                out.append(s if isinstance(s, str) else "".join(x for x in s if isinstance(x, str)))
        return out
    return [p.partition("\n")[2] for p in ("\n" + text).split("\n# %% [")[1:] if p.startswith("markdown]")]


def sentences(text: str | None, cells: bool = True) -> list[list[str]]:
    """Sentences of the prose, as lists of words (runs of letters). Headings, formulas, code, links and tables do
    not count; a paragraph or list item ends a sentence. Null and empty texts have none. Without ``cells`` the text is
    no notebook and all of it is read."""
    out = []
    for cell in (text_cells(text) if cells else [text]) if text else []:
        for pattern in (_FENCE, _FORMULA, _LINK, _CODE, _TAG, _DROP):
            cell = pattern.sub("\n\n" if pattern in (_FENCE, _DROP) else " ", cell)
        for s in _BREAK.split(cell):
            if s and (words := _WORD.findall(s)):
                out.append(words)
    return out


def band(n_sentences: int, n_words: int, n_letters: int) -> str | None:
    if n_words and n_words >= 18 * n_sentences and n_letters >= 6 * n_words:
        return "advanced"
    if n_words and n_words <= 9 * n_sentences and n_letters <= 5 * n_words:
        return "basic"
    return None


def _counts(found: list[list[str]]) -> tuple[int, int, int]:
    return len(found), sum(map(len, found)), sum(len(w) for s in found for w in s)


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = MAX_VOCABULARY, cells: bool = True) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word numbers, log probabilities [word, grade], log priors), counted over every labelled document and every
    document whose averages are extreme. Repeated labels of one grader count once, several graders are averaged, null
    and impossible grades and documents without an id do not count. Without any label or seed all grades are alike.
    The last row of probabilities is of all words beyond the vocabulary together."""
    g = labels.where(F.col("grade").between(1, 5) & F.col("doc_id").isNotNull()).select("doc_id", "grader", "grade").distinct()
    g = g.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("_grade"))
    # the join has no hint: few labels are broadcast, many are met by a shuffle of the texts
    graded = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(g, "doc_id", "left")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text, grade in zip(pdf["text"], pdf["_grade"]):
                found = sentences(text, cells)
                if not found:
                    continue
                level = {"advanced": 5, "basic": 1}.get(band(*_counts(found)) or "")
                if own := {None if pd.isna(grade) else int(grade), level} - {None}:
                    words = Counter(w.lower() for s in found for w in s)
                    for x in own:
                        for w, n in words.items():
                            seen[x, w] += n
                        # no words: documents and words of the grade
                        seen[x, ""] += 1
                        seen[x, " "] += words.total()
                if len(seen) > HELD_COUNTS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pd.DataFrame:
        return pd.DataFrame([(k[0], k[1], n) for k, n in seen.items()], columns=["grade", "word", "n"])

    counts = graded.mapInPandas(count, "grade int, word string, n bigint").groupBy("word", "grade").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col("grade") == x, F.col("n")).otherwise(0)).alias(f"g{x}") for x in GRADES], F.sum("n").alias("n"))
    words: dict[str, int] = {}
    table, prior, total = [], np.zeros(len(GRADES)), np.zeros(len(GRADES))
    for r in wide.orderBy(~F.col("word").isin("", " "), F.desc("n"), "word").limit(vocabulary + 2).collect():
        own = [r[f"g{x}"] for x in GRADES]
        if r["word"] == "":
            prior = np.array(own, float)
        elif r["word"] == " ":
            total = np.array(own, float)
        else:
            words[r["word"]] = len(words)
            table.append(own)
    known = np.array(table, float).reshape(-1, len(GRADES))
    m = np.concatenate([known, [total - known.sum(0)]]) + SMOOTHING
    return words, np.log(m / m.sum(0)), np.log((prior + 1) / (prior + 1).sum())


def levels(docs: DataFrame, labels: DataFrame, vocabulary: int = MAX_VOCABULARY, cells: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_sentences, n_words, n_letters, level (1..5, null without prose),
    p_level (its posterior) and band ('advanced', 'basic' or null). One narrow pass over the whole texts."""
    return _levels(docs, train(docs, labels, vocabulary, cells), cells)


def _levels(docs: DataFrame, model: tuple[dict[str, int], np.ndarray, np.ndarray], cells: bool) -> DataFrame:
    words, logp, prior = model
    rest = len(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = sentences(text if isinstance(text, str) else None, cells)
                ns, nw, nl = _counts(found)
                level = p = None
                if nw:
                    seen = Counter(words.get(w.lower(), rest) for s in found for w in s)
                    at = np.fromiter(seen.keys(), np.int64, len(seen))
                    score = prior + np.fromiter(seen.values(), np.float64, len(seen)) @ logp[at]
                    best = int(score.argmax())
                    level, p = GRADES[best], 1.0 / math.fsum(np.exp(score - score[best]))
                rows.append((doc_id, ns, nw, nl, level, p, band(ns, nw, nl)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_sentences", "n_words", "n_letters", "level", "p_level", "band"])
            out["level"] = out["level"].astype("Int32")
            yield out

    schema = "doc_id bigint, n_sentences bigint, n_words bigint, n_letters bigint, level int, p_level double, band string"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of either band: those whose level lies on the band's side, after the exact check of the averages. A
    side for which the training texts hold no document at all cannot be told by level; there the averages decide."""
    model = train(docs, labels)
    unseen = model[2] <= model[2].min() + 1e-12  # prior of a grade without documents
    high = F.col("level") >= 4 if not unseen[3:].all() else F.lit(True)
    low = F.col("level") <= 2 if not unseen[:2].all() else F.lit(True)
    side = ((F.col("band") == "advanced") & high) | ((F.col("band") == "basic") & low)
    return _levels(docs, model, True).where(side).select("doc_id", "band").distinct()


def accuracy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out accuracy: labels of even doc_ids train, those of odd ones, averaged over graders, are compared with the
    level: (grade, n_docs, n_exact, n_within_one). The documents compared are no formula seeds either."""
    test = labels.where("grade between 1 and 5 and doc_id % 2 <> 0").select("doc_id", "grader", "grade").distinct().groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))
    model = train(docs.join(test, "doc_id", "left_anti"), labels.where("doc_id % 2 = 0"))
    got = _levels(docs, model, True).where("level is not null").select("doc_id", "level").join(test, "doc_id")
    off = F.abs(F.col("level") - F.col("grade"))
    return got.groupBy("grade").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(off == 0).alias("n_exact"), F.count_if(off <= 1).alias("n_within_one"))


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per level and band."""
    return levels(docs, labels).groupBy("level", "band").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))
