"""Repair of text from scanned pages.

Lines that are a running header or a page number are found by what the volume's header and footer regions say;
words divided at line ends are joined; misread words are looked up in a symmetric-delete index of the lexicon and
ranked by an edit distance that charges little for characters that look alike, equal candidates by the bigrams of
the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import squeeze
from quirework.session import cut

#: The index is held by every worker; a larger lexicon is an error, not cut.
MAX_LEXICON = 500_000
HYPHENS = "-¬­‐‑–"
#: printed -> read, in both directions; costs below 1 for likely confusions
CONFUSED = (
    "o0 e c i! l1 il t f h b s5 g9 b6 g6 q9 z2 a á a4 u v c( l! l| i| i1 i: l: t+ n h r n n u a o a e i j f t b 8 s8 e é i í o ó u ú n ñ",
    "w vv|m rn|u ii|d cl|h li|n ri|k lc|g q|in m|ni m|fi ﬁ|fl ﬂ|ff ﬀ|ffi ﬃ|nn rm|w uu|m nn|H ll|b lo|y v",
)
ALIKE_COST, LIMIT, NEAR = 0.35, 1.1, 0.3


def _alike() -> dict[str, set[str]]:
    pairs: dict[str, set[str]] = defaultdict(set)
    flat = CONFUSED[0].replace(" ", "")
    for a, b in [(flat[i], flat[i + 1]) for i in range(0, len(flat), 2)] + [tuple(x.split()) for x in CONFUSED[1].split("|")]:
        pairs[a].add(b)
        pairs[b].add(a)
    return pairs


ALIKE = _alike()
LONGEST = max(map(len, ALIKE))


def fold(text: str) -> str:
    """Lower case without accents and ligatures."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def weighted_distance(read: str, word: str, limit: float = LIMIT) -> float:
    """Edit distance in which groups of characters that look alike cost ALIKE_COST; inf beyond the limit."""
    n, m = len(read), len(word)
    d = [[math.inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        best = math.inf
        for j in range(m + 1):
            x = d[i][j]
            if i and j:
                x = min(x, d[i - 1][j - 1] + (0.0 if read[i - 1] == word[j - 1] else 1.0))
            if i:
                x = min(x, d[i - 1][j] + 1.05)
            if j:
                x = min(x, d[i][j - 1] + 1.05)
            for a in range(1, min(LONGEST, i) + 1):
                for to in ALIKE.get(read[i - a : i], ()):
                    b = len(to)
                    if b <= j and word[j - b : j] == to:
                        x = min(x, d[i - a][j - b] + ALIKE_COST)
            d[i][j] = x
            best = min(best, x)
        if best > limit + 2 * ALIKE_COST:
            return math.inf
    return d[n][m] if d[n][m] <= limit else math.inf


class DeleteIndex:
    """Symmetric-delete index: every word under all its variants with up to two characters deleted."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.variants: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for v in self._deletes(w):
                self.variants[v].append(w)
        self.known: dict[str, list[tuple[str, float, int]]] = {}
        # what the limit allows takes away or adds this many characters at most
        self.longest = max(map(len, words), default=0) + int(LIMIT / ALIKE_COST) * (LONGEST - 1) + 1

    @staticmethod
    def _deletes(w: str) -> set[str]:
        out = {w}
        for k in (1, 2):
            if len(w) > k:
                out.update("".join(w[i] for i in range(len(w)) if i not in gone) for gone in map(set, combinations(range(len(w)), k)))
        return out

    def candidates(self, read: str) -> list[tuple[str, float, int]]:
        """(word, cost, frequency) within NEAR of the cheapest, cheapest first, ties by frequency, then word."""
        if (got := self.known.get(read)) is not None:
            return got
        if len(read) > 2 * self.longest:  # even if all of it were ligatures of accents
            return []
        forms = {f for f in (read, fold(read)) if len(f) <= self.longest}
        seen = {w for f in forms for v in self._deletes(f) for w in self.variants.get(v, ())}
        # groups that stand for others may put more than two deletes between the forms
        for f in list(forms):
            for a in range(2, LONGEST + 1):
                for i in range(len(f) - a + 1):
                    for to in ALIKE.get(f[i : i + a], ()):
                        seen.update(w for v in self._deletes(f[:i] + to + f[i + a :]) for w in self.variants.get(v, ()))
        out = []
        for w in seen if forms else ():
            # short words bear only look-alikes
            limit = LIMIT if len(w) >= 5 else 2 * ALIKE_COST + 0.01 if len(w) >= 3 else ALIKE_COST + 0.01
            cost = min(weighted_distance(f, w, limit) + (0.0 if f == read else ALIKE_COST * 0.5) for f in forms)
            if cost <= limit:
                out.append((w, cost, self.words[w]))
        out.sort(key=lambda x: (x[1], -x[2], x[0]))
        out = [x for x in out if x[1] <= out[0][1] + NEAR]
        if len(self.known) < 1_000_000:
            self.known[read] = out
        return out


_CODE = re.compile(r"^[a-z]?\d+(?:[/.,:-]\d+)*$")
_NUMBER_LINE = re.compile(r"^\W*(?:(?:p|pp|page|pag|seite|s|no|nr)\b\W*)?([0-9]{1,6}|[ivxlcdm]{1,12})\W*$", re.I)
_ROMAN = re.compile(r"^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def page_value(line: str) -> int | None:
    """The number of a line that holds only a page number, in digits or Roman."""
    m = _NUMBER_LINE.match(line.strip())
    if not m:
        return None
    s = m[1].lower()
    if s.isdigit():
        return int(s)
    if not _ROMAN.match(s):
        return None
    v = [_VALUE[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


_NO_LETTERS = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz"))


def letters(line: str) -> str:
    return fold(line).encode("utf-8", "replace").translate(None, _NO_LETTERS).decode()


def edit_within(a: str, b: str, limit: int) -> bool:
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > limit:
            return False
    return row[-1] <= limit


def is_header(line: str, own: str, header: str | None, frame: tuple[list[str], list[str]]) -> bool:
    """Whether the line, with its ``letters``, is the volume's running header, misprints allowed. Of a volume without
    header regions, a line in title case that begins and ends as the headers of other volumes do."""
    if len(own) < 8:
        return False
    if header:
        return edit_within(own, header, max(2, len(header) // 6))
    words = [w for w in line.split() if not re.fullmatch(r"\W*[0-9ivxl]+\W*", w)]
    if len(words) < 4 or sum(w[:1].isupper() for w in words) * 2 <= len(words):
        return False
    like = lambda w, known: any(edit_within(fold(w), k, max(1, len(k) // 4)) for k in known)
    return like(words[0], frame[0]) and like(words[-1], frame[1])


_EDGE = re.compile(r"^[\"'“”‘’(\[{<«]+|[.,;:?\"'“”‘’)\]}>»]+$")


def core(piece: str) -> str:
    return _EDGE.sub("", piece).lower()


class Cores(dict):
    """Pieces of text -> (their core, whether it may be misread); a piece that comes again costs a look-up."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, piece: str) -> tuple[str, bool]:
        w = core(piece)
        got = w, bool(w) and w not in self.words and w.rstrip("!") not in self.words and not _CODE.match(w)
        if len(self) >= 1_000_000:
            self.clear()
        self[piece] = got
        return got


#: Per worker: indexes by the lexicon they were built for, so that tasks share them.
_HELD: dict[str, tuple[DeleteIndex, Cores]] = {}


def held(lexicon: Broadcast) -> tuple[DeleteIndex, Cores]:
    name, words = lexicon.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = DeleteIndex(words), Cores(words)
    return _HELD[name]


def defects(text: str, page: int | None, header: str | None, offset: int | None, frame, index: DeleteIndex, cores: Cores) -> list[tuple]:
    """(token_idx, defect, candidates, previous word, next word, pieces) of one region's text."""
    words = index.words
    out: list[tuple] = []
    body: list[str] = []
    number: list[int] = []  # of the piece in the text
    ends: set[int] = set()  # places in body that end a line
    at = 0
    for line in text.split("\n"):
        pieces = line.split()
        if pieces:
            own = letters(line)
            # a page number has a word of up to five letters and up to twelve Roman digits
            value = page_value(line) if len(own) <= 17 else None
            if value is not None and (offset is None or page is None or value == page + offset):
                out.append((at, "page_number", [("", 0.0, 0)], "", "", len(pieces)))
            elif is_header(line, own, header, frame):
                out.append((at, "header", [("", 0.0, 0)], "", "", len(pieces)))
            else:
                body += pieces
                number += range(at, at + len(pieces))
                ends.add(len(body) - 1)
        at += len(pieces)
    n = len(body)
    suspects = [i for i, p in enumerate(body) if cores[p][1] or (i in ends and p[-1] in HYPHENS)]
    taken = -1
    word = lambda i: cores[body[i]][0] if 0 <= i < n else ""
    for i in suspects:
        if i <= taken:  # the second half of a divided word
            continue
        piece = body[i]
        if i in ends and i + 1 < n and len(piece) > 1 and piece[-1] in HYPHENS and any(c.isalpha() for c in piece[:-1]):
            left, right = _EDGE.sub("", piece[:-1]).lower(), word(i + 1)
            if right and any(c.isalnum() for c in right):
                own, joined = f"{left}-{right}", left + right
                if own not in words:
                    if joined in words:
                        out.append((number[i], "hyphen", [(joined, 0.0, words[joined])], word(i - 1), word(i + 2), 2))
                    else:
                        a, b = index.candidates(own), index.candidates(joined)
                        a = [x for x in a if "-" in x[0]]
                        b = [x for x in b if "-" not in x[0] or "-" in left + right]
                        if a and (not b or a[0][1] < b[0][1]):
                            out.append((number[i], "misread", a, word(i - 1), word(i + 2), 2))
                        elif b:
                            out.append((number[i], "hyphen", b, word(i - 1), word(i + 2), 2))
                        elif right.isalpha() and body[i + 1][:1].islower():
                            out.append((number[i], "hyphen", [(joined, 0.0, 0)], word(i - 1), word(i + 2), 2))
                taken = i + 1
                continue
        w, odd = cores[piece]
        if odd and (got := index.candidates(w)):
            out.append((number[i], "misread", got, word(i - 1), word(i + 1), 1))
    return out


def load_lexicon(lexicon: DataFrame) -> dict[str, int]:
    n = lexicon.count()
    if n > MAX_LEXICON:
        raise ValueError(f"a lexicon of {n} words is larger than MAX_LEXICON; split it by language or collection")
    return {r["w"]: r["f"] for r in lexicon.where("word is not null").groupBy(F.lower("word").alias("w")).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("f")).collect() if r["w"]}


def latest(region_ocr: DataFrame) -> DataFrame:
    """Each (doc_id, region_id) once, its latest row with text."""
    row = F.struct("ocr_at", "raw_text", "page_number", squeeze(F.col("region_type")).alias("kind"))
    r = region_ocr.where("doc_id is not null and region_id is not null and raw_text <> ''").groupBy("doc_id", "region_id").agg(F.max(row).alias("r"))
    return r.select("doc_id", "region_id", "r.raw_text", "r.page_number", "r.kind")


def volumes(regions: DataFrame) -> DataFrame:
    """(doc_id, header, title, offset): the most frequent header as letters and as printed, and the distance of
    printed page numbers from page_number; null where the volume shows none. Counts are combined before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            head = [letters(t) if k == "header" else None for t, k in zip(pdf["raw_text"], pdf["kind"])]
            value = [page_value(t) for t in pdf["raw_text"]]
            offset = [None if v is None or pd.isna(p) else v - int(p) for v, p in zip(value, pdf["page_number"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "header": head, "title": pdf["raw_text"], "offset": pd.array(offset, "Int32")})

    edge = regions.where(F.col("kind").isin("header", "footer")).mapInPandas(run, "doc_id string, header string, title string, offset int")
    h = edge.where("length(header) >= 8")
    h = h.groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title")).groupBy("doc_id").agg(F.max(F.struct("n", "header", "title")).alias("h"))
    o = edge.where("offset is not null").groupBy("doc_id", "offset").count().groupBy("doc_id").agg(F.max(F.struct("count", "offset")).alias("o"))
    return h.join(o, "doc_id", "full_outer").select("doc_id", "h.header", "h.title", "o.offset")


def frames(vols: DataFrame) -> tuple[list[str], list[str]]:
    """First and last words that at least one in a hundred of the volumes' headers share (so at most 100 each)."""
    w = vols.where("title is not null").select(F.split(F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L} ]+", " ")), r"\s+").alias("w"))
    out = []
    for at in (1, -1):
        c = w.groupBy(F.element_at("w", at).alias("x")).count()
        total = w.count()
        out.append(sorted(r["x"] for r in c.where((F.col("count") >= 2) & (F.col("count") * 100 >= total)).collect() if r["x"]))
    return out[0], out[1]


def find(region_ocr: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Defects of paragraph regions: doc_id, region_id, token_idx, defect, repaired, pieces.

    Regions without text, type or ids give none; repeated rows of a region count once. Of several candidates that
    cost nearly the same the one wins whose bigrams with its neighbours are the more frequent, then the cheaper, the
    more frequent, the smaller word.
    """
    shared = region_ocr.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, load_lexicon(lexicon)))  # bounded by MAX_LEXICON
    regions = cut(latest(region_ocr))
    vols = cut(volumes(regions))
    frame = frames(vols)
    names = ["doc_id", "region_id", "token_idx", "defect", "repaired", "cost", "freq", "before", "after", "pieces", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, cores = held(shared)
        words = index.words
        pairs: Counter = Counter()

        def counted() -> pd.DataFrame:
            rows = [(None, None, 0, "", b, 0.0, n, a, "", 0, 0) for (a, b), n in pairs.items()]
            pairs.clear()
            return pd.DataFrame(rows, columns=names)

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                w = [cores[p][0] for p in r.raw_text.split()]
                known = [x in words for x in w]
                pairs.update([p for p, a, b in zip(zip(w, w[1:]), known, known[1:]) if a and b])
                if r.kind != "paragraph":
                    continue
                page = None if pd.isna(r.page_number) else int(r.page_number)
                offset = None if pd.isna(r.offset) else int(r.offset)
                header = r.header if isinstance(r.header, str) else None
                for idx, kind, cands, before, after, pieces in defects(r.raw_text, page, header, offset, frame, index, cores):
                    rows += [(r.doc_id, r.region_id, idx, kind, c, cost, f, before, after, pieces, len(cands)) for c, cost, f in cands]
            yield pd.DataFrame(rows, columns=names)
            if len(pairs) > 500_000:
                yield counted()
        yield counted()

    schema = "doc_id string, region_id string, token_idx int, defect string, repaired string, cost double, freq bigint, before string, after string, pieces int, n int"
    # one pass over the texts finds the defects and counts neighbouring lexicon words (defect '')
    seen = cut(regions.join(vols.select("doc_id", "header", "offset"), "doc_id", "left").mapInPandas(run, schema))
    d = seen.where("defect <> ''")
    b = seen.where("defect = ''").groupBy(F.col("before").alias("a"), F.col("repaired").alias("b")).agg(F.sum("freq").alias("n"))
    p = b.select(F.col("a").alias("before"), F.col("b").alias("repaired"), F.col("n").alias("nb"))
    q = b.select(F.col("a").alias("repaired"), F.col("b").alias("after"), F.col("n").alias("na"))
    several = d.where("n > 1").join(p, ["before", "repaired"], "left").join(q, ["repaired", "after"], "left")
    score = F.col("cost") - F.log1p(F.coalesce("nb", F.lit(0)) + F.coalesce("na", F.lit(0))) * 0.05
    w = Window.partitionBy("doc_id", "region_id", "token_idx").orderBy(score, "cost", F.desc("freq"), "repaired")
    best = several.withColumn("r", F.row_number().over(w)).where("r = 1")
    cols = ["doc_id", "region_id", "token_idx", "defect", "repaired", "pieces"]
    return d.where("n = 1").select(*cols).unionByName(best.select(*cols))


def found(region_ocr: DataFrame, lexicon: DataFrame) -> DataFrame:
    return find(region_ocr, lexicon).select("doc_id", "region_id", "token_idx", "defect", "repaired")


def mend(text: str, fixes: dict[int, tuple[str, int]]) -> str:
    """The text as one line with the fixes (piece -> repaired, pieces) put in, punctuation and capitals kept."""
    pieces = text.split()
    out, i = [], 0
    while i < len(pieces):
        if i not in fixes:
            out.append(pieces[i])
            i += 1
            continue
        repaired, n = fixes[i]
        if repaired:
            head, first, last = re.match(r"^[\"'“‘(\[]*", pieces[i])[0], pieces[i], i
            i += 1
            if n == 2:
                # the other half may stand beyond lines that go
                while i < len(pieces) and i in fixes and not fixes[i][0]:
                    i += fixes[i][1]
                last, i = min(i, len(pieces) - 1), i + 1
            tail = re.search(r"[.,;:?\"'”’)\]]*$", pieces[last])[0]
            out.append(head + (repaired.capitalize() if first[len(head) : len(head) + 1].isupper() else repaired) + tail)
        else:
            i += n
    return " ".join(out)


def paragraphs(region_ocr: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every paragraph region once as continuous text: doc_id, region_id, page_number, text, n_repairs."""
    fixes = find(region_ocr, lexicon).groupBy("doc_id", "region_id").agg(F.collect_list(F.struct("token_idx", "repaired", "pieces")).alias("fixes"))
    regions = latest(region_ocr).where("kind = 'paragraph'").join(fixes, ["doc_id", "region_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, texts = [], []
            for text, own in zip(pdf["raw_text"], pdf["fixes"]):
                own = [] if own is None else list(own)
                n.append(len(own))
                texts.append(mend(text, {x["token_idx"]: (x["repaired"], x["pieces"]) for x in own}))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "region_id": pdf["region_id"], "page_number": pdf["page_number"].astype("Int32"), "text": texts, "n_repairs": n})

    return regions.mapInPandas(run, "doc_id string, region_id string, page_number int, text string, n_repairs int")
