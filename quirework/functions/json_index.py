"""Vectorised structural index over a batch of JSON texts.

The texts are laid end to end in one byte array. Escape, quote, bracket and delimiter bitmaps come from
array comparisons, string interiors from the running parity of quotes, nesting depth from prefix sums of the
brackets; both are taken relative to the start of each text, so that a broken text cannot disturb its
neighbours. Grammar is checked on neighbouring tokens and their container, all tokens at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
for _c, _k in zip(b"{}[]:,", range(6)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
AROUND = " \t\n\r\f\v﻿ \u0085  "


@dataclass
class Index:
    """Tokens of all texts in order of place. container: token number of the enclosing bracket, -1 at the root.
    position: number of commas before the token within its container. depth: brackets around the token. end: last byte
    of the value, inclusive."""

    data: bytes
    valid: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    container: np.ndarray
    position: np.ndarray
    depth: np.ndarray
    is_key: np.ndarray

    def text(self, token: int) -> str:
        return self.data[self.start[token] : self.end[token] + 1].decode("utf-8", "surrogatepass")

    def value(self, token: int) -> str | None:
        """The value as text: what a string says, None for null, brackets as they stand."""
        raw = self.data[self.start[token] : self.end[token] + 1]
        if self.kind[token] != STRING:
            return None if raw == b"null" else raw.decode("utf-8", "surrogatepass")
        said = json.loads(raw.decode("utf-8", "surrogatepass")) if b"\\" in raw else raw[1:-1].decode("utf-8", "surrogatepass")
        return said.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in said) else said

    def key_codes(self, names: Sequence[str]) -> np.ndarray:
        """For every value in an object the number of its field's name among ``names``, -1 for others."""
        out = np.full(self.kind.size, -1, np.int64)
        keys = np.flatnonzero(self.is_key)
        keys = keys[keys + 2 < self.kind.size]
        if not keys.size:
            return out
        b = np.frombuffer(self.data, np.uint8)
        length = self.end[keys] - self.start[keys] - 1
        for code, name in enumerate(names):
            want = np.frombuffer(name.encode(), np.uint8)
            k = keys[length == want.size]
            same = (b[self.start[k][:, None] + 1 + np.arange(want.size)] == want).all(1)
            out[k[same] + 2] = code
        # names with escapes are longer than what they say
        slash = np.concatenate([[0], np.cumsum(b == 92)])
        for k in keys[slash[self.end[keys]] > slash[self.start[keys]]].tolist():
            said = json.loads(self.text(k))
            out[k + 2] = names.index(said) if said in names else -1
        return out


def _forward(a: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(a) if a.size else a


def build(texts: list[str]) -> Index:
    """Index of the texts; texts that are not one valid JSON value (RFC 8259) are marked invalid.
    White space and byte-order marks around a text are ignored. Empty texts are invalid."""
    raw = [t.strip(AROUND).encode("utf-8", "surrogatepass") for t in texts]
    n_docs = len(raw)
    data = b"\n".join(raw) + b"\n"
    b = np.frombuffer(data, np.uint8)
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, n_docs)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[:n_docs]
    valid = sizes > 1
    if n_docs == 0:
        z = np.zeros(0, np.int64)
        return Index(b"", valid, z, z, z, z, z, z, z, z.astype(bool))
    idx = np.arange(b.size, dtype=np.int64)

    # bitmaps: escapes, quotes, string interiors
    slash = b == 92
    if slash.any():
        run_end = _forward(np.where(slash, -1, idx))
        run = np.empty(b.size, np.int64)
        run[0], run[1:] = 0, idx[:-1] - run_end[:-1]
        escaped = (run & 1) == 1
    else:
        escaped = np.zeros(b.size, bool)
    quote = (b == 34) & ~escaped
    seen = np.cumsum(quote)
    before = np.concatenate([[0], seen[first[1:] - 1]]) if n_docs > 1 else np.zeros(1, np.int64)
    parity = (seen - np.repeat(before, sizes)) & 1
    inside = (parity == 1) | quote
    opening = quote & (parity == 1)
    per_doc = np.add.reduceat(quote, first)
    valid &= (per_doc & 1) == 0

    def doc_of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(first, places, side="right") - 1

    # bad characters in strings, bad escapes, backslashes outside strings
    bad = np.flatnonzero(inside & (b < 32))
    if slash.any():
        intro = np.flatnonzero(slash & ~escaped)
        nxt = np.minimum(intro + 1, b.size - 1)
        wrong = ~inside[intro] | ~_ESCAPABLE[b[nxt]]
        u = intro[b[nxt] == 117]
        if u.size:
            quad = np.minimum(u[:, None] + np.arange(2, 6), b.size - 1)
            bad = np.concatenate([bad, u[~_HEX[b[quad]].all(1)]])
        bad = np.concatenate([bad, intro[wrong]])
    if bad.size:
        valid[doc_of(bad)] = False

    # tokens
    kind_at = np.where(inside, -1, _KIND[b])
    loose = ~inside & (kind_at < 0) & ~_SPACE[b]
    starts_scalar = loose.copy()
    starts_scalar[1:] &= ~loose[:-1]
    start = np.flatnonzero((kind_at >= 0) | opening | starts_scalar)
    kind = np.where(opening[start], STRING, np.where(starts_scalar[start], SCALAR, kind_at[start])).astype(np.int8)
    doc = doc_of(start)
    end = start.copy()
    closing = np.flatnonzero(quote & (parity == 0))
    is_str = kind == STRING
    if closing.size:
        at = np.minimum(np.searchsorted(closing, start[is_str]), closing.size - 1)
        end[is_str] = np.maximum(closing[at], start[is_str])
    stops = np.flatnonzero(loose[:-1] & ~loose[1:])
    scalars = np.flatnonzero(kind == SCALAR)
    end[scalars] = stops[np.searchsorted(stops, start[scalars])]
    said = [data[i:j] for i, j in zip(start[scalars].tolist(), (end[scalars] + 1).tolist())]
    wrong_words = {w for w in set(said) if _SCALAR.fullmatch(w) is None}
    if wrong_words:
        valid[doc[scalars[[w in wrong_words for w in said]]]] = False

    # depth by prefix sums, relative to the text; broken texts leave here
    def keep_valid(*arrays: np.ndarray) -> list[np.ndarray]:
        keep = valid[doc]
        return [a[keep] for a in arrays]

    start, end, kind, doc = keep_valid(start, end, kind, doc)
    up = ((kind == OPEN_OBJ) | (kind == OPEN_ARR)).astype(np.int64)
    down = ((kind == CLOSE_OBJ) | (kind == CLOSE_ARR)).astype(np.int64)
    level = np.cumsum(up - down) - (up - down)
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if doc.size else np.zeros(0, bool)
    at_first = np.flatnonzero(new)
    level = level - level[at_first][np.cumsum(new) - 1] if doc.size else level
    after = level + up - down
    if doc.size:
        valid[doc[after < 0]] = False
        last = np.concatenate([at_first[1:] - 1, [doc.size - 1]])
        valid[doc[last[after[last] != 0]]] = False
    has_token = np.zeros(n_docs, bool)
    has_token[doc] = True
    valid &= has_token
    start, end, kind, doc, level, up, down = keep_valid(start, end, kind, doc, level, up, down)
    n = kind.size

    # containers: order by level, within it by place; every opening bracket leads the level it opens
    tok = np.repeat(np.arange(n), 1 + up)
    lead = np.zeros(tok.size, bool)
    lead[1:] = tok[1:] == tok[:-1]
    lev = level[tok] + lead
    order = np.argsort(lev.astype(np.uint16) if n and lev.max() < 65536 else lev, kind="stable")
    tok, lev, lead = tok[order], lev[order], lead[order]
    head = _forward(np.where(lead, np.arange(tok.size), 0))
    comma = np.cumsum((kind[tok] == COMMA) & ~lead) if n else np.zeros(0, np.int64)
    own = ~lead
    container = np.full(n, -1, np.int64)
    position = np.zeros(n, np.int64)
    container[tok[own]] = np.where(lev[own] > 0, tok[head[own]], -1)
    position[tok[own]] = np.where(lev[own] > 0, comma[own] - comma[head[own]], 0)
    closers = np.flatnonzero(down)
    holder = np.where(container >= 0, kind[np.maximum(container, 0)], -1)
    wrong = np.zeros(n, bool)
    wrong[closers] = holder[closers] != kind[closers] - 1
    end[container[closers]] = end[closers]

    # grammar on neighbouring tokens
    prev = np.full(n, -1, np.int8)
    prev[1:] = np.where(doc[1:] == doc[:-1], kind[:-1], -1)
    in_obj, in_arr, root = holder == OPEN_OBJ, holder == OPEN_ARR, holder == -1
    is_key = (kind == STRING) & in_obj & ((prev == OPEN_OBJ) | (prev == COMMA))
    prev_key = np.zeros(n, bool)
    prev_key[1:] = is_key[:-1]
    value_end = np.isin(prev, (STRING, SCALAR, CLOSE_OBJ, CLOSE_ARR)) & ~prev_key
    value = np.isin(kind, (OPEN_OBJ, OPEN_ARR, STRING, SCALAR))
    good_value = np.where(root, prev == -1, np.where(in_arr, (prev == OPEN_ARR) | (prev == COMMA), is_key | (prev == COLON)))
    good = np.where(value, good_value, False)
    good |= (kind == COLON) & in_obj & prev_key
    good |= (kind == COMMA) & ~root & value_end
    good |= (kind == CLOSE_OBJ) & in_obj & ((prev == OPEN_OBJ) | value_end)
    good |= (kind == CLOSE_ARR) & in_arr & ((prev == OPEN_ARR) | value_end)
    valid[doc[~good | wrong]] = False
    return Index(data, valid, doc, kind, start, end, container, position, level, is_key)
