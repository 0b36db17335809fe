"""Navigable small-world graphs as flat neighbour arrays, searched for many queries in lockstep.

A graph is a matrix of vectors and a matrix of neighbour numbers (-1: none). All queries of a block take their
steps together, so a step is a few array operations instead of a loop over queries. Two metrics: cosine distance
of unit float32 rows and Hamming distance of rows of uint64 words.
"""

from __future__ import annotations

import numpy as np


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise distance of equally many rows."""
    return 1.0 - np.einsum("nd,nd->n", v, q)


def hamming(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v ^ q).sum(1, dtype=np.int64).astype(np.float32)


METRICS = {"cosine": cosine, "hamming": hamming}
QUERY_BLOCK = 512
#: Distances are taken in pieces of rows of so many bytes on either side, which stay in the processor's cache.
PIECE_BYTES = 256 << 10


def distances(vecs: np.ndarray, node: np.ndarray, q: np.ndarray, row: np.ndarray, metric: str) -> np.ndarray:
    """Distance of vecs[node] and q[row], pair by pair."""
    dist, out = METRICS[metric], np.empty(len(node), np.float32)
    step = max(1, min(PIECE_BYTES // (vecs.itemsize * vecs.shape[1]), len(node)))
    x, y = np.empty((step, vecs.shape[1]), vecs.dtype), np.empty((step, q.shape[1]), q.dtype)
    for at in range(0, len(node), step):
        m = min(step, len(node) - at)
        vecs.take(node[at : at + m], 0, out=x[:m], mode="clip")
        q.take(row[at : at + m], 0, out=y[:m], mode="clip")
        out[at : at + m] = dist(x[:m], y[:m])
    return out


def beam(vecs: np.ndarray, nbrs: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int, metric: str, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes that a beam of ef reaches from the entries (rows of node numbers, -1: none).

    Returns node numbers and distances, nearest first, -1 and inf where fewer were reached. A node is expanded
    once; the search of a query ends when every node in its beam has been expanded.
    """
    n, b = len(vecs), len(q)
    ids = np.full((b, ef), -1, np.int32)
    ds = np.full((b, ef), np.inf, np.float32)
    done = np.ones((b, ef), bool)
    if not n or not b:
        return ids, ds
    seen, base = np.zeros(b * n, bool), np.arange(b) * n

    def offer(rows: np.ndarray, cand: np.ndarray) -> None:
        """Candidates cand[len(rows), c] into the beams of these rows."""
        cand = np.sort(cand, axis=1)
        at = cand + base[rows][:, None]
        fresh = (cand >= 0) & ~seen.take(at, mode="clip")
        fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        flat = np.flatnonzero(fresh)
        if not flat.size:
            return
        r, node = flat // cand.shape[1], cand.ravel()[flat]
        seen[at.ravel()[flat]] = True
        d = distances(vecs, node, q, rows[r], metric)
        # not better than the worst of a full beam: drop before the merge
        good = d < ds[rows[r]].max(1) if ef == 1 else d < np.max(ds[rows], axis=1)[r]
        r, node, d = r[good], node[good], d[good]
        if not r.size:
            return
        per = np.bincount(r, minlength=len(rows))
        wide = int(per.max())
        slot = np.arange(r.size) - np.repeat(np.cumsum(per) - per, per)
        has = np.flatnonzero(per)
        back = np.full(len(rows), -1)
        back[has] = np.arange(has.size)
        new_ids = np.full((has.size, wide), -1, np.int32)
        new_ds = np.full((has.size, wide), np.inf, np.float32)
        new_ids[back[r], slot], new_ds[back[r], slot] = node, d
        at = rows[has]
        all_ds = np.concatenate([ds[at], new_ds], 1)
        all_ids = np.concatenate([ids[at], new_ids], 1)
        all_done = np.concatenate([done[at], np.isinf(new_ds)], 1)
        pick = np.argpartition(all_ds, ef - 1, axis=1)[:, :ef]
        ds[at], ids[at], done[at] = (np.take_along_axis(x, pick, 1) for x in (all_ds, all_ids, all_done))

    rows = np.arange(b)
    offer(rows, entries.astype(np.int64))
    width = min(width, ef)
    while True:
        open_ds = np.where(done, np.inf, ds)
        rows = np.flatnonzero(np.isfinite(open_ds.min(1)))
        if not rows.size:
            break
        od = open_ds[rows]
        pick = np.argpartition(od, width - 1, axis=1)[:, :width] if width < ef else np.broadcast_to(np.arange(ef), od.shape)
        chosen = np.take_along_axis(ids[rows], pick, 1)
        real = np.isfinite(np.take_along_axis(od, pick, 1))
        done[rows[:, None], pick] = True
        nb = nbrs[np.where(real, chosen, 0)]
        nb = np.where(real[:, :, None], nb, -1).reshape(rows.size, -1)
        offer(rows, nb)
    order = np.argsort(ds, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(ds, order, 1)


def add_reverse(nbrs: np.ndarray, ds: np.ndarray, cap: int) -> np.ndarray:
    """Neighbour matrix with up to ``cap`` reverse edges per node, the nearest first, beside the forward ones."""
    n, m = nbrs.shape
    src = np.repeat(np.arange(n), m)
    dst, d = nbrs.ravel(), ds.ravel()
    ok = dst >= 0
    src, dst, d = src[ok], dst[ok], d[ok]
    order = np.lexsort((d, dst))
    src, dst = src[order], dst[order]
    per = np.bincount(dst, minlength=n)
    slot = np.arange(dst.size) - np.repeat(np.cumsum(per) - per, per)
    ok = slot < cap
    back = np.full((n, cap), -1, np.int32)
    back[dst[ok], slot[ok]] = src[ok]
    return np.concatenate([nbrs.astype(np.int32), back], 1)


class Hnsw:
    """Hierarchical graph of one shard of unit vectors, loaded in bulk.

    Layer l holds every 16^l-th node. The links of a layer come from the similarities within the shard, which for a
    shard of bounded size costs less than inserting node by node: of the nearest ``2m`` nodes those are linked that are
    nearer to the node than to any one linked before (so links leave dense clusters), then the nearest others, m in
    all, and m reverse links. All lists come from walks over these links, also those of the shard's own nodes.
    """

    def __init__(self, vecs: np.ndarray, m: int = 16):
        self.vecs = vecs
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = np.arange(len(vecs))
        while True:
            self.layers.append((nodes, self._links(vecs[nodes], m)))
            if len(nodes) <= 64:
                break
            nodes = nodes[::16]

    @staticmethod
    def _links(v: np.ndarray, m: int) -> np.ndarray:
        n = len(v)
        c = min(2 * m, n - 1)
        if c <= 0:
            return np.full((n, m), -1, np.int32)
        s = v @ v.T
        np.fill_diagonal(s, -np.inf)
        cand = np.concatenate([np.argpartition(s[at : at + 1024], n - c, axis=1)[:, n - c :] for at in range(0, n, 1024)])
        sim = np.take_along_axis(s, cand, 1)
        order = np.lexsort((cand, -sim), axis=1)
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        kept = np.zeros((n, c), bool)
        count = np.zeros(n, np.int64)
        closest = np.full((n, c), -np.inf, np.float32)  # similarity of each candidate to the links kept so far
        for i in range(c):
            kept[:, i] = (sim[:, i] > closest[:, i]) & (count < m)
            count += kept[:, i]
            r = np.flatnonzero(kept[:, i])
            if i + 1 < c and r.size:
                closest[r, i + 1 :] = np.maximum(closest[r, i + 1 :], s[cand[r, i][:, None], cand[r, i + 1 :]])
        rank = np.argsort(~kept, axis=1, kind="stable")[:, : min(m, c)]
        return add_reverse(np.take_along_axis(cand, rank, 1), 1 - np.take_along_axis(sim, rank, 1), m)

    def search_own(self, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(node numbers, similarities) of the k most similar other nodes of every node, by a beam that starts there."""
        n = len(self.vecs)
        out_i, out_s = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
        for at in range(0, n, QUERY_BLOCK):
            rows = np.arange(at, min(n, at + QUERY_BLOCK))
            got, d = beam(self.vecs, self.layers[0][1], self.vecs[rows], rows[:, None], max(ef, k + 1), "cosine")
            d = np.where(got == rows[:, None], np.inf, d)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            d = np.take_along_axis(d, order, 1)
            out_i[rows], out_s[rows] = np.where(np.isfinite(d), np.take_along_axis(got, order, 1), -1), 1 - d
        return out_i, out_s

    def search(self, q: np.ndarray, k: int = 5, ef: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(node numbers, similarities) of the k most similar nodes that the beam finds."""
        out_i, out_s = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        for at in range(0, len(q), QUERY_BLOCK):
            part = q[at : at + QUERY_BLOCK]
            nodes, _ = self.layers[-1]
            s = part @ self.vecs[nodes].T
            e = min(4, len(nodes))
            entry = nodes[np.argpartition(-s, e - 1, axis=1)[:, :e]]
            for nodes, nbrs in self.layers[-2:0:-1]:
                local = np.searchsorted(nodes, entry)
                got, _ = beam(self.vecs[nodes], nbrs, part, local, 8, "cosine")
                entry = np.where(got[:, :4] >= 0, nodes[np.maximum(got[:, :4], 0)], -1)
            got, d = beam(self.vecs, self.layers[0][1], part, entry, max(ef, k), "cosine")
            out_i[at : at + len(part)], out_s[at : at + len(part)] = got[:, :k], 1 - d[:, :k]
        return out_i, out_s


class Nsw:
    """Navigable small-world graph of one history segment of bit strings, grown by insertion.

    Entry points of a search are nodes that share a 16-bit band with the query, and a few fixed ones. The beam is
    ``tune``d: widened until it finds nearly all nodes from copies with ``radius`` random bits flipped, as an
    exhaustive comparison tells.
    """

    def __init__(self, words: np.ndarray, bits: int, m: int = 12, ef: int = 48):
        self.words, self.bits, self.m, self.ef = words, bits, m, ef
        self.nbrs = np.full((len(words), 2 * m), -1, np.int32)
        self.far = np.full((len(words), 2 * m), np.inf, np.float32)
        self._bands()

    def _bands(self) -> None:
        """Directory of 16-bit bands: per band the values in order and the node of each."""
        parts = self.words.view(np.uint16)[:, : max(1, -(-self.bits // 16))]
        self.order = np.argsort(parts, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(parts, self.order, 0)

    def entries(self, q: np.ndarray, upto: int, per_band: int = 3, fixed: int = 8) -> np.ndarray:
        """Entry points among the first ``upto`` nodes."""
        parts = q.view(np.uint16)[:, : self.sorted.shape[1]]
        cols = [np.broadcast_to(np.linspace(0, max(0, upto - 1), fixed).astype(np.int64), (len(q), fixed))]
        n = len(self.words)
        for b in range(self.sorted.shape[1]):
            lo = np.searchsorted(self.sorted[:, b], parts[:, b])
            for j in range(per_band):
                at = np.minimum(lo + j, n - 1)
                hit = (lo + j < n) & (self.sorted[at, b] == parts[:, b])
                node = self.order[at, b]
                cols.append(np.where(hit & (node < upto), node, -1)[:, None])
        return np.concatenate(cols, 1)

    @classmethod
    def build(cls, words: np.ndarray, bits: int, m: int = 12, ef: int = 48, step: int = 512) -> Nsw:
        g = cls(words, bits, m, ef)
        n = len(words)
        for at in range(0, n, step):
            new = np.arange(at, min(n, at + step))
            q = words[new]
            # nearest among the nodes in the graph, and among the batch itself
            near = np.bitwise_count(q[:, None, :] ^ q[None, :, :]).sum(2, dtype=np.int64).astype(np.float32)
            np.fill_diagonal(near, np.inf)
            take = min(m, len(new))
            own = np.argpartition(near, take - 1, axis=1)[:, :take]
            ids, ds = at + own, np.take_along_axis(near, own, 1)
            if at:
                got, gd = beam(words, g.nbrs, q, g.entries(q, at), ef, "hamming")
                ids, ds = np.concatenate([ids, got], 1), np.concatenate([ds, gd], 1)
            best = np.argsort(ds, axis=1, kind="stable")[:, :m]
            ids, ds = np.take_along_axis(ids, best, 1), np.take_along_axis(ds, best, 1)
            ids = np.where(np.isfinite(ds), ids, -1)
            g.nbrs[new, : ids.shape[1]], g.far[new, : ids.shape[1]] = ids, ds
            g._link_back(new, ids, ds)
        return g

    def _link_back(self, new: np.ndarray, ids: np.ndarray, ds: np.ndarray) -> None:
        src = np.repeat(new, ids.shape[1])
        dst, d = ids.ravel(), ds.ravel()
        ok = dst >= 0
        src, dst, d = src[ok], dst[ok], d[ok]
        order = np.lexsort((d, dst))
        src, dst, d = src[order], dst[order], d[order]
        node, first, per = np.unique(dst, return_index=True, return_counts=True)
        per = np.minimum(per, self.m)
        wide = int(per.max()) if per.size else 0
        if not wide:
            return
        col = np.arange(wide)
        has = col < per[:, None]
        at = np.where(has, first[:, None] + col, 0)
        add_i, add_d = np.where(has, src[at], -1), np.where(has, d[at], np.inf)
        # already linked forwards: do not list twice
        add_d[(self.nbrs[node][:, None, :] == add_i[:, :, None]).any(2)] = np.inf
        all_i = np.concatenate([self.nbrs[node], add_i], 1)
        all_d = np.concatenate([self.far[node], add_d], 1)
        # the first m links of a node stay longest: the nearest and, for far reach, the oldest
        pick = np.argsort(all_d, axis=1, kind="stable")[:, : 2 * self.m]
        self.nbrs[node] = np.where(np.isfinite(np.take_along_axis(all_d, pick, 1)), np.take_along_axis(all_i, pick, 1), -1)
        self.far[node] = np.take_along_axis(all_d, pick, 1)

    def tune(self, radius: int, sample: int = 256, goal: float = 0.99, widest: int = 512) -> float:
        """Widen the beam until ``goal`` of the sampled nodes are found again, beyond ``widest`` to all nodes (then
        ``within`` compares exhaustively); returns the share reached."""
        n = len(self.words)
        rng = np.random.default_rng(n)
        pick = rng.choice(n, min(n, sample), replace=False)
        q = self.words[pick].copy()
        for i in range(len(q)):
            for bit in rng.choice(self.bits, min(radius, self.bits), replace=False):
                q[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
        truth = [np.flatnonzero(hamming(self.words, np.broadcast_to(x, self.words.shape)) <= radius) for x in q]
        share, self.ef = 0.0, min(16, max(1, n))
        while True:
            found = self.within(q, radius)
            hits = sum(np.isin(t, found[1][found[0] == i]).sum() for i, t in enumerate(truth))
            share = hits / max(1, sum(len(t) for t in truth))
            if share >= goal or self.ef >= n:
                return share
            self.ef = self.ef * 2 if self.ef < widest else n

    def possible(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of the queries that can have a node within the radius: that many flipped bits touch at most as many
        bands, so the others must occur in the segment. Codes with no more bands than that are all possible."""
        need = self.sorted.shape[1] - radius
        if need <= 0 or not len(self.words):
            return np.arange(len(q))
        parts = q.view(np.uint16)[:, : self.sorted.shape[1]]
        hits = np.zeros(len(q), np.int64)
        for b in range(self.sorted.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[:, b], parts[:, b]), len(self.words) - 1)
            hits += self.sorted[at, b] == parts[:, b]
        return np.flatnonzero(hits >= need)

    def within(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, node, distance) of the nodes found within the radius. A beam that the answers fill to
        more than half is widened, as far as the whole graph, so that no number of answers is cut."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(self.words)
        wanted = self.possible(q, radius)
        for at in range(0, len(wanted), QUERY_BLOCK):
            rows = wanted[at : at + QUERY_BLOCK]
            ef = min(self.ef, n)
            while rows.size:
                step = max(1, min(QUERY_BLOCK, (64 << 20) // max(1, n)))
                full = []
                for r in np.array_split(rows, -(-len(rows) // step)):
                    if ef >= n:  # as wide as the segment: compare with every node
                        for k in r:
                            ds = hamming(self.words, q[k][None])
                            j = np.flatnonzero(ds <= radius)
                            out.append((np.full(j.size, k), j.astype(np.int32), ds[j]))
                        full.append(r[:0])
                        continue
                    ids, ds = beam(self.words, self.nbrs, q[r], self.entries(q[r], n), ef, "hamming")
                    hit = ds <= radius
                    crowded = (hit.sum(1) * 2 > ef) & (ef < n)
                    full.append(r[crowded])
                    i, j = np.nonzero(hit & ~crowded[:, None])
                    out.append((r[i], ids[i, j], ds[i, j]))
                rows, ef = np.concatenate(full), min(n, ef * 4)
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]
