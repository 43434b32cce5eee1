"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k.

The lattice of a text offers every vocabulary piece at every place (bytes where a character has no piece), scored by a
tempered Zipf law of the piece's rank.  Pieces never run across the start of a word, so the lattice is a chain of
independent word lattices, built once per distinct word of a batch.  Sampling is a best-first search over perturbed
log-probabilities: the root's maximum is a Gumbel variable; the best path inherits it; at every word the rest of the
space that shares the path so far gets a Gumbel maximum truncated at its parent's.  The search pops the largest bound,
which yields distinct segmentations in the order of their perturbed scores, that is a sample without replacement.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import in_bytes, lean, utf8

SAMPLES, ALPHA = 2, 0.25
CHUNK = 1 << 18
BYTE_0 = 3
NONE, PREFIX = -1, -2
#: A worker forgets its word lattices when they have more nodes than this.
NODES_MAX = 3_000_000
_vocabularies: dict[tuple[str, float], Vocabulary] = {}


class Vocabulary:
    """Pieces of a model with byte fallback: their scores, bytes for decoding, and a table of hashed bytes that gives a
    piece's id, or ``PREFIX`` for what only begins pieces."""

    def __init__(self, path: str, alpha: float) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        raw = [bytes([i - BYTE_0]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        if not (sp.is_byte(BYTE_0) and sp.is_byte(BYTE_0 + 255)):
            raise ValueError("the model has no byte pieces")
        whole = [i for i in range(n) if raw[i] and not sp.is_byte(i)]
        rank = np.full(n, len(whole), np.float64)
        rank[whole] = np.arange(len(whole))
        self.score = -alpha * (np.log(rank + 2) + np.log(np.log(len(whole) + 2)))
        self.size = np.array([len(x) for x in raw])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self.longest = int(self.size[whole].max())
        starts = {raw[i][:k]: PREFIX for i in whole for k in range(1, len(raw[i]))} | {raw[i]: i for i in whole}
        end = np.cumsum([len(x) for x in starts])
        keys = W.hashes(np.frombuffer(b"".join(starts), np.uint8), np.concatenate(([0], end[:-1])), end)
        self.table = W.Table(NONE)
        self.table.put(keys, np.array(list(starts.values())))

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, without the blank that encoding puts first."""
        ids = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
        size = self.size[ids]
        end = np.concatenate(([0], np.cumsum(size)))
        raw = self.flat[np.repeat(self.begin[ids] - end[:-1], size) + np.arange(end[-1])].tobytes()
        at = end[np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)].tolist()
        return [raw[lo + 1 : hi] for lo, hi in zip(at, at[1:])]


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary of this process for a model file."""
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.held, self.n = np.empty(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        to = self.n + len(more)
        if to > len(self.held):
            before, self.held = self.held, np.empty(to + to // 2, self.held.dtype)
            self.held[: self.n] = before[: self.n]
        self.held[self.n : to] = more
        self.n = to

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Lattices:
    """Lattices of distinct words, kept from block to block.

    Words start at a blank after another byte, and around line feeds.  A node is a byte offset in a word (``base`` to
    ``last``), an edge a piece (``piece``, or -1 for the bytes of a character) into its end node; edges are sorted by
    end node (those of node n from ``head[n]``) and ``cumulative`` runs over their probabilities given the end node, from
    0 before the first edge.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.reset()

    def reset(self) -> None:
        self.known = W.Table()
        kinds = {"base": np.int64, "last": np.int64, "text": np.uint8, "head": np.int64, "begin": np.int32, "end": np.int32, "piece": np.int32, "log_p": np.float64, "cumulative": np.float64, "n_ids": np.int32}
        self._columns = {k: _Column(t) for k, t in kinds.items()}
        self._columns["head"].extend(np.zeros(1, np.int64))
        self._columns["cumulative"].extend(np.zeros(1))
        self._view()

    def _view(self) -> None:
        for k, c in self._columns.items():
            setattr(self, k, c.all)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The word of each place in the texts, and the first place of each text (one more at the end)."""
        padded = [b" " + t if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(padded), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in padded])))
        new = np.zeros(len(buf), bool)
        new[1:] = ((buf[1:] == 32) & (buf[:-1] != 32)) | (buf[1:] == 10) | (buf[:-1] == 10)
        new[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(buf))[: len(start)]
        if len(self.text) > NODES_MAX:
            self.reset()
        keys = W.hashes(buf, start, end)
        word = self.known.find(keys)
        if (word < 0).any():
            fresh, first = np.unique(keys[word < 0], return_index=True)
            at_first = np.flatnonzero(word < 0)[first]
            self.known.put(fresh, len(self.base) + np.arange(len(fresh)))
            self._build(buf, start[at_first], (end - start)[at_first])
            word = self.known.find(keys)
        return word, np.searchsorted(start, at)

    def _build(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Append the lattices of words."""
        v = self.v
        base = np.concatenate(([0], np.cumsum(size + 1)))
        n = int(base[-1])
        offset = np.arange(n - len(size)) - np.repeat(np.cumsum(size) - size, size)
        node = np.repeat(base[:-1], size) + offset
        own = buf[np.repeat(start, size) + offset]
        last = base[1:] - 1
        text = np.zeros(n, np.uint8)
        text[node] = own
        room = np.repeat(size, size) - offset
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W._BYTE[text] * W.powers(W._BASE, n))))
        inverse = W.powers(W._INVERSE, n + 1)
        lead = (own & 0xC0) != 0x80
        wide = np.where(own < 0x80, 1, np.where(own < 0xE0, 2, np.where(own < 0xF0, 3, 4)))
        wide = np.minimum(wide, room)
        covered = np.zeros(len(node), bool)
        begins, ends, pieces = [], [], []
        live = np.flatnonzero(lead)
        for k in range(1, v.longest + 1):
            s = node[live]
            got = v.table.find(W.mix((total[s + k] - total[s]) * inverse[s]))
            hit = np.flatnonzero(got >= 0)
            covered[live[hit[wide[live[hit]] == k]]] = True
            begins.append(s[hit]), ends.append(s[hit] + k), pieces.append(got[hit])
            live = live[(got != NONE) & (room[live] > k)]
            if not len(live):
                break
        bare = np.flatnonzero(lead & ~covered)
        begins.append(node[bare]), ends.append(node[bare] + wide[bare]), pieces.append(np.full(len(bare), -1, np.int32))
        b, e, p = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(e * 64 + (e - b))
        b, e, p = b[order], e[order], p[order]
        weight = np.where(p >= 0, v.score[p], v.score[BYTE_0] * (e - b))
        depth = np.zeros(n, np.int64)
        depth[node] = offset
        depth[last] = size
        deep = depth[e]
        order = np.argsort(deep.astype(np.uint16) if len(deep) and deep.max() < 1 << 16 else deep, kind="stable")
        alpha = np.full(n, -np.inf)
        alpha[base[:-1]] = 0
        # Edges by depth of their end: the forward pass goes through all words together.
        bd, ed, wd = b[order], e[order], weight[order]
        level = np.searchsorted(deep[order], np.arange(int(deep.max(initial=0)) + 2))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist()):
            if lo == hi:
                continue
            x = alpha[bd[lo:hi]] + wd[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], ed[lo + 1 : hi] != ed[lo : hi - 1])))
            top = np.maximum.reduceat(x, head)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[ed[lo:hi][head]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(head, len(x))))), head))
        with np.errstate(invalid="ignore"):
            log_p = np.nan_to_num(alpha[b] + weight - alpha[e], nan=-np.inf)
        n_nodes, n_edges = len(self.text), len(self.begin)
        more = {
            "base": base[:-1] + n_nodes, "last": last + n_nodes, "text": text, "head": np.cumsum(np.bincount(e, minlength=n)) + n_edges, "begin": b + n_nodes,
            "end": e + n_nodes, "piece": p, "log_p": log_p, "cumulative": np.cumsum(np.exp(log_p)) + self.cumulative[-1], "n_ids": np.where(p >= 0, 1, e - b),
        }
        for k, x in more.items():
            self._columns[k].extend(x)
        self._view()

    def sample(self, words: np.ndarray, noise) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path of each word, in text order, and where each word's edges begin.

        ``noise(places, step)`` gives uniform numbers; paths are drawn from the last node to the first.
        """
        place = np.argsort(words)  # neighbours search close by
        node, floor = self.last[words[place]], self.base[words[place]]
        steps, count = [], np.zeros(len(place) + 1, np.int64)
        while len(place):
            lo, hi = self.head[node], self.head[node + 1] - 1
            below = self.cumulative[lo]
            aim = below + noise(place, len(steps)) * (self.cumulative[hi + 1] - below)
            edge, go = lo, np.flatnonzero(lo < hi)  # nodes have two edges on average
            while len(go := go[self.cumulative[edge[go] + 1] <= aim[go]]):
                edge[go] += 1
                go = go[edge[go] < hi[go]]
            steps.append((place, edge))
            count[place + 1] += 1
            node = self.begin[edge]
            more = node > floor
            place, node, floor = place[more], node[more], floor[more]
        at = np.cumsum(count)
        out, cursor = np.empty(at[-1], np.int64), at[1:].copy()
        for place, edge in steps:
            cursor[place] -= 1
            out[cursor[place]] = edge
        return out, at

    def other(self, word: int, avoid: list[list[int]], draw) -> list[int]:
        """A random path of a word that is none of ``avoid`` (edge lists in text order), drawn exactly.

        Going back from the last node, an edge that still follows avoided paths loses the probability they have left.
        """
        left = [(p[::-1], float(self.log_p[p].sum())) for p in avoid]
        node, path = int(self.last[word]), []
        while node > self.base[word]:
            lo, hi = int(self.head[node]), int(self.head[node + 1])
            mass = np.exp(self.log_p[lo:hi])
            for p, log in left:
                mass[p[len(path)] - lo] -= np.exp(log)
            mass = np.maximum(mass, 0)
            cum = np.cumsum(mass)
            edge = lo + min(int(np.searchsorted(cum, draw() * cum[-1], "right")), hi - lo - 1)
            left = [(p, log - float(self.log_p[edge])) for p, log in left if p[len(path)] == edge]
            path.append(edge)
            node = int(self.begin[edge])
        return path[::-1]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges in text order."""
        out = self.piece[edges]
        odd = np.flatnonzero(out < 0)
        if not len(odd):
            return out
        n = self.n_ids[edges]
        end = np.cumsum(n)
        full = np.repeat(out, n)
        for i in odd.tolist():
            e = edges[i]
            full[end[i] - n[i] : end[i]] = self.text[self.begin[e] : self.end[e]].astype(np.int32) + BYTE_0
        return full


def _uniform(key: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from counters."""
    return ((W.mix(key) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def bounds(bound, before: np.ndarray, gone: np.ndarray, seed, nth: np.ndarray) -> np.ndarray:
    """Perturbed maxima, truncated at the parent's (whose negative is ``bound``), of the rest of the space that branches off at each word.

    ``before`` is the log-probability of the path before the word, ``gone`` the share of the word's paths already taken.
    """
    with np.errstate(divide="ignore"):
        loc = before + np.log(np.maximum(1 - gone, 0))
    # No rest is left where rounding alone keeps the mass above zero.
    loc[gone > 1 - 1e-12] = -np.inf
    noise = np.log(-np.log(_uniform(seed ^ (nth * _C[0] + _C[2]))))
    return -np.logaddexp(bound, noise - loc)


_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def segmentations(v: Vocabulary, texts: list[bytes], seeds: np.ndarray, k: int = SAMPLES, lat: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Up to ``k`` distinct segmentations per text: (ids, log-probability, perturbed score, inclusion probability).

    Fewer where the text has no more.  The inclusion probability is that of being among the ``k`` best given the
    next best perturbed score.  Equal seeds and texts give equal results in any batch.  ``lat`` keeps lattices between
    calls.
    """
    lat = lat or Lattices(v)
    token, of = lat.words(texts)
    seeds = seeds.astype(np.uint64)
    base = lat.log_p
    found: list[list[tuple]] = [[] for _ in texts]
    top = -np.log(-np.log(_uniform(seeds ^ _C[2])))
    heaps: list[list] = [[(-g, 0, None)] for g in top.tolist()]
    for turn in range(k):
        salt = np.uint64((turn + 1) * int(_C[0]) % 2**64)
        salted = seeds + salt
        # The words to draw anew: all of a text at first, then those after the word that changes.
        live = [i for i in range(len(texts)) if heaps[i]]
        nodes = [heapq.heappop(heaps[i]) for i in live]
        begin = np.array([of[i] + (0 if node is None else node[2] + 1) for i, (_, _, node) in zip(live, nodes)], np.int64)
        size = of[np.array(live, np.int64) + 1] - begin
        row = np.repeat(np.array(live, np.int64), size)
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if live else 0) + np.repeat(begin - (ends - size), size)
        seed, nth = salted[row], (place - of[row]).astype(np.uint64)
        edges, at = lat.sample(token[place], lambda p, step: _uniform(seed[p] ^ (nth[p] * _C[1] + np.uint64(step * int(_C[2]) % 2**64))))  # noqa: B023
        if not turn:  # all texts at once
            log_p = base[edges]
            each = np.add.reduceat(log_p, at[:-1]) if len(place) else np.empty(0)
            # Sums of each text by itself, so that its neighbours in the batch change no digit.
            before = np.concatenate([np.empty(0), *(np.cumsum(x) - x for x in np.split(each, of[1:-1]))])
            scores = np.array([x.sum() for x in np.split(log_p, at[of[1:-1]])])
            v_all = bounds(np.repeat(-top, size), before, np.exp(each), seed, nth)
        for i, (bound, _, node), lo_word, n in zip(live, nodes, (ends - size).tolist(), size.tolist()):
            a, b = int(of[i]), int(of[i + 1])
            lo = int(at[lo_word])
            fresh, cut = edges[lo : at[lo_word + n]], at[lo_word : lo_word + n + 1] - lo
            need = k - len(found[i])
            if node is None:
                path, cuts, j, avoid, v_max = fresh, cut, 0, [], v_all[a:b]
                found[i].append((path, float(scores[i]), -bound))
            else:
                old, old_cuts, j, avoid = node
                count = [0]

                def draw() -> float:
                    count[0] += 1
                    return float(_uniform(np.array([(int(seeds[i]) + int(salt) + 7919 * count[0]) & (2**64 - 1)], np.uint64) ^ _C[1])[0])  # noqa: B023

                swap = lat.other(int(token[a + j]), avoid, draw)
                path = np.concatenate((old[: old_cuts[j]], np.array(swap, np.int64), fresh))
                cuts = np.concatenate((old_cuts[: j + 1], old_cuts[j] + len(swap) + cut))
                log_p = base[path]
                found[i].append((path, float(log_p.sum()), -bound))
                if need:
                    each = np.add.reduceat(log_p, cuts[:-1])
                    gone = np.exp(each[j:])
                    gone[0] += sum(np.exp(base[p].sum()) for p in avoid)
                    v_max = bounds(bound, np.cumsum(each[j:]) - each[j:] + each[:j].sum(), gone, salted[i], np.arange(j, b - a, dtype=np.uint64))
            if b > a and need > 0:
                best = np.argpartition(-v_max, need - 1)[:need] if len(v_max) > need else np.arange(len(v_max))
                for m in best.tolist():
                    if np.isfinite(v_max[m]):
                        w = m + j
                        seen = [path[cuts[w] : cuts[w + 1]].tolist()] + (avoid if m == 0 and node is not None else [])
                        heapq.heappush(heaps[i], (-float(v_max[m]), len(found[i]) * 10**9 + w, (path, cuts, w, seen)))
    paths = [p for rows in found for p, _, _ in rows]
    flat = np.concatenate(paths) if paths else np.empty(0, np.int64)
    done = np.concatenate(([0], np.cumsum(lat.n_ids[flat])))
    ends = done[np.cumsum([len(p) for p in paths])] if paths else done[:0]
    split = iter(np.split(lat.ids(flat), ends[:-1]))
    out = []
    for i, rows in enumerate(found):
        kappa = -heaps[i][0][0] if heaps[i] else -np.inf
        out.append([(next(split), lp, g, float(-np.expm1(-np.exp(min(lp - kappa, 50.0))))) for _, lp, g in rows])
    return out


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the model's own segmentation of every row; NULL text has no ids."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = vocabulary(model).model
        for b in batches:
            ids = sp.encode([t.decode("utf-8", "replace") for t in utf8(b.column(1))], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; NULL ids give the empty text."""
    src = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in v.decode([np.array(x or [], np.int64) for x in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, text string")


def sample_segmentations(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = False) -> DataFrame:
    """One row per id and sample: ``sample`` (from 1, by perturbed score), ``n_pieces``, ``log_prob``, ``perturbed``,
    ``inclusion``, ``ids_crc32``, ``decoded_crc32`` and ``round_trip`` (decoding gives the text), with ``ids`` on demand.

    The row's id seeds its samples.  NULL and empty texts have one segmentation, of no piece.  Texts with fewer than
    ``k`` segmentations give all they have; an empty table gives none.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("segmentation")).alias("seed"), F.col(f"`{text_col}`").alias("text"))
    names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32", "decoded_crc32", "round_trip"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        lat = Lattices(v)
        for b in batches:
            keys, seeds = b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
            for first, texts in in_bytes(utf8(b.column(2)), CHUNK):
                out = []
                found = segmentations(v, texts, seeds[first : first + len(texts)], k, lat)
                decoded = iter(v.decode([row[0] for rows in found for row in rows]))
                for i, (text, rows) in enumerate(zip(texts, found), first):
                    for nth, (ids, lp, g, q) in enumerate(rows, 1):
                        back = next(decoded)
                        row = (keys[i], nth, len(ids), lp, g, q, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back), back == text)
                        out.append((*row, ids) if with_ids else row)
                columns = list(zip(*out)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kind = src.schema["id"].dataType.simpleString()
    fields = f"id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return src.mapInArrow(lean(run), fields)
