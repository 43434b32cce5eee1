"""Order-preserving packing of tokenized documents into fixed windows by dynamic programming.

Documents keep their order; a window is a contiguous stretch of the token stream.  Cuts fall at document ends,
at sentence ends, or, where a sentence is long, at marks inside it.  The program minimises padding plus a penalty
for each cut inside a document or a sentence.  The cost of a window depends on its two ends separately, so the best
start for each end is the front of a monotone queue and a block of tokens takes linear time.  Each input partition
packs its own stream: no shuffle, and at most one open window per partition.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as W
from lodestone.llm.common import in_bytes, lean, utf8

WINDOW = 2048
END_ID = 1
SENTENCE_CUT, INNER_CUT = 4, 16
MARK_GAP = 48
CHUNK = 1 << 20
#: A worker forgets its words and pre-tokens when it knows more than this; what one block holds always fits.
WORDS_MAX, PIECES_MAX = 1_000_000, 400_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids by a tokenizer whose pre-tokens never cross ASCII white space, for many texts at once.

    Words are found and hashed by numpy; a word seen before costs a probe of a hash table, which grows with the words
    of a block.  New words of letters below U+0130, where lower case goes letter by letter, composition changes nothing
    and the classes of letters and digits are settled, are split by the tokenizer's pattern here; all others by the
    tokenizer's own normaliser and splitter, once.  Only new pre-tokens reach its model.  Texts holding a special token's
    string go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab(False).items(), key=lambda x: x[1])])
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces_of = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.n, self.table = 0, W.Table()
        self.flat, self.at = np.empty(1 << 20, np.uint32), np.zeros(1, np.int64)

    def own_ids(self, word: str) -> list[int]:
        """The ids of one word by the tokenizer's own normaliser, splitter and model."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
        return [t.id for piece, _ in split for t in self.tokenizer.model.tokenize(piece)]

    def plain_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of words in lower case without a letter from U+0130 on."""
        split = [self.pieces_of(w) for w in words]
        if len(self.pieces) > PIECES_MAX:
            self.pieces.clear()
        if new := [p for p in dict.fromkeys(p for s in split for p in s) if p not in self.pieces]:
            for i in range(0, len(new), 256):
                part = new[i : i + 256]
                ids = self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part):
                    self.pieces.update((p, ids[lo:hi]) for p, lo, hi in zip(part, [0, *ends.tolist()], ends.tolist()))
                else:
                    self.pieces.update((p, self.own_ids(p)) for p in part)
        known = self.pieces
        return [known[s[0]] if len(s) == 1 else [i for p in s for i in known[p]] for s in split]

    def learn(self, words: list[bytes], keys: np.ndarray) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isascii() or max(t) < "\u0130"]
        coded: list[list[int]] = [[]] * len(texts)
        if plain:
            lower = "\n".join([texts[i] for i in plain]).lower().split("\n")
            for i, ids in zip(plain, self.plain_ids(lower)):
                coded[i] = ids
        if len(plain) < len(texts):
            for i in sorted(set(range(len(texts))) - set(plain)):
                coded[i] = self.own_ids(texts[i])
        n, m = self.n, self.n + len(words)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.at = np.concatenate((self.at, self.at[n] + np.cumsum(size)))
        if self.at[m] > len(self.flat):
            before, self.flat = self.flat, np.empty(2 * int(self.at[m]), np.uint32)
            self.flat[: self.at[n]] = before[: self.at[n]]
        self.flat[self.at[n] : self.at[m]] = np.fromiter((i for x in coded for i in x), np.uint32, int(size.sum()))
        self.n = m
        self.table.put(keys, np.arange(n, m))

    def encode(self, texts: list[bytes], end_id: int) -> Stream:
        """The ids of texts without special strings, each followed by ``end_id``, as one stream."""
        buf, offset = W.joined(texts)
        start, end = W.spans(buf)
        keys = W.hashes(buf, start, end)
        if self.n > WORDS_MAX:
            self.reset()
        word = self.table.find(keys)
        if (word < 0).any():
            fresh, first = np.unique(keys[word < 0], return_index=True)
            at = np.flatnonzero(word < 0)[first]
            raw = buf.tobytes()
            for i in range(0, len(fresh), 1 << 18):
                part = at[i : i + (1 << 18)]
                self.learn([raw[a:b] for a, b in zip(start[part].tolist(), end[part].tolist())], fresh[i : i + (1 << 18)])
            word = self.table.find(keys)
        size = self.at[word + 1] - self.at[word]
        doc = np.searchsorted(offset, start, "right") - 1
        before = np.searchsorted(start, offset[1:])  # words up to the end of each document
        done = np.zeros(len(word) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        doc_end = done[before] + np.arange(1, len(texts) + 1)
        ids = np.full(int(doc_end[-1]), end_id, np.uint32)
        place = np.ones(len(ids), bool)
        place[doc_end - 1] = False
        ids[place] = self.flat[np.repeat(self.at[word] - done[:-1], size) + np.arange(done[-1])]
        stop = STOPS[buf[end - 1]]
        return Stream(ids, doc_end, (done[1:] + doc)[stop])

    def encode_long(self, text: bytes, end_id: int) -> Stream:
        """``encode`` of one text in blocks cut at ASCII white space, so that its arrays stay small."""
        ids, stops, at, done = [], [], 0, 0
        while at < len(text):
            gap = _BLANK.search(text, at + CHUNK)
            to = gap.start() if gap else len(text)
            part = self.encode([text[at:to]], end_id)
            ids.append(part.ids[:-1])
            stops.append(part.sentence_end + done)
            done += len(part.ids) - 1
            at = to
        return Stream(np.concatenate([*ids, np.array([end_id], np.uint32)]), np.array([done + 1]), np.concatenate(stops))

    def encode_whole(self, text: bytes, end_id: int) -> Stream:
        """The ids of one text by the tokenizer itself."""
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return Stream(np.array([*ids, end_id], np.uint32), np.array([len(ids) + 1]), np.empty(0, np.int64))

    def streams(self, texts: list[bytes], end_id: int) -> Iterator[tuple[int, int, Stream]]:
        """(first, last, stream) for runs of consecutive texts of about ``CHUNK`` bytes."""
        for first, run in in_bytes(texts, CHUNK):
            odd = [i for i, t in enumerate(run) if b"<" in t and any(s in t for s in self.special)]
            cut = 0
            for i in [*odd, len(run)]:
                if cut < i:
                    long = i - cut == 1 and len(run[cut]) > 2 * CHUNK
                    yield first + cut, first + i, self.encode_long(run[cut], end_id) if long else self.encode(run[cut:i], end_id)
                if i < len(run):
                    yield first + i, first + i + 1, self.encode_whole(run[i], end_id)
                cut = i + 1


class Stream:
    """Ids of consecutive documents, the ends of documents, and the cuts offered with their penalties."""

    def __init__(self, ids: np.ndarray, doc_end: np.ndarray, sentence_end: np.ndarray) -> None:
        self.ids, self.doc_end, self.sentence_end = ids, doc_end, sentence_end
        stops = np.unique(np.concatenate((sentence_end[sentence_end > 0], doc_end)))
        gap = np.diff(stops, prepend=0)
        wide = np.flatnonzero(gap > MARK_GAP)
        step = MARK_GAP // 2
        n = gap[wide] // step
        marks = np.repeat(stops[wide] - gap[wide], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        self.at = np.unique(np.concatenate((stops, marks)))
        self.cost = np.full(len(self.at), INNER_CUT)
        self.cost[np.searchsorted(self.at, stops)] = SENTENCE_CUT
        self.cost[np.searchsorted(self.at, doc_end)] = 0


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows over a stream of ``at[-1]`` tokens that minimise padding plus penalties.

    ``at`` are the offered cuts, rising, with gaps of at most ``window``; the last one ends the stream.
    """
    ends, costs = [0, *at.tolist()], [0, *cost.tolist()]
    best, back = [0] * len(ends), [0] * len(ends)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])
    for j in range(1, len(ends)):
        x = ends[j]
        while queue[0][1] < x - window:
            queue.popleft()
        value, _, i = queue[0]
        best[j] = b = value + window - x + costs[j]
        back[j] = i
        key = b + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, x, j))
    cuts, j = [], len(ends) - 1
    while j:
        cuts.append(ends[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Cuts the stream of one partition into sequences; the window that is still open stays in memory."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.doc_ids: list = []
        self.total = self.start = self.doc_end = self.at = self.cost = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def add(self, doc_ids: list, more: Stream) -> None:
        """Append documents to the stream."""
        n = len(self.ids)
        size = np.diff(more.doc_end, prepend=0)
        self.doc_ids = self.doc_ids + doc_ids
        self.total = np.concatenate((self.total, size))
        self.start = np.concatenate((self.start, np.zeros(len(size), np.int64)))
        self.doc_end = np.concatenate((self.doc_end, more.doc_end + n))
        self.ids = np.concatenate((self.ids, more.ids))
        self.at = np.concatenate((self.at, more.at + n))
        self.cost = np.concatenate((self.cost, more.cost))

    def take(self, last: bool = False) -> list[tuple]:
        """The pieces of all closed windows: (id, start, length, crc, total, sequence, offset, ids)."""
        if not len(self.ids):
            return []
        cuts = np.array(best_cuts(self.at, self.cost, self.window))
        cuts = cuts if last else cuts[:-1]
        if not len(cuts):
            return []
        done = int(cuts[-1])
        hi = np.unique(np.concatenate((cuts, self.doc_end[self.doc_end < done])))
        lo = np.concatenate(([0], hi[:-1]))
        doc = np.searchsorted(self.doc_end, lo, "right")
        begins = np.concatenate(([0], self.doc_end[:-1]))
        start = self.start[doc] + lo - begins[doc]
        nth = np.searchsorted(cuts, lo, "right")
        offset = lo - np.concatenate(([0], cuts))[nth]
        raw = self.ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist())]
        out = list(zip([self.doc_ids[i] for i in doc], start.tolist(), (hi - lo).tolist(), crc, self.total[doc].tolist(), (nth + self.sequence).tolist(), offset.tolist(), lo.tolist(), hi.tolist()))
        out = [(*row[:7], self.ids[row[7] : row[8]]) for row in out]
        self.sequence += len(cuts)
        k = int(np.searchsorted(self.doc_end, done, "right"))
        if k < len(self.doc_ids):
            self.start[k] += max(0, done - int(begins[k]))
        live = self.at > done
        self.doc_ids, self.total, self.start, self.doc_end = self.doc_ids[k:], self.total[k:], self.start[k:].copy(), self.doc_end[k:] - done
        self.ids, self.at, self.cost = self.ids[done:], self.at[live] - done, self.cost[live]
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where each stretch of each document's ids lies in the sequences.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (unique over
    partitions), ``offset``, and with ``with_ids`` the ids themselves.  Defined cases: NULL or empty text is the
    end id alone; rows with NULL or repeated ids are packed like others; an empty table gives no piece.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        types = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            types = types or [b.schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            doc_ids = b.column(0).to_pylist()
            for first, last, stream in enc.streams(utf8(b.column(1)), end_id):
                packer.add(doc_ids[first:last], stream)
                yield batch(packer.take())
        if types:
            yield batch(packer.take(last=True))

    fields = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + (", ids array<int>" if with_ids else "")
    return src.mapInArrow(lean(run), fields).withColumnRenamed("doc_id", id_col)
