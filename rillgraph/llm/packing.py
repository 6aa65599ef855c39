"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids go into full windows of `size` while they
last; the rest is placed best-fit: into the open window that it leaves fullest. When none has room, the fullest
window is topped up by a cut and emitted. At the end of the partition the leftovers are merged into full
windows; the last of each partition, shorter than a window, goes to a second round that merges the leftovers of
many partitions in the same way. What then is left is cut at powers of two, which need no padding.

Cases: a null or empty text has the closing id only. Repeated rows are packed each on its own; so are rows with null
ids, whose pieces have null ids too. Extra columns are never read. Empty partitions and tables give no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common

#: Windows that a partition holds open.
OPEN = 16
#: Leftover windows that one task of the second round merges.
MERGE = 64
#: Words of one generation of a worker's memory, and their bytes: it holds two generations at most.
CACHE_WORDS = 400_000
CACHE_BYTES = 24 << 20
#: Bytes of text that are encoded at once, but for longer texts.
PORTION = 2 << 20
#: Words that are looked up at once.
WORDS_AT_ONCE = 50_000
#: A run of lower-case Latin letters (UTF-8), and marks that always end such a run: the tokenizer splits between them.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?#$%&*()|]*)")

PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Generation:
    """Known words and their ids, all in one array."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.flat, self.used, self.bytes = np.zeros(1 << 16, "<u4"), 0, 0
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, words: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        """Add words that are not there yet; ids: theirs one after another."""
        at, n = len(self.index), len(words)
        while at + n > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[at : at + n] = self.used + np.cumsum(count) - count
        self.count[at : at + n] = count
        self.used += len(ids)
        self.bytes += sum(map(len, words)) + 4 * len(ids)
        self.index.update(zip(words, range(at, at + n), strict=True))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words' places, -1 for unknown ones."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places one after another, and how many each has."""
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begin[at] - ends + n, n)], n


class WordCoder:
    """Ids of whole texts by a tokenizer whose pieces never span white space: words are encoded once and remembered.

    Texts are split at ASCII white space only, which the tokenizer drops; whatever else a word holds (other white
    space, special tokens' strings) the tokenizer itself encodes, so the ids are those of the whole text. Words of
    plain letters need none of its normalizers: a copy without them encodes those, and the marks behind them are
    encoded apart. When a generation of words is full, it becomes the older one; words that are met again move to
    the younger, the others are forgotten with the next change.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        split = pre_tokenizers.Split(" ", "removed")
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young, self.old = _Generation(), _Generation()

    def _learn_letters(self, words: list[bytes]) -> None:
        """Runs of plain letters: each ends with the only one of its tokens that ends a word."""
        if words:
            ids = np.array(self.letters.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            self.young.put(words, ids, np.diff(ends, prepend=0))

    def _learn_others(self, words: list[bytes]) -> None:
        """Any words: all in one text, whose tokens' places tell the words."""
        if words:
            texts = [w.decode("utf-8") for w in words]
            ends = np.cumsum([len(t) + 1 for t in texts])
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            place = np.searchsorted(ends, np.array([o[0] for o in got.offsets], np.int64), "right")
            self.young.put(words, np.array(got.ids, "<u4"), np.bincount(place, minlength=len(words)))

    def _learn(self, words: list[bytes]) -> None:
        """Add distinct words that the younger generation does not hold."""
        young, old = self.young, self.old
        if old.index:
            at = old.places(words)
            young.put([w for w, i in zip(words, at.tolist(), strict=True) if i >= 0], *old.ids(at[at >= 0]))
            words = [w for w, i in zip(words, at.tolist(), strict=True) if i < 0]
        matches = [PLAIN.fullmatch(w) for w in words]
        marked = [(w, *m.groups()) for w, m in zip(words, matches, strict=True) if m and m.end(1) < len(w)]
        letters = {w for w, m in zip(words, matches, strict=True) if m and m.end(1) == len(w)} | {s for _, s, _ in marked}
        others = {w for w, m in zip(words, matches, strict=True) if not m} | {t for _, _, t in marked}
        self._learn_letters([w for w in letters if w not in young.index])
        self._learn_others([w for w in others if w not in young.index])
        if marked:
            ids, n = young.ids(young.places([x for _, s, t in marked for x in (s, t)]))
            young.put([w for w, _, _ in marked], ids, n.reshape(-1, 2).sum(1))

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.young.index) > CACHE_WORDS or self.young.bytes > CACHE_BYTES:
            self.young, self.old = _Generation(), self.young
        at = self.young.places(words)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            unknown = [words[i] for i in new]
            self._learn(list(set(unknown)))
            at[new] = self.young.places(unknown)
        return self.young.ids(at)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        words: list[bytes] = []
        ends = []
        for text in texts:
            data = text.encode("utf-8", "replace")
            # the tokenizer lower-cases all but its special tokens
            words += (data if b"<|" in data else data.lower()).split()
            ends.append(len(words))
        made = [self._encoded(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.concatenate([m[0] for m in made]) if made else np.zeros(0, "<u4")
        upto = np.concatenate([[0], np.cumsum(np.concatenate([m[1] for m in made]))]) if made else np.zeros(1, np.int64)
        return np.split(ids, upto[ends[:-1]])

    def trim(self) -> None:
        """Forget all words at a task's end: the worker lives on for other stages, and most words are of one task only."""
        self.young, self.old = _Generation(), _Generation()


_CODERS: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    """The coder of a vocabulary file; one for each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold PORTION bytes or little more, or one text."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
        yield at, end
        at = end


class _Windows:
    """Open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, open_: int, first_id: int):
        self.size, self.open, self.windows, self.next, self.rows = size, open_, [], first_id, []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, None))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [w for w in self.windows if w[0] + len(ids) <= self.size]
            best = max(fits, key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.open:
                self.windows.append(best := [0, []])
            if best is not None:
                best[0] += len(ids)
                best[1].append((doc, start, total, ids))
                if best[0] == self.size:
                    self.windows.remove(best)
                    self._emit(best[1])
                return
            fullest = max(self.windows, key=lambda w: w[0])
            room = self.size - fullest[0]
            self.windows.remove(fullest)
            self._emit([*fullest[1], (doc, start, total, ids[:room])])
            start, ids = start + room, ids[room:]

    def merged(self) -> list:
        """Merge the open windows into full ones; the pieces of the last, short one come back."""
        left = sorted(self.windows, key=lambda w: -w[0])
        held, at = [], 0
        for doc, start, total, ids in (p for w in left for p in w[1]):
            while len(ids):
                n = min(self.size - at, len(ids))
                held.append((doc, start, total, ids[:n]))
                start, ids, at = start + n, ids[n:], at + n
                if at == self.size:
                    self._emit(held)
                    held, at = [], 0
        self.windows = []
        return held

    def finish(self, pieces: list) -> None:
        """Cut the last window at powers of two."""
        n = sum(len(p[3]) for p in pieces)
        room, held = 1 << (n.bit_length() - 1) if n else 0, []
        todo = list(reversed(pieces))
        while todo:
            doc, start, total, ids = todo.pop()
            take = min(room, len(ids))
            held.append((doc, start, total, ids[:take]))
            room, n = room - take, n - take
            if take < len(ids):
                todo.append((doc, start + take, total, ids[take:]))
            if not room:
                self._emit(held)
                held, room = [], 1 << (n.bit_length() - 1) if n else 0

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(cols[:7], PIECE, strict=True)), pa.array(cols[7], pa.binary())], names=[*(n for n, _ in PIECE), "ids"])


def pack(docs: DataFrame, encode: Callable[[], WordCoder], size: int = 2048, open_windows: int = OPEN, end_id: int = 1) -> DataFrame:
    """Pieces of all documents. docs: doc_id long, text string. encode: gives, on the worker, an object
    whose encode_many(texts) returns each text's ids as uint32.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences have `size` ids
    or a power of two. Ids of sequences follow the partitions of docs, so reruns over the same files agree.
    """
    spark = docs.sparkSession
    _common.prepare(spark)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encode(), TaskContext.get().partitionId()
        windows = _Windows(size, open_windows, part << 32)
        for rows in batches:
            for lo, hi in _portions(rows.column(1)):
                coded = coder.encode_many([t or "" for t in rows.column(1).slice(lo, hi - lo).to_pylist()])
                for doc, ids in zip(rows.column(0).slice(lo, hi - lo).to_pylist(), coded, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    windows.add(doc, 0, len(ids), ids)
                    if len(windows.rows) > 20_000:
                        yield windows.drain()
            yield windows.drain()
        left, at = windows.merged(), 0
        for doc, start, total, ids in left:
            windows.rows.append((doc, start, len(ids), None, total, part, at, ids.tobytes()))
            at += 1
        yield windows.drain()
        coder.trim()
        pa.default_memory_pool().release_unused()

    def second_round(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows, first = _Windows(size, open_windows, 0), None
        for doc, start, _, _, total, part, _, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if first is None:
                first = part
                windows.next = (1 << 62) + (part << 24)
            windows.add(doc, start, total, np.frombuffer(ids, "<u4"))
        windows.finish(windows.merged())
        return pa.Table.from_batches([windows.drain()])

    pieces, _ = _common.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_round, _SCHEMA), "pieces")
    full = pieces.filter(F.col("ids").isNull())
    left = pieces.filter(F.col("ids").isNotNull())
    merged = left.groupBy(F.floor(F.col("sequence_id") / MERGE).alias("merge")).applyInArrow(second_round, _SCHEMA)
    return full.unionAll(merged).drop("ids")


def public_words(path: str | None = None) -> Callable[[], WordCoder]:
    """The coder of the public word_bpe_49k vocabulary; path overrides where its file lies."""

    def make() -> WordCoder:
        if path:
            return word_coder(path)
        import public_tokenizers

        return word_coder(public_tokenizers.path("word_bpe_49k.json"))

    return make
