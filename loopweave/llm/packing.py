"""Operator 3: packing token sequences by best-fit decreasing over a segment tree.

One pass over the scan, without exchange: each task tokenizes its documents, cuts overlong ones into full windows
and packs the rest of its documents a group at a time. A group is GROUP pieces at most, so memory is bounded whatever
a partition holds, and there are enough pieces for best fit to leave little padding; no document waits for another
task. Numbers of sequences are (partition, counter), and repeat when a task is run again on the same split.

Defined results
* null or empty text: the end token alone, in one piece of length 1;
* repeated rows, also of one doc_id: each is a document of its own with its own pieces;
* no doc_id: packed like any other, with a null id; ids may be of any type;
* very long texts are cut into full windows and a rest; ties in length are packed in order of arrival; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CAPACITY = 2048
END = 1
GROUP = 32_768
#: Columns of the result after doc_id, all of them long.
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Entries of a worker's cache of encoded words, some 40 MB, which it keeps for all its tasks.
CACHE = 250_000
#: New parts that are encoded as one text.
JOINED = 250


def vocabulary() -> str:
    """Where the tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, word by word.

    Byte-level BPE never joins across a space that stands between two characters which are not white space, so a text
    may be cut there and each part encoded alone; parts that occur again come from a cache. Parts that are missing
    are encoded a batch of documents at a time.
    """

    #: A space with something other than white space on both sides.
    CUT = re.compile(r" (?!\s)(?<!\s )")

    def __init__(self, path: str | None = None, cache: int = CACHE):
        # a task has one core; the library's threads would wait for work on those of other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("\u0120")  # how byte-level BPE writes a space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The text in parts that can be encoded alone; all but the first stand for a space and the part."""
        return self._parts(text)[0]

    def _parts(self, text: str) -> tuple[list[str], bool]:
        """The parts, and whether none is known to be empty or to have white space at its ends."""
        if any(s in text for s in self.special):
            return [text], True
        plain = text.split(" ")
        # white space at the ends of a part, or an empty part: then CUT has to decide
        return (self.CUT.split(text), False) if "" in plain or list(map(str.strip, plain)) != plain else (plain, True)

    def __call__(self, texts: list[str]) -> list[bytes]:
        firsts, rests, closed, others = [], [], [], []
        for t in texts:
            (first, *rest), whole = self._parts(t)
            firsts.append(first)
            rests.append(rest)
            (closed if whole else others).append(rest)
        heads = self._encode(firsts)
        self._learn(closed, others)
        get = self.known.__getitem__
        return [h + b"".join(map(get, r)) for h, r in zip(heads, rests, strict=True)]

    def learn(self, texts: list[str]) -> None:
        """Takes the parts of some texts into the cache at once."""
        closed, others = [], []
        for t in texts:
            parts, whole = self._parts(t)
            (closed if whole else others).append(parts[1:])
        self._learn(closed, others)

    def counts(self, first: str, rest: list[str]) -> list[int]:
        """Tokens of each part of a text."""
        if not self.known.keys() >= set(rest):
            self._learn([], [rest])
        known = self.known
        return [len(self._encode([first])[0]) // 4, *(len(known[p]) // 4 for p in rest)]

    def _learn(self, closed: list[list[str]], others: list[list[str]]) -> None:
        """Takes parts into the cache; only those of others may be empty or end with white space."""
        known = self.known
        new, odd = set().union(*closed).difference(known), set().union(*others).difference(known)
        if len(known) + len(new) + len(odd) > self.limit:
            known.clear()
            new, odd = set().union(*closed), set().union(*others)
        open_ = [w for w in odd if not w or w[-1].isspace()]
        joined = list(new.union(odd).difference(open_) if odd else new)
        for k in range(0, len(joined), JOINED):
            known.update(self._joined(joined[k : k + JOINED]))
        if open_:
            known.update(zip(open_, self._encode([" " + w for w in open_]), strict=True))

    def _joined(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of parts encoded as one text: a part starts where a token starts with a space, as no part has another."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.where(self.opens[ids])[0]
        if len(starts) != len(parts):
            return zip(parts, self._encode([" " + p for p in parts]), strict=True)
        whole, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
        return zip(parts, [whole[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)], strict=True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; its cache serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree over the capacities 0 to CAPACITY.

    A leaf holds how many open windows have that capacity left; an inner node, how many lie below it. The tightest
    window that takes a piece is the first leaf at or after its length that is not empty: the search climbs from the
    leaf to the first ancestor with a filled right sibling, then descends to its leftmost filled leaf.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        k = left + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least `need` left, taken out: (what it has left, window)."""
        tree, k = self.tree, need + self.size
        if not tree[k]:
            while k & 1 or not tree[k + 1]:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        left = k - self.size
        window = self.windows[left].pop()
        while k:
            tree[k] -= 1
            k >>= 1
        return left, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (length 1 to capacity), and the number of windows."""
    window, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    open_windows = OpenWindows(capacity)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = open_windows.take(need)
        if found:
            left, w = found
        else:
            left, w = capacity, n
            n += 1
        window[k], offset[k] = w, capacity - left
        if left > need:
            open_windows.add(left - need, w)
    return window, offset, n


def _pieces(doc_ids: list, encoded: list[bytes], capacity: int) -> Iterator[tuple]:
    """(doc_id, start, length, crc32, tokens of the document) of every piece of each document with its end token."""
    end = np.array([END], "<u4").tobytes()
    for doc_id, ids in zip(doc_ids, encoded, strict=True):
        ids += end
        total = len(ids) // 4
        for start in range(0, total, capacity):
            part = ids[4 * start : 4 * (start + capacity)]
            yield doc_id, start, len(part) // 4, zlib.crc32(part), total


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    """One row for each piece of the documents (doc_id, text) of df: doc_id, of its own type, and COLUMNS.

    tokenizer: path of the vocabulary file, the same on all machines; None: that of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        counter = TaskContext.get().partitionId() << 36
        waiting: list[tuple] = []
        kind = None

        def packed(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal counter
            doc_ids, *columns = zip(*pieces, strict=True)
            window, offset, n = best_fit_decreasing(np.array(columns[1], np.int64), capacity)
            arrays = [pa.array(doc_ids, kind), *(pa.array(c, pa.int64()) for c in columns), pa.array(window + counter), pa.array(offset)]
            counter += n
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COLUMNS])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for piece in _pieces(part.column(0).to_pylist(), encode(texts), capacity):
                    waiting.append(piece)
                    if len(waiting) >= group:
                        yield from packed(waiting)
                        waiting = []
        if waiting:
            yield from packed(waiting)

    own = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {own}, " + ", ".join(f"{c} bigint" for c in COLUMNS))


def op3_packing(df: DataFrame) -> DataFrame:
    """The contract's result: one row for each piece."""
    return pack(df)
