"""Operator 13: byte-pair encoding and decoding with a vocabulary of word ends.

1. White space parts a text into chunks that can be encoded alone: no word of the pre-tokenizer holds white space, and
   normal forms and lower case do not reach across it. Chunks and words that occur again come from a worker's caches.
2. Chunks that are new in a stretch of texts are lower-cased and parted into words by the file's pattern together.
   Chunks with a special token, or with letters beyond Latin, where versions of Unicode differ, go one by one: special
   tokens are taken as they stand, normal form and words are the library's.
3. A short word is one contiguous array of parts between its boundaries, beside one of the ranks of adjacent parts. The
   least rank is found by a scan, the boundary between its two parts is deleted, what follows moves up by one, and the
   ranks at both sides are looked up again, until no pair has a rank. New words of one length take each such step
   together, as rows of a matrix. A word of more than SHORT bytes (no word of a language) has its ranks in a heap over
   linked parts, as scans would cost its square; both give the same parts, as the leftmost of equal ranks goes first.

One pass over the scan, without exchange. Ids are little-endian unsigned 32-bit integers in one binary value.

Defined results
* null or empty text, or one of white space: no ids, and an empty text when decoded;
* strings of special tokens in a text are these tokens, as the library has it;
* decoding joins the tokens as they stand in the vocabulary by one space, as the library does where a file names no
  decoder; an id outside the vocabulary is left out;
* no doc_id: encoded like any other, with a null id; ids may be of any type; repeated rows give repeated results;
* very long texts are encoded whole; ties (equal ranks) go from left to right; extra columns are ignored; an empty table
  gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of more bytes are merged by a heap.
SHORT = 128
#: Characters of the keys in a generation of a worker's caches of chunks and of words, some 15 MB each.
CACHE = 800_000
#: Texts that are encoded together: rows, and characters unless one is longer.
ROWS, STRETCH = 512, 1 << 20
#: No rank: larger than any.
NONE = 1 << 30
#: Below this code point text is in its normal form but for case, and the pattern's classes are the same in all versions.
LATIN_END = "\u0250"
#: What stands between the ids of two chunks: no id, and as ids are below 2**24 not across two either.
GAP = b"\xff" * 4

#: White space of the normalizer's pattern; str.split knows the same and the separators \x1c to \x1f besides.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def vocabulary() -> str:
    """Where the tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself in Latin-1 if it is visible, else one from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


class Kept(dict):
    """A cache of two generations: when the young one is full it becomes the old one, so what is used often stays."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def hold(self, keys: set[str]) -> None:
        """Has all keys in the young generation, which they may exceed."""
        missing = keys.difference(self)
        if not missing:
            return
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
            missing = keys
        self.size += sum(map(len, missing))
        self.update((k, self.old[k]) for k in missing & self.old.keys())
        new = list(missing.difference(self))
        self.update(zip(new, self.make(new), strict=True))


class Bpe:
    """Merges of a vocabulary over words of bytes, and the ids and texts of its tokens."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer

        path = path or vocabulary()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([ids[x + y] for x, y in merges], np.int64)
        keys = np.array([ids[x] << 32 | ids[y] for x, y in merges], np.int64)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.order = np.append(np.argsort(keys), NONE)
        self.keys = np.append(np.sort(keys), np.iinfo(np.int64).max)
        alphabet = byte_alphabet()
        self.inner, self.last = (np.array([ids[c + e] for c in alphabet], np.int64) for e in ("", end))
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        pattern = given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(pattern + "| ").findall
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        library = Tokenizer.from_file(path)
        self.normal, self.other_words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.chunks, self.words = Kept(self._chunks, cache), Kept(lambda words: self.merged([w.encode("utf-8") for w in words]), cache)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of joining the parts left and right; NONE for pairs that are never joined."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.order[at], NONE)

    def scanned(self, words: np.ndarray) -> list[np.ndarray]:
        """The ids of words of one length, given as rows of bytes, by scans for the least rank."""
        parts = np.concatenate([self.inner[words[:, :-1]], self.last[words[:, -1:]]], axis=1)
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        row = np.arange(len(words))
        while len(row):
            k = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), k] if ranks.shape[1] else np.full(len(row), NONE)
            going = least < NONE
            if not going.all():
                for r, x in zip(row[~going].tolist(), parts[~going], strict=True):
                    out[r] = x
                row, parts, ranks, k, least = row[going], parts[going], ranks[going], k[going], least[going]
                if not len(row):
                    break
            mine = np.arange(len(row))
            parts[mine, k] = self.made[least]
            # without the boundary after part k: later parts and ranks move up by one
            columns = np.arange(ranks.shape[1])
            parts = np.take_along_axis(parts, columns + (columns > k[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= k[:, None]), axis=1)
            for x, at in ((mine[k < ranks.shape[1]], 0), (mine[k > 0], -1)):
                c = k[x] + at
                ranks[x, c] = self._rank(parts[x, c], parts[x, c + 1])
        return out

    def queued(self, word: bytes) -> list[int]:
        """The ids of a long word: ranks wait in a heap by rank and place, parts are linked by their starts."""
        n = len(word)
        part = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.made

        def rank(k: int) -> int:
            return self.ranks.get(part[k] << 32 | part[after[k]], NONE) if after[k] < n else NONE

        heap = [(r, k) for k in range(n) if (r := rank(k)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if part[k] < 0 or rank(k) != r:  # one of the parts has been merged since
                continue
            gone = after[k]
            part[k], part[gone] = int(made[r]), -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for x in (k, before[k]):
                if x >= 0 and (r := rank(x)) < NONE:
                    heapq.heappush(heap, (r, x))
        return [x for x in part if x >= 0]

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as bytes."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array(list(map(len, words)), np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n).tolist()
            if n > SHORT:
                ids = [self.queued(words[k]) for k in at]
            elif n:
                ids = self.scanned(np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, n))
            else:
                continue
            for k, x in zip(at, ids, strict=True):
                out[k] = np.asarray(x, "<u4").tobytes()
        return out

    def _alone(self, chunk: str) -> bytes:
        """Ids of a chunk with special tokens or other letters."""
        out: list[bytes] = []
        for piece in self.find_special.split(chunk):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                out += self.merged([bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.other_words(self.normal(piece))])
        return b"".join(out)

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of chunks; of most of them at once, as one text."""
        plain = [c for c in chunks if max(c) < LATIN_END and not self.find_special.search(c)]
        parted = self.find_words(" ".join(plain).lower())
        self.words.hold(set(parted).difference(" "))
        self.words[" "] = GAP
        found = dict(zip(plain, b"".join(map(self.words.__getitem__, parted)).split(GAP), strict=True)) if plain else {}
        return (found[c] if c in found else self._alone(c) for c in chunks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        parted = [[c for c in SPACE.split(t) if c] if any(s in t for s in _SEPARATORS) else t.split() for t in texts]
        self.chunks.hold(set().union(*parted))
        get = self.chunks.__getitem__
        return [b"".join(map(get, p)) for p in parted]


class Tokens:
    """The texts of a vocabulary's tokens: all that decoding needs."""

    def __init__(self, path: str | None = None):
        with open(path or vocabulary(), encoding="utf-8") as f:
            given = json.load(f)
        ids = given["model"]["vocab"] | {t["content"]: t["id"] for t in given["added_tokens"]}
        self.texts = [""] * (1 + max(ids.values()))
        for text, k in ids.items():
            self.texts[k] = text

    def decode(self, ids: bytes) -> str:
        n = len(self.texts)
        return " ".join([self.texts[k] for k in np.frombuffer(ids, "<u4").tolist() if k < n])


@functools.cache
def loaded(kind: type, path: str | None = None) -> Bpe | Tokens:
    """This worker's tables of one kind; their caches serve all tasks that the worker runs."""
    return kind(path)


def encode(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document (doc_id, text).

    tokenizer: path of the vocabulary file, the same on all machines; None: that of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Bpe, tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ends = [0, *np.cumsum(list(map(len, texts))).tolist()]
                k = 0
                while k < len(texts):
                    end = max(bisect.bisect_right(ends, ends[k] + STRETCH) - 1, k + 1)
                    ids = bpe.encode(texts[k:end])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(k, end - k), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
                    )
                    k = end

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """df (doc_id, n_tokens, ids) with `decoded`, the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(Tokens, tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [tokens.decode(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def op13_bpe(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    return decode(encode(df)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
