"""Operator 4: near-duplicate documents by HyperMinHash sketches, banding, estimates and exact verification.

1. A map over the scan makes each text's set of shingles (64-bit hashes), its digest, and its sketch: BUCKETS
   registers with the leading zeros and MANTISSA further bits of the smallest hash of each bucket.
2. Texts with one digest have one set: they form a class, a node from here on.
3. Bands of ROWS registers (an empty register borrows from a bucket picked by a fixed rule) put nodes into buckets.
   Nodes of a bucket are compared with one pivot, which differs from band to band.
4. Pairs whose collision-corrected estimate may reach the threshold are verified on their full sets: each node's best
   pair first, then those whose ends are still in different components, as a member of a large group of near copies has
   a pair in each of its bands, of which one link is enough. Pairs meet their sets in cells of many pairs.
5. Where the members of a bucket are then still in several components, the pairs across components are estimated by
   finer sketches and verified: the members outside the bucket's main component meet all members, block by block, so
   a row of the main component moves once, however large it is. Pairs inside a component need no decision.
6. The same nodes may meet in many buckets of one main component: where comparing all of its outsiders with each other
   and with its members once is less work than bucket by bucket, they do so, up to WHOLE blocks of outsiders. A pair
   that shares any band of those is then compared, so none is lost.
7. In every other bucket, however crowded, all members outside its main component meet all members in blocks, so no pair
   of a bucket is dropped. Blocks grow with the bucket, so a row moves for about SPREAD blocks up to GROWTH * SPREAD * BLOCK
   members. The comparisons of a crowded bucket (very many texts that share a passage) grow with the square of its members,
   dealt over its tiles. `depth` can ask for less: members of crowded buckets are then dealt by that many further bands, and
   a pair whose only bands in common are crowded is missed if these are no more than `depth`.
8. A group of n texts that are not joined yet has n**2 / 2 candidates. So each tile first gives a spanning forest of its
   candidates, the likeliest first, a pair for each node at most; when these are verified and have joined components,
   the tiles are gone through again for all candidates that are still across components.

Tables that are read again are written compressed to the shared folder, without bands, which follow from the registers,
and go as soon as nothing reads them any more.

Defined results
* null or empty text, or one without words: n_shingles 0, linked with nothing, kept;
* repeated rows, also of one doc_id, are copies of each other: each has its row, and a doc_id that is its
  component's smallest is kept in all its rows;
* null doc_id: takes part; component_id is the smallest id that is not null, kept is null;
* the pipeline stage lets exactly one row of each component pass, that of the smallest (doc_id, digest of the text),
  null ids last, and of rows equal in both any one; rows without words all pass;
* very long texts are sketched whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, settle
from .components import components, extended

SHINGLE = 5
PERCENT = 75
#: Registers of a sketch (a power of two), further bits in a register, registers of a band.
BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: Standard deviations that an estimate may lie below the threshold before a pair is dropped unverified.
MARGIN = 4.0
#: Registers of the finer sketches by which pairs across components are told apart before verification.
FINE = 512
#: Members of a bucket that are compared as a block; words in a worker's cache (some 15 MB).
BLOCK, CACHE = 512, 100_000
#: Pairs whose full sets meet in one task, on average, and bytes of these sets.
CELL_PAIRS, CELL_BYTES = 1024, 1 << 25
#: Blocks of a bucket that a row moves for, and how many times BLOCK a block grows to keep to it.
SPREAD, GROWTH = 24, 8
#: Further bands by which the members of crowded buckets are dealt; after that all their pairs are compared. 0: at once.
DEPTH = 0
#: Blocks of outsiders of one main component that are compared all with all.
WHOLE = 32

_U = np.uint64
_MULTIPLY = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; bytes.lower and bytes.split know ASCII alone, as the words do."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = n - SHINGLE + 1
    s = h[:m] * _MULTIPLY[0]
    for k in range(1, SHINGLE):
        s = (s ^ (s >> _U(29))) * _MULTIPLY[k] + h[k : m + k]
    return np.unique(_mixed(s))


def registers(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The sketch: for each bucket 1 + (leading zeros, mantissa) of its smallest hash, 0 if it is empty."""
    out = np.zeros(buckets, np.uint16)
    if not len(hashes):
        return out
    bits = 64 - buckets.bit_length() + 1
    numbers = np.arange(buckets, dtype=np.uint64)
    at = np.searchsorted(hashes, numbers << _U(bits))
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((first >> _U(bits)) == numbers)
    rest = first[full] & _U((1 << bits) - 1)
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = np.maximum(bits - length, 0)
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & _U((1 << MANTISSA) - 1)
    out[full] = 1 + (zeros << MANTISSA) + mantissa.astype(np.int64)
    return out


#: For each bucket the order in which it asks others when it is empty; the same everywhere.
_ASK = np.argsort(_mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + _U(1)).reshape(BUCKETS, BUCKETS), axis=1)


def bands(sketch: np.ndarray) -> list[int]:
    """The bands' keys: ROWS registers of 16 bits each, empty ones filled from the first full bucket they ask."""
    full = sketch > 0
    if not full.all():
        asked = full[_ASK]
        sketch = np.where(full, sketch, sketch[_ASK[np.arange(BUCKETS), asked.argmax(axis=1)]])
    return sketch.view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketches (registers in the last axis) of sets of n and m, and registers they rest on.

    Expected chance collisions are those of HyperMinHash for sets much larger than the number of buckets; for small
    sets they are fewer, so the estimate is then low by less than 2**-MANTISSA.
    """
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * a.shape[-1] * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same - np.where(same < used, chance, 0)) / np.maximum(used, 1), used


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether pairs may be linked: by their sizes, and by the estimate less its margin.

    The registers in use are a sample without replacement of the union, so the deviation shrinks as they near its size.
    """
    j, used = estimate(a, b, n, m)
    t = PERCENT / 100
    by_size = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    union = (n + m) / (1 + t)
    part = np.clip(1 - (used - 1) / np.maximum(union - 1, 1), 0, 1)
    return by_size & (j >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1) * part) - 1 / np.maximum(used, 1))


def sketch(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """(doc_id, digest, n_shingles, node, regs) of each document (doc_id, text); node is null without words.

    digest: a text made of the document's columns that goes along, null if it isn't given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, node, regs = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    r = registers(s)
                    n.append(len(s))
                    node.append(hashlib.md5(s.tobytes()).hexdigest() if len(s) else None)
                    regs.append(r.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.string()), pa.array(regs, pa.binary())],
                    names=["doc_id", "digest", "n_shingles", "node", "regs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.lit(None).cast("string") if digest is None else digest
    return docs.select("doc_id", given.alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest string, n_shingles bigint, node string, regs binary")


def banded(regs: Column) -> Column:
    """The keys of all bands of registers: array of bigint."""

    def run(values: pa.Array) -> pa.Array:
        keys = [bands(np.frombuffer(r, np.uint16)) for r in values.to_pylist()]
        return pa.array(keys, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(regs)


def _texts(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, node) of the documents of the nodes wanted (doc_id, node).

    The ids are broadcast if they are measured to be small; else texts and ids meet in a shuffled join.
    """
    side = few(wanted.withColumnRenamed("doc_id", "_id"), scratch)
    return docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node")


def full_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the nodes wanted (doc_id, node), from whole texts; a node comes once from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for node, sets in _shingled(batches):
            new = {e: s for e, s in zip(node, sets, strict=True) if e not in seen}
            seen.update(new)
            node, sets = list(new), list(new.values())
            values = [pa.array(s.view(np.int64), pa.int64()) for s in sets]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.concat_arrays(values) if values else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), lists], names=["node", "shingles"])

    return _texts(docs, wanted, scratch).mapInArrow(run, "node string, shingles array<bigint>")


def fine_sketches(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n_shingles, regs) of the nodes wanted, with sketches of FINE registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, sets in _shingled(batches):
            regs = [registers(s, FINE).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(list(map(len, sets)), pa.int64()), pa.array(regs, pa.binary())], names=["node", "n_shingles", "regs"])

    return _texts(docs, wanted, scratch).mapInArrow(run, "node string, n_shingles bigint, regs binary").dropDuplicates(["node"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Nodes and shingles of (text, node), a few hundred at a time; other rows of a node's doc_id are passed over."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            pairs = [(e, shingles(t)) for t, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            pairs = [(e, s) for e, s in pairs if hashlib.md5(s.tobytes()).hexdigest() == e]
            yield [e for e, _ in pairs], [s for _, s in pairs]


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked, with their estimate j, by the sketches of nodes."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    with_sketches = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (2, 3))
            n, m = (batch.column(c).to_numpy() for c in (4, 5))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate(a, b, n, m)[0])], names=["a", "b", "j"])
            yield out.filter(pa.array(possible(a, b, n, m)))

    return with_sketches.mapInArrow(run, "a string, b string, j double")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets, settled; pairs must be settled.

    Pairs are dealt into cells by the hashes of both ends, about CELL_PAIRS or CELL_BYTES of sets in each; a set moves
    once for each cell in which it has a pair, not for each pair.
    """
    scratch = Scratch(docs.sparkSession)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.settle(nodes.select("doc_id", "node", "n_shingles").join(needed, "node"))
    n_pairs, mean = pairs.count(), wanted.agg(F.avg("n_shingles")).first()[0] or 0
    parts = max(1, int(np.ceil(np.sqrt(max(n_pairs / CELL_PAIRS, n_pairs * 16 * mean / CELL_BYTES)))))
    side = lambda x: F.pmod(F.xxhash64(x), F.lit(parts))
    celled = pairs.select((side("a") * parts + side("b")).alias("cell"), "a", "b")
    # a row for each set and cell, at most 2 * parts cells a set; a long list is no value of one row
    places = few(celled.select("cell", F.col("a").alias("_n")).union(celled.select("cell", "b")).distinct(), scratch)
    sets = full_sets(docs, wanted.select("doc_id", "node"), scratch).join(places, F.col("node") == F.col("_n")).select("cell", "node", "shingles")

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        lists = sets.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        of = {e: flat[ends[k] : ends[k + 1]] for k, e in enumerate(sets.column("node").to_pylist())}
        good = []
        for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            common = len(np.intersect1d(of[x], of[y], assume_unique=True))
            good.append(100 * common >= PERCENT * (len(of[x]) + len(of[y]) - common))
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = settle(celled.groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(verify, "a string, b string"))
    scratch.drop()
    return out


def _best(pairs: DataFrame) -> DataFrame:
    """The best of the pairs (a, b, j) of each node, at either end."""
    ends = pairs.select(F.col("a").alias("node"), F.struct("j", "a", "b").alias("p")).unionByName(pairs.select(F.col("b").alias("node"), F.struct("j", "a", "b").alias("p")))
    return ends.groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def _joining(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, j) whose ends are in different components."""
    side = lambda x: found.select(F.col("node").alias(f"_n{x}"), F.col("root").alias(f"_r{x}"))
    rooted = pairs.join(side("a"), F.col("a") == F.col("_na"), "left").join(side("b"), F.col("b") == F.col("_nb"), "left")
    return rooted.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).groupBy("a", "b").agg(F.max("j").alias("j"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def _spanning(n: int, root: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of n rows are in a spanning forest over their roots that prefers large j."""
    _, up = np.unique(root, return_inverse=True)
    up, first = up.tolist(), {}
    up = [first.setdefault(r, k) for k, r in enumerate(up)]  # rows of one root are joined to begin with

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept, left = [], len(first) - 1
    for p in np.argsort(-j, kind="stable").tolist():
        x, y = find(int(a[p])), find(int(b[p]))
        if x != y:
            up[y] = x
            kept.append(p)
            left -= 1
            if not left:
                break
    return np.array(sorted(kept), np.int64)


def _across(rows: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (x, y) of one tile and different roots that may be linked, with their estimate j; spanning: only a forest of them.

    rows: (tile, path, outside, side, node, root, bands, n_shingles, regs) with all rows of a tile together and in
    order. Rows of side 0, all outside the main component, meet those of side 1. A pair comes from the bucket whose
    path holds the first bands that it shares, so however many buckets hold it, it is emitted once; in a tile without a
    path all pairs are compared.
    """

    def compare(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node, root, outside = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "root", "outside"))
        n = tile.column("n_shingles").to_numpy()
        regs = np.frombuffer(b"".join(tile.column("regs").to_pylist()), np.uint16).reshape(-1, FINE)
        path = tile.column("path")[0].as_py()
        earlier = [k for k in range(path[-1] if path else 0) if k not in path]
        keys = tile.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)[:, earlier]
        first, second = np.where(side == 0)[0], np.where(side == 1)[0]
        out: tuple[list, list, list] = ([], [], [])  # rows of the tile
        for k in first:
            other = second[root[second] != root[k]]
            other = other[~(outside[other] & (node[other] < node[k]))]  # two rows outside meet twice
            other = other[~(keys[other] == keys[k]).any(axis=1)]
            if len(other):
                hit = other[possible(regs[k][None], regs[other], n[k], n[other])]
                out[0].append(np.full(len(hit), k))
                out[1].append(hit)
                out[2].append(estimate(regs[k][None], regs[hit], n[k], n[hit])[0])
        if out[0]:
            a, b, j = map(np.concatenate, out)
            if spanning:
                kept = _spanning(len(node), root, a, b, j)
                a, b, j = a[kept], b[kept], j[kept]
            yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.string()), pa.array(node[b], pa.string()), pa.array(j)], names=["x", "y", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            tiles = table.column("tile").to_numpy()
            if not len(tiles):
                continue
            starts = [0, *(np.where(tiles[1:] != tiles[:-1])[0] + 1).tolist()]
            for s, e in zip(starts, starts[1:], strict=False):
                yield from compare(table.slice(s, e - s))
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from compare(held)

    return rows.mapInArrow(run, "x string, y string, j double")


def _split(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (bucket, path, node, root) of buckets with several roots, with the bucket's size, main root and number outside it."""
    by_root = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    split = few(split.select(F.col("bucket").alias("_b"), "size", F.col("top.root").alias("main"), (F.col("size") - F.col("top.n")).alias("n_outside")), scratch)
    return scratch.settle(rows.join(split, F.col("bucket") == F.col("_b")).drop("_b"))


def _tiles(rows: DataFrame, block: int) -> DataFrame:
    """(tile, path, outside, side, node, root): each row outside the main root once for each block of its bucket, as
    side 0, and every row once for each part of those outside, as side 1; there is one part unless they are many."""
    grown = F.greatest(F.lit(block), F.least(F.lit(GROWTH * block), F.ceil(F.col("size") / SPREAD)))
    blocks, parts = (F.ceil(F.col(c) / grown).cast("int") for c in ("size", "n_outside"))
    outside = F.col("root") != F.col("main")
    own_block, own_part = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")
    as_first = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(own_part.alias("part"), b.alias("block"), F.lit(0).alias("side")))
    as_second = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(p.alias("part"), own_block.alias("block"), F.lit(1).alias("side")))
    places = F.when(outside, F.concat(as_first, as_second)).otherwise(as_second)
    placed = rows.select("bucket", "path", outside.alias("outside"), "node", "root", F.explode(places).alias("at"))
    return placed.select(F.concat_ws("/", "bucket", "at.part", "at.block").alias("tile"), "path", "outside", "at.side", "node", "root")


def _gathered(rows: DataFrame, block: int, whole: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows of `_split` left to their buckets, rows of main components whose outsiders and members meet once).

    Of the latter there is a row for each distinct node, in a bucket of the main component's name, with an empty path.
    """
    outside = F.col("root") != F.col("main")
    nodes = rows.groupBy("main", "node", "root").agg(F.sum(F.when(outside, F.col("size")).otherwise(0)).alias("work"))
    stats = nodes.groupBy("main").agg(F.count("*").alias("all"), F.sum(outside.cast("long")).alias("o"), F.sum("work").alias("work"))
    better = few(stats.filter((F.col("o") * F.col("all") <= F.col("work")) & (F.col("o") <= whole * block)).select(F.col("main").alias("_m"), "all", "o"), scratch)
    met = nodes.join(better, F.col("main") == F.col("_m"))
    met = met.select(F.concat(F.lit("of/"), "main").alias("bucket"), F.array().cast("array<int>").alias("path"), "node", "root", F.col("all").alias("size"), "main", F.col("o").alias("n_outside"))
    return rows.join(better.select("_m"), F.col("main") == F.col("_m"), "left_anti"), met


def _remaining(docs: DataFrame, members: DataFrame, nodes: DataFrame, found: DataFrame, block: int, depth: int, whole: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Tiles of the members (band, key, node) of buckets that span several components, and the fine sketches of their nodes."""
    rooted = members.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    level = rooted.select(F.concat_ws("/", "band", "key").alias("bucket"), F.array("band").alias("path"), "node", F.coalesce("root", "node").alias("root"))
    keys = nodes.select(F.col("node").alias("_n"), "regs")
    tiles = []
    for deep in range(depth + 1):
        rows = _split(level, scratch)
        if not deep:
            rows, met = _gathered(rows, block, whole, scratch)
            tiles.append(_tiles(met, block))
        crowded = (F.col("n_outside") > block) & F.lit(deep < depth)
        tiles.append(_tiles(rows.filter(~crowded), block))
        rows = rows.filter(crowded)
        if deep == depth or not rows.limit(1).count():
            break
        last = F.element_at("path", -1)
        dealt = rows.filter(last < BANDS - 1).join(keys, F.col("node") == F.col("_n")).withColumn("bands", banded(F.col("regs")))
        dealt = dealt.withColumn("next", F.explode(F.sequence(last + 1, F.lit(BANDS - 1))))
        level = dealt.select(F.concat_ws("/", "bucket", "next", F.get("bands", F.col("next"))).alias("bucket"), F.array_append("path", F.col("next")).alias("path"), "node", "root")
    rows = scratch.settle(reduce(DataFrame.unionByName, tiles))
    fine = fine_sketches(docs, nodes.select("doc_id", "node").join(rows.select("node").distinct(), "node"), scratch)
    coarse = nodes.select(F.col("node").alias("_n"), F.col("regs").alias("coarse"))
    brought = scratch.settle(fine.join(coarse, F.col("node") == F.col("_n")).select("_n", "n_shingles", "regs", "coarse"))
    return rows, brought


def _candidates(rows: DataFrame, brought: DataFrame, found: DataFrame, spanning: bool, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, j), settled, of the tiles' rows that may be linked and are in different components of found."""
    rooted = rows.drop("root").join(found.withColumnRenamed("node", "_f"), F.col("node") == F.col("_f"), "left").drop("_f")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    dealt = rooted.join(brought.withColumn("bands", banded(F.col("coarse"))).drop("coarse"), F.col("node") == F.col("_n")).drop("_n")
    pairs = _across(dealt.repartition("tile").sortWithinPartitions("tile"), spanning).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "j")
    return scratch.settle(pairs.groupBy("a", "b").agg(F.max("j").alias("j")))


def classes(docs: DataFrame, digest: Column | None = None, block: int = BLOCK, depth: int = DEPTH, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, node, root, component_id) of each document, and links (a, b) between nodes that join each component.

    root is the same for all documents of a component and null for those without words.
    """
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.settle(sketch(docs, digest))
    rows = sketched.select("doc_id", "digest", "n_shingles", "node")
    nodes = scratch.settle(
        sketched.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    )
    in_bands = nodes.select("node", F.posexplode(banded(F.col("regs"))).alias("band", "key"))
    pivots = in_bands.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node")).alias("p"), F.count("*").alias("size"))
    pivots = few(pivots.filter("size > 1").select(F.col("band").alias("_b"), F.col("key").alias("_k"), F.col("p.node").alias("pivot"), "size"), scratch)
    members = in_bands.join(pivots, (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k"))).filter("node <> pivot").select("band", "key", "node", "pivot", "size")
    members = scratch.settle(members)
    likely = scratch.settle(_estimated(_ordered(members.select(F.col("node").alias("x"), F.col("pivot").alias("y"))), nodes))
    links = _linked(docs, nodes, scratch.settle(_best(likely)))
    found = components(links)
    tiles, sketches = _remaining(docs, members.filter("size > 2"), nodes, found, block, depth, whole, scratch)
    for first in (True, False):
        rest = _candidates(tiles, sketches, found, first, scratch).select("a", "b")
        rest = scratch.settle(rest.unionByName(_joining(likely, found).select("a", "b")).distinct())
        if not rest.limit(1).count():
            continue
        added = _linked(docs, nodes, rest)
        links = links.unionByName(added)
        found = settle(extended(found, added))
    least = found.join(nodes.select(F.col("node").alias("_n"), F.col("doc_id").alias("_d")), F.col("node") == F.col("_n"))
    # a row for each component with several nodes
    smallest = few(least.groupBy("root").agg(F.min("_d").alias("component_id")).withColumnRenamed("root", "_r"), scratch)
    named = nodes.select("node", "doc_id").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").join(smallest, F.col("root") == F.col("_r"), "left")
    named = named.select(F.col("node").alias("_n"), F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = settle(rows.join(named, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("component_id", F.coalesce("component_id", "doc_id")))
    scratch.drop()
    return placed, links


def op4_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    placed, _ = classes(docs)
    return placed.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each group of near duplicates stays; see the defined results."""
    digest = F.md5(F.col("text").cast("binary"))
    placed = classes(docs, digest)[0].filter("node is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    rows = placed.groupBy("root", rank.alias("rank")).agg(F.count("*").alias("n"))
    first = few(rows.groupBy(F.col("root").alias("_r")).agg(F.min("rank").alias("first"), F.sum("n").alias("rows")).filter("rows > 1"))
    several = settle(rows.join(first, F.col("root") == F.col("_r")))
    wins = F.col("rank") == F.col("first")
    key = [F.col("rank.doc_id").alias("_id"), F.col("rank.digest").alias("_digest")]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    left = docs.join(few(several.filter(~wins).select(*key)), same, "left_anti")
    repeated = several.filter(wins & (F.col("n") > 1))
    if not repeated.limit(1).count():
        return left
    twice = few(repeated.select(*key))
    once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(once)
