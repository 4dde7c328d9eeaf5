"""Operator 7: near-duplicate embeddings by int8 tile products with rigorous error bounds.

1. Equal vectors form a class, a node from here on, so a very common vector is compared once.
2. Pivots far apart are picked from a bounded sample of the nodes, farthest first; a node belongs to the cell of its
   nearest pivot, and a cell has the least and largest angle of its nodes to the pivot. As angles obey the triangle
   inequality, cells whose pivots are further apart than both reaches and the threshold's angle hold no link. Cells are
   put into groups, near ones together: small cells share a block, a large cell is dealt into blocks of about BLOCK.
   What the driver knows is a row for each pivot and each pair of pivots, however many nodes there are; only tiles,
   pairs of blocks of near groups, are ever made, by each node for itself, and each is the work of one task.
3. In a tile each unit vector u is q * s with int8 components q, and has the error e = |u - q s|. A product of two is
   off by at most e_u |q_v s_v| + e_v (as |u| = 1), so pairs whose product plus bound stays below the threshold are
   settled by integers; only the others are recomputed in double precision.
4. A tile returns, for its nodes, the sum of linked vectors and one edge to the smallest node of their group in the
   tile, so that a large group of near copies yields a row for each member and tile, not one for each pair.

Integer products are exact in float32 (checked), which numpy multiplies at full speed.

Defined results
* null vectors, vectors of length 0 or with null or non-finite components, zero vectors: linked with nothing, kept;
* vectors of different dimension are never linked; repeated rows, also of one vec_id, count as different vectors;
* ties, pairs at exactly the threshold: linked;
* null vec_id: takes part; component_id is the smallest id that is not null, kept is null if there is none;
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few
from .components import components

THRESHOLD = 0.95
#: Vectors of a block while there are few blocks, and blocks that are wanted: a node moves once for each block that its own
#: meets, so beyond BLOCK * BLOCKS vectors blocks grow instead. At most BLOCK_BYTES of components in double precision lie
#: in one: a task holds two blocks in a few such copies.
BLOCK, BLOCKS, BLOCK_BYTES = 4096, 24, 1 << 25
#: Tasks that tiles are dealt to at most.
TASKS = 10_000
#: Pivots of a dimension (two for each block of its vectors), and dimensions that have some, the commonest; others are one cell.
PIVOTS, WIDTHS = (64, 512), 16
#: Bytes of the sample that pivots are picked from, over all dimensions. It decides where cells lie, never what is linked.
SAMPLE_BYTES = 1 << 24
#: More than the error of an angle computed in double precision, for cosines not too near 1.
ANGLE_SLACK = 1e-6
#: Products that are made at a time, pairs recomputed at a time.
STRIP, PAIRS = 1 << 21, 1 << 16
#: More than the rounding of the float32 scaling of a product of unit vectors.
SLACK = 4e-6
LARGEST_EXACT = (1 << 24) // (127 * 127)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as float32 with integer values, scale, error norm, norm of q * scale) of unit vectors in double."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error, np.linalg.norm(q * scale[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; in parts whose sums float32 holds exactly."""
    d = a.shape[1]
    if d <= LARGEST_EXACT:
        return a @ b.T
    return sum((a[:, k : k + LARGEST_EXACT] @ b[:, k : k + LARGEST_EXACT].T).astype(np.float64) for k in range(0, d, LARGEST_EXACT)).astype(np.float32)


def linked_pairs(x: np.ndarray, y: np.ndarray, own: bool, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """(row of x, rows of y) with cosine >= threshold in double precision; own: y is x, and only later rows count."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex, lx = quantised(x / nx[:, None])
    qy, sy, ey, ly = (qx, sx, ex, lx) if own else quantised(y / ny[:, None])
    longest = float(max(lx.max(initial=0), ly.max(initial=0)))
    s32 = sy.astype(np.float32)
    gain = (ey * longest + SLACK).astype(np.float32)
    strip = max(16, STRIP // max(len(y), 1))
    for at in range(0, len(x), strip):
        first = at if own else 0
        p = _products(qx[at : at + strip], qy[first:])
        p *= sx[at : at + strip, None].astype(np.float32)
        p *= s32[first:]
        p += gain[first:]
        rows, columns = np.where(p >= (threshold - SLACK - ex[at : at + strip])[:, None].astype(np.float32))
        if own:
            later = columns > rows
            rows, columns = rows[later], columns[later]
        hits: list[np.ndarray] = []
        for k in range(0, len(rows), PAIRS):
            r, c = rows[k : k + PAIRS] + at, columns[k : k + PAIRS] + first
            hits.append(np.einsum("ij,ij->i", x[r], y[c]) / (nx[r] * ny[c]) >= threshold)
        if hits:
            good = np.concatenate(hits)
            rows, columns = rows[good] + at, columns[good] + first
            ends = np.searchsorted(rows, np.arange(at, min(at + strip, len(x)) + 1))
            for r in range(len(ends) - 1):
                if ends[r + 1] > ends[r]:
                    yield at + r, columns[ends[r] : ends[r + 1]]


def _tile(table: pa.Table) -> pa.Table:
    """Rows (node, other, links) of one tile: an edge from a node to its group's smallest, and its linked vectors."""
    nodes, sizes, side = (table.column(c).to_numpy() for c in ("node", "size", "side"))
    lists = table.column("vector").combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(nodes), -1)
    own = bool((side == 2).any())
    a, b = (np.arange(len(nodes)),) * 2 if own else (np.where(side == 0)[0], np.where(side == 1)[0])
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    members: dict[int, np.ndarray] = {}  # of labels with several nodes; the smaller side of a union is labelled anew
    if len(a) and len(b):
        for r, columns in linked_pairs(x[a], x[b], own):
            k, others = a[r], b[columns]
            links[k] += sizes[others].sum()
            links[others] += sizes[k]
            joined = np.unique(np.append(label[others], label[k]))
            if len(joined) > 1:
                groups = [members.pop(int(g), np.array([g])) for g in joined]
                largest = max(range(len(groups)), key=lambda g: len(groups[g]))
                for g in groups[:largest] + groups[largest + 1 :]:
                    label[g] = joined[largest]
                members[int(joined[largest])] = np.concatenate(groups)
    found = np.where(links > 0)[0]
    least: dict[int, str] = {}
    for k in found:
        least[label[k]] = min(least.get(label[k], nodes[k]), nodes[k])
    return pa.table({"node": pa.array([nodes[k] for k in found], pa.string()), "other": pa.array([least[label[k]] for k in found], pa.string()), "links": pa.array(links[found])})


@dataclass(frozen=True)
class Cells:
    """The cells of one dimension: pivots (unit rows), groups of cells with their first block and number of blocks, near pairs of groups."""

    pivots: np.ndarray
    group: np.ndarray
    base: np.ndarray
    parts: np.ndarray
    near: list[tuple[int, int]]


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the unit rows x, each as far as can be from those before it; the first is the first."""
    picks, closest = [0], x @ x[0]
    while len(picks) < min(k, len(x)):
        at = int(closest.argmin())
        if closest[at] >= 1 - 1e-12:
            break
        picks.append(at)
        closest = np.maximum(closest, x @ x[at])
    return x[picks]


def _pivots(nodes: DataFrame, block: int) -> dict[int, np.ndarray]:
    """The pivots of the commonest dimensions, from nodes whose hash falls into a share of all that makes a bounded sample."""
    counts = nodes.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    wanted = {r.width: min(r.n, max(1, SAMPLE_BYTES // (8 * r.width * len(counts)))) for r in counts}
    taken = F.lit(False)
    for r in counts:
        limit = int(-(2**63) + 2**64 * min(1.0, wanted[r.width] / r.n)) if wanted[r.width] < r.n else 2**63
        taken = taken | ((F.size("vector") == r.width) & (F.xxhash64("node") <= min(limit, 2**63 - 1)))
    sample: dict[int, list] = {}
    for r in nodes.filter(taken).select(F.size("vector").alias("width"), F.xxhash64("node").alias("h"), "vector").collect():
        sample.setdefault(r.width, []).append((r.h, r.vector))
    out = {}
    for r in counts:
        x = np.array([v for _, v in sorted(sample.get(r.width, []), key=lambda s: s[0])], np.float64)
        if len(x):
            k = min(max(PIVOTS[0], 2 * r.n // block), PIVOTS[1])
            out[r.width] = farthest_first(x / np.linalg.norm(x, axis=1)[:, None], k)
    return out


def _in_cells(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """nodes with `width`, `cell` (the nearest pivot, 0 where the dimension has none) and `angle`, that to the pivot."""

    def run(vectors: pa.Array) -> pa.Array:
        lists = vectors if isinstance(vectors, pa.Array) else vectors.combine_chunks()
        widths = np.asarray(pc.list_value_length(lists))
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(widths)])
        cell, angle = np.zeros(len(widths), np.int32), np.zeros(len(widths))
        for w in set(widths.tolist()) & pivots.keys():
            rows = np.flatnonzero(widths == w)
            x = flat[at[rows][:, None] + np.arange(w)]
            cosines = x @ pivots[w].T / np.linalg.norm(x, axis=1)[:, None]
            cell[rows] = best = cosines.argmax(axis=1)
            angle[rows] = np.arccos(np.clip(cosines[np.arange(len(rows)), best], -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

    placed = nodes.withColumn("_at", F.arrow_udf(run, "struct<cell:int,angle:double>")("vector"))
    return placed.select(*nodes.columns, F.size("vector").alias("width"), "_at.cell", "_at.angle")


def _grouped(pivots: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, block: int, threshold: float) -> Cells:
    """Groups of the cells with n nodes at angles from low to high, and which of them may hold links."""
    k = len(pivots)
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    gap = np.maximum(between - high[:, None] - high, np.maximum(low[:, None] - between - high, low - between - high[:, None]))
    close = (gap <= np.arccos(threshold) + ANGLE_SLACK) | np.eye(k, dtype=bool)
    # a chain from pivot to nearest pivot: cells next to each other share a block while they fit
    group, held, last, left = np.zeros(k, np.int64), 0, 0, set(range(k))
    sizes: list[int] = []
    while left:
        last = min(left, key=lambda c: (between[last, c], c))
        left.discard(last)
        if not sizes or held + n[last] > block:
            sizes.append(0)
            held = 0
        group[last] = len(sizes) - 1
        held += n[last]
        sizes[-1] += int(n[last])
    parts = np.maximum(1, -(-np.array(sizes) // block))
    base = np.concatenate([[0], np.cumsum(parts)])[:-1]
    near = sorted({(int(group[a]), int(group[b])) for a, b in zip(*np.nonzero(close), strict=True) if n[a] and n[b]})
    return Cells(pivots, group, base, parts, near)


def block_rows(n: int, width: int, block: int | None = None) -> int:
    """Vectors of a block where n of a dimension are to be compared: `block`, or BLOCK, or so many that there are about BLOCKS."""
    return max(1, min(block or max(BLOCK, -(-n // BLOCKS)), BLOCK_BYTES // (8 * width)))


def tiles(nodes: DataFrame, block: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """nodes (node, vector, ...) once for each tile they belong to: with width, low and high (its blocks) and side.

    side: 0 for nodes of the low block, 1 of the high one, 2 where both are the same. A node finds its tiles from the
    groups near its own, a broadcast table of at most a row for each pair of pivots.
    """
    spark = nodes.sparkSession
    pivots = _pivots(nodes, block or BLOCK)
    placed = cut(_in_cells(nodes, pivots))
    counted = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    bare = counted.filter(~F.col("width").isin(list(pivots)))  # of these dimensions nothing is known: one cell each
    by_width: dict[int, list] = {w: [] for w in pivots}
    for r in counted.filter(F.col("width").isin(list(pivots))).collect():
        by_width[r.width].append(r)
    of_cell, of_group = [], []
    for w, found in by_width.items():
        n, low, high = np.zeros(len(pivots[w]), np.int64), np.zeros(len(pivots[w])), np.zeros(len(pivots[w]))
        for r in found:
            n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
        rows = block_rows(int(n.sum()), w, block)
        cells = _grouped(pivots[w], n, low, high, rows, threshold)
        of_cell += [(w, c, int(g), int(cells.base[g]), int(cells.parts[g])) for c, g in enumerate(cells.group)]
        of_group += [(w, a, int(cells.base[b]), int(cells.parts[b])) for a, b in cells.near]
    names = "_w int, _c int, own int, base bigint, parts bigint"
    other = bare.select(F.col("width").alias("_w"), F.col("cell").alias("_c"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("base"), F.ceil(F.col("n") / (block or BLOCK)).alias("parts"))
    known = F.broadcast(spark.createDataFrame(of_cell, names))
    groups = F.broadcast(spark.createDataFrame(of_group, "_w2 int, _g int, other_base bigint, other_parts bigint"))
    at = lambda table: (F.col("width") == table["_w"]) & (F.col("cell") == table["_c"])
    common = placed.join(known, at(known)).join(groups, (F.col("width") == F.col("_w2")) & (F.col("own") == F.col("_g"))).drop("_w2", "_g")
    rare = placed.filter(~F.col("width").isin(list(pivots))).join(other, at(other))
    rare = rare.withColumns({"other_base": F.lit(0).cast("long"), "other_parts": F.col("parts")})
    own = F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))
    meets = common.unionByName(rare).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.col("other_base"), F.col("other_base") + F.col("other_parts") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return meets.select(*nodes.columns, "width", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), side.alias("side"))


def classes(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """(vec_id, node, n_links, component_id) of each vector (vec_id, embedding)."""
    e = F.col("embedding")
    usable = F.size(e) > 0
    usable = usable & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    own = vectors.select("vec_id", F.when(usable, e).alias("embedding"))
    own = own.withColumn("node", F.when(F.col("embedding").isNotNull(), F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",").cast("binary"))))
    nodes = cut(
        own.filter("node is not null").groupBy("node").agg(F.count("*").alias("size"), F.min("vec_id").alias("vec_id"), F.first("embedding").alias("vector"))
    )
    rows = tiles(nodes.select("node", "size", "vector"), block)
    n_tiles = rows.filter("side <> 1").select("width", "low", "high").distinct().count()
    rows = rows.repartition(int(min(max(n_tiles, 1), TASKS)), "width", "low", "high")
    linked = cut(rows.groupBy("width", "low", "high").applyInArrow(_tile, "node string, other string, links bigint"))
    found = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = linked.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_m")
    named = nodes.select("node", "size", "vec_id").join(sums, F.col("node") == F.col("_m"), "left").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = cut(named.select("node", "vec_id", "root", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # a row for each component with several nodes
    least = few(named.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("root", "_r"))
    named = named.join(least, F.col("root") == F.col("_r"), "left").select(F.col("node").alias("_n"), "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return own.join(named, F.col("node") == F.col("_n"), "left").select(
        "vec_id", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


def op7_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """The contract's digest: one row for each vector."""
    return classes(vectors).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
