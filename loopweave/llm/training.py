"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

#: Labelled documents of each class that a classifier is fitted on at most, and their characters in all at most.
PER_CLASS = 1000
MAX_CHARS = 16_000_000


def _fitting(size: dict[int, tuple[int, int]], max_chars: int) -> set[int]:
    """The hashes whose texts are taken; size: (characters, class) by hash.

    In order of the hash, each class takes what fits half of max_chars, then all take what fits the rest. Texts of
    more than a hundredth of max_chars come last, and a class of which none fits has its shortest.
    """
    line = sorted(size, key=lambda h: (size[h][0] > max_chars // 100, h))
    room, chosen = {0: max_chars // 2, 1: max_chars // 2}, set()
    for h in line:
        n, y = size[h]
        if n <= room[y]:
            room[y] -= n
            chosen.add(h)
    left = sum(room.values())
    for h in line:
        if h not in chosen and size[h][0] <= left:
            left -= size[h][0]
            chosen.add(h)
    for y in {y for _, y in size.values()} - {size[h][1] for h in chosen}:
        chosen.add(min((n, h) for h, (n, c) in size.items() if c == y)[1])
    return chosen


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(whole text, label) of at most per_class documents of each class, outside the held-out fifth.

    The documents are those of smallest hash, so a larger corpus gives another sample of the same size. Texts are
    whole and have max_chars in all at most; those that don't fit are passed over (see _fitting). Rows without text or
    label are left out; of the rows of one doc_id the shortest text counts. Two times per_class ids at most are
    broadcast, and as many rows at most collected.
    """
    usable = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id"))
    parts = [usable.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    found = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    # one text for each id, the shortest, before anything goes to the driver: an id may have any number of rows
    one = found.groupBy("h").agg(F.max("y").alias("y"), F.min(F.struct(F.length("text").alias("n"), "text")).alias("t"))
    found = cut(one.select("h", "y", F.col("t.n").alias("n"), F.col("t.text").alias("text")))
    chosen = _fitting({r["h"]: (r["n"], r["y"]) for r in found.select("h", "n", "y").collect()}, max_chars)
    picked = found.filter(F.col("h").isin(list(chosen))).collect() if chosen else []
    return [(r["text"], int(r["y"])) for r in sorted(picked, key=lambda r: r["h"])]
