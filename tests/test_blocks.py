"""Files of alignment blocks, read in splits of a few bytes, against a plain reader of whole texts."""

import gzip
import random
import re

import pytest

from loopweave.sources import blocks as B

GOOD = "s 10 4bp 0-4 ACGT\nACGT+ 4bp score=4 ACGT\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "199b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(text):
    """(first line, lines) of the blocks of a text."""
    out, block, first = [], [], 0
    for number, line in enumerate(text.split("\n"), 1):
        if line.strip() and not re.match(r"# \S+ end-of-file\s*$", line):
            first = first if block else number
            block.append(line)
        elif block:
            out.append((first, block))
            block = []
    return out + ([(first, block)] if block else [])


def made(seed):
    rng = random.Random(seed)
    parts = []
    for k in range(rng.randint(1, 12)):
        n = rng.choice([1, 5, 30, 200])
        text = "".join(rng.choices("ACGT-", k=n))
        stats = f"# score={k} querybp={n} mRatio={rng.randint(0, 99)}.0% m={n} mm=1 i=2 d={k}  {'=' * n}\n" if rng.random() < 0.5 else ""
        notes = "".join(f"# position {p} [A] m={p}\n" for p in range(rng.choice([0, 0, 3, 30])))
        motif = f"ACGT{rng.choice(['+', '-', ''])} {n}bp score={k - 3} {text.lower()}\n"
        parts += [stats, f"s{k} {rng.choice(['?', '99'])} {n}bp 0-{n}   {text}\n", motif, notes, rng.choice(["\n", "\n\n\n", " \t\n", "\r\n"])]
    return "".join(parts)


@pytest.mark.parametrize("seed", range(3))
def test_split_files_give_the_blocks_of_whole_texts(spark, tmp_path, small_splits, seed):
    texts = {f"f{k}.txt": made(10 * seed + k) + "# any end-of-file\n" + "\n" * k for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(texts["f0.txt"].encode()))
    df = B.read_blocks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    got = sorted((r.file.rsplit("/", 1)[1], r.line_number, r.name, r.start, r.end, r.seq_text, r.motif, r.strand, r.score, r.m, r.extra_lines) for r in df.collect())
    want = []
    for name, text in (texts | {"g.txt.gz": texts["f0.txt"]}).items():
        for first, lines in plain(text):
            stats = re.search(r" m=(\d+)", lines[0]) if "score=" in lines[0] and lines[0].startswith("#") else None
            seq, motif = (x.split() for x in [x for x in lines if not x.startswith("#")][:2])
            extra = [x for x in lines[1 if stats else 0 :] if x.startswith("#")]
            start, end = map(int, seq[3].split("-"))
            want.append((name, first, seq[0], start, end, seq[4], motif[0].rstrip("+-"), "-" if motif[0].endswith("-") else "+", int(motif[2][6:]), stats and int(stats[1]), extra))
    assert got == sorted(want)


def test_block_longer_than_many_splits(spark, tmp_path, small_splits):
    notes = "".join(f"# note {k}\n" for k in range(60))
    (tmp_path / "a.txt").write_text(GOOD + notes + "\n" + GOOD + "# any end-of-file\n")
    got = B.read_blocks(spark, str(tmp_path / "a.txt")).orderBy("line_number").collect()
    assert [r.line_number for r in got] == [1, 64] and got[0].extra_lines == notes.splitlines()


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (GOOD, "marker is missing"),
        ("\n \n", "marker is missing"),
        ("# any end-of-file\n" + GOOD, "after the end marker, in line 2"),
        ("# any end-of-file\n" + "\n" * 300 + GOOD, "after the end marker, in line 302"),
        (GOOD + "# any end-of-file\n\n# any end-of-file\n", "after the end marker, in line 5"),
        ("\n" * 200 + "s 10 4bp 0-4 ACGT\n# any end-of-file\n", "short block at line 201"),
        ("\n\ns 10 4bp 0-4\nACGT+ 4bp score=4 ACGT\n# any end-of-file\n", "bad block at line 3"),
    ],
)
def test_block_errors(spark, tmp_path, small_splits, text, error):
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text(GOOD + "# any end-of-file\n")
    with pytest.raises(Exception, match=error):
        B.read_blocks(spark, str(tmp_path)).collect()


def test_blocks_without_a_marker(spark, tmp_path):
    (tmp_path / "a.txt").write_text(GOOD)
    (tmp_path / "b.txt").write_text("")
    assert B.read_blocks(spark, str(tmp_path), require_end=False).count() == 1
