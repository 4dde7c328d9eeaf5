"""Consensus and words of one alignment by Python follow the cells of `tokens`."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loopweave.operators import consensus as C


def alignments(spark):
    rnd, rows = random.Random(7), []
    turn = str.maketrans("ACGT", "TGCA")
    for k in range(150):
        motif = rnd.choice(["ACGTT", "AT", "A", "GGA", "ACACC"])
        unit = rnd.choice([motif, motif[::-1].translate(turn), "CGTA"])
        at, s, q = rnd.randrange(len(unit)), [], []
        for j in range(rnd.choice([0, 1, 7, 60])):
            b = unit[(at + j) % len(unit)]
            x = rnd.random()
            if x < 0.08:
                s.append("-"), q.append(b)
            elif x < 0.16:
                s.append(rnd.choice("ACGT")), q.append("-")
            elif x < 0.2:
                s.append(rnd.choice("ACGT")), q.append(b.lower())
            else:
                s.append(b), q.append(b)
        rows.append((k, motif, "".join(s), "".join(q)))
    return spark.createDataFrame([*rows, (900, "AT", None, None), (901, None, "AT", "AT")], "id int, motif string, seq_text string, motif_text string")


def test_copies_and_consensus_follow_the_tokens(spark):
    df = alignments(spark)
    cells = {}
    for r in C.tokens(df, ["id"]).collect():
        cells.setdefault(r.id, {}).setdefault(r.pos, []).append((r.chunk, r.token))
    found = {r.id: r.consensus for r in C.consensus(df, ["id"]).collect()}
    n_clear = 0
    for row in df.filter("id < 900").collect():
        by_pos = cells.get(row.id, {})
        own = C.copies_of(row.motif, row.seq_text, row.motif_text)
        assert [[t for _, t in sorted(by_pos[p])] for p in sorted(by_pos)] == [list(x) for x in zip(*own, strict=True)]
        best = [max((n, t) for t, n in Counter(t for _, t in by_pos[p]).items()) for p in sorted(by_pos)]
        clear = best and all(n >= 0.5 * len(own) for n, _ in best)
        assert found.get(row.id) == ("".join(t.replace("-", "") if t == "-" else t for _, t in best) if clear else None)
        n_clear += bool(clear)
    assert n_clear > 20


def test_no_nested_array_functions_are_left(spark):
    df = alignments(spark)
    for out in (C.consensus(df, ["id"]), C.words(df, ["id"]), C.sliced_consensus(df.select("*", F.lit(0).alias("start"), F.lit(9).alias("end")), ["id"], 40, 20)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
