"""Training-data operators do the whole job where a corpus is large or odd."""

import hashlib
import math
import random
from collections import Counter

import pytest

from loopweave.llm import mixing, training
from tests.llm.test_small import reshared


@pytest.mark.parametrize("slots", [7, 64, 300])
def test_small_sources_are_mixed_however_large_a_slot(spark, slots):
    rnd = random.Random(slots)
    sources = ["big"] * 900 + ["mid"] * 200 + [f"tail{k % 120}" for k in range(240)] + [None] * 9
    rows = [(k, s, rnd.randint(0, 40)) for k, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(df, slots=slots).collect()
    assert sorted((r.doc_id, r.source, r["size"]) for r in out) == rows
    n_slots = -(-sum(r[2] for r in rows) // mixing.slot_words(sum(r[2] for r in rows), slots))
    for s in set(sources):
        mine = [r for r in out if r.source == s]
        size = sum(r["size"] for r in mine)
        assert sum(r.taken for r in mine) == min(int(mine[0].target + 0.5), 3 * size)
        assert all(0 <= r.taken <= 3 * r["size"] for r in mine)
        # a line is read round: no document is a round ahead of another by more than one
        rounds = {r.taken // r["size"] for r in mine if r["size"]}
        assert not rounds or max(rounds) - min(rounds) <= 1
    assert all((r.first_slot is not None and 0 <= r.first_slot < n_slots) == (r.taken > 0) for r in out)
    plain = {r.doc_id: r.taken for r in mixing.mix(df, slots=slots, with_slot=False).collect()}
    assert plain == {r.doc_id: r.taken for r in out}


def blocks_read(rows, slots):
    """(taken, first slot) of each document, by walking the schedule slot by slot in plain Python."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = reshared({s: n for s, n in sizes.items() if n}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    total = sum(sizes.values())
    n_slots = -(-total // max(1, -(-total // slots)))
    ends, upto = [], 0.0
    for s in (x for x in names if sizes[x]):
        upto += target[s]
        ends.append((min(math.floor(upto / sum(target.values()) * 2**32), 2**32), s))
    own: dict = {s: [] for s in names}
    for k in range(n_slots):
        point = (k + 1) * mixing.GOLDEN % 2**32
        found = next((s for e, s in ends if point < e), None)
        own[found].append(k)
    taken, first = Counter(), {}
    for s in names:
        words = min(math.floor(target.get(s, 0) + 0.5), 3 * sizes[s])
        name = "" if s is None else "=" + s
        held = own[s] or [int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % max(1, n_slots)]
        docs = sorted((d for d in rows if d[1] == s), key=lambda d: (hashlib.md5(f"{d[0]}:mix".encode()).hexdigest(), d[2]))
        line = [d[0] for d in docs for _ in range(d[2])]
        for rank, slot in enumerate(held):
            for w in range(rank * words // len(held), (rank + 1) * words // len(held)):
                taken[line[w % len(line)]] += 1
                first.setdefault(line[w % len(line)], slot)
    return taken, first


@pytest.mark.parametrize("total", [800, 3000])
def test_taken_is_what_the_slots_read_on_either_side_of_a_word_a_slot(spark, total):
    """Below and above as many words as slots, the same rule: a walk of the schedule gives each document's words and first slot."""
    rnd = random.Random(total)
    rows, left = [], total
    while left > 0:
        size = min(left, rnd.randint(0, 30))
        rows.append((len(rows), rnd.choice(["big"] * 8 + ["mid", "mid", "small", None]), size))
        left -= size
    taken, first = blocks_read(rows, 1000)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), slots=1000).collect()
    assert {r.doc_id: r.taken for r in out} == {k: taken[k] for k, _, _ in rows}
    assert {r.doc_id: r.first_slot for r in out} == {k: first.get(k) for k, _, _ in rows}


def test_a_long_text_leaves_the_sample_whole(spark):
    texts = {k: f"text {k}" for k in range(60)}
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, toxic int")
    docs = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    whole = training.sample(docs(texts), labels, "toxic", max_chars=1000)
    assert len(whole) > 30 and {y for _, y in whole} == {0, 1}
    first = int(whole[0][0].split()[1])
    rest = training.sample(docs(texts | {first: "y" * 999}), labels, "toxic", max_chars=1000)
    assert rest == whole[1:]
    second = int(whole[20][0].split()[1])
    assert training.sample(docs(texts | {second: "y" * 5000}), labels, "toxic", max_chars=1000) == whole[:20] + whole[21:]
    long = {k: "z" * (3000 + k) if k % 2 else t for k, t in texts.items()}
    assert sum(y for _, y in training.sample(docs(long), labels, "toxic", max_chars=1000)) == 1


def test_the_stage_gives_documents_in_the_order_of_the_schedule(spark):
    """Each stretch of the stage's rows holds every source with nearly its share of the words, as the schedule has it."""
    rnd = random.Random(5)
    sizes = {k: rnd.randint(5, 30) for k in range(900)}
    source = {k: "abc"[k % 3] for k in sizes}
    rows = [(k, source[k], " ".join(["w"] * n)) for k, n in sizes.items()]
    out = [r.doc_id for r in mixing.stage(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), "").collect()]
    words = lambda ids, s: sum(sizes[k] for k in ids if source[k] == s) / sum(sizes[k] for k in ids)
    assert len(out) > 600
    for k in range(6):
        part = out[k * len(out) // 6 : (k + 1) * len(out) // 6]
        assert all(abs(words(part, s) - words(out, s)) < 0.06 for s in "abc")
    slots = {r.doc_id: r.first_slot for r in mixing.mix(spark.createDataFrame([(k, source[k], n) for k, n in sizes.items()], "doc_id long, source string, size long")).collect()}
    firsts = [slots[k] for k in dict.fromkeys(out) if slots[k] is not None]
    assert sorted(firsts) == firsts
