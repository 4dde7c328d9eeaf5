"""The classifiers' queries and every stage of the pipeline against plain Python, on a small folder of tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loopweave.llm import common, line_crf, near_dedup, packing, quality_rules, toxicity, training
from tests.llm.test_small import grams, reshared, smallest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size long, target int, row string"
STOP = "the of and to in is it that for was on are".split()


def corpus():
    rnd = random.Random(11)
    words = [f"word{k}" for k in range(60)] + STOP * 6
    texts = []
    for k in range(240):
        w = [rnd.choice(words) for _ in range(rnd.randint(25, 120))]
        if k % 4 == 0:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["awful", "awfulness", "awfully"])
        if k % 9 == 1:
            w = [x + "###" for x in w]
        texts.append("\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)))
    texts += [texts[k] for k in (2, 3, 6, 2)] + [texts[7].replace("word", "WORD", 3) + " tail", texts[10] + " end"]
    texts += [None, "", " \n", "short text", "a b c d e f g h " * 40, " ".join(rnd.choice(words) for _ in range(9000)), "the of and " * 10 + "é 日本 \x0b"]
    sources = ["hot"] * 5 + ["b", "c", None]
    rows = [(k, t, "en", sources[k % 8], len(t or ""), True, 0.5, 7, 1, "x") for k, t in enumerate(texts)]
    labels = [(k, int(k % 9 != 1), int(k % 4 == 0)) for k in range(240)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    return d, empty


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_scores_are_learned_from_the_other_four_fifths(spark, folder, name):
    docs, labels = (common.table(spark, folder[0], t) for t in ("documents", "labels"))
    rows, given = corpus()
    query = {"toxic": toxicity.op1_toxicity, "quality": line_crf.op2_quality_classifier}[name]
    column = {"toxic": 2, "quality": 1}[name]
    rows_of = lambda out: {r.doc_id: r.score for r in out}
    out = query(docs, labels).collect()
    got = rows_of(out)
    assert len(out) == len(rows) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= (0.5 if name == "toxic" else 0.3)) for r in out)
    # plain Python: every labelled row outside the fifth is in the sample, and the model on it gives these scores
    sample = training.sample(docs, labels, name)
    assert Counter(sample) == Counter((rows[g[0]][1], g[column]) for g in given if not held_out(g[0]))
    module = {"toxic": toxicity, "quality": line_crf}[name]
    model = module.train(sample)
    for k, r in enumerate(rows):
        plain = toxicity.scores(model, [toxicity.tokens(r[1])], toxicity.Vocabulary(model)) if name == "toxic" else line_crf.scores(model, [r[1]])
        assert abs(plain[0] - got[k]) < 1e-5
    right = [(got[g[0]] >= 0.5) == bool(g[column]) for g in given if held_out(g[0])]
    assert len(right) > 30 and np.mean(right) > 0.9
    # labels of the held-out fifth, languages, sources and ids of unlabelled rows change nothing
    turned = spark.createDataFrame([(g[0], 1 - g[1], 1 - g[2]) if held_out(g[0]) else g for g in given], labels.schema)
    other = spark.createDataFrame([(r[0], r[1], "fr", "z", *r[4:]) for r in rows], SCHEMA)
    assert rows_of(query(other, turned).collect()) == pytest.approx(got, abs=1e-6)


def test_an_empty_corpus_and_repeated_ids(spark, folder):
    docs, labels = (common.table(spark, folder[1], t) for t in ("documents", "labels"))
    assert toxicity.op1_toxicity(docs, labels).count() == 0 and line_crf.op2_quality_classifier(docs, labels).count() == 0
    assert corpus_pipeline.run(spark, folder[1]).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (toxicity.op1_toxicity(some, none), line_crf.op2_quality_classifier(some, none)):
        assert sorted((str(r.doc_id), r.score, r.predicted) for r in out.collect()) == [("1", 0.0, 0), ("1", 0.0, 0), ("None", 0.0, 0), ("None", 0.0, 0)]


def test_many_rows_of_one_id_stay_on_the_executors(spark):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    docs = spark.range(3000).selectExpr("id % 30 as doc_id", "concat('text ', id) as text")
    rows = training.sample(docs, labels, "toxic")
    assert len(rows) == sum(not held_out(k) for k in range(30))


def test_a_vocabulary_larger_than_its_limit_scores_alike():
    texts = [f"w{k} awful w{k + 1} plain{k % 7}" for k in range(60)]
    model = toxicity.train([(t, k % 2) for k, t in enumerate(t.replace("awful", "fine") if k % 2 == 0 else t for k, t in enumerate(texts))])
    small, large = toxicity.Vocabulary(model, 5), toxicity.Vocabulary(model)
    docs = [toxicity.tokens(t) for t in texts]
    assert [toxicity.scores(model, [d], small)[0] for d in docs] == pytest.approx(toxicity.scores(model, docs, large), abs=1e-6)


def passes_rules(text):
    """The quality rules in plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    if n < 20:
        return False
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    if 100 * len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}) > 30 * n:
        return False
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, stop = sum(map(len, w)), set(quality_rules.STOP_WORDS)
    measures = {
        "mean_word_length": chars / n, "symbols_per_word": len(re.findall("[#*$%&|<>]", t)) / n, "exclamations_per_word": t.count("!") / n,
        "upper_case_share": sum(c.isupper() for c in t) / chars, "digit_share": len(re.findall("[0-9]", t)) / chars, "stop_word_share": sum(x.lower() in stop for x in w) / n,
        "echoed_word_share": sum(a == b for a, b in zip(w, w[1:])) / n, "duplicate_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "words_per_line": n / max(len(lines), 1),
    }
    return all((r.low is None or measures[r.name] >= r.low) and (r.high is None or measures[r.name] <= r.high) for r in quality_rules.RULES)


def test_the_pipeline_stage_by_stage(spark, folder, tmp_path):
    docs, names = common.table(spark, folder[0], "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], folder[0]).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(df.columns == docs.columns for df in kept[:-1])
    text = {r[0]: r[1] for r in corpus()[0]}
    source = {r[0]: r[3] for r in corpus()[0]}
    # rules
    assert ids(kept[1]) == [k for k, t in text.items() if passes_rules(t)]
    # toxicity: the plain model on the rows that the rules left
    model = toxicity.train(training.sample(kept[1], common.table(spark, folder[0], "labels"), "toxic"))
    plain = {k: toxicity.scores(model, [toxicity.tokens(text[k])], toxicity.Vocabulary(model))[0] for k in ids(kept[1])}
    assert ids(kept[2]) == [k for k, p in plain.items() if p < 0.5]
    assert sum(k % 4 == 0 for k in ids(kept[2]) if k < 240) < 0.1 * sum(k % 4 == 0 for k in ids(kept[1]) if k < 240)
    # near duplicates: brute force over full sets
    left = ids(kept[2])
    sets = {k: grams(text[k]) for k in left}
    links = [(a, b) for a in left for b in left if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = smallest(left, links)
    assert links and ids(kept[3]) == [k for k in left if roots[k] == k]
    # mixing: whole documents, each source near its target, none more than three times
    sizes, copies = {}, Counter(ids(kept[4]))
    for k in ids(kept[3]):
        sizes[source[k]] = sizes.get(source[k], 0) + len(text[k].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    assert set(copies) <= set(ids(kept[3])) and max(copies.values()) <= 3
    longest = max(len(text[k].split()) for k in ids(kept[3]))
    for s in order:
        assert abs(sum(n * len(text[k].split()) for k, n in copies.items() if source[k] == s) - want[s]) <= longest
    # packing: every copy whole, in gapless sequences
    tok, pieces, windows = packing.encoder().tokenizer, {}, {}
    for r in kept[5].collect():
        pieces.setdefault(r.doc_id, Counter())[(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(copies)
    for k, found in pieces.items():
        coded = [*tok.encode(text[k], add_special_tokens=False).ids, 1]
        assert {n for n in found.values()} == {copies[k]} and sum(p[1] for p in found) == len(coded)
        for start, length, crc, total in found:
            assert total == len(coded) and crc == zlib.crc32(np.array(coded[start : start + length], "<u4").tobytes())
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
    # run() gives the rows of the stages
    assert corpus_pipeline.run(spark, folder[0]).count() == kept[5].count()


def test_crowded_buckets_lose_no_link(spark):
    """Blocks of four: almost every bucket with several components is crowded, and is dealt by further bands."""
    rnd = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for k in range(60):
        own = [f"o{k}.{j}" for j in range(rnd.randint(8, 40))]
        for _ in range(rnd.randint(1, 3)):
            copy = list(own)
            copy[rnd.randrange(len(copy))] = f"x{rnd.random()}"
            texts.append(" ".join(shared + copy))
    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest(range(len(texts)), [(b, a) for a, b in links])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, whole in ((4, 0), (4, 32), (512, 32)):
        placed, _ = near_dedup.classes(docs, block=block, whole=whole)
        assert {r.doc_id: r.component_id for r in placed.collect()} == want


def test_recall_in_crowded_buckets_at_the_real_block(spark):
    """1,500 pairs of near copies that all share one passage: links found over links that brute force finds, at BLOCK."""
    rnd = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(70))
    texts = []
    for k in range(1500):
        own = [f"o{k}.{j}" for j in range(24)]
        texts.append(f"{shared} {' '.join(own)}")
        own[rnd.randrange(24)] = f"x{k}"
        texts.append(f"{shared} {' '.join(own)}")
    sets = [grams(t) for t in texts]
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    # texts of two families have the passage's shingles in common and no others, so one pair stands for all
    assert all(similar(2 * k, 2 * k + 1) for k in range(1500)) and not similar(0, 2) and len(sets[0] & sets[2]) == len(grams(shared))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    buckets = Counter(key for t in texts for key in enumerate(near_dedup.bands(near_dedup.registers(near_dedup.shingles(t)))))
    assert max(buckets.values()) > 2 * near_dedup.BLOCK
    placed, _ = near_dedup.classes(docs, whole=0)  # crowded buckets are dealt by further bands
    got = {r.doc_id: r.component_id for r in placed.collect()}
    assert all(got[k] >= k - 1 for k in got) and sum(got[2 * k + 1] == 2 * k for k in range(1500)) >= 1499


def test_depth_0_compares_all(spark):
    texts = [" ".join([*(f"s{j}" for j in range(60)), *(f"o{k}.{j}" for j in range(10 + k % 7))]) for k in range(60)]
    sets = [grams(t) for t in texts]
    links = [(b, a) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    placed, _ = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4, depth=0, whole=0)
    assert {r.doc_id: r.component_id for r in placed.collect()} == smallest(range(60), links)


def test_banding_finds_pairs_at_the_threshold():
    """Pairs of similarity 0.75 to 0.8 that share a band, out of 2,000: the measured side of the formula."""
    rng, found = np.random.default_rng(7), 0
    for _ in range(2000):
        n = int(rng.integers(40, 1500))
        both = int(np.ceil(2 * n * 0.75 / 1.75))
        pool = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        a, b = (near_dedup.bands(near_dedup.registers(np.unique(x))) for x in (pool[:n], pool[n - both :]))
        found += any(x == y for x, y in zip(a, b))
    assert found >= 1998


def test_a_pair_that_shares_crowded_bands_alone_is_found(spark):
    """Two texts of similarity 0.75 with two bands in common, both of which a crowd of other texts shares."""
    rng = np.random.default_rng(3)
    key = lambda words: near_dedup.bands(near_dedup.registers(near_dedup.shingles(" ".join(words))))
    a = [f"a{k}" for k in range(600)]
    own, common = key(a), []
    while len(common) != 2:
        b = list(a)
        for k in rng.permutation(118)[:17]:
            b[5 * int(k) + 4] = f"b{rng.integers(1 << 30)}"
        common = [k for k, (x, y) in enumerate(zip(own, key(b))) if x == y]
    least = {}
    for k in range(596):
        h = int(near_dedup.shingles(" ".join(a[k : k + 5]))[0])
        least[h >> 57] = min(least.get(h >> 57, (h, k)), (h, k))
    phrases = [a[k : k + 5] for band in common for _, k in (least[4 * band + j] for j in range(4))]
    crowd = []
    while len(crowd) < 40:
        c = [w for p in phrases for w in [*p, f"c{rng.integers(1 << 30)}"]]
        if all(key(c)[k] == own[k] for k in common):
            crowd.append(c)
    sets = [grams(" ".join(t)) for t in (a, b, *crowd)]
    links = [(y, x) for x in range(42) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    assert links == [(0, 1)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((a, b, *crowd))], "doc_id long, text string")
    placed, _ = near_dedup.classes(docs, block=4, whole=0)
    assert {r.doc_id: r.component_id for r in placed.collect()} == smallest(range(42), links)
