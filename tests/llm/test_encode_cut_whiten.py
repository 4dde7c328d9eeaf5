"""Fill-in-the-middle, whitening and byte-pair encoding against plain Python, the library and numpy."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopweave.llm import bpe, fill_middle, registry, whitening

ODD = [None, "", "\n", "\n\n", "one", "one\n", " a\n\nb", "é\n日本\nß\x00\x0b\n", "a<P>b\nc\n", "x<\nS>\ny", "<|endoftext|>\nA<|startoftext|>b", "z" * 400 + "\n", "it's 1234 WE'LL\x1cq"]


def documents(spark, texts):
    """A documents table with extra columns whose names clash with results."""
    return spark.createDataFrame([(k, t, 7, "form", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, n int, form string, ids double")


# --- 11


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=300, unique=True))
def test_rank_and_select_of_a_bitvector(places):
    places = np.array(sorted(places), np.int64)
    bits = fill_middle.Bits.at(places, 3001)
    at = np.arange(0, 3001, 7)
    assert bits.rank(at).tolist() == np.searchsorted(places, at).tolist() and bits.ahead[-1] == len(places)
    flags = np.zeros(3001, bool)
    flags[places] = True
    assert (fill_middle.Bits.of(flags).words[: len(bits.words)] == bits.words[: -(-3001 // 64)].tolist() + [0] * (len(bits.words) - -(-3001 // 64))).all()
    if len(places):
        assert bits.select(np.arange(len(places))).tolist() == places.tolist()


def cut_plainly(doc_id, text, rate=100, spm=50):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("size", [1 << 22, 600])
def test_texts_are_cut_as_in_plain_python(spark, size, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", size)
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice(["a", "é", "日", "\n", "\n\n", " word", "<", "P>"]) for _ in range(rnd.randint(0, 900))) for _ in range(150)] + ["line\n" * 40_000]
    df = documents(spark, texts)
    want = {k: cut_plainly(k, t) for k, t in enumerate(texts)}
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(fill_middle.F.col("form"), fill_middle.F.col("output"))).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out} == want
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"} and all(r.back == (texts[r.doc_id] or "") for r in out)
    some = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.fill_in_middle(df, rate=40, spm=90).collect()}
    assert some == {k: cut_plainly(k, t, 40, 90) for k, t in enumerate(texts)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fill_middle.op11_fill_in_middle(df).collect():
        assert (r.output_sha256, r.restored_sha256) == (sha(want[r.doc_id][4]), sha(texts[r.doc_id] or ""))


def test_ids_of_any_kind_and_an_empty_table(spark):
    rows = spark.createDataFrame([(None, "a\nb"), ("x", "a\nb"), ("x", "a\nb")], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.output) for r in fill_middle.fill_in_middle(rows).collect())
    assert got == sorted((str(k), cut_plainly(k, "a\nb")[4]) for k in (None, "x", "x"))
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.op13_bpe(rows).collect()) == [("None", 2), ("x", 2), ("x", 2)]
    empty = documents(spark, []).limit(0)
    assert fill_middle.op11_fill_in_middle(empty).count() == 0 and bpe.op13_bpe(empty).count() == 0


def test_cuts_match_their_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = c.execute(registry.oracle_sql()["op11_fill_in_middle"])
    names = [x[0] for x in want.description]
    rows = registry.queries()["op11_fill_in_middle"](spark, d)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in rows.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


# --- 12


def whitened_plainly(vectors, components=4):
    """Rows (n, deviation, whitened up to sign, explained) by numpy's eigenvectors of the covariance."""
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    total = (centred**2).sum() / n
    return n, [sum((n * a - int(s)) ** 2 for a, s in zip(r, sums)) for r in x], (np.array(x) - sums / n) @ v / np.sqrt(e), e / total


def test_whitening_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 5
    vectors = [v.astype(np.float32).tolist() for v in base]
    vectors += [vectors[0]] * 200  # a common vector counts once
    odd = [None, [], [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [1.0] * 11]
    rows = [(k, v, 1) for k, v in enumerate([*vectors, *odd])] + [(None, vectors[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    n, deviation, white, explained = whitened_plainly(vectors)
    out = whitening.op12_whitening(df).collect()
    assert len(out) == 4 * (len(vectors) + 1) and out[0].n == n == 300
    got = np.zeros((len(vectors), 4))
    for r in out:
        if r.vec_id is None:
            continue
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-8
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-8
    assert sorted(r.component for r in out if r.vec_id is None) == [1, 2, 3, 4]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.op12_whitening(spark.createDataFrame([], schema)).count() == 0
    # one vector, or equal ones, have no variance and so no component; two span one; each dimension has its own fit
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    out = whitening.op12_whitening(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in out) == [(3, 1, 2, 256**2, 1.0, 1.0), (4, 1, 2, 256**2, 1.0, 1.0), (4, 1, 2, 256**2, 1.0, 1.0)]
    huge = whitening.op12_whitening(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], schema)).collect()
    assert len(huge) == 2 and all(r.deviation is None for r in huge)


# --- 13


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary())
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return ids, [tok.decode(x, skip_special_tokens=False) for x in ids]


def same_as_library(texts, cache=bpe.CACHE):
    b = bpe.Bpe(cache=cache)
    ids, decoded = library(texts)
    tokens = bpe.Tokens()
    for at in range(0, len(texts), 97):
        got = b.encode(texts[at : at + 97])
        assert got == [np.array(x, "<u4").tobytes() for x in ids[at : at + 97]]
        assert list(map(tokens.decode, got)) == decoded[at : at + 97]


def test_every_code_point_is_encoded_as_by_the_library():
    points = [c for c in [*range(0x600), *range(0x1100, 0x1200, 5), *range(0x1E00, 0x2200), *range(0x3000, 0x3100), *range(0xA640, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    same_as_library([f"a{chr(c)}B {chr(c)}" for c in points])


def test_texts_are_encoded_as_by_the_library():
    rnd = random.Random(1)
    pool = [*"ab AB12'sStT éÉ́̂ßΣςİI\x1c\x85\xa0 日本한글각.,!?-_\n\t", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'ll", "'re", "thing", "ation"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    same_as_library(texts + [t or "" for t in ODD])
    same_as_library(texts, cache=50)  # caches that are renewed all the time change nothing


def test_long_words_have_the_parts_that_scans_give():
    rnd, b = random.Random(2), bpe.Bpe()
    words = ["".join(rnd.choice(s) for _ in range(rnd.randint(1, 300))) for s in ("abcdet", "a", "ab", "theran") for _ in range(12)]
    for w in words:
        assert b.scanned(np.frombuffer(w.encode(), np.uint8).reshape(1, -1))[0].tolist() == b.queued(w.encode())
    same_as_library([*words, "x" * 20_000, "ab" * 30_000])


def test_documents_are_encoded_and_decoded(spark, monkeypatch):
    texts = [*ODD, *(f"some words of text {k} and more, it's {k * 7}" * (k % 40) for k in range(300))]
    monkeypatch.setattr(bpe, "STRETCH", 2000)
    ids, decoded = library([t or "" for t in texts])
    got = {r.doc_id: r for r in bpe.op13_bpe(documents(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        packed = np.array(ids[k], "<u4").tobytes()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids[k]), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded[k].encode()).hexdigest())
