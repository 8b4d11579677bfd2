"""Run detection, source divergence and byte-level encoding against plain versions, the tokenizers library and SQL."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import threading
import zlib
from fractions import Fraction

import brute
import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyframe.llm import bpe, common, divergence, queries, runs, sql, tokens

DOCS = "doc_id long, text string, lang string, source string, n_words long, ids long, _s long"
TEXTS = ["", None, " \n\t ", "one", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " + "a b c " * 5 + "y", "a " * 3000, "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é", "A\x00b It's 12<|endoftext|><|endoftext|> é中😀  \n\n x", "Z-z 7Z é_É don't"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, [None, "en"][k % 2], [None, "b", "a"][k % 3], 0, 0, 0) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, " ".join(f"{'abcdefg'[(k * j) % 7]}{j % 3 or ''}" for j in range(40)), ["en", ""][k % 2], ["a", "c", ""][k % 3], 0, 0, 0) for k in range(40)]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "no id no id no id no id", None, None, None, None, None)], DOCS)


# runs


def plain_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, times * q) and not any(part[:-r] == part[r:] for r in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(draw_from, n, period, changes):
    w = [draw_from[k % period] for k in range(n)]
    for at, x in changes:
        if w:
            w[at % n] = x
    return w


words = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.builds(periodic, st.lists(st.integers(0, 3), min_size=20, max_size=20), st.integers(0, 200), st.integers(1, 20), st.lists(st.tuples(st.integers(0, 199), st.integers(0, 3)), max_size=3)),
)


@given(st.lists(words, max_size=5), st.sampled_from([2, 16]), st.sampled_from([(6, 4), (1, 4), (12, 5)]))
@settings(max_examples=200, deadline=None)
def test_batches_have_the_runs_of_each_text(texts, rounds, limits):
    least, times = limits
    old, runs.ROUNDS = runs.ROUNDS, rounds
    try:
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts]).astype(np.int64)
        found, n_words = runs.batch_runs(doc, np.array([x for w in texts for x in w], np.int64), len(texts), least, times)
    finally:
        runs.ROUNDS = old
    assert n_words.tolist() == [len(w) for w in texts]
    assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in plain_runs(w, least, times)]


def test_long_runs_take_no_square_of_their_length():
    w = b" ".join(b"w%d" % (k * k % 50_021) for k in range(50_000))
    n, found, text = runs._search(pa.array([b"a " * 200_000, b" ".join([w] * 5), b"b " * 5], pa.binary()), 6, 4)
    assert [tuple(r.values()) for r in found[0]] == [(0, 200_000, 1)] and found[2] == [] and text[2].as_py() == "b b b b b"
    assert (0, 250_000, 50_000) in [tuple(r.values()) for r in found[1]] and n == [200_000, 250_000, 5]


@given(st.lists(st.one_of(st.binary(max_size=30), st.just(b"a \x0b\x1cb\x00 c")), max_size=6), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_words_of_a_batch(texts, at):
    doc, found = common.word_table(pa.array([b"zz z", b""] + texts, pa.binary())[min(at, 2) :], common.byte_table(common.SPACES))
    rest = ([b"zz z", b""] + texts)[min(at, 2) :]
    assert found.to_pylist() == [w for t in rest for w in t.split()]
    assert doc.tolist() == [k for k, t in enumerate(rest) for _ in t.split()]


def test_runs_of_odd_rows(spark, odd):
    rows = odd.collect()
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in runs.find_runs(odd).collect())
    want = collections.Counter()
    for r in rows:
        w = brute.words(r["text"])
        want[r["doc_id"], len(w), tuple(plain_runs(w)), collapsed(w, plain_runs(w))] += 1
    assert got == want
    none = runs.find_runs(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and runs.digests(none).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(odd, times=3)


def test_runs_query(spark, small):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, small).collect()}
    planted = 0
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        w, h = brute.words(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, planted = 1 + (n - a) // (3 + g % 8), planted + 1
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w) if n < 1500 else None
        r = got[d["doc_id"]]
        if found is None:
            continue
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (len(found), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 5 and len(got) == spark.read.parquet(f"{small}/documents.parquet").count()


# divergence


def plain_audit(docs, least, top):
    kinds = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, count, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in docs:
        found = kinds.findall((text or "").translate(brute.LOWER))
        groups.add((lang or "", source or ""))
        df.update({(lang or "", t) for t in found})
        count.update((lang or "", source or "", t) for t in found)
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (l, t), n in df.items() if l == lang and n >= least], sorted(s for l, s in groups if l == lang)
        v, total = len(kept), {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 2) // (total[s] + 2 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        for s in sources:
            parts = {"pair": [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s, t], q[t]), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (1000, 10)])
def test_audit_of_odd_rows(odd, least, top):
    got = [tuple(r) for r in divergence.audit(odd, least=least, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit([(r["lang"], r["source"], r["text"]) for r in odd.collect()], least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_audit_in_small_pieces(odd, monkeypatch):
    """Runs that go over many batches, and pairs over many blocks."""
    spark = odd.sparkSession
    want = {tuple(r) for r in divergence.audit(odd, least=2).collect()}
    monkeypatch.setattr(divergence, "_BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in divergence.audit(odd, least=2).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_matches_sql(spark, small):
    assert oracle.compare(spark, oracle.connect(small), queries.op12_source_divergence, sql.oracle_sql()["op12_source_divergence"], small) is None


# byte-level encoding


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.vocabulary_path(bpe.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


letters = st.one_of(st.sampled_from(list(" \n\t'sdAa01.é中😀<| \x85\x1c") + ["<|endoftext|>", "'ll", "  "]), st.characters(codec="utf-8"))


@given(st.lists(st.lists(letters, max_size=40).map("".join), max_size=4), st.sampled_from([3, 16, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_fragments_encode_like_whole_texts(library, texts, window):
    known = bpe.encoder()
    old, bpe.WINDOW = bpe.WINDOW, window
    try:
        got = known.encode_batch(texts)
    finally:
        bpe.WINDOW = old
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [known.decode(x) for x in got] == texts


@pytest.mark.parametrize("text", ["ab" * 30_000, " " * 70_000, "word " * 9_000, "<|endoftext|>" * 300, "x" * 49 + "é" * 20_000])
def test_long_fragments(library, text):
    got = bpe.encoder().encode_batch([text])[0]
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids and bpe.encoder().decode(got) == text


def test_few_fragments_are_remembered(library):
    small = bpe.ForcedBoundaries(tokens.vocabulary_path(bpe.VOCABULARY), limit=3)
    text = "several different words of a text"
    assert small.encode_batch([text, text])[1].tolist() == library.encode(text).ids and len(small.known) <= 3
    with pytest.raises(ValueError):
        bpe.ForcedBoundaries(tokens.vocabulary_path("word_bpe_49k.json"))


def test_unknown_ids_are_skipped():
    assert bpe.encoder().decode(np.array([64, 10**9, 65, -1])) == bpe.encoder().decode(np.array([64, 65]))


def test_encoding_of_odd_rows(spark, odd, library):
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["text"]) for r in bpe.decode(bpe.encode(odd)).collect())
    want = collections.Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), r["text"] or ""] += 1
    assert got == want
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOCS))).count() == 0


def test_encoding_query(spark, small, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_bpe(spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(d["doc_id"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


# scratch tables


def test_threads_delete_only_their_own_tables(spark):
    """A block that ends in one thread leaves the tables of a block that is open in another."""
    opened, ended, seen = threading.Event(), threading.Event(), []

    def other():
        with common.passing(spark):
            table = common.materialise(spark.range(3), "mine")
            opened.set()
            ended.wait(60)
            seen.append(table.count())
        seen.append(os.path.exists(table._skyframe_path))

    thread = threading.Thread(target=other)
    thread.start()
    opened.wait(60)
    with common.passing(spark) as keep:
        kept, gone = keep(common.materialise(spark.range(2), "kept")), common.materialise(spark.range(1), "gone")
    ended.set()
    thread.join()
    assert seen == [3, False] and kept.count() == 2 and not os.path.exists(gone._skyframe_path)
