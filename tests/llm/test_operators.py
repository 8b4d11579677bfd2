"""The operators on small inputs with nulls, ties, repeats, empty tables and clashing extra columns, against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe.llm import bayes, binary, chat, common, fingerprint, langid, mixing, neardup, packing, queries, rules, tokens, toxicity

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _s long, size long, label long"
ODD = ["", None, " \n\t ", "one", "Étéç ÉTÉ' don't [x]<y> 😀😀 a.b. 's <|endoftext|> É", "word " * 9000, "a b c d e f g h " * 4, "x\x0by\x0cz w\n\nx"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, *(" ".join(f"w{(k * 7 + j * j) % 50}" for j in range(60)) for k in range(30)), "same text here " * 9, "same text here " * 9]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "b", "a", "c"][i % 4], -1, 0, 0, 0) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# tokens and token files


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_chunks_encode_like_whole_texts(parts):
    enc = tokens.encoder()
    for text in (*parts, " ".join(parts), *(t for t in ODD if t and len(t) < 1000)):
        assert enc(text.encode()) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([32, 64, 1024]), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(ids, block, percentile):
    p = binary.Payload(binary.pack_ids(np.array(ids, np.uint32), block, percentile))
    assert p.ids().tolist() == ids
    assert p.ids(40, 100).tolist() == ids[40:100]


def test_payload_wants_its_magic():
    with pytest.raises(ValueError):
        binary.Payload(b"nothing like it")


def _ids(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, odd, none, tmp_path):
    binary.write_token_files(odd, str(tmp_path / "a"), chunk_ids=500, block=64)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for r in rows:
        a = np.array([*_ids(r.text), 2], "<u4")
        want.append((r.doc_id, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in binary.token_file_digests(spark, str(tmp_path / "a")).collect()), key=key) == want
    back = sorted(binary.read_token_files(spark, str(tmp_path / "a")).collect(), key=key)
    assert [r.ids for r in back] == [[*_ids(r.text), 2] for r in rows]
    binary.write_token_files(none, str(tmp_path / "b"))
    assert binary.token_file_digests(spark, str(tmp_path / "b")).count() == 0


# packing


@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_best_fit_places_all(lengths, open_bins):
    bins, offsets = packing.best_fit(lengths, 64, open_bins)
    by = collections.defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        by[b].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64


def test_packing(odd, none):
    rows = packing.pack_documents(odd).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(len(_ids(r.text)) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == total
    assert len(by) == -(-total // 4096)
    assert packing.pack_documents(none).count() == 0
    unique = odd.filter("doc_id < 10").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(unique, capacity=256)
    full = packing.sequences(unique, packed, capacity=256).collect()
    assert sorted(x for r in full for x in r.ids) == sorted(x for r in unique.collect() for x in [*_ids(r.text), 1])


# mixing


def test_apportion_is_sainte_lague(spark):
    draw = np.random.default_rng(5)
    rows = [(g, k, float(draw.integers(0, 50))) for g in range(6) for k in range(1 + g * 3)]
    seats = {g: int(draw.integers(0, 90)) for g in range(6)}
    cells = spark.createDataFrame([(g, k, w, seats[g]) for g, k, w in rows], "g int, k int, w double, seats int")
    got = {(r.g, r.k): r.got for r in mixing.apportion(cells, ["g"], "w", "seats", [F.col("k")], "got").collect()}
    for g in range(6):
        weights = [w for h, _, w in rows if h == g]
        want = brute.sainte_lague(weights, seats[g]) if sum(weights) else [0] * len(weights)
        assert [got[g, k] for k in range(len(weights))] == want


def test_mixing(odd, none):
    rows = mixing.mix(odd, block_words=4, shard_docs=5).collect()
    assert len(rows) == odd.count()
    sizes = collections.Counter()
    for r in odd.collect():
        sizes[r.source] += len(brute.words(r.text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = brute.targets({s: sizes[s] for s in order})
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd, block_words=4, shard_docs=5).collect()))
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.subtract(odd).count() == 0


def test_mixing_takes_what_a_plain_version_takes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("source is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.source, len(brute.words(r.text))) for r in docs.select("doc_id", "source", "text").collect()]
    assert {r.doc_id: r.taken for r in mixing.mix(docs, shard_docs=20).collect()} == brute.taken(rows, 16, 20)


# quality rules


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "e", "\n", "\x0b\n", "a b c d e f g h", "é#\x1c", "a b c d e f g h\na b"]), max_size=60), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_text_counts(batch):
    texts = [" ".join(parts) for parts in batch]
    got = [tuple(int(c[k]) for c in rules.batch_counts(pa.array([t.encode() for t in texts], pa.binary()))) for k in range(len(texts))]
    assert got == [plain_counts(t) for t in texts]


def plain_counts(text):
    w = brute.words(text)
    lines, seen, dup = [x for x in text.split("\n") if brute.words(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, brute.repeated_words(w), len(lines), sum(x == y for x, y in zip(w, w[1:], strict=False))


def plain_kept(rows):
    """rows: (lang, source, counts of _COUNTS); the verdict on each, by a plain version of the fences."""
    base = [c[0] < 20 or 100 * c[4] > 30 * c[0] for _, _, c in rows]
    kinds = {"symbol": (2, 0, 2), "length": (1, 0, 1), "dup": (3, 5, 1), "repeat": (4, 0, 16), "echo": (6, 0, 1)}

    def sketch(members, kind):
        at, over, _ = kinds[kind]
        seen = collections.defaultdict(lambda: [0, 0])
        for c in members:
            x, n = c[at] / max(1, c[over]), max(1, c[over])
            b = math.ceil(math.log(x) / math.log(1.02)) if x > 0 else -math.inf
            seen[b][0] += 1
            seen[b][1] += n
        return sorted((b, n, o) for b, (n, o) in seen.items())

    def told(entries, kind):
        docs, over, run, num, q, points = sum(n for _, n, _ in entries), sum(o for *_, o in entries), 0.0, 0.0, {}, []
        for b, n, o in entries:
            x = 2 / 2.02 * 1.02**b if b > -math.inf else 0.0
            points += [b] * (math.floor((run + n) * 100 / docs + 0.5) - math.floor(run * 100 / docs + 0.5))
            run += n
            num += x * o if run <= math.ceil(0.95 * docs) else kinds[kind][2] * n if x else 0
            for name, p in (("lo", 0.2), ("mid", 0.5), ("hi", 0.8)):
                if run >= p * docs:
                    q.setdefault(name, x)
        return q | {"rate": num / over, "length": over / docs, "points": points, "over": over}

    def drawn(entries, outer):
        return sorted([*entries, *((b, 0.5, 0.5 * outer["length"]) for b in outer["points"])])

    good = [r for r, b in zip(rows, base, strict=True) if not b]
    fence = {}
    for kind, (_, _, unit) in kinds.items() if good else ():
        top = told(sketch([c for *_, c in good], kind), kind)
        for lang in {r[0] for r in good}:
            middle = told(drawn(sketch([c for x, _, c in good if x == lang], kind), top), kind)
            for source in {s for x, s, _ in good if x == lang}:
                q = told(drawn(sketch([c for x, s, c in good if (x, s) == (lang, source)], kind), middle), kind)
                fence[lang, source, kind] = q | {"rate": max(q["rate"], unit / top["over"])}
    out = []
    for (lang, source, c), failed in zip(rows, base, strict=True):
        ok = not failed
        for kind, (at, over, unit) in kinds.items() if ok else ():
            q, x = fence[lang, source, kind], c[at] / max(1, c[over])
            high = q["hi"] + 3 * (q["hi"] - q["mid"])
            if kind == "length":
                ok &= q["lo"] - 3 * (q["mid"] - q["lo"]) - 4 / c[0] ** 0.5 <= x <= high + 4 / c[0] ** 0.5
            else:
                k, r = x * max(1, c[over]) / unit, max(q["rate"], high) * max(1, c[over]) / unit
                ok &= k <= r or k * math.log(k / r) - k + r <= 16
        out.append((failed, ok))
    return out


def test_verdicts_are_those_of_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, small).collect()}
    counts = [plain_counts(d.text or "") for d in docs]
    for d, c, verdict in zip(docs, counts, plain_kept([(d.lang, d.source, c) for d, c in zip(docs, counts, strict=True)]), strict=True):
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c[:5]
        assert (r.base_failed, r.kept) == verdict
    assert len(got) == len(docs) and 0 < sum(not r.kept for r in got.values()) < len(docs)


def test_all_fences_move_between_sparse_groups(spark):
    """Two groups in which most documents have none of what is counted, one five times as often as the other."""
    names = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_echoes long"
    rows = []
    for source, every, length in (("few", 60, 4), ("some", 12, 6)):
        for k in range(900):
            one = int(k % every == 0)
            rows.append(("en", source, 400, 400 * length + k % 40, 2 * one, one, 16 * one, 30, one))
    got = {r.source: r for r in rules.fences(spark.createDataFrame(rows, names)).collect()}
    for ratio in rules.FENCES:
        few, some = (got[s][f"q_{ratio}"] for s in ("few", "some"))
        assert few.hi == some.hi == 0 and 0 < 3 * few.rate < some.rate
    assert got["few"].q_word_length.hi < got["some"].q_word_length.lo


def test_quality_rules(odd, none):
    rows = rules.quality_rules(odd).collect()
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    assert len(rows) == odd.count()
    for r in rows:
        w = brute.words(texts[r.doc_id][0])
        assert (r.n_words, r.n_repeat_words) == (len(w), brute.repeated_words(w))
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert rules.quality_rules(none).count() == 0
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_sketch_quantiles(spark):
    rows = spark.range(1, 1001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    merged = rules.sketches(rows, ["g"], {"x": (F.col("x"), F.lit(2))}).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("over").alias("over"))
    q = merged.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "over"))).alias("e")).select(rules.summary(F.col("e"), 1.0).alias("s")).first().s
    assert (q.docs, q.over) == (1000, 2000) and q.lo == pytest.approx(200, rel=0.011) and q.mid == pytest.approx(500, rel=0.011) and q.hi == pytest.approx(800, rel=0.011)
    assert q.num == pytest.approx(2 * 950 * 951 / 2 + 50, rel=0.011)


def test_rules_find_junk(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality_rules(spark, small).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    assert sum(good) / len(good) > 0.95


def test_rules_reject_junk_beyond_the_base_rules(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    bad = [r.kept for r in queries.op3_quality_rules(spark, small).collect() if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert bad and sum(bad) / len(bad) < 0.1


def test_fences_follow_groups(spark):
    names = "doc_id int, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_echoes long"
    prose = [(k, "en", "prose", 800 + k, 4000 + 5 * k, k % 2, 0, 0, 40, k % 3) for k in range(400)]
    code = [(1000 + k, "en", "code", 300, 1500 + k % 30, 150 + k % 60, 0, 0, 40, 0) for k in range(150)]  # fewer rows than prose, own kind
    junk = [(2000, "en", "prose", 2000, 10000, 200, 0, 0, 40, 0), (2001, "en", "prose", 2000, 10000, 0, 12, 0, 40, 0), (2002, "en", "prose", 2000, 10000, 0, 0, 400, 40, 0), (2003, "en", "prose", 2000, 10000, 0, 0, 0, 40, 400)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(prose + code + junk, names)).collect()}
    assert all(got[r[0]] == (False, False) for r in junk)
    assert all(got[r[0]] == (False, True) for r in prose + code)


# hierarchical Bayes


def test_bayes(spark, odd, none, small):
    labels = spark.createDataFrame([(3, 1), (5, 0), (6, 0), (12, 1), (12, 0), (None, 1), (13, None)], "doc_id long, quality int")
    rows = bayes.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in rows)
    assert bayes.classify(none, labels).count() == 0
    assert bayes.classify(odd, labels.limit(0)).count() == odd.count()


def test_site_rates_leave_each_row_out(spark):
    draw = np.random.default_rng(8)
    rows = [(i, ["x y. "[: 1 + i % 4] * 9, "one two three four five " * 4][i % 2], f"h{min(i % 17, 9)}", f"p{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = {i: int(draw.random() < 0.6) for i in range(0, 90, 2)}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    found = {r.doc_id: r for r in bayes.classify(docs, labels).collect()}
    prior = (sum(marks.values()) + 1) / (len(marks) + 2)
    good = {i: marks.get(i, 1 / (1 + np.exp(-r.evidence) * (1 - prior) / prior)) for i, r in found.items()}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, h, p in rows:
        hosts[h].append(i)
        paths[h, p].append(i)
    rate = (sum(good.values()) + 1) / 92

    def strength(sites, means):
        sites = [(sum(good[i] for i in s), len(s), m) for s, m in zip(sites, means, strict=True) if len(s) > 1]
        n, within = sum(k for _, k, _ in sites), sum(k * m * (1 - m) for _, k, m in sites)
        between = max(sum(k * (g / k - m) ** 2 - m * (1 - m) for g, k, m in sites), 0) / n
        return min(max(within / n / between - 1 if between else 1e4, 2), 1e4)

    a = strength(hosts.values(), [rate] * len(hosts))
    means = [(sum(good[i] for i in hosts[h]) + a * rate) / (len(hosts[h]) + a) for h, _ in paths]
    b = strength(paths.values(), means)
    for i, _, h, p in rows:
        host = (sum(good[j] for j in hosts[h] if j != i) + a * rate) / (len(hosts[h]) - 1 + a)
        path = (sum(good[j] for j in paths[h, p] if j != i) + b * host) / (len(paths[h, p]) - 1 + b)
        assert found[i].host_rate == pytest.approx(host) and found[i].path_rate == pytest.approx(path)
        assert found[i].quality == pytest.approx(1 / (1 + np.exp(-found[i].evidence) * (1 - path) / path))


def test_quality_on_held_out_labels(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    out = langid.held_out(F.col("doc_id"))
    found = {r.doc_id: r.kept for r in bayes.classify(docs, labels.filter(~out)).collect()}
    held = [(r.quality, found[r.doc_id]) for r in labels.filter(out).collect() if r.doc_id in found]
    good, bad = [k for y, k in held if y == 1], [k for y, k in held if y == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 1.0)] * 300 + [("bad", "p", 0.0)] * 300 + [("one", "p", 0.0)]
    got = {r.host: r.path_rate for r in bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert got["big"] > 0.95 and got["bad"] < 0.05 and 0.05 < got["one"] < 0.6


# language


def test_language(spark, odd, none, small):
    rows = queries.op6_language(spark, small).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(out) > 20 and sum(out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert langid.identify(none).count() == 0


def test_mixture_shares():
    draw = np.random.default_rng(1)
    logs = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]).repeat(50, axis=0) / 50)
    both = np.concatenate([draw.integers(0, 50, 600), draw.integers(50, 100, 400)])
    share = langid.mixture(both, logs)
    assert share[0] == pytest.approx(0.63, abs=0.06) and share.sum() == pytest.approx(1)
    assert langid.mixture(draw.integers(0, 50, 45), np.log(np.array([[1 / 50, 1e-6]]).repeat(50, axis=0))).tolist() == [1.0, 0.0]


def test_mixture_of_many_languages():
    draw = np.random.default_rng(7)
    large, rare, grams = 4, 10, 600  # four languages of many rows, ten of few, with the floor of train()
    real = draw.dirichlet(np.full(grams, 0.1), large + rare)
    counts = np.stack([draw.multinomial(2_000_000 if k < large else 20_000, w) for k, w in enumerate(real)], axis=1) + 0.5
    logs = np.log(counts / counts.sum(axis=0))
    for first, share in ((0.6, 0.4), (0.8, 0.2)):
        for a, b in ((0, 1), (2, 3), (3, 0), (5, 1)):
            text = np.concatenate([draw.choice(grams, int(2000 * first), p=real[a]), draw.choice(grams, int(2000 * share), p=real[b])])
            got = langid.mixture(text, logs)
            assert np.flatnonzero(got).tolist() == sorted((a, b)) and got[b] == pytest.approx(share, abs=0.06)


# toxicity


def test_ordinal_fit_orders_grades():
    draw = np.random.default_rng(2)
    n = 600
    x = draw.normal(size=(n, 3))
    score = 2 * x[:, 0] - x[:, 1] + draw.logistic(size=n)
    y = (score > 0).astype(int) + (score > 2)
    w, t = toxicity.fit_ordinal(np.repeat(np.arange(n), 3), np.tile(np.arange(3), n), x.ravel(), y, 3, 3)
    assert w[0] == pytest.approx(2, abs=0.5) and w[1] == pytest.approx(-1, abs=0.4) and abs(w[2]) < 0.3 and t[1] - t[0] == pytest.approx(2, abs=0.6)


def test_toxicity(spark, odd, none, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.grade_documents(docs, labels).collect()
    assert len(rows) == docs.count() and {r.grade for r in rows} <= {0, 1, 2, 3}
    assert all((r.grade > 0) <= r.toxic and 0 <= r.severity <= 3 for r in rows)
    assert sum(r.toxic for r in rows if marks.get(r.doc_id) == 0) == 0
    few = spark.createDataFrame([(3, 1), (5, 0), (12, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.grade_documents(odd, few).count() == odd.count()
    assert toxicity.grade_documents(odd, few.limit(0)).filter("toxic").count() == 0
    assert toxicity.drop_toxic(none, few).columns == none.columns


def test_toxicity_on_held_out_labels(spark):
    if not os.path.isdir(LARGEST):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{LARGEST}/documents.parquet"), spark.read.parquet(f"{LARGEST}/labels.parquet")
    out = langid.held_out(F.col("doc_id"))
    found = {r.doc_id: r.toxic for r in toxicity.grade_documents(docs, labels.filter(~out)).collect()}
    held = [(r.toxic, found[r.doc_id]) for r in labels.filter(out).collect() if r.doc_id in found]
    bad, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert len(bad) > 100 and sum(bad) / len(bad) > 0.85 and sum(clean) / len(clean) < 0.02


def test_labels_of_several_levels_are_learned(spark):
    texts = ["plain calm words here", "mild stuff words", "mild stuff harsh tone", "harsh tone awful vile"]
    rows = [(i, f"{texts[i % 4]} filler{i % 7} filler{i % 5}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(240)], "doc_id long, toxic int")
    found = toxicity.grade_documents(docs, labels).collect()
    assert sum(r.grade == r.doc_id % 4 for r in found) > 220
    model = toxicity.train(docs, labels.withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()


# near duplicates


def test_near_duplicates(spark, odd, none):
    base = [f"t{k}" for k in range(100)]
    texts = [" ".join(base)]
    for k in range(40):  # chains and stars of edits on both sides of the limit
        w = list(base)
        for j in range(k % 5):
            w[(k * 13 + j * 29) % 100] = f"e{k}{j}"
        texts.append(" ".join(w).upper() if k % 2 else " ".join(w))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "one two"), (203, "ONE two"), (204, "one")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    for words in (4, 5):
        want = brute.near_duplicates(rows, words)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, words=words).collect()}
        assert got == want
    assert neardup.near_duplicates(odd).count() == odd.count()
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null or text is null").count() == 2


@pytest.mark.parametrize("with_base", [True, False])
def test_near_duplicates_of_a_large_group(spark, with_base):
    draw = np.random.default_rng(with_base)
    base = [f"t{k}" for k in range(90)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, 160):  # most pairs are below the limit; some edits recur, some cut or add words
        w = list(base)
        for j in draw.choice(90, i % 8, replace=False).tolist():
            w[j] = f"e{draw.integers(3)}" if j % 3 else f"own{i}"
        rows.append((i, " ".join(w[: 90 - i % 5 * (i % 3)] + ["tail"] * (i % 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, words=4).collect()}
    assert got == brute.near_duplicates(rows, 4)
    assert len({c for _, c in got.values()}) > 20


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (9, b + " more"), (11, "other text")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _gone int")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (11, 11)}
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 11]


def test_near_duplicates_of_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_near_duplicates(spark, small).collect()}
    assert got == brute.near_duplicates(docs, 4)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.component for r in neardup.components(links).collect() if r.node <= 40} == {0}


# chat


def test_reply_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "a<b & [x]"), ("t", 2, 1, 5.0, "assistant", "</s>"), ("t", 3, 1, 1.0, "assistant", "low"), ("t", 4, 2, 1.0, "user", None), (None, 1, 9, 0.0, "a|>b", "&lt;"), ("ring", 1, 2, 0.0, "u", "x"), ("ring", 2, 1, 0.0, "u", "x"), ("t", 5, 3, 1.0, None, "y")]
    tree = spark.createDataFrame([(*r, "extra") for r in rows], "tree string, node long, parent long, score double, role string, text string, rank string")
    out = {(r.tree, r["rank"]): r for r in chat.format_trees(tree, branches=2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert set(out) == {("t", 1), ("t", 2), (None, 1)}
    assert [tuple(x) for x in out["t", 1].turns] == [("user", "a<b & [x]"), ("assistant", "</s>"), ("user", "")]
    assert out["t", 2].leaf == 5 and [tuple(x) for x in out[None, 1].turns] == [("a|>b", "&lt;")]
    (span,) = out["t", 1].spans
    assert out["t", 1].formatted[span.start : span.start + span.length] == "&lt;/s>"
    assert chat.format_trees(tree.limit(0)).count() == 0


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_of_random_trees(spark, branches):
    draw = random.Random(5)
    parents = {}
    for tree in range(6):
        for node in range(1, 40):
            parents[tree, node] = draw.randrange(0, node) or None
    parents[0, 7], parents[0, 8] = 8, 7  # a ring, with all that hangs on it
    parents[1, 30] = 99  # a parent that isn't there
    scores = {k: draw.choice([None, 0.5, 1.0, 2.25]) for k in parents}
    rows = [(t, n, p, scores[t, n]) for (t, n), p in parents.items()]
    rows += [(2, 5, parents[2, 5], 3.0), (3, None, 1, 9.0)]  # a repeated node, a null one
    score = {k: v or 0.0 for k, v in scores.items()} | {(2, 5): ((scores[2, 5] or 0.0) + 3.0) / 2}
    want = {}
    for tree in range(6):
        found = []
        for leaf in set(range(1, 40)) - {p for (t, _), p in parents.items() if t == tree}:
            path = [leaf]
            while (up := parents.get((tree, path[-1]))) and (tree, up) in parents and len(path) < 50:
                path.append(up)
            if len(path) < 50:
                found.append((-sum(score[tree, n] for n in path) / len(path), leaf, path))
        for rank, (mean, leaf, path) in enumerate(sorted(found)[:branches], 1):
            want |= {(tree, leaf, n): (rank, -mean, dist) for dist, n in enumerate(path)}
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {(r.tree, r.leaf, r.node): (r["rank"], pytest.approx(r.score), r.dist) for r in chat.tree_paths(nodes, branches).collect()}
    assert got == want


def test_chat_digests(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op9_chat(spark, small).collect()}
    for k, v in by.items():
        loss = "".join(t for r, t in v if r == "assistant")
        assert got[k] == (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss), sha(loss))
    assert len(got) == len(by)


# fingerprints


def test_fingerprints(spark, odd, none):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(rows).collect()}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_edited == 1) == (got[i].fingerprint == got[i].edited_fingerprint)
    texts = collections.defaultdict(set)
    for i, t in docs:
        texts[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in texts.values()) and len({f for v in texts.values() for f in v}) == len(texts)
    every = fingerprint.edited_fingerprints(odd).collect()
    assert len(every) == odd.count()
    for r in every:
        assert (r.near_next is None) == (r.doc_id is None)
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_fingerprints_are_those_of_a_plain_version(spark, small):
    """Every column, on a table with texts far longer than a sketch; likeness is exact up to the sketch and near the share beyond."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    draw = np.random.default_rng(5)
    top = max(i for i, _ in rows)
    lines = [" ".join(f"w{k}" for k in draw.integers(0, 5000, 6)) + "\n" for _ in range(6000)]
    long = ["".join(lines[:3000]), "".join(lines[1000:5000]), "".join(lines[:2500] + lines[5500:])]
    rows += [(top + 1 + k, t) for k, t in enumerate(long)]
    docs = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    cut = 0
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (want, mine), (want_edited, theirs), (_, nexts) = (brute.fingerprint(x, fingerprint.SKETCH) for x in (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), want, want_edited)
        for near, other, same in ((r.near_edited, theirs, t == edited), (r.near_next, nexts, t == after)):
            small_enough = max(len(mine), len(other)) <= fingerprint.SKETCH
            assert near == pytest.approx(1 if same else brute.share(mine, other), abs=1e-9 if small_enough else 0.05)
            cut += not small_enough
    assert cut >= 5


def test_cut_fingerprints_add_and_take_away(spark):
    """Sums and differences of cut fingerprints hold what is complete up to the lesser bound."""
    lines = [f"line {k}\n" for k in range(6000)]
    df = spark.createDataFrame([("".join(lines), "".join(lines[:4000]), "".join(lines[4000:]))], "whole string, a string, b string")
    f = {c: fingerprint.add_up(F.col(c)) for c in df.columns}
    df = df.select(*(fingerprint.vectors(F.col(c)).alias(c) for c in df.columns)).select(*(f[c].alias(c) for c in df.columns))
    row = df.select("whole", "b", fingerprint.combine(F.col("a"), F.col("b")).alias("both"), fingerprint.combine(F.col("whole"), F.col("a"), -1).alias("rest")).first()
    assert row.both == row.whole and len(row.whole.masses) == fingerprint.SKETCH
    upto = [m for m in row.b.masses if m.cell <= row.rest.bound]
    assert (row.rest.lanes, row.rest.total, row.rest.masses) == (row.b.lanes, row.b.total, upto) and len(upto) > 200


def test_fingerprints_add_and_take_away(spark):
    df = spark.createDataFrame([("one. two. three\nfour\n", "four\nthree\none. two. ", "three\nfour\n", "one. two. ")], "whole string, other string, a string, b string")
    f = {c: fingerprint.add_up(F.col(c)) for c in df.columns}
    row = df.select(*(fingerprint.vectors(F.col(c)).alias(c) for c in df.columns)).select(f["whole"].alias("f_whole"), f["other"].alias("f_other"), f["b"].alias("f_b"), fingerprint.combine(f["a"], f["b"]).alias("f_sum"), fingerprint.combine(f["whole"], f["a"], -1).alias("f_rest")).first()
    assert row.f_whole == row.f_other == row.f_sum and row.f_rest == row.f_b


def test_likeness_of_long_texts(spark):
    draw = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5000)])
    say = lambda n: [" ".join(words[draw.integers(0, 5000, 8)]) + ". " for _ in range(n)]
    a, b, rest = say(1500), say(1500), say(750)
    plain = [w for x in a[:200] for w in x.replace(".", "").split()]
    half = plain[:800] + [w for x in b[:100] for w in x.replace(".", "").split()]
    blank = "\n" * 300
    texts = [("".join(a), "".join(b), 0.0), ("".join(a), "".join(a[:750] + rest), 1 / 3), (" ".join(plain), " ".join(half), 1 / 3), (blank + "".join(a[:50]), blank + "".join(b[:50]), 300 / (300 + sum(map(len, a[:50] + b[:50]))))]
    df = spark.createDataFrame(texts, "a string, b string, want double").select("want", fingerprint.vectors(F.col("a")).alias("p"), fingerprint.vectors(F.col("b")).alias("q"))
    df = df.select("want", fingerprint.add_up(F.col("p")).alias("f"), fingerprint.add_up(F.col("q")).alias("g"))
    docs = spark.createDataFrame([(k, "".join(x)) for k, x in enumerate((a, b))], "doc_id long, text string")
    for r in df.select("want", fingerprint.likeness(F.col("f"), F.col("g")).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=0.04)
    assert {r.doc_id: r.near_next for r in fingerprint.edited_fingerprints(docs).collect()} == {0: 0.0, 1: 0.0}


# pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, small), name)
        steps[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(steps[name]) <= ids
        ids = set(steps[name])
    survivors = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.doc_id in set(steps["quality_rules"])]
    assert set(steps["near_duplicates"]) == {d for d, (_, c) in brute.near_duplicates(survivors, 5).items() if d == c}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(steps["mixing"])
