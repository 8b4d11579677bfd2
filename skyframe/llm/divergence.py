"""How the sources of each language differ from it and from each other in their words, by sorted runs.

Each task reads (lang, term, source, document) of its texts, sorts them and scans the runs: a run of a document counts it once for its
term, and what is left is a partial run (lang, term, source, documents, occurrences). Partial runs are dealt by language and
term and sorted again; a second scan adds those of a source up, drops terms with too few documents, and holds no more than the
sources of one term. With the totals of groups and languages each count becomes a smoothed share in whole billionths, and a third scan
over the runs of a term emits the partial sums of pairs of sources. Sources that lack a term have the same share of it whatever the
term is, so that only sources that have it meet in its run; the rest follows from how many terms of a source have which count.

A row is a document. Null text, lang and source count as '', a source without any term is a group too, repeated rows count as often,
other columns are ignored, and an empty table gives an empty one. Terms are ASCII letters and all other non-ASCII characters, A-Z
lower-cased. Arithmetic is exact: counts fit in 64 bits, products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
_LETTERS = {*range(65, 91), *range(97, 123)}
_TABLE = common.byte_table([b for b in range(128) if b not in _LETTERS], lower=True)
_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n_docs", pa.int64()), ("n", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("head", pa.int64())])
_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("shared", pa.int64()), ("gain", pa.int64())])
#: So many pairs of a scan are computed at once.
_BLOCK = 1 << 20


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def partial_runs(batch: pa.RecordBatch) -> pa.Table:
    """The partial runs of a batch (lang, source, text as bytes), from its sorted (term, group, document) triples."""
    doc, words = common.word_table(batch.column("text"), _TABLE)
    if not len(words):
        return _PARTIAL.empty_table()
    terms, langs, sources = words.dictionary_encode(), batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    of = lambda coded: coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_docs, n_sources = batch.num_rows, len(sources.dictionary)
    group = of(langs) * n_sources + of(sources)
    n_groups = len(langs.dictionary) * n_sources
    key = np.sort((of(terms) * n_groups + group[doc]) * n_docs + doc)
    first = _starts(key)  # of each document of a run
    run = key[first] // n_docs
    begin = _starts(run)
    ends = np.append(first[begin[1:]], len(key))
    run = run[begin]
    pick = lambda coded, k: coded.dictionary.take(pa.array(k)).cast(pa.string())
    group = run % n_groups
    columns = [pick(langs, group // n_sources), pick(terms, run // n_groups), pick(sources, group % n_sources), pa.array(np.diff(np.append(begin, len(first)))), pa.array(ends - first[begin])]
    return pa.Table.from_arrays(columns, schema=_PARTIAL)


def _changes(t: pa.Table, columns: Iterable[str]) -> np.ndarray:
    """Which rows of a sorted table differ from the row before in the columns; the first does."""
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (t.column(x).combine_chunks() for x in columns)], axis=0)
    return new


def _whole_terms(batches: Iterable[pa.RecordBatch], shorten: Callable[[pa.Table], pa.Table]) -> Iterator[pa.Table]:
    """The rows of batches sorted by (lang, term), as tables that cut no term; shorten: makes the rows of the term that is still open fewer."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if t.num_rows:
            last = int(np.flatnonzero(_changes(t, ("lang", "term")))[-1])
            if last:
                yield t.slice(0, last).combine_chunks()
            held = shorten(t.slice(last))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _added(t: pa.Table) -> pa.Table:
    """A sorted table with one row for each run of (lang, term, source)."""
    if not t.num_rows:
        return t
    at = np.flatnonzero(_changes(t, ("lang", "term", "source")))
    sums = {c: pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in ("n_docs", "n")}
    return pa.table({c: sums.get(c, t.column(c).take(pa.array(at))) for c in t.column_names}, schema=t.schema)


def kept_terms(partial: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n, total, head) of terms in at least so many documents of their language: occurrences in the source and in the language; head is 1 in one row of a term, else 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_terms(batches, _added):
            t = _added(t)
            heads = _changes(t, ("lang", "term"))
            at = np.flatnonzero(heads)
            size = np.diff(np.append(at, t.num_rows))
            docs, total = (np.repeat(np.add.reduceat(t.column(c).to_numpy(), at), size) for c in ("n_docs", "n"))
            out = pa.Table.from_arrays([*(t.column(c) for c in ("lang", "term", "source", "n")), pa.array(total), pa.array(heads.astype(np.int64))], schema=_KEPT)
            yield from out.filter(pa.array(docs >= least)).combine_chunks().to_batches()

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, _ddl(_KEPT))


def _f(p, q):
    """The whole part of (p - q)^2 / (p + q), of arrays of whole numbers up to 10^9 + 1."""
    return (p - q) ** 2 // (p + q)


def divergence(p: Column, q: Column) -> Column:
    """The same for columns."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_runs(facts: DataFrame) -> DataFrame:
    """Partial sums (lang, a, b, shared, gain), a < b, over the runs of terms of (lang, term, source, p, p0): how many terms both have, and how much those add to the sums that take them as lacking in one of both."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for t in _whole_terms(batches, lambda t: t):
            at = np.flatnonzero(_changes(t, ("lang", "term")))
            size = np.diff(np.append(at, t.num_rows))
            p, p0 = (t.column(c).to_numpy() for c in ("p", "p0"))
            langs, sources = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
            n = len(langs.dictionary) * len(sources.dictionary)
            for i, j in _within(at, size):
                gain = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
                key = code[i] * n + code[j]
                order = np.argsort(key, kind="stable")
                key, gain = key[order], gain[order]
                begin = _starts(key)
                a, b = key[begin] // n, key[begin] % n
                name = lambda coded, k: coded.dictionary.take(pa.array(k))
                m = len(sources.dictionary)
                yield pa.Table.from_arrays([name(langs, a // m), name(sources, a % m), name(sources, b % m), pa.array(np.diff(np.append(begin, len(key)))), pa.array(np.add.reduceat(gain, begin))], schema=_PAIR)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.merged_runs(tables(batches), ["lang", "a", "b"], ["shared", "gain"]):
            yield from t.cast(_PAIR).combine_chunks().to_batches()

    dealt = facts.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, _ddl(_PAIR))


def _within(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places i < j within each of the runs that begin at `at`, in blocks of about _BLOCK."""
    for k in np.unique(size[size > 1]).tolist():
        begin = at[size == k]
        if k * (k - 1) // 2 > _BLOCK:  # a row at a time
            for b in begin.tolist():
                for i in range(b, b + k - 1):
                    j = np.arange(i + 1, b + k)
                    yield np.full(len(j), i), j
            continue
        x, y = np.triu_indices(k, 1)
        many = max(1, _BLOCK // len(x))
        for c in range(0, len(begin), many):
            rows = begin[c : c + many, None]
            yield (rows + x).ravel(), (rows + y).ravel()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + the whole billionths of (n + 2) / (total + 2 * terms)."""
    wide = lambda c: c.cast("decimal(28,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the divergence from each other source of it (part pair), and the `top` terms that it uses more than the language does (part term)."""
    common.ready(docs.sparkSession)
    named = [F.coalesce(F.col(c), F.lit("")).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.merged_runs(map(partial_runs, common.small_batches(batches)), ["lang", "term", "source"], ["n_docs", "n"]):
            yield from t.cast(_PARTIAL).combine_chunks().to_batches(max_chunksize=1 << 14)

    partial = docs.select(*named, common.utf8(F.col(text)).alias("text")).mapInArrow(read, _ddl(_PARTIAL))
    kept = common.materialise(kept_terms(partial, least), "kept-terms")
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("head").alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *map(zero, ("n", "k", "lang_n", "v")))
    some = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v")))
    groups = common.materialise(groups.withColumn("p0", some), "groups")

    facts = kept.join(groups.withColumnRenamed("n", "group_n"), ["lang", "source"])
    facts = facts.select("lang", "term", "source", "p0", _share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    over = facts.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)

    # for each source, what its terms add where the other lacks them
    counts = facts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.col("k").alias("item_k"))
    alone = counts.join(others, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * divergence(F.col("p"), F.col("item_p0"))).alias("alone"))
    shared = pair_runs(facts).groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"), F.sum("gain").alias("gain"))
    pairs = groups.select("lang", "source", "k", "v", "p0").join(others, "lang").filter("source <> item").withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("back"))
    pairs = pairs.join(alone, ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left").join(shared, ["lang", "a", "b"], "left")
    none = (F.col("v") - F.col("k") - F.col("item_k")) * divergence(F.col("p0"), F.col("item_p0"))
    value = F.when(F.col("v") > 0, none + sum((F.coalesce(F.col(c), F.lit(0)) for c in ("alone", "back", "gain")), F.lit(0))).otherwise(0)
    pairs = pairs.select("lang", "source", "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(w))
    out = [t.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, t in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])
