"""Quality rules with adaptive thresholds per language and source.

Each document has some base counts and five ratios (the last: words equal to the word before). The ratios of the documents that pass
the base rules go into mergeable quantile sketches, one per language and source: log-spaced buckets with the number of their documents
and of the words or lines that those have. Sketches merge by adding, quantiles are within 1 %, and the order of rows can't change
them. A group's sketch becomes one row, from which array functions take quantiles and the base rate: what the lower part KEEP of the
documents has, and one unit for each of the others that has any, over all words. POINTS quantiles of the language count in a group's sketch,
as WEIGHT documents, and as many of all documents in a language's, so that small groups go over into those around them smoothly.

A document stays if each of its counts is likely enough at its group's rate: the greater one of the base rate and of the quantile fence
high + WIDTH * (high - median). For k units where a text of that length would have r, k ln(k / r) - k + r bounds the negative logarithm of
the chance to have so many (Chernoff's bound of a Poisson tail); it may be EVIDENCE at most. The mean word length has quantile fences.

Words are [^\\x20\\x09-\\x0D]+. Null and empty texts have no words and fail the base rules; null languages and sources are groups too; a
row is a document, so that repeated rows count as often; extra columns and their names don't matter; an empty table gives an empty
one. Texts are counted whole, in about 100 bytes a word of the longest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
SPAN = 8
GAMMA = 1.02
LOW, HIGH, WIDTH = 0.2, 0.8, 3.0
KEEP, EVIDENCE = 0.95, 16.0
#: So many quantiles of the group around, as so many documents together, count in a group's sketch.
POINTS, WEIGHT = 100, 50
#: The bucket of zeros.
ZERO = -(2**31)
#: ratio -> (what it is counted over, units that come at once by chance); symbols come in pairs, and a passage of SPAN words counts twice
FENCES = {"symbol_ratio": ("n_words", 2), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", 2 * SPAN), "echo_ratio": ("n_words", 1)}
#: The mean word length has a lower fence too, and strays by so much / sqrt(n) over n words.
LENGTH_SLACK = 4.0
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes")
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1 for k in range(SPAN)], np.uint64)


_WORDS, _LINES = common.byte_table(common.SPACES), common.byte_table(b"\n")


def repeated_words(doc: np.ndarray, ids: np.ndarray, n_docs: int, span: int = SPAN) -> np.ndarray:
    """For each text, how many of its words lie in windows of `span` that occur in it twice or more; ids: an integer from 0 for each word, doc: its text, ascending."""
    n = max(0, len(ids) - span + 1)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    key = reduce(np.add, (np.right_shift(mixed[k : k + n], np.uint64(k)) * _MIX[k % SPAN] for k in range(span)))
    key ^= (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(doc[:n] == doc[span - 1 : span - 1 + n])
    inside = inside[np.argsort(key[inside], kind="stable")]
    same = key[inside[1:]] == key[inside[:-1]]
    at = inside[np.append(same, False) | np.append(False, same)] if len(inside) else inside  # equal windows have equal keys
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(at):
        rows = np.column_stack([doc[at], *(ids[at + k] for k in range(span))])
        order = np.lexsort(rows.T[::-1])
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        at = at[order[np.append(same, False) | np.append(False, same)]]
        np.add.at(covered, at, 1)
        np.subtract.at(covered, at + span, 1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)


def batch_counts(texts: pa.Array) -> list[np.ndarray]:
    """The counts of _COUNTS for a batch of UTF-8 texts (binary, without nulls)."""
    n = len(texts)
    doc, words = common.word_table(texts, _WORDS)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.bincount(doc, pc.utf8_length(words.cast(pa.large_string())).to_numpy(zero_copy_only=False), n).astype(np.int64)
    line_doc, lines = common.word_table(texts, _LINES)
    solid = pc.binary_length(pc.ascii_trim_whitespace(lines.cast(pa.large_string()))).to_numpy(zero_copy_only=False) > 0
    line_doc, lines = line_doc[solid], lines.filter(pa.array(solid)).dictionary_encode()
    key = np.sort(line_doc * max(1, len(lines.dictionary)) + lines.indices.to_numpy(zero_copy_only=False))
    again = key[1:][key[1:] == key[:-1]] // max(1, len(lines.dictionary))
    echo = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts.to_pylist()], np.int64)
    per = lambda at: np.bincount(at, minlength=n)
    return [per(doc), chars, symbols, per(again), repeated_words(doc, ids, n), per(line_doc), per(doc[1:][echo])]


_STRUCT = pa.struct([(c, pa.int64()) for c in _COUNTS])


def _counts_of(texts: pa.Array) -> pa.Array:
    parts = []
    for b in common.small_batches([pa.RecordBatch.from_arrays([texts], ["text"])]):
        parts.append(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in batch_counts(b.column(0))], fields=list(_STRUCT)))
    return pa.concat_arrays(parts) if parts else pa.array([], _STRUCT)


def counts(text: Column) -> Column:
    """A struct of a text's counts, all 0 for null."""
    return F.arrow_udf(_counts_of, "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ">")(common.utf8(text))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _over(name: str) -> Column:
    return F.greatest(F.col(FENCES[name][0] if name in FENCES else "n_words"), F.lit(1).cast("long"))


def _ratios() -> dict[str, Column]:
    counted = {"symbol_ratio": "n_symbols", "word_length": "word_chars", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words", "echo_ratio": "n_echoes"}
    return {name: F.col(c) / _over(name) for name, c in counted.items()}


def sketches(rows: DataFrame, by: list[str], ratios: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(by..., ratio, bucket, n, over) for ratios (value, what it is counted over): documents of each log-spaced bucket, and the sum of what theirs are counted over."""
    pair = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), v.cast("double").alias("x"), over.cast("long").alias("over")) for k, (v, over) in ratios.items())))
    bucket = F.when(F.col("_p.x") > 0, F.ceil(F.log(F.col("_p.x")) / float(np.log(GAMMA)))).otherwise(ZERO).cast("int")
    flat = rows.select(*by, pair.alias("_p")).select(*by, "_p.ratio", bucket.alias("bucket"), "_p.over")
    return flat.groupBy(*by, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("over").alias("over"))


def _value(bucket: Column) -> Column:
    return F.when(bucket == ZERO, 0.0).otherwise(2.0 / (GAMMA + 1) * F.pow(F.lit(GAMMA), bucket))


def summary(entries: Column, unit: float) -> Column:
    """A struct of docs, over, num (what the base rate counts), lo, mid, hi and points (buckets at POINTS even steps) of a sketch: an array of (bucket, n, over), in order of buckets."""
    whole = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["n"])
    zero = F.lit(0.0)
    names = ("over", "num", "run", "lo", "mid", "hi")
    start = F.struct(whole.alias("docs"), *(zero.alias(c) for c in names), F.array().cast("array<int>").alias("points"))

    def step(s: Column, e: Column) -> Column:
        x, run, docs = _value(e["bucket"]), s["run"] + e["n"], s["docs"]
        at = lambda q, name: F.when((s["run"] < q * docs) & (run >= q * docs), x).otherwise(s[name]).alias(name)
        passed = lambda r: F.floor(r * POINTS / docs + 0.5).cast("int")
        num = F.when(run <= F.ceil(KEEP * docs), x * e["over"]).when(x > 0, unit * e["n"]).otherwise(0.0)
        points = F.concat(s["points"], F.array_repeat(e["bucket"], passed(run) - passed(s["run"])))
        return F.struct(docs.alias("docs"), (s["over"] + e["over"]).alias("over"), (s["num"] + num).alias("num"), run.alias("run"), at(LOW, "lo"), at(0.5, "mid"), at(HIGH, "hi"), points.alias("points"))

    return F.aggregate(entries, start, step)


def _of_ratio(name: str) -> Callable[[Column], Column]:
    return lambda e: e["ratio"] == name


def _level(leaf: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: its sketch of each ratio, e_<ratio>, an array of (bucket, n, over)."""
    merged = leaf.groupBy(*by, "ratio", "bucket").agg(F.sum("n").cast("double").alias("n"), F.sum("over").cast("double").alias("over"))
    rows = merged.groupBy(*by).agg(F.collect_list(F.struct("ratio", "bucket", "n", "over")).alias("_e"))
    plain = lambda e: F.struct(e["bucket"].alias("bucket"), e["n"].alias("n"), e["over"].alias("over"))
    return rows.select(*by, *(F.sort_array(F.transform(F.filter("_e", _of_ratio(k)), plain)).alias(f"e_{k}") for k in _ratios()))


def _drawn(own: str, outer: str) -> Column:
    """The sketch `own` with WEIGHT documents that have the distribution and the average length of the summary `outer`."""
    s, share = F.col(outer), WEIGHT / POINTS
    entry = lambda b: F.struct(b.alias("bucket"), F.lit(share).alias("n"), (s["over"] / s["docs"] * share).alias("over"))
    return F.sort_array(F.concat(own, F.transform(s["points"], entry)))


def fences(rows: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Per group, a struct lo, mid, hi, rate for each ratio, q_<ratio>, of its sketch with those around it; rows: documents that pass the base rules.

    A rate is one unit in all that was measured at least, so that none is 0.
    """
    units = {k: float(FENCES.get(k, (0, 1))[1]) for k in _ratios()}
    leaf = common.materialise(sketches(rows, list(by), {k: (v, _over(k)) for k, v in _ratios().items()}), "sketches")
    told = lambda df, keep: df.select(*keep, *(summary(F.col(f"e_{k}"), u).alias(f"s_{k}") for k, u in units.items()))
    mixed = lambda df, keep: df.select(*keep, *(_drawn(f"e_{k}", f"t_{k}").alias(f"e_{k}") for k in units))
    least = [f"least_{k}" for k in units]
    top = told(_level(leaf.withColumn("_one", F.lit(1)), ["_one"]), ["_one"]).withColumnsRenamed({f"s_{k}": f"t_{k}" for k in units})
    top = top.select("*", *((u / F.col(f"t_{k}")["over"]).alias(f"least_{k}") for k, u in units.items()))
    middle = _level(leaf, [by[0]]).withColumn("_one", F.lit(1)).join(top, "_one")
    middle = told(mixed(middle, [by[0], *least]), [F.col(by[0]).alias("_outer"), *least]).withColumnsRenamed({f"s_{k}": f"t_{k}" for k in units})
    found = _level(leaf, list(by)).join(middle, F.col(by[0]).eqNullSafe(F.col("_outer")))
    found = told(mixed(found, [*by, *least]), [*by, *least])
    last = lambda k: F.struct(*(F.col(f"s_{k}")[c].alias(c) for c in ("lo", "mid", "hi")), F.greatest(F.col(f"s_{k}")["num"] / F.col(f"s_{k}")["over"], f"least_{k}").alias("rate")).alias(f"q_{k}")
    return found.select(*by, *map(last, units))


def within(prefix: str = "q_") -> Column:
    """Whether no ratio of a row lies beyond its group's fences."""
    ratios = _ratios()
    q, x = F.col(prefix + "word_length"), ratios["word_length"]
    slack = LENGTH_SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    ok = (x <= q["hi"] + WIDTH * (q["hi"] - q["mid"]) + slack) & (x >= q["lo"] - WIDTH * (q["mid"] - q["lo"]) - slack)
    for name, (_, unit) in FENCES.items():
        q, units = F.col(prefix + name), _over(name) / F.lit(float(unit))
        k, r = ratios[name] * units, F.greatest(q["rate"], q["hi"] + WIDTH * (q["hi"] - q["mid"])) * units
        ok &= (k <= r) | (k * F.log(k / r) - k + r <= EVIDENCE)
    return ok


def judge(rows: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Adds base_failed and kept to rows that have the counts and the two group columns (null is a group too)."""
    limits = fences(rows.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))), by)
    limits = limits.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), *(f"q_{k}" for k in _ratios()))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)))
    joined = rows.join(limits, match, "left").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    joined = joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within(), F.lit(True)))
    return joined.drop("_0", "_1", *(f"q_{k}" for k in _ratios()))


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for each row of docs; null texts count as empty and fail the base rules."""
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), counts(F.col(text)).alias("c"))
    rows = common.materialise(rows.select("doc_id", "lang", "source", "c.*"), "rule-counts")
    return judge(rows).select("doc_id", *_COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: counts are taken once, beside the rows, and joined with the fences."""
    common.ready(docs.sparkSession)
    whole = common.fresh(docs, "_whole")
    rows = docs.select(F.struct(*docs.columns).alias(whole), F.col(lang).alias("lang"), F.col(source).alias("source"), counts(F.col(text)).alias("_c"))
    rows = common.materialise(rows.select(whole, "lang", "source", "_c.*"), "rule-rows")
    return judge(rows).filter("kept").select(f"{whole}.*")
