"""Periodic runs of words: stretches that repeat a period of some words, by divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least LEAST words and TIMES periods
long, that no neighbouring word extends. Every run crosses the middle of the smallest aligned block of 2^k words that holds it, and
one side of that middle has two periods of it at least. So the half blocks that begin at a middle are searched for squares: the
Z-function of the half (for the left one, read backwards) gives them, z(q) >= q. Squares whose period has a shorter one inside are
left out, the others are extended within their block; what goes on beyond the block is left to a larger one, so that a run is
extended at one level only. All blocks of a level, of all texts of a batch, are searched at once.

Z-functions are computed in rounds, a word for all candidates at a time, which most leave after one or two; what is left after
ROUNDS is done row by row with Z-boxes.

Words are [^\\x20\\x09-\\x0D]+, as bytes. Null and empty texts have no words. A row is a document: repeated rows come back as often, null
ids too, extra columns are ignored, and an empty table gives an empty one. A text of any length is searched as a whole, in a memory of
about 40 bytes a word beside its bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 6, 4
ROUNDS = 16
_TABLE = common.byte_table(common.SPACES)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def _common(s: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """For how many words, `most` at most, the stretches from a and from b on agree, in direction `step`."""
    done, width = 0, 64
    while done < most:
        n = min(width, most - done)
        x, y = ((s[p + done : p + done + n]) if step > 0 else s[p - done - n + 1 : p - done + 1][::-1] for p in (a, b))
        odd = np.flatnonzero(x != y)
        if len(odd):
            return done + int(odd[0])
        done, width = done + n, 2 * width
    return most


def _z_boxes(row: np.ndarray, z: dict[int, int], far: list[int]) -> Iterator[tuple[int, int]]:
    """(q, z(q)) for those q of `far` (ascending; z is ROUNDS at least) whose square no shorter period of them covers; z: what the rounds found for the row's candidates."""
    n, left, right, reach, at = len(row), 0, 0, 0, 0
    while (at := max(at, bisect_right(far, reach // 2))) < len(far):
        q = far[at]
        k = max(ROUNDS, min(right - q, z.get(q - left, 0))) if q < right else ROUNDS
        k += _common(row, q + k, k, 1, n - q - k)
        z[q] = k
        if q + k > right:
            left, right = q, q + k
        yield q, k
        if k >= q:
            reach = max(reach, q + k)
        at += 1


def square_prefixes(half: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, q, z): periods q up to a half (2 / times) of each row's length whose square begins the row, where no shorter period covers that square; z words from q on agree with the row's begin."""
    n = half.shape[1]
    row, q = np.nonzero(half[:, 1 : 2 * n // times + 1] == half[:, :1])
    q = q + 1
    z = np.ones(len(q), np.int64)
    alive = np.arange(len(q))
    for k in range(1, ROUNDS):
        alive = alive[q[alive] + k < n]
        alive = alive[half[row[alive], q[alive] + k] == half[row[alive], k]]
        if not len(alive):
            break
        z[alive] += 1
    alive = alive[(z[alive] == ROUNDS) & (q[alive] + ROUNDS < n)]
    drop = np.zeros(len(q), bool)
    if len(alive):
        drop[alive] = True  # unless Z-boxes bring it back
        for r in np.unique(row[alive]).tolist():
            low, high = np.searchsorted(row, [r, r + 1]).tolist()
            far = alive[slice(*np.searchsorted(alive, [low, high]))]
            place = dict(zip(q[far].tolist(), far.tolist(), strict=True))
            for x, k in _z_boxes(half[r], dict(zip(q[low:high].tolist(), z[low:high].tolist(), strict=True)), list(place)):
                z[place[x]], drop[place[x]] = k, False
    side = -(-max(least, times) // 2)
    ok = ~drop & (z >= np.maximum(q, side - q))
    row, q, z = row[ok], q[ok], z[ok]
    if len(q):
        base = row * (2 * n + 2)
        reach = np.maximum.accumulate(q + z + base)
        covered = np.concatenate([[-1], reach[:-1]]) - base >= 2 * q
        row, q, z = row[~covered], q[~covered], z[~covered]
    return row, q, z


def crossing_runs(s: np.ndarray, half: int, n: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, period, length) of runs of s[:n] that lie in an aligned block of 2 * half words and touch its middle; s has a word that fits nowhere behind n and behind every text."""
    grid = s[:n].reshape(-1, 2 * half)
    out = [np.zeros((0, 3), np.int64)]
    for step, rows in ((1, grid[:, half:]), (-1, grid[:, half - 1 :: -1])):
        row, q, z = square_prefixes(rows, least, times)
        if not len(q):
            continue
        middle = (2 * row + 1) * half
        near = middle if step > 0 else middle - 1  # the first word on this side, and the first one on the other
        other = near - step
        t = np.zeros(len(q), np.int64)
        alive = np.arange(len(q))
        for k in range(min(ROUNDS, half)):
            alive = alive[s[other[alive] - step * k] == s[other[alive] - step * k + step * q[alive]]]
            t[alive] += 1
        for i in alive[t[alive] < half].tolist():
            o, p = int(other[i]), int(q[i])
            t[i] += _common(s, o - step * int(t[i]), o + step * p - step * int(t[i]), -step, half - int(t[i]))
        ahead, back = near + step * half, other - step * half
        beyond = (q + z == half) & (s[ahead] == s[ahead - step * q]) | (t == half) & (s[back] == s[back + step * q])
        length = q + z + t
        ok = ~beyond & (length >= np.maximum(least, times * q))
        start = np.where(step > 0, middle - t, middle - q - z)
        out.append(np.stack([start, q, length], axis=1)[ok])
    return np.concatenate(out)


def batch_runs(doc: np.ndarray, ids: np.ndarray, n_docs: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(text, start, length, period), by text, start and period, of all runs; ids: an integer from 0 for each word; doc: its text, ascending. Also the number of words of each text."""
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n_words)])
    slot = 1 << np.maximum(3, np.ceil(np.log2(n_words + 1)).astype(np.int64))  # a slot has a word that fits nowhere behind its text
    order = np.argsort(-slot, kind="stable")
    base = np.zeros(n_docs, np.int64)
    base[order] = np.concatenate([[0], np.cumsum(slot[order])])[:-1]
    total = int(slot.sum())
    s = -1 - np.arange(total + 1, dtype=np.int64)
    s[np.repeat(base - first[:-1], n_words) + np.arange(len(ids))] = ids
    found, half = [np.zeros((0, 3), np.int64)], 4
    while n_docs and 2 * half <= slot.max():
        found.append(crossing_runs(s, half, int(slot[slot >= 2 * half].sum()), least, times))
        half *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    by_base = np.argsort(base)
    text = by_base[np.searchsorted(base[by_base], runs[:, 0], side="right") - 1] if len(runs) else np.zeros(0, np.int64)
    out = np.stack([text, runs[:, 0] - base[text], runs[:, 2], runs[:, 1]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], n_words


def _search(texts: pa.Array, least: int, times: int) -> tuple[list, list, pa.Array]:
    """For a batch of texts: the number of words, the runs, and the collapsed text of each."""
    doc, words = common.word_table(texts, _TABLE)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs, n_words = batch_runs(doc, ids, len(texts), least, times)
    first = np.concatenate([[0], np.cumsum(n_words)])
    text, start, length, period = runs.T
    steps = np.zeros(len(ids) + 1, np.int64)  # words that lie in a run behind its first period
    np.add.at(steps, first[text] + start + period, 1)
    np.subtract.at(steps, first[text] + start + length, 1)
    keep = np.cumsum(steps[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(keep)])[first].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(keep)).cast(pa.binary()))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.binary())).cast(pa.string())
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    for k, *r in runs.tolist():
        found[k].append(dict(zip(("start", "length", "period"), r, strict=True)))
    return n_words.tolist(), found, collapsed


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs (start, length, period) by start and period, and its words, a blank between each two, without those that lie in a run behind the run's first period.

    least, times: the fewest words and periods of a run; `times` is 4 at least, which lets one side of a middle hold two periods.
    """
    if times < 4 or least < 1:
        raise ValueError("runs have four periods at least")
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.small_batches(batches):
            n_words, found, collapsed = _search(b.column("text"), least, times)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, _RUNS), collapsed], schema=_OUT)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.utf8(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _planted(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    out = []
    for raw, g in zip(texts.to_pylist(), seeds.to_pylist(), strict=True):
        words = raw.split() if raw is not None and g is not None else None
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words[a:] = (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
        out.append(None if not words else b" ".join(words).decode())
    return pa.array(out, pa.string())


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): in a tenth of the rows, those with crc32(doc_id) divisible by 10, the words from a place on repeat a period; place and period follow from the crc32. Rows without id or words stay as they are."""
    common.ready(docs.sparkSession)
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    chosen = h % 10 == 0
    seeds = F.when(chosen, F.floor(h / 10).cast("long"))
    planted: Column = F.arrow_udf(_planted, "string")(F.when(chosen, F.col(text).cast("binary")), seeds)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(planted, F.col(text)).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """A row of digests for each row of find_runs(): the run with most periods (ties: the first, then the shortest period), and hashes of all runs and of the collapsed text."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    earlier = lambda x, y: F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])
    best = F.reduce(F.col("runs"), F.get("runs", F.lit(0)), lambda m, x: F.when(more(x, m) | (~more(m, x) & earlier(x, m)), x).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
