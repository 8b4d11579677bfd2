"""Language identification by mixtures of character n-gram models.

Training counts hashed byte trigrams of every labelled text, per language, in one aggregation; the model is a table of
BUCKETS probabilities per language, whose size doesn't depend on the corpus. For each document, expectation-maximisation finds the
proportions of languages that explain its n-grams best. The set of languages is chosen by penalised likelihood: the best single
language stays unless a mixture gains more than `penalty` per language and log of the n-gram count. The search starts from all
languages of the model: those with the least shares are taken away as long as that improves the penalised likelihood, and a
language comes back if the bound on its gain allows for one and a new fit confirms it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
UNKNOWN = "und"
MAX_LANGUAGES = 256
_BLANK = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))  # ASCII other than letters to blanks


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2: those rows never train."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text in lower case, blanks for what isn't a letter."""
    b = np.frombuffer(b" " + raw.lower().translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = code[(b[1:-1] != 32) | (b[:-2] != 32)]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) from all rows with a language.

    Each batch adds up its counts per language, and Spark adds up the batches; the driver gets BUCKETS counts per language. More
    than MAX_LANGUAGES languages are an error.
    """
    common.ready(rows.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if name not in total:
                        total[name] = np.zeros(BUCKETS, np.int64)
                    for k in range(0, len(raw), 1 << 20):
                        total[name] += np.bincount(grams(raw[k : k + (1 << 20)]), minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], schema=schema)

    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.select(F.col(lang), common.utf8(F.col(text))).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = common.materialise(counts, "grams")
    names = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BUCKETS, len(names)), 0.5)
    found = counts.toArrow()
    at = {x: k for k, x in enumerate(names)}
    np.add.at(table, (found["bucket"].to_numpy(), np.array([at[x] for x in found["lang"].to_pylist()], np.int64)), found["n"].to_numpy())
    return names, np.log(table / table.sum(axis=0))


def _fit(p: np.ndarray, n: np.ndarray, rounds: int = 30, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood: p [grams, languages], n counts."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def _fewest(p: np.ndarray, n: np.ndarray, share: np.ndarray, cost: float) -> np.ndarray:
    """The columns of the largest shares, as many as give the best penalised likelihood with these shares scaled to 1.

    A new fit of those columns is at least as likely, so that each cut made here is a gain.
    """
    order = np.argsort(-share, kind="stable")
    order = order[share[order] > 0]
    mixed, held, value = np.zeros(len(p)), 0.0, np.empty(len(order))
    total = n.sum()
    for k, j in enumerate(order):
        mixed += p[:, j] * share[j]
        held += share[j]
        value[k] = n @ np.log(mixed) - total * np.log(held) - cost * k
    return order[: int(value.argmax()) + 1]


def mixture(buckets: np.ndarray, logs: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """The proportions of all languages in a text with these n-grams; zeros for those outside the chosen set."""
    at, n = np.unique(buckets, return_counts=True)
    rows, out = logs[at], np.zeros(logs.shape[1])
    single = n @ rows
    best = int(single.argmax())
    total = n.sum()
    cost = penalty * np.log(total + 1.0)
    # a mixture gains at most what each n-gram's best language gains
    if logs.shape[1] == 1 or n @ rows.max(axis=1) - single[best] <= cost:
        out[best] = 1.0
        return out
    p = np.exp(rows - rows.max(axis=1, keepdims=True))
    offset = float(n @ rows.max(axis=1))

    def fit(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The set, its shares and its penalised likelihood, after taking away languages as long as that improves it."""
        share, like = _fit(p[:, chosen], n)
        value = like + offset - cost * (len(chosen) - 1)
        while len(chosen) > 1:
            rest = _fewest(p[:, chosen], n, share, cost)
            if len(rest) == len(chosen):
                rest = np.delete(np.arange(len(chosen)), share.argmin())
            fewer, less = _fit(p[:, chosen[rest]], n)
            if less + offset - cost * (len(rest) - 1) < value:
                break
            chosen, share, value = chosen[rest], fewer, less + offset - cost * (len(rest) - 1)
        return chosen, share, value

    chosen, share, value = fit(np.arange(logs.shape[1]))
    if single[best] >= value:
        chosen, share, value = np.array([best]), np.ones(1), float(single[best])
    tried = np.zeros(logs.shape[1], bool)
    while True:
        # by concavity, a set with one more language gains at most total * log(pull), pull the largest of its members
        pull = (n / (p[:, chosen] @ share)) @ p / total
        most = total * np.log(np.maximum(pull, pull[chosen].max()))
        open_ = (most > cost) & ~tried
        open_[chosen] = False
        if not open_.any():
            break
        extra = int(np.where(open_, pull, -1.0).argmax())
        tried[extra] = True
        more = fit(np.append(chosen, extra))
        if more[2] > value:
            chosen, share, value = more
    out[chosen] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, doc_id: str = "doc_id", text: str = "text", penalty: float = 2.0) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) for each row; `und` and 0.0 for texts that are null or without a letter, or a model without languages."""
    common.ready(docs.sparkSession)
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))  # BUCKETS x MAX_LANGUAGES numbers at most
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    def judge(batch: pa.RecordBatch) -> Iterator[tuple]:
        names, logs = shared.value
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not names or not (any(map(str.isalpha, map(chr, set(raw)))) if raw.isascii() else any(map(str.isalpha, set(raw.decode())))):
                yield i, UNKNOWN, 0.0, [], []
                continue
            found = grams(raw)
            share = mixture(found, logs, penalty) if len(found) else np.eye(1, len(names))[0]
            order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
            yield i, names[order[0]], float(min(1.0, share[order[0]])), [names[k] for k in order], share[order]

    rows = docs.select(F.col(doc_id).cast("long"), common.utf8(F.col(text)))
    return rows.mapInArrow(common.arrow_rows(judge, schema), "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the rows that aren't held out and predicts all: (doc_id, held_out, lang_pred, score, languages, shares)."""
    model = train(docs.filter(~held_out(F.col(doc_id))), text=text, lang=lang)
    found = predict(docs, model, doc_id=doc_id, text=text)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")
