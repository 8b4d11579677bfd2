"""Byte-level byte-pair encoding by forced boundaries, and decoding.

A vocabulary of byte pairs that never stand next to each other inside any of its tokens marks cuts that every encoding has, whatever
the merges do; pre-tokens end at such certain places too. So texts are cut there, over all bytes of a batch at once, and each
distinct fragment is merged once, alone; the ids of a text are those of its fragments, one after the other. Fragments recur far
more often than words do, so that a task keeps those it has met, in a table of bounded size; long ones are merged with a heap.

Only tokenizers of this kind are taken: byte-level without a normalizer, with the usual split, and added tokens that match as they
stand. Null counts as empty, and an empty text has no ids. A row is a document: repeated rows and null ids come back as they are,
extra columns are ignored, an empty table gives an empty one. Texts are whole, of any length: the split runs in windows of WINDOW
characters, the rest takes about 20 bytes for each of the text's.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 1 << 20
#: The pattern by which byte-level tokenizers split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments of up to SHORT bytes are merged by looking for the best pair anew each time, and remembered.
SHORT = 48
_shared: dict[str, ForcedBoundaries] = {}


class ForcedBoundaries:
    """A byte-level vocabulary. limit: the most fragments that are remembered."""

    def __init__(self, path: str, limit: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens", [])
        if not plain or odd or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: only byte-level vocabularies without normalizer, prefixes and dropout are supported")
        byte_of = {c: b for b, c in enumerate(tokens.byte_alphabet())}
        size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.token: list[bytes] = [b""] * size
        #: Whether a byte follows another one inside some token.
        self.inside = np.zeros((256, 256), bool)
        for text, i in model["vocab"].items():
            raw = bytes(byte_of[c] for c in text)
            self.token[i] = raw
            self.inside[list(raw[:-1]), list(raw[1:])] = True
        self.single = [model["vocab"][c] for c in tokens.byte_alphabet()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        vocab = model["vocab"]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        #: The rank of a pair, and what it becomes by rank.
        self.merges = {(a, b): rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = [c for _, _, c in pairs]
        self.added = {t["content"]: t["id"] for t in added}
        for text, i in self.added.items():
            self.token[i] = text.encode()
        self.find_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split = regex.compile(PATTERN)
        flat = b"".join(self.token)
        self.bytes = np.frombuffer(flat, np.uint8)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.limit, self.known = limit, {}  # ids as bytes, 4 each

    def fragment(self, raw: bytes) -> bytes:
        """The ids of a fragment, 4 bytes each: its bytes, merged by rank, the leftmost of equal ranks first."""
        if (ids := self.known.get(raw)) is None:
            merge = self._merge if len(raw) <= SHORT else self._merge_long
            ids = np.array(merge([self.single[b] for b in raw]), tokens.U32).tobytes()
            if len(raw) <= SHORT:
                if len(self.known) >= self.limit:
                    self.known = {}
                self.known[raw] = ids
        return ids

    def _merge(self, ids: list[int]) -> list[int]:
        rank_of, none = self.merges.get, len(self.made)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank_of = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, (a, b) = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if y < n and (r := rank_of((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, (ids[x], ids[y])))
        return [i for i in ids if i >= 0]

    def _pieces(self, text: str, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ends of the pre-tokens of text[begin:end], in characters."""
        width = WINDOW
        while begin < end:
            stop = min(end, begin + width)
            found = self.split.findall(text, begin, stop)
            if stop < end:  # the last ones may go on behind the window
                if len(found) < 3:
                    width *= 2
                    continue
                found = found[:-2]
            ends = begin + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            yield ends
            begin, width = int(ends[-1]), WINDOW

    def _cuts(self, text: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends of a text's fragments in bytes, and which of them end added tokens."""
        ends, marks, at = [np.zeros(0, np.int64)], [], 0
        for m in self.find_added.finditer(text) if self.find_added else ():
            ends += [*self._pieces(text, at, m.start()), np.array([m.end()])]
            marks.append(m.end())
            at = m.end()
        ends += self._pieces(text, at, len(text))
        ends, marks = np.concatenate(ends), np.array(marks, np.int64)
        if len(text) != len(raw):
            place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            ends, marks = place[ends], place[marks]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = ~self.inside[raw[:-1], raw[1:]]
        for e in marks.tolist():  # no cuts inside an added token
            cut[e - self._added_length(raw, e) + 1 : e] = False
        cut[ends] = True
        return np.flatnonzero(cut), marks

    def _added_length(self, raw: np.ndarray, end: int) -> int:
        return max(len(t.encode()) for t in self.added if raw[max(0, end - len(t.encode())) : end].tobytes() == t.encode())

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ends, sizes, special, raws, at = [], [], [], [], 0
        for text in texts:
            data = text.encode()
            raw = np.frombuffer(data, np.uint8)
            cut, marks = self._cuts(text, raw) if data else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            ends.append(cut + at)
            sizes.append(len(cut))
            special.append(np.isin(cut, marks) if len(marks) else np.zeros(len(cut), bool))
            raws.append(data)
            at += len(data)
        bounds = np.concatenate([[0], *ends]).astype(np.int64)
        fragments = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(raws))])
        coded = fragments.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        ids = [self.fragment(f) for f in distinct]
        marks = np.flatnonzero(np.concatenate(special)) if special else np.zeros(0, np.int64)
        for k in marks.tolist():  # the bytes of an added token stand for it here
            ids.append(np.array([self.added[distinct[code[k]].decode()]], tokens.U32).tobytes())
            code[k] = len(ids) - 1
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(ids), tokens.U32)
        out, at = [], 0
        for n in sizes:
            out.append(flat[_ranges(begin[code[at : at + n]], length[code[at : at + n]])])
            at += n
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their tokens' bytes one after the other; unknown ids are skipped, bytes that are no UTF-8 replaced."""
        ids = ids[(ids >= 0) & (ids < len(self.token))]
        return self.bytes[_ranges(self.begin[ids], self.length[ids])].tobytes().decode(errors="replace")


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    if not len(begin):
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(begin - before, length) + np.arange(int(length.sum()))


def encoder(path: str | None = None) -> ForcedBoundaries:
    """The vocabulary of this Python worker; without a path, the file installed on this machine."""
    key = path or ""
    if key not in _shared:
        _shared[key] = ForcedBoundaries(path or tokens.vocabulary_path(VOCABULARY))
    return _shared[key]


def ids_of(text: Column, vocabulary: str | None = None) -> Column:
    """The ids of a whole text, an array of ints. vocabulary: a file that all executors find."""

    def run(texts: pa.Array) -> pa.Array:
        known, parts = encoder(vocabulary), []
        for b in common.small_batches([pa.RecordBatch.from_arrays([texts], ["text"])]):
            found = known.encode_batch(b.column(0).to_pylist())
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.coalesce(text, F.lit("")))


_READ = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("text", pa.string())])


def read_back(ids: Column, vocabulary: str | None = None) -> Column:
    """A struct of the number of ids, their digest as little-endian unsigned 32-bit integers, and the text that they decode to; null counts as no ids."""

    def run(column: pa.Array) -> pa.Array:
        known, flat = encoder(vocabulary), column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *pc.fill_null(column.value_lengths(), 0).to_pylist()])
        lists = [flat[low:high] for low, high in zip(ends[:-1], ends[1:], strict=True)]
        digests = [hashlib.sha256(x.astype(tokens.U32).tobytes()).hexdigest() for x in lists]
        parts = [pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array([known.decode(x) for x in lists], pa.string())]
        return pa.StructArray.from_arrays(parts, fields=list(_READ))

    return F.arrow_udf(run, "struct<n_tokens: bigint, ids_sha256: string, text: string>")(ids)


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row's whole text."""
    common.ready(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), ids_of(F.col(text), vocabulary).alias("ids"))


def decode(encoded: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text) of rows (doc_id, ids), by read_back()."""
    common.ready(encoded.sparkSession)
    return encoded.select("doc_id", read_back(F.col("ids"), vocabulary).alias("r")).select("doc_id", "r.*")
