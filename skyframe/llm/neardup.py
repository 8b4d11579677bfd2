"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles, and the set a signature of `coordinates` minima. Equal sets are one class from
   here on, so groups of copies cost a row each and no pairs.
2. Each class is posted under each (coordinate, value) that another class has too. Two sets of the wanted likeness agree in
   `matches` coordinates at least, but for a chance of about 1e-6 at the limit itself, so they share one of their
   coordinates - matches + 1 rarest values: only those are posted (prefix), and classes without enough shared values drop out.
3. Each posting list is joined with its most central class, the one whose values are the most common. Pairs with enough
   collisions are confirmed on the full sets, and their links joined to components: most of a large group becomes one here, at
   a row a posting.
4. Lists that still hold several components are cut down by exact bounds on the full sets: a class whose rarest shingles (prefix)
   are in no other component's can't be linked any more and leaves. What is left is merged list by list: pairs of different
   components only, skipping sizes, positions and prefixes that can't reach the limit, each pair at its first common value.
5. Components come from large-star and small-star rounds over the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
#: So many shared shingles are asked for in prefixes longer by as many; classes show TOKENS of theirs, and pairs that need more aren't skipped.
DEEPER, TOKENS = 24, 64
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; A-Z in lower case."""
    global _words
    found = raw.lower().split()
    if not found:
        return np.zeros(0, U64)
    try:
        h = [_words[w] for w in found]
    except KeyError:
        if len(_words) > 400_000:
            _words = {}
        for w in found:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        h = [_words[w] for w in found]
    h = np.array(h, U64)
    span = min(words, len(h))
    n = len(h) - span + 1
    key = np.full(n, span, U64)
    for k in range(span):
        key = key * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mix(key))


class Signer:
    """Signatures of `coordinates` 64-bit minima; the low bits of each are its coordinate, so that a value says which it belongs to."""

    def __init__(self, coordinates: int, seed: int):
        draw = np.random.default_rng(seed)
        self.flip = draw.integers(0, 2**63, coordinates, dtype=np.int64).astype(U64)[:, None]
        self.times = (draw.integers(0, 2**63, coordinates, dtype=np.int64).astype(U64) * U64(2) + U64(1))[:, None]
        self.low_bits = U64((1 << (coordinates - 1).bit_length()) - 1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.flip), 2**64 - 1, U64)
        for at in range(0, len(shingles), 2048):
            low = np.minimum(low, ((shingles[None, at : at + 2048] ^ self.flip) * self.times).min(axis=1))
        return (low & ~self.low_bits | np.arange(len(low), dtype=U64)).view(np.int64)


def matches_for(coordinates: int, likeness: float, miss: float = 1e-6) -> int:
    """The most coordinates that sets of this likeness agree in, but for a chance of `miss` (binomial tail)."""
    tail = 0.0
    for k in range(coordinates + 1):
        tail += math.comb(coordinates, k) * likeness**k * (1 - likeness) ** (coordinates - k)
        if tail > miss:
            return max(1, k)
    return coordinates


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, coordinates: int, seed: int) -> DataFrame:
    """(doc_id, n, key, sig) of every row: set size, 128-bit digest of the set, signature (null for an empty set)."""
    common.ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64()))])

    def sign(batch: pa.RecordBatch) -> Iterator[tuple]:
        signer = Signer(coordinates, seed)
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(b, words)
            yield i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signer(s) if len(s) else None

    rows = docs.select(F.col(doc_id).cast("long"), common.utf8(F.col(text)))
    return rows.mapInArrow(common.arrow_rows(sign, schema), "doc_id long, n long, key binary, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(rep, key, set) for the classes in wanted (rep, key), from their own texts."""
    schema = pa.schema([("rep", pa.int64()), ("key", pa.binary()), ("set", pa.list_(pa.int64()))])

    def take(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, key, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            s = shingle_set(b, words)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key:
                yield i, key, s.view(np.int64)

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), common.utf8(F.col(text)).alias("text"))
    return texts.join(wanted, "rep").select("rep", "key", "text").mapInArrow(common.arrow_rows(take, schema, 64), "rep long, key binary, set array<long>")


def _sides(table: DataFrame, *columns: str) -> list[DataFrame]:
    """The table twice, its columns marked _a and _b, rep as a and b."""
    return [table.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab"]


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) with enough collisions and, on the full sets, enough in common."""
    low, high = _sides(classes, "vals")
    near = pairs.join(low, "a").join(high, "b").filter(F.size(F.array_intersect("vals_a", "vals_b")) >= matches).select("a", "b").distinct()
    low, high = _sides(sets, "set")
    full = near.join(high, "b").join(low, "a").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return full.filter(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def _several(rows: DataFrame, by: list[str]) -> DataFrame:
    """The values of `by` that rows of more than one component have, with the number of their rows and the least n."""
    of = F.min("component").alias("_x"), F.max("component").alias("_y")
    return rows.groupBy(*by).agg(*of, F.count(F.lit(1)).alias("df"), F.min("n").alias("least")).filter("_x != _y").drop("_x", "_y")


def _bounded(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """classes (rep, key, component, ...) that may still be linked to another component, with what bounds it.

    own: how many of a class's shingles no class of another component has. rare: its other shingles, rarest first, TOKENS of them
    at most. A set of n shingles and one that it is linked to share one of their first n - percent * n / 100 + 1 in this order.
    """
    ids = classes.select("rep", "key", "component", "n")
    rows = sets.join(ids, ["rep", "key"]).select("rep", "key", "component", "n", F.explode("set").alias("shingle"))
    found = rows.join(_several(rows, ["shingle"]).drop("least"), "shingle")
    order = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    by_class = found.groupBy("rep", "key", "component", "n").agg(order.alias("rare"))
    by_class = by_class.select("rep", "key", "component", "n", (F.col("n") - F.size("rare")).alias("own"), F.col("rare.shingle").alias("rare"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - F.col("own")
    by_class = common.materialise(by_class.withColumn("first", first).filter("first > 0"), "bounds")
    # what isn't its own is all that a class can share, so that it has no partner larger than this
    most = F.floor((F.col("n") - F.col("own")) * (100 + percent) / percent) - F.col("n")
    heads = by_class.select("rep", "key", "component", "n", most.alias("most"), F.explode(F.slice("rare", F.lit(1), "first")).alias("shingle"))
    shared = heads.join(_several(heads, ["shingle"]).select(F.col("shingle").alias("_s"), "least"), F.col("shingle") == F.col("_s")).filter("least <= most")
    left = by_class.join(shared.select("rep", "key").distinct(), ["rep", "key"], "left_semi").select("rep", "key", "own", F.size("rare").alias("n_rare"), F.slice("rare", 1, TOKENS).alias("rare"))
    return classes.join(left, ["rep", "key"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node of links (a, b), by large-star and small-star rounds.

    Each round is two aggregations and joins, so a node of many links is split like any skewed key; tables of the shared folder
    cut the lineage between rounds.
    """
    edges = common.materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = common.materialise(small.filter("u != v").distinct(), "links")
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _central(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of each posting list's most central class with the others: lists are cut into bands of like sizes."""
    lists = postings.withColumn("band", F.floor(F.log("n") / -math.log(percent / 100)))
    pivots = lists.groupBy("v", "band").agg(F.max_by(F.struct("rep", "n"), F.struct("pull", -F.col("rep"))).alias("p")).select("v", "band", F.col("p.rep").alias("a"), F.col("p.n").alias("n_a"))
    others = lists.select("v", "band", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    pairs = pivots.join(others, ["v", "band"]).filter((F.col("a") != F.col("b")) & _sizes_fit(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sizes_fit(percent: int) -> Column:
    return (F.col("n_a") * percent <= 100 * F.col("n_b")) & (F.col("n_b") * percent <= 100 * F.col("n_a"))


def _merged(lists: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in posting lists (v, at, vals, n, rep, component, own, n_rare, rare) that may be linked.

    In each list, the classes outside its largest component meet all of it, so that a large component isn't paired with itself.
    """
    sizes = lists.groupBy("v", "component").agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.groupBy("v").agg(F.max_by("component", F.struct("_n", -F.col("component"))).alias("top"))
    lists = common.materialise(lists.join(top, "v"), "lists")  # both sides come from files, so that AQE can split a large list
    low, high = _sides(lists, "v", "top", "at", "vals", "n", "component", "own", "n_rare", "rare")
    low, high = low.filter("component_a != top_a").withColumnRenamed("v_a", "v"), high.withColumnRenamed("v_b", "v")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent)).cast("int")
    once = (F.col("component_b") == F.col("top_b")) | (F.col("a") < F.col("b"))
    fits = (F.col("component_a") != F.col("component_b")) & once & _sizes_fit(percent)
    fits &= (F.col("n_a") - F.col("own_a") >= need) & (F.col("n_b") - F.col("own_b") >= need)
    # as many values have to be left from here on
    fits &= F.least(F.size("vals_a") - F.col("at_a"), F.size("vals_b") - F.col("at_b")) >= matches
    first = ~F.arrays_overlap(F.slice("vals_a", F.lit(1), F.col("at_a")), F.slice("vals_b", F.lit(1), F.col("at_b")))
    fits &= first & (F.size(F.array_intersect("vals_a", "vals_b")) >= matches)
    deep = F.least(F.lit(DEEPER), need)
    take = {x: F.greatest(F.lit(0), F.col(f"n_{x}") - need + deep - F.col(f"own_{x}")).cast("int") for x in "ab"}
    unseen = F.greatest(*(F.least(take[x], F.col(f"n_rare_{x}")) for x in "ab")) > TOKENS
    fits &= unseen | (F.size(F.array_intersect(*(F.slice(f"rare_{x}", F.lit(1), take[x]) for x in "ab"))) >= deep)
    return low.join(high, (low["v"] == high["v"]) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, coordinates: int = 32, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets, equal sets of course. Empty sets (null, empty
    or blank texts) link with nothing. Rows that share a doc_id are one document, linked with what any of them is linked with; a null
    doc_id has a null component and is kept. An empty table gives an empty result.
    """
    matches = matches_for(coordinates, percent / 100)
    with common.passing(docs.sparkSession) as keep:
        signed = keep(common.materialise(signatures(docs, doc_id, text, words, coordinates, seed), "signatures"))
        posted = signed.filter("n > 0 and doc_id is not null")
        by_set = posted.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sig").alias("sig"))
        reps = keep(common.materialise(by_set, "classes"))
        # an id with several texts links their classes
        mixed = posted.groupBy("doc_id").agg(F.min("key").alias("_x"), F.max("key").alias("_y")).filter("_x != _y").select("doc_id")
        same = posted.join(mixed, "doc_id", "left_semi").select("doc_id", "key").join(reps.select("key", "rep"), "key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

        cells = reps.select("rep", "key", "n", F.explode("sig").alias("v"))
        shared = cells.join(cells.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "v")
        # a class's values in one global order, rarest first: those that only it has come before all others, and need no posting
        by_class = shared.groupBy("rep", "key", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "v"))).alias("order"))
        by_class = by_class.filter(F.size("order") >= matches)
        pull = F.aggregate("order", F.lit(0).cast("long"), lambda s, x: s + x["freq"])
        classes = common.materialise(by_class.select("rep", "key", "n", F.col("order.v").alias("vals"), pull.alias("pull")), "postings")
        sets = common.materialise(_sets(docs, classes.select("rep", "key"), doc_id, text, words), "sets")
        prefix = F.slice("vals", F.lit(1), F.size("vals") - (matches - 1))
        pairs = common.materialise(_central(classes.select("rep", "n", "pull", F.explode(prefix).alias("v")), percent), "pairs")
        links = common.materialise(_confirmed(pairs, classes, sets, matches, percent).union(same), "confirmed")
        labels = components(links)

        def lists(of: DataFrame) -> DataFrame:
            """The postings (v, at, ...) of lists that still hold several components."""
            rows = of.select("*", F.posexplode(prefix).alias("at", "v"))
            return rows.join(_several(rows, ["v"]), "v", "left_semi")

        known = labels.withColumnRenamed("node", "rep")
        left = classes.drop("pull").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        left = common.materialise(lists(left).select("rep", "key", "n", "vals", "component").distinct(), "left")
        left = common.materialise(_bounded(left, sets, percent), "bounded")
        pairs = common.materialise(_merged(lists(left), matches, percent), "pairs")
        links = common.materialise(_confirmed(pairs, classes, sets, matches, percent).union(links), "confirmed")
        labels = keep(common.materialise(components(links), "labels"))

    ids = reps.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("sig").join(ids, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those of near_duplicates() that aren't kept; rows with a null id stay, those that share an id stay or go together."""
    key = common.fresh(docs, "_gone")
    with common.passing(docs.sparkSession) as keep:
        verdict = near_duplicates(docs, doc_id=doc_id, **options)
        gone = keep(common.materialise(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "gone"))
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(key), "left_anti")
