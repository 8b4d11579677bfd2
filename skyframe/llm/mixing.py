"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is as many equal blocks of words as the corpus has. Sources get blocks by highest quotients (target / (2 k + 1)), and a
source's blocks go to its shards the same way by their sizes. A shard is a bounded number of documents in seeded order, its words
cut into blocks; it gives all its blocks as often as its quota holds them, and of the rest those of the lowest seeded ranks, so that
words repeat only after all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_WORDS = 16
SHARD_DOCS = 200
STEPS = 1 << 14
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, source_size) the target of each source: weights repeat by code point order, null last; all targets sum to the sizes' sum; none exceeds `most` times its size, the excess going to the others by weight.

    One row per source comes in, so the windows over all sources are small. Targets are min(most * size, level * weight); sources
    in ascending order of size / weight reach their limit first, which gives the level from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    # the first source in this order whose limit isn't below its own level sets the level for it and all after it
    free = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)
    level_all = free["level"]
    return levels.select("source", "source_size", "weight", F.least("limit", F.coalesce(level_all * F.col("weight"), F.col("limit"))).alias("target"))


def apportion(cells: DataFrame, within: list[str], weight: str, seats: str, order: list[Column], to: str) -> DataFrame:
    """Sainte-Lague: within each group of cells, `seats` (equal in a group) go to the highest quotients weight / (2 k + 1), ties by order.

    The last quotient to get a seat is total / (2 * divisor) with a divisor between seats - n / 2 and seats + n / 2, for n cells.
    Seats above that range are sure. Those within it, about three a cell, are counted in STEPS steps of the divisor, and only the
    step in which the seats run out is ranked, so that no task sees all cells of a group.
    """
    names = {c: f"_{c}_" for c in within}
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(d)) for c, d in names.items()))

    def beside(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return rows.join(groups.withColumnsRenamed(names), match, "left").drop(*names.values())

    totals = cells.groupBy(*within).agg(F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_n"), F.first(seats).cast("double").alias("_seats"))
    cells = beside(cells, totals)
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    low, high = F.col("_seats") - F.col("_n") / 2 - 1, F.col("_seats") + F.col("_n") / 2 + 1
    sure = F.greatest(F.lit(0.0), F.floor(share * F.greatest(low, F.lit(0.0)) - 0.5)).cast("long")
    last = F.when(share > 0, F.ceil(share * high + 0.5)).otherwise(F.lit(0)).cast("long")
    cells = common.materialise(cells.withColumns({"_sure": sure, "_last": last, "_low": low, "_span": high - low}), "cells")
    kept = [c for c in cells.columns if not c.startswith("_")]
    asked = cells.filter(F.col("_last") > F.col("_sure")).withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1)))
    asked = asked.withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    place = (F.col("_total") / (2 * F.col("_quotient")) - F.col("_low")) / F.col("_span")
    asked = asked.withColumn("_step", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)) * STEPS).cast("int"))

    steps = asked.groupBy(*within, "_step").agg(F.count(F.lit(1)).alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*within).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = cells.groupBy(*within).agg((F.first("_seats") - F.sum("_sure")).cast("long").alias("_left"))
    ends = beside(steps.withColumn("_before", before), left).filter("_before < _left AND _before + _in >= _left")
    asked = beside(asked, ends.select(*within, F.col("_step").alias("_end"), (F.col("_left") - F.col("_before")).alias("_open")))
    # without an end there are seats for all that ask, or none are left
    none = beside(asked.filter("_end IS NULL"), left).filter("_left > 0").select(*kept)
    within_end = asked.filter("_step = _end").withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *order)))
    won = asked.filter("_step < _end").select(*kept).unionByName(within_end.filter("_rank <= _open").select(*kept)).unionByName(none)
    got = cells.select(*kept, F.col("_sure").alias("_got")).unionByName(won.withColumn("_got", F.lit(1).cast("long")))
    return got.groupBy(*kept).agg(F.sum("_got").alias(to))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies) for every row of docs.

    size counts words, 0 for null texts; taken counts the words that the mix takes from the row, repeats included, at most
    `most` (if not whole, the next whole number) times its size. A shard's quota is rounded to whole blocks, its last block may be shorter.
    copies is for mixes of whole documents: how often a run of as many words over the shard's documents, as a ring from a seeded
    block on, begins the row. Rows that agree in doc_id, source and size are interchangeable, and each is mixed in its own right.
    A null doc_id is an id like others, a null source a source; an empty table gives an empty one, other columns play no part.
    """
    sized = common.materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.n_words(F.col(text)).alias("size")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(by_source, weights=weights, most=most).join(by_source.select(F.col("source").alias("_s"), "n_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words)
    quotas = apportion(targets.withColumn("_all", F.lit(0)).withColumn("all_blocks", blocks).withColumnRenamed("_all", "one"), ["one"], "target", "all_blocks", [F.col("source").asc_nulls_last()], "source_blocks")
    quotas = common.materialise(quotas.select(F.col("source").alias("_source"), "source_size", "target", "source_blocks", F.ceil(F.col("n_docs") / shard_docs).cast("int").alias("n_shards")), "quotas")

    placed = sized.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int"))
    ring = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"begin": before, "shard_size": F.sum("size").over(Window.partitionBy("source", "shard"))})

    shards = sized.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int"))
    shards = shards.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_blocks").alias("source_blocks"))
    shards = apportion(shards, ["source"], "words", "source_blocks", [F.col("shard")], "shard_blocks")
    words = F.col("words")
    shards = shards.withColumn("_run", F.least(F.col("shard_blocks") * block_words, F.floor(F.lit(most) * words).cast("long")))
    shards = shards.withColumn("_full", F.when(words > 0, F.floor(F.col("_run") / words)).otherwise(F.lit(0)).cast("long"))
    shards = shards.withColumn("_rest", F.floor((F.col("_run") - F.col("_full") * words + block_words // 2) / block_words).cast("int"))
    # the rank of a block; distinct in a shard, as the hash of a long is one to one
    rank = lambda k: F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard"), k.cast("long"))
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(words / block_words).cast("long") - 1), rank)
    shards = shards.withColumn("_last", F.when(F.col("_rest") > 0, F.element_at(F.sort_array(ranks), F.col("_rest"))))
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "_run", "_full", "_last")
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    begin, size = F.col("begin"), F.col("size")
    overlap = lambda k: F.least(begin + size, (k + 1) * block_words) - F.greatest(begin, k * block_words)
    blocks_of = F.sequence(F.floor(begin / block_words).cast("long"), F.floor((begin + size - 1) / block_words).cast("long"))
    chosen = F.aggregate(blocks_of, F.lit(0).cast("long"), lambda n, k: n + F.when(rank(k) <= F.col("_last"), overlap(k)).otherwise(F.lit(0).cast("long")))
    taken = F.col("_full") * size + F.when((size > 0) & F.col("_last").isNotNull(), chosen).otherwise(F.lit(0).cast("long"))

    n_blocks = F.greatest(F.floor(F.col("shard_size") / block_words), F.lit(1))
    placed = placed.withColumn("_first", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n_blocks) * block_words)
    # the run is [first, first + run) on an endless ring: how often it begins the row at begin + k * shard_size
    starts = lambda x: F.when((F.col("shard_size") > 0) & (size > 0), F.floor(x / F.col("shard_size")) + (F.pmod(x, F.col("shard_size")) > begin).cast("long")).otherwise(F.lit(0))
    copies = starts(F.col("_first") + F.col("_run")) - starts(F.col("_first"))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix in whole documents: each row of docs as often as the mix takes its first word, with all its columns.

    A shard's run of words begins and ends within a document, so this is off by a document a shard at most. Of rows that share
    a doc_id, each gets one of the numbers that mix() gave to that id.
    """
    given, n, at, key = (common.fresh(docs, c) for c in ("_given", "_n", "_at", "_key"))
    found = mix(docs, doc_id=doc_id, **options).groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list("copies")).alias(given))
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(key)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*docs.columns))
    counted = joined.withColumn(at, nth).withColumn(n, F.col(given)[F.col(at) - 1]).filter(F.col(n) > 0)
    return counted.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
