"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text falls into paragraphs (lines; within a line, sentences, each with what separates it from the next; what is still longer than
LONG is cut behind words that their own hash picks). Every paragraph gives a vector of LANES pseudo-random numbers of 32 bits, drawn
from 128 bits of its SHA-256 digest, and its length as the mass of a cell, one of CELLS, which is its own but for a chance of
1 / CELLS with each other paragraph. A fingerprint is the sum of all paragraphs, lanes modulo 2 ** 32 and masses modulo 2 ** 31, so
that paragraphs can be added or taken away without the rest, and order doesn't matter.

Its size is bounded: of the masses, the SKETCH smallest cells stay, and the greatest of them is the bound, up to which masses are
complete. Sums and differences hold up to the lesser bound, so that they are exact too, but after many deletions fewer than SKETCH
cells may stay. Lanes and the total mass aren't cut: they tell texts apart. Masses give a likeness, the share of mass that two texts
have in common: exact for texts of SKETCH distinct paragraphs or fewer, for longer ones that of a sample, the cells up to the lesser bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LANES = 64
CELLS = 2**31
SKETCH = 1024
LONG, PICK = 200, 16
_LANE, _MASS = 2**32, 2**31
#: Cuts behind each line end and behind the space after a sentence.
_CUT = r"(?<=\n)|(?<=[.!?] )"
#: Cuts behind what isn't a letter, and behind each letter of scripts without blanks.
_WORD = r"(?<=[^\p{L}\p{M}]|[\u2E80-\uD7FF])"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f mentions it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _starts(rows: Column, new: Callable[[Column, Column, Column], Column]) -> Column:
    """The places i, from 0, that are first or hold new(row before, row, i)."""
    return F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | new(F.get(rows, i - 1), x, i), i)), lambda i: i.isNotNull())


def _pieces(part: Column) -> Column:
    """A long part cut behind each word with a hash of 0 modulo PICK, so that a shared stretch has shared pieces wherever it stands."""
    run = lambda words, starts: F.transform(starts, lambda i, k: F.array_join(F.slice(words, i + 1, F.coalesce(F.get(starts, k + 1), F.size(words)) - i), ""))
    cut = _let(F.split(part, _WORD, -1), lambda w: _let(_starts(w, lambda before, x, i: F.pmod(F.xxhash64(before), F.lit(PICK)) == 0), lambda s: run(w, s)))
    return F.when(F.length(part) <= LONG, F.array(part)).otherwise(cut)


def vectors(text: Column) -> Column:
    """A struct (seed, cell, mass) for each paragraph of a text; null counts as empty, and an empty text has no paragraph."""
    parts = F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), _CUT, -1), _pieces)), lambda p: p != "")
    return F.transform(
        F.transform(parts, lambda p: F.struct(F.substr(F.sha2(p, 256), F.lit(1), F.lit(32)).alias("seed"), F.length(p).cast("long").alias("mass"))),
        lambda p: F.struct(p["seed"].alias("seed"), F.pmod(F.xxhash64(p["seed"]), F.lit(CELLS)).cast("int").alias("cell"), p["mass"].alias("mass")),
    )


def _by_cell(masses: Column) -> Column:
    """The sums of an array of (cell, mass), ordered by cell, modulo _MASS: sorted, then a run for each cell."""
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda t, m: t + m["mass"], lambda t: F.pmod(t, F.lit(_MASS)))
    runs = lambda rows, starts: F.transform(starts, lambda i, k: F.struct(F.get(rows, i)["cell"].alias("cell"), total(F.slice(rows, i + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - i)).alias("mass")))
    return _let(F.sort_array(masses), lambda rows: _let(_starts(rows, lambda before, x, i: before["cell"] != x["cell"]), lambda starts: runs(rows, starts)))


def _bounded(lanes: Column, total: Column, masses: Column, bound: Column) -> Column:
    """The fingerprint with masses, in order of cells and complete up to `bound`, cut to the first SKETCH."""
    def cut(rows: Column) -> Column:
        last = F.when(F.size(rows) > SKETCH, F.get(rows, F.lit(SKETCH - 1))["cell"]).otherwise(bound)
        return F.struct(lanes.alias("lanes"), total.alias("total"), last.alias("bound"), F.slice(rows, 1, SKETCH).alias("masses"))

    return _let(masses, cut)


def _sum(masses: Column) -> Column:
    """The mass of an array of (cell, mass)."""
    return F.aggregate(masses, F.lit(0).cast("long"), lambda s, m: s + m["mass"])


def _up_to(masses: Column, bound: Column) -> Column:
    return F.filter(masses, lambda m: m["cell"] <= bound)


def add_up(paragraphs: Column) -> Column:
    """The fingerprint of an array of paragraph vectors: a struct of lanes, total mass, bound and masses by cell.

    Lambdas compute what they mention anew for each element, so `paragraphs` has to be a column, not an expression.
    """
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)),
        lambda j: F.aggregate(paragraphs, F.lit(0).cast("long"), lambda s, p: s + F.xxhash64(p["seed"], j).bitwiseAND(F.lit(_LANE - 1)), lambda s: F.pmod(s, F.lit(_LANE))),
    )
    masses = F.transform(paragraphs, lambda p: F.struct(p["cell"].alias("cell"), p["mass"].alias("mass")))
    return _bounded(lanes, F.pmod(_sum(paragraphs), F.lit(_MASS)), _by_cell(masses), F.lit(CELLS - 1))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both a and b (sign 1), or of a's without b's (sign -1)."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(_LANE)))
    bound = F.least(a["bound"], b["bound"])
    signed = F.transform(b["masses"], lambda m: F.struct(m["cell"].alias("cell"), (sign * m["mass"]).alias("mass")))
    masses = F.filter(_by_cell(_up_to(F.concat(a["masses"], signed), bound)), lambda m: m["mass"] != 0)
    return _bounded(lanes, F.pmod(a["total"] + sign * b["total"], F.lit(_MASS)), masses, bound)


def packed(fingerprint: Column) -> Column:
    """A fingerprint with numbers of 32 bits in plain arrays, as it moves between tasks."""
    rows = fingerprint["masses"]
    return F.struct(
        F.transform(fingerprint["lanes"], lambda x: (x - _MASS).cast("int")).alias("lanes"),
        fingerprint["total"].cast("int").alias("total"),
        fingerprint["bound"].alias("bound"),
        F.transform(rows, lambda m: m["cell"]).alias("cells"),
        F.transform(rows, lambda m: m["mass"].cast("int")).alias("masses"),
    )


def unpacked(fingerprint: Column) -> Column:
    """What packed() was given."""
    return F.struct(
        F.transform(fingerprint["lanes"], lambda x: x.cast("long") + _MASS).alias("lanes"),
        fingerprint["total"].cast("long").alias("total"),
        fingerprint["bound"].alias("bound"),
        F.zip_with(fingerprint["cells"], fingerprint["masses"], lambda c, m: F.struct(c.alias("cell"), m.cast("long").alias("mass"))).alias("masses"),
    )


def as_text(fingerprint: Column) -> Column:
    """Lanes, total mass and bound in hexadecimal, then cell:mass pairs."""
    lanes = F.array_join(F.transform(fingerprint["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    masses = F.array_join(F.transform(fingerprint["masses"], lambda m: F.concat(F.lower(F.hex(m["cell"])), F.lit(":"), F.lower(F.hex(m["mass"])))), ",")
    return F.concat_ws("/", lanes, F.lower(F.hex(fingerprint["total"])), F.lower(F.hex(fingerprint["bound"])), masses)


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal fingerprints, else the common share of mass up to the lesser bound, from 0 to 1 and below 1."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # a cell that both have stands twice in a row
    lesser = lambda rows: F.transform(rows, lambda x, i: F.when(F.get(rows, i - 1)["cell"] == x["cell"], F.get(rows, i - 1)["mass"]).otherwise(zero))
    common_mass = lambda rows: F.aggregate(_let(rows, lesser), zero, lambda s, m: s + m)
    of = lambda rows: _let(common_mass(rows), lambda x: x / F.greatest(_sum(rows) - x, one))
    share = _let(F.least(a["bound"], b["bound"]), lambda bound: _let(F.sort_array(_up_to(F.concat(a["masses"], b["masses"]), bound)), of))
    # texts with other lanes differ by a character at least, which a sample may not show
    most = 1 - 1 / F.greatest(a["total"] + b["total"], one)
    return F.when(a["lanes"] == b["lanes"], F.lit(1.0)).otherwise(F.least(share, most).cast("double"))


def neighbours(ids: DataFrame) -> DataFrame:
    """From (id, n), ids unique and not null: (id, before_id, before_n), the row whose next this is: the next higher id, for the highest the lowest.

    Ids are dealt by range, ordered within each part, and a table with a row per part links the parts' ends.
    """
    parts = common.materialise(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    ends = parts.groupBy("part").agg(F.min(F.struct("id", "n")).alias("low"))
    above = F.coalesce(F.lead("low").over(Window.orderBy("part")), F.min("low").over(Window.partitionBy()))
    ends = ends.select(F.col("part").alias("_part"), above.alias("above"))
    inside = Window.partitionBy("part").orderBy("id")
    linked = parts.withColumn("_higher", F.lead(F.struct("id", "n")).over(inside)).join(ends, F.col("part") == F.col("_part"))
    before = F.coalesce("_higher", "above")
    return common.materialise(linked.select("id", before["id"].alias("before_id"), before["n"].alias("before_n")), "neighbours")


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last half of a text's code points replaced by the first as many of the next document's. Rows of one
    doc_id are next to the same row; the one with the least text stands for them. A null doc_id has no next: nothing replaces
    its last half, and near_next is null; such rows aren't sorted. Columns beside doc_id and text play no part, and an empty table
    gives an empty one. Each text is fingerprinted once, before it moves by doc_id; the halves that others need move once more.
    """
    def printed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_p", vectors(F.col("text"))).withColumn("_f", add_up(F.col("_p")))
        return rows.select("id", "text", packed(F.col("_f")).alias("f"))

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.filter("id is not null")
    links = neighbours(known.groupBy("id").agg(F.max(F.length("text")).alias("n")))
    placed = printed(known).join(links.hint("merge"), "id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    given = placed.withColumn("_k", first).filter("_k = 1")
    given = given.select(F.col("before_id").alias("_for"), F.substr("text", F.lit(1), F.floor(F.col("before_n") / 2).cast("int")).alias("start"), F.col("f").alias("next_f"))
    joined = placed.join(given.hint("merge"), F.col("id") == F.col("_for"), "left").select("id", "text", "f", "start", "next_f")
    joined = joined.unionByName(printed(rows.filter("id is null")), allowMissingColumns=True)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("start", F.lit("")), F.lit(1), half))
    next_f = F.when(F.col("next_f").isNotNull(), unpacked(F.col("next_f")))
    out = joined.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), unpacked(F.col("f")).alias("f"), next_f.alias("next_f"))
    out = out.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), vectors(F.col("edited")).alias("q"), "f", "next_f")
    out = out.select("id", "n_chars", "edited_sha256", "f", add_up(F.col("q")).alias("e"), "next_f")
    near_next = F.when(F.col("next_f").isNotNull(), likeness(F.col("f"), F.col("next_f")))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), near_next.alias("near_next"))
