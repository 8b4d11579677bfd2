"""Orbital catalogs: reading, cleaning and merging, in DataFrame operations.

Files are read from landed JSON or CSV; fetching them over a network is left to other tools.
"""

from __future__ import annotations

import logging
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime, schema
from ..functions import timescale

#: The groups of supplemental elements.
SUPPLEMENTAL_GROUPS = ("starlink", "oneweb", "planet", "iridium", "gps", "glonass", "intelsat", "ses", "telesat", "iss", "css", "cpf", "kuiper", "ast")
#: Columns that make two rows the same elements, from the epoch to the mean anomaly; bstar isn't among them.
SAME_ELEMENTS = ("epoch_jd1", "epoch_jd2", "n0", "e0", "i0", "node0", "omega0", "m0")
#: Raw columns that propagation needs, and the conventions that all rows of a base catalog have to follow.
NEEDED = ("NORAD_CAT_ID", "EPOCH", "MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "ARG_OF_PERICENTER", "RA_OF_ASC_NODE", "MEAN_ANOMALY", "BSTAR")
CONVENTIONS = {"TIME_SYSTEM": "UTC", "REF_FRAME": "TEME", "CENTER_NAME": "EARTH"}
#: Raw names of a catalog's columns.
RAW = {"NORAD_CAT_ID": "norad_id", "OBJECT_ID": "cospar_id", "OBJECT_NAME": "name", "EPOCH": "epoch", "MEAN_MOTION": "n0", "ECCENTRICITY": "e0", "INCLINATION": "i0", "RA_OF_ASC_NODE": "node0", "ARG_OF_PERICENTER": "omega0", "MEAN_ANOMALY": "m0", "BSTAR": "bstar"}
#: The attributes of an SGP4 record, in the order of schema.GPE.
RECORD = ("satnum", "jdsatepoch", "jdsatepochF", "no_kozai", "ecco", "inclo", "nodeo", "argpo", "mo", "bstar")
REV_PER_DAY, DEGREE = 2 * math.pi / 1440, 2 * math.pi / 360


LOG = logging.getLogger("skyframe")


class CatalogError(ValueError):
    """A catalog breaks a rule that the cleaning relies on."""


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header line first; lines that are too long or short are cut or filled with null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_group(spark: SparkSession, folder: str, group: str) -> DataFrame | None:
    """One group's raw rows from folder/group.json; None, with a warning, where there is no such file or it isn't a list of elements."""
    try:
        rows = read_json(spark, f"{folder}/{group}.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        LOG.warning("no file of the supplemental group %s", group)
        return None
    if "_corrupt_record" in rows.columns or "NORAD_CAT_ID" not in rows.columns:
        LOG.warning("the file of the supplemental group %s isn't a list of elements", group)
        return None
    return rows


def read_groups(spark: SparkSession, folder: str, groups=SUPPLEMENTAL_GROUPS) -> DataFrame | None:
    """All groups' files that can be read, as one frame; None if none can."""
    return concat([read_group(spark, folder, g) for g in groups])


def load_base(spark: SparkSession, path: str) -> DataFrame:
    """A landed base catalog, checked, cleaned, without repeated elements."""
    raw = read_json(spark, path)
    missing = [c for c in (*RAW, "TLE_LINE1", "TLE_LINE2", *CONVENTIONS) if c not in raw.columns]
    if missing:
        raise CatalogError(f"{path} has no {', '.join(missing)}")
    return first_of_same(reformat(validate(raw, unique="NORAD_CAT_ID", required=list(NEEDED), constant=CONVENTIONS), clean_placeholders=True))


def load_supplemental(spark: SparkSession, folder: str, groups=SUPPLEMENTAL_GROUPS) -> DataFrame | None:
    """The supplemental elements of all groups, each checked and without repeats, one row an id and epoch; None without any group."""
    found = [read_group(spark, folder, g) for g in groups]
    parts = [first_of_same(reformat(validate(raw, required=list(NEEDED)), clean_placeholders=False)) for raw in found if raw is not None]
    return lowest_rms(concat(parts)) if parts else None


def load_satcat(spark: SparkSession, path: str) -> DataFrame:
    """(norad_id, rcs, status) of a landed satellite catalog, whose ids have to be unique."""
    raw = validate(read_csv(spark, path), unique="NORAD_CAT_ID", required=["NORAD_CAT_ID"])
    number = F.col("NORAD_CAT_ID").cast("long")
    return raw.select(number.alias("norad_id"), empty_to_null(F.col("RCS")).cast("double").alias("rcs"), F.col("OPS_STATUS_CODE").alias("status"))


def load_catalog(spark: SparkSession, base: str, satcat: str, groups: str | None = None) -> DataFrame:
    """The whole catalog from landed files, in order of id and epoch: a base JSON file, a satellite catalog in CSV, and the folder of supplemental groups, if any."""
    extra = load_supplemental(spark, groups) if groups else None
    return merge(load_base(spark, base), extra, load_satcat(spark, satcat)).orderBy("norad_id", "epoch_jd1", "epoch_jd2")


def concat(frames: list[DataFrame | None]) -> DataFrame | None:
    """One below the other by column name, without those that are None."""
    out = None
    for f in frames:
        out = f if out is None else out if f is None else out.unionByName(f, allowMissingColumns=True)
    return out


def placeholder_to_null(c: Column, placeholder: str) -> Column:
    return F.nullif(c, F.lit(placeholder))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def broken_rules(df: DataFrame, *, unique: str | None = None, required: list[str] = (), constant: dict[str, str] | None = None) -> DataFrame:
    """(rule, broken): rows with a null in a required column, rows off a constant column's value, and keys that recur."""
    sums = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in required]
    sums += [F.count_if(F.col(c) != F.lit(v)).alias(f"{c} isn't {v}") for c, v in (constant or {}).items()]
    names = [f"{c} is null" for c in required] + [f"{c} isn't {v}" for c, v in (constant or {}).items()]
    row = df.agg(*sums) if sums else df.sparkSession.range(1).select()
    parts = []
    if names:
        parts.append(row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n in names))).alias("r")).select("r.*"))
    if unique:
        again = df.groupBy(unique).count().filter("count > 1").agg(F.count(F.lit(1)).alias("broken"))
        parts.append(again.select(F.lit(f"{unique} recurs").alias("rule"), "broken"))
    return concat(parts)


def validate(df: DataFrame, **rules) -> DataFrame:
    """df, or a CatalogError that names the broken rules."""
    broken = [r for r in broken_rules(df, **rules).collect() if r["broken"]]
    if broken:
        raise CatalogError("; ".join(f"{r['rule']}: {r['broken']}" for r in broken))
    return df


def convert_units(df: DataFrame) -> DataFrame:
    """Revolutions a day to radians a minute, degrees to radians."""
    return df.withColumns({"n0": F.col("n0") * REV_PER_DAY} | {c: F.col(c) * DEGREE for c in ("i0", "node0", "omega0", "m0")})


def reformat(raw: DataFrame, *, clean_placeholders: bool) -> DataFrame:
    """Raw columns to the catalog's, without rms, ops_code and rcs where raw has none. Placeholders become null only on request."""
    num = lambda c: F.col(c).cast("double")
    df = raw.withColumnsRenamed(RAW)
    df = df.withColumns({"norad_id": F.col("norad_id").cast("long")} | {c: num(c) for c in ("n0", "e0", "i0", "node0", "omega0", "m0", "bstar")})
    df = timescale.with_pair(df, timescale.iso_to_jd(F.col("epoch")), "epoch_jd1", "epoch_jd2")
    df = convert_units(df)
    if clean_placeholders:
        df = df.withColumns({"cospar_id": placeholder_to_null(F.col("cospar_id"), "UNKNOWN"), "name": placeholder_to_null(F.col("name"), "TBA - TO BE ASSIGNED")})
    if "RMS" in df.columns:
        df = df.withColumn("rms", empty_to_null(F.col("RMS").cast("string")).cast("double"))
    if "TLE_LINE1" in df.columns:
        df = df.withColumnsRenamed({"TLE_LINE1": "tle_line1", "TLE_LINE2": "tle_line2"})
    return df.select(*(c for c in schema.CATALOG.fieldNames() if c in df.columns))


def first_of_same(df: DataFrame, same=SAME_ELEMENTS, order: str = "norad_id") -> DataFrame:
    """One row of those that agree in the columns `same`, the one with the least `order`; nulls agree with nulls."""
    n = F.row_number().over(Window.partitionBy(*same).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def lowest_rms(df: DataFrame, key=("norad_id", "epoch_jd1", "epoch_jd2"), rms: str = "rms") -> DataFrame:
    """One row a key, the one with the lowest rms; a null rms is the highest."""
    others = [c for c in df.columns if c not in key and c != rms]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(rms).asc_nulls_last(), *others))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def prefer_supplemental(base: DataFrame, extra: DataFrame, key: str = "norad_id") -> DataFrame:
    """A full outer join by key whose common columns take the supplemental value if there is one; several supplemental rows repeat the base row."""
    shared = [c for c in extra.columns if c in base.columns and c != key]
    renamed = extra.withColumnsRenamed({c: f"_extra_{c}" for c in shared})
    joined = base.join(renamed, key, "full")
    order = [key, *(c for c in base.columns if c != key), *(c for c in extra.columns if c not in base.columns)]
    return joined.select(*(F.coalesce(f"_extra_{c}", c).alias(c) if c in shared else F.col(c) for c in order))


def mark_members(df: DataFrame, members: DataFrame, key: str = "norad_id", flag: str = "_member") -> DataFrame:
    """df with a flag: whether its key is among members' keys."""
    keys = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def merge(base: DataFrame, extra: DataFrame | None, satcat: DataFrame) -> DataFrame:
    """The catalog: base elements, overridden by supplemental ones, which are operational and have no TLE; then size and status of the satellite catalog.

    A satellite in the satellite catalog takes its status even if that is null.
    """
    if extra is None:
        df = base.withColumns({"rms": F.lit(None).cast("double"), "ops_code": F.lit(None).cast("string")})
    else:
        df = mark_members(prefer_supplemental(base, extra), extra)
        df = df.withColumn("ops_code", F.when(F.col("_member"), F.lit("+")))
        df = df.withColumns({c: F.when(~F.col("_member"), F.col(c)) for c in ("tle_line1", "tle_line2")}).drop("_member")
    return override_status(df, satcat).select(*schema.CATALOG.fieldNames())


def override_status(df: DataFrame, satcat: DataFrame) -> DataFrame:
    """Joins (norad_id, rcs, status): a match's status wins, null or not."""
    known = satcat.select("norad_id", "rcs", F.col("status").alias("_status"), F.lit(True).alias("_known"))
    df = df.join(known, "norad_id", "left")
    return df.withColumn("ops_code", F.when(F.col("_known"), F.col("_status")).otherwise(F.col("ops_code"))).drop("_status", "_known")


def to_gpes(df: DataFrame) -> DataFrame:
    """The fixed element columns, cast."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.GPE.fields))


def elements(spark: SparkSession, data) -> DataFrame:
    """Elements as a table of schema.GPE: from a Spark or pandas frame with its columns (others are left out, values cast), a NumPy array
    with its fields in order, or a list of SGP4 records (RECORD names their attributes). What a driver holds is sent out as it is.
    """
    names = schema.GPE.fieldNames()
    if isinstance(data, np.ndarray):
        wanted = np.dtype([(f.name, "i8" if f.name == "norad_id" else "f8") for f in schema.GPE.fields])
        if data.dtype != wanted or data.ndim != 1:
            raise TypeError(f"an array of elements has one dimension and the fields {wanted}, not {data.ndim} and {data.dtype}")
        data = pd.DataFrame({n: np.ascontiguousarray(data[n]) for n in names})
    elif isinstance(data, list):
        odd = next((x for x in data if not all(hasattr(x, a) for a in RECORD)), None)
        if odd is not None:
            raise TypeError(f"a {type(odd).__name__} is no SGP4 record")
        data = pd.DataFrame([[getattr(x, a) for a in RECORD] for x in data], columns=names)
    elif not isinstance(data, pd.DataFrame | DataFrame):
        raise TypeError(f"elements come as a frame, an array or a list of records, not as {type(data).__name__}")
    missing = [n for n in names if n not in data.columns]
    if missing:
        raise CatalogError(f"there is no {', '.join(missing)}")
    if isinstance(data, DataFrame):
        return to_gpes(data)
    data = data[names].astype({n: "int64" if n == "norad_id" else "float64" for n in names})
    return spark.createDataFrame(data, schema.GPE)


def check_elements(gpes: DataFrame) -> DataFrame:
    """gpes, or a CatalogError: at least one row, all element columns that it has finite, and no epoch twice for an id."""
    odd = lambda c: F.col(c).isNull() | (F.isnan(c) | (F.abs(c) == float("inf")) if c != "norad_id" else F.lit(False))
    fields = [f.name for f in schema.GPE.fields if f.name in gpes.columns]
    missing = [c for c in ("norad_id", "epoch_jd1", "epoch_jd2") if c not in fields]
    if missing:
        raise CatalogError(f"there is no {', '.join(missing)}")
    sums = gpes.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(odd(c)).alias(c) for c in fields)).first()
    if not sums["n"]:
        raise CatalogError("there are no elements")
    broken = [c for c in fields if sums[c]]
    if broken:
        raise CatalogError(f"null or not finite: {', '.join(broken)}")
    again = gpes.groupBy("norad_id", _utc(gpes).alias("_epoch")).count().filter("count > 1").limit(1).collect()
    if again:
        raise CatalogError(f"an epoch of {again[0]['norad_id']} recurs")
    return gpes


def _utc(gpes: DataFrame) -> Column:
    """The epoch of elements as an ordered pair."""
    return timescale.pair(timescale.two_sum(gpes["epoch_jd1"].cast("double"), gpes["epoch_jd2"].cast("double")))


def check_span(jd_begin: float, jd_end: float, reentry: float = 0.0, leave: float = math.inf) -> None:
    if not (math.isfinite(jd_begin) and math.isfinite(jd_end) and jd_begin < jd_end):
        raise ValueError(f"the dates {jd_begin} and {jd_end} aren't finite and ascending")
    if math.isnan(reentry) or math.isnan(leave) or reentry >= leave:
        raise ValueError(f"the radii {reentry} and {leave} aren't ascending")


def norad_index(df: DataFrame) -> DataFrame:
    """(obj_idx, norad_id): ids in ascending order, numbered from 0 by parts and the parts' sizes."""
    ids = df.select("norad_id").distinct().repartitionByRange("norad_id").withColumn("_part", F.spark_partition_id())
    sizes = ids.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("norad_id")) - 1
    return ids.join(sizes.select("_part", before.alias("_before")), "_part").select((F.col("_before") + inside).cast("long").alias("obj_idx"), "norad_id")


def gpe_intervals(gpes: DataFrame, jd_begin: float, jd_end: float, check: bool = True) -> DataFrame:
    """Adds the interval in which each row of elements holds: from its epoch to the next one's, the earliest one from jd_begin on; rows without a share of [jd_begin, jd_end) go.

    Epochs and ends are double-length pairs throughout. They are turned into TAI before they are compared, so that intervals over a
    leap second are as long as they are: begin and end are days of TAI since jd_begin, begin_jd1, begin_jd2, end_jd1 and
    end_jd2 the UTC pairs. check: whether the rules of elements are tested first.
    """
    check_span(jd_begin, jd_end)
    rows = check_elements(gpes) if check else gpes
    utc = timescale.two_sum(F.col("epoch_jd1").cast("double"), F.col("epoch_jd2").cast("double"))
    rows = timescale.with_tai(timescale.with_pair(rows, utc, "_utc1", "_utc2"), "_utc1", "_utc2", "_tai1", "_tai2")
    # dates order by TAI and carry their UTC along
    dated = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("tai1", "tai2", "utc1", "utc2"), strict=True)))
    first, last = (dated(*map(F.lit, (*timescale.tai_of(float(jd)), float(jd), 0.0))) for jd in (jd_begin, jd_end))
    rows = rows.withColumn("_epoch", dated(*map(F.col, ("_tai1", "_tai2", "_utc1", "_utc2"))))
    w = Window.partitionBy("norad_id").orderBy("_epoch")
    rows = rows.withColumns({"_next": F.lead("_epoch").over(w), "_first": F.row_number().over(w) == 1})
    begin = F.when(F.col("_first"), first).otherwise(F.greatest("_epoch", first))
    rows = rows.withColumns({"_begin": begin, "_end": F.least(F.coalesce("_next", last), last)}).filter("_begin < _end")
    since, zero = {}, tuple(F.lit(-x) for x in timescale.tai_of(float(jd_begin)))
    for c in ("begin", "end"):
        high, low = timescale.dl_add((F.col(f"_{c}.tai1"), F.col(f"_{c}.tai2")), zero)
        since |= {c: high + low, f"{c}_jd1": F.col(f"_{c}.utc1"), f"{c}_jd2": F.col(f"_{c}.utc2")}
    return rows.withColumns(since).drop("_utc1", "_utc2", "_tai1", "_tai2", "_epoch", "_next", "_first", "_begin", "_end")


def canonical_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def _parted(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """rows with _part, a range of (keys, _t, _side, _tie) in ascending order; written, so that parts stay what they are."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *keys, "_t", "_side", "_tie").withColumn("_part", F.spark_partition_id())
    path = f"{runtime.scratch_root(spark)}/skyframe/asof-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: list[str], tie: str, parts: int | None = None) -> DataFrame:
    """Each left row with the values of the right row of its keys that is nearest in t (the earlier one of two, then the least `tie`), null if none is.

    Both sides are merged in time, so that no key's rows meet pairwise: the last right row at or before, and the first at or after, come
    from running windows. With `parts`, rows are dealt by ranges of key and time instead of by key, so that a key of any size is
    shared among tasks: windows run within a range, and what they would have had from the ranges before and behind comes from a
    table with one row for each key and range, scanned in turn. That costs a written table in the shared folder, which is the
    caller's to delete with it.
    """
    right_rows = right.select(*keys, F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.struct(F.col(t).alias("_at"), F.col(tie).alias("_by"), *value).alias("_r"))
    left_rows = left.select(*keys, F.col(t).alias("_t"), F.struct(*left.columns).alias("_l"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True).withColumn("_side", F.col("_l").isNotNull().cast("int"))
    within = keys
    if parts:
        both, within = _parted(both, keys, parts), [*keys, "_part"]
    # of right rows of one time the least tie is met last, whichever way the window runs
    back = Window.partitionBy(*within).orderBy("_t", "_side", F.col("_tie").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*within).orderBy(F.col("_t").desc(), "_side", F.col("_tie").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_before": F.last("_r", True).over(back), "_after": F.last("_r", True).over(ahead)}).filter("_l IS NOT NULL")
    if parts:
        found = _carried(found, both, keys)
    gap = lambda r: F.abs(F.col("_t").cast("double") - F.col(f"{r}._at").cast("double"))
    best = F.when(F.col("_before").isNull() | (gap("_after") < gap("_before")), F.col("_after")).otherwise(F.col("_before"))
    return found.withColumn("_best", best).select("_l.*", *(F.col(f"_best.{v}").alias(v) for v in value))


def _carried(found: DataFrame, both: DataFrame, keys: list[str]) -> DataFrame:
    """found with the last right row of earlier ranges of its key, and the first one of later ranges.

    A time may go over several ranges, so that of equally near rows the one with the least tie is taken.
    """
    order = lambda sign: F.struct((sign * F.col("_t").cast("double")).alias("at"), F.col("_tie").alias("tie"))
    ends = both.groupBy(*keys, "_part").agg(F.min_by(F.when(F.col("_side") == 0, F.struct("_r", "_t")), F.when(F.col("_side") == 0, order(-1))).alias("last"), F.min_by(F.when(F.col("_side") == 0, F.struct("_r", "_t")), F.when(F.col("_side") == 0, order(1))).alias("first"))
    nearest = lambda column, sign: F.struct((sign * F.col(f"{column}._t").cast("double")).alias("at"), F.col(f"{column}._r._by").alias("tie"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    pick = lambda column, sign, w: F.min_by(F.col(f"{column}._r"), F.when(F.col(column).isNotNull(), nearest(column, sign))).over(w)
    ends = ends.select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys)), F.col("_part").alias("_p"), pick("last", -1, earlier).alias("_prior"), pick("first", 1, later).alias("_coming"))
    match = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_{n}"))
    found = found.join(ends, match, "left")
    nearer = lambda own, other: F.when(F.col(own).isNull() | ((F.col(own)["_at"] == F.col(other)["_at"]) & (F.col(other)["_by"] < F.col(own)["_by"])), F.col(other)).otherwise(F.col(own))
    return found.withColumns({"_before": nearer("_before", "_prior"), "_after": nearer("_after", "_coming")})
