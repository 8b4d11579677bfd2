"""Schemas of the tables that the package reads and writes."""

from pyspark.sql import types as T

COORDS = ("x", "y", "z", "vx", "vy", "vz", "r")
PRIMARY, SECONDARY, MASKED = 1, 2, 4
#: What can end a satellite's propagation.
STATUS = {0: "ok", 1: "mean eccentricity", 2: "mean motion", 3: "perturbed eccentricity", 4: "semi-latus rectum", 6: "decay", 10: "non-finite", 11: "reentry", 12: "exit", 13: "small step", 14: "interpolation"}

GPE = T.StructType([T.StructField("norad_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("epoch_jd1", "epoch_jd2", "n0", "e0", "i0", "node0", "omega0", "m0", "bstar")])
CATALOG = T.StructType(
    [T.StructField("norad_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("cospar_id", "name", "epoch")]
    + list(GPE.fields[1:])
    + [T.StructField(c, T.StringType()) for c in ("tle_line1", "tle_line2")]
    + [T.StructField("rms", T.DoubleType()), T.StructField("ops_code", T.StringType()), T.StructField("rcs", T.DoubleType())]
)
SEGMENTS = T.StructType(
    [T.StructField("obj_idx", T.LongType()), T.StructField("step_idx", T.IntegerType()), T.StructField("t_begin", T.DoubleType()), T.StructField("t_end", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in COORDS]
)
OBJECTS = T.StructType([T.StructField("obj_idx", T.LongType()), T.StructField("status", T.IntegerType()), T.StructField("norad_id", T.LongType()), T.StructField("otype", T.IntegerType())])
CONJUNCTIONS = "cd_idx long, i long, j long, tca double, dca double, ri array<double>, vi array<double>, rj array<double>, vj array<double>"
