"""Inputs for the registered queries, made from the driver's tables.

Objects are customers on straight lines with coefficients that are exact in single precision, so that any engine gets the same
boxes and codes. Each fragment is an expression of the key k that Spark SQL and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

ORDER, MAX_T, INTERVAL, THRESHOLD, SHIFT = 3, 2.75, 0.375, 1.1, 0.013671875
START = {"x": "((k*37)%1009-504)/32.0", "y": "((k*53)%1013-506)/32.0", "z": "((k*71)%1019-509)/32.0", "r": "20+((k*7)%11)/64.0"}
SPEED = {"x": "((k*13)%17-8)/16.0", "y": "((k*29)%19-9)/16.0", "z": "((k*31)%23-11)/16.0"}
#: Most objects of a clustered set lie in a small part of the space, the others far away.
CLUSTERED = START | {a: f"CASE WHEN k%8<>0 THEN ({START[a]})/2.0 ELSE ({START[a]})*8.0 END" for a in "xyz"}
BEGIN = "(k%4)*0.25"
MOVES = "k%7<>0"
OTYPE = "CASE WHEN k%10=0 THEN 4 WHEN k%10<=6 THEN 1 ELSE 2 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small table from which many follow: a file of few bytes would make one task of them all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return rows.select(F.col("k").alias("obj_idx"), F.expr("IF(k%7=0, 13, 0)").alias("status"), (F.col("k") + 40000).alias("norad_id"), F.expr(OTYPE).alias("otype"))


def segments(spark: SparkSession, sf_dir: str, begins: dict[str, str] = START) -> DataFrame:
    """Two steps of a day each for all objects that move."""
    rows = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).filter(MOVES), "k")
    rows = rows.withColumn("step_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("t_begin", F.expr(f"CAST({BEGIN} AS DOUBLE)") + F.col("step_idx"))
    zero = F.lit(0.0)
    out = {}
    for a in "xyz":
        start, speed = F.expr(f"CAST({begins[a]} AS DOUBLE)"), F.expr(f"CAST({SPEED[a]} AS DOUBLE)")
        out[a] = F.array(start + speed * (F.col("t_begin") - SHIFT), speed, zero, zero)
        out["v" + a] = F.array(speed, zero, zero, zero)
    out["r"] = F.array(F.expr(f"CAST({begins['r']} AS DOUBLE)"), zero, zero, zero)
    return rows.select(F.col("k").alias("obj_idx"), "step_idx", "t_begin", (F.col("t_begin") + 1).alias("t_end"), *(out[c].alias(c) for c in schema.COORDS))


def curved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, segments) of order 4: a pair a supplier, of which one rests and the other comes by twice on a parabola; pairs are far apart."""
    k = "s_suppkey"
    rows = table(spark, sf_dir, "supplier").withColumn("moves", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("obj_idx", F.expr(f"2*{k} + moves"))
    objects = rows.select("obj_idx", F.lit(0).alias("status"), F.col("obj_idx").alias("norad_id"), F.lit(schema.PRIMARY).alias("otype"))
    flat = lambda *c: F.array(*(F.expr(x) for x in c), *[F.lit(0.0)] * (5 - len(c)))
    state = {"x": flat(f"moves*(1-({k}%5+1)/8.0D)", "moves*-2.0D", "moves*1.0D"), "y": flat(f"moves*({k}%3)/16.0D"), "z": flat(f"8.0D*{k}")}
    state |= {"vx": flat("moves*-2.0D", "moves*2.0D"), "vy": flat("0.0D"), "vz": flat("0.0D"), "r": flat("1.0D")}
    return objects, rows.select("obj_idx", F.lit(0).alias("step_idx"), F.lit(0.0).alias("t_begin"), F.lit(2.0).alias("t_end"), *(state[c].alias(c) for c in schema.COORDS))


def gpes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible near-earth elements, one row a supplier."""
    k = "s_suppkey"
    rows = table(spark, sf_dir, "supplier")
    return rows.select(
        F.col(k).alias("norad_id"),
        F.lit(2460000.5).alias("epoch_jd1"),
        F.expr(f"({k}%8)/64.0D").alias("epoch_jd2"),
        F.expr(f"(14.2D+({k}*37%100)/100.0D)*2*pi()/1440").alias("n0"),
        F.expr(f"0.0005D+({k}*13%50)/10000.0D").alias("e0"),
        F.expr(f"radians(({k}*29%100)*0.98D+1)").alias("i0"),
        F.expr(f"radians({k}*53%360+0.0D)").alias("node0"),
        F.expr(f"radians({k}*71%360+0.0D)").alias("omega0"),
        F.expr(f"radians({k}*97%360+0.0D)").alias("m0"),
        F.expr(f"({k}%5)*1e-5D").alias("bstar"),
    )
