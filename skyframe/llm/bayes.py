"""Quality by hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a Gaussian discriminant on text statistics, fitted to the labelled rows by one aggregation. A host's
rate of good documents gets a Beta prior around the rate of all; a path's, one around its host's posterior. The priors' strengths
come from the spread of rates between sites (method of moments), so sparse sites shrink towards what is above them. A document's
log-odds are its evidence plus the log-odds of its path's posterior, taken without the document itself, so that nothing counts twice.

A table of documents has `source` for the host and `lang` for the path below it; other columns can be named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, rules

#: Statistics of a text, from the counts of rules.counts() and from its letters, each on a scale where a spread of about 1 is usual.
STATISTICS = ("symbols", "word_length", "dup_lines", "repeats", "capitals", "breaks", "echoes")
FLOOR = 0.05
MOST_EVIDENCE = 8.0
LEAST = 0.4
#: Evidence counts by n / (n + HALF_WORDS) in a text of n words: a few words say little.
HALF_WORDS = 40


def evidence_columns(text: Column, c: Column) -> list[Column]:
    """STATISTICS of a text with counts c."""
    text = F.coalesce(text, F.lit(""))
    words = F.greatest(c["n_words"], F.lit(1))
    letters = F.greatest(F.regexp_count(text, F.lit("[A-Za-z]")), F.lit(1))
    return [
        F.log1p(c["n_symbols"] / words * 20),
        F.log1p(c["word_chars"] / words),
        F.log1p(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)) * 5),
        F.log1p(c["n_repeat_words"] / words * 5),
        F.log1p(F.regexp_count(text, F.lit("[A-Z]")) / letters * 20),
        F.log1p(F.regexp_count(text, F.lit("!!|[|] ")) / words * 20),
        F.log1p(c["n_echoes"] / words * 10),
    ]


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _moments(rows: DataFrame) -> dict:
    """Mean and spread of each statistic for good and bad labelled rows, and their numbers: one row, from one aggregation."""
    out = []
    for k in (0, 1):
        mine = F.col("label") == k
        out.append(F.count(F.when(mine, 1)).alias(f"n{k}"))
        for s in STATISTICS:
            x = F.when(mine, F.col(s))
            out += [F.avg(x).alias(f"m{k}_{s}"), F.stddev_pop(x).alias(f"d{k}_{s}")]
    return rows.agg(*out).first().asDict()


def _evidence(m: dict) -> Column:
    """The log likelihood ratio of good to bad, at most MOST_EVIDENCE either way; 0 without labels of both kinds."""
    if not m["n0"] or not m["n1"]:
        return F.lit(0.0)

    def density(k: int, s: str) -> Column:
        d = max(m[f"d{k}_{s}"] or 0.0, FLOOR)
        return -0.5 * F.pow((F.col(s) - m[f"m{k}_{s}"]) / d, 2) - F.log(F.lit(d))

    total = reduce(lambda a, b: a + b, (F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), density(1, s) - density(0, s))) for s in STATISTICS))
    return F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), total))


def _strength(sites: DataFrame, mean: Column) -> float:
    """The prior's strength in documents: how little rates (good, n) differ around `mean` beyond chance. From 2 to 10,000."""
    r = F.col("good") / F.col("n")
    got = sites.filter("n > 1").agg(F.sum(F.col("n") * F.pow(r - mean, 2)).alias("s"), F.sum(mean * (1 - mean)).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("v")).first()
    if not got or not got["n"] or got["v"] is None or got["v"] <= 0:
        return 2.0
    between = max(got["s"] - got["chance"], 0.0) / got["n"]
    within = got["v"] / got["n"]
    return float(min(max(within / between - 1 if between > 0 else 1e4, 2.0), 1e4))


def site_sums(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """From rows (host, path, good): the sums (host, path, good, n, host_good, host_n) of each site, the rate of all rows, and the strengths of the hosts' and the paths' priors."""
    paths = common.materialise(rows.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    rate = (total[0] + 1.0) / (total[1] + 2.0) if total[1] else 0.5
    a = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("_host"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return joined, rate, a, _strength(joined, (F.col("host_good") + a * rate) / (F.col("host_n") + a))


def shrunk(rate: float, a: float, b: float, good: Column | None = None) -> tuple[Column, Column]:
    """The host's and the path's expected share of good documents, from the sums of site_sums(); with `good`, without the row that gave it."""
    own, one = (F.lit(0.0), 0) if good is None else (good, 1)
    host = (F.col("host_good") - own + a * rate) / (F.col("host_n") - one + a)
    return host, (F.col("good") - own + b * host) / (F.col("n") - one + b)


def site_posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate) from rows (host, path, good): expected shares of good documents, shrunk twice."""
    sums, *priors = site_sums(rows)
    host, path = shrunk(*priors)
    return sums.select("host", "path", host.alias("host_rate"), path.alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", least: float = LEAST) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, kept) for each row of docs.

    quality is the posterior probability of a good document, kept whether it reaches `least`. Labels of one id count once, with the
    lowest. Every row counts for its host and path, with its own evidence's probability where it has no label, but not for itself: the
    rates are those of the other rows. Null hosts and paths are a site each; null and empty texts count as texts without words; repeated
    rows and rows with a null id are judged each; other columns don't matter.
    """
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"), rules.counts(F.col(text)).alias("c"))
    rows = rows.select("doc_id", "host", "path", *(x.cast("double").alias(s) for s, x in zip(STATISTICS, evidence_columns(F.col("text"), F.col("c")), strict=True)), (F.col("c.n_words") / (F.col("c.n_words") + HALF_WORDS)).alias("trust"))
    rows = common.materialise(rows, "statistics")
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    rows = common.materialise(rows.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "labelled")
    m = _moments(rows.filter("label is not null"))
    prior = (m["n1"] + 1.0) / (m["n0"] + m["n1"] + 2.0)
    judged = rows.withColumn("evidence", F.col("trust") * _evidence(m))
    own = 1 / (1 + F.exp(-(F.col("evidence") + _log_odds(F.lit(prior)))))
    good = F.coalesce(F.col("label").cast("double"), own)
    judged = judged.withColumn("own", good)
    sites, *priors = site_sums(judged.select("host", "path", F.col("own").alias("good")))
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    out = judged.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host_rate, path_rate = shrunk(*priors, F.col("own"))
    out = out.select("doc_id", "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _log_odds(F.col("path_rate")))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", quality.alias("quality"), (quality >= least).alias("kept"))
