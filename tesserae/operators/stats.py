"""Statistics of feature tables: a wide aggregate first, then work on few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.quantiles import quantiles


def melt(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of keys, feature and value."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("_m")).select(*keys, "_m.feature", "_m.value")


def column_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, mean, std, variance (population), q25, q75, iqr, low, high: a row for each column, in the plan."""
    parts = (F.struct(F.avg(n).cast("double").alias("mean"), F.stddev_pop(n).cast("double").alias("std"), F.var_pop(n).cast("double").alias("variance"), F.min(n).cast("double").alias("low"), F.max(n).cast("double").alias("high")).alias(n) for n in names)
    row, q = df.agg(*parts).first(), quantiles(df, dict.fromkeys(names, (0.25, 0.75)))
    rows = []
    for n in names:
        s, (q25, q75) = row[n], q[n]
        rows.append((n, s["mean"], s["std"], s["variance"], q25, q75, None if q25 is None else q75 - q25, s["low"], s["high"]))
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, std double, variance double, q25 double, q75 double, iqr double, low double, high double").coalesce(1)


def acceptance(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, count, min, p05, mean, median, p95, max and std (of a sample) of numeric columns; missing values don't count."""
    parts = (F.struct(F.count(n).alias("count"), F.min(n).cast("double").alias("min"), F.avg(n).cast("double").alias("mean"), F.max(n).cast("double").alias("max"), F.stddev_samp(n).cast("double").alias("std")).alias(n) for n in fields)
    row, q = df.agg(*parts).first(), quantiles(df, dict.fromkeys(fields, (0.05, 0.5, 0.95)))
    rows = [(n, row[n]["count"], row[n]["min"], q[n][0], row[n]["mean"], q[n][1], q[n][2], row[n]["max"], row[n]["std"]) for n in fields if row[n]["count"]]
    return df.sparkSession.createDataFrame(rows, "field string, count long, min double, p05 double, mean double, median double, p95 double, max double, std double").coalesce(1)


def checksums(df: DataFrame, group: str, key: Column) -> DataFrame:
    """A checksum of the keys of each group that doesn't depend on their order: the sum of 48-bit hashes, and the count.

    Sums combine before the shuffle, so a group of any size costs as much.
    """
    value = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(group).agg(F.concat(F.sum(value).cast("decimal(38,0)").cast("string"), F.lit("-"), F.count("*").cast("string")).alias("checksum"))


def split_matrix(df: DataFrame, groups: dict[str, dict], names: dict[str, Sequence[str]], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The matrix that clusters and the one that only explains.

    ``groups`` are settings (enabled, dims, cluster, weight) in column order,
    ``names`` their columns.  Columns without spread are dropped, those
    that cluster get their group's weight, the others stay as they are.
    """
    cut = {g: list(names[g])[: how.get("dims", len(names[g]))] for g, how in groups.items() if how.get("enabled", True)}
    every = [n for ns in cut.values() for n in ns]
    row = df.agg(*(F.stddev_pop(n).alias(n) for n in every)).first()
    alive = {n for n in every if (row[n] or 0.0) > 1e-12}
    cluster = [(F.col(n) * float(groups[g].get("weight", 1.0))).alias(n) for g, ns in cut.items() if groups[g].get("cluster", True) for n in ns if n in alive]
    explain = [F.col(n) for g, ns in cut.items() if not groups[g].get("cluster", True) for n in ns if n in alive]
    return df.select(*keys, *cluster), df.select(*keys, *explain)


def diagnostics(df: DataFrame, names: Sequence[str], mi: DataFrame | None = None) -> DataFrame:
    """Column statistics with is_dead: an IQR strictly below the 10th percentile of all IQRs (five features or more).

    With ``mi`` (feature, mi) a feature must be below the tenth percentile of
    that, too.
    """
    out = column_stats(df, names)
    every = Window.partitionBy(F.lit(0))
    if mi is not None:
        out = out.join(mi, "feature", "left")
    dead = F.col("iqr") < F.percentile("iqr", F.lit(0.1)).over(every)
    if mi is not None:
        dead = dead & (F.col("mi") < F.percentile("mi", F.lit(0.1)).over(every))
    return out.select("feature", *(F.round(c, 6).alias(c) for c in ("mean", "std", "iqr", "variance")), (dead & F.lit(len(names) >= 5)).alias("is_dead"))


def iqr_weights(df: DataFrame, groups: dict[str, Sequence[str]], base: dict[str, float] | None = None) -> DataFrame:
    """group and weight: the group's mean IQR by the mean over groups, times its base weight, within 0.5 and 2."""
    of = F.create_map(*(F.lit(x) for g, fs in groups.items() for f in fs for x in (f, g)))
    weight = F.create_map(*(F.lit(x) for g in groups for x in (g, float((base or {}).get(g, 1.0)))))
    stats = column_stats(df, [f for fs in groups.values() for f in fs])
    by = stats.groupBy(of[F.col("feature")].alias("group")).agg(F.greatest(F.avg("iqr"), F.lit(1e-10)).alias("iqr"))
    raw = F.col("iqr") / F.avg("iqr").over(Window.partitionBy(F.lit(0))) * weight[F.col("group")]
    return by.select("group", F.round(F.least(F.greatest(raw, F.lit(0.5)), F.lit(2.0)), 4).alias("weight"))


def cluster_summary(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """cluster, feature, count, mean and population deviation; noise is a cluster of its own."""
    wide = df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names))
    parts = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n)["m"].alias("mean"), F.col(n)["s"].alias("std")) for n in names))
    return wide.select(cluster, F.col("n").alias("count"), F.explode(parts).alias("_p")).select(cluster, "count", "_p.feature", "_p.mean", "_p.std")


def cluster_preview(df: DataFrame, key: str, cluster: str = "cluster_id", examples: int = 3) -> DataFrame:
    """cluster, count and the first examples by key; ranked within tasks' groups, never collected."""
    ranked = df.select(cluster, key, F.row_number().over(Window.partitionBy(cluster).orderBy(key)).alias("_r"))
    first = ranked.where(F.col("_r") <= examples).groupBy(cluster).agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return df.groupBy(cluster).agg(F.count("*").alias("count")).join(first, cluster)


def _global(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {n: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0)) for i, n in enumerate(names)}


def deviations(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id", noise: bool = False) -> DataFrame:
    """cluster, feature, deviation: how far the cluster's mean lies from the dataset's, in deviations of the dataset."""
    overall = _global(df, names)
    rows = cluster_summary(df if noise else df.where(F.col(cluster) >= 0), names, cluster)
    mean = F.create_map(*(F.lit(x) for n in names for x in (n, overall[n][0])))
    std = F.create_map(*(F.lit(x) for n in names for x in (n, overall[n][1])))
    return rows.select(cluster, "feature", "mean", (F.abs(F.col("mean") - mean[F.col("feature")]) / (std[F.col("feature")] + 1e-8)).alias("deviation"))


def importance(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id", top: int = 5) -> DataFrame:
    """The features of each cluster that deviate most, with their rank."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("deviation"), "feature"))
    return deviations(df, names, cluster).select(cluster, "feature", "deviation", rank.alias("rank")).where(F.col("rank") <= top)


def distinctiveness(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """cluster, mean deviation and its grade."""
    by = deviations(df, names, cluster).groupBy(cluster).agg(F.avg("deviation").alias("distinctiveness"))
    d = F.col("distinctiveness")
    return by.select(cluster, F.round(d, 4).alias("distinctiveness"), F.when(d >= 1.0, "distinct").when(d >= 0.6, "moderate").otherwise("weak").alias("quality"))


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature_a, feature_b and r of all pairs a < b by place: one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def redundant_pairs(df: DataFrame, names: Sequence[str], least: float = 0.95) -> DataFrame:
    return correlations(df, names).where(F.abs("r") >= least)


def prune_correlated(df: DataFrame, names: Sequence[str], least: float = 0.95) -> list[str]:
    """Features that stay when, in order, each one too close to a kept one goes."""
    near = {(r["feature_a"], r["feature_b"]) for r in redundant_pairs(df, names, least).collect()}
    kept: list[str] = []
    for n in names:
        if not any((k, n) in near for k in kept):
            kept.append(n)
    return kept


def percentile_ranks(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """cluster, feature, percentile: share of all rows below the cluster's mean, times 100.

    The clusters' means (clusters times features) are sorted arrays in the
    plan; rows are counted by the place where they fall among them, which
    combines before the shuffle.
    """
    means = [(r[cluster], r["feature"], r["mean"]) for r in cluster_summary(df.where(F.col(cluster) >= 0), names, cluster).collect()]
    cuts = {n: sorted({m for _, f, m in means if f == n}) for n in names}
    spark = df.sparkSession
    if not means:
        return spark.createDataFrame([], "cluster_id int, feature string, percentile double").withColumnRenamed("cluster_id", cluster)

    def place(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda m: m <= F.col(name)))

    placed = df.select(*(place(n).alias(n) for n in names))
    counts = melt(placed, names).groupBy("feature", F.col("value").cast("int").alias("place")).agg(F.count("*").alias("c"))
    below = Window.partitionBy("feature").orderBy("place")
    total = Window.partitionBy("feature")
    shares = counts.select("feature", "place", (F.sum("c").over(below) * 100 / F.sum("c").over(total)).alias("percentile"))
    # rows with place k or less lie below the mean that is k-th from 0
    wanted = spark.createDataFrame([(c, f, cuts[f].index(m)) for c, f, m in means], f"{cluster} int, feature string, at int")
    last = wanted.join(shares, "feature").where("place <= at").groupBy(cluster, "feature").agg(F.max("percentile").alias("percentile"))
    return wanted.select(cluster, "feature").join(last, [cluster, "feature"], "left").withColumn("percentile", F.coalesce("percentile", F.lit(0.0)))


def entropy(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, entropy (nats) of a histogram of min(50, n // 10 + 1) equal bins."""
    row = df.agg(F.count("*").alias("n"), *(F.struct(F.min(f).cast("double"), F.max(f).cast("double")).alias(f) for f in names)).first()
    bounds, n = {f: row[f] for f in names}, row["n"]
    bins = min(50, n // 10 + 1)

    def at(name: str) -> Column:
        low, high = bounds[name]
        width = (high - low) or 1.0
        low = low if high > low else low - 0.5
        return F.least(F.floor((F.col(name) - low) / width * bins), F.lit(bins - 1)).cast("double")

    counts = melt(df.select(*(at(f).alias(f) for f in names)), names).groupBy("feature", "value").agg((F.count("*") / F.lit(n)).alias("p"))
    return counts.groupBy("feature").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("entropy"))


def _min_max(name: str) -> Column:
    every = Window.partitionBy(F.lit(0))
    low, high = F.min(name).over(every), F.max(name).over(every)
    return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(0.5)


def reliability(df: DataFrame, names: Sequence[str], mi: DataFrame, groups: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Per feature the product of normalised MI and IQR; per group its mean and a weight of 0.5 to 1.5."""
    of = F.create_map(*(F.lit(x) for g, fs in groups.items() for f in fs for x in (f, g)))
    stats = column_stats(df, names).join(mi, "feature").join(entropy(df, names), "feature")
    per = stats.select("feature", "mi", "iqr", "variance", "entropy", (F.col("std") < 1e-5).alias("is_dead"), F.round(_min_max("mi") * _min_max("iqr"), 4).alias("reliability"))
    by = per.groupBy(of[F.col("feature")].alias("group")).agg(F.round(F.avg("reliability"), 4).alias("reliability"))
    every = Window.partitionBy(F.lit(0))
    low, high = F.min("reliability").over(every), F.max("reliability").over(every)
    by = by.select("group", "reliability", F.round(F.when(high > low, 0.5 + (F.col("reliability") - low) / (high - low)).otherwise(1.0), 4).alias("weight"))
    return per, by


def anova(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """feature and F of a one-way analysis of variance over clusters; from sums by cluster."""
    rows = df.where(F.col(cluster) >= 0)
    by = rows.groupBy(cluster).agg(F.count("*").alias("n"), *(F.struct(F.avg(n).alias("m"), F.var_pop(n).alias("v")).alias(n) for n in names))
    long = by.select(cluster, "n", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n)["m"].alias("m"), F.col(n)["v"].alias("v")) for n in names))).alias("p")).select("n", "p.*")
    sums = long.groupBy("feature").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("all"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("all")
    return sums.select("feature", ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("all") - F.col("k")))).alias("anova_f"))


def kruskal(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """feature and H over clusters, average ranks and tie correction.

    Equal values are counted together first; ranks follow from running
    counts over distinct values.
    """
    rows = melt(df.where(F.col(cluster) >= 0), names, [cluster])
    counts = rows.groupBy("feature", "value", cluster).agg(F.count("*").alias("c"))
    ties = counts.groupBy("feature", "value").agg(F.sum("c").alias("t"))
    before = Window.partitionBy("feature").orderBy("value")
    ranks = ties.select("feature", "value", "t", (F.sum("t").over(before) - (F.col("t") - 1) / 2).alias("rank"))
    totals = ranks.groupBy("feature").agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("tied"))
    by = counts.join(ranks, ["feature", "value"]).groupBy("feature", cluster).agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("m"))
    sums = by.groupBy("feature").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s")).join(totals, "feature")
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("tied") / (n**3 - n))
    return sums.select("feature", h.alias("kruskal_h"))


def contribution(df: DataFrame, names: Sequence[str], mi: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The mean of the three normalised scores of each feature (F, H, MI) and whether it is below 0.2."""
    joined = anova(df, names, cluster).join(kruskal(df, names, cluster), "feature").join(mi, "feature")
    c = F.round((_min_max("anova_f") + _min_max("kruskal_h") + _min_max("mi")) / 3, 4)
    return joined.select("feature", "anova_f", "kruskal_h", "mi", c.alias("contribution"), (c < 0.2).alias("low_contribution"))


def robust_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns less their median, by their IQR (1 where it is 0)."""
    q = quantiles(df, dict.fromkeys(names, (0.25, 0.5, 0.75)))
    scale = lambda n: (F.col(n) - F.lit(q[n][1])) / F.lit((q[n][2] - q[n][0]) or 1.0)
    return df.withColumns({n: scale(n) for n in names if q[n][1] is not None})


def standard_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns less their mean, by their population deviation (1 where it is 0)."""
    of = _global(df, names)
    return df.withColumns({n: (F.col(n) - F.lit(of[n][0])) / F.lit(of[n][1] or 1.0) for n in names})


def apply_weights(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({n: F.col(n) * F.lit(w) for n, w in weights.items() if n in df.columns})


def select_existing(df: DataFrame, wanted: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Keys and those of the wanted columns that there are."""
    return df.select(*keys, *(c for c in wanted if c in df.columns))
