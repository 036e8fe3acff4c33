"""Two-sample tests, density, histogram, box plot, profile correlation.

Each one reduces the rows to counts per distinct value or to a few moments
by a map-side combined aggregate before anything is ordered or joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.nulls import safe_corr, safe_ratio
from haulframe.functions.smirnov import smirnov_exact_p
from haulframe.functions.student_t import t_quantile, t_two_sided_p
from haulframe.operators.joins import attach, null_safe_join
from haulframe.operators.ordered import quantiles, running_totals, value_counts
from haulframe.operators.reshape import pivot_wider
from haulframe.operators.window import zscore
from haulframe.sources.scratch import materialize


def _moments(group: Column, level, value: str, tag: str) -> list[Column]:
    v = F.when(group == F.lit(level), F.col(value))
    return [
        F.count(v).alias(f"n_{tag}"),
        F.avg(v).alias(f"mean_{tag}"),
        F.var_samp(v).alias(f"var_{tag}"),
    ]


def welch_statistic(df: DataFrame, group: str, value: str, x, y) -> DataFrame:
    """t and degrees of freedom of the two-sample test, one row.

    A sample with fewer than two values gives NULL.
    """
    g = F.col(group)
    m = df.agg(*_moments(g, x, value, "x"), *_moments(g, y, value, "y"))
    ex = safe_ratio("var_x", "n_x")
    ey = safe_ratio("var_y", "n_y")
    freedom = safe_ratio(
        F.pow(ex + ey, 2),
        safe_ratio(F.pow(ex, 2), F.col("n_x") - 1)
        + safe_ratio(F.pow(ey, 2), F.col("n_y") - 1),
    )
    error = F.sqrt(ex + ey)
    return m.select(
        safe_ratio(F.col("mean_x") - F.col("mean_y"), error).alias("t"),
        freedom.alias("df"),
        error.alias("stderr"),
        "mean_x", "mean_y", "n_x", "n_y",
    )


def welch_test(
    df: DataFrame, group: str, value: str, x, y, level: float = 0.95
) -> DataFrame:
    """Welch two-sample t-test with two-sided p and confidence interval."""
    # an aggregate of all rows: the Python tail functions see one row
    stat = welch_statistic(df, group, value, x, y)
    diff = F.col("mean_x") - F.col("mean_y")
    tested = stat.withColumns(
        {
            "p_value": t_two_sided_p(F.col("t"), F.col("df")),
            "__q": t_quantile(F.lit((1 + level) / 2), F.col("df")),
        }
    )
    return tested.select(
        "t", "df", "p_value",
        (diff - F.col("__q") * F.col("stderr")).alias("ci_lo"),
        (diff + F.col("__q") * F.col("stderr")).alias("ci_hi"),
        "mean_x", "mean_y", "n_x", "n_y",
    )


def kolmogorov_tail(scaled: Column) -> Column:
    """Upper tail of the limiting distribution of the scaled maximum gap."""
    terms = F.sequence(F.lit(1), F.lit(100))
    far = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(-2.0 * k * k * scaled * scaled),
    )
    near = F.lit(1.0) - F.sqrt(2 * F.pi()) / scaled * F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.exp(
            -F.pow(2.0 * k - 1.0, F.lit(2.0)) * F.pi() * F.pi()
            / (8.0 * scaled * scaled)
        ),
    )
    tail = F.when(scaled < 1e-3, F.lit(1.0)).when(scaled < 1, near).otherwise(far)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))


def ks_test(
    df: DataFrame, group: str, value: str, x, y, exact: bool = False
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test: D and p, one row.

    Both samples are reduced to counts per distinct value; an empty sample
    gives NULL.  p is asymptotic; with ``exact`` it is the share of all orders of the
    pooled values, ties as they are, that reach D.  That takes as many steps as the
    product of the sample sizes, and one row that lists the runs of equal values.
    """
    g = F.col(group)
    counts = (
        df.filter(F.col(value).isNotNull() & g.isin(x, y))
        .groupBy(value)
        .agg(
            F.count_if(g == F.lit(x)).alias("in_x"),
            F.count_if(g == F.lit(y)).alias("in_y"),
        )
    )
    upto = running_totals(
        counts,
        [],
        [value],
        {"upto_x": F.col("in_x"), "upto_y": F.col("in_y")},
        {"upto_x": "n_x", "upto_y": "n_y"},
    )
    gap = F.abs(safe_ratio("upto_x", "n_x") - safe_ratio("upto_y", "n_y"))
    runs = [
        F.sort_array(F.collect_list(F.struct(value, (F.col("in_x") + F.col("in_y")).alias("n"))))
        .alias("runs")
    ] if exact else []
    found = upto.agg(
        F.max(gap).alias("D"), F.max("n_x").alias("n_x"), F.max("n_y").alias("n_y"), *runs
    )
    n_x, n_y = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    scaled = F.col("D") * F.sqrt(F.try_divide(n_x * n_y, n_x + n_y))
    p_value = F.when(F.col("D").isNotNull(), kolmogorov_tail(scaled))
    if exact:
        p_value = smirnov_exact_p("D", "n_x", "n_y", F.col("runs.n"))
    return found.select("D", p_value.alias("p_value"), "n_x", "n_y")


def bandwidths(
    df: DataFrame, keys: Sequence[str], value: str, adjust: float = 1.0
) -> DataFrame:
    """Rule-of-thumb bandwidth, size and range per group."""
    v = F.col(value).cast("double")
    moments = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_group"),
            F.stddev_samp(v).alias("sd"),
            F.min(v).alias("least"),
            F.max(v).alias("most"),
        )
    )
    box = quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.least("sd", iqr)
    size = F.greatest(F.abs("least"), F.abs("most"))
    width = (
        F.when(spread > 0, spread)
        .when(F.col("sd") > 0, F.col("sd"))
        .when(size > 0, size)
        .otherwise(F.lit(1.0))
    )
    return null_safe_join(moments, box, keys).select(
        *keys,
        "n_group",
        "least",
        "most",
        (F.lit(0.9 * adjust) * width * F.pow(F.col("n_group"), F.lit(-0.2))).alias("bw"),
    )


def _panel_limits(groups: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Attach the range shared by all groups of a panel."""
    limits = groups.groupBy(*panel).agg(
        F.min("least").alias("x_min"), F.max("most").alias("x_max")
    )
    return null_safe_join(groups, limits, panel).drop("least", "most")


def kernel_density(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    adjust: float = 1.0,
    points: int = 512,
    panel: Sequence[str] = (),
) -> DataFrame:
    """Gaussian density of each group on a regular grid over its panel's range.

    A group of a single value has no spread to smooth by: its rows have no density
    (NULL) rather than being left out.
    Values are first spread linearly over a grid of ``points`` nodes, so a
    group of any size reaches the kernel sum as at most ``points`` weights.
    ``panel`` (a subset of ``keys``) names the groups that share one range.
    """
    widths = materialize(bandwidths(df, keys, value, adjust))
    setup = _panel_limits(widths, panel)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    last = points - 1
    lo = F.col("x_min") - 4 * F.col("bw")
    step = (F.col("x_max") - F.col("x_min") + 8 * F.col("bw")) / last
    placed = (
        attach(rows, setup, keys, "inner")
        .withColumns({"lo": lo, "step": step})
        .withColumn("__at", (F.col(value).cast("double") - F.col("lo")) / F.col("step"))
        .withColumn("__node", F.floor("__at"))
        .withColumn("__part", F.col("__at") - F.col("__node"))
    )
    frame = [*keys, "x_min", "x_max", "bw", "lo", "step", "n_group"]
    counted = placed.groupBy(*frame, "__node").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("__part").alias("parts")
    )
    # each node passes part of its rows on to the next one
    cells = counted.select(
        *frame,
        F.explode(
            F.array(
                F.struct(
                    F.col("__node").alias("node"),
                    (F.col("rows") - F.col("parts")).alias("w"),
                ),
                F.struct((F.col("__node") + 1).alias("node"), F.col("parts").alias("w")),
            )
        ).alias("cell"),
    )
    binned = cells.groupBy(*frame, F.col("cell.node").alias("node")).agg(
        (F.sum("cell.w") / F.col("n_group")).alias("w")
    )
    # at most `points` weights per group
    packed = binned.groupBy(*frame).agg(
        F.sort_array(F.collect_list(F.struct("node", "w"))).alias("cells")
    )
    grid = packed.withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(last)))
    ).withColumn(
        "x",
        F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("point") / last,
    )

    def kernel(acc, cell):
        z = (F.col("x") - (F.col("lo") + cell["node"] * F.col("step"))) / F.col("bw")
        return acc + cell["w"] * F.exp(-0.5 * z * z)

    total = F.aggregate("cells", F.lit(0.0), kernel)
    return grid.select(
        *keys,
        "point",
        "x",
        F.when(F.col("n_group") >= 2, total / (F.col("bw") * F.sqrt(2 * F.pi()))).alias("density"),
    )


def histogram(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bins: int = 30,
    panel: Sequence[str] = (),
    mirrored: Column | None = None,
) -> DataFrame:
    """Counts and density per bin, also of the empty bins of each group.

    The first bin is centred on the panel minimum, the last on its maximum,
    and bins are closed on the right.  Where ``mirrored`` holds the density
    gets a minus sign.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    v = F.col(value).cast("double")
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_group"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    )
    spread = F.col("x_max") - F.col("x_min")
    setup = _panel_limits(sizes, panel).withColumn(
        "width", F.when(spread > 0, spread / (bins - 1)).otherwise(F.lit(0.1))
    )
    left = F.col("x_min") - F.col("width") / 2
    # a value on a bin edge belongs to the bin it closes, despite rounding
    at = F.greatest(F.ceil((v - left) / F.col("width") - 1e-8), F.lit(1))
    every = F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    empty = setup.select(*keys, every, "x_min", "width", "n_group", F.lit(0).alias("n"))
    counted = (
        attach(rows, setup, keys)
        .withColumn("bin", at.cast("int"))
        .groupBy(*keys, "bin", "x_min", "width", "n_group")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per group and bin on either side
    binned = counted.unionByName(empty).groupBy(
        *keys, "bin", "x_min", "width", "n_group"
    ).agg(F.sum("n").cast("long").alias("n"))
    density = F.col("n") / (F.col("n_group") * F.col("width"))
    if mirrored is not None:
        density = F.when(mirrored, 0.0 - density).otherwise(density)
    return binned.select(
        *keys,
        "bin",
        (F.col("x_min") + (F.col("bin") - 1) * F.col("width")).alias("center"),
        "width",
        "n",
        density.alias("density"),
    )


def _with_fences(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with their group's quartiles and whether they lie within 1.5 IQR."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    box = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col(value).cast("double").between(F.col("q1") - reach, F.col("q3") + reach)
    return attach(rows, box, keys).withColumn("__within", within)


def boxplot(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, outlier count."""
    inside = F.when(F.col("__within"), F.col(value).cast("double"))
    return (
        _with_fences(df, keys, value)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(inside).alias("lower"),
            F.max(inside).alias("upper"),
            F.count_if(~F.col("__within")).alias("n_outliers"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values beyond the whiskers with their counts."""
    return value_counts(
        _with_fences(df, keys, value).filter(~F.col("__within")), keys, value
    )


def bar_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    mirrored: Column | None = None,
    name: str = "y",
) -> DataFrame:
    """Totals per bar; negative where ``mirrored`` holds."""
    total = F.sum(value).alias(name)
    out = df.groupBy(*keys).agg(total)
    if mirrored is None:
        return out
    return out.withColumn(name, F.when(mirrored, -F.col(name)).otherwise(F.col(name)))


def standardized_profile(
    df: DataFrame,
    series: str,
    position: Sequence[str],
    within: Sequence[str],
    value: str,
) -> DataFrame:
    """Totals per (series, within, position), z-scored inside (series, within)."""
    totals = df.groupBy(series, *within, *position).agg(F.sum(value).alias(value))
    # one row per position of a profile
    return zscore(totals, [series, *within], value, "std", aggregated=True)


def profile_correlation(
    df: DataFrame,
    series: str,
    levels: tuple[str, str],
    position: Sequence[str],
    within: Sequence[str],
    value: str,
) -> DataFrame:
    """Correlation of two standardised profiles at the positions both have."""
    a, b = levels
    std = standardized_profile(df, series, position, within, value)
    wide = pivot_wider(
        std.filter(F.col(series).isin(a, b)),
        [*within, *position], series, "std", levels=[a, b],
    ).dropna("any", subset=[a, b])
    return wide.groupBy(*within).agg(safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("cor"))
