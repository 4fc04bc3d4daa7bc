"""Filters and aggregates over the scored and priced table.

Each takes a table, filtered or not, and returns the rows behind one figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.constants import IQR_MULTIPLIER, RISK_BANDS
from keelmark.functions.rounding import rounded
from keelmark.functions.statistics import exact_mean, exact_sum, share_pct
from keelmark.operators.profiling import QUARTILES
from keelmark.operators.quantiles import exact_quantiles, quantiles_of_rows, value_rows

CLASS_NAMES = {0: "Incomplete", 1: "Completed"}


def _n() -> Column:
    return F.count(F.lit(1))


def filter_incidents(
    df: DataFrame, regions: list[str] | None = None, years: tuple[int, int] | None = None,
    bands: list[str] | None = None, min_pct: float | None = None,
) -> DataFrame:
    """Rows that meet all given conditions; the conditions reach the scan."""
    if regions is not None:
        df = df.where(F.col("region").isin(regions))
    if years is not None:
        df = df.where(F.col("year").between(*years))
    if bands is not None:
        df = df.where(F.col("risk_band").isin(bands))
    if min_pct is not None:
        df = df.where(F.col("attack_probability_pct") >= min_pct)
    return df


def filter_regions(df: DataFrame) -> DataFrame:
    return df.select("region").where(F.col("region").isNotNull()).distinct().orderBy("region")


def filter_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), _n().alias("n_rows"),
        F.count_distinct("region").alias("n_regions"),
    )


def overview_kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(
        _n().alias("n_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        distinct("nearest_country").alias("n_countries"), distinct("region").alias("n_regions"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by name."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column).agg(_n().alias("n")).orderBy(F.desc("n"), F.asc(column))
    )


def annual_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("year").isNotNull()).groupBy("year").agg(_n().alias("n")).orderBy("year")


def peak_year(df: DataFrame) -> DataFrame:
    """The year with the most rows, the earliest one on a tie."""
    counts = df.where(F.col("year").isNotNull()).groupBy("year").agg(_n().alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("year")).limit(1)


def year_month_matrix(df: DataFrame) -> DataFrame:
    """Rows per year and month, a column per month, 0 where there are none."""
    months = list(range(1, 13))
    pivoted = df.where(F.col("year").isNotNull()).groupBy("year").pivot("month", months).count()
    return pivoted.select(
        "year", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m:02d}") for m in months]
    ).orderBy("year")


def distance_by_region(df: DataFrame, positive_only: bool = False, digits: int = 6) -> DataFrame:
    """Five-number summary, mean and rows of the shore distance per region."""
    rows = df.where(F.col("region").isNotNull())
    if positive_only:
        rows = rows.where(F.col("shore_distance") > 0)
    value = F.nanvl("shore_distance", F.lit(None).cast("double"))
    summary = rows.groupBy("region").agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
    )
    quartiles = exact_quantiles(rows, ["region"], "shore_distance", QUARTILES)
    return (
        summary.join(quartiles, "region")
        .select("region", "n", *[rounded(c, digits).alias(c) for c in ("min", "q25", "q50", "q75", "max", "mean")])
        .orderBy("region")
    )


def _class_name() -> Column:
    name = F.when(F.col("attack_occurred") == 0, CLASS_NAMES[0])
    return name.when(F.col("attack_occurred") == 1, CLASS_NAMES[1])


def class_counts(df: DataFrame) -> DataFrame:
    counts = df.where(F.col("attack_occurred").isNotNull()).groupBy("attack_occurred").agg(_n().alias("n"))
    return counts.select(_class_name().alias("class"), "n").orderBy(F.desc("n"), "class")


def region_class_counts(df: DataFrame) -> DataFrame:
    counts = (
        df.where(F.col("region").isNotNull() & F.col("attack_occurred").isNotNull())
        .groupBy("region", "attack_occurred").agg(_n().alias("n"))
    )
    return counts.select("region", "attack_occurred", _class_name().alias("class"), "n").orderBy(
        "region", "attack_occurred"
    )


def probability_kpis(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rows, mean percentage and shares of the high bands; 0 for an empty table."""
    def share(*bands: str) -> Column:
        return share_pct(F.count_if(F.col("risk_band").isin(*bands)), _n())

    return df.agg(
        _n().alias("n_rows"),
        rounded(F.coalesce(F.avg("attack_probability_pct"), F.lit(0.0)), digits).alias("avg_pct"),
        rounded(share("High", "Critical"), digits).alias("pct_high_or_critical"),
        rounded(share("Critical"), digits).alias("pct_critical"),
    )


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in RISK_BANDS]), band).cast("int")


def band_counts(df: DataFrame) -> DataFrame:
    """Rows of every band in band order, absent bands as 0, from one aggregate."""
    row = df.agg(F.array(*[
        F.struct(
            F.lit(i).alias("band_rank"), F.lit(b).alias("risk_band"),
            F.count_if(F.col("risk_band") == b).alias("n"),
        )
        for i, b in enumerate(RISK_BANDS)
    ]).alias("rows"))
    return row.select(F.inline("rows")).orderBy("band_rank")


def _bin(value: Column, low: Column, width: Column, bins: int) -> Column:
    """Bin number; the last bin is closed on the right, one value fills bin 0."""
    position = F.floor(F.coalesce(F.try_divide(value - low, width), F.lit(0.0)))
    return F.least(position, F.lit(bins - 1)).cast("int")


def probability_histogram(df: DataFrame, low: float = 0.0, high: float = 100.0, bins: int = 50) -> DataFrame:
    """Rows per bin of equal width and band; empty bins have no row."""
    width = (high - low) / bins
    pct = F.col("attack_probability_pct")
    rows = df.where(F.col("risk_band").isin(*RISK_BANDS) & pct.between(low, high))
    start = F.lit(low) + F.col("bin") * F.lit(width)
    return (
        rows.groupBy(_bin(pct, F.lit(low), F.lit(width), bins).alias("bin"), "risk_band").agg(_n().alias("n"))
        .select("bin", start.alias("bin_start"), (start + F.lit(width)).alias("bin_end"), "risk_band", "n")
        .orderBy("bin", band_rank(F.col("risk_band")))
    )


def premium_histogram(df: DataFrame, bins: int = 60, column: str = "total_premium_usd") -> DataFrame:
    """Rows per bin between the smallest and the largest premium."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("ends")).scalar()
    low = ends["low"]
    width = (ends["high"] - low) / bins
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(_bin(F.col(column), low, width, bins).alias("bin")).agg(_n().alias("n")).orderBy("bin")
    )


def probability_grid(df: DataFrame, cell_degrees: float = 5.0, digits: int = 6) -> DataFrame:
    """Sum, rows and mean of the percentages per cell of the globe."""
    located = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cells = {
        "lat_cell": F.floor(F.col("latitude") / F.lit(cell_degrees)),
        "lon_cell": F.floor(F.col("longitude") / F.lit(cell_degrees)),
    }
    return (
        located.groupBy(*[c.alias(name) for name, c in cells.items()])
        .agg(
            _n().alias("n"),
            rounded(F.sum("attack_probability_pct"), digits).alias("sum_pct"),
            rounded(F.avg("attack_probability_pct"), digits).alias("avg_pct"),
        )
        .orderBy("lat_cell", "lon_cell")
    )


def band_attack_hierarchy(df: DataFrame) -> DataFrame:
    """Rows per band and attack type, per band, and in all.

    Leaves are counted first, so the roll-up expands only the few leaf rows.
    """
    leaves = (
        df.where(F.col("risk_band").isNotNull() & F.col("attack_type").isNotNull())
        .groupBy("risk_band", "attack_type").agg(_n().alias("n"))
    )
    return (
        leaves.rollup("risk_band", "attack_type")
        .agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))
        .orderBy("level", "risk_band", "attack_type")
    )


def _mean_by(df: DataFrame, key: str, value: str, name: str, digits: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(rounded(F.avg(value), digits).alias(name))


def mean_probability_by_region(df: DataFrame, digits: int = 6) -> DataFrame:
    return _mean_by(df, "region", "attack_probability_pct", "avg_pct", digits).orderBy("avg_pct", "region")


def mean_probability_by_year(df: DataFrame, digits: int = 6) -> DataFrame:
    return _mean_by(df, "year", "attack_probability_pct", "avg_pct", digits).orderBy("year")


def mean_premium_by_region(df: DataFrame) -> DataFrame:
    means = df.where(F.col("region").isNotNull()).groupBy("region").agg(
        rounded(exact_mean(F.col("total_premium_usd")), 2).alias("avg_premium_usd")
    )
    return means.orderBy("avg_premium_usd", "region")


def portfolio_kpis(df: DataFrame) -> DataFrame:
    high = F.count_if(F.col("risk_band").isin("High", "Critical"))
    premium, rate = F.col("total_premium_usd"), F.col("premium_rate_pct")
    return df.agg(
        rounded(exact_mean(premium), 2).alias("avg_premium_usd"),
        rounded(F.stddev_samp(premium), 2).alias("std_premium_usd"),
        rounded(exact_mean(rate, 6), 6).alias("avg_rate_pct"),
        F.max(rate).alias("max_rate_pct"),
        exact_sum(premium).cast("double").alias("premium_pool_usd"),
        high.alias("n_high_or_critical"),
        rounded(share_pct(high, _n()), 6).alias("pct_high_or_critical"),
    )


def rate_by_band(df: DataFrame, multiplier: float = IQR_MULTIPLIER, digits: int = 6) -> DataFrame:
    """Five-number summary and whiskers of the premium rate per band.

    A whisker ends at the most extreme rate inside the fences. A rate follows
    from a percentage of two decimals and a multiplier, so the rates repeat.
    """
    banded = df.where(F.col("risk_band").isin(*RISK_BANDS))
    counts = value_rows(banded, ["risk_band"], "premium_rate_pct", repeated=True)
    quartiles = quantiles_of_rows(counts, ["risk_band"], QUARTILES, fixed_keys=True)
    value, spread = F.col("_value"), (F.col("q75") - F.col("q25")) * multiplier
    names = list(QUARTILES)
    boxes = counts.join(F.broadcast(quartiles), "risk_band").groupBy("risk_band", *names).agg(
        F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min(F.when(value >= F.col("q25") - spread, value)).alias("lower_whisker"),
        F.max(F.when(value <= F.col("q75") + spread, value)).alias("upper_whisker"),
    )
    columns = ["min", "lower_whisker", *names, "upper_whisker", "max"]
    return boxes.select("risk_band", "n", *[rounded(c, digits).alias(c) for c in columns]).orderBy(
        band_rank(F.col("risk_band"))
    )


def median_probability(df: DataFrame, column: str = "attack_probability_pct", digits: int = 6) -> DataFrame:
    """Median percentage, NULL without one. Percentages repeat, so they are counted first."""
    one = df.select(F.lit(0).alias("all"), column)
    found = exact_quantiles(one, ["all"], column, {"median": 0.5}, fixed_keys=True, repeated=True)
    return found.agg(rounded(F.max("median"), digits).alias("median_pct"))
