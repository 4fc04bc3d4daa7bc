"""Voyage premiums: per incident, per quote request, per scenario."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark import constants as K
from keelmark.functions.features import region_multiplier
from keelmark.functions.risk import clip_pct, risk_band, voyage_premium
from keelmark.functions.rounding import rounded, rounded_exactly
from keelmark.functions.statistics import exact_mean, weighted_sum
from keelmark.operators.reshape import rows_per_column
from keelmark.schema import require_columns

STATISTICS_COLUMNS = ["total_premium_usd", "premium_rate_pct", "expected_loss_usd", "risk_premium_usd"]


def add_region_multiplier(df: DataFrame, region_col: str = "region") -> DataFrame:
    return df.withColumn("lambda_region", rounded(region_multiplier(F.col(region_col)), 4))


def append_premiums(
    df: DataFrame,
    insured_value: float = K.DEFAULT_INSURED_VALUE,
    lgd: float = K.DEFAULT_LGD,
    theta: float = K.DEFAULT_THETA,
    base_rate: float = K.DEFAULT_BASE_RATE,
    prob_col: str = "attack_probability_pct",
    region_col: str = "region",
) -> DataFrame:
    """Add the six premium columns; percentages outside 0..100 are clipped.

    Amounts are rounded only at the end, ties to even. A missing probability
    has no premium, only its multiplier and base premium.
    """
    multiplier = region_multiplier(F.col(region_col))
    amounts = voyage_premium(
        clip_pct(F.col(prob_col)) / 100.0, multiplier,
        *[F.lit(float(x)) for x in (insured_value, lgd, theta, base_rate)],
    )
    return df.withColumns({
        "lambda_region": rounded(multiplier, 4),
        "expected_loss_usd": rounded(amounts.expected_loss, 2),
        "risk_premium_usd": rounded(amounts.risk_premium, 2),
        "base_premium_usd": rounded_exactly(amounts.base_premium, 2),
        "total_premium_usd": rounded(amounts.total_premium, 2),
        "premium_rate_pct": rounded(amounts.rate_pct, 6),
    })


def ensure_premiums(df: DataFrame) -> DataFrame:
    return df if "total_premium_usd" in df.columns else append_premiums(df)


def band_of_probability(df: DataFrame, prob_col: str, output: str = "risk_band") -> DataFrame:
    """Band of a raw probability 0..1, without rounding it first."""
    return df.withColumn(output, risk_band(F.col(prob_col) * 100))


def _violation(p: Column, value: Column, lgd: Column, theta: Column, rate: Column) -> Column:
    """Text of the first rule that a request breaks, NULL if it breaks none."""
    rules = [
        ((p >= 0) & (p <= 1), "p_attack must lie in [0, 1]"),
        (value > 0, "insured_value must be above 0"),
        ((lgd > 0) & (lgd <= 1), "lgd must lie in (0, 1]"),
        (theta >= 0, "theta must be 0 or more"),
        (rate >= 0, "base_rate must be 0 or more"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), text) for rule, text in rules])


def quote_premiums(requests: DataFrame, mode: str = "fail") -> DataFrame:
    """Price a table of requests, each with parameters of its own.

    A NULL parameter takes its default. ``mode='fail'`` stops the job at an
    invalid request; ``'quarantine'`` keeps it, with its reason in ``error``
    and no amounts.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode: {mode}")
    filled = requests.withColumns({
        "insured_value": F.coalesce("insured_value", F.lit(K.DEFAULT_INSURED_VALUE)),
        "lgd": F.coalesce("lgd", F.lit(K.DEFAULT_LGD)),
        "theta": F.coalesce("theta", F.lit(K.DEFAULT_THETA)),
        "base_rate": F.coalesce("base_rate", F.lit(K.DEFAULT_BASE_RATE)),
    })
    p, value, lgd, theta, rate = [
        F.col(c) for c in ("p_attack", "insured_value", "lgd", "theta", "base_rate")
    ]
    checked = filled.withColumn("error", _violation(p, value, lgd, theta, rate))
    valid = F.col("error").isNull()
    if mode == "fail":
        # The guard sits on a value that every amount needs, so it is never pruned.
        guarded = F.when(valid, p).otherwise(F.raise_error(F.concat(F.lit("invalid request: "), F.col("error"))))
        checked = checked.withColumn("p_attack", guarded)
    amounts = voyage_premium(p, region_multiplier(F.col("region")), value, lgd, theta, rate)
    # Amounts first, rounding second: each amount is computed once.
    computed = checked.withColumns({
        f"_{name}": F.when(valid, amount) for name, amount in (
            ("lambda", region_multiplier(F.col("region"))), ("loss", amounts.expected_loss),
            ("risk", amounts.risk_premium), ("base", amounts.base_premium),
            ("total", amounts.total_premium), ("rate", amounts.rate_pct),
        )
    })
    priced = computed.select(
        "request_id",
        rounded_exactly(p, 6).alias("p_attack"),
        rounded_exactly(value, 2).alias("insured_value_usd"),
        "region",
        rounded_exactly(lgd, 4).alias("lgd"),
        rounded_exactly(theta, 4).alias("theta"),
        rounded_exactly("_lambda", 4).alias("lambda_region"),
        rounded_exactly("_loss", 2).alias("expected_loss_usd"),
        rounded_exactly("_risk", 2).alias("risk_premium_usd"),
        rounded_exactly("_base", 2).alias("base_premium_usd"),
        rounded_exactly("_total", 2).alias("total_premium_usd"),
        rounded_exactly("_rate", 6).alias("premium_rate_pct"),
        F.when(valid, risk_band(p * 100)).alias("risk_band"),
        "error",
    )
    return priced.drop("error") if mode == "fail" else priced


def premium_statistics(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of the four premium measures.

    Amounts are given in cents and the rate with six digits.
    """
    require_columns(df, STATISTICS_COLUMNS)

    def digits(c: str) -> int:
        return 2 if c.endswith("_usd") else 6

    rows = rows_per_column(df, STATISTICS_COLUMNS, {
        "mean": lambda c: rounded(exact_mean(F.col(c), digits(c)), digits(c)),
        "std": lambda c: rounded(F.stddev_samp(c), digits(c)),
        "min": F.min, "max": F.max,
    })
    return rows.drop("position")


def premium_by_band(df: DataFrame) -> DataFrame:
    """Mean premium and rows of every band, in band order; absent bands are 0."""
    def in_band(name: str) -> Column:
        return F.when(F.col("risk_band") == name, F.col("total_premium_usd"))

    row = df.agg(F.array(*[
        F.struct(
            F.lit(rank).alias("band_rank"), F.lit(name).alias("risk_band"),
            rounded(F.coalesce(exact_mean(in_band(name)), F.lit(0.0)), 2).alias("avg_premium_usd"),
            F.count(in_band(name)).alias("n"),
        )
        for rank, name in enumerate(K.RISK_BANDS)
    ]).alias("rows"))
    return row.select(F.inline("rows")).orderBy("band_rank")


@dataclass(frozen=True)
class Scenario:
    """One setting of the pricing parameters; None keeps what the data says."""

    name: str
    probability_pct: float | None = None
    region: str | None = None
    insured_value: float = K.DEFAULT_INSURED_VALUE
    lgd: float = K.DEFAULT_LGD
    theta: float = K.DEFAULT_THETA
    base_rate: float = K.DEFAULT_BASE_RATE

    def as_struct(self) -> Column:
        types = {"name": "string", "region": "string"}
        return F.struct(*[
            F.lit(v).cast(types.get(k, "double")).alias(k) for k, v in asdict(self).items()
        ])


def price_scenarios(
    df: DataFrame, scenarios: list[Scenario], prob_col: str = "attack_probability_pct",
) -> DataFrame:
    """Portfolio totals of every scenario over all incidents.

    The portfolio is first reduced to counts per region and percentage, and only
    these are priced once per scenario, so the data is read and shuffled once
    however many scenarios there are.
    """
    groups = df.groupBy("region", F.col(prob_col).alias("_pct")).agg(F.count(F.lit(1)).alias("_n"))
    grid = groups.select(
        F.col("region").alias("_region"), "_pct", "_n",
        F.inline(F.array(*[s.as_struct() for s in scenarios])),
    )
    pct = F.coalesce("probability_pct", "_pct")
    amounts = voyage_premium(
        clip_pct(pct) / 100.0, region_multiplier(F.coalesce("region", "_region")),
        F.col("insured_value"), F.col("lgd"), F.col("theta"), F.col("base_rate"),
    )
    priced = grid.select(
        "name", "_n",
        rounded(amounts.total_premium, 2).alias("_total"),
        rounded(amounts.expected_loss, 2).alias("_loss"),
        rounded(amounts.rate_pct, 6).alias("_rate"),
    )
    n = F.when(F.col("_total").isNotNull(), F.col("_n")).otherwise(0)
    total = weighted_sum(F.col("_total"), F.col("_n")).cast("double")
    return priced.groupBy(F.col("name").alias("scenario")).agg(
        F.sum(n).alias("n_voyages"),
        total.alias("total_premium_usd"),
        weighted_sum(F.col("_loss"), F.col("_n")).cast("double").alias("expected_loss_usd"),
        rounded(F.try_divide(total, F.sum(n)), 2).alias("avg_premium_usd"),
        F.max("_rate").alias("max_rate_pct"),
    )
