"""Independent SQL for the checked queries, written for DuckDB."""

from __future__ import annotations

RAW = """
raw_incidents AS (
SELECT o.o_orderkey AS incident_id,
  CASE WHEN o.o_orderkey % 997 = 5 THEN 'n/a' WHEN o.o_orderkey % 991 = 7 THEN '1850'
       ELSE CAST(year(o.o_orderdate) AS STRING) END AS year,
  CASE WHEN o.o_orderkey % 983 = 3 THEN '13' ELSE CAST(month(o.o_orderdate) AS STRING) END AS month,
  concat(CAST((o.o_orderkey * 7919) % 360 - 180 AS STRING), '.', lpad(CAST((o.o_orderkey * 104729) % 100 AS STRING), 2, '0')) AS longitude,
  CASE WHEN o.o_orderkey % 503 = 2 THEN CAST(NULL AS STRING)
       ELSE concat(CAST((o.o_orderkey * 31) % 181 - 90 AS STRING), '.', lpad(CAST((o.o_orderkey * 1299709) % 100 AS STRING), 2, '0')) END AS latitude,
  CASE WHEN o.o_orderkey % 211 = 1 THEN CAST(NULL AS STRING) WHEN o.o_orderkey % 199 = 1 THEN 'Unlisted'
       WHEN b < 1 THEN 'Suspicious' WHEN b < 4 THEN 'Attempted' WHEN b < 5 THEN ' Boarding '
       WHEN b < 18 THEN 'Boarded' WHEN b < 20 THEN 'Hijacked' WHEN b < 22 THEN 'Fired Upon'
       WHEN b < 24 THEN 'Detained' ELSE 'Explosion' END AS attack_type,
  CASE (o.o_orderkey * 17 + o.o_custkey) % 12
       WHEN 0 THEN 'Berthed' WHEN 1 THEN 'Moored' WHEN 2 THEN 'Anchored' WHEN 3 THEN 'Stationary'
       WHEN 4 THEN 'Grounded' WHEN 5 THEN 'Drifting' WHEN 6 THEN 'Towed' WHEN 7 THEN 'Fishing'
       WHEN 8 THEN 'Steaming' WHEN 9 THEN 'Underway' WHEN 10 THEN '   ' ELSE 'None' END AS vessel_status,
  CASE WHEN o.o_orderkey % 787 = 9 THEN '-1.00'
       ELSE concat(CAST(x * x AS STRING), '.', lpad(CAST((o.o_orderkey * 15485863) % 100 AS STRING), 2, '0')) END AS shore_distance,
  n_name AS nearest_country,
  CASE r_name WHEN 'AFRICA' THEN 'Sub-Saharan Africa' WHEN 'AMERICA' THEN 'South America'
       WHEN 'ASIA' THEN 'South Asia' WHEN 'EUROPE' THEN 'Europe & Central Asia' ELSE 'Unmapped Waters' END AS region
FROM (SELECT q.*, (o_orderkey * 37 + o_custkey) % 20 + CASE WHEN x < 20 THEN 5 ELSE 0 END AS b
      FROM (SELECT *, CAST(floor(o_totalprice / 10000) AS BIGINT) AS x FROM orders) q) o
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
)"""


def _known(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR trim({column}) IN ('', 'nan', 'None') "
        f"THEN 'Unknown' ELSE trim({column}) END AS {column}"
    )


INCIDENTS = f"""
incidents AS (
SELECT * FROM (
 SELECT incident_id,
  TRY_CAST(year AS INT) AS year, TRY_CAST(month AS INT) AS month,
  TRY_CAST(longitude AS DOUBLE) AS longitude, TRY_CAST(latitude AS DOUBLE) AS latitude,
  {_known('attack_type')}, {_known('vessel_status')},
  TRY_CAST(shore_distance AS DOUBLE) AS shore_distance,
  {_known('nearest_country')}, {_known('region')}
 FROM raw_incidents) t
WHERE year BETWEEN 1900 AND 2100 AND month BETWEEN 1 AND 12
  AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND shore_distance >= 0
)"""

SCORED = """
scored AS (
SELECT i.* EXCLUDE (p),
  CASE WHEN attack_type IN ('Boarded', 'Hijacked', 'Fired Upon', 'Explosion', 'Detained') THEN 1 ELSE 0 END AS attack_occurred,
  p AS attack_probability_pct,
  CASE WHEN p < 25 THEN 'Low' WHEN p < 50 THEN 'Moderate' WHEN p < 75 THEN 'High' ELSE 'Critical' END AS risk_band
FROM (SELECT incidents.*, CAST((incident_id * 7907) % 10001 AS DOUBLE) / 100e0 AS p FROM incidents) i
)"""

REQUESTS = """
requests AS (
SELECT incident_id AS request_id,
  CASE WHEN incident_id % 97 = 11 THEN 1.25e0 WHEN incident_id % 89 = 7 THEN CAST(-1 AS DOUBLE) / 10e0
       ELSE CAST((incident_id * 7907) % 10001 AS DOUBLE) / 10000e0 END AS p_attack,
  region,
  CASE WHEN incident_id % 83 = 5 THEN 0e0
       WHEN incident_id % 4 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(1 + incident_id % 500 AS DOUBLE) * 500000e0 END AS insured_value,
  CASE WHEN incident_id % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(5 + incident_id % 76 AS DOUBLE) / 100e0 END AS lgd,
  CASE WHEN incident_id % 3 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(incident_id % 61 AS DOUBLE) / 100e0 END AS theta,
  CASE WHEN incident_id % 3 = 2 THEN CAST(NULL AS DOUBLE) ELSE CAST(1 + incident_id % 50 AS DOUBLE) / 10000e0 END AS base_rate
FROM incidents
)"""

MULTIPLIERS = """
multipliers(name, factor) AS (VALUES
  ('Gulf of Aden', 2.5e0), ('Indian Ocean', 2.0e0), ('Middle East & North Africa', 1.9e0),
  ('West Africa', 2.0e0), ('South Asia', 1.6e0), ('Malacca Strait', 1.8e0),
  ('East Asia & Pacific', 1.4e0), ('South America', 1.3e0), ('Central America & Caribbean', 1.2e0),
  ('Sub-Saharan Africa', 1.7e0), ('Europe & Central Asia', 1.05e0), ('North America', 1.0e0))"""

PRICED = MULTIPLIERS + """,
priced AS (
SELECT s.*,
  rint(f, 4) AS lambda_region,
  rint(el, 2) AS expected_loss_usd,
  rint(el * (1e0 + 0.2e0), 2) AS risk_premium_usd,
  pyround(25000000e0 * 0.0005e0, 2) AS base_premium_usd,
  rint(el * (1e0 + 0.2e0) + 25000000e0 * 0.0005e0, 2) AS total_premium_usd,
  rint((el * (1e0 + 0.2e0) + 25000000e0 * 0.0005e0) / 25000000e0 * 100e0, 6) AS premium_rate_pct
FROM (
  SELECT scored.*, coalesce(factor, 1e0) AS f,
    least(greatest(attack_probability_pct, 0e0), 100e0) / 100e0 * 25000000e0 * 0.35e0 * coalesce(factor, 1e0) AS el
  FROM scored LEFT JOIN multipliers ON region = name) s
)"""

SEVERITY = """CAST(CASE attack_type WHEN 'Suspicious' THEN 1 WHEN 'Attempted' THEN 2 WHEN 'Boarding' THEN 3
  WHEN 'Boarded' THEN 4 WHEN 'Fired Upon' THEN 5 WHEN 'Detained' THEN 5 WHEN 'Hijacked' THEN 6
  WHEN 'Explosion' THEN 7 ELSE 3 END AS INT)"""
VULNERABILITY = """CAST(CASE WHEN vessel_status IN ('Berthed', 'Moored') THEN 1
  WHEN vessel_status IN ('Anchored', 'Stationary') THEN 2 WHEN vessel_status IN ('Grounded', 'Drifting') THEN 3
  WHEN vessel_status IN ('Towed', 'Fishing') THEN 4 WHEN vessel_status IN ('Steaming', 'Underway') THEN 5
  ELSE 3 END AS INT)"""
DISTANCE = """(6371e0 * 2e0 * asin(sqrt(least(1e0, power(sin(radians(12e0 - latitude) / 2e0), 2)
  + cos(radians(latitude)) * cos(radians(12e0)) * power(sin(radians(47e0 - longitude) / 2e0), 2)))))"""
COUNTRY = """CASE WHEN nearest_country IN (
  SELECT nearest_country FROM incidents GROUP BY nearest_country
  ORDER BY count(*) DESC, nearest_country LIMIT 15) THEN nearest_country ELSE 'Other' END"""

FEATURES = f"""
features AS (
SELECT scored.*, ln(1e0 + shore_distance) AS log_shore_distance,
  sin(2e0 * pi() * (month - 1) / 12e0) AS month_sin, cos(2e0 * pi() * (month - 1) / 12e0) AS month_cos,
  {DISTANCE} AS dist_gulf_aden_km, abs(latitude) AS abs_latitude,
  longitude * latitude AS lon_lat_interaction, {SEVERITY} AS attack_severity,
  {VULNERABILITY} AS vessel_vulnerability, {COUNTRY} AS country_grouped,
  year - (SELECT min(year) FROM incidents) AS year_trend
FROM scored
)"""

FOLDED = """
folded AS (
SELECT *, CAST((row_number() OVER (PARTITION BY attack_occurred
  ORDER BY md5(concat('42:', incident_id)), incident_id) - 1) % 10 AS INT) AS fold
FROM {table}
)"""

FOLD_TABLE = FOLDED.format(table="scored") + """,
hits AS (
SELECT m.fold AS model_fold, f.fold, attack_occurred,
  least(attack_probability_pct + m.fold, 100e0) / 100e0 AS p
FROM folded f CROSS JOIN (SELECT DISTINCT fold FROM folded) m
),
fold_table AS (
SELECT model_fold AS fold,
  avg(CAST((p > 0.5) = (attack_occurred = 1) AS INT)) FILTER (fold <> model_fold) AS acc_train,
  avg(CAST((p > 0.5) = (attack_occurred = 1) AS INT)) FILTER (fold = model_fold) AS acc_test,
  avg(power(p - attack_occurred, 2)) FILTER (fold = model_fold) AS brier_test
FROM hits GROUP BY model_fold
)"""

RAW_COLUMNS = [
    "incident_id", "year", "month", "longitude", "latitude", "attack_type", "vessel_status",
    "shore_distance", "nearest_country", "region",
]
NUMBERS = ["year", "month", "longitude", "latitude", "shore_distance"]
TEXTS = ["attack_type", "vessel_status", "nearest_country", "region"]
RECORD = (
    "year, month, region, nearest_country, attack_type, vessel_status, shore_distance, "
    "attack_occurred, attack_probability_pct, risk_band"
)
PREMIUM = (
    "lambda_region, expected_loss_usd, risk_premium_usd, base_premium_usd, total_premium_usd, premium_rate_pct"
)
PREMIUM_TABLE = (
    "year, month, region, nearest_country, attack_type, attack_probability_pct, risk_band, " + PREMIUM
)
ENRICHED = (
    "incident_id, year, month, longitude, latitude, attack_type, vessel_status, shore_distance, "
    "nearest_country, region, attack_occurred, attack_probability_pct, risk_band, " + PREMIUM
)
CHOSEN = (
    "region IN ('South Asia', 'Sub-Saharan Africa', 'South America') AND year BETWEEN 1996 AND 1999 "
    "AND risk_band IN ('Moderate', 'High', 'Critical') AND attack_probability_pct >= 30"
)
BANDS = "(VALUES (0, 'Low'), (1, 'Moderate'), (2, 'High'), (3, 'Critical')) bands(band_rank, risk_band)"
MODEL_DOUBLES = ["longitude", "latitude", "month_sin", "month_cos", "dist_gulf_aden_km", "abs_latitude", "lon_lat_interaction"]
MODEL_INTS = ["year", "attack_severity", "vessel_vulnerability", "year_trend"]
NA_TEXTS = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)


ROUNDING = {
    # scale, round the integer part with ties to even, scale back
    "rint": "(CAST(format('{{:.0f}}', ({x}) * 1e{n}) AS DOUBLE) / 1e{n})",
    # correct rounding of the binary value
    "pyround": "CAST(format('{{:.{n}f}}', {x}) AS DOUBLE)",
}


def _rounding(sql: str) -> str:
    """Spell out rint(x, n) and pyround(x, n), which DuckDB does not have."""
    for name, form in ROUNDING.items():
        while (start := sql.rfind(f"{name}(")) >= 0:
            depth, end = 1, start + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            x, n = sql[start + len(name) + 1:end - 1].rsplit(",", 1)
            sql = sql[:start] + form.format(x=x, n=n.strip()) + sql[end:]
    return sql


def _with(select: str, *ctes: str) -> str:
    return _rounding("WITH " + ",".join([RAW, *ctes]) + "\n" + select)


def raw(select: str) -> str:
    return _with(select)


def cleaned(select: str) -> str:
    return _with(select, INCIDENTS)


def scored(select: str) -> str:
    return _with(select, INCIDENTS, SCORED)


def priced(select: str) -> str:
    return _with(select, INCIDENTS, SCORED, PRICED)


def featured(select: str, *ctes: str) -> str:
    return _with(select, INCIDENTS, SCORED, FEATURES, *ctes)


def folds(select: str) -> str:
    return _with(select, INCIDENTS, SCORED, FOLD_TABLE)


def _r6(*columns: str) -> str:
    return ", ".join(f"rint({c}, 6) + 0e0 AS {c}" for c in columns)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _typed() -> str:
    texts = ", ".join(f"trim({c}) AS {c}" for c in TEXTS)
    label = "CASE WHEN trim(attack_type) IN ('Boarded', 'Hijacked', 'Fired Upon', 'Explosion', 'Detained') THEN 1 ELSE 0 END"
    return f"""
typed AS (
SELECT incident_id, {', '.join(f'TRY_CAST({c} AS DOUBLE) AS {c}' for c in NUMBERS)}, {texts},
  {label} AS attack_occurred FROM raw_incidents
)"""


def _profile() -> str:
    return _union([
        f"SELECT {i} AS position, '{c}' AS \"column\", '{'bigint' if c == 'incident_id' else 'string'}' AS dtype, "
        f"count(*) AS n_rows, count(*) - count({c}) AS n_missing, (count(*) - count({c})) * 100e0 / count(*) AS pct_missing "
        "FROM raw_incidents"
        for i, c in enumerate(RAW_COLUMNS)
    ])


def _categories() -> str:
    long = _union([f"SELECT '{c}' AS col, {c} AS value FROM incidents" for c in TEXTS])
    return f"""
SELECT col AS "column", rank, value, n, n_distinct, greatest(n_distinct - 8, 0) AS n_more FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS INT) AS rank,
    count(*) OVER (PARTITION BY col) AS n_distinct
  FROM (SELECT col, value, count(*) AS n FROM ({long}) l GROUP BY col, value) g) r
WHERE rank <= 8"""


def _summary() -> str:
    return _union([
        f"""SELECT '{c}' AS "column", count({c}) AS count, rint(avg({c}), 6) AS mean,
rint(stddev_samp({c}), 6) AS std, rint(CAST(min({c}) AS DOUBLE), 6) AS min,
rint(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, rint(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
rint(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, rint(CAST(max({c}) AS DOUBLE), 6) AS max,
rint(skewness({c}), 6) AS skew FROM incidents"""
        for c in NUMBERS
    ])


def _outliers() -> str:
    return _union([
        f"""SELECT '{c}' AS "column", rint(q1, 6) AS q1, rint(q3, 6) AS q3, rint(q3 - q1, 6) AS iqr,
rint(q1 - 1.5e0 * (q3 - q1), 6) AS lower_fence, rint(q3 + 1.5e0 * (q3 - q1), 6) AS upper_fence,
count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS n_outliers,
rint(count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) * 100e0 / count(*), 2) AS pct_outliers
FROM incidents, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM incidents) q
GROUP BY q1, q3"""
        for c in ("longitude", "latitude", "shore_distance")
    ])


def _correlation(digits: int) -> str:
    return _union([
        f"""SELECT '{c}' AS "column", rint(corr({c}, shore_distance), {digits}) AS correlation FROM incidents"""
        for c in NUMBERS if c != "shore_distance"
    ])


def _explored() -> str:
    """The three profiles as one long table."""
    parts = [
        f"SELECT 'categories' AS profile, \"column\", value AS item, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({_categories()}) c"
        for m in ("rank", "n", "n_distinct", "n_more")
    ] + [
        f"SELECT 'numbers', \"column\", '', '{m}', rint(CAST({m} AS DOUBLE), 4) FROM ({_summary()}) s"
        for m in ("count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew")
    ]
    return _union([*parts, f"SELECT 'correlation', \"column\", '', 'correlation', correlation FROM ({_correlation(4)}) r"])


def _fold_checks() -> str:
    return """SELECT fold, (SELECT count(*) FROM folded) - count(*) AS train_rows, count(*) AS test_rows,
TRUE AS acc_train_is_share, TRUE AS acc_test_is_share, TRUE AS better_than_base_rate FROM folded GROUP BY fold"""


def _feature_names() -> str:
    numeric = _union([
        f"SELECT 'num__{c}' AS feature" for c in
        [*MODEL_DOUBLES, *MODEL_INTS]
    ])
    encoded = _union([
        f"SELECT DISTINCT 'cat__{c}_' || {c} AS feature FROM features WHERE {c} <> (SELECT min({c}) FROM features)"
        for c in ("region", "country_grouped")
    ])
    return f"SELECT feature, TRUE AS is_share, 1e0 AS total, TRUE AS follows_splits FROM ({_union([numeric, encoded])}) names"


def _report() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in NUMBERS)
    plausible = (
        "year BETWEEN 1900 AND 2100 AND month BETWEEN 1 AND 12 AND longitude BETWEEN -180 AND 180 "
        "AND latitude BETWEEN -90 AND 90 AND shore_distance >= 0"
    )
    filled = ", ".join(
        f"count(*) FILTER ({complete} AND ({c} IS NULL OR {c} IN ('', 'nan', 'None'))) AS filled_{c}" for c in TEXTS
    )
    return f"""SELECT count(*) AS rows_in, count(*) FILTER (NOT ({complete})) AS dropped_null, {filled},
count(*) FILTER ({complete} AND NOT ({plausible})) AS dropped_domain,
count(*) FILTER ({complete} AND {plausible}) AS rows_out FROM typed"""


def _engineered() -> str:
    return f"""SELECT incident_id, year, {_r6('longitude', 'latitude')}, region,
{_r6('log_shore_distance', 'month_sin', 'month_cos', 'dist_gulf_aden_km', 'abs_latitude', 'lon_lat_interaction')},
attack_severity, vessel_vulnerability, country_grouped, year_trend"""


def _imputed() -> str:
    fills = ", ".join(
        f"rint(coalesce({c}, (SELECT median({c}) FROM folded WHERE fold <> 0)), 6) + 0e0 AS {c}" for c in NUMBERS
    )
    return f"SELECT incident_id, fold, {fills} FROM folded"


def _scaled(columns: list[str], source: str = "folded") -> str:
    return ", ".join(
        f"rint(({c} - (SELECT avg({c}) FROM {source} WHERE fold <> 0)) / "
        f"(SELECT stddev_pop({c}) FROM {source} WHERE fold <> 0), 6) + 0e0 AS {c}"
        for c in columns
    )


def _hot(column: str) -> str:
    return f"""SELECT incident_id, 'cat__{column}_' || {column} AS feature, 1e0 AS value FROM folded
WHERE {column} IN (SELECT {column} FROM folded WHERE fold <> 0)
AND {column} <> (SELECT min({column}) FROM folded WHERE fold <> 0)"""


def _vectors() -> str:
    columns = [c for c in ["year", *MODEL_DOUBLES, "vessel_vulnerability", "year_trend"]] + ["log_shore_distance"]
    numeric = _union([f"SELECT incident_id, 'num__{c}' AS feature, {c} AS value FROM scaled" for c in columns])
    return f"""SELECT * FROM (
{_union([numeric, _hot('region'), _hot('country_grouped')])}
) WHERE value <> 0"""


def _vector_ctes() -> tuple[str, str]:
    columns = ["year", *MODEL_DOUBLES, "vessel_vulnerability", "year_trend", "log_shore_distance"]
    return FOLDED.format(table="features"), f"\nscaled AS (SELECT incident_id, {_scaled(columns)} FROM folded)"


def _quotes() -> str:
    rules = [
        ("p >= 0 AND p <= 1", "p_attack must lie in [0, 1]"),
        ("v > 0", "insured_value must be above 0"),
        ("g > 0 AND g <= 1", "lgd must lie in (0, 1]"),
        ("t >= 0", "theta must be 0 or more"),
        ("r >= 0", "base_rate must be 0 or more"),
    ]
    error = "CASE " + " ".join(f"WHEN NOT coalesce({rule}, FALSE) THEN '{text}'" for rule, text in rules) + " END"
    return f"""SELECT request_id, pyround(p, 6) AS p_attack, pyround(v, 2) AS insured_value_usd, region,
pyround(g, 4) AS lgd, pyround(t, 4) AS theta,
CASE WHEN error IS NULL THEN pyround(f, 4) END AS lambda_region,
CASE WHEN error IS NULL THEN pyround(p * v * g * f, 2) END AS expected_loss_usd,
CASE WHEN error IS NULL THEN pyround(p * v * g * f * (1e0 + t), 2) END AS risk_premium_usd,
CASE WHEN error IS NULL THEN pyround(v * r, 2) END AS base_premium_usd,
CASE WHEN error IS NULL THEN pyround(p * v * g * f * (1e0 + t) + v * r, 2) END AS total_premium_usd,
CASE WHEN error IS NULL THEN pyround((p * v * g * f * (1e0 + t) + v * r) / v * 100e0, 6) END AS premium_rate_pct,
CASE WHEN error IS NOT NULL THEN NULL WHEN p * 100e0 < 25 THEN 'Low' WHEN p * 100e0 < 50 THEN 'Moderate'
  WHEN p * 100e0 < 75 THEN 'High' ELSE 'Critical' END AS risk_band, error
FROM (SELECT *, {error} AS error FROM (
  SELECT request_id, p_attack AS p, region, coalesce(insured_value, 25000000e0) AS v, coalesce(lgd, 0.35e0) AS g,
    coalesce(theta, 0.2e0) AS t, coalesce(base_rate, 0.0005e0) AS r, coalesce(factor, 1e0) AS f
  FROM requests LEFT JOIN multipliers ON region = name) q) e"""


def _statistics() -> str:
    parts = []
    for c in ("total_premium_usd", "premium_rate_pct", "expected_loss_usd", "risk_premium_usd"):
        d = 2 if c.endswith("_usd") else 6
        parts.append(
            f"SELECT '{c}' AS \"column\", rint(CAST(sum(CAST({c} AS DECIMAL(24, {d}))) AS DOUBLE) / count({c}), {d}) AS mean, "
            f"rint(stddev_samp({c}), {d}) AS std, min({c}) AS min, max({c}) AS max FROM priced"
        )
    return _union(parts)


SCENARIO_VALUES = """(VALUES
  ('defaults', NULL, NULL, 25000000e0, 0.35e0, 0.2e0, 0.0005e0),
  ('large hull', NULL, NULL, 120000000e0, 0.35e0, 0.2e0, 0.0005e0),
  ('high loss', NULL, NULL, 25000000e0, 0.6e0, 0.35e0, 0.0005e0),
  ('gulf transit', NULL, 'Gulf of Aden', 25000000e0, 0.35e0, 0.2e0, 0.002e0),
  ('even odds', 50e0, 'South Asia', 25000000e0, 0.35e0, 0.2e0, 0.0005e0)
) scenarios(scenario, pct, place, v, g, t, r)"""

SCENARIO_ROWS = f"""SELECT scenario, count(*) AS n_voyages,
CAST(sum(CAST(total AS DECIMAL(24, 2))) AS DOUBLE) AS total_premium_usd,
CAST(sum(CAST(loss AS DECIMAL(24, 2))) AS DOUBLE) AS expected_loss_usd,
rint(CAST(sum(CAST(total AS DECIMAL(24, 2))) AS DOUBLE) / count(*), 2) AS avg_premium_usd,
max(rate) AS max_rate_pct
FROM (SELECT scenario, rint(el, 2) AS loss, rint(el * (1e0 + t) + v * r, 2) AS total,
        rint((el * (1e0 + t) + v * r) / v * 100e0, 6) AS rate
      FROM (SELECT *, coalesce(pct, attack_probability_pct) / 100e0 * v * g * coalesce(factor, 1e0) AS el
            FROM scored CROSS JOIN {SCENARIO_VALUES} LEFT JOIN multipliers ON coalesce(place, region) = name) a) b
GROUP BY scenario"""

DECIMAL_MEAN = "rint(CAST(sum(CAST(total_premium_usd AS DECIMAL(24, 2))) AS DOUBLE) / count(*), 2)"
BIN = "CAST(least(floor({x}), {last}) AS INT)"


def _fold_summary() -> str:
    return _union([
        f"SELECT '{c}' AS metric, rint(avg({c}), 6) AS mean, rint(stddev_pop({c}), 6) AS std, "
        f"rint(min({c}), 6) AS min, rint(max({c}), 6) AS max FROM fold_table"
        for c in ("acc_train", "acc_test", "brier_test")
    ])


def _boxes() -> str:
    lower, upper = "q25 - 1.5e0 * (q75 - q25)", "q75 + 1.5e0 * (q75 - q25)"
    columns = ["min", "lower_whisker", "q25", "q50", "q75", "upper_whisker", "max"]
    return f"""SELECT risk_band, n, {', '.join(f'rint({c}, 6) AS {c}' for c in columns)} FROM (
SELECT p.risk_band, count(*) AS n, min(premium_rate_pct) AS min, max(premium_rate_pct) AS max,
  min(premium_rate_pct) FILTER (premium_rate_pct >= {lower}) AS lower_whisker,
  max(premium_rate_pct) FILTER (premium_rate_pct <= {upper}) AS upper_whisker, q25, q50, q75
FROM priced p JOIN (SELECT risk_band, quantile_cont(premium_rate_pct, 0.25) AS q25,
  quantile_cont(premium_rate_pct, 0.5) AS q50, quantile_cont(premium_rate_pct, 0.75) AS q75
  FROM priced GROUP BY risk_band) q ON p.risk_band = q.risk_band
GROUP BY p.risk_band, q25, q50, q75) b"""


MONTHS = ", ".join(f"count(*) FILTER (month = {m}) AS m{m:02d}" for m in range(1, 13))
NA_CASES = ", ".join(
    f"CASE WHEN {c} IN ({NA_TEXTS}) THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS[1:]
)
CLASS = "CASE attack_occurred WHEN 0 THEN 'Incomplete' ELSE 'Completed' END AS class"
MAP_COLUMNS = "incident_id, latitude, longitude, region, year, attack_type, vessel_status, shore_distance"

ORACLE_SQL: dict[str, str] = {
    "s1_load_csv": raw(f"SELECT incident_id, {NA_CASES} FROM raw_incidents"),
    "s2_write_enriched": priced(f"SELECT {ENRICHED} FROM priced"),
    "s2_write_enriched_csv": priced(f"SELECT {ENRICHED} FROM priced"),
    "s3_export_filtered": scored(f"SELECT * FROM scored WHERE {CHOSEN}"),
    "s4_export_results": scored(f"SELECT {RECORD} FROM scored"),
    "s4_export_filtered_results": scored(f"SELECT {RECORD} FROM scored WHERE {CHOSEN}"),
    "s5_export_premiums": priced(f"SELECT {PREMIUM_TABLE} FROM priced"),

    "p1_table_profile": raw(_profile()),
    "p2_categorical_summary": cleaned(_categories()),
    "p3_numeric_summary": cleaned(_summary()),
    "p4_outliers_iqr": cleaned(_outliers()),
    "p5_correlation": cleaned(_correlation(6)),
    "p6_explore": cleaned(_explored()),

    "c1_coerce_integers": raw(
        "SELECT incident_id, TRY_CAST(year AS INT) AS year, TRY_CAST(month AS INT) AS month FROM raw_incidents"
    ),
    "c2_coerce_floats": raw(
        "SELECT incident_id, TRY_CAST(longitude AS DOUBLE) AS longitude, TRY_CAST(latitude AS DOUBLE) AS latitude, "
        "TRY_CAST(shore_distance AS DOUBLE) AS shore_distance FROM raw_incidents"
    ),
    "c3_strip_text": raw(
        f"SELECT incident_id, {', '.join(f'trim({c}) AS {c}' for c in TEXTS)} FROM raw_incidents"
    ),
    "c4_drop_critical_nulls": _with(
        "SELECT incident_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, longitude, latitude, shore_distance "
        f"FROM typed WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMBERS)}", _typed()
    ),
    "c5_fill_unknown": raw(f"SELECT incident_id, {', '.join(_known(c) for c in TEXTS)} FROM raw_incidents"),
    "c6_domain_filter": _with(
        "SELECT incident_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, longitude, latitude, shore_distance "
        "FROM typed WHERE year BETWEEN 1900 AND 2100 AND month BETWEEN 1 AND 12 AND longitude BETWEEN -180 AND 180 "
        "AND latitude BETWEEN -90 AND 90 AND shore_distance >= 0", _typed()
    ),
    "c7_cleaning_report": _with(_report(), _typed()),
    "c8_clean": cleaned("SELECT * FROM incidents"),

    "f1_log_shore_distance": cleaned("SELECT incident_id, rint(ln(1e0 + shore_distance), 6) AS log_shore_distance FROM incidents"),
    "f2_season": featured(f"SELECT incident_id, {_r6('month_sin', 'month_cos')} FROM features"),
    "f3_hotspot_distance": cleaned(f"SELECT incident_id, rint({DISTANCE}, 6) AS dist_gulf_aden_km FROM incidents"),
    "f4_abs_latitude": cleaned("SELECT incident_id, abs(latitude) AS abs_latitude FROM incidents"),
    "f5_interaction": cleaned("SELECT incident_id, rint(longitude * latitude, 6) + 0e0 AS lon_lat_interaction FROM incidents"),
    "f6_attack_severity": cleaned(f"SELECT incident_id, {SEVERITY} AS attack_severity FROM incidents"),
    "f7_vessel_vulnerability": cleaned(f"SELECT incident_id, {VULNERABILITY} AS vessel_vulnerability FROM incidents"),
    "f8_group_rare_countries": cleaned(f"SELECT incident_id, nearest_country, {COUNTRY} AS country_grouped FROM incidents"),
    "f9_year_trend": cleaned("SELECT incident_id, year, year - (SELECT min(year) FROM incidents) AS year_trend FROM incidents"),
    "f10_label": scored("SELECT incident_id, attack_type, attack_occurred FROM scored"),
    "f11_class_balance": scored(
        "SELECT count(*) FILTER (attack_occurred = 1) AS n_positive, count(*) FILTER (attack_occurred = 0) AS n_negative, "
        "rint(avg(attack_occurred) * 100e0, 6) AS pct_positive FROM scored"
    ),
    "f12_drop_encoded": scored(
        "SELECT incident_id, year, longitude, latitude, region, attack_occurred, attack_probability_pct, risk_band FROM scored"
    ),
    "f13_engineer_features": featured(_engineered() + ", attack_occurred FROM features"),

    "m1_prepare_features": featured(_engineered() + " FROM features"),
    "m2_median_imputer": _with(_imputed(), _typed(), FOLDED.format(table="typed")),
    "m3_standard_scaler": featured(
        f"SELECT incident_id, fold, {_scaled(MODEL_DOUBLES + MODEL_INTS)} FROM folded", FOLDED.format(table="features")
    ),
    "m4_fill_missing_category": raw(
        f"SELECT incident_id, {', '.join(f'''coalesce({c}, 'missing') AS {c}''' for c in TEXTS)} FROM raw_incidents"
    ),
    "m5_one_hot": featured(_union([_hot("region"), _hot("country_grouped")]), FOLDED.format(table="features")),
    "m6_feature_vectors": featured(_vectors(), *_vector_ctes()),
    "m7_fit_regression": featured(
        "SELECT incident_id, rint(log_shore_distance, 6) AS log_shore_distance, TRUE AS finite, TRUE AS better_than_constant FROM features"
    ),
    "m8_fit_classification": featured(
        "SELECT incident_id, attack_occurred, TRUE AS is_probability, TRUE AS prediction_fits, TRUE AS better_than_constant FROM features"
    ),
    "m9_final_fit": featured(
        "SELECT incident_id, rint(log_shore_distance, 6) AS log_shore_distance, TRUE AS residual_fits, TRUE AS in_joint_range, TRUE AS better_than_constant FROM features"
    ),
    "m10_feature_importances": featured(_feature_names()),
    "m12_cross_validation": featured(_fold_checks(), FOLDED.format(table="features")),
    "m16_score_rows": featured(
        "SELECT incident_id, attack_occurred, TRUE AS pct_in_bounds, TRUE AS band_follows, TRUE AS better_than_constant FROM features"
    ),
    "m18_enrich": scored(
        "SELECT incident_id, year, month, longitude, latitude, attack_type, vessel_status, shore_distance, nearest_country, region, "
        "attack_occurred, TRUE AS pct_in_bounds, TRUE AS band_follows, TRUE AS premiums_follow, TRUE AS better_than_constant FROM scored"
    ),
    "m11_stratified_folds": _with(
        "SELECT incident_id, attack_occurred, fold FROM folded", INCIDENTS, SCORED, FOLDED.format(table="scored")
    ),
    "m12_fold_metrics": folds(f"SELECT fold, {_r6('acc_train', 'acc_test', 'brier_test')} FROM fold_table"),
    "m13_cv_summary": folds(_fold_summary()),
    "m14_overfit_verdict": folds(
        "SELECT rint(gap, 6) AS gap, CASE WHEN gap < 0.03 THEN 'none' WHEN gap < 0.07 THEN 'mild' "
        "ELSE 'significant' END AS overfitting FROM (SELECT avg(acc_train) - avg(acc_test) AS gap FROM fold_table) g"
    ),
    "m15_leakage_safe_features": featured(
        f"SELECT incident_id, year, {_r6(*MODEL_DOUBLES)}, vessel_vulnerability, year_trend, "
        f"{_r6('log_shore_distance')}, region, country_grouped, attack_occurred FROM features"
    ),
    "m17_risk_band": scored("SELECT incident_id, risk_band FROM scored"),
    "m19_residuals": scored(
        f"SELECT incident_id, {_r6('log_shore_distance', 'prediction')}, "
        "rint(abs(prediction - log_shore_distance), 6) AS abs_residual FROM (SELECT *, log_shore_distance * 0.9e0 "
        "+ attack_probability_pct / 100e0 AS prediction FROM (SELECT *, ln(1e0 + shore_distance) AS log_shore_distance FROM scored) l) p"
    ),
    "m19_joint_range": scored(
        "SELECT rint(least(min(log_shore_distance), min(prediction)), 6) AS low, "
        "rint(greatest(max(log_shore_distance), max(prediction)), 6) AS high FROM (SELECT *, log_shore_distance * 0.9e0 "
        "+ attack_probability_pct / 100e0 AS prediction FROM (SELECT *, ln(1e0 + shore_distance) AS log_shore_distance FROM scored) l) p"
    ),

    "a1_region_multiplier": priced("SELECT incident_id, region, lambda_region FROM priced"),
    "a2_append_premiums": priced(f"SELECT incident_id, {PREMIUM} FROM priced"),
    "a3_quote_premiums": _with(_quotes(), INCIDENTS, REQUESTS, MULTIPLIERS),
    "a3_quote_valid": _with(
        f"SELECT * EXCLUDE (error) FROM ({_quotes()}) q WHERE error IS NULL", INCIDENTS, REQUESTS, MULTIPLIERS
    ),
    "a4_band_of_probability": _with(
        "SELECT request_id, CASE WHEN p_attack * 100e0 < 25 THEN 'Low' WHEN p_attack * 100e0 < 50 THEN 'Moderate' "
        "WHEN p_attack * 100e0 < 75 THEN 'High' ELSE 'Critical' END AS risk_band FROM requests",
        INCIDENTS, REQUESTS,
    ),
    "a5_premium_statistics": priced(_statistics()),
    "a6_premium_by_band": priced(
        f"SELECT band_rank, risk_band, coalesce(m, 0e0) AS avg_premium_usd, coalesce(n, 0) AS n FROM {BANDS} "
        f"LEFT JOIN (SELECT risk_band, {DECIMAL_MEAN} AS m, count(*) AS n FROM priced GROUP BY risk_band) p USING (risk_band)"
    ),
    "a7_price_scenarios": _with(SCENARIO_ROWS, INCIDENTS, SCORED, MULTIPLIERS),
    "a8_ensure_premiums": priced(f"SELECT incident_id, {PREMIUM} FROM priced"),

    "d1_filter": scored(f"SELECT * FROM scored WHERE {CHOSEN}"),
    "d2_filter_regions": scored("SELECT DISTINCT region FROM scored"),
    "d2_filter_range": scored(
        "SELECT min(year) AS year_min, max(year) AS year_max, count(*) AS n_rows, count(DISTINCT region) AS n_regions FROM scored"
    ),
    "d3_overview_kpis": scored(
        "SELECT count(*) AS n_rows, min(year) AS year_min, max(year) AS year_max, "
        "count(DISTINCT nearest_country) AS n_countries, count(DISTINCT region) AS n_regions FROM scored"
    ),
    "d4_attack_type_counts": scored("SELECT attack_type, count(*) AS n FROM scored GROUP BY attack_type"),
    "d5_vessel_status_counts": scored("SELECT vessel_status, count(*) AS n FROM scored GROUP BY vessel_status"),
    "d6_region_counts": scored("SELECT region, count(*) AS n FROM scored GROUP BY region"),
    "d7_annual_counts": scored("SELECT year, count(*) AS n FROM scored GROUP BY year"),
    "d8_peak_year": scored("SELECT year, count(*) AS n FROM scored GROUP BY year ORDER BY n DESC, year LIMIT 1"),
    "d9_year_month_matrix": scored(f"SELECT year, {MONTHS} FROM scored GROUP BY year"),
    "d10_distance_by_region": scored(
        "SELECT region, count(*) AS n, rint(min(shore_distance), 6) AS min, "
        "rint(quantile_cont(shore_distance, 0.25), 6) AS q25, rint(quantile_cont(shore_distance, 0.5), 6) AS q50, "
        "rint(quantile_cont(shore_distance, 0.75), 6) AS q75, rint(max(shore_distance), 6) AS max, "
        "rint(avg(shore_distance), 6) AS mean FROM scored GROUP BY region"
    ),
    "d11_map_sample": scored(
        f"SELECT {MAP_COLUMNS} FROM scored ORDER BY md5(concat('42:', incident_id)), incident_id LIMIT 3000"
    ),
    "d12_sample_records": scored(f"SELECT incident_id, {RECORD} FROM scored WHERE {CHOSEN} ORDER BY incident_id LIMIT 200"),
    "d13_filtered_results": scored(f"SELECT incident_id, {RECORD} FROM scored WHERE {CHOSEN} ORDER BY incident_id LIMIT 50"),
    "d14_class_counts": scored(f"SELECT {CLASS}, count(*) AS n FROM scored GROUP BY attack_occurred"),
    "d15_region_class_counts": scored(
        f"SELECT region, attack_occurred, {CLASS}, count(*) AS n FROM scored GROUP BY region, attack_occurred"
    ),
    "d16_cv_table": folds(
        "SELECT fold, rint(acc_train, 4) AS acc_train, rint(acc_test, 4) AS acc_test, "
        "rint(brier_test, 4) AS brier_test FROM fold_table"
    ),
    "d16_cv_kpis": folds(
        "SELECT rint(avg(acc_test), 6) AS mean_accuracy, rint(avg(brier_test), 6) AS mean_brier FROM fold_table"
    ),
    "d17_probability_kpis": scored(
        "SELECT count(*) AS n_rows, rint(avg(attack_probability_pct), 6) AS avg_pct, "
        "rint(count(*) FILTER (risk_band IN ('High', 'Critical')) * 100e0 / count(*), 6) AS pct_high_or_critical, "
        f"rint(count(*) FILTER (risk_band = 'Critical') * 100e0 / count(*), 6) AS pct_critical FROM scored WHERE {CHOSEN}"
    ),
    "d18_band_counts": scored(
        f"SELECT band_rank, risk_band, coalesce(n, 0) AS n FROM {BANDS} LEFT JOIN "
        f"(SELECT risk_band, count(*) AS n FROM scored WHERE {CHOSEN} GROUP BY risk_band) c USING (risk_band)"
    ),
    "d19_probability_histogram": scored(
        "SELECT bin, bin * 2e0 AS bin_start, bin * 2e0 + 2e0 AS bin_end, risk_band, n FROM (SELECT "
        + BIN.format(x="attack_probability_pct / 2e0", last=49)
        + " AS bin, risk_band, count(*) AS n FROM scored GROUP BY 1, 2) h"
    ),
    "d20_probability_grid": scored(
        "SELECT CAST(floor(latitude / 5e0) AS BIGINT) AS lat_cell, CAST(floor(longitude / 5e0) AS BIGINT) AS lon_cell, "
        "count(*) AS n, rint(sum(attack_probability_pct), 6) AS sum_pct, rint(avg(attack_probability_pct), 6) AS avg_pct "
        "FROM scored GROUP BY 1, 2"
    ),
    "d21_band_attack_hierarchy": scored(
        "SELECT risk_band, attack_type, count(*) AS n, CAST(grouping(risk_band, attack_type) AS INT) AS level "
        "FROM scored GROUP BY ROLLUP (risk_band, attack_type)"
    ),
    "d22_probability_by_region": scored(
        "SELECT region, rint(avg(attack_probability_pct), 6) AS avg_pct FROM scored GROUP BY region"
    ),
    "d23_probability_by_year": scored(
        "SELECT year, rint(avg(attack_probability_pct), 6) AS avg_pct FROM scored GROUP BY year"
    ),
    "d24_portfolio_kpis": priced(
        f"SELECT {DECIMAL_MEAN} AS avg_premium_usd, rint(stddev_samp(total_premium_usd), 2) AS std_premium_usd, "
        "rint(CAST(sum(CAST(premium_rate_pct AS DECIMAL(24, 6))) AS DOUBLE) / count(*), 6) AS avg_rate_pct, "
        "max(premium_rate_pct) AS max_rate_pct, "
        "CAST(sum(CAST(total_premium_usd AS DECIMAL(24, 2))) AS DOUBLE) AS premium_pool_usd, "
        "count(*) FILTER (risk_band IN ('High', 'Critical')) AS n_high_or_critical, "
        "rint(count(*) FILTER (risk_band IN ('High', 'Critical')) * 100e0 / count(*), 6) AS pct_high_or_critical FROM priced"
    ),
    "d25_premium_by_region": priced(f"SELECT region, {DECIMAL_MEAN} AS avg_premium_usd FROM priced GROUP BY region"),
    "d26_rate_by_band": priced(_boxes()),
    "d27_premium_sample": priced(
        "SELECT attack_probability_pct, total_premium_usd, risk_band FROM priced "
        "ORDER BY md5(concat('42:', incident_id)), incident_id LIMIT 2000"
    ),
    "d28_premium_histogram": priced(
        "SELECT " + BIN.format(x="(total_premium_usd - low) / ((high - low) / 60e0)", last=59)
        + " AS bin, count(*) AS n FROM priced, (SELECT min(total_premium_usd) AS low, max(total_premium_usd) AS high FROM priced) e GROUP BY 1"
    ),
    "d29_median_probability": scored("SELECT rint(median(attack_probability_pct), 6) AS median_pct FROM scored"),
    "d30_premium_preview": priced(f"SELECT incident_id, {PREMIUM_TABLE} FROM priced ORDER BY incident_id LIMIT 50"),
    "t1_highest_risk": scored(
        f"SELECT incident_id, {RECORD} FROM scored ORDER BY attack_probability_pct DESC, incident_id LIMIT 10"
    ),
    "t2_lowest_risk": scored(
        f"SELECT incident_id, {RECORD} FROM scored ORDER BY attack_probability_pct, incident_id LIMIT 5"
    ),
}
