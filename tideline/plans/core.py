"""Queries over panels, calendars, audits, forecasts and covariances, each with a DuckDB oracle.

Doubles are rounded alike on both sides, as sums may be ordered differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, describe, risk
from ..sources import durable, panels

DIGITS = 6
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BASE = """
agg AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL),
panel AS (SELECT * FROM agg WHERE date IN (SELECT date FROM agg GROUP BY date HAVING count(*) = (SELECT count(DISTINCT asset) FROM agg))),
ret AS (SELECT * FROM (SELECT asset, date, price, price / lag(price) OVER w - 1 AS s, ln(price) - ln(lag(price) OVER w) AS r FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE r IS NOT NULL),
days AS (SELECT DISTINCT date FROM panel),
macro AS (SELECT CAST(o_orderdate AS DATE) AS date, substr(o_orderpriority, 1, 1) AS series_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 10000 AS value FROM orders GROUP BY ALL),
grid AS (SELECT series_id, date FROM macro UNION SELECT series_id, date FROM days, (SELECT DISTINCT series_id FROM macro)),
filled AS (SELECT * FROM (SELECT series_id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value FROM grid LEFT JOIN macro USING (series_id, date)) WHERE date IN (FROM days)),
numbered AS (SELECT date, row_number() OVER (ORDER BY date) AS position FROM days),
ends AS (SELECT * FROM (SELECT max(date) AS date, max(position) AS position, lead(max(date)) OVER (ORDER BY max(date)) AS next_date FROM numbered GROUP BY date_trunc('month', date)) WHERE position >= 252 AND next_date IS NOT NULL),
held AS (SELECT e.date AS origin, e.next_date, r.asset, r.date, r.r FROM ret r JOIN ends e ON r.date > e.date AND r.date <= e.next_date),
truth AS (SELECT origin AS date, next_date, asset, sum(r * r) AS realized_ivar, count(*) AS horizon_days FROM held GROUP BY ALL),
k AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS k, count(*) OVER (PARTITION BY asset) AS n FROM ret),
seed AS (SELECT asset, CASE WHEN count(*) = 63 THEN var_samp(r) END AS seed FROM k WHERE k <= 63 GROUP BY asset),
ew AS (SELECT asset, date, k, list(r * r) OVER (PARTITION BY asset ORDER BY k) AS past, seed FROM k JOIN seed USING (asset) WHERE k >= 63 AND seed IS NOT NULL),
ewma AS (SELECT asset, date, list_reduce(past, lambda a, x: a * 0.94 + x * 0.06, seed) AS ewma_variance FROM ew),
hist AS (SELECT * FROM (SELECT asset, date, var_samp(r) OVER w AS v, count(*) OVER w AS c FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 62 PRECEDING)) WHERE c = 63),
raw AS (SELECT t.*, 'hist63' AS model, v * horizon_days AS raw FROM truth t JOIN hist USING (asset, date) UNION ALL SELECT t.*, 'ewma', ewma_variance * horizon_days FROM truth t JOIN ewma USING (asset, date)),
fc AS (SELECT *, greatest(raw, 1e-8 * horizon_days) AS forecast_ivar, raw < 1e-8 * horizon_days AS floored FROM raw),
pairs AS (SELECT a.date, a.asset AS asset_i, b.asset AS asset_j, a.r AS x, b.r AS y FROM ret a JOIN ret b USING (date))
"""


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, doubles: str, digits: int = DIGITS) -> str:
    names = doubles.split()
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in names)}) FROM ({sql}) q" if names else sql


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS, base: str = BASE):
    """Registers a query; sql follows the base tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = f"WITH {base.strip()} {rounded_sql(sql, doubles, digits)}" if base else rounded_sql(sql, doubles, digits)
        return f

    return register


def prices(spark, d) -> DataFrame:
    return durable.once(spark, ("prices", d), lambda: panels.proxy_prices(spark, d))


#: erfc by the same fit as ``risk.normal_p``.
_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_p_sql(z: str) -> str:
    """Two-sided normal p-value of an SQL expression."""
    t, poly = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2.0::DOUBLE)))", str(_FIT[-1])
    for k in reversed(_FIT[:-1]):
        poly = f"({poly} * {t} + {k})"
    return f"({t} * exp(-({z}) * ({z}) / 2.0 + {poly}))"


def panel(spark, d) -> DataFrame:
    """The complete panel: the facts are read once for all queries, and this small table of them is landed."""
    return durable.once(spark, ("panel", d), lambda: align.price_panel(prices(spark, d)))


def returns(spark, d, kind: str = "log") -> DataFrame:
    make = C.log_return if kind == "log" else C.simple_return
    return panel(spark, d).withColumn("r", make("price", "asset")).filter("r is not null")


def macro(spark, d) -> DataFrame:
    return durable.once(spark, ("macro", d), lambda: panels.proxy_macro(spark, d))


def macro_filled(spark, d) -> DataFrame:
    return durable.once(spark, ("filled", d), lambda: align.fill_to_calendar(macro(spark, d), align.trading_days(panel(spark, d))))


def ends(spark, d) -> DataFrame:
    return align.month_ends(align.trading_days(panel(spark, d)))


# -- sources, validation, calendars ---------------------------------------------------------------


@query("panel_metadata", "SELECT asset, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, CAST(sum(CAST(price IS NULL AS INT)) AS BIGINT) AS missing FROM agg GROUP BY asset")
def _(spark, d):
    return panels.describe(prices(spark, d), "asset", "price")


@query("price_validation", "SELECT asset, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT date) AS BIGINT) AS duplicate_dates, CAST(count(*) - count(price) AS BIGINT) AS nulls, CAST(sum(CAST(price <= 0 AS INT)) AS BIGINT) AS not_positive, min(CASE WHEN price <= 0 THEN date END) AS first_bad_date, bool_and(price > 0) AS valid FROM agg GROUP BY asset")
def _(spark, d):
    return align.validate(prices(spark, d), "asset", "price")


@query("macro_validation", "SELECT series_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT date) AS BIGINT) AS duplicate_dates, CAST(count(*) - count(value) AS BIGINT) AS nulls, 0::BIGINT AS not_positive, CAST(NULL AS DATE) AS first_bad_date, count(*) = count(DISTINCT date) AND count(value) > 0 AS valid FROM macro GROUP BY series_id")
def _(spark, d):
    return align.validate(macro(spark, d), "series_id", "value", positive=False)


#: Two snapshots of the customers: one lacks the building segment, the other the machinery segment and has other balances in one nation.
SNAPSHOTS = """, want AS (SELECT c_custkey AS path, md5(c_name || c_mktsegment) AS x FROM customer WHERE c_mktsegment <> 'BUILDING'),
have AS (SELECT c_custkey AS path, md5(c_name || c_mktsegment || CASE WHEN c_nationkey = 3 THEN '!' ELSE '' END) AS x FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


@query("snapshot_verify", "SELECT path, CASE WHEN h.x IS NULL THEN 'missing' WHEN w.x IS NULL THEN 'unexpected' WHEN w.x = h.x THEN 'match' ELSE 'differs' END AS status FROM want w FULL JOIN have h USING (path)", base=BASE.rstrip() + SNAPSHOTS)
def _(spark, d):
    rows = panels.landed(spark, d, "customer").withColumn("path", F.col("c_custkey"))
    of = lambda *more: F.md5(F.concat("c_name", "c_mktsegment", *more).cast("binary")).alias("sha256")
    mine = rows.filter("c_mktsegment <> 'BUILDING'").select("path", of())
    return panels.verify(mine, rows.filter("c_mktsegment <> 'MACHINERY'").select("path", of(F.when(F.col("c_nationkey") == 3, "!").otherwise(""))))


@query("snapshot_manifest")
def _(spark, d):
    return panels.manifest(spark, f"{d}/nation.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "bytes", "sha256")


@query("checkpoint_resume", "SELECT DISTINCT asset AS specification FROM agg WHERE asset <> 'A'")
def _(spark, d):
    every = prices(spark, d).select(F.col("asset").alias("specification")).distinct()
    return panels.pending(every, every.filter("specification = 'A'"))


@query("price_panel", "SELECT asset, date, price FROM panel", "price", 10)
def _(spark, d):
    return panel(spark, d).select("asset", "date", "price")


@query("price_panel_wide", "SELECT date, max(price) FILTER (asset = 'A') AS A, max(price) FILTER (asset = 'N') AS N, max(price) FILTER (asset = 'R') AS R FROM panel GROUP BY date", "A N R", 10)
def _(spark, d):
    return panel(spark, d).groupBy("date").pivot("asset", ["A", "N", "R"]).agg(F.first("price"))


@query("macro_ffill", "SELECT series_id, date, value FROM filled", "value", 10)
def _(spark, d):
    return macro_filled(spark, d)


@query("macro_gap_check", "SELECT series_id, CAST(sum(CAST(NOT seen AS INT)) AS BIGINT) AS leading_missing, CAST(sum(CAST(seen AND value IS NULL AS INT)) AS BIGINT) AS internal_missing FROM (SELECT *, count(value) OVER (PARTITION BY series_id ORDER BY date) > 0 AS seen FROM filled) GROUP BY series_id")
def _(spark, d):
    return align.gaps(macro_filled(spark, d))


@query("signal_lag", "SELECT series_id, date, value, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS value_lag1 FROM filled", "value value_lag1", 10)
def _(spark, d):
    return align.signal_lag(macro_filled(spark, d), "value", 1, "series_id")


@query("asof_rate", "SELECT d.date, m.value AS rate FROM days d ASOF LEFT JOIN (FROM macro WHERE series_id = '1') m ON d.date >= m.date", "rate", 10)
def _(spark, d):
    rates = macro(spark, d).filter("series_id = '1'").select("date", F.col("value").alias("rate"))
    return align.as_of(align.trading_days(panel(spark, d)), rates, "rate")


@query("month_end_calendar", "SELECT date, CAST(position AS BIGINT) AS position, next_date FROM ends")
def _(spark, d):
    return ends(spark, d)


@query("rebalance_origins", "SELECT date, CAST(position AS BIGINT) AS position, next_date FROM ends WHERE date >= DATE '1995-03-01'")
def _(spark, d):
    return align.origins_after(ends(spark, d), "1995-03-15")


@query("holding_periods", "SELECT date, next_date, asset, realized_ivar, horizon_days FROM truth", "realized_ivar", 9)
def _(spark, d):
    return risk.realized(ends(spark, d), returns(spark, d))


@query("execution_dates", "SELECT e.date AS signal_date, min(d.date) AS execution_date FROM ends e JOIN days d ON d.date > e.date GROUP BY e.date")
def _(spark, d):
    return align.execution_dates(ends(spark, d).select("date"), align.trading_days(panel(spark, d)))


@query("trailing_five_years", "SELECT e.date AS origin, r.asset, count(*) AS n, avg(r.r) AS mean FROM ends e JOIN ret r ON r.date <= e.date AND r.date >= e.date - INTERVAL 60 MONTH GROUP BY ALL", "mean", 9)
def _(spark, d):
    return align.trailing_years(ends(spark, d), returns(spark, d)).groupBy("origin", "asset").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))


@query("common_dates_check", "SELECT date, asset, count(DISTINCT model) AS models, count(*) AS rows FROM fc GROUP BY ALL HAVING count(*) <> 2")
def _(spark, d):
    return align.uncommon_dates(risk.forecasts(ends(spark, d), returns(spark, d)))


# -- returns, windows -------------------------------------------------------------------------------


@query("simple_returns", "SELECT asset, date, s AS r FROM ret", "r")
def _(spark, d):
    return returns(spark, d, "simple").select("asset", "date", "r")


@query("log_returns", "SELECT asset, date, r FROM ret", "r")
def _(spark, d):
    return returns(spark, d).select("asset", "date", "r")


@query("macro_changes", "SELECT series_id, date, ln(value) - ln(lag(value) OVER w) AS log_change, value - lag(value, 21) OVER w AS diff_21, lead(value, 21) OVER w AS ahead_21 FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY date)", "log_change diff_21 ahead_21", 10)
def _(spark, d):
    w = C.by("series_id")
    return macro_filled(spark, d).select("series_id", "date", (F.log("value") - F.log(F.lag("value").over(w))).alias("log_change"), (F.col("value") - F.lag("value", 21).over(w)).alias("diff_21"), F.lead("value", 21).over(w).alias("ahead_21"))


@query("yield_slope", "SELECT date, max(value) FILTER (series_id = '2') - max(value) FILTER (series_id = '1') AS slope FROM filled GROUP BY date", "slope", 10)
def _(spark, d):
    wide = macro_filled(spark, d).groupBy("date").pivot("series_id", ["1", "2"]).agg(F.first("value"))
    return wide.select("date", (F.col("2") - F.col("1")).alias("slope"))


@query("rolling_vol_21", "SELECT asset, date, CASE WHEN count(r) OVER w = 21 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 20 PRECEDING)", "vol")
def _(spark, d):
    return returns(spark, d).select("asset", "date", C.rolling_std("r", 21, "asset", annualize=True).alias("vol"))


@query("rolling_vol_63", "SELECT asset, date, CASE WHEN count(r) OVER w = 63 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 62 PRECEDING)", "vol")
def _(spark, d):
    return returns(spark, d).select("asset", "date", C.rolling_std("r", 63, "asset", annualize=True).alias("vol"))


@query("rolling_var_63", "SELECT asset, date, CASE WHEN count(r) OVER w = 63 THEN var_samp(r) OVER w END AS variance FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 62 PRECEDING)", "variance", 9)
def _(spark, d):
    return returns(spark, d).select("asset", "date", C.rolling_var("r", 63, "asset").alias("variance"))


@query("rolling_corr_63", "SELECT asset_i, asset_j, date, CASE WHEN count(*) OVER w = 63 THEN corr(x, y) OVER w END AS correlation FROM pairs WHERE asset_i < asset_j WINDOW w AS (PARTITION BY asset_i, asset_j ORDER BY date ROWS 62 PRECEDING)", "correlation")
def _(spark, d):
    rows = risk.pairs(returns(spark, d)).filter("asset_i < asset_j")
    return rows.select("asset_i", "asset_j", "date", C.rolling_corr("x", "y", 63, "asset_i", "asset_j").alias("correlation"))


@query("rolling_cov_63", "SELECT date, asset_i, asset_j, covariance FROM (SELECT date, asset_i, asset_j, covar_samp(x, y) OVER w AS covariance, count(*) OVER w AS c FROM pairs WINDOW w AS (PARTITION BY asset_i, asset_j ORDER BY date ROWS 62 PRECEDING)) WHERE c = 63", "covariance", 8)
def _(spark, d):
    return risk.rolling_covariance(returns(spark, d), 63)


@query("drawdown", "SELECT asset, date, price / max(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS drawdown FROM panel", "drawdown")
def _(spark, d):
    return panel(spark, d).select("asset", "date", C.drawdown("price", "asset").alias("drawdown"))


@query("max_drawdown", "SELECT asset, min(dd) AS max_drawdown, arg_min(date, dd) AS trough FROM (SELECT asset, date, price / max(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS dd FROM panel) GROUP BY asset", "max_drawdown")
def _(spark, d):
    rows = panel(spark, d).withColumn("dd", C.drawdown("price", "asset"))
    return rows.groupBy("asset").agg(F.min("dd").alias("max_drawdown"), F.min_by("date", "dd").alias("trough"))


@query("normalized_prices", "SELECT asset, date, price / first(price) OVER (PARTITION BY asset ORDER BY date) * 100 AS level FROM panel", "level")
def _(spark, d):
    return panel(spark, d).select("asset", "date", (F.col("price") / F.first("price").over(C.by("asset")) * 100).alias("level"))


@query("expanding_median", "SELECT asset, date, median(r) OVER w AS median FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date) QUALIFY count(*) OVER w >= 252", "median")
def _(spark, d):
    w = C.expanding("asset")
    rows = returns(spark, d).select("asset", "date", F.percentile("r", 0.5).over(w).alias("median"), F.count("r").over(w).alias("k"))
    return rows.filter("k >= 252").drop("k")


@query("wealth", "SELECT asset, date, exp(sum(ln(1 + s)) OVER (PARTITION BY asset ORDER BY date)) AS wealth FROM ret", "wealth")
def _(spark, d):
    return returns(spark, d, "simple").select("asset", "date", C.wealth("r", "asset").alias("wealth"))


# -- summaries and audits ----------------------------------------------------------------------------


@query(
    "summary_statistics",
    """SELECT asset, count(s) AS n, avg(s) * 1e4 AS mean_bps, quantile_cont(s, 0.5) * 1e4 AS median_bps, stddev_samp(s) * 100 AS std_pct, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS excess_kurtosis, min(s) AS min_r, max(s) AS max_r,
    quantile_cont(s, 0.01) AS q01, quantile_cont(s, 0.05) AS q05, avg(CASE WHEN s IS NULL THEN NULL WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, stddev_samp(s) * sqrt(252) AS ann_vol, min(dd) AS max_drawdown, pow(arg_max(price, date) / arg_min(price, date), 252.0 / count(s)) - 1 AS cagr,
    count(s) / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jarque_bera, exp(-count(s) / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) / 2) AS jarque_bera_p
    FROM (SELECT p.*, r.s, price / max(price) OVER (PARTITION BY p.asset ORDER BY p.date) - 1 AS dd FROM panel p LEFT JOIN (SELECT asset, date, s FROM ret) r USING (asset, date))
    JOIN (SELECT asset, avg(pow(s - mu, 2)) AS m2, avg(pow(s - mu, 3)) AS m3, avg(pow(s - mu, 4)) AS m4 FROM ret JOIN (SELECT asset, avg(s) AS mu FROM ret GROUP BY asset) USING (asset) GROUP BY asset) USING (asset) GROUP BY asset, m2, m3, m4""",
    "mean_bps median_bps std_pct skew excess_kurtosis min_r max_r q01 q05 share_positive ann_vol max_drawdown cagr jarque_bera jarque_bera_p",
)
def _(spark, d):
    return describe.summary_statistics(panel(spark, d))


@query("macro_summary", "SELECT series_id, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, arg_min(value, date) AS first_value, arg_max(value, date) AS last_value, CAST(sum(CAST(value IS NULL AS INT)) AS BIGINT) AS n_missing FROM filled GROUP BY series_id", "mean median std min max first_value last_value")
def _(spark, d):
    return describe.macro_summary(macro_filled(spark, d))


@query("missingness_audit", """SELECT series_id, raw_rows, 0::BIGINT AS raw_missing, aligned_rows, aligned_missing, leading_missing FROM (SELECT series_id, count(*) AS raw_rows FROM macro GROUP BY series_id)
    LEFT JOIN (SELECT series_id, count(*) AS aligned_rows, CAST(sum(CAST(value IS NULL AS INT)) AS BIGINT) AS aligned_missing, CAST(sum(CAST(first IS NULL OR date < first AS INT)) AS BIGINT) AS leading_missing FROM (SELECT *, min(CASE WHEN value IS NOT NULL THEN date END) OVER (PARTITION BY series_id) AS first FROM filled) GROUP BY series_id) USING (series_id)""")
def _(spark, d):
    return describe.missingness(macro(spark, d), macro_filled(spark, d))


@query("staleness_audit", """SELECT series_id, max(length) AS longest_run, CAST(sum(length - 1) AS BIGINT) AS unchanged_days, sum(length - 1) / (sum(length) - 1) AS share_unchanged FROM
    (SELECT series_id, run, count(*) AS length FROM (SELECT *, sum(CAST(value IS DISTINCT FROM before AS INT)) OVER (PARTITION BY series_id ORDER BY date) AS run FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS before FROM filled WHERE value IS NOT NULL)) GROUP BY ALL) GROUP BY series_id""", "share_unchanged")
def _(spark, d):
    return describe.staleness(macro_filled(spark, d), "series_id", "value")


@query("calendar_audit", """SELECT series_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, 0::BIGINT AS duplicates, CAST(sum(CAST(isodow(date) >= 6 AS INT)) AS BIGINT) AS weekend_rows, max(gap) AS max_gap, CAST(sum(CAST(coalesce(gap > 4, false) AS INT)) AS BIGINT) AS gaps_over
    FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY series_id ORDER BY date), date) AS gap FROM macro) GROUP BY series_id""")
def _(spark, d):
    return describe.calendar_audit(macro(spark, d), "series_id")


@query("top_gaps", "SELECT date, gap, strftime(date, '%Y-%m-%d') || ' (' || gap || 'd)' AS label FROM (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM (SELECT DISTINCT date FROM macro WHERE series_id = '1')) WHERE gap IS NOT NULL ORDER BY gap DESC, date DESC LIMIT 10")
def _(spark, d):
    return describe.top_gaps(macro(spark, d).filter("series_id = '1'"))


@query("correlation_matrix", "SELECT asset_i, asset_j, corr(x, y) AS correlation FROM pairs GROUP BY ALL", "correlation")
def _(spark, d):
    return describe.correlation_matrix(returns(spark, d))


@query("feature_correlations", """SELECT kind, a.series_id AS asset_i, b.series_id AS asset_j, corr(a.value, b.value) AS correlation, count(*) AS n FROM f a JOIN f b USING (kind, date) WHERE a.series_id < b.series_id AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""", "correlation",
       base=BASE.rstrip() + ",\nf AS (SELECT 'level' AS kind, series_id, date, value FROM filled UNION ALL SELECT 'difference', series_id, date, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) FROM filled)")
def _(spark, d):
    return describe.feature_correlations(macro_filled(spark, d).withColumnRenamed("series_id", "asset"))


PERIODS = [("early", "1992-01-01", "1994-12-31"), ("middle", "1994-01-01", "1996-12-31"), ("late", "1997-01-01", "1999-12-31")]


@query("subperiod_summaries", """SELECT period, asset, count(*) AS n, stddev_samp(r) * sqrt(252) AS ann_vol, min(dd) AS max_drawdown, pow(arg_max(price, date) / arg_min(price, date), 252.0 / (count(*) - 1)) - 1 AS cagr FROM
    (SELECT period, asset, date, price, price / lag(price) OVER w - 1 AS r, price / max(price) OVER w - 1 AS dd FROM panel JOIN (VALUES ('early', DATE '1992-01-01', DATE '1994-12-31'), ('middle', DATE '1994-01-01', DATE '1996-12-31'), ('late', DATE '1997-01-01', DATE '1999-12-31')) v(period, start, stop) ON date BETWEEN start AND stop WINDOW w AS (PARTITION BY period, asset ORDER BY date)) GROUP BY ALL HAVING count(*) >= 42""", "ann_vol max_drawdown cagr")
def _(spark, d):
    periods = spark.createDataFrame(PERIODS, "period string, start string, stop string").selectExpr("period", "cast(start as date) start", "cast(stop as date) stop")
    return describe.subperiods(panel(spark, d), periods)


@query("return_histogram", """SELECT asset, CAST(least(floor((s - low) / (high - low) * 120), 119) AS BIGINT) AS bin, count(*) AS n FROM ret JOIN (SELECT asset, quantile_cont(s, 0.0005) AS low, quantile_cont(s, 0.9995) AS high FROM ret GROUP BY asset) USING (asset) WHERE s BETWEEN low AND high AND high > low GROUP BY ALL""")
def _(spark, d):
    return describe.histogram(returns(spark, d, "simple"), "asset", "r")


@query("stability", """SELECT metric, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, 0::BIGINT AS non_finite FROM (SELECT 'price' AS metric, price AS v FROM ret UNION ALL SELECT 'r', r FROM ret) GROUP BY metric""", "mean std min max")
def _(spark, d):
    return describe.stability(returns(spark, d), ["price", "r"])


@query("run_compare", "SELECT 'r' AS metric, max(abs(r - s)) AS max_abs, avg(abs(r - s)) AS mean_abs, CAST(sum(CAST(r = s AS INT)) AS BIGINT) AS exact, 0::BIGINT AS one_sided_nulls FROM ret", "max_abs mean_abs")
def _(spark, d):
    return describe.compare_runs(returns(spark, d), returns(spark, d, "simple"), ["asset", "date"], ["r"])


@query("group_argmax", "SELECT date, asset, r, r - second AS gap FROM (SELECT *, row_number() OVER w AS k, lead(r) OVER w AS second FROM ret WINDOW w AS (PARTITION BY date ORDER BY r DESC, asset)) WHERE k = 1", "r gap")
def _(spark, d):
    return describe.best_of(returns(spark, d).select("date", "asset", "r"), "date", "r", "asset")


# -- forecasts -----------------------------------------------------------------------------------------


@query("ewma_variance", "SELECT asset, date, ewma_variance FROM ewma", "ewma_variance", 9)
def _(spark, d):
    return risk.ewma_variance_closed(returns(spark, d))


@query("vol_forecasts", "SELECT date, next_date, asset, realized_ivar, horizon_days, model, forecast_ivar, floored, true AS converged, false AS substituted FROM fc", "realized_ivar forecast_ivar", 8)
def _(spark, d):
    return risk.forecasts(ends(spark, d), returns(spark, d))


Q = "realized_ivar / forecast_ivar - ln(realized_ivar / forecast_ivar) - 1"


@query("loss_table", f"""SELECT asset, model, avg({Q}) AS qlike, avg(abs(forecast_ivar - realized_ivar)) * 1e4 AS mae, sqrt(avg(pow(forecast_ivar - realized_ivar, 2))) * 1e4 AS rmse, count(*) AS n, avg({Q}) FILTER (date >= DATE '1995-01-01') AS qlike_oos,
    avg(abs(forecast_ivar - realized_ivar)) FILTER (date >= DATE '1995-01-01') * 1e4 AS mae_oos, sqrt(avg(pow(forecast_ivar - realized_ivar, 2)) FILTER (date >= DATE '1995-01-01')) * 1e4 AS rmse_oos, count(*) FILTER (date >= DATE '1995-01-01') AS n_oos FROM fc GROUP BY ALL""", "qlike mae rmse qlike_oos mae_oos rmse_oos")
def _(spark, d):
    return risk.losses(risk.forecasts(ends(spark, d), returns(spark, d)), "1995-01-01")


DM = f""", q AS (SELECT date, asset, max(CASE WHEN model = 'hist63' THEN {Q} END) - max(CASE WHEN model = 'ewma' THEN {Q} END) AS d FROM fc GROUP BY ALL),
e AS (SELECT asset, d - avg(d) OVER (PARTITION BY asset) AS e, avg(d) OVER (PARTITION BY asset) AS mean, count(*) OVER (PARTITION BY asset) AS n, date FROM q),
l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e WINDOW w AS (PARTITION BY asset ORDER BY date)),
dm AS (SELECT asset, mean, n, sqrt(sum(e * e) + 1.5 * coalesce(sum(e * e1), 0) + 1.0 * coalesce(sum(e * e2), 0) + 0.5 * coalesce(sum(e * e3), 0)) / n AS se FROM l GROUP BY asset, mean, n)"""


@query("diebold_mariano", f"SELECT asset, mean, n, se, mean / se AS z, {normal_p_sql('mean / se')} AS p_value, mean - 1.96 * se AS ci_low, mean + 1.96 * se AS ci_high, CASE WHEN mean < 0 THEN 'hist63' ELSE 'ewma' END AS favours FROM dm", "mean se z p_value ci_low ci_high", base=BASE.rstrip() + DM)
def _(spark, d):
    return risk.diebold_mariano(risk.forecasts(ends(spark, d), returns(spark, d)), "hist63", "ewma")


@query("holm", f"""SELECT test, p, max(least((m - k + 1) * p, 1.0)) OVER (ORDER BY p, test) AS p_holm FROM (SELECT test, p, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM (SELECT asset AS test, {normal_p_sql("mean / se")} AS p FROM dm))""", "p p_holm", base=BASE.rstrip() + DM)
def _(spark, d):
    dm = risk.diebold_mariano(risk.forecasts(ends(spark, d), returns(spark, d)), "hist63", "ewma")
    return risk.holm(dm.select(F.col("asset").alias("test"), F.col("p_value").alias("p"), F.lit("dm").alias("family")), "p", "family").drop("family")


# -- covariances ------------------------------------------------------------------------------------------


@query("sample_cov", "SELECT asset_i, asset_j, covar_samp(x, y) AS covariance FROM pairs GROUP BY ALL", "covariance", 9)
def _(spark, d):
    return risk.sample_covariance(returns(spark, d))


WEIGHTED = """, w AS (SELECT asset, date, r, pow(0.94, row_number() OVER (PARTITION BY asset ORDER BY date DESC) - 1) AS weight FROM ret),
m AS (SELECT asset, sum(weight * r) / sum(weight) AS m FROM w GROUP BY asset), c AS (SELECT w.*, r - m AS c FROM w JOIN m USING (asset))"""


@query("ewma_cov", "SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.weight * a.c * b.c) / sum(a.weight) AS covariance FROM c a JOIN c b USING (date) GROUP BY ALL", "covariance", 9, BASE.rstrip() + WEIGHTED)
def _(spark, d):
    return risk.ewma_covariance(returns(spark, d))


LW = """, c AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS c FROM ret),
s AS (SELECT a.asset AS asset_i, b.asset AS asset_j, avg(a.c * b.c) AS s, avg(a.c * a.c * b.c * b.c) AS f, count(*) AS n FROM c a JOIN c b USING (date) GROUP BY ALL),
t AS (SELECT sum(s) FILTER (asset_i = asset_j) / sqrt(count(*)) AS mu, sqrt(count(*)) AS p, sum(s * s) AS ss, sum(f) AS ff, max(n) AS n FROM s),
u AS (SELECT mu, least((ff - ss) / (p * n), (ss - p * mu * mu) / p) / ((ss - p * mu * mu) / p) AS intensity FROM t),
lw AS (SELECT asset_i, asset_j, (1 - intensity) * s + CASE WHEN asset_i = asset_j THEN intensity * mu ELSE 0 END AS covariance, intensity FROM s, u)"""


@query("ledoit_wolf", "SELECT asset_i, asset_j, covariance, intensity FROM lw", "covariance intensity", 9, BASE.rstrip() + LW)
def _(spark, d):
    return risk.ledoit_wolf(returns(spark, d))


@query("ewma_scaled_cov", """SELECT asset_i, asset_j, sqrt(vi.v * vj.v) * covariance / sqrt(vi.d * vj.d) AS covariance FROM lw JOIN x vi ON vi.asset = asset_i JOIN x vj ON vj.asset = asset_j""", "covariance", 9,
       BASE.rstrip() + LW + ", x AS (SELECT asset, arg_max(ewma_variance, date) AS v, any_value(covariance) AS d FROM ewma JOIN lw ON asset = asset_i AND asset = asset_j GROUP BY asset)")
def _(spark, d):
    r = returns(spark, d)
    latest = risk.ewma_variance_closed(r).groupBy("asset").agg(F.max_by("ewma_variance", "date").alias("ewma_variance"))
    return risk.ewma_scaled(latest, risk.ledoit_wolf(r).drop("intensity"))


#: Responsibilities by a rule: the market asset's 21-day volatility above its overall median.
STATE = """, v AS (SELECT date, CASE WHEN count(*) OVER w = 21 THEN stddev_samp(r) OVER w END AS v FROM ret WHERE asset = 'A' WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)),
h AS (SELECT date, CASE WHEN v > (SELECT quantile_cont(v, 0.5) FROM v) THEN 0.9 ELSE 0.1 END AS high FROM v WHERE v IS NOT NULL),
g AS (SELECT date, asset, r, state, CASE WHEN state = 1 THEN high ELSE 1 - high END AS weight FROM ret JOIN h USING (date), (VALUES (0), (1)) z(state)),
sm AS (SELECT state, asset, sum(weight * r) / sum(weight) AS m FROM g GROUP BY ALL), sc AS (SELECT g.*, r - m AS c FROM g JOIN sm USING (state, asset)),
states AS (SELECT a.state, a.asset AS asset_i, b.asset AS asset_j, sum(a.weight * a.c * b.c) / sum(a.weight) AS covariance FROM sc a JOIN sc b USING (state, date) GROUP BY ALL),
neff AS (SELECT state, pow(sum(weight), 2) / sum(weight * weight) AS n_eff FROM g WHERE asset = 'A' GROUP BY state)"""


def responsibilities(spark, d) -> DataFrame:
    r = returns(spark, d)
    market = r.filter("asset = 'A'").select("date", "asset", C.rolling_std("r", 21, "asset").alias("v")).filter("v is not null")
    middle = market.agg(F.percentile("v", 0.5).alias("median"))
    high = market.join(F.broadcast(middle)).select("date", F.when(F.col("v") > F.col("median"), 0.9).otherwise(0.1).alias("high"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("state"), (1 - F.col("high")).alias("weight")), F.struct(F.lit(1).alias("state"), F.col("high").alias("weight"))))
    return r.join(high.select("date", both.alias("s")).select("date", "s.*"), "date")


@query("weighted_state_cov", "SELECT state, asset_i, asset_j, covariance, n_eff FROM states JOIN neff USING (state)", "covariance n_eff", 8, BASE.rstrip() + STATE)
def _(spark, d):
    rows = responsibilities(spark, d)
    return risk.weighted_covariance(rows, "state").join(risk.effective_sample(rows.filter("asset = 'A'"), "state"), "state")


@query("shrunk_state_cov", "SELECT state, asset_i, asset_j, n_eff / (n_eff + 60) * states.covariance + 60 / (n_eff + 60) * lw.covariance AS covariance FROM states JOIN neff USING (state) JOIN lw USING (asset_i, asset_j)", "covariance", 9, BASE.rstrip() + LW + STATE)
def _(spark, d):
    rows = responsibilities(spark, d)
    n_eff = risk.effective_sample(rows.filter("asset = 'A'"), "state")
    return risk.shrink_states(risk.weighted_covariance(rows, "state"), risk.ledoit_wolf(returns(spark, d)).drop("intensity"), n_eff)


@query("regime_mixture", "SELECT asset_i, asset_j, sum(CASE WHEN state = 0 THEN 0.7 ELSE 0.3 END * covariance) AS covariance FROM states GROUP BY ALL", "covariance", 9, BASE.rstrip() + STATE)
def _(spark, d):
    states = risk.weighted_covariance(responsibilities(spark, d), "state")
    return risk.mixture(states, spark.createDataFrame([(0, 0.7), (1, 0.3)], "state int, p double"))


#: Chains of two states from the parts: start, and the probabilities to stay.
CHAINS = "SELECT DISTINCT p_size / 50.0::DOUBLE AS p0, 0.5 + p_size / 200.0::DOUBLE AS p00, 0.9 - p_size / 100.0::DOUBLE AS p11 FROM part"


@query("horizon_probs", f"""SELECT p0, p00, p11, pbar0, 1 - pbar0 AS pbar1 FROM (SELECT p0, p00, p11, (s + (p0 - s) * (p00 + p11 - 1) * (1 - pow(p00 + p11 - 1, 21)) / (2 - p00 - p11) / 21) AS pbar0 FROM (SELECT *, (1 - p11) / (2 - p00 - p11) AS s FROM ({CHAINS})))""", "p0 p00 p11 pbar0 pbar1", base="")
def _(spark, d):
    size = F.col("p_size").cast("double")
    chains = panels.landed(spark, d, "part").select((size / 50.0).alias("p0"), (0.5 + size / 200.0).alias("p00"), (0.9 - size / 100.0).alias("p11")).distinct()
    return risk.horizon_probabilities(chains, 21)


@query("matrix_distance", "SELECT sqrt(sum(pow(s.covariance - l.covariance, 2))) / sqrt(sum(l.covariance * l.covariance)) AS relative_norm, 0.0::DOUBLE AS asymmetry FROM (SELECT asset_i, asset_j, covar_samp(x, y) AS covariance FROM pairs GROUP BY ALL) s JOIN lw l USING (asset_i, asset_j)", "relative_norm asymmetry", base=BASE.rstrip() + LW)
def _(spark, d):
    r = returns(spark, d)
    return risk.frobenius(risk.sample_covariance(r), risk.ledoit_wolf(r).drop("intensity"))


