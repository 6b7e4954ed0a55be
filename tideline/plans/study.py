"""Queries of the study: weights, accounting, performance, inference, regimes, grid, reports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import accounting, align, describe, inference, portfolio, regimes, reports, risk
from ..sources import durable, panels
from ..streaming import panels as streams
from . import core
from .core import BASE, rounded, rounded_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COSTS = (0.0, 5.0, 10.0, 25.0)
CAP = 0.6
#: Starts of a fit in the registered queries.
SEEDS = tuple(range(42, 58))


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6, base: str = BASE):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = f"WITH {base.strip()} {rounded_sql(sql, doubles, digits)}" if base else rounded_sql(sql, doubles, digits)
        return f

    return register


# -- rule-based targets and their accounting ---------------------------------------------------------

#: Equal weights and a 60/40 mix at every execution day; every fourth signal of the mix falls back (no trade).
PATH = """, sig AS (SELECT e.date AS signal, min(d.date) AS date, row_number() OVER (ORDER BY e.date) AS k FROM ends e JOIN days d ON d.date > e.date GROUP BY e.date),
tg AS (SELECT 'equal_weight' AS strategy, date, asset, 1.0 / 3 AS w FROM sig, (SELECT DISTINCT asset FROM panel)
  UNION ALL SELECT 'sixty_forty', date, asset, CASE WHEN k % 4 = 0 THEN NULL WHEN asset = 'A' THEN 0.6 WHEN asset = 'N' THEN 0.4 ELSE 0.0 END FROM sig, (SELECT DISTINCT asset FROM panel)),
g0 AS (SELECT strategy, r.date, r.asset, r.s AS r, t.w FROM ret r JOIN (SELECT strategy, min(date) AS start FROM tg GROUP BY strategy) b ON r.date >= b.start LEFT JOIN tg t USING (strategy, date, asset)),
g1 AS (SELECT *, count(w) OVER p AS segment, last_value(w IGNORE NULLS) OVER p AS w0 FROM g0 WINDOW p AS (PARTITION BY strategy, asset ORDER BY date)),
g2 AS (SELECT *, w0 * product(CASE WHEN w IS NOT NULL THEN 1 ELSE 1 + r END) OVER (PARTITION BY strategy, asset, segment ORDER BY date) AS v FROM g1),
g3 AS (SELECT *, coalesce(w, v / nullif(sum(v) OVER (PARTITION BY strategy, date), 0), 0) AS post FROM g2),
g4 AS (SELECT *, coalesce(lag(post) OVER (PARTITION BY strategy, asset ORDER BY date), 0) AS held FROM g3),
g5 AS (SELECT *, held * (1 + r) AS grown, sum(held) OVER q AS before, sum(held * (1 + r)) OVER q AS total FROM g4 WINDOW q AS (PARTITION BY strategy, date)),
path AS (SELECT strategy, date, asset, post, w, before, total, CASE WHEN before > 0 AND total > 0 THEN grown / total ELSE held END AS pre, coalesce(w - CASE WHEN before > 0 AND total > 0 THEN grown / total ELSE held END, 0) AS trade FROM g5),
ev AS (SELECT strategy, date, max(CASE WHEN before > 0 THEN total - before ELSE 0 END) AS gross_return, sum(abs(trade)) AS full_trade_sum, bool_or(w IS NOT NULL) AS executed FROM path GROUP BY ALL),
net AS (SELECT *, (1 + gross_return) * (1 - cost_fraction) - 1 AS net_return FROM (SELECT *, cost_bps / 10000 * full_trade_sum AS cost_fraction FROM ev, (VALUES (0.0::DOUBLE), (5.0), (10.0), (25.0)) c(cost_bps))),
nw AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy, cost_bps ORDER BY date) AS wealth FROM net),
rate AS (SELECT d.date, m.value AS rate FROM days d ASOF LEFT JOIN (FROM macro WHERE series_id = '1') m ON d.date >= m.date),
rf AS (SELECT date, coalesce(lag(rate) OVER (ORDER BY date) / 100 * date_diff('day', lag(date) OVER (ORDER BY date), date) / 360, 0) AS rf FROM rate),
pf AS (SELECT strategy, cost_bps, count(*) AS n_days, arg_max(wealth, date) AS final_wealth, stddev_samp(net_return) * sqrt(252) AS ann_vol, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe, avg(x) / sqrt(avg(pow(least(x, 0), 2))) * sqrt(252) AS sortino, min(dd) AS max_drawdown,
  -quantile_cont(net_return, 0.05) AS var95, -quantile_cont(net_return, 0.01) AS var99, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) / 365.25 AS years, max(net_return) AS best_day, min(net_return) AS worst_day, avg(CAST(net_return > 0 AS INT)) * 100 AS positive_days_pct, sum(full_trade_sum) / (count(*) / 252) AS ann_turnover, sum(cost_fraction) / (count(*) / 252) AS ann_cost, pow(arg_max(wealth, date), 365.25 / date_diff('day', min(date), max(date))) - 1 AS cagr
  FROM (SELECT n.*, net_return - coalesce(rf, 0) AS x, wealth / greatest(max(wealth) OVER (PARTITION BY strategy, cost_bps ORDER BY n.date), 1) - 1 AS dd FROM nw n LEFT JOIN rf USING (date)) GROUP BY ALL),
perf AS (SELECT p.*, -t.es AS es95, -t.es9 AS es99, cagr / abs(max_drawdown) AS calmar FROM pf p JOIN (SELECT n.strategy, n.cost_bps, avg(net_return) FILTER (net_return <= -var95) AS es, avg(net_return) FILTER (net_return <= -var99) AS es9 FROM net n JOIN pf USING (strategy, cost_bps) GROUP BY ALL) t USING (strategy, cost_bps))"""
WITH = BASE.rstrip() + PATH


def targets(spark, d) -> DataFrame:
    ends = core.ends(spark, d)
    ex = align.execution_dates(ends.select("date"), align.trading_days(core.panel(spark, d)))
    ex = ex.withColumn("k", F.row_number().over(Window.orderBy("signal_date"))).withColumn("one", F.lit(1))
    assets = core.panel(spark, d).select("asset").distinct()
    every = ex.join(assets.withColumn("one", F.lit(1)), "one")
    equal = every.select(F.lit("equal_weight").alias("strategy"), F.col("execution_date").alias("date"), "asset", F.lit(1.0 / 3).alias("weight"))
    w = F.when(F.col("k") % 4 == 0, F.lit(None).cast("double")).when(F.col("asset") == "A", 0.6).when(F.col("asset") == "N", 0.4).otherwise(0.0)
    return equal.unionByName(every.select(F.lit("sixty_forty").alias("strategy"), F.col("execution_date").alias("date"), "asset", w.alias("weight")))


def simulated(spark, d):
    """Weights and events, each landed once for the queries that start from them."""
    made = {}

    def part(i: int) -> DataFrame:
        made.setdefault("both", accounting.simulate(core.returns(spark, d, "simple"), targets(spark, d)))
        return made["both"][i]

    return tuple(durable.once(spark, (name, d), lambda i=i: part(i)) for i, name in enumerate(("weights", "events")))


def net(spark, d) -> DataFrame:
    return durable.once(spark, ("net", d), lambda: accounting.net_returns(simulated(spark, d)[1], COSTS))


def rf(spark, d) -> DataFrame:
    def make() -> DataFrame:
        days = align.trading_days(core.panel(spark, d))
        rates = core.macro(spark, d).filter("series_id = '1'").select("date", F.col("value").alias("rate"))
        return accounting.risk_free(days, align.as_of(days, rates, "rate"))

    return durable.once(spark, ("rf", d), make)


def performance(spark, d) -> DataFrame:
    return accounting.performance(net(spark, d), rf(spark, d), "strategy", "cost_bps")


def paired(spark, d) -> DataFrame:
    """date, and of a (equal weights) and b (60/40) excess and net returns at 10 basis points."""
    rows = net(spark, d).filter("cost_bps = 10").join(rf(spark, d), "date").withColumn("x", F.col("net_return") - F.col("rf"))
    legs = {"a": "equal_weight", "b": "sixty_forty"}
    own = lambda name, c: F.max(F.when(F.col("strategy") == name, F.col(c)))
    return rows.groupBy("date").agg(*[own(name, "x").alias(leg) for leg, name in legs.items()], *[own(name, "net_return").alias(f"net_{leg}") for leg, name in legs.items()])


@query("drift_path", "SELECT strategy, date, asset, pre, post, trade FROM path", "pre post trade", base=WITH)
def _(spark, d):
    return simulated(spark, d)[0]


@query("backtest_events", "SELECT strategy, date, gross_return, full_trade_sum, executed FROM ev", "gross_return full_trade_sum", base=WITH)
def _(spark, d):
    return simulated(spark, d)[1]


@query("net_returns_by_cost", "SELECT strategy, date, cost_bps, gross_return, full_trade_sum, executed, cost_fraction, net_return, wealth FROM nw", "gross_return full_trade_sum cost_fraction net_return wealth cost_bps", base=WITH)
def _(spark, d):
    return net(spark, d)


@query("risk_free", "SELECT date, rf FROM rf", "rf", 9, WITH)
def _(spark, d):
    return rf(spark, d)


@query("performance_summary", "SELECT * FROM perf", "cost_bps final_wealth ann_vol sharpe sortino max_drawdown var95 var99 years best_day worst_day positive_days_pct ann_turnover ann_cost cagr es95 es99 calmar", 5, WITH)
def _(spark, d):
    return performance(spark, d)


@query("safeguards", """SELECT 'zero_cost_equals_gross' AS "check", max(abs(net_return - gross_return)) < 1e-12 AS ok FROM nw WHERE cost_bps = 0
  UNION ALL SELECT 'wealth_falls_with_cost', NOT coalesce(bool_or(up), false) FROM (SELECT wealth > lag(wealth) OVER (PARTITION BY strategy ORDER BY cost_bps) + 1e-12 AS up FROM (SELECT strategy, cost_bps, arg_max(wealth, date) AS wealth FROM nw GROUP BY ALL))
  UNION ALL SELECT 'same_dates', count(DISTINCT n) = 1 FROM (SELECT count(*) AS n FROM nw GROUP BY strategy, cost_bps)
  UNION ALL SELECT 'cagr_reconciles', max(abs(cagr - g)) < 1e-8 FROM perf JOIN (SELECT strategy, cost_bps, exp(sum(ln(1 + net_return)) * 365.25 / date_diff('day', min(date), max(date))) - 1 AS g FROM nw GROUP BY ALL) USING (strategy, cost_bps)""", base=WITH)
def _(spark, d):
    return accounting.safeguards(net(spark, d), performance(spark, d))


@query("rolling_sharpe", "SELECT strategy, cost_bps, date, CASE WHEN count(*) OVER w = 252 THEN avg(x) OVER w / stddev_samp(x) OVER w * sqrt(252) END AS rolling_sharpe FROM (SELECT n.*, net_return - rf AS x FROM net n JOIN rf USING (date)) WINDOW w AS (PARTITION BY strategy, cost_bps ORDER BY date ROWS 251 PRECEDING)", "cost_bps rolling_sharpe", 5, WITH)
def _(spark, d):
    excess = net(spark, d).join(rf(spark, d), "date").withColumn("x", F.col("net_return") - F.col("rf"))
    return accounting.rolling_sharpe(excess, "x", 252, "strategy", "cost_bps").select("strategy", "cost_bps", "date", "rolling_sharpe")


@query("rolling_turnover", "SELECT strategy, date, CASE WHEN count(*) OVER w = 252 THEN sum(full_trade_sum) OVER w END AS turnover FROM ev WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS 251 PRECEDING)", "turnover", base=WITH)
def _(spark, d):
    w = C.trailing(252, "strategy")
    return simulated(spark, d)[1].select("strategy", "date", C.full(F.sum("full_trade_sum").over(w), F.col("full_trade_sum"), 252, w).alias("turnover"))


@query("strategy_drawdown", "SELECT strategy, date, wealth / max(wealth) OVER (PARTITION BY strategy ORDER BY date) - 1 AS drawdown FROM nw WHERE cost_bps = 10", "drawdown", base=WITH)
def _(spark, d):
    return net(spark, d).filter("cost_bps = 10").select("strategy", "date", C.drawdown("wealth", "strategy").alias("drawdown"))


@query("concentration", "SELECT strategy, avg(1 / h) AS effective_n, avg(top) AS mean_max_weight FROM (SELECT strategy, date, sum(post * post) AS h, max(post) AS top FROM path GROUP BY ALL) GROUP BY strategy", "effective_n mean_max_weight", base=WITH)
def _(spark, d):
    return accounting.concentration(simulated(spark, d)[0])


@query("weight_validation", "SELECT strategy, date, CAST(sum(CAST(abs(w - 0.6) < 1e-6 AS INT)) AS BIGINT) AS at_cap, greatest(abs(sum(w) - 1), max(-w), max(w - 0.6), 0.0)::DOUBLE AS violation, greatest(abs(sum(w) - 1), max(-w), max(w - 0.6), 0.0) <= 1e-8 AS clean FROM tg WHERE w IS NOT NULL GROUP BY ALL", "violation", base=WITH)
def _(spark, d):
    return accounting.validate_weights(targets(spark, d).filter("weight is not null"), CAP)


@query("cap_decomposition", """SELECT a.strategy, z.sharpe - a.sharpe AS cost_effect, a.sharpe AS sharpe_10bps FROM perf a JOIN perf z ON z.strategy = a.strategy AND z.cost_bps = 0 WHERE a.cost_bps = 10""", "cost_effect sharpe_10bps", 5, WITH)
def _(spark, d):
    p = performance(spark, d)
    zero = p.filter("cost_bps = 0").select("strategy", F.col("sharpe").alias("free"))
    return p.filter("cost_bps = 10").join(zero, "strategy").select("strategy", (F.col("free") - F.col("sharpe")).alias("cost_effect"), F.col("sharpe").alias("sharpe_10bps"))


@query("subperiod_performance", """SELECT period, strategy, count(*) AS n, stddev_samp(net_return) * sqrt(252) AS ann_vol, avg(net_return) / stddev_samp(net_return) * sqrt(252) AS sharpe FROM net JOIN (VALUES ('early', DATE '1992-01-01', DATE '1994-12-31'), ('middle', DATE '1994-01-01', DATE '1996-12-31'), ('late', DATE '1997-01-01', DATE '1999-12-31')) v(period, start, stop) ON date BETWEEN start AND stop WHERE cost_bps = 10 GROUP BY ALL HAVING count(*) >= 60""", "ann_vol sharpe", 5, WITH)
def _(spark, d):
    periods = spark.createDataFrame(core.PERIODS, "period string, start string, stop string").selectExpr("period", "cast(start as date) start", "cast(stop as date) stop")
    rows = net(spark, d).filter("cost_bps = 10").join(F.broadcast(periods), F.col("date").between(F.col("start"), F.col("stop")))
    return rows.groupBy("period", "strategy").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("net_return") * 252**0.5).alias("ann_vol"), (F.avg("net_return") / F.stddev_samp("net_return") * 252**0.5).alias("sharpe")).filter("n >= 60")


# -- inference ------------------------------------------------------------------------------------------

#: Replicates and mean block of the bootstrap over the whole series, as in the plan of the study.
DRAWS, BLOCK = 10_000, 21
U = "CAST('0x' || substr(md5('12345-' || {rep} || '-' || {pos} || '-{stream}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
PAIR = """, ab AS (SELECT date, max(CASE WHEN strategy = 'equal_weight' THEN net_return - rf END) AS a, max(CASE WHEN strategy = 'sixty_forty' THEN net_return - rf END) AS b,
  max(CASE WHEN strategy = 'equal_weight' THEN net_return END) AS na, max(CASE WHEN strategy = 'sixty_forty' THEN net_return END) AS nb FROM net JOIN rf USING (date) WHERE cost_bps = 10 GROUP BY date),
src AS MATERIALIZED (SELECT a, b, na, nb, row_number() OVER (ORDER BY date) - 1 AS src, count(*) OVER () AS n FROM ab)"""
IX = f"""b0 AS MATERIALIZED (SELECT rep, src AS pos, n, src = 0 OR {U.format(rep="rep", pos="src", stream="new")} < 1.0 / 21 AS fresh, CAST(floor({U.format(rep="rep", pos="src", stream="at")} * n) AS BIGINT) AS target FROM range({DRAWS}) r(rep), src),
b1 AS (SELECT rep, pos, n, max(CASE WHEN fresh THEN pos END) OVER w AS began, arg_max(target, CASE WHEN fresh THEN pos END) OVER w AS target FROM b0 WINDOW w AS (PARTITION BY rep ORDER BY pos)),
ix AS (SELECT rep, pos, (target + pos - began) % n AS src FROM b1)"""


def _spread(order: str, keys: str, source: str) -> str:
    """Differences of the six metrics, by keys, of rows a, b, na, nb in order."""
    one = f"SELECT {keys}, a, b, na, nb, exp(sum(ln(1 + na)) OVER w) AS wa, exp(sum(ln(1 + nb)) OVER w) AS wb, {order} AS step FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})"
    two = f"SELECT *, wa / max(wa) OVER w - 1 AS da, wb / max(wb) OVER w - 1 AS db FROM ({one}) WINDOW w AS (PARTITION BY {keys} ORDER BY step)"
    of = lambda x, n, dd: {"sharpe": f"avg({x}) / stddev_samp({x}) * sqrt(252)", "sortino": f"avg({x}) / sqrt(avg(pow(least({x}, 0), 2))) * sqrt(252)", "ann_vol": f"stddev_samp({n}) * sqrt(252)", "cagr": f"exp(sum(ln(1 + {n})) * 252 / count(*)) - 1", "max_drawdown": f"min({dd})", "calmar": f"(exp(sum(ln(1 + {n})) * 252 / count(*)) - 1) / abs(min({dd}))"}
    a, b = of("a", "na", "da"), of("b", "nb", "db")
    return f"SELECT {keys}, {', '.join(f'{b[m]} - ({a[m]}) AS {m}' for m in a)} FROM ({two}) GROUP BY {keys}"


LONG = "ON sharpe, sortino, ann_vol, cagr, max_drawdown, calmar INTO NAME metric VALUE"
BOOT = f"""{PAIR}, {IX},
dr AS (UNPIVOT ({_spread("pos", "rep", "ix JOIN src USING (src)")}) {LONG} value),
ob AS (UNPIVOT ({_spread("src", "n", "src")}) {LONG} observed),
nl AS (SELECT metric, value, value - avg(value) OVER (PARTITION BY metric) AS c, observed FROM dr JOIN ob USING (metric))"""


@query("bootstrap_indices", "SELECT rep, count(*) AS n, CAST(sum(src) AS BIGINT) AS total, CAST(sum(pos * src) AS BIGINT) AS weighted, count(DISTINCT src) AS days FROM ix GROUP BY rep", base=WITH + PAIR + ", " + IX)
def _(spark, d):
    """A digest of each replicate's indices."""
    ix = inference.indices(spark, paired(spark, d).count(), BLOCK, DRAWS)
    return ix.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("total"), F.sum(F.col("pos") * F.col("src")).alias("weighted"), F.count_distinct("src").alias("days"))


def drawn(spark, d) -> tuple[DataFrame, DataFrame]:
    """The paired series and its draws."""
    p = durable.keep(paired(spark, d))
    return p, inference.draws(p, BLOCK, DRAWS, p.count())


@query("bootstrap_draws", "SELECT rep, metric, value FROM dr", "value", 5, WITH + BOOT)
def _(spark, d):
    return drawn(spark, d)[1]


@query("bootstrap_intervals", """SELECT metric, any_value(observed) AS observed, count(*) AS n_draws, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, avg(CAST(c >= observed AS INT)) AS p_greater, avg(CAST(c <= observed AS INT)) AS p_less, avg(CAST(abs(c) >= abs(observed) AS INT)) AS p_two_sided FROM nl GROUP BY metric""", "observed ci_low ci_high p_greater p_less p_two_sided", 5, WITH + BOOT)
def _(spark, d):
    p, draws = drawn(spark, d)
    return inference.intervals(durable.keep(draws), inference.observed(p))


def sharpe_rows(tests: DataFrame, role: str) -> DataFrame:
    return tests.select(F.lit(role).alias("role"), "comparison", "observed", "bootstrap_sd", "ci_low", "ci_high", F.col("p_greater").alias("p_one_sided"))


@query("block_sensitivity")
def _(spark, d):
    """The Sharpe difference by mean block length; 21 days is the primary one."""
    p = durable.keep(paired(spark, d).select(F.lit("sixty_forty minus equal_weight").alias("comparison"), "date", "a", "b"))
    out, n = None, p.count()
    for block in (21, 10, 42, 63):
        rows = sharpe_rows(inference.sharpe_tests(p, block, DRAWS, n, durable.keep), "primary" if block == 21 else "sensitivity").withColumn("mean_block_days", F.lit(block))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("comparison_family")
def _(spark, d):
    """The secondary family: every other strategy against the rolling comparator at the main cost, and the regime strategy against it at the other costs, Holm-adjusted."""
    n = durable.keep(ladder_net(spark, d, COSTS)).join(rf(spark, d), "date").select("strategy", "cost_bps", "date", (F.col("net_return") - F.col("rf")).alias("x"))
    base = n.filter("strategy = 'rolling_lw'").select("cost_bps", "date", F.col("x").alias("a"))
    wanted = ((F.col("cost_bps") == 10) & F.col("strategy").isin("ewma_scaled", "static_min_variance", "equal_weight", "sixty_forty")) | ((F.col("cost_bps") != 10) & (F.col("strategy") == "regime_aware"))
    name = F.concat("strategy", F.lit(" minus rolling_lw @"), F.col("cost_bps").cast("int").cast("string"))
    series = durable.keep(n.filter(wanted).join(base, ["cost_bps", "date"]).select(name.alias("comparison"), "date", "a", F.col("x").alias("b")))
    rows = sharpe_rows(inference.sharpe_tests(series, BLOCK, DRAWS, series.select("date").distinct().count(), durable.keep), "secondary")
    return risk.holm(rows.withColumnRenamed("comparison", "test"), "p_one_sided", "role").withColumnRenamed("test", "comparison")


def hac_sql(lags: int) -> str:
    """A CTE hac_<lags> of the mean net difference."""
    steps = range(1, lags + 1)
    return f""", e1_{lags} AS (SELECT date, nb - na - avg(nb - na) OVER () AS e, avg(nb - na) OVER () AS mean, count(*) OVER () AS n FROM ab),
e2_{lags} AS (SELECT *, {", ".join(f"lag(e, {j}) OVER (ORDER BY date) AS l{j}" for j in steps)} FROM e1_{lags}),
hac_{lags} AS (SELECT {lags}::BIGINT AS lags, mean, n, sqrt(sum(e * e) + {" + ".join(f"{2 * (1 - j / (lags + 1))} * coalesce(sum(e * l{j}), 0)" for j in steps)}) / n AS se FROM e2_{lags} GROUP BY mean, n)"""


LAGS = (21, 5, 42)
HAC_ROWS = " UNION ALL ".join(f"FROM hac_{lags}" for lags in LAGS)


@query("hac_mean_diff", f"SELECT 'b-a' AS pair, lags, n, mean * 252 AS annual_mean, se * 252 AS annual_se, (mean - 1.959963984540054 * se) * 252 AS ci_low, (mean + 1.959963984540054 * se) * 252 AS ci_high, mean / se AS z, {core.normal_p_sql('mean / se')} AS p_two_sided FROM ({HAC_ROWS})", "annual_mean annual_se ci_low ci_high z p_two_sided", 5, WITH + PAIR + "".join(map(hac_sql, LAGS)))
def _(spark, d):
    """On net returns, with the primary lags and two others."""
    p = durable.keep(paired(spark, d))
    first, *rest = (inference.hac_difference(p, lags) for lags in LAGS)
    for rows in rest:
        first = first.unionByName(rows)
    return first


# -- kernels: fits and optimised weights -----------------------------------------------------------------


def market_features(spark, d) -> DataFrame:
    market = core.panel(spark, d).filter("asset = 'A'").select("date", "price")
    wide = core.macro_filled(spark, d).groupBy("date").pivot("series_id", ["1", "2", "3"]).agg(F.first("value"))
    return regimes.features(market, wide.select("date", F.col("1").alias("vix"), F.col("2").alias("long_rate"), F.col("3").alias("short_rate")))


FEAT = """, m0 AS (SELECT date, ln(price) - ln(lag(price) OVER (ORDER BY date)) AS mkt_log_return FROM panel WHERE asset = 'A'),
m1 AS (SELECT date, mkt_log_return, CASE WHEN count(mkt_log_return) OVER w = 21 THEN stddev_samp(mkt_log_return) OVER w END AS realized_vol_21d FROM m0 WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)),
x0 AS (SELECT date, max(value) FILTER (series_id = '1') AS vix, max(value) FILTER (series_id = '2') - max(value) FILTER (series_id = '3') AS slope FROM filled GROUP BY date),
x1 AS (SELECT date, lag(ln(vix)) OVER (ORDER BY date) AS log_vix_lag1, lag(slope) OVER (ORDER BY date) AS yield_slope_lag1 FROM x0),
feat AS (SELECT date, mkt_log_return, realized_vol_21d, log_vix_lag1, yield_slope_lag1 FROM m1 JOIN x1 USING (date) WHERE mkt_log_return IS NOT NULL AND realized_vol_21d IS NOT NULL AND log_vix_lag1 IS NOT NULL AND yield_slope_lag1 IS NOT NULL)"""
NAMES = "mkt_log_return realized_vol_21d log_vix_lag1 yield_slope_lag1"


def origins(spark, d) -> DataFrame:
    """Every month end."""
    return core.ends(spark, d)


@query("hmm_features", "SELECT * FROM feat", NAMES, 10, base=BASE.rstrip() + FEAT)
def _(spark, d):
    return market_features(spark, d)


@query("expanding_zscore", "SELECT e.date AS origin, count(*) AS n_obs, " + ", ".join(f"(arg_max({n}, f.date) - avg({n})) / stddev_samp({n}) AS {n}" for n in NAMES.split()) + " FROM ends e JOIN feat f ON f.date <= e.date GROUP BY e.date", NAMES, 5, BASE.rstrip() + FEAT)
def _(spark, d):
    return regimes.expanding_scores(core.ends(spark, d), market_features(spark, d))


@query("threshold_rule", "SELECT date, median, realized_vol_21d > median AS high FROM (SELECT date, realized_vol_21d, median(realized_vol_21d) OVER (ORDER BY date) AS median, count(*) OVER (ORDER BY date) AS k FROM feat) WHERE k >= 252", "median", base=BASE.rstrip() + FEAT)
def _(spark, d):
    return regimes.threshold_rule(market_features(spark, d))


@query("cohens_kappa", """SELECT n, agreement, (agreement - chance) / (1 - chance) AS kappa FROM (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS agreement, avg(CAST(a AS INT)) * avg(CAST(b AS INT)) + (1 - avg(CAST(a AS INT))) * (1 - avg(CAST(b AS INT))) AS chance FROM (SELECT realized_vol_21d > median(realized_vol_21d) OVER (ORDER BY date) AS a, abs(mkt_log_return) > median(abs(mkt_log_return)) OVER (ORDER BY date) AS b, count(*) OVER (ORDER BY date) AS k FROM feat) WHERE k >= 252)""", "agreement kappa", base=BASE.rstrip() + FEAT)
def _(spark, d):
    f = market_features(spark, d).withColumn("size", F.abs("mkt_log_return"))
    a = regimes.threshold_rule(f).select("date", F.col("high").alias("a"))
    return describe.kappa(a.join(regimes.threshold_rule(f, "size").select("date", F.col("high").alias("b")), "date"), "a", "b")


@query("classification_agreement", """SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS agreement, corr(x, y) AS probability_correlation FROM (SELECT realized_vol_21d AS x, abs(mkt_log_return) AS y, realized_vol_21d > median(realized_vol_21d) OVER (ORDER BY date) AS a, abs(mkt_log_return) > median(abs(mkt_log_return)) OVER (ORDER BY date) AS b, count(*) OVER (ORDER BY date) AS k FROM feat) WHERE k >= 252""", "agreement probability_correlation", base=BASE.rstrip() + FEAT)
def _(spark, d):
    f = market_features(spark, d).withColumn("size", F.abs("mkt_log_return"))
    a = regimes.threshold_rule(f).join(f.select("date", F.col("realized_vol_21d").alias("p")), "date")
    b = regimes.threshold_rule(f, "size").join(f.select("date", F.col("size").alias("p")), "date")
    return describe.agreement(a, b, "high", "p")


FLAGS = "SELECT DISTINCT l_returnflag = 'R' AS absorbing, l_linestatus = 'O' AS degenerate, l_discount > 0.05 AS singular FROM lineitem"


@query("a2_routing", f"SELECT *, concat_ws(';', CASE WHEN absorbing THEN 'absorbing_state' END, CASE WHEN degenerate THEN 'degenerate_occupancy' END, CASE WHEN singular THEN 'singular_covariance' END) AS fallback_reason, absorbing OR degenerate OR singular AS fallback_used FROM ({FLAGS})", base="")
def _(spark, d):
    line = panels.landed(spark, d, "lineitem")
    return regimes.routing(line.select((F.col("l_returnflag") == "R").alias("absorbing"), (F.col("l_linestatus") == "O").alias("degenerate"), (F.col("l_discount") > 0.05).alias("singular")).distinct())


@query("hmm_fit")
def _(spark, d):
    return regimes.fit_starts(origins(spark, d), market_features(spark, d), seeds=SEEDS)


#: Starts of an order: likelihoods in steps, so that several reach the best.
STARTS = "SELECT l_orderkey AS origin, CAST(l_linenumber AS BIGINT) AS seed, -floor(l_quantity / 10) AS loglik, l_linestatus = 'O' OR l_returnflag = 'N' AS converged FROM lineitem"


@query("hmm_select", f"SELECT origin, seed, loglik, converged, within_tol, within_tol AND seed = min(seed) FILTER (within_tol) OVER (PARTITION BY origin) AS selected FROM (SELECT *, coalesce(converged AND loglik >= best - 1e-10 * greatest(1, abs(best)), false) AS within_tol FROM (SELECT *, max(loglik) FILTER (converged) OVER (PARTITION BY origin) AS best FROM ({STARTS})))", "loglik", base="")
def _(spark, d):
    starts = panels.landed(spark, d, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_linenumber").cast("long").alias("seed"), (-F.floor(F.col("l_quantity") / 10)).cast("double").alias("loglik"), ((F.col("l_linestatus") == "O") | (F.col("l_returnflag") == "N")).alias("converged"))
    return regimes.select_starts(starts)


@query("regime_states")
def _(spark, d):
    return regimes.monthly_changes(regimes.fit_states(origins(spark, d), market_features(spark, d), seeds=SEEDS))


@query("regime_revisions")
def _(spark, d):
    """Paths and parameters against those of the origin before."""
    o, f = origins(spark, d), durable.keep(market_features(spark, d))
    paths = regimes.revisions(durable.keep(regimes.state_paths(o, f, seeds=SEEDS)))
    return paths.join(regimes.parameter_revisions(durable.keep(regimes.fit_states(o, f, seeds=SEEDS))), "origin")


@query("regime_transitions")
def _(spark, d):
    return regimes.transitions(regimes.fit_states(origins(spark, d), market_features(spark, d), seeds=SEEDS))


@query("expost_smoothed")
def _(spark, d):
    last = market_features(spark, d).agg(F.max("date").alias("date"))
    return regimes.state_paths(last, market_features(spark, d), seeds=SEEDS).select("date", "smoothed", F.lit(True).alias("is_expost_smoothed"))


@query("hmm_ablation")
def _(spark, d):
    names = tuple(n for n in regimes.FEATURES if n != "log_vix_lag1")
    return regimes.fit_states(origins(spark, d), market_features(spark, d), names, seeds=SEEDS).select("origin", "n_obs", "selected_seed", "p_high", "fallback_used")


def garch(spark, d) -> DataFrame:
    r, o = core.returns(spark, d), origins(spark, d)
    return regimes.garch_forecasts(o, r, risk.realized(o, r))


@query("garch_forecast")
def _(spark, d):
    return garch(spark, d)


@query("vol_forecasts_garch")
def _(spark, d):
    return risk.forecasts(origins(spark, d), core.returns(spark, d), garch(spark, d))


@query("condition_numbers")
def _(spark, d):
    return portfolio.conditioning(portfolio.origin_covariances(core.ends(spark, d), core.returns(spark, d)), "origin")


@query("psd_gate")
def _(spark, d):
    return portfolio.psd_gate(portfolio.origin_covariances(core.ends(spark, d), core.returns(spark, d)), "origin")


@query("matrix_fingerprint")
def _(spark, d):
    return portfolio.fingerprint(portfolio.origin_covariances(core.ends(spark, d), core.returns(spark, d)), "origin")


@query("origin_covariances", """SELECT origin, asset_i, asset_j, (1 - rho) * s + CASE WHEN asset_i = asset_j THEN rho * mu ELSE 0 END AS covariance FROM oe JOIN (SELECT origin, mu, least((ff - ss) / (p * n), (ss - p * mu * mu) / p) / ((ss - p * mu * mu) / p) AS rho FROM (SELECT origin, sum(s) FILTER (asset_i = asset_j) / sqrt(count(*)) AS mu, sqrt(count(*)) AS p, sum(s * s) AS ss, sum(f) AS ff, max(n) AS n FROM oe GROUP BY origin)) USING (origin)""", "covariance", 9,
       BASE.rstrip() + ", ow AS (SELECT e.date AS origin, r.asset, r.date, r.r - avg(r.r) OVER (PARTITION BY e.date, r.asset) AS c FROM ends e JOIN ret r ON r.date <= e.date), oe AS (SELECT a.origin, a.asset AS asset_i, b.asset AS asset_j, avg(a.c * b.c) AS s, avg(a.c * a.c * b.c * b.c) AS f, count(*) AS n FROM ow a JOIN ow b USING (origin, date) GROUP BY ALL)")
def _(spark, d):
    return portfolio.origin_covariances(core.ends(spark, d), core.returns(spark, d))


def matrices(spark, d) -> DataFrame:
    """The covariance panel: sixteen starts at every month end, landed once for all that starts from it."""
    return durable.once(spark, ("covariances", d), lambda: portfolio.covariance_panel(durable.keep(origins(spark, d)), durable.keep(market_features(spark, d)), core.returns(spark, d), seeds=SEEDS))


def ladder(spark, d) -> DataFrame:
    return portfolio.ladder(matrices(spark, d), core.returns(spark, d), CAP)


def executed(spark, d, signals: DataFrame) -> DataFrame:
    """Signals as targets on their execution days."""
    ex = align.execution_dates(origins(spark, d).select("date"), align.trading_days(core.panel(spark, d)))
    return signals.join(ex, signals["date"] == ex["signal_date"]).select("strategy", F.col("execution_date").alias("date"), "asset", "weight")


def ladder_net(spark, d, costs: tuple[float, ...]) -> DataFrame:
    """Net returns of the six strategies."""
    return accounting.net_returns(accounting.simulate(core.returns(spark, d, "simple"), durable.keep(executed(spark, d, ladder(spark, d))))[1], costs)


@query("covariance_audit")
def _(spark, d):
    return portfolio.covariance_audit(matrices(spark, d))


@query("optimizer_audit")
def _(spark, d):
    m = matrices(spark, d)
    return portfolio.optimizer_audit(m, ladder(spark, d), CAP)


@query("optimizer_summary")
def _(spark, d):
    m = matrices(spark, d)
    return portfolio.optimizer_summary(portfolio.optimizer_audit(m, ladder(spark, d), CAP))


@query("ladder_performance")
def _(spark, d):
    """The six strategies at every cost."""
    return accounting.performance(durable.keep(ladder_net(spark, d, COSTS)), rf(spark, d), "strategy", "cost_bps")


@query("min_variance")
def _(spark, d):
    return portfolio.min_variance(portfolio.origin_covariances(core.ends(spark, d), core.returns(spark, d)), CAP, "origin")


@query("strategy_ladder")
def _(spark, d):
    return ladder(spark, d)


def grid_net(spark, d) -> DataFrame:
    """specification, strategy and net returns at 10 basis points of the grid's regime and comparison legs; fits are made once and landed."""

    def make() -> DataFrame:
        o, rows = durable.keep(origins(spark, d)), durable.keep(market_features(spark, d))
        signals = portfolio.grid(o, rows, core.returns(spark, d)).select(F.concat_ws("@", "strategy", "specification").alias("strategy"), "date", "asset", "weight")
        events = accounting.simulate(core.returns(spark, d, "simple"), durable.keep(executed(spark, d, durable.keep(signals))))[1]
        at = F.split("strategy", "@")
        return accounting.net_returns(events, (10.0,)).withColumns({"specification": at[1], "strategy": at[0]})

    return durable.once(spark, ("grid", d), make)


@query("robustness_grid")
def _(spark, d):
    """Performance of both legs of thirteen specifications."""
    n = grid_net(spark, d)
    return accounting.performance(n, rf(spark, d), "specification", "strategy")


def grid_tests(spark, d) -> DataFrame:
    n = grid_net(spark, d).join(rf(spark, d), "date").withColumn("x", F.col("net_return") - F.col("rf"))
    own = lambda name: F.max(F.when(F.col("strategy") == name, F.col("x")))
    series = durable.keep(n.groupBy(F.col("specification").alias("comparison"), "date").agg(own("window_lw").alias("a"), own("regime_mixture").alias("b")))
    days = series.groupBy("comparison").count()
    tests = inference.sharpe_tests(series, BLOCK, DRAWS, series.select("date").distinct().count(), durable.keep)
    rows = sharpe_rows(tests, "robustness").join(days.withColumnRenamed("count", "n_evaluation_days"), "comparison")
    return portfolio.grid_family(rows)


@query("grid_tests")
def _(spark, d):
    """Sharpe differences of the grid on shared resampled days, and the Holm family without the primary."""
    return grid_tests(spark, d)


@query("robustness_forest")
def _(spark, d):
    """The grid's differences and intervals in declared order."""
    order = {s.name: i for i, s in enumerate(portfolio.GRID)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return grid_tests(spark, d).select(rank[F.col("specification")].alias("ordinal"), "specification", "observed", "ci_low", "ci_high")


@query("hmm_summary")
def _(spark, d):
    """Health of the primary fits: fallbacks by kind, least occupancy, and means by state."""
    return regimes.summary(regimes.fit_states(origins(spark, d), market_features(spark, d), seeds=SEEDS))


@query("closing_checks")
def _(spark, d):
    """Checks that must all hold before results are published."""
    return portfolio.closing_checks(durable.keep(grid_tests(spark, d)), grid_net(spark, d))


# -- reports, text, streams ---------------------------------------------------------------------------------


@query("display_table", """SELECT strategy, cost_bps, metric, raw_value, raw_value * CASE WHEN metric = 'sharpe' THEN 1 ELSE 100 END AS display_value, CASE WHEN metric = 'sharpe' THEN 'ratio' ELSE 'percent' END AS display_unit, CASE metric WHEN 'sharpe' THEN 'Sharpe ratio' WHEN 'ann_vol' THEN 'Annualised volatility' ELSE 'Maximum drawdown' END AS label FROM (UNPIVOT (SELECT strategy, cost_bps, ann_vol, sharpe, max_drawdown FROM perf) ON ann_vol, sharpe, max_drawdown INTO NAME metric VALUE raw_value)""", "cost_bps raw_value display_value", 4, WITH)
def _(spark, d):
    long = reports.long_metrics(performance(spark, d), ["strategy", "cost_bps"], ["ann_vol", "sharpe", "max_drawdown"])
    return reports.display_table(long).drop("formatted")


@query("unit_check", "SELECT 0::BIGINT AS breaches", base="")
def _(spark, d):
    long = reports.long_metrics(performance(spark, d), ["strategy", "cost_bps"], list(reports.METRICS))
    return reports.unit_breaches(reports.display_table(long)).agg(F.count(F.lit(1)).alias("breaches"))


@query("unit_conversions", "SELECT DISTINCT l_discount, l_discount * 100.0 AS pct, l_discount * 10000.0 AS bps, l_discount / 10000.0 AS from_bps, l_discount / 0.2 AS sharpe_impact FROM lineitem", "l_discount pct bps from_bps sharpe_impact", 9, "")
def _(spark, d):
    x = F.col("l_discount")
    return panels.landed(spark, d, "lineitem").select(x, C.to_unit(x, "percent").alias("pct"), C.to_unit(x, "bps").alias("bps"), C.from_bps(x).alias("from_bps"), C.sharpe_impact(x, F.lit(0.2)).alias("sharpe_impact")).distinct()


@query("tex_escape", r"SELECT p_partkey, p_type, replace(replace(replace(replace(p_brand || '_' || p_type || ' 5%', '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_') AS escaped FROM part", base="")
def _(spark, d):
    return panels.landed(spark, d, "part").select("p_partkey", "p_type", C.tex_escape(F.concat("p_brand", F.lit("_"), "p_type", F.lit(" 5%"))).alias("escaped"))


_DIGITS = "Zero One Two Three Four Five Six Seven Eight Nine".split()
SPELT = "replace(" * 10 + "p_type || '_' || p_size" + "".join(f", '{i}', '_{w}_')" for i, w in enumerate(_DIGITS))


@query("macro_names", f"SELECT k, array_to_string(list_transform(parts, lambda p, i: CASE WHEN i = 1 THEN lower(p) ELSE upper(p[1]) || p[2:] END), '') AS name FROM (SELECT DISTINCT p_type || '_' || p_size AS k, list_filter(regexp_split_to_array({SPELT}, '[^A-Za-z]+'), lambda p: p <> '') AS parts FROM part)", base="")
def _(spark, d):
    keys = panels.landed(spark, d, "part").select(F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("k")).distinct()
    return keys.select("k", C.macro_name(F.col("k")).alias("name"))


@query("label_antijoin", "SELECT DISTINCT p_brand AS label FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 10)", base="")
def _(spark, d):
    part = panels.landed(spark, d, "part").withColumnRenamed("p_brand", "label")
    return reports.unknown(part, "label", part.filter("p_size > 10"))


@query("numeric_literals", r"SELECT replace(l, ',', '') AS literal, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?')) AS l FROM documents) GROUP BY 1", base="")
def _(spark, d):
    return reports.numeric_literals(panels.landed(spark, d, "documents"))


@query("pii_scan", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(len(regexp_extract_all(text, '{q}')) AS BIGINT) AS found FROM documents WHERE regexp_matches(text, '{q}')" for k, q in ((k, p.replace("'", "''")) for k, p in C.PERSONAL.items())), base="")
def _(spark, d):
    return reports.scan_text(panels.landed(spark, d, "documents"))


@query("inventory_gate", "SELECT 'blank_fields' AS gate, CAST(sum(CAST(p_name IS NULL OR trim(p_name) = '' OR p_type IS NULL OR trim(p_type) = '' AS INT)) AS BIGINT) AS n FROM part UNION ALL SELECT 'repeated_keys', CAST(count(*) AS BIGINT) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1)", base="")
def _(spark, d):
    return reports.inventory(panels.landed(spark, d, "part"), "p_brand", ["p_name", "p_type"])


@query("forecast_chart", "SELECT asset, date, max(CASE WHEN model = 'hist63' THEN sqrt(forecast_ivar / horizon_days * 252) * 100 END) AS hist63, max(CASE WHEN model = 'ewma' THEN sqrt(forecast_ivar / horizon_days * 252) * 100 END) AS ewma, max(sqrt(realized_ivar / horizon_days * 252) * 100) AS realized FROM fc GROUP BY ALL", "hist63 ewma realized")
def _(spark, d):
    fc = risk.forecasts(core.ends(spark, d), core.returns(spark, d))
    vol = lambda c: F.sqrt(F.col(c) / F.col("horizon_days") * 252) * 100
    wide = fc.groupBy("asset", "date").agg(*[F.max(F.when(F.col("model") == m, vol("forecast_ivar"))).alias(m) for m in ("hist63", "ewma")], F.max(vol("realized_ivar")).alias("realized"))
    return wide.select("asset", "date", "hist63", "ewma", "realized")


@query("conditioning_summary")
def _(spark, d):
    """By estimator."""
    return portfolio.conditioning_summary(matrices(spark, d))


@query("state_characteristics", "SELECT realized_vol_21d > m AS high, count(*) AS n, avg(mkt_log_return) AS mean_return, stddev_samp(mkt_log_return) AS std_return, avg(log_vix_lag1) AS mean_log_vix FROM feat, (SELECT quantile_cont(realized_vol_21d, 0.5) AS m FROM feat) GROUP BY ALL", "mean_return std_return mean_log_vix", base=BASE.rstrip() + FEAT)
def _(spark, d):
    f = market_features(spark, d)
    middle = f.agg(F.percentile("realized_vol_21d", 0.5).alias("m"))
    rows = f.join(F.broadcast(middle)).groupBy((F.col("realized_vol_21d") > F.col("m")).alias("high"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("mkt_log_return").alias("mean_return"), F.stddev_samp("mkt_log_return").alias("std_return"), F.avg("log_vix_lag1").alias("mean_log_vix"))


@query("citation_gate", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)", base="")
def _(spark, d):
    cited = panels.landed(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))
    return reports.unknown(cited, "key", panels.landed(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("key")))


@query("bibliography", "SELECT * FROM (VALUES ('k1', 'article', 'a big title', ['doe', 'roe'], '2001'), ('k2', 'book', 'other', ['poe'], '1999')) v(\"key\", kind, title, surnames, year)", base="")
def _(spark, d):
    text = "@article{k1,\n  title = {A {B}ig Title},\n  author = {Doe, Jane and Roe, R.},\n  year = {2001}\n}\n@Book{k2,\n  title = {Other},\n  author = {Poe, E.},\n  year = {1999}\n}"
    return reports.bibliography(spark.createDataFrame([(text,)], "text string"))


@query("event_windows", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL", "total", 4, "")
def _(spark, d):
    return streams.event_windows(panels.landed(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("event_props", "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS greatest, count(DISTINCT k) AS kinds FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type", base="")
def _(spark, d):
    """A field of the events' JSON."""
    rows = panels.landed(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("greatest"), F.count_distinct("k").alias("kinds"))


@query("vix_scatter", "SELECT date, exp(log_vix_lag1) AS vix, realized_vol_21d * sqrt(252) * 100 AS realized_pct, corr(exp(log_vix_lag1), realized_vol_21d * sqrt(252) * 100) OVER () AS level_correlation FROM feat", "vix realized_pct level_correlation", 2, base=BASE.rstrip() + FEAT)
def _(spark, d):
    """The volatility index against realised volatility in percent, with their correlation."""
    rows = market_features(spark, d).select("date", F.exp("log_vix_lag1").alias("vix"), (F.col("realized_vol_21d") * 252**0.5 * 100).alias("realized_pct"))
    return rows.withColumn("level_correlation", F.corr("vix", "realized_pct").over(Window.partitionBy()))


@query("user_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CAST(coalesce(ts - before >= INTERVAL 30 MINUTE, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s", base="")
def _(spark, d):
    return streams.sessions(panels.landed(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
