"""The query catalogue: each operator on the provided tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions.mathx import normal_quantile
from riskloom.operators import calibration, eda, ranking, selection, splits, stability, vintage
from riskloom.sources.tables import CONTRACTS_TX_SQL, NUMERIC, OBSERVATIONS_SQL, contracts_tx, observations, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OBS, CTX = f"WITH {OBSERVATIONS_SQL}", f"WITH {CONTRACTS_TX_SQL}"
PROCESSED = "2002-01-01"
ROLES = {"client": "client_id", "days": "tx_days", "amount": "amount", "balance": "balance", "retro": "retro_dt", "step": 7, "horizon": 365, "processed": PROCESSED}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **casts: str) -> DataFrame:
    """Doubles rounded for comparison; named columns cast."""
    kinds = dict(df.dtypes)
    out = [F.col(c).cast(casts[c]).alias(c) if c in casts else F.round(F.col(c), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(*out)


# --- vintages ---------------------------------------------------------------------------------


def _vintage_sql(group: str | None, own: bool) -> str:
    g, gk = ("sample", "sample, ") if group else ("'all'", "")
    named = f"t AS (SELECT *, coalesce(CAST({group} AS VARCHAR), 'NA') AS sample FROM contracts_tx)" if group else "t AS (SELECT * FROM contracts_tx)"
    by = "GROUP BY sample" if own else ""
    key = "sample, " if own else ""
    on = "USING (sample)" if own else "ON TRUE"
    frame = f"SELECT {key}n_total, total_balance, h FROM base JOIN hz {on}" if own else ("SELECT s.sample, n_total, total_balance, h FROM (SELECT DISTINCT sample FROM t WHERE tx_days IS NOT NULL AND amount IS NOT NULL) s CROSS JOIN base CROSS JOIN hz" if group else "SELECT n_total, total_balance, h FROM base CROSS JOIN hz")
    match = "g.sample = d.sample AND " if group else ""
    match2 = "g.sample = f.sample AND " if group else ""
    part = "PARTITION BY g.sample " if group else ""
    gs = "g.sample" if group else "'all'"
    return f"""{CTX}, {named},
hz AS (SELECT {key}greatest(0, least(365, date_diff('day', CAST(max(retro_dt) AS DATE), DATE '{PROCESSED}'))) AS h FROM t {by}),
clients AS (SELECT {key}client_id, coalesce(min(balance), 0) AS b FROM t WHERE client_id IS NOT NULL GROUP BY {key}client_id),
base AS (SELECT {key}count(*) AS n_total, sum(b) AS total_balance FROM clients {by}),
frame AS ({frame}),
g AS (SELECT *, CAST(unnest(range(0, h + 1, 7)) AS BIGINT) AS day FROM frame),
ev AS (SELECT t.*, tx_days - tx_days % 7 AS day FROM t JOIN hz {"USING (sample)" if own else "ON TRUE"} WHERE tx_days IS NOT NULL AND amount IS NOT NULL AND tx_days >= 0 AND tx_days <= h),
d AS (SELECT {gk}day, count(*) AS c, sum(amount) AS s FROM ev GROUP BY {gk}day),
f AS (SELECT {gk}day, count(client_id) AS k FROM (SELECT {gk}client_id, min(day) AS day FROM ev GROUP BY {gk}client_id) GROUP BY {gk}day),
cum AS (SELECT {gs} AS sample, g.day AS day, n_total, total_balance, sum(coalesce(c, 0)) OVER w AS cc, sum(coalesce(s, 0)) OVER w AS cs, sum(coalesce(k, 0)) OVER w AS ck
 FROM g LEFT JOIN d ON {match}g.day = d.day LEFT JOIN f ON {match2}g.day = f.day WINDOW w AS ({part}ORDER BY g.day))
SELECT sample, day, CAST(n_total AS BIGINT) AS n_total, round(total_balance, 3) AS total_balance, CAST(cc AS BIGINT) AS cum_tx_cnt, round(cs, 3) AS cum_tx_sum, CAST(ck AS BIGINT) AS cum_clients_with_tx,
 round(CASE WHEN total_balance > 0 THEN cs / total_balance ELSE 0 END, 9) AS cum_share_of_balance, round(CASE WHEN n_total > 0 THEN CAST(ck AS DOUBLE) / n_total ELSE 0 END, 9) AS cum_share_clients FROM cum"""


def _curves(df: DataFrame) -> DataFrame:
    r = lambda c, k: F.round(F.col(c).cast("double"), k).alias(c)
    return df.select("sample", "day", F.col("n_total").cast("long").alias("n_total"), r("total_balance", 3), F.col("cum_tx_cnt").cast("long").alias("cum_tx_cnt"), r("cum_tx_sum", 3), F.col("cum_clients_with_tx").cast("long").alias("cum_clients_with_tx"), r("cum_share_of_balance", 9), r("cum_share_clients", 9))


@query(_vintage_sql(None, False))
def vintage_total(spark, d):
    return _curves(vintage.vintage(contracts_tx(spark, d), **ROLES))


@query(_vintage_sql("tx_type", False))
def vintage_by_type(spark, d):
    return _curves(vintage.vintage_by_type(contracts_tx(spark, d), "tx_type", **ROLES))


@query(_vintage_sql("segment", True))
def vintage_by_segment(spark, d):
    return _curves(vintage.vintage_by_segment(contracts_tx(spark, d), "segment", **ROLES))


@query(f"SELECT * FROM ({_vintage_sql(None, False).replace(', 7))', ', 1))').replace('tx_days % 7', 'tx_days % 1')}) WHERE day IN (30, 90, 180, 365, 730, 1095)")
def vintage_milestones(spark, d):
    return _curves(vintage.at_milestones(vintage.vintage(contracts_tx(spark, d), **{**ROLES, "step": 1})))


def _profile(spark, d):
    return vintage.transaction_profile(contracts_tx(spark, d), "client_id", "amount", "tx_days", "tx_dt")


@query(f"{CTX} SELECT count(*) AS n_rows, count(DISTINCT client_id) AS n_clients, count(amount) AS n_tx, round(sum(amount), 2) AS turnover, min(tx_dt) AS first_tx, max(tx_dt) AS last_tx FROM contracts_tx")
def tx_overview(spark, d):
    return rounded(_profile(spark, d)["overview"], 2)


@query(f"{CTX} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM contracts_tx" for c in ("client_id", "retro_dt", "balance", "segment", "tx_dt", "tx_days", "amount", "tx_type")) + ")")
def tx_nulls(spark, d):
    return _profile(spark, d)["nulls"]


@query(f"{CTX}, q AS (SELECT unnest([CAST(0.01 AS DOUBLE), 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, unnest(quantile_cont(amount, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS value FROM contracts_tx WHERE amount IS NOT NULL) SELECT q, round(value, 4) AS value FROM q")
def tx_dist_table(spark, d):
    return rounded(_profile(spark, d)["quantiles"], 4)


PER = "per AS (SELECT client_id, count(*) AS n_tx, sum(amount) AS turnover, avg(amount) AS mean_amount FROM contracts_tx WHERE amount IS NOT NULL GROUP BY client_id)"


@query(f"{CTX}, {PER} SELECT count(*) AS n_clients, round(avg(n_tx), 6) AS mean_n_tx, max(n_tx) AS max_n_tx, round(avg(turnover), 3) AS mean_turnover, round(max(turnover), 3) AS max_turnover FROM per")
def tx_per_client(spark, d):
    t = _profile(spark, d)["per_client"]
    return t.select("n_clients", F.round("mean_n_tx", 6).alias("mean_n_tx"), "max_n_tx", F.round("mean_turnover", 3).alias("mean_turnover"), F.round("max_turnover", 3).alias("max_turnover"))


@query(f"{CTX} SELECT CAST(sign(amount) AS INT) AS sign, count(*) AS n_tx, round(sum(amount), 2) AS turnover FROM contracts_tx WHERE amount IS NOT NULL GROUP BY 1")
def tx_sign_stats(spark, d):
    return rounded(_profile(spark, d)["signs"], 2)


@query(f"{CTX}, {PER} SELECT client_id, n_tx, round(turnover, 3) AS turnover, round(mean_amount, 3) AS mean_amount FROM per ORDER BY per.turnover DESC, client_id LIMIT 10")
def tx_top_clients(spark, d):
    return rounded(_profile(spark, d)["top_clients"], 3)


@query(f"{CTX} SELECT CAST(date_trunc('month', tx_dt) AS TIMESTAMP) AS month, count(*) AS n_tx, round(sum(amount), 2) AS turnover FROM contracts_tx WHERE amount IS NOT NULL GROUP BY 1")
def tx_by_month(spark, d):
    return rounded(_profile(spark, d)["by_month"], 2)


@query(f"{CTX} SELECT tx_days, count(*) AS n_tx, round(sum(amount), 2) AS turnover FROM contracts_tx WHERE amount IS NOT NULL AND tx_days IS NOT NULL GROUP BY 1")
def tx_by_day(spark, d):
    return rounded(_profile(spark, d)["by_day"], 2)


# --- overviews and targets --------------------------------------------------------------------

OVERVIEW = {"price": "numeric", "acctbal": "numeric", "quantity": "numeric", "constant": "constant", "empty": "empty", "mostly_zero": "numeric", "priority": "categorical", "date": "datetime"}


def _overview_sql() -> str:
    parts = []
    for c, kind in OVERVIEW.items():
        text = f"CAST({c} AS VARCHAR)"
        num = c if kind in ("numeric", "constant", "empty") else "CAST(NULL AS DOUBLE)"
        zero = f"CAST(count(*) FILTER ({num} = 0) AS DOUBLE) / count(*)" if kind in ("numeric", "constant") else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) FILTER ({c} IS NULL) AS n_missing, count(DISTINCT {c}) AS n_unique, round({zero}, 9) AS zero_share, round((SELECT CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM obs WHERE {c} IS NOT NULL GROUP BY {text})) / count(*), 9) AS top_share, round(min({num}), 6) AS \"min\", round(quantile_cont({num}, 0.5), 6) AS median, round(avg({num}), 6) AS mean, round(max({num}), 6) AS \"max\" FROM obs")
    return f"{OBS} " + " UNION ALL ".join(parts)


@query(_overview_sql())
def overview(spark, d):
    t = eda.overview(observations(spark, d), list(OVERVIEW))
    r = lambda c, k=6: F.round(c, k).alias(c)
    return t.select("column", "kind", "n_missing", "n_unique", r("zero_share", 9), r("top_share", 9), r("min"), r("median"), r("mean"), r("max"))


@query(f"{OBS} SELECT segment, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_target, round(avg(target), 9) AS target_rate FROM obs GROUP BY segment")
def target_summary(spark, d):
    return rounded(eda.target_summary(observations(spark, d), "target", ["segment"]), 9)


_Z = repr(normal_quantile(0.975))
_WILSON = f"""greatest((k / n + {_Z}e0 * {_Z}e0 / (2 * n) - {_Z}e0 * sqrt(k / n * (1 - k / n) / n + {_Z}e0 * {_Z}e0 / (4 * n * n))) / (1 + {_Z}e0 * {_Z}e0 / n), 0) AS lo,
 least((k / n + {_Z}e0 * {_Z}e0 / (2 * n) + {_Z}e0 * sqrt(k / n * (1 - k / n) / n + {_Z}e0 * {_Z}e0 / (4 * n * n))) / (1 + {_Z}e0 * {_Z}e0 / n), 1) AS hi"""


@query(f"{OBS}, g AS (SELECT CAST(date_trunc('quarter', date) AS TIMESTAMP) AS period, segment, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS k FROM obs GROUP BY 1, 2), w AS (SELECT *, {_WILSON} FROM g) SELECT period, segment, CAST(n AS BIGINT) AS n_total, CAST(k AS BIGINT) AS n_positive, round(k / n, 9) AS rate, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM w")
def target_dynamics(spark, d):
    return rounded(eda.target_dynamics(observations(spark, d), "date", "target", "segment", "quarter"), 9)


@query(f"""{OBS}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM obs), g AS (SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 20) AS l, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS r FROM e, range(20) t(i)),
c AS (SELECT bin, count(price) AS n FROM g LEFT JOIN obs ON price >= l AND (price < r OR bin = 19) GROUP BY bin) SELECT g.bin AS bin, round(l, 6) AS "left", round(r, 6) AS "right", n FROM g JOIN c USING (bin)""")
def histogram(spark, d):
    return rounded(eda.histogram(observations(spark, d), "price", 20))


@query(f"""{OBS}, q AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM obs), x AS (SELECT least(greatest(price, a), b) AS x FROM obs, q), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, CAST(count(*) AS DOUBLE) AS n FROM x)
SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS std, round(avg(power((x - mu) / sd, 3)) * any_value(sqrt(n * (n - 1)) / (n - 2)), 6) AS skew, (avg(power((x - mu) / sd, 3)) * any_value(sqrt(n * (n - 1)) / (n - 2)) > 2 AND min(x) > 0) AS log_scale FROM x, m""")
def distribution_stats(spark, d):
    return rounded(eda.distribution_stats(observations(spark, d), "price"))


@query(f"{OBS}, e AS (SELECT list_distinct(quantile_cont(quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM obs) SELECT CAST(CASE WHEN quantity IS NULL THEN -1 ELSE len(list_filter(e, lambda v: v < quantity)) END AS INT) AS bin, count(*) AS n, round(avg(target), 9) AS target_rate FROM obs, e GROUP BY 1")
def target_by_bins(spark, d):
    return rounded(eda.target_by_bins(observations(spark, d), "quantity", "target"), 9)


# --- discrimination ---------------------------------------------------------------------------


def _rank_sql(source: str, keys: str, label: str = "y", score: str = "p") -> str:
    """CTEs ending in r (keys, n, n_target, auc, ks, pr_auc) over a relation with the label and score."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""hh AS (SELECT {k}{score} AS p, CAST(count(*) AS DOUBLE) AS n, CAST(sum({label}) AS DOUBLE) AS q FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY {k}{score}),
cc AS (SELECT {k}n, q, sum(n - q) OVER a AS cn, sum(q) OVER a AS cp, sum(n - q) OVER z AS nn, sum(q) OVER z AS np, sum(q) OVER d AS dp, sum(n) OVER d AS dn FROM hh WINDOW a AS ({part} ORDER BY p), d AS ({part} ORDER BY p DESC), z AS ({part})),
r AS (SELECT {k}CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS n_target, sum(q * (cn - (n - q) / 2)) / nullif(any_value(np) * any_value(nn), 0) AS auc, CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN max(abs(cp / np - cn / nn)) END AS ks, CASE WHEN any_value(np) > 0 THEN sum(q / np * dp / dn) END AS pr_auc FROM cc {group})"""


_SEG = "s AS (SELECT 'ALL' AS segment, target AS y, score AS p FROM obs UNION ALL SELECT coalesce(segment, 'NaN'), target, score FROM obs)"


@query(f"{OBS}, {_SEG}, {_rank_sql('s', 'segment')} SELECT segment, n, n_target, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(CAST(n_target AS DOUBLE) / n, 9) AS target_rate FROM r")
def auc_by_segment(spark, d):
    t = ranking.metrics_by_segment(observations(spark, d), "target", "score", "segment")
    return rounded(t.select("segment", "n", "n_target", "auc", "gini", "target_rate"), 9)


@query(f"{OBS}, {_SEG}, {_rank_sql('s', 'segment')} SELECT segment, round(ks, 9) AS ks, round(pr_auc, 9) AS pr_auc FROM r")
def ks_pr_auc_by_segment(spark, d):
    return rounded(ranking.metrics_by_segment(observations(spark, d), "target", "score", "segment").select("segment", "ks", "pr_auc"), 9)


@query(f"{OBS}, {_rank_sql('obs', '', 'target', 'score')} SELECT n, n_target, round(auc, 9) AS auc, round(ks, 9) AS ks, round(pr_auc, 9) AS pr_auc FROM r")
def ranking_total(spark, d):
    return rounded(ranking.ranking_metrics(observations(spark, d), "target", "score").select("n", "n_target", "auc", "ks", "pr_auc"), 9)


@query(f"{OBS} SELECT segment, round(avg(-(target * ln(score) + (1 - target) * ln(1 - score))), 9) AS logloss, round(avg((score - target) * (score - target)), 9) AS brier FROM obs GROUP BY segment")
def logloss_brier(spark, d):
    return rounded(ranking.losses(observations(spark, d), "target", "score", ["segment"]), 9)


@query(f"{OBS}, o AS (SELECT segment, target, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS i, count(*) OVER (PARTITION BY segment) AS n, sum(target) OVER (PARTITION BY segment) AS t FROM obs), k AS (SELECT *, greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) AS k FROM o) SELECT segment, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(t) AS BIGINT) AS n_target, CAST(any_value(k) AS BIGINT) AS k, round(CAST(sum(target) FILTER (i <= k) AS DOUBLE) / any_value(k) / (CAST(any_value(t) AS DOUBLE) / any_value(n)), 9) AS lift FROM k GROUP BY segment")
def lift_10(spark, d):
    return rounded(ranking.lift(observations(spark, d), "target", "score", "row_id", 0.1, ["segment"]), 9)


@query(f"{OBS}, m AS (SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS period, segment, target AS y, score AS p FROM obs), {_rank_sql('m', 'period, segment')} SELECT period, segment, n, n_target, round(CASE WHEN n >= 30 THEN auc END, 9) AS auc, round(CASE WHEN n >= 30 THEN 2 * auc - 1 END, 9) AS gini, round(CASE WHEN n >= 30 THEN ks END, 9) AS ks, round(CASE WHEN n >= 30 THEN pr_auc END, 9) AS pr_auc FROM r")
def metric_dynamics(spark, d):
    return rounded(ranking.metric_dynamics(observations(spark, d), "target", "score", "date", "segment"), 9)


@query(f"{OBS}, s AS (SELECT 'score' AS sc, target AS y, score AS p FROM obs UNION ALL SELECT 'price', target, price FROM obs UNION ALL SELECT 'acctbal', target, acctbal FROM obs), {_rank_sql('s', 'sc')} SELECT sc AS score, n, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(ks, 9) AS ks FROM r")
def compare_scores(spark, d):
    return rounded(ranking.compare_scores(observations(spark, d), "target", ["score", "price", "acctbal"]), 9)


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, target AS y, {c} AS p FROM obs" for c in ("price", "acctbal", "quantity", "discount", "constant"))


@query(f"{OBS}, s AS ({_LONG}), {_rank_sql('s', 'feature')} SELECT feature, round(greatest(auc, 1 - auc), 9) AS direct_auc FROM r")
def direct_auc_features(spark, d):
    return rounded(ranking.direct_auc(observations(spark, d), "target", ["price", "acctbal", "quantity", "discount", "constant"]), 9)


# --- stability --------------------------------------------------------------------------------

_SPLIT = "date < TIMESTAMP '1998-01-01'"
_Q10 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def _psi_sql(counts: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""c0 AS ({counts}), c1 AS (SELECT *, sum(expected) OVER ({part}) AS ea, sum(actual) OVER ({part}) AS aa FROM c0),
ps AS (SELECT *, CAST(greatest(expected, 1) AS DOUBLE) / nullif(ea, 0) AS es, CAST(greatest(actual, 1) AS DOUBLE) / nullif(aa, 0) AS sa FROM c1 WHERE expected + actual > 0)"""


_PSI_COLS = "CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, round(es, 9) AS expected_share, round(sa, 9) AS actual_share, round((sa - es) * ln(sa / es), 9) AS psi"


def _psi_out(t: DataFrame, bin_type: str) -> DataFrame:
    return rounded(t.select(F.col("bin").cast(bin_type).alias("bin"), "expected", "actual", "expected_share", "actual_share", "psi"), 9)


@query(f"{OBS}, e AS (SELECT list_distinct(quantile_cont(quantity, {_Q10})) AS e FROM obs WHERE {_SPLIT}), " + _psi_sql(f"SELECT CASE WHEN quantity IS NULL THEN 0 ELSE len(list_filter(e, lambda v: v < quantity)) + 1 END AS bin, count(*) FILTER ({_SPLIT}) AS expected, count(*) FILTER (NOT {_SPLIT}) AS actual FROM obs, e GROUP BY 1") + f" SELECT CAST(bin AS BIGINT) AS bin, {_PSI_COLS} FROM ps")
def psi_table_num(spark, d):
    return _psi_out(stability.psi_table(observations(spark, d), "quantity", F.expr(_SPLIT)), "long")


@query(f"{OBS}, " + _psi_sql(f"SELECT CASE WHEN code IS NULL OR code IN ('nan', 'NaN', 'None', 'null', 'NULL', '') THEN 'NaN' ELSE code END AS bin, count(*) FILTER ({_SPLIT}) AS expected, count(*) FILTER (NOT {_SPLIT}) AS actual FROM obs GROUP BY 1") + f" SELECT bin, {_PSI_COLS} FROM ps")
def psi_table_cat(spark, d):
    return _psi_out(stability.psi_table(observations(spark, d), "code", F.expr(_SPLIT)), "string")


_FPSI = ("price", "acctbal", "quantity")
_FLONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, {_SPLIT} AS e, CAST(date_trunc('quarter', date) AS TIMESTAMP) AS period FROM obs" for c in _FPSI)
_FEDGE = f"l AS ({_FLONG}), ed AS (SELECT feature, list_distinct(quantile_cont(x, {_Q10})) AS q FROM l WHERE e GROUP BY feature), b AS (SELECT feature, e, period, CAST(CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(q, lambda v: v < x)) + 1 END AS VARCHAR) AS bin FROM l JOIN ed USING (feature) UNION ALL SELECT 'code', {_SPLIT}, CAST(date_trunc('quarter', date) AS TIMESTAMP), CASE WHEN code = 'nan' THEN 'NaN' ELSE code END FROM obs)"
_STATUS = "CASE WHEN psi IS NULL THEN 'n/a' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS status"


@query(f"{OBS}, {_FEDGE}, " + _psi_sql("SELECT feature, bin, count(*) FILTER (e) AS expected, count(*) FILTER (NOT e) AS actual FROM b GROUP BY 1, 2", "feature") + f", t AS (SELECT feature, sum((sa - es) * ln(sa / es)) AS psi FROM ps GROUP BY 1) SELECT feature, round(psi, 9) AS psi, {_STATUS} FROM t")
def feature_psi(spark, d):
    return rounded(stability.feature_psi(observations(spark, d), [*_FPSI, "code"], F.expr(_SPLIT)), 9)


@query(f"{OBS}, {_FEDGE}, ex AS (SELECT feature, bin, count(*) AS expected FROM b WHERE e GROUP BY 1, 2), ac AS (SELECT feature, period, bin, count(*) AS actual FROM b WHERE NOT e GROUP BY 1, 2, 3), gr AS (SELECT * FROM (SELECT DISTINCT feature, period FROM ac) JOIN ex USING (feature)), " + _psi_sql("SELECT feature, period, bin, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM gr FULL JOIN ac USING (feature, period, bin)", "feature, period") + f", t AS (SELECT feature, period, sum((sa - es) * ln(sa / es)) AS psi FROM ps GROUP BY 1, 2) SELECT feature, period, round(psi, 9) AS psi, {_STATUS} FROM t")
def feature_psi_by_period(spark, d):
    t = observations(spark, d).withColumn("quarter", F.date_trunc("quarter", "date"))
    return rounded(stability.feature_psi(t, [*_FPSI, "code"], F.expr(_SPLIT), period="quarter"), 9)


_PER = "x AS (SELECT CAST(date_trunc('year', date) AS TIMESTAMP) AS period, quantity AS x FROM obs WHERE date IS NOT NULL)"
_NB = "CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(e, lambda v: v < x)) + 1 END"


@query(f"{OBS}, {_PER}, f AS (SELECT min(period) AS f FROM x), e AS (SELECT list_distinct(quantile_cont(x, {_Q10})) AS e FROM x, f WHERE period = f), b AS (SELECT period, {_NB} AS bin FROM x, e), ex AS (SELECT bin, count(*) AS expected FROM b, f WHERE period = f GROUP BY 1), ac AS (SELECT period, bin, count(*) AS actual FROM b GROUP BY 1, 2), gr AS (SELECT * FROM (SELECT DISTINCT period FROM ac) CROSS JOIN ex), " + _psi_sql("SELECT period, bin, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM gr FULL JOIN ac USING (period, bin)", "period") + " SELECT period, round(sum((sa - es) * ln(sa / es)), 9) AS psi FROM ps GROUP BY 1")
def psi_period_reference(spark, d):
    return rounded(stability.psi_by_period(observations(spark, d), "quantity", "date", "year"), 9)


@query(f"{OBS}, {_PER}, e AS (SELECT period, list_distinct(quantile_cont(x, {_Q10})) AS e FROM x GROUP BY period), st AS (SELECT period, e, lead(period) OVER (ORDER BY period) AS nx FROM e), b AS (SELECT nx AS period, {_NB} AS bin, 1 AS o FROM x JOIN st USING (period) WHERE nx IS NOT NULL UNION ALL SELECT x.period, {_NB}, 0 FROM x JOIN st ON x.period = st.nx), " + _psi_sql("SELECT period, bin, sum(o) AS expected, count(*) FILTER (o = 0) AS actual FROM b GROUP BY 1, 2", "period") + ", t AS (SELECT period, sum((sa - es) * ln(sa / es)) AS psi FROM ps GROUP BY 1) SELECT e.period AS period, round(psi, 9) AS psi FROM e LEFT JOIN t ON e.period = t.period")
def psi_period_adjacent(spark, d):
    return rounded(stability.psi_by_period(observations(spark, d), "quantity", "date", "year", mode="adjacent"), 9)


def _greedy_sql(source: str, x: str, k: int, key: str = "") -> str:
    """CTEs ending in up (key, x): upper values of the greedy buckets, by a recursive query."""
    g, part = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    same = f"hc.{key} = s.{key} AND " if key else ""
    return f"""hv AS (SELECT {g}{x} AS x, count(*) AS n FROM {source} WHERE {x} IS NOT NULL GROUP BY {g}{x}),
hc AS MATERIALIZED (SELECT {g}x, sum(n) OVER ({part} ORDER BY x) AS c, sum(n) OVER ({part}) AS tot FROM hv),
st AS (SELECT {g}{k} AS k, CAST(0 AS HUGEINT) AS b, CAST(max(tot) AS HUGEINT) AS tot FROM hc {f'GROUP BY {key}' if key else ''}
 UNION ALL SELECT {f's.{key}, ' if key else ''}s.k - 1, CASE WHEN s.k <= 1 THEN s.tot ELSE (SELECT CAST(min(c) AS HUGEINT) FROM hc WHERE {same}CAST(c - s.b AS DOUBLE) >= CAST(s.tot - s.b AS DOUBLE) / s.k) END, s.tot FROM st s WHERE s.k >= 1 AND s.b < s.tot),
up AS (SELECT DISTINCT {f'hc.{key}, ' if key else ''}hc.x FROM hc JOIN st ON {f'hc.{key} = st.{key} AND ' if key else ''}hc.c = st.b)"""


OBSR = OBS.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{OBSR}, {_greedy_sql('obs', 'quantity', 7)} SELECT CAST(CASE WHEN quantity IS NULL THEN -1 ELSE (SELECT count(*) FROM up WHERE up.x < quantity) END AS INT) AS bucket, count(*) AS n, round(min(quantity), 6) AS least, round(max(quantity), 6) AS largest FROM obs GROUP BY 1")
def greedy_buckets(spark, d):
    t = stability.quantile_buckets(observations(spark, d), "quantity", 7)
    return rounded(t.groupBy("bucket").agg(F.count("*").alias("n"), F.min("quantity").alias("least"), F.max("quantity").alias("largest")))


@query(f"{OBS}, e AS (SELECT min(quantity) AS lo, max(quantity) AS hi FROM obs), r AS (SELECT quantity, CASE WHEN quantity IS NULL THEN -1 ELSE len(list_filter(list_transform(range(1, 8), lambda i: lo + i * ((hi - lo) / 8)), lambda v: v <= quantity)) END AS raw FROM obs, e), k AS (SELECT raw, CASE WHEN raw < 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY raw < 0 ORDER BY raw) - 1 END AS bucket FROM (SELECT DISTINCT raw FROM r)) SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, round(min(quantity), 6) AS least, round(max(quantity), 6) AS largest FROM r JOIN k USING (raw) GROUP BY 1")
def uniform_buckets(spark, d):
    t = stability.uniform_buckets(observations(spark, d), "quantity", 8)
    return rounded(t.groupBy("bucket").agg(F.count("*").alias("n"), F.min("quantity").alias("least"), F.max("quantity").alias("largest")))


def _woe_sql(source: str, keys: str, part: str = "") -> str:
    w = f"PARTITION BY {part}" if part else ""
    return f"""w0 AS (SELECT {keys}, count(*) AS n, sum(y) AS bad, count(*) - sum(y) AS good FROM {source} GROUP BY {keys}),
w1 AS (SELECT *, (CASE WHEN bad = 0 THEN 1e-5 ELSE CAST(bad AS DOUBLE) END) / nullif(sum(bad) OVER ({w}), 0) AS bs, (CASE WHEN good = 0 THEN 1e-5 ELSE CAST(good AS DOUBLE) END) / nullif(sum(good) OVER ({w}), 0) AS gs FROM w0),
wi AS (SELECT *, ln(bs / gs) AS woe, (bs - gs) * ln(bs / gs) AS iv FROM w1)"""


_GB = "CAST(CASE WHEN quantity IS NULL THEN -1 ELSE (SELECT count(*) FROM up WHERE up.x < quantity) END AS INT)"


@query(f"{OBSR}, {_greedy_sql('obs', 'quantity', 5)}, pl AS (SELECT {_GB} AS bucket, target AS y FROM obs), {_woe_sql('pl', 'bucket')} SELECT bucket, n, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good, round(bs, 9) AS bad_share, round(gs, 9) AS good_share, round(CAST(bad AS DOUBLE) / n, 9) AS bad_rate, round(woe, 9) AS woe, round(iv, 9) AS iv FROM wi")
def woe_iv(spark, d):
    return rounded(stability.woe_iv_table(stability.quantile_buckets(observations(spark, d), "quantity", 5), "bucket", "target"), 9)


_IVF = ("price", "acctbal", "quantity", "discount", "mostly_zero")


@query(f"{OBSR}, lg AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, {c} AS v, target AS y FROM obs' for c in _IVF)}), {_greedy_sql('lg', 'v', 10, 'feature')}, ua AS (SELECT feature, list(x) AS u FROM up GROUP BY feature), pl AS (SELECT lg.feature AS feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(u, lambda z: z < v)) END AS bucket, y FROM lg LEFT JOIN ua ON lg.feature = ua.feature), {_woe_sql('pl', 'feature, bucket', 'feature')}, t AS (SELECT feature, sum(iv) AS iv FROM wi GROUP BY 1) SELECT feature, round(iv, 9) AS iv, CASE WHEN iv < 0.02 THEN 'none' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' ELSE 'strong' END AS strength FROM t")
def iv_table(spark, d):
    return rounded(stability.iv_table(observations(spark, d), _IVF, "target"), 9)


def _stability_sql(x: str, bucket: str, extra: str, tail: str) -> str:
    return f"""{OBSR}, {extra}, pl AS (SELECT CAST(date_trunc('year', date) AS TIMESTAMP) AS period, {bucket} AS bucket, target AS y FROM obs), {_woe_sql('pl', 'period, bucket', 'period')},
od AS (SELECT period, lag(period) OVER (ORDER BY period) AS bf FROM (SELECT DISTINCT period FROM wi)), nw AS (SELECT wi.period, bucket, n AS actual FROM wi JOIN od USING (period) WHERE bf IS NOT NULL), ol AS (SELECT od.period AS period, bucket, n AS expected FROM od JOIN wi ON od.bf = wi.period),
{_psi_sql('SELECT period, bucket, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM nw FULL JOIN ol USING (period, bucket)', 'period')}, pt AS (SELECT period, sum((sa - es) * ln(sa / es)) AS psi FROM ps GROUP BY 1) {tail}"""


_CELLS = "SELECT period, bucket, n, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good, round(CAST(bad AS DOUBLE) / n, 9) AS bad_rate, round(woe, 9) AS woe, round(iv, 9) AS iv, round(sqrt(CAST(bad AS DOUBLE) / n * (1 - CAST(bad AS DOUBLE) / n) / n), 9) AS bad_rate_ci, round(sqrt(1 / greatest(CAST(bad AS DOUBLE), 1e-5) + 1 / greatest(CAST(good AS DOUBLE), 1e-5)), 9) AS woe_ci, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY period), 9) AS share FROM wi"
_PERIODS = ", pp AS (SELECT period, CAST(sum(n) AS BIGINT) AS n, sum(iv) AS iv FROM wi GROUP BY 1) SELECT pp.period AS period, n, round(iv, 9) AS iv, round(psi, 9) AS psi FROM pp LEFT JOIN pt ON pp.period = pt.period"


@query(_stability_sql("quantity", _GB, _greedy_sql("obs", "quantity", 5), _CELLS))
def stability_buckets(spark, d):
    return rounded(stability.stability_table(observations(spark, d), "quantity", "target", "date", "year")[0], 9)


@query(_stability_sql("quantity", _GB, _greedy_sql("obs", "quantity", 5), _PERIODS))
def stability_periods(spark, d):
    return rounded(stability.stability_table(observations(spark, d), "quantity", "target", "date", "year")[1], 9)


@query(_stability_sql("quantity", "CAST(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END AS INT)", "nf AS (SELECT 1)", _CELLS))
def stability_nullflag(spark, d):
    return rounded(stability.null_flag_stability(observations(spark, d), "quantity", "target", "date", "year")[0], 9)


@query(f"{OBSR}, {_greedy_sql('obs', 'quantity', 5)}, pl AS (SELECT CAST(date_trunc('year', date) AS TIMESTAMP) AS period, {_GB} AS bucket, price AS y FROM obs WHERE quantity IS NOT NULL) SELECT period, bucket, count(*) AS n, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.45), 6) AS q45, round(quantile_cont(y, 0.55), 6) AS q55, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY period), 9) AS share FROM pl GROUP BY 1, 2")
def stability_continuous(spark, d):
    t = stability.stability_table(observations(spark, d), "quantity", "price", "date", "year", continuous=True)[0]
    return t.select("period", "bucket", "n", *[F.round(c, 6).alias(c) for c in ("median", "q45", "q55")], F.round("share", 9).alias("share"))


# --- calibration ------------------------------------------------------------------------------


def _logits(spark, d):
    return observations(spark, d).withColumn("logit", F.round(C.prob_to_logit(F.col("score")), 3))


_GAIN = f"""{OBS}, lo AS (SELECT round(ln(score / (1 - score)), 3) AS l, target AS y FROM obs), q AS (SELECT list_distinct(quantile_cont(l, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q, min(l) AS mn FROM lo), e AS (SELECT list_filter(q, lambda v: v > mn) AS e FROM q),
b AS (SELECT CAST(greatest(len(e), 1) - len(list_filter(e, lambda v: v < l)) AS INT) AS bucket, l, y FROM lo, e),
g AS (SELECT bucket, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_target, avg(y) AS badrate, avg(1 / (1 + exp(-l))) AS pred, min(l) AS logit_min, max(l) AS logit_max FROM b GROUP BY bucket)"""


@query(_GAIN + " SELECT bucket, n, n_target, round(badrate, 9) AS badrate, round(CAST(2.5758 AS DOUBLE) * sqrt(badrate * (1 - badrate) / n), 9) AS ci, round(pred, 9) AS pred, logit_min, logit_max FROM g")
def gain_chart_table(spark, d):
    return rounded(calibration.gain_chart_table(_logits(spark, d), "logit", "target"), 9)


@query(_GAIN + " SELECT round(sum(CASE WHEN pred * n * (1 - pred) > 0 THEN power(n_target - pred * n, 2) / (pred * n * (1 - pred)) END), 6) AS hl, count(*) AS groups FROM g")
def hosmer_lemeshow(spark, d):
    return rounded(calibration.hosmer_lemeshow(calibration.gain_chart_table(_logits(spark, d), "logit", "target")))


# --- splits -----------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY target ORDER BY md5('42|' || row_id), row_id) AS rk, count(*) OVER (PARTITION BY target) AS cn"


@query(f"{OBS}, r AS (SELECT *, {_RANK} FROM obs), p AS (SELECT *, CASE WHEN rk <= round_even(cn * CAST(0.1 AS DOUBLE), 0) THEN 'test' WHEN rk <= round_even(cn * CAST(0.1 AS DOUBLE), 0) + round_even(cn * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS part FROM r) SELECT part, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_target, round(avg(target), 9) AS target_rate, min(date) AS date_min, max(date) AS date_max, CAST(sum(row_id) AS BIGINT) AS ids FROM p GROUP BY part")
def split_random_summary(spark, d):
    s = splits.random_split(observations(spark, d), "target", "row_id", 0.2, 0.1)
    ids = s.data.groupBy("part").agg(F.sum("row_id").alias("ids"))
    return rounded(s.summary("date").join(ids, "part"), 9)


@query(f"{OBS}, dv AS (SELECT *, row_number() OVER (ORDER BY date, row_id) AS rk, count(*) OVER () AS cn FROM obs WHERE date < TIMESTAMP '2000-01-01'), p AS (SELECT row_id, target, date, CASE WHEN rk > cn - round_even(cn * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS part FROM dv UNION ALL SELECT row_id, target, date, 'test' FROM obs WHERE date >= TIMESTAMP '2000-01-01' AND date < TIMESTAMP '2001-01-01') SELECT part, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_target, round(avg(target), 9) AS target_rate, min(date) AS date_min, max(date) AS date_max, CAST(sum(row_id) AS BIGINT) AS ids FROM p GROUP BY part")
def split_time_summary(spark, d):
    s = splits.time_split(observations(spark, d), "target", "date", "row_id", "2000-01-01", "2001-01-01", val_mode="time")
    ids = s.data.groupBy("part").agg(F.sum("row_id").alias("ids"))
    return rounded(s.summary("date").join(ids, "part"), 9)


@query(f"{OBS}, r AS (SELECT row_id, {_RANK} FROM obs) SELECT row_id, CAST((rk - 1) % 5 AS INT) AS fold FROM r")
def folds(spark, d):
    return splits.make_folds(observations(spark, d), "target", "row_id").select("row_id", "fold")


@query(f"{OBS} SELECT row_id FROM obs ORDER BY md5('42|' || row_id), row_id LIMIT 500")
def exact_sample(spark, d):
    return splits.exact_sample(observations(spark, d).select("row_id"), "row_id", 500)


# --- selection and typing ---------------------------------------------------------------------

_QF = ("price", "acctbal", "quantity", "constant", "empty", "mostly_zero")


def _quality_sql() -> str:
    parts = []
    for c in _QF:
        parts.append(f"SELECT '{c}' AS feature, 'numeric' AS kind, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) AS m, CAST(count(*) FILTER ({c} = 0) AS DOUBLE) / count(*) AS z, CAST(0 AS BIGINT) AS n_unique, stddev_samp({c}) AS sd FROM obs")
    parts.append("SELECT 'priority', 'categorical', CAST(count(*) FILTER (priority IS NULL) AS DOUBLE) / count(*), CAST(0 AS DOUBLE), count(DISTINCT priority), NULL FROM obs")
    reason = "CASE WHEN kind = 'numeric' THEN CASE WHEN m > 0.95 THEN 'missing' WHEN z > 0.95 THEN 'zeros' WHEN m + z > 0.95 THEN 'zeros_and_missing' WHEN sd IS NULL OR NOT sd > 0 THEN 'constant' END ELSE CASE WHEN n_unique <= 1 THEN 'too_few_values' WHEN n_unique > 100 THEN 'too_many_values' WHEN m > 0.95 THEN 'missing' END END"
    return f"{OBS}, q AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, {reason} AS reason FROM q) SELECT feature, kind, round(m, 9) AS missing_share, round(z, 9) AS zero_share, n_unique, reason, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS action FROM r"


@query(_quality_sql())
def quality_filter(spark, d):
    return rounded(selection.quality_table(observations(spark, d), [*_QF, "priority"], ["priority"]), 9)


_CF = ("price", "acctbal", "quantity", "price_copy", "n_lines", "constant")


@query(f"{OBS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0), 6) AS corr FROM obs" for k, a in enumerate(_CF) for b in _CF[k + 1 :]))
def corr_matrix(spark, d):
    return rounded(selection.correlation_matrix(observations(spark, d), list(_CF)), 6)


_KF = ("c_acctbal", "c_nationkey", "c_custkey", "thousands")


@query("WITH c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN floor(CAST(c_acctbal AS DOUBLE) / 1000) END AS thousands FROM customer) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(sum(abs(sign(x.{a} - y.{a}))) * sum(abs(sign(x.{b} - y.{b})))), 9) AS corr FROM c x JOIN c y ON x.c_custkey < y.c_custkey WHERE x.{a} IS NOT NULL AND y.{a} IS NOT NULL AND x.{b} IS NOT NULL AND y.{b} IS NOT NULL" for k, a in enumerate(_KF) for b in _KF[k + 1 :]))
def corr_kendall(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return rounded(selection.correlation_matrix(c.withColumn("thousands", F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_acctbal") / 1000).cast("double"))), list(_KF), "kendall"), 9)


_CORR = f"{OBS}, s AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, target AS y, {c} AS p FROM obs' for c in ('price', 'acctbal', 'price_copy'))}), {_rank_sql('s', 'feature')}, da AS (SELECT feature, greatest(auc, 1 - auc) AS a FROM r), cr AS (SELECT abs(corr(price, price_copy)) > 0.8 AS hit FROM obs)"
_CORR_OUT = " SELECT feature, round(a, 9) AS direct_auc, CASE WHEN feature <> 'acctbal' AND hit AND (a < (SELECT max(a) FROM da WHERE feature <> 'acctbal') OR (feature = 'price_copy' AND a = (SELECT a FROM da WHERE feature = 'price'))) THEN 'drop' ELSE 'keep' END AS action FROM da, cr"


@query(_CORR + _CORR_OUT)
def corr_components(spark, d):
    r = selection.correlation_filter(observations(spark, d), "target", ["price", "acctbal", "price_copy"])
    return rounded(r.table.select("feature", "direct_auc", "action"), 9)


@query(_CORR + _CORR_OUT)
def corr_pairwise(spark, d):
    r = selection.correlation_filter(observations(spark, d), "target", ["price", "acctbal", "price_copy"], grouping="pairwise")
    return rounded(r.table.select("feature", "direct_auc", "action"), 9)


@query(f"{OBS} SELECT row_id, CASE WHEN code IN ('nan', 'NaN', 'None', 'null', 'NULL', '') THEN NULL ELSE TRY_CAST(code AS DOUBLE) END AS code, CAST(round(price, 0) AS BIGINT)::VARCHAR AS price_text, CAST(target AS INT) AS target, CAST(epoch_us(date) AS DOUBLE) * 1000 AS date_ns FROM obs")
def cast_types(spark, d):
    t = observations(spark, d).withColumn("price_text", F.round("price", 0))
    t = C.cast_types(t, ["code"], ["price_text"], "target")
    return t.select("row_id", "code", "price_text", "target", C.numeric(t, "date").alias("date_ns"))


@query(f"{OBS} SELECT code_text, count(*) AS n FROM (SELECT CASE WHEN code = 'nan' THEN NULL WHEN row_id % 2 = 0 THEN code ELSE code END AS code_text FROM obs) GROUP BY 1")
def category_strings(spark, d):
    raw = F.when((F.col("row_id") % 2 == 0) & (F.col("code") != "nan"), F.concat("code", F.lit(".0"))).otherwise(F.col("code"))
    return observations(spark, d).select(C.category_strings(raw).alias("code_text")).groupBy("code_text").agg(F.count("*").alias("n"))


@query(f"{OBS} SELECT row_id, round(CASE WHEN p > 0 THEN ln(p) END, 9) AS x FROM (SELECT row_id, sign(c) * power(abs(c), CAST(0.5 AS DOUBLE)) AS p FROM (SELECT row_id, least(greatest(acctbal, 0), 5000) AS c FROM obs))")
def value_transform(spark, d):
    return observations(spark, d).select("row_id", F.round(C.value_transform(F.col("acctbal"), 0, 5000, 0.5, True), 9).alias("x"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintage_by_type(spark, sf_dir)


# --- queries whose results SQL cannot give: models, searches, seeded generators -----------------


def _signal(spark, d) -> DataFrame:
    """Observations with a target that depends on price, quantity and priority, and seeded noise."""
    noise = F.conv(F.substring(F.md5(F.concat(F.lit("noise|"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    risk = (F.col("price") - 250_000) / 150_000 + F.coalesce(F.col("quantity"), F.lit(100.0)) / 200 + F.when(F.col("priority").startswith("1"), 0.8).otherwise(0.0)
    return observations(spark, d).withColumn("target", (noise < 1 / (1 + F.exp(-2 * (risk - 0.6)))).cast("int"))


MODEL_FEATURES = ["price", "acctbal", "quantity", "discount", "priority"]


def _folds(spark, d, n: int = 3) -> DataFrame:
    return splits.make_folds(_signal(spark, d), "target", "row_id", n)


def _split(spark, d) -> splits.DataSplit:
    return splits.time_split(_signal(spark, d), "target", "date", "row_id", "2000-01-01")


_NEWTON = f"""{OBSR}, lg AS (SELECT coalesce(segment, 'NaN') AS grp, round(ln(score / (1 - score)), 3) AS l, target AS y FROM obs UNION ALL SELECT 'ALL', round(ln(score / (1 - score)), 3), target FROM obs),
lh AS MATERIALIZED (SELECT grp, l, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS y FROM lg GROUP BY grp, l),
nb AS (SELECT DISTINCT grp, 0 AS i, CAST(0 AS DOUBLE) AS b FROM lh UNION ALL SELECT s.grp, i + 1, b - (SELECT (sum(n / (1 + exp(-(l + s.b)))) - sum(y)) / sum(n / (1 + exp(-(l + s.b))) * (1 - 1 / (1 + exp(-(l + s.b))))) FROM lh WHERE lh.grp = s.grp) FROM nb s WHERE i < 25),
nf AS (SELECT DISTINCT grp, 0 AS i, CAST(1 AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS b FROM lh UNION ALL SELECT grp, i + 1, k + (m.d * m.g1 - m.c * m.g0) / (m.a * m.d - m.c * m.c), b + (m.a * m.g0 - m.c * m.g1) / (m.a * m.d - m.c * m.c)
 FROM (SELECT s.grp, s.i, s.k, s.b, (SELECT {{'g1': sum((y - n / (1 + exp(-(l * s.k + s.b)))) * l), 'g0': sum(y - n / (1 + exp(-(l * s.k + s.b)))), 'a': sum(n / (1 + exp(-(l * s.k + s.b))) * (1 - 1 / (1 + exp(-(l * s.k + s.b)))) * l * l), 'c': sum(n / (1 + exp(-(l * s.k + s.b))) * (1 - 1 / (1 + exp(-(l * s.k + s.b)))) * l), 'd': sum(n / (1 + exp(-(l * s.k + s.b))) * (1 - 1 / (1 + exp(-(l * s.k + s.b)))))}} FROM lh WHERE lh.grp = s.grp) AS m FROM nf s WHERE s.i < 25)),
ro AS (SELECT nb.grp, nb.b AS offs, nf.k AS coef, nf.b AS icpt FROM nb JOIN nf USING (grp) WHERE nb.i = 25 AND nf.i = 25)"""


@query(_NEWTON + " SELECT round(offs, 6) AS \"offset\", round(coef, 6) AS coef, round(icpt, 6) AS intercept FROM ro WHERE grp = 'ALL'")
def calibration_parameters(spark, d):
    df = _logits(spark, d)
    k, b = calibration.full_calibration(df, "logit", "target")
    return spark.createDataFrame([(round(calibration.calibration_offset(df, "logit", "target"), 6), round(k, 6), round(b, 6))], "offset double, coef double, intercept double")


@query(f"""{_NEWTON}, gq AS (SELECT grp, quantile_cont(l, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM lg GROUP BY grp), ge AS (SELECT grp, list_distinct(list_filter(q[2:], lambda v: v > q[1])) AS e FROM gq),
gb AS (SELECT grp, len(list_filter(e, lambda v: v < l)) AS bucket, count(*) AS n, sum(y) AS k, avg(1 / (1 + exp(-l))) AS pred FROM lg JOIN ge USING (grp) GROUP BY 1, 2),
hl AS (SELECT grp, sum(CASE WHEN pred * n * (1 - pred) > 0 THEN power(k - pred * n, 2) / (pred * n * (1 - pred)) END) AS hl FROM gb GROUP BY grp), {_rank_sql('lg', 'grp', 'y', 'l')}
SELECT grp AS "group", round(auc, 4) AS roc_auc, round(hl, 1) AS hl, round(offs, 4) AS "offset", round(coef, 4) AS coef FROM r JOIN hl USING (grp) JOIN ro USING (grp) WHERE grp <> 'ALL'""")
def gain_chart_by_segment(spark, d):
    return spark.createDataFrame(calibration.gain_chart_metrics(_logits(spark, d), "logit", "target", "segment"), "group string, roc_auc double, hl double, offset double, coef double")


# A rational approximation of the normal quantile near the middle.
_PROBIT = "(((((-39.69683028665376e0 * t + 220.9460984245205e0) * t - 275.9285104469687e0) * t + 138.3577518672690e0) * t - 30.66479806614716e0) * t + 2.506628277459239e0) * v / (((((-54.47609879822406e0 * t + 161.5858368580409e0) * t - 155.6989798598866e0) * t + 66.80131188771972e0) * t - 13.28068155288572e0) * t + 1e0)"


@query(f"{OBS}, s AS (SELECT 'price' AS feature, target AS y, price AS p FROM obs UNION ALL SELECT 'acctbal', target, acctbal FROM obs), {_rank_sql('s', 'feature')}, tv AS (SELECT feature, greatest(auc, 1 - auc) - 0.5 AS v, (greatest(auc, 1 - auc) - 0.5) * (greatest(auc, 1 - auc) - 0.5) AS t FROM r) SELECT feature, round(2 * power({_PROBIT}, 2), 7) AS iv FROM tv")
def iv_auc(spark, d):
    rows = ranking.direct_auc(observations(spark, d), "target", ["price", "acctbal"]).collect()
    return rounded(spark.createDataFrame([(r["feature"], C.iv_from_auc(r["direct_auc"])) for r in rows], "feature string, iv double"), 7)


_SIGNAL = f"""{OBS}, sg AS (SELECT * REPLACE (CASE WHEN CAST(('0x' || substr(md5('noise|' || row_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967296 < 1 / (1 + exp(-2 * ((price - 250000) / CAST(150000 AS DOUBLE) + coalesce(quantity, 100) / 200 + CASE WHEN priority LIKE '1%' THEN CAST(0.8 AS DOUBLE) ELSE 0 END - CAST(0.6 AS DOUBLE)))) THEN 1 ELSE 0 END AS target) FROM obs),
sf AS (SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|' || row_id), row_id) - 1) % 3 AS INT) AS fold FROM sg)"""
MODEL_NUMBERS = ("price", "acctbal", "quantity", "discount")


def _bins_sql(train: str, data: str, keep: str, bins: int = 32) -> str:
    """CTEs ending in bn (feature, keep, b): bins of MODEL_FEATURES by edges of ``train``, 0 for missing."""
    cuts = ", ".join(f"CAST({k} AS DOUBLE) / {bins - 1}" for k in range(1, bins - 1))
    return f"""tl AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS x FROM {train} WHERE {f} IS NOT NULL" for f in MODEL_NUMBERS)}), tr AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rk, count(*) OVER (PARTITION BY feature) AS nx FROM tl),
te AS (SELECT DISTINCT feature, x FROM tr JOIN (SELECT unnest([{cuts}]) AS q) ON rk = greatest(1, CAST(ceil(q * nx) AS BIGINT))), ta AS (SELECT feature, list(x) AS e FROM te GROUP BY feature),
pc AS (SELECT DISTINCT priority AS c FROM {train} WHERE priority IS NOT NULL), dl AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS x, {keep} FROM {data}" for f in MODEL_NUMBERS)}),
bn AS (SELECT feature, {keep}, CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(e, lambda v: v < x)) + 1 END AS b FROM dl JOIN ta USING (feature)
 UNION ALL SELECT 'priority', {keep}, CASE WHEN priority IS NULL THEN 0 ELSE (SELECT CASE WHEN count(*) FILTER (c = priority) = 0 THEN 0 ELSE count(*) FILTER (c <= priority) END FROM pc) END FROM {data})"""


@query(f"""{_SIGNAL}, {_bins_sql('sf', 'sf', 'fold, target')}, ct AS (SELECT feature, fold, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS k FROM bn GROUP BY 1, 2, 3), fo AS (SELECT DISTINCT fold AS o FROM sf),
tn AS (SELECT feature, o, b, sum(n) AS n, sum(k) AS k FROM ct JOIN fo ON fold <> o GROUP BY 1, 2, 3), rt AS (SELECT feature, o, sum(k) / sum(n) AS rate FROM tn GROUP BY 1, 2),
sc AS (SELECT ct.feature AS feature, ct.fold AS fold, ct.n AS n, ct.k AS k, coalesce((tn.k + 5 * rate) / (tn.n + 5), rate) AS p FROM ct JOIN rt ON ct.feature = rt.feature AND ct.fold = rt.o LEFT JOIN tn ON tn.feature = ct.feature AND tn.o = ct.fold AND tn.b = ct.b),
hs AS (SELECT feature, fold, p, sum(n) AS n, sum(k) AS q FROM sc GROUP BY 1, 2, 3), hc AS (SELECT *, sum(n - q) OVER (PARTITION BY feature, fold ORDER BY p) AS cn FROM hs),
fa AS (SELECT feature, fold, sum(q * (cn - (n - q) / 2)) / (sum(q) * sum(n - q)) AS auc FROM hc GROUP BY 1, 2)
SELECT feature, round(avg(auc), 9) AS auc_mean, round(stddev_pop(auc), 9) AS auc_std, round(abs(avg(auc) - 0.5), 9) AS auc_gain, 'ok' AS status FROM fa GROUP BY feature""")
def univariate_scores(spark, d):
    from riskloom.operators import models

    t = models.univariate_scores(_folds(spark, d), "target", MODEL_FEATURES, accuracy=1_000_000, model="rates")
    return rounded(t.select("feature", "auc_mean", "auc_std", "auc_gain", "status"), 9)


@query(f"{_SIGNAL}, mu AS (SELECT avg(target) AS m FROM sg), rk AS (SELECT row_id, target, coalesce(priority, '') AS c, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS r FROM sg) SELECT row_id, round((coalesce(sum(target) OVER w, 0) + m) / (count(target) OVER w + 1), 9) AS stat FROM rk, mu WINDOW w AS (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ordered_target_stats(spark, d):
    from riskloom.operators import models

    t, _, _ = models.with_ordered_stats(_signal(spark, d), "target", F.col("priority"), F.lit(True), "stat")
    return rounded(t.select("row_id", "stat"), 9)


@query()
def symmetric_scores(spark, d):
    from riskloom.operators import models

    m = models.make_model("symmetric", n_trees=5, depth=3, learning_rate=0.3)
    cv = models.cross_validate(_folds(spark, d), "target", MODEL_FEATURES, model=m)
    return spark.createDataFrame([(k, s) for k, s in enumerate(cv.scores)], "fold int, score double")


@query()
def univariate_boosting(spark, d):
    from riskloom.operators import models

    return models.univariate_scores(_folds(spark, d), "target", MODEL_FEATURES)


@query(f"""{_SIGNAL}, {_bins_sql('sf', 'sf', 'fold, target')}, ct AS (SELECT feature, fold, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS k FROM bn WHERE feature <> 'priority' GROUP BY 1, 2, 3), fo AS (SELECT DISTINCT fold AS o FROM sf),
tn AS (SELECT feature, o, b, sum(n) AS n, sum(k) AS k FROM ct JOIN fo ON fold <> o GROUP BY 1, 2, 3), mu AS (SELECT feature, o, sum(k) / sum(n) AS q FROM tn GROUP BY 1, 2),
hi AS (SELECT feature, o, b, n, k - n * q AS g, n * q * (1 - q) AS h FROM tn JOIN mu USING (feature, o)), to_ AS (SELECT feature, o, sum(n) AS n, sum(g) AS g, sum(h) AS h, max(b) AS top, sum(n) FILTER (b = 0) AS nm FROM hi GROUP BY 1, 2),
op AS (SELECT c.feature AS feature, c.o AS o, c.b AS cut, ml FROM hi c JOIN to_ USING (feature, o) CROSS JOIN (SELECT unnest([false, true]) AS ml) WHERE c.b > 0 AND (c.b < top OR (nm > 0 AND NOT ml)) AND (NOT ml OR nm > 0)),
sd AS (SELECT op.feature AS feature, op.o AS o, cut, ml, sum(hi.n) AS ln, sum(hi.g) AS lg, sum(hi.h) AS lh FROM op JOIN hi ON hi.o = op.o AND hi.feature = op.feature AND ((hi.b > 0 AND hi.b <= cut) OR (hi.b = 0 AND ml)) GROUP BY 1, 2, 3, 4),
be AS (SELECT sd.*, to_.g AS g, to_.h AS h, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM sd JOIN to_ USING (feature, o) WHERE ln >= 50 AND n - ln >= 50 QUALIFY row_number() OVER (PARTITION BY feature, o ORDER BY gain DESC, cut, ml) = 1),
hs AS (SELECT ct.feature AS feature, fold, p, sum(n) AS n, sum(k) AS q FROM (SELECT ct.*, coalesce(CASE WHEN (ct.b = 0 AND ml) OR (ct.b > 0 AND ct.b <= cut) THEN lg / (lh + 1) ELSE (g - lg) / (h - lh + 1) END, 0) AS p FROM ct LEFT JOIN be ON be.feature = ct.feature AND be.o = ct.fold) ct GROUP BY 1, 2, 3),
hc AS (SELECT *, sum(n - q) OVER (PARTITION BY feature, fold ORDER BY p) AS cn FROM hs), fa AS (SELECT feature, fold, sum(q * (cn - (n - q) / 2)) / (sum(q) * sum(n - q)) AS auc FROM hc GROUP BY 1, 2)
SELECT feature, round(avg(auc), 9) AS auc_mean, round(stddev_pop(auc), 9) AS auc_std, round(min(auc), 9) AS auc_min, round(max(auc), 9) AS auc_max FROM fa GROUP BY feature""")
def univariate_boosting_of_stumps(spark, d):
    from riskloom.operators import models

    t = models.univariate_scores(_folds(spark, d), "target", list(MODEL_NUMBERS), accuracy=1_000_000, model={"n_trees": 1, "num_leaves": 2})
    return rounded(t.select("feature", "auc_mean", "auc_std", "auc_min", "auc_max"), 9)


@query(f"""{_SIGNAL}, st AS (SELECT * FROM sg WHERE date < TIMESTAMP '1997-01-01'), sd AS (SELECT CAST(date_trunc('quarter', date) AS TIMESTAMP) AS period, * FROM sg WHERE date >= TIMESTAMP '1997-01-01'), {_bins_sql('st', 'sd', 'period, target')},
b2 AS (SELECT feature, target, CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(e, lambda v: v < x)) + 1 END AS b FROM ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS x, target FROM st" for f in MODEL_NUMBERS)}) JOIN ta USING (feature)
 UNION ALL SELECT 'priority', target, CASE WHEN priority IS NULL THEN 0 ELSE (SELECT count(*) FROM pc WHERE c <= priority) END FROM st),
tn AS (SELECT feature, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS k FROM b2 GROUP BY 1, 2), rt AS (SELECT feature, sum(k) / sum(n) AS rate FROM tn GROUP BY 1),
sc AS (SELECT bn.feature AS feature, period, target AS y, coalesce((k + 5 * rate) / (n + 5), rate) AS p FROM bn JOIN rt ON rt.feature = bn.feature LEFT JOIN tn ON tn.feature = bn.feature AND tn.b = bn.b), {_rank_sql('sc', 'feature, period')}
SELECT feature, period, n, round(CASE WHEN n >= 30 THEN auc END, 9) AS value FROM r""")
def feature_metric_dynamics(spark, d):
    from riskloom.operators import models

    t = _signal(spark, d)
    late = F.col("date") >= F.lit("1997-01-01").cast("timestamp")
    return rounded(models.feature_metric_dynamics(t.filter(~late), t.filter(late), MODEL_FEATURES, "target", "date", "quarter", accuracy=1_000_000), 9)


@query()
def univariate_tree(spark, d):
    from riskloom.operators import models

    return models.univariate_tree_scores(_folds(spark, d), "target", MODEL_FEATURES)


@query()
def cv_scores(spark, d):
    from riskloom.operators import models

    cv = models.cross_validate(_folds(spark, d), "target", MODEL_FEATURES, model="small", segment="segment")
    return spark.createDataFrame([(k, s) for k, s in enumerate(cv.scores)], "fold int, score double")


@query()
def train_scores(spark, d):
    from riskloom.operators import models

    fitted = models.train_model(_split(spark, d), MODEL_FEATURES, "small")
    return spark.createDataFrame(list(fitted.scores_.items()), "part string, score double")


@query()
def compare_models(spark, d):
    from riskloom.operators import models

    return models.compare_models(_folds(spark, d, 2), "target", MODEL_FEATURES, ("small", "deep"))[0].drop("mean_fit_time_sec")


@query()
def tune_table(spark, d):
    from riskloom.operators import models

    return models.tune_hyperparams(_split(spark, d), MODEL_FEATURES[:3], n_trials=2, space={"depth": (2, 3), "n_trees": (3, 5)})[0]


@query()
def sample_size(spark, d):
    from riskloom.operators import models

    return models.sample_size_curve(_split(spark, d), MODEL_FEATURES[:3], [500, 2000])


@query()
def importance(spark, d):
    from riskloom.operators import wrappers

    return wrappers.cumulative_importance_selection(_signal(spark, d), "target", MODEL_FEATURES, model="small").table


@query()
def permutation_importance(spark, d):
    from riskloom.operators import models, wrappers

    with models.held(_signal(spark, d), ["row_id", "target", *MODEL_FEATURES[:3]]) as df:
        fitted = models.make_model("small").fit(df, "target", MODEL_FEATURES[:3])
        return wrappers.permutation_importance(fitted, df, "target", n_repeats=2)


@query()
def rfe_log(spark, d):
    from riskloom.operators import wrappers

    return wrappers.rfe(_folds(spark, d, 2), "target", ["price", "quantity", "acctbal"], model="small", tol=0.002).table


@query()
def forward_addition(spark, d):
    from riskloom.operators import wrappers

    s = _split(spark, d)
    return wrappers.forward_addition(s.train, s.val, "target", ["price"], ["quantity", "acctbal"]).table


@query()
def backward_elimination(spark, d):
    from riskloom.operators import wrappers

    s = _split(spark, d)
    return wrappers.backward_elimination(s.train, s.val, "target", ["price", "quantity", "acctbal"], segment="segment").table


@query()
def incremental(spark, d):
    from riskloom.operators import wrappers

    return wrappers.incremental_feature_eval(_folds(spark, d, 2), "target", ["price", "quantity"]).table


def _corr_sql(a: str, b: str) -> str:
    u, v = (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {c} END" for c in (a, b))
    return f"covar_pop({u}, {v}) / nullif(stddev_pop({u}) * stddev_pop({v}), 0)"


_CHEAP = ("quantity", "price_copy")


@query(f"""{OBS}, s AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, target AS y, {c} AS p FROM obs" for c in _CHEAP)}), {_rank_sql('s', 'feature')},
cv AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST(count({c}) AS DOUBLE) / count(*) AS coverage, min(date) FILTER ({c} IS NOT NULL) AS filled_from, max(date) FILTER ({c} IS NOT NULL) AS filled_to FROM obs" for c in _CHEAP)}),
co AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature, '{b}' AS o, abs({_corr_sql(a, b)}) AS c FROM obs" for a in _CHEAP for b in ("price", "acctbal"))}), cm AS (SELECT feature, max(c) AS max_corr, arg_max(o, c) AS corr_with FROM co GROUP BY 1),
fp AS (SELECT min(CAST(date_trunc('quarter', date) AS TIMESTAMP)) AS f FROM obs), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x, CAST(date_trunc('quarter', date) AS TIMESTAMP) AS period, CAST(date_trunc('quarter', date) AS TIMESTAMP) = (SELECT f FROM fp) AS e FROM obs" for c in _CHEAP)}),
ed AS (SELECT feature, list_distinct(quantile_cont(x, {_Q10})) AS q FROM l WHERE e GROUP BY feature), b AS (SELECT feature, e, period, CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(q, lambda v: v < x)) + 1 END AS bin FROM l JOIN ed USING (feature)),
ex AS (SELECT feature, bin, count(*) AS expected FROM b WHERE e GROUP BY 1, 2), ac AS (SELECT feature, period, bin, count(*) AS actual FROM b WHERE NOT e GROUP BY 1, 2, 3), gr AS (SELECT feature, period, bin, expected FROM (SELECT DISTINCT feature, period FROM ac) JOIN ex USING (feature)),
{_psi_sql('SELECT feature, period, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM gr FULL JOIN ac USING (feature, period, bin)', 'feature, period')}, pm AS (SELECT feature, max(psi) AS max_psi FROM (SELECT feature, period, sum((sa - es) * ln(sa / es)) AS psi FROM ps GROUP BY 1, 2) GROUP BY 1)
SELECT feature, round(coverage, 9) AS coverage, filled_from, filled_to, round(greatest(auc, 1 - auc), 9) AS direct_auc, round(max_corr, 7) AS max_corr, corr_with, round(max_psi, 9) AS max_psi FROM r JOIN cv USING (feature) JOIN cm USING (feature) JOIN pm USING (feature)""")
def cheap_stats(spark, d):
    from riskloom.operators import feature_testing

    t = feature_testing.cheap_stats(observations(spark, d), "target", list(_CHEAP), ["price", "acctbal"], "date", freq="quarter")
    return rounded(t, 9).withColumn("max_corr", F.round("max_corr", 7))


@query()
def feature_test(spark, d):
    from riskloom.operators import feature_testing

    return feature_testing.test_features(_split(spark, d), ["acctbal"], ["price"], n_splits=3).summary


@query()
def domain_test(spark, d):
    from riskloom.operators import feature_testing

    return feature_testing.test_domains(_split(spark, d), ["acctbal"], {"order": ["price", "quantity"]}, n_splits=2).summary


def _bootstrap_sql(n: int = 20) -> str:
    from riskloom.operators.feature_testing import poisson_steps

    w = " + ".join(f"CASE WHEN u >= {t!r}e0 THEN 1 ELSE 0 END" for t in poisson_steps())
    return f"""{OBS}, bu AS (SELECT target AS y, round(acctbal / 10000.0e0, 6) AS o, score AS p, b, ('0x' || substr(md5('42|' || CAST(b // 8 AS INT) || '|' || row_id), 1 + 4 * (b % 8), 4))::INT / 65536.0e0 AS u FROM obs, range({n}) t(b)),
bw AS (SELECT y, o, p, b, {w} AS w FROM bu), bl AS (SELECT b, 'base' AS s, o AS x, y, w FROM bw UNION ALL SELECT b, 'new', p, y, w FROM bw), bh AS (SELECT b, s, x, CAST(sum(w * y) AS DOUBLE) AS q, CAST(sum(w * (1 - y)) AS DOUBLE) AS g FROM bl GROUP BY 1, 2, 3),
bc AS (SELECT *, sum(g) OVER (PARTITION BY b, s ORDER BY x) AS c FROM bh), ba AS (SELECT b, s, sum(q * (c - g / 2)) / (sum(q) * sum(g)) AS auc FROM bc GROUP BY 1, 2),
bo AS (SELECT b, max(auc) FILTER (s = 'base') AS base_auc, max(auc) FILTER (s = 'new') AS new_auc FROM ba GROUP BY 1)"""


def _with_other(spark, d) -> DataFrame:
    return observations(spark, d).withColumn("other", F.round(F.col("acctbal") / 10000.0, 6))


@query(f"{_bootstrap_sql()} SELECT CAST(b AS INT) AS b, round(base_auc, 9) AS base_auc, round(new_auc, 9) AS new_auc FROM bo")
def bootstrap_aucs(spark, d):
    from riskloom.operators import feature_testing

    return rounded(feature_testing.bootstrap_aucs(_with_other(spark, d), "target", "other", "score", "row_id", n_boot=20), 9)


@query(f"{_bootstrap_sql()} SELECT round(quantile_cont(new_auc - base_auc, 0.025), 9) AS ci_low, round(quantile_cont(new_auc - base_auc, 0.975), 9) AS ci_high FROM bo")
def bootstrap_auc_delta(spark, d):
    from riskloom.operators import feature_testing

    return rounded(feature_testing.bootstrap_interval(_with_other(spark, d), "target", "other", "score", "row_id", n_boot=20), 9)


@query()
def selection_pipeline(spark, d):
    from riskloom.operators import wrappers

    p = selection.SelectionPipeline([selection.quality_step(), selection.correlation_step(), wrappers.univariate_step()])
    return p.fit(_folds(spark, d), "target", ["price", "price_copy", "quantity", "constant", "empty", "priority"]).log_


@query()
def model_report(spark, d):
    from riskloom.operators import models, report

    s = _split(spark, d)
    fitted = models.train_model(s, MODEL_FEATURES, "small")
    return report.model_report(fitted, s, "date", "segment").tables["metrics"]


def _bits_sql(name: str, keys: str, first: int = 1) -> str:
    return f"CAST(('0x' || substr(md5('42|{name}|' || {keys}), {first}, 8))::UBIGINT AS DOUBLE)"


def _uniform_sql(name: str, keys: str = "client_id") -> str:
    return f"{_bits_sql(name, keys)} / 4294967296"


def _normal_sql(name: str, keys: str = "client_id") -> str:
    return f"sqrt(-2 * ln(({_bits_sql(name, keys)} + 0.5e0) / 4294967296)) * cos(2 * pi() * ({_bits_sql(name, keys, 9)} / 4294967296))"


def _poisson_sql(mean: float, u: str, most: int = 20) -> str:
    import math

    p, acc, parts = math.exp(-mean), 0.0, []
    for k in range(most):
        acc += p
        parts.append(f"WHEN {u} < {acc!r}e0 THEN {k}")
        p *= mean / (k + 1)
    return f"CASE {' '.join(parts)} ELSE {most} END"


@query(f"""WITH c AS (SELECT range AS client_id FROM range(2000)), o AS (SELECT client_id, {_normal_sql('risk')} AS risk, {_uniform_sql('segment')} AS us, {_uniform_sql('bureau')} AS ub, TIMESTAMP '2023-01-01' + to_days(CAST(floor({_uniform_sql('date')} * 540) AS INT)) AS dt FROM c),
f AS (SELECT *, CASE WHEN us < 0.5e0 THEN 'early' WHEN us < 0.8e0 THEN 'middle' ELSE 'late' END AS segment FROM o), g AS (SELECT *, CASE WHEN {_uniform_sql('target')} < 1 / (1 + exp(-(risk - 1.2e0 + CASE WHEN segment = 'late' THEN 0.5e0 ELSE 0 END))) THEN 1 ELSE 0 END AS target FROM f)
SELECT segment, count(*) AS n, round(avg(target), 9) AS target_rate, min(dt) AS first_date, max(dt) AS last_date, round(avg(CASE WHEN ub >= 0.1e0 THEN 600 - risk * 60 + {_normal_sql('score')} * 40 END), 6) AS bureau_score, round(avg(CASE WHEN ub >= 0.1e0 THEN {_poisson_sql(2.5, _uniform_sql('open'))} END), 9) AS open_cnt,
 count(CASE WHEN dt >= TIMESTAMP '2023-07-01' THEN 1 END) AS n_trx, round(avg(exp({_normal_sql('income')} * 0.5e0 + 10.5e0 - risk * 0.2e0)), 4) AS income, count(DISTINCT 'r' || CAST(floor({_uniform_sql('region')} * 8) AS INT)) AS n_regions FROM g GROUP BY segment""")
def demo_observations(spark, d):
    from riskloom.sources.demo import demo_observations as make

    t = make(spark, 2000).groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.avg("target"), 9).alias("target_rate"), F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date"), F.round(F.avg("bureau_score"), 6).alias("bureau_score"),
        F.round(F.avg("bureau_open_cnt"), 9).alias("open_cnt"), F.count("trx_sum").alias("n_trx"), F.round(F.avg("app_income"), 4).alias("income"), F.count_distinct("app_region").alias("n_regions"),
    )
    return t


_TWO = "contract_id || '|' || k"


@query(f"""WITH c0 AS (SELECT range AS contract_id FROM range(1000)), c AS (SELECT contract_id, 'product_' || CAST(floor({_uniform_sql('product', 'contract_id')} * 3) AS INT) AS product, TIMESTAMP '2023-01-01' + to_days(CAST(floor({_uniform_sql('start', 'contract_id')} * 600) AS INT)) AS start_date,
 round(exp({_normal_sql('balance', 'contract_id')} * 0.7e0 + 9.5e0), 2) AS balance, CAST({_poisson_sql(2.5, _uniform_sql('payments', 'contract_id'))} AS INT) AS n_tx FROM c0),
x AS (SELECT contract_id, start_date, balance, unnest(range(1, n_tx + 1)) AS k FROM c), t AS (SELECT contract_id, start_date + to_days(CAST(floor({_uniform_sql('day', _TWO)} * 500) AS INT)) AS tx_date, round(balance * ({_uniform_sql('amount', _TWO)}) * 0.2e0 * CASE WHEN {_uniform_sql('sign', _TWO)} < 0.03e0 THEN -1 ELSE 1 END, 2) AS amount,
 CASE WHEN {_uniform_sql('type', _TWO)} < 0.7e0 THEN 'voluntary' ELSE 'court' END AS tx_type FROM x)
SELECT product, count(*) AS n, count(tx_date) AS n_tx, round(sum(amount), 0) AS turnover, count(CASE WHEN tx_type = 'court' THEN 1 END) AS n_court, min(tx_date) AS first_tx FROM c LEFT JOIN t ON c.contract_id = t.contract_id AND tx_date <= TIMESTAMP '2025-01-01' GROUP BY product""")
def demo_transactions(spark, d):
    from riskloom.sources.demo import demo_transactions as make

    return make(spark, 1000).groupBy("product").agg(F.count("*").alias("n"), F.count("tx_date").alias("n_tx"), F.round(F.sum("tx_amount"), 0).alias("turnover"), F.count_if(F.col("tx_type") == "court").alias("n_court"), F.min("tx_date").alias("first_tx"))


# --- models of one split, which SQL can grow too -------------------------------------------------


def _stump():
    """Boosting of one tree with one split, its edges exact."""
    from riskloom.operators.models import make_model

    return make_model("small", n_trees=1, depth=1, accuracy=1_000_000)


def _stumps_sql(members: str) -> str:
    """CTEs ending in au (o, part, auc): models ``o`` of one split, fitted on train and scored by part.

    ``members`` are CTEs ending in fe (o, feature), tn (o, row_id) and ev (o, part, row_id) over sg.
    """
    cuts = ", ".join(f"CAST({k} AS DOUBLE) / 31" for k in range(1, 31))
    values = " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, {f} AS x FROM sg" for f in MODEL_NUMBERS)
    return f"""{_SIGNAL}, {members}, va AS ({values}), tx AS (SELECT tn.o AS o, feature, row_id, x FROM tn JOIN fe ON fe.o = tn.o JOIN va USING (feature, row_id)),
tq AS (SELECT o, feature, x, row_number() OVER (PARTITION BY o, feature ORDER BY x) AS rk, count(*) OVER (PARTITION BY o, feature) AS nx FROM tx WHERE x IS NOT NULL),
ta AS (SELECT o, feature, list(x) AS e FROM (SELECT DISTINCT o, feature, x FROM tq JOIN (SELECT unnest([{cuts}]) AS q) ON rk = greatest(1, CAST(ceil(q * nx) AS BIGINT))) GROUP BY 1, 2),
mu AS (SELECT o, avg(target) AS q FROM tn JOIN sg USING (row_id) GROUP BY o), tb AS (SELECT o, feature, row_id, CASE WHEN x IS NULL THEN 0 ELSE len(list_filter(e, lambda v: v < x)) + 1 END AS b FROM tx JOIN ta USING (o, feature)),
hi AS (SELECT o, feature, b, CAST(count(*) AS DOUBLE) AS n, sum(target - q) AS g, count(*) * any_value(q * (1 - q)) AS h FROM tb JOIN sg USING (row_id) JOIN mu USING (o) GROUP BY 1, 2, 3),
to_ AS (SELECT o, feature, sum(n) AS n, sum(g) AS g, sum(h) AS h, max(b) AS top, sum(n) FILTER (b = 0) AS nm FROM hi GROUP BY 1, 2),
op AS (SELECT c.o AS o, c.feature AS feature, c.b AS cut, ml FROM hi c JOIN to_ USING (o, feature) CROSS JOIN (SELECT unnest([false, true]) AS ml) WHERE c.b > 0 AND (c.b < top OR (nm > 0 AND NOT ml)) AND (NOT ml OR nm > 0)),
sd AS (SELECT op.o AS o, op.feature AS feature, cut, ml, sum(hi.n) AS ln, sum(hi.g) AS lg, sum(hi.h) AS lh FROM op JOIN hi ON hi.o = op.o AND hi.feature = op.feature AND ((hi.b > 0 AND hi.b <= cut) OR (hi.b = 0 AND ml)) GROUP BY 1, 2, 3, 4),
gn AS (SELECT sd.*, to_.g AS g, to_.h AS h, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM sd JOIN to_ USING (o, feature) WHERE ln >= 20 AND n - ln >= 20),
be AS (SELECT * FROM gn QUALIFY row_number() OVER (PARTITION BY o ORDER BY gain DESC, feature, cut, ml) = 1),
pr AS (SELECT be.o AS o, part, row_id, CASE WHEN (x IS NULL AND ml) OR (x IS NOT NULL AND len(list_filter(e, lambda v: v < x)) + 1 <= cut) THEN lg / (lh + 1) ELSE (g - lg) / (h - lh + 1) END AS p FROM be JOIN ev USING (o) JOIN va USING (feature, row_id) JOIN ta USING (o, feature)),
pl AS (SELECT o, part, target AS y, p FROM pr JOIN sg USING (row_id)), {_rank_sql('pl', 'o, part')}, au AS (SELECT o, part, auc FROM r)"""


_EACH = f"(SELECT unnest([{', '.join(repr(f) for f in MODEL_NUMBERS)}]) AS feature)"
_BY_FOLD = f"fo AS (SELECT DISTINCT fold AS o FROM sf), fe AS (SELECT o, feature FROM fo CROSS JOIN {_EACH}), tn AS (SELECT o, row_id FROM sf JOIN fo ON fold <> o), ev AS (SELECT fold AS o, 'valid' AS part, row_id FROM sf)"
_PARTS = "tp AS (SELECT *, CASE WHEN date >= TIMESTAMP '2000-01-01' THEN 'test' WHEN rk <= round_even(cn * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY target, date < TIMESTAMP '2000-01-01' ORDER BY md5('42|' || row_id), row_id) AS rk, count(*) OVER (PARTITION BY target, date < TIMESTAMP '2000-01-01') AS cn FROM sg))"


@query(_stumps_sql(_BY_FOLD) + " SELECT CAST(o AS INT) AS fold, round(auc, 9) AS score FROM au")
def cv_scores_of_stumps(spark, d):
    from riskloom.operators import models

    cv = models.cross_validate(_folds(spark, d), "target", list(MODEL_NUMBERS), model=_stump(), segment="segment")
    return spark.createDataFrame([(k, round(s, 9)) for k, s in enumerate(cv.scores)], "fold int, score double")


@query(_stumps_sql(f"{_PARTS}, fe AS (SELECT 0 AS o, feature FROM {_EACH}), tn AS (SELECT 0 AS o, row_id FROM tp WHERE part = 'train'), ev AS (SELECT 0 AS o, part, row_id FROM tp)") + " SELECT part, round(auc, 9) AS score FROM au")
def train_scores_of_a_stump(spark, d):
    from riskloom.operators import models

    fitted = models.train_model(_split(spark, d), list(MODEL_NUMBERS), _stump())
    return spark.createDataFrame([(k, round(v, 9)) for k, v in fitted.scores_.items()], "part string, score double")


@query(_stumps_sql(f"{_PARTS}, si AS (SELECT unnest([300, 600]) AS o), fe AS (SELECT o, feature FROM si CROSS JOIN {_EACH}), ot AS (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS rk FROM tp WHERE part = 'train'), tn AS (SELECT o, row_id FROM ot JOIN si ON rk <= o), ev AS (SELECT o, part, row_id FROM tp CROSS JOIN si WHERE part = 'val')") + " SELECT CAST(o AS INT) AS size, round(auc, 9) AS score FROM au")
def sample_size_of_stumps(spark, d):
    from riskloom.operators import models

    t = models.sample_size_curve(_split(spark, d), list(MODEL_NUMBERS), [300, 600], model=_stump())
    return rounded(t.select("size", "score"), 9)


_SETS = "ms AS (SELECT unnest([0, 1, 2]) AS o), fe AS (SELECT o, 'discount' AS feature FROM ms UNION ALL SELECT 1, 'quantity' UNION ALL SELECT 2, 'price'), tn AS (SELECT o, row_id FROM tp CROSS JOIN ms WHERE part = 'train'), ev AS (SELECT o, part, row_id FROM tp CROSS JOIN ms WHERE part <> 'test')"


@query(_stumps_sql(f"{_PARTS}, {_SETS}") + ", pv AS (SELECT o, max(auc) FILTER (part = 'train') AS t, max(auc) FILTER (part = 'val') AS v FROM au GROUP BY o) SELECT CASE o WHEN 0 THEN 'BASE' WHEN 1 THEN 'quantity' ELSE 'price' END AS added, round(t, 9) AS train, round(v, 9) AS valid, round(t - (SELECT t FROM pv WHERE o = 0), 9) AS delta_train, round(v - (SELECT v FROM pv WHERE o = 0), 9) AS delta_valid FROM pv")
def forward_addition_of_stumps(spark, d):
    from riskloom.operators import wrappers

    s = _split(spark, d)
    return rounded(wrappers.forward_addition(s.train, s.val, "target", ["discount"], ["quantity", "price"], model=_stump()).table, 9)


# --- helpers that other operators are made of ---------------------------------------------------


@query(f"{OBS} SELECT row_id, CASE WHEN code IN ('nan', 'NaN', 'None', 'null', 'NULL', '') THEN NULL ELSE TRY_CAST(code AS DOUBLE) END AS code, price, CAST(target AS DOUBLE) AS target, priority, date_diff('day', CAST(date AS DATE), DATE '2000-01-01') AS days_since, CASE WHEN priority IS NULL THEN NULL ELSE 'categorical' END AS kind FROM obs")
def numeric_frame(spark, d):
    t = observations(spark, d).select("row_id", "code", "price", "target", "priority", "date")
    numbers, texts = C.split_feature_types(t, ["code", "price", "priority"])
    t = C.to_numeric_frame(t, ["code", "price", "target", "priority"], texts)
    kind = F.when(F.col("priority").isNotNull(), F.lit("categorical" if texts == ["priority"] and numbers == ["code", "price"] else "wrong"))
    return t.withColumn("days_since", C.days_between(F.lit("2000-01-01"), F.col("date").cast("string"))).withColumn("kind", kind).drop("date")


@query(f"{OBS} SELECT row_id, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT row_id, greatest(least(CASE WHEN row_id % 50 = 0 THEN 0 WHEN row_id % 50 = 1 THEN 1 ELSE score END, 1 - 1e-15), 1e-15) AS p FROM obs)")
def prob_to_logit(spark, d):
    p = F.when(F.col("row_id") % 50 == 0, 0.0).when(F.col("row_id") % 50 == 1, 1.0).otherwise(F.col("score"))
    return observations(spark, d).select("row_id", F.round(C.prob_to_logit(p), 6).alias("logit"))


@query(f"{OBSR}, {_greedy_sql('obs', 'quantity', 10)}, pl AS (SELECT {_GB} AS bucket, target AS y FROM obs), {_woe_sql('pl', 'bucket')} SELECT round(sum(iv), 9) AS iv FROM wi")
def information_value(spark, d):
    return rounded(stability.information_value(observations(spark, d), "quantity", "target"), 9)


@query(f"{OBSR}, {_greedy_sql('obs', 'quantity', 6)}, pl AS (SELECT {_GB} AS bucket, quantity FROM obs) SELECT bucket, round(min(quantity), 6) AS least, round(max(quantity), 6) AS largest, CASE WHEN bucket = -1 THEN 'quantity is null' END AS label FROM pl GROUP BY bucket")
def bucket_ranges(spark, d):
    t = stability.bucket_ranges(stability.quantile_buckets(observations(spark, d), "quantity", 6), "quantity")
    text = F.format_string("quantity in [%.4g, %.4g]", "least", "largest")
    return rounded(t.withColumn("label", F.when(F.col("label") == text, F.lit(None)).otherwise(F.col("label"))))


@query(f"{OBS}, " + _psi_sql(f"SELECT priority, count(*) FILTER ({_SPLIT}) AS expected, count(*) FILTER (NOT {_SPLIT}) AS actual FROM obs GROUP BY 1") + " SELECT round(sum((sa - es) * ln(sa / es)), 9) AS psi FROM ps")
def psi_from_counts(spark, d):
    t = observations(spark, d)
    counts = lambda x: x.groupBy(F.col("priority").alias("bin")).agg(F.count("*").alias("n"))
    return rounded(stability.psi_from_counts(counts(t.filter(_SPLIT)), counts(t.filter(f"NOT {_SPLIT}"))), 9)


_SPF = ("price", "acctbal", "n_lines")
_SPR = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0 END AS {c}" for c in _SPF)


@query(f"{OBS}, rk AS (SELECT {_SPR} FROM obs) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr_sql(a, b)}, 6) AS corr FROM rk" for k, a in enumerate(_SPF) for b in _SPF[k + 1 :]))
def corr_spearman(spark, d):
    return rounded(selection.correlation_matrix(observations(spark, d), list(_SPF), "spearman"), 6)


@query(f"{OBS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr_sql(a, b)}, 6) AS corr FROM obs" for k, a in enumerate(_CF) for b in _CF[k + 1 :]))
def corr_by_products(spark, d):
    return rounded(selection.correlation_matrix(observations(spark, d), list(_CF), chunk=0), 6)


_TS = "ts AS (SELECT *, CASE WHEN date >= TIMESTAMP '2000-01-01' THEN 'test' WHEN rk <= round_even(cn * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY target, date < TIMESTAMP '2000-01-01' ORDER BY md5('42|' || row_id), row_id) AS rk, count(*) OVER (PARTITION BY target, date < TIMESTAMP '2000-01-01') AS cn FROM obs))"


@query(f"{OBS}, {_TS} SELECT part, count(*) AS n, round(sum(price), 2) AS price, CAST(sum(target) AS BIGINT) AS n_target FROM ts WHERE part <> 'train' GROUP BY part")
def eval_sets(spark, d):
    s = splits.time_split(observations(spark, d), "target", "date", "row_id", "2000-01-01")
    sets = s.eval_sets()
    parts = [s.xy(name, ["price"]).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"), F.sum("target").cast("long").alias("n_target")) for name in sets]
    return parts[0].union(parts[1])


@query(f"{OBS}, {_TS} SELECT part, count(*) AS n, count(DISTINCT row_id) AS n_keys, CAST(sum(row_id) AS BIGINT) AS ids FROM ts GROUP BY part")
def split_parts_are_disjoint(spark, d):
    s = splits.time_split(observations(spark, d), "target", "date", "row_id", "2000-01-01")
    s.check("row_id")
    return s.labeled().groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_keys"), F.sum("row_id").alias("ids"))


@query(f"{OBS}, r AS (SELECT *, {_RANK} FROM obs), a AS (SELECT count(*) AS al FROM obs) SELECT row_id FROM r, a WHERE rk <= round_even(cn * least(CAST(1 AS DOUBLE), CAST(700 AS DOUBLE) / al), 0)")
def stratified_cap(spark, d):
    return splits.stratified_cap(observations(spark, d), "target", "row_id", 700).select("row_id")


@query(f"{OBS}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS rk, count(*) OVER () AS cn FROM obs) SELECT row_id, CASE WHEN rk <= round_even(cn * CAST(0.2 AS DOUBLE), 0) THEN 0 ELSE -1 END AS fold FROM r")
def holdout_fold(spark, d):
    return splits.make_folds(observations(spark, d), "target", "row_id", 1, stratify=False).select("row_id", "fold")


@query(f"{OBS}, {_rank_sql('obs', '', 'target', 'score')}, ls AS (SELECT avg(-(target * ln(score) + (1 - target) * ln(1 - score))) AS logloss, avg((score - target) * (score - target)) AS brier FROM obs) SELECT unnest(['roc_auc', 'gini', 'ks', 'pr_auc', 'logloss', 'brier']) AS metric, unnest([round(auc, 9), round(2 * auc - 1, 9), round(ks, 9), round(pr_auc, 9), round(logloss, 9), round(brier, 9)]) AS value, unnest([true, true, true, true, false, false]) AS greater_is_better FROM r, ls")
def metric_registry(spark, d):
    t, parts = observations(spark, d), []
    for name in ("roc_auc", "gini", "ks", "pr_auc", "logloss", "brier"):
        m = ranking.get_metric(name)
        parts.append(m.func(t, "target", "score").select(F.lit(m.name).alias("metric"), F.round("value", 9).alias("value"), F.lit(m.greater_is_better).alias("greater_is_better")))
    from functools import reduce

    return reduce(DataFrame.union, parts)


@query(f"{OBS} SELECT segment, round(avg(abs(score - target)), 9) AS value FROM obs GROUP BY segment")
def custom_metric(spark, d):
    m = ranking.get_metric(lambda y, p: abs(y - p).mean())
    return rounded(m.func(observations(spark, d), "target", "score", ["segment"]), 9)


@query(f"{OBS} SELECT row_id, segment, price, quantity, target FROM obs")
def csv_round_trip(spark, d):
    import uuid

    from riskloom.plans.relational import shared_folder
    from riskloom.sources.tables import read_csv, write_csv

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(observations(spark, d).select("row_id", "segment", "price", "quantity", "target"), path)
    return read_csv(spark, path, "row_id long, segment string, price double, quantity double, target int")


@query(f"{OBS}, hb AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM obs), x AS (SELECT least(greatest(price, a), b) AS x FROM obs, hb), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), g AS (SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 10) AS l, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS r FROM e, range(10) t(i)), c AS (SELECT bin, count(x) AS n FROM g LEFT JOIN x ON x >= l AND (x < r OR bin = 9) GROUP BY bin) SELECT g.bin AS bin, round(l, 5) AS \"left\", round(r, 5) AS \"right\", n FROM g JOIN c USING (bin)")
def distribution(spark, d):
    return rounded(eda.distribution(observations(spark, d), "price", bins=10, log_scale=False)[0], 5)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS n_total, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, round(avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS rate FROM events WHERE ts IS NOT NULL GROUP BY 1")
def event_error_dynamics(spark, d):
    t = table(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(eda.target_dynamics(t, "ts", "y", freq="day").select("period", "n_total", "n_positive", "rate"), 9)
