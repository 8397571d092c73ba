"""Registered queries of the inference operators, and their SQL.

All tests use hash-keyed draws, so SQL can repeat them number by number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resampla import api
from resampla.functions import tails, text
from resampla.operators import bootstrap, confounding, linear, logistic, report, resample
from resampla.plans.frame import Moments, moments, outcome_kind, prepare
from resampla.sources import tables

X, Y, B, SEED = ["n_orders", "n_f", "balance"], "spend", 199, 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c, places: int = 6):
    return F.bround(c, places) + F.lit(0.0)  # no negative zero


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Moments]:
    frame = prepare(tables.customers(spark, sf_dir), "id", X, Y)
    return frame, moments(frame, [*X, Y])


def labelled(spark: SparkSession, sf_dir: str, features: list[str], target: str) -> tuple[DataFrame, Moments]:
    frame = prepare(tables.labelled(spark, sf_dir), "id", features, target)
    return frame, moments(frame, [*features, target])


# ---------------------------------------------------------------- SQL parts


def det(m: list[list[str]]) -> str:
    if not m:
        return "1.0"
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'}{m[0][j]}*({det([r[:j] + r[j + 1 :] for r in m[1:]])})" for j in range(len(m))]
    return "(" + "".join(parts).lstrip("+") + ")"


def cov(a: str, b: str) -> str:
    return "m.c_" + "_".join(sorted((a, b)))


def slopes(target: str, on: list[str]) -> list[str]:
    g = [[cov(a, b) for b in on] for a in on]
    return [f"({det([[cov(a, target) if j == i else g[k][j] for j in range(len(on))] for k, a in enumerate(on)])}/{det(g)})" for i in range(len(on))]


def fit_sql(target: str, on: list[str]) -> str:
    return f"(m.m_{target}" + "".join(f"+{b}*({c}-m.m_{c})" for b, c in zip(slopes(target, on), on)) + ")"


def resid(target: str, on: list[str]) -> str:
    return f"({target}-{fit_sql(target, on)})"


def rss(target: str, on: list[str]) -> str:
    return f"(m.n*({cov(target, target)}" + "".join(f"-{b}*{cov(c, target)}" for b, c in zip(slopes(target, on), on)) + "))"


CUST = """cust as (select c_custkey as id, coalesce(o.n_orders, 0.0) as n_orders, coalesce(o.avg_price, 0.0) as avg_price, coalesce(o.n_f, 0.0) as n_f,
  c_acctbal as acctbal, c_acctbal / 1000 as balance, coalesce(o.total, 0.0) / 1e6 as spend
  from customer left join (select o_custkey, count(*)::double as n_orders, avg(o_totalprice) as avg_price,
    sum(case when o_orderstatus = 'F' then 1.0::double else 0 end) as n_f, sum(o_totalprice) as total from orders group by o_custkey) o on o_custkey = c_custkey)"""
LBL = """lbl as (select doc_id as id, n_chars / 1000.0::double as k_chars, length(regexp_replace(text, '[^0-9]', '', 'g'))::double as n_dig,
  (lang = 'en')::int::double as is_en, quality::double as quality, toxic::double as toxic from labels join documents using (doc_id))"""


def frame_sql(source: str, columns: list[str], order: str = "id") -> str:
    pairs = ", ".join(f"covar_pop({a}, {b}) as c_{a}_{b}" for i, a in enumerate(sorted(columns)) for b in sorted(columns)[i:])
    return f"fr as (select row_number() over (order by {order}) as rid, * from {source}), m as (select count(*)::double as n, {', '.join(f'avg({c}) as m_{c}' for c in columns)}, {pairs} from fr)"


BASE = f"with {CUST}, {frame_sql('cust', [*X, Y])}"
REPS = f"reps as (select unnest(range(1, {B + 1})) as rep)"


PRIME, ROUNDS = resample.PRIME, resample.ROUNDS


def constants_sql(name: str, count: int, rounds: int = ROUNDS) -> str:
    """A row a replicate: lists of the shifts, factors and addends of its rounds."""
    d = f"md5(concat_ws(':', '{SEED}', '{name}', rep::varchar, i::varchar))"
    part = lambda at, size: f"('0x' || substr(d, {at}, {size}))::bigint"
    return f"select rep, list({part(1, 15)} order by i) as s, list({part(16, 8)} % {PRIME - 1} + 1 order by i) as a, list({part(24, 8)} % {PRIME} order by i) as b from (select rep, i, {d} as d from (select unnest(range(1, {count + 1})) as rep), (select unnest(range(0, {rounds})) as i)) group by rep"


def moves_sql(name: str, work: str, keep: str, out: str, count: int = B) -> str:
    """CTEs that end in ``out``: (rep, rid, pos, keep) of the rows of ``work`` in every replicate."""
    ctes = [f"{out}_0 as (select c.*, w.rid, w.rid - 1 as x, (select count(*) from {work}) as n, {keep} from {work} w, ({constants_sql(name, count)}) c)"]
    for i in range(1, ROUNDS + 1):
        y = f"(select *, ((s[{i}] % n - x) % n + n) % n as y from {out}_{i - 1})"
        h = f"(select *, (a[{i}] * (greatest(x, y) % {PRIME}) + b[{i}]) % {PRIME} as h from {y})"
        ctes.append(f"{out}_{i} as (select * exclude (x, y, h), case when ((h * h + b[{i}]) % {PRIME}) % 2 = 1 then y else x end as x from {h})")
    return ", ".join(ctes) + f", {out} as materialized (select * exclude (x, n, s, a, b), x + 1 as pos from {out}_{ROUNDS})"


def uniform_sql(pos: str) -> str:
    """A draw for each position, from the columns s, a, b of constants_sql with two rounds."""
    h = f"((a[1] * ({pos} % {PRIME}) + b[1]) % {PRIME})"
    return f"(((a[2] * (({h} * {h} + b[2]) % {PRIME}) + b[1]) % {PRIME}) / {PRIME}::double)"


def stars_sql(p: str) -> str:
    return f"round_even({p}, 3)::varchar || case when {p} < 0.01 then ' (**)' when {p} < 0.05 then ' (*)' else ' (ns)' end"


def integral_sql(f, top: str, points: int = 2000) -> str:
    """Simpson's rule over 0..top of ``f`` (SQL of x)."""
    weight = f"case when i = 0 or i = {points} then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(select sum(({weight}) * ({f('(i * top / ' + str(float(points)) + ')')})) * any_value(top) / {3 * points} from (select unnest(range(0, {points + 1})) as i, {top} as top))"


def t_tail_sql(t: str, df: str) -> str:
    f = lambda x: f"pow(1 + {x} * {x} / ({df}), -(({df}) + 1) / 2)"
    return f"greatest(0, 1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * {integral_sql(f, f'abs({t})')})"


def z_tail_sql(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {integral_sql(lambda x: f'exp(-{x} * {x} / 2)', f'abs({z})')})"


def f_tail_sql(f: str, one: str, two: str) -> str:
    a, b = f"(({one}) / 2.0::double)", f"(({two}) / 2.0::double)"
    beta = integral_sql(lambda x: f"2 * pow({x}, 2 * {a} - 1) * pow(1 - {x} * {x}, {b} - 1)", f"sqrt(({f}) * ({one}) / (({f}) * ({one}) + ({two})))")
    return f"greatest(0, 1 - exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {beta})"


# ---------------------------------------------------------------- sources, projections, outcomes


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1.0::double else 0.0 end as y from lineitem")
def recode_target(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", tables.recode(F.col("l_returnflag"), "R").alias("y"))


@query(f"with {CUST} select id, n_orders, round_even(avg_price, 7) as avg_price, n_f, acctbal, round_even(spend, 8) as spend from cust")
def customer_features(spark, sf_dir):
    c = tables.customers(spark, sf_dir)
    return c.select("id", "n_orders", F.bround("avg_price", 7).alias("avg_price"), "n_f", "acctbal", F.bround("spend", 8).alias("spend"))


@query(f"with {LBL} select id, k_chars, n_dig, is_en, quality, toxic from lbl")
def labelled_features(spark, sf_dir):
    return tables.labelled(spark, sf_dir)


@query(f"with {CUST} select id, n_orders, acctbal from cust")
def column_subset(spark, sf_dir):
    return tables.customers(spark, sf_dir).select("id", "n_orders", "acctbal")


@query(f"with {CUST}, fr as (select row_number() over (order by id) as rid, * from cust) select rid, n_f, balance, round_even(spend, 8) as spend, 1.0::double as intercept from fr")
def reduced_design(spark, sf_dir):
    rest = [c for c in X if c != "n_orders"]
    frame = prepare(tables.customers(spark, sf_dir), "id", X, Y)
    return frame.select("rid", *rest, F.bround(Y, 8).alias(Y), F.lit(1.0).alias("intercept"))


KINDS = {"spend": "cust", "n_orders": "cust", "quality": "lbl", "toxic": "lbl", "k_chars": "lbl"}


@query(f"with {CUST}, {LBL} " + " union all ".join(f"select '{c}' as outcome, count(distinct {c}) as n_distinct, count(distinct {c}) = 2 and bool_and({c} in (0, 1)) as is_binary, case when count(distinct {c}) = 2 and bool_and({c} in (0, 1)) then 'logistic' else 'linear' end as model_type from {t}" for c, t in KINDS.items()))
def detect_outcome_type(spark, sf_dir):
    frames = {"cust": tables.customers(spark, sf_dir), "lbl": tables.labelled(spark, sf_dir)}
    out = None
    for c, t in KINDS.items():
        binary = (F.count_distinct(c) == 2) & F.bool_and(F.col(c).isin(0.0, 1.0))
        one = frames[t].agg(F.lit(c).alias("outcome"), F.count_distinct(c).alias("n_distinct"), binary.alias("is_binary"), F.when(binary, "logistic").otherwise("linear").alias("model_type"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- correlations


PAIRS = [(a, b) for i, a in enumerate([*X, Y]) for b in [*X, Y][i + 1 :]]


@query(f"with {CUST} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round_even(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) as r from cust" for a, b in PAIRS))
def pearson_matrix(spark, sf_dir):
    row = tables.customers(spark, sf_dir).agg(*[confounding.pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(PAIRS)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(PAIRS)])).alias("x")).select("x.*")


@query(f"with {CUST}, r as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) as n, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) as r from cust" for a, b in PAIRS) + ") select a, b, round_even(r * sqrt((n - 2) / (1 - r * r)), 4) as t from r")
def pearson_t(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    rows = []
    for a, b in PAIRS:
        r = confounding.correlation(m, a, b)
        rows.append((a, b, float(r * math.sqrt((m.n - 2) / (1 - r * r)))))
    return spark.createDataFrame(rows, "a string, b string, t double").withColumn("t", r6("t", 4))


PEARSON = f"with {CUST}, r as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, count(*)::double as n, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) as r from cust" for a, b in PAIRS) + "), t as (select a, b, n, r * sqrt((n - 2) / (1 - r * r)) as t from r)"


@query(f"{PEARSON} select a, b, round_even({t_tail_sql('t.t', 't.n - 2')}, 6) as p from t")
def pearson_p(spark, sf_dir):
    """Two-sided p-values; the SQL integrates the density."""
    _, m = customers(spark, sf_dir)
    return spark.createDataFrame([(a, b, tails.pearson_p(confounding.correlation(m, a, b), m.n)) for a, b in PAIRS], "a string, b string, p double").withColumn("p", r6("p"))


# |t| at the 5 % level for v degrees of freedom, by the expansion around the normal quantile z
T_CRIT = "(z.z + (pow(z.z, 3) + z.z) / (4 * (n - 2)) + (5 * pow(z.z, 5) + 16 * pow(z.z, 3) + 3 * z.z) / (96 * pow(n - 2, 2)))"


def screen_sql(predictors: list[str], x: list[str] = X, y: str = Y, source: str = "cust") -> str:
    rows = " union all ".join(f"select '{p}' as predictor, '{c}' as feature, count(*) as n, corr({c}, {p}) as r, corr({c}, {y}) as s from {source}" for p in predictors for c in x if c != p)
    return f"sc as ({rows}), z as (select 1.959963984540054 as z), sr as (select predictor, feature, r, s, abs(r) >= 0.1 and abs(s) >= 0.1 and abs(r) * sqrt((n - 2) / (1 - r * r)) > {T_CRIT} and abs(s) * sqrt((n - 2) / (1 - s * s)) > {T_CRIT} as is_candidate from sc, z)"


@query(f"with {CUST}, {screen_sql(['n_orders'])} select predictor, feature, round_even(r, 6) as r_pred, round_even(s, 6) as r_out, is_candidate from sr")
def screen_confounders(spark, sf_dir):
    frame, _ = customers(spark, sf_dir)
    return confounding.screen(frame, X, Y, ["n_orders"]).select("predictor", "feature", r6("r_pred").alias("r_pred"), r6("r_out").alias("r_out"), "is_candidate")


# ---------------------------------------------------------------- least squares


@query(f"with {CUST} " + " union all ".join(f"select '{c}' as feature, round_even(regr_slope({Y}, {c}), 6) as slope, round_even(regr_intercept({Y}, {c}), 6) as intercept from cust" for c in X))
def ols_simple(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    fits = {c: m.fit(Y, [c]) for c in X}
    return spark.createDataFrame([(c, float(b[0]), float(a)) for c, (a, b) in fits.items()], "feature string, slope double, intercept double").select("feature", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(f"{BASE} " + " union all ".join(f"select '{c}' as feature, {i} as ordinal, round_even({b}, 6) as coef from m" for i, (c, b) in enumerate(zip(X, slopes(Y, X)))))
def ols_multi(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    return spark.createDataFrame([(c["feature"], c["ordinal"], c["coef"]) for c in linear.coefficients(m, X, Y)], "feature string, ordinal int, coef double").withColumn("coef", r6("coef"))


@query(f"""{BASE}, d as (select n, 3 as p, {rss(Y, X)} as rss, n * {cov(Y, Y)} as tss from m), l as (select *, -n / 2 * (ln(2 * pi() * rss / n) + 1) as llf from d)
select n::bigint as n_observations, p as n_features, round_even(1 - rss / tss, 4) as r_squared, round_even(1 - rss / tss * (n - 1) / (n - p - 1), 4) as r_squared_adj,
round_even((tss - rss) / p / (rss / (n - p - 1)), 4) as f_statistic, round_even(2 * (p + 1) - 2 * llf, 4) as aic, round_even((p + 1) * ln(n) - 2 * llf, 4) as bic from l""")
def ols_diagnostics(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    d = linear.diagnostics(m, X, Y)
    names = ["r_squared", "r_squared_adj", "f_statistic", "aic", "bic"]
    frame = spark.createDataFrame([(d["n_observations"], d["n_features"], *[float(d[k]) for k in names])], "n_observations long, n_features int, " + ", ".join(f"{k} double" for k in names))
    return frame.select("n_observations", "n_features", *[r6(k, 4).alias(k) for k in names])


def se_sql(i: int) -> str:
    g = [[cov(a, b) for b in X] for a in X]
    minor = [[c for j, c in enumerate(r) if j != i] for k, r in enumerate(g) if k != i]
    return f"sqrt({rss(Y, X)} / (m.n - {len(X) + 1}) * {det(minor)} / {det(g)} / m.n)"


@query(f"{BASE} " + " union all ".join(f"select '{c}' as feature, round_even({se_sql(i)}, 6) as se, round_even({slopes(Y, X)[i]} / {se_sql(i)}, 4) as stat from m" for i, c in enumerate(X)))
def classic_t_linear(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    return spark.createDataFrame([(c["feature"], c["se"], c["stat"]) for c in linear.coefficients(m, X, Y)], "feature string, se double, stat double").select("feature", r6("se").alias("se"), r6("stat", 4).alias("stat"))


T_ROWS = " union all ".join(f"select '{c}' as feature, m.n - {len(X) + 1} as df, {slopes(Y, X)[i]} / {se_sql(i)} as t, ({cov(Y, Y)} * m.n - {rss(Y, X)}) / {len(X)} / ({rss(Y, X)} / (m.n - {len(X) + 1})) as f from m" for i, c in enumerate(X))


@query(f"{BASE}, t as ({T_ROWS}), p as (select feature, {t_tail_sql('t.t', 't.df')} as p, {f_tail_sql('t.f', str(len(X)), 't.df')} as fp from t) select feature, round_even(p, 6) as p_classic, {stars_sql('p')} as p_classic_str, round_even(fp, 6) as f_p_value from p")
def classic_pvalues_linear(spark, sf_dir):
    """Classical p-values with marks, and that of F; the SQL integrates the densities."""
    _, m = customers(spark, sf_dir)
    f = linear.diagnostics(m, X, Y)["f_p_value"]
    rows = spark.createDataFrame([(c["feature"], c["p_classic"], text.marked(c["p_classic"], 3, 0.05, 0.01), float(f)) for c in linear.coefficients(m, X, Y)], "feature string, p_classic double, p_classic_str string, f_p_value double")
    return rows.withColumn("p_classic", r6("p_classic")).withColumn("f_p_value", r6("f_p_value"))


@query(f"{BASE} select rid, round_even({fit_sql(Y, ['n_f', 'balance'])}, 6) as fitted, round_even({resid(Y, ['n_f', 'balance'])}, 6) + 0.0 as residual from fr, m")
def residuals_reduced(spark, sf_dir):
    frame, m = customers(spark, sf_dir)
    return linear.fitted(frame, m, Y, ["n_f", "balance"]).select("rid", r6("fitted").alias("fitted"), r6("residual").alias("residual"))


@query(f"{BASE} select rid, round_even({fit_sql('n_orders', ['n_f'])}, 6) as fitted, round_even({resid('n_orders', ['n_f'])}, 6) + 0.0 as residual, round_even(n_orders - m.m_n_orders, 6) + 0.0 as centred from fr, m")
def exposure_residuals(spark, sf_dir):
    frame, m = customers(spark, sf_dir)
    a, b = linear.fitted(frame, m, "n_orders", ["n_f"]), linear.fitted(frame, m, "n_orders", [])
    return a.join(b.select("rid", F.col("residual").alias("centred")), "rid").select("rid", r6("fitted").alias("fitted"), r6("residual").alias("residual"), r6("centred").alias("centred"))


@query(f"{BASE} select rid, round_even({resid('n_orders', ['balance'])}, 6) + 0.0 as r_n_orders, round_even({resid('n_f', ['balance'])}, 6) + 0.0 as r_n_f from fr, m")
def exposure_residuals_multi(spark, sf_dir):
    from resampla.plans.frame import residual

    frame, m = customers(spark, sf_dir)
    return frame.select("rid", *[r6(residual(m, c, ["balance"])).alias(f"r_{c}") for c in ("n_orders", "n_f")])


@query(f"{BASE} select round_even({rss(Y, ['n_f'])}, 6) as rss_reduced, round_even({rss(Y, X)}, 6) as rss_full, round_even({rss(Y, ['n_f'])} - {rss(Y, X)}, 6) as improvement from m")
def rss_metric(spark, sf_dir):
    _, m = customers(spark, sf_dir)
    a, b = m.rss(Y, ["n_f"]), m.rss(Y, X)
    return spark.createDataFrame([(a, b, a - b)], "rss_reduced double, rss_full double, improvement double").select(*[r6(c).alias(c) for c in ("rss_reduced", "rss_full", "improvement")])


# ---------------------------------------------------------------- resampling


@query(f"with {CUST}, fr as (select row_number() over (order by id) as rid, * from cust), {moves_sql('n_orders', 'fr', 'round_even(spend, 8) as spend', 'p', 5)} select rep, rid, pos, spend from p")
def permute_residuals(spark, sf_dir):
    frame = prepare(tables.customers(spark, sf_dir), "id", X, Y)
    return resample.permuted(frame, frame.count(), 5, SEED, "n_orders", [Y]).select("rep", "rid", "pos", F.bround(Y, 8).alias(Y))


@query(f"with {CUST}, fr as (select row_number() over (order by id) as rid, * from cust), {moves_sql('joint', 'fr', 'n_orders, n_f', 'p', 5)} select rep, rid, pos, n_orders, n_f from p")
def permute_rows_joint(spark, sf_dir):
    frame = prepare(tables.customers(spark, sf_dir), "id", X, Y)
    return resample.permuted(frame, frame.count(), 5, SEED, "joint", ["n_orders", "n_f"]).select("rep", "rid", "pos", "n_orders", "n_f")



def boot_noise(x: str, y: str) -> str:
    """The hash of node x and serial y under a replicate's constants a, b."""
    h = f"((a[1] * (({x}) % {PRIME}) + b[1]) % {PRIME})"
    h = f"((a[2] * (({h} * {h} + {y}) % {PRIME}) + b[2]) % {PRIME})"
    for i in range(3, bootstrap.MIXES + 1):
        h = f"((a[{i}] * (({h} * {h} + b[{i}]) % {PRIME}) + b[{i - 1}]) % {PRIME})"
    return h


def boot_uniform(x: str, y: str) -> str:
    return f"(({boot_noise(x, f'2 * ({y})')} + {boot_noise(x, f'2 * ({y}) + 1')} / {PRIME}::double) / {PRIME}::double)"


BOOT_LEVELS = 12  # of the tree of row ranges: up to 500,000 rows


def boot_sql(count: int, rows: str = "fr") -> str:
    """CTEs that end in bi (rep, slot, rid), a row a draw: binomial splits of row ranges by transformed rejection, then single draws in each leaf."""
    leaf = bootstrap.LEAF
    ctes = [f"bc as materialized ({constants_sql('boot', count, bootstrap.MIXES)})", f"bt0 as (select rep, 1::bigint as node, 0::bigint as lo, (select count(*) from {rows}) as size, (select count(*) from {rows}) as m from bc)"]
    for i in range(BOOT_LEVELS):
        split = f"select t.*, a, b, (size // 2) / size::double as p from bt{i} t join bc using (rep) where size > {leaf}"
        wide = "select *, sqrt(m * p * (1 - p)) as spread, floor((m + 1) * p) as mode from b0"
        tries = f"select *, 1.15 + 2.53 * spread as bb, {boot_uniform('node', '2 * t')} - 0.5 as u, {boot_uniform('node', '2 * t + 1')} as v from b1, (select unnest(range(0, 24)) as t)"
        shape = "select *, -0.0873 + 0.0248 * bb + 0.01 * p as aa, 0.5 - abs(u) as us from b2"
        k = "select *, floor((2 * aa / us + bb) * u + m * p + 0.5) as k from b3"
        far = "ln(v * (2.83 + 5.1 / bb) * spread / (aa / (us * us) + bb)) <= lgamma(mode + 1) + lgamma(m - mode + 1) - lgamma(k + 1) - lgamma(m - k + 1) + (k - mode) * ln(p / (1 - p))"
        ctes.append(
            f"bs{i} as materialized (with b0 as ({split}), b1 as ({wide}), b2 as ({tries}), b3 as ({shape}), b4 as ({k}) "
            f"select rep, node, any_value(lo) as lo, any_value(size) as size, any_value(m) as m, arg_min(k, t)::bigint as l from b4 where case when k < 0 or k > m then false when us >= 0.07 and v <= 0.92 - 4.2 / bb then true else {far} end group by rep, node)")
        ctes.append(
            f"bt{i + 1} as (select * from bt{i} where size <= {leaf} union all select rep, 2 * node, lo, size // 2, l from bs{i} "
            f"union all select rep, 2 * node + 1, lo + size // 2, size - size // 2, m - l from bs{i})")
    ctes.append(f"bi as materialized (select rep, lo + floor({boot_uniform('node', 'k')} * size)::bigint + 1 as rid from (select t.*, a, b, unnest(range(0, m)) as k from bt{BOOT_LEVELS} t join bc using (rep)))")
    return ", ".join(ctes)


@query(f"with {CUST}, fr as (select row_number() over (order by id) as rid, * from cust), {boot_sql(5)} select rep, rid, count(*) as times from bi group by rep, rid")
def bootstrap_indices(spark, sf_dir):
    """How often each replicate drew each row."""
    frame = prepare(tables.customers(spark, sf_dir), "id", X, Y)
    return bootstrap.drawn(frame, frame.count(), 5, SEED)


@query(f"with {LBL}, fr as (select row_number() over (order by id) as rid, * from lbl), c as ({constants_sql('k_chars:draw', 3, 2)}), {moves_sql('k_chars', 'fr', 'k_chars', 'p', 3)} select rep, rid, pos, ({uniform_sql('pos')} < least(greatest(k_chars / 10, 0.001), 0.999))::int::double as y from p join c using (rep)")
def bernoulli_outcome(spark, sf_dir):
    frame = prepare(tables.labelled(spark, sf_dir), "id", ["k_chars"], "quality")
    rows = resample.permuted(frame, frame.count(), 3, SEED, "k_chars", ["k_chars"], "k_chars:draw")
    return rows.select("rep", "rid", "pos", resample.bernoulli(F.col("k_chars") / 10, F.col("u")).alias("y"))


# ---------------------------------------------------------------- permutation tests, linear


def run_test(spark, sf_dir, method: str, confounders=(), features=None, target=Y, source=tables.customers, count: int = B) -> api.PermutationTest:
    return api.PermutationTest(source(spark, sf_dir), "id", features or X, target, method, list(confounders), count, SEED, plan="rows")


def coefficient_rows(test: api.PermutationTest) -> DataFrame:
    t = test.coefficient_table()
    return t.select("feature", "ordinal", r6("coef").alias("coef"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exceed", "n_perm")], r6("p_emp").alias("p_emp"), "p_emp_str")


def exceed_sql(c: str, i: int, masked: bool = False, x: list[str] = X, y: str = Y) -> str:
    coef = f"(select {slopes(y, x)[i]} from m)"
    if masked:
        return f"select '{c}' as feature, {i} as ordinal, round_even({coef}, 6) as coef, 0::bigint as n_exceed, 0::bigint as n_perm, null::double as p_emp, '{text.MASKED}' as p_emp_str"
    inner = f"select count(*) filter (abs(stat) >= abs({coef}) * (1 - 1e-9)) as b, count(*) as k from s_{c}"
    return f"select '{c}' as feature, {i} as ordinal, round_even({coef}, 6) as coef, b as n_exceed, k as n_perm, round_even((b + 1) / (k + 1), 6) as p_emp, {stars_sql('((b + 1) / (k + 1))')} as p_emp_str from ({inner})"


def braak_sql(x: list[str] = X, y: str = Y, count: int = B) -> str:
    ctes = []
    for c in x:
        rest = [o for o in x if o != c]
        ctes.append(f"w_{c} as materialized (select rid, {resid(y, rest)} as e, {resid(c, rest)} as x from fr, m), {moves_sql(c, f'w_{c}', 'w.e', f'p_{c}', count)}, s_{c} as (select rep, sum(w.x * p.e) / (select sum(x * x) from w_{c}) as stat from p_{c} p join w_{c} w on w.rid = p.pos group by rep)")
    return ", ".join(ctes)


@query(f"{BASE}, {braak_sql()} " + " union all ".join(exceed_sql(c, i) for i, c in enumerate(X)))
def ter_braak_linear(spark, sf_dir):
    return coefficient_rows(run_test(spark, sf_dir, "ter_braak"))


def kennedy_sql(z: list[str], x: list[str] = X, y: str = Y, count: int = B) -> str:
    """Of three features."""
    ctes = []
    for c in x:
        if c in z:
            continue
        a, b = [o for o in x if o != c]
        ctes.append(
            f"w_{c} as materialized (select rid, {resid(c, z)} as r, {resid(y, [a, b])} as e, {resid(a, [])} as q0, {resid(b, [a])} as q1 from fr, m), {moves_sql(c, f'w_{c}', 'w.r', f'p_{c}', count)}, k_{c} as (select sum(r * r) as rr, sum(q0 * q0) as n0, sum(q1 * q1) as n1 from w_{c}), "
            f"s_{c} as (select rep, sum(w.e * p.r) / ((select rr from k_{c}) - pow(sum(w.q0 * p.r), 2) / (select n0 from k_{c}) - pow(sum(w.q1 * p.r), 2) / (select n1 from k_{c})) as stat from p_{c} p join w_{c} w on w.rid = p.pos group by rep)")
    return ", ".join(ctes)


@query(f"{BASE}, {kennedy_sql([])} " + " union all ".join(exceed_sql(c, i) for i, c in enumerate(X)))
def kennedy_linear(spark, sf_dir):
    return coefficient_rows(run_test(spark, sf_dir, "kennedy"))


@query(f"{BASE}, {kennedy_sql(['n_f'])} " + " union all ".join(exceed_sql(c, i, c == "n_f") for i, c in enumerate(X)))
def kennedy_linear_confounders(spark, sf_dir):
    return coefficient_rows(run_test(spark, sf_dir, "kennedy", ["n_f"]))


def joint_rows_sql(obs: str, metric: str, kind: str, tested: list[str], z: list[str]) -> str:
    """From i (v: the improvement of each replicate) and ``obs``, the observed one."""
    return f"o as ({obs}), b as (select count(*) filter (v >= ob - 1e-9 * greatest(1, abs(ob))) as b, count(*) as k from i, o) select round_even(any_value(ob), 6) as observed_improvement, any_value(b) as n_exceed, any_value(k) as n_perm, round_even((any_value(b) + 1) / (any_value(k) + 1), 6) as p_value, {stars_sql('((any_value(b) + 1) / (any_value(k) + 1))')} as p_value_str, '{metric}' as metric_type, '{kind}' as model_type, '{', '.join(tested)}' as features_tested, '{', '.join(z)}' as confounders from b, o"


def joint_sql(z: list[str]) -> str:
    t = [c for c in X if c not in z]
    k, q = len(t), len(z)
    basis = [f"{resid(c, z[:i])} as q{i}" for i, c in enumerate(z)]
    values = ", ".join([f"{resid(Y, z)} as y", *[f"{resid(c, z)} as x{i}" for i, c in enumerate(t)], *basis])
    work = f"w as materialized (select rid, {values} from fr, m), {moves_sql('joint', 'w', ', '.join(f'w.x{i}' for i in range(k)), 'p')}"
    gram = "g as (select " + ", ".join([f"sum(x{i} * x{j}) as g{i}{j}" for i in range(k) for j in range(k)] + [f"sum(q{a} * q{a}) as n{a}" for a in range(q)]) + " from w)"
    sums = "u as (select rep, " + ", ".join([f"sum(w.y * p.x{i}) as c{i}" for i in range(k)] + [f"sum(w.q{a} * p.x{i}) as a{a}{i}" for a in range(q) for i in range(k)]) + " from p join w on w.rid = p.pos group by rep)"
    inner = [["(g%d%d%s)" % (i, j, "".join(f" - a{a}{i} * a{a}{j} / n{a}" for a in range(q))) for j in range(k)] for i in range(k)]
    solved = " + ".join(f"c{i} * {det([[f'c{r}' if col == i else inner[r][col] for col in range(k)] for r in range(k)])}" for i in range(k))
    improvement = f"i as (select ({solved}) / {det(inner)} as v from u, g)"
    return f"{BASE}, {work}, {gram}, {sums}, {improvement}, " + joint_rows_sql(f"select {rss(Y, z) if z else f'm.n * {cov(Y, Y)}'} - {rss(Y, X)} as ob from m", "RSS Reduction", "linear", t, z)


def joint_columns(test: api.PermutationTest) -> DataFrame:
    t = test.joint_table()
    return t.select(r6("observed_improvement").alias("observed_improvement"), "n_exceed", "n_perm", r6("p_value").alias("p_value"), "p_value_str", "metric_type", "model_type", F.array_join("features_tested", ", ").alias("features_tested"), F.array_join("confounders", ", ").alias("confounders"))


@query(joint_sql(["balance"]))
def kennedy_joint_linear(spark, sf_dir):
    return joint_columns(run_test(spark, sf_dir, "kennedy_joint", ["balance"]))


@query(joint_sql([]))
def kennedy_joint_linear_all(spark, sf_dir):
    """Without confounders: the exposure model is the mean alone."""
    return joint_columns(run_test(spark, sf_dir, "kennedy_joint"))


@query(f"{BASE}, {braak_sql()} " + " union all ".join(exceed_sql(c, i) for i, c in enumerate(X)))
def ter_braak_replicates(spark, sf_dir):
    """The same test by the replicate-parallel plan, from the same draws."""
    return coefficient_rows(api.PermutationTest(tables.customers(spark, sf_dir), "id", X, Y, "ter_braak", None, B, SEED, plan="replicates"))


PART_P = "select p_partkey, (count(*) filter (abs(l_discount - 0.05) >= 0.04 * (1 - 1e-9)) + 1) / (count(*) + 1)::double as p from lineitem join part on l_partkey = p_partkey group by p_partkey"


@query(f"with p as ({PART_P}) select p_partkey, round_even(p, 6) as p, {stars_sql('p')} as marked from p")
def significance_stars(spark, sf_dir):
    """Marks of one p-value a part: how often the discounts of its order lines are far from 5 %."""
    line, part = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "part").select("p_partkey")
    t = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.count_if(resample.exceeds(F.col("l_discount") - 0.05, F.lit(0.04))).alias("b"), F.count("*").alias("k"))
    t = t.withColumn("p", resample.p_value(F.col("b"), F.col("k")))
    return t.select("p_partkey", r6("p").alias("p"), text.marked_column(F.col("p"), 3, 0.05, 0.01).alias("marked"))


@query("select l_returnflag as grp, count(*) filter (abs(l_discount - 0.05) >= 0.03 * (1 - 1e-9)) as n_exceed, count(*) as n_perm, round_even((count(*) filter (abs(l_discount - 0.05) >= 0.03 * (1 - 1e-9)) + 1) / (count(*) + 1), 6) as p_emp from lineitem group by l_returnflag")
def empirical_pvalues(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"))
    t = line.agg(F.count_if(resample.exceeds(F.col("l_discount") - 0.05, F.lit(0.03))).alias("n_exceed"), F.count("*").alias("n_perm"))
    return t.withColumn("p_emp", r6(resample.p_value(F.col("n_exceed"), F.col("n_perm"))))


# ---------------------------------------------------------------- mediation and confounders


def paths_sql(x: str, z: str, y: str) -> dict[str, str]:
    c = lambda a, b: f"covar_samp({a}, {b})"
    low = f"nullif({c(x, x)} * {c(z, z)} - pow({c(x, z)}, 2), 0)"
    return {"total": f"{c(x, y)} / nullif({c(x, x)}, 0)", "a": f"{c(x, z)} / nullif({c(x, x)}, 0)", "b": f"({c(z, y)} * {c(x, x)} - {c(x, y)} * {c(x, z)}) / {low}", "direct": f"({c(x, y)} * {c(z, z)} - {c(z, y)} * {c(x, z)}) / {low}"}


def mediation_sql(pairs: list[tuple[str, str]], name: str = "md", y: str = Y) -> str:
    parts = []
    for x, z in pairs:
        e = paths_sql(x, z, y)
        boot = f"select ({e['a']}) * ({e['b']}) as i from bi join fr using (rid) group by rep"
        parts.append(f"select '{x}' as predictor, '{z}' as mediator, p.*, q.lo, q.hi from (select {', '.join(f'{v} as {k}' for k, v in e.items())} from fr) p, (select quantile_cont(i, 0.025) as lo, quantile_cont(i, 0.975) as hi from ({boot})) q")
    fill = lambda t: "replace(replace('" + t.replace("'", "''") + "', '{m}', mediator), '{p}', predictor)"
    say = f"case when (lo > 0 or hi < 0) and abs(direct) < abs(total) * 0.1 then {fill(text.FULL)} when lo > 0 or hi < 0 then {fill(text.PARTIAL)} else {fill(text.NEITHER)} end"
    return f"{name} as (select *, a * b as indirect, coalesce(lo > 0 or hi < 0, false) as is_mediator, case when abs(total) > 1e-10 then a * b / total end as share, {say} as interpretation from ({' union all '.join(parts)}))"


FR = f"with {CUST}, fr as (select row_number() over (order by id) as rid, * from cust), {boot_sql(B)}"
MED_SELECT = "select predictor, mediator, round_even(total, 4) as total_effect, round_even(direct, 4) as direct_effect, round_even(a, 4) as a_path, round_even(b, 4) as b_path, round_even(indirect, 4) as indirect_effect, round_even(lo, 4) as ci_lower, round_even(hi, 4) as ci_upper, is_mediator, round_even(share, 4) as proportion_mediated, interpretation from md"


@query(f"{FR}, {mediation_sql([('n_f', 'n_orders'), ('n_orders', 'n_f')])} {MED_SELECT}")
def mediation(spark, sf_dir):
    frame, m = customers(spark, sf_dir)
    t = confounding.mediate(frame, m, Y, [("n_f", "n_orders"), ("n_orders", "n_f")], B, 0.95, SEED)
    return t.select(*[F.bround(c, 4).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


@query(f"with {CUST}, e as (select {', '.join(f'{v} as {k}' for k, v in paths_sql('n_f', 'n_orders', Y).items())} from cust) select round_even(total, 6) as total_effect, round_even(direct, 6) as direct_effect, round_even(a, 6) as a_path, round_even(b, 6) as b_path, round_even(direct + a * b - total, 6) + 0.0 as gap from e")
def mediation_point(spark, sf_dir):
    e = confounding.paths("n_f", "n_orders", Y)
    row = tables.customers(spark, sf_dir).agg(*[v.alias(k) for k, v in e.items()])
    return row.select(r6("total").alias("total_effect"), r6("direct").alias("direct_effect"), r6("a").alias("a_path"), r6("b").alias("b_path"), r6(F.col("direct") + F.col("a") * F.col("b") - F.col("total")).alias("gap"))


@query(f"{FR}, {mediation_sql([('n_f', 'n_orders')])} select round_even(lo, 4) as ci_lower, round_even(hi, 4) as ci_upper, is_mediator from md")
def mediation_bootstrap_ci(spark, sf_dir):
    frame, m = customers(spark, sf_dir)
    return confounding.mediate(frame, m, Y, [("n_f", "n_orders")], B, 0.95, SEED).select(F.bround("ci_lower", 4).alias("ci_lower"), F.bround("ci_upper", 4).alias("ci_upper"), "is_mediator")


def identify_sql(predictors: list[str], x: list[str] = X, y: str = Y, source: str = "cust", rows: str = FR) -> str:
    pairs = [(p, c) for p in predictors for c in x if c != p]
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(x))
    lists = "select sr.predictor, " + ", ".join(f"coalesce(string_agg(case when is_candidate and is_mediator = {flag} then feature end, ',' order by o.i), '') as {name}" for flag, name in (("false", "identified_confounders"), ("true", "identified_mediators")))
    q = lambda t: "replace('" + t.replace("'", "''") + "', '{p}', predictor)"
    advice = f"case when identified_confounders = '' then {q(text.NO_CONTROL)} else replace({q(text.CONTROL)}, '{{c}}', '''' || replace(identified_confounders, ',', ''', ''') || '''') end as recommendation"
    return f"{rows}, {mediation_sql(pairs, y=y)}, {screen_sql(predictors, x, y, source)}, o(c, i) as (values {order}), li as ({lists} from sr join md on md.predictor = sr.predictor and md.mediator = sr.feature join o on o.c = sr.feature group by sr.predictor) select predictor, identified_confounders, identified_mediators, {advice} from li"


def identified(frame: DataFrame, m: Moments, x: list[str], y: str, predictors: list[str]) -> DataFrame:
    summary, _, _ = confounding.identify(frame, m, x, y, predictors, count=B, seed=SEED)
    return summary.select("predictor", *[F.array_join(c, ",").alias(c) for c in ("identified_confounders", "identified_mediators")], "recommendation")


@query(identify_sql(["n_orders"]))
def identify_confounders(spark, sf_dir):
    return identified(*customers(spark, sf_dir), X, Y, ["n_orders"])


@query(identify_sql(X))
def identify_all(spark, sf_dir):
    return identified(*customers(spark, sf_dir), X, Y, X)


@query(f"with i as ({identify_sql(X)}) select predictor, identified_confounders from i where identified_confounders <> ''")
def predictors_with_confounders(spark, sf_dir):
    return identified(*customers(spark, sf_dir), X, Y, X).where("identified_confounders <> ''").select("predictor", "identified_confounders")


@query()
def kennedy_with_found_confounders(spark, sf_dir):
    """Sweep, first flagged predictor, Kennedy's test with its confounders; the report as rows."""
    return found_lines(spark, tables.customers(spark, sf_dir), X, Y)


def found_lines(spark, source: DataFrame, x: list[str], y: str) -> DataFrame:
    r = api.kennedy_with_found_confounders(source, "id", x, y, B, B, SEED, plan="rows")
    said = report.coefficient_report(r, x, y, text.FOUND_TITLE.format(p=r["predictor"], c=r["confounders"], k=r["model_type"].capitalize())) if r else "No confounders identified for any predictor."
    return as_lines(spark, said)


def as_lines(spark, said: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(said.split("\n"))), "line int, text string")


@query()
def confounder_report(spark, sf_dir):
    return as_lines(spark, report.confounder_report(api.identify_all(tables.customers(spark, sf_dir), "id", X, Y, n_bootstrap=B, random_state=SEED)))


# ---------------------------------------------------------------- logistic


def newton_sql(steps: int = 12) -> str:
    out = ["b0 as (select 0.0::double as a, 0.0::double as b)"]
    for i in range(steps):
        out.append(
            f"h{i} as (select any_value(a) as a, any_value(b) as b, sum(quality - p) as g0, sum((quality - p) * x) as g1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11 from (select a, b, k_chars as x, quality, 1 / (1 + exp(-(a + b * k_chars))) as p from fr, b{i})), "
            f"b{i + 1} as materialized (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from h{i})")
    return f"with {LBL}, fr as materialized (select * from lbl), " + ", ".join(out) + f", e as (select a, b, k_chars as x, quality as y, 1 / (1 + exp(-(a + b * k_chars))) as p from fr, b{steps})"


@query(newton_sql() + " select round_even(any_value(a), 6) as intercept, round_even(any_value(b), 6) as coef, round_even(any_value(b) / sqrt(sum(p * (1 - p)) / (sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - pow(sum(p * (1 - p) * x), 2))), 4) as stat from e")
def logit_fit_1(spark, sf_dir):
    frame, m = labelled(spark, sf_dir, ["k_chars"], "quality")
    model = logistic.fit(frame, m, "quality", ["k_chars"])
    c = logistic.coefficients(model, ["k_chars"])[0]
    return spark.createDataFrame([(float(model["beta"][0]), c["coef"], c["stat"])], "intercept double, coef double, stat double").select(r6("intercept").alias("intercept"), r6("coef").alias("coef"), r6("stat", 4).alias("stat"))


@query(newton_sql() + ", l as (select count(*) as n, avg(y) as q, sum(y * ln(p) + (1 - y) * ln(1 - p)) as ll from e), d as (select *, n * (q * ln(q) + (1 - q) * ln(1 - q)) as l0 from l) select n::bigint as n_observations, 1 as n_features, round_even(1 - ll / l0, 4) as pseudo_r_squared, round_even(ll, 4) as log_likelihood, round_even(l0, 4) as log_likelihood_null, round_even(4 - 2 * ll, 4) as aic, round_even(2 * ln(n) - 2 * ll, 4) as bic from d")
def logit_diagnostics(spark, sf_dir):
    frame, m = labelled(spark, sf_dir, ["k_chars"], "quality")
    d = logistic.diagnostics(logistic.fit(frame, m, "quality", ["k_chars"]), m, ["k_chars"], "quality")
    names = ["pseudo_r_squared", "log_likelihood", "log_likelihood_null", "aic", "bic"]
    t = spark.createDataFrame([(d["n_observations"], d["n_features"], *[float(d[k]) for k in names])], "n_observations long, n_features int, " + ", ".join(f"{k} double" for k in names))
    return t.select("n_observations", "n_features", *[r6(k, 4).alias(k) for k in names])


@query(newton_sql() + " select round_even(-2 * sum(y * ln(p) + (1 - y) * ln(1 - p)), 4) as deviance, round_even(sum(y - p), 6) + 0.0 as score_0, round_even(sum((y - p) * x), 6) + 0.0 as score_1 from e")
def deviance_metric(spark, sf_dir):
    frame, m = labelled(spark, sf_dir, ["k_chars"], "quality")
    p = logistic.probability(logistic.fit(frame, m, "quality", ["k_chars"])["beta"], ["k_chars"])
    e = frame.withColumn("p", p)
    dev = logistic.deviance(frame, "quality", p)
    return e.agg(F.bround(F.lit(dev), 4).alias("deviance"), r6(F.sum(F.col("quality") - F.col("p"))).alias("score_0"), r6(F.sum((F.col("quality") - F.col("p")) * F.col("k_chars"))).alias("score_1"))


LX, LY = ["k_chars", "n_dig"], "quality"
LBASE = f"with {LBL}, {frame_sql('lbl', [*LX, LY])}"


def logit_sql(name: str, rows: str, y: str, z: list[str], steps: int) -> str:
    """CTEs that end in ``name``_b: (rep, b0, b1, ..., size of the last step), by Newton steps over ``rows`` (rep, y, z) of all replicates at once."""
    k = len(z) + 1
    x = ["1.0::double", *[f"r.{c}" for c in z]]
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    out = [f"{name}_0 as (select distinct rep, {', '.join(f'0.0::double as b{i}' for i in range(k))}, 1.0::double as size from {rows})"]
    for t in range(steps):
        eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
        sums = ", ".join([f"sum((r.{y} - p) * {x[i]}) as g{i}" for i in range(k)] + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) as h{i}{j}" for i in range(k) for j in range(i, k)])
        low = ", ".join(f"any_value(b{i}) as b{i}" for i in range(k))
        grad = f"select rep, {low}, {sums} from (select r.*, b.* exclude (rep), 1 / (1 + exp(-({eta}))) as p from {rows} r join {name}_{t} b on r.rep = b.rep) r group by rep"
        move = ", ".join(f"{det([[f'g{r}' if c == i else h[r][c] for c in range(k)] for r in range(k)])} / d as s{i}" for i in range(k))
        size = "greatest(" + ", ".join(f"abs(s{i})" for i in range(k)) + ")" if k > 1 else "abs(s0)"
        new = ", ".join(f"case when {size} < 1e-8 then b{i} else b{i} + s{i} * least(1, 5 / {size}) end as b{i}" for i in range(k))
        out.append(f"{name}_{t + 1} as materialized (select rep, {new}, {size} as size from (select *, {move} from (select *, {det(h)} as d from ({grad}))))")
    return ", ".join(out) + f", {name}_b as (select * from {name}_{steps})"


def scaled_sql(x: list[str]) -> str:
    return ", ".join(f"({c} - m.m_{c}) / sqrt({cov(c, c)}) as z_{c}" for c in x)


def observed_sql(x: list[str], y: str) -> str:
    """The observed model: ob_b, in scaled columns."""
    return f"ob_r as materialized (select 0 as rep, {y} as y, {scaled_sql(x)} from fr, m), " + logit_sql("ob", "ob_r", "y", [f"z_{c}" for c in x], 12)


OBSERVED = observed_sql(LX, LY)


def refit_sql(name: str, moved: str, x: list[str], steps: int) -> str:
    """CTEs of the refits of all replicates over ``moved`` (rep, y, x)."""
    return f"{name}_r as materialized (select rep, y, {scaled_sql(x)} from {moved}, m), " + logit_sql(name, f"{name}_r", "y", [f"z_{c}" for c in x], steps)


def logistic_rows_sql(names: dict[str, str], z: list[str], x: list[str]) -> str:
    parts = []
    for i, c in enumerate(x, 1):
        coef = f"((select b{i} from ob_b) / (select sqrt({cov(c, c)}) from m))"
        shown = f"select '{c}' as feature, {i - 1} as ordinal, round_even({coef}, 6) as coef"
        if c in z:
            parts.append(f"{shown}, 0::bigint as n_exceed, 0::bigint as n_perm, null::double as p_emp, '{text.MASKED}' as p_emp_str")
            continue
        sound = f"select abs(b{i} / (select sqrt({cov(c, c)}) from m)) >= abs({coef}) * (1 - 1e-9) as far, coalesce(size < 1e-8, false) as ok from {names[c]}_b"
        parts.append(f"{shown}, b as n_exceed, k as n_perm, round_even((b + 1) / (k + 1), 6) as p_emp, {stars_sql('((b + 1) / (k + 1))')} as p_emp_str from (select count(*) filter (ok and far) as b, count(*) filter (ok) as k from ({sound}))")
    return " union all ".join(parts)


def braak_logistic_sql(x: list[str] = LX, y: str = LY, base: str = LBASE, count: int = B, steps: int = 30) -> str:
    """Of two features."""
    ctes, names = [observed_sql(x, y)], {}
    for c in x:
        (rest,) = [o for o in x if o != c]
        names[c] = f"t_{c}"
        ctes += [
            f"a_{c}_r as (select 0 as rep, {y} as y, ({rest} - m.m_{rest}) / sqrt({cov(rest, rest)}) as z from fr, m)", logit_sql(f"a_{c}", f"a_{c}_r", "y", ["z"], 12),
            f"e_{c} as materialized (select rid, p, {y} - p as e from (select rid, {y}, 1 / (1 + exp(-((select b0 from a_{c}_b) + (select b1 from a_{c}_b) * ({rest} - m.m_{rest}) / sqrt({cov(rest, rest)})))) as p from fr, m))",
            moves_sql(c, f"e_{c}", "w.e", f"v_{c}", count), f"u_{c} as ({constants_sql(f'{c}:draw', count, 2)})",
            f"y_{c} as (select v.rep, ({uniform_sql('v.pos')} < least(greatest(w.p + v.e, 0.001), 0.999))::int::double as y, {', '.join(f'fr.{o}' for o in x)} from v_{c} v join u_{c} using (rep) join e_{c} w on w.rid = v.pos join fr on fr.rid = v.pos)",
            refit_sql(f"t_{c}", f"y_{c}", x, steps),
        ]
    return f"{base}, {', '.join(ctes)} {logistic_rows_sql(names, [], x)}"


def kennedy_logistic_sql(z: list[str], x: list[str] = LX, y: str = LY, base: str = LBASE, count: int = B, steps: int = 30) -> str:
    ctes, names = [observed_sql(x, y)], {}
    for c in [o for o in x if o not in z]:
        names[c] = f"t_{c}"
        hat = fit_sql(c, z)
        kept = ", ".join(f"fr.{o}" if o != c else f"{hat} + v.r as {o}" for o in x)
        for o in z:
            kept = kept.replace(f"*({o}-", f"*(fr.{o}-")
        ctes += [f"w_{c} as materialized (select rid, {resid(c, z)} as r from fr, m)", moves_sql(c, f"w_{c}", "w.r", f"v_{c}", count), f"y_{c} as (select v.rep, fr.{y} as y, {kept} from v_{c} v join fr on fr.rid = v.pos, m)", refit_sql(f"t_{c}", f"y_{c}", x, steps)]
    return f"{base}, {', '.join(ctes)} {logistic_rows_sql(names, z, x)}"


def joint_logistic_sql(x: list[str] = LX, y: str = LY, base: str = LBASE, count: int = B, steps: int = 30) -> str:
    values = ", ".join(f"{resid(c, [])} as r_{c}" for c in x)
    ctes = [observed_sql(x, y), f"w as materialized (select rid, {values} from fr, m)", moves_sql("joint", "w", ", ".join(f"w.r_{c}" for c in x), "v", count), f"y_j as (select v.rep, fr.{y} as y, {', '.join(f'm.m_{c} + v.r_{c} as {c}' for c in x)} from v join fr on fr.rid = v.pos, m)", refit_sql("t", "y_j", x, steps)]
    deviance = lambda name: f"select r.rep, -2 * sum(y * ln(p) + (1 - y) * ln(1 - p)) as d from (select r.rep, r.y, least(greatest(1 / (1 + exp(-(b0 + b1 * z_{x[0]} + b2 * z_{x[1]}))), 2.220446049250313e-16), 1 - 2.220446049250313e-16) as p from {name}_r r join {name}_b b on r.rep = b.rep) r group by r.rep"
    none = f"(select -2 * m.n * (m.m_{y} * ln(m.m_{y}) + (1 - m.m_{y}) * ln(1 - m.m_{y})) from m)"
    ctes += [f"i as (select {none} - d as v from ({deviance('t')}) join t_b using (rep) where size < 1e-8)"]
    return f"{base}, {', '.join(ctes)}, " + joint_rows_sql(f"select {none} - d as ob from ({deviance('ob')})", "Deviance Reduction", "logistic", x, [])


LOGIT_P = f"x as (select sum(p * (1 - p)) as h00, " + ", ".join(f"sum(p * (1 - p) * z{i}) as h0{i}" for i in (1, 2)) + ", sum(p * (1 - p) * z1 * z1) as h11, sum(p * (1 - p) * z1 * z2) as h12, sum(p * (1 - p) * z2 * z2) as h22, sum(y * ln(p) + (1 - y) * ln(1 - p)) as ll, any_value(b1) as b1, any_value(b2) as b2 from (select y, b1, b2, z_k_chars as z1, z_n_dig as z2, 1 / (1 + exp(-(b0 + b1 * z_k_chars + b2 * z_n_dig))) as p from ob_r, ob_b))"


def wald_sql() -> str:
    h = [[f"x.h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    parts = []
    for i, c in enumerate(LX, 1):
        minor = [[h[r][k] for k in range(3) if k != i] for r in range(3) if r != i]
        parts.append(f"select '{c}' as feature, x.b{i} / sqrt({cov(c, c)}) as coef, x.b{i} / sqrt({det(minor)} / {det(h)}) as stat, exp(-(x.ll - m.n * (m.m_{LY} * ln(m.m_{LY}) + (1 - m.m_{LY}) * ln(1 - m.m_{LY})))) as llr from x, m")
    return f"{LBASE}, {OBSERVED}, {LOGIT_P}, w as ({' union all '.join(parts)}) select feature, round_even(coef, 6) as coef, round_even(stat, 4) as stat, round_even({z_tail_sql('w.stat')}, 6) as p_classic, round_even(llr, 6) as llr_p_value from w"


@query(wald_sql())
def classic_pvalues_logistic(spark, sf_dir):
    """Wald and likelihood-ratio p-values; the SQL integrates the normal density (with two features the ratio's tail is an exponential)."""
    frame, m = labelled(spark, sf_dir, LX, LY)
    model = logistic.fit(frame, m, LY, LX)
    p = logistic.diagnostics(model, m, LX, LY)["llr_p_value"]
    rows = spark.createDataFrame([(c["feature"], c["coef"], c["stat"], c["p_classic"], p) for c in logistic.coefficients(model, LX)], "feature string, coef double, stat double, p_classic double, llr_p_value double")
    return rows.select("feature", r6("coef").alias("coef"), r6("stat", 4).alias("stat"), r6("p_classic").alias("p_classic"), r6("llr_p_value").alias("llr_p_value"))


def logistic_test(spark, sf_dir, method: str, confounders=()):
    return run_test(spark, sf_dir, method, confounders, LX, LY, tables.labelled)


@query(braak_logistic_sql())
def ter_braak_logistic(spark, sf_dir):
    return coefficient_rows(logistic_test(spark, sf_dir, "ter_braak"))


@query(kennedy_logistic_sql(["n_dig"]))
def kennedy_logistic(spark, sf_dir):
    return coefficient_rows(logistic_test(spark, sf_dir, "kennedy", ["n_dig"]))


@query(kennedy_logistic_sql([]))
def kennedy_logistic_all(spark, sf_dir):
    """Without confounders: the exposure model is the mean alone."""
    return coefficient_rows(logistic_test(spark, sf_dir, "kennedy"))


@query(joint_logistic_sql())
def kennedy_joint_logistic(spark, sf_dir):
    return joint_columns(logistic_test(spark, sf_dir, "kennedy_joint"))


# ---------------------------------------------------------------- many rows: order lines, by the exchange


RX, RY, RB = ["quantity", "discount"], "returned", 19
RET = "ret as (select l_orderkey * 10 + l_linenumber as id, l_quantity::double as quantity, l_discount::double as discount, l_tax::double as tax, (l_returnflag = 'R')::int::double as returned, l_extendedprice::double / 1000 as price from lineitem)"
RBASE = f"with {RET}, {frame_sql('ret', [*RX, RY], 'id, quantity, discount, returned')}"
PX, PY = ["quantity", "discount", "tax"], "price"


def returns_test(spark, sf_dir, method: str, confounders=()):
    return run_test(spark, sf_dir, method, confounders, RX, RY, tables.returns, RB)


@query(braak_logistic_sql(RX, RY, RBASE, RB, 10))
def ter_braak_logistic_returns(spark, sf_dir):
    """Order lines: every row of lineitem in each replicate, refitted by steps that keep nothing."""
    return coefficient_rows(returns_test(spark, sf_dir, "ter_braak"))


@query(kennedy_logistic_sql(["discount"], RX, RY, RBASE, RB, 10))
def kennedy_logistic_returns(spark, sf_dir):
    return coefficient_rows(returns_test(spark, sf_dir, "kennedy", ["discount"]))


@query(joint_logistic_sql(RX, RY, RBASE, RB, 10))
def kennedy_joint_logistic_returns(spark, sf_dir):
    return joint_columns(returns_test(spark, sf_dir, "kennedy_joint"))


PBASE = f"with {RET}, {frame_sql('ret', [*PX, PY], 'id, quantity, discount, tax, price')}"


@query(f"{PBASE}, {braak_sql(PX, PY, RB)} " + " union all ".join(exceed_sql(c, i, False, PX, PY) for i, c in enumerate(PX)))
def ter_braak_linear_prices(spark, sf_dir):
    """Order lines: prices on quantity, discount and tax."""
    return coefficient_rows(run_test(spark, sf_dir, "ter_braak", (), PX, PY, tables.returns, RB))


@query(f"{PBASE}, {kennedy_sql(['tax'], PX, PY, RB)} " + " union all ".join(exceed_sql(c, i, c == "tax", PX, PY) for i, c in enumerate(PX)))
def kennedy_linear_prices(spark, sf_dir):
    return coefficient_rows(run_test(spark, sf_dir, "kennedy", ["tax"], PX, PY, tables.returns, RB))


# ---------------------------------------------------------------- reports in SQL


def quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def pair_sql(label: str, value: str, other: str, number: str) -> str:
    return f"rpad('{label}', {report.LABEL}, ' ') || rpad({value}, {report.LEFT - report.LABEL}, ' ') || lpad('{other}', {report.RIGHT}, ' ') || ' ' || lpad({number}, greatest({report.VALUE}, length({number}))::int, ' ')"


def head_sql(title: str, kind: str, method: str, target: str) -> list[str]:
    """Lines over d (a row of diagnostics)."""
    line, number = quoted("=" * report.WIDTH), lambda c: f"d.{c}::varchar"
    out = [line, quoted(f"{title:^{report.WIDTH}}"), line, pair_sql("Dep. Variable:", quoted(text.short(target, 20)), "No. Observations:", number("n_observations"))]
    out += [pair_sql("Model Type:", quoted(kind), "No. Features:", number("n_features")), pair_sql("Method:", quoted(method), "AIC:", number("aic"))]
    for label, name, other, value in report.LINEAR if kind == "linear" else report.LOGISTIC:
        out.append(pair_sql(label, number(name) if name else "''", other, f"printf('%.4e', d.{value})" if value.endswith("_p_value") else number(value)))
    return out


RULE, LEGEND = quoted("-" * report.WIDTH), [quoted("=" * report.WIDTH), quoted("(*) p < 0.05   (**) p < 0.01   (ns) p >= 0.05"), "''"]


def numbered_sql(lists: str) -> str:
    return f"select (generate_subscripts(l, 1) - 1)::int as line, unnest(l) as text from (select {lists} as l)"


def coefficient_lines(title: str, kind: str, method: str, target: str, diagnostics: str, coefs: str, classic: str, z: list[str]) -> str:
    """A list of lines, as an expression: ``coefs`` has feature, ordinal, coef, p_emp_str and ``classic`` feature, p_classic_str."""
    letter = "t" if kind == "linear" else "z"
    header = quoted(f"{'Feature':<{report.NAME}} {'Coef':>12} {f'P>|{letter}| (Emp)':>18} {f'P>|{letter}| (Asy)':>18}")
    masked = f"case when c.feature in ({', '.join(map(quoted, z))}) then '{text.MASKED}' else a.p_classic_str end" if z else "a.p_classic_str"
    row = f"rpad(c.feature, {report.NAME}, ' ') || ' ' || printf('%12.4f', c.coef) || ' ' || lpad(c.p_emp_str, 18, ' ') || ' ' || lpad({masked}, 18, ' ')"
    rows = f"(select list({row} order by c.ordinal) from ({coefs}) c join ({classic}) a on a.feature = c.feature)"
    return f"list_concat((select [{', '.join([*head_sql(title, kind, method, target), RULE, header, RULE])}] from ({diagnostics}) d), {rows}, [{', '.join(LEGEND)}])"


def joint_lines(kind: str, target: str, diagnostics: str, joint: str) -> str:
    names = "['Features Tested: ' || j.features_tested] || case when j.confounders = '' then [] else ['Confounders: ' || j.confounders] end"
    tail = f"[{RULE}, rpad('Observed Improvement:', 30, ' ') || ' ' || printf('%12.4f', j.observed_improvement), rpad('Joint p-Value:', 30, ' ') || ' ' || lpad(j.p_value_str, 12, ' '), {', '.join(LEGEND)}]"
    head = f"[{', '.join(head_sql('Joint Permutation Test Results', kind, 'kennedy_joint', target))}, rpad('Metric:', {report.LABEL}, ' ') || j.metric_type, {RULE}]"
    return f"(select {head} || {names} || {tail} from ({diagnostics}) d, ({joint}) j)"


def small_f_tail_sql(x: str, one: str, two: str) -> str:
    """Upper tail of F, however small, from the residual share ``x`` of the sum of squares: the incomplete beta integral in powers of e."""
    a, b = f"(({one}) / 2.0::double)", f"(({two}) / 2.0::double)"
    inner = integral_sql(lambda w: f"exp(-{w}) * pow(1 - ({x}) * exp(-{w} / {b}), {a} - 1)", "40.0::double", 4000)
    return f"exp({b} * ln({x}) - ln({b}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}) + ln({inner}))"


def linear_diagnostics_sql() -> str:
    share = f"select m.n as n, {rss(Y, X)} / (m.n * {cov(Y, Y)}) as x from m"
    return f"select o.*, f.p as f_p_value from ({ORACLE['ols_diagnostics']}) o, ({BASE}, e as ({share}) select {small_f_tail_sql('e.x', str(len(X)), f'(e.n - {len(X) + 1})')} as p from e) f"


def logistic_diagnostics_sql(x: list[str], y: str, base: str) -> str:
    """Of two features, whose likelihood ratio has an exponential tail."""
    eta = " + ".join(["b0", *[f"b{i} * z_{c}" for i, c in enumerate(x, 1)]])
    fitted = f"l as (select count(*) as n, avg(y) as q, sum(y * ln(p) + (1 - y) * ln(1 - p)) as ll from (select y, 1 / (1 + exp(-({eta}))) as p from ob_r, ob_b)), d as (select *, n * (q * ln(q) + (1 - q) * ln(1 - q)) as l0 from l)"
    return f"{base}, {observed_sql(x, y)}, {fitted} select n as n_observations, {len(x)} as n_features, round_even(1 - ll / l0, 4) as pseudo_r_squared, round_even(ll, 4) as log_likelihood, round_even(l0, 4) as log_likelihood_null, round_even({2 * len(x) + 2} - 2 * ll, 4) as aic, round_even({len(x) + 1} * ln(n) - 2 * ll, 4) as bic, exp(l0 - ll) as llr_p_value from d"


def logistic_classic_sql(x: list[str], y: str, base: str) -> str:
    """Marked Wald p-values of two features."""
    z1, z2 = (f"z_{c}" for c in x)
    h = [[f"x.h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    sums = f"x as (select sum(w) as h00, sum(w * z1) as h01, sum(w * z2) as h02, sum(w * z1 * z1) as h11, sum(w * z1 * z2) as h12, sum(w * z2 * z2) as h22, any_value(b1) as b1, any_value(b2) as b2 from (select z1, z2, b1, b2, p * (1 - p) as w from (select {z1} as z1, {z2} as z2, b1, b2, 1 / (1 + exp(-(b0 + b1 * {z1} + b2 * {z2}))) as p from ob_r, ob_b)))"
    parts = []
    for i, c in enumerate(x, 1):
        minor = [[h[r][k] for k in range(3) if k != i] for r in range(3) if r != i]
        parts.append(f"select '{c}' as feature, x.b{i} / sqrt({det(minor)} / {det(h)}) as stat from x")
    return f"{base}, {observed_sql(x, y)}, {sums}, w as ({' union all '.join(parts)}), p as (select feature, {z_tail_sql('w.stat')} as p from w) select feature, {stars_sql('p')} as p_classic_str from p"


LINEAR_CLASSIC = f"select feature, p_classic_str from ({ORACLE['classic_pvalues_linear']})"


def listed(names: str) -> str:
    """A comma-separated text as a list is printed."""
    return f"case when {names} = '' then '[]' else {quoted(chr(91) + chr(39))} || replace({names}, ',', {quoted(chr(39) + ', ' + chr(39))}) || {quoted(chr(39) + chr(93))} end"


def confounder_lines(identified_: str, x: list[str], note: str = "") -> str:
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(x))
    own = f"[concat({quoted('Predictor: ' + chr(39))}, predictor, {quoted(chr(39))}), '  Identified Confounders: ' || {listed('identified_confounders')}, '  Identified Mediators: ' || {listed('identified_mediators')}] || case when identified_confounders = '' and identified_mediators = '' then [] else ['  Recommendation: ' || recommendation] end || ['']"
    found = f"coalesce(list('  ' || predictor || ': control for ' || {listed('identified_confounders')} order by o.i) filter (identified_confounders <> ''), ['  No confounders identified for any predictor.', '  This suggests the predictors are relatively independent.'])"
    return f"(select ['Confounder Identification for All Predictors{note}', ''] || flatten(list({own} order by o.i)) || ['Summary: Predictors with Identified Confounders{note}', ''] || {found} || [''] from ({identified_}) s join (values {order}) o(c, i) on o.c = s.predictor)"


def found_sql(identified_: str, x: list[str], kind: str, lines) -> str:
    """The report of the first predictor with confounders: the tests of all sets that may be found, of which one is taken."""
    sets = [[c for k, c in enumerate(x) if bits >> k & 1] for bits in range(1, 2 ** len(x) - 1)]
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(x))
    parts = []
    for z in sets:
        for p in (c for c in x if c not in z):
            title = text.FOUND_TITLE.format(p=p, c=z, k=kind.capitalize())
            parts.append((p, ",".join(z), lines(title, z)))
    tests = " union all ".join(f"select '{p}' as p, '{z}' as z, {l} as l" for p, z, l in parts)
    first = f"select arg_min(predictor, o.i) as p, arg_min(identified_confounders, o.i) as z from ({identified_}) s join (values {order}) o(c, i) on o.c = s.predictor where identified_confounders <> ''"
    return numbered_sql(f"coalesce((select any_value(t.l) from ({first}) f join ({tests}) t on t.p = f.p and t.z = f.z), ['No confounders identified for any predictor.'])")


def linear_found_lines(title: str, z: list[str]) -> str:
    coefs = f"{BASE}, {kennedy_sql(z)} " + " union all ".join(exceed_sql(c, i, c in z) for i, c in enumerate(X))
    return coefficient_lines(title, "linear", "kennedy", Y, linear_diagnostics_sql(), coefs, LINEAR_CLASSIC, z)


def logistic_found_lines(x: list[str], y: str, base: str):
    return lambda title, z: coefficient_lines(title, "logistic", "kennedy", y, logistic_diagnostics_sql(x, y, base), kennedy_logistic_sql(z, x, y, base), logistic_classic_sql(x, y, base), z)


ORACLE["confounder_report"] = numbered_sql(confounder_lines(identify_sql(X), X))
ORACLE["kennedy_with_found_confounders"] = found_sql(identify_sql(X), X, "linear", linear_found_lines)


# ---------------------------------------------------------------- confounders of a 0/1 outcome


LFR = f"with {LBL}, fr as (select row_number() over (order by id) as rid, * from lbl), {boot_sql(B)}"


@query(identify_sql(LX, LX, LY, "lbl", LFR))
def identify_all_logistic(spark, sf_dir):
    return identified(*labelled(spark, sf_dir, LX, LY), LX, LY, LX)


@query(numbered_sql(confounder_lines(identify_sql(LX, LX, LY, "lbl", LFR), LX, " (Logistic)")))
def confounder_report_logistic(spark, sf_dir):
    return as_lines(spark, report.confounder_report(api.identify_all(tables.labelled(spark, sf_dir), "id", LX, LY, n_bootstrap=B, random_state=SEED), " (Logistic)"))


@query(found_sql(identify_sql(LX, LX, LY, "lbl", LFR), LX, "logistic", logistic_found_lines(LX, LY, LBASE)))
def kennedy_with_found_confounders_logistic(spark, sf_dir):
    return found_lines(spark, tables.labelled(spark, sf_dir), LX, LY)


# Customers who spend much: a 0/1 outcome with a confounder to find.
BX, BY = ["n_orders", "n_f"], "large"
BUY = f"{CUST}, buy as (select *, (spend > 2.5)::int::double as large from cust)"
BUYERS = f"with {BUY}, {frame_sql('buy', [*BX, BY])}"
BFR = f"with {BUY}, fr as (select row_number() over (order by id) as rid, * from buy), {boot_sql(B)}"


@query(identify_sql(BX, BX, BY, "buy", BFR))
def identify_all_buyers(spark, sf_dir):
    frame = prepare(tables.buyers(spark, sf_dir), "id", BX, BY)
    return identified(frame, moments(frame, [*BX, BY]), BX, BY, BX)


@query(numbered_sql(confounder_lines(identify_sql(BX, BX, BY, "buy", BFR), BX, " (Logistic)")))
def confounder_report_buyers(spark, sf_dir):
    return as_lines(spark, report.confounder_report(api.identify_all(tables.buyers(spark, sf_dir), "id", BX, BY, n_bootstrap=B, random_state=SEED), " (Logistic)"))


@query(found_sql(identify_sql(BX, BX, BY, "buy", BFR), BX, "logistic", logistic_found_lines(BX, BY, BUYERS)))
def kennedy_with_found_confounders_buyers(spark, sf_dir):
    """A 0/1 outcome, end to end: the sweep finds a confounder, and Kennedy's test controls for it."""
    return found_lines(spark, tables.buyers(spark, sf_dir), BX, BY)


# ---------------------------------------------------------------- text


@query("select p_partkey, case when length(n) <= 25 then n else substr(n, 1, 22) || '...' end as short from (select p_partkey, p_name || ' ' || p_type as n from part)")
def truncate_name(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.shortened(F.concat_ws(" ", "p_name", "p_type"), 25).alias("short"))


REPORT = coefficient_lines("Permutation Test Results", "linear", "ter_braak", Y, linear_diagnostics_sql(), ORACLE["ter_braak_linear"], LINEAR_CLASSIC, [])
JOINT_REPORT = joint_lines("linear", Y, linear_diagnostics_sql(), ORACLE["kennedy_joint_linear"])
LREPORT = coefficient_lines("Permutation Test Results", "logistic", "ter_braak", LY, logistic_diagnostics_sql(LX, LY, LBASE), ORACLE["ter_braak_logistic"], logistic_classic_sql(LX, LY, LBASE), [])
LJOINT_REPORT = joint_lines("logistic", LY, logistic_diagnostics_sql(LX, LY, LBASE), ORACLE["kennedy_joint_logistic"])


@query(numbered_sql(f"list_concat(({REPORT})[:-2], {JOINT_REPORT})"))
def report_rows(spark, sf_dir):
    """The coefficient and joint reports, line by line."""
    source = tables.customers(spark, sf_dir)
    a = report.coefficient_report(api.permutation_test_regression(source, "id", X, Y, B, random_state=SEED, plan="rows"), X, Y)
    b = report.joint_report(api.permutation_test_regression(source, "id", X, Y, B, method="kennedy_joint", confounders=["balance"], random_state=SEED, plan="rows"), Y)
    return as_lines(spark, a + b)


@query(numbered_sql(f"list_concat(({LREPORT})[:-2], {LJOINT_REPORT})"))
def report_rows_logistic(spark, sf_dir):
    """The coefficient and joint reports of a 0/1 outcome, line by line."""
    source = tables.labelled(spark, sf_dir)
    a = report.coefficient_report(api.permutation_test_regression(source, "id", LX, LY, B, random_state=SEED, plan="rows"), LX, LY)
    b = report.joint_report(api.permutation_test_regression(source, "id", LX, LY, B, method="kennedy_joint", random_state=SEED, plan="rows"), LY)
    return as_lines(spark, a + b)


__all__ = ["ORACLE", "QUERIES", "outcome_kind"]
