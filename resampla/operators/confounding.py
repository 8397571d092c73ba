"""Confounder screening, mediation with bootstrap intervals, and identification for one or all predictors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.functions import tails, text
from resampla.operators import bootstrap
from resampla.plans.frame import Moments, moments

SCREEN = "predictor string, feature string, ordinal int, r_pred double, p_pred double, r_out double, p_out double, is_candidate boolean"


def pearson(a: str, b: str) -> Column:
    """Correlation; null where a column is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlation(m: Moments, a: str, b: str) -> float:
    scale = math.sqrt(m.block([a], [a])[0, 0] * m.block([b], [b])[0, 0])
    return max(-1.0, min(1.0, float(m.block([a], [b])[0, 0]) / scale)) if scale > 0 else math.nan


def screen(frame: DataFrame, features: list[str], target: str, predictors: list[str], least: float = 0.1, alpha: float = 0.05, m: Moments | None = None) -> DataFrame:
    """One row per predictor and other feature: correlations with predictor and outcome; a candidate passes all four tests.

    All pairs come from one pass; undefined correlations never pass.
    """
    m = m or moments(frame, [*features, target])
    rows = []
    for p in predictors:
        for i, c in enumerate(features):
            if c == p:
                continue
            r, s = correlation(m, c, p), correlation(m, c, target)
            pr, ps = tails.pearson_p(r, m.n), tails.pearson_p(s, m.n)
            none = lambda x: None if math.isnan(x) else x
            rows.append((p, c, i, none(r), none(pr), none(s), none(ps), bool(abs(r) >= least and pr < alpha and abs(s) >= least and ps < alpha)))
    return frame.sparkSession.createDataFrame(rows, SCREEN)


def paths(x: str, z: str, y: str) -> dict[str, Column]:
    """Aggregates of one group: total, direct and indirect effects from six moments."""
    v, c = F.var_samp, F.covar_samp
    low = v(x) * v(z) - F.pow(c(x, z), 2.0)
    return {
        "total": F.try_divide(c(x, y), v(x)), "a": F.try_divide(c(x, z), v(x)),
        "b": F.try_divide(c(z, y) * v(x) - c(x, y) * c(x, z), low), "direct": F.try_divide(c(x, y) * v(z) - c(z, y) * c(x, z), low),
    }


def mediate(frame: DataFrame, m: Moments, target: str, pairs: list[tuple[str, str]], count: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row per (predictor, mediator): effects, percentile interval of the indirect effect, and what follows.

    All pairs share the draws of a replicate and its one moment matrix; each pair is a row from there on.  The model is linear for any outcome.
    """
    spark = frame.sparkSession
    schema = "predictor string, mediator string, total_effect double, direct_effect double, a_path double, b_path double, indirect_effect double, ci_lower double, ci_upper double, is_mediator boolean, proportion_mediated double, interpretation string"
    if not pairs:
        return spark.createDataFrame([], schema)
    used = sorted({c for p in pairs for c in p} | {target})
    at = {c: i for i, c in enumerate(used)}
    c = m.block(used, used) * (m.n / (m.n - 1)) if m.n > 1 else np.zeros((len(used), len(used)))
    effects = bootstrap.path_values(c, np.array([at[x] for x, _ in pairs]), np.array([at[z] for _, z in pairs]), at[target])
    point = [(i, x, z, *(None if math.isnan(e[i]) else float(e[i]) for e in effects)) for i, (x, z) in enumerate(pairs)]
    rows = spark.createDataFrame(point, "pair long, predictor string, mediator string, total double, a double, b double, direct double")
    ends = F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))
    band = bootstrap.indirect_effects(frame, m, pairs, target, count, seed).groupBy("pair").agg(F.percentile("value", ends).alias("ci"))
    rows = rows.join(band, "pair").withColumn("indirect", F.col("a") * F.col("b")).withColumn("lo", F.get("ci", F.lit(0))).withColumn("hi", F.get("ci", F.lit(1)))
    rows = rows.withColumn("is_mediator", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))
    share = F.when(F.abs("total") > 1e-10, F.try_divide("indirect", "total"))
    return rows.select(
        "predictor", "mediator", F.col("total").alias("total_effect"), F.col("direct").alias("direct_effect"), F.col("a").alias("a_path"), F.col("b").alias("b_path"), F.col("indirect").alias("indirect_effect"),
        F.col("lo").alias("ci_lower"), F.col("hi").alias("ci_upper"), "is_mediator", share.alias("proportion_mediated"), text.interpretation(F.col("predictor"), F.col("mediator"), F.col("is_mediator"), F.col("total"), F.col("direct")).alias("interpretation"),
    )


def identify(frame: DataFrame, m: Moments, features: list[str], target: str, predictors: list[str], least: float = 0.1, alpha: float = 0.05, count: int = 1000, level: float = 0.95, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, screening, mediation): candidates that don't mediate are confounders; all pairs run in one job."""
    screened = screen(frame, features, target, predictors, least, alpha, m)
    pairs = [(r["predictor"], r["feature"]) for r in screened.where("is_candidate").orderBy("predictor", "ordinal").collect()]
    mediation = mediate(frame, m, target, pairs, count, level, seed)
    order = frame.sparkSession.createDataFrame([(p, features.index(p)) for p in predictors], "predictor string, ordinal int")
    placed = mediation.join(frame.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features)], "mediator string, _at int"), "mediator")
    pick = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_mediator") == flag, F.struct("_at", "mediator")))), lambda s: s["mediator"])
    lists = placed.groupBy("predictor").agg(pick(False).alias("identified_confounders"), pick(True).alias("identified_mediators"))
    none = F.array().cast("array<string>")
    summary = order.join(lists, "predictor", "left").select("predictor", "ordinal", F.coalesce("identified_confounders", none).alias("identified_confounders"), F.coalesce("identified_mediators", none).alias("identified_mediators"))
    return summary.withColumn("recommendation", text.recommendation(F.col("predictor"), F.col("identified_confounders"))), screened, mediation
