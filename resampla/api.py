"""The library's entry points: permutation tests, mediation and confounder search on a DataFrame."""

from __future__ import annotations

import math
import secrets
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resampla.functions import text
from resampla.operators import confounding, linear, logistic, report, resample
from resampla.plans import kernel
from resampla.plans.frame import Moments, moments, outcome_kind, prepare

METHODS = ("ter_braak", "kennedy", "kennedy_joint")


def _round(d: dict, places: int = 4) -> dict:
    return {k: v if isinstance(v, int) or k.endswith("_p_value") else round(v, places) for k, v in d.items()}


class PermutationTest:
    """One validated frame and its observed model; the tables of a test are DataFrames."""

    def __init__(self, df: DataFrame, id_col: str, features: list[str], target: str, method: str = "ter_braak", confounders: list[str] | None = None, n_permutations: int = 5000, seed: int | None = None, na: str = "fail", plan: str = "auto", precision: int = 3, one: float = 0.05, two: float = 0.01):
        confounders = list(confounders or [])
        if method not in METHODS:
            raise ValueError("Invalid method. Please select 'ter_braak', 'kennedy', or 'kennedy_joint'.")
        if n_permutations < 1:
            raise ValueError("at least one permutation is needed")
        if set(confounders) - set(features):
            raise ValueError(f"confounders that are no features: {sorted(set(confounders) - set(features))}")
        if method == "ter_braak" and confounders:
            warnings.warn("the ter Braak method takes no confounders; they are ignored", stacklevel=3)
            confounders = []
        if method == "kennedy_joint" and not set(features) - set(confounders):
            raise ValueError("every feature is a confounder: nothing is left to test")
        if plan not in ("auto", "rows", "replicates"):
            raise ValueError("plan is one of auto, rows, replicates")
        self.features, self.target, self.method, self.confounders = list(features), target, method, confounders
        self.count, self.seed = n_permutations, secrets.randbits(31) if seed is None else seed
        self.precision, self.one, self.two = precision, one, two
        self.frame = prepare(df, id_col, features, target, na).persist()
        self.kind = outcome_kind(self.frame, target)
        self.moments: Moments = moments(self.frame, [*features, target])
        small = kernel.fits(self.moments.n, len(features))
        self.plan = plan if plan != "auto" else "replicates" if small else "rows"
        if self.kind == "linear":
            self.coefs = linear.coefficients(self.moments, self.features, target)
            self.diagnostics = linear.diagnostics(self.moments, self.features, target)
        else:
            model = logistic.fit(self.frame, self.moments, target, self.features)
            self.coefs = logistic.coefficients(model, self.features)
            self.diagnostics = logistic.diagnostics(model, self.moments, self.features, target)

    def null(self) -> DataFrame:
        """(rep, feature, stat, sound): the null distribution, under the name 'joint' for the joint test."""
        args = (self.frame, self.moments, self.features, self.target)
        if self.plan == "replicates":
            return kernel.null_distribution(self.frame, self.features, self.target, self.method, self.confounders, self.kind == "logistic", self.count, self.seed)
        work = linear if self.kind == "linear" else logistic
        if self.method == "ter_braak":
            out = work.ter_braak(*args, self.count, self.seed)
        elif self.method == "kennedy":
            out = work.kennedy(*args, self.confounders, self.count, self.seed)
        else:
            _, out = work.kennedy_joint(*args, self.confounders, self.count, self.seed)
            out = out.withColumn("feature", F.lit("joint")).withColumnRenamed("improvement", "stat")
        return out if "sound" in out.columns else out.withColumn("sound", F.lit(True))

    def coefficient_table(self) -> DataFrame:
        """One row per feature: coefficient, exceedances, empirical and classical p-values with marks; confounders masked."""
        spark = self.frame.sparkSession
        observed = spark.createDataFrame([(c["feature"], c["ordinal"], c["coef"], c["p_classic"], c["feature"] in self.confounders, text.marked(c["p_classic"], self.precision, self.one, self.two)) for c in self.coefs], "feature string, ordinal int, coef double, p_classic double, is_confounder boolean, p_classic_str string")
        counted = self.null().join(F.broadcast(observed.select("feature", "coef")), "feature").groupBy("feature").agg(F.count_if(F.col("sound") & resample.exceeds(F.col("stat"), F.col("coef"))).alias("n_exceed"), F.count_if("sound").alias("n_perm"), F.count_if(~F.col("sound")).alias("n_unsound"))
        p = resample.p_value(F.col("n_exceed"), F.col("n_perm"))
        out = observed.join(counted, "feature", "left").withColumn("p_emp", p).withColumn("p_emp_str", text.marked_column(F.col("p_emp"), self.precision, self.one, self.two))
        mask = lambda c: F.when(F.col("is_confounder"), text.MASKED).otherwise(F.col(c)).alias(c)
        return out.select(F.lit(self.method).alias("method"), F.lit(self.kind).alias("model_type"), "feature", "ordinal", "coef", "n_exceed", "n_perm", "n_unsound", "p_emp", mask("p_emp_str"), "p_classic", mask("p_classic_str"), "is_confounder")

    def joint_table(self) -> DataFrame:
        """One row: observed improvement, exceedances and the p-value with its mark."""
        z = self.confounders
        if self.kind == "linear":
            observed, metric = self.moments.rss(self.target, z) - self.moments.rss(self.target, self.features), "RSS Reduction"
        else:
            observed, metric = 2 * (logistic.fit(self.frame, self.moments, self.target, self.features)["ll"] - logistic.fit(self.frame, self.moments, self.target, z)["ll"]), "Deviance Reduction"
        least = observed - resample.TOLERANCE * max(1.0, abs(observed))
        row = self.null().agg(F.count_if(F.col("sound") & (F.col("stat") >= least)).alias("n_exceed"), F.count_if("sound").alias("n_perm"), F.count_if(~F.col("sound")).alias("n_unsound"))
        row = row.withColumn("p_value", resample.p_value(F.col("n_exceed"), F.col("n_perm")))
        names = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
        tested = [c for c in self.features if c not in z]
        return row.select(F.lit(observed).alias("observed_improvement"), "n_exceed", "n_perm", "n_unsound", "p_value", text.marked_column(F.col("p_value"), self.precision, self.one, self.two).alias("p_value_str"), F.lit(metric).alias("metric_type"), F.lit(self.kind).alias("model_type"), names(tested).alias("features_tested"), names(z).alias("confounders"))


def permutation_test_regression(df: DataFrame, id_col: str, features: list[str], target: str, n_permutations: int = 5000, precision: int = 3, p_value_threshold_one: float = 0.05, p_value_threshold_two: float = 0.01, method: str = "ter_braak", confounders: list[str] | None = None, random_state: int | None = None, na: str = "fail", plan: str = "auto") -> dict:
    """Test every coefficient (or all together, 'kennedy_joint') of the model that the outcome's values call for."""
    test = PermutationTest(df, id_col, features, target, method, confounders, n_permutations, random_state, na, plan, precision, p_value_threshold_one, p_value_threshold_two)
    try:
        shared = {"p_value_threshold_one": p_value_threshold_one, "p_value_threshold_two": p_value_threshold_two, "method": method, "model_type": test.kind, "diagnostics": _round(test.diagnostics), "random_state": test.seed}
        if method == "kennedy_joint":
            row = test.joint_table().first().asDict(True)
            row["p_value_str"] = text.marked(row["p_value"], precision, p_value_threshold_one, p_value_threshold_two)
            return row | shared
        rows = [r.asDict() for r in test.coefficient_table().orderBy("ordinal").collect()]
        said = [text.MASKED if r["is_confounder"] else text.marked(math.nan if r["p_emp"] is None else r["p_emp"], precision, p_value_threshold_one, p_value_threshold_two) for r in rows]
        return {"model_coefs": [r["coef"] for r in rows], "permuted_p_values": said, "classic_p_values": [r["p_classic_str"] for r in rows], "p_values": [r["p_emp"] for r in rows], "classic_p_numbers": [r["p_classic"] for r in rows]} | shared
    finally:
        test.frame.unpersist()


def screen_potential_confounders(df: DataFrame, id_col: str, features: list[str], target: str, predictor: str, correlation_threshold: float = 0.1, p_value_threshold: float = 0.05) -> dict:
    frame = prepare(df, id_col, features, target)
    rows = confounding.screen(frame, features, target, [predictor], correlation_threshold, p_value_threshold).orderBy("ordinal").collect()
    number = lambda x: math.nan if x is None else x
    return {
        "predictor": predictor, "potential_confounders": [r["feature"] for r in rows if r["is_candidate"]],
        "correlations_with_predictor": {r["feature"]: {"r": number(r["r_pred"]), "p": number(r["p_pred"])} for r in rows},
        "correlations_with_outcome": {r["feature"]: {"r": number(r["r_out"]), "p": number(r["p_out"])} for r in rows},
        "excluded_variables": [r["feature"] for r in rows if not r["is_candidate"]],
    }


def mediation_analysis(df: DataFrame, id_col: str, features: list[str], target: str, predictor: str, mediator: str, n_bootstrap: int = 1000, confidence_level: float = 0.95, precision: int = 4, random_state: int | None = None) -> dict:
    frame = prepare(df, id_col, features, target)
    seed = secrets.randbits(31) if random_state is None else random_state
    row = confounding.mediate(frame, moments(frame, [*features, target]), target, [(predictor, mediator)], n_bootstrap, confidence_level, seed).first()
    return _mediation(row, precision)


def _mediation(row, precision: int) -> dict:
    number = lambda x: math.nan if x is None else round(x, precision)
    keep = {k: number(row[k]) for k in ("total_effect", "direct_effect", "indirect_effect", "a_path", "b_path", "proportion_mediated")}
    return {"predictor": row["predictor"], "mediator": row["mediator"], **keep, "indirect_effect_ci": (number(row["ci_lower"]), number(row["ci_upper"])), "is_mediator": row["is_mediator"], "interpretation": row["interpretation"]}


def identify_all(df: DataFrame, id_col: str, features: list[str], target: str, predictors: list[str] | None = None, correlation_threshold: float = 0.1, p_value_threshold: float = 0.05, n_bootstrap: int = 1000, confidence_level: float = 0.95, random_state: int | None = None) -> list[dict]:
    """Confounders and mediators of each predictor (all features by default), in one job for all pairs."""
    frame = prepare(df, id_col, features, target).persist()
    seed = secrets.randbits(31) if random_state is None else random_state
    try:
        summary, screened, mediation = confounding.identify(frame, moments(frame, [*features, target]), features, target, predictors or features, correlation_threshold, p_value_threshold, n_bootstrap, confidence_level, seed)
        med = [_mediation(r, 4) for r in mediation.collect()]
        tested = [r.asDict() for r in screened.orderBy("predictor", "ordinal").collect()]
        return [s.asDict() | {"screening_results": [t for t in tested if t["predictor"] == s["predictor"]], "mediation_results": {m["mediator"]: m for m in med if m["predictor"] == s["predictor"]}} for s in summary.orderBy("ordinal").collect()]
    finally:
        frame.unpersist()


def identify_confounders(df: DataFrame, id_col: str, features: list[str], target: str, predictor: str, **options) -> dict:
    return identify_all(df, id_col, features, target, [predictor], **options)[0]


def kennedy_with_found_confounders(df: DataFrame, id_col: str, features: list[str], target: str, n_permutations: int = 5000, n_bootstrap: int = 1000, random_state: int | None = None, plan: str = "auto") -> dict | None:
    """Kennedy's test for the first predictor with identified confounders, controlling for them; None without one."""
    found = [s for s in identify_all(df, id_col, features, target, n_bootstrap=n_bootstrap, random_state=random_state) if s["identified_confounders"]]
    if not found:
        return None
    result = permutation_test_regression(df, id_col, features, target, n_permutations, method="kennedy", confounders=found[0]["identified_confounders"], random_state=random_state, plan=plan)
    return result | {"predictor": found[0]["predictor"], "confounders": found[0]["identified_confounders"]}


print_results_table = lambda *a, **k: print(report.coefficient_report(*a, **k))
print_joint_results_table = lambda *a, **k: print(report.joint_report(*a, **k))
