"""Plain-text reports, from the few rows of a result."""

from __future__ import annotations

from resampla.functions.text import short

# Widths of the report and its labels.
WIDTH, LEFT, LABEL, RIGHT, VALUE, NAME = 80, 40, 16, 27, 10, 25
LINEAR = (("R-squared:", "r_squared", "BIC:", "bic"), ("Adj. R-squared:", "r_squared_adj", "F-statistic:", "f_statistic"), ("", None, "Prob (F-stat):", "f_p_value"))
LOGISTIC = (("Pseudo R-sq:", "pseudo_r_squared", "BIC:", "bic"), ("Log-Likelihood:", "log_likelihood", "LL-Null:", "log_likelihood_null"), ("", None, "LLR p-value:", "llr_p_value"))


def _pair(label: str, value, other: str, number) -> str:
    return f"{label:<{LABEL}}{value:<{LEFT - LABEL}}{other:>{RIGHT}} {number:>{VALUE}}"


def _head(result: dict, target: str | None, title: str) -> list[str]:
    shown = result.get("diagnostics", {})
    out = ["=" * WIDTH, f"{title:^{WIDTH}}", "=" * WIDTH]
    if target:
        out.append(_pair("Dep. Variable:", short(target, 20), "No. Observations:", shown.get("n_observations", "N/A")))
    out.append(_pair("Model Type:", result["model_type"], "No. Features:", shown.get("n_features", "N/A")))
    out.append(_pair("Method:", result["method"], "AIC:", shown.get("aic", "N/A")))
    for label, name, other, number in LINEAR if result["model_type"] == "linear" else LOGISTIC:
        value = shown.get(number, "N/A")
        if number.endswith("_p_value") and not isinstance(value, str):
            value = "N/A" if value is None else f"{value:.4e}"
        out.append(_pair(label, shown.get(name, "N/A") if name else "", other, value))
    return out


def _legend(result: dict) -> list[str]:
    one, two = result["p_value_threshold_one"], result["p_value_threshold_two"]
    return ["=" * WIDTH, f"(*) p < {one}   (**) p < {two}   (ns) p >= {one}", ""]


def coefficient_report(result: dict, features: list[str], target: str | None = None, title: str = "Permutation Test Results") -> str:
    letter = "t" if result["model_type"] == "linear" else "z"
    rows = [f"{short(f, NAME):<{NAME}} {c:>12.4f} {e:>18} {a:>18}" for f, c, e, a in zip(features, result["model_coefs"], result["permuted_p_values"], result["classic_p_values"])]
    header = f"{'Feature':<{NAME}} {'Coef':>12} {f'P>|{letter}| (Emp)':>18} {f'P>|{letter}| (Asy)':>18}"
    return "\n".join([*_head(result, target, title), "-" * WIDTH, header, "-" * WIDTH, *rows, *_legend(result)])


def joint_report(result: dict, target: str | None = None, title: str = "Joint Permutation Test Results") -> str:
    out = [*_head(result, target, title), f"{'Metric:':<{LABEL}}{result['metric_type']}", "-" * WIDTH]
    out.append("Features Tested: " + ", ".join(short(f, NAME) for f in result["features_tested"]))
    if result["confounders"]:
        out.append("Confounders: " + ", ".join(short(c, NAME) for c in result["confounders"]))
    out += ["-" * WIDTH, f"{'Observed Improvement:':<30} {result['observed_improvement']:>12.4f}", f"{'Joint p-Value:':<30} {result['p_value_str']:>12}"]
    return "\n".join(out + _legend(result))


def confounder_report(summaries: list[dict], note: str = "") -> str:
    """Per predictor its lists, and the advice if either has entries; then the summary. ``note`` stands after both titles."""
    out = [f"Confounder Identification for All Predictors{note}", ""]
    for s in summaries:
        out += [f"Predictor: '{s['predictor']}'", f"  Identified Confounders: {s['identified_confounders']}", f"  Identified Mediators: {s['identified_mediators']}"]
        if s["identified_confounders"] or s["identified_mediators"]:
            out.append(f"  Recommendation: {s['recommendation']}")
        out.append("")
    out += [f"Summary: Predictors with Identified Confounders{note}", ""]
    found = [s for s in summaries if s["identified_confounders"]]
    out += [f"  {s['predictor']}: control for {s['identified_confounders']}" for s in found]
    if not found:
        out += ["  No confounders identified for any predictor.", "  This suggests the predictors are relatively independent."]
    return "\n".join([*out, ""])
