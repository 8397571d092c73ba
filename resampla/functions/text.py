"""Text forms of results, as column expressions and for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stars(p: Column, one: float, two: float) -> Column:
    """Significance mark of an unrounded p-value; an undefined one is not significant."""
    sound = p.isNotNull() & ~F.isnan(p)
    return F.when(sound & (p < two), " (**)").when(sound & (p < one), " (*)").otherwise(" (ns)")


def star(p: float, one: float, two: float) -> str:
    return " (**)" if p < two else " (*)" if p < one else " (ns)"  # comparisons with NaN are false


def rounded(x: float, precision: int) -> str:
    """Half-even rounding, in the shortest form; never with an exponent at the precisions in use."""
    if x is None or math.isnan(x):
        return "nan"
    text = repr(round(float(x), precision))
    return text if "e" not in text else f"{float(x):.{precision}f}"


def marked(p: float, precision: int, one: float, two: float) -> str:
    return rounded(p, precision) + star(p, one, two)


def marked_column(p: Column, precision: int, one: float, two: float) -> Column:
    """As ``marked``, for precisions up to 3, where all engines print doubles alike."""
    return F.concat(F.bround(p, precision).cast("string"), stars(p, one, two))


def shortened(name: Column, most: int) -> Column:
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 3), F.lit("...")))


def short(name: str, most: int) -> str:
    return name if len(name) <= most else name[: most - 3] + "..."


# The sentences of results; {p} predictor, {m} mediator, {c} confounders.
CONTROL = "For Kennedy method with predictor '{p}', control for: {c}"
FOUND_TITLE = "Kennedy (1995) Method for '{p}' (controlling for {c}) ({k})"
NO_CONTROL = "No confounders identified for predictor '{p}'. Consider using ter Braak method instead."
FULL = "'{m}' is a full mediator. It explains most of the effect of '{p}' on the outcome. Do not control for it as a confounder."
PARTIAL = "'{m}' is a partial mediator. It explains some of the effect of '{p}' on the outcome. Consider whether to control for it based on research question."
NEITHER = "'{m}' is not a significant mediator. It may be a confounder if correlated with both '{p}' and outcome. Consider controlling for it."
MASKED = "N/A (confounder)"


def filled(template: str, **columns: Column) -> Column:
    """A template with its fields taken from columns."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out


def recommendation(predictor: Column, confounders: Column) -> Column:
    """Advice from the list of identified confounders, which may be empty."""
    quoted = F.array_join(F.transform(confounders, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    return F.when(F.size(confounders) > 0, filled(CONTROL, p=predictor, c=quoted)).otherwise(filled(NO_CONTROL, p=predictor))


def interpretation(predictor: Column, mediator: Column, is_mediator: Column, total: Column, direct: Column) -> Column:
    """A significant mediator is full if less than a tenth of the total effect is direct."""
    say = lambda t: filled(t, m=mediator, p=predictor)
    return F.when(is_mediator & (F.abs(direct) < F.abs(total) * 0.1), say(FULL)).when(is_mediator, say(PARTIAL)).otherwise(say(NEITHER))
