"""Scalar expressions: label parsing, three-valued logic, safe numbers, text pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_label(value: Column) -> Column:
    """{-1, 0, 1} to {0, 1}; anything else is null."""
    return F.when(value.isin(-1, 0), F.lit(0)).when(value == 1, F.lit(1))


def text_label(value: Column) -> Column:
    """Words for valid and invalid, whatever their case and surrounding space, to {1, 0}."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("valid", "true", "1", "+1"), F.lit(1)).when(v.isin("invalid", "false", "0", "-1"), F.lit(0))


def first_error_steps(first_error: Column, n_steps: Column) -> Column:
    """Step labels of a trace whose step ``first_error`` is the first wrong one: true before it,
    false there, null after it; all true for -1; null if it is out of range."""
    index = F.when(n_steps > 0, F.sequence(F.lit(0), n_steps - 1)).otherwise(F.array().cast("array<int>"))
    labels = F.transform(index, lambda i: F.when((first_error == -1) | (i < first_error), F.lit(True)).when(i == first_error, F.lit(False)))
    return F.when((first_error >= -1) & (first_error < n_steps), labels)


def rating_label(rating: Column) -> Column:
    return F.when(rating > 0, F.lit(True)).when(rating < 0, F.lit(False))


def three_valued_valid(steps: Column) -> Column:
    """False if any step is false, true if there are steps and all are true, else null."""
    return F.when(F.exists(steps, lambda x: F.coalesce(~x, F.lit(False))), F.lit(False)).when((F.size(steps) > 0) & F.forall(steps, lambda x: F.coalesce(x, F.lit(False))), F.lit(True))


def annotated_steps(generated: Column, annotations: Column) -> Column:
    """Label of each generated step: the chosen completion's rating if its index is valid, else that
    of the completion whose text equals the step, else null; never a counterfactual completion."""

    def label(step: Column, i: Column) -> Column:
        a = F.get(annotations, i)
        chosen = F.get(a["completions"], a["chosen_completion"])
        same = F.get(F.filter(a["completions"], lambda c: c["text"] == step), F.lit(0))
        valid = (a["chosen_completion"] >= 0) & (a["chosen_completion"] < F.size(a["completions"]))
        return rating_label(F.when(valid, chosen["rating"]).otherwise(same["rating"]))

    return F.transform(generated, label)


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def null_if_not_finite(value: Column) -> Column:
    return F.when(finite(value), value)


def json_number(value: Column) -> Column:
    """Numbers as text, NaN as null, infinities by name."""
    return F.when(value == float("inf"), F.lit("Infinity")).when(value == float("-inf"), F.lit("-Infinity")).when(~F.isnan(value), value.cast("string"))


def one_of(canonical: Column, alias: Column) -> tuple[Column, Column]:
    """(value, conflict) of a field that may stand under either of two names."""
    return F.coalesce(canonical, alias), canonical.isNotNull() & alias.isNotNull() & (canonical != alias)


def even_indices(length: Column, most: int) -> Column:
    """Up to ``most`` evenly spread indices, both ends included."""
    whole = F.sequence(F.lit(0), length - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (length - 1) / F.lit(float(max(most - 1, 1)))).cast("int"))
    return F.when(length <= 0, F.array().cast("array<int>")).when(length <= most, whole).otherwise(spread)


def same_width_neighbour(value: Column) -> Column:
    """Nearest other number with as many digits: +1, -1, +2, -2."""
    width = lambda x: F.length(x.cast("string"))
    fits = lambda d: (value + d >= 0) & (width(value + d) == width(value))
    return F.when(fits(1), value + 1).when(fits(-1), value - 1).when(fits(2), value + 2).when(fits(-2), value - 2)


def steps_text(steps: Column) -> Column:
    return F.array_join(steps, "\n")


def offsets_after(offsets: Column, start: Column) -> Column:
    """For each (start, end) pair whether it ends after both its own start and ``start``."""
    return F.transform(offsets, lambda o: o["end"] > F.greatest(o["start"], start))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def below(x: Column) -> Column:
    """The next smaller double."""
    up = x * F.lit(1 + 2.0**-53)
    return F.when(x > 0, x * F.lit(1 - 2.0**-53)).when(x == 0, F.lit(-5e-324)).otherwise(F.when(up < x, up).otherwise(x * F.lit(1 + 2.0**-52)))
