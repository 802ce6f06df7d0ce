"""Result tables: ratios, pooled deviations, integer recovery, long metrics to wide ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_deviation(pairs: DataFrame, a: str, b: str) -> Column:
    """Aggregate: the standard deviation between paired runs, sqrt(sum d^2 / 2n)."""
    d = F.col(a) - F.col(b)
    return F.sqrt(F.sum(d * d) / (2 * F.count(d)))


def recovered(value: Column, n: Column) -> Column:
    """The error count behind a rounded percentage of n; an error where it is ambiguous or doesn't fit."""
    e = F.rint(value * n / 100)
    fits = (n > 0) & (n < 100_000) & (F.abs(100 * e / n - value) <= 0.00050001)
    return F.when(fits, e.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no count of "), n.cast("string"), F.lit(" gives "), value.cast("string"))).cast("long"))


def relative_gain(base: Column, value: Column) -> Column:
    """By how many percent value lies below base."""
    return 100 * (base - value) / F.nullif(base, F.lit(0))


def gap_closed(base: Column, base_ref: Column, value: Column, value_ref: Column) -> Column:
    """By how many percent the distance of a metric to its reference shrank."""
    return relative_gain(base - base_ref, value - value_ref)


def dose_gain(first: Column, last: Column, value: Column) -> Column:
    """How many percent of the whole gain from first to last are reached at value."""
    return 100 * (first - value) / F.nullif(first - last, F.lit(0))


def wide(metrics: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """Long metrics (keys, name, value) with a column for each of the named metrics."""
    return metrics.groupBy(*keys).pivot(name, columns).agg(F.first(value))


def contrasts(table: DataFrame, model: str, value: str, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """(a, b, by, diff) of named pairs of models."""
    p = F.broadcast(table.sparkSession.createDataFrame(pairs, "a string, b string"))
    x = table.select(F.col(model).alias("a"), *by, F.col(value).alias("x"))
    y = table.select(F.col(model).alias("b"), *by, F.col(value).alias("y"))
    return x.join(p, "a").join(y, ["b", *by]).select("a", "b", *by, (F.col("x") - F.col("y")).alias("diff"))


def signed(c: Column, places: int = 2) -> Column:
    """A number with its sign, a true minus sign for negative ones."""
    return F.regexp_replace(F.format_string(f"%+.{places}f", c), "^-", "−")


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than `limit` rows raise an error."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *(line(r) for r in rows)]) + "\n"


def latex_macros(values: dict[str, str]) -> str:
    """Values as TeX definitions, special characters escaped."""
    safe = lambda v: "".join("\\" + c if c in "%&#_$" else c for c in v)
    return "".join(f"\\expandafter\\def\\csname {k}\\endcsname{{{safe(v)}}}\n" for k, v in sorted(values.items()))
