"""Run modes, output and results as queries over a log of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_once(calls: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The first call of each name.

    A grouped minimum of the whole row: combined before the shuffle, so a name
    with most of the calls is no burden, as a ranking window would make it.
    """
    row = F.struct(*order, *(c for c in calls.columns if c not in order))
    return calls.groupBy(F.col(name).alias("_name")).agg(F.min(row).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in calls.columns))


def run_changed(calls: DataFrame, name: str, variables: str, order: Sequence[str]) -> DataFrame:
    """Calls whose variables differ from those of the call of that name before; the first of each name always runs."""
    w = Window.partitionBy(name).orderBy(*order)
    before, nth = F.lag(variables).over(w), F.row_number().over(w)
    marked = calls.withColumn("_before", before).withColumn("_nth", nth)
    return marked.where((F.col("_nth") == 1) | ~F.col("_before").eqNullSafe(F.col(variables))).drop("_before", "_nth")


def joined_lines(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, output): each line trimmed, in order, joined by newlines, the whole trimmed."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.trim(F.col(text)).alias("line"))))
    return lines.groupBy(by).agg(F.trim(F.array_join(F.transform(held, lambda x: x["line"]), "\n")).alias("output"))


def dependency_results(results: DataFrame, by: str, name: Column, result: Column) -> DataFrame:
    """(by, results): name=result of each dependency, sorted, as one text."""
    return results.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", name.cast("string"), result.cast("string")))), ",").alias("results"))


def numbered_names(calls: DataFrame, by: str, name: str, order: Sequence[str]) -> DataFrame:
    """Adds ``dep_name``: the name, with _1, _2 and so on where a parent calls it more than once."""
    group = Window.partitionBy(by, name)
    n, k = F.count(F.lit(1)).over(group), F.row_number().over(group.orderBy(*order))
    text = F.col(name).cast("string")
    return calls.withColumn("dep_name", F.when(n > 1, F.concat_ws("_", text, k.cast("string"))).otherwise(text))


def or_empty(value: Column) -> Column:
    """What a failed or missing result becomes where errors are ignored."""
    return F.coalesce(value.cast("string"), F.lit(""))
