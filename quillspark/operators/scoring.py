"""Dimension and overall scores, bands, ranked recommendations, strengths, headline, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators.signals import band


def weight_of(dimension: Column, with_job: Column | bool) -> Column:
    def table(weights: dict[str, float]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), dimension), F.lit(0.0))

    with_job = F.lit(with_job) if isinstance(with_job, bool) else with_job
    return F.when(with_job, table(L.WEIGHTS_WITH_JOB)).otherwise(table(L.WEIGHTS_WITHOUT_JOB))


def severity_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in L.SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]), level)


def _severity(rank: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in L.SEVERITY_RANK.items() for x in (v, k)]), rank)


def dimension_scores(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dimension, score (weighted mean of 100, one digit), severity (the worst)."""
    return signals.groupBy(*keys, "dimension").agg(
        T.round_binary(F.lit(100.0) * F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), F.lit(0.0)), 1).alias("score"),
        _severity(F.min(severity_rank(F.col("severity")))).alias("severity"))  # by number: an aggregate that holds strings sorts its rows first


def overall_scores(dimensions: DataFrame, keys: list[str], with_job: bool = False) -> DataFrame:
    """keys, overall, band: weighted mean of the rounded dimension scores, in decimals, so that no order of adding moves a tie."""
    w = weight_of(F.col("dimension"), with_job).cast("decimal(4,2)")
    total = F.round(F.coalesce(F.try_divide(F.sum(F.col("score").cast("decimal(6,1)") * w), F.sum(w)), F.lit(0)), 1).cast("double")
    return dimensions.groupBy(*keys).agg(total.alias("overall")).withColumn("band", band(F.col("overall")))


def recommendations(signals: DataFrame, keys: list[str], with_job: bool = False) -> DataFrame:
    """keys, rank, signal_id, ..., impact: overall points to win, worst severity first."""
    by = [*keys, "dimension"]
    w = weight_of(F.col("dimension"), with_job) / F.lit(sum((L.WEIGHTS_WITH_JOB if with_job else L.WEIGHTS_WITHOUT_JOB).values()))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*by))
    # dealt by the keys once, which suits both windows; the test of the advice goes along instead of its text
    dealt = signals.withColumn("__open", (F.col("score") < 0.95) & (F.col("recommendation") != "")).repartition(*keys)
    rows = dealt.withColumn("impact", T.round_binary((1 - F.col("score")) * share * w * 100, 2)).filter("__open")
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), F.desc("impact"), "signal_id")
    return rows.withColumn("rank", F.row_number().over(order)).select(
        *keys, "rank", "signal_id", "dimension", "severity", F.col("label").alias("title"), F.col("recommendation").alias("action"),
        F.slice("evidence", 1, 4).alias("evidence"), "impact")


def ranked_issues(signals: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "dimension").orderBy(F.desc("points_lost"), "signal_id")
    return signals.filter("score < 0.95").withColumn("rank", F.row_number().over(w))


def strengths(signals: DataFrame, keys: list[str]) -> DataFrame:
    return signals.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("score") >= 0.95, F.col("label")))).alias("strengths"))


def headline(recommended: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top_action (first with an impact of 1 or more), first_critical."""
    return recommended.groupBy(*keys).agg(
        F.min_by("action", F.when(F.col("impact") >= 1.0, F.col("rank"))).alias("top_action"),
        F.min_by("title", F.when(F.col("severity") == "critical", F.col("rank"))).alias("first_critical"))


def bar(score: Column) -> Column:
    return F.rpad(F.repeat(F.lit("#"), F.bround(score / 5, 0).cast("int")), 20, ".")


def report_lines(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, line: a dimension a line with a bar of 20."""
    order = F.element_at(F.create_map(*[x for i, (k, _) in enumerate(L.DIMENSIONS) for x in (F.lit(k), F.lit(i))]), F.col("dimension"))
    label = F.element_at(F.create_map(*[F.lit(x) for d in L.DIMENSIONS for x in d]), F.col("dimension"))
    return dimensions.select(*keys, order.alias("position"), F.format_string("%-26s %5.1f [%s]", label, "score", bar(F.col("score"))).alias("line"))
