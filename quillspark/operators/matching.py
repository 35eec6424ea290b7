"""Documents against postings: skill coverage, gaps, surplus, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

STEM = 5
COVERED_FROM = 0.6


def asked_and_owned(pairs: DataFrame, asked: DataFrame, owned: DataFrame, a: str, b: str) -> DataFrame:
    """Each skill asked of each pair, with the mention's is_demonstrated where the document has it (credit 0, 0.75 or 1)."""
    mine = owned.select(a, F.col("name").alias("skill"), "is_demonstrated")
    rows = pairs.select(a, b).join(asked, b).join(mine, [a, "skill"], "left")
    credit = F.when(F.col("is_demonstrated").isNull(), 0.0).when(F.col("is_demonstrated"), 1.0).otherwise(0.75)
    return rows.withColumn("credit", credit)


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts, required_share (weighted), required_coverage (unweighted, 3 digits), matched skills."""
    need, hit = F.col("required"), F.col("credit") > 0
    return rows.groupBy(*keys).agg(
        F.count_if(need).alias("n_required"), F.count_if(~need).alias("n_preferred"), F.count_if(~need & hit).alias("preferred_hits"),
        F.coalesce(F.try_divide(F.sum(F.when(need, F.col("weight") * F.col("credit"))), F.sum(F.when(need, F.col("weight")))), F.lit(0.0)).alias("required_share"),
        F.coalesce(F.round(F.try_divide(F.count_if(need & hit).cast("double"), F.count_if(need).cast("double")), 3), F.lit(1.0)).alias("required_coverage"),
        F.array_sort(F.collect_set(F.when(need & hit, F.col("skill")))).alias("matched_required"),
        F.array_sort(F.collect_set(F.when(need & ~hit, F.col("skill")))).alias("missing_required"),
        F.array_sort(F.collect_set(F.when(~need & hit, F.col("skill")))).alias("matched_preferred"))


def with_coverage(rows: DataFrame, asked: Column, owned: Column) -> DataFrame:
    """Adds the counts and required_share of `coverage` from arrays of (skill, required, weight) and of (name, is_demonstrated), either null for none."""
    out = rows.withColumn("__owned", F.coalesce(owned, F.array().cast("array<struct<name:string,is_demonstrated:boolean>>")))
    own = lambda x, shown: F.exists("__owned", lambda o: (o["name"] == x["skill"]) & (o["is_demonstrated"] | ~shown))
    credited = F.transform(F.coalesce(asked, F.array().cast("array<struct<skill:string,required:boolean,weight:double>>")), lambda x: F.struct(
        x["required"].alias("required"), x["weight"].alias("weight"), F.when(own(x, F.lit(True)), 1.0).when(own(x, F.lit(False)), 0.75).otherwise(0.0).alias("credit")))
    out = out.withColumn("__asked", credited)
    out = out.withColumn("__need", F.filter("__asked", lambda x: x["required"])).withColumn("__wish", F.filter("__asked", lambda x: ~x["required"]))
    total = lambda f: F.aggregate(F.transform("__need", f), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("n_required", F.size("__need")).withColumn("n_preferred", F.size("__wish")).withColumn("preferred_hits", F.size(F.filter("__wish", lambda x: x["credit"] > 0)))
    out = out.withColumn("required_share", F.coalesce(F.try_divide(total(lambda x: x["weight"] * x["credit"]), total(lambda x: x["weight"])), F.lit(0.0)))
    return out.drop("__owned", "__asked", "__need", "__wish")


def gaps(rows: DataFrame, edges: DataFrame, owned: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, skill, required, category, adjacent_owned, priority: asked skills that the document lacks."""
    missing = rows.filter("credit = 0").select(a, b, "skill", "required", "category")
    near = (
        missing.join(edges.withColumnRenamed("name", "skill"), "skill")
        .join(owned.select(a, F.col("name").alias("related")), [a, "related"])
        .groupBy(a, b, "skill").agg(F.array_sort(F.collect_set("related")).alias("adjacent_owned"))
    )
    out = missing.join(near, [a, b, "skill"], "left").withColumn("adjacent_owned", F.coalesce("adjacent_owned", F.array().cast("array<string>")))
    return out.withColumn("priority", F.when(~F.col("required"), "low").when(F.size("adjacent_owned") > 0, "medium").otherwise("high"))


def ordered_gaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank: high before medium before low, then by name."""
    worst = F.element_at(F.create_map(*[x for i, p in enumerate(("high", "medium", "low")) for x in (F.lit(p), F.lit(i))]), F.col("priority"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(worst, "skill")))


def surplus(pairs: DataFrame, asked: DataFrame, owned: DataFrame, a: str, b: str, most: int = 20) -> DataFrame:
    """a, b, surplus_skills: owned, not asked."""
    rows = pairs.select(a, b).join(owned.select(a, F.col("name").alias("skill")), a).join(asked.select(b, "skill"), [b, "skill"], "left_anti")
    return rows.groupBy(a, b).agg(F.slice(F.array_sort(F.collect_set("skill")), 1, most).alias("surplus_skills"))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(T.content_tokens(text), lambda t: F.substring(t, 1, STEM)))


def missing_keywords(keywords: Column, document_stems: Column) -> Column:
    """Keywords of which less than 60 % of the words' stems occur; one without content words is never missing."""

    def lacking(k: Column) -> Column:
        mine = F.transform(T.content_tokens(k), lambda t: F.substring(t, 1, STEM))
        hits = F.size(F.filter(mine, lambda s: F.array_contains(document_stems, s)))
        return (F.size(mine) > 0) & (hits.cast("double") / F.greatest(F.size(mine), F.lit(1)) < COVERED_FROM)

    return F.filter(keywords, lacking)
