"""The best postings of each document: exact top-k over shared skills by an impact-ordered inverted index with upper bounds.

The score of a pair is the sum, over the skills that both have, of the document's credit times the posting's impact.
Comparing all pairs that share a skill grows with the product of both tables; here

* postings that ask for the same things are one class with its `most` smallest ids;
* a skill's list is cut by level (what a posting asks for from this skill on, in order of rarity) and, where long, into parts, so
  a key is (skill, level, part);
* each document first meets the `most` highest-impact classes of its skills: the last of its best ones is its bar;
* then it reads only levels that can still reach the bar, at the rarest skill that a pair shares, and only as long as
  its own skills from there on can reach it. Scores of what is left are exact.

Equal scores go to the smaller posting id, which bounds use too. The output has `most` rows a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import measured_broadcasts

#: Levels a doubling of what is asked, and postings of a list's part.
LEVELS, PART = 4, 2_000
_CREDIT = 4  # the highest


def _level(asked: Column) -> Column:
    return F.floor(F.log2(asked.cast("double")) * LEVELS).cast("int")


def _rest(vector: Column, at: Column, value: str) -> Column:
    """Sum of a vector's values from a place on."""
    return F.aggregate(F.slice(vector, at + 1, F.size(vector)), F.lit(0).cast("long"), lambda acc, x: acc + x[value])


def _first(rows: DataFrame, key: str | list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key; map tasks keep no more than that of each."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= most)


def vectors(owned: DataFrame, asked: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(a, v) and (b, v): skills with credits (quarters) or impacts (thousandths, required ones double), rarest in postings first."""
    theirs = asked.groupBy(b, "skill").agg(F.max((F.round(F.col("weight") * 1000) * F.when(F.col("required"), 2).otherwise(1)).cast("long")).alias("impact")).filter("impact > 0")
    stats = theirs.groupBy("skill").agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    mine = owned.groupBy(a, F.col("name").alias("skill")).agg(F.max(F.when(F.col("is_demonstrated"), _CREDIT).otherwise(3)).cast("long").alias("credit"))
    gather = lambda rows, key, *cols: rows.join(stats, "skill").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "skill", *cols))).alias("v"))
    return gather(mine, a, "credit", (F.col("credit") * F.col("top")).alias("bound")), gather(theirs, b, "impact")


def _score(mine: Column, theirs: Column) -> Column:
    credit = F.map_from_arrays(F.transform(mine, lambda x: x["skill"]), F.transform(mine, lambda x: x["credit"]))
    return F.aggregate(theirs, F.lit(0).cast("long"), lambda acc, x: acc + x["impact"] * F.coalesce(F.element_at(credit, x["skill"]), F.lit(0)))


def best_pairs(owned: DataFrame, asked: DataFrame, a: str, b: str, most: int = 20, part: int = PART) -> DataFrame:
    """a, b, score, rank: the `most` best postings of each document among those that ask for one of its skills.

    owned: a, name, is_demonstrated; asked: b, skill, required, weight. Documents without a shared skill have no row.
    """
    mine, theirs = vectors(measured_broadcasts(owned), asked, a, b)
    mine = mine.persist()  # read three times; small beside the texts
    members = _first(theirs, "v", [b], most).select("v", b, "__r").persist()
    classes = members.filter("__r = 1").select(F.col(b).alias("class"), F.col("v").alias("pv"))
    listed = classes.select("class", "pv", F.posexplode("pv").alias("at", "x")).select(
        "class", "pv", F.col("x.skill").alias("skill"), F.col("x.impact").alias("impact"), _rest(F.col("pv"), F.col("at"), "impact").alias("rest"))
    wanted = mine.select(a, F.col("v").alias("mv"), F.posexplode("v").alias("at", "x")).select(
        a, "mv", F.col("x.skill").alias("skill"), _rest(F.col("mv"), F.col("at"), "bound").alias("reach"))

    score, order = _score(F.col("mv"), F.col("pv")), [F.desc("score"), "class"]
    heads = _first(listed, "skill", [F.desc("impact"), "class"], most).select("skill", "class", "pv")
    met = wanted.select(a, "mv", "skill").join(heads, "skill").groupBy(a, "class").agg(F.max(score).alias("score"))
    bars = _first(met, a, order, most).filter(F.col("__r") == most).select(a, F.col("score").alias("bar"), F.col("class").alias("bar_class"))

    listed = listed.withColumn("level", _level(F.col("rest")))
    levels = listed.groupBy("skill", "level").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    barred = wanted.join(bars, a, "left").withColumn("bar", F.coalesce("bar", F.lit(1))).filter("reach >= bar")
    least = _level(F.ceil(F.col("bar") / _CREDIT))
    asking = barred.withColumn("least", least).join(levels, "skill").filter("level >= least").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = listed.join(levels, ["skill", "level"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    above = lambda most_possible: (most_possible > F.col("bar")) | ((most_possible == F.col("bar")) & (F.col("bar_class").isNull() | (F.col("class") <= F.col("bar_class"))))
    names = lambda v: F.transform(v, lambda x: x["skill"])
    found = (
        asking.join(dealt, ["skill", "level", "part"]).filter(above(F.least(F.col("rest") * _CREDIT, "reach")))
        .filter(F.array_intersect(names(F.col("mv")), names(F.col("pv")))[0] == F.col("skill"))  # a pair meets at its rarest shared skill
        .withColumn("score", score).filter(above(F.col("score"))))
    kept = _first(found.select(a, "class", "score"), a, order, most).select(a, "class", "score")
    own = members.join(classes, F.col("v") == F.col("pv")).select("class", b)
    return _first(kept.join(own, "class"), a, [F.desc("score"), b], most).select(a, b, "score", F.col("__r").alias("rank"))
