"""Filter interaction audit: what each filter removes in every order, from one CUBE over failure flags and part.

Each document gets five failure flags from one pass over its text. Rows are summed by flags and part
before the cube, so that the cube reads at most 32 rows a part. Its rows of the grouping sets with
`part`, whose selected flags are all false, are the survivors of each subset of filters. A step of an order turns a
subset into one with a filter more: the 80 such pairs of a part are joined once, with the part's Shapley sums, and
then with the 600 (order, step) rows that name a pair.

A text's first document is found by its SHA-256: rows are summed by (text, part, labels) first, so that a text that a third of the rows
share is a few rows a task when it is shuffled, and the window by text has a row a part and label.

Defined results: null text is empty text, null source the part ''; empty text fails A only (and E, if a smaller id has it); a null doc_id has
no smaller ids and no labels; a doc_id of several rows counts once a row, and equal texts of one id do not fail E; of several label rows of an
id one with a 1 is enough; ties need no rule; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import literal_rows, materialized, table

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_COUNTS = ("n", "good", "toxic")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_flags(documents: DataFrame) -> DataFrame:
    """doc_id, part, A to D (true: the text fails) and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    read = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n, capitals = F.size("words"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return read.select(
        "doc_id", "part", (n < 200).alias("A"), (F.size(F.array_distinct("words")) * 100 < n * 50).alias("B"),
        (capitals * 100 > F.length("text") * 2).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: documents by part and flags, and how many of them have each label."""
    own = ["part", "A", "B", "C", "D"]
    marked = labels.groupBy(F.col("doc_id").alias("__id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = text_flags(documents).join(marked, F.col("doc_id") == F.col("__id"), "left").na.fill(False, ["good", "toxic"])
    # rows of one id together (no further shuffle), then of one text
    by_id = rows.groupBy("doc_id", "digest", *own, "good", "toxic").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest", *own, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    is_first = F.col("first") == F.min("first").over(Window.partitionBy("digest"))
    passing = F.when(is_first, F.col("n_first")).otherwise(0) + F.col("n_null")
    split = by_text.withColumn("passing", passing).select(
        *own, "good", "toxic", F.explode(F.array(
            F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n")))).alias("e"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("e.n")).otherwise(0)).alias(c)
    return split.filter("e.n > 0").groupBy(*own, F.col("e.E").alias("E")).agg(F.sum("e.n").alias("n"), counted("good"), counted("toxic"))


def subset_survivors(counts: DataFrame) -> DataFrame:
    """part, whole (over all parts), subset (bits of FILTERS), n, good, toxic: what passes each subset of filters, zeros included."""
    cube = counts.cube(*FILTERS, "part").agg(*[F.sum(c).alias(c) for c in _COUNTS], *[F.grouping(c).alias(f"g_{c}") for c in (*FILTERS, "part")])
    passes = F.lit(True)
    subset: Column = F.lit(0)
    for f in FILTERS:
        passes &= (F.col(f"g_{f}") == 1) | ~F.col(f)
        subset += (1 - F.col(f"g_{f}")) * _bit(f)
    found = cube.filter(passes).select("part", (F.col("g_part") == 1).alias("whole"), subset.alias("subset"), *_COUNTS)
    every = found.filter("subset = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("subset"))
    on = F.col("e.part").eqNullSafe(F.col("f.part")) & (F.col("e.whole") == F.col("f.whole")) & (F.col("e.subset") == F.col("f.subset"))
    return every.alias("e").join(found.alias("f"), on, "left").select("e.part", "e.whole", "e.subset", *[F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in _COUNTS])


def _steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, before (bits of the earlier filters): one row a step of each order."""
    orders = literal_rows(spark, [("".join(p),) for p in permutations(FILTERS)], "filter_order")
    letters = orders.select("filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("at")), ""), F.lit(0), lambda acc, f: acc + _bit_of(f))
    return letters.filter("filter <> ''").select("filter_order", (F.col("at") + 1).alias("step"), "filter", F.when(F.col("at") > 0, before).otherwise(0).alias("before"))


def _bit_of(name: Column) -> Column:
    return F.coalesce(*[F.when(name == f, _bit(f)) for f in FILTERS], F.lit(0))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, whole, filter_order, step, filter and the counts of each step; rows with `whole` are over all parts together."""
    survivors = materialized(subset_survivors(failure_counts(documents, labels)), "audit-survivors")
    key = ["part", "whole"]
    same = lambda a, b: F.col(f"{a}.part").eqNullSafe(F.col(f"{b}.part")) & (F.col(f"{a}.whole") == F.col(f"{b}.whole"))
    more = survivors.select(*key, "subset", *_COUNTS, F.explode(F.array(*map(F.lit, FILTERS))).alias("filter"))
    more = more.withColumn("bit", _bit_of(F.col("filter"))).filter(F.col("subset").bitwiseAND(F.col("bit")) == 0)
    pairs = more.alias("b").join(survivors.alias("a"), same("a", "b") & (F.col("a.subset") == F.col("b.subset") + F.col("b.bit"))).select(
        *[F.col(f"b.{k}") for k in key], "b.filter", F.col("b.subset").alias("before"), F.col("a.n").alias("kept"),
        *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(name) for c, name in zip(_COUNTS, ("removed", "good_lost", "toxic_lost"))])
    each = Window.partitionBy(*key, "filter")
    others = len(FILTERS) - 1
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(others - k)) for k in range(others + 1)]), F.bit_count("before") + 1)
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(each)
    pairs = pairs.select(
        "*", (fails - F.col("removed")).alias("redundant"), F.min(F.when(F.bit_count("before") == others, F.col("removed"))).over(each).alias("unique_fails"),
        F.sum(F.col("removed") * orders).over(each).alias("shapley"))
    steps = F.broadcast(_steps(documents.sparkSession))  # 600 rows
    return pairs.join(steps, ["filter", "before"]).select(
        *key, "filter_order", "step", "filter", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.filter("NOT whole").drop("whole", "filter")


#: DuckDB SQL for op11: every document goes through every order; no cube.
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(m.doc_id > first, false)] AS fails
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
seen AS (
  SELECT part, good, toxic, filter_order, list_sum(list_transform(fails, lambda x: x::INT)) AS n_fails,
    list_transform([1, 2, 3, 4, 5], lambda i: fails[ascii(substr(filter_order, i, 1)) - 64]) AS failed FROM f, orders),
at_step AS (
  SELECT part, filter_order, step, failed[step] AS fails, good, toxic, n_fails, coalesce(nullif(list_position(failed, true), 0), 6) AS gone
  FROM seen, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
counted AS (
  SELECT part, filter_order, step, count(*) FILTER (WHERE gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
    count(*) FILTER (WHERE fails AND gone < step) AS redundant, count(*) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
    count(*) FILTER (WHERE gone = step AND good) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost
  FROM at_step GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM counted
"""
