"""Quality rules whose limits come from mergeable quantile sketches, one a language and source.

A first pass measures every whole text. Each measure then goes into a deterministic log-linear
histogram sketch (32 buckets a power of two, so a quantile is off by at most 1/32 of its value):
the sketch of a group is a count for each bucket, and sketches merge by adding counts, within a
task, between tasks and between runs. From a group's sketch come the first and last tenth and the
median of each measure. They count as much as the group has documents: n of them weigh n to
HALF_WEIGHT against those of the language, which are weighed the same way against those of all
documents. A limit lies REACH times the distance between median and last (first) tenth beyond the last (first) tenth,
and a text may exceed it by what chance does in a text of its length (`Rule.allowance`: some items and a
multiple of the root of the length, no fixed share). The limits are joined back, and a document outside any of them goes.

Defined results: null text has no words and fails the base rule; null lang or source are groups of
their own; a text of any length is measured whole; repeated rows are judged separately; an empty
table gives no rows; other columns are ignored by `judge` and kept by `filter_quality`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialized, small_batches, table

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


#: Documents of a group at which its own quantiles count half, and how far beyond the tenths a limit lies, in their distance from the median.
HALF_WEIGHT, REACH = 200, 2


@dataclass(frozen=True)
class Rule:
    """A ratio in thousandths; allowance: what a text of its length may exceed a limit by (SQL over the measures)."""

    name: str
    over: str
    per: str
    allowance: str
    both_sides: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", "1e4 / sqrt(n_words)", both_sides=True),
    Rule("symbols", "n_symbols", "n_words", "(5e0 + 2e0 * sqrt(n_words)) * 1e3 / n_words"),
    Rule("dup_lines", "n_dup_lines", "n_lines", "(2e0 + sqrt(n_lines)) * 1e3 / n_lines"),
    Rule("repeats", "n_repeat_words", "n_words", "(5e0 + 2e0 * sqrt(n_words)) * 1e3 / n_words"),
)
_TENTHS = {"q1": 1, "q5": 5, "q9": 9}


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a whole text."""
    if not text:
        return (0,) * 6
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            upto = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + 3 - max(upto, i)
                    upto = i + 3
    return n, chars, symbols, dup, repeated, len(lines)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([measure_text(t) for t in pdf["text"]], columns=[c.split()[0] for c in _MEASURED.split(", ")], dtype="int64")
            yield pd.concat([pdf[["doc_id", "lang", "source"]].reset_index(drop=True), got], axis=1)

    return small_batches(documents.select("doc_id", "lang", "source", "text")).mapInPandas(scan, f"doc_id long, lang string, source string, {_MEASURED}")


def _bucket(value: Column) -> Column:
    """Sketch bucket of a whole number: exact below 64, then 32 a power of two; ordered as the values."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return shift * 32 + F.call_function("shiftright", value, shift)


def _edge(bucket: Column) -> Column:
    """Least value of a bucket."""
    shift = F.greatest((bucket / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", bucket - shift * 32, shift)


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all groups, one row a bucket."""
    ratios = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.expr(f"{r.over} * 1000 div {r.per}").alias("value")) for r in RULES]))
    return (
        measured.filter("n_words > 0").select("lang", "source", ratios.alias("r"))
        .groupBy("lang", "source", F.col("r.rule").alias("rule"), _bucket(F.col("r.value")).cast("long").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: bucket counts are added."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and by rule a struct of n (documents) and the first tenth, the median and the last tenth of each group's merged sketch."""
    w = Window.partitionBy(*keys, "rule").orderBy("bucket")
    whole = Window.partitionBy(*keys, "rule")
    ranked = merge_sketches(sketches, keys).select(
        *keys, "rule", "bucket", F.sum("n").over(w).alias("upto"), F.sum("n").over(whole).alias("total"))
    tenths = [_edge(F.min(F.when(F.col("upto") * 10 >= F.col("total") * t, F.col("bucket")))).cast("double").alias(q) for q, t in _TENTHS.items()]
    found = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("n"), *tenths)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("rule") == r.name, F.struct("n", *_TENTHS))).alias(r.name) for r in RULES])


def weighed(own: Column, wider: Column) -> Column:
    """A group's quantiles drawn to the wider group's, the more the fewer documents it has."""
    w = own["n"] / (own["n"] + F.lit(float(HALF_WEIGHT)))
    return F.struct(*[(w * own[q] + (F.lit(1.0) - w) * wider[q]).alias(q) for q in _TENTHS])


def judge(measured: DataFrame) -> DataFrame:
    """The measures plus base_failed, kept and `broken` (names of the rules a document breaks)."""
    groups = materialized(sketch(measured), "quality-sketch")
    names = [r.name for r in RULES]

    def level(keys: list[str], suffix: str) -> DataFrame:
        return quantiles(groups, keys).select(*[F.col(k).alias(f"__{k}{suffix}") for k in keys], F.struct(*names).alias(f"__q{suffix}"))

    both, lang, every = level(["lang", "source"], "0"), level(["lang"], "1"), level([], "2")
    # all limits of a (lang, source) pair in one row, so that the documents are joined once
    chosen = both.join(lang, F.col("__lang0").eqNullSafe(F.col("__lang1"))).crossJoin(every)  # `every` is one row
    chosen = chosen.select("__lang0", "__source0", *[weighed(F.col(f"__q1.{r}"), F.col(f"__q2.{r}")).alias(f"__w_{r}") for r in names], "__q0")
    chosen = chosen.select("__lang0", "__source0", F.struct(*[weighed(F.col(f"__q0.{r}"), F.col(f"__w_{r}")).alias(r) for r in names]).alias("__l"))
    joined = measured.join(chosen, F.col("lang").eqNullSafe(F.col("__lang0")) & F.col("source").eqNullSafe(F.col("__source0")), "left")
    broken = []
    for r in RULES:
        value, allowed = F.expr(f"{r.over} * 1000 div nullif({r.per}, 0)"), F.expr(f"CASE WHEN {r.per} > 0 THEN {r.allowance} END")
        first, mid, last = (F.col(f"__l.{r.name}.{q}") for q in _TENTHS)
        out = value > last + REACH * (last - mid) + allowed
        if r.both_sides:
            out = out | (value < first - REACH * (mid - first) - allowed)
        broken.append(F.when(out, F.lit(r.name)))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return joined.withColumn("base_failed", base_failed).withColumn("broken", F.concat_ws(",", *broken)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("broken") == "")
    ).drop("__lang0", "__source0", "__l")


def filter_quality(documents: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; of a doc_id that comes several times all rows stay if one of them passes."""
    passed = judge(materialized(measure(documents), "quality-measures")).filter("kept").select("doc_id")
    return documents.join(passed, "doc_id", "left_semi")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialized(measure(table(spark, sf_dir, "documents")), "quality-measures")
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


def _sql_ratio(r: Rule, per: str) -> str:
    return f"{r.over} * 1000 // {per}"


def _sql_level(keys: str, name: str) -> str:
    by = f"{keys}, " if keys else ""
    tenths = ", ".join(f"(min(edge) FILTER (WHERE upto * 10 >= total * {t}))::DOUBLE AS {q}" for q, t in _TENTHS.items())
    return f"""{name} AS (
  SELECT {by}rule, max(total) AS n, max(total) / (max(total) + {HALF_WEIGHT}e0) AS w, {tenths}
  FROM (SELECT {by}rule, edge, sum(n) OVER (PARTITION BY {by}rule ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY {by}rule)::DOUBLE AS total
    FROM (SELECT {by}rule, edge, count(*) AS n FROM ratios GROUP BY ALL)) GROUP BY ALL)"""


def _sql_weighed(q: str) -> str:
    return f"l0.w * l0.{q} + (1e0 - l0.w) * (l1.w * l1.{q} + (1e0 - l1.w) * l2.{q}) AS {q}"


#: DuckDB SQL for op3. A bucket's least value stands for the bucket.
OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
counts AS (SELECT rid, count(*) AS n_words, sum(len(word)) AS word_chars FROM w GROUP BY rid),
tri AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS k
  FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
repeated AS (SELECT rid, count(DISTINCT j) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM tri WHERE k IS NOT NULL) WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT t.rid, t.doc_id, t.lang, t.source, coalesce(c.n_words, 0) AS n_words, CAST(coalesce(c.word_chars, 0) AS BIGINT) AS word_chars,
    len(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM t LEFT JOIN counts c ON t.rid = c.rid LEFT JOIN lines l ON t.rid = l.rid LEFT JOIN repeated r ON t.rid = r.rid
), ratios AS (
  SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (len(bin(v)) - 6)::BIGINT) << (len(bin(v)) - 6)::BIGINT END AS edge FROM (
    """ + "\n    UNION ALL ".join(
    f"SELECT lang, source, '{r.name}' AS rule, {_sql_ratio(r, r.per)} AS v FROM m WHERE n_words > 0" for r in RULES) + r"""
  )), """ + ",\n".join((_sql_level("lang, source", "l0"), _sql_level("lang", "l1"), _sql_level("", "l2"))) + r""",
judged AS (
  SELECT m.rid, r.rule, r.v, r.allowed, """ + ", ".join(map(_sql_weighed, _TENTHS)) + r"""
  FROM m JOIN (
    """ + "\n    UNION ALL ".join(
    f"SELECT rid, '{r.name}' AS rule, {_sql_ratio(r, r.per)} AS v, {r.allowance} AS allowed FROM m WHERE n_words > 0" for r in RULES) + r"""
  ) r ON m.rid = r.rid
  JOIN l0 ON l0.rule = r.rule AND l0.lang IS NOT DISTINCT FROM m.lang AND l0.source IS NOT DISTINCT FROM m.source
  JOIN l1 ON l1.rule = r.rule AND l1.lang IS NOT DISTINCT FROM m.lang
  JOIN l2 ON l2.rule = r.rule
), broken AS (
  SELECT rid, string_agg(rule, ',' ORDER BY CASE rule """ + " ".join(f"WHEN '{r.name}' THEN {i}" for i, r in enumerate(RULES)) + r""" END) AS rules
  FROM judged WHERE CASE rule
    """ + "\n    ".join(
    f"WHEN '{r.name}' THEN v > q9 + {REACH} * (q9 - q5) + allowed" + (f" OR v < q1 - {REACH} * (q5 - q1) - allowed" if r.both_sides else "") for r in RULES) + r""" END
  GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND b.rules IS NULL AS kept,
  coalesce(b.rules, '') AS broken
FROM m LEFT JOIN broken b ON m.rid = b.rid
"""
