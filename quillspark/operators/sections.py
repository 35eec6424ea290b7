"""Sections of a document and buckets of a posting, inside the row: no shuffle, lines never leave their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T


def explode_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line, is_blank, is_bullet: one row a line."""
    return documents.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line")).select(
        key, "line_no", "line", (~F.col("line").rlike(r"\S")).alias("is_blank"), T.is_bullet(F.col("line")).alias("is_bullet"))


def with_sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds sections (map of kind to heading, body, start_line, end_line, word_count) and unknown_headings; same kinds are merged.

    Each step is a column of its own, so that no expression is evaluated twice.
    """
    out = documents.withColumn("__rows", T.lines(F.col(text)))
    # an array a step, so that what a step makes is bound to the next one's variable and not made again at each use
    bare = F.transform("__rows", lambda x: F.struct(F.length(x).alias("size"), T.strip(x).alias("heading")))
    cores = F.transform(bare, lambda m: F.struct(
        m["size"].alias("size"), m["heading"].alias("heading"), F.when(F.length(m["heading"]) <= 120, T.undecorated(m["heading"])).alias("core")))
    sized = F.transform(cores, lambda m: F.struct(m["heading"].alias("heading"), m["core"].alias("core"), F.when(
        (m["size"] <= 120) & T.may_head(m["heading"], m["core"]), T.core_counts(m["core"])).alias("n")))
    seen = F.transform(sized, lambda m, i: F.struct(
        i.alias("i"), m["heading"].alias("heading"), (m["heading"] != "").alias("filled"), F.lower(T.strip(m["core"])).alias("text"),
        F.coalesce(T.heads(m["core"], m["n"]), F.lit(False)).alias("like")))
    out = out.withColumn("__seen", seen)
    out = out.withColumn("__first", F.coalesce(F.get(F.filter("__seen", lambda m: m["filled"]), F.lit(0))["i"], F.size("__rows")))
    out = out.withColumn("__marks", F.filter(F.transform("__seen", lambda m: F.struct(
        m["i"].alias("i"), m["heading"].alias("heading"), T.kind_of(m["text"], m["like"]).alias("kind"),
        (m["like"] & (m["i"] != F.col("__first")) & ((m["i"] == 0) | ~F.coalesce(F.get("__seen", m["i"] - 1)["filled"], F.lit(False)))).alias("unknown"),
    )), lambda m: m["kind"].isNotNull() | m["unknown"]))
    out = out.withColumn("__ends", F.concat(F.slice(F.transform("__marks", lambda m: m["i"]), 2, 1_000_000), F.array(F.size("__rows"))))

    def body(start: Column, end: Column) -> Column:
        return T.strip(T.join_lines(F.slice("__rows", start + 1, F.greatest(end - start, F.lit(0)))))

    head_end = F.coalesce(F.get("__marks", F.lit(0))["i"], F.size("__rows"))
    header = F.struct(F.lit("contact").alias("kind"), F.lit("(header)").alias("heading"), body(F.lit(0), head_end).alias("body"),
                      F.lit(0).alias("start_line"), head_end.alias("end_line"), F.lit(False).alias("unknown"))
    cut = F.transform("__marks", lambda m, j: F.struct(
        F.coalesce(m["kind"], F.lit("other")).alias("kind"), m["heading"].alias("heading"), body(m["i"] + 1, F.get("__ends", j)).alias("body"),
        m["i"].alias("start_line"), F.get("__ends", j).alias("end_line"), m["kind"].isNull().alias("unknown")))
    out = out.withColumn("__pieces", F.filter(F.concat(F.array(header), cut), lambda p: p["body"] != ""))
    out = out.withColumn("__kinds", F.array_distinct(F.transform("__pieces", lambda p: p["kind"])))

    def merged(kind: Column) -> Column:
        mine = F.filter("__pieces", lambda p: p["kind"] == kind)
        return F.struct(F.get(mine, F.lit(0))["heading"].alias("heading"), F.array_join(F.transform(mine, lambda p: p["body"]), "\n").alias("body"),
                        F.get(mine, F.lit(0))["start_line"].alias("start_line"), F.element_at(mine, -1)["end_line"].alias("end_line"))

    out = out.withColumn("__merged", F.transform("__kinds", merged))
    out = out.withColumn("sections", F.map_from_arrays("__kinds", F.transform("__merged", lambda m: F.struct(
        m["heading"].alias("heading"), m["body"].alias("body"), m["start_line"].alias("start_line"), m["end_line"].alias("end_line"), T.word_count(m["body"]).alias("word_count")))))
    out = out.withColumn("unknown_headings", F.transform(F.filter("__pieces", lambda p: p["unknown"]), lambda p: p["heading"]))
    return out.drop("__rows", "__seen", "__first", "__marks", "__ends", "__pieces", "__kinds", "__merged")


def section_body(kind: str) -> Column:
    return F.coalesce(F.element_at("sections", F.lit(kind))["body"], F.lit(""))


def section_table(sectioned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, heading, body, start_line, end_line, word_count: one row a section.

    explode_outer here and elsewhere over parsed columns: for explode Spark infers a filter on the
    array, and copies the parsing into it when it pushes that filter down.
    """
    return sectioned.select(key, F.explode_outer("sections").alias("kind", "s")).filter("kind is not null").select(key, "kind", "s.*")


def job_heading(line: Column) -> Column:
    """Bucket that a posting's heading line opens, or null."""
    return _bucket_of(_job_core(T.strip(line)))


def _job_core(bare: Column) -> Column:
    """A heading without its colon, in lower case; null if the line is none."""
    is_heading = (F.length(bare) <= 60) & (bare.rlike(r"^[A-Za-z][A-Za-z'’/&\- ]{2,50}\s*:?$") | bare.rlike(":$"))
    return F.when(is_heading, F.lower(F.regexp_replace(bare, r"[:\s]+$", "")))


def _bucket_of(core: Column) -> Column:
    bucket = F.lit(None).cast("string")
    for name, phrases in reversed(L.JOB_HEADINGS):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(core, F.lit(p))
        bucket = F.when(hit, F.lit(name)).otherwise(bucket)
    return F.when(core != "", bucket)


def with_buckets(jobs: DataFrame, text: str = "text") -> DataFrame:
    """Adds required, preferred, responsibilities, other: a posting's lines by the last heading before them."""
    out = jobs.withColumn("__rows", T.lines(F.col(text)))
    # an array a step, so that what a step makes is bound to the next one's variable and not made again at each use
    cores = F.transform(F.transform("__rows", T.strip), _job_core)
    marks = F.filter(F.transform(cores, lambda c, i: F.struct(i.alias("i"), _bucket_of(c).alias("bucket"))), lambda m: m["bucket"].isNotNull())
    out = out.withColumn("__marks", F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("other").alias("bucket"))), marks))
    out = out.withColumn("__ends", F.concat(F.slice(F.transform("__marks", lambda m: m["i"]), 2, 1_000_000), F.array(F.size("__rows"))))
    out = out.withColumn("__cut", F.transform("__marks", lambda m, j: F.struct(
        m["bucket"].alias("bucket"), F.slice("__rows", m["i"] + 2, F.greatest(F.get("__ends", j) - m["i"] - 1, F.lit(0))).alias("lines"))))
    for name in ("required", "preferred", "responsibilities", "other"):
        out = out.withColumn(name, F.array_join(F.flatten(F.transform(F.filter("__cut", lambda p: p["bucket"] == name), lambda p: p["lines"])), "\n"))
    return out.drop("__rows", "__marks", "__ends", "__cut")


def forward_fill(rows: DataFrame, key: str, order: list[str], opens: Column, name: str = "section_no") -> DataFrame:
    """The same idea over a table of rows: numbers the stretches that each opening row starts (0 before the first)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(opens.cast("long")).over(w))
