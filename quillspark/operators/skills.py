"""Skill ontology and mentions: surface forms found exactly, longest claims first, rolled up by skill."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import surface
from quillspark.functions import text as T
from quillspark.sources.tables import small_batches

ONTOLOGY = str(Path(__file__).parent.parent / "sources" / "ontology.json")


def load_ontology(spark: SparkSession, path: str | None = None) -> DataFrame:
    """name, category, aliases, related, declared_order. A missing or invalid file is an empty ontology."""
    schema = "skills array<struct<name:string,category:string,aliases:array<string>,related:array<string>>>"
    import json

    try:
        found = json.loads(Path(path or ONTOLOGY).read_text()).get("skills", [])
    except (OSError, json.JSONDecodeError):
        found = []
    rows = [(s["name"], s.get("category", "other"), s.get("aliases", []), s.get("related", []), i) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "name string, category string, aliases array<string>, related array<string>, declared_order int")


def surface_forms(ontology: DataFrame) -> DataFrame:
    """surface_key, name, category, position: the first skill that declares a form keeps it; position: declared order."""
    forms = ontology.select("name", "category", "declared_order", F.posexplode(F.concat(F.array("name"), "aliases")).alias("k", "form"))
    forms = forms.withColumn("surface_key", T.normalise_surface(F.col("form"))).filter("surface_key <> ''")
    place = F.struct("declared_order", "k")
    return forms.groupBy("surface_key").agg(F.min_by("name", place).alias("name"), F.min_by("category", place).alias("category"), F.min(place).alias("position"))


def skill_edges(ontology: DataFrame) -> DataFrame:
    return ontology.select("name", F.explode("related").alias("related"))


def context_array(raw: str = "clean") -> Column:
    """(context, text) of a sectioned document: section bodies by context; what no such section holds is "other"."""
    named = F.array(*[F.struct(F.lit(label).alias("context"), F.element_at("sections", F.lit(kind))["body"].alias("text")) for kind, label in L.SECTION_CONTEXTS.items()])
    bodies = F.filter(F.transform(named, lambda c: c["text"]), lambda b: b.isNotNull())
    left = F.aggregate(bodies, F.col(raw), lambda t, b: F.replace(t, b, F.lit(" ")))
    every = F.concat(named, F.array(F.struct(F.lit("other").alias("context"), left.alias("text"))))
    return F.filter(every, lambda c: F.coalesce(c["text"].rlike(r"\S"), F.lit(False)))


def contexts_of(sectioned: DataFrame, key: str = "doc_id", raw: str = "clean") -> DataFrame:
    """key, context, text: a row for each of `context_array`."""
    return exploded(sectioned.select(key, context_array(raw).alias("contexts")), key)


def exploded(contexts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, context, text of arrays of contexts."""
    return contexts.select(key, F.explode_outer("contexts").alias("c")).filter("c is not null").select(key, "c.context", "c.text")


def declared(forms: DataFrame) -> list[tuple[str, str, str]]:
    """The forms' rows in declared order: a dictionary (`surface.MOST_FORMS` at most, else an error), which every task gets."""
    rows = forms.select("surface_key", "name", "category", "position").limit(surface.MOST_FORMS + 1).collect()
    return [(r.surface_key, r.name, r.category) for r in sorted(rows, key=lambda r: tuple(r.position))]


def scan(contexts: DataFrame, forms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, context, name, category, n, snippets: forms found in each text; no character counts for two forms. No shuffle."""
    find = surface.scanner(declared(forms))
    return small_batches(contexts).select(key, "context", F.explode(find("text")).alias("c")).select(key, "context", "c.*")


def roll_up(found: DataFrame, key: str = "doc_id", fuzzy: Column | None = None) -> DataFrame:
    """key, name, category, count, contexts, evidence, fuzzy, confidence, is_demonstrated: one row a skill. A typo doesn't count beside an exact mention."""
    order = F.create_map(*[x for i, c in enumerate(L.CONTEXT_WEIGHTS) for x in (F.lit(c), F.lit(i))])
    weight = F.create_map(*[x for c, w in L.CONTEXT_WEIGHTS.items() for x in (F.lit(c), F.lit(w))])
    row = F.struct(F.coalesce(order[F.col("context")], F.lit(9)).alias("o"), "context", "n", "snippets", (fuzzy if fuzzy is not None else F.lit(False)).alias("fuzzy"),
                   F.coalesce(weight[F.col("context")], F.lit(0.5)).alias("w"))
    rows = found.groupBy(key, "name", "category").agg(F.array_sort(F.collect_list(row)).alias("all"))  # a row a context
    exact = F.filter("all", lambda m: ~m["fuzzy"])
    rows = rows.withColumn("m", F.when(F.size(exact) > 0, exact).otherwise(F.slice("all", 1, 1)))
    out = rows.select(
        key, "name", "category", F.aggregate("m", F.lit(0).cast("long"), lambda acc, m: acc + m["n"]).alias("count"),
        F.array_sort(F.array_distinct(F.transform("m", lambda m: m["context"]))).alias("contexts"),
        F.slice(F.array_distinct(F.flatten(F.transform("m", lambda m: m["snippets"]))), 1, 3).alias("evidence"),
        F.col("m")[0]["fuzzy"].alias("fuzzy"), F.array_max(F.transform("m", lambda m: m["w"])).alias("w"),
        F.exists("m", lambda m: ~m["context"].isin("skills", "other")).alias("is_demonstrated"))
    return out.withColumn("confidence", confidence(F.col("w"), F.col("count"), F.col("fuzzy"))).drop("w")


def confidence(weight: Column, count: Column, fuzzy: Column) -> Column:
    sure = F.least(F.lit(1.0), weight + F.least(F.lit(0.15), F.lit(0.05) * (count - 1)))
    return F.round(sure * F.when(fuzzy, F.lit(0.85)).otherwise(F.lit(1.0)), 3)


def typo_candidates(contexts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, context, candidate: single words of 4 to 25 characters listed under skills or summary."""
    parts = F.transform(F.split("text", r"[,|•\n;/]"), T.normalise_surface)
    ok = F.filter(parts, lambda p: F.length(p).between(4, 25) & ~F.contains(p, F.lit(" ")))
    return contexts.filter(F.col("context").isin("skills", "summary")).select(key, "context", F.explode_outer(F.array_distinct(ok)).alias("candidate")).filter("candidate is not null")


def recover_typos(candidates: DataFrame, forms: DataFrame, key: str = "doc_id", least: float = 0.88) -> DataFrame:
    """Candidates that are no form but close to one: joined on the first character and three lengths, then compared."""
    from quillspark.functions.udfs import ratcliff

    fresh = small_batches(candidates).join(forms, F.col("candidate") == F.col("surface_key"), "left_anti")
    keyed = forms.select("surface_key", "name", "category", F.substring("surface_key", 1, 1).alias("c0"),
                         F.explode(F.sequence(F.length("surface_key") - 2, F.length("surface_key") + 2)).alias("len"))
    pairs = fresh.withColumn("c0", F.substring("candidate", 1, 1)).withColumn("len", F.length("candidate")).join(keyed, ["c0", "len"])
    near = pairs.withColumn("ratio", ratcliff("candidate", "surface_key")).filter(F.col("ratio") >= least)
    best = near.groupBy(key, "candidate").agg(F.max(F.struct("ratio", "surface_key", "name", "category")).alias("b")).select(key, "candidate", "b.name", "b.category")
    return best.groupBy(key, "name", "category").agg(
        F.lit(1).cast("long").alias("n"), F.array(F.format_string('Matched from "%s" (possible misspelling)', F.min("candidate"))).alias("snippets"), F.lit("skills").alias("context"))


def extract_skills(contexts: DataFrame, forms: DataFrame, key: str = "doc_id", fuzzy: bool = True, dealt: bool = False) -> DataFrame:
    """Mentions of all skills, typos included; dealt: by the key alone, for those who group or join them by it."""
    exact = scan(contexts, forms, key)
    if not fuzzy:
        return roll_up(exact.repartition(key) if dealt else exact, key)
    typos = recover_typos(typo_candidates(contexts, key), forms, key)
    every = exact.withColumn("f", F.lit(False)).unionByName(typos.withColumn("f", F.lit(True)))
    return roll_up(every.repartition(key) if dealt else every, key, F.col("f"))


def top_skills(mentions: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("count"), "name")
    return mentions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def category_counts(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """category, n (mentioned skills), n_documents."""
    return mentions.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_documents"))
