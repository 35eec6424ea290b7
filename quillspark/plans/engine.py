"""The whole analysis: parse documents, parse postings, score, match, recommend."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import entities, jobs, matching, pairing, scoring, signals, skills, vectors
from quillspark.operators.sections import section_body, with_sections
from quillspark.sources.tables import materialized, measured_broadcasts, small_batches


@dataclass(frozen=True)
class EngineConfig:
    """Limits and the day that open roles last until (explicit, so that results can be repeated)."""

    as_of: str = "2025-01-01"
    max_bytes: int = 5 * 1024 * 1024
    max_chars: int = 60_000
    max_posting_chars: int = 30_000
    fuzzy: bool = True
    postings_a_document: int = 20
    action_verbs: tuple[str, ...] | None = None


def _layout() -> dict[str, Column]:
    """What a plain-text file says about layout: nothing."""
    no = F.lit(False)
    return {"source_format": F.lit("txt"), "page_count": page_count(F.col("text")), "pages": F.array().cast("array<struct<has_extractable_text:boolean>>"),
            "has_tables": no, "table_count": F.lit(0), "has_multi_column_hint": no, "has_text_in_headers_footers": no, "is_encrypted": no}


def from_text(documents: DataFrame, text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Documents of plain text with the layout columns of a text file; longer texts are cut, with a warning."""
    cut = F.length(text) > config.max_chars
    out = documents.withColumn("warnings", F.when(cut, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("text", F.substring(text, 1, config.max_chars))
    for name, value in _layout().items():
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out


def page_count(text: Column) -> Column:
    """Pages of 500 words, half to even."""
    return F.greatest(F.lit(1), F.bround(T.word_count(text) / 500, 0).cast("int"))


PARTS = ("contact", "experience", "education", "bullets", "tenure")


def parse_documents(documents: DataFrame, config: EngineConfig = EngineConfig(), parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Adds clean, sections, unknown_headings, and of these parts contact, experience, education, bullets, tenure_months (with experience); row by row, no shuffle."""
    as_of = F.lit(config.as_of).cast("date")
    rows = with_sections(small_batches(documents).withColumn("clean", T.clean_text(F.col("text"))), "clean")
    if "contact" in parts:
        rows = entities.with_contact(rows, "clean")
    if "experience" in parts or "tenure" in parts:
        rows = entities.with_experience(rows, section_body("experience"))
    if "education" in parts:
        rows = entities.with_education(rows, section_body("education"))
    if "bullets" in parts:
        every = F.filter(T.lines(F.col("clean")), T.is_bullet)
        rows = rows.withColumn("bullets", F.transform(every, T.strip_bullet))
    if "tenure" not in parts:
        return rows

    def interval(e: Column) -> Column:
        start, end = entities.month_interval(e["dates"], as_of)
        return F.struct(start.alias("start"), end.alias("end"))

    rows = rows.withColumn("__spans", F.transform(F.filter("experience", lambda e: e["dates"]["start_year"].isNotNull()), interval))
    return rows.withColumn("tenure_months", entities.merged_months(F.col("__spans"))).drop("__spans")


class Analysis:
    """Lazy DataFrames of one batch: documents, alone or each paired with postings."""

    def __init__(self, spark: SparkSession, documents: DataFrame, postings: DataFrame | None = None, pairs: DataFrame | None = None,
                 ontology: DataFrame | None = None, config: EngineConfig = EngineConfig()):
        self.spark, self.config = spark, config
        self.ontology = skills.load_ontology(spark) if ontology is None else ontology
        self.forms = skills.surface_forms(self.ontology).cache()
        # every consumer below reads these; written, they are parsed once, and no plan below repeats their long expressions
        self.documents = materialized(parse_documents(measured_broadcasts(documents), config), "documents")
        self.with_job = postings is not None
        if self.with_job:
            self.jobs, self.job_skills = jobs.parse_jobs(postings, self.forms)
            self.jobs, self.job_skills = materialized(self.jobs, "jobs"), materialized(self.job_skills, "job-skills")
            # a stated set of pairs, or each document with the postings that suit its skills best
            self.pairs = pairs if pairs is not None else materialized(
                pairing.best_pairs(self.mentions, self.job_skills, "doc_id", "job_id", config.postings_a_document), "best-pairs")
        self.keys = ["doc_id", "job_id"] if self.with_job else ["doc_id"]

    @cached_property
    def mentions(self) -> DataFrame:
        return materialized(skills.extract_skills(skills.contexts_of(self.documents), self.forms, fuzzy=self.config.fuzzy), "mentions")

    @cached_property
    def similarity(self) -> DataFrame:
        return vectors.cosines(self.vectors, self.pairs.select("doc_id", "job_id"), ["doc_id", "job_id"])

    @cached_property
    def vectors(self) -> DataFrame:
        return vectors.shared_terms(self.documents.select("doc_id", F.col("clean").alias("text")), self.jobs.select("job_id", F.col("clean").alias("text")),
                                  self.pairs.select("doc_id", "job_id"), "doc_id", "job_id")

    @cached_property
    def asked(self) -> DataFrame:
        return matching.asked_and_owned(self.pairs, self.job_skills, self.mentions, "doc_id", "job_id")

    @cached_property
    def gaps(self) -> DataFrame:
        return matching.gaps(self.asked, skills.skill_edges(self.ontology), self.mentions, "doc_id", "job_id")

    @cached_property
    def match_rows(self) -> DataFrame:
        keys = ["doc_id", "job_id"]
        job = self.jobs.select("job_id", "seniority", "years", "keywords")
        doc = signals.with_own_level(self.documents).select("doc_id", "own_level", "tenure_months", matching.stems(F.col("clean")).alias("stems"))
        rows = self.pairs.select(*keys).join(job, "job_id").join(doc, "doc_id").join(matching.coverage(self.asked, keys), keys, "left").join(self.similarity, keys, "left")
        rows = rows.fillna(0, ["n_required", "n_preferred", "preferred_hits"]).withColumn("missing_keywords", matching.missing_keywords(F.col("keywords"), F.col("stems")))
        return rows.withColumn("n_keywords", F.size("keywords")).withColumn("n_missing", F.size("missing_keywords")).drop("stems")

    @cached_property
    def signals(self) -> DataFrame:
        own = [*signals.ats_signals(), *signals.structure_signals(), *signals.content_signals(self.config.action_verbs)]
        alone = signals.signal_table(signals.with_measures(self.documents), ["doc_id"], own)
        if not self.with_job:
            return alone.persist()  # all scores and lists below read it
        matched = self.match_signals
        return alone.join(self.pairs.select("doc_id", "job_id"), "doc_id").select(*matched.columns).unionByName(matched).persist()

    @cached_property
    def match_signals(self) -> DataFrame:
        """The signals of pairs alone."""
        return signals.signal_table(self.match_rows, self.keys, signals.match_signals())

    @cached_property
    def dimensions(self) -> DataFrame:
        return scoring.dimension_scores(self.signals, self.keys)

    @cached_property
    def overall(self) -> DataFrame:
        return scoring.overall_scores(self.dimensions, self.keys, self.with_job)

    @cached_property
    def recommendations(self) -> DataFrame:
        return scoring.recommendations(self.signals, self.keys, self.with_job)

    def close(self) -> None:
        """Gives back what is kept."""
        made = [self.__dict__[x] for x in ("signals",) if x in self.__dict__]
        for kept in (*made, self.forms):
            kept.unpersist()

    def results(self) -> DataFrame:
        """One row a document (and posting): overall, band, dimensions, recommendations, strengths, headline."""
        rec = self.recommendations.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(
            "rank", "signal_id", "severity", "title", "action", "impact", "evidence"))).alias("recommendations"))
        dim = self.dimensions.groupBy(*self.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "score")))).alias("dimensions"))
        out = self.overall.join(dim, self.keys).join(rec, self.keys, "left").join(scoring.strengths(self.signals, self.keys), self.keys)
        return out.join(scoring.headline(self.recommendations, self.keys), self.keys, "left")


    def responses(self, include_signals: bool = False, bullets: int = 6, evidence: int = 2) -> DataFrame:
        """What a reader of single analyses gets: `results` with entries of experience of so many bullets, skills with so much evidence, and signals if asked for."""
        entries = self.documents.select("doc_id", "contact", F.transform("experience", lambda e: e.withField("bullets", F.slice(e["bullets"], 1, bullets))).alias("experience"), "education")
        best = skills.top_skills(self.mentions).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
            "rank", "name", "category", "confidence", "count", F.slice("evidence", 1, evidence).alias("evidence")))).alias("skills"))
        out = self.results().join(entries, "doc_id").join(best, "doc_id", "left")
        if include_signals:
            every = self.signals.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct("dimension", "signal_id", "score", "weight", "severity", "evidence", "recommendation"))).alias("signals"))
            out = out.join(every, self.keys, "left")
        return out

    def publish(self, prefix: str = "") -> list[str]:
        """Temporary views of the analysis for SQL; their names."""
        views = {"documents": self.documents, "skills": self.mentions, "signals": self.signals, "dimensions": self.dimensions, "overall": self.overall, "recommendations": self.recommendations}
        if self.with_job:
            views |= {"jobs": self.jobs, "job_skills": self.job_skills, "gaps": self.gaps}
        for name, rows in views.items():
            rows.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in views]


def fields_match(spark: SparkSession, documents: DataFrame, postings: DataFrame, pairs: DataFrame, wanted: tuple[str, ...], config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, job_id, and of the signals of stated pairs the wanted ones, without evidence: those that skills, titles and years decide.

    Only what they read is parsed (no keywords, no similarity, no other parts of documents), a text once, and what meets are narrow rows: a pair's asked and owned
    skills stand in two arrays, so that no row a skill is dealt out by pair.
    """
    forms = skills.surface_forms(skills.load_ontology(spark))
    doc = signals.with_own_level(parse_documents(measured_broadcasts(documents), config, ("tenure",)))
    doc = materialized(doc.select("doc_id", "own_level", "tenure_months", skills.context_array().alias("contexts")), "documents")
    job = materialized(jobs.job_fields(postings).select("job_id", "seniority", "years", "required", "preferred", "responsibilities", "other"), "jobs")
    mentions = skills.extract_skills(skills.exploded(doc), forms, fuzzy=config.fuzzy, dealt=True)
    owned = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("name", "is_demonstrated")).alias("owned"))
    asked = jobs.job_skills(job, forms, dealt=True).groupBy("job_id").agg(F.collect_list(F.struct("skill", "required", "weight")).alias("asked"))
    rows = pairs.select("doc_id", "job_id").join(job.select("job_id", "seniority", "years"), "job_id").join(asked, "job_id", "left")
    rows = rows.join(doc.select("doc_id", "own_level", "tenure_months"), "doc_id").join(owned, "doc_id", "left")
    rows = matching.with_coverage(rows, F.col("asked"), F.col("owned"))
    return signals.signal_table(rows, ["doc_id", "job_id"], [x for x in signals.match_signals() if x.signal_id in wanted], evidence=False)


def readiness(spark: SparkSession, store: str | None = None) -> dict[str, bool]:
    """Whether the ontology is there (needed) and the history can be read (needed if a store is named)."""
    from quillspark.sources.history import History

    ready = {"ontology": not skills.load_ontology(spark).isEmpty()}
    if store:
        try:
            History(spark, store).rows().limit(1).collect()
            ready["history"] = True
        except Exception:  # the answer is the result
            ready["history"] = False
    return ready
