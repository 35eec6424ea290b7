"""The 32 signals: one struct expression each over a parsed document's row, no shuffle; the long table is an explode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators.jobs import seniority, seniority_rank
from quillspark.operators.sections import section_body


@dataclass(frozen=True)
class SignalKind:
    """Name, weight and the advice given while the score is below 0.95."""

    dimension: str
    label: str
    weight: float
    advice: str


KINDS = {
    "ats.text_layer": SignalKind("ats", "Text is machine-readable", 3.0, "Export the file from its source; scanned or sparse pages read as blank."),
    "ats.file_format": SignalKind("ats", "File format parses reliably", 1.5, "Hand in an unprotected PDF or a DOCX."),
    "ats.layout": SignalKind("ats", "Single-column layout", 2.5, "Use one column; parsers read across columns."),
    "ats.tables": SignalKind("ats", "No tables used for layout", 1.5, "Turn tables into paragraphs and lists."),
    "ats.header_footer": SignalKind("ats", "No content stranded in header/footer", 2.0, "Move what stands in header or footer into the body."),
    "ats.contact": SignalKind("ats", "Contact details are parseable", 3.0, "Write name, e-mail, phone and place as plain text at the top."),
    "ats.headings": SignalKind("ats", "Section headings use standard names", 2.0, "Name sections conventionally, such as Experience or Skills."),
    "ats.dates": SignalKind("ats", "Employment dates are parseable", 2.0, "Give every role a date range such as Mar 2021 - Present."),
    "ats.encoding": SignalKind("ats", "Characters encode cleanly", 1.0, "Export again with a standard font; some characters came out damaged."),
    "ats.bullets": SignalKind("ats", "Achievements use bullet lists", 1.0, "Break paragraphs of experience into bullets."),
    "structure.core_sections": SignalKind("structure", "Core sections present", 3.0, "Add the missing core sections."),
    "structure.length": SignalKind("structure", "Length is appropriate", 2.0, "Aim for 400 to 1000 words."),
    "structure.order": SignalKind("structure", "Sections are ordered sensibly", 1.0, "Put experience before education."),
    "structure.experience_detail": SignalKind("structure", "Roles are described in enough detail", 2.5, "Give every role two bullets or more."),
    "structure.education": SignalKind("structure", "Education is stated", 1.0, "State degree and institution."),
    "structure.summary": SignalKind("structure", "Summary is useful", 1.0, "Open with a summary of two to four lines."),
    "structure.links": SignalKind("structure", "Professional links included", 1.0, "Add a profile or portfolio link."),
    "content.action_verbs": SignalKind("content", "Bullets open with strong verbs", 2.5, "Open bullets with a past-tense verb of achievement."),
    "content.quantification": SignalKind("content", "Achievements are quantified", 3.0, "Attach a number to a third of the bullets or more."),
    "content.bullet_length": SignalKind("content", "Bullets are a readable length", 1.5, "Keep bullets between 10 and 28 words."),
    "content.filler": SignalKind("content", "Free of filler phrasing", 2.0, "Replace duties by outcomes."),
    "content.first_person": SignalKind("content", "Written in resume voice", 1.0, "Leave out first-person pronouns."),
    "content.verb_variety": SignalKind("content", "Verb choice is varied", 1.5, "Vary the opening verbs."),
    "content.buzzwords": SignalKind("content", "Avoids empty buzzwords", 1.0, "Show evidence instead of praise."),
    "content.skills_section": SignalKind("content", "Skills section is scannable", 1.5, "List 10 to 20 skills as short terms."),
    "content.tense": SignalKind("content", "Verb tense is consistent", 1.0, "Use the past tense for finished roles."),
    "match.required_skills": SignalKind("match", "Required skills covered", 5.0, "Show the missing required skills in bullets where you have them."),
    "match.preferred_skills": SignalKind("match", "Preferred skills covered", 1.5, "Add preferred skills that you have."),
    "match.keywords": SignalKind("match", "Posting keywords mirrored", 1.5, "Use the posting's own words for work you have done."),
    "match.similarity": SignalKind("match", "Overall language overlap", 1.0, "Phrase summary and first bullets in the posting's terms."),
    "match.seniority": SignalKind("match", "Seniority aligns", 1.0, "Make your level explicit in titles or summary."),
    "match.experience": SignalKind("match", "Years of experience aligns", 1.0, "Date every role; lead with scope where years are short."),
}


def severity(score: Column) -> Column:
    return F.when(score < 0.34, "critical").when(score < 0.67, "warning").when(score < 0.95, "info").otherwise("ok")


def band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "strong").when(score >= 55, "fair").when(score >= 40, "weak").otherwise("poor")


@dataclass(frozen=True)
class Signal:
    """How one signal is computed from a row; `forced` is a severity that overrides the one of the score where it isn't null."""

    signal_id: str
    score: Column
    forced: Column | None = None
    evidence: Column | None = None


def signal_table(rows: DataFrame, keys: list[str], kinds: list[Signal], evidence: bool = True) -> DataFrame:
    """keys, signal_id, dimension, label, score, weight, severity, evidence, recommendation, points_lost: one row a signal.

    Without `evidence` none is gathered, for those who don't read it: Spark prunes no part of the exploded structs. Scores are columns of a projection of their own, since a struct's fields use each several times.
    """
    none = F.array().cast("array<string>")
    scored = rows.select(*keys, *[x for i, k in enumerate(kinds) for x in (
        T.score4(k.score).alias(f"__s{i}"), (k.forced if k.forced is not None else F.lit(None).cast("string")).alias(f"__f{i}"),
        (k.evidence if evidence and k.evidence is not None else none).alias(f"__e{i}"))])

    def made(i: int, k: Signal) -> Column:
        kind, score = KINDS[k.signal_id], F.col(f"__s{i}")
        return F.struct(
            F.lit(k.signal_id).alias("signal_id"), F.lit(kind.dimension).alias("dimension"), F.lit(kind.label).alias("label"), score.alias("score"), F.lit(kind.weight).alias("weight"),
            F.coalesce(F.col(f"__f{i}"), severity(score)).alias("severity"), F.col(f"__e{i}").alias("evidence"),
            F.when(score < 0.95, F.lit(kind.advice)).otherwise(F.lit("")).alias("recommendation"), ((1 - score) * kind.weight).alias("points_lost"))

    return scored.select(*keys, F.explode_outer(F.array(*[made(i, k) for i, k in enumerate(kinds)])).alias("s")).select(*keys, "s.*")


def evidence_table(rows: DataFrame, keys: list[str], kinds: list[Signal]) -> DataFrame:
    """keys, signal_id, evidence: what signals quote, for those who read nothing else; no score is computed, nor what only scores read."""
    found = [F.struct(F.lit(k.signal_id).alias("signal_id"), k.evidence.alias("evidence")) for k in kinds if k.evidence is not None]
    return rows.select(*keys, F.explode_outer(F.array(*found)).alias("s")).filter("s is not null").select(*keys, "s.*")


def with_measures(documents: DataFrame) -> DataFrame:
    """Adds what several signals read: __words of the text, __low, the clean text in lower case, and of the bullets of three words or more their texts, sizes and opening verbs."""
    out = documents.withColumn("__words", T.word_count(F.col("text"))).withColumn("__low", F.lower("clean"))
    return with_line_measures(out, F.col("bullets"))


def with_line_measures(rows: DataFrame, lines: Column) -> DataFrame:
    """Adds __lines (text, size), those of three words or more, and __verbs, their opening words."""
    sized = rows.withColumn("__lines", F.transform(lines, lambda x: F.struct(x.alias("text"), T.word_count(x).alias("size"))))
    kept = sized.withColumn("__lines", F.filter("__lines", lambda x: x["size"] >= 3))
    return kept.withColumn("__verbs", F.transform("__lines", lambda x: T.lead_verb(x["text"])))


def length_score(words: Column) -> Column:
    return (
        F.when(words.between(400, 1000), F.lit(1.0)).when(words < 250, F.lit(0.2))
        .when(words < 400, F.lit(0.5) + F.lit(0.5) * (words - 250) / 150).when(words <= 1400, F.lit(1.0) - F.lit(0.4) * (words - 1000) / 400).otherwise(F.lit(0.3)))


def encoding_score(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).when(T.junk_count(text) > 5, 0.2).when(T.non_ascii_share(text) > 0.25, 0.6).otherwise(1.0)


def _count(array: Column) -> Column:
    return F.size(array).cast("double")


def share(array: Column, test) -> Column:
    return F.try_divide(_count(F.filter(array, test)), _count(array))


def bullet_length_score(lines: Column) -> Column:
    """Over __lines."""
    return F.when(F.size(lines) < 3, 0.5).otherwise(share(lines, lambda x: x["size"].between(10, 28)))


def verb_variety_score(verbs: Column) -> Column:
    """Over __verbs."""
    found = F.filter(verbs, lambda v: v != "")
    ratio = F.try_divide(_count(F.array_distinct(found)), _count(found))
    return F.when((F.size(verbs) < 5) | (F.size(found) == 0), 0.5).otherwise(F.least(F.lit(1.0), ratio / 0.75))


def overused_verbs(verbs: Column, most: int = 3, least: int = 3) -> Column:
    """Of an array of opening verbs the `most` most frequent ones (verb, n), ties by first place, as far as they open `least` bullets or more."""
    found = F.filter(verbs, lambda v: v != "")
    counts = F.transform(F.array_distinct(found), lambda v: F.struct(
        (-F.size(F.filter(found, lambda x: x == v))).alias("rank"), F.array_position(found, v).alias("first"), v.alias("verb")))
    top = F.filter(F.slice(F.array_sort(counts), 1, most), lambda c: -c["rank"] >= least)
    return F.transform(top, lambda c: F.struct(c["verb"].alias("verb"), (-c["rank"]).alias("n")))


def _some(array: Column, to_text=None, most: int = 4) -> Column:
    """The first elements as evidence."""
    return F.transform(F.slice(array, 1, most), to_text) if to_text else F.slice(array, 1, most)


def _said(test: Column, text: Column | str) -> Column:
    """One line of evidence where the test holds."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))


def ats_signals() -> list[Signal]:
    """Over the measures of a parsed document's columns: text, source_format, page_count, contact, sections, experience, bullets and layout flags."""
    pdf, has = F.col("source_format") == "pdf", lambda c: F.coalesce(F.col(c), F.lit(False))
    dead = F.size(F.filter("pages", lambda p: ~p["has_extractable_text"]))
    density = F.try_divide(F.length("text").cast("double"), F.greatest(F.col("page_count"), F.lit(1)).cast("double"))
    layer = F.when(~pdf, 1.0).when(dead > 0, 1 - dead / F.greatest(F.col("page_count"), F.lit(1))).otherwise(F.least(F.lit(1.0), density / 1200))
    fmt = F.when(pdf & has("is_encrypted"), 0.6).when(F.col("source_format").isin("pdf", "docx"), 1.0).otherwise(0.7)
    tables = F.when(~has("has_tables"), 1.0).when(F.col("table_count") <= 2, 0.5).otherwise(0.2)
    fields = [F.col(f"contact.{c}").isNotNull().cast("double") for c in ("name", "email", "phone", "location")]
    reachable = F.col("contact.email").isNotNull() | F.col("contact.phone").isNotNull()
    contact = F.when(~reachable, 0.0).otherwise(F.greatest(F.lit(0.5), sum(fields, F.lit(0.0)) / 4))
    known, unknown = _count(F.map_keys("sections")), _count(F.col("unknown_headings"))
    headings = F.when(unknown == 0, 1.0).otherwise(F.greatest(F.lit(0.3), known / (known + unknown)))
    dated = F.when(F.size("experience") == 0, 0.4).otherwise(share(F.col("experience"), lambda e: e["dates"]["start_year"].isNotNull()))
    bullets = F.when(F.size("bullets") > 0, 1.0).when(F.col("__words") < 250, 0.5).otherwise(0.3)
    lacking = F.filter(F.array(*[F.when(F.col(f"contact.{c}").isNull(), F.lit(f"No {c} found")) for c in ("name", "email", "phone", "location")]), lambda x: x.isNotNull())
    undated = F.filter("experience", lambda e: e["dates"]["start_year"].isNull())
    return [
        Signal("ats.text_layer", layer, evidence=_said(pdf & (dead > 0), F.concat(dead.cast("string"), F.lit(" page(s) without text")))),
        Signal("ats.file_format", fmt, evidence=_said(fmt < 1, F.concat(F.lit("Format: "), F.col("source_format")))),
        Signal("ats.layout", F.when(has("has_multi_column_hint"), 0.25).otherwise(1.0), evidence=_said(has("has_multi_column_hint"), "Many short lines on a page")),
        Signal("ats.tables", tables, evidence=_said(has("has_tables"), F.concat(F.col("table_count").cast("string"), F.lit(" table(s)")))),
        Signal("ats.header_footer", F.when(has("has_text_in_headers_footers"), 0.3).otherwise(1.0), evidence=_said(has("has_text_in_headers_footers"), "Text in header or footer")),
        Signal("ats.contact", contact, F.when(~reachable, F.lit("critical")), lacking),
        Signal("ats.headings", headings, evidence=F.transform(F.slice("unknown_headings", 1, 5), lambda h: F.concat(F.lit("Unrecognised heading: "), h))),
        Signal("ats.dates", dated, evidence=_some(undated, lambda e: F.concat(F.lit("No dates: "), F.coalesce(e["title"], e["organization"], F.substring(e["raw"], 1, 60))))),
        Signal("ats.encoding", encoding_score(F.col("text"))), Signal("ats.bullets", bullets, evidence=_said(F.size("bullets") == 0, "No bullet lines")),
    ]


def structure_signals() -> list[Signal]:
    missing = F.array_except(T.strings(L.CORE_SECTIONS), F.map_keys("sections"))
    words = F.greatest(F.col("__words"), T.word_count(F.col("clean")))
    start = lambda k: F.element_at("sections", F.lit(k))["start_line"]
    order = F.when((F.col("tenure_months") >= 24) & (start("education") < start("experience")), 0.5).otherwise(1.0)
    none = F.size("experience") == 0
    detail = F.when(none, 0.0).otherwise(1 - share(F.col("experience"), lambda e: F.size(e["bullets"]) < 2))
    education = F.when(F.size("education") > 0, 1.0).when(F.element_at("sections", F.lit("education")).isNotNull(), 0.6).otherwise(0.3)
    summary = T.word_count(section_body("summary"))
    summary_score = F.when(F.element_at("sections", F.lit("summary")).isNull(), 0.5).when(summary > 120, 0.6).when(summary < 15, 0.7).otherwise(1.0)
    links = F.coalesce(F.col("contact.linkedin"), F.col("contact.github"), F.col("contact.website"))
    return [
        Signal("structure.core_sections", (3 - _count(missing)) / 3, evidence=F.transform(F.array_sort(missing), lambda k: F.concat(F.lit("Missing section: "), k))),
        Signal("structure.length", length_score(words), evidence=_said(~words.between(400, 1000), F.concat(words.cast("string"), F.lit(" words")))),
        Signal("structure.order", order, evidence=_said(order < 1, "Education stands before experience")),
        Signal("structure.experience_detail", detail, F.when(none, F.lit("critical")), _some(
            F.filter("experience", lambda e: F.size(e["bullets"]) < 2), lambda e: F.concat(F.coalesce(e["title"], e["organization"], F.lit("A role")), F.lit(": fewer than two bullets")))),
        Signal("structure.education", education), Signal("structure.summary", summary_score, evidence=_said(summary > 0, F.concat(summary.cast("string"), F.lit(" words in the summary")))),
        Signal("structure.links", F.when(links.isNotNull(), 1.0).otherwise(0.4)),
    ]


def content_signals(action_verbs: tuple[str, ...] | None = None) -> list[Signal]:
    b, verbs = F.col("__lines"), F.col("__verbs")
    n = F.size(b)
    few = n < 3
    strong = share(verbs, lambda v: T.is_strong_verb(v, action_verbs))
    weak = share(verbs, lambda v: v.isin(*L.WEAK_OPENERS) | (v == ""))
    action = F.when(few, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), strong + 0.25) - weak * 0.5))
    metric = F.when(few, 0.5).otherwise(F.least(F.lit(1.0), share(b, lambda x: T.has_metric(x["text"])) / 0.4))
    low = F.col("__low")
    filler = sum((T.occurrences(low, p) for p in L.FILLER_PHRASES), F.lit(0))
    others = F.filter(F.map_entries("sections"), lambda e: ~e["key"].isin("summary", "contact"))
    spoken = F.regexp_count(F.array_join(F.transform(others, lambda e: e["value"]["body"]), "\n"), F.lit(r"\b(I|I'm|I've|I'll|me|my|mine|myself)\b"))
    praise = sum((F.contains(low, F.lit(p)).cast("int") for p in L.BUZZWORDS), F.lit(0))
    items = F.filter(F.transform(F.split(section_body("skills"), r"[,|•\n;]+"), T.strip), lambda i: i != "")
    mean = F.try_divide(F.aggregate(F.transform(items, T.word_count), F.lit(0), lambda a, x: a + x).cast("double"), _count(items))
    listed = F.when(F.size(items) == 0, 0.3).when(F.size(items) < 5, 0.5).when(mean > 5, 0.6).when(F.size(items) > 45, 0.6).otherwise(1.0)
    past = F.flatten(F.transform(F.filter("experience", lambda e: e["dates"].isNotNull() & ~e["dates"]["is_current"]), lambda e: e["bullets"]))
    tense = F.when(few | (F.size("experience") == 0) | (F.size(past) == 0), 0.5).otherwise(1 - share(past, lambda x: x.rlike(r"(?i)^\w+ing\b")))
    return [
        Signal("content.action_verbs", action, evidence=F.when(few, F.array().cast("array<string>")).otherwise(_some(
            F.filter(F.arrays_zip(b.alias("b"), verbs.alias("v")), lambda x: x["v"].isin(*L.WEAK_OPENERS) | (x["v"] == "")), lambda x: F.format_string('Weak opener: "%s"', F.substring(x["b"]["text"], 1, 110))))),
        Signal("content.quantification", metric, evidence=_some(F.transform(F.filter(b, lambda x: ~T.has_metric(x["text"])), lambda x: x["text"]))),
        Signal("content.bullet_length", bullet_length_score(b), evidence=_some(F.filter(b, lambda x: ~x["size"].between(10, 28)), lambda x: F.concat(x["size"].cast("string"), F.lit(" words: "), F.substring(x["text"], 1, 80)))),
        Signal("content.filler", 1 - filler / F.greatest(n, F.lit(5)), evidence=_some(F.filter(T.strings(L.FILLER_PHRASES), lambda p: F.contains(low, p)))),
        Signal("content.first_person", 1 - spoken / 8, evidence=_said(spoken > 0, F.concat(spoken.cast("string"), F.lit(" first-person word(s)")))),
        Signal("content.verb_variety", verb_variety_score(verbs), evidence=F.when(F.size(verbs) < 5, F.array().cast("array<string>")).otherwise(
            F.transform(overused_verbs(verbs), lambda v: F.format_string('"%s" opens %d bullets', F.initcap(v["verb"]), v["n"])))),
        Signal("content.buzzwords", 1 - F.lit(0.2) * praise, evidence=_some(F.filter(T.strings(L.BUZZWORDS), lambda p: F.contains(low, p)))),
        Signal("content.skills_section", listed, evidence=_said(F.size(items) > 0, F.concat(F.size(items).cast("string"), F.lit(" items")))), Signal("content.tense", tense),
    ]


def with_own_level(documents: DataFrame) -> DataFrame:
    """Adds own_level: seniority by a document's newest titles, else by its summary."""
    titles = F.array_join(F.filter(F.transform(F.slice("experience", 1, 3), lambda e: e["title"]), lambda t: t.isNotNull()), " ")
    out = documents.withColumn("__titles", F.coalesce(F.nullif(titles, F.lit("")), section_body("summary")))
    return out.withColumn("own_level", seniority(F.col("__titles"))).drop("__titles")


def match_signals() -> list[Signal]:
    """Over a pair's row: n_required, required_share, n_preferred, preferred_hits, n_keywords, n_missing, similarity, levels and years."""
    need = F.when(F.col("n_required") == 0, 0.75).otherwise(F.col("required_share"))
    prefer = F.when(F.col("n_preferred") == 0, 1.0).otherwise(F.col("preferred_hits") / F.col("n_preferred"))
    words = F.when(F.col("n_keywords") == 0, 1.0).otherwise((F.col("n_keywords") - F.col("n_missing")) / F.col("n_keywords"))
    mine = F.col("own_level")
    level = F.when(F.col("seniority") == "unspecified", 1.0).when(mine == "unspecified", 0.7).otherwise(
        1 - F.lit(0.3) * F.abs(seniority_rank(mine) - seniority_rank(F.col("seniority"))))
    actual, least = F.round(F.col("tenure_months") / 12, 1), F.col("years.min_years")
    years = F.when(least.isNull(), 1.0).when(actual <= 0, 0.4).when(actual >= least, 1.0).otherwise(1 - (least - actual) / F.greatest(least, F.lit(1)))
    return [
        Signal("match.required_skills", need, F.when((F.col("n_required") > 0) & (need < 0.5), F.lit("critical")), _some(F.col("missing_required"))),
        Signal("match.preferred_skills", prefer), Signal("match.keywords", words, evidence=_some(F.col("missing_keywords"))), Signal("match.similarity", F.col("similarity") / 0.45),
        Signal("match.seniority", level, evidence=_said(level < 1, F.concat(F.lit("Asked: "), F.col("seniority"), F.lit(", found: "), mine))),
        Signal("match.experience", years, evidence=_said(years < 1, F.concat(actual.cast("string"), F.lit(" of "), least.cast("string"), F.lit(" years")))),
    ]
