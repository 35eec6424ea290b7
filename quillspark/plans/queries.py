"""Registered queries: the reference's operations over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import entities, guards, jobs, matching, packed_tfidf, scoring, signals, vectors
from quillspark.operators.sections import forward_fill
from quillspark.sources.history import content_hash, page
from quillspark.sources.tables import spread
from quillspark.streaming import stateful

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job_id"), F.coalesce("text", F.lit("")).alias("text"))


_STOP = "(" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + ")"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents)"
_WS = r"[ \t\n\x0B\f\r]"
#: SQL of words and tokens of a column.
_WORDS = lambda c: rf"list_filter(string_split_regex({c}, '{_WS}+'), lambda x: x <> '')"
_TOKENS = lambda c: rf"list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9+#.\-/]*'), lambda t: regexp_replace(t, '[./\-]+$', '')), lambda t: t <> '')"
_CONTENT = lambda c: f"list_filter({_TOKENS(c)}, lambda t: t NOT IN {_STOP} AND len(t) > 1)"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_TERMS = lambda c: (f"list_concat({c}, list_transform(range(1, len({c})), lambda i: {c}[i] || '_' || {c}[i + 1]))")


# ---------------------------------------------------------------- text

@query(rf"""WITH {_D}, w AS (SELECT doc_id, text, len({_WORDS('text')}) AS n FROM d)
SELECT doc_id, CAST(len(text) AS BIGINT) AS n_chars, CAST(n AS BIGINT) AS n_words,
  CAST(greatest(1, round_even(n / 500.0, 0)) AS BIGINT) AS n_pages, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM w""")
def doc_stats(spark, sf_dir):
    n = T.word_count(F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), n.cast("long").alias("n_words"),
        F.greatest(F.lit(1), F.bround(n / 500, 0)).cast("long").alias("n_pages"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))


@query(rf"""WITH {_D}, c AS (SELECT doc_id, len(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS odd, len(text) AS n FROM d)
SELECT doc_id, CAST(odd AS BIGINT) AS n_non_ascii, CASE WHEN n = 0 THEN 0.0 WHEN odd * 1.0 / n > 0.25 THEN 0.6 ELSE 1.0 END::DOUBLE AS score FROM c""")
def encoding_health(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x7F]")).cast("long").alias("n_non_ascii"),
                                       signals.encoding_score(F.col("text")).cast("double").alias("score"))


@query(rf"""WITH {_D}, t AS (SELECT doc_id, unnest({_TOKENS('text')}) AS token FROM d)
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM t GROUP BY doc_id""")
def token_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.tokenize(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(rf"""WITH {_D}, t AS (SELECT doc_id, unnest({_CONTENT('text')}) AS term FROM d)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term""")
def content_token_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode_outer(T.content_tokens(F.col("text"))).alias("term")).filter("term is not null")
    per_doc = rows.groupBy("doc_id", "term").agg(F.count("*").alias("k"))
    return per_doc.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


_UNITS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: len({_WORDS('x')}) >= 3)"
_LEAD = r"lower(regexp_extract(x, '^[^A-Za-z]*([A-Za-z][0-9A-Za-z_''\-]*)', 1))"


@query(rf"""WITH {_D}, v AS (SELECT doc_id, len(u) AS n_units, list_filter(list_transform(u, lambda x: {_LEAD}), lambda v: v <> '') AS verbs
  FROM (SELECT doc_id, {_UNITS} AS u FROM d))
SELECT doc_id, CAST(n_units AS BIGINT) AS n_units, CAST(len(list_distinct(verbs)) AS BIGINT) AS n_distinct,
  CASE WHEN n_units < 5 OR len(verbs) = 0 THEN 0.5 ELSE round(least(1.0, (len(list_distinct(verbs))::DOUBLE / len(verbs)) / 0.75), 4) END::DOUBLE AS score FROM v""")
def lead_word_variety(spark, sf_dir):
    rows = signals.with_line_measures(_docs(spark, sf_dir), T.filled_lines(F.col("text")))
    verbs = F.filter("__verbs", lambda v: v != "")
    return rows.select("doc_id", F.size("__lines").cast("long").alias("n_units"), F.size(F.array_distinct(verbs)).cast("long").alias("n_distinct"),
                       T.score4(signals.verb_variety_score(F.col("__verbs"))).alias("score"))


@query(rf"""WITH {_D}, l AS (SELECT doc_id, list_sort(list_transform({_UNITS}, lambda x: len({_WORDS('x')}))) AS n FROM d)
SELECT doc_id, CAST(n[len(n) // 2 + 1] AS BIGINT) AS upper_median,
  CASE WHEN len(n) < 3 THEN 0.5 ELSE round(len(list_filter(n, lambda k: k BETWEEN 10 AND 28))::DOUBLE / len(n), 4) END::DOUBLE AS score FROM l""")
def line_length_profile(spark, sf_dir):
    rows = signals.with_line_measures(_docs(spark, sf_dir), T.filled_lines(F.col("text")))
    sizes = F.array_sort(F.transform("__lines", lambda x: x["size"]))
    return rows.select("doc_id", F.get(sizes, F.floor(F.size("__lines") / 2).cast("int")).cast("long").alias("upper_median"),
                       T.score4(signals.bullet_length_score(F.col("__lines"))).alias("score"))


def _doc_signals(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("__words", T.word_count(F.col("text")))
    own = [signals.Signal("ats.encoding", signals.encoding_score(F.col("text"))), signals.Signal("structure.length", signals.length_score(F.col("__words"))),
           signals.Signal("content.bullet_length", signals.bullet_length_score(F.col("__lines"))), signals.Signal("content.verb_variety", signals.verb_variety_score(F.col("__verbs")))]
    return signals.signal_table(signals.with_line_measures(rows, T.filled_lines(F.col("text"))), ["doc_id"], own)


_SEV = lambda s: f"CASE WHEN {s} < 0.34 THEN 0 WHEN {s} < 0.67 THEN 1 WHEN {s} < 0.95 THEN 2 ELSE 3 END"
_BAND = "CASE WHEN overall_score >= 85 THEN 'excellent' WHEN overall_score >= 70 THEN 'strong' WHEN overall_score >= 55 THEN 'fair' WHEN overall_score >= 40 THEN 'weak' ELSE 'poor' END"
_SIGNALS = rf"""{_D}, x AS (SELECT doc_id, len(text) AS n_chars, len({_WORDS('text')}) AS n, len(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS odd, {_UNITS} AS u FROM d),
y AS (SELECT *, list_transform(u, lambda x: len({_WORDS('x')})) AS sizes, list_filter(list_transform(u, lambda x: {_LEAD}), lambda v: v <> '') AS verbs FROM x),
s AS (SELECT doc_id,
  CASE WHEN n_chars = 0 THEN 0.0 WHEN odd::DOUBLE / n_chars > 0.25 THEN 0.6 ELSE 1.0 END::DOUBLE AS enc,
  round(CASE WHEN n BETWEEN 400 AND 1000 THEN 1.0 WHEN n < 250 THEN 0.2 WHEN n < 400 THEN 0.5::DOUBLE + 0.5::DOUBLE * (n - 250) / 150 WHEN n <= 1400 THEN 1.0::DOUBLE - 0.4::DOUBLE * (n - 1000) / 400 ELSE 0.3 END::DOUBLE, 4) AS len,
  CASE WHEN len(u) < 3 THEN 0.5 ELSE round(len(list_filter(sizes, lambda k: k BETWEEN 10 AND 28))::DOUBLE / len(u), 4) END::DOUBLE AS bul,
  CASE WHEN len(u) < 5 OR len(verbs) = 0 THEN 0.5 ELSE round(least(1.0, (len(list_distinct(verbs))::DOUBLE / len(verbs)) / 0.75), 4) END::DOUBLE AS var FROM y)"""


@query(rf"""WITH {_SIGNALS}, dims AS (SELECT *, round(100.0::DOUBLE * (enc * 1.0::DOUBLE) / 1.0::DOUBLE, 1) AS ats_score, round(100.0::DOUBLE * ((len * 2.0::DOUBLE) / 2.0::DOUBLE), 1) AS structure_score,
  round(100.0::DOUBLE * ((bul * 1.5::DOUBLE + var * 1.5::DOUBLE) / 3.0::DOUBLE), 1) AS content_score FROM s),
o AS (SELECT *, round((content_score * 0.40::DOUBLE + ats_score * 0.35::DOUBLE + structure_score * 0.25::DOUBLE) / 1.0::DOUBLE, 1) AS overall_score FROM dims)
SELECT doc_id, ats_score, structure_score, content_score, overall_score, {_BAND} AS band,
  ['critical', 'warning', 'info', 'ok'][least({_SEV('enc')}, {_SEV('len')}, {_SEV('bul')}, {_SEV('var')}) + 1] AS severity FROM o""")
def doc_signals_overall(spark, sf_dir):
    """The flagship: four signals, three dimensions, overall score, band and worst severity of every document."""
    dims = scoring.dimension_scores(_doc_signals(spark, sf_dir), ["doc_id"])
    wide = dims.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(f"{d}_score") for d in ("ats", "structure", "content")],
        F.min_by("severity", scoring.severity_rank(F.col("severity"))).alias("severity"))
    overall = T.round_binary((F.col("content_score") * 0.40 + F.col("ats_score") * 0.35 + F.col("structure_score") * 0.25) / 1.0, 1)
    return wide.withColumn("overall_score", overall).withColumn("band", signals.band(F.col("overall_score")))


@query(rf"""WITH {_SIGNALS}, r AS (
  SELECT doc_id, 'ats.encoding' AS signal_id, enc AS score, 0.35::DOUBLE AS share FROM s UNION ALL SELECT doc_id, 'structure.length', len, 0.25::DOUBLE FROM s
  UNION ALL SELECT doc_id, 'content.bullet_length', bul, 0.20::DOUBLE FROM s UNION ALL SELECT doc_id, 'content.verb_variety', var, 0.20::DOUBLE FROM s),
i AS (SELECT doc_id, signal_id, {_SEV('score')} AS sev, round((1.0::DOUBLE - score) * share * 100.0::DOUBLE, 2) AS impact FROM r WHERE score < 0.95)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sev, impact DESC, signal_id) AS rank, signal_id, ['critical', 'warning', 'info', 'ok'][sev + 1] AS severity, impact FROM i""")
def recommendations_ranked(spark, sf_dir):
    out = scoring.recommendations(_doc_signals(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.col("rank").cast("long").alias("rank"), "signal_id", "severity", "impact")


@query(rf"""WITH {_D}, p(phrase) AS (VALUES ('of the'), ('the of'), ('de la'), ('in the'), ('und der'))
SELECT doc_id, phrase, CAST((len(text) - len(replace(text, phrase, ''))) // len(phrase) AS BIGINT) AS n
FROM (SELECT doc_id, lower(text) AS text FROM d) CROSS JOIN p WHERE contains(text, phrase)""")
def phrase_occurrences(spark, sf_dir):
    """A fixed phrase table against every text, as a literal array: no join."""
    phrases = T.strings(("of the", "the of", "de la", "in the", "und der"))
    rows = _docs(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    hits = F.filter(F.transform(phrases, lambda p: F.struct(p.alias("phrase"), T.occurrences(F.col("text"), p).alias("n"))), lambda h: h["n"] > 0)
    return rows.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.phrase", "h.n")


# ---------------------------------------------------------------- vectors

_BUL = r"^[ \t\n\x0B\f\r]*[•‣▪●◦⁃∙·‐‒–—* \-]+[ \t\n\x0B\f\r]*"
_UNIT15 = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: len(x) >= 15)"
_U15 = f"CASE WHEN len({_UNIT15}) > 0 THEN {_UNIT15} ELSE list_filter([{_STRIP('text')}], lambda x: x <> '') END"


def _terms_sql(name: str, key: str, source: str) -> str:
    """CTEs: NAME_tf (key, term, tf), NAME_df (key, term, df), NAME_n (key, n)."""
    return rf"""{name}_t AS (SELECT {key}, {_CONTENT('text')} AS c FROM {source}),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_TERMS('c')}) AS term FROM {name}_t) GROUP BY ALL),
{name}_u AS (SELECT {key}, {_U15} AS u FROM {source}),
{name}_n AS (SELECT {key}, len(u) AS n FROM {name}_u),
{name}_x AS (SELECT {key}, {_CONTENT('unit')} AS c, row_number() OVER () AS k FROM (SELECT {key}, unnest(u) AS unit FROM {name}_u)),
{name}_df AS (SELECT {key}, term, count(*) AS df FROM (SELECT DISTINCT {key}, k, unnest({_TERMS('c')}) AS term FROM {name}_x) GROUP BY ALL)"""


_W = "(1 + ln(tf)) * coalesce(idf, 1.0::DOUBLE) * CASE WHEN contains(term, '_') THEN 0.6 ELSE 1.0 END::DOUBLE"
_TFIDF = rf"""{_D}, {_terms_sql('a', 'doc_id', 'd')}, total AS (SELECT sum(n) AS n FROM a_n),
g AS (SELECT term, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1 AS idf FROM (SELECT term, sum(df) AS df FROM a_df GROUP BY term), total),
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, a.term, {_W.replace('term', 'a.term')} AS w FROM a_tf a LEFT JOIN g ON a.term = g.term))"""


@query(rf"""WITH {_D}, {_terms_sql('a', 'doc_id', 'd')}, total AS (SELECT sum(n) AS n FROM a_n)
SELECT term, CAST(df AS BIGINT) AS df, round(ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM (SELECT term, sum(df) AS df FROM a_df GROUP BY term), total""")
def idf_terms(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = vectors.document_frequencies(vectors.term_table(docs, "doc_id"), vectors.unit_total(docs))
    return found.select("term", "df", F.round(vectors.idf(F.col("df"), F.col("total")), 6).alias("idf"))


@query(rf"""WITH {_TFIDF}, r AS (SELECT doc_id, term, round(w, 6) AS weight FROM v)
SELECT doc_id, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM r) WHERE rank <= 5""")
def tfidf_topk(spark, sf_dir):
    return packed_tfidf.best_terms(_docs(spark, sf_dir), "doc_id", 5)


@query(rf"""WITH {_TFIDF}, c AS (SELECT lang, term, sum(w) AS w FROM v JOIN d USING (doc_id) GROUP BY ALL),
n AS (SELECT lang, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY lang)), 6) AS weight FROM c)
SELECT lang, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM n) WHERE rank <= 20""")
def lang_centroids(spark, sf_dir):
    return packed_tfidf.best_group_terms(_docs(spark, sf_dir), "doc_id", "lang", 20)


def _pairs(spark, sf_dir):
    """Each document with one posting (its id modulo the number of items): a stated pairs table, no cross join."""
    items = _benchmark(spark, sf_dir)
    n = items.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))  # one row
    rows = _docs(spark, sf_dir).select("doc_id").crossJoin(F.broadcast(n)).select("doc_id", F.pmod("doc_id", F.col("n")).alias("job_id"))
    return rows.join(items.select("job_id"), "job_id", "left_semi").select("doc_id", "job_id")


_PAIR_SQL = "p AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS job_id FROM d WHERE doc_id % (SELECT count(*) FROM benchmark) IN (SELECT item_id FROM benchmark))"


def _pair_side(name: str, own: str, key: str) -> str:
    return rf"""{name} AS (SELECT doc_id, job_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, job_id)) AS w FROM (
  SELECT doc_id, job_id, term, {_W} AS w FROM (SELECT p.doc_id, p.job_id, t.term, t.tf,
    CASE WHEN coalesce(x.df, 0) + coalesce(y.df, 0) > 0 THEN ln((na.n + nb.n + 1.0::DOUBLE) / (coalesce(x.df, 0) + coalesce(y.df, 0) + 1.0::DOUBLE)) + 1 END AS idf
  FROM p JOIN {own}_tf t ON t.{key} = p.{key} JOIN a_n na ON na.doc_id = p.doc_id JOIN b_n nb ON nb.job_id = p.job_id
  LEFT JOIN a_df x ON x.doc_id = p.doc_id AND x.term = t.term LEFT JOIN b_df y ON y.job_id = p.job_id AND y.term = t.term)))"""


_PAIR = rf"""{_D}, b AS (SELECT item_id AS job_id, coalesce(text, '') AS text FROM benchmark), {_PAIR_SQL}, {_terms_sql('a', 'doc_id', 'd')}, {_terms_sql('b', 'job_id', 'b')},
{_pair_side('va', 'a', 'doc_id')}, {_pair_side('vb', 'b', 'job_id')}"""


def _pair_terms(spark, sf_dir, of=vectors.pair_terms):
    return of(_docs(spark, sf_dir), _benchmark(spark, sf_dir), _pairs(spark, sf_dir), "doc_id", "job_id")


@query(rf"""WITH {_PAIR}, s AS (SELECT doc_id, job_id, sum(va.w * vb.w) AS s FROM va JOIN vb USING (doc_id, job_id, term) GROUP BY ALL)
SELECT p.doc_id, p.job_id, round(least(1.0, greatest(0.0, coalesce(s, 0.0))), 6)::DOUBLE AS similarity FROM p LEFT JOIN s USING (doc_id, job_id)""")
def doc_job_cosine(spark, sf_dir):
    return vectors.cosines(_pair_terms(spark, sf_dir, vectors.shared_terms), _pairs(spark, sf_dir), ["doc_id", "job_id"]).select("doc_id", "job_id", F.round("similarity", 6).alias("similarity"))


@query(rf"""WITH {_PAIR}, c AS (SELECT doc_id, job_id, replace(term, '_', ' ') AS term, round(va.w * vb.w, 5) AS contribution FROM va JOIN vb USING (doc_id, job_id, term))
SELECT doc_id, job_id, rank, term, contribution FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, job_id ORDER BY contribution DESC, term) AS rank FROM c) WHERE rank <= 12""")
def overlap_terms(spark, sf_dir):
    return vectors.overlapping_terms(_pair_terms(spark, sf_dir, vectors.shared_terms), ["doc_id", "job_id"]).select("doc_id", "job_id", F.col("rank").cast("long").alias("rank"), "term", "contribution")


@query(rf"""WITH {_PAIR}, m AS (SELECT doc_id, job_id, term, round(w, 6) AS weight FROM vb WHERE NOT contains(term, '_') AND len(term) > 2
  AND NOT EXISTS (SELECT 1 FROM va WHERE va.doc_id = vb.doc_id AND va.job_id = vb.job_id AND va.term = vb.term))
SELECT doc_id, job_id, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, job_id ORDER BY weight DESC, term) AS rank FROM m) WHERE rank <= 15""")
def missing_terms(spark, sf_dir):
    return vectors.missing_terms(_pair_terms(spark, sf_dir, vectors.second_terms), ["doc_id", "job_id"]).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- postings and matching

_BAD = "(" + ", ".join(f"'{w}'" for w in (*L.STOPWORDS, *L.POSTING_BOILERPLATE)) + ")"
_KEY = rf"""b AS (SELECT item_id AS job_id, coalesce(text, '') AS text FROM benchmark),
l AS (SELECT job_id, unnest(string_split(text, chr(10))) AS line FROM b),
c AS (SELECT job_id, line, list_transform(regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]+'), lambda x: lower(x)) AS w FROM l),
g AS (SELECT job_id, lower(unnest(regexp_extract_all(line, '\b[A-Z]{{2,6}}(?:[0-9]{{1,2}})?\b'))) AS phrase, 3.0::DOUBLE AS score, NULL AS parts FROM c
  UNION ALL SELECT job_id, array_to_string(w[i:i + 2], ' '), 2.5, w[i:i + 2] FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM c)
  UNION ALL SELECT job_id, array_to_string(w[i:i + 1], ' '), 2.0, w[i:i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM c)),
k AS (SELECT job_id, phrase, sum(score) AS score FROM g WHERE (parts IS NULL AND phrase NOT IN {_STOP})
  OR (parts IS NOT NULL AND len(list_filter(parts, lambda x: x IN {_BAD} OR len(x) < 3)) = 0) GROUP BY ALL HAVING sum(score) >= 2)"""


@query(f"WITH {_KEY} SELECT job_id, phrase, score FROM k")
def job_keyword_scores(spark, sf_dir):
    rows = _benchmark(spark, sf_dir).select("job_id", "text", F.col("text").alias("required"), F.lit("").alias("responsibilities"))
    return jobs.keyword_scores(rows)


@query(rf"""WITH {_D}, {_PAIR_SQL}, {_KEY}, st AS (SELECT doc_id, list_distinct(list_transform({_CONTENT('text')}, lambda t: t[1:5])) AS stems FROM d),
x AS (SELECT p.doc_id, p.job_id, k.phrase, {_CONTENT('k.phrase')} AS toks, s.stems FROM p JOIN k ON k.job_id = p.job_id JOIN st s ON s.doc_id = p.doc_id)
SELECT doc_id, job_id, count(*) AS n_keywords,
  count(*) FILTER (WHERE len(toks) > 0 AND len(list_filter(toks, lambda t: list_contains(stems, t[1:5])))::DOUBLE / len(toks) < 0.6) AS n_missing FROM x GROUP BY ALL""")
def keyword_coverage(spark, sf_dir):
    rows = _benchmark(spark, sf_dir).select("job_id", "text", F.col("text").alias("required"), F.lit("").alias("responsibilities"))
    words = jobs.keyword_scores(rows).groupBy("job_id").agg(F.collect_list("phrase").alias("keywords"))
    docs = _docs(spark, sf_dir).select("doc_id", matching.stems(F.col("text")).alias("stems"))
    joined = _pairs(spark, sf_dir).join(words, "job_id").join(docs, "doc_id")
    return joined.select("doc_id", "job_id", F.size("keywords").cast("long").alias("n_keywords"), F.size(matching.missing_keywords(F.col("keywords"), F.col("stems"))).cast("long").alias("n_missing"))


#: The driver's texts name no skills, so every content word stands for one; queries over composed résumés scan the ontology.
_ONTO = rf"""tok AS (SELECT doc_id, unnest({_CONTENT('text')}) AS name FROM d)"""


def _mentions(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select("doc_id", F.explode_outer(T.content_tokens(F.col("text"))).alias("name")).filter("name is not null")
    return tokens.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(rf"""WITH {_D}, {_ONTO}, m AS (SELECT doc_id, name, count(*) AS n FROM tok GROUP BY ALL)
SELECT doc_id, name, n, round(least(1.0::DOUBLE, 0.5::DOUBLE + least(0.15::DOUBLE, 0.05::DOUBLE * (n - 1))), 3) AS confidence FROM m""")
def skill_mentions(spark, sf_dir):
    from quillspark.operators.skills import confidence

    return _mentions(spark, sf_dir).select("doc_id", "name", "n", confidence(F.lit(0.5), F.col("n"), F.lit(False)).alias("confidence"))


def _asked(spark, sf_dir):
    tokens = _benchmark(spark, sf_dir).select("job_id", F.explode_outer(T.content_tokens(F.col("text"))).alias("skill")).filter("skill is not null")
    asked = tokens.groupBy("job_id", "skill").agg(F.count("*").alias("mentions"))
    return asked.withColumn("required", F.col("mentions") >= 2).withColumn("category", F.lit("term")).withColumn(
        "weight", F.round(F.least(F.lit(1.0), F.lit(0.7) + F.lit(0.15) * (F.col("mentions") - 1)), 3))


_ASKED = rf"""{_D}, {_PAIR_SQL}, {_ONTO}, m AS (SELECT DISTINCT doc_id, name FROM tok),
q AS (SELECT job_id, skill, count(*) AS mentions FROM (SELECT item_id AS job_id, unnest({_CONTENT("coalesce(text, '')")}) AS skill FROM benchmark) GROUP BY ALL),
j AS (SELECT p.doc_id, p.job_id, q.skill, q.mentions >= 2 AS required, round(least(1.0::DOUBLE, 0.7::DOUBLE + 0.15::DOUBLE * (mentions - 1)), 3) AS weight, m.name IS NOT NULL AS hit
  FROM p JOIN q ON q.job_id = p.job_id LEFT JOIN m ON m.doc_id = p.doc_id AND m.name = q.skill)"""


def _asked_and_owned(spark, sf_dir):
    owned = _mentions(spark, sf_dir).withColumn("is_demonstrated", F.col("n") >= 3)
    return matching.asked_and_owned(_pairs(spark, sf_dir), _asked(spark, sf_dir), owned, "doc_id", "job_id")


@query(rf"""WITH {_ASKED} SELECT doc_id, job_id, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE required AND hit) AS n_hits,
  coalesce(round(count(*) FILTER (WHERE required AND hit)::DOUBLE / nullif(count(*) FILTER (WHERE required), 0), 3), 1.0)::DOUBLE AS coverage FROM j GROUP BY ALL""")
def required_coverage(spark, sf_dir):
    out = matching.coverage(_asked_and_owned(spark, sf_dir), ["doc_id", "job_id"])
    return out.select("doc_id", "job_id", "n_required", F.size("matched_required").cast("long").alias("n_hits"), F.col("required_coverage").alias("coverage"))


@query(rf"""WITH {_ASKED} SELECT doc_id, job_id, skill, CASE WHEN required THEN 'high' ELSE 'low' END AS priority FROM j WHERE NOT hit""")
def skill_gaps(spark, sf_dir):
    edges = spark.createDataFrame([], "name string, related string")
    return matching.gaps(_asked_and_owned(spark, sf_dir), edges, _mentions(spark, sf_dir), "doc_id", "job_id").select("doc_id", "job_id", "skill", "priority")


@query(rf"""WITH {_ASKED}, s AS (SELECT p.doc_id, p.job_id, m.name FROM p JOIN m ON m.doc_id = p.doc_id WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.job_id = p.job_id AND q.skill = m.name))
SELECT doc_id, job_id, array_to_string(list_sort(list(name))[1:20], ',') AS surplus FROM s GROUP BY ALL""")
def surplus_skills(spark, sf_dir):
    out = matching.surplus(_pairs(spark, sf_dir), _asked(spark, sf_dir), _mentions(spark, sf_dir), "doc_id", "job_id")
    return out.select("doc_id", "job_id", F.array_join("surplus_skills", ",").alias("surplus"))


_FORMS = ("thereon", "ertion", "ention", "queelle", "schein", "tionque")


@query(rf"""WITH {_D}, f(form) AS (VALUES {', '.join(f"('{x}')" for x in _FORMS)}), t AS (SELECT DISTINCT unnest({_CONTENT('text')}) AS candidate FROM d)
SELECT candidate, form, CAST(levenshtein(candidate, form) AS BIGINT) AS distance FROM t JOIN f ON candidate[1] = form[1] AND abs(len(candidate) - len(form)) <= 2
WHERE candidate <> form AND len(candidate) BETWEEN 4 AND 25 AND levenshtein(candidate, form) <= 2""")
def fuzzy_candidates(spark, sf_dir):
    """Near forms by first character and length, then edit distance; the ratio form is in operators.skills."""
    forms = spark.createDataFrame([(x,) for x in _FORMS], "form string").withColumn("c0", F.substring("form", 1, 1)).withColumn(
        "len", F.explode(F.sequence(F.length("form") - 2, F.length("form") + 2)))
    words = _docs(spark, sf_dir).select(F.explode_outer(F.array_distinct(T.content_tokens(F.col("text")))).alias("candidate")).distinct().filter(F.length("candidate").between(4, 25))
    pairs = words.withColumn("c0", F.substring("candidate", 1, 1)).withColumn("len", F.length("candidate")).join(forms, ["c0", "len"])
    near = pairs.withColumn("distance", F.levenshtein("candidate", "form").cast("long"))
    return near.filter((F.col("distance") <= 2) & (F.col("candidate") != F.col("form"))).select("candidate", "form", "distance")


# ---------------------------------------------------------------- ordered rows

@query("""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section_no FROM c)
SELECT conv_id, CAST(section_no AS BIGINT) AS section_no, count(*) AS n_turns, CAST(min(turn) AS BIGINT) AS first_turn, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM s GROUP BY conv_id, section_no""")
def conversation_sections(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cut = forward_fill(rows, "conv_id", ["turn"], F.col("role") == "user")
    return cut.groupBy("conv_id", "section_no").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH i AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + (o_orderkey % 4) AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS months FROM (SELECT o_custkey, max(e) - min(s) + 1 AS n FROM g GROUP BY o_custkey, island) GROUP BY o_custkey""")
def tenure_months(spark, sf_dir):
    first = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = _table(spark, sf_dir, "orders").select("o_custkey", first.alias("s"), (first + F.col("o_orderkey") % 4).alias("e"))
    return entities.tenure_months(rows, "o_custkey", "s", "e")


# ---------------------------------------------------------------- guards

@query(rf"""WITH {_D} SELECT doc_id, unnest(regexp_extract_all(text, '{L.EMAIL}')) AS email FROM d""")
def pii_emails(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({L.EMAIL})"), F.lit(1))).alias("email"))


_BLANKS = lambda p: p.replace(r"\S", r"[^ \t\n\x0B\f\r]").replace(r"[\s.", r"[ \t\n\x0B\f\r.").replace(r"\s", r"[ \t\n\x0B\f\r]")
_MASKED = "text"
for _pattern, _mark in ((L.EMAIL, "[EMAIL]"), (L.LINK, "[LINK]"), (L.STREET, "[ADDRESS]"), (L.PHONE, "[PHONE]")):
    _MASKED = f"regexp_replace({_MASKED}, '{_BLANKS(_pattern)}', '{_mark}', 'g')"


@query(f"""WITH {_D} SELECT doc_id, sha256({_MASKED}) AS redacted_sha256 FROM d""")
def redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(guards.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("""SELECT page_id, CAST(len(html) AS BIGINT) AS n_chars, CAST(len(html) - len(replace(replace(html, '<', ''), '>', '')) AS BIGINT) AS n_brackets,
  sha256(translate(html, '<>', '‹›')) AS safe_sha256 FROM pages WHERE html IS NOT NULL""")
def sanitise_html(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").filter("html is not null")
    return rows.select("page_id", F.length("html").cast("long").alias("n_chars"), F.regexp_count("html", F.lit("[<>]")).cast("long").alias("n_brackets"),
                       F.sha2(guards.sanitise(F.col("html")), 256).alias("safe_sha256"))


_RE2 = lambda p: p.replace("'", "''").replace(r"\s", r"[ \t\n\x0B\f\r]")


@query(f"""WITH h AS (SELECT page_id, list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN regexp_matches(html, '(?im){_RE2(p)}') THEN '{k}' END" for k, p in L.INJECTION_PATTERNS)}], lambda x: x IS NOT NULL))) AS kinds
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)) SELECT page_id, array_to_string(kinds, ',') AS kinds FROM h""")
def injection_scan(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(guards.injection_kinds(F.coalesce("html", F.lit(""))), ",").alias("kinds"))


_NUM = r"regexp_extract_all({}, '(?i)[0-9][0-9,.]*[ \t\n\x0B\f\r]*(?:%|k\b|m\b|bn\b|x\b)?')"
_CAN = r"regexp_replace(lower(regexp_replace(x, '[ \t\n\x0B\f\r,]', '', 'g')), '\.+$', '')"


@query(rf"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') || ' ' || CAST(conv_id * 37 + turn * 11 AS VARCHAR) || ' 12' AS text FROM conversations),
s AS (SELECT conv_id, list_distinct(list_transform(flatten(list({_NUM.format('text')})), lambda x: {_CAN})) AS known FROM r WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, turn, unnest({_NUM.format('text')}) AS x FROM r WHERE role = 'assistant'),
c AS (SELECT DISTINCT a.conv_id, turn, {_STRIP('x')} AS raw FROM a LEFT JOIN s ON s.conv_id = a.conv_id WHERE NOT coalesce(list_contains(known, {_CAN}), false)
  AND len(regexp_replace({_CAN}, '[^0-9]', '', 'g')) > 1 AND NOT regexp_full_match(regexp_replace({_CAN}, '[^0-9]', '', 'g'), '(?:19|20)[0-9][0-9]'))
SELECT conv_id, CAST(turn AS BIGINT) AS turn, string_agg(raw, ',' ORDER BY raw) AS fabricated FROM c GROUP BY conv_id, turn""")
def fabricated_numbers(spark, sf_dir):
    """Numbers of assistant turns that no user turn of the conversation has; a made-up number ends each text, as the tables hold few."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(
        F.coalesce("text", F.lit("")), F.lit(" "), (F.col("conv_id") * 37 + F.col("turn") * 11).cast("string"), F.lit(" 12")).alias("text"))
    said = rows.filter("role = 'user'").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ; ").alias("said"))
    claimed = rows.filter("role = 'assistant'").join(said, "conv_id", "left")
    found = claimed.select("conv_id", "turn", guards.fabricated_numbers(F.col("text"), F.coalesce("said", F.lit(""))).alias("f"))
    return found.filter(F.size("f") > 0).select("conv_id", "turn", F.array_join("f", ",").alias("fabricated"))


# ---------------------------------------------------------------- history and metrics

@query(rf"""WITH {_D} SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM d GROUP BY 1 HAVING count(*) > 1""")
def content_dupes(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def history_page(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return page(rows, "o_orderdate", "o_orderkey", 25, 50).select("o_orderkey", "o_custkey", "o_totalprice", F.lit(rows.count()).cast("long").alias("total"))


@query(f"""WITH b(le, bound) AS (VALUES {', '.join(f"('{x}', {x}::DOUBLE)" for x in L.HISTOGRAM_BOUNDS)}, ('+Inf', 'infinity'::DOUBLE))
SELECT event_type, le, count(*) FILTER (WHERE value <= bound) AS n, count(*) AS n_all FROM events CROSS JOIN b GROUP BY ALL""")
def latency_histogram(spark, sf_dir):
    return stateful.histogram(_table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "le", "n", "n_all")


@query("""SELECT event_type AS name, json_extract_string(props, '$.k') AS k, count(*) AS value FROM events GROUP BY ALL""")
def counter_by_label(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    out = stateful.counters(rows, F.col("event_type"), F.create_map(F.lit("k"), F.col("k")))
    return out.select("name", F.get_json_object("labels", "$.k").alias("k"), "value")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_attempts FROM events""")
def attempted_hits_window(spark, sf_dir):
    return stateful.attempted_hits(_table(spark, sf_dir, "events"), "user_id", 86_400).select("event_id", "user_id", "n_attempts")


_EVENTS = "e AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (
  SELECT user_id, i, event_id, ts, [sec] AS times, true AS allowed, 0 AS retry FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, ts, CASE WHEN len(kept) < 5 THEN list_append(kept, sec) ELSE kept END, len(kept) < 5, CASE WHEN len(kept) < 5 THEN 0 ELSE greatest(1, trunc(kept[1] + 86400.0 - sec)::INT) END
  FROM (SELECT e.*, list_filter(r.times, lambda t: t >= e.sec - 86400.0) AS kept FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1))
SELECT event_id, user_id AS key, ts, allowed, retry AS retry_after_s FROM r""")
def rate_limited_events(spark, sf_dir):
    """Limit 5 a day for each user."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return stateful.rate_limited(rows, 5, 86_400.0)


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, false AS blocked, 0 AS failures, NULL::DOUBLE AS opened FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, event_id, ts, blocked, CASE WHEN blocked THEN failures WHEN ok THEN 0 ELSE failures + 1 END,
    CASE WHEN blocked THEN opened WHEN ok THEN NULL WHEN failures + 1 >= 2 THEN sec ELSE opened END
  FROM (SELECT user_id, i, event_id, ts, sec, ok, was AND NOT cooled AS blocked, CASE WHEN was AND cooled THEN 1 ELSE failures END AS failures, CASE WHEN was AND cooled THEN NULL ELSE opened END AS opened
    FROM (SELECT e.*, e.event_id % 2 = 0 AS ok, r.failures, r.opened, r.opened IS NOT NULL AS was, coalesce(e.sec - r.opened >= 3600.0, false) AS cooled FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1)))
SELECT event_id, user_id AS key, ts, blocked, failures FROM r WHERE i > 0""")
def breaker_trace(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("event_id") % 2 == 0).alias("ok"))
    return stateful.breaker_trace(rows, 2, 3_600.0)


@query("""WITH e AS (SELECT user_id, event_id, ts, value >= 0.5 AS ok FROM events),
r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM e)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS length FROM r WHERE NOT ok GROUP BY ALL""")
def failure_runs(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") >= 0.5).alias("ok"))
    return stateful.failure_runs(rows, "user_id")


@query("""SELECT r_name, l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_price, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def weighted_mean_star(spark, sf_dir):
    """A weighted mean over a star join; only the small dimensions are broadcast, by Spark's own size check."""
    t = lambda name: _table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    rows = t("lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name", "l_returnflag").agg(
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted_price"), F.count("*").alias("n"))
