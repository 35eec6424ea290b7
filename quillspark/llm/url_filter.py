"""URL filters: dated list entries become validity intervals, an as-of join judges each capture.

Everything is DataFrame functions. `validity_intervals` turns add/remove events into half-open
intervals; `filter_captures` looks up the host of a capture and its parent domains, keeps the
intervals that hold at fetch time, and lets the most specific one decide (allow wins a tie).
Each different host is judged once a day on which it was fetched, so a host with a third of all captures
makes as few rows as any; the verdicts, a written table, are joined back on host and day, and Spark
broadcasts it while it is small and splits a skewed host otherwise.

Defined results: a null, empty or hostless URL has no host and is never blocked; host case and
ports are ignored, an IPv6 address in brackets is a host of its own; a null fetch time matches no interval; repeated
events count once; an add while active and a remove while inactive change nothing; events of one day apply add first, then
remove; equally specific entries tie, and allow wins; a URL of any length is read whole; pages with equal page_id are separate
captures; empty tables give no rows, an empty list blocks nothing; other columns are kept, but for those of the result's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import literal_rows, materialized, table


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, most specific first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def validity_intervals(events: DataFrame) -> DataFrame:
    """list, action, domain, valid_from, valid_to (exclusive, null: open) from dated add/remove events."""
    keys = ["list", "action", "domain"]
    e = events.select(*keys, F.col("dated").cast("date").alias("dated"),
                      F.when(F.lower("event") == "add", 0).otherwise(1).alias("off")).distinct()
    w = Window.partitionBy(*keys).orderBy("dated", "off")
    changes = (
        e.withColumn("before", F.lag("off", 1, 1).over(w)).filter(F.col("off") != F.col("before"))
        .withColumn("valid_to", F.lead("dated").over(w))
    )
    return (
        changes.filter((F.col("off") == 0) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("dated"))))
        .select(*keys, F.col("dated").alias("valid_from"), "valid_to")
    )


def judge_hosts(visits: DataFrame, intervals: DataFrame) -> DataFrame:
    """host, fetched_on, n_active, lists, blocked of those (host, fetched_on) that an entry was active for."""
    looked_up = visits.filter(F.col("host").isNotNull() & F.col("fetched_on").isNotNull()).select("host", "fetched_on").distinct().select(
        "host", "fetched_on", F.posexplode(domains_of(F.col("host"))).alias("depth", "domain"))
    active = looked_up.join(intervals.distinct(), "domain").filter(
        (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    first = F.min(F.struct("depth", (F.col("action") != "allow").alias("blocked")))  # the most specific; of those, allow
    return active.groupBy("host", "fetched_on").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), first.alias("first")
    ).select("host", "fetched_on", "n_active", "lists", "first.blocked")


def filter_captures(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """capture columns plus host, n_active, lists, blocked. Needs columns url and fetched_on (date)."""
    mine = [c for c in captures.columns if c not in ("host", "n_active", "lists", "blocked")]
    keyed = captures.select(*mine, url_host(F.col("url")).alias("host"))
    verdicts = materialized(judge_hosts(keyed, intervals), "url-verdicts")
    return keyed.join(verdicts, ["host", "fetched_on"], "left").select(
        *mine, "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


#: Domains of the registered query's long list.
HISTORY = 100_000
#: The dated list of the registered query: list, action, domain, event, day.
LIST_EVENTS = (
    ("gambling", "block", "casino-win.example.net", "add", "2024-02-01"),
    ("gambling", "block", "casino-win.example.net", "remove", "2024-05-01"),
    ("gambling", "block", "casino-win.example.net", "add", "2024-08-15"),
    ("pharma", "block", "cheap-pills.example.net", "add", "2024-01-10"),
    ("pharma", "block", "cheap-pills.example.net", "add", "2024-03-10"),
    ("adult", "block", "adult-x.example.com", "add", "2024-01-01"),
    ("adult", "block", "adult-x.example.com", "remove", "2024-11-01"),
    ("spam", "block", "tionsh.example.net", "add", "2024-06-01"),
    ("spam", "block", "tionsh.example.net", "remove", "2024-07-01"),
    ("spam", "block", "example.org", "add", "2024-09-01"),
    ("spam", "block", "example.org", "remove", "2024-10-01"),
    ("partner", "allow", "ththth.example.org", "add", "2024-09-10"),
    ("partner", "allow", "blog.ththth.example.org", "add", "2024-01-01"),
    ("partner", "allow", "blog.ththth.example.org", "remove", "2024-09-20"),
    ("partner", "allow", "cheap-pills.example.net", "add", "2024-12-01"),
    ("retired", "block", "example.com", "remove", "2024-04-01"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; the query gives page n the day n * 37 mod 366 of 2024. The list is a short one and one of HISTORY domains."""
    day = F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 366) AS INT))")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    events = literal_rows(spark, LIST_EVENTS, "list action domain event dated").withColumn("dated", F.col("dated").cast("date"))
    return filter_captures(captures, validity_intervals(events.unionByName(history(spark)))).drop("url")


def history(spark: SparkSession) -> DataFrame:
    """A long list: HISTORY domains, each put on and taken off once or twice."""
    n = spark.range(HISTORY).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.pmod("id", F.lit(2)) * 2 + 1)).alias("i"))
    day = F.expr("date_add(DATE'2024-01-01', CAST(n % 100 + i * 60 AS INT))")
    return n.select(F.lit("long").alias("list"), F.lit("block").alias("action"), F.concat(F.lit("site"), F.col("n").cast("string"), F.lit(".example.org")).alias("domain"),
                    F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("event"), day.alias("dated"))


OP7_SQL = r"""
WITH events(list, action, domain, event, dated) AS (VALUES
  """ + ",\n  ".join("('%s','%s','%s','%s',DATE '%s')" % row for row in LIST_EVENTS) + rf"""
  UNION ALL SELECT 'long', 'block', 'site' || n || '.example.org', CASE WHEN i % 2 = 0 THEN 'add' ELSE 'remove' END, CAST(DATE '2024-01-01' + CAST(n % 100 + i * 60 AS INTEGER) AS DATE)
    FROM (SELECT n, unnest(range(0, n % 2 * 2 + 2)) AS i FROM range({HISTORY}) t(n))
), numbered AS (
  SELECT *, coalesce(lag(event) OVER w, 'remove') AS before
  FROM (SELECT DISTINCT * FROM events) WINDOW w AS (PARTITION BY list, action, domain ORDER BY dated, event)
), changes AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, action, domain ORDER BY dated, event) AS valid_to
  FROM numbered WHERE event <> before
), spans AS (SELECT * FROM changes WHERE event = 'add' AND (valid_to IS NULL OR valid_to > dated)),
captures AS (
  SELECT row_number() OVER () AS rid, page_id, CAST(DATE '2024-01-01' + CAST(((page_id * 37 % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_on,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:@\[\]]+)', 1), '\.$', ''), '') AS host
  FROM pages
), parents AS (
  SELECT rid, fetched_on, array_to_string(labels[i:], '.') AS domain
  FROM (SELECT rid, fetched_on, labels, unnest(range(1, greatest(len(labels), 2))) AS i FROM (SELECT rid, fetched_on, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL))
), hits AS (
  SELECT c.rid, s.list, s.action, len(s.domain) AS size
  FROM parents c JOIN spans s ON c.domain = s.domain AND s.dated <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to)
), best AS (SELECT rid, max(size) AS size FROM hits GROUP BY rid),
verdicts AS (
  SELECT h.rid, count(*) AS n_active, string_agg(DISTINCT h.list, ',' ORDER BY h.list) AS lists,
    NOT coalesce(bool_or(h.action = 'allow') FILTER (WHERE h.size = b.size), false) AS blocked
  FROM hits h JOIN best b ON h.rid = b.rid GROUP BY h.rid
)
SELECT c.page_id, c.fetched_on, c.host, coalesce(v.n_active, 0) AS n_active, coalesce(v.lists, '') AS lists,
  coalesce(v.blocked, false) AS blocked
FROM captures c LEFT JOIN verdicts v ON c.rid = v.rid
"""
