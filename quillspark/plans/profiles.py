"""Résumés and postings written by a rule from the customer and part tables.

The tables hold no résumés. These are composed from fields that are arithmetic on the key, in SQL
that Spark and DuckDB both read, so that a query's SQL can state what parsing has to find without
parsing anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import measured_broadcasts, spread

FIRST = ("Mira", "Jonas", "Aiko", "Pedro", "Lena", "Omar", "Ruth")
LAST = ("Solano", "Berger", "Tanaka", "Silva", "Novak", "Haddad")
PLACES = ("Lisbon, Portugal", "Austin, TX", "Oslo, Norway")
TITLES = ("Software Engineer", "Data Analyst", "Product Manager", "Research Scientist")
ORGS = ("Harbor Systems", "Pine Labs", "Delta Holdings", "North Bank", "Orchid Group")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SKILLS = ("Python", "Go", "SQL", "Kubernetes", "Docker", "Airflow", "Terraform", "Kafka", "Rust", "Redis")
VERBS = ("Rebuilt", "Automated", "Designed", "Managing", "Helped")
FIELDS = ("Computer Science", "Applied Mathematics", "Economics")
SCHOOLS = ("University of Porto", "Oslo Institute", "Austin College")
GRADES = (("GPA: 3.5/4.0", 3.5), ("CGPA: 8.0/10", 3.2), ("GPA: 3.9", 3.9))
POSTS = (("Senior Platform Engineer", "senior"), ("Data Analyst", "unspecified"), ("Staff Backend Engineer", "staff"), ("Junior Developer", "junior"))


def pick(values, index: str) -> str:
    """SQL: the value at an index from 0."""
    found = f"split_part('{'|'.join(map(str, values))}', '|', CAST(1 + {index} AS INT))"
    return found if isinstance(values[0], str) else f"CAST({found} AS DOUBLE)"


def when(test: str, value: str) -> str:
    return f"(CASE WHEN {test} THEN {value} END)"


def _lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


def fixed(rows: DataFrame) -> DataFrame:
    """The rows as a generator's output: what is made by long expressions is made once, and no filter copies them."""
    return measured_broadcasts(rows).select(F.explode_outer(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


# ---------------------------------------------------------------- résumés, over k

FIRST_NAME, LAST_NAME = pick(FIRST, "k % 7"), pick(LAST, "k % 6")
NAME = f"concat({FIRST_NAME}, ' ', {LAST_NAME})"
SLUG = f"concat(lower({FIRST_NAME}), lower({LAST_NAME}), CAST(k % 9973 AS STRING))"
EMAIL = f"concat(lower({FIRST_NAME}), '.', lower({LAST_NAME}), CAST(k % 9973 AS STRING), '@example.com')"
PHONE = when("k % 3 <> 0", "concat('+1 415-555-', lpad(CAST(k % 10000 AS STRING), 4, '0'))")
PLACE = pick(PLACES, "k % 3")
LINKEDIN = when("k % 2 = 0", f"concat('linkedin.com/in/', {SLUG})")
GITHUB = when("k % 5 = 0", f"concat('github.com/', {SLUG})")

SUMMARY_SKILL, HAS_SUMMARY = pick(SKILLS, "k % 10"), "k % 4 <> 3"
SUMMARY = "concat(" + ", ".join((
    f"(CASE WHEN k % 8 = 1 THEN concat('Builds systems in ', {SUMMARY_SKILL}, '.') ELSE "
    f"concat('Builder of payment systems in ', {SUMMARY_SKILL}, ' who writes services that other people at the firm run every single day.') END)",
    "(CASE WHEN k % 5 = 2 THEN ' A team player.' ELSE '' END)", "(CASE WHEN k % 7 = 3 THEN ' A dynamic one.' ELSE '' END)")) + ")"

ROLES = "(CASE WHEN k % 10 = 9 THEN 0 ELSE 1 + k % 3 END)"


def role(j: int) -> dict[str, str]:
    """Fields of the j-th role."""
    sm, em = f"(1 + (k * 7 + {j}) % 12)", f"(1 + (k * 5 + {j}) % 12)"
    current = "(k % 2 = 0)" if j == 0 else "(1 = 0)"
    sy = f"({2018 - 3 * j} + k % 2)"
    ey = f"({sy} + 2)"
    month = lambda m: pick(MONTHS, f"{m} - 1")
    title = f"concat((CASE WHEN (k + {j}) % 3 = 0 THEN 'Senior ' ELSE '' END), {pick(TITLES, f'(k + {j}) % 4')})"
    org = pick(ORGS, f"(k + {2 * j}) % 5")
    dates = f"concat({month(sm)}, ' ', CAST({sy} AS STRING), ' - ', (CASE WHEN {current} THEN 'Present' ELSE concat({month(em)}, ' ', CAST({ey} AS STRING)) END))"
    return {"exists": f"({ROLES} > {j})", "title": title, "organization": org, "start_year": sy, "start_month": sm, "end_year": when(f"NOT {current}", ey),
            "end_month": when(f"NOT {current}", em), "is_current": current, "bullets": f"(1 + (k + {j}) % 3)", "line": f"concat({title}, ' | ', {org}, ' | ', {dates})"}


def bullet(j: int, b: int) -> dict[str, str]:
    """Fields of the b-th bullet of the j-th role."""
    verb, skill, rich = pick(VERBS, f"(k + {j + b}) % 5"), pick(SKILLS, f"(k + {2 * j + b}) % 10"), f"((k + {b}) % 2 = 0)"
    long = f"concat({verb}, ' the ledger service with ', {skill}, ' and cut the settlement time by ', CAST(10 + (k + {3 * j + b}) % 80 AS STRING), '% for every team')"
    short = f"concat({verb}, ' the nightly batch jobs', (CASE WHEN k % 6 = 1 THEN ' for my team' ELSE '' END))"
    return {"exists": f"({ROLES} > {j} AND (k + {j}) % 3 >= {b})", "verb": verb, "skill": skill, "rich": rich, "text": f"(CASE WHEN {rich} THEN {long} ELSE {short} END)"}


ROLE_NOS, BULLET_NOS = range(3), range(3)


def _role_lines(j: int) -> list[str]:
    gap = [when(f"{ROLES} > {j}", "''")] if j else []
    return [*gap, when(role(j)["exists"], role(j)["line"]), *[when(bullet(j, b)["exists"], f"concat('- ', {bullet(j, b)['text']})") for b in BULLET_NOS]]


EXPERIENCE, HAS_EXPERIENCE = _lines(*[x for j in ROLE_NOS for x in _role_lines(j)]), "k % 10 <> 9"
FIELD, SCHOOL, GRADUATED = pick(FIELDS, "k % 3"), pick(SCHOOLS, "(k + 1) % 3"), "(2008 + k % 8)"
GRADE, GRADE_OF_FOUR = pick([g for g, _ in GRADES], "k % 3"), pick([v for _, v in GRADES], "k % 3")
EDUCATION, HAS_EDUCATION = _lines(f"concat('B.Sc in ', {FIELD}, ', ', {SCHOOL}, ', ', CAST({GRADUATED} AS STRING))", GRADE), "k % 6 <> 5"
LISTED = "(3 + k % 4)"


def listed(i: int) -> str:
    return pick(SKILLS, f"(k + {3 * i}) % 10")


TYPO = "(k % 4 = 1)"
SKILL_LIST, HAS_SKILLS = "concat_ws(', ', " + ", ".join([*[when(f"{LISTED} > {i}", listed(i)) for i in range(6)], when(TYPO, "'Kubernets'")]) + ")", "k % 11 <> 10"
NOTES, HAS_NOTES = "'plants and soil'", "k % 9 = 0"
INTERESTS, HAS_INTERESTS = "trim(repeat('gardening with friends ', 100))", "k % 13 = 0"
EARLY_EDUCATION = "(k % 8 = 7)"
#: Kinds of sections with their headings and bodies and whether a résumé has them, in the order in which they stand.
SECTIONS = {
    "contact": ("(header)", _lines(NAME, f"concat_ws(' | ', {PLACE}, {EMAIL}, {PHONE})", LINKEDIN, GITHUB), "1 = 1"),
    "summary": ("SUMMARY", SUMMARY, HAS_SUMMARY), "experience": ("EXPERIENCE", EXPERIENCE, HAS_EXPERIENCE), "education": ("EDUCATION", EDUCATION, HAS_EDUCATION),
    "skills": ("SKILLS", SKILL_LIST, HAS_SKILLS), "interests": ("INTERESTS", INTERESTS, HAS_INTERESTS), "other": ("Garden Notes", NOTES, HAS_NOTES),
}


def _section(kind: str, test: str = "1 = 1") -> str:
    heading, body, exists = SECTIONS[kind]
    return when(f"{exists} AND {test}", _lines("''", f"'{heading}'", body))


def resume(header: str = SECTIONS["contact"][1]) -> str:
    return _lines(header, _section("summary"), _section("education", EARLY_EDUCATION), _section("experience"),
                  _section("education", f"NOT {EARLY_EDUCATION}"), _section("skills"), _section("interests"), _section("other"))


RESUME = resume()


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a résumé a customer."""
    k = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")))
    return fixed(k.select(F.col("k").alias("doc_id"), F.expr(RESUME).alias("text")))


#: Lists as people write them, and the skills in them.
LIST_SEGMENTS = (
    ("Python/Go", (("Python", 1), ("Go", 1))), ("react  native, React", (("React Native", 1), ("React", 1))), ("my_python_x", ()),
    ("C++/C#", (("C++", 1), ("C#", 1))), ("node.js/TypeScript", (("Node.js", 1), ("TypeScript", 1))), ("CI/CD & Docker/Kubernetes", (("CI/CD", 1), ("Docker", 1), ("Kubernetes", 1))),
    ("Docker (docker)", (("Docker", 2),)), ("asp.net core", (("ASP.NET", 1),)), ("scikit-learn;pythonic", (("scikit-learn", 1),)),
)


def list_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a name, two lists of skills, and one of interests."""
    k = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")))
    lists = [pick([x for x, _ in LIST_SEGMENTS], f"(k + {4 * i}) % {len(LIST_SEGMENTS)}") for i in range(3)]
    text = _lines(NAME, "''", "'SKILLS'", f"concat({lists[0]}, ', ', {lists[1]})", "''", "'INTERESTS'", lists[2])
    return fixed(k.select(F.col("k").alias("doc_id"), F.expr(text).alias("text")))


# ---------------------------------------------------------------- postings, over j

POST, POST_LEVEL = pick([t for t, _ in POSTS], "j % 4"), pick([x for _, x in POSTS], "j % 4")
YEARS = "(2 + j % 7)"
#: What a posting asks for: skill, whether required, the bucket that names it.
ASKED = tuple((pick(SKILLS, f"(j + {at}) % 10"), required, bucket) for at, required, bucket in (
    (0, "true", "required"), (3, "true", "required"), (5, "false", "preferred"), (7, "true", "responsibilities")))
DUTIES = (f"concat('Run the ', {ASKED[3][0]}, ' platform for every team of the firm.')", "'Write clear notes for new members of the firm.'")
REQUIRED = _lines(f"concat('- ', CAST({YEARS} AS STRING), '+ years of experience with services.')", f"concat('- ', {ASKED[0][0]}, ' and ', {ASKED[1][0]}, ' in production.')",
                  when("j % 2 = 0", "'- Bachelor degree in a numerate field.'"))
POSTING = _lines(POST, "''", "'Requirements'", REQUIRED, "''", "'Nice to have'", f"concat('- ', {ASKED[2][0]})", "''", "'Responsibilities'",
                 *[f"concat('- ', {d})" for d in DUTIES])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, text: a posting a part."""
    j = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("j")))
    return fixed(j.select(F.col("j").alias("job_id"), F.expr(POSTING).alias("text")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, job_id: each résumé with the posting at its own place among the postings."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(n)).select(F.col("c_custkey").alias("doc_id"), F.pmod("c_custkey", F.col("n")).alias("job_id"))
