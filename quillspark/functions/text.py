"""Text as Column expressions: cleaning, bullets, tokens, headings, counts. No Python runs on the rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L

_GLYPHS = "".join("\\" + c if c in "-^]\\" else c for c in L.BULLET_GLYPHS)
BULLET_OPEN = rf"^\s*[{_GLYPHS}*\- ]+\s*"
_WHITE = r"[ \t  -​]+"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts with non-ASCII characters go to Python (Spark has no such function)."""
    from quillspark.functions.udfs import nfkc as in_python

    # Spark sends all rows to Python, whatever stands around the call: ASCII texts go as nulls
    return F.coalesce(in_python(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)


def clean_text(text: Column, compose: bool = True) -> Column:
    """Canonical characters and white space, lines kept: at most one blank line in a row."""
    text = nfkc(text) if compose else text
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, _WHITE, " ")
    text = F.regexp_replace(text, r"(?m)^[ \t\f\x0B]+|[ \t\f\x0B]+$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    r"""Without what \s stands for at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def strip_bullet(line: Column) -> Column:
    return strip(F.regexp_replace(line, BULLET_OPEN, ""))


def is_bullet(line: Column) -> Column:
    """A bullet glyph with three characters after it, or a number with a dot or bracket."""
    glyph = strip(line).rlike(BULLET_OPEN) & (F.length(strip_bullet(strip(line))) >= 3)
    return glyph | line.rlike(r"^\s*\(?\d{1,2}[.)]\s+\S")


def tokenize(text: Column) -> Column:
    """Lower-case tokens that keep + # . - / inside; c++, node.js and ci/cd stay whole."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9+#.\-/]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"[./\-]+$", "")), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), lambda t: ~t.isin(*L.STOPWORDS) & (F.length(t) > 1))


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then neighbours joined by an underscore. Pass a column, not a long expression: it is used several times."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(tokens, pairs)


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def ascii_boundaries(pattern: str) -> str:
    r"""The pattern with \b between ASCII letters, digits and _ and anything else, as in RE2; Java's \b depends on its version (before 19, it takes all letters)."""
    return pattern.replace(r"\b", "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def filled_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(r"\S"))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "\n", " "), _WHITE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def heading_text(line: Column) -> Column:
    """The line without decoration, lower-cased."""
    return F.lower(strip(undecorated(line)))


def undecorated(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\s\-_=*#|~<>\[\]•]+|[\s\-_=*#|~<>\[\]:•]+$", "")


def may_head(whole: Column, core: Column) -> Column:
    """Whether a stripped line may be a heading, by its length and end; core: `undecorated` of it."""
    return (F.length(whole) > 0) & (F.length(whole) <= 60) & (F.length(core) > 0) & ~core.rlike(r"[.!?,;]$")


def core_counts(core: Column) -> Column:
    """words, letters, capitals."""
    return F.struct(word_count(core).alias("words"), F.regexp_count(core, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(core, F.lit(r"\p{Lu}")).alias("capitals"))


def heads(core: Column, n: Column) -> Column:
    """Whether a line that `may_head` is a heading; n: `core_counts` of its core."""
    letters, capitals = n["letters"], n["capitals"]
    shouted = (F.upper(core) == core) & (letters > 0)
    titled = ~F.exists(words(core), lambda w: w.rlike(r"^\p{L}") & ~w.rlike(r"^\p{Lu}"))
    return n["words"].between(1, 5) & (~core.rlike(r"\d") | shouted) & (letters > 0) & ((capitals > letters * 0.85) | titled)


def looks_like_heading(line: Column) -> Column:
    """Short, few words, no sentence end, capitals throughout or at each word."""
    whole = strip(line)
    core = undecorated(whole)
    return may_head(whole, core) & heads(core, core_counts(core))


_PHRASES = [(p, k) for k, ps in L.HEADINGS.items() for p in ps]


def kind_of(text: Column, like: Column) -> Column:
    """Section kind of a heading's text (`heading_text`), or null: an exact phrase, else, if the line is like a heading, a long phrase that fills half of it."""
    kinds = F.create_map(*[F.lit(x) for pair in dict(reversed(_PHRASES)).items() for x in pair])
    exact = F.when(text.isin(*[p for p, _ in _PHRASES]), F.element_at(kinds, text))  # a set is searched faster than a map
    # the alternation tries longer phrases first; the found one gives the kind
    long = sorted((p for p, _ in _PHRASES if len(p) >= 6), key=lambda p: -len(p))
    found = F.regexp_extract(text, r"\b(" + "|".join(re.escape(p) for p in long) + r")\b", 1)
    loose = F.when(F.length(found) * 2 >= F.length(text), F.element_at(kinds, found))
    return F.when(text != "", F.coalesce(exact, F.when(like, loose)))


def classify_heading(line: Column, like: Column | None = None) -> Column:
    """Section kind of a heading line, or null.

    `like` is looks_like_heading(line), where it is known already.
    """
    return kind_of(heading_text(line), like if like is not None else looks_like_heading(line))


def lead_verb(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, r"^[^A-Za-z]*([A-Za-z][\w'\-]*)", 1))


def has_metric(line: Column) -> Column:
    return line.rlike(L.METRIC)


def is_strong_verb(verb: Column, listed: tuple[str, ...] | None = None) -> Column:
    """One of a caller's list, or by rule: a past tense in -ed or an irregular one, but no weak opening and none that asserts nothing."""
    if listed is not None:
        return verb.isin(*listed)
    return (verb.rlike(r"^[a-z]{2,}ed$") | verb.isin(*L.IRREGULAR_PAST)) & ~verb.isin(*L.WEAK_OPENERS, *L.IDLE_PAST)


def normalise_surface(text: Column) -> Column:
    """Comparison key of a skill's surface form."""
    text = F.regexp_replace(F.lower(strip(text)), r"[‐-―]", "-")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9+#./\- ]+", " "), r"\s+", " "))


def occurrences(text: Column, phrase: Column | str) -> Column:
    """How often a phrase occurs, without overlaps."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.floor((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def canonical_number(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[\s,]", "")), r"\.+$", "")


def non_ascii_share(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(r"[^\x00-\x7F]")).cast("double"), F.length(text).cast("double"))


def junk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[�\x00-\x05]"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def round_binary(x: Column, digits: int) -> Column:
    """x * 10^digits, rounded half away from zero, / 10^digits: what engines with binary rounding give. F.round takes the decimal digits that a double is
    printed with, so it cuts 60.449999999999996 to 60.4 where the product is 604.5.
    """
    by = F.lit(10.0 ** digits)
    return F.round(x * by, 0) / by


def score4(x: Column) -> Column:
    return F.round(clamp(x), 4)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def keep(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(array, test)
