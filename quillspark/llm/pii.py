"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans. Around digits and at-signs the text is cut into atoms; every
run of atoms that has the outline of an entity becomes a candidate segment, scored as a whole
by a linear model over span features, and a dynamic program over segments (entities of at most
MAX_ATOMS atoms, everything else one atom of type "none") chooses boundaries and types together.
Atoms far from any digit or at-sign can only be "none", so leaving them out changes no result.
The weights maximise the conditional likelihood of generated, labelled sentences.

Defined results: null text is empty text and has no span; offsets are code points, end
exclusive; spans that start together stand in the order of the kinds, secrets last, and of equally good segmentations the one with
fewer spans is taken; texts of any length are read whole; repeated rows are separate; an empty table gives
no rows; other columns are dropped by `find_pii` and kept by `redact_pii`.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, table

#: Kinds with a base pattern; the model also finds secrets (keys and tokens that a text assigns to a name).
KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate((*KINDS, "secret"))}
MAX_ATOMS = 24

# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these starts where a run of digits starts and takes whole runs, so no backtracking is needed.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at and at >= done else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    spans = []
    if "@" in text:
        spans += [(s, e, "email") for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    spans.sort(key=lambda x: (x[0], _RANK[x[2]]))
    return spans


# ---------------------------------------------------------------- semi-Markov model

#: 20 to 64 letters and digits, both among them.
_KEY = r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,63}[0-9])(?=[0-9]{0,63}[A-Za-z])[A-Za-z0-9]{20,64}(?![A-Za-z0-9])"
#: An atom: what may be a key, letters, digits, or one other visible character. Runs are cut so that an entity stays bounded.
_ATOM = re.compile(_KEY + r"|[^\W\d_]{1,64}|[0-9]{1,24}|[^\w\s]|_")
#: Stretches of text that can hold an entity: what surrounds a digit or an at-sign (also a written one).
_ANCHOR = re.compile(r"[0-9]|@|[\[(]\s?at\s?[\])]", re.IGNORECASE)
_NEAR = 60
#: Outline of a candidate, by type; digits are 9, letters a.
_OUTLINE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){13,18}"),
    "phone": re.compile(r"(?:\+|00)?\(?[0-9](?:[ ().-]{0,2}[0-9]){8,14}"),
    "secret": re.compile(_KEY),
}


def _features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Names of the features of a whole span that fire for a type."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    n = len(digits)
    before, after = text[max(0, start - 14):start].lower(), text[end:end + 1]
    cue = re.findall(r"[a-z]+", before)
    f = ["bias", f"digits={min(n, 20)}", f"atoms={min(8, len(_ATOM.findall(span)))}"]
    f.append("left=" + ("space" if not before or before[-1].isspace() else "alnum" if before[-1].isalnum() else before[-1]))
    f.append("right=" + ("space" if not after or after.isspace() else "alnum" if after.isalnum() else after))
    f.append("cue=" + (cue[-1] if cue and cue[-1] in _CUES else "none"))
    seps = sorted({c for c in span if not c.isalnum() and c not in "@"})
    f.append("seps=" + "".join(seps)[:4])
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    if kind == "card":
        f.append(f"luhn={14 <= n <= 19 and luhn(''.join(digits))}")
        f.append("groups=" + (",".join(map(str, groups[:5]))))
    elif kind == "phone":
        f.append("lead=" + ("+" if span[0] == "+" else "(" if span[0] == "(" else "00" if span[:2] == "00" else "digit"))
        f.append("groups=" + (",".join(map(str, groups[:6]))))
        f.append("balanced=" + str(span.count("(") == span.count(")")))
    elif kind == "secret":
        f.append("hex=" + str(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) is not None))
        f.append("assigned=" + str(re.search(r"[=:]\s*[\"']?$", before) is not None))
    elif kind == "ip":
        f.append("bytes=" + str(all(g.isdigit() and int(g) <= 255 for g in re.findall(r"[0-9]+", span))))
    else:
        tail = re.findall(r"[A-Za-z0-9-]+$", span)
        f.append("tld=" + ("letters" if tail and tail[0].isalpha() and 2 <= len(tail[0]) <= 10 else "other"))
        f.append("written=" + str("@" not in span))
    return [f"{kind}|{x}" for x in f]


_CUES = frozenset("phone tel call mobile fax contact card visa mastercard credit debit ip address host server mail email version order ref invoice id no number isbn serial part code token secret key password apikey auth commit hash sha".split())


def _stretches(text: str) -> list[tuple[int, int]]:
    """Bounds of the stretches around anchors, apart from each other."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - _NEAR), min(len(text), m.end() + _NEAR)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, int, int]]]:
    """Atoms of a stretch and candidate segments (first atom, after last atom, type, start, end): all runs of at most MAX_ATOMS atoms with an outline."""
    atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text, lo, hi)]
    found = []
    for i, (s, _) in enumerate(atoms):
        for kind, outline in _OUTLINE.items():
            if kind in ("ip", "card", "phone") and text[s] not in "+(0123456789" or not (m := outline.match(text, s, hi)):
                continue
            # the match is the longest; every shorter reading that ends with an atom is proposed too
            for j in range(i + 1, min(i + MAX_ATOMS, len(atoms)) + 1):
                e = atoms[j - 1][1]
                if e > m.end():
                    break
                if outline.fullmatch(text, s, e):
                    found.append((i, j, kind, s, e))
    return atoms, found


class SemiMarkovCRF:
    """Weights by feature name; a "none" atom scores 0, so a segment's score is against its atoms being none."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, text: str, seg: tuple[int, int, str, int, int]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in _features(text, seg[3], seg[4], seg[2]))

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation of each stretch, by dynamic programming over atoms."""
        out: list[tuple[int, int, str]] = []
        for lo, hi in _stretches(text):
            atoms, segs = candidates(text, lo, hi)
            if not segs:
                continue
            ending: dict[int, list] = {}
            for seg in segs:
                ending.setdefault(seg[1], []).append((self.score(text, seg), seg))
            best, back = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
            for j in range(1, len(atoms) + 1):
                best[j] = best[j - 1]
                for score, seg in ending.get(j, ()):
                    if best[seg[0]] + score > best[j] + 1e-12:
                        best[j], back[j] = best[seg[0]] + score, seg
            j, chosen = len(atoms), []
            while j:
                if (seg := back[j]) is None:
                    j -= 1
                else:
                    chosen.append((seg[3], seg[4], seg[2]))
                    j = seg[0]
            out += reversed(chosen)
        return out

    @classmethod
    def fit(cls, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> SemiMarkovCRF:
        """Gradient ascent on the conditional log-likelihood; expectations by forward-backward over segments."""
        lattices, names = [], {}
        for text, gold in examples:
            want = set(gold)
            for lo, hi in _stretches(text):
                atoms, segs = candidates(text, lo, hi)
                if segs:
                    rows = [(s[0], s[1], [names.setdefault(f, len(names)) for f in _features(text, s[3], s[4], s[2])], (s[3], s[4], s[2]) in want) for s in segs]
                    lattices.append((len(atoms), rows))
        w = np.zeros(len(names))
        for _ in range(epochs):
            for n, rows in lattices:
                scores = [sum(w[f] for f in feats) for _, _, feats, _ in rows]
                fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                by_end, by_start = {}, {}
                for k, (i, j, _, _) in enumerate(rows):
                    by_end.setdefault(j, []).append(k)
                    by_start.setdefault(i, []).append(k)
                for j in range(1, n + 1):
                    fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[rows[k][0]] + scores[k] for k in by_end.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[rows[k][1]] + scores[k] for k in by_start.get(i, ()))])
                for k, (i, j, feats, gold) in enumerate(rows):
                    step = gold - math.exp(min(0.0, fwd[i] + scores[k] + bwd[j] - fwd[n]))
                    if abs(step) > 1e-6:
                        for f in feats:
                            w[f] += rate * step
            w *= 1 - decay
        return cls({name: float(w[i]) for name, i in names.items()})


def training_sentences(count: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with labelled entities and look-alikes without a label."""
    rnd = random.Random(seed)
    words = "the of on maria notes send please reach via about their order house river then with for and under".split()
    digit = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            d = rnd.choice("3456") + digit(rnd.choice((13, 14, 15, 15, 15)))
            if luhn(d) == valid:
                break
        sep = rnd.choice(("", "", " ", "-", "."))
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return rnd.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digit(2)} {a} {b} {c}", f"+{digit(12)}", f"00{digit(2)} {a} {b} {c}", f"+{digit(2)} {digit(2)} {digit(4)} {digit(4)}"))

    def mail() -> str:
        name, host, top = rnd.choice(words) + rnd.choice(("", digit(2), "." + rnd.choice(words))), rnd.choice(words), rnd.choice(("com", "org", "example.com", "net"))
        at, dot = rnd.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")))
        return f"{name}{at}{host}{dot}{top.replace('.', dot)}"

    def ip() -> str:
        return rnd.choice((".", ".", "[.]")).join(str(rnd.randrange(256)) for _ in range(4))

    def key() -> str:
        letters = rnd.choice(("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"))
        return "a1" + "".join(rnd.choice(letters) for _ in range(rnd.choice((22, 30, 38, 38, 46)))) if letters[-1] == "Z" else "".join(rnd.choice(letters) for _ in range(rnd.choice((32, 40, 40, 64))))

    lookalike = [
        lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"{digit(2)}:{digit(2)}", lambda: card(False),
        lambda: ".".join(str(rnd.randrange(300, 999)) for _ in range(4)), lambda: digit(rnd.randrange(1, 13)),
        lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), lambda: f"978-{digit(10)}",
        lambda: f"{digit(3)} {digit(3)} {digit(3)} {digit(3)}", lambda: f"{digit(1)}.{digit(2)}.{digit(1)}", lambda: f"{digit(5)}-{digit(5)}",
        lambda: " ".join(digit(rnd.randrange(1, 4)) for _ in range(rnd.randrange(5, 9))), lambda: digit(rnd.randrange(14, 20)) if rnd.random() < 0.5 else digit(10),
    ]
    made = []
    for _ in range(count):
        text, gold = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))), []
        for _ in range(rnd.randrange(1, 4)):
            kind = rnd.choice((*_RANK, None, None))
            cue = rnd.choice(("", "", "", "call ", "tel: ", "card ", "host ", "mail ")) if kind else rnd.choice(("", "", "order ", "version ", "id ", "isbn ", "ref ", "commit ", "hash "))
            if kind == "secret":
                cue = rnd.choice(("token", "secret", "api_key", "key", "password", "auth")) + rnd.choice((" = \"", "=", ": ", "='", " "))
            text += " " + cue
            if kind:
                value = {"email": mail, "ip": ip, "card": lambda: card(True), "phone": phone, "secret": key}[kind]()
                gold.append((len(text), len(text) + len(value), kind))
            else:
                value = rnd.choice(lookalike)()
            text += value + rnd.choice(("", "", ",", ".")) + " " + " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5)))
        made.append((text, gold))
    return made


@functools.lru_cache(maxsize=1)
def default_model() -> SemiMarkovCRF:
    return SemiMarkovCRF.fit(training_sentences())


def all_spans(text: str, model: SemiMarkovCRF) -> tuple[list, list]:
    """(base spans, all spans): the model's spans are added where they touch no base span."""
    base = base_spans(text)
    if not _ANCHOR.search(text):
        return base, base
    extra = []
    for s, e, k in model.decode(text):
        if all(e <= a or b <= s for a, b, _ in base):
            extra.append((s, e, k))
    return base, sorted(base + extra, key=lambda x: (x[0], _RANK[x[2]]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end with their number."""
    weights = weights or default_model().weights

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SemiMarkovCRF(weights)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, spans = all_spans(text or "", model)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    # Only texts with a digit or an at-sign, or a written one, can hold a span; Python sees those alone.
    held = F.col("text").rlike(r"(?i)[0-9@]|[\[(]\s?at\s?[\])]")
    rows = small_batches(documents.select("doc_id", F.when(held, F.col("text")).alias("text")))
    return rows.mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, model: SemiMarkovCRF) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans as one."""
    out, at = [], 0
    for s, e, k in all_spans(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_pii(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All columns and rows as they are, personal data in `text` replaced, n_chars (if any) counted anew."""
    weights = weights or default_model().weights
    names = documents.columns

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = SemiMarkovCRF(weights)
        for series in texts:
            yield series.map(lambda t: None if t is None else redact(t, model))

    done = small_batches(documents).withColumn("text", clean("text"))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return done.select(*names)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
