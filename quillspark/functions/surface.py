"""Exact scan of texts for surface forms: a trie over atoms, boundary rules, spans claimed longest form first.

An atom is a run of word characters, a run of white space and hyphens, or one other character. A form is a path of atoms; a space
in it stands for any run of white space and hyphens, a hyphen for itself. A walk starts at atoms that open a form only, and
ends at the longest form's depth, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F

_ATOM = re.compile(r"[\s\-]+|\w+|.", re.DOTALL).findall
#: Letters whose lower case is ASCII; one for one, so that places stay.
_LOWER = {c: c + 32 for c in range(65, 91)} | {0x130: "i", 0x131: "i", 0x212A: "k", 0x17F: "s"}
#: Characters of a snippet to either side, and snippets kept of a skill in a text.
AROUND, SNIPPETS = 45, 3
#: Forms that a scan takes; they go to every task.
MOST_FORMS = 1_000_000


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _gap(form: str) -> Callable:
    """Whether a run of white space and hyphens is one that these spaces and hyphens of a form stand for."""
    return re.compile(re.escape(form).replace(r"\ ", r"[\s\-]+")).fullmatch


def form_pattern(form: str) -> re.Pattern:
    """What a form finds, as a regular expression. It needs no word next to it, nor + or # next to a letter or digit."""
    before, after = (r"(?<![\w+#])" if form[0].isalnum() else r"(?<!\w)"), (r"(?![\w+#])" if form[-1].isalnum() else r"(?!\w)")
    return re.compile(before + re.escape(form).replace(r"\ ", r"[\s\-]+") + after, re.IGNORECASE)


class SurfaceForms:
    """The trie of (form, name, category): forms are comparison keys; of equally long ones the earlier comes first."""

    def __init__(self, forms: list[tuple[str, str, str]]):
        self.forms = sorted(forms, key=lambda f: -len(f[0]))
        self.words: list[dict[str, int]] = [{}]
        self.gaps: list[list[tuple[Callable, int]]] = [[]]
        self.ends: list[int] = [-1]
        self.odd: list[tuple[int, re.Pattern]] = []
        paths: dict[tuple[str, ...], int] = {(): 0}
        for rank, (form, _, _) in enumerate(self.forms):
            if "-" in (form[0], form[-1]):
                self.odd.append((rank, form_pattern(form)))  # it can begin or end within a run
                continue
            atoms = tuple(_ATOM(form))
            for depth in range(1, len(atoms) + 1):
                if atoms[:depth] not in paths:
                    node, atom = paths[atoms[:depth - 1]], atoms[depth - 1]
                    paths[atoms[:depth]] = len(self.ends)
                    if atom[0] in " -":
                        self.gaps[node].append((_gap(atom), len(self.ends)))
                    else:
                        self.words[node][atom] = len(self.ends)
                    self.words.append({})
                    self.gaps.append([])
                    self.ends.append(-1)
            self.ends[paths[atoms]] = rank

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(rank of the form, start, end) of all places where a form stands."""
        atoms = _ATOM(text.translate(_LOWER))
        opening = self.words[0]
        starts = [i for i, a in enumerate(atoms) if a in opening]
        found = [(rank, *m.span()) for rank, pattern in self.odd for m in pattern.finditer(text)]
        if not starts:
            return found
        place = [0, *accumulate(map(len, atoms))]
        for first in starts:
            nodes, at = [opening[atoms[first]]], first + 1
            while nodes:
                for node in nodes:
                    rank = self.ends[node]
                    if rank >= 0 and self._stands(text, rank, place[first], place[at]):
                        found.append((rank, place[first], place[at]))
                if at == len(atoms):
                    break
                atom, after = atoms[at], []
                for node in nodes:
                    if atom in self.words[node]:
                        after.append(self.words[node][atom])
                    elif self.gaps[node] and (atom[0] == "-" or atom[0].isspace()):
                        after += [child for fits, child in self.gaps[node] if fits(atom)]
                nodes, at = after, at + 1
        return found

    def _stands(self, text: str, rank: int, start: int, end: int) -> bool:
        form = self.forms[rank][0]
        for c, edge in ((text[start - 1:start], form[0]), (text[end:end + 1], form[-1])):
            if c and (_is_word(c) or edge.isalnum() and c in "+#"):
                return False
        return True

    def claims(self, text: str) -> list[tuple[str, str, int, list[str]]]:
        """(name, category, n, snippets): longer forms claim their characters first, then earlier places."""
        taken, upto = bytearray(len(text)), {}
        out: dict[str, tuple[str, int, list[str]]] = {}
        for rank, start, end in sorted(self.hits(text)):
            if start < upto.get(rank, 0):
                continue  # a form doesn't overlap itself
            upto[rank] = end
            if taken.find(1, start, end) >= 0:
                continue
            taken[start:end] = b"\x01" * (end - start)
            _, name, category = self.forms[rank]
            _, n, snippets = out.get(name, (category, 0, []))
            if len(snippets) < SNIPPETS:
                snippets.append(snippet(text, start, end))
            out[name] = category, n + 1, snippets
        return [(name, *rest) for name, rest in out.items()]


def snippet(text: str, start: int, end: int) -> str:
    """The text around a place on one line."""
    left, right = max(0, start - AROUND), min(len(text), end + AROUND)
    return ("..." if left else "") + " ".join(text[left:right].split()) + ("..." if right < len(text) else "")


def scanner(forms: list[tuple[str, str, str]]):
    """A function of texts to arrays of (name, category, n, snippets); forms: key, name, category, in declared order."""
    if len(forms) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} surface forms")

    @F.pandas_udf("array<struct<name:string,category:string,n:long,snippets:array<string>>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = SurfaceForms(forms)
        for texts in batches:
            yield pd.Series([[dict(zip(("name", "category", "n", "snippets"), c)) for c in trie.claims(t or "")] for t in texts], dtype=object)

    return scan
