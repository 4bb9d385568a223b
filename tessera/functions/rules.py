"""Many patterns over one text: a single pass finds where any of them could start, and each is tried only there.

The beginnings of all patterns (a few letters each) are merged into one tree,
written as one expression without case folding: a letter stands for its forms.
A text is cut where a beginning occurs; each cut is a candidate, and a pattern
fits if it fits at the start of one. Texts have few candidates, so the work no
longer grows with patterns times letters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound

#: Whatever the case, letters beyond ASCII among those of words.
ANY_CASE = "(?iU)"
#: Letters, classes and gaps of a pattern that make its beginning.
DEPTH = 6
#: Pieces of a text that a candidate reaches over: no pattern holds so many beginnings.
REACH = 16
#: Any character: what stands before a candidate.
ONE = r"[\s\S]"

Rules = Sequence[tuple[str, str]]
_ATOM = re.compile(r"\\b|\\s\+|\[[^\]]+\]|\\?[^\W_]|[ \-]")


def phrase(words: str) -> str:
    """A pattern of words with any blanks between."""
    return r"\s+".join(re.escape(w) for w in words.split())


def after(c: Column, start: str, line: bool = True) -> Column:
    """What follows the first place of a pattern, to the end of its line or of the text; null without it."""
    rest = lambda x: F.when(F.regexp_like(x, F.lit(ANY_CASE + start)), F.split(x, ANY_CASE + start, 2)[1])
    return bound(c, lambda x: F.split_part(rest(x), F.lit("\n"), F.lit(1)) if line else rest(x))


def upto(c: Column, *ends: str, case: str = ANY_CASE) -> Column:
    """What stands before the first of some patterns."""
    return F.regexp_replace(c, case + "(?s)(?:" + "|".join(ends) + ").*", "")


def _alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives, at its top and in a group that it starts with."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append(pattern[last:i])
            last = i + 1
    parts.append(pattern[last:])
    opened = [re.match(r"\(\?:([^()]*)\)(.*)$", p) for p in parts]
    return [a + m[2] for p, m in zip(parts, opened, strict=True) if m for a in m[1].split("|")] + [p for p, m in zip(parts, opened, strict=True) if not m]


def _cased(atom: str) -> str:
    """A letter or class in all its forms; other atoms as they are."""
    if atom.startswith("\\") or atom in " -":
        return re.escape(atom) if atom in " -" else atom
    letters = sorted({x for c in atom.strip("[]") for x in (c, c.lower(), c.upper(), *{"s": "ſ", "k": "K"}.get(c.lower(), ""))})
    return "[" + "".join(letters) + "]"


def _beginning(pattern: str) -> tuple[str, ...]:
    """The first atoms of a pattern, before anything optional or grouped."""
    atoms, at = [], 0
    while len(atoms) < DEPTH and (m := _ATOM.match(pattern, at)):
        if pattern[m.end() : m.end() + 1] in tuple("?*{"):
            break
        atoms.append(_cased(m[0]))
        at = m.end()
    return tuple(atoms)


def beginnings(patterns: Sequence[str]) -> str:
    """One expression for the beginnings of all patterns, as a tree."""

    def tree(branches: set[tuple[str, ...]]) -> str:
        if () in branches:
            return ""
        heads = sorted({b[0] for b in branches})
        parts = [h + tree({b[1:] for b in branches if b[0] == h}) for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return tree({_beginning(a) for p in patterns for a in _alternatives(p)})


def candidates(c: Column, *tables: Rules) -> Column:
    """The places of a text where a rule of the tables could fit, in order: each as the text from there on, after the character before it."""
    pieces = F.split(F.coalesce(c, F.lit("")), "(?=" + beginnings([p for rules in tables for p, _ in rules]) + ")")
    before = lambda parts, i: F.coalesce(F.substring(F.get(parts, i - 1), -1, 1), F.lit("\n"))
    rest = lambda parts: F.transform(parts, lambda x, i: F.concat(before(parts, i), F.array_join(F.slice(parts, i + 1, F.lit(REACH)), "")))
    return bound(pieces, rest)


def _fits(places: Column, pattern: str) -> Column:
    return F.exists(places, lambda x: F.regexp_like(x, F.lit(f"{ANY_CASE}^{ONE}(?:{pattern})")))


def fitting(places: Column, rules: Rules) -> Column:
    """Those of the places where any of the rules fits: one look at each, and most texts have none."""
    anyone = "|".join(f"(?:{p})" for p, _ in rules)
    return F.filter(places, lambda x: F.regexp_like(x, F.lit(f"{ANY_CASE}^{ONE}(?:{anyone})")))


def labels(places: Column, rules: Rules) -> Column:
    """Labels of all rules that fit, in the order of the rules."""
    return bound(fitting(places, rules), lambda held: F.filter(F.array(*[F.when(_fits(held, p), F.lit(label)) for p, label in rules]), lambda x: x.isNotNull()))


def first_label(places: Column, rules: Rules) -> Column:
    """The label of the first rule that fits."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(_fits(places, pattern), label).otherwise(out)
    return out


def matches(places: Column, pattern: str, groups: int) -> Column:
    """``raw`` and the groups ``g1, g2, ..`` of a pattern at each place where it fits, in order; an absent group is null."""
    whole = f"{ANY_CASE}^{ONE}({pattern})"
    part = lambda x, k: F.regexp_extract(x, whole, k + 1).alias("raw" if k == 0 else f"g{k}")
    count = re.compile(pattern).groups
    fields = lambda x: [part(x, k) if k <= count else F.lit(None).cast("string").alias(f"g{k}") for k in range(groups + 1)]
    return F.transform(F.filter(places, lambda x: F.regexp_like(x, F.lit(whole))), lambda x: F.struct(*fields(x)))


def started(c: Column, rules: Rules) -> Column:
    """The label of the first rule whose text, in lower case, a text starts with: one look at a table of texts."""
    known = F.create_map(*[F.lit(x) for text, label in {t.lower(): label for t, label in reversed(rules)}.items() for x in (text, label)])
    start = F.regexp_extract(c, "^(" + "|".join("\\Q" + t.lower() + "\\E" for t, _ in rules) + ")", 1)
    return bound(start, lambda x: F.try_element_at(known, F.nullif(x, F.lit(""))))
