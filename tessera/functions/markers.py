"""An index of a text's headings: one pass finds them all, and every section is a slice of it.

The index is an array of ``name, text``: a text's pieces from one heading to the
next, in order, each with its heading's name. A section is a run of pieces, and a
section within it a run of those, so a text is searched once however many
sections and levels are read from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound


def quoted(*headings: str) -> dict[str, str]:
    """Headings that are their own names, as patterns."""
    return {h: "\\Q" + h + "\\E" for h in headings}


def marker_index(c: Column, markers: dict[str, str]) -> Column:
    """Pieces of a text by its markers (name to pattern); null is the empty text.

    Headings may start within others, such as "II." within "III.": each has its
    piece. Of markers that fit at one place the first counts.
    """
    pieces = F.split(F.coalesce(c, F.lit("")), "(?=" + "|".join(f"(?:{p})" for p in markers.values()) + ")")

    def name(whole: Column) -> Column:
        found = F.lit(None).cast("string")
        for label, pattern in reversed(markers.items()):
            found = F.when(F.regexp_like(whole, F.lit(f"^(?:{pattern})")), label).otherwise(found)
        return found

    def of(parts: Column) -> Column:
        following = lambda i: F.array_join(F.slice(parts, i + 2, F.lit(2)), "")
        return F.transform(parts, lambda x, i: F.struct(bound(F.concat(F.substring(x, 1, 200), F.substring(following(i), 1, 200)), name).alias("name"), x.alias("text")))

    return bound(pieces, of)


def part(index: Column, name: str, ends: list[str], closed: bool = False) -> Column:
    """The pieces from a heading to the nearest of ``ends`` behind it, or to the last; none without the heading.

    ``closed`` parts need an end. An end that starts inside the heading's own
    words doesn't count.
    """

    def of(at: Column) -> Column:
        inside = F.length(index[at - 1]["text"]) < len(name)
        places = F.transform(index, lambda x, i: F.when((i + 1 > at + inside.cast("int")) & x["name"].isin(*ends), i + 1)) if ends else F.array().cast("array<int>")
        end = F.array_min(places)
        stop = F.coalesce(end, F.size(index) + 1)
        return F.when((at > 0) & (end.isNotNull() | F.lit(not closed)), F.slice(index, F.greatest(at, F.lit(1)), F.greatest(stop - at, F.lit(0)))).otherwise(F.slice(index, F.lit(1), F.lit(0)))

    places = F.transform(index, lambda x: F.coalesce(x["name"], F.lit("")))
    return bound(F.array_position(places, name).cast("int"), of)


def text_of(pieces: Column) -> Column:
    """The text of a run of pieces; empty if there is none."""
    return F.array_join(F.transform(pieces, lambda x: x["text"]), "")


def body_of(pieces: Column, pattern: str) -> Column:
    """The text without its heading."""
    return F.regexp_replace(text_of(pieces), f"^(?:{pattern})", "")
