"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain_letters() -> tuple[str, str]:
    """Letters that are a plain ASCII letter with marks, by Unicode decomposition, and those plain letters."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k)).encode("ascii", "ignore").decode()) for k in range(0xC0, 0x2000)]
    pairs = [(c, p) for c, p in pairs if len(p) == 1]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


MARKED, PLAIN = _plain_letters()


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def strip(c: Column) -> Column:
    """Without blanks and line ends at either end."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def comma_below(c: Column) -> Column:
    """Letters with a cedilla become those with a comma below."""
    return F.translate(c, "şŞţŢ", "șȘțȚ")


def fold(c: Column) -> Column:
    """Without marks, and without what is then not ASCII."""
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[^\x00-\x7F]", "")


def slug(c: Column, limit: int = 60) -> Column:
    """Lower-case words of letters and digits, joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, limit)


def strip_html(c: Column) -> Column:
    """Line breaks for ``<br>``, no other tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""))


def name_key(c: Column) -> Column:
    """A name folded, lower-cased and with single spaces; the key that collections share."""
    return F.lower(F.trim(F.regexp_replace(fold(c), r"\s+", " ")))


def row_id(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts with bars between; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def file_key(url: Column) -> Column:
    """The first 12 hex digits of SHA-1: the name under which a fetched file is kept."""
    return F.substring(F.sha1(url), 1, 12)


def escape_markup(c: Column) -> Column:
    """Text that is safe between tags and in attributes of HTML or XML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def initials(c: Column, most: int = 2) -> Column:
    """First letters of the first words, in upper case."""
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 1, most), lambda w: F.substring(w, 1, 1)), ""))


def basic_markup(c: Column, limit: int = 2000) -> Column:
    """Markup with b, i and br tags only, in lower case; no empty ones, no breaks at either end, at most two in a row."""
    for tag in ("b", "i", "br"):
        c = F.regexp_replace(c, rf"(?i)<(/?){tag}\b\s*([^>]*?)\s*>", f"<$1{tag}$2>")
    for gone in (r"<(?!/?(?:b|i|br)\b)[^>]+>", r"<b>\s*</b>", r"<i>\s*</i>", r"^(?:<br\s*/?>|\s)+", r"(?:<br\s*/?>|\s)+$"):
        c = F.regexp_replace(c, gone, "")
    return F.substring(F.regexp_replace(c, "(?:<br>){3,}", "<br><br>"), 1, limit)


def committee_name(c: Column) -> Column:
    """A committee's name without notes in brackets that hold a month or year, and without a heading that trails it."""
    c = F.regexp_replace(c, r"(?i)\s+Alte\s+comisii\s*$", "")
    c = F.regexp_replace(c, r"(?i)\s*\([^)]*(?:ian|feb|mar|apr|mai|iun|iul|aug|sep|oct|noi|dec|\b20\d{2}\b)[^)]*\)\s*", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_key(c: Column) -> Column:
    """A label folded to lower-case letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9\\s]", ""), r"\s+", " "))


def tolerant_lookup(fields: Column, *candidates: str) -> Column:
    """The first value that is neither null nor empty among candidate labels of a map, whatever their case, marks and punctuation.

    Of labels that fold alike the last one counts.
    """
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(label_key(e["key"]).alias("k"), e["value"].alias("v")))

    def value(held: Column, name: str) -> Column:
        same = F.filter(held, lambda e: e["k"] == label_key(F.lit(name)))
        return F.nullif(F.try_element_at(same, F.lit(-1))["v"], F.lit(""))

    return bound(entries, lambda held: F.coalesce(*[value(held, name) for name in candidates]))


#: Words of the agenda texts that say nothing about their topic.
STOPWORDS = (
    "de la și în din cu pe se nu ca o un sau a al ai ale lui lor unui unei unor către pentru privind asupra "
    "acest această acestei acestui aceste acestor sunt este fi fost fiind era erau vor va au am ar mai mult doar însă dar ori "
    "partea precum respectiv data prezentării biroul permanent termenul constituțional dezbatere vot potrivit regulamentului constituției "
    "documente casetele deputaților inițiate inițiată inițiat distribuit distribuirea art alin "
    "proiectul lege legea legii hotărâre hotărârea propunerea legislativă ordonanței ordonanța urgență guvernului "
    "aprobarea modificarea completarea nr pl-x ph cd raport raportul comun comisia comisiei adoptat senat organică ordinară "
    "procedură decizională cameră româniei românia"
).split()


def tokens(c: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS), longer_than: int = 3) -> Column:
    """Lower-case words, hyphenated ones whole; a border also where a capital follows a small letter.

    Stopwords and words of ``longer_than`` letters or fewer are left out.
    """
    parted = F.regexp_replace(comma_below(c), "(?<=[a-zăâîșț0-9])(?=[A-ZĂÂÎȘȚ])", " ")
    words = F.regexp_extract_all(F.lower(parted), F.lit("[a-zăâîșț0-9]+(?:-[a-zăâîșț0-9]+)*"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~F.array_contains(stop, w))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, with spaces between; none of fewer words."""
    if n == 1:
        return words
    if n == 2:
        return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def contains_any(columns: list[Column], needle: str) -> Column:
    """Whether one of the columns has the text, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return out


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(F.regexp_like(c, F.lit(pattern)), label).otherwise(out)
    return out


def all_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all patterns that are found, in the order of the rules."""
    return F.filter(F.array(*[F.when(F.regexp_like(c, F.lit(p)), F.lit(label)) for p, label in rules]), lambda x: x.isNotNull())


def amount(c: Column) -> Column:
    """A number with points or commas as thousands or decimal marks; null if it isn't one.

    With both, the later one is the decimal mark. With commas only, they are
    decimal marks if one or two digits, or none, follow the last one. With points
    only, they part thousands if three characters follow the last one.
    """
    none, dot, comma = F.lit(""), F.lit("."), F.lit(",")

    def plain(t: Column) -> Column:
        points, commas = F.contains(t, dot), F.contains(t, comma)
        return (
            F.when(points & commas & t.rlike(r",[^.,]*$"), F.replace(F.replace(t, dot, none), comma, dot))
            .when(points & commas, F.replace(t, comma, none))
            .when(commas & t.rlike(r",[^,]{0,2}$"), F.replace(t, comma, dot))
            .when(commas, F.replace(t, comma, none))
            .when(t.rlike(r"\.[^.]{3}$"), F.replace(t, dot, none))
            .otherwise(t)
        )

    number = bound(F.replace(c, F.lit(" "), none), plain)
    return bound(number, lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x.try_cast("double")))


def fraction(c: Column) -> Column:
    """``a/b`` as a number; 1 for anything else."""
    a, b = F.regexp_extract(c, r"^\s*(\d+)\s*/\s*(\d+)\s*$", 1).try_cast("double"), F.regexp_extract(c, r"^\s*(\d+)\s*/\s*(\d+)\s*$", 2).try_cast("double")
    return F.coalesce(F.when(b > 0, a / b), F.lit(1.0))


#: A bill's number anywhere in a text, and references to bills of two kinds, in order.
BILL_NUMBER = r"(\d{2,4}/\d{4})"
BILL_KINDS = [("PL", r"(?i)PL[-\s]?x?\s*(?:nr\.?\s*)?(\d+/\d{4})"), ("PHCD", r"(?i)PH\s?CD\s*(?:nr\.?\s*)?(\d+/\d{4})")]


def bill_key(c: Column) -> Column:
    """The first number of a bill, of two to four digits and a year; of a longer number its last four digits."""
    return F.nullif(F.regexp_extract(c, BILL_NUMBER, 1), F.lit(""))


def bill_reference(c: Column) -> Column:
    """``kind, nr`` of the bill that a text refers to; of the first kind that it names."""
    found = [(kind, F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))) for kind, pattern in BILL_KINDS]
    return F.struct(F.coalesce(*[F.when(nr.isNotNull(), kind) for kind, nr in found]).alias("kind"), F.coalesce(*[nr for _, nr in found]).alias("nr"))


def age_cohort(birth: Column, year: int) -> Column:
    """Five-year bracket of the age at the end of a year, such as 50–54."""
    low = F.floor((F.lit(year) - F.year(birth)) / 5) * 5
    return F.concat(low.cast("string"), F.lit("–"), (low + 4).cast("string"))
