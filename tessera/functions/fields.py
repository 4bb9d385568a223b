"""Labelled fields, profiles and event lists of record pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import day_first_date, named_month_date
from tessera.functions.mappings import elected_gender
from tessera.functions.markers import body_of, marker_index, part
from tessera.functions.text import bound, fold, name_key, strip

# --- Fixed values: labels of a motion's page, patterns of a member's profile, and what events mean, in order. ---
MOTION_LABELS = ["Tip", "Inițiator", "Iniţiator", "Nr.", "Data", "Voturi", "Vot", "Abțineri", "Abţineri", "Rezultat", "Semnătur", "Semnatar", "Texte", "Stenogr"]
PROFILE = {
    "born": r"(?iu)n\.\s*(\d{1,2}\s+[a-zăâîşţșț.]+\s+\d{4})",
    "constituency": r"(?iu)circumscripti(?:a|ia|ţia|ția)\s+electoral(?:a|ă)\s+nr\.\s*(\d+)",
    "party": r"(?iu)Forma[ţt]iunea politic[ăa]:\s*-?\s*(.+?)\s+Grup",
    "speeches": r"(?iu)Lu[ăa]ri de cuv[âa]nt:\s*(?:la\s+)?(\d+)\s+puncte",
    "declarations": r"(?iu)Declara[ţt]ii politice.*?:\s*(\d+)",
    "proposals": r"(?iu)Propuneri legislative.*?:\s*(\d+)",
    "promulgated": r"(?iu)Propuneri legislative.*?:\s*\d+\s*,\s*din care\s+(\d+)\s+promulgate",
    "questions": r"(?iu)[ÎI]ntreb[ăa]ri [şs]i interpel[ăa]ri:\s*(\d+)",
}
MILESTONES = [
    ("presented", "prezentare|primit"),
    ("registered", "inregistrat"),
    ("adopted_jointly", "(?=.*adoptat)(?=.*sedin)(?=.*comun)"),
    ("adopted_chamber", "(?=.*adoptat)(?=.*camera deputat)"),
    ("adopted_senate", "(?=.*adoptat)(?=.*senat)"),
    ("promulgated", "promulgat"),
]


def labelled_text(c: Column, label: str, others: list[str], most: int = 200) -> Column:
    """What follows a label, up to the next label, within so many characters, with the blanks at its ends; empty without the label."""
    quoted = lambda x: "\\Q" + x + "\\E"
    return F.regexp_extract(c, rf"{quoted(label)}\s*:?\s*(.{{1,{most}}}?)(?=\s+(?:{'|'.join(map(quoted, others))})|\s*$)", 1)


def labelled_field(c: Column, label: str, others: list[str], most: int = 200) -> Column:
    """The same without those blanks; null without the label."""
    return strip(F.nullif(labelled_text(c, label, others, most), F.lit("")))


def leading_number(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^(\d+)", 1).try_cast("int")


def number_and_day(c: Column) -> Column:
    """``nr, day`` of a number, a bar and a date; a text of another form is a number without a date."""
    pattern = r"^(\d+)\s*/\s*(\d{1,2}-\d{1,2}-\d{4})"
    both = F.regexp_like(c, F.lit(pattern))
    return F.struct(F.when(both, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("nr"), F.when(both, day_first_date(F.regexp_extract(c, pattern, 2))).alias("day"))


def signatories(html: Column, link: str) -> Column:
    """Names of members that a page links to, each once, in order; names of three letters or fewer are none."""
    names = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<a\b[^>]*href=[\"'][^\"']*{link}[^\"']*[\"'][^>]*>(.*?)</a>"), F.lit(1)), lambda x: strip(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    return F.array_distinct(F.filter(names, lambda x: F.length(x) > 3))


def profile(c: Column) -> Column:
    """``born`` and the other fields of a member's profile; null where the text has none."""
    part = lambda name: F.nullif(F.regexp_extract(c, PROFILE[name], 1), F.lit(""))
    numbers = [part(n).try_cast("int").alias(n) for n in ("constituency", "speeches", "declarations", "proposals", "promulgated", "questions")]
    return F.struct(named_month_date(part("born")).alias("born"), strip(part("party")).alias("party"), *numbers)


def milestones(events: Column, text: str, day: str) -> Column:
    """First day of each kind of event in a list in order; an event is of the first kind that fits it and has no day yet.

    A joint adoption counts for both chambers. Also the deadline for amendments
    and how many were admitted and rejected, from the first event that says so.
    """
    plain = F.transform(events, lambda e: F.struct(F.lower(fold(e[text])).alias("t"), e[text].alias("raw"), e[day].alias("day")))
    names = [name for name, _ in MILESTONES if name != "adopted_jointly"]
    none = F.struct(*[F.lit(None).cast("date").alias(n) for n in names])

    def step(have: Column, e: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(MILESTONES):
            free = F.lit(True) if name == "adopted_jointly" else have[name].isNull()
            kind = F.when(e["t"].rlike(pattern) & free, name).otherwise(kind)
        joint = ("adopted_chamber", "adopted_senate")
        return bound(kind, lambda k: F.struct(*[F.coalesce(have[n], F.when((k == n) | ((k == "adopted_jointly") & F.lit(n in joint)), e["day"])).alias(n) for n in names]))

    def first(pattern: str, where: str) -> Column:
        found = F.filter(F.transform(F.filter(plain, lambda e: F.contains(e["t"], F.lit(where))), lambda e: F.regexp_extract(e["raw"], pattern, 1)), lambda x: x != "")
        return F.try_element_at(found, F.lit(1))

    days = F.aggregate(plain, none, step)
    return F.struct(
        days.alias("days"),
        day_first_date(first(r"(\d{1,2}\.\d{1,2}\.\d{4})", "termen depunere amendament")).alias("deadline"),
        first(r"(?i)\((\d+)\s*amend(?:amente)?\.?\s*admise\)", "amend").cast("int").alias("admitted"),
        first(r"(?i)\((\d+)\s*amend(?:amente)?\.?\s*respinse\)", "amend").cast("int").alias("rejected"),
    )


# --- A member's whole profile, from one index of its headings. ---
#: Headings of a profile, roles, and what entries of lists start with.
HEADINGS = {
    "seat": r"(?iu)circumscripti(?:a|ia|ţia|ția)\s+electoral(?:a|ă)\s+nr\.",
    "validation": r"(?iu)data\s+validari[iî]\s*:",
    "party": r"(?iu)Forma[ţt]iunea politic[ăa]:",
    "group": r"(?iu)Grupul parlamentar:",
    "permanent": r"(?iu)Comisii permanente",
    "joint": r"(?iu)Comisii speciale comune",
    "special": r"(?iu)Comisii speciale(?! comune)",
    "delegations": r"(?iu)Delegatii",
    "delegations_marked": r"(?iu)Delegaţii",
    "friendship": r"(?iu)Grupuri de prietenie",
    "activity": r"(?iu)Activitatea parlamentar",
    "other_activity": r"(?iu)Activitatea(?! parlamentar)",
    "office": r"(?iu)Biroul\s+parlamentar:",
    "chamber": r"(?iu)Camera Deputa",
}
COMMITTEE_KINDS = [("permanenta", "permanent", ["special", "joint"]), ("speciala", "special", ["joint"]), ("speciala_comuna", "joint", [])]
COMMITTEE = r"Comisia\s.*?(?=\s+Comisia|\s+(?:Comisii|Delegat|Grupuri|Activit)|$)"
COMMITTEE_ROLE = r"\s*-\s*(Secretar|Pre[şs]edinte|Vicepre[şs]edinte|Membru|Lider)"
GROUP_ROLE = r"(?iu)\s+(Lider|Vicelider|Pre[şs]edinte|Vicepre[şs]edinte|Secretar)(?:\s+-\s+din|\s+din|\s*$)"
PARTY_TAIL = r"\s+(Vicelider|Lider|Pre[şs]edinte|Secretar|din\s+\w+).*$"
LIST_ROLE = r"(?iu)\s+(supleant|titular|Vicepre[şs]edinte|Pre[şs]edinte|Secretar|Membru|Vicelider|Lider)\s*$"
DELEGATION_HEAD, DELEGATION = r"(?iu)Delega[ţt]ii\s+ale\s+Parlamentului\s+Rom[âa]niei[^:]*:", r"Delega[ţt]ia\s+Parlamentului\s+Rom[âa]niei"
FRIENDSHIP_HEAD, FRIENDSHIP = r"(?iu)Grupuri\s+de\s+prietenie[^:]*:", r"Grupul\s+parlamentar\s+de\s+prietenie"
COUNTY = r"(?iu)nr\.\s*\d+\s+([A-ZĂÂÎȘŞȚŢ\- ]+?)(?=\s+data|\s+Grup|\s+Forma|$)"
SPEECHES = r"(?iu)Lu[ăa]ri de cuv[âa]nt:\s*(?:la\s+)?\d+\s+puncte.*?\(?\s*[îi]n\s+(\d+)"
DECISION = r"(?iu)(HCD\s+nr\.\s*[\d/]+)"
PORTRAIT = r"(?i)<img\b[^>]*\bsrc=[\"']([^\"']*/parlamentari/l[^\"']*)[\"']"


def page_text(html: Column) -> Column:
    """The text between a page's tags, with single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def _match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(c, pattern, group)), F.lit(""))


def _entries(body: Column, start: str) -> Column:
    """Parts of a list that start with what its entries start with, without a role at their end."""
    parts = F.transform(F.split(body, rf"(?iu)(?={start})"), lambda x: strip(x))
    return F.transform(F.filter(parts, lambda x: F.regexp_like(x, F.lit(rf"(?iu)^{start}"))), lambda x: strip(F.regexp_replace(x, LIST_ROLE, "")))


def _committees(index: Column) -> Column:
    """``committee, kind, role`` of all committee lists that end before another heading."""

    def entry(x: Column, kind: str) -> Column:
        role = _match(x, COMMITTEE_ROLE)
        name = strip(F.when(role.isNotNull(), F.regexp_extract(x, rf"^(.*?){COMMITTEE_ROLE}", 1)).otherwise(x))
        return F.struct(name.alias("committee"), F.lit(kind).alias("kind"), F.translate(role, "ş", "ș").alias("role"))

    def entries(kind: str, name: str, before: list[str]) -> Column:
        body = body_of(part(index, name, [*before, "delegations", "friendship", "activity", "other_activity"], closed=True), HEADINGS[name])
        return F.transform(F.regexp_extract_all(strip(body), F.lit(COMMITTEE), F.lit(0)), lambda x: entry(strip(x), kind))

    return F.filter(F.concat(*[entries(*k) for k in COMMITTEE_KINDS]), lambda x: x["committee"] != "")


def member_record(text: Column, name: Column, html: Column | None = None, base: str = "") -> Column:
    """A member's whole profile as one struct, from a page's text with single spaces and the name in the list.

    ``id`` (of the folded name and the day of birth), names, gender, birth,
    portrait (from ``html``, below ``base``), seat, validation, party, group and role in it, committees with
    kind and role, delegations, groups of friendship, counts of activity and the
    office. What a text lacks is null, a list empty; a null text is empty.
    """
    t = F.coalesce(text, F.lit(""))
    return bound(F.struct(t.alias("t"), marker_index(t, HEADINGS).alias("index")), lambda x: _member(x["t"], x["index"], name, html, base))


def _member(t: Column, index: Column, name: Column, html: Column | None, base: str) -> Column:
    seat = body_of(part(index, "seat", ["validation", "party", "group"]), "")
    validation = body_of(part(index, "validation", ["party", "group", "permanent"]), HEADINGS["validation"])
    party = F.regexp_replace(body_of(part(index, "party", ["group"], closed=True), HEADINGS["party"]), r"(?i)\s+Grup.*$", "")
    group = strip(body_of(part(index, "group", ["permanent", "special", "joint", "delegations", "delegations_marked", "friendship", "activity"], closed=True), HEADINGS["group"]))
    office = body_of(part(index, "office", ["chamber"]), HEADINGS["office"])
    delegations = F.when(F.regexp_like(t, F.lit(DELEGATION_HEAD)), F.regexp_extract(t, rf"{DELEGATION_HEAD}(.*?)(?=Grupuri\s+de\s+prietenie|Activitatea\s+parlamentar|$)", 1))
    friends = F.regexp_replace(F.concat_ws("", body_of(part(index, "friendship", ["activity"]), "")), FRIENDSHIP_HEAD, "")
    number = lambda key: F.nullif(F.regexp_extract(t, PROFILE[key], 1), F.lit("")).try_cast("int")
    words = F.split(strip(F.regexp_replace(name, r"\s+", " ")), " ")

    def of(x: Column) -> Column:
        role = _match(x["group"], GROUP_ROLE)
        return F.struct(
            F.substring(F.sha2(F.concat_ws("|", name_key(name), x["born"].cast("string")), 256), 1, 16).alias("id"),
            words[0].alias("family_name"),
            F.nullif(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit("")).alias("given_name"),
            elected_gender(t).alias("gender"),
            x["born"].alias("born"),
            (F.concat(F.lit(base), _match(html, PORTRAIT)) if html is not None else F.lit(None).cast("string")).alias("portrait"),
            F.replace(F.initcap(F.replace(_match(x["seat"], COUNTY), F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-")).alias("county"),
            _match(x["seat"], r"nr\.\s*(\d+)").try_cast("int").alias("constituency"),
            named_month_date(x["validation"]).alias("validated"),
            _match(x["validation"], DECISION).alias("decision"),
            F.nullif(F.regexp_replace(strip(F.regexp_replace(x["party"], r"^[ \-]+|[ \-]+$", "")), PARTY_TAIL, ""), F.lit("")).alias("party"),
            F.nullif(F.when(role.isNotNull(), strip(F.regexp_replace(x["group"], GROUP_ROLE + ".*$", ""))).otherwise(x["group"]), F.lit("")).alias("group"),
            F.translate(role, "ş", "ș").alias("group_role"),
            _committees(index).alias("committees"),
            _entries(strip(F.coalesce(delegations, F.lit(""))), DELEGATION).alias("delegations"),
            _entries(strip(x["friends"]), FRIENDSHIP).alias("friendships"),
            number("speeches").alias("speeches"),
            _match(t, SPEECHES).try_cast("int").alias("sittings"),
            *[number(k).alias(k) for k in ("declarations", "proposals", "promulgated", "questions")],
            F.nullif(strip(x["office"]), F.lit("")).alias("office"),
        )

    born = named_month_date(F.regexp_extract(t, PROFILE["born"], 1))
    return bound(F.struct(born.alias("born"), seat.alias("seat"), validation.alias("validation"), party.alias("party"), group.alias("group"), office.alias("office"), friends.alias("friends")), of)
