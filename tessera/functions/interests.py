"""Rows of declarations of interests: companies, boards, contracts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import day_first_date
from tessera.functions.declarations import is_blank, main_role, numbered_entries, split_number
from tessera.functions.markers import marker_index, part, quoted, text_of
from tessera.functions.text import amount, bound, first_rule, strip

# --- Fixed values: headings, patterns of roles, titles and amounts, and kinds of contracts in order of precedence. ---
HEADINGS = [
    "1. Asociat sau ac",
    "2. Calitatea de membru în organele de conducere, administrare",
    "3. Calitatea de membru în cadrul asocia",
    "4. Calitatea de membru în organele de conducere, administrare şi control, retribuite",
    "5. Contracte",
    "Prezenta declara",
]
BENEFICIARIES = [("titular", "Titular"), ("sot_sotie", "So[ţț]/so[ţț]ie"), ("rude", "Rude de gradul I"), ("societate_comerciala", "Societă[ţț]i comerciale")]
HELD = r"(?iU)\b(Asociat|Ac[tţ]ionar|Fondator|Membru)\b"
TITLES = r"(?iU)(Păr[tţ]i\s+sociale|Ac[tţ]iuni|Parti\s+sociale)"
IN_RON = r"(?i)(\d[\d.,]*)\s*RON"
DASHES = "- - - - - - -"
ASIDE = r"(?m)^\d+\).*$|^/.*$|^\d+\s*/\s*\d+$|^[a-z].*$"
CONTRACTS = [
    (r"(?iU)LUCRARI|LUCRĂRI|EXECU[TŢ]IE\s+LUCRARI", "lucrari"),
    (r"(?iU)ASISTEN[TŢ][AĂ]\s+JURIDIC[AĂ]", "asistenta_juridica"),
    (r"(?iU)ASISTEN[TŢ][AĂ]\s+TEHNIC[AĂ]", "asistenta_tehnica"),
    (r"(?iU)CONSULTAN[TŢ][AĂ]", "consultanta"),
    (r"(?iU)PROIECTAR", "proiectare"),
    (r"(?iU)FURNIZARE", "furnizare"),
    (r"(?iU)FINAN[TŢ]ARE|NERAMBURSABIL", "finantare"),
    (r"(?iU)COLABORARE", "colaborare"),
    (r"(?iU)PRESTARI?\s+SERVICII?|SERVICII|CATERING", "servicii"),
]


def _entries(c: Column) -> Column:
    """Texts of numbered entries, without their numbers."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?m)(?=^\d+\.\d+\s)"), lambda s: strip(s)), lambda x: x.rlike(r"^\d+\.\d+\s"))
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^\d+\.\d+\s+", ""))


def _name(c: Column) -> Column:
    """The first line, without a dash at its end."""
    return strip(F.regexp_replace(strip(F.split_part(strip(c), F.lit("\n"), F.lit(1))), "-+$", ""))


def _amounts(c: Column) -> Column:
    """Numbers before the currency, those that are numbers."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(IN_RON), F.lit(1)), amount), lambda x: x.isNotNull())


def companies(c: Column) -> Column:
    """``name, role, titles, kind, value`` of entries that name a role; the value is the last amount."""

    def row(x: Column) -> Column:
        return F.struct(
            _name(F.regexp_extract(x, r"(?isU)^(.*?)\b(?:Asociat|Ac[tţ]ionar|Fondator|Membru)\b", 1)).alias("name"),
            F.initcap(F.regexp_extract(x, HELD, 1)).alias("role"),
            F.regexp_extract(x, r"(?iU)\b(\d+)\s+(?:Păr[tţ]i\s+sociale|Ac[tţ]iuni|Parti\s+sociale)\b", 1).try_cast("int").alias("titles"),
            F.nullif(F.regexp_extract(x, TITLES, 1), F.lit("")).alias("kind"),
            F.try_element_at(_amounts(x), F.lit(-1)).alias("value"),
        )

    return F.filter(F.transform(F.filter(_entries(c), lambda x: F.regexp_like(x, F.lit(HELD))), row), lambda r: r["name"] != "")


def boards(c: Column) -> Column:
    """``name, role, value`` of entries; the role is the most specific one, the value the last amount."""
    row = lambda x: F.struct(_name(x).alias("name"), main_role(F.translate(x, "şșŞȘ", "ssSS")).alias("role"), F.try_element_at(_amounts(x), F.lit(-1)).alias("value"))
    return F.filter(F.transform(_entries(c), row), lambda r: r["name"] != "")


def contracts(c: Column) -> Column:
    """``beneficiary, name, kind, value, approximate, day`` of each kind of beneficiary whose block isn't empty.

    A block goes from its heading to the next one; of a heading that repeats the
    first counts. The value is the sum of its amounts, or what a number broken
    over two lines is put together from, which is approximate.
    """

    def block(tag: str, heading: str) -> Column:
        others = "|".join(h for _, h in BENEFICIARIES)
        body = F.regexp_extract(c, rf"(?s){heading}[^\n]*\n(.*?)(?=(?:{others})|\z)", 1)
        clean = strip(F.regexp_replace(body, ASIDE, ""))
        cut = F.regexp_extract(clean, rf"(?s)^(.*{DASHES})", 1)
        return F.struct(F.lit(tag).alias("tag"), F.when(cut != "", cut).otherwise(clean).alias("text"))

    def row(b: Column) -> Column:
        flat = strip(F.regexp_replace(b["text"], r"\s+", " "))
        broken = split_number(b["text"], flat)
        total = F.aggregate(F.filter(_amounts(flat), lambda v: v > 0), F.lit(0.0), lambda a, v: a + v)
        lines = F.filter(F.transform(F.split(b["text"], "\n"), lambda x: strip(F.split_part(strip(x), F.lit("  "), F.lit(1)))), lambda x: (F.length(x) > 3) & ~is_blank(x) & (x.rlike(r"(?iU)\b(?:SC|SRL|SA|RA|SNC|SCS|CABINET INDIVIDUAL|PFA|ASOCIATIA|FUNDATIA)\b") | (x.rlike(r"(?U)^\p{Lu}") & (F.length(x) > 4))))
        return F.struct(
            b["tag"].alias("beneficiary"),
            F.try_element_at(lines, F.lit(1)).alias("name"),
            first_rule(b["text"], CONTRACTS).alias("kind"),
            F.coalesce(broken["value"], F.when(total > 0, total)).alias("value"),
            broken["split"].alias("approximate"),
            day_first_date(F.regexp_extract(b["text"], r"\b(\d{2}[./]\d{2}[./]\d{4})\b", 1)).alias("day"),
        )

    blocks = F.filter(F.array(*[block(tag, heading) for tag, heading in BENEFICIARIES]), lambda b: ~is_blank(b["text"]))
    return bound(blocks, lambda held: F.transform(held, row))


#: What a declaration says of itself.
REGISTERED, COMPLETED = r"^\s*(\d{6,9})", r"(?iu)Data complet[aă]rii\s+Semn[aă]tura\s+(\d{2}-\d{2}-\d{4})"
OCCASION = r"(?iu)(30 de zile de la num[iî]re|30 de zile de la [îi]ncetare|Anual[,\s])"
SHORTEST = 100


def interests(c: Column) -> Column:
    """A whole declaration of interests as one struct; its sections come from one index of the headings.

    ``readable`` (100 characters or more; else nothing is read), register number,
    occasion, day, ``companies, boards, associations, functions, contracts``, how
    many companies there are, the sum of the contracts, whether there is an office
    in a party, a public contract, or anything at all. Null is an empty text.
    """
    text = F.coalesce(c, F.lit(""))
    usable = F.when(F.length(strip(text)) >= SHORTEST, text).otherwise("")

    def sections(index: Column) -> Column:
        of = lambda k: text_of(part(index, HEADINGS[k], HEADINGS[k + 1 :]))
        return F.struct(*[of(k).alias(f"s{k}") for k in range(5)])

    def rows(s: Column) -> Column:
        third = strip(F.regexp_replace(s["s2"], r"(?is)^3\. Calitatea de membru.*?\n", ""))
        return F.struct(companies(s["s0"]).alias("companies"), boards(s["s1"]).alias("boards"), F.when(~is_blank(third), third).alias("associations"), numbered_entries(s["s3"], 4).alias("functions"), contracts(s["s4"]).alias("contracts"))

    def whole(x: Column) -> Column:
        said = F.lower(F.regexp_extract(usable, OCCASION, 1))
        occasion = F.when(F.contains(said, F.lit("num")), "numire").when(F.contains(said, F.lit("ncetare")), "incetare").when(said != "", "anual")
        offices, public = F.size(x["functions"]) > 0, F.size(x["contracts"]) > 0
        return F.struct(
            (F.length(usable) > 0).alias("readable"),
            F.nullif(F.regexp_extract(usable, REGISTERED, 1), F.lit("")).alias("register_id"),
            occasion.alias("occasion"),
            day_first_date(F.regexp_extract(usable, COMPLETED, 1)).alias("completed"),
            *[x[k].alias(k) for k in ("companies", "boards", "associations", "functions", "contracts")],
            F.size(x["companies"]).alias("company_count"),
            F.aggregate(x["contracts"], F.lit(0.0), lambda a, v: a + F.coalesce(v["value"], F.lit(0.0))).alias("contract_total"),
            offices.alias("party_office"),
            public.alias("public_contracts"),
            ((F.size(x["companies"]) + F.size(x["boards"]) > 0) | offices | public | x["associations"].isNotNull()).alias("holds_any"),
        )

    return bound(marker_index(usable, quoted(*HEADINGS)), lambda index: bound(sections(index), lambda s: bound(rows(s), whole)))
