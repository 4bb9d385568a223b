"""Sections, amounts and rows of declaration texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.mappings import first_contained
from tessera.functions.markers import marker_index, part, quoted, text_of
from tessera.functions.text import amount, bound, fraction, strip

# --- Fixed values: rates, section headings, patterns of amounts, and what blocks contain. ---
RATES = {"RON": 1.0, "LEI": 1.0, "EUR": 5.05, "EURO": 5.05, "USD": 4.50, "DOLARI": 4.50, "GBP": 5.80, "CHF": 5.40}
SECTIONS = ["I. Bunuri imobile", "II. Bunuri mobile", "III. Bunuri mobile", "IV. Active financiare", "V. Datorii", "VI. Cadouri", "VII. Venituri"]
CURRENCY = "RON|EUR|EURO|USD|GBP|CHF|lei|euro|dolari"
AMOUNT = rf"(?i)(\d{{1,3}}(?:[.,]\d{{3}})+(?:[.,]\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?)\s*({CURRENCY})\b"
AMOUNT_AFTER = rf"(?i)\b({CURRENCY})\b\s+\d{{4}}\s+(\d+(?:[.,]\d+)?)"
AREA = r"(?i)(\d+(?:[.,]\d+)?)\s*m\s*²?"
YEAR = r"\b(19\d{2}|20[0-3]\d)\b"
LAND = [("luciu de ap", "luciu_apa"), ("extravilan", "extravilan"), ("forestier", "forestier"), ("agricol", "agricol"), ("intravilan", "intravilan")]
BUILDINGS = [("comerciale", "comercial"), ("producti", "comercial"), ("vacan", "vacanta"), ("locuit", "locuinta"), ("apartament", "apartament"), ("bunuri imobile", "alte_cladiri")]
ACQUIRED = [("mostenire", "mostenire"), ("moștenire", "mostenire"), ("donati", "donatie"), ("donație", "donatie"), ("vânzare", "cumparare"), ("vanzare", "cumparare"), ("altele", "altele")]
VEHICLE = r"(?iU)^(autoturism|autovehicul|motociclet|tractor|remorc|iaht|şalup|salup|alt mijloc)\w*"


def in_ron(value: Column, currency: Column) -> Column:
    """An amount at a fixed rate; an unknown currency counts as one to one."""
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return value * F.coalesce(F.try_element_at(rates, F.upper(currency)), F.lit(1.0))


def scan_amounts(c: Column, above: float = 100.0) -> Column:
    """Sum in RON of all amounts above a bound, with the currency after or before them."""
    total = F.lit(0.0)
    for pattern, number, currency in ((AMOUNT, 1, 2), (AMOUNT_AFTER, 2, 1)):
        part = lambda g, p=pattern: F.regexp_extract_all(c, F.lit(p), F.lit(g))
        each = F.zip_with(part(number), part(currency), lambda n, cur: bound(amount(n), lambda v: F.when(v > above, in_ron(v, cur)).otherwise(0.0)))
        total = total + F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return total


def section(c: Column, heading: str, following: list[str]) -> Column:
    """The text from a heading to the nearest of the following ones; empty without the heading."""

    def upto(body: Column) -> Column:
        ends = [F.nullif(F.position(F.lit(x), body), F.lit(0)) for x in following]
        return F.substring(body, F.lit(1), F.least(*ends, F.length(body) + 1, F.length(body) + 1) - 1)

    def of(t: Column) -> Column:
        start = F.position(F.lit(heading), t)
        return F.when(start > 0, F.concat(F.lit(heading), bound(F.substring(t, start + len(heading), F.length(t)), upto))).otherwise("")

    return bound(c, of)


def property_category(block: Column, building: bool) -> Column:
    return first_contained(F.lower(block), LAND + (BUILDINGS if building else []), "necunoscuta")


def acquisition(block: Column) -> Column:
    return first_contained(F.lower(block), ACQUIRED)


def _first(c: Column, pattern: str) -> Column:
    return bound(F.regexp_extract(c, pattern, 1), lambda x: F.nullif(x, F.lit("")))


def properties(c: Column, building: bool) -> Column:
    """Rows of a section of real estate, of more than 5 square metres each.

    ``kind, category, area, county, year, share, mode, owned``; a block starts
    with its country, year and share stand on the line of the area, ``owned`` is
    the area by that share.
    """

    def row(block: Column) -> Column:
        line = F.regexp_extract(block, r"(?i)([^\n]*?\d+(?:[.,]\d+)?\s*m\s*²?[^\n]*)", 1)
        return bound(F.struct(line.alias("line"), _first(line, r"\b(\d+/\d+)\b").alias("share"), amount(F.regexp_extract(block, AREA, 1)).alias("area")), lambda x: fields(block, x["line"], x["share"], x["area"]))

    def fields(block: Column, line: Column, share: Column, area: Column) -> Column:
        return F.struct(
            F.lit("cladire" if building else "teren").alias("kind"),
            property_category(block, building).alias("category"),
            area.alias("area"),
            _first(block, r"(?i)Judet\s*:\s*(\S+)").alias("county"),
            _first(line, YEAR).cast("int").alias("year"),
            share.alias("share"),
            acquisition(block).alias("mode"),
            (area * fraction(share)).alias("owned"),
        )

    blocks = F.split(F.coalesce(c, F.lit("")), r"(?im)^Tara\s*:")
    return F.filter(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), row), lambda x: x["area"] > 5)


def own_income(c: Column) -> Column:
    """Sum in RON of the declarant's own subsections of the incomes; those of others don't count."""
    own = F.regexp_extract_all(c, F.lit(r"(?s)\b[1-9]\.1\.(.*?)(?=\b[1-9]\.[1-3]\.|\z)"), F.lit(1))
    return F.coalesce(F.aggregate(F.transform(own, lambda s: scan_amounts(s)), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def vehicles(c: Column) -> Column:
    """Rows of the section of vehicles: ``kind, brand, year, mode``; the year and mode are on the line or the next three."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    held = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.array_join(F.slice(lines, i + 1, F.lit(4)), "\n").alias("near")))

    def row(x: Column) -> Column:
        rest = strip(F.regexp_replace(x["line"], VEHICLE, ""))
        return F.struct(
            F.regexp_extract(x["line"], VEHICLE, 1).alias("kind"),
            F.coalesce(F.nullif(strip(F.regexp_extract(rest, r"^([A-Za-zÀ-ž\s\-.]+?)\s+\d", 1)), F.lit("")), _first(rest, r"^(\S+)")).alias("brand"),
            _first(x["near"], YEAR).cast("int").alias("year"),
            first_contained(F.lower(x["near"]), [r for r in ACQUIRED if r[1] == "cumparare"] + [r for r in ACQUIRED if r[1] in ("mostenire", "donatie")]).alias("mode"),
        )

    return F.transform(F.filter(held, lambda x: F.regexp_like(x["line"], F.lit(VEHICLE))), row)


def is_blank(c: Column) -> Column:
    """Whether a field holds nothing but dashes and blanks."""
    return F.coalesce(c, F.lit("")).rlike(r"^[\s\-–—.]*$")


def wealth_totals(c: Column) -> Column:
    """``land, buildings, vehicles, debts, own_income, counties, first_year`` of a whole wealth declaration."""
    part = {k: section(c, SECTIONS[k], SECTIONS[k + 1 :]) for k in (0, 1, 4, 6)}
    land = bound(part[0], lambda x: properties(section(x, "1. Terenuri", ["2. Clădiri", "2. Cladiri"]), False))
    buildings = bound(part[0], lambda x: properties(F.concat(section(x, "2. Clădiri", []), section(x, "2. Cladiri", [])), True))
    area = lambda rows: F.aggregate(F.transform(rows, lambda x: x["owned"]), F.lit(0.0), lambda a, b: a + b)

    def totals(x: Column) -> Column:
        both = F.concat(x["land"], x["buildings"])
        return F.struct(
            area(x["land"]).alias("land"),
            area(x["buildings"]).alias("buildings"),
            x["vehicles"].alias("vehicles"),
            x["debts"].alias("debts"),
            x["own_income"].alias("own_income"),
            F.size(F.array_distinct(F.filter(F.transform(both, lambda r: r["county"]), lambda r: r.isNotNull()))).alias("counties"),
            F.array_min(F.transform(both, lambda r: r["year"])).alias("first_year"),
        )

    held = F.struct(land.alias("land"), buildings.alias("buildings"), F.size(vehicles(part[1])).alias("vehicles"), scan_amounts(part[4]).alias("debts"), own_income(part[6]).alias("own_income"))
    return bound(held, totals)


def accounts(c: Column) -> Column:
    """Rows of the section of accounts: ``bank, kind, currency, year, balance`` in RON, for each currency, year and balance.

    The bank is the last line before that ends with a comma and isn't about a
    kind of account; kind is told by the 200 characters before. Amounts above 100
    before their currency follow, without bank, kind and year.
    """
    every = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), AMOUNT_AFTER, "\u0001$0\u0001"), "\u0001")

    def around(i: Column, parts: Column) -> Column:
        text = F.try_element_at(parts, i + 1)
        before = F.substring(F.array_join(F.slice(parts, F.lit(1), i), ""), -300, 300)
        return F.struct(text.alias("text"), before.alias("before"), F.lower(F.substring(before, -200, 200)).alias("near"), F.upper(F.regexp_extract(text, AMOUNT_AFTER, 1)).alias("currency"))

    def row(x: Column) -> Column:
        text, near, currency = x["text"], x["near"], x["currency"]
        lines = F.transform(F.split(x["before"], "\n"), lambda s: strip(s))
        banks = F.filter(lines, lambda x: x.endswith(",") & (F.length(x) > 3) & ~x.rlike("(?i)cont|depozit|fond|echival|inclusiv"))
        value = amount(F.regexp_extract(text, AMOUNT_AFTER, 2))
        return F.struct(
            strip(F.regexp_replace(F.try_element_at(banks, F.lit(-1)), ",+$", "")).alias("bank"),
            F.when(near.rlike("fond|pensii"), "fond_investitii").when(F.contains(near, F.lit("depozit")), "depozit").otherwise("cont_curent").alias("kind"),
            currency.alias("currency"),
            F.regexp_extract(text, r"\s(\d{4})\s", 1).cast("int").alias("year"),
            in_ron(value, currency).alias("balance"),
        )

    def rows(parts: Column) -> Column:
        return F.filter(F.transform(_odd(parts), lambda i: bound(around(i, parts), row)), lambda x: x["balance"] > 0)

    def plainly(n: Column, currency: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(none.alias("bank"), none.alias("kind"), F.upper(currency).alias("currency"), F.lit(None).cast("int").alias("year"), in_ron(F.when(n > 100, n), F.upper(currency)).alias("balance"))

    numbers, currencies = (F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(AMOUNT), F.lit(k)) for k in (1, 2))
    forward = F.zip_with(numbers, currencies, lambda n, cur: plainly(amount(n), cur))
    return F.concat(bound(every, rows), F.filter(forward, lambda x: x["balance"].isNotNull()))


def _odd(parts: Column) -> Column:
    """Places of the matches among parts that marks were put around."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (i % 2 == 1) & (F.size(parts) > 1))


#: How many titles are held, at the end of what stands before an amount, and kinds of investments.
TITLES = r"(?i)(\d+\s*%|\d+\s*/\s*\d+|\d+\s+parti?|\d+\s+titluri?|\d+\s+actiuni?)\s*$"
LOAN, SHARES, NO_SHARES, STAKES, BONDS = "[iî]mprumut", "acti", "parti", "par[tț]i social", "titluri|obligati|certificate"


def investments(c: Column) -> Column:
    """Rows of the section of investments: ``issuer, kind, titles, value`` in RON for each amount above 100.

    Issuer and titles stand before the amount on its line; the kind is told by
    200 characters before and 50 behind. A section of dashes has none.
    """
    every = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), AMOUNT, "\u0001$0\u0001"), "\u0001")

    def kind(words: Column) -> Column:
        return bound(words, lambda near: F.when(near.rlike(LOAN), "imprumut").when(near.rlike(SHARES) & ~near.rlike(NO_SHARES), "actiuni").when(near.rlike(STAKES), "parti_sociale").when(near.rlike(BONDS), "titluri_stat"))

    def around(i: Column, parts: Column) -> Column:
        before, after = F.array_join(F.slice(parts, F.lit(1), i), ""), F.array_join(F.slice(parts, i + 2, F.size(parts)), "")
        return F.struct(before.alias("before"), F.try_element_at(parts, i + 1).alias("found"), after.alias("after"))

    def stated(x: Column) -> Column:
        line = F.concat(F.substring_index(x["before"], "\n", -1), x["found"], F.split_part(x["after"], F.lit("\n"), F.lit(1)))
        behind = lambda y: F.length(F.call_function("substring_index", y, x["found"], F.lit(-1)))
        prefix = bound(line, lambda y: strip(F.substring(y, F.lit(1), F.length(y) - behind(y) - F.length(x["found"]))))
        number = amount(F.regexp_extract(x["found"], AMOUNT, 1))
        return bound(F.struct(number.alias("number"), prefix.alias("prefix")), lambda y: row(x, y["number"], y["prefix"]))

    def row(x: Column, number: Column, prefix: Column) -> Column:
        near = F.lower(F.concat(F.substring(x["before"], -200, 200), x["found"], F.substring(x["after"], 1, 50)))
        issuer = bound(strip(F.regexp_replace(prefix, TITLES, "")), lambda y: F.nullif(y, F.lit("")))
        return F.struct(issuer.alias("issuer"), kind(near).alias("kind"), strip(_first(prefix, TITLES)).alias("titles"), in_ron(number, F.upper(F.regexp_extract(x["found"], AMOUNT, 2))).alias("value"), number.alias("number"))

    def rows(parts: Column) -> Column:
        return F.filter(F.transform(_odd(parts), lambda i: bound(around(i, parts), stated)), lambda x: x["number"] > 100)

    return bound(every, lambda parts: F.when(F.contains(c, F.lit("- - -")), F.slice(rows(parts), F.lit(1), F.lit(0))).otherwise(rows(parts)))


def numbered_entries(c: Column, number: int) -> Column:
    """The texts of entries such as ``4.1 …``, without the empty ones."""
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"(?m)^{number}\.\d+\s+(.+)"), F.lit(1)), lambda s: strip(s))
    return F.filter(found, lambda x: ~is_blank(x))


def split_number(block: Column, joined: Column) -> Column:
    """``split, value``: whether a number breaks off at a line's end after one decimal, and what it is with the digits before the currency elsewhere."""
    piece, rest = F.regexp_extract(block, r"(?m)\b(\d{4,}\.\d)\s*$", 1), F.regexp_extract(joined, r"(?i)\b(\d{1,3})\s*RON\b", 1)
    whole = F.when((piece != "") & (rest != ""), F.concat(piece, rest).try_cast("double"))
    return F.struct((piece != "").alias("split"), F.when(whole > piece.try_cast("double"), whole).alias("value"))


#: Roles by how specific they are.
ROLES = {"presedinte": 8, "vicepresedinte": 8, "administrator": 7, "cenzor": 7, "lichidator": 7, "fondator": 7, "reprezentant legal": 6, "asociat unic": 5, "altele": 2, "asociat": 2, "membre": 1, "membrul": 1, "membru": 1}


def main_role(c: Column) -> Column:
    """The most specific role that a text names, of equally specific ones the first listed."""
    t = F.lower(c)
    found = F.filter(F.array(*[F.when(t.rlike(rf"\b{name}\b"), F.struct(F.lit(rank).alias("rank"), F.lit(-k).alias("k"), F.lit(name).alias("name"))) for k, (name, rank) in enumerate(ROLES.items())]), lambda x: x.isNotNull())
    return F.array_max(found)["name"]


# --- Whole declarations, from one index of headings. ---
#: Headings within sections, and the categories of land that have a sum of their own.
LAND_PART, BUILDING_PART, VALUABLES_PART, ACCOUNTS_PART, INVESTMENTS_PART, OTHERS_PART, OLD_INCOME = "1. Terenuri", "2. Clădiri", "2. Bunuri sub", "1. Conturi", "2. Plasamente", "3. Alte active", "Venituri ale declarantului"
AREAS = {"agricol": "farm_area", "forestier": "forest_area", "intravilan": "town_area", "luciu_apa": "water_area"}
SHORTEST = 100


def wealth_record(c: Column) -> Column:
    """A whole wealth declaration as one struct; each section is read from one index of the headings.

    ``readable`` (100 characters or more; else all sums are 0), numbers of plots
    and buildings and their rows, areas by category and share, vehicles,
    valuables, disposals, accounts, investments, debts, gifts, income of all and
    of the declarant, and what follows from them: monetary assets, net worth,
    counties, companies, plots of forest and farm land, the first year. Null is an
    empty text.
    """
    headings = [*SECTIONS, LAND_PART, BUILDING_PART, VALUABLES_PART, ACCOUNTS_PART, INVESTMENTS_PART, OTHERS_PART, OLD_INCOME]
    text = F.coalesce(c, F.lit(""))
    usable = F.when(F.length(strip(text)) >= SHORTEST, text).otherwise("")
    return bound(marker_index(usable, quoted(*headings)), lambda index: bound(_wealth_sections(index), lambda s: bound(_wealth_rows(s), lambda r: _wealth(usable, s, r))))


def _wealth_sections(index: Column) -> Column:
    """Texts of all sections that the record reads."""
    main = lambda k: part(index, SECTIONS[k], SECTIONS)
    within = lambda k, heading, ends: bound(main(k), lambda x: text_of(part(x, heading, ends)))
    income = F.nullif(text_of(main(6)), F.lit(""))
    return F.struct(
        within(0, LAND_PART, [BUILDING_PART, SECTIONS[1]]).alias("land"),
        within(0, BUILDING_PART, [SECTIONS[1]]).alias("buildings"),
        text_of(main(1)).alias("movables"),
        within(1, VALUABLES_PART, []).alias("valuables"),
        text_of(main(2)).alias("disposals"),
        within(3, ACCOUNTS_PART, [INVESTMENTS_PART, OTHERS_PART]).alias("accounts"),
        within(3, INVESTMENTS_PART, [OTHERS_PART, SECTIONS[4]]).alias("investments"),
        text_of(main(4)).alias("debts"),
        text_of(main(5)).alias("gifts"),
        F.coalesce(income, text_of(part(index, OLD_INCOME, SECTIONS))).alias("income"),
    )


def _wealth_rows(s: Column) -> Column:
    forward = F.zip_with(*[F.regexp_extract_all(s["income"], F.lit(AMOUNT), F.lit(k)) for k in (1, 2)], lambda n, cur: bound(amount(n), lambda v: F.when(v > 100, in_ron(v, cur)).otherwise(0.0)))
    disposed = F.when(F.contains(s["disposals"], F.lit("- - -")), "").otherwise(s["disposals"])
    return F.struct(
        F.concat(properties(s["land"], False), properties(s["buildings"], True)).alias("properties"),
        vehicles(s["movables"]).alias("vehicles"),
        accounts(s["accounts"]).alias("accounts"),
        investments(s["investments"]).alias("investments"),
        scan_amounts(s["valuables"]).alias("valuables"),
        F.size(F.regexp_extract_all(disposed, F.lit(r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"), F.lit(0))).alias("disposals"),
        scan_amounts(disposed).alias("disposed"),
        scan_amounts(s["debts"]).alias("debts"),
        scan_amounts(s["gifts"]).alias("gifts"),
        F.aggregate(forward, F.lit(0.0), lambda a, b: a + b).alias("income"),
        own_income(s["income"]).alias("own_income"),
    )


def _wealth(text: Column, s: Column, r: Column) -> Column:
    total = lambda rows, of: F.aggregate(F.transform(rows, of), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    land = F.filter(r["properties"], lambda x: x["kind"] == "teren")
    area = lambda which: total(F.filter(land, which), lambda x: x["owned"])
    of_category = lambda category: area(lambda x: x["category"] == category)
    areas = [of_category(category).alias(name) for category, name in AREAS.items()]
    other = area(lambda x: ~x["category"].isin(*AREAS)).alias("other_area")
    built = total(F.filter(r["properties"], lambda x: x["kind"] == "cladire"), lambda x: x["owned"]).alias("built_area")
    plots = lambda category: F.size(F.filter(r["properties"], lambda x: x["category"] == category))
    measures = lambda t: F.size(F.regexp_extract_all(t, F.lit(AREA), F.lit(0)))
    held, invested = total(r["accounts"], lambda x: x["balance"]), total(r["investments"], lambda x: x["value"])
    assets = held + invested + r["valuables"]
    return F.struct(
        (F.length(text) > 0).alias("readable"),
        measures(s["land"]).alias("plots"),
        measures(s["buildings"]).alias("buildings"),
        r["properties"].alias("properties"),
        *areas,
        other,
        built,
        total(r["properties"], lambda x: x["owned"]).alias("area"),
        F.size(r["vehicles"]).alias("vehicle_count"),
        r["vehicles"].alias("vehicles"),
        r["valuables"].alias("valuables"),
        r["disposals"].alias("disposals"),
        r["disposed"].alias("disposed"),
        r["accounts"].alias("accounts"),
        held.alias("in_accounts"),
        r["investments"].alias("investments"),
        invested.alias("invested"),
        r["debts"].alias("debts"),
        r["gifts"].alias("gifts"),
        r["income"].alias("income"),
        r["own_income"].alias("own_income"),
        assets.alias("monetary_assets"),
        (assets - r["debts"]).alias("net_worth"),
        F.size(F.array_distinct(F.filter(F.transform(r["properties"], lambda x: x["county"]), lambda x: x.isNotNull()))).alias("counties"),
        F.size(r["investments"]).alias("companies"),
        plots("forestier").alias("forest_plots"),
        plots("agricol").alias("farm_plots"),
        F.array_min(F.transform(r["properties"], lambda x: x["year"])).alias("first_year"),
    )
