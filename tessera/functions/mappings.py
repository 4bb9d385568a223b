"""Labels to categories: ordered rules as data, applied as column expressions; the first that fits counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, comma_below, fold

# --- Fixed values: what labels contain, and their categories, in order of precedence. ---
PARTIES = [
    ("social democrat", "PSD"), ("national liberal", "PNL"), ("salvati romania", "USR"), ("unirea romanilor", "AUR"), (" aur", "AUR"), ("aur ", "AUR"),
    ("democrata maghiara", "UDMR"), ("sos", "SOS"), ("s.o.s", "SOS"), ("oamenilor tineri", "POT"), (" pot", "POT"), ("pot ", "POT"),
    ("deputati neafiliat", "Neafiliat"), ("neafiliat", "Neafiliat"), ("minoritat", "Minorități"),
]
COMMITTEES = [
    ("juridic", "juridica"), ("constituționalitate", "constitutionalitate"), ("buget", "buget_finante"), ("muncă", "munca"), ("sănătate", "sanatate"),
    ("învățământ", "invatamant"), ("economică", "economica"), ("industrii", "industrii"), ("agricultură", "agricultura"), ("mediu", "mediu"),
    ("transporturi", "transporturi"), ("apărare", "aparare"), ("politică externă", "politica_externa"), ("administrație publică", "administratie_publica"),
    ("drepturile omului", "drepturile_omului"), ("egalitate", "egalitate"), ("tineretul", "tineret"), ("cultură", "cultura"),
    ("tehnologia informației", "it_comunicatii"), ("știință", "stiinta"), ("violenței domestice", "violenta_domestica"), ("specială comună", "speciala_comuna"),
]
VOTES = {"DA": "yes", "NU": "no", "AB": "abstain", "-": "not_voting"}
LABELS = {
    "vote": {"yes": "Pentru", "no": "Contra", "abstain": "Abținere", "absent": "Absent", "not_voting": "Nu a votat"},
    "status": {"promulgat": "Promulgat", "respins": "Respins", "adoptat": "Adoptat", "in_lucru": "În lucru", "retras": "Retras"},
    "committee": {"permanenta": "Permanentă", "speciala": "Specială", "speciala_comuna": "Specială comună"},
    "bill": {"propunere_legislativa": "PL", "proiect_lege": "PLG"},
}
UNAFFILIATED, UNKNOWN = "Neafiliat", "Necunoscut"


def first_contained(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The category of the first text that is contained; null stays null."""

    def of(x: Column) -> Column:
        out = F.lit(otherwise)
        for part, label in reversed(rules):
            out = F.when(F.contains(x, F.lit(part)), label).otherwise(out)
        return F.when(x.isNotNull(), out)

    return bound(c, of)


def matching_case(c: Column) -> Column:
    """Lower case without the marks of Romanian letters; other characters stay (so does an s with a comma below)."""
    return F.lower(F.translate(c, "ăâîțţşĂÂÎȚŢŞ", "aaittsAAITTS"))


def party_code(label: Column) -> Column:
    """Party of a group's name, else ``Altul``."""
    return first_contained(matching_case(label), PARTIES, "Altul")


def group_code(raw: Column) -> Column:
    """Party of a group as scraped: marks of the next field go; what no rule names is its first word."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[:;,]+", " "), r"(?i)\bDestinatar[ie]?\b", ""), r"\s+", " "))
    return bound(F.struct(clean.alias("clean"), F.lower(fold(clean)).alias("t")), lambda x: _group_of(x["clean"], x["t"]))


def _group_of(clean: Column, t: Column) -> Column:
    has = lambda *parts: F.lit(False) if not parts else F.contains(t, F.lit(parts[0])) | has(*parts[1:])
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", UNAFFILIATED)
        .when(has("fara adeziune", "fara grup"), UNAFFILIATED)
        .when(has("social democrat") | (t == "psd"), "PSD")
        .when(has("national liberal") | (t == "pnl"), "PNL")
        .when(has("salvati romania") | (t == "usr"), "USR")
        .when(has("alianta pentru unirea") | (t == "aur"), "AUR")
        .when(has("democrata maghiara") | (t == "udmr"), "UDMR")
        .when(has("s.o.s") | t.startswith("sos"), "S.O.S.")
        .when(has("oamenilor tineri") | (t == "pot"), "POT")
        .when(has("minorit"), "Minorități")
        .when(has("neafiliat"), UNAFFILIATED)
        .otherwise(F.split_part(clean, F.lit(" "), F.lit(1)))
    )


def short_party(label: Column, limit: int = 8) -> Column:
    """As the pages show it: a known party, else the first run of capitals, else the first characters."""
    known = first_contained(F.lower(fold(label)), PARTIES)
    return F.coalesce(known, F.nullif(F.regexp_extract(label, r"\b([A-ZĂÂÎȘȚ]{2,})\b", 1), F.lit("")), F.substring(label, 1, limit))


def clean_group(raw: Column) -> Column:
    """A group's name without what trails it; the unaffiliated, the empty and null are one group."""
    g = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s*Destinatari?:?\s*$", ""), r"\s*Textul\s*$", "")
    g = F.trim(F.regexp_replace(g, "Neafilia[ţț]i", UNAFFILIATED))
    return F.coalesce(F.nullif(g, F.lit("")), F.lit(UNAFFILIATED))


def clean_destination(raw: Column, limit: int = 70) -> Column:
    """The ministry or body that a question goes to, else the first characters."""
    body = F.regexp_extract(raw, r"^(Ministerul [^î(]+?|Guvernul României|Preşedinţia|Curtea [^î]+?)(?:\s+în atenţia|\s+\(|$)", 1)
    return F.when(F.coalesce(raw, F.lit("")) == "", UNKNOWN).when(body != "", F.trim(body)).otherwise(F.trim(F.substring(raw, 1, limit)))


def initiator_parties(c: Column) -> Column:
    """Parties whose members started a bill, each once; the government alone if it is named."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:deputati|senatori)\s+-\s+([A-ZĂÎȘŢŞȚRO ]{2,20}):"), F.lit(1)), lambda s: F.trim(s)))
    none = F.array(F.lit("Neidentificat"))
    return F.when(F.coalesce(c, F.lit("")) == "", none).when(F.contains(c, F.lit("Guvern")), F.array(F.lit("Guvern"))).otherwise(F.when(F.size(found) > 0, found).otherwise(none))


def bill_status(law: Column, stage: Column, *adopted: Column) -> Column:
    """Promulgated if it has a law number, else rejected by its stage, else adopted by a date, else in progress."""
    s = F.coalesce(F.lower(stage), F.lit(""))
    return F.when(F.coalesce(law.cast("string"), F.lit("")) != "", "promulgat").when(s.rlike("respinge|încetat|incetat"), "respins").when(F.coalesce(*adopted).isNotNull(), "adoptat").otherwise("in_lucru")


def bill_status_facet(law: Column, stage: Column) -> Column:
    """Status as the search knows it."""
    s = F.coalesce(F.lower(stage), F.lit(""))
    return F.when(F.coalesce(law.cast("string"), F.lit("")) != "", "promulgat").when(F.contains(s, F.lit("respins")), "respins").when(F.contains(s, F.lit("retras")), "retras").otherwise("în lucru")


def bill_type(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.startswith("proiect"), "proiect_lege").when(t.startswith("propunere"), "propunere_legislativa").when(t.rlike("ordonanță de urgență|ordonanta de urgenta|oug"), "oug").when(t.rlike("ordonanța|ordonanta"), "og").otherwise("other")


def law_character(c: Column) -> Column:
    return F.when(c.rlike("(?i)organic"), "organic").when(c.rlike("(?i)ordinar"), "ordinar").otherwise("other")


def motion_type(c: Column) -> Column:
    return F.when(c.rlike("(?i)cenzur"), "cenzura").when(c.rlike("(?i)simpl"), "simpla").otherwise("other")


def motion_outcome(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "in_procedura").when(c.rlike("(?i)respins"), "respinsa").when(c.rlike("(?i)adoptat"), "adoptata").when(c.rlike("(?i)retras"), "retrasa").otherwise("other")


def sanction(c: Column) -> Column:
    """``kind, percent, months, gender`` of a sanction's text."""
    cut = r"(?iu)diminuarea.*?(\d+)\s*%.*?(\d+)\s+lun"
    percent, months = (F.regexp_extract(c, cut, k).try_cast("int") for k in (1, 2))
    t = F.lower(c)
    kind = F.when(percent.isNotNull(), "diminuare_indemnizatie").when(F.contains(t, F.lit("avertisment")), "avertisment_scris").when(t.rlike("(?s)chemar.*ordine|ordine.*chemar"), "chemare_ordine").when(t.rlike("(?s)retragere.*cuv|cuv.*retragere"), "retragere_cuvant").otherwise("other")
    gender = F.when(t.rlike(r"\bdoamnei\b|\bdoamna\b"), "F").when(t.rlike(r"\bdomnului\b|\bdomnul\b"), "M")
    return F.struct(kind.alias("kind"), percent.alias("percent"), months.alias("months"), gender.alias("gender"))


def committee_document(c: Column) -> Column:
    t = F.upper(c)
    return F.when(F.contains(t, F.lit("RAPORT")), "raport").when(F.contains(t, F.lit("AVIZ")), "aviz").when(t.rlike("SINTEZ[AĂ]"), "sinteza").when(t.rlike("PROCES(UL)? VERBAL|PROCES-VERBAL"), "proces_verbal").otherwise("other")


def vote_option(symbol: Column) -> Column:
    """Option of a vote's symbol; an unknown one counts as not voting."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VOTES.items() for x in kv]), symbol), F.lit("not_voting"))


def elected_gender(c: Column) -> Column:
    """Gender from the form of the word for elected."""
    return F.when(c.rlike(r"(?i)\baleasa\b"), "F").when(c.rlike(r"(?i)\bales\b"), "M")


def committee_slug(name: Column) -> Column:
    return first_contained(comma_below(F.lower(name)), COMMITTEES)


def threshold_bin(rate: Column, high: float, middle: float) -> Column:
    return F.when(rate >= high, "high").when(rate >= middle, "middle").when(rate.isNotNull(), "low")


def display_label(code: Column, kind: str) -> Column:
    """How a code is shown; one without a label is shown as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS[kind].items() for x in kv]), code), code)


def site_map_party(label: Column) -> Column:
    """Party as the site map tells it: marks aren't folded, so names with a cedilla match no rule."""
    return first_contained(F.lower(label), PARTIES)
