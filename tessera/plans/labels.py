"""Queries of text, date and label functions, over texts that are rendered from the columns of a table, each read back to what the columns say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, declarations, fields, mappings, text
from tessera.plans.base import query, t
from tessera.sources import records


def read_back(name: str, table: str, key: str, rendered: str, of: Callable[[Column], Column], expected: str) -> None:
    """Register a query ``key, out`` of what a function reads in a rendered text, and the SQL of what the columns say."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return t(spark, d, table).select(key, F.expr(rendered).alias("text")).select(key, of(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT {key}, {expected} AS out FROM {table}")(run)


def pick(by: str, *values: str | None) -> str:
    """One of some SQL expressions by a number."""
    n = len(values)
    return f"CASE {by} % {n} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)) + " END"


def joined(*parts: Column) -> Column:
    """Columns as one text; null as a hyphen."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


O, C, S = "o_orderkey", "c_custkey", "l_suppkey"
Y, M, D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
M2, D2 = (f"lpad(CAST({x} AS string), 2, '0')" for x in (M, D))
ISO = f"concat({Y}, '-', {M2}, '-', {D2})"

# --- normalisation --------------------------------------------------------------------

read_back("fold_letters", "customer", C, pick(C, "concat('Ștefan Țuțea ŞŢ ', c_name)", "concat('Kovács Győző ', c_mktsegment)", "concat(c_name, ' Ødegård ß Černý')", None, "''"), text.fold, pick(C, "'Stefan Tutea ST ' || c_name", "'Kovacs Gyozo ' || c_mktsegment", "c_name || ' degard  Cerny'", None, "''"))
read_back("cedilla_to_comma", "customer", C, pick(C, "concat('Şedinţă ş ţ Ţ ', c_name)", "c_mktsegment", None), text.comma_below, pick(C, "'Ședință ș ț Ț ' || c_name", "c_mktsegment", None))
read_back("matching_case", "customer", C, pick(C, "concat('ŢARĂ Înaltă ', c_mktsegment)", "concat('Ș rămâne ', c_name)", None), mappings.matching_case, pick(C, "'tara inalta ' || lower(c_mktsegment)", "'ș ramane ' || lower(c_name)", None))
read_back(
    "basic_markup", "orders", O,
    pick(O, "concat('<P><B>', o_orderkey, '</B><BR/><i> </i>text <a href=x>', o_orderpriority, '</a></P>')", "concat('<br><br>', o_orderkey, repeat('<br>', CAST(o_orderkey % 5 AS INT)), o_orderstatus, '<br> <br/>')", "'  '", None, "concat('<i class=k>', o_orderpriority, '</I><b></b>')"),
    text.basic_markup,
    pick(O, "'<b>' || o_orderkey || '</b><br/>text ' || o_orderpriority", "o_orderkey || repeat('<br>', least(CASE WHEN o_orderkey % 5 > 2 THEN 2 ELSE o_orderkey % 5 END, 2)::INT) || o_orderstatus", "''", None, "o_orderpriority || '</i>'"),
)
read_back("committee_names", "part", "p_partkey", pick("p_partkey", "concat('Comisia  ', p_name, ' (din feb. 20', p_size % 90 + 10, ')')", "concat('Comisia ', p_brand, ' (până în sep. 2025) Alte comisii')", "concat('Comisia ', p_brand, ' (comună)')", None), text.committee_name, pick("p_partkey", "'Comisia ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g'))", "'Comisia ' || p_brand", "'Comisia ' || p_brand || ' (comună)'", None))
_V = "CAST(floor(o_totalprice) AS BIGINT)"
_TH, _REST = f"CAST(floor({_V} / 1000) AS BIGINT)", f"lpad(CAST({_V} % 1000 AS string), 3, '0')"
read_back(
    "parse_amount", "orders", O,
    pick(O, f"CAST({_V} AS string)", f"concat({_TH}, '.', {_REST})", f"concat({_TH}, '.', {_REST}, ',56')", f"concat({_TH}, ',', {_REST}, '.5')", f"concat({_TH}, ' ', {_REST})", f"concat({_V}, ',5')", f"concat({_TH}, ',', {_REST})", f"concat({_V}, '.25')", f"concat({_V}, 'x')", None, f"concat('1.', {_TH} % 10, '.', {_REST})"),
    text.amount,
    pick(O, f"{_V}::DOUBLE", f"{_V}::DOUBLE", f"{_V} + 0.56::DOUBLE", f"{_V} + 0.5::DOUBLE", f"{_V}::DOUBLE", f"{_V} + 0.5::DOUBLE", f"{_V}::DOUBLE", f"{_V} + 0.25::DOUBLE", None, None, f"(('1' || ({_TH} % 10) || {_REST})::DOUBLE)"),
)
read_back("ownership_fraction", "orders", O, pick(O, f"concat({M}, '/', {D})", "'1/0'", "concat(o_orderstatus, '/2')", None, f"concat(' 3 / ', {D})"), lambda c: F.round(text.fraction(c), 9), pick(O, f"round({M}::DOUBLE / {D}, 9)", "1.0::DOUBLE", "1.0::DOUBLE", "1.0::DOUBLE", f"round(3::DOUBLE / {D}, 9)"))
read_back("tolerant_lookup", "orders", O, pick(O, "concat('INIŢIATOR=', o_custkey, ';Stadiu=B')", "concat('initiator=;Inițiatori.=', o_orderkey)", "concat('x=', o_custkey)", "concat('iniţiator =a;Stadiu=c;Initiator=', o_orderpriority)"), lambda c: text.tolerant_lookup(F.str_to_map(c, F.lit(";"), F.lit("=")), "Inițiator:", "initiatori"), pick(O, "CAST(o_custkey AS VARCHAR)", "CAST(o_orderkey AS VARCHAR)", None, "o_orderpriority"))

# --- dates and numbers ----------------------------------------------------------------

read_back("day_first_date", "orders", O, pick(O, f"concat({D}, '.', {M}, '.', {Y})", f"concat({D2}, '-', {M2}, '-', {Y}, ' 10:00')", f"concat(' ', {D}, '/', {M2}, '/', {Y})", ISO, f"concat('31.02.', {Y})", None, "o_orderpriority"), lambda c: dates.day_first_date(c).cast("string"), pick(O, *[f"CAST(o_orderdate::DATE AS VARCHAR)"] * 3, None, None, None, None))
read_back("short_year_date", "orders", O, pick(O, f"concat({D}, '.', {M}, '.', lpad(CAST({Y} % 100 AS string), 2, '0'))", f"concat({D2}, '.', {M2}, '.', {Y})", f"concat({D}, '.', {M}, '.', lpad(CAST({Y} % 100 AS string), 2, '0'), '1')"), lambda c: dates.day_first_date(c, True).cast("string"), pick(O, f"'20' || lpad(CAST({Y} % 100 AS VARCHAR), 2, '0') || strftime(o_orderdate, '-%m-%d')", "CAST(o_orderdate::DATE AS VARCHAR)", "NULL"))
_MONTH = pick(f"({M} - 1)", "'ian.'", "'Februarie'", "'mart.'", "'apr'", "'MAI'", "'iunie'", "'iul.'", "'august'", "'sept.'", "'Octombrie'", "'nov.'", "'dec.'")
_NAME = pick(f"({M} - 1)", "'ianuarie'", "'februarie'", "'martie'", "'Aprilie'", "'mai'", "'iunie'", "'iulie'", "'august'", "'septembrie'", "'octombrie'", "'noiembrie'", "'decembrie'")
read_back("named_month_date", "orders", O, pick(O, f"concat('n. ', {D}, ' ', {_MONTH}, ' ', {Y}, ' la ', o_orderpriority)", f"concat({D}, ' ', {_NAME}, ' ', {Y}, ' și 1 mai 1900')", f"concat('31 feb. ', {Y})", "concat('1 foo ', o_orderkey)", None), lambda c: dates.named_month_date(c).cast("string"), pick(O, "CAST(o_orderdate::DATE AS VARCHAR)", "CAST(o_orderdate::DATE AS VARCHAR)", None, None, None))
_NEXT = f"least({D} + o_custkey % 3, 28)"
read_back("title_dates", "orders", O, pick(O, f"concat('Ordinea de zi din {{0}} ', {_NAME}, ' ', {Y})".replace("{0}", f"', least({D}, 28), ' - ', {_NEXT}, '"), f"concat('din ', {D}, ' ', {_NAME}, ' ', {Y})", f"concat('30–31 februarie ', {Y})", "o_orderpriority"), lambda c: joined(dates.title_dates(c)["start"], dates.title_dates(c)["end"]), pick(O, f"CAST(make_date({Y}, {M}, least({D}, 28)) AS VARCHAR) || '|' || CAST(make_date({Y}, {M}, {_NEXT}) AS VARCHAR)", "CAST(o_orderdate::DATE AS VARCHAR) || '|-'", "'-|-'", "'-|-'"))
read_back("iso_instant", "orders", O, pick(O, ISO, f"concat({ISO}, 'T10:00:00+02:00')", f"concat({ISO}, 'T10:00:00Z')", "o_orderpriority", f"concat({Y}, '-13-01')", None), lambda c: F.date_format(dates.iso_instant(c), "yyyy-MM-dd HH:mm:ss"), pick(O, "strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00'", "strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00'", "strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00'", None, None, None))
read_back("vote_instant", "orders", O, pick(O, f"concat({D2}, '.', {M2}, '.', {Y}, ' ', o_custkey % 24, ':05:09')", f"concat({D}, '.', {M}, '.', {Y}, ' ', lpad(CAST(o_custkey % 24 AS string), 2, '0'), ':45')", "o_orderpriority"), lambda c: F.date_format(dates.vote_instant(c), "yyyy-MM-dd HH:mm:ss"), pick(O, "strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':05:09'", "strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':45:00'", None))
read_back("bill_key", "orders", O, pick(O, f"concat('PL-x ', o_custkey % 9000, '/', {Y}, ' privind')", f"concat('nr. ', o_orderkey % 10, '/', {Y})", f"concat('x', 10000 + o_custkey, '/', {Y}, '/7')", None), text.bill_key, pick(O, f"CASE WHEN o_custkey % 9000 > 9 THEN (o_custkey % 9000) || '/' || {Y} END", None, f"right(CAST(10000 + o_custkey AS VARCHAR), 4) || '/' || {Y}", None))
read_back("bill_reference", "orders", O, pick(O, f"concat('vot final PL-x ', o_custkey, '/', {Y})", f"concat('PHCD nr. ', o_custkey, '/', {Y}, ' art. 2')", f"concat('Pl ', o_custkey, '/', {Y}, ' PH CD 1/2000')", "o_orderpriority", f"concat('ph cd', o_custkey, '/', {Y})", None), lambda c: joined(text.bill_reference(c)["kind"], text.bill_reference(c)["nr"]), pick(O, f"'PL|' || o_custkey || '/' || {Y}", f"'PHCD|' || o_custkey || '/' || {Y}", f"'PL|' || o_custkey || '/' || {Y}", "'-|-'", f"'PHCD|' || o_custkey || '/' || {Y}", "'-|-'"))
read_back("currency_sum", "orders", O, pick(O, f"concat({_V}, ' EUR')", f"concat('100 RON și ', {_TH}, '.', {_REST}, ' lei')", f"concat('EUR 2019 ', {_V}, ' x')", f"concat({_TH}, '.', {_REST}, ',5 USD')", "o_orderpriority", f"concat('99 EUR ', {_V}, ' CHF')"), lambda c: F.round(declarations.scan_amounts(c), 2), pick(O, f"round({_V} * 5.05::DOUBLE, 2)", f"{_V}::DOUBLE", f"round({_V} * 5.05::DOUBLE, 2)", f"round(({_V} + 0.5) * 4.5::DOUBLE, 2)", "0.0::DOUBLE", f"round({_V} * 5.4::DOUBLE, 2)"))

# --- labels ---------------------------------------------------------------------------

_SEG = "lower(c_mktsegment)"
read_back("party_code", "customer", C, pick(C, "concat('Grupul parlamentar al Partidului Social Democrat ', c_custkey)", "concat(c_mktsegment, ' Naţional Liberal')", "'Uniunea Salvaţi România'", "concat('Alianţa pentru Unirea Românilor', c_custkey)", "concat(c_custkey, ' SOS')", "'DEPUTAŢI NEAFILIAŢI'", "'Minorităţi naţionale'", "concat('Alt ', c_mktsegment)", None), mappings.party_code, pick(C, "'PSD'", "'PNL'", "'USR'", "'AUR'", "'SOS'", "'Neafiliat'", "'Minorități'", "'Altul'", None))
read_back("site_map_party", "customer", C, pick(C, "concat('Partidul Social Democrat ', c_name)", "concat('Uniunea Salvaţi România ', c_custkey)", None), mappings.site_map_party, pick(C, "'PSD'", None, None))
read_back("group_code", "customer", C, pick(C, "'AUR Destinatar'", "'Neafiliaţi Destinatari'", "concat('Partidul Social Democrat: ', c_custkey)", "concat('fără grup ', c_custkey)", "'SOS România'", "concat(c_mktsegment, ' Dreptei; ', c_custkey)", "''", None, "'psd'"), mappings.group_code, pick(C, "'AUR'", "'Neafiliat'", "'PSD'", "'Neafiliat'", "'S.O.S.'", "c_mktsegment", "'Neafiliat'", "'Neafiliat'", "'PSD'"))
read_back("short_party", "customer", C, pick(C, "concat('Partidul Social Democrat ', c_custkey)", "concat('Grupul XYZ', chr(65 + CAST(c_custkey % 26 AS INT)), ' nou')", "concat('x', c_custkey, 'necunoscut')"), mappings.short_party, pick(C, "'PSD'", "'XYZ' || chr(CAST(65 + c_custkey % 26 AS INT))", "left('x' || c_custkey || 'necunoscut', 8)"))
read_back("clean_group", "customer", C, pick(C, "concat(c_mktsegment, ' Destinatari:')", "'Neafiliaţi Textul'", "'  '", None, "concat(' G', c_custkey, '  Textul ')"), mappings.clean_group, pick(C, "c_mktsegment", "'Neafiliat'", "'Neafiliat'", "'Neafiliat'", "'G' || c_custkey"))
read_back("clean_destination", "customer", C, pick(C, "concat('Ministerul ', c_mktsegment, ' în atenţia domnului ', c_name)", "'Guvernul României (SGG)'", "concat('Curtea de ', c_mktsegment)", "concat('Agenţia ', repeat('x', CAST(c_custkey % 100 AS INT)))", "''", None), mappings.clean_destination, pick(C, "'Ministerul ' || c_mktsegment", "'Guvernul României'", "'Curtea de ' || c_mktsegment", "'Agenţia' || CASE WHEN c_custkey % 100 > 0 THEN ' ' || repeat('x', least(c_custkey % 100, 62)::INT) ELSE '' END", "'Necunoscut'", "'Necunoscut'"))
read_back("initiator_parties", "customer", C, pick(C, "concat(c_custkey, ' deputati - PSD: A, B; 3 senatori - USR: C; 1 deputati - PSD: D')", "concat('Guvern ', c_custkey)", "concat('un cetăţean ', c_name)", None, "concat(c_custkey, ' senatori - ', c_mktsegment, ': X')"), lambda c: F.array_join(mappings.initiator_parties(c), ","), pick(C, "'PSD,USR'", "'Guvern'", "'Neidentificat'", "'Neidentificat'", "c_mktsegment").replace("WHEN 4 THEN c_mktsegment", "WHEN 4 THEN CASE WHEN regexp_matches(c_mktsegment, '^[A-ZĂÎȘŢŞȚRO ]{2,20}$') THEN c_mktsegment ELSE 'Neidentificat' END"))
read_back("bill_type", "orders", O, pick(O, "concat('Proiect de Lege ', o_orderkey)", "'PROPUNERE legislativă'", "concat('Aprobarea ordonanta de urgenta ', o_orderkey)", "concat(o_orderkey, ' ordonanța')", "concat('o', o_orderpriority)", None), mappings.bill_type, pick(O, "'proiect_lege'", "'propunere_legislativa'", "'oug'", "'og'", "'other'", "'other'"))
read_back("law_character", "orders", O, pick(O, "concat(o_orderkey, ' Lege ORGANICă')", "concat('ordinară ', o_orderkey)", "o_orderpriority"), mappings.law_character, pick(O, "'organic'", "'ordinar'", "'other'"))
read_back("motion_type", "orders", O, pick(O, "concat('Moţiune de CENZURĂ ', o_orderkey)", "concat(o_orderkey, ' simplă')", "o_orderpriority"), mappings.motion_type, pick(O, "'cenzura'", "'simpla'", "'other'"))
read_back("motion_outcome", "orders", O, pick(O, "concat('Respinsă la vot: respins ', o_orderkey)", "concat(o_orderkey, ' ADOPTATĂ')", "'retras'", "''", None, "o_orderpriority"), mappings.motion_outcome, pick(O, "'respinsa'", "'adoptata'", "'retrasa'", "'in_procedura'", "'in_procedura'", "'other'"))
read_back(
    "sanction_kind", "orders", O,
    pick(O, f"concat('diminuarea indemnizaţiei cu ', o_custkey % 90 + 10, ' % pe ', {M}, ' luni doamnei ', o_orderkey)", "concat('Avertisment scris domnului ', o_orderkey)", "'chemarea la ordine'", "'retragerea cuvântului doamna X'", "o_orderpriority"),
    lambda c: joined(*[mappings.sanction(c)[k] for k in ("kind", "percent", "months", "gender")]),
    pick(O, f"'diminuare_indemnizatie|' || (o_custkey % 90 + 10) || '|' || {M} || '|F'", "'avertisment_scris|-|-|M'", "'chemare_ordine|-|-|-'", "'retragere_cuvant|-|-|F'", "'other|-|-|-'"),
)
read_back("committee_document", "orders", O, pick(O, "concat('Raport asupra ', o_orderkey)", "concat(o_orderkey, ' aviz')", "'Sinteză'", "'proces-verbal'", "concat('Procesul verbal ', o_orderkey)", "'x'"), mappings.committee_document, pick(O, "'raport'", "'aviz'", "'sinteza'", "'proces_verbal'", "'proces_verbal'", "'other'"))
read_back("vote_option", "lineitem", S, pick(f"({S} + l_linenumber)", "'DA'", "'NU'", "'AB'", "'-'", "l_returnflag", None), mappings.vote_option, pick(f"({S} + l_linenumber)", "'yes'", "'no'", "'abstain'", "'not_voting'", "'not_voting'", "'not_voting'"))
read_back("elected_gender", "orders", O, pick(O, "concat(o_orderkey, ' aleasa deputat')", "concat('Ales deputat ', o_orderkey)", "concat('alesul ', o_orderkey)"), mappings.elected_gender, pick(O, "'F'", "'M'", None))
read_back("committee_slug", "orders", O, pick(O, "concat('Comisia juridică ', o_orderkey)", "concat('Comisia pentru muncă şi ', o_orderpriority)", "'COMISIA PENTRU POLITICĂ EXTERNĂ'", "concat('Comisia pentru ştiinţă ', o_orderkey)", "concat('Altă comisie ', o_orderkey)"), mappings.committee_slug, pick(O, "'juridica'", "'munca'", "'politica_externa'", "'stiinta'", None))


def _labels_of(kind: str, codes: dict[str, str]) -> tuple[str, str]:
    values = [*codes, "odd"]
    return pick(O, *[f"'{c}'" for c in values], None), pick(O, *[f"'{codes.get(c, c)}'" for c in values], None)


for _kind in mappings.LABELS:
    _rendered, _expected = _labels_of(_kind, mappings.LABELS[_kind])
    read_back(f"display_labels_{_kind}", "orders", O, _rendered, lambda c, k=_kind: mappings.display_label(c, k), _expected)

# --- pages and fields -----------------------------------------------------------------

read_back(
    "labelled_fields", "orders", O,
    pick(O, f"concat('Tip: ', lower(o_orderstatus), ' simpla Inițiatori: ', o_custkey, ' deputaţi Nr./Data înregistrării: ', o_orderkey, ' / ', {D2}, '-', {M2}, '-', {Y}, ' Data votului: x Voturi pentru: ', o_custkey % 300, ' Rezultat: respinsă')", "o_orderpriority", f"concat('Nr./Data înregistrării ', o_orderkey, 'a Data votului Voturi pentru: ', o_orderpriority)"),
    lambda c: joined(fields.labelled_field(c, "Tip", fields.MOTION_LABELS, 50), *[fields.number_and_day(fields.labelled_field(c, "Nr./Data înregistrării", fields.MOTION_LABELS, 100))[k] for k in ("nr", "day")], fields.leading_number(fields.labelled_field(c, "Voturi pentru", fields.MOTION_LABELS, 20))),
    pick(O, "lower(o_orderstatus) || ' simpla|' || o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || (o_custkey % 300)", "'-|-|-|-'", "'-|' || o_orderkey || 'a|-|' || regexp_extract(o_orderpriority, '^\\d+')"),
)
read_back("signatories", "orders", O, pick(O, "concat('<a href=\"/structura.mp?idm=', o_orderkey, '\"><b>Pop</b> ', o_custkey, '</a> <a href=\"/structura.mp?idm=1\">Pop ', o_custkey, '</a> <a href=\"x\">Alt Om</a> <a class=q href=\"structura.mp\">Ab</a><a href=\"structura\">', o_orderpriority, '</a>')", "o_orderpriority"), lambda c: F.array_join(fields.signatories(c, "structura"), ","), pick(O, "'Pop ' || o_custkey || ',' || o_orderpriority", "''"))


def _milestones(c: Column) -> Column:
    events = F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(2)).alias("text"), F.split_part(x, F.lit("="), F.lit(1)).try_cast("date").alias("day")))
    return text.bound(fields.milestones(events, "text", "day"), lambda m: joined(*[m["days"][k] for k in ("presented", "registered", "adopted_senate", "adopted_chamber", "promulgated")], m["deadline"], m["admitted"], m["rejected"]))


_LATER = "date_add(CAST(o_orderdate AS date), {n})"
_EVENTS = (
    f"concat_ws(';', concat({_LATER.format(n=0)}, '=Primit la Senat'), concat({_LATER.format(n=1)}, '=Înregistrat la Cameră'), concat({_LATER.format(n=2)}, '=primire raport (', o_custkey, ' amend. admise)'), concat({_LATER.format(n=3)}, '=termen depunere amendamente: ', {D2}, '.', {M2}, '.', {Y} + 1, ', ora 16'), "
    f"CASE WHEN o_orderkey % 2 = 0 THEN concat({_LATER.format(n=4)}, '=adoptat de Senat') END, CASE WHEN o_orderstatus = 'F' THEN concat({_LATER.format(n=5)}, '=Adoptat de Camera Deputaţilor') END, CASE WHEN o_orderstatus = 'O' THEN concat({_LATER.format(n=6)}, '=Adoptat în ședință comună') END, concat({_LATER.format(n=7)}, '=promulgat'), concat({_LATER.format(n=8)}, '=promulgat'))"
)
_DAY = "CAST((o_orderdate + INTERVAL {n} DAY)::DATE AS VARCHAR)"
read_back(
    "bill_milestones", "orders", O, _EVENTS, _milestones,
    f"concat_ws('|', {_DAY.format(n=0)}, {_DAY.format(n=1)}, CASE WHEN o_orderkey % 2 = 0 THEN {_DAY.format(n=4)} WHEN o_orderstatus = 'O' THEN {_DAY.format(n=6)} ELSE '-' END, CASE o_orderstatus WHEN 'F' THEN {_DAY.format(n=5)} WHEN 'O' THEN {_DAY.format(n=6)} ELSE '-' END, {_DAY.format(n=7)}, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN '-' ELSE CAST(year(o_orderdate) + 1 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') END, o_custkey, '-')",
)
read_back("nominal_vote_rows", "orders", O, pick(O, "concat('<table><tr><td>1.</td><td>Pop ', o_custkey, '</td><td>PSD</td><td>', CASE o_orderstatus WHEN 'F' THEN 'DA' WHEN 'O' THEN 'NU' ELSE '?' END, '</td></tr><tr><td>#</td><td>Nume</td><td>Grup</td><td>Vot</td></tr><tr><td>2.</td><td>Dan &amp; Ana</td><td>', o_orderpriority, '</td><td>AB</td></tr></table>')", "concat('<p>', o_orderpriority)"), lambda c: F.array_join(F.transform(records.nominal_votes(c), lambda v: F.concat_ws("/", v["name"], v["party"], mappings.vote_option(v["symbol"]))), ","), pick(O, "'Pop ' || o_custkey || '/PSD/' || CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'not_voting' END || ',Dan & Ana/' || o_orderpriority || '/abstain'", "''"))
read_back("label_table", "orders", O, pick(O, "concat('<tr><td bgcolor=\"#fff0d8\">- Stadiu:</td><td>la <b>', o_orderpriority, '</b></td></tr><tr><td bgcolor=fff0d8>Nr. </td><td>', o_orderkey, '</td></tr><tr><td bgcolor=\"#FFF0D8\">Gol</td><td> </td></tr>')", "o_orderpriority"), lambda c: F.array_join(F.transform(F.map_entries(records.label_table(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), pick(O, "'Stadiu=la ' || o_orderpriority || ',Nr=' || o_orderkey", "''"))
read_back("listed_page_ids", "orders", O, "concat('<a href=\"d?idm=', o_orderkey, '\"><a href=\"d?idm=', o_custkey, '\"><a href=\"d?idm=', o_orderkey, '\"><a href=\"d?idp=5\">')", lambda c: F.array_join(records.listed_ids(c, r"idm=(\d+)").cast("array<string>"), ","), "o_orderkey || CASE WHEN o_custkey <> o_orderkey THEN ',' || o_custkey ELSE '' END")
read_back("linked_pdf_files", "orders", O, pick(O, f"concat('<tr><td><a href=\"/', o_orderkey, '.pdf\">x</a></td><td><a>', {D2}, '.', {M2}, '.', {Y}, '</a></td></tr><tr><td><a href=\"/', o_orderkey, '.pdf\">y</a></td></tr><tr><td><a href=\"http://y.org/b.pdf\">z</a></td></tr>')", "o_orderpriority"), lambda c: F.array_join(F.transform(records.linked_files(c, "https://x.org"), lambda f: F.concat_ws(" ", f["url"], f["day"].cast("string"))), ","), pick(O, "'https://x.org/' || o_orderkey || '.pdf ' || strftime(o_orderdate, '%Y-%m-%d') || ',http://y.org/b.pdf'", "''"))
read_back("session_day_list", "orders", O, f"concat(',', {Y}, {M2}, {D2}, ',20260525,', {Y}, {M2}, {D2}, ',19970399,1997031', o_custkey % 10, ',')", lambda c: F.array_join(records.session_days(c, 1997, 3).cast("array<string>"), ","), "array_to_string(list_sort(list_distinct(list_filter([strftime(o_orderdate, '%Y-%m-%d'), '1997-03-1' || (o_custkey % 10)], lambda x: left(x, 7) = '1997-03'))), ',')")
