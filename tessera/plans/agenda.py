"""Queries of agenda entities, rules and group histories, over texts that are rendered from rows of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import entities, rules
from tessera.functions.text import bound, strip_html
from tessera.operators import facets
from tessera.plans.base import query, t
from tessera.plans.rendered import derived, plain

#: An order is an agenda item: its form, whether it has each of some marks, and what it is about.
AGENDA_ROWS = """
SELECT *, CASE form WHEN 0 THEN 'proiect_lege' WHEN 1 THEN 'proiect_lege' WHEN 2 THEN 'propunere_legislativa' WHEN 3 THEN 'proiect_hotarare' WHEN 4 THEN 'motiune_simpla' WHEN 5 THEN 'dezbateri_politice' WHEN 6 THEN 'informare_casete' WHEN 7 THEN 'raport' WHEN 8 THEN 'alegere' END AS kind FROM (
  SELECT o_orderkey AS o, o_orderkey % 10 AS form, CAST(floor(o_orderkey / 10) AS BIGINT) AS k, o_custkey % 300 + 1 AS nr, year(o_orderdate) AS y, month(o_orderdate) AS mm, day(o_orderdate) AS dd,
    o_custkey % 2 = 0 AS urgent, o_custkey % 3 = 0 AS decisive, o_custkey % 5 = 0 AS secret, o_orderstatus = 'F' AS organic, o_orderstatus = 'O' AS ordinary, concat('domeniul ', o_orderkey) AS topic FROM {orders}
)
"""
AGENDA_TEXT = """
CASE form
  WHEN 0 THEN concat('<b>Proiectul de Lege</b> pentru ', CASE k % 3 WHEN 0 THEN 'modificarea şi completarea' WHEN 1 THEN 'modificarea' ELSE 'completarea' END, ' Legii nr.', nr, '/', y, ' privind ', topic, ' (PL-x ', o, '/', y, ')', CASE WHEN organic THEN ' - lege organică' WHEN ordinary THEN ' - Lege  ordinara' ELSE '' END)
  WHEN 1 THEN concat('Proiectul Legii privind aprobarea ', CASE WHEN k % 2 = 0 THEN 'Ordonanţei de urgenţă a Guvernului nr.' ELSE 'Ordonanței Guvernului nr.' END, nr, '/', y, ' pentru ', topic, ' <i>(PL-x ', o, '/', y, ')</i>.')
  WHEN 2 THEN concat('PROPUNEREA LEGISLATIVĂ privind ', topic, '.')
  WHEN 3 THEN concat('Proiectul de Hotărâre privind constituirea unei comisii, ', topic, '<br/>Decizia Curţii Constituţionale nr.', nr, ', Legea nr.', nr, '/', y, ', Legea nr.', nr, '/', y)
  WHEN 4 THEN concat('Dezbaterea moţiunii simple cu tema ', topic, ', iniţiat', CASE WHEN k % 2 = 0 THEN 'ă' ELSE 'e' END, ' de ', nr, ' de ', CASE k % 3 WHEN 0 THEN 'deputaţi' WHEN 1 THEN 'senatori' ELSE 'deputaţi şi senatori' END)
  WHEN 5 THEN concat('  - Dezbateri politice la solicitarea Grupului parlamentar USR', k % 4, ', cu tema ', topic)
  WHEN 6 THEN 'Informare privind distribuirea unor documente în casete'
  WHEN 7 THEN concat('Raportul ', CASE k % 4 WHEN 0 THEN 'Curţii, Curtea de Conturi' WHEN 1 THEN 'Băncii Naționale a României' WHEN 2 THEN 'ANPC şi al Consiliului Economic și Social European' ELSE 'Parlamentului European' END, ' ', topic)
  WHEN 8 THEN concat('Alegerea unui vicepreşedinte, ', topic)
  ELSE concat('Altele: ', topic) END"""
#: Lines below an item: marks, a report with its committees, an adoption.
AGENDA_MARKS = """
concat(CASE WHEN urgent THEN '<br>Procedură de urgenţă' ELSE '' END, CASE WHEN decisive THEN '<BR>CAMERA decizională' ELSE '' END, CASE WHEN secret THEN '<br>Vot secret cu bile' ELSE '' END,
  CASE WHEN form < 2 THEN concat('<br>Raport ', CASE WHEN k % 2 = 0 THEN 'comun - ' ELSE '' END, 'Comisia juridică', CASE WHEN k % 3 = 0 THEN ' şi Comisia pentru muncă şi familie, Comisia pentru mediu' ELSE '' END, CASE k % 4 WHEN 0 THEN ' (Adoptare)' WHEN 1 THEN ' distribuit în ' ELSE '' END) ELSE '' END,
  CASE WHEN form = 0 AND k % 5 < 3 THEN concat('<br>Adoptat de Senat ', CASE WHEN k % 2 = 0 THEN '-' ELSE '–' END, ' ', dd, '.', lpad(CAST(mm AS string), 2, '0'), '.', y) ELSE '' END)"""


def agenda_texts(spark: SparkSession, d: str) -> DataFrame:
    """``o, text``: an agenda item of each order; every 97th has none."""
    text = F.concat(F.expr(AGENDA_TEXT), F.expr(AGENDA_MARKS))
    return derived(spark, d, AGENDA_ROWS, "orders").select("o", F.when(F.col("o") % 97 == 5, F.lit("")).otherwise(text).alias("text"))


AGENDA_SQL = f"""
SELECT o, CASE WHEN NOT none THEN kind END AS item_type,
  CASE WHEN NOT none THEN CASE form WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'modificare_si_completare' WHEN 1 THEN 'modificare' ELSE 'completare' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'aprobare_oug' ELSE 'aprobare_og' END WHEN 2 THEN 'privind' WHEN 3 THEN 'constituire' END END AS action,
  CASE WHEN NOT none AND form = 0 THEN CASE WHEN organic THEN 'lege_organica' WHEN ordinary THEN 'lege_ordinara' END END AS law_category,
  CASE WHEN none THEN '' ELSE concat_ws(',', CASE WHEN urgent THEN 'procedura_urgenta' END, CASE WHEN decisive THEN 'camera_decizionala' END, CASE WHEN secret THEN 'vot_secret_bile' END) END AS flags,
  CASE WHEN NOT none AND form = 0 AND k % 5 < 3 THEN CAST(make_date(y, mm, dd) AS VARCHAR) END AS senate_date,
  CASE WHEN none THEN '' ELSE CASE form WHEN 0 THEN 'Lege ' || nr || '/' || y WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'OUG ' ELSE 'OG ' END || nr || '/' || y WHEN 3 THEN 'Lege ' || nr || '/' || y || ',CCR ' || nr || '/' ELSE '' END END AS acts,
  CASE WHEN NOT none AND form < 2 THEN 'juridica' || CASE WHEN k % 3 = 0 THEN ',munca,mediu' ELSE '' END ELSE '' END AS committees,
  CASE WHEN NOT none AND form = 7 THEN CASE k % 4 WHEN 0 THEN 'Curtea de Conturi' WHEN 1 THEN 'BNR' WHEN 2 THEN 'ANPC' ELSE 'Parlamentul European' END ELSE '' END AS institutions,
  CASE WHEN NOT none AND form = 5 THEN 'USR' || (k % 4) END AS initiator, CASE WHEN NOT none AND form = 4 THEN nr END AS initiators, CASE WHEN NOT none AND form = 4 THEN CASE k % 3 WHEN 0 THEN 'deputati' WHEN 1 THEN 'senatori' ELSE 'deputati_si_senatori' END END AS initiator_kind,
  CASE WHEN NOT none THEN CASE form WHEN 0 THEN topic WHEN 1 THEN topic WHEN 2 THEN topic WHEN 3 THEN 'constituirea unei comisii, ' || topic
    WHEN 4 THEN 'cu tema ' || topic || ', inițiat' || CASE WHEN k % 2 = 0 THEN 'ă' ELSE 'e' END || ' de ' || nr || ' de ' || CASE k % 3 WHEN 0 THEN 'deputați' WHEN 1 THEN 'senatori' ELSE 'deputați și senatori' END
    WHEN 5 THEN '- Dezbateri politice la solicitarea Grupului parlamentar USR' || (k % 4) || ', cu tema ' || topic
    WHEN 7 THEN CASE k % 4 WHEN 0 THEN 'Curții, Curtea de Conturi' WHEN 1 THEN 'Băncii Naționale a României' WHEN 2 THEN 'ANPC și al Consiliului Economic și Social European' ELSE 'Parlamentului European' END || ' ' || topic
    WHEN 8 THEN 'Alegerea unui vicepreședinte, ' || topic WHEN 9 THEN 'Altele: ' || topic END END AS subject
FROM (SELECT *, o % 97 = 5 AS none FROM ({plain(AGENDA_ROWS, 'orders')}))
"""


def _acts(acts: Column) -> Column:
    return F.array_join(F.transform(acts, lambda a: F.concat(a["act_type"], F.lit(" "), a["nr"], F.lit("/"), F.coalesce(a["year"].cast("string"), F.lit("")))), ",")


@query(AGENDA_SQL)
def agenda_entities(spark: SparkSession, d: str) -> DataFrame:
    e = agenda_texts(spark, d).select("o", entities.entities(F.col("text")).alias("e"))
    lists = {"flags": "flags", "committees": "commission_slugs", "institutions": "institutions"}
    plainly = {"item_type": "item_type", "action": "action", "law_category": "law_category", "initiator": "initiator_group", "initiator_kind": "initiator_type", "subject": "subject"}
    return e.select("o", *[F.col(f"e.{n}").alias(a) for a, n in plainly.items()], *[F.array_join(f"e.{n}", ",").alias(a) for a, n in lists.items()], F.col("e.senate_adoption_date").cast("string").alias("senate_date"), F.col("e.initiator_count").cast("long").alias("initiators"), _acts(F.col("e.referenced_acts")).alias("acts"))


def _of(spark: SparkSession, d: str, name: str, of) -> DataFrame:
    return agenda_texts(spark, d).select("o", bound(strip_html(F.col("text")), of).alias(name))


@query(f"SELECT o, item_type FROM ({AGENDA_SQL})")
def agenda_item_type(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "item_type", entities.item_type)


@query(f"SELECT o, acts FROM ({AGENDA_SQL})")
def agenda_acts(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "acts", lambda c: _acts(entities.referenced_acts(c)))


@query(f"SELECT o, subject FROM ({AGENDA_SQL})")
def agenda_subject(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "subject", lambda c: entities.subject(c, entities.item_type(c)))


@query(f"SELECT o, action FROM ({AGENDA_SQL})")
def agenda_action(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "action", lambda c: entities.action(c, entities.item_type(c)))


@query(f"SELECT o, initiator, initiators, initiator_kind FROM ({AGENDA_SQL})")
def agenda_initiator(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "who", entities.initiator).select("o", F.col("who.group").alias("initiator"), F.col("who.count").cast("long").alias("initiators"), F.col("who.kind").alias("initiator_kind"))


@query(f"SELECT o, committees FROM ({AGENDA_SQL})")
def agenda_committees(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "committees", lambda c: F.array_join(F.transform(entities.committees(c), entities.committee_slug), ","))


@query(f"SELECT coalesce(law_category, '-') AS law, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (item_type IS NULL) / count(*), 1) AS unknown, count(senate_date) AS adopted FROM ({AGENDA_SQL}) GROUP BY 1")
def extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = agenda_texts(spark, d).select(F.coalesce(entities.law_category("text"), F.lit("-")).alias("law"), bound(strip_html(F.col("text")), entities.item_type).alias("kind"), entities.senate_date(F.col("text")).alias("day"))
    n = F.count(F.lit(1))
    return found.groupBy("law").agg(n.alias("n"), F.bround(100.0 * F.count_if(F.col("kind").isNull()) / n, 1).alias("unknown"), F.count("day").alias("adopted"))


#: Phrases put into documents by their id, each with the label that it must bring; the last three bring none.
PLANTED = [
    ("Procedură de urgenţă", "procedura_urgenta"), ("PRIORITATE LEGISLATIVA", "prioritate_legislativa"), ("Se  dezbate sub rezerva", "rezerva_raport"), ("cererii de reexaminare", "cerere_reexaminare"), ("Comisiei Europene", "Comisia Europeană"), ("Bănci Centrale", None),
    ("Comitetului Regiunilor", "Comitetul Regiunilor"), ("Consiliul UE", "Consiliul UE"), ("Consiliul Superior al Magistraturii", "CSM"), ("Curtea Constituţională a României", "CCR"), ("Consiliul Economic și Social", "CES România"), ("Comitetul Economic şi Social European", "CESE"),
    ("Inspecţia Muncii", "Inspecția Muncii"), ("RA-APPS", "RA-APPS"), ("zANCOM", None), ("Consiliul UEFA", None),
]
#: Short names that end a word fit wherever one does, also in the documents' own words.
ENDINGS, BS = {"bnr": "BNR", "csm": "CSM", "ccr": "CCR", "asas": "Academia de Științe Agricole"}, "\\"
_LABELS = [label for _, label in entities.FLAGS + entities.INSTITUTIONS]


def _planted(k: str, values: list[str | None]) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query(
    f"""
WITH p AS (SELECT doc_id, {_planted('doc_id % 16', [x[1] for x in PLANTED])} AS a, {_planted('(doc_id * 7 + 3) % 16', [x[1] for x in PLANTED])} AS b,
  [{', '.join(f"CASE WHEN regexp_matches(left(text, length(text) // 2) || ' ' || substr(text, length(text) // 2 + 1), '(?i){short}(?:[^{BS}p{{L}}{BS}p{{N}}_]|$)') THEN '{label}' END" for short, label in ENDINGS.items())}] AS ends FROM documents)
SELECT doc_id, array_to_string(list_filter([{', '.join(repr(x) for x in _LABELS)}], lambda x: coalesce(x = a, false) OR coalesce(x = b, false) OR coalesce(list_contains(ends, x), false)), ',') AS labels FROM p
"""
)
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all flags and institutions in documents that phrases are put into, by one list of candidates."""
    phrases = [x for x, _ in PLANTED]
    middle = (F.length("text") / 2).cast("int")
    text = F.concat_ws(" ", F.expr(_planted("doc_id % 16", phrases)), F.substring("text", F.lit(1), middle), F.expr(_planted("(doc_id * 7 + 3) % 16", phrases)), F.substring("text", middle + 1, F.length("text")))
    found = bound(rules.candidates(entities.comma_below(text), entities.FLAGS, entities.INSTITUTIONS), lambda places: F.concat(rules.labels(places, entities.FLAGS), rules.labels(places, entities.INSTITUTIONS)))
    return t(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("labels"))


#: One to three spells in groups; the last may have ended.
_SPELLS = """
concat('Grupul parlamentar ', CASE c_custkey % 3 WHEN 0 THEN 'al Partidului Social Democrat' WHEN 1 THEN 'Uniunea Salvaţi România' ELSE 'SOS România' END, CASE WHEN c_custkey % 4 < 2 THEN concat(' - membru până în feb. ', 2020 + c_custkey % 5) ELSE '' END,
  CASE WHEN c_custkey % 4 < 2 THEN concat(' Deputaţi neafiliaţi - membru din mart. ', 2020 + c_custkey % 5) ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN concat(' Grupul parlamentar PNL\\u0020- afiliat din iun. ', 2021 + c_custkey % 5, CASE WHEN c_custkey % 8 = 0 THEN ' până în dec. 2026' ELSE '' END) ELSE '' END)"""


@query(
    """
WITH p AS (SELECT c_custkey AS c, CASE c_custkey % 3 WHEN 0 THEN 'PSD' WHEN 1 THEN 'USR' ELSE 'SOS' END AS first, 2020 + c_custkey % 5 AS y, c_custkey % 4 AS a FROM customer)
SELECT c, CASE a WHEN 0 THEN concat_ws(',', first || '/-/feb. ' || y || '/false', 'Neafiliat/mart. ' || y || '/-/false', 'Altul/iun. ' || (y + 1) || CASE WHEN c % 8 = 0 THEN '/dec. 2026/false' ELSE '/-/true' END)
  WHEN 1 THEN concat_ws(',', first || '/-/feb. ' || y || '/false', 'Neafiliat/mart. ' || y || '/-/true') ELSE first || '/-/-/true' END AS spells FROM p
"""
)
def group_history(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda e: F.concat_ws("/", e["short"], F.coalesce(e["from_date"], F.lit("-")), F.coalesce(e["until_date"], F.lit("-")), e["current"].cast("string"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.array_join(F.transform(entities.group_history(F.expr(_SPELLS)), shown), ",").alias("spells"))


@query(f"SELECT o, coalesce(item_type IN ('proiect_lege', 'propunere_legislativa', 'reexaminare'), false) AS bills, coalesce(item_type = 'proiect_hotarare', false) AS hotarari, coalesce(item_type IN ('motiune_simpla', 'motiune_cenzura', 'angajare_raspundere'), false) AS motions, coalesce(item_type IN ('informare_casete', 'dezbateri_politice', 'raport', 'alegere'), false) AS procedural FROM ({AGENDA_SQL})")
def named_type_sets(spark: SparkSession, d: str) -> DataFrame:
    """Which named sets the type of each agenda item belongs to."""
    kinds = _of(spark, d, "kind", entities.item_type)
    return kinds.select("o", *[facets.in_set(F.col("kind"), name).alias(name) for name in facets.TYPE_SETS])
