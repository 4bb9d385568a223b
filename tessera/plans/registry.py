"""All queries of the engine, each with the SQL it is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import aggregates as agg
from tessera.operators import facets, joins, lists, ranking
from tessera.plans.base import ORACLES, QUERIES, query
from tessera.plans.base import t as _t

__all__ = ["ORACLES", "QUERIES"]


@query("""
SELECT o_orderpriority AS grp, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS hits,
  round_even(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS rate
FROM orders GROUP BY 1 HAVING count(*) >= 5""")
def rate_by_group(spark: SparkSession, d: str) -> DataFrame:
    return agg.rate_by_group(_t(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F", at_least=5)


@query("SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='P') AS p, round_even(100.0::DOUBLE*count(*) FILTER (o_orderstatus='F')/count(*),1) AS rate FROM orders GROUP BY 1")
def conditional_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(s == "P").alias("p"), agg.safe_pct(F.count_if(s == "F"), F.count(F.lit(1))).alias("rate"))


@query("SELECT strftime(o_orderdate,'%Y-%m') AS month, count(*) AS total, count(*) FILTER (o_orderstatus='F') AS hits FROM orders GROUP BY 1")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return agg.monthly_trend(_t(spark, d, "orders"), F.col("o_orderdate"), F.col("o_orderstatus") == "F")


@query("SELECT coalesce(c_mktsegment,'unknown') AS value, count(*) AS n FROM customer GROUP BY 1")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return agg.value_distribution(_t(spark, d, "customer"), F.col("c_mktsegment"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) n, min(event_id) f FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) rn, sum(n) OVER (PARTITION BY user_id) total FROM c)
SELECT user_id, CAST(total AS BIGINT) AS total, event_type AS modal FROM r WHERE rn=1 ORDER BY total DESC, user_id LIMIT 15""")
def top_actors_modal_group(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    users = pairs.groupBy("user_id").agg(F.sum("n").alias("total"), F.max_by("event_type", F.struct("n", -F.col("f"))).alias("modal"))
    return users.orderBy(F.desc("total"), "user_id").limit(15)


@query("""WITH g AS (SELECT user_id, date_sub('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, list_sort(list(gap)) AS l FROM g WHERE gap > 0 AND gap < 7*86400 GROUP BY 1)
SELECT user_id, CAST(l[len(l)//2+1] AS BIGINT) AS gap FROM s""")
def upper_median_gap(spark: SparkSession, d: str) -> DataFrame:
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts"))
    rows = _t(spark, d, "events").select("user_id", gap.alias("gap")).where("gap > 0 and gap < 7 * 86400")
    return agg.upper_median(rows, ["user_id"], "gap", "gap").drop("n")


@query("SELECT n_name, count(*) AS n, round_even(median(c_acctbal),2) AS med, round_even(avg(c_acctbal),2) AS mean, round_even(sum(c_acctbal),2) AS total FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1 HAVING count(*)>=3")
def group_stats_median(spark: SparkSession, d: str) -> DataFrame:
    joined = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = F.col("c_acctbal")
    out = agg.group_stats(joined.select("n_name", "c_acctbal"), ["n_name"], "c_acctbal", {"med": 0.5}, mean=F.bround(F.avg(v), 2), total=F.bround(F.sum(v), 2))
    return out.where("n >= 3").withColumn("med", F.bround("med", 2))


@query("SELECT round_even(quantile_cont(s_acctbal,0.25),4) AS q1, round_even(quantile_cont(s_acctbal,0.5),4) AS med, round_even(quantile_cont(s_acctbal,0.75),4) AS q3, round_even(quantile_cont(s_acctbal,0.9),4) AS p90, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier")
def quartiles_linear(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("s_acctbal")
    shares = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.9}
    q = agg.group_stats(_t(spark, d, "supplier").select("s_acctbal"), [], "s_acctbal", shares, low=F.min(v), high=F.max(v))
    return q.select(*[F.bround(n, 4).alias(n) for n in shares], "low", "high")


@query("WITH s AS (SELECT s_nationkey AS k, list_sort(list(s_acctbal)) AS l FROM supplier GROUP BY 1) SELECT k, CASE WHEN len(l)>=5 THEN l[CAST(floor(len(l)*0.25) AS INT)+1] END AS q1, CASE WHEN len(l)>=5 THEN l[CAST(floor(len(l)*0.75) AS INT)+1] END AS q3 FROM s")
def quartiles_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    return agg.floor_quantiles(rows, ["k"], "s_acctbal", {"q1": 0.25, "q3": 0.75}).drop("n")


@query("""SELECT c_custkey, CAST(round_even(100.0::DOUBLE*(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal)-1)/count(*) OVER (PARTITION BY c_nationkey),0) AS INT) AS pct, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rnk,
CASE WHEN c_acctbal>0 THEN CAST(round_even(100.0::DOUBLE*(rank() OVER (PARTITION BY c_nationkey, c_acctbal>0 ORDER BY c_acctbal)-1)/count(*) OVER (PARTITION BY c_nationkey, c_acctbal>0),0) AS INT) END AS pct_positive, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer""")
def percentile_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("positive"))
    out = ranking.context(rows, "c_acctbal", {"all": ["c_nationkey"], "some": ["positive"]})
    return out.select("c_custkey", F.col("all_pct").alias("pct"), F.col("all_rank").alias("rnk"), F.col("some_pct").alias("pct_positive"), F.col("all_n").alias("n"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal>0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 15")
def leaderboard_desc(spark: SparkSession, d: str) -> DataFrame:
    return ranking.leaderboard(_t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", where=F.col("s_acctbal") > 0)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL ORDER BY s_acctbal, s_suppkey LIMIT 15")
def leaderboard_asc(spark: SparkSession, d: str) -> DataFrame:
    return ranking.leaderboard(_t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", descending=False)


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) rn, ts FROM events) SELECT event_id, event_type, rn FROM r WHERE rn<=15 ORDER BY ts DESC, event_id LIMIT 60")
def top_n_per_type(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n_per_type(_t(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", [F.desc("ts"), F.asc("event_id")], 15, 60).select("event_id", "event_type", "rn")


@query("WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) ORDER BY l_linenumber, l_partkey LIMIT 7")
def latest_group_children(spark: SparkSession, d: str) -> DataFrame:
    latest = _t(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(F.broadcast(latest), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_linenumber", "l_partkey").limit(7)


@query("(SELECT 'top' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) UNION ALL (SELECT 'bottom', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50)")
def top_bottom_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    sides = [ranking.leaderboard(rows, "c_acctbal", "c_custkey", 50, descending=side == "top").withColumn("side", F.lit(side)) for side in ("top", "bottom")]
    return sides[0].unionByName(sides[1])


@query("SELECT c_custkey, round_even(abs(c_acctbal)/max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey),6) AS bar, round_even(least(1.0, greatest(0.1, sqrt(abs(c_acctbal)/max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey)))),6) AS circle FROM customer")
def max_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.abs("c_acctbal").alias("v"))
    bar = F.col("v") / F.col("most")
    out = rows.join(rows.groupBy("c_nationkey").agg(F.max("v").alias("most")), "c_nationkey")
    return out.select("c_custkey", F.bround(bar, 6).alias("bar"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.sqrt(bar))), 6).alias("circle"))


@query("WITH v AS (SELECT c_nationkey, c_custkey, floor(log10(c_acctbal)) AS dec, c_acctbal FROM customer WHERE c_acctbal>=1) SELECT c_custkey, coalesce(dec <> lag(dec) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), false) AS brk FROM v")
def decade_break(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").where("c_acctbal >= 1").select("c_custkey", "c_nationkey", "c_acctbal", F.floor(F.log10("c_acctbal")).alias("dec"))
    return ranking.first_of_step(rows, "c_nationkey", "dec", "c_acctbal", "c_custkey", "brk").select("c_custkey", "brk")


@query("SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 150")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50).select("o_orderkey", "rn")


@query("SELECT s_suppkey, coalesce(n_name,'?') AS n_name, coalesce(r_name,'?') AS r_name FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey AND n_regionkey<>2 LEFT JOIN region ON n_regionkey=r_regionkey")
def lookup_join_defaults(spark: SparkSession, d: str) -> DataFrame:
    nations = _t(spark, d, "nation").where("n_regionkey <> 2").withColumnRenamed("n_nationkey", "s_nationkey")
    regions = _t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    one = joins.lookup(_t(spark, d, "supplier"), nations, "s_nationkey", {"n_name": "?"})
    return joins.lookup(one, regions, "n_regionkey", {"r_name": "?"}).select("s_suppkey", "n_name", "r_name")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) rn FROM lineitem) SELECT o_orderkey, l_partkey FROM orders LEFT JOIN f ON o_orderkey=l_orderkey AND rn=1")
def first_match_join(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return joins.first_match(_t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("o_orderkey", "l_partkey")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(CASE WHEN l_partkey=l_suppkey THEN [l_partkey] ELSE [l_partkey,l_suppkey] END) AS s_suppkey FROM lineitem), r AS (SELECT k.l_orderkey, k.l_linenumber, k.l_partkey, s.s_suppkey, row_number() OVER (PARTITION BY k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_suppkey ORDER BY s.s_suppkey) rn FROM k JOIN supplier s ON s.s_suppkey=k.s_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, s_suppkey FROM r WHERE rn=1""")
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = joins.either_key(lines, ["l_partkey", "l_suppkey"], _t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "s_suppkey")


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, CASE WHEN count(*)>3 THEN count(*) END AS n FROM supplier WHERE s_nationkey<20 GROUP BY 1)
SELECT coalesce(c.k,s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.n ELSE c.n END AS n FROM c FULL JOIN s ON c.k=s.k""")
def full_outer_precedence(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = _t(spark, d, "supplier").where("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.full_outer(c, s.withColumn("n", F.when(F.col("n") > 3, F.col("n"))), "k", ["n"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000) AS big FROM customer")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    big = _t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flagged(_t(spark, d, "customer").select("c_custkey"), big, "c_custkey", "big")


@query("SELECT o_orderkey, CASE WHEN o_custkey%3=0 THEN 'new' ELSE 'old' END AS gen FROM orders")
def upsert_new_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    new = orders.where("o_custkey % 3 = 0").select("o_orderkey", F.lit("new").alias("gen"))
    return joins.upsert(orders.select("o_orderkey", F.lit("old").alias("gen")), new, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderdate>=DATE '2000-01-01' THEN 'c' WHEN o_orderdate>=DATE '1997-06-01' THEN 'b' ELSE 'a' END AS era FROM orders")
def range_map(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", joins.range_label(F.col("o_orderdate").cast("date"), [("1997-06-01", "b"), ("2000-01-01", "c")], "a").alias("era"))


@query("SELECT CASE WHEN o_orderstatus='P' THEN 'unknown' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, count(*) AS n FROM orders GROUP BY 1")
def split_by_year(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return _t(spark, d, "orders").groupBy(F.coalesce(F.year(day).cast("string"), F.lit("unknown")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def nest_unnest(spark: SparkSession, d: str) -> DataFrame:
    nested = joins.nest(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"], "lines")
    return joins.unnest(nested, "l_orderkey", "lines")


@query("SELECT 'order' AS tip, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus='F' UNION ALL SELECT CASE WHEN event_type='error' THEN 'alert' ELSE 'event' END, event_id, ts FROM events")
def feed_union(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit("order").alias("tip"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = _t(spark, d, "events").select(F.when(F.col("event_type") == "error", "alert").otherwise("event").alias("tip"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return orders.unionByName(events)


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, string_agg(CAST(event_id AS VARCHAR) || ',' || CAST(event_id + 1 AS VARCHAR), ',' ORDER BY event_id) AS children FROM events GROUP BY 1")
def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.array("event_id", F.col("event_id") + 1).alias("children"))
    merged = lists.whole(joins.merge_repeated(rows, "user_id", "event_id", ["event_type"], "children", 20), ["user_id"], "children", "event_type")
    return merged.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("""WITH c AS (SELECT CAST(user_id%5 AS VARCHAR) AS grp, count(*) AS total, count(*) FILTER (event_type='view') y, count(*) FILTER (event_type='click') n, count(*) FILTER (event_type='error') a FROM events GROUP BY 1)
SELECT grp, total, CAST(CASE WHEN y+n+a>0 THEN floor(100.0::DOUBLE*greatest(y,n,a)/(y+n+a)+0.5) ELSE 0 END AS BIGINT) AS rate FROM c""")
def cohesion_by_party(spark: SparkSession, d: str) -> DataFrame:
    return agg.cohesion(_t(spark, d, "events"), (F.col("user_id") % 5).cast("string"), F.col("event_type"), ("view", "click", "error"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round_even(100.0::DOUBLE*count(*)/sum(count(*)) OVER (PARTITION BY c_nationkey),1) AS share, round_even(100.0::DOUBLE*count(*)/max(count(*)) OVER (PARTITION BY c_nationkey),1) AS bar FROM customer GROUP BY 1,2")
def share_in_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    n = _t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.bround(100.0 * F.col("n") / F.sum("n").over(w), 1)).withColumn("bar", F.bround(100.0 * F.col("n") / F.max("n").over(w), 1))


@query("SELECT c_nationkey, count(*) AS members, coalesce(sum(n),0)::BIGINT AS orders, round_even(coalesce(sum(n),0)/count(*)::DOUBLE,3) AS per_capita FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey=c_custkey GROUP BY 1")
def per_capita(spark: SparkSession, d: str) -> DataFrame:
    sums = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = joins.lookup(_t(spark, d, "customer"), sums, "c_custkey", {"n": 0})
    out = joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("orders"))
    return out.withColumn("per_capita", F.bround(F.col("orders") / F.col("members"), 3))


@query("SELECT o_custkey, count(*) AS n, arg_min(o_totalprice,(o_orderdate,o_orderkey)) AS first_value, arg_max(o_totalprice,(o_orderdate,o_orderkey)) AS last_value, CASE WHEN count(*)>1 THEN round_even(arg_max(o_totalprice,(o_orderdate,o_orderkey))-arg_min(o_totalprice,(o_orderdate,o_orderkey)),2) END AS delta FROM orders GROUP BY 1")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    return agg.snapshot_delta(_t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("SELECT l_returnflag, round_even(sum(l_extendedprice*(1-l_discount)),0) AS weighted FROM lineitem GROUP BY 1")
def weighted_category_sum(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("weighted"))


_WORDS_SQL = "SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: len(w) > 3) AS w FROM documents"  # runs of fewer letters are left out, as [a-z]{4,} does


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))


@query(f"WITH t AS ({_WORDS_SQL}) SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query(f"WITH t AS ({_WORDS_SQL}) SELECT gram, count(*) AS n FROM (SELECT unnest(CASE WHEN len(w)>=2 THEN list_transform(range(1,len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE [] END) AS gram FROM t) GROUP BY 1 ORDER BY n DESC, gram LIMIT 100")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select(F.explode(text.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(100)


@query(f"""WITH t AS ({_WORDS_SQL}), c AS (SELECT word, count(*) FILTER (lang='en') AS a, count(*) FILTER (lang='fr') AS b FROM (SELECT lang, unnest(w) AS word FROM t WHERE lang IN ('en','fr')) GROUP BY 1), m AS (SELECT * FROM c WHERE a>=5 ORDER BY a DESC, word LIMIT 200)
SELECT word, a, b, round_even(a::DOUBLE/greatest(b,1),2) AS ratio FROM m""")
def ngram_contrast(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d).where(F.col("lang").isin("en", "fr")).select("lang", F.explode("w").alias("word"))
    counts = rows.groupBy("word").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "fr").alias("b"))
    top = counts.where("a >= 5").orderBy(F.desc("a"), "word").limit(200)
    return top.withColumn("ratio", F.bround(F.col("a") / F.greatest("b", F.lit(1)), 2))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[1:60] AS slug FROM documents")
def fold_slug(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html,'(?i)<br\\s*/?>',chr(10),'g'),'<[^>]+>','','g'), ' ')) AS plain FROM pages")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("plain"))


_RULES = [("spam|pills|casino|bets", "unwanted"), ("^https", "secure"), ("[?]page=", "paged")]


@query("SELECT page_id, CASE WHEN regexp_matches(url,'spam|pills|casino|bets') THEN 'unwanted' WHEN regexp_matches(url,'^https') THEN 'secure' WHEN regexp_matches(url,'[?]page=') THEN 'paged' ELSE 'other' END AS first, concat_ws(',', CASE WHEN regexp_matches(url,'spam|pills|casino|bets') THEN 'unwanted' END, CASE WHEN regexp_matches(url,'^https') THEN 'secure' END, CASE WHEN regexp_matches(url,'[?]page=') THEN 'paged' END) AS every FROM pages")
def rule_tagging(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", text.first_rule(url, _RULES, "other").alias("first"), F.array_join(text.all_rules(url, _RULES), ",").alias("every"))


@query("SELECT page_id, CASE WHEN regexp_extract(url,'page=(\\d+)',1)<>'' THEN CAST(regexp_extract(url,'page=(\\d+)',1) AS BIGINT) END AS page FROM pages")
def extract_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"page=(\d+)", 1).try_cast("long").alias("page"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text),'the instan') OR contains(lower(source),'src7')")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.where(text.contains_any([F.col("text")], "the instan") | text.contains_any([F.col("source")], "SRC7")).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view','click') AND CAST(json_extract_string(props,'$.k') AS INT) BETWEEN 10 AND 20 AND value > 5")
def faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return facets.facet_filter(_t(spark, d, "events"), any_of={"event_type": ["view", "click"]}).where(k.between(10, 20) & (F.col("value") > 5)).select("event_id")


@query("SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents WHERE n_chars>500 GROUP BY 1,2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE n_chars>500 GROUP BY 1,2")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_counts(_t(spark, d, "documents").where("n_chars > 500"), ["lang", "source"])


@query("""SELECT 'documents' AS tbl, count(*) AS n, count(*)-count(DISTINCT doc_id) AS repeated, round_even(100.0::DOUBLE*count(*) FILTER (text IS NOT NULL AND text<>'')/count(*),1) AS coverage FROM documents
UNION ALL SELECT 'orders', count(*), count(*)-count(DISTINCT o_orderkey), round_even(100.0::DOUBLE*count(*) FILTER (o_totalprice IS NOT NULL AND o_totalprice<>0)/count(*),1) FROM orders""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    def row(name, key, filled):
        n = F.count(F.lit(1))
        return _t(spark, d, name).agg(F.lit(name).alias("tbl"), n.alias("n"), (n - F.count_distinct(key)).alias("repeated"), agg.safe_pct(F.count_if(filled), n).alias("coverage"))

    filled = F.col("text").isNotNull() & (F.col("text") != "")
    return row("documents", "doc_id", filled).unionByName(row("orders", "o_orderkey", F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") != 0)))


_ROLL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _ROLL))
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    parts = [_t(spark, d, t).agg(F.lit(t).alias("tbl"), F.count(F.lit(1)).alias("n")) for t in _ROLL]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT c_custkey, substr(sha256('leg|' || c_name),1,16) AS id, lower(trim(c_name)) AS name_key FROM customer")
def ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", text.row_id(F.lit("leg"), F.col("c_name")).alias("id"), text.name_key(F.col("c_name")).alias("name_key"))


@query("SELECT o_orderkey, CAST(floor((2024-year(o_orderdate))/5)*5 AS INT) || '–' || CAST(floor((2024-year(o_orderdate))/5)*5+4 AS INT) AS cohort FROM orders")
def age_cohort(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", text.age_cohort(F.col("o_orderdate"), 2024).alias("cohort"))


@query("WITH m AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) SELECT CAST(m.day AS VARCHAR) AS day, isodow(m.day)<6 AS weekday, count(event_id) AS n FROM m LEFT JOIN events ON ts::DATE=m.day GROUP BY m.day")
def calendar_spine(spark: SparkSession, d: str) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS day")
    counts = _t(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup(days, counts, "day", {"n": 0}).select(F.col("day").cast("string").alias("day"), (F.weekday("day") < 5).alias("weekday"), "n")


from tessera.plans import agenda, files, labels, pages, records, rendered, stored, texts  # noqa: E402, F401  they register their queries
