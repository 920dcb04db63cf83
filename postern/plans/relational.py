"""Catalogue queries over the star-schema and event tables: filters, joins, aggregations, windows, sorting, sets."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postern.operators import aggregates, graph, joins

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


MS = "CAST(floor(epoch(ts) * 1000 + 1e-6) AS BIGINT)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with the time in whole seconds since 1970."""
    return t(spark, d, "events").withColumn("sec", F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority LIKE '%URGENT%' AND o_totalprice BETWEEN 1000 AND 200000")
def filt01_conjunctive_filter(spark, d):
    return t(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").contains("URGENT") & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(r"SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%100\%%' ESCAPE '\' OR lower(text) LIKE '%license%'")
def filt02_escaped_like(spark, d):
    text = F.lower("text")
    return t(spark, d, "documents").filter(text.contains("100%") | text.contains("license")).select("doc_id", "source")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS rank FROM orders ORDER BY rank DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def filt03_rank_sort_key(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return t(spark, d, "orders").withColumn("rank", rank).orderBy(F.desc("rank"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "rank")


@query("SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN ('click','error') GROUP BY ALL HAVING count(*) >= 3")
def filt04_having_filter(spark, d):
    return t(spark, d, "events").filter(F.col("event_type").isin("click", "error")).groupBy("event_type", "user_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(text), 1, 2))::INT < 179 THEN 'train' ELSE 'holdout' END AS split FROM documents")
def filt11_content_hash_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.when(F.conv(F.substring(F.sha2("text", 256), 1, 2), 16, 10).cast("int") < 179, "train").otherwise("holdout").alias("split"))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_mktsegment FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey AND c.c_acctbal > 0 WHERE l.l_quantity > 45")
def join01_list_page(spark, d):
    c = t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    rows = t(spark, d, "lineitem").filter("l_quantity > 45").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment")


@query("SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY n.n_name")
def join02_three_way(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l.l_suppkey, l.l_partkey, count(DISTINCT s.s_name) AS names FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 25 GROUP BY ALL")
def join09_composite_key(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "part").filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("s_name").alias("names"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS closed FROM customer c")
def join12_scalar_counts(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    return t(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("closed", F.lit(0)).alias("closed"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def join14_left_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join15_left_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)")
def join16_first_wins_duplicates(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return joins.first_wins(docs, "sha", ["doc_id"], "doc_id").select("doc_id", "duplicate_of")


@query("WITH r AS (SELECT p_partkey, p_partkey * 37 AS lo, p_partkey * 37 + p_size AS hi FROM part), k AS (SELECT o_orderkey, (o_orderkey * 7) % 50000 AS k FROM orders) SELECT o_orderkey, p_partkey FROM k JOIN r ON k BETWEEN lo AND hi")
def join20_interval_join(spark, d):
    ranges = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37).alias("lo"), (F.col("p_partkey") * 37 + F.col("p_size")).alias("hi"))
    rows = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 50000).alias("k"))
    return joins.interval_join(rows, "k", ranges, "lo", "hi", 64).select("o_orderkey", "p_partkey")


@query("WITH m AS (SELECT p_partkey AS name, p_partkey * 53 AS start FROM part WHERE p_size % 3 = 0), k AS (SELECT o_orderkey, (o_orderkey * 11) % 120000 AS k FROM orders) SELECT o_orderkey, name AS mark_name, start AS mark_start FROM k ASOF LEFT JOIN m ON k.k >= m.start")
def join21_asof_join(spark, d):
    marks = t(spark, d, "part").filter("p_size % 3 = 0").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 53).alias("start"))
    rows = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 11 % 120000).alias("k"))
    return joins.asof_join(rows, "k", marks, "start", 4096).select("o_orderkey", "mark_name", "mark_start")


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS key FROM lineitem), ok AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 40),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.key = y.key AND x.id < y.id JOIN ok ON ok.key = x.key GROUP BY ALL)
SELECT a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 5""")
def join22_blocked_pairs_topk(spark, d):
    return joins.blocked_pairs(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", fan_out=40, top=5)


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS key FROM lineitem), ok AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 200),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.key = y.key AND x.id < y.id JOIN ok ON ok.key = x.key GROUP BY ALL)
SELECT a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 300""")
def join22_blocked_pairs(spark, d):
    """With the operator's own fan_out and top."""
    return joins.blocked_pairs(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events")
def join32_prior_sightings(spark, d):
    return t(spark, d, "events").select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)).alias("seen"))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS closed, count(*) FILTER (o_orderstatus='O') AS open, count(*) FILTER (o_totalprice > 100000) AS large, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
def agg01_conditional_counts(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("closed"), F.count_if(s == "O").alias("open"), F.count_if(p > 100000).alias("large"), F.max(p).alias("most"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def agg02_facets(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ms FROM events), s AS (SELECT min(ms) lo, max(ms) hi FROM e),
w AS (SELECT w FROM (VALUES (3600000),(21600000),(86400000),(604800000),(2592000000),(31536000000)) v(w), s WHERE hi // w - lo // w + 1 <= 60 ORDER BY w LIMIT 1),
g AS (SELECT unnest(range(lo // w, hi // w + 1)) AS slot, w FROM s, w)
SELECT CAST(g.slot * g.w AS BIGINT) AS start, CAST(g.w AS BIGINT) AS width, (SELECT count(*) FROM e WHERE e.ms // g.w = g.slot) AS n FROM g""")
def agg05_adaptive_timeline(spark, d):
    return aggregates.timeline(events(spark, d).withColumn("ms", F.col("sec") * 1000), "ms")


@query("""WITH f AS (SELECT event_type, CAST(user_id % 4 AS INT) AS sev, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, max(sev) AS worst, arg_max(n, sev) AS n_worst FROM f GROUP BY event_type""")
def agg06_severity_rollup(spark, d):
    f = t(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).cast("int").alias("sev")).agg(F.count("*").alias("n"))
    return f.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("sev").alias("worst"), F.max_by("n", "sev").alias("n_worst"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY kinds DESC, user_id LIMIT 25")
def agg07_top_distinct_roles(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("roles"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).orderBy(F.desc("kinds"), "user_id").limit(25)


@query("""SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n, count(*) FILTER (url LIKE '%?%') AS with_query FROM pages GROUP BY 1 ORDER BY with_query DESC, n DESC, host LIMIT 8""")
def agg08_top_hosts(spark, d):
    host = F.substring_index(F.substring_index("url", "://", -1), "/", 1)
    return t(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").contains("?")).alias("with_query")).orderBy(F.desc("with_query"), F.desc("n"), "host").limit(8)


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem")
def agg11_distinct_totals(spark, d):
    return t(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS last_day FROM events GROUP BY event_type")
def agg14_recent_window(spark, d):
    e = t(spark, d, "events")
    return e.crossJoin(e.agg(F.max("ts").alias("_m"))).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.col("_m") - F.expr("INTERVAL 1 DAY")).alias("last_day"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS df, round(count(DISTINCT l_suppkey) / count(DISTINCT l_orderkey), 9) AS diversity FROM lineitem GROUP BY l_partkey")
def agg16_df_and_diversity(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("df"), F.round(F.countDistinct("l_suppkey") / F.countDistinct("l_orderkey"), 9).alias("diversity"))


@query("""WITH m AS (SELECT l_orderkey, l_returnflag, max(l_discount) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(1 - product(1 - s), 9) AS score, count(*) AS families FROM m GROUP BY l_orderkey""")
def agg17_noisy_or(spark, d):
    return aggregates.noisy_or(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_discount").withColumn("score", F.round("score", 9))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def agg20_mode_first_seen(spark, d):
    return aggregates.mode_first_seen(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH s AS (SELECT user_id, event_type, least(sum((event_id % 7) / 10.0::DOUBLE), CASE event_type WHEN 'click' THEN 1.5 WHEN 'error' THEN 3.0 ELSE 2.0 END) AS s FROM events GROUP BY user_id, event_type)
SELECT user_id, CAST(round(100 / (1 + exp(-round(x, 6)))) AS INT) AS score FROM (SELECT user_id, sum(s) - 2.6 AS x FROM s GROUP BY user_id)""")
def agg23_capped_logistic(spark, d):
    rows = t(spark, d, "events").withColumn("w", (F.col("event_id") % 7) / F.lit(10.0))
    out = aggregates.capped_score(rows, "user_id", "event_type", "w", {"click": 1.5, "error": 3.0})
    return out.select("user_id", F.round(100 / (1 + F.exp(-F.col("logit")))).cast("int").alias("score"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def agg30_totals_with_rollup(spark, d):
    return t(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH j AS (SELECT l.quality = 0 AS truth, d.n_chars < 600 AS found FROM labels l JOIN documents d USING (doc_id))
SELECT count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND NOT found) AS tn,
round(count(*) FILTER (truth AND found) / count(*) FILTER (truth), 9) AS recall, round(count(*) FILTER (truth AND found) / count(*) FILTER (found), 9) AS precision, round(count(*) FILTER (NOT truth AND found) / count(*) FILTER (NOT truth), 9) AS fpr FROM j""")
def agg31_confusion_metrics(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select((F.col("quality") == 0).alias("truth"), (F.col("n_chars") < 600).alias("found"))
    a = j.agg(F.count_if(F.expr("truth and found")).alias("tp"), F.count_if(F.expr("not truth and found")).alias("fp"), F.count_if(F.expr("truth and not found")).alias("fn"), F.count_if(F.expr("not truth and not found")).alias("tn"))
    return a.select("*", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 9).alias("recall"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("fp") / (F.col("fp") + F.col("tn")), 9).alias("fpr"))


@query("""WITH j AS (SELECT label AS truth, vec_id % 13 AS found FROM embeddings), c AS (SELECT found, truth, count(*) AS n FROM j GROUP BY ALL),
o AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY found)), r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY truth)),
b AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c)
SELECT round(b.s / o.s, 9) AS precision, round(b.s / r.s, 9) AS recall, round(2 * (b.s / o.s) * (b.s / r.s) / (b.s / o.s + b.s / r.s), 9) AS f1,
round((b.s - o.s * r.s / (b.n * (b.n - 1) / 2)) / ((o.s + r.s) / 2 - o.s * r.s / (b.n * (b.n - 1) / 2)), 9) AS ari FROM o, r, b""")
def agg32_pairwise_and_rand(spark, d):
    return aggregates.agreement(t(spark, d, "embeddings").select(F.col("label").alias("truth"), (F.col("vec_id") % 13).alias("found")), "found", "truth")


@query("""WITH s AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT q AS share, min(v) AS value FROM s, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) x(q) WHERE i = CAST(floor(n * q) AS BIGINT) GROUP BY q""")
def agg33_index_quantiles(spark, d):
    return aggregates.quantiles(t(spark, d, "orders"), "o_custkey", [0.5, 0.95])


@query("SELECT quality, count(*) AS n, round(avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0.0 END), 9) AS long_rate, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 9) AS english_rate FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def agg34_feature_rates(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return j.groupBy("quality").agg(F.count("*").alias("n"), rate(F.col("n_chars") > 1500).alias("long_rate"), rate(F.col("lang") == "en").alias("english_rate"))


@query("SELECT id, count(*) AS degree FROM (SELECT c_nationkey AS id FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY id")
def agg35_degrees(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("id"))
    return a.union(t(spark, d, "supplier").select("s_nationkey")).groupBy("id").agg(F.count("*").alias("degree"))


@query("SELECT o_custkey, o_orderpriority, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS evidence, max(o_totalprice) AS weight FROM orders GROUP BY ALL")
def agg36_edge_merge(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("evidence"), F.max("o_totalprice").alias("weight"))


@query("SELECT event_id, lag(sec) OVER w AS before, sec - lag(sec) OVER w AS delay FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win01_hop_delay(spark, d):
    before = F.lag("sec").over(Window.partitionBy("user_id").orderBy("event_id"))
    return events(spark, d).select("event_id", before.alias("before"), (F.col("sec") - before).alias("delay"))


@query("SELECT event_id FROM (SELECT event_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY event_id) AS delay FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)) WHERE delay < -7200")
def win02_backwards_time(spark, d):
    return win01_hop_delay(spark, d).filter("delay < -7200").select("event_id")


@query("SELECT event_id, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS intact FROM events")
def win03_running_flag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t(spark, d, "events").select("event_id", F.min(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(w).alias("intact"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def win04_top_k_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH e AS (SELECT event_id, user_id, sha256(concat_ws('|', event_id, event_type)) AS own FROM events), c AS (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM e)
SELECT event_id, sha256(coalesce(prev, '') || own) AS link, prev IS NULL AS first FROM c""")
def win07_chain_links(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("own"))
    prev = F.lag("own").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select("event_id", F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.col("own")), 256).alias("link"), prev.isNull().alias("first"))


@query("""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM e""")
def win09_sliding_rate(spark, d):
    return events(spark, d).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)).alias("in_hour"))


@query("SELECT p_brand, n, 'C-' || lpad(CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS VARCHAR), 4, '0') AS name FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def win11_rank_labels(spark, d):
    n = t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.select("p_brand", "n", F.concat(F.lit("C-"), F.lpad(F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).cast("string"), 4, "0")).alias("name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sort01_page(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT kind, id, priority FROM (SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS priority FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier) ORDER BY priority DESC, kind, id LIMIT 40")
def sort05_priority_cut(spark, d):
    a = t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("priority"))
    b = t(spark, d, "supplier").select(F.lit("supplier"), "s_suppkey", "s_acctbal")
    return a.union(b).orderBy(F.desc("priority"), "kind", "id").limit(40)


@query("SELECT event_id, event_type FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 30")
def sort08_keyset_page(spark, d):
    return t(spark, d, "events").filter("event_id < 900").orderBy(F.desc("event_id")).limit(30).select("event_id", "event_type")


@query("SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def set02_union_distinct(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("id")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set03_difference(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(t(spark, d, "orders").select("o_custkey").distinct()).distinct()


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set03_intersection(spark, d):
    li = t(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).intersect(li.filter("l_returnflag = 'A'").select("l_suppkey"))


@query("""WITH a AS (SELECT event_id AS id, value AS v, ts FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id AS id, value * 2 AS v, ts FROM events WHERE event_id % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.ts, b.ts) AS first_seen, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.id = b.id""")
def sink02_accumulating_merge(spark, d):
    e = t(spark, d, "events")
    old = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("value").alias("v0"), F.col("ts").alias("t0"))
    new = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("v1"), F.col("ts").alias("t1"))
    return old.join(new, "id", "full").select("id", F.coalesce("t0", "t1").alias("first_seen"), F.coalesce("v1", "v0").alias("v"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def sink03_upsert_latest(spark, d):
    best = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("b")
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", "b.event_id", "b.value")


@query("""SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) > (SELECT greatest(count(*) - 4000, 0) FROM orders)""")
def sink09_retention_prune(spark, d):
    o = t(spark, d, "orders")
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return o.withColumn("_r", rank).orderBy(F.desc("_r"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(4000).select("o_orderkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 100 + c_nationkey % 7 AS b FROM customer), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM both_ UNION SELECT both_.b, r.c FROM r JOIN both_ ON r.id = both_.a) SELECT id, min(c) AS component FROM r GROUP BY id""")
def clu03_components(spark, d):
    return graph.components(t(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("a"), (F.col("c_nationkey") % 7 + 100).cast("int").alias("b")))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 10000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h0 AS (SELECT 1::BIGINT AS id, 0 AS hops),
h1 AS (SELECT DISTINCT u.b AS id FROM u JOIN h0 ON u.a = h0.id), h2 AS (SELECT DISTINCT u.b AS id FROM u JOIN h1 ON u.a = h1.id)
SELECT id, min(hops) AS hops FROM (SELECT id, hops FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def gra03_neighbourhood(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b"))
    return graph.neighbourhood(edges, spark.range(1, 2).toDF("id"), 2)


@query("""WITH e AS (SELECT o_custkey AS a, o_orderkey + 1000000 AS b FROM orders), g AS (SELECT id FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id HAVING count(*) >= 1),
k AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 12) SELECT a, b FROM e WHERE a IN (SELECT a FROM k)""")
def gra02_min_degree(spark, d):
    edges = t(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1_000_000).alias("b"))
    few = graph.degrees(edges).filter("degree >= 12").select(F.col("id").alias("a"))
    return edges.join(few, "a", "left_semi").select("a", "b")


@query("""WITH e AS (SELECT c_nationkey AS a, 100 + c_custkey % 9 AS b, count(*)::DOUBLE AS w FROM customer GROUP BY ALL), p AS (SELECT id, id % 5 AS part FROM (SELECT a AS id FROM e UNION SELECT b FROM e)),
x AS (SELECT e.w, pa.part AS pa, pb.part AS pb FROM e JOIN p pa ON e.a = pa.id JOIN p pb ON e.b = pb.id), m AS (SELECT sum(w) AS m FROM e),
s AS (SELECT part, sum(w) AS d FROM (SELECT pa AS part, w FROM x UNION ALL SELECT pb, w FROM x) GROUP BY part), i AS (SELECT pa AS part, sum(w) AS w FROM x WHERE pa = pb GROUP BY pa)
SELECT round(sum(coalesce(i.w, 0) / m.m - (s.d / (2 * m.m)) ** 2), 9) AS modularity FROM s LEFT JOIN i USING (part), m""")
def clu02_modularity(spark, d):
    edges = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 9 + 100).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    parts = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("part", F.col("id") % 5)
    return graph.modularity(edges, parts)


@query()
def clu01_communities(spark, d):
    """Louvain communities of nations that share customers' segments; no SQL form."""
    edges = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("a"), (F.hash("c_mktsegment") % 5 + 100).cast("long").alias("b")).agg(F.count("*").cast("double").alias("weight"))
    return graph.communities(edges)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


@query("""WITH g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER w < 1800 THEN 0 ELSE 1 END AS new FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
s AS (SELECT user_id, sec, sum(new) OVER (PARTITION BY user_id ORDER BY sec RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(sec) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def ext_sessions(spark, d):
    """A gap of 1,800 seconds or more starts a session (session_window goes on at just 1,800); of a user, rows without a time are one more."""
    w = Window.partitionBy("user_id").orderBy(F.col("sec").asc_nulls_last())
    new = F.when(F.col("sec") - F.lag("sec").over(w) < 1800, 0).otherwise(1)
    s = events(spark, d).select("user_id", "sec", new.alias("new")).withColumn("s", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "s").agg(F.min("sec").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def bench_pricing_summary(spark, d):
    li = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))
