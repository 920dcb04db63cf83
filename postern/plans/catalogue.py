"""Catalogue queries of the investigation API over the star-schema tables: lists, counts, joins, sorts and sets.

Orders stand for messages, their lines for observations (a part seen in an order in a role), parts for indicators,
suppliers for sources, customers for cases; conversations for chains of hops; events for jobs and sightings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postern.plans.relational import events, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rank_of(c: Column | str, values: list[str]) -> Column:
    """Position of a value in a list from the worst (largest) on; 0 for what is not in it."""
    out = F.lit(0)
    for i, v in enumerate(values):
        out = F.when(F.col(c) == v if isinstance(c, str) else c == v, F.lit(len(values) - i)).otherwise(out)
    return out


VERDICTS = ["F", "P", "O"]
RANK = "CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END"


# Filters

@query("""SELECT o_orderkey, class, severity FROM (SELECT o_orderkey, o_custkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS class, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS severity,
coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END, TIMESTAMP '1998-06-01 00:00:00') AS sent FROM orders)
WHERE class IN ('unknown', 'F') AND severity IN ('none', '1-URGENT') AND sent BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-01-01 00:00:00' AND o_custkey % 3 = 1""")
def filt05_graph_filter(spark, d):
    at = F.coalesce(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")), F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    rows = t(spark, d, "orders").withColumn("class", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown"))).withColumn("severity", F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("none")))
    span = [F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01 00:00:00", "1999-01-01 00:00:00")]
    return rows.filter(F.col("class").isin("unknown", "F") & F.col("severity").isin("none", "1-URGENT") & at.cast("timestamp_ntz").between(*span) & (F.col("o_custkey") % 3 == 1)).select("o_orderkey", "class", "severity")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND (contains(lower(o_orderpriority), 'urg') OR contains(CAST(o_custkey AS VARCHAR), '77')))
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def filt06_history(spark, d):
    found = t(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.contains(F.lower("o_orderpriority"), F.lit("urg")) | F.contains(F.col("o_custkey").cast("string"), F.lit("77"))))
    page = found.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("o_orderkey", "o_custkey", "total")  # the total is one row


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS keys, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, max(o_totalprice) AS most FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'unknown') AS segment, coalesce(n, 0) AS n, coalesce(failed, 0) AS failed, coalesce(most, 0.0) AS most, coalesce(array_to_string(keys[1:5], ','), '') AS top FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def filt09_summary_shape(spark, d):
    """One fixed shape for every row, whatever is missing; the five first findings only."""
    heaviest = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("r", F.row_number().over(heaviest))
    top = F.array_sort(F.array_agg(F.when(F.col("r") <= 5, F.struct("r", "o_orderkey"))))
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.max("o_totalprice").alias("most"), top.alias("top"))
    rows = t(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    keys = F.transform("top", lambda x: x["o_orderkey"].cast("string"))
    return rows.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("unknown")).alias("segment"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("failed", F.lit(0)).alias("failed"),
                       F.coalesce("most", F.lit(0.0)).alias("most"), F.coalesce(F.array_join(keys, ","), F.lit("")).alias("top"))


@query("""SELECT page_id, array_to_string(list_filter(string_split(split_part(split_part(url, '://', 2), '?', 1), '/'), lambda x: NOT regexp_matches(x, '^(www\\.|m\\.|blog\\.)')), ' ') AS kept FROM pages""".replace("\\\\", "\\"))
def filt12_exclusion_pattern(spark, d):
    parts = F.split(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), "/")
    return t(spark, d, "pages").select("page_id", F.array_join(F.filter(parts, lambda x: ~x.rlike(r"^(www\.|m\.|blog\.)")), " ").alias("kept"))


@query("SELECT event_id FROM (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS sec, floor(epoch(ts))::BIGINT + CAST(value * 100 AS BIGINT) AS expires FROM events) WHERE expires < 1704080000 OR (event_type = 'view' AND sec < 1704080000 - 1800)")
def filt13_expired_or_idle(spark, d):
    rows = events(spark, d).withColumn("expires", F.col("sec") + F.round(F.col("value") * 100).cast("long"))
    return rows.filter("expires < 1704080000 or (event_type = 'view' and sec < 1704080000 - 1800)").select("event_id")


@query(r"""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status-enum' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') THEN 'priority-pattern' END,
CASE WHEN o_totalprice < 5000 THEN 'price-minimum' END, CASE WHEN o_orderdate IS NULL THEN 'date-required' END], lambda x: x IS NOT NULL)) AS rule FROM orders) GROUP BY rule""")
def filt14_conformance(spark, d):
    rules = [("status-enum", ~F.col("o_orderstatus").isin("F", "O")), ("priority-pattern", ~F.col("o_orderpriority").rlike("^[1-3]-[A-Z]+$")), ("price-minimum", F.col("o_totalprice") < 5000), ("date-required", F.col("o_orderdate").isNull())]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return t(spark, d, "orders").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, len(list_filter(w, lambda x: x > 0.05)) AS risk, len(list_filter(w, lambda x: x < 0.03)) AS trust, len(list_filter(w, lambda x: x BETWEEN 0.03 AND 0.05)) AS neutral
FROM (SELECT l_orderkey, list(l_discount) AS w FROM lineitem GROUP BY l_orderkey HAVING count(*) < 9)""")
def filt15_slices(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("w")).filter(F.size("w") < 9)
    return rows.select("l_orderkey", F.size(F.filter("w", lambda x: x > 0.05)).alias("risk"), F.size(F.filter("w", lambda x: x < 0.03)).alias("trust"), F.size(F.filter("w", lambda x: x.between(0.03, 0.05))).alias("neutral"))


# Joins

@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 40")
def join03_messages_with_results(spark, d):
    return t(spark, d, "lineitem").filter("l_quantity > 40").join(t(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@query("SELECT l_orderkey, p_partkey, p_brand, max(l_discount) AS strength FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.08 GROUP BY ALL")
def join04_matches_with_indicators(spark, d):
    rows = t(spark, d, "lineitem").filter("l_discount >= 0.08").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey", "p_partkey", "p_brand").agg(F.max("l_discount").alias("strength"))


@query("SELECT DISTINCT l_orderkey AS message, p_brand AS node, l_returnflag AS role FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 = 3")
def join05_graph_observations(spark, d):
    rows = t(spark, d, "lineitem").filter("l_orderkey % 10 = 3").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("message"), F.col("p_brand").alias("node"), F.col("l_returnflag").alias("role")).distinct()


@query("SELECT DISTINCT l_partkey, o_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey < 60")
def join06_messages_by_indicator(spark, d):
    return t(spark, d, "lineitem").filter("l_partkey < 60").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_orderkey", "o_custkey").distinct()


@query("""WITH seen AS (SELECT DISTINCT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), allowed AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT s.l_partkey, s.o_custkey AS other FROM seen s JOIN (SELECT l_partkey FROM seen WHERE o_custkey = 7) m ON m.l_partkey = s.l_partkey WHERE s.o_custkey <> 7 AND s.o_custkey IN (SELECT c_custkey FROM allowed)""")
def join07_same_value_elsewhere(spark, d):
    """Values of case 7 in other cases that the reader may see."""
    seen = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("o_custkey").alias("other")).distinct()
    allowed = t(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("other"))
    return seen.filter("other <> 7").join(seen.filter("other = 7").select("l_partkey"), "l_partkey").join(allowed, "other", "left_semi").select("l_partkey", "other")


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48 AND l_returnflag = 'R')")
def join08_observed_indicators(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem").filter("l_quantity > 48 and l_returnflag = 'R'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name").distinct()


@query("SELECT a.conv_id, a.turn, a.role, b.role AS answered_by, length(b.text) AS answer_chars FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def join09_two_keys(spark, d):
    """Rows meet on both keys: each turn and the next one of its conversation."""
    turns = t(spark, d, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answered_by"), F.length("text").alias("answer_chars"))
    return turns.select("conv_id", "turn", "role").join(answers, ["conv_id", "turn"])


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 4)")
def join10_cases_of_a_member(spark, d):
    return t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation").filter("n_nationkey in (1, 4)")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")  # a table of 25 rows


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join11_names_of_members(spark, d):
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")  # 25 rows


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS intel, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS sources FROM part")
def join13_scalar_subqueries(spark, d):
    per = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("intel"), F.countDistinct("l_suppkey").alias("sources"))
    return t(spark, d, "part").join(per, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("intel", F.lit(0)).alias("intel"), F.coalesce("sources", F.lit(0)).alias("sources"))


HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query(f"""WITH hosts AS (SELECT DISTINCT {HOST} AS host FROM pages WHERE page_id % 5 = 0)
SELECT h.host, p.url FROM hosts h JOIN pages p ON (p.url >= 'http://' || h.host AND p.url < 'http://' || h.host || chr(1114111)) AND {HOST.replace('url', 'p.url')} = h.host
QUALIFY row_number() OVER (PARTITION BY h.host ORDER BY p.url, p.page_id) <= 4""")
def join19_prefix_range(spark, d):
    """The first four http URLs of each host: an equal join on the host in place of a range scan for each."""
    pages = t(spark, d, "pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    hosts = pages.filter("page_id % 5 = 0").select("host").distinct()
    order = Window.partitionBy("host").orderBy("url", "page_id")
    found = pages.filter(F.col("url").startswith("http://")).join(hosts, "host", "left_semi")
    return found.withColumn("r", F.row_number().over(order)).filter("r <= 4").select("host", "url")


@query("""WITH k AS (SELECT l_partkey AS key, l_orderkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
p AS (SELECT a.id, b.id AS candidate, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND b.r < a.r AND b.r >= a.r - 60 GROUP BY ALL)
SELECT id, candidate, shared FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, candidate DESC) <= 300""")
def join25_newest_candidates(spark, d):
    """What each arrival meets in an inverted index: of each of its keys the newest 60 before it, the best 300 in all."""
    newest, top = 60, 300
    keys = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("id")).distinct()
    order = Window.partitionBy("key").orderBy("id")
    listed = keys.withColumn("r", F.row_number().over(order)).withColumn("stretch", F.floor(F.col("r") / newest))
    # rows up to 60 apart stand in one stretch of 60 or in neighbouring ones, so a hot key is many pairs of keys
    before = listed.select("key", F.col("id").alias("candidate"), F.col("r").alias("q"), F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    pairs = listed.join(before, ["key", "stretch"]).filter(f"q < r and q >= r - {newest}").groupBy("id", "candidate").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("candidate"))
    return pairs.withColumn("n", F.row_number().over(best)).filter(f"n <= {top}").drop("n")


@query("SELECT DISTINCT f AS a, id AS b FROM (SELECT l_orderkey AS id, min(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey) AS f FROM lineitem) WHERE f < id")
def join27_star_per_key(spark, d):
    """The first owner of a key is linked to each later one, so a key of n rows makes n - 1 links."""
    keys = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("b"))
    first = keys.groupBy("l_partkey", "l_suppkey").agg(F.min("b").alias("a"))
    return keys.join(first, ["l_partkey", "l_suppkey"]).filter("a < b").select("a", "b").distinct()


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'part ' || l_partkey) AS label FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = l_partkey WHERE l_orderkey % 20 = 1")
def join28_node_labels(spark, d):
    names = t(spark, d, "part").filter("p_size > 20").select("p_partkey", "p_name")
    return t(spark, d, "lineitem").filter("l_orderkey % 20 = 1").join(names, F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.concat(F.lit("part "), F.col("l_partkey"))).alias("label"))


KINDS = {"click": ["ECONOMY", "STANDARD"], "purchase": ["PROMO"], "error": ["LARGE", "SMALL", "MEDIUM"]}


@query("""WITH m AS (SELECT * FROM (VALUES ('click', 'ECONOMY'), ('click', 'STANDARD'), ('purchase', 'PROMO'), ('error', 'LARGE'), ('error', 'SMALL'), ('error', 'MEDIUM')) AS v(event_type, kind)),
linked AS (SELECT e.event_id, p_partkey AS node FROM events e JOIN m ON m.event_type = e.event_type JOIN part ON p_type = m.kind AND p_partkey = e.user_id)
SELECT event_id, node FROM linked UNION ALL SELECT event_id, -1 FROM events WHERE event_id NOT IN (SELECT event_id FROM linked)""")
def join29_typed_links(spark, d):
    """Events link to nodes of the kinds that their type maps to; those without one stand alone."""
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    rows = t(spark, d, "events").select("event_id", F.col("user_id").alias("p_partkey"), F.explode_outer(F.element_at(kinds, F.col("event_type"))).alias("p_type"))
    linked = rows.join(t(spark, d, "part").select("p_partkey", "p_type"), ["p_partkey", "p_type"]).select("event_id", F.col("p_partkey").alias("node"))
    alone = t(spark, d, "events").join(linked, "event_id", "left_anti").select("event_id", F.lit(-1).cast("long").alias("node"))
    return linked.union(alone)


@query("SELECT l_partkey, l_orderkey, l_suppkey FROM lineitem WHERE l_partkey IN (3, 17, 58, 91, 120) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def join30_lookup_in_enabled_sources(spark, d):
    enabled = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t(spark, d, "lineitem").filter(F.col("l_partkey").isin(3, 17, 58, 91, 120)).join(enabled, "l_suppkey", "left_semi").select("l_partkey", "l_orderkey", "l_suppkey")


@query("""WITH scope AS (SELECT p_partkey FROM part WHERE p_size < 10), c AS (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, count(*) AS members, count(p_partkey) AS in_scope FROM c LEFT JOIN scope ON p_partkey = l_partkey GROUP BY o_custkey HAVING count(p_partkey) > 0""")
def join31_membership_in_scope(spark, d):
    members = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    scope = t(spark, d, "part").filter("p_size < 10").select("p_partkey")
    return members.join(scope, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("members"), F.count("p_partkey").alias("in_scope")).filter("in_scope > 0")


# Aggregations

@query("SELECT l_returnflag AS kind, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def agg03_progress(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS severity, count(*) AS n FROM orders GROUP BY ALL")
def agg04_severities(spark, d):
    return t(spark, d, "orders").groupBy(F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey AS cluster, max({RANK}) AS verdict, count(*) AS size FROM orders GROUP BY o_custkey ORDER BY verdict DESC, size DESC, cluster LIMIT 6")
def agg09_worst_clusters(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.max(rank_of("o_orderstatus", VERDICTS)).alias("verdict"), F.count("*").alias("size")).orderBy(F.desc("verdict"), F.desc("size"), "cluster").limit(6)


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS messages, count(DISTINCT l_returnflag || l_linestatus) AS roles, max(l_discount) AS suspicious, epoch(min(l_shipdate))::BIGINT AS first_seen, epoch(max(l_shipdate))::BIGINT AS last_seen FROM lineitem GROUP BY l_partkey")
def agg10_indicator_list(spark, d):
    seconds = lambda c: c.cast("timestamp").cast("long")
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("messages"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("roles"), F.max("l_discount").alias("suspicious"),
                                                       seconds(F.min("l_shipdate")).alias("first_seen"), seconds(F.max("l_shipdate")).alias("last_seen"))


@query("SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_discount > 0.04 GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 10)")
def agg12_count_of_groups(spark, d):
    return t(spark, d, "lineitem").filter("l_discount > 0.04").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n")).filter("n >= 10").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def agg13_evidence_bytes(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""WITH e AS (SELECT c_nationkey AS cluster, p_type AS family, p_brand AS value, count(DISTINCT o_orderkey) AS messages, max(l_discount) AS strength
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT cluster, family, value, messages, round(strength * messages, 6) AS weight FROM e QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(strength * messages, 6) DESC, family, value) <= 25""")
def agg19_shared_indicators(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    seen = rows.groupBy(F.col("c_nationkey").alias("cluster"), F.col("p_type").alias("family"), F.col("p_brand").alias("value")).agg(F.countDistinct("o_orderkey").alias("messages"), F.max("l_discount").alias("strength"))
    seen = seen.withColumn("weight", F.round(F.col("strength") * F.col("messages"), 6)).drop("strength")
    best = Window.partitionBy("cluster").orderBy(F.desc("weight"), "family", "value")
    return seen.withColumn("r", F.row_number().over(best)).filter("r <= 25").drop("r")


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT d.source, round_even(avg(d.n_chars) / 100, 0)::BIGINT AS hundreds, (SELECT lang FROM c WHERE c.source IS NOT DISTINCT FROM d.source ORDER BY n DESC, f LIMIT 1) AS example FROM documents d GROUP BY d.source""")
def agg22_rounded_profile(spark, d):
    """Averages rounded half to even; the commonest value, the first seen of equals."""
    docs = t(spark, d, "documents")
    langs = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f")).groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("f"))).alias("example"))
    sizes = docs.groupBy("source").agg(F.bround(F.avg("n_chars") / 100, 0).cast("long").alias("hundreds"))
    return sizes.alias("s").join(langs.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source"))).select("s.source", "hundreds", "example")


@query(f"SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS malicious, count(*) FILTER (WHERE o_orderstatus = 'P') AS suspicious, count(*) FILTER (WHERE o_orderstatus = 'O') AS safe, max(o_totalprice) AS score, max({RANK}) AS worst FROM orders GROUP BY o_custkey")
def agg24_campaign_verdicts(spark, d):
    n = lambda v: F.count_if(F.col("o_orderstatus") == v)
    return t(spark, d, "orders").groupBy("o_custkey").agg(n("F").alias("malicious"), n("P").alias("suspicious"), n("O").alias("safe"), F.max("o_totalprice").alias("score"), F.max(rank_of("o_orderstatus", VERDICTS)).alias("worst"))


@query("""WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AS today FROM orders)
SELECT 'verdict' AS part, o_orderstatus AS name, count(*) AS n, count(*) FILTER (WHERE today) AS n_today FROM o GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'brand', CAST(o_custkey % 40 AS VARCHAR), count(*) AS n, count(*) FILTER (WHERE today) FROM o WHERE o_orderstatus <> 'O' GROUP BY ALL ORDER BY n DESC, 2 LIMIT 8)""")
def agg25_dashboard(spark, d):
    orders = t(spark, d, "orders").withColumn("today", F.col("o_orderdate").cast("timestamp_ntz") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    count = [F.count("*").alias("n"), F.count_if("today").alias("n_today")]
    verdicts = orders.groupBy(F.col("o_orderstatus").alias("name")).agg(*count).select(F.lit("verdict").alias("part"), "name", "n", "n_today")
    brands = orders.filter("o_orderstatus <> 'O'").groupBy((F.col("o_custkey") % 40).cast("string").alias("name")).agg(*count).orderBy(F.desc("n"), "name").limit(8).select(F.lit("brand").alias("part"), "name", "n", "n_today")
    return verdicts.union(brands)


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0) AS hits FROM lineitem GROUP BY l_orderkey")
def agg28_hits(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") > 0).alias("hits"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources, max(l_discount) AS strongest, array_to_string(list_sort(list(DISTINCT coalesce(nullif(l_returnflag, 'N'), l_linestatus))), ',') AS threats FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey")
def agg37_intel_of_indicators(spark, d):
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = t(spark, d, "lineitem").filter("l_quantity > 30").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.max("l_discount").alias("strongest"), names(F.coalesce(F.nullif("l_returnflag", F.lit("N")), "l_linestatus")).alias("threats"))
    return rows.select("l_partkey", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sources"), "strongest", "threats")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten(list([o_orderpriority, o_orderstatus])))), '|') AS every FROM orders GROUP BY o_custkey")
def agg40_distinct_over_arrays(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("x"))  # distinct before it is gathered
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias("every"))


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT sha256(text)) AS hashes FROM conversations GROUP BY conv_id")
def agg41_distinct_versions(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct(F.sha2("text", 256)).alias("hashes"))


# Windows, sorts, sets

@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 2")
def win08_nth_from_last(spark, d):
    return t(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r = 2").select("conv_id", "turn", "role")


#: name: (column, descending)
SORTS = {"key": ("o_orderkey", False), "-key": ("o_orderkey", True), "case": ("o_custkey", False), "-case": ("o_custkey", True), "status": ("o_orderstatus", False), "-date": ("o_orderdate", True), "date": ("o_orderdate", False), "-score": ("o_totalprice", True), "priority": ("o_orderpriority", False)}


def sorted_page(rows: DataFrame, sort: str, page: int = 1, size: int = 50) -> DataFrame:
    """A page (of 500 rows at most) in one of the nine orders; the score, then the key decide between equals."""
    column, down = SORTS[sort]
    key = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_first()
    size = min(size, 500)
    return rows.orderBy(key, F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset((page - 1) * size).limit(size)


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, o_orderkey FROM orders ORDER BY {c} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 20)" for name, (c, down) in SORTS.items()))
def sort01_nine_orders(spark, d):
    orders = t(spark, d, "orders")
    out = None
    for name in SORTS:
        page = sorted_page(orders, name, page=3, size=10).select(F.lit(name).alias("sort"), "o_orderkey")
        out = page if out is None else out.union(page)
    return out


@query("""SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, l_extendedprice DESC, l_linenumber, l_partkey), ',') AS findings FROM lineitem GROUP BY l_orderkey""")
def sort02_findings(spark, d):
    """An array sorted by severity, then weight, then where it stood."""
    key = F.struct((-rank_of("l_returnflag", ["R", "A", "N"])).alias("a"), (-F.col("l_extendedprice")).alias("b"), "l_linenumber", "l_partkey")
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["l_linenumber"].cast("string")), ",").alias("findings"))


@query("SELECT o_custkey AS cluster, count(*) AS size FROM orders GROUP BY o_custkey ORDER BY size DESC, cluster LIMIT 50")
def sort03_clusters(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(50)


@query(f"SELECT o_custkey AS campaign, max({RANK}) AS verdict, count(*) AS size, epoch(max(o_orderdate))::BIGINT AS updated FROM orders GROUP BY o_custkey ORDER BY verdict DESC, size DESC, updated DESC, campaign LIMIT 40")
def sort04_campaigns(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("campaign")).agg(F.max(rank_of("o_orderstatus", VERDICTS)).alias("verdict"), F.count("*").alias("size"), F.max("o_orderdate").cast("timestamp").cast("long").alias("updated"))
    return rows.orderBy(F.desc("verdict"), F.desc("size"), F.desc("updated"), "campaign").limit(40)


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus AS kind, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT kind, count(*) FILTER (WHERE r <= 100) AS shown, count(*) FILTER (WHERE r > 100) AS hidden FROM r GROUP BY kind""")
def sort05_hidden_counts(spark, d):
    orders = t(spark, d, "orders")
    shown = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).groupBy("o_orderstatus").agg(F.count("*").alias("shown"))
    every = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return every.join(F.broadcast(shown), "o_orderstatus", "left").select(F.col("o_orderstatus").alias("kind"), F.coalesce("shown", F.lit(0)).alias("shown"), (F.col("n") - F.coalesce("shown", F.lit(0))).alias("hidden"))  # 100 rows at most


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND floor(epoch(ts))::BIGINT <= 1704100000 ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, event_id LIMIT 20")
def sort06_queue_claim(spark, d):
    return events(spark, d).filter("event_type in ('click', 'error') and sec <= 1704100000").orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id").limit(20).select("event_id", "event_type")


@query("""SELECT name, n FROM (SELECT * FROM (SELECT 'part ' || l_partkey AS name, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, name LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'case ' || o_custkey AS name, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, name LIMIT 6)) ORDER BY n DESC, name LIMIT 7""")
def sort07_merged_top(spark, d):
    def six(table, key, word):
        return t(spark, d, table).groupBy(F.concat(F.lit(word), F.col(key)).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(6)
    return six("lineitem", "l_partkey", "part ").union(six("orders", "o_custkey", "case ")).orderBy(F.desc("n"), "name").limit(7)


@query(f"SELECT kind, array_to_string(list_sort(list(DISTINCT host))[1:40], ',') AS hosts FROM (SELECT page_id % 5 AS kind, {HOST} AS host FROM pages) GROUP BY kind")
def set04_distinct_hosts(spark, d):
    pages = t(spark, d, "pages").select((F.col("page_id") % 5).alias("kind"), F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host")).distinct()
    first = pages.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("host"))).filter("r <= 40")  # cut before it is gathered
    return first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("hosts"))


@query(f"SELECT DISTINCT 'host' AS kind, {HOST} AS value FROM pages UNION SELECT DISTINCT 'url', url FROM pages WHERE page_id % 2 = 0")
def set05_union_of_lists(spark, d):
    pages = t(spark, d, "pages")
    hosts = pages.select(F.lit("host").alias("kind"), F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("value"))
    urls = pages.filter("page_id % 2 = 0").select(F.col("url").alias("value"), F.lit("url").alias("kind"))
    return hosts.unionByName(urls).distinct()


@query("""WITH near AS (SELECT DISTINCT 'case:' || o_custkey AS id, 'case' AS kind FROM orders WHERE o_custkey = 11 UNION SELECT DISTINCT 'order:' || o_orderkey, 'order' FROM orders WHERE o_custkey = 11),
more AS (SELECT DISTINCT 'order:' || l_orderkey AS id, 'order' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_custkey = 11 UNION SELECT DISTINCT 'part:' || l_partkey, 'part' FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_custkey = 11)
SELECT id, kind FROM near UNION SELECT id, kind FROM more""")
def gra05_merged_expansion(spark, d):
    """Two neighbourhoods, one fetched after the other, merged by node id."""
    orders = t(spark, d, "orders").filter("o_custkey = 11")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c)).alias("id")
    near = orders.select(node("case", "o_custkey"), F.lit("case").alias("kind")).union(orders.select(node("order", "o_orderkey"), F.lit("order")))
    lines = t(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    more = lines.select(node("order", "l_orderkey"), F.lit("order").alias("kind")).union(lines.select(node("part", "l_partkey"), F.lit("part")))
    return near.unionByName(more).dropDuplicates(["id"])
