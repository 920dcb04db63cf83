"""Catalogue queries over documents and pages: text, URL, address and hash functions, near-duplicate campaigns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postern.functions import hashing, net, text
from postern.operators import graph, joins, similarity
from postern.plans.relational import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


IPS = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ip: IPv4 literals in the documents."""
    docs = t(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IPS), F.lit(0)))).alias("ip")).filter(net.is_ipv4(F.col("ip")))


ADDRESSES = r"(SELECT doc_id, ip, string_split(ip, '.') AS p FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'))) AS ip FROM documents) WHERE split_part(ip,'.',1)::INT < 256 AND split_part(ip,'.',2)::INT < 256 AND split_part(ip,'.',3)::INT < 256 AND split_part(ip,'.',4)::INT < 256)"


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def fnt01_collapse(spark, d):
    return t(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("flat"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS head FROM documents")
def fnt02_truncate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("head"))


@query(r"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS distinct_n FROM (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 AND length(x) < 40) AS w FROM documents)")
def fnt06_tokens(spark, d):
    words = t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct_n"))


@query()
def fnt07_templates(spark, d):
    """Template and its lower-first profile of each document (look-ahead has no RE2 form)."""
    return t(spark, d, "documents").select("doc_id", text.templatize(F.col("text")).alias("template"), text.templatize(F.col("text"), False).alias("subject_template"))


@query("SELECT a, b, CASE WHEN levenshtein(a, b) > 3 THEN 4 ELSE levenshtein(a, b) END AS d FROM (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)")
def fnt09_capped_edit_distance(spark, d):
    n = t(spark, d, "nation")
    pairs = n.alias("x").join(n.alias("y"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))
    return pairs.select("a", "b", text.capped_levenshtein(F.col("a"), F.col("b"), 3).alias("d"))


@query()
def fnt16_coarse_intent(spark, d):
    return t(spark, d, "documents").select("doc_id", text.coarse_intent(F.col("text")).alias("intent"))


@query(r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,5}[\s.-]\d{3,4}[\s.-]?\d{0,4}'),
lambda p: length(regexp_replace(p, '\D', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(regexp_replace(p, '\D', '', 'g'), '^(19|20)\d{6}$')), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))))), ','), '') AS phones FROM documents WHERE text IS NOT NULL""")
def fnt17_phones(spark, d):
    """All numbers of a text: the operator's own limit of five is left to its callers."""
    return t(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.array_sort(text.phones(F.col("text"), 1_000_000)), ",").alias("phones"))


@query(r"""SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'), lambda x: lower(x)))) AS email FROM documents""")
def fnt17_emails(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query("""SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the','of','and','to','in','is','that','for','with'))) / len(w), 9) AS share FROM (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1 AND length(x) < 40) AS w FROM documents) WHERE len(w) >= 5""".replace("\\\\", "\\"))
def fnt19_language_guess(spark, d):
    share = text.english_share(text.tokens(F.col("text")), ["the", "of", "and", "to", "in", "is", "that", "for", "with"])
    return t(spark, d, "documents").select("doc_id", F.round(share, 9).alias("share")).filter("share is not null")


@query()
def fnt21_wallets(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(text.wallets(F.col("text"))).alias("w")).select("doc_id", "w.kind", "w.value")


@query(r"SELECT page_id, replace(replace(regexp_replace(url, '\bhttp', 'hxxp', 'gi'), '.', '[.]'), '@', '[@]') AS safe FROM pages")
def fnt23_defang(spark, d):
    return t(spark, d, "pages").select("page_id", text.defang(F.col("url")).alias("safe"))


@query("SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s256 FROM documents")
def fnh01_digests(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s256"))


@query("SELECT n_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS h FROM nation")
def fnh02_fnv(spark, d):
    return t(spark, d, "nation").select("n_name", hashing.fnv1a32(F.col("n_name")).alias("h"))


def sketches(spark: SparkSession, d: str) -> DataFrame:
    words = t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    features = words.select("doc_id", text.shingles(F.col("w"), most=None).alias("s"))
    return features.select("doc_id", hashing.minhash(F.col("s")).alias("sketch"))


@query()
def fnh05_minhash_bands(spark, d):
    return sketches(spark, d).select("doc_id", F.explode(hashing.band_keys(F.col("sketch"))).alias("band"))


@query()
def fnh08_simhash(spark, d):
    words = t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", hashing.simhash(text.shingles(F.col("w"), most=None)).alias("simhash"))


@query("SELECT source, 'CL-' || upper(substr(sha256(string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR))), 1, 8)) AS name FROM documents GROUP BY source")
def fnh12_set_names(spark, d):
    ids = F.collect_list(F.col("doc_id").cast("string"))
    return t(spark, d, "documents").groupBy("source").agg(hashing.set_id(ids).alias("name"))


@query(f"SELECT doc_id, ip, p[1] || '.' || p[2] || '.' || p[3] || '.0/24' AS network, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS number FROM {ADDRESSES}")
def fnd04_networks(spark, d):
    return addresses(spark, d).select("doc_id", "ip", net.network(F.col("ip")).alias("network"), net.ipv4_int(F.col("ip")).alias("number"))


@query(f"""SELECT doc_id, ip, NOT (p[1]::INT IN (0, 10, 127) OR p[1]::INT >= 224 OR (p[1]::INT = 172 AND p[2]::INT BETWEEN 16 AND 31) OR (p[1]::INT = 192 AND p[2]::INT = 168) OR (p[1]::INT = 169 AND p[2]::INT = 254) OR (p[1]::INT = 100 AND p[2]::INT BETWEEN 64 AND 127)) AS public FROM {ADDRESSES}""")
def fnd03_public_addresses(spark, d):
    return addresses(spark, d).select("doc_id", "ip", net.is_public(F.col("ip")).alias("public"))


@query(f"""WITH r(cidr, lo, hi) AS (VALUES ('10.0.0.0/8', 167772160, 184549375), ('64.0.0.0/3', 1073741824, 1610612735 - 0), ('152.143.0.0/16', 2559508480, 2559574015))
SELECT doc_id, ip, cidr FROM (SELECT doc_id, ip, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS n FROM {ADDRESSES}) JOIN r ON n BETWEEN lo AND hi""")
def fnd05_cidr_membership(spark, d):
    ranges = spark.createDataFrame([("10.0.0.0/8",), ("64.0.0.0/3",), ("152.143.0.0/16",)], "cidr string")
    ranges = ranges.select("cidr", net.cidr_start(F.col("cidr")).alias("lo"), net.cidr_end(F.col("cidr")).alias("hi"))
    rows = addresses(spark, d).withColumn("n", net.ipv4_int(F.col("ip")))
    return joins.interval_join(rows, "n", ranges, "lo", "hi", 1 << 24).select("doc_id", "ip", "cidr")


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '([^.]+\.[^.]+)$', 1) AS org FROM pages")
def fnd02_hosts(spark, d):
    h = net.host(F.col("url"))
    return t(spark, d, "pages").select("page_id", h.alias("host"), net.registrable(h).alias("org"))


@query()
def fnd14_canonical_urls(spark, d):
    u = net.canonical_url(F.col("url"))
    return t(spark, d, "pages").select("page_id", u.alias("canonical"), net.without_query(u).alias("bare"))


@query()
def fnd12_url_templates(spark, d):
    return t(spark, d, "pages").groupBy(net.url_template(F.col("url")).alias("template")).agg(F.count("*").alias("n"))


@query()
def fnd16_link_flags(spark, d):
    """Flags and risk of every link in the pages."""
    links = t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"), "url")
    full = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).otherwise(F.concat(F.substring_index("url", "/", 3), "href"))
    flags = links.withColumn("link", full).withColumn("flags", net.link_flags(F.col("link")))
    return flags.select("page_id", "link", F.array_join("flags", ",").alias("flags"), net.link_risk(F.col("flags")).alias("risk"))


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), l AS (SELECT DISTINCT CASE WHEN hash_ < 3 THEN org ELSE host END AS name FROM (SELECT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS org, length(host) % 5 AS hash_ FROM h) WHERE hash_ <> 4),
c AS (SELECT page_id, host, regexp_replace(host, '^www\.', '') AS first FROM h), x AS (SELECT page_id, first, unnest(list_transform(range(0, len(string_split(first, '.')) - 1), lambda i: array_to_string(list_slice(string_split(first, '.'), i + 1, len(string_split(first, '.'))), '.'))) AS name FROM c)
SELECT page_id, x.name AS matched, CASE WHEN x.name = first THEN 'host' ELSE 'parent-domain' END AS match_type FROM x JOIN l USING (name)""")
def join17_suffix_join(spark, d):
    h = t(spark, d, "pages").select("page_id", net.host(F.col("url")).alias("host"))
    kind = F.length("host") % 5
    listed = h.filter(kind != 4).select(F.when(kind < 3, net.registrable(F.col("host"))).otherwise(F.col("host")).alias("name")).distinct()
    return joins.suffix_join(h, "host", listed, "name").select("page_id", "matched", "match_type")


@query(r"""WITH p AS (SELECT page_id, url, split_part(url, '?', 1) AS bare, split_part(url, '/', 3) AS host FROM pages), l AS (SELECT * FROM p WHERE page_id % 9 = 0),
m AS (SELECT p.page_id, (SELECT min(url) FROM l WHERE l.url = p.url) AS u, (SELECT min(bare) FROM l WHERE l.bare = p.bare) AS b, (SELECT min(host) FROM l WHERE l.host = p.host) AS h FROM p)
SELECT page_id, CASE WHEN u IS NOT NULL THEN 'exact-url' WHEN b IS NOT NULL THEN 'url-without-query' WHEN h IS NOT NULL THEN 'host-of-listed-url' END AS match_type, coalesce(u, b, h) AS matched FROM m""")
def join18_fallback_chain(spark, d):
    p = t(spark, d, "pages").select("page_id", "url", F.substring_index("url", "?", 1).alias("bare"), F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("host"))
    listed = p.filter("page_id % 9 = 0")
    stages = [("exact-url", F.col("url"), listed, "url"), ("url-without-query", F.col("bare"), listed, "bare"), ("host-of-listed-url", F.col("host"), listed, "host")]
    return joins.fallback_join(p, "page_id", stages).select("page_id", "match_type", "matched")


@query("""WITH w AS (SELECT doc_id, source, list_distinct(string_split(lower(text), ' ')) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.w AS wa, y.w AS wb FROM w x JOIN w y ON x.source = y.source AND x.doc_id < y.doc_id AND least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w)))
SELECT * FROM (SELECT a, b, round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 9) AS j FROM p) WHERE j >= 0.8""")
def set01_jaccard_documents(spark, d):
    """Every pair of documents of a source with a Jaccard of 0.8 or more, over whole texts of any length."""
    pairs = similarity.similar_pairs(t(spark, d, "documents"), "source", F.split(F.lower("text"), " "))
    return pairs.select("a", "b", F.round("j", 9).alias("j")).filter("j >= 0.8")


@query("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS anchors, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<form')) AS forms, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def fnm08_markup_counts(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return t(spark, d, "pages").select("page_id", n("<a ").alias("anchors"), n("<script").alias("scripts"), n("<form").alias("forms"), n("<p>").alias("paragraphs"))


@query()
def campaign_tracing(spark, d):
    """Near-duplicate campaigns: tokens, shingles, MinHash, band blocking, verification on sketches, components, statistics."""
    return campaigns(graph.cut(sketches(spark, d)))


def campaigns(s: DataFrame) -> DataFrame:
    """Campaigns of sketches (doc_id, sketch): equal ones are one representative with n members, and every two
    representatives that share a band are compared; edges and weights count the pairs of members."""
    reps = graph.cut(s.filter(F.exists("sketch", lambda v: v != 0)).groupBy("sketch").agg(F.min("doc_id").alias("rep"), F.collect_list("doc_id").alias("ids"), F.count("*").alias("n")))
    keys = reps.select("rep", F.explode(hashing.band_keys(F.col("sketch"))).alias("band"))
    pairs = joins.all_pairs(keys, "rep", "band")
    side = lambda c, n: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{n}"), F.col("n").alias(f"n{n}"))
    scored = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").select("a", "b", hashing.same_share(F.col("sa"), F.col("sb")).alias("weight"), (F.col("na") * F.col("nb")).alias("pairs"))
    edges = graph.cut(scored.filter("weight >= 0.6"))
    label = graph.components(edges)
    member = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = member.filter("n > 1").select("component", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.lit(1.0).alias("weight"))
    across = edges.join(label.withColumnRenamed("id", "a"), "a").select("component", "pairs", "weight")
    inside = own.union(across).groupBy("component").agg(F.sum("pairs").alias("edges"), F.round(F.sum(F.col("weight") * F.col("pairs")) / F.sum("pairs"), 3).alias("cohesion"))
    size = member.groupBy("component").agg(F.sum("n").alias("size"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")).filter("size > 1")
    density = F.round(F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2), 3)
    confidence = F.when((F.col("cohesion") >= 0.75) & (F.col("density") >= 0.5), "high").when(F.col("cohesion") >= 0.65, "medium").otherwise("low")
    name = hashing.set_id(F.transform("ids", lambda x: x.cast("string")))
    return size.join(inside, "component").withColumn("density", density).select(name.alias("cluster_id"), "component", "size", "edges", "cohesion", "density", confidence.alias("confidence"))
