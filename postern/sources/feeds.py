"""Readers of threat lists: each turns one published form into the common ``indicators`` rows.

Fetching is not Spark's concern: the readers take landed files.  Rows that normalise to nothing are dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postern.functions import net
from postern.operators.intel import normalise

COLUMNS = ["source", "type", "value", "first_seen", "last_seen", "threat", "family", "tags", "confidence", "reference"]


def _rows(df: DataFrame, source: str, kind: Column, value: Column, **more: Column) -> DataFrame:
    types = {"first_seen": "string", "last_seen": "string", "threat": "string", "family": "string", "tags": "string", "confidence": "int", "reference": "string"}
    out = df.select(F.lit(source).alias("source"), kind.alias("type"), normalise(kind, value).alias("value"), *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    return out.filter("value is not null").dropDuplicates(["source", "type", "value"])


def lines(spark: SparkSession, path: str, source: str, kind: str, last_word: bool = False, threat: str | None = None) -> DataFrame:
    """One value on each line; comments and empty lines go.  last_word reads host files (address, white space, name)."""
    text = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not v rlike '^[#;!]'")
    value = F.element_at(F.split("v", r"\s+"), -1) if last_word else F.col("v")
    return _rows(text, source, F.lit(kind), value, threat=F.lit(threat))


def url_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """id, dateadded, url, url_status, last_online, threat, tags, link, reporter."""
    schema = "id string, added string, url string, status string, last_online string, threat string, tags string, link string, reporter string"
    df = spark.read.csv(path, schema=schema, comment="#", quote='"', escape='"', ignoreLeadingWhiteSpace=True)
    return _rows(df, source, F.lit("url"), F.col("url"), first_seen=F.col("added"), last_seen=F.coalesce("last_online", "added"), threat=F.col("threat"), tags=F.col("tags"), reference=F.col("link"))


def hash_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """first_seen, sha256, md5, sha1, family: three rows for each sample."""
    df = spark.read.csv(path, schema="first_seen string, sha256 string, md5 string, sha1 string, family string", comment="#", quote='"', escape='"', ignoreLeadingWhiteSpace=True)
    df = df.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("sha256", "md5", "sha1")])).alias("h"))
    return _rows(df, source, F.col("h.k"), F.col("h.v"), first_seen=F.col("first_seen"), family=F.col("family"), threat=F.lit("malware"))


def map_of_lists(spark: SparkSession, path: str, source: str) -> DataFrame:
    """{"id": [{"ioc_value": …, "ioc_type": …}, …]}: a port is cut off an address."""
    schema = "map<string,array<struct<ioc_value:string,ioc_type:string,threat_type:string,malware_printable:string,first_seen_utc:string,last_seen_utc:string,confidence_level:int,reference:string>>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("k", "list")).select(F.explode("list").alias("r")).select("r.*")
    kind = F.when(F.col("ioc_type").contains("ip"), "ip").when(F.col("ioc_type").contains("url"), "url").when(F.col("ioc_type").contains("domain"), "domain").when(F.col("ioc_type").contains("sha256"), "sha256").when(F.col("ioc_type").contains("sha1"), "sha1").when(F.col("ioc_type").contains("md5"), "md5")
    value = F.when(kind == "ip", F.regexp_replace("ioc_value", r":\d+$", "")).otherwise(F.col("ioc_value"))
    return _rows(df.filter(kind.isNotNull()), source, kind, value, first_seen=F.col("first_seen_utc"), last_seen=F.col("last_seen_utc"), threat=F.col("threat_type"), family=F.col("malware_printable"), confidence=F.col("confidence_level"), reference=F.col("reference"))


def address_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    """[{"ip_address": …, "malware": …}, …]"""
    df = spark.read.json(path, schema="ip_address string, malware string, first_seen string, last_online string", multiLine=True)
    return _rows(df, source, F.lit("ip"), F.col("ip_address"), first_seen=F.col("first_seen"), last_seen=F.col("last_online"), family=F.col("malware"), threat=F.lit("c2"))


def cidr_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """{"cidr": …} on each line -> cidr, source, start, end."""
    df = spark.read.json(path, schema="cidr string, sblid string").filter("cidr is not null and cidr rlike '^[0-9.]+/[0-9]+$'")
    return df.select("cidr", F.lit(source).alias("source"), net.cidr_start(F.col("cidr")).alias("start"), net.cidr_end(F.col("cidr")).alias("end"), F.col("sblid").alias("reference"))


def events(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Event files {"Event": {…, "Attribute": […], "Object": [{"Attribute": […]}]}} -> events and event_indicators."""
    attribute = "struct<type:string,value:string,category:string,to_ids:boolean,comment:string>"
    schema = f"Event struct<uuid:string,info:string,date:string,Orgc:struct<name:string>,threat_level_id:string,Attribute:array<{attribute}>,Object:array<struct<Attribute:array<{attribute}>>>>"
    e = spark.read.json(path, schema=schema, multiLine=True).select("Event.*").filter("uuid is not null")
    none = F.array().cast(f"array<{attribute}>")
    every = F.concat(F.coalesce("Attribute", none), F.flatten(F.coalesce(F.transform("Object", lambda o: F.coalesce(o["Attribute"], none)), F.array(none))))
    rows = e.select("uuid", "info", F.explode(every).alias("a")).select("uuid", "info", "a.*")
    kind = F.when(F.col("type").isin("ip-src", "ip-dst"), "ip").when(F.col("type").isin("domain", "hostname"), "domain").when(F.col("type").isin("url", "link"), "url").when(F.col("type").isin("email-src", "email"), "email").when(F.col("type") == "email-subject", "subject").when(F.col("type").isin("md5", "sha1", "sha256", "filename", "btc"), F.col("type"))
    indicators = rows.withColumn("kind", kind).filter("kind is not null").select(F.lit(source).alias("source"), F.col("uuid").alias("event_id"), F.col("info").alias("name"), F.col("kind").alias("type"), normalise(F.col("kind"), F.col("value")).alias("value"), "category", "to_ids", "comment").filter("value is not null").distinct()
    return e.select(F.lit(source).alias("source"), F.col("uuid").alias("id"), F.col("info").alias("name"), F.to_date("date").alias("date"), F.col("Orgc.name").alias("org"), F.col("threat_level_id").cast("int").alias("threat_level"), F.size(every).alias("attribute_count")), indicators


def popular(spark: SparkSession, path: str) -> DataFrame:
    """rank,domain"""
    return spark.read.csv(path, schema="rank int, domain string").filter("rank is not null").select(F.lower("domain").alias("domain"), "rank")


def as_ranges(spark: SparkSession, path: str) -> DataFrame:
    """start,end,asn,country,name (tab-separated), IPv4 as numbers."""
    df = spark.read.csv(path, sep="\t", schema="start string, end string, asn int, country string, name string")
    return df.select(net.ipv4_int(F.col("start")).alias("start"), net.ipv4_int(F.col("end")).alias("end"), "asn", "name").filter("start is not null")


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """A feed that shows a moving window: what was seen stays, first_seen is kept, last_seen is the newer one."""
    keys = ["source", "type", "value"]
    a, b = old.select(*COLUMNS).alias("a"), new.select(*COLUMNS).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    pick = lambda c: (F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in (*keys, "first_seen") else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).alias(c)
    return both.select(*[pick(c) for c in COLUMNS])
