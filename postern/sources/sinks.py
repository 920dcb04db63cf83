"""Sinks: indicator exports, reports from one model with a hash of its data, replaced partitions."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from postern.functions import text


def replace_source(df: DataFrame, path: str) -> None:
    """Write indicators so that the sources in df replace their own partitions and leave others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def indicator_csv(observations: DataFrame, path: str) -> None:
    """type, defanged value, roles, messages."""
    rows = observations.groupBy("type", "value").agg(F.array_join(F.array_sort(F.collect_set("role")), " ").alias("roles"), F.countDistinct("message_id").alias("messages"))
    rows.select("type", F.when(F.col("type").isin("url", "domain", "email", "ip"), text.defang(F.col("value"))).otherwise(F.col("value")).alias("value"), "roles", "messages").write.mode("overwrite").csv(path, header=True, quoteAll=True)


def stix_objects(observations: DataFrame) -> DataFrame:
    """One STIX 2.1 indicator object (JSON) for each distinct observation; ids follow from type and value."""
    quoted = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    patterns = {"url": "url:value", "domain": "domain-name:value", "ip": "ipv4-addr:value", "email": "email-addr:value", "sha256": "file:hashes.'SHA-256'", "md5": "file:hashes.MD5", "sha1": "file:hashes.'SHA-1'"}
    path = F.element_at(F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv]), F.col("type"))
    h = F.sha2(F.concat_ws("|", "type", "value"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    rows = observations.select("type", "value").distinct().filter(path.isNotNull())
    body = F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uuid).alias("id"), F.concat(F.lit("["), path, F.lit(" = '"), quoted, F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"))
    return rows.select(F.to_json(body).alias("object"))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def case_report(rows: DataFrame, clusters: DataFrame | None = None, top: int = 25) -> dict:
    """Counts and the worst messages of analysed rows (bounded: groups and ``top`` rows), with a hash of all of it."""
    by = lambda c: {str(r[0]): r[1] for r in rows.groupBy(c).agg(F.count("*")).orderBy(c).limit(100).collect()}
    worst = [r.asDict() for r in rows.orderBy(F.desc("score"), "message_id").select("message_id", "subject", "score", "class", "severity").limit(top).collect()]
    data = {"by_class": by("class"), "by_severity": by("severity"), "worst": worst, "clusters": [r.asDict() for r in clusters.orderBy(F.desc("size"), "cluster_id").limit(top).collect()] if clusters is not None else []}
    return data | {"sha256": hashlib.sha256(canonical_json(data).encode()).hexdigest()}


def report_markdown(report: dict) -> str:
    out = ["# Case report", "", "| class | messages |", "|---|---|", *[f"| {k} | {v} |" for k, v in report["by_class"].items()], "", "| message | score | class | subject |", "|---|---|---|---|"]
    out += [f"| {r['message_id']} | {r['score']} | {r['class']} | {str(r['subject']).replace('|', '/')} |" for r in report["worst"]]
    return "\n".join([*out, "", f"SHA-256 of the data: `{report['sha256']}`", ""])
