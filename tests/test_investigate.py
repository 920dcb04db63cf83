"""DKIM body hashes, the investigation graph, case queries."""
import base64
import hashlib

from pyspark.sql import functions as F

from postern.operators import investigate
from postern.sources import dkim


def signed(body, canon, extra=""):
    digest = base64.b64encode(hashlib.sha256(dkim.canonical_body(body, canon.endswith("relaxed"))).digest()).decode()
    return f"From: a@x.org\nDKIM-Signature: v=1; a=rsa-sha256; c={canon}; d=x.org; s=k1;\n h=from:to; bh={digest}; {extra} b=AAAA\n\n".encode() + body


def test_body_hashes(spark):
    body = b"Hello  there \r\n\r\nSecond\t line\r\n\r\n\r\n"
    assert dkim.canonical_body(body, True) == b"Hello there\r\n\r\nSecond line\r\n" and dkim.canonical_body(b"", False) == b"\r\n" and dkim.canonical_body(b"", True) == b""
    for canon in ("simple/simple", "relaxed/relaxed"):
        assert dkim.check(signed(body, canon))[0][:6] == ("x.org", "k1", "rsa-sha256", "pass", 0, True)
    assert dkim.check(signed(body, "simple/simple") + b"more")[0][3] == "fail"
    row = spark.createDataFrame([(bytearray(signed(body, "relaxed/relaxed")),), (None,)], "raw binary").select(dkim.body_hashes("raw").alias("r")).collect()
    assert row[0].r[0].body_hash == "pass" and row[1].r == []


def frames(spark):
    rows = spark.createDataFrame([("1", "win", 90, "malicious", 10, "a@x", "A"), ("2", "hi", 5, "benign", 20, "b@x", "B"), ("3", "hello", 50, "suspicious", None, "a@x", "A")], "message_id string, subject string, score int, class string, sent_ms long, from_addr string, from_name string")
    rows = rows.withColumn("severity", F.lit("low")).withColumn("confidence", F.lit("low")).withColumn("findings", F.array(F.struct(F.when(F.col("score") > 40, "links.ip-host").otherwise("auth.none").alias("id"))))
    obs = spark.createDataFrame([("1", "email", "a@x", "from"), ("3", "email", "a@x", "from"), ("2", "email", "b@x", "from"), ("1", "url", "http://u", "link")], "message_id string, type string, value string, role string")
    return rows, obs


def test_graph(spark):
    rows, obs = frames(spark)
    nodes, edges = investigate.nodes_and_edges(rows, obs)
    assert nodes.count() == 6 and edges.count() == 4
    best, kept, hidden = investigate.view(nodes, edges, limit=4)
    assert [r.id for r in best.orderBy(F.desc("priority"), "id").collect()][:2] == ["message:1", "message:3"] and sum(r.hidden for r in hidden.collect()) == 2
    near, links, _ = investigate.view(nodes, edges, focus="message:1", depth=2)
    assert {r.id for r in near.collect()} == {"message:1", "message:3", "email:a@x", "url:http://u"} and links.count() == 3


def test_case_queries(spark):
    rows, obs = frames(spark)
    assert [r.message_id for r in investigate.pivot(obs, "email", "a@x", rows).collect()] == ["1", "3"]
    assert [r.message_id for r in investigate.message_list(rows, obs, indicator=("email", "a@x"), finding="links.").collect()] == ["1", "3"]
    assert [r.message_id for r in investigate.message_list(rows, classes=["benign"], text="HI").collect()] == ["2"]
    cases = spark.createDataFrame([("1", "c1"), ("3", "c2"), ("2", "c3")], "message_id string, case_id string")
    members = spark.createDataFrame([("c1", "u"), ("c2", "u")], "case_id string, user_id string")
    assert [(r.value, r.cases) for r in investigate.elsewhere(obs, cases, members, "u", "c1").collect()] == [("a@x", 1)]


def test_audit_chain(spark):
    log, previous = [], None
    for seq, payload in enumerate(["a", "b", "c", "d"]):
        h = hashlib.sha256(((previous or "") + payload).encode()).hexdigest()
        log.append((seq, payload, previous, h))
        previous = h
    schema = "seq int, payload string, previous string, hash string"
    assert investigate.audit_breaks(spark.createDataFrame(log, schema)).count() == 0
    log[2] = (2, "x", *log[2][2:])
    assert [r.seq for r in investigate.audit_breaks(spark.createDataFrame(log, schema)).collect()] == [2]
