"""Functions, mail, rules, intelligence, graph, feeds, sinks and streams on hand-written cases."""
import json
import random

import pytest
from pyspark.sql import functions as F

from postern import registry
from postern.functions import hashing, net, text
from postern.operators import correlate, graph, intel, joins, rules, similarity
from postern.plans import textual
from postern.sources import feeds, mail, sinks
from postern.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_murmur3():
    assert (hashing.murmur3_32(b""), hashing.murmur3_32(b"hello"), hashing.murmur3_32(b"", 1)) == (0, 613153351, 0x514E28B7)


@pytest.mark.parametrize("expression, want", [
    (lambda: hashing.fnv1a32(F.lit("hello")), 1335831723),
    (lambda: net.canonical_url(F.lit("HTTP://Evil.Example:80/Login?a=1#frag")), "http://evil.example/Login?a=1"),
    (lambda: net.canonical_url(F.lit("evil.example")), "http://evil.example"),
    (lambda: net.canonical_url(F.lit("ftp://x.example/")), None),
    (lambda: net.host_candidates(F.lit("www.a.b.evil.co.uk")), ["a.b.evil.co.uk", "b.evil.co.uk", "evil.co.uk"]),
    (lambda: net.registrable(F.lit("a.b.example.org")), "example.org"),
    (lambda: net.url_template(F.lit("https://a.example.org/links/Ab3dEf9hIj2k/42?b=1&A=2")), "example.org/links/{tok}/{n}?a&b"),
    (lambda: net.url_template(F.lit("https://example.org/qwertyuiopasd/a%40b/100%/x+y")), "example.org/{tok}/{email}/{n}%/x+y"),
    (lambda: net.url_template(F.lit("https://example.org/oooooooooooo/%34%32")), "example.org/oooooooooooo/{n}"),
    (lambda: text.templatize(F.lit("Invoice #INV-20931 due 21/09/2026"), False), "invoice #inv-{n} due {date}"),
    (lambda: text.collapse(F.lit(" a \n b ")), "a b"),
    (lambda: text.normal_phone(F.lit("+1 (323) 555-9830")), "+13235559830"),
    (lambda: text.capped_levenshtein(F.lit("kitten"), F.lit("sitting!!"), 3), 4),
    (lambda: text.series_key(F.lit("Phishing 2024-01-02 part 3/4: DHL #77")), "phishing dhl"),
    (lambda: net.cidr_end(F.lit("203.0.113.0/24")) - net.cidr_start(F.lit("203.0.113.77/24")), 255),
    (lambda: net.is_public(F.lit("172.20.1.1")), False),
    (lambda: net.network(F.lit("203.0.113.9")), "203.0.113.0/24"),
    (lambda: similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), None),
    (lambda: F.round(similarity.weighted([(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.3), (F.lit(0.0), 0.5)]), 6), 0.5),
    (lambda: F.array_join(net.link_flags(F.lit("http://user:pw@198.51.100.1:8080/x.exe?url=https://a")), ","), "ip-host,credentials-in-url,nonstandard-port,no-tls,file-download,redirect-param"),
    (lambda: hashing.simhash_similarity(F.lit("f" * 16), F.lit("f" * 15 + "0")), 1 - 4 / 64),
    (lambda: text.message_id_template(F.lit("<12345678-1234-1234-1234-123456789abc.77@x.y>")), "{uuid}.{n}"),
])
def test_functions(spark, expression, want):
    assert value(spark, expression()) == want


def eml(sender, subject, body, extra="", kind="text/html"):
    return (f"Received: from mx.out.example (mx.out.example [203.0.113.9]) by mail.corp.example; Mon, 1 Jan 2024 10:00:05 +0000\n{extra}From: {sender}\nTo: bob@corp.example\n"
            f"Subject: {subject}\nMessage-ID: <abc@x.example>\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: {kind}; charset=utf-8\n\n{body}\n").encode()


PASS = "Authentication-Results: mail.corp.example; spf=pass smtp.mailfrom=x; dkim=pass header.d=x; dmarc=pass\n"
FAIL = "Authentication-Results: mail.corp.example; spf=fail; dkim=none; dmarc=fail (p=reject)\n"
LONG = "We write once a month about what is new in our garden centre, with tips for the season and the opening hours. " * 3
CASES = {
    "newsletter": (eml("Garden News <news@garden.example.org>", "Spring tips", f"<p>{LONG}</p><a href='https://garden.example.org/a'>more</a>", PASS + "List-Unsubscribe: <https://garden.example.org/u>\n"), "safe", {"auth.dmarc-pass", "route.esp"}),
    "lookalike": (eml("PayPal Service <service@paypa1.com>", "Verify your account", '<p>Please confirm your identity</p><a href="http://203.0.113.7/login">https://www.paypal.com/signin</a><form><input type=password></form>', FAIL), "danger", {"auth.dmarc-fail", "sender.brand-impersonation", "links.text-mismatch", "links.ip-host", "html.credential-form"}),
    "giftcard": (eml("The Boss <boss@corp.example>", "Quick task", "<p>Are you available? I need gift cards, scratch the codes. Keep this confidential.</p>", "Reply-To: boss.private@gmail.com\n"), "danger", {"sender.reply-to-freemail", "content.intent"}),
    "fake-reply": (eml("Billing <billing@shop.example.net>", "RE: overdue invoice", "<p>The invoice is overdue, send the remittance as soon as possible.</p>"), "caution", {"content.fake-reply"}),
    "bank": (eml("Chase Alerts <alerts@chase.com>", "Your statement is ready", f"<p>{LONG}</p>", PASS), "safe", {"sender.verified-brand"}),
    "macros": (eml("Accounts <a@firm.example.net>", "Invoice", "<p>Open the file and enable content to see the invoice.</p>"), "danger", {"content.enable-content"}),
}


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(name, 0, bytearray(raw)) for name, (raw, _, _) in CASES.items()]
    return {r.path: r for r in rules.analyse(mail.parse(spark.createDataFrame(rows, "path string, idx int, raw binary"))).collect()}


@pytest.mark.parametrize("name", CASES)
def test_golden_mail(analysed, name):
    _, verdict, ids = CASES[name]
    row = analysed[name]
    assert row.verdict == verdict, (row.score, [f.id for f in row.findings])
    assert ids <= {f.id for f in row.findings}
    assert (row["class"] in ("malicious", "suspicious")) == (verdict != "safe") and 1 <= row.score <= 99


def test_route_and_trust(spark):
    """Hand-off to the receiver, the oldest public address without one, and who wrote the results."""
    hop = "idx int, from_host string, ip string, by_host string, at_ms long"
    rows = spark.createDataFrame([
        ("hand-off", [(0, "relay.corp.example", "10.0.0.4", "store.corp.example", None), (1, "mx.out.example", "203.0.114.9", "mx.corp.example", None), (2, "forged.example", "198.52.100.1", "mx.corp.example", None)], [("authentication-results", "mx.corp.example; dmarc=pass")]),
        ("own-public", [(0, "a.corp.example", "203.0.114.1", "b.corp.example", None), (1, "client.example.net", "203.0.114.77", "[10.0.0.9]", None)], [("authentication-results", "evil.example.net; dmarc=pass")]),
        ("oldest", [(0, "x.corp.example", "203.0.114.5", "y.corp.example", None), (1, "n.example.net", "203.0.114.6", "other.example.org", None), (2, "n.example.net", "203.0.114.7", "third.example.org", None)], []),
        ("provider", [(0, "r.google.com", "203.0.114.8", "mx.corp.example", None)], [("authentication-results", " mx.corp.example 1; spf=pass"), ("authentication-results", "x")]),
        ("none", [], []), ("null", None, None),
    ], f"name string, received array<struct<{hop}>>, headers array<struct<key:string,value:string>>")
    receiver = rules.receiver_org(F.col("received"))
    got = {r.name: (r.o, r.t) for r in rows.select("name", rules.origin_ip(F.col("received"), receiver).alias("o"), rules.auth_trusted(F.col("headers"), receiver).alias("t")).collect()}
    assert got == {"hand-off": ("203.0.114.9", True), "own-public": ("203.0.114.77", False), "oldest": ("203.0.114.7", False), "provider": ("203.0.114.8", True), "none": (None, False), "null": (None, False)}


def test_trust_scales_the_pass(analysed):
    weight = {f.id: f.weight for f in analysed["newsletter"].findings}
    assert weight["auth.dmarc-pass"] == -0.6 and analysed["newsletter"].origin_ip == "203.0.113.9"


def test_containers(spark, tmp_path):
    one = CASES["bank"][0]
    (tmp_path / "a.eml").write_bytes(one)
    (tmp_path / "b.mbox").write_bytes(b"From x Mon\n" + one + b"\nFrom y Tue\n" + one.replace(b"statement", b"summary") + b">From the team\n")
    (tmp_path / "c.emlx").write_bytes(str(len(one)).encode() + b"\n" + one + b"<plist></plist>")
    (tmp_path / "d.bin").write_bytes(bytes(range(256)))
    (tmp_path / "e.msg").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + bytes(600))
    (tmp_path / ".hidden").write_bytes(one)
    rows = mail.expand(mail.read_files(spark, str(tmp_path))).collect()
    kinds = sorted((r.format, r.idx, r.error) for r in rows)
    assert kinds == [("eml", 0, None), ("emlx", 0, None), ("error:binary", 0, "binary"), ("mbox", 0, None), ("mbox", 1, None), ("msg", 0, "unsupported-ole")]
    assert next(bytes(r.raw) for r in rows if r.format == "emlx") == one
    assert any(b"\nFrom the team" in bytes(r.raw) for r in rows if r.format == "mbox")
    again = mail.mark_duplicates(mail.expand(mail.read_files(spark, str(tmp_path))).filter("raw is not null"))
    assert again.filter("duplicate_of is not null").count() == 1


def test_hostile_message_is_a_row(spark):
    rows = mail.parse(spark.createDataFrame([("x", 0, bytearray(b"\xff\xfe: \x00\n\n" + b"Content-Type: multipart/mixed\n" * 50))], "path string, idx int, raw binary"))
    assert rows.count() == 1


def test_asof_and_interval(spark):
    marks = spark.createDataFrame([(10, "a"), (20, "b"), (5000, "c")], "start long, name string")
    rows = spark.createDataFrame([(5,), (10,), (19,), (4999,), (9000,)], "k long")
    got = {r.k: r.mark_name for r in joins.asof_join(rows, "k", marks, "start", 64).collect()}
    assert got == {5: None, 10: "a", 19: "a", 4999: "b", 9000: "c"}
    ranges = spark.createDataFrame([(0, 10, "x"), (5, 300, "y")], "lo long, hi long, name string")
    assert sorted((r.k, r.name) for r in joins.interval_join(rows, "k", ranges, "lo", "hi", 64).collect()) == [(5, "x"), (5, "y"), (10, "x"), (10, "y"), (19, "y")]


def test_louvain_splits_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10, 0.1)]
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    got = {r.id: r.community for r in graph.communities(frame).collect()}
    assert {got[i] for i in range(4)} == {0} and {got[i] for i in range(10, 14)} == {10}
    assert {r.component for r in graph.components(frame).collect()} == {0}


def test_components_of_a_chain(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in graph.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_intel_matching(spark):
    obs = spark.createDataFrame([("m", "url", "http://evil.example/a?x=1", "link"), ("m", "domain", "login.evil.example", "link-domain"), ("m", "ip", "203.0.113.77", "origin-ip"), ("n", "sha256", "a" * 64, "attachment"), ("n", "ip", "8.8.8.8", "origin-ip")], "message_id string, type string, value string, role string")
    listed = spark.createDataFrame([("url", "http://evil.example/a", "f1", "phish"), ("domain", "evil.example", "f2", "phish"), ("sha256", "a" * 64, "f3", "mal"), ("ip", "8.8.8.8", "f4", "tor-exit")], "type string, value string, source string, threat string")
    cidrs = spark.createDataFrame([("203.0.113.0/24", "f5")], "cidr string, source string")
    got = {(r.message_id, r.source): (r.match_type, r.strength) for r in intel.match(obs, listed, cidrs).collect()}
    assert got == {("m", "f1"): ("url-without-query", 0.85), ("m", "f2"): ("parent-domain", 0.70), ("m", "f5"): ("cidr", 0.50), ("n", "f3"): ("exact", 0.98), ("n", "f4"): ("exact", 0.0)}
    names = spark.createDataFrame([("f1", "http://evil.example/a", "Parcel kit 2024-01-01"), ("f3", "a" * 64, "daily malware list")], "source string, value string, name string")
    found = {r.series: (r.assessment, r.confidence) for r in intel.associations(intel.match(obs, listed, cidrs), names).collect()}
    assert found == {"parcel kit": ("reported-association", "medium"), "daily malware list": ("possible-association", "low")}


def test_drop_popular(spark):
    domains = spark.createDataFrame([("big.example.com",), ("example.com",), ("evil.net",), *((f"t{i}.host.io",) for i in range(12))], "domain string")
    popular = spark.createDataFrame([("example.com", 50), ("host.io", 500)], "domain string, rank int")
    assert {r.domain for r in intel.drop_popular(domains, popular).collect()} == {"evil.net", *(f"t{i}.host.io" for i in range(12))}


def test_feeds(spark, tmp_path):
    (tmp_path / "hosts").write_text("# comment\n127.0.0.1 evil.example.net\n\n0.0.0.0\tbad.example.org\n")
    assert {r.value for r in feeds.lines(spark, str(tmp_path / "hosts"), "h", "domain", last_word=True).collect()} == {"evil.example.net", "bad.example.org"}
    (tmp_path / "urls.csv").write_text('# id\n"1", "2024-01-01", "HTTP://Evil.example/x,y", "online", "", "phish", "a,b", "ref", "me"\n')
    row = feeds.url_csv(spark, str(tmp_path / "urls.csv"), "u").first()
    assert row.value == "http://evil.example/x,y" and row.first_seen == "2024-01-01"
    (tmp_path / "m.json").write_text(json.dumps({"1": [{"ioc_value": "203.0.113.5:443", "ioc_type": "ip:port"}], "2": [{"ioc_value": "d.example", "ioc_type": "domain"}]}))
    assert {(r.type, r.value) for r in feeds.map_of_lists(spark, str(tmp_path / "m.json"), "t").collect()} == {("ip", "203.0.113.5"), ("domain", "d.example")}
    (tmp_path / "e.json").write_text(json.dumps({"Event": {"uuid": "u1", "info": "Kit", "date": "2024-01-02", "Attribute": [{"type": "ip-dst", "value": "203.0.113.6"}], "Object": [{"Attribute": [{"type": "url", "value": "http://x.example/"}]}]}}))
    events, indicators = feeds.events(spark, str(tmp_path / "e.json"), "s")
    assert events.first().attribute_count == 2 and {r.value for r in indicators.collect()} == {"203.0.113.6", "http://x.example"}
    (tmp_path / "c.json").write_text('{"cidr":"203.0.113.0/24","sblid":"S1"}\n{"type":"metadata"}\n')
    assert feeds.cidr_lines(spark, str(tmp_path / "c.json"), "d").collect()[0].end - 255 == feeds.cidr_lines(spark, str(tmp_path / "c.json"), "d").collect()[0].start
    a = feeds.lines(spark, str(tmp_path / "hosts"), "h", "domain", last_word=True).withColumn("first_seen", F.lit("1"))
    b = feeds.lines(spark, str(tmp_path / "hosts"), "h", "domain", last_word=True).filter("value like 'evil%'").withColumn("first_seen", F.lit("2")).withColumn("last_seen", F.lit("3"))
    assert {(r.value, r.first_seen, r.last_seen) for r in feeds.accumulate(a, b).collect()} == {("evil.example.net", "1", "3"), ("bad.example.org", "1", None)}


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([("m", "url", "http://evil.example/a", "link"), ("n", "url", "http://evil.example/a", "link"), ("n", "phone", "+13235559830", "body")], "message_id string, type string, value string, role string")
    sinks.indicator_csv(obs, str(tmp_path / "csv"))
    assert {(r.value, r.messages) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("hxxp://evil[.]example/a", "2"), ("+13235559830", "1")}
    objects = [json.loads(r.object) for r in sinks.stix_objects(obs).collect()]
    assert len(objects) == 1 and objects[0]["pattern"] == "[url:value = 'http://evil.example/a']" and objects[0]["id"].startswith("indicator--")
    rows = spark.createDataFrame([("m", "s", 80, "malicious", "high")], "message_id string, subject string, score int, class string, severity string")
    report = sinks.case_report(rows)
    assert report["by_class"] == {"malicious": 1} and report == sinks.case_report(rows) and "| m | 80 |" in sinks.report_markdown(report)


def test_streams(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for n, name in enumerate(("a", "b", "c")):
        (landing / f"{name}.eml").write_bytes(CASES["bank"][0] if n < 2 else CASES["macros"][0])
    jobs.upsert(jobs.intake(spark, str(landing)).select("path", "sha256", "format"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    schema = "message_id string, from_addr string, sent_ms long"
    spark.createDataFrame([("1", "a@x", 1), ("2", "a@x", 2), ("1", "a@x", 1), ("3", "b@x", 1)], schema).coalesce(1).write.json(str(tmp_path / "mail"))
    history = jobs.sender_history(spark.readStream.schema(schema).json(str(tmp_path / "mail")))
    jobs.upsert(history, str(tmp_path / "seen"), str(tmp_path / "ck2")).awaitTermination(120)
    assert {(r.message_id, r.seen) for r in spark.read.parquet(str(tmp_path / "seen")).collect()} == {("1", 0), ("2", 1), ("3", 0)}


def test_evidence_families(spark):
    obs = spark.createDataFrame([("a", "sha256", "f" * 64, "attachment"), ("b", "sha256", "f" * 64, "attachment"), ("a", "domain", "gmail.com", "from"), ("b", "subject", "x", "y")], "message_id string, type string, value string, role string")
    senders = spark.createDataFrame([("a", "x.org"), ("b", "y.org")], "message_id string, from_org string")
    got = {(r.message_id, r.family): r.strength for r in correlate.keyed(obs, senders).collect()}
    assert got == {("a", "attachment"): 0.95, ("b", "attachment"): 0.95, ("a", "from-domain"): 0.007}


def test_campaigns_of_many_copies(spark):
    same, near, other = [7] * 64, [7] * 60 + [8] * 4, list(range(100, 164))
    rows = [(i, same) for i in range(500)] + [(i, near) for i in range(500, 800)] + [(i, other) for i in range(800, 1100)] + [(2000, [9] * 64), (2001, [0] * 64), (2002, [0] * 64)]
    got = {r.component: r for r in textual.campaigns(spark.createDataFrame(rows, "doc_id long, sketch array<long>")).collect()}
    assert {k: (r.size, r.edges, r.density) for k, r in got.items()} == {0: (800, 800 * 799 // 2, 1.0), 800: (300, 300 * 299 // 2, 1.0)}
    inner = 500 * 499 // 2 + 300 * 299 // 2
    assert got[0].cohesion == round((inner + 500 * 300 * 60 / 64) / (800 * 799 / 2), 3) and got[800].cohesion == 1.0
    distinct = spark.createDataFrame([(i, [7] * 40 + [1000 * i + j for j in range(1, 25)]) for i in range(400)], "doc_id long, sketch array<long>")
    (r,) = textual.campaigns(distinct).collect()  # more partners and more ids in a band than blocked_pairs allows
    assert (r.size, r.edges, r.cohesion) == (400, 400 * 399 // 2, 0.625)


def test_jaccard_of_whole_texts(spark, tmp_path):
    r = random.Random(3)
    rows = [(900, None, "s0"), (901, "", "s0"), (902, "", "s0")]
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(300)] + ["the"]
        for k in range(12):
            rows.append((len(rows), " ".join(f"z{r.randrange(10**6)}" if r.random() < 0.02 * k else x for x in base), f"s{k % 2}"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: (s, set(x.lower().split(" "))) for i, x, s in rows if x is not None}
    want = {(a, b): round(len(x & y) / len(x | y), 9) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if a < b and s == u and 10 * len(x & y) >= 8 * len(x | y)}
    got = {(r.a, r.b): r.j for r in textual.set01_jaccard_documents(spark, str(tmp_path)).collect()}
    assert got == want and (901, 902) in want and len(want) > 20


def test_jaccard_shuffles_less_than_its_texts(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(40_000)}" for _ in range(300)), f"s{i % 2}") for i in range(1500)]
    rows += [(1500 + i, rows[0][1] + f" more{i}", "s0") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert textual.set01_jaccard_documents(spark, str(tmp_path)).count() == 201 * 200 // 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 2 * sum(len(x) for _, x, _ in rows)


def test_jaccard_of_odd_rows(spark, tmp_path):
    """Ids that stand in several sources, repeated rows, missing ids and sources, long sets, sets split over tiles."""
    base = [f"w{i}" for i in range(200)]
    text = lambda *gone: " ".join(x for i, x in enumerate(base) if i not in gone)
    rows = [(1, text(), "a"), (2, text(3), "a"), (2, text(), "b"), (3, text(5), "b"), (3, "another text", "a"), (4, text(7), "a"), (4, text(7), "a"), (None, text(), "a"), (5, text(), None), (6, text(), None), (7, None, "a")]
    rows += [(8, text(*range(40)), "a"), (9, text(*range(41)), "a"), (10, "  x", "c"), (11, "x ", "c"), (12, " ".join(f"v{i}" for i in range(9000)), "c"), (13, " ".join(f"v{i}" for i in range(8000)), "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [(i, s, set(x.split(" "))) for i, x, s in rows if None not in (i, x, s)]
    want = sorted((i, k, round(len(x & y) / len(x | y), 9)) for i, s, x in sets for k, u, y in sets if i < k and s == u and 10 * len(x & y) >= 8 * len(x | y))
    got = lambda: sorted(tuple(p) for p in textual.set01_jaccard_documents(spark, str(tmp_path)).collect())
    assert got() == want and (1, 8, 0.8) in want and (1, 9) not in {p[:2] for p in want} and (12, 13, 0.888888889) in want
    kept, similarity.TILE_WORDS = similarity.TILE_WORDS, 300
    try:
        assert got() == want
    finally:
        similarity.TILE_WORDS = kept


def test_templates_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 100 + "see https://x.example/a on 01/02/2024")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = textual.fnt07_templates(spark, str(tmp_path)).collect()
    assert r.template == r.subject_template == "word " * 100 + "see {url} on {date}"


def test_sketches_of_whole_texts(spark, tmp_path):
    head = " ".join(f"w{i}" for i in range(4100))
    rows = [(k, head + "".join(f" {name}{i}" for i in range(4000))) for k, name in ((1, "x"), (2, "y"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({tuple(r.sketch) for r in textual.sketches(spark, str(tmp_path)).collect()}) == 2
    assert len({r.simhash for r in textual.fnh08_simhash(spark, str(tmp_path)).collect()}) == 2


def test_blocked_pairs_of_common_parts(spark, tmp_path):
    spark.createDataFrame([(i, 1) for i in range(60)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["join22_blocked_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b, r.shared) for r in got} == {(a, b, 1) for a in range(60) for b in range(a + 1, 60)}


def test_sessions_like_their_sql(spark, tmp_path):
    """Gaps of 1,799, 1,800 and 1,801 seconds, equal times, rows without user or time."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0.0), (1, 1799.9), (1, 3599.0), (1, 3599.5), (1, 5400.0), (2, 10.0), (2, 10.0), (2, 1810.0), (2, None), (2, None), (3, None), (None, 5.0), (None, 1805.0), (None, 1900.0), (4, -1800.5), (4, -0.5)]
    events = spark.createDataFrame(rows, "user_id long, s double").select("user_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(registry.ORACLE["ext_sessions"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [(r.user_id, r.start, r.n) for r in registry.QUERIES["ext_sessions"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (2, None, 2) in got and len([g for g in got if g[0] == 1]) == 3
