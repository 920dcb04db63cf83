"""Catalogue queries of scalar functions: normal forms, phrases, phones, fragments, hashes, URLs in text, wrappers."""
from __future__ import annotations

from pyspark.sql import functions as F

from postern.functions import hashing, net, text
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


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in dict.fromkeys(values)) + ")"


ODD = "replace(replace(text, 'th', 't' || chr(8203) || 'h'), ' a', ' ' || chr(119834))"


@query(rf"SELECT doc_id, len(regexp_extract_all({ODD}, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{00AD}}\x{{034F}}\x{{180E}}\x{{E0000}}-\x{{E007F}}\x{{E0100}}-\x{{E01EF}}]'))::INT AS hidden, len(regexp_extract_all({ODD}, '[\x{{1D400}}-\x{{1D7FF}}]'))::INT AS styled FROM documents")
def fnt03_hidden_characters(spark, d):
    """Hidden and styled characters of texts into which some were put."""
    odd = F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("t\u200bh")), F.lit(" a"), F.lit(" \U0001d41a"))
    return t(spark, d, "documents").select("doc_id", text.invisible(odd).alias("hidden"), text.styled(odd).alias("styled"))


@query(r"SELECT doc_id, regexp_replace(translate(strip_accents(lower(text)), '’‘`´', ''''''''''), '\s+', ' ', 'g') AS normal FROM documents")
def fnt05_normal_form(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


PHRASES = ["all rights reserved", "cc by", "general public license", "mit license", "the of"]


@query("SELECT doc_id, " + ", ".join(rf"regexp_matches(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'), '(?:^|[^\p{{L}}\p{{N}}]){p.replace(' ', chr(92) + 's+')}(?:$|[^\p{{L}}\p{{N}}])') AS p{i}" for i, p in enumerate(PHRASES)) + " FROM documents WHERE text IS NOT NULL")
def fnt13_phrases(spark, d):
    rows = t(spark, d, "documents").filter("text is not null").select("doc_id", text.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", *[text.holds_phrase(F.col("n"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)])


@query(rf"""SELECT doc_id, round(len(list_filter(w, lambda x: length(x) <= 2 AND x NOT IN {_list(text.SHORT_WORDS)})) / len(w), 9) AS share
FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 25""")
def fnt18_fragments(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(text.fragment_share(F.col("text")), 9).alias("share")).filter("share is not null")


@query(rf"""SELECT doc_id, CASE WHEN len(w) < 5 THEN 'unknown' WHEN len(list_filter(w, lambda x: x IN {_list(text.ENGLISH)})) / len(w) >= 0.08 THEN 'en' WHEN regexp_matches(text, '\p{{Devanagari}}') THEN 'hi' WHEN regexp_matches(text, '\p{{Cyrillic}}') THEN 'ru'
WHEN regexp_matches(text, '\p{{Han}}') THEN 'zh' WHEN regexp_matches(text, '\p{{Arabic}}') THEN 'ar' ELSE 'other' END AS language
FROM (SELECT doc_id, text, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND length(x) < 40) AS w FROM documents WHERE text IS NOT NULL)""")
def fnt19_languages(spark, d):
    return t(spark, d, "documents").filter("text is not null").select("doc_id", text.language(F.col("text")).alias("language"))


UNITS = "list_transform(regexp_extract_all(x, '(?s).'), lambda c: unicode(c)::BIGINT)"
#: The first list item is the start, so that the fold carries it.
UTF16 = f"flatten(list_transform({UNITS}, lambda u: CASE WHEN u < 65536 THEN [u] ELSE [55296 + ((u - 65536) >> 10), 56320 + ((u - 65536) % 1024)] END))"


@query(f"""WITH n AS (SELECT doc_id, substr(coalesce(text, ''), 1, 40) || chr(128231) AS x FROM documents)
SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, {UTF16}), lambda h, u: (xor(h, u) * 16777619) % 4294967296) AS h FROM n""")
def fnh02_fnv_units(spark, d):
    """Over UTF-16 units: a character beyond the first plane is two."""
    head = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit("\U0001f4e7"))
    return t(spark, d, "documents").select("doc_id", hashing.fnv1a32(head).alias("h"))


@query(f"""WITH n AS (SELECT doc_id, substr(coalesce(text, ''), 1, 60) AS x FROM documents),
r AS (SELECT doc_id, list_reduce(list_prepend(3735928559::HUGEINT, {UTF16}::HUGEINT[]), lambda h, u: (xor(h, u) * 2654435761) % 4294967296) AS a, list_reduce(list_prepend(1103547991::HUGEINT, {UTF16}::HUGEINT[]), lambda h, u: (xor(h, u) * 1597334677) % 4294967296) AS b FROM n),
f AS (SELECT doc_id, b, xor((xor(a, a >> 16) * 2246822507) % 4294967296, (xor(b, b >> 13) * 3266489909) % 4294967296) AS one FROM r),
s AS (SELECT doc_id, one, xor((xor(b, b >> 16) * 2246822507) % 4294967296, (xor(one, one >> 13) * 3266489909) % 4294967296) AS two FROM f)
SELECT doc_id, lpad(lower(to_hex(((two % 2097152) * 4294967296 + one)::BIGINT)), 14, '0') AS h FROM s""")
def fnh03_hash53(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing.cyrb53(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("h"))


SAID = "'see (' || url || '). Or WWW.' || page_id || '.example.org/a?b=c, not ftp://x!'"


@query(rf"""SELECT page_id, array_to_string(list_transform(list_transform(regexp_extract_all({SAID}, '(?i)\b(?:https?://|www\.)[^\s<>\x22''`{{}}|\\^\[\]]+'), lambda u: regexp_replace(u, '[.,;:!?)\]}}''\x22\x{{2019}}\x{{201D}}>]+$', '')),
lambda u: CASE WHEN regexp_matches(u, '(?i)^www\.') THEN 'http://' || u ELSE u END), ' ') AS urls FROM pages""")
def fnd10_urls_in_text(spark, d):
    said = F.concat(F.lit("see ("), "url", F.lit("). Or WWW."), F.col("page_id").cast("string"), F.lit(".example.org/a?b=c, not ftp://x!"))
    return t(spark, d, "pages").select("page_id", F.array_join(net.text_urls(said), " ").alias("urls"))


@query("SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'eur01.safelinks.protection.outlook.com' END AS wrapper FROM pages")
def fnd11_unwrapped(spark, d):
    """URLs in one wrapper, in two, and in none, unwrapped again."""
    encoded = F.url_encode("url")
    google = F.concat(F.lit("https://www.google.com/url?sa=t&q="), encoded)
    outlook = F.concat(F.lit("https://eur01.safelinks.protection.outlook.com/?url="), F.url_encode(F.concat(F.lit("https://l.facebook.com/l.php?u="), encoded)), F.lit("&data=1"))
    found = net.unwrap_url(F.when(F.col("page_id") % 3 == 0, google).when(F.col("page_id") % 3 == 1, outlook).otherwise(F.col("url")))
    return t(spark, d, "pages").select("page_id", found.alias("f")).select("page_id", "f.url", "f.wrapper")


def _phrase_count(phrase: str) -> str:
    return f"(length(x) - length(replace(x, '{phrase}', ''))) // {len(phrase)}"


ORACLE["fnt16_coarse_intent"] = (
    "WITH s AS (SELECT doc_id, " + ", ".join(f"{' + '.join(_phrase_count(p) for p in phrases)} AS {name}" for name, phrases in text.INTENTS.items())
    + " FROM (SELECT doc_id, lower(text) AS x FROM documents)) SELECT doc_id, CASE WHEN greatest(" + ", ".join(text.INTENTS) + ") < 2 THEN '' "
    + " ".join(f"WHEN {name} = greatest({', '.join(text.INTENTS)}) THEN '{name}'" for name in text.INTENTS) + " ELSE '' END AS intent FROM s")
