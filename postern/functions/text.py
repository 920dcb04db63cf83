"""Text functions on columns: templates, tokens, phones, wallets, defanging."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Patterns of what changes from one message of a template to the next.
URL = r"(?i)https?://\S+"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
DATE = r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"
HEX = r"(?i)\b[a-f0-9]{8,}\b"
MIXED_ID = r"\b(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{6,}\b"
NUMBER = r"[#№]?\d[\d,.]*"
#: Months as they appear in names of recurring reports.
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
SERIES_DATE = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|{MONTH}[a-z]*\.? \d{{1,2}},? \d{{4}}|\d{{1,2}} {MONTH}[a-z]*,? \d{{4}})\b"


def collapse(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


#: Zero-width characters, soft hyphens and joiners, tag characters, variation selectors.
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{034F}\x{180E}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
STYLED = r"[\x{1D400}-\x{1D7FF}]"
#: Cherokee letters that look like Latin ones.
LOOK_ALIKES = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
_DROPPED = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad\u034f\u180e\U000e0000-\U000e007f\U000e0100-\U000e01ef]")
_SEEN_AS = str.maketrans(LOOK_ALIKES)


def invisible(c: Column) -> Column:
    """Number of zero-width, joining, tag and selector characters."""
    return F.regexp_count(c, F.lit(ZERO_WIDTH)).cast("int")


def styled(c: Column) -> Column:
    """Number of mathematical letters that stand for plain ones."""
    return F.regexp_count(c, F.lit(STYLED)).cast("int")


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", _DROPPED.sub("", x).translate(_SEEN_AS)))


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        x = unicodedata.normalize("NFKC", _DROPPED.sub("", x).translate(_SEEN_AS))
        return _DROPPED.sub("", "".join([ch for ch in unicodedata.normalize("NFKD", x) if not "\u0300" <= ch <= "\u036f"]))
    return texts.map(one)


def deobfuscate(c: Column) -> Column:
    """Without invisible characters, look-alikes and compatibility forms folded.  Spark has no normal forms: Python, in
    Arrow batches, which hands plain ASCII through."""
    return _compatible(c)


def normalize(c: Column) -> Column:
    """Deobfuscated, without accents, lower, with straight quotes and single white space."""
    return F.regexp_replace(F.translate(F.lower(_unaccented(c)), "\u2019\u2018`\u00b4", "''''"), r"\s+", " ")


def split_words(c: Column) -> Column:
    """Lower-case runs of letters and digits, 2 to 39 characters long."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 1) & (F.length(t) < 40))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the normalised text, 2 to 39 characters long."""
    return F.filter(F.split(normalize(c), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 1) & (F.length(t) < 40))


def holds_phrase(normal: Column, phrase: str) -> Column:
    """Whether a normalised text holds a phrase between what are no letters or digits, with any white space inside."""
    words = r"\s+".join(re.escape(w) for w in phrase.split())
    return normal.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){words}(?:$|[^\p{{L}}\p{{N}}])")


#: Short words of common languages that are no fragments.
SHORT_WORDS = (
    "a i to of in on is it at be by or as an we my me no so up do go he us if am pm "
    "de la el en y e o da do em um se lo le du et il di un zu im es er ab ok tv id").split()
#: Common English function words.
ENGLISH = "the and you your to of a in is for on that this with be are we it as have our will please from by at or an if not can has been was any all more account thank".split()


def fragment_share(c: Column) -> Column:
    """The share of words of one or two letters that are no short words; null under 25 words."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(words) >= 25, F.size(F.filter(words, lambda w: (F.length(w) <= 2) & ~w.isin(SHORT_WORDS))) / F.size(words))


def language(c: Column) -> Column:
    """en by its function words, else by the script; unknown under five tokens."""
    words = tokens(c)
    share = F.size(F.filter(words, lambda w: w.isin(ENGLISH))) / F.size(words)
    other = F.when(c.rlike(r"\p{IsDevanagari}"), "hi").when(c.rlike(r"\p{IsCyrillic}"), "ru").when(c.rlike(r"\p{IsHan}"), "zh").when(c.rlike(r"\p{IsArabic}"), "ar").otherwise("other")
    return F.when(F.size(words) < 5, "unknown").when(share >= 0.08, "en").otherwise(other)


def shingles(words: Column, size: int = 3, most: int | None = 4000) -> Column:
    """Distinct runs of size tokens, at most ``most`` (None: all); fewer tokens make one shingle."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs) if most is None else F.slice(F.array_distinct(runs), 1, most))


def templatize(c: Column, with_hex: bool = True) -> Column:
    """Volatile parts become placeholders; with_hex=False is the profile that lowers first and knows no hex step."""
    c = c if with_hex else F.lower(c)
    for pattern, place in ((URL, "{url}"), (EMAIL, "{email}"), (DATE, "{date}"), *(((HEX, "{hex}"),) if with_hex else ()), (MIXED_ID, "{id}"), (NUMBER, "{n}")):
        c = F.regexp_replace(c, pattern, F.lit(place).cast("string"))
    return collapse(F.lower(c))


def local_template(address: Column) -> Column:
    local = F.lower(F.substring_index(address, "@", 1))
    return F.regexp_replace(F.regexp_replace(local, r"\d+", "{n}"), r"[a-z]{12,}", "{w}")


def message_id_template(message_id: Column) -> Column:
    local = F.regexp_extract(message_id, r"<?([^<>@\s]+)@([^<>\s]+)>?", 1)
    for pattern, place in ((r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}"), (r"[A-Za-z0-9+/_-]{16,}={0,2}", "{tok}"), (r"\d+", "{n}"), (r"(?i)[a-f0-9]{6,}", "{hex}")):
        local = F.regexp_replace(local, pattern, F.lit(place))
    return F.when(local != "", local)


def defang(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(c, r"(?i)\bhttp", "hxxp"), F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))


def normal_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits).between(7, 15), F.concat(F.when(F.trim(c).startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))


#: Fixed value: how telephone numbers are written.
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,5}[\s.-]\d{3,4}[\s.-]?\d{0,4}"


def phones(c: Column, most: int = 5) -> Column:
    """Telephone numbers as they stand, of 10 to 15 digits and not eight that begin like a year; distinct, ``most`` at most."""
    digits = lambda p: F.regexp_replace(p, r"\D", "")
    found = F.filter(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), lambda p: F.length(digits(p)).between(10, 15) & ~digits(p).rlike(r"^(19|20)\d{6}$"))
    return F.slice(F.array_distinct(F.transform(found, collapse)), 1, most)


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"), F.lit(0)), F.lower))


def wallets(c: Column, most: int = 20) -> Column:
    """(kind, value) of crypto-currency addresses among alphanumeric runs."""
    def kind(t: Column) -> Column:
        n = F.length(t)
        mixed = t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
        return (F.when((n == 42) & t.rlike("^0x[a-fA-F0-9]{40}$"), "eth").when((n == 95) & t.rlike("^4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}$"), "xmr")
                .when(t.rlike("^bc1[ac-hj-np-z02-9]{25,62}$"), "btc").when((n <= 35) & t.rlike("^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$") & mixed, "btc"))
    runs = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda t: F.length(t).between(26, 95))
    pairs = F.filter(F.transform(runs, lambda t: F.struct(kind(t).alias("kind"), F.when(kind(t) == "eth", F.lower(t)).otherwise(t).alias("value"))), lambda p: p["kind"].isNotNull())
    return F.slice(F.array_distinct(pairs), 1, most)


def series_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), SERIES_DATE, " ")
    c = F.regexp_replace(c, r"(?i)\bpart \d+\s*(?:/|of)\s*\d+\b", " ")
    c = F.regexp_replace(c, r"[#\d]+", " ")
    return collapse(F.regexp_replace(c, r"[|:()\[\]_,.-]+", " "))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(c, "")
    shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
    return F.when(F.length(c) > 0, -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def english_share(words: Column, stop: list[str]) -> Column:
    return F.when(F.size(words) >= 5, F.size(F.filter(words, lambda w: w.isin(stop))) / F.size(words))


def capped_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def count_phrase(c: Column, phrase: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


#: Words that hint at what a lure asks for, by coarse intent.
INTENTS = {
    "credential": ["verify your", "confirm your identity", "password", "sign in", "log in", "mailbox", "storage", "account has been limited", "credentials", "validate"],
    "payment": ["invoice", "payment", "billing", "bank details", "wire transfer", "overdue", "remittance", "settle"],
    "delivery": ["parcel", "package", "delivery", "customs fee", "shipment", "tracking"],
    "document": ["review and sign", "shared", "document", "files", "recording", "view the"],
    "crypto": ["wallet", "seed phrase", "crypto", "bitcoin", "token"],
}


def coarse_intent(c: Column) -> Column:
    """The intent whose phrases occur most, the first of equals, if they occur twice or more; else empty."""
    low = F.lower(c)
    scores = F.array(*[F.struct(sum((count_phrase(low, p) for p in phrases), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, phrases) in enumerate(INTENTS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] >= 2, best["name"]).otherwise(F.lit(""))
