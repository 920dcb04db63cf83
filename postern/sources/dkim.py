"""DKIM canonicalisation and body hashes; signatures themselves need keys from outside and stay "not-checked"."""
from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

RESULT = T.StructType([T.StructField("domain", T.StringType()), T.StructField("selector", T.StringType()), T.StructField("algorithm", T.StringType()), T.StructField("body_hash", T.StringType()), T.StructField("appended", T.LongType()), T.StructField("signed_from", T.BooleanType()), T.StructField("signature", T.StringType())])


def canonical_body(body: bytes, relaxed: bool) -> bytes:
    """Lines end in CRLF, empty lines at the end go; relaxed also folds white space."""
    lines = body.replace(b"\r\n", b"\n").split(b"\n")
    if relaxed:
        lines = [re.sub(rb"[ \t]+", b" ", x).rstrip(b" ") for x in lines]
    while lines and not lines[-1]:
        lines.pop()
    out = b"".join(x + b"\r\n" for x in lines)
    return out if out or relaxed else b"\r\n"


def canonical_header(name: str, value: str, relaxed: bool) -> str:
    return f"{name.lower().strip()}:{' '.join(value.split())}" if relaxed else f"{name}:{value}"


def check(raw: bytes) -> list[tuple]:
    """One result for each of the first five signatures: whether the body hash holds, and what was appended beyond l=."""
    head, _, body = raw.replace(b"\r\n", b"\n").partition(b"\n\n")
    text = re.sub(r"\n[ \t]+", " ", head.decode("utf-8", "replace"))
    out = []
    for value in re.findall(r"(?im)^dkim-signature:(.*)$", text)[:5]:
        tags = {k.strip().lower(): re.sub(r"\s+", "", v) for k, sep, v in (x.partition("=") for x in value.split(";")) if sep}
        algorithm = tags.get("a", "rsa-sha256")
        canon = canonical_body(body, tags.get("c", "simple/simple").partition("/")[2] == "relaxed")
        limit = int(tags["l"]) if tags.get("l", "").isdigit() else len(canon)
        digest = hashlib.new("sha1" if algorithm.endswith("sha1") else "sha256", canon[:limit]).digest()
        state = "none" if "bh" not in tags else "pass" if base64.b64encode(digest).decode() == tags["bh"] else "fail"
        out.append((tags.get("d", "").lower(), tags.get("s"), algorithm, state, max(0, len(canon) - limit), "from" in tags.get("h", "").lower().split(":"), "not-checked"))
    return out


@F.pandas_udf(T.ArrayType(RESULT))
def body_hashes(raw: pd.Series) -> pd.Series:
    names = RESULT.names
    return raw.map(lambda x: [] if x is None else [dict(zip(names, r)) for r in check(bytes(x))])
