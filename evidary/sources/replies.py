"""Structured replies as a table: unwrap, repair, parse, split good from bad."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidary.functions.text import col

_CLOSING = {"{": "}", "[": "]"}
# One step of the scan: a whole string literal, or a bracket.
_STEP = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)
_LOOSE_COMMA = re.compile(r",(\s*[}\]])")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
# Unicode categories that cannot be written into a document.
_UNWRITABLE = ("Cc", "Cf", "Cs", "Co", "Cn", "Zl", "Zp")


def strip_fence(text: Column | str) -> Column:
    """The inside of a fenced block when the whole reply is one."""
    fenced = r"(?s)^\s*```(?:json|JSON)?\s*\n(.*?)\n?\s*```\s*$"
    c = col(text)
    return F.when(c.rlike(fenced), F.regexp_replace(c, fenced, "$1")).otherwise(F.trim(c))


def _first_value(body: str) -> str | None:
    """The first balanced object or array, or None."""
    stack: list[str] = []
    start = -1
    first = next((i for i, ch in enumerate(body) if ch in _CLOSING), None)
    if first is None:
        return None
    for step in _STEP.finditer(body, first):
        token = step.group(0)
        if token in _CLOSING:
            if not stack:
                start = step.start()
            stack.append(token)
        elif token in ("}", "]") and stack:
            opener = stack.pop()
            if not stack:
                return body[start : step.end()] if _CLOSING[opener] == token else None
    return None


def _loads(text: object) -> object:
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def _unwrapped(value: object, fields: frozenset[str]) -> object:
    """Peel one envelope key that is no field of the wanted object."""
    if isinstance(value, dict) and len(value) == 1:
        key, inner = next(iter(value.items()))
        if isinstance(inner, dict) and key not in fields:
            return inner
    return value


def _object_of(reply: str | None, fields: frozenset[str], nested: frozenset[str]) -> str | None:
    fragment = _first_value(reply) if reply else None
    if fragment is None:
        return None
    value = _loads(fragment)
    if value is None:
        value = _loads(_LOOSE_COMMA.sub(r"\1", fragment))
    value = _unwrapped(value, fields)
    if not isinstance(value, dict):
        return None
    # A structure that came back as text: the whole object in one string, or single fields.
    texts = {k: _loads(v) for k, v in value.items() if isinstance(v, str) and v.strip()[:1] in "[{"}
    if len(value) == 1 and texts:
        inner = _unwrapped(next(iter(texts.values())), fields)
        if isinstance(inner, dict):
            value = inner
    value = {k: (texts[k] if k in nested and texts.get(k) is not None else v) for k, v in value.items()}
    return json.dumps(value, ensure_ascii=False)


def reply_object(text: Column | str, fields: list[str], nested: list[str] = ()) -> Column:
    """The reply's object as JSON text; null when it holds none."""
    names, inner = frozenset(fields), frozenset(nested)

    @F.pandas_udf("string")
    def unpack(replies: pd.Series) -> pd.Series:
        return replies.map(lambda r: _object_of(r, names, inner))

    return unpack(strip_fence(text))


def parse_replies(
    df: DataFrame, text: str, schema: str, nested: list[str] = (), known: list[str] = (), required: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Replies read into ``schema``, and those that could not be.

    Columns named in ``known`` are ours and win over whatever the reply said.
    """
    fields = df.sparkSession.createDataFrame([], schema).columns
    parsed = df.withColumn("_object", reply_object(text, fields, list(nested))).withColumn(
        "_reply", F.from_json("_object", schema)
    )
    good = F.col("_reply").isNotNull() & F.col("_object").isNotNull()
    for name in required:
        good = good & F.col(f"_reply.{name}").isNotNull()
    others = [c for c in df.columns if c != text and c not in fields]
    rows = parsed.filter(good).select(
        *others, *[F.col(n) if n in known else F.col(f"_reply.{n}").alias(n) for n in fields]
    )
    bad = parsed.filter(~good).select(
        *df.columns,
        F.when(F.col("_object").isNull(), F.lit("no JSON object")).otherwise(F.lit("fields missing")).alias("problem"),
    )
    return rows, bad


def _decoded(text: str | None) -> str | None:
    if text is None or "\\u" not in text:
        return text

    def one(match: re.Match) -> str:
        char = chr(int(match.group(1), 16))
        keep = ord(char) < 0x80 or unicodedata.category(char) in _UNWRITABLE
        return match.group(0) if keep else char

    return _ESCAPE.sub(one, text)


def decode_escapes(text: Column | str) -> Column:
    """Spelled-out ``\\uXXXX`` above ASCII back to the character it names."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(_decoded)

    return decode(col(text))


def repair_escapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same over several columns, arrays of strings included.

    Rows without an escape never reach Python.
    """
    kinds = dict(df.dtypes)
    scalar = [c for c in columns if kinds[c] == "string"]
    arrays = [c for c in columns if kinds[c] == "array<string>"]
    probe = F.lit(False)
    for c in scalar:
        probe = probe | F.coalesce(F.contains(F.col(c), F.lit("\\u")), F.lit(False))
    for c in arrays:
        probe = probe | F.coalesce(
            F.exists(F.col(c), lambda x: F.contains(x, F.lit("\\u"))), F.lit(False)
        )
    mark = "\u0001"
    touched = df.filter(probe)
    for c in scalar:
        touched = touched.withColumn(c, decode_escapes(c))
    for c in arrays:
        joined = decode_escapes(F.array_join(c, mark))
        touched = touched.withColumn(
            c, F.when(F.size(c) > 0, F.split(joined, mark, -1)).otherwise(F.col(c))
        )
    return df.filter(~probe).unionByName(touched)
