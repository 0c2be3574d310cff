"""Enumerations, licences, codes, costs, request keys and table cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidary import fixed
from evidary.functions.numbers import general
from evidary.functions.text import (
    alnum_lower,
    code_array_map,
    col,
    inline,
    let,
    strings,
    strip,
    text_or_empty,
)


def is_export_safe(license_text: Column | str) -> Column:
    """Whether a licence lets the document be passed on."""
    text = inline(F.lower(text_or_empty(license_text)))
    tokens = F.split(F.replace(text, F.lit("-"), F.lit(" ")), " ")
    barred = F.arrays_overlap(tokens, strings(["nc", "nd"]))
    return (text != "") & ~barred & text.isin(*fixed.PERMISSIVE_LICENSES)


def says_true(value: Column | str) -> Column:
    """The string ``false`` is false."""
    return F.lower(strip(text_or_empty(value))) == "true"


def inverse_interaction(kind: Column | str) -> Column:
    return F.element_at(code_array_map(fixed.INVERSE_INTERACTION), col(kind))


def is_structural(kind: Column | str) -> Column:
    return col(kind).isin(*fixed.STRUCTURAL_INTERACTIONS)


def canonical_measure(measure: Column | str) -> Column:
    """Fold a measure name to a known key: whole name first, last word second."""
    text = F.translate(F.lower(text_or_empty(measure)), "²", "2")
    tokens = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    offers = let(tokens, lambda t: F.array(F.array_join(t, ""), F.try_element_at(t, F.lit(-1))))
    known = F.array_intersect(offers, strings(fixed.INTERACTION_CUTOFFS))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(""))


def band_interaction(kind: Column | str, measure: Column | str, value: Column | str) -> Column:
    """structural, strong, moderate, weak or stated."""
    table = fixed.INTERACTION_CUTOFFS
    size = F.abs(col(value))
    strong = code_array_map({k: v[0] for k, v in table.items()})
    moderate = code_array_map({k: v[1] for k, v in table.items()})
    smaller_is_stronger = [k for k, v in table.items() if v[2]]

    def banded(key: Column) -> Column:
        inverted = key.isin(*smaller_is_stronger)
        reaches = lambda cuts: F.when(
            inverted, size <= F.element_at(cuts, key)
        ).otherwise(size >= F.element_at(cuts, key))
        return (
            F.when(key == "", F.lit("stated"))
            .when(reaches(strong), F.lit("strong"))
            .when(reaches(moderate), F.lit("moderate"))
            .otherwise(F.lit("weak"))
        )

    return (
        F.when(is_structural(kind), F.lit("structural"))
        .when(col(value).isNull(), F.lit("stated"))
        .otherwise(let(canonical_measure(measure), banded))
    )


def confidence_rank(confidence: Column | str) -> Column:
    return F.element_at(code_array_map(fixed.CONFIDENCE_RANK), col(confidence))


def confidence_down(confidence: Column | str) -> Column:
    """One step lower, stopping at low."""
    return F.element_at(code_array_map(fixed.CONFIDENCE_DOWN), col(confidence))


def canonical_system(system: Column | str) -> Column:
    """A code system's name, so spellings agree."""
    return alnum_lower(system)


def canonical_codes(codes: Column | str) -> Column:
    """``array<struct<system, code>>`` canonical and distinct, first one kept."""
    return F.array_distinct(
        F.transform(
            col(codes),
            lambda c: F.struct(
                canonical_system(c["system"]).alias("system"), strip(c["code"]).alias("code")
            ),
        )
    )


def borderline(include: Column | str, relevance: Column | str, confidence: Column | str) -> Column:
    """Excluded but relevant, or included on weak grounds."""
    inc = col(include)
    return (~inc & (col(relevance) >= 2)) | (inc & (col(confidence) == "low"))


def shortfall(kept: Column | str, floor: Column | str | int) -> Column:
    bound = F.lit(floor) if isinstance(floor, int) else col(floor)
    return F.greatest(F.lit(0), bound - col(kept))


def prompt_tokens(text: Column | str) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(text_or_empty(text)) / F.lit(4.0)).cast("long") + F.lit(1)


def chunk_tokens(text: Column | str) -> Column:
    """Three characters to a token, rounded up."""
    return F.ceil(F.length(text_or_empty(text)) / F.lit(3.0)).cast("long")


def format_cost(usd: Column | str, calls: Column | str, unpriced: Column | str) -> Column:
    """Never shows an unpriced call as free."""
    shown = F.concat(F.lit("$"), F.format_number(F.coalesce(col(usd), F.lit(0.0)), 4))
    return (
        F.when(col(calls) == 0, F.lit("$0.00"))
        .when(col(unpriced) == 0, shown)
        .when(col(unpriced) == col(calls), F.lit("cost unavailable"))
        .otherwise(F.concat(shown, F.lit(" + "), col(unpriced).cast("string"), F.lit(" unpriced")))
    )


def stamp(moment: Column | str) -> Column:
    """UTC to the second with a trailing Z (C30); the session zone must be UTC."""
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def started_at(run_id: Column | str) -> Column:
    """The timestamp a run id opens with, or null."""
    head = F.substring(col(run_id), 1, 15)
    return F.when(
        head.rlike(r"^\d{8}-\d{6}$"), F.try_to_timestamp(head, F.lit("yyyyMMdd-HHmmss"))
    )


# --- request identity --------------------------------------------------------------

_SECRET = ("api_key", "apikey", "key")
_IDENTITY = ("tool", "email")


def canonical_query(params: Column | str) -> Column:
    """Sorted ``name=value`` pairs without secrets and caller identity.

    ``params`` is ``map<string,string>``.
    """
    kept = F.filter(
        F.map_entries(col(params)), lambda e: ~F.lower(e["key"]).isin(*_SECRET, *_IDENTITY)
    )
    pairs = F.transform(F.array_sort(kept), lambda e: F.concat_ws("=", _quoted(e["key"]), _quoted(e["value"])))
    return F.array_join(pairs, "&")


def _quoted(value: Column) -> Column:
    # Form encoding that leaves tilde as it is and encodes the star, as URL query
    # encoders for forms do on the reading side.
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def request_key(method: Column | str, url: Column | str, params: Column | str) -> Column:
    return F.sha2(
        F.concat(F.upper(col(method)), F.lit(" "), col(url), F.lit("?"), canonical_query(params)), 256
    )


def redact_url(url: Column | str) -> Column:
    """Secret query values replaced."""
    names = "|".join(_SECRET)
    u = col(url)
    cut = F.instr(u, "?")
    base = F.substr(u, F.lit(1), cut)
    query = F.substr(u, cut + 1)
    safe = F.transform(
        F.split(query, "&", -1),
        lambda c: F.regexp_replace(c, rf"(?i)^({names})(?:=.*)?$", "$1=REDACTED"),
    )
    return F.when(cut == 0, u).otherwise(F.concat(base, F.array_join(safe, "&")))


def fingerprint(*parts: Column | str) -> Column:
    """First 16 hex digits over NUL-ended parts."""
    ended = [x for p in parts for x in (col(p), F.lit("\u0000"))]
    return F.substring(F.sha2(F.concat(*ended), 256), 1, 16)


# --- search terms --------------------------------------------------------------------


def untagged_clauses(term: Column | str) -> Column:
    """Words of a query that carry no field tag."""
    bare = F.regexp_replace(col(term), r"(?U)(?:\"[^\"]*\"|[^\s()]+?)\s*\[[^\]]+\]", " ")
    words = F.split(inline(F.translate(bare, "()", "  ")), " ")
    return F.filter(words, lambda w: (w != "") & ~F.upper(w).isin("AND", "OR", "NOT"))


def is_suspect(term: Column | str, translation: Column | str, fields_not_found: Column | str) -> Column:
    """An unknown field, or an all-fields expansion nothing asked for."""
    unknown = F.size(col(fields_not_found)) > 0
    unexplained = (F.size(untagged_clauses(term)) == 0) & (
        F.instr(text_or_empty(translation), fixed.ALL_FIELDS) > 0
    )
    return unknown | unexplained


def query_tags(text: Column | str) -> Column:
    """The field tags a query names, aliases spelled out, appended filters left out."""
    raw = F.transform(
        F.regexp_extract_all(text_or_empty(text), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)),
        lambda t: strip(F.lower(t)),
    )
    aliases = code_array_map(fixed.TAG_ALIASES)
    named = F.transform(raw, lambda t: F.coalesce(F.element_at(aliases, t), t))
    return F.array_except(named, strings(fixed.APPENDED_TAGS))


def expansion_is_mechanical(term: Column | str, translation: Column | str, suspect: Column | str) -> Column:
    """The service only spelled out tags the term already carried."""
    return (
        (text_or_empty(translation) != "")
        & ~col(suspect)
        & (F.size(F.array_except(query_tags(translation), query_tags(term))) == 0)
    )


# --- table cells ----------------------------------------------------------------------


def effect_cell(effect: Column | str, measure: Column | str, raw: Column | str) -> Column:
    """Printed, unverified or none."""
    raw_text = text_or_empty(raw)
    stated = strip(raw_text) != ""
    suffix = F.when(text_or_empty(measure) != "", F.concat(F.lit(" "), col(measure))).otherwise("")
    return (
        F.when(col(effect).isNotNull() & stated, raw_text)
        .when(col(effect).isNotNull(), F.concat(general(effect), suffix))
        .when(~stated, F.lit(fixed.NONE_CELL))
        .when(~raw_text.rlike("[0-9]"), raw_text)
        .otherwise(F.lit(fixed.UNVERIFIED_CELL))
    )


def interaction_cell(
    value: Column | str,
    measure: Column | str,
    raw: Column | str,
    mirrored: Column | str,
    stated_on: Column | str,
) -> Column:
    """The evidence cell of one interaction, with where it was mirrored from."""
    raw_text = text_or_empty(raw)
    lead = F.when(text_or_empty(measure) != "", F.concat(col(measure), F.lit("="))).otherwise("")
    base = (
        F.when(col(value).isNotNull() & (raw_text != ""), raw_text)
        .when(col(value).isNotNull(), F.concat(lead, general(value)))
        .when(strip(raw_text) == "", F.lit(fixed.NONE_CELL))
        .when(~raw_text.rlike("[0-9]"), raw_text)
        .otherwise(F.lit(fixed.UNVERIFIED_CELL))
    )
    origin = F.when(
        col(stated_on) > 0, F.concat(F.lit("mirrored from row "), col(stated_on).cast("string"))
    ).otherwise(F.lit("mirrored"))
    with_origin = lambda b: F.when(b == fixed.NONE_CELL, origin).otherwise(
        F.concat(b, F.lit(" ("), origin, F.lit(")"))
    )
    is_mirror = F.coalesce(col(mirrored), F.lit(False))
    return let(base, lambda b: F.when(is_mirror, with_origin(b)).otherwise(b))


def strength_cell(grade: Column | str, score: Column | str) -> Column:
    """Grade and two-place score, or none when ungraded."""
    return F.when(
        col(grade).isNull() | (col(grade) == "ungraded"), F.lit(fixed.NONE_CELL)
    ).otherwise(F.concat(col(grade), F.lit(" "), F.format_string("%.2f", col(score))))
