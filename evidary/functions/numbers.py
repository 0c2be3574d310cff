"""Numbers in text, their printed precision, and numeric support."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidary.functions.text import col, let

DECIMAL = "decimal(38,10)"
# A number with an optional sign.  The sign counts only when it is not attached to a
# letter or digit and not set off by spaces from a digit before it.
_ATTACHED = r"\p{L}\p{Nd}²³¹⁰-⁹₀-₉"
_DIGIT = r"\p{Nd}²³¹⁰-⁹₀-₉"
NUMBER = (
    # Signs are few, so what stands before one is looked at after the sign.
    rf"(?:[-−–](?<![{_ATTACHED}][-−–])(?<![{_DIGIT}] [-−–]))?"
    r"[0-9][0-9,]*(?:[.·][0-9]+)?"
)


def number_literals(text: Column | str) -> Column:
    """Every number in a passage as plain ASCII literals, in order."""
    # Runs of blanks shrink to one, so the look-behind stays bounded.
    whole = col(text)
    runs = F.contains(whole, F.lit("  ")) | F.contains(whole, F.lit("\t"))
    spaced = F.when(runs, F.regexp_replace(whole, r"[ \t]+", " ")).otherwise(whole)
    found = F.regexp_extract_all(spaced, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: F.translate(n, "·−–,", ".--"))


def quantities(text: Column | str) -> Column:
    """``array<struct<value decimal, decimals int>>`` for a passage (C17)."""
    return F.filter(
        F.transform(
            number_literals(text),
            lambda n: F.struct(
                n.try_cast(DECIMAL).alias("value"),
                F.when(F.instr(n, ".") > 0, F.length(n) - F.instr(n, "."))
                .otherwise(F.lit(0))
                .alias("decimals"),
            ),
        ),
        lambda q: q["value"].isNotNull(),
    )


def values_in(text: Column | str) -> Column:
    """The distinct numeric values of a passage; all that support checks need."""
    return F.array_distinct(
        F.filter(
            F.transform(number_literals(text), lambda n: n.try_cast(DECIMAL)),
            lambda v: v.isNotNull(),
        )
    )


def claim_value(value: Column | str) -> Column:
    """A claimed double as a ten-place decimal."""
    return F.round(col(value).cast("decimal(38,12)"), 10).cast(DECIMAL)


def claim_decimals(value: Column | str) -> Column:
    """How precisely a claim was written, at most ten places."""
    fraction = F.substring_index(claim_value(value).cast("string"), ".", -1)
    return F.length(F.rtrim(fraction, F.lit("0")))


def _half_unit(decimals: Column) -> Column:
    steps = [f"{5 * 10 ** -(d + 1):.11f}" for d in range(11)]
    table = F.array(*[F.lit(s).cast("decimal(12,11)") for s in steps])
    return F.element_at(table, decimals + 1)


def is_supported(claim: Column | str, found: Column | str) -> Column:
    """Whether any found value rounds, half up, to the claim at the claim's precision.

    The claim is already a multiple of its own unit, so "rounds to" is an interval test
    around it, open on the far side.  Null claims are null.
    """
    value = claim_value(claim)
    half = _half_unit(claim_decimals(claim))
    bounds = F.struct((value - half).alias("lo"), (value + half).alias("hi"))
    # The bounds are computed once per row; the search ends at the first value within them.
    return let(
        bounds,
        lambda b: F.exists(
            col(found),
            lambda v: F.when(v >= 0, (b["lo"] <= v) & (v < b["hi"])).otherwise((b["lo"] < v) & (v <= b["hi"])),
        ),
    )


def general(value: Column | str) -> Column:
    """``%g`` rendering: six significant digits, trailing zeros dropped."""
    scientific = F.format_string("%.5e", col(value).cast("double"))

    def shown(text: Column) -> Column:
        rounded = text.try_cast("double")
        size = F.abs(rounded)
        return (
            F.when(size == 0, F.lit("0"))
            .when((size >= 0.001) & (size < 1e6), F.regexp_replace(rounded.cast("string"), r"\.0$", ""))
            .when((size >= 0.0001) & (size < 0.001), F.rtrim(F.format_string("%.10f", rounded), F.lit("0")))
            .when(size.isNotNull(), F.regexp_replace(text, r"\.?0*e", "e"))
        )

    return let(scientific, shown)
