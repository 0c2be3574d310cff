"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from evidary import fixed

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(items) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in items) + "]"


def inline(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def tokens(x: str) -> str:
    stop = words(fixed.TOKEN_STOPWORDS)
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'), "
        f"lambda tk: NOT list_contains({stop}, tk)))"
    )


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST({shared} AS DOUBLE) / "
        f"(len({a}) + len({b}) - {shared}) ELSE 0 END"
    )


def casefold(x: str) -> str:
    out = f"lower({x})"
    for source, target in fixed.CASEFOLD_EXPANSIONS:
        out = f"replace({out}, '{source}', '{target}')"
    return out


def fold(x: str) -> str:
    return f"trim(regexp_replace({casefold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def norm_title(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def numbers(x: str) -> str:
    """The signed numbers of a text: first blank out the dashes that are no sign."""
    digit = r"\p{Nd}²³¹⁰-⁹₀-₉"
    spaced = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    attached = f"regexp_replace({spaced}, '([\\p{{L}}{digit}])[-−–]', '\\1' || chr(1), 'g')"
    apart = f"regexp_replace({attached}, '([{digit}]) [-−–]', '\\1 ' || chr(1), 'g')"
    found = f"regexp_extract_all({apart}, '[-−–]?[0-9][0-9,]*(?:[.·][0-9]+)?')"
    return f"list_transform({found}, lambda nm: translate(replace(nm, ',', ''), '·−–', '.--'))"


def values(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({numbers(x)}, lambda nv: try_cast(nv AS DECIMAL(38,10))), lambda nv: nv IS NOT NULL))"


def sentences(x: str) -> str:
    """Mark every boundary, unmark the ones after an abbreviation (twice, for neighbours), split."""
    abbr = "|".join(w.replace(".", r"\.") for w in fixed.ABBREVIATIONS)
    marked = f"regexp_replace({inline(x)}, '([.!?])([\"'')\\]]*{WS}+)', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    undo = (
        f"'(?i)((?:^|{WS}|' || chr(2) || ')(?:{abbr}|[^\\s.' || chr(1) || chr(2) || '])\\.{{1,3}})' || chr(1) || "
        f"'([^' || chr(2) || ']*)' || chr(2)"
    )
    once = f"regexp_replace({marked}, {undo}, '\\1\\2', 'g')"
    twice = f"regexp_replace({once}, {undo}, '\\1\\2', 'g')"
    clean = f"regexp_replace({twice}, chr(1) || '[^' || chr(2) || ']*' || chr(2), chr(1), 'g')"
    return f"list_filter(string_split({clean}, chr(1)), lambda sn: sn <> '')"


def supported(claim: str, found: str) -> str:
    """Whether any value of a list rounds, half up, to the claim at the claim's own precision."""
    value = f"CAST(round(CAST({claim} AS DECIMAL(38,12)), 10) AS DECIMAL(38,10))"
    places = f"length(rtrim(split_part(CAST({value} AS VARCHAR), '.', 2), '0'))"
    cases = " ".join(f"WHEN {d} THEN round(sv, {d}) = round({value}, {d})" for d in range(11))
    return f"(len(list_filter({found}, lambda sv: CASE {places} {cases} END)) > 0)"


def general(x: str) -> str:
    """Six significant digits for the magnitudes that occur here (below 100,000)."""
    return f"CASE WHEN {x} = floor({x}) THEN printf('%d', CAST({x} AS BIGINT)) ELSE rtrim(printf('%.4f', {x}), '0') END"


def cell(x: str) -> str:
    return f"coalesce(nullif(replace({inline(f'coalesce({x}, chr(32))')}, '|', '\\|'), ''), '—')"


def row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cell(c) for c in cells) + " || ' |'"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"
