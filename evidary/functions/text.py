"""Text expressions: tokens, keys, folding, sentences, truncation, rendering.

All of these build Catalyst expressions; none calls Python per row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed

# The characters Python's ``str.split()`` treats as white space, and its line breaks.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])"
_OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
NBSP_LIKE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

_WS_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in NBSP_LIKE)
# A run of white space that is not one blank; printable ASCII is passed over by a comparison of ranges.
_RUN = f" [{_WS_CLASS}]+|[^ -~](?<=[{_WS_CLASS}])[{_WS_CLASS}]*"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once.

    Inside a lambda an outer expression is computed anew for every element; bound this way
    it is a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, however often it is used above.

    A one-element explode is a boundary that neither a later projection nor a pushed
    filter copies the expression across.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def strings(words) -> Column:
    """A literal string array."""
    words = list(words)
    if not words:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(word) for word in words])


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def strip(value: Column | str) -> Column:
    """Python's ``strip()``."""
    return F.btrim(col(value), F.lit(NBSP_LIKE))


def _inlined(text: Column) -> Column:
    # Most texts are printable ASCII without double blanks: nothing is inside them to collapse.
    tidy = ~text.rlike("[^ -~]") & ~F.contains(text, F.lit("  "))
    return F.when(tidy, F.trim(text)).otherwise(F.trim(F.regexp_replace(text, _RUN, " ")))


def inline(value: Column | str) -> Column:
    """Collapse to one line."""
    return _inlined(F.col(value)) if isinstance(value, str) else let(value, _inlined)


def has_text(value: Column | str) -> Column:
    """Whether ``strip`` would leave anything."""
    return col(value).rlike(f"[!-~]|[^{_WS_CLASS}]")


def words_of(value: Column | str) -> Column:
    """White-space words, none empty."""
    return F.filter(F.split(inline(value), " "), lambda w: w != "")


def word_count(value: Column | str) -> Column:
    """Number of white-space words (C20)."""
    counted = lambda text: F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))
    return let(inline(text_or_empty(value)), counted)


def plain_lines(text: Column) -> Column:
    """Whether line feeds are the only line breaks; nine searches for one character each are cheaper than a pattern."""
    return ~reduce(or_, [F.contains(text, F.lit(c)) for c in _OTHER_BREAKS])


def line_feeds_only(value: Column | str) -> Column:
    """The text with blanks for all line breaks but line feeds."""
    return F.translate(col(value), _OTHER_BREAKS, " " * len(_OTHER_BREAKS))


def lines_of(value: Column | str) -> Column:
    """``splitlines()``: no empty element for a closing line break."""

    def cut(whole: Column) -> Column:
        closed = F.when(whole.endswith("\n"), F.substring(whole, 1, F.length(whole) - 1)).otherwise(whole)
        text = F.when(F.right(whole, F.lit(1)).rlike(LINE_BREAK), F.regexp_replace(whole, rf"{LINE_BREAK}\z", "")).otherwise(whole)
        # Where line feeds are the only breaks, no pattern is tried at every character.
        return F.when(whole == "", F.array().cast("array<string>")).otherwise(
            F.when(plain_lines(whole), F.split(closed, "\n", -1)).otherwise(F.split(text, LINE_BREAK, -1))
        )

    return let(col(value), cut)


# --- tokens -----------------------------------------------------------------


def text_tokens(value: Column | str) -> Column:
    """Distinct lower-case content words of three or more characters."""
    found = F.regexp_extract_all(F.lower(col(value)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(found, strings(fixed.TOKEN_STOPWORDS))


def paper_tokens(title: Column | str, mesh: Column | str, keywords: Column | str) -> Column:
    """Title, subject headings and keywords, never the abstract."""
    return text_tokens(
        F.concat_ws(" ", col(title), F.array_join(col(mesh), " "), F.array_join(col(keywords), " "))
    )


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Set overlap; 0 when either side is empty (C3).  Both sides must be distinct arrays."""
    a, b = col(left), col(right)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union).otherwise(F.lit(0.0))


def normalized_title(value: Column | str) -> Column:
    """Lower case, punctuation dropped, white space collapsed."""
    return inline(F.regexp_replace(F.lower(col(value)), "[^a-z0-9 ]+", " "))


def casefold(value: Column | str) -> Column:
    """Lower case plus the folds that yield further ASCII letters."""
    text = col(value)
    out = F.lower(text)
    for source, target in fixed.CASEFOLD_EXPANSIONS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)


def fold(value: Column | str) -> Column:
    """Case-folded alphanumeric words joined by single spaces."""
    # Single characters are looked up in a table, ranges tried one by one.
    return F.trim(F.regexp_replace(casefold(value), f"[^{ascii_lowercase}{digits}]+", " "))


def alnum_lower(value: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(col(value)), r"[^\p{L}\p{N}]+", "")


# --- phrase keys ---------------------------------------------------------------

_INITIALISM = r"(?U)\b[A-Z][A-Z0-9-]*\b"


def _opened(value: Column) -> Column:
    """Parentheses opened; only the initialisms inside them removed."""
    pieces = F.regexp_extract_all(value, F.lit(r"\([^)]*\)|[^(]+|\("), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.startswith("(") & p.endswith(")"),
                F.concat(
                    F.lit(" "),
                    F.regexp_replace(F.substring(p, 2, F.length(p) - 2), _INITIALISM, " "),
                    F.lit(" "),
                ),
            ).otherwise(p),
        ),
        "",
    )


def singular(token: Column) -> Column:
    """Drop a plural ``s``, keeping words such as status, analysis, stress."""
    endings = "|".join(fixed.NOT_PLURAL_ENDINGS)
    plural = (F.length(token) > 3) & token.endswith("s") & ~token.rlike(f"(?:{endings})$")
    return F.when(plural, F.substring(token, 1, F.length(token) - 1)).otherwise(token)


def surface_key(value: Column | str) -> Column:
    """The sorted token set two phrases are compared on."""
    opened = _opened(col(value))
    tokens = F.transform(text_tokens(opened), singular)
    initialisms = F.filter(
        F.regexp_extract_all(opened, F.lit(_INITIALISM), F.lit(0)), lambda w: F.length(w) > 1
    )
    return F.array_sort(
        F.array_distinct(F.concat(tokens, F.transform(initialisms, lambda w: F.lower(w))))
    )


def number_set(value: Column | str) -> Column:
    """The distinct numbers a phrase carries, sorted and joined (C14)."""
    found = F.regexp_extract_all(col(value), F.lit(fixed.NUMBER), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def without_thresholds(value: Column | str) -> Column:
    """The phrase with comparator-number-unit runs removed and punctuation tidied (C14)."""
    bare = F.regexp_replace(col(value), fixed.THRESHOLD, " ")
    bare = F.regexp_replace(bare, fixed.EMPTY_PARENTHESES, " ")
    bare = F.regexp_replace(bare, fixed.DANGLING_PUNCTUATION, "$1")
    bare = F.btrim(inline(bare), F.lit(" ,;:-."))
    return F.when(bare == "", col(value)).otherwise(bare)


def keyphrases(value: Column | str) -> Column:
    """Runs of content words, first four words of each, distinct in order."""
    words = F.regexp_extract_all(col(value), F.lit(fixed.KEYPHRASE_WORD), F.lit(0))
    breakers = strings(fixed.PHRASE_STOPWORDS + fixed.PHRASE_TASK_WORDS)
    marked = F.transform(
        words,
        lambda w: F.when(
            F.array_contains(breakers, F.lower(w)) | (F.length(w) < 3), F.lit("\u0001")
        ).otherwise(w),
    )
    runs = F.filter(
        F.transform(F.split(F.array_join(marked, " "), "\u0001"), lambda r: F.trim(r)),
        lambda r: r != "",
    )
    heads = F.transform(
        runs, lambda r: F.array_join(F.slice(F.split(r, " "), 1, fixed.MAX_PHRASE_WORDS), " ")
    )
    return F.array_distinct(heads)


# --- sentences and budgets --------------------------------------------------------

_ABBR = "|".join(word.replace(".", r"\.") for word in fixed.ABBREVIATIONS)
SENTENCE_BREAK = (
    rf"(?i)(?<=[.!?])(?<!(?:^|\s)(?:{_ABBR}|[^\s.])\.{{1,3}})[\"')\]]*\s+"
)
_MAY_BREAK = r"[.!?][\"')\]]* "


def sentences(value: Column | str) -> Column:
    """Split prose after a terminator, not after an abbreviation or an initial."""

    def cut(text: Column) -> Column:
        pieces = F.filter(F.split(text, SENTENCE_BREAK, -1), lambda s: s != "")
        # Without a terminator before a blank there is one sentence, or none.
        return (
            F.when(text.rlike(_MAY_BREAK), pieces)
            .when(text == "", F.array().cast("array<string>"))
            .when(text.isNotNull(), F.array(text))
        )

    return let(inline(value), cut)


def truncate_sentences(value: Column | str, limit: int) -> Column:
    """The first ``limit`` sentences (C20)."""
    return F.array_join(F.slice(sentences(value), 1, limit), " ")


def truncate_chars(value: Column | str, limit: int) -> Column:
    """Cut on a word boundary past the half-way mark and add an ellipsis (C20)."""

    def cut_at_word(cut: Column) -> Column:
        # Where the last space sits, 0-based; -1 when there is none.
        space = F.when(F.instr(cut, " ") == 0, F.lit(-1)).otherwise(
            F.lit(limit - 1) - F.instr(F.reverse(cut), " ")
        )
        kept = F.when(space > limit // 2, F.substr(cut, F.lit(1), space)).otherwise(cut)
        return F.concat(F.rtrim(kept, F.lit(" ,;:.")), F.lit("…"))

    return let(
        inline(value),
        lambda text: F.when(F.length(text) <= limit, text).otherwise(
            let(F.substring(text, 1, limit - 1), cut_at_word)
        ),
    )


# --- names and files -----------------------------------------------------------


def slugify(value: Column | str) -> Column:
    """A folder name: lower case, hyphens, 64 characters."""
    folded = F.btrim(F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(folded, 1, 64), F.lit("-"))


def filename_token(value: Column | str) -> Column:
    """A file-name part that keeps its capitals."""
    folded = F.btrim(F.regexp_replace(col(value), "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(folded, 1, 64), F.lit("-"))


def first_author_surname(authors: Column | str) -> Column:
    """The first author without trailing initials, or Anon."""
    first = inline(F.get(col(authors), F.lit(0)))
    bare = F.regexp_replace(first, r"^(.+) (?=[^ ]{1,4}$)(?=[^ ]*\p{Lu})[^ \p{Ll}]+$", "$1")
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("Anon")).otherwise(bare)


def document_filename(pmid: Column | str, authors: Column | str) -> Column:
    token = filename_token(first_author_surname(authors))
    return F.concat(
        col(pmid), F.lit("_"), F.when(token == "", F.lit("Anon")).otherwise(token), F.lit(".md")
    )


def screening_text(title: Column | str, abstract: Column | str) -> Column:
    """Title, blank line, abstract (C11)."""
    return strip(F.concat(text_or_empty(title), F.lit("\n\n"), text_or_empty(abstract)))


def citation(authors: Column | str, venue: Column | str, year: Column | str) -> Column:
    """One-line human citation (C11)."""
    a = col(authors)
    lead = F.coalesce(F.get(a, F.lit(0)), F.lit("Anon"))
    et_al = F.when(F.size(a) > 1, F.lit(" et al.")).otherwise(F.lit(""))
    when = F.coalesce(F.nullif(col(year), F.lit(0)).cast("string"), F.lit("n.d."))
    return strip(F.concat(lead, et_al, F.lit(" "), text_or_empty(venue), F.lit(" "), when))


def author_line(authors: Column | str, limit: int = fixed.MAX_AUTHORS) -> Column:
    """First six authors, then ``et al.``."""
    a = F.coalesce(col(authors), F.array().cast("array<string>"))
    line = F.array_join(F.slice(a, 1, limit), ", ")
    return F.when(F.size(a) > limit, F.concat(line, F.lit(", et al."))).otherwise(line)


def key_predictors(names: Column | str, limit: int = fixed.TOPIC_PREDICTORS) -> Column:
    """First three names and how many more."""
    a = col(names)
    line = F.array_join(F.slice(a, 1, limit), ", ")
    more = F.concat(line, F.lit(", +"), (F.size(a) - limit).cast("string"), F.lit(" more"))
    return (
        F.when(F.size(a) <= 0, F.lit(fixed.NONE_CELL)).when(F.size(a) > limit, more).otherwise(line)
    )


def and_list(items: Column | str) -> Column:
    """``a, b or c``."""
    a = col(items)
    head = F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), ", ")
    last = F.element_at(a, -1)
    return F.when(F.size(a) == 1, last).when(
        F.size(a) > 1, F.concat(head, F.lit(" or "), last)
    ).otherwise(F.lit(""))


# --- Markdown pieces -------------------------------------------------------------


def _cell(text: Column) -> Column:
    escaped = F.replace(_inlined(text), F.lit("|"), F.lit("\\|"))
    return F.when(has_text(text), escaped).otherwise(F.lit(fixed.NONE_CELL))


def cell(value: Column | str) -> Column:
    """One table cell: one line, pipes escaped, never empty."""
    return let(text_or_empty(value), _cell)


def table_row(*cells: Column | str) -> Column:
    shown = F.transform(F.array(*[text_or_empty(c) for c in cells]), _cell)
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def header_row(names) -> str:
    return "| " + " | ".join(names) + " |"


def rule_row(columns: int) -> str:
    return "|" + "---|" * columns


def fact(label: str, value: Column | str) -> Column:
    """``- **Label** — value``; null when there is nothing to say."""
    text = text_or_empty(value)
    return F.when(text != "", F.concat(F.lit(f"- **{label}** — "), inline(text)))


def thousands(value: Column | str) -> Column:
    """An integer with thousands separators."""
    return F.format_number(col(value), 0)


def code_array_map(pairs: dict[str, object]) -> Column:
    """A literal map."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
