"""Which texts of a whole corpus hold which quotes: containment without comparing every pair.

A quote is held where its folded form stands somewhere in the folded text, which may cut the quote's first and last
words out of longer ones but not those between.  So each quote is looked up by whole words of its inside: runs of
``WIDTH`` of them (shingles).  Where no more than that many are inside, all of them are one run, and its places with the words
around them tell which texts hold the quote (``held_by_place``).  Else the corpus is read once for the places of
only those shingles and words that some quote has; each quote is then looked up by the one that the fewest
texts have, and what is found is verified on the texts.  Quotes of one or two words have no inside: they are first looked
up in the corpus's vocabulary by a run of letters, and then by the words found.

All joins are on equal keys.  A hash that two shingles share costs a verification and changes no result.  Quotes and
texts that are null or have no letter or digit are held by nothing and hold nothing; repeated texts are rows of their
own, and quotes repeated with their id are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidary.functions.text import fold, let, text_or_empty
from evidary.session import cut

#: Words in a shingle; letters in the runs by which short quotes find words.
WIDTH, GRAM = 5, 3


def _shingles(words: Column, first: int, beyond: int, width: Column) -> Column:
    """Hashes of the runs of ``width`` words, leaving out ``first`` words in front and ``beyond`` at the end."""
    count = F.size(words) - first - beyond - width + 1
    starts = F.when(count > 0, F.sequence(F.lit(first + 1), count + first)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(width, F.array_join(F.slice(words, i, width), " ")))


def text_keys(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, key): each text's shingles of the widths, each key once for a text."""
    keys = let(F.split(fold("text"), " "), lambda words: F.array_distinct(F.concat(*[_shingles(words, 0, 0, F.lit(w)) for w in widths])))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(keys).alias("key"))


def _inner_width(width: int) -> Column:
    """Words in the shingles that a needle is looked up by; a needle of one or two words is looked up by single ones."""
    return F.greatest(F.least(F.size(F.split("needle", " ")) - 2, F.lit(width)), F.lit(1))


def _cuts(word: Column, size: int) -> Column:
    """The runs of ``size`` letters of a word."""
    starts = F.when(F.char_length(word) >= size, F.sequence(F.lit(1), F.char_length(word) - size + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(word, i, size)), F.array().cast("array<string>"))


def _short_keys(short: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, needle, key) for quotes of one or two words: a key for each word of the corpus that may hold their longer one."""
    words = F.split("needle", " ")
    one = F.size(words) == 1
    ends = ~one & (F.char_length(words[0]) >= F.char_length(F.get(words, F.lit(1))))
    asked = short.select("quote_id", "needle", one.alias("one"), ends.alias("ends"), F.when(one | ends, words[0]).otherwise(F.get(words, F.lit(1))).alias("piece"))
    asked = asked.withColumn("gram", F.left("piece", F.lit(GRAM)))
    known = cut(docs.select(F.explode(F.split(fold("text"), " ")).alias("word")).where("word <> ''").distinct(), "words")
    cuts = F.flatten(F.array(*[_cuts(F.col("word"), n) for n in range(1, GRAM + 1)]))
    grams = known.select("word", F.explode(F.array_distinct(cuts)).alias("gram"))
    fits = F.when(F.col("one"), F.contains("word", "piece")).when(F.col("ends"), F.endswith("word", "piece")).otherwise(F.startswith("word", "piece"))
    return asked.join(grams, "gram").where(fits).select("quote_id", "needle", F.xxhash64(F.lit(1), "word").alias("key"))


def lookup_keys(quotes: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(one-of, any-of): (quote_id, needle, key) of quotes that a text holds only if it has each key, or any of the keys."""
    inner = F.size(F.split("needle", " ")) - 2
    keys = F.when(inner > 0, let(F.split("needle", " "), lambda words: F.array_distinct(_shingles(words, 1, 1, _inner_width(width)))))
    each = quotes.select("quote_id", "needle", F.explode(keys).alias("key"))
    short = quotes.where(inner < 1)
    return each, each.limit(0) if short.isEmpty() else _short_keys(short, docs)


def _edged(width: Column, inside: Column, before: Column, after: Column) -> Column:
    """Hash of a run of words with the last letter of the word before it and the first of the one after."""
    return F.xxhash64(width, F.array_join(inside, " "), F.right(before, F.lit(1)), F.left(after, F.lit(1)))


def held_by_place(needles: DataFrame, docs: DataFrame, insides: list[int]) -> DataFrame:
    """(quote_id, needle, _doc) of the texts that hold needles of which all inside words are one run, ``insides`` long.

    A place of such a run with the words around it tells by itself whether the needle is held: the word before must end as
    the needle begins, the one after begin as it ends.  Pairs that fail this are never written.
    """
    words = F.split("needle", " ")
    count = F.size(words) - 2
    asked = needles.select(
        "quote_id", "needle", words[0].alias("_first"), F.element_at(words, -1).alias("_last"),
        _edged(count, F.slice(words, F.lit(2), count), words[0], F.element_at(words, -1)).alias("key"),
    )

    def places(words: Column, width: int) -> Column:
        starts = F.when(F.size(words) > width + 1, F.sequence(F.lit(1), F.size(words) - width - 1)).otherwise(F.array().cast("array<int>"))

        def place(i: Column) -> Column:
            before, after = F.get(words, i - 1), F.get(words, i + width)
            return F.struct(_edged(F.lit(width), F.slice(words, i + 1, F.lit(width)), before, after).alias("key"), before.alias("before"), after.alias("after"))

        return F.transform(starts, place)

    found = let(F.split(fold("text"), " "), lambda words: F.concat(*[places(words, n) for n in insides]))
    around = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_doc"), F.inline(found))
    held = around.join(asked, "key").where(F.endswith("before", "_first") & F.startswith("after", "_last"))
    return held.select("quote_id", "needle", "_doc").distinct()


def _looked_up(needles: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(quote_id, needle, _doc) of the texts that have what each needle is looked up by."""
    each, any_of = (cut(keys, "lookups") for keys in lookup_keys(needles, docs, width))
    # At most ``width`` of them; no text is cut into shingles that no quote asks for.
    widths = sorted(r["w"] for r in needles.select(_inner_width(width).alias("w")).distinct().collect()) or [1]
    wanted = each.select("key").unionByName(any_of.select("key")).distinct()
    places = cut(text_keys(docs, widths).join(wanted, "key"), "places")
    held_by = places.groupBy("key").agg(F.count("*").alias("texts"))
    # A key that no text has is the rarest: its quote is nowhere.
    rarest = each.join(held_by, "key", "left").groupBy("quote_id", "needle").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key"))["key"].alias("key")
    )
    keyed = rarest.unionByName(any_of.select("quote_id", "needle", "key"))
    return keyed.join(places, "key").select("quote_id", "needle", F.col("doc_id").alias("_doc")).distinct()


def corpus_quotes(quotes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(quote_id, doc_id, at, as_code) of every text of ``docs`` (doc_id, text) that holds a quote of ``quotes`` (quote_id, quote).

    ``at`` is the place of the folded quote in the folded text, from 1; ``as_code`` whether it stands there on word boundaries.
    """
    needles = quotes.select("quote_id", fold(text_or_empty("quote")).alias("needle")).where("needle <> ''").distinct()
    needles = cut(needles, "needles")
    inner = F.size(F.split("needle", " ")) - 2
    of_one_run = (inner > 0) & (inner <= width)
    insides = sorted(r["n"] for r in needles.where(of_one_run).select(inner.alias("n")).distinct().collect())
    others = needles.where(~of_one_run)
    parts = [held_by_place(needles.where(of_one_run), docs, insides)] if insides else []
    if not insides or not others.isEmpty():
        parts.append(_looked_up(others, docs, width))
    found = cut(reduce(DataFrame.unionByName, parts), "found")
    texts = docs.select("doc_id", fold("text").alias("folded"))
    held = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_doc"))).where(F.contains("folded", "needle"))
    padded = F.contains(F.concat(F.lit(" "), "folded", F.lit(" ")), F.concat(F.lit(" "), "needle", F.lit(" ")))
    return held.select("quote_id", "doc_id", F.expr("instr(folded, needle)").alias("at"), padded.alias("as_code"))
