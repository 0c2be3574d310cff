"""Quotes in a corpus against plain containment of every pair."""

import random
import re

import pytest

from evidary.operators import containment


def _fold(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").casefold()).strip()


def _expected(quotes, docs):
    found = []
    for quote_id, quote in set(quotes):
        needle = _fold(quote)
        for doc_id, text in docs:
            folded = _fold(text)
            if needle and needle in folded:
                found.append((quote_id, doc_id, folded.index(needle) + 1, f" {needle} " in f" {folded} "))
    return sorted(found, key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_every_length_of_quote(spark, width):
    rng = random.Random(width)
    words = ["ab", "abc", "cab", "b", "x1", "banana", "nan", "Anna", "the"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "?!"), (3, docs[3][1]), (None, "the banana, the banana split of Anna"), (503, "word " * 30_000 + "abc cab x1 the b nan")]
    docs += [(600 + k, "One passage that many texts share, word for word, in full.") for k in range(200)]
    quotes = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    quotes += [(900, None), (901, ""), (902, "--"), (903, "nana"), (904, "anana th"), (905, "b"), (906, "anna ban"), (907, "no such words here at all, none of them")]
    quotes += [(908, "passage that many texts share, word for"), (908, "passage that many texts share, word for"), (909, "assage that many texts share word f"), (910, "ab"), (910, "the")]
    got = containment.corpus_quotes(
        spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id int, text string, key string"), width
    )
    assert sorted(map(tuple, got.collect()), key=str) == _expected(quotes, docs)


def test_no_nested_loop_and_no_cross_join(spark):
    quotes = spark.createDataFrame([(1, "a quote of seven or more words here"), (2, "two words"), (3, "three words here")], "quote_id int, quote string")
    docs = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    plan = containment.corpus_quotes(quotes, docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    quotes, docs = spark.createDataFrame([], "quote_id int, quote string"), spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    assert containment.corpus_quotes(quotes, docs).count() == 0
    assert containment.corpus_quotes(spark.createDataFrame([(1, "b")], quotes.schema), docs.limit(0)).count() == 0


def test_quotes_of_few_words_are_looked_up_by_their_whole_inside(spark):
    from evidary.operators.containment import lookup_keys, text_keys

    docs = spark.createDataFrame([(1, "the cat sat down"), (2, "sat the cat and cat sat on"), (3, "sat cat"), (4, "scat cat satin")], "doc_id long, text string")
    needles = spark.createDataFrame([("q", "a cat sat b")], "quote_id string, needle string")
    each, _ = lookup_keys(needles, docs, 5)
    assert each.count() == 1
    found = text_keys(docs, [2]).join(each, "key")
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 2]


def test_no_pair_that_fails_is_kept(spark):
    """Texts that share only the inside of a quote are told apart where they are found."""
    docs = spark.createDataFrame([(1, "one the cat sat on two"), (2, "in a cat sat by"), (3, "bathe cat sat onto"), (4, "the cat sat"), (5, None)], "doc_id long, text string")
    needles = spark.createDataFrame([("q", "the cat sat on"), ("r", "he cat sat on"), ("s", "a cat sat b")], "quote_id string, needle string")
    found = containment.held_by_place(needles, docs, [2]).collect()
    assert sorted((r["quote_id"], r["_doc"]) for r in found) == [("q", 1), ("q", 3), ("r", 1), ("r", 3), ("s", 2)]
