"""The field's arithmetic against enumeration, and main texts of composed, written and given pages."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidary.llm import pagecrf


@pytest.fixture(scope="module")
def model(spark):
    return pagecrf.fit(spark)


def _paths(scores, kinds, moves, start):
    for labels in itertools.product((0, 1), repeat=len(scores)):
        s = start[labels[0]] + sum(scores[t, y] for t, y in enumerate(labels))
        yield labels, s + sum(moves[kinds[t], labels[t - 1], labels[t]] for t in range(1, len(labels)))


def test_forward_backward_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([5, 1, 7])
    scores, kinds = np.zeros((3, 7, 2)), rng.integers(0, 3, (3, 7))
    scores[:, :, 1] = rng.normal(size=(3, 7))
    moves, start = rng.normal(size=(3, 2, 2)), rng.normal(size=2)
    whole, marginals, expected = pagecrf.forward_backward(scores, sizes, kinds, moves, start)
    wanted = np.zeros((3, 2, 2))
    for c, n in enumerate(sizes):
        paths = list(_paths(scores[c, :n], kinds[c], moves, start))
        total = np.log(sum(np.exp(s) for _, s in paths))
        assert whole[c] == pytest.approx(total)
        for t in range(n):
            assert marginals[c, t, 1] == pytest.approx(sum(np.exp(s - total) for y, s in paths if y[t]))
        for y, s in paths:
            for t in range(1, n):
                wanted[kinds[c, t], y[t - 1], y[t]] += np.exp(s - total)
        best = max(paths, key=lambda p: p[1])[0]
        assert pagecrf.viterbi(scores[c, :n, 1], kinds[c], moves, start).tolist() == [bool(y) for y in best]
    assert expected == pytest.approx(wanted)


def _texts(html):
    return [b[1] for b in pagecrf.leaf_blocks(html)]


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        (None, []), ("", []), (" \n", []), ("plain &lt;text&gt; &amp; more", ["plain <text> & more"]),
        ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]),
        ("<p>one<p>two<ul><li>x<li>y</ul>z", ["one", "two", "x", "y", "z"]),
        ("<p>a &nbsp;\n b&#8217;s &copy x &am</p>", ["a b’s © x &am"]),
        ("<script>var t='</p><p>no'</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><noscript>no</noscript>", ["yes"]),
        ("<form>q<select><option>no</select><textarea>no</textarea><button>no</button></form>", ["q"]),
        ("<table><tr><td>1<td>2<tr><td>3</table></div></b>end", ["1", "2", "3", "end"]),
        ("<div><p>cut <b>short", ["cut short"]), ("a < b <3 >c", ["a < b <3 >c"]),
        ("<article><p><b>x<br><p>y</article><footer>z</footer>", ["x", "y", "z"]),
    ],
)
def test_blocks(html, texts):
    assert _texts(html) == texts


def test_composed_labels_fit_their_blocks_and_held_out_pages_are_read(spark, model):
    import pickle

    field = pickle.loads(model)
    wrong = total = 0
    for number in range(500_000, 500_150):
        html, labels = pagecrf.labelled_page(number)
        blocks = pagecrf.label_page(html, field)
        assert len(blocks) == len(labels)
        wrong += sum(m != bool(y) for (_, _, m), y in zip(blocks, labels))
        total += len(labels)
    assert wrong / total < 0.01


PAGES = [
    (
        '<html><head><title>T</title></head><body><header class="site-header"><h1>The Site</h1><p>Our tagline here</p></header>'
        '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><main><article><h1>On rivers</h1>'
        "<p>Rivers run, &amp; they run <a href='/x'>down</a> to the sea.</p><h2>Why</h2><p>Because.</p><ul><li>They are heavy.</li><li>They are wet.</li></ul>"
        '<aside class="related"><h3>Related</h3><ul><li><a href="/1">Lakes</a></li></ul></aside><p>That is all there is to say about them.</p></article></main>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I like rivers a lot, thank you for this.</p></div></section>'
        '<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/2">Hills</a></li></ul></aside><form><p>Subscribe to our newsletter</p><input></form>'
        "<footer><p>&copy; 2024 The Site. All rights reserved.</p></footer></body></html>",
        "On rivers Rivers run, & they run down to the sea. Why Because. They are heavy. They are wet. That is all there is to say about them.",
    ),
    (
        '<div id="cookie-notice"><p>We use cookies to make this site better for you.</p></div><div class="header"><div>Daily Times</div></div>'
        '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Sports</a></li></ul></div><div class="post-content"><h1>A day out</h1>'
        "<p>We went out in the morning. It rained, but we did not mind.</p><div class='advertisement'><p>Buy a raincoat now, half price today only.</p></div>"
        "<p>In the evening we came home.</p></div><div id='comments'><h3>2 comments</h3><ol><li><p>Anna says</p><p>Nice story, I was there too.</p></li></ol></div>"
        "<div class='sidebar'><h4>Recent</h4><p>Some other story that nobody reads any more.</p></div><div id='footer'>Copyright Daily Times</div>",
        "A day out We went out in the morning. It rained, but we did not mind. In the evening we came home.",
    ),
    (
        "<article><h1>Flood</h1><p>The river rose in the night, and by morning it had reached the fields.</p><aside><p>Last year the river stayed low, and nobody spoke of it.</p></aside>"
        "<p>Nobody had seen it so high since the old bridge fell.</p><div class='ad-banner'>Boats for sale, cheap and dry.</div><p>It fell again within the week.</p>"
        "<form><p>Join our letter today.</p></form></article><section id='comments'><article class='comment'><p>I saw it too, it was quite a sight.</p></article></section>",
        "Flood The river rose in the night, and by morning it had reached the fields. Nobody had seen it so high since the old bridge fell. It fell again within the week.",
    ),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_written_pages(spark, model, number):
    html, text = PAGES[number]
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert pagecrf.extract(pages, model).first()["text"] == text


def test_awkward_rows(spark, model):
    html = "<article><h1>Title</h1><p>Some words of the article stand here, and more of them.</p></article><footer>&copy; us</footer>"
    text = "Title Some words of the article stand here, and more of them."
    long = "<article><h1>Title</h1>" + "<p>Some words of the article stand here, and more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", html), (1, "u", html), (None, None, None), (2, "u", ""), (3, None, html), (4, "v", long), (5, "w", "<div>" * 5000 + "x")]
    pages = spark.createDataFrame([(*r, "b") for r in rows], "page_id long, url string, html string, blocks string")
    got = pagecrf.extract(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    found = {(r["page_id"], r["url"]): r for r in got.collect()}
    assert got.count() == len(rows)
    assert found[1, "u"]["text"] == found[3, None]["text"] == text and found[1, "u"]["n_chars"] == len(text)
    assert found[None, None]["text"] == found[2, "u"]["text"] == "" and found[2, "u"]["n_chars"] == 0
    assert found[4, "v"]["text"] == "Title" + " Some words of the article stand here, and more of them." * 20_000
    assert pagecrf.extract(pages.limit(0), model).count() == 0
    assert pagecrf.labelled(pages, model).columns == ["page_id", "url", "html", "blocks"]


def test_given_pages(spark, model):
    """The articles of the given pages, read off their one layout, are what the field finds."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    inner = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    spaced = F.regexp_replace(F.regexp_replace(inner, "</?(p|h1|br)>", " "), "<[^>]+>", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, "&amp;?", "&"), "&quot;", '"'), r"(?U)\s+", " "))
    both = pagecrf.extract(pages, model).join(pages.select("page_id", plain.alias("want")), "page_id")
    assert both.where("text = want").count() >= 0.99 * pages.count()
