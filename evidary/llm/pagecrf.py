"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page's tree.

A page is cut into blocks: the text between two block-level tags, inline tags dropped, character references decoded, white space made
one space.  Scripts, styles, form controls, embedded media and comments of the markup are no blocks.  Each block has features of its
tag, its ancestors (tags, words of their class, id and role) and its text (length, links, punctuation, words of menus and notices), and of
its neighbours; a page's blocks are a chain whose two labels, main text or not, are weighted by features and by transitions, which differ for
neighbours in one parent, for a return to a parent that was left, and for others.

The field is trained by conditional likelihood (forward-backward, Adam) on ``LABELLED`` labelled pages.  No labels are
given with the pages, so the labelled ones are composed: layouts of ten kinds of boilerplate around and within
articles, with semantic tags, with speaking names, or with neither, of words of made-up languages.  They are composed by
Spark tasks from their numbers, so they are the same each time; one task fits the field, bounded by ``LABELLED``.
Pages are then labelled by Viterbi where they lie, without a shuffle, and their main blocks are joined in page order.

A null or empty page has no blocks and an empty text.  Unclosed and stray tags are mended as browsers do for paragraphs, lists and tables;
a page cut short ends its open blocks.  Very long pages are one row of one task and are taken whole.  Repeated rows and urls are rows of their own;
equal scores go to "not main".  Columns besides those named are ignored by ``extract`` and kept by ``labelled``.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from evidary.llm.common import free_name

#: Composed pages the field is trained on, places of hashed features, passes over the pages.
LABELLED, PLACES, EPOCHS = 3000, 1 << 17, 16
L2, RATE, BATCH = 1e-5, 0.1, 32
#: Ancestors of a block that give features, the nearest first.
ANCESTORS = 16
#: How a block stands to those before: elsewhere, next to the one before and named like it, or in a parent that had other blocks before.
APART, SIBLING, BACK = range(3)
RELATIONS = 3
BLOCKS = "array<struct<tag:string,text:string,main:boolean>>"

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("audio button canvas iframe map math noscript object option script select style svg template textarea title video".split())
#: A tag that ends an open one of the second kind, unless one of the third kind lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_BOXES = frozenset("article aside dialog footer form header main nav section".split())
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"\w+")


class _Blocks(HTMLParser):
    """Collects (frames, text, share of letters in links, numbers): the tags and names of the ancestors, and which elements they are."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], int]] = []
        self.silent = self.links = self.linked = self.elements = 0
        self.parts: list[str] = []
        self.found: list[tuple[tuple[tuple[str, tuple[str, ...]], ...], str, float, tuple[int, ...]]] = []

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                above = [f for f in self.stack[-2 * ANCESTORS :] if f[0] not in _INLINE][-ANCESTORS:]
                self.found.append((tuple((t, n) for t, n, _ in above), text, min(1.0, self.linked / len(text)), tuple(k for _, _, k in above)))
            self.parts, self.linked = [], 0

    def _pop(self, keep: int) -> None:
        for tag, _, _ in self.stack[keep:]:
            self.silent -= tag in _SILENT
            self.links -= tag == "a"
        del self.stack[keep:]

    def _open(self, tags: set[str], stop: set[str] | frozenset[str]) -> int | None:
        """The place of the innermost open one of ``tags``, if none of ``stop`` lies above it."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in tags:
                return k
            if tag in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "hr" or tag in _VOID and tag not in _INLINE:
            if tag == "hr":
                self._end_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in _VOID:
            return
        if tag not in _INLINE and tag not in _SILENT:
            self._end_block()
            # a block-level tag ends an open paragraph above which only inline tags are open
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] in _INLINE:
                k -= 1
            if k >= 0 and self.stack[k][0] == "p":
                self._pop(k)
            if tag in _ENDS:
                at = self._open(*_ENDS[tag])
                if at is not None:
                    self._pop(at)
        names: list[str] = []
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                names.extend(w.lower().rstrip("s") for w in _PART.findall(value[:256]))
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", ""):
                names.append("hidden")
        self.elements += 1
        self.stack.append((tag, tuple(names), self.elements))
        self.silent += tag in _SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack and self.stack[-1][0] == tag and tag in _SILENT:
            self._pop(len(self.stack) - 1)  # <svg/> and the like close themselves

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _INLINE:
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] in _INLINE and self.stack[k][0] != tag:
                k -= 1
            if k >= 0 and self.stack[k][0] == tag:
                self._pop(k)
            return
        if tag not in _SILENT:
            self._end_block()
        at = self._open({tag}, frozenset())
        if at is not None:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[tuple[tuple, str, float, tuple[int, ...]]]:
    """(ancestors with their names, text, share of letters in links, numbers of the ancestors) of the leaf blocks of a page in order."""
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    reader._end_block()
    return reader.found


# --- features ---------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (PLACES - 1)


def _of_frames(frames: tuple) -> tuple[list[int], str]:
    """The places of the ancestors' features, and the innermost part of a page they name by its tag."""
    tags = [t for t, _ in frames] or ["none"]
    named = {f"tag={tags[-1]}", f"up={'>'.join(tags[-2:])}", f"depth={min(len(tags), 8)}"}
    for up, (tag, names) in enumerate(reversed(frames)):
        named.add(f"in={tag}")
        for name in names:
            named.add(f"name={name}")
            if up < 2:
                named.add(f"near={name}")
    if not any(names for _, names in frames):
        named.add("nameless")
    box = next((t for t in reversed(tags) if t in _BOXES), "none")
    named.add(f"box={box}")
    return [_place(n) for n in sorted(named)], box


def _step(x: float) -> int:
    return int(min(9, max(0.0, x)).bit_length() if isinstance(x, int) else min(9, x * 5))


def _of_text(text: str, links: float) -> tuple[list[str], str]:
    """Names of a text's features, and its kind, which its neighbours see."""
    words = text.count(" ") + 1
    size = min(9, words.bit_length())
    stops = sum(map(text.count, ".!?"))
    kind = f"{size}{'l' if links > 0.5 else 't'}"
    last = text[-1]
    end = "stop" if last in ".!?…\"'”»" else "letter" if last.isalpha() else "digit" if last.isdigit() else "other"
    named = [f"size={size}", f"links={_step(links)}", f"stops={min(4, stops)}", f"end={end}", f"size={size},end={end}", f"kind={kind}"]
    named.append(f"digits={_step(2 * sum(map(text.count, '0123456789')) / len(text))}")
    named.append(f"commas={min(3, text.count(','))}")
    if text[0].isupper():
        named.append("upper")
    for mark in "©|»·@→✓×":
        if mark in text:
            named.append(f"mark={mark}")
    if words <= 24:
        named.extend(f"word={w}" for w in _KNOWN.intersection(_WORD.findall(text.lower())))
    return named, kind


def features(blocks: list[tuple], known: dict | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The places of each block's features, and its relation to what came before; ``known`` remembers ancestors."""
    known = {} if known is None else known
    texts = [_of_text(text, links) for _, text, links, _ in blocks]
    kinds = ["start", *[kind for _, kind in texts], "end"]
    made, relation, parents = [], np.full(len(blocks), APART), set()
    before: tuple[tuple, tuple] = ((), ())
    for k, (frames, _, _, numbers) in enumerate(blocks):
        named, kind = texts[k]
        if frames not in known:
            if len(known) > 20_000:
                known.clear()
            known[frames] = _of_frames(frames)
        tag, (above, box) = frames[-1][0] if frames else "none", known[frames]
        beside = [f"before={kinds[k]}", f"after={kinds[k + 2]}", f"tag={tag},kind={kind}", f"box={box},tag={tag}", f"box={box},kind={kind}"]
        # where the ways to this block and to the one before part
        at = next((i for i, (x, y) in enumerate(zip(numbers, before[1])) if x != y), min(len(numbers), len(before[1])))
        parent = numbers[-2] if len(numbers) > 1 else 0
        if k and at == len(numbers) - 1 == len(before[1]) - 1 and (not frames or frames[-1][1] == before[0][-1][1]):
            relation[k] = SIBLING
        elif parent in parents:
            relation[k] = BACK
        parents.add(parent)
        if relation[k] != SIBLING:
            beside.append(f"enter={frames[at][0] if at < len(frames) else 'none'}")
            beside.append(f"leave={before[0][at][0] if at < len(before[0]) else 'none'}")
        before = frames, numbers
        made.append(np.fromiter({*above, *map(_place, named), *map(_place, beside)}, np.int64))
    return made, relation


# --- the field ------------------------------------------------------------------------------------


def forward_backward(scores: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, label marginals and expected transitions of chains.

    ``scores`` (chains, longest, 2) weighs labels; chains end at ``sizes``.  The transition to a place is weighed by
    the one of ``moves`` (kinds, 2, 2) that ``kinds`` (chains, longest) names.
    """
    chains, longest, _ = scores.shape
    a = np.zeros_like(scores)
    a[:, 0] = scores[:, 0] + start
    for t in range(1, longest):
        m = moves[kinds[:, t]]
        a[:, t] = scores[:, t] + np.logaddexp(a[:, t - 1, :1] + m[:, 0], a[:, t - 1, 1:] + m[:, 1])
    end = sizes - 1
    row = np.arange(chains)
    whole = np.logaddexp(a[row, end, 0], a[row, end, 1])
    b = np.zeros_like(scores)
    expected = np.zeros_like(moves)
    for t in range(longest - 2, -1, -1):
        ahead = scores[:, t + 1] + b[:, t + 1]
        on = (t < end)[:, None]
        m = moves[kinds[:, t + 1]]
        b[:, t] = np.where(on, np.logaddexp(m[:, :, 0] + ahead[:, :1], m[:, :, 1] + ahead[:, 1:]), 0.0)
        pairs = np.exp(a[:, t, :, None] + m + ahead[:, None, :] - whole[:, None, None]) * on[:, :, None]
        np.add.at(expected, kinds[:, t + 1], pairs)
    marginals = np.exp(a + b - whole[:, None, None])
    marginals[np.arange(longest)[None, :] >= sizes[:, None]] = 0
    return whole, marginals, expected


def train(pages: list[tuple[tuple[list[np.ndarray], np.ndarray], np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, moves, start) that make the labels of ``pages`` (features of the blocks, labels 0 or 1) likely."""
    edge = PLACES + 4 * RELATIONS  # the weights of features, of transitions, of the first label
    theta, first, second = np.zeros(edge + 2), np.zeros(edge + 2), np.zeros(edge + 2)
    pages = [p for p in pages if len(p[1])]
    step = 0
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(pages))
        for at in range(0, len(order), BATCH):
            some = [pages[k] for k in order[at : at + BATCH]]
            sizes = np.array([len(y) for _, y in some])
            ids = [i for (x, _), _ in some for i in x]
            flat, bounds = np.concatenate(ids), np.concatenate(([0], np.cumsum([len(i) for i in ids])))[:-1]
            y, kind = np.concatenate([y for _, y in some]), np.concatenate([k for (_, k), _ in some])
            row = np.repeat(np.arange(len(some)), sizes)
            col = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            scores, kinds = np.zeros((len(some), sizes.max(), 2)), np.zeros((len(some), sizes.max()), np.int64)
            scores[row, col, 1], kinds[row, col] = np.add.reduceat(theta[flat], bounds), kind
            moves, start = theta[PLACES:edge].reshape(RELATIONS, 2, 2), theta[edge:]
            _, p, expected = forward_backward(scores, sizes, kinds, moves, start)
            grad = L2 * len(some) * theta
            grad[:PLACES] += np.bincount(flat, np.repeat(p[row, col, 1] - y, [len(i) for i in ids]), PLACES)
            inner = col > 0
            seen = np.bincount(4 * kind[inner] + 2 * np.roll(y, 1)[inner] + y[inner], minlength=4 * RELATIONS)
            grad[PLACES:edge] += expected.ravel() - seen
            grad[edge:] += p[:, 0].sum(axis=0) - np.bincount(y[~inner], minlength=2)
            grad /= len(some)
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            rate = RATE * (1 - epoch / epochs)
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:PLACES], theta[PLACES:edge].reshape(RELATIONS, 2, 2), theta[edge:]


def viterbi(scores: np.ndarray, kinds: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest labels of a chain whose label 1 weighs ``scores`` more; ties go to 0."""
    n = len(scores)
    if not n:
        return np.zeros(0, bool)
    came = np.zeros((n, 2), bool)
    weigh = moves.tolist()
    off, on = float(start[0]), float(start[1]) + float(scores[0])
    for t in range(1, n):
        (m00, m01), (m10, m11) = weigh[kinds[t]]
        came[t] = on + m10 > off + m00, on + m11 > off + m01
        off, on = max(off + m00, on + m10), max(off + m01, on + m11) + float(scores[t])
    label = np.zeros(n, bool)
    label[-1] = on > off
    for t in range(n - 1, 0, -1):
        label[t - 1] = came[t, int(label[t])]
    return label


def label_page(html: str | None, model: tuple, known: dict | None = None) -> list[tuple[str, str, bool]]:
    """(tag, text, whether main) of a page's blocks."""
    weights, moves, start = model
    blocks = leaf_blocks(html)
    places, kinds = features(blocks, known)
    main = viterbi(np.array([weights[i].sum() for i in places]), kinds, moves, start)
    return [(frames[-1][0] if frames else "none", text, bool(m)) for (frames, text, _, _), m in zip(blocks, main)]


# --- labelled pages ---------------------------------------------------------------------------------

#: Names that sites give to their parts; what the field learns of names it learns from these.
MAIN_NAMES = """content main-content post-content entry-content article-body article post post-body story story-body page-content
blog-post entry text body-text main maintext article__content single-post news-item td-post-content articleBody document prose""".split()
NAMES = {
    "nav": "nav navbar navigation main-menu menu topnav site-nav breadcrumb breadcrumbs menu-list pagination pager tabs toc links skip-link dropdown",
    "header": "header site-header masthead top-bar page-header banner branding logo topbar hero-header tagline",
    "footer": "footer site-footer page-footer bottom copyright colophon legal foot imprint footer-links credits",
    "side": "sidebar side aside widget widget-area rail right-column left-column related related-posts recent popular trending more-stories recommended tags tag-cloud author-box",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle ad-slot banner-ad dfp affiliate commercial teaser-ad",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay toast announcement disclaimer paywall privacy-notice message warning info-bar",
    "form": "form search search-form login newsletter subscribe signup contact-form register comment-form mailing-list",
    "comment": "comments comment comment-list commentlist replies reply discussion disqus responses user-comments feedback comment-body thread reviews",
    "share": "share social social-links sharing share-buttons follow tools print actions toolbar meta-links",
}
TAGS = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "ad": ["aside", "ins"], "notice": ["dialog", "aside"], "form": ["form"], "comment": ["section"], "share": ["ul"]}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "alert"}
SAID = {
    "nav": "Home About Contact News Products Services Blog Shop Sports World Business Startseite Kontakt Impressum Accueil Inicio Next Previous Menu",
    "header": "Welcome Official Daily Times Magazine Online Portal Est",
    "footer": "Copyright rights reserved Privacy Terms Impressum Datenschutz Contact Powered",
    "side": "Related Popular Recent Trending More Tags Archive Categories Mehr Plus",
    "ad": "Advertisement Sponsored Anzeige Publicité Publicidad Buy Save Offer Discount",
    "notice": "cookies Accept consent privacy policy browser verwenden utilisons Usamos Cookies",
    "form": "Subscribe Email Password Login Search Name Submit newsletter Anmelden",
    "comment": "Comments Reply says replied Like Report Kommentare Commentaires Comentarios ago posted",
    "share": "Share Tweet Facebook Twitter Print Email Pin Teilen Partager",
}
_SAID = sorted({w for said in SAID.values() for w in said.split()})
_KNOWN = frozenset(w.lower() for said in SAID.values() for w in said.split())


class _Composer:
    """Composes a page and notes which of its texts are main."""

    def __init__(self, number: int) -> None:
        self.draw = random.Random(number)
        letters = self.draw.choice(["aeiourtnsl", "aeioubdgmnrst", "eéèaouimntrs", "aouäöüeinrstch", "aeioóánñdrsc"])
        pieces = ["".join(self.draw.choice(letters) for _ in range(self.draw.randint(2, 4))) for _ in range(40)]
        common = ["".join(self.draw.choice(letters) for _ in range(self.draw.randint(1, 3))) for _ in range(12)]
        self.words = common * 4 + ["".join(self.draw.choice(pieces) for _ in range(self.draw.randint(1, 3))) for _ in range(120)]
        self.style = self.draw.choice(["tags", "tags", "names", "names", "both", "bare"])
        self.noise = self.draw.random() < 0.15
        self.junk = self.draw.sample(["%%%", "***", "###", "&&&", "$$$", "!!", "??", "~~", ":-)"], 4)
        self.labels: list[int] = []

    def one(self, chance: float) -> bool:
        return self.draw.random() < chance

    def said(self, count: int) -> str:
        words = [self.draw.choice(self.words) if self.one(0.97) else self.draw.choice(_SAID).lower() for _ in range(count)]
        if self.noise:
            words = [w + self.draw.choice([*self.junk, ""]) for w in words]
        return " ".join(words)

    def sentences(self, least: int, most: int) -> str:
        made = []
        for _ in range(self.draw.randint(least, most)):
            text = self.said(self.draw.randint(1, self.draw.choice([2, 4, 18, 18])))
            if self.one(0.4):
                text = text.replace(" ", ", ", 1)
            text = text[:1].upper() + text[1:] + self.draw.choice(".....!?")
            made.append(text + self.draw.choice(self.junk) if self.noise and self.one(0.5) else text)
        text, lot = " ".join(made), self.draw.random()
        if lot < 0.03:  # junk that real pages have in their articles, too
            return self.draw.choice([" | ", " » ", " · "]).join(self.said(self.draw.randint(2, 30)).split())
        if lot < 0.06:
            return " ".join([self.said(1)] * self.draw.randint(2, 40))
        return text.upper() if lot < 0.09 else text

    def inline(self, text: str) -> str:
        """The text as markup, a part of it emphasized or linked."""
        words = escape(text, quote=self.one(0.5)).split(" ")
        if len(words) > 3 and self.one(0.3):
            tag = self.draw.choice(['<a href="/x">', "<b>", "<em>", "<strong>", "<span>", "<i>"])
            k = self.draw.randrange(len(words) - 2)
            words[k], words[k + 1] = tag + words[k], words[k + 1] + f"</{tag[1:].split()[0].rstrip('>')}>"
        return " ".join(words) + (" &amp; co." if self.one(0.05) else "")

    def block(self, tag: str, text: str, main: int) -> str:
        self.labels.append(main)
        close = "" if tag in ("p", "li") and self.one(0.1) else f"</{tag}>"
        return f"<{tag}>{text}{close}"

    def wrapped(self, kind: str, inner: str) -> str:
        tag, attributes = "div", ""
        if self.style in ("tags", "both") and self.one(0.85):
            tag = self.draw.choice(TAGS[kind])
        plain = self.style == "bare" or (self.style == "tags" and tag != "div")
        # some parts must be named, as nothing else tells a reader's comment or a notice from the article
        if not plain or kind in ("comment", "notice", "ad") and tag not in ("aside", "ins", "dialog"):
            name = self.draw.choice(NAMES[kind].split())
            if self.one(0.3):
                name = self.draw.choice(["site-", "js-", "c-", "main-", "block-", "page_"]) + name
            if self.one(0.3):
                name += self.draw.choice(["-wrapper", "-inner", " clearfix", "-container", "-list", "_1", " col-md-4", "-area"])
            attributes = f' {self.draw.choice(["class", "class", "id"])}="{name}"'
        if kind in ROLES and self.one(0.15):
            attributes += f' role="{ROLES[kind]}"'
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def told(self, kind: str, most: int = 4) -> str:
        """A short text of a kind's own words, or of any."""
        own = SAID[kind].split()
        if self.one(0.5):
            return escape(" ".join(self.draw.choice(own) for _ in range(self.draw.randint(1, most))))
        return escape(self.said(self.draw.randint(1, most)).capitalize())

    def links(self, kind: str, least: int = 2, most: int = 9) -> str:
        form = self.draw.choice(["ul", "ul", "ol", "div", "p"])
        items = []
        for _ in range(self.draw.randint(least, most)):
            link = f'<a href="/{self.draw.randrange(99)}">{self.told(kind)}</a>'
            items.append(self.block("li" if form in ("ul", "ol") else "div", link, 0) if form != "p" else link)
        if form == "p":
            self.labels.append(0)
            return f"<p>{self.draw.choice([' | ', ' ', ' · ']).join(items)}</p>"
        return f"<{form}>{''.join(items)}</{form}>"

    def part(self, kind: str) -> str:
        """A part of a page that is not its main text."""
        made = []
        if kind == "nav":
            made.append(self.links("nav"))
        elif kind == "header":
            made.append(self.block(self.draw.choice(["h1", "div", "h2", "p", "a"]).replace("a", "div"), self.told("header"), 0))
            if self.one(0.4):
                made.append(self.block("p", self.inline(self.sentences(1, 1)), 0))
            if self.one(0.3):
                made.append(self.links("nav"))
        elif kind == "footer":
            if self.one(0.7):
                made.append(self.block(self.draw.choice(["p", "div", "small"]).replace("small", "p"), f"&copy; {self.draw.choice(['2021 ', ''])}{self.told('footer')} &middot; {self.inline(self.sentences(1, 2))}", 0))
            if self.one(0.4) or not made:
                made.append(self.links("footer"))
        elif kind == "ad":
            made.append(self.block(self.draw.choice(["div", "p"]), self.inline(self.sentences(1, 3)) if self.one(0.7) else self.told("ad"), 0))
        elif kind == "notice":
            made.append(self.block(self.draw.choice(["p", "div"]), f"{self.told('notice', 6)} {self.inline(self.sentences(1, 3))}", 0))
            made.append("<button>OK</button>" if self.one(0.5) else "")
        elif kind == "form":
            made.append(self.block(self.draw.choice(["p", "h3", "div"]), self.told("form") + (" " + self.inline(self.sentences(1, 2)) if self.one(0.5) else ""), 0))
            made.append('<input type="text" name="q"><button>Go</button>' + ("<select><option>A</option></select>" if self.one(0.2) else ""))
        elif kind == "share":
            made.append(self.links("share", 2, 5))
        elif kind == "comment":
            made.append(self.block(self.draw.choice(["h2", "h3", "p"]), self.told("comment"), 0))
            for _ in range(self.draw.randint(1, 5)):
                who = self.block(self.draw.choice(["div", "p", "h4"]), self.told("comment"), 0) if self.one(0.6) else ""
                what = who + "".join(self.block("p", self.inline(self.sentences(1, 4)), 0) for _ in range(self.draw.randint(1, 2)))
                made.append(self.draw.choice(["<li>{}</li>", "<div>{}</div>", '<div class="comment">{}</div>', "<article>{}</article>", '<div class="comment-body">{}</div>']).format(what))
        else:
            if self.one(0.8):
                made.append(self.block(self.draw.choice(["h2", "h3", "h4", "p"]), self.told("side"), 0))
            made.append(self.links("side") if self.one(0.7) else self.block("p", self.inline(self.sentences(1, 4)), 0))
        return self.wrapped(kind, "".join(made))

    def article(self) -> str:
        made = []
        if self.one(0.85):
            head = escape(self.said(self.draw.randint(1, 12)).capitalize())
            title = self.block(self.draw.choice(["h1", "h1", "h1", "h2"]), head, 1)
            made.append(f"<header>{title}</header>" if self.one(0.15) else title)
        for _ in range(self.draw.choice([1, 2, 3, 5, 8, 12, 20])):
            lot = self.draw.random()
            if lot < 0.70:
                made.append(self.block("p", self.inline(self.sentences(1, self.draw.choice([1, 3, 8, 25]))), 1))
            elif lot < 0.75:
                made.append(self.block("p", f"<b>{self.inline(self.sentences(1, 4))}<br>", 1))
            elif lot < 0.80:
                made.append(self.block(self.draw.choice(["h2", "h3", "h4"]), escape(self.said(self.draw.randint(1, 8)).capitalize()), 1))
            elif lot < 0.84:
                kind = self.draw.choice(["ul", "ol"])
                made.append(f"<{kind}>" + "".join(self.block("li", self.inline(self.sentences(1, 2)), 1) for _ in range(self.draw.randint(2, 6))) + f"</{kind}>")
            elif lot < 0.87:
                made.append("<blockquote>" + self.block("p", self.inline(self.sentences(1, 3)), 1) + "</blockquote>")
            elif lot < 0.89:
                made.append(self.block("pre", self.inline(self.said(12)), 1))
            elif lot < 0.91:
                cells = "".join("<tr>" + "".join(self.block("td", escape(self.said(self.draw.randint(1, 3))), 1) for _ in range(3)) + "</tr>" for _ in range(2))
                made.append(f"<table>{cells}</table>")
            elif lot < 0.93:
                made.append('<figure><img src="x.png" alt="x">' + self.block("figcaption", self.inline(self.sentences(1, 1)), 1) + "</figure>")
            elif self.one(0.6):
                made.append(self.part(self.draw.choice(["ad", "ad", "share", "side", "form", "notice"])))
            else:
                made.append("<!-- x --><script>var t='</p>';</script>")
        inner = "".join(made)
        if self.one(0.15):
            inner += self.part("share")
        if self.one(0.2):
            inner += self.part("comment")
        tag, attributes = "div", ""
        if self.style in ("tags", "both"):
            tag = self.draw.choice(["article", "article", "main", "section"])
        if self.style in ("names", "both") or self.style == "tags" and tag == "section":
            attributes = f' {self.draw.choice(["class", "class", "id", "itemprop"])}="{self.draw.choice(MAIN_NAMES)}"'
        whole = f"<{tag}{attributes}>{inner}</{tag}>"
        if self.style == "bare" and self.one(0.4):
            whole = inner
        if self.one(0.2):
            whole = f"<main>{whole}</main>" if tag != "main" else f"<div>{whole}</div>"
        return whole

    def page(self) -> str:
        top = [k for k, chance in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("form", 0.2), ("ad", 0.4), ("side", 0.2)) if self.one(chance)]
        low = [k for k, chance in (("share", 0.2), ("comment", 0.35), ("side", 0.4), ("ad", 0.2), ("form", 0.25), ("nav", 0.15), ("footer", 0.75), ("notice", 0.15)) if self.one(chance)]
        body = "".join([*map(self.part, top), self.article(), *map(self.part, low)])
        if self.one(0.3):
            body = f'<div class="{self.draw.choice(["wrapper", "container", "page", "site", "row"])}">{body}</div>'
        head = "<head><title>x</title><style>p{margin:0}</style></head>" if self.one(0.8) else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if self.one(0.9) else "")


def labelled_page(number: int) -> tuple[str, np.ndarray]:
    """A composed page and the label of each of its blocks."""
    composer = _Composer(number)
    html = composer.page()
    return html, np.array(composer.labels, np.int64)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    pages = [pickle.loads(p) for p in rows.sort_values("id")["page"]]
    weights, moves, start = train(pages)
    return pd.DataFrame({"model": [pickle.dumps((weights.astype(np.float32), moves, start))]})


def fit(spark: SparkSession, labelled: int = LABELLED) -> bytes:
    """The field's weights from ``labelled`` composed pages."""

    @pandas_udf("binary")
    def composed(numbers: pd.Series) -> pd.Series:
        made = []
        for number in numbers:
            html, labels = labelled_page(int(number))
            made.append(pickle.dumps((features(leaf_blocks(html)), labels)))
        return pd.Series(made, dtype=object)

    rows = spark.range(0, labelled, 1, 8).select("id", composed("id").alias("page"))
    return rows.groupBy().applyInPandas(_fit, "model binary").first()["model"]


def labelled(pages: DataFrame, model: bytes, name: str = "blocks") -> DataFrame:
    """``pages`` with a column ``name``: the blocks of ``html`` in order, each with its tag, text and whether it is main."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(BLOCKS)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field, known = pickle.loads(shared.value), {}
        for htmls in batches:
            yield pd.Series([[{"tag": g, "text": t, "main": m} for g, t, m in label_page(h, field, known)] for h in htmls], dtype=object)

    return pages.withColumn(name, label("html"))


def extract(pages: DataFrame, model: bytes | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html): the main blocks, joined by spaces."""
    name = free_name(pages, "blocks")
    found = labelled(pages, model or fit(pages.sparkSession), name)
    main = F.array_join(F.transform(F.filter(name, lambda b: b["main"]), lambda b: b["text"]), " ")
    return found.select("page_id", "url", main.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
