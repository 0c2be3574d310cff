"""Mixing sources to target weights by soft membership, in DataFrame expressions only.

1. Features of each text: shares of capitals and of symbols, logarithm of the word count, share of distinct
   words, and how many different words it has that mark the labelled toxic texts.
2. A logistic classifier for each domain of the labelled table (Newton steps whose sums are one
   aggregate each) on a bounded sample; the posteriors of a document are the domains' probabilities
   scaled to sum to one.
3. Rates: each document starts at rate one, and projected-gradient steps of the least-squares problem
   ``sum_d (sum_i rate_i tokens_i p_id - target_d)^2`` move them, never below zero.  In the
   token-weighted norm a step changes a rate by ``-p_i . g`` for a vector g with one number for each domain, so
   the state of all documents is the list of the vectors so far: a pass folds the list into the
   rate and adds up what the next vector needs.  Steps are scaled by the token-weighted second moments of the
   posteriors, under which a step of size one cannot overshoot.  Only those few sums reach the driver.
4. ``copies``: a rate's whole part, and one more for the share of documents that its fraction
   asks for, chosen by a hash of the document.

Defined results: a null, empty or wordless text has no tokens; its posteriors are those of its (zero) features.
Without labels, or with labels of one domain only, posteriors are the labelled shares, or equal.
A target for a domain that no document may belong to leaves a residual; the rates are the
least-squares answer.  Rows may repeat; each is a document of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidary.llm.common import bounded_texts, durable

DOMAINS = ("clean", "low", "toxic")
#: Shares of tokens wanted; ``clean`` sets the scale (see ``rates``).
TARGETS = {"clean": 0.85, "low": 0.08, "toxic": 0.07}
#: The classifier learns from at most so many documents of each domain.
PER_DOMAIN = 3000
#: Marking words: at most so many, each in at least so many toxic sample texts, and so many times likelier there.
MARKS, MARK_TEXTS, MARK_LIFT = 64, 8, 12.0
NEWTON, RIDGE = 8, 1e-3
STEPS, TOLERANCE = 40, 1e-6

FEATURES = ("one", "capitals", "symbols", "words", "distinct", "marks")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def domain_of(quality: Column, toxic: Column) -> Column:
    """A label row's domain; null where it says nothing."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "clean")


def marking_words(sample: DataFrame) -> list[str]:
    """Words that toxic texts of ``sample`` (doc_id, domain, text) have and others hardly do; at most ``MARKS``."""
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    toxic, others = sizes.get("toxic", 0), sum(n for d, n in sizes.items() if d != "toxic")
    if not toxic or not others:
        return []
    words = sample.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''")
    is_toxic = F.col("domain") == "toxic"
    seen = words.groupBy("word").agg(F.count_if(is_toxic).alias("t"), F.count_if(~is_toxic).alias("o")).where(F.col("t") >= MARK_TEXTS)
    lift = (F.col("t") / toxic) / ((F.col("o") + 0.5) / others)
    best = seen.withColumn("lift", lift).where(F.col("lift") >= MARK_LIFT).orderBy(F.desc(F.sqrt("t") * F.log("lift")), "word").limit(MARKS)
    return sorted(r["word"] for r in best.select("word").collect())


def _with_features(df: DataFrame, marks: list[str]) -> DataFrame:
    """``df`` (with ``text``) with ``tokens`` and an array ``f`` of the features."""
    text = F.coalesce("text", F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    listed = F.array(*map(F.lit, marks)) if marks else F.array().cast("array<string>")
    first = df.withColumns({
        "words": _words(text), "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "symbols": F.regexp_count(text, F.lit(r"[|%*&$#!@<>{}=_~^]")) / chars,
    })
    second = first.withColumns({
        "tokens": F.size("words") - F.array_contains("words", "").cast("int") * F.size(F.filter("words", lambda w: w == "")),
        "kinds": F.size(F.array_distinct("words")), "marks": F.size(F.array_intersect("words", listed)),
    })
    return second.withColumn("f", F.array(
        F.lit(1.0), F.col("capitals") * 10, F.col("symbols") * 10, F.log1p("tokens") / 5,
        F.col("kinds") / F.greatest("tokens", F.lit(1)), F.log1p("marks"),
    )).drop("words", "capitals", "symbols", "kinds", "marks")


def _dot(f: str, w: list[float]) -> str:
    """SQL for the product of an array column and numbers."""
    return " + ".join(f"{f}[{k}] * {x!r}D" for k, x in enumerate(w))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a few linear equations, by elimination with pivoting."""
    n = len(b)
    m = [[*row, v] for row, v in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i and m[i][i]:
                m[r] = [x - m[r][i] / m[i][i] * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


def fit(sample: DataFrame, shares: dict[str, float]) -> dict[str, list[float]]:
    """A weight vector for each domain from ``sample`` (domain, f).

    Rows weigh so that domains count by ``shares``, whatever their parts of the sample.
    """
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total, known = sum(sizes.values()), [d for d in DOMAINS if sizes.get(d)]
    if len(known) < 2:
        return {}
    weight = reduce(lambda c, d: c.when(F.col("domain") == d, shares[d] * total / sizes[d]), known, F.when(F.lit(False), 0.0))
    rows = sample.withColumn("weight", weight)
    n = len(FEATURES)
    w = {d: [0.0] * n for d in known}
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    for _ in range(NEWTON):
        # Weights as an array value keep the generated code the same from step to step.
        dots = {d: f"aggregate(zip_with(f, array({', '.join(f'{x!r}D' for x in w[d])}), (a, b) -> a * b), 0D, (a, b) -> a + b)" for d in known}
        odds = rows.selectExpr("f", "weight", *[f"1 / (1 + exp(-greatest(least({dots[d]}, 30D), -30D))) AS p_{d}" for d in known], *[f"IF(domain = '{d}', 1D, 0D) AS is_{d}" for d in known])
        sums = [F.expr(f"sum(weight * (p_{d} - is_{d}) * f[{i}]) AS g_{d}_{i}") for d in known for i in range(n)]
        sums += [F.expr(f"sum(weight * p_{d} * (1 - p_{d}) * f[{i}] * f[{j}]) AS h_{d}_{i}_{j}") for d in known for i, j in pairs]
        got = odds.agg(*sums).first()
        for d in known:
            slope = [got[f"g_{d}_{i}"] + RIDGE * total * w[d][i] for i in range(n)]
            second = [[got[f"h_{d}_{min(i, j)}_{max(i, j)}"] + (RIDGE * total if i == j else 0.0) for j in range(n)] for i in range(n)]
            step = _solve(second, slope)
            size = max(1.0, max(map(abs, step)) / 10)  # no step of over ten
            w[d] = [a - b / size for a, b in zip(w[d], step)]
    return w


def learn(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> tuple[list[str], dict[str, list[float]], dict[str, float]]:
    """The classifier: marking words, a weight vector for each domain, and the labelled shares."""
    wanted = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain IS NOT NULL")
    counts = {r["domain"]: r["n"] for r in wanted.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    shares = {d: counts.get(d, 0) / max(1, sum(counts.values())) for d in DOMAINS}
    sample = durable(bounded_texts(docs, wanted, "domain", per_domain))
    marks = marking_words(sample)
    return marks, fit(durable(_with_features(sample, marks).select("domain", "f")), shares), shares


def posteriors(docs: DataFrame, model: tuple) -> DataFrame:
    """Every row of ``docs`` as (row, tokens, u, p): the row itself, its tokens, a number in [0, 1) from a hash
    of its id and text, and one probability for each of ``DOMAINS``."""
    marks, w, shares = model
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 40)) / (1 << 40)
    rows = _with_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", u.alias("u")), marks)
    if w:
        raw = [F.expr(f"1 / (1 + exp(-({_dot('f', w[d])}))) + 1e-12D") if d in w else F.lit(0.0) for d in DOMAINS]
    else:
        even = not any(shares.values())
        raw = [F.lit(1 / len(DOMAINS) if even else shares[d]) for d in DOMAINS]
    scored = rows.select("row", "tokens", "u", F.array(*raw).alias("raw"))
    whole = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    return scored.select("row", "tokens", "u", F.transform("raw", lambda x: x / whole).alias("p"))


def _rate(steps: list[list[float]]) -> Column:
    """The rate after all steps so far; none goes below zero."""
    if not steps:
        return F.lit(1.0)
    listed = ", ".join(f"array({', '.join(f'{x!r}D' for x in g)})" for g in steps)
    moved = " - ".join(f"p[{d}] * g[{d}]" for d in range(len(DOMAINS)))
    return F.expr(f"aggregate(array({listed}), 1D, (r, g) -> greatest(0D, r - {moved}))")


def rates(scored: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[Column, list[dict]]:
    """A column of rates over ``scored`` (tokens, p), and each pass's residual and expected tokens.

    ``targets`` are shares of tokens.  Their scale is set by the first domain: it keeps its expected tokens.
    """
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = scored.agg(*[F.expr(f"sum(tokens * p[{i}] * p[{j}]) AS h{i}_{j}") for i, j in pairs]).first()
    moment = [[float(moments[f"h{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]
    for i in range(k):
        moment[i][i] += 1e-9 * sum(map(sum, moment)) + 1e-9
    steps: list[list[float]] = []
    log: list[dict] = []
    goal: list[float] = []
    for _ in range(STEPS):
        got = scored.select("tokens", "p", _rate(steps).alias("rate")).agg(*[F.expr(f"sum(tokens * rate * p[{d}]) AS s{d}") for d in range(k)]).first()
        have = [float(got[f"s{d}"] or 0) for d in range(k)]
        if not goal:
            first = targets[DOMAINS[0]]
            goal = [targets[d] * (have[0] / first if first else sum(have)) for d in DOMAINS]
        off = [a - b for a, b in zip(have, goal)]
        step = _solve(moment, off)
        # half the squared residual in the moments' norm: no step of size one makes it larger
        log.append({"loss": sum(a * b for a, b in zip(off, step)) / 2, "residual": max(map(abs, off)) / max(sum(goal), 1.0), "tokens": have})
        if log[-1]["residual"] < TOLERANCE or (len(log) > 1 and log[-2]["loss"] - log[-1]["loss"] < 1e-3 * log[-1]["loss"]):
            break
        steps.append(step)
    return _rate(steps), log


def _copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def _plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> tuple[tuple, DataFrame, Column]:
    model = learn(docs, labels)
    scored = durable(posteriors(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "tokens", "u", "p"))
    return model, scored, rates(scored, targets)[0]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, p, rate, copies) of each row of ``docs`` (doc_id, text)."""
    _, scored, rate = _plan(docs, labels, targets)
    return scored.withColumn("rate", rate).select("doc_id", "tokens", "p", "rate", _copies(F.col("rate"), F.col("u")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, repeat: bool = False) -> DataFrame:
    """``docs`` with each row as often as its copies say, or at most once unless ``repeat``.

    Posterior and rate are expressions of a row, so they are evaluated on the rows again and nothing is joined.
    """
    model, _, rate = _plan(docs, labels, targets)
    # The row number, which the filter asks for, holds the optimizer from spelling the posterior out at each of its uses
    # in the rate: it moves nothing through a projection with such a column.
    scored = posteriors(docs, model).withColumn("number", F.monotonically_increasing_id())
    rated = scored.select("row", "u", "number", rate.alias("rate")).select("row", "number", _copies(F.col("rate"), F.col("u")).alias("copies"))
    kept = rated.where((F.col("copies") > 0) & (F.col("number") >= 0))
    if repeat:
        return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    return kept.select("row.*")
