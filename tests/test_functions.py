from pyspark.sql import functions as F

from evidary.functions import labels as L, numbers as N, scoring as S, text as T


def test_number_signs(values):
    texts = [
        ("OR 1·82, beta −0.44, n = 12,405",),
        ("CI 1.21-2.74",),
        ("1.21–2.74",),
        ("1.21   -   2.74",),
        ("at 30-day follow-up, 12 events",),
        ("(-3.5) and R²-2",),
    ]
    assert values(texts, "t string", N.number_literals("t")) == [
        ["1.82", "-0.44", "12405"],
        ["1.21", "2.74"],
        ["1.21", "2.74"],
        ["1.21", "2.74"],
        ["30", "12"],
        ["-3.5", "2"],
    ]


def test_support_is_at_the_claims_precision(values):
    rows = [(1.8, "1.84"), (1.84, "1.84"), (1.9, "1.84"), (18.4, "1.84"), (4.44, "Table 4 in 2019, 244"), (0.00003, "0.00003"), (-0.4, "beta −0.44")]
    got = values(rows, "c double, t string", N.is_supported("c", N.values_in("t")))
    assert got == [True, True, False, False, False, True, True]
    assert values([(0.00003,), (2.0,), (1.25,)], "c double", N.claim_decimals("c")) == [5, 0, 2]


def test_general_rendering(values):
    rows = [(1.5,), (12.0,), (0.1234567,), (1234567.0,), (0.00012,), (0.0,), (None,)]
    assert values(rows, "v double", N.general("v")) == ["1.5", "12", "0.123457", "1.23457e+06", "0.00012", "0", None]


def test_surface_keys(values):
    rows = [("Chronic sleep restriction (CSR)",), ("SD of sleep duration",), ("Sleep duration (short, <=6h/d)",), ("duration of sleeps",), ("status",)]
    assert values(rows, "t string", T.surface_key("t")) == [
        ["chronic", "restriction", "sleep"],
        ["duration", "sd", "sleep"],
        ["duration", "short", "sleep"],
        ["duration", "sleep"],
        ["status"],
    ]


def test_thresholds_come_off(values):
    rows = [("Comorbidity index score (≥1)",), ("Sleep duration (short, <=6h/d)",), ("8",)]
    assert values(rows, "t string", T.without_thresholds("t")) == ["Comorbidity index score", "Sleep duration (short)", "8"]


def test_sentences_and_cuts(values):
    text = 'This is e.g. a test. Smith J. et al. found it! "Yes." Then no.'
    assert values([(text,)], "t string", T.sentences("t")) == [
        ["This is e.g. a test.", "Smith J. et al. found it!", '"Yes.', "Then no."]
    ]
    short = values([("word " * 60,), ("a b",), ("x" * 300,)], "t string", T.truncate_chars("t", 200))
    assert short[0].endswith("word…") and len(short[0]) <= 200
    assert short[1] == "a b"
    assert short[2] == "x" * 199 + "…"


def test_folding_keeps_what_case_folding_yields(values):
    assert values([("A--B  c!",), ("Groß ﬁne",), ("E11·9",)], "t string", T.fold("t")) == ["a b c", "gross fine", "e11 9"]


def test_names(values):
    rows = [("Ferrari Silva B",), ("WHO Group",), ("Li",), ("van der Berg Q-R",)]
    assert values(rows, "a string", T.document_filename(F.lit("1"), F.array("a"))) == [
        "1_Ferrari-Silva.md", "1_WHO-Group.md", "1_Li.md", "1_van-der-Berg.md",
    ]


def test_bands(values):
    rows = [("correlated", "r", 0.81), ("correlated", "Pearson r", 0.52), ("correlated", "r", -0.11), ("correlated", "R²", 0.61), ("correlated", "VIF", 12.0),
            ("correlated", "tolerance", 0.05), ("correlated", "tolerance", 0.9), ("modifies", "beta", 0.5), ("derives", "r", 0.1), ("correlated", "r", None)]
    got = values(rows, "k string, m string, v double", L.band_interaction("k", "m", "v"))
    assert got == ["strong", "moderate", "weak", "strong", "strong", "strong", "weak", "stated", "structural", "stated"]


def test_unpriced_never_reads_as_free(values):
    rows = [(0.0, 0, 0), (1.5, 2, 0), (0.0, 2, 2), (1.5, 3, 1)]
    assert values(rows, "u double, c int, x int", L.format_cost("u", "c", "x")) == [
        "$0.00", "$1.5000", "cost unavailable", "$1.5000 + 1 unpriced",
    ]


def test_secrets_leave_the_url_and_the_key(values):
    rows = [("https://x/y?api_key=abc&b=1",), ("https://x/y",)]
    assert values(rows, "u string", L.redact_url("u")) == ["https://x/y?api_key=REDACTED&b=1", "https://x/y"]
    same = F.create_map(F.lit("b"), F.lit("1"), F.lit("api_key"), F.col("u"))
    keys = values(rows, "u string", L.request_key(F.lit("get"), F.lit("https://x"), same))
    assert keys[0] == keys[1]


def test_translation_inspection(values):
    rows = [('"a b"[tiab] AND (c[mh])', '"a b"[All Fields]'), ("sleep[tiab] AND apnea", '"apnea"[All Fields]'), ('"a"[tiab]', '"a"[Title/Abstract]')]
    none = F.array().cast("array<string>")
    assert values(rows, "t string, r string", L.is_suspect("t", "r", none)) == [True, False, False]


def test_unmeasured_is_neutral(values):
    row = [(None, None, None)]
    schema = "design double, size double, adjustment double"
    combined = S.combine([("design", F.col("design"), 0.35), ("size", F.col("size"), 0.25), ("adjustment", F.col("adjustment"), 0.4)])
    [got] = values(row, schema, combined)
    assert got["score"] == 0.5 and got["unmeasured"] == ["design", "size", "adjustment"]
    assert values([("x",)], "a string", S.grade_for(F.lit(0.5), F.lit(False))) == ["ungraded"]


def test_precision_signal(values):
    rows = [(2.0, "OR", 1.0, 10.0), (2.0, "Odds Ratio", 1.0, 1.0), (2.0, "mean difference", 1.0, 3.0), (2.0, "OR", None, 3.0), (0.0, "beta", -1.0, 1.0)]
    got = values(rows, "e double, m string, l double, h double", S.precision_signal("e", "m", "l", "h"))
    assert got[:3] == [0.0, 1.0, 0.75] and got[3:] == [None, None]


def test_wide_cuts_are_compressed(spark, tmp_path, monkeypatch):
    from evidary import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    wide = spark.range(20_000).repartition(4, "id").selectExpr("id", "repeat('a sentence of a paper ', 50) AS text")
    again = session.cut(wide, "wide")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < size < 20_000 * 1100 / 20
    assert again.dtypes == wide.dtypes and again.exceptAll(wide).isEmpty() and again.count() == 20_000
