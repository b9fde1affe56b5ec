"""Literal cases of the scalar functions, one row each."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import classify, display, language, metrics
from quillspark.functions import contacts as ct
from quillspark.functions import geometry as g
from quillspark.functions import hallucination as h
from quillspark.functions import text as tx
from quillspark.operators import spelling
from quillspark.operators.routing import calibrated_confidence
from quillspark.operators.tables import structure_score


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(spark, values, make):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"a{k} string" for k in range(len(values[0]))))
    return [r["v"] for r in df.select("i", make(*[F.col(f"a{k}") for k in range(len(values[0]))]).alias("v")).orderBy("i").collect()]


CASES = {
    tx.normalize_underscores: [("_ _ _ _", "___"), ("________", "___"), ("Name:      x", "Name: ___x"), ("a  b", "a b"), (None, None)],
    tx.punctuation_spacing: [("Govr. , x", "Govr., x"), ("word . word", "word. word"), ("( text )", "(text)"), ("self - aware", "self-aware"), ("don 't", "don't"), ("é - é", "é-é"), ("", "")],
    tx.fix_encoding: [("a b", "a b"), ("“q” ‘s’ –—…", "\"q\" 's' --...")],
    tx.clean: [("<b> a </b>\t\n b ", "a b"), ("", "")],
    tx.trailing_period: [("DEPARTMENT .", "DEPARTMENT"), ("Total.", "Total"), ("Acme Inc.", "Acme Inc."), ("John S.", "John S."), ("wait..", "wait."), ("none", "none"), (".", "")],
    tx.dropped_parenthesis: [("BRANDS)", "BRAND(S)"), ("recipients) x", "recipient(s) x"), ("SCOPE)", "SCOPE)"), ("(a) BRANDS", "(a) BRANDS"), ("boxES)", "box(ES)")],
    tx.signature_text: [("RECEIVED BY: John Smith DATE: 3", "RECEIVED BY: (signature) DATE: 3"), ("signature: Ann", "signature: (signature)"), ("SIGNED BY: 12", "SIGNED BY: 12")],
    tx.truncate: [("a\nb<br>c", "a b c"), ("x" * 40, "x" * 34 + "…"), (None, "")],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_text_functions(spark, function):
    cases = CASES[function]
    assert rows(spark, [(a,) for a, _ in cases], function) == [b for _, b in cases]


def test_decimal_dashes(spark):
    cases = [("Factor -88 applied", "Factor .88 applied", True), ("MENT-474", "MENT.474", True), ("•55", ".55", True), ("on 3-12-1998 -44", "on 3-12-1998 -44", False), ("-5", "-5", False), ("x -12 -34", "x .12 .34", True), ("AB-12-3", "AB-12-3", False)]
    got = rows(spark, [(a,) for a, *_ in cases], lambda c: F.struct(*[x.alias(n) for x, n in zip(tx.decimal_dash(c), ("t", "r"))]))
    assert [(r["t"], r["r"]) for r in got] == [(b, c) for _, b, c in cases]


def test_repeated_words(spark):
    cases = [("We went straight straight to bed", "We went straight to bed", 1), ("the The THE x", "the x", 2), ("a b", "a b", None), ("one", "one", None)]
    got = rows(spark, [(a,) for a, *_ in cases], lambda c: F.struct(*[x.alias(n) for x, n in zip(tx.repeated_words(c), ("t", "n"))]))
    assert [(r["t"], r["n"]) for r in got] == [(b, c) for _, b, c in cases]


def test_case_transfer(spark):
    cases = [("DATE ISSUED: January", "date issued: january", "DATE ISSUED: january"), ("ALL CAPS", "all caps here", "ALL CAPS HERE"), ("Mostly lower TEXT", "mostly lower", "mostly lower"), ("", "kept", "kept"), ("12 34", "a b", "a b")]
    assert rows(spark, [(a, b) for a, b, _ in cases], tx.transfer_case) == [c for *_, c in cases]


def box(*v):
    return [F.lit(float(x)) for x in v]


def test_geometry(spark):
    assert one(spark, g.overlap_of_smaller(box(0, 0, 10, 10), box(5, 5, 7, 7))) == 1.0
    assert one(spark, g.overlap_of_smaller(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0.0
    assert one(spark, g.overlap_of(box(0, 0, 10, 10), box(0, 0, 5, 10), box(0, 0, 10, 10))) == 0.5
    assert one(spark, g.overlap_of_smaller(box(0, 0, 1, 1), [F.lit(None).cast("double")] * 4)) == 0.0
    assert one(spark, g.intersects(box(0, 0, 2, 2), box(1, 1, 3, 3))) and not one(spark, g.intersects(box(0, 0, 1, 1), box(1, 0, 2, 1)))
    assert one(spark, g.too_large(box(0, 0, 100, 20), F.lit(100.0), F.lit(100.0), F.lit("Human Face")))
    assert not one(spark, g.too_large(box(0, 0, 100, 20), F.lit(100.0), F.lit(100.0), F.lit("logo")))
    assert one(spark, g.too_large(box(5, 5, 5, 9), F.lit(100.0), F.lit(100.0), F.lit("logo")))
    words = one(spark, g.word_boxes(box(0, 0, 100, 10), F.array(F.lit("ab"), F.lit("abcdef"))))
    assert [round(w["x1"], 3) for w in words] == [0.0, round(2 * 100 / 8.5 + 50 / 8.5, 3)] and words[1]["x2"] == 100.0
    single = one(spark, g.word_boxes(box(3, 0, 9, 10), F.array(F.lit("word"))))
    assert (single[0]["x1"], single[0]["x2"]) == (3.0, 9.0)


def scored(spark, content, confidence, *b):
    s, names = h.score(F.lit(content), F.lit(confidence), box(*b), F.lit(1000.0))
    r = spark.range(1).select(s.alias("s"), names.alias("n")).first()
    return r["s"], r["n"]


def test_hallucination_score(spark):
    s, names = scored(spark, "///", 0.3, 5, 5, 15, 15)
    assert s >= 0.5 and names[:2] == ["very_low_confidence", "short"] and "margin_fragment_short" in names
    assert scored(spark, "A complete sentence", 0.99, 100, 100, 400, 120) == (0.0, [])
    blank, names = scored(spark, "", 0.99, 100, 100, 400, 120)
    assert abs(blank - 0.40) < 1e-9 and names == ["very_short", "only_punctuation", "not_valid_text"]


def test_valid_text(spark):
    good = ["word", "a)", "#:", ".55", "USA", "Smith", "12/3/98", "12.5", "$5.00", "(555) 555-0100", "a.b@c.org", "https://x", "www.x", "two words", "abc123", "7", "#", "é"]
    bad = ["", "///", "~", "-- --", "@@@@!", "中"[:0] + "*!*!*"]
    got = rows(spark, [(x,) for x in good + bad], h.is_valid_text)
    assert got == [True] * len(good) + [False] * len(bad)
    assert rows(spark, [("the the cat",), ("a a",), ("x x x",), ("one two",), ("one",)], h.has_repetition) == [True, False, True, False, False]


def test_phones(spark):
    texts = [("Call (555) 123-4567 or 555.123.4567",), ("5551234567",), ("12345-6789",), ("3/12/1998",), ("ring 555/123-4567 and 555 987 6543",), ("55512345678",), (None,)]
    got = rows(spark, texts, lambda c: F.transform(ct.phones(c), lambda p: p["normalized"]))
    assert got[:6] == [["(555) 123-4567"], ["(555) 123-4567"], [], [], ["(555) 123-4567", "(555) 987-6543"], []]
    assert one(spark, ct.phone_validation(ct.phones(F.lit("1111111111"))))["status"] == "invalid"
    assert rows(spark, [("12345",), ("12345-6789",), ("3/4/98",), ("3/4/98 10:30",), ("Albany, NY 12207",), ("555-123-4567",)], ct.is_date_or_zip) == [True] * 5 + [False]
    assert rows(spark, [("FAX tel",), ("Telephone",), ("multitel",)], ct.phone_kind) == ["fax", "phone", ""]


def test_dates(spark):
    got = rows(spark, [("12/0/98",), ("13-1-2000",), ("Mar 3, 1999",), ("414,00",), ("1/2/98 and 3/4/1999",)], ct.dates)
    assert [r["status"] for r in got] == ["suspicious", "suspicious", "valid", "none", "valid"]
    assert got[0]["dates"][0]["issues"] == ["invalid_day", "missing_digit"] and got[1]["dates"][0]["issues"] == ["invalid_month"]
    assert [d["format"] for d in got[4]["dates"]] == ["MM/DD/YYYY", "MM/DD/YY"]


def test_plausible(spark):
    cases = [("hcllo", "hello", True), ("hxllo", "hello", False), ("helo", "hello", True), ("heelo", "hello", False), ("same", "same", False), ("skip", "skips", False), ("abcde", "abc", False), ("oarly", "early", True), ("earlv", "early", True)]
    assert rows(spark, [(a, b) for a, b, _ in cases], spelling.is_plausible) == [c for *_, c in cases]


def test_structure_score(spark):
    s, names = structure_score(F.lit(0.2), F.lit(3), F.lit(2), F.lit(0.5), F.lit(0.99))
    r = spark.range(1).select(s.alias("s"), names.alias("n")).first()
    assert r["s"] == 90.0 and r["n"] == ["columns:3", "rows:2", "grid_coverage:50%", "density_ok:20.0%", "high_confidence"]


def test_classes(spark):
    f = lambda *v: classify.typed_score(*[F.lit(x) for x in v])
    typed = one(spark, classify.page_class(f(0.1, 0.9, 100.0, 0.05, 0.6, 0.9, False, True)))
    assert typed["document_type"] == "typed" and typed["confidence"] == 0.95
    assert one(spark, classify.page_class(f(0.9, 0.1, 1600.0, 0.5, 0.0, 0.0, False, False)))["document_type"] == "handwritten"
    assert one(spark, f(0.9, 0.1, 900.0, 0.01, 0.18, 0.0, False, False)) == 0.65
    assert one(spark, classify.page_class(F.lit(None).cast("double"))).asDict() == {"document_type": "mixed", "confidence": 0.3}
    assert one(spark, calibrated_confidence(F.lit(-1.25))) == 0.5


def test_metrics(spark):
    df = spark.createDataFrame([("The cat, sat.", "the cat sat"), ("", "x"), ("a b c", "a x c d")], "r string, h string")
    got = metrics.evaluate(df, F.col("r"), F.col("h")).collect()
    assert [round(r.strict_wer, 4) for r in got] == [0.6667, 0.0, 0.6667] and [r.flexible_wer for r in got][:2] == [0.0, 0.0]
    assert got[0].formatting_errors == 2 and got[0].content_errors == 0 and got[0].total_ref_chars == 11
    native = df.select(metrics.word_distance_native(metrics.tokens(F.col("r")), metrics.tokens(F.col("h"))).alias("d")).collect()
    assert [r.d for r in native] == [metrics.edit_distance(r.lower().split(), x.lower().split()) for r, x in (("The cat, sat.", "the cat sat"), ("", "x"), ("a b c", "a x c d"))]


def test_display_and_language(spark):
    assert one(spark, display.colour(F.lit("Text"), F.lit("trocr"), F.lit(None).cast("double"))) == "#ff8c00"
    assert one(spark, display.label(F.lit("x" * 40), F.lit("trocr"), F.lit(0.5), F.lit(0.25))).endswith("[TrOCR | 0.50 | H:0.25]")
    assert rows(spark, [("Das ist der Hund und die Katze ist nicht da",), ("court",)], language.detected) == ["de", "en"]
