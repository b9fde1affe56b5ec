"""Operators and whole plans over small pages, and the registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark import sql
from quillspark.operators import cleaning, layout, regions, scoring, spelling, tables
from quillspark.plans import evaluation, pipeline
from quillspark.plans.queries import QUERIES

COLUMNS = "doc_id long, page_no long, elem_idx long, type string, content string, x1 double, y1 double, x2 double, y2 double, confidence double, source_model string"


def page(spark, *elements):
    return spark.createDataFrame([(1, 1, i, *e) for i, e in enumerate(elements)], COLUMNS)


def text(content, x1=100, y1=100, x2=300, y2=120, conf=0.95, model="surya"):
    return ("text", content, float(x1), float(y1), float(x2), float(y2), conf, model)


def region(kind, *b, conf=0.9):
    return (kind, None, *map(float, b), conf, None)


def left(df):
    return [r.elem_idx for r in df.orderBy("elem_idx").collect()]


def test_regions(spark):
    df = page(spark, text("a"), region("table", 90, 90, 310, 130), region("table", 800, 800, 900, 900), region("layout_region", 0, 0, 400, 400), region("layout_region", 0.001, 0, 400, 400), ("layout_region", None, None, None, None, None, 0.5, None))
    assert left(regions.filter_empty_regions(df)) == [0, 1, 3, 4]
    assert left(regions.deduplicate_layout(df)) == [0, 1, 2, 3, 5]
    sig = page(spark, region("Signature", 90, 90, 310, 130), text("elevens."), text("12/3/98"), text("two words"), text("far", y1=500, y2=520))
    assert left(regions.filter_signature_garbage(sig)) == [0, 2, 3, 4]
    margin = page(spark, text("body", 0, 0, 1000, 20), text("x", 950, 50, 960, 90), text("12345", 950, 100, 960, 190), text("12", 950, 200, 960, 290))
    assert left(regions.filter_rotated_margin(margin)) == [0, 2]


def test_hallucinations_and_numeric_columns(spark):
    numbers = [text(str(10 + i), 500, 100 + 30 * i, 515, 112 + 30 * i, 0.3) for i in range(3)]
    df = page(spark, text("A complete sentence here", 100, 20, 900, 40), *numbers, text("///", 5, 400, 15, 408, 0.2), text("7", 700, 300, 715, 312, 0.3))
    got = {r.elem_idx: r for r in scoring.process_hallucinations(df).collect()}
    assert 4 not in got and {1, 2, 3} <= set(got) and got[1].hallucination_flag is None


def test_override_and_periods(spark):
    df = page(spark, text("One.", model="trocr"), text("Two.", model="trocr"), text("Three.")).withColumn("document_type", F.lit("typed"))
    over = cleaning.classification_override(df)
    r = over.first()
    assert r.document_type == "handwritten" and r.classification_override.trocr_ratio == 0.67
    assert [x.content for x in cleaning.strip_trailing_periods(over).collect()] == ["One.", "Two.", "Three."]
    assert [x.content for x in cleaning.strip_trailing_periods(df).collect()] == ["One", "Two", "Three."]
    dashes = cleaning.repair_decimal_dashes(page(spark, text("Total 14.00"), text("Factor -88 applied")))
    assert [x.content for x in dashes.collect()] == ["Total 14.00", "Factor .88 applied"]
    assert [x.content for x in cleaning.repair_decimal_dashes(page(spark, text("Factor -88 applied"))).collect()] == ["Factor -88 applied"]


def with_grid(df, rows, cols):
    line = lambda b: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])
    return df.withColumn("structure", F.when(F.col("type") == "table", F.struct(F.array(*map(line, rows)).alias("rows"), F.array(*map(line, cols)).alias("columns"), F.array(line(rows[0])).alias("headers"))))


def test_cells_of_a_two_by_two_grid(spark):
    df = page(spark, text("before", 0, 0, 60, 10), text("A", 10, 22, 40, 38), text("B", 60, 22, 90, 38), text("C", 10, 62, 40, 78), text("D", 60, 62, 90, 78), text("after", 0, 200, 60, 210), region("table", 0, 20, 100, 100))
    df = with_grid(df, [(0, 20, 100, 58), (0, 62, 100, 100)], [(0, 20, 48, 100), (52, 20, 100, 100)])
    cells = {(r.row, r.col): (r.content, r.is_header) for r in tables.table_cells(df).collect()}
    assert cells == {(0, 0): ("A", True), (0, 1): ("B", True), (1, 0): ("C", False), (1, 1): ("D", False)}
    out = tables.absorb_tables(df).orderBy("elem_idx").collect()
    assert [(r.type, r.content) for r in out] == [("text", "before"), ("table", None), ("text", "after")] and out[1].num_rows == 2 == out[1].num_columns
    nested = pipeline.nested(tables.absorb_tables(df).withColumn("document_type", F.lit("typed"))).first()
    assert [e.type for e in nested.pages[0].elements] == ["text", "table", "text"]
    assert evaluation.document_text(tables.absorb_tables(df)).first().text == "before A B C D after"


def test_reading_order_is_anchored(spark):
    df = page(spark, text("c", 300, 104, 320, 110), text("a", 10, 100, 30, 110), text("b", 10, 109, 30, 115), text("d", 10, 300, 30, 310))
    got = {r.elem_idx: (r.row_id, r.reading_idx) for r in layout.cluster_rows(df).collect()}
    assert got == {1: (0, 0), 0: (0, 1), 2: (1, 2), 3: (2, 3)}


def corrections_by_force(wrong, vocabulary):
    pairs = {frozenset(p) for p in spelling.CONFUSED}

    def edits(w):
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        abc = "abcdefghijklmnopqrstuvwxyz"
        return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in abc} | {a + c + b for a, b in cut for c in abc}

    def plausible(w, c):
        if len(w) == len(c):
            d = [frozenset(p) for p in zip(w, c) if p[0] != p[1]]
            return 0 < len(d) <= 2 and all(x in pairs for x in d)
        s, l = sorted((w, c), key=len)
        lost = [l[i] for i in range(len(l)) if l[:i] + l[i + 1 :] == s]
        return bool(lost) and lost[0] not in "ksxz"

    out = {}
    for w in wrong:
        found = {e for e in edits(w) if e in vocabulary} or {v for v in vocabulary if len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 2}
        good = sorted((v for v in found if plausible(w, v)), key=lambda v: (-vocabulary[v], v))
        if good:
            out[w] = good[0]
    return out


def test_corrections_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    vocabulary = {"".join(rng.choice("acehilnotu") for _ in range(rng.randrange(5, 8))): rng.randrange(1, 50) for _ in range(400)}
    wrong = {w.replace("e", "c", 1).replace("l", "i", 1) for w in vocabulary} | {w[1:] for w in list(vocabulary)[:100]}
    wrong = sorted(w for w in wrong if w not in vocabulary)
    got = spelling.corrections(spark.createDataFrame([(w,) for w in wrong], "wrong string"), spark.createDataFrame(list(vocabulary.items()), "word string, freq long"))
    assert {r.wrong: r.right for r in got.collect()} == corrections_by_force(wrong, vocabulary)


def test_long_words_are_corrected_as_short_ones(spark):
    import random

    rng = random.Random(6)
    vocabulary = {"".join(rng.choice("acehilnotu") for _ in range(n)): 1 + n % 7 for n in (15, 16, 17, 18, 25, 30, 31, 32, 33, 34, 35, 50, 51) for _ in range(12)}
    wrong = set()
    for k, w in enumerate(vocabulary):
        i, j = sorted(rng.sample(range(len(w) - 1), 2))
        swap = lambda x, at: x[:at] + {"e": "c", "a": "o", "l": "i", "h": "n"}.get(x[at], x[at]) + x[at + 1 :]
        wrong |= {swap(w, i), swap(swap(w, i), j), w[:i] + w[i + 1 :], w[:j] + "t" + w[j:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
    wrong = sorted(w for w in wrong if w not in vocabulary)
    got = spelling.corrections(spark.createDataFrame([(w,) for w in wrong], "wrong string"), spark.createDataFrame(list(vocabulary.items()), "word string, freq long"))
    assert {r.wrong: r.right for r in got.collect()} == corrections_by_force(wrong, vocabulary)


def test_spelling_guards(spark):
    vocabulary = spark.createDataFrame([("hello", 5), ("house", 3)], "word string, freq long")
    df = page(spark, text("hcllo, HCLLOO  Hcllo hcll0 a-hcllo HCLLO house"), text(""))
    got = spelling.correct_nonwords(df, vocabulary).orderBy("elem_idx").collect()
    assert got[0].content == "hello, HCLLOO Hcllo hcll0 a-hcllo HCLLO house"


def test_whole_pipeline(spark):
    df = page(spark, text("FAX: 555-123-4567  ", 100, 100, 400, 120), text("Date 13/2/1998", 100, 140, 300, 160), text("///", 2, 500, 12, 508, 0.2), text("word word here.", 100, 200, 300, 220, model="trocr"), text("wide", 100, 600, 1000, 620))
    got = {r.elem_idx: r for r in pipeline.postprocess(df).collect()}
    assert [r.content for _, r in sorted(got.items())] == ["FAX: 555-123-4567", "Date 13/2/1998", "word here", "wide"]
    assert got[0].normalized_phone == "(555) 123-4567" and got[0].phone_type == "fax" and got[1].date_validation.status == "suspicious"
    assert pipeline.postprocess(df.limit(0)).count() == 0
    log = {}
    vocabulary = spark.createDataFrame([("word", 9)], "word string, freq long")
    assert pipeline.postprocess(df, vocabulary, log=log).count() == 4
    assert len(log) == 18 and log["empty regions"].get == {"elements": 5, "texts": 5} and log["validation"].get == {"elements": 4, "texts": 4}


def test_sql_functions(spark):
    assert len(sql.register(spark)) == 6
    r = spark.sql("SELECT qs_underscores('_ _ _ _') a, qs_overlap(0D, 0D, 10D, 10D, 5D, 5D, 7D, 7D) b, qs_punctuation('( a . )') c").first()
    assert (r.a, r.b, r.c) == ("___", 1.0, "(a.)")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "events", "orders", "supplier"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


ORACLES = __spark_entry__.oracle_sql()
SLOW = {"e_character_metrics", "e9_pass_fail", "e11_baseline"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and n not in SLOW])
def test_query_equals_oracle(spark, sf, duck, name):
    a = QUERIES[name](spark, sf).toArrow()
    b = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    show = lambda v: "%.9g" % v if isinstance(v, float) else repr(v)
    rows = lambda t: sorted(tuple(map(show, r)) for r in zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)]))
    got = rows(a)
    assert got and got == rows(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
