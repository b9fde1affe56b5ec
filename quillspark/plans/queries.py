"""Registered queries over the driver's tables, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import classify, display, language, metrics
from quillspark.functions import contacts as ct
from quillspark.functions import geometry as g
from quillspark.functions import hallucination as h
from quillspark.functions import image as image_measures
from quillspark.functions import text as tx
from quillspark.operators import cleaning, contacts, layout, regions, routing, scoring, spelling, tables
from quillspark.plans import evaluation, pipeline
from quillspark.plans.fixtures import GRID_COLUMNS, GRID_ROWS, elements
from quillspark.schema import KEY, PAGE, page_window
from quillspark.sources.documents import document_metadata
from quillspark.sources.lineage import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).where("type = 'text'")


def _joined(c: Column) -> Column:
    """A string array as one string, for comparison across engines."""
    return F.array_join(c, "|")


# --- scalar text


@query
def n_scalars(spark, d):
    """N1 underscores, N2 markup, N4 encoding, N5 white space, N6 trailing period, N8 parenthesis, V1 truncation."""
    c = F.col("content")
    return _texts(spark, d).select(
        *KEY,
        tx.normalize_underscores(c).alias("underscores"),
        tx.strip_markup(c).alias("markup"),
        tx.fix_encoding(c).alias("encoding"),
        tx.clean(c).alias("cleaned"),
        tx.trailing_period(c).alias("period"),
        tx.dropped_parenthesis(c).alias("parenthesis"),
        tx.truncate(c).alias("shown"),
    )


@query
def n3_punctuation_spacing(spark, d):
    spaced = F.concat(F.lit("( "), F.regexp_replace("content", "([.,;:])", " $1 "), F.lit(" ) it 's self - made"))
    return _texts(spark, d).select(*KEY, tx.punctuation_spacing(spaced).alias("spaced"))


@query
def n7_decimal_dash(spark, d):
    text, repaired = tx.decimal_dash(F.concat(F.col("content"), F.lit(" •5")))
    return _texts(spark, d).select(*KEY, text.alias("fixed"), repaired.alias("repaired"))


@query
def n9_duplicate_words(spark, d):
    text, removed = tx.repeated_words(F.col("content"))
    return _texts(spark, d).select(*KEY, text.alias("deduplicated"), F.coalesce(removed, F.lit(0)).alias("removed"))


@query
def n10_case_transfer(spark, d):
    """A reading in lower case takes the capitals of the print reading; on every fourth line it has one word more."""
    read = F.when(F.col("g") % 4 == 0, F.concat(F.lower("content"), F.lit(" extra"))).otherwise(F.lower("content"))
    return _texts(spark, d).select(*KEY, tx.transfer_case(F.col("content"), read).alias("cased"))


# --- geometry


@query
def g_page_size(spark, d):
    w, h_ = g.page_size(g.box(), F.lit(500.0), F.lit(400.0), page_window())
    return elements(spark, d).select(*PAGE, w.alias("width"), h_.alias("height")).distinct()


@query
def g_overlaps(spark, d):
    """G2, G3 and G4 for every pair of a text and another element on its page."""
    e = elements(spark, d)
    a = e.where("type = 'text'").select(*KEY, "x1", "y1", "x2", "y2")
    b = e.where("type <> 'text'").select(*PAGE, F.col("elem_idx").alias("o_idx"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = g.box(), g.box("o_")
    j = a.join(b, list(PAGE))
    return j.select(*KEY, "o_idx", F.round(g.overlap_of_smaller(p, q), 6).alias("of_smaller"), F.round(g.overlap_of(p, q, p), 6).alias("of_first"), g.intersects(p, q).alias("touching"))


@query
def g5_word_boxes(spark, d):
    words = g.word_boxes(g.box(), tx.words(F.col("content")))
    e = _texts(spark, d).select(*KEY, F.posexplode(words).alias("i", "w"))
    return e.select(*KEY, "i", "w.word", F.round("w.x1", 4).alias("x1"), F.round("w.x2", 4).alias("x2"))


@query
def g6_too_large(spark, d):
    e = elements(spark, d)
    return e.select(*KEY, "type", g.too_large(g.box(), F.lit(612.0), F.lit(340.0), F.col("type")).alias("too_large"))


@query
def i2_padded_boxes(spark, d):
    p = g.padded(g.box(), 12, F.lit(612.0), F.lit(792.0))
    return _texts(spark, d).select(*KEY, *[c.alias(n) for c, n in zip(p, ("x1", "y1", "x2", "y2"))])


# --- hallucination scoring


@query
def h_scores(spark, d):
    """H1 with its parts H3, H4 and H5, for each text by itself."""
    t = h.scored(_texts(spark, d), F.col("content"), F.col("confidence"), g.box(), F.lit(612.0))
    return t.select(
        *KEY,
        F.round("_score", 6).alias("score"),
        _joined(F.col("_signals")).alias("signals"),
        F.round("_pattern", 6).alias("pattern_score"),
        _joined(F.col("_patterns")).alias("patterns"),
        F.col("_valid").alias("valid"),
        F.col("_repeats").alias("repeats"),
    )


@query
def h2_numeric_columns(spark, d):
    return scoring.numeric_columns(elements(spark, d)).where("in_numeric_column").select(*KEY)


# --- the steps


@query
def step0_sanitize(spark, d):
    e = elements(spark, d)
    raw = e.select(
        *KEY,
        F.when(F.col("g") % 13 != 0, F.col("type")).alias("raw_type"),
        F.col("content").alias("raw_content"),
        F.when(F.col("g") % 11 == 0, F.array(F.lit("1"), F.lit("b"), F.lit("3"), F.lit("4"))).when(F.col("g") % 11 == 1, F.array(F.lit("1"))).otherwise(F.array(*[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])).alias("raw_box"),
        F.when(F.col("g") % 7 == 0, "high").when(F.col("g") % 7 == 1, "1.5").when(F.col("g") % 7 == 2, "-0.5").otherwise(F.col("confidence").cast("string")).alias("raw_confidence"),
    )
    return cleaning.sanitize(raw)


@query
def step1_filter_empty_regions(spark, d):
    return regions.filter_empty_regions(elements(spark, d)).select(*KEY, "type")


@query
def step2_underscore_fields(spark, d):
    return cleaning.normalize_underscore_fields(elements(spark, d)).select(*KEY, "content")


@query
def step3_table_measures(spark, d):
    """T1 to T8: tables over text with their score."""
    t = tables.table_measures(elements(spark, d))
    return t.select(*KEY, F.round("density", 6).alias("density"), "num_columns", "num_rows", F.round("grid_coverage", 6).alias("grid_coverage"), "structure_score", _joined(F.col("structure_signals")).alias("signals"))


@query
def step3_filter_tables(spark, d):
    return tables.filter_invalid_tables(elements(spark, d)).select(*KEY, "type", "structure_score")


@query
def step4_deduplicate_layout(spark, d):
    return regions.deduplicate_layout(elements(spark, d)).select(*KEY, "type")


@query
def step5_hallucinations(spark, d):
    p = scoring.process_hallucinations(elements(spark, d))
    return p.select(*KEY, "type", F.coalesce("hallucination_flag", F.lit(False)).alias("flagged"), "hallucination_score", _joined(F.col("hallucination_signals")).alias("signals"))


@query
def step6_rotated_margin(spark, d):
    return regions.filter_rotated_margin(elements(spark, d)).select(*KEY, "type")


@query
def step7_clean_text(spark, d):
    return cleaning.clean_text(elements(spark, d)).select(*KEY, "content")


def _typed(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "typed").when(F.col("doc_id") % 3 == 1, "mixed").otherwise("handwritten")
    return df.withColumn("document_type", kind)


@query
def step8_classification_override(spark, d):
    p = cleaning.classification_override(_typed(elements(spark, d)))
    o = F.col("classification_override")
    return p.select(*PAGE, "document_type", o["original"].alias("original"), o["reason"].alias("reason"), o["trocr_ratio"].alias("trocr_ratio")).distinct()


@query
def step9_trailing_periods(spark, d):
    return cleaning.strip_trailing_periods(_typed(elements(spark, d))).select(*KEY, "content")


@query
def step10_decimal_dashes(spark, d):
    return cleaning.repair_decimal_dashes(elements(spark, d)).select(*KEY, "content", F.coalesce("decimal_dash_repaired", F.lit(False)).alias("repaired"))


@query
def step11_parentheses(spark, d):
    return cleaning.repair_parentheses(elements(spark, d)).select(*KEY, "content")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The corpus's own words, counted once for all that reads them."""
    return cut(spelling.vocabulary_of(_read(spark, d, "documents")))


@query
def step12_spelling(spark, d):
    """Words with letters misread, corrected against the corpus's own words."""
    vocabulary = _vocabulary(spark, d)
    wrong = vocabulary.where("length(word) >= 5").select(F.translate("word", "eo", "co").alias("wrong")).distinct().join(vocabulary.select(F.col("word").alias("wrong")), "wrong", "left_anti")
    return spelling.corrections(wrong, vocabulary)


@query
def step12_correct_texts(spark, d):
    e = elements(spark, d).where("type = 'text'").withColumn("content", F.translate("content", "eo", "co"))
    return spelling.correct_nonwords(e, _vocabulary(spark, d)).select(*KEY, "content")


@query
def k1_plausible(spark, d):
    """Words against themselves with letters changed, and with one lost."""
    w = _read(spark, d, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 3").distinct()
    other = F.translate("word", "eot", "cof")
    return w.select("word", spelling.is_plausible(F.col("word"), other).alias("swapped"), spelling.is_plausible(F.col("word"), F.expr("substring(word, 2)")).alias("shorter"))


@query
def step13_signature_text(spark, d):
    return cleaning.replace_signature_text(elements(spark, d)).select(*KEY, "content")


@query
def step14_signature_garbage(spark, d):
    return regions.filter_signature_garbage(elements(spark, d)).select(*KEY, "type")


@query
def step15_duplicate_words(spark, d):
    return cleaning.remove_duplicate_words(elements(spark, d)).select(*KEY, "content", "duplicate_words_removed")


def _with_structure(df: DataFrame) -> DataFrame:
    line = lambda b: F.struct(*[F.lit(v).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])
    grid = F.struct(F.array(*map(line, GRID_ROWS)).alias("rows"), F.array(*map(line, GRID_COLUMNS)).alias("columns"), F.array(line(GRID_ROWS[0])).alias("headers"))
    return df.withColumn("structure", F.when((F.col("type") == "table") & (F.col("elem_idx") == 100), grid))


@query
def step16_table_cells(spark, d):
    """T9 to T12."""
    return tables.table_cells(_with_structure(elements(spark, d)))


@query
def step16_absorb_tables(spark, d):
    """T13 and T14: the page in its new order."""
    t = tables.absorb_tables(cut(_with_structure(elements(spark, d))))
    return t.select(*KEY, "type", "content", "num_rows", "num_columns")


@query
def step17_phones(spark, d):
    p = contacts.normalize_phones(elements(spark, d).where("type = 'text'"))
    return p.select(*KEY, "normalized_phone", _joined(F.col("normalized_phones")).alias("normalized_phones"), "phone_type")


@query
def p6_date_or_zip(spark, d):
    return _texts(spark, d).select(*KEY, ct.is_date_or_zip(F.col("content")).alias("date_or_zip"), ct.phone_kind(F.col("content")).alias("kind"))


@query
def step18_validation(spark, d):
    v = contacts.validate(elements(spark, d).where("type = 'text'"))
    shown = F.transform("date_validation.dates", lambda x: F.concat_ws(";", x["raw"], x["format"], x["valid"].cast("string"), _joined(x["issues"])))
    numbers = F.transform("phone_validation.phones", lambda x: x["normalized"])
    return v.select(*KEY, F.col("phone_validation.status").alias("phone_status"), _joined(numbers).alias("phones"), F.col("date_validation.status").alias("date_status"), _joined(shown).alias("dates"))


# --- layout and routing


@query
def r9_cluster_rows(spark, d):
    return layout.cluster_rows(_texts(spark, d)).select(*KEY, "row_id", "reading_idx")


def _detections(spark, d) -> DataFrame:
    """Labelled detections: texts as handwriting boxes, and signatures."""
    e = elements(spark, d)
    hw = e.where("type = 'text' and g % 5 = 0").select(*PAGE, F.col("elem_idx").alias("det_idx"), F.lit("handwritten text").alias("label"), "x1", "y1", "x2", (F.col("y2") + 30).alias("y2"))
    more = e.where("type = 'text' and g % 10 = 0").select(*PAGE, (F.col("elem_idx") + 40).alias("det_idx"), F.lit("handwritten text").alias("label"), (F.col("x1") + 2).alias("x1"), "y1", "x2", (F.col("y2") + 30).alias("y2"))
    s = e.where("type = 'signature'").select(*PAGE, F.col("elem_idx").alias("det_idx"), F.lit("A Signature").alias("label"), "x1", "y1", "x2", "y2")
    return hw.unionByName(more).unionByName(s)


@query
def r2_handwritten_regions(spark, d):
    """R1 and R2."""
    return layout.handwritten_regions(_detections(spark, d))


@query
def r_route_lines(spark, d):
    """R3 to R7 over lines, second readings, signature regions and page classes."""
    e = elements(spark, d)
    found = e.where("type = 'signature'").select(*PAGE, F.lit(0).alias("region_idx"), F.lit("signature").alias("type"), "x1", "y1", "x2", "y2")
    lines = e.where("type = 'text'").select(*KEY, F.col("content").alias("text"), "x1", "y1", "x2", "y2", "confidence", "g")
    lines = routing.line_regions(lines, found)
    sure = F.element_at(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.9))), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = _typed(lines).withColumns({"hw_text": F.lower("text"), "hw_conf": ((F.col("g") * 53) % 101).cast("double") / 100, "document_confidence": sure, "has_signature": F.col("doc_id") % 2 == 0, "page_height": F.lit(600.0)})
    r = routing.route_lines(lines)
    return r.select(*KEY, "region_type", "route", "content", "source_model", F.coalesce("in_signature_region", F.lit(False)).alias("in_signature_region"))


@query
def r8_page_text(spark, d):
    return routing.page_text(_texts(spark, d)).select(*PAGE, F.md5("text").alias("text_md5"), (F.length(tx.strip(F.col("text"))) > 20).alias("long_enough"))


@query
def r10_visual_elements(spark, d):
    e = elements(spark, d).where("type <> 'text'").withColumn("label", F.initcap("type"))
    v = routing.visual_elements(e, F.lit(612.0), F.lit(340.0), ("table", "logo", "signature", "seal", "figure"))
    p = routing.grounded_phrases(e, F.lit(612.0), F.lit(340.0))
    return v.select(*KEY, "type", F.lit("").alias("description")).unionByName(p.select(*KEY, "type", "description"))


@query
def r12_append_order(spark, d):
    e = elements(spark, d)
    return layout.append_order(e.where("type = 'text'"), e.where("type = 'table'"), e.where("type not in ('text', 'table')")).select(*KEY, "type")


@query
def i7_calibration(spark, d):
    return _read(spark, d, "events").select("event_id", F.round(routing.calibrated_confidence(-F.col("value") / 40), 6).alias("confidence"))


@query
def i9_structure_parts(spark, d):
    """I9 and I10: parts by label, shifted to the page, in order."""
    e = elements(spark, d).where("type = 'text'")
    names = F.array(*map(F.lit, ("table row", "table column", "table column header", "table spanning cell", "table projected row header", "table")))
    dets = e.select(*PAGE, F.lit(0).alias("t_idx"), F.col("elem_idx").alias("det_idx"), F.element_at(names, (F.col("g") % 6 + 1).cast("int")).alias("label"), "confidence", "x1", "y1", "x2", "y2", F.lit(30.0).alias("t_x1"), F.lit(20.0).alias("t_y1"))
    s = routing.structure_parts(dets)
    shown = lambda c, k: _joined(F.transform(c, lambda p: p[k].cast("int").cast("string"))).alias(c)
    return s.select(*PAGE, shown("rows", "y1"), shown("columns", "x1"), shown("headers", "y1"), shown("cells", "y1"))


# --- classification


@query
def c_features(spark, d):
    """C3, C5, C6, C7, C10 and I5 as aggregates over events: a user a page, an event a component or line."""
    e = _read(spark, d, "events").withColumns({"height": (F.col("value") % 40) + 5, "angle": (F.col("event_id") * 7 % 61 - 30).cast("double"), "area": (F.col("event_id") % 900).cast("double")})
    return e.groupBy("user_id").agg(
        F.round(classify.character_uniformity(F.col("height")), 6).alias("uniformity"),
        F.round(classify.line_regularity(F.col("angle")), 6).alias("line"),
        F.round(classify.angle_variance(F.col("angle")), 4).alias("angle_variance"),
        F.round(classify.stroke_variance(F.col("height")), 6).alias("stroke"),
        F.round(classify.skew(F.col("angle")), 6).alias("skew"),
        classify.is_signature(F.lit(0.01), F.col("area"), F.col("height"), F.lit(40_000), F.lit(100), F.lit(400)).alias("signature"),
    )


@query
def c_page_class(spark, d):
    """C11 to C14 over features made by arithmetic."""
    f = _read(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderkey") * k % m / float(m)).alias(n) for n, k, m in (("stroke", 7, 11), ("line", 13, 101), ("form", 5, 13), ("uniformity", 3, 17))], (F.col("o_orderkey") * 37 % 2000).cast("double").alias("angle"), (F.col("o_orderkey") * 11 % 20 / 100.0).alias("edge"), (F.col("o_orderkey") % 3 == 0).alias("sig"), (F.col("o_orderkey") % 5 == 0).alias("fax"))
    s = classify.typed_score(*[F.col(c) for c in ("stroke", "line", "angle", "edge", "form", "uniformity", "sig", "fax")])
    r = f.withColumn("s", F.when(F.col("o_orderkey") % 97 != 0, s)).withColumn("c", classify.page_class(F.col("s")))
    return r.select("o_orderkey", F.round("s", 6).alias("typed_score"), "c.document_type", F.round("c.confidence", 6).alias("confidence"))


#: Pages that a task measures, some hundredths of a second each.
PAGES_A_TASK = 250


@query
def c_pixels(spark, d):
    """C1 to C4, C9 and C15: measures of pixels and what follows from them, over pages with bars by arithmetic on the supplier's key."""
    k = F.col("s_suppkey").cast("int")
    t, body, head, foot = 2 + k % 3, 15 + k % 61, F.when(k % 2 == 1, 20 + k % 40).otherwise(0), F.when(k % 3 == 0, 15 + k % 30).otherwise(0)
    hexes = lambda what, n: F.expr(f"repeat('{what}', {n})") if isinstance(n, int) else F.repeat(F.lit(what), n)
    row = lambda x, n: F.concat(hexes("FF", x), hexes("00", n), hexes("FF", 200 - x - n))
    blank = lambda n: hexes("FF" * 200, n)
    image = F.concat(blank(10), F.repeat(row(10, head), t), blank(50 - t), F.repeat(row(10, body), t), blank(130 - t), F.repeat(row(30, foot), F.lit(6)), blank(24))
    keys = spread(_read(spark, d, "supplier").select("s_suppkey"), PAGES_A_TASK)
    m = keys.select("s_suppkey", image_measures.measures()(F.lit(220), F.lit(200), F.unhex(image)).alias("m"))
    f = classify.measured_flags(F.col("m"))
    zone = classify.signature_zone(f["has_signature"])
    return m.select(
        "s_suppkey",
        F.col("m.horizontal").alias("horizontal"),
        F.col("m.vertical").alias("vertical"),
        F.round(f["form"], 6).alias("form"),
        f["has_signature"].alias("has_signature"),
        f["has_fax_header"].alias("has_fax_header"),
        F.array_join(zone.cast("array<string>"), ",").alias("zone"),
    )


@query
def i5_line_skew(spark, d):
    """I5's gates over lines by arithmetic, an event a line and a user a page."""
    e = _read(spark, d, "events").withColumns({"x1": F.col("event_id") % 7, "y1": F.col("event_id") % 11})
    e = e.withColumns({"x2": F.col("x1") + F.col("event_id") * 13 % 50 - 10, "y2": F.col("y1") + F.col("event_id") * 17 % 7 - 2})
    return e.groupBy("user_id").agg(F.round(classify.line_skew(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 6).alias("skew"))


@query
def i8_table_detections(spark, d):
    dets = _texts(spark, d).select(*KEY, "confidence", (F.col("g") % 3).alias("label_id"))
    return routing.table_detections(dets).select(*KEY, "confidence")


@query
def i11_language(spark, d):
    return _read(spark, d, "documents").select("doc_id", language.detected(F.col("text")).alias("language"))


@query
def e8_metadata(spark, d):
    """First pages: none, without a class, or with one."""
    page = F.struct(F.when(F.col("doc_id") % 3 != 1, F.col("lang")).alias("document_type"), (F.col("n_chars") % 100 / 100).alias("classification_confidence"))
    docs = _read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.array(page)).otherwise(F.array()).alias("pages"))
    return document_metadata(docs)


# --- evaluation


def _pairs(spark, d) -> DataFrame:
    """Every line of the documents, and the same with letters misread and, on even lines, a word lost."""
    lines = _read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "truth"))
    t = lines.withColumn("line_no", F.col("line_no").cast("long"))
    heard = F.translate("truth", "eo.", "co,")
    return t.withColumn("heard", F.when(F.col("line_no") % 2 == 0, F.regexp_replace(heard, "^\\S+\\s+", "")).otherwise(heard))


@query
def e_character_metrics(spark, d):
    """E1 to E4 by characters, for each pair."""
    p = _pairs(spark, d)
    m = metrics.character_measures(F.col("truth"), F.col("heard"))
    rates = [F.round(m[c], 9).alias(c) for c in ("strict_cer", "flexible_cer")]
    return p.select("doc_id", "line_no", *rates, F.size(metrics.tokens(F.col("truth"))).alias("total_ref_words"), m["total_ref_chars"].alias("total_ref_chars"))


@query
def e_metrics(spark, d):
    """E1 to E6 for each pair."""
    p = metrics.evaluate(_pairs(spark, d), F.col("truth"), F.col("heard"))
    rates = [F.round(c, 9).alias(c) for c in ("strict_wer", "flexible_wer", "strict_cer", "flexible_cer")]
    return p.select("doc_id", "line_no", *rates, "formatting_errors", "content_errors", "total_ref_words", "total_ref_chars")


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    p = _pairs(spark, d).withColumn("doc_id", F.col("doc_id") * 1_000_000 + F.col("line_no"))
    kind = F.when(F.col("doc_id") % 3 == 0, "typed").when(F.col("doc_id") % 3 == 1, "handwritten").otherwise("other")
    truth = p.select("doc_id", F.col("truth").alias("ground_truth"), kind.alias("truth_type"))
    output = p.select("doc_id", F.col("heard").alias("text"), F.lit("typed").alias("doc_type"), F.lit(0.5).alias("confidence"))
    return truth, evaluation.score_documents(truth, output)


@query
def e9_pass_fail(spark, d):
    _, s = _scored(spark, d)
    return s.select("doc_id", "truth_type", F.round("flexible_wer", 9).alias("flexible_wer"), F.round("flexible_cer", 9).alias("flexible_cer"), "wer_limit", "cer_limit", "wer_pass", "cer_pass", "passed")


@query
def e10_summary(spark, d):
    truth, s = _scored(spark, d)
    m = evaluation.summary(s, truth)
    return m.select("expected", "total", "passed", *[F.round(c, 9).alias(c) for c in ("avg_wer", "avg_cer", "avg_flexible_wer", "avg_flexible_cer")], "formatting_errors", "content_errors", "succeeded")


@query
def e11_baseline(spark, d):
    truth, s = _scored(spark, d)
    now = evaluation.summary(s, truth)
    before = now.select(F.lit(0.25).alias("avg_wer"), F.lit(0.10).alias("avg_cer"), (F.col("passed") - 1).alias("passed"), "total")
    c = evaluation.compare(now, before)
    return c.select(F.round("wer_delta", 7).alias("wer_delta"), F.round("cer_delta", 7).alias("cer_delta"), "passed_before", "passed", "total_before", "total")


@query
def e7_document_text(spark, d):
    e = tables.absorb_tables(cut(_with_structure(elements(spark, d))))
    t = evaluation.document_text(e)
    return t.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query
def v_display(spark, d):
    """V2 and V3 by document."""
    e = elements(spark, d)
    kind = display.bucket(F.col("type"), F.col("source_model"))
    shown = e.select("doc_id", kind.alias("kind"), display.colour(F.col("type"), F.col("source_model"), F.col("confidence")).alias("colour"))
    return shown.groupBy("doc_id", "kind", "colour").agg(F.count("*").alias("n"))


# --- whole plans


@query
def postprocess_all(spark, d):
    """All steps, flattened."""
    p = pipeline.postprocess(_typed(_with_structure(elements(spark, d))), _vocabulary(spark, d))
    return p.select(*KEY, "type", "content", "document_type", "structure_score", "hallucination_score", "num_rows", "num_columns", "normalized_phone", "phone_type", F.col("date_validation.status").alias("date_status"), F.col("phone_validation.status").alias("phone_status"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Underscores, cleaning and phones over the element relation."""
    e = cleaning.clean_text(cleaning.normalize_underscore_fields(elements(spark, d)))
    return contacts.normalize_phones(e).where("phone_type is not null").select(*KEY, "content", "normalized_phone", "phone_type")
