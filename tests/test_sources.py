"""Sources, sinks, streams and the command line."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import display, image
from quillspark.operators import cleaning
from quillspark.sources import documents, sinks
from quillspark.streaming import run_batches, stream_elements, windowed_counts


def png(pixels: np.ndarray) -> bytes:
    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_folder_listing_images_and_adapters(spark, tmp_path):
    g = np.full((60, 80), 255)
    g[10:20, 10:40] = 0
    g[40:50, 50:70] = 0
    (tmp_path / "a.PNG").write_bytes(png(g))
    (tmp_path / "b.txt").write_bytes(b"no")
    known, skipped = documents.list_documents(spark, str(tmp_path))
    assert known.count() == 1 and skipped.count() == 1
    images = documents.read_images(spark, str(tmp_path))
    parts = images.select(F.explode(image.components()("height", "width", "data")).alias("c")).collect()
    assert sorted((r.c.area, r.c.width, r.c.height) for r in parts) == [(200, 20, 10), (300, 30, 10)]
    assert images.select(image.noise()("height", "width", "data").alias("n")).first().n >= 0.0
    files = documents.read_contents(spark, str(tmp_path))

    def rasterize(content, dpi):
        if dpi != 72:
            raise ValueError("no such resolution")
        return [content, content]

    assert documents.with_pages(files, rasterize, 72).count() == 2
    failed = documents.with_pages(files, rasterize, 99).first()
    assert failed.page_no is None and failed.processing_error == "no such resolution"
    lines = documents.with_recognizer(documents.with_pages(files, rasterize, 72), lambda: lambda b: [{"text": "x", "confidence": 0.5}], "text string, confidence double")
    assert lines.count() == 2 and lines.first().text == "x"


def line(content, y, confidence):
    return dict(content=content, type="text", bbox=[10, y, 300, y + 20], confidence=confidence, source_model="surya")


MARK = dict(bbox=["x", 1, 2, 3], confidence="high", type="logo")
PAGE = dict(document_type="typed", page_number=1, classification_confidence=0.9, elements=[line("Name:     ", 10, 0.9), line("The quick  brown fox jumps", 40, 7), MARK])
OUTPUT = dict(pages=[PAGE], filename="a.png")


def test_json_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc1.json").write_text(json.dumps(OUTPUT))
    (tmp_path / "in" / "doc2.json").write_text(json.dumps({"filename": "b.pdf", "pages": [], "processing_error": "broken"}))
    raw = documents.read_output(spark, str(tmp_path / "in"))
    e = {r.elem_idx: r for r in cleaning.sanitize(raw).collect()}
    assert e[0].doc_id == "doc1" and e[1].confidence == 1.0 and e[2].x1 is None and e[2].confidence == 0.0
    assert documents.read_errors(spark, str(tmp_path / "in")).first().processing_error == "broken"
    (tmp_path / "gt.json").write_text(json.dumps({"doc1": {"ground_truth": "The quick brown fox jumps", "document_type": "typed"}}))
    args = ["--input_dir", str(tmp_path / "in"), "--output_dir", str(tmp_path / "out"), "--ground_truth", str(tmp_path / "gt.json")]
    code = cli.main([*args, "--save-baseline", str(tmp_path / "base")])
    assert cli.main([*args, "--compare", str(tmp_path / "base")]) == code
    out = spark.read.text(str(tmp_path / "out" / "documents")).first().value
    page = json.loads(out)["pages"][0]
    assert page["elements"][1]["content"] == "The quick brown fox jumps" and "phone_type" not in page["elements"][1]
    assert json.loads(spark.read.text(str(tmp_path / "out" / "errors")).first().value) == {"filename": "b.pdf", "pages": [], "processing_error": "broken"}
    shown = str(tmp_path / "shown")
    assert cli.main([*args, "--display_dir", shown, "--no-content", "--no-confidence"]) == code
    assert {r.label for r in spark.read.schema("type string, label string").json(shown).where("type = 'text'").collect()} == {""}
    assert sinks.load_baseline(spark, str(tmp_path / "base")).first().total == 1


def test_what_a_viewer_shows(spark):
    row = (1, 1, 0, "text", "Name: x", 1.0, 2.0, 3.0, 4.0, 0.9, "trocr")
    df = spark.createDataFrame([row, (1, 1, 1, "layout_region", None, 0.0, 0.0, 9.0, 9.0, None, None)], "doc_id long, page_no long, elem_idx long, type string, content string, x1 double, y1 double, x2 double, y2 double, confidence double, source_model string")
    assert [r.label for r in display.shown(df).collect()] == ["Name: x [TrOCR | 0.90]"]
    assert [r.label for r in display.shown(df, True, False, False).orderBy("elem_idx").collect()] == ["[TrOCR]", None]


def test_stream_of_documents(spark, tmp_path, sf):
    columns = "doc_id long, page_no long, elem_idx long, type string, content string"
    rows = [(i, 1, 0, "text", f"  spaced   text {i} ") for i in range(6)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "in"))
    source = stream_elements(spark, str(tmp_path / "in"), columns)
    q = run_batches(source, str(tmp_path / "out"), str(tmp_path / "cp"), cleaning.clean_text)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.where("content like '%  %'").count() == 0
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    q = windowed_counts(events).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM counted").first().n == spark.read.parquet(f"{sf}/events.parquet").count()
