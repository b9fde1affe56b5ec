"""Sources: folders of documents, images, nested JSON output, ground truth, and recognizers behind adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = tuple("avif bmp gif heic jpeg jpg pdf png tif tiff webp".split())

RAW_ELEMENT = "type:string,content:string,bbox:array<string>,confidence:string,source_model:string,description:string"
RAW_PAGE = f"page_number:bigint,document_type:string,classification_confidence:double,language:string,elements:array<struct<{RAW_ELEMENT}>>"
RAW_DOCUMENT = f"filename string, processing_error string, pages array<struct<{RAW_PAGE}>>"


def list_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of a folder, by extension, whatever its case; subfolders aren't entered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length", "modificationTime")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    known = F.col("extension").isin(*EXTENSIONS)
    return files.where(known), files.where(~known)


def _known(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (png, jpg, bmp, gif) with origin, height, width, mode, data and processing_error: a file that can't be decoded is a row with that and without pixels.

    Other formats (tif, webp, heic, avif) are such rows too; `with_pages` takes a decoder for them.
    """
    i = spark.read.format("image").load(path).select("image.*").where(_known("origin"))
    broken = F.col("height") < 0
    shown = [F.when(~broken, F.col(c)).alias(c) for c in ("height", "width", "nChannels", "mode", "data")]
    return i.select("origin", *shown, F.when(broken, F.lit("image can't be decoded")).alias("processing_error"))


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the documents of a folder, for `with_pages`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.where(_known("path"))


def with_pages(files: DataFrame, rasterize: Callable[[bytes, int], list[bytes]], dpi: int = 200) -> DataFrame:
    """(path, page_no, image, processing_error): files through a rasterizer, in Arrow batches; a failing file is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i + 1, image, None) for i, image in enumerate(rasterize(content, dpi))]
                except Exception as e:  # noqa: BLE001  whatever a decoder raises goes to the error column
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "image", "processing_error"])

    return files.mapInPandas(run, "path string, page_no int, image binary, processing_error string")


def with_recognizer(pages: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], schema: str) -> DataFrame:
    """Pages through a recognizer: `load` is called once a worker, its result once an image; rows carry path and page_no first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognize = load()
        for batch in batches:
            rows = [{"path": p, "page_no": n, **r} for p, n, image in zip(batch["path"], batch["page_no"], batch["image"]) for r in recognize(image)]
            names = ["path", "page_no", *[c.strip().split()[0] for c in schema.split(",")]]
            yield pd.DataFrame(rows, columns=names)

    return pages.where("image is not null").select("path", "page_no", "image").mapInPandas(run, f"path string, page_no int, {schema}")


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Raw elements of nested JSON files: doc_id is the file's stem; fields stay strings for `sanitize`."""
    docs = spark.read.schema(RAW_DOCUMENT).json(path, multiLine=True).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    pages = docs.select("doc_id", F.posexplode("pages").alias("p", "page"))
    e = pages.select("doc_id", F.coalesce("page.page_number", F.col("p") + 1).cast("long").alias("page_no"), F.coalesce("page.document_type", F.lit("typed")).alias("document_type"), F.posexplode("page.elements").alias("elem_idx", "e"))
    return e.select("doc_id", "page_no", F.col("elem_idx").cast("long").alias("elem_idx"), "document_type", F.col("e.type").alias("raw_type"), F.col("e.content").alias("raw_content"), F.col("e.bbox").alias("raw_box"), F.col("e.confidence").alias("raw_confidence"), F.col("e.source_model").alias("source_model"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(filename, processing_error) of the documents that failed."""
    return spark.read.schema(RAW_DOCUMENT).json(path, multiLine=True).where("processing_error is not null").select("filename", "processing_error")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ground_truth, truth_type) of a JSON object by document."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<ground_truth:string,document_type:string>>")
    return text.select(F.explode(entries).alias("doc_id", "v")).select("doc_id", "v.ground_truth", F.col("v.document_type").alias("truth_type"))


def document_metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, doc_type, confidence) of each document's first page, unknown and 0 where it has none."""
    first = F.try_element_at("pages", F.lit(1))
    return pages.select("doc_id", F.coalesce(first["document_type"], F.lit("unknown")).alias("doc_type"), F.coalesce(first["classification_confidence"], F.lit(0.0)).alias("confidence"))
