"""The canonical relation: one row for each element of a page."""

from __future__ import annotations

from pyspark.sql.window import Window

PAGE = ("doc_id", "page_no")
KEY = (*PAGE, "elem_idx")
BOX = ("x1", "y1", "x2", "y2")
ELEMENT = (*KEY, "type", "content", *BOX, "confidence", "source_model")


def page_window() -> Window:
    """All elements of a page; every page-scoped operator shares this partitioning, so one exchange serves them all."""
    return Window.partitionBy(*PAGE)
