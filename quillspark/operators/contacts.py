"""Phone numbers and dates on text elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import contacts as ct
from quillspark.operators.regions import is_text


def normalize_phones(df: DataFrame) -> DataFrame:
    """Add `normalized_phone` (of one), `normalized_phones` (of several) and `phone_type`; texts that are a date or an address have none."""
    c = F.coalesce("content", F.lit(""))
    found = F.when(is_text() & ~ct.is_date_or_zip(c), F.transform(ct.phones(c), lambda p: p["normalized"]))
    df = df.withColumn("_p", found)
    kind = ct.phone_kind(c)
    return df.withColumns(
        {
            "normalized_phone": F.when(F.size("_p") == 1, F.get("_p", F.lit(0))),
            "normalized_phones": F.when(F.size("_p") > 1, F.col("_p")),
            "phone_type": F.when((F.size("_p") > 0) & (kind != ""), kind),
        }
    ).drop("_p")


def validate(df: DataFrame) -> DataFrame:
    """Add `phone_validation` and `date_validation`, null where nothing is found."""
    c = F.when(is_text() & (F.col("content") != ""), F.col("content"))
    phone = ct.phone_validation(ct.phones(c))
    date = ct.dates(c)
    df = df.withColumn("_p", F.when(ct.mentions_phone(c), phone)).withColumn("_d", F.when(ct.mentions_date(c), date))
    return df.withColumns({"phone_validation": F.when(F.col("_p.status") != "none", F.col("_p")), "date_validation": F.when(F.col("_d.status") != "none", F.col("_d"))}).drop("_p", "_d")
