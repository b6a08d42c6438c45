"""Layout of recognised text: blocks to lines, lines to tables, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions.text import rlike, strip

LEAST_CONFIDENCE = 0.6
DEFAULT_CONFIDENCE = 0.8
SEPARATOR = "\n\n--- Page Break ---\n\n"


def decoded_blocks(raw: DataFrame, *keys: str) -> DataFrame:
    """Blocks with their centres (of corners 0 and 2). Blank ones, those under .6 and those without four corners go."""
    c = F.coalesce(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE))
    centre = lambda k: (F.col("bbox")[0][k] + F.col("bbox")[2][k]) / 2
    kept = raw.filter((strip(F.coalesce("text", F.lit(""))) != "") & (c >= LEAST_CONFIDENCE) & (F.size("bbox") == 4) & F.forall("bbox", lambda p: F.size(p) >= 2))
    return kept.select(*keys, "block_no", strip(F.col("text")).alias("text"), c.alias("confidence"), "bbox", centre(0).alias("x_center"), centre(1).alias("y_center"))


def lines(blocks: DataFrame, keys: list[str], dpi: int = 200) -> DataFrame:
    """(keys, line_no, text): blocks by y, then x; a new line begins where y is max(12, dpi // 7) or more from the block before."""
    gap = max(12, dpi // 7)
    by = Window.partitionBy(*keys).orderBy("y_center", "x_center", "block_no")
    new = (F.abs(F.col("y_center") - F.lag("y_center").over(by)) >= gap).cast("int")
    n = blocks.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("line_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("y_center", "x_center", "block_no", "text")))
    return n.groupBy(*keys, "line_no").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"))


def page_text(assembled: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return assembled.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def page_confidence(blocks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence of a page's blocks; 0.0 where it has none."""
    mean = blocks.groupBy(*keys).agg(F.avg("confidence").alias("confidence"))
    return pages.select(*keys).join(mean, keys, "left").fillna(0.0, ["confidence"])


def is_table_row(line: Column) -> Column:
    """A pay-item code, or a unit and a number."""
    return rlike(line, r"\d{3}-\d{1,3}-\d{1,3}") | (rlike(line, r"(?i)\b(LF|EA|SY|CY|SF|TON|LS|GAL|AC)\b") & rlike(line, r"\b\d+(?:[.,]\d+)*\b"))


def cells(line: Column) -> Column:
    """A row's cells: parted by two blanks or more, or a tab."""
    return F.filter(F.transform(F.split(strip(line), r"\s{2,}|\t"), strip), lambda c: c != "")


def tables(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, table_no, rows): runs of two table rows or more."""
    at = pages.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).filter(is_table_row(F.col("line")))
    by = Window.partitionBy(*keys).orderBy("line_no")
    runs = at.withColumn("_run", F.col("line_no") - F.row_number().over(by))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", cells(F.col("line")).alias("cells")))), lambda x: x["cells"])
    found = runs.groupBy(*keys, "_run").agg(F.min("line_no").alias("first_line"), rows.alias("rows")).filter(F.size("rows") >= 2)
    return found.withColumn("table_no", F.row_number().over(Window.partitionBy(*keys).orderBy("first_line"))).drop("_run")


def document_text(pages: DataFrame, file_col: str = "file_id", page_col: str = "page_num", text_col: str = "text") -> DataFrame:
    """Pages of a document, each headed by its number, joined by page breaks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("n"), F.col(text_col).alias("t"))))
    parts = F.transform(ordered, lambda p: F.concat(F.lit("[Page "), p["n"].cast("string"), F.lit("]\n"), F.coalesce(p["t"], F.lit(""))))
    return pages.groupBy(file_col).agg(F.array_join(parts, SEPARATOR).alias("text"), F.count(F.lit(1)).alias("page_count"))


def blocks_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.explode("text_blocks").alias("b")).select(*keys, "b.*")
