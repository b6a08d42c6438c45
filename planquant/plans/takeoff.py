"""The take-off pipeline over pages: extract, gate, price, categorise, report; one lazy plan keyed by page and file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from planquant.functions.text import clean_ocr, project_facts
from planquant.operators import extract, gates, pages as page_ops, pricing, products, rollup, summary
from planquant.operators.catalog import with_keywords, with_patterns
from planquant.operators.layout import document_text
from planquant.workers import cut


@dataclass
class Takeoff:
    """Results of one run. Items are extracted once and kept in the checkpoint folder; every field is lazy from there on."""

    items: DataFrame
    warnings: DataFrame
    drainage: DataFrame
    pipes: DataFrame
    structures: DataFrame
    report: DataFrame
    projects: DataFrame

    def release(self) -> None:
        """For callers that end a run: nothing is held in memory, what was cut is in the checkpoint folder."""


KEYS = ["file_id", "page_num"]
FILE = ["file_id"]


def raw_items(pages: DataFrame, catalog: DataFrame | None, use_product_first: bool = True) -> DataFrame:
    """Items of summary sheets by their tables, of other pages by products first (if asked) and patterns.

    `pages` says which are sheets, and of what type (is_sheet, sheet_type). Sheets are read page by page and the most certain of equal items of a file kept; the
    other strategies match page by page too, but the first of equal items counts within the file, as do products."""
    sheets, others = pages.filter("is_sheet"), pages.filter("not is_sheet")
    # What each way of reading finds is kept: later steps neither plan nor compute it again.
    of_sheets = cut(summary.to_pay_items(summary.best_of_pages(summary.summary_items(sheets, KEYS, type_col="sheet_type"), FILE)))
    of_pages = extract.extract_items(others, FILE)
    if catalog is None or not use_product_first:
        return of_sheets.unionByName(of_pages, allowMissingColumns=True)
    catalog = with_patterns(with_keywords(catalog))
    matched = lambda some: cut(products.to_pay_items(products.product_matches(some, catalog, FILE), FILE))
    found = matched(others)
    supplement = products.uncovered_by_summary(matched(sheets), of_sheets, FILE)
    both = products.supplemented(found, of_pages, FILE)
    return of_sheets.unionByName(supplement, allowMissingColumns=True).unionByName(both, allowMissingColumns=True)


def numbered(items: DataFrame) -> DataFrame:
    """Items with item_no within their file, by page and order of extraction; items of sheets and products, which have no
    strategy, come first on a page. A file's items are bounded by the file."""
    order = ["page_num", *[c for c in ("strategy", "pattern", "hit", "line_no") if c in items.columns], "pay_item_no", "description", "quantity"]
    return items.withColumn("item_no", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)))


def analyze(pages: DataFrame, catalog: DataFrame | None = None, clean: bool = False, validate: bool = True, use_product_first: bool = True, blocks: DataFrame | None = None) -> Takeoff:
    """pages(file_id, page_num, text) to priced items and reports. With `clean`, misreadings of recognition are mended
    first; for recognised text only, since the rules also take the end of a code before PIPE for a size. With
    `blocks`(file_id, page, block_no, text, bbox, confidence), items have the source_location that they most likely come from."""
    read = pages.withColumn("text", clean_ocr(F.col("text"))) if clean else pages
    # Every strategy reads the pages: they are cleaned and classified once, and their rules stay out of the later plans.
    read = read.select(*KEYS, "text", page_ops.is_summary_page(F.col("text")).alias("is_sheet"))
    read = read.withColumn("sheet_type", F.when(F.col("is_sheet"), page_ops.summary_type(F.col("text")))).persist()
    items = raw_items(read, catalog, use_product_first)
    for c, kind in (("unit_price", "double"), ("line_cost", "double"), ("matched", "boolean"), ("confidence_score", "double"), ("needs_verification", "boolean")):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast(kind))
    items = cut(numbered(items))
    read.unpersist()
    warnings = gates.warnings_of(items, "file_id", "item_no")
    if validate:
        items = gates.accepted(items)
    if blocks is not None:
        items = extract.located(items, blocks, FILE, "item_no")
    items = items.withColumn("item_key", F.concat_ws(":", "file_id", F.col("item_no").cast("string")))
    if catalog is not None:
        items = cut(pricing.priced(items, catalog, "item_key"))
    text = document_text(pages.withColumn("text", clean_ocr(F.col("text"))) if clean else pages)
    facts = text.select("file_id", project_facts(F.col("text"), F.col("file_id")).alias("p")).select("file_id", "p.*")
    return Takeoff(items, warnings, rollup.categorized(items, "file_id", "item_no"), rollup.material_pipes(items, "file_id"), rollup.material_structures(items, "file_id"), rollup.takeoff_report(items, "file_id"), facts)
