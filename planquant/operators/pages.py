"""Pages: classes, skip decisions, quality of product text, vision budget, override."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions import rules
from planquant.functions.arrays import let
from planquant.functions.text import contains_any, matches, rlike, strip, words_found

PRODUCT_WORDS = (
    "RCP", "PVC", "HDPE", "CMP", "DIP", "SRCP", "ERCP", "PIPE", "CULVERT", "INLET", "MANHOLE", "CATCH BASIN", "JUNCTION BOX",
    "ENDWALL", "MES", "FLARED END", "CRADLE", "MH", "CB", "JB", "FES", "STORM", "DRAIN", "SEWER",
)
SCHEDULE_WORDS = ("PIPE SCHEDULE", "STORM SCHEDULE", "DRAINAGE SCHEDULE", "QTY", "QUAN", "SIZE", "LENGTH", "STATION")
ANNOTATION_WORDS = ("SEE", "NOTE", "TYP", "TYPICAL", "DETAIL", "SCHEDULE", "TABLE")


def page_class(text: Column, page: Column) -> Column:
    """struct(page_type, confidence, keywords) by words found, in order of priority, else by position."""
    lists = (
        ("summary", rules.SUMMARY_WORDS, 0.7, 0.1, 0.98, None),
        ("title", rules.TITLE_WORDS, 0.5, 0.1, 0.9, 2),
        ("toc", rules.TOC_WORDS, 0.5, 0.15, 0.9, 5),
        ("notes", rules.NOTES_WORDS, 0.4, 0.1, 0.85, 6),
        ("payload", rules.PAYLOAD_WORDS, 0.6, 0.05, 0.95, None),
    )
    other = lambda name, c: F.struct(F.lit(name).alias("page_type"), F.lit(c).alias("confidence"), F.array().cast("array<string>").alias("keywords"))

    def chosen(found: Column) -> Column:
        out = F.when(page == 1, other("title", 0.4)).when(page == 2, other("toc", 0.3)).otherwise(other("payload", 0.5))
        for name, _, base, step, most, last in reversed(lists):
            hits = found[name]
            when = (F.size(hits) > 0) if last is None else (F.size(hits) > 0) & (page <= last)
            out = F.when(when, F.struct(F.lit(name).alias("page_type"), F.least(F.lit(most), F.lit(base) + F.lit(step) * F.size(hits)).alias("confidence"), hits.alias("keywords"))).otherwise(out)
        return out

    # The case is folded once, and each list looked for once.
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.struct(*[words_found(low, words).alias(name) for name, words, *_ in lists]), chosen))


def classified(pages: DataFrame, file_col: str = "file_id", page_col: str = "page_num", text_col: str = "text") -> DataFrame:
    """Pages with page_type, class_confidence, keywords and should_ocr. Files of up to three pages are payload throughout, pages
    beyond the fiftieth are payload unseen; title, contents and notes are skipped where that is sure (over 0.7)."""
    total = F.count(F.lit(1)).over(Window.partitionBy(file_col))
    found = pages.withColumn("_n", total).withColumn("_c", page_class(F.col(text_col), F.col(page_col)))
    fixed = lambda c: F.struct(F.lit("payload").alias("page_type"), F.lit(c).alias("confidence"), F.array().cast("array<string>").alias("keywords"))
    c = F.when(F.col("_n") <= 3, fixed(1.0)).when(F.col(page_col) > 50, fixed(0.7)).otherwise(F.col("_c"))
    skip = F.col("page_type").isin("title", "toc", "notes") & (F.col("class_confidence") > 0.7)
    classes = [F.col("_c.page_type"), F.col("_c.confidence").alias("class_confidence"), F.col("_c.keywords")]
    return found.withColumn("_c", c).select(*pages.columns, *classes).withColumn("should_ocr", ~skip)


def is_blank(white_ratio: Column, threshold: float = 0.98) -> Column:
    return white_ratio > threshold


def class_rollup(classes: DataFrame, *keys: str) -> DataFrame:
    """Per file: pages, pages to read, pages skipped, summary pages and their numbers. A file's pages are bounded by the file."""
    return classes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("should_ocr").alias("n_read"),
        F.count_if(~F.col("should_ocr")).alias("n_skipped"),
        F.count_if(F.col("page_type") == "summary").alias("n_summary"),
        *([F.array_sort(F.collect_list(F.when(F.col("page_type") == "summary", F.col("page_num")))).alias("summary_pages")] if "page_num" in classes.columns else []),
    )


def is_summary_page(text: Column) -> Column:
    """100 characters or more, and a primary phrase or two secondary ones with a unit."""
    secondary = lambda up: (F.size(words_found(up, rules.SUMMARY_SECONDARY)) >= 2) & contains_any(up, ("LF", "EA", "LS", "SY", "CY", "SF", "TON"))
    return let(F.upper(F.coalesce(text, F.lit(""))), lambda up: (F.length(up) >= 100) & (contains_any(up, rules.SUMMARY_PRIMARY) | secondary(up)))


def summary_type(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    has = lambda s: F.contains(up, F.lit(s))
    return (
        F.when(has("SUMMARY OF QUANTITIES"), "summary_of_quantities")
        .when(has("TABULATION OF QUANTITIES"), "tabulation_of_quantities")
        .when(has("ESTIMATE OF QUANTITIES"), "estimate_of_quantities")
        .when(has("PAY ITEM SUMMARY"), "pay_item_summary")
        .when(has("BID SCHEDULE"), "bid_schedule")
        .when(has("ENGINEER'S ESTIMATE") | has("ENGINEERS ESTIMATE"), "engineers_estimate")
        .otherwise("unknown")
    )


# Complete items, callouts, incomplete mentions.
_COMPLETE = (
    r"(?i)\d{3}-\d{1,3}-\d{1,3}\s+.+?\s+(?:LS|EA|LF|SY|CY|SF|TON)\s+\d+",
    "(?i)\\d+\\s*(?:LF|EA|SF|SY)\\s+\\d+\\s*[\"”]?\\s*(?:RCP|PVC|HDPE|CMP)",
    "(?i)\\d+\\s*[\"”]\\s*(?:RCP|PVC|HDPE|CMP).*?\\d+\\s*(?:LF|EA)",
)
_CALLOUT = r"\b(?:RCP|PVC|HDPE|CMP|DIP|SRCP)\s*-?\s*(\d{1,2})\b"
_INCOMPLETE = (
    "(?i)\\b\\d{1,2}\\s*[\"”]\\s*(?:RCP|PVC|HDPE|CMP|DIP|SRCP)\\b(?!.*\\d+\\s*(?:LF|EA))",
    r"(?i)\b(?:INLET|MANHOLE|CATCH\s*BASIN)\b(?!\s*[#-]?\s*\d)",
)


def page_quality(text: Column) -> Column:
    """How well a page's products can be read: counts, flags, the reasons for a second reading, and whether one is needed."""
    count = lambda s, patterns: reduce(lambda a, b: a + b, [F.regexp_count(s, F.lit(p)) for p in patterns])

    def measured(up: Column) -> Column:
        sizes = F.regexp_extract_all(up, F.lit(_CALLOUT), F.lit(1))
        bare = F.size(F.filter(sizes, lambda n: ~F.regexp_like(up, F.concat(F.lit(r"(?:RCP|PVC|HDPE|CMP|DIP|SRCP)\s*-?\s*"), n, F.lit(r".*?(\d+)\s*(?:LF|EA)")))))
        # Every complete item and callout has a digit and, but for codes, a material; most pages have neither.
        material = contains_any(up, ("RCP", "PVC", "HDPE", "CMP", "DIP"))
        return F.struct(
            F.size(words_found(up, PRODUCT_WORDS)).alias("keywords"), F.when(material | rlike(up, r"\d{3}-\d{1,3}-\d"), count(up, _COMPLETE)).otherwise(0).alias("complete"), F.when(material, bare).otherwise(0).alias("bare"),
            count(F.left(up, F.lit(500)), _INCOMPLETE).alias("incomplete"), (F.size(words_found(up, SCHEDULE_WORDS)) >= 2).alias("schedule"), contains_any(up, ANNOTATION_WORDS).alias("notes"),
        )

    def judged(m: Column) -> Column:
        keywords, complete, bare, incomplete = (m[c] for c in ("keywords", "complete", "bare", "incomplete"))
        said = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
        reasons = F.array_compact(
            F.array(
                F.when((keywords > 0) & (complete == 0), said("product_keywords_found (", keywords, ") but no complete items")),
                F.when(bare > 0, said("callouts_without_quantity (", bare, ")")),
                F.when((incomplete > complete) & (keywords > 2), said("incomplete_items (", incomplete, ") > complete_items (", complete, ")")),
                F.when(m["schedule"], F.lit("pipe_schedule_detected")),
            )
        )
        return let(
            reasons,
            lambda r: F.struct(
                keywords.alias("product_keywords_found"), complete.alias("complete_items_found"), incomplete.alias("incomplete_items_found"), bare.alias("callouts_without_quantity"),
                (m["schedule"] | m["notes"]).alias("has_complex_tables"), m["schedule"].alias("has_pipe_schedule"), r.alias("reasons"), (F.size(r) > 0).alias("needs_vision"),
            ),
        )

    return let(F.upper(F.coalesce(text, F.lit(""))), lambda up: let(measured(up), judged))


def flagged(pages: DataFrame, text_col: str = "text", confidence_col: str = "confidence", blocks_col: str = "block_count") -> DataFrame:
    """Pages with their quality and whether they should be read again."""
    n = F.length(strip(F.coalesce(F.col(text_col), F.lit(""))))
    few = (F.col(blocks_col) < 5) & (n > 0)
    q = pages.withColumn("quality", page_quality(F.col(text_col)))
    return q.withColumn("flagged", (F.col(confidence_col) < 0.65) | few | (n < 50) | F.col("quality.needs_vision"))


def within_budget(pages: DataFrame, budget: int, file_col: str = "file_id", page_col: str = "page_num", confidence_col: str = "confidence") -> DataFrame:
    """The flagged pages with the lowest confidence, at most `budget` a file."""
    rank = F.row_number().over(Window.partitionBy(file_col).orderBy(confidence_col, page_col))
    return pages.withColumn("_rank", rank).filter(F.col("_rank") <= budget).drop("_rank")


def overridden(pages: DataFrame, vision: DataFrame, file_col: str = "file_id", page_col: str = "page_num") -> DataFrame:
    """Pages with the second reading's text where there is one, else their own, stripped."""
    new = vision.select(file_col, page_col, F.col("text").alias("_vision"))
    return pages.join(new, [file_col, page_col], "left").withColumn("text", F.coalesce("_vision", strip(F.col("text")))).drop("_vision")


def route_ocr(mode: Column, has_key: Column, n_flagged: Column) -> Column:
    """Where a file goes after reading: vision (always, or in hybrid mode with a key and flagged pages) or parse."""
    return F.when(~has_key, "parse").when(mode == "vision_only", "vision").when((mode == "hybrid") & (n_flagged > 0), "vision").otherwise("parse")


def route_extraction(text: Column, retries: Column, most: int = 2) -> Column:
    """parse, retry or skip."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) > 50, "parse").when(retries < most, "retry").otherwise("skip")


def next_dpi(dpi: Column) -> Column:
    return F.least(dpi + 50, F.lit(400))
