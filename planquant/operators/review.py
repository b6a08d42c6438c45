"""Review: items that need a second look, the queue for people, and corrections that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LOW_CONFIDENCE = 0.6


def review_reason(confidence: Column, ocr_confidence: Column, flagged: Column, quantity: Column) -> Column:
    """Why an item needs a look, reasons joined by commas; null if it doesn't."""
    c = F.coalesce(ocr_confidence, F.lit(1.0))
    parts = F.concat_ws(
        ", ",
        F.when(confidence == "low", "low confidence extraction"),
        F.when(c < LOW_CONFIDENCE, F.concat(F.lit("low OCR confidence ("), F.format_number(c, 2), F.lit(")"))),
        F.when(flagged, "flagged for verification"),
        F.when(F.coalesce(quantity, F.lit(0.0)) == 0, "zero quantity"),
    )
    return F.nullif(parts, F.lit(""))


def region_hint(bbox: Column) -> Column:
    """Where on a sheet a box is, on a grid of three by three."""
    x, y = (bbox[0][0] + bbox[2][0]) / 2, (bbox[0][1] + bbox[2][1]) / 2
    v = F.when(y < 350, "Top").when(y < 750, "Middle").otherwise("Bottom")
    h = F.when(x < 400, "left").when(x < 600, "center").otherwise("right")
    return F.when(F.size(bbox) >= 3, F.concat(v, F.lit("-"), h, F.lit(" region"))).otherwise("Unknown location")


def review_queue(items: DataFrame, *keys: str) -> DataFrame:
    """Items that need a look, with reason and place. `items` has page, bbox, text_context and ocr_confidence or nulls."""
    reason = review_reason(F.col("confidence"), F.col("ocr_confidence"), F.coalesce("needs_verification", F.lit(False)), F.col("quantity"))
    q = items.withColumn("reason", reason).filter("reason is not null")
    return q.select(*keys, "description", "quantity", "unit", "confidence", "reason", F.coalesce("page", F.lit(0)).alias("page"), region_hint(F.col("bbox")).alias("region_hint"), F.coalesce("text_context", F.lit("")).alias("text_context"))


def first_of_file(queue: DataFrame, most: int = 10, file_col: str = "file_id", order_col: str = "item_no") -> DataFrame:
    """What is sent to verification at once: the first `most` of a file."""
    return queue.withColumn("_rank", F.row_number().over(Window.partitionBy(file_col).orderBy(order_col))).filter(F.col("_rank") <= most).drop("_rank")


def corrected(items: DataFrame, verdicts: DataFrame, key: str = "item_no", least: float = 0.7) -> DataFrame:
    """Items with corrected quantity, unit and description; unsure or negative verdicts ask for a person. Applied before prices."""
    v = verdicts.select(key, F.col("quantity").alias("_q"), F.col("unit").alias("_u"), F.col("description").alias("_d"), F.col("confidence").alias("_c"), F.col("is_correct").alias("_ok"))
    j = items.join(v, key, "left")
    sure = F.coalesce(F.col("_c") >= least, F.lit(False))
    asked = F.col("_c").isNotNull() & (~sure | ~F.coalesce(F.col("_ok"), F.lit(True)))
    put = lambda old, new: F.when(sure, F.coalesce(new, old)).otherwise(F.col(old))
    return j.withColumn("quantity", put("quantity", "_q")).withColumn("unit", put("unit", "_u")).withColumn("description", put("description", "_d")).withColumn("needs_human_review", asked).drop("_q", "_u", "_d", "_c", "_ok")


def validation_score(n_issues: Column, n_items: Column) -> Column:
    """1 less the share of weighty issues, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - n_issues / n_items)
