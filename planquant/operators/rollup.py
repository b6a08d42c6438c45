"""Roll-ups and report projections: materials, take-off report, drainage categories, file and batch totals, CSV rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planquant.functions.arrays import computed
from planquant.functions.text import contains_any, extract, first_wins, rlike

PIPE_WORDS = ("RCP", "PVC", "HDPE", "CMP", "DIP", "SRCP", "ERCP", "PIPE", "CULVERT")
STRUCTURE_WORDS = ("INLET", "MANHOLE", "CATCH BASIN", "JUNCTION BOX", "ENDWALL", "MES", "FLARED END", "CRADLE")
DRAINAGE_WORDS = ("PIPE", "RCP", "PVC", "HDPE", "CMP", "DIP", "SRCP", "ERCP", *STRUCTURE_WORDS[:6], "MITERED", *STRUCTURE_WORDS[6:], "STORM", "DRAIN", "CULVERT")


def _up(c: str) -> Column:
    return F.upper(F.coalesce(F.col(c), F.lit("")))


def _material() -> Column:
    """struct(pipe, size, material, type, amount) of a row that counts as material, else null: pipes measured in LF that have a size in inches, with
    their length; structures and other pieces with their whole quantity, 1 where there is none."""
    d, unit, q = _up("description"), _up("unit"), F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    size, material = extract(d, "(\\d{1,2})\\s*[\"”]"), F.coalesce(extract(d, r"\b(RCP|PVC|HDPE|CMP|DIP|SRCP|ERCP)\b"), F.lit("PIPE"))
    kind = reduce(lambda rest, w: F.when(F.contains(d, F.lit(w)), w).otherwise(rest), reversed(STRUCTURE_WORDS), F.lit("OTHER"))
    pipe = contains_any(d, PIPE_WORDS) & (unit == "LF")
    none = F.lit(None).cast("string")
    row = lambda is_pipe, a, b, c, x: F.struct(F.lit(is_pipe).alias("pipe"), a.alias("size"), b.alias("material"), c.alias("type"), x.alias("amount"))
    of_pipe = F.when(size.isNotNull(), row(True, size, material, none, q))
    return F.when(pipe, of_pipe).when(contains_any(d, STRUCTURE_WORDS) | (unit == "EA"), row(False, none, none, kind, F.when(q == 0, F.lit(1.0)).otherwise(q.cast("long").cast("double"))))


def material_pipes(items: DataFrame, *keys: str) -> DataFrame:
    """LF and count per size and material of pipes measured in LF; pipes without a size in inches don't count."""
    p = computed(items, _material(), "m").select(*keys, "m").filter("m.pipe")
    return p.groupBy(*keys, "m.size", "m.material").agg(F.sum("m.amount").alias("total_lf"), F.count(F.lit(1)).alias("n_items"))


def material_structures(items: DataFrame, *keys: str) -> DataFrame:
    """Count per structure type: whole quantities, 1 where there is none."""
    s = computed(items, _material(), "m").select(*keys, "m").filter("not m.pipe")
    return s.groupBy(*keys, F.col("m.type").alias("structure_type")).agg(F.sum("m.amount").cast("long").alias("n_structures"))


def material_totals(items: DataFrame) -> DataFrame:
    """One row: pipe LF, pipe sizes, structures, structure types; in one pass, by kind first and then over the few kinds."""
    kinds = computed(items, _material(), "m").filter("m is not null").groupBy("m.pipe", "m.size", "m.material", "m.type").agg(F.sum("m.amount").alias("n"))
    pipe = F.col("pipe")
    return kinds.agg(
        F.coalesce(F.sum(F.when(pipe, F.col("n"))), F.lit(0.0)).alias("total_pipe_lf"), F.count_if(pipe).alias("total_pipe_sizes"),
        F.coalesce(F.sum(F.when(~pipe, F.col("n"))), F.lit(0)).cast("long").alias("total_structures"), F.count_if(~pipe).alias("total_structure_types"),
    )


def is_drainage_item() -> Column:
    return (F.coalesce(F.col("source"), F.lit("")) == "product_first") | rlike(_up("pay_item_no"), "^(430|425)-") | contains_any(_up("description"), DRAINAGE_WORDS)


def takeoff_report(items: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates and cost of a file's (or batch's) items, in one aggregation."""
    m, d, c = F.coalesce(F.col("matched"), F.lit(False)), is_drainage_item(), F.coalesce(F.col("confidence_score"), F.lit(0.0))
    first = F.coalesce(F.col("source"), F.lit("")) == "product_first"
    n = F.count(F.lit(1))
    share = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    return items.groupBy(*keys).agg(
        n.alias("total_items"), F.count_if(m).alias("matched_items"), share(F.count_if(m), n).alias("match_rate"),
        F.round(F.coalesce(F.sum("line_cost"), F.lit(0.0)), 2).alias("estimated_total"),
        F.count_if(d).alias("drainage_items"), F.count_if(d & m).alias("drainage_matched"), F.round(share(F.count_if(d & m), F.count_if(d)), 1).alias("drainage_match_rate"),
        F.count_if(~d).alias("non_drainage_items"), F.count_if(c >= 0.85).alias("high_confidence_count"), F.count_if((c >= 0.6) & (c < 0.85)).alias("medium_confidence_count"),
        F.count_if((c < 0.6) | F.coalesce(F.col("needs_verification"), F.lit(False))).alias("needs_review_count"),
        F.count_if(first).alias("product_first_count"), F.count_if(~first).alias("regex_fallback_count"),
    )


def drainage_category(code: Column, description: Column) -> Column:
    """struct(type, size, description) by code prefix or word: pipe, endwall, inlet, manhole; null for others."""
    c, d = F.coalesce(code, F.lit("")), F.upper(F.coalesce(description, F.lit("")))
    has, starts = lambda w: F.contains(d, F.lit(w)), lambda p: rlike(c, f"^(?:{p})")
    inches = F.coalesce(F.concat(extract(d, r"(\d{1,2})[\"\s]*(?:INCH)?"), F.lit('"')), F.lit("-"))
    cut = F.when(F.length(d) > 80, F.concat(F.left(d, F.lit(80)), F.lit("..."))).otherwise(d)
    wall = F.when(has("WING"), "Winged").when(has("U-TYPE") | has("U TYPE"), "U-Type").when(has("MES") | has("MITERED"), "MES").otherwise("Straight")
    inlet = F.when(has("TYPE D"), "Type D").when(has("TYPE E"), "Type E").when(has("TYPE P"), "Type P").when(has("DITCH BOTTOM"), "Ditch Bottom").otherwise("Standard")
    hole = F.when(has("TYPE 7"), "Type 7").when(has("TYPE P") | has("P-7"), "Type P-7").otherwise("Standard")
    row = lambda t, s, x: F.struct(F.lit(t).alias("type"), s.alias("size"), x.alias("description"))
    return (
        F.when(starts("430-175|430-084") | has("PIPE"), row("Pipe", inches, cut))
        .when(starts("430-03|430-04|430-01|430-5|430-98"), row("Endwall", inches, F.concat(wall, F.lit(" - "), F.left(d, F.lit(60)))))
        .when(starts("425-1") | has("INLET"), row("Inlet", inlet, cut))
        .when(starts("425-2") | has("MANHOLE"), row("Manhole", hole, cut))
    )


def categorized(items: DataFrame, *keys: str) -> DataFrame:
    x = items.withColumn("_x", drainage_category(F.col("pay_item_no"), F.col("description"))).filter("_x is not null")
    return x.select(*keys, "_x.type", "_x.size", "_x.description", F.lit("-").alias("station"), "quantity", "unit", "unit_price", F.col("line_cost").alias("line_total"))


def file_results(items: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """A row per file, also for files without items: items, matched by rules or a second opinion, cost, success."""
    ai = F.coalesce(F.col("match_source") == "ai", F.lit(False))
    m = F.coalesce(F.col("matched"), F.lit(False))
    g = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(m).alias("n_matched"), F.count_if(m & ai).alias("n_ai"), F.count_if(m & ~ai).alias("n_rules"), F.coalesce(F.sum("line_cost"), F.lit(0.0)).alias("total_cost"))
    return files.join(g, key, "left").fillna(0, ["n_items", "n_matched", "n_ai", "n_rules"]).fillna(0.0, ["total_cost"])


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"),
        F.sum("n_items").alias("n_items"), F.sum("n_matched").alias("n_matched"), F.sum("total_cost").alias("total_estimate"),
    )


def csv_rows(items: DataFrame, *keys: str) -> DataFrame:
    """The fourteen columns of the CSV report, after the keys."""
    label = F.when(F.col("confidence") == "high", 0.90).when(F.coalesce(F.col("confidence"), F.lit("medium")) == "medium", 0.75).otherwise(0.40)
    score = F.coalesce(F.col("confidence_score"), label)
    review = (score < 0.6) | (F.coalesce(F.col("quantity"), F.lit(0.0)) == 0) | F.coalesce(F.col("needs_verification"), F.lit(False))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    money = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c).cast("string")).otherwise("")
    m = F.coalesce(F.col("matched"), F.lit(False))
    return items.select(
        *keys, blank("pay_item_no").alias("Pay Item No"), blank("description").alias("Description"), blank("unit").alias("Unit"), F.coalesce(F.col("quantity"), F.lit(0.0)).alias("Quantity"),
        money("unit_price").alias("Unit Price"), money("line_cost").alias("Line Cost"), blank("page").alias("Page"), blank("source").alias("Source"), blank("confidence").alias("Confidence"),
        F.format_number(score, 2).alias("Confidence Score"), F.when(review, "Yes").otherwise("").alias("Needs Review"), F.when(m, "Yes").otherwise("No").alias("Matched"),
        F.when(m, F.coalesce(F.col("match_source"), F.lit("rules"))).otherwise("").alias("Match Source"), blank("ai_match_reason").alias("AI Match Reason"),
    )


def vision_dedup(items: DataFrame, *keys: str) -> DataFrame:
    """One item per code and first fifty characters of the description: the most certain, the first on ties."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    x = items.withColumn("_d", F.left("description", F.lit(50))).withColumn("_r", rank)
    return first_wins(x, [*keys, "pay_item_no", "_d"], ["_r", "item_no"]).drop("_d", "_r")


def job_totals(results: DataFrame, key: str = "message_id") -> DataFrame:
    """Per message: files, successes, items, estimate, status."""
    g = results.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("success").alias("n_ok"), F.sum("n_items").alias("n_items"), F.sum("total_cost").alias("total_estimate"))
    return g.withColumn("status", F.when(F.col("n_ok") == F.col("n_files"), "success").when(F.col("n_ok") > 0, "partial").otherwise("failed"))


def ocr_success_rate(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.groupBy(*keys).agg(F.avg(F.col("success").cast("double")).alias("success_rate"))


def counts_by_type(found: DataFrame, type_col: str = "type") -> DataFrame:
    return found.groupBy(type_col).count()


def progress(files_done: Column, files_total: Column, node_weight: Column) -> Column:
    """Percent: 95 for files, by the share of the current one's steps."""
    return F.least(F.lit(100.0), F.when(files_total > 0, 95.0 * (files_done + node_weight) / files_total).otherwise(0.0))
