"""Validation gates over pay items: quantity, size, description, membrane and price, as one projection.

A warning is struct(category, severity, field, message, original_value); an item with any REJECT is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions import rules
from planquant.functions.text import contains_any, extract, is_elliptical_size, is_membrane, is_round_size, rlike, strip

WARNING_TYPE = "struct<category:string,severity:string,field:string,message:string,original_value:string>"
_PIPE_WORDS = ("RCP", "PVC", "HDPE", "CMP", "DIP", "SRCP", "ERCP", "PIPE")


def _warn(when: Column, category: str, severity: str, field: str, message: Column, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message"), value.cast("string").alias("original_value")).cast(WARNING_TYPE))


def limit(unit: Column, which: int, default: float) -> Column:
    """A unit's minimum (0), maximum (1) or typical maximum (2)."""
    table = F.create_map(*[F.lit(x) for u, v in rules.QUANTITY_LIMITS.items() for x in (u, float(v[which]))])
    return F.coalesce(F.element_at(table, F.upper(F.coalesce(unit, F.lit("")))), F.lit(default))


def quantity_warnings(quantity: Column, unit: Column) -> Column:
    """Below the minimum or above the maximum: reject; a round number, or else above what is typical: warning."""
    low, high, typical = limit(unit, 0, 0.0), limit(unit, 1, float("inf")), limit(unit, 2, float("inf"))
    name = F.upper(F.coalesce(unit, F.lit("")))
    out, over = quantity < low, quantity > high
    text = quantity.cast("string")
    return F.array_compact(
        F.array(
            _warn(out, "quantity", "reject", "quantity", F.concat(F.lit("Quantity "), text, F.lit(" is below minimum for unit "), name), quantity),
            _warn(~out & over, "quantity", "reject", "quantity", F.concat(F.lit("Quantity "), text, F.lit(" exceeds maximum for unit "), name), quantity),
            _warn(~out & ~over & quantity.isin(*map(float, rules.ROUND_QUANTITIES)), "quantity", "warning", "quantity", F.concat(F.lit("Suspicious round quantity "), text), quantity),
            _warn(~out & ~over & ~quantity.isin(*map(float, rules.ROUND_QUANTITIES)) & (quantity > typical), "quantity", "warning", "quantity", F.concat(F.lit("Quantity "), text, F.lit(" exceeds typical maximum for "), name), quantity),
        )
    )


def description_fault(description: Column) -> Column:
    """Why a description is refused: empty, short, numeric or unit; null if it is fine."""
    s = strip(F.coalesce(description, F.lit("")))
    return (
        F.when(F.coalesce(description, F.lit("")) == "", "empty")
        .when(F.length(s) < rules.MIN_DESCRIPTION, "short")
        .when(rlike(s, r"^[\d.\-\s]+$"), "numeric")
        .when(rlike(s, r"(?i)^(LF|EA|SY|SF|CY|TON|GAL|AC|LS)$"), "unit")
    )


def description_warnings(description: Column) -> Column:
    fault = description_fault(description)
    return F.array_compact(F.array(_warn(fault.isNotNull(), "description", "reject", "description", F.concat(F.lit("Invalid description: "), fault), description)))


def _sizes(description: Column) -> tuple[Column, Column, Column, Column]:
    """(names a pipe, rise, span, round size) of a description."""
    up = F.upper(F.coalesce(description, F.lit("")))
    rise, span = (extract(up, r"(\d+)\s*[xX×]\s*(\d+)", k).try_cast("int") for k in (1, 2))
    return contains_any(up, _PIPE_WORDS), rise, span, extract(up, "(\\d+)[\"”]").try_cast("int")


def size_faults(description: Column) -> tuple[Column, Column]:
    """(a round pipe beyond the largest, a pipe of another odd size)."""
    pipe, rise, span, size = _sizes(description)
    oval = rise.isNotNull() & span.isNotNull()
    odd = F.coalesce(pipe & ~oval & ~is_round_size(size), F.lit(False))
    return F.coalesce(odd & (size > rules.MAX_PIPE_SIZE), F.lit(False)), F.coalesce((odd & (size <= rules.MAX_PIPE_SIZE)) | (pipe & oval & ~is_elliptical_size(rise, span)), F.lit(False))


def size_warnings(description: Column) -> Column:
    """Sizes of pipes: an elliptical size or an odd round one gives a warning, a round one beyond the largest a reject."""
    pipe, rise, span, size = _sizes(description)
    elliptical = rise.isNotNull() & span.isNotNull()
    odd = pipe & ~elliptical & size.isNotNull() & ~is_round_size(size)
    return F.array_compact(
        F.array(
            _warn(pipe & elliptical & ~is_elliptical_size(rise, span), "size", "warning", "size", F.lit("Non-standard elliptical size"), F.concat_ws("x", rise.cast("string"), span.cast("string"))),
            _warn(odd & (size > rules.MAX_PIPE_SIZE), "size", "reject", "size", F.lit("Pipe size exceeds the largest in the catalog"), size),
            _warn(odd & (size <= rules.MAX_PIPE_SIZE), "size", "warning", "size", F.lit("Non-standard pipe size"), size),
        )
    )


def _most_prices() -> Column:
    return F.create_map(*[F.lit(x) for u, v in rules.MAX_UNIT_PRICE.items() for x in (u, float(v))])


def price_warnings(unit_price: Column, line_cost: Column, unit: Column) -> Column:
    """Line cost above a million; unit price below a cent or above what the unit allows. Null and 0 aren't judged."""
    name, price, cost = F.upper(F.coalesce(unit, F.lit(""))), F.coalesce(unit_price, F.lit(0.0)), F.coalesce(line_cost, F.lit(0.0))
    most = F.element_at(_most_prices(), name)
    return F.array_compact(
        F.array(
            _warn(cost > rules.MAX_LINE_COST, "price", "warning", "line_cost", F.lit("Line cost exceeds the threshold"), line_cost),
            _warn((price != 0) & (price < rules.MIN_UNIT_PRICE), "price", "warning", "unit_price", F.lit("Unit price seems too low"), unit_price),
            _warn(F.coalesce(price > most, F.lit(False)), "price", "warning", "unit_price", F.lit("Unit price exceeds what is typical"), unit_price),
        )
    )


def membrane_warnings(description: Column, source_text: Column) -> Column:
    both = F.concat_ws(" ", description, source_text)
    return F.array_compact(F.array(_warn(is_membrane(both), "material", "reject", "description", F.lit("Membrane or liner, not a pipe"), description)))


def validated(items: DataFrame) -> DataFrame:
    """Items with validation_warnings and rejected; the gates stop at the first reject, in the order
    description, quantity, size, price."""
    none = F.array().cast(f"array<{WARNING_TYPE}>")
    rejects = lambda w: F.exists(w, lambda x: x["severity"] == "reject")
    d, q = description_warnings(F.col("description")), quantity_warnings(F.coalesce("quantity", F.lit(0.0)).cast("double"), F.col("unit"))
    s, p = size_warnings(F.col("description")), price_warnings(F.col("unit_price"), F.col("line_cost"), F.col("unit"))
    w = F.when(rejects(d), d).when(rejects(q), F.concat(d, q)).when(rejects(s), F.concat(d, q, s)).otherwise(F.concat(d, q, s, p))
    return items.withColumn("validation_warnings", F.coalesce(w, none)).withColumn("rejected", rejects(F.col("validation_warnings")))


def accepted(items: DataFrame) -> DataFrame:
    """Items that no gate rejects, with their warnings."""
    rejected, _ = gate_outcome(*[F.col(c) for c in ("description", "quantity", "unit", "unit_price", "line_cost")])
    q, s = quantity_warnings(F.coalesce("quantity", F.lit(0.0)).cast("double"), F.col("unit")), size_warnings(F.col("description"))
    return items.filter(~rejected).withColumn("validation_warnings", F.concat(q, s, price_warnings(F.col("unit_price"), F.col("line_cost"), F.col("unit"))))


def warnings_of(items: DataFrame, *keys: str) -> DataFrame:
    """A row per warning."""
    return validated(items).select(*keys, F.explode("validation_warnings").alias("w")).select(*keys, "w.*")


def gate_outcome(description: Column, quantity: Column, unit: Column, unit_price: Column, line_cost: Column) -> tuple[Column, Column]:
    """(rejected, number of warnings) of `validated`, from its conditions alone: no warning is written out."""
    q, name = F.coalesce(quantity, F.lit(0.0)).cast("double"), F.upper(F.coalesce(unit, F.lit("")))
    bad = description_fault(description).isNotNull()
    out = (q < limit(unit, 0, 0.0)) | (q > limit(unit, 1, float("inf")))
    unusual = q.isin(*map(float, rules.ROUND_QUANTITIES)) | (q > limit(unit, 2, float("inf")))
    oversized, odd = size_faults(description)
    price, cost = F.coalesce(unit_price, F.lit(0.0)), F.coalesce(line_cost, F.lit(0.0))
    dear = F.coalesce(price > F.element_at(_most_prices(), name), F.lit(False))
    n = lambda c: c.cast("int")
    prices = n(cost > rules.MAX_LINE_COST) + n((price != 0) & (price < rules.MIN_UNIT_PRICE)) + n(dear)
    rejected = bad | out | oversized
    return rejected, F.when(bad | out, 0).when(oversized, n(unusual)).otherwise(n(unusual) + n(odd) + prices)


def gate_report(items: DataFrame, *keys: str) -> DataFrame:
    """Counts by outcome: items, passed, rejected, warnings."""
    rejected, warnings = gate_outcome(*[F.col(c) for c in ("description", "quantity", "unit", "unit_price", "line_cost")])
    v = items.select(*keys, rejected.alias("rejected"), warnings.alias("warnings"))
    return v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(~F.col("rejected")).alias("n_passed"),
        F.count_if("rejected").alias("n_rejected"),
        F.sum("warnings").cast("long").alias("n_warnings"),
    )


# Unit ranges and round sizes of the rule validator; tighter than the gates.
RULE_RANGES = {"LF": (1, 50_000), "EA": (1, 500), "SY": (1, 100_000), "CY": (1, 50_000), "SF": (1, 500_000), "TON": (1, 10_000), "LS": (1, 1)}
RULE_SIZES = (12, 15, 18, 24, 30, 36, 42, 48, 54, 60, 64, 66, 72, 84, 96)


def rule_issues(items: DataFrame, file_col: str = "file_id", order_col: str = "item_no") -> DataFrame:
    """Items with their rule issues: exchanged size, odd size, quantity out of range, no unit, no quantity, and
    repeats of an earlier item (same description, quantity and unit). Files of fewer than three items have none."""
    size = extract(F.upper("description"), "(\\d+)\\s*[\"”]").try_cast("int")
    unit, quantity = F.upper(F.coalesce("unit", F.lit(""))), F.coalesce("quantity", F.lit(0.0))
    low = F.element_at(F.create_map(*[F.lit(x) for u, v in RULE_RANGES.items() for x in (u, float(v[0]))]), unit)
    high = F.element_at(F.create_map(*[F.lit(x) for u, v in RULE_RANGES.items() for x in (u, float(v[1]))]), unit)
    swapped = (size > 96) & quantity.isin(*map(float, RULE_SIZES))
    first = F.first(order_col).over(Window.partitionBy(file_col, F.lower("description"), "quantity", "unit").orderBy(order_col))
    many = F.count(F.lit(1)).over(Window.partitionBy(file_col)) >= 3
    issues = F.array_compact(
        F.array(
            F.when(swapped, "swapped_size"),
            F.when(size.isNotNull() & ~swapped & ~size.isin(*RULE_SIZES), "odd_size"),
            F.when((quantity > 0) & ((quantity < low) | (quantity > high)), "quantity_range"),
            F.when(unit == "", "missing_unit"),
            F.when(quantity == 0, "zero_quantity"),
            F.when(first < F.col(order_col), "duplicate"),
        )
    )
    return items.withColumn("first_seen", first).withColumn("issues", F.when(many, issues).otherwise(F.array().cast("array<string>")))
