"""Summary sheets: standard, inline and tabulated tables of pay items, line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from planquant.functions import rules
from planquant.functions.arrays import computed, let
from planquant.functions.text import contains_any, extract, first_wins, matches, parse_number, rlike, strip, to_double
from planquant.operators.pages import is_summary_page, summary_type
from planquant.workers import cut

# Units and code pattern of summary sheets.
UNITS = ("LS", "EA", "LF", "SY", "CY", "SF", "TON", "GAL", "AC", "TN", "GM", "DA", "AS", "PI")
CODE = r"\b(\d{3}-\d{1,3}(?:-\d{1,3})?)\b"
DRAINAGE_WORDS = (
    "PIPE", "RCP", "PVC", "HDPE", "CMP", "CULVERT", "DRAIN", "STORM", "INLET", "MANHOLE", "CATCH BASIN", "JUNCTION", "ENDWALL",
    "MES", "MITERED END", "FLARED END", "STRUCTURE",
)
_UNIT = r"(?i)\b(" + "|".join(UNITS) + r")\b"
_QUANTITY = r"\b(\d{1,7}(?:,\d{3})*(?:\.\d+)?)\b"


def _number(s: Column) -> Column:
    """A quantity between 0 and a million; null for anything else."""
    return let(to_double(F.replace(s, F.lit(","), F.lit(""))), lambda n: F.when((n > 0) & (n < 1_000_000), n))


def _kept(text_col: str) -> Column:
    """The lines of a page that aren't blank, stripped."""
    return F.filter(F.transform(F.split(text_col, "\n"), strip), lambda x: x != "")


def _code(line: Column, start: Column) -> Column:
    """The code that a short line starts with."""
    return F.when(F.length(line) < 20, start)


def _lines(pages: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Lines that aren't blank, stripped, with their number, and the code that a short line starts with."""
    lines = pages.select(*keys, F.posexplode(_kept(text_col)).alias("line_no", "line"))
    return lines.withColumn("code", _code(F.col("line"), extract(F.col("line"), "^" + CODE)))


def _coded(pages: DataFrame, keys: list[str], text_col: str, behind: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """keys, line_no, code, before (the line before) and rest of each line with a code. A line is struct(line, code, starts, and n and unit if it
    is a number or a unit); rest is behind(lines, numbers of those with a code, place among these).

    What stands around a line comes from the page's own lines, so that a task holds a page and sorts nothing."""
    line = lambda x: let(extract(x, "^" + CODE), lambda start: F.struct(x.alias("line"), _code(x, start).alias("code"), start.isNotNull().alias("starts"), _number(x).alias("n"), F.when(F.upper(x).isin(*UNITS), F.upper(x)).alias("unit")))
    numbers = lambda a: F.filter(F.transform(a, lambda x, i: F.when(x["code"].isNotNull(), i)), lambda i: i.isNotNull())
    row = lambda a, at: lambda i, k: F.struct(i.alias("line_no"), F.get(a, i)["code"].alias("code"), F.when(i > 0, F.get(a, i - 1)["line"]).alias("before"), behind(a, at, k).alias("rest"))
    found = let(F.transform(_kept(text_col), line), lambda a: let(numbers(a), lambda at: F.transform(at, row(a, at))))
    return pages.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.*")


def _last(lines: Column, field: str) -> Column:
    return F.get(F.reverse(F.filter(F.transform(lines, lambda x: x[field]), lambda v: v.isNotNull())), F.lit(0))


def standard_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Code, description, then quantity and unit within three lines; a number of up to two digits before is the bid number."""
    is_bid = lambda s: rlike(F.coalesce(s, F.lit("")), r"^\d{1,2}$")
    five = _coded(pages, keys, text_col, lambda a, at, k: F.slice(a, F.get(at, k) + 2, F.lit(5)))
    d = F.get("rest", F.lit(0))["line"]
    ok = five.filter(d.isNotNull()).filter(~rlike(F.regexp_replace(d, "[,.]", ""), r"^\d+$") & ~F.upper(d).isin(*UNITS))
    # Lines count up to the next item: its code, or its bid number.
    ends = lambda r: F.transform(F.slice(r, F.lit(2), F.lit(3)), lambda x, k: x["starts"] | (is_bid(x["line"]) & F.coalesce(F.get(r, k + 2)["starts"], F.lit(False))))
    n = lambda e: F.when(F.array_contains(e, True), (F.array_position(e, True) - 1).cast("int")).otherwise(F.size(e))
    own = lambda r: let(ends(r), lambda e: F.slice(r, F.lit(2), n(e)))
    ok = computed(ok, let(own(F.col("rest")), lambda x: F.struct(_last(x, "n").alias("quantity"), _last(x, "unit").alias("unit"))), "_f")
    items = ok.select(*keys, "line_no", F.col("code").alias("pay_item_no"), d.alias("description"), "_f.quantity", F.coalesce("_f.unit", F.lit("EA")).alias("unit"), F.when(is_bid(F.col("before")), F.col("before").cast("int")).alias("bid_number"), F.lit(0.95).alias("confidence"))
    return items.filter(F.col("quantity").isNotNull())


def inline_item(line: Column, code: Column) -> Column:
    """struct(description, quantity, unit) of a line with all fields, or null. The last unit counts; the quantity is the
    first number behind it, else the last number before it that is no pipe size."""

    def item(rest: Column, u: Column) -> Column:
        after = strip(F.substring(rest, u["start"] + F.length(u["m"]) + 1, F.length(rest)))
        behind = F.get(F.regexp_extract_all(after, F.lit(_QUANTITY), F.lit(1)), F.lit(0))
        usable = lambda before: F.filter(matches(before, _QUANTITY, 1, with_start=True), lambda x: ~parse_number(x["g1"]).isin(*map(float, rules.PIPE_SIZES)))
        parts = let(strip(F.left(rest, u["start"])), lambda before: F.struct(before.alias("before"), behind.alias("behind"), F.get(F.reverse(usable(before)), F.lit(0)).alias("last")))
        return F.when(u.isNotNull(), let(parts, lambda v: let(fields(v["before"], v["behind"], v["last"], u), lambda x: F.when((x["quantity"] > 0) & (x["description"] != ""), x))))

    def fields(before: Column, behind: Column, last: Column, u: Column) -> Column:
        quantity = F.when(behind.isNotNull(), parse_number(behind)).otherwise(F.coalesce(parse_number(last["g1"]), F.lit(0.0)))
        d = F.when(behind.isNotNull() | last.isNull(), before).otherwise(F.left(before, last["start"]))
        d = F.regexp_replace(strip(F.regexp_replace(d, r"\s+", " ")), r"[,.\-]+$", "")
        return F.struct(d.alias("description"), quantity.alias("quantity"), F.upper(u["g1"]).alias("unit"))

    return let(strip(F.replace(line, code, F.lit(""))), lambda rest: let(F.get(F.reverse(matches(rest, _UNIT, 1, with_start=True)), F.lit(0)), lambda u: item(rest, u)))


def inline_items(pages: DataFrame, keys: list[str], text_col: str = "text", standard: DataFrame | None = None) -> DataFrame:
    """Items on one line, for codes that the standard format doesn't have (`standard`: its items, where they are known)."""
    standard = standard_items(pages, keys, text_col) if standard is None else standard
    lines = _lines(pages, keys, text_col).filter("code is null").withColumn("pay_item_no", extract(F.col("line"), CODE)).filter("pay_item_no is not null")
    found = lines.join(standard.select(*keys, "pay_item_no").distinct(), [*keys, "pay_item_no"], "left_anti")
    found = computed(found, inline_item(F.col("line"), F.col("pay_item_no")), "x").filter("x is not null")
    return first_wins(found, [*keys, "pay_item_no"], ["line_no"]).select(*keys, "line_no", "pay_item_no", "x.description", "x.quantity", "x.unit", F.lit(None).cast("int").alias("bid_number"), F.lit(0.9).alias("confidence"))


def tabulated_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Blocks from one code to the next: the first text is the description, the last unit and number count (the total)."""
    blocks = _coded(pages, keys, text_col, lambda a, at, k: F.slice(a, F.get(at, k) + 2, F.coalesce(F.get(at, k + 1), F.size(a)) - F.get(at, k) - 1))
    text = lambda r: F.get(F.filter(r, lambda x: x["unit"].isNull() & x["n"].isNull()), F.lit(0))["line"]
    rest = F.col("rest")
    f = computed(blocks, F.struct(text(rest).alias("description"), _last(rest, "n").alias("quantity"), F.coalesce(_last(rest, "unit"), F.lit("EA")).alias("unit")), "_f")
    return f.filter("_f.description is not null and _f.quantity is not null").select(*keys, "line_no", F.col("code").alias("pay_item_no"), "_f.description", "_f.quantity", "_f.unit", F.lit(None).cast("int").alias("bid_number"), F.lit(0.95).alias("confidence"))


def summary_items(pages: DataFrame, keys: list[str], text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """Items of all summary pages, by their format. With `type_col`, all pages are sheets, and their type is known."""
    sheets = pages.filter(is_summary_page(F.col(text_col))).withColumn("_type", summary_type(F.col(text_col))) if type_col is None else pages.withColumnRenamed(type_col, "_type")
    tab, other = sheets.filter("_type = 'tabulation_of_quantities'"), sheets.filter("_type <> 'tabulation_of_quantities'")
    standard = cut(standard_items(other, keys, text_col))
    return tabulated_items(tab, keys, text_col).unionByName(standard).unionByName(inline_items(other, keys, text_col, standard))


def is_drainage(code: Column, description: Column) -> Column:
    return rlike(F.coalesce(code, F.lit("")), "^(430|425)-") | contains_any(F.upper(F.coalesce(description, F.lit(""))), DRAINAGE_WORDS)


def best_of_pages(items: DataFrame, file_keys: list[str], page_col: str = "page_num") -> DataFrame:
    """One item per code and quantity of a file: the most certain, the first on ties."""
    return first_wins(items.withColumn("_c", -F.col("confidence")), [*file_keys, "pay_item_no", "quantity"], ["_c", page_col, "line_no"]).drop("_c")


def success_rate(n_items: Column, n_lines: Column) -> Column:
    return F.when(n_lines > 0, n_items / n_lines).otherwise(0.0)


def to_pay_items(items: DataFrame) -> DataFrame:
    label = F.when(F.col("confidence") >= 0.9, "high").otherwise("medium")
    return items.withColumn("confidence_score", F.col("confidence")).withColumn("confidence", label).withColumn("source", F.lit("summary"))
