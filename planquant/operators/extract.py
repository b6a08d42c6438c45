"""Pay-item extraction: tables of patterns drive generators over page text.

Every generator gives rows (keys of the document, page_num, strategy, pattern, hit, dedup key, item fields). Pages are matched one
by one; the first of a key wins, and mentions are counted, within the document that `keys` name, over all of its pages.
The order of a hit is explicit, so that "the first wins" is a rank, whatever the partitioning. Pages without page_num are page 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions import rules
from planquant.functions.arrays import computed, let
from planquant.functions.text import contains_any, extract, first_wins, is_elliptical_size, is_round_size, matches, may_match, none_if_empty, rlike, strip, swap_size_quantity, to_double
from planquant.operators.gates import description_fault, limit
from planquant.workers import cut

FIELDS = {
    "pay_item_no": "string", "description": "string", "unit": "string", "quantity": "double", "source": "string", "confidence": "string",
    "needs_verification": "boolean", "mentions": "int", "structure_type": "string", "configuration": "string", "option": "string",
    "rise": "int", "span": "int", "run_config": "string", "frame_option": "string", "source_text": "string",
}
ORDER = ["strategy", "pattern", "page_num", "hit"]


def _page(pages: DataFrame) -> Column:
    return (F.col("page_num").cast("int") if "page_num" in pages.columns else F.lit(1)).alias("page_num")


def _page_keys(keys: list[str]) -> list[str]:
    return [*keys, *(["page_num"] if "page_num" not in keys else [])]


def _hits(pages: DataFrame, keys: list[str], text_col: str, patterns: list[tuple[str, int]], with_start: bool = False) -> DataFrame:
    """keys, page_num, text, pattern (its number), hit (its number) and the groups of every match of the patterns.

    A pattern only runs over pages that have the strings which each of its matches has."""
    most = max(n for _, n in patterns)

    def padded(k: int, n: int):
        groups = lambda x: [x[f"g{j}"].alias(f"g{j}") if j <= n else F.lit(None).cast("string").alias(f"g{j}") for j in range(1, most + 1)]
        return lambda x, i: F.struct(F.lit(k).alias("pattern"), i.alias("hit"), x["m"].alias("m"), *groups(x), *([x["start"].alias("start")] if with_start else []))

    may = [may_match(F.col("_up"), p) for p, _ in patterns]
    arrays = [F.when(m, F.transform(matches(F.col("_text"), "(?i)" + p, n, with_start), padded(k, n))).otherwise(F.expr("array()")) for k, (m, (p, n)) in enumerate(zip(may, patterns, strict=True))]
    own = [k for k in keys if k != "page_num"]
    some = computed(pages.select(*own, _page(pages), F.col(text_col).alias("_text")), F.upper("_text"), "_up").filter(reduce(lambda a, b: a | b, may))
    return some.select(*own, "page_num", "_text", F.explode(F.concat(*arrays)).alias("_h")).select(*own, "page_num", "_text", "_h.*")


def _group(numbers: list[int | None]) -> Column:
    """The group that each pattern has the field in; null for patterns without."""
    return reduce(lambda rest, kn: F.when(F.col("pattern") == kn[0], F.col(f"g{kn[1]}")).otherwise(rest), [(k, n) for k, n in enumerate(numbers) if n], F.lit(None).cast("string"))


def _items(df: DataFrame, keys: list[str], strategy: int, dedup: Column, **fields: Column) -> DataFrame:
    given = {f: fields.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()}
    return df.select(*_page_keys(keys), F.lit(strategy).alias("strategy"), F.col("pattern").cast("int").alias("pattern"), F.col("hit").cast("int").alias("hit"), dedup.alias("dedup_key"), *given.values())


def _accepted(quantity: Column, unit: Column) -> Column:
    """Whether no gate rejects the quantity, from its limits alone: no warning is written out."""
    return ~F.coalesce((quantity < limit(unit, 0, 0.0)) | (quantity > limit(unit, 1, float("inf"))), F.lit(False))


def _first(items: DataFrame, keys: list[str]) -> DataFrame:
    return first_wins(items, [*keys, "dedup_key"], ORDER)


# A coded item in one run of text.
_FDOT = [(rf"({code})\s+(.+?)\s+(LS|EA|LF|SY|CY|SF|TON|GAL|AC)\s+(\d+(?:\.\d+)?)", 4) for code in (r"\d{3}-\d{1,3}-\d{1,3}", r"\d{3}-\d{1,2}")]


def fdot_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Code, description, unit and quantity in one run of text; gates come before the first occurrence wins."""
    h = _hits(pages, keys, text_col, _FDOT)
    q, d = F.col("g4").try_cast("double"), strip(F.col("g2"))
    ok = h.filter(description_fault(d).isNull() & _accepted(q, F.upper("g3")))
    return _first(_items(ok, keys, 1, F.concat_ws("_", F.lit("fdot"), "g1", "g4"), pay_item_no=F.col("g1"), description=d, unit=F.upper("g3"), quantity=q, source=F.lit("fdot"), confidence=F.lit("high"), source_text=F.col("m")), keys)


# Units of items on several lines.
_MULTILINE_UNITS = ("LS", "EA", "LF", "SY", "CY", "SF", "TON", "GAL", "AC", "AS", "GM")


def _multiline_fields(rest: Column) -> Column:
    """struct(d, q, u) of the lines behind a code: the first small number is the quantity; later ones, and anything that is no unit or
    code, can be the description; the last unit counts."""
    is_unit = lambda x: F.upper(x).isin(*_MULTILINE_UNITS)
    number = lambda x: to_double(F.replace(x, F.lit(","), F.lit("")))
    small = lambda x: ~is_unit(x) & F.coalesce(number(x) < 100_000, F.lit(False))
    words = lambda x: ~is_unit(x) & (F.length(x) > 5) & ~rlike(x, r"^\d{3}-\d{1,3}-\d{1,3}\s*$")

    def fields(r: Column, n: Column) -> Column:
        at = F.coalesce(F.array_position(r, n), F.lit(0))
        d = let(at, lambda k: F.get(F.filter(r, lambda x, i: (i + 1 != k) & words(x)), F.lit(0)))
        return F.struct(d.alias("d"), number(n).alias("q"), F.upper(F.get(F.reverse(F.filter(r, is_unit)), F.lit(0))).alias("u"))

    return let(F.filter(rest, lambda x: x != ""), lambda r: let(F.get(F.filter(r, small), F.lit(0)), lambda n: fields(r, n)))


def multiline_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A code alone on its line, and description, quantity and unit on the next four."""
    coded = lambda x: rlike(x, r"^(430|425)-\d{1,3}-\d{1,3}$")
    at = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(coded(x), F.struct(i.alias("hit"), x.alias("code"), F.slice(lines, i + 2, F.lit(4)).alias("rest")))), lambda x: x.isNotNull())
    some = pages.filter(rlike(F.col(text_col), r"(?m)^\s*(430|425)-\d{1,3}-\d{1,3}\s*$"))
    found = some.select(*[k for k in keys if k != "page_num"], _page(pages), F.explode(let(F.transform(F.split(text_col, "\n"), strip), at)).alias("_h")).select(*_page_keys(keys), F.lit(0).alias("pattern"), "_h.*")
    found = computed(found, _multiline_fields(F.col("rest")), "_f").select(*_page_keys(keys), "pattern", "hit", "code", "_f.*")
    ok = found.filter(F.col("d").isNotNull() & F.col("q").isNotNull() & F.col("u").isNotNull()).filter(description_fault(F.col("d")).isNull() & _accepted(F.col("q"), F.col("u")))
    return _first(_items(ok, keys, 2, F.concat_ws("_", F.lit("fdot_ml"), "code", F.col("q").cast("string")), pay_item_no=F.col("code"), description=F.col("d"), unit=F.col("u"), quantity=F.col("q"), source=F.lit("fdot_multiline"), confidence=F.lit("high"), source_text=F.concat_ws(" ", "code", "d")), keys)


def quantity_first_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Quantity, unit, size and material in eight orders; size and quantity are exchanged where only that makes sense."""
    table = rules.QUANTITY_FIRST
    h = _hits(pages, keys, text_col, [(r[0], max(x for x in r[1:] if x)) for r in table])
    field = lambda k: _group([r[k] for r in table])
    h = computed(h, F.struct(field(1).try_cast("double").alias("q"), F.upper(field(2)).alias("u"), field(3).try_cast("int").alias("s"), F.upper(field(4)).alias("mat"), field(5).alias("spec")), "_f")
    h = computed(h.select(*_page_keys(keys), "pattern", "hit", "m", "_f.*").filter(F.col("s").isNotNull()), swap_size_quantity(F.col("s"), F.col("q")), "x")
    q, s = F.col("x.quantity"), F.col("x.size").cast("string")
    kind = F.when(F.col("mat").isin("RCP", "SRCP"), " CLASS ").otherwise(" SDR ")
    d = F.concat(s, F.lit('" '), F.col("mat"), F.coalesce(F.concat(kind, "spec"), F.lit("")))
    ok = h.filter(_accepted(q, F.col("u")))
    return _first(_items(ok, keys, 3, F.concat_ws("_", F.lit("qty"), "mat", s, q.cast("string")), pay_item_no=F.concat_ws("-", "mat", s), description=d, unit=F.col("u"), quantity=q, source=F.lit("quantity_first"), confidence=F.lit("medium"), source_text=F.col("m")), keys)


def elliptical_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Pipes of catalog elliptical sizes; without a quantity they need checking."""
    table = rules.ELLIPTICAL
    h = _hits(pages, keys, text_col, [(r[0], max(x for x in r[1:] if x)) for r in table])
    field = lambda k: _group([r[k] for r in table])
    h = h.select(*_page_keys(keys), "pattern", "hit", "m", F.coalesce(field(1).try_cast("double"), F.lit(0.0)).alias("q"), F.coalesce(F.upper(field(2)), F.lit("LF")).alias("u"), field(3).try_cast("int").alias("r"), field(4).try_cast("int").alias("p"), field(5).alias("c"))
    h = h.filter(is_elliptical_size(F.col("r"), F.col("p")))
    r, p, q = F.col("r").cast("string"), F.col("p").cast("string"), F.col("q")
    d = F.concat(r, F.lit('"x'), p, F.lit('" ERCP'), F.coalesce(F.concat(F.lit(" CLASS "), "c"), F.lit("")))
    size = F.concat(r, F.lit("x"), p)
    return _first(_items(h, keys, 4, F.concat_ws("_", F.lit("ellip"), size, q.cast("string")), pay_item_no=F.concat(F.lit("ERCP-"), size), description=d, unit=F.col("u"), quantity=q, source=F.lit("elliptical_pipe"), confidence=F.when(q > 0, "medium").otherwise("low"), needs_verification=q == 0, rise=F.col("r"), span=F.col("p"), source_text=F.col("m")), keys)


def elliptical_ends(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Flared and mitered ends of elliptical pipes; mitered ones near GALV or STEEL belong to the galvanized items."""
    h = _hits(pages, keys, text_col, [(r[0], 2) for r in rules.ELLIPTICAL_ENDS], with_start=True)
    h = h.withColumn("r", F.col("g1").try_cast("int")).withColumn("p", F.col("g2").try_cast("int")).withColumn("flared", F.col("pattern") < 2)
    near = F.upper(F.substring(F.col("_text"), F.greatest(F.col("start") - 29, F.lit(1)), F.col("start") + F.length("m") + 30 - F.greatest(F.col("start") - 30, F.lit(0))))
    h = h.filter(is_elliptical_size(F.col("r"), F.col("p"))).filter(F.col("flared") | ~contains_any(near, ("GALV", "STEEL")))
    size, inches = F.concat_ws("x", F.col("r").cast("string"), F.col("p").cast("string")), F.concat(F.col("r").cast("string"), F.lit('"x'), F.col("p").cast("string"), F.lit('"'))
    pick = lambda a, b: F.when(F.col("flared"), a).otherwise(b)
    return _first(_items(h, keys, 5, F.concat_ws("_", F.lit("ellip"), pick("flared", "mes"), size), pay_item_no=F.concat(pick("ERCP-FE-", "ERCP-MES-"), size), description=F.concat(inches, pick(" ELLIPTICAL FLARED END", " ELLIPTICAL MES 4:1")), unit=F.lit("EA"), quantity=F.lit(1.0), source=F.lit("elliptical_accessory"), confidence=F.lit("medium"), structure_type=pick("FLARED_END_ELLIPTICAL", "MES_ELLIPTICAL"), rise=F.col("r"), span=F.col("p"), source_text=F.col("m")), keys)


def structure_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Endwalls, mitered and flared ends, cradles, of catalog sizes, with configuration and option."""
    table = rules.STRUCTURE_ITEMS
    h = _hits(pages, keys, text_col, [(r[0], max(x for x in r[2:] if x)) for r in table])
    field = lambda k: _group([r[k] for r in table])
    kind = F.get(F.array(*[F.lit(r[1]) for r in table]), F.col("pattern"))
    h = h.select(*_page_keys(keys), "pattern", "hit", "m", kind.alias("kind"), field(2).try_cast("int").alias("s"), F.upper(field(3)).alias("c"), F.upper(field(4)).alias("o"))
    oval = F.col("kind") == "MES_ELLIPTICAL"
    span = F.when(oval, F.col("c").try_cast("int"))
    h = h.filter(F.when(oval, is_elliptical_size(F.col("s"), span)).otherwise(is_round_size(F.col("s"))))
    config = F.when(oval | F.col("c").isNull(), "").when(F.contains("c", F.lit("45")) & F.contains("c", F.lit("DEG")), "45 DEGREE").when(rlike(F.col("c"), r"^U.*TYPE|^U$"), "U-TYPE").otherwise(F.col("c"))
    option = F.when(oval | F.col("o").isNull(), "").when(F.contains("o", F.lit("GRATE")) & F.contains("o", F.lit("BAFFLE")), "WITH GRATE AND BAFFLES").when(F.contains("o", F.lit("GRATE")), "WITH GRATE").when(F.contains("o", F.lit("BAFFLE")), "WITH BAFFLES").otherwise(F.col("o"))
    h = h.withColumn("config", config).withColumn("opt", option)
    size = F.when(oval, F.concat(F.col("s").cast("string"), F.lit('"x'), F.col("c"), F.lit('"'))).otherwise(F.concat(F.col("s").cast("string"), F.lit('"')))
    name = F.when(oval, "MES (ELLIPTICAL)").otherwise(F.replace("kind", F.lit("_"), F.lit(" ")))
    key = F.when(oval, F.concat(F.lit("struct_MES_"), "s", F.lit("x"), "c")).otherwise(F.concat_ws("_", F.lit("struct"), "kind", F.col("s").cast("string"), "config", "opt"))
    d = F.concat_ws(" ", size, name, none_if_empty(F.col("config")), none_if_empty(F.col("opt")))
    return _first(_items(h, keys, 6, key, pay_item_no=F.concat_ws("-", "kind", size), description=d, unit=F.lit("EA"), quantity=F.lit(1.0), source=F.lit("structure"), confidence=F.lit("medium"), structure_type=F.col("kind"), configuration=none_if_empty(F.col("config")), option=none_if_empty(F.col("opt")), source_text=F.col("m")), keys)


def galvanized_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Galvanized mitered ends, round or elliptical, with runs (one unless said) and frame (none unless said)."""
    table = [(r[0], *((r[1], None, r[2], r[3]) if len(r) == 4 else r[1:])) for r in rules.GALVANIZED]
    h = _hits(pages, keys, text_col, [(r[0], max(x for x in r[1:] if x)) for r in table])
    field = lambda k: _group([r[k] for r in table])
    h = h.select(*_page_keys(keys), "pattern", "hit", "m", field(1).try_cast("int").alias("s"), field(2).try_cast("int").alias("p"), F.concat(F.coalesce(F.upper(field(3)), F.lit("SINGLE")), F.lit(" RUN")).alias("run"), F.concat(F.coalesce(F.upper(field(4)), F.lit("NO")), F.lit(" FRAME")).alias("frame"))
    oval = F.col("p").isNotNull()
    h = h.filter(F.when(oval, is_elliptical_size(F.col("s"), F.col("p"))).otherwise(is_round_size(F.col("s"))))
    size = F.concat_ws("x", F.col("s").cast("string"), F.col("p").cast("string"))
    inches = F.when(oval, F.concat(F.col("s").cast("string"), F.lit('"x'), F.col("p").cast("string"), F.lit('"'))).otherwise(F.concat(F.col("s").cast("string"), F.lit('"')))
    d = F.concat_ws(" ", inches, F.lit("GALVANIZED STEEL 4:1 MES"), "run", "frame")
    return _first(_items(h, keys, 7, F.concat_ws("_", F.lit("galv_mes"), size, "run", "frame"), pay_item_no=F.concat(F.lit("GALV-MES-"), size), description=d, unit=F.lit("EA"), quantity=F.lit(1.0), source=F.lit("galvanized_mes"), confidence=F.lit("medium"), structure_type=F.when(oval, "GALVANIZED_MES_ELLIPTICAL").otherwise("GALVANIZED_MES_ROUND"), rise=F.when(oval, F.col("s")), span=F.col("p"), run_config=F.col("run"), frame_option=F.col("frame"), source_text=F.col("m")), keys)


# Materials and units of tables, in their order.
_TABLE_MATERIALS = ("RCP", "PVC", "HDPE", "CMP", "DIP", "SRCP", "ERCP", "ADS")
_TABLE_UNITS = ("LF", "EA", "SF", "SY", "CY", "TON", "GAL")


def table_lines(pages: DataFrame, keys: list[str], text_col: str = "text", cells_at_least: int = 3) -> DataFrame:
    """Lines of several cells in runs of two lines or more of a page: keys, page_num, line_no, cells."""
    cells = lambda line: F.filter(F.transform(F.split(strip(line), r"\s{2,}|\t"), strip), lambda c: c != "")
    keys = _page_keys(keys)
    # A line's neighbours come from the page's own lines: a task holds a page and sorts nothing.
    long = lambda a, i: F.coalesce(F.size(F.get(a, i)) >= cells_at_least, F.lit(False))
    rows = lambda a: F.filter(F.transform(a, lambda x, i: F.when(long(a, i) & (long(a, i - 1) | long(a, i + 1)), F.struct(i.alias("line_no"), x.alias("cells")))), lambda x: x.isNotNull())
    some = pages.filter(rlike(F.col(text_col), r"\s\s|\t")) if cells_at_least > 1 else pages
    return some.select(*[k for k in keys if k != "page_num"], _page(pages), F.explode(let(F.transform(F.split(text_col, "\n"), cells), rows)).alias("_x")).select(*keys, "_x.*")


def table_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows of tables read cell by cell: the last quantity and size win, materials in a fixed order."""
    t = table_lines(pages, keys, text_col).withColumn("pattern", F.lit(0)).withColumnRenamed("line_no", "hit")
    up = lambda c: F.upper(c)
    last = lambda a: F.get(F.reverse(a), F.lit(0))
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    of_list = lambda c, names: F.get(F.filter(F.array(*[F.lit(m) for m in names]), lambda m: F.contains(up(c), m)), F.lit(0))
    material = last(known(F.transform("cells", lambda c: of_list(c, _TABLE_MATERIALS))))
    unit = last(known(F.transform("cells", lambda c: F.get(F.filter(F.array(*[F.lit(u) for u in _TABLE_UNITS]), lambda u: (up(c) == u) | F.endswith(up(c), F.concat(F.lit(" "), u))), F.lit(0)))))
    size_like = "^(\\d{1,2})\\s*[\"”″]?\\s*$"
    size = last(F.filter(F.transform("cells", lambda c: extract(c, size_like).try_cast("int")), lambda n: is_round_size(n)))
    qty = last(F.filter(F.transform("cells", lambda c: F.when(~rlike(c, size_like), extract(c, r"^(\d+(?:\.\d+)?)\s*$")).try_cast("double")), lambda n: n > 0))
    words = F.filter("cells", lambda c: rlike(c, "[A-Za-z]") & ~up(c).isin(*_TABLE_UNITS))
    spelled = F.get(F.filter(F.transform(words, lambda c: extract(c, "(\\d{1,2})\\s*[\"”″]").try_cast("int")), lambda n: is_round_size(n)), F.lit(0))
    t = computed(t, F.struct(material.alias("mat"), qty.alias("q")), "_f").select(*_page_keys(keys), "pattern", "hit", "cells", "_f.*").filter("mat is not null and q > 0")
    t = computed(t, F.struct(unit.alias("u"), size.alias("s"), words.alias("words"), spelled.alias("spelled"), F.array_join("cells", " ").alias("m")), "_f").select(*_page_keys(keys), "pattern", "hit", "mat", "q", "_f.*")
    t = computed(t, F.when(F.col("s").isNotNull(), swap_size_quantity(F.col("s"), F.col("q"))).otherwise(F.struct(F.col("spelled").alias("size"), F.col("q").alias("quantity"))), "x")
    s, q = F.col("x.size").cast("string"), F.col("x.quantity")
    d = F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.concat_ws(" ", F.concat(s, F.lit('"')), "mat"))
    d = F.when(F.length(d) > 100, F.concat(F.left(d, F.lit(100)), F.lit("..."))).otherwise(d)
    return _first(_items(t, keys, 8, F.concat_ws("_", F.lit("table"), "mat", F.coalesce(s, F.lit("None")), q.cast("string")), pay_item_no=F.concat_ws("-", "mat", s), description=d, unit=F.coalesce("u", F.lit("LF")), quantity=q, source=F.lit("table"), confidence=F.lit("medium"), source_text=F.col("m")), keys)


def callout_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Labels such as RCP 24, counted by material and size; they have no quantity and need checking."""
    table = rules.CALLOUTS
    h = _hits(pages, keys, text_col, [(r[0], 2) for r in table])
    h = h.select(*_page_keys(keys), "pattern", "hit", F.upper(_group([r[1] for r in table])).alias("mat"), _group([r[2] for r in table]).alias("s")).filter(is_round_size(F.col("s").try_cast("int")))
    page = [c for c in ("page_num",) if c not in keys]
    g = h.groupBy(*keys, "mat", "s").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(F.struct("pattern", *page, "hit")).alias("o")).select(*keys, "mat", "s", "n", "o.*")
    return _items(g, keys, 9, F.concat_ws("_", F.lit("callout"), "mat", "s"), pay_item_no=F.concat_ws("-", "mat", "s"), description=F.concat("s", F.lit('" '), "mat", F.lit(" PIPE (VERIFY QTY)")), unit=F.lit("LF"), quantity=F.lit(0.0), source=F.lit("callout"), confidence=F.lit("low"), needs_verification=F.lit(True), mentions=F.col("n"), source_text=F.concat_ws(" ", "mat", "s"))


# Structures with a number.
_LABELS = (
    r"(?:STORM\s*DRAIN|SANITARY\s*SEWER|SD|SS)?\s*(MANHOLE|MH)\s*[#-]?\s*(\d+)",
    r"(?:GRATE|TYPE\s*[A-Z])?\s*(INLET)\s*[#-]?\s*(\d+)",
    r"(CATCH\s*BASIN|CB)\s*[#-]?\s*(\d+)",
    r"(JUNCTION\s*BOX|JB)\s*[#-]?\s*(\d+)",
)


def drainage_labels(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Numbered structures count one each; a type that is only mentioned without numbers is kept for checking."""
    h = _hits(pages, keys, text_col, [(p, 2) for p in _LABELS])
    kind = F.upper("g1")
    kind = F.when(kind == "MH", "MANHOLE").when(kind == "CB", "CATCH BASIN").when(kind == "JB", "JUNCTION BOX").otherwise(kind)
    named = h.withColumn("kind", kind)
    labels = _items(named, keys, 10, F.concat_ws("_", F.lit("struct"), "kind", "g2"), pay_item_no=F.col("kind"), description=F.concat("kind", F.lit(" #"), "g2"), unit=F.lit("EA"), quantity=F.lit(1.0), source=F.lit("drainage_label"), confidence=F.lit("high"), source_text=F.concat("kind", F.lit(" #"), "g2"))
    labels = _first(labels, keys)
    generic = F.array(*[F.struct(F.lit(100 + k).alias("pattern"), F.lit(0).alias("hit"), F.lit(t).alias("kind"), F.when(may_match(F.col("_up"), p), F.regexp_count(F.col("_text"), F.lit("(?i)" + p))).otherwise(0).alias("n")) for k, (p, t) in enumerate(rules.GENERIC_LABELS)])
    some = computed(pages.select(*[k for k in keys if k != "page_num"], _page(pages), F.col(text_col).alias("_text")), F.upper("_text"), "_up").filter(reduce(lambda a, b: a | b, [may_match(F.col("_up"), p) for p, _ in rules.GENERIC_LABELS]))
    seen = some.select(*_page_keys(keys), F.explode(F.filter(generic, lambda x: x["n"] > 0)).alias("x")).select(*_page_keys(keys), "x.*")
    seen = seen.groupBy(*keys, "kind").agg(F.sum("n").alias("n"), F.min(F.struct("pattern", "page_num", "hit")).alias("o")).select(*keys, "kind", "n", *[f"o.{c}" for c in ("pattern", "page_num", "hit") if c not in keys])
    mentions = _items(seen, keys, 10, F.concat(F.lit("struct_generic_"), "kind"), pay_item_no=F.col("kind"), description=F.concat("kind", F.lit(" (VERIFY QTY)")), unit=F.lit("EA"), quantity=F.lit(0.0), source=F.lit("drainage_label"), confidence=F.lit("low"), needs_verification=F.lit(True), mentions=F.col("n"), source_text=F.col("kind"))
    # A window, no anti join with the labels: their patterns would run once more.
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    numbered = F.max(F.col("mentions").isNull()).over(Window.partitionBy(*keys, "pay_item_no"))
    return labels.unionByName(mentions).withColumn("_numbered", known & numbered).filter("mentions is null or not _numbered").drop("_numbered")


def without_covered_callouts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Callouts whose size a coded, quantity-first or table item of the page has already are left out."""
    up, code = F.upper("description"), F.upper("pay_item_no")
    materials = "RCP|PVC|HDPE|CMP|DIP|SRCP"
    by_text = F.coalesce(extract(up, f"(\\d+)[\"”]?\\s*(?:{materials})"), extract(up, rf"(?:{materials})\s*-?\s*(\d+)"), extract(up, "ROUND\\s+(\\d+)[\"”]"))
    by_code = F.when(F.startswith(code, F.lit("430-17")), extract(code, r"-\d(\d{2})$"))
    by_code = F.when(is_round_size(by_code.try_cast("int")), by_code)
    has = F.when(F.col("source").isin("fdot", "quantity_first", "table"), F.array_compact(F.array(by_text, by_code)))
    size = F.when((F.col("source") == "callout") & (F.size(F.split("pay_item_no", "-")) == 2), F.substring_index("pay_item_no", "-", -1))
    # A window, no join of the items with themselves: every strategy would run once for each side.
    marked = computed(items, F.struct(has.alias("has"), size.alias("size")), "_sizes").withColumn("_have", F.flatten(F.collect_set("_sizes.has").over(Window.partitionBy(*keys))))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return marked.filter(~F.coalesce(known & F.array_contains("_have", F.col("_sizes.size")), F.lit(False))).drop("_sizes", "_have")


STRATEGIES = (fdot_items, multiline_items, quantity_first_items, elliptical_items, elliptical_ends, structure_items, galvanized_items, table_items, callout_items, drainage_labels)


def extract_items(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """All strategies, the first occurrence of each key, without covered callouts.

    Each strategy's items are kept and its plan is cut: all ten in one plan are analyzed again for every step after them, for minutes."""
    every = reduce(lambda a, b: a.unionByName(b), [cut(f(pages, keys, text_col)) for f in STRATEGIES])
    return without_covered_callouts(_first(every, keys), keys)


def _candidates(items: DataFrame, blocks: DataFrame, keys: list[str], item_key: str) -> DataFrame:
    """(keys, item, block_no, match_points, text_points) of items(_match, _text) and the blocks(_block) that hold a word of theirs, or that may hold
    a whole one without words.

    An inverted index: words of items meet the distinct tokens of a file on their first three characters, and tokens know their blocks, so items
    and blocks only meet where they share something."""
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 2)
    each = lambda c, m, t: F.transform(words(F.col(c)), lambda w: F.struct(w.alias("word"), F.lit(m).alias("m"), F.lit(t).alias("t")))
    wanted = items.select(*keys, item_key, F.explode(F.concat(each("_match", 20, 0), each("_text", 0, 10))).alias("w")).groupBy(*keys, item_key, "w.word").agg(F.sum("w.m").alias("m"), F.sum("w.t").alias("t"))
    postings = blocks.select(*keys, "block_no", F.explode(F.array_distinct(words(F.col("_block")))).alias("token"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda k: F.substring(F.col("token"), k, F.lit(3))))
    tokens = postings.select(*keys, "token").distinct().select(*keys, "token", F.explode(grams).alias("gram"))
    asked = wanted.select(*keys, "word").distinct().withColumn("gram", F.left("word", F.lit(3)))
    held = asked.join(tokens, [*keys, "gram"]).filter(F.contains("token", "word")).select(*keys, "word", "token").distinct()
    places = held.join(postings, [*keys, "token"]).select(*keys, "word", "block_no").distinct()
    by_words = wanted.join(places, [*keys, "word"]).groupBy(*keys, item_key, "block_no").agg(F.sum("m").alias("match_points"), F.sum("t").alias("text_points"))

    whole = items.select(*keys, item_key, F.explode(F.array("_match", "_text")).alias("whole")).filter((F.col("whole") != "") & (F.size(words(F.col("whole"))) == 0))
    short = whole.select(*keys, item_key, F.left("whole", F.lit(3)).alias("gram")).distinct()
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_block")), lambda k: F.array(*[F.substring(F.col("_block"), k, F.lit(n)) for n in (1, 2, 3)])))
    there = blocks.filter(F.col("_block") != "").select(*keys, "block_no", F.explode(F.array_distinct(parts)).alias("gram")).join(short.select(*keys, "gram").distinct(), [*keys, "gram"], "left_semi")
    by_parts = short.join(there, [*keys, "gram"]).select(*keys, item_key, "block_no", F.lit(0).cast("long").alias("match_points"), F.lit(0).cast("long").alias("text_points"))
    return by_words.unionByName(by_parts).groupBy(*keys, item_key, "block_no").agg(F.max("match_points").alias("match_points"), F.max("text_points").alias("text_points"))


def located(items: DataFrame, blocks: DataFrame, keys: list[str], item_key: str, match_col: str = "source_text") -> DataFrame:
    """Items with the text block they most likely come from: the block that holds the match scores 100, else 20 for
    each of its words; the description 50, or 10 for each word; 20 are needed, the first of the best wins."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    at = F.struct("page", "bbox", F.left("text", F.lit(100)).alias("text_context"), F.col("confidence").alias("ocr_confidence"))
    # Equal blocks of a file score alike, so the first stands for all; equal items have the same place. Only distinct ones meet.
    b = blocks.select(*keys, F.lower("text").alias("_block"), at.alias("_at"), "block_no").groupBy(*keys, "_block").agg(F.min_by("_at", "block_no").alias("_at"), F.min("block_no").alias("block_no"))
    asked = items.withColumn("_asked", F.struct(low(match_col).alias("_match"), low("description").alias("_text")))
    i = asked.select(*keys, "_asked").distinct().select("*", "_asked.*")
    holds = lambda c: (F.col(c) != "") & F.contains("_block", F.col(c))
    score = F.when(holds("_match"), 100).otherwise(F.col("match_points")) + F.when(holds("_text"), 50).otherwise(F.col("text_points"))
    pairs = _candidates(i, b, keys, "_asked").join(i, [*keys, "_asked"]).join(b, [*keys, "block_no"]).withColumn("_score", score).filter("_score >= 20")
    best = pairs.groupBy(*keys, "_asked").agg(F.max_by("_at", F.struct("_score", -F.col("block_no"))).alias("source_location"))
    return asked.join(best, [*keys, "_asked"], "left").drop("_asked")
