"""Product matching: catalog patterns over page text, quantities from the context, one row per product.

A page is read once for all products (`pattern_hits`): the literals that patterns can't do without are found by one automaton, and of
the products whose keywords the page has, only patterns whose literals are there are tried. What comes out are hits with the text
around them; all else is column expressions over those few rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from planquant.functions import rules
from planquant.functions.arrays import computed, let
from planquant.functions.text import extract, parse_number, rlike
from planquant.workers import workers_find_package

#: Patterns of one pass over the pages, by their characters: what is broadcast of a catalog. A larger one takes more passes.
PATTERN_CHARS = 16 << 20

# Ways to write a unit.
UNIT_FORMS = {
    "LF": (r"L\.?F\.?", r"LIN(?:EAR)?\s*(?:FT|FEET|FOOT)", r"FEET|FT\.?|'"),
    "EA": (r"EA\.?", "EACH", "EA?CH", r"PCS?\.?", r"PIECES?", r"UNITS?"),
}
_NUMBER = r"(\d+(?:,\d{3})*(?:\.\d+)?)"


def plausible_quantity(quantity: Column, unit: Column) -> Column:
    """Positive, no pipe size (for LF and EA), and within the unit's range."""
    sized = F.array_contains(F.expr(f"array({', '.join(f'{float(n)}D' for n in rules.PIPE_SIZES)})"), quantity)
    return (quantity > 0) & F.when(unit == "LF", ~sized & quantity.between(1, 50_000)).when(unit == "EA", ~sized & quantity.between(1, 500)).otherwise(quantity.between(1, 100_000))


def false_pipe(context: Column, size: Column) -> Column:
    """Whether a hit is a liner: its number in mil, a membrane, or a code of the 900 series."""
    n = extract(F.coalesce(size, F.lit("")), r"(\d+)").try_cast("int")

    def liner(up: Column) -> Column:
        words = rlike(up, "|".join(map(re.escape, rules.MEMBRANE_WORDS)))
        mil = F.contains(up, F.lit("MIL")) & F.regexp_like(up, F.concat(F.lit(r"\b"), n.cast("string"), F.lit(r"\s*MIL\b")))
        return n.isNotNull() & (mil | (words & (n.isin(*rules.MEMBRANE_MILS) | F.contains(up, F.lit("MEMBRANE")))) | rlike(up, r"\b900-\d"))

    return F.coalesce(let(F.upper(context), liner), F.lit(False))


def quantity_near(context: Column, unit: Column, start: Column, end: Column) -> Column:
    """struct(quantity, confidence, unit) from the text around a hit at [start, end), or null.

    In this order: number and unit on the hit's line (.95); in the context, by distance (.90, .75, .60), or unit before
    number (.75); behind leaders on the line (.85); behind the hit on the line (.65); behind it (.50); before it (.40)."""
    head = lambda a: F.get(a, F.lit(0))
    first = lambda a: head(F.filter(a, lambda x: x.isNotNull()))
    fine = lambda s, p: head(F.filter(F.transform(F.regexp_extract_all(s, p, F.lit(1)), parse_number), lambda q: plausible_quantity(q, unit)))
    sure = lambda q, c: F.when(q.isNotNull(), F.struct(q.alias("quantity"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), unit.alias("unit")))
    forms = F.coalesce(*[F.when(unit == name, F.split(F.lit("\t".join(ways)), "\t")) for name, ways in UNIT_FORMS.items()], F.expr("cast(array() as array<string>)"))
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))

    def by_distance(up: Column, p: Column) -> Column:
        """The first plausible number before a unit in the context."""

        def placed_hits(found: Column) -> Column:
            at = lambda i: length(F.split(up, p, F.lit(-1)), i + 1) + length(found, i)
            hits = F.transform(found, lambda m, i: F.struct(parse_number(F.call_function("regexp_extract", m, p, F.lit(1))).alias("q"), at(i).alias("start"), F.length(m).alias("n")))
            return head(F.filter(hits, lambda h: plausible_quantity(h["q"], unit)))

        def ranked(h: Column) -> Column:
            distance = F.least(F.abs(h["start"] - end), F.abs(h["start"] + h["n"] - start))
            return sure(h["q"], F.when(distance < 30, 0.90).when(distance < 80, 0.75).otherwise(0.60))

        return let(F.regexp_extract_all(up, p, F.lit(0)), lambda found: let(placed_hits(found), ranked))

    def around(v: Column) -> Column:
        up, line, after, before = v["up"], v["line"], v["after"], v["before"]
        number = lambda before_unit, f: F.concat(F.lit(rf"{_NUMBER}\s*(?:"), f, F.lit(")")) if before_unit else F.concat(F.lit("(?:"), f, F.lit(rf")\s*{_NUMBER}"))
        same_line = first(F.transform(forms, lambda f: sure(fine(v["line_up"], number(True, f)), 0.95)))
        in_context = first(F.flatten(F.transform(forms, lambda f: F.array(by_distance(up, number(True, f)), sure(fine(up, number(False, f)), 0.75)))))
        bare = F.lit(rf"\b{_NUMBER}\b")
        leaders = sure(fine(line, F.lit(rf"[.=\-_]{{3,}}\s*{_NUMBER}")), 0.85)
        return F.coalesce(same_line, in_context, leaders, sure(fine(F.substring_index(after, "\n", 1), bare), 0.65), sure(fine(after, bare), 0.50), sure(fine(before, bare), 0.40))

    before, after = F.left(context, start), F.substring(context, end + 1, F.length(context))
    line = F.concat(F.substring_index(before, "\n", -1), F.substring(context, start + 1, end - start), F.substring_index(after, "\n", 1))
    return let(F.struct(F.upper(context).alias("up"), line.alias("line"), F.upper(line).alias("line_up"), after.alias("after"), before.alias("before")), around)


def needed_literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern has, in capitals; empty if there is none of two or more."""
    from re import _constants as kinds, _parser

    runs, run = [""], []

    def walk(parts) -> None:
        nonlocal run
        for kind, value in parts:
            if kind is kinds.LITERAL and value < 128:
                run.append(chr(value))
                runs.append("".join(run))
            elif kind is kinds.SUBPATTERN:
                walk(value[3])
            else:
                run = []

    walk(_parser.parse(pattern))
    best = max(runs, key=len).upper()
    return best if len(best) > 1 else ""


class Finder:
    """All patterns of a catalog: what a text has of them."""

    def __init__(self, catalog: list[tuple[int, list[str], list[str]]]):
        import ahocorasick

        self.products = [(row_no, keywords, [(k, needed_literal(p), p) for k, p in enumerate(patterns)]) for row_no, keywords, patterns in catalog]
        self.compiled: dict[str, re.Pattern] = {}
        self.literals = ahocorasick.Automaton()
        for word in {w for _, keywords, patterns in self.products for w in (*keywords, *(x for _, x, _ in patterns)) if w}:
            self.literals.add_word(word, word)
        self.literals.make_automaton()

    def _pattern(self, p: str) -> re.Pattern:
        # As the JVM reads it: classes and case are ASCII's, a dot stops at any line end.
        if p not in self.compiled:
            self.compiled[p] = re.compile(p.replace(".*?", r"[^\n\r\x85\u2028\u2029]*?"), re.IGNORECASE | re.ASCII)
        return self.compiled[p]

    def hits(self, text: str):
        """(row_no, pattern, hit, start, end) of every match."""
        there = {w for _, w in self.literals.iter(text.upper())} if len(self.literals) else set()
        for row_no, keywords, patterns in self.products:
            if all(k in there for k in keywords):
                for k, literal, p in patterns:
                    if not literal or literal in there:
                        for i, m in enumerate(self._pattern(p).finditer(text)):
                            yield row_no, k, i, m.start(), m.end()


def pattern_hits(pages: DataFrame, catalog: DataFrame, keys: list[str], text_col: str = "text", window: int = 150) -> DataFrame:
    """(keys, row_no, pattern_no, hit, context, start, end) of every match of the catalog's patterns; start and end are places in
    the context. Products without patterns or keywords are not looked for. Null texts have no matches."""
    workers_find_package(pages.sparkSession)
    wanted = catalog.filter((F.size("patterns") > 0) & (F.size("keywords") > 0)).select("row_no", "keywords", "patterns")
    passes: list[list[tuple]] = [[]]
    room = PATTERN_CHARS
    for r in wanted.coalesce(1).toLocalIterator():
        size = sum(map(len, r["patterns"]))
        if passes[-1] and size > room:
            passes, room = [*passes, []], PATTERN_CHARS
        room -= size
        passes[-1].append((r["row_no"], list(r["keywords"]), list(r["patterns"])))
    given = pages.select(*keys, F.col(text_col).alias("_text"))
    key_schema = ", ".join(f"`{n}` {t}" for n, t in given.drop("_text").dtypes)
    key_types = [to_arrow_type(f.dataType) for f in given.schema.fields[:-1]]
    out = None
    for some in passes:
        held = pages.sparkSession.sparkContext.broadcast(some)

        def run(batches, held=held):
            finder = Finder(held.value)
            for batch in batches:
                rows: list[tuple] = []
                own = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
                for key, text in zip(own, batch.column(len(keys)).to_pylist(), strict=True):
                    for row_no, k, i, a, b in finder.hits(text or ""):
                        at = max(a - window, 0)
                        rows.append((*key, row_no, k, i, text[at : b + window], a - at, b - at))
                columns = list(zip(*rows, strict=True)) or [()] * (len(keys) + 6)
                types = [*key_types, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*keys, "row_no", "pattern_no", "hit", "context", "start", "end"])

        one = given.mapInArrow(run, f"{key_schema}, row_no long, pattern_no int, hit int, context string, start int, end int")
        out = one if out is None else out.unionByName(one)
    return out


def product_hits(pages: DataFrame, catalog: DataFrame, keys: list[str], text_col: str = "text", window: int = 150) -> DataFrame:
    """A row per hit of a product's pattern: keys, product, quantity, unit, confidence, context.

    `catalog` has keywords and patterns. Hits of liners are left out; earlier patterns add up to .1 of confidence."""
    page = [c for c in ("page_num",) if c in pages.columns and c not in keys]
    product = catalog.select("row_no", "id", "category", "product_type", "size", "configuration", "price", F.col("unit").alias("product_unit"), "fdot_code")
    # A few hits of few files are still much work: they go to all cores, however small they are, and stay there for what follows. The products are
    # what is broadcast: a catalog's size isn't known to the optimizer, and it would send the hits, guessed from the size of the pages' files.
    h = pattern_hits(pages, catalog, [*keys, *page], text_col, window).join(F.broadcast(product), "row_no").repartition(4 * pages.sparkSession.sparkContext.defaultParallelism, *keys)
    h = computed(h, false_pipe(F.col("context"), F.col("size")), "_liner").filter("not _liner").drop("_liner")
    q = F.coalesce(quantity_near(F.col("context"), F.col("product_unit"), F.col("start"), F.col("end")), F.struct(F.lit(0.0).alias("quantity"), F.lit(0.3).alias("confidence"), F.col("product_unit").alias("unit")))
    bonus = F.greatest(F.lit(0.0), F.lit(0.1) - F.col("pattern_no") * 0.02)
    return computed(h, q, "q").select(*keys, *page, "row_no", "id", "category", "product_type", "size", "configuration", "price", "fdot_code", "pattern_no", "hit", F.col("q.quantity").alias("quantity"), F.least(F.lit(1.0), F.col("q.confidence") + bonus).alias("confidence"), F.col("q.unit").alias("unit"), F.trim("context").alias("source_text"))


def best_per_product(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per product: the most certain hit; if that has no quantity, the next best one's (over .4) is borrowed."""
    page = ["page_num"] if "page_num" in hits.columns and "page_num" not in keys else []
    by = Window.partitionBy(*keys, "id")
    r = hits.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("confidence"), F.desc(F.col("quantity") > 0), "pattern_no", *page, "hit")))
    spare = F.when((F.col("_rank") > 1) & (F.col("quantity") > 0) & (F.col("confidence") > 0.4), F.col("_rank"))
    # Windows, no join: hits are found once, and no table of them goes through the driver to be broadcast.
    j = r.withColumn("_alt", F.min_by(F.struct("quantity", "confidence", "unit"), spare).over(by)).withColumn("_n", F.count(spare).over(by)).filter("_rank = 1")
    borrow = (F.col("quantity") == 0) & (F.col("_n") > 0)
    pick = lambda a, b: F.when(borrow, a).otherwise(b)
    return j.withColumn("_q", pick(F.col("_alt.quantity"), F.col("quantity"))).withColumn("_c", pick(F.least("confidence", "_alt.confidence"), F.col("confidence"))).withColumn("_u", pick(F.col("_alt.unit"), F.col("unit"))).drop("quantity", "confidence", "unit", "_alt", "_n", "_rank").withColumnsRenamed({"_q": "quantity", "_c": "confidence", "_u": "unit"})


def best_class(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Of pipes of one size in several classes the one the text names, else the usual one (III, IV, V) at .7 at most."""
    up, config = F.upper("source_text"), F.upper(F.coalesce("configuration", F.lit("")))
    named = lambda c: rlike(up, rf"CLASS\s*{c}\b|CL\s*{c}\b|C-{c}\b|\b{c}\s*RCP")
    of_text = F.when(named("III"), "III").when(named("IV"), "IV").when(named("V"), "V")
    of_product = F.when(rlike(config, r"CL ?III"), "III").when(rlike(config, r"CL ?IV"), "IV").when(rlike(config, r"CL ?V"), "V")
    score = F.when(of_text.isNotNull() & of_product.isNotNull(), F.when(of_text == of_product, 100).otherwise(-100)).when(of_product == "III", 10).when(of_product == "IV", 5).when(of_product == "V", 1).otherwise(0)
    classed = (F.col("category") == "RCP_Price_List") & rlike(config, r"^CL\s*[IVX]+")
    group = F.when(classed, F.concat(F.lit("RCP_"), F.trim(F.replace("size", F.lit('"'), F.lit(""))))).otherwise(F.col("id"))
    m = matched.withColumn("_g", group).withColumn("_s", score)
    by = Window.partitionBy(*keys, "_g")
    r = m.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_s"), F.desc("confidence"), "row_no")))
    best = r.filter("_rank = 1")
    low = (F.col("_n") > 1) & (F.col("_s") <= 10)
    return best.withColumn("confidence", F.when(low, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence"))).drop("_g", "_s", "_n", "_rank")


def product_matches(pages: DataFrame, catalog: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return best_class(best_per_product(product_hits(pages, catalog, keys, text_col), keys), keys)


def extended_price(quantity: Column, price: Column) -> Column:
    return F.when(price > 0, quantity * price).otherwise(0.0)


def to_pay_items(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Matches as pay items; a price of 0 is no price."""
    c, priced = F.col("confidence"), F.col("price") > 0
    return matched.select(
        *keys,
        *[c for c in ("page_num",) if c in matched.columns and c not in keys],
        F.coalesce("fdot_code", F.concat_ws("-", "category", "size")).alias("pay_item_no"),
        F.concat_ws(" ", F.nullif("size", F.lit("")), F.nullif("product_type", F.lit("")), F.nullif("configuration", F.lit(""))).alias("description"),
        "unit", "quantity", F.lit(True).alias("matched"), F.when(priced, F.col("price")).alias("unit_price"), F.when(priced, F.col("quantity") * F.col("price")).alias("line_cost"),
        F.lit("product_first").alias("source"), F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low").alias("confidence"), c.alias("confidence_score"),
        ((F.col("quantity") == 0) | (c < 0.6)).alias("needs_verification"), F.left("source_text", F.lit(200)).alias("source_text"),
    )


def supplemented(product_items: DataFrame, regex_items: DataFrame, keys: list[str]) -> DataFrame:
    """Product items, and the extracted items that they don't cover: same number in the code and the same family."""
    family = lambda d: F.array_compact(F.array(*[F.when(F.contains(F.upper(d), F.lit(w)), w) for w in ("RCP", "ENDWALL", "MES")]))
    number = F.regexp_extract("pay_item_no", r"(\d+)", 1)
    # Codes hold an item's number anywhere; every run of digits and each part of it is a key of the anti join.
    have = product_items.select(*keys, F.col("pay_item_no").alias("_code"), F.explode(family(F.col("description"))).alias("_f"), F.regexp_extract("description", r"(\d+)", 1).alias("_n"))
    have = have.filter(F.contains("_code", F.col("_n"))).select(*keys, "_f", "_n").distinct()
    marked = regex_items.withColumn("_id", F.monotonically_increasing_id())
    covered = marked.select(*keys, "_id", F.explode(family(F.col("description"))).alias("_f"), number.alias("_n")).filter("_n <> ''").join(have, [*keys, "_f", "_n"]).select("_id").distinct()
    rest = marked.join(covered, "_id", "left_anti").drop("_id").withColumn("confidence_score", F.when(F.col("confidence").isin("high", "medium"), 0.6))
    return product_items.unionByName(rest, allowMissingColumns=True)


def uncovered_by_summary(product_items: DataFrame, summary_items: DataFrame, keys: list[str]) -> DataFrame:
    """Product items whose code (without FDOT) starts no code of the sheet's own items."""
    code = F.trim(F.replace(F.coalesce("pay_item_no", F.lit("")), F.lit("FDOT "), F.lit("")))
    parts = F.split("pay_item_no", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    have = summary_items.select(*keys, F.explode(prefixes).alias("_code")).distinct()
    return product_items.withColumn("_code", code).join(have, [*keys, "_code"], "left_anti").drop("_code").withColumn("source", F.lit("product_first_supplement"))
