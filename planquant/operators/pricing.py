"""Prices: a cascade of joins with the catalog; each step only sees what the steps before left over.

Prices depend on an item's code and description alone, so the cascade runs once for each distinct pair of them. The catalog is a
dimension table. Joins leave the choice of broadcast to the optimizer's size check; the step without an equal key (tokens) joins
on the few tokens that a pair of the needed overlap must share, the common ones of the trade last, never on all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions.arrays import computed
from planquant.functions.text import contains_any, extract, is_membrane, size_inches, tokens
from planquant.operators.structures import structure_of
from planquant.workers import kept

PRODUCT = ("product_type", "size", "configuration", "price", "unit", "fdot_code", "category")


def item_size(description: Column) -> Column:
    """The first one or two digits of a description, with an inch sign; empty if there are none."""
    n = F.regexp_extract(F.lower(F.coalesce(description, F.lit(""))), r"(\d{1,2})[\"\s]*(?:inch)?", 1)
    return F.when(n != "", F.concat(n, F.lit('"'))).otherwise("")


def keyed_catalog(catalog: DataFrame) -> DataFrame:
    """The price list's view of the catalog: of products with the same size, configuration and type the last counts, at
    the first one's place."""
    by = Window.partitionBy("size", "configuration", "product_type")
    ranked = catalog.withColumn("_place", F.min("row_no").over(by)).withColumn("_last", F.max("row_no").over(by))
    return ranked.filter("row_no = _last").withColumn("row_no", F.col("_place")).drop("_place", "_last")


def with_fdot(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("fdot_norm", F.trim(F.replace(F.coalesce("fdot_code", F.lit("")), F.lit("FDOT "), F.lit("")))).withColumn("size_norm", size_inches(F.col("size")))


def _product(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in PRODUCT])


def candidate_score(description: Column, size: Column, product_size: Column, product_type: Column, configuration: Column) -> Column:
    """100 for the size; 50 for a shared number of barrels (or 10 for a single one unsaid); 25 for each shared shape."""
    d, t, c = F.lower(description), F.lower(F.coalesce(product_type, F.lit(""))), F.lower(F.coalesce(configuration, F.lit("")))
    has = lambda s, w: F.contains(s, F.lit(w))
    barrels = F.lit(0)
    barrels = F.when(has(c, "single") & ~has(d, "double") & ~has(d, "triple") & ~has(d, "quad"), 10).otherwise(barrels)
    for w in ("quad", "triple", "double", "single"):
        barrels = F.when(has(d, w) & has(c, w), 50).otherwise(barrels)
    shape = F.lit(0)
    for w in ("straight", "winged", "u-type"):
        shape = shape + F.when(has(d, w) & has(t, w), 25).otherwise(0)
    return F.when((size != "") & (size == product_size), 100).otherwise(0) + barrels + shape


def _best(joined: DataFrame, key: str, score: Column) -> DataFrame:
    return joined.groupBy(key).agg(F.max_by(_product("c."), F.struct(score.alias("s"), (-F.col("c.row_no")).alias("r"))).alias("product"))


def by_code(items: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, product): the exact code, or the longest prefix of its parts that the catalog has."""
    parts = F.split("pay_item_no", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    p = items.select(key, "description", "size_of_item", F.explode(prefixes).alias("prefix"))
    codes = catalog.filter("fdot_norm <> ''").select(F.col("fdot_norm").alias("prefix")).distinct()
    longest = p.join(codes, "prefix").groupBy(key).agg(F.max_by(F.struct("prefix", "description", "size_of_item"), F.length("prefix")).alias("x")).select(key, "x.*")
    c = catalog.filter("fdot_norm <> ''").alias("c")
    i = longest.alias("i")
    return _best(i.join(c, F.col("i.prefix") == F.col("c.fdot_norm")), key, candidate_score(F.col("i.description"), F.col("i.size_of_item"), F.col("c.size_norm"), F.col("c.product_type"), F.col("c.configuration")))


def by_family(items: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, product): the same size and the same family (endwall, pipe, inlet, manhole, mitered end); the first product wins."""
    d, t = F.lower("i.description"), F.lower("c.product_type")
    has = lambda s, w: F.contains(s, F.lit(w))
    family = (has(d, "endwall") & has(t, "endwall")) | (contains_any(d, ("rcp", "pipe", "culvert")) & has(t, "pipe")) | (has(d, "inlet") & has(t, "inlet")) | (has(d, "manhole") & has(t, "manhole")) | (has(d, "mes") & has(t, "mes"))
    i, c = items.filter("size_of_item <> ''").alias("i"), catalog.alias("c")
    return _best(i.join(c, (F.col("i.size_of_item") == F.col("c.size_norm")) & family), f"i.{key}", F.lit(0)).toDF(key, "product")


#: Words that most products of a kind have; they come last where sets of tokens are ordered, so that joins hardly use them.
COMMON_TOKENS = ("pipe", "endwall", "inlet", "manhole", "culvert", "round", "elliptical", "straight", "winged", "type", "class", "cl", "end", "section", "single", "double", "triple", "box", "mes")


def _needed(t: Column, share: float) -> Column:
    """The tokens of a set of which any set that shares `share` of the larger one of both must have one: in one order for all
    sets, all but the last that can be missing."""
    ordered = F.transform(F.array_sort(F.transform(t, lambda w: F.struct(w.isin(*COMMON_TOKENS).alias("common"), w.alias("w")))), lambda x: x["w"])
    return F.slice(ordered, F.lit(1), F.size(t) - F.ceil(F.size(t) * share - 1e-9).cast("int") + 1)


def by_tokens(items: DataFrame, catalog: DataFrame, key: str, least: float = 0.4) -> DataFrame:
    """(key, product): 0.6 for shared tokens over the larger set, 0.3 for the same size; `least` is needed. The first of the best
    wins. Sets of tokens are compared once, whatever the number of items that have them: with the products of the same
    size if they have one, and with those that share enough tokens without it."""
    i = items.select(key, "size_of_item", F.array_sort(tokens(F.col("description"))).alias("t")).filter(F.size("t") > 0)
    asked = i.groupBy("t", "size_of_item").agg(F.count(F.lit(1)).alias("_n")).select(F.col("t").alias("it"), F.col("size_of_item").alias("is"))
    # Products of one size and one set of tokens score alike, so the first stands for all of them.
    sets = computed(catalog, F.array_sort(tokens(F.concat_ws(" ", "product_type", "configuration"))), "ct").filter(F.size("ct") > 0)
    c = sets.select("ct", "size_norm", "row_no", F.struct(*PRODUCT).alias("product")).groupBy("ct", "size_norm").agg(F.min_by("product", "row_no").alias("product"), F.min("row_no").alias("row_no"))
    share = lambda: F.size(F.array_intersect("it", "ct")) / F.greatest(F.size("it"), F.size("ct"))
    sized = asked.filter(F.col("is") != "").join(c, F.col("is") == F.col("size_norm")).withColumn("score", (share() * 60 + 30) / 100)
    plain = asked.select("*", F.explode(_needed(F.col("it"), least / 0.6)).alias("w")).join(c.select("row_no", F.explode(_needed(F.col("ct"), least / 0.6)).alias("w")), "w").select("it", "is", "row_no").distinct()
    plain = plain.join(c, "row_no").withColumn("score", share() * 60 / 100)
    columns = ["it", "is", "score", "row_no", "product"]
    # Every stage of a pair gets its share of tokens; a product without any never counts.
    scored = sized.filter(F.size(F.array_intersect("it", "ct")) > 0).select(*columns).unionByName(plain.select(*columns)).filter(F.col("score") >= least)
    best = scored.groupBy("it", "is").agg(F.max_by("product", F.struct(F.col("score"), -F.col("row_no"))).alias("product"))
    return i.join(best, (F.col("t") == F.col("it")) & (F.col("size_of_item") == F.col("is"))).select(key, "product")


#: The steps of the cascade, in order.
STEPS = ("code", "family", "tokens", "structure")


def matched_products(items: DataFrame, catalog: DataFrame, key: str = "item_no") -> DataFrame:
    """(key, product, match_source): code, then size and family, then tokens, then structure wording. Liners match nothing.

    Every step looks at all items, which are distinct questions here, and the first step that found something counts: one
    aggregation over the few hits, where anti joins would have each step contain the plans of all before it."""
    catalog = with_fdot(catalog)
    listed = with_fdot(keyed_catalog(catalog.drop("fdot_norm", "size_norm")))
    asked = items.filter(~is_membrane(F.col("description"))).select(key, "pay_item_no", "description").withColumn("size_of_item", item_size(F.col("description")))
    found = [step(asked, table, key).select(key, "product") for step, table in ((by_code, catalog), (by_family, listed), (by_tokens, listed))]
    wording = contains_any(F.upper("description"), ("INLET", "MANHOLE", "MH", "JUNCTION", "CATCH BASIN", "CB"))
    st = asked.filter(wording).select(key, structure_of(F.col("description")).alias("s")).filter("s.confidence >= 0.6")
    product = F.struct(F.col("s.description").alias("product_type"), F.col("s.subtype").alias("size"), F.lit("Standard").alias("configuration"), F.col("s.unit_price").alias("price"), F.col("s.unit").alias("unit"), F.col("s.fdot_code").alias("fdot_code"), F.lit(None).cast("string").alias("category"))
    found.append(st.select(key, product.alias("product")))
    hits = reduce(DataFrame.unionByName, [f.withColumn("step", F.lit(n)) for n, f in enumerate(found)])
    first = hits.groupBy(key).agg(F.min_by(F.struct("product", "step"), "step").alias("x"))
    return first.select(key, "x.product", F.get(F.array(*map(F.lit, STEPS)), F.col("x.step")).alias("match_source"))


def priced(items: DataFrame, catalog: DataFrame, key: str = "item_no") -> DataFrame:
    """Items with matched, unit_price, line_cost and matched_product; a match found replaces an earlier one. A price of
    0 (on request) counts as matched, at no cost."""
    asked = items.select(F.col("pay_item_no").alias("_code"), F.col("description").alias("_text"))
    question = lambda code, text: F.to_json(F.struct(F.col(code).alias("c"), F.col(text).alias("d")))
    # Kept, since each step's conditions would else be asked of all items, not of the distinct ones; what is found, since its size decides the join.
    questions = kept(asked.distinct()).select(question("_code", "_text").alias("_question"), F.col("_code").alias("pay_item_no"), F.col("_text").alias("description"))
    hits = kept(matched_products(questions, catalog, "_question"))
    j = items.withColumn("_question", question("pay_item_no", "description")).join(hits, "_question", "left")
    new = F.col("product").isNotNull()
    old = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    return j.select(
        *[c for c in items.columns if c not in ("matched", "unit_price", "line_cost", "matched_product", "match_source")],
        (new | F.coalesce(old("matched", "boolean"), F.lit(False))).alias("matched"),
        F.when(new, F.col("product.price")).otherwise(old("unit_price", "double")).alias("unit_price"),
        F.when(new, F.col("quantity") * F.col("product.price")).otherwise(old("line_cost", "double")).alias("line_cost"),
        F.col("product").alias("matched_product"),
        hits["match_source"].alias("match_source"),
        (F.col("product.price") == 0).alias("call_for_price"),
    )


def with_second_opinion(items: DataFrame, suggestions: DataFrame, least: float = 0.5) -> DataFrame:
    """Unmatched items joined with suggestions (description, code, confidence, reason) from an outside matcher; a match
    without a price."""
    s = suggestions.filter(F.col("confidence") >= least).groupBy("description").agg(F.max_by(F.struct("code", "confidence", "reason"), "confidence").alias("_s"))
    j = items.join(s, "description", "left")
    use = ~F.col("matched") & F.col("_s").isNotNull()
    return j.withColumn("matched_code", F.when(use, F.col("_s.code"))).withColumn("ai_confidence", F.when(use, F.col("_s.confidence"))).withColumn("ai_match_reason", F.when(use, F.col("_s.reason"))).withColumn("matched", F.col("matched") | use).drop("_s")
