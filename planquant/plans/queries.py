"""Queries over the driver's tables: the operators on plan text made from them, each with SQL that needs no such text.

Plan text is written from structured columns (order lines as items, parts as products, orders as files), read back by
the operators, and held against SQL over the structured columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planquant.functions import rules, text as T
from planquant.operators import catalog as C, extract as E, gates as G, geometry, layout, messy, pages as P, pricing, products, review, rollup, structures, summary
from planquant.plans import takeoff
from planquant.plans.registry import register
from planquant.sources import files, flow, sinks
from planquant.streaming import mail

MATERIALS = ("RCP", "PVC", "HDPE", "CMP")
UNITS = ("LF", "EA", "SY", "SF", "CY", "TON", "GAL", "AC", "LS")
RUNS = ("SINGLE", "DOUBLE", "TRIPLE", "QUAD")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def _sql_pick(values, n: str) -> str:
    return f"list_value({', '.join(repr(v) for v in values)})[{n} % {len(values)} + 1]"


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a size, a material and a whole quantity."""
    part = _table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand", "p_name")
    line = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    pair = _pick([f"{a}x{b}" for a, b in rules.ELLIPTICAL_SIZES], F.col("p_size"))
    return j.select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("int").alias("q"),
        _pick(rules.PIPE_SIZES, F.col("p_size")).cast("int").alias("sz"), _pick(MATERIALS, F.col("p_partkey")).alias("mat"), pair.alias("oval"), _pick(RUNS, F.col("p_partkey")).alias("cfg"),
        _pick(UNITS, F.col("p_partkey")).alias("u"), "l_extendedprice", "p_retailprice", "p_brand", "p_name", "p_type", "p_size",
    )


_PAIRS = [f"{a}x{b}" for a, b in rules.ELLIPTICAL_SIZES]
BASE = f"""base as (select l_orderkey as file_id, l_linenumber as ln, l_partkey as pk, l_suppkey as sk, cast(l_quantity as int) as q,
  {_sql_pick(rules.PIPE_SIZES, 'p_size')} as sz, {_sql_pick(MATERIALS, 'p_partkey')} as mat, {_sql_pick(_PAIRS, 'p_size')} as oval, {_sql_pick(RUNS, 'p_partkey')} as cfg,
  {_sql_pick(UNITS, 'p_partkey')} as u, l_extendedprice, p_retailprice, p_brand, p_name, p_type, p_size
  from lineitem join part on l_partkey = p_partkey)"""


def cat(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def page_of(lines: DataFrame, line: Column, header: str = "") -> DataFrame:
    """One page per file, its lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ln", "pk", "sk", line.alias("l"))))
    return lines.groupBy("file_id").agg(F.concat(F.lit(header), F.array_join(F.transform(ordered, lambda x: x["l"]), "\n")).alias("text"))


c = F.col
_code = lambda: cat("430-175-1", c("sz"))
_fdot_line = lambda: cat(_code(), " PIPE CULVERT ROUND ", c("sz"), '" RCP LF ', c("q"))


def _fdot_pages(s, d):
    return page_of(base(s, d), _fdot_line())


register(
    "material_summary_pipe",
    lambda s, d: rollup.material_pipes(G.accepted(E.fdot_items(_fdot_pages(s, d), ["file_id"]).withColumn("unit_price", F.lit(None).cast("double")).withColumn("line_cost", F.lit(None).cast("double")))),
    f"with {BASE}, i as (select distinct file_id, sz, q from base) select cast(sz as varchar) as size, 'RCP' as material, cast(sum(q) as double) as total_lf, count(*) as n_items from i group by sz",
)
register(
    "fdot_items",
    lambda s, d: E.fdot_items(_fdot_pages(s, d), ["file_id"]).select("file_id", "pay_item_no", "description", "unit", "quantity"),
    f"""with {BASE} select distinct file_id, '430-175-1' || sz as pay_item_no, 'PIPE CULVERT ROUND ' || sz || '" RCP' as description, 'LF' as unit, cast(q as double) as quantity from base""",
)
register(
    "multiline_items",
    lambda s, d: E.multiline_items(page_of(base(s, d), cat(_code(), "\nCONCRETE PIPE ROUND\n", c("q"), "\nLF")), ["file_id"]).select("file_id", "pay_item_no", "description", "unit", "quantity"),
    f"with {BASE} select distinct file_id, '430-175-1' || sz as pay_item_no, 'CONCRETE PIPE ROUND' as description, 'LF' as unit, cast(q as double) as quantity from base",
)
register(
    "quantity_first",
    lambda s, d: E.quantity_first_items(page_of(base(s, d), cat(c("q"), " LF ", c("sz"), '" ', c("mat"))), ["file_id"]).select("file_id", "pay_item_no", "description", "unit", "quantity"),
    f"""with {BASE} select distinct file_id, mat || '-' || sz as pay_item_no, sz || '" ' || mat as description, 'LF' as unit, cast(q as double) as quantity from base""",
)
register(
    "elliptical_items",
    lambda s, d: E.elliptical_items(page_of(base(s, d), cat(c("q"), " LF ", c("oval"), " ERCP ;")), ["file_id"]).select("file_id", "pay_item_no", "unit", "quantity", "needs_verification"),
    f"with {BASE} select distinct file_id, 'ERCP-' || oval as pay_item_no, 'LF' as unit, cast(q as double) as quantity, false as needs_verification from base union all select distinct file_id, 'ERCP-' || oval, 'LF', 0.0::double, true from base",
)
register(
    "elliptical_ends",
    lambda s, d: E.elliptical_ends(page_of(base(s, d), cat(c("oval"), F.when(c("pk") % 2 == 0, " FLARED END ;").otherwise(" MES ;"))), ["file_id"]).select("file_id", "pay_item_no", "structure_type"),
    f"with {BASE} select distinct file_id, case when pk % 2 = 0 then 'ERCP-FE-' else 'ERCP-MES-' end || oval as pay_item_no, case when pk % 2 = 0 then 'FLARED_END_ELLIPTICAL' else 'MES_ELLIPTICAL' end as structure_type from base",
)
register(
    "structure_items",
    lambda s, d: E.structure_items(page_of(base(s, d), cat(c("sz"), '" STRAIGHT ENDWALL ', c("cfg"), " ;")), ["file_id"]).select("file_id", "pay_item_no", "description", "configuration"),
    f"""with {BASE} select distinct file_id, 'STRAIGHT_ENDWALL-' || sz || '"' as pay_item_no, sz || '" STRAIGHT ENDWALL ' || cfg as description, cfg as configuration from base""",
)
register(
    "galvanized_items",
    lambda s, d: E.galvanized_items(page_of(base(s, d), cat(c("sz"), '" GALV STEEL MES ', _pick(RUNS[:3], c("pk")), " RUN ", F.when(c("pk") % 2 == 0, "WITH").otherwise("NO"), " FRAME ;")), ["file_id"]).select("file_id", "pay_item_no", "run_config", "frame_option"),
    f"with {BASE} select distinct file_id, 'GALV-MES-' || sz as pay_item_no, {_sql_pick(RUNS[:3], 'pk')} || ' RUN' as run_config, case when pk % 2 = 0 then 'WITH FRAME' else 'NO FRAME' end as frame_option from base",
)
register(
    "table_items",
    lambda s, d: E.table_items(page_of(base(s, d), cat(c("mat"), "    ", c("sz"), '"    ', c("q") + 100, "    LF")), ["file_id"]).select("file_id", "pay_item_no", "description", "unit", "quantity"),
    f"with {BASE} select distinct file_id, mat || '-' || sz as pay_item_no, mat as description, 'LF' as unit, cast(q + 100 as double) as quantity from base where file_id in (select file_id from base group by file_id having count(*) > 1)",
)
register(
    "callouts",
    lambda s, d: E.callout_items(page_of(base(s, d), cat(c("mat"), " ", c("sz"), " ;")), ["file_id"]).select("file_id", "pay_item_no", "mentions", "needs_verification"),
    f"with {BASE} select file_id, mat || '-' || sz as pay_item_no, cast(count(*) as int) as mentions, true as needs_verification from base group by file_id, mat, sz",
)


def _anti(s: SparkSession, d: str) -> DataFrame:
    b = base(s, d)
    pages = page_of(b, cat(F.when(c("pk") % 2 == 0, cat(_fdot_line(), " ;\n")).otherwise(F.lit("")), "RCP ", c("sz"), " ;"))
    both = E.fdot_items(pages, ["file_id"]).unionByName(E.callout_items(pages.withColumn("text", F.regexp_replace("text", r"(?m)^430.*$", "")), ["file_id"]))
    return E.without_covered_callouts(both, ["file_id"]).filter("source = 'callout'").select("file_id", "pay_item_no", "mentions")


register(
    "callout_antidedupe",
    _anti,
    f"with {BASE} select file_id, 'RCP-' || sz as pay_item_no, cast(count(*) as int) as mentions from base b where not exists (select 1 from base x where x.file_id = b.file_id and x.sz = b.sz and x.pk % 2 = 0) group by file_id, sz",
)
register(
    "drainage_labels",
    lambda s, d: E.drainage_labels(page_of(base(s, d), F.when(c("pk") % 3 == 0, cat("INLET #", c("q"), " ;")).when(c("pk") % 3 == 1, cat("MH-", c("q"), " ;")).otherwise("CATCH BASIN ;")), ["file_id"]).select("file_id", "description", "quantity", "mentions"),
    f"""with {BASE} select distinct file_id, case pk % 3 when 0 then 'INLET #' else 'MANHOLE #' end || q as description, 1.0::double as quantity, cast(null as int) as mentions from base where pk % 3 < 2
    union all select file_id, 'CATCH BASIN (VERIFY QTY)', 0.0::double, cast(count(*) as int) from base where pk % 3 = 2 group by file_id""",
)

_HEAD = "SUMMARY OF QUANTITIES\nPROJECT SHEET OF ALL THE WORK THAT IS TO BE DONE UNDER THIS CONTRACT AS SHOWN ON THE DRAWINGS\n"
register(
    "summary_standard",
    lambda s, d: summary.standard_items(page_of(base(s, d), cat(_code(), "\nPIPE CULVERT\n", c("q"), "\nLF"), _HEAD).filter(P.is_summary_page(c("text"))), ["file_id"]).select("file_id", "pay_item_no", "description", "quantity", "unit"),
    f"with {BASE} select file_id, '430-175-1' || sz as pay_item_no, 'PIPE CULVERT' as description, cast(q as double) as quantity, 'LF' as unit from base",
)
register(
    "summary_tabulation",
    lambda s, d: summary.tabulated_items(page_of(base(s, d), cat(_code(), "\nPIPE CULVERT\nLF\n", c("q"), "\n", c("q") + 7), "TABULATION OF QUANTITIES\n"), ["file_id"]).select("file_id", "pay_item_no", "quantity", "unit"),
    f"with {BASE} select file_id, '430-175-1' || sz as pay_item_no, cast(q + 7 as double) as quantity, 'LF' as unit from base",
)


def _parts(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select(c("p_partkey").alias("file_id"), _pick(rules.PIPE_SIZES, c("p_size")).cast("int").alias("sz"), c("p_size").alias("n"), "p_partkey", "p_name", "p_type", "p_retailprice", "p_size", "p_brand")


_PARTS = f"parts as (select p_partkey as file_id, {_sql_pick(rules.PIPE_SIZES, 'p_size')} as sz, p_size as n, * from part)"
register(
    "summary_inline",
    lambda s, d: summary.inline_items(_parts(s, d).select("file_id", cat(_code(), " PIPE CULVERT, ROUND ", c("sz"), '" LF ', c("n")).alias("text")), ["file_id"]).select("file_id", "pay_item_no", "description", "quantity", "unit"),
    f"""with {_PARTS} select file_id, '430-175-1' || sz as pay_item_no, 'PIPE CULVERT, ROUND ' || sz || '"' as description, cast(n as double) as quantity, 'LF' as unit from parts""",
)

_WORDING = (
    ("TYPE D INLET (MODIFIED)", "425-1-549", 5800.0, 0.95), ("TYPE E INLET", "425-1-551", 4000.0, 0.95), ("MANHOLE, TYPE 7 STRUCTURE", "425-2-41", 5500.0, 0.95), ("INLET #35", "425-1-541", 4200.0, 0.70),
    ("JUNCTION BOX", "425-3-11", 3800.0, 0.95), ("CURB INLET TYPE 9", "425-1-901", 5500.0, 0.95), ("MH 12", "425-2-41", 5500.0, 0.70), ("CATCH BASIN", "425-4-11", 3500.0, 0.95),
)
register(
    "structure_match",
    lambda s, d: _parts(s, d).select("p_partkey", structures.structure_of(_pick([w[0] for w in _WORDING], c("p_partkey"))).alias("x")).select("p_partkey", "x.fdot_code", "x.unit_price", "x.confidence"),
    f"select p_partkey, {_sql_pick([w[1] for w in _WORDING], 'p_partkey')} as fdot_code, cast({_sql_pick([w[2] for w in _WORDING], 'p_partkey')} as double) as unit_price, cast({_sql_pick([w[3] for w in _WORDING], 'p_partkey')} as double) as confidence from part",
)
_CLASSES = ("III", "IV", "V")


def _pipe_catalog(s: SparkSession) -> DataFrame:
    rows = [(k, f"RCP_{z}_{cl}", "RCP_Price_List", "Round RCP", f'{z}"', f"CL {cl}", float(z), "LF", "ASTM C-76", "") for k, (z, cl) in enumerate((z, cl) for z in rules.PIPE_SIZES for cl in _CLASSES)]
    return s.createDataFrame(rows, "row_no long, id string, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string, notes string")


register(
    "product_matches",
    lambda s, d: products.product_matches(_parts(s, d).select("file_id", cat(c("sz"), '" RCP CLASS ', _pick(_CLASSES, c("p_partkey")), " - ", c("n") + 100, " LF").alias("text")), C.with_patterns(C.with_keywords(_pipe_catalog(s))), ["file_id"]).select("file_id", "size", "configuration", "quantity", "unit"),
    f"""with {_PARTS} select file_id, sz || '"' as size, 'CL ' || {_sql_pick(_CLASSES, 'p_partkey')} as configuration, cast(n + 100 as double) as quantity, 'LF' as unit from parts""",
)

# Text functions.
register("parse_number", lambda s, d: _parts(s, d).select("p_partkey", T.parse_number(F.when(c("p_partkey") % 3 == 0, c("p_name")).otherwise(cat(c("p_partkey"), ",500"))).alias("number")), "select p_partkey, case when p_partkey % 3 = 0 then 0.0 else cast(p_partkey || '500' as double) end as number from part")
register("parse_price", lambda s, d: _parts(s, d).select("p_partkey", T.parse_price(F.when(c("p_partkey") % 3 == 0, F.lit("call")).otherwise(cat("$1,", c("p_size") + 100, ".50"))).alias("price")), "select p_partkey, case when p_partkey % 3 = 0 then 0.0 else 1000 + p_size + 100 + 0.5 end::double as price from part")
register("normalize_size", lambda s, d: _parts(s, d).select("p_partkey", T.size_key(cat(c("p_size"), '" x ', c("sz"))).alias("size_key"), T.size_inches(cat(c("p_size"), '"X', c("sz"))).alias("size_inches")), f"""with {_PARTS} select p_partkey, p_size || 'X' || sz as size_key, p_size || '"' as size_inches from parts""")
register(
    "tokenize_terms",
    lambda s, d: _parts(s, d).select("p_partkey", F.explode(T.tokens(F.concat_ws(" ", "p_name", F.lit("and the RCP pipes of"), "p_type"))).alias("token")),
    "select distinct p_partkey, t as token from (select p_partkey, unnest(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '), ['pipe'])) as t from part) where length(t) > 1",
)
register("project_name", lambda s, d: _table(s, d, "orders").select("o_orderkey", T.project_of(cat("job", c("o_custkey"), F.when(c("o_orderkey") % 2 == 0, "_part").otherwise("-x"), "1.pdf")).alias("project")), "select o_orderkey, case when o_orderkey % 2 = 0 then 'job' || o_custkey else 'job' || o_custkey || '-x1' end as project from orders")
register("clean_ocr", lambda s, d: _parts(s, d).select("p_partkey", T.clean_ocr(cat("Iniet tipe D, ", c("sz"), ' RGP, manhoi3 #', c("p_partkey"), " ex1sting condu1t")).alias("text")), f"""with {_PARTS} select p_partkey, 'INLET TYPE D, ' || sz || '" RCP, MANHOLE #' || p_partkey || ' EXISTING CONDUIT' as text from parts""")
register("size_swap", lambda s, d: base(s, d).select(T.swap_size_quantity(c("q"), c("sz").cast("double")).alias("x")).groupBy("x.size", "x.quantity").count().withColumnRenamed("count", "n"), f"with {BASE} select case when q in {rules.PIPE_SIZES} then q else sz end as size, cast(case when q in {rules.PIPE_SIZES} then sz else q end as double) as quantity, count(*) as n from base group by all")
register("membrane", lambda s, d: _parts(s, d).select("p_partkey", T.is_membrane(F.when(c("p_partkey") % 4 == 0, cat(c("p_size"), " MIL PVC")).when(c("p_partkey") % 4 == 1, F.lit("liner fabric")).when(c("p_partkey") % 4 == 2, F.lit("fabric")).otherwise(F.lit('30" RCP')), F.lit(18)).alias("membrane")), "select p_partkey, p_partkey % 4 < 2 as membrane from part")

# Gates.
_MIN, _MAX, _TYP = ([rules.QUANTITY_LIMITS[u][k] for u in UNITS] for k in range(3))


def _gated(s: SparkSession, d: str) -> DataFrame:
    b = base(s, d)
    return b.select("file_id", "ln", "pk", c("u").alias("unit"), (c("q") * 250).cast("double").alias("quantity"), F.when(c("pk") % 10 == 0, "12-3").when(c("pk") % 10 == 1, "ea").otherwise(cat(c("sz") + F.when(c("pk") % 10 == 2, 100).otherwise(0), '" ', c("mat"), " PIPE")).alias("description"), F.lit(None).cast("double").alias("unit_price"), F.lit(None).cast("double").alias("line_cost"))


register(
    "quantity_gate",
    lambda s, d: _gated(s, d).select("unit", "quantity", F.coalesce(F.get(G.quantity_warnings(c("quantity"), c("unit")), F.lit(0))["severity"], F.lit("ok")).alias("outcome")).groupBy("unit", "outcome").agg(F.count(F.lit(1)).alias("n")),
    f"""with {BASE}, x as (select u, cast(q * 250 as double) as v, {_sql_pick(_MIN, 'pk')} as lo, {_sql_pick(_MAX, 'pk')} as hi, {_sql_pick(_TYP, 'pk')} as typ from base)
    select u as unit, case when v < lo or v > hi then 'reject' when v in {rules.ROUND_QUANTITIES} or v > typ then 'warning' else 'ok' end as outcome, count(*) as n from x group by all""",
)
register("description_gate", lambda s, d: _gated(s, d).select("description", F.coalesce(G.description_fault(c("description")), F.lit("ok")).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n")), f"with {BASE} select case pk % 10 when 0 then 'numeric' when 1 then 'short' else 'ok' end as fault, count(*) as n from base group by all")
register(
    "gate_report",
    lambda s, d: G.gate_report(_gated(s, d), "unit"),
    f"""with {BASE}, x as (select *, cast(q * 250 as double) as v, {_sql_pick(_MIN, 'pk')} as lo, {_sql_pick(_MAX, 'pk')} as hi, {_sql_pick(_TYP, 'pk')} as typ from base),
    y as (select u, pk % 10 < 2 or v < lo or v > hi or pk % 10 = 2 as bad, pk % 10 >= 2 and v >= lo and v <= hi and (v in {rules.ROUND_QUANTITIES} or v > typ) as warned, pk % 10 >= 2 and v >= lo and v <= hi and pk % 10 = 2 and sz + 100 <= 96 as odd from x)
    select u as unit, count(*) as n_items, count(*) filter (not bad) as n_passed, count(*) filter (bad) as n_rejected, count(*) filter (warned) + count(*) filter (odd) as n_warnings from y group by u""",
)
register(
    "price_gate",
    lambda s, d: base(s, d).select("u", F.size(G.price_warnings(c("p_retailprice"), c("l_extendedprice") * 20, c("u"))).alias("n_warnings")).groupBy("u", "n_warnings").agg(F.count(F.lit(1)).alias("n")),
    f"""with {BASE} select u, cast(case when l_extendedprice * 20 > 1000000 then 1 else 0 end + case when p_retailprice < 0.01 and p_retailprice <> 0 then 1 else 0 end +
    case when (u = 'LF' and p_retailprice > 1000) or (u = 'EA' and p_retailprice > 100000) or (u in ('SY', 'SF') and p_retailprice > 500) then 1 else 0 end as int) as n_warnings, count(*) as n from base group by all""",
)
register(
    "rule_duplicates",
    lambda s, d: G.rule_issues(base(s, d).groupBy("file_id", c("ln").alias("item_no")).agg(F.max("q").cast("double").alias("quantity"), F.max("mat").alias("description")).withColumn("unit", F.lit("LF"))).select("file_id", "item_no", F.array_contains("issues", "duplicate").alias("duplicate")),
    f"""with {BASE}, i as (select file_id, ln as item_no, max(q) as quantity, max(mat) as description from base group by all)
    select file_id, item_no, count(*) over (partition by file_id) >= 3 and row_number() over (partition by file_id, description, quantity order by item_no) > 1 as duplicate from i""",
)


# Prices.
def _items_by_code(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).select(F.concat_ws("-", c("file_id").cast("string"), c("ln").cast("string"), c("pk").cast("string"), c("sk").cast("string"), c("q").cast("string")).alias("item_no"), cat("430-", c("pk"), "-1", c("sz")).alias("pay_item_no"), cat(c("sz"), '" RCP PIPE').alias("description"), c("q").cast("double").alias("quantity"), "p_brand").dropDuplicates(["item_no"])


def _part_catalog(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select(c("p_partkey").alias("row_no"), F.lit("End_Sections").alias("category"), c("p_name").alias("product_type"), cat(c("sz"), '"').alias("size"), c("p_type").alias("configuration"), c("p_retailprice").alias("price"), F.lit("EA").alias("unit"), cat("FDOT 430-", c("p_partkey")).alias("fdot_code"))


register(
    "price_by_code",
    lambda s, d: pricing.priced(_items_by_code(s, d), _part_catalog(s, d)).groupBy("p_brand", "matched", "match_source").agg(F.round(F.sum("line_cost"), 2).alias("line_cost"), F.count(F.lit(1)).alias("n")),
    f"with {BASE}, i as (select distinct file_id, ln, pk, sk, q, p_brand, p_retailprice from base) select p_brand, true as matched, 'code' as match_source, round(sum(q * p_retailprice), 2) as line_cost, count(*) as n from i group by p_brand",
)
register(
    "price_by_family",
    lambda s, d: pricing.by_family(_parts(s, d).select("p_partkey", cat(c("sz"), '" RCP CULVERT').alias("description"), cat(c("sz"), '"').alias("size_of_item")), pricing.with_fdot(_pipe_catalog(s).withColumn("product_type", F.lit("Round Pipe"))), "p_partkey").select("p_partkey", "product.size", "product.configuration", "product.price"),
    f"""with {_PARTS} select p_partkey, sz || '"' as size, 'CL III' as configuration, cast(sz as double) as price from parts""",
)
register(
    "price_fuzzy",
    lambda s, d: pricing.by_tokens(_table(s, d, "part").select("p_name").distinct().select(c("p_name").alias("item_no"), c("p_name").alias("description"), F.lit("").alias("size_of_item")), pricing.with_fdot(_part_catalog(s, d)), "item_no").select(c("item_no").alias("p_name"), c("product.fdot_code").alias("fdot_code")),
    """with t as (select p_partkey, list_distinct(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) as w from part),
    i as (select distinct p_name, list_distinct(string_split(lower(p_name), ' ')) as w from part),
    s as (select p_name, p_partkey, len(list_intersect(i.w, t.w)) * 60.0 / greatest(len(i.w), len(t.w)) / 100 as score from i cross join t)
    select p_name, 'FDOT 430-' || p_partkey as fdot_code from s where score >= 0.4 qualify row_number() over (partition by p_name order by score desc, p_partkey) = 1""",
)


# Roll-ups.
def _rolled(s: SparkSession, d: str) -> DataFrame:
    b = base(s, d)
    kind = _pick(("INLET TYPE D", "MANHOLE", "CATCH BASIN", "ENDWALL", "SIGN POST", "PIPE"), c("pk"))
    return b.select(
        "file_id", "ln", "pk", cat(kind, " ", c("sz"), '"').alias("description"), F.when(c("pk") % 6 == 5, "LF").otherwise("EA").alias("unit"), c("q").cast("double").alias("quantity"), _pick(("425-1-541", "425-2-41", "999-1", "430-030", "700-1", "430-175-118"), c("pk")).alias("pay_item_no"),
        _pick(("fdot", "product_first", "table"), c("ln")).alias("source"), (c("q") % 2 == 0).alias("matched"), F.when(c("q") % 2 == 0, c("p_retailprice")).alias("unit_price"), F.when(c("q") % 2 == 0, c("q") * c("p_retailprice")).alias("line_cost"),
        (c("q") / 50).alias("confidence_score"), (c("pk") % 7 == 0).alias("needs_verification"), _pick(("high", "medium", "low"), c("ln")).alias("confidence"), F.lit("rules").alias("match_source"),
    )


_ROLLED = f"""{BASE}, r as (select *, {_sql_pick(('INLET TYPE D', 'MANHOLE', 'CATCH BASIN', 'ENDWALL', 'SIGN POST', 'PIPE'), 'pk')} || ' ' || sz || '"' as description, case when pk % 6 = 5 then 'LF' else 'EA' end as unit,
  {_sql_pick(('fdot', 'product_first', 'table'), 'ln')} as source, q % 2 = 0 as matched, case when q % 2 = 0 then q * p_retailprice end as line_cost, q / 50 as score, pk % 7 = 0 as needs_verification, {_sql_pick(('high', 'medium', 'low'), 'ln')} as confidence from base)"""
register("material_summary_structure", lambda s, d: rollup.material_structures(_rolled(s, d)), f"with {_ROLLED} select {_sql_pick(('INLET', 'MANHOLE', 'CATCH BASIN', 'ENDWALL', 'OTHER', ''), 'pk')} as structure_type, cast(sum(q) as bigint) as n_structures from r where pk % 6 < 5 group by all")
register("material_totals", lambda s, d: rollup.material_totals(_rolled(s, d)), f"with {_ROLLED} select cast(sum(q) filter (pk % 6 = 5) as double) as total_pipe_lf, count(distinct sz) filter (pk % 6 = 5) as total_pipe_sizes, cast(sum(q) filter (pk % 6 < 5) as bigint) as total_structures, count(distinct pk % 6) filter (pk % 6 < 5) as total_structure_types from r")
register(
    "takeoff_report",
    lambda s, d: rollup.takeoff_report(_rolled(s, d)).select("total_items", "matched_items", "estimated_total", "drainage_items", "drainage_matched", "non_drainage_items", "high_confidence_count", "medium_confidence_count", "needs_review_count", "product_first_count", "regex_fallback_count"),
    f"""with {_ROLLED}, x as (select *, source = 'product_first' or pk % 6 <> 4 as dr from r)
    select count(*) as total_items, count(*) filter (matched) as matched_items, round(sum(line_cost), 2) as estimated_total, count(*) filter (dr) as drainage_items, count(*) filter (dr and matched) as drainage_matched, count(*) filter (not dr) as non_drainage_items,
    count(*) filter (score >= 0.85) as high_confidence_count, count(*) filter (score >= 0.6 and score < 0.85) as medium_confidence_count, count(*) filter (score < 0.6 or needs_verification) as needs_review_count,
    count(*) filter (source = 'product_first') as product_first_count, count(*) filter (source <> 'product_first') as regex_fallback_count from x""",
)
register(
    "categorize",
    lambda s, d: rollup.categorized(_rolled(s, d), "file_id").groupBy("type", "size").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n")),
    f"""with {_ROLLED} select case pk % 6 when 0 then 'Inlet' when 1 then 'Manhole' when 3 then 'Endwall' else 'Pipe' end as type, case pk % 6 when 0 then 'Type D' when 1 then 'Standard' else sz || '"' end as size,
    cast(sum(q) as double) as quantity, count(*) as n from r where pk % 6 not in (2, 4) group by all""",
)
register("file_results", lambda s, d: rollup.file_results(_rolled(s, d), _table(s, d, "orders").select(c("o_orderkey").alias("file_id"))).select("file_id", "n_items", "n_matched", "n_rules", F.round("total_cost", 2).alias("total_cost")), f"with {_ROLLED} select o_orderkey as file_id, count(r.file_id) as n_items, count(*) filter (r.matched) as n_matched, count(*) filter (r.matched) as n_rules, coalesce(round(sum(line_cost), 2), 0) as total_cost from orders left join r on o_orderkey = r.file_id group by o_orderkey")
register(
    "batch_summary",
    lambda s, d: rollup.batch_summary(rollup.file_results(_rolled(s, d), _table(s, d, "orders").select(c("o_orderkey").alias("file_id"), (c("o_orderstatus") != "F").alias("success")))).withColumn("total_estimate", F.round("total_estimate", 2)),
    f"with {_ROLLED} select (select count(*) from orders) as n_files, (select count(*) from orders where o_orderstatus <> 'F') as n_ok, (select count(*) from orders where o_orderstatus = 'F') as n_failed, count(*) as n_items, count(*) filter (matched) as n_matched, round(sum(line_cost), 2) as total_estimate from r where file_id in (select o_orderkey from orders)",
)
register("csv_projection", lambda s, d: rollup.csv_rows(_rolled(s, d).withColumn("page", F.lit(1)).withColumn("ai_match_reason", F.lit(None).cast("string")).withColumn("confidence_score", F.lit(None).cast("double"))).groupBy(c("Confidence Score").alias("score"), c("Needs Review").alias("review"), c("Matched").alias("matched")).agg(F.count(F.lit(1)).alias("n")), f"with {_ROLLED} select {_sql_pick(('0.90', '0.75', '0.40'), 'ln')} as score, case when ln % 3 = 2 or needs_verification then 'Yes' else '' end as review, case when matched then 'Yes' else 'No' end as matched, count(*) as n from r group by all")
register(
    "review_queue",
    lambda s, d: review.review_queue(_rolled(s, d).select("*", F.lit(1).alias("page"), F.lit(None).cast("array<array<double>>").alias("bbox"), F.lit(None).cast("string").alias("text_context"), (c("pk") % 10 / 10).alias("ocr_confidence"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    f"""with {_ROLLED}, x as (select concat_ws(', ', case when confidence = 'low' then 'low confidence extraction' end, case when pk % 10 < 6 then 'low OCR confidence (0.' || pk % 10 || '0)' end, case when needs_verification then 'flagged for verification' end) as reason from r) select reason, count(*) as n from x where reason <> '' group by reason""",
)


# The whole take-off.
_FULL_CATALOG = ((0, "A", "RCP_Price_List", "Round RCP", "", "CL III", 7.5, "LF", "FDOT 430-175"), (1, "B", "RCP_Price_List", "Round RCP", "", "CL V", 11.25, "LF", "430-984"))


def full_pages(s: SparkSession, d: str) -> DataFrame:
    """Files of four pages: items and labels, the same items again with labels of pipes, and a summary sheet twice."""
    b = base(s, d)
    first = cat(_code(), " PIPE CULVERT LF ", c("q"), "\nINLET #", c("pk") % 5)
    second = cat(_code(), " PIPE CULVERT LF ", c("q"), "\nINLET #", c("pk") % 5 + 3, "\nHDPE ", c("sz"), " ;")
    sheet = cat("430-984-1", c("sz"), "\nPIPE CULVERT\n", c("q"), "\nLF")
    # The lines are joined and gathered once for all pages of a file.
    files = b.groupBy("file_id").agg(F.collect_list(F.struct("ln", "pk", "sk", first.alias("l1"), second.alias("l2"), sheet.alias("l3"))).alias("x"))
    text = lambda l: F.array_join(F.transform(F.array_sort(F.transform("x", lambda x: F.struct(x["ln"], x["pk"], x["sk"], x[l].alias("l")))), lambda x: x["l"]), "\n")
    pages = F.array(*[F.struct(F.lit(n).alias("page_num"), t.alias("text")) for n, t in ((1, text("l1")), (2, text("l2")))])
    sheets = F.transform(F.array(F.concat(F.lit(_HEAD), text("l3"))), lambda t: F.array(*[F.struct(F.lit(n).alias("page_num"), t.alias("text")) for n in (3, 4)]))
    return files.select("file_id", F.explode(F.concat(pages, F.get(sheets, F.lit(0)))).alias("p")).select("file_id", "p.text", "p.page_num")


def _full(s: SparkSession, d: str):
    catalog = s.createDataFrame(list(_FULL_CATALOG), "row_no long, id string, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string")
    return takeoff.analyze(full_pages(s, d), catalog, use_product_first=False)


_FULL = f"""{BASE}, full_items as (
  select distinct file_id, '430-175-1' || sz as pay_item_no, 'LF' as unit, cast(q as double) as quantity, 'fdot' as source, 7.5::double as unit_price from base
  union all select file_id, 'INLET', 'EA', 1.0::double, 'drainage_label', 4200.0::double from (select distinct file_id, pk % 5 + k.k * 3 as no from base, range(2) k(k))
  union all select distinct file_id, '430-984-1' || sz, 'LF', cast(q as double), 'summary', 11.25::double from base)"""
register("takeoff_full", lambda s, d: _full(s, d).items.select("file_id", "pay_item_no", "unit", "quantity", "source", "unit_price", F.round("line_cost", 2).alias("line_cost")), f"with {_FULL} select *, round(quantity * unit_price, 2) as line_cost from full_items")
register(
    "takeoff_full_report",
    lambda s, d: _full(s, d).report.select("file_id", "total_items", "matched_items", F.round("estimated_total", 2).alias("estimated_total")),
    f"with {_FULL} select file_id, count(*) as total_items, count(*) as matched_items, round(sum(quantity * unit_price), 2) as estimated_total from full_items group by file_id",
)


def _cascade(s: SparkSession, d: str) -> DataFrame:
    """Parts as items that end at one stage of the cascade each."""
    k = c("p_partkey")
    code = F.when(k % 5 == 0, cat("430-", k)).when(k % 5 == 1, cat("430-", k, "-9-1")).otherwise(cat("X-", k))
    text = F.when(k % 5 == 2, cat(c("sz"), '" RCP CULVERT')).when(k % 5 == 3, "TYPE E INLET").when(k % 5 == 4, "SIGN POST").otherwise("GOODS")
    items = _parts(s, d).select(k.alias("item_no"), code.alias("pay_item_no"), text.alias("description"), c("n").cast("double").alias("quantity"))
    pipes = _pipe_catalog(s).withColumn("product_type", F.lit("Round Pipe")).drop("id", "notes").withColumn("row_no", c("row_no") + 1_000_000_000)
    return pricing.priced(items, _part_catalog(s, d).filter(c("row_no") % 5 < 2).withColumn("product_type", F.lit("Goods of all kinds")).unionByName(pipes)).select("item_no", "matched", "match_source", "unit_price", F.round("line_cost", 2).alias("line_cost"))


register(
    "price_cascade",
    _cascade,
    f"""with {_PARTS}, x as (select p_partkey as item_no, p_partkey % 5 < 4 as matched, case p_partkey % 5 when 2 then 'family' when 3 then 'structure' when 4 then null else 'code' end as match_source,
    case p_partkey % 5 when 2 then cast(sz as double) when 3 then 4000.0 when 4 then null else p_retailprice end as unit_price, n from parts)
    select item_no, matched, match_source, cast(unit_price as double) as unit_price, round(unit_price * n, 2) as line_cost from x""",
)


# Pages.
def _pages(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", c("source").alias("file_id"), (c("doc_id") % 8 + 1).cast("int").alias("page_num"), "text", (c("n_chars") % 100 / 100).alias("confidence"), (c("doc_id") % 9).cast("int").alias("block_count"))


def _hits(words) -> str:
    return "len(list_filter([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "], lambda k: contains({}, k)))"


_CLASS = f"""with h as (select doc_id, doc_id % 8 + 1 as p, {', '.join(_hits(w).format('lower(text)') + ' as ' + n for n, w in (('su', rules.SUMMARY_WORDS), ('ti', rules.TITLE_WORDS), ('tc', rules.TOC_WORDS), ('no', rules.NOTES_WORDS), ('pa', rules.PAYLOAD_WORDS)))} from documents)
select doc_id, case when su > 0 then 'summary' when ti > 0 and p <= 2 then 'title' when tc > 0 and p <= 5 then 'toc' when no > 0 and p <= 6 then 'notes' when pa > 0 then 'payload' when p = 1 then 'title' when p = 2 then 'toc' else 'payload' end as page_type,
round(cast(case when su > 0 then least(0.98, 0.7 + 0.1 * su) when ti > 0 and p <= 2 then least(0.9, 0.5 + 0.1 * ti) when tc > 0 and p <= 5 then least(0.9, 0.5 + 0.15 * tc) when no > 0 and p <= 6 then least(0.85, 0.4 + 0.1 * no) when pa > 0 then least(0.95, 0.6 + 0.05 * pa) when p = 1 then 0.4 when p = 2 then 0.3 else 0.5 end as double), 6) as confidence from h"""
register("page_class", lambda s, d: _pages(s, d).select("doc_id", P.page_class(c("text"), c("page_num")).alias("x")).select("doc_id", "x.page_type", F.round("x.confidence", 6).alias("confidence")), _CLASS)
register(
    "page_quality",
    lambda s, d: _pages(s, d).select("doc_id", P.page_quality(c("text")).alias("x")).select("doc_id", "x.product_keywords_found", "x.complete_items_found", "x.has_pipe_schedule", "x.has_complex_tables"),
    f"select doc_id, cast({' + '.join(f"len(regexp_extract_all(upper(text), '{p}'))" for p in P._COMPLETE)} as int) as complete_items_found, cast({_hits(P.PRODUCT_WORDS).format('upper(text)')} as int) as product_keywords_found, {_hits(P.SCHEDULE_WORDS).format('upper(text)')} >= 2 as has_pipe_schedule, {_hits(P.SCHEDULE_WORDS).format('upper(text)')} >= 2 or {_hits(P.ANNOTATION_WORDS).format('upper(text)')} > 0 as has_complex_tables from documents",
)
register("page_flags", lambda s, d: P.flagged(_pages(s, d)).groupBy("flagged", "quality.needs_vision").agg(F.count(F.lit(1)).alias("n")))
register(
    "page_rollup",
    lambda s, d: P.class_rollup(P.classified(_pages(s, d), page_col="page_num"), "file_id").select("file_id", "n_pages", "n_read", "n_skipped", "n_summary", F.array_join(F.array_distinct(F.transform("summary_pages", lambda p: p.cast("string"))), ",").alias("summary_pages")),
    f"""with c as ({_CLASS}), j as (select source as file_id, doc_id % 8 + 1 as p, c.page_type, c.confidence, count(*) over (partition by source) as n from c join documents using (doc_id)),
    k as (select file_id, p, case when n <= 3 then 'payload' else page_type end as t, case when n <= 3 then 1.0 else confidence end as f from j)
    select file_id, count(*) as n_pages, count(*) filter (not (t in ('title', 'toc', 'notes') and f > 0.7)) as n_read, count(*) filter (t in ('title', 'toc', 'notes') and f > 0.7) as n_skipped, count(*) filter (t = 'summary') as n_summary,
    coalesce(string_agg(distinct cast(p as varchar), ',' order by cast(p as varchar)) filter (t = 'summary'), '') as summary_pages from k group by file_id""",
)
register("page_should_read", lambda s, d: P.classified(_pages(s, d), page_col="page_num").select("doc_id", "page_type", "should_ocr"), f"with c as ({_CLASS}), j as (select doc_id, c.page_type, c.confidence, count(*) over (partition by source) as n from c join documents using (doc_id)) select doc_id, case when n <= 3 then 'payload' else page_type end as page_type, n <= 3 or not (page_type in ('title', 'toc', 'notes') and confidence > 0.7) as should_ocr from j")
register("vision_budget_topk", lambda s, d: P.within_budget(_pages(s, d).filter("confidence < 0.65"), 5, page_col="doc_id").select("file_id", "doc_id", "confidence"), "select source as file_id, doc_id, n_chars % 100 / 100 as confidence from documents where n_chars % 100 / 100 < 0.65 qualify row_number() over (partition by source order by n_chars % 100, doc_id) <= 5")
register(
    "page_override",
    lambda s, d: P.overridden(_pages(s, d).select("doc_id", "file_id", "text"), _pages(s, d).filter("doc_id % 5 = 0").select("doc_id", "file_id", cat("VISION ", c("doc_id")).alias("text")), page_col="doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")),
    "with t as (select doc_id, case when doc_id % 5 = 0 then 'VISION ' || doc_id else regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') end as text from documents) select doc_id, length(text) as n_chars, sha256(text) as text_sha256 from t",
)


# Layout, geometry, files, mail.
def _blocks(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).select("file_id", c("pk").cast("int").alias("block_no"), c("pk").cast("string").alias("text"), (c("ln") * 30).cast("double").alias("y_center"), c("pk").cast("double").alias("x_center"), (c("q") / 50).alias("confidence"))


register("line_assembly", lambda s, d: layout.lines(_blocks(s, d), ["file_id"]), f"with {BASE} select file_id, cast(dense_rank() over (partition by file_id order by ln) - 1 as int) as line_no, string_agg(cast(pk as varchar), ' ' order by pk) as text from base group by file_id, ln")
register(
    "table_islands",
    lambda s, d: layout.tables(page_of(base(s, d), F.when(c("pk") % 5 == 0, "NOTE").otherwise(cat(_code(), "  LF  ", c("q")))), ["file_id"]).select("file_id", "table_no", F.size("rows").alias("n_rows")),
    f"""with {BASE}, o as (select file_id, pk % 5 = 0 as note, row_number() over (partition by file_id order by ln, pk, sk, case when pk % 5 = 0 then 'NOTE' else '430-175-1' || sz || '  LF  ' || q end) as i from base),
    g as (select file_id, i, i - row_number() over (partition by file_id order by i) as run from o where not note), t as (select file_id, min(i) as f, count(*) as n from g group by file_id, run having count(*) >= 2)
    select file_id, cast(row_number() over (partition by file_id order by f) as int) as table_no, cast(n as int) as n_rows from t""",
)
register("page_confidence", lambda s, d: layout.page_confidence(_blocks(s, d), _table(s, d, "orders").select(c("o_orderkey").alias("file_id")), ["file_id"]).select("file_id", F.round("confidence", 6).alias("confidence")), f"with {BASE} select o_orderkey as file_id, coalesce(round(avg(q / 50), 6), 0) as confidence from orders left join base on file_id = o_orderkey group by o_orderkey")
_box = lambda: geometry.box(c("pk").cast("double"), c("q").cast("double"), (c("pk") + c("sz")).cast("double"), (c("q") + 10).cast("double"))
register("bbox_expand", lambda s, d: base(s, d).select(geometry.expanded(_box()).alias("b")).select(c("b")[0][0].alias("x1"), c("b")[0][1].alias("y1"), c("b")[2][0].alias("x2"), c("b")[2][1].alias("y2")).groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")), f"with {BASE} select cast(pk - sz * 0.25 as double) as x1, cast(q - 2.5 as double) as y1, cast(pk + sz * 1.25 as double) as x2, cast(q + 12.5 as double) as y2, count(*) as n from base group by all")
register("bbox_merge", lambda s, d: geometry.merged_boxes(base(s, d).select("file_id", c("pk").alias("block_no"), _box().alias("bbox")).dropDuplicates(["file_id", "block_no"]), ["file_id"]).select("file_id", "cluster_no", "n_boxes"))
register(
    "split_plan",
    lambda s, d: files.split_plan(_table(s, d, "orders").select(c("o_orderkey").alias("file_id"), (c("o_totalprice") / 10000).alias("mb"), (c("o_orderkey") % 400 + 1).alias("n_pages"))),
    """with f as (select o_orderkey as file_id, o_totalprice / 10000 as mb, o_orderkey % 400 + 1 as p from orders), n as (select *, greatest(ceil(mb / 25), ceil(p / 90), 1) as k, mb > 25 or p > 90 as split from f),
    z as (select *, cast(case when split then least(ceil(p / k), 90) else p end as int) as size from n), e as (select *, unnest(range(0, cast(ceil(p / size) as int))) as part from z)
    select file_id, cast(part as int) as part_no, cast(part * size + 1 as int) as first_page, cast(least((part + 1) * size, p) as int) as last_page from e""",
)
register("sender_acl", lambda s, d: _table(s, d, "customer").select("c_custkey", mail.sender_allowed(cat("Name <user", c("c_custkey"), "@", _pick(("a.com", "b.org", "c.net"), c("c_custkey")), ">"), ["user7@b.org", "user5@*", "*@A.com"], []).alias("allowed")), "select c_custkey, c_custkey % 3 = 0 or c_custkey = 5 or (c_custkey = 7 and c_custkey % 3 = 1) as allowed from customer")
register("link_extract", lambda s, d: _table(s, d, "pages").select("page_id", F.explode(mail.cloud_links(cat("see https://drive.google.com/f/", c("page_id"), " or http://x.org and https://we.tl/", c("page_id") % 7, " https://we.tl/", c("page_id") % 7))).alias("link")), "select page_id, 'https://drive.google.com/f/' || page_id as link from pages union all select page_id, 'https://we.tl/' || page_id % 7 from pages")
register(
    "rate_limit_fold",
    lambda s, d: mail.rate_limited(_table(s, d, "events").select("event_id", "ts", "user_id"), "user_id", "ts", ["event_id"], 2, 20).select("event_id", "user_id", "allowed"),
    """with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
  fold as (
    select event_id, user_id, n, true as allowed, [us] as taken from e where n = 1
    union all
    select event_id, user_id, n, ok, case when ok then list_append(held, us) else held end from (
      select x.*, len(held) < 20 and len(list_filter(held, lambda t: t > us - 3600000000)) < 2 as ok
      from (select e.*, list_filter(f.taken, lambda t: t > e.us - 86400000000) as held from fold f join e on e.user_id = f.user_id and e.n = f.n + 1) x)
  ) select event_id, user_id, allowed from fold""",
)
register("mail_totals", lambda s, d: rollup.job_totals(rollup.file_results(_rolled(s, d), _table(s, d, "orders").select(c("o_orderkey").alias("file_id"), c("o_custkey").alias("message_id"), (c("o_orderstatus") != "F").alias("success")))).select("message_id", "n_files", "n_ok", "n_items", "status"), f"with {_ROLLED}, f as (select o_custkey as message_id, o_orderstatus <> 'F' as ok, (select count(*) from r where file_id = o_orderkey) as n from orders) select message_id, count(*) as n_files, count(*) filter (ok) as n_ok, cast(sum(n) as bigint) as n_items, case when bool_and(ok) then 'success' when bool_or(ok) then 'partial' else 'failed' end as status from f group by message_id")
register(
    "messy_materials",
    lambda s, d: messy.messy_materials(page_of(base(s, d), cat(c("sz"), F.when(c("pk") % 2 == 0, ' ROP ; ').otherwise(" pvc ; "), "manhoi3 #", c("q"), " ;")), ["file_id"]).select("file_id", "type", "size", "material", "id"),
    f"""with {BASE} select distinct file_id, 'pipe' as type, sz || '"' as size, case when pk % 2 = 0 then 'RCP' else 'PVC' end as material, cast(null as varchar) as id from base
    union all select distinct file_id, 'manhole', null, null, cast(q as varchar) from base""",
)
register(
    "nearby_items",
    lambda s, d: messy.nearby_items(messy.code_lines(_parts(s, d).select("file_id", cat("999-1 BASE WORK\n", c("n"), " SY\n", c("n") + 1000).alias("text")), ["file_id"]), ["file_id"]).select("file_id", "pay_item_no", "description", "quantity", "unit"),
    f"with {_PARTS} select file_id, '999-1' as pay_item_no, 'BASE WORK' as description, cast(n + 1000 as double) as quantity, 'SY' as unit from parts",
)


# Control flow and small projections.
def _files(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").select(c("o_orderkey").alias("file_id"), (c("o_totalprice") / 10000).alias("mb"), (c("o_orderkey") % 400 + 1).alias("n_pages"), "o_custkey", "o_orderstatus")


_FILES = "files as (select o_orderkey as file_id, o_totalprice / 10000 as mb, o_orderkey % 400 + 1 as n_pages, o_custkey, o_orderstatus from orders)"
register(
    "split_stats",
    lambda s, d: flow.split_stats(base(s, d).groupBy("file_id", c("ln").alias("part_no")).agg(F.sum("q").cast("double").alias("mb"), F.max("pk").alias("n_pages")), "file_id").select("file_id", "n_parts", "total_mb", "total_pages", F.get("parts", F.lit(0))["mb"].alias("first_mb")),
    f"with {BASE}, p as (select file_id, ln, cast(sum(q) as double) as mb, max(pk) as n from base group by all) select file_id, count(*) as n_parts, sum(mb) as total_mb, cast(sum(n) as bigint) as total_pages, min_by(mb, ln) as first_mb from p group by file_id",
)
register(
    "split_files",
    lambda s, d: flow.split_files(_files(s, d), files.split_plan(_files(s, d).filter("file_id % 7 <> 0"))).groupBy("original_file", "route").agg(F.count(F.lit(1)).alias("n"), F.max("last_page").cast("long").alias("last_page")),
    f"""with {_FILES}, k as (select *, greatest(ceil(mb / 25), ceil(n_pages / 90), 1) as k, mb > 25 or n_pages > 90 as large from files), z as (select *, least(ceil(n_pages / k), 90) as size from k)
    select file_id as original_file, case when large and file_id % 7 = 0 then 'skip' else 'extract' end as route, cast(case when large and file_id % 7 <> 0 then ceil(n_pages / size) else 1 end as bigint) as n, cast(n_pages as bigint) as last_page from z""",
)
_selected = lambda s, d, known: flow.selected_pages(_files(s, d).filter(known).select("file_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_num")), _files(s, d).select("file_id", (c("file_id") % 6 + 1).cast("int").alias("page_num")))
register(
    "vision_selected_errors",
    lambda s, d: _selected(s, d, "file_id % 2 = 0")[1],
    f"with {_FILES}, w as (select file_id, cast(file_id % 6 + 1 as int) as page_num, file_id % 2 = 0 as known from files) select file_id, page_num, 'Page ' || page_num || ' out of range (document has ' || case when known then 3 else 0 end || ' pages)' as error from w where not known or page_num > 3",
)
register("vision_selected_pages", lambda s, d: _selected(s, d, "true")[0], f"with {_FILES} select file_id, cast(file_id % 6 + 1 as int) as page_num from files where file_id % 6 < 3")
register(
    "page_placeholders",
    lambda s, d: flow.with_placeholders(_pages(s, d).filter("doc_id % 3 = 0").select("file_id", c("doc_id").alias("page_num"), "text", "confidence"), P.classified(_pages(s, d)).select("file_id", c("doc_id").alias("page_num"), "page_type", "keywords", "should_ocr")).groupBy("file_id", F.coalesce("method", F.lit("read")).alias("method")).agg(F.count(F.lit(1)).alias("n")),
    f"""with c as ({_CLASS}), j as (select source, doc_id, c.page_type, c.confidence, count(*) over (partition by source) as n from c join documents using (doc_id))
    select source as file_id, 'read' as method, count(*) as n from documents where doc_id % 3 = 0 group by source union all select source, 'skipped', count(*) from j where n > 3 and page_type in ('title', 'toc', 'notes') and confidence > 0.7 group by source""",
)
register("failure_rows", lambda s, d: flow.failures(_files(s, d).filter("o_orderstatus = 'F'"), F.when(c("file_id") % 2 == 0, "timeout")).select("file_id", "success", "n_items", F.get("errors", F.lit(0)).alias("error")), f"with {_FILES} select file_id, false as success, 0::bigint as n_items, case when file_id % 2 = 0 then 'timeout' else 'Unknown error' end as error from files where o_orderstatus = 'F'")
register(
    "routes",
    lambda s, d: _files(s, d).select(
        "file_id", P.route_extraction(F.when(c("file_id") % 3 > 0, F.repeat(F.lit("ab "), (c("file_id") % 40).cast("int"))), c("file_id") % 4).alias("after_reading"), P.route_ocr(_pick(("ocr_only", "hybrid", "vision_only"), c("file_id")), c("o_custkey") % 2 == 0, c("o_custkey") % 3).alias("second_reading"),
        P.next_dpi((c("file_id") % 9 * 50).cast("int")).alias("dpi"), files.clamped_dpi((c("file_id") % 900).cast("int")).alias("clamped"), files.chosen_method(c("o_custkey") % 200, c("file_id") % 2 == 0, c("n_pages")).alias("method"), P.is_blank(c("o_custkey") % 100 / 100).alias("blank"),
    ),
    f"""with {_FILES} select file_id, case when file_id % 3 > 0 and 3 * (file_id % 40) - 1 > 50 then 'parse' when file_id % 4 < 2 then 'retry' else 'skip' end as after_reading,
    case when o_custkey % 2 <> 0 then 'parse' when file_id % 3 = 2 then 'vision' when file_id % 3 = 1 and o_custkey % 3 > 0 then 'vision' else 'parse' end as second_reading, cast(least(file_id % 9 * 50 + 50, 400) as int) as dpi, cast(greatest(72, least(600, file_id % 900)) as int) as clamped,
    case when o_custkey % 200 > 100 then 'native' when file_id % 2 = 0 and n_pages >= 4 then 'parallel_ocr' else 'ocr' end as method, o_custkey % 100 / 100 > 0.98 as blank from files""",
)
register(
    "small_functions",
    lambda s, d: _parts(s, d).select(
        "p_partkey", T.confidence_label(c("n") / 50).alias("label"), T.code_key(cat("  a-", c("n"), " ")).alias("code"), T.safe_filename(cat("a b/", c("n"), ".pdf")).alias("filename"), products.extended_price(c("n").cast("double"), F.when(c("n") % 2 == 0, 2.5).otherwise(0.0)).alias("extended"),
        summary.success_rate(c("n").cast("double"), c("n") % 3).alias("rate"), summary.is_drainage(F.when(c("n") % 2 == 0, "430-1").otherwise("9"), F.when(c("n") % 3 == 0, "Storm line").otherwise("sign")).alias("drainage"), F.round(review.validation_score((c("n") % 5).cast("double"), F.lit(3)), 6).alias("score"),
        rollup.progress(c("n") % 4, F.lit(4), F.lit(0.5)).alias("progress"), structures.structure_number(cat("MH #", c("n"))).alias("number"), structures.depth_bucket(cat(c("n") % 12, "' DEEP")).alias("depth"),
    ),
    f"""with {_PARTS} select p_partkey, case when n / 50 >= 0.85 then 'high' when n / 50 >= 0.6 then 'medium' else 'low' end as label, 'A-' || n as code, 'a_b_' || n || '.pdf' as filename, case when n % 2 = 0 then n * 2.5 else 0 end::double as extended,
    case when n % 3 > 0 then n / (n % 3) else 0 end::double as rate, n % 2 = 0 or n % 3 = 0 as drainage, round(greatest(0.0, 1 - (n % 5) / 3)::double, 6) as score, least(100.0, 95.0 * (n % 4 + 0.5) / 4)::double as progress, cast(n as varchar) as number,
    case when n % 12 < 4 then '<4''' when n % 12 < 6 then '4''-6''' when n % 12 < 8 then '6''-8''' when n % 12 < 10 then '8''-10''' else '>10''' end as depth from parts""",
)
register("vision_dedup", lambda s, d: rollup.vision_dedup(base(s, d).select("file_id", c("pk").alias("item_no"), c("mat").alias("pay_item_no"), c("cfg").alias("description"), _pick(("high", "medium", "low"), c("pk")).alias("confidence")).distinct(), "file_id").select("file_id", "pay_item_no", "description", "item_no", "confidence"), f"with {BASE}, x as (select distinct file_id, pk as item_no, mat as pay_item_no, cfg as description, {_sql_pick(('high', 'medium', 'low'), 'pk')} as confidence, pk % 3 as r from base) select file_id, pay_item_no, description, item_no, confidence from x qualify row_number() over (partition by file_id, pay_item_no, description order by r, item_no) = 1")
register("counts_by_type", lambda s, d: rollup.counts_by_type(base(s, d).select(c("cfg").alias("type"))).withColumnRenamed("count", "n"), f"with {BASE} select cfg as type, count(*) as n from base group by cfg")
register("ocr_success_rate", lambda s, d: rollup.ocr_success_rate(base(s, d).select("mat", (c("q") % 2 == 0).alias("success")), "mat").select("mat", F.round("success_rate", 6).alias("success_rate")), f"with {BASE} select mat, round(avg(case when q % 2 = 0 then 1.0 else 0 end), 6) as success_rate from base group by mat")
register(
    "csv_report",
    lambda s, d: sinks.csv_report(_rolled(s, d).withColumn("page", F.lit(1)).withColumn("ai_match_reason", F.lit(None).cast("string")), pipes=rollup.material_pipes(_rolled(s, d), "file_id")).select("file_id", F.size(F.split("report", "\n")).cast("long").alias("n_lines"), F.contains("report", F.lit("PIPE SUMMARY")).alias("has_pipes")),
    f"with {_ROLLED}, n as (select file_id, count(*) as n, count(distinct sz) filter (pk % 6 = 5) as p from r group by file_id) select file_id, n + 1 + case when p > 0 then p + 3 else 0 end as n_lines, p > 0 as has_pipes from n",
)


# Every wording of the pattern tables, one line a page.
def _line_pages(s: SparkSession, d: str, forms: list) -> DataFrame:
    b = base(s, d).withColumn("a", F.split("oval", "x")[0]).withColumn("b", F.split("oval", "x")[1])
    text = F.lit("")
    for k, parts in enumerate(forms):
        text = F.when((c("pk") + c("ln")) % len(forms) == k, cat(*parts)).otherwise(text)
    return b.select(F.concat_ws("-", *[c(x).cast("string") for x in ("file_id", "ln", "pk", "sk", "q")]).alias("file_id"), text.alias("text")).distinct()


_LINES = f"{BASE}, lines as (select distinct file_id || '-' || ln || '-' || pk || '-' || sk || '-' || q as file_id, pk + ln as k, sz, q, cfg, split_part(oval, 'x', 1) as a, split_part(oval, 'x', 2) as b from base)"
register(
    "quantity_first_wordings",
    lambda s, d: E.quantity_first_items(_line_pages(s, d, [(c("q"), " LF ", c("sz"), '" RCP CLASS III'), (c("q"), " LF ", c("sz"), '" PVC SDR 35'), (c("sz"), '" RCP - ', c("q"), " LF"), (c("sz"), '" CMP (', c("q"), " LF)"), (c("q"), " LF of ", c("sz"), '" HDPE'), ("CMP ", c("sz"), '" @ ', c("q"), " LF"), (c("q"), " LF PVC ", c("sz"), '"'), (c("sz"), '" RCP LF ', c("q"))]), ["file_id"]).select("file_id", "pay_item_no", "description", "unit", "quantity"),
    f"""with {_LINES}, m as (select *, list_value('RCP', 'PVC', 'RCP', 'CMP', 'HDPE', 'CMP', 'PVC', 'RCP')[k % 8 + 1] as mat from lines)
    select file_id, mat || '-' || sz as pay_item_no, sz || '" ' || mat || case when k % 8 = 0 then ' CLASS III' else '' end as description, 'LF' as unit, cast(q as double) as quantity from m""",
)
register(
    "structure_wordings",
    lambda s, d: E.structure_items(
        _line_pages(s, d, [
            (c("sz"), '" STRAIGHT ENDWALL ', c("cfg")), ("STRAIGHT CONCRETE END WALL ", c("sz"), '" ', c("cfg")), (c("sz"), '" WINGED ENDWALL 45 DEG'), ("WING WALL ", c("sz"), '" U-TYPE'), (c("sz"), '" U-TYPE ENDWALL 4:1 WITH GRATE'), ("U-TYPE ENDWALL ", c("sz"), '" 3:1 BAFFLES'), (c("sz"), '" PIPE CRADLE'), ("CRADLE ", c("sz"), '"'),
            (c("sz"), '" MES 4:1'), ("MES 4:1 ", c("sz"), '"'), ("MITERED END SECTION ", c("sz"), '"'), (c("sz"), '" MITERED END'), (c("oval"), " MES"), ("MES ", c("oval")), (c("sz"), '" FLARED END'), ("FLARED END SECTION ", c("sz"), '"'),
        ]), ["file_id"]).select("file_id", "pay_item_no", "description"),
    f"""with {_LINES}, m as (select *, k % 16 as f, list_value('STRAIGHT_ENDWALL', 'STRAIGHT_ENDWALL', 'WINGED_ENDWALL', 'WINGED_ENDWALL', 'U_TYPE_ENDWALL', 'U_TYPE_ENDWALL', 'PIPE_CRADLE', 'PIPE_CRADLE', 'MES', 'MES', 'MES', 'MES', '', '', 'FLARED_END', 'FLARED_END')[k % 16 + 1] as kind,
      case k % 16 when 0 then ' ' || cfg when 1 then ' ' || cfg when 2 then ' 45 DEGREE' when 3 then ' U-TYPE' when 4 then ' 4:1 WITH GRATE' when 5 then ' 3:1 WITH BAFFLES' else '' end as more from lines)
    select file_id, kind || '-' || sz || '"' as pay_item_no, sz || '" ' || replace(kind, '_', ' ') || more as description from m where f not in (12, 13)
    union all select file_id, 'U_TYPE_ENDWALL-' || sz || '"', sz || '" U TYPE ENDWALL' from m where f = 3
    union all select file_id, 'MES_ELLIPTICAL-' || a || '"x' || b || '"', a || '"x' || b || '" MES (ELLIPTICAL)' from m where f in (12, 13)
    union all select file_id, 'MES-' || n || '"', n || '" MES' from (select file_id, case f when 12 then b else a end as n from m where f in (12, 13)) where cast(n as int) in {rules.PIPE_SIZES}""",
)
register(
    "galvanized_wordings",
    lambda s, d: E.galvanized_items(_line_pages(s, d, [(c("sz"), '" GALV STEEL MES DOUBLE RUN WITH FRAME'), ("GALVANIZED MES ", c("sz"), '" TRIPLE RUN'), (c("oval"), " GALV MES"), ("GALV MES ", c("oval"), " DOUBLE RUN NO FRAME")]), ["file_id"]).select("file_id", "pay_item_no", "run_config", "frame_option"),
    f"""with {_LINES}, m as (select *, k % 4 as f from lines)
    select file_id, 'GALV-MES-' || case when f < 2 then cast(sz as varchar) else a || 'x' || b end as pay_item_no, list_value('DOUBLE RUN', 'TRIPLE RUN', 'SINGLE RUN', 'DOUBLE RUN')[f + 1] as run_config, case when f = 0 then 'WITH FRAME' else 'NO FRAME' end as frame_option from m
    union all select file_id, 'GALV-MES-' || n, 'SINGLE RUN', 'NO FRAME' from (select file_id, case f when 2 then b else a end as n from m where f >= 2) where cast(n as int) in {rules.PIPE_SIZES}""",
)


# The workflow.
def _reader_at(dpi: int):
    """Stands for an engine: page texts parted by form feeds. Files of a path with r are legible at 300 dpi only, those with x never."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, _, span = path.rpartition("#")
                first, last = map(int, span.split("-"))
                legible = "x" not in name and ("r" not in name or dpi >= 300)
                for n, text in enumerate(bytes(content).decode().split("\f")[first - 1 : last], start=1):
                    rows.append((path, n, text if legible else "?", 0.9, 9, f"at {dpi}"))
            yield pd.DataFrame(rows, columns=["file_id", "page_num", "text", "confidence", "block_count", "method"])

    return read


def _workflow_files(s: SparkSession, d: str) -> DataFrame:
    """Orders as files, an order line a page: every seventh needs a second or third reading, every eleventh fails, every third is split."""
    line = cat("SHEET OF THE DRAINAGE PLAN, SEE THE NOTES BELOW FOR WHAT IS MEANT\n", _code(), " PIPE CULVERT LF ", c("q"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("ln", line.alias("t")))), lambda x: x["t"])
    kind = F.when(c("file_id") % 11 == 0, "x").when(c("file_id") % 7 == 0, "r").otherwise("p")
    g = base(s, d).groupBy("file_id").agg(pages.alias("pages"))
    return g.select(c("file_id").cast("string").alias("file_id"), F.concat(kind, c("file_id").cast("string")).alias("path"), F.encode(F.array_join("pages", "\f"), "UTF-8").alias("content"), F.when(c("file_id") % 3 == 0, 60.0).otherwise(5.0).alias("mb"), F.size("pages").alias("n_pages"))


def _workflow(s: SparkSession, d: str) -> DataFrame:
    from planquant.plans.workflow import run_workflow
    from planquant.workers import checkpoint_folder

    catalog = lambda: s.createDataFrame(list(_FULL_CATALOG), "row_no long, id string, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string")
    measured = lambda parts: parts.withColumn("mb", (c("last_page") - c("first_page") + 1) * 12.0)
    status = run_workflow(_workflow_files(s, d), _reader_at, f"{checkpoint_folder(s)}/workflow-{uuid.uuid4().hex}", catalog, measured, use_product_first=False)
    return status.select("file_id", "original_file", "first_page", "last_page", "status", "stage", "attempts", "n_pages", "n_items", "n_matched", F.round("total_cost", 2).alias("total_cost"), F.array_join("errors", "; ").alias("errors"))


_PLANNED = """planned as (select file_id, n, cast(ceil(n / 3.0) as int) as size, 1 + cast(ceil(n / 3.0) as int) * k.k as a from counted, range(7) k(k) where file_id % 3 = 0 and k.k * cast(ceil(n / 3.0) as int) < n),
  halved as (select file_id, a, least(a + size - 1, n) as b from planned union all
    select file_id, case x.x when 0 then a else (a + b) // 2 + 1 end, case x.x when 0 then (a + b) // 2 else b end from halved, range(2) x(x) where (b - a + 1) * 12.0 > 30 and b > a),
  fitting as (select file_id, a, b, row_number() over (partition by file_id order by a) as part from halved where not ((b - a + 1) * 12.0 > 30 and b > a)),
  parts as (select file_id, cast(file_id as varchar) || '_part' || part as id, a, b from fitting union all select file_id, cast(file_id as varchar), 1, n from counted where file_id % 3 <> 0)"""
register(
    "workflow_status",
    _workflow,
    f"""with recursive {BASE}, paged as (select *, row_number() over (partition by file_id order by ln, sz || ' PIPE CULVERT LF ' || q) as page from base), counted as (select file_id, cast(count(*) as int) as n from base group by 1), {_PLANNED},
  found as (select distinct id, sz, q from parts join paged on parts.file_id = paged.file_id and page between a and b where parts.file_id % 11 <> 0),
  totals as (select id, count(*) as n_items, round(sum(q * 7.5), 2) as cost from found group by id)
  select parts.id as file_id, cast(file_id as varchar) as original_file, a as first_page, b as last_page, case when file_id % 11 = 0 then 'failed' else 'success' end as status, case when file_id % 11 = 0 then 'read' else 'report' end as stage,
    cast(case when file_id % 11 = 0 or file_id % 7 = 0 then 3 else 1 end as int) as attempts, cast(case when file_id % 11 = 0 then 0 else b - a + 1 end as bigint) as n_pages, coalesce(n_items, 0) as n_items, coalesce(n_items, 0) as n_matched,
    coalesce(cost, 0.0)::double as total_cost, case when file_id % 11 = 0 then 'too little text after all retries' else '' end as errors
  from parts left join totals on totals.id = parts.id""",
)


# Places of items, answers of vision models, codes of structures.
register(
    "source_locations",
    lambda s, d: E.located(
        _parts(s, d).select(c("n").alias("file_id"), c("p_partkey").alias("item_no"), cat(c("p_name"), " ", c("sz"), " LF").alias("source_text"), F.when(c("p_partkey") % 4 > 0, c("p_type")).alias("description")),
        _parts(s, d).select(c("n").alias("file_id"), F.lit(1).alias("page"), c("p_partkey").alias("block_no"), F.upper(F.when(c("p_partkey") % 3 > 0, cat("SEE ", c("p_name"), " ", c("sz"), " LF")).otherwise(cat(c("p_type"), " ", c("p_brand")))).alias("text"), F.lit(None).cast("array<array<double>>").alias("bbox"), F.lit(0.9).alias("confidence")),
        ["file_id"],
        "item_no",
    ).select("file_id", "item_no", c("source_location.page").alias("page"), c("source_location.text_context").alias("text_context"), c("source_location.ocr_confidence").alias("ocr_confidence")),
    f"""with {_PARTS},
  items as (select n as file_id, p_partkey as item_no, lower(p_name || ' ' || sz || ' LF') as m, lower(case when p_partkey % 4 > 0 then p_type else '' end) as t from parts),
  blocks as (select n as file_id, p_partkey as block_no, upper(case when p_partkey % 3 > 0 then 'SEE ' || p_name || ' ' || sz || ' LF' else p_type || ' ' || p_brand end) as text from parts),
  scored as (select i.file_id, i.item_no, b.block_no, b.text,
      case when contains(lower(b.text), m) then 100 else 20 * len(list_filter(string_split(m, ' '), lambda w: len(w) > 2 and contains(lower(b.text), w))) end
      + case when t <> '' and contains(lower(b.text), t) then 50 else 10 * len(list_filter(string_split(t, ' '), lambda w: len(w) > 2 and contains(lower(b.text), w))) end as score
    from items i join blocks b on i.file_id = b.file_id),
  best as (select * from scored where score >= 20 qualify row_number() over (partition by file_id, item_no order by score desc, block_no) = 1)
  select i.file_id, i.item_no, case when b.block_no is not null then 1 end as page, left(b.text, 100) as text_context, case when b.block_no is not null then 0.9 end::double as ocr_confidence
  from items i left join best b on i.file_id = b.file_id and i.item_no = b.item_no""",
)


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Parts as recorded answers, written in eight ways."""
    k = c("p_partkey")
    item = lambda code: F.to_json(F.struct(F.array(F.struct(cat(code, k).alias("pay_item_no"), c("p_name").alias("description"), F.lit("LF").alias("unit"), c("n").cast("double").alias("quantity"), F.lit("high").alias("confidence"))).alias("pay_items"), F.lit("sheet {A} of }{").alias("page_summary") if code == "430-" else F.lit("second").alias("page_summary")))
    whole, plain = item("430-"), F.regexp_replace(item("430-"), r"sheet \{A\} of \}\{", "sheet")
    ways = (whole, cat("The items: ", plain, " and {more}."), cat("```json\n", plain, "\n```"), cat("{no} object, ", plain), cat(plain, "\n", item("431-")), cat("```\n", plain, "\n``` with {braces}"), F.lit("{broken"), F.lit("I can't read this page."))
    return _parts(s, d).select(c("file_id"), F.lit(1).alias("page_num"), F.get(F.array(*ways), (k % 8).cast("int")).alias("response"))


register(
    "vision_answers",
    lambda s, d: files.vision_items(_answers(s, d)).select("file_id", "item_no", "pay_item_no", "description", "unit", "quantity", "confidence"),
    f"with {_PARTS} select file_id, 0 as item_no, '430-' || p_partkey as pay_item_no, p_name as description, 'LF' as unit, cast(n as double) as quantity, 'high' as confidence from parts where p_partkey % 8 in (0, 1, 2, 4, 5)",
)
register(
    "structure_code_lookup",
    lambda s, d: structures.code_lookup(_parts(s, d).select("p_partkey", _pick(("INLET", "MANHOLE", "WELL"), c("p_partkey")).alias("type"), _pick(("type 7", "STANDARD", "CURB TYPE P-5", "zzzz"), c("p_partkey")).alias("subtype"), F.lit(None).cast("string").alias("depth")), structures.structure_codes(s)).select("p_partkey", "fdot_code", "price", "found"),
    f"""select p_partkey, case p_partkey % 4 when 0 then '425-2-41' when 2 then '425-1-621' else {_sql_pick([rules.DEFAULT_STRUCTURES.get(t, structures.FALLBACK)[0] for t in ("INLET", "MANHOLE", "WELL")], 'p_partkey')} end as fdot_code,
  cast(case p_partkey % 4 when 0 then 5500.0 when 2 then 7200.0 else {_sql_pick([float(rules.DEFAULT_STRUCTURES.get(t, structures.FALLBACK)[1]) for t in ("INLET", "MANHOLE", "WELL")], 'p_partkey')} end as double) as price, {_sql_pick(('direct', 'standard', 'direct', 'default'), 'p_partkey')} as found from part""",
)
