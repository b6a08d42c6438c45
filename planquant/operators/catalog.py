"""The product catalog: CSV rows to products, keywords and search patterns.

Search patterns follow from a product's size, kind and configuration: a table of templates is filled in, row by row, and the
patterns are used as a column.
"""

from __future__ import annotations

import itertools
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from planquant.workers import workers_find_package

CSV_SCHEMA = "Document string, Product_Type string, Size string, Configuration string, Price string, Unit string, FDOT_Code string, Notes string"


#: Where the price list is looked for if none is named: this variable, else this file in the working folder.
CATALOG_VARIABLE, CATALOG_FILE = "PLANQUANT_CATALOG", "references/prices.csv"


def default_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The price list at `path`, else where `CATALOG_VARIABLE` says, else `CATALOG_FILE`."""
    return read_catalog(spark, path or os.environ.get(CATALOG_VARIABLE) or CATALOG_FILE)


def read_catalog(spark: SparkSession, path: str, drop_unpriced: bool = True) -> DataFrame:
    """Products of a price list. `call for pricing` is 0.0; with `drop_unpriced` other unreadable prices drop the row, else
    they are 0.0. Inch signs inside fields are plain characters; rows with surplus cells keep their first eight."""
    raw = spark.read.csv(path, schema=CSV_SCHEMA, header=True, escape='"', mode="PERMISSIVE", enforceSchema=True)
    return products(raw.withColumn("row_no", F.monotonically_increasing_id()), drop_unpriced)


def products(raw: DataFrame, drop_unpriced: bool = True) -> DataFrame:
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    number = F.regexp_replace(t("Price"), r"[$,]", "").try_cast("double")
    price = F.when(F.contains(F.lower(t("Price")), F.lit("call")), 0.0).otherwise(number)
    name = F.concat_ws("_", t("Document"), t("Product_Type"), t("Size"), t("Configuration"))
    ident = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\W", "_"), "_+", "_"), "^_|_$", "")
    out = raw.select(
        "row_no", ident.alias("id"), t("Document").alias("category"), t("Product_Type").alias("product_type"), t("Size").alias("size"),
        t("Configuration").alias("configuration"), price.alias("price"), t("Unit").alias("unit"), F.nullif(t("FDOT_Code"), F.lit("")).alias("fdot_code"), t("Notes").alias("notes"),
    )
    return out.filter("price is not null") if drop_unpriced else out.fillna({"price": 0.0})


def with_keywords(catalog: DataFrame) -> DataFrame:
    """The words a text must have for a product to be looked for: its first number, and MES for grates."""
    number = F.nullif(F.regexp_extract("size", r"\d+", 0), F.lit(""))
    return catalog.withColumn("keywords", F.array_compact(F.array(number, F.when(F.col("category") == "MES_Pipe_Grates", "MES"))))


# How products are written in plans, the most specific way first, by category, product type and configuration
# (regular expressions that must be found). <n> is the size, <s> the size with or without an inch sign, <rcp> a spelling of
# concrete pipe, <class> a way to write its class, <oval> a way to write rise and span, <grate> a grate's size, <run> and
# <frame> its kind, <ratio> a slope.
_NO_CLASS = r"^(?!CL\s*[IVX])"
SEARCH_PATTERNS = (
    ("RCP_Price_List", "Round", r"^CL\s*[IVX]", (r"<s>\s*(?:INCH\s+)?<rcp>\s*,?\s*<class>", r"<s>\s*<class>\s+<rcp>", r"<rcp>\s+<s>\s*,?\s*<class>", r"<n>\s*(?:INCH|IN\.?)\s*<rcp>\s*,?\s*<class>")),
    ("RCP_Price_List", "Round", r"^CL\s*[IVX]", (r"\(<s>\)\s*\(RCP\)\s*\(<class>\)", r"PIPE.*?\(<s>\).*?\(RCP\).*?\(<class>\)", r"CULVERT.*?<s>.*?RCP.*?<class>")),
    ("RCP_Price_List", "Round", r"^CL\s*[IVX]", (r"PIPE\s*[,\-]?\s*<s>\s*.*?RCP.*?<class>", r"<s>\s*(?:REINFORCED\s+)?(?:CONCRETE\s+)?PIPE\s+<class>")),
    ("RCP_Price_List", "Round", _NO_CLASS + r".*MES", (r"<s>\s*(?:RCP\s+)?MES\s*4:1", r"MES\s+<s>\s*(?:RCP)?", r"<s>\s*MITERED\s+END\s+SECTION")),
    ("RCP_Price_List", "Round", _NO_CLASS + r"(?!.*MES).*Flared", (r"<s>\s*(?:RCP\s+)?FLARED\s+END", r"FLARED\s+END\s+(?:SECTION\s+)?<s>", r"<s>\s*FES")),
    ("RCP_Price_List", "Round", _NO_CLASS + r"(?!.*(?:MES|Flared)).*Cradle", (r"<s>\s*PIPE\s+CRADLE", r"PIPE\s+CRADLE\s+<s>", r"CRADLE\s+<s>")),
    ("RCP_Price_List", "Round", "", (r"<s>\s*<rcp>", r"<rcp>\s+<s>")),
    ("RCP_Price_List", "Round", "", (r"<n>\s*(?:INCH|IN\.?)\s*RCP", r"<s>\s+REINFORCED\s+CONCRETE\s+PIPE")),
    ("RCP_Price_List", "^(?!.*Round).*Elliptical", r"^CL\s*[IVX]", (r"<oval>\s*ELLIPTICAL.*?<word class>", r"ELLIPTICAL.*?<oval>.*?<word class>", r"<oval>.*?RCP.*?<word class>")),
    ("RCP_Price_List", "^(?!.*Round).*Elliptical", _NO_CLASS + r".*MES", (r"<oval>\s*(?:ELLIPTICAL\s+)?MES", r"MES\s+<oval>")),
    ("RCP_Price_List", "^(?!.*Round).*Elliptical", _NO_CLASS + r"(?!.*MES).*Flared", (r"<oval>\s*FLARED\s+END", r"FLARED\s+END.*?<oval>")),
    ("RCP_Price_List", "^(?!.*Round).*Elliptical", "", (r"<oval>\s*ELLIPTICAL", r"ELLIPTICAL\s*<oval>", r"<oval>\s*(?:E\.?R\.?C\.?P\.?|ERCP)")),
    ("End_Sections", "Straight", "Single", (r"<s>\s*SINGLE\s+ENDWALL", r"SINGLE\s+ENDWALL\s+<s>", r"<s>\s*(?:STRAIGHT\s+)?ENDWALL\s*[-,]?\s*SINGLE")),
    ("End_Sections", "Straight", "^(?!.*Single).*Double", (r"<s>\s*DOUBLE\s+ENDWALL", r"DOUBLE\s+ENDWALL\s+<s>", r"<s>\s*(?:STRAIGHT\s+)?ENDWALL\s*[-,]?\s*DOUBLE")),
    ("End_Sections", "Straight", "^(?!.*(?:Single|Double)).*Triple", (r"<s>\s*TRIPLE\s+ENDWALL", r"TRIPLE\s+ENDWALL\s+<s>", r"<s>\s*(?:STRAIGHT\s+)?ENDWALL\s*[-,]?\s*TRIPLE")),
    ("End_Sections", "Straight", "^(?!.*(?:Single|Double|Triple)).*Quad", (r"<s>\s*QUAD(?:RUPLE)?\s+ENDWALL", r"QUAD(?:RUPLE)?\s+ENDWALL\s+<s>")),
    ("End_Sections", "Straight", "", (r"<s>\s*STRAIGHT\s+ENDWALL", r"STRAIGHT\s+ENDWALL\s+<s>", r"<s>\s*ENDWALL", r"ENDWALL\s+<s>", r"<s>\s*END\s+WALL")),
    ("End_Sections", "^(?!.*Straight).*Winged", "45", (r"<s>\s*(?:WINGED?\s+)?ENDWALL\s*[-,]?\s*45\s*(?:DEG(?:REE)?)?", r"45\s*(?:DEG(?:REE)?)?\s+WINGED?\s+ENDWALL\s+<s>")),
    ("End_Sections", "^(?!.*Straight).*Winged", "^(?!.*45).*(?:U-Type|U TYPE)", (r"<s>\s*WINGED?\s+ENDWALL\s*[-,]?\s*U[-\s]?TYPE", r"U[-\s]?TYPE\s+WINGED?\s+ENDWALL\s+<s>")),
    ("End_Sections", "^(?!.*Straight).*Winged", "", (r"<s>\s*WINGED?\s+ENDWALL", r"WINGED?\s+ENDWALL\s+<s>", r"<s>\s*WING\s+WALL")),
    ("End_Sections", "^(?!.*(?:Straight|Winged)).*U-Type", "", (r"<s>\s*U[-\s]?TYPE\s+(?:ENDWALL\s+)?<ratio>", r"<ratio>\s+U[-\s]?TYPE\s+(?:ENDWALL\s+)?<s>", r"<s>\s*<ratio>\s+U[-\s]?TYPE")),
    ("End_Sections", "^(?!.*(?:Straight|Winged)).*U-Type", "^(?=.*Grate).*Baffle", (r"<s>\s*U[-\s]?TYPE.*?<ratio>.*?GRATE.*?BAFFLE",)),
    ("End_Sections", "^(?!.*(?:Straight|Winged)).*U-Type", "^(?!.*Baffle).*Grate", (r"<s>\s*U[-\s]?TYPE.*?<ratio>.*?GRATE",)),
    ("End_Sections", "^(?!.*(?:Straight|Winged)).*U-Type", "^(?!.*Grate).*Baffle", (r"<s>\s*U[-\s]?TYPE.*?<ratio>.*?BAFFLE",)),
    ("End_Sections", "^(?!.*(?:Straight|Winged)).*U-Type", "", (r"<s>\s*U[-\s]?TYPE\s+ENDWALL", r"U[-\s]?TYPE\s+ENDWALL\s+<s>", r"<s>\s*U[-\s]?TYPE")),
    ("MES_Pipe_Grates", "", "", (r"<grate>\s*(?:4:1\s+)?MES\s+<run>", r"<run>\s+(?:RUN\s+)?(?:4:1\s+)?MES\s+<grate>", r"MES\s+<grate>\s+<run>", r"<grate>.*?MES.*?<run>.*?<frame>")),
    ("MES_Pipe_Grates", "", "", (r"<grate>\s*(?:4:1\s+)?MES", r"MES\s+(?:4:1\s+)?<grate>")),
    ("MES_Pipe_Grates", "", "", (r"<round>\s*MITERED\s+END\s+SECTION",)),
    ("MES_Pipe_Grates", "", "", (r"GALVANIZED.*?MES.*?<n>",)),
)
#: The ways that a placeholder is written; numbers are groups of what is looked up in `_LOOKUPS`.
_WAYS = {
    "<rcp>": ("RCP", "RGP", "PCP", "RCE", r"R\.?C\.?P\.?"),
    "<oval>": (r"""\1["']?\s*[Xx×]\s*\2["']?""", r"\1\s*BY\s*\2", r"\1-\2"),
    "<class>": (r"CL\s*\1", r"CLASS\s*\1", r"C-\1"),
    "<word class>": (r"CL\s*\1", r"CLASS\s*\1"),
    "<grate>": (r"""\1["']?\s*[Xx×]\s*\2["']?""", r"""\3["']?"""),
    "<round>": (r"""\1["']?""",),
    "<run>": (r"\1",),
    "<frame>": (r"NO\s+FRAME", r"(?:WITH\s+)?FRAME"),
    "<ratio>": (r"\1:1",),
    "<n>": (r"\1",),
    "<s>": (r"""\1["']?""",),
}
#: Where a placeholder's values come from: the size or the configuration, and what must be found there.
_LOOKUPS = {
    "<rcp>": ("size", ""), "<oval>": ("size", r"^(\d+)\s*[Xx]\s*(\d+)"), "<class>": ("configuration", r"^CL\s*([IVX]+)"), "<word class>": ("configuration", r"^CL\s*([IVX]+)"),
    "<grate>": ("size", r"^(?:(\d+)\s*[Xx]\s*(\d+)|([^Xx]*)$)"), "<round>": ("size", r"^([^Xx]*)$"), "<run>": ("run", r"^(.+)$"),
    "<frame>": ("configuration", r"^(?:(?!.*Frame)|.*(No Frame))|(Frame)"), "<ratio>": ("configuration", r"^(\d+):1"), "<n>": ("size", "^(.*)$"), "<s>": ("size", "^(.*)$"),
}


def _ways(name: str, size: str, configuration: str) -> list[str]:
    """The ways to write a placeholder for a product; none where the product doesn't have it."""
    where, pattern = _LOOKUPS[name]
    run = min((w for w in ("Single", "Double", "Triple") if w in configuration), key=("Single", "Double", "Triple").index, default="")
    m = re.search(pattern, {"size": size, "configuration": configuration, "run": run.upper()}[where])
    if m is None:
        return []
    if name == "<grate>":
        return [_filled(_WAYS[name][0 if m[1] else 1], m)]
    if name == "<frame>":
        return [_WAYS[name][1 if m[2] else 0]]
    return [_filled(w, m) for w in _WAYS[name]]


def _filled(way: str, m: re.Match) -> str:
    return re.sub(r"\\([1-9])", lambda g: re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", m[int(g[1])] or ""), way)


def search_patterns(category: str, product_type: str, size: str, configuration: str) -> list[str]:
    """A product's patterns, the most specific first: every row of `SEARCH_PATTERNS` that fits it, its placeholders filled in
    all ways. A row with a placeholder that the product doesn't have is left out. Structures have no rows: their wording is
    matched instead."""
    bare, out = size.replace('"', "").replace("'", "").strip(), []
    for row_category, kind, when, templates in SEARCH_PATTERNS:
        if row_category == category and re.search(kind, product_type) and re.search(when, configuration):
            used = [n for n in _WAYS if any(n in t for t in templates)]
            for values in itertools.product(*(_ways(n, bare, configuration) for n in used)):
                for t in templates:
                    for n, v in zip(used, values, strict=True):
                        t = t.replace(n, v)
                    out.append(t)
    return out


def with_patterns(catalog: DataFrame) -> DataFrame:
    """The catalog with its patterns as arrays, made where the rows are. Sizes are quoted, so every pattern compiles."""
    workers_find_package(catalog.sparkSession)
    made = F.udf(search_patterns, "array<string>", useArrow=True)
    given = [F.coalesce(c, F.lit("")) for c in ("category", "product_type", "size", "configuration")]
    return catalog.withColumn("patterns", made(*given))
