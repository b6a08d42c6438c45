"""Sources: PDF lists, page text, recorded recognition, split plans; boundaries to outside engines are pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from planquant.functions.arrays import let
from planquant.functions.text import project_of
from planquant.workers import cut

PAGES = "file_id string, page_num int, text string, confidence double, block_count int, method string"
VISION = (
    "struct<pay_items:array<struct<pay_item_no:string,description:string,unit:string,quantity:double,confidence:string>>,"
    "drainage_structures:array<struct<type:string,id:string,size:string>>,notes:array<string>,page_summary:string>"
)
MAX_MB, MAX_PAGES, SAFE_MB = 25, 90, 30


def scan_pdfs(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """PDF files of a folder (not below it) or a single file: path, name, project, length; by name without case."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    name = F.substring_index("path", "/", -1)
    files = raw.select("path", name.alias("filename"), project_of(name).alias("project"), "length", "modificationTime", *(["content"] if with_content else []))
    return files.orderBy(F.lower("filename"))


def read_pages(files: DataFrame, reader: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Pages from a reader of (path, content) batches: a PDF library, an OCR engine or a vision model. It loads its
    model once per worker, and gives a row with confidence 0 and an empty text for a page it fails on."""
    return files.select("path", "content").mapInPandas(reader, PAGES)


def recorded_vision(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a vision model, recorded as JSON lines (file_id, page_num, response)."""
    return spark.read.schema("file_id string, page_num int, response string").json(path)


def balanced_object(response: Column) -> Column:
    """The first stretch from an opening brace to the one that closes it, braces counted as they come; null if none closes.

    Only braces matter, so the text is cut at them: a running depth over those few pieces finds the end."""
    pieces = F.split(F.substring(response, F.locate("{", response), F.length(response)), r"(?<=[{}])")
    # Depth after each piece, and how many pieces it takes until it is 0 for the first time.
    sign = lambda x: F.when(F.endswith(x, F.lit("{")), 1).when(F.endswith(x, F.lit("}")), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    step = lambda s, x: F.when(s["done"], s).otherwise(let(s["depth"] + sign(x), lambda d: F.struct(d.alias("depth"), (s["n"] + 1).alias("n"), (d == 0).alias("done"))))
    closed = lambda p: F.aggregate(p, start, step, lambda s: F.when(s["done"], F.array_join(F.slice(p, F.lit(1), s["n"]), "")))
    return F.when(F.contains(response, F.lit("{")), let(pieces, closed))


def vision_json(response: Column) -> Column:
    """The answer as a struct: the whole of it, its first balanced object, a fenced block, or from its first brace to its last. Null
    if none of them is an object with items or a summary."""
    read = lambda s: F.from_json(s, VISION)
    fenced = F.nullif(F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit(""))
    good = lambda x: F.when(x["pay_items"].isNotNull() | x["page_summary"].isNotNull(), x)
    return F.coalesce(good(read(response)), good(read(balanced_object(response))), good(read(fenced)), good(read(braces)))


def vision_items(answers: DataFrame) -> DataFrame:
    a = answers.withColumn("v", vision_json(F.col("response"))).filter("v is not null")
    return a.select("file_id", "page_num", F.posexplode("v.pay_items").alias("item_no", "i")).select("file_id", "page_num", "item_no", "i.*")


def vision_text(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items as lines of code, description, unit and quantity, so that text rules can read them."""
    line = F.concat_ws(" ", "pay_item_no", "description", "unit", F.col("quantity").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("item_no", line.alias("l"))))
    return items.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("text"))


def needs_splitting(mb: Column, pages: Column) -> Column:
    return (mb > MAX_MB) | (pages > MAX_PAGES)


def split_plan(files: DataFrame, mb_col: str = "mb", pages_col: str = "n_pages", file_col: str = "file_id") -> DataFrame:
    """Page ranges of each file's parts: as many as size and pages ask for, at most 90 pages each."""
    n = F.greatest(F.ceil(F.col(mb_col) / MAX_MB), F.ceil(F.col(pages_col) / MAX_PAGES), F.lit(1))
    size = F.least(F.ceil(F.col(pages_col) / n), F.lit(MAX_PAGES)).cast("int")
    parts = F.when(needs_splitting(F.col(mb_col), F.col(pages_col)), F.sequence(F.lit(1), F.col(pages_col).cast("int"), size)).otherwise(F.array(F.lit(1)))
    whole = F.when(needs_splitting(F.col(mb_col), F.col(pages_col)), size).otherwise(F.col(pages_col).cast("int"))
    e = files.select(file_col, F.col(pages_col).cast("int").alias("_n"), whole.alias("_size"), F.posexplode(parts).alias("part_no", "first_page"))
    return e.select(file_col, "part_no", "first_page", F.least(F.col("first_page") + F.col("_size") - 1, F.col("_n")).alias("last_page"))


def halves(parts: DataFrame, mb_col: str = "mb") -> DataFrame:
    """Parts that came out over 30 MB, each in two; to be written and measured again."""
    mid = F.floor((F.col("first_page") + F.col("last_page")) / 2).cast("int")
    big = (F.col(mb_col) > SAFE_MB) & (F.col("last_page") > F.col("first_page"))
    ranges = F.when(big, F.array(F.struct(F.col("first_page").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("last_page").alias("b")))).otherwise(F.array(F.struct(F.col("first_page").alias("a"), F.col("last_page").alias("b"))))
    return parts.withColumn("_r", F.explode(ranges)).withColumn("first_page", F.col("_r.a")).withColumn("last_page", F.col("_r.b")).drop("_r")


def split_to_fit(parts: DataFrame, measured: Callable[[DataFrame], DataFrame], file_col: str = "file_id") -> DataFrame:
    """Parts (file_col, first_page, last_page) of at most 30 MB, numbered anew, or of a single page: parts that are larger are halved, written
    and measured again until none is left. `measured` adds the size `mb` of the parts it is given. Each round halves
    pages, so rounds are few; parts that fit are not measured again."""
    done, left = None, parts.select(file_col, "first_page", "last_page")
    while True:
        sized = cut(measured(left))
        fits = (F.col("mb") <= SAFE_MB) | (F.col("last_page") <= F.col("first_page"))
        good = sized.filter(fits).select(file_col, "first_page", "last_page", "mb")
        done = good if done is None else done.unionByName(good)
        large = sized.filter(~fits)
        if not large.limit(1).count():
            break
        left = halves(large).select(file_col, "first_page", "last_page")
    return done.select(file_col, (F.row_number().over(Window.partitionBy(file_col).orderBy("first_page")) - 1).alias("part_no"), "first_page", "last_page", "mb")


def chosen_method(native_chars: Column, parallel: Column, n_pages: Column) -> Column:
    """native where the file has text (over 100 characters), else parallel recognition from four pages on, else sequential."""
    return F.when(native_chars > 100, "native").when(parallel & (n_pages >= 4), "parallel_ocr").otherwise("ocr")


def clamped_dpi(dpi: Column) -> Column:
    return F.greatest(F.lit(72), F.least(F.lit(600), dpi))
