"""What happens to files and pages before and after reading: splits, retries, placeholders, selected pages, failures, and the
boundaries to outside engines, which are functions passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from planquant.operators.pages import next_dpi, route_extraction
from planquant.sources.files import MAX_MB, PAGES, needs_splitting, scan_pdfs
from planquant.workers import cut, workers_find_package

Reader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: Characters of a page that an outside cleaner is sent; the rest stays as it is.
CLEANED_CHARACTERS = 3000


def checked_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """`scan_pdfs`, but a path that isn't there, a single file that is no PDF and a folder without PDFs raise ValueError."""
    if "." in path.rsplit("/", 1)[-1] and not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF file: {path}")
    try:
        files = scan_pdfs(spark, path)
        found = files.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError(f"not found: {path}") from e
        raise
    if not found:
        raise ValueError(f"no PDF files in {path}")
    return files


def with_placeholders(read: DataFrame, classes: DataFrame) -> DataFrame:
    """The pages read, and a page with the reason as text (confidence 1) for every classified page that wasn't to be read."""
    reason = F.concat(F.lit("[Skipped: "), "page_type", F.lit(" - "), F.array_join("keywords", ", "), F.lit("]"))
    skipped = classes.filter(~F.col("should_ocr")).select("file_id", "page_num", reason.alias("text"), F.lit(1.0).alias("confidence"), F.lit(0).alias("block_count"), F.lit("skipped").alias("method"))
    return read.unionByName(skipped, allowMissingColumns=True)


def failed_page(error: Column) -> Column:
    """The text of a page that recognition failed on; its confidence is 0."""
    return F.when(F.lower(error).contains("timeout"), "[OCR TIMEOUT]").otherwise(F.concat(F.lit("[OCR FAILED: "), error, F.lit("]")))


def selected_pages(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages asked for, errors): of `wanted`(file_id, page_num) those that `pages` has, and a message for each of the others."""
    keys = ["file_id", "page_num"]
    total = pages.groupBy("file_id").agg(F.max("page_num").alias("_n"))
    missing = wanted.join(pages.select(*keys).distinct(), keys, "left_anti").join(total, "file_id", "left")
    message = F.concat(F.lit("Page "), F.col("page_num").cast("string"), F.lit(" out of range (document has "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" pages)"))
    return pages.join(wanted.select(*keys).distinct(), keys, "left_semi"), missing.select(*keys, message.alias("error"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as pages of their own: path, filename, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG}").load(path)
    return raw.select("path", F.substring_index("path", "/", -1).alias("filename"), "content")


def rendered(files: DataFrame, renderer: Reader) -> DataFrame:
    """Page images (file_id, page_num, image) from a renderer of (path, content) batches."""
    workers_find_package(files.sparkSession)
    return files.select("path", "content").mapInPandas(renderer, "file_id string, page_num int, image binary")


def cropped(page_images: DataFrame, regions: DataFrame, cropper: Reader) -> DataFrame:
    """Image parts: each region's page image and box through a cropper of (file_id, page_num, region_no, image, bbox) batches."""
    both = regions.select("file_id", "page_num", "region_no", "bbox").join(page_images, ["file_id", "page_num"])
    workers_find_package(both.sparkSession)
    return both.select("file_id", "page_num", "region_no", "image", "bbox").mapInPandas(cropper, "file_id string, page_num int, region_no int, image binary")


def image_words(page_images: DataFrame, reader: Reader) -> DataFrame:
    """Words with their boxes from a recognition engine."""
    workers_find_package(page_images.sparkSession)
    return page_images.mapInPandas(reader, "file_id string, page_num int, word_no int, text string, bbox array<array<double>>, confidence double")


def cleaned_by(pages: DataFrame, cleaner: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Pages whose first `CLEANED_CHARACTERS` characters an outside cleaner has mended; what it gives no text for stays."""
    mend = F.pandas_udf(cleaner, "string")
    head, rest = F.left("text", F.lit(CLEANED_CHARACTERS)), F.substring(F.col("text"), F.lit(CLEANED_CHARACTERS + 1), F.length("text"))
    return pages.withColumn("text", F.coalesce(F.concat(mend(head), rest), F.col("text")))


def validated_by(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Items with what an outside validator says of them: `issues`(file_id, item_no, issue, severity, quantity); a quantity it
    is sure of (severity high) replaces the item's."""
    found = issues.groupBy("file_id", "item_no").agg(F.array_sort(F.collect_list("issue")).alias("ai_issues"), F.max(F.when(F.col("severity") == "high", F.col("quantity"))).alias("_q"))
    return items.join(found, ["file_id", "item_no"], "left").withColumn("quantity", F.coalesce("_q", "quantity")).drop("_q")


def split_stats(parts: DataFrame, *keys: str) -> DataFrame:
    """Number, size and pages of the parts that files were split into, and the parts in order. A file's parts are bounded by it."""
    part = F.struct("part_no", F.round("mb", 2).alias("mb"), "n_pages")
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum("mb"), 2).alias("total_mb"), F.sum("n_pages").alias("total_pages"), F.array_sort(F.collect_list(part)).alias("parts"))


def split_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files with every large one replaced by its planned parts: file_id, original_file, first_page, last_page, route.

    A large file without a plan (it couldn't be split) is skipped; all others go on to extraction."""
    large = needs_splitting(F.col("mb"), F.col("n_pages"))
    n = F.count(F.lit(1)).over(Window.partitionBy("file_id"))
    parts = plan.withColumn("_n", n).select(F.col("file_id").alias("_file"), "part_no", "first_page", "last_page", "_n")
    j = files.join(parts, F.col("file_id") == F.col("_file"), "left")
    name = F.when(large & F.col("part_no").isNotNull() & (F.col("_n") > 1), F.concat(F.col("file_id").cast("string"), F.lit("_part"), (F.col("part_no") + 1).cast("string"))).otherwise(F.col("file_id").cast("string"))
    route = F.when(large & F.col("part_no").isNull(), "skip").otherwise("extract")
    return j.select(name.alias("file_id"), F.col("file_id").alias("original_file"), F.coalesce("first_page", F.lit(1)).alias("first_page"), F.coalesce(F.col("last_page"), F.col("n_pages").cast("int")).alias("last_page"), route.alias("route"))


def failures(files: DataFrame, error: Column) -> DataFrame:
    """Result rows of files that failed."""
    zero = lambda c: F.lit(0).cast("long").alias(c)
    return files.select("file_id", F.lit(False).alias("success"), zero("n_items"), zero("n_matched"), F.lit(0.0).alias("total_cost"), F.array(F.coalesce(error, F.lit("Unknown error"))).alias("errors"))


def read_with_retries(files: DataFrame, reader_at: Callable[[int], Reader], dpi: int = 200, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pages, failures): files(file_id, path, content) read at `dpi`; files whose text is too short are read again, at a higher
    resolution each time, `most` times at most, and then fail. Only what failed is read again. Pages say at which attempt they were read."""
    workers_find_package(files.sparkSession)
    done, left = None, files
    for k in range(most + 1):
        pages = cut(left.select("path", "content").mapInPandas(reader_at(dpi), PAGES))
        ok = pages.groupBy("file_id").agg(F.array_join(F.collect_list("text"), "\n").alias("t")).filter(route_extraction(F.col("t"), F.lit(k), most) == "parse").select("file_id")
        good = pages.join(ok, "file_id", "left_semi").withColumn("attempt", F.lit(k + 1))
        done = good if done is None else done.unionByName(good)
        left = left.join(ok, "file_id", "left_anti")
        dpi = int(files.sparkSession.range(1).select(next_dpi(F.lit(dpi))).head()[0])
        if not left.limit(1).count():
            break
    return done, failures(left, F.lit("too little text after all retries"))


def mail_jobs(decisions: DataFrame, attachments: DataFrame) -> DataFrame:
    """A row per PDF of every accepted message: message_id, file_id, content; what `analyze` is run on in `foreachBatch`."""
    accepted = decisions.filter(F.col("decision") == "process").select("message_id")
    fine = (F.length("content") <= MAX_MB * 1024 * 1024) & (F.substring("content", 1, 5).cast("string") == "%PDF-")
    return attachments.join(accepted, "message_id", "left_semi").filter(fine).select("message_id", F.concat_ws("/", F.col("message_id").cast("string"), "filename").alias("file_id"), "content")
