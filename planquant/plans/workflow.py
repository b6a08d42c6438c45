"""The workflow around a take-off: files are split, read (again, if need be), taken off, priced and reported, with a status row for each.

Stages hand tables on, so a file that fails leaves the run at its stage and the others go on. A run appends to `root`: `items` and
`drainage` first and `status` last, each under the run's number. A run that stopped before its status is done again under the same
number; files that have succeeded are left out of later runs, files that failed are tried again. Results of a run without
status are never read (`results`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from planquant.operators.rollup import file_results
from planquant.plans.takeoff import analyze
from planquant.sources.files import needs_splitting, split_plan, split_to_fit
from planquant.sources.flow import Reader, read_with_retries
from planquant.workers import cut

STATUS = "file_id string, original_file string, first_page int, last_page int, status string, stage string, attempts int, n_pages long, n_items long, n_matched long, total_cost double, errors array<string>"


def _known(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def results(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table (items, drainage or status) over all finished runs; of a file's status rows the last run's counts."""
    status, rows = _known(spark, root, "status"), _known(spark, root, name)
    if status is None or rows is None:
        return None
    last = status.groupBy("original_file").agg(F.max("run").alias("run"))
    return rows.join(last.withColumnRenamed("original_file", "_file"), (F.col("_file") == F.col("original_file")) & (rows["run"] == last["run"]), "left_semi")


def parts_of(files: DataFrame, measured: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files with each large one as its parts: file_id, original_file, first_page, last_page. Parts that come out too large are halved,
    if there is something to measure them with."""
    large = needs_splitting(F.col("mb"), F.col("n_pages"))
    plan = split_plan(files.filter(large).select("file_id", "mb", "n_pages"))
    plan = split_to_fit(plan, measured).drop("mb") if measured is not None else plan
    split = plan.select(F.concat("file_id", F.lit("_part"), (F.col("part_no") + 1).cast("string")).alias("part"), "file_id", "first_page", "last_page")
    whole = files.filter(~large).select(F.col("file_id").alias("part"), "file_id", F.lit(1).alias("first_page"), F.col("n_pages").cast("int").alias("last_page"))
    return whole.unionByName(split).select(F.col("part").alias("file_id"), F.col("file_id").alias("original_file"), "first_page", "last_page")


def run_workflow(files: DataFrame, reader_at: Callable[[int], Reader], root: str, catalog: DataFrame | Callable[[], DataFrame] | None = None, measured: Callable[[DataFrame], DataFrame] | None = None, dpi: int = 200, retries: int = 2, **options) -> DataFrame:
    """Takes files(file_id, path, content, mb, n_pages) through all stages; gives this run's status rows, a row for each part of a file.

    Readers are given path and content, the path with `#first-last` behind it; they give this path as file_id, and count pages from 1
    within the range. `catalog` may be a
    function, so that a price list that can't be read leaves items without prices and its error in the status (pricing_failed).
    Files without a row in `content` or without pages fail at reading. `options` go to `analyze`."""
    spark = files.sparkSession
    before = _known(spark, root, "status")
    run = 1
    if before is not None:
        run = (before.agg(F.max("run")).head()[0] or 0) + 1
        done = results(spark, root, "status").groupBy("original_file").agg(F.min((F.col("status") != "failed").cast("int")).alias("fine")).filter("fine = 1")
        files = files.join(done.select(F.col("original_file").alias("file_id")), "file_id", "left_anti")
    errors: list[str] = []
    if callable(catalog) and not isinstance(catalog, DataFrame):
        try:
            catalog = catalog()
            catalog.limit(1).count()
        except Exception as e:  # whatever a price list fails with: the take-off goes on without it
            catalog, errors = None, [f"pricing failed: {type(e).__name__}"]
    parts = cut(parts_of(files, measured))
    place = F.concat("path", F.lit("#"), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))
    given = parts.join(files.select(F.col("file_id").alias("original_file"), "path", "content"), "original_file").select(F.col("file_id").alias("part"), place.alias("path"), "content")
    pages, failed = read_with_retries(given.select(F.col("path").alias("file_id"), "path", "content"), reader_at, dpi, retries)
    part_of = given.select(F.col("path").alias("file_id"), "part")
    back = lambda df: df.join(part_of, "file_id").drop("file_id").withColumnRenamed("part", "file_id")
    pages, failed = cut(back(pages)), back(failed)
    found = analyze(pages.select("file_id", "page_num", "text"), catalog, **options)
    origin = parts.select("file_id", "original_file", F.col("first_page").alias("_first"))
    items = found.items.join(origin, "file_id").withColumn("page_num", F.col("page_num") + F.col("_first") - 1).drop("_first")
    items.write.mode("overwrite").parquet(f"{root}/items/run={run}")
    found.drainage.join(origin.drop("_first"), "file_id").write.mode("overwrite").parquet(f"{root}/drainage/run={run}")
    read = pages.groupBy("file_id").agg(F.max("attempt").alias("attempts"), F.count(F.lit(1)).alias("n_read"))
    kept = spark.read.parquet(f"{root}/items/run={run}")
    for c, kind in (("matched", "boolean"), ("match_source", "string"), ("line_cost", "double")):
        kept = kept if c in kept.columns else kept.withColumn(c, F.lit(None).cast(kind))
    counted = file_results(kept, parts.select("file_id"))
    j = parts.join(read, "file_id", "left").join(failed.select("file_id", F.col("errors").alias("_errors")), "file_id", "left").join(counted.select("file_id", "n_items", "n_matched", "total_cost"), "file_id")
    bad = F.col("n_read").isNull()
    said = F.array(*map(F.lit, errors)) if errors else F.expr("cast(array() as array<string>)")
    status = j.select(
        "file_id", "original_file", "first_page", "last_page",
        F.when(bad, "failed").when(F.lit(bool(errors)), "pricing_failed").otherwise("success").alias("status"),
        F.when(bad, "read").when(F.lit(bool(errors)), "price").otherwise("report").alias("stage"),
        F.coalesce("attempts", F.lit(retries + 1)).cast("int").alias("attempts"), F.coalesce("n_read", F.lit(0)).cast("long").alias("n_pages"), "n_items", "n_matched", "total_cost",
        F.when(bad, F.coalesce("_errors", F.array(F.lit("no pages")))).otherwise(said).alias("errors"),
    )
    status.write.mode("overwrite").parquet(f"{root}/status/run={run}")
    return spark.read.schema(STATUS).parquet(f"{root}/status/run={run}")

