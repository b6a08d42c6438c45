"""Sinks: a nested JSON record per file, CSV sections, a one-row batch record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planquant.functions.arrays import let
from planquant.functions.text import contains_any
from planquant.operators.rollup import batch_summary, csv_rows, takeoff_report


def json_reports(items: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, report): a file's roll-up and its items in order, nested. A file's items are bounded by the file."""
    nested = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "pay_item_no", "description", "unit", "quantity", "unit_price", "line_cost", "source"))), lambda x: x.dropFields("item_no")).alias("pay_items"))
    totals = takeoff_report(items, key)
    summary = F.struct(*[c for c in totals.columns if c != key])
    return totals.join(nested, key).select(key, F.to_json(F.struct(summary.alias("summary"), "pay_items")).alias("report"))


def write_json_reports(items: DataFrame, path: str, key: str = "file_id") -> None:
    json_reports(items, key).select(key, F.col("report").alias("value")).write.partitionBy(key).text(path)


def write_csv_sections(path: str, items: DataFrame, **sections: DataFrame) -> None:
    """The item table and further sections (drainage, review, materials), each a folder of CSV files."""
    csv_rows(items).write.csv(f"{path}/items", header=True)
    for name, rows in sections.items():
        rows.write.csv(f"{path}/{name}", header=True)


def write_batch_summary(results: DataFrame, path: str) -> None:
    batch_summary(results).write.json(path)


def _cell(c: Column) -> Column:
    """A CSV cell, quoted where it has to be."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(contains_any(s, ('"', ",", "\n", "\r")), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_report(items: DataFrame, key: str = "file_id", drainage: DataFrame | None = None, review: DataFrame | None = None, pipes: DataFrame | None = None, structures: DataFrame | None = None) -> DataFrame:
    """(key, report): one CSV text per file, its item table first and then the sections that it has, each with its title and
    header. All tables have the key; rows are ordered by their cells. A file's rows are bounded by the file."""

    heads: list[tuple[int, list[str]]] = []

    def lines(df: DataFrame, section: int, title: str | None) -> DataFrame:
        columns = [c for c in df.columns if c != key]
        heads.append((section, ([""] if section else []) + ([title] if title else []) + [",".join(columns)]))
        return df.select(key, F.lit(section).alias("s"), F.concat_ws(",", *[_cell(F.col(f"`{c}`")) for c in columns]).alias("line"))

    out = lines(csv_rows(items, key), 0, None)
    for section, title, df in ((1, "DRAINAGE STRUCTURES", drainage), (2, "ITEMS NEEDING REVIEW", review), (3, "PIPE SUMMARY", pipes), (4, "STRUCTURE SUMMARY", structures)):
        if df is not None:
            out = out.unionByName(lines(df, section, title))
    # Titles and headers are put before a file's own rows; a table is read once.
    own = lambda a, n: F.transform(F.filter(a, lambda x: x["s"] == n), lambda x: x["line"])
    part = lambda a, n, head: let(own(a, n), lambda rows: F.when(F.size(rows) > 0, F.concat(F.array(*map(F.lit, head)), rows)).otherwise(rows))
    whole = lambda a: F.array_join(F.concat(*[part(a, n, head) for n, head in heads]), "\n")
    return out.groupBy(key).agg(let(F.array_sort(F.collect_list(F.struct("s", "line"))), whole).alias("report"))
