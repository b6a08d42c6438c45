"""What makes queries grow: expressions copied by the optimizer, work on equal rows done again, rows held that needn't be."""

from pyspark.sql import functions as F

from planquant.functions import text as T
from planquant.operators import extract as E, geometry, pricing, products, summary
from planquant.sources import sinks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_multiline_fields_are_computed_once(spark):
    pages = spark.createDataFrame([(1, "430-175-118\n12,5\n12,5\nCONCRETE PIPE\nLF\n425-1-1\n7\nINLET TOP\n\nEA\n999-1-1\nX")], "file_id long, text string").repartition(1)
    items = E.multiline_items(pages, ["file_id"])
    assert sorted(map(tuple, items.select("pay_item_no", "description", "quantity", "unit", "hit").collect())) == [("425-1-1", "INLET TOP", 7.0, "EA", 5), ("430-175-118", "CONCRETE PIPE", 125.0, "LF", 0)]
    # Each copy of the lines behind a code is a slice of its own.
    assert plan(items).count("slice(") <= 2


def test_double_reads_what_a_cast_reads(spark):
    values = ["1", " 1.5 ", "1.", ".5", "-2e3", "+7f", "3D", "NaN", "nan", "Infinity", "-inf", "0x1p3", "\t4\n", "1,000", "LF", "", "430-175-1", "1e", "\x01 9", "٣", ".", "e5", None]
    rows = spark.createDataFrame([(v,) for v in values], "s string").select("s", F.col("s").try_cast("double").alias("a"), T.to_double(F.col("s")).alias("b"))
    assert rows.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_boxes_of_many_pages_are_clustered_together(spark):
    import random

    rng = random.Random(3)
    rows = [(f, k, [[float(x), float(y)], [x + 9.0, float(y)], [x + 9.0, y + 4.0], [float(x), y + 4.0]]) for f in [*range(300), None] for k in range(rng.choice([1, 3, 40])) for x, y in [(rng.randrange(600), rng.randrange(600))]]
    want = []
    for f in {r[0] for r in rows}:
        free, n = sorted((r for r in rows if r[0] == f), key=lambda r: r[1]), 0
        while free:
            (x1, y1), (x2, y2) = free[0][2][0], free[0][2][2]
            near = [r for r in free if max(x1, r[2][0][0]) - min(x2, r[2][2][0]) <= 50 and max(y1, r[2][0][1]) - min(y2, r[2][2][1]) <= 50]
            free = [r for r in free if r not in near]
            want.append((f, n, min(r[2][0][0] for r in near), max(r[2][2][1] for r in near), len(near)))
            n += 1
    boxes = spark.createDataFrame(rows, "file_id long, block_no int, bbox array<array<double>>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = geometry.merged_boxes(boxes, ["file_id"])
        assert "FlatMapGroupsInPandas" not in plan(found)
        got = [(r.file_id, r.cluster_no, r.bbox[0][0], r.bbox[2][1], r.n_boxes) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equal_items_and_blocks_meet_once(spark, monkeypatch):
    met = []
    candidates = E._candidates

    def seen(items, blocks, keys, item_key):
        out = candidates(items, blocks, keys, item_key)
        met.append(out.count())
        return out

    monkeypatch.setattr(E, "_candidates", seen)
    items = spark.createDataFrame([(1, k, "Blue PIPE", None if k % 2 else "large") for k in range(40)], "file_id int, item_no int, source_text string, description string")
    blocks = spark.createDataFrame([(1, 1, k, ("see BLUE pipe", "Large blue", "See blue pipe", "none")[k % 4], None, 0.9) for k in reversed(range(40))], "file_id int, page int, block_no int, text string, bbox array<array<double>>, confidence double")
    got = E.located(items, blocks, ["file_id"], "item_no").select("item_no", "source_location.text_context").collect()
    assert sorted(map(tuple, got)) == [(k, "see BLUE pipe") for k in range(40)]
    assert met == [4]


def test_hits_of_products_are_found_once(spark):
    hits = spark.createDataFrame([(1, "a", 0.95, 0.0, "LF", 0, 0), (1, "a", 0.6, 7.0, "EA", 1, 0), (1, "a", 0.5, 9.0, "LF", 1, 1), (1, "b", 0.3, 0.0, "LF", 0, 0), (2, "a", 0.9, 3.0, "LF", 0, 0), (2, "a", 0.8, 4.0, "LF", 1, 0), (3, "a", 0.7, 0.0, "LF", 0, 0), (3, "a", 0.4, 5.0, "LF", 1, 0)], "file_id int, id string, confidence double, quantity double, unit string, pattern_no int, hit int")
    best = products.best_per_product(hits, ["file_id"])
    assert "Join" not in plan(best)
    got = best.select("file_id", "id", "quantity", "confidence", "unit").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 7.0, 0.6, "EA"), (1, "b", 0.0, 0.3, "LF"), (2, "a", 3.0, 0.9, "LF"), (3, "a", 0.0, 0.7, "LF")]


def test_summary_lines_are_read_within_their_page(spark):
    sheet = "SUMMARY\n12\n430-175-118\nPIPE\n1,200\nLF\n7\n425-1-1\nINLET\n3\nEA\n4\n"
    pages = spark.createDataFrame([(1, sheet), (2, None), (3, "425-1-2\nBOX\n5\n\n")], "file_id long, text string")
    for found, want in (
        (summary.standard_items(pages, ["file_id"]), [(1, 2, "430-175-118", "PIPE", 1200.0, "LF", 12), (1, 7, "425-1-1", "INLET", 4.0, "EA", 7), (3, 0, "425-1-2", "BOX", 5.0, "EA", None)]),
        (summary.tabulated_items(pages, ["file_id"]), [(1, 2, "430-175-118", "PIPE", 7.0, "LF", None), (1, 7, "425-1-1", "INLET", 4.0, "EA", None), (3, 0, "425-1-2", "BOX", 5.0, "EA", None)]),
    ):
        assert sorted(map(tuple, found.drop("confidence").collect())) == want
        # Neither sorted nor gathered: a task holds a page.
        assert not any(x in plan(found) for x in ("Window", "Sort", "Aggregate"))


def test_inline_items_are_computed_once(spark):
    pages = spark.createDataFrame([(1, 'ITEM 430-175-118 PIPE, 24" LF 30\nITEM 425-1-1 INLET OF STEEL 5 EA')], "file_id long, text string")
    found = summary.inline_items(pages, ["file_id"])
    assert sorted(map(tuple, found.select("pay_item_no", "description", "quantity", "unit").collect())) == [("425-1-1", "ITEM INLET OF STEEL", 5.0, "EA"), ("430-175-118", 'ITEM PIPE, 24"', 30.0, "LF")]
    assert len(plan(found)) < 60_000


def test_strategies_are_cut_before_they_meet(spark):
    pages = spark.createDataFrame([(1, 1, "430-175-118 PIPE LF 30 ;\nRCP 24 ;\nMH 3")], "file_id long, page_num int, text string")
    found = E.extract_items(pages, ["file_id"])
    assert "regexp_extract_all" not in plan(found)
    assert sorted(r.pay_item_no for r in found.collect()) == ["430-175-118", "MANHOLE", "RCP-24"]


def test_covered_callouts_need_no_join_of_items(spark):
    rows = [(1, "fdot", '24" RCP', "430-1"), (1, "callout", "x", "RCP-24"), (1, "callout", "x", "RCP-30"), (2, "callout", "x", "RCP-24"), (None, "fdot", '24" RCP', "430-1"), (None, "callout", "x", "RCP-24")]
    found = E.without_covered_callouts(spark.createDataFrame(rows, "file_id long, source string, description string, pay_item_no string"), ["file_id"])
    assert "Join" not in plan(found)
    assert sorted((str(r.file_id), r.pay_item_no) for r in found.filter("source = 'callout'").collect()) == [("1", "RCP-30"), ("2", "RCP-24"), ("None", "RCP-24")]


def test_table_lines_sort_nothing(spark):
    pages = spark.createDataFrame([(1, "a  b  c\nd  e  f\nx\ng  h  i\n\nj  k  l\nm  n  o"), (2, None)], "file_id long, text string")
    found = E.table_lines(pages, ["file_id"])
    assert not any(x in plan(found) for x in ("Window", "Sort"))
    assert sorted((r.line_no, r.cells[0]) for r in found.collect()) == [(0, "a"), (1, "d"), (5, "j"), (6, "m")]


def test_gated_quantities_write_no_warnings(spark):
    pages = spark.createDataFrame([(1, '20000 LF 24" RCP\n30 LF 18" PVC\n1000 LF 18" PVC')], "file_id long, text string")
    found = E.quantity_first_items(pages, ["file_id"])
    assert "Suspicious" not in plan(found)
    assert sorted(r.quantity for r in found.collect()) == [30.0, 1000.0]


def test_misreading_rules_only_run_where_they_can_match(spark):
    from functools import reduce

    words = ["tipe", "24 ROP", "h0pe", "END  WALL", "1F", "12 inch", '24"1NCH', "A0B", "1X", "PAY 1TEM", "EX.", "18 IN", "manhoi3 #4", "30” HDPE", "é", None]
    rows = spark.createDataFrame([(f"{a} {b}" if a and b else a,) for a in words for b in words], "s string")
    plainly = reduce(lambda out, rule: F.regexp_replace(out, *rule), (*T.rules.OCR_FIXES, *T.rules.SIZE_FIXES), F.upper("s"))
    assert rows.filter(~T.clean_ocr(F.col("s")).eqNullSafe(plainly)).collect() == []
    assert T.needed_strings(r"\bR[C0]P\b") == ["RCP", "R0P"] and T.needed_strings(r"\d+\s*(AB|CD)") == ["AB", "CD"] and T.needed_strings(r"\d+(A|\d)") == []
    assert "contains" in plan(rows.select(T.clean_ocr(F.col("s"))))


def test_csv_report_reads_each_table_once(spark):
    columns = "file_id long, pay_item_no string, description string, unit string, quantity double, unit_price double, line_cost double, page int, source string, confidence string, confidence_score double, needs_verification boolean, matched boolean, match_source string, ai_match_reason string"
    items = spark.createDataFrame([(f, "1-2", d, "LF", 2.0, None, None, 1, "s", "high", None, False, False, None, None) for f, d in ((1, "b, c"), (1, 'a "x"'), (2, "d"))], columns)
    pipes = spark.createDataFrame([(1, "24", "RCP")], "file_id long, size string, material string")
    found = sinks.csv_report(items, pipes=pipes)
    assert plan(found).count("LogicalRDD") == 2
    texts = {r.file_id: r.report.split("\n") for r in found.collect()}
    assert [x[:13] for x in texts[1][1:3]] == ['1-2,"a ""x"""', '1-2,"b, c",LF'] and texts[1][3:] == ["", "PIPE SUMMARY", "size,material", "24,RCP"]
    assert len(texts[2]) == 2 and texts[2][0].startswith("Pay Item No,")


def test_products_of_equal_words_are_compared_once(spark):
    listed = spark.createDataFrame([(k, "Blue Pump", "", ("large", "small")[k % 2], float(k), "EA", f"c{k}", "x") for k in range(20)], "row_no long, product_type string, size string, configuration string, price double, unit string, fdot_code string, category string")
    items = spark.createDataFrame([("i", "blue pump small", "")], "item_no string, description string, size_of_item string")
    found = pricing.by_tokens(items, pricing.with_fdot(listed), "item_no")
    assert [(r.item_no, r.product.fdot_code) for r in found.collect()] == [("i", "c1")]
    assert "Aggregate [ct" in plan(found)


def test_patterns_run_where_they_can_match(spark):
    import random
    import re

    from planquant.functions import rules

    assert T.needed_clauses(r"\b(MANHOLE|MH)\b(?!\s*\d)") == [["MANHOLE", "MH"]] and T.needed_clauses(r"(?:ab+|\d)?[xX×]\s*(é|B)(?:CD){2}") == [["CD"], ["X", "×"]]
    tables = (rules.QUANTITY_FIRST, rules.ELLIPTICAL, rules.ELLIPTICAL_ENDS, rules.STRUCTURE_ITEMS, rules.GALVANIZED, rules.CALLOUTS)
    patterns = [*dict.fromkeys([r[0] for t in tables for r in t] + [p for p, _ in E._FDOT] + list(E._LABELS) + [p for p, _ in rules.GENERIC_LABELS])]
    words = ["430-175-118", "PIPE", "rcp", "HDPE", "Lf", "EA", "12", '24"', "14x23", "19”×30”", "ERCP", "Ellip", "FE", "Flared End", "mes", "4:1", "MITERED", "end", "STRAIGHT", "WINGED", "WALL", "U-Type", "cradle", "GALV", "RUN", "@", "(", ")", "-", "—", "INLET", "#3", "mh", "CATCH  BASIN", "cb", "JB", "JUNCTION", "BOX", "ı", "ſ", "\n"]
    rng = random.Random(5)
    pages = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(4000)], "n int, text string")
    seen = pages.select(*[F.struct(F.regexp_like("text", F.lit("(?i)" + p)).alias("has"), T.may_match(F.upper("text"), p).alias("may")).alias(f"p{k}") for k, p in enumerate(patterns)])
    counts = seen.agg(*[F.struct(F.count_if(F.expr(f"p{k}.has and not p{k}.may")).alias("lost"), F.count_if(F.expr(f"p{k}.has")).alias("had"), F.count_if(F.expr(f"not p{k}.may")).alias("left")).alias(f"p{k}") for k in range(len(patterns))]).head()
    assert all(c["lost"] == 0 and c["left"] > 0 for c in counts) and sum(c["had"] > 0 for c in counts) > 30
    # A page without any of the strings meets no pattern.
    hits = E._hits(pages.withColumnRenamed("n", "file_id"), ["file_id"], "text", [(r[0], 2) for r in rules.ELLIPTICAL_ENDS])
    assert re.search(r"Filter.*[Cc]ontains", plan(hits))


def test_labels_without_numbers_are_mentions(spark):
    pages = spark.createDataFrame([(1, 1, "MH-3 INLET"), (1, 2, "MANHOLE MANHOLE, INLET TOP"), (2, 1, "catch basin"), (None, 1, "INLET #1"), (None, 2, "INLET")], "file_id long, page_num int, text string")
    items = E.drainage_labels(pages, ["file_id"])
    assert sorted(map(repr, items.select("file_id", "description", "mentions").collect())) == sorted(map(repr, [r for r in spark.createDataFrame([(1, "MANHOLE #3", None), (1, "INLET (VERIFY QTY)", 2), (2, "CATCH BASIN (VERIFY QTY)", 1), (None, "INLET #1", None), (None, "INLET (VERIFY QTY)", 1)], "file_id long, description string, mentions int").collect()]))
    assert "LeftAnti" not in plan(items)


def test_prices_are_asked_of_distinct_items(spark, monkeypatch):
    asked = []
    matched = pricing.matched_products

    def seen(questions, catalog, key):
        asked.append((plan(questions), questions.count()))
        return matched(questions, catalog, key)

    monkeypatch.setattr(pricing, "matched_products", seen)
    items = spark.range(500).select(F.col("id").alias("item_no"), F.lit("430-1").alias("pay_item_no"), F.concat(F.lit("PIPE "), (F.col("id") % 3).cast("string")).alias("description"), F.lit(2.0).alias("quantity"))
    catalog = spark.createDataFrame([(0, "A", "Pipe", '24"', "", 3.0, "LF", "430-1")], "row_no long, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string")
    priced = pricing.priced(items, catalog)
    assert asked[0][1] == 3 and "Aggregate" not in asked[0][0] and "Range" not in asked[0][0]
    assert priced.filter("matched and line_cost = 6").count() == 500


def test_pages_of_a_file_are_made_from_one_read():
    import os

    import pytest
    from pyspark.sql import SparkSession

    from planquant.plans import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    pages = queries.full_pages(spark, data)
    assert plan(pages).count("Join") == 1
    assert pages.groupBy("file_id").agg(F.count("text").alias("n")).filter("n <> 4").count() == 0


def test_products_are_broadcast_not_hits(spark, tmp_path):
    from planquant.operators import catalog as C

    spark.range(50).select(F.col("id").alias("file_id"), F.lit('24" RCP CLASS III - 120 LF').alias("text")).write.parquet(f"{tmp_path}/pages")
    rows = [(0, "A", "RCP_Price_List", "Round RCP", '24"', "CL III", 7.5, "LF", "", "")]
    catalog = C.with_patterns(C.with_keywords(spark.createDataFrame(rows, "row_no long, id string, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string, notes string")))
    hits = products.product_hits(spark.read.parquet(f"{tmp_path}/pages"), catalog, ["file_id"])
    physical = hits._jdf.queryExecution().sparkPlan().toString()
    # The pages' file is small, and so is the optimizer's guess of its hits.
    assert "BuildRight" in physical and "BuildLeft" not in physical
    assert hits.select("file_id").distinct().count() == 50
