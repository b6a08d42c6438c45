"""Files and pages before and after reading, with readers that stand for outside engines."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from planquant.functions.arrays import running
from planquant.operators import catalog, structures
from planquant.plans.takeoff import analyze
from planquant.sources import flow, sinks


def test_pdf_lists_raise(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "A.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "empty").mkdir()
    assert [r["filename"] for r in flow.checked_pdfs(spark, str(tmp_path)).collect()] == ["A.pdf", "b.PDF"]
    for bad in ("none", "empty", "x.txt"):
        with pytest.raises(ValueError):
            flow.checked_pdfs(spark, str(tmp_path / bad))


def test_files_are_read_again_at_a_higher_resolution(spark):
    files = spark.createDataFrame([("a", "a", b""), ("b", "b", b""), ("c", "c", b"")], "file_id string, path string, content binary")

    def reader_at(dpi):
        def read(batches):
            for batch in batches:
                good = [("long text " * 9) if p == "a" or (p == "b" and dpi >= 250) else "x" for p in batch["path"]]
                yield pd.DataFrame({"file_id": batch["path"], "page_num": 1, "text": good, "confidence": 0.9, "block_count": 1, "method": f"ocr at {dpi}"})

        return read

    pages, failed = flow.read_with_retries(files, reader_at)
    assert {(r["file_id"], r["method"]) for r in pages.collect()} == {("a", "ocr at 200"), ("b", "ocr at 250")}
    assert [(r["file_id"], r["success"]) for r in failed.collect()] == [("c", False)]


def test_boundaries(spark):
    pages = spark.createDataFrame([("f", 1, "ROP " * 1000), ("f", 2, None)], "file_id string, page_num int, text string")
    got = flow.cleaned_by(pages, lambda s: s.str.replace("ROP", "RCP")).orderBy("page_num").collect()
    assert got[0]["text"] == "RCP " * 750 + "ROP " * 250 and got[1]["text"] is None
    items = spark.createDataFrame([("f", 1, 5.0), ("f", 2, 6.0)], "file_id string, item_no int, quantity double")
    issues = spark.createDataFrame([("f", 1, "typo", "high", 50.0), ("f", 1, "unit", "low", None)], "file_id string, item_no int, issue string, severity string, quantity double")
    assert [(r["quantity"], r["ai_issues"]) for r in flow.validated_by(items, issues).orderBy("item_no").collect()] == [(50.0, ["typo", "unit"]), (6.0, None)]
    mails = spark.createDataFrame([(1, "process"), (2, "rate_limited")], "message_id int, decision string")
    parts = spark.createDataFrame([(1, "a.pdf", b"%PDF-1"), (1, "b.pdf", b"nope"), (2, "c.pdf", b"%PDF-1")], "message_id int, filename string, content binary")
    assert [r["file_id"] for r in flow.mail_jobs(mails, parts).collect()] == ["1/a.pdf"]
    errors = spark.createDataFrame([("Timeout after 120 s",), ("broken",)], "e string")
    assert [r["x"] for r in errors.select(flow.failed_page(F.col("e")).alias("x")).collect()] == ["[OCR TIMEOUT]", "[OCR FAILED: broken]"]


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 32, 33, 100, 1000):
        row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x % 7).alias("a")).select("a", running(F.col("a"), 0, lambda s, x: s + x).alias("r")).head()
        want = [0]
        for x in row["a"]:
            want.append(want[-1] + x)
        assert row["r"] == want


def test_sizes_are_quoted_in_patterns():
    import re

    for size in ("18 (NOM", "4.5+", "[x"):
        for p in catalog.search_patterns("RCP_Price_List", "Round RCP", size, "CL III"):
            re.compile(p)


def test_closest_subtype_takes_the_first_code_of_ties(spark):
    table = spark.createDataFrame([("2", "INLET", "TYPE A1", 5.0, "x"), ("1", "INLET", "TYPE A2", 6.0, "x"), ("0", "MANHOLE", "TYPE A", 7.0, "x")], "fdot_code string, type string, subtype string, price double, depth string")
    wanted = spark.createDataFrame([("INLET", "TYPE A", "x"), ("INLET", "QQQQQQ", "y")], "type string, subtype string, depth string")
    assert [(r["subtype"], r["fdot_code"]) for r in structures.closest_subtype(table, wanted).collect()] == [("TYPE A", "1")]


def test_codes_of_subtypes_follow_the_ratio(spark):
    from difflib import SequenceMatcher

    from planquant.functions import rules

    table = structures.structure_codes(spark)
    rows = table.collect()
    wanted = [(t, s, d) for t in ("INLET", "MANHOLE", "WELL") for s in ("TYPE D MODIFIED", "type 7", "DITCH BOTTOM TYPE", "CURB P-6", "MODIFIED P", "STANDARD", "QQQ", None, "", "BOTTOM DITCH TYPE E") for d in (None, "<6'", rows[0]["depth"])]
    got = {(r["type"], r["subtype"], r["depth"]): (r["fdot_code"], r["price"], r["found"]) for r in structures.code_lookup(spark.createDataFrame(wanted, "type string, subtype string, depth string"), table).collect()}
    for t, s, d in wanted:
        up = (s or "").upper()
        default = rules.DEFAULT_STRUCTURES.get(t, structures.FALLBACK)
        scores = [(-(SequenceMatcher(None, up, r["subtype"].upper()).ratio() + (0.1 if d and r["depth"] == d else 0.0)), r["fdot_code"], r["price"]) for r in rows if r["type"] == t]
        best = min(scores, default=(0, "", 0))
        want = (*rules.SUBTYPE_CODES[up], "direct") if up in rules.SUBTYPE_CODES else (*default, "standard") if up == "STANDARD" else (*best[1:], "closest") if up and -best[0] > 0.5 else (*default, "default")
        assert got[(t, s, d)] == want, (t, s, d)


def test_csv_report_quotes(spark):
    items = spark.createDataFrame([("f", "1", 'pipe, 18" "x"', "LF", 2.0)], "file_id string, pay_item_no string, description string, unit string, quantity double")
    for c in ("unit_price", "line_cost", "confidence_score"):
        items = items.withColumn(c, F.lit(None).cast("double"))
    for c in ("page", "source", "confidence", "match_source", "ai_match_reason"):
        items = items.withColumn(c, F.lit(None).cast("string"))
    items = items.withColumn("matched", F.lit(False)).withColumn("needs_verification", F.lit(False))
    review = spark.createDataFrame([("f", "zero quantity")], "file_id string, reason string")
    (row,) = sinks.csv_report(items, review=review).collect()
    lines = row["report"].split("\n")
    assert lines[1].startswith('1,"pipe, 18"" ""x""",LF,2.0') and lines[2:] == ["", "ITEMS NEEDING REVIEW", "reason", "zero quantity"]


def test_items_of_several_pages_count_once(spark):
    pages = spark.createDataFrame([("f", 1, "430-175-118 PIPE CULVERT LF 45\nINLET #3"), ("f", 2, "430-175-118 PIPE CULVERT LF 45\nINLET #3\nHDPE 24 ;\nHDPE 24 ;"), ("f", 3, "HDPE 24 ;")], "file_id string, page_num int, text string")
    blocks = spark.createDataFrame([("f", 2, 0, "430-175-118 PIPE CULVERT LF 45", None, 0.7)], "file_id string, page int, block_no int, text string, bbox array<array<double>>, confidence double")
    out = analyze(pages, None, validate=False, blocks=blocks)
    got = {(r["pay_item_no"], r["page_num"], r["mentions"]): r for r in out.items.collect()}
    assert set(got) == {("430-175-118", 1, None), ("INLET", 1, None), ("HDPE-24", 2, 3)}
    assert got[("430-175-118", 1, None)]["source_location"]["page"] == 2
    out.release()
