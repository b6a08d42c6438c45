"""Known facts of the take-off domain, property checks, and the pipeline end to end."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from planquant.functions import text as T
from planquant.operators import extract as E, gates as G, geometry, layout, pages as P, pricing, products, review, rollup, structures, summary
from planquant.operators.catalog import products as parse_products, search_patterns, with_keywords, with_patterns
from planquant.plans.takeoff import analyze
from planquant.sources import files, sinks
from planquant.streaming import mail


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("given,want", [('18"', "18"), ("18'", "18"), ('14"X23"', "14X23"), ("14 X 23", "14X23")])
def test_size_key(spark, given, want):
    assert one(spark, T.size_key(F.col("s")), s=given) == want


@pytest.mark.parametrize("given,want", [("1,500", 1500.0), ("1,234,567", 1234567.0), ("450.5", 450.5), ("x", 0.0)])
def test_parse_number(spark, given, want):
    assert one(spark, T.parse_number(F.col("s")), s=given) == want


@pytest.mark.parametrize("q,unit,want", [(18.0, "LF", False), (24.0, "LF", False), (100.0, "LF", True), (1500.0, "LF", True), (48.0, "EA", False), (6.0, "EA", True)])
def test_plausible(spark, q, unit, want):
    assert one(spark, products.plausible_quantity(F.col("q"), F.col("u")), q=q, u=unit) is want


@pytest.mark.parametrize(
    "context,unit,want",
    [('18" RCP CL III - 450 LF more text here', "LF", (450.0, "LF")), ('450 LF of 18" RCP CL III', "LF", (450.0, "LF")), ("1,500 LF", "LF", (1500.0, "LF")), ("450 LINEAR FEET", "LF", (450.0, "LF")), ("2 EACH", "EA", (2.0, "EA"))],
)
def test_quantity_near(spark, context, unit, want):
    got = one(spark, products.quantity_near(F.col("c"), F.col("u"), F.col("a"), F.col("b")), c=context, u=unit, a=0, b=7)
    assert (got["quantity"], got["unit"]) == want


@pytest.mark.parametrize("size,q,want", [(51, 18.0, (18, 51.0)), (18, 51.0, (18, 51.0)), (120, 24.0, (24, 120.0))])
def test_swap(spark, size, q, want):
    got = one(spark, T.swap_size_quantity(F.col("s"), F.col("q")), s=size, q=q)
    assert (got["size"], got["quantity"]) == want


@pytest.mark.parametrize("q,unit,want", [(12000.0, "LF", "reject"), (500.0, "LF", "warning"), (6000.0, "LF", "warning"), (2.0, "LS", "reject"), (60.0, "EA", "warning"), (37.0, "LF", None)])
def test_quantity_gate(spark, q, unit, want):
    w = one(spark, G.quantity_warnings(F.col("q"), F.col("u")), q=q, u=unit)
    assert [x["severity"] for x in w] == ([want] if want else [])


@pytest.mark.parametrize("text,code,price,confidence", [("TYPE D INLET (MODIFIED)", "425-1-549", 5800.0, 0.95), ("MANHOLE, TYPE 7 STRUCTURE", "425-2-41", 5500.0, 0.95), ("INLET #35", "425-1-541", 4200.0, 0.70)])
def test_structure(spark, text, code, price, confidence):
    got = one(spark, structures.structure_of(F.col("s")), s=text)
    assert (got["fdot_code"], got["unit_price"], got["confidence"]) == (code, price, confidence)


def test_depth_and_number(spark):
    assert one(spark, structures.depth_bucket(F.col("s")), s="5-7' DEEP") == "6'-8'"
    assert one(spark, structures.structure_number(F.col("s")), s="MH #103") == "103"


@pytest.mark.parametrize(
    "text,check",
    [
        ("", lambda q: q["product_keywords_found"] == 0 and not q["needs_vision"]),
        ('RCP 18" PVC HDPE CMP', lambda q: q["product_keywords_found"] >= 4),
        ("INLET MANHOLE CATCH BASIN ENDWALL", lambda q: q["product_keywords_found"] >= 4),
        ('51 LF 18" RCP CLASS III', lambda q: q["complete_items_found"] >= 1),
        ('430-175-118 PIPE CULVERT 18" LF 98', lambda q: q["complete_items_found"] >= 1),
        ("RCP 24\nRCP 18\nPVC 12", lambda q: q["callouts_without_quantity"] >= 1),
        ("RCP INLET MANHOLE PIPE", lambda q: q["needs_vision"] and any("product_keywords_found" in r for r in q["reasons"])),
        ("PIPE SCHEDULE\nQTY SIZE LENGTH\nRCP", lambda q: q["has_pipe_schedule"] and q["has_complex_tables"] and q["needs_vision"]),
    ],
)
def test_page_quality(spark, text, check):
    assert check(one(spark, P.page_quality(F.col("s")), s=text))


ITEMS = "description string, quantity double, unit string"


@pytest.mark.parametrize(
    "rows,pipes,structs",
    [
        ([], {}, {}),
        ([('18" RCP', 100.0, "LF"), ('18" RCP', 50.0, "LF"), ('24" RCP', 75.0, "LF")], {("18", "RCP"): (150.0, 2), ("24", "RCP"): (75.0, 1)}, {}),
        ([("INLET D", 3.0, "EA"), ("INLET E", 2.0, "EA"), ("MANHOLE #1", 1.0, "EA")], {}, {"INLET": 5, "MANHOLE": 1}),
        ([('18" RCP', 5.0, "EA")], {}, {"OTHER": 5}),
        ([("INLET", None, "EA")], {}, {"INLET": 1}),
        ([('18" RCP', 0.0, "LF")], {("18", "RCP"): (0.0, 1)}, {}),
    ],
)
def test_materials(spark, rows, pipes, structs):
    items = spark.createDataFrame(rows, ITEMS)
    assert {(r["size"], r["material"]): (r["total_lf"], r["n_items"]) for r in rollup.material_pipes(items).collect()} == pipes
    assert {r["structure_type"]: r["n_structures"] for r in rollup.material_structures(items).collect()} == structs


def test_summary_page(spark):
    sheet = "SUMMARY OF QUANTITIES " + "x" * 100
    assert one(spark, P.is_summary_page(F.col("s")), s=sheet)
    assert not one(spark, P.is_summary_page(F.col("s")), s="SUMMARY OF QUANTITIES")
    assert not one(spark, P.is_summary_page(F.col("s")), s="DRAINAGE PLAN SHEET " * 10)
    assert one(spark, P.summary_type(F.col("s")), s="BID SCHEDULE") == "bid_schedule"


def test_dedup_keeps_best(spark):
    rows = [(1, "a", 1, 0, 5.0, 0.9, "x"), (1, "a", 2, 0, 5.0, 0.7, "y"), (1, "b", 0, 0, 0.0, 0.9, "z"), (1, "b", 1, 0, 7.0, 0.5, "z")]
    hits = spark.createDataFrame([(f, i, p, h, q, c, s, "LF") for f, i, p, h, q, c, s in rows], "file_id int, id string, pattern_no int, hit int, quantity double, confidence double, source_text string, unit string")
    got = {r["id"]: (r["quantity"], r["confidence"]) for r in products.best_per_product(hits, ["file_id"]).collect()}
    assert got == {"a": (5.0, 0.9), "b": (7.0, 0.5)}


def test_catalog_traps(spark):
    raw = spark.createDataFrame(
        [(0, "RCP_Price_List", "Round RCP", '18"', "CL III", "$1,020.50", "LF", "ASTM C-76", ""), (1, "End_Sections", "Straight Endwall", '14"X23"', "Single", "call for pricing", "EA", "", ""), (2, "X", "Y", "1", "z", "n/a", "EA", None, None)],
        "row_no long, Document string, Product_Type string, Size string, Configuration string, Price string, Unit string, FDOT_Code string, Notes string",
    )
    assert [r["price"] for r in parse_products(raw).orderBy("row_no").collect()] == [1020.5, 0.0]
    assert [r["price"] for r in parse_products(raw, drop_unpriced=False).orderBy("row_no").collect()] == [1020.5, 0.0, 0.0]
    assert parse_products(raw).orderBy("row_no").head()["id"] == "RCP_Price_List_Round_RCP_18_CL_III"
    assert search_patterns("Drainage_Structures", "Inlet", "x", "y") == []
    got = with_patterns(with_keywords(parse_products(raw))).orderBy("row_no").collect()
    assert got[0]["keywords"] == ["18"] and len(got[0]["patterns"]) > 50


def test_products_in_text(spark):
    raw = spark.createDataFrame([(0, "RCP_Price_List", "Round RCP", '18"', "CL III", "50", "LF", None, ""), (1, "End_Sections", "Straight Endwall", '18"', "Single", "900", "EA", None, "")], "row_no long, Document string, Product_Type string, Size string, Configuration string, Price string, Unit string, FDOT_Code string, Notes string")
    cat = with_patterns(with_keywords(parse_products(raw)))
    pages = spark.createDataFrame([(1, '18" RCP CLASS III - 450 LF'), (2, 'STRAIGHT ENDWALL 18" SINGLE - 2 EA'), (3, "30 MIL PVC GEOMEMBRANE"), (4, '18" RGP CL III - 300 LF')], "file_id int, text string")
    got = {(r["file_id"], r["category"]): r["quantity"] for r in products.product_matches(pages, cat, ["file_id"]).collect()}
    assert got[(1, "RCP_Price_List")] == 450.0 and got[(2, "End_Sections")] == 2.0 and got[(4, "RCP_Price_List")] == 300.0
    assert not any(f == 3 for f, _ in got)


def test_quirks_of_codes(spark):
    pages = spark.createDataFrame([(1, "430-175-118 PIPE CULVERT LF 1,500"), (2, "430-982-25 MITERED END EA 3")], "file_id int, text string")
    got = {(r["file_id"], r["pay_item_no"], r["quantity"]) for r in E.fdot_items(pages, ["file_id"]).collect()}
    assert (1, "430-175-118", 1.0) in got and (2, "430-982-25", 3.0) in got and (2, "982-25", 3.0) in got


def test_location(spark):
    items = spark.createDataFrame([(1, 1, '18" RCP LF 5', "pipe culvert"), (1, 2, "zzz", "nothing here")], "file_id int, item_no int, source_text string, description string")
    blocks = spark.createDataFrame([(1, 1, 0, "notes", None, 0.9), (1, 1, 1, 'see 18" RCP LF 5 here', None, 0.8)], "file_id int, page int, block_no int, text string, bbox array<array<double>>, confidence double")
    got = {r["item_no"]: r["source_location"] for r in E.located(items, blocks, ["file_id"], "item_no").collect()}
    assert got[1]["ocr_confidence"] == 0.8 and got[2] is None


def test_location_is_the_brute_force(spark):
    import random

    r = random.Random(4)
    pool = ["pipe", "culvert", "rcp", '18"', "lf", "5", "inlet", "type", "piping", "24", "ea", "x", "pip"]
    text = lambda: " ".join(r.choice(pool) for _ in range(r.randint(0, 5)))
    items = [(k % 2, k, r.choice([text(), "5", "lf", "", None]), r.choice([text(), None, "x"])) for k in range(60)]
    blocks = [(k % 2, 1, k, r.choice([text(), "", "5 lf x", "Culvert  PIPE"]), None, k / 100) for k in range(24)]

    def score(block, whole, one, of):
        return whole if of and of in block else one * sum(w in block for w in re.split(r"\s+", of) if len(w) > 2)

    want = {}
    for f, k, match, desc in items:
        best = max(((score(b[3].lower(), 100, 20, (match or "").lower()) + score(b[3].lower(), 50, 10, (desc or "").lower()), -b[2]) for b in blocks if b[0] == f), default=(0, 0))
        want[k] = -best[1] / 100 if best[0] >= 20 else None
    i = spark.createDataFrame(items, "file_id int, item_no int, source_text string, description string")
    b = spark.createDataFrame(blocks, "file_id int, page int, block_no int, text string, bbox array<array<double>>, confidence double")
    got = {x["item_no"]: x["source_location"] and x["source_location"]["ocr_confidence"] for x in E.located(i, b, ["file_id"], "item_no").collect()}
    assert got == want and None in want.values()


def test_lines_follow_the_previous_block(spark):
    rows = [(1, k, t, float(y), float(x)) for k, (t, y, x) in enumerate([("c", 20, 5), ("a", 0, 9), ("b", 10, 1), ("d", 60, 0)])]
    b = spark.createDataFrame(rows, "page int, block_no int, text string, y_center double, x_center double")
    assert [r["text"] for r in layout.lines(b, ["page"], dpi=200).orderBy("line_no").collect()] == ["a b c", "d"]


def test_vision_json(spark):
    body = '{"pay_items": [{"pay_item_no": "430-1", "description": "d", "unit": "LF", "quantity": 2.0, "confidence": "high"}], "page_summary": "s"}'
    for given in (body, f"Here:\n```json\n{body}\n```", f"Sure! {body} Done."):
        assert one(spark, files.vision_json(F.col("s")), s=given)["pay_items"][0]["quantity"] == 2.0
    assert one(spark, files.vision_json(F.col("s")), s="no") is None


def test_rate_limit_is_a_fold(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, 1, t0 + dt.timedelta(minutes=m)) for k, m in enumerate([0, 10, 20, 30, 59, 61, 62, 75])]
    ev = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp")
    got = [r["allowed"] for r in mail.rate_limited(ev, "user_id", "ts", ["event_id"], per_hour=2).orderBy("event_id").collect()]
    assert got == [True, True, False, False, False, True, False, True]
    got = [r["allowed"] for r in mail.rate_limited(ev, "user_id", "ts", ["event_id"], per_hour=9, per_day=3).orderBy("event_id").collect()]
    assert got == [True] * 3 + [False] * 5


def test_rate_limit_stream_matches_batch_whatever_the_order_of_arrival(spark, tmp_path):
    import random

    mail.use_rocksdb(spark)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, t0 + dt.timedelta(minutes=7 * k), k) for k in range(60)] + [(0, t0 + dt.timedelta(minutes=21), 100)]
    ev = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int")
    shuffled = sorted(rows, key=lambda r: (r[1] - t0).total_seconds() / 420 + random.Random(r[2]).uniform(0, 14))
    for n, part in enumerate((shuffled[:20], shuffled[20:41], shuffled[41:], [(9, t0 + dt.timedelta(days=3), 999)])):
        spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = mail.rate_limited_stream(stream, "user_id", "ts", per_hour=2, late="2 hours", id_col="event_id").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {int(r["id"]): r["allowed"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["allowed"] for r in mail.rate_limited(ev, "user_id", "ts", ["event_id"], per_hour=2).collect()}
    assert got == want and not all(want.values())


def test_mail_decisions(spark):
    assert one(spark, mail.sender_allowed(F.col("s"), ["joe@*", "*@ok.com", "a@b.c"], ["d.org"]), s="Joe <joe@x.y>")
    assert one(spark, mail.sender_allowed(F.col("s"), [], ["d.org"]), s="z@d.org")
    assert not one(spark, mail.sender_allowed(F.col("s"), ["joe@*"], ["d.org"]), s="jo@x.y")
    assert one(spark, mail.decision(F.lit(True), F.lit(True), F.lit(0), F.lit(0), F.lit(0)), s="") == "no_attachment"


def test_corrections_and_hints(spark):
    items = spark.createDataFrame([(1, 5.0, "LF", "a"), (2, 6.0, "LF", "b")], "item_no int, quantity double, unit string, description string")
    v = spark.createDataFrame([(1, 7.0, None, None, 0.9, False), (2, 9.0, None, None, 0.5, True)], "item_no int, quantity double, unit string, description string, confidence double, is_correct boolean")
    got = {r["item_no"]: (r["quantity"], r["needs_human_review"]) for r in review.corrected(items, v).collect()}
    assert got == {1: (7.0, True), 2: (6.0, True)}
    box = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    assert one(spark, review.region_hint(box), s="") == "Top-left region"
    assert one(spark, geometry.expanded(box, 2.0), s="")[0] == [-5.0, -5.0]


def test_membrane_never_priced(spark):
    items = spark.createDataFrame([("1", "430-1-1", "30 MIL PVC LINER", 2.0), ("2", "x", "TYPE E INLET", 2.0)], "item_no string, pay_item_no string, description string, quantity double")
    cat = spark.createDataFrame([(0, "E", "Pipe", '30"', "c", 5.0, "LF", "430-1")], "row_no long, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string")
    got = {r["item_no"]: (r["matched"], r["line_cost"]) for r in pricing.priced(items, cat).collect()}
    assert got == {"1": (False, None), "2": (True, 8000.0)}


def test_pipeline(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("f1", 1, 'PROJECT: Elm Street\n430-175-118 PIPE CULVERT ROUND 18" RCP LF 450\n51 LF 24" RCP CLASS III\nINLET #3\nMH-2'),
            ("f1", 2, "SUMMARY OF QUANTITIES " + "." * 100 + "\n430-175-124\nPIPE CULVERT\n160\nLF"),
            ("f2", 1, ""),
        ],
        "file_id string, page_num int, text string",
    )
    cat = spark.createDataFrame([(0, "RCP_18_III", "RCP_Price_List", "Round RCP", '18"', "CL III", 50.0, "LF", "FDOT 430-175")], "row_no long, id string, category string, product_type string, size string, configuration string, price double, unit string, fdot_code string")
    out = analyze(pages, cat, use_product_first=False)
    items = out.items.collect()
    assert any(r["pay_item_no"] == "430-175-118" and r["quantity"] == 450.0 and r["line_cost"] == 22500.0 for r in items)
    assert any(r["source"] == "summary" and r["quantity"] == 160.0 for r in items)
    assert {r["file_id"]: r["name"] for r in out.projects.collect()}["f1"] == "Elm Street"
    given = spark.createDataFrame([(r["file_id"], r["item_no"], r["pay_item_no"], r["description"], r["unit"], r["quantity"], r["matched"], r["unit_price"], r["line_cost"], r["source"]) for r in items], "file_id string, item_no int, pay_item_no string, description string, unit string, quantity double, matched boolean, unit_price double, line_cost double, source string")
    full = given.withColumn("confidence_score", F.lit(None).cast("double")).withColumn("needs_verification", F.lit(False))
    sinks.write_json_reports(full, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 1
    out.release()


def test_summary_stops_at_next_code(spark):
    text = "SUMMARY OF QUANTITIES\n430-175-118\nPIPE CULVERT\n25\n430-175-124\nPIPE CULVERT\n160\nLF"
    p = spark.createDataFrame([(1, text)], "file_id int, text string")
    got = {r["pay_item_no"]: (r["quantity"], r["unit"], r["bid_number"]) for r in summary.standard_items(p, ["file_id"]).collect()}
    assert got == {"430-175-124": (160.0, "LF", 25)}


def test_encoded_headers(spark):
    from planquant.streaming.headers import decoded_header

    rows = spark.createDataFrame([("=?utf-8?B?w6k=?= x",), ("plain",), (None,)], "h string")
    assert [r["x"] for r in rows.select(decoded_header(F.col("h")).alias("x")).collect()] == ["é x", "plain", None]
