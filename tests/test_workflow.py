"""The workflow driver: status rows, resumption, price lists that fail; recursive splits and answers of vision models."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from planquant.plans.workflow import results, run_workflow
from planquant.sources import files as S


def reader_at(broken):
    def at(dpi):
        def read(batches):
            for batch in batches:
                rows = []
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    name, _, span = path.rpartition("#")
                    first, last = map(int, span.split("-"))
                    for n, text in enumerate(bytes(content).decode().split("\f")[first - 1 : last], start=1):
                        rows.append((path, n, "?" if name in broken else text, 0.9, 9, f"at {dpi}"))
                yield pd.DataFrame(rows, columns=["file_id", "page_num", "text", "confidence", "block_count", "method"])

        return read

    return at


@pytest.fixture(scope="module")
def three_runs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("workflow"))
    page = lambda n: f"DRAINAGE PLAN, SEE THE NOTES BELOW FOR WHAT IS MEANT\n430-175-1{n} PIPE CULVERT LF {n}5"
    rows = [("a", "a", page(18).encode(), 1.0, 1), ("b", "b", "\f".join(map(page, (18, 24, 30, 36))).encode(), 60.0, 4), ("c", "c", page(24).encode(), 1.0, 1)]
    files = spark.createDataFrame(rows, "file_id string, path string, content binary, mb double, n_pages int")

    def no_prices():
        raise OSError("no such price list")

    first = run_workflow(files, reader_at({"c"}), root, no_prices).collect()
    second = run_workflow(files, reader_at(set()), root).collect()
    third = run_workflow(files, reader_at(set()), root).collect()
    return root, first, second, third


def test_status_of_files_and_resumption(spark, three_runs):
    root, first, second, third = three_runs
    status = {r["file_id"]: (r["status"], r["stage"], r["attempts"], r["n_pages"], r["n_items"]) for r in first}
    assert status["a"] == ("pricing_failed", "price", 1, 1, 1) and status["c"] == ("failed", "read", 3, 0, 0)
    assert sorted(k for k in status if k.startswith("b")) == ["b_part1", "b_part2"] or sorted(k for k in status if k.startswith("b")) == ["b_part1", "b_part2", "b_part3", "b_part4"]
    assert {r["original_file"] for r in first} == {"a", "b", "c"} and all("pricing failed: OSError" in r["errors"] for r in first if r["status"] == "pricing_failed")
    assert [(r["file_id"], r["status"], r["n_items"]) for r in second] == [("c", "success", 1)]
    assert third == []
    items = results(spark, root, "items").collect()
    assert sorted((r["original_file"], r["page_num"]) for r in items) == [("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1)]


def test_a_run_without_status_is_done_again(spark, three_runs):
    root = three_runs[0]
    n = results(spark, root, "items").count()
    spark.read.parquet(f"{root}/items/run=1").limit(1).write.parquet(f"{root}/items/run=99")
    assert results(spark, root, "items").count() == n


@pytest.mark.parametrize("rate", [1.0, 12.0, 40.0])
def test_split_to_fit(spark, rate):
    parts = spark.createDataFrame([("a", 1, 90), ("b", 1, 1), ("c", 11, 17)], "file_id string, first_page int, last_page int")
    got = S.split_to_fit(parts, lambda p: p.withColumn("mb", (F.col("last_page") - F.col("first_page") + 1) * rate)).collect()
    for f, a, b in (("a", 1, 90), ("b", 1, 1), ("c", 11, 17)):
        own = sorted((r["part_no"], r["first_page"], r["last_page"], r["mb"]) for r in got if r["file_id"] == f)
        assert [x[0] for x in own] == list(range(len(own))) and own[0][1] == a and own[-1][2] == b
        assert all(x[2] + 1 == y[1] for x, y in zip(own, own[1:])) and all(mb <= 30 or x == y for _, x, y, mb in own)


def balanced(text):
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start != -1:
                return text[start : i + 1]
    return None


GOOD = '{"pay_items": [{"pay_item_no": "430-1", "description": "a", "unit": "LF", "quantity": 2.0, "confidence": "high"}], "page_summary": "s"}'


@pytest.mark.parametrize(
    ("answer", "summary"),
    [(GOOD, "s"), (f"Here it is: {GOOD} and {{more}} of it", "s"), (f"text\n```json\n{GOOD}\n```\nand {{x", "s"), ("nothing", None), ("{open", None), (None, None), ("", None), (f'{{"x": 1}} then {GOOD}', None), (GOOD + GOOD.replace('"s"', '"t"'), "s"), ('{"page_summary": "a {b} c"} tail', "a {b} c")],
)
def test_answers_of_vision_models(spark, answer, summary):
    row = spark.createDataFrame([(answer,)], "r string").select(S.balanced_object(F.col("r")).alias("b"), S.vision_json(F.col("r"))["page_summary"].alias("s")).head()
    assert row["b"] == balanced(answer or "") and row["s"] == summary
