import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry
from lamina.operators import assign, catalog, headings, memory, order, search, stats, suppress, tables

BOX = "page_id long, seq long, type string, x0 long, top long, x1 long, bottom long, score double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOX)


def test_equal_overlap_goes_to_the_later_region(spark):
    a = boxes(spark, ("t", 0, 0, 10, 10, 1.0))
    b = boxes(spark, ("t", 0, 0, 10, 20, 1.0), ("t", 0, 0, 10, 20, 1.0))
    assert assign.best_overlap(a, b, 0.3).first()["hit"] == 1


def test_equal_distance_goes_to_the_earlier_column(spark):
    a = boxes(spark, ("t", 10, 0, 20, 10, 1.0))
    b = boxes(spark, ("t", 5, 0, 15, 9, 1.0), ("t", 15, 0, 25, 9, 1.0))
    assert assign.nearest_column(a, b).first()["hit"] == 0


def test_suppression_keeps_the_limit_only_with_borders(spark):
    b = boxes(spark, ("t", 0, 0, 9, 9, 0.9), ("t", 0, 0, 9, 9, 0.8), ("t", 100, 100, 110, 110, 0.1))
    assert {r["seq"] for r in suppress.suppress(b, 0.5).collect()} == {0, 2}
    half = boxes(spark, ("t", 0, 0, 10, 10, 0.9), ("t", 0, 0, 10, 5, 0.8))
    assert {r["seq"] for r in suppress.suppress(half, 0.5, pixel_border=False).collect()} == {0}


def test_clean_up_drops_the_earlier_of_equals():
    a = {"type": "t", "x0": 0, "top": 0, "x1": 10, "bottom": 10, "score": 0.5}
    assert suppress.clean([dict(a, seq=0), dict(a, seq=1)], [], 5, 0.6)[0]["seq"] == 1
    assert suppress.clean([dict(a, seq=0, score=0.6), dict(a, seq=1)], [], 5, 0.6)[0]["seq"] == 0


@pytest.mark.parametrize(("empty", "expected"), [(7, [(0, 11)]), (8, [(0, 3)])])
def test_bands(spark, empty, expected):
    rows = [(1, y, y < 4) for y in range(4 + empty + (empty == 7))]
    rows = rows[: 4 + empty + 1] if empty == 7 else rows
    found = order.bands(spark.createDataFrame(rows, "page_id long, y long, has_content boolean")).collect()
    got = [(r["top"], r["bottom"]) for r in found]
    assert got == ([(0, 3)] if len(rows) - 4 >= 8 else [(0, len(rows) - 1)])


def test_replay_is_longest_first(spark):
    rules = spark.createDataFrame([(0, "a", "ab", "x"), (1, "b", "abc", "y")], "seq int, id string, wrong string, correct string")
    row = memory.replay(spark.createDataFrame([("abc ab",)], "text string"), rules).first()
    assert row["corrected"] == "y x"
    assert [tuple(a) for a in row["applied"]] == [("b", 1), ("a", 1)]


def test_headings_keep_state(spark):
    lines = ["Quyết định số 5", "1. Mục tiêu", "12 Kinh phí", "Chương II", "12 Kinh phí", "Thông báo", "# kept", "x"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no long, text string")
    got = [(r["line_no"], r["level"], r["heading"]) for r in headings.classify(df).orderBy("line_no").collect()]
    assert got == [(0, 1, "Quyết định số 5"), (1, 3, "1. Mục tiêu"), (2, 4, "1.2. Kinh phí"), (3, 2, "Chương II"), (5, 2, "Thông báo")]


def test_gate_reasons_one_by_one(spark):
    fine = dict(line_count=10, avg_score=0.95, min_score=0.9, low_score_ratio=0.0, l_region_count=5, l_avg_score=0.8, l_low_score_ratio=0.0, has_text=True, risks=["sensitive_value"])
    cases = {
        "recognized OCR lines 0 < minimum 1 on a document with text/table layout": dict(line_count=0, avg_score=None, min_score=None),
        "average OCR confidence 0.8000 < threshold 0.8600": dict(avg_score=0.8),
        "minimum OCR line confidence 0.5000 < threshold 0.6000": dict(min_score=0.5),
        "low-confidence OCR line ratio 0.2000 >= threshold 0.2000": dict(low_score_ratio=0.2),
        "average layout confidence 0.5800 < threshold 0.6000": dict(l_avg_score=0.58),
        "low-confidence layout region ratio 0.4000 >= threshold 0.3500": dict(l_low_score_ratio=0.4),
        "3 OCR uncertainty risk(s): ambiguous_characters, ocr_too_short_for_region": dict(risks=["ocr_too_short_for_region", "ambiguous_characters", "ambiguous_characters"]),
        None: {},
    }
    schema = "line_count long, avg_score double, min_score double, low_score_ratio double, l_region_count long, l_avg_score double, l_low_score_ratio double, has_text boolean, risks array<string>"
    for reason, change in cases.items():
        row = spark.createDataFrame([tuple({**fine, **change}.values())], schema).select(stats.gate_reasons().alias("r")).first()
        assert row["r"] == ([reason] if reason else [])


def test_weighted_median_of_medians(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, 0.9, 0.9, 0.9, 0), (1, 3, 9, 0.5, 0.5, 0.5, 3), (1, 0, 0, None, None, None, 0), (2, 0, 0, None, None, None, 0)],
        "k int, line_count long, char_count long, avg_score double, min_score double, median_score double, low_score_count long",
    )
    got = {r["k"]: r for r in stats.roll_up(df, ["k"]).collect()}
    assert tuple(got[1][c] for c in ("line_count", "char_count", "avg_score", "min_score", "median_score", "low_score_count", "low_score_ratio")) == (4, 14, 0.6, 0.5, 0.5, 3, 0.75)
    assert tuple(got[2][c] for c in ("line_count", "avg_score", "min_score", "median_score", "low_score_ratio")) == (0, None, None, None, 0.0)


def test_learning_overwrites_what_is_said(spark):
    rules = spark.createDataFrame([("a", "w", "c", 2, 1, "old", 5, False), ("z", "q", "r", 1, 0, "old", 6, True)], "id string, wrong string, correct string, seen_count long, applied_count long, kind string, line int, blocked boolean")
    found = spark.createDataFrame(
        [("a", "w", "c", "new", None, 1), ("b", "x", "y", "one", 7, 2), ("b", "x", "y", None, 8, 3), ("z", "q", "r", "new", 9, 4)], "id string, wrong string, correct string, kind string, line int, at int"
    )
    got = {r["id"]: (r["seen_count"], r["applied_count"], r["kind"], r["line"], r["blocked"]) for r in memory.learn(rules, found).collect()}
    assert got == {"a": (3, 1, "new", 5, False), "b": (2, 0, "one", 8, False), "z": (1, 0, "old", 6, True)}


def test_replay_in_several_passes(spark, monkeypatch):
    rules = spark.createDataFrame([(i, f"r{i}", w, c) for i, (w, c) in enumerate([("a", "b"), ("bb", "c"), ("ccc", "aa"), ("b", "d")])], "seq int, id string, wrong string, correct string")
    texts = spark.createDataFrame([("abbcccb",), ("aab",)], "text string")
    wanted = sorted(memory.replay(texts, rules).collect())
    monkeypatch.setattr(memory, "RULES_A_PASS", 1)
    assert sorted(memory.replay(texts, rules).collect()) == wanted


def test_replay_against_a_plain_fold(spark, monkeypatch):
    """Overlapping, deleting, growing and chained rules, blocked and empty ones, null and empty texts, any number of rules a pass."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rules = [(i, f"r{i}", say(rng.randrange(1, 5)), say(rng.randrange(0, 4)), rng.random() < 0.1) for i in range(60)] + [(90, "x", "", "y", False), (91, "y", None, "y", None)]
    texts = [say(rng.randrange(0, 40)) for _ in range(80)] + [None, ""]

    def fold(text):
        applied = []
        for _, name, wrong, correct, blocked in sorted((r for r in rules if r[2]), key=lambda r: (-len(r[2]), r[0], r[1])):
            if not blocked and wrong != correct and text and wrong in text:
                applied.append((name, text.count(wrong)))
                text = text.replace(wrong, correct)
        return text, applied

    df = spark.createDataFrame(rules, "seq int, id string, wrong string, correct string, blocked boolean")
    said = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for size in (100_000, 7):
        monkeypatch.setattr(memory, "RULES_A_PASS", size)
        got = {r["i"]: (r["corrected"], [tuple(a) for a in r["applied"]]) for r in memory.replay(said, df).collect()}
        assert got == {i: fold(t) for i, t in enumerate(texts)}


def test_column_sort_across_pages():
    # One page: columns by tag; several pages: by place alone.
    cells = [{"C": 0, "x0": 0, "x1": 9, "top": 0}, {"C": 1, "x0": 20, "x1": 29, "top": 0}]
    for pages, wanted in (((1, 1), [0, 1]), ((1, 2), [0, 1])):
        boxes = [dict(c, page_number=p) for c, p in zip(cells, pages, strict=True)]
        tables.number_columns(boxes)
        assert [b["cn"] for b in boxes] == wanted


def test_lone_rows_move_up_or_down():
    cell = lambda rn, cn, top: {"rn": rn, "cn": cn, "top": top, "bottom": top + 10, "text": "t"}
    grid = [cell(r, c, 30 * r) for c in range(4) for r in (0, 2) if (r, c) != (2, 1)] + [cell(1, 1, 45)]
    tables.relocate(grid, "rn", "cn", "top", "bottom")
    assert sorted((b["rn"], b["cn"]) for b in grid) == [(r, c) for r in (0, 1) for c in range(4)]


def test_captions_and_empty_tables(spark):
    from lamina.plans import document

    cells = spark.createDataFrame([(1, 0, 0, 0, 9, 9, "表 1: x", 0.5), (1, 1, 0, 20, 9, 29, "a", 1.0), (2, 0, 9, 0, 0, 9, "gone", 0.2)], "table_id long, seq long, x0 long, top long, x1 long, bottom long, text string, score double")
    parts = spark.createDataFrame([(1, 0, "table row", 0, 20, 9, 29, 0.9), (1, 1, "table column", 0, 0, 9, 29, 0.9)], "table_id long, seq long, label string, x0 long, top long, x1 long, bottom long, score double")
    got = {r["table_id"]: r for r in document.extract_tables(cells, parts).collect()}
    assert got[1]["markdown"] == "**表 1: x**\n\n| a |\n| --- |\n" and got[1]["line_count"] == 2
    assert got[2]["markdown"] == "" and got[2]["avg_score"] == 0.2


def test_risk_assets_keep_counting(spark):
    from lamina.plans import document

    rows = [(1, 0, "a b", 0, 0, 9, 9, "old.png"), (1, 1, "a b", 0, 0, 9, 9, None), (1, 2, "c", None, None, None, None, None), (1, 3, "d", 0, 0, 9, 9, None), (1, 4, "e", 0, 0, 9, 9, None)]
    risks = spark.createDataFrame(rows, "page_id long, seq long, category string, x0 long, top long, x1 long, bottom long, asset_path string")
    got = [r["asset_path"] for r in document.risk_assets(risks, 4, 640, 800).orderBy("seq").collect()]
    assert got == ["old.png", "page_001_risk_002_a_b.png", None, "page_001_risk_003_d.png", None]


def test_diffs_candidates_and_effective_text(spark):
    docs = spark.createDataFrame([(1, "a\nhello wurld\nc\n", "a\nhello world\nc\nd\n")], "doc_id long, source_text string, checked_text string")
    changes = memory.hunks(docs)
    got = {r["change_id"]: r["reason"] for r in memory.candidates(changes).collect()}
    assert got == {0: "", 1: "empty"}
    reversed_ = spark.createDataFrame([(1, 0)], "doc_id long, change_id long")
    assert memory.effective(changes, reversed_).first()["markdown"] == "a\nhello wurld\nc\nd\n"
    rows = memory.change_rows(changes, reversed_).orderBy("change_id").collect()
    assert [(r["kind"], r["reversed"]) for r in rows] == [("replace", True), ("insert", False)]


def test_find_without_filters_is_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert catalog.find(df, n=None).count() == 0
    assert catalog.find(df, n=[1, 1]).count() == 1
    assert catalog.find(df, s={"a", "b"}).count() == 2
    assert df.where(catalog.condition({})).count() == 2


def test_singles_move_to_the_nearer_line():
    cell = lambda rn, cn, x0: {"rn": rn, "cn": cn, "x0": x0, "x1": x0 + 10, "text": "t"}
    grid = [cell(r, c, 100 * c) for r in range(4) for c in (0, 2) if (r, c) != (1, 2)] + [cell(1, 1, 180)]
    tables.relocate(grid, "cn", "rn", "x0", "x1")
    assert sorted((b["rn"], b["cn"]) for b in grid) == [(r, c) for r in range(4) for c in (0, 1)]


def test_sentences_join_headers():
    place = lambda text: [{"text": text}]
    places = {(0, 0): place("Name"), (0, 1): place("Sum"), (1, 0): place("A"), (1, 1): place("5")}
    assert tables.sentences(places, {0}) == ["Name：A; Sum：5"]
    assert tables.sentences(places, set()) == ["Name：Sum\nA：5"]


def test_fuzzy_sort_and_reading_order():
    rows = [{"top": 5, "x0": 30}, {"top": 0, "x0": 40}, {"top": 30, "x0": 0}]
    assert [r["x0"] for r in order.fuzzy(rows, "top", "x0", 10)] == [30, 40, 0]
    assert [r["x0"] for r in order.reading_order(rows)] == [30, 40, 0]


def test_any_date(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("2020-01-02",), ("2020-01-02_03:04:05",), ("x",)], "s string")
    assert [r["d"] is not None for r in df.select(search.any_date(F.col("s")).alias("d")).collect()] == [True, True, True, False]


def test_job_rows(spark):
    jobs = spark.createDataFrame(
        [("j1", 0.0, 10.0, None, 0, "/o/a.md", None, None), ("j2", 0.0, 10.0, 12.5, 1, None, None, "/o/r.json"), ("j3", 0.0, None, None, None, None, None, None), ("j4", 0.0, 9.0, 8.0, 0, "/o/b.md", "/o/m.json", None)],
        "job_id string, created_at double, started_at double, finished_at double, exit_code int, markdown_path string, metadata_path string, review_path string",
    )
    jobs = jobs.withColumn("status", catalog.job_state(F.col("started_at"), F.col("finished_at"), F.col("exit_code"), F.col("markdown_path")))
    got = {r["job_id"]: r for r in catalog.job_rows(jobs, F.lit(15.0)).collect()}
    assert {k: (r["status"], r["elapsed_seconds"], r["markdown_name"], r["changes_name"], r["has_markdown"]) for k, r in got.items()} == {
        "j1": ("running", 5.0, "a.md", None, True), "j2": ("failed", 2.5, None, "r.json", False), "j3": ("queued", None, None, None, False), "j4": ("succeeded", 0.0, "b.md", None, True),
    }
    assert got["j1"]["created_at"].startswith("1970-01-01T00:00:00")


def test_change_sources(spark):
    jobs = spark.createDataFrame([(1, "/o/r.json", "s.md", None), (2, "/o/r.json", None, "")], "job_id int, review_path string, source_name string, checked_name string")
    files = spark.createDataFrame([(i, p, m) for i in (1, 2) for p, m in (("/x/a_ocr_raw.md", 1), ("/x/b_ocr_raw.md", 2), ("/x/c_vlm_checked.md", 1))], "job_id int, path string, mtime int")
    got = {r["job_id"]: (r["source"], r["checked"]) for r in catalog.change_sources(jobs, files).collect()}
    assert got == {1: ("/o/s.md", "/x/c_vlm_checked.md"), 2: ("/x/b_ocr_raw.md", "/x/c_vlm_checked.md")}


def test_page_without_a_limit_numbers_nothing(spark):
    df = spark.range(5)
    assert [tuple(r) for r in catalog.page(df, {}, [F.col("id").desc()], offset=3).collect()] == [(1, 5), (0, 5)]


def test_typed_json(spark):
    from lamina.functions import text as t

    df = spark.sql("SELECT timestamp'2020-01-02 03:04:05' AS at, 7 AS n, CAST(NULL AS STRING) AS gone")
    row = df.select(t.encoded(F.struct("at", "n", "gone")).alias("j")).select("j", t.decoded(F.col("j"), "at timestamp, n int").alias("d")).first()
    assert row["j"] == '{"at":"2020-01-02 03:04:05","n":7}'
    assert str(row["d"]["at"]) == "2020-01-02 03:04:05" and row["d"]["n"] == 7


def test_registry_holds_transforms(spark):
    from lamina.plans.document import REGISTRY

    df = boxes(spark, ("t", 0, 0, 9, 9, 0.9), ("t", 0, 0, 9, 9, 0.5))
    assert [r["seq"] for r in df.transform(REGISTRY["clean_layouts"]).collect()] == [0]


def test_ctc(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1],)], "a array<int>")
    assert df.select(suppress.ctc_collapse("a").alias("x")).first()["x"] == [1, 1]


def test_bands_give_every_touching_pair_once(spark):
    """Against all pairs, with boxes without height, over many bands, inverted, on the bands' edges, and without an edge."""
    rng = random.Random(6)
    rows = [(1, i, x := rng.randrange(500), t := rng.randrange(900), x + rng.randrange(80), t + rng.choice([0, 5, 31, 32, 33, 400, -10])) for i in range(150)]
    rows += [(1, 200, 0, 32, 500, 64), (1, 201, 0, 64, 500, 64), (1, 202, None, 5, 10, 20), (1, 203, 0, None, 10, 20), (2, 0, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, "page_id int, seq int, x0 int, top int, x1 int, bottom int")
    touch = lambda a, b: None not in (*a, *b) and a[0] == b[0] and a[4] >= b[2] and a[2] <= b[4] and a[5] >= b[3] and a[3] <= b[5]
    wanted = sorted((a[0], a[1], b[1]) for a in rows for b in rows if touch(a, b))
    for band in (1, 32, 10_000):
        met = assign.met(df, df, ("page_id",), band).where(geometry.touching("a_", "b_"))
        assert sorted((r["page_id"], r["a_seq"], r["b_seq"]) for r in met.collect()) == wanted


def test_a_large_page_makes_few_pairs(spark):
    """Twelve hundred boxes of a line's height on one high page: a small share of all pairs meet."""
    rng = random.Random(7)
    rows = [(1, i, x := rng.randrange(500), t := rng.randrange(20_000), x + 60, t + 18) for i in range(1200)]
    df = spark.createDataFrame(rows, "page_id int, seq int, x0 int, top int, x1 int, bottom int")
    assert assign.met(df, df, ("page_id",)).count() < 1200 * 1200 / 40


def test_required_reviews_fail_the_query(spark):
    from lamina.plans import document

    decided = spark.createDataFrame([(1, "raw", True, True, True)], "doc_id long, markdown string, enabled boolean, run boolean, has_key boolean")
    replies = spark.createDataFrame([(1, "no json", None)], "doc_id long, reply string, failure string")
    assert tuple(document.reviewed(decided, replies).first()) == (1, "failed", document.NO_TEXT, "raw", False)
    with pytest.raises(Exception, match="review of 1"):
        document.reviewed(decided, replies, required=True).collect()


def test_records_of_jobs_that_share_a_folder(spark):
    """Files are not joined to every job of their folder: outputs are found before."""
    files = spark.createDataFrame([(7, i, f"out/{i}_full.md") for i in range(50)], "job_id long, mtime long, path string")
    jobs = spark.range(100).selectExpr("id AS job_id", "7L AS folder", "'a' AS input_name", "'b' AS status", "0D AS created_at", "1D AS started_at", "3D AS finished_at", "'c' AS ai_check_status", "NULL AS error")
    metadata = spark.createDataFrame([(3, '{"page_count": 4}')], "job_id long, metadata string")
    got = catalog.history_records(jobs, files, metadata).collect()
    assert {r["markdown_name"] for r in got} == {"49_full.md"} and len(got) == 100
    assert [r["page_count"] for r in got if r["job_id"] == 3] == [4] and {r["duration_seconds"] for r in got} == {2.0}
