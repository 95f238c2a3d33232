import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Số tiền 1.000 đồng [x]", ["sensitive_value", "checkbox_or_selection"]),
        ("mã O1B2", ["sensitive_value", "ambiguous_characters"]),
        ("SỐ 5", ["sensitive_value"]),
        ("ñso", []),
        ("   ", []),
    ],
)
def test_risk_categories(spark, text, expected):
    assert one(spark, t.risk_categories(F.col("s")), s=text) == expected


def test_short_text_in_a_large_region(spark):
    assert one(spark, t.risk_categories(F.col("s"), F.lit(250_000)), s="Số tiền 1.000 đồng [x]") == ["sensitive_value", "checkbox_or_selection", "ocr_too_short_for_region"]


@pytest.mark.parametrize(("name", "safe"), [("../bad<>name?.pdf", "badname.pdf"), ("a/b/", "b"), ("<>", "upload")])
def test_safe_filename(spark, name, safe):
    assert one(spark, t.safe_filename(F.col("s")), s=name) == safe


def test_rule_id_is_a_known_digest(spark):
    assert one(spark, t.rule_id(F.col("a"), F.col("b")), a="foo", b="bar") == "d6b681bfce7155d4"


def test_json_reply_drops_the_fence(spark):
    assert one(spark, t.json_reply(F.col("s")), s='```json {"checked_markdown":"ok"} ```') == '{"checked_markdown":"ok"}'


def test_preview_is_cut_in_bytes(spark):
    row = spark.createDataFrame([("abcdef",)], "s string").select(*t.preview(F.col("s").cast("binary"), 4)).first()
    assert tuple(row) == ("abcd", True)


def test_status(spark):
    assert one(spark, t.postcheck_status(F.col("s")), s='{"ai_postcheck":{"status":"ok"}}') == "ok"
    assert one(spark, t.postcheck_status(F.col("s")), s="{}") == "unavailable"
    assert one(spark, t.postcheck_status(F.col("s")), s='{"a":1}') == "disabled"


def test_usage(spark):
    usage = t.token_usage(F.col("s"), (("prompt_token_count", "prompt"), ("total_token_count", "total")))
    assert one(spark, usage, s='{"prompt_token_count":10,"total_token_count":20}') == "prompt=10, total=20"


@pytest.mark.parametrize(("text", "kind"), [("2020年", "Dt"), ("12,5", "Nu"), ("AB-12", "Ca"), ("hello", "En"), ("12 kg", "NE"), ("é", "Sg"), ("éé", None)])
def test_block_types(spark, text, kind):
    assert one(spark, t.block_type(F.col("s")), s=text) == kind


box = st.tuples(*[st.integers(0, 50)] * 4).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(box, box), min_size=1, max_size=20))
def test_intersection_is_symmetric(spark, pairs):
    names = [f"{p}{e}" for p in ("a_", "b_") for e in g.EDGES]
    df = spark.createDataFrame([a + b for a, b in pairs], ", ".join(f"{n} bigint" for n in names))
    for row in df.select(g.intersection("a_", "b_").alias("x"), g.intersection("b_", "a_").alias("y"), g.overlap_ratio("a_", "b_").alias("r")).collect():
        assert row["x"] == row["y"]
        assert 0 <= row["r"] <= 1


def test_sensitive_agrees_with_a_restatement(spark):
    words = ["số 5", "1.000", "12/3/2020", "123456789", "so", "soso", "đơn", "12345678", "hợp  đồng", "ma."]
    plain = re.compile(r"\b(\d{1,3}([.,]\d{3})+|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{9,12}|số|so|mã|ma|mst|cccd|cmnd|hợp\s*đồng|hop\s*dong|đơn|don)\b", re.I)
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r["x"] for r in df.select(t.sensitive(F.col("s")).alias("x")).collect()] == [bool(plain.search(w)) for w in words]


def test_paths_stay_in_their_folder(spark):
    cases = {
        "/runs/j1/out/a.md": "/runs/j1/out/a.md", "/runs/j1/./out//a.md": "/runs/j1/out/a.md", "/runs/j1/../j2/a.md": None, "/runs/j1/x/../../j1/b": "/runs/j1/b",
        "/runs/j10/a": None, "/runs/j1": "/runs/j1", "/../../runs/j1/c": "/runs/j1/c", "": None, "a.md": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r["p"]: r["at"] for r in df.select("p", t.contained(F.col("p"), F.lit("/runs/j1/")).alias("at")).collect()}
    assert got == {**cases, None: None}
