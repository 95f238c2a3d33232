import json

from lamina.sources import config, files
from lamina.streaming import lines


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "in" / "sub" / "b.PNG").write_bytes(b"bad")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    kinds = {r["name"]: r["kind"] for r in files.listing(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.pdf": "pdf", "b.PNG": "visual", "c.txt": "doc"}

    def decode(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return bytes(content).split(b"|")

    got = {(r["output"], r["page_no"]) for r in files.pages(spark, str(tmp_path / "in"), decode).collect()}
    assert got == {("a_0.jpg", 0), ("a_1.jpg", 1)}


def test_memory_of_another_shape_is_empty(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"version": 1, "rules": [{"id": "abc", "wrong": "a", "correct": "b"}], "blocked": [{"wrong": "x", "correct": "y"}]}))
    rules, blocked = files.read_memory(spark, str(good))
    assert [(r["seq"], r["id"]) for r in rules.collect()] == [(0, "abc")]
    assert blocked.count() == 1
    (tmp_path / "bad.json").write_text("[]")
    rules, blocked = files.read_memory(spark, str(tmp_path / "bad.json"))
    assert rules.count() == blocked.count() == 0


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a"), (2, "b")], "doc_id long, markdown string")
    files.write_documents(docs, str(tmp_path / "json"))
    files.write_markdown(docs, str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert {r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()} == {"# a", "b"}


def test_environment():
    env = {"KEEP_VALUE": "set"}
    config.load_env('# no\nNEW_VALUE="abc"\nKEEP_VALUE=from_file\nnothing\n', env)
    assert env == {"KEEP_VALUE": "set", "NEW_VALUE": "abc"}
    assert config.switch(" Yes ") and not config.switch("0") and config.switch(None, True)
    assert config.layered({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}


def test_index_schema(spark):
    kinds = {"x_int": "integer", "v_768_vec": "dense_vector", "lat_lon": "geo_point"}
    assert len(spark.createDataFrame([], config.index_schema(kinds)).columns) == 3


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "số 5", 0.9), (1, 2, "plain", 0.9)], lines.SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    lines.write(lines.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["category"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["sensitive_value"]


def test_memory_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([(1, "b", "sai", "đúng", True, 2, 0), (0, "a", 'x"\n', "y", False, 1, 9)], "seq int, id string, wrong string, correct string, blocked boolean, seen_count long, applied_count long")
    blocked = spark.createDataFrame([("q", "r")], "wrong string, correct string")
    for pair in ((rules, blocked), (rules.limit(0), blocked.limit(0))):
        path = str(tmp_path / f"memory{pair[0].count()}")
        files.write_memory(*pair, path)
        got = files.read_memory(spark, path)
        assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, pair[0].collect()))
        assert got[1].collect() == pair[1].collect()


def test_tables_are_made_and_widened(spark):
    from lamina.operators import catalog

    first = spark.createDataFrame([(1, "a")], "id int, name string")
    wide = first.withColumn("more", first["id"] * 2.5)
    spark.sql("DROP TABLE IF EXISTS lamina_test_ensured")
    try:
        catalog.ensure_table(first, "lamina_test_ensured")
        first.write.insertInto("lamina_test_ensured")
        catalog.ensure_table(wide, "lamina_test_ensured")
        catalog.ensure_table(first, "lamina_test_ensured")
        wide.write.insertInto("lamina_test_ensured")
        assert sorted(map(tuple, spark.table("lamina_test_ensured").collect()), key=str) == [(1, "a", 2.5), (1, "a", None)]
        assert catalog.continuous(wide) == ["id", "more"]
    finally:
        spark.sql("DROP TABLE IF EXISTS lamina_test_ensured")


def test_configuration():
    assert config.number("2.5", 1.0) == 2.5 and config.number("x", 1.0) == 1.0 and config.number(None, 1.0) == 1.0
    assert config.base_url(None, "http://a/") == config.base_url(" ", "http://a/")
