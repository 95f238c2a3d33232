"""Relations derived from the driver's tables by integer arithmetic.

The texts below are valid in Spark and in DuckDB once ``{d}`` is the engine's
integer division, so that both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_WIDTH, PAGE_HEIGHT = 640, 800

_LABELS = ("text", "title", "table", "figure", "equation")
_LINES = ("Quyết định số 5", "Chương II", "Mục 3", "Điều 4. Phạm vi", "Nơi nhận", "1. Mục tiêu", "1.2. Tiến độ", "12. Kinh phí", "Dòng thường", "| a | b |", "12 Kinh phí")


def _case(index: str, values: tuple[str, ...]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BOX = "CAST(x0 AS BIGINT) AS x0, CAST(top AS BIGINT) AS top, CAST(x0 + w AS BIGINT) AS x1, CAST(top + h AS BIGINT) AS bottom"

SQL = {
    "layout_boxes": f"""
        SELECT page_id, seq, type, {_BOX}, score FROM (
            SELECT event_id {{d}} 12 AS page_id, event_id % 12 AS seq,
                   {_case("(event_id * event_id * 31 + event_id {d} 5) % 5", _LABELS)} AS type,
                   (event_id * event_id * 7919 + event_id) % 400 AS x0, (event_id * event_id * 104729 + 3 * event_id) % 600 AS top,
                   40 + (event_id * 31) % 200 AS w, 10 + (event_id * 17) % 80 AS h,
                   CAST((event_id * 613) % 1000 AS DOUBLE) / 1000 AS score
            FROM events) b""",
    "ocr_boxes": f"""
        SELECT page_id, seq, {_BOX}, text, score FROM (
            SELECT event_id {{d}} 12 AS page_id, event_id % 12 AS seq,
                   (event_id * event_id * 6151 + event_id) % 520 AS x0, (event_id * event_id * 3571 + 7 * event_id) % 640 AS top,
                   20 + (event_id * 13) % 60 AS w, 8 + (event_id * 11) % 12 AS h,
                   concat(event_type, ' ', CAST(event_id AS VARCHAR(20))) AS text,
                   CAST((event_id * 397) % 1000 AS DOUBLE) / 1000 AS score
            FROM events) b""",
    "mask_rows": "SELECT event_id {d} 100 AS page_id, event_id % 100 AS y, (event_id {d} 9) % 3 <> 0 AS has_content FROM events",
    "heading_lines": f"""
        SELECT o_orderkey {{d}} 20 AS doc_id, o_orderkey % 20 AS line_no,
               {_case("(o_orderkey * 5 + o_orderkey {d} 20) % 11", _LINES)} AS text
        FROM orders""",
    # Tables of 24 cells, six rows by four columns, one table per 24 events. Every fifth has a cell over two columns, every
    # fourth two header rows; edges of parts are a little off, row 4 of every third is recognised twice, and a cell of every seventh is empty.
    "table_parts": """
        SELECT table_id, n AS seq,
               CASE WHEN n = 0 OR (n = 1 AND table_id % 4 = 2) THEN 'table column header' WHEN n < 6 OR n = 11 THEN 'table row' WHEN n < 10 THEN 'table column' ELSE 'table spanning cell' END AS label,
               CAST(CASE WHEN n < 6 THEN (table_id + n) % 3 WHEN n = 11 THEN 2 WHEN n < 10 THEN 120 * (n - 6) ELSE 120 END AS BIGINT) AS x0,
               CAST(CASE WHEN n < 6 THEN 30 * n WHEN n = 11 THEN 121 WHEN n < 10 THEN (table_id + n) % 2 ELSE 30 END AS BIGINT) AS top,
               CAST(CASE WHEN n < 6 THEN 470 - (table_id + n) % 3 WHEN n = 11 THEN 460 WHEN n < 10 THEN 120 * (n - 6) + 110 ELSE 350 END AS BIGINT) AS x1,
               CAST(CASE WHEN n < 6 THEN 30 * n + 28 WHEN n = 11 THEN 147 WHEN n < 10 THEN 178 - (table_id + n) % 2 ELSE 58 END AS BIGINT) AS bottom,
               CASE WHEN n = 11 THEN 0.5 ELSE 0.9 END AS score
        FROM (SELECT event_id {d} 24 AS table_id, event_id % 24 AS n FROM events) e
        WHERE n < 10 OR (n = 10 AND table_id % 5 = 1) OR (n = 11 AND table_id % 3 = 0)""",
    "table_cells": """
        SELECT table_id, n AS seq, CAST(120 * c + 5 + table_id % 7 AS BIGINT) AS x0, CAST(30 * r + 3 + table_id % 5 AS BIGINT) AS top,
               CAST(120 * c + 95 + table_id % 7 AS BIGINT) AS x1, CAST(30 * r + 21 + table_id % 5 AS BIGINT) AS bottom,
               CASE WHEN n = 14 AND table_id % 7 = 3 THEN '' WHEN c = 3 THEN CAST(r * 10 + c AS VARCHAR(20)) ELSE concat(event_type, CAST(r AS VARCHAR(20)), CAST(c AS VARCHAR(20))) END AS text,
               CAST((event_id * 397) % 1000 AS DOUBLE) / 1000 AS score
        FROM (SELECT event_id, event_type, event_id {d} 24 AS table_id, event_id % 24 AS n, event_id % 24 {d} 4 AS r, event_id % 4 AS c FROM events) e""",
    "rules": """
        SELECT p_partkey AS seq, lower(p_brand) AS wrong, upper(p_type) AS correct, p_partkey % 7 = 0 AS blocked, p_partkey % 5 AS seen_count
        FROM part""",
    "files": """
        SELECT c_custkey AS file_id, c_custkey % 50 AS job_id, c_custkey * 7919 % 1000 AS mtime,
               concat('out/job', CAST(c_custkey % 50 AS VARCHAR(20)), '/', c_name,
                      CASE c_custkey % 4 WHEN 0 THEN '_vlm_checked.md' WHEN 1 THEN '_ocr_raw.md' WHEN 2 THEN '_metadata.json' ELSE '_full.md' END) AS path
        FROM customer""",
}
_NEEDS = {"table_parts": "events", "table_cells": "events", "layout_boxes": "events", "ocr_boxes": "events", "mask_rows": "events", "heading_lines": "orders", "rules": "part", "files": "customer"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived relation on Spark."""
    table = _NEEDS[name]
    text = SQL[name].replace("{d}", "div").replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(name: str) -> str:
    """The derived relation as a DuckDB subquery."""
    return "(" + SQL[name].replace("{d}", "//") + ")"
