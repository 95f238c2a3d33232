"""Registered queries over the engine's own operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.fixtures import PAGE_HEIGHT, PAGE_WIDTH, duck, relation
from lamina.functions import geometry as g
from lamina.functions import text as t
from lamina.operators import assign, catalog, decode, headings, memory, order, raster, sample, search, stats, suppress, tables
from lamina.plans import document
from lamina.sources.byte_log import ByteLog
from lamina.sources.versioned import VersionedTable
from lamina.storage import new_path
from lamina.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LAYOUT, OCR, MASK, LINES = duck("layout_boxes"), duck("ocr_boxes"), duck("mask_rows"), duck("heading_lines")
PARTS, CELLS, RULES, FILES = duck("table_parts"), duck("table_cells"), duck("rules"), duck("files")


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---- text (T1-T8, T11-T17) ------------------------------------------------

_W, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_SENSITIVE_SQL = (
    rf"regexp_matches(lower(text), '{_W}[0-9]{{1,3}}([.,][0-9]{{3}})+(\s*(đồng|vnd|vnđ|usd))?{_E}')"
    rf" OR regexp_matches(text, '{_W}[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}{_E}')"
    rf" OR regexp_matches(text, '{_W}[0-9]{{9,12}}{_E}')"
    rf" OR regexp_matches(lower(text), '{_W}(số|so|mã|ma|mst|cccd|cmnd|hợp\s*đồng|hop\s*dong|đơn|don){_E}')"
)
_CHECKBOX_SQL = r"regexp_matches(lower(text), '(\[[ x]\]|☐|☑|✓|□|■|checkbox|tick|chọn|chon)')"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Risk categories of document lines by language."""
    return document.risks_by_group(_docs(spark, sf), ["lang"])


# The counterpart's engine has no look-ahead. So by cases: from a word boundary, letters or ? with an ambiguous one among them and a
# digit after these (begun by a letter after no word character, or by ? after one); then an end at a boundary, three characters on.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_TWO = r"[A-Za-z][A-Za-z?]*[OolIS?][A-Za-z?]*[0-9]"
_BEGUN = rf"((^|[^{_WORD}])({_TWO}|[OolIS][A-Za-z?]*[0-9])|[{_WORD}]\?[A-Za-z?]*[0-9])"
_THREE = rf"((^|[^{_WORD}])({_TWO}|[OolIS][A-Za-z?]+[0-9])|[{_WORD}]\?[A-Za-z?]+[0-9])"
_AMBIGUOUS_SQL = rf"regexp_matches(text, '{_BEGUN}[A-Za-z0-9?]*([A-Za-z0-9]([^{_WORD}]|$)|\?[{_WORD}])|{_THREE}([^{_WORD}]|$)')"
_FLAG_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text FROM documents"
ORACLE_SQL["t5_risks_by_language"] = f"""WITH l AS ({_FLAG_LINES}),
r AS (SELECT doc_id, lang, 'sensitive_value' AS category, 'high' AS severity FROM l WHERE {_SENSITIVE_SQL}
UNION ALL SELECT doc_id, lang, 'ambiguous_characters', 'high' FROM l WHERE {_AMBIGUOUS_SQL}
UNION ALL SELECT doc_id, lang, 'checkbox_or_selection', 'medium' FROM l WHERE {_CHECKBOX_SQL})
SELECT lang, category, severity, count(*) AS n_risks, count(DISTINCT doc_id) AS n_docs FROM r GROUP BY lang, category, severity"""
QUERIES["t5_risks_by_language"] = flagship


@register(f"""WITH l AS (SELECT doc_id, line, text[line] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents) d),
r AS (SELECT doc_id, line, 0 AS nth, 'sensitive_value' AS category, 'high' AS severity, text FROM l WHERE {_SENSITIVE_SQL}
UNION ALL SELECT doc_id, line, 1, 'ambiguous_characters', 'high', text FROM l WHERE {_AMBIGUOUS_SQL}
UNION ALL SELECT doc_id, line, 2, 'checkbox_or_selection', 'medium', text FROM l WHERE {_CHECKBOX_SQL})
SELECT doc_id AS page_id, printf('p%03d_r%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, nth)) AS risk_id, category, severity, substring(text, 1, 1000) AS text FROM r""")
def t5_risk_rows(spark, sf):
    """Every risk of every line of the documents, numbered."""
    lines = _docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return document.text_risks(lines).drop("seq")


@register(f"""SELECT seq, wrong, correct FROM {RULES} r WHERE NOT blocked AND NOT EXISTS (SELECT 1 FROM part p WHERE p_partkey % 3 = 0 AND lower(p_brand) = r.wrong AND upper(p_type) = r.correct)""")
def j9_not_blocked(spark, sf):
    """Rules that are blocked neither by their mark nor as a pair; a third of the parts block theirs."""
    blocked = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 3 = 0").select(F.lower("p_brand").alias("wrong"), F.upper("p_type").alias("correct"))
    return memory.not_blocked(relation(spark, sf, "rules"), blocked).select("seq", "wrong", "correct")


@register(f"SELECT doc_id, ({_SENSITIVE_SQL}) AS sensitive FROM documents")
def t1_sensitive_value(spark, sf):
    return _docs(spark, sf).select("doc_id", t.sensitive(F.col("text")).alias("sensitive"))


@register(f"SELECT doc_id, {_AMBIGUOUS_SQL} AS ambiguous FROM documents")
def t2_ambiguous_characters(spark, sf):
    return _docs(spark, sf).select("doc_id", t.ambiguous(F.col("text")).alias("ambiguous"))


@register(f"SELECT doc_id, {_CHECKBOX_SQL} AS checkbox FROM documents")
def t3_checkbox(spark, sf):
    return _docs(spark, sf).select("doc_id", t.checkbox(F.col("text")).alias("checkbox"))


@register("SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(trim(text, ' \t\n\r')) > 0 AND doc_id * 40000 >= 120000 AND length(trim(text, ' \t\n\r')) / nullif(doc_id * 40000, 0) < 0.00025 END AS too_short FROM documents")
def t4_too_short(spark, sf):
    return _docs(spark, sf).select("doc_id", t.too_short(F.col("text"), F.col("doc_id") * 40000).alias("too_short"))


@register(f"""SELECT page_id, 'table_or_form_block' AS category, 'high' AS severity FROM {LAYOUT} l WHERE type = 'table'
UNION ALL SELECT page_id, 'signature_stamp_qr_or_visual_mark', 'medium' FROM {LAYOUT} l WHERE type IN ('figure', 'equation')
UNION ALL SELECT page_id, 'multi_column_page', 'high' FROM (
  SELECT page_id, x0 + x1 AS c2, top, bottom FROM {LAYOUT} l
  WHERE type IN ('text', 'title', 'table') AND score >= 0.15 AND x1 - x0 <= 435.2 AND bottom - top >= 32) f
GROUP BY page_id
HAVING count(*) FILTER (WHERE c2 < 614.4) >= 2 AND count(*) FILTER (WHERE c2 > 665.6) >= 2
 AND max(bottom) FILTER (WHERE c2 < 614.4) - min(top) FILTER (WHERE c2 < 614.4) > 200
 AND max(bottom) FILTER (WHERE c2 > 665.6) - min(top) FILTER (WHERE c2 > 665.6) > 200""")
def t6_structural_risks(spark, sf):
    return document.structural_risks(relation(spark, sf, "layout_boxes"), PAGE_WIDTH, PAGE_HEIGHT)


@register(f"SELECT doc_id, line_no, regexp_matches(text, '^(#|\\||!\\[|```|- |\\+ |\\* )') AS passthrough FROM {LINES} l")
def t7_passthrough(spark, sf):
    return relation(spark, sf, "heading_lines").select("doc_id", "line_no", t.passthrough(F.col("text")).alias("passthrough"))


@register("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN length(l) >= 3 AND length(l) <= 140 AND regexp_matches(l, '\\p{L}') THEN 1 ELSE 0 END) AS BIGINT) AS n_candidates FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) d GROUP BY doc_id")
def t8_heading_candidate(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(t.heading_candidate(F.col("line"))).alias("n_candidates"))


@register(f"""WITH k AS (SELECT doc_id, line_no, text, CASE
    WHEN text = 'Quyết định số 5' THEN 'title' WHEN text = 'Điều 4. Phạm vi' THEN 'article' WHEN text = 'Nơi nhận' THEN 'receiver_section'
    WHEN text = 'Chương II' THEN 'chương' WHEN text = 'Mục 3' THEN 'mục' WHEN text = '1.2. Tiến độ' THEN 'numbered_subsection'
    WHEN text IN ('1. Mục tiêu', '12. Kinh phí') THEN 'numbered_section' WHEN text = '12 Kinh phí' THEN 'dense' END AS kind FROM {LINES} l),
m AS (SELECT *, CASE kind WHEN 'numbered_subsection' THEN '1' WHEN 'numbered_section' THEN split_part(text, '.', 1) WHEN 'dense' THEN NULL ELSE '' END AS number FROM k WHERE kind IS NOT NULL),
g AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp,
    count(CASE WHEN kind = 'title' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS titles FROM m),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, number FROM m WHERE number IS NOT NULL),
s AS (SELECT g.*, n.number AS parent FROM g LEFT JOIN n ON n.doc_id = g.doc_id AND n.i = g.grp)
SELECT doc_id, line_no,
  CASE WHEN kind = 'title' THEN CASE WHEN titles = 0 THEN 1 ELSE 2 END WHEN kind IN ('numbered_section', 'mục') THEN 3 WHEN kind IN ('numbered_subsection', 'dense') THEN 4 ELSE 2 END AS level,
  CASE WHEN kind = 'title' THEN CASE WHEN titles = 0 THEN 'document_title' ELSE 'document_section_title' END WHEN kind = 'dense' THEN 'dense_numbered_subsection' ELSE kind END AS reason,
  CASE WHEN kind = 'dense' THEN '1.2. Kinh phí' ELSE text END AS heading
FROM s WHERE kind <> 'dense' OR parent = '1'""")
def t9_headings(spark, sf):
    return headings.classify(relation(spark, sf, "heading_lines"))


@register(f"""WITH h AS ({ORACLE_SQL["t9_headings"]})
SELECT l.doc_id, string_agg(CASE WHEN h.level IS NULL THEN l.text ELSE repeat('#', CAST(h.level AS BIGINT)) || ' ' || h.heading END, chr(10) ORDER BY l.line_no) AS markdown
FROM {LINES} l LEFT JOIN h ON h.doc_id = l.doc_id AND h.line_no = l.line_no GROUP BY l.doc_id""")
def t10_apply_headings(spark, sf):
    lines = relation(spark, sf, "heading_lines")
    return headings.apply(lines, headings.classify(lines))


@register("""SELECT o_orderkey, CASE
  WHEN regexp_matches(v, '^[0-9.,+%/ -]+$') THEN 'Nu' WHEN regexp_matches(v, '^[0-9A-Z/._~-]+$') THEN 'Ca'
  WHEN regexp_matches(v, '^[A-Z]*[a-z'' -]+$') THEN 'En' WHEN regexp_matches(v, '^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()'' -]+$') THEN 'NE' END AS btype
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderpriority WHEN 2 THEN upper(o_orderstatus) || '-' || CAST(o_custkey AS VARCHAR) ELSE lower(o_orderstatus) || ' kept' END AS v FROM orders) o""")
def t11_block_type(spark, sf):
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN o_orderpriority WHEN 2 THEN upper(o_orderstatus) || '-' || CAST(o_custkey AS STRING) ELSE lower(o_orderstatus) || ' kept' END")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", t.block_type(v).alias("btype"))


@register("SELECT p_partkey, substring(sha256(p_name || chr(0) || p_brand), 1, 16) AS rule_id FROM part")
def t13_rule_id(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", t.rule_id(F.col("p_name"), F.col("p_brand")).alias("rule_id"))


@register("SELECT event_id, regexp_extract(props, '\\{.*\\}') AS reply FROM events")
def t14_json_reply(spark, sf):
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.json_reply(wrapped).alias("reply"))


@register("SELECT doc_id, CASE WHEN length(text) > 1800 THEN substring(text, 1, 1800) || '...' ELSE text END AS snippet FROM documents")
def t16_shortened(spark, sf):
    return _docs(spark, sf).select("doc_id", t.shortened(F.col("text"), 1800, "...").alias("snippet"))


@register("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'disabled' ELSE 'unavailable' END AS status FROM events")
def t17_postcheck_status(spark, sf):
    meta = F.expr("CASE event_id % 3 WHEN 0 THEN '{\"ai_postcheck\":{\"status\":\"ok\"}}' WHEN 1 THEN '{\"pages\":[]}' ELSE '{}' END")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.postcheck_status(meta).alias("status"))


@register("SELECT event_id, printf('%02d:%02d:%02d', event_id * 977 // 3600, event_id * 977 // 60 % 60, event_id * 977 % 60) AS clock FROM events")
def t18_clock(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.clock(F.col("event_id") * 977000).alias("clock"))


# ---- names, predicates, projections (S3-S10, P1-P12) ---------------------


@register("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'visual' WHEN 2 THEN 'doc' ELSE 'other' END AS kind, page_id % 4 < 2 AS upload FROM pages")
def s3_file_kind(spark, sf):
    name = F.expr("concat('F', page_id, CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' ELSE '.bin' END)")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.file_kind(name).alias("kind"), t.may_upload(name).alias("upload"))


@register("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '[^\\p{L}\\p{N}._\\- ()]', '', 'g')), ''), 'upload') AS name FROM pages")
def s5_safe_filename(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.safe_filename(F.col("url")).alias("name"))


_JOB = "'out/job' || CAST(job_id AS VARCHAR) || '/job' || CAST(job_id AS VARCHAR) || '_"


@register("SELECT file_id, " + ", ".join(f"{_JOB}{n}' AS {n.replace('.', '_')}" for n in ("full.md", "metadata.json", "ocr_raw.md", "vlm_checked.md", "vlm_review.json")) + f" FROM {FILES} f")
def s6_artifact_paths(spark, sf):
    return relation(spark, sf, "files").select("file_id", *t.artifact_paths(F.col("path")))


@register("SELECT p_partkey, printf('page_%03d_region_%03d_%s.png', CAST(p_partkey % 1000 AS INTEGER), p_size, coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'image')) AS asset FROM part")
def s7_asset_name(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", t.asset_name((F.col("p_partkey") % 1000).cast("int"), F.col("p_size"), F.col("p_type")).alias("asset"))


@register(f"""SELECT job_id, coalesce(max(CASE WHEN ends_with(path, '_vlm_checked.md') THEN k END), max(CASE WHEN ends_with(path, '_full.md') THEN k END), max(CASE WHEN ends_with(path, '_ocr_raw.md') THEN k END))[6:] AS markdown,
  max(CASE WHEN ends_with(path, '_metadata.json') THEN k END)[6:] AS metadata FROM (SELECT *, printf('%05d', mtime) || path AS k FROM {FILES} f) x GROUP BY job_id""")
def s9_latest_outputs(spark, sf):
    return catalog.latest_outputs(relation(spark, sf, "files"))


@register("""SELECT doc_id, coalesce(text[1:list_max(list_filter(range(1, 257), lambda k: strlen(text[1:k]) <= 256))], '') AS preview, strlen(text) > 256 AS truncated FROM documents""")
def s10_preview(spark, sf):
    """The first 256 bytes as whole characters: the counterpart cannot cut one in two, so the mark that stands for the half of one is taken off."""
    found = _docs(spark, sf).select("doc_id", *t.preview(F.col("text").cast("binary"), 256))
    return found.withColumn("preview", F.regexp_replace("preview", "\uFFFD+$", ""))


@register("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 2 ELSE 1 END AS update_time, 1 AS create_time FROM customer""")
def s14_upsert(spark, sf):
    old = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("update_time"), F.lit(1).alias("create_time"))
    new = old.where("c_custkey % 3 = 0").withColumn("update_time", F.expr("IF(c_custkey % 2 = 0, 2, 1)")).withColumn("create_time", F.lit(9))
    new = new.withColumn("seq", F.lit(0)).withColumn("c_acctbal", F.lit(0.0)).unionByName(new.withColumn("seq", F.lit(1)).withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return catalog.upsert(old, new, "c_custkey")


_NEWEST = "max(CASE WHEN ends_with(path, '{}') THEN printf('%05d', mtime) || path END)[6:]"


@register(f"""SELECT *, CASE WHEN markdown IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM (
  SELECT job_id, coalesce({_NEWEST.format('_vlm_checked.md')}, {_NEWEST.format('_full.md')}, {_NEWEST.format('_ocr_raw.md')}) AS markdown, {_NEWEST.format('_metadata.json')} AS metadata
  FROM {FILES} f WHERE job_id % 2 = 1 GROUP BY job_id) j""")
def s13_missing_jobs(spark, sf):
    files = relation(spark, sf, "files")
    return catalog.missing_jobs(files, files.where("job_id % 2 = 0").select("job_id").distinct()).select("job_id", "markdown", "metadata", "status")


@register(f"SELECT page_id, seq, greatest(0, least(x0 - 24, 640)) AS x0, greatest(0, least(top - 24, 800)) AS top, greatest(0, least(x1 + 24, 640)) AS x1, greatest(0, least(bottom + 24, 800)) AS bottom, (x1 - x0) * (bottom - top) AS area FROM {LAYOUT} l")
def p2_padded_box(spark, sf):
    boxes = relation(spark, sf, "layout_boxes")
    return boxes.select("page_id", "seq", g.area().alias("area"), *g.clamped_box(PAGE_WIDTH, PAGE_HEIGHT, pad=24))


@register(f"SELECT page_id, seq, type FROM {LAYOUT} l WHERE score > 0.08 AND NOT (type IN ('figure', 'equation') AND score < 0.4)")
def p6_score_filter(spark, sf):
    return relation(spark, sf, "layout_boxes").where(t.scored_enough(F.col("type"), F.col("score"))).select("page_id", "seq", "type")


@register("SELECT page_id, regexp_matches(v, '^•+$') OR regexp_matches(v, '^[0-9]{1,2} / ?[0-9]{1,2}$') OR regexp_matches(v, '^[0-9]{1,2} of [0-9]{1,2}$') OR regexp_matches(v, '^http://[^ ]{12,}') AS garbage FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN CAST(page_id % 100 AS VARCHAR) || ' of 12' WHEN 2 THEN '3 / 4' ELSE 'text' END AS v FROM pages) p")
def p7_garbage(spark, sf):
    v = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN CAST(page_id % 100 AS STRING) || ' of 12' WHEN 2 THEN '3 / 4' ELSE 'text' END")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.garbage(v).alias("garbage"))


@register(f"SELECT page_id, seq, (CAST(x0 + x1 AS DOUBLE) / 2 - CAST(x1 - x0 AS DOUBLE) / 2 - 8) * 2 AS x0, (CAST(top + bottom AS DOUBLE) / 2 - CAST(bottom - top AS DOUBLE) / 2 - 4) * 2 AS top, (CAST(x0 + x1 AS DOUBLE) / 2 + CAST(x1 - x0 AS DOUBLE) / 2 - 8) * 2 AS x1, (CAST(top + bottom AS DOUBLE) / 2 + CAST(bottom - top AS DOUBLE) / 2 - 4) * 2 AS bottom FROM {LAYOUT} l")
def p9_unpad(spark, sf):
    c = F.col
    return relation(spark, sf, "layout_boxes").select(
        "page_id", "seq", *g.from_center((c("x0") + c("x1")) / 2, (c("top") + c("bottom")) / 2, c("x1") - c("x0"), c("bottom") - c("top"), F.lit(8), F.lit(4), F.lit(2))
    )


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 150000")
def p10_find(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return catalog.find(orders, o_orderstatus={"F", "O"}, o_totalprice=[1000, 150000], o_orderkey=None).select("o_orderkey", "o_custkey")


@register("""SELECT o_orderkey, place - 30 AS place, total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER () AS total
FROM orders WHERE o_orderpriority LIKE '%-URGENT' AND o_custkey >= 10) o WHERE place > 30 AND place <= 50""")
def p12_page(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    query = {"o_orderpriority": ("%", "%-URGENT"), "o_custkey": (">=", 10)}
    return catalog.page(orders, query, [F.col("o_totalprice").desc(), F.col("o_orderkey")], limit=20, offset=30).select("o_orderkey", F.col("place").cast("long").alias("place"), "total")


# ---- spatial joins (J1-J9), suppression (D1-D5) --------------------------

_TOUCH = "a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.bottom >= b.top AND a.top <= b.bottom"
_COMMON = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top))"
_AREA = "((a.x1 - a.x0) * (a.bottom - a.top))"
_AREA_B = "((b.x1 - b.x0) * (b.bottom - b.top))"
_OV = f"CAST({_COMMON} AS DOUBLE) / {_AREA}"
_OV2 = f"CAST({_COMMON} AS DOUBLE) / {_AREA_B}"


@register(f"SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq, {_COMMON} AS common, CAST(floor({_COMMON} * 10000 / {_AREA}) AS BIGINT) AS share FROM {OCR} a JOIN {LAYOUT} b ON a.page_id = b.page_id AND {_TOUCH}")
def j1_overlap(spark, sf):
    found = assign.pairs(relation(spark, sf, "ocr_boxes"), relation(spark, sf, "layout_boxes"), ("page_id",))
    share = F.floor(g.intersection("a_", "b_") * 10000 / g.area("a_"))
    return found.select("page_id", "a_seq", "b_seq", g.intersection("a_", "b_").alias("common"), share.alias("share"))


@register(f"""SELECT page_id, seq, hit FROM (SELECT a.page_id, a.seq, b.seq AS hit, row_number() OVER (PARTITION BY a.page_id, a.seq ORDER BY {_OV} DESC, {_OV2} DESC, b.seq DESC) AS r
FROM {OCR} a JOIN {LAYOUT} b ON a.page_id = b.page_id AND {_TOUCH} WHERE {_OV} >= 0.3) x WHERE r = 1""")
def j2_best_overlap(spark, sf):
    return assign.best_overlap(relation(spark, sf, "ocr_boxes"), relation(spark, sf, "layout_boxes"), 0.3)


@register(f"""SELECT page_id, seq, hit FROM (SELECT a.page_id, a.seq, b.seq AS hit, row_number() OVER (PARTITION BY a.page_id, a.seq
  ORDER BY least(2 * abs(a.x0 - b.x0), 2 * abs(a.x1 - b.x1), abs(a.x0 + a.x1 - b.x0 - b.x1)), b.seq) AS r
FROM {OCR} a JOIN {LAYOUT} b ON a.page_id = b.page_id) x WHERE r = 1""")
def j3_nearest_column(spark, sf):
    return assign.nearest_column(relation(spark, sf, "ocr_boxes"), relation(spark, sf, "layout_boxes"))


_SPANNED = "(table_id % 5 = 1 AND seq IN (5, 6))"
_FIT = f"(SELECT *, {_SPANNED} AS spanned, seq // 4 AS r, seq % 4 AS c, seq // 4 = 0 OR (seq // 4 = 1 AND table_id % 4 = 2) AS head FROM {CELLS} c)"


@register(f"""SELECT table_id, seq, r AS R, CASE WHEN head THEN r END AS H, c AS C, CASE WHEN spanned THEN 0 END AS SP,
  CASE WHEN spanned THEN 120 WHEN head THEN (table_id + r) % 3 END AS H_left, CASE WHEN spanned THEN 350 WHEN head THEN 470 - (table_id + r) % 3 END AS H_right,
  CASE WHEN spanned THEN 30 WHEN head THEN 30 * r END AS H_top, CASE WHEN spanned THEN 58 WHEN head THEN 30 * r + 28 END AS H_bott FROM {_FIT} f""")
def j5_tag_cells(spark, sf):
    # Of parts recognised twice the clean-up keeps the better one; the tags count what is left.
    parts = suppress.clean_parts(relation(spark, sf, "table_parts"))
    return assign.tag_cells(relation(spark, sf, "table_cells"), parts).select("table_id", "seq", "R", "H", "C", "SP", "H_left", "H_right", "H_top", "H_bott")


_TAGS = f"""(SELECT page_id, seq, CASE WHEN type = 'equation' THEN 'figure' ELSE type END AS layout_type, hit AS layout_seq FROM (
  SELECT a.page_id, a.seq, b.type, b.seq AS hit, row_number() OVER (PARTITION BY a.page_id, a.seq
    ORDER BY CASE b.type WHEN 'title' THEN 1 WHEN 'table' THEN 2 WHEN 'text' THEN 3 WHEN 'figure' THEN 4 ELSE 5 END, {_OV} DESC, {_OV2} DESC, b.seq DESC) AS r
  FROM {OCR} a JOIN {LAYOUT} b ON a.page_id = b.page_id AND {_TOUCH} WHERE {_OV} >= 0.4) x WHERE r = 1)"""


@register(f"SELECT * FROM {_TAGS} t")
def j6_tag_layout(spark, sf):
    return assign.tag_layout(relation(spark, sf, "ocr_boxes"), relation(spark, sf, "layout_boxes"))


@register(f"SELECT page_id, seq FROM {LAYOUT} b WHERE NOT (type = 'text' AND NOT bottom < 720) AND NOT (type = 'title' AND NOT top > 80)")
def j7_drop_page_edges(spark, sf):
    kind = F.when(F.col("type") == "text", "footer").when(F.col("type") == "title", "header").otherwise(F.col("type"))
    return assign.drop_page_edges(relation(spark, sf, "layout_boxes").withColumn("layout_type", kind), PAGE_HEIGHT).select("page_id", "seq")


@register(f"SELECT page_id, seq, '' AS text FROM {LAYOUT} l WHERE type IN ('figure', 'equation') AND NOT EXISTS (SELECT 1 FROM {_TAGS} t WHERE t.page_id = l.page_id AND t.layout_seq = l.seq)")
def j8_orphan_visuals(spark, sf):
    layouts = relation(spark, sf, "layout_boxes")
    tags = assign.tag_layout(relation(spark, sf, "ocr_boxes"), layouts)
    return assign.orphan_visuals(layouts, tags).select("page_id", "seq", "text")


def _greedy_sql(border: int, test: str) -> str:
    side = lambda lo, hi: f"greatest(0, least(k.{hi}, x[1].{hi}) - greatest(k.{lo}, x[1].{lo}) + {border})"
    common = f"({side('x0', 'x1')} * {side('top', 'bottom')})"
    iou = f"CAST({common} AS DOUBLE) / nullif((k.x1 - k.x0) * (k.bottom - k.top) + (x[1].x1 - x[1].x0) * (x[1].bottom - x[1].top) - {common}, 0)"
    box = "{'seq': seq, 'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom}"
    fold = f"list_reduce(list([{box}] ORDER BY score DESC, seq), lambda a, x: CASE WHEN len(list_filter(a, lambda k: NOT coalesce({iou} {test}, FALSE))) = 0 THEN a || x ELSE a END)"
    return f"SELECT page_id, unnest(kept).seq AS seq FROM (SELECT page_id, {fold} AS kept FROM {LAYOUT} l GROUP BY page_id, type) g"


@register(_greedy_sql(1, "<= 0.45"))
def d1_suppress(spark, sf):
    return suppress.suppress(relation(spark, sf, "layout_boxes"), 0.45)


@register(_greedy_sql(0, "< 0.2"))
def d2_suppress_strict(spark, sf):
    return suppress.suppress(relation(spark, sf, "layout_boxes"), 0.2, pixel_border=False)


@register()
def d3_clean_layouts(spark, sf):
    return suppress.clean_layouts(relation(spark, sf, "layout_boxes"))


@register()
def d3_clean_by_text(spark, sf):
    layouts = relation(spark, sf, "layout_boxes").withColumn("score", F.lit(None).cast("double"))
    return suppress.clean_layouts(layouts, texts=relation(spark, sf, "ocr_boxes"))


_GARBAGE_SQL = f"(SELECT split_part(text, ' ', 1) AS t FROM {OCR} g WHERE seq = 0 GROUP BY t HAVING count(*) > 1)"


@register(f"SELECT page_id, seq FROM {OCR} b WHERE NOT EXISTS (SELECT 1 FROM {_GARBAGE_SQL} x WHERE x.t = CASE WHEN b.seq < 4 THEN split_part(b.text, ' ', 1) ELSE b.text END)")
def d4_repeated_garbage(spark, sf):
    boxes = relation(spark, sf, "ocr_boxes")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    dropped = boxes.where("seq = 0").select(F.lit("header").alias("layout_type"), word.alias("text"))
    shown = boxes.withColumn("text", F.when(F.col("seq") < 4, word).otherwise(F.col("text")))
    return assign.repeated_garbage(shown, dropped).select("page_id", "seq")


# Steps n of 12 show (event_id >> n) % 4, 0 being the blank.
_STEP = "((event_id // CAST(pow(2, {n}) AS BIGINT)) % 4)"
_KEPT = "list_filter(range(12), lambda i: " + _STEP.format(n="i") + " <> 0 AND (i = 0 OR " + _STEP.format(n="i") + " <> " + _STEP.format(n="greatest(i - 1, 0)") + "))"


@register(f"""SELECT event_id, list_transform(k, lambda i: {_STEP.format(n="i")}) AS decoded, CASE WHEN len(k) = 0 THEN 0.0 ELSE list_sum(list_transform(k, lambda i: (i + 1) / 16.0)) / len(k) END AS confidence
FROM (SELECT event_id, {_KEPT} AS k FROM events) e""")
def d5_ctc_collapse(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.expr("event_id").cast("long") / F.pow(F.lit(2.0), i))
    scored = spark.read.parquet(f"{sf}/events.parquet").withColumn("steps", F.transform(steps, lambda x: F.floor(x) % 4)).withColumn("scores", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i / 16.0))
    return scored.select("event_id", suppress.ctc_collapse("steps").alias("decoded"), suppress.ctc_confidence("steps", "scores").alias("confidence"))


# ---- order and bands (O1-O9, W1) ------------------------------------------


@register()
def o1_sort_rows(spark, sf):
    return order.ordered(relation(spark, sf, "ocr_boxes"), lambda rows: order.fuzzy(rows, "top", "x0", 10))


@register()
def o4_reading_order(spark, sf):
    return order.ordered(relation(spark, sf, "ocr_boxes"), order.reading_order)


@register(f"SELECT page_id AS doc_id, string_agg(text, '\n\n' ORDER BY top, seq) AS markdown FROM {OCR} o GROUP BY page_id")
def o5_assemble(spark, sf):
    regions = relation(spark, sf, "ocr_boxes").withColumnRenamed("page_id", "doc_id").withColumn("page_no", F.lit(0))
    return document.assemble(regions)


@register(f"SELECT page_id, seq, place FROM (SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS place FROM {OCR} o) x WHERE place <= 3")
def o9_first_k(spark, sf):
    return order.first_k(relation(spark, sf, "ocr_boxes"), ["page_id"], [F.col("score").desc(), F.col("seq")], 3).select("page_id", "seq", F.col("place").cast("long").alias("place"))


@register(f"""WITH c AS (SELECT page_id, y, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS d FROM {MASK} m WHERE has_content),
r AS (SELECT page_id, y, sum(CASE WHEN d > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y) AS band FROM c),
e AS (SELECT page_id, max(y) AS last FROM {MASK} m GROUP BY page_id)
SELECT r.page_id, CAST(band AS BIGINT) AS band, min(y) AS top, CASE WHEN max(last) - max(y) < 8 THEN max(last) ELSE max(y) END AS bottom FROM r JOIN e ON e.page_id = r.page_id GROUP BY r.page_id, band""")
def w1_bands(spark, sf):
    return order.bands(relation(spark, sf, "mask_rows"))


# ---- statistics and gate (A1-A9, R1-R2) ----------------------------------

_MILLI = "CAST(round(score * 1000) AS BIGINT)"


@register(f"""SELECT page_id, count(*) AS line_count, CAST(sum(length(text)) AS BIGINT) AS char_count, 0.78 AS low_score_threshold, CAST(sum({_MILLI}) AS BIGINT) AS score_sum,
round(CAST(sum({_MILLI}) AS BIGINT) / count(*) / 1000, 4) AS avg_score, min(score) AS min_score, round(median({_MILLI}) / 1000, 4) AS median_score,
count(*) FILTER (WHERE score < 0.78) AS low_score_count, round(count(*) FILTER (WHERE score < 0.78) / count(*), 4) AS low_score_ratio FROM {OCR} o GROUP BY page_id""")
def a1_line_stats(spark, sf):
    out = stats.line_stats(relation(spark, sf, "ocr_boxes"), ["page_id"])
    return out.withColumn("score_sum", F.round(F.col("score_sum") * 1000).cast("long"))


@register(f"""WITH p AS (SELECT page_id, count(*) AS n, sum(length(text)) AS chars, sum({_MILLI}) AS s, min(score) AS lo, median({_MILLI}) / 1000 AS mid, count(*) FILTER (WHERE score < 0.78) AS low FROM {OCR} o GROUP BY page_id)
SELECT page_id // 10 AS doc_id, CAST(sum(n) AS BIGINT) AS line_count, CAST(sum(chars) AS BIGINT) AS char_count, CAST(round(CAST(sum(s) AS BIGINT) * 1000 / sum(n)) AS BIGINT) AS avg_score, min(lo) AS min_score,
  CAST(round(median(m) * 10000) AS BIGINT) AS median_score, CAST(sum(low) AS BIGINT) AS low_score_count, CAST(round(sum(low) * 1000000 / sum(n)) AS BIGINT) AS low_score_ratio
FROM (SELECT page_id, CASE WHEN i = 0 THEN n ELSE 0 END AS n, CASE WHEN i = 0 THEN chars ELSE 0 END AS chars, CASE WHEN i = 0 THEN s ELSE 0 END AS s, lo, CASE WHEN i = 0 THEN low ELSE 0 END AS low, mid AS m FROM (SELECT *, unnest(range(n)) AS i FROM p) u) x GROUP BY 1""")
def a2_roll_up(spark, sf):
    # Unrounded, since ties in the fifth place would fall either way in either engine; then in whole millionths.
    pages = stats.line_stats(relation(spark, sf, "ocr_boxes"), ["page_id"], digits=None).withColumn("doc_id", F.expr("page_id div 10"))
    out = stats.roll_up(pages, ["doc_id"], digits=None).drop("low_score_threshold")
    whole = lambda c, n: F.round(F.round(F.col(c) * n, 6)).cast("long")
    return out.withColumns({"avg_score": whole("avg_score", 1_000_000), "median_score": whole("median_score", 10_000), "low_score_ratio": whole("low_score_ratio", 1_000_000)})


@register(f"""SELECT page_id, count(*) AS region_count, 0.55 AS low_score_threshold, round(CAST(sum({_MILLI}) AS BIGINT) / count(*) / 1000, 4) AS avg_score, min(score) AS min_score, round(median({_MILLI}) / 1000, 4) AS median_score,
count(*) FILTER (WHERE score < 0.55) AS low_score_count, round(count(*) FILTER (WHERE score < 0.55) / count(*), 4) AS low_score_ratio FROM {LAYOUT} l GROUP BY page_id""")
def a3_layout_stats(spark, sf):
    return stats.layout_stats(relation(spark, sf, "layout_boxes"), ["page_id"]).drop("score_sum")


@register(f"""SELECT page_id // 10 AS doc_id, count(DISTINCT page_id % 10) AS pages, count(*) AS regions, count(*) FILTER (WHERE type = 'figure') AS assets, count(*) FILTER (WHERE type = 'title') AS headings, count(*) FILTER (WHERE type = 'table') AS risks,
coalesce(string_agg(CAST(page_id % 10 AS VARCHAR) || ':' || seq || type, ',' ORDER BY page_id, seq) FILTER (WHERE type = 'title'), '') AS headings_list, coalesce(string_agg(CAST(page_id % 10 AS VARCHAR) || ':' || seq || type, ',' ORDER BY page_id, seq) FILTER (WHERE type = 'table'), '') AS risks_list FROM {LAYOUT} l GROUP BY 1""")
def a4_document_counts(spark, sf):
    content = F.when(F.col("type") == "figure", "image").otherwise("text")
    regions = relation(spark, sf, "layout_boxes").select(F.expr("page_id div 10").alias("doc_id"), (F.col("page_id") % 10).alias("page_no"), "seq", "type", content.alias("content_type"))
    found = document.metadata(regions, *[regions.where(f"type = '{k}'").drop("content_type") for k in ("title", "table")])
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["page_no"].cast("string"), F.lit(":"), x["seq"].cast("string"), x["type"])), ","), F.lit("")).alias(c)
    return found.select("doc_id", "pages", "regions", "assets", "headings", "risks", shown("headings_list"), shown("risks_list"))


@register(f"""SELECT page_id, type FROM (SELECT page_id, type, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(seq)) AS r FROM {LAYOUT} l GROUP BY page_id, type) x WHERE r = 1""")
def a5_majority(spark, sf):
    return stats.majority(relation(spark, sf, "layout_boxes"), ["page_id"], "type", "seq")


@register(f"""SELECT table_id, seq, label, score, CAST(CASE WHEN h THEN least(x0, avg(x0) FILTER (WHERE h) OVER t) ELSE x0 END AS DOUBLE) AS x0, CAST(CASE WHEN v THEN least(top, min(top) FILTER (WHERE v) OVER t) ELSE top END AS DOUBLE) AS top,
CAST(CASE WHEN h THEN greatest(x1, avg(x1) FILTER (WHERE h) OVER t) ELSE x1 END AS DOUBLE) AS x1, CAST(CASE WHEN v THEN greatest(bottom, max(bottom) FILTER (WHERE v) OVER t) ELSE bottom END AS DOUBLE) AS bottom
FROM (SELECT *, label IN ('table row', 'table column header') AS h, label = 'table column' AS v FROM {PARTS} p) q WINDOW t AS (PARTITION BY table_id)""")
def a6_align_parts(spark, sf):
    return tables.align_parts(relation(spark, sf, "table_parts"))


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'prompt=' || CAST(event_id AS VARCHAR) || ', total=' || CAST(event_id * 2 AS VARCHAR) ELSE 'total=' || CAST(event_id * 2 AS VARCHAR) END AS usage FROM events")
def a9_token_usage(spark, sf):
    usage = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('{\"prompt_token_count\":', event_id, ',\"total_token_count\":', event_id * 2, '}') ELSE concat('{\"total_token_count\":', event_id * 2, '}') END")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.token_usage(usage, (("prompt_token_count", "prompt"), ("total_token_count", "total"))).alias("usage"))


@register(f"""WITH o AS (SELECT page_id, count(*) AS n, round(CAST(sum({_MILLI}) AS BIGINT) / count(*) / 1000, 4) AS a, min(score) AS lo, round(count(*) FILTER (WHERE score < 0.78) / count(*), 4) AS low FROM {OCR} o GROUP BY page_id),
l AS (SELECT page_id, round(CAST(sum({_MILLI}) AS BIGINT) / count(*) / 1000, 4) AS a, round(count(*) FILTER (WHERE score < 0.55) / count(*), 4) AS low FROM {LAYOUT} l GROUP BY page_id),
r AS (SELECT o.page_id, list_filter([CASE WHEN o.a < 0.86 THEN printf('average OCR confidence %.4f < threshold 0.8600', o.a) END, CASE WHEN lo < 0.6 THEN printf('minimum OCR line confidence %.4f < threshold 0.6000', lo) END,
  CASE WHEN o.low >= 0.2 THEN printf('low-confidence OCR line ratio %.4f >= threshold 0.2000', o.low) END, CASE WHEN l.a < 0.6 THEN printf('average layout confidence %.4f < threshold 0.6000', l.a) END,
  CASE WHEN l.low >= 0.35 THEN printf('low-confidence layout region ratio %.4f >= threshold 0.3500', l.low) END, CASE WHEN o.page_id % 3 = 0 THEN '1 OCR uncertainty risk(s): ambiguous_characters' END], lambda x: x IS NOT NULL) AS reasons FROM o JOIN l ON o.page_id = l.page_id)
SELECT page_id, TRUE AS enabled, len(reasons) > 0 AS run, 'low_confidence' AS trigger, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') ELSE 'OCR confidence passed; VLM post-check skipped' END AS reason FROM r""")
def r1_review_gate(spark, sf):
    text = F.when((F.col("page_id") % 3 == 0) & (F.col("seq") == 0), "mã O0l1").otherwise("plain words here")
    return document.review(relation(spark, sf, "ocr_boxes").withColumn("text", text), relation(spark, sf, "layout_boxes")).drop("reasons")


# ---- tables (W2-W10) -------------------------------------------------------


def _tagged(spark, sf):
    return assign.tag_cells(relation(spark, sf, "table_cells"), suppress.clean_parts(relation(spark, sf, "table_parts")))


@register(f"SELECT table_id, seq, CAST(seq // 4 AS BIGINT) AS rn, CAST(seq % 4 AS BIGINT) AS cn FROM {CELLS} c")
def w4_grid(spark, sf):
    return tables.grid(_tagged(spark, sf)).select("table_id", "seq", "rn", "cn")


@register(f"SELECT DISTINCT table_id, CAST(seq // 4 AS BIGINT) AS rn, seq // 4 = 1 AND table_id % 4 = 2 AS header FROM {CELLS} c")
def w6_header_rows(spark, sf):
    return tables.header_rows(tables.grid(_tagged(spark, sf)))


_PLACE = f"""(SELECT table_id, r, c, CASE WHEN spanned THEN (SELECT string_agg(x.text, ' ' ORDER BY x.seq) FROM {CELLS} x WHERE x.table_id = f.table_id AND x.seq IN (5, 6)) ELSE text END AS text FROM {_FIT} f)"""


@register(f"""WITH n AS (SELECT table_id, max(r) AS r_last, max(c) AS c_last, max(CASE WHEN r = 0 THEN c END) AS first FROM {_FIT} f WHERE text <> '' GROUP BY table_id),
g AS (SELECT n.table_id, rr.r, cc.c, coalesce(p.text, '') AS text FROM n, (SELECT unnest(range(6)) AS r) rr, (SELECT unnest(range(4)) AS c) cc LEFT JOIN {_PLACE} p ON p.table_id = n.table_id AND p.r = rr.r AND p.c = cc.c WHERE rr.r <= r_last AND cc.c <= c_last)
SELECT table_id, string_agg(line, '' ORDER BY r) AS markdown FROM (SELECT table_id, r, '| ' || string_agg(text, ' | ' ORDER BY c) || ' |' || chr(10) || CASE WHEN r = 0 THEN '| --- | --- | --- | --- |' || chr(10) ELSE '' END AS line FROM g GROUP BY table_id, r) x GROUP BY table_id""")
def w8_markdown(spark, sf):
    return document.extract_tables(relation(spark, sf, "table_cells"), relation(spark, sf, "table_parts")).select("table_id", "markdown")


@register()
def w9_rebuild_tables(spark, sf):
    return tables.rebuild(_tagged(spark, sf))


@register(f"SELECT page_id, page_id % 10 + 1 AS page_number FROM (SELECT DISTINCT page_id FROM {LAYOUT} l) x")
def w13_page_numbers(spark, sf):
    pages = relation(spark, sf, "layout_boxes").select("page_id", F.expr("page_id div 10").alias("doc_id")).distinct()
    return assign.numbered_pages(pages).select("page_id", "page_number")


@register(f"SELECT page_id, seq, printf('p%03d_r%03d', page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq)) AS risk_id FROM {LAYOUT} l WHERE type = 'table'")
def w12_numbered_risks(spark, sf):
    return memory.numbered(relation(spark, sf, "layout_boxes").where("type = 'table'")).select("page_id", "seq", "risk_id")


# ---- correction memory (R3-R12) -------------------------------------------


def _rules(spark, sf):
    rules = relation(spark, sf, "rules").withColumn("id", t.rule_id(F.col("wrong"), F.col("correct")))
    return rules.withColumn("applied_count", F.lit(0).cast("long"))


def _edited(spark, sf):
    """Documents of 20 lines: of the first kind lines 1, 2, 6, 7, ... end in !, of the second line 5 goes and one comes after line 9, the third stays."""
    said = F.when((F.col("doc_id") % 3 == 0) & F.col("line_no").isin(1, 2, 6, 7, 11, 12, 16, 17), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    said = F.when((F.col("doc_id") % 3 == 1) & (F.col("line_no") == 9), F.concat("text", F.lit("\nmới"))).otherwise(said)
    said = F.when((F.col("doc_id") % 3 == 1) & (F.col("line_no") == 5), F.lit(None)).otherwise(said)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("x")))), lambda x: x["x"]), "\n")
    return relation(spark, sf, "heading_lines").withColumn("text", F.concat("text", F.lit(" "), "line_no")).groupBy("doc_id").agg(joined(F.col("text")).alias("source_text"), joined(said).alias("checked_text"))


_KIND = f"(SELECT doc_id, line_no, text || ' ' || line_no || CASE WHEN line_no < 19 THEN chr(10) ELSE '' END AS text, doc_id % 3 AS k, line_no % 5 IN (1, 2) AS hot FROM {LINES} l)"
#: Lines with the hunk they lie in, and what both texts have of them.
_HUNKED = f"""(SELECT doc_id, line_no, k, CASE k WHEN 0 THEN line_no // 5 * 2 + CASE WHEN line_no % 5 = 0 THEN 0 WHEN hot THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN line_no < 5 THEN 0 WHEN line_no = 5 THEN 1 WHEN line_no < 10 THEN 2 ELSE 4 END ELSE 0 END AS hunk,
  text AS original, CASE WHEN k = 0 AND hot THEN rtrim(text, chr(10)) || '!' || chr(10) WHEN k = 1 AND line_no = 5 THEN '' ELSE text END AS output FROM {_KIND} x)"""
_HUNKS = f"""(SELECT doc_id, CAST(hunk AS INTEGER) AS hunk, CASE WHEN k = 0 AND hunk % 2 = 1 THEN CAST(hunk // 2 AS BIGINT) WHEN k = 1 AND hunk = 1 THEN 0 END AS change_id, CASE WHEN k = 0 AND hunk % 2 = 1 THEN 'replace' WHEN k = 1 AND hunk = 1 THEN 'delete' ELSE 'equal' END AS kind,
  CAST(min(line_no) + 1 AS INTEGER) AS source_line, CAST(min(line_no) + 1 - CASE WHEN k = 1 AND hunk = 2 THEN 1 ELSE 0 END AS INTEGER) AS checked_line, string_agg(original, '' ORDER BY line_no) AS original, string_agg(output, '' ORDER BY line_no) AS output FROM {_HUNKED} h GROUP BY doc_id, k, hunk
UNION ALL SELECT DISTINCT doc_id, 3, 1, 'insert', 11, 10, '', 'mới' || chr(10) FROM {LINES} l WHERE doc_id % 3 = 1)"""
_CHANGES = f"(SELECT *, trim(original, chr(10)) AS wrong, trim(output, chr(10)) AS correct FROM {_HUNKS} h WHERE change_id IS NOT NULL)"


@register(f"SELECT * FROM {_HUNKS} h")
def r3_hunks(spark, sf):
    return memory.hunks(_edited(spark, sf))


@register(f"""SELECT doc_id, change_id, substring(sha256(wrong || chr(0) || correct), 1, 16) AS id, wrong, correct, kind, CASE WHEN kind = 'replace' THEN CAST(round(10000 * (length(wrong) / (length(wrong) + 1.0))) AS BIGINT) END AS similarity, source_line, checked_line, CASE WHEN kind = 'replace' THEN '' ELSE 'empty' END AS reason FROM {_CHANGES} c""")
def r6_candidates(spark, sf):
    return memory.candidates(memory.hunks(_edited(spark, sf))).withColumn("similarity", F.round(F.col("similarity") * 10000).cast("long"))


@register("""SELECT p_partkey, CASE WHEN own THEN replace(said, p_brand || ';', 'B' || p_brand[7:] || ';') ELSE replace(said, 'Brand#', 'Br') END AS corrected,
  substring(sha256(CASE WHEN own THEN p_brand || ';' || chr(0) || 'B' || p_brand[7:] || ';' ELSE 'Brand#' || chr(0) || 'Br' END), 1, 16) AS rule, 2 AS n
FROM (SELECT p_partkey, p_brand, p_brand || ';' || p_brand || ';' AS said, CAST(p_brand[-1:] AS INTEGER) < 3 AS own FROM part) p""")
def r7_replay(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    brands = part.select("p_brand").distinct().where("CAST(right(p_brand, 1) AS INT) < 3")  # the others are left to the rule of their beginning
    brands = brands.select(F.expr("p_brand || ';' AS wrong"), F.expr("'B' || substring(p_brand, 7) || ';' AS correct"), F.lit(False).alias("blocked"))
    more = spark.createDataFrame([("Brand#", "Br", False), ("Br", "zzz", True), ("B", "B", False)], "wrong string, correct string, blocked boolean")
    rules = brands.unionByName(more).withColumn("id", t.rule_id(F.col("wrong"), F.col("correct"))).withColumn("seq", F.xxhash64("wrong"))
    texts = part.select("p_partkey", F.expr("p_brand || ';' || p_brand || ';' AS text"))
    return memory.replay(texts, rules).select("p_partkey", "corrected", F.explode("applied").alias("a")).select("p_partkey", "corrected", F.col("a.id").alias("rule"), "a.n")


@register("SELECT substring(sha256(p_brand || ';' || chr(0) || 'x'), 1, 16) AS id, CASE WHEN ends_with(p_brand, '1') THEN 1 ELSE 3 END + count(*) AS applied_count FROM part GROUP BY p_brand")
def r7_counters(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    rules = part.select(F.concat("p_brand", F.lit(";")).alias("wrong")).distinct().withColumn("correct", F.lit("x")).withColumn("id", t.rule_id(F.col("wrong"), F.col("correct"))).withColumn("seq", F.lit(0))
    rules = rules.withColumn("applied_count", F.when(F.col("wrong").endswith("1;"), 1).otherwise(3).cast("long"))
    return memory.count_applied(rules, memory.replay(part.select(F.concat("p_brand", F.lit(";")).alias("text")), rules)).select("id", "applied_count")


_RULE_ID = "substring(sha256(wrong || chr(0) || correct), 1, 16)"
_FOUND = "SELECT p_partkey AS at, lower(p_brand) AS wrong, upper(p_type) AS correct, CASE WHEN p_partkey % 3 > 0 THEN 'k' || p_size END AS kind FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'new' || lower(p_brand), 'x', 'n' FROM part"


@register(f"""WITH r AS (SELECT {_RULE_ID} AS id, max(seen_count) AS seen, bool_or(blocked) AS blocked FROM {RULES} r GROUP BY 1),
c AS (SELECT {_RULE_ID} AS id, count(*) AS n, arg_max(kind, "at") FILTER (WHERE kind IS NOT NULL) AS kind FROM ({_FOUND}) l GROUP BY 1)
SELECT coalesce(r.id, c.id) AS id, CASE WHEN coalesce(r.blocked, FALSE) THEN 'old' ELSE coalesce(c.kind, CASE WHEN r.id IS NOT NULL THEN 'old' END) END AS kind, coalesce(r.blocked, FALSE) AS blocked, coalesce(seen, 0) + CASE WHEN coalesce(r.blocked, FALSE) THEN 0 ELSE coalesce(n, 0) END AS seen_count FROM r FULL OUTER JOIN c ON r.id = c.id""")
def r8_learn(spark, sf):
    same = [F.first(c).alias(c) for c in ("wrong", "correct")]  # equal in all rows of an id
    rules = _rules(spark, sf).groupBy("id").agg(*same, F.max("seen_count").alias("seen_count"), F.max("applied_count").alias("applied_count"), F.bool_or("blocked").alias("blocked"), F.lit("old").alias("kind"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    found = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("at"), F.lower("p_brand").alias("wrong"), F.upper("p_type").alias("correct"), F.expr("IF(p_partkey % 3 > 0, 'k' || p_size, NULL)").alias("kind"))
    found = found.unionAll(part.select("p_partkey", F.concat(F.lit("new"), F.lower("p_brand")), F.lit("x"), F.lit("n")))
    return memory.learn(rules, found.withColumn("id", t.rule_id(F.col("wrong"), F.col("correct")))).select("id", "kind", "blocked", "seen_count")


@register(f"SELECT seq, CASE WHEN seq % 11 = 0 THEN TRUE WHEN seq % 7 = 0 THEN seq % 2 = 0 ELSE blocked END AS blocked FROM {RULES} r")
def r9_set_blocked(spark, sf):
    rules = relation(spark, sf, "rules").withColumn("id", F.col("seq"))
    first = rules.where("seq % 7 = 0").select("id", (F.col("seq") % 2 == 0).alias("blocked"), F.lit(1).alias("at"))
    commands = first.unionByName(rules.where("seq % 11 = 0").select("id", F.lit(True).alias("blocked"), F.lit(2).alias("at")))
    return memory.set_blocked(rules, commands).select("seq", "blocked")


@register("""WITH c AS (SELECT DISTINCT p_brand AS wrong, p_type AS correct FROM part), n AS (SELECT *, CAST(wrong[-1:] AS INTEGER) AS d FROM c)
SELECT wrong, correct, CASE WHEN d = 1 THEN 2 WHEN d = 2 THEN 3 ELSE 0 END AS at FROM n WHERE d IN (1, 2) OR d = 4""")
def r9_blocked_pairs(spark, sf):
    pairs = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("wrong"), F.col("p_type").alias("correct")).distinct().withColumn("d", F.expr("CAST(right(wrong, 1) AS INT)"))
    blocked = pairs.where("d > 1").select("wrong", "correct", F.lit(0).alias("at")).where("right(wrong, 1) IN ('2', '3', '4')")
    made = lambda d, on, at: pairs.where(f"d = {d}").select("wrong", "correct", F.lit(on).alias("blocked"), F.lit(at).alias("at"))
    commands = made(1, False, 1).unionByName(made(1, True, 2)).unionByName(made(2, True, 3)).unionByName(made(3, True, 1)).unionByName(made(3, False, 2))
    return memory.blocked_pairs(blocked, commands)


@register(f"SELECT doc_id, change_id, kind, source_line, checked_line, original, output AS ai_output, FALSE AS truncated, change_id % 2 = 0 AS reversed FROM {_CHANGES} c")
def r10_change_rows(spark, sf):
    changes = memory.hunks(_edited(spark, sf))
    return memory.change_rows(changes, changes.where("change_id % 2 = 0").select("doc_id", "change_id"))


@register(f"SELECT doc_id, string_agg(CASE WHEN change_id % 2 = 0 THEN original ELSE output END, '' ORDER BY hunk) AS markdown FROM {_HUNKS} h GROUP BY doc_id")
def r11_effective(spark, sf):
    changes = memory.hunks(_edited(spark, sf))
    return memory.effective(changes, changes.where("change_id % 2 = 0").select("doc_id", "change_id"))


@register(f"SELECT doc_id, change_id, wrong, correct FROM {_CHANGES} c WHERE change_id = 1")
def m12_change_texts(spark, sf):
    edited = _edited(spark, sf)
    return memory.change_texts(memory.hunks(edited), edited.select("doc_id").withColumn("change_id", F.lit(1).cast("long")))


@register(f"SELECT wrong, correct, change_id = 1 AS blocked, 5 AS at FROM {_CHANGES} c WHERE change_id < 2")
def m14_reverse_changes(spark, sf):
    changes = memory.hunks(_edited(spark, sf))
    ids = changes.where("change_id >= 0").select("doc_id", "change_id")
    commands = ids.where("change_id < 2").withColumn("on", F.col("change_id") == 1).withColumn("at", F.lit(5))
    return memory.reverse_changes(changes, ids, commands)[2]


@register("SELECT event_id, CASE WHEN event_id > 3 THEN [3, event_id] WHEN event_id = 3 THEN [3] ELSE [event_id, 3] END AS ids FROM events")
def r12_reversal_ids(spark, sf):
    payload = F.concat(F.lit('[3,"-1",3,"x",'), F.col("event_id").cast("string"), F.lit("]"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", memory.reversal_ids(payload).alias("ids"))


# ---- declared search semantics (X1-X4) -------------------------------------

_TOKENS = "SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents"
_QUERY = "SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM benchmark"


@register(f"""WITH q AS ({_QUERY}), p AS (SELECT * FROM ({_TOKENS}) t WHERE token <> '' AND token IN (SELECT token FROM q)),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
s AS (SELECT q.query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score FROM p JOIN q ON p.token = q.token JOIN d ON d.token = p.token, n GROUP BY q.query_id, p.doc_id)
SELECT query_id, doc_id, CAST(round(score * 10000) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) x WHERE r <= 10""")
def x1_term_scores(spark, sf):
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.TermIndex(_docs(spark, sf)).best(queries).select("query_id", "doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


@register(f"""WITH q AS ({_QUERY}), p AS (SELECT * FROM ({_TOKENS}) t WHERE token <> '' AND token IN (SELECT token FROM q)),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
s AS (SELECT q.query_id, p.doc_id, sum(1.5 * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score FROM p JOIN q ON p.token = q.token JOIN d ON d.token = p.token, n GROUP BY q.query_id, p.doc_id),
f AS (SELECT s.query_id, s.doc_id, s.score + 3.0 * c.n_chars / (c.n_chars + 2000.0) AS score FROM s JOIN documents c ON s.doc_id = c.doc_id)
SELECT query_id, doc_id, CAST(round(score * 10000) AS BIGINT) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM f) x WHERE place <= 10""")
def x4_rank_features(spark, sf):
    """Terms and a document's length as a saturated rank feature."""
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = search.TermIndex(_docs(spark, sf), 3.0 * search.saturation(F.col("n_chars"), 2000.0))
    return index.best(queries, boost=1.5).select("query_id", "doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@register("""SELECT query_id, vec_id, CAST(round(score * 1000000) AS BIGINT) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place
FROM (SELECT b.vec_id AS query_id, a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) x) y WHERE place <= 10""")
def x3_nearest(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = search.VectorIndex(vectors).nearest(asked)
    return best.select("query_id", "vec_id", F.round(F.col("score") * 1000000).cast("long").alias("score"), F.col("place").cast("long").alias("place"))


# ---- smaller operators -----------------------------------------------------


@register("""SELECT event_id, o AS offset_, CASE WHEN p % 2 = 0 THEN repeat('ab', 50) ELSE repeat('ba', 50) END[1:o - p] AS text FROM (
  SELECT event_id, p, p + least(100, 512 - p) AS o FROM (SELECT event_id, CASE WHEN event_id % 900 > 512 THEN 0 ELSE event_id % 900 END AS p FROM events) e) x""")
def s11_log_tail(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("content", F.repeat(F.lit("ab"), 256).cast("binary"))
    return events.select("event_id", *t.log_tail(F.col("content"), F.col("event_id") % 900, 100)).select("event_id", F.col("offset").alias("offset_"), "text")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey // 1000 % 20 = 7 THEN 'later' WHEN o_orderkey % 4000 < 40 THEN 'succeeded' ELSE o_orderstatus END AS status, o_custkey AS owner FROM orders
UNION ALL SELECT -1 - o_orderkey, 'queued', o_custkey FROM orders WHERE o_orderkey % 300 = 0""")
def s14_versioned(spark, sf):
    """Three commits: all records; one in a hundred side by side, and new ones before all others; a stretch again, its owners kept."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    table = VersionedTable(spark, new_path(spark, "versioned"), "o_orderkey", "o_orderkey long, status string, owner long", 20_000)
    records = orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("owner"))
    table.upsert(records)
    fresh = records.where("o_orderkey % 300 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("queued").alias("status"), "owner")
    table.upsert(records.where("o_orderkey % 4000 < 40").withColumn("status", F.lit("succeeded")).unionByName(fresh))
    table.upsert(records.where("o_orderkey div 1000 % 20 = 7").select("o_orderkey", F.lit("later").alias("status"), F.lit(-1).cast("long").alias("owner")), keep=("owner",))
    return table.read()


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE o_orderstatus END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders")
def s12_history(spark, sf):
    old = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    new = old.where("o_orderkey % 2 = 0").withColumn("status", F.lit("succeeded")).withColumn("seq", F.lit(1))
    latest = catalog.history(catalog.upsert(old, new, "o_orderkey"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return latest.select("o_orderkey", "status", F.col("place").cast("long").alias("n"))


@register(f"SELECT page_id, seq, x0 + 3 AS x0, top, least(x1, 639) AS x1, bottom - 2 AS bottom FROM {LAYOUT} l WHERE floor(sqrt((least(x1, 639) - x0 - 3) * (least(x1, 639) - x0 - 3) + 4)) > 3 AND floor(sqrt(9 + (bottom - top - 2) * (bottom - top - 2))) > 3")
def p5_detector_quads(spark, sf):
    # Slightly turned, in no order: from the corner nearest the origin to the right, down and back.
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, top, x1, bottom = (F.col(c) for c in g.EDGES)
    quad = F.array(point(x1, bottom), point(x0 + 3, top), point(x0, bottom - 2), point(x1, top + 2))
    found = relation(spark, sf, "layout_boxes").withColumn("quad", g.clipped(g.clockwise(quad), PAGE_WIDTH, PAGE_HEIGHT)).where(g.wide_enough(F.col("quad")))
    return found.select("page_id", "seq", *g.quad_box(F.col("quad")))


@register("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'reference' WHEN 3 THEN 'figure' END AS label FROM events")
def p8_class_labels(spark, sf):
    number = F.when(F.col("event_id") % 6 == 5, -1).otherwise(F.col("event_id") % 6)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.class_label(number, ("Title", "Text", "Reference", "Figure")).alias("label"))


@register("""SELECT o_orderkey, o_orderstatus <> 'F' AS ne, o_custkey < 50 AS lt, o_custkey <= 50 AS le, o_custkey > 50 AS gt, o_custkey >= 50 AS ge, o_orderstatus = 'O' AS eq, o_custkey IN (1, 2, 3) AS among, o_custkey NOT IN (1, 2) AS not_among,
o_orderpriority LIKE '%-URGENT' AS alike, o_orderpriority ILIKE '%urgent' AS ilike, xor(o_custkey, 5) <> 0 AS differs, o_custkey BETWEEN 5 AND 9 AS ranged, contains(lower(o_orderpriority), 'high') AS holds, starts_with(o_orderpriority, '1') AS starts, ends_with(o_orderpriority, 'T') AS ends, FALSE AS missing FROM orders""")
def p11_conditions(spark, sf):
    tests = {
        "ne": ("o_orderstatus", ("!=", "F")), "lt": ("o_custkey", ("<", 50)), "le": ("o_custkey", ("<=", 50)), "gt": ("o_custkey", (">", 50)), "ge": ("o_custkey", (">=", 50)), "eq": ("o_orderstatus", "O"),
        "among": ("o_custkey", ("<<", [1, 2, 3])), "not_among": ("o_custkey", ("~", [1, 2])), "alike": ("o_orderpriority", ("%", "%-URGENT")), "ilike": ("o_orderpriority", ("**", "%urgent")), "differs": ("o_custkey", ("^", 5)),
        "ranged": ("o_custkey", ("between", (5, 9))), "holds": ("o_orderpriority", ("contains", "HIGH")), "starts": ("o_orderpriority", ("startswith", "1")), "ends": ("o_orderpriority", ("endswith", "T")), "missing": ("o_custkey", (">>", None)),
    }
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", *[catalog.condition({field: test}).alias(name) for name, (field, test) in tests.items()])


@register(f"SELECT page_id, string_agg(type || CASE WHEN type = 'figure' THEN '=a.png' ELSE '' END, ';' ORDER BY seq) AS regions FROM {LAYOUT} l GROUP BY page_id")
def p13_compact_regions(spark, sf):
    asset = F.when(F.col("type") == "figure", "a.png").when(F.col("type") == "table", "")
    boxes = relation(spark, sf, "layout_boxes").withColumn("asset_path", asset).withColumn("ignored", F.lit(1))
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "asset_path", "ignored"))).alias("regions"))
    shown = F.transform(t.compact_regions(F.col("regions")), lambda r: F.concat(r["layout_type"], F.coalesce(F.concat(F.lit("="), r["asset_path"]), F.lit(""))))
    return pages.select("page_id", F.array_join(shown, ";").alias("regions"))


@register(f"""SELECT page_id, seq, hit FROM (SELECT a.page_id, a.seq, b.seq AS hit, row_number() OVER (PARTITION BY a.page_id, a.seq ORDER BY {_COMMON} DESC, b.seq) AS r
FROM {OCR} a JOIN {LAYOUT} b ON a.page_id = b.page_id AND {_TOUCH} WHERE {_COMMON} > 0) x WHERE r = 1""")
def j4_most_overlap(spark, sf):
    return assign.most_overlap(relation(spark, sf, "ocr_boxes"), relation(spark, sf, "layout_boxes"))


@register(f"SELECT doc_id, change_id, CASE change_id WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS issue FROM {_CHANGES} c")
def j10_issue_pairing(spark, sf):
    edited = _edited(spark, sf)
    issues = edited.select("doc_id", F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("change_id", "issue"))
    return memory.candidates(memory.hunks(edited), issues.withColumn("change_id", F.col("change_id").cast("long"))).select("doc_id", "change_id", "issue")


@register("""SELECT p_brand, string_agg(reason || '=' || n, ';' ORDER BY reason) AS skipped FROM (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'same' ELSE 'too_long' END AS reason, count(*) AS n FROM part WHERE p_partkey % 4 < 3 GROUP BY ALL) x GROUP BY p_brand""")
def a7_skip_reasons(spark, sf):
    k = F.col("p_partkey") % 4
    wrong = F.when(k == 0, "").when(k == 1, "abc").when(k == 2, F.repeat(F.lit("a"), 241)).otherwise("abd")
    found = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", memory.candidate_reason(wrong, F.lit("abc"), F.lit(0.9)).alias("reason"))
    shown = F.transform(F.array_sort(F.map_entries("skipped")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.skip_reasons(found, ["p_brand"]).select("p_brand", F.array_join(shown, ";").alias("skipped"))


@register(f"SELECT CASE WHEN page_id % 10 < 6 THEN page_id // 10 ELSE 1000000 + page_id END AS table_id, count(DISTINCT page_id) > 1 AS cross_page FROM {LAYOUT} l GROUP BY 1")
def a8_cross_page(spark, sf):
    boxes = relation(spark, sf, "layout_boxes").withColumn("table_id", F.expr("IF(page_id % 10 < 6, page_id div 10, 1000000 + page_id)"))
    return stats.cross_page(boxes, ["table_id"], "page_id")


@register()
def o2_sort_columns(spark, sf):
    return order.ordered(relation(spark, sf, "ocr_boxes"), lambda rows: order.fuzzy(rows, "x0", "top", 10))


@register(f"SELECT table_id, seq, row_number() OVER (PARTITION BY table_id ORDER BY seq) - 1 AS place FROM {CELLS} c")
def o3_sort_by_rows(spark, sf):
    return order.ordered(_tagged(spark, sf), lambda rows: order.by_tag(rows, "R", "x0", "top", "x0", 0), "table_id")


@register(f"SELECT page_id // 4 AS doc_id, string_agg(m, '\n\n' ORDER BY page_id) AS markdown FROM (SELECT page_id, string_agg(text, '\n\n' ORDER BY top, seq) AS m FROM {OCR} o GROUP BY page_id) x GROUP BY 1")
def o6_assemble_pages(spark, sf):
    regions = relation(spark, sf, "ocr_boxes").withColumn("doc_id", F.expr("page_id div 4")).withColumnRenamed("page_id", "page_no")
    return document.assemble(regions)


@register(f"SELECT seq, row_number() OVER (PARTITION BY seq % 40 ORDER BY length(wrong) DESC, seq) AS place FROM {RULES} r")
def o7_rule_order(spark, sf):
    rules = relation(spark, sf, "rules").withColumn("owner", F.col("seq") % 40)
    return memory.rule_order(rules, ["owner"]).select("seq", F.col("place").cast("long").alias("place"))


@register(f"SELECT table_id, string_agg(text, ' ' ORDER BY seq) AS caption FROM {CELLS} c WHERE seq % 4 = 3 GROUP BY table_id")
def w10_captions(spark, sf):
    boxes = relation(spark, sf, "table_cells").withColumn("layout_type", F.when(F.col("seq") % 4 == 3, "table caption").otherwise("table"))
    return tables.captions(boxes)


_ALPHABET = "B#0123456789 abcdefghijklmnopqrstuvwxyz"


@register(f"SELECT p_partkey, [1] || list_transform(string_split(said, ''), lambda c: strpos('{_ALPHABET}', c) + 3) || [2] AS ids, said AS text FROM (SELECT p_partkey, p_brand || ' ' || lower(p_type) AS said FROM part) p")
def t21_vocabulary(spark, sf):
    ids = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", t.encode(F.expr("p_brand || ' ' || lower(p_type)"), _ALPHABET).alias("ids"))
    return ids.select("p_partkey", "ids", t.decode(F.col("ids"), _ALPHABET).alias("text"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CAST(l_partkey AS DOUBLE) / 7, 4) AS share, CASE WHEN l_quantity > 0 THEN round(CAST(l_linenumber AS DOUBLE) / 7, 4) ELSE 0.0 END AS part FROM lineitem")
def t12_rounded(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    share = stats.ratio(F.col("l_linenumber").cast("double"), F.when(F.col("l_quantity") > 0, F.lit(7)))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", stats.rounded(F.col("l_partkey").cast("double") / 7).alias("share"), share.alias("part"))


@register("SELECT event_id, props AS props FROM events")
def t19_json_round_trip(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", F.get_json_object(F.to_json(F.struct("props")), "$.props").alias("props"))


_DECIDED = {
    "always": ("TRUE", "'always'", "'VLM_POSTCHECK_TRIGGER=always'"), "never": ("FALSE", "'never'", "'VLM_POSTCHECK_TRIGGER=never'"),
    " Risk_Or_Low_Confidence ": ("low OR risky", "'risk_or_low_confidence'", "CASE WHEN risky THEN 'VLM risks present' WHEN low THEN 'low confidence gate matched' ELSE 'no VLM risk and OCR confidence passed' END"),
    "other": ("low", "'low_confidence'", "CASE WHEN low THEN 'x; y' ELSE 'OCR confidence passed; VLM post-check skipped' END"),
}


@register("SELECT event_id, NOT off AS enabled, CASE WHEN off THEN FALSE " + " ".join(f"WHEN k = {i} THEN {v[0]}" for i, v in enumerate(_DECIDED.values())) + " END AS run, CASE WHEN off THEN 'disabled' " + " ".join(f"WHEN k = {i} THEN {v[1]}" for i, v in enumerate(_DECIDED.values())) + " END AS trigger, CASE WHEN off THEN 'GEMINI_POSTCHECK=false' " + " ".join(f"WHEN k = {i} THEN {v[2]}" for i, v in enumerate(_DECIDED.values())) + " END AS reason FROM (SELECT event_id, event_id % 4 AS k, event_id % 3 = 0 AS low, event_id % 5 = 0 AS risky, event_id % 7 = 0 AS off FROM events) e")
def r2_decisions(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    reasons = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    trigger = F.element_at(F.array(*map(F.lit, _DECIDED)), (F.col("event_id") % 4 + 1).cast("int"))
    made = stats.decision(trigger, reasons, (F.col("event_id") % 5 == 0).cast("int"), F.col("event_id") % 7 != 0)
    return events.select("event_id", made.alias("d")).select("event_id", "d.*")


@register()
def r4_similarity(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", F.round(memory.similarity(F.col("p_name"), F.col("p_type")), 4).alias("ratio"))


@register("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'same' WHEN 2 THEN 'too_long' WHEN 3 THEN 'too_many_lines' WHEN 4 THEN 'structured_or_asset' ELSE 'low_similarity' END AS reason FROM part""")
def r5_candidate_reasons(spark, sf):
    which = F.col("p_partkey") % 6
    wrong = F.when(which == 0, "").when(which == 2, F.repeat(F.lit("a"), 241)).when(which == 3, "a\nb\nc\nd\ne").when(which == 4, "![x](y)").otherwise("abc")
    correct = F.when(which == 1, "abc").otherwise("zzz")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", memory.candidate_reason(wrong, correct, F.lit(0.5)).alias("reason"))


@register("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'disabled' WHEN event_id % 4 = 1 THEN 'skipped' WHEN event_id % 4 = 2 THEN 'failed' ELSE 'ok' END AS status FROM events")
def r14_review_status(spark, sf):
    k = F.col("event_id") % 4
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.review_status(k != 0, k != 1, k == 2).alias("status"))


@register("SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[\\s#]+'), lambda x: x <> ''), '|') AS tokens FROM documents")
def x2_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(search.tokens(F.col("text"), True), "|").alias("tokens"))


@register("SELECT event_id, CAST(epoch(CASE event_id % 4 WHEN 1 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END) AS BIGINT) AS seconds FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def x4_dates(spark, sf):
    kinds = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd_HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", kinds[0])).when(k == 1, F.date_format("ts", kinds[1])).when(k == 2, F.date_format("ts", kinds[2])).otherwise("12/31/99")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.unix_seconds(search.any_date(text)).alias("seconds"))


@register("SELECT p_partkey, CASE WHEN p_type LIKE '%\\_vec' THEN 'dense_vector' WHEN p_partkey % 3 = 0 THEN 'integer' WHEN p_partkey % 3 = 1 THEN 'dense_vector' ELSE 'date' END AS kind FROM part")
def x4_field_types(spark, sf):
    name = F.expr("concat('f', CASE p_partkey % 3 WHEN 0 THEN '_int' WHEN 1 THEN '_768_vec' ELSE '_dt' END)")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", catalog.suffix_type(name).alias("kind"))


@register("SELECT o_orderkey, greatest(0, o_custkey - o_orderkey) * 1.0 AS seconds FROM orders")
def m10_duration(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", catalog.duration(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")).alias("seconds"))


@register(f"SELECT file_id, CASE WHEN ends_with(path, '_vlm_checked.md') THEN replace(path, '_vlm_checked.md', '_vlm_user.md') ELSE regexp_replace(path, '\\.[^.]*$', '') || '_user.md' END AS user_path FROM {FILES} f")
def m13_user_file(spark, sf):
    return relation(spark, sf, "files").select("file_id", t.user_file(F.col("path")).alias("user_path"))


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [1, 2, 5] ELSE [1] END AS ids FROM events")
def m14_toggle(spark, sf):
    on = F.col("event_id") % 2 == 0
    ids = F.array(F.lit(1), F.lit(2))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", memory.toggle(ids, F.when(on, 5).otherwise(2), on).alias("ids"))


@register("SELECT item_id, array_to_string(list_reverse(regexp_extract_all(text, '(?s)([a-zA-Z0-9 :*./%+-]+|.)')), '') AS text FROM benchmark UNION ALL SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(text, '(?s)([a-zA-Z0-9 :*./%+-]+|.)')), '') FROM documents")
def m20_right_to_left(spark, sf):
    both = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").unionAll(_docs(spark, sf).select("doc_id", "text"))
    return both.select("item_id", t.right_to_left(F.col("text")).alias("text"))


@register(f"SELECT page_id, seq, least(greatest(CAST(ceil(CAST(trunc(32.0 * (x1 - x0) / (bottom - top)) AS DOUBLE) / 10) * 10 AS BIGINT), 32), 512) AS width FROM {LAYOUT} l")
def k13_line_width(spark, sf):
    return relation(spark, sf, "layout_boxes").select("page_id", "seq", g.line_width(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")).alias("width"))


_LONG, _SHORT = "greatest(w, h)", "least(w, h)"
_SCALES = {"max": f"CASE WHEN {_LONG} > 120 THEN 120.0 / {_LONG} ELSE 1.0 END", "min": f"CASE WHEN {_SHORT} < 40 THEN 40.0 / {_SHORT} ELSE 1.0 END", "resize_long": f"120.0 / {_LONG}"}
_SIDE = "greatest(CAST(round_even(CAST(trunc({v} * CAST({s} AS DOUBLE)) AS BIGINT) / 32.0, 0) * 32 AS BIGINT), 32) AS {n}_{k}"


@register("SELECT page_id, seq, " + ", ".join(_SIDE.format(v=v, s=s, n=n, k=k) for k, s in _SCALES.items() for v, n in (("w", "width"), ("h", "height"))) + f" FROM (SELECT page_id, seq, x1 - x0 AS w, bottom - top AS h FROM {LAYOUT} l) b")
def k1_detector_size(spark, sf):
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    limits = {"max": 120, "min": 40, "resize_long": 120}
    sizes = [c.alias(f"{n}_{k}") for k, limit in limits.items() for n, c in zip(("width", "height"), g.detector_size(w, h, limit, k), strict=True)]
    return relation(spark, sf, "layout_boxes").select("page_id", "seq", *sizes)


@register(f"SELECT page_id, seq, CAST(least(greatest(round_even(x0 - 20 + 0.5 * (seq % 2), 0), 0), 640) AS BIGINT) AS x0, CAST(least(greatest(round_even(top + 0.5, 0), 0), 800) AS BIGINT) AS top, CAST(least(greatest(round_even(x1 + 100.5, 0), 0), 640) AS BIGINT) AS x1, CAST(least(bottom, 800) AS BIGINT) AS bottom FROM {LAYOUT} l")
def p1_clamped_box(spark, sf):
    boxes = relation(spark, sf, "layout_boxes").select("page_id", "seq", (F.col("x0") - 20 + 0.5 * (F.col("seq") % 2)).alias("x0"), (F.col("top") + 0.5).alias("top"), (F.col("x1") + 100.5).alias("x1"), "bottom")
    return boxes.select("page_id", "seq", *g.clamped_box(PAGE_WIDTH, PAGE_HEIGHT))


@register(f"SELECT page_id, seq FROM {OCR} o WHERE seq % 5 <> 0 AND seq % 7 <> 0")
def p4_fit_boxes(spark, sf):
    boxes = relation(spark, sf, "ocr_boxes").withColumn("x1", F.when(F.col("seq") % 5 == 0, F.col("x0") - 1).otherwise(F.col("x1"))).withColumn("text", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("text")))
    return boxes.where(~g.degenerate() & (F.col("text") != "")).select("page_id", "seq")


@register(f"SELECT page_id, seq, x0, top, x1, bottom, 1.0 AS score FROM {OCR} o")
def m7_ocr_lines(spark, sf):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    quad = F.array(point("x0", "top"), point("x1", "top"), point("x1", "bottom"), point("x0", "bottom"))
    return relation(spark, sf, "ocr_boxes").select("page_id", "seq", *g.ocr_line(quad))


@register(f"SELECT table_id, seq, row_number() OVER (PARTITION BY table_id ORDER BY seq % 4, seq) - 1 AS place FROM {CELLS} c")
def o3_sort_by_columns(spark, sf):
    return order.ordered(_tagged(spark, sf), lambda rows: order.by_tag(rows, "C", "top", "x0", "top", 40), "table_id")


@register("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, CAST(epoch(date_trunc('second', ts)) * 1000 AS BIGINT) AS back, CAST(epoch(date_trunc('second', ts)) * 1000 AS BIGINT) AS cut, 0 AS wait FROM events")
def t18_millis(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    text = t.from_millis(F.col("ms"))
    return events.select("event_id", text.alias("text"), t.to_millis(text).alias("back"), t.to_second(F.col("ms")).alias("cut"), t.seconds_between(F.col("ms") + 999, F.col("ms")).alias("wait"))


@register("SELECT event_id, '{\"at\":\"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '\",\"n\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"kind\":\"' || event_type || '\"' ELSE '' END || '}' AS json, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, event_id AS n, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events")
def t19_typed_json(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    made = events.select("event_id", t.encoded(F.struct(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), F.expr("IF(event_id % 2 = 0, event_type, NULL)").alias("kind"))).alias("json"))
    read = made.withColumn("d", t.decoded(F.col("json"), "at timestamp, n long, kind string"))
    return read.select("event_id", "json", F.unix_seconds("d.at").alias("seconds"), "d.n", "d.kind")


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 90.0 ELSE 25.0 END AS elapsed_seconds, CASE WHEN o_orderkey % 4 = 2 THEN 'full.md' END AS markdown_name, o_orderkey % 4 = 2 AS has_markdown, o_orderkey % 8 = 2 AS changes_available FROM orders")
def m11_job_rows(spark, sf):
    k = F.col("o_orderkey") % 4
    jobs = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.lit(0.0).alias("created_at"), F.when(k > 0, 10.0).alias("started_at"), F.when(k > 1, 35.0).alias("finished_at"), F.when(k > 1, k - 2).alias("exit_code"),
        F.when(k == 2, "/out/full.md").alias("markdown_path"), F.lit(None).cast("string").alias("metadata_path"), F.when(F.col("o_orderkey") % 8 == 2, "/out/review.json").alias("review_path"),
    )
    state = catalog.job_state(F.col("started_at"), F.col("finished_at"), F.col("exit_code"), F.col("markdown_path"))
    return catalog.job_rows(jobs.withColumn("status", state), F.lit(100.0)).select("o_orderkey", "status", "elapsed_seconds", "markdown_name", "has_markdown", "changes_available")


@register(f"SELECT DISTINCT page_id // 10 AS doc_id, 'scan.pdf' AS input, 'd' || CAST(page_id // 10 AS VARCHAR) || '_full.md' AS output_markdown, 'assets' AS assets_dir FROM {LAYOUT} l")
def m5_envelope(spark, sf):
    docs = relation(spark, sf, "layout_boxes").select(F.expr("page_id div 10").alias("doc_id")).distinct()
    return document.envelope(docs.withColumn("output_path", F.format_string("/out/d%d/d%d_full.md", "doc_id", "doc_id")), "scan.pdf").drop("generated_at")


@register(f"""SELECT page_id, seq, CASE WHEN own THEN 'had.png' WHEN new THEN printf('page_%03d_risk_%03d_%s.png', page_id, count(*) FILTER (WHERE own) OVER p + count(*) FILTER (WHERE new) OVER (p ORDER BY seq), type) END AS asset_path
FROM (SELECT page_id, seq, type, seq % 6 = 5 AS own, seq % 6 <> 5 AND seq % 4 <> 3 AND seq < 9 AS new FROM {LAYOUT} l) x WINDOW p AS (PARTITION BY page_id)""")
def m6_risk_assets(spark, sf):
    boxes = relation(spark, sf, "layout_boxes").withColumnRenamed("type", "category").withColumn("asset_path", F.expr("IF(seq % 6 = 5, 'had.png', NULL)"))
    boxes = boxes.withColumns({c: F.expr(f"IF(seq % 4 = 3, NULL, {c})") for c in g.EDGES})
    return document.risk_assets(boxes, 9, PAGE_WIDTH, PAGE_HEIGHT).select("page_id", "seq", "asset_path")


@register("SELECT c_custkey, 1700000000123 AS create_time, '2023-11-14 22:13:20' AS create_date, 1700000000123 AS update_time, '2023-11-14 22:13:20' AS update_date FROM customer")
def m15_audited(spark, sf):
    return catalog.audited(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), F.lit(1_700_000_000_123))


# ---- streams over the tables -------------------------------------------------

_JOB_KINDS = "CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'finish' END"
_JOB_ID = "concat(CAST(user_id AS VARCHAR), '-', CAST(event_id // 97 AS VARCHAR))"


@register(f"""WITH e AS (SELECT {_JOB_ID} AS job_id, event_id, ts, {_JOB_KINDS} AS kind, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS code FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, kind ORDER BY ts DESC, event_id DESC) AS r FROM e),
j AS (SELECT job_id, min(CASE WHEN kind = 'queue' THEN ts END) AS created_at FROM e GROUP BY job_id),
s AS (SELECT job_id, ts FROM k WHERE kind = 'start' AND r = 1), f AS (SELECT job_id, ts, code FROM k WHERE kind = 'finish' AND r = 1),
w AS (SELECT max(ts) - INTERVAL 10 DAY AS mark FROM e)
SELECT j.job_id, created_at, s.ts AS started_at, f.ts AS finished_at, f.code AS returncode,
  CASE WHEN l.kind = 'start' AND mark >= s.ts + INTERVAL 1 DAY THEN 'failed' WHEN l.kind = 'finish' AND l.code <> 0 THEN 'failed'
    WHEN l.kind = 'finish' THEN 'succeeded' WHEN l.kind = 'start' THEN 'running' ELSE 'queued' END AS status,
  CASE WHEN l.kind = 'start' AND mark >= s.ts + INTERVAL 1 DAY THEN 'No result in time' WHEN l.kind = 'finish' AND l.code <> 0 THEN concat('Pipeline exited with code ', CAST(l.code AS VARCHAR)) END AS error
FROM j JOIN l ON j.job_id = l.job_id AND l.r = 1 LEFT JOIN s ON j.job_id = s.job_id LEFT JOIN f ON j.job_id = f.job_id CROSS JOIN w""")
def u4_job_stream(spark, sf):
    """All events as job events, each twice, in three micro-batches that follow no order of time within a day."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'finish' END")
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.expr("concat(CAST(user_id AS STRING), '-', CAST(event_id DIV 97 AS STRING))").alias("job_id"), "event_id", "ts", kind.alias("kind"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("code")
    )
    source, out, check = (new_path(spark, f"jobs-{x}") for x in ("in", "out", "check"))
    for i in range(3):  # each event in two of the batches
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) != i).write.mode("append").parquet(source)
    stream = spark.readStream.schema(jobs.EVENT).parquet(source)
    shown = jobs.rows(stream, 86_400, 10 * 86_400, slots=64 + events.count() // 4_096)
    shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return jobs.latest(spark.read.schema(jobs.ROW).parquet(out)).drop("version")


@register("""SELECT event_type, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) AS n_lines, CAST(sum(length(line) - length(replace(line, '€', ''))) AS BIGINT) AS n_euros
FROM (SELECT event_type, concat(CAST(event_id AS VARCHAR), ' é', repeat('€', CAST(event_id % 7 AS INTEGER)), ' ', props, chr(10)) AS line FROM events) e GROUP BY event_type""")
def s11_log_stream(spark, sf):
    """A log of every event, read back by byte offsets in small pieces."""
    line = F.concat(F.col("event_id").cast("string"), F.lit(" é"), F.expr("repeat('€', CAST(event_id % 7 AS INT))"), F.lit(" "), F.col("props"))
    logs, out, check = (new_path(spark, f"log-{x}") for x in ("in", "out", "check"))
    spark.read.parquet(f"{sf}/events.parquet").select("event_type", line.alias("value")).write.partitionBy("event_type").text(logs)
    spark.dataSource.register(ByteLog)
    stream = spark.readStream.format("byte_log").option("limit", 4_096).load(logs)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("file string, start long, end long, text string").parquet(out)
    had = lambda c: F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))).alias
    return read.groupBy(F.regexp_extract("file", "event_type=([^/]*)/", 1).alias("event_type")).agg(
        F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.sum(F.length("text")).alias("n_chars"), had("\n")("n_lines"), had("€")("n_euros")
    )


# ---- rasters (K7, W1) ----------------------------------------------------------

#: One pixel an event, 30 by 30 a page; blocks of 4 by 3 pixels have one probability.
_PIXELS = """SELECT page_id, y, x, CAST((x {d} 4 * 5 + y {d} 3 * 7 + page_id * 3) % 11 AS DOUBLE) / 10 AS p FROM (
  SELECT event_id {d} 900 AS page_id, event_id % 900 {d} 30 AS y, event_id % 30 AS x FROM {events}) e"""
_LIT = 0.65


def _pixels(spark, sf):
    return spark.sql(_PIXELS.replace("{d}", "div"), events=spark.read.parquet(f"{sf}/events.parquet"))


@register(f"""WITH RECURSIVE px AS (SELECT page_id, y, x, p, y * 30 + x AS id FROM ({_PIXELS.replace("{d}", "//").replace("{events}", "events")}) q WHERE p > {_LIT}),
near AS (SELECT a.page_id, a.id AS a, b.id AS b FROM px a JOIN px b ON a.page_id = b.page_id WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT page_id, id, id AS label FROM px UNION SELECT near.page_id, near.a, reach.label FROM reach JOIN near ON reach.page_id = near.page_id AND reach.id = near.b),
least AS (SELECT page_id, id, min(label) AS label FROM reach GROUP BY page_id, id)
SELECT px.page_id, min(x) AS x0, min(y) AS top, max(x) AS x1, max(y) AS bottom, count(*) AS n, CAST(round(1000 * sum(p) / count(*)) AS BIGINT) AS score
FROM px JOIN least ON px.page_id = least.page_id AND px.id = least.id GROUP BY px.page_id, label""")
def k7_regions(spark, sf):
    boxes = raster.boxes(raster.regions(_pixels(spark, sf), _LIT))
    return boxes.select("page_id", *[F.col(c).cast("long").alias(c) for c in (*g.EDGES, "n")], F.round(1000 * F.col("score")).cast("long").alias("score"))


@register()
def k7_quads(spark, sf):
    """Widened rectangles of the regions, in pixels of a page of twice the size."""
    found = raster.quads(raster.regions(_pixels(spark, sf), _LIT), box_threshold=0.7, scale_x=2.0, scale_y=2.0)
    return found.select("page_id", F.col("region.y").alias("y"), F.col("region.first").alias("x"), F.round("score", 6).alias("score"), "quad")


@register(f"""WITH rows_ AS (SELECT page_id, y FROM (SELECT DISTINCT page_id FROM {OCR} o) p CROSS JOIN (SELECT unnest(generate_series(0, {PAGE_HEIGHT - 1})) AS y) s),
m AS (SELECT r.page_id, y, EXISTS (SELECT 1 FROM {OCR} b WHERE b.page_id = r.page_id AND b.top <= y AND b.bottom >= y) AS has_content FROM rows_ r),
c AS (SELECT *, CASE WHEN lag(has_content) OVER (PARTITION BY page_id ORDER BY y) = has_content THEN 0 ELSE 1 END AS fresh FROM m),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY y) AS island FROM c)
SELECT page_id, min(y) AS top, max(y) AS bottom, has_content FROM i GROUP BY page_id, island, has_content""")
def w1_mask_bands(spark, sf):
    """Rows of pages that recognised lines cover, by a sweep over their edges instead of pixels."""
    return raster.mask_bands(relation(spark, sf, "ocr_boxes"), PAGE_HEIGHT)


_PX = "(" + _PIXELS.replace("{d}", "//").replace("{events}", "events") + ")"
_SIZES = f"(SELECT page_id, max(y) + 1 AS h0, max(x) + 1 AS w0 FROM {_PX} q GROUP BY page_id)"


def _sampled_sql(points: str, keys: str) -> str:
    """(page_id, keys, p) of points (page_id, keys, sy, sx, h0, w0): the four pixels around, the border repeated."""
    return f"""SELECT n.page_id, {keys}, sum(w * coalesce(q.p, 0)) AS p FROM (SELECT page_id, {keys}, greatest(0, least(CAST(floor(sy) AS BIGINT) + i, h0 - 1)) AS y, greatest(0, least(CAST(floor(sx) AS BIGINT) + j, w0 - 1)) AS x,
  (CASE i WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE j WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w
  FROM ({points}) s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)) n LEFT JOIN {_PX} q ON n.page_id = q.page_id AND n.y = q.y AND n.x = q.x GROUP BY n.page_id, {keys}"""


@register(f"""WITH k AS (SELECT page_id, h0, w0, CAST(round_even(h0 * least(24 / h0, 40 / w0), 0) AS BIGINT) AS h, CAST(round_even(w0 * least(24 / h0, 40 / w0), 0) AS BIGINT) AS w FROM {_SIZES} z),
f AS (SELECT *, CAST(round_even((24 - h) / 2 - 0.1, 0) AS BIGINT) AS up, CAST(round_even((40 - w) / 2 - 0.1, 0) AS BIGINT) AS aside FROM k),
g AS (SELECT * FROM f CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS v) a CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS u) b),
i AS ({_sampled_sql("SELECT page_id, v, u, (v - up + 0.5) * h0 / h - 0.5 AS sy, (u - aside + 0.5) * w0 / w - 0.5 AS sx, h0, w0 FROM g WHERE v >= up AND v < up + h AND u >= aside AND u < aside + w", "v, u")})
SELECT g.page_id, g.v, g.u, CAST(round(coalesce(i.p, 114) / 255 * 10000000) AS BIGINT) AS p FROM g LEFT JOIN i ON g.page_id = i.page_id AND g.v = i.v AND g.u = i.u""")
def k3_letter_box(spark, sf):
    boxed = sample.letter_boxed(_pixels(spark, sf), 24, 40)
    return boxed.select("page_id", "v", "u", F.round(F.col("p") * 10_000_000).cast("long").alias("p"))


#: Two quads a page: a slanted one, and one higher than wide.
_QUADS = """SELECT page_id, 0 AS seq, 2.0 + page_id % 3 AS x0, 3.0 AS y0, 20.0 + page_id % 5 AS x1, 2.0 + page_id % 2 AS y1, 24.0 AS x2, 14.0 + page_id % 4 AS y2, 3.0 AS x3, 12.0 AS y3 FROM {pages}
UNION ALL SELECT page_id, 1, 5.0, 2.0, 11.0, 3.0, 10.0 + page_id % 3, 25.0, 4.0, 22.0 FROM {pages}"""
_M = {"g": "((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / det", "h": "((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / det"}


@register(f"""WITH q AS ({_QUADS.replace("{pages}", f"(SELECT DISTINCT page_id FROM {_PX} d) p")}),
d AS (SELECT *, CAST((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS DOUBLE) AS det, CAST(floor(greatest(sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2), sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2))) AS BIGINT) AS w,
  CAST(floor(greatest(sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2), sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2))) AS BIGINT) AS h FROM q),
m AS (SELECT *, {_M["g"]} AS mg, {_M["h"]} AS mh FROM d),
t AS (SELECT m.page_id, seq, a.v, b.u, CAST(b.u AS DOUBLE) / w AS s, CAST(a.v AS DOUBLE) / h AS t, mg, mh, x0, y0, x1, y1, x3, y3, w, h FROM m CROSS JOIN (SELECT unnest(generate_series(0, 40)) AS v) a CROSS JOIN (SELECT unnest(generate_series(0, 40)) AS u) b WHERE a.v < h AND b.u < w),
c AS (SELECT page_id, seq, CASE WHEN h >= 1.5 * w THEN w - 1 - u ELSE v END AS v, CASE WHEN h >= 1.5 * w THEN v ELSE u END AS u,
  ((x1 - x0 + mg * x1) * s + (x3 - x0 + mh * x3) * t + x0) / (mg * s + mh * t + 1) AS sx, ((y1 - y0 + mg * y1) * s + (y3 - y0 + mh * y3) * t + y0) / (mg * s + mh * t + 1) AS sy FROM t),
r AS ({_sampled_sql(f"SELECT c.page_id, seq, v, u, sy, sx, h0, w0 FROM c JOIN {_SIZES} z ON c.page_id = z.page_id", "seq, v, u")})
SELECT page_id, seq, v, u, CAST(round(p * 1000000) AS BIGINT) AS p FROM r""")
def k8_crops(spark, sf):
    pixels = _pixels(spark, sf)
    quads = spark.sql(_QUADS, pages=pixels.select("page_id").distinct())
    return sample.crops(pixels, quads).select("page_id", "seq", "v", "u", F.round(F.col("p") * 1_000_000).cast("long").alias("p"))


# ---- reviews, records, paths (R14, M9, M10) --------------------------------------


@register("""SELECT o_orderkey AS doc_id, status, error, CASE WHEN status = 'completed' THEN upper(o_comment) ELSE o_comment END AS text, status = 'completed' AS checked FROM (
SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'disabled' WHEN o_totalprice < 60000 THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' ELSE 'completed' END AS status FROM (
SELECT *, CASE WHEN o_orderkey % 7 = 0 OR o_totalprice < 60000 THEN NULL WHEN o_custkey % 5 = 0 THEN 'no key was given' WHEN o_orderpriority = '1-URGENT' THEN concat('timed out after ', CAST(o_custkey AS VARCHAR))
  WHEN o_orderkey % 4 = 1 OR o_orderkey % 11 = 3 THEN 'the reply holds no checked text' END AS error FROM (SELECT *, concat(o_orderpriority, ' "', CAST(o_custkey AS VARCHAR), '"') AS o_comment FROM orders) o) e) s""")
def r14_reviewed(spark, sf):
    """Every order as a document: switched off, not due, without a key, with a failed call, a reply without JSON or none at all, or a checked text in fences."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    said = F.concat("o_orderpriority", F.lit(' "'), F.col("o_custkey").cast("string"), F.lit('"'))
    decided = o.select(
        F.col("o_orderkey").alias("doc_id"), said.alias("markdown"), (F.col("o_orderkey") % 7 != 0).alias("enabled"), (F.col("o_totalprice") >= 60000).alias("run"), (F.col("o_custkey") % 5 != 0).alias("has_key")
    )
    good = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.upper(said).alias("checked_markdown"), F.lit(0.9).alias("confidence"))), F.lit("\n```"))
    reply = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Sorry, "), said)).otherwise(good)
    failure = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("timed out after "), F.col("o_custkey").cast("string")))
    replies = o.where("o_orderkey % 11 <> 3").select(F.col("o_orderkey").alias("doc_id"), reply.alias("reply"), failure.alias("failure"))
    # Of those that never replied some failed all the same; that is known of the call.
    silent = o.where("o_orderkey % 11 = 3").select(F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("string").alias("reply"), failure.alias("failure"))
    return document.reviewed(decided, replies.unionByName(silent.where("failure IS NOT NULL")))


@register(f"""WITH f AS (SELECT job_id, max(CASE WHEN ends_with(path, '_vlm_checked.md') THEN printf('%05d', mtime) || path END)[6:] AS a, max(CASE WHEN ends_with(path, '_full.md') THEN printf('%05d', mtime) || path END)[6:] AS b,
  max(CASE WHEN ends_with(path, '_ocr_raw.md') THEN printf('%05d', mtime) || path END)[6:] AS c FROM {FILES} f GROUP BY job_id)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN greatest(0.0, CAST(o_orderkey % 50 - 10 AS DOUBLE)) END AS duration_seconds, CASE WHEN o_orderkey % 5 <> 2 THEN o_custkey % 30 END AS page_count,
  CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END AS ocr_avg_score, split_part(coalesce(a, b, c), '/', 3) AS markdown_name, coalesce(a, b, c) IS NOT NULL AS has_markdown
FROM orders LEFT JOIN f ON f.job_id = o_orderkey % 60""")
def m10_history_record(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    started = F.lit(100.0)
    jobs_ = o.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 60).alias("folder"), F.lit("scan.pdf").alias("input_name"), F.lit("succeeded").alias("status"), F.lit(50.0).alias("created_at"), started.alias("started_at"),
        F.when(F.col("o_orderkey") % 3 > 0, started + F.col("o_orderkey") % 50 - 10).alias("finished_at"), F.lit("ok").alias("ai_check_status"), F.lit(None).cast("string").alias("error"),
    )
    pages, score = (F.col("o_custkey") % 30).cast("string"), (F.col("o_custkey") % 100 / 100).cast("string")
    said = F.when(F.col("o_orderkey") % 5 < 2, F.concat(F.lit('{"page_count": '), pages, F.lit(', "ocr_confidence": {"avg_score": '), score, F.lit("}}")))
    said = said.when(F.col("o_orderkey") % 5 > 2, F.concat(F.lit('{"page_count": '), pages, F.lit(', "ocr_confidence": null}')))
    metadata = o.select(F.col("o_orderkey").alias("job_id"), said.alias("metadata"))
    return catalog.history_records(jobs_, relation(spark, sf, "files"), metadata).select(F.col("job_id").alias("id"), "duration_seconds", "page_count", "ocr_avg_score", "markdown_name", "has_markdown")


@register(f"SELECT file_id, CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN concat('out/job', CAST(job_id AS VARCHAR), '/', split_part(path, '/', 3)) END AS at FROM {FILES} f")
def m9_contained(spark, sf):
    """Paths of files, some by way of other folders, some out of their job's own."""
    k, name = F.col("file_id") % 3, F.regexp_extract("path", "([^/]*)$", 1)
    path = F.when(k == 0, F.concat(F.lit("/"), F.col("path"))).when(k == 1, F.concat(F.lit("/out/other/../job"), F.col("job_id"), F.lit("/./"), name)).otherwise(F.concat(F.lit("/out/job"), F.col("job_id"), F.lit("/../"), name))
    at = t.contained(path, F.concat(F.lit("/out/job"), F.col("job_id")))
    return relation(spark, sf, "files").select("file_id", F.regexp_replace(at, "^/", "").alias("at"))


@register("""WITH RECURSIVE w AS (SELECT word || '$' AS w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) d WHERE length(word) >= 2 GROUP BY word),
t AS (SELECT w[i:i + 1] AS context, w[i + 2:i + 2] AS symbol, sum(n) AS score FROM (SELECT w, n, unnest(generate_series(1, length(w) - 2)) AS i FROM w) p GROUP BY context, symbol),
b AS (SELECT context, symbol FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, symbol) AS r FROM t) x WHERE r = 1),
d AS (SELECT p_partkey AS row_id, lower(p_name[1:2]) AS text, 0 AS steps, false AS ended FROM part
UNION ALL SELECT row_id, CASE WHEN coalesce(symbol, '$') = '$' THEN text ELSE text || symbol END, steps + 1, coalesce(symbol, '$') = '$' FROM d LEFT JOIN b ON text[-2:] = context WHERE NOT ended AND steps < 129)
SELECT row_id, text, steps, ended FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY steps DESC) AS r FROM d) x WHERE r = 1""")
def k12_greedy(spark, sf):
    """From the first letters of every part's name, by what follows what in the words of all documents."""
    words = _docs(spark, sf).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= 2).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    starts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.lower(F.substring("p_name", 1, 2)).alias("text"))
    return decode.greedy(starts, decode.transitions(words))
