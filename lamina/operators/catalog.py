"""Queries by dictionary, latest outputs, upserts and job records."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

OPERATORS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<<": lambda c, v: c.isin(list(v)),
    ">>": lambda c, v: c.isNull() if v is None else c == v,
    "%": lambda c, v: c.like(v),
    "**": lambda c, v: c.ilike(v),
    "^": lambda c, v: c.bitwiseXOR(v) != 0,
    "~": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}


def condition(query: dict[str, Any]) -> Column:
    """AND of {field: value or (operator, value)}; an empty query holds for every row."""
    tests = [OPERATORS[v[0]](F.col(k), v[1]) if isinstance(v, tuple) else F.col(k) == v for k, v in query.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def page(df: DataFrame, query: dict[str, Any], order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """The rows of one page, each with ``total``, the number of rows that match; limit and offset count above 0 only.

    A page's rows have their ``place`` on it; without a limit all rows come, in order, and none is numbered.
    """
    first = max(offset, 0)
    out = df.where(condition(query))
    total = out.agg(F.count(F.lit(1)).alias("total"))
    cut = out.orderBy(*order).offset(first) if first else out.orderBy(*order)
    if limit <= 0:
        return cut.crossJoin(F.broadcast(total))  # one row
    n = F.row_number().over(Window.orderBy(*order))  # of ``limit`` rows
    return cut.limit(limit).crossJoin(F.broadcast(total)).withColumn("place", n)  # one row


def history(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Records of each key (an owner's jobs), numbered in order."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def find(df: DataFrame, order_by: str = "create_time", descending: bool | None = None, **fields: Any) -> DataFrame:
    """Rows by equality, by membership (lists, sets) or, for two values of a continuous field, by range.

    Fields without a value are skipped; with no field left the result is empty.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = []
    for name, value in fields.items():
        if value is None or name not in types:
            continue
        c = F.col(name)
        if isinstance(value, list) and len(value) == 2 and isinstance(types[name], NumericType | DateType | TimestampType):
            low, high = value
            if low is not None and high is not None:
                tests.append(c.between(low, high))
            elif low is not None:
                tests.append(c >= low)
            elif high is not None:
                tests.append(c <= high)
        elif isinstance(value, list | set | tuple):
            tests.append(c.isin(list(value)))
        else:
            tests.append(c == value)
    if not tests:
        return df.limit(0)
    out = df.where(reduce(lambda a, b: a & b, tests))
    if descending is None:
        return out
    return out.orderBy(F.col(order_by).desc() if descending else F.col(order_by).asc())


def latest_outputs(files: DataFrame) -> DataFrame:
    """(job_id, markdown, metadata): the newest file of each kind by (mtime, path); checked text before raw."""
    newest = lambda end: F.max_by(F.when(F.col("path").endswith(end), F.col("path")), F.when(F.col("path").endswith(end), F.struct("mtime", "path")))
    return files.groupBy("job_id").agg(
        F.coalesce(newest("_vlm_checked.md"), newest("_full.md"), newest("_ocr_raw.md")).alias("markdown"), newest("_metadata.json").alias("metadata")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("create_time", "create_date")) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key, but for ``keep``; the last of equal keys in ``new`` (by seq) wins."""
    last = new.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).where("n_ = 1").drop("n_")
    kept = [c for c in keep if c in old.columns and c in last.columns]
    before = old.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in kept])
    merged = last.join(before, key, "left").select(*[F.coalesce(f"old_{c}", c).alias(c) if c in kept else F.col(c) for c in old.columns])
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(merged)


def missing_jobs(folders: DataFrame, history: DataFrame) -> DataFrame:
    """Jobs that have a folder but no record; those with text have succeeded."""
    status = F.when(F.col("markdown").isNotNull(), "succeeded").otherwise("failed")
    return latest_outputs(folders).join(history.select("job_id"), "job_id", "left_anti").withColumn("status", status)


def audited(rows: DataFrame, now: Column, fresh: bool = True) -> DataFrame:
    """``rows`` with their audit columns set to ``now`` (milliseconds): update_time and update_date, and for new rows create_time and create_date."""
    moment = F.date_format(F.timestamp_millis(now), "yyyy-MM-dd HH:mm:ss")
    for name in ("create", "update") if fresh else ("update",):
        rows = rows.withColumn(f"{name}_time", now).withColumn(f"{name}_date", moment)
    return rows


def continuous(df: DataFrame) -> list[str]:
    """Fields that take ranges: numbers, dates and times."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType | DateType | TimestampType)]


def ensure_table(df: DataFrame, name: str) -> None:
    """Create the table ``name`` with the columns of ``df`` if it is missing, else add those it lacks."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.limit(0).write.saveAsTable(name)
        return
    known = set(spark.table(name).columns)
    if new := [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in known]:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def job_state(started: Column, finished: Column, exit_code: Column, markdown: Column) -> Column:
    """queued until it starts, running until it ends; succeeded with exit code 0 and a text, else failed."""
    done = (exit_code == 0) & markdown.isNotNull()
    return F.when(started.isNull(), "queued").when(finished.isNull(), "running").when(F.coalesce(done, F.lit(False)), "succeeded").otherwise("failed")


def job_rows(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs as they are shown: times as text, elapsed seconds up to ``now`` while a job runs, names instead of paths, and what is there of them."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    moment = lambda c: F.date_format(F.timestamp_millis((F.col(c) * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ssXX").alias(c)
    elapsed = F.when(F.col("started_at").isNotNull(), F.greatest(F.lit(0.0), F.coalesce("finished_at", now) - F.col("started_at")))
    hidden = ("input_path", "output_dir", "log_path", "markdown_path", "metadata_path", "review_path", "created_at", "started_at", "finished_at")
    return jobs.select(
        *[c for c in jobs.columns if c not in hidden], moment("created_at"), moment("started_at"), moment("finished_at"), elapsed.alias("elapsed_seconds"),
        name("markdown_path").alias("markdown_name"), name("metadata_path").alias("metadata_name"), name("review_path").alias("changes_name"),
        F.col("review_path").isNotNull().alias("changes_available"), F.col("markdown_path").isNotNull().alias("has_markdown"),
    )


def change_sources(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, source, checked): the texts a review names, beside it, or else the newest of their kind."""
    newest = lambda end: F.max_by(F.when(F.col("path").endswith(end), F.col("path")), F.when(F.col("path").endswith(end), F.struct("mtime", "path")))
    found = files.groupBy("job_id").agg(newest("_ocr_raw.md").alias("raw"), newest("_vlm_checked.md").alias("newest"))
    folder = F.regexp_extract("review_path", r"^(.*/)[^/]*$", 1)
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(folder, F.col(c)))
    both = jobs.join(found, "job_id", "left")
    return both.select("job_id", F.coalesce(named("source_name"), "raw").alias("source"), F.coalesce(named("checked_name"), "newest").alias("checked"))


def duration(started: Column, finished: Column) -> Column:
    return F.greatest(F.lit(0.0), finished - started)


def history_records(jobs: DataFrame, files: DataFrame, metadata: DataFrame) -> DataFrame:
    """A history record of each of ``jobs``: its own fields, how long it ran, the newest text's name, and what its metadata (job_id, metadata as JSON) says of pages, regions and confidence.

    Files lie in the job's own folder, or in the one that a column ``folder`` of ``jobs`` names by its job_id: jobs may share one,
    whose newest files are found once and then joined, not its files to every job.
    """
    outputs = latest_outputs(files).select(F.col("job_id").alias("folder"), "markdown")
    placed = jobs if "folder" in jobs.columns else jobs.withColumn("folder", F.col("job_id"))
    found = placed.join(outputs, "folder", "left").join(metadata.select("job_id", "metadata"), "job_id", "left")
    of = lambda field, kind: F.get_json_object("metadata", f"$.{field}").try_cast(kind)
    return found.select(
        "job_id", "input_name", "status", "created_at", "started_at", "finished_at",
        F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), duration(F.col("started_at"), F.col("finished_at"))).alias("duration_seconds"),
        of("page_count", "long").alias("page_count"), of("region_count", "long").alias("region_count"), "ai_check_status", of("ocr_confidence.avg_score", "double").alias("ocr_avg_score"),
        F.nullif(F.regexp_extract("markdown", r"([^/]*)$", 1), F.lit("")).alias("markdown_name"), F.col("markdown").isNotNull().alias("has_markdown"), "error",
    )


def suffix_type(name: Column) -> Column:
    """The data type that an index field's name ending declares."""
    # Name endings and their types.
    table = (
        ("_int", "integer"), ("_ulong", "unsigned_long"), ("_long", "long"), ("_short", "short"), ("_flt|_numeric", "float"),
        ("_tks|_ltks", "text"), ("_kwd|_id|_ids|id", "keyword"), ("_dt|_time|_at", "date"), ("_nst", "nested"), ("_obj", "object"),
        ("_with_weight|_list", "text"), ("_fea", "rank_feature"), ("_feas", "rank_features"), ("_(512|768|1024|1536)_vec", "dense_vector"), ("_bin", "binary"),
    )
    out = F.when(name == "lat_lon", "geo_point")
    for endings, kind in table:
        out = out.when(name.rlike(f"({endings})$"), kind)
    return out.otherwise("text")
