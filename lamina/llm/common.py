"""Helpers shared by the training-data operators.

Nothing here touches a machine-local folder on a cluster: intermediate tables go
to ``spark.checkpoint.dir``. They are Parquet, so a lost executor never costs
more than the work since the last one. Operators drop those that nothing reads
any more; the rest go with ``scratch`` blocks, or at the end of the process.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many (narrow) rows, counted first; beyond, both sides are shuffled, the large one salted.
BROADCAST_ROWS = 200_000
SALTS = 64

_OWN_DIR: dict[str, str] = {}
#: Paths and catalog tables written and not dropped yet.
_MADE: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One of this machine's only in local mode, and where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="lamina-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str, table: str = "") -> str:
    """A path for an intermediate table, dropped with the others; ``table`` is its name in the catalog, if it has one."""
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path, table))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def _remove(entry: tuple[SparkSession, str, str]) -> None:
    spark, path, table = entry
    with suppress(Exception):  # what is gone already, or a store that is closing, needs no care
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    paths = {getattr(t, "_lamina_path", None) for t in tables}
    for entry in [e for e in _MADE if e[1] in paths]:
        _MADE.remove(entry)
        _remove(entry)


@contextmanager
def scratch() -> Iterator[None]:
    """Drop the intermediate tables made inside when the block ends; results must be written by then."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for entry in _MADE[mark:]:
            _remove(entry)
        del _MADE[mark:]


def written(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What ``make`` returns, materialized; the intermediate tables it made are dropped."""
    path = new_path(spark, name)
    with scratch():
        df = make()
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


@atexit.register
def _drop_all() -> None:
    for entry in _MADE:
        if entry[0].sparkContext._jsc is not None:
            _remove(entry)
    _MADE.clear()


def join_small(large: DataFrame, small: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """``large`` with the columns of the materialized ``small`` (key columns left out), nulls equal to nulls.

    ``keys`` are {column of large: column of small}. ``small`` is counted: up to
    ``BROADCAST_ROWS`` rows it is broadcast. Beyond that ``large`` is salted and
    ``small`` repeated for every salt, so that no key's rows meet in one task.
    """
    on = F.lit(True)
    small = small.select(*[F.col(c).alias(f"{c}__k") if c in keys.values() else F.col(c) for c in small.columns])
    for a, b in keys.items():
        on = on & F.col(a).eqNullSafe(F.col(f"{b}__k"))
    if small.count() <= BROADCAST_ROWS:
        out = large.join(F.broadcast(small), on, how)
    else:
        salted = large.withColumn("salt__a", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        repeated = small.withColumn("salt__b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(repeated, on & (F.col("salt__a") == F.col("salt__b")), how).drop("salt__a", "salt__b")
    return out.drop(*[f"{b}__k" for b in keys.values()])


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, two hashes of the whole row: rows with both alike are taken as equal."""
    row = [x for c in sorted(docs.columns) for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumns({"k1": F.xxhash64(*row), "k2": F.xxhash64(F.lit("row"), *row)})


def survivors(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each label in ``labels`` (doc_id, k1, k2, label) the row with the smallest doc_id, nulls last, then by row key; without the key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("row")
    keep = materialize(labels.groupBy("label").agg(first).select("row.k1", "row.k2"), "survivors")
    return keyed.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).drop("k1", "k2")


def lean(f: Callable) -> Callable:
    """``f``, a function of Arrow tables that tasks run, which afterwards gives back what Arrow held: else a worker keeps what its largest group took."""

    def run(*tables):
        import pyarrow as pa

        out = f(*tables)
        del tables
        pa.default_memory_pool().release_unused()
        return out

    # Spark tells the kinds of function by the number of parameters.
    if f.__code__.co_argcount == 1:
        return lambda a: run(a)
    return lambda a, b: run(a, b)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """The words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
