"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source gets a token target: targets share all tokens by weight, and no
target exceeds ``max_repeat`` times its source. Within a source the document
rates that are closest in relative entropy to "take each once" and that meet
the target are exponentially tilted, ``rate = min(max_repeat, exp(lambda * z))``
with ``z`` the document's size over the source's mean size. ``lambda`` solves
the convex dual; all sources are solved at once by distributed Newton steps on
the logarithm of the dual's gradient, kept inside a bisection bracket. Each
step is one aggregation of the (source, size) histogram, summed before the
shuffle; the state, a row a source, rides along in it, and is written every
``STEPS_A_WRITE`` steps. Sums are decimals, so they do not depend on the order
of rows and reruns agree.

Rates become copies by systematic rounding along documents sorted by size, so
that copies of every prefix differ from the sum of its rates by at most one
half. Equal rows are one entry with their number; large sources are dealt into
strata by hash, so no window holds a source or a group of equal rows.

Defined results: a null source is a source of its own, last in order; null and
empty texts have size 0 and take 0, as has every text where no source has a
word; repeated rows are documents of their own, and differ by at most one copy;
ties in size are taken in order of a hash of the row; texts of any length count
whole; an empty table gives an empty result. ``mix`` ignores columns other than
doc_id, text and source; ``take`` passes the named ones through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import BROADCAST_ROWS, drop, join_small, materialize, with_row_key, word_count

#: Documents in one rounding stratum, on average at most.
STRATUM = 4096
#: Offsets of the systematic rounding; each source takes the one that lands nearest its target.
OFFSETS = tuple((2 * i + 1) / 32 for i in range(16))
MAX_STEPS = 32
STEPS_A_WRITE = 4
TOLERANCE = 1e-7
#: Copies of one row that a task writes in a row.
CHUNK = 1024
DECIMAL = "decimal(38,9)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, docs) -> the same with sid, weight, target.

    Weights repeat along sources in code-point order, null last. The water
    level is exact: sources sorted by cap over weight are full up to the first
    one whose cap lies above the level of the rest. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sid = F.row_number().over(by_name).cast("long")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("full_at", "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sizes.withColumn("sid", sid)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * float(max_repeat))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))))
        .select("source", "sid", "source_size", "docs", "weight", "target", "cap")
    )


def _rate(lam: Column, z: Column, max_repeat: int) -> Column:
    return F.least(F.lit(float(max_repeat)), F.exp(F.least(lam * z, F.lit(50.0))))


def _newton(hist: DataFrame, state: DataFrame, few: bool, max_repeat: int) -> DataFrame:
    """One step of every source: the new state. ``few``: the sources were counted and their state may be broadcast."""
    z = F.col("size") / F.col("mean")
    r = _rate(F.col("lam"), z, max_repeat)
    mass = F.col("size") * F.col("n")
    total = lambda x: F.sum(x.cast(DECIMAL)).cast("double")
    kept = ("target", "mean", "lam", "lo", "hi", "done")
    stepped = (
        hist.join(F.broadcast(state) if few else state, "sid")
        .groupBy("sid")
        .agg(*[F.max(c).alias(c) for c in kept], total(mass * r).alias("g"), total(F.when(r < max_repeat, mass * r * z).otherwise(0.0)).alias("dg"))
    )
    over = F.col("g") > F.col("target")
    step = F.col("lam") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("dg")
    done = F.col("done") | (F.abs(F.col("g") / F.col("target") - 1) < TOLERANCE)
    return (
        stepped.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        .withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam")))
        .withColumn("done", done)
        .withColumn(
            "lam",
            F.when(F.col("done"), F.col("lam"))
            .when((F.col("dg") > 0) & (F.col("g") > 0) & (step > F.col("lo")) & (step < F.col("hi")), F.round(step, 12))
            .otherwise((F.col("lo") + F.col("hi")) / 2),
        )
        .select("sid", *kept)
    )


def tilt(hist: DataFrame, targets: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Solve the dual: one row per source with ``lam`` and ``mean``.

    ``hist`` holds (sid, size, n) with sizes above 0, ``targets`` is materialized.
    """
    reach = 4096.0
    few = targets.count() <= BROADCAST_ROWS
    full = F.col("target") >= F.col("cap") * (1 - 1e-12)
    state = targets.where("source_size > 0").select(
        "sid",
        "target",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        F.when(full, reach).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(-reach).alias("lo"),
        F.lit(reach).alias("hi"),
        full.alias("done"),
    )
    written = None
    for _ in range(MAX_STEPS // STEPS_A_WRITE):
        for _ in range(STEPS_A_WRITE):
            state = _newton(hist, state, few, max_repeat)
        before, written = written, materialize(state, "mix-state")
        if before is not None:
            drop(before)
        state = written
        open_ = state.where("NOT done").select("sid", "target").take(1)
        if not open_:
            break
    else:
        raise RuntimeError(f"the rates of source {open_[0]['sid']} miss its target {open_[0]['target']} after {MAX_STEPS} steps")
    return state.select("sid", "lam", "mean")


def _planned(docs: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Entries of ``docs`` (doc_id, source, size, k1, k2): each with its number of equal rows (m), rate, and copies of all of them."""
    base = materialize(docs.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count(F.lit(1)).alias("m")), "mix-base")
    hist = base.groupBy("source", "size").agg(F.sum("m").alias("n"))
    sized = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"),
    )
    targets = materialize(source_targets(sized, weights, max_repeat), "mix-targets")
    known = targets.select(F.col("source").alias("s"), "sid", "source_size", "docs", "target")
    hist = materialize(join_small(hist.where("size > 0"), known, {"source": "s"}).select("sid", "size", "n"), "mix-hist")
    lam = tilt(hist, targets, max_repeat)
    known = materialize(known.join(lam, "sid", "left"), "mix-known")
    full = join_small(base, known, {"source": "s"})
    rate = F.when(F.col("size") == 0, 0.0).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), max_repeat))
    strata = F.greatest(F.ceil(F.col("docs") / F.lit(STRATUM)), F.lit(1))
    order = Window.partitionBy("sid", "stratum").orderBy(F.col("size").desc(), "k1", "k2", F.col("doc_id").asc_nulls_last())
    upto = F.sum(F.col("rate") * F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rated = materialize(
        full.withColumn("rate", rate)
        .withColumn("stratum", F.pmod(F.col("k1"), strata))
        .withColumn("upto", upto)
        .withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
        .select("doc_id", "k1", "k2", "m", "sid", "size", "source_size", "target", "rate", "upto", "before"),
        "mix-rated",
    )
    drop(base, hist)
    copies = lambda u: F.when(F.col("size") == 0, 0).otherwise(F.least(max_repeat * F.col("m"), F.floor(F.col("upto") + u) - F.floor(F.col("before") + u)))
    tried = rated.groupBy("sid").agg(
        F.first("target").alias("wanted"), *[F.sum(F.col("size") * copies(F.lit(u))).alias(f"t{i}") for i, u in enumerate(OFFSETS)]
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("wanted")), F.lit(u).alias("u")) for i, u in enumerate(OFFSETS)]))["u"]
    offsets = materialize(tried.select(F.col("sid").alias("s"), best.alias("offset")), "mix-offsets")
    return join_small(rated, offsets, {"sid": "s"}).withColumn("copies", copies(F.col("offset")).cast("long"))


def each(df: DataFrame, n: str, number: str, keys: tuple[str, ...]) -> DataFrame:
    """Every row of ``df`` as often as its column ``n`` says, numbered from 0; of many, stretches of ``CHUNK`` are dealt to other tasks."""
    long = lambda x: x.cast("long")
    few = df.where(F.col(n).between(1, CHUNK)).withColumn(number, F.explode(F.sequence(long(F.lit(0)), long(F.col(n)) - 1)))
    at = F.col("chunk__") * CHUNK
    many = df.where(F.col(n) > CHUNK).withColumn("chunk__", F.explode(F.sequence(long(F.lit(0)), long((F.col(n) - 1) / CHUNK))))
    many = many.repartition(*keys, "chunk__").withColumn(number, F.explode(F.sequence(at, F.least(long(F.col(n)), at + CHUNK) - 1)))
    return few.unionByName(many.drop("chunk__"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate."""
    cells = [x for c in ("doc_id", "text", "source") for x in (F.col(c), F.col(c).isNull())]
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*cells).alias("k1"), F.xxhash64(F.lit("row"), *cells).alias("k2"))
    rows = each(_planned(keyed, weights, max_repeat), "m", "nth", ("k1", "k2"))
    # Of m equal rows with c copies together, each has c div m, and the first c mod m have one more.
    own = F.expr("CAST(copies DIV m + IF(nth < copies % m, 1, 0) AS INT)")
    return rows.withColumn("copies", own).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "rate"
    )


def take(docs: DataFrame, columns: tuple[str, ...], weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The ``columns`` of every document, once per copy taken.

    Copies belong to whole rows: rows that differ in any of the columns, in text
    or in source are taken apart, whatever their doc_id.
    """
    keyed = with_row_key(docs.select(*dict.fromkeys((*columns, "text", "source"))))
    sized = keyed.select(F.lit(None).cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), "k1", "k2")
    taken = materialize(_planned(sized, weights, max_repeat).where("copies > 0").select("k1", "k2", "m", "copies"), "mix-taken")
    found = keyed.join(taken, ["k1", "k2"])
    once = found.where("m = 1").unionByName(found.where("m > 1").dropDuplicates(["k1", "k2"]))
    return each(once, "copies", "nth__", ("k1", "k2")).select(*columns)
