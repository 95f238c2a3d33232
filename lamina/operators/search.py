"""Term and vector similarity as the index configuration states them, with exact pruning.

Term scores. A term index holds documents in blocks of ``BLOCK`` along their rank
feature, largest first; a block is one row with its largest feature and its postings,
so a task has all that a document's score needs and no posting is shuffled.
A query's terms are ordered by weight. A document whose first matching term is the
i-th can score no more than the sum of the weights from the i-th on, plus its
feature's share; so once a threshold is known, common terms are looked up for other
terms' documents only, and blocks whose largest feature is too small are left out.
The threshold comes from documents of the query's rarest terms, scored in full, and
rises with the k-th best that a task has met. Only documents whose bound reaches it
are scored.

Vector scores. A vector index holds unit vectors in clusters with a centre, each
with its angle to it. Angles on the sphere obey the triangle inequality: a vector
whose angle to the centre differs from the query's by more than the threshold
cannot be nearer than the threshold. The threshold is the k-th best angle in the
query's nearest clusters; clusters, then rows, beyond it are not compared.

Both return what comparing everything returns: bounds carry a slack of ``SLACK``
against rounding, and ties are settled by id among all that reach the threshold.

Defined results: null and empty texts have no tokens and match nothing; a query
without a known token has no rows; a missing or negative rank feature counts 0;
repeated doc_ids are documents of their own; vectors that are null, of length 0 or
hold null or non-finite values take no part; an empty index gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.storage import materialize

BLOCK = 128
#: Tokens of a block at most, one document aside.
TOKENS_A_BLOCK = 1 << 18
#: Rare terms of a query hold so many postings together, times k, at most; the rarest always counts.
SEEDS = 8
#: Terms of queries that are broadcast together, about.
TERMS_A_PASS = 100_000
SLACK = 1e-8


def tokens(text: Column, hash_too: bool = False) -> Column:
    """Lower-cased tokens, split at white space, or also at #."""
    return F.filter(F.split(F.lower(text), r"[\s#]+" if hash_too else r"\s+"), lambda t: t != "")


def saturation(feature: Column, pivot: float) -> Column:
    """A rank feature's share between 0 and 1: one half at the pivot."""
    value = F.greatest(F.coalesce(feature.cast("double"), F.lit(0.0)), F.lit(0.0))
    return value / (value + pivot)


class TermIndex:
    """Blocks of documents: each a row with its documents, its largest share and its postings."""

    def __init__(self, docs: DataFrame, feature: Column | None = None, block: int = BLOCK):
        """Index ``docs`` (doc_id, text); ``feature`` is a column of each document's share of the score, 0 or more."""
        share = F.lit(0.0) if feature is None else F.nanvl(F.coalesce(feature, F.lit(0.0)), F.lit(0.0))
        rows = docs.select("doc_id", "text", share.alias("share"))
        if feature is not None:
            rows = rows.repartitionByRange(F.col("share").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("share").desc())
        found = F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array().cast("array<string>"))
        rows = rows.select(F.monotonically_increasing_id().alias("place"), "doc_id", "share", found.alias("tokens"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ends = np.asarray(b.column("tokens").offsets)
                ends, coded = ends - ends[0], b.column("tokens").flatten().dictionary_encode()
                code, low = coded.indices.to_numpy(), 0
                while low < b.num_rows:
                    high = min(low + block, max(low + 1, int(np.searchsorted(ends, ends[low] + TOKENS_A_BLOCK, "right")) - 1), b.num_rows)
                    held = code[ends[low] : ends[high]]
                    order = np.argsort(held, kind="stable")
                    at = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(ends[low : high + 1]))[order]
                    token, first = np.unique(held[order], return_index=True)
                    listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at))
                    postings = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(token)), listed], names=["token", "at"])
                    part = b.slice(low, high - low)
                    documents = pa.StructArray.from_arrays([part.column(c) for c in ("place", "doc_id", "share")], names=["place", "doc_id", "share"])
                    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    most = part.column("share").to_numpy().max()
                    yield pa.RecordBatch.from_arrays([part.column("place").slice(0, 1), pa.array([most]), whole(documents), whole(postings)], names=["block", "most", "docs", "postings"])
                    low = high

        kind = dict(docs.dtypes)["doc_id"]
        schema = f"block long, most double, docs array<struct<place: long, doc_id: {kind}, share: double>>, postings array<struct<token: string, at: array<int>>>"
        # A block is known by its first place, and a document by its place: they hold from here on.
        self.blocks = materialize(rows.mapInArrow(cut, schema), "terms-blocks")
        self.docs = self.blocks.select(F.inline("docs"))
        size = self.blocks.agg(F.sum(F.size("docs")).alias("n"), F.max("most").alias("top")).first()
        self.n, self.top = size["n"] or 0, size["top"] or 0.0

    @property
    def postings(self) -> DataFrame:
        """(token, block, most, found): the documents (place, share) of a block that hold the token."""
        return self._listed().select("token", "block", "most", F.transform("at", lambda a: F.struct((F.col("block") + a).alias("place"), F.get("docs", a)["share"].alias("share"))).alias("found"))

    def _listed(self) -> DataFrame:
        rows = self.blocks.select("block", "most", "docs", F.explode("postings").alias("p"))
        return rows.select("block", "most", "docs", F.col("p.token").alias("token"), F.col("p.at").alias("at"))

    def terms(self, queries: DataFrame, boost: float = 1.0) -> DataFrame:
        """(query_id, token, df, w, i, rest, before): a query's known tokens, heaviest first; ``rest`` sums w from there on, ``before`` counts the postings ahead.

        The tokens asked for are broadcast: ``queries`` are those of one pass.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token")).distinct()
        df = self._listed().join(F.broadcast(asked.select("token").distinct()), "token").groupBy("token").agg(F.sum(F.size("at")).alias("df"))
        # As the index counts it: documents that hold the field at all are all documents here.
        n = F.lit(float(self.n))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (n - 0.5) / 1.5)
        along = Window.partitionBy("query_id").orderBy(F.col("w").desc(), "token")
        weighed = asked.join(df, "token").withColumn("w", boost * idf)
        return weighed.withColumns({
            "i": F.row_number().over(along),
            "rest": F.sum("w").over(along.rowsBetween(0, Window.unboundedFollowing)),
            "before": F.coalesce(F.sum("df").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        })

    def _reached(self, asked: _Asked, least: np.ndarray, k: int, first: bool) -> DataFrame:
        """(query_id, place, score): in each task, what reaches a query's ``least`` and the task's k-th best; with ``first`` only k scores a query and task, of documents with a rare term."""
        spark = self.blocks.sparkSession
        shared = spark.sparkContext.broadcast((asked, least))  # TERMS_A_PASS terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, least = shared.value
            least, best = least.copy(), np.full((len(least), k), -np.inf)
            heaviest = np.array([rest[0] for _, _, rest, _ in asked.queries])
            row_of = np.full(len(asked.tokens), -1)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def given() -> pa.RecordBatch:
                q, place, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                keep = score >= least[q]
                return pa.RecordBatch.from_arrays([asked.names.take(pa.array(q[keep])), pa.array(place[keep]), pa.array(score[keep])], names=["query_id", "place", "score"])

            for part in _by_block(batches):
                block, most, number, lists = part["block"][0].as_py(), part["most"][0].as_py(), part["number"].to_numpy(), part["at"].combine_chunks()
                at = lists.flatten().to_numpy()
                holds, share = np.zeros((len(number), at.max() + 1)), np.zeros(at.max() + 1)
                holds[np.repeat(np.arange(len(number)), lists.value_lengths().to_numpy()), at] = 1
                share[at] = part["share"].combine_chunks().flatten().to_numpy()
                row_of[number] = np.arange(len(number))
                for q in np.flatnonzero(heaviest + most >= least).tolist():
                    numbers, w, _, rare = asked.queries[q]
                    rows = row_of[numbers]
                    known = np.flatnonzero(rows >= 0)
                    # Documents that first meet a later term cannot reach the threshold: these terms, of all that the block holds, only add to others.
                    rest = np.cumsum(w[known][::-1])[::-1]
                    met = np.searchsorted(known, rare) if first else np.searchsorted(-rest, most - least[q] + SLACK, "right")
                    early, late = known[:met], known[met:]
                    if not len(early):
                        continue
                    some = holds[rows[early]]
                    bound = w[early] @ some + share + w[late].sum()
                    left = np.flatnonzero(some.any(0) & (bound + SLACK >= least[q]))
                    if not len(left):
                        continue
                    score = (w[known, None] * holds[np.ix_(rows[known], left)]).sum(0) + share[left]
                    keep = np.flatnonzero(score >= least[q])
                    if not len(keep):
                        continue
                    best[q] = np.partition(np.concatenate([best[q], score[keep]]), -k)[-k:]
                    least[q] = max(least[q], best[q].min() - SLACK)
                    if not first:
                        out.append((np.full(len(keep), q), block + left[keep], score[keep]))
                row_of[number] = -1
                if sum(len(x[0]) for x in out) >= PAIRS_AT_ONCE:
                    yield given()
                    out.clear()
            if first:
                q, i = np.nonzero(best > -np.inf)
                out.append((q, np.full(len(q), -1), best[q, i]))
            yield given()

        # A token's row is read where a query that asks for it can reach its threshold at all.
        need = np.full(len(asked.tokens), np.inf)
        for (numbers, _, rest, _), limit in zip(asked.queries, least, strict=True):
            need[numbers] = np.minimum(need[numbers], limit - rest[0] - SLACK)
        wanted = spark.createDataFrame(pa.table({"token": asked.tokens.cast(pa.string()), "number": pa.array(np.arange(len(need))), "need": pa.array(need)}))
        read = self._listed().where(F.col("most") >= float(need.min(initial=np.inf))).join(F.broadcast(wanted), "token").where(F.col("most") >= F.col("need"))
        read = read.select("block", "most", "number", "at", F.transform("at", lambda a: F.get("docs", a)["share"]).alias("share"))
        return read.mapInArrow(run, f"query_id {asked.kind}, place long, score double")

    def candidates(self, terms: DataFrame, k: int) -> DataFrame:
        """(query_id, place, score): documents scored in full that reach the threshold, among them the k best of every query; ``terms`` are those of one pass."""
        asked = _Asked(terms, k)
        # Every task's k best of the rarest terms: the k-th of them all is the threshold.
        ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        seeds = self._reached(asked, np.full(len(asked.queries), -np.inf), k, True).withColumn("r", F.row_number().over(ranked))
        kth = {r["query_id"]: r["score"] for r in seeds.where(F.col("r") == k).select("query_id", "score").collect()}  # a number a query
        least = np.array([kth.get(x, -np.inf) - SLACK for x in asked.names.to_pylist()])
        return materialize(self._reached(asked, least, k, False), "terms-candidates")

    def best(self, queries: DataFrame, k: int = 10, boost: float = 1.0) -> DataFrame:
        """(query_id, doc_id, score, place): the k best of every query (query_id, query) by whole billionths of the score, then by doc_id.

        Queries are taken ``TERMS_A_PASS`` tokens at a time, about.
        """
        n = queries.agg(F.sum(F.size(F.coalesce(F.array_distinct(tokens(F.col("query"))), F.array().cast("array<string>"))))).first()[0] or 0
        passes, full = max(1, -(-n // TERMS_A_PASS)), None
        for i in range(passes):
            some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            found = self.candidates(self.terms(some, boost), k)
            full = found if full is None else full.unionAll(found)
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
        ranked = full.join(self.docs.select("place", "doc_id"), "place").withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "score", F.col("rank").alias("place"))


class _Asked:
    """The terms of one pass on the driver: for each query the numbers, weights and rests of its terms, and how many of them are rare."""

    def __init__(self, terms: DataFrame, k: int):
        self.kind = dict(terms.dtypes)["query_id"]
        held = terms.select("query_id", "token", "w", "i", "rest", (F.col("before") + F.col("df")).alias("until")).toArrow().combine_chunks()  # TERMS_A_PASS rows, about
        whole = lambda c: pa.concat_arrays(held.column(c).chunks) if held.column(c).num_chunks else pa.array([], held.schema.field(c).type)
        asked, said = whole("query_id").dictionary_encode(), whole("token").dictionary_encode()
        self.names, self.tokens = asked.dictionary, said.dictionary
        of, i = asked.indices.to_numpy(), held.column("i").to_numpy()
        order = np.lexsort((i, of))
        ends = np.searchsorted(of[order], np.arange(len(self.names) + 1))
        number, w, rest = said.indices.to_numpy()[order], held.column("w").to_numpy()[order], held.column("rest").to_numpy()[order]
        rare = ((i == 1) | (held.column("until").to_numpy() <= SEEDS * k))[order]
        self.queries = [(number[a:b], w[a:b], rest[a:b], int(rare[a:b].sum())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another; a block's rows come from one row of the index, so they follow each other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("block")[0].as_py() != block[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


#: Query vectors that are broadcast together, and centres of an index at most.
QUERIES_A_PASS = 1_000
CENTRES = 1_024
#: Rows compared with all centres at once, and found pairs that a task holds before it gives them out.
ROWS_AT_ONCE = 1_024
PAIRS_AT_ONCE = 100_000


def _unit(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold a proper vector, these as rows of length one)."""
    rows = column.to_pylist()
    ok = np.array([r is not None and len(r) > 0 and None not in r for r in rows], bool)
    width = max((len(r) for r, good in zip(rows, ok.tolist(), strict=True) if good), default=1)
    ok &= np.array([r is not None and len(r) == width for r in rows], bool)
    m = np.array([r for r, good in zip(rows, ok.tolist(), strict=True) if good], np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        m = m / np.abs(m).max(1, initial=0, keepdims=True)
        m = m / np.sqrt((m * m).sum(1, keepdims=True))
    fine = np.isfinite(m).all(1)
    ok[np.flatnonzero(ok)[~fine]] = False
    return ok, m[fine]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the unit rows of ``a`` and of ``b``."""
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class VectorIndex:
    """Unit vectors in clusters around sampled centres, each with its angle to the centre."""

    def __init__(self, vectors: DataFrame, centres: int | None = None):
        """Index ``vectors`` (vec_id, embedding). Centres are a sample by hash of the id, about the root of their number, ``CENTRES`` at most; every vector is indexed."""
        spark = vectors.sparkSession
        n = vectors.count()
        wanted = min(CENTRES, max(1, int(n**0.5))) if centres is None else centres
        share = min(1.0, 2 * wanted / max(n, 1))
        sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("centre")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
        sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").toArrow()  # CENTRES rows at most
        self.centres = _unit(sample.column("embedding"))[1]
        shared = spark.sparkContext.broadcast(self.centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok, unit = _unit(b.column("embedding"))
                if len(unit) and len(shared.value):
                    nearest, angle = np.empty(len(unit), np.int64), np.empty(len(unit))
                    for at in range(0, len(unit), ROWS_AT_ONCE):
                        angles = _angles(unit[at : at + ROWS_AT_ONCE], shared.value)
                        nearest[at : at + ROWS_AT_ONCE], angle[at : at + ROWS_AT_ONCE] = angles.argmin(1), angles.min(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nearest), b.column("vec_id").filter(pa.array(ok)), pa.array(list(unit), pa.list_(pa.float64())), pa.array(angle)],
                        names=["cluster", "vec_id", "unit", "angle"],
                    )

        kind = dict(vectors.dtypes)["vec_id"]
        placed = vectors.select("vec_id", "embedding").mapInArrow(place, f"cluster long, vec_id {kind}, unit array<double>, angle double")
        self.rows = materialize(placed, "vectors-rows")
        # A row a cluster: how many it holds, and how far they reach.
        self.clusters = {r["cluster"]: (r["n"], r["radius"]) for r in self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}

    def _compare(self, ids: list, units: np.ndarray, limits: np.ndarray, k: int) -> DataFrame:
        """(query_id, vec_id, score, compared, place): the k nearest of every query among rows within its limits by cluster; a first row of each task and query counts what was compared."""
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast((units, _angles(units, self.centres), limits))  # QUERIES_A_PASS queries

        def pairs(b: pa.RecordBatch, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            q, near, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(q), b.column("vec_id").take(pa.array(near)), pa.array(score), pa.array(np.zeros(len(q), np.int64))], names=["q", "vec_id", "score", "compared"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit_q, to_centre, limit = shared.value
            count, kth = np.zeros(len(unit_q), np.int64), np.full(len(unit_q), -np.inf)
            for b in batches:
                cluster, angle = b.column("cluster").to_numpy(), b.column("angle").to_numpy()
                unit = np.array(b.column("unit").flatten()).reshape(b.num_rows, -1)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                held = 0
                for q in range(len(unit_q)):
                    within = limit[q, cluster]
                    near = np.flatnonzero((within >= 0) & (np.abs(to_centre[q, cluster] - angle) <= within + SLACK))
                    if not len(near):
                        continue
                    count[q] += len(near)
                    score = unit[near] @ unit_q[q]
                    # Of each query the k best of this batch and all that tie with the k-th, or with that of a batch before.
                    if len(near) >= k:
                        kth[q] = max(kth[q], np.partition(score, -k)[-k])
                    keep = score >= kth[q] - SLACK
                    out.append((np.full(keep.sum(), q), near[keep], score[keep]))
                    held += len(out[-1][0])
                    if held >= PAIRS_AT_ONCE:
                        yield pairs(b, out)
                        out, held = [], 0
                if held:
                    yield pairs(b, out)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), kind_), pa.nulls(len(some), pa.float64()), pa.array(count[some])], names=["q", "vec_id", "score", "compared"])

        kind = dict(self.rows.dtypes)["vec_id"]
        kind_ = self.rows.select("vec_id").limit(0).toArrow().schema.field("vec_id").type
        found = materialize(self.rows.mapInArrow(run, f"q long, vec_id {kind}, score double, compared long"), "vectors-found")
        best = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "vec_id")
        total = found.groupBy("q").agg(F.sum("compared").alias("compared"))
        kept = found.where("score IS NOT NULL").drop("compared").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"q long, query_id {self._id_type}")
        return kept.join(total, "q").join(F.broadcast(names), "q").select("query_id", "vec_id", "score", "compared", "place")  # QUERIES_A_PASS rows

    def nearest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, vec_id, score, place, compared): the k vectors of largest cosine to each of ``queries`` (query_id, q), by whole billionths, then by vec_id.

        ``compared`` is how many vectors were compared with the query at the last.
        Queries are taken ``QUERIES_A_PASS`` at a time.
        """
        self._id_type = dict(queries.dtypes)["query_id"]
        n = queries.count()
        passes, out = max(1, -(-n // QUERIES_A_PASS)), None
        for i in range(passes):
            some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            asked = some.select("query_id", "q").toArrow()  # QUERIES_A_PASS rows, about
            ok, units = _unit(asked.column("q"))
            ids = [x for x, good in zip(asked.column("query_id").to_pylist(), ok.tolist(), strict=True) if good]
            found = self._pass(ids, units, k)
            out = found if out is None else out.unionAll(found)
        return out

    def _pass(self, ids: list, units: np.ndarray, k: int) -> DataFrame:
        if not len(ids) or not len(self.centres) or units.shape[1] != self.centres.shape[1]:
            return self._none()
        reach = np.array([self.clusters.get(c, (0, -1.0)) for c in range(len(self.centres))])
        to_centre = _angles(units, self.centres)
        # First the nearest clusters that hold k vectors together: their k-th best angle is the threshold.
        first = np.full(to_centre.shape, -1.0)
        for q, row in enumerate(np.argsort(to_centre, 1)):
            first[q, row[: int(np.searchsorted(np.cumsum(reach[row, 0]), k)) + 1]] = 7.0
        kth = {r["query_id"]: r["score"] for r in self._compare(ids, units, first, k).where(F.col("place") == k).select("query_id", "score").collect()}  # a number a query
        # Cosines that round alike may lie apart by SLACK, and arc cosines are good to the root of a double's precision.
        angle = np.array([np.arccos(np.clip(kth[x] - SLACK, -1, 1)) + 1e-7 if x in kth else 7.0 for x in ids])
        within = np.maximum(to_centre - reach[:, 1], 0) <= angle[:, None] + SLACK
        return self._compare(ids, units, np.where(within & (reach[:, 0] > 0), angle[:, None], -1.0), k)

    def _none(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["vec_id"]
        return self.rows.sparkSession.createDataFrame([], f"query_id {self._id_type}, vec_id {kind}, score double, compared long, place int")


def any_date(text: Column) -> Column:
    """The first of the three configured date formats that fits."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd_HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
