"""Correction rules: learned from diffs, replayed on new text, blocked and unblocked."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import rule_id, shortened, stripped
from lamina.storage import materialize

MAX_CHARS, MAX_LINES, MIN_SIMILARITY, SNIPPET = 240, 4, 0.72, 1800
#: Documents whose hunks a task holds at once.
DOCS_AT_ONCE = 256
#: Text that stands for structure or assets, never corrected (fixed values).
MARKERS = ("![", "<table", "</table", "assets/")


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Line hunks by longest matching blocks, adjacent ones of a kind as one."""
    if a == b:
        return [("equal", 0, len(a), 0, len(b))] if a else []
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def hunks(docs: DataFrame, source: str = "source_text", checked: str = "checked_text") -> DataFrame:
    """(doc_id, hunk, change_id, kind, source_line, checked_line, original, output): all line hunks of two texts; equal ones have change_id null."""

    names = ["doc_id", "hunk", "change_id", "kind", "source_line", "checked_line", "original", "output"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                rows = []
                for doc_id, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    a, b = (a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True)
                    change = 0
                    for i, (kind, a0, a1, b0, b1) in enumerate(opcodes(a, b)):
                        rows.append((doc_id, i, None if kind == "equal" else change, kind, a0 + 1, b0 + 1, "".join(a[a0:a1]), "".join(b[b0:b1])))
                        change += kind != "equal"
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, hunk int, change_id long, kind string, source_line int, checked_line int, original string, output string"
    return docs.select("doc_id", source, checked).mapInArrow(run, schema)


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by longest matching blocks."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)


def candidate_reason(wrong: Column, correct: Column, alike: Column, least: float = MIN_SIMILARITY) -> Column:
    """Why a pair is no candidate; empty if it is one. The first reason wins."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | wrong.contains(m) | correct.contains(m)
    return (
        F.when((wrong == "") | (correct == ""), "empty")
        .when(wrong == correct, "same")
        .when((F.length(wrong) > MAX_CHARS) | (F.length(correct) > MAX_CHARS), "too_long")
        .when((lines(wrong) >= MAX_LINES) | (lines(correct) >= MAX_LINES), "too_many_lines")
        .when(marked, "structured_or_asset")
        .when(alike < least, "low_similarity")
        .otherwise("")
    )


def candidates(changes: DataFrame, issues: DataFrame | None = None, least: float = MIN_SIMILARITY) -> DataFrame:
    """Changes as (doc_id, change_id, id, wrong, correct, kind, similarity, reason), with the issue of the same number."""
    pairs = changes.where("change_id IS NOT NULL").withColumn("wrong", stripped(F.col("original"))).withColumn("correct", stripped(F.col("output")))
    plain = candidate_reason(F.col("wrong"), F.col("correct"), F.lit(1.0))
    pairs = pairs.withColumn("similarity", F.when(plain == "", similarity(F.col("wrong"), F.col("correct"))))
    out = pairs.select(
        "doc_id", "change_id", rule_id(F.col("wrong"), F.col("correct")).alias("id"), "wrong", "correct", "kind",
        F.round("similarity", 4).alias("similarity"), "source_line", "checked_line",
        candidate_reason(F.col("wrong"), F.col("correct"), F.coalesce("similarity", F.lit(1.0)), least).alias("reason"),
    )
    return out if issues is None else out.join(issues, ["doc_id", "change_id"], "left")


def not_blocked(rules: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Rules that are blocked neither themselves nor by their (wrong, correct) pair."""
    left = rules.where(~F.coalesce(F.col("blocked"), F.lit(False)))
    return left if blocked is None else left.join(blocked.select("wrong", "correct").distinct(), ["wrong", "correct"], "left_anti")


#: Rules, about, that a task holds at once.
RULES_A_PASS = 100_000


class Fold:
    """Rules in order, and an automaton of all their texts that finds which of them a text holds in one reading."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        import ahocorasick

        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for i, (_, wrong, _) in enumerate(rules):
            self.automaton.add_word(wrong, (*self.automaton.get(wrong, ()), i))
        if rules:
            self.automaton.make_automaton()

    def next(self, text: str, after: int) -> int | None:
        """The first rule beyond ``after`` that the text holds as it is now."""
        return min((i for _, found in self.automaton.iter(text) for i in found if i > after), default=None)

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[str, int]]]:
        applied: list[tuple[str, int]] = []
        at = self.next(text, -1) if text and self.rules else None
        while at is not None:
            name, wrong, correct = self.rules[at]
            applied.append((name, text.count(wrong)))
            text = text.replace(wrong, correct)
            at = self.next(text, at)
        return text, applied


def replay(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``corrected`` and ``applied`` (array of (id, n)), rules in order of length, longest first.

    A text is read once for all rules and once more after each that it holds, so what a
    text costs does not grow with the rules that it does not hold; a rule sees
    what earlier ones changed, and no rule comes twice. Rules are sorted by ranges and
    sent ``RULES_A_PASS`` at a time, the texts being read once a pass. A rule without
    a correction deletes; null texts stay null, with nothing applied.
    """
    usable = rules.where((F.coalesce("wrong", F.lit("")) != "") & (F.col("wrong") != F.col("correct")))
    if "blocked" in rules.columns:
        usable = usable.where(~F.coalesce("blocked", F.lit(False)))
    order = [F.length("wrong").desc(), F.col("seq"), F.col("id")]
    n = usable.count()
    ranges = usable.repartitionByRange(-(-n // RULES_A_PASS), *order).withColumn("pass", F.spark_partition_id()) if n > RULES_A_PASS else usable.withColumn("pass", F.lit(0))
    if n > RULES_A_PASS:
        ranges = materialize(ranges, "rules")
    passes = sorted(r["pass"] for r in ranges.select("pass").distinct().collect())  # a row a pass
    out = texts.withColumn("corrected", F.col(text)).withColumn("applied", F.array().cast("array<struct<id:string,n:int>>"))
    for i in passes:
        listed = ranges.where(F.col("pass") == i).orderBy(*order).select("id", "wrong", "correct").collect()  # RULES_A_PASS rows, about
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in listed])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            fold = Fold(shared.value)
            for b in batches:
                done = [fold.apply(t) for t in b.column("corrected").to_pylist()]
                more = [[*had, *({"id": x, "n": k} for x, k in new)] for had, (_, new) in zip(b.column("applied").to_pylist(), done, strict=True)]
                columns = {**dict(zip(b.schema.names, b.columns, strict=True)), "corrected": pa.array([t for t, _ in done], pa.string()), "applied": pa.array(more, pa.list_(pa.struct([("id", pa.string()), ("n", pa.int32())])))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(run, out.schema)
    return out


def count_applied(rules: DataFrame, replayed: DataFrame) -> DataFrame:
    """``rules`` with their counters raised by what was applied to ``replayed``."""
    used = replayed.select(F.explode("applied").alias("a")).groupBy(F.col("a.id").alias("id")).agg(F.sum("a.n").alias("n"))
    return rules.join(used, "id", "left").withColumn("applied_count", F.coalesce("applied_count", F.lit(0)) + F.coalesce("n", F.lit(0))).drop("n")


def rule_order(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rules of each key (a user's memory) with their ``place``: the longest first, equal ones as they came."""
    return rules.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.length("wrong").desc(), "seq")))


def learn(rules: DataFrame, found: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """The rules after the candidates of ``found``, in order of its column ``at``.

    A known rule is seen once more per candidate, and each of the candidate's
    fields that is not null replaces the rule's; a new rule starts from its first
    candidate in the same way, not applied yet and not blocked. Candidates of
    blocked pairs, listed or by their rule, teach nothing.
    """
    own = ("wrong", "correct", *[c for c in found.columns if c not in ("id", "at", "wrong", "correct")])
    fresh = found if blocked is None else found.join(blocked.select("wrong", "correct").distinct(), ["wrong", "correct"], "left_anti")
    if "blocked" in rules.columns:
        fresh = fresh.join(rules.where("blocked").select("id"), "id", "left_anti")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}")
    fresh = fresh.groupBy("id").agg(*[last(c) for c in own], F.count(F.lit(1)).alias("n"))
    both = rules.join(fresh, "id", "full_outer")
    zero = F.lit(0).cast("long")
    merged = [F.coalesce(f"new_{c}", c).alias(c) if c in rules.columns else F.col(f"new_{c}").alias(c) for c in own]
    kept = [F.coalesce(c, F.lit(False)).alias(c) if c == "blocked" else F.col(c) for c in rules.columns if c not in ("id", "seen_count", "applied_count", *own)]
    return both.select(
        "id", *merged, *kept, (F.coalesce("seen_count", zero) + F.coalesce("n", zero)).alias("seen_count"), F.coalesce("applied_count", zero).alias("applied_count")
    )


def set_blocked(rules: DataFrame, commands: DataFrame) -> DataFrame:
    """Rules after the last (id, blocked, at) command of each."""
    last = commands.groupBy("id").agg(F.max_by("blocked", "at").alias("b"))
    return rules.join(last, "id", "left").withColumn("blocked", F.coalesce("b", "blocked")).drop("b")


def blocked_pairs(blocked: DataFrame, commands: DataFrame) -> DataFrame:
    """(wrong, correct, at) pairs that are blocked after ``commands`` (wrong, correct, blocked, at): the last command of a pair replaces its entry."""
    valid = commands.where((F.coalesce("wrong", F.lit("")) != "") & (F.coalesce("correct", F.lit("")) != "") & (F.col("wrong") != F.col("correct")))
    last = valid.groupBy("wrong", "correct").agg(F.max_by("blocked", "at").alias("b"), F.max("at").alias("at"))
    kept = blocked.select("wrong", "correct", "at").join(last.select("wrong", "correct"), ["wrong", "correct"], "left_anti")
    return kept.unionByName(last.where("b").select("wrong", "correct", "at"))


def change_texts(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, change_id, wrong, correct) of the changes named in ``wanted`` (doc_id, change_id), white space at the ends dropped."""
    found = changes.where("change_id IS NOT NULL").join(wanted.select("doc_id", "change_id").distinct(), ["doc_id", "change_id"], "left_semi")
    return found.select("doc_id", "change_id", stripped(F.col("original")).alias("wrong"), stripped(F.col("output")).alias("correct"))


def reverse_changes(changes: DataFrame, ids: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, markdown, block commands) after ``commands`` (doc_id, change_id, on, at): the reversed sets, the texts they make, and what they block or free."""
    last = commands.groupBy("doc_id", "change_id").agg(F.max_by("on", "at").alias("on"), F.max("at").alias("at"))
    kept = ids.select("doc_id", "change_id").join(last, ["doc_id", "change_id"], "left_anti")
    now = kept.unionByName(last.where("on").select("doc_id", "change_id"))
    blocks = change_texts(changes, last).join(last, ["doc_id", "change_id"]).select("wrong", "correct", F.col("on").alias("blocked"), "at")
    return now, effective(changes, now), blocks


def change_rows(changes: DataFrame, reversed_ids: DataFrame) -> DataFrame:
    """Numbered changes with their texts cut short and whether they are reversed."""
    marker = "\n... [truncated]"
    flagged = changes.where("change_id IS NOT NULL").join(reversed_ids.withColumn("reversed", F.lit(True)), ["doc_id", "change_id"], "left")
    return flagged.select(
        "doc_id", "change_id", "kind", "source_line", "checked_line",
        shortened(F.col("original"), SNIPPET, marker).alias("original"), shortened(F.col("output"), SNIPPET, marker).alias("ai_output"),
        ((F.length("original") > SNIPPET) | (F.length("output") > SNIPPET)).alias("truncated"), F.coalesce("reversed", F.lit(False)).alias("reversed"),
    )


def effective(changes: DataFrame, reversed_ids: DataFrame) -> DataFrame:
    """(doc_id, markdown): the checked text, with reversed changes as in the source."""
    flagged = changes.join(reversed_ids.withColumn("reversed", F.lit(True)), ["doc_id", "change_id"], "left")
    text = F.when(F.col("reversed"), F.col("original")).otherwise(F.col("output"))
    items = F.array_sort(F.collect_list(F.struct("hunk", text.alias("out"))))
    return flagged.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda s: s["out"]), "").alias("markdown"))


def reversal_ids(payload: Column) -> Column:
    """The non-negative whole numbers of a JSON list, sorted."""
    items = F.from_json(payload, "array<string>")
    numbers = F.transform(F.filter(items, lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.coalesce(numbers, F.array().cast("array<long>"))))


def toggle(ids: Column, change: Column, on: Column) -> Column:
    return F.array_sort(F.when(on, F.array_union(ids, F.array(change))).otherwise(F.array_except(ids, F.array(change))))


def numbered(risks: DataFrame) -> DataFrame:
    """Risks with their identifier, numbered in order of emission within the page."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    return risks.withColumn("risk_id", F.format_string("p%03d_r%03d", F.col("page_id"), n))
