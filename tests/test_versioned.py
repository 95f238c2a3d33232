"""The versioned table: upserts against a dictionary, what they rewrite, writers at the same time, commits that fail."""

import threading

import pytest

from lamina.sources import versioned
from lamina.sources.versioned import Conflict, VersionedTable

SCHEMA = "id long, v string, create_time long"


def rows(spark, pairs, schema="id long, v string, create_time long"):
    return spark.createDataFrame(list(pairs), schema)


def held(table, version=None):
    return {r["id"]: (r["v"], r["create_time"]) for r in table.read(version).collect()}


def test_upserts_as_a_dictionary(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, 50)
    wanted = {i: (f"a{i}", i) for i in range(0, 600, 2)}
    assert table.read().count() == 0 and table.upsert(rows(spark, [])) == 0
    assert table.upsert(rows(spark, [(i, *x) for i, x in wanted.items()])) == 1
    first = dict(wanted)
    for step, keys in enumerate([range(100, 110), [-5, 3, 1000], range(0, 600, 3), [7]]):
        assert table.upsert(rows(spark, [(i, f"b{step}", 9) for i in keys]), keep=("create_time",)) == step + 2
        wanted |= {i: (f"b{step}", wanted[i][1] if i in wanted else 9) for i in keys}
        assert held(table) == wanted
    files = table.files()
    assert all(a["high"] < b["low"] for a, b in zip(files, files[1:], strict=False)) and max(f["rows"] for f in files) <= 50
    assert held(table, 1) == first and sum(f["rows"] for f in files) == len(wanted)
    assert table.vacuum(5) > 0 and held(table) == wanted


def test_the_last_of_equal_keys_wins_and_columns_may_lack(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA)
    table.upsert(spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2)], "id long, v string, seq int"))
    assert held(table) == {1: ("z", None)}
    with pytest.raises(ValueError, match="unknown"):
        table.upsert(spark.createDataFrame([(1, 2)], "id long, other int"))
    with pytest.raises(ValueError, match="null"):
        table.upsert(rows(spark, [(None, "a", 1)]))


def test_an_upsert_rewrites_what_it_hits(spark, tmp_path):
    """One key in a hundred, side by side: a bounded share of the files and rows."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, 100)
    table.upsert(rows(spark, [(i, "a", 0) for i in range(4000)]))
    before = {f["path"]: f["rows"] for f in table.files()}
    table.upsert(rows(spark, [(i, "b", 1) for i in range(2000, 2040)]))
    after = {f["path"] for f in table.files()}
    assert sum(n for p, n in before.items() if p not in after) <= 0.06 * 4000
    assert sum(v == "b" for v, _ in held(table).values()) == 40


@pytest.mark.parametrize("apart", [True, False])
def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, apart):
    """On files of their own, or all on the same ones."""
    path = f"file://{tmp_path}/t"
    VersionedTable(spark, path, "id", SCHEMA, 100).upsert(rows(spark, [(i, "a", 0) for i in range(1000)]))
    failed = []

    def write(w):
        try:
            for j in range(3):
                key = w * 300 + j if apart else w + 10 * j
                VersionedTable(spark, path, "id", SCHEMA, 100).upsert(rows(spark, [(key, f"w{w}", j)]))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    table = VersionedTable(spark, path, "id", SCHEMA, 100)
    assert table.versions() == list(range(1, 11))
    now = held(table)
    assert all(now[w * 300 + j if apart else w + 10 * j] == (f"w{w}", j) for w in range(3) for j in range(3)) and len(now) == 1000


def test_a_commit_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "TRIES", 2)
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA)
    table.upsert(rows(spark, [(1, "a", 0)]))
    with pytest.raises(Conflict):
        table._create(1, [], [])
    monkeypatch.setattr(VersionedTable, "_create", lambda *a: (_ for _ in ()).throw(Conflict(2)))
    with pytest.raises(RuntimeError, match="tries"):
        table.upsert(rows(spark, [(1, "b", 0)]))
    assert held(table) == {1: ("a", 0)} and table.versions() == [1]
