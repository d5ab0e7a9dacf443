from datetime import datetime

from lodestone.operators.snapshots import snapshot_changes

from .conftest import rows

NODES = "repo_id bigint, revision_id bigint, id string, kind string, flag boolean, where struct<a:string,b:string>, spots array<int>, loaded_at timestamp"


def t(n):
    return datetime(2031, 1, 1, 0, 0, n)


def changes(spark, nodes, revisions, schema=NODES):
    df = spark.createDataFrame(nodes, schema)
    revs = spark.createDataFrame(revisions, "repo_id bigint, revision_id bigint, instant bigint")
    return snapshot_changes(df, revs, series=["repo_id"], snapshot="revision_id", key=["id"], version="loaded_at", instant="instant")


def test_added_removed_changed(spark):
    nodes = [
        (1, 10, "a", "F", None, ("x", None), [1], t(1)),
        (1, 10, "b", "F", True, None, None, t(1)),
        (1, 10, "same", "F", None, None, [], t(1)),
        # a later snapshot with a smaller number
        (1, 9, "a", "F", None, (None, "x"), [1], t(2)),  # the text moved to another field of the struct
        (1, 9, "c", "F", None, None, None, t(2)),
        (1, 9, "same", "F", None, None, [], t(2)),
    ]
    got = rows(changes(spark, nodes, [(1, 10, 5), (1, 9, 7), (1, 9, 7), (1, 8, 6)]).select("revision_id", "id", "change", "changed_fields"))
    assert got == [(9, "a", "changed", ["where"]), (9, "b", "removed", []), (9, "c", "added", [])]


def test_newest_row_stands_and_copies_do_not_matter(spark):
    old, new = (1, 1, "a", "F", None, None, None, t(1)), (1, 1, "a", "G", None, None, None, t(5))
    later = (1, 2, "a", "G", None, None, None, t(2))
    assert rows(changes(spark, [old, new, new, later], [(1, 1, 1), (1, 2, 2)])) == []


def test_nulls_arrays_and_gaps(spark):
    nodes = [
        (1, 1, None, "F", None, None, [1, None], t(1)),
        (1, 2, None, "F", None, None, [None, 1], t(1)),
        (1, 1, "gone", "F", None, None, None, t(1)),
        (1, 3, "gone", "F", None, None, None, t(1)),
        (2, 1, "first", "F", None, None, None, t(1)),
        (None, 1, "x", "F", None, None, None, t(1)),
    ]
    got = rows(changes(spark, nodes, [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)]).select("repo_id", "revision_id", "id", "change", "changed_fields"))
    assert got == [(1, 2, "gone", "removed", []), (1, 2, None, "changed", ["spots"]), (1, 3, "gone", "added", []), (1, 3, None, "removed", [])]


def test_empty_and_clashing_names(spark):
    assert rows(changes(spark, [], [])) == []
    schema = "repo_id bigint, revision_id bigint, id string, change string, instant bigint, loaded_at timestamp"
    nodes = [(1, 1, "a", "p", 1, t(1)), (1, 2, "a", "q", 2, t(1))]
    df = spark.createDataFrame(nodes, schema)
    revs = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "repo_id bigint, revision_id bigint, instant bigint")
    got = snapshot_changes(df, revs, series=["repo_id"], snapshot="revision_id", key=["id"], version="loaded_at", instant="instant")
    assert rows(got) == [(1, 2, "a", "changed", ["change", "instant"])]


def test_salted_join_gives_the_same(spark, monkeypatch):
    from lodestone.plans import staging

    nodes = [(1, r, f"n{i}", "F" if i % 3 else str(r), None, None, None, t(1)) for r in (1, 2) for i in range(r, 20)]
    one = rows(changes(spark, nodes, [(1, 1, 1), (1, 2, 2)]))
    monkeypatch.setattr(staging, "fits_broadcast", lambda *a, **k: False)
    assert rows(changes(spark, nodes, [(1, 1, 1), (1, 2, 2)])) == one
    assert len(one) == 7
