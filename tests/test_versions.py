"""The delta log: what a reader sees after batches, failures, merges and sweeps."""

import random
from pathlib import Path

import pytest

from quirework.sources import versions as V

ROWS = "document_id string, content string"


def change(spark, rows=None, removed=None):
    return V.Change(
        None if rows is None else spark.createDataFrame(rows, ROWS),
        None if removed is None else spark.createDataFrame([(d,) for d in removed], "document_id string"),
    )


def held(spark, root, generation=None, table="t"):
    return sorted(tuple(r) for r in V.read(spark, root, table, ROWS, generation=generation).collect())


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == [] and V.state(spark, root)["generation"] == 0
    assert V.publish(spark, root, {"t": change(spark, [("a", "1"), ("b", "1")])}) == 1
    assert V.publish(spark, root, {"t": change(spark, [("a", "2")], ["a", "x"]), "other": change(spark, [("o", "")])}) == 2
    assert V.publish(spark, root, {"t": change(spark, removed=["b"])}) == 3
    assert [held(spark, root, g) for g in (1, 2, 3, None)] == [
        [("a", "1"), ("b", "1")], [("a", "2"), ("b", "1")], [("a", "2")], [("a", "2")],
    ]
    assert held(spark, root, 1, "other") == [] and held(spark, root, None, "other") == [("o", "")]


def test_a_batch_that_is_done_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    V.publish(spark, root, {"t": change(spark, [("a", "1")])}, "s", 0)
    assert V.publish(spark, root, {"t": change(spark, [("a", "again")])}, "s", 0) == 1
    assert V.publish(spark, root, {"t": change(spark, [("b", "1")])}, "u", 0) == 2  # another source's batch
    assert (V.done(spark, root, "s"), V.done(spark, root, "u"), V.done(spark, root, "v")) == (0, 0, -1)
    assert held(spark, root) == [("a", "1"), ("b", "1")]


def test_a_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    V.publish(spark, root, {"t": change(spark, [("a", "1")])})
    with monkeypatch.context() as patch:
        patch.setattr(V, "_publish_state", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            V.publish(spark, root, {"t": change(spark, [("b", "1")], ["a"])})
    assert held(spark, root) == [("a", "1")]
    assert V.publish(spark, root, {"t": change(spark, [("c", "1")])}) == 2
    assert held(spark, root) == [("a", "1"), ("c", "1")]
    assert len(V.sweep(spark, root, keep=1)) == 3  # the lost rows and removals, and the first log file
    assert held(spark, root) == [("a", "1"), ("c", "1")]


def test_two_writers_cannot_both_win(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    before = V.state(spark, root)
    V.publish(spark, root, {"t": change(spark, [("a", "1")])})
    monkeypatch.setattr(V, "state", lambda *_: before)  # the second one looked before the first was done
    with pytest.raises(V.TakenError):
        V.publish(spark, root, {"t": change(spark, [("b", "1")])})
    monkeypatch.undo()
    assert held(spark, root) == [("a", "1")]


def test_merges_keep_what_readers_see(spark, tmp_path):
    """Random batches against a dictionary, merged at random points."""
    rng, root, want = random.Random(3), str(tmp_path), {}
    for n in range(9):
        rows = [(rng.choice("abcdef"), str(n)) for _ in range(rng.randint(0, 4))]
        gone = {d for d, _ in rows} | set(rng.sample("abcdef", rng.randint(0, 2)))
        for d in gone:
            want[d] = sorted(r for r in rows if r[0] == d)
        V.publish(spark, root, {"t": change(spark, rows, sorted(gone))})
        if rng.random() < 0.6:
            V.compact(spark, root, "t", ROWS, most=rng.choice([1, 2]), ratio=rng.choice([0.5, 4]))
        assert held(spark, root) == sorted(r for rows in want.values() for r in rows)
    V.compact(spark, root, "t", ROWS, most=1)
    deltas = V.state(spark, root)["tables"]["t"]
    assert len(deltas) == 1 and deltas[0]["removed"] is None
    V.sweep(spark, root)
    assert held(spark, root) == sorted(r for rows in want.values() for r in rows)


def test_which_deltas_merge():
    assert V.due([5, 5, 5], 4, 3) is None
    assert V.due([1000, 5, 5, 5], 4, 3) == 1  # a large one stays apart
    assert V.due([20, 5, 5, 5], 4, 3) == 0
    assert V.due([1000, 900, 800, 700, 5], 0.5, 3) == 2  # at most three are left after the merge


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    root = str(tmp_path)
    size = lambda: sum(p.stat().st_size for p in Path(root, "data").rglob("*.parquet"))
    rng = random.Random(1)
    many = [(f"d{i}", "".join(rng.choices("abcdefghijklmnop", k=200))) for i in range(5000)]
    V.publish(spark, root, {"t": change(spark, many)})
    first = size()
    V.publish(spark, root, {"t": change(spark, many[:100], [d for d, _ in many[:100]])})
    assert size() - first < first / 20
    assert V.read(spark, root, "t", ROWS).count() == 5000
