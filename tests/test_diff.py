import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from resultfeed.operators.diff import diff_bag, diff_identity, fold, fold_last, init_events, late_join_events, seq_batches

SCHEMA = "id long, name string"


def events(df):
    return [(r.mz_diff, r.id, r.name) for r in df.collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_init_and_late_join(spark):
    df = frame(spark, [(1, "Alice"), (2, "Bob")])
    assert [(r.mz_timestamp, r.mz_diff, r.id) for r in init_events(df, 7).collect()] == [(7, 1, 1), (7, 1, 2)]
    assert {r.mz_timestamp for r in late_join_events(df).collect()} == {0}


@pytest.mark.parametrize(
    "before, after, expected",
    [
        ([(1, "Alice")], [(1, "Alice"), (2, "Bob")], [(1, 2, "Bob")]),
        ([(1, "Alice"), (2, "Bob")], [(1, "Alice")], [(-1, 2, "Bob")]),
        ([(1, "Alice")], [(1, "Alice Updated")], [(-1, 1, "Alice"), (1, 1, "Alice Updated")]),
        ([(1, "Alice")], [(1, "Alice")], []),
    ],
)
def test_identity_cases(spark, before, after, expected):
    assert events(diff_identity(frame(spark, before), frame(spark, after), ["id"])) == expected
    assert sorted(events(diff_bag(frame(spark, before), frame(spark, after)))) == sorted(expected)


def test_bag_with_duplicates_and_nulls(spark):
    old = frame(spark, [(1, "a"), (2, "b"), (2, "b"), (4, None)])
    new = frame(spark, [(1, "a2"), (2, "b"), (3, "c"), (4, None)])
    assert sorted(events(diff_bag(old, new)), key=str) == sorted([(-1, 1, "a"), (-1, 2, "b"), (1, 1, "a2"), (1, 3, "c")], key=str)


def test_larger(spark):
    old = frame(spark, [(i, f"n{i}") for i in range(1000)])
    new = old.withColumn("name", F.when(F.col("id") < 50, "changed").otherwise(F.col("name")))
    assert diff_identity(old, new, ["id"]).count() == 100


def test_missing_identity_falls_back_to_whole_rows(spark):
    assert events(diff_identity(frame(spark, [(1, "a")]), frame(spark, [(1, "b")]), ["nope"])) in ([(-1, 1, "a"), (1, 1, "b")], [(1, 1, "b"), (-1, 1, "a")])


def test_maps_and_variants_compare(spark):
    old = spark.sql("SELECT 1 AS id, map('a', 1, 'b', 2) AS m, parse_json('{\"x\": 1}') AS v")
    same = spark.sql("SELECT 1 AS id, map('b', 2, 'a', 1) AS m, parse_json('{\"x\":1}') AS v")
    new = spark.sql("SELECT 1 AS id, map('a', 1) AS m, parse_json('{\"x\": 1}') AS v")
    assert diff_bag(old, same).count() == 0
    assert diff_identity(old, same, ["id"]).count() == 0
    assert diff_identity(old, new, ["id"]).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_fold_inverts_diff(spark, seed):
    rng = random.Random(seed)
    rows = lambda: [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b"])) for _ in range(30)]
    a, b = rows(), rows()
    for keys in ([], ["id"]):
        old, new = frame(spark, a), frame(spark, b)
        change = diff_identity(old, new, keys) if keys else diff_bag(old, new)
        got = fold(init_events(old, 0).unionByName(change))
        assert Counter(tuple(r) for r in got.collect()) == Counter(b)


def test_fold_last_and_sequence(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "gone"), (2, 3, "y")], "k long, n long, op string")
    assert [r.k for r in fold_last(df, ["k"], "n", F.col("op") == "gone").collect()] == [2]
    got = seq_batches(spark.createDataFrame([("q", 5), ("q", 9), ("q", 9), ("r", 1)], "q string, b long"), "q", "b")
    assert sorted((r.q, r.b, r.seq, r.n_events) for r in got.collect()) == [("q", 5, 1, 1), ("q", 9, 2, 2), ("r", 1, 1, 1)]


def test_any_column_names(spark):
    names = ["_n", "mz_diff", "a.b", "_d", "_copy", "mz_timestamp"]
    old = spark.createDataFrame([(1, 2, "x", 3, 4, 5), (2, 2, "x", 3, 4, 5)], ", ".join(f"c{i} string" if i == 2 else f"c{i} long" for i in range(6))).toDF(*names)
    new = spark.createDataFrame([(1, 7, "y", 3, 4, 5), (2, 2, "x", 3, 4, 5), (2, 2, "x", 3, 4, 5)], ", ".join(f"c{i} string" if i == 2 else f"c{i} long" for i in range(6))).toDF(*names)
    for made, n in ((diff_bag(old, new), 3), (diff_identity(old, new, ["_n"]), 3), (diff_identity(old, new, ["a.b", "mz_diff"]), 3)):
        rows = [tuple(r) for r in made.collect()]
        assert len(rows) == n and sum(r[1] for r in rows) == 1 and (0, 1, 1, 7, "y", 3, 4, 5) in rows
        back = fold(init_events(old, 0).unionByName(made))
        assert back.columns == names and Counter(tuple(r) for r in back.collect()) == Counter(tuple(r) for r in new.collect())
