"""Places in an order and random permutations."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.operators.numbering import numbered, shuffled


def table(spark, n=3_000):
    """One group holds most rows, one is NULL, one is a single row; some keys repeat."""
    rows = [(None if i % 10 == 1 else "rest" if i % 10 == 2 else "most", i * 7919 % n // 2, i) for i in range(n)]
    return spark.createDataFrame([*rows, ("one", 5, n)], "g string, k long, i long").repartition(7)


def test_places_follow_the_order_of_each_group(spark):
    rows = table(spark)
    found = defaultdict(list)
    for r in numbered(rows, ["g"], ["k", "i"], parts=16).collect():
        found[r["g"]].append((r["place"], r["k"], r["i"]))
    assert set(found) == {None, "rest", "most", "one"}
    for group in found.values():
        assert [p for p, *_ in sorted(group)] == list(range(len(group)))
        assert [x for _, *x in sorted(group)] == sorted(x for _, *x in group)


def test_places_of_a_whole_table(spark):
    found = numbered(table(spark), [], ["k", "i"], name="at", parts=5).orderBy("k", "i").collect()
    assert [r["at"] for r in found] == list(range(3_001))


def test_a_group_with_most_rows_is_many_tasks(spark):
    plan = numbered(table(spark), ["g"], ["k", "i"], parts=16)
    per_task = plan.where("g = 'most'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 8


def test_shuffle_is_a_permutation_that_follows_the_seed(spark):
    rows = table(spark)
    first = {r["i"]: r["place"] for r in shuffled(rows, ["k", "i"], 1).collect()}
    again = {r["i"]: r["place"] for r in shuffled(rows.repartition(3), ["k", "i"], 1).collect()}
    other = {r["i"]: r["place"] for r in shuffled(rows, ["k", "i"], 2).collect()}
    assert sorted(first.values()) == list(range(3_001)) == sorted(other.values())
    assert first == again and first != other
    # neighbours are scattered over the whole table
    halves = Counter(first[i] * 2 // 3_001 for i in range(1_000))
    assert min(halves.values()) > 400


def test_ranges_bound_what_a_task_puts_in_order(spark, monkeypatch):
    from windowmatch.operators import numbering

    monkeypatch.setattr(numbering, "RANGE_ROWS", 50)
    assert sorted(r["place"] for r in shuffled(table(spark), ["i"]).collect()) == list(range(3_001))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("k", T.LongType())]))
    assert shuffled(empty, ["k"]).collect() == [] == numbered(empty, [], ["k"]).collect()
