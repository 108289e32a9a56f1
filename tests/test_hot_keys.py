"""Scans in two levels against one window, on keys that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 2, None, rng.randrange(9)]), rng.randrange(40), rng.choice([None, rng.random()]), rng.choice([True, False, None, False])) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    yield spark.createDataFrame(rows, "id long, user int, at int, value double, flag boolean")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows", [3000, 0, 1])
def test_two_levels_equal_one_window(events, rows):
    some, keys, order = events.limit(rows), ["user"], ["at", "id"]
    for scan in (
        lambda n: ordered.sibling_ordinal(some, keys, order, hot_rows=n),
        lambda n: ordered.running_max_before(some, keys, order, "value", hot_rows=n),
        lambda n: ordered.islands(some, keys, order, F.col("flag"), hot_rows=n),
        lambda n: ordered.flag_from(some, keys, order, F.col("flag"), hot_rows=n),
    ):
        assert rows_of(scan(0)) == rows_of(scan(1 << 40))


def test_a_hot_key_is_spread(events):
    assert ordered.hottest(events, ["user"]) > 1400
    sizes = [r["count"] for r in ordered.in_ranges(events, ["user"], ["at", "id"]).groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_rows_of_two_tables_side_by_side(spark, events):
    left = events.where("value IS NOT NULL").select("id", "value")
    right = left.select((-F.col("id")).alias("other"))
    both = ordered.zipped(left, right, ["value", "id"], ["other"]).collect()
    by_value, by_other = left.orderBy("value", "id").collect(), right.orderBy("other").collect()
    assert sorted((r.position, r.id, r.other) for r in both) == [(i + 1, a.id, b.other) for i, (a, b) in enumerate(zip(by_value, by_other, strict=True))]
    with pytest.raises(ValueError, match="beside"):
        ordered.zipped(left, right.limit(5), ["value", "id"], ["other"])
    assert ordered.zipped(left.limit(0), right.limit(0), ["value"], ["other"]).collect() == []


def test_the_longest_name_at_the_start(spark):
    from quarry.operators import lookup

    names = spark.createDataFrame([("CDC", "urn:cdc"), ("Código Civil", "urn:cc"), ("código", "urn:c"), ("CC", "urn:b"), ("cc", "urn:a"), ("", "urn:none"), (None, "urn:null")], "name string, urn string")
    texts = spark.createDataFrame([(1, "CODIGO CIVIL, art. 206"), (2, "Código de obras"), (3, "cc"), (4, "cdcx art. 1"), (5, ""), (6, None), (3, "cc")], "id int, text string")
    got = sorted((r.id, r.found, " ".join(r.rest), r.reason) for r in lookup.named_at_start(texts, names).collect())
    assert got == [(1, "urn:cc", "art 206", None), (2, "urn:c", "de obras", None), (3, "urn:a", "", None), (3, "urn:a", "", None), (4, None, "cdcx art 1", "no known name"), (5, None, "", "empty"), (6, None, "", "empty")]
    assert {r.reason for r in lookup.named_at_start(texts, names.limit(0)).collect()} == {"no known name", "empty"}
