"""The whole listing of blocks in every order, against sorting in Python."""

import random

from granary import queries
from granary.plans import maintenance


def test_every_block_has_its_place(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(5), r.randrange(1000), r.choice([None, 0.0, 0.5, r.random()]), 7, 1000 * k) for k in range(1000)]
    used = spark.createDataFrame(rows, "block_id long, size long, live_bytes long, utilisation double, ref_count long, create_time long")
    got = {(x.sorted_by, x.direction, x.block_id): x.place for x in maintenance.block_places(used).collect()}
    assert len(got) == 12 * len(rows)
    for at, column in enumerate(used.columns):
        for direction, sign in (("up", 1), ("down", -1)):
            order = sorted(rows, key=lambda x: (x[at] is not None, sign * (x[at] or 0), x[0]))
            assert [got[column, direction, x[0]] for x in order] == list(range(len(rows)))
    assert maintenance.block_places(used.where("false")).count() == 0


def test_query_places_more_than_a_page(spark):
    blocks = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").count()
    assert blocks > 200
    assert queries.QUERIES["block_sort_places"](spark, "/root/testdata/sf0.1").count() == 12 * blocks


def test_references_are_read_once(spark, sf):
    for name in ("block_sort_places", "block_sort_orders"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan
    used = queries.QUERIES["block_utilization"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert used.count("lineitem.parquet") == 1
