"""The grid join against all pairs: poles, the date line, crowded cells, no coordinates."""

import math
import random

import pytest

from metricspark.checks.enriching import near_places
from metricspark.functions.geo import EARTH_RADIUS_KM, near


def km(a, b):
    (la, lo), (lb, ob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2
    h += math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, h)))


def spread(n, seed):
    r = random.Random(seed)
    out = [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(n)]
    edges = [(90.0, 0.0), (-90.0, 12.0), (89.99, -180.0), (89.99, 0.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.999), (0.0, 0.0), (-45.0, -179.99), (60.0, 179.9)]
    return out + edges


@pytest.mark.parametrize("radius", [0, 0.5, 40, 900, 5000, 12000, 25000])
def test_against_all_pairs(spark, radius):
    points, places = spread(150, 1), spread(60, 2) + spread(10, 1)
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "p long, lat double, lon double")
    others = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, None, None)], "q long, place_lat double, place_lon double")
    got = sorted((r.p, r.q) for r in near(frame.repartition(3), others, radius, cell_points=5).collect())
    want = {(i, j): km(a, b) for i, a in enumerate(points) for j, b in enumerate(places)}
    # pairs on the edge of the circle may fall to either side
    assert len(got) == len(set(got))
    assert {x for x, d in want.items() if d <= radius - 1e-6} <= set(got) <= {x for x, d in want.items() if d <= radius + 1e-6}


def test_no_pairs_are_made_beyond_the_cells(spark):
    frame = spark.createDataFrame([(1, 1.0, 1.0)], "p long, lat double, lon double")
    others = spark.createDataFrame([(1, 1.0, 1.0)], "q long, place_lat double, place_lon double")
    text = near(frame, others, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert [c for c in near(frame, others, 10).columns] == ["p", "lat", "lon", "q", "place_lat", "place_lon", "km"]


def test_one_crowded_place(spark):
    frame = spark.range(3000).selectExpr("id as p", "48.85D as lat", "2.35D as lon").repartition(4)
    others = spark.createDataFrame([(i, 48.85 + i / 1000, 2.35) for i in range(4)], "q long, place_lat double, place_lon double")
    assert near(frame, others, 1, cell_points=100).count() == 3000 * 4


def test_a_radius_below_zero(spark):
    with pytest.raises(ValueError):
        near(spark.range(1).selectExpr("1D as lat", "1D as lon"), spark.range(1).selectExpr("1D as place_lat", "1D as place_lon"), -1)


def test_pairs_of_events_and_suppliers_without_a_set_of_users(spark, tmp_path):
    users, suppliers = [0, 0, 0, 5, 5, 1499, None, 300], [1, 2, 2, 40, 41, 77, None, *range(100, 200)]
    spark.createDataFrame([(u,) for u in users], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(s,) for s in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = near_places(spark, str(tmp_path))
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = lambda u: ((u * 37 % 17900) / 100 - 89, (u * 91 % 35900) / 100 - 179)
    of = lambda s: ((s * 53 % 17900) / 100 - 89, (s * 131 % 35900) / 100 - 179)
    want = {}
    for s in suppliers:
        for u in users:
            if s is not None and u is not None and (d := km(at(u), of(s))) <= 700:
                n, who, least = want.get(s, (0, set(), d))
                want[s] = (n + 1, who | {u}, min(least, d))
    assert 2 in want and want[2][0] > len(want[2][1])
    assert {r.s_suppkey: (r.n, r.users, r.nearest) for r in found.collect()} == {s: (n, len(who), round(d, 3)) for s, (n, who, d) in want.items()}
