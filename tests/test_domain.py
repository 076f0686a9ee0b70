import operator
import random
from functools import reduce

from terrane.operators import objects
from terrane.plans import domain


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """Twentieths of doubles, summed as they come, differ in their last digit from one order to another."""
    values = [(k * 7 % 11) * 0.2 for k in range(201)]
    found, sums = set(), set()
    for seed in range(20):
        random.Random(seed).shuffle(values)
        sums.add(reduce(operator.add, values) / len(values))
        rows = spark.createDataFrame([(v,) for v in values], "z double").coalesce(1)
        found.add(rows.agg(domain.exact_mean("z")).first()[0])
    assert len(sums) > 1
    assert len(found) == 1


def test_below_many_alike(spark):
    """Copies of a box are one candidate, named by the least id, and all of them get an answer."""
    low = [(k, 0.5, 0.0, 2.0, 0.0, 2.0) for k in range(10, 40)]
    high = [(k, 1.0, 1.0, 3.0, 1.0, 3.0) for k in range(100, 130)]
    rows = spark.createDataFrame(low + high + [(1, 0.25, 1.0, 2.0, 1.0, 2.0)], "object_id long, z double, x0 double, x1 double, y0 double, y1 double")
    found = {(r["upper"], r["lower"]) for r in objects.below(rows, 5.0, 0.4, 1.5).collect()}
    assert found == {(k, 10) for k in range(100, 130)}
