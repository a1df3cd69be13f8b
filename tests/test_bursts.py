import random

from skein.operators import temporal


def test_a_count_equal_to_the_threshold_is_no_burst(spark):
    # Mean plus two deviations is the highest count itself in each of these, whatever the order of windows and rows.
    rng, rows = random.Random(3), []
    for shape in ([1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4], [1, 2, 2, 2, 2, 2, 3, 3, 3, 4], [1, 1, 1, 1, 3]):
        assert (max(shape) * len(shape) - sum(shape)) ** 2 == 4 * (len(shape) * sum(n * n for n in shape) - sum(shape) ** 2)
        for k in range(400):
            some = rng.sample(shape, len(shape))
            rows += [(f"{len(shape)}-{k}", 86_400_000_000 * w, 0) for w, n in enumerate(some) for _ in range(n)]
    times = spark.createDataFrame(rows, "entity string, us long, _first long")
    for n in (1, 7):
        assert temporal.over_threshold(times.repartition(n)).count() == 0


def test_a_count_over_the_threshold_is_a_burst(spark):
    times = spark.createDataFrame([("a", 86_400_000_000 * w, 0) for w, n in enumerate([1, 1, 1, 1, 1, 4]) for _ in range(n)] + [("b", 5, 0), ("b", 6, 0), ("b", 7, 0)], "entity string, us long, _first long")
    assert [(r["entity"], r["win"], r["observed"], r["mean"], r["std"], r["threshold"]) for r in temporal.over_threshold(times).collect()] == [("a", 5, 4, 1.5, 1.12, 3.74)]
