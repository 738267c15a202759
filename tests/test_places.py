import random

from pyspark.sql import functions as F

from loopscope.plans.places import numbered


def test_places_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 30), i, rng.choice(["a", None])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, id long, place string").repartition(13)
    got = {r["id"]: r["rank"] for r in numbered(df, F.desc("k"), F.col("id"), name="rank").collect()}
    assert got == {r[1]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert numbered(df.limit(0), F.col("id")).collect() == [] and numbered(df.limit(0), F.col("id"), name="rank").columns == [*df.columns, "rank"]
