"""A search that touches few nodes doesn't shuffle the edges."""

from pyspark.sql import functions as F

from weftgraph.operators.shortest import shortest_paths


def written(spark) -> int:
    """Shuffle bytes of all stages of the session so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_edges_are_not_shuffled(spark):
    n = 10**6
    chain = spark.range(n).select("id", F.col("id").alias("src"), (F.col("id") + F.when(F.col("id") % 10 == 9, F.lit(n)).otherwise(1)).alias("dst"))
    before = written(spark)
    found = shortest_paths(chain, spark.range(40, 42), spark.range(n), "out", 20, "pair").collect()
    assert sorted((r.t_start, r.t_end, len(r.t_edges)) for r in found) == sorted((s, e, e - s) for s in (40, 41) for e in range(s + 1, 50))
    # The ends are shuffled (their distinct ids, then once a level); the edges, eight levels of both searches, are not.
    assert written(spark) - before < 150 * 10**6
