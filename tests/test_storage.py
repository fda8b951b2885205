"""Stored intermediate results."""

from pyspark.sql import functions as F

from lowstress.storage import checkpoint


def test_estimated_size_does_not_grow_with_rounds(spark):
    state = spark.range(1000).select(F.col("id").alias("dart"), F.pmod(F.col("id") + 1, F.lit(1000)).alias("end"))
    for _ in range(6):  # a loop that joins its own state: a kept estimate would be squared each round
        ahead = state.select(F.col("dart").alias("end"), F.col("end").alias("to"))
        state = checkpoint(state.join(ahead, "end").select("dart", F.col("to").alias("end")))
    assert state.where("end = pmod(dart + 64, 1000)").count() == 1000
    assert int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_what_a_step_stores_on_the_way_is_deleted(spark):
    import os

    from lowstress import storage

    seen = []

    def build():
        seen.append(storage.checkpoint(spark.range(10)))
        return seen[0].where("id > 3")

    out = storage.settled(spark, build, "step")
    at = [os.path.dirname(f.removeprefix("file://")) for f in (seen[0].inputFiles()[0], out.inputFiles()[0])]
    assert [os.path.exists(p) for p in at] == [False, True] and out.count() == 6
    assert sum(p.endswith(os.path.basename(at[1])) for p in storage._written[spark.sparkContext.applicationId]) == 1


def test_detectors_of_the_union_leave_only_their_results(spark):
    from lowstress import storage
    from lowstress.plans import catalogue

    storage.sweep(spark)
    assert catalogue.queries()["union_detectors"](spark, "/root/testdata/sf0.001").count() > 0
    kept = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._written[spark.sparkContext.applicationId]]
    assert kept.count("detector") == 6 and kept.count("step") <= 2
