"""Tables that grow with the frames are not broadcast, however few bytes they are made of."""

from sceneloom.plans.align_queries import align_video
from sceneloom.plans.scene_view import SceneView


def _broadcast_rows(plan):
    """Rows of each broadcast of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _broadcast_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in _broadcast_rows(plan.children().apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else [])


def test_aligned_frames_are_not_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # 120 frames stand for millions
    try:
        df = align_video(SceneView(spark, "/root/testdata/sf0.001"))
        assert len(df.collect()) == 120
        sent = _broadcast_rows(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(sent) <= 100  # the confidence lines of the test view
