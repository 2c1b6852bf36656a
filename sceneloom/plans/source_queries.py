"""Sources and sinks: derived tables written out and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneloom.operators import evaluate as E
from sceneloom.operators import scene as Sc
from sceneloom.plans.evaluation_queries import _COLS, _LETTERS, _SCORED
from sceneloom.plans.registry import query
from sceneloom.plans.track_queries import _SINGLE, _STEPS, _TRACKS, single_run_scene
from sceneloom.schema import FRAME
from sceneloom.session import ensure_checkpoint_dir
from sceneloom.sources import readers as R


def _folder(v, name: str) -> str:
    return f"{ensure_checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("read_frames", "select video_id, source_idx, case when fps > 0 then source_idx / fps else 0e0 end as ts from manifest")
def read_frames(v):
    out = _folder(v, "manifest")
    v.manifest.withColumn("path", F.concat_ws("/", F.col("video_id").cast("string"), F.col("source_idx").cast("string"))).write.parquet(out)
    return R.read_frames(v.spark, out).select("video_id", "source_idx", "ts")


@query("read_depth_rows", """select video_id, frame_idx, v, (5e0 + v / 64e0 * 5e-1) as first, 64 as size
    from frames, (select unnest(range(64)) as v) where video_id % 2 = 0 and frame_idx < 20""")
def read_depth_rows(v):
    """One folder per video; only the asked videos and the depth column are read."""
    out = _folder(v, "depth")
    R.write_depth_rows(v.depth_rows, out)
    d = R.read_depth_rows(v.spark, out, ("depth",)).filter("video_id % 2 = 0 and frame_idx < 20")
    return d.select(*FRAME, "v", F.col("depth")[0].cast("double").alias("first"), F.size("depth").alias("size"))


def _arrays(v, rows, name: str, per: int = 200):
    """Rows as JSON array files: one array of ``per`` rows per line, a folder of text files."""
    out = _folder(v, name)
    (rows.groupBy(F.expr(f"event_id div {per}").alias("g")).agg(F.collect_list("j").alias("a"))
     .select(F.concat(F.lit("["), F.array_join("a", ","), F.lit("]")).alias("value"))
     .repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(out))
    return out


@query("read_qa", "select event_id, answer, choice_texts[2] as second, choice_texts[4] as fourth from qa")
def read_qa(v):
    tagged = F.struct(F.concat_ws("_", F.lit("q"), F.col("event_id").cast("string")).alias("id"), "video", "question", "choices", "answer")
    out = _arrays(v, v.qa.select("event_id", F.to_json(tagged).alias("j")), "qa")
    return R.read_qa(v.spark, out).select(F.regexp_extract("id", "_([0-9]+)$", 1).cast("bigint").alias("event_id"), "answer",
                                          F.col("choices")["B"].alias("second"), F.col("choices")["D"].alias("fourth"))


@query("read_predictions", "select event_id, category, letter as prediction, correct from scored", letters=_LETTERS, scored=_SCORED)
def read_predictions(v):
    """Result files of two hundred predictions each."""
    p = E.score_answers(v.qa)
    row = F.struct(F.concat_ws("_", F.lit("p"), F.col("event_id").cast("string")).alias("id"), "category", "prediction",
                   F.col("answer").alias("ground_truth"), "correct", "response")
    out = _folder(v, "predictions")
    (p.select("event_id", row.alias("r")).groupBy(F.expr("event_id div 200").alias("g")).agg(F.collect_list("r").alias("predictions"))
     .select(F.to_json(F.struct(F.create_map(F.lit("model"), F.lit("m")).alias("config"), "predictions")).alias("value"), "g")
     .repartition("g").select("value").write.option("maxRecordsPerFile", 1).text(out))
    return R.read_predictions(v.spark, out).select(
        F.regexp_extract("id", "_([0-9]+)$", 1).cast("bigint").alias("event_id"), "category", "prediction", "correct")


@query("write_accuracy_table", f"""select 'answers-' || event_id % 3 || '.json' as "Model (JSON File)", {_COLS} from scored group by all""",
       letters=_LETTERS, scored=_SCORED)
def write_accuracy_table(v):
    m = F.concat(F.lit("answers-"), (F.col("event_id") % 3).cast("string"), F.lit(".json"))
    out = _folder(v, "accuracy")
    E.write_accuracy_table(E.accuracy_table(E.score_answers(v.qa).withColumn("model", m)), out)
    fields = ", ".join(["`Model (JSON File)` string", *[f"`{t}` double" for t, _s, _c in E.TABLE_COLUMNS]])
    return v.spark.read.schema(fields).csv(out, header=True)


@query("write_scene", """select video_id, object_id, count(*) as n_steps from steps group by all""",
       single=_SINGLE, tracks=_TRACKS, steps=_STEPS, obs="select * from moments")
def write_scene(v):
    """Scene documents written in parts per video, and their track parts read back."""
    _, meta, ego, steps = single_run_scene(v)
    out = _folder(v, "scene")
    Sc.write_parts(Sc.scene_json_parts(meta, ego, Sc.track_documents(steps)), out)
    text = v.spark.read.text(out).filter(F.col("value").rlike(r'^,?\{"object_id"'))
    d = F.from_json(F.regexp_replace("value", "^,", ""), "object_id long, F_k array<struct<t:long>>")
    return text.select(F.col("video_id").cast("bigint"), d.alias("d")).select(
        "video_id", "d.object_id", F.size("d.F_k").cast("bigint").alias("n_steps"))
