"""The scene graph: tables, JSON parts and text parts.

A scene is kept as tables (ego, observations, tracks). Its documents are written
as ordered parts, one row each, so that a video of any length never has to fit
into one row: the parts of a video, joined in order, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.text import fixed_places, plain_list, plain_number, rounded
from sceneloom.operators.lift import ego_track
from sceneloom.operators.masks import top_tau
from sceneloom.operators.tracks import WINDOW, track_window
from sceneloom.schema import DET, FRAME

# Metadata texts of the scene document.
COORDINATES = ("World frame = first frame camera. X=right, Y=down, Z=forward. "
               "Scale: metres if metric model, otherwise relative.")


def schema_notes(grid: int) -> dict[str, str]:
    # The field notes of the scene document.
    return {
        "ego[].xyz": "Camera position in world coordinates [x, y, z].",
        "tracks[].F_k[]": "Per-frame STEP token S_t^k (Eq. 4). Fields use paper symbols.",
        "tau": f"Image patch tokens: occupied cells in a {grid}x{grid} grid on the masked image. "
               "row/col = grid index; iou = mask-cell overlap.",
        "c": "Centroid token: 3D center of the object's point cloud in world coordinates [x, y, z].",
        "s": "Shape token: per-axis Gaussian statistics (mu, sigma, min, max) of the object's 3D point cloud.",
        "theta": "Temporal token: [t_start, t_end] track-level lifespan.",
    }


def scene_metadata(observations: DataFrame, frames: DataFrame, grid: int = 16) -> DataFrame:
    """Per video: grid, processed frames (also empty ones) and tracks with an observation."""
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_frames"))
    tracks = observations.groupBy("video_id").agg(F.countDistinct("object_id").alias("num_tracks"))
    return n.join(tracks, "video_id", "left").select(
        "video_id", F.lit(f"{grid}x{grid}").alias("grid"), "num_frames",
        F.coalesce("num_tracks", F.lit(0)).cast("bigint").alias("num_tracks"))


def step_tokens(observations: DataFrame, states: DataFrame, window: int = WINDOW, max_tau: int = 0) -> DataFrame:
    """Steps kept of each track: video_id, object_id, frame_idx and the struct ``step``.

    ``observations`` from fuse_tracks, ``states`` from object_state.
    """
    kept = track_window(observations, window)
    d = kept.join(states, DET)
    axis = lambda a: F.struct(F.col(f"c{a}").alias("mu"), F.col(f"{a}_sigma").alias("sigma"),
                              F.col(f"{a}_min").alias("min"), F.col(f"{a}_max").alias("max")).alias(a)
    step = F.struct(
        F.col("frame_idx").alias("t"), top_tau(F.col("tau"), max_tau).alias("tau"),
        F.array("cx", "cy", "cz").alias("c"), F.struct(*[axis(a) for a in "xyz"]).alias("s"),
        F.array("t_start", "t_end").alias("theta"))
    return d.select("video_id", "object_id", "frame_idx", step.alias("step"))


def track_documents(steps: DataFrame) -> DataFrame:
    """One nested row per track, its steps in frame order; the window bounds their number."""
    return steps.groupBy("video_id", "object_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "step"))), lambda s: s["step"]).alias("F_k"))


def keyframe_refs(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """Supplied image anchors (video_id, frame_idx, path) whose file exists."""
    return refs.join(listing.select("path").distinct(), "path", "left_semi")


_PART = ["video_id", "section", "major", "minor"]


def _part(df: DataFrame, section: int, major: Column, minor: Column, text: Column) -> DataFrame:
    return df.select("video_id", F.lit(section).alias("section"), major.cast("bigint").alias("major"),
                     minor.cast("bigint").alias("minor"), text.alias("text"))


def _after_first(df: DataFrame, order: str, keys: list[str] = ("video_id",)) -> Column:
    """True for every row but the first of its key; the firsts come by aggregate and join."""
    return F.col(order) > F.col("_first")


def _mark_first(df: DataFrame, order: str, keys: list[str] = ("video_id",)) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, list(keys))


def scene_json_parts(metadata: DataFrame, ego: DataFrame, tracks: DataFrame,
                     anchors: DataFrame | None = None, grid: int = 16) -> DataFrame:
    """The scene JSON of each video in ordered parts; nothing is truncated or rounded."""
    meta = metadata.select("video_id", F.struct(
        "grid", "num_frames", "num_tracks", F.lit(COORDINATES).alias("coordinate_system"),
        F.struct(*[F.lit(t).alias(n) for n, t in schema_notes(grid).items()]).alias("schema")).alias("m"))
    head = F.to_json("m")
    zero = F.lit(0)
    if anchors is None:
        parts = _part(meta, 0, zero, zero, F.concat(F.lit('{"metadata":'), head))
    else:
        open_head = F.concat(F.lit('{"metadata":'), F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"visual_anchor":['))
        a = _mark_first(anchors, "frame_idx")
        item = F.concat(F.when(_after_first(a, "frame_idx"), ",").otherwise(""), F.to_json(F.struct("frame_idx", "path")))
        parts = (_part(meta, 0, zero, zero, open_head)
                 .unionByName(_part(a, 1, F.col("frame_idx"), zero, item))
                 .unionByName(_part(meta, 2, zero, zero, F.lit("]}"))))
    e = _mark_first(ego, "frame_idx")
    ego_item = F.concat(F.when(_after_first(e, "frame_idx"), ",").otherwise(""),
                        F.to_json(F.struct(F.col("frame_idx").alias("t"), F.array("x", "y", "z").alias("xyz"))))
    t = _mark_first(tracks, "object_id")
    track_item = F.concat(F.when(_after_first(t, "object_id"), ",").otherwise(""), F.to_json(F.struct("object_id", "F_k")))
    return (parts.unionByName(_part(meta, 3, zero, zero, F.lit(',"ego":[')))
            .unionByName(_part(e, 4, F.col("frame_idx"), zero, ego_item))
            .unionByName(_part(meta, 5, zero, zero, F.lit('],"tracks":[')))
            .unionByName(_part(t, 6, F.col("object_id"), zero, track_item))
            .unionByName(_part(meta, 7, zero, zero, F.lit("]}"))))


def prompt_preamble(grid: Column, frames: Column, tracks: Column) -> Column:
    # The opening text of a rendered scene.
    return F.format_string(
        "You are a spatial reasoning agent analyzing a 4D scene graph (4DSG).\n"
        "Grid: %s, Frames: %d, Tracks: %d\n"
        "Coordinate system: " + COORDINATES + "\n\n"
        "[4DSG STRUCTURE]\n"
        "The 4DSG encodes every detected object across all video frames using STEP tokens.\n"
        "Each object track contains per-frame observations (F_k) with these fields:\n"
        "  tau  — Image patch tokens: which cells in a %s grid the object occupies. "
        "(row, col) = grid position, iou = how much of that cell the object covers. "
        "Tracks tau across frames to see how the object moves in the image.\n"
        "  c    — Centroid: 3D center [x, y, z] of the object in world coordinates (metres).\n"
        "  s    — Shape: per-axis Gaussian statistics (mu, sigma, min, max) of the object's 3D point cloud.\n"
        "  theta — Temporal span: [t_start, t_end] = first and last frame the object was seen.\n\n"
        "Other sections:\n"
        "  EGO POSES — Camera position [x, y, z] in world coordinates at each frame.\n"
        "  Use ego poses + object centroids (c) to derive spatial relations "
        "(distance, bearing, relative motion) yourself.\n", grid, frames, tracks, grid)


def _step_line() -> Column:
    s = F.col("step")
    num = lambda c: plain_number(c)
    tau = F.concat(F.lit("["), F.array_join(F.transform(s["tau"], lambda p: F.concat(
        F.lit("("), p["row"].cast("string"), F.lit(", "), p["col"].cast("string"), F.lit(", "),
        num(rounded(p["iou"])), F.lit(")"))), ", "), F.lit("]"))
    axis = lambda a: F.concat(F.lit(f'"{a}": {{'), F.concat_ws(", ", *[
        F.concat(F.lit(f'"{m}": '), num(s["s"][a][m])) for m in ("mu", "sigma", "min", "max")]), F.lit("}"))
    return F.concat(F.lit("  t="), s["t"].cast("string"), F.lit(": tau="), tau,
                    F.lit(" c="), plain_list([num(s["c"][i]) for i in range(3)]),
                    F.lit(" s={"), F.concat_ws(", ", *[axis(a) for a in "xyz"]), F.lit("}"),
                    F.lit(" theta="), plain_list([s["theta"][i].cast("string") for i in range(2)]))


def scene_text_parts(metadata: DataFrame, ego: DataFrame, steps: DataFrame) -> DataFrame:
    """The scene as prompt text, one part per line; parts of a video joined by newlines."""
    zero = F.lit(0)
    num = [plain_number(F.col(c)) for c in "xyz"]
    has_ego = metadata.join(ego.select("video_id").distinct(), "video_id", "left_semi")
    sizes = steps.groupBy("video_id", "object_id").agg(F.count(F.lit(1)).alias("_n"), F.max("frame_idx").alias("_end"))
    title = F.format_string("=== Object %d (F_k, %d frames) ===", "object_id", "_n")
    lines = steps.join(sizes, ["video_id", "object_id"])
    last = F.col("frame_idx") == F.col("_end")
    end_ego = ego.groupBy("video_id").agg(F.max("frame_idx").alias("_end"))
    ego_line = F.concat(F.lit("  t="), F.col("frame_idx").cast("string"), F.lit(": xyz="), plain_list(num),
                        F.when(last, "\n").otherwise(""))
    return (_part(metadata, 0, zero, zero, prompt_preamble(F.col("grid"), F.col("num_frames"), F.col("num_tracks")))
            .unionByName(_part(has_ego, 1, zero, zero, F.lit("[EGO POSES]")))
            .unionByName(_part(ego.join(end_ego, "video_id"), 2, F.col("frame_idx"), zero, ego_line))
            .unionByName(_part(sizes, 3, F.col("object_id"), F.lit(-1), title))
            .unionByName(_part(lines, 3, F.col("object_id"), F.col("frame_idx"),
                               F.concat(_step_line(), F.when(last, "\n").otherwise("")))))


def scene_summary_parts(ego: DataFrame, steps: DataFrame, edges: DataFrame, last: int = 5, max_edges: int = 20
                        ) -> DataFrame:
    """A short human form: positions to two decimals, the last observations, the last frame's edges."""
    zero = F.lit(0)
    videos = ego.select("video_id").distinct()
    two = fixed_places
    n = steps.groupBy("video_id").agg(F.countDistinct("object_id").alias("_n"))
    count = F.concat(F.lit("\nObjects ("), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" tracked):"))
    tail = track_window(steps, last)
    s = F.col("step")
    size = [two(s["s"][a]["max"] - s["s"][a]["min"]) for a in "xyz"]
    body = F.concat(F.lit("    Position: ("), F.concat_ws(", ", *[two(s["c"][i]) for i in range(3)]), F.lit(")\n    Size: "),
                    F.concat_ws("m x ", *size), F.lit("m\n    Visible: frames "),
                    s["theta"][0].cast("string"), F.lit("-"), s["theta"][1].cast("string"))
    names = steps.select("video_id", "object_id").distinct()
    end = edges.groupBy("video_id").agg(F.max("frame_idx").alias("frame_idx"))
    from sceneloom.operators.relations import top_k_edges
    shown = top_k_edges(edges.join(end, FRAME, "left_semi"), max_edges)
    edge_line = F.concat(F.format_string("  Object %d is %s of Object %d (", "src", "relation", "dst"),
                         fixed_places(F.col("dist"), 1), F.lit("m)"))
    return (_part(videos, 0, zero, zero, F.lit("=== 4D Scene Graph ===\n\nEgo Agent Trajectory:"))
            .unionByName(_part(ego, 1, F.col("frame_idx"), zero, F.concat(
                F.lit("  Frame "), F.col("frame_idx").cast("string"), F.lit(": position=("),
                F.concat_ws(", ", two(F.col("x")), two(F.col("y")), two(F.col("z"))), F.lit(")"))))
            .unionByName(_part(videos.join(n, "video_id", "left"), 2, zero, zero, count))
            .unionByName(_part(names, 3, F.col("object_id"), F.lit(-1), F.format_string("\n  Object %d:", "object_id")))
            .unionByName(_part(tail, 3, F.col("object_id"), F.col("frame_idx"), body))
            .unionByName(_part(end, 4, zero, zero, F.format_string("\nSpatial Relations (Frame %d):", "frame_idx")))
            .unionByName(_part(shown, 5, F.col("src"), F.col("dst"), edge_line)))


def write_parts(parts: DataFrame, path: str) -> None:
    """One folder per video whose files, in name order, hold its parts in order."""
    ordered = parts.repartitionByRange(*_PART).sortWithinPartitions(*_PART)
    ordered.select("video_id", "text").write.mode("overwrite").partitionBy("video_id").text(path)


def scene_tables(observations: DataFrame, states: DataFrame, frames: DataFrame, grid: int = 16,
                 window: int = WINDOW, max_tau: int = 0):
    """Metadata, ego and steps of all scenes."""
    return (scene_metadata(observations, frames, grid), ego_track(frames),
            step_tokens(observations, states, window, max_tau))
