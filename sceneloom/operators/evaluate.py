"""Scoring multiple-choice answers about scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.text import answer_letter, same_answer, strip

# The last exo-centric question number, and the two prompt texts.
LAST_EXO = 922
PROMPTS = {
    "cot": ("Question: %s\n%s\n\n"
            "Answer the given multiple-choice question step by step. "
            "Begin by explaining your reasoning process clearly. "
            "In the last sentence of your response, you must conclude by "
            "stating the final answer using the following format: "
            "'Therefore, the final answer is: $LETTER' (without quotes), "
            "where $LETTER must be only one of the options (A or B or C or D). "
            "Think step by step before answering."),
    "direct-output": ("Question: %s\n%s\n\n"
                      "Do not generate any intermediate reasoning process. "
                      "Answer directly with the option letter from the given choices."),
}


def split_of(name: Column) -> Column:
    """Data split by file name; unknown names count as real."""
    low = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    return F.when(low.contains("real"), "real").when(low.contains("synth"), "synthetic").otherwise("real")


def tag_split_by_file(df: DataFrame) -> DataFrame:
    """Adds ``split``, and ``split_known``, which is false where the name says neither."""
    name = F.input_file_name()
    low = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    return df.withColumn("split", split_of(name)).withColumn(
        "split_known", low.contains("real") | low.contains("synth"))


def media_path(url: Column, prefix: str) -> Column:
    """Path below the media root: behind the prefix, else from the first known folder on."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin("videos_real", "videos_synthetic")), True)
    rel = F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/"))
    return F.when(url.startswith(prefix), F.substring(url, F.lit(len(prefix) + 1), F.length(url))).otherwise(rel)


def resolve_media(qa: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """Adds ``media``: the file of each question, null when it is not in the listing."""
    known = listing.select(F.col("path").alias("media")).distinct()
    want = qa.withColumn("_want", media_path(F.col("video"), prefix))
    return want.join(known, want["_want"] == known["media"], "left").drop("_want")


def classify(ids: Column, split: Column, answer: Column, last_exo: int = LAST_EXO) -> Column:
    """Question category from its number (real) or its answer (synthetic)."""
    num = F.regexp_extract(ids, r"([^_]*)$", 1).cast("int")
    low = F.lower(strip(answer))
    return (F.when(split == "real", F.when(num <= last_exo, "exo-centric").otherwise("ego-centric"))
            .when((low == "no") | low.startswith("no "), "false-positive").otherwise("directional"))


def build_prompt(question: Column, choices: Column, style: str = "cot") -> Column:
    if style not in PROMPTS:
        raise ValueError(f"unknown prompt style: {style}")
    lines = F.array_join(F.transform(F.map_entries(choices), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.format_string(PROMPTS[style], question, lines)


def join_answers(qa: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Each question with its response; a question without one, or without media, is an error.

    ``responses`` has the keys, response and optionally error.
    """
    r = responses if "error" in responses.columns else responses.withColumn("error", F.lit(None).cast("string"))
    j = qa.join(r, keys, "left")
    lost = F.when(F.col("media").isNull(), F.lit("VIDEO_NOT_FOUND")) if "media" in qa.columns else F.lit(None).cast("string")
    problem = F.coalesce(lost, F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error"))),
                         F.when(F.col("response").isNull(), F.lit("ERROR: no response")))
    return j.withColumn("api_error", problem.isNotNull()).withColumn(
        "response", F.coalesce(problem, F.col("response"))).drop("error")


def score_answers(answered: DataFrame, last_exo: int = LAST_EXO) -> DataFrame:
    """Adds category, prediction and correct; errors count as wrong."""
    failed = F.col("api_error") if "api_error" in answered.columns else F.lit(False)
    d = answered.withColumn("category", classify(F.col("id"), F.col("split"), F.col("answer"), last_exo))
    d = d.withColumn("prediction", F.when(failed, F.lit("")).otherwise(answer_letter(F.col("response"), F.col("choices"))))
    return d.withColumn("correct", same_answer(F.col("prediction"), F.col("choices"), F.col("answer")))


def accuracy(preds: DataFrame) -> DataFrame:
    """Correct, total and accuracy per category, per split and overall, in one shuffle."""
    out = preds.groupingSets(
        [[F.col("split"), F.col("category")], [F.col("split")], []], F.col("split"), F.col("category")
    ).agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_g"))
    return out.select(F.when(F.col("_g") == 3, "all").otherwise(F.col("split")).alias("split"),
                      F.when(F.col("_g") > 0, "all").otherwise(F.col("category")).alias("category"),
                      "correct", "total",
                      F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"))


def answer_quality(preds: DataFrame) -> DataFrame:
    """Answers without a letter, and errors, per split."""
    return preds.groupBy("split").agg(F.count_if(F.col("prediction") == "").alias("failed_extract"),
                                      F.count_if("api_error").alias("api_errors"), F.count(F.lit(1)).alias("total"))


# The columns of the accuracy table, with the row each one shows.
TABLE_COLUMNS = [
    ("Real Ego-centric Accuracy (%)", "real", "ego-centric"),
    ("Real Exo-centric Accuracy (%)", "real", "exo-centric"),
    ("Real Overall Accuracy (%)", "real", "all"),
    ("Synthetic Directional Accuracy (%)", "synthetic", "directional"),
    ("Synthetic FP Accuracy (%)", "synthetic", "false-positive"),
    ("Synthetic Overall Accuracy (%)", "synthetic", "all"),
    ("Overall Accuracy (%)", "all", "all"),
]


def accuracy_table(preds: DataFrame, model: str = "model") -> DataFrame:
    """One line per model: accuracies in percent to two decimals.

    The counts are conditional sums of one aggregate, so models of any number of
    answers need one shuffle of one partial row per task.
    """
    s, c, ok = F.col("split"), F.col("category"), F.col("correct")
    cols = []
    for title, split, cat in TABLE_COLUMNS:
        hit = F.lit(True)
        if split != "all":
            hit = hit & (s == split)
        if cat != "all":
            hit = hit & (c == cat)
        n = F.count_if(hit)
        cols.append(F.round(F.when(n > 0, F.count_if(hit & ok) * 100.0 / n).otherwise(0.0), 2).alias(title))
    return preds.groupBy(F.col(model).alias("Model (JSON File)")).agg(*cols)


def write_accuracy_table(table: DataFrame, path: str) -> None:
    """CSV with a header; the table has one short line per model."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)
