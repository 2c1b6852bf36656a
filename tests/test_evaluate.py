"""Answers, categories, accuracies, files and text."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sceneloom.functions import text as Tx
from sceneloom.operators import evaluate as E
from sceneloom.sources import readers as R

CHOICES = {"A": "left", "B": "right", "C": "no", "D": "it turns around"}


@pytest.mark.parametrize("response,letter", [
    ("Therefore, the final answer is: B", "B"), ("FINAL ANSWER IS $c", "C"), ("the final answer is E. option: D", "D"),
    (" a ", "A"), (" b ", "B"), ("b) since", "B"), ("C. yes", "C"), ("D it is", "D"), ("AB", ""),
    ("my Answer: d", "D"), ("answer is  C", "C"), ("I take option B", "B"), ("choice:a", "A"),
    ("perhaps (C) or (D)", "C"), ("perhaps (c)", "C"), ("hm [D]", "D"),
    ("It Turns Around quickly", "D"), ("no", ""), ("to the left, then right", "A"),
    ("so B seems", "B"), ("x_B y", ""), ("éB c", "C"), ("", ""), ("answer: x (B)", "B"), ("final answer is Bob", "B")])
def test_answer_letter(spark, response, letter):
    df = spark.createDataFrame([(response, CHOICES)], "r string, c map<string,string>")
    assert df.select(Tx.answer_letter(F.col("r"), F.col("c")).alias("l")).first().l == letter


def test_letter_must_be_a_choice(spark):
    df = spark.createDataFrame([("the final answer is D, or rather option B", {"A": "x", "B": "y"})], "r string, c map<string,string>")
    assert df.select(Tx.answer_letter(F.col("r"), F.col("c")).alias("l")).first().l == "B"


@pytest.mark.parametrize("response,letter", [("final answer: c", "C"), ("x (b)", "B"), ("first\nd. so", "D"), ("well", ""), ("cab", "C")])
def test_simple_letter(spark, response, letter):
    assert spark.range(1).select(Tx.answer_letter_simple(F.lit(response)).alias("l")).first().l == letter


def test_categories(spark):
    df = spark.createDataFrame([("real_mc_922", "real", "x"), ("real_mc_923", "real", "x"), ("s_1", "synthetic", " No "),
                                ("s_2", "synthetic", "no one"), ("s_3", "synthetic", "none")], "id string, split string, answer string")
    got = [r.c for r in df.select(E.classify(F.col("id"), F.col("split"), F.col("answer")).alias("c")).collect()]
    assert got == ["exo-centric", "ego-centric", "false-positive", "false-positive", "directional"]


def published(spark, ego, exo, direct, fp):
    """Predictions with the published numbers of right answers."""
    parts = [("real", "ego-centric", 449, ego), ("real", "exo-centric", 922, exo),
             ("synthetic", "directional", 400, direct), ("synthetic", "false-positive", 45, fp)]
    return spark.createDataFrame([("m.json", s, c, i < k) for s, c, n, k in parts for i in range(n)],
                                 "model string, split string, category string, correct boolean")


@pytest.mark.parametrize("right,table", [
    ((341, 668, 275, 29), [75.95, 72.45, 73.6, 68.75, 64.44, 68.31, 72.3]),
    ((332, 662, 265, 33), [73.94, 71.8, 72.5, 66.25, 73.33, 66.97, 71.15])])
def test_published_accuracies(spark, tmp_path, right, table):
    preds = published(spark, *right)
    t = E.accuracy_table(preds)
    assert list(t.first())[1:] == table
    assert len(E.accuracy(preds).collect()) == 7
    E.write_accuracy_table(t, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert [float(x) for x in back.first()[1:]] == table


def test_missing_media_counts_as_wrong(spark):
    qa = spark.createDataFrame([("real_1", "real", {"A": "l"}, "l", "p.mp4"), ("real_2", "real", {"A": "l"}, "l", None), ("real_3", "real", {"A": "l"}, "l", "p.mp4")],
                               "id string, split string, choices map<string,string>, answer string, media string")
    responses = spark.createDataFrame([("real_1", "A"), ("real_2", "A")], "id string, response string")
    scored = E.score_answers(E.join_answers(qa, responses, ["id"]))
    assert rows(scored, "id", "response", "prediction", "correct") == [
        ("real_1", "A", "A", True), ("real_2", "VIDEO_NOT_FOUND", "", False), ("real_3", "ERROR: no response", "", False)]
    q = E.answer_quality(scored).first()
    assert (q.failed_extract, q.api_errors, q.total) == (2, 2, 3)


def test_unknown_prompt_style(spark):
    with pytest.raises(ValueError):
        E.build_prompt(F.lit("q"), F.lit("c"), "poem")


def test_media_paths(spark):
    p = "https://h.example.org/main/"
    urls = [p + "videos_real/a/b.mp4", "https://x.org/z/videos_synthetic/c.mp4?x=1", "https://x.org/other/c.mp4", "videos_real/d.mp4"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.m for r in df.select(E.media_path(F.col("u"), p).alias("m")).collect()] == [
        "videos_real/a/b.mp4", "videos_synthetic/c.mp4", None, "videos_real/d.mp4"]


def test_question_and_prediction_files(spark, tmp_path):
    qa = [{"id": "real_1", "video": "v", "question": "q?", "choices": {"A": 1, "B": "two"}, "answer": 1}]
    (tmp_path / "qa_real.json").write_text(json.dumps(qa, indent=1))
    q = R.read_qa(spark, str(tmp_path / "qa_real.json")).first()
    assert q.choices == {"A": "1", "B": "two"} and q.answer == "1"
    for name in ("out_real.json", "out_synth.json", "other.json"):
        (tmp_path / name).write_text(json.dumps({"config": {"model": "m"}, "metrics": {}, "predictions": [
            {"id": "real_1", "category": "exo-centric", "prediction": "A", "ground_truth": "1", "correct": True, "response": "A"}]}, indent=1))
    d = R.read_predictions(spark, str(tmp_path / "o*.json"))
    assert rows(d, "model", "split", "split_known", "correct") == [
        ("other.json", "real", False, True), ("out_real.json", "real", True, True), ("out_synth.json", "synthetic", True, True)]


@pytest.mark.parametrize("x,s", [(0.5, "0.5"), (5.0, "5.0"), (-0.0, "-0.0"), (0.000123, "0.000123"), (1e-05, "1e-05"), (1.25e-07, "1.25e-07"),
                                 (12345678.5, "12345678.5"), (2e7, "20000000.0"), (1e16, "1e+16"), (-3.5e-4, "-0.00035"), (0.1, "0.1"), (1.5e300, "1.5e+300")])
def test_numbers_in_scene_texts(spark, x, s):
    assert repr(x) == s
    assert spark.createDataFrame([(x,)], "x double").select(Tx.plain_number(F.col("x")).alias("s")).first().s == s


def test_rounding_on_the_binary_value(spark):
    """Ties and near ties come out as correct rounding of the stored double has them."""
    from sceneloom.functions.text import fixed_places, rounded
    values = [0.525, 0.575, 0.125, 0.375, 0.625, 2.675, 1.005, 0.285, 0.565, 0.57, 0.29, -0.001, -0.0, 0.0, -2.5, 1234.565, 99999.995, -0.375,
              0.005, 0.015, 0.995, 1.115, 4.35, 1e-12, 123456.785] + [k / 1000 for k in range(0, 1200)] + [k / 16 for k in range(-80, 80)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", rounded(F.col("x")).alias("r"), fixed_places(F.col("x")).alias("t"), fixed_places(F.col("x"), 1).alias("o")).collect():
        assert (r.r, r.t, r.o) == (round(r.x, 2), f"{r.x:.2f}", f"{r.x:.1f}"), r.x


def test_answers_know_unicode_spaces_and_line_ends(spark):
    choices = F.create_map(*[F.lit(x) for kv in zip("ABCD", ("left", "right", "forward", "no way")) for x in kv])
    rows = [("final answer is\u00a0B", "B", None), ("answer\u2003is:\u3000C", "C", None), ("option:\u2028D", "D", None),
            ("Had it\rC. yes", None, "A"), ("Had it\u2028C. yes", None, "A"), ("Had it\nC. yes", None, "C"), ("B\u00a0then", None, "B")]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select("t", Tx.answer_letter(F.col("t"), choices).alias("a"), Tx.answer_letter_simple(F.col("t")).alias("b")).collect()
    for r, (_, a, b) in zip(got, rows):
        assert (a is None or r.a == a) and (b is None or r.b == b), r
