"""Queries over questions, answers and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions import text as Tx
from sceneloom.operators import evaluate as E
from sceneloom.plans.registry import query

# the cascade in SQL over (response, keys A-D, choice_texts)
_SP = Tx.SPACE
_STRIP = f"regexp_replace(response, '^{_SP}+|{_SP}+\\z', '', 'g')"


def _cascade(valid: str) -> str:
    """SQL of the ordered answer patterns; ``valid`` guards a letter."""
    ok = lambda e: f"(case when {valid.format(x=e)} then {e} end)"
    ex = lambda text, p: f"upper(regexp_extract({text}, '{p}', 1))"
    tries = [ex("t", Tx.FINAL), ex("upper(t)", Tx.WHOLE), ex("upper(t)", Tx.LEADING)]
    tries += [ex("t", p) for p in Tx.KEYWORDS] + [ex("t", p) for p in Tx.BRACKETS]
    named = ("(case when len(choice_texts[1]) > 2 and contains(lower(t), lower(choice_texts[1])) then 'A' "
             "when len(choice_texts[2]) > 2 and contains(lower(t), lower(choice_texts[2])) then 'B' "
             "when len(choice_texts[3]) > 2 and contains(lower(t), lower(choice_texts[3])) then 'C' "
             "when len(choice_texts[4]) > 2 and contains(lower(t), lower(choice_texts[4])) then 'D' end)")
    return "coalesce(" + ", ".join([*map(ok, tries), named, ok(ex("upper(t)", Tx.ALONE)), "''"]) + ")"


_LETTER = _cascade("{x} in ('A', 'B', 'C', 'D')")
_LETTERS = f"select *, {_LETTER} as letter from (select *, {_STRIP} as t from qa)"
_SCORED = """select *, case when split = 'real' then case when regexp_extract(id, '([^_]*)$', 1)::int <= 922 then 'exo-centric'
        else 'ego-centric' end when lower(answer) = 'no' or starts_with(lower(answer), 'no ') then 'false-positive'
        else 'directional' end as category,
    letter <> '' and lower(choice_texts[strpos('ABCD', letter)]) = lower(answer) as correct from letters"""


@query("extract_answer", "select event_id, letter from letters", letters=_LETTERS)
def extract_answer(v):
    return v.qa.select("event_id", Tx.answer_letter(F.col("response"), F.col("choices")).alias("letter"))


_TALK = "select conv_id, turn, text as response, ['left', 'right', 'forward', 'no'] as choice_texts from conversations"


@query("extract_answer_texts", f"select conv_id, turn, {_LETTER} as letter from (select *, {_STRIP} as t from talk)", talk=_TALK)
def extract_answer_texts(v):
    choices = F.create_map(*[F.lit(x) for kv in zip("ABCD", ("left", "right", "forward", "no")) for x in kv])
    talk = v.spread(v.table("conversations"), "conv_id")
    return talk.select("conv_id", "turn", Tx.answer_letter(F.col("text"), choices).alias("letter"))


_SIMPLE = "coalesce(" + ", ".join(f"nullif(upper(regexp_extract(response, '{p}', 1)), '')" for p in Tx.SIMPLE) + \
    ", regexp_extract(upper(response), '([A-D])', 1))"


@query("extract_answer_simple", f"select event_id, {_SIMPLE} as letter from qa")
def extract_answer_simple(v):
    return v.qa.select("event_id", Tx.answer_letter_simple(F.col("response")).alias("letter"))


@query("extract_answer_simple_texts", f"select doc_id, {_SIMPLE} as letter from (select doc_id, text as response from documents)")
def extract_answer_simple_texts(v):
    docs = v.spread(v.table("documents"), "doc_id")
    return docs.select("doc_id", Tx.answer_letter_simple(F.col("text")).alias("letter"))


@query("answer_matches", "select event_id, letter, correct from scored", letters=_LETTERS, scored=_SCORED)
def answer_matches(v):
    return E.score_answers(v.qa).select("event_id", F.col("prediction").alias("letter"), "correct")


@query("classify_sample", "select event_id, category from scored", letters=_LETTERS, scored=_SCORED)
def classify_sample(v):
    return v.qa.select("event_id", E.classify(F.col("id"), F.col("split"), F.col("answer")).alias("category"))


@query("build_prompt", """select event_id, format('Question: {}\nA: {}\nB: {}\nC: {}\nD: {}\n\n' ||
    'Do not generate any intermediate reasoning process. Answer directly with the option letter from the given choices.',
    question, choice_texts[1], choice_texts[2], choice_texts[3], choice_texts[4]) as prompt from qa""")
def build_prompt(v):
    return v.qa.select("event_id", E.build_prompt(F.col("question"), F.col("choices"), "direct-output").alias("prompt"))


@query("build_prompt_steps", """select event_id, format('Question: {}\nA: {}\nB: {}\nC: {}\nD: {}\n\n' ||
    'Answer the given multiple-choice question step by step. Begin by explaining your reasoning process clearly. ' ||
    'In the last sentence of your response, you must conclude by stating the final answer using the following format: ' ||
    '''Therefore, the final answer is: $LETTER'' (without quotes), where $LETTER must be only one of the options ' ||
    '(A or B or C or D). Think step by step before answering.',
    question, choice_texts[1], choice_texts[2], choice_texts[3], choice_texts[4]) as prompt from qa""")
def build_prompt_steps(v):
    return v.qa.select("event_id", E.build_prompt(F.col("question"), F.col("choices")).alias("prompt"))


@query("accuracy", """select coalesce(split, 'all') as split, case when grouping(category) = 1 then 'all' else category end as category,
    count_if(correct)::bigint as correct, count(*) as total, count_if(correct) / count(*) as accuracy from scored
    group by grouping sets ((split, category), (split), ())""", letters=_LETTERS, scored=_SCORED)
def accuracy(v):
    return E.accuracy(E.score_answers(v.qa))


_ANSWERED = """select *, event_id % 7 = 0 or event_id % 11 = 0 as api_error from scored"""


@query("join_answers", """select event_id, api_error, case when event_id % 11 = 0 then 'ERROR: timeout' when event_id % 7 = 0
    then 'ERROR: no response' else response end as response, not api_error and correct as correct from answered""",
       letters=_LETTERS, scored=_SCORED, answered=_ANSWERED)
def join_answers(v):
    return E.score_answers(answered(v)).select("event_id", "api_error", "response", "correct")


def answered(v):
    """Responses joined back to their questions; some are missing, some failed."""
    e = F.col("event_id")
    responses = v.qa.filter((e % 7 > 0) | (e % 11 == 0)).select(
        "event_id", F.when(e % 11 == 0, None).otherwise(F.col("response")).alias("response"),
        F.when(e % 11 == 0, "timeout").alias("error"))
    return E.join_answers(v.qa.drop("response"), responses, ["event_id"])


@query("answer_quality", """select split, count_if(api_error or letter = '')::bigint as failed_extract,
    count_if(api_error)::bigint as api_errors, count(*) as total from answered group by all""",
       letters=_LETTERS, scored=_SCORED, answered=_ANSWERED)
def answer_quality(v):
    return E.answer_quality(E.score_answers(answered(v)))


_COLS = ",\n".join(
    f"round(coalesce(100e0 * count_if(correct and {c}) / nullif(count_if({c}), 0), 0e0), 2) as \"{t}\""
    for t, c in [(t, " and ".join(([f"split = '{s}'"] if s != "all" else []) + ([f"category = '{k}'"] if k != "all" else [])) or "true")
                 for t, s, k in E.TABLE_COLUMNS])


@query("accuracy_table", f"""select 'answers-' || event_id % 3 || '.json' as "Model (JSON File)", {_COLS} from scored group by all""",
       letters=_LETTERS, scored=_SCORED)
def accuracy_table(v):
    m = F.concat(F.lit("answers-"), (F.col("event_id") % 3).cast("string"), F.lit(".json"))
    return E.accuracy_table(E.score_answers(v.qa).withColumn("model", m))


_PREFIX = "https://media.example.org/data/"


@query("resolve_media", """select event_id, case when u % 4 = 0 then null when event_id % 3 = 0 then 'videos_real/clip' || u || '.mp4'
        when event_id % 3 = 1 then 'videos_synthetic/s/clip' || u || '.mp4' end as media from (
    select event_id, regexp_extract(video, 'clip([0-9]+)', 1)::int as u from qa)""")
def resolve_media(v):
    e = v.events.select("user_id").distinct().filter("user_id % 4 > 0")
    listing = e.select(F.explode(F.array(
        F.format_string("videos_real/clip%d.mp4", "user_id"), F.format_string("videos_synthetic/s/clip%d.mp4", "user_id"))).alias("path"))
    return E.resolve_media(v.qa, listing, _PREFIX).select("event_id", "media")


@query("tag_split", """select event_id, case when event_id % 3 = 1 then 'synthetic' else 'real' end as split from qa""")
def tag_split(v):
    name = F.element_at(F.array(F.lit("/d/QA_REAL.json"), F.lit("/real/synth_qa.json"), F.lit("/x/other.json")),
                        (F.col("event_id") % 3 + 1).cast("int"))
    return v.qa.select("event_id", E.split_of(name).alias("split"))
