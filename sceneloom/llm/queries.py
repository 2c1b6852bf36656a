"""The registered queries of the text operators, and their SQL where there is one.

Production parameters stand here once, for the queries and for the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm import conversations, decontaminate, html_extract, langid, licenses, line_dedup, minhash, neighbours, quality_rules, runs, sentencepieces, sharding, urls
from sceneloom.llm.common import table

# The rules of the URL filter, and words by which hosts are labelled as unwanted for training.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BAD_WORDS = ["adult", "ads", "adserver", "bet", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]
#: The cosine from which a notice is a licence's.
LICENCE_SCORE = 0.5
#: Shards of the training order.
SHARDS = 24
#: A line on so many sources is boilerplate.
SITES = 10
#: The least margin, as a share of the runner-up's size, for a language to be accepted.
MIN_MARGIN = 0.002
#: A run of words has so many words and periods at least.
RUN_WORDS, RUN_PERIODS = 6, 4
#: Neighbours of a vector, and the share of them that a search must find.
NEAREST, RECALL = 10, 0.95
#: The public vocabulary; every executor has the file.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _third():
    """crc32 of the doc_id as text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def taught(docs: DataFrame) -> DataFrame:
    """The documents that language models may learn from."""
    return docs.filter(_third() != 1)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/thousand/hundred/<doc_id>.txt, and a hundred's first document as its LICENSE file.

    A thousand's first document is the LICENSE of the thousand, a ten thousand's that of the source.
    """
    i = F.col("doc_id")
    k, h = (i / 1000).cast("long").cast("string"), (i / 100).cast("long").cast("string")
    path = (F.when(i % 10000 == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), i)))
            .when(i % 1000 == 0, F.concat_ws("/", "source", k, F.concat(F.lit("LICENSE-"), i)))
            .when(i % 100 == 0, F.concat_ws("/", "source", k, h, F.concat(F.lit("LICENSE-"), i)))
            .when(i.isNotNull(), F.concat_ws("/", "source", k, h, F.concat(i, F.lit(".txt")))))
    return docs.select("doc_id", path.alias("path"), "text")


_TEMPLATE_ROWS = ", ".join(f"('{a}', {b}, '{c}', {d}, {e})" for a, b, c, d, e in licenses.template_rows())
_IDF_ROWS = ", ".join(f"('{t}', {w})" for t, w in licenses.idf().items())
_CUE = licenses.CUE.replace("(?i)", "")


@_query("op1_license_scan", f"""
    with model(licence, variant, term, weight, square) as (values {_TEMPLATE_ROWS}), known(term, idf) as (values {_IDF_ROWS}),
    f as (select doc_id, coalesce(text, '') as text, concat_ws('/', source, case when doc_id % 10000 = 0 then 'LICENSE-' || doc_id
             when doc_id % 1000 = 0 then doc_id // 1000 || '/LICENSE-' || doc_id
             when doc_id % 100 = 0 then doc_id // 1000 || '/' || doc_id // 100 || '/LICENSE-' || doc_id
             else doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id || '.txt' end) as path from documents),
    u as (select path, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, '{_CUE}', 'i') then x else '' end), chr(10)) as cued,
                 path like '%LICENSE-%' as whole, text from f),
    n as (select path, unnest(list_concat(case when whole then [text] else [] end, list_filter(regexp_split_to_array(cued, '\n\n+'), lambda x: x <> ''))) as body from u),
    t as (select path, row_number() over () as unit, body from n),
    tok as (select path, unit, unnest(regexp_extract_all(lower(body), '{licenses.TERM}')) as term from t),
    v as (select path, unit, term, (count(*) * coalesce(any_value(idf), {licenses.rare_idf()}))::bigint as w from tok left join known using (term) group by path, unit, term),
    s as (select unit, sum(w * w)::bigint as own from v group by unit),
    d as (select path, unit, licence, variant, sum(w * weight)::bigint as dot, any_value(square) as square from v join model using (term) group by path, unit, licence, variant),
    c as (select path, licence, dot::double / sqrt(own::double * square::double) as score from d join s using (unit)),
    o as (select path, licence, score from c where score >= {LICENCE_SCORE} qualify row_number() over (partition by path order by score desc, licence) = 1),
    decl as (select regexp_replace(path, '/?[^/]*$', '') as dir, licence from o where path like '%LICENSE-%'
             qualify row_number() over (partition by regexp_replace(path, '/?[^/]*$', '') order by score desc, licence) = 1),
    dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as dir from f),
    near as (select dirs.dir, decl.dir as from_dir, decl.licence as from_licence from dirs join decl on dirs.dir = decl.dir or starts_with(dirs.dir, decl.dir || '/')
             qualify row_number() over (partition by dirs.dir order by length(decl.dir) desc) = 1)
    select doc_id, path, o.licence as own_licence, score, coalesce(o.licence, from_licence) as licence, case when o.licence is null then from_dir end as from_dir
    from f left join o using (path) left join near on near.dir = regexp_replace(path, '/?[^/]*$', '')""")
def op1(spark, sf_dir):
    files = as_files(table(spark, sf_dir, "documents"))
    found = licenses.scan(files, LICENCE_SCORE)
    return found.select(F.regexp_extract("path", "([0-9]+)(\\.txt)?$", 1).cast("long").alias("doc_id"), "path", "own_licence", "score", "licence", "from_dir")


@_query("op2_sharding")
def op2(spark, sf_dir):
    out = sharding.shards(table(spark, sf_dir, "documents"), SHARDS)
    text = F.col("record.text")
    return out.select(F.col("record.doc_id").alias("doc_id"), sharding.text_size(text).alias("size"), F.crc32(text).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op3_html_extract")
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


@_query("op4_minhash_near_dedup")
def op4(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("keeper").alias("kept"), "n_links")


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, label): the pages' URLs, 1 where the host's name has one of the BAD_WORDS."""
    found = F.exists(F.split(urls.host_of(F.col("url")), "[.-]"), lambda w: w.isin(BAD_WORDS))
    return pages.select("url", found.cast("int").alias("label"))


@_query("op5_url_filter")
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.train(labelled_urls(pages)), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


@_query("op6_sentencepiece")
def op6(spark, sf_dir):
    return sentencepieces.encode(table(spark, sf_dir, "documents"), MODEL_PATH)


@_query("op7_decontaminate")
def op7(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@_query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs.select("doc_id", "text"), langid.learn(taught(docs)), MIN_MARGIN).select(
        "doc_id", F.coalesce(_third() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_accepted")


_WORDS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_BOUNDS = " and ".join(f"{m} {op} {bound}" for m, least, most in quality_rules.RULES for op, bound in ((">=", least), ("<=", most)) if bound is not None)


@_query("op9_quality_rules", f"""
    with d as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]'), lambda w: w <> '') as w from documents),
    m as (select doc_id, t, w, len(w) as n_words, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as l from d),
    g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) as i from m where len(w) > 8)),
    twice as (select doc_id, i from g join (select doc_id, g from g group by all having count(*) > 1) using (doc_id, g)),
    covered as (select doc_id, count(distinct i + k) as c from twice, (select unnest(range(0, 8)) as k) group by doc_id),
    f as (select m.doc_id, n_words::bigint as n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
                 (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::bigint as n_symbols,
                 (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c, 0)::bigint as n_repeat_words, len(l) as n_lines,
                 len(list_filter(w, lambda x: lower(x) in ({_WORDS}))) as n_stop,
                 length(regexp_replace(t, '[\\p{{P}}\\p{{S}}\\p{{N}}\\s]+', '', 'g')) as n_letters
          from m left join covered using (doc_id)),
    r as (select *, n_stop / greatest(n_words, 1) as stop_share, word_chars / greatest(n_words, 1) as mean_word,
                 n_symbols / greatest(word_chars, 1) as symbol_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_share,
                 n_repeat_words / greatest(n_words, 1) as repeat_share, n_letters / greatest(word_chars, 1) as letter_share,
                 n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_BOUNDS} as kept from r""")
def op9(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op10_line_dedup", f"""
    with line as (select doc_id, source, p as pos, (string_split(text, chr(10)))[p] as line
                  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as p from documents where text is not null)),
    spread as (select line from line where length(translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0
               group by line having count(distinct source) >= {SITES}),
    place as (select doc_id, pos, row_number() over (partition by line order by doc_id, pos) > 1 as again from line semi join spread using (line)),
    gone as (select doc_id, pos from place where again),
    rest as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text from line l anti join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id),
    n as (select doc_id, count(*) as n from gone group by doc_id)
    select d.doc_id, case when d.text is not null then coalesce(r.text, '') end as text,
           case when d.text is not null then length(coalesce(r.text, '')) end as n_chars, coalesce(n.n, 0) as n_removed
    from documents d left join rest r using (doc_id) left join n using (doc_id)""")
def op10(spark, sf_dir):
    return line_dedup.drop_spread_lines(table(spark, sf_dir, "documents"), SITES).select("doc_id", "text", "n_chars", "n_removed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts, by crc32 of the doc_id, all words from some word on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("_h div 10")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    chosen = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.select("doc_id", "text", h.alias("_h")).select(
        "doc_id", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), F.coalesce(chosen, F.lit(""))).otherwise(F.col("text")).alias("text"))


@_query("op11_periodic_runs")
def op11(spark, sf_dir):
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), RUN_WORDS, RUN_PERIODS)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    # the greatest length / period, compared as whole numbers; runs come by start, then period, so the first of equals stays
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                    lambda top, r: F.when(r.length * top.period > top.length * r.period, r).otherwise(top))
    return found.select("_row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "collapsed", listed.alias("listed")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("listed", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query("op13_nearest_vectors")
def op13(spark, sf_dir):
    index = neighbours.build_index(table(spark, sf_dir, "embeddings"))
    asked = index.rows.filter("vec_id % 100 = 0").select("vec_id", "vec")
    visits, _ = neighbours.calibrate(index, asked, NEAREST, RECALL)
    return neighbours.search(index, asked, visits, NEAREST)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, doubled or given to the user, by crc32 of conv_id and turn; nulls become a space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("_h")).filter("_h <> 0")
    return hurt.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")).drop("_again")


@_query("op12_conversation_repair")
def op12(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    audited, mended = conversations.repair(damaged(given))
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    found = audited.join(conversations.digests(mended).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
