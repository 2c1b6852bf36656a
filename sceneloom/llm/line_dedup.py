"""Boilerplate lines: those found on many sites, by sketches and then exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import bounded, kept, packed, text_key, unpacked

_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_text(line: Column) -> Column:
    return F.length(F.translate(line, _BLANK, "")) > 0


def spread_lines(docs: DataFrame, sites: int = 10, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """(line): hashes of the lines that occur on ``sites`` distinct sources or more.

    Every line hash gets a HyperLogLog sketch of its sources; sketches are merged by the
    aggregation, before and after the shuffle. An estimate outside sites * (1 - band) ..
    sites * (1 + band) decides (with 2 ** lg_k registers the error is some 1.6 %); lines
    within it are counted exactly. Blank lines and rows without source count for no line.
    """
    each = docs.select("source", F.explode(F.array_distinct(F.transform(
        F.filter(_lines(F.col("text")), _has_text), lambda x: F.xxhash64(x)))).alias("line")).filter("source is not null")
    # one row for each line and source and task at most, then one sketch for each line
    estimates = kept(each.groupBy("line").agg(F.hll_sketch_agg("source", F.lit(lg_k)).alias("_s")).select(
        "line", F.hll_sketch_estimate("_s").alias("n")).filter(F.col("n") >= sites * (1 - band)))
    sure = estimates.filter(F.col("n") > sites * (1 + band)).select("line")
    near = bounded(estimates.filter(F.col("n") <= sites * (1 + band)).select("line"))
    exact = (each.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= sites).select("line"))
    return sure.unionByName(exact)


def drop_spread_lines(docs: DataFrame, sites: int = 10, band: float = 0.25, lg_k: int = 12, most: float = 1.0) -> DataFrame:
    """The rows of ``docs``, their texts without cross-site boilerplate, and n_removed.

    A line is boilerplate if it occurs on ``sites`` distinct sources or more. All its
    occurrences go but the first one (smallest doc_id, then smallest key and position), so
    that the corpus as a whole loses no text. The other lines keep their order; a text of
    which nothing is left is empty. A text that would lose more than the share ``most`` of its
    characters stays whole: it is a copy rather than a page with boilerplate. Null texts stay
    null, a null source counts for no site, rows equal in doc_id and text lose the same
    lines, columns of any other name pass through, and n_chars, where there is one, is
    counted anew. A doc_id that is no number counts as null; texts of any length are taken
    whole, and an empty table gives no row.
    """
    key = text_key(F.col("doc_id"), F.col("text"))
    spread = bounded(kept(spread_lines(docs, sites, band, lg_k)))
    places = docs.select(F.expr("try_cast(doc_id as long)").alias("id"), key.alias("key"), F.posexplode(_lines(F.col("text"))).alias("pos", "_l")).filter(
        _has_text(F.col("_l"))).select("id", "key", "pos", F.xxhash64("_l").alias("line"), F.length("_l").alias("size"))
    found = kept(places.join(spread, "line", "left_semi"))
    first = found.groupBy("line").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("key").alias("k"), F.col("pos").alias("p"))).alias("_f"))
    # rows equal in doc_id and text bring the same places: a place counts once
    gone = found.join(first, "line").filter("not (key = _f.k and pos = _f.p)").groupBy("key").agg(F.collect_set(F.struct("pos", "size")).alias("_gone"))
    rows = packed(docs, _key=key, _text=F.col("text")).join(gone.withColumnRenamed("key", "_key"), "_key", "left")
    lost = F.aggregate("_gone", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    cut = F.col("_gone").isNotNull() & (lost <= F.lit(most) * F.length("_text"))

    def left(lines):
        """The lines whose places are not gone; the split text is bound once, and places are told apart by a hash set."""
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("_gone", lambda x: x["pos"]))
        return F.array_join(F.transform(places, lambda p: F.get(lines, p)), "\n")

    text = F.when(cut, F.get(F.transform(F.array(_lines(F.col("_text"))), left), F.lit(0))).otherwise(F.col("_text"))
    rows = rows.select("_row", text.alias("_text"), F.when(cut, F.size("_gone")).otherwise(0).alias("_n"))
    out = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.length("_text").cast("long"))
    return unpacked(rows.select(out.withField("n_removed", F.col("_n").cast("long")).alias("_row")))
