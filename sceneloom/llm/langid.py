"""Language by compression: the language whose dictionary shortens a text most.

Each language has a zstandard raw-content dictionary, a bounded sample of its texts. A
text is lower-cased, reduced to its letters and cut into blocks, so that the dictionary
and not the text's own past explains it; every block of the whole text is compressed with
every dictionary. Matches of four bytes count, as languages differ in word endings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.common import about, packed, slices, unpacked

#: Texts of each language and characters of each that dictionaries are made of; bytes compressed at a time.
SAMPLE_TEXTS, SAMPLE_CHARS, BLOCK_BYTES = 64, 2000, 1024


def _plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^\\pL]+", " ")


def _encoder(dictionary: bytes):
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, chain_log=17, hash_log=17, target_length=8,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress


def learn(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language from (text, lang, ...) rows; rows with a null in either don't count.

    Of each language ``sample_texts`` texts are taken by their hash, of each
    ``sample_chars`` characters at most: the sample and so the driver's share are bounded.
    A language's different texts are counted first, and only some four times the sample go
    on; copies of one text count and go on once, so no language gets lost by them.
    """
    full = labelled.filter("text is not null and lang is not null and length(text) > 0").select("lang", F.substring("text", 1, sample_chars).alias("text"))
    sizes = {r.lang: r.n for r in full.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return {}
    many = F.create_map(*[F.lit(x) for kv in sorted(sizes.items()) for x in kv])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    some = (full.filter(about(4 * sample_texts, many, F.col("text"))).distinct()
            .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample_texts).orderBy("lang", "_r"))
    texts: dict[str, list[str]] = {}
    for row in some.collect():
        texts.setdefault(row.lang, []).append(row.text)
    return {lang: " ".join(_plain(pa.array(t, pa.string())).to_pylist()).encode() for lang, t in texts.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and lang_accepted.

    ``lang_pred`` is the language of the smallest size (ties: the first by name), ``und``
    for a null text or one without a letter. ``score`` is the share by which the runner-up
    is longer, scaled into 0..1; with a single language it is 1. ``lang_accepted`` is
    false for ``und`` and where the margin is ``min_margin`` or less of the runner-up's
    size. Only the text is read. Columns of these three names are replaced.
    """
    langs = sorted(dictionaries)
    content = [dictionaries[x] for x in langs]

    def run(batches):
        encoders = [_encoder(x) for x in content]
        for part in slices(batches, "_text"):
            texts = part.column("_text")
            names, margins = [], []
            for data in _plain(texts).cast(pa.large_binary()).to_pylist():
                if not data.strip() or not langs:
                    names.append("und")
                    margins.append(0.0)
                    continue
                blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                sizes = [sum(len(f(b)) for b in blocks) for f in encoders]
                least = min(sizes)
                best = sizes.index(least)
                other = min((s for i, s in enumerate(sizes) if i != best), default=0)
                names.append(langs[best])
                margins.append((other - least) / other if other else 1.0)
            m = np.array(margins)
            named = np.array([n != "und" for n in names])
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array(names, pa.string()), pa.array(m), pa.array(named & (m > min_margin))],
                ["_row", "lang_pred", "score", "lang_accepted"])

    rows = packed(docs.drop("lang_pred", "score", "lang_accepted"), _text=F.col("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_row {kind}, lang_pred string, score double, lang_accepted boolean")
    return out.select("_row.*", "lang_pred", "score", "lang_accepted")


def drop_undecided(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language the operator accepts, with their columns as they are."""
    own = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_row", F.col("text"))
    return unpacked(predict(own, dictionaries, min_margin).filter("lang_accepted").select("_row"))
