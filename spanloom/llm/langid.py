"""Language by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, runs

#: Bytes of training text per language, at most: the bound of the sample.
DICTIONARY_BYTES = 1 << 17
#: Times a dictionary's size that is looked at to fill it.
SPARE = 4
#: Bytes of training text over all languages, at most: of more than 256 languages each gets an equal part of it.
SAMPLE_BYTES = 1 << 25
LEVEL = 3
#: A lead over the second best of less than this share of the best size is narrow.
MARGIN = 0.02
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """The text's words of letters, in lower case: what is compressed, in training and after."""
    return " ".join(LETTERS.findall(text.lower()))


def learn(rows: DataFrame, size: int = DICTIONARY_BYTES, total: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per language from ``rows(doc_id, text, lang)``, the most frequent language first.

    Every language with a letter in its texts is learned.  The sample is bounded: of each language the rows of
    smallest id hash, until their letters fill ``size`` bytes, or an equal part of ``total``.  A language's
    amount of text gives the share of hashes that is looked at, ``SPARE`` times what the dictionary needs and its
    first row with a letter at least, so that what meets in one task is bounded at any scale.  Rows with a null
    language or text teach nothing; equal texts of a language teach once; rows without id are hashed by their text.
    """
    rank = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"))), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select(rank.alias("rank"), F.col("lang").cast("string"), F.col("text").cast("string"))
    lettered = F.substring("text", 1, size).rlike(r"\p{L}")
    amounts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(size))).alias("chars"), F.min(F.when(lettered, F.col("rank"))).alias("first"))
    known = amounts.orderBy(F.col("n").desc(), "lang").collect()
    if not known:
        return {}
    size = max(1, min(size, total // len(known)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], max(SPARE * size / max(r["chars"], 1), r["first"] or 0.0)) for r in known], "lang string, share double")

    def fill(key, part):
        import pandas as pd

        part["text"] = part["text"].map(letters)
        best = part.sort_values(["rank", "text"]).drop_duplicates("text")
        keep = best["text"].str.encode("utf-8").str.len().cumsum().shift(1, fill_value=0) < size
        return pd.DataFrame({"lang": [key[0]], "content": [" ".join(best["text"][keep][::-1]).encode()[-size:]]})

    sample = rows.join(F.broadcast(shares), "lang").where("rank <= share").select("rank", "lang", F.substring("text", 1, size).alias("text"))
    learned = {r["lang"]: bytes(r["content"]) for r in sample.groupBy("lang").applyInPandas(fill, "lang string, content binary").collect()}
    return {r["lang"]: learned[r["lang"]] for r in known if learned.get(r["lang"])}


@lru_cache(4)
def compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def language(text: Column, model: dict[str, bytes]) -> Column:
    """struct(lang, score, rejected) of a text under dictionaries by language.

    lang: the language of the smallest encoding, of equals the one most frequent in
    training; ``und``
    for null texts and those without a letter, or where nothing was learned.  score: the share of
    the best among weights that fall with a language's extra bytes, 0 for ``und``.
    rejected: ``und``, or a lead below ``MARGIN``.
    """
    fixed = tuple(model.items())
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.arrow_udf(kind)
    def predict(column: pa.Array) -> pa.Array:
        tools, names = compressors(fixed), [n for n, _ in fixed]
        lang, score, rejected = [], [], []
        for texts in runs(column):
            for text in texts.to_pylist():
                plain = letters(text).encode()
                if not plain or not tools:
                    lang.append("und"), score.append(0.0), rejected.append(True)
                    continue
                sizes = [len(c.compress(plain)) for c in tools]
                best = min(sizes)
                extra = np.array(sizes) - best
                rivals = sorted(extra)[1:2] or [len(plain)]
                lang.append(names[sizes.index(best)])
                score.append(float(1 / np.exp(-extra * 8 * math.log(2) / max(8.0, best**0.5)).sum()))
                rejected.append(bool(rivals[0] < MARGIN * best))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return predict.asNondeterministic()(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), language(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


QUERIES = {"op10_language_id": op10_language_id}
