"""Token totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import uuid
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import RANKS, looked_up, tokenizer
from spanloom.llm.common import documents, runs, written
from spanloom.session import shared_folder

#: Versions counted, and their rank files.
TOKENIZERS = {"byte_bpe_50k": RANKS, "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
#: Bits of a count of tokens.
FIELD = 40
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]


@lru_cache(4)
def counting(paths: tuple[str, ...]):
    """A function from texts to their numbers of tokens under each vocabulary.

    A pre-token's counts are remembered as one number, ``FIELD`` bits for each vocabulary, so
    that one look-up and one sum serve all of them.
    """
    tools, seen = [tokenizer(p) for p in paths], {}

    def packed(piece: bytes) -> int:
        return sum(len(t.merged(piece)) << FIELD * i for i, t in enumerate(tools))

    def count(texts: list[str]) -> list[list[int]]:
        words, bounds = tools[0].words(texts)
        found = looked_up(words, seen, packed)
        sums = [sum(found[a:b]) for a, b in zip(bounds, bounds[1:])]
        return [[s >> FIELD * i & (1 << FIELD) - 1 for i in range(len(tools))] for s in sums]

    return count


def token_counts(text: Column, paths: list[str]) -> Column:
    """Array of a whole text's numbers of tokens, one for each vocabulary; null and empty texts have none."""
    fixed = tuple(paths)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def count(column: pa.Array) -> pa.Array:
        of = counting(fixed)
        return pa.array([n for texts in runs(column) for n in of(texts.to_pylist())], pa.list_(pa.int64()))

    return count.asNondeterministic()(text.cast("string"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that bring in ``counts(doc_id, source, lang, tokenizer, n_tokens)``."""
    gone = [F.lit(None).cast(t).alias(n) for n, t in (("was_source", "string"), ("was_lang", "string"), ("was_tokens", "long"))]
    return counts.select("doc_id", *KEYS, "n_tokens", *gone)


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take ``counts`` out again."""
    none = [F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang")]
    return counts.select("doc_id", *none, "tokenizer", F.lit(None).cast("long").alias("n_tokens"), F.col("source").alias("was_source"), F.col("lang").alias("was_lang"), F.col("n_tokens").alias("was_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one counts table to a later one: what only one has is deleted or inserted, what differs revised."""
    b, a = before.alias("b"), after.alias("a")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.tokenizer") == F.col("b.tokenizer"))
    differ = F.struct("a.source", "a.lang", "a.n_tokens") != F.struct("b.source", "b.lang", "b.n_tokens")
    both = b.join(a, same, "full").where(F.col("a.doc_id").isNull() | F.col("b.doc_id").isNull() | F.coalesce(differ, F.lit(True)))
    pick = [F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.col("a.source"), F.col("a.lang"), F.coalesce("a.tokenizer", "b.tokenizer").alias("tokenizer"), F.col("a.n_tokens")]
    return both.select(*pick, F.col("b.source").alias("was_source"), F.col("b.lang").alias("was_lang"), F.col("b.n_tokens").alias("was_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Delta totals: a new count adds, an old one subtracts.  A null count means that side is absent."""
    sides = F.array(
        F.struct(F.col("source"), F.col("lang"), F.lit(1).alias("sign"), F.col("n_tokens").alias("n")),
        F.struct(F.col("was_source").alias("source"), F.col("was_lang").alias("lang"), F.lit(-1).alias("sign"), F.col("was_tokens").alias("n")),
    )
    rows = changes.select("tokenizer", F.inline(sides)).where("n IS NOT NULL")
    return rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))


class Rollup:
    """Additive totals in a folder that driver and executors share.

    A batch's delta, a row for each key it touches, is written under a name of its own; then
    a whole marker is renamed to the batch's name, which only one writer can do.  Totals are the sum
    over the marked deltas.  So a batch that is repeated, or retried after any failure, counts
    once, and a delta without marker not at all.  ``compact`` folds deltas into a snapshot,
    which names the batches inside.
    """

    KIND = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _claim(self, name: str, content: str) -> bool:
        """Make a marker that holds ``content``; False if there is one.

        The content is written under a name of its own, which is then renamed without overwriting: so a marker
        is whole from the moment it is there, whatever fails before.
        """
        place, draft = self.path(f"{self.folder}/{name}"), self.path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        self.files.mkdirs(place.getParent())
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        keep = gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        try:
            hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self.files.makeQualified(draft), self.files.makeQualified(place), keep)
        except Exception:
            if not self.files.exists(place):
                raise
            self.files.delete(draft, False)
            return False
        return True

    def _markers(self, kind: str) -> dict[str, str]:
        place = self.path(f"{self.folder}/{kind}")
        if not self.files.exists(place):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{kind}", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
        return {r["name"]: r["value"] for r in rows if r["value"]}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes of one batch; False, and nothing done, if the batch was committed before."""
        if not batch or set(batch) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-"):
            raise ValueError(f"a batch is named by letters, digits and dashes, not {batch!r}")
        place = self.path(f"{self.folder}/commits/{batch}")
        if self.files.exists(place):
            if self.files.getFileStatus(place).getLen():
                return False
            # Not from here: no marker is ever without content.
            self.files.delete(place, False)
        name = f"delta-{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.folder}/{name}")
        return self._claim(f"commits/{batch}", name)

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders whose sum is the totals, and the batches in them."""
        commits, shots = self._markers("commits"), self._markers("snapshots")
        folded, parts = set(), []
        if shots:
            name, *inside = shots[max(shots)].split("\n")
            folded, parts = set(inside), [name]
        return parts + [p for b, p in sorted(commits.items()) if b not in folded], sorted(commits)

    def _sum(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.KIND).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.KIND)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of what is in; keys that came to nothing are left out."""
        return self._sum(self._parts()[0]).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        parts, batches = self._parts()
        name = f"snapshot-{uuid.uuid4().hex}"
        self._sum(parts).write.parquet(f"{self.folder}/{name}")
        self._claim(f"snapshots/{len(batches):012d}", "\n".join([name, *batches]))


#: Runs of signs that decorate text; a revised text is without them.
DECORATION = r"[#*$%&|<>]{2,}"


def maintained(docs: DataFrame, tokenizers: dict[str, str], folder: str) -> DataFrame:
    """Totals after four batches over ``docs``: all rows inserted, texts with decorations
    revised, copies of an earlier text deleted, and the second batch sent once more.  ``loaded_docs`` and
    ``loaded_tokens`` are the totals after the first batch: the counts of the table as it is.

    Null and empty texts count as documents without tokens; null sources and languages are keys
    of their own.  Repeated rows count each, and all but one go as copies if their text isn't null.  Rows
    without doc_id are of unknown order: their texts are never deleted as copies.  Only doc_id, text, lang and source are read.
    """
    text = F.col("text").cast("string")
    plain = F.regexp_replace(text, DECORATION, "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.select("doc_id", "source", "lang", F.sha2("text", 256).alias("key"), "text", F.when(text.rlike(DECORATION), plain).alias("plain"))
    versions = list(tokenizers.items())
    paths = [path for _, path in versions]
    rows = rows.withColumn("n", token_counts(F.col("text"), paths)).withColumn("r", token_counts(F.col("plain"), paths))
    wide = F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col("n")[i].alias("n"), F.when(F.col("plain").isNotNull(), F.col("r")[i]).alias("r")) for i, (name, _) in enumerate(versions)))
    counted = written(rows.select("doc_id", "source", "lang", "key", F.monotonically_increasing_id().alias("row"), wide.alias("counts")), "counts")
    each = counted.select("doc_id", "source", "lang", F.inline("counts"))
    changed = each.where("r IS NOT NULL")
    first = counted.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    copies = counted.join(first, "key").where(F.struct("doc_id", "row") != F.col("first")).select("doc_id", "source", "lang", F.inline("counts"))

    rollup = Rollup(docs.sparkSession, folder)
    revised = changed.select("doc_id", *KEYS, F.col("r").alias("n_tokens"), F.col("source").alias("was_source"), F.col("lang").alias("was_lang"), F.col("n").alias("was_tokens"))
    rollup.commit("1-load", inserts(each.withColumnRenamed("n", "n_tokens")))
    loaded = rollup.totals()
    rollup.commit("2-revise", revised)
    rollup.commit("3-copies", deletes(copies.withColumn("n_tokens", F.coalesce("r", "n"))))
    rollup.commit("2-revise", revised)
    rollup.compact()
    none = F.lit(0).cast("long")
    both = rollup.totals().select(*KEYS, *SUMS, none.alias("loaded_docs"), none.alias("loaded_tokens")).union(loaded.select(*KEYS, none, none, *SUMS))
    return both.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in (*SUMS, "loaded_docs", "loaded_tokens")))


def op1_token_counts(spark, sf_dir):
    return maintained(documents(spark, sf_dir), TOKENIZERS, f"{shared_folder(spark)}/llm/rollup-{uuid.uuid4().hex}")


QUERIES = {"op1_token_counts": op1_token_counts}
