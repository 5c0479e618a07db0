"""Lines that many documents share, found with levelled runs of line hashes; DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import documents, unused, written
from spanloom.session import shared_folder

#: Documents that a line must be found in, and code points that its key must have.
LEAST_DOCS, LEAST_CHARS = 10, 1
#: Batches that a whole table is added in, and runs of one level that are folded into the next.
BATCHES, FANOUT = 4, 2
#: A line in more than this share of all (document, line) pairs is spread over ``SALTS`` tasks; there are at most 1024 such lines.
HOT, SALTS = 1024, 64
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "h1 long, h2 long, n long"


def lowered(text: Column) -> Column:
    """A-Z as a-z; texts of ASCII alone take the faster way to the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def key_of(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def hashes(*values: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit("spanloom"), *values, F.lit(1)).alias("h2")]


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each line key is found."""
    keys = F.array_distinct(F.transform(F.split(lowered(text_of(docs)), "\n"), key_of))
    rows = docs.select(F.explode(keys).alias("line")).where(F.char_length("line") >= least_chars)
    return rows.select(*hashes(F.col("line"))).groupBy("h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """Sorted runs of line hashes with their document counts, in levels, in a shared folder.

    A batch's keys are merge-anti-joined with the keys that the runs have settled (found often
    enough already, which no later batch can change); the rest becomes a run of level 0.  When a level has
    ``fanout`` runs, they are folded into one sorted run of the next level, so that there are
    logarithmically many.  ``log`` names the live runs; a run that a lost job left behind is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.folder, self.least, self.fanout = spark, folder, least_docs, fanout
        self.log: list[tuple[int, str]] = []

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*(f"{self.folder}/{n}" for n in names))

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"run-{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("h1", "h2").write.parquet(f"{self.folder}/{name}")
        return level, name

    def counts(self) -> DataFrame:
        """Each key once, with what the runs say together; a settled key's count may be short of its later batches."""
        runs = self._read([name for _, name in self.log])
        return runs if len(self.log) < 2 else runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.least)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``keys(h1, h2, n)``, each key once."""
        if self.log:
            keys = keys.join(self.settled().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.log.append(self._write(keys, 0))
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(full := [r for r in self.log if r[0] == level]) >= self.fanout:
            folded = self._read([name for _, name in full]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
            merged = self._write(folded, level + 1)
            self.log = [r for r in self.log if r[0] != level] + [merged]
            level += 1


def frequent(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, n) of all line keys found in ``least_docs`` rows, each row in one of ``batches`` by its id's hash."""
    index = LineRuns(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/llm/lines-{uuid.uuid4().hex}", least_docs)
    batch = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(batches))
    for b in range(batches):
        index.add(counted(docs.select("doc_id", "text").where(batch == b).select("text"), least_chars))
    return written(index.settled(), "frequent-lines")


def dropped(docs: DataFrame, often: DataFrame) -> DataFrame:
    """(k1, k2, gone): line numbers to drop for each (doc_id, text), by hash, that has any.

    Only hashes of lines are shuffled.  The at most ``HOT`` keys with over a ``HOT``-th of all counts are broadcast
    and their rows spread over ``SALTS`` tasks.
    """
    all_ = often.agg(F.sum("n")).head()[0] or 0
    hot = often.where(F.col("n") * HOT > all_).select("h1", "h2", F.lit(True).alias("hot"))
    lines = F.transform(F.split(lowered(text_of(docs)), "\n"), key_of)
    k1, k2 = (h.alias(k) for h, k in zip(hashes(F.col("doc_id").cast("string"), text_of(docs)), ("k1", "k2")))
    rows = docs.select(k1, k2, F.posexplode(lines).alias("at", "line")).where(F.char_length("line") > 0).select("k1", "k2", "at", *hashes(F.col("line")))
    rows = rows.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("k1"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("n") * HOT > all_, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hits = rows.join(often.select("h1", "h2", F.explode(salts).alias("salt")), ["h1", "h2", "salt"])
    return hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))


def deduplicated(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, into: str = "lines") -> DataFrame:
    """All rows and columns of ``docs`` with the kept text in ``text`` and a struct (n_lines, n_dropped) in ``into``.

    A line's key is the line without blanks at its ends and with A-Z as a-z.  Keys of ``least_chars`` code points
    in ``least_docs`` rows lose all their lines, exact up to 128-bit hashes.  A null or empty text is one
    empty line, and both come out empty; so does a text that loses all lines.  Repeated rows, and rows without doc_id, are documents
    each.  A column of ``docs`` with the name of ``into`` is replaced.  An empty table gives an empty result.
    """
    if least_chars < 1:
        raise ValueError("least_chars must be 1 at least: empty lines have no key to share")
    gone = dropped(docs.select("doc_id", "text"), frequent(docs, least_docs, least_chars, batches))
    k1, k2, parts, out = (unused(docs, c) for c in ("k1", "k2", "parts", "gone"))
    gone = gone.toDF(k1, k2, out)
    keys = dict(zip((k1, k2), hashes(F.col("doc_id").cast("string"), text_of(docs))))
    # Lines cross the join as an array, so that none is split off again for each element read below.
    rows = docs.withColumns(keys | {parts: F.split(text_of(docs), "\n")}).drop("text").join(gone, [k1, k2], "left")
    n = F.size(parts)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), out)
    text = F.array_join(F.when(F.col(out).isNull(), F.col(parts)).otherwise(F.transform(kept, lambda i: F.get(F.col(parts), i))), "\n")
    left = F.when(F.col(out).isNull(), 0).otherwise(F.size(out))
    rows = rows.withColumns({"text": text, into: F.struct(n.cast("long").alias("n_lines"), left.cast("long").alias("n_dropped"))})
    return rows.select(*docs.columns, *([] if into in docs.columns else [into]))


def op13_line_dedup(spark, sf_dir):
    rows = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op13_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
judged AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k)),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t
  FROM judged GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM docs JOIN kept USING (r)
""",
}
QUERIES = {"op13_line_dedup": op13_line_dedup}
