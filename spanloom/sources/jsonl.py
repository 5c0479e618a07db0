"""Line-oriented JSON logs with a position that survives re-reading."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.ordered import number, scan
from spanloom.functions.payload import computed, get, is_object

LAYOUT = r"/([^/]+)/([^/]+)/[^/]+$"
#: Rows of one part of a log; a longer log goes on in the next part, so no task writes more of it.
PART_ROWS = 65_536
#: Rows of a file that holds parts of many logs, on average.
FILE_ROWS = 32_768
SESSION = ["platform", "session_id"]
#: Begins the line that opens a part in a file; a random word that the folder's name tells follows it.
MARK = "\x1e"
#: Written in place of a missing platform or session.
UNNAMED = "__HIVE_DEFAULT_PARTITION__"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (platform, session_id, file, pos, line).

    ``pos`` is the start of the file split plus the row's index in its task.  A task reads
    at most one split size of bytes and a line has at least one, so ``pos`` rises with the
    line order inside a file and is unique there, however the file is split.
    Platform and session come from the ``…/<platform>/<session>/<file>`` layout.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"),
    )
    return raw.select(
        F.regexp_extract("file", LAYOUT, 1).alias("platform"), F.regexp_extract("file", LAYOUT, 2).alias("session_id"), "file", "file_size", "pos", "line"
    )


def write_logs(rows: DataFrame, path: str, order: str, *, part_rows: int = PART_ROWS, line_sep: str = "\n") -> None:
    """Write ``rows(platform, session_id, line)`` as logs in ``order``, which is unique inside a session.

    Logs are cut into parts of ``part_rows`` lines at most.  A file holds many parts one after another, so the number of files follows
    that of rows, not of sessions.  Before a part's first line stand a mark that occurs in no log, platform, session, number and bytes of the part.
    NULL lines are written as empty ones, and no rows make no log.
    """
    if "\n" in line_sep.removesuffix("\n"):
        raise ValueError("a line separator may have a newline at its end only")
    spark = rows.sparkSession
    token = uuid.uuid4().hex
    files = max(1, -(-rows.count() // FILE_ROWS))
    placed = number(rows.select("platform", "session_id", order, "line"), SESSION, order, "nth")
    part = [*SESSION, "part"]
    value = F.coalesce("line", F.lit(""))
    placed = placed.select(*[F.coalesce(c, F.lit(UNNAMED)).alias(c) for c in SESSION], "nth", F.expr(f"nth div {part_rows}").alias("part"), value.alias("value"))
    size = F.sum(F.octet_length("value") + len(line_sep.encode())).over(Window.partitionBy(*part))
    head = F.concat_ws("\t", F.lit(f"{MARK}{token}"), *[F.url_encode(c) for c in SESSION], "part", size, F.lit(""))
    if not line_sep.endswith("\n"):
        head = F.concat(F.lit("\n"), head)
    (
        placed.withColumn("head", head)
        .repartition(files, *part)
        .sortWithinPartitions(*part, "nth")
        .select(F.when(F.col("nth") == F.col("part") * part_rows, F.concat("head", "value")).otherwise(F.col("value")).alias("value"))
        .write.option("lineSep", line_sep)
        .text(f"{path}/parts-{token}")
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``write_logs``, like ``read_lines``; ``pos`` rises through the parts of a session, ``part`` tells them apart.

    Each part is a ``file`` of its own, with its own size; a line belongs to the last mark at or before it.
    """
    lines = read_lines(spark, f"{path}/parts-*").drop(*SESSION, "file_size")
    token = F.regexp_extract("file", "/parts-([0-9a-f]{32})/", 1)
    own = F.when(F.startswith("line", F.concat(F.lit(MARK), token)), F.split("line", "\t", 6))
    cells = own.isNotNull()
    head = F.when(cells, F.struct(F.url_decode(own[1]).alias("platform"), F.url_decode(own[2]).alias("session_id"), own[3].cast("bigint").alias("part"), own[4].cast("bigint").alias("file_size")))
    owned = scan(lines, ["file"], "pos", lasts={"__head": head}).where("__head is not null")
    return owned.select(
        "__head.platform",
        "__head.session_id",
        F.concat_ws("/", "file", F.url_encode("__head.platform"), F.concat(F.url_encode("__head.session_id"), F.lit("~"), F.col("__head.part").cast("string"))).alias("file"),
        "__head.file_size",
        (F.shiftleft("__head.part", 40) + F.col("pos")).alias("pos"),
        F.coalesce(own[5], "line").alias("line"),
        "__head.part",
    )


def complete_lines(lines: DataFrame) -> DataFrame:
    """Lines that end in a newline, with byte offset and length.

    Only the last line of a file can lack the newline, and then its end lies past the
    file size.
    """
    size = F.octet_length("line") + 1
    placed = scan(lines.withColumn("byte_length", size), ["file"], "pos", sums={"__end": size})
    return (
        placed.where("__end <= file_size")
        .withColumn("byte_offset", F.col("__end") - F.col("byte_length"))
        .drop("__end")
    )


def json_frames(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as VARIANT ``frame``; all others are left out."""
    return computed(lines, {"frame": F.try_parse_json(F.trim("line"))}).where(is_object(F.col("frame"))).drop("line")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines that hold no JSON object, for the error log."""
    return lines.where((F.trim("line") != "") & ~is_object(F.try_parse_json(F.trim("line"))))


def field(*keys: str, kind: str = "string") -> Column:
    return get(F.col("frame"), *keys, kind=kind)
