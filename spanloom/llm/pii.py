"""Personal data by pattern, and terms that give it away by co-occurrence; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanloom.llm.common import documents, unused, written

#: Base kinds in their order, then those the method adds.
KINDS = ("email", "ip", "card", "phone", "term", "revealing")
#: The base patterns.  No repetition gives back what it took, as nothing that follows could use it; a match
#: begins at the start of its run of characters or where the last match ended, the only places that can be leftmost.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "revealing": ""}
#: Characters on either side of an entity whose words count as seen with it.
NEAR = 80
#: Different contexts in which a term and an entity must meet.
SUPPORT = 3
#: Share of an entity's information that a term must give to be generalised, and to be removed.
GENERALISE, REMOVE = 0.9, 0.97
#: Cells of the filter that spares other words the shuffle: the broadcast has so many rows at most.
CELLS = 1 << 16
NOT_LETTERS = r"[^\p{L}]+"


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def valid(kind: Column, found: Column) -> Column:
    """Whether a match of a kind's pattern passes its further rule."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)

    def place(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + place(i)) % 10 == 0
    return (
        F.when(kind == KINDS.index("ip"), found.rlike(rf"^{PART}(\.{PART}){{3}}$"))
        .when(kind == KINDS.index("card"), F.when((n >= 14) & (n <= 19), luhn).otherwise(False))
        .when(kind == KINDS.index("phone"), (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def base_matches(docs: DataFrame) -> DataFrame:
    """The valid matches of each different text: key, kind, start, end, found, before, after.

    Lengths between matches add up to their places: one running sum per text and kind, over rows
    that hold the matches and what is near them, not the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = {k: F.when(F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else F.lit(True), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p in PATTERNS.items()}
    hits = docs.select(text.alias("text")).select("text", *(f.alias(k) for k, f in found.items())).where(" OR ".join(f"size({k}) > 0" for k in PATTERNS))

    def listed(kind):
        parts = F.split("text", PATTERNS[kind], -1)
        gaps = F.transform(parts, lambda x: F.struct(F.length(x).alias("gap"), F.right(x, F.lit(NEAR)).alias("before"), F.left(x, F.lit(NEAR)).alias("after")))
        rows = F.transform(
            F.arrays_zip(F.col(kind).alias("found"), F.slice(gaps, F.lit(1), F.size(kind)).alias("left"), F.slice(gaps, F.lit(2), F.size(kind)).alias("right")),
            lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["found"].alias("found"), x["left"]["gap"].alias("gap"), x["left"]["before"].alias("before"), x["right"]["after"].alias("after")),
        )
        return F.when(F.size(kind) > 0, rows).otherwise(F.lit(None).cast(ROWS))

    rows = hits.select(text_key(F.col("text")).alias("key"), *(listed(k).alias(k) for k in PATTERNS)).dropDuplicates(["key"])
    rows = rows.select("key", F.inline(F.flatten(F.array_compact(F.array(*PATTERNS)))))
    so_far = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(so_far)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))
    return placed.where(valid(F.col("kind"), F.col("found"))).select("key", "kind", "start", "end", "found", "before", "after")


ROWS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType(), False), T.StructField("i", T.IntegerType(), False), T.StructField("found", T.StringType()), T.StructField("gap", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def terms_near(matches: DataFrame) -> DataFrame:
    """entity, term, n_both, n_entity, n_least: in how many different texts an entity meets a term,
    and occurs, and in how many texts the term is seen near any entity.

    An entity is a kind and a value.  An entity, and its meeting with a term, need ``SUPPORT`` different
    contexts: what is around them in copies of a document counts once.
    """
    whole = F.concat(F.when(F.length("before") < NEAR, F.col("before")).otherwise(F.regexp_replace("before", r"^\p{L}*", "")), F.lit(" "), F.when(F.length("after") < NEAR, F.col("after")).otherwise(F.regexp_replace("after", r"\p{L}*$", "")))
    value = F.when(F.col("kind") == KINDS.index("email"), F.lower("found")).when(F.col("kind") == KINDS.index("ip"), F.col("found")).otherwise(F.regexp_replace("found", "[^0-9]", ""))
    seen = matches.select("key", F.xxhash64("kind", value).alias("entity"), F.lower(whole).alias("context"))
    words = F.explode(F.array_distinct(F.split("context", NOT_LETTERS))).alias("term")
    least = seen.select("key", words).where("length(term) >= 3").distinct().groupBy("term").agg(F.count("*").alias("n_least"))
    spot = F.xxhash64("context").alias("spot")
    counts = [F.count_distinct("key").alias("n"), F.count_distinct("spot").alias("n_spots")]
    enough = F.col("n_spots") >= SUPPORT
    often = seen.select("entity", "key", spot).groupBy("entity").agg(*counts).where(enough).select("entity", F.col("n").alias("n_entity"))
    both = seen.select("entity", "key", spot, words).where("length(term) >= 3").groupBy("entity", "term").agg(*counts).where(enough).select("entity", "term", F.col("n").alias("n_both"))
    return both.join(often, "entity").join(least, "term")


def given(total: Column, n_term: Column) -> Column:
    """Share of an entity's information that a term gives, if ``n_term`` texts have it."""
    return F.log2(total * F.col("n_both") / (F.greatest(n_term, "n_both") * F.col("n_entity"))) / F.greatest(F.log2(total / F.col("n_entity")), F.lit(1e-9))


def holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term: each text's different words that are in ``terms``; one row per row of ``docs``.

    Words pass a filter of hash cells, ``CELLS`` rows at most at any number of terms, before they are joined.
    """
    cell = F.pmod(F.xxhash64("term"), F.lit(CELLS)).alias("cell")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(text_key(text).alias("key"), F.explode(F.array_distinct(F.split(F.lower(text), NOT_LETTERS))).alias("term"))
    likely = words.withColumn("cell", cell).join(F.broadcast(terms.select(cell).distinct()), "cell", "left_semi")
    return likely.select("key", "term").join(terms.select("term").distinct(), "term", "left_semi")


def revealing_terms(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """term, kind: terms that reveal an entity, by the share of its information they give.

    With N different texts, and all n counting different texts, information(e) = log2(N / n(e)), and a term gives log2(N * n(t, e) / (n(t) * n(e))) of
    it: all, if every text with the term has the entity.
    """
    total = F.lit(float(docs.select(text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key")).distinct().count()))
    # A term near entities in too many texts already can't reach the threshold, and need not be counted.
    near = written(terms_near(matches).where(given(total, F.col("n_least")) >= GENERALISE), "terms")
    if near.isEmpty():
        return near.select("term", F.lit(0).alias("kind"))
    spread = holding(docs, near).select(F.xxhash64("key").alias("key"), "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    told = near.join(spread, "term").select("term", given(total, F.col("n_term")).alias("given")).groupBy("term").agg(F.max("given").alias("given"))
    kind = F.when(F.col("given") >= REMOVE, KINDS.index("revealing")).otherwise(KINDS.index("term"))
    return written(told.where(F.col("given") >= GENERALISE).select("term", kind.alias("kind")), "revealing")


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, kind, start, end of every occurrence of the terms, as whole words of letters in any case."""
    if terms.isEmpty():
        return terms.selectExpr("term AS key", "kind", "kind AS start", "kind AS end").where("false")
    keys = holding(docs, terms).select("key").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), text_key(text).alias("key")).join(keys, "key", "left_semi").dropDuplicates(["key"])
    pieces = texts.select("key", F.posexplode(F.split("text", r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})", -1)).alias("i", "piece"))
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.select("key", F.lower("piece").alias("term"), F.length("piece").alias("size"), F.sum(F.length("piece")).over(so_far).alias("end"))
    return placed.join(terms, "term").select("key", "kind", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def text_spans(docs: DataFrame) -> DataFrame:
    """key (SHA-256 of the text), spans: array of (start, kind, end), ordered; code points, end exclusive.

    Only texts with spans have a row, and equal texts one.  kind: a place in ``KINDS``.
    """
    matches = written(base_matches(docs), "matches")
    extra = term_places(docs, revealing_terms(docs, matches))
    every = matches.select("key", F.col("kind").cast("int"), F.col("start").cast("int"), F.col("end").cast("int")).union(extra.select("key", "kind", "start", "end"))
    return every.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))


def spelled(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms: one row per input row.

    Null and empty texts have no spans; repeated rows have equal answers; rows without doc_id are
    answered too.  Only doc_id and text are read.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("key")).join(text_spans(docs), "key", "left").select("doc_id", F.coalesce("spans", none).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 4)

    def count(test):
        return F.size(F.filter("s", test)).cast("long")

    def of(kind):
        return lambda x: x["kind"] == kind

    counts = [count(of(i)).alias(f"n_{KINDS[i]}") for i in range(4)]
    return rows.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("s")).alias("spans"), count(lambda x: x["kind"] > 3).alias("n_terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span generalised to its kind, or removed; other columns as they were.

    Overlapping spans are replaced as one, by the label of the first.  Null texts stay null.
    """
    spans = text_spans(docs).select("key", F.explode("spans").alias("s")).select("key", "s.*")
    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    opens = spans.withColumn("opens", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    islands = opens.withColumn("island", F.sum("opens").over(Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    after = F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy("start")), F.lit(0))
    pieces = merged.select("key", F.struct("start", after.alias("from"), "end", "kind").alias("p"))
    key, cuts, text = unused(docs, "key"), unused(docs, "cuts"), F.col("text").cast("string")
    listed = pieces.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("p")).alias(cuts))
    labels = F.array(*(F.lit(LABELS[k]) for k in KINDS))
    parts = F.transform(cuts, lambda p: F.concat(F.substring(text, p["from"] + 1, p["start"] - p["from"]), labels[p["kind"]]))
    last = F.element_at(cuts, -1)["end"]
    new = F.when(F.col(cuts).isNull(), text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))))
    return docs.withColumn(key, text_key(F.coalesce(text, F.lit("")))).join(listed, key, "left").withColumn("text", new).select(docs.columns)


def op7_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op7_pii": op7_pii}
