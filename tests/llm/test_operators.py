"""Each operator on awkward rows against its plain version, and on empty tables."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chaining, decontam, graph, langid, minhash, pii, quality, rollup, sharding, suffixes
from spanloom.llm import words as W

from . import brute
from .conftest import CLASHES, KIND, awkward_rows, sentence


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


# --- words -------------------------------------------------------------------------------------
def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    texts = ["Ab  c\x0bd", "", "c", "x" * (W.BLOCK + 5) + " c Ab"]
    w = W.words(pa.array(texts))
    spelled = [[x.lower() for x in brute.WORD.findall(t)] for t in texts]
    assert np.diff(w.at).tolist() == [len(x) for x in spelled]
    flat = [x for t in spelled for x in t]
    groups = defaultdict(set)
    for x, h in zip(flat, w.hash.tolist()):
        groups[x].add(h)
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


# --- op5 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, k):
    rows = awkward_rows()
    want = brute.near_duplicates([(r[0], r[1]) for r in rows], k)
    got = minhash.near_duplicates(docs, shingle=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_copies_of_many_grades(spark):
    """Copies whose likeness straddles the threshold: links with the center alone would not do."""
    rng = random.Random(7)
    base, rows = sentence(rng, 60).split(), []
    for i in range(220):
        text = list(base)
        for j in rng.sample(range(60), rng.randrange(0, 9)):
            text[j] = f"new{rng.randrange(4)}"
        rows.append((i, " ".join(text), "en", "s", 0))
    want = brute.near_duplicates([r[:2] for r in rows], 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows), shingle=2).collect()}
    assert got == {d: c for d, (_, c) in want.items()} and 1 < len(set(got.values())) < 200


def test_one_of_each_group_stays_as_it_was(spark, docs, empty):
    out = minhash.without_near_duplicates(docs)
    assert out.columns == docs.columns
    named = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
    want = brute.near_duplicates([r[:2] for r in awkward_rows()], 5)
    assert Counter(named) == Counter({d for d, (_, c) in want.items() if c == d})
    assert minhash.near_duplicates(empty).count() == 0 and minhash.without_near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (8, 9), (20, 11), (11, 30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 11, 20: 11, 30: 11}


# --- op4 ---------------------------------------------------------------------------------------
def test_repeats_are_removed(spark, docs):
    rows = awkward_rows()
    want = Counter((r[0], *w) for r, w in zip(rows, brute.without_repeats([r[1] for r in rows])))
    got = suffixes.without_repeats(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want and sum(k[2] for k in want) > 1000


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(8)
    long = sentence(rng, 700)
    texts = [long, "short", None, long[:3000], long[100:350] + " tail", ""]
    rows = [(d, t, None, None, None) for d in (4, None) for t in texts]
    want = Counter((r[0], *w) for r, w in zip(rows, brute.without_repeats([r[1] for r in rows])))
    got = suffixes.without_repeats(table(spark, rows)).drop("kept")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_repeats_at_all_offsets(spark, monkeypatch):
    """Passages around the length, inside one text and across; buckets so small that runs span several."""
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 40)
    monkeypatch.setattr(suffixes, "SMALL", 8)
    rng = random.Random(3)
    letters = "abcdefghij é"
    passage = "".join(rng.choice(letters) for _ in range(500))
    rows = []
    for i in range(60):
        a = rng.randrange(0, 250)
        n = rng.choice([150, 190, 199, 200, 201, 215, 240])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) + passage[a : a + n] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        if i % 9 == 0:
            text += passage[a : a + n]
        rows.append((i, text, None, None, None))
    rows += [(100 + i, "ab" * 170 + "c" * i, None, None, None) for i in range(5)]
    want = {r[0]: w for r, w in zip(rows, brute.without_repeats([r[1] for r in rows]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.without_repeats(table(spark, rows)).drop("kept").collect()}
    assert got == want


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(3500)), None, None, None) for i in range(3)]
    rows.append((9, rows[0][1][500:2600] + rows[1][1][100:400], None, None, None))
    import pyarrow as pa

    texts = pa.array([rows[3][1], rows[0][1]])
    for t in texts:
        data, at = suffixes.raw(pa.array([t.as_py()]))
        parts = [suffixes.sampled(data[a : a + 700 + 199], np.array([0, len(data[a : a + 899])]), 200) for a in range(0, len(data) - 199, 700)]
        assert sum(int(p["n"].sum()) for p in parts) == len(data) - 199 == int(suffixes.sampled(data, at, 200)["n"].sum())


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 4)
    rng = np.random.default_rng(1)
    cols = [rng.integers(-3, 3, 500), rng.integers(-2, 2, 500), rng.permutation(500)]
    assert suffixes.multikey_quicksort(cols).tolist() == np.lexsort(cols[::-1]).tolist()
    assert suffixes.without_repeats  # noqa: B018


def test_repeats_of_nothing(empty):
    assert suffixes.without_repeats(empty).count() == 0


# --- op9 ---------------------------------------------------------------------------------------
def test_quality_base_and_columns(docs, empty):
    into = "verdict_"
    got = quality.judged(docs, into=into)
    assert got.columns == [*docs.columns, into]
    for r in got.collect():
        counts, failed = brute.quality_base(r["text"])
        v = r[into]
        assert (v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"]) == counts
        assert v["base_failed"] == failed and not (failed and v["kept"])
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.judged(empty).count() == 0


def test_em_finds_the_accuracies():
    rng = random.Random(2)
    accuracy, patterns, truth = [0.95, 0.9, 0.8, 0.6], Counter(), {}
    for _ in range(20000):
        y = 1 if rng.random() < 0.7 else -1
        p = tuple((y if rng.random() < a else -y) if rng.random() < 0.8 else 0 for a in accuracy)
        patterns[p] += 1
        truth.setdefault(p, Counter())[y] += 1
    model = quality.fit(sorted(patterns.items()))
    assert abs(model["prior"] - 0.7) < 0.03
    good = np.array(model["answer"])[1]
    assert np.allclose(good[:, 2] / (good[:, 2] + good[:, 0]), accuracy, atol=0.04)


def test_quality_on_given_labels(spark, given):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    got = {r["doc_id"]: r["verdict"]["kept"] for r in quality.judged(spark.createDataFrame(given, KIND)).collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(got[d] for d in good) >= 0.95 * len(good) and sum(got[d] for d in bad) <= 0.1 * len(bad)


# --- op6 ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    rng = random.Random(5)
    signs = "  \n\t   \x1c\x85'''strevlmdSTaéßñ中文٣12½.,!<|>_-😀\r\x0b"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["'ll", "'l", "'", "x're", "'s'", " 's", "\n's", "it's 'tis ''s", "a" * 3000, "é" * 700, " " * 500, "<|endoftext|>", "'" * 300 + "s", ""]
    tool = bpe.tokenizer(bpe.RANKS)
    ids = tool.encode(texts)
    assert ids == [reference.encode_ordinary(t) for t in texts]
    assert all(tool.decode(i) == t.encode() and (not i or tool.ends(i)[-1] == len(t.encode())) for i, t in zip(ids, texts))


def test_scan_is_the_composition_in_order():
    rng = np.random.default_rng(0)
    values, compose, _ = bpe.monoid()
    f = rng.integers(0, len(compose), 5000).astype(np.uint16)
    state, want = np.arange(8), []
    for x in f:
        state = values[x][state]
        want.append(state)
    assert (values[bpe.scan(f, block=16)] == np.array(want)).all()


def test_tokenized_rows(spark, docs, empty, reference):
    out = bpe.tokenized(docs).withColumn("back", bpe.decoded(F.col("ids")))
    rest = [c for c in docs.columns if c != "text"]
    assert [c for c in out.columns if c in rest] == rest
    got = Counter((r["doc_id"], bytes(r["back"]), tuple(r["ids"]), r["n_tokens"]) for r in out.collect())
    assert got == Counter((r[0], (r[1] or "").encode(), tuple(x := reference.encode_ordinary(r[1] or "")), len(x)) for r in awkward_rows())
    assert bpe.tokenized(empty).count() == 0


# --- op10 --------------------------------------------------------------------------------------
def test_language_by_compression(spark, given):
    rows = spark.createDataFrame(given, KIND)
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn(rows.where(~out))
    got = rows.where(out).select("lang", langid.language(F.col("text"), model).alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang"] for r in got) >= 0.93 * len(got)
    sure = [r for r in got if not r["p"]["rejected"]]
    assert sum(r["lang"] == r["p"]["lang"] for r in sure) >= 0.97 * len(sure)


def test_language_of_awkward_rows(docs, empty):
    model = langid.learn(docs)
    assert set(model) == {"en", "de"} and all(len(v) <= langid.DICTIONARY_BYTES for v in model.values())
    for r in docs.select("text", langid.language(F.col("text"), model).alias("p")).collect():
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang"] == "und") == blank and 0 <= r["p"]["score"] <= 1 and (not blank or r["p"]["rejected"])
    assert langid.learn(empty) == {}
    assert all(r["p"]["lang"] == "und" for r in docs.select(langid.language(F.col("text"), {}).alias("p")).collect())


def test_every_language_is_learned(spark):
    # More languages than have whole dictionaries, and few texts that are longer than a dictionary each.
    words = ["".join(chr(97 + (i * 7 + j * 5) % 26) for j in range(6)) for i in range(300)]
    rows = [(i, " ".join(words[(i + j) % 300] for j in range(40)), f"l{i:03}") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=1000, total=30_000)
    assert set(model) == {f"l{i:03}" for i in range(300)} and all(len(v) <= 100 for v in model.values())
    long = [(i, ("1 " if i % 4 else "") + f"{words[i // 4]} " * 400, f"l{i // 4:03}") for i in range(1200)]
    assert len(langid.learn(spark.createDataFrame(long, "doc_id long, text string, lang string"), size=500)) == 300
    bare = [(None, "12 34", "none"), (None, "wort", "de"), (None, "wort", "de")]
    assert set(langid.learn(spark.createDataFrame(bare, "doc_id long, text string, lang string"))) == {"de"}


# --- op8 ---------------------------------------------------------------------------------------
def test_leaks(spark, docs, empty):
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate((14, 16, 20, 40, 60))] + [(7, None), (None, "no id"), (8, ""), (9, "too short")]
    planted = []
    for d in range(1000, 1100):
        item = rng.choice(items[:5])[1].split()
        if d % 3 == 0:
            item[rng.randrange(len(item))] = "other"
        if d % 2:
            item[: rng.randrange(0, 6)] = []
        planted.append((d, " ".join([sentence(rng, rng.randrange(0, 30)), *item, sentence(rng, rng.randrange(0, 30))]), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    every = docs.unionByName(table(spark, planted), allowMissingColumns=True)
    want = brute.leaks([(r[0], r[1]) for r in awkward_rows() + planted if r[0] is not None], [x for x in items[:5]], decontam.LENGTH, decontam.DIFFER)
    rows = decontam.contaminated(every, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) > 60
    kept = decontam.clean_documents(every, bench)
    assert kept.columns == every.columns and kept.count() == every.count() - len({d for d, _ in got})
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(every, bench.limit(0)).count() == 0


def test_masks_cover_every_allowed_change():
    from itertools import combinations

    for n in range(decontam.SPAN, decontam.LENGTH + 1):
        placed = [{i + j for j, bit in enumerate(m) if bit == "1"} for m in decontam.MASKS for i in range(n - len(m) + 1)]
        assert all(any(not p & set(changed) for p in placed) for changed in combinations(range(n), int(n * decontam.DIFFER)))


@pytest.mark.parametrize("n", [12, 16, 20, 24])
def test_leaks_with_a_quarter_changed(spark, n):
    rng = random.Random(n)
    items = [(i, sentence(rng, n)) for i in range(300)]
    rows = []
    for i, text in items:
        own = text.split()
        for j in rng.sample(range(n), n // 4):
            own[j] = "changed"
        rows.append((i, " ".join([sentence(rng, 20), *own, sentence(rng, 20)]), None, None, None))
    want = brute.leaks([(r[0], r[1]) for r in rows], items, decontam.LENGTH, decontam.DIFFER)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 200


def test_leaks_of_short_items_and_of_all_texts_of_an_item(spark):
    rng = random.Random(2)
    items = [(n, sentence(rng, n)) for n in range(1, 16)] + [(50, sentence(rng, 9)), (50, sentence(rng, 30)), (50, sentence(rng, 20))]
    rows = []
    for i, text in items * 30:
        own = text.split()
        for j in rng.sample(range(len(own)), rng.randrange(len(own) // 4 + 1)):
            own[j] = "changed"
        rows.append((len(rows), " ".join([sentence(rng, 20), *own, sentence(rng, 20)]), None, None, None))
    want = {(d, i) for one in items for d, i in brute.leaks([(r[0], r[1]) for r in rows], [one], decontam.LENGTH, decontam.DIFFER)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and {i for _, i in want} == {i for i, _ in items}


def test_verification_ends_at_equal_words():
    a = np.array([9, 9, 1, 2, 3, 4, 5, 6, 9, 9])
    assert decontam.verified(a, np.array([1, 2, 3, 7, 5, 6]), 2, 4, 0.25) == (2, 8, 5)
    assert decontam.verified(a, np.array([1, 8, 8, 8, 5, 6]), 2, 4, 0.25) is None


# --- op7 ---------------------------------------------------------------------------------------
def test_pii_base(spark, docs, empty):
    rng = random.Random(3)
    bits = ["a@b.com", "x", "@", ".", " ", "_", "1.2.3.4", "300.1.1.1", "+1 (555) 123-4567", "4041894974608795", "4111 1111 1111 1111", "é😀", "-", "256.0.0.01", "000.00.0.255", "+"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(15))), None, None, None) for i in range(800)]
    rows += [(900, "a" * 50000, None, None, None), (901, "1 " * 9000, None, None, None), (902, ".a" * 9000 + "@b" + ".c" * 9000, None, None, None)]
    every = docs.unionByName(table(spark, rows), allowMissingColumns=True)
    got = pii.personal_data(every.where("doc_id IS NOT NULL"))
    want = Counter((r[0], *(b := brute.pii_base(r[1]))[0], b[1]) for r in rows + [r for r in awkward_rows() if r[0] is not None])
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert pii.personal_data(docs.where("doc_id IS NULL")).count() == 2 and pii.personal_data(empty).count() == 0


def test_revealing_terms_are_found_and_replaced(spark):
    # 48 documents, 6 with the entity: "quuxly", only there, gives all of its 3 bits, "zorblax", in a seventh, 2.78.
    rows = [(i, f"word{'abcdef'[i]} and Zorblax of joe@corp.example Quuxly here{'qwerty'[i]}", None, None, None) for i in range(6)]
    rows += [(10 + i, f"and of plain words{i} here", None, None, None) for i in range(40)] + [(90, "Again zorblax, again.", None, None, None), (91, None, None, None, None)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[90]["spans"] == "term:6:13" and got[0]["n_email"] == 1 and got[0]["spans"] == "term:10:17,email:21:37,revealing:38:44"
    assert all(got[10 + i]["spans"] == "" for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[90] == "Again [TERM], again." and clean[0] == "worda and [TERM] of [EMAIL]  hereq" and clean[91] is None and clean[12] == rows[8][1]


def test_copies_change_no_revealing_term(spark):
    rows = [(i, f"word{'abcdef'[i]} and Quuxly of joe@corp.example here{'qwerty'[i]}", None, None, None) for i in range(6)]
    rows += [(10 + i, f"and of plain words{i} here", None, None, None) for i in range(200)]
    copies = [(1000 + i, *rows[0][1:]) for i in range(400)]
    plain = [(2000 + i, *rows[20][1:]) for i in range(400)]
    spans = [{r["doc_id"]: r["spans"] for r in pii.personal_data(table(spark, x)).collect()} for x in (rows, rows + copies, rows + plain)]
    assert "revealing:10:16" in spans[0][0]
    assert all({d: x[d] for d in spans[0]} == spans[0] for x in spans[1:]) and {spans[1][1000 + i] for i in range(400)} == {spans[0][0]}


def test_overlapping_spans_are_replaced_once(docs, spark):
    text = "é +30569309025904 x a@b.co 1.2.3.4."  # the digits of the phone number pass as a card's too
    out = pii.sanitised(table(spark, [(1, text, None, None, None), (2, "", None, None, None)])).orderBy("doc_id").collect()
    assert out[0]["text"] == "é [PHONE] x [EMAIL] [IP]." and out[1]["text"] == ""
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == docs.count()


def test_pii_plan_has_no_python(docs):
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- op3 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("blocks", [8192, 40])
def test_shards(spark, docs, blocks, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", blocks)
    rng = random.Random(6)
    more = [(2000 + i, "x" * int(rng.paretovariate(1.2) * 20) + str(i % 300), None, None, None) for i in range(500)]
    every = docs.unionByName(table(spark, more), allowMissingColumns=True)
    rows = sharding.sharded(every, 7).collect()
    source = awkward_rows() + more
    assert len(rows) == len(source)
    groups = defaultdict(list)
    for r in source:
        groups[r[1]].append(-1 if r[0] is None else r[0])
    size = {t: len(v) * (len((t or "").encode()) + 8) for t, v in groups.items()}
    ordered = sorted(groups, key=lambda t: (min(groups[t]),))
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(loads.values()) == brute.smallest_capacity([size[t] for t in ordered], 7)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r[0]: r[1] for r in source if r[0] is not None}
    where = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["text_crc32"] == brute.crc(text[r["doc_id"]]) and r["law"] == "bytes"
            where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_no_shards_of_nothing(empty):
    assert sharding.sharded(empty).count() == 0


# --- op2 ---------------------------------------------------------------------------------------
def test_chains_have_the_best_score():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 12)
        x, y = np.array([rng.randrange(60) for _ in range(n)]), np.array([rng.randrange(60) for _ in range(n)])
        best = [0.0] * n
        for i in sorted(range(n), key=lambda i: (x[i], -y[i])):
            best[i] = 6 + max([0.0] + [best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in range(n) if x[j] < x[i] and y[j] < y[i]])
        got = chaining.chains(x, y, 6, 0.1)
        assert sorted(int(i) for c in got for i in c) == list(range(n))
        c = got[0]
        score = 6 * len(c) - 0.1 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert abs(score - max(best)) < 1e-9 and all(np.diff(x[c]) > 0) and all(np.diff(y[c]) > 0)


def test_edits():
    a = np.array([1, 2, 3, 4, 5])
    assert [chaining.edits(a, np.array(b)) for b in ([1, 2, 3, 4, 5], [1, 3, 4, 5], [1, 2, 9, 3, 4, 5], [], [9, 8, 7, 6, 0])] == [0, 1, 1, 5, 5]


def test_fuzzy_passages(spark, docs, empty):
    rng = random.Random(11)
    passage = sentence(rng, 70).split()
    rows, want = [], {}
    for i in range(40):
        own = list(passage)
        if i % 4 == 1:
            own[35] = "swapped"
        if i % 4 == 2:
            own[30:30] = ["put", "in"]
        if i % 4 == 3:
            del own[40]
        lead = sentence(rng, rng.randrange(0, 80)).split()
        rows.append((3000 + i, " ".join([*lead, *own, *sentence(rng, 30).split()]), None, None, None))
        want[3000 + i] = (len(lead), len(lead) + len(own))
    rows += [(4000 + i, sentence(rng, 300), None, None, None) for i in range(20)]
    got = chaining.passages(docs.unionByName(table(spark, rows), allowMissingColumns=True)).collect()
    found = {r["doc_id"]: r for r in got if r["match_doc_id"] == 3000}
    assert set(found) == set(want) - {3000}
    for d, r in found.items():
        assert abs(r["start"] - want[d][0]) <= 3 and abs(r["end"] - want[d][1]) <= 3 and r["n_edits"] <= 4 and r["identity"] > 0.93
    assert not {r["doc_id"] for r in got} & set(range(4000, 4020))
    assert chaining.passages(empty).count() == 0


@pytest.mark.parametrize(("size", "gap"), [(100, 60), (100, 100), (50, 30), (60, 60)])
def test_passages_round_an_unrelated_body(spark, size, gap):
    rng = random.Random(size + gap)
    one, two = sentence(rng, size), sentence(rng, size)
    texts = [" ".join([sentence(rng, 20), one, sentence(rng, gap), two, sentence(rng, 20)]) for _ in range(2)]
    got = chaining.passages(table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)])).collect()
    assert sorted((r["start"], r["end"], r["match_start"], r["n_edits"]) for r in got) == [(20, 20 + size, 20, 0), (20 + size + gap, 20 + 2 * size + gap, 20 + size + gap, 0)]


@pytest.mark.parametrize("share", [0.04, 0.1, 0.2])
def test_recall_of_short_fuzzy_passages(spark, share):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        passage = sentence(rng, 50).split()
        other = list(passage)
        for j in rng.sample(range(1, 49), int(50 * share)):
            other[j] = "changed"
        rows += [(d, " ".join([sentence(rng, 30), *p, sentence(rng, 30)]), None, None, None) for d, p in ((2 * i, passage), (2 * i + 1, other))]
    got = chaining.passages(table(spark, rows)).collect()
    found = {r["doc_id"] for r in got if r["match_doc_id"] == r["doc_id"] - 1 and r["start"] <= 30 and r["end"] >= 80}
    print(f"{share}: {len(found)} of 300")
    assert len(found) == 300


@pytest.mark.parametrize("size", [6, 10, 25])
def test_passage_of_lines_that_all_occur_earlier_elsewhere(spark, size):
    rng = random.Random(size)
    lines = [sentence(rng, size) for _ in range(60 // size + 1)]
    n = size * len(lines)
    texts = [" ".join([sentence(rng, 20), x, sentence(rng, 20)]) for x in lines] + [" ".join([sentence(rng, 20), *lines, sentence(rng, 20)]) for _ in range(2)]
    got = chaining.passages(table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)])).collect()
    assert [tuple(r)[:7] for r in got] == [(len(texts) - 1, len(texts) - 2, 20, 20 + n, 20, 20 + n, 0)]


def test_pieces_are_the_longest_that_are_equal_enough():
    rng = random.Random(3)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(1, 60))])
        fits = [j - i for i in range(len(same)) for j in range(i + 10, len(same) + 1) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9]
        every = np.ones(len(same), bool)
        got = chaining.pieces(every, every, same, 10, 0.8)
        assert bool(got) == bool(fits)
        assert all(j - i >= 10 and same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9 for i, j in got)
        assert all(a[1] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:]))

def test_seeds_are_dealt_in_bytes_and_meet_their_first_occurrence(spark):
    rng = np.random.default_rng(5)
    for kind in (np.uint64, np.int64, np.int32):
        values = rng.integers(0, 1 << 31, 100).astype(kind)
        assert (chaining.plain(chaining.planes(values), kind) == values).all()
    texts = ["a b c d e", "x a b c d", "a b c d a b c d", "p q r s p q r s"]
    docs = table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)]).select("doc_id", "text")
    dealt = chaining.seeds(docs, 4, 1)
    assert dealt.columns == ["bucket", "seeds", "docs", "words"]
    rows = chaining.met(dealt).collect()
    assert sorted((r.doc_id, r.other_id, r.x, r.y) for r in rows if r.doc_id is not None) == [(1, 0, 1, 0), (2, 0, 0, 0), (2, 0, 4, 0)]
    assert len({r.place for r in rows if r.place is not None}) == 2


def test_every_passage_shares_the_prints_that_are_asked_for():
    assert chaining.sure(4, 50, 0.8) == 7 and chaining.sure(8, 50, 0.8) == 1
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(50, 90))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        changed = rng.choice(np.arange(1, n - 1), n // 5, replace=False)
        b[changed] = rng.integers(1, 1 << 62, len(changed)).astype(np.uint64)
        assert np.isin(chaining.prints(a, 4), chaining.prints(b, 4)).sum() >= 7


@pytest.mark.parametrize("part", [3, 2048])
def test_all_occurrences_meet_as_the_edges_of_runs(spark, part):
    """Every equal 4 words of two documents lie in a run that is told by its ends, also of seeds that are cut into parts."""
    rng = random.Random(part)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))) for _ in range(12)]
    texts += ["k l m n o p"] * 9
    want = set()
    for a, s in enumerate(t.split() for t in texts):
        for b, o in enumerate(t.split() for t in texts[:a]):
            want |= {(a, b, x, y) for x in range(len(s) - 3) for y in range(len(o) - 3) if s[x : x + 4] == o[y : y + 4]}
    docs = table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)]).select("doc_id", "text")
    rows = chaining.every(chaining.seeds(docs, 4, 1, sides=True), part).collect()
    pairs = {}
    for r in rows:
        pairs.setdefault((r.doc_id, r.other_id), []).append((r.x, r.y, r.edge))
    got = set()
    for (a, b), cells in pairs.items():
        for _, x, y, size in zip(*chaining.runs(np.zeros(len(cells), int), *(np.array(c) for c in zip(*cells)), 4)):
            got |= {(a, b, int(x) + i, int(y) + i) for i in range(size - 3)}
    assert got == want and len(rows) == sum(map(len, pairs.values())) < len(want)


def test_edited_passage_of_phrases_that_all_occur_earlier_elsewhere(spark):
    """Each four words of both documents are first met in another one, and no six words are without an edit."""
    rng = random.Random(20)
    words = sentence(rng, 80).split()
    texts = [" ".join([*sentence(rng, 20).split(), *words[i : i + 6], *sentence(rng, 20).split()]) for i in range(0, 75)]
    edited = list(words)
    for i in range(5, 76, 6):
        edited[i] = "changed" + str(i)
    n = len(texts)
    texts += [" ".join([sentence(rng, 20), *x, sentence(rng, 20)]) for x in (words, edited)]
    got = chaining.passages(table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)])).collect()
    assert [tuple(r)[:7] for r in got] == [(n + 1, n, 20, 100, 20, 100, 12)]


def test_a_third_copy_is_linked_with_both_earlier_ones(spark):
    rng = random.Random(21)
    shared = sentence(rng, 60)
    texts = [" ".join([sentence(rng, 9), shared, sentence(rng, 9)]) for _ in range(3)]
    got = chaining.passages(table(spark, [(i, x, None, None, None) for i, x in enumerate(texts)])).collect()
    assert sorted((r.doc_id, r.match_doc_id, r.start, r.end, r.n_edits) for r in got) == [(1, 0, 9, 69, 0), (2, 0, 9, 69, 0), (2, 1, 9, 69, 0)]


def test_pairs_that_share_too_few_seeds_are_no_candidates():
    x = np.array([0, 20, 40, 60, 80, 94])
    assert not chaining.shares(x, np.full(6, 4), 4, 7, 95) and chaining.shares(x, np.array([4] * 5 + [5]), 4, 7, 95)
    assert not chaining.shares(x * 2, np.array([4] * 5 + [5]), 4, 7, 95) and chaining.shares(x[:1], np.array([10]), 4, 7, 95)


# --- op1 ---------------------------------------------------------------------------------------
def test_rollup_commits_once_and_compacts(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    counts = spark.createDataFrame([(1, "s0", "en", "v1", 5), (2, "s0", "en", "v1", 7), (3, None, None, "v1", 0)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    later = spark.createDataFrame([(1, "s0", "de", "v1", 6), (3, None, None, "v1", 0), (4, "s1", "en", "v2", 9)], counts.schema)
    assert r.commit("one", rollup.inserts(counts)) and not r.commit("one", rollup.inserts(counts))
    change = rollup.revisions(counts, later)
    assert change.count() == 3
    r.compact()
    assert r.commit("two", change) and not r.commit("two", change)
    rollup.signed(rollup.inserts(counts)).write.parquet(f"{tmp_path}/r/delta-unmarked")
    want = {("s0", "de", "v1", 1, 6), (None, None, "v1", 1, 0), ("s1", "en", "v2", 1, 9)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.commit("three", rollup.deletes(later)) and r.totals().count() == 0
    with pytest.raises(ValueError):
        r.commit("../x", change)


def test_a_crash_while_committing_loses_nothing(spark, tmp_path):
    """An empty marker and a draft that was never renamed are no commits; the batch can be sent again."""
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    counts = spark.createDataFrame([(1, "s0", "en", "v1", 5)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    for name in ("commits", "drafts"):
        (tmp_path / "r" / name).mkdir(parents=True)
    (tmp_path / "r/commits/b1").write_text("")
    (tmp_path / "r/drafts/half").write_text("delta-")
    assert r.totals().count() == 0
    assert r.commit("b1", rollup.inserts(counts)) and not r.commit("b1", rollup.inserts(counts))
    assert not r._claim("commits/b1", "delta-other")
    assert [tuple(x) for x in r.totals().collect()] == [("s0", "en", "v1", 1, 5)]


def test_token_totals(spark, docs, empty, tmp_path, reference):
    import re

    made = rollup.maintained(docs, {"v": bpe.RANKS}, f"file://{tmp_path}/t").collect()
    assert sum(r["loaded_docs"] for r in made) == len(awkward_rows()) and sum(r["loaded_tokens"] for r in made) == sum(len(reference.encode_ordinary(t[1] or "")) for t in awkward_rows())
    got = {tuple(r)[:3]: (r["n_docs"], r["n_tokens"]) for r in made}
    want, seen = defaultdict(lambda: [0, 0]), set()
    rows = awkward_rows()
    for d, text, lang, source, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if d is not None and text is not None:
            if text in seen:
                continue
            seen.add(text)
        total = want[(source, lang, "v")]
        total[0] += 1
        total[1] += len(reference.encode_ordinary(re.sub(rollup.DECORATION, "", text or "")))
    assert got == {k: tuple(v) for k, v in want.items()}
    assert rollup.maintained(empty, {"v": bpe.RANKS}, f"file://{tmp_path}/e").count() == 0


def test_clashing_names_are_in_the_table(docs):
    assert set(CLASHES) <= set(docs.columns)
