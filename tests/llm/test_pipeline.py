"""The pipeline on awkward and on given rows."""

import corpus_pipeline as P
import pytest

from spanloom.llm.common import written

from . import brute


def test_stages_are_in_order_and_keep_the_columns(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "some item of words that no document has at all in this order here and now")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "personal_data", "byte_bpe"]
    for table in (docs, empty):
        out = table
        for name, stage in P.STAGES:
            columns = out.columns
            out = written(stage(spark, out, str(tmp_path)), name)
            assert name == "byte_bpe" or out.columns == columns
        assert {"ids", "n_tokens", "ends"} <= set(out.columns)
    assert out.count() == 0


def test_run_on_the_smallest_tables(spark, given):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    text = {r[0]: r[1] for r in given}
    kept = [r["doc_id"] for r in rows]
    assert len(kept) == len(set(kept)) and 0.5 * len(text) < len(kept) < len(text)
    assert not any(brute.quality_base(text[d])[1] for d in kept)
    near = brute.near_duplicates([(d, text[d]) for d in kept], 5)
    assert all(c == d for d, (_, c) in near.items())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert not brute.leaks([(d, text[d]) for d in kept], items, 16, 0.25)


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_collinear_chaining", "op3_sharding", "op4_suffix_array_dedup", "op5_minhash_near_dedup", "op6_byte_bpe", "op7_pii", "op8_benchmark_decontamination", "op9_quality_rules", "op10_language_id", "pipeline"])
def test_queries_are_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
