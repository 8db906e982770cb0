"""The pipeline's stages, one after the other, against the operators' brute-force forms."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from counterfair.llm.common import staged
from tests.llm.test_text_operators import _classes

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF_DIR), name))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [{r["doc_id"]: r["text"] for r in t.select("doc_id", "text").collect()} for t in tables[:-1]]
    assert set(rows[1]) < set(rows[0]) and set(rows[2]) == set(rows[1])
    classes = _classes(list(rows[2].items()))
    assert set(rows[3]) == {i for i, (_, c) in classes.items() if i == c}
    assert rows[4] == rows[3] and tables[4].count() >= tables[3].count()
    assert tables[5].count() == tables[4].count() and tables[5].where("NOT decoded_ok").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_tables(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, SF_DIR).count() == 0
    assert stage(spark, odd, SF_DIR).count() > 0


def test_tokens_carry_the_order_of_the_mix_over_several_files(spark):
    from pyspark.sql import functions as F

    from counterfair.llm import mixing
    from counterfair.llm.queries import MIX_BLOCK, MIX_WEIGHTS

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mixed = mixing.mix(docs, MIX_WEIGHTS, block_rows=MIX_BLOCK)
    want = [r["doc_id"] for r in mixed.select("position", "row.doc_id").orderBy("position").collect()]
    ordered = mixed.repartitionByRange(7, "position").sortWithinPartitions("position").select("row.*")
    table = staged(ordered, "order-test")
    assert table.select(F.input_file_name()).distinct().count() > 3
    got = corpus_pipeline.encode(spark, table, SF_DIR).select("position", "doc_id").collect()
    assert sorted(r["position"] for r in got) == list(range(len(want)))
    assert [r["doc_id"] for r in sorted(got)] == want
