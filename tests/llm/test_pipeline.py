"""The pipeline's stages one by one and together, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import decontamination, simhash
from graphloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        after.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "sentencepiece":
            assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = before - ids
        assert ids <= before
        if name == "quality":
            assert sum(labels[d].quality == 0 for d in gone if d in labels) > 30
            assert sum(labels[d].quality == 1 for d in gone if d in labels) <= 2
        elif name == "toxicity":
            assert all(labels[d].toxic == 1 for d in gone if d in labels) and len(gone) > 20
        elif name == "dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert ids == set(groups.values())
        elif name == "decontamination":
            found = {r.doc_id for r in decontamination.contaminated(docs, table(spark, SF, "benchmark")).collect()}
            assert gone == found and gone
        else:
            assert ids == before and after.where("not round_trip").count() == 0
        docs = after
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op4_warc", "op8_embedding_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    rows = con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(str, rows))
