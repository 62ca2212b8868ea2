import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foliomine.llm.oracle import ORACLES
from foliomine.llm.queries import QUERIES
from oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = sorted(QUERIES, key=lambda n: (len(n.split("_")[0]), n))
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_stages_narrow_the_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, names = docs, {name for name, _ in corpus_pipeline.STAGES}
    assert names == {"quality", "near_duplicates", "decontamination", "mixing", "sharding"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns
        assert after.join(left, docs.columns, "left_anti").count() == 0
        if name != "mixing":
            assert 0 < after.count() < left.count()
        else:  # every document stays
            assert left.join(after, docs.columns, "left_anti").count() == 0
        left = after
    shards = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert shards.count() == left.count()


def test_run_keeps_the_last_stage_alone(spark):
    import os

    from foliomine.llm.scratch import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(made.columns) and 0 < made.count()
    assert made.join(docs, "doc_id", "left_anti").count() == 0
    folder, = [f for f in set(os.listdir(shared_folder(spark))) - before if f.startswith("pipeline-")]
    assert os.listdir(f"{shared_folder(spark)}/{folder}") == ["sharding"]


def test_scratch_of_a_cluster_is_in_the_warehouse():
    from types import SimpleNamespace

    from foliomine.llm.scratch import shared_folder

    def session(master, **conf):
        held = SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=held)

    warehouse = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}
    assert shared_folder(session("yarn", **warehouse)) == "hdfs://x/warehouse/_scratch"
    assert shared_folder(session("local-cluster[2,1,1024]", **warehouse)) == "hdfs://x/warehouse/_scratch"
    assert shared_folder(session("yarn", **warehouse, **{"spark.checkpoint.dir": "hdfs://y/z/"})) == "hdfs://y/z"
