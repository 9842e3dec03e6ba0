import corpus_pipeline
import pytest

import __spark_entry__ as registered
from windowmatch.llm import decontaminate, secret_scan, simhash
from windowmatch.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        docs = spark.createDataFrame(rows.collect(), rows.schema)
        kept.append(docs)
    return kept


def test_stages_keep_the_columns_and_drop_what_they_name(spark, stages):
    docs = table(spark, SF, "documents")
    rows = [docs, *stages]
    for before, after in zip(rows, rows[1:-1]):
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    # every document has a language
    assert stages[0].count() == docs.count()
    classes = simhash.near_duplicates(stages[0])
    assert {r["doc_id"] for r in stages[1].collect()} == {r["component_id"] for r in classes.collect()}
    leaks = decontaminate.contaminated(stages[1], table(spark, SF, "benchmark"))
    gone = {r["doc_id"] for r in leaks.collect()}
    assert gone and {r["doc_id"] for r in stages[1].collect()} - gone == {r["doc_id"] for r in stages[2].collect()}
    secrets = {r["doc_id"] for r in secret_scan.scan(stages[2]).collect()}
    changed = stages[2].select("doc_id", "text").subtract(stages[3].select("doc_id", "text"))
    assert secrets == {r["doc_id"] for r in changed.collect()} and stages[3].count() == stages[2].count()


def test_the_index_of_near_duplicates_is_not_broadcast(spark, monkeypatch):
    plans, components = [], simhash.components

    def watched(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components(links)

    monkeypatch.setattr(simhash, "components", watched)
    kept = corpus_pipeline.near_duplicates(spark, table(spark, SF, "documents"), SF)
    assert kept.count() and len(plans) == 1 and "Generate explode" in plans[0] and "Broadcast" not in plans[0]


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = registered.queries()["pipeline"](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1].select(*columns).collect()))


def test_every_operator_has_one_query():
    names = [n for n in registered.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in registered.queries()
