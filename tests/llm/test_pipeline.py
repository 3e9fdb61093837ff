"""The pipeline's stages on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from rankfield.llm.op10_simhash import simhash_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    word = lambda: f"w{r.randrange(3000)}"
    rows, labels = [], []
    for k in range(200):
        words = [word() for _ in range(r.randint(60, 200))]
        if k % 10 == 0:
            words = [w.upper() + "!!" for w in words]
        labels.append((k, int(k % 10 != 0), 0))
        rows.append([k, " ".join(words)])
    for k in range(20):
        rows.append([200 + k, rows[k + 21][1]])
    item = " ".join(f"item{k}" for k in range(30))
    for k in (31, 47):
        rows[k][1] += " " + item
    rows[55][1] += " reach me at someone@example.org"
    rows.append([500, None])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept["quality_rules"].keys() == {k for k in range(220) if k >= 200 or k % 10} - {200 + k for k in range(20) if (k + 21) % 10 == 0}
    assert len(set(kept["quality_rules"].values())) >= len(kept["near_duplicates"])
    assert not {31, 47} & kept["decontamination"].keys() and len(kept["decontamination"]) >= len(kept["near_duplicates"]) - 4
    assert kept["personal_data"][55].endswith("[EMAIL]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == kept["personal_data"].keys()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    groups = simhash_components(docs).select("component_id").distinct().count()
    assert corpus_pipeline.near_duplicates(spark, docs, folder).count() == groups


def test_empty(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
