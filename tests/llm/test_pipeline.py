"""The pipeline's stages against plain Python versions, and the entry without this part."""

import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from shelfweave.llm import toxicity
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).cache()
        seen.append((name, docs, out))
        docs = out
    return seen


def test_columns_stay(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    expected = {r.doc_id for r in before.collect() if model.score(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == expected and len(expected) < before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    classes = brute.components([(r.doc_id, brute.simhash(r.text)) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    clean = set()
    for r in before.collect():
        n_words, n_hit, _ = brute.decontaminate(r.text, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < before.count()


def test_every_document_stays_in_the_mixture(stages):
    _, before, after = stages[3]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.count() > before.count()


def test_all_rows_get_a_place(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before.collect())
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def test_run_leaves_the_same_documents(spark, stages):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == Counter(r.doc_id for r in stages[-1][2].collect())


def test_awkward_documents_and_clashing_names(spark, corpus, no_documents, tmp_path):
    docs = corpus.selectExpr("*", "1 AS size", "'x' AS slot", "2 AS _slot", "3 AS row")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "_size", "_shard", "__slot"]
    rows = out.collect()
    ids = Counter(r.doc_id for r in rows)
    # copies go (1 and 2 are one text, as are 3, 4, 5, 16 and 17), long and NULL texts and rows without an id stay
    assert {1, 3, 6, 7, 8, 14, None} <= set(ids) and not {2, 4, 5, 16, 17} & set(ids)
    assert all(r.key == "clash" and r.slot == "x" for r in rows)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_this_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("shelfweave.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "smape_by_store" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
