"""The stages in their order, against what each decides."""

from collections import Counter

import pytest

import corpus_pipeline
from tabular_audit.llm.queries import ORACLES, QUERIES

from .conftest import ODD, SF

COLUMNS = corpus_pipeline.COLUMNS


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.kept(stage(spark, out[-1], SF), name))
    return out


def test_stages(stages):
    docs, spoken, single, private, mixed, packed = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert spoken.count() == docs.count()  # all documents have letters
    assert single.count() == single.select("doc_id").distinct().count() < spoken.count()
    assert private.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    changed = [r for r in private.collect() if before[r["doc_id"]] != r["text"]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in private.collect())
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(before) and max(times.values()) <= 3
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == times


def test_run_gives_the_same(spark, stages):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))
    assert rows == sorted(map(tuple, stages[-1].drop("sequence_id", "offset").collect()))


def test_odd_documents(spark):
    docs = spark.createDataFrame([(*r, 0) for r in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.kept(stage(spark, rows, SF), name)
        assert (rows.count() > 0) == (start.count() > 0)
    spoken = corpus_pipeline.identify_language(spark, docs, SF)
    assert Counter(r["doc_id"] for r in spoken.collect()) == Counter([5, 5, 6, None, 7, 8])


def test_near_duplicates_lose_no_text(spark):
    """Two texts under one id stay, of copies without id one, and reruns agree."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["the river ran past the old mill and on to the sea", "a quite different story about a dog and its bone",
             "no name but words of its own in this one here"]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "b", 1), (2, texts[0], "en", "c", 1),
            (None, texts[2], "en", "d", 1), (None, texts[2], "en", "d", 1), (None, texts[1], "en", "e", 1)]
    found = [sorted(map(tuple, corpus_pipeline.drop_near_duplicates(
        spark, spark.createDataFrame(rows, schema).repartition(n), "").collect()), key=str) for n in (1, 5)]
    assert found[0] == found[1] == sorted([rows[0], rows[1], rows[3]], key=str)
