"""The pipeline's stages, each on its own input, against plain versions; and the whole run."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from .test_brute import SF, brute_jaccard, odd, pairs

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    got = spark.read.parquet(f"{SF}/documents.parquet") if request.param == "table" else odd(spark) if request.param == "odd" else odd(spark).limit(0)
    got.write.parquet(path)
    return spark.read.parquet(path)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None


def test_toxicity(spark, docs):
    from tessera.llm import op7_toxic

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns
    scored = op7_toxic.classify(docs, labels).where("predicted = 0").collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in scored)


def test_near_duplicates(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    every = pairs(docs)
    want = Counter({p: 1 for p, (d, _, c) in zip(every, brute_jaccard(every, 5, 80)) if c is None or c == d})
    assert Counter(pairs(kept)) == want


def test_decontamination(spark, docs):
    from tessera.llm import op10_decon

    kept = corpus_pipeline.decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in op10_decon.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert Counter(pairs(kept)) == Counter(p for p in pairs(docs) if p[0] not in gone)


def test_mixing(spark, docs):
    """Each source's words come near its target, and no row has more than three copies; reruns agree."""
    from .test_brute import targets

    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words, taken, largest = Counter(), Counter(), Counter()
    for r in docs.collect():
        words[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    got = mixed.collect()
    for r in got:
        taken[r.source] += size(r.text)
    aim = targets(dict(words), [5, 2, 1])
    assert all(abs(taken[s] - aim[s]) <= largest[s] + 1e-6 for s in words)
    before, after = Counter(pairs(docs)), Counter((r.doc_id, r.text) for r in got)
    assert all(after[p] <= 3 * before[p] for p in after)
    again = corpus_pipeline.mixing(spark, docs.repartition(3), SF).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mixing_copies(spark, monkeypatch):
    """Rows that repeat very often are written in pieces, and none is lost."""
    monkeypatch.setattr(corpus_pipeline, "COPIES", 7)
    docs = spark.range(100).selectExpr("cast(null as bigint) as doc_id", "'x y' as text", "'s' as source", "id % 2 as other")
    got = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert len(got) == 100 and {r.other for r in got} <= {0, 1} and len({r.other for r in got}) == 1


def test_near_duplicates_same_id(spark):
    """Where a doc_id has a near duplicate and a text of its own, the own text stays; of equal rows the same one stays, however they come."""
    long = " ".join(f"word{i}" for i in range(100))
    rows_ = [(1, long, "a"), (2, long + " more", "b"), (2, "quite another text with words of its own", "c"), (3, "again another text of the same kind", "d"), (3, "again another text of the same kind", "e")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, other string")
    got = [sorted(map(tuple, corpus_pipeline.near_duplicates(spark, d, SF).collect())) for d in (docs, docs.orderBy(docs.other.desc()).coalesce(1))]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2, 3] and (2, "quite another text with words of its own", "c") in got[0]


def test_sharding(spark, docs):
    out = corpus_pipeline.sharding(spark, docs, SF)
    got = out.collect()
    assert out.schema["document"].dataType.fieldNames() == docs.columns
    assert Counter((r.document.doc_id, r.document.text) for r in got) == Counter(pairs(docs)) and all(0 <= r.shard < 24 and r.doc_id == r.document.doc_id for r in got)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "shard", "slot", "document"} <= set(got.columns)
