import os

import pytest
import sentencepiece
import public_tokenizers

import corpus_pipeline as P
from colloquy.llm.decontam import normalise
from tests.llm.test_similar import jaccard, slow_shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        kept.append(docs.collect())
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    ids = [{r.doc_id for r in rows} for rows in kept]
    # Each stage keeps part of what the one before it kept; clean text stays.
    for a, b in zip(ids, ids[1:], strict=False):
        assert b <= a
    assert {r.doc_id for r in kept[0] if any(c.isalpha() for c in r.text or "")} >= ids[1] and len(ids[1]) >= 0.97 * len(ids[0])
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    assert len((ids[1] - ids[2]) - toxic) <= 0.05 * len(ids[1])
    # Near duplicates: one of each group, by all pairs' similarity of five-word shingles.
    rows = kept[2]
    sets, group = [slow_shingles(r.text) for r in rows], list(range(len(rows)))
    near = [(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in near:
        before = list(group)
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert ids[3] == set(least.values())
    # Decontamination: what holds an item goes.
    items = [normalise(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids[4] == {r.doc_id for r in kept[3] if not any(i in normalise(r.text) for i in items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in docs.collect()} == {r.doc_id: sp.encode(r.text) for r in kept[4]}


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
