"""The pipeline, stage by stage, against plain Python over the smallest tables."""

import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import common, decontaminate, packing, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage makes of its predecessor's result."""
    folder, before = str(tmp_path_factory.mktemp("cut")), common.shared_folder
    common.shared_folder = lambda spark: folder
    docs, out = common.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = common.cut(stage(spark, docs, SF))
    yield [*out, docs]
    common.shared_folder = before


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[:5])


def test_quality_keeps_the_good(spark, stages):
    folder = SF.replace("0.001", "0.01")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, common.table(spark, folder, "documents"), folder).collect()}
    labels = common.table(spark, folder, "labels").collect()
    share = lambda q: sum(r.doc_id in kept for r in labels if r.quality == q) / sum(r.quality == q for r in labels)
    assert share(1) >= 0.98 and share(0) <= 0.15


def test_one_of_each_group_stays(stages):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {r.doc_id: grams(r.text) for r in stages[1].collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[2].collect()} == {i for i in ids if find(i) == i}


def test_leaks_go(spark, stages):
    items = [" ".join(decontaminate.words(r.text)) for r in common.table(spark, SF, "benchmark").collect()]
    before = {r.doc_id: " ".join(decontaminate.words(r.text)) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    assert after == {i for i, t in before.items() if not any(x in t for x in items)}


def test_personal_data_is_masked(stages):
    before, after = ({r.doc_id: r for r in stages[k].collect()} for k in (3, 4))
    assert set(before) == set(after)
    for i, r in after.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.windows(before[i].text):
            assert r.text == before[i].text


def test_packing_round_trip(stages):
    encoder, got = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert set(got) == set(texts)
    for i, pieces in got.items():
        ids, at = encoder.encode(texts[i]) + (1).to_bytes(4, "little"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)


def test_awkward_documents_run_through(spark, stages, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns with names that stages use."""
    names = ("unit", "row", "class", "label", "quality", "chunk", "kind", "list", "part", "_quality_score2", "score", "node", "length")
    given = common.table(spark, SF, "documents")
    long = " ".join(r.text for r in given.where("text IS NOT NULL").orderBy("doc_id").limit(150).collect())
    odd = [(1_000_001, None, None, None, None), (1_000_002, "", "en", "s", 0), (1_000_003, " \n\t", None, "s", 3),
           (None, "a text without an id, of some words", "en", None, None), (None, None, None, None, None),
           (1_000_004, long, "en", "s", len(long)), *[(1_000_005, "twice the same row stands here", "en", "s", 30)] * 2]
    docs = given.union(spark.createDataFrame(odd, given.schema)).withColumns({n: F.lit("x") for n in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        common.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= known
    # Every document that is left lies in pieces that follow each other; a row that stands n times has each n times.
    pieces = defaultdict(Counter)
    for r in rows:
        if r.doc_id is not None:
            pieces[r.doc_id][r.start, r.length] += 1
            assert r.start + r.length <= r.doc_tokens
    for r in rows:
        if r.doc_id is not None:
            copies = min(pieces[r.doc_id].values())
            assert sum(length * n for (_, length), n in pieces[r.doc_id].items()) == copies * r.doc_tokens

    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        common.table(spark, SF, name).where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == stages[5].columns
