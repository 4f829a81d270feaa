"""The pipeline's stages on real rows and on odd ones."""

import re

import pytest

import corpus_pipeline
from canasta.llm import mixing, secrets


def odd_rows(spark, docs):
    rows = [(None, None, None, None, None), (7, None, "en", "src0", 0), (8, "", None, None, 0), (9, "123 !!", "xx", "src1", 6), (9, "123 !!", "xx", "src1", 6),
            (10, "the word of the day is here " * 3000, "en", None, 84000), (None, "le mot du jour est dans la phrase", "fr", "src2", 33),
            (900011, 'a note says password = "hunter2hunter2" and the key 0123456789abcdef0123456789abcdef', "en", "src1", 85)]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = docs.union(odd_rows(spark, docs))
    seen = [source]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], folder).cache()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        seen.append(out)
    spoken, single, clean, mixed, packed = [x.collect() for x in seen[1:]]
    letters = [r for r in source.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(str(r.text) for r in spoken) == sorted(str(r.text) for r in letters)
    words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    texts = [words(r.text) for r in single]
    assert len(set(texts)) == len(texts) and {len(t) > 0 for t in texts} == {True}
    assert len(single) > 0.8 * len({words(r.text) for r in spoken})
    by_words = {}
    for r in spoken:
        by_words.setdefault(words(r.text), []).append(r.doc_id)
    known = {i for ids in by_words.values() for i in ids}
    assert {r.doc_id for r in single} <= known
    assert len(clean) == len(single) and all(r.n_chars == len(r.text) for r in clean)
    machine = secrets.compile_rules(secrets.RULES)
    assert not list(secrets.scan_texts(machine, [r.text.encode() for r in clean]))
    assert [r.text for r in clean if r.doc_id == 900011] == ['a note says [assign]" and the key [hex]']
    size = lambda rows: sum(len(words(r.text)) for r in rows)
    assert size(mixed) == pytest.approx(1.5 * size(clean), rel=0.05)
    assert max((mixed.count(r) for r in mixed[:50]), default=0) <= mixing.USES
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_stages_take_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_run_is_the_chain_of_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    short = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rs)
    again = docs.collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows}) == sorted({(r.doc_id, r.doc_tokens) for r in again})
    assert sum(r.length for r in rows) == sum(x[2] for x in short(again))
