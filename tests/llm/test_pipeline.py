"""The pipeline's stages one after another, each against its own input."""

import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tessera.llm import bpe

SF = brute.SF
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        out[name] = docs.collect()
    return out


def test_stages(kept):
    columns = kept["documents"][0].__fields__
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "pii", "mixing", "bpe"]
    assert all(kept[n][0].__fields__ == columns for n in ("quality", "simhash", "pii", "mixing"))
    passed = {r.doc_id for r in kept["documents"] if not brute.quality_counts(r.text)[5]}
    ids = {r.doc_id for r in kept["quality"]}
    assert ids <= passed and len(ids) > 0.9 * len(passed)
    near = brute.near_groups([(r.doc_id, r.text) for r in kept["quality"]])
    assert {r.doc_id for r in kept["simhash"]} == set(near.values())
    assert {r.doc_id for r in kept["pii"]} == {r.doc_id for r in kept["simhash"]}
    before = {r.doc_id: r.text for r in kept["simhash"]}
    for r in kept["pii"]:
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        assert brute.base_spans(before[r.doc_id]) or r.text == before[r.doc_id] or "<TERM>" in r.text
    sizes = {r.doc_id: brute.quality_counts(r.text)[0] for r in kept["pii"]}
    taken = {r.doc_id: brute.quality_counts(r.text)[0] for r in kept["mixing"]}
    assert all(0 < n <= 2 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.02
    words = {r.doc_id: set(r.text.split()) for r in kept["pii"]}
    assert all(set(r.text.split()) <= words[r.doc_id] for r in kept["mixing"])
    assert {r.doc_id for r in kept["bpe"]} == set(taken)
    v = bpe.vocabulary(bpe.default_path())
    text = {r.doc_id: r.text for r in kept["mixing"]}
    assert all(r.n_tokens == sum(len(p) for p in bpe.encoded(v, text[r.doc_id])) // 4 and r.decoded_sha256 == brute.sha(text[r.doc_id]) for r in kept["bpe"])


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept["bpe"]))


def test_odd_rows(spark, tmp_path):
    random.seed(8)
    text = " ".join(random.choices("one two three four five six seven eight nine ten eleven twelve".split(), k=80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, text + " mail me@x.org", None, "b", 3), (4, "x " * 30000, "en", "a", 60000), (5, text[::-1], "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.written(stage(spark, table, str(tmp_path)), "odd")
        assert table.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
