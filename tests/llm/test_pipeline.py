"""The stages of the pipeline against brute force, and the whole of it on awkward tables."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tarn.llm import mixing, pii, quality
from tarn.llm.common import documents, settle
from tests.llm.fixtures import WORD, awkward
from tests.llm.test_operators import brute_jaccard, plain_spans


def rows_of(df):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


def test_near_duplicate_stage_keeps_the_least_id(spark, sf):
    docs = documents(spark, sf)
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    want = {i: rows[i] for i, (_, root) in brute_jaccard({i: r["text"] for i, r in rows.items()}).items() if i == root}
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()
    assert len(out) == len(want) < len(rows) and {r["doc_id"]: r.asDict() for r in out} == want


def test_quality_stage_keeps_rows_by_their_score(spark, sf):
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    out = corpus_pipeline.quality_stage(spark, docs, sf)
    assert rows_of(out) == rows_of(docs.where(F.col("doc_id").isin([i for i, x in score.items() if x >= 0.3]))) and 0 < out.count() < docs.count()


def test_personal_data_stage_marks_every_span(spark, sf):
    docs = documents(spark, sf)
    model = pii.learn(docs)
    out = {r["doc_id"]: r.asDict() for r in corpus_pipeline.personal_data_stage(spark, docs, sf).collect()}
    changed = 0
    for r in docs.collect():
        text, done, at = r["text"] or "", "", 0
        for s, e, kind in sorted((s, e, k) for k, s, e in plain_spans(text, model)):
            if s >= at:
                done += text[at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        done += text[at:]
        changed += done != text
        want = r.asDict() | ({"text": done, "n_chars": len(done)} if r["text"] is not None else {})
        assert out[r["doc_id"]] == want, r["doc_id"]
    assert changed and len(out) == docs.count()


def test_mixing_stage_takes_what_the_mix_says(spark, sf):
    docs = documents(spark, sf)
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in docs.collect():
        want[tuple(sorted((k, str(v)) for k, v in r.asDict().items()))] = times[r["doc_id"]]
    assert rows_of(corpus_pipeline.mixing_stage(spark, docs, sf)) == +want


def test_token_stage_equals_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    docs = documents(spark, sf)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.token_stage(spark, docs, sf).collect()}
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_is_its_stages_in_turn(spark, sf):
    docs = documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        docs, columns = stage(spark, docs, sf), docs.columns
        assert last or docs.columns == columns, name
        docs = docs if last else settle(docs)
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(docs) and docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, tmp_path, empty):
    """Nulls, empty and very long texts, repeated rows, null ids and clashing names from end to end."""
    docs = awkward(spark, empty)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([] if empty else [(4, 1, 0), (5, 1, None), (13, 0, 0), (None, 1, 1), (7, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    if empty:
        assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
        return
    stages = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, stages = stages, settle(stage(spark, stages, str(tmp_path)))
        assert stages.columns == docs.columns, name
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert ids(stages) <= ids(before), name
    texts = [r["text"] for r in stages.collect()]
    out = corpus_pipeline.STAGES[-1][1](spark, stages, str(tmp_path)).collect()
    assert len(out) == len(texts) > 0 and sum(r["n_tokens"] for r in out) >= sum(len(WORD.findall(t or "")) for t in texts)
