"""The pipeline's stages against brute force over the fixture."""

import hashlib
from collections import Counter

import pytest

from .fixture import SCHEMA, frame, rows
from .test_near_lines_language_bpe import brute_classes
from .test_secrets_mix_quality_exact import brute_mix, brute_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark):
    docs = frame(spark).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    table = rows()

    good = stages["quality rules"](spark, docs, None)
    table = [r for r in table if brute_quality(r[1])[6]]
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r[0] for r in table}

    best = {}
    for r in table:
        k = (r[1] or "").encode().lower()
        best[k] = max(best.get(k, r), r, key=lambda x: x[0])
    single = stages["exact dedup"](spark, spark.createDataFrame(table, SCHEMA), None)
    table = list(best.values())
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in table)

    near = stages["minhash near-dedup"](spark, spark.createDataFrame(table, SCHEMA), None)
    classes = brute_classes(table)
    table = [r for r in table if classes[r[0]] == r[0]]
    assert sorted(r.doc_id for r in near.collect()) == sorted(r[0] for r in table)

    mixed = stages["source mixing"](spark, spark.createDataFrame(table, SCHEMA), None)
    want = Counter({i: int(taken / size + 0.5) for i, (size, _, _, taken) in brute_mix(table).items() if size})
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +want

    out = stages["bpe encoding"](spark, mixed, None).collect()
    text = {r[0]: r[1] or "" for r in table}
    assert Counter(r.doc_id for r in out) == +want
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens > 0 for r in out)


def test_run_writes_and_rereads(spark, tmp_path):
    frame(spark).drop("key", "n").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 10
    frame(spark).drop("key", "n").limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
