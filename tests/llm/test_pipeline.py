from __future__ import annotations

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import common, langid, packing, pii, simhash
from corvane.llm.registry import tokenizer_path
from corvane.llm.tokens import encoder
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_pii import brute as plain_spans
from tests.llm.test_pii import plainly_redacted
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r for r in out.collect()} if name != "pack" else {}
        if name != "pack":
            assert out.columns == docs.columns
        if name == "language_id":
            # the model is learned as in the stage; each text is judged alone, by one pass over its words
            model = langid.fit(langid.training_sample(docs))

            def score(text, model=model):
                ws = re.findall(r"[^\W\d_]+", (text or "").lower())
                if not ws:
                    return 0.0
                post = langid.forward_backward(model.scores(ws)[None], model.turns.astype(float), model.start.astype(float), np.array([len(ws)]))
                return post.sum(axis=(0, 1)).max() / len(ws)

            want = {i: t for i, t in kept.items() if score(t) >= langid.LEAST_SCORE}
            assert len(want) > 0.98 * len(kept)
        elif name == "near_dedup":
            fps = {i: plain_fingerprint(t) for i, t in kept.items()}
            want = {i: kept[i] for i in set(plain_components(fps).values())}
        elif name == "decontaminate":
            want = {i: t for i, t in kept.items() if i not in {d for d, *_ in contained(list(kept.items()), items)}}
        elif name == "pii":
            spans = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
            for i, t in kept.items():
                # the base kinds' spans by the plain expressions
                assert [x for x in spans[i].split(",") if x.split(":")[0] in pii.BASE] == [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t)]
            want = {i: plainly_redacted(t, spans[i]) for i, t in kept.items()}
            assert pii.pii_report(out).where("n_email + n_card + n_phone > 0").count() == 0
        else:
            encode = encoder("byte_bpe", tokenizer_path("byte_bpe_50k.json")).packed
            sizes = {i: len(encode(t)) // 4 + 1 for i, t in kept.items()}
            got: dict[int, int] = {}
            for r in out.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == sizes
            assert out.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0
            continue
        assert {i: r.text for i, r in rows.items()} == want
        kept, docs = want, out
    assert simhash.BITS == 4


def test_run_and_queries(spark, sf_dir):
    import __spark_entry__ as entry

    found = entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "pack"]
    assert "pipeline" in found
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in found}
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_stages_on_repeated_rows_and_null_ids(spark, sf_dir):
    """Copies under one id leave one row; rows without an id or text are no error."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    row = docs.first()
    extra = spark.createDataFrame([row, row, row, (None, row.text, None, None, None), (None, None, None, None, None), (row.doc_id, None, "en", "s", 0)], docs.schema)
    out = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.written(stage(spark, out, sf_dir), name)
        assert out.columns == docs.columns
    assert out.where(out.doc_id == row.doc_id).count() == 1
    assert out.where("doc_id IS NULL").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, out, sf_dir)
    assert packed.select("doc_id").distinct().count() == out.count()


def test_what_earlier_stages_wrote_is_deleted(spark, sf_dir):
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    corpus_pipeline.run(spark, sf_dir).count()
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
    assert [x for x in left if not re.fullmatch(r"[0-9a-f-]{36}", x)] == [x for x in left if x.startswith("corpus-pipeline-pack")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            class Unset:
                @staticmethod
                def isDefined():
                    return False

            return Unset

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Session)
