import hashlib
import re

import sentencepiece

from test_mixing import brute_plan
from test_near_dedup import brute

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = dict(cp.STAGES)["language_id"](spark, docs, FOLDER)
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    rows = {r.doc_id: r for r in kept.collect()}

    once = dict(cp.STAGES)["exact_dedup"](spark, kept, FOLDER)
    groups = {}
    for r in rows.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {min(g)[1] for g in groups.values()}
    rows = {r.doc_id: r for r in once.collect()}

    near = dict(cp.STAGES)["near_dedup"](spark, once, FOLDER)
    want = {i for i, v in brute([(i, r.text) for i, r in rows.items()], 5).items() if v[2]}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want
    rows = {i: rows[i] for i in want}

    mix = dict(cp.STAGES)["mixing"](spark, near, FOLDER)
    plan = brute_plan([(r.doc_id, r.source, r.text) for r in rows.values()])
    passes = sorted(i for i, (size, _, _, taken) in plan.items() for _ in range(-(-taken // size) if taken else 0))
    assert mix.columns == columns and sorted(r.doc_id for r in mix.collect()) == passes

    sp = sentencepiece.SentencePieceProcessor(model_file=cp.MODEL)
    last = dict(cp.STAGES)["sentencepiece"](spark, mix, FOLDER)
    got = sorted((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in last.collect())
    one = {i: (i, tuple(ids := sp.encode(rows[i].text)), len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for i in set(passes)}
    assert got == [one[i] for i in passes]
    assert sorted(r.doc_id for r in cp.run(spark, FOLDER).collect()) == passes


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
