import itertools
import math
from collections import Counter

import pytest
from runledger.llm import language_id as li
from runledger.llm import queries

FOLDER = "/root/testdata/sf0.01"


def brute_probability(counts, order, ctx, ch):
    """Interpolated Kneser-Ney straight from its definition, over the dictionary of highest-order counts."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter({g[1:] for g in levels[k + 1]} and [g[1:] for g in levels[k + 1]])

    def p(k, ctx, ch):
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        level = levels[k]
        once, twice = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        d = once / (once + 2 * twice) if once else 0.5
        own = {g[-1]: n for g, n in level.items() if g[:-1] == ctx}
        if not own:
            return p(k - 1, ctx[1:], ch)
        total = sum(own.values())
        return max(own.get(ch, 0) - d, 0) / total + d * len(own) / total * p(k - 1, ctx[1:], ch)

    return p(order, ctx, ch)


def test_bits_equal_brute_force():
    import pandas as pd

    train = {"aa": ["the", "then", "they", "a"], "bb": ["der", "die", "das", "den", "der"]}
    rows = []
    for lang, ws in train.items():
        n = Counter()
        for w in ws:
            padded = li.START * 2 + w + li.END
            n.update(padded[i : i + 3] for i in range(len(w) + 1))
        rows += [(lang, g, c) for g, c in n.items()]
    models = li.fit_models(pd.DataFrame(rows, columns=["lang", "gram", "n"]), 3)
    tests = ["the", "der", "x", "thd", "zzzz", "den"]
    bits, size = models.bits(tests)
    assert size.tolist() == [len(w) + 1 for w in tests]
    for (i, w), (j, lang) in itertools.product(enumerate(tests), enumerate(models.langs)):
        counts = {g: c for x, g, c in rows if x == lang}
        padded = li.START * 2 + w + li.END
        want = -sum(math.log2(brute_probability(counts, 3, padded[k : k + 2], padded[k + 2])) for k in range(len(w) + 1))
        assert bits[i, j] == pytest.approx(want, rel=1e-9), (w, lang)


def test_held_out_accuracy_and_rows(spark):
    got = queries.queries()["op8_language_id"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got)
    out = both[both.held_out & both.lang.notna()]
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.02


def test_edges(spark):
    base = [(i, "the thing and the other thing", "en") for i in range(30)] + [(100 + i, "der und die das nicht", "de") for i in range(30)]
    odd = [(200, None, "en"), (201, "", None), (202, " 123 ²!! ", "de"), (None, "the and the", None), (203, "und der " * 40000, "de"), (203, "und der", "de")]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string").withColumn("rejected", li.F.lit("clash"))
    models = li.fit(docs)
    got = docs.select("doc_id", li.predict(docs.text, models).alias("p")).collect()
    by = {r.doc_id: r.p.lang for r in got}
    assert [by[x] for x in (200, 201, 202, None, 203, 0, 100)] == ["und", "und", "und", "en", "de", "en", "de"]
    kept = li.keep_identified(docs, models)
    assert kept.columns == docs.columns and {200, 201, 202}.isdisjoint(r.doc_id for r in kept.collect())
    assert li.fit(docs.limit(0)) is None and li.keep_identified(docs.limit(0)).count() == 0
    blank = docs.withColumn("lang", li.F.lit(None).cast("string"))
    assert li.keep_identified(blank).count() == docs.count() and li.keep_identified(blank, unlearned="drop").count() == 0
    with pytest.raises(ValueError):
        li.keep_identified(blank, unlearned="raise")
    assert docs.select(li.predict(docs.text, None).alias("p")).where("p.lang != 'und'").count() == 0


def test_foreign_texts_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    models = li.fit(docs)
    scorer = li.Scorer(models)
    foreign = ["привет мир", "ξένος λόγος", "xqzjv kwqxz", "日本語の文", "zxq vkjw qqx", "джщъ"]
    assert [scorer.score([t])[0][4] for t in foreign] == [True] * len(foreign)
    assert [scorer.score([" ".join([t] * 40)])[0][4] for t in foreign] == [True] * len(foreign)
    clean = docs.where(li.shared.held_out(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull()).toPandas()
    cut = [" ".join(ws[at : at + n]) for ws in map(li.words, clean.text) for at in range(0, min(len(ws), 40), 10) for n in (1, 2, 4)]
    assert len(cut) > 500
    assert sum(r[4] for r in scorer.score(cut)) <= 0.02 * len(cut)
    assert sum(r[4] for r in scorer.score(clean.text.tolist())) <= 0.02 * len(clean)


def test_scores_do_not_depend_on_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    models = li.fit(docs)
    texts = [r.text for r in docs.collect()] + [None, "", "x" * 2_000, "ab cd " * 20_000]
    whole = li.Scorer(models).score(texts)
    for chars, words, limit in ((1, 1, 10), (1000, 7, 300), (10**9, 10**9, 10**9)):
        monkeypatch.setattr(li, "CHARS_AT_ONCE", chars)
        monkeypatch.setattr(li, "WORDS_AT_ONCE", words)
        monkeypatch.setattr(li, "WORD_LIMIT", limit)
        got = li.Scorer(models).score(texts)
        assert all(a[0] == b[0] and a[3:] == b[3:] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(whole, got, strict=True))


def test_each_job_that_learns_takes_one_python_worker_a_task(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans, collect = [], type(docs).collect

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(docs), "collect", watched)
    li.fit(docs)
    assert [p.count("ArrowEvalPython") + p.count("MapInPandas") for p in plans] == [1, 1]


def test_scored_runs_equal_scores_of_their_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = li.fit(docs)
    texts = docs.where("lang is not null and text is not null").select("lang", "text").limit(40)
    want = Counter()
    for lang, text in texts.collect():
        for run, t in [(False, text), *((True, r) for r in li.runs(li.words(text)))]:
            p = li.Scorer(models).score([t])[0]
            want[lang, run, p[0], p[2], p[3]] += 1
    assert Counter(tuple(r) for r in li.scored_with_runs(texts, models).collect()) == want
