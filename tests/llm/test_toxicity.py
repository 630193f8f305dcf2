import math
import random

import numpy as np
from pyspark.ml.linalg import Vectors
from runledger.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.queries()["op7_toxicity"](spark, folder).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    hits = int(((rows.predicted == 1) & (rows.toxic == 1)).sum())
    assert hits >= 0.87 * (rows.toxic == 1).sum() and hits >= 0.95 * max((rows.predicted == 1).sum(), 1)
    assert got.where("score < 0 or score > 1 or score is null or predicted != cast(score >= 0.5 as int)").count() == 0


def test_features():
    t = toxicity.Tokens({"gorp": 2.0})
    names = toxicity.FEATURES
    one = dict(zip(names, t.features(["You IDIOT! you id!ot, gorp fine"])[0], strict=True))
    assert one["fixed"] == 1 / 6 and one["learned"] == 1 / 6 and one["weight"] == 2 / 6 and one["second"] == 2 / 6
    assert one["hidden"] == one["hidden_hit"] == 1 / 6 and one["near"] == 1.0 and one["burst"] == 3 and one["caps"] == 1 / 6
    assert all(len(f) == len(names) for f in t.features(["", None, " \n", "x" * 100_000, "!" * 50]))


def test_disguised_words():
    t = toxicity.Tokens({"gorp": 2.0, "blargi*": 1.5})
    names = toxicity.FEATURES
    for token in ("1diot", "@sshole", "id*ot", "st**id", "i.d.i.o.t", "1d10t", "Id!ot!", "g0rp", "(m0ron),", "l-o-s-e-r"):
        one = dict(zip(names, t.features([token])[0], strict=True))
        assert one["hidden"] == 1 and one["hidden_hit"] == (token != "@sshole"), token
    for token in ("hello", "3rd", "a*b", "x.y", "idiot", "well-known", "e.g.", "10,000", "c++", "qu**n"):
        assert dict(zip(names, t.features([token])[0], strict=True))["hidden_hit"] == 0, token
    one = dict(zip(names, t.features(["blargish blargi Blarging? other"])[0], strict=True))
    assert one["stem"] == 2 / 4 and one["stem_weight"] == 3.0 / 4 and one["learned"] == 0


def slow_features(text, lexicon):
    """One token after another."""
    tokens = (text or "").split()
    n = max(len(tokens), 1)
    words = [toxicity.core(w) for w in tokens]
    fixed, learned = [w in toxicity.INSULTS for w in words], [w in lexicon for w in words]
    second = [w in toxicity.SECOND_PERSON for w in words]
    rows = [toxicity.Tokens(lexicon)._row(w) for w in tokens]
    hidden, caught = [r[4] for r in rows], [r[5] for r in rows]
    hits = [i for i in range(len(tokens)) if fixed[i] or learned[i] or caught[i]]
    near = sum(any(second[j] for j in range(max(0, i - toxicity.NEAR), min(len(tokens), i + toxicity.NEAR + 1))) for i in hits)
    burst = max((sum(i <= j < i + 50 for j in hits) for i in hits), default=0)
    letters, chars = sum(c.isalpha() for w in tokens for c in w), sum(map(len, tokens))
    begun = [lexicon.get(w[:6] + "*", 0.0) if len(w) > 6 else 0.0 for w in words]
    signs = sum(not c.isalpha() and not c.isdigit() for w in tokens for c in w)
    shouted = sum(sum(map(str.isalpha, w)) > 1 and all(c.isupper() for c in w if c.isalpha()) for w in tokens)
    return [
        sum(fixed) / n, sum(learned) / n, sum(lexicon.get(w, 0.0) for w in words) / n, math.log1p(len(hits)), near / max(len(hits), 1), sum(second) / n,
        sum(c.isupper() for w in tokens for c in w) / max(letters, 1), shouted / n, signs / max(chars, 1), sum(w.count("!") for w in tokens) / max(chars, 1),
        sum(c.isdigit() for w in tokens for c in w) / max(chars, 1), sum(hidden) / n, sum(caught) / n, burst, math.log1p(len(tokens)), chars / n, sum(b > 0 for b in begun) / n, sum(begun) / n,
    ]


def test_features_against_one_token_after_another():
    rng = random.Random(3)
    lexicon = {"gorp": 2.0, "zib": 1.75, "blargi*": 1.6}
    pool = ["you", "DU", "Idiot,", "gorp", "zib!", "blargish", "id!ot", "fine", "DAY", "42", "x-1", "--", "Ünder", "moron", "1diot", "a.b.c"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, "", "!!!", "idiot " * 500]
    for text, got in zip(texts, toxicity.Tokens(lexicon).features(texts), strict=True):
        assert np.allclose(got, slow_features(text, lexicon), rtol=1e-12), text


def test_scores_against_trees_and_interpolation(spark):
    """The boosted sum, its logistic and the isotonic step, worked out by hand from the trees of a fitted model."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    tokens = toxicity.Tokens(model.lexicon)
    xs, ys = np.array(model.calibration.boundaries), np.array(model.calibration.predictions)
    values = set()
    for r in rows[::7]:
        x = Vectors.dense([float(v) for v in tokens.features([r.text])[0]])
        margin = sum(w * t.predict(x) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True))
        raw = 1 / (1 + math.exp(-2 * margin))
        assert abs(got[r.doc_id] - min(1.0, max(0.0, float(np.interp(raw, xs, ys))))) < 1e-9
        values.add(got[r.doc_id])
    assert len(values) > 1 and (np.diff(ys) >= 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot clown" if i % 3 == 0 else "a fine day") for i in range(300)] + [(900, None), (901, ""), (None, "idiot"), (902, "idiot " * 50_000)], "doc_id long, text string").withColumn("score", toxicity.F.lit("clash")).withColumn("d", toxicity.F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, None), (None, 1), (900, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert got[0] > 0.5 > got[1] and got[None] is not None and 0 <= got[901] <= 1
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0
    flat = toxicity.fit(docs, labels.limit(0))
    assert flat.trees is None and toxicity.score(docs.select("doc_id", "text"), flat).select("score").distinct().count() == 1
