"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates of a whole text: densities of a fixed and of a learned lexicon, how near lexicon words stand
to second-person words, capitals, punctuation, and words that hide letters behind digits and signs. The learned
lexicon holds the words, and the beginnings of longer words, that mark toxic texts among labelled ones. Trees learn from a bounded sample of labelled
documents that are not held out; the calibration from others of the same kind.

Defined results: null and empty texts are scored like any text, from features of 0; labels that are null teach
nothing, of several labels of a document the highest counts; without both kinds of labels every score is the
smoothed share of toxic labels; a null doc_id is never held out; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Labelled documents that are learned from, at most in expectation; one in four of them calibrates.
SAMPLE = 24_000
#: Words of the learned lexicon (and as many beginnings), and in how many toxic texts each occurs at least.
LEARNED, LEAST_TEXTS = 200, 8
#: Letters of the beginnings of longer words.
STEM = 6
#: Distinct tokens whose properties a task keeps.
TOKEN_LIMIT = 200_000
#: Tokens within which a second-person word stands near a lexicon word.
NEAR = 6

# Insults, and second-person words, in four languages.
INSULTS = frozenset("""
    idiot idiots moron morons stupid dumb fool loser losers trash garbage scum jerk clown pathetic worthless disgusting ugly liar filthy vermin
    dummkopf trottel depp abschaum widerlich imbécile crétin ordure stupide débile idiota imbécil estúpido basura asqueroso
""".split())
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre tú ti usted ustedes vosotros".split())

_HIDDEN = str.maketrans("013457@$!|", "oieasta" + "sil")
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
# signs or digits between letters or before them, or letters one by one
_INSIDE = re.compile(r"[^\W\d_][\d@$!|*#%&]+[^\W\d_]|^[(\"']*[\d@$!|]+[^\W\d_]{2}")
_SPELLED = re.compile(r"[^\W\d_](?:[.\-_*][^\W\d_]){2,}[.\-_*]?")
_MASK = re.compile(r"[*#%&]+")

#: Properties of a token that are summed: in order the columns of Tokens.table.
_PROPERTIES = ("fixed", "learned", "weight", "second", "hidden", "hidden_hit", "caps", "letters", "upper", "digits", "signs", "calls", "chars", "stem", "stem_weight")
FEATURES = ("fixed", "learned", "weight", "hits", "near", "second", "upper", "caps", "signs", "calls", "digits", "hidden", "hidden_hit", "burst", "words", "word_length", "stem", "stem_weight")


def core(token: str) -> str:
    return _STRIP.sub("", token.lower())


def stem(word: str) -> str | None:
    """The beginning of a longer word, as the lexicon writes it."""
    return word[:STEM] + "*" if len(word) > STEM else None


def unhidden(token: str) -> set[str]:
    """The words that a token with signs or digits may stand for: signs read as letters, and dots between letters left out."""
    low = token.lower().strip("\"'()[].,;:?")
    out = {core(low.translate(_HIDDEN)), core(low).translate(_HIDDEN), core(low.rstrip("!").translate(_HIDDEN))}
    if _SPELLED.fullmatch(low):
        out.add(re.sub(r"[.\-_*]", "", low))
    return out


class Tokens:
    """Token -> row of properties, worked out once for each distinct token."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.words = sorted(INSULTS | {w for w in lexicon if not w.endswith("*")})
        self.clear()

    def _stands_for_insult(self, token: str) -> bool:
        if any(w in INSULTS or w in self.lexicon for w in unhidden(token)):
            return True
        low = core(token)
        if not _MASK.search(low):
            return False
        # a run of masks stands for one letter or more
        pattern = re.compile(r"[^\W\d_]+".join(map(re.escape, _MASK.split(low))))
        return any(pattern.fullmatch(w) for w in self.words)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.empty((0, len(_PROPERTIES)), np.float64)

    def _row(self, token: str) -> tuple:
        word = core(token)
        letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        upper = sum(map(str.isupper, token))
        hidden = bool(_INSIDE.search(token) or _SPELLED.fullmatch(core(token)))
        known = word in INSULTS or word in self.lexicon
        hit = hidden and not known and self._stands_for_insult(token)
        begun = self.lexicon.get(stem(word) or "", 0.0)
        weight = self.lexicon.get(word, 0.0)
        return (word in INSULTS, word in self.lexicon, weight, word in SECOND_PERSON, hidden, hit, letters > 1 and upper == letters, letters, upper, digits, len(token) - letters - digits, token.count("!"), len(token), begun > 0, begun)

    def features(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.at) > TOKEN_LIMIT:
            self.clear()
        cut = [(t or "").split() for t in texts]
        if new := sorted({w for ws in cut for w in ws} - self.at.keys()):
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array([self._row(w) for w in new], np.float64)])
        return [self._one(np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))) for ws in cut]

    def _one(self, ids: np.ndarray) -> np.ndarray:
        rows = self.table[ids]
        n = max(len(ids), 1)
        s = dict(zip(_PROPERTIES, rows.sum(axis=0), strict=True))
        hit = np.flatnonzero(rows[:, [0, 1, 5]].any(axis=1))
        you = np.flatnonzero(rows[:, 3])
        near, burst = 0, 0
        if len(hit):
            # hits within the widest run of 50 tokens
            burst = (np.arange(1, len(hit) + 1) - np.searchsorted(hit, hit - 49)).max()
        if len(hit) and len(you):
            after = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        chars, letters = max(s["chars"], 1), max(s["letters"], 1)
        return np.array([s["fixed"] / n, s["learned"] / n, s["weight"] / n, np.log1p(len(hit)), near / max(len(hit), 1), s["second"] / n, s["upper"] / letters, s["caps"] / n, s["signs"] / chars, s["calls"] / chars, s["digits"] / chars, s["hidden"] / n, s["hidden_hit"] / n, burst, np.log1p(len(ids)), s["chars"] / n, s["stem"] / n, s["stem_weight"] / n])


def features(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(lexicon)
        for texts in batches:
            yield pd.Series(tokens.features(texts.tolist()), dtype=object)

    return made(text)


@dataclass
class Model:
    lexicon: dict[str, float]
    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, text, toxic, calibrates: labelled rows that are not held out, bounded in expectation by size."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~shared.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    spread = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000))
    chosen = known.withColumn("spread", spread).where(F.col("spread") * max(total, 1) < size * 1_000_000)
    chosen = chosen.select("doc_id", "toxic", (F.col("spread") % 4 == 0).alias("calibrates"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by size


def _texts_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found: dict[str, list[int]] = {}
        for text, toxic in zip(rows.text, rows.toxic, strict=True):
            ws = {core(t) for t in (text or "").split()}
            for w in ws | {b for w in ws if (b := stem(w))}:
                found.setdefault(w, [0, 0])[toxic] += 1
        yield pd.DataFrame([(w, a, b) for w, (a, b) in found.items() if w], columns=["word", "clean", "toxic"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """The words and beginnings that mark toxic texts most, LEARNED of each, with their log odds."""
    n = rows.groupBy().agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    clean, toxic = n.clean or 0, n.toxic or 0
    counts = rows.select("text", "toxic").mapInPandas(_texts_with, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    marked = counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).where("odds > 1.5")
    most = marked.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word")
    rows = [r for begun in (False, True) for r in most.where(F.col("word").endswith("*") == begun).limit(LEARNED).collect()]
    return {r.word: r.odds for r in rows}


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    shared.small_batches(spark)
    work = shared.Workspace(spark, "toxicity")
    chosen = work.save(sample(docs, labels, size), "sample")
    counts = {(r.calibrates, r.toxic): r.n for r in chosen.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}
    total, toxic = sum(counts.values()), sum(n for (_, t), n in counts.items() if t)
    base = (toxic + 0.5) / (total + 1.0)
    if any(not counts.get((c, t)) for c in (False, True) for t in (0, 1)):
        return Model({}, base)
    lexicon = learn_lexicon(chosen.where("not calibrates"))
    rows = work.save(chosen.select("calibrates", F.col("toxic").cast("double").alias("label"), features(F.col("text"), lexicon).alias("f")), "features")
    rows = rows.withColumn("features", array_to_vector("f"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=7, maxBins=64).fit(rows.where("not calibrates"))
    scored = trees.transform(rows.where("calibrates")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(work.save(scored, "scored"))
    work.drop("sample", "features", "scored")
    return Model(lexicon, base, trees, calibration)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score: the calibrated probability that the text is toxic."""
    if model.trees is None:
        return docs.withColumn("score", F.lit(model.base))
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("d"), array_to_vector(features(docs["text"], model.lexicon)).alias("features"))
    raw = model.trees.transform(rows).select("d", vector_to_array("probability")[1].alias("raw"))
    calibrated = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    kept = [F.col("d").getField(c).alias(c) for c in docs.columns if c.lower() != "score"]  # a column of that name is replaced
    return model.calibration.transform(raw).select(*kept, calibrated.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, shared.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
