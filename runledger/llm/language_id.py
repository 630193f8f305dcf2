"""Language identification by interpolated Kneser-Ney character models, one per language.

A word (a run of letters, lower-cased) is a sequence of characters after ORDER-1 start marks and before an
end mark; contexts never cross words. Each language's model is fitted on a bounded sample of its labelled
texts. All models live in common arrays sorted by the hash of an n-gram: one row of probabilities per
n-gram seen, one row of back-off weights per context seen, a column per language. A text's score under a
language is its cross-entropy in bits per character; the lowest wins. Texts whose best cross-entropy lies
above a bound calibrated on other labelled texts of that language and length are rejected. As few texts are
short, length classes under 32 characters are calibrated on runs of words cut from those texts as well.

Defined results: null texts and texts without a letter are `und`, score 0, and rejected; with no labelled
text at all every text is `und`, and keep_identified leaves the rows as they are unless told otherwise; ties go to the language that sorts first; rows with a null id never are
held out; labels that are null teach nothing; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ORDER = 5
#: Labelled texts per language, at most in expectation, from which the models learn; a fifth more calibrate.
SAMPLE_PER_LANGUAGE = 3000
#: Share of a language's own calibration texts that may lie above the bound, and the slack beyond that.
REJECT_SHARE, SLACK = 0.001, 1.05
#: Length classes below this one (under 32 characters) calibrate on runs of words too: so many a text and class;
#: a class of fewer than FEW texts and runs is pooled with the next shorter one.
SHORT_CLASSES, RUNS, FEW = 6, 4, 30
#: Distinct words a task keeps before it starts anew.
WORD_LIMIT = 300_000
#: Characters that are cut into words, and new words that are worked out, at a time.
CHARS_AT_ONCE, WORDS_AT_ONCE = 500_000, 8_192
START, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RESULT = "lang string, score double, bits double, n_chars long, rejected boolean"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """A bounded sample of labelled rows that are not held out, with `calibrates` for one in six."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~shared.held_out(F.col("doc_id")))
    total = rows.groupBy("lang").agg(F.count("*").alias("n_of_lang"))
    spread = F.pmod(F.xxhash64(F.lit(8), "doc_id", "text"), F.lit(1_000_000))
    chosen = rows.withColumn("spread", spread).join(F.broadcast(total), "lang")
    return chosen.where(F.col("spread") * F.col("n_of_lang") < F.lit(1_200_000 * per_language)).select("lang", "text", (F.col("spread") % 6 == 0).alias("calibrates"))


@shared.lean
def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found: Counter = Counter()
        for lang, text in zip(rows.lang, rows.text, strict=True):
            found.update((lang, w) for w in words(text))
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in found.items()], columns=["lang", "word", "n"])


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of the n-grams of the highest order, start marks included."""
    by_word = texts.select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long")
    by_word = by_word.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    at = by_word.select("lang", "n", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    return at.groupBy("lang", F.col("w").substr(F.col("i"), F.lit(order)).alias("gram")).agg(F.sum("n").alias("n"))


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k characters that end at each place; places before the k-th wrap around."""
    h = np.full(len(codes), k, np.uint64)
    for j in range(k - 1, -1, -1):
        h = (h ^ np.roll(codes, j)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)


@dataclass
class Models:
    """Sorted hashes with probabilities (grams) and back-off weights (contexts), by order; bounds by language and length."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    bounds: np.ndarray
    order: int = ORDER

    def bits(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its bits under each language, and its characters counted with the end mark."""
        pad = START * (self.order - 1)
        codes = _codes("".join(pad + w + END for w in ws))
        p = np.tile(self.unseen, (len(codes), 1))
        for k in range(1, self.order + 1):
            if k > 1:
                # the context of k-1 characters ends one place before
                p *= _rows(self.contexts[k - 1], np.roll(hashes(codes, k - 1), 1), 1.0)
            seen = _rows(self.grams[k], hashes(codes, k), np.nan)
            p = np.where(np.isnan(seen), p, seen)
        b = -np.log2(p)
        b[codes == ord(START)] = 0
        sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + self.order
        return np.add.reduceat(b, np.cumsum(sizes) - sizes, axis=0), sizes - self.order + 1


def _rows(of: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = of
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where((known[at] == keys)[:, None], values[at], missing)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    known = np.unique(np.concatenate([h for h, _ in parts]))
    values = np.full((len(known), len(parts)), missing, np.float64)
    for i, (h, v) in enumerate(parts):
        values[np.searchsorted(known, h), i] = v
    return known, values


def fit_one(counts: dict[str, int], order: int = ORDER) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """One language's interpolated probabilities and back-off weights by order, and its weight of an unseen character.

    The highest order uses counts; lower ones count the distinct characters seen before an n-gram.
    """
    levels: list[dict[str, int]] = [{} for _ in range(order + 1)]
    levels[order] = counts
    for k in range(order - 1, 0, -1):
        levels[k] = dict(Counter(g[1:] for g in levels[k + 1]))
    alphabet = len(levels[1]) + 1
    probs: list[dict[str, float]] = [{} for _ in range(order + 1)]
    weights: list[dict[str, float]] = [{} for _ in range(order + 1)]
    unseen = 1.0
    for k in range(1, order + 1):
        once, twice = (sum(n == x for n in levels[k].values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and once + 2 * twice else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in levels[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        back = {c: d * kinds[c] / total[c] for c in total}
        if k == 1:
            unseen = back[""] / alphabet
            probs[1] = {g: (n - d) / total[""] + unseen for g, n in levels[1].items()}
        else:
            probs[k] = {g: max(n - d, 0) / total[g[:-1]] + back[g[:-1]] * probs[k - 1][g[1:]] for g, n in levels[k].items()}
        weights[k - 1] = back
    return probs, weights, unseen


def fit_models(grams: pd.DataFrame, order: int = ORDER) -> Models | None:
    langs = sorted(grams.lang.unique())
    if not langs:
        return None
    fitted = [fit_one(dict(zip(part.gram, part.n.astype(int), strict=True)), order) for part in (grams[grams.lang == x] for x in langs)]

    def arrays(of: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        codes = _codes("".join(of))
        return hashes(codes, k)[k - 1 :: k], np.fromiter(of.values(), np.float64, len(of))

    tables = [[_merged([arrays(f[which][k], k) for f in fitted], missing) if k else None for k in range(order + 1 - which)] for which, missing in ((0, np.nan), (1, 1.0))]
    return Models(langs, tables[0], tables[1], np.array([f[2] for f in fitted]), np.full((len(langs), 32), np.inf), order)


class Scorer:
    """Scores texts word by word; the bits of each distinct word are worked out once."""

    def __init__(self, models: Models) -> None:
        self.m = models
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.bits = np.empty((0, len(self.m.langs)))
        self.size = np.empty(0, np.int64)

    def add(self, new: list[str]) -> None:
        bits, size = self.m.bits(new)
        letters = np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.bits = np.concatenate([self.bits, bits * letters[:, None]])
        self.size = np.concatenate([self.size, size * letters])

    def score(self, texts: list[str]) -> list[tuple]:
        """Texts are cut into words a group of some CHARS_AT_ONCE characters at a time, and new words worked out WORDS_AT_ONCE
        at a time, so that a batch of long texts takes no more memory than one of them."""
        out: list[tuple] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= CHARS_AT_ONCE:
                out += self._score(group)
                group, size = [], 0
        return out + self._score(group)

    def _score(self, texts: list[str]) -> list[tuple]:
        if len(self.at) > WORD_LIMIT:
            self.clear()
        cut = [words(t) if t else [] for t in texts]
        new = sorted({w for ws in cut for w in ws} - self.at.keys())
        for i in range(0, len(new), WORDS_AT_ONCE):
            self.add(new[i : i + WORDS_AT_ONCE])
        return [self._one(ws) for ws in cut]

    def _one(self, ws: list[str]) -> tuple:
        row = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
        n = int(self.size[row].sum())
        if not n:
            return "und", 0.0, None, 0, True
        h = self.bits[row].sum(axis=0) / n
        best = int(h.argmin())
        odds = np.exp2(-(h - h[best]) * min(n, 60))
        return self.m.langs[best], float(odds[best] / odds.sum()), float(h[best]), n, bool(h[best] > self.m.bounds[best, length_class(n)])


def length_class(n: int) -> int:
    return min(n.bit_length(), 31)


def predict(text: Column, models: Models | None) -> Column:
    """A struct of lang, score (confidence, 0 to 1), bits per character, characters counted, rejected."""
    if models is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(0).cast("long").alias("n_chars"), F.lit(True).alias("rejected"))

    @F.pandas_udf(_RESULT)
    @shared.lean
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(models)
        for texts in batches:
            yield pd.DataFrame(scorer.score(texts.tolist()), columns=["lang", "score", "bits", "n_chars", "rejected"])

    return scored(text)


def runs(ws: list[str]) -> Iterator[str]:
    """Runs of words, begun at RUNS places of a text, that just reach a short length class."""
    for c in range(2, SHORT_CLASSES):
        for i in range(RUNS):
            first = end = i * len(ws) // RUNS
            n = 0
            while n < 2 ** (c - 1) and end < len(ws):
                n += len(ws[end]) + 1
                end += 1
            if length_class(n) == c:
                yield " ".join(ws[first:end])


def scored_with_runs(texts: DataFrame, models: Models) -> DataFrame:
    """(lang, text) -> lang, run (whether it is a run cut from a text), lang_pred, bits, n_chars; one Python worker a task cuts and scores."""

    @shared.lean
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(models)
        for rows in batches:
            whole = [(lang, text, False) for lang, text in zip(rows.lang, rows.text, strict=True)]
            cut = whole + [(lang, run, True) for lang, text, _ in whole for run in runs(words(text))]
            found = scorer.score([text for _, text, _ in cut])
            yield pd.DataFrame([(lang, run, p[0], p[2], p[3]) for (lang, _, run), p in zip(cut, found, strict=True)], columns=["lang", "run", "lang_pred", "bits", "n_chars"])

    return texts.select("lang", "text").mapInPandas(scored, "lang string, run boolean, lang_pred string, bits double, n_chars long")


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Models | None:
    """Models of the labelled rows of docs (doc_id, text, lang) that are not held out, with calibrated bounds."""
    shared.small_batches(docs.sparkSession)
    chosen = sample(docs.select("doc_id", "text", "lang"), per_language)
    # bounded: n-grams of a bounded sample
    models = fit_models(count_grams(chosen.where("not calibrates")).toPandas())
    if models is None:
        return None
    # a run may read as another language and must stay there too
    own = scored_with_runs(chosen.where("calibrates"), models).where("lang_pred = lang or run and n_chars > 0")
    classes = F.least(F.length(F.bin("n_chars")), F.lit(31))
    limits = own.groupBy(F.col("lang_pred").alias("lang"), classes.alias("c")).agg(F.percentile_approx("bits", 1 - REJECT_SHARE, 10_000).alias("bits"), F.count("*").alias("n")).collect()
    bounds = np.full((len(models.langs), 32), np.nan)
    for r in limits:
        bounds[models.langs.index(r.lang), r.c] = r.bits * SLACK
    texts_of = {(r.lang, r.c): r.n for r in limits}
    for lang, row in zip(models.langs, bounds, strict=True):
        # shorter texts vary more: no bound is below that of a longer class, and classes without texts take the next shorter one's
        longer = -np.inf
        for c in range(31, -1, -1):
            longer = row[c] = max(longer, row[c]) if not np.isnan(row[c]) else longer
        shortest = np.argmax(row > -np.inf) if (row > -np.inf).any() else 32
        row[:shortest] = np.inf
        row[row == -np.inf] = row[row > -np.inf].min() if (row > -np.inf).any() else np.inf
        for c in range(1, SHORT_CLASSES):
            if texts_of.get((lang, c), 0) < FEW:
                row[c] = row[c - 1]
    models.bounds = bounds
    return models


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit(docs)
    p = docs.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), models).alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def keep_identified(docs: DataFrame, models: Models | None = None, unlearned: str = "keep") -> DataFrame:
    """The rows of docs whose language the models accept, with the columns that docs has.

    unlearned: what becomes of docs where no row is labelled, so that no model can reject anything: keep, drop or raise.
    """
    models = models or fit(docs)
    if models is None:
        if unlearned == "raise":
            raise ValueError("no labelled text to learn a language from")
        return docs if unlearned == "keep" else docs.limit(0)
    return docs.select(F.struct("*").alias("d"), predict(docs["text"], models).alias("p")).where("not p.rejected").select("d.*")
