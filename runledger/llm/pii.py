"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans in other forms.

Patterns find the base spans. Between them, regions around digits, `@` and spelled-out `at` or `dot` (in any case) are cut
into atoms (runs of digits, of letters, of white space, single signs). The random field scores whole segments
of up to MOST_ATOMS atoms by features of the span (digits, groups, separators, checksums, borders) and by
transitions of kinds; dynamic programming over bounded segments chooses boundaries and kinds jointly. It goes through a
region atom by atom with a window of MOST_ATOMS places, and gives out what all paths through the window agree on, so a
region of any length takes little memory. Its
weights are learned on the driver by maximum likelihood from a bounded sample: base spans of documents, rewritten into forms
that the patterns miss, in their own surroundings, and regions without personal data. Documents are sampled by their ids,
at a rate that is raised until enough of them have something to look at.

Defined results: a null text counts as empty and has no spans; spans are in code points, end exclusive, sorted
by start and then kind; base spans of different kinds may overlap, added ones overlap nothing; without any
base span to learn from, nothing is added; texts of any length are read whole; repeated rows get equal results.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
#: Documents with personal data, at most in expectation, and regions, at most, from which the field learns.
SAMPLE, REGIONS, EPOCHS = 600, 500, 4
#: Atoms of a span; the longest form that rewriting makes of a name of three parts and a host of four has 29.
MOST_ATOMS = 32
#: Seeds closer than this many characters lie in one region.
GAP = 3
#: Atoms after which a decoder looks for what all its paths agree on.
SETTLE = 512

_LOCAL = "".join(map(chr, range(128)))
_LOCAL = "".join(c for c in _LOCAL if c.isalnum() or c in "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match starts inside a run of digits, so looking behind only spares time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a text needs for any span, and what starts a region; a bare `at` only where a `dot` follows the next word.
SEED = r"(?i)[0-9]+|@|[\[(](?:at|dot)[\])]|(?<= )dot(?= )|(?<= )at(?= [^\s]{1,63} dot )"
_SEED, _AT = re.compile(SEED), re.compile(r"(?i)@|[\[(](?:at|dot)[\])]|(?<= )dot(?= )|(?<= )at(?= [^\s]{1,63} dot )")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_WORD_CHAR = re.compile(r"[^\s,;:!?]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each has one `@`; its local part reaches left to what cannot belong or was matched before."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# --- regions and features --------------------------------------------------------------------------------------


def regions(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches around seeds, outside the spans taken, that could hold a span: an `at` or `dot`, or 4 digits."""
    edges = [(0, 0), *sorted((a, b) for _, a, b in taken), (len(text), len(text))]
    free, low = [], 0
    for a, b in edges:
        if a > low:
            free.append((low, a))
        low = max(low, b)
    for low, high in free:
        found, region = _runs(text, low, high), None
        run = next(found, None)
        while run:
            (a, b, spelled), run = run, next(found, None)
            skips = 1 if spelled else 0  # spelled-out forms have a space between seed and word
            a = _extended(text, a, region[1] if region else low, -1, skips)
            b = _extended(text, b, run[0] if run else high, 1, skips)
            if region and a <= region[1]:
                region[1] = b
                continue
            if region:
                yield region[0], region[1]
            region = [a, b]
        if region:
            yield region[0], region[1]


def _runs(text: str, low: int, high: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, spelled) of seeds that lie close together and could be a span: with an `at` or `dot`, or 4 digits."""
    run = None
    for m in _SEED.finditer(text, low, high):
        spelled, digits = not "0" <= m[0][0] <= "9", m.end() - m.start()
        if run and m.start() - run[1] <= GAP and "\n" not in text[run[1] : m.start()]:
            run = [run[0], m.end(), run[2] or spelled, run[3] + (0 if spelled else digits)]
            continue
        if run and (run[2] or run[3] >= 4):
            yield run[0], run[1], run[2]
        run = [m.start(), m.end(), spelled, 0 if spelled else digits]
    if run and (run[2] or run[3] >= 4):
        yield run[0], run[1], run[2]


def _extended(text: str, at: int, limit: int, step: int, skips: int) -> int:
    """Moves over the word beside a place, after at most `skips` spaces, up to the limit."""
    begun = False
    while at != limit:
        c = text[at - 1] if step < 0 else text[at]
        if _WORD_CHAR.match(c):
            begun = True
        elif c == " " and skips and not begun:
            skips -= 1
        else:
            break
        at += step
    return at


@dataclass
class Lattice:
    """A short region's atoms and the segments that may be entities, with their features, to learn from."""

    atoms: list[tuple[int, int]]
    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    outside: list[list[str]] = field(default_factory=list)


def _kind_of_char(c: str) -> str:
    return "-" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in "@.+-=\"'/_" else "p"


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def span_features(text: str, a: int, b: int, n_atoms: int) -> list[str]:
    return shape_features(text[a - 1 : a], text[a:b], text[b : b + 1], n_atoms) + value_features(text[a:b])


def shape_features(left: str, s: str, right: str, n_atoms: int) -> list[str]:
    """What does not depend on which digits stand in the span."""
    groups = re.findall("[0-9]+", s)
    n_digits = sum(map(len, groups))
    letters = sum(c.isalpha() for c in s)
    between = sorted({_kind_of_char(c) for x in re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", s) for c in x})
    out = ["bias", f"digits={_bucket(n_digits, (1, 4, 7, 10, 11, 12, 13, 14, 16, 17, 20))}", f"letters={_bucket(letters, (1, 3, 6, 12, 25))}", f"between={''.join(between)}"]
    out.append(f"groups={'-'.join(str(len(g)) for g in groups) if len(groups) <= 5 else 'many'}" if letters == 0 else f"groups={_bucket(len(groups), (1, 2, 3, 5))}+")
    out += [f"left={_kind_of_char(left)}", f"right={_kind_of_char(right)}", f"first={_kind_of_char(s[:1])}", f"last={_kind_of_char(s[-1:])}", f"atoms={_bucket(n_atoms, (2, 4, 7, 10, 14, 18, 24))}"]
    if letters:
        low = s.lower()
        marks = len(re.findall(r"@|[\[(]at[\])]|(?<= )at(?= )", low)), len(re.findall(r"\.|[\[(]dot[\])]|(?<= )dot(?= )", low))
        tail = re.search(r"[A-Za-z]+$", s)
        out += [f"at={min(marks[0], 2)},dot={min(marks[1], 2)}", f"tail={_bucket(len(tail[0]), (2, 5, 8)) if tail else '-'}", f"spaces={min(s.count(' '), 6)},at={min(marks[0], 2)}"]
    return out


def value_features(s: str) -> list[str]:
    """Checks of the digits themselves, in spans without letters."""
    if any(map(str.isalpha, s)):
        return []
    groups = re.findall("[0-9]+", s)
    out = [f"luhn={luhn(''.join(groups))}"] if 13 <= sum(map(len, groups)) <= 19 else []
    if len(groups) == 4:
        out.append(f"bytes={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


def outside_features(text: str, x: int, y: int) -> list[str]:
    c = text[x]
    return ["out", f"out={_kind_of_char(c)}", f"out_digits={_bucket(y - x, (1, 4, 7, 10, 14)) if c.isdigit() else 0}"]


def starts(text: str, window: list[tuple[int, int]]) -> list[int]:
    """Places in a window of atoms at which a span that ends with its last atom may start."""
    out: list[int] = []
    if not text[window[-1][1] - 1].isalnum():
        return out
    digits = seeds = 0
    for k in range(len(window) - 1, max(-1, len(window) - 1 - MOST_ATOMS), -1):
        u, v = window[k]
        c = text[u]
        if c == "\n":
            break
        digits += v - u if "0" <= c <= "9" else 0
        seeds += c == "@" or v - u <= 3 and text[u:v].lower() in ("at", "dot")
        if (digits >= 4 or seeds) and (c.isalnum() or c in "+("):
            out.append(k)
    return out


def lattice(text: str, a: int, b: int) -> Lattice:
    out = Lattice([m.span() for m in _ATOM.finditer(text, a, b)])
    for j, (x, y) in enumerate(out.atoms):
        out.outside.append(outside_features(text, x, y))
        for i in starts(text, out.atoms[: j + 1]):
            out.spans.append((i, j + 1))
            out.features.append(span_features(text, out.atoms[i][0], y, j + 1 - i))
    return out


# --- the random field ------------------------------------------------------------------------------------------

_N = len(KINDS) + 1  # label 0 is outside
#: Shapes of spans whose scores a task keeps.
SHAPES = 50_000
_NINES = str.maketrans("012345678", "9" * 9)


@dataclass
class Field:
    """Weights by feature (a row per feature, a column per label) and of transitions between labels."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    known: dict = field(default_factory=dict)

    def total(self, names: list[str]) -> np.ndarray:
        return self.weights[[i for n in names if (i := self.index.get(n)) is not None]].sum(axis=0)

    def of_span(self, text: str, a: int, b: int, n_atoms: int) -> np.ndarray:
        """The score of a span by label; what its shape gives is worked out once for each shape."""
        shape = text[a - 1 : a], text[a:b].translate(_NINES), text[b : b + 1], n_atoms
        if (score := self.known.get(shape)) is None:
            if len(self.known) >= SHAPES:
                self.known.clear()
            score = self.known[shape] = self.total(shape_features(*shape))
        checks = value_features(text[a:b])
        return score + self.total(checks) if checks else score

    def scores(self, of: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """(spans x kinds, atoms): scores of entities and of atoms outside."""
        inside = np.array([self.total(f)[1:] for f in of.features]).reshape(len(of.spans), _N - 1)
        return inside, np.array([self.total(f)[0] for f in of.outside])

    def arcs(self, of: Lattice) -> tuple[list[list[tuple[int, np.ndarray]]], np.ndarray]:
        """For each end place its arcs (start place, scores by label); labels that an arc cannot have score -inf."""
        inside, outside = self.scores(of)
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(len(of.atoms) + 1)]
        for k, (i, j) in enumerate(of.spans):
            out[j].append((i, np.concatenate([[-np.inf], inside[k]])))
        for i, s in enumerate(outside):
            out[i + 1].append((i, np.array([s] + [-np.inf] * (_N - 1))))
        return out, inside

    def decode(self, text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, label) of the entities of the best segmentation of a region.

        Kept are the last MOST_ATOMS places, as arcs reach no further back, and the atoms and back pointers since
        the place that all paths of the window come from; what lies before that is given out.
        """
        atoms: list[tuple[int, int]] = []  # since the settled place
        best = [np.where(np.arange(_N) == 0, 0.0, -np.inf)]
        back: list[list[tuple[int, int] | None]] = [[None] * _N]  # by place and label: atoms of the last segment, label before it
        outside: dict[tuple, float] = {}
        tried = 0

        def path(j: int, y: int) -> list[tuple[int, int, int]]:
            out = []
            while j:
                n, before = back[j][y]
                if y:
                    out.append((atoms[j - n][0], atoms[j - 1][1], y))
                j, y = j - n, before
            return out[::-1]

        for m in _ATOM.finditer(text, a, b):
            x, y = m.span()
            atoms.append((x, y))
            key = tuple(outside_features(text, x, y))
            if key not in outside:
                outside[key] = float(self.total(list(key))[0])
            j = len(atoms)
            low = max(0, j - MOST_ATOMS)
            spans = [low + k for k in starts(text, atoms[low:j])]
            froms = [j - 1, *spans]
            s = np.full((len(froms), _N), -np.inf)
            s[0, 0] = outside[key]
            for row, i in enumerate(spans, 1):
                s[row, 1:] = self.of_span(text, atoms[i][0], y, j - i)[1:]
            step = (np.array([best[i] for i in froms])[:, :, None] + self.moves[None] + s[:, None, :]).reshape(-1, _N)
            top = step.argmax(axis=0)
            best.append(step[top, np.arange(_N)])
            back.append([(j - froms[t // _N], t % _N) if np.isfinite(v) else None for t, v in zip(top.tolist(), best[-1], strict=True)])
            if j - tried >= SETTLE:
                tried = j
                alive = {(p, y) for p in range(max(0, j - MOST_ATOMS + 1), j + 1) for y in range(_N) if np.isfinite(best[p][y])}
                while len(alive) > 1:
                    p, y = max(alive)
                    alive.remove((p, y))
                    n, y = back[p][y]
                    alive.add((p - n, y))
                ((p, y),) = alive
                if p:
                    yield from path(p, y)
                    del atoms[:p], best[:p], back[:p]
                    back[0], tried = [None] * _N, j - p
                    best[0] = np.where(np.arange(_N) == y, best[0], -np.inf)
        yield from path(len(atoms), int(best[-1].argmax()))

    def learn(self, of: Lattice, gold: list[tuple[int, int, int]], rate: float) -> float:
        """One step up the log-likelihood of a segmentation; returns that likelihood before the step."""
        arcs, _ = self.arcs(of)
        n = len(of.atoms)
        forward = np.full((n + 1, _N), -np.inf)
        forward[0, 0] = 0
        for j in range(1, n + 1):
            forward[j] = _log_sum(np.concatenate([forward[i][:, None] + self.moves + s[None, :] for i, s in arcs[j]]))
        backward = np.full((n + 1, _N), -np.inf)
        backward[n] = 0
        into: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                backward[j] = _log_sum(np.concatenate(into[j]).T.reshape(_N, -1).T)
            for i, s in arcs[j]:
                into[i].append((self.moves + (s + backward[j])[None, :]).T)
        z = _log_sum(forward[n][:, None])[0]
        names = {(i, j, y): f for (i, j), f in zip(of.spans, of.features, strict=True) for y in range(1, _N)}
        names |= {(i, i + 1, 0): f for i, f in enumerate(of.outside)}
        path, at, last, value = [], 0, 0, 0.0
        for i, j, y in [*gold, (n, n, None)]:
            path += [(k, k + 1, 0) for k in range(at, i)]
            if y is not None:
                path.append((i, j, y))
            at = j
        step, moved = Counter(), np.zeros_like(self.moves)
        score = {(i, j): s for j in range(1, n + 1) for i, s in arcs[j] if np.isfinite(s[1:]).any()} | {(j - 1, j, 0): s for j in range(1, n + 1) for i, s in arcs[j] if np.isfinite(s[0])}
        for i, j, y in path:
            value += self.moves[last, y] + (score[i, j, 0][0] if y == 0 else score[i, j][y])
            moved[last, y] += 1
            last = y
            for f in names[i, j, y]:
                step[f, y] += 1
        for j in range(1, n + 1):
            for i, s in arcs[j]:
                p = np.exp(forward[i][:, None] + self.moves + (s + backward[j])[None, :] - z)
                moved -= p
                for y in np.flatnonzero(p.sum(axis=0) > 1e-6):
                    for f in names[i, j, int(y)]:
                        step[f, int(y)] -= p[:, y].sum()
        for (f, y), v in step.items():
            if f in self.index:
                self.weights[self.index[f], y] += rate * v
        self.moves += rate * moved
        return value - z


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


# --- learning --------------------------------------------------------------------------------------------------


def rewritten(kind: str, s: str, rng: random.Random) -> str:
    """The same datum in a form that the patterns miss, or as it is."""
    if rng.random() < 0.15:
        return s
    groups = re.findall("[0-9]+", s)
    if kind == "email":
        local, _, domain = s.partition("@")
        at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", " dot "), (" at ", " dot ")])
        made = local + at + domain.replace(".", dot)
        return made.upper() if rng.random() < 0.2 else made
    if kind == "ip":
        return rng.choice([" . ", "[.]", "-", "(.)"]).join(groups)
    if kind == "card":
        d = _digits(s)
        return rng.choice([".", " - ", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = _digits(s)[-10:]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00 1 {} {} {}", "({}){} {}", "+1/{}/{}/{}"]).format(d[:3], d[3:6], d[6:])


def examples(rows: list[tuple[str, list[Span]]], rng: random.Random, most: int) -> list[tuple[str, int, int, list[Span]]]:
    """(text, region start, region end, spans in it) of rewritten spans and of regions without any."""
    out = []
    for text, spans in rows:
        for kind, a, b in spans:
            left, right = text[max(0, a - 12) : a], text[b : b + 12]
            if any(x < b + 12 and y > a - 12 and (x, y) != (a, b) for _, x, y in spans):
                continue
            form = rewritten(kind, text[a:b], rng)
            made = left + form + right
            whole = (kind, len(left), len(left) + len(form))
            for x, y in regions(made, []):
                if x <= whole[1] and y >= whole[2]:
                    out.append((made, x, y, [whole]))
        out += [(text, x, y, []) for x, y in list(regions(text, spans))[:3] if y - x < 200]
    rng.shuffle(out)
    return out[:most]


def learn(rows: list[tuple[str, list[Span]]], most: int = REGIONS, epochs: int = EPOCHS) -> Field | None:
    rng = random.Random(6)
    ready = []
    for text, a, b, spans in examples(rows, rng, most):
        of = lattice(text, a, b)
        starts, ends = {x: i for i, (x, _) in enumerate(of.atoms)}, {y: i + 1 for i, (_, y) in enumerate(of.atoms)}
        gold = [(starts.get(x, -1), ends.get(y, -1), 1 + KINDS.index(k)) for k, x, y in spans]
        if all(g[:2] in of.spans for g in gold):
            ready.append((of, gold))
    if not any(gold for _, gold in ready):
        return None
    seen = Counter(f for of, _ in ready for fs in (*of.features, *of.outside) for f in fs)
    index = {f: i for i, f in enumerate(sorted(seen))}
    model = Field(index, np.zeros((len(index), _N)), np.zeros((_N, _N)))
    for epoch in range(epochs):
        rng.shuffle(ready)
        for of, gold in ready:
            model.learn(of, gold, 0.3 / (1 + epoch))
    return model


# --- Spark -----------------------------------------------------------------------------------------------------


def all_spans(text: str, model: Field | None) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if model is not None:
        for a, b in regions(text, base):
            out += [(KINDS[y - 1], x, z, False) for x, z, y in model.decode(text, a, b)]
    return sorted(out, key=_order)


def may_hold(text: Column) -> Column:
    """False only for texts in which nothing can be found."""
    return text.rlike(SEED)


def spans(text: Column, model: Field | None) -> Column:
    """array<struct<kind, start, end, base>>, sorted by start and kind; empty for null."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long, base: boolean>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in all_spans(t, model)] if t else [] for t in texts], dtype=object)

    return found(F.when(may_hold(text), text))


def fit(docs: DataFrame, size: int = SAMPLE) -> Field | None:
    """Learns from a sample of texts with seeds, of some `size` to 8 * `size` documents where there are as many.

    Only sampled texts are searched. The rate starts at 4 * size of all documents and is raised while fewer than half
    of `size` have seeds.
    """
    shared.small_batches(docs.sparkSession)
    spread = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30))
    rate = min(1.0, 4 * size / max(docs.count(), 1))
    while True:
        chosen = docs.select("doc_id", "text", spread.alias("spread")).where(F.col("spread") < int(rate * (1 << 30))).where(may_hold(F.col("text")))
        # windows around seeds only, so long texts do not reach the driver whole
        windows = chosen.select("spread", "doc_id", F.explode(F.array_distinct(_windows(F.col("text")))).alias("w")).orderBy("spread", "doc_id", "w").limit(4 * size)
        rows = windows.collect()
        if rate == 1 or len({r.doc_id for r in rows}) * 2 >= size or len(rows) == 4 * size:
            texts = dict.fromkeys(r.w for r in rows)  # copies teach once
            return learn([(w, base_spans(w)) for w in texts])
        rate = min(1.0, 8 * rate)


def _windows(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\n]{0,60}(?:[0-9]{2}|@)[^\n]{0,60}"), F.lit(0))


def find(docs: DataFrame, model: Field | None) -> DataFrame:
    """docs with a column pii of spans."""
    shared.small_batches(docs.sparkSession)
    return docs.withColumn("pii", spans(docs["text"], model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    base = F.filter("pii", lambda s: s["base"])

    def listed(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
