"""Quality of texts by positive-unlabelled learning: known good texts against unlabelled ones, whose share of good ones is estimated."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .toxicity import held_out, softplus

# the fit reads at most this many known good and this many unlabelled documents, chosen by a hash
MAX_TRAIN = 6000
STEPS, RATE, DECAY = 400, 0.05, 3e-4
# a feature is kept if so many documents of the sample have it
LEAST_DOCS = 4
# beside the whole text, its worst stretch of so many words: a text that is good but for one part is not good
STRETCH = 48
MEMO = 200_000
RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, all else as it is; each repeated class once."""
    return RUN.sub(r"\1", "".join(("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c for c in word[:40]))[:8]


@dataclass
class Reader:
    """Features of a text: shapes of words and of neighbours, and repetition, by their share; for the whole and for its stretches."""

    shapes: dict[str, int] = field(default_factory=dict)
    memo: dict[str, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def number(self, word: str) -> int:
        if len(self.memo) > MEMO:
            self.memo.clear()
        s = shape(word)
        n = self.shapes.setdefault(s, len(self.names))
        if n == len(self.names):
            self.names.append(s)
        self.memo[word] = n
        return n

    def features(self, text: str) -> dict[str, float]:
        words = text.split()
        n = len(words)
        if not n:
            return {}
        memo = self.memo
        ids = [memo[w] if w in memo else self.number(w) for w in words]
        out: Counter[str] = Counter()
        singles, pairs = Counter(ids), Counter(zip(ids, ids[1:]))
        for k, count in singles.items():
            out[f"w {self.names[k]}"] = math.sqrt(count / n)
        for (a, b), count in pairs.items():
            out[f"p {self.names[a]} {self.names[b]}"] = math.sqrt(count / n)
        # per stretch: words that repeat one of the two before, and distinct words
        most, least = 0.0, 1.0
        for at in range(0, max(1, n - STRETCH // 2), STRETCH):
            part = words[at : at + STRETCH]
            again = sum(map(str.__eq__, part, part[1:])) + sum(map(str.__eq__, part, part[2:]))
            most, least = max(most, again / len(part)), min(least, len(set(part)) / min(len(part), STRETCH))
        out[f"again {math.ceil(most * 8)}"] = 1.0
        out[f"distinct {math.floor(least * 8)}"] = 1.0
        return out


@dataclass(frozen=True)
class Model:
    """Log-odds of a good text: ``bias`` plus its features' weights."""

    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, features: dict[str, float]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) * x for f, x in features.items())
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))


class Rows:
    """Feature rows as flat arrays."""

    def __init__(self, rows: list[dict[str, float]], number: dict[str, int]):
        kept = [[(number[f], x) for f, x in r.items() if f in number] for r in rows]
        self.n, self.width = len(rows), len(number)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in kept])
        self.col = np.array([f for r in kept for f, _ in r], dtype=np.int64)
        self.val = np.array([x for r in kept for _, x in r])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n) + w[-1]

    def pull(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.col, weights=self.val * g[self.row], minlength=self.width), g.sum())


def adam(gradient, width: int, steps: int, rate: float = RATE) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate_prior(good: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Share of good texts among the unlabelled ones, by the bin of best scores that holds the fewest of the latter.

    Both are scores of texts that a classifier of the two samples has not seen.
    Above any score the unlabelled texts are at least the prior times as many as
    the good ones; where no bad text scores so high they are just that. The
    least such ratio is taken, each widened by its sampling error.
    """
    if not len(good) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(good, np.linspace(0, 0.99, 100)))
    p = 1 - np.searchsorted(np.sort(good), cuts, side="left") / len(good)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    error = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(len(good)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_rows(good: list[dict[str, float]], unlabelled: list[dict[str, float]], prior: float | None = None, steps: int = STEPS) -> Model:
    """Least non-negative risk (logistic loss) of good and unlabelled feature rows.

    The risk of unlabelled texts taken as bad, less the part that the good ones
    among them cause, estimates the risk of the bad ones; it cannot be negative,
    so where the estimate falls below zero the fit turns round instead of
    following it. Without good or unlabelled rows every score is 0.5.
    """
    if not good or not unlabelled:
        return Model({}, 0.0, 0.5)
    seen = Counter(f for r in (*good, *unlabelled) for f in r)
    number = {f: i for i, f in enumerate(sorted(f for f, k in seen.items() if k >= LEAST_DOCS))}
    P, U, width = Rows(good, number), Rows(unlabelled, number), len(number) + 1

    def told_apart(p: Rows, u: Rows) -> np.ndarray:
        return adam(lambda w: u.pull(sigmoid(u.dot(w)) / u.n) - p.pull(sigmoid(-p.dot(w)) / p.n), width, steps // 2)

    if prior is None:
        halves = [(Rows(good[i::2], number), Rows(unlabelled[i::2], number)) for i in (0, 1)]
        if min(h.n for pair in halves for h in pair):
            scores = [(halves[1 - i][0].dot(w), halves[1 - i][1].dot(w)) for i in (0, 1) for w in [told_apart(*halves[i])]]
            prior = float(np.mean([estimate_prior(*s) for s in scores]))
        else:
            prior = 0.5

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = P.dot(w), U.dot(w)
        bad = softplus(zu).mean() - prior * softplus(zp).mean()
        g = U.pull(sigmoid(zu) / U.n) - P.pull(prior * sigmoid(zp) / P.n)
        return -P.pull(prior * sigmoid(-zp) / P.n) + g if bad >= 0 else -g

    w = adam(risk, width, steps)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}, float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_docs`` known good and ``max_docs`` unlabelled documents, read in one task.

    Good ones are labelled 1 and not held out; of an id in many rows the least
    text counts. Of the unlabelled ones only the text is read. Equal texts count
    once. Without either every score is 0.5.
    """
    C.session(docs)
    known = labels.where((C.quoted(label_col) == 1) & C.quoted(id_col).isNotNull() & ~held_out(C.quoted(id_col)))
    known = known.select(C.quoted(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(C.quoted(id_col).alias("_id"), F.coalesce(C.quoted(text_col), F.lit("")).alias("_text"))
    good = rows.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text")).select("_text", F.lit(1).alias("_y"))
    share = min(1.0, 1.1 * max_docs / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("_text", "_id"), F.lit(1 << 40)) <= int(share * (1 << 40))
    sample = good.unionByName(rows.where(chosen).limit(max_docs).select("_text", F.lit(0).alias("_y")))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates().sort_values(["_y", "_text"])
        # a fixed shuffle, so that halves are alike
        pdf = pdf.iloc[np.random.default_rng(11).permutation(len(pdf))]
        reader = Reader()
        model = fit_rows(*[[reader.features(t) for t in pdf.loc[pdf["_y"] == y, "_text"]] for y in (1, 0)])
        rows = [("bias", model.bias), ("prior", model.prior), *[("=" + f, x) for f, x in model.weights.items()]]
        return pd.DataFrame(rows, columns=["name", "value"])

    found = {r["name"]: r["value"] for r in sample.groupBy(F.lit(0).alias("_all")).applyInPandas(train, "name string, value double").collect()}
    return Model({f[1:]: x for f, x in found.items() if f[0] == "="}, found.get("bias", 0.0), found.get("prior", 0.5))


def score(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Every row with quality (0 to 1, higher: better) and is_good (quality of ``limit`` or more).

    Whole texts of any length are scored, each row by its text alone; null and
    empty texts have no features and get the score of the bias; repeated rows
    are scored each and equal texts alike; an empty table gives an empty one.
    Input columns of those names are replaced, others kept.
    """
    shared = C.session(docs).sparkContext.broadcast(model)

    def start():
        reader, model = Reader(), shared.value
        return lambda text: model.score(reader.features(text))

    found = C.rows(docs, _score=C.per_text(start, "double")(C.quoted(text_col)))
    return C.unpack(found, quality=F.col("_score"), is_good=F.col("_score") >= limit)
