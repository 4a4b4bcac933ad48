"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
# the fit reads at most this many labelled documents, chosen by a hash of their id
MAX_TRAIN, STEPS, DECAY = 6000, 300, 1e-2
# a word is an input if families of toxic documents have it so many times as often, with this log-likelihood ratio
TIMES, EVIDENCE = 3.0, 15.0
# beside whole words, their proper prefixes of these lengths: compounds of one stem count together
PREFIXES = range(4, 10)
MEMO = 200_000
FLOOR = -20.0


def inputs(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in PREFIXES if k < len(word)]]


@dataclass(frozen=True)
class Model:
    """Sentence log-odds are ``bias`` plus its words' weights; noisy-or over sentences; then a logistic scale."""

    weights: dict[str, float]
    bias: float
    slope: float
    offset: float
    memo: dict[str, float] = field(default_factory=dict, compare=False)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of every sentence that has words."""
        memo, low, found = self.memo, text.lower(), []
        same = len(low) == len(text)  # else lower case has moved the places
        for m in SENTENCE.finditer(low if same else text):
            words = WORD.findall(m[0] if same else m[0].lower())
            if words:
                found.append((*m.span(), self.bias + sum([memo[w] if w in memo else self.weigh(w) for w in words])))
        return found

    def weigh(self, word: str) -> float:
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[word] = total = sum(self.weights.get(f, 0.0) for f in inputs(word))
        return total

    def score(self, log_odds: np.ndarray) -> float:
        return float(scaled(noisy_or(log_odds), self.slope, self.offset))


def softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def noisy_or(log_odds: np.ndarray) -> float:
    """Log-odds that at least one sentence is toxic: of 1 - prod(1 - p)."""
    none = float(softplus(log_odds).sum()) if len(log_odds) else 0.0  # -log of the product
    return max(FLOOR, none if none > 30 else float(np.log(np.expm1(none))) if none > 1e-12 else FLOOR)


def scaled(z, slope: float, offset: float):
    return 1 / (1 + np.exp(-np.clip(slope * z + offset, -500, 500)))


def families(texts: list[str], labels: np.ndarray, keys: int = 12, length: int = 5, agree: int = 9) -> np.ndarray:
    """Number of each text's family: the first text of the same label that has ``agree`` of its least hashes of word runs.

    Each text is held against the first of every family, so a chain of passages joins nothing.
    """
    number: dict[str, int] = {}
    seeds = np.random.default_rng(7).integers(1, 2**63, size=(keys, 2), dtype=np.uint64) | np.uint64(1)
    heads = {y: (np.zeros((len(texts), keys), dtype=np.uint64), []) for y in set(labels.tolist())}
    family = np.arange(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        ids = np.array([number.setdefault(w, len(number) + 1) for w in WORD.findall(text.lower())], dtype=np.uint64)
        runs = ids[: max(1, len(ids) - length + 1)].copy()
        for k in range(1, min(length, len(ids))):
            runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(runs)]
        if not len(runs):
            continue
        mixed = runs * seeds[:, :1]
        least = ((mixed ^ (mixed >> np.uint64(31))) * seeds[:, 1:]).min(axis=1)
        signs, first = heads[int(labels[i])]
        same = np.flatnonzero((signs[: len(first)] == least).sum(axis=1) >= agree)
        if len(same):
            family[i] = first[same[0]]
        else:
            signs[len(first)] = least
            first.append(i)
    return family


def evidence(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Words and stems that tell toxic documents from others, with the log of how many times as often they have it."""
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    counts = (Counter(), Counter())
    for t, y in zip(texts, labels):
        counts[y].update({f for w in set(WORD.findall(t.lower())) for f in inputs(w)})
    found = {}
    for f, k1 in counts[1].items():
        k0 = counts[0][f]
        times = (k1 / n[1]) / ((k0 + 0.5) / n[0])
        if times < TIMES:
            continue
        share = (k0 + k1) / n.sum()
        terms = ((k0, n[0] * share), (k1, n[1] * share), (n[0] - k0, n[0] * (1 - share)), (n[1] - k1, n[1] * (1 - share)))
        ratio = 2 * sum(o * math.log(o / e) for o, e in terms if o > 0)
        if ratio >= EVIDENCE:
            found[f] = (ratio, math.log(times))
    # of a word and its stems, the one that tells most
    kept: dict[str, float] = {}
    for f in sorted(found, key=lambda f: (-found[f][0], -len(f.strip("^")), f)):
        bare = f.strip("^")
        if not any(bare.startswith(k.strip("^")) or k.strip("^").startswith(bare) for k in kept):
            kept[f] = found[f][1]
    return kept


def bags(texts: list[str], names: list[str]):
    """Words of each sentence as flat arrays: word id, sentence; and the document of each sentence."""
    number = {w: i for i, w in enumerate(names)}
    word, sentence, doc, n = [], [], [], 0
    for k, text in enumerate(texts):
        for m in SENTENCE.finditer(text.lower()):
            if ws := WORD.findall(m[0]):
                ids = [number[f] for w in ws for f in inputs(w) if f in number]
                word += ids
                sentence += [n] * len(ids)
                doc.append(k)
                n += 1
    return np.array(word, dtype=np.int64), np.array(sentence, dtype=np.int64), np.array(doc, dtype=np.int64), n


def fit_bags(texts: list[str], labels: np.ndarray, steps: int = STEPS, decay: float = DECAY) -> Model:
    """Maximum likelihood by Adam.

    A label may be 1 without any toxic sentence; a share of such labels is
    learned too, so they do not raise every sentence's odds.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model({}, FLOOR, 1.0, 0.0)
    # one document of each family: copies of a wrong label prove nothing
    _, once = np.unique(families(texts, labels), return_index=True)
    texts, labels = [texts[i] for i in once], labels[once]
    told = evidence(texts, labels)
    names = list(told)
    word, sentence, doc, n = bags(texts, names)
    y = labels.astype(float)
    w = np.zeros(len(names) + 2)  # words, bias, log-odds of a label without cause
    w[:-2], w[-2], w[-1] = list(told.values()), -6.0, -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-2] + np.bincount(sentence, weights=w[word], minlength=n)
        none = np.bincount(doc, weights=softplus(z), minlength=len(y))
        noise = 1 / (1 + np.exp(-w[-1]))
        clean = (1 - noise) * np.exp(-none)  # chance of label 0
        toxic = np.maximum(1 - clean, 1e-12)
        pull = np.where(y == 1, -clean / toxic, 1.0)
        gz = pull[doc] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(word, weights=gz[sentence], minlength=len(names)), [gz.sum(), float((pull * noise).sum())]]) / len(y)
        g[:-2] += decay * (w[:-2] - w[:-2].mean()) if len(names) else 0.0  # words share one strength until the labels say otherwise
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w[:-2][np.abs(w[:-2]) < 0.05] = 0.0
    z = w[-2] + np.bincount(sentence, weights=w[word], minlength=n)
    none = np.bincount(doc, weights=softplus(z), minlength=len(y))
    x = np.array([max(FLOOR, s if s > 30 else np.log(np.expm1(s)) if s > 1e-12 else FLOOR) for s in none])
    slope, offset = 1.0, 0.0
    for _ in range(100):  # Newton steps of a two-parameter logistic fit
        p = scaled(x, slope, offset)
        h = p * (1 - p)
        a = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        b = np.array([((y - p) * x).sum() + 1e-3 * (1 - slope), (y - p).sum()])
        d = np.linalg.solve(a, b)
        slope, offset = slope + float(np.clip(d[0], -0.5, 0.5)), offset + float(np.clip(d[1], -2, 2))
    return Model({k: float(w[i]) for i, k in enumerate(names) if w[i]}, float(w[-2]), max(slope, 0.05), offset)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_docs`` labelled rows that are not held out.

    The fit runs in one task on that bounded sample: one row of each labelled
    id, that of the least text where the id repeats. An id labelled both ways
    counts as toxic; null ids and null labels are left out. Without labels of
    both kinds, as on an empty table, every score is 0.
    """
    C.session(docs)
    known = labels.where(C.quoted(label_col).isNotNull() & C.quoted(id_col).isNotNull() & ~held_out(C.quoted(id_col)))
    known = known.groupBy(C.quoted(id_col).alias("_id")).agg(F.max(C.quoted(label_col)).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sample = docs.select(C.quoted(id_col).alias("_id"), F.coalesce(C.quoted(text_col), F.lit("")).alias("_text"))
    # of an id in many rows the least text counts, so the sample has no more rows than ids
    sample = sample.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_text", "_y", F.lit(0).alias("_all"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_text"])
        model = fit_bags(pdf["_text"].tolist(), pdf["_y"].to_numpy())
        rows = [(" bias", model.bias), (" slope", model.slope), (" offset", model.offset), *model.weights.items()]
        return pd.DataFrame(rows, columns=["word", "weight"])

    found = {r["word"]: r["weight"] for r in sample.groupBy("_all").applyInPandas(train, "word string, weight double").collect()}
    if not found:
        return Model({}, FLOOR, 1.0, 0.0)
    bias, slope, offset = (found.pop(" " + n) for n in ("bias", "slope", "offset"))
    return Model(found, bias, slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7, sentence_limit: float = 0.3) -> DataFrame:
    """Every row with toxicity (0 to 1), is_toxic, and toxic_sentences: places and odds of offending sentences.

    Whole texts of any length are scored; null and empty texts have no sentence
    and the least score; an empty table gives an empty one. Only sentences of documents at or over ``limit`` are reported. Input
    columns of those names are replaced; repeated rows are scored each.
    """
    spark = C.session(docs)
    shared = spark.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(text: str) -> dict:
            found = model.sentences(text)
            total = model.score(np.array([z for _, _, z in found]))
            p = [(a, b, float(scaled(z, 1.0, 0.0))) for a, b, z in found if z > -5] if total >= limit else []
            top = max([x[2] for x in p], default=0.0)
            return {"score": total, "spans": [x for x in p if x[2] >= min(sentence_limit, top)]}

        return work

    run = C.per_text(start, "struct<score:double,spans:array<struct<start:int,end:int,probability:double>>>")
    found = C.rows(docs, _found=run(C.quoted(text_col)))
    value = F.col("_found.score")
    return C.unpack(found, toxicity=value, is_toxic=value >= limit, toxic_sentences=F.col("_found.spans"))
