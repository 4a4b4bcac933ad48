"""Benchmark passages in training documents: BM25 with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import common as C

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n]+\s*")
K1, B = 1.2, 0.75
# postings in one block; ranges of items that have a bound of their own; items and bytes of text in one index
BLOCK, RANGES, ITEMS, BYTES = 32, 32, 4096, 8 << 20
RUN = 3
# a side of so many words is compared by single words
SHORT = 4
# share of the item's runs, or of those of its question, at which the passage holds it whatever the answer; of a question of so many words at least
WHOLE, ASKED, LONG = 0.6, 0.9, 8
FOUND = "array<struct<item:int,score:double,question:double,answer:double,word:int>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def runs(words: list[str], length: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def overlap_with(side: list[str], passage: list[str]) -> float:
    """Share of the side's runs of words (of its words, where it is short) that the passage has."""
    length = RUN if len(side) > SHORT else 1
    own = runs(side, length)
    return len(own & runs(passage, length)) / len(own) if own else 1.0


def whole_with(item: list[str], passage: list[str]) -> float:
    """Share of the item's runs of words (all of it, where shorter) that the passage has."""
    length = min(RUN, len(item))
    own = runs(item, length)
    return len(own & runs(passage, length)) / len(own) if length else 0.0


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item up to its last sentence, and of that sentence; of a single sentence the last quarter is the answer."""
    parts = [w for w in map(words_of, SENTENCE_END.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    cut = max(1, len(only) * 3 // 4)
    return only[:cut], only[cut:]


def held(question: list[str], answer: list[str], passage: list[str]) -> bool:
    """Most of the item, or a long question nearly word for word, as where a copy is changed or cut off in its answer."""
    return whole_with(question + answer, passage) >= WHOLE or (len(question) >= LONG and whole_with(question, passage) >= ASKED)


class Index:
    """Inverted index of items of similar length; an item's scores are shares of its score against itself.

    ``frequency`` (items that have a word), ``count`` and ``mean`` (words of an
    item) are those of the whole benchmark, so an item's scores do not depend on
    which other items share its index.
    """

    def __init__(self, texts: list[str], number: dict[str, int], frequency: dict[str, int], count: int, mean: float):
        items = [words_of(t) for t in texts]
        self.span = max(map(len, items))
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, ws in enumerate(items):
            gain = {}
            for w, n in Counter(ws).items():
                rare = math.log(1 + (count - frequency[w] + 0.5) / (frequency[w] + 0.5))
                gain[w] = rare * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean))
            own = sum(gain.values())
            for w, g in gain.items():
                postings.setdefault(w, []).append((i, g / own))
        self.terms = {number.setdefault(w, len(number)): k for k, w in enumerate(postings)}
        self.at = [[i for i, _ in p] for p in postings.values()]
        self.gain = [[g for _, g in p] for p in postings.values()]
        self.block_last = [[p[min(k + BLOCK, len(p)) - 1][0] for k in range(0, len(p), BLOCK)] for p in postings.values()]
        self.block_most = [[max(g for _, g in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in postings.values()]
        self.most = [max(g) for g in self.gain]
        self.sides = [question_and_answer(t) for t in texts]
        width = -(-len(items) // RANGES)
        self.bound = np.zeros((len(postings) + 1, -(-len(items) // width)), dtype=np.float32)
        for k, p in enumerate(postings.values()):
            for i, g in p:
                self.bound[k, i // width] = max(self.bound[k, i // width], g)
        self.top = self.bound.max(axis=1)

    def search(self, terms: list[int], limit: float) -> list[tuple[int, float]]:
        """Every item whose score reaches ``limit``, by block-max WAND."""
        at, gain, most = self.at, self.gain, self.most
        lists = [[at[t][0], 0, t] for t in terms]  # current item, place, term
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += most[t]
                if total >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, ends = 0.0, []
            for _, _, t in lists[: pivot + 1]:
                b = bisect_left(self.block_last[t], item)
                if b < len(self.block_last[t]):
                    bound += self.block_most[t][b]
                    ends.append(self.block_last[t][b] + 1)
            if bound < limit:
                to = min(ends, default=1 << 60)
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, item + 1)
                moved = range(pivot + 1)
            elif lists[0][0] == item:
                score = sum(gain[t][p] for i, p, t in lists[: pivot + 1])
                if score >= limit:
                    found.append((item, score))
                to, moved = item + 1, range(pivot + 1)
            else:
                to, moved = item, [k for k in range(pivot + 1) if lists[k][0] < item]
            for k in moved:
                _, p, t = lists[k]
                p = bisect_left(at[t], to, p)
                lists[k] = [at[t][p], p, t] if p < len(at[t]) else None
            lists = [x for x in lists if x]
        return found

    def passages(self, ids: np.ndarray) -> np.ndarray:
        """Windows of twice the longest item every such length, so each place of an item lies in one."""
        span, n = self.span, len(ids)
        starts = max(1, -(-n // span))
        padded = np.full((starts + 1) * span, -1, dtype=np.int64)
        padded[:n] = ids
        return np.lib.stride_tricks.sliding_window_view(padded, 2 * span)[::span]

    def hopeful(self, rows: np.ndarray, limit: float) -> np.ndarray:
        """Windows (sorted terms, -1 for none) in which some range of items can reach the limit."""
        rows = rows.copy()
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
        most = np.flatnonzero(self.top[rows].sum(axis=1) >= limit - 1e-3)
        near = [self.bound[rows[most[k : k + 64]]].sum(axis=1).max(axis=1) >= limit - 1e-3 for k in range(0, len(most), 64)]
        return most[np.concatenate(near)] if near else most

    def matches(self, words: list[str], ids: np.ndarray, limit: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """Item, score, overlap of question and of answer, and first word of the passage."""
        best: dict[int, tuple] = {}
        rows = np.sort(self.passages(ids), axis=1)
        for k in self.hopeful(rows, limit):
            for item, score in self.search([int(t) for t in np.unique(rows[k]) if t >= 0], limit):
                passage = words[k * self.span : (k + 2) * self.span]
                question, answer = (overlap_with(side, passage) for side in self.sides[item])
                if (question >= overlap and answer >= overlap) or held(*self.sides[item], passage):
                    best[item] = max(best.get(item, (0.0,)), (score, question, answer, int(k) * self.span))
        return [(i, *v) for i, v in sorted(best.items())]


class Matcher:
    """All indexes over one vocabulary, so a text is read once."""

    def __init__(self, parts: list[tuple[list, list[str], dict[str, int]]], count: int, mean: float):
        self.number: dict[str, int] = {}
        self.parts = [(ids, Index(texts, self.number, frequency, count, mean)) for ids, texts, frequency in parts]
        # each index numbers its own terms; the last place stands for words it does not have
        self.own = []
        for _, index in self.parts:
            to = np.full(len(self.number) + 1, -1, dtype=np.int64)
            to[list(index.terms)] = list(index.terms.values())
            self.own.append(to)

    def leaks(self, text: str, limit: float, overlap: float) -> list[tuple]:
        words = words_of(text)
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        if not len(ids) or ids.max() < 0:
            return []
        found = []
        for (names, index), own in zip(self.parts, self.own):
            found += [(names[i], *rest) for i, *rest in index.matches(words, own[ids], limit, overlap)]
        return sorted(found)


def counted(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, float]:
    """Items that have words, each with the number of items that have each of its words; number of items and their mean length."""
    words = C.per_text(lambda: words_of, "array<string>")(C.quoted(text_col))
    items = benchmark.select(C.quoted(id_col).alias("id"), C.quoted(text_col).alias("text"), words.alias("words")).where(F.size("words") > 0)
    # a number that is written down with the row, so it stays the same
    items = materialize(items.withColumn("n", F.monotonically_increasing_id()), "items")
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    pairs = items.select("n", F.explode(F.array_distinct("words")).alias("word"))
    frequency = pairs.groupBy("word").agg(F.count("*").alias("items"))
    own = pairs.join(frequency, "word").groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("word", "items"))).alias("frequency"))
    size = F.ceil(F.log2(F.length("text") + 1.0)).alias("_class")
    return materialize(items.join(own, "n").select("id", "text", "frequency", size), "counted"), total["n"], total["mean"] or 0.0


def blocks(items: DataFrame):
    """The benchmark in bounded parts of items of similar length, each as ids, texts and frequencies of their words."""
    for r in items.groupBy("_class").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("_class").collect():
        parts = max(-(-r["n"] // ITEMS), -(-r["bytes"] // BYTES))
        for k in range(parts):
            own = items.where((F.col("_class") == r["_class"]) & (F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)).orderBy("id", "text").collect()
            if own:
                yield [x["id"] for x in own], [x["text"] for x in own], {w: n for x in own for w, n in x["frequency"].items()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """Every row with ``leaks``: the benchmark items that one of its passages holds.

    Each passage of the whole text queries the items; all items whose BM25 score
    reaches ``limit`` of their score against themselves are retrieved, and those
    of whose question and answer runs of three words a share of ``overlap``
    occurs in the passage are kept, with the best passage's figures. A side of
    at most four words is compared by words. An item is kept too if 0.6 of all
    its runs, or 0.9 of those of a question of eight words or more, occur,
    whatever became of its answer. Items
    without words, null and empty texts match nothing; an item that occurs
    twice is reported twice; an input column named ``leaks`` is replaced.

    Document frequencies and the mean length are counted over the whole
    benchmark. Items of similar length are indexed together. What is broadcast
    and loaded at a time is bounded: after 4,096 items or 8 MB of text, the rows
    found so far are written and the next part of the benchmark is another pass
    over them. Whole texts of any length are read, in passages; an empty table
    or an empty benchmark gives rows without leaks.
    """
    spark = C.session(docs)
    kind = FOUND.replace("item:int", f"item:{dict(benchmark.dtypes)[item_id]}")
    items, count, mean = counted(benchmark, item_id, item_text)
    found = C.rows(docs, _text=C.quoted(text_col), _leaks=F.array().cast(kind))

    def matched(parts) -> DataFrame:
        shared = spark.sparkContext.broadcast(parts)

        def start():
            matcher = Matcher(shared.value, count, mean)
            return lambda text: matcher.leaks(text, limit, overlap)

        return found.select("_row", "_text", F.concat("_leaks", C.per_text(start, kind)("_text")).alias("_leaks"))

    parts, size = [], 0
    for part in blocks(items):
        if parts and (size + sum(map(len, part[1])) > BYTES or sum(len(p[0]) for p in parts) + len(part[0]) > ITEMS):
            found = materialize(matched(parts), "leaks")
            parts, size = [], 0
        parts.append(part)
        size += sum(map(len, part[1]))
    return C.unpack(matched(parts) if parts else found, leaks=F.col("_leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that hold no benchmark item, with the input's columns."""
    found = decontaminate(C.rows(docs, _text=C.quoted(text_col)), benchmark, "_text", **options)
    return C.unpack(found.where(F.size("leaks") == 0))
