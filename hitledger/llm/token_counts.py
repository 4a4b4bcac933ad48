"""Token counts of a unigram vocabulary without making the tokens."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from . import common as C

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
PENALTY = 10.0
MEMO, LONGEST = 300_000, 48


class Counter:
    """Best score and piece count of a text under a unigram vocabulary.

    The rules are those of the public unigram tokenizers: a space is a mark, one
    more leads the text; of ways to the same place with equal scores the one
    whose last piece begins first stays; a character that is no piece scores the
    least score less 10 and counts its UTF-8 bytes.
    """

    _made: dict[str, Counter] = {}

    def __init__(self, pieces: dict[str, float]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        if pieces:
            self.matches.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        # without a piece that runs on past a space mark, segments are independent
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.memo: dict[str, tuple[float, int]] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
            cls._made[path] = cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not special(i)})
        return cls._made[path]

    def best(self, text: str) -> tuple[float, int]:
        """Viterbi over the places of the text; each carries its best score and how many pieces led there."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.matches.iter(text) if len(self.matches) else ():
            ends[last + 1].append(match)
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, count, single = None, 0, False
            for length, score in sorted(ends[end], reverse=True):  # the longest piece begins first
                single |= length == 1
                total = scores[end - length] + score
                if top is None or total > top:
                    top, count = total, counts[end - length] + 1
            if not single:
                total = scores[end - 1] + self.unknown
                if top is None or total > top:
                    top, count = total, counts[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            scores[end], counts[end] = top, count
        return scores[n], counts[n]

    def count(self, text: str) -> dict:
        if not text:
            return {"n": 0, "score": 0.0}
        marked = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            score, n = self.best(marked)
            return {"n": n, "score": score}
        memo, score, n = self.memo, 0.0, 0
        for w in SEGMENT.findall(marked):
            got = memo.get(w)
            if got is None:
                got = self.best(w)
                if len(w) <= LONGEST:
                    memo[w] = got
            score += got[0]
            n += got[1]
        if len(memo) > MEMO:
            memo.clear()
        return {"n": n, "score": score}


def count_tokens(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Every row with ``n_tokens`` and ``token_score``; null and empty texts have 0.

    ``model`` is a vocabulary file whose pieces and scores are read as a unigram
    model. Whole texts are counted, a word at a time, and a task keeps the
    counts of up to 300,000 words. Input columns of those names are replaced;
    repeated rows are counted each.
    """
    C.session(docs)
    run = C.per_text(lambda: Counter.of(model).count, "struct<n:bigint,score:double>")
    return C.unpack(C.rows(docs, _found=run(C.quoted(text_col))), n_tokens=F.col("_found.n"), token_score=F.col("_found.score"))
