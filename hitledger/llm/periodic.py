"""Periodic runs of words: stretches that repeat themselves at least three times.

A run of period q is a stretch of q * 3 words or more, 24 at least, in which
words q apart are identical, q is the smallest such number and neither
neighbouring word goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

LEAST, TIMES = 24, 3
# a run of any period up to this many words matches its own copy, one period back, in as many words at least
WINDOW = LEAST * (TIMES - 1) // TIMES
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def pairs(ids: np.ndarray, apart: int) -> np.ndarray:
    """Numbers of the windows made of two windows ``apart`` words from each other; -1 where one occurs once only."""
    left, right = ids[: max(0, len(ids) - apart)], ids[apart:]
    out = np.full(len(left), -1, dtype=np.int64)
    again = np.flatnonzero((left >= 0) & (right >= 0))
    codes = pd.factorize(left[again] * (int(ids.max(initial=0)) + 1) + right[again])[0]
    out[again] = np.where(np.bincount(codes, minlength=1)[codes] > 1, codes, -1)
    return out


def occurrences(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Places of words with lags at which an earlier occurrence can continue a run: (word, lag, words that match up to it).

    An occurrence is looked for with the words before it, in windows: of 16
    words for lags up to 16, of twice as many for lags up to twice that, and so
    on. In a run a window of a period or more occurs at multiples of the period
    only, so of all earlier occurrences the nearest one is the run's; and no run
    is too short for its window. Frequent words therefore cost no more than
    others: each word has one lag at most per window length.
    """
    n, k, found = len(ids), 1, []
    windows = np.where(np.bincount(ids, minlength=1)[ids] > 1, ids, -1)
    while (k <= WINDOW or TIMES * (k // 2 + 1) <= n) and (windows >= 0).any():
        if k >= WINDOW:
            at = np.flatnonzero(windows >= 0)
            order = at[np.argsort(windows[at], kind="stable")]
            same = windows[order[1:]] == windows[order[:-1]]
            start, lag = order[1:][same], (order[1:] - order[:-1])[same]
            fits = (lag <= k) & (lag > (k // 2 if k > WINDOW else 0))
            found.append(np.stack([start[fits] + k - 1, lag[fits], np.full(fits.sum(), k)], axis=1))
        windows = pairs(windows, k)
        k *= 2
    if not found:
        return []
    events = np.concatenate(found)
    return events[np.lexsort((events[:, 1], events[:, 0]))].tolist()


def runs_of(events: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Walk the words once: each occurrence lengthens its lag's diagonal; a diagonal that ends long enough is a run.

    Only diagonals that the word before has lengthened are held.
    """
    active: dict[int, int] = {}
    grown: dict[int, int] = {}
    at = -1

    def ended(diagonals: dict[int, int], end: int, going: dict[int, int]) -> Iterator[tuple[int, int, int]]:
        for lag, length in diagonals.items():
            if lag not in going and length >= max((TIMES - 1) * lag, LEAST - lag):
                yield end - length - lag, length + lag, lag

    for word, lag, window in events:
        if word != at:
            yield from ended(active, at, grown)
            if word == at + 1:
                active = grown
            else:
                yield from ended(grown, at + 1, {})
                active = {}
            grown, at = {}, word
        grown[lag] = active.get(lag, window - 1) + 1
    yield from ended(active, at, grown)
    yield from ended(grown, at + 1, {})


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length by period; of equals the first one, then the one of the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words, repeated from some place on for one ``h`` in ten: a known run in a known document."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def scan(text: bytes, h: int | None) -> dict:
    words = text.split()  # bytes split at space and \x09-\x0D, no more and no less
    if h is not None:
        words = planted(words, h)
    found = sorted(runs_of(occurrences(pd.factorize(np.array(words, dtype=object))[0]))) if len(words) >= LEAST else []
    found.sort(key=lambda r: (r[0], r[2]))
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    top = longest(found)
    rows = [dict(zip(("start", "length", "period"), r)) for r in found]
    best = None if top is None else dict(zip(("start", "length", "period"), top))
    return {"n_words": len(words), "runs": rows, "longest": best, "collapsed": b" ".join(w for w, k in zip(words, keep) if k) if found else b" ".join(words)}


def find_runs(docs: DataFrame, text_col: str = "text", plant: Column | None = None) -> DataFrame:
    """Every row with n_words, runs (by start, then period), longest run, and collapsed: the words without repeats, joined by one space.

    Words are parted by space and \\x09-\\x0D; whole texts are walked, of any
    length, in memory that grows with the longest text's words. A word is left
    out of ``collapsed`` if any run holds it after its first period. Null and
    empty texts have no words, no runs, a null longest run and an empty
    collapsed text. Ties of the longest run go to the smaller start, then the
    smaller period. Repeated rows are walked each; an empty table gives an empty
    one. Input columns of those names are replaced, others kept. ``plant`` is a
    number per row from which ``planted`` makes runs (null: none).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    C.session(docs)
    kind = f"struct<n_words:bigint,runs:{RUNS},longest:{RUNS[6:-1]},collapsed:binary>"
    target = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, seed in batches:
            yield pa.array([scan(t or b"", h) for t, h in zip(text.to_pylist(), seed.to_pylist())], type=target)

    seed = F.lit(None) if plant is None else plant
    found = C.rows(docs, _found=run.asNondeterministic()(C.quoted(text_col).cast("binary"), seed.cast("bigint")))
    value = F.col("_found")
    return C.unpack(found, n_words=value["n_words"], runs=value["runs"], longest=value["longest"], collapsed=value["collapsed"].cast("string"))
