"""Secrets in texts: known forms, and strings of high entropy in any window."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from . import common as C
from .spans import SPANS

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
# a candidate is a whole run of these characters
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
# entropy in bits that a window must reach, by the class of the candidate's characters
LIMITS = {"hex": 3.1, "alnum": 3.7, "base64": 3.8}
WINDOW = 20
# what is no secret whatever its entropy: cut out of a candidate wherever it stands
CUT = (
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",  # UUID
    r"(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|placeholder|xxxx|0123456789)[A-Za-z0-9]*",
)
# a part between separators that is a word, a name of words, or a number, with at most a short number behind it
PLAIN = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*|[A-Z]{2,})[0-9]{0,4}|[0-9]+"
# stretches that are no secrets as a whole
ALLOWED = (
    r"[0-9+/_=-]+",  # numbers and dates
    r"[A-Za-z+/_=-]+",  # words, paths and names without a digit
    r"(?i:[a-z]+[0-9]{0,4}[/_=-])*[A-Za-z]+[0-9]{0,4}",  # paths and names of short numbers
)
TERM = [0.0, *[n * math.log2(n) for n in range(1, WINDOW + 1)]]


def windows_over(text: str, limit: float) -> list[tuple[int, int]]:
    """Merged places of the windows whose entropy reaches ``limit``.

    The entropy of a window of w characters is log2(w) - sum(n log2 n) / w over
    its character counts n; sliding changes two counts.
    """
    counts: dict[str, int] = {}
    total, most, found = 0.0, (math.log2(WINDOW) - limit) * WINDOW + 1e-9, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += TERM[n + 1] - TERM[n]
        if i >= WINDOW:
            old = text[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            total += TERM[n - 1] - TERM[n]
        if i >= WINDOW - 1 and total <= most:
            start = i - WINDOW + 1
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def char_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def without(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a stretch when the taken places are cut out."""
    out = []
    for a, b in sorted(taken):
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            break
    return out + [(start, end)] if start < end else out


def stretches(text: str, start: int, end: int, plain: re.Pattern) -> list[tuple[int, int]]:
    """Neighbouring parts that are not plain, with the separators between them."""
    out: list[tuple[int, int]] = []
    joins = False
    for m in re.finditer(r"[^+/_=-]+", text[start:end]):
        if plain.fullmatch(m[0]):
            joins = False
            continue
        if joins:
            out[-1] = (out[-1][0], start + m.end())
        else:
            out.append((start + m.start(), start + m.end()))
        joins = True
    return out


def scanner(allowed: tuple[str, ...] = ALLOWED, cut: tuple[str, ...] = CUT):
    """Function of a text that gives its known forms and its added spans."""
    allow, cuts, plain = [re.compile(p) for p in allowed], [re.compile(p) for p in cut], re.compile(PLAIN)

    def scan(text: str) -> dict:
        base = base_spans(text)
        added = []
        for m in CANDIDATE.finditer(text):
            if any(p.fullmatch(m[0]) for p in allow):
                continue
            taken = [(s, e) for _, s, e in base if s < m.end() and m.start() < e]
            taken += [(m.start() + c.start(), m.start() + c.end()) for p in cuts for c in p.finditer(m[0])]
            for left, right in without(m.start(), m.end(), taken):
                for a, b in stretches(text, left, right, plain):
                    word = text[a:b]
                    if b - a >= WINDOW and not any(p.fullmatch(word) for p in allow):
                        added += [("entropy", a + x, a + y) for x, y in windows_over(word, LIMITS[char_class(word)])]
        return {"base": base, "added": added}

    return scan


def scan_secrets(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, cut: tuple[str, ...] = CUT) -> DataFrame:
    """Every row with ``secrets``: base spans of known forms, added spans of high entropy.

    Whole texts of any length are scanned; offsets are code points, ends
    exclusive. Base spans and what ``cut`` matches are cut out of a candidate,
    and so are parts between separators that are plain words or numbers; each
    stretch that is left is scanned by itself unless ``allowed`` matches it as a
    whole. Null and empty texts have no spans; repeated rows are scanned each;
    an input column named ``secrets`` is replaced; an empty table gives no rows.
    """
    C.session(docs)
    scan = C.per_text(lambda: scanner(allowed, cut), f"struct<base:{SPANS},added:{SPANS}>")
    return C.unpack(C.rows(docs, _found=scan(C.quoted(text_col))), secrets=F.col("_found"))
