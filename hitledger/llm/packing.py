"""Best-fit packing of tokenized documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import common as C

# a space before a word or a mark always starts a token of the byte-level pattern
CUT = re.compile(r"(?= [\w!-/:-@\[-`{-~])")
UNSAFE = re.compile(r" (?![\w!-/:-@\[-`{-~])")
# letters that every regex library classes alike
PLAIN = re.compile(r"[\t\n\r -~\u00c0-\u024f]*")
# the split pattern of byte-level BPE, a fixed value of the vocabulary
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED, LONGEST = 100_000, 40


class Encoder:
    """Token ids of whole texts as little-endian bytes, exactly as the tokenizer gives them.

    A text is cut where the tokenizer's own pattern must start a token. The ids
    of a cut are made once and kept, up to CACHED cuts; after that the store
    starts anew. Cuts of plain letters are encoded with the same vocabulary as
    byte ranks, which is faster, the others by the tokenizer itself.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that are one token wherever they stand; a text that holds one goes to the tokenizer whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes print as themselves where they can, the rest as the letters from 256 on, in order
        shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or 174 <= n]
        byte = {chr(n): n for n in shown} | {chr(256 + k): n for k, n in enumerate(n for n in range(256) if n not in set(shown))}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.ids: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def cuts(self, text: str) -> list[str]:
        if UNSAFE.search(text) or "\0" in text:
            return CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        known, cuts = self.ids, self.cuts(text)
        out = [known.get(w) for w in cuts]
        if None in out:
            make = self.ranked.encode_ordinary if text.isascii() or PLAIN.fullmatch(text) else lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
            for i, ids in enumerate(out):
                if ids is None:
                    w = cuts[i]
                    out[i] = ids = array("I", make(w)).tobytes()
                    if len(w) <= LONGEST:
                        known[w] = ids
            if len(known) > CACHED:
                known.clear()
        return b"".join(out)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its place among the pieces of its length in its partition."""

    def start():
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()

        def work(batch):
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth")}
            for doc, text in zip(batch["id"], batch["text"]):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    for name, v in zip(out, (doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, int(seen[length]))):
                        out[name].append(v)
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            return out

        return work

    kind = dict(docs.select(C.quoted(id_col)).dtypes)[id_col]
    given = docs.select(C.quoted(id_col).alias("id"), C.quoted(text_col).alias("text"))
    return C.map_arrow(given, start, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _nth long")


def configuration(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size goes into one sequence: the largest one left, and the best fill beside it."""
    top = int(np.flatnonzero(left)[0])
    room = capacity - int(sizes[top])
    taken = np.zeros((len(sizes), room + 1), dtype=np.int16)
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    for g in range(top, len(sizes)):
        size = int(sizes[g])
        have = min(int(left[g]) - (g == top), room // size)
        base = reach.copy()
        for k in range(1, have + 1):
            new = np.zeros_like(reach)
            new[k * size :] = base[: room + 1 - k * size]
            new &= ~reach
            taken[g][new] = k
            reach |= new
        if reach[room]:
            break
    at, use = int(np.flatnonzero(reach)[-1]), np.zeros(len(sizes), dtype=np.int64)
    use[top] = 1
    for g in range(len(sizes) - 1, top - 1, -1):
        if k := int(taken[g][at]):
            use[g] += k
            at -= k * int(sizes[g])
    return use


def plan(counts: np.ndarray, capacity: int, groups: int = 512, small: int | None = None) -> dict[str, np.ndarray]:
    """Packing of ``counts[l]`` pieces of each length as runs.

    A run says: pieces ``first .. first + n - 1`` of a length go to sequences
    ``sequence .. sequence + n - 1``, all at ``offset``. Lengths over ``small``
    are rounded up within groups of equal cardinality, sequences are composed of
    few rounded sizes by configurations, actual lengths take their places, and
    the small lengths go, longest first, where they fit best. The work depends
    on the number of lengths, not of pieces.
    """
    counts = counts.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = int(counts[capacity])
    if sequences:
        runs.append((capacity, 0, sequences, 0, 0))
    large = np.array([n for n in range(capacity - 1, small, -1) if counts[n]], dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(counts[large])]) if len(large) else np.array([0])
    total = int(upto[-1])
    blocks: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, first of its pieces)])
    if total:
        edges = np.unique(np.linspace(0, total, min(groups, len(large)) + 1).astype(np.int64)) if groups < len(large) else upto
        left = np.diff(edges)
        sizes = large[np.searchsorted(upto, edges[:-1], side="right") - 1]
        at = edges[:-1].copy()
        while left.any():
            use = configuration(sizes, left, capacity)
            used = np.flatnonzero(use)
            n = int((left[used] // use[used]).min())
            slots = []
            for g in used:
                for _ in range(int(use[g])):
                    slots.append(int(at[g]))
                    at[g] += n
                left[g] -= n * int(use[g])
            # a block ends where the actual length in any of its places changes
            marks = {0, n}
            for s in slots:
                i = np.searchsorted(upto, [s, s + n])
                marks.update(int(x) - s for x in upto[i[0] : i[1]] if s < x < s + n)
            marks = sorted(marks)
            for a, b in zip(marks, marks[1:]):
                places = []
                for s in slots:
                    k = int(np.searchsorted(upto, s + a, side="right")) - 1
                    places.append((int(large[k]), s + a - int(upto[k])))
                blocks.append((b - a, places))
    by_room: list[list] = [[] for _ in range(capacity + 1)]
    for n, places in blocks:
        by_room[capacity - sum(p[0] for p in places)].append((n, places))
    for length in range(min(small, capacity - 1), 0, -1):
        left, first = int(counts[length]), 0
        room = length
        while left:
            while room <= capacity and not by_room[room]:
                room += 1
            n, places = by_room[room].pop() if room <= capacity else (left, [])
            space = room if room <= capacity else capacity
            q = min(space // length, left)
            many = min(n, left // q)
            if many < n and room <= capacity:
                by_room[room].append((n - many, [(m, f + many) for m, f in places]))
            by_room[space - q * length].append((many, places + [(length, first + k * many) for k in range(q)]))
            first += q * many
            left -= q * many
            room = length if space - q * length >= length else room
    for ready in by_room:
        for n, places in ready:
            offset = 0
            for length, first in places:
                runs.append((length, first, n, sequences, offset))
                offset += length
            sequences += n
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "n", "sequence", "offset"), table.T))


def best_plan(counts: np.ndarray, capacity: int, groups: int) -> dict[str, np.ndarray]:
    """The plan of the fewest sequences, over where large lengths begin."""
    tried = [plan(counts, capacity, groups, capacity // share) for share in (8, 4, 3, 2)]
    return min(tried, key=lambda p: int((p["sequence"] + p["n"]).max(initial=0)))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens in as few sequences of ``capacity`` as the plan finds.

    A document is its token ids and ``end_id``; null counts as empty and gives
    one token. Only documents longer than a sequence are cut, the first piece
    being the shorter one. Repeated rows are packed each; other columns are not
    read; an empty table gives no rows. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id and offset.

    Pieces are written once with their place among the pieces of their length,
    so only the histogram of lengths (``capacity`` numbers) goes to the driver
    and only the plan's runs (a few thousand) come back.
    """
    spark = C.session(docs)
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    per_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    runs = best_plan(counts, capacity, groups)
    shift = 44
    keys = (runs["length"] << shift) | runs["first"]

    def place():
        def work(batch):
            length = np.array(batch["length"], dtype=np.int64)
            nth = np.array(batch["_nth"], dtype=np.int64)
            run = np.searchsorted(keys, (length << shift) | nth, side="right") - 1
            return {**batch, "sequence_id": runs["sequence"][run] + nth - runs["first"][run], "offset": runs["offset"][run]}

        return work

    ranked = pieces.join(starts, ["length", "_part"]).withColumn("_nth", F.col("_nth") + F.col("_before"))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "_nth")
    kinds = ", ".join(f"{n} {k}" for n, k in ranked.select(*names).dtypes)
    placed = C.map_arrow(ranked.select(*names), place, f"{kinds}, sequence_id long, offset long")
    return placed.drop("_nth")
