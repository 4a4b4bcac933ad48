"""Licence families of paragraphs: a trained n-gram classifier with an unknown class names them, templates and version words confirm or reject."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common as C

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
PARAGRAPH = re.compile(r"[^\n]*\n")
UNKNOWN = "unknown"
# fixed values: statements as their licences or common use word them
GPL = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify " + GPL.format("", 2),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "lgpl-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify " + GPL.format("Lesser ", 2.1),
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify " + GPL.format("Lesser ", 3),
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify " + GPL.format("Affero ", 3),
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "bsd-3-clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "bsd-2-clause": ("Licensed under the BSD 2-Clause License.",),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
    "all-rights-reserved": ("All rights reserved.", "Copyright holder. All rights reserved."),
}
# fixed values: names of the families as statements and package files write them
NAMES = {
    "mit": ("MIT", "MIT License", "Expat"),
    "apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2"),
    "gpl-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL version 3", "GNU GPL v3", "GNU General Public License v3", "GNU General Public License, version 3"),
    "gpl-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPL version 2", "GNU GPL v2", "GNU General Public License v2", "GNU General Public License, version 2"),
    "lgpl-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1", "LGPL version 2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1"),
    "lgpl-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3", "LGPL version 3", "GNU LGPL v3", "GNU Lesser General Public License v3"),
    "agpl-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3", "AGPL version 3", "GNU AGPL v3", "GNU Affero General Public License v3"),
    "mpl-2.0": ("MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-4.0": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0"),
    "cc0-1.0": ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    "bsd-3-clause": ("BSD-3-Clause", "BSD 3-Clause", "BSD 3-Clause License"),
    "bsd-2-clause": ("BSD-2-Clause", "BSD 2-Clause", "BSD 2-Clause License"),
    "isc": ("ISC", "ISC License"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "all-rights-reserved": (),
}
# statements that a name is put into, and sentences of like words that are none
FRAMES = (
    "This {thing} is licensed under the {name}", "This {thing} is {name} licensed", "{name} licensed", "Licensed under {name}", "Licensed under the {name} license", "Released under {name}", "License: {name}",
    "SPDX-License-Identifier: {name}", "The {thing} is distributed under the terms of the {name}", "You may use this {thing} under the {name} license", "Published under {name}, see the file for details", "license = {name}",
    "All {thing} here is available under the {name} license", "{thing} under {name}", "licensed as {name}",
)
THINGS = ("code", "software", "project", "work", "library", "file", "program", "package", "text", "document", "data", "source")
NO_FRAMES = (
    "This {thing} is about {name} and its history", "A talk on {name} at the meeting", "{name} was founded long ago", "People at {name} wrote this {thing}", "We like {name} and other names", "The {thing} of {name} was late", "see {name} on the map",
)
NO_NAMES = ("the table", "the old rules", "a new name", "version 2", "version 3", "the terms of the contract", "a driving license", "license plate 2.0", "public opinion", "the general public", "common ground", "the state", "my own terms")
# what the words of a paragraph must hold for its family to be confirmed: the family's own name and version
OWN = {
    "mit": r"\bmit\b.*\blicen|\blicen.*\bmit\b|\bunder (?:the )?mit\b|\bexpat\b|permission is hereby granted",
    "apache-2.0": r"\bapache\b.* v?2(?:\.0)?\b|\bapache-2\.0\b",
    "gpl-3.0": r"(?<![al])gpl[- ]?v?3|(?<![al])gpl (?:version |v )3|(?<!lesser )(?<!affero )general public license.* v?3(?:\.0)?\b",
    "gpl-2.0": r"(?<![al])gpl[- ]?v?2|(?<![al])gpl (?:version |v )2|(?<!lesser )(?<!affero )general public license.* v?2(?:\.0)?\b",
    "lgpl-2.1": r"lgpl[- ]?v?2\.1|lgpl (?:version |v )2\.1|lesser general public license.* v?2\.1\b",
    "lgpl-3.0": r"lgpl[- ]?v?3|lgpl (?:version |v )3|lesser general public license.* v?3(?:\.0)?\b",
    "agpl-3.0": r"agpl[- ]?v?3|agpl (?:version |v )3|affero general public license.* v?3(?:\.0)?\b",
    "mpl-2.0": r"\bmpl[- ]?v?2|mozilla public license.* v?2(?:\.0)?\b",
    "cc-by-nc-4.0": r"\bcc[- ]by-nc[- ]4\.0|\battribution-noncommercial 4\.0",
    "cc-by-sa-4.0": r"\bcc[- ]by-sa[- ]4\.0|\battribution-sharealike 4\.0",
    "cc-by-4.0": r"\bcc[- ]by[- ]4\.0|\battribution 4\.0",
    "cc0-1.0": r"\bcc0[- ]1\.0|waived all copyright",
    "bsd-3-clause": r"bsd[- ]3-clause|redistribution and use",
    "bsd-2-clause": r"bsd[- ]2-clause",
    "isc": r"\bisc\b.*\blicen|\blicen.*\bisc\b|\bunder (?:the )?isc\b|permission to use",
    "unlicense": r"\bunlicense\b|unencumbered software",
    "all-rights-reserved": r"all rights reserved",
}
OWN = {family: re.compile(own) for family, own in OWN.items()}
BODY = re.compile("permission is hereby granted|permission to use|redistribution and use|waived all copyright|unencumbered software")
# families that differ by a version or a condition: the classifier tells the kind, the words which of them
KINDS = [
    ("gpl-3.0", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"), ("cc-by-nc-4.0", "cc-by-sa-4.0", "cc-by-4.0"), ("bsd-3-clause", "bsd-2-clause"),
    *[(f,) for f in ("mit", "apache-2.0", "mpl-2.0", "cc0-1.0", "isc", "unlicense", "all-rights-reserved")],
]
# the clause that BSD texts of two clauses lack
THIRD = re.compile(r"neither\W+the\W+names?\b", re.I)
# paragraphs of the corpus that the unknown class is fitted on, at most
NEGATIVES, VARIANTS, STEPS = 2000, 30, 200
LIMIT, OVERLAP = 0.5, 0.6
# a statement of so many words at most is confirmed by its name and version alone; a longer paragraph must hold a template
STATEMENT = 24


def grams(words: list[str]) -> set[str]:
    """Runs of one to three words."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    families: list[str]  # the last one is unknown
    number: dict[str, int]
    weights: np.ndarray  # a row per n-gram and one for the bias
    scale: float

    def __post_init__(self):
        # by how much an n-gram can raise a family over the unknown class, at most
        lead = (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1)
        object.__setattr__(self, "lead", np.maximum(lead[:-1], 0.0).tolist())
        object.__setattr__(self, "start", float(lead[-1]) + math.log(len(self.families)) / self.scale)

    def ids(self, words: list[str]) -> set[int]:
        """Numbers of the known n-grams; one of two or three words is known only if its words are."""
        number, out, one, two = self.number, set(), None, None
        for w in words:
            k = number.get(w)
            if k is None:
                one = two = None
                continue
            out.add(k)
            if one is not None:
                pair = f"{one} {w}"
                if pair in number:
                    out.add(number[pair])
                if two is not None and (triple := f"{two} {pair}") in number:
                    out.add(number[triple])
            one, two = w, one
        return out

    def probabilities(self, words: list[str]) -> np.ndarray | None:
        """Of each family; None where no family can be likelier than unknown, which the sum of leads tells."""
        ids = self.ids(words)
        lead = self.lead
        if self.start + sum([lead[k] for k in ids]) < 0:
            return None
        z = self.scale * (self.weights[sorted(ids)].sum(axis=0) + self.weights[-1])
        e = np.exp(z - z.max())
        return e / e.sum()

    def named(self, words: list[str]) -> tuple[str, float, float] | None:
        """Family, probability and template overlap of a paragraph, or None.

        The classifier must hold one kind of licence likelier than unknown and
        than all others; the name and version in the words then tell the family,
        and the paragraph must be a short statement or hold a template of it.
        """
        p = self.probabilities(words)
        if p is None:
            return None
        total, kind = max((float(sum(p[self.families.index(f)] for f in kind)), kind) for kind in KINDS)
        if total < LIMIT or total < p[-1]:
            return None
        text = " ".join(words)
        own = [f for f in kind if OWN[f].search(text)]
        if not own or text in BARE:
            return None
        near = compare(words)
        family = max(own, key=lambda f: (near.get(f, 0.0), p[self.families.index(f)]))
        # without a template it must be a short statement that has the name itself, not words of the licence's body
        if family not in near and (len(words) > STATEMENT or not OWN[family].search(BODY.sub(" ", text))):
            return None
        return family, min(1.0, total), near.get(family, 0.0)

    def detect(self, text: str) -> list[tuple[str, float, float, int, int]]:
        """Family, probability, template overlap, start and end of each paragraph with a confirmed family.

        Every paragraph goes through the classifier. A line is a paragraph of its own. Lines up to one without words (blank,
        or nothing but comment marks) are joined too, and the stretch of them
        that a template covers is a paragraph if it runs over the end of a line.
        """
        found, block = [], []  # lines of the block: first place, words, families found
        for m in PARAGRAPH.finditer(text + "\n"):
            words, place = words_of(m[0]), (m.start(), m.end() - 1)
            if words:
                one = self.named(words)
                if one:
                    found.append((*one, *place))
                block.append((place, words, one and one[0]))
            elif block:
                found += self.wrapped(text, block)
                block = []
        found += self.wrapped(text, block)
        found = [(bsd(f, text), *rest) for f, *rest in found]
        return sorted(found, key=lambda x: x[3:])

    def wrapped(self, text: str, block: list) -> list[tuple[str, float, float, int, int]]:
        if len(block) < 2:
            return []
        joined = [w for _, words, _ in block for w in words[words[0] in MARKS :]]
        if not compare(joined):
            return []
        # words with their lines and places
        at = [(w[0].lower(), k, start + w.start(), start + w.end()) for k, ((start, end), _, _) in enumerate(block) for n, w in enumerate(WORD.finditer(text[start:end])) if n or w[0].lower() not in MARKS]
        words = [w for w, *_ in at]
        hits: dict[tuple[str, int], list[int]] = {}
        for i, run in enumerate(zip(words, words[1:], words[2:])):
            for t in RUNS.get(run, ()):
                hits.setdefault(t, []).append(i)
        best: dict[tuple[int, int], dict[str, float]] = {}
        for t, places in hits.items():
            for a, b in stretches(words, places, t):
                if at[a][1] != at[b - 1][1]:
                    best[a, b] = {}
        found, taken = [], []
        for a, b in best:
            one = self.named(words[a:b])
            if one and one[2] > 0:
                found.append((*one, a, b))
        # of stretches that overlap, the one most shared, then the longest
        kept = []
        for f, p, near, a, b in sorted(found, key=lambda x: (-x[2], x[3] - x[4], x[0])):
            if all(b <= s or e <= a for s, e in taken):
                taken.append((a, b))
                if not any(family == f and start <= at[a][2] and at[b - 1][3] <= end for (start, end), _, family in block):
                    kept.append((f, p, near, at[a][2], at[b - 1][3]))
        return kept


def bsd(family: str, text: str) -> str:
    """The common opening of BSD texts, named by whether the third clause occurs."""
    if family != "bsd-3-clause" or THIRD.search(text) or re.search(r"(?i)bsd\W+3-clause", text):
        return family
    return "bsd-2-clause"


def runs_of(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:]))


# runs of three words of each template, and the templates of each run
SHAPES = {(f, k): runs_of(words_of(t)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)}
LENGTH = {(f, k): len(words_of(t)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)}
RUNS: dict[tuple[str, ...], list[tuple[str, int]]] = {}
for _t, _runs in SHAPES.items():
    for _r in _runs:
        RUNS.setdefault(_r, []).append(_t)
# a name alone is a heading and states nothing
BARE = {" ".join(words_of(n)) for names in NAMES.values() for n in names}
# comment marks that are words
MARKS = frozenset({"rem", "dnl"})


def compare(words: list[str]) -> dict[str, float]:
    """Families of which a template's runs of three words occur by ``OVERLAP`` or more, with the largest share."""
    own = RUNS.keys() & runs_of(words)
    shared: dict[tuple[str, int], int] = {}
    for r in own:
        for t in RUNS[r]:
            shared[t] = shared.get(t, 0) + 1
    near: dict[str, float] = {}
    for t, n in shared.items():
        if n >= OVERLAP * len(SHAPES[t]):
            near[t[0]] = max(near.get(t[0], 0.0), n / len(SHAPES[t]))
    return near


def stretches(words: list[str], places: list[int], template: tuple[str, int]) -> list[tuple[int, int]]:
    """Parts of the words, one after the other, that hold enough of a template's runs within twice its length."""
    most, need, found, k = 2 * LENGTH[template] + 10, OVERLAP * len(SHAPES[template]), [], 0
    while k < len(places):
        near = places[k : bisect_right(places, places[k] + most - 3)]
        seen: set = set()
        end = k
        for n, i in enumerate(near):  # ends where nothing new comes
            if tuple(words[i : i + 3]) not in seen:
                seen.add(tuple(words[i : i + 3]))
                end = k + n
        if len(seen) >= need:
            found.append((places[k], places[end] + 3))
            k = end + 1
        else:
            k += 1
    return found


def softmax_fit(rows: list[list[int]], labels: np.ndarray, width: int, classes: int, steps: int = STEPS) -> np.ndarray:
    """Sparse multinomial logistic regression by Adam with a small ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    ids = np.concatenate([np.array([*r, width], dtype=np.int64) for r in rows])
    by_id, by_row = np.argsort(ids, kind="stable"), np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    present, first = np.unique(ids[by_id], return_index=True)
    w = np.zeros((width + 1, classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    one = np.eye(classes)[labels]
    for step in range(1, steps + 1):
        z = np.add.reduceat(w[ids], by_row, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - one) / len(rows)
        g = np.zeros_like(w)
        g[present] = np.add.reduceat(d[at[by_id]], first, axis=0)
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def examples(negatives: list[str], seed: int = 5) -> list[tuple[list[str], str]]:
    """Words with their family: templates and damaged copies of them, statements, and what is none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out: list[tuple[list[str], str]] = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            ws = words_of(t)
            out += [(ws, family)] * 2
            for i in range(VARIANTS):
                few = i % 3 == 0 and len(ws) > 3
                kept = [w for w in ws if rng.random() < (0.35 if few else 0.85)]
                if few:
                    rng.shuffle(kept)
                    out.append((kept[: max(1, len(ws) // 3)], UNKNOWN))
                elif kept:
                    out.append((kept, family))
        for name in NAMES[family]:
            for frame in FRAMES:
                ws = words_of(frame.format(thing=pick(THINGS), name=name))
                out.append((ws, family))
                if rng.random() < 0.3:  # with words before and after
                    out.append((words_of(f"{pick(THINGS)} {pick(THINGS)}") + ws + words_of(pick(THINGS)), family))
            for frame in NO_FRAMES[:4]:
                out.append((words_of(frame.format(thing=pick(THINGS), name=name.split(" ")[0])), UNKNOWN))
    for frame in (*NO_FRAMES, *FRAMES):
        out += [(words_of(frame.format(thing=pick(THINGS), name=n)), UNKNOWN) for n in NO_NAMES]
    return out + [(words_of(t), UNKNOWN) for t in negatives]


def fit(negatives: list[str]) -> Model:
    """A model from templates, statements and paragraphs of the corpus.

    Copies of a template that keep seven words in ten have its family, those that
    keep fewer than four in ten, shuffled, are unknown, as are the paragraphs and
    sentences of like words. The scale is fitted on a fifth that is left out of
    the weights, so that the probabilities, unknown's too, are calibrated.
    """
    families = [*TEMPLATES, UNKNOWN]
    texts = examples(negatives)
    grammar = [grams(ws) for ws, y in texts if y != UNKNOWN]
    number = {g: i for i, g in enumerate(sorted(set().union(*grammar)))}
    blank = Model(families, number, np.zeros((len(number) + 1, len(families))), 1.0)
    rows = [sorted(blank.ids(ws)) for ws, _ in texts]
    labels = np.array([families.index(y) for _, y in texts])
    held = np.arange(len(rows)) % 5 == 4
    w = softmax_fit([r for r, h in zip(rows, held) if not h], labels[~held], len(number), len(families))
    z = np.array([w[r].sum(axis=0) + w[-1] for r, h in zip(rows, held) if h])

    def loss(s: float) -> float:
        x = s * z
        return float((np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) + x.max(axis=1) - x[np.arange(len(x)), labels[held]]).mean())

    return Model(families, number, w, float(min(np.linspace(0.3, 2.0, 18), key=loss)))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``license`` (null where none) and ``license_paragraphs``.

    Each line of the whole text is a paragraph, and so is what a template covers
    of lines that follow one another without a blank one. The classifier reads
    every paragraph; where it holds a kind of licence likelier than unknown (0.5
    at least), name and version in the words tell the family, and a paragraph of
    more than 24 words must share 0.6 of a template's word runs. Of stretches
    that overlap, the one most shared counts, then the longest. The most
    probable paragraph, then the first, names the row. Null and empty texts have
    none; texts of any length are read whole; input columns of those names are
    replaced; repeated rows are scanned each; an empty table gives an empty one.
    A name alone is no statement. The fit reads at most 2,000 lines of the corpus, those of least hash among
    about twice as many that a bound on the hash lets through.
    """
    spark = C.session(docs)
    text = C.quoted(text_col)
    total = docs.agg(F.sum(F.regexp_count(text, F.lit("\n")) + 1)).first()[0] or 1
    share = min(1.0, 2.0 * NEGATIVES / total)
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).where("line != ''").select("line", F.xxhash64("line").alias("h"))
    lines = lines.where(F.pmod("h", F.lit(1 << 40)) <= int(share * (1 << 40)))
    few = lines.groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(NEGATIVES)
    negatives = [r["line"] for r in few.collect() if not any(own.search(" ".join(words_of(r["line"]))) for own in OWN.values())]
    shared = spark.sparkContext.broadcast(fit(negatives))
    kind = "array<struct<family:string,probability:double,overlap:double,start:int,end:int>>"
    run = C.per_text(lambda: shared.value.detect, kind)
    found = C.rows(docs, _found=run(C.quoted(text_col)))
    first = F.aggregate("_found", F.lit(None).cast("struct<family:string,probability:double,overlap:double,start:int,end:int>"), lambda a, x: F.when(a.isNull() | (x["probability"] > a["probability"]), x).otherwise(a))
    return C.unpack(found.withColumn("_first", first), license=F.col("_first.family"), license_paragraphs=F.col("_found"))
