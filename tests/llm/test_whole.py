"""Cases that earlier forms of the training-data operators left out."""

from __future__ import annotations

import random

import numpy as np

from hitledger.llm import decontaminate, licenses, toxicity

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(4, 7))) for _ in range(400)]


def test_near_copies_of_items(spark):
    """Each copy with one word changed, at any place, and each cut off before a short last sentence."""
    items = [" ".join(RNG.choice(VOCABULARY) for _ in range(18)) + ". " + " ".join(RNG.choice(VOCABULARY) for _ in range(n)) + "." for n in (1, 2, 3, 4, 6)]
    rows, want = [], {}
    for i, item in enumerate(items):
        words = item.split(" ")
        copies = [" ".join([*words[:k], "changed" + "." * words[k].endswith("."), *words[k + 1 :]]) for k in range(len(words))]
        for text in [item, *copies, item.split(". ")[0]]:
            want[len(rows)] = [i]
            rows.append((len(rows), f"Some text before it\n{text}\nand after it"))
    # half of the question alone is no copy
    want[len(rows)] = []
    rows.append((len(rows), " ".join(items[0].split(" ")[:9])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in found.collect()} == want


MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
NOTICES = {
    "mit": MIT,
    "gpl-3.0": GPL.format("", 3),
    "gpl-2.0": GPL.format("", 2),
    "lgpl-2.1": GPL.format("Lesser ", 2.1),
    "lgpl-3.0": GPL.format("Lesser ", 3),
    "agpl-3.0": GPL.format("Affero ", 3),
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at\n",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "bsd-3-clause": BSD + "\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products\n",
    "bsd-2-clause": BSD,
    "unlicense": "This is free and unencumbered software released into\nthe public domain.\n",
}


def test_wrapped_notices(spark):
    rows, want = [], []
    for family, text in NOTICES.items():
        for mark in ("", "# ", " * ", "// ", "dnl "):
            rows.append((len(rows), "import this\n\n" + "".join(f"{mark}{line}\n" for line in text.splitlines()) + "\nvalue = 1"))
            want.append(family)
    one_line = {"This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "This work is licensed under the GNU General Public License.": None, "The rivers of the north are subject to the terms of the\nlong winter, and all of the boats wait.": None}
    for text, family in one_line.items():
        rows.append((len(rows), text))
        want.append(family)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == want
    place = got[0]["license_paragraphs"][0]
    assert rows[0][1][place["start"] : place["end"]].startswith("Permission is hereby") and rows[0][1][place["start"] : place["end"]].endswith("without restriction")


def test_toxicity_families_are_copies():
    """Rows that share a passage stay; copies, and copies with a word changed, are one; labels are never joined."""
    def say(n):
        return " ".join(RNG.choice(VOCABULARY) for _ in range(n))

    passage = say(60)
    texts = [f"{say(60)} {passage}" for _ in range(40)]
    long = say(200)
    texts += [long, long, long.replace(" ", "  "), long + " changed", long]
    labels = np.array([i % 2 for i in range(40)] + [0, 0, 0, 0, 1])
    got = toxicity.families(texts, labels)
    assert got.tolist() == [*range(40), 40, 40, 40, 40, 44]
