"""License scans: a trained paragraph classifier with template comparison; DataFrame operations only.

A paragraph is a line of a text, or several: each sentence that goes on over lines
and each run of non-blank lines, without comment markers.  Sparse multinomial logistic regression over its
word 1- to 3-grams identifies a licence family or the class "unknown", whose score
is calibrated so that at most ``false_rate`` of the corpus's foreign paragraphs get a
family.  A family is confirmed where one of its templates shares at least
``overlap`` of its word bigrams with the paragraph, or where the paragraph grants under one of
its names ("may be used under the terms of the MIT License").  A line that is just a licence's
title, and an SPDX identifier, are told by rule (probability and overlap 1).

Only paragraphs with one of the gate words are classified.  They follow from the
overlap: without all gate words of a template, so many of its bigrams are missing that
no paragraph can reach the overlap (see gate_words), so nothing is lost; the cues of the names are gate words too.  Foreign
paragraphs are those behind the gate that share less than half the overlap with every
template and hold no family's name, in documents of which no paragraph reaches it, grants under a name or is told by rule (other lines
of a licence are not foreign); the calibration counts all of them, equal ones once.

The model is fitted on the driver from the templates, variants of them, fixed foreign
lines and a sample of at most ``most`` foreign paragraphs, of which it gets the n-grams that
templates have; its weights are a table whose size the templates bound.

Null and empty texts have no paragraphs.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

UNKNOWN = "unknown"

#: What a text must contain for a rule on SPDX identifiers or titles to hold (fixed values).
RULE_CUES = ["license", "spdx", "attribution", "cc by", "cc-by", "cc0", "licence", "gpl", "mpl ", "mpl-", "epl ", "epl-", "bsd-", "apache-2", "creative commons"]

#: Families of SPDX identifiers, the first that fits (fixed patterns).
SPDX = [
    ("AGPL", "agpl-.*"), ("LGPL", "lgpl-.*"), ("GPL", "gpl-.*"), ("MIT", "mit(-.*)?"), ("Apache", "apache-.*"), ("BSD", "0?bsd(-.*)?"), ("MPL", "mpl-.*"), ("EPL", "epl-.*"),
    ("CC-BY-NC", "cc-by-nc-.*"), ("CC-BY-SA", "cc-by-sa-.*"), ("CC-BY", "cc-by-[0-9].*"), ("CC0", "cc0-.*"), ("ISC", "isc(-.*)?"), ("Unlicense", "unlicense"), ("Proprietary", "licenseref-proprietary.*"),
]
#: Titles as whole lines of words (fixed patterns); "the" before and the short name after may stand.
TITLES = [
    ("AGPL", "gnu affero general public license( agpl)?( version| v)?( ?v?[0-9.]+)?( or later)?"),
    ("LGPL", "gnu (lesser|library) general public license( lgpl)?( version| v)?( ?v?[0-9.]+)?( or later)?"),
    ("GPL", "gnu general public license( gpl)?( version| v)?( ?v?[0-9.]+)?( or later)?"),
    ("MIT", "(mit|expat|x11) license( mit)?"),
    ("Apache", "apache (software )?license( version| v)?( ?v?[0-9.]+)?|apache[ -]2(.0)? license"),
    ("BSD", "(bsd|(new|modified|simplified|original|revised) bsd|bsd[ -][0-4][ -]clause|[0-4][ -]clause bsd|bsd zero clause)( [a-z]+ or [a-z]+)? license"),
    ("MPL", "mozilla public license( mpl)?( version| v)?( ?v?[0-9.]+)?"),
    ("EPL", "eclipse public license( epl)?( version| v| - v)?( ?v?[0-9.]+)?"),
    ("CC-BY-NC", "(creative commons )?attribution[ -]noncommercial([ -](sharealike|noderivatives|noderivs))?( [0-9.]+)?( international| unported| generic)?( public)?( license)?|cc[ -]by-nc(-sa|-nd)?( [0-9.]+)?( license)?"),
    ("CC-BY-SA", "(creative commons )?attribution[ -]sharealike( [0-9.]+)?( international| unported| generic)?( public)?( license)?|cc[ -]by-sa( [0-9.]+)?( license)?"),
    ("CC-BY", "creative commons attribution( [0-9.]+)?( international| unported| generic)?( public)?( license)?|cc[ -]by( [0-9.]+)?( license)?"),
    ("CC0", "(creative commons )?cc0( [0-9.]+)?( universal)?( public domain dedication)?( license)?"),
    ("ISC", "isc license( isc)?"),
    ("Unlicense", "(the )?unlicense"),
]

#: Names of the families within a paragraph's words (fixed patterns); a version may follow.
NAMED = [
    ("AGPL", "gnu affero general public licen[sc]e|(gnu )?agpl"),
    ("LGPL", "gnu (lesser|library) general public licen[sc]e|(gnu )?lgpl"),
    ("GPL", "gnu general public licen[sc]e|(gnu )?gpl"),
    ("MIT", "(mit|expat|x11)( x11)? licen[sc]e"),
    ("Apache", "apache (software )?licen[sc]e|apache[ -]2(.0)?( licen[sc]e)?"),
    ("BSD", "((new|modified|simplified|original|revised) )?([0-4]-clause )?bsd( [0-4]-clause)? licen[sc]e|bsd-[0-4]-clause"),
    ("MPL", "mozilla public licen[sc]e|mpl"),
    ("EPL", "eclipse public licen[sc]e|epl"),
    ("CC-BY-NC", "(creative commons )?attribution[ -]noncommercial([ -](sharealike|noderivatives|noderivs))?|cc[ -]by-nc(-sa|-nd)?"),
    ("CC-BY-SA", "(creative commons )?attribution[ -]sharealike|cc[ -]by-sa"),
    ("CC-BY", "creative commons attribution(?![ -](non|share|no))|cc[ -]by"),
    ("CC0", "cc0|creative commons zero"),
    ("ISC", "isc licen[sc]e"),
    ("Unlicense", "unlicense"),
]
#: Words right before a name that make it a grant (fixed pattern).
GRANT = "(?:(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|covered|governed|dedicated|use|used|copied|copy|redistribute|modify)(?: [^ ]+){0,6}? (?:under|by|to)(?: the)?(?: terms(?: and conditions)? of)?|see)(?: the| a| an)? "

#: Notices and characteristic paragraphs of licence families (fixed values).
TEMPLATES = {
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License v2.0 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright owner.",
        "Copyright. All rights reserved. Unauthorized redistribution is prohibited.",
    ],
}

#: Names of the families and sentences that grant under a name, for training (fixed values).
NAMES = {
    "GPL": ["GNU General Public License v3.0", "GNU GPL version 2", "GPLv3", "GPL-2.0", "GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License v3", "LGPL version 2.1", "GNU LGPL", "LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License v3", "AGPLv3", "GNU AGPL version 3", "AGPL-3.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT/X11 license"],
    "Apache": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD": ["BSD License", "3-clause BSD license", "BSD 2-Clause License", "BSD-3-Clause", "new BSD license"],
    "MPL": ["Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL 2.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-ND 4.0", "CC BY-NC-SA 3.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "Proprietary": [],
}
FRAMES = ["Licensed under the {}.", "Released under {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.", "This software is available under the {}.", "See the {} for more details.", "This work is made available under {}."]

#: Words so common that a gate made of them would let all texts through (fixed values).
COMMON = frozenset("the of to and or in under this is with you any that for are may not by it as be no all can from at on a an its without such their have has will which other".split())

#: Paragraphs with cue words that grant no licence (fixed values).
FOREIGN = [
    "He lost his driver's license after the accident and had to renew it at the office.",
    "The city council voted to change the liquor license rules for restaurants.",
    "Permission to enter the building must be requested at the front desk.",
    "The copyright debate in parliament lasted until midnight.",
    "The product comes with a two year warranty on all moving parts.",
    "She holds a license to practise medicine in three states.",
    "Redistribution of wealth was the main topic of the lecture.",
    "The software license costs forty dollars a month for each seat.",
    "The park opened to the public domain of walkers and cyclists last spring.",
    "With the permission of the owner we crossed the field.",
    "A general public meeting about the free software fair takes place on Monday.",
    "The foundation published version 3 of its annual report.",
]

_TOKEN = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
_PY_TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return _PY_TOKEN.findall(text.lower())


def grams(words: list[str], orders=(1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in orders for i in range(len(words) - n + 1)}


@dataclass
class LicenseModel:
    families: list[str]
    weights: dict[str, list[float]]  #: n-gram -> one weight for each family; unknown's are 0
    bias: list[float]
    templates: list[tuple[str, list[str]]] = field(default_factory=list)  #: (family, distinct bigrams)


def _scores(model: LicenseModel, features: set[str]) -> list[float]:
    got = [model.weights[g] for g in features if g in model.weights]
    scale = 1 / math.sqrt(max(len(features), 1))
    return [b + scale * sum(w[k] for w in got) for k, b in enumerate(model.bias)]


def gate_words(templates: list[tuple[str, list[str]]], overlap: float) -> list[str] | None:
    """Words of which a text must contain one to share ``overlap`` of some template's bigrams.

    For each template words are taken until the bigrams without any of them are fewer than the overlap
    asks for; long words go before short ones, words taken already before others.  None (no gate) where
    an overlap of 0 lets everything pass.
    """
    chosen = set(RULE_CUES[:1])
    for _, bigrams in templates:
        left, size = [b.split(" ") for b in bigrams], len(bigrams)
        while len(left := [b for b in left if not chosen & set(b)]) >= overlap * size:
            if not left:
                return None
            words = sorted({w for b in left for w in b})
            price = {w: 50 if w in COMMON else 1 if len(w) > 6 else 3 if len(w) > 4 or re.search(r"[0-9]", w) else 10 for w in words}
            chosen.add(max(words, key=lambda w: (sum(w in b for b in left) / price[w], w)))
    return sorted(chosen)


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(f, sorted(grams(tokens(t), (2,)))) for f in sorted(templates) for t in templates[f]]


def training_texts(templates: dict[str, list[str]], seed: int = 5) -> list[tuple[str, str]]:
    """(family, text): templates, sentences with a family's names, and variants with words lost or added."""
    chance = random.Random(seed)
    texts = [(f, t) for f in sorted(templates) for t in [*templates[f], *(frame.format(n) for n in NAMES.get(f, []) for frame in FRAMES)]]
    more = []
    for f, t in texts:
        w = t.split(" ")
        if len(w) > 12:  # parts of it
            more += [(f, " ".join(w[: len(w) * 2 // 3])), (f, " ".join(w[len(w) // 3 :]))]
            more += [(f, " ".join(x for x in w if chance.random() > 0.15)) for _ in range(3)]
        other = chance.choice(FOREIGN).split(" ")
        more.append((f, " ".join([*other[: chance.randint(0, 6)], *w, *other[: chance.randint(0, 6)]])))
    for f in sorted(NAMES):
        for n in NAMES[f]:  # names among other words
            for _ in range(4):
                other = chance.choice(FOREIGN).split(" ")
                more.append((f, " ".join([*other[: chance.randint(0, 8)], n, *other[: chance.randint(0, 4)]])))
    return texts + more


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    """The n-grams that weights can stand on: those of the training texts, less what only foreign words around them make."""
    return sorted({g for f, t in training_texts(templates) for g in grams(tokens(t))})


def fit_licenses(foreign: list[str] | list[tuple[list[str], int]], templates: dict[str, list[str]] | None = None, steps: int = 300, rate: float = 0.5, sparsity: float = 2e-5) -> LicenseModel:
    """Multinomial logistic regression with soft-thresholded weights; features are presences over the root of their number.

    foreign: texts, or for each its n-grams that vocabulary() has and the number of all its n-grams.
    """
    templates = templates or TEMPLATES
    families = sorted(templates)
    words = vocabulary(templates)
    place = {g: i for i, g in enumerate(words)}
    rows = [(families.index(f), g, len(g)) for f, t in training_texts(templates) if (g := grams(tokens(t)))]
    for x in [*FOREIGN, *foreign]:
        g, n = (own := grams(tokens(x)), len(own)) if isinstance(x, str) else x
        if n:
            rows.append((len(families), g, n))
    x = np.zeros((len(rows), len(words)), np.float32)
    for r, (_, g, n) in enumerate(rows):
        for one in g:
            if one in place:
                x[r, place[one]] = 1 / math.sqrt(n)
    want = np.array([k for k, _, _ in rows])
    had = np.bincount(want, minlength=len(families) + 1)
    weight = (np.sqrt(had.max() / np.maximum(had, 1)) / len(rows))[want].astype(np.float32)
    target = np.eye(len(families) + 1, dtype=np.float32)[want]
    w, b = np.zeros((len(words), len(families)), np.float32), np.zeros(len(families), np.float32)
    g2, b2 = np.full_like(w, 1e-10), np.full_like(b, 1e-10)
    for _ in range(steps):
        eta = np.concatenate([x @ w + b, np.zeros((len(rows), 1), np.float32)], 1)
        p = np.exp(eta - eta.max(1, keepdims=True))
        d = ((p / p.sum(1, keepdims=True) - target) * weight[:, None])[:, :-1]
        grad, own = x.T @ d, d.sum(0)
        g2 += grad * grad
        b2 += own * own
        step = rate / np.sqrt(g2)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step * sparsity, 0.05), 0)
        b -= 0.2 * rate * own / np.sqrt(b2)
    weights = {g: [float(v) for v in w[i]] for i, g in enumerate(words) if w[i].any()}
    return LicenseModel(families, weights, [float(v) for v in b], template_bigrams(templates))


def _n_grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _may_hold(lowered: Column, gate: list[str] | None) -> Column:
    """Whether a lower-cased text contains a gate word, or what a rule asks for ("cc by" with any space between)."""
    if gate is None:
        return F.lit(True)
    out = lowered.rlike(r"\bcc\s+by\b")
    for word in sorted({*gate, *RULE_CUES} - {"cc by"}):
        out = out | F.contains(lowered, F.lit(word))
    return out


def _passages(text: Column) -> Column:
    """array<struct<first, last, line>>: every line with its number, then the sentences that go on over several lines
    and the runs of several non-blank lines.

    Lines carry their numbers (between marks) while they are joined and cut again."""
    lines = F.split(text, "\n")
    one = F.transform(lines, lambda x, i: F.struct(i.alias("first"), i.alias("last"), x.alias("line")))
    bare = lambda x: F.regexp_replace(F.translate(x, "\x01\x02\x03", "   "), r"(?i)^(?:[^\p{L}\p{N}(\"']|(?:dnl|rem)(?=\s))+|[\s*/#]+$", "")
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), bare(x))).otherwise(F.lit("\x03")))
    runs = F.filter(F.split(F.array_join(marked, " "), "\x03"), lambda r: r.rlike("(?s)\x01.*\x01"))
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.trim(r)), F.split(F.trim(r), r"(?<=[.!?])\s+"))))
    parts = F.array_distinct(F.filter(parts, lambda r: r.rlike("(?s).\x01")))
    number = lambda r, pattern: F.regexp_extract(r, pattern, 1).cast("int")
    first = lambda r: number(r, "\x01([0-9]+)\x02") - F.when(F.startswith(r, F.lit("\x01")), 0).otherwise(1)
    many = F.transform(parts, lambda r: F.struct(first(r).alias("first"), number(r, "(?s).*\x01([0-9]+)\x02").alias("last"), F.regexp_replace(r, "\x01[0-9]+\x02", "").alias("line")))
    return F.concat(one, many)


def _told(text: Column) -> Column:
    """array<string>: the families that a line's words name by SPDX identifiers or as a title."""
    family = lambda pairs, x, lead: F.coalesce(*(F.when(x.rlike(f"^(?:{lead}(?:{p}))$"), F.lit(f)) for f, p in pairs))
    ids = F.split(F.regexp_extract(text, "spdx-license-identifier ([^ ]+(?: (?:and|or|with) [^ ]+)*)", 1), " (?:and|or|with) ")
    both = F.concat(F.transform(ids, lambda x: family(SPDX, x, "")), F.array(family(TITLES, text, "(?:the )?")))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def _granted(text: Column) -> Column:
    """array<string>: the families under whose names a paragraph's words grant."""
    name = lambda pattern: f"(?:^| ){GRANT}(?:{pattern})(?:-?v?[0-9][0-9.]*)?(?:-only|-or-later)?(?: |$)"
    granted = F.array_compact(F.array(*(F.when(text.rlike(name(pattern)), F.lit(f)) for f, pattern in NAMED)))
    return F.when(text.rlike(f"(?:^| ){GRANT}"), granted).otherwise(F.array().cast("array<string>"))


def _names(text: Column) -> Column:
    """Whether a paragraph's words hold any family's name."""
    return text.rlike(f"(?:^| )(?:{'|'.join(pattern for _, pattern in NAMED)})")


@dataclass(frozen=True)
class Paragraphs:
    """The paragraphs of a corpus that may be licences, as written tables."""

    places: DataFrame  #: doc_id, _row, first, last, words, _told, _text: one row for each
    seen: DataFrame  #: _text, _n, granted (families), named (any), ids (of its n-grams in the vocabulary), shares (of each template's bigrams): one row for equal ones
    foreign: DataFrame  #: _text of the foreign ones
    templates: dict[str, list[str]]


def license_paragraphs(docs: DataFrame, overlap: float = 0.7, templates: dict[str, list[str]] | None = None) -> Paragraphs:
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    own = template_bigrams(templates)
    gate = gate_words(own, overlap)
    number = {g: i for i, g in enumerate(vocabulary(templates))}
    # a row key of its own, as ids may repeat; it is fixed once written
    some = docs.where(_may_hold(F.lower("text"), gate)).select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    some = some.select("doc_id", "_row", F.explode(_passages(F.col("text"))).alias("_p")).select("doc_id", "_row", "_p.*")
    lowered = F.lower("line")
    some = some.where(_may_hold(lowered, gate)).select("doc_id", "_row", "first", "last", F.regexp_extract_all(lowered, F.lit(_TOKEN), 0).alias("_words"))
    told = F.when(F.col("first") == F.col("last"), _told(F.array_join("_words", " "))).otherwise(F.array().cast("array<string>"))
    places = written(some.select("doc_id", "_row", "first", "last", F.size("_words").alias("words"), told.alias("_told"), F.array_join("_words", " ").alias("_line"), F.sha2(F.array_join("_words", " "), 256).alias("_text")))
    # equal paragraphs are classified once, whatever group of copies they come from
    # (cut into words below the grouping, as a lambda above it would cut a line anew for each word)
    distinct = places.select("_text", F.split("_line", " ").alias("_words"), "_line").dropDuplicates(["_text"])
    distinct = distinct.select("_text", _granted(F.col("_line")).alias("granted"), _names(F.col("_line")).alias("named"), F.array_distinct(F.concat(*(_n_grams(F.col("_words"), n) for n in (1, 2, 3)))).alias("_grams"))
    # the templates bound the vocabulary, so it is sent to every task
    words = F.broadcast(spark.createDataFrame(sorted(number.items()), "gram string, id int"))
    found = distinct.select("_text", "granted", "named", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram")).join(words, "gram")
    bigrams = F.from_json(F.lit(json.dumps([[number[g] for g in x] for _, x in own])), "array<array<int>>")
    share = F.transform(bigrams, lambda t: F.size(F.array_intersect(F.col("ids"), t)) / F.size(t))
    seen = found.groupBy("_text", "_n", "granted", "named").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("shares", share)
    seen = written(seen)
    nearest = places.select("_row", "_text", (F.size("_told") > 0).alias("_ruled")).join(seen.select("_text", (F.size("granted") > 0).alias("_granted"), "named", F.array_max("shares").alias("_s")), "_text")
    licensed = nearest.where(F.col("_ruled") | F.col("_granted") | (F.col("_s") >= overlap)).select("_row").distinct()
    foreign = nearest.where(~F.col("named") & (F.col("_s") < overlap / 2)).join(licensed, "_row", "left_anti").select("_text").distinct()
    return Paragraphs(places.drop("_line"), seen, written(foreign), templates)


def foreign_paragraphs(paragraphs: Paragraphs, most: int = 400) -> list[tuple[list[str], int]]:
    """For about ``most`` distinct foreign paragraphs at most (those with the smallest hashes): the n-grams that the vocabulary has, and the
    number of all; what reaches the driver is bounded by ``most`` and the templates."""
    share = min(1.0, most / max(paragraphs.foreign.count(), 1))
    words = vocabulary(paragraphs.templates)
    some = paragraphs.foreign.where(F.xxhash64("_text") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
    rows = paragraphs.seen.join(some, "_text").select("_text", "ids", "_n").collect()
    return [([words[i] for i in r["ids"]], r["_n"]) for r in sorted(rows, key=lambda r: r["_text"])]


def _unknown_score(scored: DataFrame, paragraphs: Paragraphs, false_rate: float) -> float:
    """The score of "unknown" that at most ``false_rate`` of the foreign paragraphs exceed, 0 at least, in steps of 0.01."""
    foreign = scored.join(paragraphs.foreign, "_text", "left_semi")
    total = paragraphs.foreign.count()
    above = foreign.select(F.array_max("scores").alias("m")).where(F.col("m") > 0).groupBy(F.ceil(F.col("m") * 100).alias("step")).agg(F.count("*").alias("n"))
    score, left = 0.0, false_rate * total
    for r in above.orderBy(F.col("step").desc()).collect():  # as many rows as there are steps
        if (left := left - r["n"]) < 0:
            score = r["step"] / 100
            break
    return score


def scan_licenses(docs: DataFrame, model: LicenseModel, overlap: float = 0.7, least: float = 0.5, false_rate: float = 0.001, paragraphs: Paragraphs | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line from 0), family, probability, template_overlap, words: the paragraphs
    whose predicted family has probability of at least ``least`` and a template or a grant under its name that confirms it, or that a rule tells.
    Of paragraphs of one family, those that hold another that is found are left out.  Repeated rows repeat.

    paragraphs: what license_paragraphs() made of docs with the same overlap, if it is there already."""
    spark = docs.sparkSession
    p = paragraphs or license_paragraphs(docs, overlap)
    k = len(model.families)
    number = {g: i for i, g in enumerate(vocabulary(p.templates))}
    weights = F.broadcast(spark.createDataFrame([(number[g], w) for g, w in sorted(model.weights.items())], "id int, w array<double>"))
    sums = p.seen.select("_text", F.explode("ids").alias("id")).join(weights, "id").groupBy("_text").agg(*(F.sum(F.get("w", j)).alias(f"s{j}") for j in range(k)))
    scores = F.array(*(F.lit(model.bias[j]) + F.coalesce(F.col(f"s{j}"), F.lit(0.0)) / F.sqrt("_n") for j in range(k)))
    scored = written(p.seen.select("_text", "_n", "granted", "shares").join(sums, "_text", "left").select("_text", "granted", "shares", scores.alias("scores")))
    unknown = F.lit(_unknown_score(scored, p, false_rate))
    top = F.greatest(F.array_max("scores"), unknown)
    z = F.aggregate("scores", F.exp(unknown - F.col("top")), lambda a, x: a + F.exp(x - F.col("top")))
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    mine = F.from_json(F.lit(json.dumps([[t for t, (f, _) in enumerate(model.templates) if f == family] for family in model.families])), "array<array<int>>")
    shared = F.array_max(F.transform(F.get(mine, F.col("_family")), lambda t: F.get("shares", t)))
    good = scored.withColumn("top", top).withColumn("_family", best).select("_text", "_family", "granted", (F.exp(F.array_max("scores") - F.col("top")) / z).alias("probability"), shared.alias("template_overlap"))
    names = F.array(*(F.lit(f) for f in model.families))
    named = F.array_contains("granted", F.get(names, F.col("_family")))
    good = good.where((F.col("probability") >= least) & ((F.col("template_overlap") >= overlap) | named))
    good = good.select("_text", F.get(names, F.col("_family")).alias("family"), "probability", "template_overlap")
    both = p.places.join(good, "_text", "left")
    ruled = F.transform(F.filter("_told", lambda f: ~f.eqNullSafe(F.col("family"))), lambda f: F.struct(f.alias("family"), F.lit(1.0).alias("probability"), F.lit(1.0).alias("template_overlap")))
    one = F.struct("family", "probability", "template_overlap")
    every = both.select("doc_id", "_row", "first", "last", "words", F.explode(F.when(F.col("family").isNull(), ruled).otherwise(F.concat(F.array(one), ruled))).alias("_f")).select("doc_id", "_row", "first", "last", "words", "_f.*")
    # in this order a paragraph comes after all that it holds
    before = Window.partitionBy("_row", "family").orderBy("last", F.col("first").desc(), F.col("template_overlap").desc(), "words").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_inner", F.max("first").over(before)).where(F.col("_inner").isNull() | (F.col("_inner") < F.col("first")))
    return every.select("doc_id", F.col("first").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), "template_overlap", "words")
