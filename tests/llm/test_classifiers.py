import numpy as np
import pytest

from seatwatch.llm import license_scan, quality, text_arrays, toxicity
from seatwatch.llm.queries import held_out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels, train=~held_out())
    r = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(held_out()).toPandas()
    assert r["score"].between(0, 1).all()
    assert ((r["predicted"] == 1) & (r["toxic"] == 0)).sum() <= 1
    assert ((r["predicted"] == 1) & (r["toxic"] == 1)).sum() >= 0.7 * r["toxic"].sum()
    again = toxicity.fit_toxicity(docs, labels, train=~held_out())
    assert np.array_equal(again.weights, model.weights)


def test_toxicity_score_equals_plain_sum(corpus, documents):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    texts = [None, "", "  ", "You IDIOT\nclown", "the worthless " * 40000, "ä" * 10, *(r["text"] for r in docs.limit(5).collect())]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(list(enumerate(texts)), ["score", "predicted"]), model).collect()}
    for i, t in enumerate(texts):
        plain = f" {' '.join((t or '').lower().split())} "
        found = {g: f for k, n in enumerate(toxicity.ORDERS) for g in {plain[j : j + n] for j in range(len(plain) - n + 1)} for f in [bucket(g) + (k << toxicity.BITS)]}
        eta = model.bias + sum(float(model.weights[f]) for f in set(found.values()))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-eta)), rel=1e-4)


def bucket(gram):
    return int(text_arrays.gram_buckets(np.array([ord(c) for c in gram], np.uint32), len(gram), toxicity.BITS)[0])


def test_ids_of_any_type_and_repeated_ids(spark):
    """Ids are strings; of an id with several texts the smallest counts, so that fits agree."""
    docs = spark.createDataFrame([(f"d{i}", ("you idiot " if i % 3 == 0 else "a fine day ") * (i % 5 + 1) + str(i)) for i in range(60)] + [("d1", "other text"), ("d1", "a text"), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id string, quality int, toxic int")
    one, two = (toxicity.fit_toxicity(d, labels) for d in (docs, docs.orderBy("text").repartition(3)))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    scored = {(r["doc_id"], r["score"] > 0.5) for r in toxicity.score_toxicity(docs, one).collect()}
    assert ("d3", True) in scored and ("d4", False) in scored
    ratings = quality.graded_labels(labels)
    first, again = (quality.fit_quality(d, ratings) for d in (docs, docs.orderBy("text").repartition(3)))
    assert np.array_equal(first.weights, again.weights)
    assert quality.score_quality(docs, first).count() == docs.count()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 100, 127, 128, 200])
def test_repeats_count_every_word(n):
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in rng.integers(0, 30, n)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes, _ = text_arrays.word_hashes(data, np.array([0, len(data)]), lower=False)

    def repeats(window):
        return (len(window) - len(set(window))) / (len(window) - 1) if len(window) > 1 else 0.0

    if n < 64:
        want = repeats(words)
    else:
        whole = n // 64
        want = (sum(repeats(words[64 * i : 64 * i + 64]) for i in range(whole)) * 64 + (repeats(words[-64:]) * (n % 64) if n % 64 else 0)) / n
    if n > 1:
        assert quality._window_repeats(hashes) == pytest.approx(want)
    if n > 64 and n % 64:  # words at the end are looked at
        assert quality._window_repeats(np.append(hashes[:-1], hashes[-2])) != quality._window_repeats(np.append(hashes[:-1], np.uint64(1)))


def test_models_of_no_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None), (None, "x")])
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).count() == 3
    assert quality.keep_sound(docs, quality.fit_quality(docs, quality.graded_labels(none))).count() == 3
    assert toxicity.keep_civil(docs, toxicity.fit_toxicity(docs, none)).count() == 3
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_quality(docs, quality.graded_labels(odd))).count() == 3
    empty = documents([])
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, odd)).count() == 0


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    ratings = quality.graded_labels(labels)
    model = quality.fit_quality(docs, ratings, train=~held_out())
    assert (np.diff(model.thresholds) > 0).all()
    r = quality.score_quality(docs, model).join(ratings, "doc_id").where(held_out()).toPandas()
    assert (r["keep"] == (r["grade"] >= 1)).mean() > 0.97
    means = r.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[2] and r["tail"].map(lambda t: t[0] >= t[1]).all()


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    rows = [(np.array([5, 9], np.int32), np.array([g + rng.normal(0, 0.3), 1.0], np.float32)) for g in grade]
    m = quality.fit_ordinal(rows, grade, np.bincount(grade).tolist(), steps=400)
    eta = np.array([v @ m.weights[i] for i, v in rows])
    got = (eta[:, None] > m.thresholds).sum(1)
    assert (np.diff(m.thresholds) > 0).all() and (got == grade).mean() > 0.85


def test_quality_features_do_not_depend_on_neighbours(documents):
    model = quality.OrdinalModel(np.random.default_rng(1).normal(size=quality.WIDTH), np.array([0.0, 1.0]))
    texts = ["", None, "One two two.", "X" * 3_000_000, "ünï çode", "a"]
    together = {r["doc_id"]: r["expected_grade"] for r in quality.score_quality(documents(list(enumerate(texts)), ["tail", "keep"]), model).collect()}
    for i, t in enumerate(texts):
        index, values = quality.text_features(np.frombuffer((t or "").encode(), np.uint8))
        eta = float(values @ model.weights[index])
        assert together[i] == pytest.approx(float((1 / (1 + np.exp(model.thresholds - eta))).sum()), rel=1e-4)


def test_license_scan(spark, documents):
    lines = [
        (1, "Some prose.\nReleased under the MIT License.\nMore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "He renewed his driver's license at the office."),
        (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (6, "Licensed under CC BY-NC 4.0."), (7, "the license of the free public general version " * 20000), (8, "No licence here"),
    ]
    model = license_scan.fit_licenses(["Some prose of the corpus.", "And another line."])
    got = license_scan.scan_licenses(documents(lines, ["family", "line", "gram"]), model).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(1, 1, "MIT"), (2, 0, "GPL"), (6, 0, "CC-BY-NC"), (6, 0, "CC-BY-NC"), (6, 1, "Apache")]
    assert license_scan.scan_licenses(documents([]), model).count() == 0


def test_license_scan_of_wrapped_headers_and_titles(documents):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    apache = "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License. You may obtain a copy of the License at"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the notice."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    free = "This is free and unencumbered software released into the public\ndomain."
    marked = lambda t, sign: "\n".join(f"{sign} {x}" for x in t.split("\n"))
    texts = {
        1: (f"Copyright (c) 2020 A\n\n{mit}", {(2, "MIT")}), 2: ("/*\n" + marked(gpl, " *") + "\n */\nint x;", {(1, "GPL")}), 3: (marked(apache, "#"), {(0, "Apache")}), 4: (f"Words before. {bsd}", {(0, "BSD")}),
        5: (marked(isc, "//"), {(0, "ISC")}), 6: (f"prose\n\n{free}", {(2, "Unlicense")}), 7: ("MIT License\n\nCopyright (c) 2020 A", {(0, "MIT")}), 8: ("// SPDX-License-Identifier: BSD-2-Clause\nx", {(0, "BSD")}),
        9: ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", {(0, "MIT"), (0, "Apache")}), 10: ("The MIT License question was\ndebated by the council, and the general public\nlost interest in a license.", set()),
        11: (" Apache License\n Version 2.0, January 2004", {(0, "Apache")}), 12: ("SPDX-License-Identifier: NOASSERTION", set()), 13: ("Released under the MIT License.\nmore\nReleased under the MIT License.", {(0, "MIT"), (2, "MIT")}),
        14: ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", {(0, "GPL")}),
    }
    model = license_scan.fit_licenses(["Some prose of the corpus.", "And another line."])
    got = {i: set() for i in texts}
    for r in license_scan.scan_licenses(documents([(i, t) for i, (t, _) in texts.items()]), model).collect():
        assert (r["paragraph"], r["family"]) not in got[r["doc_id"]]
        got[r["doc_id"]].add((r["paragraph"], r["family"]))
    assert got == {i: want for i, (_, want) in texts.items()}


def test_license_scores_equal_plain_python(documents):
    import math

    model = license_scan.fit_licenses(["Plain line."])
    texts = [t for f in license_scan.TEMPLATES.values() for t in f]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(list(enumerate(texts))), model, overlap=0.0, least=0.0).collect()}
    right = 0
    for i, t in enumerate(texts):
        g = license_scan.grams(license_scan.tokens(t))
        s = license_scan._scores(model, g)
        top = max(0.0, *s)
        p = math.exp(max(s) - top) / (sum(math.exp(x - top) for x in s) + math.exp(-top))
        if i in got:
            assert got[i]["probability"] == pytest.approx(p, abs=2e-6)
            right += t in license_scan.TEMPLATES[got[i]["family"]]
    assert right >= 0.9 * len(texts)


def test_license_gate_loses_nothing():
    """Any text that shares the overlap with a template has a gate word."""
    import random

    rng = random.Random(6)
    templates = license_scan.template_bigrams(license_scan.TEMPLATES)
    gate = license_scan.gate_words(templates, 0.7)
    reached = 0
    for (f, bigrams), t in zip(templates, [t for f in sorted(license_scan.TEMPLATES) for t in license_scan.TEMPLATES[f]]):
        words = license_scan.tokens(t)
        for _ in range(200):
            lost = set(rng.sample(sorted(set(words)), rng.randint(0, min(6, len(set(words))))))
            text = [w if w not in lost else "x" for w in words]
            if len(license_scan.grams(text, (2,)) & set(bigrams)) >= 0.7 * len(bigrams):
                reached += 1
                assert any(g in " ".join(text) for g in gate)
        assert len([b for b in bigrams if not set(b.split()) & set(gate)]) < 0.7 * len(bigrams)
    assert reached > 1000
    assert license_scan.gate_words(templates, 0.0) is None


def test_license_scan_of_reworded_notices_and_calibration(documents):
    texts = {
        1: ("To the extent possible under law, the author has waived all copy rights and related or neighboring rights to this work.", "CC0"),
        2: ("This is free and unencumbered software released into the public-domain.", "Unlicense"),
        3: ("Use of this source code is governed by a BSD-style terms that can be found in the file.", "BSD"),
        4: ("Licensed under CC BY 4.0.", "CC-BY"),
    }
    foreign = [(100 + i, f"The council released its program {i} for public transport, and the general purpose was discussed.") for i in range(300)]
    docs = documents([(i, t) for i, (t, _) in texts.items()] + foreign)
    paragraphs = license_scan.license_paragraphs(docs)
    sample = license_scan.foreign_paragraphs(paragraphs, 50)
    assert 20 < len(sample) < 90
    model = license_scan.fit_licenses(sample)
    got = {r["doc_id"]: r["family"] for r in license_scan.scan_licenses(docs, model, paragraphs=paragraphs).collect()}
    assert got == {i: f for i, (_, f) in texts.items()}
    # a model that gives every paragraph a family is held back by the unknown class
    eager = license_scan.LicenseModel(model.families, model.weights, [b + 9 for b in model.bias], model.templates)
    scored = license_scan.scan_licenses(docs, eager, overlap=0.0, least=0.5, paragraphs=paragraphs).where("doc_id >= 100")
    assert scored.count() == 0


def test_license_scan_of_grants_under_names(documents):
    """Sentences that training has not seen, under all names of all families; mentions that grant nothing; usual other paragraphs."""
    frames = ["You may use these files under the terms of the {}.", "The code in this folder is distributed under {}.", "All examples of the book are made available to readers under the {} by the author.", "The dataset was released to the public under the {}."]
    grants = [(f.format(n), family) for family in sorted(license_scan.NAMES) for n in license_scan.NAMES[family] for f in frames]
    known = [(f.format(n), family) for family in sorted(license_scan.NAMES) for n in license_scan.NAMES[family] for f in license_scan.FRAMES]
    mentions = ["The {} was debated by the council for an hour.", "Nobody in the room had read the {}."]
    plain = [f.format(n) for names in license_scan.NAMES.values() for n in names for f in mentions] + license_scan.FOREIGN
    plain += [f"He was released under bail {i} of the public court and could not renew his licence or license." for i in range(300)]
    texts = [*grants, *known, *((x, None) for x in plain)]
    docs = documents(list(enumerate(t for t, _ in texts)))
    paragraphs = license_scan.license_paragraphs(docs)
    model = license_scan.fit_licenses(license_scan.foreign_paragraphs(paragraphs))
    got = {}
    for r in license_scan.scan_licenses(docs, model, paragraphs=paragraphs).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    missed = [(t, f, got.get(i)) for i, (t, f) in enumerate(texts) if f and got.get(i) != {f}]
    assert not [(texts[i], f) for i, f in got.items() if texts[i][1] is None]
    assert sum(t in dict(grants) for t, *_ in missed) <= 0.1 * len(grants)
    assert len(missed) <= 0.1 * (len(grants) + len(known))


def test_license_query_finds_planted_lines(spark):
    import re

    from seatwatch.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    cue = re.compile(r"GNU General Public License|MIT License|CC BY-NC|Apache License")
    want = {(i, k) for i, t in zip(docs["doc_id"], docs["text"]) for k, line in enumerate(t.split("\n")) if cue.search(line)}
    got = {(r["doc_id"], r["paragraph"]) for r in QUERIES["op9_licenses"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want
