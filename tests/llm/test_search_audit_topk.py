"""Lexical search, filter audit and exact top-k against brute force."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwatch.llm import filter_audit, inner_products, lexical_search

# --- ranked lexical search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def rank(docs, items, k):
    sets = [(d, terms(t)) for d, t in docs]
    total, length = sum(bool(w) for _, w in sets), sum(len(w) for _, w in sets)
    df = Counter(t for _, w in sets for t in set(w))
    out = []
    for item, text in set(items):
        found = []
        for d, w in sets:
            tf, m = Counter(w), 75 + 25 * len(w) * total // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, k=20, parts=3):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, rank string, n int").repartition(parts)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, score string")
    got = lexical_search.search_documents(d, i, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Éte", "x_y", "9", "ñ-ñ"]
    share = 1 / np.arange(1, len(words) + 1)
    return [(int(i * 3 % n), " ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum()))) for i in range(n)]


@pytest.mark.parametrize("shard,opened", [(8192, 256), (7, 1), (64, 3)])
def test_search_equals_brute_force(spark, monkeypatch, shard, opened):
    docs = corpus(150) + [(500, None), (501, ""), (502, "   ---"), (503, "W1 w1 W1"), (503, "w1 W1 w1"), (None, "w3 w3 w40"), (504, "the w50 " * 3000), (505, "w1")]
    items = [(i, t) for i, (_, t) in enumerate(corpus(12, 5))] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w1"), (93, "w1 w1 w1"), (None, "w3"), (95, "w50 ÉTE été"), (96, "w2 " * 500)]
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "OPENED", opened)
    assert search(spark, docs, items) == rank(docs, items, 20)


def test_search_in_slices_and_shards_by_postings(spark, monkeypatch):
    docs, items = corpus(80), [(i, t) for i, (_, t) in enumerate(corpus(9, 3))]
    monkeypatch.setattr(lexical_search, "SLICE_CHARS", 300)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 50)
    assert search(spark, docs, items, k=3) == rank(docs, items, 3)


def test_search_with_ties_and_one_hot_text(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(i, f"other {i}") for i in range(500, 540)]
    items = [(1, "same words here"), (2, "other here")]
    assert search(spark, docs, items, parts=7) == rank(docs, items, 20)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_search_of_empty_tables(spark, docs, items):
    assert search(spark, docs, items) == rank(docs, items, 20)


def test_tree_opens_fewer_nodes_than_documents(monkeypatch):
    monkeypatch.setattr(lexical_search, "OPENED", 16)
    rng = np.random.default_rng(1)
    tree = lexical_search.WaveletTree(np.repeat(np.arange(4), 1000), np.tile(np.arange(1000), 4), rng.integers(1, 10**6, 4000), 1000)
    score, doc = tree.best(np.array([1, 3, 9]), np.array([2, 5, 7]), 10, 1)
    whole = tree.best(np.array([1, 3]), np.array([2, 5]), 1000, 1)
    top = np.lexsort((whole[1], -whole[0]))[:10]
    order = np.lexsort((doc, -score))[:10]
    assert (score[order] == whole[0][top]).all() and (doc[order] == whole[1][top]).all() and len(doc) < 500


# --- filter interaction audit ----------------------------------------------------------


def audit(docs, labels):
    """Every order applied filter by filter to the documents."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    parts, rows = {}, []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" * (len(w) < 200)) + ("B" * (100 * len(set(w)) < 50 * len(w))) + ("C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))) + ("D" * bool(re.search("[#$%&*|]", t))) + ("E" * (d is not None and d > first[t]))
        parts.setdefault(lang or "", []).append((f, d in good, d in toxic))
    for part, own in parts.items():
        shapley, mine = Counter(), []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                out = [r for r in left if x in r[0]]
                redundant = sum(x in r[0] for r in gone)
                left, gone = [r for r in left if x not in r[0]], gone + out
                shapley[x] += len(out)
                mine.append((part, "".join(order), step, len(left), len(out), redundant, sum(r[0] == x for r in own), sum(r[1] for r in out), sum(r[2] for r in out), x))
        rows += [(*r[:-1], shapley[r[-1]]) for r in mine]
    return sorted(rows)


def test_audit_equals_every_order_by_hand(spark):
    rng = np.random.default_rng(2)
    texts = ["w " * 250, "Big WORDS " * 30, "a $ b", " ".join(f"v{i}" for i in range(300)), "", None, "\x0b\tx\n", "É" * 100, "X", " ".join(f"u{i} #" for i in range(220)), "long " * 60000]
    docs = [(int(rng.integers(0, 90)), texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for _ in range(160)] + [(None, "X", "en"), (None, None, None), (7, "X", "en"), (7, "X", "en")]
    labels = [(int(rng.integers(0, 90)), int(rng.integers(2)), int(rng.integers(2))) for _ in range(80)] + [(None, 1, 1), (7, None, None), (7, 1, 1)]
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], "doc_id long, text string, lang string, mask string, part string")
    got = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit(docs, labels)


def test_audit_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit_filters(docs, none).count() == 0
    rows = [(1, "a", "en"), (2, "a", "fr")]
    assert sorted(map(tuple, filter_audit.audit_filters(spark.createDataFrame(rows, docs.schema), none).collect())) == audit(rows, [])


def test_counts_invert_the_sums(spark):
    rows = [("p", m, m % 3 == 0, m == 7) for m in range(8) for _ in range(m * m)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), 3)
    got = filter_audit.mask_counts(sums, 3).first()
    assert got["all"] == [m * m for m in range(8)] and got["good"] == [m * m * (m % 3 == 0) for m in range(8)] and got["toxic"] == [49 * (m == 7) for m in range(8)]


# --- exact top-k -----------------------------------------------------------------------


def nearest(rows, k, every):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    asks, out = {}, []
    for i, v in whole:
        if i is not None and i % every == 0:
            asks[i] = min(v, asks.get(i, v))
    for q, v in asks.items():
        found = sorted(((-dot(v, w), i is None, i or 0, i) for i, w in whole if i != q), key=lambda x: x[:3])[:k]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(found, 1)]
    return sorted(out, key=repr)


def top(spark, rows, k=5, every=5, parts=3):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string").repartition(parts)
    got = inner_products.top_inner_products(df, "embedding", F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("block,chunk", [(8192, 1024), (16, 5), (50, 16)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(inner_products, "BLOCK", block)
    monkeypatch.setattr(inner_products, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    make = lambda s: [float(np.float32(x)) for x in rng.normal(size=12) * s]
    rows = [(i, make(rng.choice([0.01, 0.3, 2.0]))) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(i, rows[3][1]) for i in range(500, 530)]  # copies
    rows += [(600, None), (605, [1.0, None]), (610, [math.inf] * 12), (615, [math.nan] + [0.0] * 11), (620, []), (625, [1.0, -1.0]), (630, [0.0] * 12), (None, make(1)), (10, make(1)), (10, make(1)), (3, make(1)), (640, [1000.0] * 12)]
    assert top(spark, rows) == nearest(rows, 5, 5)


def test_top_k_prunes_and_keeps_all_blocks_that_can_matter(spark, monkeypatch):
    """Short vectors can't enter: their blocks aren't met, but those at the border are."""
    monkeypatch.setattr(inner_products, "BLOCK", 256)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / (1 + i)]) for i in range(1500)]
    assert top(spark, rows, every=50) == nearest(rows, 5, 50)
    monkeypatch.setattr(inner_products, "DIRECTORY", 2)
    assert top(spark, rows, every=50) == nearest(rows, 5, 50)


@pytest.mark.parametrize("rows", [[], [(5, None)], [(5, [1.0])], [(5, [1.0]), (6, [2.0])], [(1, [1.0])], [(None, [1.0])]])
def test_top_k_of_few_rows(spark, rows):
    assert top(spark, rows) == nearest(rows, 5, 5)


def test_vectors_too_long_for_64_bits_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0e38, 0.0]), (2, [2.0, 0.0])]
    assert top(spark, rows) == [(0, 1, 2, 256 * 512)]
