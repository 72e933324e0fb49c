import random

import numpy as np
import pytest

from seatwatch.llm import decontamination as d


def squeeze(t):
    return " ".join((t or "").lower().split())


def least_edits(item, text):
    """Fewest edits that turn item into a part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text))
        rng.choice([lambda: text.insert(i, "q"), lambda: text.pop(i), lambda: text.__setitem__(i, "z")])()
    return "".join(text)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))


def test_equals_brute_force(spark, documents):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([4, 12, 20, 35, 35])] + [(7, None), (8, "")]
    rows = []
    for k in range(40):
        body = prose(rng, rng.randint(0, 40))
        item = rng.choice(items[:5])[1]
        e = rng.choice([0, 0, 1, 2, 5, 9, 14])
        rows.append((k, f"{body}  {edited(rng, item, e).upper()}\n{prose(rng, 5)}" if k % 4 else body))
    rows += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (103, items[3][1] * 2 + " x" * 20000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.contaminated_passages(documents(rows, ["item_id", "edits"]), benchmark).collect()}
    want = {}
    for k, t in rows:
        for i, item in items:
            s = squeeze(item)
            if s and len(t or "") < 9000:
                e = least_edits(s, squeeze(t))
                if e <= max(min(int(d.RATE * len(s)), (len(s) - d.Q) // d.Q), 0):
                    want[k, i] = e
    want[103, 3] = 0
    assert got == want
    left = d.without_benchmark(documents(rows), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, _ in rows if k not in {a for a, _ in want})


def test_spans_and_slices(spark, documents, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(6)]
    docs = documents([(1, f"x y {items[0][1]} z"), (2, items[5][1]), (3, prose(rng, 50))])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = d.contaminated_passages(docs, benchmark).collect()
    monkeypatch.setattr(d, "INDEX_CHARS", 200)
    many = d.contaminated_passages(docs, benchmark).collect()
    key = lambda rows: sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in rows)
    assert key(one) == key(many) == [(1, 0, 4, 4 + len(items[0][1])), (2, 5, 0, len(items[5][1]))]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated_passages(documents([(1, "a")]), none).count() == 0
    assert d.without_benchmark(documents([(1, "a")]), none).count() == 1
    some = spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string")
    assert d.contaminated_passages(documents([]), some).count() == 0


@pytest.mark.parametrize("q", [1, 2, 3, 6, 10, 13])
def test_gram_hashes(q):
    codes = np.random.default_rng(q).integers(0, 3, 200).astype(np.uint32)
    h = d.gram_hashes(codes, q)
    assert len(h) == 201 - q
    same = {}
    for i in range(len(h)):
        assert same.setdefault(codes[i : i + q].tobytes(), h[i]) == h[i]
    assert len(set(same.values())) == len(same)
    assert len(d.gram_hashes(codes[: q - 1], q)) == 0


def test_short_items_match_as_words_of_their_own(spark, documents):
    import re

    rng = random.Random(2)
    items = [(i, w) for i, w in enumerate(["a", "ab", "x1", "(b)", "nine char", "Eight ch", "ß", "c++", "a b c"])]
    pieces = [w for _, w in items] + ["(ab)", "xab", "ab,", "a-ab", "c++11", "nine  CHAR.", "nine chars", "a\nb c", "é", ".", "1"]
    rows = [(k, " ".join(rng.choices(pieces, k=rng.randint(0, 4)))) for k in range(60)] + [(99, None)]
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in d.contaminated_passages(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, t in rows:
        for i, item in items:
            s, text = squeeze(item), f" {squeeze(t)} "
            for m in re.finditer(f"(?={re.escape(s)})", text):
                a, b = m.start(), m.start() + len(s)
                if not (text[a - 1].isalnum() and s[0].isalnum()) and not (text[b].isalnum() and s[-1].isalnum()):
                    want[k, i] = (a - 1, b - 1, 0)
                    break
    assert got == want


def test_items_with_a_shared_start_stay_cheap():
    import time

    rng = random.Random(1)
    start = prose(rng, 12)[:45]
    index = d.build_index([(i, start + prose(rng, 30)) for i in range(500)])
    text = f"{prose(rng, 200)} {start} {prose(rng, 150)}"
    began = time.time()
    assert d.find_passages([text], index, d.lookup_table(index)) == []
    assert time.time() - began < 1
    text = f"{prose(rng, 100)} {edited(rng, ''.join(map(chr, index.codes[77])), 3)} {prose(rng, 50)}"
    assert [x[1] for x in d.find_passages([text], index, d.lookup_table(index))] == [77]


@pytest.mark.parametrize("seed", range(4))
def test_alignment_of_many_pairs(seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(30):
        item = prose(rng, rng.randint(1, 12))
        text = edited(rng, prose(rng, 3) + item + prose(rng, rng.randint(0, 4)), rng.randint(0, 5))[rng.randint(0, 9) :]
        pairs.append((item, text, rng.randint(0, 6)))
    codes = lambda t: np.array([ord(c) for c in t], np.uint32)
    for (item, text, most), found in zip(pairs, d.align_all([(codes(a), codes(b), e) for a, b, e in pairs])):
        fewest = least_edits(item, text)
        assert (found is None) == (fewest > most)
        if found:
            e, s, t = found
            assert e == fewest and least_edits(item, text[s:t]) == e and all(least_edits(item, text[:x]) > e for x in range(t))
