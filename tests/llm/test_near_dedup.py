import random
import re

import pytest

from seatwatch.llm import near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_set(text, n):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [word_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                up[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d, len(s), first.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, bases=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 30, 90, 160]))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 18)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(documents, seed, n, percent):
    rows = corpus(seed)
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, rows[0][1].upper()), (9005, "Über Ä b"), (9006, "ÜBER Ä B"), (rows[3][0], rows[3][1]), (rows[4][0], "another text of one id"), (9007, "word " * 30000)]
    long = " ".join(f"n{i}" for i in range(60))
    rows += [(9010, long), (None, long + " one"), (None, long + " one two"), (9011, long + " one two three")]  # linked through rows without an id
    got = near_dedup.near_duplicates(documents(rows, ["node", "cluster", "kept", "labels"]), n, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, n, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_large_group_lose_nothing(documents, monkeypatch):
    rows = corpus(5, bases=2, copies=60)
    monkeypatch.setattr(near_dedup, "REGION", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 300)
    got = near_dedup.near_duplicates(documents(rows), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, 3, 85)


@pytest.mark.parametrize("near", [True, False])
def test_large_regions_by_representatives(documents, monkeypatch, near):
    """Regions and clusters of many blocks, of near copies of one text or of chains that only their ends' neighbours link."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(90):
        text = list(base)
        if near:
            text[rng.randrange(80)] = f"x{k}"
        else:  # a window that slides: only neighbours are similar enough
            text = [f"w{i}" for i in range(3 * (k % 45), 80 + 3 * (k % 45))] + [f"x{k // 45}"]
        rows.append((k + 1, " ".join(text)))
    monkeypatch.setattr(near_dedup, "REGION", 6)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 500)
    got = near_dedup.near_duplicates(documents(rows), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, 3, 85)


def test_recall_where_regions_split(spark, documents, monkeypatch):
    """Pairs just at the threshold, all regions cut to full depth: the share found is stated, and over 0.9."""
    monkeypatch.setattr(near_dedup, "REGION", 2)
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = [f"p{k}w{i}" for i in range(100)]
        rows.append((2 * k, " ".join(text)))
        for at in rng.sample(range(10, 90, 5), 2):
            text[at] = "z"
        rows.append((2 * k + 1, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(rows), 3, 85).collect()}
    want = {d: c for d, _, c in brute(rows, 3, 85)}
    linked = [d for d in want if want[d] != d]
    assert len(linked) > 40 and sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == d or got[d] == want[d] for d in got)


def test_texts_of_one_id_go_by_their_own_class(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    kept = near_dedup.keep_first_of_class(documents([(1, a), (5, a + " x"), (5, b), (5, b)], ["row", "_row", "kept"])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (5, b)]
    assert all(r["row"] == "clash" for r in kept)


def test_empty_table_and_stage(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    docs = documents([(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, ""), (None, "a b c d e f"), (4, None)])
    kept = near_dedup.keep_first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 3, 4, None]


def test_query_equals_sql(spark, folder):
    from oracle import compare

    from seatwatch.llm.queries import ORACLE, QUERIES

    compare(spark, folder, QUERIES["op2_near_dedup"], ORACLE["op2_near_dedup"])
