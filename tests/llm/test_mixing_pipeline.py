import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seatwatch.llm import mixing


def fill(sizes, weights, share, most):
    """Water-filling by rounds."""
    total, fixed = sum(sizes.values()) * share, {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        level = left / sum(free.values()) if free else 0
        over = [s for s in free if level * free[s] > sizes[s] * most + 1e-9]
        if not over or not free:
            return fixed | {s: level * w for s, w in free.items()}
        fixed |= {s: sizes[s] * most for s in over}


@pytest.mark.parametrize("share,most", [(1.5, 2.0), (0.3, 1.0), (1.9, 2.0)])
def test_targets_and_takes(documents, share, most):
    rows = [(i, "w " * (i % 37), f"s{i % 7 if i % 3 else 0}") for i in range(900)] + [(2000, None, "s1"), (2001, "a b", None), (None, "c d e", None), (5, "dup dup", "s5"), (5, "dup dup", "s5"), (3000, "big " * 50000, "s2"), (3001, "", "zero")]
    docs = documents(rows, ["size", "target", "taken", "weight"])
    got = mixing.mix_sources(docs, mixing.cyclic_weights(docs, [5, 2, 1]), share, most).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}, share, most)
    assert sorted(set(got["target"].round(3))) == sorted({round(x, 3) for x in want.values()})
    assert (got["taken"] <= most * got["size"]).all() and (got["taken"] >= 0).all()
    for t, part in got.groupby("target"):
        if len({round(x, 6) for x in want.values() if abs(x - t) < 1e-6}) == 1 and sum(abs(x - t) < 1e-6 for x in want.values()) == 1:
            assert abs(part["taken"].sum() - t) <= 0.5 + 1e-6
    again = mixing.mix_sources(docs.repartition(7), mixing.cyclic_weights(docs, [5, 2, 1]), share, most).toPandas()
    assert sorted(map(tuple, again.fillna(-1).values.tolist())) == sorted(map(tuple, got.fillna(-1).values.tolist()))


def test_empty_table(documents):
    docs = documents([])
    assert mixing.mix_sources(docs, mixing.cyclic_weights(docs, [5, 2, 1])).count() == 0


def test_pipeline_stages(spark, documents):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("clash"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], folder).cache())
        assert seen[-1].columns == docs.columns, name
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    poor = set(labels.index[labels["quality"] == 0])
    assert len((ids[0] - ids[1]) & set(labels.index) - poor) == 0 and len(poor & ids[1]) <= 2
    clean = set(labels.index[labels["toxic"] == 0])
    assert not (ids[1] - ids[2]) & clean and len(ids[1] - ids[2]) > 20
    from test_near_dedup import brute

    left = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert ids[3] == {d for d, _, c in brute(left, 5, 80) if d == c}
    squeeze = lambda t: " ".join(t.lower().split())
    items = [squeeze(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    has = {r["doc_id"] for r in seen[3].collect() if any(i in squeeze(r["text"]) for i in items)}
    assert has <= ids[3] - ids[4] and len(ids[3] - ids[4]) <= len(has) + 1
    assert corpus_pipeline.STAGES[-1][1](spark, seen[4], folder).count() == len(ids[4])


def test_stages_take_empty_and_odd_tables(spark, documents):
    folder = "/root/testdata/sf0.001"
    for rows in ([], [(1, None), (1, None), (None, ""), (2, "x"), (3, "same text here it is"), (4, "same text here it is")]):
        docs = documents(rows, ["size", "label"])
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() <= len(rows)


def test_rows_without_an_id_share_the_cut(documents):
    """Rows of one key are not ordered: at the cut they take equal parts."""
    rows = [(None, "w " * 10, "a")] * 40 + [(i, "w " * 5, "b") for i in range(10)] + [(7, "w " * 3, "c")] * 9
    docs = documents(rows)
    got = mixing.mix_sources(docs, mixing.cyclic_weights(docs, [5, 2, 1])).collect()
    assert len(got) == 59 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for size in (10, 5, 3):
        own = [r for r in got if r["size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= len(own)
