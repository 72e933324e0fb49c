"""Exact top-k by integer inner product: candidates in order of falling length, partial sums in rotated coordinates.

1. A rotation that gathers the squared lengths in the first coordinates: the right singular
   vectors of all vectors, from the sum of their outer products (d x d, summed by Spark).
2. Candidates are dealt by falling length (range partitioning, ids break ties) into blocks
   of bounded size and written.  The longest vector of each block is its bound.
3. Every query meets the first block, which gives it a score that it has to beat, and then
   those blocks that can still hold one by |query| * |longest of the block|; as blocks fall in
   length these are a prefix.  Blocks of queries meet blocks of candidates, each pair in one
   task with two bounded groups.
4. Within a pair of blocks candidates are taken by falling length, a chunk at a time.  Of each
   stage of coordinates the partial sum plus the product of what is left of both lengths
   (Cauchy-Schwarz) bounds the score; pairs whose bound is below the query's k-th score go.
   What stays is scored exactly in 64-bit integers.

The rotation works in floats and only prunes, with a slack far above its rounding; scores
come from the integers.  Vectors that are null or hold a null or non-finite component take no
part, nor do those of length 2**31 and above, whose products would not fit 64 bits.  Shorter
vectors count as padded with zeros.  A query doesn't meet rows of its own id; of rows that
repeat a query's id the smallest vector asks.  A null id is never a query and comes last
among ties (id 2**63 - 1 stands for it in between).  No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BLOCK = 8192  #: vectors in a block, of candidates and of queries, where they have up to 64 components
CHUNK = 1024  #: rows and columns of the scores that one step bounds at once
STAGES = 4
DIRECTORY = 1 << 14  #: entries of the directory of block lengths
LONGEST = float(1 << 31)
_LOW, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, column: str, scale: int = 256) -> DataFrame:
    """(id, v array<int>, length double) of the rows that take part; vectors (vec_id, column)."""
    able = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < LONGEST / scale, F.lit(False)) & ~F.isnan(x.cast("double")))
    some = vectors.where(F.col(column).isNotNull() & F.coalesce(able, F.lit(False)))
    whole = some.select(F.col("vec_id").alias("id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return whole.withColumn("length", length).where(F.col("length") < LONGEST)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """width x width, orthonormal: directions by falling share of the squared lengths of all vectors."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["i", "x"])

    sums = vectors.select("v").mapInArrow(outer, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # width ** 2 rows
    gram = np.zeros(width * width)
    for r in sums:
        gram[r["i"]] = r["x"]
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


def _rotated(m: np.ndarray, turn: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rotated rows, and of each the length of what follows each cut."""
    r = m @ turn
    rest = np.sqrt(np.maximum(np.cumsum(r[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    rest = np.concatenate([rest, np.zeros((len(r), 1))], axis=1)
    return r, rest[:, cuts]


class _Best:
    """The k best (score, id) of each of n queries; ids break ties, the smaller first."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()  # what a score must reach
        self.score, self.id = np.full((len(least), k), _LOW), np.full((len(least), k), _NO_ID)
        self.full = np.zeros((len(least), k), bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        held = self.full[touched]
        q = np.concatenate([query, np.repeat(touched, held.sum(1))])
        s, i = np.concatenate([score, self.score[touched][held]]), np.concatenate([ids, self.id[touched][held]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.full[touched] = False
        self.score[q[top], place[top]], self.id[q[top], place[top]], self.full[q[top], place[top]] = s[top], i[top], True
        whole = touched[self.full[touched].all(1)]
        self.least[whole] = np.maximum(self.least[whole], self.score[whole, -1])


def _meet(q: np.ndarray, q_id: np.ndarray, least: np.ndarray, c: np.ndarray, c_id: np.ndarray, turn: np.ndarray, k: int) -> _Best:
    """The best candidates of each query within one pair of blocks; c by falling length."""
    d = q.shape[1]
    cuts = sorted({-(-d * i // STAGES) for i in range(STAGES + 1)})
    best = _Best(least, k)
    qr, q_rest = _rotated(q.astype(float), turn, cuts)
    cr, c_rest = _rotated(c.astype(float), turn, cuts)
    for at in range(0, len(c), CHUNK):
        own = slice(at, at + CHUNK)
        longest = c_rest[own, 0].max()
        for lo in range(0, len(q), CHUNK):
            rows = np.arange(lo, min(lo + CHUNK, len(q)))
            slack = 1e-9 * q_rest[rows, 0] * longest + 1e-6
            need = best.least[rows].astype(float) - slack
            able = q_rest[rows, 0] * longest >= need
            rows, slack, need = rows[able], slack[able], need[able]
            if not len(rows):
                continue
            part = np.zeros((len(rows), len(c_rest[own])))
            alive = q_id[rows, None] != c_id[None, own]
            for s, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                part += qr[rows, a:b] @ cr[own, a:b].T
                alive &= part + q_rest[rows, s, None] * c_rest[None, own, s] >= need[:, None]
                if np.count_nonzero(alive) * 32 < alive.size:
                    break
            else:  # part is the score but for rounding: of this chunk the k highest can enter, and their ties
                if part.shape[1] > k:
                    kth = np.partition(np.where(alive, part, -np.inf), -k, axis=1)[:, -k]
                    alive &= part >= kth[:, None] - 2 * slack[:, None]
            i, j = np.nonzero(alive)
            for x in range(0, len(i), 1 << 16):
                qi, cj = rows[i[x : x + (1 << 16)]], at + j[x : x + (1 << 16)]
                score = np.einsum("ij,ij->i", q[qi], c[cj])
                good = score >= best.least[qi]
                if good.any():
                    best.add(qi[good], score[good], c_id[cj[good]])
    return best


def _answers(queries: DataFrame, candidates: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, full): the k best of each query in each of the blocks it meets.

    queries (id, v, least, q_block, block), candidates (id, v, length, q_block, block)."""
    width = len(turn)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = lambda t: t.column("id").combine_chunks().cast(pa.int64()).fill_null(_NO_ID).to_numpy()
        right = right.sort_by([("length", "descending"), ("id", "ascending")])
        q_id = ids(left)
        if len(left) and len(right):
            best = _meet(_matrix(left.column("v"), width), q_id, left.column("least").combine_chunks().to_numpy(), _matrix(right.column("v"), width), ids(right), turn, k)
        else:
            best = _Best(np.zeros(0, np.int64), k)
        row, place = np.nonzero(best.full)
        found = best.id[row, place]
        return pa.table({"query_id": q_id[row], "vec_id": pa.array(found, mask=found == _NO_ID), "score": best.score[row, place]})

    lead = ["q_block", "block"]
    return queries.groupBy(*lead).cogroup(candidates.groupBy(*lead)).applyInArrow(answer, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, column: str, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a condition on vec_id) the k other rows of highest inner
    product of floor(scale * x), the smaller id first among equals."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, column, scale)
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    asked = vectors.where(is_query & F.col("vec_id").isNotNull()).select(F.col("vec_id"), column)
    queries = integer_vectors(asked, column, scale).groupBy("id").agg(F.min("v").alias("v"), F.min_by("length", "v").alias("length"))
    n_queries = queries.count() if size["n"] else 0
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size["width"], 1)
    turn = rotation(whole, width)

    rows = max(256, min(BLOCK, (BLOCK << 6) // width))
    n_blocks, q_blocks = -(-size["n"] // rows), -(-n_queries // rows)
    dealt = whole.repartitionByRange(n_blocks, F.desc("length"), F.asc("id")) if n_blocks > 1 else whole
    blocks = written(dealt.withColumn("block", F.spark_partition_id() if n_blocks > 1 else F.lit(0)))
    per = -(-n_blocks // DIRECTORY)
    longest = blocks.groupBy(F.floor(F.col("block") / per).cast("int").alias("entry")).agg(F.max("length").alias("length"), F.max("block").alias("last")).orderBy(F.desc("length")).collect()  # DIRECTORY rows at most
    first = longest[0]["last"]
    everywhere = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))

    near = queries.select("id", "v", F.lit(_LOW).alias("least"), "q_block", F.lit(first).alias("block"))
    opening = written(_answers(near, everywhere.where(F.col("block") == first), turn, k))
    if n_blocks == 1:
        return _ranked(opening, k).select("query_id", "rank", "vec_id", "score")
    least = opening.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("_least"))
    ends = F.lit([float(r["length"]) for r in longest])
    lasts = F.lit([int(r["last"]) for r in longest])
    bar = F.coalesce("_least", F.lit(_LOW))
    able = F.size(F.filter(ends, lambda x: x * F.col("length") * (1 + 1e-9) + 1e-6 >= bar))
    rest = queries.join(least, "id", "left").select("id", "v", bar.alias("least"), "q_block", F.explode(F.slice(lasts, 1, able) if per == 1 else F.flatten(F.transform(F.slice(lasts, 1, able), lambda x: F.sequence(x - x % per, x)))).alias("block"))
    closing = _answers(rest.where(F.col("block") != first), everywhere.where(F.col("block") != first), turn, k)
    return _ranked(opening.unionByName(closing), k).select("query_id", "rank", "vec_id", "score")
