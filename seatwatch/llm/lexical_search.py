"""Ranked lexical search: dual-sorted wavelet trees over shards of the documents, exact top-k.

1. What the queries' terms (a slice of bounded size) meet in the documents is written once, narrow:
   each document's number of terms, and the query terms it holds with their counts.  Corpus
   statistics (documents, terms, documents of each term) are aggregates of that table.
2. A shard is a bounded number of documents of one task.  The posting lists of its terms, each
   by falling impact, stand one after another in one sequence of documents (numbered by
   doc_id), which a wavelet tree holds: level by level the sequence is parted by the next bit
   of the document, in order, so in each node (a range of documents) every list is an
   interval still sorted by impact.
3. A query intersects its lists' intervals from the root.  The sum of the first impacts of a
   node's intervals bounds every document below; at a leaf it is the score.  Nodes are opened
   best first, a batch at a time, until no bound reaches the k-th score.  What a task has
   found in earlier shards counts for later ones.
4. The k best of each task and query meet in one ranked window, which cuts before its shuffle.

Terms are maximal runs of ASCII letters, digits and bytes from 128 on, only A-Z lower-cased,
compared by 64-bit hashes.  A null text has no terms, nor does a null query; both have no
results.  Rows that repeat a doc_id are documents of their own; rows that repeat an item and its
text ask once; equal scores go by doc_id, a null one last (it stands as 2**63 - 1 in between).
Scores are 64-bit integers; those of 0 are left out.  Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .text_arrays import blocks, word_hashes

SLICE_CHARS = 1 << 21  #: characters of queries that are searched at once
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
OPENED = 256  #: nodes of a query that are opened at once
_NO_ID = np.iinfo(np.int64).max

#: Bytes of terms stay (A-Z lower-cased), all others become a space.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[0x30:0x3A], _TERM[0x61:0x7B], _TERM[0x41:0x5B] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the terms, the rows' first terms) of each block of texts."""
    for lo, data, offsets in blocks(column):
        yield lo, *word_hashes(_TERM[data], offsets, lower=False)


@dataclass
class Queries:
    """A slice of the queries: of each its terms (places in ``vocabulary``) and how often it has them."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def query_slices(items: DataFrame) -> Iterator[Queries]:
    """items (item_id, text); the size of the whole is summed first, what is larger than SLICE_CHARS comes in
    slices by hash."""
    items = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    slices = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE_CHARS)
    for k in range(slices):
        own = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = own.orderBy("item_id", "text").collect()  # a slice
        hashes = []
        for _, h, firsts in term_hashes(pa.array([r["text"] for r in rows], pa.large_string())):
            hashes += np.split(h, firsts[1:-1])
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        found = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for h in hashes]
        if len(vocabulary):
            yield Queries([r["item_id"] for r in rows], vocabulary, [t for t, _ in found], [n for _, n in found])


def matched_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n long, terms array<int>, tfs array<int>): how many terms each document has, and which of the vocabulary."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(vocabulary) - 1
        for batch in batches:
            for lo, hashes, firsts in term_hashes(batch.column("text")):
                rows, n = len(firsts) - 1, np.diff(firsts)
                place = np.minimum(np.searchsorted(vocabulary, hashes), last)
                hit = np.flatnonzero(vocabulary[place] == hashes)
                row = np.searchsorted(firsts, hit, "right") - 1
                pair, tf = np.unique(row * (last + 1) + place[hit], return_counts=True)
                cut = np.searchsorted(pair, np.arange(rows + 1) * (last + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (pair % (last + 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, rows).cast(pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(match, "doc_id long, n long, terms array<int>, tfs array<int>")


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class WaveletTree:
    """Posting lists of one shard as a wavelet tree.  doc: local numbers of documents; impact: of each posting."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order].astype(np.int32)
        self.levels = max(1, (documents - 1).bit_length())
        self.terms, first = np.unique(term, return_index=True)
        self.bounds = np.append(first, len(term)).astype(np.int32)
        n = len(term)
        self.width = n + 1
        self.before = np.zeros((1 << self.levels) + 1, np.int32)  # postings of smaller documents
        np.cumsum(np.bincount(doc, minlength=1 << self.levels), out=self.before[1:])
        self.zeros = np.zeros((self.levels, n + 1), np.int32)  # how many postings before a place go left
        self.impact = np.zeros((self.levels + 1, n + 1), np.int32)
        for level in range(self.levels):
            self.impact[level, :n] = impact
            shift = self.levels - 1 - level
            right = (doc >> shift & 1).astype(bool)
            zeros = self.zeros[level]
            np.cumsum(~right, out=zeros[1:])
            node = doc >> shift + 1
            start, middle = self.before[node << shift + 1], self.before[(2 * node + 1) << shift]
            left = zeros[:n] - zeros[start]
            to = np.where(right, middle + (np.arange(n, dtype=np.int32) - start) - left, start + left)
            doc, impact = _moved(doc, to), _moved(impact, to)
        self.impact[self.levels, :n] = impact
        self.zeros, self.impact = self.zeros.ravel(), self.impact.ravel()

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, local document) of those that can be among the k best of all with a score of ``least`` (1 or
        above): every document of the k best, and maybe more."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[own], weights[own].astype(np.int64)
        scores, docs = [], []
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.bounds[at][None, :], self.bounds[at + 1][None, :]
        bound, level, node = self.impact[low] @ weights, np.zeros(1, np.int32), np.zeros(1, np.int32)
        found = np.zeros(0, np.int64)
        width = max(1, min(OPENED, (1 << 20) // len(at)))
        pool = [(bound, level, node, low, high)]  # opened in turn: the newest parts first, each by falling bound
        heads = np.array([bound[0]])
        while len(heads):
            i = int(heads.argmax())
            if heads[i] < least:
                break
            bound, level, node, low, high = pool[i]
            take = slice(0, width)
            pool[i] = tuple(x[width:] for x in (bound, level, node, low, high))
            live = bound[take] >= least
            level, node, low, high = level[take][live], node[take][live], low[take][live], high[take][live]
            bound, level, node, low, high = self._opened(level, node, low, high, weights, least)
            leaf = level == self.levels
            if leaf.any():
                scores.append(bound[leaf])
                docs.append(node[leaf])
                found = np.concatenate([found, bound[leaf]])
                if len(found) >= k:
                    found = np.partition(found, len(found) - k)[-k:]
                    least = max(least, int(found[0]))
                inner = ~leaf
                bound, level, node, low, high = bound[inner], level[inner], node[inner], low[inner], high[inner]
            if len(pool[i][0]):
                heads[i] = pool[i][0][0]
            else:
                pool.pop(i)
                heads = np.delete(heads, i)
            if len(bound):
                order = np.argsort(-bound, kind="stable")
                pool.append(tuple(x[order] for x in (bound, level, node, low, high)))
                heads = np.append(heads, bound[order[0]])
        return (np.concatenate(scores), np.concatenate(docs).astype(np.int64)) if scores else (found, found)

    def _opened(self, level, node, low, high, weights, least):
        """The children of nodes whose bound reaches ``least``."""
        shift = self.levels - level
        start, middle = self.before[node << shift], self.before[(2 * node + 1) << shift - 1]
        row = (level.astype(np.int64) * self.width)[:, None]
        skip = self.zeros[row[:, 0] + start]
        l0, h0 = self.zeros[row + low] - skip[:, None], self.zeros[row + high] - skip[:, None]
        parts = []
        for side, (a, b) in enumerate([(start[:, None] + l0, start[:, None] + h0), (middle[:, None] + (low - start[:, None]) - l0, middle[:, None] + (high - start[:, None]) - h0)]):
            first = np.where(b > a, self.impact[row + self.width + a], 0)
            bound = first @ weights
            good = bound >= least
            parts.append((bound[good], level[good] + 1, 2 * node[good] + side, a[good], b[good]))
        return [np.concatenate(x) for x in zip(*parts)]


def _moved(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[to] = x
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, n, offsets, terms, tfs) of a bounded number of documents that have postings."""
    held, docs, postings = [], 0, 0

    def flush():
        t = pa.Table.from_batches(held)
        cols = [t.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs")]
        return cols[0].fill_null(_NO_ID).to_numpy(), cols[1].to_numpy(), cols[2].offsets.to_numpy() - cols[2].offsets[0].as_py(), cols[2].flatten().to_numpy(), cols[3].flatten().to_numpy()

    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        total, lo = np.cumsum(sizes), 0
        while lo < len(batch):
            room = SHARD_POSTINGS - postings + (total[lo - 1] if lo else 0)
            hi = min(lo + most - docs, max(int(np.searchsorted(total, room, "right")), lo + (docs == 0)))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                docs, postings, lo = docs + hi - lo, postings + int(sizes[lo:hi].sum()), hi
            if lo < len(batch):
                yield flush()
                held, docs, postings = [], 0, 0
    if held:
        yield flush()


def search_slice(matched: DataFrame, q: Queries, k: int, item_type: pa.DataType) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task for each query.  matched: what matched_terms gives, written."""
    size = matched.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(q.vocabulary), np.int64)
    for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the slice's vocabulary at most
        df[r["t"]] = r["count"]
    total, length = size["documents"], max(size["terms"] or 0, 1)
    weight = np.array([term_weight(total, d) if d else 0 for d in df.tolist()], np.int64)
    weights = [weight[t] * n for t, n in zip(q.terms, q.times)]
    most = max(64, min(SHARD_DOCS, (1 << 24) // max(map(len, q.terms))))
    ids, terms = q.ids, q.terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in terms]
        for doc_id, n, offsets, term, tf in _shards(batches, most):
            if not len(term):
                continue
            order = np.argsort(doc_id, kind="stable")
            local = np.empty(len(order), np.int32)
            local[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.diff(offsets)
            tf = tf.astype(np.int64)
            m = np.repeat(100 - 25 + (25 * n * total) // length, sizes)
            tree = WaveletTree(term, np.repeat(local, sizes), 1000000000 * tf // (1000 * tf + 12 * m), len(order))
            own = doc_id[order]
            for i, (t, w) in enumerate(zip(terms, weights)):
                score, doc = best[i]
                s, d = tree.best(t, w, k, max(1, int(score[-1])) if len(score) == k else 1)
                if len(s):
                    score, doc = np.concatenate([score, s]), np.concatenate([doc, own[d]])
                    top = np.lexsort((doc, -score))[:k]
                    best[i] = score[top], doc[top]
        counts = [len(s) for s, _ in best]
        if sum(counts):
            doc = np.concatenate([d for _, d in best])
            item = pa.array(ids, item_type).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
            query = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), counts))
            yield pa.RecordBatch.from_arrays([query, item, pa.array(doc, mask=doc == _NO_ID), pa.array(np.concatenate([s for s, _ in best]))], ["query", "item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import from_arrow_type

    found = matched.where("n > 0").mapInArrow(search, f"query int, item_id {from_arrow_type(item_type).simpleString()}, doc_id long, score long")
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its k best documents (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = items.schema["item_id"].dataType
    found = [search_slice(written(matched_terms(docs, q.vocabulary)), q, k, to_arrow_type(item_type)) for q in query_slices(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    out = found[0] if len(found) == 1 else written(found[0])
    for x in found[1:]:
        out = out.unionByName(written(x))
    return out
