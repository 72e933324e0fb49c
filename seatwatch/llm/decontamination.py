"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared lower-cased with runs of whitespace as one space.  An item of
m characters may differ from a passage by e = floor(rate * m) edits (at most
(m - q) // q, where the lemma still filters).  A passage within e edits shares at
least m + 1 - q * (e + 1) of the item's q-grams, on diagonals that differ by at
most e.  Shared q-grams are counted in overlapping diagonal bands, each 2 * (e + 1)
wide and half of it shared with the next, so that one band holds them all; bands
that reach the bound are verified by banded alignment, many of them at a time.

Items shorter than q characters, for which the lemma does not filter, match exactly where
they are words of their own: no letter or digit of theirs touches one of the text.  Items of
one or two letters are allowed, and match accordingly often.
Null and empty texts or items match nothing.  Repeated items are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written
from .text_arrays import char_codes

Q = 10
RATE = 0.08
#: Characters of items in one index, which takes some 30 bytes for each (64 MB); a larger benchmark is searched
#: slice by slice, with a scan of the documents for each.  A single longer item is a slice of its own.
INDEX_CHARS = 1 << 21
#: Postings and alignment cells that are held at a time.
POSTINGS = 1 << 20
CELLS = 1 << 18
TABLE_BITS = 22
_STEP = 0x9E3779B97F4A7C15


@dataclass
class Index:
    ids: list  #: of the items
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray  #: shared q-grams that a band must hold
    grams: np.ndarray  #: sorted distinct q-gram hashes
    first: np.ndarray  #: of each gram's postings, one more entry than grams
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  #: by length: sorted hashes of the items below q, and the items


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """The polynomial hash (mod 2**64) of the q-gram at each place, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, out, size = codes.astype(np.uint64), 1, None, 0
    while True:
        if q & span:
            out, size = (power[: len(codes) - span + 1].copy(), span) if out is None else (out[: len(codes) - size - span + 1] + np.uint64(pow(_STEP, size, 2**64)) * power[size : len(codes) - span + 1], size + span)
        if size == q:
            return out[:n] ^ (out[:n] >> np.uint64(29))
        power = power[: len(power) - span] + np.uint64(pow(_STEP, span, 2**64)) * power[span:]
        span *= 2


def build_index(items: list[tuple], q: int = Q, rate: float = RATE) -> Index:
    """items: (id, text)."""
    ids, codes = [], []
    for i, text in items:
        c = char_codes([text])[0][1:-1]
        if len(c):
            ids.append(i)
            codes.append(c)
    m = np.array([len(c) for c in codes], int)
    edits = np.maximum(np.minimum((rate * m).astype(int), (m - q) // q), 0)
    hashes = [gram_hashes(c, q) for c in codes]
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(h) for h in hashes])
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h in hashes)])
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    short = {}
    for n in sorted({int(x) for x in m if x < q}):
        own = np.flatnonzero(m == n)
        h = np.concatenate([gram_hashes(codes[i], n) for i in own])
        short[n] = np.sort(h), own[np.argsort(h, kind="stable")]
    need = np.where(m < q, np.iinfo(np.int64).max, m + 1 - q * (edits + 1))
    return Index(ids, codes, edits, need, grams, np.append(first, len(every)), item[order], place[order], short)


_FAR = 1 << 24
_BEFORE, _BEYOND = 0xFFFFFFFE, 0xFFFFFFFF


def align_all(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[int, int, int] | None]:
    """For each (item, window, most): the best (edits, start, end) of item in the window, of at most ``most``
    edits: fewest edits, then the earliest end; None where there is none.

    All pairs advance together, an item character at a time, over the diagonals that ``most`` edits can
    reach; a pair ends with its item, or once every diagonal costs too much.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(pairs)
    wide = np.array([len(t) - len(c) + 2 * e + 1 for c, t, e in pairs], int)
    order = [i for i in np.argsort(wide, kind="stable").tolist() if wide[i] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * wide[order[hi]] <= CELLS:
            hi += 1
        _align_batch(pairs, order[lo:hi], int(wide[order[hi - 1]]), out)
        lo = hi
    return out


def _align_batch(pairs, chosen: list[int], width: int, out: list) -> None:
    m = np.array([len(pairs[i][0]) for i in chosen])
    most = np.array([pairs[i][2] for i in chosen], np.int32)
    items = np.zeros((len(chosen), int(m.max())), np.uint32)
    texts = np.full((len(chosen), int(m.max()) + width), _BEYOND, np.uint32)  # at x: the window's place x - most
    ends = np.array([len(pairs[i][1]) for i in chosen])
    for r, i in enumerate(chosen):
        c, t, e = pairs[i]
        items[r, : len(c)] = c
        texts[r, :e] = _BEFORE
        texts[r, e : e + len(t)] = t[: texts.shape[1] - e]
    at = np.arange(width, dtype=np.int32)
    origin = at[None, :] - most[:, None]
    cost = np.where((origin < 0) | (origin > ends[:, None]), _FAR, 0).astype(np.int32)
    who = np.array(chosen)
    for i in range(int(m.max())):
        chars = texts[:, i : i + width]
        swap = cost + (chars != items[:, i : i + 1])
        new, came = np.full_like(cost, _FAR), origin.copy()
        new[:, :-1] = cost[:, 1:] + 1
        came[:, :-1] = origin[:, 1:]
        better = swap < new
        np.copyto(new, swap, where=better)
        np.copyto(came, origin, where=better)
        new[chars == _BEYOND] = _FAR
        level = new - at
        least = np.minimum.accumulate(level, axis=1)  # insertions run along the row
        source = np.maximum.accumulate(np.where(level == least, at, 0), axis=1)
        cost, origin = least + at, np.take_along_axis(came, source, 1)
        cost[chars == _BEYOND] = _FAR
        low = cost.min(1)
        for r in np.flatnonzero((m == i + 1) & (low <= most)).tolist():
            k = int(np.argmin(cost[r]))
            out[who[r]] = (int(cost[r, k]), int(origin[r, k]), i + 1 + k - int(most[r]))
        stay = (m > i + 1) & (low <= most)
        if not stay.all():
            if not stay.any():
                return
            cost, origin, texts, items, m, most, who = (x[stay] for x in (cost, origin, texts, items, m, most, who))


def lookup_table(index: Index) -> np.ndarray:
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(index.grams)] = True
    return table


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(_STEP)) >> np.uint64(64 - TABLE_BITS)


_WORD = np.array([chr(i).isalnum() for i in range(1 << 16)])


def _in_word(codes: np.ndarray) -> np.ndarray:
    out = _WORD[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF).tolist():
        out[i] = chr(codes[i]).isalnum()
    return out


def _short_passages(codes: np.ndarray, offsets: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (0, start, end) of the first place where a short item is a word of its own."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, (hashes, items) in index.short.items():
        own = gram_hashes(codes, n)
        lo = np.searchsorted(hashes, own, "left")
        at = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == own)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = (at > offsets[row]) & (at + n < offsets[row + 1])  # a space stands at either end of a row
        at, row = at[inside], row[inside]
        free = ~((_in_word(codes[at - 1]) & _in_word(codes[at])) | (_in_word(codes[at + n]) & _in_word(codes[at + n - 1])))
        at, row = at[free], row[free]
        _, one = np.unique(np.stack([row, lo[at]]), axis=1, return_index=True)
        for a, r in zip(at[one].tolist(), row[one].tolist()):
            k = int(lo[a])
            while k < len(hashes) and hashes[k] == own[a]:
                if np.array_equal(index.codes[items[k]], codes[a : a + n]):
                    found[r, int(items[k])] = (0, a - int(offsets[r]), a - int(offsets[r]) + n)
                k += 1
    return found


def _full_bands(at: np.ndarray, gram: np.ndarray, offsets: np.ndarray, index: Index, q: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, band) of the bands that reach their item's bound, sorted; pair = row * items + item.  Postings are
    counted in slices of bounded size."""
    count = index.first[gram + 1] - index.first[gram]
    ends = np.cumsum(count)
    most = int(2 * (offsets[-1] + longest) + 4)  # of a band's number
    keys, sums, lo = [], [], 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, "right")))
        some = count[lo:hi]
        post = np.repeat(index.first[gram[lo:hi]] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
        item, place, where = index.item[post].astype(np.int64), index.place[post], np.repeat(at[lo:hi], some)
        row = np.searchsorted(offsets, where, "right") - 1
        inside = where + q <= offsets[row + 1]
        item, place, where, row = item[inside], place[inside], where[inside], row[inside]
        width = index.edits[item] + 1
        band = (where - offsets[row] - place + longest + 2 * width) // width
        key = (row * len(index.ids) + item) * most + band
        key, seen = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        keys.append(key)
        sums.append(seen)
        lo = hi
    if len(keys) > 1:
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        keys, sums = [every], [np.bincount(back, np.concatenate(sums)).astype(np.int64)]
    pair, band = keys[0] // most, keys[0] % most
    good = sums[0] >= index.need[pair % len(index.ids)]
    return pair[good], band[good]


def find_passages(texts: list[str], index: Index, table: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the best passage for each row and item that share one."""
    if not index.ids:
        return []
    codes, offsets = char_codes(texts)
    best = _short_passages(codes, offsets, index)
    hashes = gram_hashes(codes, q)
    at = np.flatnonzero(table[_slot(hashes)])
    if len(at) and len(index.grams):
        gram = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
        real = index.grams[gram] == hashes[at]
        at, gram = at[real], gram[real]
        # a band needs at least the smallest bound of hits within the widest item's reach
        longest = max(len(c) for c in index.codes)
        reach, least = int(longest + 2 * (index.edits.max() + 1)), int(index.need.min())
        near = np.searchsorted(at, at + reach, "right") - np.searchsorted(at, at - reach, "left") >= max(least, 1)
        at, gram = at[near], gram[near]
    if len(at) and len(index.grams):
        pair, band = _full_bands(at, gram, offsets, index, q, longest)
        # bands of a pair that touch are one window
        begins = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] > band[:-1] + 1))) if len(pair) else []
        work, place = [], []
        for a, b in zip(begins, [*begins[1:], len(pair)]):
            r, i = divmod(int(pair[a]), len(index.ids))
            c, e = index.codes[i], int(index.edits[i])
            w = e + 1
            lo = max(0, int(band[a]) * w - longest - 2 * w - e)
            hi = (int(band[b - 1]) + 2) * w - longest - 2 * w + len(c) + e
            window = codes[offsets[r] + lo : min(offsets[r] + hi, offsets[r + 1])]
            exact = _first_exact(window, c)
            if exact >= 0:
                best[r, i] = min(best.get((r, i), (1, 0, 0)), (0, exact + lo, exact + lo + len(c)))
            elif e:
                work.append((c, window, e))
                place.append((r, i, lo))
        for (r, i, lo), found in zip(place, align_all(work)):
            if found:
                found = (found[0], found[1] + lo, found[2] + lo)
                best[r, i] = min(best.get((r, i), found), found)
    return [(r, i, s, t, e) for (r, i), (e, s, t) in sorted(best.items())]


def _first_exact(window: np.ndarray, item: np.ndarray) -> int:
    data, part, at = window.tobytes(), item.tobytes(), -1
    while (at := data.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def benchmark_slices(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes over the items, each of about INDEX_CHARS characters at most, and whether it is the only one: the size
    of the whole is summed first, and what is larger comes in slices by hash of the item.  A slice's index goes
    when the next one is asked for, if nothing holds it by then."""
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // INDEX_CHARS)
    for k in range(slices):
        own = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield build_index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]), slices == 1


def _text_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    texts = []
    lo = held = 0
    for i, t in enumerate(column.to_pylist()):
        t = t or ""
        if texts and held + len(t) > most:
            yield lo, texts
            lo, texts, held = i, [], 0
        texts.append(t)
        held += len(t)
    if texts:
        yield lo, texts


def contaminated_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (of the passage, in characters of the normalised text), edits:
    one row for each document and item it contains within the item's edit budget."""
    doc_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, start long, end long, edits int"
    found = []
    for index, only in benchmark_slices(benchmark):
        kind = pa.array(index.ids).type if index.ids else pa.int64()

        def search(batches: Iterator[pa.RecordBatch], index=index, kind=kind) -> Iterator[pa.RecordBatch]:
            table = lookup_table(index)
            for batch in batches:
                for lo, texts in _text_slices(batch.column("text")):
                    got = find_passages(texts, index, table)
                    if got:
                        rows, items, start, end, edits = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([lo + r for r in rows])), pa.array([index.ids[i] for i in items], kind), pa.array([s - 1 for s in start], pa.int64()), pa.array([e - 1 for e in end], pa.int64()), pa.array(edits, pa.int32())],
                            ["doc_id", "item_id", "start", "end", "edits"],
                        )

        hits = docs.select("doc_id", "text").mapInArrow(search, schema)
        found.append(hits if only else written(hits))
        del index, search, hits  # the next slice takes its place
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("b")).select("doc_id", "item_id", "b.start", "b.end", "b.edits")


def has_passage(text: Column, index: Index) -> Column:
    """Whether a text contains an item of the index within its edit budget."""

    @F.arrow_udf("boolean")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = lookup_table(index)
        for batch in batches:
            out = np.zeros(len(batch), bool)
            for lo, texts in _text_slices(batch):
                for r, *_ in find_passages(texts, index, table):
                    out[lo + r] = True
            yield pa.array(out)

    return search(text)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contain a benchmark item, columns unchanged.  Of a benchmark in slices what
    each slice leaves is written, and read for the next."""
    for index, only in benchmark_slices(benchmark):
        left = docs.where(~has_passage(F.col("text"), index))
        docs = left if only else written(left)
        del index, left
    return docs
