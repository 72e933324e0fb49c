"""Near duplicates: MinHash LSH forest over word shingles, links confirmed on full sets.

1. A document is its set of word shingles.  Documents with the same set (128-bit
   key) become one node, so groups of copies cost one entry.
2. Forest: each of ``TREES`` trees orders the nodes by a signature of ``DEPTH``
   min-hashes.  Neighbours in such an order are those with the longest common prefix;
   a region is a run of nodes whose common prefix is long enough.  That depth adapts: a
   run of over REGION nodes at depth 3 is cut by the next hash, down to DEPTH.  Within a
   region in its order, nodes are compared by 2-bit min-hash sketches: each with its
   nearest neighbours first, then all that no chain of those has reached with all others.
   A pair at the threshold of 0.8 shares a depth-3 region of one of 20 trees with
   probability 1 - 6e-7.
3. Connected candidates form clusters, within which exact Jaccard values of full shingle
   sets confirm links.
4. Components of the confirmed links give each node its class.

Regions that are large at full depth and large clusters are dealt over blocks of bounded
size and never capped: blocks are linked within, then one representative of each chain of a
block meets the others, and what is still apart from its region's largest chain meets
every block.  So a group of near copies costs work in proportion to its size, and every
pair is either compared or within one chain.

Texts without words have no set: each is a class of its own.  Rows that repeat an id
count like others.  Null ids link like others but name a class only if it has no other id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import arrow_rows, written
from .text_arrays import blocks, mix64, shingle_sets, word_hashes

TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
HASHES = 128  #: the forest's labels are the first TREES * DEPTH
REGION = 2048
BLOCK_WORDS = 1 << 19  #: shingles in a block of full sets, which has REGION nodes at most
FEW_ROWS = 1 << 21  #: so many keys (some 40 bytes each) are sent to every task to pick texts or entries by; more are joined by a shuffle
NEAR = 8  #: neighbours in a region's order that a node is compared with first
_XOR = mix64(np.arange(HASHES), 3).astype(np.uint32)
_MUL = mix64(np.arange(HASHES), 4).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """rows x HASHES min-hashes; empty sets get zeros."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    x = (x >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    got = np.empty((HASHES, len(full)), np.uint32)
    buffer = np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _XOR[k], out=buffer)
        np.multiply(buffer, _MUL[k], out=buffer)
        np.bitwise_xor(buffer, buffer >> np.uint32(15), out=buffer)
        np.multiply(buffer, np.uint32(0x2C1B3C6D), out=buffer)
        got[k] = np.minimum.reduceat(buffer, first)
    out[full] = got.T
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """rows x 4 uint64: two bits of each min-hash, as two bit planes of two words."""
    mixed = sig ^ (sig >> np.uint32(16))
    planes = [np.packbits((mixed >> np.uint32(b)) & np.uint32(1), axis=1) for b in (8, 13)]
    return np.ascontiguousarray(np.concatenate(planes, 1)).view(np.uint64)


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes, whatever its order."""
    return np.array([mix64(s, 11).sum(dtype=np.uint64), mix64(s, 12).sum(dtype=np.uint64)]).tobytes()


def _sketch_floor(threshold: float) -> int:
    """Equal 2-bit hashes (of HASHES) that a pair at the threshold has but for 1 in 10**6."""
    p = threshold + (1 - threshold) / 4
    return int(HASHES * p - 4.9 * (HASHES * p * (1 - p)) ** 0.5)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def stars(self, keys: np.ndarray) -> np.ndarray:
        """Index pairs (node, first node by key) of each set: sets of other regions that overlap it
        mostly have the same first node, so that equal links meet."""
        sets: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            if (r := self.find(i)) != i:
                sets.setdefault(r, [r]).append(i)
        out = []
        for members in sets.values():
            first = min(members, key=lambda i: keys[i].tobytes())
            out += [(i, first) for i in members if i != first]
        return np.array(out, int).reshape(-1, 2)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, node (binary key of the set; null if empty), labels
    (DEPTH min-hashes for each tree, 4 bytes each), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in blocks(batch.column("text")):
                rows = len(offsets) - 1
                sets = shingle_sets(*word_hashes(data, offsets), words)
                sig = signatures(sets)
                sketch = sketches(sig)
                labels = np.ascontiguousarray(sig[:, : TREES * DEPTH])
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, rows),
                        batch.column("row").slice(lo, rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() if k else None for x, k in zip(labels, some)], pa.binary()),
                        pa.array([x.tobytes() if k else None for x, k in zip(sketch, some)], pa.binary()),
                    ],
                    ["doc_id", "row", "n_shingles", "node", "labels", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row_key().alias("row"), "text").mapInArrow(make, f"doc_id {kind}, row long, n_shingles long, node binary, labels binary, sketch binary")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _regions(nodes: DataFrame, region: int) -> tuple[DataFrame, DataFrame | None]:
    """The regions of up to ``region`` nodes, and the larger ones of full depth if there are any:
    (key, node, label, sketch) and the number of blocks."""
    label = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("labels", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))
    entry = nodes.select("node", "sketch", F.posexplode(label).alias("tree", "label"))
    at = lambda depth: F.xxhash64("tree", F.substring("label", 1, 4 * depth)).alias("key")
    entry = entry.select("node", "sketch", "tree", "label", at(LEAST_DEPTH))
    done = None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        # a run of one node has no pair: only runs of two and more go on
        size = written(entry.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1))
        fit = size.where(F.col("size") <= region)
        fit = F.broadcast(fit) if size.count() <= FEW_ROWS else fit  # most entries are alone in their run: they are left where they are
        whole = entry.join(fit, "key").select("key", "node", "label", "sketch", F.lit(1).alias("blocks"))
        done = whole if done is None else done.unionByName(whole)
        heavy = written(size.where(F.col("size") > region))  # few keys, in a small table of their own
        if heavy.isEmpty():
            return done, None
        large = written(entry.join(heavy, "key"))
        entry = large.select("node", "sketch", "tree", "label", at(depth + 1))
    return done, large.select("key", "node", "label", "sketch", F.ceil(F.col("size") / region).cast("int").alias("blocks"))


def _packed(entries: DataFrame, fields: list[str]) -> DataFrame:
    """The entries of each key in their blocks: key, block, blocks, left (array of structs in order of the fields)."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return entries.withColumn("block", block).groupBy("key", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("left"))


def _alone(packed: DataFrame) -> DataFrame:
    return packed.where(F.size("left") > 1).select("left", F.lit(None).cast(packed.schema["left"].dataType).alias("right"))


def _crossed(one: DataFrame, other: DataFrame, met: Column) -> DataFrame:
    """Blocks of ``one`` beside blocks ("to") of ``other`` of their key, where ``met`` holds."""
    counts = lambda x, name: x.groupBy("key").agg(F.max("blocks").alias(name))
    both = counts(one, "ones").join(counts(other, "others"), "key")
    left = one.join(both, "key").select("key", "block", "left", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("to")).where(met)
    right = other.join(both, "key").select("key", F.col("block").alias("to"), F.col("left").alias("right"), F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("block")).where(met)
    return left.join(right, ["key", "block", "to"]).select("left", "right")


def _linked(entries: DataFrame, fields: list[str], link: Callable, weight: str, room: int) -> DataFrame:
    """(a, b) links that connect, within each key, all that ``link`` connects pair by pair, for keys of several blocks.

    entries: a written table of key, node, blocks and the fields; a block holds up to ``room`` of ``weight``.
    """
    run = lambda packed: written(packed.mapInArrow(link, "a binary, b binary"))
    found = run(_alone(_packed(entries, fields)))
    placed, apart = _chains(entries, found)
    if apart.isEmpty():
        return found
    # one node of each chain of each block stands for it: a chain of many blocks is one already
    first = placed.join(apart, "key", "left_semi").groupBy("key", "root").agg(F.min("node").alias("node"))
    stand = written(placed.join(first.drop("root"), ["key", "node"]))
    size = stand.groupBy("key").agg(F.greatest(F.ceil(F.sum(weight) / room), F.ceil(F.count("*") / REGION)).cast("int").alias("blocks"))
    stand = _packed(stand.drop("blocks").join(size, "key"), fields)
    found = written(found.unionByName(run(_alone(stand))).unionByName(run(_crossed(stand, stand, F.col("block") < F.col("to")))))
    placed, apart = _chains(entries, found)
    if apart.isEmpty():
        return found
    # what no representative has joined to the key's largest chain meets every node
    ranked = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = ranked.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    rest = placed.join(main, "key").where(F.col("root") != F.col("main"))
    size = rest.groupBy("key").agg(F.greatest(F.ceil(F.sum(weight) / room), F.ceil(F.count("*") / REGION)).cast("int").alias("blocks"))
    rest = _packed(rest.drop("blocks", "main").join(size, "key"), fields)
    return found.unionByName(run(_crossed(rest, _packed(entries.join(apart, "key", "left_semi"), fields), F.lit(True))))


def _chains(entries: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries with root (of the node's chain over ``found``), and the keys that have several chains."""
    chains = connected_components(thinned(found))
    placed = written(entries.join(chains, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return placed, written(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("key"))


def _fixed(column: pa.Array, words: int) -> np.ndarray:
    """A binary column whose values all have 8 * words bytes, as rows of uint64."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(-1, words)


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    def column(parts):
        keys = np.ascontiguousarray(np.concatenate([np.zeros((0, 2), np.uint64), *parts]))
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 16).astype(np.int32)), pa.py_buffer(keys)])

    return pa.RecordBatch.from_arrays([column(a), column(b)], ["a", "b"])


def _equal_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 2-bit hashes sketches (..., 4 words: two bit planes of two words) share."""
    differ = a ^ b
    return HASHES - np.bitwise_count(differ[..., :2] | differ[..., 2:]).sum(-1)


def _sketch_chains(sketch: np.ndarray, floor: int) -> _Union:
    """Joins nodes, in their region's order, whose sketches allow a link: all that comparing every pair would join."""
    n = len(sketch)
    u = _Union(n)
    for step in range(1, min(NEAR, n - 1) + 1):
        for i in np.flatnonzero(_equal_hashes(sketch[:-step], sketch[step:]) >= floor).tolist():
            u.join(i, i + step)
    root = np.array([u.find(i) for i in range(n)])
    values, sizes = np.unique(root, return_counts=True)
    for i in np.flatnonzero(root != values[sizes.argmax()]).tolist():  # the largest chain is one already
        for j in np.flatnonzero(_equal_hashes(sketch[i], sketch) >= floor).tolist():
            u.join(i, j)
    return u


def candidate_links(nodes: DataFrame, threshold: float, small: int = 8, region: int = REGION) -> DataFrame:
    """(a, b): pairs of the small regions, and for the others stars over the chains, whose sketches allow a link."""
    floor = _sketch_floor(threshold)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            first = left.offsets.to_numpy()
            size = np.diff(first)
            rows = left.values
            node, sketch = _fixed(rows.field("node"), 2), _fixed(rows.field("sketch"), 4)
            alone = np.asarray(right.is_null())
            a, b = [], []
            for n in range(2, small + 1):
                at = first[:-1][alone & (size == n)]
                for i in range(n):
                    for j in range(i + 1, n):
                        hit = _equal_hashes(sketch[at + i], sketch[at + j]) >= floor
                        a.append(node[at[hit] + i])
                        b.append(node[at[hit] + j])
            for r in np.flatnonzero(~alone | (size > small)).tolist():
                keys, own = node[first[r] : first[r + 1]], sketch[first[r] : first[r + 1]]
                if alone[r]:
                    u = _sketch_chains(own, floor)
                else:
                    more = right[r].values
                    shift, other = len(keys), _fixed(more.field("sketch"), 4)
                    keys = np.concatenate([keys, _fixed(more.field("node"), 2)])
                    u = _Union(len(keys))
                    for i in range(shift):
                        for h in np.flatnonzero(_equal_hashes(own[i], other) >= floor).tolist():
                            u.join(i, h + shift)
                ends = u.stars(keys)
                a.append(keys[ends[:, 0]])
                b.append(keys[ends[:, 1]])
            yield _links(a, b)

    fields = ["label", "node", "sketch"]
    whole, large = _regions(nodes, region)
    with arrow_rows(nodes.sparkSession, 1024):
        found = written(_alone(_packed(whole, fields)).mapInArrow(match, "a binary, b binary").distinct())
        if large is not None:
            found = found.unionByName(_linked(large.withColumn("one", F.lit(1)), fields, match, "one", region))
    return found


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of two lists of sorted distinct hash arrays, in columns of bounded width."""
    both = [*a, *b]
    _, token = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    split = sum(len(x) for x in a)
    shared = np.zeros(token.max() + 1, np.int8)
    shared[token[:split]] |= 1
    shared[token[split:]] |= 2
    inside = shared[token] == 3
    from_a = (np.arange(len(token)) < split)[inside]
    token, row = (np.cumsum(shared == 3) - 1)[token[inside]], row[inside]
    order = np.argsort(token, kind="stable")
    token, row, from_a = token[order], row[order], from_a[order]
    out = np.zeros((len(a), len(b)), np.float32)
    count = int(token[-1]) + 1 if len(token) else 0
    width = min(count, max(256, (1 << 21) // len(both)))
    for lo in range(0, count, max(width, 1)):
        part = slice(*np.searchsorted(token, [lo, lo + width]))
        t, r, f = token[part] - lo, row[part], from_a[part]
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        x[r[f], t[f]] = 1
        y[r[~f] - len(a), t[~f]] = 1
        out += x @ y.T
    return out


def _set_chains(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> _Union:
    shift = 0 if other is None else len(sets)
    other = sets if other is None else other
    common = _overlaps(sets, other).astype(np.int64)
    total = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in other])[None, :]
    u = _Union(shift + len(other))
    for j, h in zip(*(x.tolist() for x in np.nonzero(100 * common >= percent * (total - common)))):
        u.join(j, h + shift)
    return u


def confirmed_links(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links with 100 * |intersection| >= percent * |union|: stars that connect what such links connect.

    docs (doc_id, text); clusters (row, node, key, n, blocks), written: row names the node's representative.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(*word_hashes(data, offsets), words)
                own = batch.slice(lo, len(sets))
                mine = [set_key(s) == k for s, k in zip(sets, own.column("node").to_pylist())]  # another row's hash may be the same
                got = [pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("node", "key", "n", "blocks")), *got], ["node", "key", "n", "blocks", "set"]).filter(pa.array(mine))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = lambda x: (_fixed(x.values.field("node"), 2), [np.frombuffer(s.as_buffer(), np.uint64) for s in x.values.field("set")])
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                keys, sets = side(left[i])
                other = None
                if right[i].is_valid:
                    more, other = side(right[i])
                    keys = np.concatenate([keys, more])
                ends = _set_chains(sets, other, percent).stars(keys)
                yield _links([keys[ends[:, 0]]], [keys[ends[:, 1]]])

    def sets_of(some: DataFrame) -> DataFrame:
        rows = docs.select(_row_key().alias("row"), "text")
        if some.count() <= FEW_ROWS:  # most texts have no candidate: they are left where they are
            rows = rows.join(F.broadcast(some.select("row").distinct()), "row", "left_semi")
        rows = rows.join(some, "row").dropDuplicates(["row", "node"])  # repeated rows; the join's partitions serve
        return rows.mapInArrow(to_sets, "node binary, key binary, n long, blocks int, set binary")

    fields = ["node", "set"]
    with arrow_rows(docs.sparkSession, 64):  # a row can be two whole blocks
        found = written(_alone(_packed(sets_of(clusters.where(F.col("blocks") == 1)), fields)).mapInArrow(match, "a binary, b binary"))
        large = clusters.where(F.col("blocks") > 1)
        if not large.isEmpty():
            found = found.unionByName(_linked(written(sets_of(large)), fields, match, "n", BLOCK_WORDS))
    return found


def thinned(links: DataFrame) -> DataFrame:
    """As few links with the same components: each node keeps its smallest neighbour below it, to which its
    other ones are linked instead.  A node has at most a few neighbours below it in each region or block."""
    down = links.where(F.col("a") != F.col("b")).groupBy(F.greatest("a", "b").alias("x")).agg(F.collect_set(F.least("a", "b")).alias("below"))
    down = down.select("x", "below", F.array_min("below").alias("least"))
    moved = down.select(F.explode("below").alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b"))
    return down.select(F.col("x").alias("a"), F.col("least").alias("b")).unionByName(moved).distinct()


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row of docs."""
    made = written(document_sets(docs, words))
    nodes = written(made.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")))
    candidates = connected_components(thinned(candidate_links(nodes, percent / 100, region=REGION)))
    clusters = candidates.select("node", F.col("root").alias("key")).join(nodes.select("node", "row", "n"), "node")
    size = clusters.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_WORDS), F.ceil(F.count("*") / REGION)).cast("int").alias("blocks"))
    clusters = written(clusters.join(size, "key").select("row", "node", "key", "n", "blocks"))
    links = connected_components(thinned(confirmed_links(docs, clusters, words, percent)))
    rooted = written(nodes.select("node", "first").join(links, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component")))  # a join above the aggregate itself can't be split where a root is hot
    classes = rooted.join(smallest, "root").select("node", "component")
    out = made.select("doc_id", "row", "n_shingles", "node").join(classes, "node", "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Documents link where 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles.
    """
    return _classes(docs, words, percent).drop("row")


def keep_first_of_class(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first document of each class; repeated rows of one id and text stay once.
    Of an id with several texts each text goes or stays by its own class.

    Rows without an id all stay: nothing tells them apart from the first of their class.
    """
    kept = _classes(docs, words, percent).where("kept").select(F.col("row").alias("_row_key")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_row_key", _row_key())
    named = named.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
