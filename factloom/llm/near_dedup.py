"""MinHash near-dedup with an LSH forest.

Documents with equal shingle sets, named by 128-bit digests, are one node.  Every tree of the forest sorts
all nodes by its own order of minhash values, so the neighbours of a node are those with the longest
common prefix.  Nodes that share ``REGION`` values form a region, and the depth at which they are looked
at adapts to it: where a region is sparse, a neighbour counts from ``SHALLOW`` values on if the rest of
the order agrees too; where it is crowded, it is followed as deep as it stays crowded.  A node's candidates
are its neighbours and the pivot of its region, the node at the end of the heaviest path; in a crowd the
pivot of the first deeper region that is none, and these pivots meet the whole region's.  So candidates
grow with the nodes and not with the pairs of a region.  Candidates are confirmed on full shingle sets in
rounds that skip what is connected already.  Last, whole regions are compared block by block, by signatures
and then by shingles, so that a link between two nodes of a crowd is found also where no tree made them
candidates.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, materialize, release, sliced

#: Words of a shingle, as the contract of the registered query sets it; the pipeline takes the same.
SIZE = 2
THRESHOLD = 80  # per cent
HASHES = 128
TREES = 32
#: Values of a tree's order: the least common prefix of sparse neighbours, that of a region, and all.
SHALLOW, REGION, DEPTH = 3, 5, 36
#: Bytes of a path: a hash of the first ``SHALLOW`` values, and one byte for each of the others.
PATH_BYTES = 8 + DEPTH - SHALLOW
#: Values of a path that sparse neighbours have in common beyond the first, at least (six deviations below 0.8).
SPARSE_LEAST = 13
#: A region of more nodes than this is crowded.
CROWD = 64
#: Candidates are looked up in full unless their signatures agree on less than this share (five deviations below 0.8).
SIGNATURE_LEAST = 0.62
BLOCK = 4096
#: Nodes on either side of a block in which regions are compared by signatures, and crowds by shingles.
REGION_BLOCK = 1024
CROWD_BLOCK = 1024
CACHE_WORDS = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def _orders() -> np.ndarray:
    """For each tree the minhash functions that it compares, in order."""
    rng = np.random.default_rng(7)
    need = TREES * REGION
    heads = np.concatenate([rng.permutation(HASHES) for _ in range(-(-need // HASHES))])[:need].reshape(TREES, REGION)
    tails = [rng.permutation(np.setdiff1d(np.arange(HASHES), head))[: DEPTH - REGION] for head in heads]
    return np.concatenate([heads, np.stack(tails)], axis=1)


ORDERS = _orders()


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def shingles(words: list[bytes], size: int) -> set:
    """The set itself: distinct runs of ``size`` words, the whole sequence if it is shorter."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _M1 + own[i : i + count]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _M2
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` 32-bit minima."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        low = np.minimum(low, ((_A[:, None] * part + _B[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def set_digest(hashes: np.ndarray) -> int:
    """128 bits that name a shingle set."""
    return xxhash.xxh3_128_intdigest(hashes.tobytes())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def features(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, text_hash, node, check, n_shingles, sketch`` of every row; ``node, check`` are the halves of the set's digest, null for empty ones."""
    half = (1 << 64) - 1

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                own = shingle_hashes(blank_words(text or b""), size)
                if len(own):
                    name = set_digest(own)
                    rows.append((_signed(name & half), _signed(name >> 64), len(own), signature(own).tobytes()))
                else:
                    rows.append((None, None, 0, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["id", "text_hash", "node", "check", "n_shingles", "sketch"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "id bigint, text_hash bigint, node bigint, check bigint, n_shingles bigint, sketch binary")


def forest(nodes: DataFrame) -> DataFrame:
    """``tree, path, node``: per tree a node's place in its order, as bytes that sort like the values they come from."""

    def run(batches):
        for batch in sliced(batches, 1024):
            own = batch.column(0).to_numpy()
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(own), HASHES)
            picked = sketches[:, ORDERS]
            key = np.zeros(picked.shape[:2], np.uint64)
            for depth in range(SHALLOW):
                key = (key ^ (key >> np.uint64(31))) * _M1 + picked[:, :, depth].astype(np.uint64) * _M2
            paths = np.empty((len(own), TREES, PATH_BYTES), np.uint8)
            paths[:, :, :8] = (key ^ (key >> np.uint64(29))).astype(">u8").view(np.uint8).reshape(len(own), TREES, 8)
            paths[:, :, 8:] = picked[:, :, SHALLOW:] & 255  # the low bits, as minima have small high ones
            rows = len(own) * TREES
            offsets = np.arange(0, (rows + 1) * PATH_BYTES, PATH_BYTES, dtype=np.int32)
            path = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(paths.tobytes())])
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(own)))
            yield pa.RecordBatch.from_arrays([trees, path, pa.array(np.repeat(own, TREES))], names=["tree", "path", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "tree int, path binary, node bigint")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _heaviest(parent: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each parent its largest child, the first of equal ones."""
    order = np.lexsort((np.arange(len(size)), -size, parent))
    return order[_starts(parent[order])]


def region_candidates(tree: np.ndarray, paths: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of sorted rows, each row's region, the regions' pivots and weights, and the rows that stand for their region.

    A pivot is the row at the end of the path that takes the largest branch at every depth, followed while
    it has more than one row.
    """
    n = len(node)
    same = paths[1:] == paths[:-1]
    common = np.where(same.all(axis=1), PATH_BYTES, same.argmin(axis=1)) * (tree[1:] == tree[:-1])  # bytes of the common prefix
    at = lambda depth: 8 + depth - SHALLOW  # noqa: E731  # bytes of the first values
    starts = [np.r_[True, common < at(depth)] if n else np.zeros(0, bool) for depth in range(REGION, DEPTH + 1)]
    firsts = [np.flatnonzero(s) for s in starts]
    sizes = [np.diff(np.append(f, n)) for f in firsts]
    region = np.cumsum(starts[0]) - 1
    # From the deepest on: the row that stands for each branch, and the weight of the branch it came from.
    leads, weights = [firsts[-1]], [sizes[-1]]
    for level in range(len(starts) - 1, 0, -1):
        parent = (np.cumsum(starts[level - 1]) - 1)[firsts[level]]
        best = _heaviest(parent, sizes[level])
        alone = sizes[level][best] == 1
        leads.append(np.where(alone, firsts[level - 1], leads[-1][best]))
        weights.append(sizes[level][best])
    leads, weights = leads[::-1], weights[::-1]
    pivot = node[leads[0]]
    left, right = [], []

    def pair(one: np.ndarray, two: np.ndarray) -> None:
        differ = one != two
        left.append(one[differ])
        right.append(two[differ])

    # Neighbours: inside a region, and in sparse places those whose orders agree on after a shorter prefix.
    close = np.flatnonzero(common >= at(REGION))
    sparse = np.flatnonzero((common >= 8) & (common < at(REGION)))
    agree = same[sparse, 8:].sum(axis=1) >= SPARSE_LEAST
    for rows in (close, sparse[agree]):
        pair(node[rows], node[rows + 1])
    crowded = sizes[0][region] > CROWD
    pair(node[~crowded], pivot[region[~crowded]])
    # In a crowd the pivot of the first deeper region that is none; these meet the pivot of the whole.
    open_rows = np.flatnonzero(crowded)
    handed = ~crowded
    for level in range(1, len(starts)):
        if not len(open_rows):
            break
        own = (np.cumsum(starts[level]) - 1)[open_rows]
        settled = (sizes[level][own] <= CROWD) | (level == len(starts) - 1)
        lead = leads[level][own[settled]]
        pair(node[open_rows[settled]], node[lead])
        handed[lead] = True
        open_rows = open_rows[~settled]
    heads = np.flatnonzero(handed & crowded)
    pair(node[heads], pivot[region[heads]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), region, pivot, weights[0], handed


def _region_keys(paths: np.ndarray) -> np.ndarray:
    """One number for the bytes that name a region."""
    first = np.ascontiguousarray(paths[:, :8]).view(">u8").ravel().astype(np.uint64)
    for at in range(8, 8 + REGION - SHALLOW):
        first = (first ^ (first >> np.uint64(31))) * _M1 + paths[:, at]
    return (first ^ (first >> np.uint64(29))).view(np.int64)


def candidates(nodes: DataFrame) -> DataFrame:
    """``a, b, votes`` (a < b): pairs of nodes that some tree makes candidates.

    Partitions are ranges of the sorted order, so a crowded region may span several: rows of the regions at
    a partition's ends are handed on and meet the heaviest pivot of their whole region.
    """
    keys = ["tree", "path", "node"]
    rows = forest(nodes)
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        tree, node = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("tree", "node"))
        paths = np.concatenate([np.frombuffer(b"".join(b.column("path").to_pylist()), np.uint8) for b in parts]).reshape(len(node), PATH_BYTES)
        left, right, region, pivot, weight, handed = region_candidates(tree, paths, node)
        low, high = np.minimum(left, right), np.maximum(left, right)
        if len(low):
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = np.flatnonzero(_starts(low, high))
            votes = np.diff(np.append(new, len(low)))
            yield _candidate_batch(low[new], high[new], votes)
        ends = np.flatnonzero(((region == region[0]) | (region == region[-1])) & handed)
        keys = _region_keys(paths[ends])
        for start in range(0, len(ends), 10_000):
            own = ends[start : start + 10_000]
            yield _candidate_batch(node[own], pivot[region[own]], weight[region[own]], tree[own], keys[start : start + 10_000])

    schema = "a bigint, b bigint, votes bigint, tree int, k0 bigint"
    found = materialize(rows.mapInArrow(run, schema), "candidates")
    ends = found.where("tree IS NOT NULL")
    crowded = ends.groupBy("tree", "k0").agg(F.max_by("b", F.struct("votes", "b")).alias("pivot"), F.count("*").alias("n"))
    crowded = materialize(crowded.where("n > 1").select("tree", "k0", "pivot"), "crowded")
    across = ends.join(crowded, ["tree", "k0"]).where("a <> pivot").select(
        F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b"), F.lit(1).cast("bigint").alias("votes")
    )
    pairs = found.where("tree IS NULL").select("a", "b", "votes").unionByName(across)
    return materialize(pairs.groupBy("a", "b").agg(F.sum("votes").alias("votes")), "pairs")


def _candidate_batch(a, b, votes, tree=None, k0=None) -> pa.RecordBatch:
    n = len(a)
    arrays = [pa.array(a), pa.array(b), pa.array(votes.astype(np.int64))]
    arrays += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())] if tree is None else [pa.array(tree), pa.array(k0)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "votes", "tree", "k0"])


def _hooked(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes in ``edges (a, b)``: trees of two nodes or more, named by their roots.

    Each node points to its smallest neighbour.  Two nodes that point to each other are the only cycles, and
    the smaller is a root; the others jump to what they point to until all point to roots, so the rounds grow
    with the logarithm of a tree's depth.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    back = nearest.select(F.col("a").alias("b"), F.col("b").alias("back"))
    root = (F.col("back") == F.col("a")) & (F.col("a") < F.col("b"))
    labels = materialize(nearest.join(back, "b").select(F.col("a").alias("node"), F.when(root, F.col("a")).otherwise(F.col("b")).alias("label")), "labels")
    while True:
        held = labels._written_path
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = materialize(labels.join(target, "label").select("node", F.col("label").alias("old"), F.col("next").alias("label")), "labels")
        release(edges.sparkSession, held)  # the round before is read no more
        labels = jumped
        if jumped.where("old <> label").isEmpty():
            return labels


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all nodes in ``links (a, b)``: the smallest node reachable.

    Trees are contracted to their roots, and only the different links that remain between roots go on, so
    links are joined with labels once and not in every round; each contraction at least halves the nodes.
    """
    spark = links.sparkSession
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    trees, held = [], [edges._written_path]
    while not trees or not edges.isEmpty():
        labels = _hooked(edges)
        trees.append(labels.select("node", "label"))
        named = edges
        for side in ("a", "b"):
            own = labels.select("node", F.col("label").alias("root"))
            named = named.join(own, named[side] == own.node).withColumn(side, F.col("root")).select("a", "b")
        named = named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(named.distinct(), "links")
        held += [labels._written_path, edges._written_path]
    roots = trees[0]
    for tree in trees[1:]:
        above = tree.select(F.col("node").alias("label"), F.col("label").alias("root"))
        roots = roots.join(above, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    low = roots.groupBy("label").agg(F.min("node").alias("low"))
    labels = materialize(roots.join(low, "label").select("node", F.col("low").alias("label")), "labels")
    release(spark, *held)
    return labels


def joined_components(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """``node, label`` after more links ``(a, b)``: only the components that they join are labelled anew."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    named = fresh.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    edges = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    roots = components(edges)
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    known = moved.select("node", F.coalesce("root", "label").alias("label"))
    return materialize(known.unionByName(roots.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _packed_texts(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, text`` (compressed) of one document of each node in ``reps (id, node)``."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            made = [pack.compress(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "text"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body"), F.xxhash64(text_col).alias("text_hash"))
    own = rows.join(reps, rows.id.eqNullSafe(reps.rep_id) & (rows.text_hash == reps.rep_hash)).select("node", "body")
    return own.mapInArrow(run, "node bigint, text binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """``a, b`` of the pairs whose full shingle sets reach the threshold."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()

        @functools.lru_cache(maxsize=64)
        def parsed(text: bytes) -> set:
            return shingles(blank_words(unpack.decompress(text)), size)

        for batch in sliced(batches):
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = parsed(one), parsed(two)
                both = len(x & y)
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the share of equal signature values as ``votes``, without those too far apart for any link."""

    def run(batches):
        for batch in sliced(batches, 2048):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (4, 5))
            equal = (x == y).sum(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(equal.astype(np.int64)), batch.column(2), batch.column(3)]
            made = pa.RecordBatch.from_arrays(columns, names=["a", "b", "votes", "label_a", "label_b"])
            yield made.filter(pa.array(equal >= SIGNATURE_LEAST * HASHES))

    short = _briefs(nodes)
    one = short.select(F.col("node").alias("a"), F.col("brief").alias("brief_a"))
    two = short.select(F.col("node").alias("b"), F.col("brief").alias("brief_b"))
    joined = pairs.select("a", "b", "label_a", "label_b").join(one, "a").join(two, "b")
    joined = joined.select("a", "b", "label_a", "label_b", "brief_a", "brief_b")
    return joined.mapInArrow(run, "a bigint, b bigint, votes bigint, label_a bigint, label_b bigint")


def _best_partners(pairs: DataFrame) -> DataFrame:
    """Each node's candidate with most votes."""
    both = pairs.select("a", "b", "votes").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are not connected yet, with the labels of both; a node without links is its own."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    joined = pairs.select("a", "b", "votes").join(one, "a", "left").join(two, "b", "left")
    named = joined.select("a", "b", "votes", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))
    return named.where("label_a <> label_b")


def _through_hubs(left: DataFrame, links: DataFrame) -> DataFrame:
    """For each node's best pair still apart, each side with the other side's most linked neighbour: new candidates."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = materialize(both.groupBy("a").agg(F.count("*").alias("degree")), "degrees")
    known = both.join(degree.withColumnRenamed("a", "b"), "b")
    hubs = materialize(known.groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("hub")), "hubs")
    sides = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = sides.join(hubs.withColumnRenamed("a", "b"), "b").where(F.col("hub") != F.col("a"))
    return far.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"), F.lit(0).cast("bigint").alias("votes")).distinct()


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the symmetric matrix ``near`` that connect all that it connects."""
    seen = np.zeros(len(near), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            rows = near[front] & ~seen
            fresh = np.flatnonzero(rows.any(axis=0))
            left.append(front[rows[:, fresh].argmax(axis=0)])
            right.append(fresh)
            seen[fresh] = True
            front = fresh
    return np.concatenate(left), np.concatenate(right)


def _near(briefs: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which nodes of different components have signatures that allow a link."""
    n = len(label)
    if n <= 64:
        equal = (briefs[:, None] == briefs[None]).sum(axis=2)
    else:
        equal = np.zeros((n, n), np.uint8)
        for value in np.ascontiguousarray(briefs.T):
            equal += value[:, None] == value
    return (equal >= SIGNATURE_LEAST * HASHES) & (label[:, None] != label)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[counts[column] > 1], column[counts[column] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(_starts(column[order])) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK):
        own = slice(*np.searchsorted(column, [start, start + BLOCK]))
        dense = np.zeros((len(sets), BLOCK), np.float32)
        dense[owner[own], column[own] - start] = 1
        both += dense @ dense.T
    return both.astype(np.int64)


def _groups(batches, width: int):
    """The rows of each key, the first ``width`` columns, of batches sorted by it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        firsts = np.flatnonzero(_starts(*[rows.column(k).to_numpy() for k in range(width)]))
        for start, end in zip(firsts[:-1], firsts[1:], strict=True):
            yield rows.slice(start, end - start)
        held = rows.slice(firsts[-1])
    if held is not None:
        yield held


def _in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``key, row, column, ..``: rows of a key with ``n`` of them dealt to all pairs of its blocks, a block by the node's hash."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node", key), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = [c for c in rows.columns if c not in (key, "n", "_own", "_other")]
    rows = rows.select(key, F.least("_own", "_other").alias("row"), F.greatest("_own", "_other").alias("column"), *rest)
    return rows.repartition(key, "row", "column").sortWithinPartitions(key, "row", "column")


def _briefs(nodes: DataFrame) -> DataFrame:
    """``node, brief``: one byte of each signature value."""

    def run(batches):
        for batch in sliced(batches, 1024):
            made = [bytes(s[::4]) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "brief"])

    return nodes.select("node", "sketch").mapInArrow(run, "node bigint, brief binary")


def _edges(found) -> pa.RecordBatch:
    low, high = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(low, high)), pa.array(np.maximum(low, high))], names=["a", "b"])


def _crowds(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b`` that connect all nodes of different components that share a region and have signatures that allow a link.

    Regions of two nodes are left out, as their nodes are candidates.  A block hands on a spanning forest of
    its pairs, so a crowd's edges grow with its nodes and blocks.
    """

    def regions(batches):
        for batch in sliced(batches, 1024):
            node, label = (batch.column(k).to_numpy() for k in (0, 2))
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), HASHES)
            key = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(node), 1))
            for depth in range(REGION):
                key = (key ^ (key >> np.uint64(31))) * _M1 + sketches[:, ORDERS[:, depth]].astype(np.uint64) * _M2
            key = (key ^ (key >> np.uint64(29))).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(node, TREES)), pa.array(np.repeat(label, TREES))], names=["region", "node", "label"])

    def run(batches):
        found = []
        for rows in _groups(batches, 3):
            node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
            if len(node) > 1 and (label != label[0]).any():
                briefs = np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(-1, HASHES)
                one, two = _spanning(_near(briefs, label))
                found.append((node[one], node[two]))
        yield _edges(found)

    named = nodes.join(labels, "node", "left").select("node", "sketch", F.coalesce("label", "node").alias("label"))
    rows = materialize(named.mapInArrow(regions, "region bigint, node bigint, label bigint"), "regions")
    sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = materialize(sizes.where("n > 2 AND low <> high").select("region", "n"), "open-regions")
    rows = materialize(rows.join(sizes, "region"), "open-nodes")
    rows = rows.join(_briefs(nodes), "node").select("region", "n", "node", "label", "brief")
    return materialize(_in_blocks(rows, "region", REGION_BLOCK).mapInArrow(run, "a bigint, b bigint").distinct(), "crowd-edges")


def _crowd_links(nodes: DataFrame, labels: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame | None:
    """``a, b``: links between components, by comparing all nodes of each crowd in blocks; None without crowds."""
    edges = _crowds(nodes, labels)
    if edges.isEmpty():
        return None
    crowds = components(edges).withColumnRenamed("label", "crowd")
    sizes = materialize(crowds.groupBy("crowd").agg(F.count("*").alias("n")), "crowd-sizes")
    rows = crowds.join(sizes, "crowd").join(labels, "node", "left").select("crowd", "n", "node", F.coalesce("label", "node").alias("label"))
    rows = materialize(rows, "crowd-nodes").join(_briefs(nodes), "node").join(texts, "node").select("crowd", "n", "node", "label", "brief", "text")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for rows in _groups(batches, 3):
            label = rows["label"].to_numpy()
            near = _near(np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(-1, HASHES), label)
            own = np.flatnonzero(near.any(axis=1))
            if not len(own):
                continue
            rows = rows.take(own)
            sets = [shingle_hashes(blank_words(unpack.decompress(t)), size) for t in rows["text"].to_pylist()]
            both = _overlaps(sets)
            sizes = np.array([len(s) for s in sets])
            fits = 100 * both >= threshold * (sizes[:, None] + sizes - both)
            one, two = _spanning(fits & near[np.ix_(own, own)])
            node = rows["node"].to_numpy()
            yield _edges([(node[one], node[two])])

    found = materialize(_in_blocks(rows, "crowd", CROWD_BLOCK).mapInArrow(run, "a bigint, b bigint").distinct(), "crowd-links")
    return _confirmed(found, texts, size, threshold)


def linked_components(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame | None:
    """``node, label`` of all nodes that have a link, or None without candidates.

    Round by round: each node's best candidate; then each node's best of what is still apart and of the
    other side's hubs; then all that remains; last, all nodes that share a region.  A pair is left out only
    where its nodes are connected already, share no region or their signatures rule a link out.
    """
    pairs = candidates(nodes)
    if pairs.isEmpty():
        return None
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = nodes.join(involved, "node", "left_semi").select("node", "rep_id", "rep_hash")
    texts = materialize(_packed_texts(docs, reps, id_col, text_col), "texts")
    links = materialize(_confirmed(_best_partners(pairs), texts, size, threshold), "confirmed")
    labels = components(links)
    left = materialize(_between(pairs, labels), "pairs-left")
    for stage in ("best", "all"):
        if left.isEmpty():
            break
        if stage == "best":
            left = materialize(_alike(left, nodes), "pairs-left")
            more = _alike(_between(_through_hubs(_best_partners(left), links), labels), nodes)
            left = materialize(left.unionByName(more).dropDuplicates(["a", "b"]), "pairs-left")
        fresh = materialize(_confirmed(_best_partners(left) if stage == "best" else left, texts, size, threshold), "confirmed")
        if not fresh.isEmpty():
            labels = joined_components(labels, fresh)
            if stage == "best":
                left = materialize(_between(left, labels), "pairs-left")
    fresh = _crowd_links(nodes, labels, texts, size, threshold)
    fresh = None if fresh is None else materialize(fresh, "confirmed")
    return labels if fresh is None or fresh.isEmpty() else joined_components(labels, fresh)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row a node: its first row as ``rep``, its sketch, and whether rows with another ``check`` share its number."""
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    own = rows.where("node IS NOT NULL").groupBy("node")
    nodes = own.agg(F.min(order).alias("rep"), F.first("sketch").alias("sketch"), F.min("check").alias("check"), F.max("check").alias("other"))
    return nodes.select("node", "rep", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "sketch", "check", (F.col("check") < F.col("other")).alias("mixed"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """``id, text_hash, n_shingles, component_id, first`` of every row.

    ``first`` marks the rows that stand for their component: those with its smallest id (null ids come last)
    and, of these, its smallest hash of the text; rows equal in both are all marked.  Rows with empty sets
    stand for themselves.
    """
    docs = docs.select(id_col, text_col)
    rows = materialize(features(docs, id_col, text_col, size), "features")
    nodes = materialize(_nodes(rows), "nodes")
    while not (mixed := nodes.where("mixed")).isEmpty():
        # Sets of different digests fell on one number: all but one of them get a number of both halves.
        clash = mixed.select("node", F.col("check").alias("_kept"))
        moved = F.when(F.col("check") != F.col("_kept"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        rows = materialize(rows.join(clash, "node", "left").withColumn("node", moved).select(*rows.columns), "features")
        nodes = materialize(_nodes(rows), "nodes")
    nodes = nodes.select("node", "rep", "rep_id", "rep_hash", "sketch")
    labels = linked_components(docs, nodes, id_col, text_col, size, threshold)
    named = nodes.select("node", "rep")
    if labels is not None:
        own = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        low = materialize(own.groupBy("label").agg(F.min("rep").alias("low")), "lowest")
        named = own.join(low, "label").select("node", F.col("low").alias("rep"))
    named = materialize(named, "components")
    out = rows.select("id", "text_hash", "node", "n_shingles").join(named, "node", "left")
    alone = F.col("node").isNull()
    first = alone | (F.col("id").eqNullSafe(F.col("rep.id")) & F.col("text_hash").eqNullSafe(F.col("rep.text_hash")))
    return out.select("id", "text_hash", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("rep.id")).alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    Rows whose sets of ``size``-word shingles overlap by ``threshold`` per cent of their union are linked;
    ``component_id`` is the smallest id reachable.  Null, empty and blank texts have empty sets and stay
    alone; a text shorter than a shingle is one shingle; very long texts are shingled whole; repeated rows
    share one component and are kept together; of ties no choice is needed; null ids never name a component
    unless it has no other; columns besides id and text are left behind, so names cannot clash; an empty
    table gives an empty table.
    """
    rows = near_rows(docs, id_col, text_col, size, threshold)
    return rows.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
