"""Suffix-array dedup of byte strings that also start in an earlier document.

Only suffixes that can matter are sorted.  Every string of ``LENGTH`` bytes holds one anchor, its
smallest hashed ``GRAM``; equal strings have it at the same place.  Anchors that occur once are set
aside by an exchange of packed anchor hashes.  The suffixes at the others, with the strings they
stand for, are range-partitioned by their leading bytes with sampled splitters, sorted in each bucket
by multikey quicksort, and neighbours with equal strings are compared; suffixes at the ends of a
bucket are compared across boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1  # grams of one string
#: Bytes of text in one chunk (a longer document is a chunk of its own), and of text behind one hash bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Positions handled at once; anchors carry their place in so many low bits.
BLOCK = 1 << 21
PLACE_BITS = 22
HASH_BITS = 39
LAST = (1 << 63) - 1  # the place of null ids: after all others

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian number (short by 7 positions)."""
    value = data.astype(np.uint64)
    for step in (1, 2, 4):
        value = (value[:-step] << np.uint64(8 * step)) | value[step:]
    return value


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from every position on."""
    at = words_at(data)
    n = len(data) - GRAM + 1
    value = at[:n] * _M1
    value = (value ^ (value >> np.uint64(29)) ^ at[8 : n + 8]) * _M2
    value = (value ^ (value >> np.uint64(31)) ^ at[GRAM - 8 : n + GRAM - 8]) * _M1
    return value ^ (value >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``LENGTH`` bytes inside documents that end at ``ends``.

    Returns parallel arrays: the anchor's place, its gram's hash, and the first and last start of the
    strings whose anchor it is.
    """
    found = []
    for start in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[start : start + BLOCK + LENGTH - 1]
        hashes = gram_hashes(part)
        packed = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        low, width = packed, 1
        while width * 2 <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < REACH:
            low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        begin = np.arange(len(place))
        inside = np.searchsorted(ends, begin + start, side="right")
        valid = np.flatnonzero(begin + start + LENGTH <= ends[inside])
        if not len(valid):
            continue
        place, begin, inside = place[valid], valid, inside[valid]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
        last = np.append(new[1:] - 1, len(place) - 1)
        found.append((place[new] + start, hashes[place[new]], begin[new] + start, begin[last] + start))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``chunk, ids, sizes, digests, blob``: documents in groups of about ``CHUNK_BYTES``, compressed."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        pack = zstandard.ZstdCompressor(level=3)
        ids, texts, digests, held = [], [], [], 0

        def out():
            nonlocal number, ids, texts, digests, held
            row = [[number], [ids], [[len(t) for t in texts]], [digests], [pack.compress(b"".join(texts))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "sizes", "digests", "blob"])
            number, ids, texts, digests, held = number + 1, [], [], [], 0
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for name, text, digest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if texts and held + len(text) > CHUNK_BYTES:
                        yield out()
                    ids.append(name)
                    texts.append(text)
                    digests.append(digest)
                    held += len(text)
        if texts:
            yield out()

    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), body.alias("body")).select("id", "body", F.sha2("body", 256).alias("digest"))
    return rows.mapInArrow(run, "chunk bigint, ids array<bigint>, sizes array<bigint>, digests array<string>, blob binary")


def _opened(blob: bytes, sizes: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A chunk's bytes and the starts and ends of its documents."""
    ends = np.cumsum(np.array(sizes, np.int64))
    return zstandard.ZstdDecompressor().decompress(blob), ends - sizes, ends


def _keys(data: np.ndarray, ends: np.ndarray, bits: int):
    """A chunk's anchors, its distinct hashes in order, and where each anchor and each bucket lies in them.

    Anchors have the smallest hashes of their strings, so they are mixed anew to fill all buckets alike.
    """
    place, hashes, first, last = anchors(data, ends)
    mixed = (hashes ^ (hashes >> np.uint64(33))) * _M2
    short = (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - bits - HASH_BITS)
    distinct, at = np.unique(short, return_inverse=True)
    bounds = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS))
    return place, first, last, distinct, at, np.append(bounds, len(distinct))


def shared_anchors(table: DataFrame, bits: int) -> DataFrame:
    """``chunk, bucket, bits``: for each chunk's distinct anchor hashes, in order, whether another document has them too.

    A hash leaves a chunk once, so the most frequent anchor is no more than one entry a chunk, and a chunk sends
    no more rows than it has buckets or distinct hashes, whichever is fewer: at any size the rows stay in
    proportion to the text.
    """

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                data, _, ends = _opened(one.column("blob")[0].as_py(), one.column("sizes")[0].as_py())
                place, _, _, distinct, at, bounds = _keys(np.frombuffer(data, np.uint8), ends, bits)
                doc = np.searchsorted(ends, place, side="right")
                low, high = np.full(len(distinct), len(ends)), np.full(len(distinct), -1)
                np.minimum.at(low, at, doc)
                np.maximum.at(high, at, doc)
                entries = ((distinct & np.uint64((1 << HASH_BITS) - 1)) << np.uint64(1)) | (low < high).astype(np.uint64)
                own = np.flatnonzero(np.diff(bounds))
                raw = entries.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                made = [raw[bounds[b] : bounds[b + 1]].tobytes() for b in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int64)), pa.array([one.column("chunk")[0].as_py()] * len(own), pa.int64()), pa.array(made, pa.binary())],
                    names=["bucket", "chunk", "entries"],
                )

    def meet(key, rows):
        sent = rows["entries"].to_pylist()
        sizes = [len(e) // 5 for e in sent]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :5] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, 5)
        entries = raw.view("<u8").ravel()
        hashes, several = entries >> np.uint64(1), (entries & np.uint64(1)).astype(bool)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        shared = several[order] | np.r_[False, same] | np.r_[same, False]
        back = np.zeros(len(hashes), bool)
        back[order] = shared
        cuts = np.cumsum([0, *sizes])
        made = [np.packbits(back[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": rows["chunk"], "bucket": pa.array([key[0].as_py()] * len(made), pa.int64()), "bits": pa.array(made, pa.binary())})

    sent = table.select("chunk", "sizes", "blob").mapInArrow(send, "bucket bigint, chunk bigint, entries binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket bigint, bits binary")


SUFFIX = "k1 bigint, k2 bigint, place bigint, doc bigint, chunk bigint, row int, start int, strings binary"


def suffixes(table: DataFrame, marks: DataFrame, copies: DataFrame, bits: int) -> DataFrame:
    """Suffixes at shared anchors: 16 leading bytes, the document's place in order, and the bytes of the strings they stand for."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1).to_pylist()[0]
                raw, starts, ends = _opened(one["blob"], one["sizes"])
                data = np.frombuffer(raw, np.uint8)
                place, first, last, distinct, at, bounds = _keys(data, ends, bits)
                shared = np.zeros(len(distinct), bool)
                for mark in one["marks"] or ():
                    a, b = bounds[mark["bucket"]], bounds[mark["bucket"] + 1]
                    shared[a:b] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=b - a).astype(bool)
                row = np.searchsorted(ends, place, side="right")
                plain = np.ones(len(ends), bool)
                plain[one["copies"] or []] = False
                keep = np.flatnonzero(shared[at] & plain[row])
                leading = words_at(data).view(np.int64)
                order = np.array([LAST if i is None else i for i in one["ids"]], np.int64)
                for s in range(0, len(keep), 10_000):
                    own = keep[s : s + 10_000]
                    r = row[own]
                    strings = [raw[a : b + LENGTH] for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)]
                    arrays = [
                        pa.array(leading[place[own]]), pa.array(leading[place[own] + 8]), pa.array((place - first)[own]), pa.array(order[r]),
                        pa.array(np.full(len(own), one["chunk"], np.int64)), pa.array(r.astype(np.int32)),
                        pa.array((first[own] - starts[r]).astype(np.int32)), pa.array(strings, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "place", "doc", "chunk", "row", "start", "strings"])

    marked = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    joined = table.select("chunk", "ids", "sizes", "blob").join(marked, "chunk").join(copies, "chunk", "left")
    return joined.select("chunk", "ids", "sizes", "blob", "marks", "copies").mapInArrow(run, SUFFIX)


def multikey_groups(columns: list[np.ndarray]) -> np.ndarray:
    """Group number of each row, equal rows alike: a multikey quicksort whose characters are 8-byte columns.

    Rows are sorted by one column at a time; only runs that are still equal go on to the next.
    """
    n = len(columns[0])
    group = np.zeros(n, np.int64)
    active, label = np.arange(n), np.zeros(n, np.int64)
    numbers = 0
    for depth, column in enumerate(columns):
        value = column[active]
        order = np.lexsort((value, label)) if depth else np.argsort(value, kind="stable")
        active, label, value = active[order], label[order], value[order]
        new = np.ones(len(active), bool)
        new[1:] = (value[1:] != value[:-1]) | (label[1:] != label[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run] if len(run) else run
        last = depth == len(columns) - 1
        done = np.ones(len(active), bool) if last else size == 1
        group[active[done]] = numbers + run[done]
        numbers += int(run[-1]) + 1 if len(run) else 0
        active, label = active[~done], run[~done]
        if not len(active):
            break
    return group


def repeated_runs(strings: list[bytes], doc: np.ndarray) -> tuple[tuple, tuple]:
    """Runs of bytes that an earlier document has too, and the heads that may still have an earlier one elsewhere.

    Runs are ``(row, first, end)`` relative to each row's strings.  Heads are ``(row, start)``: the strings of
    the earliest document among these rows, one a distinct string but for repeats inside that document.
    """
    number: dict[bytes, int] = {}
    text = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    distinct = list(number)
    earliest = np.full(len(distinct), LAST, np.int64)
    np.minimum.at(earliest, text, doc)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    counts = sizes - LENGTH + 1
    at = words_at(np.frombuffer(b"".join(distinct), np.uint8))
    offset = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(distinct)), counts)
    base = np.cumsum(counts) - counts
    begin = np.arange(len(owner)) - base[owner] + offset[owner]
    group = multikey_groups([at[begin + shift] for shift in (*range(0, LENGTH - 8, 8), LENGTH - 8)])
    low = np.full(int(group.max()) + 1 if len(group) else 0, LAST, np.int64)
    np.minimum.at(low, group, earliest[owner])
    low = low[group]  # earliest document of every string of every distinct text

    def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and earliest document of every string of some rows."""
        n = counts[text[rows]]
        who = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(who)) - (np.cumsum(n) - n)[who]
        return rows[who], step, low[base[text[rows]][who] + step]

    who, step, first = spread(np.flatnonzero(doc > np.minimum.reduceat(low, base)[text]))
    hit = first < doc[who]
    who, step = who[hit], step[hit]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (step[1:] != step[:-1] + 1)]) if len(who) else who
    last = np.append(new[1:] - 1, len(who) - 1) if len(who) else who
    head, start, first = spread(np.flatnonzero(doc == earliest[text]))
    own = first == doc[head]
    return (who[new], step[new], step[last] + LENGTH), (head[own], start[own])


def repeated_runs_wide(strings: list[bytes], place: np.ndarray, doc: np.ndarray) -> tuple[tuple, tuple]:
    """The same for any number of rows of one leading gram, in memory in proportion to the rows' bytes.

    Equal strings have their anchor at the same place, so the strings with the anchor at one place are compared
    at a time, one a row at most; ``place`` is the anchor's place in each row's strings.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    offset = np.cumsum(sizes) - sizes
    at = words_at(np.frombuffer(b"".join(strings), np.uint8))
    hit = np.zeros((len(strings), REACH + 1), bool)
    heads: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(REACH):
        step = place - back
        rows = np.flatnonzero((step >= 0) & (step <= sizes - LENGTH))
        if not len(rows):
            continue
        begin = offset[rows] + step[rows]
        group = multikey_groups([at[begin + shift] for shift in (*range(0, LENGTH - 8, 8), LENGTH - 8)])
        low = np.full(int(group.max()) + 1, LAST, np.int64)
        np.minimum.at(low, group, doc[rows])
        hit[rows, step[rows]] = low[group] < doc[rows]
        first = rows[doc[rows] == low[group]]
        heads.append((first, step[first]))
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    empty = np.zeros(0, np.int64)
    head, step = (np.concatenate(c) for c in zip(*heads, strict=True)) if heads else (empty, empty)
    return (row, start, end - 1 + LENGTH), (head, step)


#: Bytes of text whose suffixes one range partition sorts, at most.
PARTITION_BYTES = 128 << 20


def repeats(found: DataFrame, total: int) -> DataFrame:
    """``chunk, row, start, end``: byte runs of documents that strings of earlier documents cover; ``total`` bytes of text."""
    keys = ["k1", "k2", "doc", "chunk", "row", "start"]
    few = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-total // PARTITION_BYTES)
    ordered = (found.repartitionByRange(parts, *keys) if parts > few else found.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        k1, k2, doc, start = (table[c].to_numpy() for c in ("k1", "k2", "doc", "start"))
        edge = ((k1 == k1[0]) & (k2 == k2[0])) | ((k1 == k1[-1]) & (k2 == k2[-1]))
        # A slice at a time, cut between groups of equal leading bytes; the end groups make one of their own.
        inner = np.flatnonzero(~edge)
        cuts = [0]
        if len(inner):
            for c in np.flatnonzero((k1[inner][1:] != k1[inner][:-1]) | (k2[inner][1:] != k2[inner][:-1])) + 1:
                if c - cuts[-1] >= SLICE_ROWS:
                    cuts.append(int(c))
        slices = [(inner[a:b], False) for a, b in zip(cuts, [*cuts[1:], len(inner)], strict=True)]
        for own, is_edge in [*slices, (np.flatnonzero(edge), True)]:
            if not len(own):
                continue
            part = table.take(pa.array(own))
            strings = part["strings"].to_pylist()
            if len(own) > WIDE_ROWS:
                (row, first, end), (head, step) = repeated_runs_wide(strings, part["place"].to_numpy(), doc[own])
            else:
                (row, first, end), (head, step) = repeated_runs(strings, doc[own])
            yield from _found(part, row, start[own][row] + first, start[own][row] + end)
            if is_edge:
                yield from _found(part, head, start[own][head] + step, None, [strings[r][a : a + LENGTH] for r, a in zip(head.tolist(), step.tolist(), strict=True)])

    schema = "chunk bigint, row int, start int, end int, strings binary, doc bigint"
    made = materialize(ordered.mapInArrow(run, schema), "repeats")
    # Heads at the ends of buckets: compared across boundaries, string by string.
    heads = made.where("end IS NULL").select("chunk", "row", "start", "doc", "strings")
    firsts = heads.groupBy("strings").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("strings", "first")
    firsts = materialize(firsts, "boundary")
    across = heads.join(firsts, "strings").where("doc > first").select("chunk", "row", "start", (F.col("start") + LENGTH).alias("end"))
    return made.where("end IS NOT NULL").select("chunk", "row", "start", "end").unionByName(across)


#: Suffixes that one slice of a bucket holds, about; a group of one gram that has more than ``WIDE_ROWS`` is compared place by place.
SLICE_ROWS = 20_000
WIDE_ROWS = 60_000


def _found(part: pa.Table, row: np.ndarray, start: np.ndarray, end: np.ndarray | None, strings: list[bytes] | None = None):
    """Batches of runs, or of heads with their strings."""
    for s in range(0, len(row), 10_000):
        pick = pa.array(row[s : s + 10_000])
        n = len(pick)
        take = lambda c: part[c].take(pick).combine_chunks()  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [
                take("chunk"),
                take("row"),
                pa.array(start[s : s + n].astype(np.int32)),
                pa.nulls(n, pa.int32()) if end is None else pa.array(end[s : s + n].astype(np.int32)),
                pa.nulls(n, pa.binary()) if strings is None else pa.array(strings[s : s + n], pa.binary()),
                take("doc"),
            ],
            names=["chunk", "row", "start", "end", "strings", "doc"],
        )


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, spans, kept``: byte runs removed from every text, and the bytes that stay.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.
    A null text is empty; texts shorter than ``LENGTH`` stay whole; very long ones are read whole, each a chunk of
    its own; rows with equal ids are not earlier than each other, so repeated rows go or stay alike; null ids come
    after all others; matches never cross documents; an empty table gives an empty table; other columns are left
    out, so names cannot clash.
    """
    table = materialize(chunks(docs, id_col, text_col), "chunks")
    total = table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).first().n or 0
    bits = max(1, int(total // BUCKET_BYTES).bit_length())
    named = table.select("chunk", F.posexplode(F.arrays_zip("ids", "digests"))).select(
        "chunk", F.col("pos").alias("row"), F.coalesce("col.ids", F.lit(LAST)).alias("doc"), F.col("col.digests").alias("digest")
    )
    firsts = materialize(named.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    copies = named.join(firsts, "digest").where("doc > first").groupBy("chunk").agg(F.collect_list("row").alias("copies"))
    copies = materialize(copies, "copies")
    marks = materialize(shared_anchors(table, bits), "marks")
    gone = repeats(suffixes(table, marks, copies, bits), total)
    gone = gone.groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "end")).alias("gone"))
    joined = table.select("chunk", "ids", "sizes", "blob").join(gone, "chunk", "left").join(copies, "chunk", "left")

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                chunk = {c: one.column(c)[0].as_py() for c in ("ids", "sizes", "blob", "copies")}
                raw, starts, _ = _opened(chunk["blob"], chunk["sizes"])
                spans: dict[int, list] = {}
                rows = one.column("gone").flatten()
                if len(rows):
                    for row, a, b in zip(*(rows.field(k).to_pylist() for k in range(3)), strict=True):
                        spans.setdefault(row, []).append((a, b))
                for row in chunk["copies"] or ():
                    if chunk["sizes"][row] >= LENGTH:
                        spans[row] = [(0, chunk["sizes"][row])]
                for s in range(0, len(chunk["ids"]), 256):
                    made = []
                    for row in range(s, min(s + 256, len(chunk["ids"]))):
                        size, at = chunk["sizes"][row], int(starts[row])
                        own = _merged(spans.get(row, ()))
                        kept, done = [], 0
                        for a, b in own:
                            kept.append(raw[at + done : at + a])
                            done = b
                        kept.append(raw[at + done : at + size])
                        made.append((chunk["ids"][row], size, [{"start": a, "end": b} for a, b in own], b"".join(kept)))
                    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    kinds = (pa.int64(), pa.int64(), span, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["id", "n_bytes", "spans", "kept"]
                    )

    schema = "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return joined.select("chunk", "ids", "sizes", "blob", "gone", "copies").mapInArrow(run, schema)
