"""Best-two-fit packing of token sequences.

Texts become token ids plus an end token and are cut into pieces of at most ``CAPACITY``.
The packing itself works on the histogram of piece lengths, which never has more than
``CAPACITY`` entries: a bin is filled greedily with the longest lengths that fit, then its
shortest piece gives way to the two unpacked pieces that fill the expanded gap most tightly,
and the pattern is used as often as the counts allow.  Pieces find their place by their rank
within their length, so no task ever holds more than a shard of one length.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, keyed, materialize, sliced
from .token_counts import byte_symbols, read_vocabulary

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task ranks, about.
SHARD_ROWS = 100_000

#: Fixed value: the split pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts by a byte-level BPE file, as its own library gives them without a template's special tokens.

    The ranks engine gives the same ids several times faster where the file's ids follow its merges; other
    files, texts that hold the string of an added token (one id there), and texts on which that engine
    breaks off, go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        self.plain = tokenizers.Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [token["content"] for token in spec.get("added_tokens") or []]
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        kind = spec.get("pre_tokenizer") or {}
        level = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and not spec.get("normalizer")
        if level and ids == sorted(ids) and set(byte_symbols()) <= set(vocab):
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=read_vocabulary(path), special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not any(token in text for token in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # the engine's panics are no Exceptions
                if isinstance(error, KeyboardInterrupt | SystemExit | GeneratorExit):
                    raise
        return self.plain.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the first piece takes the remainder."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and the token ids, if asked for) of every text's pieces.

    A null or empty text is the end token alone; a very long text gives as many pieces as it takes; repeated
    rows give repeated pieces; an empty table gives an empty table; other columns are left out, so names cannot
    clash.
    """

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in sliced(batches):
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array([*encode(text), END_ID], "<u4")
                for number, (start, size) in enumerate(cuts(len(own))):
                    part = own[start : start + size]
                    rows.append((name, number, start, size, zlib.crc32(part.tobytes()), part.astype("i4") if ids else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds[:keep], strict=True)], names=names[:keep])

    rows = keyed(df, id_col, text_col)
    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return rows.select(rows.id.cast("bigint").alias("id"), "body").mapInArrow(run, schema)


@dataclass
class Plan:
    """Rank ranges of each length, sorted by length and first rank; parallel arrays and the offsets of each range's pattern."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offsets: list[np.ndarray]
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            low, high = np.searchsorted(self.length, [length, length + 1])
            at = low + np.searchsorted(self.first[low:high], ranks[own], side="right") - 1
            for entry in np.unique(at):
                rows = own[at == entry]
                copy, slot = np.divmod(ranks[rows] - self.first[entry], len(self.offsets[entry]))
                sequence[rows] = self.sequence[entry] + copy
                offset[rows] = self.offsets[entry][slot]
        return sequence, offset


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, copies)`` that use up ``counts`` exactly.

    Each pattern is used until one of its lengths runs short, so there are never more patterns than
    the sum over lengths of the pieces of that length that fit a bin (under 8 capacity).
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    patterns: list[tuple[list[int], int]] = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            lengths.remove(n)

    def give(n: int) -> None:
        if not left[n]:
            insort(lengths, n)
        left[n] += 1

    while lengths:
        bin_: list[int] = []
        gap = capacity
        while lengths and (at := bisect_right(lengths, gap)):
            n = lengths[at - 1]
            times = min(left[n], gap // n)
            for _ in range(times):
                take(n)
            bin_ += [n] * times
            gap -= n * times
        if gap and len(bin_) > 1:
            small = min(bin_)
            pair = _two_fit(lengths, left, gap + small, small)
            if pair:
                bin_.remove(small)
                give(small)
                for n in pair:
                    take(n)
                bin_ += pair
        need = {n: bin_.count(n) for n in set(bin_)}
        more = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * more
            if not left[n] and n in lengths:
                lengths.remove(n)
        patterns.append((bin_, more + 1))
    return patterns


def _two_fit(lengths: list[int], left: dict[int, int], room: int, over: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum above ``over`` and up to ``room``."""
    best, found = over, None
    low, high = 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room:
            high -= 1
            continue
        if total > best and (low != high or left[lengths[low]] > 1):
            best, found = total, [lengths[high], lengths[low]]
        low += 1
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Which ranks of each length go into which sequences."""
    used = dict.fromkeys(counts, 0)
    entries = []
    sequence = 0
    for bin_, copies in best_two_fit(counts, capacity):
        slots: dict[int, list[int]] = {}
        at = 0
        for n in bin_:
            slots.setdefault(n, []).append(at)
            at += n
        for n, offsets in slots.items():
            entries.append((n, used[n], sequence, np.array(offsets, np.int64)))
            used[n] += len(offsets) * copies
        sequence += copies
    entries.sort(key=lambda e: e[:2])
    columns = [np.array([e[k] for e in entries], np.int64) for k in range(3)]
    return Plan(*columns, [e[3] for e in entries], sequence)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``id, piece, start, length``) and for each its ``sequence_id`` and gapless ``offset``.

    Every row is placed once, repeated rows and rows with null ids too; pieces of equal length, id and number
    take any order; an empty table gives an empty table.  Pieces are written to the shared folder once; what goes to the driver and back out is the
    histogram of at most ``capacity`` lengths and the plan made from it.
    """
    rows = materialize(pieces, "pieces")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)))
    sizes = rows.groupBy("length", "shard").count()
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "shard").orderBy("id", "piece")
    ranked = (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "shard"])
        .withColumn("rank", (F.col("rank") + F.col("base")).cast("bigint"))
    )
    held = rows.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    names = pieces.columns

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = held.value.place(lengths, ranks)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    schema = extended(pieces, names, "sequence_id bigint, offset bigint")
    return ranked.select(*names, "rank").mapInArrow(run, schema)
