"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark items.

The alphabet of the automaton is the benchmark's own vocabulary: each of its words is one symbol
and every other word is symbol 0, so a document is scanned once and offsets are word numbers,
which map back to the original text.  Every window of 13 item words holds one block of 7 words that
starts at a multiple of 7 in its item, so these blocks are the automaton's patterns, about one state a
benchmark word; a block that is met is extended to both sides along its item, and what reaches 13 words
is hit.  Items of fewer words are patterns as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, extended, field_bytes, sliced

#: Bytes of benchmark text in one automaton; a larger benchmark takes several in turn over the texts a task holds.
AUTOMATON_BYTES = 8_000_000
#: Bytes of text that a task holds while it goes through several automata.
HELD_BYTES = 64 << 20
WINDOW = 13
#: A document is contaminated from this share of hit words on: 1 in ``SHARE``.
SHARE = 20
SURROGATES = 0xD800, 0xE000

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class WindowScanner:
    """Finds windows of items in lists of words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.width = width
        self.symbol: dict[bytes, str] = {}
        block = (width + 1) // 2
        reach = width - block
        #: Of each pattern the item words around it, as far as a window reaches, and the items that have them.
        patterns: dict[str, dict[tuple[str, str] | None, set[str]]] = {}
        for name, text in items:
            own = "".join([self._symbol(w) for w in ascii_words(text)])
            if 0 < len(own) < width:
                patterns.setdefault(own, {}).setdefault(None, set()).add(name)
            for at in range(0, len(own) - block + 1, block) if len(own) >= width else ():
                around = own[max(0, at - reach) : at][::-1], own[at + block : at + width]
                patterns.setdefault(own[at : at + block], {}).setdefault(around, set()).add(name)
        self.machine = ahocorasick.Automaton()
        for pattern, places in patterns.items():
            self.machine.add_word(pattern, (len(pattern), list(places.items())))
        if patterns:
            self.machine.make_automaton()

    def _symbol(self, word: bytes) -> str:
        found = self.symbol.get(word)
        if found is None:
            code = len(self.symbol) + 1
            found = self.symbol[word] = chr(code if code < SURROGATES[0] else code + SURROGATES[1] - SURROGATES[0])
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word intervals ``[start, end)`` that windows cover, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not len(self.machine):
            return spans, names
        get = self.symbol.get
        text = "".join([get(w, "\0") for w in words])
        for last, (size, places) in self.machine.iter(text):
            end = last + 1
            start = end - size
            before, after = text[max(0, start - self.width) : start][::-1], text[end : end + self.width]
            for around, owners in places:
                if around is None:
                    spans.append((start, end))
                    names |= owners
                    continue
                left, right = _agreement(before, around[0]), _agreement(after, around[1])
                if left + size + right >= self.width:
                    spans.append((start - left, end + right))
                    names |= owners
        return merged(spans), names


def _agreement(one: str, two: str) -> int:
    """How many symbols two strings have in common at their start."""
    if one.startswith(two):
        return len(two)
    return next((n for n, (a, b) in enumerate(zip(one, two, strict=False)) if a != b), min(len(one), len(two)))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


@functools.lru_cache(maxsize=1)
def scanner(items: tuple[tuple[str, bytes], ...], width: int) -> WindowScanner:
    return WindowScanner(list(items), width)


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[tuple[str, bytes], ...]]:
    """Items in parts of about ``AUTOMATON_BYTES``; the benchmark's size is taken before any of it is fetched."""
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("binary").alias("body")
    ).where(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.length("body")).alias("n")).first().n or 0
    parts = max(1, -(-total // AUTOMATON_BYTES))
    out: list[list[tuple[str, bytes]]] = [[] for _ in range(parts)]
    for r in rows.withColumn("part", F.pmod(F.xxhash64("name", "body"), F.lit(parts))).toLocalIterator():
        out[r.part].append((r.name, bytes(r.body)))
    return [tuple(sorted(own)) for own in out]


OUT = "n_words bigint, n_hit bigint, items array<string>, hits array<struct<start:bigint,end:bigint>>, spans array<struct<start:bigint,end:bigint>>"


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """Words of every text inside any occurrence of a benchmark window.

    Returns all columns of ``docs`` under ``doc`` (a struct), then ``n_words``, ``n_hit``, ``items`` (sorted
    ids as strings), ``hits`` (word intervals) and ``spans`` (the same as byte offsets of the original
    UTF-8 text).  An item of fewer than ``width`` words is one window; null and empty texts have no words;
    very long texts are scanned whole; items with a null id count under the empty string, and equal items
    under each of their ids; repeated rows give repeated results; columns of ``docs`` may have any names, as
    they travel inside ``doc``; empty tables on either side give no hits.  The benchmark goes to every task;
    above ``AUTOMATON_BYTES`` a task takes several automata in turn over the texts it holds.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    held = spark.sparkContext.broadcast(benchmark_parts(benchmark, item_id, item_text))

    def run(batches):
        for group in _grouped(sliced(batches), len(held.value) > 1):
            texts = [[ascii_words(text or b"") for text in field_bytes(batch, text_col)] for batch in group]
            found = [[([], set()) for _ in words] for words in texts]
            for part in held.value:
                scan = scanner(part, width).scan
                for own, words in zip(found, texts, strict=True):
                    for (hits, items), one in zip(own, words, strict=True):
                        spans, names = scan(one)
                        hits += spans
                        items |= names
            for batch, words, own in zip(group, texts, found, strict=True):
                yield _result(batch, text_col, words, own)

    return rows.mapInArrow(run, extended(rows, ["doc"], OUT))


def _grouped(batches, several: bool):
    """Lists of batches: one by one, or as many as ``HELD_BYTES`` allow where several automata take turns."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if not several or size >= HELD_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _result(batch: pa.RecordBatch, text_col: str, words: list[list[bytes]], found: list[tuple[list, set]]) -> pa.RecordBatch:
    rows = []
    for text, own, (hits, items) in zip(field_bytes(batch, text_col), words, found, strict=True):
        hits = merged(hits)
        at = [m.span() for m in WORD.finditer(text)] if hits else []
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in hits]
        rows.append((len(own), sum(b - a for a, b in hits), sorted(items), [{"start": a, "end": b} for a, b in hits], spans))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), span, span)
    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc", "n_words", "n_hit", "items", "hits", "spans"])


def contaminated(found: DataFrame):
    """The contamination rule: some word is hit, and at least one word in ``SHARE``."""
    return (found.n_hit > 0) & (SHARE * found.n_hit >= found.n_words)


def items_digest(found: DataFrame):
    return F.sha2(F.array_join(found.items, ",").cast("binary"), 256)


def digest_of(names: list[str]) -> str:
    """The digest of item ids as plain Python, for tests."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
