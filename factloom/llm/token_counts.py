"""Token counts by a linear longest-match automaton.

Words are split greedily into the longest pieces of a vocabulary.  A trie of the
vocabulary carries, for every node, a failure link and the number of pieces that
are settled ("popped") when the link is taken, so a word is counted in one pass
over its bytes and no piece is ever built.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_rows

#: Words remembered by a Python worker, and the longest word that is remembered.
CACHE_WORDS = 400_000
CACHE_BYTES = 64

NONE = -1


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use: their own character where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces and ids of a byte-level tokenizer file; added special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in special}


class PieceCounter:
    """Number of greedy longest pieces of a byte string; 1 for a string that can't be split whole."""

    def __init__(self, pieces) -> None:
        step: dict[int, int] = {}
        parent, symbol, final = [NONE], [0], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                node = step.get(key, NONE)
                if node == NONE:
                    node = step[key] = len(parent)
                    parent.append(key >> 8)
                    symbol.append(byte)
                    final.append(False)
            final[node] = node != 0
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a parent is older than its children
            depth[node] = depth[parent[node]] + 1
        link, popped = [NONE] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[node]:
                link[node], popped[node] = 0, 1
                continue
            at, count = link[parent[node]], popped[parent[node]]
            while at != NONE and (at << 8 | symbol[node]) not in step:
                count += popped[at]
                at = link[at]
            if at != NONE:
                link[node], popped[node] = step[at << 8 | symbol[node]], count
        self.step, self.link, self.popped = step, link, popped
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for byte in word:
            while (after := step.get(node << 8 | byte, NONE)) == NONE:
                total += popped[node]
                node = link[node]
                if node == NONE:
                    return 1
            node = after
        while node:
            total += popped[node]
            node = link[node]
            if node == NONE:
                return 1
        return total

    def counts(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(word) <= CACHE_BYTES:
                    known[word] = n
            out.append(n)
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(read_vocabulary(path))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_words, n_tokens, max_word_tokens`` of every text.

    Words are runs of anything but ASCII white space, and a blank is put before each as the mark of
    a word's start.  A null or empty text has no words and counts of 0; very long texts are counted whole; the
    longest match leaves no ties; repeated rows give repeated results; an empty table gives an empty table; other
    columns are left out, so names cannot clash.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = counter(vocabulary)
        rows = []
        for text in batch.column(1).to_pylist():
            each = pieces.counts([b" " + w for w in text.split()])
            rows.append((len(text), len(each), sum(each), max(each, default=0)))
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_bytes", "n_words", "n_tokens", "max_word_tokens"])

    rows = keyed(df, id_col, text_col)
    rows = rows.select(rows.id.cast("bigint").alias("id"), rows.body.cast("binary").alias("body"))
    return map_rows(rows, count, "id bigint, n_bytes bigint, n_words bigint, n_tokens bigint, max_word_tokens bigint")
