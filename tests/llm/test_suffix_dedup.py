"""Suffix-array dedup against a table of all strings."""

import random

import numpy as np
import pytest

from factloom.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string"


def brute(rows):
    """``(id, n_bytes, spans, kept)`` of every row, by the earliest document of every string."""
    texts = [(sd.LAST if n is None else n, (t or "").encode()) for n, t in rows]
    first = {}
    for n, t in texts:
        for i in range(len(t) - sd.LENGTH + 1):
            s = t[i : i + sd.LENGTH]
            first[s] = min(first.get(s, sd.LAST), n)
    out = []
    for (n, t), (name, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - sd.LENGTH + 1):
            if first[t[i : i + sd.LENGTH]] < n:
                gone[i : i + sd.LENGTH] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        spans = tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out.append((str(name), len(t), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return sorted(out)


def result(df):
    return sorted((str(r.id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


def corpus(rng, n):
    words = "the of and in re tion ing er on an über".split()
    say = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    passages = [say(rng.randrange(4, 30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages)[rng.randrange(8) :])
        rows.append((i * 37 % 1009, " ".join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [(2100, "ab" * 90), (2101, "b" + "ab" * 70), (2102, "a" * 49), (2103, "a" * 50), (2104, "a" * 51)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, monkeypatch, seed):
    if seed:
        monkeypatch.setattr(sd, "CHUNK_BYTES", 700)
        monkeypatch.setattr(sd, "BUCKET_BYTES", 5000)
    rows = corpus(random.Random(seed), 90)
    assert result(sd.dedup_substrings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_groups_compared_place_by_place_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "WIDE_ROWS", 0)
    monkeypatch.setattr(sd, "PARTITION_BYTES", 4000)
    rows = corpus(random.Random(5), 80)
    assert result(sd.dedup_substrings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("wide", [False, True])
def test_a_hot_passage_over_many_buckets(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(sd, "WIDE_ROWS", 0)
    rng = random.Random(8)
    line = "One very common line of text that stands in nearly every document."
    rows = [(n, f"{rng.random()} {line} {rng.random()}" * rng.choice([1, 2])) for n in range(200)]
    for name, value in (("spark.sql.shuffle.partitions", 11), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        assert result(sd.dedup_substrings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_tables(spark, odd, odd_rows, empty, clashing):
    want = brute([(r[0], r[1]) for r in odd_rows])
    assert result(sd.dedup_substrings(odd)) == want == result(sd.dedup_substrings(clashing))
    assert sd.dedup_substrings(empty).count() == 0


def test_anchors_cover_all_strings_alike():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    data = np.frombuffer((text + text[100:900]).encode(), np.uint8)
    place, _, first, last = sd.anchors(data, np.array([3000, 3800]))
    seen = {}
    for p, a, b in zip(place, first, last, strict=True):
        for start in range(a, b + 1):
            assert start not in seen and start <= p <= start + sd.LENGTH - sd.GRAM
            seen[start] = p - start
    assert set(seen) == {s for s in range(3800) if s + 50 <= 3000 or (s >= 3000 and s + 50 <= 3800)}
    assert all(seen[s + 3000 - 100] == seen[s] for s in range(100, 850))


def test_blocks_do_not_change_anchors(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choice("abc ") for _ in range(2000)).encode(), np.uint8)
    whole = sd.anchors(data, np.array([2000]))
    monkeypatch.setattr(sd, "BLOCK", 300)
    parts = sd.anchors(data, np.array([2000]))
    spread = lambda f: {s: p for p, a, b in zip(f[0], f[2], f[3], strict=True) for s in range(a, b + 1)}
    assert spread(whole) == spread(parts)


def test_multikey_groups():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500, np.uint64) for _ in range(4)]
    got = sd.multikey_groups(columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert len(set(zip(rows, got.tolist(), strict=True))) == len(set(rows)) == len(set(got.tolist()))


def test_buckets_fill_alike():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode(), np.uint8)
    *_, bounds = sd._keys(data, np.array([200_000]), 4)
    sizes = np.diff(bounds)
    assert len(sizes) == 16 and sizes.max() < 1.3 * sizes.mean()
