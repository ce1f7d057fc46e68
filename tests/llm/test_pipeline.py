"""The corpus pipeline: stage contracts, decisions taking effect, and odd input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factloom.llm import decontamination as dc
from factloom.llm import near_dedup as nd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns(spark, docs):
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        before = after


def test_run_packs_what_the_stages_leave(spark, docs):
    packed = cp.run(spark, SF)
    rows = packed.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in per.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(w if rng.random() > 0.01 else "x" for w in words), "en", "s", 1) for n in range(6)] + [(50, "something else entirely", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {r.id for r in nd.near_duplicates(df).where("kept").collect()}
    got = {r.doc_id for r in cp.dedup_near(spark, df, SF).collect()}
    assert got == want and 0 in got and 50 in got


def test_decontamination_drops_planted_passages(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    planted = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit("before " + item.upper() + " after")})
    kept = {r.doc_id for r in cp.decontaminate(spark, docs.unionByName(planted), SF).collect()}
    assert not kept & {r.doc_id for r in planted.collect()}
    found = dc.find_contamination(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept == {r.doc.doc_id for r in found.where(~dc.contaminated(found)).collect()}


def test_line_dedup_updates_the_length(spark):
    rows = [(1, "a\nb\nc", "en", "s", 5), (2, "a\nb\nx", "en", "s", 5), (3, "a\nb", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.dedup_lines(spark, df, SF).collect()}
    assert got == {1: ("a\nb\nc", 5), 2: ("x", 1)}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, odd, empty, clashing, stage):
    _, function = cp.STAGES[stage]
    assert function(spark, empty, SF).count() == 0
    n = function(spark, odd, SF).count()
    assert n == function(spark, clashing, SF).count()
    assert n <= odd.count() or stage == 4


def test_of_repeated_rows_one_stays(spark, odd):
    got = [r.doc_id for r in cp.dedup_near(spark, odd, SF).collect()]
    assert got.count(8) == 1 and got.count(None) == 1 and 7 not in got and got.count(1) == 1


def test_rows_with_repeated_or_null_ids_lose_no_text(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    one, two, three = say("a"), say("b"), say("c")
    rows = [(1, one), (None, one), (None, two), (8, three), (8, one), (8, three), (9, None), (9, None), (None, ""), (9, "!")]
    df = spark.createDataFrame([(n, t, "en", "s", 1) for n, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in cp.dedup_near(spark, df, SF).collect()), key=repr)
    assert got == sorted([(1, one), (None, two), (8, three), (9, None), (None, ""), (9, "!")], key=repr)


def test_near_dedup_drops_what_the_query_links(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = {r.id for r in nd.near_duplicates(docs).where("NOT kept").collect()}
    kept = {r.doc_id for r in cp.dedup_near(spark, docs, sf_dir).collect()}
    assert len(gone) > 100 and not gone & kept and len(gone) + len(kept) == docs.count()


def test_line_dedup_deletes_a_repeated_long_line(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb", "en", "s", 1), (2, f"c\n{long}\nd", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.dedup_lines(spark, df, SF).collect()}
    assert got == {1: (rows[0][1], 1), 2: ("c\nd", 3)}


def removed_lines(rows):
    """``place in rows -> kept text``: later places of two lines in a row, and of lines of over 50 words."""
    first, gone = {}, {}
    for n, i, size in sorted((n, i, size) for n, r in enumerate(rows) if r[1] is not None for i, _ in enumerate(r[1].split("\n")) for size in (1, 2)):
        lines = rows[n][1].split("\n")
        part = tuple(lines[i : i + size])
        if len(part) < size or not any(x.strip(" ") for x in part) or (size == 1 and len(part[0].split()) <= 50):
            continue
        if first.setdefault(part, (n, i)) != (n, i):
            gone.setdefault(n, set()).update(range(i, i + size))
    return {n: "\n".join(x for k, x in enumerate(rows[n][1].split("\n")) if k not in out) for n, out in gone.items()}


def test_run_against_plain_loops(spark, tmp_path):
    """The whole pipeline on a small table: every stage's decisions, one after another, by brute force."""
    import zlib

    import numpy as np
    import test_near_dedup
    import test_scans
    from tokenizers import Tokenizer

    from factloom.llm import language_id as li

    rng = random.Random(11)
    words = "the of and in re tion ing er on an then that with for was".split()
    say = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    passages = [say(60) for _ in range(3)]
    items = [(n, say(20)) for n in range(4)]
    rows = []
    for n in range(70):
        lines = [say(rng.randrange(3, 20)) for _ in range(rng.randrange(1, 6))]
        if n % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(passages))
        if n % 9 == 0:
            lines.insert(0, rng.choice(items)[1])
        rows.append((n, "\n".join(lines), "en" if n % 5 else None, "s", 1))
    rows += [(100 + n, rows[n][1] + " more", "en", "s", 1) for n in range(0, 30, 3)] + [(200, "\u043d\u0435 \u0442\u043e " * 40, None, "s", 1), (201, None, None, None, None), (202, "123 !!", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in cp.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))

    model = li.train(li.training_rows(docs))
    kept = []
    for r in rows:
        counts, letters = li.gram_counts((r[1] or "").encode())
        if not model.predict(counts[None], np.array([letters]))[0][2]:
            kept.append(r)
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {200, 201, 202} and len(kept) >= 75
    cut = removed_lines(kept)
    lined = [(r[0], cut.get(n, r[1])) for n, r in enumerate(kept) if n not in cut or cut[n].strip(" ")]
    assert cut
    groups = test_near_dedup.brute(lined, 2)
    apart = [(n, t) for n, t in lined if groups[n][1] == n]
    assert len(apart) < len(lined)
    clean = []
    for n, t in apart:
        n_words, n_hit, _ = test_scans.naive_hits(t, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.append((n, t))
    assert len(clean) < len(apart)
    plain = Tokenizer.from_file(cp.TOKENIZER)
    want = {}
    for n, t in clean:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        want[n] = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {n: sorted(p) for n, p in got.items()} == want
