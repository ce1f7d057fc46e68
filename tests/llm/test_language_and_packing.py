"""Language ID by held-out accuracy, packing by exact reconstruction."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import language_id as li
from factloom.llm import packing as pk

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.train(li.training_rows(docs), sample=100)
    found = li.identify(docs, model).where(li.held_out(F.col("doc.doc_id")) & F.col("doc.lang").isNotNull())
    n, right, rejected = found.agg(
        F.count("*"), F.count_if(F.col("lang_pred") == F.col("doc.lang")), F.count_if("rejected")
    ).first()
    assert n > 200 and right / n > 0.98 and rejected / n < 0.01


def test_language_id_learns_only_from_training_rows(spark):
    rows = [(n, "été où çà" if n % 2 else "über straße", "fr" if n % 2 else "de") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = {r.doc_id for r in docs.where(li.held_out(F.col("doc_id"))).collect()}
    assert held == {n for n in range(60) if zlib.crc32(str(n).encode()) % 4 == 2}
    renamed = docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(set(li.train(li.training_rows(renamed)).labels)) == ["de", "fr"]


@pytest.mark.parametrize("unseen", ["de", "es", "fr"])
def test_language_id_rejects_a_language_left_out_of_training(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    known = docs.where(F.col("lang") != unseen)
    found = li.identify(docs, li.train(li.training_rows(known)))
    share = {r.own: r.share for r in found.groupBy((F.col("doc.lang") == unseen).alias("own")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share[True] >= 0.8 and share[False] <= 0.01


def test_language_id_ties_go_to_the_first_label(spark):
    rows = [(n, "same words here", "xx" if n % 2 else "aa") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in li.identify(docs, li.train(li.training_rows(docs))).collect()} == {"aa"}


def test_language_id_rejects_the_far_and_the_letterless(spark, odd, empty, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.train(li.training_rows(docs), sample=100)
    finnish = spark.createDataFrame([(1, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.")], "doc_id bigint, text string")
    assert li.identify(finnish, model).first().rejected
    alien = spark.createDataFrame([(1, "Это совсем другой язык, и его тут нет. " * 9)], "doc_id bigint, text string")
    assert li.identify(alien, model).first().rejected
    got = {r.doc.doc_id: r for r in li.identify(odd, model).collect()}
    for n in (1, 2, 3, 4):
        assert (got[n].lang_pred, got[n].score, got[n].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert li.identify(clashing, model).count() == odd.count()
    assert li.identify(empty, model).count() == 0
    assert li.identify(odd, li.train(empty)).where("lang_pred = 'und'").count() == odd.count()


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, 1 + int(rng.expovariate(0.05))) for _ in range(rng.choice([1, 5, 3000])))
    patterns = pk.best_two_fit(dict(counts), 64)
    used = Counter()
    for bin_, copies in patterns:
        assert 0 < sum(bin_) <= 64 and copies > 0
        for n in bin_:
            used[n] += copies
    assert used == counts
    if sum(counts.values()) == 3000:
        assert sum(c for _, c in patterns) <= 1.02 * sum(n * c for n, c in counts.items()) / 64


def test_two_fit_replaces_the_smallest():
    assert [sorted(b) for b, _ in pk.best_two_fit({6: 1, 2: 1, 1: 2, 3: 0}, 9)][0] == [1, 2, 6]
    assert sorted(pk.best_two_fit({50: 1, 30: 1, 28: 1, 21: 1}, 100)[0][0]) == [21, 28, 50]


def test_packing_against_the_tokenizer(spark, odd, empty, clashing, odd_rows):
    plain = Tokenizer.from_file(TOKENIZER)
    special = [(300, "hello <|endoftext|> world", "en", "s", 25), (301, "<|endoftext|>" * 1500, "en", "s", 19500), (302, "a<|endoftext|", "en", "s", 13)]
    odd = odd.unionByName(spark.createDataFrame(special, odd.schema))
    packed = pk.pack(pk.token_pieces(odd, TOKENIZER, ids=True)).collect()
    assert [r.ids for r in packed if r.id == 300] == [[31373, 220, 50256, 995, pk.END_ID]]
    by_text = {}
    for name, text, *_ in odd_rows + special:
        by_text.setdefault(name, []).append([*plain.encode(text or "", add_special_tokens=False).ids, pk.END_ID])
    pieces = {}
    for r in packed:
        assert r.length == len(r.ids) <= pk.CAPACITY
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        pieces.setdefault((r.id, r.piece), []).append((r.start, r.ids))
    for name, texts in by_text.items():
        want = Counter()
        for ids in texts:
            first = len(ids) % pk.CAPACITY or pk.CAPACITY
            for number, start in enumerate([0, *range(first, len(ids), pk.CAPACITY)]):
                end = first if number == 0 else start + pk.CAPACITY
                want[number, start, tuple(ids[start:end])] += 1
        got = Counter((n, s, tuple(i)) for (d, n), rows in pieces.items() if d == name for s, i in rows)
        assert got == want
    for sequence in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pk.CAPACITY
    assert pk.pack(pk.token_pieces(empty, TOKENIZER)).count() == 0
    assert pk.pack(pk.token_pieces(clashing, TOKENIZER)).count() == sum(r.id is None or r.id < 300 for r in packed)


def test_shards_rank_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(pk, "SHARD_ROWS", 7)
    rows = spark.range(100).selectExpr("id", "0 piece", "0L start", "cast(id % 3 + 1 as bigint) length", "id ids_crc32")
    got = pk.pack(rows, 4).toPandas()
    assert len(got) == 100 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id").length.sum().max() <= 4


def test_equal_lengths_with_equal_ids_each_get_a_place(spark):
    rows = spark.range(9).selectExpr("1L id", "0 piece", "0L start", "2L length", "7L ids_crc32")
    got = pk.pack(rows, 4).collect()
    assert len(got) == 9 and len({(r.sequence_id, r.offset) for r in got}) == 9 and {r.offset for r in got} == {0, 2}
    assert len({r.sequence_id for r in got}) == 5


def test_engine_panics_fall_back():
    text = " " * 1_500_000 + "x"
    encode = pk.Encoder(TOKENIZER)
    plain = encode.plain.encode(text, add_special_tokens=False).ids
    assert encode.encode(text) == plain
