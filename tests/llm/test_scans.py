"""Licence scan, token counts, decontamination and media against brute force."""

import random
import re

import pytest

import public_tokenizers

from factloom.llm import decontamination as dc
from factloom.llm import license_scan as ls
from factloom.llm import media
from factloom.llm import token_counts as tc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_license_scan_matches_brute_force(spark, odd_rows):
    rng = random.Random(1)
    parts = [*ls.PHRASES, "cc by", "nc", "the", "Apache", "License,", "VERSION", "2.0", "MIT", "under", "é", "\n"]
    rows = [(100 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(14))), "en", "s", 1) for i in range(60)]
    rows += [r for r in odd_rows if r[0] not in (None, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.scan_licenses(df).collect()}
    assert got == {r[0]: ls.brute_force(r[1]) for r in rows}


def test_license_templates_survive_edits(spark):
    text = "x y " + ls.TEMPLATES[0][1].replace("free of charge", "free of any charge") + " z"
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = spark.createDataFrame([(1, text), (2, gpl), (3, "this work is under")], "doc_id bigint, text string")
    got = {r.id: r for r in ls.scan_licenses(rows).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].spans[0].start == 2
    assert got[2].labels == "gpl-3" and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score < ls.COVERAGE


def test_scans_take_odd_tables(spark, odd, empty, clashing):
    bench = spark.createDataFrame([(1, None), (None, "ein wort")], "item_id bigint, text string")
    for make in (
        ls.scan_licenses,
        lambda d: tc.token_counts(d, VOCABULARY),
        media.media_columns,
        lambda d: dc.find_contamination(spark, d, bench),
    ):
        assert make(empty).count() == 0
        assert make(odd).count() == make(clashing).count() == odd.count()


def greedy(pieces, word):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return 1
        word, n = word[size:], n + 1
    return n


def test_token_counts_match_naive_greedy(spark, odd_rows):
    rng = random.Random(2)
    for _ in range(200):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        counter = tc.PieceCounter(sorted(pieces))
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
            assert counter.count(word) == greedy(pieces, word), (pieces, word)
    pieces = set(tc.read_vocabulary(VOCABULARY))
    rows = [r for r in odd_rows if r[0] not in (None, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.id: (r.n_words, r.n_tokens) for r in tc.token_counts(df, VOCABULARY).collect()}
    for row in rows:
        each = [greedy(pieces, b" " + w) for w in (row[1] or "").encode().split()]
        assert got[row[0]] == (len(each), sum(each))


def naive_hits(text, items, width=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            window = own[i : i + width]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    names.add(str(name))
    return len(words), len(hit), names


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["The", "of", "an,", "re", "tion"]) for _ in range(n))
    items = [(n, prose(rng.choice([0, 1, 3, 13, 14, 30]))) for n in range(12)] + [(99, None), (100, "!!")]
    texts = [None, "", "."] + [prose(rng.randrange(60)) for _ in range(30)]
    texts += [prose(5) + " " + items[n][1].upper() + " " + prose(5) for n in range(12)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {n: naive_hits(t, items) for n, t in enumerate(texts)}
    for size, held in ((dc.AUTOMATON_BYTES, dc.HELD_BYTES), (200, dc.HELD_BYTES), (200, 100)):  # one automaton, then several in turn
        monkeypatch.setattr(dc, "AUTOMATON_BYTES", size)
        monkeypatch.setattr(dc, "HELD_BYTES", held)
        for r in dc.find_contamination(spark, docs, bench).collect():
            assert (r.n_words, r.n_hit, set(r["items"])) == want[r.doc.doc_id]
            for hit, span in zip(r.hits, r.spans, strict=True):
                words = dc.ascii_words(r.doc.text.encode()[span.start : span.end])
                assert len(words) == hit.end - hit.start


@pytest.mark.parametrize("width", [1, 2, 4, 5, 13])
def test_scanner_matches_every_window(width):
    rng = random.Random(width)
    for _ in range(150):
        words = rng.choice([b"a", b"a b", b"a b c d"]).split()
        say = lambda n: [rng.choice(words) for _ in range(n)]
        items = [(str(n), say(rng.randrange(3 * width))) for n in range(4)]
        text = say(rng.randrange(8 * width)) + rng.choice(items)[1] + [b"x"] + say(rng.randrange(2 * width))
        hit, names = set(), set()
        for name, own in items:
            size = min(width, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for at in range(len(text) - size + 1):
                if tuple(text[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    names.add(name)
        spans, found = dc.WindowScanner([(n, b" ".join(w)) for n, w in items], width).scan(text)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == names


def test_media_round_trip(spark, odd_rows):
    rng = random.Random(4)
    rows = [(n, rng.randbytes(n).decode("latin-1")) for n in (0, 1, 287, 288, 575, 576, 577, 40_000)] + [(-1, None)]
    for r in media.media_columns(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = dict(rows)[r.id]
        raw = (text or "").encode()
        want = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert bytes(r.payload) == want and r.n_bytes == len(raw) and len(r.media) % 188 == 0
        assert r.stamps == [i * media.FRAME_TICKS for i in range(len(want) // 576)]
        assert all(r.media[at] == media.SYNC for at in r.random_access)


def bits(data, at, n):
    """``n`` bits of a packet from bit ``at`` on, as a number."""
    return int("".join(f"{b:08b}" for b in data)[at : at + n], 2)


def crc_bit_by_bit(data):
    register = [1] * 32
    for byte in data:
        for k in range(7, -1, -1):
            turn = register.pop(0) ^ (byte >> k & 1)
            register.append(0)
            register = [r ^ (turn & p) for r, p in zip(register, map(int, f"{0x04C11DB7:032b}"), strict=True)]
    return register


def demuxed(stream):
    """Payload, stamps, clocks and flagged frames of a transport stream, read bit by bit and without the operator's reader."""
    assert len(stream) % 188 == 0
    counters, sections, units, marks = {}, {}, [], []
    pmt = es = None
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert bits(packet, 0, 8) == 0x47 and bits(packet, 8, 1) == 0 and bits(packet, 24, 2) == 0
        starts, pid, control, counter = bits(packet, 9, 1), bits(packet, 11, 13), bits(packet, 26, 2), bits(packet, 28, 4)
        assert control in (1, 3) and counters.setdefault(pid, counter) == counter
        counters[pid] = (counter + 1) % 16
        rest, flagged, clock = packet[4:], 0, None
        if control == 3:
            size = rest[0]
            field, rest = rest[1 : 1 + size], rest[1 + size :]
            if size:
                flagged = bits(field, 1, 1)
                used = 1
                if bits(field, 3, 1):
                    clock = bits(field, 8, 33) * 300 + bits(field, 47, 9)
                    used += 6
                assert set(field[used:]) <= {0xFF}
        if pid == 0 or pid == pmt:
            assert starts
            section = rest[1 + rest[0] :]
            size = bits(section, 12, 12) + 3
            section, filler = section[:size], section[size:]
            assert not any(crc_bit_by_bit(section)) and set(filler) <= {0xFF}
            if pid == 0:
                assert section[0] == 0 and bits(section, 64, 16) == 1
                pmt = bits(section, 83, 13)
            else:
                assert section[0] == 2 and section[12] == 0x06
                es = bits(section, 107, 13)
        elif pid == es:
            if starts:
                units.append(b"")
                marks.append((at, flagged, clock))
            units[-1] += rest
    payload, stamps = b"", []
    for unit in units:
        assert unit[:4] == b"\x00\x00\x01\xbd" and int.from_bytes(unit[4:6], "big") == len(unit) - 6
        assert bits(unit, 48, 2) == 2 and bits(unit, 56, 2) == 2 and unit[8] == 5
        assert [bits(unit, 72, 4), bits(unit, 79, 1), bits(unit, 95, 1), bits(unit, 111, 1)] == [2, 1, 1, 1]
        stamps.append(bits(unit, 76, 3) << 30 | bits(unit, 80, 15) << 15 | bits(unit, 96, 15))
        payload += unit[14:]
    return payload, stamps, marks


@pytest.mark.parametrize("size", [0, 1, 576, 577, 12_000])
def test_streams_by_an_independent_demuxer(spark, size):
    text = "".join(chr(97 + n * 7 % 26) for n in range(size))
    row = media.media_columns(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    payload, stamps, marks = demuxed(bytes(row.media))
    assert payload == bytes(row.payload) == text.encode().ljust(max(1, -(-size // 576)) * 576, b"\xff")
    assert stamps == row.stamps == [n * 576 * 90_000 // 8_000 for n in range(len(payload) // 576)]
    assert [at for at, flagged, _ in marks if flagged] == row.random_access
    assert [clock for _, flagged, clock in marks if flagged] == [300 * s for s in stamps[::16]]
    assert all((clock is not None) == bool(flagged) for _, flagged, clock in marks)


def test_media_reader_reports_damage():
    stream = media.write_stream(media.padded(b"abc" * 2000))
    lost = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.read_stream(stream).breaks == 0
    assert media.read_stream(lost).breaks > 0
    bad = bytearray(stream)
    bad[20] ^= 1
    assert media.read_stream(bytes(bad)).bad_tables == 1
