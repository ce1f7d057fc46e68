"""Line dedup against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import line_dedup as ld

SCHEMA = "doc_id bigint, text string"


def brute(rows, run=2):
    """``id -> kept text``: lines of windows that stand at an earlier place go."""
    first, gone = {}, {}
    places = sorted(((n, i) for n, t in rows if t is not None for i in range(len(t.split("\n")) - run + 1)))
    texts = dict(rows)
    for n, i in places:
        window = tuple(texts[n].split("\n")[i : i + run])
        if not any(x.strip(" ") for x in window):
            continue
        if first.setdefault(window, (n, i)) != (n, i):
            gone.setdefault(n, set()).update(range(i, i + run))
    return {n: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(n, ())) for n, t in rows}


@pytest.mark.parametrize("run", [1, 2, 3])
def test_matches_a_plain_loop(spark, run):
    rng = random.Random(run)
    lines = ["a", "b", "c c", "d", "", " ", "é"]
    rows = [(n * 7 % 101, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for n in range(60)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "one")]
    found = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA), run=run).collect()
    assert {r.doc.doc_id: r.kept_text for r in found} == brute(rows, run)
    for r in found:
        assert r.n_lines - r.n_removed == (0 if r.kept_text is None or r.n_lines == r.n_removed else len(r.kept_text.split("\n")))
        assert (r.n_runs == 0) == (r.n_removed == 0) and r.n_runs <= r.n_removed


def test_repeated_rows_are_one_place(spark, odd, empty, clashing):
    twice = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "a\nb")], SCHEMA)
    assert sorted((r.doc.doc_id, r.kept_text) for r in ld.dedup_lines(twice).collect()) == [(1, "a\nb"), (1, "a\nb"), (2, "")]
    assert ld.dedup_lines(empty).count() == 0
    got = {str(r.doc.doc_id): r.kept_text for r in ld.dedup_lines(odd).collect()}
    assert got["1"] is None and got["7"] == "" and got["6"] != ""
    assert ld.dedup_lines(clashing).count() == odd.count()


def test_no_python_in_the_plan(spark, odd, capsys):
    ld.dedup_lines(odd).explain()
    assert "Python" not in capsys.readouterr().out


def test_a_long_line_between_lines_of_its_own_is_a_passage(spark):
    say = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    long, short = say("l", 51), say("s", 50)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{short}"), (3, long), (4, f"e\n{short}\n{long}\n{long}"), (5, short), (6, "a\nc"), (7, None), (8, "")]
    want = {1: rows[0][1], 2: f"c\nd\n{short}", 3: "", 4: f"e\n{short}", 5: short, 6: "a\nc", 7: None, 8: ""}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc.doc_id: r.kept_text for r in ld.dedup_lines(df, long_words=ld.LONG_WORDS).collect()} == want
    assert {r.doc.doc_id: r.kept_text for r in ld.dedup_lines(df).collect()} == brute(rows)


@pytest.mark.parametrize("run", [2, 4])
def test_windows_select_few_fingerprints_that_shared_runs_have_in_common(spark, run):
    rng = random.Random(9)
    shared = [f"shared {i}" for i in range(run)]
    rows = []
    for n in range(2):
        own = [f"{n} {rng.random()}" for _ in range(200)]
        rows.append((n, "\n".join(own[:100] + shared + own[100:])))
    windows = ld._windows(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", run, None)
    picks = [{w.pick for w in r.windows} for r in windows.collect()]
    assert all(len(p) < 0.8 * (200 + run) for p in picks)
    assert any(100 <= p < 100 + run for p in picks[0] & picks[1])
    assert ld._shared_fingerprints(windows).count() >= 1


@pytest.mark.parametrize("run", [2, 3])
def test_colliding_hashes_delete_nothing(spark, monkeypatch, run):
    monkeypatch.setattr(ld, "_line_hash", lambda line: F.lit(7).cast("bigint") + F.length(line) % 2)
    rng = random.Random(run)
    rows = [(n, "\n".join(rng.choice(["a", "b", "c c", "d", "é é"]) for _ in range(rng.randrange(1, 7)))) for n in range(30)]
    found = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA), run=run).collect()
    assert {r.doc.doc_id: r.kept_text for r in found} == brute(rows, run)
