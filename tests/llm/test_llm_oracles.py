"""The SQL of the training-data queries on small rows, where SQL can express them."""

import random

import duckdb
import pytest

from factloom.llm import queries

ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a few documents that share passages, lines and benchmark items."""
    rng = random.Random(6)
    words = "The of and in re tion ing er on an was über straße niño".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    passages = [say(25) for _ in range(4)]
    rows = []
    for n in range(60):
        lines = [say(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 4))]
        for p in passages:
            if rng.random() < 0.3:
                lines.insert(rng.randrange(len(lines) + 1), p)
        rows.append((n, "\n".join(lines), "en", "s", 1))
    rows += [(100 + n, rows[n][1], "en", "s", 1) for n in range(5)] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    items = [(n, p) for n, p in enumerate(passages)] + [(10, "Short item"), (11, None), (12, rows[3][1])]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet/*.parquet'")
    df = queries.queries()[name](spark, small)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    want = found.fetchall()
    assert got == sorted(map(repr, want))
