"""Near-dedup against all pairs on small fixtures, and its parts."""

import random

import numpy as np
import pytest

from factloom.llm import near_dedup as nd
from factloom.llm.common import blank_words

SCHEMA = "doc_id bigint, text string"


def brute(rows, size, threshold=80):
    """``id -> (n_shingles, component)`` by comparing all pairs."""
    sets = [(name, nd.shingles(blank_words((text or "").encode()), size)) for name, text in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                parent[root(i)] = root(j)
    low = {}
    for i, (name, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), name), name)
    return {name: (len(x), low[root(i)]) for i, (name, x) in enumerate(sets)}


def result(df):
    return {r.id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("size", [2, 5])
def test_matches_all_pairs(spark, size):
    rng = random.Random(size)
    rows = []
    for group in range(25):
        base = [rng.choice("the of and in re tion ing er on an".split()) + str(rng.randrange(60)) for _ in range(rng.choice([3, 12, 80, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rng, base, rng.choice([0, 1, 2, len(base) // 30, len(base) // 12])))))
    rows += [(2001, None), (2002, ""), (2003, " \t"), (2004, "one"), (2005, "ONE"), (2006, "two words")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(nd.near_duplicates(df, size=size)) == brute(rows, size)


def test_star_of_copies_that_only_their_source_links(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))] + [(n, " ".join(edited(rng, base, 20))) for n in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 2)
    assert len({c for _, c in want.values()}) < 10
    assert result(nd.near_duplicates(df, size=2)) == want


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(11)]  # 10 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[:8] + ["z", "y"]))]
    got = result(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2))
    assert got == {1: (10, 1), 2: (8, 1), 3: (9, 3)} == brute(rows, 2)


def test_odd_tables(spark, odd, empty, clashing):
    got = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in nd.near_duplicates(odd).collect())
    assert len(got) == odd.count()
    by = {(r[0], r[3]) for r in got}
    assert {("6", True), ("7", False), ("8", True), ("1", True), ("None", True)} <= by
    again = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in nd.near_duplicates(clashing).collect())
    assert got == again
    assert nd.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame(chain + star + [(300, 299)], "a bigint, b bigint")
    got = {r.node: r.label for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {299: 299, 300: 299}


def join_rows(spark, since):
    """Rows that all joins of executions after ``since`` put out, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    made, last = 0, since
    listed = store.executionsList()
    for one in (listed.apply(k) for k in range(listed.size())):
        at = one.executionId()
        last = max(last, at)
        if at <= since:
            continue
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made, last


def test_a_dense_crowd_is_joined_with_labels_once(spark):
    rng = random.Random(8)
    links = list({tuple(sorted(rng.sample(range(400), 2))) for _ in range(6000)})
    _, since = join_rows(spark, -1)
    got = {r.node: r.label for r in nd.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(400), 0)
    made, _ = join_rows(spark, since)
    assert 2 * len(links) <= made < 3 * len(links)


def test_components_of_random_links(spark):
    """Sparse and dense parts, stars around their largest node, loops and links given twice and both ways."""
    for seed in range(3):
        rng = random.Random(seed)
        links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(1000 + k, 2000) for k in range(50)] + [(7, 7), (9000, 9000)]
        links += [(b, a) for a, b in links[:20]] + links[:20]
        low = {n: n for link in links for n in link if link[0] != link[1]}
        for _ in low:
            for a, b in links:
                if a != b:
                    low[a] = low[b] = min(low[a], low[b])
        got = nd.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
        assert {r.node: r.label for r in got} == low and len(got) == len(low)
    assert nd.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_more_links_join_components_as_all_links_do(spark):
    rng = random.Random(5)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    fresh = [(rng.randrange(90), rng.randrange(90)) for _ in range(25)]
    table = lambda rows: spark.createDataFrame([(min(r), max(r)) for r in rows if r[0] != r[1]], "a bigint, b bigint")
    want = {r.node: r.label for r in nd.components(table(first + fresh)).collect()}
    got = nd.joined_components(nd.components(table(first)), table(fresh)).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def paths_of(rows):
    """Paths whose first bytes are given and whose rest differs by row."""
    out = np.zeros((len(rows), nd.PATH_BYTES), np.uint8)
    for n, head in enumerate(rows):
        out[n, 7 : 7 + len(head)] = head
        out[n, 7 + len(head) :] = n
    return out


def both_ways(left, right):
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    return {*pairs, *((b, a) for a, b in pairs)}


def test_pivot_follows_the_heaviest_path():
    tree = np.zeros(6, np.int32)
    paths = paths_of([(1, 1, 1, 1), (1, 1, 1, 2, 2), (1, 1, 1, 2, 2), (1, 1, 1, 5), (1, 1, 1, 6), (1, 2, 1, 1)])
    node = np.array([10, 11, 12, 13, 14, 15])
    left, right, region, pivot, weight, _ = nd.region_candidates(tree, paths, node)
    assert list(region) == [0] * 5 + [1] and list(pivot) == [11, 15] and len(weight) == 2
    assert {(10, 11), (12, 11), (13, 11), (14, 11), (13, 14)} <= both_ways(left, right)


def test_depth_adapts_to_the_region(monkeypatch):
    tree = np.zeros(4, np.int32)
    paths = np.full((4, nd.PATH_BYTES), 9, np.uint8)
    paths[1, 8] = 10  # agrees on the first values only, and on most of the rest
    paths[2:, 7] = 10
    paths[3, 8:] = 77  # agrees on the first values and nothing else
    left, right, region, *_ = nd.region_candidates(tree, paths, np.arange(4))
    assert both_ways(left, right) == {(0, 1), (1, 0)} and len(set(region.tolist())) == 4
    monkeypatch.setattr(nd, "CROWD", 2)
    crowd = paths_of([(1, 1, 1, 4)] * 3 + [(1, 1, 1, 7, k // 2) for k in range(6)])
    left, right, *_, handed = nd.region_candidates(np.zeros(9, np.int32), crowd, np.arange(9))
    assert {(n, n + 1) for n in range(8)} | {(n, 3) for n in (0, 1, 2, 5, 7)} <= both_ways(left, right)
    assert np.flatnonzero(handed).tolist() == [0, 1, 2, 3, 5, 7]


def test_sets_that_share_half_a_digest_stay_apart(spark, monkeypatch):
    real = nd.set_digest
    monkeypatch.setattr(nd, "set_digest", lambda h: (real(h) >> 64 << 64) | (real(h) & 3))
    rng = random.Random(3)
    rows = []
    for n in range(40):
        base = [f"g{n}w{i}" for i in range(60)]
        rows += [(len(rows) + k, " ".join(edited(rng, base, 2 * k))) for k in range(2)]
    assert result(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2)) == brute(rows, 2)


def test_boundaries_lose_no_region(spark):
    """One region over many partitions still meets its pivot."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set(coalesce, "false")
    try:
        rng = random.Random(4)
        base = [f"w{i}" for i in range(200)]
        rows = [(n, " ".join(edited(rng, base, 4))) for n in range(60)]
        assert result(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2)) == brute(rows, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset(coalesce)


def test_the_one_link_out_of_a_crowd_below_the_threshold(spark):
    """Copies that are alike but not enough so, and some pairs among them that just are."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(edited(rng, base, 24))) for n in range(150)]
    rows += [(1000 + n, " ".join(edited(rng, rows[n][1].split(), 15))) for n in range(0, 150, 6)]
    want = brute(rows, 2)
    assert len({c for _, c in want.values()}) > 100
    assert result(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2)) == want


def test_links_between_single_nodes_of_a_large_crowd(spark):
    """Thousands of documents from one pool, nearly all apart, and a few links that no tree need put side by side."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    rows = [(n, " ".join(edited(rng, base, 7))) for n in range(3000)]
    rows += [(10_000 + n, " ".join(edited(rng, rows[n][1].split(), 6))) for n in range(0, 3000, 10)]
    sets = [nd.shingles(blank_words(t.encode()), 2) for _, t in rows]
    names = {s: i for i, s in enumerate(set().union(*sets))}
    both = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, len(names), 2048):
        dense = np.zeros((len(rows), 2048), np.float32)
        for i, own in enumerate(sets):
            at = [names[s] - start for s in own if start <= names[s] < start + 2048]
            dense[i, at] = 1
        both += dense @ dense.T
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (sizes[:, None] + sizes - both)
    low = np.array([i for i, _ in rows])
    while True:
        fallen = np.where(linked, low, 1 << 40).min(axis=1)
        if (fallen == low).all():
            break
        low = fallen
    want = {i: (len(s), int(c)) for (i, _), s, c in zip(rows, sets, low, strict=True)}
    assert result(nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2)) == want
