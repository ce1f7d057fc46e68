"""Full-text retrieval and ranking: inverted index, weighted BM25, score normalisation, structural bonuses, fusion."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx

K1, B = 1.2, 0.75
#: Bonus of each structural hit, and the multiplier of cards with few clean cells.
BONUSES = {"period": 0.35, "unit": 0.15, "statement": 0.10, "basis": 0.30, "code": 0.45}
CLEAN_FLOOR = 0.70


#: Query terms that are looked for inside each document's tokens; more of them meet the postings in a join.
LITERAL_TERMS = 2_000


def tokenized(df: DataFrame, uid: str, fields: list[str], only: DataFrame | None = None) -> DataFrame:
    """``uid, length, f0, f1, ..``: every text tokenised once, its length in tokens and the tokens of each field.

    For a single search, ``only`` (a table of ``term``) leaves other terms out where it is small.  What is
    stored or held of this serves both the index and the size of the corpus.
    """
    terms = None
    if only is not None:
        found = only.select("term").distinct().limit(LITERAL_TERMS + 1).collect()
        terms = [r.term for r in found] if len(found) <= LITERAL_TERMS else None
    kept = lambda w: w if terms is None else F.filter(w, lambda x: x.isin(terms) if terms else F.lit(False))
    once = lambda f: F.get(F.transform(F.array(tx.words(f)), lambda w: F.struct(F.coalesce(F.size(w), F.lit(0)).alias("n"), kept(w).alias("w"))), F.lit(0))
    split = df.select(F.col(uid).alias("uid"), *[once(f).alias(f"_{n}") for n, f in enumerate(fields)])
    sizes = [F.coalesce(F.col(f"_{n}.n"), F.lit(0)) for n in range(len(fields))]
    return split.select("uid", sum(sizes[1:], sizes[0]).alias("length"), *[F.col(f"_{n}.w").alias(f"f{n}") for n in range(len(fields))])


def postings(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """``uid, length, field, term, tf``: one row per term of a field, with the tokens of all fields of its document."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{n}").alias("words")) for n, f in enumerate(fields)])
    terms = tokens.select("uid", "length", F.inline(rows)).select("uid", "length", "field", F.explode("words").alias("term"))
    return terms.groupBy("uid", "length", "field", "term").agg(F.count("*").alias("tf"))


def inverted_index(df: DataFrame, uid: str, fields: list[str], only: DataFrame | None = None) -> DataFrame:
    """The postings of a table; stored, they serve any number of searches."""
    return postings(tokenized(df, uid, fields, only), fields)


def corpus_size(tokens: DataFrame) -> DataFrame:
    """``total, mean``: number of documents and their mean length in tokens."""
    return tokens.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))


def bm25(index: DataFrame, corpus: DataFrame, queries: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``query_id, uid, score`` for ``queries (query_id, term)``.

    ``idf = ln((N - n + 0.5) / (n + 0.5))``, at least 1e-6, over all documents; term frequencies are weighted
    by field.  Queries are distinct terms; postings of other terms never leave the index.
    """
    weight = F.element_at(F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))]), F.col("field"))
    terms = queries.select("query_id", "term").distinct()
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    weighted = wanted.groupBy("uid", "length", "term").agg(F.sum(F.col("tf") * weight).alias("wtf"))
    found = weighted.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    joined = weighted.join(found, "term").join(F.broadcast(corpus))
    scored = joined.select("uid", "term", (idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + norm)).alias("part"))
    return terms.join(scored, "term").groupBy("query_id", "uid").agg(F.sum("part").alias("score"))


def normalized(scores: DataFrame, by: str, kind: str = "minmax") -> DataFrame:
    """Scores of a pool on one scale: ``minmax`` (a constant pool is 0.5), ``rank`` (ties averaged, unmatched 0) or ``max``."""
    pool = Window.partitionBy(by)
    s = F.col("score")
    if kind == "minmax":
        low, high = F.min("score").over(pool), F.max("score").over(pool)
        return scores.withColumn("normal", F.when(high - low < 1e-9, 0.5).otherwise((s - low) / (high - low)))
    if kind == "max":
        high = F.max("score").over(pool)
        return scores.withColumn("normal", F.when(s > 0, s / high).otherwise(0.0))
    matched = Window.partitionBy(by, s > 0)
    place = F.rank().over(matched.orderBy(F.desc("score"))) - 1 + (F.count("*").over(Window.partitionBy(by, "score")) - 1) / 2
    return scores.withColumn("normal", F.when(s > 0, 1 - place / F.count("*").over(matched)).otherwise(0.0))


def structural(df: DataFrame, base: str, hits: dict[str, Column], clean_ratio: Column) -> DataFrame:
    """Base score plus the bonus of every hit, scaled by the share of clean cells, with the reasons."""
    bonus = sum((F.when(F.coalesce(h, F.lit(False)), BONUSES[k]).otherwise(0.0) for k, h in hits.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(h, F.lit(False)), F.lit(k)) for k, h in hits.items()]))
    score = (F.col(base) + bonus) * (CLEAN_FLOOR + (1 - CLEAN_FLOOR) * clean_ratio)
    return df.withColumns({"ranked": score, "reasons": reasons})


def top_k(df: DataFrame, by: str, score: str, uid: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(uid))
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def adaptive_cut(df: DataFrame, by: str, score: str, uid: str, least: int, margin: float, most: int) -> DataFrame:
    """The first ``least`` rows, then more while each stays within ``margin`` of the best; the first miss ends it."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(uid))
    rows = df.withColumns({"place": F.row_number().over(order), "best": F.first(score).over(order)})
    near = ((F.col("place") <= least) | (F.col(score) >= F.col("best") - margin)).cast("int")
    rows = rows.withColumn("open", F.min(near).over(order))
    return rows.where((F.col("open") == 1) & (F.col("place") <= most)).drop("best", "open")


def linear_rerank(df: DataFrame, features: dict[str, float], name: str = "rerank") -> DataFrame:
    return df.withColumn(name, sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in features.items()), F.lit(0.0)))


def scope_filter(cards: DataFrame, entities: list[str] | None, years: tuple[int, int] | None, basis: str | None, slack: int = 1) -> DataFrame:
    """The hard filter: entities, years up to ``slack`` beyond the last, and the basis or none at all."""
    out = cards
    if entities:
        out = out.where(F.col("entity").isin(entities))
    if years:
        out = out.where(F.col("year").between(years[0], years[1] + slack))
    if basis:
        out = out.where(F.col("basis").isNull() | (F.col("basis") == basis))
    return out


def match_metric(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``label, metric, strength``: raw exact 4, folded exact 3, prefix 2; the longest alias wins ties.

    Exact matches are equi-joins on two keys; prefixes meet on the label's leading word runs, so labels never
    meet every alias.
    """
    own = labels.select("label", F.lower("label").alias("raw"), tx.normalize_search("label").alias("folded"))
    known = aliases.select("alias", "metric", F.lower("alias").alias("alias_raw"), tx.normalize_search("alias").alias("alias_folded"))
    exact_raw = own.join(known, F.col("raw") == F.col("alias_raw")).select("label", "metric", "alias", F.lit(4).alias("strength"))
    exact = own.join(known, F.col("folded") == F.col("alias_folded")).select("label", "metric", "alias", F.lit(3).alias("strength"))
    tokens = F.split("folded", " ")
    heads = own.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))).alias("head"))
    prefix = heads.join(known, F.col("head") == F.col("alias_folded")).select("label", "metric", "alias", F.lit(2).alias("strength"))
    union = exact_raw.unionByName(exact).unionByName(prefix)
    order = Window.partitionBy("label").orderBy(F.desc("strength"), F.desc(F.length("alias")), "metric")
    return union.withColumn("place", F.row_number().over(order)).where("place = 1").select("label", "metric", "strength")
