"""Line dedup by winnowing over line hashes, in DataFrame functions only.

In every window of ``RUN`` consecutive lines the smallest line hash, the rightmost of equal ones, is
selected; the selected positions are a document's fingerprints, and any run of ``RUN`` lines or more that
two places share has a fingerprint in common.  Positions meet by fingerprint, and those that stand alone
go.  From a shared fingerprint the match is extended to the left and to the right, over the windows it was
selected for, by comparing the lines themselves through SHA-256 digests, never through the 64-bit
hashes; extents of neighbouring fingerprints join into maximal runs.  Every line of an extent that stands
at an earlier place too (smaller document id, or further up in the same document) is deleted.  Where
``long_words`` is given, a single line of more words is a fingerprint and a run of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Lines of the shortest run that is deleted, and of the winnowing window.
RUN = 2
#: A single line of more words than this is a passage of its own.
LONG_WORDS = 50


def _lines(text):
    return F.split(text, "\n", -1)


def _line_hash(line):
    return F.xxhash64(line)


def _is_long(line, words: int):
    return (F.length(line) > 2 * words) & line.rlike(rf"^\s*+(?:\S++\s++){{{words}}}\S")


def _windows(docs: DataFrame, id_col: str, text_col: str, run: int, long_words: int | None) -> DataFrame:
    """``id, text_hash, lines, hashes, windows``: for every window its first line ``at``, its lines ``n`` and the line ``pick`` that it selects.

    Windows of blank lines only are left out.
    """
    least = run if long_words is None else 1
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _lines(F.col(text_col)).alias("lines")
    ).where(F.size("lines") >= least)
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    low = lambda i: F.least(*[F.get("hashes", i + n) for n in range(run)]) if run > 1 else F.get("hashes", i)
    last = lambda i, m: F.coalesce(*[F.when(F.get("hashes", i + n) == m, i + n) for n in reversed(range(run))])
    filled = lambda i: reduce(lambda a, b: a | b, [F.trim(F.get("lines", i + n)) != "" for n in range(run)])
    starts = F.when(F.size("lines") >= run, F.sequence(F.lit(0), F.size("lines") - run)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(F.filter(starts, filled), lambda i: F.struct(i.alias("at"), F.lit(run).alias("n"), last(i, low(i)).alias("pick")))
    if long_words is not None:
        long = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _is_long(F.get("lines", i), long_words))
        windows = F.concat(windows, F.transform(long, lambda i: F.struct(i.alias("at"), F.lit(1).alias("n"), i.alias("pick"))))
    return rows.withColumn("windows", windows)


def _shared_fingerprints(rows: DataFrame) -> DataFrame:
    """``fingerprint``: the line hashes that windows select at two places or more."""
    picks = F.array_distinct(F.transform("windows", lambda w: w["pick"]))
    place = F.struct("id", "text_hash", "pick")
    named = F.transform(picks, lambda p: F.struct(p.alias("pick"), F.get("hashes", p).alias("fingerprint")))
    found = rows.select("id", "text_hash", F.inline(named))  # no array travels along, or every row would copy its document
    return found.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("fingerprint")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """``id, text_hash, gone``: the positions of deleted lines of each document that has some."""
    rows = _windows(docs, id_col, text_col, run, long_words)
    # What is written and read again deals both sides of a join anew, so that a hot line's partition can be split.
    shared = materialize(_shared_fingerprints(rows), "line-fingerprints")
    digest = lambda w: F.unhex(F.sha2(F.array_join(F.slice("lines", w["at"] + 1, w["n"]), "\n").cast("binary"), 256))
    extent = lambda w: F.struct(w["at"].alias("at"), w["n"].alias("n"), F.get("hashes", w["pick"]).alias("fingerprint"), digest(w).alias("digest"))
    extents = rows.select("id", "text_hash", F.inline(F.transform("windows", extent)))
    extents = materialize(extents.join(shared, "fingerprint", "left_semi"), "line-extents")
    place = F.struct("id", "text_hash", "at")
    firsts = (
        extents.groupBy("digest", "n")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("digest", "n", "first")
    )
    later = extents.join(materialize(firsts, "line-runs"), ["digest", "n"]).where(place > F.col("first"))
    return later.groupBy("id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + (F.col("n") - 1)))))).alias("gone")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` as ``doc``, then ``n_lines``, ``n_removed``, ``n_runs`` and ``kept_text``.

    A null text has no lines and stays null, an empty one is one blank line; windows of blank lines only
    never count; documents shorter than ``run`` lines stay whole, but for lines of more than ``long_words``
    words, which are runs of their own where that is given; rows with equal id and text are one
    place, so repeated rows keep what each of them alone would keep; null ids come before all others; very
    long texts are read whole, as arrays of their lines; columns of ``docs`` may have any names, as they
    travel inside ``doc``; an empty table gives an empty table.
    """
    gone = repeated_lines(docs, id_col, text_col, run, long_words).withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    text = F.col("doc").getField(text_col)
    rows = rows.join(
        gone, F.col("doc").getField(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left"
    )
    rows = rows.select("doc", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), _lines(text).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    whole = F.size("gone") == 0
    return rows.select(
        "doc",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_removed"),
        F.size(F.array_except("gone", F.transform("gone", lambda p: p + 1))).cast("bigint").alias("n_runs"),
        F.when(whole, F.col("doc").getField(text_col))
        .otherwise(F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n"))
        .alias("kept_text"),
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line AS one, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM lines
), real AS (
  SELECT * FROM windows WHERE two IS NOT NULL AND (trim(one, ' ') <> '' OR trim(two, ' ') <> '')
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, pos) AS place FROM real
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1)) AS v(d) WHERE place > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS is_gone,
         coalesce(lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS before
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE is_gone) AS n_removed,
         count(*) FILTER (WHERE is_gone AND NOT before) AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
       coalesce(p.n_runs, 0)::BIGINT AS n_runs, sha256(p.kept) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""
