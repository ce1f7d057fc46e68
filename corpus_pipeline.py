"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again
as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, language_id, line_dedup, near_dedup, packing
from factloom.llm.common import materialize, release, settled, written
from factloom.llm.queries import TOKENIZER

#: The stages' decisions rest on fitted centroids, signatures and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects and sets ``lang`` where it is null.

    Null, empty and letterless texts are rejected; long texts are read whole; equal texts share one fate, so
    repeated rows stay or go together; ties go to the first language in order; columns of any name pass
    through untouched; an empty table stays empty.
    """
    model = language_id.train(language_id.training_rows(docs))
    found = language_id.identify(docs, model).where("NOT rejected")
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    lang = F.coalesce(F.col("doc").getField("lang"), F.col("lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else x for c, x in zip(docs.columns, columns, strict=True)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines and long lines; documents of which nothing is left go.

    Null and empty texts stay as they are; long texts are read whole; rows with equal id and text are one
    place and keep the same lines; the earliest place is the smallest id (null first), then the position;
    ``text`` and ``n_chars`` change only where lines went; other columns of any name pass through; an empty
    table stays empty.
    """
    found = line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS)
    found = found.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    changed = F.col("n_removed") > 0
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    own["text"] = F.col("kept_text")
    own["n_chars"] = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(own["n_chars"])
    return found.select(*[own[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, shingled as in the registered query.

    It is the row with the smallest id (null ids last), of these the one with the smallest hash of its text;
    rows are judged by id and text together, so a repeated or null id takes no other text along.  Of rows
    equal in id and text one stays, whichever its other columns.  Null, empty and blank texts are near
    nothing; long texts are shingled whole; other columns of any name pass through; an empty table stays
    empty.
    """
    found = materialize(near_dedup.near_rows(docs), "near")
    counted = found.groupBy("id", "text_hash").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    odd = materialize(counted.where("NOT first OR n > 1"), "near-odd").withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    same = lambda x: docs.doc_id.eqNullSafe(x["_id"]) & (F.xxhash64(docs.text) == x["_hash"])
    again = odd.where("first").select("_id", "_hash")
    repeated = docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(odd, same(odd), "left_anti").unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds go.

    Null and empty texts have no words and stay; long texts are scanned whole; repeated rows share one fate;
    other columns of any name pass through; an empty table, or an empty benchmark, loses nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(spark, docs, benchmark)
    clean = found.where(~decontamination.contaminated(found))
    return clean.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences.

    Null and empty texts are the end token alone; long texts are cut into pieces; repeated rows are packed
    each; pieces of equal length and id take any order; other columns are left out; an empty table gives an
    empty table.
    """
    return packing.pack(packing.token_pieces(docs, TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what led to it removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before_last: tuple[str, ...] = ()
    for name, stage in STAGES:
        before = written()
        docs = settled(stage(spark, docs, sf_dir), name, before)
        release(spark, *before_last)
        before_last = (docs._written_path,)
    return docs
