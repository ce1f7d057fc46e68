"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams; every
language has a few centroids, clustered from a bounded sample of its labelled texts;
the nearest centroid by cosine names the language, and a text farther from it than nearly
all training texts with as many different grams is rejected.  Document frequencies cover
all labelled texts.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, field_bytes, sliced

DIMENSIONS = 8192
GRAMS = 3
#: Labelled texts per language that the centroids are fitted on (the documented bound of the fit).
SAMPLE = 600
CLUSTERS = 4
ROUNDS = 12
#: A text is rejected below the cosine that this share of the training texts of its band misses, less a margin that
#: shrinks with the root of their number; their cosines are taken to centroids of the other half.
MISSES = 0.004
#: No text is accepted below this cosine, however short.
FLOOR = 0.02
#: Half octaves of the number of different grams, and the training texts that a band needs for a bound of its own.
BANDS = 2 * 14
BAND_LEAST = 20
UNKNOWN = "und"
CHUNK = 1 << 20

_MIX = np.uint32(2654435761)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_counts(text: bytes) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams inside words (a 0 marks a word's edge), and the number of letters."""
    codes = _letters()[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")]
    codes = np.concatenate(([np.uint32(0)], codes, [np.uint32(0)]))
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]  # runs of other characters become one edge
    total = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - int(math.log2(DIMENSIONS)))
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + GRAMS - 1]
        mixed = part * _MIX
        rolled = mixed
        for size in range(1, GRAMS + 1):
            if size > 1:
                rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(2246822519) + mixed[size - 1 :]
            own = rolled[: min(len(rolled), CHUNK)]
            bucket = (own * np.uint32(3266489917)) >> shift
            if size == 1:
                bucket = bucket[part[: len(own)] != 0]
            total += np.bincount(bucket, minlength=DIMENSIONS)
    return total, int(np.count_nonzero(codes))


@dataclass
class Model:
    """Centroids (rows), their languages, inverse document frequencies and the least cosine by band."""

    labels: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: list[float]

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return normalised(counts, self.idf)

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, bool]]:
        """Language, cosine and rejection of each row."""
        if not len(self.labels):
            return [(UNKNOWN, 0.0, True)] * len(counts)
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        bands = band(np.count_nonzero(counts, axis=1))
        out = []
        for row, n in enumerate(letters):
            if not n:
                out.append((UNKNOWN, 0.0, True))
                continue
            score = float(min(1.0, max(0.0, cosines[row, best[row]])))
            out.append((self.labels[best[row]], score, score < max(FLOOR, self.least[bands[row]])))
        return out


def band(grams: np.ndarray) -> np.ndarray:
    """The band of each number of different grams; texts that only repeat themselves fall among short ones."""
    return np.minimum(BANDS - 1, 2 * np.log2(np.maximum(grams, 1))).astype(int)


def unseen_cosines(vectors: np.ndarray) -> np.ndarray:
    """Each text's cosine to centroids that were fitted without it, on the other half of the sample."""
    half = np.arange(len(vectors)) % 2 == 0
    out = np.ones(len(vectors), np.float32)
    if len(vectors) > 1:
        for own in (half, ~half):
            out[own] = (vectors[own] @ clustered(vectors[~own], CLUSTERS).T).max(axis=1)
    return out


def least_cosines(bands: np.ndarray, cosines: np.ndarray) -> list[float]:
    """The least accepted cosine by band, from training texts of the band, of the next ones too where it has few, or as in the band below."""
    out: list[float] = []
    for number in range(BANDS):
        near = next((own for width in (0, 1, 2) if len(own := cosines[np.abs(bands - number) <= width]) >= BAND_LEAST), None)
        if near is None:
            out.append(out[-1] if out else 0.0)
        else:
            out.append((1 - len(near) ** -0.5) * float(np.sort(near)[int(MISSES * len(near))]))
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts, dtype=np.float32) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def clustered(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same input gives the same centroids."""
    mean = vectors.mean(axis=0)
    seeds = [int((vectors @ mean).argmax())]
    nearest = vectors @ vectors[seeds[0]]
    while len(seeds) < min(clusters, len(vectors)):
        far = int(nearest.argmin())
        if nearest[far] > 0.999999:
            break
        seeds.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    centroids = vectors[seeds]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on ``labelled``: document frequencies over all its rows, centroids on about ``sample`` texts a label.

    Rows with a null text or label are left out; without any row the model knows no language and
    predicts ``und``.
    """
    rows = labelled.select(
        F.col(label_col).alias("label"),
        F.col(text_col).cast("binary").alias("body"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("draw"),
    ).where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), [0.0] * BANDS)

    def frequencies(batches):
        seen, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text)[0] > 0
                texts += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array([texts, *seen.tolist()], pa.int64())], names=["bucket", "texts"])

    counted = rows.select("body").mapInArrow(frequencies, "bucket int, texts bigint").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    seen = {r.bucket: r.texts for r in counted.collect()}
    idf = np.array([math.log((1 + seen[-1]) / (1 + seen[b])) + 1 for b in range(DIMENSIONS)], np.float32)

    share = {label: min(1.0, 1.2 * sample / n) for label, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for label, s in share.items() for x in (label, int(s * (1 << 30)))])

    def vectors(batches):
        for batch in sliced(batches):
            found = [gram_counts(text) for text in batch.column(1).to_pylist()]
            packed = [np.stack([(at := np.flatnonzero(c)), c[at]]).astype("<i4").tobytes() for c, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary()), pa.array([n for _, n in found], pa.int64())],
                names=["label", "draw", "counts", "letters"],
            )

    drawn = rows.where(F.col("draw") < F.element_at(limits, F.col("label")))
    drawn = drawn.mapInArrow(vectors, "label string, draw bigint, counts binary, letters bigint").collect()
    labels, centroids, bands, cosines = [], [], [], []
    for label in sorted(sizes):
        own = sorted((r.draw, bytes(r.counts)) for r in drawn if r.label == label and r.letters)[:sample]
        if not own:
            continue
        counts = np.zeros((len(own), DIMENSIONS), np.int32)
        for row, (_, packed) in enumerate(own):
            at, times = np.frombuffer(packed, "<i4").reshape(2, -1)
            counts[row, at] = times
        x = normalised(counts, idf)
        found = clustered(x, CLUSTERS)
        labels += [label] * len(found)
        centroids.append(found)
        bands.append(band(np.count_nonzero(counts, axis=1)))
        cosines.append(unseen_cosines(x))
    if not labels:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), idf, [0.0] * BANDS)
    return Model(labels, np.concatenate(centroids), idf, least_cosines(np.concatenate(bands), np.concatenate(cosines)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as the struct ``doc``, then ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Null, empty and letterless texts are ``und`` with score 0 and rejected; very long texts are read whole,
    in chunks; equal texts give equal results; of equal cosines the first label in order wins; columns of
    ``docs`` may have any names, as they travel inside ``doc``; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, 64):
            found = [gram_counts(text or b"") for text in field_bytes(batch, text_col)]
            out = held.value.predict(np.stack([c for c, _ in found]), np.array([n for _, n in found]))
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, extended(rows, ["doc"], "lang_pred string, score double, rejected boolean"))


def held_out(id_col):
    """Rows never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(docs.doc_id) & docs.lang.isNotNull())
