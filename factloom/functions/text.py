"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "for", "on", "with")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters with marks and the plain letters they fold to, from the Unicode decompositions."""
    source, target = ["đ", "Đ"], ["d", "d"]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)).casefold()
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


def fold(text: Column | str) -> Column:
    """Lower case without marks: composed letters by table, combining marks dropped; ASCII text is only lowered."""
    source, target = _fold_table()
    column = F.col(text) if isinstance(text, str) else text
    full = F.regexp_replace(F.lower(F.translate(column, source, target)), r"[̀-ͯ]", "")
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(full)


def normalize_search(text: Column | str) -> Column:
    """Folded text with white space collapsed."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def clean(text: Column | str) -> Column:
    """Image tags, control characters and entity blanks out, white space collapsed and trimmed."""
    column = F.col(text) if isinstance(text, str) else text
    column = F.regexp_replace(column, r"(?i)<img\b[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        column = F.replace(column, F.lit(name), F.lit(char))
    column = F.regexp_replace(column, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(column, r"[\s ]+", " "))


def words(text: Column | str) -> Column:
    """Tokens of letters and digits of the folded text."""
    return F.filter(F.split(fold(text), r"[^a-z0-9]+"), lambda w: w != "")


def content_terms(text: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens without stop words, in order of first appearance."""
    return F.array_except(words(text), F.array(*[F.lit(w) for w in stopwords]))


def compact(text: Column | str) -> Column:
    return F.regexp_replace(fold(text), "[^a-z0-9]+", "")


def phrase_mentioned(text: Column, phrase: str) -> Column:
    """The phrase as whole words."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" ")).contains(f" {phrase} ")


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def strip_prefixes(name: Column, prefixes: tuple[str, ...]) -> Column:
    """A company name without the legal prefixes it starts with."""
    return F.trim(F.regexp_replace(name, "(?i)^((" + "|".join(prefixes) + r")\b\s*)+", ""))


def uid(*parts: Column) -> Column:
    """Deterministic id: first 16 hex digits of the hash of the parts, a missing part as ``None``."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 16)


def hierarchy(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "›"), lambda x: F.trim(x)), lambda x: x != "")


def csv_member(csv: Column, values: list[str]) -> Column:
    """Whether comma-separated text holds one of the values, as set membership."""
    return F.arrays_overlap(F.split(csv, ","), F.array(*[F.lit(v) for v in values]))


# ---- texts that were decoded wrongly

_WRONG = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(128, 256)}


@lru_cache(maxsize=1)
def _wrong_runs() -> re.Pattern[str]:
    """Runs of characters that bytes of UTF-8 sequences turn into when read as Windows-1252."""
    lead = "".join(c for c, b in _WRONG.items() if 0xC2 <= b <= 0xF4)
    rest = "".join(c for c, b in _WRONG.items() if b < 0xC0)
    return re.compile(f"(?:[{re.escape(lead)}][{re.escape(rest)}]{{1,3}})+")


def repaired(text: str, passes: int = 3) -> str:
    """Text with every run that was UTF-8 read as Windows-1252 read again, up to ``passes`` layers.

    A run changes only if its bytes are valid UTF-8 and what comes out holds no control characters; the rest
    of the text is never touched.
    """

    def again(match: re.Match[str]) -> str:
        now = match[0]
        for _ in range(passes):
            try:
                now = bytes(_WRONG[c] if c in _WRONG else ord(c) for c in now).decode()
            except (ValueError, UnicodeDecodeError):
                break
            if not any(c in _WRONG for c in now):
                break
        return match[0] if any(unicodedata.category(c) == "Cc" for c in now) else now

    for _ in range(passes):
        done = _wrong_runs().sub(again, text)
        if done == text:
            return done
        text = done
    return text


def repair_mojibake(text: Column) -> Column:
    """``repaired`` over Arrow batches; ASCII texts stay in the JVM."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else repaired(t))

    return F.when(F.octet_length(text) == F.length(text), text).otherwise(run(text))


# ---- labels and search expressions


def fact_label(text: Column | str) -> Column:
    """A row label without its leading number and without a formula in brackets behind it, folded to words."""
    column = fold(text)
    column = F.regexp_replace(column, r"^\s*(?:[ivx]+|[a-z]|\d+(?:\.\d+)*)\s*[.)/:-]+\s*", "")
    column = F.regexp_replace(column, r"\(\s*\d+\s*=[\d\s+().-]*\)\s*$", "")
    return F.trim(F.regexp_replace(column, r"[^a-z0-9]+", " "))


def fact_label_segments(path: Column | str, mark: str = "›") -> Column:
    """The labels of a path that are not empty."""
    column = F.col(path) if isinstance(path, str) else path
    return F.filter(F.transform(F.split(column, mark), fact_label), lambda s: s != "")


def match_expression(terms: Column) -> Column:
    """Terms as a search expression: each in quotes, any of them."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.nullif(F.array_join(quoted, " OR "), F.lit(""))


def without_terms(terms: Column, dropped: Column) -> Column:
    """Terms of a question without those of names that the filter has settled already."""
    return F.array_except(terms, dropped)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order and nulls written out."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(fields[k])), F.lit("[null]"))) for k in sorted(fields)]
    bare = [F.regexp_replace(p, r'^("[^"]*":)\[(.*)\]$', "$1$2") for p in parts]
    return F.concat(F.lit("{"), F.concat_ws(",", *bare), F.lit("}"))


def classify(text: Column | str, classes: list[tuple[str, tuple[str, ...]]], otherwise: str, least: int = 1) -> Column:
    """The class most of whose phrases a folded text holds, at least ``least``; the first in order on ties."""
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    scores = [(name, sum((F.contains(padded, F.lit(f" {p} ")).cast("int") for p in phrases), F.lit(0))) for name, phrases in classes]
    best = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    return F.coalesce(*[F.when((s == best) & (s >= least), F.lit(name)) for name, s in scores], F.lit(otherwise))
