"""Text, vector and JSON functions as Spark expressions, and the query term extractor."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean particles, longest first, and words that carry no content in a question.
PARTICLES = ("에서는", "으로는", "이라고", "에서", "으로", "까지", "부터", "이야", "이란", "란", "은", "는", "이", "가", "을", "를", "의", "와", "과", "도", "만", "에", "로", "야")
STOP_WORDS = frozenset("뭐 뭐야 어떻게 어디서 어느 어디 무슨 언제 왜 몇 얼마 어떤 뭐라고 알려줘 알려 돼 되 해 쓰는 거야 있어 방법 오늘 내일".split())


def query_terms(question: str | None) -> list[str]:
    """FN-04: content words of a question, in order, each once."""
    found: dict[str, None] = {}
    for token in re.findall(r"[^\s?!.,()]+", (question or "").lower()):  # a fixed value, as are the quotes: what parts words of a question
        word = token.strip("'\"`")
        word = next((word[: -len(p)] for p in PARTICLES if word.endswith(p) and len(word) - len(p) >= 2), word)
        if len(word) >= 2 and word not in STOP_WORDS:
            found[word] = None
    return list(found)


def term_pattern(term: str) -> str:
    """FN-05: regular expression of a term; a word of a-z and 0-9 must stand free of other such characters."""
    safe = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)
    return f"(^|[^a-z0-9]){safe}([^a-z0-9]|$)" if re.fullmatch("[a-z0-9]+", term) else safe  # a fixed value: what a word must be free of


def matches(text: Column, pattern: str) -> Column:
    """FIL-06: case-insensitive match; both sides are lower-cased, as dialects differ in folding beyond ASCII."""
    return F.lower(text).rlike(pattern)


def token_count(text: Column) -> Column:
    """FN-06: number of words between white space."""
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def shortened(text: Column, limit: int) -> Column:
    """FN-02: text of at most limit code points, the last an ellipsis where it was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def cosine(a: Column, b: Column) -> Column:
    """FN-18: cosine similarity of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(distance: Column) -> Column:
    """FN-15: 1 - distance, not below 0, rounded half up to six decimals."""
    return F.round(F.greatest(1 - distance, F.lit(0.0)).cast("decimal(20,12)"), 6)


def valid_vector(v: Column, dimension: int) -> Column:
    """FN-19/20: of the dimension, and all finite."""
    return (F.size(v) == dimension) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalised(v: Column) -> Column:
    """FN-22: v scaled to length 1."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def vector_text(v: Column) -> Column:
    """FN-21: [a,b,c]; parse_vector() reads it back."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_hash(v: Column | str) -> Column:
    """FN-09: SHA-256 over the big-endian 32-bit floats, a batch at a time: the numbers are swapped in one array, a row's hash is one call on its part of it."""

    def run(rows: pd.Series) -> pd.Series:
        sizes = [0 if x is None else 4 * len(x) for x in rows]
        held = [x for x in rows if x is not None]
        raw = memoryview(np.concatenate(held).astype(">f4").tobytes() if held else b"")
        ends = np.cumsum(sizes)
        return pd.Series([None if x is None else hashlib.sha256(raw[e - n : e]).hexdigest() for x, e, n in zip(rows, ends, sizes, strict=True)], dtype="object")

    return F.pandas_udf(run, "string")(v)


def framed_hash(*fields: Column) -> Column:
    """FN-08: SHA-256 of fields, each after its length in bytes as four big-endian bytes (-1 for null)."""
    size = lambda c: F.unhex(F.coalesce(F.lpad(F.hex(F.octet_length(c)), 8, "0"), F.lit("FFFFFFFF")))
    return F.sha2(F.concat(*[F.concat(size(c), F.coalesce(c.cast("binary"), F.lit("").cast("binary"))) for c in fields]), 256)


def heading_path(metadata: Column, title: Column) -> Column:
    """FN-26: headings of the JSON list as "a > b > c"; the title where there are none or the JSON is bad."""
    names = F.from_json(metadata, "headingPath array<string>")["headingPath"]
    return F.when(F.size(names) > 0, F.array_join(names, " > ")).otherwise(title)


def id_list(text: Column) -> Column:
    """FN-28: a JSON list of positive whole numbers, or null if any element isn't one."""
    raw = F.from_json(text, "array<string>")
    return F.when(F.forall(raw, lambda x: x.rlike("^[1-9][0-9]{0,18}$")), raw.cast("array<bigint>"))


def ids_text(ids: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(ids)))


def backoff(retries: Column, first_ms: int, most_ms: int) -> Column:
    """FN-16: first x 2^retries milliseconds, at most most."""
    return F.least(F.lit(float(first_ms)) * F.pow(F.lit(2.0), retries), F.lit(float(most_ms))).cast("long")


def jittered(delay: Column, unit: Column, spread: float, least: Column, most: int) -> Column:
    """FN-17: delay moved by up to spread of it each way (unit in 0..1), kept between least and most."""
    moved = F.round(delay * (1 + spread * (2 * unit - 1))).cast("long")
    return F.least(F.greatest(moved, least), F.lit(most))


def idf(total: Column, frequency: Column) -> Column:
    """FN-14: ln((N + 1) / (df + 0.5)) to ten decimals."""
    return F.round(F.log((total + 1) / (frequency + 0.5)), 10)
