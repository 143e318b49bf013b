"""Token counts with a whole-token shortcut.

Byte-level BPE splits a text by a pattern into pre-tokens and merges inside each of them alone, so a text's count is
the sum of its pre-tokens' counts. Offline - once a worker, from the vocabulary file alone - each vocabulary string
is proven to be one pre-token that encodes as one token; such a pre-token counts 1 by a look-up. Only the rest is
merged by the library, once for each different pre-token in a bounded memo.

The pattern is run by the `regex` module, whose character classes may follow another Unicode version than the
library's. So the shortcut takes only texts made of the scripts whose every code point was proven to be classed
alike (Latin, Greek, Cyrillic, general punctuation and currency signs) and free of the tokenizer's special strings; any other text is encoded whole by the library.

Defined results: null and empty text have 0 bytes and 0 tokens. Repeated rows are counted one by one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, table, vocabulary

# Fixed value: the pattern by which byte-level BPE of this kind splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the ranges in which both libraries' classes were compared one by one.
UNPROVEN = r"[^\x00-\x1b\x20-\u052f\u2010-\u205e\u20a0-\u20bf]"
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts as the tokenizer file at `path` has them, without added special tokens."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.split, self.unproven = regex.compile(PATTERN).findall, regex.compile(UNPROVEN).search
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        self.single = self.proven()
        self.memo: dict[str, int] = {}

    def proven(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        alphabet, found = byte_alphabet(), []
        for token in self.whole.get_vocab(with_added_tokens=False):
            try:
                text = bytes(alphabet[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not self.unproven(text) and not self.special(text) and self.split(text) == [text]:
                found.append(text)
        coded = self.whole.encode_batch_fast(found, add_special_tokens=False)
        return {t: 1 for t, e in zip(found, coded, strict=True) if len(e) == 1}

    def merged(self, part: str) -> int:
        if (n := self.memo.get(part)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = len(self.whole.encode(part, add_special_tokens=False))
            if len(part) < 64:
                self.memo[part] = n
        return n

    def count(self, text: str) -> int:
        if self.unproven(text) or self.special(text):
            return len(self.whole.encode(text, add_special_tokens=False))
        parts = self.split(text)
        known = list(map(self.single.get, parts))
        if None not in known:
            return len(known)
        memo, merged, n = self.memo, self.merged, 0
        for part, one in zip(parts, known, strict=True):
            n += one or memo.get(part) or merged(part)
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One a worker process, so that its memo serves all tasks there."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, folder: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = documents(docs, "doc_id", "text").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
