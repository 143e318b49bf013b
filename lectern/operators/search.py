"""Retrieval inside a permitted scope: vectors, weighted terms, their fusion, and measures of quality."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import cosine, idf, shortened, similarity, term_pattern

MIN_SIMILARITY, FUSED_SIMILARITY, MIN_COVERAGE, BONUS, PER_DOCUMENT = 0.30, 0.45, 0.5, 0.10, 2


def in_scope(chunks: DataFrame, permitted: DataFrame) -> DataFrame:
    """FIL-01, RET-06: chunks of permitted documents; permitted has the ids (distinct) of readable, indexed, current ones."""
    return chunks.join(permitted.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def _blocks(dim: int, names: list[str], make: Callable[[np.ndarray, pa.RecordBatch], pa.RecordBatch | None]):  # noqa: ANN202
    """A scan over batches (names, vector): make() gets the vectors as one matrix of unit rows, those of another length or without a direction left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch.column(len(names))), dim).fill_null(False)
            batch = batch.filter(fits)
            flat = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
            solid = np.isfinite(norm) & (norm > 0)
            if not solid.all():
                batch, flat, norm = batch.filter(pa.array(solid)), flat[solid], norm[solid]
            if (out := make(flat / norm[:, None], batch)) is not None:
                yield out

    return run


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """chunk_id, document_id, raw: cosine of each vector with the query, a block of vectors at a time. Vectors of another length, or of length 0, have none and are left out."""
    q = np.array(query, np.float64)
    q = q / np.sqrt(q @ q)
    make = lambda unit, batch: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit @ q)], ["chunk_id", "document_id", "raw"])
    kinds = dict(vectors.dtypes)
    rows = vectors.select("chunk_id", "document_id", "vector")
    return rows.mapInArrow(_blocks(len(q), ["chunk_id", "document_id"], make), f"chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, raw double")


#: Bytes of the queries that go to all tasks at once; more are taken in blocks. Digits at which cosines count as equal.
QUERY_BYTES, DIGITS = 64 << 20, 9


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """TOP-01, RET-01 for many queries: query_id, chunk_id, document_id, similarity, rank_no of the k nearest vectors of each, ties by chunk.

    queries: query_id, vector; vectors: chunk_id, document_id, vector; ids are long. Both are unit rows of matrices: a task multiplies its blocks of
    vectors with all queries and keeps k candidates a query; those alone are shuffled and ranked. Queries that take over
    query_bytes are dealt into blocks by hash, each a scan of its own.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = size.dim or 1
    parts = max(1, -(-size.n * dim * 8 // query_bytes))
    found = [_nearest_block(vectors, queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, dim) for i in range(parts)]
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return reduce(DataFrame.union, found).withColumn("rank_no", order).filter(F.col("rank_no") <= k)


def _nearest_block(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    asked = queries.select("query_id", "vector").filter(F.size("vector") == dim).toArrow()
    ids = asked.column(0).to_numpy()
    q = asked.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    ids, q = ids[norm > 0], (q[norm > 0] / norm[norm > 0, None]).T.copy()
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q))
    names = ["query_id", "chunk_id", "document_id", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        least = np.full(len(ids), -2.0)
        best = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64)]  # query's place, chunk, document, cosine

        def make(unit: np.ndarray, batch: pa.RecordBatch) -> None:
            nonlocal best, least
            s = np.round(unit @ q, DIGITS)
            if len(s) >= k:
                least = np.maximum(least, np.partition(s, len(s) - k, axis=0)[len(s) - k])
            row, column = np.nonzero(s >= least)
            chunk, document = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            both = [np.concatenate(x) for x in zip(best, (column, chunk[row], document[row], s[row, column]), strict=True)]
            order = np.lexsort((both[1], -both[3], both[0]))
            both = [x[order] for x in both]
            first = np.searchsorted(both[0], both[0], side="left")
            place = np.arange(len(first)) - first
            best = [x[place < k] for x in both]
            last = place[place < k] == k - 1
            least[best[0][last]] = np.maximum(least[best[0][last]], best[3][last])

        for _ in _blocks(dim, names[1:3], make)(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), *map(pa.array, best[1:])], names)

    return vectors.select("chunk_id", "document_id", "vector").mapInArrow(run, "query_id long, chunk_id long, document_id long, similarity double")


def nearest(rows: DataFrame, limit: int) -> DataFrame:
    """The best of scored() rows as chunk_id, document_id, similarity: a top-k without a sort of all rows."""
    return rows.orderBy(F.desc("raw"), "chunk_id").limit(limit).select("chunk_id", "document_id", similarity(1 - F.col("raw")).alias("similarity"))


def vector_candidates(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """TOP-01: nearest by cosine, ties by chunk."""
    return nearest(scored(vectors, query), limit)


def capped(rows: DataFrame, *order: Column, per_document: int = PER_DOCUMENT, limit: int = 10) -> DataFrame:
    """WIN-04, WIN-05: at most per_document rows of a document in order, then the first limit, ranked from 1."""
    mine = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    best = rows.withColumn("mine", mine).filter(F.col("mine") <= per_document).drop("mine").orderBy(*order).limit(limit)
    return best.withColumn("rank_no", F.row_number().over(Window.orderBy(*order)))


def hits(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, document_id, hits: which of the terms a chunk's text matches, in order. All that frequencies and coverage need of a text.

    The text is lower-cased and cut into its words of a-z and 0-9 once; a term that is such a word is looked up among them - the same as
    its pattern, which wants it free of other such characters - and any other term is a pattern over the text.
    """
    word = re.compile("[a-z0-9]+").fullmatch
    found = lambda x: F.array(*[F.array_contains(x["words"], t) if word(t) else x["low"].rlike(term_pattern(t)) for t in terms])
    low = F.lower("chunk_text")
    parts = F.transform(F.array(low), lambda x: F.struct(x.alias("low"), F.split(x, "[^a-z0-9]+").alias("words")))
    return chunks.select("chunk_id", "document_id", F.element_at(F.transform(parts, found), 1).alias("hits"))


def term_frequencies(rows: DataFrame, terms: list[str]) -> DataFrame:
    """RET-02, JOIN-07, AGG-04: ord 0 with the number of chunks, then each term with the number of chunks it matches, 0 included. rows: see hits(). One pass."""
    counts = rows.agg(F.count("*").alias("n0"), *[F.count_if(F.get("hits", F.lit(i))).alias(f"n{i + 1}") for i in range(len(terms))])
    found = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("term"), F.col(f"n{i}").alias("matched")) for i, t in enumerate([None, *terms])])
    return counts.select(F.inline(found))


def weighted_terms(frequencies: DataFrame) -> DataFrame:
    """RET-03: ord, term, weight of terms that occur at all."""
    total = frequencies.filter("ord = 0").select(F.col("matched").alias("total"))
    return frequencies.filter("ord > 0 AND matched > 0").crossJoin(F.broadcast(total)).select("ord", "term", idf(F.col("total"), F.col("matched")).alias("weight"))


def coverage(rows: DataFrame, terms: list[str], weights: DataFrame) -> DataFrame:
    """AGG-11: chunk_id, document_id, coverage: share of the terms' weight that a chunk matches. rows: see hits(); weights: one row a term at most."""
    per = weights.agg(F.sum("weight").alias("whole"), *[F.coalesce(F.max(F.when(F.col("ord") == i + 1, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i in range(len(terms))])
    hit = reduce(lambda a, b: a + b, [F.when(F.get("hits", F.lit(i)), F.col(f"w{i}")).otherwise(F.lit(0.0)) for i in range(len(terms))], F.lit(0.0))
    return rows.crossJoin(F.broadcast(per)).select("chunk_id", "document_id", F.when(F.col("whole") > 0, F.round(hit / F.col("whole"), 6)).otherwise(F.lit(0.0)).alias("coverage"))


def lexical_candidates(covered: DataFrame, near: DataFrame, limit: int, least: float = MIN_COVERAGE) -> DataFrame:
    """RET-04, TOP-02, SET-05: the best by coverage, and all vector candidates that match any term."""
    best = covered.filter(F.col("coverage") >= least).orderBy(F.desc("coverage"), "chunk_id").limit(limit)
    return best.union(covered.filter("coverage > 0").join(near.select("chunk_id"), "chunk_id", "left_semi").select(*covered.columns)).distinct()


def fused(near: DataFrame, lexical: DataFrame, all_vectors: DataFrame, limit: int) -> DataFrame:
    """RET-05, JOIN-16, TOP-03: outer merge, thresholds, score = similarity + bonus x coverage, cap per document, top k.

    all_vectors: chunk_id, document_id, similarity of the scope, for lexical candidates beyond the vector ones.
    """
    lexical = lexical.join(all_vectors.select("chunk_id", F.col("similarity").alias("own")), "chunk_id", "left")
    both = near.alias("v").join(lexical.alias("l"), "chunk_id", "full_outer").select(
        "chunk_id", F.coalesce("v.document_id", "l.document_id").alias("document_id"), F.coalesce("v.similarity", "l.own", F.lit(0).cast("decimal(20,6)")).alias("similarity"), F.coalesce("l.coverage", F.lit(0.0)).alias("coverage"),
    )
    kept = both.filter((F.col("similarity") >= FUSED_SIMILARITY) | (F.col("coverage") >= MIN_COVERAGE))
    kept = kept.withColumn("score", F.round(F.col("similarity").cast("double") + BONUS * F.col("coverage"), 6))
    return capped(kept, F.desc("score"), F.desc("similarity"), F.col("chunk_id"), limit=limit)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """AGG-22: coverage, hit at 1 and 3, mean reciprocal rank over queries. ranked: query_id, item_id, rank_no; relevant: query_id, item_id."""
    first = relevant.join(ranked.filter(F.col("rank_no") <= k), ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("rank_no").alias("first"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return first.agg(share(F.col("first").isNotNull()).alias("found"), share(F.coalesce(F.col("first") <= 1, F.lit(False))).alias("hit1"), share(F.coalesce(F.col("first") <= 3, F.lit(False))).alias("hit3"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def recall(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """AGG-23: query_id, recall of two id lists (query_id, ids); null where nothing is expected."""
    e = F.array_distinct(F.col("expected"))
    return expected.withColumnRenamed("ids", "expected").join(actual.withColumnRenamed("ids", "actual"), "query_id", "left").select("query_id", F.when(F.size(e) > 0, F.round(F.size(F.array_intersect(e, F.coalesce("actual", F.array().cast("array<bigint>")))) / F.size(e), 6)).alias("recall"))


def context_text(turns: DataFrame, last: int = 2) -> DataFrame:
    """RET-08, WIN-07: conv_id, retrieval_text: the last user turns of a conversation, oldest first, one a line."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.filter("role = 'user'").withColumn("nth", nth).filter(F.col("nth") <= last)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("retrieval_text"))


def citations(ranked: DataFrame) -> DataFrame:
    """RET-09, RET-16: prompt lines of ranked candidates (query_id, rank_no, title, page_no, chunk_text), shortened to a share of the context."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    limit = F.least(F.lit(800), F.greatest(F.lit(1), F.floor(F.lit(3200) / F.col("n")))).cast("int")
    text = F.when(F.length("chunk_text") <= limit, F.col("chunk_text")).otherwise(F.concat(F.substring(F.col("chunk_text"), F.lit(1), limit - 1), F.lit("…")))
    page = F.coalesce(F.concat(F.lit(" p."), F.col("page_no").cast("string")), F.lit(""))
    line = F.concat(F.lit("["), F.col("rank_no").cast("string"), F.lit("] "), F.col("title"), page, F.lit(': "'), text, F.lit('"'))
    return ranked.withColumn("n", n).select("query_id", "rank_no", F.concat(F.lit("["), F.col("rank_no").cast("string"), F.lit("]")).alias("label"), line.alias("line"))


def clean_answer(answer: Column, phrase: str) -> Column:
    """RET-11: no answer where it begins with the phrase that says so; cut where the phrase comes later."""
    return F.when(F.startswith(F.trim(answer), F.lit(phrase)), F.lit(None).cast("string")).otherwise(F.trim(F.substring_index(answer, phrase, 1)))


def fallback_answer(text: Column, page: Column, limit: int = 300) -> Column:
    """RET-12: the top chunk's beginning with its page."""
    return F.concat(shortened(text, limit), F.coalesce(F.concat(F.lit(" (p."), page.cast("string"), F.lit(")")), F.lit("")))


def withheld(sources: Column, readable: Column) -> Column:
    """RET-13, SET-14: unless all sources are known and readable."""
    return F.coalesce(F.size(F.array_except(sources, readable)) > 0, F.lit(True))


def grouped_sources(rows: DataFrame) -> DataFrame:
    """AGG-17, JOIN-19: per document its chunks (each once), best score, and place by first rank."""
    each = rows.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.max("score").alias("best"), F.min("rank_no").alias("first_rank"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "document_id")))


def rechecked(ranked: DataFrame, readable: DataFrame) -> DataFrame:
    """RET-07: ranked candidates that a fresh look at the rights still allows, in the same order with new ranks (per query_id)."""
    rows = ranked.join(readable.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank_no")))


def prompts(questions: DataFrame, cited: DataFrame, history: DataFrame, instruction: str, closing: str, most: int = 600) -> DataFrame:
    """RET-09, RET-10: query_id, prompt: instruction, earlier turns, numbered citations, question.

    questions: query_id, question. cited: see citations(). history: query_id, turn, question, answer, each shortened to `most`.
    """
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))
    said = history.withColumn("n", turn).withColumn("part", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] Q: "), shortened(F.col("question"), most), F.lit("\nA: "), shortened(F.col("answer"), most), F.lit("\n")))
    joined = lambda d, order, text, name: d.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(name))
    lines = citations(cited).withColumn("part", F.concat("line", F.lit("\n")))
    rows = questions.join(joined(said, "n", "part", "earlier"), "query_id", "left").join(joined(lines, "rank_no", "part", "context"), "query_id", "left")
    earlier = F.coalesce(F.concat("earlier", F.lit("\n")), F.lit(""))
    return rows.select("query_id", F.concat(F.lit(instruction), earlier, F.coalesce("context", F.lit("")), F.lit("\nQuestion: "), "question", F.lit(closing)).alias("prompt"))


def capped_units(text: Column, most: int = 1000) -> Column:
    """RET-15: the first `most` UTF-16 units of text; a pair that the end would cut goes as a whole."""
    units = F.encode(text, "UTF-16BE")
    cut = F.substring(units, 1, 2 * most)
    split = F.hex(F.substring(cut, 2 * most - 1, 1)).rlike("^D[89AB]$")
    return F.when(F.octet_length(units) <= 2 * most, text).otherwise(F.decode(F.when(split, F.substring(units, 1, 2 * most - 2)).otherwise(cut), "UTF-16BE"))


def best_by_group(vectors: DataFrame, query: list[float], key: str) -> DataFrame:
    """AGG-12: for each group its best similarity to the query and its number of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.groupBy(key).agg(F.max(cosine(F.col("vector"), q)).alias("best"), F.count("*").alias("n"))
