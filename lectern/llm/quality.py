"""Quality rules: distribution divergence from language references.

A document's histogram over classes of characters, and its histogram over the common words of its language, are
held against the means of all documents of that language by Jensen-Shannon distance (base 2, so 0 to 1). A document
that lies too far off is rejected. Guards leave short documents alone: a distance counts only from a minimum number
of characters or words on, and only against a reference of a minimum number of documents. Means are sums of whole
parts per million, so that reruns and any order of addition agree. Texts are measured once, into a table of counts and
histograms; means and verdicts read that table.

Defined results: null or empty text has no words and fails the base rule. A language without a list of common words,
or a null one, is measured by characters alone, against all such documents together. Repeated rows are judged one by
one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, documents, let, table, words, written

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is was for that on with at from are or this",
    "de": "der die und das in den von zu ist für sich des auf im ein als",
    "es": "de la que el en y los del se las por un para con una su",
    "fr": "de la le et les des en un du une que est pour dans par sur",
}
OTHER = "other"
#: Classes of characters; all that no pattern counts are lower-case or uncased letters and the like.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{N}", "space": r"[\x20\x09-\x0D]", "stop": r"[.,;:?'\"()\-]", "sign": r"[^\p{L}\p{N}\x20\x09-\x0D.,;:?'\"()\-]"}
SYMBOLS = r"[#*$%&|<>]"

#: Limits of the distances. A sample of n words strays from its own source by a distance of about 1/sqrt(n).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.28, 0.16, 1.15
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 250, 40, 20
PPM = 1_000_000


def _ppm(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda n: F.floor(n * F.lit(PPM) / total))


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with the words, the language and both histograms in parts per million.

    class_ppm is null without characters, word_ppm without words or without a list of common words.
    """
    most = max(len(v.split()) for v in COMMON_WORDS.values())
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.xxhash64(F.lit(w)) for w in v.split()]))])
    step = docs.withColumn("words", words("text")).withColumn("language", _language(F.col("lang")))
    chars = F.length("text")
    counts = [F.regexp_count("text", F.lit(p)).cast("long") for p in CLASSES.values()]
    step = step.withColumns({"chars": chars, "counts": F.array(*counts), "n_words": F.size("words").cast("long"), "common": lists[F.col("language")], "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    hits = [F.coalesce(F.size("hashes") - F.size(F.array_remove("hashes", F.get("common", F.lit(i)))), F.lit(0)).cast("long") for i in range(most)]
    step = step.withColumns({"counts": F.concat("counts", F.array(F.col("chars") - total("counts"))), "hits": F.array(*hits)})
    step = step.withColumn("hits", F.when(F.col("common").isNotNull(), F.concat("hits", F.array(F.col("n_words") - total("hits")))))
    return step.withColumns({"class_ppm": F.when(F.col("chars") > 0, _ppm(F.col("counts"), F.col("chars"))), "word_ppm": F.when(F.col("n_words") > 0, _ppm(F.col("hits"), F.col("n_words")))}).drop("counts", "hits", "common")


def references(facts: DataFrame) -> DataFrame:
    """One row a language (those with a list, and one for all others): sums of both histograms over all documents."""
    bins = {"class": len(CLASSES) + 1, "word": 1 + max(len(v.split()) for v in COMMON_WORDS.values())}
    sums = [F.array(*[F.coalesce(F.sum(F.get(f"{k}_ppm", F.lit(i))), F.lit(0)) for i in range(n)]).alias(f"{k}_reference") for k, n in bins.items()]
    return facts.groupBy("language").agg(*sums, F.count("class_ppm").alias("class_docs"), F.count("word_ppm").alias("word_docs"))


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, both of a sum above 0; bins that one lacks count as 0."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).cast("double")
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(p: Column, q: Column) -> Column:
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    both = F.arrays_zip(F.transform(counts, lambda x: F.coalesce(x, F.lit(0)) / total(counts)).alias("p"), F.transform(reference, lambda x: x / total(reference)).alias("q"))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + term(F.coalesce(x["p"], F.lit(0.0)), F.coalesce(x["q"], F.lit(0.0)))), F.lit(0.0)))


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more, from the array of the words' hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))), F.lit(0).cast("long"), lambda x, y: x + y)

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"])
        at = let(ordered, lambda s: F.sort_array(F.array_compact(F.transform(s, lambda e, k: F.when(same(s, e, k), e["i"])))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(at, covered))

    return F.when(F.size(hashes) < n, F.lit(0).cast("long")).otherwise(let(windows(hashes), count))


def quality(docs: DataFrame, *keep: str, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, noise: float = WORD_NOISE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Per row of docs: row (a struct of the columns named in keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The references have a row for each language in COMMON_WORDS and one
    for the rest - five rows at any size - and so are broadcast.
    """
    docs = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = measured(docs).select(
        "row", "language", "chars", "class_ppm", "word_ppm", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("hashes")).alias("n_repeat_words"),
    )
    facts = written(docs.sparkSession, facts)
    far = facts.join(F.broadcast(references(facts)), "language", "left")
    off = lambda k, low, most, size: (size >= low) & (F.col(f"{k}_docs") >= min_reference) & (divergence(F.col(f"{k}_ppm"), F.col(f"{k}_reference")) > most)
    rejected = off("class", min_chars, F.lit(max_class), F.col("chars")) | off("word", min_words, max_word + noise / F.sqrt("n_words"), F.when(F.col("language") != OTHER, F.col("n_words")))
    out = far.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    kept = ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))
    return out.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _sql() -> str:
    """The same in DuckDB; doc_id is unique there."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lists = " ".join(f"WHEN {quoted(k)} THEN [{', '.join(map(quoted, v.split()))}]" for k, v in COMMON_WORDS.items())
    known = ", ".join(map(quoted, COMMON_WORDS))
    classes = ", ".join(f"len(regexp_extract_all(t, {quoted(p)}))" for p in CLASSES.values())
    bins = 1 + max(len(v.split()) for v in COMMON_WORDS.values())
    mean = lambda k, n: "[" + ", ".join(f"sum({k}[{i + 1}])" for i in range(n)) + "]"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(z[1] / list_sum({p}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) / 2 ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(z[2] / list_sum({q}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) / 2 ELSE 0 END)), 0))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '{OTHER}' END AS language FROM documents),
w AS (SELECT doc_id, language, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS w, CASE language {lists} END AS common, [{classes}] AS c FROM d),
h AS (SELECT *, list_append(c, length(t) - list_sum(c)) AS cs, list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))) AS hs FROM w),
m AS (SELECT *, CASE WHEN length(t) > 0 THEN list_transform(cs, lambda x: (x * {PPM}) // length(t)) END AS class_ppm,
             CASE WHEN len(w) > 0 THEN list_transform(list_append(hs, len(w) - list_sum(hs)), lambda x: (x * {PPM}) // len(w)) END AS word_ppm FROM h),
r AS (SELECT language, {mean("class_ppm", len(CLASSES) + 1)} AS class_reference, {mean("word_ppm", bins)} AS word_reference, count(class_ppm) AS class_docs, count(word_ppm) AS word_docs FROM m GROUP BY language),
g AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
e AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
k AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM e WHERE n > 1) GROUP BY doc_id),
s AS (SELECT m.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
             len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(length(t) >= {MIN_CHARS} AND class_docs >= {MIN_REFERENCE} AND {js("class_ppm", "class_reference")} > {MAX_CLASS_DISTANCE}, false)
             OR coalesce(len(w) >= {MIN_WORDS} AND m.language <> '{OTHER}' AND word_docs >= {MIN_REFERENCE} AND {js("word_ppm", "word_reference")} > {MAX_WORD_DISTANCE} + {WORD_NOISE} / sqrt(len(w)), false) AS rejected
      FROM m LEFT JOIN r USING (language) LEFT JOIN k ON m.doc_id = k.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected AS kept
FROM s
"""


OP4_SQL = _sql()


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), "doc_id").select("row.doc_id", "*").drop("row")
