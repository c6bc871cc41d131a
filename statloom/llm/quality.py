"""Quality rules in DataFrame functions only: base rules, then a hashed n-gram log-likelihood ratio.

Words are runs of anything but ASCII white space. Word unigrams and bigrams are hashed into ``BUCKETS`` buckets.
Two multinomials over the buckets are counted: one from trusted texts, one from all texts (the raw corpus). Both are
smoothed by ``PSEUDO`` counts at the size of the trusted set, so that a bucket with little evidence weighs little,
however small the corpus is. A document's score is the mean, over its n-grams, of log p_trusted - log p_raw; it is
kept if the score reaches ``threshold``. Bucket weights are rounded to integers (millionths), so sums are exact and verdicts do not
depend on the order of rows or on the number of partitions.

The raw counts cover every row, the trusted counts every row with a trusted id. Trusted ids are counted first: few of them are
broadcast and documents are not shuffled; more than ``BROADCAST_IDS`` are merge-joined by id. The weights reach the rows as one scalar subquery, an array of
``BUCKETS`` integers; documents are never shuffled.

Defined results: a null text has no words; wordless texts fail the base rules; a null id is never trusted; with no
trusted text at all every weight is zero and only the base rules decide; repeated rows are judged each for itself;
a very long text is judged whole, in one row; a score equal to the threshold keeps; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PSEUDO = 20.0
#: Up to this many trusted ids (8 bytes each, if they are numbers) are broadcast; more meet the documents in a merge join.
BROADCAST_IDS = 1_000_000
#: Mean log-likelihood ratio that a kept document must reach.
THRESHOLD = -0.15
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rows(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), *more)
    rows = rows.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    return rows.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))


def _buckets() -> Column:
    """Buckets of all unigrams and bigrams."""
    one = F.transform("wh", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice("wh", 1, F.greatest(F.size("wh") - 1, F.lit(0))), F.slice("wh", 2, F.greatest(F.size("wh") - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def repeated_words(hashes: str, k: int = WINDOW) -> Column:
    """Number of words that lie in a k-word window found twice or more."""
    n = F.size(hashes)
    windows = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)])))

    def covered(sorted_windows: Column) -> Column:
        h = lambda i: F.get(sorted_windows, i)["h"]
        twice = F.filter(sorted_windows, lambda s, i: F.coalesce(s["h"] == h(i - 1), F.lit(False)) | F.coalesce(s["h"] == h(i + 1), F.lit(False)))
        return _let(F.sort_array(F.transform(twice, lambda s: s["i"])), lambda at: F.aggregate(F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(k))), F.lit(k), lambda s, x: s + x))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    return F.coalesce(_let(windows, lambda w: F.when(w.isNotNull(), count(w))), F.lit(0)).cast("long")


def bucket_counts(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, raw, target: n-gram counts of all texts and of the trusted ones. trusted: a column doc_id."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = ids.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_in")).hint("broadcast" if few else "merge")
    # the words are split after the join, so that only texts are ever shuffled
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = (texts if few else texts.where("doc_id is not null")).join(marked, F.col("doc_id") == F.col("_id"), "left")
    if not few:  # rows without an id would meet in one task
        rows = rows.unionByName(texts.where("doc_id is null"), allowMissingColumns=True)
    rows = _rows(rows.select("_in", "doc_id", "t"), "doc_id", "t", "_in")
    grams = rows.select(F.coalesce("_in", F.lit(0)).alias("is_in"), F.explode(_buckets()).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_in").cast("long").alias("target"))


def bucket_weights(counts: DataFrame) -> str:
    """The weight of each bucket in millionths, comma-joined. BUCKETS numbers, whatever the corpus."""
    every = counts.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    full = every.join(counts.withColumn("bucket", F.col("bucket").cast("long")), "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("r"), F.sum("target").alias("t"))

    def weight(c: Column) -> Column:
        ratio = F.log((c["target"] + PSEUDO) / (c["raw"] * F.col("t") / F.col("r") + PSEUDO))
        return F.when(F.col("t") > 0, F.round(ratio * 1_000_000)).otherwise(0).cast("int").cast("string")

    return one.select(F.array_join(F.transform("all", weight), ",")).first()[0]


def assess(docs: DataFrame, weights: str, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base figures, score and verdict per row of docs, with its other columns."""
    others = [c for c in docs.columns if c not in (doc_id,)]
    packed = docs.select(F.col(doc_id), F.col(text).cast("string").alias(text), F.struct(*[F.col(c) for c in others]).alias("_rest"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = packed.select(F.col(doc_id).alias("doc_id"), "_rest", t.alias("t"), F.array_remove(F.split(t, SPACE), "").alias("words"))
    rows = rows.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    dup = _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    n = F.size("words").cast("long")
    table = F.split(F.lit(weights), ",").cast("array<int>")  # folded to one constant array when the plan is optimized
    total = F.aggregate(_buckets(), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    out = rows.select(
        "doc_id",
        "_rest",
        n.alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        repeated_words("wh").alias("n_repeat_words"),
        F.when(n > 0, total / (1_000_000.0 * (2 * n - 1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold))


def rules(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """assess() with weights counted from docs themselves."""
    return assess(docs, bucket_weights(bucket_counts(docs, trusted, doc_id=doc_id, text=text)), doc_id=doc_id, text=text, threshold=threshold)


def keep(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of docs that rules() keeps, with the columns of docs.

    The row number holds the filter above the projection: pushed below, every figure would be computed twice.
    """
    doc_id = options.get("doc_id", "doc_id")
    judged = rules(docs, trusted, **options).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return judged.select([F.col("doc_id").alias(c) if c == doc_id else F.col("_rest")[c].alias(c) for c in docs.columns])
