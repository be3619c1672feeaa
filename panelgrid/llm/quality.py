"""Quality rules: base counts and a hashed n-gram likelihood ratio, in built-in functions only.

Two multinomials over hashed words and word pairs are counted, one over the documents labelled as
good, one over all documents. A document's score is the mean of log p(good) - log p(all) over its
n-grams; documents at or above the threshold are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm.common import narrow, pin

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _pairs(values: Column, n: Column, step: int) -> Column:
    """Hash of each value with the one ``step`` places on; the others have no partner."""
    kept = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), kept), F.slice(values, F.lit(1 + step), kept),
                      lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame) -> DataFrame:
    """Adds n_words, and 64-bit hashes of words (w1) and of word pairs (w2)."""
    return (docs.withColumn("words", words_of(F.col("text")))
            .withColumn("n_words", F.size("words"))
            .withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("w2", _pairs(F.col("w1"), F.col("n_words"), 1)))


def ngram_buckets(buckets: int) -> Column:
    """Bucket of every word and word pair."""
    return F.transform(F.concat("w1", "w2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, good_ids: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row: ``ratios``, the array of log p(good) - log p(all) by bucket.

    Counts are summed on the map side; ``buckets`` bounds the rows that are shuffled. ``docs`` may
    hold an id more than once, each row counts. A bucket that neither side has gets ratio 0 up to
    smoothing. Without good documents every ratio is 0. ``good_ids`` must be bounded: it is broadcast.
    """
    marked = docs.join(F.broadcast(good_ids.withColumn("good", F.lit(1))), "doc_id", "left") \
        if good_ids is not None else docs.withColumn("good", F.lit(None).cast("int"))
    counts = (hashed(marked).select(F.coalesce("good", F.lit(0)).cast("long").alias("good"),
                                    F.explode(ngram_buckets(buckets)).alias("bucket"))
              .groupBy("bucket").agg(F.count("*").alias("c_all"), F.sum("good").alias("c_good")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0)
    rows = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "c_all", "c_good")))
                      .alias("rows"), F.sum("c_all").alias("n_all"), F.sum("c_good").alias("n_good"))
    part = lambda c, n: F.log((c + smoothing) / (n + smoothing * buckets))
    return rows.select(F.transform("rows", lambda x: F.when(
        F.col("n_good") > 0, part(x["c_good"], F.col("n_good")) - part(x["c_all"], F.col("n_all")))
        .otherwise(F.lit(0.0))).alias("ratios"))


def _window_places() -> Column:
    """(hash, place) of all eight-word windows in order of the hash; empty if no window repeats."""
    repeats = F.size(F.array_distinct("w8")) < F.size("w8")
    return F.when(repeats, F.sort_array(F.transform(
        "w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array())


def _repeated_starts() -> Column:
    """Sorted places of windows whose hash has an equal neighbour; get() is null beyond the ends."""
    places = F.col("places")
    equal = lambda x, i: x["h"] == F.get(places, i)["h"]
    return F.sort_array(F.filter(F.transform(
        places, lambda x, i: F.when(equal(x, i - 1) | equal(x, i + 1), x["i"])),
        lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words covered by windows at sorted starts."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(s - acc["last"], F.lit(WINDOW))).alias("n"),
                                s.alias("last")),
        lambda acc: acc["n"])


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines and n_repeat_words to ``hashed`` documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (docs
            .withColumn("word_chars", F.char_length(F.regexp_replace(text, SPACE, "")))
            .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)))
            .withColumn("lines", lines)
            .withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")))
            .withColumn("w4", _pairs(F.col("w2"), F.size("w2"), 2))
            .withColumn("w8", _pairs(F.col("w4"), F.size("w4"), 4))
            .withColumn("places", _window_places())
            .withColumn("n_repeat_words", _covered(_repeated_starts())))


def _scored(own: DataFrame, labels: DataFrame | None, buckets: int, threshold: float,
            smoothing: float, max_trusted: int) -> DataFrame:
    """Adds all counts, base_failed, score and kept to (doc_id, text, ...)."""
    good = None if labels is None else \
        (labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
         .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted))
    model = pin(log_ratios(own.select("doc_id", "text"), good, buckets, smoothing), "quality-ratios")
    # a scalar subquery: the array, of fixed size, becomes a constant of the plan
    ratios = model.select("ratios").scalar()
    total = F.aggregate(ngram_buckets(buckets), F.lit(0.0),
                        lambda acc, b: acc + F.get(F.col("ratios"), b))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words").cast("long") > MAX_REPEATED * F.col("n_words").cast("long"))
    return (base_counts(hashed(own)).withColumn("ratios", ratios)
            .withColumn("score", F.when(F.col("n_words") > 0,
                                        total / (F.size("w1") + F.size("w2"))).otherwise(0.0))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))


def quality_rules(docs: DataFrame, labels: DataFrame | None, buckets: int = 1 << 14,
                  threshold: float = -0.2, smoothing: float = 1.0, max_trusted: int = 1 << 16,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    labels: (doc_id, quality); documents labelled 1 anywhere are the trusted target, ``max_trusted``
    of them at most, those of smallest hashed id; the other side counts every document. Nulls and
    empty texts have no words, fail the base rules and score 0; rows that repeat are counted and
    judged each; without a trusted document every score is 0; an empty table gives no rows.
    """
    scored = _scored(narrow(docs, id_col, text_col), labels, buckets, threshold, smoothing,
                     max_trusted)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts],
                         "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame | None, buckets: int = 1 << 14,
              threshold: float = -0.2, smoothing: float = 1.0, max_trusted: int = 1 << 16,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      F.struct("*").alias("row"))
    scored = _scored(own, labels, buckets, threshold, smoothing, max_trusted)
    # the row number keeps the filter above the projections; pushed below, it would repeat them all
    numbered = scored.withColumn("at", F.monotonically_increasing_id())
    return numbered.filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")


def load_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
