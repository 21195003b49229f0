"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Every document is a bag of hashed n-grams, its whole words and pairs of neighbouring
words, as they are.  Two multinomials over ``buckets`` buckets are counted over all
documents: one of the trusted target, one of the whole raw corpus.  A document's score
is its mean log-likelihood ratio per n-gram; it is kept if it passes the base rules and
its score is at least the threshold.  Ratios are whole millionths, so sums do not depend
on the order of rows and the verdict is deterministic.

The threshold comes from labels that the target has no part in: a fifth of the trusted and
rejected ids, by crc32 of the id, is held out.  It is half way between the score that 99 of
100 held-out trusted documents reach and the one that 99 of 100 held-out rejected documents
stay below, among those that pass the base rules.  Without rejected ones it lies as far
below the former as that lies below the trusted median; without trusted ones all scores are
0 and nothing is below the threshold.

DataFrame functions only.  The table of ratios has ``buckets`` rows, whatever the corpus.
Counting sends each text once to its label; scoring shuffles nothing.

A null text has no words; a text without n-grams has score 0.  Null ids have no label; an
id that is both trusted and rejected is trusted; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import written

# The white space that separates words, and symbols that are counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS, SCALE = 1 << 17, 1_000_000
WINDOW, HELD_OUT = 8, 5


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text):
    """Words of a text column; none if it is null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def _joined(h: str, step: int):
    """Hashes of each element and the one ``step`` places on, of an array column of hashes."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def grams(docs: DataFrame) -> DataFrame:
    """``docs`` with ``h``, hashes of the words of ``text``, and ``pairs``, those of neighbouring words."""
    hashed = docs.withColumn("h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)))
    return hashed.withColumn("pairs", _joined("h", 1))


def _bucket(h, buckets: int):
    return h.bitwiseAND(buckets - 1).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row: the array of log-likelihood ratios by bucket, in whole millionths.  ``buckets``: a power of two."""
    # dealt by id at every size: no table of trusted ids goes to all tasks
    marked = docs.join(trusted.withColumn("good", F.lit(1)).hint("shuffle_hash"), "doc_id", "left")
    each = grams(marked).select("good", F.explode(F.concat("h", "pairs")).alias("h")).select("good", _bucket(F.col("h"), buckets).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    dense = docs.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    table = dense.agg(F.array_sort(F.collect_list(F.struct("id", count("raw"), count("target")))).alias("t"))
    total = lambda c: F.aggregate("t", F.lit(0).cast("long"), lambda n, s: n + s[c]).alias(f"{c}s")
    table = table.select("t", total("raw"), total("target"))
    ratio = lambda s: F.log((s["target"] + 1) / (F.col("targets") + buckets)) - F.log((s["raw"] + 1) / (F.col("raws") + buckets))
    known = F.transform("t", lambda s: F.round(ratio(s) * SCALE).cast("long"))
    return table.select(F.when(F.col("targets") > 0, known).otherwise(F.transform("t", lambda s: F.lit(0).cast("long"))).alias("ratios"))


def _threshold(scored: DataFrame, held: DataFrame) -> DataFrame:
    """One row: the threshold, in whole millionths, from the scores of held-out trusted (1) and rejected (0) documents."""
    # scores to a thousandth: exact percentiles of a bounded number of values
    known = scored.where(~F.col("base_failed")).join(held, "doc_id").select("good", F.round(F.col("score"), 3).alias("score"))
    part = lambda good, share: F.percentile(F.when(F.col("good") == good, F.col("score")), F.lit(share))
    at = known.agg(part(1, 0.01).alias("low"), part(1, 0.5).alias("middle"), part(0, 0.99).alias("high"))
    half = F.coalesce((F.col("low") + F.col("high")) / 2, 2 * F.col("low") - F.col("middle"), F.lit(float("-inf")))
    return at.select(half.alias("threshold"))


def rules(
    docs: DataFrame,
    trusted: DataFrame,
    rejected: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    labels = trusted.select(trusted[label_id_col].cast("long").alias("doc_id"), F.lit(1).alias("good"))
    labels = labels.union(rejected.select(rejected[label_id_col].cast("long").alias("doc_id"), F.lit(0).alias("good")))
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    table = ratios(docs, labels.where((F.col("good") == 1) & ~held).select("doc_id"), buckets).scalar()
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    rows = grams(docs).select(
        "doc_id",
        "h",
        "pairs",
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        table.alias("ratios"),
    )
    total = lambda known, h: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.get(known, _bucket(x, buckets)))
    # a subquery may stand in a lambda only once the optimizer has put it there; the table is never a row's column
    rows = rows.withColumn("fours", _joined("pairs", 2)).withColumn("sum", _let(F.col("ratios"), lambda known: total(known, "h") + total(known, "pairs"))).withColumn("n", F.size("h") + F.size("pairs")).drop("ratios")
    # a window found twice has its first four words twice
    again = F.size(F.array_distinct("fours")) < F.size("fours")
    scored = rows.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(again, _repeated(_joined("fours", 4))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("n") > 0, F.round(F.col("sum") / F.col("n") / SCALE, 9)).otherwise(F.lit(0.0)).alias("score"),
    )
    scored = written(scored.select("*", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed")))
    threshold = _threshold(scored, labels.where(held)).scalar()
    columns = [c for c in scored.columns if c not in ("base_failed", "score")]
    return scored.select(*columns, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def _repeated(windows):
    """Words that windows found twice or more cover, given the windows' hashes in order."""
    placed = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def twice(sorted_):
        same = lambda s, k: (F.get(sorted_, k)["h"] == s["h"])
        again = F.filter(sorted_, lambda s, k: F.coalesce(same(s, k - 1), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda s: s["k"]))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    add = lambda acc, k: F.struct((acc["total"] + k + WINDOW - F.greatest(acc["end"], k)).alias("total"), (k + WINDOW).alias("end"))
    return F.aggregate(_let(placed, twice), start, add, lambda acc: acc["total"])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op4_quality_rules, and ``score``."""
    return rules(docs, labels.where("quality = 1"), labels.where("quality = 0"))
