"""Quality rules with adaptive thresholds [native: DataFrame functions only].

Each document gets its statistics in one pass, without a shuffle. For every
language and source, mergeable quantile sketches of five rates are built with
map-side partial aggregation, so a source with a third of all rows sends its bucket counts
once a task. The sketches give the quartiles, and these the fences: a rate further
than ``SPREADS`` interquartile ranges beyond the outer quartile is an outlier. A
document is kept if it passes the base rules and no rate is an outlier.

A sketch counts integers (rates in ten-thousandths) in buckets of 1/32 of their
value: six leading bits. It has no random choices and adds up exactly, so reruns and retried
tasks agree, and sketches of sources merge into one of the language and of all.
Documents that fail the base rules don't enter it. A group of fewer than ``ENOUGH``
documents takes the fences of its language, and a language of fewer those of all; without
``ENOUGH`` documents in all there are no fences. Where most documents have the same value, as most
have no symbols, the interquartile range is 0 and ``least`` of the rate is taken for it.

The rates of a document: symbols a word, share of repeated lines, share of words in
repeated windows, characters a word, and ASCII signs and digits among the characters of words.

Defined cases: null text has no words, so it fails the base rules; null
language or source is a group of its own; repeated rows each get a row and count
each; an empty table gives an empty result; other columns of any name come
back as they are (``judge`` refuses only its own ``out``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, boxed, read, small, written

WINDOW = 8
#: Interquartile ranges beyond the upper (lower) quartile that are still normal.
SPREADS = 6
#: Documents of a group below which it takes the fences of the next larger one.
ENOUGH = 50
#: Parts of one in which rates are counted, and leading bits that a bucket keeps.
UNIT, BITS = 10_000, 6
MIN_WORDS, MAX_REPEAT = 20, 30


class Rate(NamedTuple):
    name: str
    over: str  # numerator, a statistic
    of: str  # denominator
    least: int  # least interquartile range, in parts of UNIT
    below: bool  # whether too little is an outlier too


RATES = (
    Rate("symbol_rate", "n_symbols", "n_words", 200, False),
    Rate("dup_line_rate", "n_dup_lines", "n_lines", 500, False),
    Rate("repeat_rate", "n_repeat_words", "n_words", 300, False),
    Rate("word_length", "word_chars", "n_words", 500, True),
    Rate("sign_rate", "n_signs", "word_chars", 50, False),
)


def stats(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_signs, n_lines, n_dup_lines and n_repeat_words of a text."""
    t = F.coalesce(text, F.lit(""))

    def counted(norm: Column) -> Column:
        w = F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))
        return F.transform(F.array(w), lambda words: _counts(t, norm, words))[0]

    # one-element arrays name what is used more than once, so that it is made once
    return F.transform(F.array(F.trim(F.regexp_replace(t, SPACE, " "))), counted)[0]


def _counts(t: Column, norm: Column, words: Column) -> Column:
    n = F.size(words).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    of_lines = F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))[0]
    return F.struct(
        n.alias("n_words"),
        (F.length(norm) - F.greatest(n - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(norm, F.lit(r"[!-@\[-`{-~]")).cast("long").alias("n_signs"),
        of_lines["all"].alias("n_lines"),
        of_lines["dup"].alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    )


def repeated_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur twice or more in the text, the first included.

    Windows are hashed, a long each. Only if two hashes are equal are the windows
    of those hashes compared themselves, sorted with their places, and the covered words summed.
    """
    hashes = F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), lambda h: F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))[0]

    def equal_neighbours(placed: Column) -> Column:
        """Places of structs (key, i), sorted by key, whose key is that of a neighbour."""
        same = lambda x, k: F.coalesce(F.get(placed, k)["key"] == x["key"], F.lit(False))
        return F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    def neighbours(keys: Column) -> Column:
        return F.transform(F.array(F.sort_array(keys)), equal_neighbours)[0]

    def covered(h: Column) -> Column:
        maybe = neighbours(F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("i"))))
        twice = neighbours(F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("key"), i.alias("i"))))
        # each window adds what the next one doesn't cover
        return F.aggregate(F.sort_array(twice), F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("at")), lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("sum"), i.alias("at")))["sum"]

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(F.transform(F.array(hashes), of)[0]).cast("long")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (F.lit(100) * s["n_repeat_words"] > F.lit(MAX_REPEAT) * s["n_words"])


def parts(rate: Rate, s: Column) -> Column:
    """A rate in parts of UNIT, a whole number; 0 where there is nothing to divide by."""
    return F.when(s[rate.of] > 0, F.floor(s[rate.over] * UNIT / s[rate.of])).otherwise(F.lit(0)).cast("long")


def sketch(judged: DataFrame) -> DataFrame:
    """judged: (lang, source, base_failed and the rates). Counts n by language, source, rate, and from and to of the bucket."""
    v = F.col("rate.v")
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    low = F.expr("shiftleft(shiftright(rate.v, b), b)")
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("name"), F.col(r.name).alias("v")) for r in RATES])).alias("rate")
    d = judged.filter("NOT base_failed").select("lang", "source", each).withColumn("b", shift)
    d = d.select("lang", "source", F.col("rate.name").alias("rate"), low.alias("lo"), (low + F.expr("shiftleft(1L, b)") - 1).alias("hi"))
    return d.groupBy("lang", "source", "rate", "lo", "hi").agg(F.count("*").alias("n"))


def _levels(d: DataFrame, *kept: str) -> DataFrame:
    """Each row of a language and source thrice: for the group itself, its language and all."""
    lang, source = F.col("lang"), F.col("source")
    of = lambda level, x, y: F.struct(F.lit(level).alias("level"), x.alias("lang"), y.alias("source"))
    none = F.lit(None).cast("string")
    three = F.array(of(0, lang.cast("string"), source.cast("string")), of(1, lang.cast("string"), none), of(2, none, none))
    return d.select(*kept, F.explode(three).alias("of"))


def quartiles(counts: DataFrame) -> DataFrame:
    """(of, rate, docs, q1, q3) from the counts of each level. A group has some two thousand buckets at most."""
    merged = _levels(counts, "rate", "lo", "hi", "n").groupBy("of", "rate", "lo", "hi").agg(F.sum("n").alias("n"))
    w = W.partitionBy("of", "rate")
    run = F.sum("n").over(w.orderBy("lo").rowsBetween(W.unboundedPreceding, 0))
    r = merged.withColumn("run", run).withColumn("docs", F.sum("n").over(w))
    q1, q3 = F.min(F.when(4 * F.col("run") >= F.col("docs"), F.col("lo"))), F.min(F.when(4 * F.col("run") >= 3 * F.col("docs"), F.col("hi")))
    return r.groupBy("of", "rate").agg(F.first("docs").alias("docs"), q1.alias("q1"), q3.alias("q3"))


def fences(counts: DataFrame) -> DataFrame:
    """(f_lang, f_source, and the fences max_ and min_ of each rate): a row a language and source, of the smallest group that is large enough."""
    q = quartiles(counts).filter(F.col("docs") >= ENOUGH).withColumnRenamed("of", "q_of")
    groups = _levels(counts.select("lang", "source").distinct(), "lang", "source")
    found = groups.join(q, F.col("of") == F.col("q_of"))  # structs are equal also where both hold null
    best = found.groupBy("lang", "source", "rate").agg(F.min(F.struct(F.col("of.level").alias("level"), "q1", "q3")).alias("q"))
    spread = lambda r: SPREADS * F.greatest(F.col("q.q3") - F.col("q.q1"), F.lit(r.least))
    at = lambda r, c: F.max(F.when(F.col("rate") == r.name, c))
    out = [at(r, F.col("q.q3") + spread(r)).alias(f"max_{r.name}") for r in RATES] + [at(r, F.col("q.q1") - spread(r)).alias(f"min_{r.name}") for r in RATES if r.below]
    return best.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*out)


def judged(rows: DataFrame) -> DataFrame:
    """rows: row, text, lang, source. Returns row, stats and kept. The statistics are made once and written to the shared folder."""
    s = F.col("stats")
    d = rows.select("row", "lang", "source", stats(F.col("text")).alias("stats"))
    d = written(d.select("*", base_failed(s).alias("base_failed"), *[parts(r, s).alias(r.name) for r in RATES]), "quality")
    f = small(written(fences(written(sketch(d), "sketch")), "fences"))
    j = d.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    ok = ~F.col("base_failed")
    for r in RATES:
        ok = ok & F.coalesce(F.col(r.name) <= F.col(f"max_{r.name}"), F.lit(True))
        if r.below:
            ok = ok & F.coalesce(F.col(r.name) >= F.col(f"min_{r.name}"), F.lit(True))
    return j.select("row", F.struct("stats.*", "base_failed", ok.alias("kept")).alias("quality"))


def judge(docs: DataFrame, out: str = "quality") -> DataFrame:
    """docs with a struct of their statistics, base_failed and kept."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    return judged(_rows(docs)).select("row.*", F.col("quality").alias(out))


def _rows(docs: DataFrame) -> DataFrame:
    return boxed(docs).select("row", "row.text", "row.lang", "row.source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    d = read(spark, sf_dir, "documents")
    j = judged(d.select(F.struct("doc_id").alias("row"), "text", "lang", "source"))
    return j.select("row.doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return judged(_rows(docs)).filter("quality.kept").select("row.*")
