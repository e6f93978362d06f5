"""Mixing sources to target weights by capped water-filling [native: DataFrame functions only].

Each source has a weight and a capacity of ``max_epochs`` times its size. The
water level L gives source i the target min(capacity_i, L * weight_i), where
the targets sum to the wanted total. Resharing the excess of clamped sources by
weight until none is above its capacity ends at this same level, so it is
found in closed form: sources sorted by capacity / weight fill up in this order.

A source with target t and size s takes every document floor(t / s) times and
a seeded sample once more, so that the extra words come near the rest. The
sample is a prefix of the documents in the order of md5(seed:doc_id): their
sizes are first summed in 4096 slices of that order, then only the
slice in which the wanted sum is reached is ordered row by row. No source,
however large, meets in one task: slices are pre-aggregated map-side.

Defined cases: null text has size 0; documents of size 0 are taken 0 times; a
null source is a source, the last; a null doc_id is hashed as the empty text;
repeated rows are ordered by doc_id and size and count each; an
empty table gives an empty result; other columns of any name come back as they
are (``mix`` refuses only its own ``out``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, boxed, read, small, written

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the hash that name a slice: 16 ** 3 = 4096 slices a source.
SLICE_DIGITS = 3
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0.

    A word and the white space after it become one byte: regexp_count would hold
    every word of the text as an object in an array first.
    """
    marks = F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), F.lit(NOT_SPACE + r"[ \x09-\x0D]*"), F.lit("."))
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, total: Column | None = None) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds weight and target. One row a source passes through one task."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("want", F.sum("source_size").over(everything).cast("double") if total is None else total.cast("double"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # the first source in filling order that the level doesn't fill sets the level of all after it
    s = s.withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("open_level.level"), F.lit(float("inf"))) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """rows: row, doc_id, source and size (long). Returns row, size, source_size, target and reps, the times a document is taken."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = rows.withColumn("key", key).withColumn("slice", F.substring(key, 1, SLICE_DIGITS))
    slices = written(d.groupBy("source", "slice").agg(F.sum("size").alias("sum")), "mix-slices")
    goal = water_fill(slices.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, max_epochs)
    s = F.col("source_size")
    whole = F.when(s > 0, F.floor(F.col("target") / s)).otherwise(F.lit(0)).cast("long")
    goal = goal.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * s).alias("rest"))
    # a row a source: the slice in which the wanted sum is reached, and what comes before it
    run = W.partitionBy("source").orderBy("slice")
    cut = slices.withColumn("before", F.sum("sum").over(run) - F.col("sum"))
    cut = cut.join(goal, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("before") + F.col("sum") > F.col("rest"))
    cut = cut.groupBy(F.col("source").alias("cut_of")).agg(F.min(F.struct("slice", "before")).alias("cut"))
    per = goal.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").select("of", "source_size", "target", "whole", "rest", F.col("cut.slice").alias("at"), F.col("cut.before").alias("before"))
    j = d.join(small(written(per, "mix-goal")), F.col("source").eqNullSafe(F.col("of")))
    inside = F.coalesce(F.col("slice") == F.col("at"), F.lit(False))
    # rows of other slices aren't in the order: only a slice of each source is sorted
    order = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = j.filter(inside).withColumn("run", F.col("before") + F.sum("size").over(order) - F.col("size"))
    # the document at the edge goes in if that brings the sum nearer
    edge = edge.withColumn("extra", (F.col("run") + F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("run")
    rest = j.filter(~inside).withColumn("extra", F.coalesce(F.col("slice") < F.col("at"), F.lit(True)).cast("long"))
    reps = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("long")
    return edge.unionByName(rest).select("row", "size", "source_size", "target", reps.alias("reps"))


def mix(docs: DataFrame, out: str = "mix", **how) -> DataFrame:
    """docs with a struct of their size in words, their source's source_size and target, and reps, the times a document is taken."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    return mixed(_rows(docs), **how).select("row.*", F.struct("size", "source_size", "target", "reps").alias(out))


def _rows(docs: DataFrame) -> DataFrame:
    return boxed(docs).select("row", "row.doc_id", "row.source", n_words(F.col("row.text")).alias("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with the fixed weights: doc_id, size, source_size, target, taken."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    d = written(d, "mix-sizes")  # the mix reads them twice, the texts once
    return mixed(d.select(F.struct("doc_id").alias("row"), "doc_id", "source", "size")).select("row.doc_id", "size", "source_size", "target", (F.col("reps") * F.col("size")).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    m = mixed(_rows(docs)).filter(F.col("reps") > 0)
    return m.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps")))).select("row.*")


#: The same mix in SQL: the running sum in md5 order over the whole source, levels by the same closed form.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS want FROM s),
l AS (SELECT *, (want - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap), 'inf'::DOUBLE)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS run
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(whole + CASE WHEN run + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r
"""
