"""License scans by ordered signature rules [native: DataFrame functions only].

One pass over the documents without a shuffle; memory is bounded by a document.

1. Keyword prefilter: a regex over the raw text, a trie of all keywords at the beginnings of
   words. Most documents stop here.
2. Words of the rest; for each keyword word the ``REACH`` words on either side.
3. Only the rules of that keyword, and only if their second literal is in the
   window, try their two patterns. A detection is an interval of words.
4. A detection inside another of higher (priority, length, rule number) is
   suppressed. Both cover a common word, so their keywords are at most
   ``2 * REACH`` words apart: each is compared with so many neighbours only.

Base phrases are rules too; they are counted before suppression and their
labels stay. Defined cases: null or empty text has no words and no labels,
score 0; repeated rows each give a row; an empty table gives an empty result;
other columns of any name come back as they are (``scan`` refuses only its own
``out``); a rule with a side that may take more than ``REACH`` words is refused.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, lower_ascii, read
from .license_rules import Rule, rules

#: Words that a match may take on either side of its keyword.
REACH = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = WORD + "+"


def _table(found: list[Rule]) -> Column:
    """Keyword to its rules, a constant: one JSON literal, which the optimizer folds, rather than thousands of expressions."""
    by: dict[str, list[dict]] = {}
    for i, r in enumerate(found):
        left, right = (f"(?:^|(?<= )){r.left}$" if r.left else "", f"^{r.right}(?= |$)" if r.right else "")
        by.setdefault(r.keyword, []).append({"id": i, "need": r.need, "left": left, "right": right, "label": r.label, "priority": r.priority, "weight": r.weight, "base": r.base})
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<id:int,need:string,left:string,right:string,label:string,priority:int,weight:double,base:boolean>>>")


def _blanks(c: Column) -> Column:
    """Number of blanks, which is the number of words that a matched side has."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _side(pattern: Column, text: Column) -> Column:
    """Words matched at the keyword's side: 0 for no pattern, null if the pattern doesn't match."""
    return F.when(pattern == "", F.lit(0)).when(F.regexp_like(text, pattern), _blanks(F.coalesce(F.regexp_substr(text, pattern), F.lit(""))))


def _better(e: Column, d: Column) -> Column:
    """e outranks d: by priority, then length, then the earlier rule."""
    return F.struct(e["priority"], e["end"] - e["start"], -e["id"], -e["start"]) > F.struct(d["priority"], d["end"] - d["start"], -d["id"], -d["start"])


def _alternatives(words: list[str]) -> str:
    """A pattern of any of some words, common beginnings once, so that few branches are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    return "|".join(re.escape(c) + (f"(?:{_alternatives(rest)})" if len(rest) > 1 else re.escape(rest[0])) if c else "" for c, rest in sorted(by.items(), reverse=True))


def words_of(pattern: str) -> float:
    """The most words that a side's pattern can take: blanks that it can match."""

    def most(items) -> float:
        return sum(map(one, items))

    def one(item) -> float:
        kind, what = str(item[0]), item[1]
        if kind == "LITERAL":
            return float(what == 32)
        if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            times = float("inf") if str(what[1]) == "MAXREPEAT" else int(what[1])
            return times * n if (n := most(what[2])) else 0.0
        if kind == "BRANCH":
            return max(map(most, what[1]))
        if kind == "SUBPATTERN":
            return most(what[-1])
        if kind == "IN":  # a class holds a blank or not
            return float(re.match("[" + _class(what) + "]", " ") is not None)
        return float(kind in ("ANY", "NOT_LITERAL"))

    return most(re._parser.parse(pattern)) if pattern else 0.0


def _class(items) -> str:
    out = ""
    for kind, what in items:
        kind = str(kind)
        out += {"NEGATE": "^", "LITERAL": f"\\x{what:02x}" if kind == "LITERAL" else ""}.get(kind, "")
        if kind == "RANGE":
            out += f"\\x{what[0]:02x}-\\x{what[1]:02x}"
        if kind == "CATEGORY":
            out += {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_WORD": r"\W"}[str(what)]
    return out


def scan(docs: DataFrame, found: list[Rule] | None = None, text: str = "text", out: str = "license") -> DataFrame:
    """docs with a struct of n_words, detections (after suppression), n_base, first_word, last_word, base_labels, labels, score."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    return scanned(boxed(docs).select("row", F.col(f"row.`{text}`").alias("text")), found).select("row.*", F.col("license").alias(out))


def scanned(rows: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """rows: row and text. Returns row and license, what scan() finds."""
    found = rules() if found is None else found
    for r in found:
        if max(words_of(r.left), words_of(r.right)) > REACH:
            raise ValueError(f"a side of {r} may take more than {REACH} words")
    keywords = sorted({r.keyword for r in found})
    table = _table(found)
    t = F.coalesce(F.col("text"), F.lit(""))
    d = rows.withColumn("n_words", F.regexp_count(t, F.lit(RAW_WORD)).cast("long"))
    gate = t.rlike(f"(?i)(?<!{WORD})(?:{_alternatives(keywords)})(?!{WORD})")
    words = F.when(gate, F.filter(F.split(F.regexp_replace(lower_ascii(t), SEPARATORS, " "), " "), lambda w: w != ""))
    d = d.withColumn("w", F.coalesce(words, F.array().cast("array<string>")))
    kw = F.array(*[F.lit(k) for k in keywords])
    at = F.filter(F.transform("w", lambda w, i: F.when(F.array_contains(kw, w), i)), lambda i: i.isNotNull())
    d = d.withColumn("at", at)

    def detections(pos: Column) -> Column:
        w = F.col("w")
        low = F.greatest(pos - REACH, F.lit(0))
        left = F.concat(F.array_join(F.slice(w, low + 1, pos - low), " "), F.when(pos > low, F.lit(" ")).otherwise(F.lit("")))
        after = F.slice(w, pos + 2, F.lit(REACH))
        right = F.concat(F.when(F.size(after) > 0, F.lit(" ")).otherwise(F.lit("")), F.array_join(after, " "))

        def tried(r: Column) -> Column:
            gated = (r["need"] == "") | F.contains(left, r["need"]) | F.contains(right, r["need"])
            a, b = _side(r["left"], left), _side(r["right"], right)
            return F.when(gated & a.isNotNull() & b.isNotNull(), F.struct((pos - a).alias("start"), (pos + b).alias("end"), r["id"].alias("id"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["base"].alias("base")))

        mine = F.filter(F.transform(F.try_element_at(table, F.element_at(w, pos + 1)), tried), lambda x: x.isNotNull())
        return mine

    d = d.withColumn("all", F.filter(F.transform("at", detections), lambda g: F.size(g) > 0))
    base = F.filter(F.flatten("all"), lambda x: x["base"])
    # within a keyword's group first, so that the groups compared below are small
    best = F.transform("all", lambda g: F.filter(g, lambda x: ~F.exists(g, lambda e: (e["start"] <= x["start"]) & (e["end"] >= x["end"]) & _better(e, x))))
    d = d.withColumn("base", base).withColumn("best", best)
    near = lambda i: F.flatten(F.slice(F.col("best"), F.greatest(i - 2 * REACH, F.lit(0)) + 1, F.lit(4 * REACH + 1)))
    kept = F.flatten(F.transform("best", lambda g, i: F.filter(g, lambda x: ~F.exists(near(i), lambda e: (e["start"] <= x["start"]) & (e["end"] >= x["end"]) & _better(e, x)))))
    d = d.withColumn("detections", kept)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_labels = F.transform("base", lambda x: x["label"])
    found_here = F.struct(
        "n_words",
        "detections",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("detections", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0)).cast("double").alias("score"),
    )
    return d.select("row", found_here.alias("license"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    d = scanned(read(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "text"))
    return d.select("row.doc_id", *[f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
