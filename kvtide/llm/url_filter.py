"""URL filters: prefix rules, then host word segmentation and multinomial naive Bayes.

Host, path and rules are JVM expressions. A url without a rule is judged by
naive Bayes over the words of its host labels and its path tokens. Host names
are concatenated words, so each label is split by a unigram Viterbi whose lexicon
is trained on all distinct labels: labels of two or more hosts, and pieces that
occur in two or more labels, re-estimated by hard EM. The lexicon is a table: pieces are
counted with partial sums, and each label is joined to the counts of its own
pieces, so that nothing is collected or cut. Letters left alone say nothing. Training
texts are the urls that rules judge, all of them; their token counts are exact, in a
table that is joined by token.

Defined cases: null urls and urls without ``://`` have empty host and path and
no rule; they are judged by the prior alone. Without any training url the
verdict is allow. Repeated rows each get a row; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read, small, written

#: Verdict, host, path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that any lexicon has.
COMMON = "ads api app best blog buy cdn chat click cloud com data dev docs example files forum free game games help home image img info mail media mobile music news online page photo play porn post pro sale search sex shop site store tech the top track tracker travel video web wiki work world www xxx".split()
ROUNDS, LONGEST = 3, 12


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it has no ``://``."""
    host = F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, what: str) -> Column:
    """The longest rule that fits, or its verdict; null if none does."""
    fits = []
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(ok, F.lit(verdict if what == "verdict" else h + p)))
    return F.coalesce(*fits)


class Segmenter:
    """Unigram Viterbi over letters; unknown stretches cost by the letter."""

    def __init__(self, counts: dict[str, float]) -> None:
        self._set(counts, sum(counts.values()) + 1.0)

    @classmethod
    def part(cls, counts: dict[str, float], total: float) -> Segmenter:
        """With the counts of some pieces of a lexicon and its total."""
        seg = cls.__new__(cls)
        seg._set(counts, total)
        return seg

    def _set(self, counts: dict[str, float], total: float) -> None:
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total) + math.log(26)
        self.longest = max(map(len, counts), default=1)

    def split(self, name: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - self.longest), j):
                c = best[i] + self.cost.get(name[i:j], self.unknown if j - i == 1 else math.inf)
                if c < best[j]:
                    best[j], back[j] = c, i
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]

    @classmethod
    def trained(cls, names: list[str], words: Iterable[str] = ()) -> Segmenter:
        """Given words, and pieces of 2 to LONGEST letters in at least two of the distinct names, re-estimated by hard EM. What lexicon() does, in memory."""
        given = {*COMMON, *words}
        found: Counter[str] = Counter()
        for n in names:
            found.update({n[i:j] for i in range(len(n)) for j in range(i + 2, min(len(n), i + LONGEST) + 1)})
        counts = {w: float(c) for w, c in found.items() if c >= 2}
        counts |= {w: counts.get(w, 0.0) + 1.0 for w in given}
        for _ in range(ROUNDS):
            s, used = cls(counts), Counter()
            for n in names:
                used.update(s.split(n))
            counts = {w: float(c) for w, c in used.items() if len(w) > 1 or c > 1} | {w: used[w] + 1.0 for w in given}
        return cls(counts)


def path_tokens(path: str) -> list[str]:
    """Tokens of the path; numbers are told by their length only."""
    return ["p:" + (f"#{len(t)}" if t.isdigit() else t) for t in re.findall("[^\\W_]+", path.lower())]


def parsed(pages: DataFrame) -> DataFrame:
    host, path = split_url(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    return d.withColumn("rule", rule_of(F.col("host"), F.col("path"), "rule")).withColumn("said", rule_of(F.col("host"), F.col("path"), "verdict"))


def _pieces(labels: DataFrame, given: DataFrame) -> DataFrame:
    """(n, w): the distinct pieces of each label, of up to LONGEST letters or given."""
    n, at = F.col("n"), lambda last: F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    short = F.flatten(F.transform(at(F.length(n)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(n) - i + 1)), lambda k: n.substr(i, k))))
    out = labels.select("n", F.explode(F.array_distinct(short)).alias("w"))
    # longer words are found by their first letters
    head = LONGEST + 1
    long = given.filter(F.length("w") > LONGEST).select("w", F.col("w").substr(1, head).alias("head"))
    starts = labels.select("n", F.posexplode(F.transform(at(F.length(n) - LONGEST), lambda i: n.substr(i, F.lit(head)))).alias("i", "start"))
    more = starts.join(small(written(long, "long-words")), F.col("start") == F.col("head")).filter(n.substr(F.col("i") + 1, F.length("w")) == F.col("w"))
    return out.unionByName(more.select("n", "w").distinct())


def _split(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(n, words): labels split with the pieces (n, w) they have and the counts (w, c) of the whole lexicon."""
    total = float(counts.agg(F.sum("c")).first()[0] or 0.0) + 1.0
    both = pairs.join(small(counts).withColumnRenamed("w", "v"), F.col("w") == F.col("v"), "left")
    known = both.groupBy("n").agg(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("w", "c"))).alias("known"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            words = [Segmenter.part({x["w"]: x["c"] for x in known}, total).split(n) for n, known in zip(pdf["n"], pdf["known"], strict=True)]
            yield pd.DataFrame({"n": pdf["n"], "words": words})

    return known.mapInPandas(run, "n string, words array<string>")


def lexicon(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels: (n, hosts), distinct and written. Returns (n, w), the pieces of each label, and (w, c), the lexicon, both written."""
    spark = labels.sparkSession
    common = spark.createDataFrame([(w,) for w in COMMON], "w string")
    given = written(labels.filter("hosts > 1").select(F.col("n").alias("w")).unionByName(common).distinct(), "given-words")
    plus = given.select("w", F.lit(1.0).alias("plus"))
    pairs = written(_pieces(labels, given), "pieces")
    found = pairs.filter((F.length("w") > 1) & (F.length("w") <= LONGEST)).groupBy("w").agg(F.count("*").cast("double").alias("c")).filter("c >= 2")

    def added(used: DataFrame) -> DataFrame:
        every = used.join(plus, "w", "full").filter("plus IS NOT NULL OR length(w) > 1 OR c > 1")
        return written(every.select("w", (F.coalesce("c", F.lit(0.0)) + F.coalesce("plus", F.lit(0.0))).alias("c")), "lexicon")

    counts = added(found)
    # other pieces never come into use
    usable = small(counts).select(F.col("w").alias("v"))
    pairs = written(pairs.join(usable, F.col("w") == F.col("v"), "left_semi").filter("length(w) > 1").unionByName(pairs.filter("length(w) = 1")), "pieces")
    for _ in range(ROUNDS):
        used = _split(pairs, counts).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").cast("double").alias("c"))
        counts = added(used)
    return pairs, counts


def judge(pages: DataFrame, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by naive Bayes). learn: the ruled pages to learn from, by page_id, for measuring on the others; all by default."""
    ruled = parsed(pages).withColumn("rid", F.monotonically_increasing_id())
    d = written(ruled.withColumn("verdict", F.col("said")).withColumn("said", F.when(F.lit(True) if learn is None else learn, F.col("said"))), "urls")
    label = F.filter(F.split("host", "[0-9.:_-]+"), lambda x: x != "")
    hosts = d.select("host").distinct().select("host", label.alias("all"))
    labels = hosts.select(F.explode(F.array_distinct("all")).alias("n")).groupBy("n").agg(F.count("*").alias("hosts"))
    words = _split(*lexicon(written(labels, "labels"))).select("n", F.filter("words", lambda w: F.length(w) > 1).alias("words"))
    of_host = hosts.select("host", F.explode("all").alias("label")).join(small(written(words, "words")), F.col("label") == F.col("n"))
    of_host = of_host.select("host", F.explode("words").alias("w")).groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "w")).alias("host_tokens"))
    of_host = written(of_host, "host-words").withColumnRenamed("host", "name")

    def paths(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["rid", "host", "said"]].assign(path_tokens=[path_tokens(p) for p in pdf["path"]])

    t = d.select("rid", "host", "said", "path").mapInPandas(paths, "rid long, host string, said string, path_tokens array<string>")
    t = t.join(small(of_host), F.col("host") == F.col("name"), "left")
    none = F.array().cast("array<string>")
    t = written(t.select("rid", "said", F.explode(F.concat(F.coalesce("host_tokens", none), "path_tokens")).alias("token")), "tokens")
    per = [F.count(F.when(F.col("said") == c, 1)).cast("double") for c in ("allow", "block")]
    seen = written(t.filter("said IS NOT NULL").groupBy("token").agg(per[0].alias("allow"), per[1].alias("block")), "token-counts")
    sums = seen.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("allow"), F.lit(0.0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0.0)).alias("block")).first()
    docs = d.agg(per[0].alias("allow"), per[1].alias("block")).first()
    kinds = max(1, sums.kinds)
    rest = math.log(sums.allow + kinds) - math.log(sums.block + kinds)
    prior = math.log((docs.block + 1.0) / (docs.allow + 1.0))
    known = small(seen).select(F.col("token").alias("known"), (F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0)).alias("ratio"))
    sums_of = t.join(known, F.col("token") == F.col("known"), "left").groupBy("rid").agg(F.sum(F.coalesce("ratio", F.lit(0.0)) + F.lit(rest)).alias("s")).withColumnRenamed("rid", "r")
    log_odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(prior) + F.coalesce("s", F.lit(0.0))))
    out = d.join(sums_of, F.col("rid") == F.col("r"), "left").withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds)))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict, and the score of the method."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
