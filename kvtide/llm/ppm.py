"""Language model scores: prediction by partial matching over bytes, and unigram base scores.

Model. A context trie of depth ``ORDER`` = 5 over bytes, counted on all
training documents and growing with them. A symbol's probability comes from the longest context
in which it was seen, after an escape (method C: d / (n + d) with n counts of d symbols)
from each longer one; symbols seen in a longer context are excluded from the
shorter ones. Below order 0 the symbols left are equally likely. Byte FF, which UTF-8 never
has, pads the start and ends the text.

The trie is a table of grams: five bytes of context and a symbol, packed in a long, with
their counts. Grams are counted by batch, then by partial sums. All contexts of orders 3 to 5 of a gram,
and their other symbols, share its last three bytes of context, so grams dealt by these
(256^3 symbols at most, of 256^2 first bytes) are scored together in a task: symbols seen in a context were seen in all
shorter ones, so the mass that a context excludes is a sum over its symbols. Orders 0 to 2 are a dense table of 64 MB at
most at any size of the corpus, which is broadcast to that step. Each distinct gram of all
documents gets its log probability. Documents add them up: those of the most frequent grams, ``FREQUENT`` at most, from
a broadcast table, all others by gram and joined back, with partial sums before every shuffle.

Base score. Token counts are exact over all training tokens. Tokens that a
sample shows to be frequent (``COMMON`` at most; any choice gives the same
results) are counted in arrays and broadcast; occurrences of all others are
summed by token and joined back, with partial sums before every shuffle.

Passes over the texts: the sample, the tokens, the grams, the scores. The scores are written
once, a row a document with its rare tokens and grams.

Defined cases: null text is empty (one token, the end); without training
documents every count is 0 and bytes are uniform; repeated rows each get a row
(rows are told apart by a number of their own); a null doc_id is
hashed as the empty text; an empty table gives an empty result; a text of any length is worked on in
pieces of ``CHUNK`` bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, parts_for, read, written

ORDER = 5
PAD = b"\xff" * ORDER
#: Frequent tokens in the broadcast table, and bytes of each.
COMMON, COMMON_BYTES = 1 << 16, 64
SAMPLE_DOCS = 4000
#: Bytes of text worked on at a time.
CHUNK = 1 << 19
#: Documents scored at a time, 1 << 16 at most, and bytes of them (one text can be more).
ROWS, GROUP = 1024, 1 << 22
#: Grams in the broadcast table, and those a task holds before it sends them on.
FREQUENT, HELD_GRAMS = 1 << 20, 1 << 20
FOLDS, HELD = 5, 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def texts_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column, ROWS and about GROUP bytes at a time."""
    held, size = [], 0
    for t in column:
        held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if len(held) == ROWS or size > GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def words_in(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and the number in each text."""
    a = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    solid = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))  # starts and ends in turn
    start, length = edge[::2], edge[1::2] - edge[::2]
    stop = np.cumsum([len(t) + 1 for t in texts])
    many = np.diff(np.searchsorted(start, stop), prepend=0)
    at = np.r_[0, np.cumsum(length)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(a[solid])])
    return words, many


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


# ---- the byte model


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A padded text in pieces; the first ORDER bytes of each are context only."""
    data = PAD + text + b"\xff"
    for k in range(0, len(data) - ORDER, CHUNK):
        yield data[k : k + CHUNK + ORDER]


def grams(pieces: list[bytes]) -> np.ndarray:
    """The grams of all pieces, one after the other: ORDER bytes of context and a symbol, packed."""
    a = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(x) for x in pieces], np.int64)
    ok = np.ones(len(a), bool)
    first = np.cumsum(size) - size
    for k in range(ORDER):
        ok[first + k] = False
    wide = a.astype(np.uint64)
    g = wide[: len(a) - ORDER]
    for k in range(1, ORDER + 1):
        g = (g << np.uint64(8)) | wide[k : len(a) - ORDER + k]
    return g[ok[ORDER:]]


def probabilities(ctx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ctx: contexts of two bytes with a row of counts each. Returns (row of each of 65536 contexts, log10 of probabilities by row).

    Rows: the contexts given, then the last byte alone (256), then none (1).
    """
    order1 = np.zeros((256, 256))
    np.add.at(order1, ctx & 255, counts)
    order0 = order1.sum(0, keepdims=True)
    lut = (len(ctx) + (np.arange(1 << 16) & 255)).astype(np.int32)
    lut[~order1.any(1)[np.arange(1 << 16) & 255]] = len(ctx) + 256
    lut[ctx] = np.arange(len(ctx))
    out = np.empty((len(ctx) + 257, 256), np.float32)

    def fill(levels: list[np.ndarray], n: int) -> np.ndarray:
        """levels: counts by context, longest first."""
        p, left, open_ = np.zeros((n, 256)), np.ones((n, 1)), np.ones((n, 256), bool)
        for level in levels:
            c = np.where(open_, level, 0)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            # where nothing is left to see, or nothing was seen, there is no escape to pay
            whole = open_.sum(1, keepdims=True) == kinds
            down = np.where(total > 0, np.where(whole, total, total + kinds), 1)
            p += np.where(c > 0, left * c / down, 0)
            left = left * np.where(total > 0, np.where(whole, 0, kinds / down), 1)
            open_ &= c == 0
        return p + np.where(open_, left / np.maximum(open_.sum(1, keepdims=True), 1), 0)

    for k in range(0, len(ctx), 4096):
        mine = ctx[k : k + 4096]
        out[k : k + len(mine)] = np.log10(fill([counts[k : k + 4096], order1[mine & 255], np.broadcast_to(order0, (len(mine), 256))], len(mine)))
    out[len(ctx) : -1] = np.log10(fill([order1, np.broadcast_to(order0, (256, 256))], 256))
    out[-1:] = np.log10(fill([order0], 1))
    return lut, out


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, below 1 << 48, in order and the sums of their whole numbers."""
    key, n = key.astype(np.uint64, copy=False), n.astype(np.int64, copy=False)
    both = (key << np.uint64(16)) | (n & 0xFFFF).astype(np.uint64)  # sorting one array is far cheaper than an order of two
    both.sort()
    sorted_key = both >> np.uint64(16)
    new = runs(sorted_key)
    out = sorted_key[new]
    sums = np.add.reduceat((both & np.uint64(0xFFFF)).astype(np.int64), new) if len(new) else n[:0]
    more = np.flatnonzero(n >> 16)
    np.add.at(sums, np.searchsorted(out, key[more]), n[more] & ~0xFFFF)
    return out, sums


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and how often each is there."""
    g = np.sort(g)
    new = runs(g)
    return g[new], np.diff(new, append=len(g))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is wanted in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def gram_scores(key: np.ndarray, n: np.ndarray, low: LowOrders) -> np.ndarray:
    """log10 probabilities of distinct grams, in order, with their training counts; all grams that share three bytes of context are there."""
    levels, k, c = [], key[n > 0], n[n > 0]
    for order in range(ORDER, 2, -1):
        shorter, sums = _summed(k & np.uint64((1 << 8 * order) - 1), c)
        x, owner = np.unique(k >> np.uint64(8), return_inverse=True)
        up = sums[_at(shorter, k & np.uint64((1 << 8 * order) - 1))[0]] if order > 3 else low.counts_of(k)
        levels.append((k, c, x, np.bincount(owner, c, len(x)), np.bincount(owner, minlength=len(x)), np.bincount(owner, up, len(x))))
        k, c = shorter, sums
    out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    gone_n, gone_d = np.zeros(len(key)), np.zeros(len(key))
    for order, (k, c, x, total, kinds, mass) in zip(range(ORDER, 2, -1), levels, strict=True):
        mine = key & np.uint64((1 << 8 * (order + 1)) - 1)
        i, here = _at(x, mine >> np.uint64(8))
        j, found = _at(k, mine)
        if not len(x):
            continue
        left_n, left_d = total[i] - gone_n, kinds[i] - gone_d
        hit, miss = open_ & found, open_ & here & ~found & (left_n > 0)
        down = np.where(kinds[i] == 256, left_n, left_n + left_d)
        out[hit] += np.log10(c[j[hit]] / down[hit])
        out[miss] += np.log10(left_d[miss] / down[miss])
        open_ &= ~found
        gone_n, gone_d = np.where(here, mass[i], gone_n), np.where(here, kinds[i], gone_d)
    out[open_] += low.scores(key[open_], gone_n[open_], gone_d[open_])
    return out


class LowOrders:
    """Contexts of two bytes, one and none, as a dense table."""

    def __init__(self, ctx: np.ndarray, counts: np.ndarray) -> None:
        self.n, self.counts = len(ctx), counts
        self.lut, self.table = probabilities(ctx, counts.astype(np.float64))
        self.total, self.kinds = counts.sum(1, dtype=np.float64), (counts > 0).sum(1)

    def _row(self, key: np.ndarray) -> np.ndarray:
        return self.lut[((key >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]

    def counts_of(self, key: np.ndarray) -> np.ndarray:
        """Counts of the last three bytes of grams that were seen."""
        return self.counts[self._row(key), (key & np.uint64(255)).astype(np.int64)]

    def scores(self, key: np.ndarray, gone_n: np.ndarray, gone_d: np.ndarray) -> np.ndarray:
        """log10 probabilities without symbols of which gone_d kinds with gone_n counts were excluded by a longer context."""
        row, sym = self._row(key), (key & np.uint64(255)).astype(np.int64)
        out = self.table[row, sym].astype(np.float64)
        at = np.flatnonzero(row < self.n)  # contexts of two bytes that were seen
        r = row[at]
        c, total, kinds = self.counts[r, sym[at]], self.total[r], self.kinds[r]
        left_n, left_d = total - gone_n[at], kinds - gone_d[at]
        down = np.where(kinds == 256, left_n, left_n + left_d)
        hit, down_some = c > 0, down > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(c / down)
            # the escape is another one than in the table; what follows it is the same
            other = out[at] - np.log10(kinds / (total + kinds)) + np.where(down_some & (left_n > 0), np.log10(left_d / down), 0.0)
        out[at] = np.where(hit, seen, other)
        return out


# ---- the passes


def _common(docs: DataFrame) -> list[bytes]:
    """Tokens that are frequent in a sample of about SAMPLE_DOCS documents."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(words_of(t.as_py()))
        top = [(w, k) for w, k in c.most_common(COMMON) if len(w) <= COMMON_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([k for _, k in top], pa.int64())], ["w", "n"])

    if not n:
        return []
    got = docs.select("text").sample(min(1.0, SAMPLE_DOCS / n), seed=1).mapInArrow(lean(run), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [bytes(r.w) for r in got.orderBy(F.col("n").desc(), "w").limit(COMMON).collect()]


def _counts(train: DataFrame, common: list[bytes]) -> tuple[np.ndarray, int, int]:
    """Over all training documents: counts of common tokens, all tokens, documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = pa.array(common, pa.large_binary())
        mine, tokens, docs = np.zeros(len(common), np.int64), 0, 0
        for b in batches:
            for texts in texts_of(b.column(0)):
                words, _ = words_in(texts)
                at = places(words, among)
                mine += np.bincount(at[at >= 0], minlength=len(mine))
                tokens, docs = tokens + len(words) + len(texts), docs + len(texts)
        seen = np.flatnonzero(mine)
        rows = (np.r_[np.zeros(len(seen)), 2, 2], np.r_[seen, 0, 1], np.r_[mine[seen], tokens, docs])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(rows, (np.int32, np.int64, np.int64), strict=True)], ["kind", "key", "n"])

    got = train.select("text").mapInArrow(lean(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()
    kind, key, n = (got[c].to_numpy() for c in ("kind", "key", "n"))
    c = np.zeros(len(common), np.int64)
    c[key[kind == 0]] = n[kind == 0]
    totals = dict(zip(key[kind == 2].tolist(), n[kind == 2].tolist(), strict=True))
    return c, totals.get(0, 0), totals.get(1, 0)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(g, n): the distinct grams of docs (text, held_out), with their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[bytes], list[bytes]] = ([], [])
        keys, ns, size, many = [], [], 0, 0

        def counted() -> None:
            nonlocal size, many
            for weight, mine in ((1, held[0]), (0, held[1])):
                if mine:
                    key, n = distinct(grams(mine))
                    keys.append(key)
                    ns.append(n * weight)
                    many += len(key)
                    mine.clear()
            size = 0

        def merged() -> None:
            nonlocal many
            if keys:
                key, n = _summed(np.concatenate(keys), np.concatenate(ns))
                keys[:], ns[:], many = [key], [n], len(key)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal many
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(ns[0])], ["g", "n"])
            keys.clear()
            ns.clear()
            many = 0

        for b in batches:
            for t, out in zip(b.column(0), b.column(1), strict=True):
                for x in pieces_of((t.as_py() or "").encode("utf-8", "surrogatepass")):
                    held[out.as_py()].append(x)
                    size += len(x)
                    if size > CHUNK:
                        counted()
                        if many > HELD_GRAMS:  # distinct grams are fewer; send them on only if they are many by themselves
                            merged()
                            if many > HELD_GRAMS // 2:
                                yield from rows()
        counted()
        merged()
        yield from rows()

    return docs.select("text", "held_out").mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def scored_grams(counts: DataFrame) -> DataFrame:
    """counts, a written table (g, n); adds p, the log10 probability of the symbol after its context."""
    spark = counts.sparkSession
    low = counts.filter("n > 0").groupBy(F.col("g").bitwiseAND(0xFFFFFF).alias("t")).agg(F.sum("n").alias("n")).toArrow()  # three bytes
    t, n = low["t"].to_numpy(), low["n"].to_numpy()
    ctx, row = np.unique(t >> 8, return_inverse=True)
    dense = np.zeros((len(ctx), 256), np.float32 if n.sum() < 1 << 24 else np.float64)
    dense[row, t & 255] = n
    shared = spark.sparkContext.broadcast((ctx, dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        g, n = (whole.sort_by("g").column(i).to_numpy() for i in range(2))
        ctx, dense = shared.value
        low = LowOrders(ctx, dense)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(gram_scores(g.view(np.uint64), n, low).astype(np.float32))], ["g", "n", "p"])

    parts = parts_for(counts, counts.count())
    near = F.shiftright("g", 8).bitwiseAND(0xFFFFFF)
    return counts.select("g", "n").repartition(parts, near).mapInArrow(lean(run), "g long, n long, p float")


def _frequent(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams in order and their log probabilities, FREQUENT at most."""
    size = F.length(F.bin("n"))  # powers of two
    most, at = 0, 65
    for r in scored.filter("n > 0").groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        most += r["count"]
        if most > FREQUENT:
            break
        at = r["size"]
    got = scored.filter((F.col("n") > 0) & (size >= at)).select("g", "p").toArrow().sort_by("g")
    return got["g"].to_numpy().view(np.uint64), got["p"].to_numpy()


def piece_scores(pieces: list[bytes], owner: list[int], known: np.ndarray, p: np.ndarray, rows: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of the log probabilities p of the known grams, in order, in the pieces of each row; and the other grams: row, gram, how often.

    Grams are looked up once each, in order, and not where they occur.
    """
    g = grams(pieces) << np.uint64(16)  # 48 bits, and 16 for the row
    g |= np.repeat(np.array(owner, np.uint64), [len(x) - ORDER for x in pieces])
    both, n = distinct(g)
    row, gram = (both & np.uint64(0xFFFF)).astype(np.int64), both >> np.uint64(16)
    new = runs(gram)
    at, here = _at(known, gram[new])
    value = np.zeros(len(new))
    value[here] = p[at[here]]
    often = np.diff(new, append=len(gram))
    other = np.flatnonzero(np.repeat(~here, often))
    return np.bincount(row, np.repeat(value, often) * n, rows), (row[other], gram[other], n[other])


def lists(row: np.ndarray, rows: int, *values: pa.Array) -> list[pa.Array]:
    """Values as lists by row; rows are in order."""
    at = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, v) for v in values]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets at most so many rows at once meanwhile: all rows come, in smaller messages, so that both sides hold less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if not 0 < int(before or 0) < rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for documents (doc_id, text)."""
    with batches_of(docs.sparkSession, ROWS):
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out"))
    common = _common(d)
    counts, tokens, n_docs = _counts(d.filter("NOT held_out"), common)
    scored = written(scored_grams(written(gram_counts(d), "grams")), "scored-grams")
    shared = spark.sparkContext.broadcast((common, counts, *_frequent(scored)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = math.log10(n_docs + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, known_grams, p = shared.value
        among, value, seen = pa.array(common, pa.large_binary()), np.log10(counts + 0.5), counts > 0
        rid = TaskContext.get().partitionId() << 40
        for whole in batches:
            first = 0
            for texts in texts_of(whole.column(0)):
                rows = len(texts)
                words, many = words_in(texts)
                doc, at = np.repeat(np.arange(rows), many), places(words, among)
                hit = at >= 0
                base = end + np.bincount(doc[hit], value[at[hit]], rows)
                known = int(n_docs > 0) + np.bincount(doc[hit], seen[at[hit]], rows).astype(np.int64)
                rare = words.filter(pa.array(~hit)).dictionary_encode()
                kinds = max(1, len(rare.dictionary))
                key, tf = distinct(doc[~hit] * kinds + rare.indices.to_numpy())
                rares = lists(key // kinds, rows, rare.dictionary.take(pa.array(key % kinds)).cast(pa.binary()), pa.array(tf))

                total, far = np.zeros(rows), []
                pieces, owner, size = [], [], 0
                for i, t in enumerate(texts):
                    for x in pieces_of(t):
                        pieces.append(x)
                        owner.append(i)
                        size += len(x)
                        if size > CHUNK:
                            sums, others = piece_scores(pieces, owner, known_grams, p, rows)
                            total += sums
                            far.append(others)
                            pieces, owner, size = [], [], 0
                if pieces:
                    sums, others = piece_scores(pieces, owner, known_grams, p, rows)
                    total += sums
                    far.append(others)
                row, gram, often = (np.concatenate(x) for x in zip(*far, strict=True))
                o = np.argsort(row, kind="stable")
                fars = lists(row[o], rows, pa.array(gram[o].view(np.int64)), pa.array(often[o]))

                arrays = [pa.array(x) for x in (rid + np.arange(rows), many + 1, known, base)]
                keys = [whole.column(k).slice(first, rows) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*keys, *arrays, *rares, pa.array(total), *fars], ["doc_id", "held_out", "rid", "n", "known", "base", "rare", "tf", "score", "far", "far_n"])
                first, rid = first + rows, rid + rows

    schema = f"doc_id {kind}, held_out boolean, rid long, n long, known long, base double, rare array<binary>, tf array<long>, score double, far array<long>, far_n array<long>"
    s = written(d.mapInArrow(lean(run), schema), "scores")
    every = s.select("rid", "held_out", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("rid", "held_out", F.col("x.rare").alias("w"), F.col("x.tf").alias("tf"))
    seen = written(every.filter("NOT held_out").groupBy("w").agg(F.sum("tf").alias("c")), "token-counts")
    kinds = seen.count() + int((counts > 0).sum()) + int(n_docs > 0)
    both = every.join(seen.withColumnRenamed("w", "v"), F.col("w") == F.col("v"), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    # a document's base score adds its rare tokens in any order: doubles, so equal up to rounding
    rare = both.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(c + F.lit(0.5))).alias("rare_base"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    far = s.select("rid", F.explode(F.arrays_zip("far", "far_n")).alias("x")).select(F.col("rid").alias("far_rid"), F.col("x.far").alias("far"), F.col("x.far_n").alias("far_n"))
    far = far.join(scored.select("g", "p"), F.col("far") == F.col("g")).groupBy("far_rid").agg(F.sum(F.col("far_n") * F.col("p").cast("double")).alias("far_score"))
    whole = math.log10(tokens + 0.5 * (kinds + 1))
    out = s.drop("rare", "tf", "far", "far_n").join(rare.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left").join(far, F.col("rid") == F.col("far_rid"), "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n") * F.lit(whole)
    known = (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long")
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"))
