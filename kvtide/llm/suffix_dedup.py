"""Suffix-array deduplication: bytes in strings of 100 that also start earlier are removed.

A suffix array over every byte would be many times the corpus, so this one
is sparse and exact. Every 100-byte window holds 69 grams of 32 bytes; the least
gram hash of a window is its leading token. Consecutive windows with the same leading
token form a run, on average 37 bytes of text. Equal windows have equal tokens, so
only runs with the same token can hold equal windows.

1. Runs. Each text gives (token, hash of all windows of the run, document,
   start, length).
2. Buckets. Sampled splitters range-partition the runs by token, then run hash,
   then place, so even a token that a third of all documents have is dealt over
   many buckets. Each bucket sorts locally. A run equal to the one before it is a
   repeat as a whole. The first of equal runs is an edge if its token has other
   runs too. What touches a bucket's ends is compared with
   the neighbouring buckets: two rows a bucket at most, on the driver.
3. Edges. They meet again by token, with their bytes, and all their windows
   are sorted by a multikey quicksort on the bytes themselves, eight at a
   time; equal neighbours that start later are repeats. Tokens with more than
   ``HOT`` edges are instead grouped window by window with partial sums, which deals
   them over all tasks with the same result.
4. Windows that repeat within a document are found in that document alone,
   when its bytes are removed.

Rows of one document are told apart by doc_id and a hash of the text. Defined
cases: null text is empty; a null doc_id comes before all others; rows that
repeat doc_id and text are one document, so each gets the same result; rows
that repeat only doc_id are ordered by the hash of their text; texts under 100
bytes keep everything; an empty table gives an empty result; other columns
of any name are brought back by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, parts_for, read, written

LENGTH, GRAM = 100, 32
#: Edges of a token above which its windows are grouped one by one.
HOT = 1 << 16
#: Windows of a text worked on at a time, which bounds memory for very long texts.
CHUNK = 1 << 20
NULL_ID = -(1 << 63)
#: Bytes of text that make a run, about.
RUN_BYTES = 32

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32, 36)}
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all grams and of all windows of a byte array of at least LENGTH, by doubling."""
    h = {1: _BYTES[a]}
    for b in (1, 2, 4, 8, 16, 32):
        h[2 * b] = h[b][:-b] * _POWERS[b] + h[b][b:]
    n = len(a) - LENGTH + 1
    # 100 = 64 + 32 + 4
    return _mix(h[GRAM]), _mix((h[64][:n] * _POWERS[32] + h[32][64 : 64 + n]) * _POWERS[4] + h[4][96 : 96 + n])


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """Least gram hash of each of n windows."""
    width, b = LENGTH - GRAM + 1, 1
    while 2 * b <= width:
        g, b = np.minimum(g[:-b], g[b:]), 2 * b
    return np.minimum(g[:n], g[width - b : width - b + n])


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, run hash, start and number of windows of each run of a text."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        a = np.frombuffer(text[at : at + CHUNK + LENGTH - 1], np.uint8)
        g, w = _hashes(a)
        m = _least(g, len(w))
        cut = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        size = np.diff(np.r_[cut, len(m)])
        place = np.arange(len(m)) - np.repeat(cut, size)
        span = np.add.reduceat(_mix(w + place.astype(np.uint64) * _STEP), cut)
        out.append((m[cut], span, cut + at, size))
    if not out:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _encoded(t: pa.Scalar) -> bytes:
    return (t.as_py() or "").encode("utf-8", "surrogatepass")


RUN = "m long, span long, d long, h long, s long, n long"
RUN_NAMES = ["m", "span", "d", "h", "s", "n"]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2)
        d, h = (b.column(i).to_numpy() for i in (0, 1))
        for k in range(0, b.num_rows, 1024):
            parts = [runs(_encoded(t)) for t in texts[k : k + 1024]]
            many = [len(p[0]) for p in parts]
            m, span, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = [np.repeat(x[k : k + 1024], many) for x in (d, h)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m.view(np.int64), span.view(np.int64), *own, s.astype(np.int64), n.astype(np.int64))], RUN_NAMES)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of runs to: r (repeats), e (edges), and what its neighbours decide: f (first row), t (last token, of one run here), and z (its last run)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    from pyspark import TaskContext

    t = pa.Table.from_batches(got)
    m, span, d, h, s, n = (t.column(i).to_numpy() for i in range(6))
    o = np.lexsort((s, h, d, span, m))
    m, span, d, h, s, n = (x[o] for x in (m, span, d, h, s, n))
    new_m = np.r_[True, m[1:] != m[:-1]]
    new = new_m | np.r_[True, span[1:] != span[:-1]]
    same = ~new & ~np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])]  # the very same place, of a repeated row
    first_of = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    same |= ~new & (d == d[first_of]) & (h == h[first_of]) & (s == s[first_of])
    at_m = np.flatnonzero(new_m)
    kinds = np.add.reduceat(new.astype(np.int64), at_m)
    many = np.repeat(kinds > 1, np.diff(np.r_[at_m, len(m)]))
    kind = np.where(new, np.where(many, "e", ""), np.where(same, "", "r")).astype("U1")
    # the first row may repeat one of the bucket before; a token at either end may have other runs outside
    kind[0] = "f"
    tail = at_m[-1]
    if kinds[-1] == 1 and tail:
        kind[tail] = "t"
    # z has the place where the bucket's last run starts here
    rows = np.r_[np.flatnonzero(kind != ""), first_of[-1]]
    kind = np.append(kind[rows[:-1]], "z")
    bucket = np.full(len(rows), TaskContext.get().partitionId(), np.int64)
    alone = np.where(kind == "f", kinds[0] == 1, kind == "t")
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket), pa.array(alone), *[pa.array(x[rows]) for x in (m, span, d, h, s, n)]], ["kind", "bucket", "alone", *RUN_NAMES])


def _settled(rows: list) -> list[tuple]:
    """The rows at the buckets' ends, with what the neighbours say: at most three of each bucket come here."""
    firsts = {r.bucket: r for r in rows if r.kind == "f"}
    tails = {r.bucket: r for r in rows if r.kind == "t"}
    lasts = {r.bucket: r for r in rows if r.kind == "z"}
    order, out = sorted(firsts), []
    spans: dict[int, set] = {}  # runs of tokens that stand at an end; more than two don't matter
    for r in rows:
        if len(spans.setdefault(r.m, set())) < 2:
            spans[r.m].add(r.span)
    crowded = {m for m, x in spans.items() if len(x) > 1} | {r.m for r in rows if r.kind == "f" and not r.alone}
    begun: dict[tuple, tuple] = {}  # where each run at an end started
    for i, b in enumerate(order):
        f = firsts[b]
        last = lasts[order[i - 1]] if i else None
        place = (f.d, f.h, f.s)
        if last is not None and (last.m, last.span) == (f.m, f.span):
            start = begun.get((f.m, f.span))
            if start != place:  # else a repeated row
                out.append(("r", f.m, f.span, f.d, f.h, f.s, f.n))
        else:
            begun[f.m, f.span] = place
            if f.m in crowded:
                out.append(("e", f.m, f.span, f.d, f.h, f.s, f.n))
        begun.setdefault((lasts[b].m, lasts[b].span), (lasts[b].d, lasts[b].h, lasts[b].s))
        if b in tails and tails[b].m in crowded:
            t = tails[b]
            out.append(("e", t.m, t.span, t.d, t.h, t.s, t.n))
    return out


def _bytes(keyed: DataFrame) -> int:
    return keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def candidates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeats and edges among the runs of documents (_sa_d, _sa_h, text)."""
    spark = keyed.sparkSession
    a = keyed.select(F.col("_sa_d").alias("d"), F.col("_sa_h").alias("h"), "text").mapInArrow(lean(_run_rows), RUN)
    ranged = a.repartitionByRange(parts_for(keyed, _bytes(keyed) // RUN_BYTES), "m", "span", "d", "h", "s")
    out = written(ranged.mapInArrow(lean(_bucket), f"kind string, bucket long, alone boolean, {RUN}"), "runs")
    ends = out.filter(F.col("kind").isin("f", "t", "z")).collect()  # three rows a bucket at most
    more = spark.createDataFrame(_settled(ends), f"kind string, {RUN}")
    both = out.select("kind", *RUN_NAMES).unionByName(more)
    return both.filter("kind = 'r'"), both.filter("kind = 'e'")


# ---- windows of edges


def _sorted_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of windows of LENGTH bytes at given places, within groups. Returns (order, new): new marks the first of equal ones.

    Stable: equal windows stay as they were. Each round sorts by eight more bytes, and only those that are still tied.
    """
    w = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for b in (1, 2, 4):
        w = (w[:-b] << np.uint64(8 * b)) | w[b:]
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        block = np.cumsum(new)[tied]
        key = w[at[order[tied]] + k]
        o = np.lexsort((key, block))
        order[tied] = order[tied][o]
        block, key = block[o], key[o]
        new[tied] |= np.r_[True, (block[1:] != block[:-1]) | (key[1:] != key[:-1])]
    return order, new


def _intervals(d: np.ndarray, h: np.ndarray, s: np.ndarray) -> list[pa.Array]:
    """Starts of repeated windows to (d, h, from, to), consecutive ones as one."""
    o = np.lexsort((s, h, d))
    d, h, s = d[o], h[o], s[o]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] > s[:-1] + 1)] if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(s)][: len(at)] - 1
    return [pa.array(x) for x in (d[at], h[at], s[at], s[last] + LENGTH)]


CUT = "d long, h long, a long, b long"


def _edge_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their edges to a row an edge: (m, hot, d, h, s, bytes)."""
    for b in batches:
        cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        m, hot, d, h, s, data = [], [], [], [], [], []
        for i, t in enumerate(cols["text"]):
            t = _encoded(t)
            for e in cols["_sa_edges"][i].as_py():
                m.append(e["m"])
                hot.append(e["hot"])
                d.append(cols["_sa_d"][i].as_py())
                h.append(cols["_sa_h"][i].as_py())
                s.append(e["s"])
                data.append(t[e["s"] : e["s"] + e["n"] + LENGTH - 1])
        longs = [pa.array(x, pa.int64()) for x in (d, h, s)]
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(hot, pa.bool_()), *longs, pa.array(data, pa.binary())], ["m", "hot", "d", "h", "s", "data"])


def _spread(t: pa.Table) -> tuple[np.ndarray, ...]:
    """All windows of a table of edges: bytes, place in them, token, d, h, start."""
    m, d, h, s = (t.column(c).to_numpy() for c in ("m", "d", "h", "s"))
    data = [bytes(x) for x in t.column("data").to_pylist()]
    size = np.array([len(x) for x in data], np.int64)
    n = size - LENGTH + 1
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + nth
    return np.frombuffer(b"".join(data), np.uint8), at, *(np.repeat(x, n) for x in (m, d, h)), np.repeat(s, n) + nth


def _cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of whole tokens to the intervals that repeat."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).sort_by([("m", "ascending")])
    m = t.column("m").to_numpy()
    cuts = np.r_[np.flatnonzero(np.r_[True, m[1:] != m[:-1]]), len(m)]
    k = 0
    while k < len(cuts) - 1:  # some whole tokens at a time
        j = max(k + 1, int(np.searchsorted(cuts, cuts[k] + 8192, "right")) - 1)
        data, at, g, d, h, s = _spread(t.slice(cuts[k], cuts[j] - cuts[k]))
        o = np.lexsort((s, h, d))
        at, g, d, h, s = (x[o] for x in (at, g, d, h, s))
        # a repeated row brings the very same place again
        o = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        at, g, d, h, s = (x[o] for x in (at, g, d, h, s))
        order, new = _sorted_windows(data, at, g)
        again = order[~new]
        yield pa.RecordBatch.from_arrays(_intervals(d[again], h[again], s[again]), ["d", "h", "a", "b"])
        k = j


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to a row a window: (m, w, d, h, s)."""
    for b in batches:
        if b.num_rows:
            data, at, m, d, h, s = _spread(pa.Table.from_batches([b]))
            text = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array([text[x : x + LENGTH] for x in at.tolist()], pa.binary()), pa.array(d), pa.array(h), pa.array(s)], ["m", "w", "d", "h", "s"])


def cuts(keyed: DataFrame, hot: int | None = None) -> DataFrame:
    """(_sa_d, _sa_h, _sa_a, _sa_b): a row a document with the intervals that earlier documents have."""
    repeats, edges = candidates(keyed)
    many = edges.groupBy("m").agg(F.count("*").alias("c")).filter(F.col("c") > (HOT if hot is None else hot)).select(F.col("m").alias("hm"))
    any_hot = not many.isEmpty()
    # without hot tokens, which is the rule, nothing has to meet by token to learn that
    edges = edges.join(many, F.col("m") == F.col("hm"), "left").withColumn("hot", F.col("hm").isNotNull()) if any_hot else edges.withColumn("hot", F.lit(False))
    by_doc = edges.groupBy(F.col("d").alias("_sa_ed"), F.col("h").alias("_sa_eh")).agg(F.collect_list(F.struct("m", "hot", "s", "n")).alias("_sa_edges"))
    joined = keyed.join(by_doc, (F.col("_sa_d") == F.col("_sa_ed")) & (F.col("_sa_h") == F.col("_sa_eh")))
    rows = joined.mapInArrow(lean(_edge_bytes), "m long, hot boolean, d long, h long, s long, data binary")
    n = parts_for(keyed)
    cold = (rows.filter("NOT hot") if any_hot else rows).repartition(n, "m").mapInArrow(lean(_cold), CUT)
    w = rows.filter("hot").mapInArrow(lean(_hot), "m long, w binary, d long, h long, s long")
    place = F.struct("d", "h", "s")
    least = w.groupBy(F.col("m").alias("lm"), F.col("w").alias("lw")).agg(F.min(place).alias("least"))
    again = w.join(least, (F.col("m") == F.col("lm")) & (F.col("w") == F.col("lw"))).filter(place > F.col("least"))
    warm = again.select("d", "h", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("b"))
    whole = repeats.select("d", "h", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + LENGTH).alias("b"))
    every = whole.unionByName(cold)
    if any_hot:
        every = every.unionByName(warm)
    lists = every.groupBy(F.col("d").alias("_sa_cd"), F.col("h").alias("_sa_ch")).agg(F.collect_list(F.struct("a", "b")).alias("_sa_cuts"))
    return lists


def _own_repeats(text: bytes) -> Iterator[np.ndarray]:
    """Starts of windows that also start earlier in the text, by their hashes; a share of the hashes at a time, which bounds memory for very long texts."""
    n = len(text) - LENGTH + 1
    shares = max(1, -(-n // (4 * CHUNK)))
    for share in range(shares):
        w, at = [], []
        for a in range(0, n, CHUNK):
            h = _hashes(np.frombuffer(text, np.uint8, min(CHUNK + LENGTH - 1, len(text) - a), a))[1]
            mine = np.arange(len(h)) if shares == 1 else np.flatnonzero(h % np.uint64(shares) == share)
            w.append(h[mine])
            at.append((mine + a).astype(np.uint32 if n < 1 << 32 else np.int64))
        h, place = (x[0] if len(x) == 1 else np.concatenate(x) for x in (w, at))
        del w, at
        plain = np.sort(h)
        if (plain[1:] == plain[:-1]).any():
            del plain
            o = np.argsort(h, kind="stable")
            yield np.sort(place[o[1:][h[o][1:] == h[o][:-1]]].astype(np.int64))


def kept_bytes(text: bytes, cut: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the intervals and without windows that it repeats itself, and the number of maximal removed runs."""
    if len(text) < LENGTH:
        return text, 0
    spans = [(a, b) for a, b in cut]
    for again in _own_repeats(text):
        new = np.flatnonzero(np.r_[True, again[1:] > again[:-1] + LENGTH])
        spans += zip(again[new].tolist(), (again[np.r_[new[1:], len(again)] - 1] + LENGTH).tolist(), strict=True)
    left, runs, at, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            left.append(text[at:a])
            runs += 1
        at = end = max(end, b)
    left.append(text[at:])
    return b"".join(left), runs


def _pairs(cuts: pa.Scalar) -> list[tuple[int, int]]:
    return [(x["a"], x["b"]) for x in cuts.as_py() or ()]


def keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_sa_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long"))).withColumn("_sa_h", F.xxhash64(t))


def with_cuts(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """docs with _sa_cuts, null for none."""
    k = keyed(docs)
    return k.join(cuts(k, hot), (F.col("_sa_d") == F.col("_sa_cd")) & (F.col("_sa_h") == F.col("_sa_ch")), "left")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return digest(with_cuts(read(spark, sf_dir, "documents").select("doc_id", "text")))


def digest(d: DataFrame) -> DataFrame:
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, c in zip(b.column(1), b.column(2), strict=True):
                t = _encoded(t)
                kept, spans = kept_bytes(t, _pairs(c))
                rows.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return d.select("doc_id", "text", "_sa_cuts").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text (halves of characters at the cuts go too) and, if there, its n_chars."""
    cols = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in cols if c != "text"]).alias("row")
    d = with_cuts(docs.select(rest, "doc_id", "text")).select("row", "text", "_sa_cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for t, c in zip(b.column(1), b.column(2), strict=True):
                left.append(kept_bytes(_encoded(t), _pairs(c))[0].decode("utf-8", "ignore") if t.is_valid else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, b.schema.field(1).type)], ["row", "text"])

    out = d.mapInArrow(lean(run), d.drop("_sa_cuts").schema)
    back = {c: F.col(f"row.`{c}`") for c in cols if c != "text"} | {"text": F.col("text")}
    if "n_chars" in cols:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[back[c].alias(c) for c in cols])


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated bytes."""
    return deduplicated(docs)
