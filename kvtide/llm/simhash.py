"""SimHash near-duplicates: fingerprints in one pass, tiled exact comparison, components.

1. A fingerprint a text (Arrow batches; xxhash and numpy bit sums), of 64 bits or of
   ``lanes`` times 64, each lane from another mix of the shingles' hashes.
2. Equal fingerprints become one class. All later work is on
   distinct fingerprints, so copies never meet as pairs.
3. Buckets. Within ``RADIUS`` = 3 of 64 bits, two fingerprints agree on one of 4
   blocks of 16 bits at least: each goes to 4 buckets. Buckets above ``BUCKET``
   members go on to 16 buckets each by 4 blocks of 12 of the other 48 bits, by
   the same argument, so no link is lost. The pipeline's stage works by
   similarity instead (below); a radius of that width leaves no whole block, so its
   buckets are bands of ``BAND`` shingles of least (or largest) hash.
4. In a bucket, members sorted by population count are compared tile by tile with
   numpy XOR and bit counts; tiles whose counts differ by more than the radius are
   skipped. A component grows from a seed, and only what it has not reached yet is
   compared with what it reached last. A bucket emits a link from each member to the first
   of its local component, never all pairs. Buckets above ``DEAL`` members are cut into
   parts, and pairs of parts are dealt over tasks.
5. Components by min-label propagation with pointer jumping, every round a
   written table; nothing is collected.

The stage. Shingles of ``STAGE_WORDS`` = 5 words, a similarity of ``SIMILARITY`` = 0.8 or more.
A bit of two SimHashes differs with probability angle / pi, and sets of
Jaccard similarity J have a cosine of 2 J / (1 + J), so J = 0.8 is 15.15 % of the bits. With
``LANES`` = 8, 512 bits, the estimate of J has a standard error of 0.03; the radius is two of them
wider, so 97.7 % of pairs of J = 0.8, and half of those of 0.745, are within. Two texts of
J = 0.8 share a band of 3 with probability 0.512, and one of 10 with 0.9992.

Defined cases: null and empty texts have fingerprint 0, linked like any other;
a null doc_id counts only if a class has no other (its id is then null);
repeated rows each get a row; an empty table gives an empty result; the query reads
only doc_id and text, and the stage brings other columns of any name back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, lean, parts_for, read, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Of the stage: words of a shingle, least similarity, fingerprint words of 64 bits, shingles of a band, bands.
STAGE_WORDS, SIMILARITY, LANES, BAND, BANDS = 5, 0.8, 8, 3, 10
#: Members of a bucket above which it is refined, of a tile, of a group compared all at once, and of a part dealt to a task.
BUCKET, TILE, SMALL, DEAL = 4096, 512, 8, 1 << 15
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK, WIDE = 1 << 16, 1 << 13
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = (np.cumprod(np.r_[np.uint64(1), np.full(1 << 15, x, np.uint64)]) for x in (_BASE, _INVERSE))
_BYTES = np.random.default_rng(21).integers(0, 1 << 64, 256, dtype=np.uint64)
_LANE = np.random.default_rng(64).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits of sets with a Jaccard similarity, and two standard errors more, so that nearly all of that similarity are within."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(p * bits + 2 * math.sqrt(p * (1 - p) * bits) + 0.5)


def _shingles(text: str | None, size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The normalized text, and first and last places of its shingles, CHUNK at a time; fewer words than size are one shingle."""
    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    size = min(size, len(gaps) + 1)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(norm)]
    n = len(starts) + 1 - size
    for k in range(0, n, CHUNK):
        m = min(CHUNK, n - k)
        yield norm, starts[k : k + m], ends[k + size - 1 : k + size - 1 + m]


def _bit_sums(x: np.ndarray) -> np.ndarray:
    """How often each bit is set in each row of words, summed in bytes as long as they don't overflow."""
    bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).ravel(), bitorder="little").reshape(*x.shape, 64)
    whole = x.shape[1] // 255 * 255
    out = bits[:, whole:].sum(1, dtype=np.uint8).astype(np.int64)
    return out + bits[:, :whole].reshape(len(x), -1, 255, 64).sum(2, dtype=np.uint8).sum(1, dtype=np.int64) if whole else out


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text by XXH64 of its shingles, unsigned; 0 for none."""
    n, sums, h = 0, np.zeros((1, 64), np.int64), xxhash.xxh64_intdigest
    for norm, starts, ends in _shingles(text, size):
        n += len(starts)
        sums += _bit_sums(np.array([[h(norm[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]], np.uint64))
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _rolled(norm: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of a text from sums of its bytes' values times powers, modulo 2 ** 64."""
    low, n = starts[0], ends[-1] - starts[0]
    powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) if n >= len(y) else y for x, y in ((_BASE, _POWERS), (_INVERSE, _INVERSES)))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[np.frombuffer(norm, np.uint8, n, low)] * powers[:n])]
    return (sums[ends - low] - sums[starts - low]) * inverse[starts - low]


def wide_fingerprint(text: str | None, size: int = STAGE_WORDS, lanes: int = LANES, bands: int = BANDS, band: int = BAND) -> tuple[bytes, list[int]]:
    """The fingerprint of lanes words, and the keys of the text's bands: shingles that are least or largest by one half of a lane."""
    n, sums = 0, np.zeros((lanes, 64), np.int64)
    least, most = np.full((lanes, 2), 0xFFFFFFFF, np.uint32), np.zeros((lanes, 2), np.uint32)
    for norm, starts, ends in _shingles(text, size):
        n += len(starts)
        every = _rolled(norm, starts, ends)
        for k in range(0, len(every), WIDE):
            x = every[None, k : k + WIDE] * _LANE[:lanes, None]
            x = (x ^ (x >> np.uint64(32))) * _LANE[lanes : 2 * lanes, None]
            x ^= x >> np.uint64(29)
            sums += _bit_sums(x)
            halves = np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint32).reshape(lanes, -1, 2).transpose(0, 2, 1))
            least, most = np.minimum(least, halves.min(2)), np.maximum(most, halves.max(2))
    fp = np.packbits(2 * sums > n, axis=1, bitorder="little").tobytes()
    flat = np.concatenate([least.T, most.T]).tobytes()
    return fp, [xxhash.xxh64_intdigest(flat[4 * k * band : 4 * (k + 1) * band], k) - (1 << 63) for k in range(bands)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of a with each of b, fingerprints of one or more words."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def _local_roots(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For fingerprints (n, words) sorted by population count: the index of the first member of each one's component."""
    n, pops = len(fp), np.bitwise_count(fp).sum(1, dtype=np.int64)
    root, left = np.full(n, -1), np.arange(n)  # left: not reached yet, in order of population count
    while len(left):
        seed = left[0]
        root[seed], left, last = seed, left[1:], np.array([seed])
        while len(last) and len(left):
            reached = []
            for a in range(0, len(last), TILE):
                tile = last[a : a + TILE]
                lo = np.searchsorted(pops[left], pops[tile[0]] - radius)
                hi = np.searchsorted(pops[left], pops[tile[-1]] + radius, "right")
                hit = np.zeros(len(left), bool)
                for c in range(lo, hi, TILE):
                    other = left[c : min(c + TILE, hi)]
                    hit[c : c + len(other)] = (_distance(fp[tile], fp[other]) <= radius).any(0)
                reached.append(left[hit])
                left = left[~hit]
            last = np.sort(np.concatenate(reached))
            root[last] = seed
    return root


def _links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints (n, words) within equal keys, a row a member at most for large groups."""
    pops = np.bitwise_count(fp).sum(1, dtype=np.int64)
    order = np.lexsort((*fp.T, pops, key))
    key, fp = key[order], fp[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    small = np.repeat(size <= SMALL, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(SMALL, len(key))):  # small groups all at once, by distance in the order
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        at = at[np.bitwise_count(fp[at + d] ^ fp[at]).sum(1, dtype=np.int64) <= radius]
        left.append(order[at + d])
        right.append(order[at])
    for g in np.flatnonzero(size > SMALL):
        mine = order[cut[g] : cut[g + 1]]
        root = _local_roots(fp[cut[g] : cut[g + 1]], radius)
        at = np.flatnonzero(root != np.arange(len(mine)))
        left.append(mine[at])
        right.append(mine[root[at]])
    return np.concatenate(left), np.concatenate(right)


def _tiled(radius: int, words: int):
    """A partition's buckets, (k1, k2, node, fp), to links (a, b) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        k1, k2, node = (t.column(i).to_numpy() for i in range(3))
        if words == 1:
            fp = t.column(3).to_numpy().view(np.uint64)[:, None]
        else:
            fp = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(-1, words)
        order = np.lexsort((k2, k1))
        key = np.zeros(len(k1), np.int64)
        key[order] = np.cumsum(np.r_[False, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])
        a, b = _links(key, fp, radius)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def _compared(buckets: DataFrame, n: int, radius: int, words: int) -> DataFrame:
    """Links (a, b) within buckets (k1, k2, node, fp); buckets above DEAL are dealt over tasks by pairs of parts."""
    large = written(buckets.groupBy("k1", "k2").count().filter(F.col("count") > DEAL).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.ceil(F.col("count") / DEAL).alias("parts")), "large-buckets")
    if not large.isEmpty():
        j = buckets.join(large, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
        mine = F.pmod(F.xxhash64("node"), F.col("parts"))
        # a part meets every part, itself included, in a task of their own
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.least(mine, q) * F.col("parts") + F.greatest(mine, q))
        spread = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pair))
        buckets = j.select(F.col("k1"), F.col("k2"), "node", "fp", spread.alias("pair")).select(F.xxhash64("k1", "k2", "pair").alias("k1"), "k2", "node", "fp")
    return buckets.repartition(n, "k1", "k2").mapInArrow(lean(_tiled(radius, words)), "a long, b long").distinct()


def _block(fp: Column, at: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, at.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (node, fp) that connect all within RADIUS bits of 64."""
    n = parts_for(classes, 4 * classes.count())
    four = F.array(*[F.lit(i) for i in range(4)])
    one = classes.select("node", "fp", F.explode(four).alias("i"))
    one = one.select("node", "fp", "i", (_block(F.col("fp"), F.col("i") * 16, 16) * 4 + F.col("i")).alias("k1"))
    full = one.groupBy("k1").count().filter(F.col("count") > BUCKET).select(F.col("k1").alias("hot"))
    one = one.join(full, F.col("k1") == F.col("hot"), "left")
    # the other 48 bits: those above the block come down onto it
    low = F.col("fp").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") * 16).cast("int")) - 1)
    high = F.call_function("shiftleft", F.when(F.col("i") == 3, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("fp"), (F.col("i") * 16 + 16).cast("int"))), (F.col("i") * 16).cast("int"))
    rest = one.withColumn("rest", low.bitwiseOR(high))
    cold = rest.filter("hot IS NULL").select("k1", F.lit(-1).cast("long").alias("k2"), "node", "fp")
    fine = rest.filter("hot IS NOT NULL").select("k1", "node", "fp", "rest", F.explode(four).alias("j"))
    fine = fine.select("k1", (_block(F.col("rest"), F.col("j") * 12, 12) * 4 + F.col("j")).alias("k2"), "node", "fp")
    return _compared(cold.unionByName(fine), n, RADIUS, 1)


def similar(classes: DataFrame, similarity: float, lanes: int) -> DataFrame:
    """(a, b): links between distinct wide fingerprints (node, fp, bands) that connect those of a similarity and a common band."""
    n = parts_for(classes, BANDS * classes.count())
    keyed = classes.select("node", "fp", F.posexplode("bands").alias("k2", "k1"))
    return _compared(keyed.select("k1", F.col("k2").cast("long").alias("k2"), "node", "fp"), n, radius_of(similarity, 64 * lanes), lanes)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for nodes with an edge (a, b)."""
    e = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        got = e.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(got, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = label.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        new = new.join(up, F.col("label") == F.col("p"), "left").select("node", "old", F.least("label", "pl").alias("label"))
        new = written(new, "labels")
        label = new.select("node", "label")
        if new.filter("label < old").isEmpty():
            return label


def rooted(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes, a written table of distinct nodes; adds root, the same for all of a component."""
    label = components(edges).withColumnRenamed("node", "ln")
    return classes.join(label, F.col("node") == F.col("ln"), "left").withColumn("root", F.coalesce("label", "node")).drop("ln", "label")


def near_duplicates(fps: DataFrame) -> DataFrame:
    """fps: (doc_id, fp), best a written table; adds component_id."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("node", F.col("fp")), "classes")
    c = rooted(classes, links(classes.select("node", "fp")))
    # min over the whole component; a component is small beside the table, and its rows are pre-aggregated
    ids = c.groupBy("root").agg(F.min("rep").alias("component_id"))
    by = c.select("fp", "root").join(ids, "root").select(F.col("fp").alias("cfp"), "component_id")
    return fps.join(by, F.col("fp") == F.col("cfp")).drop("cfp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id."""
    fps = written(fingerprints(read(spark, sf_dir, "documents")), "fingerprints")
    return near_duplicates(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprints(docs: DataFrame, size: int, lanes: int) -> DataFrame:
    """(id, hash, fp, bands) of docs (id, hash, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [wide_fingerprint(t.as_py(), size, lanes, BANDS, BAND) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.list_(pa.int64()))], ["id", "hash", "fp", "bands"])

    return docs.select("id", "hash", "text").mapInArrow(lean(run), f"id {kind}, hash string, fp binary, bands array<long>")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = STAGE_WORDS, similarity: float = SIMILARITY, lanes: int = LANES) -> DataFrame:
    """One row of each component of texts stays, of its smallest doc_id (null if it has no other). Rows are told apart by doc_id and text.

    Texts with equal fingerprints are one class, whatever their ids; two rows with the same
    id and different texts are two documents, and so are rows without an id.
    """
    d = boxed(docs).select("row", F.col("row.doc_id").alias("id"), F.coalesce(F.md5("row.text"), F.lit("")).alias("hash"))
    fps = wide_fingerprints(d.select("id", "hash", "row.text"), size, lanes)
    # partial sums before every shuffle, so a component of any size is no skew
    least = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    classes = fps.groupBy("fp").agg(F.min(F.struct(least.alias("least"), "bands")).alias("m"))
    classes = written(classes.select("fp", "m.least", "m.bands").withColumn("node", F.monotonically_increasing_id()), "classes")
    c = rooted(classes.select("node", "least"), similar(classes, similarity, lanes))
    keep = c.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.hash")
    # one key without nulls for the join and the window, so that texts are shuffled once
    keyed = lambda x: x.withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    key = ["none", "id", "hash"]
    kept = keyed(d).join(keyed(keep).select(*key), key, "left_semi")
    # rows equal in doc_id and text
    first = W.partitionBy(*key).orderBy("row.text")
    return kept.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")
