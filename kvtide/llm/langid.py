"""Language identification by a byte convolutional network trained here in numpy.

Bytes are folded to 128 classes. A text is cut into windows of ``WINDOW``
bytes, all of them used; in each, filters of widths 2, 4 and 6 at
every byte are max-pooled, rectified and fed to a softmax. A document's prediction
has the highest mean probability over its windows. Since a filter is a sum over
its bytes, prediction looks byte pairs up in a table of 16384 rows.

Training takes at most ``PER_LANG`` documents a language and ``SAMPLE`` in all
(documented parameters), with ``PER_DOC`` windows of each spread over the text:
those of lowest hash among documents outside the held-out fold. Order and
seeds are fixed, so reruns agree.

Defined cases: null text and text without a letter give ``und`` with score 0;
rows with a null language are never learned from; without any training row
all are ``und``; a null doc_id is hashed as the empty text; repeated rows
each get a row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, read

FOLDS, HELD = 5, 0
WINDOW, WIDTHS, FILTERS = 256, (2, 4, 6), 16
PER_LANG, SAMPLE, PER_DOC = 500, 8192, 8
EPOCHS, BATCH, RATE = 6, 64, 3e-3
CLASSES = 128
#: Windows worked on at a time, and bytes of text gathered for that.
AT_ONCE, CHUNK = 512, 1 << 21
NEVER = -1e4


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 padding, letters without case, digits together, the bytes of longer characters apart."""
    c = np.ones(256, np.uint8)
    c[[9, 10, 11, 12, 13, 32]] = 2
    c[48:58] = 3
    c[33:48] = c[58:65] = 4
    for i in range(26):
        c[65 + i] = c[97 + i] = 5 + i
    c[128:192] = 32 + np.arange(64)
    c[192:256] = 96 + np.arange(64) // 2
    return c


TABLE = byte_classes()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all windows of the texts, padded with 0, and the number of windows of each text."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    for t, at in zip(texts, (np.cumsum(n) - n).tolist(), strict=True):
        out[at * WINDOW : at * WINDOW + len(t)] = TABLE[np.frombuffer(t, np.uint8)]
    return out.reshape(-1, WINDOW), n


class Network:
    """Filters by width (width, class, filter), and the softmax layer."""

    def __init__(self, langs: list[str], p: dict[str, np.ndarray] | None = None, seed: int = 7) -> None:
        self.langs = langs
        if p is not None:
            self.p = p
            return
        r = np.random.default_rng(seed)
        self.p = {f"w{w}": r.normal(0, 0.5 / w, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.p |= {"u": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"][:, 0] = NEVER

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.p["u"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross entropy on a batch of windows."""
        pooled, best = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            pre = sum(self.p[f"w{w}"][k][x[:, k : k + n]] for k in range(w)) + self.p[f"b{w}"]
            best.append(pre.argmax(1))
            pooled.append(np.take_along_axis(pre, best[-1][:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        hidden = np.maximum(z, 0)
        d = self._softmax(hidden)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"u": hidden.T @ d, "c": d.sum(0)}
        back = (d @ self.p["u"].T) * (z > 0)
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        for j, w in enumerate(WIDTHS):
            dj = back[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"b{w}"] = dj.sum(0)
            gw = np.zeros_like(self.p[f"w{w}"])
            for k in range(w):
                np.add.at(gw[k], (x[rows, best[j] + k], np.broadcast_to(cols, dj.shape)), dj)
            gw[:, 0] = 0
            g[f"w{w}"] = gw
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Adam on shuffled batches, languages weighted alike by drawing them alike."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        share = 1.0 / np.bincount(y, minlength=len(self.langs))[y]
        share /= share.sum()
        steps = EPOCHS * max(1, len(x) // BATCH)
        for t in range(1, steps + 1):
            at = r.choice(len(x), BATCH, p=share)
            rate = RATE * (1 - 0.9 * t / steps)
            for k, g in self.step(x[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width a table a byte pair of the filter: (pair, filter)."""
        out = {}
        for w in WIDTHS:
            f = self.p[f"w{w}"]
            out[w] = [np.ascontiguousarray((f[k][:, None] + f[k + 1][None] + (self.p[f"b{w}"] if k == 0 else 0)).reshape(-1, FILTERS).astype(np.float32)) for k in range(0, w, 2)]
        return out

    def predict(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), AT_ONCE):
            c = x[a : a + AT_ONCE]
            pair = c[:, :-1].astype(np.intp) * CLASSES + c[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                pre = np.take(tables[w][0], pair[:, :n], axis=0)
                for k, t in enumerate(tables[w][1:], 1):
                    pre += np.take(t, pair[:, 2 * k : 2 * k + n], axis=0)
                while pre.shape[1] > 1:  # halves, so that the maximum runs over long rows
                    half = pre.shape[1] // 2
                    low = np.maximum(pre[:, :half], pre[:, half : 2 * half])
                    if pre.shape[1] % 2:
                        low[:, 0] = np.maximum(low[:, 0], pre[:, -1])
                    pre = low
                pooled.append(pre[:, 0])
            out[a : a + AT_ONCE] = self._softmax(np.maximum(np.concatenate(pooled, 1), 0))
        return out


def train(docs: DataFrame) -> Network | None:
    """A network fitted on a bounded sample of docs (doc_id, text, lang), of those outside the held-out fold."""
    mine = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    ok = mine.filter(F.col("text").rlike(r"\p{L}"))
    # a threshold on the hash leaves some PER_LANG rows of each frequent language, so that few meet to be ranked
    many = mine.select("lang").groupBy("lang").count().filter(F.col("count") > 4 * PER_LANG).orderBy(F.desc("count"), "lang").limit(1000).collect()
    pairs = [F.lit(x) for r in many for x in (r["lang"], 4.0 * PER_LANG / r["count"])]
    share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(1.0)) if pairs else F.lit(1.0)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    hashed = ok.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = hashed.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).withColumn("n", rank).filter(F.col("n") <= PER_LANG)
    ids = ids.orderBy("n", "lang").limit(SAMPLE).select(F.col("doc_id").alias("i"), F.col("lang").alias("l")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, data = [], []
            for t, code in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py().encode("utf-8", "surrogatepass")
                n = -(-len(t) // WINDOW)
                for k in sorted({round(z) for z in np.linspace(0, n - 1, PER_DOC)}):
                    lang.append(code.as_py())
                    data.append(t[k * WINDOW : (k + 1) * WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary())], ["lang", "data"])

    # at most SAMPLE ids, so their broadcast is bounded
    picked = ok.join(F.broadcast(ids), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l"))).select("text", "lang")
    cuts = picked.mapInArrow(lean(cut), "lang string, data binary")
    # repeated rows can be more than the sample: the windows of lowest hash, so that reruns agree
    got = cuts.orderBy(F.xxhash64("data", "lang"), "data", "lang").limit(SAMPLE * PER_DOC).toArrow().sort_by([("lang", "ascending"), ("data", "ascending")])
    if not len(got):
        return None
    spoken = got["lang"].to_pylist()
    langs = sorted(set(spoken))
    x, n = windows(got["data"].to_pylist())
    y = np.repeat([langs.index(c) for c in spoken], n)
    return Network(langs).fit(x, y)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(letters, F.col("text")).alias("text"))
    if net is None:
        return d.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    # plain data, so that executors needn't have this module to read it
    shared = docs.sparkSession.sparkContext.broadcast((net.langs, net.p, net.tables()))

    def means(net: Network, texts: list[bytes]) -> np.ndarray:
        tables = shared.value[2]
        x, n = windows(texts)
        sums = np.add.reduceat(net.predict(x, tables).astype(np.float64), np.cumsum(n) - n, axis=0)
        return sums / n[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shared.value[:2])
        for b in batches:
            lang, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            at, held, size = [], [], 0

            def flush() -> None:
                if held:
                    for i, p in zip(at, means(net, held), strict=True):
                        lang[i], score[i] = net.langs[int(p.argmax())], min(1.0, float(p.max()))
                at.clear()
                held.clear()

            for i, t in enumerate(b.column(2)):
                if (t := t.as_py()) is not None:
                    at.append(i)
                    held.append(t.encode("utf-8", "surrogatepass"))
                    size += len(held[-1])
                    if size > CHUNK:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score."""
    d = read(spark, sf_dir, "documents")
    return predict(d.select("doc_id", "text"), train(d.select("doc_id", "text", "lang")))
