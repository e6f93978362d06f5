"""SimHash components and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvtide.llm import simhash as S
from kvtide.llm import suffix_dedup as D

# ---- SimHash


def plain_fp(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(q.encode(), 42) for q in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\naAbBéÉ日x\x1c\u00a0", max_size=60))
def test_fingerprint(t):
    assert S.fingerprint(t) == plain_fp(t)


def test_long_text_in_chunks(monkeypatch):
    t = " ".join(f"w{i % 50}" for i in range(2000))
    want = S.fingerprint(t)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(t) == want == plain_fp(t)


def plain_components(ids, fps):
    f, lab = np.array(fps, np.uint64), np.arange(len(fps))
    while True:
        new = lab.copy()
        for i in range(len(f)):
            new[i] = lab[np.bitwise_count(f ^ f[i]) <= 3].min()
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return {int(x): min((i for i, y in zip(ids, lab, strict=True) if y == x and i is not None), default=None) for x in set(lab.tolist())}, lab


@pytest.mark.parametrize(("bucket", "deal"), [(4096, 1 << 15), (4, 1 << 15), (4096, 7)])
def test_components(spark, monkeypatch, bucket, deal):
    """Chains, a dense cluster, far groups and random ones; with small buckets the second level is used, and parts are dealt over tasks."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "DEAL", deal)
    r = random.Random(7)
    fps = [0, 0, (1 << 64) - 1]
    x = r.getrandbits(64)
    for _ in range(40):  # a chain of links of up to three bits
        fps.append(x)
        for _ in range(r.choice([1, 2, 3])):
            x ^= 1 << r.randrange(64)
    center = r.getrandbits(64)
    fps += [center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)]
    for _ in range(150):
        y = r.getrandbits(64)
        fps += [y, y ^ sum(1 << b for b in r.sample(range(64), r.choice([3, 4])))]
    ids = list(range(1000, 1000 + len(fps)))
    r.shuffle(ids)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)]
    got = {x.doc_id: x.component_id for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    low, lab = plain_components(ids, fps)
    assert got == {i: low[int(x)] for i, x in zip(ids, lab, strict=True)}


def test_tiles_agree_with_brute_force(monkeypatch):
    monkeypatch.setattr(S, "TILE", 5)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 6).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 30, 3)]))
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    got = S._local_roots(fp[:, None])
    _, lab = plain_components(list(range(len(fp))), fp.tolist())
    assert (got == lab).all()


def test_odd_documents(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (8, "one two"), (None, "One TWO"), (9, "one two three four")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = S.near_duplicates(S.fingerprints(df)).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[6] == by[7] == {5} and by[8] == {8} and by[None] == {8} and by[9] == {9}
    assert S.near_duplicates(S.fingerprints(df.filter("false"))).count() == 0
    kept = S.stage_simhash(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 8, 9]


def test_distinct_documents_that_share_an_id_stay(spark):
    """Null and repeated ids: a row of each component stays, not of each id."""
    r = random.Random(7)
    t = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (1, t[2]), (2, t[2]), (2, t[3]), (3, t[4]), (3, t[4])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, fp int")
    kept = S.stage_simhash(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, t.index(r.text)) for r in kept.collect()) == [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4)]


def varied(r, words, share):
    return " ".join(f"n{r.randrange(10**6)}" if r.random() < share else w for w in words)


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("deal", [1 << 15, 5])
def test_stage_keeps_one_of_each_component(spark, monkeypatch, deal):
    """Against brute force over all pairs: five words, 0.8 by the wide fingerprints, and by exact similarity outside their error."""
    monkeypatch.setattr(S, "DEAL", deal)
    r = random.Random(11)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 200, 600]))]
        texts += [varied(r, words, x) for x in (0, 0.004, 0.01, 0.02, 0.05, 0.2)]
    texts += ["", "one two", "one two", " ", "one two three"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in S.stage_simhash(spark, df, "").collect()}
    fp = np.frombuffer(b"".join(S.wide_fingerprint(t)[0] for t in texts), np.uint64).reshape(len(texts), -1)
    near = S._distance(fp, fp) <= S.radius_of(0.8, 512)
    lab = np.arange(len(texts))
    while (new := np.array([lab[row].min() for row in near])).tolist() != lab.tolist():
        lab = new
    assert kept == {min(i for i, y in zip(ids, lab, strict=True) if y == x) for x in set(lab.tolist())}
    sets = [shingles(t) for t in texts[:120]]
    exact = np.array([[jaccard(a, b) for b in sets] for a in sets])
    est = near[:120, :120]
    assert est[exact >= 0.9].all() and not est[exact < 0.5].any() and est[exact >= 0.8].mean() > 0.97


def test_bands_of_similar_texts_meet():
    r = random.Random(5)
    met = []
    for _ in range(400):
        a = [f"w{r.randrange(10**6)}" for _ in range(300)]
        b = varied(r, a, 0.021)
        if jaccard(shingles(" ".join(a)), shingles(b)) >= 0.78:
            met.append(any(x == y for x, y in zip(S.wide_fingerprint(" ".join(a))[1], S.wide_fingerprint(b)[1], strict=True)))
    assert len(met) > 150 and sum(met) >= 0.995 * len(met)


def test_wide_fingerprint_in_chunks(monkeypatch):
    t = " ".join(f"w{i % 700}" for i in range(3000))
    want = S.wide_fingerprint(t)
    monkeypatch.setattr(S, "CHUNK", 11)
    monkeypatch.setattr(S, "WIDE", 4)
    assert S.wide_fingerprint(t) == want


# ---- suffix dedup


def plain_dedup(docs, length=100):
    """docs in order; every window in a set."""
    seen, out = set(), []
    for t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            else:
                seen.add(w)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéñ") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randrange(15, 60)) for _ in range(4)]
    docs = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 350, "xy" * 200, "z" * 1000]
    for _ in range(40):
        parts = [text(r.randrange(0, 40)) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passages))
        if r.random() < 0.3:
            parts.insert(1, parts[-1])
        docs.append(" ".join(parts))
    for _ in range(12):  # near copies
        d = list(r.choice(docs[8:30]))
        d[r.randrange(len(d))] = "#"
        docs.append("".join(d))
    docs += [docs[10], docs[11], "pre " + docs[12], docs[12][1:]]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "hot", "parts"), [(1, None, 4), (2, 1, 4), (3, None, 40), (4, 3, 40), (5, None, 1)])
def test_suffix_dedup(spark, seed, hot, parts):
    docs = corpus(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
        got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.with_cuts(df, hot)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i] for i in range(len(docs))] == plain_dedup(docs)


def test_one_hot_passage(spark):
    """A passage in every document, at the ends and in the middle."""
    p = " ".join(f"passage{i}" for i in range(40))
    docs = [f"{'a' * (i % 7)} {p} {i}" for i in range(300)] + [p] * 50
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.with_cuts(df)).collect()}
    assert [got[i] for i in range(len(docs))] == plain_dedup(docs)


def test_long_text_in_pieces(monkeypatch, spark):
    t = " ".join(f"w{i % 300}" for i in range(900))
    monkeypatch.setattr(D, "CHUNK", 64)
    m, span, s, n = D.runs(t.encode())
    assert n.sum() == len(t) - 99 and (np.diff(s) == n[:-1]).all()
    kept, spans = D.kept_bytes(t.encode(), [])
    assert (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()) == plain_dedup([t])[0]


def test_odd_rows(spark):
    t, u = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(2, t), (2, t), (None, u), (3, u), (2, u), (4, t + u)]
    df = spark.createDataFrame([(i, x, "k", len(x), 1) for i, x in rows], "doc_id long, text string, m string, n_chars long, kind int")
    got = D.deduplicated(df)
    assert got.columns == df.columns
    left = sorted((r.doc_id or -1, len(r.text), r.n_chars) for r in got.collect())
    # a repeated row is the same document; a null id comes first; the same id with another text is a document too
    assert [(a, b) for a, b, _ in left][:5] == [(-1, len(u)), (2, 0), (2, len(t)), (2, len(t)), (3, 0)]
    assert all(b == c for _, b, c in left)
    assert D.deduplicated(df.filter("false")).count() == 0 and D.digest(D.with_cuts(df.filter("false"))).count() == 0


def test_multikey_sort():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 500).astype(np.uint8)
    data = np.concatenate([data, data[:300]])
    at = np.arange(len(data) - 99)
    group = at % 2
    order, new = D._sorted_windows(data, at, group)
    keys = [(group[k], data[k : k + 100].tobytes()) for k in order]
    assert keys == sorted(keys) and new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:], strict=False)]


def test_decisions_on_utf8(spark):
    """What is left is text even if a cut falls within a character."""
    t = "é" * 200
    df = spark.createDataFrame([(1, t), (2, "a" + t)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in D.deduplicated(df).collect()}[2].strip("é") in ("a", "")
    assert D.keyed(df).filter(F.col("_sa_h").isNull()).count() == 0
