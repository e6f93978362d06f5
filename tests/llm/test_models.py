"""Language identification, PPM scores, piece encoding and top-k search against brute force, held-out accuracy and round trips."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvtide.llm import langid, mtree, pieces, ppm

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")

# ---- language identification


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def babble(r, stems):
    return " ".join(r.choice(stems) + r.choice(stems) for _ in range(r.randrange(30, 200)))


def test_language_identification(spark):
    r = random.Random(2)
    stems = {"xx": ["tion", "the", "ing", "wh"], "yy": ["sch", "keit", "über", "ß"], "zz": ["ción", "ñó", "rr", "os"]}
    rows = [(i, babble(r, stems[c]), c) for i in range(300) for c in [r.choice("x" * 8 + "y" * 2 + "z") * 2]]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !? 456", "yy"), (1003, babble(r, stems["yy"]), None), (1003, babble(r, stems["yy"]), None), (None, "the tion ing", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = df.withColumn("score", F.lit(9))
    got = langid.predict(d.select("doc_id", "text"), langid.train(d)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == (fold(x.doc_id) == 0) for x in got if x.doc_id is not None)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "yy"
    held = [(x.lang_pred, c) for x, (_, _, c) in ((by[row[0]], row) for row in rows[:300]) if x.held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert [(x.lang_pred, x.score) for x in langid.predict(df, None).collect()] == [("und", 0.0)]
    assert langid.predict(df.filter("false"), None).count() == 0


def test_network_gradients():
    net = langid.Network(["a", "b"], seed=1)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    r = np.random.default_rng(0)
    x, y = r.integers(1, 128, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        pooled = []
        for w in langid.WIDTHS:
            n = langid.WINDOW - w + 1
            pooled.append((sum(net.p[f"w{w}"][k][x[:, k : k + n]] for k in range(w)) + net.p[f"b{w}"]).max(1))
        return -np.log(net._softmax(np.maximum(np.concatenate(pooled, 1), 0))[np.arange(4), y]).mean()

    g = net.step(x, y)
    for name, at in (("u", (3, 1)), ("c", (0,)), ("b4", (2,)), ("w2", (0, int(x[0, 0]), 1)), ("w6", (3, int(x[1, 7]), 5))):
        e = 1e-6
        net.p[name][at] += e
        up = loss()
        net.p[name][at] -= 2 * e
        down = loss()
        net.p[name][at] += e
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4


def test_tables_equal_filters():
    """Predicting by byte pairs is the same network, for windows that are full or not."""
    net = langid.Network(["a", "b", "c"], seed=4)
    x, n = langid.windows([b"a", b"Hello w\xc3\xb6rld " * 60, bytes(range(1, 256)) * 2])
    assert n.tolist() == [1, 4, 2]
    pooled = []
    for w in langid.WIDTHS:
        m = langid.WINDOW - w + 1
        pooled.append((sum(net.p[f"w{w}"][k][x[:, k : k + m]] for k in range(w)) + net.p[f"b{w}"]).max(1))
    assert np.allclose(net.predict(x, net.tables()), net._softmax(np.maximum(np.concatenate(pooled, 1), 0)), atol=1e-5)


@tables
def test_language_query_on_held_out_documents(spark):
    """The query itself, held against the labels that it never learned from."""
    sf = SF.replace("sf0.001", "sf0.01")
    want = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = langid.op4_langid(spark, sf).collect()
    assert len(got) == len(want)
    held = [(r.lang_pred, want[r.doc_id].lang) for r in got if r.held_out and want[r.doc_id].lang]
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in got)
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97


# ---- PPM


def plain_ppm(train, order=ppm.ORDER):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for x in train:
        b = b"\xff" * order + x + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1

    def p(ctx, sym):
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            c = {a: n for a, n in seen[k].get(ctx[order - k :], {}).items() if a not in gone}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            whole = len(gone) + d == 256
            if sym in c:
                return out * c[sym] / (n if whole else n + d)
            out, gone = out * d / (n + d), gone | set(c)
        return out / (256 - len(gone))

    return p


def check_scores(spark, rows, common, frequent=1 << 21):
    before = ppm.COMMON, ppm.FREQUENT
    ppm.COMMON, ppm.FREQUENT = common, frequent
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = ppm.score(df.repartition(3)).collect()
    finally:
        ppm.COMMON, ppm.FREQUENT = before
    key = lambda i: "" if i is None else str(i)
    train = [(t or "") for i, t in rows if zlib.crc32(key(i).encode()) % 5 != 1]
    c = Counter()
    for t in train:
        c.update(t.encode().lower().split())
        c["end"] += 1
    total, kinds, p = sum(c.values()), len(c), plain_ppm([t.encode() for t in train])

    def want(i, t):
        w = (t or "").encode().lower().split() + ["end"]
        b = ppm.PAD + (t or "").encode() + b"\xff"
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        return i, zlib.crc32(key(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), total, round(base, 6), sum(math.log10(p(b[k - ppm.ORDER : k], b[k])) for k in range(ppm.ORDER, len(b)))

    order = lambda x: (x[0] is None, x[0], x[2], x[5])
    a = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), x.score) for x in got), key=order)
    b = sorted((want(i, t) for i, t in rows), key=order)
    assert [x[:6] for x in a] == [x[:6] for x in b]
    assert all(abs(x[6] - y[6]) <= 1e-4 * max(1, abs(y[6])) for x, y in zip(a, b, strict=True))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "Ünïcödé 日本"), (5, "a A a b"), (5, "a A a b"), (None, "null id"), (6, "x" * 3000), (7, "a\x00b")]


@pytest.mark.parametrize(("common", "frequent"), [(0, 0), (2, 300), (1 << 16, 1 << 21)])
def test_scores(spark, common, frequent):
    r = random.Random(common)
    words = ["the", "The", "of", "ring", "élan", "x"] + [f"w{i}" for i in range(40)]
    check_scores(spark, ODD + [(100 + i, " ".join(r.choice(words) for _ in range(r.randrange(30)))) for i in range(60)], common, frequent)


def test_scores_of_long_texts(spark, monkeypatch):
    """Texts in pieces, and grams sent on before the end."""
    monkeypatch.setattr(ppm, "CHUNK", 50)
    monkeypatch.setattr(ppm, "HELD_GRAMS", 20)
    r = random.Random(1)
    check_scores(spark, [(i, " ".join(r.choice("ab abc cab bac x yz".split()) for _ in range(r.randrange(200)))) for i in range(40)], 1 << 16, 100)


def test_longer_contexts_help(spark):
    """What two bytes of context leave open is learned from four: the code length falls far below that of order 2."""
    r = random.Random(2)
    said = lambda: " ".join(r.choice(["xabcabcz", "yabcabcw", "uabcabcv"]) for _ in range(40)).encode()
    train, text = [said() for _ in range(60)], said()
    b = {k: b"\xff" * k + text + b"\xff" for k in (2, ppm.ORDER)}
    bits = {k: -sum(math.log2(plain_ppm(train, k)(x[i - k : i], x[i])) for i in range(k, len(x))) for k, x in b.items()}
    rows = [(i, t.decode()) for i, t in zip([i for i in range(200) if fold(i) != 1], train, strict=False)] + [(next(i for i in range(1000, 2000) if fold(i) == 1), text.decode())]
    got = {x.doc_id: x.score for x in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(-got[rows[-1][0]] / math.log10(2) - bits[ppm.ORDER]) < 0.1 and bits[ppm.ORDER] < 0.7 * bits[2]


def test_words_of_many_texts_at_once():
    """Words and their numbers are those of each text by itself: odd spaces, upper case beyond ASCII, nothing at all."""
    texts = ["", " a  B\t", "Ünïcödé\x0b日本\x0cÄ", "\n", "a\x00b\x1cc\x85d\u2003e", "end"]
    for some in (texts, texts[:1], [" "], ["x"], ["", ""]):
        words, many = ppm.words_in([t.encode() for t in some])
        want = [ppm.words_of(t) for t in some]
        assert words.to_pylist() == [w for x in want for w in x] and many.tolist() == [len(x) for x in want]


def test_texts_in_groups(spark, monkeypatch):
    monkeypatch.setattr(ppm, "ROWS", 3)
    monkeypatch.setattr(ppm, "GROUP", 40)
    check_scores(spark, ODD + [(i, "the ring of w%d w%d" % (i % 7, i)) for i in range(10, 40)], 5, 100)


def test_rows_sent_to_python(spark):
    """Texts go to Python in smaller messages, and the session's own number is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sent = lambda: max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect())
    before = spark.conf.get(name, None)
    try:
        for own, most in ((None, 1024), ("100", 100), ("0", 1024)):
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)
            with ppm.batches_of(spark, 1024):
                assert sent() == most
            assert spark.conf.get(name, None) == own
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    with pytest.raises(ZeroDivisionError), ppm.batches_of(spark, 7):
        1 / 0  # noqa: B018
    assert spark.conf.get(name, None) == before


def test_grams_are_looked_up_once(monkeypatch):
    """A gram of many places and rows costs one look-up; the sums are those of each place."""
    asked, at = [], ppm._at
    monkeypatch.setattr(ppm, "_at", lambda keys, wanted: asked.append(len(wanted)) or at(keys, wanted))
    texts = [b"ab" * 500, b"abab", b"xyz"]
    pieces = [x for t in texts for x in ppm.pieces_of(t)]
    known = np.unique(ppm.grams(pieces[:1]))
    p = np.arange(1.0, len(known) + 1)
    sums, (row, gram, n) = ppm.piece_scores(pieces, [0, 1, 2], known, p, 4)
    value = dict(zip(known.tolist(), p, strict=True))
    places = [ppm.grams([x]).tolist() for x in pieces]
    assert asked == [len({g for x in places for g in x})] and asked[0] < 20
    assert sums.tolist() == [sum(value.get(g, 0) for g in x) for x in places] + [0]
    assert sorted(zip(row.tolist(), gram.tolist(), n.tolist(), strict=True)) == sorted((i, g, k) for i, x in enumerate(places) for g, k in Counter(x).items() if g not in value)


def test_sums_of_large_counts():
    key = np.array([5, (1 << 48) - 1, 5, 0, 5, 7], np.uint64)
    n = np.array([65535, 1 << 40, 65536, 0, (1 << 33) + 3, 1], np.int64)
    got = ppm._summed(key, n)
    assert [x.tolist() for x in got] == [[0, 5, 7, (1 << 48) - 1], [0, 65535 + 65536 + (1 << 33) + 3, 1, 1 << 40]]
    assert [len(x) for x in ppm._summed(key[:0], n[:0])] == [0, 0]


def test_scores_without_training(spark):
    held = next(i for i in range(100) if fold(i) == 1)
    check_scores(spark, [(held, "ab c")], 1 << 16)
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def all_after(contexts, train):
    """log10 probabilities of every symbol after some contexts, with all grams of the training texts beside them."""
    key, n = np.unique(np.concatenate([ppm.grams(list(ppm.pieces_of(t))) for t in train]), return_counts=True)
    low = np.unique(key & np.uint64(0xFFFFFF), return_inverse=True)
    ctx, row = np.unique(low[0] >> np.uint64(8), return_inverse=True)
    dense = np.zeros((len(ctx), 256))
    np.add.at(dense, (row[low[1]], (key & np.uint64(255)).astype(int)), n)
    asked = np.array([int.from_bytes(c + bytes([s]), "big") for c in contexts for s in range(256)], np.uint64)
    both = np.unique(np.r_[key, asked])
    counts = np.zeros(len(both), np.int64)
    counts[np.searchsorted(both, key)] = n
    got = ppm.gram_scores(both, counts, ppm.LowOrders(ctx.astype(np.int64), dense))
    return got[np.searchsorted(both, asked)].reshape(-1, 256)


def test_probabilities_sum_to_one():
    train = [b"abracadabra", bytes(range(255)), b"", b"aaa", b"abracax", *[b"zabra" + bytes([s]) for s in range(255)]]
    contexts = [b"abrac", b"dabra", b"zabra", b"aaaaa", b"\xff" * 5, b"xxbra", b"xxxra", b"xxxxa", b"qqqqq", b"abcde"]
    p = all_after(contexts, train)
    assert np.allclose((10.0**p).sum(1), 1, atol=1e-5)
    plain = plain_ppm(train)
    assert np.allclose(p, [[math.log10(plain(c, s)) for s in range(256)] for c in contexts], atol=1e-5)


# ---- pieces


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.Vocabulary.load())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


ALPHABET = "aehtionsr  \n\t▁é①😀-=0🙂ß.,!?AB\x00　"


@needs_model
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=120), max_size=5))
def test_ids_are_the_library_s(coder, library, texts):
    ids, many = coder.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(many))[: len(texts)]]
    assert got == [library.encode(t) for t in texts]
    assert [coder.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


@needs_model
def test_long_units_and_small_indexes(monkeypatch, library):
    monkeypatch.setattr(pieces, "INDEXED", 64)
    monkeypatch.setattr(pieces, "KNOWN", 10)
    c = pieces.Coder(pieces.Vocabulary.load())
    texts = ["a" * 500, " " * 200, "-" * 333 + "=" * 50, "internationalization" * 40, "日本語" * 100, "", "the end"]
    for _ in range(2):
        ids, many = c.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [library.encode(t) for t in texts]


@needs_model
def test_texts_in_slices(monkeypatch, library):
    """A text longer than a batch has the library's ids, wherever its slices end."""
    r = random.Random(8)
    words = ["the", "internationalization", " ", "  ", "日本語の", "q7Zx9", "\n", "▁", "a", "x" * 70, "=-" * 30]
    texts = ["".join(r.choice(words) + r.choice([" ", ""]) for _ in range(300)) for _ in range(4)]
    for batch in (1, 7, 100):
        monkeypatch.setattr(pieces, "BATCH", batch)
        monkeypatch.setattr(pieces, "DECODED", 10)
        c = pieces.Coder(pieces.Vocabulary.load())
        for t in texts:
            ids, many = c.encode([t])
            assert ids.tolist() == library.encode(t) and many.tolist() == [len(ids)] and c.decode(ids) == t.replace("▁", " ")


@needs_model
def test_a_long_text_without_blanks_takes_little_memory(library):
    """A million signs of random letters and digits: split where no piece reaches, and indexed a part at a time."""
    import tracemalloc

    r = random.Random(3)
    t = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    c = pieces.Coder(pieces.Vocabulary.load())
    tracemalloc.start()
    ids, _ = c.encode([t])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == library.encode(t) and peak < 400e6


@needs_model
@tables
def test_encoding_query(spark, library):
    import hashlib

    got = {r.doc_id: r for r in pieces.op5_pieces(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = np.array(library.encode(d.text), "<i4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_ok) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), True)


@needs_model
def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "en", None, 1), (2, "", None, "s", 1), (2, "", None, "s", 1), (None, "a b", "en", "s", 1)], "doc_id long, text string, lang string, source string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in pieces.stage_pieces(spark, df, "").collect())
    assert got[1:] == [(1, 0, 0), (2, 0, 0), (2, 0, 0)] and got[0][1] == got[0][2] > 0
    assert pieces.stage_pieces(spark, df.filter("false"), "").count() == 0


# ---- top-k


def plain_top(rows, k=20, every=20):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(64 * float(np.float32(c))) for c in x])
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for q in v:
        if q % every == 0:
            found = sorted((-dot(v[q][0], x), i) for i, xs in v.items() if i != q for x in xs)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_the_index_is_copied_only_where_many_queries_go(spark, monkeypatch):
    """Hundreds of batches: the copies stay within the index and four rows a routed query."""
    for name, x in (("CELL", 20), ("BLOCK", 2), ("PAGE", 8)):
        monkeypatch.setattr(mtree, name, x)
    seen, real = [], mtree.copies

    def spied(index, routed):
        held, asked = real(index, routed)
        seen.append((index.count(), routed.count(), held.count(), asked.count(), held.select("cell", "salt", "block").distinct().count()))
        return held, asked

    monkeypatch.setattr(mtree, "copies", spied)
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, (r.normal(size=6) * 2).tolist()) for i in range(1200)], "vec_id long, embedding array<double>")
    assert mtree.top_k(mtree.quantized(df), F.col("vec_id") % 3 == 0, 3).count() == 1200
    assert len(seen) == 2 and max(x[4] for x in seen) > 100
    for index, routed, held, asked, _ in seen:
        assert asked == routed and held <= index + 4 * routed


@pytest.mark.parametrize("cell", [4096, 16])
def test_top_k(spark, monkeypatch, cell):
    """Clusters, ties, copies, zero vectors; with small cells there are many trees."""
    for name, x in (("CELL", cell), ("PAGE", 8), ("FAN", 3), ("BLOCK", 7), ("TREE", 2 * cell)):
        monkeypatch.setattr(mtree, name, x)
    r = np.random.default_rng(cell)
    centers = r.normal(0, 1, (5, 6))
    x = [(centers[i % 5] + r.normal(0, 0.1, 6)).tolist() for i in range(300)]
    x += [x[20]] * 60 + [[0.0] * 6] * 5 + [[1.0] * 6, [-1.0] * 6, [30.0] * 6]
    rows = list(enumerate(x)) + [(1000, None), (1020, [1.0] * 5 + [float("nan")]), (1040, [float("inf")] + [0.0] * 5), (1060, [None] + [0.5] * 5), (1080, [0.25, -0.01]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(z) for z in mtree.top_k(mtree.quantized(df), F.col("vec_id") % 20 == 0).collect())
    assert got == plain_top(rows)


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(z) for z in mtree.top_k(mtree.quantized(df), F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert mtree.top_k(mtree.quantized(df), F.col("vec_id") == 9).count() == 0
    assert mtree.top_k(mtree.quantized(df.filter("false")), F.col("vec_id") == 0).count() == 0


def test_own_id_with_several_vectors(spark):
    """Rows of the query's own id don't take the places of others."""
    rows = [(0, [2.0]), (0, [1.9]), (0, [1.8])] + [(1 + i, [1.0 - i / 64]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = [(i, math.floor(64 * float(np.float32(x)))) for i, (x,) in rows]
    pairs = sorted((-a * b, j) for i, a in v if i == 0 for j, b in v if j != 0)[:20]
    got = sorted(tuple(z) for z in mtree.top_k(mtree.quantized(df), F.col("vec_id") == 0).collect())
    assert got == [(0, n + 1, j, -s) for n, (s, j) in enumerate(pairs)]


def test_own_id_fills_the_list(spark):
    """More rows of the query's own id than places: the others still come."""
    rows = [(0, [100.0 + i]) for i in range(25)] + [(1 + i, [1.0 + i]) for i in range(22)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(mtree.quantized(df), F.col("vec_id") == 0).collect()
    assert len(got) == 20 and all(z.vec_id > 0 for z in got)


def test_bounds_spare_distances():
    """On clustered vectors the tree computes far fewer scores than there are vectors."""
    r = np.random.default_rng(1)
    v = np.floor(np.repeat(r.normal(0, 60, (40, 8)), 100, 0) + r.normal(0, 2, (4000, 8))).astype(np.int64)
    t = mtree.MTree(v, [np.array([i]) for i in range(len(v))], float((v.astype(float) ** 2).sum(1).max()))
    s, i = t.search(v[5], 20)
    want = sorted((-int(x), k) for k, x in enumerate(v @ v[5]))[:20]
    assert list(zip((-s).tolist(), i.tolist(), strict=True)) == want and t.computed < 2000


def test_many_queries_as_one_by_one():
    """Side by side, with floors, copies, ties and scores too large to pack, against all scores."""
    r = np.random.default_rng(5)
    for scale in (3, 1 << 24):
        v = np.unique(r.integers(-scale, scale, (900, 4)), axis=0)
        ids = [np.sort(r.choice(10**6, r.integers(1, 4), replace=False)) for _ in v]
        t = mtree.MTree(v, ids, float((v.astype(float) ** 2).sum(1).max()))
        q = r.integers(-scale, scale, (40, 4))
        every = q @ v.T
        floors = np.where(np.arange(40) % 3 == 0, np.nan, np.sort(every, 1)[:, -7].astype(float))
        row, s, i = t.search_all(q, 9, floors)
        for j in range(len(q)):
            want = sorted((-int(x), int(y)) for x, of in zip(every[j], ids, strict=True) for y in of if np.isnan(floors[j]) or x >= floors[j])[:9]
            assert list(zip((-s[row == j]).tolist(), i[row == j].tolist(), strict=True)) == want


# ---- the pipeline


@needs_model
@tables
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, d = [docs.count()], docs
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns, name
        d = spark.createDataFrame(d.collect(), d.schema)
        seen.append(d.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    last = P.STAGES[-1][1](spark, d, SF)
    assert last.count() == seen[-1] and P.run(spark, SF).count() == seen[-1]


@needs_model
def test_pipeline_without_rows(spark):
    import corpus_pipeline as P

    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        d = stage(spark, d, "")
        assert d.count() == 0
