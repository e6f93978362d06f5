"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary is a BPE model with byte fallback, so the last step relaxes the
edges in BPE order, best score first and then leftmost, which is what
gives the same ids as the library; the best path by summed scores wouldn't.

A batch of texts is encoded together. No piece holds a blank mark after
another character, and none holds a line feed with others, so texts
split there into units whose encodings don't depend on each other; units over ``LONG``
characters also split between two characters that no piece holds side by side. Only the
distinct units of a batch are encoded:

1. Index: the units, joined, and a suffix array over their characters, sorted by
   as many characters as the longest piece has.
2. Match: every piece is binary-searched at once for its first and last suffix.
   Each suffix in the range is an edge from its position.
3. Sort the edges by position: into a table by position and length.
4. Relax: adjacent symbols whose joint edge exists are merged, the best
   edge of every unit at a time; units over ``LONG`` characters with a heap.

Decoding looks pieces up and joins their bytes. Memory is bounded by the batch, by
``INDEXED`` characters an index, and by ``KNOWN`` remembered units of ``KNOWN_CHARS`` characters in all; a
text longer than a batch is worked on in slices that end where units do, with the same result.

Defined cases: null text is empty and has no ids; U+2581 in a text decodes to
a blank, as in the library; a stretch that can't be split, such as one letter
repeated, is one unit and takes some 250 bytes a character; repeated rows each get a row; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters of text in a batch, characters of units indexed at a time, units remembered and their characters, longest unit merged in rounds.
BATCH, INDEXED, KNOWN, KNOWN_CHARS, LONG = 1 << 21, 1 << 19, 600_000, 1 << 23, 48
#: Ids decoded at a time.
DECODED = 1 << 20
NONE = np.iinfo(np.int32).max


class Vocabulary(NamedTuple):
    """What a model file holds, small and plain so that it can be broadcast."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]  # may match text
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Coder:
    """Encodes and decodes batches of texts with one vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        many = [(i, p) for i, (p, ok) in enumerate(zip(v.pieces, v.plain, strict=True)) if ok and len(p) > 1]
        self.single = {p: i for i, (p, ok) in enumerate(zip(v.pieces, v.plain, strict=True)) if ok and len(p) == 1}
        self.longest = max((len(p) for _, p in many), default=1)
        # equal scores share a rank: then the leftmost is merged first
        order = {s: k for k, s in enumerate(sorted({v.scores[i] for i, _ in many}, reverse=True))}
        self.ids = np.array([i for i, _ in many], np.int32)
        self.rank = np.array([order[v.scores[i]] for i, _ in many], np.int32)
        self.names = [p for _, p in many]
        self.byte_ids = v.byte_ids
        marks = all(not (a != BLANK and b == BLANK) for p in self.names for a, b in zip(p, p[1:], strict=False))
        feeds = all("\n" not in p for p in self.names)
        self.pairs = {p[k : k + 2] for p in self.names for k in range(len(p) - 1)}
        self.units = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if marks and feeds else r"(?s).+")
        self.bytes = [(p.replace(BLANK, " ").encode() if ok else b"") for p, ok in zip(v.pieces, v.plain, strict=True)]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.flat, self.count = [], []

    # ---- suffix array and edges

    def _edges(self, chars: np.ndarray) -> np.ndarray:
        """chars: code points of joined units, 0 between them. Table (position, length - 2) of the piece that stands there, or -1."""
        n = len(chars)
        table = np.full((n, max(1, self.longest - 1)), -1, np.int32)
        here = np.unique(chars)
        # characters get dense codes; those of no piece get 0 as the separator
        used = {c: k for k, c in enumerate(sorted(set("".join(self.names)) & {chr(c) for c in here.tolist()}), 1)}
        width = 1 if len(used) < 255 else 2
        lut = np.array([used.get(chr(c), 0) for c in here.tolist()], np.uint64)
        code = lut[np.searchsorted(here, chars)]
        per = 8 // width
        words = -(-self.longest // per)
        w = np.r_[code, np.zeros(words * per + per, np.uint64)]
        b = 1
        while b < per:
            w, b = (w[:-b] << np.uint64(8 * width * b)) | w[b:], 2 * b
        # suffix array: by a word at a time, and only those still tied
        order = np.argsort(w[:n], kind="stable")
        key = w[order]
        new = np.r_[True, key[1:] != key[:-1]]
        for k in range(1, words):
            size = np.diff(np.r_[np.flatnonzero(new), n])
            tied = np.flatnonzero(np.repeat(size > 1, size))
            if not len(tied):
                break
            block, key = np.cumsum(new)[tied], w[order[tied] + k * per]
            o = np.lexsort((key, block))
            order[tied] = order[tied][o]
            block, key = block[o], key[o]
            new[tied] |= np.r_[True, (block[1:] != block[:-1]) | (key[1:] != key[:-1])]
        # pieces whose characters all occur, as words and masks
        mine = [j for j, p in enumerate(self.names) if all(c in used for c in p)]
        if not mine:
            return table
        size = np.array([len(self.names[j]) for j in mine])
        want, mask = np.zeros((words, len(mine)), np.uint64), np.zeros((words, len(mine)), np.uint64)
        full = np.uint64((1 << (8 * width)) - 1)
        flat = np.array([used[c] for j in mine for c in self.names[j]], np.uint64)
        row = np.repeat(np.arange(len(mine)), size)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        shift = (8 * width * (per - 1 - nth % per)).astype(np.uint64)
        np.bitwise_or.at(want, (nth // per, row), flat << shift)
        np.bitwise_or.at(mask, (nth // per, row), full << shift)

        def bound(after: bool) -> np.ndarray:
            """For every piece the number of suffixes before it (or not after it), by binary search."""
            lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = order[np.minimum(mid, n - 1)]
                less, same = np.zeros(len(mine), bool), np.ones(len(mine), bool)
                for k in range(words):
                    x = w[at + k * per] & mask[k]
                    less |= same & (x < want[k])
                    same &= x == want[k]
                go = open_ & ((less | same) if after else less)
                lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            return lo

        low, high = bound(False), bound(True)
        many = high - low
        start = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        table[start, np.repeat(size - 2, many)] = np.repeat(np.array(mine, np.int32), many)
        return table

    # ---- relaxing the edges

    def _rounds(self, table: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges in short units, the best edge of each unit a round. Returns marks of the symbols' first positions."""
        head = np.zeros(len(table) + 1, bool)
        at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        head[at] = True
        unit = np.repeat(np.arange(len(first)), size)
        ends = np.repeat(first + size, size)
        after = np.minimum(at + 1, ends)  # where each symbol ends
        rank = np.append(self.rank, NONE)
        while len(at):
            right = np.r_[after[1:], 0]
            pair = np.r_[unit[1:] == unit[:-1], False]
            span = right - at
            ok = pair & (span <= self.longest)
            r = np.full(len(at), NONE, np.int64)
            r[ok] = rank[table[at[ok], span[ok] - 2]]
            cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            many = np.diff(np.r_[cut, len(at)])
            score = (r << 32) | np.arange(len(at))
            best = np.minimum.reduceat(score, cut)
            live = (best >> 32) != NONE
            pick = best[live] & 0xFFFFFFFF
            after[pick] = after[pick + 1]
            gone = np.zeros(len(at), bool)
            gone[pick + 1] = True
            head[at[gone]] = False
            keep = np.repeat(live, many) & ~gone
            at, after, unit = at[keep], after[keep], unit[keep]
        return head

    def _heap(self, table: np.ndarray, head: np.ndarray, first: int, size: int) -> None:
        """Merges in one long unit with a heap."""
        end = first + size
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive, heap = [True] * size, []

        def offer(i: int) -> None:
            j = after[i]
            if j < size and after[j] - i <= self.longest and (p := int(table[first + i, after[j] - i - 2])) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), i, after[j]))

        for i in range(size):
            offer(i)
        head[first:end] = True
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= size or after[j] != stop:
                continue
            alive[j] = False
            head[first + j] = False
            after[i] = stop
            if stop < size:
                before[stop] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)

    def _learn(self, units: list[str]) -> None:
        """Encodes units and remembers them."""
        size = np.array([len(u) for u in units], np.int64)
        joined = ("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(joined, np.uint32)
        first = np.cumsum(size + 1) - size - 1
        table = self._edges(chars)
        head = self._rounds(table, first[size <= LONG], size[size <= LONG])
        for k in np.flatnonzero(size > LONG).tolist():
            self._heap(table, head, int(first[k]), int(size[k]))
        at = np.flatnonzero(head[:-1])
        owner = np.searchsorted(first, at, "right") - 1
        stop = np.minimum(np.r_[at[1:], len(chars)], (first + size)[owner])
        span = stop - at
        many = span > 1
        # single characters: an id, or one for each byte
        kinds, which = np.unique(chars[at[~many]], return_inverse=True)
        own = [[self.single[chr(c)]] if chr(c) in self.single else [self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        count = np.ones(len(at), np.int64)
        lengths = np.array([len(x) for x in own], np.int64)
        count[~many] = lengths[which]
        ids = np.zeros(int(count.sum()), np.int32)
        place = np.cumsum(count) - count
        ids[place[many]] = self.ids[table[at[many], span[many] - 2]]
        wide = np.zeros((len(own), 4), np.int32)
        for k, x in enumerate(own):
            wide[k, : len(x)] = x
        for k in range(4):
            ok = np.flatnonzero(~many)[lengths[which] > k]
            ids[place[ok] + k] = wide[which[lengths[which] > k], k]
        total = np.bincount(owner, count, minlength=len(units)).astype(np.int64)
        base = len(self.known)
        self.known.update(zip(units, range(base, base + len(units)), strict=True))
        self.flat.append(ids)
        self.count.append(total)

    def _split(self, text: str) -> list[str]:
        """The units of a prepared text."""
        out = []
        for u in self.units.findall(text):
            if len(u) <= LONG:
                out.append(u)
                continue
            at = [0, *[k for k in range(1, len(u)) if u[k - 1 : k + 1] not in self.pairs], len(u)]
            out += [u[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """A text with its marks, in slices of about a batch that end where units do."""
        at = 0
        while at < len(text):
            end = min(len(text), at + BATCH)
            while end < len(text) and text[end - 1 : end + 1].replace(" ", BLANK) in self.pairs:
                end += 1
            yield ("" if at else BLANK) + text[at:end].replace(" ", BLANK)
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's ids."""
        if len(texts) == 1 and len(texts[0]) > BATCH:
            ids = np.concatenate([self._encode([x])[0] for x in self._slices(texts[0])])
            return ids, np.array([len(ids)], np.int64)
        return self._encode([BLANK + t.replace(" ", BLANK) if t else "" for t in texts])

    def _encode(self, prepared: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KNOWN or self.known_chars > KNOWN_CHARS:
            self.forget()
        split = [self._split(t) if t else [] for t in prepared]
        new: dict[str, None] = {}
        for s in split:
            new.update(dict.fromkeys(s))
        fresh, size = [], 0
        for u in new:
            if u not in self.known:
                if fresh and size + len(u) + 1 > INDEXED:
                    self._learn(fresh)
                    fresh, size = [], 0
                fresh.append(u)
                size += len(u) + 1
                self.known_chars += len(u)
        if fresh:
            self._learn(fresh)
        if not self.count:
            return np.zeros(0, np.int32), np.zeros(len(prepared), np.int64)
        self.flat, self.count = [np.concatenate(self.flat)], [np.concatenate(self.count)]
        flat, count = self.flat[0], self.count[0]
        start = np.cumsum(count) - count
        known = self.known
        number = [len(s) for s in split]
        u = np.fromiter((known[x] for s in split for x in s), np.int64, sum(number))
        many = count[u]
        ids = flat[np.repeat(start[u] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        done = np.r_[0, np.cumsum(many)][np.cumsum([0, *number])]
        return ids, np.diff(done)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids, without the blank that encoding puts before it."""
        ids = np.asarray(ids, np.int32)
        text = b"".join(b"".join(map(self.bytes.__getitem__, ids[k : k + DECODED].tolist())) for k in range(0, len(ids), DECODED)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _coded(docs: DataFrame, model: str, schema: str, row) -> DataFrame:
    """docs batch by batch through row(columns, texts, ids of each text, coder), a function from a list of rows to a record batch."""
    # plain data, so that executors needn't have this module to read it
    shared = docs.sparkSession.sparkContext.broadcast(tuple(Vocabulary.load(model)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(*shared.value))
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(at)]
            k = 0
            while k < len(texts):
                j, size = k, 0
                while j < len(texts) and (j == k or size + len(texts[j]) <= BATCH):
                    size += len(texts[j])
                    j += 1
                ids, many = coder.encode(texts[k:j])
                cut = np.split(ids, np.cumsum(many)[:-1]) if j > k else []
                yield row(b.slice(k, j - k), texts[k:j], cut, coder)
                k = j

    return docs.mapInArrow(lean(run), schema)


def op5_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_ok (decoding gives the text again)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(b: pa.RecordBatch, texts: list[str], ids: list[np.ndarray], coder: Coder) -> pa.RecordBatch:
        ok = [coder.decode(x) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]
        out = [[len(x) for x in ids], [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], ok]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.bool_()), strict=True)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_ok"])

    return _coded(docs, model, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_ok boolean", row)


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    """The documents with their ids; the last stage, so the text gives way to them."""
    d = docs.select("doc_id", "text", "lang", "source")
    kinds = {c: d.schema[c].dataType.simpleString() for c in d.columns}

    def row(b: pa.RecordBatch, texts: list[str], ids: list[np.ndarray], coder: Coder) -> pa.RecordBatch:
        offsets = np.cumsum([0, *[len(x) for x in ids]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([len(x) for x in ids], pa.int64()), lists], ["doc_id", "lang", "source", "n_tokens", "ids"])

    return _coded(d, model, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, source {kinds['source']}, n_tokens long, ids array<int>", row)
