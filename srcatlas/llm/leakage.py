"""Problem 7: evaluation passages leaking into a corpus.

Pigeonhole edit matching on words.  A document holds an item if one or two runs
of it contain two fifths of the item's words in order, so the longer run has at
least a fifth of them and within it a stretch of ``s`` words with at most ``e`` changed, missing or added ones.
Each item is cut into pieces of so many words that every stretch of ``s`` holds ``e + 1`` whole
pieces: one is intact.  Exact hits of pieces are found for a whole batch of documents by
one sorted lookup.  A hit stays if some ``s`` words of the item around it stand, all but ``e``, within ``e`` places
of where the hit puts them, which every such stretch fulfils.  For the pairs of document and item that are left all runs are
gathered, extended, and verified with Myers' bit-parallel edit distance.

Layout and look are normalised first: markup, quotation marks, line-break hyphens,
escapes, entities, case, accents, invisible and look-alike characters.  A word is a run of letters of any
script, one character where a script doesn't separate words, or a run of digits.

Scale: one map-only pass over the documents, whole texts.  The items are a fixed
test set; they are sent to the tasks, after a check of their size, in several
passes if they exceed ``max_item_bytes``.  What an item needs to know of the others (sentences that many
share) is counted before, over all items, so the number of passes changes nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = 3
SHARE = 0.4
#: one word in so many may be changed or missing
ERROR_EVERY = 5
MAX_ITEM_BYTES = 32 << 20

# Characters that look like Latin letters, and invisible ones.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһӏвкмнтгпиьбзлАВЕКМНОРСТУХІЈЅαεορυχικνητγμωβτАΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtrnnbb3nABEKMHOPCTYXIJSaeopuxiknntymwbtAABEZHIKMNOPTYX"))
_FOLD = {ord(k): v for k, v in _LOOKALIKE.items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x180E)} | {0x131: "i", 0xF8: "o", 0x142: "l", 0x111: "d", 0xE6: "ae", 0x153: "oe"}
_INLINE_TAG = re.compile(r"</?(?:em|b|i|u|s|strong|code|span|a|mark|sub|sup|small|tt|font|kbd)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑­][ \t]*\r?\n[ \t]*(?:(?:[>|*#;]|//|--)[ \t]*)*(?=\w)")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt])")
_INNER = re.compile(r"(?<=[^\W_])[*`~]{1,3}(?=[^\W_])")
#: scripts without spaces between words: Thai to Myanmar, Khmer, kana, Han
_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+|\d+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def words(text: str) -> list[str]:
    """The normalised words of a text; signs only separate."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "*" in text or "`" in text or "~" in text:
        text = _INNER.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_FOLD)).casefold()
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_FOLD)
    if "-" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


def myers(pattern: list[int], text: list[int]) -> int:
    """Edit distance between two word sequences, bit-parallel (global, unit costs)."""
    m = len(pattern)
    if not m or not len(text):
        return max(m, len(text))
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
    return score


def sentences(text: str) -> list[tuple[int, int]]:
    """(hash, number of words) of the sentences of a text, in order."""
    out = []
    for part in _SENTENCE.split(text):
        w = words(part)
        out.append((int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(w)))
    return out


def pieces(n: int) -> tuple[int, int, int]:
    """(s, e, p) for an item of n words: of s successive words with e errors at least one of the pieces of p words is intact."""
    s = max(1, -(-n // 5))
    e = s // ERROR_EVERY
    return s, e, max(1, (s + 1) // (e + 2))


def _rolled(x: np.ndarray, p: int) -> np.ndarray:
    """Hashes of every p successive numbers (modulo 2**64)."""
    h = np.zeros(max(0, len(x) - p + 1), np.uint64)
    y = x.astype(np.int64).view(np.uint64) + np.uint64(2)
    with np.errstate(over="ignore"):
        for j in range(p):
            h = (h ^ y[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Index:
    """Pieces of the items in sorted order, by their length, and what a run needs.

    ``standing``: hashes of the sentences that are standing instructions, those of three different items or more.
    """

    def __init__(self, items: list[tuple[int, str]], standing: set[int] | None = None):
        self.ids = [i for i, _ in items]
        texts = [words(t or "") for _, t in items]
        if standing is None:
            standing = standing_sentences([t for _, t in items])
        self.vocab = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.seq = [np.array([self.vocab[w] for w in t], np.int64) for t in texts]
        self.own = []
        for (_, t), seq in zip(items, self.seq):
            own = np.array([ok for h, n in sentences(t or "") for ok in [h not in standing] * n], bool)
            self.own.append(own if len(own) == len(seq) else np.ones(len(seq), bool))
        lens = np.array([len(q) for q in self.seq], np.int64)
        self.shape = np.array([pieces(int(n)) for n in lens], np.int64).reshape(-1, 3)
        self.gap = int((self.shape[:, 0] * 2 + self.shape[:, 1] + self.shape[:, 2]).max(initial=1)) + 1
        # items one after the other, apart, so that no window reaches another
        self.base = np.concatenate(([0], np.cumsum(lens + self.gap)))[:-1] + self.gap
        self.all = np.full(int((lens + self.gap).sum()) + 2 * self.gap, -2, np.int64)
        by: dict[int, list] = {}
        for k, q in enumerate(self.seq):
            self.all[self.base[k] : self.base[k] + len(q)] = q
            p = int(self.shape[k, 2])
            # successive pieces, and one that ends with the item
            at = np.unique(np.append(np.arange(0, len(q) - p + 1, p), len(q) - p)) if len(q) >= p > 0 and len(q) else np.empty(0, np.int64)
            if len(at):
                by.setdefault(p, []).append((_rolled(q, p)[at], np.full(len(at), k), at))
        self.tables = []
        for p, rows in sorted(by.items()):
            code, item, offset = (np.concatenate(c) for c in zip(*rows))
            order = np.argsort(code, kind="stable")
            self.tables.append((p, code[order], item[order].astype(np.int64), offset[order].astype(np.int64)))

    def search(self, docs: list[str]) -> list[tuple[int, int, int, float]]:
        """(document index, item index, matched words, share) of a batch of texts."""
        get = self.vocab.get
        lists = [[x for x in (get(w, -1 if not w.isdigit() else -3) for w in words(t)) if x != -3] if t else [] for t in docs]
        lens = np.array([len(x) for x in lists], np.int64)
        starts = np.concatenate(([0], np.cumsum(lens + self.gap))) + self.gap
        flat = np.full(int(starts[-1]) + self.gap, -1, np.int64)
        for a, x in zip(starts, lists):
            flat[a : a + len(x)] = x
        n_items = len(self.ids)
        chosen: set[int] = set()
        for p, codes, items, offsets in self.tables:
            h = _rolled(flat, p)
            lo = np.searchsorted(codes, h, "left")
            hit = np.flatnonzero((codes[np.minimum(lo, len(codes) - 1)] == h) & (flat[: len(h)] >= 0))
            lo, n = lo[hit], np.searchsorted(codes, h[hit], "right") - lo[hit]
            # a batch of hits at a time: a piece that many items share multiplies them
            ends = np.cumsum(n)
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 65536, "right")))
                m = n[a:b]
                pos = np.repeat(hit[a:b], m)
                which = np.repeat(lo[a:b] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
                item, offset = items[which], offsets[which]
                doc = np.searchsorted(starts, pos, "right") - 1
                key = doc * n_items + item
                if chosen:
                    new = ~np.isin(key, np.fromiter(chosen, np.int64, len(chosen)))
                    pos, item, offset, key = pos[new], item[new], offset[new], key[new]
                chosen.update(key[self._near(flat, pos, item, offset)].tolist())
                a = b
        out = []
        for k in sorted(chosen):
            d, it = divmod(k, n_items)
            doc = flat[starts[d] : starts[d] + lens[d]]
            got = self.verify(it, doc, *self._hits(it, doc))
            if got:
                out.append((d, it, got, got / len(self.seq[it])))
        return out

    def _near(self, flat: np.ndarray, pos: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Which hits have around them s words of the item of which all but e stand within e places of the hit's diagonal."""
        keep = np.zeros(len(pos), bool)
        for s, e, p in np.unique(self.shape[item], axis=0).tolist() if len(pos) else []:
            rows = np.flatnonzero((self.shape[item] == (s, e, p)).all(1))
            t = np.arange(-s, p + s)
            for a in range(0, len(rows), 4096):
                r = rows[a : a + 4096]
                want = self.all[(self.base[item[r]] + offset[r])[:, None] + t]
                there = np.zeros(want.shape, bool)
                for d in range(-e, e + 1):
                    there |= flat[pos[r][:, None] + t + d] == want
                c = np.concatenate([np.zeros((len(r), 1), np.int32), np.cumsum(there, axis=1, dtype=np.int32)], 1)
                keep[r] = (c[:, s:] - c[:, :-s]).max(1) >= s - e
        return keep

    def _hits(self, it: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document position, item offset) of all equal runs of P words (fewer in a short item), by position."""
        p = self.run_words(it)
        code = _rolled(self.seq[it], p)
        order = np.argsort(code, kind="stable")
        h = _rolled(doc, p)
        lo, hi = np.searchsorted(code[order], h, "left"), np.searchsorted(code[order], h, "right")
        n = hi - lo
        pos = np.repeat(np.arange(len(h)), n)
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(h) else np.empty(0, np.int64)
        return pos, order[which]

    def run_words(self, it: int) -> int:
        return max(1, min(P, int(self.shape[it, 2])))

    def verify(self, it: int, doc: np.ndarray, pos: np.ndarray, offset: np.ndarray) -> int:
        """Words of the item in its best one or two runs of the document, 0 if they are under the share."""
        seq = self.seq[it]
        n, p = len(seq), self.run_words(it)
        chains: list[list[int]] = []  # item from, to, document from, to
        open_: list[list[int]] = []
        for x, o in zip(pos.tolist(), offset.tolist()):
            for ch in reversed(open_):
                dx, do = x - ch[3] + p, o - ch[1] + p
                if 0 < dx <= 24 and 0 < do <= 24 and abs(dx - do) <= 6:
                    ch[1], ch[3] = o + p, x + p
                    break
            else:
                ch = [o, o + p, x, x + p]
                chains.append(ch)
                open_ = [c for c in open_ if x - c[3] <= 24]
                open_.append(ch)
        runs = []
        for i0, i1, x0, x1 in chains:
            if i1 - i0 < min(6, self.shape[it, 0]):
                continue
            i1, x1 = self._extend(seq, doc, i1, x1, 1)
            i0, x0 = self._extend(seq, doc, i0, x0, -1)
            d = myers(seq[i0:i1].tolist(), doc[x0:x1].tolist())
            if d * 5 <= (i1 - i0) * 2:
                own = int(self.own[it][i0:i1].sum())
                runs.append((i1 - i0 - d, i0, i1, x0, x1, own))
        if not runs:
            return 0
        return self.best(n, runs)

    @staticmethod
    def best(n: int, runs: list[tuple[int, int, int, int, int, int]]) -> int:
        """The most words of one run, or of two in order (matched, item from, to, document from, to, own), 0 if under the share.

        One run precedes another if it ends at most two words after the other begins, in the item and in the
        document.  Runs are swept by where they begin in the document; of those that have ended there, each item
        end keeps the (own, matched) that no other exceeds in both.  So every pair counts, and a run is compared with what
        differs in the item, however often a document repeats it.
        """
        need = n * SHARE / 4
        best = max((r[0] for r in runs if r[5] >= need), default=0)
        starts = sorted(runs, key=lambda r: r[3])
        ends = sorted(runs, key=lambda r: r[4])
        # front[e]: (own, matched) pairs, none dominated, of the runs with item end e
        front: dict[int, list[tuple[int, int]]] = {}
        k = 0
        for r in starts:
            while k < len(ends) and ends[k][4] <= r[3] + 2:
                q = ends[k]
                k += 1
                f = front.setdefault(q[2], [])
                if not any(o >= q[5] and g >= q[0] for o, g in f):
                    f[:] = [(o, g) for o, g in f if o > q[5] or g > q[0]]
                    f.append((q[5], q[0]))
            for e, f in front.items():
                if e <= r[1] + 2:
                    for own, got in f:
                        if own + r[5] >= need and got + r[0] > best:
                            best = got + r[0]
        return best if best >= SHARE * n - 1e-9 else 0

    @staticmethod
    def _extend(seq: np.ndarray, doc: np.ndarray, i: int, x: int, step: int) -> tuple[int, int]:
        n, m = len(seq), len(doc)
        a, b = (i, x) if step > 0 else (i - 1, x - 1)

        def eq(p: int, q: int) -> bool:
            return 0 <= p < n and 0 <= q < m and seq[p] == doc[q]

        while True:
            if eq(a, b):
                a, b = a + step, b + step
            elif eq(a + step, b + step) and eq(a + 2 * step, b + 2 * step):
                a, b = a + 2 * step, b + 2 * step
            elif eq(a + step, b) and eq(a + 2 * step, b + step):
                a += step
            elif eq(a, b + step) and eq(a + step, b + 2 * step):
                b += step
            else:
                return (a, b) if step > 0 else (a + 1, b + 1)


_FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("matched_words", T.IntegerType()), T.StructField("share", T.DoubleType())]
)


def standing_sentences(texts: list[str]) -> set[int]:
    """Hashes of the sentences that three different texts or more share."""
    seen: dict[int, int] = {}
    for t in {t for t in texts if t}:
        for h in {h for h, _ in sentences(t)}:
            seen[h] = seen.get(h, 0) + 1
    return {h for h, n in seen.items() if n >= 3}


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for h in {h for h, _ in sentences(t)}:
                ids.append(i)
                hashes.append(h)
                texts.append(int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], names=["item_id", "sentence", "text"])


def leaked(documents: DataFrame, items: DataFrame, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, matched_words, share) of every document that holds an item's passage.

    Rows with a null id or text take no part; a passage under two ids gives both, repeated
    documents one row each.  An item without words is never found.  Empty tables give
    no rows.  The result is sorted by nothing; each pair comes once.
    """
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // max_item_bytes))
    parts = rows.mapInArrow(_sentences, "item_id long, sentence long, text long")
    shared = parts.select("sentence", "text").distinct().groupBy("sentence").agg(F.count("*").alias("n")).where("n >= 3").select("sentence")
    mine = parts.join(shared, "sentence", "left_semi").groupBy("item_id").agg(F.collect_set("sentence").alias("standing"))
    full = rows.join(mine, "item_id", "left").withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    out = None
    for k in range(passes):
        part = full.where(F.col("pass") == k).orderBy("item_id", "text").collect()
        found = _one_pass(documents, [(r.item_id, r.text) for r in part], {h for r in part for h in r.standing or ()})
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(documents: DataFrame, items: list[tuple[int, str]], standing: set[int]) -> DataFrame:
    holder: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "x" not in holder:
            holder["x"] = Index(items, standing)
        index = holder["x"]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column(0).to_pylist()
                for d, it, got, share in index.search(part.column(1).to_pylist()):
                    for col, x in zip(out, (ids[d], index.ids[it], got, share)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=_FOUND.names)

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, _FOUND)
