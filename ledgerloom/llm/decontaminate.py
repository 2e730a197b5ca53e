"""Benchmark decontamination by latent semantic retrieval.

The texts' words are hashed to features.  A randomised SVD of the TF-IDF matrix of all passages gives a latent space; every
window of every text is compared there with every benchmark item of its length by cosine.  Beside that, runs of words that an item or its
answer shares with a text are joined exactly, whatever the latent space says.  Each place is checked by the longest
common subsequence of words, and, where that is only moderate, by whether the item's answer (its last sentence) is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, Scratch, mix, ranges, released, slices, text_batches, text_buffers, words_of

FEATURES = 1 << 14
RANK, OVERSAMPLE = 72, 8
#: Informative words of a cell (windows start and end at cells), and words of a passage of the SVD.
CELL, PASSAGE = 4, 32
#: Share of passages from which on a feature is no informative one, and the standard deviations by which its count must exceed that share.
COMMON, SURE = 0.01, 3.0
#: Features below which an item keeps its common ones too.
FEW = 5
#: Cosine in the latent space from which a window is a candidate.
COSINE = 0.55
#: Items of up to so many informative words have a lower one, as their windows hold more besides: that much lower at most.
SHORT_ITEM, LOWER = (12, 20), 0.15
#: Longest common subsequence over the item's words: enough alone, or together with the answer.
COPIED, PARAPHRASED = 0.8, 0.6
ANSWER = 0.8
#: Words of a run that is joined exactly, at most.
RUN = 3
#: Items that are searched for at once; more are searched for in blocks, in one latent space.  And items of a length whose scores are held at once.
ITEM_BLOCK, SCORED = 20_000, 512
BROADCAST_IDS = 1_000_000


# ------------------------------------------------------------------------------------------ features and SVD


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, the texts' pointer); case is folded in every script."""
    words, _, _, ptr = words_of(*text_buffers(pc.utf8_lower(texts)), NOT_WORD)
    return words, ptr


@released
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            words, ptr = _split(b.column("text"))
            f = (words >> np.uint64(50)).astype(np.uint16)
            offsets = pa.py_buffer((ptr * 2).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(f.tobytes())])], ["doc_id", "features"])


def _unpack(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch's texts and the texts' pointer."""
    col = b.column("features").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint16, (off[-1] - off[0]) // 2, off[0]) if off[-1] > off[0] else np.zeros(0, np.uint16), (off - off[0]) // 2


def _parts(b: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    _, ptr = _unpack(b)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _passages(ptr: np.ndarray) -> tuple[np.ndarray, int]:
    """The passage of each word, and how many there are."""
    n = np.diff(ptr)
    count = -(-n // PASSAGE)
    first = np.cumsum(count) - count
    return np.repeat(first, n) + (ranges(np.zeros(len(n), np.int64), n) // PASSAGE), int(count.sum())


@released
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, passages = np.zeros(FEATURES, np.int64), 0
    for whole in batches:
        for b in _parts(whole):
            f, ptr = _unpack(b)
            p, n = _passages(ptr)
            order = np.argsort(f, kind="stable")  # within a feature the passages ascend
            g, q = f[order], p[order]
            if len(g):
                total += np.bincount(g[np.concatenate(([True], (g[1:] != g[:-1]) | (q[1:] != q[:-1])))], minlength=FEATURES)
            passages += n
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"feature": np.concatenate(([-1], has)), "n": np.concatenate(([passages], total[has]))})


def random_signs(features: int, columns: int, each: int = 2, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random test matrix: ``each`` columns and signs for every feature."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((features, columns)), axis=1)[:, :each]
    return at, rng.choice([-1.0, 1.0], (features, each))


_BLOCK = 256


def sketcher(idf: np.ndarray):
    informative, weight = idf > 0, idf.astype(np.float32)

    @released
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's share of A'A times the test matrix, as blocks of rows."""
        at, sign = random_signs(FEATURES, RANK + OVERSAMPLE)
        width = RANK + OVERSAMPLE
        m = np.zeros((FEATURES, width), np.float32)
        for whole in batches:
            for b in _parts(whole):
                f, ptr = _unpack(b)
                p, n = _passages(ptr)
                keep = informative[f]
                f, p = f[keep], p[keep]
                if not len(f):
                    continue
                w = idf[f]
                y = np.zeros(n * width)
                for e in range(at.shape[1]):
                    y += np.bincount(p * width + at[f, e], w * sign[f, e], minlength=n * width)
                y = y.reshape(n, width).astype(np.float32)
                order = np.argsort(f, kind="stable")
                for lo in range(0, len(order), 1 << 14):  # so many rows stay in the cache
                    part = order[lo : lo + (1 << 14)]
                    g = f[part]
                    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                    m[g[starts]] += np.add.reduceat(np.take(y, p[part], axis=0), starts, axis=0) * weight[g[starts], None]
        rows = m.reshape(-1, _BLOCK * width)
        use = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int64)), pa.array([rows[k].tobytes() for k in use], pa.binary())], ["block", "m"])

    return sketch


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("m"):
            v = np.frombuffer(x.as_buffer(), np.float32)
            total = v.astype(np.float64) if total is None else total + v
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "m"])


def frequencies(features: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that each feature occurs in, passages), over every text."""
    stats = features.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES)
    passages = max(1, int(stats.loc[stats.feature < 0, "n"].sum()))
    stats = stats[stats.feature >= 0]
    df[stats.feature] = stats.n
    return df, passages


def common_features(df: np.ndarray, passages: int) -> np.ndarray:
    """Features that surely occur in more than ``COMMON`` of all passages."""
    return df - SURE * np.sqrt(df) > COMMON * passages


def latent_space(features: DataFrame, df: np.ndarray, passages: int, common: np.ndarray) -> np.ndarray:
    """FEATURES x RANK: takes a bag of words to whitened latent coordinates.  The sketch covers every passage.

    Rows of ``common`` features are zero.
    """
    idf = np.where(df > 0, np.log((1 + passages) / (1 + df)) + 0.05, np.log(1 + passages))
    idf[common] = 0
    parts = features.mapInArrow(sketcher(idf), "block long, m binary")
    split = max(1, math.isqrt(features.rdd.getNumPartitions()))
    width = RANK + OVERSAMPLE
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(split)))
    parts = parts.groupBy("block", "part").applyInArrow(_sum, "block long, m binary").groupBy("block").applyInArrow(_sum, "block long, m binary")
    m = np.zeros((FEATURES // _BLOCK, _BLOCK * width))
    for block, x in parts.collect():  # FEATURES / 256 rows
        m[block] = np.frombuffer(x, np.float32)
    m = m.reshape(FEATURES, width)
    # Nystroem: A'A = M (T'M)^+ M' for the test matrix T
    at, sign = random_signs(FEATURES, width)
    t = np.zeros((FEATURES, width))
    np.put_along_axis(t, at, sign, 1)
    shift = 1e-7 * max(np.linalg.norm(m), 1e-12)
    m = m + shift * t
    c = t.T @ m
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > max(values.max(), 0) * 1e-8 + 1e-300
    u, s, _ = np.linalg.svd(m @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    k = min(RANK, int((s > s[0] * 1e-6).sum())) if len(s) else 0
    out = np.zeros((FEATURES, RANK), np.float32)
    if k:
        out[:, :k] = idf[:, None] * u[:, :k] / s[:k]
    return out


# ------------------------------------------------------------------------------------------ search and checks


def lcs(a, b) -> int:
    """Length of the longest common subsequence, with the bits of one integer for the positions of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        if m := where.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def window_cells(n_words: int) -> int:
    """Cells of the windows for an item: the fewest that hold it wherever it starts."""
    return -(-(n_words + CELL - 1) // CELL)


def run_length(n_words: int) -> int:
    """Words in a row that are left of n when a fifth of them is replaced or dropped, wherever; ``RUN`` at most, 0 for less than two words."""
    gone = n_words - math.ceil(COPIED * n_words - 1e-9)
    return min(RUN, -(-(n_words - gone) // (gone + 1))) if n_words > 1 else 0


def _runs(f: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of so many words, by its first word."""
    n = max(0, len(f) - width + 1)
    out = np.full(n, width, np.int64)
    for k in range(width):
        out = out * FEATURES + f[k : k + n]
    return out


_BITS = 22


def _short(runs: np.ndarray) -> np.ndarray:
    return (runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Joined:
    """Runs of the items' words, and of their answers', to meet those of texts."""

    def __init__(self, items: list[np.ndarray], answers: list[np.ndarray]):
        parts: dict[int, list] = {}
        for k, (f, a) in enumerate(zip(items, answers)):
            for words, shift in ((f, 0), (a, len(f) - len(a))):
                if width := run_length(len(words)):
                    r = _runs(words, width)
                    parts.setdefault(width, []).append(np.stack((r, np.full(len(r), k), shift + np.arange(len(r)))))
        self.by_width = {}
        for width, found in parts.items():
            runs, item, at = np.unique(np.concatenate(found, 1), axis=1)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[_short(runs)] = True
            self.by_width[width] = (runs, item, at, maybe)

    def meet(self, every: np.ndarray, start_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where its first word would stand, text), distinct."""
        keys = [np.zeros((3, 0), np.int64)]
        for width, (runs, item, at, maybe) in self.by_width.items():
            mine = _runs(every.astype(np.int64), width)
            place = np.flatnonzero(maybe[_short(mine)])
            lo, hi = (np.searchsorted(runs, mine[place], side) for side in ("left", "right"))
            # within one text
            n = np.where(np.searchsorted(start_of, place, "right") == np.searchsorted(start_of, place + width - 1, "right"), hi - lo, 0)
            x = ranges(lo, n)
            keys.append(np.stack((item[x], np.repeat(place, n) - at[x], np.repeat(place, n))))
        item, first, place = np.concatenate(keys, 1)
        doc = np.searchsorted(start_of, place, "right") - 1
        item, first, doc = np.unique(np.stack((item, first, doc)), axis=1)
        return item, first, doc


#: Items whose words have a table of places; those of more are searched in a list.
TABLE_ITEMS = 1024


class Bound:
    """The words of an item, with their number, that occur in a stretch of text at all: no common subsequence is longer."""

    def __init__(self, items: list[np.ndarray]):
        parts = [np.unique(f, return_counts=True) for f in items]
        sizes = [len(f) for f, _ in parts]
        self.most = max(sizes)
        self.keys = np.concatenate([k * FEATURES + f for k, (f, _) in enumerate(parts)])
        self.slots = ranges(np.zeros(len(sizes), np.int64), np.array(sizes)).astype(np.int32)
        self.counts = np.zeros((len(items), self.most), np.int32)
        self.counts[self.keys // FEATURES, self.slots] = np.concatenate([n for _, n in parts])
        self.table = None
        if len(items) <= TABLE_ITEMS:
            self.table = np.full(len(items) * FEATURES, -1, np.int32)
            self.table[self.keys] = self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        x = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[x] == key, self.slots[x], -1)

    def of(self, every: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(item), np.int64), 0
        sizes = np.cumsum(hi - lo)
        while at < len(item):
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 18), "right"))
            to = max(at + 1, min(to, at + (1 << 22) // self.most))
            n, k = (hi - lo)[at:to], item[at:to]
            slot = self._slot(np.repeat(k * FEATURES, n) + every[ranges(lo[at:to], n)])
            flags = np.zeros((to - at) * (self.most + 1), bool)  # the last column is for words that the item doesn't have
            flags[np.repeat(np.arange(1, to - at + 1) * (self.most + 1), n) - np.where(slot < 0, 1, self.most + 1 - slot)] = True
            out[at:to] = np.einsum("ij,ij->i", flags.reshape(to - at, -1)[:, : self.most], self.counts[k])
            at = to
        return out


def searcher(space: np.ndarray, items: list[tuple[int, np.ndarray]], answers: list[np.ndarray], cosine: float, least: float):
    @released
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.vstack([space, np.zeros((1, RANK), np.float32)])
        informative = space.any(1)
        items_ = [f[informative[f]] for _, f in items]
        widths: dict[int, list[int]] = {}
        for k, f in enumerate(items_):
            if len(f):
                widths.setdefault(window_cells(len(f)), []).append(k)
        z = np.stack([space[f].sum(0) for f in items_])
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-30)
        lengths = np.array([len(f) for _, f in items])
        least_cosine = np.array([cosine - LOWER * float(np.interp(len(f), SHORT_ITEM, (1, 0))) for f in items_])
        known, known_answers = [f.tolist() for _, f in items], [f.tolist() for f in answers]
        joined, bound = Joined([f for _, f in items], answers), Bound([f for _, f in items])
        for whole in batches:
            best: dict = {}
            for b in _parts(whole):
                every, start_of = _unpack(b)
                if not len(every):
                    continue
                ids = b.column("doc_id").to_pylist()

                def check(item: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
                    """Keeps the best stretch of each text and item, and the best with the answer."""
                    for x in np.flatnonzero(bound.of(every, item, lo, hi) >= least * lengths[item]):
                        k, d, from_, to = int(item[x]), int(doc[x]), int(lo[x]), int(hi[x])
                        part = every[from_:to].tolist()
                        ratio = lcs(known[k], part) / len(known[k])
                        if ratio >= least:
                            for answered in (False, True):
                                key = (ids[d], items[k][0], answered)
                                if (key not in best or best[key][0] < ratio) and (not answered or known_answers[k] and lcs(known_answers[k], part) >= ANSWER * len(known_answers[k])):
                                    best[key] = (ratio, from_ - int(start_of[d]), to - int(start_of[d]))

                k, at, d = joined.meet(every, start_of)
                # where the item would stand and as many words around it as it has
                check(k, d, np.maximum(at - lengths[k], start_of[d]), np.minimum(at + 2 * lengths[k], start_of[d + 1]))

                place = np.flatnonzero(informative[every])  # of the informative words
                f, ptr = every[place], np.searchsorted(place, start_of)
                n = np.diff(ptr)
                count = -(-n // CELL)
                total = int(count.sum())
                if not total:
                    continue
                # each text padded to whole cells
                first = np.cumsum(count) - count
                padded = np.full(total * CELL, FEATURES, np.int64)
                padded[np.repeat(first * CELL, n) + ranges(np.zeros(len(n), np.int64), n)] = f
                cells = padded.reshape(total, CELL)
                sums = np.zeros((total + 1, RANK), np.float32)
                np.take(table, cells[:, 0], axis=0, out=sums[1:], mode="clip")
                for c in range(1, CELL):
                    sums[1:] += np.take(table, cells[:, c], axis=0)
                np.cumsum(sums, axis=0, out=sums)
                end = np.repeat(first + count, count)
                doc = np.repeat(np.arange(len(n)), count)
                for w, ks in ((w, np.array(x[lo : lo + SCORED])) for w, x in widths.items() for lo in range(0, len(x), SCORED)):
                    stop = np.minimum(np.arange(total) + w, end)
                    mine = np.ascontiguousarray((z[ks] / least_cosine[ks, None]).T.astype(np.float32))
                    for at in range(0, total, 1 << 12):
                        v = sums[stop[at : at + (1 << 12)]] - sums[at : min(at + (1 << 12), total)]
                        size = np.sqrt(np.einsum("ij,ij->i", v, v)) + np.float32(1e-30)
                        i, j = np.nonzero(v @ mine >= size[:, None])
                        if len(i):
                            a, k = i + at, ks[j]
                            d = doc[a]
                            # the window's words and as many around it as the item has
                            from_ = ptr[d] + (a - first[d]) * CELL
                            to = np.minimum(from_ + w * CELL, ptr[d + 1]) - 1
                            check(k, d, np.maximum(place[from_] - lengths[k], start_of[d]), np.minimum(place[to] + lengths[k], start_of[d + 1]))
            rows = sorted({(doc_id, item, *v[1:]) for (doc_id, item, _), v in best.items()})
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item", "start", "stop"])

    return search


def answer_of(text: str) -> str:
    """The last sentence, without its stop."""
    parts = [x for x in text.replace("\n", " ").rstrip(" .!?").replace("!", ".").replace("?", ".").split(". ") if x.strip()]
    return parts[-1] if parts else ""


def _words(text: str) -> list[int]:
    return _split(pa.array([text]))[0].tolist()


def checker(items: dict[int, str], copied: float, paraphrased: float):
    known = {k: (_words(t), _words(answer_of(t))) for k, t in items.items()}

    @released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = []
            for b in slices(whole, "text"):
                words, ptr = _split(b.column("text"))
                for r, (doc, item, start, stop) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "item", "start", "stop")))):
                    part = words[ptr[r] + start : ptr[r] + stop].tolist()
                    whole_item, answer = known[item]
                    ratio = lcs(whole_item, part) / len(whole_item)
                    answered = bool(answer) and lcs(answer, part) >= ANSWER * len(answer)
                    if ratio >= copied or (ratio >= paraphrased and answered):
                        rows.append((doc, item, ratio, answered))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], ["doc_id", "item", "overlap", "answered"])

    return check


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, copied: float = COPIED, paraphrased: float = PARAPHRASED) -> DataFrame:
    """(doc_id, item_id, overlap, answered): the benchmark items that a document holds.

    ``overlap`` is the longest common subsequence of words (letters and digits, lower-cased) over the item's words;
    ``answered`` whether the item's last sentence is there.  A document holds an item from ``copied`` on, or from ``paraphrased`` on with the answer.
    Items or texts that are null or have no word match nothing, nor does a row without doc_id; equal items each match; rows that
    share a doc_id count as one document.  Empty tables give no rows; a very long text is searched whole; more columns are ignored.
    """
    text_batches(spark)
    scratch = Scratch(spark, "decontaminate")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    features = scratch.save(texts.mapInArrow(_features, "doc_id long, features binary"))
    good = scratch.save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct())
    # items whose texts are equal are searched for once
    different = scratch.save(good.select("text").distinct())
    blocks = max(1, -(-different.count() // ITEM_BLOCK))

    def block(k: int) -> tuple[list[str], list[list[int]]]:
        rows = different.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text").collect()  # about ITEM_BLOCK rows
        split = [(r.text, w) for r in rows if (w := _words(r.text))]
        return [t for t, _ in split], [w for _, w in split]

    feature = lambda words: (np.array(words, np.uint64) >> np.uint64(50)).astype(np.int64)
    df, passages = frequencies(features)
    common, kept = common_features(df, passages), []
    for k in range(blocks):  # items that have few other features keep their common ones
        kept += [f for f in map(feature, block(k)[1]) if (~common[f]).sum() < FEW]
    common[np.concatenate([np.zeros(0, np.int64), *kept])] = False
    space = latent_space(features, df, passages, common)
    hits = None
    for k in range(blocks):
        named, words = block(k)
        if not named:
            continue
        feats = [(j, feature(w)) for j, w in enumerate(words)]
        answers = [feature(_words(answer_of(t))) for t in named]
        near = scratch.save(features.mapInArrow(searcher(space, feats, answers, cosine, paraphrased), "doc_id long, item long, start long, stop long"))
        few = near.count() <= BROADCAST_IDS
        found = texts.join(F.broadcast(near) if few else near, "doc_id").select("doc_id", "text", "item", "start", "stop").mapInArrow(checker(dict(enumerate(named)), copied, paraphrased), "doc_id long, item long, overlap double, answered boolean")
        names = spark.createDataFrame([(j, t) for j, t in enumerate(named)], "item long, text string")  # a block of items
        found = found.join(F.broadcast(names), "item").join(good, "text").select("doc_id", "item_id", "overlap", "answered")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, item_id long, overlap double, answered boolean")
    return scratch.save(hits.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("answered").alias("answered")))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` (doc_id, text) with item_ids, an array of the benchmark items that the document holds, and overlap, the largest one (0 if there is none).

    A row without doc_id is known by its text, so that it is searched like any other.  Columns of these two names are replaced.  See ``contamination``.
    """
    columns = [c for c in docs.columns if c not in ("item_ids", "overlap")]
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    hits = contamination(spark, docs.select(name.alias("doc_id"), "text"), benchmark, **thresholds)
    per = hits.groupBy(F.col("doc_id").alias("_of")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("overlap"))
    per = F.broadcast(per) if per.count() <= BROADCAST_IDS else per
    out = docs.select(F.struct(*columns).alias("_row"), name.alias("_name")).join(per, F.col("_name") == F.col("_of"), "left")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in columns), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, overlap (the largest) for every document."""
    out = contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "overlap")
