"""Language identification as mixture inference: expectation-maximisation over n-gram likelihoods.

Each language has an interpolated trigram model over folded bytes, counted over every document that may be learned from; only trigrams that
occur are kept, so a model takes about 100 kB a language and any number of languages can be learned.  A
document is a mixture of languages; a word is drawn from one of them.  EM estimates the proportions; the set of languages
grows while twice the gain in log likelihood exceeds twice the logarithm of the number of words, for a language costs its proportion and its choice.  What that mixture explains worse than letters without order do is text in
none of the languages, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, released, slices, text_batches, text_buffers

#: Byte classes: 0 parts words (ASCII but letters), 1-26 the letters, 27-63 the folded bytes from 128 on.
FOLD = np.zeros(256, np.int32)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B] = np.arange(1, 27)
FOLD[128:] = 27 + np.arange(128) % 37
CODES = 64**3
#: Languages up to which the likelihoods are looked up in one table; of more, a table is made for the trigrams of each batch.
DENSE = 32
#: Share of the background's probability that is spread evenly over the byte classes; the rest follows how often they occur.
EVEN = 0.1
#: Letters without evidence that every text has besides its own, so that a short one needs more.
PRIOR_LETTERS = 8
#: Rounds of EM for the ranking of languages and for each set that is tried.
RANK_ROUNDS, SET_ROUNDS = 4, 6
#: Bytes for which likelihoods are looked up at once.
_PIECE = 1 << 19


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the trigram that ends at each byte, class of the byte); no trigram reaches into the text before."""
    c = FOLD[buf]
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    first = offsets[:-1][offsets[:-1] < len(c)]
    one[first] = 0
    two[first] = 0
    second = first[first + 1 < len(c)] + 1
    two[second] = 0
    # after a gap the byte before the gap says nothing
    two[one == 0] = 0
    return (two << 12) | (one << 6) | c, c


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def counter(languages: list[str]):
    known = {x: k for k, x in enumerate(languages)}

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for whole in batches:
            for b in slices(whole, "text", 1 << 21):
                buf, off = text_buffers(b.column("text"))
                code, c = trigrams(buf, off)
                lang = np.array([known.get(x, -1) for x in b.column("lang").to_pylist()])
                if len(languages) <= DENSE:
                    key = np.repeat(lang * CODES, np.diff(off)) + code
                    n = np.bincount(key[(key >= 0) & ((code & 4095) != 0)], minlength=1)
                    found = np.flatnonzero(n)
                    n = n[found]
                else:
                    key = np.repeat(lang * CODES, np.diff(off)) + code
                    found, n = np.unique(key[(key >= 0) & ((code & 4095) != 0)], return_counts=True)
                keys.append(found)
                counts.append(n)
                held += len(found)
                if held > 1 << 20:
                    found, n = _summed(keys, counts)
                    keys, counts, held = [found], [n], 0
        found, n = _summed(keys, counts)
        yield pa.RecordBatch.from_pydict({"key": found, "n": n})

    return count


class Model:
    """Log probabilities of a byte after the two before it, interpolated with shorter contexts; and a background column, of a byte by itself.

    ``keys`` (language * CODES + trigram, sorted) and ``n`` are the trigrams that occur.
    """

    def __init__(self, languages: int, keys: np.ndarray, n: np.ndarray):
        n = n.astype(np.float64)
        lang, code = keys // CODES, keys % CODES
        two = np.bincount(lang * 4096 + (code & 4095), n, languages * 4096).reshape(-1, 64, 64)
        one = two.sum(1)
        p1 = (one + 1) / (one.sum(1, keepdims=True) + 64)
        p2 = (two + 8 * p1[:, None, :]) / (two.sum(2, keepdims=True) + 8)
        context = np.bincount(lang * 4096 + (code >> 6), n, languages * 4096) + 8
        self.languages = languages
        self.unseen = np.log(8 * p2).reshape(languages, 4096)  # by the last two bytes
        self.context = np.log(context).reshape(languages, 4096)  # by the first two
        self.starts = np.searchsorted(lang, np.arange(languages + 1))
        self.codes = code.astype(np.int32)
        self.seen = np.log(n + 8 * p2.reshape(languages, 4096)[lang, code & 4095]).astype(np.float32) - np.log(context)[lang * 4096 + (code >> 6)].astype(np.float32)
        every = one.sum(0)
        self.background = np.log((1 - EVEN) * every / max(every.sum(), 1) + EVEN / 64).astype(np.float32)
        self._dense = None

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities (codes x languages and the background) of sorted trigrams."""
        out = np.empty((len(codes), self.languages + 1), np.float32)
        for k in range(self.languages):
            lo, hi = self.starts[k], self.starts[k + 1]
            out[:, k] = self.unseen[k, codes & 4095] - self.context[k, codes >> 6]
            _, mine, theirs = np.intersect1d(codes, self.codes[lo:hi], assume_unique=True, return_indices=True)
            out[mine, k] = self.seen[lo:hi][theirs]
        out[:, -1] = self.background[codes & 63]
        return out

    def rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a table, the row of each trigram in it)."""
        if self.languages <= DENSE:
            if self._dense is None:
                self._dense = self.table(np.arange(CODES))
            return self._dense, codes
        has = np.zeros(CODES, bool)
        has[codes] = True
        return self.table(np.flatnonzero(has)), (np.cumsum(has) - 1)[codes]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}


def _by_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text."""
    out = np.zeros((len(ptr) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(ptr) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, ptr[full], axis=0, dtype=np.float64)
    return out


def word_likelihoods(buf: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each word in each language and by the background, the texts' pointer into the words)."""
    code, c = trigrams(buf, off)
    start = (c > 0) & (((code >> 6) & 63) == 0)
    at = np.flatnonzero(start)
    table, row = model.rows(code)
    most = _PIECE * 8 // max(8, model.languages + 1)
    parts, lo = [], 0
    while lo < len(at):  # so many bytes at once; a word ends where the next one starts
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        end = at[hi] if hi < len(at) else len(code)
        scores = table[row[at[lo] : end]]
        scores[(code[at[lo] : end] & 4095) == 0] = 0
        parts.append(np.add.reduceat(scores, at[lo:hi] - at[lo], axis=0))
        lo = hi
    words = np.concatenate(parts) if parts else np.zeros((0, model.languages + 1), np.float32)
    return words, np.searchsorted(at, off)


def _em(p: np.ndarray, ptr: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood beside the words' scale) after some rounds."""
    n = np.diff(ptr)
    text = np.repeat(np.arange(len(n)), n)
    for k in range(rounds + 1):
        q = p * theta[text].astype(p.dtype)
        s = q.sum(1)
        np.maximum(s, 1e-30, out=s)
        if k < rounds:
            q /= s[:, None]
            theta = _by_text(q, ptr) / np.maximum(n, 1)[:, None]
    return theta, _by_text(np.log(s), ptr)


def infer(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its proportion, the mixture's log likelihood) of each text: the largest share within the set that the penalised likelihood selects."""
    n, langs = np.diff(ptr), words.shape[1]
    top = words.max(1, keepdims=True) if len(words) else words
    p = np.exp(np.maximum(words - top, -40))
    alone = _by_text(np.maximum(words - top, -40), ptr)
    best = alone.argmax(1)
    like = alone[np.arange(len(n)), best]
    share = np.ones(len(n))
    scale = _by_text(top, ptr)[:, 0]
    if langs == 1:
        return best, share, like + scale
    theta, _ = _em(p, ptr, np.full((len(n), langs), 1 / langs), RANK_ROUNDS)
    theta[np.arange(len(n)), best] += 1  # the best one alone comes first
    order = np.argsort(-theta, axis=1, kind="stable")
    live = np.flatnonzero(n > 1)
    for size in range(2, langs + 1):
        if not len(live):
            break
        # only texts whose set grew the last time, and their words
        rows = ranges(ptr[live], n[live])
        sub = np.concatenate(([0], np.cumsum(n[live])))
        chosen = order[live, :size]
        part = np.take_along_axis(p[rows], np.repeat(chosen, n[live], axis=0), 1)
        t, now = _em(part, sub, np.full((len(live), size), 1 / size), SET_ROUNDS)
        grew = 2 * (now - like[live]) > 2 * np.log(n[live])
        texts = live[grew]
        like[texts] = now[grew]
        best[texts] = chosen[grew, t[grew].argmax(1)]
        share[texts] = t[grew].max(1)
        live = texts
    return best, share, like + scale


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = (FOLD[buf] > 0) & (buf < 128)
    sums = np.concatenate(([0], np.cumsum(ascii_)))
    out = sums[off[1:]] > sums[off[:-1]]
    for k in np.flatnonzero(~out):  # none of A-Z, a-z: look at every character
        out[k] = any(ch.isalpha() for ch in buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predictor(languages: list[str], model, text: bool = False, evidence: bool = False):
    @released
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for whole in batches:
            for b in slices(whole, "text", (1 << 21) * 8 // max(8, len(languages) + 1)):
                buf, off = text_buffers(b.column("text"))
                sure = has_letter(buf, off)
                if languages:
                    words, ptr = word_likelihoods(buf, off, table)
                    known = len(languages)
                    best, share, like = infer(words[:, :known], ptr)
                    if evidence:
                        letters = np.concatenate(([0], np.cumsum(FOLD[buf] > 0)))
                        gain = (like - _by_text(words[:, known:], ptr)[:, 0]) / (letters[off[1:]] - letters[off[:-1]] + PRIOR_LETTERS)
                    names = [languages[k] if ok else "und" for k, ok in zip(best, sure)]
                else:
                    names, share, gain = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
                keep = [c for c in b.schema.names if c != "text" or text]
                more = [pa.array(gain)] if evidence else []
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(sure, np.clip(share, 0, 1), 0.0)), *more], [*keep, "lang_pred", "score", *["evidence"] * evidence])

    return predict


def learn(spark: SparkSession, labelled: DataFrame) -> tuple[list[str], Model | None]:
    """(languages, their model) from all rows (text, lang) of ``labelled``; rows with a null in either are left out.

    The counts are summed in Spark; the driver gets a row for each language and trigram that occurs.
    """
    text_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # a label is a language: a few thousand at most
    if not languages:
        return [], None
    n = rows.mapInArrow(counter(languages), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return languages, Model(len(languages), n.key.to_numpy(), n.n.to_numpy())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(spark: SparkSession, docs: DataFrame, languages: list[str], model: Model | None, text: bool = False, evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score for every row, from its whole text alone; the text itself only if ``text`` says so.

    A null text, an empty one and one without a letter are ``und`` with score 0, and so is everything where nothing was learned.  Equal
    texts get equal results; the first language by name wins ties; an empty table gives an empty result, and a very long text is read whole.  ``evidence`` adds a column of that name: how much more likely (natural
    logarithm, by letter) the languages make the whole text than the background does.
    """
    text_batches(spark)
    rows = docs.drop("lang_pred", "score", *["evidence"] * evidence)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or text)
    return rows.mapInArrow(predictor(languages, spark.sparkContext.broadcast(model), text, evidence), f"{schema}, lang_pred string, score double" + ", evidence double" * evidence)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, model = learn(spark, docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return predict(spark, docs.select("doc_id", "text"), languages, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
