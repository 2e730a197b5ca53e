"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of at least ``SHORTEST`` token characters that mixes letters with digits, or upper with lower case inside.
The network sees the candidate and its surroundings.  It is trained on every text: what the patterns find, with and without
its keyword and spelled in other alphabets, against words, paths, names and ids that are plainly none.  Other candidates have no label and train
nothing.  A few windows give it a start; then each task trains a copy on its windows, and the copies' mean is the network.  It is calibrated on
all windows of a part that it hasn't seen, and its threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounds, ranges, released, slices, text_batches, text_buffers

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "network")

SHORTEST = 16
#: A part of a token between its punctuation that is a word, a name in camel case, or a number with at most a word before it; and whole ids.
PLAIN_PART = re.compile(rb"[A-Z]?[a-z]++|[A-Z]++|[A-Z]?[a-z]*+(?:[A-Z][a-z]{2,}+)++|[a-z]*+[0-9]{1,8}")
PLAIN_ID = re.compile(rb"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
PARTS = re.compile(rb"[+/_=-]+")
#: The least and most bytes of a token that counts as a plain one.
PLAIN_BYTES = (12, 200)
#: Windows that the network starts with, at most; windows that one task trains a copy of it on, about, and the rate of that.
START, SHARE, RATE = 10_000, 20_000, 0.002
#: Logits are counted in steps of one over this number, up to so many on either side, to set the threshold.
STEPS, FAR = 1024, 60
#: Bytes of context on either side, and of the candidate.
AROUND, INSIDE = 20, 44
RECALL = 0.95


def _table(*parts: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in parts:
        out[lo : hi + 1] = True
    return out


NOT_HEX = ~_table((0x30, 0x39), (0x61, 0x66))
NOT_TOKEN = ~_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x2D, 0x2D), (0x3D, 0x3D))
DIGIT, UPPER, LOWERS = _table((0x30, 0x39)), _table((0x41, 0x5A)), _table((0x61, 0x7A))
#: Character classes of the network: 0 none, digits, hex letters, other letters by case, frequent punctuation, rest.
CLASS = np.full(256, 15, np.int64)
CLASS[0x30:0x3A] = 1
CLASS[0x61:0x67] = 2
CLASS[0x67:0x7B] = 3
CLASS[0x41:0x47] = 4
CLASS[0x47:0x5B] = 5
for _k, _c in enumerate(b" =:\"'_-/+"):
    CLASS[_c] = 6 + _k
CLASSES = 16
WIDTH = 2 * AROUND + INSIDE


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in bytes."""
    found = []
    if b"=" in text or b":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found


def runs(buf: np.ndarray, off: np.ndarray, other: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    s, e = bounds(buf, off, other)
    long_ = e - s >= least
    return s[long_], e[long_]


def _inside(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[e] - total[s]


def _covered(base: dict[int, list], n: int) -> np.ndarray:
    """Which of n bytes lie in a base span."""
    flags = np.zeros(n + 1, np.int64)
    for spans in base.values():
        for a, _, b in spans:
            flags[a] += 1
            flags[b] -= 1
    return np.cumsum(flags[:-1]) > 0


def scan(buf: np.ndarray, off: np.ndarray) -> tuple[dict[int, list], np.ndarray, np.ndarray]:
    """(base spans by text, starts and ends of the candidates that base spans don't cover as a whole)."""
    base: dict[int, list] = {}
    hs, he = runs(buf, off, NOT_HEX, LEAST_HEX)
    for k, s, e in zip((np.searchsorted(off, hs, "right") - 1).tolist(), hs.tolist(), he.tolist()):
        base.setdefault(k, []).append((s, 2, e))
    marks = np.flatnonzero((buf == 0x3D) | (buf == 0x3A) | (buf == 0x4B))  # = : K
    for k in np.unique(np.searchsorted(off, marks, "right") - 1).tolist():
        at = int(off[k])
        for s, kind, e in base_spans(buf[at : off[k + 1]].tobytes()):
            base.setdefault(k, []).append((s + at, kind, e + at))
    s, e = runs(buf, off, NOT_TOKEN, SHORTEST)
    if len(s):
        digits, upper, lower = (_inside(t[buf], s, e) for t in (DIGIT, UPPER, LOWERS))
        # a capital within: beyond the first character
        mixed = (upper - UPPER[buf[s]] > 0) & (lower > 0)
        ok = ((digits > 0) & (upper + lower > 0)) | mixed
        s, e = s[ok], e[ok]
    if len(s) and base:
        free = _inside(_covered(base, len(buf)), s, e) < e - s
        s, e = s[free], e[free]
    for spans in base.values():
        spans.sort()
    return base, s, e


def windows(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Classes of the bytes before, in and behind each candidate; 0 beyond the text's ends.

    Of a candidate longer than ``INSIDE`` bytes the first and the last half are here; see ``middles`` for the rest.
    """
    out = np.zeros((len(s), WIDTH), np.int64)
    if not len(s):
        return out
    k = np.searchsorted(off, s, "right") - 1
    lo, hi = off[k], off[k + 1]

    def put(column: int, n: int, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        at = start[:, None] + np.arange(n)
        ok = (at >= first[:, None]) & (at < last[:, None])
        out[:, column : column + n] = np.where(ok, CLASS[buf[np.clip(at, 0, len(buf) - 1)]], 0)

    half = INSIDE // 2
    put(0, AROUND, s - AROUND, lo, s)
    put(AROUND, half, s, s, e)
    put(AROUND + half, half, np.maximum(e - half, s + half), s, e)
    put(AROUND + INSIDE, AROUND, e, e, hi)
    return out


def middles(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, window) for what ``windows`` leaves out of long candidates, ``INSIDE`` bytes at a time, with the bytes around as context."""
    half = INSIDE // 2
    n = np.where(e - s > INSIDE, -(-(e - s - INSIDE) // INSIDE), 0)
    which = np.repeat(np.arange(len(s)), n)
    from_ = s[which] + half + ranges(np.zeros(len(s), np.int64), n) * INSIDE
    return which, windows(buf, off, from_, np.minimum(from_ + INSIDE, e[which]))


class Network:
    """Embedding by one-hot classes, a convolution of five characters, maximum and mean over places, one hidden layer."""

    TAPS, FILTERS, HIDDEN = 5, 16, 16

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "w": r.normal(0, 0.25, (self.TAPS, CLASSES, self.FILTERS)), "b": np.zeros(self.FILTERS),
            "h": r.normal(0, 0.2, (4 * self.FILTERS, self.HIDDEN)), "c": np.zeros(self.HIDDEN),
            "o": r.normal(0, 0.3, self.HIDDEN), "d": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.trained = self.judged = 0  # windows

    def _forward(self, x: np.ndarray) -> tuple:
        p, n = self.p, x.shape[1] - self.TAPS + 1
        a = p["b"] + sum(p["w"][t][x[:, t : t + n]] for t in range(self.TAPS))
        a = np.maximum(a, 0)
        # what lies around and what lies inside are pooled on their own
        inside = np.zeros(n, bool)
        inside[AROUND - 2 : AROUND + INSIDE - 2] = True
        parts = [a[:, inside], a[:, ~inside]]
        top = [v.argmax(1) for v in parts]
        f = np.concatenate([np.take_along_axis(v, t[:, None], 1)[:, 0] for v, t in zip(parts, top)] + [v.mean(1) for v in parts], 1)
        h = np.maximum(f @ p["h"] + p["c"], 0)
        return a, inside, parts, top, f, h, h @ p["o"] + p["d"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[-1] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def candidates(self, buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The probability of each candidate: the largest of its windows."""
        out = self.probability(windows(buf, off, s, e))
        which, more = middles(buf, off, s, e)
        np.maximum.at(out, which, self.probability(more))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 5, share: float | None = None, state: dict | None = None) -> None:
        """Adam over windows in random order; ``share`` is that of the findings among all windows, if these are a part of them, and ``state`` what a part leaves to the next."""
        state = {} if state is None else state
        r, m, v, step = np.random.default_rng(seed), state.setdefault("m", {}), state.setdefault("v", {}), state.get("step", 0)
        share = y.mean() if share is None else share
        weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), 64):
                k = order[lo : lo + 64]
                g = self._gradient(x[k], y[k], weight[k])
                step += 1
                for name, d in g.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        state["step"] = step

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        a, inside, parts, top, f, h, z = self._forward(x)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        g = {"o": h.T @ dz, "d": np.array([dz.sum()])}
        dh = dz[:, None] * p["o"] * (h > 0)
        g |= {"h": f.T @ dh, "c": dh.sum(0)}
        df = dh @ p["h"].T
        da = np.zeros_like(a)
        for k, mask in enumerate((inside, ~inside)):
            n = int(mask.sum())
            part = np.repeat(df[:, None, (2 + k) * self.FILTERS : (3 + k) * self.FILTERS] / n, n, 1)
            one = df[:, k * self.FILTERS : (k + 1) * self.FILTERS]
            np.put_along_axis(part, top[k][:, None], np.take_along_axis(part, top[k][:, None], 1) + one[:, None], 1)
            da[:, mask] = part
        da *= a > 0
        g["b"] = da.sum((0, 1))
        n, da = a.shape[1], da.reshape(-1, self.FILTERS)
        classes = np.eye(CLASSES)[x]
        return g | {"w": np.stack([classes[:, t : t + n].reshape(-1, CLASSES).T @ da for t in range(self.TAPS)])}

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling; then the highest threshold, 0.5 at least, at which ``recall`` of the labelled findings are kept."""
        self.calibrate_logits(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_logits(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """``calibrate`` from logits, each of which ``n`` windows have."""
        w = np.array([1.0, 0.0])
        n1, n0 = n[y > 0].sum(), n[y == 0].sum()
        soft = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
            # drawn towards the network's own scale, lest labels that part cleanly make the slope endless
            grad = np.array([(n * (q - soft) * z).sum(), (n * (q - soft)).sum()]) + (w - np.array([1.0, 0.0]))
            s = n * q * (1 - q)
            hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        self.scale, self.shift = float(w[0]), float(w[1])
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
        order = np.argsort(p[y > 0], kind="stable")
        found, upto = p[y > 0][order], np.cumsum(n[y > 0][order])
        self.threshold = max(0.5, float(found[np.searchsorted(upto, int((1 - recall) * n1), "right")])) if len(found) else 0.5
        # anything between the findings kept and the other candidates parts them alike: the middle is the calmest
        other = p[y == 0]
        if len(other) and other.max() < self.threshold:
            self.threshold = max(0.5, float(self.threshold + other.max()) / 2)


def plain(token: bytes) -> bool:
    """Whether a token is a word, a path, a name or an id, and so no secret."""
    return len(token) <= PLAIN_BYTES[1] and (all(PLAIN_PART.fullmatch(x) for x in PARTS.split(token) if x) or bool(PLAIN_ID.fullmatch(token)))


def respelled(value: bytes) -> list[bytes]:
    """Random tokens in other alphabets, drawn from a finding's digest: what a secret looks like, whatever its kind."""
    h = hashlib.sha512(value).digest()
    long_, safe, head = base64.b64encode(h), base64.urlsafe_b64encode(h), bytes(0x61 + x % 26 for x in h[:6])
    letters = bytes(x for x in long_ if x not in b"+/=")
    n = 18 + h[5] % 44
    return [long_[: n + 10], letters[:n], head[: 2 + h[6] % 3] + b"_-"[h[7] % 2 :][:1] + letters[-n:], base64.b32encode(h)[:n], letters[-n:].lower(), safe[-n - 20 : -2], head[h[8] % 3 :] + b"_-"[h[9] % 2 :][:1] + safe[: 16 + h[10] % 12], head[: 4 + h[11] % 3] + b"-" + safe[30 : 48 + h[12] % 8]]


def composed(words: list[bytes], seed: bytes) -> list[bytes]:
    """Paths, names and ids of a text's words."""
    h = hashlib.md5(seed).digest()
    hexes, few = h.hex().encode(), words[h[0] % max(1, len(words) - 5) :][:6]
    number = b"%d" % int.from_bytes(h[1:4])
    date = b"20%02d-%02d-%02d" % (h[4] % 40, 1 + h[5] % 12, 1 + h[6] % 28)
    names = [w[:1].upper() + w[1:].lower() for w in few]
    made = [b"/".join(few), b"_".join(few[:4]), b"-".join([*few[:3], number]), b"/".join([*few[:3], b"v" + number[:2]]), b"".join(names[:4]), b"_".join(few[:3]).upper(), few[0].lower() + b"-" + date + b"-" + number[:4]]
    made += [b"".join(names[:2]) + b"/" + b"".join(names[2:4]) + number[:2], b"-".join([hexes[:8], hexes[8:12], hexes[12:16], hexes[16:20], hexes[20:]])]
    camel = names[0].lower() + b"".join(names[1 : 2 + h[10] % 5])
    made += [camel, camel + b"/" + few[-1].lower() + number[:2], names[0].lower() + few[-1][: 2 + h[11] % 4].upper() + b"".join(names[1:4])]
    # names of models and parts: words, capitals and numbers in turn
    unit = (b"GB", b"mm", b"Pro", b"kWh", b"Ti", b"MHz")
    part = lambda k: few[k % len(few)]
    models = [
        names[0] + part(1)[:3].upper() + number[:4] + part(2)[:2].capitalize() + b"%d" % (h[12] % 64) + unit[h[13] % 6],
        part(0)[:1].lower() + names[-1] + b"%d" % (h[12] % 40) + part(1)[:3].capitalize() + part(2)[:3].capitalize() + b"%d" % (h[13] * 4) + unit[h[14] % 6],
        part(0)[:3].upper() + b"-" + number[:4] + b"-" + part(1)[:2].upper() + number[4:6] + b"-" + names[-1], names[0] + number[:2] + part(1)[:1].upper() + number[2:4] + names[-1] + part(2)[:2].upper() + b"%d" % h[15],
        b"_".join([part(0), part(1)[:2].upper() + number[:3], names[-1] + b"V%d" % (h[12] % 9)]), part(0)[:2].upper() + number[:3] + names[-1] + number[3:5] + part(1)[:1].upper() + b"x" + names[0] + b"%d" % h[12],
    ]
    return [*[made[h[7] % len(made)], made[h[8] % len(made)], made[-4]][: 2 + (h[9] % 4 == 0)], models[h[11] % 6], *[models[h[14] % 6]] * (h[15] % 2)]


def _name(token: bytes) -> int:
    """By which all windows of one finding, however spelled, fall into the same part of the sample."""
    return int.from_bytes(hashlib.md5(token).digest()[:7])


def _alone(tokens: list[bytes], words: list[bytes], named: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of tokens that stand between words, and the tokens' names."""
    texts = []
    for k, x in enumerate(tokens):
        texts += [b" ".join(words[k % len(words) :][:4])[-30:] + b" ", x, b" " + b" ".join(words[-1 - k % len(words) :][:4])[:30]]
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    return _every(np.frombuffer(b"".join(texts), np.uint8), at[::3], at[1::3], at[2::3], np.array(named, np.int64))


def _every(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of candidates, their middles too, and the names of the candidates that they are of."""
    which, middle = middles(buf, off, s, e)
    return np.concatenate((windows(buf, off, s, e), middle)), np.concatenate((named, named[which]))


@released
def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with labels and names: what the patterns find, also without its context and in other alphabets; against plain tokens, found and composed.

    A window in another alphabet has the name of the finding that it was drawn from.
    """
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            buf, off = text_buffers(b.column("text"))
            base, _, _ = scan(buf, off)
            spans = [(a, z) for v in base.values() for a, kind, z in v]
            ps, pe = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
            # an assignment's value is its finding, not the word before it
            for k, (a, z) in enumerate(spans):
                if m := ASSIGN.match(buf[a:z].tobytes()):
                    ps[k] = a + m.start(2)
            s, e = runs(buf, off, NOT_TOKEN, PLAIN_BYTES[0])
            if len(s):
                s, e = (v[_inside(_covered(base, len(buf)), s, e) == 0] for v in (s, e))
            first = np.searchsorted(s, off)
            keep, good, bad = [], [(windows(buf, off, ps, pe), np.array([_name(buf[a:z].tobytes()) for a, z in zip(ps, pe)], np.int64))], []
            for k in range(b.num_rows):
                text = buf[off[k] : min(off[k + 1], off[k] + 4096)].tobytes()
                words = [x for x in re.findall(rb"[A-Za-z]{2,12}", text)[:200]] or [b"the"]
                keep += [x for x in range(first[k], first[k + 1]) if plain(buf[s[x] : e[x]].tobytes())]
                made = composed(words, text)
                made = [x for x in made if len(x) >= PLAIN_BYTES[0]]
                bad.append(_alone(made, words, [_name(x) for x in made]))
                if k in base:
                    here = np.flatnonzero((ps >= off[k]) & (ps < off[k + 1]))
                    values = [buf[ps[x] : pe[x]].tobytes() for x in here]
                    values = [x for x in dict.fromkeys(values) if not plain(x)]
                    spelled = [(y, _name(x)) for x in values for y in (x, *respelled(x))]
                    good.append(_alone([y for y, _ in spelled], words, [n for _, n in spelled]))
            if keep:
                bad.append(_every(buf, off, s[keep], e[keep], np.array([_name(buf[s[x] : e[x]].tobytes()) for x in keep], np.int64)))
            x, named = (np.concatenate([part[k] for part in good + bad]) for k in (0, 1))
            y = (np.arange(len(x)) < sum(len(part[0]) for part in good)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.uint8)], pa.binary()), pa.array(y), pa.array(named)], ["x", "y", "name"])


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64), b.column("y").to_numpy().astype(np.float64)


def _copies(net: Network, share: float):
    """Each task trains a copy of the network on its windows and gives its numbers, as often as it has windows."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, n = copy.deepcopy(net), {}, 0
        for b in batches:
            x, y = _windows(b)
            own.train(x, y, 1, RATE, n, share, state)
            n += len(x)
        if n:
            numbers = np.concatenate([own.p[k].ravel() for k in sorted(own.p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers), pa.array(np.full(len(numbers), n))], ["at", "number", "n"])

    return run


def _logits(net: Network):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _windows(b)
            z = np.rint(np.clip(net.logits(x), -FAR, FAR) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(z)], ["y", "z"])

    return run


def fit(labelled: DataFrame, start: int = START, recall: float = RECALL) -> Network:
    """A network from all texts whose findings the patterns label, and all their plain tokens.

    ``start`` windows at most, picked by hashes, give the network that each task then trains a copy of, on about ``SHARE`` windows; every window but those kept unseen trains once,
    and the copies' mean, by their windows, is the result.  Besides, names are composed of words at the start of each text (200 of its first 4,096 bytes).  Windows that
    repeat count once.  The threshold is set on all findings and tokens that training hasn't seen in any spelling: a quarter of them, by their names.
    Null texts aren't read; an empty table, or texts with too few findings, give a network that finds nothing.
    """
    spark = labelled.sparkSession
    text_batches(spark)
    texts = labelled.where(F.col("text").isNotNull()).select("text")
    rows = texts.mapInArrow(_labelled, "x binary, y int, name long").groupBy("x", "y").agg(F.min("name").alias("name"))
    unseen = F.pmod(F.col("name"), F.lit(4)) == 0
    scratch = Scratch(spark, "windows")
    rows = scratch.save(rows.withColumn("unseen", unseen))  # labelled once
    sizes = {(r.y, r.unseen): r.n for r in rows.groupBy("y", "unseen").agg(F.count(F.lit(1)).alias("n")).collect()}
    data = [rows.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(start // 2).collect() for y in (0, 1)]
    net = Network()
    if min(map(len, data)) < 20:
        net.threshold = 2.0
        return net
    few = [r for part in data for r in part if not r.unseen]
    order = np.random.default_rng(9).permutation(len(few))
    net.train(np.array([np.frombuffer(few[k].x, np.uint8) for k in order]).astype(np.int64), np.array([few[k].y for k in order], np.float64))
    good, bad = (sizes.get((y, False), 0) for y in (1, 0))
    dealt = rows.where(~F.col("unseen")).repartition(max(1, -(-(good + bad) // SHARE)), "x").sortWithinPartitions(F.xxhash64("x"), "x", "y")
    # sums of decimals, so that reruns agree
    total = F.sum((F.col("number") * F.col("n")).cast("decimal(28,12)"))
    mean = dealt.mapInArrow(_copies(net, good / (good + bad)), "at int, number double, n long").groupBy("at").agg((total.cast("double") / F.sum("n")).alias("number"), F.sum("n").alias("n")).orderBy("at").collect()
    numbers, at = np.array([r.number for r in mean]), 0
    for k in sorted(net.p):
        net.p[k], at = numbers[at : at + net.p[k].size].reshape(net.p[k].shape), at + net.p[k].size
    z = rows.where("unseen").mapInArrow(_logits(net), "y int, z int").groupBy("y", "z").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "z").collect()
    net.calibrate_logits(np.array([r.z / STEPS for r in z]), np.array([float(r.y) for r in z]), np.array([float(r.n) for r in z]), recall)
    net.trained, net.judged = mean[0].n, sum(r.n for r in z)
    scratch.drop(rows)
    return net


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanner(net: Network):
    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                buf, off = text_buffers(b.column("text"))
                found, s, e = scan(buf, off)
                if len(s) and net.threshold <= 1:
                    good = net.candidates(buf, off, s, e) >= net.threshold
                    for k, a, z in zip((np.searchsorted(off, s[good], "right") - 1).tolist(), s[good].tolist(), e[good].tolist()):
                        found.setdefault(k, []).append((a, 3, z))
                counts = np.zeros((b.num_rows, 3), np.int64)
                empty = hashlib.sha256(b"").hexdigest()
                digests, spans = [empty] * b.num_rows, [""] * b.num_rows
                for k, rows in found.items():
                    # bytes to code points: those before that begin a character
                    text = buf[off[k] : off[k + 1]]
                    chars = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                    names = [(kind, f"{KINDS[kind]}:{chars[a - off[k]]}:{chars[z - off[k]]}") for a, kind, z in sorted(rows)]
                    for kind in range(3):
                        counts[k, kind] = sum(x == kind for x, _ in names)
                    digests[k] = hashlib.sha256(",".join(n for kind, n in names if kind < 3).encode()).hexdigest()
                    spans[k] = ",".join(n for _, n in names)
                keep = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests), pa.array(spans)], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find


def find_secrets(docs: DataFrame, net: Network, *columns: str) -> DataFrame:
    """(doc_id, *columns, n_assign, n_access, n_hex, base_sha256, spans) of every row's whole text.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind; ``base_sha256`` digests those of the patterns
    alone.  A null or an empty text has no spans; an empty table gives an empty result; a very long text, and a very long candidate, is read whole.
    Repeated rows give repeated results.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", *columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(scanner(net), f"{schema}, {FOUND}")


def redacter(net: Network):
    """The text with every span replaced by ``<secret>``; spans that overlap become one."""

    @released
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                column = b.column("text")
                (rows,) = scanner(net)(iter([pa.RecordBatch.from_arrays([column], ["text"])])) if b.num_rows else (None,)
                texts = column.to_pylist()
                for k, spans in enumerate(rows.column("spans").to_pylist() if rows else []):
                    if spans:
                        out, at, t = [], 0, texts[k]
                        for _, a, z in (x.split(":") for x in spans.split(",")):
                            if int(a) >= at:
                                out += [t[at : int(a)], "<secret>"]
                            at = max(at, int(z))
                        texts[k] = "".join(out) + t[at:]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in b.schema.names], b.schema.names)

    return redact


def redact_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with its columns, each text's secrets replaced by ``<secret>``; a null text stays null."""
    text_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(redacter(net), schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, fit(docs))
