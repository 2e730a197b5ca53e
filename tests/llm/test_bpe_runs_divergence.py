"""BPE against the library, periodic runs against all pairs, divergence against exact arithmetic."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, divergence, periodic_runs

# ----------------------------------------------------------------------------- BPE

ODD = [
    "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x <|endoftext|>", "  a   b\n\n c\t\td  ", "it's we'll I'D 'll x'", "日本語テキスト、です。", "a" * 5000, " " * 3000, "\x1c\x1d x", "é ñ 123abc ½", "<|endoftext|", "--'s-'re",
    " 　 x \x85y", "\U00031350\U00031351 \U00010d40x ࡰࣈ \U0001e5f1", "word " * 40_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))


def by_library(vocabulary, texts):
    t = vocabulary.tokenizer()
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_are_the_librarys_and_decoding_gives_the_text(spark, vocabulary):
    rows = [*enumerate([*ODD, "", None]), (None, "x y"), (None, "x y"), (3, "twin id")]
    d = spark.createDataFrame([(k, t, "mine") for k, t in rows], "doc_id long, text string, _row string")
    got = bpe.decode(bpe.encode(d, vocabulary, text=True), vocabulary).collect()
    assert len(got) == len(rows) and all(r._row == "mine" for r in got)
    for r in got:
        assert list(r.ids) == by_library(vocabulary, [r.text])[0] and r.decoded == (r.text or "")


def test_every_character_is_split_as_the_library_does(spark, vocabulary):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(every[k : k + 5000]) for k in range(0, 30_000, 5000)] + ["-".join(every[k : k + 20_000]) for k in range(60_000, len(every), 200_000)]
    texts += [" ".join(every[k : k + 3000]) for k in (0x840, 0x10500, 0x13400, 0x1CC00, 0x1E000, 0x31000)]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), vocabulary).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == by_library(vocabulary, texts)


def test_batches_parts_and_numbers(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 2_000)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "of", "und", f"w{r.randint(0, 500)}", "x" * r.randint(1, 50)]) for _ in range(r.randint(0, 200))) for _ in range(400)]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), vocabulary).orderBy("doc_id").collect()
    assert [list(x.ids) for x in got] == by_library(vocabulary, texts)
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_152, 2**31 - 1])
    assert (bpe.unpacked(bpe.packed(x)[0]) == x).all() and len(bpe.unpacked(np.zeros(0, np.uint8))) == 0


def test_decoding_of_odd_ids(spark, vocabulary):
    d = spark.createDataFrame([(1, [50256, 99_999, None, -1, 15496]), (2, []), (3, None), (4, [222, 222])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(d, vocabulary).collect()}
    assert got == {1: "<|endoftext|>Hello", 2: "", 3: "", 4: vocabulary.tokenizer().decode([222, 222], skip_special_tokens=False)}
    assert bpe.encode(d.select(F.lit("").alias("text")).limit(0), vocabulary).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


# ----------------------------------------------------------------------------- periodic runs


def all_runs(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(6, 4 * q) and not any(all(x[s + t] == x[s + t + p] for t in range(n - p)) for p in range(1, q)):
                found.append((s, n, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(r):
    k, x = r.choice([1, 2, 3, 5]), []
    while len(x) < r.randint(0, 120):
        x += [str(r.randrange(k)) for _ in range(r.randint(1, 9))] * (r.randint(1, 7) if r.random() < 0.4 else 1)
    return x


def test_runs_equal_brute_force(spark):
    r = random.Random(1)
    texts = [random_words(r) for _ in range(1500)] + [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], [str(k % 600) for k in range(2400)]]
    d = spark.createDataFrame([(k, r.choice(["  ", "\n"]).join(x), "r", 1) for k, x in enumerate(texts)], "doc_id int, text string, _row string, runs int")
    for row in periodic_runs.collapse_runs(d).collect():
        x = texts[row.doc_id]
        want = all_runs(x)
        assert [tuple(y) for y in row.runs] == want and row._row == "r"
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(x) if i not in gone)


def test_highest_run_and_awkward_texts(spark, awkward, nothing):
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    d = spark.createDataFrame([([(0, 6, 1), (9, 12, 2), (30, 12, 2)],), ([(0, 9, 2), (20, 13, 3)],), ([],)], f"runs {kind}")
    assert [r.b and tuple(r.b) for r in d.select(periodic_runs.highest(F.col("runs")).alias("b")).collect()] == [(0, 6, 1), (0, 9, 2), None]
    got = periodic_runs.collapse_runs(awkward).collect()
    assert len(got) == awkward.count() and {len(r.runs) for r in got if r.doc_id == 5} == {1} and [r.collapsed for r in got if r.doc_id == 5] == ["lorem ipsum dolor sit amet"]
    assert all(r.runs == [] and r.collapsed == "" for r in got if not r.text) and periodic_runs.collapse_runs(nothing).count() == 0


# ----------------------------------------------------------------------------- divergence


def exact_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = term.findall((text or "").translate(low))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in df.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def shares(c, lang):
        n, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept[lang]}

    out, f = [], lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), c in counts.items():
        p, q = shares(c, lang), shares(whole[lang], lang)
        pairs = [(sum(f(p[t], o[t]) for t in kept[lang]), s) for (l2, s), c2 in counts.items() if l2 == lang and s != source for o in [shares(c2, lang)]]
        words = [(f(p[t], q[t]), t) for t in kept[lang] if c[t] > 0 and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", words)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 500, "count_bytes": 200, "piece": 20, "per_shard": 4}])
def test_divergence_equals_exact_arithmetic(spark, blocks):
    r = random.Random(7)
    words = [f"{a}{b}" for a in "äbcdé日" for b in "xyzüwq"] + ["Term", "TERM", "term"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "é"]), " ".join(r.choice(words[: 5 + k % 34]) for _ in range(r.randint(0, 30)))) for k in range(300)]
    rows += [("fr", "a", "Rien"), ("fr", "b", None), ("la", "solo", "x"), ("en", "empty", "12 34")] + [("en", "a", "same words here")] * 12
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "lang string, source string, text string, slot int")
    got = sorted(map(tuple, divergence.divergence(d, least=5, top=4, **blocks).collect()))
    assert got == exact_divergence(rows, 5, 4)
    assert divergence.divergence(d.limit(0)).count() == 0


def test_perfect_hashes_are_minimal():
    for n in (1, 2, 3, 7, 100, 3000):
        h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        move, slot = divergence.displaced(h)
        assert sorted(slot) == list(range(n)) and len(move) == -(-n // 4)


def test_terms_whose_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_hashes", lambda words: np.array([7 if w in (b"aa", b"bb") else int(hashlib.md5(w).hexdigest()[:8], 16) for w in words], np.uint64))
    import pandas as pd

    row = divergence._build(("en", 0), pd.DataFrame({"term": ["aa", "bb", "cc"], "_n": [1, 1, 1]})).iloc[0]
    assert sorted(row.twins) == ["aa", "bb"] and list(row.numbered) == ["cc", "aa", "bb"] and row.n == 3
