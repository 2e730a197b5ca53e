"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark, by the tokenizer's own rule, once.  The words of a batch of texts are numbered, so that a text is a list of numbers and the
batch a list of distinct words.  These lists are dealt out by a hash of the word, which makes the table of distinct words: each word is encoded once, by the tokenizers
library, and its ids go back to every batch that has it, and by position into the texts.  A word that is in every text comes once from each batch, so
no key is hot and nothing is broadcast; the texts' numbers lie in buckets by batch and aren't shuffled.  Decoding joins ids to their pieces and the pieces, in order, to a text.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, freed, ranges, released, text_batches

#: Bytes of words in one batch of texts; the text that goes beyond ends it.
BATCH_BYTES = 6 << 20
#: Parts of the table of distinct words for each partition of a shuffle.
PARTS = 2

# Letters and numbers of Unicode 14 to 16, which the tokenizers library knows and Java 17 doesn't, and white space.
LATER_LETTERS = """
    0870-0887 0889-088E 08B5 08C8-08C9 0C5D 0CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4
    10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA
    10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746
    11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3
    1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB
    1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
SPACES = r"\x09-\x0D\x20[\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _later(listed: str) -> str:
    """A class within a class, asked last and for characters from its first one on: Java asks the parts of a class one after the other."""
    code = lambda x: rf"\x{{{x}}}"
    parts = "".join("-".join(map(code, r.split("-"))) for r in listed.split())
    return f"[{code(listed.split()[0].split('-')[0])}-{code('10FFFF')}&&[{parts}]]"


L, N = rf"\p{{L}}{_later(LATER_LETTERS)}", rf"\p{{N}}{_later(LATER_NUMBERS)}"
#: The rule that parts words, as Java reads it.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{SPACES}{L}{N}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

# ----------------------------------------------------------------------------- vocabulary


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE tokenizer file; the driver reads it, and tasks get its text."""

    text: str
    special: tuple[str, ...]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Only what the rule above and the byte alphabet express is accepted; truncation and padding are left out."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, dec, added = made["pre_tokenizer"] or {}, made["decoder"] or {}, made["added_tokens"]
        plain = made["normalizer"] is None and pre.get("type") == dec.get("type") == "ByteLevel" and made["model"]["type"] == "BPE"
        if not plain or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE tokenizer")
        special = sorted((t["content"] for t in added), key=lambda x: (-len(x), x))
        return cls(json.dumps(made | {"truncation": None, "padding": None}, ensure_ascii=False), tuple(special))

    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_str(self.text)

    def pieces(self) -> list[bytes]:
        """The bytes of each id; empty for ids that aren't there."""
        # the byte alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        vocab = self.tokenizer().get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            out[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        return out


# ----------------------------------------------------------------------------- words


def words(text: Column, special: tuple[str, ...] = ()) -> Column:
    """The words of a text in order; together they are the text.  Special tokens stand for themselves wherever they occur."""
    split = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    if not special:
        return split(text)
    rule = "|".join(map(re.escape, special))
    between = lambda found: F.flatten(F.transform(F.split(text, rule, -1), lambda t, i: F.concat(split(t), F.array_compact(F.array(F.get(found, i))))))
    # the array of one list binds it, so that it is found once
    with_special = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(rule), F.lit(0))), between), F.lit(0))
    return F.when(F.greatest(F.lit(False), *(F.contains(text, F.lit(s)) for s in special)), with_special).otherwise(split(text))


# ----------------------------------------------------------------------------- numbers in bytes


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each number): seven bits a byte, the lowest first; all bytes of a number but its last have the top bit."""
    n = np.ones(len(x), np.int64)
    for k in range(1, 5):
        n += x >= 1 << 7 * k
    out, at = np.zeros(int(n.sum()), np.uint8), np.cumsum(n) - n
    for k in range(5):
        more = np.flatnonzero(n > k)
        out[at[more] + k] = (x[more] >> 7 * k) & 127 | np.where(n[more] > k + 1, 128, 0)
    return out, n


def unpacked(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    x = (data[start] & 127).astype(np.int64)
    for k in range(1, 5):
        more = np.flatnonzero(end - start >= k)
        x[more] |= (data[start[more] + k] & 127).astype(np.int64) << 7 * k
    return x


# ----------------------------------------------------------------------------- encoding


def _cut(data: np.ndarray, size: np.ndarray, ptr: np.ndarray) -> pa.BinaryArray:
    """Packed numbers (bytes, bytes of each) in parts: part k has the numbers from ptr[k] to ptr[k + 1]."""
    edge = np.concatenate(([0], np.cumsum(size)))[ptr].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))])


def _number(parts: int):
    """The kernel that numbers words: a row for each text with its words' numbers, and for each batch its distinct words in parts, by a hash, with their numbers."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        size, name, kind = 0, 0, None

        def dealt() -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in number]
            part = np.array([zlib.crc32(w) % parts for w in words])
            order = np.argsort(part, kind="stable")
            length = np.array([len(w) for w in words])[order]
            ptr = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0, [True])))
            body = [pa.compress(b"".join([words[k] for k in order[a:z]]), "zstd", asbytes=True) for a, z in zip(ptr[:-1], ptr[1:])]
            n = len(ptr) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, name)), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(part[order][ptr[:-1]], pa.int32()), pa.array(body, pa.binary()), _cut(*packed(length), ptr), _cut(*packed(order), ptr)],
                names=["_batch", "_row", "_codes", "_part", "_words", "_lengths", "_numbers"],
            )
            number.clear()

        for whole in batches:
            kind = whole.column("_row").type
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                if not number:
                    name = uuid.uuid4().int >> 65
                lists = b.column("_words")
                ptr = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.slice(ptr[0], ptr[-1] - ptr[0])
                coded = flat.dictionary_encode()
                own = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int64)
                codes = _cut(*packed(own[coded.indices.to_numpy()]), ptr - ptr[0])
                none = [pa.nulls(len(b), k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), name)), b.column("_row"), codes, *none], names=["_batch", "_row", "_codes", "_part", "_words", "_lengths", "_numbers"])
                size += pc.sum(pc.binary_length(flat)).as_py() or 0
                if size >= BATCH_BYTES:
                    yield from dealt()
                    freed()
                    size = 0
        if number:
            yield from dealt()

    return run


def _encoder(vocabulary: Vocabulary):
    """The kernel that encodes the distinct words of a part of the table, each once, and gives the ids of each batch's words."""
    made: list[Tokenizer] = []

    def encode(part: pa.Table) -> pa.Table:
        if not made:  # once a task
            made.append(vocabulary.tokenizer())
        length = [unpacked(np.frombuffer(x, np.uint8)) for x in part.column("_lengths").to_pylist()]
        body = b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(part.column("_words").to_pylist(), length))
        n = np.concatenate(length)
        edge = np.concatenate(([0], np.cumsum(n)))
        words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(body)).dictionary_encode()
        ids = [e.ids for e in made[0].encode_batch_fast(words.dictionary.to_pylist(), add_special_tokens=False)]
        size = np.array([len(x) for x in ids])
        flat, start = np.array([k for x in ids for k in x], np.int64), np.cumsum(size) - size
        own = words.indices.to_numpy().astype(np.int64)
        ptr = np.concatenate(([0], np.cumsum([len(x) for x in length])))
        placed = np.concatenate(([0], np.cumsum(size[own])))[ptr]
        out = pa.Table.from_arrays([part.column("_of"), part.column("_part"), _cut(*packed(size[own]), ptr), _cut(*packed(flat[ranges(start[own], size[own])]), placed)], names=["_of", "_of_part", "sizes", "ids"])
        freed()
        return out

    return encode


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where its values begin and end."""
    data = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    cut = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[cut[0] : cut[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
    return raw, cut - cut[0]


def _place(rows: pa.Table, known: pa.Table) -> Iterator[pa.RecordBatch]:
    """The ids of one batch's texts: the numbers of their words, each replaced by the ids of the word.

    ``rows`` are the texts, and the parts of the batch's words with the words' numbers; ``known`` has the ids of each part's words in the same order.
    """
    lists = rows.filter(pc.is_valid(rows.column("_part"))).select(["_part", "_numbers"]).sort_by("_part")
    number = unpacked(_bytes(lists.column("_numbers"))[0])
    known = known.select(["_of_part", "sizes", "ids"]).sort_by("_of_part")
    size, ids = (unpacked(_bytes(known.column(c))[0]) for c in ("sizes", "ids"))
    n_of, start_of = np.zeros(len(number) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
    n_of[number], start_of[number] = size, np.cumsum(size) - size
    ids = ids.astype(np.int32)
    texts = rows.filter(pc.is_valid(rows.column("_codes"))).select(["_row", "_codes"])
    for b in texts.combine_chunks().to_batches(max_chunksize=200):
        raw, cut = _bytes(pa.chunked_array([b.column("_codes")]))
        word = unpacked(raw)
        n = n_of[word]
        edge = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(raw < 128)))[cut]]
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids[ranges(start_of[word], n)], pa.int32()))], names=["_row", "ids"])


def _placed(rows: pa.Table, known: pa.Table) -> pa.Table:
    out = pa.Table.from_batches(_place(rows, known), pa.schema([("_row", rows.schema.field("_row").type), ("ids", pa.list_(pa.int32()))]))
    freed()
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, text: bool = False) -> DataFrame:
    """``docs`` (which has text) with ``ids``, an array of the ids of the whole text's tokens; the text itself only if ``text`` says so.

    A column named ids is replaced, others stay.  Special tokens are recognised wherever they stand.  A null or empty text has no ids; very long texts are read
    whole; rows that repeat are separate rows, and need no doc_id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    columns = [c for c in docs.columns if c != "ids" and (text or c != "text")] or ["text"]
    rows = docs.select(F.struct(*columns).alias("_row"), F.coalesce(words(F.col("text"), vocabulary.special), F.array().cast("array<string>")).alias("_words"))
    kind = rows.schema["_row"].dataType.simpleString()
    n = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"_batch long, _row {kind}, _codes binary, _part int, _words binary, _lengths binary, _numbers binary"
    parts = Scratch(spark, "bpe").save_in_buckets(rows.mapInArrow(_number(n), schema), "_batch")
    table = parts.where("_part is not null").select("_part", F.col("_batch").alias("_of"), "_words", "_lengths")
    known = table.groupBy("_part").applyInArrow(_encoder(vocabulary), "_of long, _of_part int, sizes binary, ids binary")
    rows = parts.select("_batch", "_row", "_codes", "_part", "_numbers")
    out = rows.groupBy("_batch").cogroup(known.groupBy("_of")).applyInArrow(_placed, f"_row {kind}, ids array<int>")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in columns), "ids")


# ----------------------------------------------------------------------------- decoding


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (ids) with ``decoded``: each id joined to its piece, pieces joined in order; a column of this name is replaced, others stay.

    The key of the join is the id itself, which counts from 0, so that the table of pieces (as many as the vocabulary has, as hexadecimal digits, a constant of the
    plan) is read by place, in the JVM.  Bytes that are no UTF-8 become replacement characters; ids that are null or not in the vocabulary give nothing; null ids
    give an empty text; special tokens are kept.
    """
    # splitting a constant makes a constant
    pieces = F.split(F.lit(",".join(p.hex() for p in vocabulary.pieces())), ",", -1)
    found = F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(pieces, i))
    text = F.make_valid_utf8(F.unhex(F.array_join(found, "")).cast("string"))
    return encoded.select(*(c for c in encoded.columns if c != "decoded"), text.alias("decoded"))


# ----------------------------------------------------------------------------- query


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, for every document."""
    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, vocabulary).select("doc_id", "ids")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(ids, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
