"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Nothing is trained. Every token's bytes are mapped to printable characters (one per byte), the token becomes a piece
whose score is its negative rank, and the model is serialised by hand as a protocol buffer with identity
normalisation. Texts are split by the vocabulary's own pattern; each match is byte-mapped and encoded by itself, so
merges never cross matches. Decoding inverts the mapping piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow

#: What \s means to the reference encoder: Unicode's White_Space property (unlike Python's, without \x1c to \x1f).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_characters() -> list[str]:
    """A printable character for every byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i, one unknown piece follows.

    Fields: ModelProto pieces=1, trainer_spec=2, normalizer_spec=3; SentencePiece piece=1, score=2, type=3 (1 normal,
    2 unknown); TrainerSpec model_type=3 (2 is BPE), vocab_size=4, unk/bos/eos/pad id=40..43; NormalizerSpec name=1,
    add_dummy_prefix=3, remove_extra_whitespaces=4, escape_whitespaces=5.
    """
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be gapless from 0")
    out = bytearray()
    for token, rank in by_rank:
        piece = "".join(chars[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, 1))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2))
    none = (1 << 64) - 1
    out += _bytes_field(2, _int_field(3, 2) + _int_field(4, len(by_rank) + 1) + _int_field(40, len(by_rank)) + _int_field(41, none) + _int_field(42, none) + _int_field(43, none))
    out += _bytes_field(3, _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes with the serialised model. Recurring matches are looked up, never more than `keep` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 200_000):
        import re

        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.bytes_of = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        self.whole = ranks
        self.map = {b: ord(c) for b, c in enumerate(self.chars)}
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")).findall
        # The same pattern where every character is ASCII.
        ascii_ = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
        self.split_ascii = re.compile(ascii_, re.ASCII).findall
        self.keep, self.known = keep, {}

    def _ids(self, match: str) -> list[int]:
        raw = match.encode()
        rank = self.whole.get(raw)
        return [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.map))

    def encode(self, text: str) -> list[list[int]]:
        """The ids of each match of the pattern."""
        known, out = self.known, []
        if len(known) > self.keep:
            known.clear()
        for m in (self.split_ascii if text.isascii() else self.split)(text):
            ids = known.get(m)
            if ids is None:
                ids = self._ids(m)
                if len(m) <= 64:
                    known[m] = ids
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; only with_ids), ids_sha256, decoded_sha256, for every row.

    Null texts count as empty: no tokens and the hashes of no bytes. Repeated rows are encoded each. Other columns are
    not read. An empty table gives no rows. `path` names the rank file, which every executor must find there.
    """
    schema = "doc_id long, n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        own = codec(path, pattern)
        text_of = {}
        for whole in batches:
            for batch in chunks(whole, "raw"):
                n, ids_out, first, second = [], [], [], []
                for raw in batch.column(1).to_pylist():
                    ids = list(chain.from_iterable(own.encode(raw.decode("utf-8", "replace")))) if raw else []
                    if len(text_of) < len(own.bytes_of):
                        text_of.update((i, str(i)) for i in range(len(own.bytes_of)))
                    n.append(len(ids))
                    if with_ids:
                        ids_out.append(ids)
                    first.append(hashlib.sha256(",".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                cols = [batch.column(0), pa.array(n, pa.int64())] + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []) + [pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["doc_id", "n_tokens"] + (["ids"] if with_ids else []) + ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).transform(map_arrow, run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text, bytes that are not UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(map_arrow, run, "doc_id long, text string")
