"""Byte-level BPE through sentencepiece: a model serialised from a rank vocabulary.

Every byte is mapped to a printable character of its own, every token of the vocabulary to the string of its mapped
bytes, scored by its negative rank, and the normaliser is the identity. Merging the best-scored neighbours is then
merging by lowest rank. Texts are split by the vocabulary's pattern; each pre-token is encoded on its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

CACHE_TOKENS = 150_000
LONG_TEXT = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, other = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(other))
            other += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _sized(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto in wire format: piece 0 is unknown, piece ``k + 1`` the token of the ``k``-th smallest rank."""
    chars = byte_characters()
    piece = lambda text, score, kind: _sized(1, _sized(1, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    parts = [piece("<unk>", 0.0, 2)]
    for token in sorted(ranks, key=ranks.__getitem__):
        parts.append(piece("".join(chars[b] for b in token), -float(ranks[token]), 1))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(parts))) + _field(40, 0, _varint(0))
    trainer += b"".join(_field(n, 0, _varint((1 << 64) - 1)) for n in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _sized(1, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(parts) + _sized(2, trainer) + _sized(3, normaliser)


class _Merged(dict):
    """Ids by pre-token, encoded on first sight; emptied when it holds ``CACHE_TOKENS``."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[piece] = ids
        return ids


_LATIN = 0x250


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern with its classes spelt out for characters below U+0250, for the faster standard engine."""
    chars = [chr(c) for c in range(_LATIN)]
    named = {c: "".join(re.escape(x) for x in chars if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    blank = "".join(re.escape(x) for x in chars if regex.match(r"\s", x))
    out = pattern.replace(r"\S", f"[^{blank}]")
    for name, members in named.items():
        out = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m, x=members: m[1] + x, out)
        out = out.replace(name, f"[{members}]")
    return re.compile(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.ids = sorted(ranks.values())
        self.whole = ranks
        self.wide, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.beyond = re.compile(f"[^\0-{chr(_LATIN - 1)}]")
        self.mapped = dict(enumerate(byte_characters()))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.seen = _Merged(self._encode_piece)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        rank = self.whole.get(raw)
        if rank is not None:
            return (rank,)
        ids = self.ids
        return tuple([ids[k - 1] for k in self.model.encode(raw.decode("latin-1").translate(self.mapped))])

    def pieces(self, text: str) -> Iterable[str]:
        """Pre-tokens; of long texts one by one."""
        split = self.wide if self.beyond.search(text) else self.latin
        return split.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in split.finditer(text))

    def encode(self, text: str) -> array:
        """Ids of the whole text, in order."""
        return array("I", chain.from_iterable(map(self.seen.__getitem__, self.pieces(text))))

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One encoder for each vocabulary and worker."""
    return ByteBpe(read_ranks(path), pattern)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.frombuffer(r, dtype=np.uint32) for r in rows if r] or [np.zeros(0, np.uint32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids array<bigint>``.

    The digests are of the ids as little-endian 32-bit numbers and of the bytes that decoding them gives back. Null and
    empty texts have no tokens. Rows with a null id and repeated rows give a result row each; an empty table gives an empty
    result; other columns are not read. Nothing is shuffled; a worker holds the vocabulary, a bounded cache and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            counts, hashes, back, all_ids = [], [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(little_endian(ids)).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            out = [b.column(0), pa.array(counts, type=pa.int64()), pa.array(hashes, type=pa.string()), pa.array(back, type=pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, _lists(all_ids)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from id lists; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            texts = [bpe.decode(array("I", ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
