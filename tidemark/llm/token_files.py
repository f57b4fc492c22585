"""Token ids as binary files: tokenized, cut into blocks, range coded, and read back.

A file holds whole documents in ascending order of ``doc_id``; files are ordered by part and number. Its layout, all
numbers little-endian::

    magic, part u32, number u32, id bits u8, ids of a block u32, documents u64, ids u64, table length u32, crc32 u32
    table: for each document a varint of (zigzag of doc_id less the one before, shifted by one, plus one if it is null)
           and a varint of its number of ids
    for each block: payload length u32, crc32 u32, payload

The first crc32 covers the head before it and the table, a block's covers its payload and its number, so that blocks
cannot change places. Every block starts a model of its own (:mod:`tidemark.llm.idcoder`), so one document can be read by
decoding only the blocks that hold it. Spark's text writer writes a file as one record, hence the end mark.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.idcoder import decode_blocks, encode_blocks
from tidemark.llm.store import fresh_path, small_batches, stash

MAGIC, END_MARK = b"TIDM", "TIDEND"
_HEAD = struct.Struct("<4sIIBIQQI")
_CRC = struct.Struct("<I")
_BLOCK = struct.Struct("<II")
#: Ids of a block, and blocks after which a file ends with the document.
BLOCK_IDS, FILE_BLOCKS = 2048, 4096
#: Chunks that a worker remembers, and chunks encoded as one text.
CACHE_CHUNKS, JOINED = 400_000, 100
_CUT = re.compile(r" (?=\S)")


class IdEncoder:
    """Whole texts to ids by a tokenizer of the tokenizers library.

    A byte-level tokenizer with the usual pattern never joins what stands before a space with the word that the space
    belongs to. Texts are cut there, and the library encodes each different chunk of a batch once; other tokenizers get
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        whole = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in made.get("added_tokens") or [])
        self.cuts = bool(plain and whole and not made.get("normalizer"))
        self.id_bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        #: Ids, as bytes, of a space and a chunk that begins with no white space; emptied when it holds ``CACHE_CHUNKS``.
        self.chunks: dict[str, bytes] = {}
        self.begins = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(1 << self.id_bits)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Enter chunks: some without a space are encoded as one text, in which each begins with the only token that has one."""
        joined = [c for c in new if " " not in c]
        for k in range(0, len(joined), JOINED):
            some = joined[k : k + JOINED]
            raw = self._whole(" " + " ".join(some))
            starts = np.flatnonzero(self.begins[np.frombuffer(raw, dtype="<u4")]).tolist()
            if len(starts) == len(some):
                cuts = [4 * i for i in starts] + [len(raw)]
                self.chunks.update((c, raw[i:j]) for c, i, j in zip(some, cuts, cuts[1:], strict=False))
        self.chunks.update((c, self._whole(" " + c)) for c in new if c not in self.chunks)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.cuts:
            return [self._whole(t) if t else b"" for t in texts]
        parts = [t.split(" ") for t in texts]
        new = set(chain.from_iterable(p[1:] for p in parts)).difference(self.chunks)
        odd = {c for c in new if not c or c[0].isspace()}  # spaces beside other white space
        if odd:
            parts = [p if odd.isdisjoint(p[1:]) else _CUT.split(t) for p, t in zip(parts, texts, strict=True)]
            new = set(chain.from_iterable(p[1:] for p in parts)).difference(self.chunks)
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
            new = set(chain.from_iterable(p[1:] for p in parts))
        if new:
            self._learn([*new])
        out = [(self._whole(p[0]) if p[0] else b"") + b"".join(map(self.chunks.__getitem__, p[1:])) for p in parts]
        for chunk in new:
            if len(chunk) > 64:
                del self.chunks[chunk]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    """One encoder for each worker."""
    return IdEncoder(path)


def _varints(numbers: list[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out)


def _numbers(table: bytes) -> Iterator[int]:
    n = shift = 0
    for b in table:
        n |= (b & 0x7F) << shift
        if b < 0x80:
            yield n
            n = shift = 0
        else:
            shift += 7


def pack_file(docs: list[tuple[int | None, int]], ids: np.ndarray, part: int, number: int, id_bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file, less its end mark, of documents ``(doc_id, number of ids)`` and their ids in the same order."""
    table, before = [], 0
    for doc, n in docs:
        step = 0 if doc is None else doc - before
        table += [(step << 1 if step >= 0 else (-step << 1) - 1) << 1 | (doc is None), n]
        before = before if doc is None else doc
    listed = _varints(table)
    head = _HEAD.pack(MAGIC, part, number, id_bits, block_ids, len(docs), len(ids), len(listed))
    out = [head, _CRC.pack(zlib.crc32(listed, zlib.crc32(head))), listed]
    length = min(block_ids, len(ids)) or 1  # all blocks are as long; the last one is filled up with its last id
    for k in range(0, -(-len(ids) // length), FILE_BLOCKS):
        some = ids[k * length : (k + FILE_BLOCKS) * length]
        rows = -(-len(some) // length)
        even = np.concatenate((some, np.full(rows * length - len(some), some[-1], dtype=some.dtype)))
        for i, payload in enumerate(encode_blocks(even.reshape(rows, length), id_bits)):
            out += [_BLOCK.pack(len(payload), zlib.crc32(payload, k + i)), payload]
    return b"".join(out)


class TokenFile:
    """A file's documents and blocks; raises ``ValueError`` where a checksum does not hold."""

    def __init__(self, content: bytes):
        end = END_MARK.encode()
        if len(content) < _HEAD.size + _CRC.size + len(end) or content[-len(end) :] != end or content[:4] != MAGIC:
            raise ValueError("not a whole token file")
        _, self.part, self.number, self.id_bits, self.block_ids, n_docs, self.n_ids, size = _HEAD.unpack_from(content)
        at = _HEAD.size + _CRC.size
        table = content[at : at + size]
        if zlib.crc32(table, zlib.crc32(content[: _HEAD.size])) != _CRC.unpack_from(content, _HEAD.size)[0]:
            raise ValueError("the head or the table of a token file is damaged")
        numbers, before = _numbers(table), 0
        self.docs: list[tuple[int | None, int]] = []
        for coded in numbers:
            step = coded >> 2 if not coded >> 1 & 1 else -((coded >> 1) + 1 >> 1)
            before += step
            self.docs.append((None if coded & 1 else before, next(numbers)))
        if len(self.docs) != n_docs:
            raise ValueError("the table of a token file is damaged")
        at += size
        self.blocks: list[bytes] = []
        while at < len(content) - len(end):
            length, crc = _BLOCK.unpack_from(content, at)
            payload = content[at + _BLOCK.size : at + _BLOCK.size + length]
            if zlib.crc32(payload, len(self.blocks)) != crc:
                raise ValueError(f"block {len(self.blocks)} of a token file is damaged")
            self.blocks.append(payload)
            at += _BLOCK.size + length

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` (excluded) of the file; only their blocks are decoded."""
        last = self.n_ids if last is None else last
        size = min(self.block_ids, self.n_ids)
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // size, -(-last // size)
        found = [decode_blocks(self.blocks[k : min(b, k + FILE_BLOCKS)], size, self.id_bits).ravel() for k in range(a, b, FILE_BLOCKS)]
        return np.concatenate(found)[first - a * size : last - a * size].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document of the file."""
        first = sum(n for _, n in self.docs[:k])
        return self.ids(first, first + self.docs[k][1])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_blocks: int = FILE_BLOCKS) -> None:
    """Write the ids of all whole texts, each followed by ``end_id``, to files below ``path``, in ascending order of ``doc_id``.

    A null text counts as empty. Rows without an id come first; rows that share an id are ordered by a hash of the text,
    and each is a document of its own, however many there are: ranges are cut within them. Other columns are not read. A
    file ends with the document that fills ``file_blocks`` blocks, so a worker holds that much, or one larger document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        held, texts, size = [], [], 0
        bits = max(coder.id_bits, end_id.bit_length())

        def pack() -> pa.RecordBatch:
            content = pack_file(held, np.frombuffer(b"".join(texts), dtype="<u4"), part, number, bits)
            return pa.RecordBatch.from_arrays([pa.array([content], type=pa.binary())], names=["content"])

        for b in batches:
            encoded = coder.encode_all([t or "" for t in b.column(1).to_pylist()])
            for doc, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids += end
                held.append((doc, len(ids) >> 2))
                texts.append(ids)
                size += len(ids) >> 2
                if size >= file_blocks * BLOCK_IDS:
                    yield pack()
                    held, texts, size, number = [], [], 0, number + 1
        if held:
            yield pack()

    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("t"),
        F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("doc").asc_nulls_first(), "h", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "t")
    packed = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    packed.write.option("lineSep", END_MARK).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files below ``path``: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids array<bigint>``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is of its ids as little-endian unsigned 32-bit
    numbers. A damaged file ends the query with an error. No file, no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    file = TokenFile(content.as_buffer().to_pybytes())
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from None
                ids = file.ids().astype("<u4")
                ends = np.cumsum([n for _, n in file.docs], dtype=np.int64)
                for k in range(0, len(file.docs), 10_000):
                    some, stop = file.docs[k : k + 10_000], ends[k : k + 10_000]
                    start = stop - np.array([n for _, n in some], dtype=np.int64)
                    out = [
                        pa.array([file.part] * len(some), type=pa.int64()), pa.array([file.number] * len(some), type=pa.int64()),
                        pa.array([d for d, _ in some], type=pa.int64()), pa.array(start), pa.array(stop - start),
                        pa.array([zlib.crc32(ids[i:j]) for i, j in zip(start.tolist(), stop.tolist(), strict=True)], type=pa.int64()),
                    ]
                    names = ["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cuts = pa.array(np.concatenate((start[:1], stop)) - start[0], type=pa.int32())
                        out.append(pa.ListArray.from_arrays(cuts, pa.array(ids[start[0] : stop[-1]].astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names=names)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0)
    schema = "part bigint, number bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    read = stash(files.select("path", "content").mapInArrow(run, schema), "token-rows")
    # a file's ids begin after those of the part's files before it, a part's after those of the parts before it
    sizes = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_part = sizes.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("file_from"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_from"))
    base = in_part.join(parts, "part").select("part", "number", (F.col("file_from") + F.col("part_from")).alias("base"))
    out = read.join(base, ["part", "number"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back; the files stay there.

    One row per input row; an empty table gives an empty result. Nulls, ties and repeats: :func:`write_token_files`.
    """
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
    return read_documents(docs.sparkSession, path)
