"""Corpus-wide removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

The edit unit is the word: two lines are near if one word changed, added or left out turns one into the other (after
lower-casing and with any white space taken as one space). Each line's variants are the line itself and the line less
one word, as hashed keys. A changed word leaves equal variants with the same place deleted; an added word makes one
line a variant of the other. A key's group is never listed as pairs: each line only needs the earliest line of each of
its keys, so groups are reduced to their earliest member, and that one is verified by its edit distance.

A line is removed if any earlier line (smaller document id, then digest of the text, then line number) equals it or is near
it. Documents are told apart by id and text, so rows that share an id, or have none, keep what only they hold. Equal lines are
told at any length of a word or more; near ones from ``min_words`` words on: at five words, one edit is a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import discard, small_batches, stash

MIN_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def line_words(line: bytes) -> list[bytes]:
    """Words of a line in UTF-8, A-Z lower-cased; space and U+0009 to U+000D part them."""
    return line.lower().split()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_key(words: list[bytes]) -> bytes:
    """128-bit hash of a line's words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the unchanged half: two lines one edit apart share one, taken by the word count of the shorter line."""
    n = len(words)
    out, join, digest = [], b" ".join, xxhash.xxh64_intdigest
    for m in (n, n - 1):
        cut = m // 2
        out += [digest(join(words[:cut]), 2 * m), digest(join(words[n - m + cut :]), 2 * m + 1)]
    return out


def variant_keys(words: list[bytes]) -> tuple[int, np.ndarray]:
    """Hash of the word sequence, and of the sequence less each of its words, in one pass.

    The hash is a polynomial in the words' hashes modulo 2^64: without word ``i``, what follows it moves down a place.
    """
    n = len(words)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * powers)))
    less = before[:-1] + (before[-1] - before[1:]) * np.uint64(_BASE_INVERSE)
    return _signed(int(before[-1])), less.view(np.int64)


def hash_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``(doc, s, z, line, h, h2, halves)`` of every line with a word; lines of fewer than ``min_words`` words have no halves."""

    def pack(ids: list, numbers: list[int], keys: list[bytes], halves: list[int], ends: list[int]) -> pa.RecordBatch:
        key = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2).astype(np.int64)
        listed = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.array(halves, dtype=np.uint64).view(np.int64)))
        names = [pa.array([i[k] for i in ids], type=pa.int64()) for k in range(3)]
        columns = [*names, pa.array(numbers, type=pa.int32()), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), listed]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "s", "z", "line", "h", "h2", "halves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, numbers, keys, halves, ends = [], [], [], [], [0]
            for *doc, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                for number, line in enumerate((text.as_py() or b"").split(b"\n")):
                    words = line_words(line)
                    if words:
                        ids.append(doc)
                        numbers.append(number)
                        keys.append(line_key(words))
                        if len(words) >= min_words:
                            halves += half_keys(words)
                        ends.append(len(halves))
                if len(ids) > 20_000:
                    yield pack(ids, numbers, keys, halves, ends)
                    ids, numbers, keys, halves, ends = [], [], [], [], [0]
            yield pack(ids, numbers, keys, halves, ends)

    rows = docs.select(*_document(docs, id_col, text_col), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc bigint, s bigint, z bigint, line int, h bigint, h2 bigint, halves array<bigint>")


def _document(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: id, digest of the text, and a second digest where there is no id."""
    number, text = docs[id_col].cast("bigint"), F.coalesce(docs[text_col], F.lit(""))
    return [number.alias("doc"), F.xxhash64(text).alias("s"), F.when(number.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.lit(0)).alias("z")]


#: A place in the table; places are ordered by its fields.
_PLACE = "struct<doc:bigint,s:bigint,z:bigint,line:int>"


def _place() -> Column:
    return F.struct("doc", "s", "z", "line")


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marked for broadcasting if it has no more than ``rows`` (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _likely(distinct: DataFrame) -> DataFrame:
    """``(h, h2, first)`` of the different lines that share an unchanged half with another; the rest have no near line."""
    halves = distinct.select("h", "h2", F.explode("halves").alias("half"))
    # written, so that a half of very many lines can be split in the join
    shared = stash(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "halves")
    chosen = halves.join(shared, "half", "left_semi").select("h", "h2").distinct()
    return distinct.join(chosen, ["h", "h2"], "left_semi").select("h", "h2", "first")


def _variants(texts: DataFrame) -> DataFrame:
    """``(h, first, key, at)``: hash of the line less its word ``at``, and of the line itself with ``at`` -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, at = [], [], []
            for k, words in enumerate(b.column(2).to_pylist()):
                whole, less = variant_keys(words)
                row.append(np.full(len(words) + 1, k))
                key += [np.array([whole], dtype=np.int64), less]
                at.append(np.arange(-1, len(words), dtype=np.int32))
            if row:
                rows = pa.array(np.concatenate(row))
                made = [pa.array(np.concatenate(key)), pa.array(np.concatenate(at))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *made], names=["h", "first", "key", "at"])

    return texts.select("h", "first", "words").mapInArrow(run, f"h bigint, first {_PLACE}, key bigint, at int")


def _near(texts: DataFrame) -> DataFrame:
    """``(h, h2, bound)``: the earliest verified near line of each line that has an earlier one.

    Lines with the same variant and the same word left out differ in that word; a variant that equals a line has that
    word more. Each line is offered the earliest member of its groups, and each offer is verified on the words of the
    two lines, so that lines with one half of the hash in common are not taken for one another.
    """
    keyed = _variants(texts)
    entry = F.struct(F.col("first").alias("first"), F.col("h").alias("h"))
    groups = stash(keyed.groupBy("key", "at").agg(F.min(entry).alias("e"), F.count(F.lit(1)).alias("c")), "variants")
    whole = groups.where("at = -1").select("key", F.col("e").alias("w"))
    cut = groups.where("at >= 0")
    changed = keyed.join(_small(cut.where("c > 1").select("key", "at", "e")), ["key", "at"]).select("h", "first", "at", "e", F.col("at").alias("oat"))
    longer = cut.join(_small(whole), "key").select("key", "at", "e", "w")
    # the whole line is offered the earliest line with one word more, and each of those the whole line
    shorter = longer.select(F.col("w.h").alias("h"), F.col("w.first").alias("first"), F.lit(-1).alias("at"), "e", F.col("at").alias("oat"))
    added = keyed.join(_small(longer.select("key", "at", "w")), ["key", "at"]).select("h", "first", "at", F.col("w").alias("e"), F.lit(-1).alias("oat"))
    offers = changed.unionByName(shorter).unionByName(added).where(F.col("e.first") < F.col("first"))
    offers = offers.select("h", "at", F.col("e.first").alias("bound"), F.col("e.h").alias("oh"), "oat").distinct()
    own = texts.select("h", "h2", F.col("words").alias("a"))
    other = texts.select(F.col("h").alias("oh"), F.col("first").alias("bound"), F.col("words").alias("b"))
    less = lambda words, at: F.filter(words, lambda w, k: k != F.col(at))
    seen = offers.join(own, "h").join(other, ["oh", "bound"]).where(less("a", "at") == less("b", "oat"))
    return seen.groupBy("h", "h2").agg(F.min("bound").alias("bound"))


def _texts(docs: DataFrame, likely: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, h2, first, words)`` of the likely lines, read where they first stand."""
    raw = docs.select(*_document(docs, id_col, text_col), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "raw"))
    at = _small(likely.select("h", "h2", "first", F.col("first.doc").alias("d"), F.col("first.s").alias("ds"), F.col("first.z").alias("dz"), F.col("first.line").alias("n")))
    same = (raw["s"] == at["ds"]) & (raw["z"] == at["dz"]) & (raw["line"] == at["n"]) & raw["doc"].eqNullSafe(at["d"])
    found = raw.join(at, same).select("h", "h2", "first", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [line_words(x) for x in b.column(3).cast(pa.binary()).to_pylist()]
            # two texts of one id and digest may hold other lines at this place
            keys = np.frombuffer(b"".join(map(line_key, words)), dtype=">i8").reshape(-1, 2)
            good = pa.array((keys[:, 0] == b.column(0).to_numpy()) & (keys[:, 1] == b.column(1).to_numpy()))
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words, type=pa.list_(pa.binary()))], names=["h", "h2", "first", "words"])
            yield out.filter(good)

    return found.mapInArrow(run, f"h bigint, h2 bigint, first {_PLACE}, words array<binary>").dropDuplicates(["h", "h2"])


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, s, z, line)`` of the lines that repeat an earlier line, or are one word edit away from one."""
    small_batches(docs.sparkSession)
    seen = stash(hash_lines(docs, id_col, text_col, min_words), "lines")
    distinct = stash(
        seen.groupBy("h", "h2").agg(
            F.min(_place()).alias("first"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("c")
        ),
        "different",
    )
    likely = stash(_likely(distinct), "likely")
    texts = stash(_texts(docs, likely, id_col, text_col), "texts")
    near = _near(texts)
    bounds = distinct.join(near, ["h", "h2"], "left").where((F.col("c") > 1) | F.col("bound").isNotNull())
    # written, so that a line of very many documents can be split in the join
    bounds = stash(bounds.select("h", "h2", F.least("first", F.coalesce("bound", "first")).alias("bound")), "bounds")
    discard(texts)
    discard(likely)
    return seen.join(bounds, ["h", "h2"]).where(_place() > F.col("bound")).select("doc", "s", "z", "line").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text_col``, and ``removed array<int>`` (line numbers).

    The other columns stay. Rows with one id and different texts are documents of their own, in the order of a digest of
    the text, and so are rows without an id, which come before all others; rows equal in id and text are one document, and
    lose the same lines. A null text stays null. Equal lines are told by 128-bit hashes; a near line is verified word by
    word. Lines without a word stay.
    """
    gone = removed_lines(docs, id_col, text_col, min_words).groupBy("doc", "s", "z").agg(F.collect_set("line").alias("gone"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(f"own_{k}") for k, c in enumerate(_document(docs, id_col, text_col))])
    joined = packed.join(gone, packed["own_0"].eqNullSafe(gone["doc"]) & (packed["own_1"] == gone["s"]) & (packed["own_2"] == gone["z"]), "left")
    none = F.array().cast("array<int>")
    split = joined.select("row", F.coalesce("gone", none).alias("gone"), F.split(F.col("row")[text_col], "\n", -1).alias("ls"))
    left = split.select("row", "gone", "ls", F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone").alias("stay"))
    kept = F.when(F.size("gone") == 0, F.col("row")[text_col]).otherwise(F.array_join(F.transform("stay", lambda k: F.get("ls", k)), "\n"))
    return left.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"], F.array_sort("gone").alias("removed"))
