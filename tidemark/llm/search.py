"""Ranked lexical search: compressed postings in shards, merged a document at a time.

A shard holds documents in ascending order of id. Its postings are per term: the places of the documents that hold it
(differences as varints; the low bit says that the term occurs more than once), then those occurrence counts. A query's
cursors stand in a heap by document. The smallest document is taken off, scored over all cursors on it, and offered to a
heap of the best results, which is keyed by score, then id. A term's largest share of a score in the shard is known, so
terms whose shares add up to less than the worst kept score are not merged but looked up, and only while that can still
lift a document into the results. Nothing is skipped that could be among the best.

A task's results go on from shard to shard, so each task gives ``k`` rows a query at most, and those are merged at last.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import discard, small_batches, stash

K = 20
#: Words after which a shard ends with the document; different terms of the queries that are searched at a time.
SHARD_WORDS, BLOCK_TERMS = 2_000_000, 100_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII, of a UTF-8 text."""
    return (text or b"").translate(_FOLD).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned numbers, seven bits each, the low ones first; and how many bytes each number takes."""
    values = values.astype(np.uint64)
    sizes, rest = np.ones(len(values), dtype=np.int64), values >> np.uint64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[ends[has] - sizes[has] + k] = low | np.where(sizes[has] > k + 1, np.uint64(0x80), np.uint64(0))
    return out, sizes


def numbers(data: bytes) -> np.ndarray:
    """The unsigned numbers of a run of varints."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    last = raw < 0x80
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * at).astype(np.uint64), starts)


def _id_bytes(ids: list[int | None]) -> bytes:
    """Sorted ids: how many are null, then the others from the smallest 64-bit number on, as differences."""
    known = np.array([i for i in ids if i is not None], dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    steps = np.diff(known, prepend=np.uint64(0)) if len(known) else known
    return varints(np.concatenate((np.array([len(ids) - len(known)], dtype=np.uint64), steps)))[0].tobytes()


def _ids_of(data: bytes) -> list[int | None]:
    found = numbers(data)
    known = (np.cumsum(found[1:], dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64).tolist()
    return known + [None] * int(found[0])


class _Shard:
    """Documents of a shard that is being built."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.coded: list[np.ndarray] = []
        self.words = 0

    def add(self, doc: int | None, words: list[bytes]) -> None:
        self.ids.append(doc)
        self.coded.append(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
        self.words += len(words)

    def pack(self, shard: int) -> pa.RecordBatch:
        """A row for each term and, with a null term, one for the documents."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array([len(self.coded[k]) for k in order], dtype=np.int64)
        keys = np.concatenate([self.coded[k] for k in order]).astype(np.int64) << 32
        keys |= np.repeat(np.arange(len(order)), lengths)
        keys, tf = np.unique(keys, return_counts=True)
        term, place = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        df = np.diff(np.append(first, len(term)))
        # the counts of a term follow its places: each term's bytes are its places', then its counts'
        many = tf > 1
        places, place_sizes = varints(step << 1 | many)
        counts, count_sizes = varints(tf[many])
        a, b = np.add.reduceat(place_sizes, first), np.bincount(term[many], weights=count_sizes, minlength=len(first)).astype(np.int64)
        ends = np.cumsum(a + b)
        data = np.empty(int(ends[-1]), dtype=np.uint8)
        into = np.repeat(ends - a - b - (np.cumsum(a) - a), a) + np.arange(len(places))
        data[into] = places
        data[np.repeat(ends - b - (np.cumsum(b) - b), b) + np.arange(len(counts))] = counts
        cuts = np.concatenate(([0], ends)).astype(np.int32)
        ids = _id_bytes([self.ids[k] for k in order])
        sizes = varints(lengths)[0].tobytes()
        own = pa.BinaryArray.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        count = len(df) + 1
        columns = [
            pa.array(np.full(count, shard)),
            pa.array([*(t.decode("utf-8", "replace") for t in self.vocabulary), None], type=pa.string()),
            pa.array(np.append(df, len(order)).astype(np.int32)),
            pa.concat_arrays([own, pa.array([sizes], type=pa.binary())]),
            pa.array([None] * len(df) + [ids], type=pa.binary()),
            pa.array([None] * len(df) + [self.words], type=pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "postings", "ids", "words"])


INDEX = "shard bigint, term string, df int, postings binary, ids binary, words bigint"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all whole texts, written: :data:`INDEX`, a row for each shard and term, and one for the shard's documents.

    Documents without a term are left out, as no query can find them. Nothing is shuffled: a task cuts its own documents
    into shards of about ``shard_words`` words, and holds one. Rows without an id come after the others; rows that share an
    id are documents of their own. An empty table gives an empty index. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if words := terms_of(text.as_py()):
                    shard.add(doc, words)
                    if shard.words >= shard_words:
                        yield shard.pack(part << 32 | made)
                        shard, made = _Shard(), made + 1
        if shard.ids:
            yield shard.pack(part << 32 | made)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    return stash(rows.mapInArrow(run, INDEX), "index")


class _Postings:
    """A term's decoded postings in a shard: places, each document's share of the score for one mention, and the largest."""

    __slots__ = ("places", "shares", "most")

    def __init__(self, df: int, data: bytes, weight: int, m: np.ndarray):
        found = numbers(data)
        steps, counts = found[:df], found[df:]
        places = np.cumsum((steps >> np.uint64(1)).astype(np.int64))
        tf = np.ones(df, dtype=np.int64)
        tf[(steps & np.uint64(1)).astype(bool)] = counts.astype(np.int64)
        shares = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[places]))
        self.places, self.shares, self.most = array("q", places.tobytes()), array("q", shares.tobytes()), int(shares.max())


def merge_documents(lists: list[tuple[_Postings, int]], ids: list[int | None], best: list[tuple], k: int) -> None:
    """Offer a shard's documents to ``best``, a heap of ``(score, -id, id)``; ``lists`` are a query's terms and their mentions.

    A missing id is worse than any. Scores of zero are not offered.
    """
    lists = sorted(((p.most * q, p, q) for p, q in lists if p.most), key=lambda x: x[0])
    n = len(lists)
    if not n:
        return
    below = [0]  # the most that the first terms can give together
    for most, _, _ in lists:
        below.append(below[-1] + most)
    places, shares, mentions = [p.places for _, p, _ in lists], [p.shares for _, p, _ in lists], [q for _, _, q in lists]
    sizes, at = [len(p) for p in places], [0] * n
    floor = best[0][0] if len(best) == k else 1
    merged = next((i for i in range(n) if below[i + 1] >= floor), n)
    cursors = [places[i][0] * n + i for i in range(merged, n)]
    heapify(cursors)
    while cursors:
        doc, i = divmod(cursors[0], n)
        score = 0
        while True:  # all cursors on this document
            if i < merged:
                heappop(cursors)  # its term is looked up by now
            else:
                p = at[i]
                score += shares[i][p] * mentions[i]
                at[i] = p = p + 1
                if p < sizes[i]:
                    heapreplace(cursors, places[i][p] * n + i)
                else:
                    heappop(cursors)
            if not cursors or cursors[0] >= (doc + 1) * n:
                break
            i = cursors[0] - doc * n
        if not score:
            continue
        for j in range(merged - 1, -1, -1):
            if score + below[j + 1] < floor:
                break
            p = bisect_left(places[j], doc, at[j])
            at[j] = p
            if p < sizes[j] and places[j][p] == doc:
                score += shares[j][p] * mentions[j]
        if score < floor:
            continue
        name = ids[doc]
        entry = (score, -math.inf if name is None else -name, name)
        if len(best) < k:
            heappush(best, entry)
        elif entry[:2] > best[0][:2]:
            heappushpop(best, entry)
        if len(best) == k and best[0][0] > floor:
            floor = best[0][0]
            while merged < n and below[merged + 1] < floor:
                merged += 1


def _search_block(hits: DataFrame, asked: list[tuple[int, dict[str, int]]], k: int) -> DataFrame:
    """``(q, doc_id, score)``: each task's best of a block of queries; ``hits`` are its terms' rows and the shards' own."""
    spark = hits.sparkSession
    sums = hits.where("term is null").agg(F.sum("df").alias("n"), F.sum("words").alias("l")).first()
    n_docs, n_words = sums["n"] or 0, sums["l"] or 0
    found = hits.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()  # BLOCK_TERMS at most, or one query's
    weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
    held = spark.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = held.value
        best: list[list[tuple]] = [[] for _ in queries]

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def finish(ids: list[int | None], terms: dict[str, _Postings]) -> None:
            for heap, (_, mentions) in zip(best, queries, strict=True):
                here = [(terms[t], q) for t, q in mentions.items() if t in terms]
                if here:
                    merge_documents(here, ids, heap, k)

        shard, ids, m, terms = None, [], None, {}
        for own, term, df, postings, names, _ in rows():
            if own != shard:
                finish(ids, terms)
                shard, terms = own, {}
            if term is None:  # the first row of its shard
                ids, n = _ids_of(names), numbers(postings).astype(np.int64)
                product = 25 * int(n.max(initial=0)) * n_docs
                m = 75 + ((25 * n * n_docs) // n_words if product < 1 << 63 else np.array([25 * x * n_docs // n_words for x in n.tolist()], dtype=np.int64))
            elif weight[term] > 0:
                terms[term] = _Postings(df, postings, weight[term], m)
        finish(ids, terms)
        out = [(q, name, score) for (q, _), heap in zip(queries, best, strict=True) for score, _, name in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64()) for i in range(3)], names=["q", "doc_id", "score"])

    ordered = hits.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return ordered.select(*[x.split()[0] for x in INDEX.split(", ")]).mapInArrow(run, "q bigint, doc_id bigint, score bigint")


def _asked(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(q, item_id, terms, mentions)`` of the queries that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [Counter(w.decode("utf-8", "replace") for w in terms_of(t)) for t in b.column(2).to_pylist()]
            lists = [pa.array([[*c] for c in counted], type=pa.list_(pa.string())), pa.array([[*c.values()] for c in counted], type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["q", "item_id", "terms", "mentions"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"q bigint, item_id {kind}, terms array<string>, mentions array<int>").where(F.size("terms") > 0)


def search(index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of an index for each query: ``item_id, rank, doc_id, score``; scores above 0 only.

    Equal scores are ranked by ascending ``doc_id``, a missing one last. Each row of ``queries`` is a query of its own,
    whether its id is null or repeated; one without a term has no result. Queries are searched in blocks of about
    ``block_terms`` different terms: the driver holds and broadcasts one block, and each reads the index once.
    """
    spark = index.sparkSession
    small_batches(spark)
    asked = stash(_asked(queries, id_col, text_col), "queries")
    results: list[DataFrame] = []

    def run_block(block: list[tuple[int, dict[str, int]]]) -> None:
        words = spark.createDataFrame([(t,) for t in {t for _, c in block for t in c}], "asked string")
        near = index.join(F.broadcast(words), index["term"] == words["asked"], "left").where("term is null or asked is not null")
        hits = stash(near.drop("asked"), "hits")
        results.append(stash(_search_block(hits, block, k), "found"))
        discard(hits)

    block, size = [], 0
    for r in asked.toLocalIterator():  # one partition of the queries at a time
        block.append((r["q"], dict(zip(r["terms"], r["mentions"], strict=True))))
        size += len(r["terms"])
        if size >= block_terms:
            run_block(block)
            block, size = [], 0
    if block or not results:
        run_block(block)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """:func:`search` over a new index of ``docs``, which stays in the shared folder as long as the result is read."""
    return search(build_index(docs), queries, k)
