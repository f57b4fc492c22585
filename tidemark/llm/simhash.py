"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints that differ in few bits are linked. A fingerprint is cut into segments; each segment has a table from its
value to the fingerprints that hold it. If two fingerprints differ in at most ``max_bits`` bits, they differ in few bits
within some segment, so each fingerprint enumerates the small Hamming ball of its own value within every segment, fetches
what the tables hold there, and each candidate's complete distance is verified.

A table entry that holds more than ``crowd`` fingerprints is not fetched. It is cut anew instead: its remaining bits are
segments of their own, searched with what is left of the distance, and so on. The last cut leaves ``FLOOR_BITS`` bits or
fewer outside the key, so an entry holds ``2 ** FLOOR_BITS`` different fingerprints at most, whatever the size of a group
of near copies; nothing is dropped on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.store import discard, shuffled, small_batches, stash

SEED = 42
BITS = 64
MAX_BITS = 2
SEGMENTS = 2
CROWD = 64
FLOOR_BITS = 8
_CHUNK = 1 << 16

#: An index: the bits of its key, and the bits that may be flipped in a probe, each with how many were flipped.
Index = tuple[frozenset[int], list[tuple[int, int]]]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; zero for a text without words.

    Of bytes, ``lower`` and ``split`` know A-Z and the six ASCII spaces only, which is what is asked for.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[k : k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, same, fp)``, all long, for every row; a null text counts as empty. ``same`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(t.as_py(), shingle) for t in b.column(2)), type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=["id", "same", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _same(docs[text_col]).alias("same"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id bigint, same bigint, fp bigint")


def _same(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _number(bits: frozenset[int] | set[int] | tuple[int, ...]) -> int:
    """The bits as a signed 64-bit number."""
    n = sum(1 << b for b in bits)
    return n - (1 << BITS) if n >> (BITS - 1) else n


def _balls(rest: list[int], budget: int, segments: int) -> list[tuple[list[int], int]]:
    """Segments of ``rest`` and the radius within each that finds every pair ``budget`` bits apart at most.

    If no segment but the first ``budget % m + 1`` differs in fewer than ``budget // m`` bits, one of those first ones
    differs in no more than that; the other segments can do with one bit less.
    """
    m = min(segments, len(rest))
    cuts = [len(rest) * k // m for k in range(m + 1)]
    radius, more = divmod(budget, m)
    parts = [(rest[a:b], radius if k <= more else radius - 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return [(p, r) for p, r in parts if r >= 0]


def _probes(part: list[int], radius: int) -> list[tuple[int, ...]]:
    return [c for n in range(min(radius, len(part)) + 1) for c in combinations(part, n)]


def first_indexes(max_bits: int, segments: int) -> list[Index]:
    """One index for each segment that has to be searched."""
    return [(frozenset(p), [(_number(c), len(c)) for c in _probes(p, r)]) for p, r in _balls(list(range(BITS)), max_bits, segments)]


def finer_indexes(key: frozenset[int], used: set[int], max_bits: int) -> list[tuple[frozenset[int], dict[int, list[tuple[int, int]]]]]:
    """Longer keys for what an index leaves out, with the further flips by the number of those made before."""
    rest = [b for b in range(BITS) if b not in key]
    found: dict[frozenset[int], dict[int, list[tuple[int, int]]]] = {}
    for n in sorted(used):
        for part, radius in _balls(rest, max_bits - n, 2):
            found.setdefault(key | set(part), {})[n] = [(_number(c), n + len(c)) for c in _probes(part, radius)]
    return [*found.items()]


def _flipped(from_col: str, index: int, flips: list[tuple[int, int]]) -> Column:
    """Probes ``(ix, near, used)`` of an index: ``from_col`` with each of the flips."""
    listed = F.expr(f"array({','.join(f"struct(cast({f} as bigint) as flip, {n} as used)" for f, n in flips)})")
    return F.transform(listed, lambda x: F.struct(F.lit(index).alias("ix"), F.col(from_col).bitwiseXOR(x["flip"]).alias("near"), x["used"].alias("used")))


def links(fps: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)``, ``a < b``: all pairs of the different fingerprints ``fps(fp)`` with ``max_bits`` differing bits at most.

    An empty table has no edge. ``segments`` need not divide 64.
    """
    if not 1 <= segments <= BITS or max_bits < 1:
        raise ValueError("there is at least one segment, of at least one bit, and one differing bit")
    first = first_indexes(max_bits, segments)
    at = lambda key: F.col("fp").bitwiseAND(F.lit(_number(key)))
    held = F.array(*[F.struct(F.lit(k).alias("ix"), at(key).alias("key")) for k, (key, _) in enumerate(first)])
    table = fps.select("fp", F.explode(held).alias("e")).select("fp", "e.ix", "e.key")
    asked = F.concat(*[_flipped("fp", k, flips) for k, (_, flips) in enumerate(first)])
    keys = [key for key, _ in first]
    probes = fps.select("fp", F.explode(asked).alias("e")).select("fp", "e.*")
    out: list[DataFrame] = []
    held_on: list[DataFrame] = []
    while True:
        mask = reduce(lambda c, k: c.when(F.col("ix") == k, F.lit(_number(keys[k]))), range(len(keys)), F)
        probes = probes.select("fp", "ix", "near", "used", F.col("near").bitwiseAND(mask).alias("key"))
        last = BITS - min(map(len, keys)) <= FLOOR_BITS
        # written, so that an entry that very many probes ask for can be split in the join
        size = stash(table.groupBy("ix", "key").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("low")), "entries")
        # an entry that holds the asking fingerprint alone has no candidate
        met = probes.join(shuffled(size), ["ix", "key"]).where((F.col("c") > 1) | (F.col("low") != F.col("fp")))
        met = stash(met.select("fp", "ix", "near", "used", "key", "c"), "met")
        calm = met if last else met.where(F.col("c") <= crowd)
        fetched = calm.select(F.col("fp").alias("a"), "ix", "key").join(shuffled(table.select(F.col("fp").alias("b"), "ix", "key")), ["ix", "key"])
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        pair = fetched.where((F.col("a") != F.col("b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out.append(stash(pair.distinct(), "pairs"))
        discard(size)
        held_on += [met, out[-1]]
        full = met.where(F.col("c") > crowd)
        if last or not full.limit(1).count():
            break
        crowds = stash(full.select("ix", "key").distinct(), "crowds")
        used = {r["used"] for r in full.select("used").distinct().collect()}  # max_bits + 1 numbers at most
        finer = [(k, key, flips) for k in range(len(keys)) for key, flips in finer_indexes(keys[k], used, max_bits)]
        inside = table.join(shuffled(crowds), ["ix", "key"])
        table = stash(
            inside.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("ix"), F.lit(k).alias("was"), at(key).alias("key")) for n, (k, key, _) in enumerate(finer)])).alias("e"), F.col("ix").alias("own"))
            .where("e.was = own").select("fp", "e.ix", "e.key"), "crowded",
        )
        none = F.expr("cast(array() as array<struct<ix:int,near:bigint,used:int>>)")
        further = F.concat(*[
            F.when((F.col("ix") == k) & (F.col("used") == u), _flipped("near", n, more)).otherwise(none)
            for n, (k, _, flips) in enumerate(finer) for u, more in flips.items()
        ])
        held_on += [crowds, table]
        probes = full.select("fp", F.explode(further).alias("e")).select("fp", "e.*")
        keys = [key for _, key, _ in finer]
    edges = stash(reduce(DataFrame.unionByName, out).distinct(), "edges")
    for used_up in held_on:
        discard(used_up)
    return edges


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(id, same, fp)`` of all rows, and ``(fp, group)`` of the different fingerprints."""
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    each = stash(prints.select("fp").distinct(), "different")
    edges = links(each, max_bits=max_bits)
    joined = connected_components(edges)
    discard(edges)
    return prints, each.join(shuffled(joined), each["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``(doc_id, fingerprint, component_id)``.

    ``component_id`` is the smallest id reachable over links, the row's own included; rows with a null id take part and
    get the smallest id of the others, or null if there is none. Texts without words share fingerprint zero. Repeated
    rows give repeated result rows, and an empty table an empty result. Extra input columns are not read.
    """
    prints, group = _grouped(docs, id_col, text_col, shingle, max_bits)
    low = prints.groupBy("fp").agg(F.min("id").alias("low")).join(shuffled(group), "fp")
    least = low.groupBy("group").agg(F.min("low").alias("component_id"))
    by_print = group.join(shuffled(least), "group").select("fp", "component_id")
    return prints.join(shuffled(by_print), "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, one without an id only where no row has one.

    Of rows that share that id, the text of the smallest hash counts, and of rows with that text the one of the smallest
    hash of all its columns. An empty table gives an empty result; all columns stay.
    """
    prints, group = _grouped(docs, id_col, text_col, shingle, max_bits)
    rows = prints.join(shuffled(group), "fp").groupBy("group", "id", "same").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "same")
    rows = stash(rows, "members")
    first = stash(rows.groupBy("group").agg(F.min(order).alias("f")).select("group", "f.id", "f.same"), "first")
    is_first = (rows["group"] == first["group"]) & rows["id"].eqNullSafe(first["id"]) & (rows["same"] == first["same"])
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("own_id"), _same(docs[text_col]).alias("own_same"))
    on = lambda other: left["own_id"].eqNullSafe(other["id"]) & (left["own_same"] == other["same"])
    gone = stash(rows.join(shuffled(first), is_first, "left_anti").select("id", "same"), "gone")
    stay = left.join(shuffled(gone), on(gone), "left_anti")
    again = stash(rows.where("n > 1").join(shuffled(first), is_first, "left_semi").select("id", "same"), "again")
    unpacked = lambda df: df.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    if not again.limit(1).count():
        return unpacked(stay)
    single = unpacked(stay.join(shuffled(again), on(again), "left_anti"))
    several = stay.join(shuffled(again), on(again), "left_semi")
    digest = F.xxhash64(*[F.col("row")[c] for c in docs.columns])
    one = several.groupBy("own_id", "own_same").agg(F.min_by("row", digest).alias("row"))
    return single.unionByName(unpacked(one))
