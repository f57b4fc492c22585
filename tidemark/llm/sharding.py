"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys are hashed onto a ring that is cut into a fixed number of cells; every shard stands at many points of it. A first
pass counts the rows of each cell (a fixed number of counts, whatever the input), and cells that hold more than their
share are cut into parts by the text. The ring is then walked on the parts' counts: each shard takes the keys before its
points until it is full, and what is over goes on clockwise to the next shard with room. The walk gives, for every part,
ranges of ranks and their shards; a row finds its shard by its rank within its part. All shards are full to the row in
the end: counts differ by one at most.
"""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import stash

CELLS = 4096
POINTS = 256
#: Equal rows are written out in runs of this many.
_RUN = 10_000

#: (cell, part, first rank, rank after the last, shard, slot of the first)
Range = tuple[int, int, int, int, int, int]


def ring(shards: int, points: int = POINTS, cells: int = CELLS) -> list[tuple[int, int]]:
    """The virtual nodes, clockwise, as (cell, shard). A shard's points depend on its number alone."""
    return sorted((crc32(f"shard {s} point {p}".encode()) % cells, s) for s in range(shards) for p in range(points))


def walk(counts: dict[tuple[int, int], int], shards: int, capacity: list[int], points: int = POINTS, cells: int = CELLS) -> list[Range]:
    """Ranges of ranks by cell part. First every shard takes from its own arcs, clockwise; then overflow moves on."""
    nodes = ring(shards, points, cells)
    where = [c for c, _ in nodes]
    room, slot = list(capacity), [0] * shards
    out: list[Range] = []

    def take(cell: int, part: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            out.append((cell, part, lo, lo + n, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return lo + n

    over = []
    for (cell, part), n in sorted(counts.items()):
        at = bisect_left(where, cell) % len(nodes)
        lo = take(cell, part, 0, n, nodes[at][1])
        if lo < n:
            over.append((cell, part, lo, n, at))
    for cell, part, lo, n, at in over:
        for step in range(1, len(nodes) + 1):
            lo = take(cell, part, lo, n, nodes[(at + step) % len(nodes)][1])
            if lo == n:
                break
    return out


def capacities(rows: int, shards: int) -> list[int]:
    """Full loads: the first ``rows mod shards`` shards hold one row more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def parts_of(cell_counts: dict[int, int], cells: int = CELLS) -> list[int]:
    """Parts of each cell, so that a part holds about the mean of the cells: twice as many as cells at most."""
    mean = max(1, -(-sum(cell_counts.values()) // cells))
    return [max(1, -(-cell_counts.get(c, 0) // mean)) for c in range(cells)]


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``rows``: counts are at most one apart, and ``slot`` runs gapless from 0 in each shard. ``size`` is the
    text's UTF-8 bytes (null: none) plus one. The id decides the cell, the text only the order within it; equal texts
    need not share a shard. Rows equal in id, size and checksum are one row with a count until the end, and take
    neighbouring ranks. Null ids are one key. An empty table gives an empty result. Only id, size and checksum are
    written and shuffled; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    rows = stash(rows, "keys")
    n = F.count(F.lit(1)).alias("n")
    parts = parts_of({r["cell"]: r["n"] for r in rows.groupBy("cell").agg(n).collect()})
    parted = F.get(F.split(F.lit(",".join(map(str, parts))), ",").cast("array<int>"), F.col("cell"))
    rows = rows.withColumn("part", F.pmod(F.hash("text_crc32", "size"), parted).cast("int"))
    counts = {(r["cell"], r["part"]): r["n"] for r in rows.groupBy("cell", "part").agg(n).collect()}
    plan = walk(counts, shards, capacities(sum(counts.values()), shards), points)
    ranges = spark.createDataFrame(plan, "p_cell int, p_part int, lo bigint, hi bigint, shard int, slot0 bigint")
    before = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    equal = rows.groupBy("cell", "part", "doc_id", "text_crc32", "size").agg(n)
    ranked = equal.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the plan has two parts a cell and a few rows a shard at most: its size is fixed by the parameters
    placed = ranked.join(
        F.broadcast(ranges),
        (F.col("cell") == F.col("p_cell")) & (F.col("part") == F.col("p_part")) & (F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("n") > F.col("lo")),
    )
    first, end = F.greatest("rank", "lo"), F.least(F.col("rank") + F.col("n"), F.col("hi"))
    runs = placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot0") + first - F.col("lo")).alias("at"), (end - first).alias("n")
    ).select("doc_id", "size", "text_crc32", "shard", "at", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _RUN).cast("int"))).alias("run"))
    # runs of a row that is repeated very often are dealt out
    dealt = runs.repartition("shard", "at", "run")
    slots = F.sequence(F.col("at") + F.col("run").cast("bigint") * _RUN, F.col("at") + F.least(F.col("n"), (F.col("run").cast("bigint") + 1) * _RUN) - 1)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.explode(slots).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
