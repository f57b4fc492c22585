"""Benchmark decontamination by a generalised suffix automaton over item words.

The automaton is built from the normalised words of all items. A document's words are streamed through it; at each word
it tells the longest suffix read so far that is part of some item. Where that length reaches a window, the words are
hit. Items are taken in blocks of a stated number of words, each broadcast by itself in a pass over the documents, so that
no more than one block is held at a time, by the driver or by a worker, however many items there are. Between passes only
the hits are written, never the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import discard, small_batches, stash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK_WORDS = 200_000
_FIND = re.compile(WORD)
#: What parts words becomes a space, A-Z lower case; the bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; a null text has none."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


class _States:
    """States under construction: edges by word, suffix links, and the length of each state's longest word sequence."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, parent: int, word: int) -> int:
        """The target of ``parent --word-->``, cloned if it is longer than one step."""
        target = self.next[parent][word]
        if self.len[target] == self.len[parent] + 1:
            return target
        clone = self._new(self.len[parent] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            if w in self.next[last]:
                last = self._split(last, w)
                continue
            made = self._new(self.len[last] + 1, {}, 0)
            at = last
            while at >= 0 and w not in self.next[at]:
                self.next[at][w] = made
                at = self.link[at]
            if at >= 0:
                self.link[made] = self._split(at, w)
            last = made


class SuffixAutomaton:
    """Generalised suffix automaton over lists of words, with the items of every window of ``window`` words.

    It is built once, on the driver, and packed into arrays, which is what travels to the workers. ``items`` are ``(id,
    words)``; an item whose id is None hits as any other and is not listed.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        states = _States()
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, ids))
                states.add(ids)
        self.base = base = max(1, len(self.vocab))
        self.keys = np.fromiter((s * base + w for s, edges in enumerate(states.next) for w in edges), dtype=np.int64)
        self.targets = np.fromiter((t for edges in states.next for t in edges.values()), dtype=np.int32)
        self.link, self.len = np.array(states.link, dtype=np.int32), np.array(states.len, dtype=np.int32)
        del states
        self.names = sorted({str(item) for item, _ in coded if item is not None})
        number = {n: k for k, n in enumerate(self.names)}
        full: set[tuple[int, int]] = set()
        #: (length, item) of whole items shorter than a window, by state
        self.short: dict[int, set[tuple[int, int]]] = {}
        for item, ids in coded:
            k = -1 if item is None else number[str(item)]
            if len(ids) >= window:
                full |= {(self._state_of_length(state, window), k) for _, state, length in self._walk(ids) if length >= window}
            else:
                *_, (_, state, _) = self._walk(ids)
                self.short.setdefault(state, set()).add((len(ids), k))
        #: items whose window of ``window`` words ends in a state, by the state that holds just that length
        self.full = np.array(sorted(full), dtype=np.int32).reshape(-1, 2)
        #: the nearest state among a state and its suffixes that ends a short item; 0 if none does
        self.near = np.zeros(len(self.len), dtype=np.int32)
        if self.short:
            for s in np.argsort(self.len, kind="stable").tolist()[1:]:
                self.near[s] = s if s in self.short else self.near[self.link[s]]
        self.least = min((min(len(ids), window) for _, ids in coded), default=window)
        self.pairs = np.unique(np.array([a * base + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)], dtype=np.int64))

    @cached_property
    def _ready(self) -> tuple[dict[int, int], list[int], list[int], list[int]]:
        """The arrays in the form that a walk reads fastest; made where it is needed, and not sent."""
        return dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), self.link.tolist(), self.len.tolist(), self.near.tolist() if self.short else []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def _state_of_length(self, state: int, length: int) -> int:
        _, link, size, _ = self._ready
        while size[link[state]] >= length:
            state = link[state]
        return state

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and longest matching length after each word."""
        step, link, size, _ = self._ready
        base, get = self.base, step.get
        state = length = 0
        for i, w in enumerate(ids):
            to = get(state * base + w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = get(state * base + w)
            if to is not None:
                state, length = to, length + 1
            yield i, state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit intervals (first word, word after the last; disjoint, ascending) and the items with occurring windows."""
        if not self.vocab:
            return [], set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        _, link, _, near = self._ready
        hits: list[tuple[int, int]] = []
        ends: set[int] = set()
        found: set[int] = set()
        for lo, hi in self._stretches(ids):
            for i, state, length in self._walk(ids[lo:hi].tolist()):
                reach = 0
                if length >= self.window:
                    reach = length
                    ends.add(self._state_of_length(state, self.window))
                up = near[state] if near else 0
                while up:
                    for n, item in self.short[up]:
                        if n <= length:
                            reach = max(reach, n)
                            found.add(item)
                    up = near[link[up]]
                if reach:
                    start, end = lo + i + 1 - reach, lo + i + 1
                    while hits and hits[-1][1] >= start:
                        start = min(start, hits.pop()[0])
                    hits.append((start, end))
        for state in ends:
            a, b = np.searchsorted(self.full[:, 0], [state, state + 1])
            found.update(self.full[a:b, 1].tolist())
        return hits, {self.names[k] for k in found if k >= 0}

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words whose neighbours are neighbours in some item too; all windows lie within them."""
        known = ids >= 0
        if self.least < 2 or len(ids) < 2:
            good, extra = known, 0
        else:
            code = ids[:-1] * self.base + ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            good = known[:-1] & known[1:] & (self.pairs[place] == code if len(self.pairs) else False)
            extra = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        return [(a, b + extra) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + extra - a >= self.least]


def _pieces(words: list[bytes], size: int, window: int) -> Iterator[list[bytes]]:
    """A long item in pieces of ``size`` words that overlap so far that every window is inside one of them."""
    for k in range(0, max(1, len(words) - window + 1), size):
        yield words[k : k + size + window - 1]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in lists of about ``block_words`` words, one at a time; those without words have no window to find.

    The driver holds one input partition of the items and one list.
    """
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        words = words_of(row["t"])
        for piece in _pieces(words, block_words, window) if words else ():
            block.append((row["i"], piece))
            size += len(piece)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _with_last(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block and whether it is the last one; a single empty block if there is none."""
    held = next(blocks, [])
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def _strings(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)


def _merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(old + new):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = [pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.list_(pa.string()), pa.int64()]


def find_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_words: int = BLOCK_WORDS, cut_above: float | None = None,
) -> DataFrame:
    """``row`` (all input columns as a struct), ``hits`` (word intervals), ``items`` (ids as strings, sorted), ``n_words``.

    With ``cut_above``, the columns of ``docs`` instead: the pass also cuts the hits out of the texts and drops documents
    of which more than that share of words is hit, so that a task runs one Python worker and none besides.

    Every block but the last is a pass of its own that writes the hits of the texts that have any, by the texts' digests.
    The last block's pass joins them to the documents, which are therefore never written; its automaton stays broadcast,
    as the result is read later.
    """
    spark = docs.sparkSession
    small_batches(spark)
    *known, (block, _) = _written_hits(docs, items, text_col, item_id, item_text, window, block_words)
    names = ["row", "hits", "items", "n_words"]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _digest(docs[text_col]).alias("key"))
    if known:
        each = F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        # a table of its own, so that a text of very many rows can be split in the join
        found = stash(reduce(DataFrame.unionByName, [t for _, t in known]).groupBy("key").agg(*each), "hits")
        for _, table in known:
            discard(table)
        rows = rows.join(found, "key", "left").select("row", "hits", "items")
    else:
        rows = rows.select("row", F.lit(None).cast(_HITS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    out = rows.withColumn("n_words", F.lit(None).cast("bigint"))
    columns, at = list(docs.columns), docs.columns.index(text_col)
    held = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for b in batches:
            row = b.column(0)
            hits, ids, counts = [], [], []
            for text, old, had in zip(_texts(row.field(at)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                got, found = automaton.scan(words)
                hits.append(_merge([(h["lo"], h["hi"]) for h in old], got) if old else got)
                ids.append(sorted({*(had or ()), *found}))
                counts.append(len(words))
            if cut_above is not None:
                texts = pa.array((cut_words(t, h) if h else t for t, h in zip(_strings(row.field(at)), hits, strict=True)), type=pa.string())
                stay = pa.array([sum(y - x for x, y in h) <= cut_above * n for h, n in zip(hits, counts, strict=True)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([texts if k == at else row.field(k) for k in range(len(columns))], names=columns).filter(stay)
            else:
                listed = [[{"lo": x, "hi": y} for x, y in h] for h in hits]
                made = [pa.array(x, type=t) for x, t in zip((listed, ids, counts), _FOUND, strict=True)]
                yield pa.RecordBatch.from_arrays([row, *made], names=names)

    return out.mapInArrow(run, out.schema if cut_above is None else docs.schema)


_HITS = "array<struct<lo:int,hi:int>>"


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _written_hits(
    docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_words: int
) -> Iterator[tuple[list, DataFrame | None]]:
    """Each block with its written ``(key, hits, items)`` of the different texts with hits; the last block without."""
    texts = docs.select(_digest(docs[text_col]).alias("key"), docs[text_col].alias("text")).where("text is not null")
    for block, last in _with_last(_blocks(items, item_id, item_text, block_words, window)):
        if last:
            yield block, None
            return
        held = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = held.value
            for b in batches:
                scanned = ((k, *automaton.scan(words_of(t))) for k, t in zip(_strings(b.column(0)), _texts(b.column(1)), strict=True))
                found = [(k, [{"lo": x, "hi": y} for x, y in hits], sorted(ids)) for k, hits, ids in scanned if hits]
                made = [pa.array([f[k] for f in found], type=t) for k, t in enumerate((pa.string(), *_FOUND[:2]))]
                yield pa.RecordBatch.from_arrays(made, names=["key", "hits", "items"])

        table = stash(texts.mapInArrow(run, f"key string, hits {_HITS}, items array<string>").dropDuplicates(["key"]), "block-hits")
        held.destroy()
        yield [], table


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null texts and texts without words have zeros; items without words are in no document; repeated rows of a document
    or an item each count as they stand (an item id counts once). Words of an item with a null id are hit; it has no id
    to be listed or counted by. Without documents or without items the result is that of no hits.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_hits(slim, items, window=window, block_words=block_words)
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, h: acc + h["hi"] - h["lo"])
    return found.select(
        F.col("row")["doc_id"].alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_words(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the characters from each interval's first word to its last."""
    spans = [m.span() for m in _FIND.finditer("".join([c.lower() if "A" <= c <= "Z" else c for c in text]))]
    out, at = [], 0
    for lo, hi in hits:
        out.append(text[at : spans[lo][0]])
        at = spans[hi - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without the passages found in test items; all other columns stay.

    Every hit interval leaves the text. A document of which more than ``max_coverage`` of the words are hit leaves as a
    whole. Documents without a hit are unchanged, null texts included. Ids play no part: rows with a null id and repeated
    rows are each treated by their text. Without items nothing changes; an empty table gives an empty table.
    """
    return find_hits(docs, items, text_col, window=window, block_words=block_words, cut_above=max_coverage)
