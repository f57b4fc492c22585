"""Adaptive context-mixing range coder of token ids, in blocks that are reset and checked one by one.

Three orders predict ids: order 2 the id that last followed the two ids before, order 1 the one that last followed the id
before, order 0 the ids seen so far, in a list that brings frequent ones forward (an id found at a place is exchanged with
the one at half that place). An id is coded as an event: order 2 is right, else order 1 is right, else order 0 knows it,
else it is new and sent in full. Two adaptive distributions over the events, one in the context of what order 2 knows, one
in that of what order 1 knows, are mixed by a weight that moves to the better one, and the mixture drives the range coder.
A place in the list is coded as a class with an adaptive distribution, and the place in the class.

Many blocks are coded in lockstep, a block in each lane of NumPy arrays, so a step costs the same few array operations
for thousands of ids. All arithmetic that decides is in integers: what one machine writes every other reads.

A block's payload is its 16-bit big-endian words; words after the last count as zero.
"""

from __future__ import annotations

import numpy as np

#: Slots of the order-2 and order-1 tables of a lane.
ORDER2_SLOTS, ORDER1_SLOTS = 4096, 2048
#: Bits of a place in each class of order-0 places, the class's first place, and the places in all.
_PLACE_BITS = np.array([4, 6, 8, 11, 0, 0, 0, 0], dtype=np.int64)
_FIRST = np.array([0, 16, 80, 336, 0, 0, 0, 0], dtype=np.int64)
PLACES = 336 + (1 << 11)
_HINTS = 4096
#: The coder's range lies between these; the difference is one word.
_LOW, _FULL = 1 << 32, 1 << 48
_SCALE = 12
#: Three probabilities share a word, this many bits apart; the fourth is the rest.
_STEP = 21
_FIELD = 0x1FFF
_FIELDS = _FIELD | _FIELD << _STEP | _FIELD << 2 * _STEP
_RATE, _RISE = 5, 124
_EQUAL = 960 | 960 << _STEP | 960 << 2 * _STEP
_SUMS = 1 | 1 << _STEP | 1 << 2 * _STEP
_ONES = 1 | 2 << _STEP | 3 << 2 * _STEP
_AT = np.array([[0], [_STEP], [2 * _STEP]], dtype=np.int64)
_MORE = np.array([_RISE, _RISE << _STEP, _RISE << 2 * _STEP, 0], dtype=np.int64)
_SHIFT = np.array([0, _STEP, 2 * _STEP, 63], dtype=np.int64)
_KEEP = _FIELD >> _RATE
_KEPT = _KEEP | _KEEP << _STEP | _KEEP << 2 * _STEP
_MIX1, _MIX2 = 0x9E3779B1, 0x85EBCA77
#: Classes of a lane that codes no place: nothing, and an id in full. By event and class of place, the class that holds.
_NONE, _WHOLE = 5, 7
_KINDS = np.array([_NONE] * 8 + [0, 1, 2, 3] + [_WHOLE] * 4, dtype=np.int64)
_MORE0 = np.array([_RISE, _RISE << _STEP, _RISE << 2 * _STEP, 0, 0, 0, 0, 0], dtype=np.int64)
_KEPT0 = np.array([_KEPT] * 4 + [0] * 4, dtype=np.int64)


class _Lanes:
    """The model of ``n`` blocks: what the three orders know, the distributions and the weight between them."""

    def __init__(self, n: int, id_bits: int):
        self.n, self.lane = n, np.arange(n, dtype=np.int64)
        self.two, self.one = np.zeros(n * ORDER2_SLOTS, dtype=np.int32), np.zeros(n * ORDER1_SLOTS, dtype=np.int32)
        self.at2, self.at1 = self.lane * ORDER2_SLOTS, self.lane * ORDER1_SLOTS
        # one place more than there are, for lanes that move nothing
        self.list, self.at0 = np.zeros(n * (PLACES + 1), dtype=np.int32), self.lane * (PLACES + 1)
        self.count = np.zeros(n, dtype=np.int64)
        # by order 2: its confidence (8), whether order 1 agrees (2), the last event (4); by order 1: confidence, last event
        self.by2, self.by1 = np.full(n * 64, _EQUAL, dtype=np.int64), np.full(n * 32, _EQUAL, dtype=np.int64)
        self.row2, self.row1 = self.lane * 64, self.lane * 32
        self.by0, self.row0 = np.full(n * 8, _EQUAL, dtype=np.int64), self.lane * 8
        self.weight = np.full(n, 1 << 15, dtype=np.int64)
        self.before, self.last, self.event, self.kind = (np.zeros(n, dtype=np.int64) for _ in range(4))
        self.bounds, self.parts = np.zeros((5, n), dtype=np.int64), np.zeros((9, n), dtype=np.int64)
        self.raw_bits = _PLACE_BITS.copy()
        self.raw_bits[_WHOLE] = id_bits
        self.choices = np.zeros((4, n), dtype=np.int64)

    def predict(self, width: np.ndarray) -> None:
        """Fill ``choices`` 0 and 1 with the predicted ids, and ``bounds`` with where each event's part of ``width`` begins."""
        self.i2 = self.at2 + (((self.last * _MIX1 + self.before * _MIX2) >> 16) & (ORDER2_SLOTS - 1))
        self.i1 = self.at1 + (self.last & (ORDER1_SLOTS - 1))
        self.v2, self.v1 = self.two.take(self.i2), self.one.take(self.i1)
        np.right_shift(self.v2, 3, out=self.choices[0])
        np.right_shift(self.v1, 3, out=self.choices[1])
        agree = self.choices[0] == self.choices[1]
        self.r2 = self.row2 + (((self.v2 & 7) * 2 + agree) * 4 + self.event)
        self.r1 = self.row1 + ((self.v1 & 7) * 4 + self.event)
        self.p2, self.p1 = self.by2.take(self.r2), self.by1.take(self.r1)
        mixed = (((self.p2 - self.p1) * (self.weight >> 8) + (self.p1 << 8)) >> 8) & _FIELDS
        np.multiply(((mixed * _SUMS + _ONES) >> _AT) & _FIELD, width >> _SCALE, out=self.bounds[1:4])
        self.bounds[4] = width

    def divide(self, width: np.ndarray) -> None:
        """Fill ``parts`` with where each class begins in ``width``; a lane without a place has all of it, from row 5 or 7."""
        self.r0 = self.row0 + self.kind
        self.p0 = self.by0.take(self.r0)
        np.multiply(((self.p0 * _SUMS + _ONES) >> _AT) & _FIELD, width >> _SCALE, out=self.parts[1:4])
        self.parts[4::2] = width

    def learn(self, ids: np.ndarray, event: np.ndarray, kind: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Enter the coded ids; gives each lane's place of the id until now and from now on, and the id that left the latter."""
        shift, more = _SHIFT.take(event), _MORE.take(event)
        ahead = ((self.p2 >> shift) & _FIELD) - ((self.p1 >> shift) & _FIELD)
        self.weight = np.minimum(np.maximum(self.weight + ahead, 1 << 10), (1 << 16) - (1 << 10))
        self.by2[self.r2] = self.p2 - ((self.p2 >> _RATE) & _KEPT) + more
        self.by1[self.r1] = self.p1 - ((self.p1 >> _RATE) & _KEPT) + more
        found = event == 2
        self.by0[self.r0] = self.p0 - ((self.p0 >> _RATE) & _KEPT0.take(kind)) + _MORE0.take(kind)
        fresh = (ids << 3 | 1).astype(np.int32)
        self.two[self.i2] = np.where(self.choices[0] == ids, np.minimum(self.v2 + 1, self.v2 | 7), fresh)
        self.one[self.i1] = np.where(self.choices[1] == ids, np.minimum(self.v1 + 1, self.v1 | 7), fresh)
        new = event == 3
        place = np.where(found, place, np.where(new, self.count, PLACES))
        self.count = np.minimum(self.count + new, PLACES - 1)
        to = np.where(found, place >> 1, place)
        other = self.list.take(self.at0 + to)
        self.list[self.at0 + place] = other
        self.list[self.at0 + to] = ids
        self.before, self.last, self.event, self.kind = self.last, ids, event, kind
        return place, to, other


def encode_blocks(ids: np.ndarray, id_bits: int) -> list[bytes]:
    """Payloads of the rows of ``ids`` (blocks by places); ids are below ``2 ** id_bits``, at most 20 bits."""
    n, length = ids.shape
    if not n or not length:
        return [b""] * n
    if id_bits > 20 or int(ids.max()) >> id_bits or int(ids.min()) < 0:
        raise ValueError(f"ids must lie in 0 to {2 ** min(id_bits, 20) - 1}")
    m = _Lanes(n, id_bits)
    columns = np.ascontiguousarray(ids.T)
    low, width = np.zeros(n, dtype=np.int64), np.full(n, _FULL, dtype=np.int64)
    out, used = np.zeros((n, length // 2 + 16), dtype=np.uint16), np.zeros(n, dtype=np.int64)
    # where the list may hold an id, by the id's low bits; an id that another has displaced here is sent as new
    hint, hints = np.zeros(n * _HINTS, dtype=np.int16), m.lane * _HINTS
    class_of = np.searchsorted(_FIRST[1:4], np.arange(PLACES + 1), side="right")

    def emit(rows: np.ndarray, word: np.ndarray) -> None:
        nonlocal out
        if int(used.max()) >= out.shape[1]:
            out = np.concatenate((out, np.zeros_like(out)), axis=1)
        carried = rows[word >> 16 > 0]
        back = used[carried] - 1
        while carried.size:  # a carry passes through words that are full
            out[carried, back] += 1
            on = out[carried, back] == 0
            carried, back = carried[on], back[on] - 1
        out[rows, used[rows]] = word & 0xFFFF
        used[rows] += 1

    for column in columns:
        now = column.astype(np.int64)
        m.predict(width)
        place = hint.take(hints + (now & (_HINTS - 1))).astype(np.int64)
        known = m.list.take(m.at0 + place) == now
        event = np.where(m.choices[0] == now, 0, np.where(m.choices[1] == now, 1, np.where(known, 2, 3)))
        at = event * n + m.lane
        start = m.bounds.ravel().take(at)
        width = m.bounds.ravel().take(at + n) - start
        m.divide(width)
        kind = _KINDS.take(event * 4 + class_of.take(place))
        at = kind * n + m.lane
        first = m.parts.ravel().take(at)
        width = (m.parts.ravel().take(at + n) - first) >> m.raw_bits.take(kind)
        raw = np.where(event == 3, now, np.where(event == 2, place - _FIRST.take(kind), 0))
        low += start + first + width * raw
        held, to, other = m.learn(now, event, kind, place)
        moved = np.flatnonzero(event >= 2)
        hint[hints[moved] + (other[moved] & (_HINTS - 1))] = held[moved]
        hint[hints[moved] + (now[moved] & (_HINTS - 1))] = to[moved]
        rows = np.flatnonzero(width < _LOW)
        while rows.size:
            value = low[rows]
            emit(rows, value >> 32)
            low[rows] = (value & (_LOW - 1)) << 16
            width[rows] <<= 16
            rows = rows[width[rows] < _LOW]
    emit(m.lane, (low + _LOW - 1) >> 32)
    return [words[:k].astype(">u2").tobytes() for words, k in zip(out, used.tolist(), strict=True)]


def decode_blocks(payloads: list[bytes], length: int, id_bits: int) -> np.ndarray:
    """Rows of ``length`` ids from the payloads of as many blocks."""
    n = len(payloads)
    if not n or not length:
        return np.zeros((n, length), dtype=np.int32)
    m = _Lanes(n, id_bits)
    sizes = np.array([len(p) // 2 for p in payloads], dtype=np.int64)
    place = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 4)))[:-1]
    words = np.frombuffer(b"".join(p + bytes(8) for p in payloads), dtype=">u2").astype(np.int64)
    end = place + sizes + 3
    code, width = np.zeros(n, dtype=np.int64), np.full(n, _FULL, dtype=np.int64)
    for _ in range(3):
        code = code << 16 | words.take(place)
        place += 1
    out = np.zeros((length, n), dtype=np.int32)
    for k in range(length):
        m.predict(width)
        reached = code >= m.bounds[1:4]
        event = reached[0].astype(np.int64) + reached[1] + reached[2]
        at = event * n + m.lane
        start = m.bounds.ravel().take(at)
        width = m.bounds.ravel().take(at + n) - start
        code -= start
        m.divide(width)
        reached = code >= m.parts[1:4]
        kind = _KINDS.take(event * 4 + reached[0] + reached[1] + reached[2])
        at0 = kind * n + m.lane
        start = m.parts.ravel().take(at0)
        width = (m.parts.ravel().take(at0 + n) - start) >> m.raw_bits.take(kind)
        code -= start
        raw = _quotient(code, width)
        code -= raw * width
        where = np.where(event == 2, _FIRST.take(kind) + raw, 0)
        m.choices[2] = m.list.take(m.at0 + where)
        m.choices[3] = raw
        ids = m.choices.ravel().take(at)
        out[k] = ids
        m.learn(ids, event, kind, where)
        rows = np.flatnonzero(width < _LOW)
        while rows.size:
            code[rows] = code[rows] << 16 | words.take(np.minimum(place[rows], end[rows]))
            place[rows] += 1
            width[rows] <<= 16
            rows = rows[width[rows] < _LOW]
    return np.ascontiguousarray(out.T)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` of positive numbers below 2^48: the quotient of two such doubles, rounded, is one too high at most."""
    q = (a / b).astype(np.int64)
    return q - (q * b > a)
