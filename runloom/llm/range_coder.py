"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block of up to `BLOCK` ids is coded on its own, from fresh state. For each id two
predictions are looked up: the id that followed the last two ids (order 2) and the one
that followed the last id (order 1), each with a confidence that hits raise and misses
lower. How far they are trusted is mixed from their confidences and agreement: that
triple selects adaptive chances of "order 2 right" and, if not, "order 1 right". With
neither, the id is coded by its order-0 share, from a table of counts that the file's
head carries. A range coder with 64-bit state writes 32 bits at a time; a carry goes
into the words already written. A block ends with the interval's exact lower end, so a
decoder that is left with anything else has read damaged bytes.

Blocks do not depend on each other, so all blocks of a file advance together: one step
codes one id of each block with NumPy operations over the blocks. Arrays with two rows
hold what belongs to order 2 and to order 1. Choices are made with masks (all bits set
where something holds), which costs less than `np.where`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 4096
PRECISION = 18
#: Blocks that advance together; more are done in turns.
LANES = 3072
#: Slots of the order-1 and order-2 tables of a block.
SLOTS1, SLOTS2 = 1024, 2048
#: Chances are in parts of 2^CHANCE and move by 1/2^RATE of the way to what happened; they stay `EDGE` off 0 and 1.
CHANCE, RATE, EDGE = 12, 5, 32
#: A slot that holds nothing yet: a symbol that no file has.
NOTHING = 1 << 28

U = np.uint64


def fixed(value: int, kind: type = np.int32) -> np.ndarray:
    """A constant as an array without dimensions, which NumPy takes with less to-do than a Python number."""
    return np.array(value, kind)


ONE, TWO, THREE, FOUR, HALF, LOWER, SIGN = map(fixed, (1, 2, 3, 4, 16, 0xFFFF, 31))
SURE, SPAN, OFF, SLOW, NEAR = map(fixed, (CHANCE, 1 << CHANCE, EDGE, RATE, (1 << CHANCE) - 2 * EDGE))
FACTOR1, FACTOR2, DROP1, DROP2, MASK1, MASK2, ONE64 = (fixed(v, np.int64) for v in (40503, 2654435761, 4, 7, SLOTS1 - 1, SLOTS2 - 1, 1))
WORD, BOTTOM, CUT, WIDE, LAST = (fixed(v, U) for v in (32, 1 << 32, CHANCE, PRECISION, (1 << PRECISION) - 1))


class Shares:
    """Order-0 counts of symbols 0..n-1, scaled to 2^PRECISION."""

    def __init__(self, counts: np.ndarray):
        if len(counts) > 1 << (PRECISION - 1):
            raise ValueError(f"{len(counts)} different ids in a file; at most {1 << (PRECISION - 1)} can be coded")
        total = int(counts.sum())
        share = 1 + counts.astype(np.int64) * ((1 << PRECISION) - len(counts)) // max(total, 1)
        share[int(np.argmax(share))] += (1 << PRECISION) - int(share.sum())
        self.share = share.astype(U)
        self.start = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(U)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) <= 1 << 16 else np.int32), share)


class State:
    """Predictions and chances of the blocks, and the width of the coder's interval."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        #: A slot holds 4 * symbol + confidence; order 2 first, then order 1.
        self.slots = np.full(lanes * (SLOTS2 + SLOTS1), NOTHING, np.int32)
        #: Chance of order 2 in the upper half, of order 1 in the lower.
        self.chances = np.full(lanes * 32, (1 << (CHANCE - 2)) * ((1 << 16) + 1), np.int32)
        self.every = [np.arange(lanes) * SLOTS2, lanes * SLOTS2 + np.arange(lanes) * SLOTS1, np.arange(lanes) * 32]
        self.last, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.range = np.full(lanes, ~U(0))
        self.size = -1

    def only(self, n: int) -> None:
        """Goes on with the first n blocks."""
        if n == self.size:
            return
        self.size = n
        self.base2, self.base1, self.base = (b[:n] for b in self.every)
        self.last, self.before, self.wide = self.last[:n], self.mixed[:n], self.range[:n]
        self.at, self.a, self.context = np.empty((2, n), np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        self.held, self.sure, self.p, self.hit, self.x, self.y = (np.empty((2, n), np.int32) for _ in range(6))
        self.agree, self.q, self.left, self.m, self.packed = (np.empty(n, np.int32) for _ in range(5))
        self.at2, self.at1 = self.at
        self.held2, self.held1 = self.held
        self.sure2, self.sure1 = self.sure
        self.p2, self.p1 = self.p
        self.two, self.one = self.hit
        self.x2, self.x1 = self.x

    def predict(self) -> None:
        """Predictions for the next id, and the chances: of order 2 (`p2`), of anything else (`left`), and of order 1 alone (`q`)."""
        a, before, held, sure, agree, m, packed, q, left = self.a, self.before, self.held, self.sure, self.agree, self.m, self.packed, self.q, self.left
        np.multiply(self.last, FACTOR2, a)
        np.add(a, before, a)
        np.right_shift(a, DROP2, a)
        np.bitwise_and(a, MASK2, a)
        np.add(a, self.base2, self.at2)
        np.multiply(self.last, FACTOR1, before)
        np.right_shift(before, DROP1, a)
        np.bitwise_and(a, MASK1, a)
        np.add(a, self.base1, self.at1)
        self.slots.take(self.at, out=held, mode="clip")
        np.bitwise_and(held, THREE, sure)
        np.bitwise_xor(self.held2, self.held1, agree)
        np.subtract(agree, FOUR, agree)
        np.right_shift(agree, SIGN, agree)
        np.subtract(agree, self.sure1, agree)
        np.subtract(agree, self.sure1, agree)
        np.left_shift(self.sure2, THREE, m)
        np.subtract(m, agree, m)
        np.add(m, self.base, self.context)
        self.chances.take(self.context, out=packed, mode="clip")
        np.right_shift(packed, HALF, self.p2)
        np.bitwise_and(packed, LOWER, self.p1)
        np.subtract(SPAN, self.p2, left)
        np.multiply(left, self.p1, q)
        np.right_shift(q, SURE, q)
        np.maximum(q, ONE, q)

    def judge(self, fresh: np.ndarray) -> None:
        """Which predictions are right for an id, given as 4 * symbol (masks)."""
        hit = self.hit
        np.bitwise_xor(self.held, fresh, hit)
        np.subtract(hit, FOUR, hit)
        np.right_shift(hit, SIGN, hit)

    def learn(self, symbol: np.ndarray, fresh: np.ndarray) -> None:
        """Chances, predictions and history after an id."""
        held, hit, sure, x, y, m, packed = self.held, self.hit, self.sure, self.x, self.y, self.m, self.packed
        np.bitwise_and(hit, NEAR, x)
        np.subtract(x, self.p, x)
        np.add(x, OFF, x)
        np.right_shift(x, SLOW, x)
        np.bitwise_not(self.two, m)
        np.bitwise_and(self.x1, m, m)
        np.add(packed, m, packed)
        np.left_shift(self.x2, HALF, m)
        np.add(packed, m, packed)
        self.chances[self.context] = packed
        # wrong: one less sure, or replaced
        np.subtract(sure, ONE, sure)
        np.right_shift(sure, SIGN, sure)
        np.subtract(held, ONE, x)
        np.bitwise_xor(x, fresh, y)
        np.bitwise_and(y, sure, y)
        np.bitwise_xor(x, y, x)
        # right: one surer
        np.add(held, ONE, held)
        np.bitwise_or(fresh, THREE, m)
        np.minimum(held, m, held)
        np.bitwise_xor(held, x, held)
        np.bitwise_and(held, hit, held)
        np.bitwise_xor(x, held, x)
        self.slots[self.at] = x
        self.last = symbol


def turns(blocks: int) -> int:
    """Blocks in a turn, about the same in each."""
    return -(-blocks // max(1, -(-blocks // LANES))) or 1


def active(sizes: np.ndarray) -> list[int]:
    """How many blocks take part in each step."""
    return (len(sizes) - np.cumsum(np.bincount(sizes))[:-1]).tolist()


def encode(blocks: Sequence[np.ndarray], shares: Shares) -> list[bytes]:
    """Bytes of each block of symbols."""
    out: list[bytes] = []
    lanes = turns(len(blocks))
    for at in range(0, len(blocks), lanes):
        out += _encode(blocks[at : at + lanes], shares)
    return out


def _encode(blocks: Sequence[np.ndarray], shares: Shares) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lanes, steps = len(blocks), max(map(len, blocks))
    symbols = np.zeros((lanes, steps), np.int32)
    for lane, i in enumerate(order):
        symbols[lane, : len(blocks[i])] = blocks[i]
    symbols = np.ascontiguousarray(symbols.T)
    state = State(lanes)
    room = steps + 2
    begin = np.arange(lanes) * room
    words, place = np.zeros(lanes * room, np.uint32), begin.copy()
    lower = np.zeros(lanes, U)
    for t, n in enumerate(active(np.array([len(blocks[i]) for i in order]))):
        state.only(n)
        state.predict()
        symbol = symbols[t, :n].astype(np.int64)
        fresh = np.left_shift(symbols[t, :n], TWO)
        state.judge(fresh)
        two, one, p2, q, low, wide = state.two, state.one, state.p2, state.q, lower[:n], state.wide
        # the part of the interval for "order 2 right", "order 1 right" or neither
        wrong = np.bitwise_not(two)
        miss = np.bitwise_not(one)
        np.bitwise_and(miss, wrong, miss)
        start = np.bitwise_and(q, miss)
        np.add(start, p2, start)
        np.bitwise_and(start, wrong, start)
        width = np.subtract(state.left, q)
        np.bitwise_and(width, miss, width)
        np.bitwise_and(one, wrong, wrong)
        np.bitwise_and(wrong, q, wrong)
        np.add(width, wrong, width)
        np.bitwise_and(p2, two, wrong)
        np.add(width, wrong, width)
        np.right_shift(wide, CUT, wide)
        add = start.astype(U)
        np.multiply(add, wide, add)
        np.multiply(wide, width.astype(U), wide)
        # with neither, the symbol's share of that
        miss = miss.astype(np.int64).view(U)
        part = np.right_shift(wide, WIDE)
        share = shares.start.take(symbol)
        np.bitwise_and(share, miss, share)
        np.multiply(share, part, share)
        np.add(add, share, add)
        shares.share.take(symbol, out=share, mode="clip")
        np.multiply(part, share, part)
        np.bitwise_xor(part, wide, part)
        np.bitwise_and(part, miss, part)
        np.bitwise_xor(wide, part, wide)
        np.add(low, add, low)
        (carry,) = (low < add).nonzero()
        if len(carry):
            spot = place[carry]
            while len(spot):
                spot = spot - 1
                words[spot] += np.uint32(1)
                spot = spot[words[spot] == 0]
        state.learn(symbol, fresh)
        (due,) = (wide < BOTTOM).nonzero()
        if len(due):
            spot, now = place[due], low[due]
            words[spot] = now >> WORD
            place[due] = spot + 1
            low[due] = now << WORD
            wide[due] <<= WORD
    for part in (lower >> WORD, lower & U((1 << 32) - 1)):
        words[place] = part
        place += 1
    raw = memoryview(words.astype("<u4", copy=False)).cast("B")
    found = {i: bytes(raw[4 * a : 4 * z]) for i, a, z in zip(order, begin.tolist(), place.tolist(), strict=True)}
    return [found[i] for i in range(lanes)]


def decode(coded: list[bytes], sizes: list[int], shares: Shares) -> list[np.ndarray]:
    """Symbols of each block; blocks that do not end where an encoder ends are refused."""
    out: list[np.ndarray] = []
    lanes = turns(len(coded))
    for at in range(0, len(coded), lanes):
        out += _decode(coded[at : at + lanes], sizes[at : at + lanes], shares)
    return out


def _decode(coded: list[bytes], sizes: list[int], shares: Shares) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    lanes, steps = len(coded), max(sizes)
    data = np.frombuffer(b"".join(coded[i] for i in order), "<u4")
    ends = np.cumsum([len(coded[i]) // 4 for i in order])
    place = np.append(0, ends[:-1])
    last_word = len(data) - 1
    ahead = np.zeros(lanes, U)  # the code's distance from the interval's lower end
    for _ in range(2):
        ahead = ahead << WORD | data[np.minimum(place, last_word)]
        place += 1
    state = State(lanes)
    symbols = np.zeros((steps, lanes), np.int32)
    for t, n in enumerate(active(np.array([sizes[i] for i in order]))):
        state.only(n)
        state.predict()
        code, wide = ahead[:n], state.wide
        np.right_shift(wide, CUT, wide)
        first = state.p2.astype(U)
        np.multiply(first, wide, first)
        one = state.q.astype(U)
        np.multiply(one, wide, one)
        second = np.add(first, one)
        by_two = code < first
        neither = code >= second
        wrong = by_two.astype(np.int64)
        np.subtract(wrong, ONE64, wrong)
        wrong = wrong.view(U)
        miss = neither.astype(np.int64)
        np.negative(miss, miss)
        miss = miss.view(U)
        start = np.bitwise_and(one, miss)
        np.add(start, first, start)
        np.bitwise_and(start, wrong, start)
        np.subtract(code, start, code)
        np.left_shift(wide, CUT, wide)
        np.subtract(wide, second, wide)
        np.bitwise_xor(wide, one, wide)
        np.bitwise_and(wide, miss, wide)
        np.bitwise_xor(wide, one, wide)
        np.bitwise_xor(wide, first, wide)
        np.bitwise_and(wide, wrong, wide)
        np.bitwise_xor(wide, first, wide)
        # with neither, the symbol in whose share the code lies
        part = np.right_shift(wide, WIDE)
        spot = np.floor_divide(code, part)
        np.minimum(spot, LAST, spot)
        np.bitwise_and(spot, miss, spot)
        own = symbols[t, :n]
        np.right_shift(np.where(by_two, state.held2, state.held1), TWO, own)
        np.copyto(own, shares.symbol.take(spot.view(np.int64)), where=neither)
        symbol = own.astype(np.int64)
        share = shares.start.take(symbol, mode="clip")
        np.bitwise_and(share, miss, share)
        np.multiply(share, part, share)
        np.subtract(code, share, code)
        shares.share.take(symbol, out=share, mode="clip")
        np.multiply(part, share, part)
        np.bitwise_xor(part, wide, part)
        np.bitwise_and(part, miss, part)
        np.bitwise_xor(wide, part, wide)
        fresh = np.left_shift(own, TWO)
        state.judge(fresh)
        state.learn(symbol, fresh)
        (due,) = (wide < BOTTOM).nonzero()
        if len(due):
            spot = place[due]
            code[due] = code[due] << WORD | data[np.minimum(spot, last_word)]
            place[due] = spot + 1
            wide[due] <<= WORD
    if ahead.any() or (place != ends).any() or (steps and int(symbols.max()) >= len(shares.share)):
        raise ValueError("damaged block of a token file")
    symbols = np.ascontiguousarray(symbols.T)
    found = {i: symbols[lane, : sizes[i]] for lane, i in enumerate(order)}
    return [found[i] for i in range(lanes)]
