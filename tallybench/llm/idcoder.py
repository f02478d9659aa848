"""A range coder for blocks of ids whose probabilities come from mixed id predictions.

Blocks are coded independently, each from a reset model, and in step: the n-th ids of
thousands of blocks are coded by the same array operations, one lane a block. Per lane:

* order 2 and order 1: a table by the last two ids (the last id) holds the id that followed,
  and a confidence that grows when it follows again. The order-2 id, or the order-1 id
  if there is none, is the candidate.
* mixing: three adaptive probabilities say whether the candidate is right, one by the
  order-2 confidence, one by the order-1 confidence and whether both orders agree, one by
  the last three outcomes alone. Their weighted mean is coded with; the weights follow its error.
* order 0: a wrong candidate's id is coded by its frequency among the first 1, 2, 4, 8, ... ids of the
  block, kept as those ids in order: a place in that list is an id. Unseen ids have as many places
  as there are distinct ids, and are then coded evenly.

Whole-number arithmetic throughout, so every machine decodes alike. Coder and decoder run
the same steps; what differs is where the outcome comes from.
"""

from __future__ import annotations

import numpy as np

BLOCK_IDS = 2048
WINDOW, WORD = 62, 32        # bits of the coder's window, and of a word that leaves it
LEAST = 1 << (WINDOW - WORD)  # below this range a word leaves
ONE_BITS = 15                # probabilities are parts of 2 ** 15, so products with weights fit 32 bits
ONE, SLOW, CERTAIN = 1 << ONE_BITS, 4, 1 << 5   # scale, rate, distance from 0 and 1
EVEN_BITS = 13               # a weight of one
EVEN, HEAVY, LEARN = 1 << EVEN_BITS, 1 << 14, 19  # one, the largest weight, rate
SLOTS1, SLOTS2 = 1 << 10, 1 << 11
DOUBLED = 256                # the order-0 list doubles up to this many ids, then grows fourfold
RANKS = 1 << 24              # lanes at a time times distinct ids, at most
PLACE = 13                   # bits of a place in it
FULL = (1 << PLACE) - 1
STEPS = np.array([0, 0, *(-(c + 1 >> 1) for c in range(2, 8)), *[1] * 7, 0], np.int32)  # confidence: halved, or one more
FIRST2 = [4000, 8000, 15000, 20000, 24000, 27000, 29000, 30000]  # by order-2 confidence, at a reset
FIRST1 = [1500, 5000, 10000, 13000, 16000, 18000, 20000, 22000,  # by order-1 confidence; then the
          1500, 10000, 16000, 21000, 25000, 27500, 29000, 30000]  # same where both orders agree
ONE_, ZERO_ = np.int32(ONE), np.int32(0)


class _Output:
    """Words of each lane. A carry out of the window is added to words that have left."""

    def __init__(self, lanes: int, ids: int):
        self.words = np.zeros((lanes, 2 * ids + 4), np.uint32)
        self.at = np.zeros(lanes, np.int64)

    def put(self, lane: np.ndarray, value: np.ndarray) -> None:
        """``value``: a word, and a carry above it."""
        at = self.at[lane]
        self.words[lane, at] = value & 0xFFFFFFFF
        self.at[lane] = at + 1
        over = value >> WORD > 0
        lane, at = lane[over], at[over]
        while len(lane):
            at = at - 1
            more = self.words[lane, at] + np.uint32(1)  # wraps to 0 where it carries on
            self.words[lane, at] = more
            over = more == 0
            lane, at = lane[over], at[over]


def _sorted_prefix(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ids (lanes, m): each lane in order, with the first and last + 1 place of each one's
    id (packed: id, first, last + 1), and the number of distinct ids."""
    m = ids.shape[1]
    s = np.sort(ids, axis=1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, s.size))
    first = heads % m
    packed = (s.ravel()[heads].astype(np.int64) << 2 * PLACE) | (first << PLACE) | (first + size)
    return np.repeat(packed, size), new.sum(axis=1)


def _run(lengths: np.ndarray, vocabulary: int, ids: np.ndarray | None, words: np.ndarray | None) -> np.ndarray | _Output:
    """Code ``ids`` (place, lane) into words, or decode ``words`` (lane, place) into ids.

    ``lengths``: ids of each lane, never rising.
    """
    coding = ids is not None
    lanes, n = len(lengths), int(lengths[0])
    lane = np.arange(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << WINDOW, np.int64)
    lows = low  # all lanes; those that have ended keep theirs
    table1, table2 = np.zeros(lanes * SLOTS1, np.int32), np.zeros(lanes * SLOTS2, np.int32)
    prob2, prob1 = np.tile(np.array(FIRST2, np.int32), lanes), np.tile(np.array(FIRST1, np.int32), lanes)
    prob0 = np.full(lanes * 8, ONE // 4, np.int32)
    weight2, weight1 = np.full(lanes, EVEN // 2, np.int32), np.full(lanes, EVEN // 2, np.int32)
    history, before, last = (np.zeros(lanes, np.int32) for _ in range(3))
    at1, at2, lane8, lane16 = lane * SLOTS1, lane * SLOTS2, lane * 8, lane * 16
    if coding:
        out = _Output(lanes, n)
        # Ids as ranks among those that occur, so that a lane's table of places is small.
        used = np.zeros(vocabulary, bool)
        used[ids.ravel()] = True
        rank = np.cumsum(used) - 1
        width = int(used.sum())
        places = np.zeros(lanes * width, np.int16)
    else:
        shifted = ((words[:, :-1] & 3) << 30) | (words[:, 1:] >> 2)  # what follows the first 62 bits, word by word
        code, at, wide = (words[:, 0] << 30) | (words[:, 1] >> 2), np.ones(lanes, np.int64), shifted.shape[1]
        shifted = shifted.ravel()
        ids = np.zeros((n, lanes), np.int32)

    def refill(short: np.ndarray) -> None:
        """Let a word leave (enter) the windows of these lanes."""
        rng[short] <<= WORD
        if coding:
            values = low.take(short)
            out.put(short, values >> 30)
            low[short] = (values & (LEAST - 1)) << WORD
        else:
            place = at.take(short)
            code[short] = (code.take(short) << WORD) | shifted.take(short * wide + np.minimum(place, wide - 1))
            at[short] = place + 1

    active, m, rebuild = lanes, 0, 1
    for t in range(n):
        if lengths[active - 1] <= t:
            active = int((lengths > t).sum())
            lane, low, rng, weight2, weight1, history, before, last, at1, at2, lane8, lane16 = (
                x[:active] for x in (lane, low, rng, weight2, weight1, history, before, last, at1, at2, lane8, lane16))
            if not coding:
                code, at = code[:active], at[:active]
        if t == rebuild:
            m, rebuild = t, t * (2 if t < DOUBLED else 4)
            ordered, distinct = _sorted_prefix(np.ascontiguousarray(ids[:m, :active].T))
            total, start = m + distinct, lane * m
            if coding:
                places[np.repeat(lane * width, m) + rank.take(ordered >> 2 * PLACE)] = np.tile(np.arange(m, dtype=np.int16), active)
        # The candidate and how likely it is.
        mixed = last * 40503
        slot1 = ((mixed >> 4) & (SLOTS1 - 1)) + at1
        slot2 = (((mixed + before * 30011) >> 3) & (SLOTS2 - 1)) + at2
        entry1, entry2 = table1.take(slot1), table2.take(slot2)
        sure1, sure2 = entry1 & 7, entry2 & 7
        id1, id2 = entry1 >> 3, entry2 >> 3
        guess = np.where(sure2 > 0, id2, id1)
        state2, state1, state0 = lane8 + sure2, lane16 + (sure1 + ((id1 == guess).view(np.int8) << 3)), lane8 + history
        p2, p1, p0 = prob2.take(state2), prob1.take(state1), prob0.take(state0)
        away2, away1 = p2 - p0, p1 - p0
        p = p0 + ((weight2 * away2 + weight1 * away1) >> EVEN_BITS)
        np.maximum(p, CERTAIN, out=p)
        np.minimum(p, ONE - CERTAIN, out=p)
        bound = (rng >> ONE_BITS) * p
        # The outcome.
        rest = rng - bound
        if coding:
            now = ids[t, :active]
            right = now == guess
            wrong = np.flatnonzero(~right)
            low[wrong] += bound.take(wrong)
        else:
            right = code < bound
            now = guess
            wrong = np.flatnonzero(~right)
            code[wrong] -= bound.take(wrong)
        rng = np.where(right, bound, rest)
        if len(wrong):
            novel = wrong
            if m:
                all_ = total.take(wrong)
                share = rest.take(wrong) // all_
                if coding:
                    want = now.take(wrong)
                    place = np.minimum(places.take(wrong * width + rank.take(want)), m - 1) + start.take(wrong)
                    run = ordered.take(place)
                    known = run >> 2 * PLACE == want
                else:
                    value = code.take(wrong)
                    target = np.minimum(value // share, all_ - 1)
                    known = target < m
                    run = ordered.take(np.minimum(target, m - 1) + start.take(wrong))
                    now[wrong] = run >> 2 * PLACE
                a, b = np.where(known, (run >> PLACE) & FULL, m), np.where(known, run & FULL, all_)
                if coding:
                    low[wrong] += share * a
                else:
                    code[wrong] = value - share * a
                rng[wrong] = share * (b - a)
                novel = wrong[~known]
            if len(novel):
                short = novel[rng.take(novel) < LEAST]
                if len(short):
                    refill(short)
                share = rng.take(novel) // vocabulary
                if coding:
                    low[novel] += share * now.take(novel)
                else:
                    found = np.minimum(code.take(novel) // share, vocabulary - 1)
                    code[novel] -= share * found
                    now[novel] = found
                rng[novel] = share
        short = np.flatnonzero(rng < LEAST)
        if len(short):
            refill(short)
        # What was learnt.
        yes = right.view(np.int8)
        aim = np.where(right, ONE_, ZERO_)
        error = (aim - p) >> 2
        weight2 += (error * away2) >> LEARN
        weight1 += (error * away1) >> LEARN
        np.clip(weight2, -HEAVY, HEAVY, out=weight2)
        np.clip(weight1, -HEAVY, HEAVY, out=weight1)
        prob2[state2] = p2 + ((aim - p2) >> SLOW)
        prob1[state1] = p1 + ((aim - p1) >> SLOW)
        prob0[state0] = p0 + ((aim - p0) >> SLOW)
        history = (history + history + yes) & 7
        fresh = (now << 3) + 1
        step2, step1 = sure2 + ((id2 == now).view(np.int8) << 3), sure1 + ((id1 == now).view(np.int8) << 3)
        table2[slot2] = np.where(step2 < 2, fresh, entry2 + STEPS.take(step2))
        table1[slot1] = np.where(step1 < 2, fresh, entry1 + STEPS.take(step1))
        if not coding:
            ids[t, :active] = now
        before, last = last, now
    if not coding:
        return ids
    out.put(np.arange(lanes), (lows + LEAST - 1) >> 30)  # a value inside the last range
    return out


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The payload of each block of ids (at least one, all below ``vocabulary``)."""
    used = np.zeros(vocabulary, bool)
    for block in blocks:
        used[block] = True
    lanes = max(256, RANKS // max(int(used.sum()), 1))
    if len(blocks) > lanes:
        return [p for at in range(0, len(blocks), lanes) for p in encode(blocks[at: at + lanes], vocabulary)]
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((int(lengths[0]), len(blocks)), np.int32)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    out = _run(lengths, vocabulary, ids, None)
    payloads: list[bytes] = [b""] * len(blocks)
    for lane, i in enumerate(order):
        payloads[i] = out.words[lane, : out.at[lane]].astype("<u4").tobytes()
    return payloads


def decode(payloads: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block; a damaged payload gives other ids, never a crash."""
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    widest = max(len(payloads[i]) for i in order) // 4
    words = np.zeros((len(payloads), widest + 2), np.int64)
    for row, i in enumerate(order):
        found = np.frombuffer(payloads[i][: len(payloads[i]) // 4 * 4], "<u4")
        words[row, : len(found)] = found
    ids = _run(np.array([lengths[i] for i in order]), vocabulary, None, words)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    for row, column in enumerate(np.ascontiguousarray(ids.T)):
        out[order[row]] = column[: lengths[order[row]]]
    return out
