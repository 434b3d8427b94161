"""Token-ID files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Model. Order-2 and order-1 contexts (the last two ids, the last id) each remember the id that followed last time, with a confidence. For each
id the model asks "is it the order-2 prediction?", then "is it the order-1 prediction?"; the chance of yes mixes the adaptive estimates of both
orders' confidences and of order 0 in the logistic domain with weights learned on the way. An id that neither predicts is coded by order-0
frequencies. Both answers and the order-0 frequency make one interval of a 64-bit range coder.

Every block starts from the same blank model, so blocks decode alone and in any order. A block is cut into runs of equal length, coded side by
side in numpy lanes with a range coder each: step t codes the t-th id of every run. The lanes share one model, so it learns from all of them and
stays in a core's cache. Each order's states are few, so the mixed chances are tables, which are mixed and learned anew every ``REFRESH``
steps from what the lanes saw, as are the order-0 frequencies at steps that double, then every ``RECOUNT``. All model arithmetic is in integers, so
encoder and decoder agree bit for bit. Of lanes with one context in one step the last one's id is remembered.

Block format (little endian): magic ``CMR3``; uint32 number of ids, number of documents, bytes of the document table, bytes of
code, crc32 of the ids as uint32; the document table (zlib: int64 first row number, int64 ids of the documents, uint32 ids of each in this block); the code:
uint32 number of lanes and of ids in the alphabet, uint32 words of each lane, the lanes' 32-bit words (after them a lane's code is zeros).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
BLOCK_IDS = 1 << 21
LANES = 4096
RUN_IDS = 256  # a lane's ids at least, where a block has as many
REFRESH, RECOUNT = 16, 128
_SLOTS = 1 << 17
_BITS = 20  # order-0 frequencies sum to 1 << _BITS
_ONE = 1 << 12  # chances are in 1/4096
_LEAST = 64  # least chance of either answer: the intervals of all ids stay open
_HEAD, _CODE = struct.Struct("<4s5I"), struct.Struct("<2I")
_U = np.uint64

# stretch(p) = ln(p / (1 - p)) in 1/256 for p in 1/4096, and its inverse, as integer tables
_STRETCH = np.round(256 * np.log((np.arange(_ONE) + 0.5) / (_ONE - np.arange(_ONE) - 0.5))).astype(np.int64)
_SQUASH = np.clip(np.round(_ONE / (1 + np.exp(-np.arange(-2048, 2048) / 256))), _LEAST, _ONE - _LEAST).astype(np.int64)

# a state is (confidence of order 2, of order 1, whether they agree, level of the prediction in order 0); each order sees a part of it
_STATES = 1 << 11
_STATE = np.arange(_STATES)
_SEEN = (_STATE >> 8 << 1 | _STATE >> 4 & 1, _STATE >> 4 & 15, _STATE & 15)
_NEXT = np.array([s >> 1 for s in range(8)] + [min(s + 1, 7) for s in range(8)], np.int32)  # confidence after no and after yes


def _by_order(n: np.ndarray) -> list[np.ndarray]:
    """Sums of the states' numbers by what each order sees."""
    n = n.reshape(128, 16)
    pairs = n.sum(axis=1).reshape(8, 8, 2)
    return [pairs.sum(axis=1).ravel(), pairs.sum(axis=0).ravel(), n.sum(axis=0)]


class _Question:
    """The chance of yes in each state: three orders' adaptive chances, mixed with learned weights. ``second``: not put where both orders agree."""

    def __init__(self, second: bool):
        self.second = second
        self.chance = np.full((3, 16), _ONE // 3, dtype=np.int64)
        self.weight = np.full(3, 22000, dtype=np.int64)  # in 1/65536
        self.mix()

    def mix(self):
        self.inputs = [_STRETCH[self.chance[o]].take(s) for o, s in enumerate(_SEEN)]
        dot = sum(w * x for w, x in zip(self.weight.tolist(), self.inputs, strict=True)) >> 16
        self.mixed = _SQUASH.take(dot + 2048, mode="clip")
        if self.second:
            self.mixed[_STATE & 16 != 0] = 0

    def learn(self, seen: np.ndarray):
        """``seen``: state * 2 + yes of each time the question was put; larger numbers and states where it is not put do not count."""
        found = np.bincount(seen, minlength=2 * _STATES)
        yes = found[1 : 2 * _STATES : 2].copy()
        n = yes + found[: 2 * _STATES : 2]
        if self.second:
            yes.reshape(64, 2, 16)[:, 1] = n.reshape(64, 2, 16)[:, 1] = 0
        total = int(n.sum())
        if not total:
            return
        error = yes * (_ONE - 1) - n * self.mixed
        for o, (y, k) in enumerate(zip(_by_order(yes), _by_order(n), strict=True)):
            self.chance[o] = np.clip((self.chance[o] * 32 + y * _ONE) // (32 + k), 16, _ONE - 17)
            self.weight[o] += int(np.dot(self.inputs[o], error)) * min(total, 16) // total >> 9
        self.mix()


class _Encoder:
    """A range coder a lane; ``out`` has the lanes' words, where a carry may stand on top of the 32 bits until ``finish``.

    A lane's range is 2**32 at least before each id, so one word an id is put out at most."""

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.at = np.arange(lanes)  # place of the next word
        self.out = np.zeros((steps + 2) * lanes, _U)

    def narrow(self, start, size):
        step = self.range >> _U(32)
        low = self.low + step * start
        self.carry(low)
        self.range = step * size
        go = np.flatnonzero(self.range < _U(1 << 32))
        self.put(go)
        self.range[go] <<= _U(32)

    def carry(self, low):
        over = np.flatnonzero(low < self.low)
        if len(over):
            self.out[self.at[over] - self.lanes] += _U(1)
        self.low = low

    def put(self, go):
        low, at = self.low[go], self.at[go]
        self.out[at] = low >> _U(32)
        self.low[go] = low << _U(32)
        self.at[go] = at + self.lanes

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each lane, the words lane by lane). One word names a value in the range, with zeros behind it."""
        self.carry(self.low + _U((1 << 32) - 1))
        self.put(np.arange(self.lanes))
        n = self.at // self.lanes
        rows = self.out.reshape(-1, self.lanes)[: int(n.max())]
        for i in range(len(rows) - 1, 0, -1):
            rows[i - 1] += rows[i] >> _U(32)
        return n, rows.astype("<u4").T[np.arange(len(rows)) < n[:, None]]


class _Decoder:
    def __init__(self, lanes: int, n: np.ndarray, words: np.ndarray):
        upto = np.cumsum(n, dtype=np.int64)
        self.words = np.insert(words, upto, 0)  # zeros behind each lane
        self.at = upto - n + np.arange(lanes)
        self.code, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        for _ in range(2):
            self.code = self.code << _U(32) | self.next(np.arange(lanes))

    def next(self, go):
        at = self.at[go]
        self.at[go] = at + 1
        return self.words.take(at, mode="clip").astype(_U)

    def point(self):
        """Where each lane's code stands in its range, in units of range / 2**32."""
        self.step = self.range >> _U(32)
        return np.minimum(self.code // self.step, _U((1 << 32) - 1)).view(np.int64)

    def narrow(self, start, size):
        self.code -= self.step * start
        self.range = self.step * size
        go = np.flatnonzero(self.range < _U(1 << 32))
        wide = self.range[go] << _U(32)
        if not wide.all():
            raise ValueError("a block of ids does not decode")
        self.range[go] = wide
        self.code[go] = self.code[go] << _U(32) | self.next(go)


class _Frequencies:
    """Order 0: ``span`` has for each id the sums of the frequencies of the ids below it (in the upper half) and up to it, each frequency at
    least 1; ``at`` has the id at each place of the sum."""

    def __init__(self, size: int, places: bool):
        self.size, self.places = size, places
        self.count = np.zeros(size, np.int64)
        self.fit()

    def fit(self):
        weight = self.count * 16 + 1
        size = 1 + weight * ((1 << _BITS) - self.size) // int(weight.sum())
        size[int(self.count.argmax())] += (1 << _BITS) - int(size.sum())
        upto = np.cumsum(size)
        self.span = upto - size << 32 | upto
        self.level = np.clip(np.frexp(size.astype(np.float32))[1] - 4, 0, 15).astype(np.uint8)  # 0 below 16, then the power of two
        if self.places:
            self.at = np.repeat(np.arange(self.size, dtype=np.uint16), size)


def _run(steps: int, lanes: int, alphabet: int, coder: _Encoder | _Decoder, ids: np.ndarray | None) -> np.ndarray:
    """Codes (ids given) or decodes a table of ids, a row a step. Lanes choose by masks, 0 for yes and -1 for no: numpy's ``where`` is slow on mixed answers."""
    out = np.zeros((steps, lanes), dtype=np.int64) if ids is None else ids
    one, two = np.zeros(1 << 16, np.int32), np.zeros(_SLOTS, np.int32)  # id * 8 + confidence
    order0, questions = _Frequencies(alphabet, ids is None), (_Question(False), _Question(True))
    seen = np.zeros((2, REFRESH, lanes), dtype=np.int64)
    last, hash1, hash2 = (np.zeros(lanes, np.int64) for _ in range(3))
    counted, recount = 0, 1
    for t in range(steps):
        c2 = hash1 + (hash2 >> 9) >> 13 & (_SLOTS - 1)
        e1, e2 = one.take(last).astype(np.int64), two.take(c2).astype(np.int64)
        p1, p2, s1, s2 = e1 >> 3, e2 >> 3, e1 & 7, e2 & 7
        state = s2 << 8 | s1 << 5 | (p1 == p2).view(np.int8) << 4
        state2, state1 = state | order0.level.take(p2), state | order0.level.take(p1)
        a, b = questions[0].mixed.take(state2), questions[1].mixed.take(state1)
        no = _ONE - a
        w2, w1 = a << 20, no * b << 8
        rest = (no << 20) - w1
        if ids is not None:
            x = ids[t]
        else:
            point = coder.point()
            over = point - w2 - w1
            # float64 holds both numbers, and a quotient below 2**20 by less than 2**32 does not round up to the next integer
            place = np.divide((over + 1 << _BITS) - 1, rest).astype(np.int64)
            x = order0.at.take(place, mode="clip").astype(np.int64)
            x = (x ^ p1) & ~(over >> 63) ^ p1
            x = (x ^ p2) & ~(point - w2 >> 63) ^ p2
            out[t] = x
        yes2, yes1 = (x == p2).astype(np.int64), (x == p1).astype(np.int64)
        no2, no1 = yes2 - 1, yes1 - 1
        span = order0.span.take(x)
        start = rest * (span >> 32) >> _BITS
        size = (rest * (span & 0xFFFFFFFF) >> _BITS) - start
        start = w2 + (w1 + start & no1) & no2
        size = (((size ^ w1) & no1 ^ w1) ^ w2) & no2 ^ w2
        coder.narrow(start.view(_U), size.view(_U))
        i = t % REFRESH
        np.add(state2 << 1, yes2, out=seen[0, i])
        np.add(state1 << 1 | yes1, yes2 << 12, out=seen[1, i])  # beyond the states where order 2 was right
        one[last] = (x ^ (x ^ p1) & (1 - s1 >> 63)).astype(np.int32) << 3 | _NEXT.take(yes1 << 3 | s1)  # from a confidence of 2 on the id stays
        two[c2] = (x ^ (x ^ p2) & (1 - s2 >> 63)).astype(np.int32) << 3 | _NEXT.take(yes2 << 3 | s2)
        last, hash1, hash2 = x, x * 0x9E3779B1, hash1
        if i == REFRESH - 1:
            for question, what in zip(questions, seen, strict=True):
                question.learn(what.ravel())
        if t + 1 == recount:
            order0.count += np.bincount(out[counted : t + 1].ravel(), minlength=alphabet)
            order0.fit()
            counted, recount = t + 1, t + 1 + min(t + 1, RECOUNT)
    return out


def _encoded(ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    lanes = max(1, min(LANES, len(ids) // RUN_IDS))
    steps = -(-len(ids) // lanes)
    table = np.zeros(lanes * steps, np.int64)  # the last run is filled up with zeros
    table[: len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    alphabet, coder = int(ids.max()) + 1, _Encoder(lanes, steps)
    _run(steps, lanes, alphabet, coder, table)
    sizes, words = coder.finish()
    return _CODE.pack(lanes, alphabet) + sizes.astype("<u4").tobytes() + words.tobytes()


def _decoded(code: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    lanes, alphabet = _CODE.unpack_from(code) if len(code) >= _CODE.size else (0, 0)
    if not (0 < lanes <= n and 0 < alphabet <= 1 << 16 and len(code) >= _CODE.size + 4 * lanes):
        raise ValueError("not the code of a block of ids")
    sizes = np.frombuffer(code, "<u4", lanes, _CODE.size).astype(np.int64)
    words = code[_CODE.size + 4 * lanes :]
    if 4 * sizes.sum() != len(words):
        raise ValueError("not the code of a block of ids")
    return _run(-(-n // lanes), lanes, alphabet, _Decoder(lanes, sizes, np.frombuffer(words, "<u4")), None).T.ravel()[:n]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids below 65536."""
    return [_encoded(np.asarray(b, dtype=np.int64)) for b in blocks]


def decode(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    return [_decoded(c, n) for c, n in zip(codes, lengths, strict=True)]


def pack_blocks(blocks: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Blocks of (ids, first row number, document ids, ids of each document in the block) in the file format."""
    out = []
    for (ids, first, docs, sizes), code in zip(blocks, encode([b[0] for b in blocks]), strict=True):
        table = zlib.compress(struct.pack("<q", first) + docs.astype("<i8").tobytes() + sizes.astype("<u4").tobytes())
        out.append(_HEAD.pack(MAGIC, len(ids), len(docs), len(table), len(code), zlib.crc32(ids.astype("<u4").tobytes())) + table + code)
    return out


def unpack_blocks(values: list[bytes]) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """What ``pack_blocks`` was given. A block that doesn't match its checksum raises ValueError."""
    out = []
    for v in values:
        magic, n, docs, table, code, crc = _HEAD.unpack_from(v)
        if magic != MAGIC or len(v) != _HEAD.size + table + code:
            raise ValueError("not a block of ids")
        rows = zlib.decompress(v[_HEAD.size : _HEAD.size + table])
        ids = _decoded(v[_HEAD.size + table :], n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of ids does not match its checksum")
        out.append((ids, struct.unpack_from("<q", rows)[0], np.frombuffer(rows, "<i8", docs, 8), np.frombuffer(rows, "<u4", docs, 8 + 8 * docs)))
    return out
