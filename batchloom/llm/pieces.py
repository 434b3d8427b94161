"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Method. Spaces become the mark U+2581 and a text is cut before each run of marks, so every unit is a marked word; no piece spans
two units. The distinct units of a block are sorted, which is the depth-first order of their trie: the Viterbi forward scores of a unit
are kept as a stack, and the next unit reuses those of the prefix it shares with the one before. Each new character walks back through a trie of
reversed pieces, so only pieces that end there are tried, and keeps the best sum of piece scores; a character that no piece covers costs the unknown score and becomes its
UTF-8 byte pieces. Results are kept for later blocks of the task (at most CACHE units), so a common word is scored once.

The segmentation is the one of greatest total score (ties: the longest last piece), which is what the file's scores mean under a
unigram model; a model file made for merge-rank encoding is read the same way, so its ids can differ from merge-order encoding.

Scale. One narrow pass over the texts; no shuffle. A worker holds a block, its units and the bounded cache.

Defined results. Null or empty text: no ids. An empty table gives no rows; repeated rows get the same result. Columns named sp_ids or sp_text are
replaced by the outputs of that name. Decoding gives back the text exactly, but that U+2581 itself reads as a space.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from batchloom.llm.textblocks import arrow_limits, replaced

MARK = "▁"
CACHE = 300_000
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; only varint, fixed and length-delimited wire types."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


class Pieces:
    """Pieces, scores and settings of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        kinds, scores = [], []
        self.dummy_prefix, self.squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, kinds, strict=True) if k in (_NORMAL, _USER)):
            raise ValueError("a piece has the mark after another character")
        least = min((s for s, k in zip(scores, kinds, strict=True) if k == _NORMAL), default=0.0)
        self.unknown = least - UNKNOWN_PENALTY
        self.score = {p: s for p, s, k in zip(self.pieces, scores, kinds, strict=True) if k in (_NORMAL, _USER)}
        self.id = {p: i for i, p in enumerate(self.pieces)}
        self.byte = [self.id[f"<0x{b:02X}>"] for b in range(256)]
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte)}
        #: Pieces by their characters from the last to the first; a node's score stands under the empty string.
        self.ends: dict = {}
        for p, score in self.score.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = score
        raw = [self.bytes_of.get(i) or p.encode() for i, p in enumerate(self.pieces)]
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit as little-endian int32. ``units`` are distinct."""
        ends, ids, unknown = self.ends, self.id, self.unknown
        best, back = [0.0], [0]
        before, out = "", {}
        for unit in sorted(units):
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for e in range(same, len(unit)):
                node = ends.get(unit[e])
                top = None if node is None else node.get("")
                if top is None:
                    top, length = unknown + best[e], -1
                else:
                    top, length = top + best[e], 1
                j = e - 1
                while node is not None and j >= 0:
                    node = node.get(unit[j])
                    if node is None:
                        break
                    s = node.get("")
                    if s is not None and s + best[j] >= top:  # longer pieces come later and win ties
                        top, length = s + best[j], e + 1 - j
                    j -= 1
                best.append(top)
                back.append(length)
            found, e = [], len(unit)
            while e:
                n = back[e]
                if n < 0:
                    found.extend(self.byte[b] for b in reversed(unit[e - 1].encode()))
                    e -= 1
                else:
                    found.append(ids[unit[e - n : e]])
                    e -= n
            found.reverse()
            out[unit] = array("i", found).tobytes()
            before = unit
        return out

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        n = self.raw_size[ids]
        end = np.cumsum(n)
        raw = self.raw[np.repeat(self.raw_at[ids] - (end - n), n) + np.arange(int(n.sum()))].tobytes()
        stop = np.concatenate(([0], end))[np.cumsum(sizes)].tolist() if len(sizes) else []
        out, a = [], 0
        for z in stop:
            text = raw[a:z].decode("utf-8", "replace").replace(MARK, " ")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
            a = z
        return out


class Encoder:
    """Encodes blocks of texts, keeping up to CACHE units between blocks."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.kept = pieces, {}

    def units(self, text: str) -> list[str]:
        """The units of a text; one mark at the start of a unit is left out, so plain texts are just split at spaces. Other units get two marks more than they have."""
        p = self.pieces
        if p.dummy_prefix and text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        found = _UNIT.findall(p.normalise(text))
        return [u[1:] if u[0] == MARK and u[1:2] != MARK and len(u) > 1 else MARK + MARK + u for u in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [self.units(t) for t in texts]
        every = set().union(*units)
        new = every - self.kept.keys()
        if len(self.kept) + len(new) > CACHE:
            self.kept, new = {}, every
        whole = {(u[2:] if u.startswith(MARK + MARK) else MARK + u): u for u in new}
        self.kept.update({whole[k]: ids for k, ids in self.pieces.encode_units(list(whole)).items()})
        get = self.kept.__getitem__
        return [b"".join(map(get, u)) for u in units]


def _transform(docs: DataFrame, column: str, model: str | bytes, added: list[tuple[str, object]], each):
    arrow_limits(docs.sparkSession, 4)
    data = model if isinstance(model, bytes) else open(model, "rb").read()
    docs = replaced(docs, *[n for n, _ in added if n.lower() != column.lower()])
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    out = StructType(list(plain.schema.fields))
    for name, kind in added:
        out = out.add(name, kind)
    at = own.index(column)

    def run(batches):
        state = Encoder(Pieces(data))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *each(state, b.column(at))], [*names, *[n for n, _ in added]])

    return plain.mapInArrow(run, out).toDF(*own, *[n for n, _ in added])


def _ids(state: Encoder, column: pa.Array) -> pa.Array:
    """The ids of each text as a list column."""
    texts, out, a = [t or "" for t in column.to_pylist()], [], 0
    while a < len(texts):
        z, held = a, 0
        while z < len(texts) and (z == a or held + len(texts[z]) <= 1 << 20):
            held += len(texts[z])
            z += 1
        out += state.encode(texts[a:z])
        a = z
    size = np.array([0, *[len(x) // 4 for x in out]], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(np.frombuffer(b"".join(out), dtype=np.int32)))


def _crc(ids: pa.Array) -> pa.Array:
    """The checksum of each list of ids, as little-endian unsigned 32-bit integers."""
    raw, at = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes()), (4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
    return pa.array([zlib.crc32(raw[a:z]) for a, z in zip(at, at[1:], strict=False)], pa.int64())


def _texts(state: Encoder, column: pa.Array) -> pa.Array:
    """The text of each list of ids; null for null."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    ids, at, out, a = column.flatten().to_numpy(), 0, [], 0
    while a < len(sizes):  # about a million ids at a time
        z = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 1 << 20, "right")) + a)
        n = int(sizes[a:z].sum())
        out += state.pieces.decode(ids[at : at + n].astype(np.int64), sizes[a:z])
        at, a = at + n, z
    valid = column.is_valid().to_pylist()
    return pa.array([x if v else None for x, v in zip(out, valid, strict=True)], pa.string())


def encode(docs: DataFrame, text_col: str = "text", model: str | bytes | None = None) -> DataFrame:
    """All rows and columns with sp_ids."""
    return _transform(docs, text_col, model or default_model(), [("sp_ids", ArrayType(IntegerType()))], lambda state, c: [_ids(state, c)])


def round_trip(docs: DataFrame, text_col: str = "text", model: str | bytes | None = None) -> DataFrame:
    """All rows and columns with sp_ids, sp_crc (checksum of the ids) and sp_text (the ids decoded), in one pass: one Python worker a task."""

    def each(state, column):
        ids = _ids(state, column)
        return [ids, _crc(ids), _texts(state, ids)]

    return _transform(docs, text_col, model or default_model(), [("sp_ids", ArrayType(IntegerType())), ("sp_crc", LongType()), ("sp_text", StringType())], each)


def decode(docs: DataFrame, ids_col: str = "sp_ids", model: str | bytes | None = None) -> DataFrame:
    """All rows and columns with sp_text; null ids give null."""

    return _transform(docs, ids_col, model or default_model(), [("sp_text", StringType())], lambda state, c: [_texts(state, c)])
