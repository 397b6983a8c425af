"""Operator 11: SentencePiece ids with the byte span of the source behind every piece, and back.

A text is first normalised by the model's own rules: at each place the compiled character map, a
double-array trie over UTF-8 bytes, gives the longest prefix that it holds and what replaces it; a
character without one stays. White space is collapsed, escaped and prefixed as the model asks. Each
normalised byte keeps the place of the source bytes that it came from, so a piece that covers
normalised bytes a:b comes from source bytes align[a]:align[b], however the map grew or shrank them.

Normalised text is cut where no piece of the vocabulary reaches across (before escaped white space and
around a line feed that only stands alone), and distinct cuts are encoded once for each worker, in a
dictionary of bounded size. Encoding of a cut is the library's, with its own normaliser switched off.

Null and empty texts give the begin and end ids alone. Very long texts are taken whole, in blocks of
BLOCK characters between cuts. Each row is encoded by itself, so repeated rows, equal and null ids keep
their rows; an empty table gives no rows; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, tidy

#: Cuts kept by a worker; beyond that the dictionary starts anew, so memory stays bounded.
KEPT_CUTS = 300_000
#: Characters of normalised text that are cut together.
BLOCK = 1 << 20
SPACE = "▁"
_SPACE = SPACE.encode()
#: Fixed values of the model file's format: kinds of pieces, field numbers, the unknown piece's surface.
UNKNOWN, CONTROL, DEFINED, BYTE = 2, 3, 4, 6
UNKNOWN_SURFACE = " ⁇ ".encode()

PIECES = "doc_id long, n_tokens long, ids binary, begins array<long>, ends array<long>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; lengths and varints only are decoded."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement by a compiled map: trie size, trie units, then replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""
        #: Bytes that some key begins with.
        self.starts = np.array([self._step(self._root(), b) is not None for b in range(256)], bool) if size else np.zeros(256, bool)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """(the child's node, the child's unit), or None."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        return (at ^ self._offset(unit), unit) if unit & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key at raw[at:] and its replacement; (0, b"") without one."""
        node, found, value = self._root(), 0, 0
        for i in range(at, len(raw)):
            step = self._step(node, raw[i])
            if step is None:
                break
            node, unit = step
            if unit >> 8 & 1:
                found, value = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return (found, self.strings[value : self.strings.index(b"\0", value)]) if found else (0, b"")


class Model:
    """One model file: normalise, encode with spans, decode; equal to the library's own results."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._load(f.read())

    @classmethod
    def of(cls, proto: bytes) -> Model:
        model = cls.__new__(cls)
        model._load(proto)
        return model

    def _load(self, proto: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        pieces, trainer, spec = [], {}, {}
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, 1)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                spec |= dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.collapse, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.suffix, self.byte_ids = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.space = _SPACE if escape else b" "
        #: The same model with a normaliser that changes nothing (a later message overrides an earlier one).
        off = b"\x12\x00\x18\x00\x20\x00\x28" + bytes([escape])
        self.library = SentencePieceProcessor(model_proto=proto + b"\x1a" + bytes([len(off)]) + off)
        self.bos, self.eos, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()

        kinds = np.array([k for _, k in pieces])
        self.control, self.byte = kinds == CONTROL, kinds == BYTE
        surfaces = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_SURFACE if k == UNKNOWN else p.encode() for p, k in pieces]
        #: Normalised bytes of each id; a byte's piece covers one.
        self.width = np.array([0 if k in (CONTROL, UNKNOWN) else len(s) for s, (_, k) in zip(surfaces, pieces, strict=True)], np.int64)
        self.surfaces = [s if kinds[i] in (BYTE, UNKNOWN) else s.replace(_SPACE, b" ") for i, s in enumerate(surfaces)]
        self.sizes = np.array([len(s) for s in self.surfaces], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.joined = np.frombuffer(b"".join(self.surfaces) or b"\0", np.uint8)
        self.spaced = [p.startswith(SPACE) for p, _ in pieces]
        #: Symbols that are never normalised, by first byte, longest first.
        self.defined: dict[int, list[bytes]] = {}
        for s in sorted((p.encode() for p, k in pieces if k == DEFINED and p), key=len, reverse=True):
            self.defined.setdefault(s[0], []).append(s)
        self.starts = self.map.starts.copy()
        self.starts[list(self.defined)] = True

        mark = self.space.decode()
        whole = [p for p, k in pieces if k not in (CONTROL, UNKNOWN, BYTE)]
        crossed = any(a != mark and b == mark for p in whole for a, b in zip(p, p[1:]))
        line = not any(len(p) > 1 and "\n" in p for p in whole)
        #: Cuts that no piece reaches across; without byte ids neighbouring unknown pieces merge, so texts stay whole.
        m = re.escape(mark)
        self.cut = None if crossed or not self.byte_ids else re.compile(f"{m}*[^{m}\n]+|{m}+|\n" if line else f"{m}*[^{m}]+|{m}+")
        self.known: dict[str, bytes] = {}

    # -------------------------------------------------------------- normalising
    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and their end, the source byte behind it."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        buf = np.frombuffer(raw, np.uint8)
        if self.collapse or self.suffix or self.starts[buf].any():
            return self._stepped(raw, buf)
        # nothing but white space changes
        at = np.arange(len(buf))
        head = np.maximum.accumulate(np.where(buf & 0xC0 != 0x80, at, 0))
        align = np.repeat(head, np.where(buf == 32, len(self.space), 1))
        lead = np.zeros(len(self.space) if self.prefix else 0, np.int64)
        return (self.space if self.prefix else b"") + raw.replace(b" ", self.space), np.concatenate((lead, align, [len(raw)]))

    def _stepped(self, raw: bytes, buf: np.ndarray) -> tuple[bytes, np.ndarray]:
        """normalize() prefix by prefix, with runs between places of interest taken together."""
        stops = self.starts[buf] | (buf == 32)
        head = np.maximum.accumulate(np.where(buf & 0xC0 != 0x80, np.arange(len(buf)), 0))
        places = np.append(np.flatnonzero(stops & (buf & 0xC0 != 0x80)), len(buf)).tolist()
        out: list[bytes] = []
        align: list[np.ndarray] = []
        at, k, open_space = 0, 0, self.collapse

        def put(piece: bytes, source: np.ndarray) -> None:
            # white space is escaped here, three bytes for one
            if piece:
                out.append(piece.replace(b" ", self.space))
                is_space = np.frombuffer(piece, np.uint8) == 32
                align.append(np.repeat(source, np.where(is_space, len(self.space), 1)))

        begun = not self.collapse
        lead = 0
        while at < len(raw):
            while places[k] < at:
                k += 1
            if places[k] > at:
                piece, source, end = raw[at : places[k]], head[at : places[k]], places[k]
            else:
                symbol = next((s for s in self.defined.get(raw[at], ()) if raw.startswith(s, at)), None)
                n, piece = (len(symbol), symbol) if symbol else self.map.longest(raw, at) if self.map.starts[raw[at]] else (0, b"")
                if not n:
                    n = 2 if 0xC0 <= raw[at] < 0xE0 else 3 if 0xE0 <= raw[at] < 0xF0 else 4 if raw[at] >= 0xF0 else 1
                    piece = raw[at : at + n]
                source, end = np.full(len(piece), at, np.int64), at + n
            if not begun:
                # leading spaces only: each is skipped as a whole
                if piece == b" ":
                    at = lead = end
                    continue
                begun = True
            if open_space:
                cut = len(piece) - len(piece.lstrip(b" "))
                piece, source = piece[cut:], source[cut:]
            put(piece, source)
            if piece:
                open_space = self.collapse and piece.endswith(b" ")
            at = end
        if not begun:
            return b"", np.array([len(raw)])
        body, align = b"".join(out), np.concatenate([*align, [len(raw)]])
        if self.prefix and not self.suffix:
            body, align = self.space + body, np.concatenate((np.full(len(self.space), lead), align))
        if self.collapse:
            # only a text of more than white space comes here, so the prefix may go with what follows it
            keep = len(body)
            while keep and body.endswith(self.space, 0, keep):
                keep -= len(self.space)
            body, align = body[:keep], align[: keep + 1]
        if self.prefix and self.suffix:
            body, align = body + self.space, np.concatenate((align, np.full(len(self.space), align[-1])))
        return body, align

    # -------------------------------------------------------------- encoding
    def _blocks(self, text: str) -> Iterator[str]:
        mark, at = self.space.decode(), 0
        while len(text) - at > 2 * BLOCK:
            end = text.find(mark, at + BLOCK)
            while end > 0 and text[end - 1] == mark:
                end = text.find(mark, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _ids(self, text: str) -> bytes:
        """Ids of normalised text as 32-bit integers."""
        if self.cut is None:
            return np.array(self.library.encode(text, out_type=int), "<u4").tobytes()
        out = []
        for block in self._blocks(text):
            cuts = self.cut.findall(block)
            new = list(set(cuts).difference(self.known))
            if new:
                if len(self.known) > KEPT_CUTS:
                    self.known.clear()
                    new = list(set(cuts))
                for cut, ids in zip(new, self.library.encode(new, out_type=int, num_threads=1), strict=True):
                    self.known[cut] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(b"".join(map(self.known.__getitem__, cuts)))
        return b"".join(out)

    def _widths(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each piece covers."""
        widths = self.width[ids]
        if not self.byte_ids and (ids == self.unknown).any():
            widths = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], np.int64)
        return widths

    def encode(self, text: str | None, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end of the source bytes behind each (of a character's bytes the last has them)."""
        raw = (text or "").encode()
        normal, align = self.normalize(raw)
        shown = normal.decode()
        ids = np.frombuffer(self._ids(shown), "<u4") if normal else np.zeros(0, "<u4")
        cut = np.concatenate(([0], np.cumsum(self._widths(shown, ids))))
        begins, ends = align[cut[:-1]], align[cut[1:]]
        if bos:
            ids, begins, ends = np.append(np.uint32(self.bos), ids), np.append(0, begins), np.append(0, ends)
        if eos:
            ids, begins, ends = np.append(ids, np.uint32(self.eos)), np.append(begins, len(raw)), np.append(ends, len(raw))
        return ids.astype("<u4"), begins, ends

    # -------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: surfaces in turn, less the prefix; bytes that form no character become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids].copy()
        places = self.places[ids].copy()
        if self.prefix or self.collapse:
            # the prefix goes; where white space is collapsed, so do all pieces' up to the first text
            for i, x in enumerate(ids.tolist()):
                if self.byte[x]:
                    break
                if not self.control[x] and self.spaced[x]:
                    sizes[i] -= 1
                    places[i] += 1
                    if not self.collapse:
                        break
                if sizes[i]:
                    break
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        out = self.joined[np.arange(total) - np.repeat(before - places, sizes)].tobytes()
        is_byte = self.byte[ids]
        if not is_byte.any():
            return out
        try:
            out.decode()
            # runs of bytes whose neighbours complete them don't occur: pieces are whole characters
            return out
        except UnicodeDecodeError:
            return self._repaired(out, before, sizes, is_byte)

    @staticmethod
    def _repaired(out: bytes, before: np.ndarray, sizes: np.ndarray, is_byte: np.ndarray) -> bytes:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], is_byte.view(np.int8), [0]))))
        parts, at = [], 0
        for s, e in edge.reshape(-1, 2).tolist():
            begin, end = int(before[s]), int(before[e - 1] + sizes[e - 1])
            parts.append(out[at:begin])
            run, at = out[begin:end], end
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    parts.append(run[:n])
                    run = run[n:]
                    break
                else:
                    parts.append("�".encode())
                    run = run[1:]
        return b"".join([*parts, out[at:]])


@cache
def model(path: str) -> Model:
    """One for each Python worker and model file."""
    return Model(path)


def encode(df: DataFrame, model_path: str, bos: bool = True, eos: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of PIECES: ids as little-endian 32-bit integers, and the source bytes begins[i]:ends[i] of piece i."""

    @tidy
    def run(batches):
        m = model(model_path)
        for batch in slices(batches, "text"):
            done = [m.encode(t, bos, eos) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x[0]) for x in done], pa.int64()), "ids": pa.array([x[0].tobytes() for x in done], pa.binary()),
                "begins": pa.array([x[1] for x in done], pa.list_(pa.int64())), "ends": pa.array([x[2] for x in done], pa.list_(pa.int64())),
            })

    return id_text(df, id_col, text_col).mapInArrow(run, PIECES)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows as encode() gives them; null ids give a null text."""

    @tidy
    def run(batches):
        m = model(model_path)
        for batch in batches:
            texts = [None if x is None else m.decode(np.frombuffer(x, "<u4")).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of DIGESTS: each text encoded with its spans and decoded again, in one pass without a shuffle.

    n_bytes is the source's; spans_sha256 is over all begins, then all ends, as little-endian 64-bit integers.
    """

    @tidy
    def run(batches):
        m = model(model_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, "text"):
            rows = []
            for t in batch.column("text").to_pylist():
                ids, begins, ends = m.encode(t)
                rows.append((len(ids), sha(ids.tobytes()), sha(m.decode(ids)), int(ends[-1]), sha(begins.astype("<i8").tobytes() + ends.astype("<i8").tobytes())))
            n, a, b, size, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": list(a), "decoded_sha256": list(b), "n_bytes": pa.array(size, pa.int64()), "spans_sha256": list(c)})

    return id_text(df, id_col, text_col).mapInArrow(run, DIGESTS)
