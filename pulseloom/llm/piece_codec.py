"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalisation is done here, by longest-prefix matching against the model's compiled character map
(a double-array trie over UTF-8 bytes), and records for every normalised byte which source bytes
it stands for.  The trie is walked from every byte that can begin an entry; what lies between stays as it is, so
a model whose map is empty, as some are, has no walks but takes the same path.  The library then segments the already normalised text, with a copy of the model
whose own normaliser is switched off, and each piece is projected through the record to a span of
source bytes.

Null texts count as empty; an empty text has only the begin and end ids.  Texts are never cut.  Repeated rows are
encoded alike, each as a row of its own; an empty table gives an empty result; columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseloom.llm.words import slices

SPACE_MARK = "▁".encode()


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int, int, int]]:
    """(field number, wire type, value, begin, end) of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        begin = at
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, kind, value, begin, at


def _put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


@dataclass(frozen=True)
class Rules:
    """A model's normaliser settings."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False
    own_symbols: tuple[bytes, ...] = ()


class CharMap:
    """The compiled character map: a double-array trie whose values point at zero-ended replacements."""

    def __init__(self, blob: bytes):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]
        else:
            self.units, self.replacements = [], b""
        root = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) if self.units else 0
        self.begins = np.array([root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b for b in range(256)])

    def longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement) of the longest entry that starts at raw[at]; (0, 0) if none."""
        units, best = self.units, (0, 0)
        if not units:
            return best
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(raw)):
            byte = raw[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, place: int) -> bytes:
        return self.replacements[place : self.replacements.index(0, place)]


def _width(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


@dataclass
class Aligned:
    """Normalised bytes; source[i] is the source byte at which normalised byte i's stretch begins, source[-1] the end."""

    data: bytes
    source: np.ndarray


@dataclass
class Normalizer:
    rules: Rules
    map: CharMap = field(init=False)

    def __post_init__(self):
        self.map = CharMap(self.rules.charsmap)
        self._own = sorted(self.rules.own_symbols, key=len, reverse=True)

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self._own:
            if raw.startswith(symbol, at):
                return symbol, len(symbol)
        n, place = self.map.longest(raw, at)
        if n:
            return self.map.replacement(place), n
        n = min(_width(raw[at]), len(raw) - at)
        return raw[at : at + n], n

    def __call__(self, raw: bytes) -> Aligned:
        rules = self.rules
        if not raw:
            return Aligned(b"", np.zeros(1, np.int64))
        if rules.trim_spaces or self._own or rules.space_suffix:
            return self._by_prefix(raw)
        return self._by_jumps(raw)

    def _by_jumps(self, raw: bytes) -> Aligned:
        """Where no rule looks at what came before: entries of the map are sought only where a byte can begin one."""
        bytes_, mark = np.frombuffer(raw, np.uint8), SPACE_MARK if self.rules.escape_spaces else b" "
        # an entry begins at a character's first byte only
        places = np.flatnonzero(self.map.begins[bytes_] & (bytes_ & 0xC0 != 0x80))
        parts, sources, at = [], [], 0

        def put(piece: bytes, source: np.ndarray) -> None:
            wide = np.where(np.frombuffer(piece, np.uint8) == 32, len(mark), 1)
            parts.append(piece.replace(b" ", mark))
            sources.append(np.repeat(source, wide))

        if self.rules.dummy_prefix:
            parts.append(mark)
            sources.append(np.zeros(len(mark), np.int64))
        for place in places.tolist():
            n, found = self.map.longest(raw, place) if place >= at else (0, 0)
            if n:
                put(raw[at:place], np.arange(at, place))
                new = self.map.replacement(found)
                put(new, np.arange(place, place + n) if new == raw[place : place + n] else np.full(len(new), place))
                at = place + n
        put(raw[at:], np.arange(at, len(raw)))
        return Aligned(b"".join(parts), np.append(np.concatenate(sources), len(raw)))

    def _by_prefix(self, raw: bytes) -> Aligned:
        rules = self.rules
        mark = SPACE_MARK if rules.escape_spaces else b" "
        at = 0
        if rules.trim_spaces:
            while at < len(raw):
                new, n = self._step(raw, at)
                if new != b" ":
                    break
                at += n
            if at == len(raw):
                return Aligned(b"", np.full(1, len(raw), np.int64))
        out, source = bytearray(), []

        def put(piece: bytes, place: int) -> None:
            out.extend(piece)
            source.extend([place] * len(piece))

        if rules.dummy_prefix and not rules.space_suffix:
            put(mark, at)
        was_space = rules.trim_spaces
        while at < len(raw):
            new, n = self._step(raw, at)
            own = new == raw[at : at + n]  # then every byte stands for itself
            if was_space and rules.trim_spaces:
                new = new.lstrip(b" ")
            if new:
                for k, byte in enumerate(new):
                    put(mark if byte == 32 else bytes([byte]), at + k * own)
                was_space = new.endswith(b" ")
            at += n
            if not rules.trim_spaces:
                was_space = False
        end = len(raw)
        if rules.trim_spaces:
            while out.endswith(mark) and out:
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        if rules.dummy_prefix and rules.space_suffix:
            put(mark, end)
        return Aligned(bytes(out), np.array([*source, end], np.int64))


@dataclass
class Encoded:
    """Ids with begin and end ids; spans[k] is the source byte range of ids[k] (empty for begin and end)."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            raw = f.read()
        pieces, own, spec, kept = [], [], {}, []
        for number, _, value, begin, end in _fields(raw):
            if number == 1:
                entry = {n: v for n, _, v, _, _ in _fields(value)}
                pieces.append((entry.get(1, b""), entry.get(3, 1)))
                if entry.get(3, 1) == 4:
                    own.append(entry[1])
            if number == 3:
                spec = {n: v for n, _, v, _, _ in _fields(value)}
            else:
                kept.append(raw[begin:end])
            if number == 2:
                suffix = {n: v for n, _, v, _, _ in _fields(value)}.get(24, 0)
        self.rules = Rules(bytes(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(suffix), tuple(own))
        self.normalize = Normalizer(self.rules)
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        plain = b"".join(kept) + b"\x1a" + _put_varint(len(off)) + off
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=plain)
        self.width = np.array([1 if kind == 6 else len(piece) for piece, kind in pieces], np.int64)
        self.unknown = self.library.unk_id()
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()

    def encode(self, texts: list[str]) -> list[Encoded]:
        aligned = [self.normalize(t.encode()) for t in texts]
        found = self.segmenter.encode([a.data.decode() for a in aligned], num_threads=1)
        return [self._project(a, ids) for a, ids in zip(aligned, found, strict=True)]

    def _project(self, aligned: Aligned, found: list[int]) -> Encoded:
        ids = np.array(found, np.int64)
        if self.unknown in found:  # only without byte fallback
            proto = self.segmenter.encode(aligned.data.decode(), return_type="proto")
            stop = np.cumsum([len(p.surface.encode()) for p in proto.pieces])
        else:
            stop = np.cumsum(self.width[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(stop) and stop[-1] != len(aligned.data):
            raise ValueError("pieces don't cover the normalised text")
        begin, end = aligned.source[np.concatenate([[0], stop[:-1]]).astype(np.int64)] if len(stop) else stop, aligned.source[stop]
        size = int(aligned.source[-1])
        return Encoded(np.concatenate([[self.bos], ids, [self.eos]]).astype(np.int64), np.concatenate([[0], begin, [size]]), np.concatenate([[0], end, [size]]))

    def decode(self, ids) -> str:
        return self.library.decode([int(i) for i in ids])


@lru_cache(maxsize=4)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = batch.column(column)
    for low, high in slices(texts, 1 << 20):
        yield batch.slice(low, high - low), [t or "" for t in texts.slice(low, high - low).to_pylist()]


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, and begins, ends array<int>: the source bytes of each id."""

    def run(batches):
        for batch in batches:
            for part, texts in _texts(batch, text_col):
                rows = codec(model_file).encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array([getattr(r, k) for r in rows], pa.list_(pa.int32())) for k in ("ids", "begin", "end"))], [id_col, "ids", "begins", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded text (null ids: empty)."""

    def run(batches):
        for batch in batches:
            texts = [codec(model_file).decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps counts and digests, with the digest of all spans."""

    def run(batches):
        for batch in batches:
            for part, texts in _texts(batch, text_col):
                own, out = codec(model_file), []
                rows = own.encode(texts)
                for r, back in zip(rows, own.library.decode([r.ids.tolist() for r in rows]), strict=True):
                    spans = np.stack([r.begin, r.end], 1).astype("<i8").tobytes()
                    out.append((len(r.ids), hashlib.sha256(r.ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(spans).hexdigest(), int(r.end[-1])))
                n, ids, decoded, spans, size = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(spans), pa.array(size, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_bytes long")
