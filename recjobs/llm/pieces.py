"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised by longest prefix through the model's compiled character map, and by the model's
rule for blanks; for each byte of the result the source byte is recorded. The normalised text is
encoded by the same model without a normaliser, so every id comes from it, and each piece projects to
a byte span of the original. Merges never cross the start of a word or a line break, so a text is
encoded by segments that the library sees once and that are then remembered.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recjobs.llm.chunks import ChunkIds, counts_of, flat
from recjobs.llm.textvec import Texts, slices

SLICE_BYTES = 1 << 20  # of text at a time
BLANK = "▁"


class CharacterMap:
    """The compiled map: a double-array trie of source strings, and the strings they become."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest mapped prefix of ``data[at:]``: its length and what it becomes."""
        node, found = self._base(0), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    def _base(self, node: int) -> int:
        return node ^ self._offset(self.units[node])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def pieces(self, data: bytes, kept: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """``(start, length, result)`` of the prefixes taken in turn; strings in ``kept``, longest first,
        stay as they are, and so does a character without an entry."""
        at = 0
        while at < len(data):
            own = next((x for x in kept if data.startswith(x, at)), None)
            hit = (len(own), own) if own else self.longest(data, at) if self.units else None
            if hit is None:
                step = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = step, data[at : at + step]
            yield at, *hit
            at += hit[0]


class Normalizer:
    """A model's normalisation: its character map, and whether blanks around and between words go."""

    def __init__(self, charsmap: bytes, trim: bool, kept: list[bytes] = []):  # noqa: B006
        self.map, self.trim, self.kept = CharacterMap(charsmap), trim, sorted(kept, key=len, reverse=True)
        self.identity = not charsmap and not trim

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) its byte in the source."""
        data = text.encode()
        if self.identity:
            return data, np.arange(len(data) + 1)
        out, source, end = bytearray(), [], len(data)
        for at, _, result in self.map.pieces(data, self.kept):
            if self.trim and (not out or out.endswith(b" ")):  # no blank at the start or after a blank
                result = result.lstrip(b" ")
            out += result
            source += [at] * len(result)
        if self.trim:
            size = len(out.rstrip(b" "))
            end = source[size] if size < len(out) else end
            del out[size:], source[size:]
        return bytes(out), np.array([*source, end])


class PieceEncoder:
    """Needs a model that puts a blank before the text; pieces that hold a blank inside, or a line
    break, make it encode texts whole."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        own = [p.piece.replace(BLANK, " ").encode() for p in proto.pieces if p.type == p.USER_DEFINED]
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.remove_extra_whitespaces, own)
        self.prefix = spec.add_dummy_prefix
        # the model without its normaliser: texts come normalised
        spec.precompiled_charsmap, spec.remove_extra_whitespaces = b"", False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_segment = self.prefix and not own and not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.end, self.unknown = self.model.eos_id(), self.model.unk_id()
        # bytes of the normalised text that a piece stands for
        self.widths = np.array([0 if self.model.is_control(i) else 1 if self.model.is_byte(i) else len(p.replace(BLANK, " ").encode()) for i, p in enumerate(pieces)])
        self.names = pa.array([str(i) for i in range(len(pieces))])
        self.segments = ChunkIds(self._learn)

    def normalize(self, texts: pa.Array) -> tuple[pa.Array, list[np.ndarray] | None]:
        """The normalised texts, and the source byte of each of their bytes (None: their own)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.normalizer.identity:
            return texts, None
        found = [self.normalizer.normalize(t) for t in texts.to_pylist()]
        return pa.array([d.decode() for d, _ in found], pa.large_string()), [s for _, s in found]

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the model puts one blank before each text; a segment after a line break has none
        cut = [s[0] != " " for s in segments]
        out = []
        for a in range(0, len(segments), 10_000):
            part = list(zip(segments[a : a + 10_000], cut[a : a + 10_000]))
            found = self.model.encode(["\n" + s if c else s[1:] for s, c in part], num_threads=1)
            out += [ids[2:] if c else ids if s != " " else self.model.encode(BLANK + "a")[:1] for (s, c), ids in zip(part, found)]
        return flat(out)

    def _by_segment(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = Texts(texts)
        some = plain.offsets[:-1] < plain.offsets[1:]
        data = np.insert(plain.bytes, plain.offsets[:-1][some], 32)
        offsets = plain.offsets + np.concatenate([[0], np.cumsum(some)])
        # a segment is a word with the blanks before it, blanks before a line's end, or a line break
        start = np.zeros(len(data) + 1, bool)
        blank, line = data == 32, data == 10
        start[:-1] = line
        start[1:] |= line
        start[1:-1] |= blank[1:] & ~blank[:-1]
        start[offsets] = True
        at = np.flatnonzero(start)
        cut = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        numbered = cut.dictionary_encode()
        ids, n = self.segments.gather(numbered.dictionary.to_pylist(), numbered.indices.to_numpy())
        return ids, counts_of(n, np.searchsorted(at, offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts one after the other, each text's with the end id, and their counts."""
        whole = np.ones(len(texts), bool) if not self.by_segment else pc.match_substring(texts, BLANK).to_numpy(zero_copy_only=False)
        ids, counts = self._by_segment(pc.if_else(pa.array(whole), "", texts)) if not whole.all() else (np.empty(0, np.uint32), np.zeros(len(texts), np.int64))
        rows = np.flatnonzero(whole)
        found = self.model.encode([texts[i].as_py() for i in rows.tolist()], num_threads=1) if len(rows) else []
        at = np.cumsum(counts)[rows]
        ids = np.insert(ids, np.repeat(at, [len(x) for x in found]), np.array([i for x in found for i in x], np.uint32))
        counts[rows] = [len(x) for x in found]
        return np.insert(ids, np.cumsum(counts), np.uint32(self.end)), counts + 1

    def spans(self, texts: pa.Array, sources: list[np.ndarray] | None, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the bytes of the original text that it stands for: starts and ends.

        The blank before the text, and the end id, stand for no byte. ``texts`` are normalised.
        """
        size = np.diff(Texts(texts).offsets)
        last = np.cumsum(counts)
        width = self.widths[ids]
        ends = np.cumsum(width)
        base = np.concatenate([[0], ends[last - 1]])[:-1]
        ahead = self.prefix * (size > 0)
        ends = ends - np.repeat(base + ahead, counts)
        starts, ends = np.maximum(ends - width, 0), np.maximum(ends, 0)
        told = pc.match_substring(texts, BLANK).to_numpy(zero_copy_only=False)
        if self.unknown >= 0 and (ids == self.unknown).any():
            told = told | np.isin(np.arange(len(texts)), np.repeat(np.arange(len(texts)), counts)[ids == self.unknown])
        if (ends[last - 1] != size)[~told].any():
            raise ValueError("pieces don't cover the text")
        for i in np.flatnonzero(told).tolist():  # blank marks of the text's own, or pieces of unknown width
            text = texts[i].as_py()
            at = np.cumsum([0, *(len(c.encode()) for c in text)])  # the library counts characters
            found = self.model.encode(text, return_type="proto").pieces
            part = slice(last[i] - counts[i], last[i])
            starts[part], ends[part] = [*at[[p.begin for p in found]], size[i]], [*at[[p.end for p in found]], size[i]]
        if sources is not None:
            source = np.concatenate([np.empty(0, np.int64), *sources])
            shift = np.repeat(np.cumsum(size + 1) - size - 1, counts)
            starts, ends = source[starts + shift], source[ends + shift]
        return starts, ends


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker: the tasks that a worker runs in turn share what is remembered."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, starts array<int>, ends array<int>)``: ids with byte spans.

    A null text counts as empty: the end id alone. Repeated rows give equal results, other columns
    are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                texts, sources = encoder.normalize(part.column(1))
                ids, counts = encoder.encode(texts)
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (ids, *encoder.spans(texts, sources, ids, counts)))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "ids", "starts", "ends"])
            pa.default_memory_pool().release_unused()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``encode_pieces`` and of the decoded text, without moving the ids out of the task:
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes)``, the last being the bytes that the
    spans cover. Nulls, empty texts, repeated rows and other columns as in ``encode_pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                texts, sources = encoder.normalize(part.column(1))
                ids, counts = encoder.encode(texts)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                told = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), encoder.names.take(pa.array(ids))), " ").cast(pa.large_binary()).to_pylist()
                every = ids.tolist()
                decoded = encoder.model.decode([every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], num_threads=1)
                covered = np.maximum.reduceat(encoder.spans(texts, sources, ids, counts)[1], cuts[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(map(sha, told)), pa.array([sha(t.encode()) for t in decoded]), pa.array(covered)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])
            pa.default_memory_pool().release_unused()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
