"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie followed by
replacement strings); every normalised byte remembers the original byte it came from. The normalised text is cut into
units before each run of the blank symbol. No piece of the vocabulary has a blank symbol after another character (this
is checked on loading; else a text is one unit), so no merge crosses a cut and units are encoded apart: each distinct
unit once per worker, by the library. Piece lengths then give spans in the normalised text, and the alignment
projects them to spans of original UTF-8 bytes.

Null texts are empty; an empty text has the end id only. Rows are independent: repeated rows, and texts of any length,
give one result row each. Columns other than id and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANK = "\u2581"
#: Distinct units that a worker keeps; the cache starts anew beyond.
CACHE_UNITS = 500_000
#: Text bytes of an output batch.
OUT_BYTES = 1 << 20
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharsMap:
    """The compiled character map: uint32 size of the trie, the trie's units, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``text`` has at ``at``."""
        trie, best = self.trie, None
        if not trie:
            return None
        node = (trie[0] >> 10) << ((trie[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(trie):
                break
            unit = trie[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (trie[node] & 0x7FFFFFFF, i + 1 - at)
        return best and (self.strings[best[0] : self.strings.index(b"\0", best[0])], best[1])


class Codec:
    def __init__(self, model_path: str, end_id: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        self.spec = model.normalizer_spec
        self.chars = CharsMap(self.spec.precompiled_charsmap)
        kinds = type(model.SentencePiece())
        self.user = sorted((p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.apart = not any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)) and not model.trainer_spec.treat_whitespace_as_suffix
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int32)
        self.unknown = [i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN] if not model.trainer_spec.byte_fallback else []
        self.end = [self.lib.eos_id()] if end_id else []
        self.plain = not self.chars.trie and not self.user and self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces
        self.alone = self.lib.encode("a ")[len(self.lib.encode("a")) :]
        self.cache: dict[str, bytes] = {}  # of a unit: pairs of id and length in normalised bytes

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for the end, the original byte offset."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, dtype=np.int32)
        blank = BLANK.encode() if self.spec.escape_whitespaces else b" "
        if self.plain:
            given = np.frombuffer(raw, dtype=np.uint8)
            at = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(given == 32, len(blank), 1))
            return blank + raw.replace(b" ", blank), np.concatenate([np.zeros(len(blank), np.int32), at, np.full(1, len(raw), np.int32)])
        out, at, pos, squeeze = bytearray(), [], 0, self.spec.remove_extra_whitespaces
        blank_before = squeeze
        while pos < len(raw):
            piece, used = self._prefix(raw, pos)
            if blank_before:
                piece = piece.lstrip(b" ")
            if piece:
                if not at and self.spec.add_dummy_prefix:
                    out += blank
                    at += [pos] * len(blank)
                blank_before = squeeze and piece.endswith(b" ")
                piece = piece.replace(b" ", blank)
                out += piece
                at += [pos] * len(piece)
            pos += used
        end = len(raw)
        if squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                end = at[len(out)]
                del at[len(out) :]
        return bytes(out), np.array([*at, end], dtype=np.int32)

    def _prefix(self, raw: bytes, pos: int) -> tuple[bytes, int]:
        for symbol in self.user:
            if raw.startswith(symbol, pos):
                return symbol, len(symbol)
        found = self.chars.longest(raw, pos)
        if found:
            return found
        first = raw[pos]
        used = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return raw[pos : pos + used], used

    def _units(self, normalized: str) -> list[str]:
        if not self.apart:
            return [normalized]
        return re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", normalized)

    def _learn(self, needed: set[str]) -> None:
        """Puts into the cache those of the units that it lacks; a full cache starts anew with just these."""
        missing = needed - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE_UNITS:
            self.cache.clear()
            missing = needed
        order = list(missing)
        lead = 1 if self.spec.add_dummy_prefix else 0
        found = self.lib.encode([u.replace(BLANK, " ")[lead:] for u in order], num_threads=1)
        if BLANK in missing:  # the library takes a lone leading blank for no text
            found[order.index(BLANK)] = self.alone
        flat = np.fromiter(chain.from_iterable(found), dtype="<i4")
        spans = self.lengths[flat].astype("<i4")
        stops = np.cumsum([len(ids) for ids in found])
        starts = stops - [len(ids) for ids in found]
        if self.unknown:  # an unknown piece is as long as what the unit's other pieces leave
            for k in np.unique(np.searchsorted(stops, np.flatnonzero(np.isin(flat, self.unknown)), side="right")):
                here = slice(starts[k], stops[k])
                odd = np.flatnonzero(np.isin(flat[here], self.unknown))
                spans[here][odd] = 0
                spans[starts[k] + odd[0]] = len(order[k].encode()) - spans[here].sum()
        packed = np.stack([flat, spans], axis=1).tobytes()
        self.cache.update(zip(order, [packed[a:b] for a, b in zip((starts * 8).tolist(), (stops * 8).tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text; the end id spans nothing."""
        ready = []
        for text in texts:
            if self.plain and self.apart and "  " not in text and BLANK not in text and text[:1] != " ":
                ready.append(((BLANK + text.replace(" ", f" {BLANK}")).split(" ") if text else [], None))
            else:
                normalized, at = self.normalize(text)
                ready.append((self._units(normalized.decode(errors="replace")), at))
        self._learn(set().union(*[units for units, _ in ready]))
        for text, (units, at) in zip(texts, ready, strict=True):
            found = np.frombuffer(b"".join([self.cache[u] for u in units]), dtype="<i4")
            ids, stops = found[::2], np.concatenate([[0], np.cumsum(found[1::2])])
            if at is None:
                at = self.normalize(text)[1]
            places = at[stops]
            last = [len(text.encode())] * len(self.end)
            yield np.concatenate([ids, self.end]).astype(np.int32), np.concatenate([places[:-1], last]).astype(np.int32), np.concatenate([places[1:], last]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


_CODECS: dict[tuple[str, bool], Codec] = {}


def codec(model_path: str, end_id: bool = True) -> Codec:
    """The worker's codec, loaded once."""
    if (model_path, end_id) not in _CODECS:
        _CODECS[model_path, end_id] = Codec(model_path, end_id)
    return _CODECS[model_path, end_id]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), type=pa.int32()))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True) -> DataFrame:
    """doc_id, ids, begins, ends (original UTF-8 byte spans of the ids), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, end_id)
        for batch in common.slices(batches, OUT_BYTES):
            rows = list(own.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists([r[k] for r in rows]) for k in range(3)), pa.array([own.decode(r[0]) for r in rows], type=pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    out = encode_decode(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("n_bytes"),
    )
