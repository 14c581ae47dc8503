"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is the score-ordered agenda of adjacent symbol pairs: of all adjacent pairs
whose concatenation is a piece, the best score (leftmost on ties) merges first, until
none is left; characters outside the vocabulary become byte pieces.

A text falls apart where no piece can reach across: if no piece holds a word mark after
another character (checked when the model is loaded), every run "marks + word" is encoded
on its own. The distinct words of an Arrow batch go through the agenda together, one pop
per word and round, in numpy. Every word that was not met before is checked against the
sentencepiece library, and a difference stops the job.

Defined cases: null text counts as empty; an empty text has only the begin and end ids and
decodes to the empty string; rows, repeated or not, keep their multiplicity; columns of the
input named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructType
from sentencepiece import sentencepiece_model_pb2

from visitframe.llm.common import text_slices

MARK = "▁"
#: Codes of symbols that are no piece: this plus the code point.
LOOSE = 1 << 17
NO_PAIR = np.int32(2**31 - 1)
#: Words longer than this take the one-word agenda with a heap.
LONG_WORD = 40
#: Words a Python worker remembers; beyond it the memory is emptied.
WORDS_KEPT = 150_000


class PieceModel:
    """A merge-type model; `proto` is the content of its file."""

    def __init__(self, proto: bytes):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models without text normalisation and with a word mark in front are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.byte_ids = [-1] * 256
        self.ids: dict[str, int] = {}
        self.is_byte = np.zeros(len(spec.pieces), bool)
        self.is_control = np.zeros(len(spec.pieces), bool)
        self.surface: list[bytes] = []
        scores: dict[int, float] = {}
        for i, p in enumerate(spec.pieces):
            text = b""
            if p.type == kinds.NORMAL:
                self.ids[p.piece] = i
                scores[i] = p.score
                text = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                text = bytes([value])
            elif p.type == kinds.UNKNOWN:
                text = spec.trainer_spec.unk_surface.encode()
            else:
                self.is_control[i] = True
            self.surface.append(text)
        self.byte_fallback = min(self.byte_ids) >= 0
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: (left code, right code) -> (rank, merged id); every way to cut a piece in two symbols.
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                left, right = self._code(text[:k]), self._code(text[k:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (order[scores[i]], i)
        self.splits = not any(b == MARK and a != MARK for t in self.ids for a, b in zip(t, t[1:], strict=False))
        self._fill_tables()

    def _code(self, symbol: str) -> int | None:
        if symbol in self.ids:
            return self.ids[symbol]
        return LOOSE + ord(symbol) if len(symbol) == 1 else None

    def _fill_tables(self) -> None:
        self.char_code = np.arange(LOOSE, LOOSE + 0x110000, dtype=np.int64)
        for text, i in self.ids.items():
            if len(text) == 1:
                self.char_code[ord(text)] = i
        bits = max(4, int(np.ceil(np.log2(len(self.pairs) * 4 + 16))))
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NO_PAIR, np.int32)
        self.slot_id = np.zeros(1 << bits, np.int64)
        last = (1 << bits) - 1
        for (left, right), (rank, merged) in self.pairs.items():
            key = left << 21 | right
            at = int(self._slots(np.array([key], np.int64))[0])
            while self.slot_key[at] != -1:
                at = at + 1 & last
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, rank, merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_PAIR where the two are no piece."""
        shape = left.shape
        key = (left << 21 | right).ravel()
        at = self._slots(key)
        got = self.slot_key[at]
        on = np.flatnonzero((got != key) & (got != -1))
        while len(on):
            at[on] = at[on] + 1 & len(self.slot_key) - 1
            now = self.slot_key[at[on]]
            on = on[(now != key[on]) & (now != -1)]
        hit = self.slot_key[at] == key
        return np.where(hit, self.slot_rank[at], NO_PAIR).reshape(shape), self.slot_id[at].reshape(shape)

    def _to_ids(self, codes: list[int]) -> list[int]:
        out: list[int] = []
        for c in codes:
            if c < LOOSE:
                out.append(c)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in chr(c - LOOSE).encode()]
            else:
                out.append(self.unk)
        return out

    def agenda(self, word: str) -> list[int]:
        """Ids of one word (marks in place): a heap of adjacent pairs over a linked list."""
        codes = [int(self.char_code[ord(c)]) for c in word]
        n = len(codes)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def propose(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (found := self.pairs.get((codes[i], codes[j]))):
                heapq.heappush(heap, (found[0], i, codes[i], codes[j], found[1]))

        for i in range(n - 1):
            propose(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or codes[i] != left or codes[j] != right:
                continue  # one of the two was merged meanwhile
            codes[i], alive[j], after[i] = merged, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(before[i])
            propose(i)
        return self._to_ids([c for c, a in zip(codes, alive, strict=True) if a])

    def words(self, distinct: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(distinct)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(distinct):
            by_length.setdefault(len(w), []).append(i)
        for length, members in by_length.items():
            if length > LONG_WORD:
                for i in members:
                    out[i] = np.array(self.agenda(distinct[i]), "<u4").tobytes()
                continue
            text = "".join([distinct[i] for i in members])
            codes = self.char_code[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(-1, length)
            self._merge_rows(codes, np.array(members), out)
        return out

    def _merge_rows(self, codes: np.ndarray, at: np.ndarray, out: list[bytes]) -> None:
        """One agenda per row, all rows one merge at a time."""

        def leave(rows: np.ndarray, where: np.ndarray) -> None:
            loose = (rows >= LOOSE).any(axis=1)
            flat, width = rows.astype("<u4").tobytes(), rows.shape[1] * 4
            for k, (i, odd) in enumerate(zip(where.tolist(), loose.tolist(), strict=True)):
                out[i] = (
                    np.array(self._to_ids(rows[k].tolist()), "<u4").tobytes() if odd else flat[k * width : (k + 1) * width]
                )

        if codes.shape[1] == 1:
            return leave(codes, at)
        rank, merged = self._look_up(codes[:, :-1], codes[:, 1:])
        while len(at):
            j = rank.argmin(axis=1)
            row = np.arange(len(at))
            live = rank[row, j] != NO_PAIR
            if not live.all():
                leave(codes[~live], at[~live])
                codes, rank, merged, at, j = codes[live], rank[live], merged[live], at[live], j[live]
                row = np.arange(len(at))
                if not len(at):
                    return
            n, width = codes.shape
            codes[row, j] = merged[row, j]
            keep = np.ones((n, width), bool)
            keep[row, j + 1] = False
            codes = codes[keep].reshape(n, width - 1)
            if width == 2:
                return leave(codes, at)
            keep = np.ones((n, width - 1), bool)
            keep[row, j] = False
            rank, merged = rank[keep].reshape(n, width - 2), merged[keep].reshape(n, width - 2)
            for side in (j - 1, j):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                c = side[ok]
                rank[ok, c], merged[ok, c] = self._look_up(codes[ok, c], codes[ok, c + 1])

    def check(self, distinct: list[str], got: list[bytes]) -> None:
        """Hold words against the library; they are told to it without their first mark."""
        plain = [w[1:].replace(MARK, " ") for w in distinct]
        for w, ids, mine in zip(distinct, self.library.encode(plain, num_threads=1), got, strict=True):
            if w != MARK and np.array(ids, "<u4").tobytes() != mine:
                raise AssertionError(f"{w!r}: the library has {ids}, the agenda {np.frombuffer(mine, '<u4').tolist()}")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: controls vanish, one leading space goes, byte runs become UTF-8."""
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        surface = self.surface
        parts = [surface[i] for i in ids.tolist()]
        if not self.is_byte[ids[0]] and ids[0] != self.unk and parts[0][:1] == b" ":
            parts[0] = parts[0][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids, parts)

    def _decode_bytes(self, ids: np.ndarray, parts: list[bytes]) -> str:
        out, held = [], b""
        for i, part in zip(ids.tolist(), parts, strict=True):
            if self.is_byte[i]:
                held += part
                continue
            out += [_lenient(held), part.decode()]
            held = b""
        return "".join([*out, _lenient(held)])


def _lenient(data: bytes) -> str:
    """UTF-8 where whole characters stand, U+FFFD for every other byte."""
    out = []
    while data:
        for n in (1, 2, 3, 4):
            try:
                out.append(data[:n].decode())
                data = data[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            data = data[1:]
    return "".join(out)


_loaded: dict[int, tuple[PieceModel, dict[str, bytes]]] = {}


def _model(proto: bytes) -> tuple[PieceModel, dict[str, bytes]]:
    """The worker's model and the words it remembers; a worker serves many tasks."""
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (PieceModel(proto), {})
    return _loaded[key]


def encode_texts(model: PieceModel, known: dict[str, bytes], texts: list[str]) -> list[bytes]:
    """Ids of each text between the begin and end ids, as little-endian unsigned 32-bit."""
    head, tail = np.array([model.bos], "<u4").tobytes(), np.array([model.eos], "<u4").tobytes()
    find = re.compile(f"{MARK}+[^{MARK}]*").findall
    cut = [
        [] if not t else find(MARK + t.replace(" ", MARK)) if model.splits else [MARK + t.replace(" ", MARK)]
        for t in texts
    ]
    fresh = list({w for ws in cut for w in ws if w not in known})
    if fresh:
        if len(known) + len(fresh) > WORDS_KEPT:
            known.clear()
            fresh = list({w for ws in cut for w in ws})
        got = model.words(fresh)
        model.check(fresh, got)
        known.update(zip(fresh, got, strict=True))
    return [head + b"".join([known[w] for w in ws]) + tail for ws in cut]


def encode_and_decode(docs: DataFrame, proto: bytes, text: str = "text") -> DataFrame:
    """docs plus `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string).

    Every whole text is encoded with begin and end ids and decoded again. The model's bytes
    travel with the job as a broadcast variable: their size is the vocabulary file's, it
    doesn't grow with the data. `text` itself isn't carried along.
    """
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    carried = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    n = len(kept)
    schema = StructType(carried.schema.fields[:n]).add("ids", BinaryType()).add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(shared.value)
        for whole in batches:
            for batch in text_slices(whole, n):
                coded = encode_texts(model, known, [t or "" for t in batch.column(n).to_pylist()])
                decoded = [model.decode(np.frombuffer(c, "<u4").astype(np.int64)) for c in coded]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array(coded, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*kept, "ids", "decoded"],
                )

    return carried.mapInArrow(run, schema)
