"""Encoding and decoding with merge-type (BPE) piece vocabularies: a score-ordered agenda of adjacent symbol pairs,
checked against the sentencepiece library in Arrow batches.

A text is normalised as the model says and cut where no piece can reach over: before a space mark that follows
another character, and around characters that only stand alone. What is left between cuts is short and repeats, so
a batch looks at its distinct cuts, and a worker merges those it doesn't remember: short ones together, each round
taking the best pair of every cut off the agenda, long ones by a heap, in time n log n. The library encodes each
cut that a worker merges, and decodes each text's ids; on request it encodes each whole text too.

Cases: null text is empty and has no ids; texts of spaces only, control characters, zero characters and characters
out of the vocabulary (their bytes, or the unknown piece where the vocabulary has no bytes) encode as the library
has them; very long texts are encoded whole; repeated rows are encoded as often as they stand; an empty table gives
no rows; of the table only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, small_batches

SPACE = "▁"
#: Bytes of remembered cuts (text and ids) at which a worker puts them aside for a new lot (the lot before that goes), and the longest cut that is remembered.
REMEMBERED_BYTES, LONGEST_REMEMBERED = 80 << 20, 48
#: About what a remembered cut takes besides its letters and ids.
_ENTRY = 160
# Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
_NONE = (1 << 62) - 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tallyfold-one-byte", _one_byte)


class PieceModel:
    """A merge-type vocabulary, read from its model file. Refuses what it couldn't follow exactly: other kinds of models, tables of character rewrites, user-defined and unused pieces, spaces as suffixes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            said = list(_fields(f.read()))
        trainer = dict(_fields(next((v for n, v in said if n == 2), b"")))
        rules = dict(_fields(next((v for n, v in said if n == 3), b"")))
        # Field numbers, and what a field that isn't there means.
        self.byte_fallback, self.prefix = bool(trainer.get(35, 0)), bool(rules.get(3, 1))
        self.squeeze, escaped = bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ")
        pieces = [dict(_fields(v)) for n, v in said if n == 1]
        self.text = [p[1].decode() for p in pieces]
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != MERGES or rules.get(2) or not escaped or trainer.get(24, 0) or {USER, UNUSED} & set(self.kind):
            raise ValueError(f"{path}: not a plain merge-type vocabulary")
        self.known = {t: (-score[i], i) for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.unknown = self.kind.index(UNKNOWN)
        of_byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.byte_ids = [of_byte.get(b, self.unknown) for b in range(256)]
        self._agenda_tables(score)
        self.remembered: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.room = REMEMBERED_BYTES
        self.controls = {i for i, k in enumerate(self.kind) if k == CONTROL}
        self.bytes_of = [self._bytes(i) for i in range(len(self.text))]

    def _agenda_tables(self, score: list[float]) -> None:
        """Symbols are pieces, then characters of pieces that aren't pieces, then one that stands for all other characters. Of each character its symbol, and whether it stands alone (0), joins others (1) or is the space mark (2); of each pair of symbols that makes a piece its rank by score and the piece."""
        longer = [t for t in self.known if len(t) > 1]
        symbol = {t: i for t, (_, i) in self.known.items()}
        chars = sorted({c for t in longer for c in t})
        symbol |= {c: len(self.text) + k for k, c in enumerate(c for c in chars if c not in symbol)}
        self.other = len(self.text) + len(chars)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        single = [c for c in symbol if len(c) == 1]
        self.symbol_of[[ord(c) for c in single]] = [symbol[c] for c in single]
        self.class_of = np.zeros(0x110000, np.uint8)
        if not self.byte_fallback or any(SPACE in t.lstrip(SPACE) for t in longer):
            self.class_of[:] = 1  # unknown characters in a row are one piece, or pieces reach over spaces: nothing is cut
        else:
            self.class_of[[ord(c) for c in chars]] = 1
            self.class_of[ord(SPACE)] = 2
        rank = np.unique([-x for x in score], return_inverse=True)[1]
        made = [(symbol[t[:k]] * (self.other + 1) + symbol[t[k:]], int(rank[i]), i) for t, i in ((t, self.known[t][1]) for t in longer) for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol]
        self.pairs, self.pair_rank, self.pair_piece = np.array(sorted(made), np.int64).reshape(-1, 3).T.copy()

    def _bytes(self, i: int) -> bytes:
        kind, text = self.kind[i], self.text[i]
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return b"" if kind == CONTROL else self.unknown_text if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.replace(SPACE, " ").split(" ") if x)
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[int]:
        """Ids of a normalised text. The agenda holds adjacent pairs that make a piece, the highest score first, of equal ones the leftmost; a pair that has changed since is skipped."""
        known = self.known
        symbols = list(text)
        before, behind = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = [(found[0], i, i + 1, 2) for i in range(len(symbols) - 1) if (found := known.get(symbols[i] + symbols[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            nxt = behind[left] = behind[right]
            if nxt >= 0:
                before[nxt] = left
            for a, b in ((before[left], left), (left, nxt)):
                if a >= 0 and b >= 0 and (found := known.get(symbols[a] + symbols[b])):
                    heapq.heappush(agenda, (found[0], a, b, len(symbols[a]) + len(symbols[b])))
        ids: list[int] = []
        after_unknown = False
        for s in symbols:
            if not s:
                continue
            found = known.get(s)
            if found:
                ids.append(found[1])
            elif self.byte_fallback:
                ids += (self.byte_ids[b] for b in s.encode())
            elif not after_unknown:
                ids.append(self.unknown)
            after_unknown = not found
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for pairs that make no piece, in the upper half; where the piece stands in the table in the lower."""
        key = left.astype(np.int64) * (self.other + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        return np.where(self.pairs[at] == key, self.pair_rank[at] << 32 | at, _NONE) if len(self.pairs) else np.full(len(key), _NONE)

    def merged_together(self, cuts: list[str]) -> list[bytes]:
        """Ids of many short cuts. The agenda is an array of ranks of adjacent pairs; a round takes the best pair of each cut, the leftmost of equal ones."""
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")
        of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        symbols = self.symbol_of[points]
        plain = np.bincount(of[symbols >= len(self.text)], minlength=len(cuts)) == 0
        symbols, of = symbols[plain[of]], of[plain[of]]
        out = [b""] * len(cuts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = np.array(self.merged(cuts[i]), "<i4").tobytes()
        done_symbols, done_of = [], []
        ranks = np.append(np.where(of[1:] == of[:-1], self._ranks(symbols[:-1], symbols[1:]), _NONE), _NONE) if len(of) else np.zeros(0, np.int64)
        while len(of):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            size = np.diff(np.append(first, len(of)))
            best = np.minimum.reduceat(ranks >> 32, first)
            over = np.repeat(best == _NONE >> 32, size)
            done_symbols.append(symbols[over])
            done_of.append(of[over])
            here = np.flatnonzero((ranks >> 32 == np.repeat(best, size)) & ~over)
            if not len(here):
                break
            here = here[np.append(True, of[here[1:]] != of[here[:-1]])]
            symbols[here] = self.pair_piece[ranks[here] & 0xFFFFFFFF]
            keep = ~over
            keep[here + 1] = False
            place = np.cumsum(keep) - 1
            symbols, of, ranks, here = symbols[keep], of[keep], ranks[keep], place[here]
            # The pairs left and right of a merged one are ranked anew.
            for left in (here - 1, here):
                left = left[(left >= 0) & (left < len(of))]
                right = np.minimum(left + 1, len(of) - 1)
                same = (of[left] == of[right]) & (right > left)
                ranks[left] = np.where(same, self._ranks(symbols[left], symbols[right]), _NONE)
        symbols, of = np.concatenate([*done_symbols, np.zeros(0, np.int32)]), np.concatenate([*done_of, np.zeros(0, np.int64)])
        symbols = symbols[np.argsort(of, kind="stable")].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(of.astype(np.int64), minlength=len(cuts)))
        at = 0
        for i, end in enumerate(ends.tolist()):
            if end > at:
                out[i] = symbols[at:end]
            at = end
        return out

    def _learn(self, cuts: list[str], library) -> list[bytes]:
        short = [i for i, c in enumerate(cuts) if len(c) <= LONGEST_REMEMBERED]
        out = [b""] * len(cuts)
        for i, ids in zip(short, self.merged_together([cuts[i] for i in short]), strict=True):
            out[i] = ids
        for i in sorted(set(range(len(cuts))) - set(short)):
            out[i] = np.array(self.merged(cuts[i]), "<i4").tobytes()
        if library is not None and self.prefix and not self.squeeze:
            # A cut is encoded alone: the library adds the space mark, or, to a cut without one, a line end goes before it.
            behind = library.encode("\n")
            led = [c[0] == SPACE and len(c) > 1 for c in cuts]
            said = library.encode([c[1:] if x else "\n" + c for c, x in zip(cuts, led, strict=True)], num_threads=1)
            self.odd |= {c for c, x, ids, theirs in zip(cuts, led, out, said, strict=True) if np.frombuffer(ids, "<i4").tolist() != (theirs if x else theirs[len(behind) :] if theirs[: len(behind)] == behind else None)}
        for i in short:
            self.room -= _ENTRY + len(cuts[i]) + len(out[i])
            if self.room < 0:
                self.aside, self.remembered, self.room = self.remembered, {}, REMEMBERED_BYTES
            self.remembered[cuts[i]] = out[i]
        return out

    def encode(self, texts: list[str], library=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts after one another, the offset of each text's, and whether the library has all its cuts as they are here."""
        texts = [self.normalised(t) for t in texts]
        offs = np.cumsum([0, *map(len, texts)])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, "<i4"), np.zeros(len(offs), np.int64), np.ones(len(texts), bool)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.class_of[points]
        start = np.append(True, (kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] == 2) & (kind[:-1] != 2))
        start[offs[:-1][offs[:-1] < offs[1:]]] = True
        start = np.flatnonzero(start)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        data = joined.encode()
        bounds = np.append((np.cumsum(size) - size)[start], len(data))
        cuts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        distinct, code = cuts.dictionary.to_pylist(), cuts.indices.to_numpy()
        ids = [self.remembered.get(c) or self.aside.get(c) for c in distinct]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self._learn([distinct[i] for i in missing], library) if missing else [], strict=True):
            ids[i] = x
        size = np.array([len(x) // 4 for x in ids])
        flat, from_ = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(size) - size
        n = size[code]
        end = np.cumsum(n)
        out = flat[np.repeat(from_[code] - (end - n), n) + np.arange(end[-1])]
        first = np.searchsorted(start, offs)
        odd = np.zeros(len(start) + 1, np.int64)
        if self.odd:
            np.cumsum(np.array([c in self.odd for c in distinct])[code], out=odd[1:])
        return out, np.append(0, end)[first], odd[first[1:]] == odd[first[:-1]]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: bytes that aren't UTF-8 become U+FFFD each, the space of the dummy prefix goes, control pieces are nothing."""
        out = list(map(self.bytes_of.__getitem__, ids))
        if self.prefix or self.squeeze:
            for k, i in enumerate(ids):
                if self.kind[i] == CONTROL:
                    continue
                if self.kind[i] == NORMAL and out[k][:1] == b" ":
                    out[k] = out[k][1:]
                    if self.squeeze and not out[k]:
                        continue  # all leading spaces go
                break
        runs, at = [], 0
        if not self.controls.isdisjoint(ids):  # bytes before and behind a control piece make no character together
            for k, i in enumerate(ids):
                if i in self.controls:
                    runs.append(out[at:k])
                    at = k
        return "".join(b"".join(run).decode("utf-8", "tallyfold-one-byte") for run in [*runs, out[at:]])


@lru_cache(2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(2)
def library_of(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def public_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str | None = None, check: str | None = "cuts") -> DataFrame:
    """doc_id, ids, decoded (the text of these ids), and agrees: whether the sentencepiece library has the same ids (of the text's cuts; with check="texts" of the text as a whole too) and the same text of these ids; null without a check."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or public_path()
        model, library = model_of(path), library_of(path) if check else None
        for table in chunks(batches):
            texts = [t or "" for t in table.column("text").to_pylist()]
            flat, offs, same = model.encode(texts, library)
            plain = flat.tolist()
            ids = [plain[a:z] for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            del plain
            decoded = [model.decode(i) for i in ids]
            agrees = [None] * len(texts)
            if check:
                agrees = [bool(s) and a == b for s, a, b in zip(same, decoded, library.decode(ids, num_threads=1), strict=True)]
            if check == "texts":
                agrees = [s and a == b for s, a, b in zip(agrees, ids, library.encode(texts, num_threads=1), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())]))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of a table of doc_id and ids; null ids give null, ids out of the vocabulary an error."""
    rows = rows.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary or public_path())
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
