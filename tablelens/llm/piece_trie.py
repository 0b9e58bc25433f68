"""SentencePiece encoding and decoding with a shared-prefix forward pass.

White space becomes the mark U+2581 and a mark is put in front, as the model
does; no piece crosses into the next mark, so a text is a row of marked words.
The distinct words of a batch are sorted, which walks their trie depth-first:
the forward states of a common prefix are computed once and reused by every
word below it.

The forward state of a prefix depends on the kind of model:

* unigram: the best score of any segmentation of the prefix, and its last
  piece (Viterbi);
* byte-pair merges (the kind of the public model): merges are not decided by
  the sum of scores, so plain Viterbi would give other pieces than the model.
  The state is the last piece of the prefix's own merge result; a piece may
  follow it only where merging the two side by side leaves both as they are.
  Exactly one path through the trellis meets that, and it is the model's.

Characters outside the vocabulary become byte pieces. All of it runs inside
tasks, word tables are bounded, and nothing is shuffled.

Defined cases: null and empty texts have no pieces and decode to the empty
text; a mark character in a text counts as a space; texts of any length are
encoded whole; repeated rows are encoded each; other columns are carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORDS_KEPT = 800_000     # encoded words a worker remembers
PAIRS_KEPT = 1_000_000   # judged pairs of pieces a worker remembers
LONGEST_KEPT = 64
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN = -1


class PieceModel:
    """Pieces, scores and merge behaviour of a SentencePiece model file."""

    _made: dict[str, "PieceModel"] = {}

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.piece = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unk = proto.trainer_spec.unk_id
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.bytes_of = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                         else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode()
                         for p in proto.pieces]
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        ids, score = self.ids, self.score
        pair = [ids.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pair):
                if p is not None and (best is None or score[p] > best):
                    best, at = score[p], i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = ids.get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = ids.get(parts[at - 1] + parts[at])

    def _stands(self, i: int) -> bool:
        """Is a piece the merge result of its own characters?"""
        ok = self.whole.get(i)
        if ok is None:
            ok = self.whole[i] = self.merged(self.piece[i]) == [self.piece[i]]
        return ok

    def _may_follow(self, a: int, b: int) -> bool:
        """Do two pieces side by side stay as they are?"""
        key = (a, b)
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) > PAIRS_KEPT:
                self.follows.clear()
            x, y = self.piece[a], self.piece[b]
            ok = self.follows[key] = self.merged(x + y) == [x, y]
        return ok

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of marked words, walking their trie in sorted order."""
        ids, score, longest = self.ids, self.score, self.longest
        path: list[tuple[float, int, int]] = [(0.0, 0, UNKNOWN)]   # (score, length of the last piece, its id) per prefix
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                found = None
                for length in range(min(end, longest), 0, -1):
                    i = ids.get(word[end - length:end])
                    if i is None:
                        if length > 1:
                            continue
                        i = UNKNOWN
                    total, _, last = path[end - length]
                    if self.merges:
                        if i != UNKNOWN and not (self._stands(i) and (end == length or last == UNKNOWN or self._may_follow(last, i))):
                            continue
                        found = (0.0, length, i)
                        break
                    total += self.least if i == UNKNOWN else score[i]
                    if found is None or total > found[0]:
                        found = (total, length, i)
                path.append(found)
            before = word
            out, end = [], len(word)
            while end:
                _, length, i = path[end]
                if i != UNKNOWN:
                    out.append((i,))
                elif self.byte:
                    out.append(tuple(self.byte[x] for x in word[end - 1].encode("utf-8", "surrogatepass")))
                else:
                    out.append((self.unk,))
                end -= length
            yield word, np.array([i for t in reversed(out) for i in t], dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of whole texts."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        units = []
        for text in texts:
            text = text or ""
            if not text:
                units.append([])
            elif "  " in text or text[0] == " " or MARK in text:
                units.append([u[1:] for u in UNIT.findall(MARK + text.replace(" ", MARK))])
            else:
                units.append(text.split(" "))       # words without their mark
        known, kept = self.known, {}
        new = {w for u in units for w in u if w not in known}
        for word, ids in self.encode_words(MARK + w for w in new):
            (known if len(word) <= LONGEST_KEPT else kept)[word[1:]] = ids
        if kept:
            return [b"".join([known[w] if w in known else kept[w] for w in u]) for u in units]
        return [b"".join(map(known.__getitem__, u)) for u in units]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``: the text's piece ids, packed as little-endian unsigned 32-bit."""

    @F.pandas_udf("binary")
    def ids(text):
        import pandas as pd

        return pd.Series(PieceModel.of(model_path).encode([t if isinstance(t, str) else None for t in text]), dtype=object)

    return df.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the text of packed piece ids."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        model = PieceModel.of(model_path)
        return pd.Series([model.decode(i or b"") for i in ids], dtype=object)

    return df.withColumn(out_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of both directions in one pass: ``doc_id, n_pieces, ids_crc32,
    decoded_crc32, round_trip`` (does the text decoded from the ids equal the input)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = model.encode(texts)
            back = [model.decode(i) for i in ids]
            yield pa.record_batch([
                b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                pa.array([t == (x or "").replace(MARK, " ") for t, x in zip(back, texts)], pa.bool_())],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
