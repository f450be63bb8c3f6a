"""SentencePiece encoding and decoding with a streaming Viterbi search.

The model is a BPE model. A segmentation is the model's own exactly if every piece and every two
neighbours come out of the merge rules unchanged, because merges inside a piece do not depend on
what lies beyond its ends until one crosses them, and a crossing shows in the pair alone. So the
search runs over piece boundaries from left to right: a piece may follow the best path to its start
if the merge rules keep it apart from that path's last piece. One path survives at each boundary, and
the backpointers of the last boundaries, as many as the longest piece has characters, are all
that later steps can use; where they meet, the ids before are final and leave the window.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.text import byte_column, int_lists, list_column

SPACE = "▁"
#: Segments in each of the two generations that a worker remembers, and the longest of them in characters.
MEMO, MEMO_CHARS = 250_000, 48
#: Characters of a text that are cut into segments at once; the cut is before a run of spaces.
PART = 1 << 20
_BREAK = re.compile(f"(?<!{SPACE}){SPACE}")
#: Segments of at most so many characters are searched without a moving window.
SHORT = 64
#: Remembered answers of the merge rules on pairs of pieces.
PAIRS = 400_000
#: Boundaries between two looks at whether the paths have met.
LOOK = 64
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
#: Where a Latin letter is followed by ASCII punctuation.
_TAIL = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-/:-@\[-`{-~])")


class Pieces:
    """A BPE model with byte fallback: pieces, scores and merge rules."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models that leave texts as they are")
        self.names = [p.piece for p in model.pieces]
        self.prefixed = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        #: Pieces by their characters: each node has the piece that ends there, if any, and the nodes after it.
        self.tree: dict[str, list] = {}
        for p in self.ids:
            below = self.tree
            for c in p:
                node = below.setdefault(c, [None, {}])
                below = node[1]
            node[0] = p
        if len(self.bytes) != 256 or any(p.type not in (_NORMAL, _UNKNOWN, 3, _BYTE) for p in model.pieces):
            raise ValueError("only models with byte fallback and no pieces of users")
        #: No piece goes on after a space that follows another character, so segments may be cut before it.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Nor does one go on from a letter to punctuation, so segments may be cut there too.
        self.tails = not any(len(_TAIL.split(p)) > 1 for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge rules as such: join the neighbours with the best score, the leftmost first."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part) and part[i] + part[j] in self.scores:
                heapq.heappush(queue, (-self.scores[part[i] + part[j]], i, part[i] + part[j], j))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, i, whole, j = heapq.heappop(queue)
            if part[i] is None or after[i] != j or part[j] is None or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p is not None]

    def apart(self, left: str, right: str) -> bool:
        """Whether the merge rules leave two neighbouring pieces as they are (``left`` may be empty)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known


class StreamingViterbi:
    """Segments one run of text that is fed in parts; ids come out as soon as they are final."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text, self.offset, self.done = "", 0, 0   # the window's text, where it starts, the last final boundary
        self.back: dict[int, tuple[int, str]] = {0: (0, "")}  # boundary -> start and piece of the last step of its path
        self.at = 0

    def feed(self, part: str) -> Iterator[int]:
        m, back = self.pieces, self.back
        self.text += part
        end, base, ids = self.offset + len(self.text), self.offset, m.ids
        for i in range(self.at + 1, end + 1):
            found = None
            for start in range(max(i - m.longest, self.done), i):
                step = back.get(start)
                if step is None:
                    continue
                piece = self.text[start - base:i - base]
                if piece in ids and m.apart(step[1], piece):
                    found = (start, piece)
                    break
            if found is None and self.text[i - 1 - base] not in ids:
                found = (i - 1, "")  # a character without a piece: never merged, so nothing hangs on it
            if found:
                back[i] = found
            self.at = i
            if i % LOOK == 0:
                yield from self._settle()
                base = self.offset

    def _settle(self) -> Iterator[int]:
        """Commit up to the boundary where the paths of all boundaries still in reach meet."""
        alive = {i for i in range(max(self.done, self.at - self.pieces.longest + 1), self.at + 1) if i in self.back}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0] if last > self.done else self.done)
        yield from self._commit(alive.pop())

    def _commit(self, boundary: int) -> Iterator[int]:
        steps, i = [], boundary
        while i > self.done:
            start, piece = self.back[i]
            steps.append((piece, self.text[start - self.offset:i - self.offset]))
            i = start
        for piece, surface in reversed(steps):
            if piece:
                yield self.pieces.ids[piece]
            else:
                yield from (self.pieces.bytes[b] for b in surface.encode("utf-8"))
        if boundary > self.done:
            last = self.back[boundary]
            for i in range(self.done, boundary):
                self.back.pop(i, None)
            self.back[boundary] = (boundary, last[1])
            self.done = boundary
            self.text, self.offset = self.text[boundary - self.offset:], boundary

    def close(self) -> Iterator[int]:
        yield from self._commit(self.at)


class Encoder:
    """Ids of whole texts. Before each run of spaces the paths have met in any case, so a text is a row
    of segments, and equal segments have equal ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before, from which segments in use come back
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if pieces.cuts else r"(?s).+")

    def _short(self, text: str) -> bytes:
        """As ``segment``, for a text that fits the window: the same steps, taken forward from each boundary. The first
        step to a boundary is the one from the leftmost start."""
        m, n = self.pieces, len(text)
        ids, pairs, apart = m.ids, m.pairs, m.apart
        back: list[tuple[int, str] | None] = [None] * (n + 1)
        back[0] = (0, "")
        for start in range(n):
            step = back[start]
            if step is None:
                if text[start - 1] in ids:
                    continue
                step = back[start] = (start - 1, "")
            last, below, end = step[1], m.tree, start
            for c in text[start:]:
                node = below.get(c)
                if node is None:
                    break
                piece, below = node
                end += 1
                if piece is not None and back[end] is None:
                    known = pairs.get((last, piece))
                    if known or known is None and apart(last, piece):
                        back[end] = (start, piece)
        out, i = [], n
        while i > 0:
            start, piece = back[i] or (i - 1, "")
            out += (ids[piece],) if piece else [m.bytes[b] for b in reversed(text[start:i].encode("utf-8"))]
            i = start
        out.reverse()
        return np.array(out, "<i4").tobytes()

    def segment(self, text: str) -> bytes:
        if len(text) <= SHORT:
            return self._short(text)
        search = StreamingViterbi(self.pieces)
        ids: list[int] = []
        for at in range(0, len(text), 1 << 12):
            ids.extend(search.feed(text[at:at + (1 << 12)]))
        ids.extend(search.close())
        return np.array(ids, "<i4").tobytes()

    def _learn(self, s: str) -> bytes:
        """Ids of a new segment; one with punctuation after letters is the segments on both sides of the cut."""
        cut = _TAIL.split(s) if self.pieces.tails and len(s) <= MEMO_CHARS else [s]
        if len(cut) == 1:
            return self.segment(s)
        for part in cut:
            if part not in self.memo:
                self.memo[part] = self.old.get(part) or self.segment(part)
        return b"".join(map(self.memo.__getitem__, cut))

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = (SPACE if self.pieces.prefixed else "") + text.replace(" ", SPACE)
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        out, at = [], 0
        while at < len(text):
            cut = _BREAK.search(text, at + PART) if self.pieces.cuts else None
            end = cut.start() if cut else len(text)
            found = self.segments.findall(text, at, end)
            memo, old = self.memo, self.old
            new = set(found).difference(memo)
            for s in new:
                memo[s] = old.get(s) or self._learn(s)
            out.append(b"".join(map(memo.__getitem__, found)))
            for s in new:
                if len(s) > MEMO_CHARS:
                    del memo[s]
            at = end
        return np.frombuffer(b"".join(out), "<i4")


class Decoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.surface = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else
                        (name.replace(SPACE, " ").encode() if pieces.ids.get(name) == i else b"") for i, name in enumerate(pieces.names)]

    def __call__(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefixed and text.startswith(" ") else text


@lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    """One per worker, which later tasks of the worker use again."""
    return Encoder(Pieces(model))


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` of every row: exactly the library's ids for the model. With ``decoded`` also
    ``decoded``, the text of the ids, made in the same pass, so that one worker per task does both.

    Null and empty texts have no ids. Characters without a piece become the ids of their UTF-8 bytes. Texts of any
    length are searched in a window bounded by the longest piece. Repeated rows come out repeated,
    other columns are ignored, ids of rows may be null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model)
        for batch in batches:
            ids = [encode(t.decode("utf-8")) for t in byte_column(batch, "text")]
            columns = [batch.column("id"), list_column(ids, pa.int32())]
            if decoded:
                decode = Decoder(encode.pieces)
                columns.append(pa.array([decode(x.tolist()) for x in ids], pa.string()))
            yield pa.record_batch(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode_ids(coded: DataFrame, model: str) -> DataFrame:
    """The columns of ``coded`` plus ``decoded``, the text of its ``ids``. Null and empty lists give an empty text; ids of
    control pieces have no text; bytes that form no character become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(_encoder(model).pieces)
        for batch in batches:
            text = pa.array([decode(x.tolist()) for x in int_lists(batch, "ids")], pa.string())
            kept = [n for n in batch.schema.names if n != "decoded"]
            yield pa.record_batch([*(batch.column(n) for n in kept), text], [*kept, "decoded"])

    schema = T.StructType([f for f in coded.schema if f.name != "decoded"]).add("decoded", T.StringType())
    return coded.mapInArrow(run, schema)
