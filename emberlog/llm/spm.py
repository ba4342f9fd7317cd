"""SentencePiece encoding and decoding by a streaming Viterbi search.

At each character the encoder keeps one best way to end a piece there, with a backpointer.
Only the last `longest piece` positions can be extended, so that window is all that
survives; when all backpointer paths from it run through one boundary, everything before that
boundary is final, its ids are committed and the text before it is dropped.

Two kinds of model share the search and differ in what makes a way the best:

* unigram: the sum of the piece scores (ties: the shorter last piece).
* bpe: the prefix's own merge encoding is the one admissible way. The last piece t of a
  prefix is the one for which the encoding of what precedes it ends in a piece u such that
  merging u followed by t gives back u and t. Adjacent pairs decide this alone, because
  merges inside a final piece never depend on what lies outside it. So the search gives
  the ids that merging the whole text would give, one character at a time.

Where no piece of a vocabulary holds a space after another character, nor a line feed with others, which is checked
when a model is made, all paths converge there, and the encoder commits at every such boundary. Spans between
boundaries repeat in a corpus, so each worker remembers the ids of those of up to SHORT characters, at most CACHE of them; longer
ones, and all of a text if the check fails, run through the window above.

Characters that are no piece become the pieces of their UTF-8 bytes. Spaces become U+2581 and
one is put in front, as the model prescribes; other characters stay as they are.
Decoding reverses both and joins byte pieces. Text survives the round trip exactly unless
it holds U+2581 itself, which decodes to a space.

Cases: null and empty texts have no ids and decode to ''. A text of any length is read CHUNK characters
at a time and takes memory for its ids, a chunk and one window. Rows are independent: order, repeats, other columns don't matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 400_000
SHORT = 96
CHUNK = 16_384

_SPANS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_BORDER, _BARE = re.compile(f"[{SPACE}\n]"), re.compile(f"[^{SPACE}\n]")
_ACROSS = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.S)
_NEVER = float("inf")


class Model:
    """Pieces, scores and the two admissibility rules."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], kind: str, special: Iterable[int] = ()):
        self.kind = kind
        self.byte_ids = byte_ids
        hidden = {*byte_ids, *special}
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in hidden}
        self.pieces = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.longest = max(map(len, self.ids))
        #: Whether paths converge before every space that follows another character, and around line feeds.
        self.parted = not any(_ACROSS.search(p) for p in self.ids)
        self.unknown = min(self.scores) - 10
        self.rank = [-s for s in self.scores]
        self.shared_ranks = {r for r, n in _counted(self.rank[i] for i in self.ids.values()) if n > 1}
        self._pairs: dict[int, bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._plain: dict[int, bool] = {}
        self._spans: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: The lengths of the pieces of two or more characters that end in two given ones, longest first.
        self.lengths: dict[str, list[int]] = {}
        for end, length in {(p[-2:], len(p)) for p in self.ids if len(p) > 1}:
            self.lengths.setdefault(end, []).append(length)
        for found in self.lengths.values():
            found.sort(reverse=True)
        if kind == "bpe":  # pieces longer than two characters are found by their last three
            self.lengths3: dict[str, list[int]] = {}
            for end, length in {(p[-3:], len(p)) for p in self.ids if len(p) > 2}:
                self.lengths3.setdefault(end, []).append(length)
            for found in self.lengths3.values():
                found.sort(reverse=True)
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.raw = [
            bytes([byte_of[i]]) if i in byte_of else b"" if i in hidden else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
            for i, p in enumerate(self.pieces)
        ]

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)]
        return cls(pieces, byte_ids, kind, special)

    # ---- merging, on single pieces and pairs only

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Merge a short text; also the merges in order."""
        parts, done = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts, done
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces of which i is merged last; None for one character."""
        if i not in self._splits:
            parts, done = self.merged(self.pieces[i])
            last = done[-1] if done and len(parts) == 1 else None
            self._splits[i] = last and (self.ids[last[0]], self.ids[last[1]])
        return self._splits[i]

    def plain(self, i: int) -> bool:
        """Whether i is merged from parts of earlier ranks all the way down, with no rank shared."""
        if i not in self._plain:
            s = self.split(i)
            if s is None:
                self._plain[i] = len(self.pieces[i]) == 1
            else:
                self._plain[i] = (
                    self.rank[i] not in self.shared_ranks
                    and all(self.plain(p) and (len(self.pieces[p]) == 1 or self.rank[p] < self.rank[i]) for p in s)
                )
        return self._plain[i]

    def adjacent(self, u: int, t: int) -> bool:
        """Whether merging u followed by t gives u and t."""
        key = u << 20 | t
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = (
                self._unmerge(u, t) if self.plain(u) and self.plain(t)
                else self.merged(self.pieces[u] + self.pieces[t])[0] == [self.pieces[u], self.pieces[t]]
            )
        return known

    def _unmerge(self, u: int, t: int) -> bool:
        """Undo the merges of u and t, latest first; a piece over their border must never be due."""
        limit, strict = _NEVER, True
        rank = lambda i: self.rank[i] if self.split(i) else -_NEVER
        while True:
            both = self.ids.get(self.pieces[u] + self.pieces[t])
            if both is not None and (self.rank[both] < limit or not strict and self.rank[both] == limit):
                return False
            a, b = rank(u), rank(t)
            if a == b == -_NEVER:
                return True
            if a >= b:  # on a tie the merge to the left came first and is undone last
                if a == b:
                    limit, strict, t = b, False, self.split(t)[0]
                else:
                    limit, strict, u = a, True, self.split(u)[1]
            else:
                limit, strict, t = b, False, self.split(t)[0]

    # ---- the search

    def search(self, text: str, last: list[int], back: list[int], best: list[float]) -> None:
        """Extend the three lists, which reach to position len(last) - 1, to the end of text."""
        if self.kind == "unigram":
            self._search_unigram(text, last, back, best)
        else:
            self._search_bpe(text, last, back)
            best.extend([0.0] * (len(last) - len(best)))

    def _search_unigram(self, text: str, last: list[int], back: list[int], best: list[float]) -> None:
        for end in range(len(last), len(text) + 1):
            found, frm, score = -1, end - 1, best[end - 1] + self.unknown
            for length in (*self.lengths.get(text[max(0, end - 2) : end], ()), 1):
                at = end - length
                i = self.ids.get(text[at:end]) if at >= 0 else None
                if i is not None and (found < 0 or best[at] + self.scores[i] >= score):
                    found, frm, score = i, at, best[at] + self.scores[i]
            last.append(found)
            back.append(frm)
            best.append(score)

    def _search_bpe(self, text: str, last: list[int], back: list[int]) -> None:
        ids, pairs, adjacent, lengths = self.ids, self._pairs, self.adjacent, self.lengths3.get
        for end in range(len(last), len(text) + 1):
            found, frm = -1, end - 1
            for length in (*(lengths(text[end - 3 : end], ()) if end > 2 else ()), 2, 1):
                at = end - length
                if at < 0:
                    continue
                i = ids.get(text[at:end])
                if i is None:
                    continue
                u = last[at]
                if u >= 0:
                    fits = pairs.get(u << 20 | i)
                    if fits is None:
                        fits = adjacent(u, i)
                else:
                    fits = length == 1 or self.split(i) is not None
                if fits:
                    found, frm = i, at
                    break
            last.append(found)
            back.append(frm)

    def path(self, text: str, last: list[int], back: list[int], end: int) -> list[int]:
        """Ids of the path that ends at a position; characters that are no piece become bytes."""
        out: list[int] = []
        while end:
            i, at = last[end], back[end]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[at:end].encode("utf-8", "surrogatepass")))
            end = at
        out.reverse()
        return out

    def span(self, text: str) -> bytes:
        """int32 ids of a span, as bytes."""
        known = self._spans.get(text) or self._older.get(text)
        if known is None:
            if len(text) > SHORT:
                stream = Stream(self)
                return np.array([*stream.feed(text), *stream.finish()], "<i4").tobytes()
            last, back = [-2], [0]
            self.search(text, last, back, [0.0])
            known = array("i", self.path(text, last, back, len(text))).tobytes()
        if len(self._spans) >= CACHE:
            self._older, self._spans = self._spans, {}
        self._spans[text] = known
        return known

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        encoder, out = Encoder(self), bytearray()
        for at in range(0, len(text), CHUNK):
            encoder.feed(text[at : at + CHUNK], out)
        encoder.finish(out)
        return np.frombuffer(out, "<i4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _counted(values: Iterable[float]) -> Iterable[tuple[float, int]]:
    seen: dict[float, int] = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    return seen.items()


class Encoder:
    """Ids of one text that arrives in chunks: a span at a time, or by the window where a span is long."""

    def __init__(self, model: Model):
        self.model = model
        self.rest = SPACE
        self.stream: Stream | None = None if model.parted else Stream(model)

    def _stream(self, text: str, out: bytearray) -> None:
        out += np.array(self.stream.feed(text), "<i4").tobytes()

    def feed(self, chunk: str, out: bytearray) -> None:
        """Add a chunk; ids that are final are appended to out."""
        text = self.rest + chunk.replace(" ", SPACE)
        self.rest = ""
        if self.stream:
            border = _BORDER.search(text) if self.model.parted else None
            self._stream(text[: border.start()] if border else text, out)
            if not border:
                return
            out += np.array(self.stream.finish(), "<i4").tobytes()
            self.stream, text = None, text[border.start() :]
        spans = _SPANS.findall(text)
        self.rest = spans.pop()  # it may go on
        get, span = self.model._spans.get, self.model.span
        out += b"".join([get(s) or span(s) for s in spans])
        if len(self.rest) > SHORT and _BARE.search(self.rest):
            self.stream = Stream(self.model)
            self._stream(self.rest, out)
            self.rest = ""

    def finish(self, out: bytearray) -> None:
        if self.stream:
            self._stream(self.rest, out)
            out += np.array(self.stream.finish(), "<i4").tobytes()
        elif self.rest:
            out += self.model.span(self.rest)


class Stream:
    """The search over one text that arrives in pieces.

    `text` holds what is not committed; position k lies after k characters of it.
    last[k] is the piece that ends there (-1: a character that is no piece), back[k]
    where that piece begins.
    """

    def __init__(self, model: Model):
        self.model = model
        self.text = ""
        self.last: list[int] = [-2]
        self.back: list[int] = [0]
        self.best: list[float] = [0.0]
        self.widest = 0

    def extend(self, more: str) -> None:
        """Add characters without committing."""
        self.text += more
        self.model.search(self.text, self.last, self.back, self.best)

    def feed(self, more: str) -> list[int]:
        """Add characters; return the ids that have become final."""
        out: list[int] = []
        step = 4 * self.model.longest
        for at in range(0, len(more), step):
            self.extend(more[at : at + step])
            out += self._commit()
        return out

    def _commit(self) -> list[int]:
        self.widest = max(self.widest, len(self.text))
        end = len(self.text)
        paths = set(range(max(0, end - self.model.longest + 1), end + 1))
        while len(paths) > 1:
            k = max(paths)
            paths.remove(k)
            paths.add(self.back[k])
        border = paths.pop()
        if not border:
            return []
        out = self.model.path(self.text, self.last, self.back, border)
        self.text = self.text[border:]
        self.last = self.last[border:]
        self.back = [max(0, k - border) for k in self.back[border:]]
        self.best = self.best[border:]
        return out

    def finish(self) -> list[int]:
        out = self.model.path(self.text, self.last, self.back, len(self.text))
        self.__init__(self.model)
        return out


_models: dict[tuple[str, str], Model] = {}


def model(path: str = MODEL, kind: str = "bpe") -> Model:
    """The worker's copy of a model."""
    if (path, kind) not in _models:
        _models[path, kind] = Model.load(path, kind)
    return _models[path, kind]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    m = model(path, kind)
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            texts = part.column(1).to_pylist()
            ids = [m.encode(t) for t in texts]
            same = [m.decode_bytes(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
            n = [len(i) for i in ids]
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                    pa.array(same),
                ],
                ["doc_id", "n_tokens", "ids", "round_trip"],
            )


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, kind: str = "bpe"
) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row; round_trip: the ids decode to the text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _encoded(it, path, kind), "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    )


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) from encode()'s rows; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
