"""Toxic spans by a linear-chain conditional random field, and document scores from them.

A token's label is toxic or not. The field's log-potentials are a weight for each feature of a
token (the word, its beginnings of three to six characters, its last three, lower-cased and
without punctuation around) and one for each pair of neighbouring labels. Training
and scoring use exact forward-backward marginals.

Token labels come from document labels: in toxic training documents, tokens that carry a
feature found in MARKED times as large a share of toxic as of other documents (and in at least
LEAST_SHARE of the toxic ones) are toxic; all
tokens of the other documents are not. A document's score is a logistic function of the
expected number of toxic tokens, the largest marginal and their share, fitted on the
same documents. Offending offsets are the code points of tokens with a marginal of 0.5.

The model is fitted on the driver from a bounded sample: at most `sample` labelled documents and
`sample_bytes` of text of each label, those whose keyed hash is smallest. It learns from all of their tokens, cut into
segments of SEGMENT, and holds features of that sample only. Scoring
is a map over all rows: no shuffle, whole texts, and memory for one text or for GROUP tokens.
Labels, language, source and id never enter a score.

Cases: null and empty texts have no tokens and get the score of no evidence. Without
training documents of both labels the score is the share of toxic ones (0 for none at
all). Rows that repeat a doc_id are scored each for itself. Null labels are left out; of several labels
of one doc_id, toxic counts. A null doc_id has held_out = true.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE = 3000
SAMPLE_BYTES = 48_000_000
MARKED = 12.0
LEAST_DOCS = 4
LEAST_SHARE = 0.015
SEGMENT = 48
BLOCK = 1024
CACHE = 500_000
#: Tokens that are scored together, and code points of the texts that are held together.
GROUP = 1_000_000
HELD = 12_000_000

#: The words that bytes.split() gives.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_=+/\\`~"


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from; a null id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(token: str) -> list[str]:
    w = token.strip(_EDGES).lower()
    if not w:
        return ["-"]
    return [f"w:{w}", *(f"{n}:{w[:n]}" for n in range(3, 7) if len(w) >= n), f"e:{w[-3:]}"]




_MOST = np.exp(300.0)


def _messages(odds: np.ndarray, length: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as odds; `odds` has a row for each place and a column for each text.

    A step maps any odds between two quotients of `step`, so nothing overflows.
    """
    t_max = len(odds)
    fwd, bwd = np.empty_like(odds), np.ones_like(odds)
    (e00, e01), (e10, e11) = np.exp(step)
    fwd[0] = odds[0]
    for t in range(1, t_max):
        r = fwd[t - 1]
        np.divide(e01 + r * e11, e00 + r * e10, out=fwd[t])
        fwd[t] *= odds[t]
    last = length - 1
    for t in range(t_max - 2, -1, -1):
        r = bwd[t + 1] * odds[t + 1]
        bwd[t] = np.where(t >= last, 1.0, (e10 + r * e11) / (e00 + r * e01))
    return fwd, bwd


def marginals(emit: np.ndarray, length: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded rows.

    emit: (rows, T) log-potential of the toxic label against the other; step: (2, 2)
    log-potentials of neighbours. Returns (rows, T) marginals of the toxic label and the
    forward and backward messages.

    With two labels, a message is one number: the odds of the toxic label.
    """
    t_max = emit.shape[1]
    if not t_max:
        return emit, emit, emit
    odds = np.exp(np.clip(np.ascontiguousarray(emit.T), -100, 100))
    fwd, bwd = _messages(odds, length, step)
    both = np.minimum(fwd * bwd, _MOST)
    p = (both / (1.0 + both)).T.copy()
    p[np.arange(t_max)[None] >= length[:, None]] = 0.0
    return p, fwd.T, bwd.T


class Model:
    """Feature weights, neighbour weights and the score's logistic weights."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray, score: np.ndarray):
        self.weights, self.bias, self.step, self.score = weights, bias, step, score
        self._known: dict[bytes, float] = {}
        self._older: dict[bytes, float] = {}

    def emit(self, token: bytes) -> float:
        """The log-potential of a word, from the cache or the one it replaced."""
        e = self._older.get(token)
        if e is None:
            get, e = self.weights.get, self.bias
            for f in features(token.decode("utf-8", "surrogatepass")):
                e += get(f, 0.0)
        if len(self._known) >= CACHE:
            self._older, self._known = self._known, {}
        self._known[token] = e
        return e

    def emits(self, text: bytes | None) -> np.ndarray:
        """The log-potentials of a text's tokens."""
        tokens = text.split() if text else []
        out = np.fromiter(map(self._known.get, tokens, repeat(np.nan)), np.float64, len(tokens))
        for i in np.flatnonzero(np.isnan(out)).tolist():
            e = self._known.get(tokens[i])
            out[i] = self.emit(tokens[i]) if e is None else e
        return out

    def tag(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each UTF-8 text the marginals of its tokens. Texts of like length go together,
        at most GROUP tokens with what pads them, or one text."""
        return self.tagged([self.emits(t) for t in texts])

    def tagged(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        order = sorted(range(len(emits)), key=lambda i: len(emits[i]))
        out: list = [None] * len(emits)
        at = 0
        while at < len(order):
            end = at + 1
            longest = len(emits[order[at]])
            while end < len(order) and (n := len(emits[order[end]])) <= 1.3 * longest + 16 and n * (end + 1 - at) <= GROUP:
                end += 1
            group = order[at:end]
            n = np.array([len(emits[i]) for i in group])
            emit = np.zeros((len(group), n.max()))
            for row, i in enumerate(group):
                emit[row, : n[row]] = emits[i]
            p = marginals(emit, n, self.step)[0]
            for row, i in enumerate(group):
                out[i] = p[row, : n[row]].copy()
            at = end
        return out

    def document(self, p: np.ndarray) -> float:
        z = float(self.score @ summary(p))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def summary(p: np.ndarray) -> np.ndarray:
    """What the score sees of a document's marginals."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    total = float(p.sum())
    return np.array([1.0, np.log1p(total), float(p.max()), float(np.sqrt(total / len(p)))])


def _marked(docs: list[tuple[np.ndarray, int]], place: np.ndarray, feature: np.ndarray, n_words: int, n_features: int) -> np.ndarray:
    """Whether each word carries a feature that marks toxic tokens; docs hold word numbers."""
    held = np.zeros((2, n_features))
    n = np.zeros(2)
    starts = np.searchsorted(place, np.arange(n_words + 1))
    for words, label in docs:
        n[label] += 1
        own = np.unique(words)
        many = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(own) else own
        held[label, np.unique(feature[at])] += 1
    marks = (held[1] >= max(LEAST_DOCS, LEAST_SHARE * n[1])) & (held[1] / n[1] >= MARKED * ((held[0] + 0.5) / (n[0] + 1)))
    return np.bincount(place, marks[feature], minlength=n_words) > 0


def fit(docs: Iterable[tuple[str | None, int]], rounds: int = 120) -> Model:
    """Train on (text, label) pairs, with every token of every text."""
    word_id: dict[str, int] = {}
    split = [
        (np.array([word_id.setdefault(w, len(word_id)) for w in _TOKEN.findall(t or "")], np.int32), int(label)) for t, label in docs
    ]
    n_toxic = sum(label for _, label in split)
    if not split or n_toxic in (0, len(split)):
        share = n_toxic / len(split) if split else 0.0
        odds = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model({}, -20.0, np.zeros((2, 2)), np.array([odds, 0.0, 0.0, 0.0]))
    words = list(word_id)
    names: dict[str, int] = {}
    place, feature = [], []  # a word's features: its score is their sum, wherever it stands
    for i, w in enumerate(words):
        ids = [names.setdefault(f, len(names)) for f in features(w)]
        feature.extend(ids)
        place.extend([i] * len(ids))
    place, feature = np.array(place, np.int64), np.array(feature, np.int64)
    marked = _marked(split, place, feature, len(words), len(names))
    width = SEGMENT
    flat = np.concatenate([ids for ids, _ in split])
    sizes = np.array([len(ids) for ids, _ in split])
    per = -(-sizes // width)  # segments of each text
    rows = int(per.sum())
    inside_text = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.cumsum(per) - per, sizes) + inside_text // width
    length = np.bincount(row, minlength=rows)
    word = np.zeros((rows, width), np.int32)
    y = np.zeros((rows, width), np.int8)
    word[row, inside_text % width] = flat
    y[row, inside_text % width] = marked[flat] & np.repeat([label == 1 for _, label in split], sizes)
    held = np.bincount(np.unique(row * len(words) + flat) % len(words), minlength=len(words))
    known = np.bincount(feature, held[place], minlength=len(names)) >= 3  # seen in three segments
    place, feature = place[known[feature]], feature[known[feature]]
    toxic = np.zeros(len(words))
    blocks = []
    for at in range(0, rows, BLOCK):  # places in rows, segments in columns
        own, label, n = (np.ascontiguousarray(x[at : at + BLOCK].T) for x in (word, y, length))
        inside = np.arange(width)[:, None] < n[None]
        toxic += np.bincount(own.ravel(), label.ravel(), minlength=len(words))
        pairs = np.bincount((2 * label[:-1] + label[1:])[inside[1:]], minlength=4)
        blocks.append((own, n, inside, pairs))
    w = np.zeros(len(names) + 5)  # features, bias, four neighbour weights
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        scores = np.bincount(place, w[feature], minlength=len(words)) + w[-5]
        word_odds = np.exp(np.clip(scores, -100, 100))
        step = w[-4:].reshape(2, 2)
        grad = np.zeros_like(w)
        missed = toxic.copy()
        for own, n, inside, pairs in blocks:  # memory for one block of segments
            odds = word_odds[own]
            fwd, bwd = _messages(odds, n, step)
            both = np.minimum(fwd * bwd, _MOST)
            p = both / (1.0 + both)
            p *= inside
            missed -= np.bincount(own.ravel(), p.ravel(), minlength=len(words))
            (e00, e01), (e10, e11) = np.exp(step)
            left = np.minimum(odds[1:] * bwd[1:], _MOST)
            one = left * e11 / (e10 + left * e11)  # the right label's share if the left is toxic
            both = float((p[:-1] * one * inside[1:]).sum())  # expected pairs of toxic neighbours
            first, second = float((p[:-1] * inside[1:]).sum()), float(p[1:].sum())
            expected = np.array([pairs.sum() - first - second + both, second - both, first - both, both])
            grad[-4:] += pairs - expected
        grad[: len(names)] = np.bincount(feature, missed[place], minlength=len(names))
        grad[-5] = missed.sum()
        grad -= 0.5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = {f: float(w[i]) for f, i in names.items() if known[i] and abs(w[i]) > 1e-3}
    model = Model(weights, float(w[-5]), w[-4:].reshape(2, 2).copy(), np.zeros(4))
    emit = np.array([model.emit(v.encode("utf-8", "surrogatepass")) for v in words])
    x = np.array([summary(p) for at in range(0, len(split), 64) for p in model.tagged([emit[ids] for ids, _ in split[at : at + 64]])])
    target = np.array([label for _, label in split], float)
    balance = np.where(target == 1, len(split) / (2 * n_toxic), len(split) / (2 * (len(split) - n_toxic)))
    score = np.zeros(4)
    for _ in range(30):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ score, -30, 30)))
        g = x.T @ (balance * (target - q)) - 0.01 * score
        h = (x * (balance * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(4)
        score += np.linalg.solve(h, g)
    model.score = score
    return model


def training_rows(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> Iterator[tuple[str, int]]:
    """At most `sample` labelled documents and `sample_bytes` of text of each label, none of the held-out fold."""
    usable = (
        labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    place = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    upto = Window.partitionBy("toxic").orderBy(place, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .withColumn("taken", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(upto))
        .where(F.col("taken") <= sample_bytes).orderBy("doc_id", "text").select("text", "toxic")
    )
    return ((r[0], r[1]) for r in rows.toLocalIterator())


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 4096 texts and about HELD bytes, or one text."""
    sizes = batch.column(1).nbytes // max(1, len(batch))
    step = max(1, min(4096, HELD // max(1, sizes)))
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        lengths = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in part.column(1)), np.int64, len(part))
        begun = 0
        for end in range(1, len(part) + 1):
            if end == len(part) or lengths[begun : end + 1].sum() > HELD:
                yield part.slice(begun, end - begun)
                begun = end


def _scored(batches: Iterator[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _groups(batch):
            tagged = model.tag(part.column(1).cast(pa.binary()).to_pylist())
            found = []
            for t, p in zip(part.column(1), tagged):
                hit = np.flatnonzero(p >= 0.5)
                if spans and len(hit):
                    places = [m.span() for m in _TOKEN.finditer(t.as_py())]
                    found.append([{"start": places[i][0], "end": places[i][1], "p": float(p[i])} for i in hit])
                else:
                    found.append([])
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array([model.document(p) for p in tagged], pa.float64()),
                pa.array([int((p >= 0.5).sum()) for p in tagged], pa.int64()),
            ]
            names = ["doc_id", "score", "n_toxic_tokens"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                columns.append(pa.array(found, kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)


def score(docs: DataFrame, model: Model, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_toxic_tokens[, spans]) for every row of `docs`."""
    schema = "doc_id long, score double, n_toxic_tokens long"
    if spans:
        schema += ", spans array<struct<start:int,end:int,p:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _scored(it, model, spans), schema
    )


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, spans: bool = True) -> DataFrame:
    """Fit on the labelled sample and score every row: doc_id, held_out, score, predicted, ..."""
    model = fit(training_rows(docs, labels, sample))
    return (
        score(docs, model, spans)
        .withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
