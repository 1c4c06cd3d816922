"""Toxicity by a string-kernel support vector machine.

Words are compared by the gap-weighted subsequence kernel of order 3: two words are alike as far as they share letters in the
same order, each match weighted by ``decay`` to the power of the span it takes in either word. Spans of up to six characters
count, so letters may be left out, changed, or parted by inserted characters.

*Nystroem landmarks* are words that stand out in toxic training documents, with some common words for contrast. A sentence
is described by its best match with each landmark, whitened by the landmarks' own kernel matrix, and a linear machine with
squared hinge loss is trained on labelled sentences. Labels are given for documents, so in each round a toxic document
lends its label to its most suspicious sentences only. A logistic curve turns a document's highest sentence margins into a
score.

Training uses a bounded sample of labelled rows (``sample`` per class, taken by hash); scoring reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, column, id_remainder, remembers
from .keys import WIDTH, KeyTable, groups, grown, keys_of

STRIP = b".,;:!?\"'()[]{}|*&%$#<>"
STOPS = (b".", b"!", b"?")
SPAN = 6
#: Triples (i, j, k) of a window that begin at its first place: 0 < j < k < SPAN.
STEPS = np.array([(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)])
POWER = 5  # ``Kernel`` multiplies it out; a power of a kernel is a kernel; a higher one sets close matches apart from chance ones
LONGEST = 24  # longer words are cut into overlapping parts, each a word of the same sentence


@dataclass(frozen=True)
class Toxicity:
    """Rows with crc32(doc_id) % ``modulus`` = ``held`` are never learnt from. ``sample``: labelled rows used per class at most;
    ``landmarks`` words from ``pool`` times as many candidates, less than ``alike`` each other by the plain kernel as far as there are
    such, and ``contrast`` common ones; ``sentences``: of a training document, so many with the best matches are used."""

    modulus: int = 4
    held: int = 2
    sample: int = 3000
    landmarks: int = 120
    contrast: int = 8
    pool: int = 4
    alike: float = 0.8
    decay: float = 0.75
    least_documents: int = 3
    sentences: int = 100
    rounds: int = 5
    threshold: float = 0.3


# ASCII letters are 0 to 25; all other characters share the codes 26 to 31, so every letter has a place.
CODES = np.array([ord(chr(c).lower()) - 97 if chr(c).isascii() and chr(c).isalpha() else 26 + c % 6 for c in range(1024)], np.int64)


def _codes(word: str) -> np.ndarray:
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(c < 1024, CODES[np.minimum(c, 1023)], 26 + c % 6)


def triples(words: list[str], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of unit length: (word, subsequence, weight), sorted by word and subsequence."""
    lens = np.array([len(w) for w in words], np.int64)
    codes = _codes("".join(words))
    owner = np.repeat(np.arange(len(words)), lens)
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(codes))
    # A key holds word, subsequence and span, so one sort of numbers brings equal subsequences of a word together.
    keys = []
    for j, k in STEPS.tolist():
        i = at[at + k < ends]
        keys.append((owner[i] << 18) | (codes[i] << 13) | (codes[i + j] << 8) | (codes[i + k] << 3) | k)
    # Words of one or two characters have no triple: they stand for themselves by a padded one.
    short = np.flatnonzero((lens > 0) & (lens < 3))
    first = (np.cumsum(lens) - lens)[short]
    keys.append((short << 18) | (codes[first] << 13) | (codes[first + lens[short] - 1] << 8) | (31 << 3))
    key = np.sort(np.concatenate(keys))
    weight = (decay ** (np.arange(8) + 1)).astype(np.float32)[key & 7]
    key >>= 3
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    key, weight = key[start], np.add.reduceat(weight, start) if len(start) else weight
    norm = np.sqrt(np.bincount(key >> 15, weight.astype(np.float64) ** 2, len(words)))
    return key >> 15, key & 0x7FFF, (weight / norm[key >> 15]).astype(np.float32)


class Kernel:
    """Kernel values of words with the landmarks. Subsequences and landmarks meet in a sparse table: most triples of a word stand in
    few landmarks or none, so a word costs what it shares with them, not their number."""

    def __init__(self, landmarks: list[str], decay: float) -> None:
        self.landmarks, self.decay = landmarks, decay
        owner, sub, weight = triples(landmarks, decay)
        order = np.argsort(sub, kind="stable")
        self.first = np.searchsorted(sub[order], np.arange((1 << 15) + 1))  # where the entries of a subsequence begin
        self.owner, self.weight = owner[order], weight[order]

    def __call__(self, words: list[str]) -> np.ndarray:
        width = len(self.landmarks)
        if not words:
            return np.zeros((0, width), np.float32)
        owner, sub, weight = triples(words, self.decay)
        start, n = self.first[sub], self.first[sub + 1] - self.first[sub]
        keep = n > 0
        owner, start, n, weight = owner[keep], start[keep], n[keep], weight[keep]
        ends = np.cumsum(n)
        entry = np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(owner * width, n) + self.owner[entry]
        out = np.bincount(cell, np.repeat(weight, n) * self.weight[entry], len(words) * width).astype(np.float32)
        square = out * out
        return (square * square * out).reshape(len(words), width)  # to the power of POWER


def clean(word: bytes) -> list[str]:
    """A word without marks around it, and also without marks inside if it has any; in parts of at most LONGEST characters."""
    w = word.strip(STRIP).decode().lower()
    forms = [w] if w.isalpha() or not w else [w, "".join(c for c in w if c.isalpha())]
    half = LONGEST // 2
    return [f[i:i + LONGEST] for f in forms for i in range(0, max(1, len(f) - half), half)]


# Bytes in lower case: white space, what is stripped from a word, and what may follow the stop that ends a sentence.
WHITE, MARKS, AFTER, ENDS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8))
                             for x in (b" \t\n\r\x0b\x0c", STRIP, b"\"')]*&%$#|", b"".join(STOPS)))


class Describer:
    """Best matches of each sentence with each landmark, as bytes (255: equal); a worker remembers words from task to task.

    Words that differ by case and marks around them only share a row. Words are cut and looked up by NumPy, many at a time. When
    ``LIMIT`` words are there, those that were met again since the last time stay."""

    LIMIT = 250_000
    GROUP = 1_000_000  # bytes of texts that are described at a time

    def __init__(self, kernel: Kernel) -> None:
        self.kernel = kernel
        self._begin(np.zeros((0, 3), np.uint64), np.zeros((0, len(kernel.landmarks)), np.uint8))

    def _begin(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.table, self.rows, self.longer = KeyTable(), rows, {}
        self.table.add(keys)

    def _turn(self) -> None:
        """Called between texts, never while numbers of rows are in use."""
        if self.table.n > self.LIMIT:
            stay = self.table.met_again()
            stay = stay[:0] if len(stay) > self.LIMIT // 2 else stay
            self._begin(self.table.keys[stay], self.rows[stay])

    def _learn(self, words: list[bytes], keys: np.ndarray) -> np.ndarray:
        """The rows of different words, stripped and in lower case, that have none."""
        parts = [[w.decode()] if len(w) <= LONGEST and w.isalpha() else clean(w) for w in words]
        flat = [x for p in parts for x in p]
        values = np.concatenate([np.rint(np.minimum(self.kernel(flat[s:s + 20_000]), 1) * 255).astype(np.uint8)
                                 for s in range(0, len(flat), 20_000)])
        new = self.table.add(keys)
        self.rows = grown(self.rows, self.table.n)
        self.rows[new] = highest(values, np.arange(len(flat)), np.cumsum([0, *map(len, parts[:-1])]))
        return new

    def _rows_of(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The row of each word of ``data``, new ones made."""
        keys = keys_of(data, start, length, length + 1)
        out = self.table.find(keys)
        lost = np.flatnonzero((out < 0) & (length <= WIDTH))
        if len(lost):
            order, fresh = groups(keys[lost])
            order = lost[order]
            one = order[fresh]
            words = [data[a:a + n] for a, n in zip(start[one].tolist(), length[one].tolist(), strict=True)]
            out[order] = self._learn(words, keys[one])[np.cumsum(fresh) - 1]
        far = np.flatnonzero(length > WIDTH)
        if len(far):
            names = [data[a:a + n] for a, n in zip(start[far].tolist(), length[far].tolist(), strict=True)]
            new = list({w for w in names if w not in self.longer})
            if new:
                made = self._learn(new, np.zeros((len(new), 3), np.uint64))
                self.longer.update(zip(new, made.tolist(), strict=True))
            out[far] = [self.longer[w] for w in names]
        return out

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """For each text, a matrix of sentences by landmarks; without words it has no row."""
        some, size = [], 0
        for t in texts:
            some.append(t or b"")
            size += len(some[-1])
            if size > self.GROUP:
                yield from self._sentences(some)
                some, size = [], 0
        if some:
            yield from self._sentences(some)

    def _sentences(self, texts: list[bytes]) -> list[np.ndarray]:
        self._turn()
        data = b"\n".join([b"", *texts, b""]).lower()
        buffer = np.frombuffer(data, np.uint8)
        white = WHITE[buffer]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        first = np.zeros(len(start) + 1, bool)  # words that begin a sentence
        first[np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]]))] = True
        low, high = start.copy(), end.copy()
        marked = np.flatnonzero(MARKS[buffer[end - 1]])
        if len(marked):
            last = np.flatnonzero(~AFTER[buffer])
            first[1:][marked] |= ENDS[buffer[last[np.searchsorted(last, end[marked]) - 1]]]
        marked = np.flatnonzero(MARKS[buffer[start]] | MARKS[buffer[end - 1]])
        if len(marked):
            inner = np.flatnonzero(~(white | MARKS[buffer]))
            a, b = np.searchsorted(inner, start[marked]), np.searchsorted(inner, end[marked])
            some = b > a
            low[marked[some]], high[marked[some]] = inner[a[some]], inner[b[some] - 1] + 1
            high[marked[~some]] = low[marked[~some]]
        row = self._rows_of(data, low, high - low)
        begin = np.flatnonzero(first[:-1])
        found = highest(self.rows, row, begin)
        sentence = np.searchsorted(begin, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])))
        return np.split(found, sentence[:-1])


def highest(rows: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The maxima of ``rows[at]`` over stretches that begin at ``start``; neighbours are compared by pairs, again and again."""
    size = np.diff(start, append=len(at))
    while True:
        half = (size + 1) // 2
        begin = np.cumsum(half) - half
        a = np.repeat(start - 2 * begin, half) + 2 * np.arange(int(half.sum()))
        b = np.minimum(a + 1, np.repeat(start + size - 1, half))
        rows = np.maximum(rows[at[a]], rows[at[b]]) if at is not None else np.maximum(rows[a], rows[b])
        start, size, at = begin, half, None
        if not len(size) or size.max() == 1:
            return rows


_describers: dict[tuple, Describer] = {}


def describer_of(landmarks: list[str], decay: float) -> Describer:
    """The worker's describer for these landmarks; another set of them takes its place."""
    remembers("toxicity", _describers.clear)
    key = (tuple(landmarks), decay)
    if key not in _describers:
        _describers.clear()
        _describers[key] = Describer(Kernel(landmarks, decay))
    return _describers[key]


@dataclass
class Model:
    landmarks: list[str]
    decay: float
    weights: np.ndarray  # of kernel values, the whitening folded in
    bias: float
    curve: np.ndarray  # of the features of a document, the constant last

    def margins(self, sentences: np.ndarray) -> np.ndarray:
        return sentences.astype(np.float32) @ (self.weights / 255) + self.bias

    def score(self, margins: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(_top(margins) @ self.curve, -30, 30))))


def _top(margins: np.ndarray) -> np.ndarray:
    """What a document's score sees: its five highest margins, and a constant."""
    five = np.full(5, -1.0)  # where a clean sentence lies
    high = np.sort(margins)[::-1][:5]
    five[:len(high)] = np.clip(high, -3, 3)
    return np.array([*five, 1.0])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents each word stands in."""
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in arrays(batch, "toxic", "text"):
            counts[toxic].update({x for w in set((text or b"").split()) for x in clean(w) if len(x) > 2})
    words = list(counts[0].keys() | counts[1].keys())
    for s in range(0, len(words), 50_000):
        w = words[s:s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([counts[0][x] for x in w], pa.int64()),
                                          pa.array([counts[1][x] for x in w], pa.int64())], ["word", "clean", "toxic"])


def _describe(landmarks: list[str], p: Toxicity):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = describer_of(landmarks, p.decay)
        for batch in batches:
            toxic, texts = zip(*arrays(batch, "toxic", "text"), strict=True) if batch.num_rows else ((), ())
            found = []
            for m in describer.texts(list(texts)):
                m = np.unique(m, axis=0) if len(m) else m
                found.append(m[np.argsort(-m.max(axis=1).astype(np.int64), kind="stable")[:p.sentences]].tobytes()
                             if len(m) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.binary())], ["toxic", "found"])
    return job


BLOCK = 4096  # described sentences that are turned into numbers of eight bytes at a time


def _blocks(cells: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows ``at`` of the bytes as doubles with a constant at the end, a few at a time."""
    for s in range(0, len(at), BLOCK):
        some = cells[at[s:s + BLOCK]]
        wide = np.ones((len(some), some.shape[1] + 1))
        wide[:, :-1] = some
        yield slice(s, s + len(some)), wide


def _margins(cells: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for place, wide in _blocks(cells, at):
        out[place] = wide @ w
    return out


def _svm(cells: np.ndarray, at: np.ndarray, y: np.ndarray, c: np.ndarray, turn: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared hinge loss by Newton steps over rows ``at``, described by their bytes and a constant times ``turn``; the last
    column is constant. ``c`` is one number per class. Only sums of products over a class are kept, so the rows stay bytes."""
    w = np.zeros(turn.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        on = y * _margins(cells, at, turn @ w) < 1
        gram, pull = np.zeros((len(turn), len(turn))), np.zeros(len(turn))
        for sign in (-1.0, 1.0):
            some = on & (y == sign)
            if some.any():
                part = sum(wide.T @ wide for _, wide in _blocks(cells, at[some]))
                cost = c[some][0]
                gram += cost * part
                pull += sign * cost * part[-1]
        new = np.linalg.solve(turn.T @ gram @ turn + np.diag(reg), turn.T @ pull)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - q) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model | None:
    """A model of the labelled training rows; None when a class or every landmark is missing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(id_remainder("doc_id", p.modulus) != p.held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    picked = [known.where(F.col("toxic") == t).orderBy(order).limit(p.sample).collect() for t in (0, 1)]
    if not all(picked):
        return None
    chosen = docs.sparkSession.createDataFrame([tuple(r) for rows in picked for r in rows], "id long, toxic int")
    # At most 2 * sample rows are broadcast.
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("toxic", "text")
    stats = train.mapInArrow(_words, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = len(picked[0]), len(picked[1])
    rate = (F.col("clean") + F.col("toxic") + 1) / F.lit(n0 + n1 + 2.0)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-9)
    best = stats.where(F.col("toxic") >= p.least_documents).orderBy(z.desc(), "word").limit(p.pool * p.landmarks).collect()
    usual = stats.orderBy(F.col("clean").desc(), "word").limit(p.contrast + p.pool * p.landmarks).collect()
    if not best:
        return None
    landmarks = set_apart([r.word for r in best], p)
    landmarks += [r.word for r in usual if r.word not in set(landmarks)][:p.contrast]
    rows = train.mapInArrow(_describe(landmarks, p), "toxic int, found binary").collect()
    return learn(landmarks, [(r.toxic, np.frombuffer(r.found, np.uint8).reshape(-1, len(landmarks))) for r in rows], p)


def set_apart(words: list[str], p: Toxicity) -> list[str]:
    """Of words in order, those that are unlike all words taken before; then the rest in order, while there is room. Near
    variants of one word so don't crowd out the words of other languages."""
    alike = Kernel(words, p.decay)(words) ** (1 / POWER) > p.alike
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < p.landmarks and not alike[i, taken].any():
            taken.append(i)
    rest = [i for i in range(len(words)) if i not in set(taken)]
    return [words[i] for i in [*taken, *rest][:p.landmarks]]


def learn(landmarks: list[str], rows: list[tuple[int, np.ndarray]], p: Toxicity) -> Model | None:
    """The machine from described training documents. Their sentences stay bytes: the driver never holds them all as numbers."""
    rows = [r for r in rows if len(r[1])]
    toxic = np.array([t for t, _ in rows])
    if not len(rows) or toxic.min() == toxic.max():
        return None
    gram = Kernel(landmarks, p.decay)(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    white = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    counts = [len(m) for _, m in rows]
    cells = np.concatenate([m for _, m in rows])
    turn = np.eye(len(landmarks) + 1)
    turn[:-1, :-1] = white / 255
    owner = np.repeat(np.arange(len(rows)), counts)
    every = np.arange(len(cells))
    label = toxic[owner]
    margin = cells.max(axis=1).astype(np.float64)
    for _ in range(p.rounds):
        # A toxic document lends its label to its three most suspicious sentences.
        order = np.lexsort((-margin, owner))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        use = (label == 0) | (place < 3)
        y = np.where(label[use] == 1, 1.0, -1.0)
        c = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * 100
        w = _svm(cells, np.flatnonzero(use), y, c, turn)
        margin = _margins(cells, every, turn @ w)
    docs = np.array([_top(m) for m in np.split(margin, np.cumsum(counts)[:-1])])
    curve = _logistic(docs, toxic.astype(np.float64))
    return Model(landmarks, p.decay, white @ w[:-1], float(w[-1]), curve)


def _score(model: Model | None):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = describer_of(model.landmarks, model.decay) if model else None
        for batch in batches:
            scores = []
            for s in range(0, batch.num_rows, 200):
                texts = column(batch.slice(s, 200), "text")
                scores += [model.score(model.margins(m)) for m in describer.texts(texts)] if model else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "held_out", "text_key")]
                + [pa.array(scores, pa.float64())], ["doc_id", "held_out", "text_key", "score"])
    return job


def classify(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, text_key.

    A NULL or empty text has no sentence and gets the score of a document without any match. A NULL id is not held out and
    never learnt from; repeated rows are scored each; of labels that contradict each other the toxic one counts. Without
    labels of both classes every score is 0. An empty table gives an empty result. Only doc_id and text are read.
    """
    model = fit(docs, labels, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        id_remainder("doc_id", p.modulus) == p.held, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, text_key long, score double").select(
        "doc_id", "held_out", "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"), "text_key")
