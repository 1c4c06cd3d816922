"""Language-model scores by prediction by partial matching over bytes, next to a unigram base of words.

*Model.* A trie of byte contexts: the counts of every byte after its last ``order`` bytes, and by summing along the path after fewer
bytes, down to none. A byte is coded in its longest context; one that never followed there costs an escape, whose probability is
estimated from the number of distinct followers (method D: q followers among n bytes leave q/2n to the escape, a follower seen c times
gets (2c-1)/2n), and the followers seen above are excluded from the next shorter context. Below order 0 all bytes left are equally
likely. The end of a text is a symbol too (0xFF, which UTF-8 never uses), so the probabilities of all texts sum to one.

*Base.* The smoothed share of each word in the training texts.

*Plan.* The trie grows with the corpus and is nowhere in one piece. Texts are cut into chunks of bounded size, each with its distinct
words and its distinct (context, byte) pairs. A chunk sends them packed, one row to each bucket: words by hash, pairs by
the two bytes before the coded one, so a bucket holds whole subtrees from depth two on; the two levels above them are a table of 256
x 256 counts. A bucket adds the counts of all chunks up, works out counts and log probabilities once for each distinct key,
and sends them back the same way. A common word or context is one entry per chunk, so no bucket grows with one key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import arrays, id_remainder, mix, partitions, split_words, word_hashes

END = b"\xff"
WORD, PAIR, TEXT = 0, 1, 2  # kinds of rows, in the order in which a chunk is put together again
DOCS = 60_000  # documents whose bytes are sorted together: an index has 16 bits


@dataclass(frozen=True)
class Scoring:
    """Rows with crc32(doc_id) % ``held_modulus`` = 0 are held out. ``order``: bytes of context, 2 to 5. ``chunk_bytes`` close a
    chunk (a longer text is one by itself); there is a bucket of either kind for every ``bucket_bytes`` of text, and
    ``least_buckets`` at least."""

    held_modulus: int = 10
    order: int = 5
    chunk_bytes: int = 6_000_000
    bucket_bytes: int = 64_000_000
    least_buckets: int = 16

    def __post_init__(self) -> None:
        if not 2 <= self.order <= 5:
            raise ValueError("order must be 2 to 5: a pair and the index of a document share 64 bits")


def pairs_of(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte of each text and its end: the bytes before it, the last one highest, and below them the byte itself."""
    pad = b"\x00" * order
    b = np.frombuffer(b"".join([x for t in texts for x in (pad, t, END)]), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64) + 1
    coded = np.ones(len(b), bool)
    first = np.cumsum(lens + order) - lens - order
    for i in range(order):
        coded[first + i] = False
    keys = b.astype(np.uint64)
    for j in range(1, order + 1):
        before = b[:-j].astype(np.uint64)
        before <<= np.uint64(8 * (order + 1 - j))
        keys[j:] |= before
    return keys[coded]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where equal keys begin."""
    return np.flatnonzero(np.concatenate((sorted_keys[:1] == sorted_keys[:1], sorted_keys[1:] != sorted_keys[:-1])))


def _bucket(keys: np.ndarray, kind: int, buckets: int, order: int) -> np.ndarray:
    if kind == PAIR:
        keys = mix(keys >> np.uint64(8 * order - 8))  # the two bytes before
    return (keys % np.uint64(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, kind: int, buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted keys by bucket, the buckets in use and where each begins."""
    of = _bucket(keys, kind, buckets, order)
    place = np.argsort(of, kind="stable")
    first = _runs(of[place])
    return place, of[place][first], np.append(first, len(of))


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return zlib.compress(numbers.astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _keys(data: bytes) -> np.ndarray:
    """Sorted keys from their packed differences."""
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


SENT = ("kind int, part int, seq int, bucket int, keys binary, counts binary, doc_ids array<long>, held array<boolean>, "
        "lens array<int>, texts binary, train_words long, train_docs long, low binary")
SENT_KINDS = [pa.int32()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
                                                   pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    cells = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)],
                                      [x.split()[0] for x in schema.split(", ")])


class Chunk:
    """Documents that are scored together."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        words = [word_hashes(split_words(t)) for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.words, self.word_at = np.unique(np.concatenate(words), return_inverse=True)
        self.lens = np.array([len(t) + 1 for t in texts], np.int64)
        # Keys with the index of their document below them: one sort of numbers groups equal pairs.
        self.pieces = []
        for s in range(0, len(texts), DOCS):
            some = texts[s:s + DOCS]
            keys = pairs_of(some, order)  # eight bytes for each of the text: everything is done in place
            keys <<= np.uint64(16)
            keys |= np.repeat(np.arange(len(some), dtype=np.uint64), self.lens[s:s + DOCS])
            keys.sort()
            self.pieces.append(keys)
        runs = [p[_runs(p >> np.uint64(16))] >> np.uint64(16) for p in self.pieces]
        self.pairs = runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))

    def counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word and pair, how often it stands in the documents to learn from."""
        words = np.bincount(self.word_at[np.repeat(learn, self.n_words)], minlength=len(self.words))
        pairs = np.zeros(len(self.pairs), np.int64)
        for s, piece in enumerate(self.pieces):
            first = _runs(piece >> np.uint64(16))
            known = learn[s * DOCS:(s + 1) * DOCS][piece.astype(np.uint16)]  # the low 16 bits are the document
            pairs[np.searchsorted(self.pairs, piece[first] >> np.uint64(16))] += np.add.reduceat(known, first, dtype=np.int64)
        return words, pairs

    def sums(self, logs: np.ndarray) -> np.ndarray:
        """Per document, the sum of its pairs' values."""
        out = []
        for s, piece in enumerate(self.pieces):
            first = _runs(piece >> np.uint64(16))
            value = np.repeat(logs[np.searchsorted(self.pairs, piece[first] >> np.uint64(16))], np.diff(np.append(first, len(piece))))
            out.append(np.bincount(piece.astype(np.uint16), value, len(self.lens[s * DOCS:(s + 1) * DOCS])))
        return np.concatenate(out)


def _send(p: Scoring, buckets: int):
    """Chunks: a row with the texts, and a row of keys and counts for each bucket."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk = Chunk(texts, p.order)
            learn = ~np.array(held, bool)
            counts = chunk.counts(learn)
            low = np.bincount(((chunk.pairs >> np.uint64(8 * p.order)) << np.uint64(8) | (chunk.pairs & np.uint64(255))).astype(np.int64),
                              counts[1], 1 << 16)
            rows = []
            for kind, keys, n in ((WORD, chunk.words, counts[0]), (PAIR, chunk.pairs, counts[1])):
                place, used, first = _by_bucket(keys, kind, buckets, p.order)
                for b, a, z in zip(used.tolist(), first, first[1:], strict=False):
                    own = keys[place[a:z]]
                    rows.append((kind, part, seq, b, _packed(np.diff(own, prepend=np.uint64(0)), "<u8"), _packed(n[place[a:z]], "<u8"),
                                 *[None] * 7))
            yield _batch(rows, SENT_KINDS, SENT)
            yield _batch([(TEXT, part, seq, 0, None, None, ids, held, [len(t) for t in texts], zlib.compress(b"".join(texts), 1),
                           int(chunk.n_words[learn].sum()), int(learn.sum()), _packed(low, "<u8"))], SENT_KINDS, SENT)

        for batch in batches:
            for doc, h, text in arrays(batch, "doc_id", "held_out", "text"):
                ids.append(doc)
                held.append(h)
                texts.append(text or b"")
                size += len(texts[-1]) + 16
                if size >= p.chunk_bytes:
                    yield from out()
                    seq += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield from out()
    return job


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (last byte, byte) over the chunks of a task."""
    total = np.zeros(1 << 16, np.uint64)
    for batch in batches:
        for (data,) in arrays(batch, "low"):
            total += _unpacked(data, "<u8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["pair", "n"])


class Subtrees:
    """All (context, byte) pairs below some two-byte contexts, sorted, with their training counts; ``low`` holds the counts of bytes
    after their last byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> None:
        self.keys, self.counts, self.order = keys, counts.astype(np.float64), order
        known = counts > 0
        self.levels = []  # per order: (context, byte) in training, counts
        for d in range(order, -1, -1):
            if d >= 2:
                at = self._at(keys[known], d)
                values, place = np.unique(at, return_inverse=True)
                self.levels.append((d, values, np.bincount(place, self.counts[known], len(values))))
            else:
                n = low.reshape(256, 256) if d else low.reshape(256, 256).sum(axis=0)[None, :]
                cell = np.flatnonzero(n)
                self.levels.append((d, cell.astype(np.uint64), n.reshape(-1)[cell].astype(np.float64)))

    def _at(self, keys: np.ndarray, d: int) -> np.ndarray:
        """The byte in its context of ``d`` bytes."""
        context = (keys >> np.uint64(8)) >> np.uint64(8 * (self.order - d))
        return (context << np.uint64(8)) | (keys & np.uint64(255))

    def logs(self) -> np.ndarray:
        """log10 of the probability of each pair's byte in its context."""
        out = np.zeros(len(self.keys))
        context = self.keys >> np.uint64(8)
        first = _runs(context)
        size = np.diff(np.append(first, len(context)))
        n = np.repeat(np.add.reduceat(self.counts, first), size) if len(first) else out
        seen = np.flatnonzero(self.counts > 0)
        out[seen] = np.log10((2 * self.counts[seen] - 1) / (2 * n[seen]))
        new = np.flatnonzero(self.counts == 0)
        for s in range(0, len(new), 8192):
            out[new[s:s + 8192]] = self.escaped(self.keys[new[s:s + 8192]])
        return out

    def escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same for any pairs, followed from the longest context down."""
        out = np.zeros(len(keys))
        byte = (keys & np.uint64(255)).astype(np.int64)
        gone = np.zeros((len(keys), 256), bool)
        open_ = np.arange(len(keys))
        for d, values, counts in self.levels:
            if not len(open_):
                break
            context = self._at(keys[open_], d) & ~np.uint64(255)
            low = np.searchsorted(values, context)
            size = np.searchsorted(values, context | np.uint64(255), "right") - low
            ends = np.cumsum(size)
            row = np.repeat(np.arange(len(open_)), size)
            cell = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
            follower = (values[cell] & np.uint64(255)).astype(np.int64)
            left = ~gone[open_[row], follower]
            row, cell, follower = row[left], cell[left], follower[left]
            n = np.bincount(row, counts[cell], len(open_))
            kinds = np.bincount(row, minlength=len(open_))
            c = np.bincount(row, counts[cell] * (follower == byte[open_][row]), len(open_))
            hit, miss = c > 0, (c == 0) & (kinds > 0)
            out[open_[hit]] += np.log10((2 * c[hit] - 1) / (2 * n[hit]))
            out[open_[miss]] += np.log10(kinds[miss] / (2 * n[miss]))
            gone[open_[row], follower] = True
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(1, 256 - gone[open_].sum(axis=1)))
        return out


VALUES = "part int, seq int, kind int, bucket int, values binary, new_words long"


def _answer(low, p: Scoring):
    """A bucket's keys from all chunks: counts of words, log probabilities of pairs, back to each chunk."""
    def job(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [_keys(k) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(c, "<u8") for c in table.column("counts").to_pylist()]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)  # exact below 2**53
        if kind == WORD:
            values, form = total, "<u8"
        else:
            values, form = Subtrees(distinct, total, low.value, p.order).logs(), "<f4"
        ends = np.cumsum([len(k) for k in keys])
        rows = [(part, seq, kind, bucket, _packed(values[place[e - len(k):e]], form), 0)
                for part, seq, k, e in zip(table.column("part").to_pylist(), table.column("seq").to_pylist(), keys, ends, strict=True)]
        rows[0] = (*rows[0][:5], int((total > 0).sum()) if kind == WORD else 0)
        made = _batch(rows, [pa.int32()] * 4 + [pa.binary(), pa.int64()], VALUES)
        return pa.Table.from_batches([made])
    return job


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double"


def _finish(p: Scoring, buckets: int, end_count: int):
    """Rows sorted by chunk, the values by kind and bucket before the texts: scores."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        for batch in batches:
            for kind, data, ids, held, lens, texts in arrays(batch, "kind", "values", "doc_ids", "held", "lens", "texts", rows=64):
                if kind != TEXT:
                    values[kind].append(_unpacked(data, "<u8" if kind == WORD else "<f4").astype(np.float64))
                    continue
                whole, ends = zlib.decompress(texts), np.cumsum(lens).tolist()
                chunk = Chunk([whole[e - n:e] for e, n in zip(ends, lens, strict=True)], p.order)
                found = []
                for k, keys in ((WORD, chunk.words), (PAIR, chunk.pairs)):
                    v = np.zeros(len(keys))
                    if len(keys):
                        v[_by_bucket(keys, k, buckets, p.order)[0]] = np.concatenate(values[k])
                    found.append(v)
                    values[k] = []
                n = chunk.n_words
                known, logs = np.zeros(len(n), np.int64), np.zeros(len(n))
                some = np.flatnonzero(n)
                if len(some):
                    c = found[0][chunk.word_at]
                    first = (np.cumsum(n) - n)[some]
                    logs[some] = np.add.reduceat(np.log10(c + 0.1), first)
                    known[some] = np.add.reduceat((c > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n + 1), pa.array(known + (end_count > 0)),
                     pa.array(logs + np.log10(end_count + 0.1)), pa.array(chunk.sums(found[1]))],
                    [x.split()[0] for x in RESULT.split(", ")])
    return job


def score(docs: DataFrame, p: Scoring = Scoring()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A NULL text is an empty one (its only token is the end); a row with a NULL id is learnt from; repeated rows count each;
    an empty table gives an empty result. Without training rows every count is 0 and all bytes are equally likely. Words are told
    apart by 64-bit hashes. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        id_remainder("doc_id", p.held_modulus) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(p.least_buckets, size // p.bucket_bytes)

    sent = stage(rows.mapInArrow(_send(p, buckets), SENT), "chunks")
    chunks = sent.where(F.col("kind") == TEXT)
    low = np.zeros(1 << 16, np.int64)
    for r in chunks.select("low").mapInArrow(_low, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        low[r.pair] = r.n  # at most 65,536 rows
    shared = spark.sparkContext.broadcast(low)
    blobs = sent.where(F.col("kind") != TEXT).select("kind", "bucket", "part", "seq", "keys", "counts")
    answers = stage(blobs.groupBy("kind", "bucket").applyInArrow(_answer(shared, p), VALUES), "answers")

    words, ends = chunks.agg(F.coalesce(F.sum("train_words"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    kinds = answers.agg(F.coalesce(F.sum("new_words"), F.lit(0))).first()[0] + (ends > 0)
    total = words + ends
    base = float(np.log10(total + 0.1 * (kinds + 1)))
    nothing = {"values": "binary", "doc_ids": "array<long>", "held": "array<boolean>", "lens": "array<int>", "texts": "binary"}
    columns = ["part", "seq", "kind", "bucket", *nothing]
    both = answers.select(*[F.col(c) if c in answers.columns else F.lit(None).cast(nothing[c]).alias(c) for c in columns]).unionByName(
        chunks.select(*[F.col(c) if c in chunks.columns else F.lit(None).cast(nothing[c]).alias(c) for c in columns]))
    done = both.repartition(partitions(spark), "part", "seq").sortWithinPartitions("part", "seq", "kind", "bucket").mapInArrow(
        _finish(p, buckets, int(ends)), RESULT)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                       (F.col("log_sum") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score")
