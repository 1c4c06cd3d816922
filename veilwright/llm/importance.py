"""Importance resampling towards a target distribution (hashed n-gram features, Gumbel top-k).

An untrained ``Split`` of the tokenizers library cuts the ASCII-lowered text at a regular expression and returns words with
offsets. Windows are pairs of offsets; each window's CRC picks a bucket. Corpus and target fill one histogram of buckets each, a
bucket's gain is the log ratio of its shares, a document's weight the mean gain of its windows. Weights plus Gumbel noise from a
hash of the id are ranked, which draws without replacement in proportion to the importance.

Texts are cut into words once: each document's buckets are staged beside its id, and histograms and weights are numpy
sums over them. Only histograms (``buckets`` numbers) reach the driver. Ranks come from range partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import row_ranks
from ..functions.staging import stage
from .common import Memo, arrays, texts

#: Bytes below 0x80 that are no ASCII letter or digit become blanks; everything else is part of a word.
BLANKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 1 << 20


@dataclass(frozen=True)
class Resampling:
    """Windows of 1 to ``words`` words; ``percent`` of the documents with ``least_words`` words or more are drawn. ``seed`` is
    the text before the id in the hash that makes the noise."""

    words: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def chunks(text: bytes, size: int = CHUNK) -> Iterator[str]:
    """The text, lowered and with blanks for all that is no word, in parts of about ``size`` bytes that end at a blank."""
    plain = text.lower().translate(BLANKS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].decode("utf-8", "replace")
        at = end


class Features:
    """Buckets of the windows of a text."""

    def __init__(self, p: Resampling) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.p = p
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.dtype = np.dtype("<u2" if p.buckets <= 1 << 16 else "<u4")
        self.bucket = Memo(lambda s: zlib.crc32(s.encode()) % p.buckets, 400_000)

    def of(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """Number of words and the bucket of each window, repeats kept. No text has none."""
        n_words, found, tail = 0, [], ""
        for part in chunks(text or b""):
            # The last words of the part before go in front, for windows that reach over the cut.
            before = len(tail.split(" ")) if tail else 0
            line = f"{tail} {part}" if tail else part
            pieces = self.split.pre_tokenize_str(line)
            n_words += len(pieces) - before
            for k in range(1, self.p.words + 1):
                first = max(0, before - k + 1)  # earlier windows belong to the part before
                found.append(self._windows(line, pieces, k, first))
            if self.p.words > 1:
                tail = " ".join([w for w, _ in pieces[-(self.p.words - 1):]])
        return n_words, np.concatenate(found) if found else np.empty(0, self.dtype)

    def _windows(self, line: str, pieces: list, k: int, first: int) -> np.ndarray:
        get = self.bucket.__getitem__
        if k == 1:
            names = [w for w, _ in pieces[first:]]
        else:
            names = []
            for i in range(first, len(pieces) - k + 1):
                start, end = pieces[i][1][0], pieces[i + k - 1][1][1]
                if end - start == sum(len(w) for w, _ in pieces[i:i + k]) + k - 1:
                    names.append(line[start:end])
                else:  # more than one blank between two words
                    names.append(" ".join([w for w, _ in pieces[i:i + k]]))
        return np.fromiter(map(get, names), self.dtype, len(names))


FEATURES = "doc_id long, text_key long, n_words long, n_features long, buckets binary"


def _describe(p: Resampling):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(p)
        for batch in batches:
            words, sizes, cells = [], [], []
            for (text,) in arrays(batch, "text"):
                n, found = features.of(text)
                words.append(n)
                sizes.append(len(found))
                cells.append(found.tobytes())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())],
                ["doc_id", "text_key", "n_words", "n_features", "buckets"])
    return job


def features(rows: DataFrame, p: Resampling, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_features, buckets (binary, little-endian)."""
    return texts(rows, id_column).withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(p), FEATURES)


def _cells(batch: pa.RecordBatch, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch one after another, and how many each row has."""
    sizes = batch.column(batch.schema.get_field_index("n_features")).to_numpy().astype(np.int64)
    cells = batch.column(batch.schema.get_field_index("buckets")).to_pylist()
    return np.frombuffer(b"".join(cells), dtype), sizes


def histogram(found: DataFrame, p: Resampling) -> DataFrame:
    """bucket, n: summed inside each task first, so that a task sends at most one row per bucket."""
    dtype = np.dtype("<u2" if p.buckets <= 1 << 16 else "<u4")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch, dtype)[0], minlength=p.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return found.select("n_features", "buckets").mapInArrow(job, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, p: Resampling) -> DataFrame:
    """bucket, gain for every bucket, from two histograms."""
    buckets = corpus.sparkSession.range(p.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = buckets.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = {"all_s": corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(),
             "all_t": target.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()}

    def number(name: str, more: int) -> Column:
        return F.col(name).cast("double") + F.lit(float(more))

    ratio = number("t", 1) * number("all_s", p.buckets) / (number("s", 1) * number("all_t", p.buckets))
    return both.withColumns(whole).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


WEIGHTS = "doc_id long, text_key long, n_words long, n_features long, weight long"


def _weigh(table, p: Resampling):
    dtype = np.dtype("<u2" if p.buckets <= 1 << 16 else "<u4")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            cells, sizes = _cells(batch, dtype)
            sums = np.concatenate(([0], np.cumsum(gain[cells])))
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.int64())],
                                             ["doc_id", "text_key", "n_words", "n_features", "weight"])
    return job


def _noise(p: Resampling) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling(), target_id: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (NULL: not drawn), text_key.

    NULL and empty texts have no words, no features and weight 0; invalid UTF-8 counts as U+FFFD. A NULL id gives a NULL score
    and is never drawn, though its words count in the corpus. Rows that repeat an id are rows of their own; ties of score go to
    the smaller doc_id, then to the smaller hash of the text. Empty tables give no rows; an empty target leaves weights that
    favour rare buckets. Only id and text are read, other columns don't matter.
    """
    found = stage(features(docs, p), "features")
    wanted = features(target, p, target_id)
    table = gains(stage(histogram(found, p), "histogram"), stage(histogram(wanted, p), "histogram"), p).orderBy("bucket").collect()
    gain = docs.sparkSession.sparkContext.broadcast(np.array([r.gain for r in table], np.int64))
    scored = stage(found.mapInArrow(_weigh(gain, p), WEIGHTS).withColumn("score", F.col("weight") + _noise(p)), "scores")

    able = (F.col("n_words") >= p.least_words) & F.col("score").isNotNull()
    by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"))
    wanted_rows, taken, least = None, 0, None
    counts = [(r.score, r.n) for r in by_score.collect()]  # one row per distinct whole number: some ten thousands at any size
    wanted_rows = sum(n for _, n in counts) * p.percent // 100
    for score, n in counts:
        if taken >= wanted_rows:
            break
        taken, least = taken + n, score
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank", "text_key"]
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none).select(*columns)
    high = F.coalesce(able & (F.col("score") >= least), F.lit(False))
    ranked = row_ranks(scored.where(high).withColumn("order", -F.col("score")), [], ["order", "doc_id", "text_key"], "place")
    drawn = F.when(F.col("place") < wanted_rows, F.col("place") + 1)
    return ranked.withColumn("rank", drawn.cast("long")).select(*columns).unionByName(
        scored.where(~high).withColumn("rank", none).select(*columns))
