"""Phrases whose words stand together more often than apart, from suffix trees built group by group.

The text's suffixes, cut off at ``longest`` words or the end of a piece, are partitioned vertically by the words they begin with:

1. Scan ``k`` counts the prefixes of ``k`` words whose first ``k - 1`` words are a heavy prefix (scan 1: all words). A prefix of more
   suffixes than the memory budget is heavy and is extended by another word in the next scan.
2. The prefixes that are not heavy, in order, are cut into groups of one budget (less than two). Only the first prefix of each group and
   the heavy prefixes are broadcast: at most two entries per budget of words.
3. Every suffix goes to the group of its prefix, equal ones of a task with a count. A task sends one row to each group: the words in
   use, and the suffixes as codes of these. A group is one task's work: it sorts its suffixes, which are the leaves of its truncated subtree, and adds up leaf totals at each inner node. A node's prefixes lie on
   its path, so their counts come with it.

Scores need the counts of a phrase's last words too, which lie in other subtrees: a join of distinct phrases. Heavy ones are answered
by a broadcast, so a key meets only as many phrases as a budget holds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import prefix_sums
from ..functions.staging import stage
from .common import arrays, partitions

#: One byte for every end of a piece; the words are split at white space, which is blank and tab once these are gone.
ENDS = bytes(0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
SLICE = 32_768  # words in one step
CODES = 1 << 16  # distinct words in one chunk, so that four of them fit in 64 bits


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to 4 words that occur ``least`` times or more in a language; of those not inside a longer one that occurs at
    ``inside`` percent of their count or more, the ``top`` by score. A group holds about ``budget`` suffixes (or all that begin with
    the same four words); smaller tables are cut into as many groups as there are shuffle partitions, down to ``small``. A mapper
    counts equal suffixes among ``chunk`` at a time."""

    least: int = 30
    inside: int = 80
    top: int = 2000
    scale: int = 2_000_000
    budget: int = 1_000_000
    small: int = 50_000
    chunk: int = 4_000_000


LONGEST = 4


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lowered, with ``.`` where a piece ends."""
    return text.lower().translate(ENDS).replace(b".", b" . ").split()


class Chunk:
    """Words of one language as codes. Code 0 is the end of a piece."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {b".": 0}
        self.windows: list[np.ndarray] = []
        self.size = 0

    def holds(self, words: list[bytes]) -> bool:
        """Whether there is room for the codes of more words."""
        return len(self.codes) + len(words) <= CODES or len(self.codes) + len(set(words).difference(self.codes)) <= CODES

    def add(self, words: list[bytes], ahead: list[bytes]) -> None:
        """The suffixes that begin at ``words``; ``ahead``: up to three words that follow."""
        codes = self.codes
        for w in set(words).union(ahead).difference(codes):
            codes[w] = len(codes)
        all_words = words + ahead
        flat = np.zeros(len(words) + LONGEST, np.uint64)
        flat[:len(all_words)] = np.fromiter(map(codes.__getitem__, all_words), np.uint64, len(all_words))
        n = len(words)
        at = flat[:n]
        window, open_ = at << np.uint64(48), at > 0
        for k in range(1, LONGEST):
            open_ = open_ & (flat[k:k + n] > 0)
            window |= np.where(open_, flat[k:k + n], np.uint64(0)) << np.uint64(48 - 16 * k)
        window = window[at > 0]
        self.windows.append(window)
        self.size += len(window)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes in the order of their codes, and how often each occurs."""
        if not self.windows:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        whole = np.sort(np.concatenate(self.windows))
        first = np.flatnonzero(np.concatenate((whole[:1] == whole[:1], whole[1:] != whole[:-1])))
        return whole[first], np.diff(np.append(first, len(whole)))


def _codes(windows: np.ndarray, k: int) -> np.ndarray:
    return ((windows >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, Chunk]]:
    """Full chunks by language. At most about ``limit`` suffixes are open at a time, over all languages."""
    chunks: dict[str, Chunk] = {}
    waiting: dict[str, list[bytes]] = {}
    size = 0

    def take(lang: str, some: list[bytes], ahead: list[bytes]) -> Iterator[tuple[str, Chunk]]:
        nonlocal size
        chunk = chunks.setdefault(lang, Chunk())
        if not chunk.holds(some + ahead):
            size -= chunk.size
            yield lang, chunks.pop(lang)
            chunk = chunks.setdefault(lang, Chunk())
        before = chunk.size
        chunk.add(some, ahead)
        size += chunk.size - before
        if size >= limit:
            yield from chunks.items()
            chunks.clear()
            size = 0

    for batch in batches:
        for lang, text in arrays(batch, "lang", "text"):
            words = waiting.setdefault(lang, [])
            words += words_of(text) if text else []
            words.append(b".")
            if len(words) >= 2 * SLICE:
                at = 0
                while len(words) - at >= SLICE + LONGEST:
                    yield from take(lang, words[at:at + SLICE], words[at + SLICE:at + SLICE + LONGEST - 1])
                    at += SLICE
                del words[:at]
    for lang, words in waiting.items():
        for at in range(0, len(words), SLICE):
            yield from take(lang, words[at:at + SLICE], words[at + SLICE:at + SLICE + LONGEST - 1])
    yield from chunks.items()


def _spelled(chunk: Chunk) -> pa.Array:
    """The word of each code; none for code 0."""
    return pa.array([b"", *list(chunk.codes)[1:]], pa.binary())


def _joined(words: pa.Array, windows: np.ndarray, k: int) -> pa.Array:
    """The first ``k`` words of each suffix with a blank after each but the last; words that are not there are empty."""
    columns = [words.take(pa.array(_codes(windows, i))) for i in range(k)]
    return columns[0] if k == 1 else pc.binary_join_element_wise(*columns, b" ")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, np.int64)


PREFIXES = "lang string, prefix binary, n long"


def _scan(k: int, heavy, limit: int):
    """Counts of prefixes of ``k`` words below heavy ones of ``k - 1``."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = heavy.value if heavy else None
        for lang, chunk in _chunks(batches, limit):
            windows, n = chunk.counted()
            if not len(windows):
                continue
            words = _spelled(chunk)
            if wanted is not None:
                short = windows >> np.uint64(64 - 16 * (k - 1))
                first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
                names = _joined(words, windows[first], k - 1).to_pylist()
                of = np.array([(lang, x) in wanted for x in names])
                keep = np.repeat(of, np.diff(np.append(first, len(short))))
                windows, n = windows[keep], n[keep]
                if not len(windows):
                    continue
            short = windows >> np.uint64(64 - 16 * k)
            first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()), _joined(words, windows[first], k), pa.array(_sums(n, first))],
                ["lang", "prefix", "n"])
    return job


@dataclass
class Partition:
    """``heavy``: counts of heavy prefixes by (lang, prefix). ``starts``: the first prefix of each group, each word with a blank
    after it, in order."""

    heavy: dict[tuple[str, bytes], int]
    starts: list[tuple[str, bytes]]

    def group(self, lang: str, suffix: bytes) -> int:
        return bisect_right(self.starts, (lang, suffix)) - 1


def _partition(rows: DataFrame, p: Collocations) -> tuple[DataFrame, DataFrame, Partition]:
    """n by language, counts of words and the groups."""
    spark = rows.sparkSession
    first = stage(rows.mapInArrow(_scan(1, None, p.chunk), PREFIXES).groupBy("lang", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    totals = stage(first.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(p.small, min(p.budget, -(-total // partitions(spark))))
    heavy: dict[tuple[str, bytes], int] = {}
    light = []
    level = first
    for k in range(1, LONGEST + 1):
        found = [] if k == LONGEST else level.where(F.col("n") > budget).collect()  # at most total / budget rows
        heavy |= {(r.lang, bytes(r.prefix)): r.n for r in found}
        light.append(level if k == LONGEST else level.where(F.col("n") <= budget))
        now = {(r.lang, bytes(r.prefix)) for r in found}
        if not now:
            break
        counted = rows.mapInArrow(_scan(k + 1, spark.sparkContext.broadcast(now), p.chunk), PREFIXES)
        level = stage(counted.groupBy("lang", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    whole = light[0]
    for more in light[1:]:
        whole = whole.unionByName(more)
    # A prefix and a blank: no prefix is the beginning of another, so all suffixes of one lie between it and the next.
    order = whole.select("lang", F.concat("prefix", F.lit(b" ")).alias("prefix"), "n")
    placed = prefix_sums(order, [], ["lang", "prefix"], ["n"])
    begins = placed.groupBy(F.floor(F.col("n_before") / budget).alias("g")).agg(
        F.min(F.struct("lang", "prefix")).alias("s")).orderBy("g").collect()  # at most total / budget + 1 rows
    return totals, first, Partition(heavy, [(r.s.lang, bytes(r.s.prefix)) for r in begins])


SUFFIXES = "group int, lang string, words binary, codes binary, counts binary"


class Outbox:
    """Suffixes of one language on their way to the groups: codes of a task's own vocabulary, counts, and the group of each."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"": 0}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, chunk: Chunk, windows: np.ndarray, n: np.ndarray, group: np.ndarray) -> None:
        words = self.words
        of = np.fromiter((words.setdefault(w, len(words)) for w in [b"", *list(chunk.codes)[1:]]), np.int32, len(chunk.codes))
        codes = np.stack([of[_codes(windows, k)] for k in range(LONGEST)], axis=1)
        self.parts.append((codes, n.astype(np.uint32), group))
        self.size += len(n)

    def rows(self) -> Iterator[tuple]:
        """A row per group: the words its suffixes use, their codes among these, and counts."""
        codes, n, group = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(group, kind="stable")
        group = group[order]
        spelled = list(self.words)
        cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            used, place = np.unique(codes[own], return_inverse=True)
            kind = "<u2" if len(used) <= 1 << 16 else "<u4"
            yield (int(group[a]), b" ".join([spelled[i] for i in used.tolist()]), place.astype(kind).tobytes(),
                   n[own].astype("<u4").tobytes())


def _route(partition, limit: int):
    """Distinct suffixes of a task with their counts, packed by group."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Partition = partition.value
        boxes: dict[str, Outbox] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, box in boxes.items():
                some, size = [], 0
                for row in box.rows():
                    some.append(row)
                    size += sum(map(len, row[1:]))
                    if size > 4_000_000:
                        yield _packed(lang, some)
                        some, size = [], 0
                if some:
                    yield _packed(lang, some)
            boxes.clear()

        for lang, chunk in _chunks(batches, limit):
            windows, n = chunk.counted()
            if not len(windows):
                continue
            spelled = _spelled(chunk)
            # A word that is no heavy prefix decides alone, the few others with the words after them.
            by_word = np.array([-1 if (lang, w) in plan.heavy else plan.group(lang, w + b" ") for w in spelled.to_pylist()], np.int32)
            group = by_word[_codes(windows, 0)]
            rest = np.flatnonzero(group < 0)
            if len(rest):
                group[rest] = [plan.group(lang, x + b" ") for x in _joined(spelled, windows[rest], LONGEST).to_pylist()]
            boxes.setdefault(lang, Outbox()).add(chunk, windows, n, group)
            if sum(b.size for b in boxes.values()) >= limit:
                yield from send()
        yield from send()
    return job


def _packed(lang: str, rows: list[tuple]) -> pa.RecordBatch:
    group, *cells = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int32()), pa.array([lang] * len(group), pa.string()), *[pa.array(c, pa.binary()) for c in cells]],
        ["group", "lang", "words", "codes", "counts"])


NODES = "lang string, phrase string, words int, f long, prefixes array<long>"


def unpack(rows: Iterator[tuple[str, bytes, bytes, bytes]]) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, words, and per leaf its language, its four word codes and its count, of all packed rows of a group."""
    langs: dict[str, int] = {}
    index: dict[bytes, int] = {}
    of, code, n = [], [], []
    for lang, words, codes, counts in rows:
        spelled = words.split(b" ")
        own = np.fromiter((index.setdefault(w, len(index)) for w in spelled), np.int64, len(spelled))
        count = np.frombuffer(counts, "<u4")
        kind = "<u2" if len(codes) == 2 * LONGEST * len(count) else "<u4"
        code.append(own[np.frombuffer(codes, kind)].reshape(-1, LONGEST))
        n.append(count.astype(np.int64))
        of.append(np.full(len(count), langs.setdefault(lang, len(langs)), np.int64))
    return list(langs), list(index), np.concatenate(of), np.concatenate(code), np.concatenate(n)


def subtree(names: list[str], spelled: list[bytes], of: np.ndarray, code: np.ndarray, n: np.ndarray,
            heavy: dict[tuple[str, bytes], int], least: int) -> list[tuple]:
    """Nodes (lang, phrase, words, count, counts of its proper prefixes) of the truncated suffix tree over the given leaves that
    occur ``least`` times or more. Heavy prefixes are not whole here: their counts are taken from ``heavy``."""
    words = pa.array(spelled, pa.binary())
    empty = spelled.index(b"") if b"" in spelled else -1
    order = np.lexsort(((code[:, 2] << 32) | code[:, 3], (code[:, 0] << 32) | code[:, 1], of))
    code, of, n = code[order], of[order], n[order]
    new = np.concatenate(([True], of[1:] != of[:-1]))
    out: list[tuple] = []
    above: list[tuple[np.ndarray, np.ndarray]] = []  # per level above: first leaves and counts of nodes
    split = None  # first leaves of the nodes above that are heavy
    for k in range(LONGEST):
        new = new | np.concatenate(([True], code[1:, k] != code[:-1, k]))
        first = np.flatnonzero(new)
        count = _sums(n, first)
        whole = np.ones(len(first), bool)
        if k < LONGEST - 1 and (k == 0 or len(split)):
            # Only below a heavy node can another one be.
            below = np.arange(len(first)) if k == 0 else np.flatnonzero(
                np.isin(above[-1][0][np.searchsorted(above[-1][0], first, "right") - 1], split))
            for i in below.tolist():
                row = first[i]
                got = heavy.get((names[of[row]], b" ".join([spelled[c] for c in code[row, :k + 1]])))
                if got is not None:
                    count[i], whole[i] = got, False
        split = first[~whole]
        shown = np.flatnonzero(whole & (count >= least) & (code[first, k] != empty))
        at = first[shown]
        path = [c[np.searchsorted(f, at, "right") - 1].tolist() for f, c in above]
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(code[at, i])) for i in range(k + 1)], b" ") if k else \
            words.take(pa.array(code[at, 0]))
        before = [list(x) for x in zip(*path, strict=True)] if path else [[] for _ in shown]
        spelling = [x.decode("utf-8", "replace") for x in phrases.to_pylist()]
        out += zip([names[x] for x in of[at]], spelling, [k + 1] * len(at), count[shown].tolist(), before, strict=True)
        above.append((first, count))
    return out


def _trees(partition, least: int):
    def job(table: pa.Table) -> pa.Table:
        nodes = subtree(*unpack(zip(*[table.column(c).to_pylist() for c in ("lang", "words", "codes", "counts")], strict=True)),
                        partition.value.heavy, least) if table.num_rows else []
        cells = list(zip(*nodes, strict=True)) if nodes else [[] for _ in range(5)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        made = [pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)]
        return pa.table(made, names=["lang", "phrase", "words", "f", "prefixes"])
    return job


def _heavy_nodes(spark: SparkSession, heavy: dict[tuple[str, bytes], int]) -> DataFrame:
    """Heavy prefixes as nodes; one that ends with an empty word is the end of a piece and no phrase."""
    rows = []
    for (lang, name), n in heavy.items():
        words = name.split(b" ")
        if words[-1]:
            rows.append((lang, name.decode("utf-8", "replace"), len(words), n,
                         [heavy[lang, b" ".join(words[:i])] for i in range(1, len(words))]))
    return spark.createDataFrame(rows, NODES)


def count_phrases(docs: DataFrame, p: Collocations) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of 1 to 4 words with ``least`` occurrences (lang, phrase, words, f, prefixes), those of them that are heavy
    prefixes, and the number of words by language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("binary").alias("text"))
    totals, _, partition = _partition(rows, p)
    plan = spark.sparkContext.broadcast(partition)
    suffixes = rows.mapInArrow(_route(plan, p.chunk), SUFFIXES)
    light = suffixes.groupBy("group").applyInArrow(_trees(plan, p.least), NODES)
    heavy = _heavy_nodes(spark, partition.heavy)
    return stage(light.unionByName(heavy), "phrases"), heavy, totals


def _part(first, last):
    return F.array_join(F.slice("w", first, last), " ")


def mine(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the best phrases of each language (NULL: ``und``).

    NULL and empty texts have no words, repeated rows count each time, ids don't matter and may be NULL. Ties of score go to the
    larger count, then to the phrase that is first in byte order. An empty table, or one without frequent phrases, gives no rows.
    Only lang and text are read.
    """
    spark = docs.sparkSession
    nodes, heavy, totals = count_phrases(docs, p)
    phrases = nodes.where("words > 1").withColumn("w", F.split("phrase", " "))

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.posexplode("prefixes").alias("k0", "l"), "w").select(
        "lang", "phrase", "a", (F.col("k0") + 1).alias("k"), "l",
        F.array_join(F.expr("slice(w, k0 + 2, size(w) - k0 - 1)"), " ").alias("rest"))
    few = heavy.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), F.col("f").alias("hot_r"))
    marked = cuts.join(F.broadcast(few), (F.col("lang") == F.col("hl")) & (F.col("rest") == F.col("hp")), "left").drop("hl", "hp")
    counts = nodes.select(F.col("lang").alias("rl"), F.col("phrase").alias("rp"), F.col("f").alias("r"))
    plain = marked.where("hot_r is null").join(counts, (F.col("lang") == F.col("rl")) & (F.col("rest") == F.col("rp")))
    keep = ["lang", "phrase", "a", "k", "l", "r"]
    cut = plain.select(*keep).unionByName(marked.where("hot_r is not null").withColumnRenamed("hot_r", "r").select(*keep))
    big = "decimal(25,0)"
    score = F.expr(f"cast(a as {big}) * {p.scale} div (cast(l as {big}) + cast(r as {big}))")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")

    # The shorter phrases inside each longer one, with the largest count of a longer one.
    inner = [F.struct(_part(F.lit(i + 1), F.lit(m)).alias("p"), F.lit(m).alias("m"), F.lit(i + m).alias("e"))
             for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    inside = phrases.where("words > 2").select("lang", "words", "f", "w").select(
        "lang", F.explode(F.filter(F.array(*inner), lambda x: (x["m"] < F.col("words")) & (x["e"] <= F.col("words")))).alias("x"), "f")
    over = inside.groupBy(F.col("lang").alias("ol"), F.col("x.p").alias("op")).agg(F.max("f").alias("most"))
    kept = worst.join(over, (F.col("lang") == F.col("ol")) & (F.col("phrase") == F.col("op")), "left").where(
        F.expr(f"most is null or cast(most as {big}) * 100 < cast(a as {big}) * {p.inside}"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark))).alias("b"))
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).where(
        F.col("rank") <= p.top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= p.top)
    n = totals.select(F.col("lang").alias("nl"), "n")
    return ranked.join(n, F.col("lang") == F.col("nl")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
