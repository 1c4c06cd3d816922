"""Quality rules from the divergence of histograms, in DataFrame functions only.

A document's character classes and its common words are compared with those of its language by Jensen-Shannon distance
(base 2, from 0 to 1). The references are summed over the documents of the language that the plain rules accept. A short document
says little, so each comparison has a guard of minimum length, and a language with few documents has no reference.

How far common words may lie from the reference is taken from the data: the distance of a sound document shrinks with its
length, so documents are put into bands of length (half octaves), and the limit of a band is its median distance plus
some times the way from the tenth percentile to the median. Junk lies above the median and so doesn't widen the limit.

One scan of the texts writes counts per document; references and verdicts work on the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage

SPACE = r"[\x20\x09-\x0D]+"

# Frequent words of English, German, French and Spanish.
COMMON = tuple(dict.fromkeys((
    "the of and to in is that for it with as was on be by this are from or at an not "
    "der die das und ist nicht mit von den dem des ein eine zu auf für im sich als es "
    "le la les de des et en un une du que qui dans pour pas sur par au est plus "
    "el los las y que en una por con para del se no al lo su es como").split()))

#: Character classes by pattern; blanks and all other characters (mostly lower-case letters) are two more.
CLASSES = (("upper", r"\p{Lu}"), ("digit", "[0-9]"), ("stop", "[.,]"), ("mark", r"[;:!?'\"()\-]"),
           ("symbol", "[#*$%&|<>]"), ("other_symbol", r"[=+@_/\\^~`\[\]{}]"))


@dataclass(frozen=True)
class QualityRules:
    """``char_limit``: the largest distance of character classes, for documents of ``char_words`` words or more. ``spread``: how many
    times the lower spread of a band its limit lies above the median, for documents of ``word_words`` words or more, and no limit
    is below ``word_floor``. ``least_documents``: a language with fewer accepted documents has no reference and so only the plain
    rules; a band with fewer documents takes its limit from all lengths of the language."""

    least_words: int = 10
    repeat_percent: int = 20
    char_limit: float = 0.30
    spread: float = 4.0
    word_floor: float = 0.10
    char_words: int = 20
    word_words: int = 60
    least_documents: int = 20


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(hashes: Column) -> Column:
    """Words in windows that occur more than once: windows sorted with their places, equal neighbours marked, and the places
    of marked windows merged."""
    def marked(s: Column) -> Column:
        same = F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(F.lit(True)) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(F.lit(True)),
            x["i"]))
        return _once(F.array_sort(F.filter(same, lambda i: i.isNotNull())), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - i, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(pairs, marked)


def key() -> Column:
    """Rows with equal keys get equal verdicts."""
    return F.xxhash64(F.col("text").cast("binary"), F.col("lang"))


def features(docs: DataFrame) -> DataFrame:
    """Counts per document: the base measures, character classes and common words."""
    c = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(""))
                        .alias("lang"), c.alias("c"), key().alias("text_key"))
    # A generator keeps later expressions from splitting the text again.
    words = whole.withColumn("w", F.explode(F.array(F.array_remove(F.split("c", SPACE), ""))))
    lines = F.filter(F.split("c", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    inner = [F.regexp_count("c", F.lit(p)).cast("long") for _, p in CLASSES]
    known = F.filter("w", lambda x: F.lower(x).isin(*COMMON))
    hashed = words.select(
        "doc_id", "lang", "text_key", F.size("w").cast("long").alias("n_words"),
        F.char_length("c").cast("long").alias("n_chars"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.array(*inner).alias("classes"),
        _once(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"),
        F.explode(F.array(F.transform(known, lambda x: F.lower(x)))).alias("k"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    windowed = hashed.withColumn("v", F.explode(F.array(_once(F.col("h"), lambda h: F.when(F.size(h) >= 5, F.transform(
        F.sequence(F.lit(0), F.size(h) - 5),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))))))
    repeats = F.when(F.size("v") == F.size(F.array_distinct("v")), F.lit(0)).otherwise(_repeats(F.col("v")))
    return windowed.select(
        "doc_id", "lang", "text_key", "n_words", "word_chars", F.col("classes")[4].alias("n_symbols"), "n_dup_lines",
        repeats.cast("long").alias("n_repeat_words"),
        F.concat("classes", F.array(F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - F.aggregate(
            "classes", F.lit(0).cast("long"), lambda a, b: a + b))).alias("char_counts"),
        F.array(*[(F.size("k") - F.size(F.array_remove("k", x))).cast("long") for x in COMMON],
                F.col("n_words") - F.size("k")).alias("word_counts"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; NULL if one sums to 0."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def of(t: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: (term(x / t["a"], y / t["b"]) + term(y / t["b"], x / t["a"])) / 2)

    value = _once(F.struct(total(a).alias("a"), total(b).alias("b")),
                  lambda t: F.when((t["a"] > 0) & (t["b"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(of(t))))))
    return value


def _failed(p: QualityRules) -> Column:
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))


def references(counts: DataFrame, p: QualityRules) -> DataFrame:
    """Per language, the summed histograms of the documents that the plain rules accept."""
    n_char, n_word = len(CLASSES) + 2, len(COMMON) + 1
    sums = counts.where(~_failed(p)).groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.array(*[F.sum(F.get("char_counts", F.lit(i))) for i in range(n_char)]).alias("char_reference"),
        F.array(*[F.sum(F.get("word_counts", F.lit(i))) for i in range(n_word)]).alias("word_reference"))
    return sums.where(F.col("documents") >= p.least_documents).select(
        F.col("lang").alias("_lang"), "char_reference", "word_reference")


STEPS = 1000  # steps of a distance when percentiles are read


def _limit(rows: DataFrame, keys: list[str], value: Column, p: QualityRules) -> DataFrame:
    """``keys…, documents, limit``: median plus ``spread`` times (median - tenth percentile), from counts of small steps, so that
    they are the same under any partitioning."""
    steps = rows.groupBy(*keys, F.floor(value * STEPS).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_step"))
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    placed = steps.select(*keys, "_step", upto.alias("_upto"), whole.alias("_whole"))

    def percentile(share: int) -> Column:
        return F.min(F.when(100 * F.col("_upto") >= share * F.col("_whole"), F.col("_step"))) / STEPS

    found = placed.groupBy(*keys).agg(F.max("_whole").alias("documents"), percentile(10).alias("_low"), percentile(50).alias("_mid"))
    return found.select(*keys, "documents", (F.col("_mid") + p.spread * (F.col("_mid") - F.col("_low"))).alias("limit"))


def word_limits(measured: DataFrame, p: QualityRules) -> DataFrame:
    """``_limit_lang, _limit_band, _word_limit``: per language and band; and for band NULL the limit of distance times the square root
    of the words, which hardly depends on length, for bands with few documents."""
    able = measured.where((~_failed(p)) & (F.col("n_words") >= p.word_words) & F.col("word_distance").isNotNull()).select(
        "lang", "band", "word_distance", F.sqrt(F.col("n_words").cast("double")).alias("root"))
    banded = _limit(able, ["lang", "band"], F.col("word_distance"), p).where(F.col("documents") >= p.least_documents)
    whole = _limit(able, ["lang"], F.col("word_distance") * F.col("root"), p).withColumn("band", F.lit(None).cast("int"))
    return banded.unionByName(whole).select(
        F.col("lang").alias("_limit_lang"), F.col("band").alias("_limit_band"), F.col("limit").alias("_word_limit"))


def judge(docs: DataFrame, p: QualityRules = QualityRules()) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance, text_key.

    A NULL text has no words and fails; a NULL language is a language of its own; NULL ids stay, repeated rows are judged
    each; an empty table gives an empty result. A language with fewer than ``least_documents`` accepted documents is judged by the
    plain rules only. Only doc_id, lang and text are read.
    """
    counts = stage(features(docs), "counts")
    known = references(counts, p)
    joined = counts.join(known, F.col("lang") == F.col("_lang"), "left")
    measured = stage(joined.select(
        "doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.floor(2 * F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("int").alias("band"),
        distance(F.col("char_counts"), F.col("char_reference")).alias("char_distance"),
        distance(F.col("word_counts"), F.col("word_reference")).alias("word_distance")), "distances")
    limits = stage(word_limits(measured, p), "limits")
    own = limits.where("_limit_band is not null")
    rest = limits.where("_limit_band is null").select(F.col("_limit_lang").alias("_rest_lang"), F.col("_word_limit").alias("_rest"))
    placed = measured.join(own, (F.col("lang") == F.col("_limit_lang")) & (F.col("band") == F.col("_limit_band")), "left").join(
        rest, F.col("lang") == F.col("_rest_lang"), "left")
    limit = F.greatest(F.lit(p.word_floor), F.coalesce(F.col("_word_limit"), F.col("_rest") / F.sqrt(F.col("n_words").cast("double"))))
    far = ((F.col("n_words") >= p.char_words) & (F.col("char_distance") > p.char_limit)) | (
        (F.col("n_words") >= p.word_words) & (F.col("word_distance") > limit))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed(p).alias("base_failed"),
        (~_failed(p) & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance", "text_key")
