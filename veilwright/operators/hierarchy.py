"""Generalisation hierarchies.

Every hierarchy answers one question: which labels does a value have, from level 0 (itself) to the top? The answer
is ``labels``, an array column of ``height + 1`` strings. Interval, mask and small map hierarchies are plain
expressions; a lookup hierarchy adds one left join with its table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_number, bin_index, col
from ..functions.joins import lookup

TOP = "*"
END_MARGIN = 1e-6  # added to the largest value so that the last half-open interval holds it


def number_text(x: float) -> str:
    """Bounds in labels: at most six decimals, no trailing zeros."""
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def validate_all(hierarchies: Sequence[Hierarchy]) -> None:
    """Refuse lookup hierarchies that would multiply or confuse rows; each is examined once."""
    for h in hierarchies:
        if getattr(h, "validate", None) and not getattr(h, "checked", True):
            h.validate()


def label_column(attribute: str) -> str:
    return f"_labels_{attribute}"


class Hierarchy:
    attribute: str
    height: int

    def listed(self, spark: SparkSession) -> DataFrame | None:
        """Ground values ``(value string)`` that the hierarchy lists itself; None when the data defines them."""
        return None

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_labels_{attribute}``: the labels of levels 0..height."""
        raise NotImplementedError

    def label(self, level: int) -> Column:
        """The label at a level, after ``attach``."""
        return F.get(col(label_column(self.attribute)), F.lit(level))


@dataclass
class LookupHierarchy(Hierarchy):
    """Labels from a table ``(value string, labels array<string>)``; a value that is not listed becomes ``*``."""

    attribute: str
    table: DataFrame
    height: int
    checked: bool = field(default=False, repr=False)

    def validate(self) -> LookupHierarchy:
        """Each value once; each label has one parent (the levels form a tree). Both are needed to roll up."""
        twice = self.table.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        short = self.table.where(F.size("labels") != self.height)
        steps = self.table.select(F.posexplode("labels").alias("level", "label"), "labels").select(
            "level", "label", F.get("labels", F.col("level") + 1).alias("parent")
        )
        split = steps.where("parent is not null").groupBy("level", "label").agg(
            F.min("parent").alias("a"), F.max("parent").alias("b")
        ).where("a <> b")
        faults = {"lists a value twice": twice, "has lines of different length": short, "is not a tree": split}
        found = None
        for text, rows in faults.items():
            one = rows.limit(1).select(F.lit(text).alias("fault"))
            found = one if found is None else found.unionByName(one)
        for r in found.collect():  # at most three rows
            raise ValueError(f"hierarchy of {self.attribute!r} {r['fault']}")
        self.checked = True
        return self

    def attach(self, df: DataFrame) -> DataFrame:
        own = col(self.attribute).cast("string")
        marked = df.withColumn("_value", F.coalesce(own, F.lit("")))  # a missing cell is the empty text
        dim = self.table.select(F.col("value").alias("_value"), F.col("labels").alias("_above"))
        joined = lookup(marked, dim, ["_value"], ["_above"])
        missing = F.array_repeat(F.lit(TOP), self.height)
        labels = F.concat(F.array(own), F.coalesce(F.col("_above"), missing))
        return joined.withColumn(label_column(self.attribute), labels).drop("_value", "_above")

    def listed(self, spark: SparkSession) -> DataFrame | None:
        return self.table.select("value")


@dataclass
class MapHierarchy(Hierarchy):
    """value → category → ``*`` from a small mapping kept in the plan; other values become ``*``."""

    attribute: str
    mapping: Mapping[str, str]
    height: int = 2

    def attach(self, df: DataFrame) -> DataFrame:
        pairs = [F.lit(x) for item in self.mapping.items() for x in item]
        own = col(self.attribute).cast("string")
        category = F.coalesce(F.try_element_at(F.create_map(*pairs), own), F.lit(TOP)) if pairs else F.lit(TOP)
        labels = F.array(own, F.when(own.isNotNull(), category).otherwise(F.lit(TOP)), F.lit(TOP))
        return df.withColumn(label_column(self.attribute), labels)

    def listed(self, spark: SparkSession) -> DataFrame | None:
        return spark.createDataFrame([(v,) for v in self.mapping], "value string")


@dataclass
class IntervalHierarchy(Hierarchy):
    """Half-open intervals ``[lo, hi)`` and fan-out groups above them, then ``*``.

    Levels: 0 the value, 1 the interval, 2.. groups of ``fanouts`` (each a multiple of the level below), last ``*``.
    A trailing group may be short. Values outside the intervals become ``*``.
    """

    attribute: str
    bounds: list[float]
    names: list[str] | None = None
    fanouts: tuple[int, ...] = (2, 3)
    equal_width: bool = False

    @property
    def height(self) -> int:  # type: ignore[override]
        return 2 + len(self.fanouts)

    @property
    def intervals(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def equal(cls, attribute: str, low: float, high: float, intervals: int,
              fanouts: Sequence[int] = (2, 3)) -> IntervalHierarchy:
        """``intervals`` equal parts of [low, high]; the last one is closed by a small margin."""
        width = (high - low) / intervals
        bounds = [low + i * width for i in range(intervals)] + [high + END_MARGIN]
        return cls(attribute, bounds, None, tuple(fanouts), True)

    @classmethod
    def from_data(cls, df: DataFrame, attribute: str, intervals: int = 10,
                  fanouts: Sequence[int] = (2, 3)) -> IntervalHierarchy:
        """Equal intervals between the smallest and largest value in the table (one aggregate)."""
        x = as_number(df, attribute)
        row = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
        if row["low"] is None:
            return cls.equal(attribute, 0.0, 0.0, intervals, fanouts)
        return cls.equal(attribute, row["low"], row["high"], intervals, fanouts)

    def bucket(self, x: Column) -> Column:
        """Interval number from 0; NULL outside."""
        inside = (x >= F.lit(self.bounds[0])) & (x < F.lit(self.bounds[-1]))
        if self.equal_width:
            high = self.bounds[-1] - END_MARGIN
            inside = inside | ((x >= F.lit(self.bounds[0])) & (x <= F.lit(high)))  # the margin is lost in large numbers
            return F.when(inside, bin_index(x, self.bounds[0], high, self.intervals))
        out = F.lit(None).cast("int")
        for i in reversed(range(self.intervals)):
            out = F.when((x >= F.lit(self.bounds[i])) & (x < F.lit(self.bounds[i + 1])), F.lit(i)).otherwise(out)
        return out

    def steps(self) -> list[int]:
        """How many base intervals one group holds at levels 1.."""
        sizes = [1]
        for f in self.fanouts:
            sizes.append(sizes[-1] * f)
        return sizes

    def group_labels(self, step: int) -> list[str]:
        out = []
        for start in range(0, self.intervals, step):
            last = min(start + step, self.intervals) - 1
            if self.names is not None:
                out.append(self.names[start] if start == last else f"{self.names[start]} .. {self.names[last]}")
            else:
                out.append(f"[{number_text(self.bounds[start])}, {number_text(self.bounds[last + 1])}[")
        return out

    def label_table(self) -> list[list[str]]:
        """Labels of levels 1..height per interval."""
        groups = [(s, self.group_labels(s)) for s in self.steps()]
        return [[labels[b // s] for s, labels in groups] + [TOP] for b in range(self.intervals)]

    def attach(self, df: DataFrame) -> DataFrame:
        x = as_number(df, self.attribute)
        own = col(self.attribute).cast("string")
        table = F.array(*[F.array(*[F.lit(s) for s in row]) for row in self.label_table()])
        above = F.coalesce(F.get(table, self.bucket(x)), F.array_repeat(F.lit(TOP), self.height))
        return df.withColumn(label_column(self.attribute), F.concat(F.array(own), above))


@dataclass
class MaskHierarchy(Hierarchy):
    """Digits hidden from the right: ``33.0`` → ``33.*`` → ``3*.*`` → ``**.**``.

    Numbers are written with ``whole`` digits before and ``decimals`` after the point. Numbers that need more digits
    before the point become ``*``.
    """

    attribute: str
    whole: int
    decimals: int = 1

    # Fixed value: what stands after the point once every digit is hidden.
    ALL_HIDDEN = ".**"

    @property
    def height(self) -> int:  # type: ignore[override]
        return self.whole + self.decimals

    def attach(self, df: DataFrame) -> DataFrame:
        x = as_number(df, self.attribute)
        width = self.whole + (self.decimals + 1 if self.decimals else 0)
        digits = F.format_string(f"%.{self.decimals}f", F.round(F.abs(x), self.decimals))
        body = F.lpad(digits, width, "0")
        sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
        fits = F.coalesce(F.length(digits) <= F.lit(width), F.lit(False)) & x.isNotNull()
        levels: list[Column] = [col(self.attribute).cast("string")]
        for hidden in range(1, self.height):
            shown = self.height - hidden
            if shown >= self.whole:
                cut = shown + 1 if self.decimals else shown
                mask = F.concat(F.substring(body, 1, cut), F.lit("*" * (width - cut)))
            else:
                tail = "." + "*" * self.decimals if self.decimals else ""
                mask = F.concat(F.substring(body, 1, shown), F.lit("*" * (self.whole - shown) + tail))
            levels.append(F.when(fits, F.concat(sign, mask)).otherwise(F.lit(TOP)))
        levels.append(F.when(fits, F.lit("*" * self.whole + self.ALL_HIDDEN)).otherwise(F.lit(TOP)))
        return df.withColumn(label_column(self.attribute), F.array(*levels))


def attach_all(df: DataFrame, hierarchies: Sequence[Hierarchy]) -> DataFrame:
    for h in hierarchies:
        df = h.attach(df)
    return df


def levels_report(df: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """``(level, groups)``: how many different labels the data shows at each level."""
    labels = hierarchy.attach(df.select(col(hierarchy.attribute)).distinct()).select(
        F.posexplode(col(label_column(hierarchy.attribute))).alias("level", "label")
    )
    return labels.where(F.col("label").isNotNull()).distinct().groupBy("level").agg(
        F.count(F.lit(1)).alias("groups")
    )


def age_hierarchy(df_or_spark, attribute: str) -> LookupHierarchy:
    """Ages -4..119 in left-open bands of 5, 10 and 20 years, built by rule.

    Fixed rule: ages 0..5 carry ``0-4``, 6..10 ``5-9`` and so on up to 96..100; other ages are ``*`` on all levels.
    """
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    age = F.col("id") - F.lit(4)
    band = F.greatest(F.lit(0), F.ceil(age / F.lit(5.0)).cast("int") - 1)

    def name(width: int) -> Column:
        start = F.floor(band * F.lit(5) / F.lit(width)).cast("int") * F.lit(width)
        return F.format_string("%d-%d", start, start + F.lit(width - 1))

    inside = (age >= 0) & (age <= 100)
    labels = F.when(inside, F.array(name(5), name(10), name(20), F.lit(TOP))).otherwise(F.array_repeat(F.lit(TOP), 4))
    return LookupHierarchy(attribute, spark.range(124).select(age.cast("string").alias("value"),
                                                              labels.alias("labels")), 4)


# Codes of a person's sex and what they generalise to.
SEX_GROUPS = {"M": "Person", "F": "Person", "X": "Person", "(blank)": "Unknown", "''": "Unknown", '""': "Unknown",
              "H": "Person", "-": "Unknown", "": ""}

# Codes of a person's descent; each generalises to ``*``.
DESCENT_CODES = ("O", "X", "B", "H", "W", "A", "J", "K", "C", "F", "I", "V", "S", "P", "Z", "G", "U", "D", "L",
                 "-", "", "*")

# Longitude bands, from -200 to 200.
LONGITUDE_BOUNDS = [-200.0, -119.0, -118.9, -118.8, -118.7, -118.6, -118.5, -118.4, -118.3, -118.2, -118.1, -118.0,
                    200.0]
LONGITUDE_NAMES = ["<-119", "-119 to -118.9", "-118.9 to -118.8", "-118.8 to -118.7", "-118.7 to -118.6",
                   "-118.6 to -118.5", "-118.5 to -118.4", "-118.4 to -118.3", "-118.3 to -118.2",
                   "-118.2 to -118.1", "-118.1 to -118.0", ">-118"]

# Latitude bands, from 0 to 100.
LATITUDE_BOUNDS = [0.0, 30.0, 30.5, 31.0, 31.5, 32.0, 32.5, 33.0, 33.5, 34.0, 34.5, 35.0, 35.5, 100.0]
LATITUDE_NAMES = ["<30", "30-30.5", "30.5-31", "31-31.5", "31.5-32", "32-32.5", "32.5-33", "33-33.5", "33.5-34",
                  "34-34.5", "34.5-35", "35-35.5", ">35"]

# Crime descriptions and their categories.
CRIME_CATEGORIES = {
    "VEHICLE - STOLEN": "STOLEN PROPERTY",
    "BIKE - STOLEN": "STOLEN PROPERTY",
    "BURGLARY FROM VEHICLE": "PROPERTY DAMAGE",
    "THEFT OF IDENTITY": "FRAUD",
    "THEFT-GRAND ($950.01 & OVER)EXCPT,GUNS,FOWL,LIVESTK,PROD": "FRAUD",
    "THEFT FROM MOTOR VEHICLE - PETTY ($950 & UNDER)": "STOLEN PROPERTY",
    "THEFT FROM MOTOR VEHICLE - GRAND ($950.01 AND OVER)": "STOLEN PROPERTY",
    "SHOPLIFTING-GRAND THEFT ($950.01 & OVER)": "STOLEN PROPERTY",
    "THEFT PLAIN - PETTY ($950 & UNDER)": "STOLEN PROPERTY",
    "BURGLARY": "PROPERTY DAMAGE",
    "BATTERY - SIMPLE ASSAULT": "ASSAULT",
    "ASSAULT WITH DEADLY WEAPON, AGGRAVATED ASSAULT": "ASSAULT",
    "INTIMATE PARTNER - SIMPLE ASSAULT": "ASSAULT",
    "INTIMATE PARTNER - AGGRAVATED ASSAULT": "ASSAULT",
    "CHILD ABUSE (PHYSICAL) - SIMPLE ASSAULT": "ASSAULT",
    "BATTERY WITH SEXUAL CONTACT": "SEXUAL ASSAULT",
    "RAPE, FORCIBLE": "SEXUAL ASSAULT",
    "ORAL COPULATION": "SEXUAL ASSAULT",
    "SEXUAL PENETRATION W/FOREIGN OBJECT": "SEXUAL ASSAULT",
    "SEX,UNLAWFUL(INC MUTUAL CONSENT, PENETRATION W/ FRGN OBJ": "SEXUAL ASSAULT",
    "SODOMY/SEXUAL CONTACT B/W PENIS OF ONE PERS TO ANUS OTH": "SEXUAL ASSAULT",
    "LEWD CONDUCT": "SEXUAL ASSAULT",
    "CRM AGNST CHLD (13 OR UNDER) (14-15 & SUSP 10 YRS OLDER)": "CHILD-RELATED CRIME",
    "CHILD ANNOYING (17YRS & UNDER)": "CHILD-RELATED CRIME",
    "CRIMINAL THREATS - NO WEAPON DISPLAYED": "THREATS",
    "LETTERS, LEWD  -  TELEPHONE CALLS, LEWD": "HARASSMENT",
    "UNAUTHORIZED COMPUTER ACCESS": "CYBERCRIME",
    "OTHER MISCELLANEOUS CRIME": "MISCELLANEOUS",
    "DOCUMENT FORGERY / STOLEN FELONY": "FRAUD",
    "EMBEZZLEMENT, GRAND THEFT ($950.01 & OVER)": "FRAUD",
    "EXTORTION": "THREATS",
    "VIOLATION OF RESTRAINING ORDER": "HARASSMENT",
    "SEX OFFENDER REGISTRANT OUT OF COMPLIANCE": "SEXUAL OFFENSE",
    "VANDALISM - FELONY ($400 & OVER, ALL CHURCH VANDALISMS)": "PROPERTY DAMAGE",
    "VANDALISM - MISDEAMEANOR ($399 OR UNDER)": "PROPERTY DAMAGE",
    "BUNCO, GRAND THEFT": "FRAUD",
}


def sex_hierarchy(spark, attribute: str) -> LookupHierarchy:
    rows = [(v, [g, TOP]) for v, g in SEX_GROUPS.items()]
    return LookupHierarchy(attribute, spark.createDataFrame(rows, "value string, labels array<string>"), 2)


def descent_hierarchy(spark, attribute: str) -> LookupHierarchy:
    rows = [(v, [TOP]) for v in DESCENT_CODES]
    return LookupHierarchy(attribute, spark.createDataFrame(rows, "value string, labels array<string>"), 1)


def longitude_hierarchy(attribute: str) -> IntervalHierarchy:
    return IntervalHierarchy(attribute, list(LONGITUDE_BOUNDS), list(LONGITUDE_NAMES))


def latitude_hierarchy(attribute: str) -> IntervalHierarchy:
    return IntervalHierarchy(attribute, list(LATITUDE_BOUNDS), list(LATITUDE_NAMES))


def crime_hierarchy(attribute: str) -> MapHierarchy:
    return MapHierarchy(attribute, dict(CRIME_CATEGORIES))
