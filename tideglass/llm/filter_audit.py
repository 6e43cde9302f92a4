"""Filter interaction audit: what each filter removes, alone and in every order, from one CUBE.

Documents are reduced to counts per part and pattern of failure flags. A CUBE over the five flags and the part gives,
in the grouping set of a subset of flags, the row in which all of them are false: the documents that survive that
subset. Whatever order the filters run in, a step leads from the survivors of one subset to those of one more filter,
so all orders come from joining pairs of subsets.

Copies are told by SHA-256 of the text. Rows of equal id and text are counted together before anything is joined, and equal
texts are counted per part and label before their least id is sought, so a text or an id that a third of all
rows share is a handful of rows. Rows with a null id are spread over the join with the labels.

Defined cases: a null text is empty and fails filter A; a null language is the part ``''``; a row with a null id has no labels,
copies nothing and is copied by nothing; rows that repeat an id and text are counted each and do not copy each other; of
several label rows of an id any that says 1 counts; an empty table has no parts, hence no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

FILTERS = "ABCDE"
#: The white space between words, and capital letters.
_BLANK = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")
_SPREAD = 64


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text has by itself."""
    words = F.array_remove(F.split(text, _BLANK, -1), "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (what fails), n, good, toxic: documents per part and pattern of failures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *(f.alias(name) for name, f in failures(text).items()))
    keys = ["part", "same", *"ABCD"]
    rows = own.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("same"), F.lit(_SPREAD))).otherwise(-1))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"is_{name}") for name, c in (("good", "quality"), ("toxic", "toxic"))))
    marked = rows.join(marks.withColumn("_salt", F.lit(-1)), ["doc_id", "_salt"], "left")
    kinds = marked.groupBy(*keys, F.coalesce("is_good", F.lit(False)).alias("is_good"), F.coalesce("is_toxic", F.lit(False)).alias("is_toxic")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    kept = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).withColumn("both", F.array(F.struct(F.lit(False).alias("E"), kept.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - kept).alias("n"))))
    counted = split.select("part", *"ABCD", "is_good", "is_toxic", F.inline("both")).filter("n > 0")
    good, toxic = (F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c[3:]) for c in ("is_good", "is_toxic"))
    return counted.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), good, toxic)


def survivors(profiled: DataFrame) -> DataFrame:
    """part, subset (bit i for filter i), n, good, toxic: what is left after the filters of each of the 32 subsets; the
    part is null in the rows for all parts together."""
    selected = sum(F.when(F.grouping(c) == 0, 1 << i).otherwise(0) for i, c in enumerate(FILTERS))
    cube = profiled.cube(*FILTERS, "part").agg(selected.alias("subset"), F.grouping("part").alias("whole"), *(F.sum(m).alias(m) for m in MEASURES))
    clear = cube.filter(~F.coalesce(F.greatest(*FILTERS), F.lit(False)))
    every = clear.filter("subset = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    left = every.join(clear.drop(*FILTERS).withColumnRenamed("part", "_part").withColumnRenamed("whole", "_whole").withColumnRenamed("subset", "_subset"),
        F.expr("part <=> _part AND whole = _whole AND subset = _subset"), "left")
    return left.select(F.when(F.col("whole") == 0, F.col("part")).alias("part"), "subset", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES))


def _steps() -> list[tuple[str, int, str, int, int]]:
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | 1 << FILTERS.index(letter)
            out.append((order, step, letter, before, after))
            before = after
    return out


def orders(left: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order and
    step, from the ``survivors`` of each subset."""
    spark = left.sparkSession
    left = left.filter("part IS NOT NULL")
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, filter string, before int, after int")  # 600 rows, whatever the data

    def at(subset: str, name: str) -> DataFrame:
        return left.select("part", F.col("subset").alias(subset), *(F.col(m).alias(f"{m}_{name}") for m in MEASURES))

    whole = 2 ** len(FILTERS) - 1
    alone = [(c, 0, 1 << i, whole ^ 1 << i, whole) for i, c in enumerate(FILTERS)]
    ends = spark.createDataFrame(alone, "filter string, none int, one int, others int, every int")
    single = at("none", "none").join(F.broadcast(ends), "none")
    for subset in ("one", "others", "every"):
        single = single.join(at(subset, subset), ["part", subset])
    single = single.select("part", "filter", (F.col("n_none") - F.col("n_one")).alias("fails"), (F.col("n_others") - F.col("n_every")).alias("unique_fails"))
    pairs = at("before", "was").join(F.broadcast(steps), "before").join(at("after", "is"), ["part", "after"]).join(single, ["part", "filter"])
    removed = F.col("n_was") - F.col("n_is")
    return pairs.select(
        "part", "filter_order", "step", "filter", F.col("n_is").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        (F.col("good_was") - F.col("good_is")).alias("good_lost"), (F.col("toxic_was") - F.col("toxic_is")).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``orders`` of the five filters over ``docs``."""
    profiled = materialise(profiles(docs, labels), "filter-profiles")  # small, read for each grouping set
    return orders(materialise(survivors(profiled), "filter-survivors"))
