"""Fuzzy matches of short names: the share of characters in matching blocks, found without comparing all pairs.

The ratio of two names is 2 M / (|a| + |b|), where M counts the characters of the longest common block and, again and again, of what lies before and
behind it.  M is at most the number of characters that the names share with their repeats.  So names whose ratio is t or more share at least
o = ceil(t / 2 (|a| + |b|)) numbered characters (the first e, the second e, ...), and if both list theirs in one order (rare ones first), their first |a| - o + 2 and
|b| - o + 2 have two in common: pairs of these are the keys that names of the two lengths are joined by.  No match is lost; candidates are then counted and verified.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from lakewright.plans.registry import query
from lakewright.plans.written import written

RATIO, SHORTEST = 0.84, 4
#: Words that start alike: letters that must be equal, and by how many letters the lengths may differ.
HEAD, LENGTHS = 5, 2


def match_ratio(a: str, b: str) -> float:
    """The ratio of two names."""
    return SequenceMatcher(None, a, b).ratio()


def _needed(n: int, m: int, ratio: float) -> int:
    """Shared characters that names of n and m characters need."""
    return ceil(ratio * (n + m) / 2 - 1e-9)


def keys(name: str, rank: dict[str, int], ratio: float, left: bool) -> set[str]:
    """The join keys of a name: it shares one with every name of the other side whose ratio is high enough."""
    seen: Counter[str] = Counter()
    tokens = []
    for c in name:
        seen[c] += 1
        tokens.append((rank.get(c, 0), c, seen[c]))
    tokens.sort()
    n, out = len(name), set()
    for m in range(ceil(n * ratio / (2 - ratio) - 1e-9), int(n * (2 - ratio) / ratio + 1e-9) + 1):
        o = _needed(n, m, ratio)
        if o > min(n, m) or not m:
            continue
        width = min(2, o)
        sizes = f"{n}:{m}" if left else f"{m}:{n}"
        for part in combinations(tokens[: n - o + width], width):
            out.add(f"{sizes}:" + "".join(f"{c}{k}" for _, c, k in part))
    return out


def _keyed(names: DataFrame, rank: dict[str, int], ratio: float, left: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            owners, found = [], []
            for name in batch.column(0).to_pylist():
                own = keys(name, rank, ratio, left)
                owners += [name] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(owners, pa.string())], ["key", "name"])

    return names.mapInArrow(run, "key string, name string")


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([match_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _shared(a, b):
    """Characters, with their repeats, that two names share: by the counts of each letter."""
    letters = lambda x: F.split(x, "")
    return F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda s, c: s + F.least(F.size(F.filter(letters(a), lambda x: x == c)), F.size(F.filter(letters(b), lambda x: x == c))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, ratio: float = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """(a, b, ratio) of the distinct names of left(name) and right(name), of `shortest` characters or more, whose ratio is high enough; nulls have none."""
    sides = [written(df.select("name").where(F.length("name") >= shortest).distinct()) for df in (left, right)]
    letters = sides[0].union(sides[1]).select(F.explode(F.split("name", "")).alias("c")).where("c <> ''").groupBy("c").count()
    rank = {r.c: r["count"] for r in letters.collect()}  # a row a character: bounded by the alphabet
    a = _keyed(sides[0], rank, ratio, True).withColumnRenamed("name", "a")
    b = _keyed(sides[1], rank, ratio, False).withColumnRenamed("name", "b")
    pairs = a.join(b, "key").select("a", "b").distinct()
    near = pairs.where(2 * _shared(F.col("a"), F.col("b")) >= ratio * (F.length("a") + F.length("b")) - 1e-9)
    return written(near).withColumn("ratio", F.when(F.col("a") == F.col("b"), 1.0).otherwise(_ratio("a", "b"))).where(F.col("ratio") >= ratio)


def word_matches(left: DataFrame, right: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a, b) of the distinct words of two sides that are equal, have a high enough ratio, or start with the same letters and are of about one length."""
    sides = [df.select("name").where("name <> ''").distinct() for df in (left, right)]
    one, two = sides[0].withColumnRenamed("name", "a"), sides[1].withColumnRenamed("name", "b")
    equal = one.join(two, F.col("a") == F.col("b"))
    head = lambda c: F.left(F.col(c), F.lit(HEAD))
    long_enough = lambda c: F.length(c) >= HEAD
    # each word by its head and length, the other side by every length that is near enough: an equality join
    near = two.where(long_enough("b")).select("b", head("b").alias("_h"), F.explode(F.transform(F.sequence(F.lit(-LENGTHS), F.lit(LENGTHS)), lambda d: F.length("b") + d)).alias("_n"))
    alike = one.where(long_enough("a")).select("a", head("a").alias("_h"), F.length("a").alias("_n")).join(near, ["_h", "_n"]).select("a", "b")
    return equal.union(alike).union(fuzzy_pairs(left, right, ratio).select("a", "b")).distinct()


def words_of(texts: DataFrame, column: str) -> DataFrame:
    """The distinct lower-case words of letters of a column, of three letters or more, without the s at the end of those of five or more."""
    word = F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"\p{L}{3,}"), F.lit(0)))
    return texts.select(word.alias("w")).distinct().select(F.when(F.endswith("w", F.lit("s")) & (F.length("w") > 4), F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("name")).distinct()


@query("fuzzy_matches")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark items that match words of pages' addresses and of customers' segments."""
    items, pages, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "pages", "customer"))
    subjects = words_of(items, "text")
    kinds = words_of(pages, "url").union(words_of(customers, "c_mktsegment")).distinct()
    return word_matches(subjects, kinds)
