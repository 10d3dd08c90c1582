"""Document fingerprints by spot signatures, with DataFrame operations only.

A spot is a run of common words (or the beginning of the text); its signature is the last
common word together with the next CHAIN content words after it.  A text's fingerprint is its
set of distinct signatures, as sorted 32-bit hashes.  Two fingerprints are compared by
Jaccard; set lengths alone bound it, so pairs whose lengths are too far apart are not compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import materialise

#: Common words of four languages.
COMMON = """a an and are as at be by for from in is it of on or that the this to was were with not but you he she they we his her
aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer er es für im ist mit nicht oder sich sie so und von war wie wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con de del el ella en entre era es esta este fue ha hay la las lo los más no o para pero por que se sin sobre su sus un una y ya""".split()
CHAIN = 2
STRETCH, EVERY = 160, 8
#: Scripts without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Documents in a block of the doc_id order, and the square root of the most blocks.
BLOCK, ROOT = 512, 64


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with array<int> column `name`: the sorted distinct spot hashes of column `text`; empty without letters and digits.

    The steps are columns of their own, so that none is computed again for every spot.
    """
    apart = F.when(F.col(text).rlike(UNSPACED), F.regexp_replace(F.col(text), F.lit(f"({UNSPACED})"), F.lit(" $1 "))).otherwise(F.col(text))
    plain = F.trim(F.regexp_replace(F.lower(apart), F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))
    word = "|".join(sorted(set(COMMON)))
    marked = F.regexp_replace(F.concat(F.lit("\x02 "), F.col("_plain"), F.lit(" ")), F.lit(f" ({word})(?= )"), F.lit("\x01$1\x02"))
    halves = F.transform(F.split(marked, "\x01"), lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("word"), F.trim(F.substring_index(x, "\x02", -1)).alias("after")))
    # of a run of common words the last one has content words after it; a text of common words alone is one spot
    alone = F.array(F.struct(F.lit("").alias("word"), F.col("_plain").alias("after")))
    spots = F.when(F.size("_halves") == 0, alone).otherwise(F.col("_halves"))
    after = lambda i: F.coalesce(F.concat(F.get("_spots", i)["after"], F.lit(" ")), F.lit(""))
    chain = lambda i: F.substring_index(F.trim(F.concat(*(after(i + k) for k in range(CHAIN + 1)))), " ", CHAIN)
    each = F.transform(F.sequence(F.lit(0), F.size("_spots") - 1), lambda i: F.hash(F.get("_spots", i)["word"], chain(i)))
    # the words of a long stretch are bound to w once
    long_ = F.filter(F.col("_spots"), lambda x: F.length(x["after"]) > STRETCH)
    anchors = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.pmod(F.hash(F.get(w, i)), F.lit(EVERY)) == 0)
    inside = F.flatten(F.transform(F.transform(long_, lambda x: F.split(x["after"], " ")), lambda w: F.transform(anchors(w), lambda i: F.hash(F.get(w, i), *(F.coalesce(F.get(w, i + k), F.lit("")) for k in range(1, CHAIN + 1))))))
    all_ = F.when(F.size(long_) > 0, F.concat(each, inside)).otherwise(each)
    found = F.when(F.col("_plain") == "", F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(all_)))
    return df.withColumn("_plain", plain).withColumn("_halves", F.filter(halves, lambda x: x["after"] != "")).withColumn("_spots", spots).withColumn(name, found).drop("_plain", "_halves", "_spots")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(signature: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `signatures`; null texts are empty."""
    return with_signatures(docs.withColumn("text", F.coalesce("text", F.lit(""))), "text", "signatures")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): distinct fingerprints, by the smallest doc_id of each, with likeness >= threshold.

    Fingerprints are partitioned by length so that likely partners are in the same or the next partition, and within
    one they meet on the prefix of signatures that two similar sets must share.  Empty fingerprints pair with nothing.
    """
    sets = materialise(fingerprints(docs.where("doc_id is not null")).groupBy("signatures").agg(F.min("doc_id").alias("doc_id")).where(F.size("signatures") > 0))
    part = F.floor(F.log(F.size("signatures").cast("double")) / F.log(F.lit(1 / threshold)))
    n = F.size("signatures")
    prefix = F.explode(F.slice("signatures", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1))
    keys = sets.select("doc_id", n.alias("n"), part.alias("part"), prefix.alias("key"))
    left = keys.select(F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "key", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("part").alias("own"))
    right = keys.select("part", "key", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    near = left.join(right, ["part", "key"]).where("a <> b and nb >= na and na >= nb * " + repr(threshold) + " and (own < part or na < nb or a < b)")
    pairs = near.select("a", "b").distinct()
    x, y = (sets.select(F.col("doc_id").alias(s), F.col("signatures").alias(f"s{s}")) for s in "ab")
    out = pairs.join(x, "a").join(y, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return out.where(F.col("likeness") >= threshold).distinct()


def _block(bounds: list[int]) -> Column:
    """The number of bounds (ascending) that doc_id reaches; -1 if it is null.  Two levels of ROOT steps at most."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = max(1, -(-len(bounds) // ROOT))
    whole = F.array(*map(F.lit, bounds)).cast("array<long>")
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[::step])).cast("array<long>"), lambda b: b <= F.col("doc_id")))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(whole, start + 1, F.lit(step)), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(start + fine)


def with_next(docs: DataFrame, carried: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """carried(docs) with next_<c> for each name: its value in the next row by ascending doc_id (null first, ties by text); after the last the first.

    carried adds columns to rows, each row by itself.  The order is cut at quantiles of doc_id into blocks of about BLOCK documents, at most ROOT ** 2,
    wherever the ids lie; each is a window of its own.  The first row of each block is found by its doc_id, and goes to the block before.
    """
    rows = docs.agg(F.count("doc_id")).first()[0]
    blocks = max(1, min(rows // BLOCK, ROOT * ROOT))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 100_000)).first()[0] if blocks > 1 else []
    named = docs.withColumn("_block", _block(sorted(set(cuts or []))))
    order = [F.col("doc_id").asc_nulls_first(), "text"]
    value = F.struct(*names)
    placed = carried(named).withColumn("_next", F.lead(value).over(Window.partitionBy("_block").orderBy(*order)))
    # one id per block, then the few rows that have it
    ids = named.groupBy("_block").agg(F.min("doc_id").alias("_id"))
    heads = named.join(F.broadcast(ids.withColumnRenamed("_block", "_b")), (F.col("_block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_b", "_id")
    heads = heads.withColumn("_row", F.row_number().over(Window.partitionBy("_block").orderBy(*order))).where("_row = 1")
    firsts = carried(heads).select(F.col("_block").alias("_to"), value.alias("_value"))
    links = ids.select("_block", F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.min("_block").over(Window.partitionBy())).alias("_to"))
    after = links.join(firsts, "_to").select("_block", "_value")
    joined = placed.join(after, "_block", "left")
    kept = [c for c in placed.columns if c not in ("_block", "_next")]
    return joined.select(*kept, *(F.coalesce(F.col(f"_next.{c}"), F.col(f"_value.{c}")).alias(f"next_{c}") for c in names))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document's
    (fewer if it is shorter).  Null texts are empty.  Every row gives one row: repeated rows follow each other, rows without a
    doc_id come first, any 64-bit ids do.  Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(base, fingerprints, ["text", "signatures"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), 1, n - half), F.substring(F.col("next_text"), 1, half))
    full = pairs.select("doc_id", n.cast("long").alias("n_chars"), "signatures", "next_signatures", edited.alias("edited"))
    full = with_signatures(full, "edited", "changed")
    return full.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("signatures")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("changed")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
