"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (a line, cut further after punctuation) hashes to a wide sparse vector of
integers; the fingerprint is the sum of these modulo 2^32. The order of paragraphs doesn't matter,
and adding or removing one adds or subtracts its vector: no rescan. The vector has a count, DENSE
lanes that every paragraph touches, which make collisions negligible, and LEVELS x BUCKETS lanes of
which it touches one: level l holds about 1 in 2^(l+1) of all paragraphs. The lanes that differ
between two fingerprints, level by level, tell how many paragraphs differ.

Everything is DataFrame functions. A null text counts as empty; empty texts have the fingerprint 0.
Repeated ids are ordered by text, null ids come first; a single document is its own next one; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

DENSE, LEVELS, BUCKETS = 6, 7, 12
LANES = 1 + DENSE + LEVELS * BUCKETS
MASK = (1 << 32) - 1
PARAGRAPHS = r"(?<=[.!?,;:|])\s+|\n+"


def lanes(paragraph: Column) -> list[Column]:
    """The vector of one paragraph; that of an empty one is 0."""
    real = paragraph != ""
    hashes = [F.xxhash64(F.lit(k), paragraph) for k in range(DENSE // 2)]
    dense = [x for h in hashes for x in (h.bitwiseAND(MASK), F.shiftrightunsigned(h, 32))]
    return [F.when(real, x).otherwise(0) for x in (F.lit(1), *dense)]


def lane_of(paragraph: Column) -> tuple[Column, Column]:
    """The sparse lane that a paragraph touches, and what it adds there."""
    h = F.xxhash64(F.lit(DENSE), paragraph)
    level = reduce(lambda rest, k: F.when(h.bitwiseAND((1 << (k + 1)) - 1) != 0, k).otherwise(rest), range(LEVELS - 2, -1, -1), F.lit(LEVELS - 1))
    bucket = F.shiftrightunsigned(h, 40) % BUCKETS
    return (level * BUCKETS + bucket).cast("int"), F.when(paragraph != "", F.shiftrightunsigned(h, 8).bitwiseAND(MASK).bitwiseOR(1)).otherwise(0)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, pattern: str = PARAGRAPHS) -> DataFrame:
    """keys and `lanes`, the fingerprint as an array, per row of texts; keys must identify the rows.

    If texts are already dealt out by one of the keys, nothing is shuffled."""
    rows = texts.select(*keys, F.explode(F.split(F.coalesce(text_col, F.lit("")), pattern)).alias("paragraph"))
    at, value = lane_of(F.col("paragraph"))
    rows = rows.select(*keys, *[x.alias(f"d{k}") for k, x in enumerate(lanes(F.col("paragraph")))], at.alias("at"), value.alias("value"))
    sums = [F.sum(f"d{k}") for k in range(1 + DENSE)] + [F.sum(F.when(F.col("at") == k, F.col("value")).otherwise(0)) for k in range(LEVELS * BUCKETS)]
    summed = rows.groupBy(*keys).agg(*[s.alias(f"l{k}") for k, s in enumerate(sums)])
    return summed.select(*keys, F.array(*[F.col(f"l{k}").bitwiseAND(MASK) for k in range(LANES)]).alias("lanes"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or of a without b: lane by lane, modulo 2^32."""
    return F.zip_with(a, b, lambda x, y: (x + y if sign > 0 else x - y).bitwiseAND(MASK))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of paragraphs that differ, estimated from the lanes: 1 for equal multisets.

    With z of BUCKETS lanes unlike, a level has about ln(1 - z/BUCKETS) / ln(1 - 1/BUCKETS) unlike
    paragraphs. The first level with at most 3/4 unlike counts, with all beyond it."""
    unlike = [reduce(Column.__add__, [(F.get(a, F.lit(1 + DENSE + level * BUCKETS + k)) != F.get(b, F.lit(1 + DENSE + level * BUCKETS + k))).cast("int") for k in range(BUCKETS)]) for level in range(LEVELS)]
    guess = [math.log(1 - min(z, BUCKETS - 0.5) / BUCKETS) / math.log(1 - 1 / BUCKETS) for z in range(BUCKETS + 1)]
    found = F.array(*unlike)
    counts = F.transform(found, lambda z: F.get(F.array(*map(F.lit, guess)), z))
    first = F.coalesce(F.nullif(F.array_position(F.transform(found, lambda z: z <= BUCKETS * 3 // 4), F.lit(True)), F.lit(0)), F.lit(LEVELS)).cast("int") - 1
    differ = F.aggregate(F.slice(counts, first + 1, LEVELS), F.lit(0.0), lambda s, x: s + x) * F.pow(F.lit(2.0), first)
    total = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(differ, F.lit(1.0)) / F.greatest(total, F.lit(1))))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """docs dealt out by ranges of the id, each range with a copy of the row that follows it (flag 1).

    One number per range reaches the driver. Returns (bucket, flag, doc_id, text) and the window in which
    lead() is the next document."""
    spark, n = docs.sparkSession, 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r.bucket, r.least.doc_id) for r in rows.groupBy("bucket").agg(F.min(F.struct(F.isnotnull("doc_id").alias("there"), "doc_id")).alias("least")).collect())
    before = [(firsts[k - 1][0], x) for k, (_, x) in enumerate(firsts)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    following = rows.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(before, f"bucket int, first {kind}")), F.col("doc_id").eqNullSafe(F.col("first")))  # a row per range
    both = rows.select("bucket", F.lit(0).alias("flag"), "doc_id", "text").unionByName(following.select("bucket", F.lit(1).alias("flag"), "doc_id", "text"))
    return both, Window.partitionBy("bucket").orderBy("flag", "doc_id", "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like it is to the edited and the next one."""
    rows, window = in_order(docs, id_col, text_col)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.select("*", F.lead("text").over(window).alias("next"), F.row_number().over(window).alias("pos"))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "pos", "flag", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), F.posexplode(F.array("text", edited)).alias("edit", "t"))
    keys = ["bucket", "pos", "flag", "doc_id", "n_chars", "edited_sha256", "edit"]
    found = fingerprints(rows, keys, "t")
    along = Window.partitionBy("bucket").orderBy("pos", "edit")
    found = found.select("*", F.lead("lanes", 1).over(along).alias("edited"), F.lead("lanes", 2).over(along).alias("next"))
    return found.where("flag = 0 and edit = 0").select("doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("next")).alias("near_next"))
