"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source wants its weight's share of the mix; one that would repeat its words more than `max_epochs` times is clamped
there and its excess goes to the others by weight, until none is above. The clamped set only grows, so each round is one
aggregate over the table of sources. A document's place in its source is a keyed digest of its doc_id: the mix takes the
whole repetitions of every document and then, in that order, documents until the source's rest is used up; the document
at the cut is taken in part. The cut is found from sums over 4096 buckets of the digest, so that no source, however
large, is sorted in one task: only the documents of the cut's bucket are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, materialise, own, text_or_empty

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Bytes of the table of sources up to which it is broadcast; beyond, it is joined by source and salt.
BROADCAST_BYTES, SALTS = 16 << 20, 64


def word_count(text: str | Column = "text") -> Column:
    """Runs of characters other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text_or_empty(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: str, seed: str) -> Column:
    """A document's keyed place in its source, as hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary")), 1, 16)


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Each source's size, weight and target, and the table's bytes. Weights repeat over sources by code point, null last.

    A source without words has the target 0; without any words all have.
    """
    s, w, t, n = own("source"), own("weight"), own("target"), own("source_size")
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = sizes.groupBy(F.col(source).alias(s)).agg(F.sum(size).alias(n))
    # monotonically_increasing_id is the partition's number in the upper bits and the row's in the lower 33.
    ordered = totals.repartitionByRange(parts, F.col(s).asc_nulls_last()).sortWithinPartitions(F.col(s).asc_nulls_last())
    ordered = materialise(ordered.withColumn(own("at"), F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright(own("at"), 33)
    counts = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(n).alias("size"), F.sum(F.coalesce(F.octet_length(s), F.lit(0)) + 40).alias("bytes"))
    words, stored = counts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # A row for each partition.
    starts = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias(own("first")))
    ordered = ordered.join(F.broadcast(starts), part == F.col("p"))
    rank = F.col(own("first")) + (F.col(own("at")) % F.lit(1 << 33))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ordered = ordered.select(s, n, weight.alias(w))
    cap = F.col(n) * max_epochs
    level, clamped = 0.0, -1
    while True:
        over = F.col(w) * level > cap
        got = ordered.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col(w)))).first()
        if got[0] == clamped or not got[2]:
            break
        clamped = got[0]
        level = (share * words - (got[1] or 0)) / got[2]
        if not clamped and level == 0:
            break
    return ordered.withColumn(t, F.least(F.col(w) * level, cap.cast("double"))), stored


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __taken: words of the document, of its source, the source's target
    and the words that the mix takes of the document, repeats counted; never above max_epochs times its size.

    A null text has the size 0, a null source is a source of its own and comes last, documents of one doc_id have the same
    place and are ordered by size, repeated rows each count, and an empty table gives an empty one. size names a column
    that already holds the number of words.
    """
    n, sn, t, taken, key, cut, rest, whole, before, s = map(own, ("size", "source_size", "target", "taken", "key", "cut", "rest", "whole", "before", "source"))
    rows = docs.drop(*map(own, ("size", "source_size", "target", "taken")))
    rows = rows.withColumn(n, F.col(size) if size else word_count(text)).withColumn(key, place(doc_id, seed))
    bucket = F.substring(key, 1, 3)
    sources, stored = source_targets(rows.select(source, n), source, n, weights, share, max_epochs)
    want = F.floor(F.col(t) + 0.5).cast("long")
    some = F.col(sn) > 0
    sources = sources.withColumn(whole, F.when(some, F.floor(want / F.col(sn))).otherwise(0).cast("long"))
    sources = sources.withColumn(rest, F.when(some, want - F.col(whole) * F.col(sn)).otherwise(0).cast("long"))
    sums = rows.groupBy(F.col(source).alias(s), bucket.alias(cut)).agg(F.sum(n).alias("n"))
    sums = sums.withColumn(before, F.sum("n").over(Window.partitionBy(s).orderBy(cut)) - F.col("n"))
    at = sums.withColumnRenamed(s, "x").join(sources.select(F.col(s).alias("y"), rest), F.col("x").eqNullSafe(F.col("y")))
    at = at.filter((F.col(before) <= F.col(rest)) & (F.col(rest) < F.col(before) + F.col("n"))).select(F.col("x"), cut, before)
    sources = materialise(sources.join(at, F.col(s).eqNullSafe(F.col("x")), "left").drop("x"), "mix-targets")
    if stored <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(sources), F.col(source).eqNullSafe(F.col(s)), "left")
    else:
        salt = own("salt")
        salted = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(own("row_salt"), F.pmod(F.xxhash64(key, n), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col(source).eqNullSafe(F.col(s)) & (F.col(own("row_salt")) == F.col(salt)), "left").drop(salt, own("row_salt"))
    base = F.col(whole) * F.col(n)
    # Below the cut all, above it nothing; a source whose rest is 0 has its cut at the first bucket, or none.
    away = joined.filter(~bucket.eqNullSafe(F.col(cut))).withColumn(taken, base + F.when(bucket < F.col(cut), F.col(n)).otherwise(0))
    inside = joined.filter(bucket.eqNullSafe(F.col(cut)))
    reached = F.col(before) + F.sum(n).over(Window.partitionBy(s).orderBy(key, doc_id, n).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    inside = inside.withColumn(taken, base + F.greatest(F.lit(0), F.least(F.col(n), F.col(rest) - reached)))
    return away.unionByName(inside).drop(key, cut, rest, whole, before, s, own("weight"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; texts are read once, the rest works on sizes.

    A null or empty text has the size 0 and nothing taken; a null source is a source of its own, the last; rows that repeat
    a doc_id each count, in order of size; an empty table gives an empty one; other columns are ignored.
    """
    narrow = materialise(docs.select("doc_id", "source", word_count().alias("words")), "mix-sizes")
    out = mix(narrow, size="words")
    return out.select("doc_id", *(F.col(own(c)).alias(c) for c in ("size", "source_size", "target", "taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition, and one cut to its first words for a part.

    Columns stay as they are but for text and n_chars of a part. A document of which nothing is taken goes.
    """
    out = mix(docs)
    n, taken = F.col(own("size")), F.col(own("taken"))
    copies = F.when(n > 0, F.ceil(taken / n)).otherwise(0).cast("int")
    out = out.withColumn(own("copy"), F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    words = F.least(n, taken - n * (F.col(own("copy")) - 1))
    part = words < n
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all(text_or_empty(), F.lit(f"({WORD})")), F.lit(1), words.cast("int")))
    text = F.when(part, head).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(part, F.length(head)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, sum(size)::DOUBLE * 2 AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT a.cap / a.w AS ratio,
         ((SELECT sum(n) FROM s) * 1.5 - sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN b.cap ELSE 0 END))
         / sum(CASE WHEN b.cap / b.w >= a.cap / a.w THEN b.w ELSE 0 END) AS level
  FROM s a, s b GROUP BY a.source, a.cap, a.w),
t AS (
  SELECT source, n, least(w * (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level), cap) AS target FROM s),
x AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
             ELSE (want // source_size) * size + greatest(0, least(size, want % source_size - reached)) END)::BIGINT AS taken
FROM x
"""
