"""Target-distribution importance resampling over a position table of word n-grams.

The corpus becomes a table of positions (document row, position, word). A window's lead() puts the words that
follow beside each word, so every position starts one n-gram of each order up to ORDERS; its bucket is a hash.
Buckets are counted over the whole corpus and over the whole target, and the log ratio of the two smoothed
shares is a bucket's gain. A document's weight is the sum of its n-grams' gains; with Gumbel noise from a hash
of its id, the highest scores are a draw without replacement by weight.

The texts are dealt by row before they are exploded, so the window, the counts and the sums follow without a
shuffle of positions; both uses of the position table read that one shuffle. Gains are BUCKETS rows at most,
which is the proven bound of their broadcast. Ranks come from a range-partitioned sort, not from one task.

Defined results: null text and text without words have no features, weight 0; a null id is noised as the empty
text; rows that repeat count each, and are ranked by row where score and id tie; an empty target or corpus gives
gains by smoothing alone; columns named in the result are replaced, others are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, stored

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
BREAKS = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.isalpha()))


def spaced(text: Column) -> Column:
    """A-Z lower-cased, every ASCII character that is no letter or digit a space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS))


def positions(df: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc, pos, word: the words in order. A document without words has one row, whose word is empty."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), spaced(F.col(text)).alias("said"))
    dealt = rows.repartition("row", "doc")
    words = dealt.select("row", "doc", F.posexplode(F.split("said", " ")).alias("pos", "word"))
    return words.filter((F.col("word") != "") | (F.col("pos") == 0))


def features(df: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc, n (order less 1), bucket: all runs of 1 to `orders` words; null where a document has none from there."""
    w = Window.partitionBy("row", "doc").orderBy("pos")
    follow = {f"w{i}": F.lead("word", i).over(w) for i in range(1, orders)}
    table = positions(df, key, text).withColumns(follow)
    words = [F.col("word"), *[F.col(c) for c in follow]]
    whole = lambda i: (F.col("word") != "") & words[i].isNotNull()
    bucket = lambda i: F.pmod(F.crc32(F.concat_ws(" ", *words[: i + 1]).cast("binary")), F.lit(buckets)).cast("int")
    return table.select("row", "doc", F.posexplode(F.array(*[F.when(whole(i), bucket(i)) for i in range(orders)])).alias("n", "bucket"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket, from the features of both sides."""
    count = lambda df, n: df.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(n))
    both = count(corpus, "s").withColumn("t", F.lit(0).cast("long")).unionByName(count(target, "t").withColumn("s", F.lit(0).cast("long")))
    none = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = both.unionByName(none).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every = Window.partitionBy(F.lit(0))  # `buckets` rows
    total = lambda c: F.sum(c).over(every) + F.lit(float(buckets))
    ratio = (F.col("t") + 1) * total("s") / ((F.col("s") + 1) * total("t"))
    return each.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(doc: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(corpus: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's `key`, n_words, n_features, weight, score and rank: of those with `least_words`, the `percent` of highest
    score have a rank from 1, the rest null."""
    own = features(corpus, key, text, orders, buckets)
    gained = own.join(F.broadcast(gains(own, features(target.select(text, F.lit(0).alias("doc")), "doc", text, orders, buckets), buckets)), "bucket", "left")
    there = F.col("bucket").isNotNull()
    sums = gained.groupBy("row", "doc").agg(F.count_if(there & (F.col("n") == 0)).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = stored(sums.withColumn("score", F.col("weight") + noise(F.col("doc"), seed)).withColumn("able", F.col("n_words") >= least_words), "importance-scores")
    drawn = scored.filter("able").count() * percent // 100
    ranked = numbered(scored, [F.desc("able"), F.desc("score"), F.asc("doc"), F.asc("row")], "place")
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    return ranked.select(F.col("doc").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
