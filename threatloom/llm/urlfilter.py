"""URL filter: fixed rules first, then naive Bayes over segmented host and path tokens.

Word frequencies come from the letters runs of all page texts. A host label is split into words by
a unigram Viterbi search in time linear in its length; only frequencies of substrings of labels are joined to them. Multinomial
naive Bayes learns from all pages that a rule decides and judges the others by the words of their
host and the tokens of their path (digits count as `#`).

Everything is a function of the url, so each distinct url is judged once and joined back.

Defined results: a null url or one without `://` has an empty host and path, no rule, and the verdict
of the prior; with nothing to learn from, and on ties, the verdict is allow; empty host labels are
skipped; repeated rows are judged alike and each returned; columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 20
PIECE, LETTERS = 4096, re.compile("[a-z]+")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each run of letters a-z stands in the page texts."""
    words = pages.select(F.explode(F.split(F.translate(F.col(text), UPPER, LOWER), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a label; unknown words cost a factor of ten a letter."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for i in range(1, len(label) + 1):
        for j in range(max(0, i - LONGEST_WORD), i):
            n = counts.get(label[j:i], 0)
            p = best[j] + (math.log(n / total) if n else math.log(10 / max(1, total)) - (i - j) * math.log(10))
            if p > best[i]:
                best[i], back[i] = p, j
    words, i = [], len(label)
    while i:
        words.append(label[back[i] : i])
        i = back[i]
    return words[::-1]


def parts_of(label: str) -> Iterator[set[str]]:
    """The substrings of a label that can be words, a bounded piece of the label at a time."""
    for at in range(0, len(label), PIECE):
        runs = LETTERS.findall(label[at : at + PIECE + LONGEST_WORD - 1])
        yield {m[i:j] for m in runs for i in range(len(m)) for j in range(i + 1, min(len(m), i + LONGEST_WORD) + 1)}


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for the distinct host labels in `labels`."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    labels = stored(labels.select("label").distinct().withColumn("id", F.monotonically_increasing_id()), "url-labels")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, words = [], []
            for label, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in parts_of(label):
                    words += part
                    ids += [number] * len(part)
                    if len(ids) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])
                        ids, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])

    known = labels.mapInArrow(cut, "id long, word string").join(counts, "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = labels.join(known, "id", "left").select("label", F.col("known.word").alias("words"), F.col("known.n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for label, words, ns in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out.append(split_label(label, dict(zip(words or [], ns or [])), total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return rows.mapInArrow(run, "label string, words array<string>")


def judge(pages: DataFrame, url: str = "url", text: str = "html", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and block_odds (log odds of naive Bayes, null under a rule)."""
    urls = pages.groupBy(F.col(url).alias("u")).agg(F.count("*").alias("pages"))
    urls = urls.select("u", "pages", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    urls = stored(urls.withColumns({"rule": rule, "by_rule": by_rule}), "url-hosts")
    label = F.explode(F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("label")
    words = segmented(urls.select(label), stored(word_counts(pages, text), "url-words"))
    of_host = urls.select("u", "pages", "by_rule", label).join(words, "label").select("u", "pages", "by_rule", F.explode("words").alias("token"))
    path = F.filter(F.split(F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]", "#"), r"[^\p{L}\p{N}#]+"), lambda x: x != "")
    of_path = urls.select("u", "pages", "by_rule", F.explode(F.transform(path, lambda x: F.concat(F.lit("/"), x))).alias("token"))
    tokens = stored(of_host.union(of_path), "url-tokens")
    n = lambda what: F.coalesce(F.sum(F.when(F.col("by_rule") == what, F.col("pages"))), F.lit(0))
    seen = tokens.filter("by_rule is not null").groupBy("token").agg(n("block").alias("blocked"), n("allow").alias("allowed"))
    seen = stored(seen, "url-counts")
    sums = seen.agg(F.count("*").alias("v"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    prior = urls.agg(n("block").alias("b"), n("allow").alias("a")).first()
    odds0 = math.log((prior.b + 1) / (prior.a + 1))
    size = sums.v + 1
    odds = F.log((F.coalesce("blocked", F.lit(0)) + 1) / (sums.b + size)) - F.log((F.coalesce("allowed", F.lit(0)) + 1) / (sums.a + size))
    open_ = tokens.filter("by_rule is null").groupBy("u", "token").agg(F.count("*").alias("k"))
    scored = open_.join(seen, "token", "left").groupBy("u").agg(F.sum(F.col("k") * odds).alias("evidence"))
    judged = urls.join(scored, urls.u.eqNullSafe(scored.u), "left").drop(scored.u)
    block_odds = F.when(F.col("by_rule").isNull(), F.coalesce("evidence", F.lit(0.0)) + odds0)
    judged = judged.select("u", "host", "path", "rule", F.coalesce("by_rule", F.when(F.round(block_odds, 9) > 0, "block").otherwise("allow")).alias("verdict"), block_odds.alias("block_odds"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_odds")]
    u = fresh(pages, "u")
    left = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url).alias(u))
    judged = judged.withColumnRenamed("u", f"{u}_")
    return left.join(judged, F.col(u).eqNullSafe(F.col(f"{u}_")), "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "verdict", "block_odds")
