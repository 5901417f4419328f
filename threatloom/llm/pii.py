"""Personal data: pattern spans, and terms that give a protected entity away.

Base spans (email, ip, card, phone) come from linear scans. Protected entities c are every distinct
base value, its class (domain, first half of an address, first six digits of a card, first four of a phone number), and every kind as a whole. The terms t within CONTEXT characters of a value, on its line,
are what may give it or its kind away; over the whole corpus,

    disclosure(t, c) = PMI(t; c) / IC(c) = log(N n_tc / (n_t n_c)) / log(N / n_c)

where N and every n count distinct texts, so copies of a document are one observation of each: n_t
of those that hold t, n_tc of those where t stands by c, n_c of those where any term does. 1 means that
the term says as much as the entity itself. A term with disclosure >= THRESHOLD (half of the entity's
information), seen by c in SUPPORT texts at least (in one text alone every rare word would do), reveals
c, unless chance would do: if terms and entities were spread over the texts independently, e = n_t n_c / N texts were expected to hold both, and
n_tc or more with a probability below exp(n_tc - e - n_tc log(n_tc / e)) (Chernoff), which must be CHANCE / (pairs tested) at
most, so that in all the corpus a chance finding is expected CHANCE times. Where a revealing term stands by c, it becomes a span of kind `term`, to be generalised like the base spans.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; spans of
one kind never overlap, spans of different kinds may (sanitised text merges them); repeated rows are
judged alike and each returned; columns pass through, those named base or spans are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, slices, stored

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD, SUPPORT, CONTEXT, CHANCE = 0.5, 2, 100, 0.05
SIEVE_BITS = 1 << 25
#: The base patterns, with possessive runs where these can't change a match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What every base value holds a match of.
HINT = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|\+[0-9]|[0-9](?:[ -]?[0-9]){11}"
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    if not text:
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
NEAR = T.StructType([T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def near_terms(text: str, spans: list[tuple[int, int, int]], context: int = CONTEXT) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms by each base span that no base span overlaps. `spans` are sorted."""
    ends = np.maximum.accumulate([e for _, _, e in spans]).tolist()
    starts = [s for s, _, _ in spans]
    for start, kind, end in spans:
        entity = f"{KINDS[kind]}={text[start:end].lower()}"
        low, high = text.rfind("\n", max(0, start - context), start) + 1, text.find("\n", end, end + context)
        low, high = low or max(0, start - context), min(len(text), end + context) if high < 0 else high
        for m in (*TERM.finditer(text, low, start), *TERM.finditer(text, end, high)):
            a, b = m.span()
            if (a == low and a and text[a - 1].isalpha()) or (b == high and b < len(text) and text[b].isalpha()):
                continue  # only a part of a word
            before = bisect_left(starts, b)  # spans that begin before the term's end
            if not before or ends[before - 1] <= a:
                yield entity, m[0].lower(), a, b


def with_base(df: DataFrame, text: str, base: str, near: str) -> DataFrame:
    """`df` with base spans and near_terms."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(base, T.ArrayType(SPAN)), T.StructField(near, T.ArrayType(NEAR))])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, terms = [], []
            for t in batch.column(text).to_pylist():
                found = base_spans(t)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                terms.append([dict(zip(("entity", "term", "start", "end"), x)) for x in near_terms(t, found)] if found else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, span_type), pa.array(terms, near_type)], [*names, base, near])

    return bounded_batches(df).mapInArrow(run, schema)


def sieve(terms: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits with that of every term set, so of bounded size: a term whose bit is not set isn't in `terms`."""
    bit = terms.select(F.pmod(F.xxhash64("term"), F.lit(SIEVE_BITS)).alias("bit"))
    words = bit.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).collect()
    out = np.zeros(SIEVE_BITS // 32, "<u4")
    out[[r["at"] for r in words]] = [r.bits for r in words]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def text_counts(df: DataFrame, text: str, copy: str, terms: DataFrame) -> DataFrame:
    """(term, n): in how many distinct texts each of `terms` stands (and some others, which a sieve lets through). Counted per
    task first, in bounded tables."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(sieve(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shared.value).astype(bool)
        counts: dict[str, int] = {}
        others: set[str] = set()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                for w in set(TERM.findall(t.lower())) - others:
                    if w in counts:
                        counts[w] += 1
                    elif passes[xxhash.xxh64_intdigest(w.encode(), 42) % SIEVE_BITS]:
                        counts[w] = 1
                    else:
                        others.add(w)
                if len(counts) > 300_000:
                    yield flush()
                if len(others) > 300_000:
                    others.clear()
        if counts:
            yield flush()

    once = df.filter(F.col(text).isNotNull()).select(copy, text).dropDuplicates([copy])
    return bounded_batches(once.select(text)).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def entities(value: Column) -> Column:
    """The entities that a value (kind=text) stands for: itself, its class and its kind."""
    kind, text = F.substring_index(value, "=", 1), F.regexp_replace(value, "^[a-z]+=", "")
    digits = F.regexp_replace(text, "[^0-9]", "")
    own = F.when(kind == "email", F.substring_index(text, "@", -1)).when(kind == "ip", F.substring_index(text, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(value, F.concat(kind, F.lit("~"), own), F.concat(kind, F.lit(":")))


def paired(near: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, n_tc) of the pairs in `support` texts at least; `near`: (copy, entity, term), copy is a text's hash."""
    return near.select("copy", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_tc")).filter(F.col("n_tc") >= support)


def disclosures(near: DataFrame, pairs: DataFrame, counts: DataFrame, texts: int, threshold: float = THRESHOLD, chance: float = CHANCE) -> DataFrame:
    """(entity, term, disclosure) above the threshold and above chance. `pairs`: paired(near); `counts`: (term, n); `texts`: distinct texts."""
    entities = near.select("copy", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    kind = F.col("entity").endswith(":")  # the kinds are few but meet most terms; values are many
    kinds, values = F.broadcast(entities.filter(kind)), entities.filter(~kind).hint("merge")
    met = pairs.filter(kind).join(kinds, "entity").unionByName(pairs.filter(~kind).join(values, "entity"))
    known = met.join(counts.hint("merge"), "term")
    n = F.lit(float(max(2, texts)))
    lift = F.log(n * F.least("n_tc", "n") / (F.col("n") * F.col("n_c")))
    value = lift / F.log(n / F.least("n_c", n - 1))
    beyond = F.col("n_tc") * lift - F.col("n_tc") + F.col("n") * F.col("n_c") / n  # minus the log of the bound
    tested = math.log(max(1, pairs.count()) / chance)
    return known.filter(beyond >= tested - 1e-9).select("entity", "term", value.alias("disclosure")).filter(F.col("disclosure") >= threshold - 1e-9)


def find(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """`df` with base and spans (arrays of start, kind, end; kind indexes KINDS).

    Spans are a function of the text, so terms are met by its 128-bit hash. Texts without a HINT hold no base value:
    they neither leave the JVM nor are shuffled with the others.
    """
    kept = [c for c in df.columns if c not in ("base", "spans")]
    copy, base, near, extra = (fresh(df, x) for x in ("copy", "base", "near", "extra"))
    own = df.select(*[F.col(f"`{c}`") for c in kept])
    some = F.coalesce(F.col(text).rlike("[@0-9]") & F.col(text).rlike(HINT), F.lit(False))
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    held = with_base(own.filter(some).select(digest.alias(copy), text), text, base, near).filter(F.size(near) > 0)
    held = stored(held.select(F.col(copy).alias("copy"), F.col(near).alias("near")).dropDuplicates(["copy"]), "pii-near")
    by = held.select("copy", F.explode("near").alias("x")).select("copy", "x.*")
    by = by.withColumn("entity", F.explode(entities(F.col("entity"))))
    once = own.filter(F.col(text).isNotNull()).select(digest.alias("copy"), F.col(text).alias("text"))
    texts = once.select("copy").distinct().count()
    pairs = stored(paired(by, support), "pii-pairs")
    reveal = stored(disclosures(by, pairs, text_counts(once, "text", "copy", by), texts, threshold), "pii-terms")
    hits = by.join(reveal, ["entity", "term"]).select(F.col("copy").alias(copy), F.struct("start", F.lit(4).alias("kind"), "end").alias("s"))
    hits = hits.groupBy(copy).agg(F.collect_set("s").alias(extra))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    met = with_base(own.filter(some).withColumn(copy, digest), text, base, near).drop(near).join(hits.hint("merge"), copy, "left")
    both = met.unionByName(own.filter(~some).withColumn(base, none), allowMissingColumns=True)
    return both.select(*[F.col(f"`{c}`") for c in kept], F.col(base).alias("base"), F.array_sort(F.concat(base, F.coalesce(extra, none))).alias("spans"))


def listed(spans: str):
    """kind:start:end, comma-joined, by start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """`text` with every span (start, kind, end) generalised to its kind; overlapping spans become one."""
    if text is None:
        return None
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def sanitised(df: DataFrame, text: str = "text", spans: str = "spans", into: str = "sanitised") -> DataFrame:
    """`df` with its texts sanitised; only texts with spans leave the JVM."""

    @F.pandas_udf(T.StringType())
    def run(texts, found):
        import pandas as pd

        return pd.Series([sanitise(t, [(s["start"], s["kind"], s["end"]) for s in ([] if x is None else np.asarray(x, object).tolist())]) for t, x in zip(texts, found)], dtype=object)

    some = F.size(spans) > 0
    return df.withColumn(into, F.coalesce(run(F.when(some, F.col(text)), F.when(some, F.col(spans))), F.col(text)))
