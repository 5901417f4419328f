"""Many patterns against many texts: Aho-Corasick automata in Arrow batches.

Patterns are measured first. Up to SHARD characters of them become one automaton, which is broadcast; more are dealt by their
owner to shards of about that size, and every shard passes over the texts by itself. Texts are never shuffled: what leaves a
task are matches. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD, ROWS = 16_000_000, 256


def folded(text: str) -> str:
    """Lower case, character by character where that keeps the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(patterns: dict[str, object]) -> ahocorasick.Automaton | None:
    """Finds the keys of `patterns`; a match gives the value. None for no patterns."""
    if not patterns:
        return None
    built = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        built.add_word(pattern, value)
    built.make_automaton()
    return built


def is_word(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has no letter, digit or underscore beside it."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_"))


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans (start, end) that a search from left to right takes: the longest at a place, then on from its end."""
    out, at = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append((start, end))
            at = end
    return out


def shards(patterns: DataFrame, owner: list[str], pattern: str, size: int = SHARD) -> Iterator[pa.Table]:
    """The rows of `patterns`, all of an owner's together, in tables of about `size` characters."""
    total = patterns.agg(F.sum(F.length(pattern))).first()[0]
    if not total:
        return
    n = -(-total // size)
    for k in range(n):
        yield patterns.filter(F.pmod(F.xxhash64(*owner), F.lit(n)) == k).toArrow() if n > 1 else patterns.toArrow()


def scanned(df: DataFrame, keys: list[str], text: str, found: DataFrame, automata: list[object], rows: Callable[[str, object], list[tuple]]) -> DataFrame:
    """`keys` of `df` and the columns of `found` (an empty frame with their types): what `rows(text, automata)` lists for each text that isn't null."""
    spark, out = df.sparkSession, None
    kinds = [f.type for f in found.toArrow().schema]
    own = df.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*own.drop("_text").schema.fields, *found.schema.fields])

    for built in automata:
        shared = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part, lists, owners = batch.slice(at, ROWS), [], []
                    for i, t in enumerate(part.column(len(keys)).to_pylist()):
                        made = rows(t, shared.value)
                        lists += made
                        owners += [i] * len(made)
                    if lists:
                        taken = [c.take(pa.array(owners, pa.int32())) for c in part.columns[: len(keys)]]
                        yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, kind) for c, kind in zip(zip(*lists), kinds))], schema.names)

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
