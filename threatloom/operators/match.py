"""Dictionary matching: keyword categories, entity mentions, counters, contexts, alias dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.functions.text import is_codename, stripped
from threatloom.operators import automaton


def _any_of(low: Column, patterns: list[str]) -> Column:
    """Whether lower-cased text holds one of the patterns, as a balanced disjunction."""
    if len(patterns) == 1:
        return F.contains(low, F.lit(patterns[0]))
    return _any_of(low, patterns[: len(patterns) // 2]) | _any_of(low, patterns[len(patterns) // 2 :])


def categories(low: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the categories with a pattern that is part of the lower-cased text `low`, in map order.

    A keyword map has a few hundred literal patterns: they are an expression, not a join.
    """
    lists = {name: list(dict.fromkeys(p.lower() for p in patterns)) for name, patterns in keywords.items()}
    return F.array_compact(F.array(*[F.when(_any_of(low, patterns), F.lit(name)) for name, patterns in lists.items() if patterns]))


def classified(df: DataFrame, text: str, keywords: dict[str, list[str]], exclude: list[str]) -> DataFrame:
    """`df` with categories and excluded: blank text is excluded; an exclude pattern counts only where no category matches.

    The text is lower-cased once, below both expressions.
    """
    out = df.withColumn("_low", F.lower(F.col(text)))
    low = F.col("_low")
    out = out.withColumn("categories", F.coalesce(categories(low, keywords), F.array().cast("array<string>")))
    barred = _any_of(low, [p.lower() for p in exclude]) if exclude else F.lit(False)
    return out.withColumn("excluded", (F.size("categories") == 0) & F.coalesce(barred | (F.trim(low) == ""), F.lit(True))).drop("_low")


def phrase_mentions(docs: DataFrame, phrases: DataFrame, key: str | list[str], text: str, item: str, phrase: str, shard: int = automaton.SHARD) -> DataFrame:
    """(key, item, at): first place (from 1) of every phrase in every text that holds it. Empty phrases stand nowhere."""
    keys = [key] if isinstance(key, str) else key
    asked = phrases.filter(F.length(phrase) > 0).select(item, phrase)
    built = []
    for part in automaton.shards(asked, [item], phrase, shard):
        held: dict[str, tuple[int, set]] = {}
        for i, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            held.setdefault(p, (len(p), set()))[1].add(i)
        built.append(automaton.automaton(held))

    def first(t: str, found) -> list[tuple]:
        at: dict[object, int] = {}
        for end, (size, items) in found.iter(t):
            for i in items:
                at[i] = min(at.get(i, end), end - size + 1)
        return [(i, k + 1) for i, k in at.items()]

    return automaton.scanned(docs, keys, text, asked.limit(0).select(item, F.lit(0).alias("at")), built, first)


def first_contexts(mentions: DataFrame, by: list[str], order: list[str], context: str, n: int = 10) -> DataFrame:
    """Per key: chunk_count and the first n contexts in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = mentions.withColumn("_n", rank)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= n, F.struct("_n", context)))), lambda s: s[context])
    return ranked.groupBy(*by).agg(F.count("*").alias("chunk_count"), kept.alias("contexts"))


def id_counts(df: DataFrame, text: str, pattern: str, top: int = 20) -> DataFrame:
    """The most frequent matches of a pattern."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(top)


def alias_dictionary(entities: DataFrame, stoplist: DataFrame, least: int = 4) -> DataFrame:
    """(canonical, attack_id, type, alias, pattern, exact): aliases of `least` letters at least that are not
    stop words, once each per entity (ignoring case), longest first. Code names match exactly, others ignore case."""
    each = entities.select("canonical", "attack_id", "type", F.posexplode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "alias"))
    each = each.withColumn("key", F.lower(F.trim("alias"))).filter(F.length("key") >= least)
    each = each.join(stoplist.select(F.lower("key").alias("key")).distinct(), "key", "left_anti")
    first = Window.partitionBy("attack_id", "key").orderBy("pos")
    each = each.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "pos")
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.trim("alias"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    exact = is_codename(F.trim("alias"))
    return each.select("canonical", "attack_id", "type", "alias", exact.alias("exact"), F.when(exact, word).otherwise(F.concat(F.lit("(?iu)"), word)).alias("pattern")).orderBy("attack_id", F.desc(F.length("alias")), "alias")


def entity_mentions(chunks: DataFrame, aliases: DataFrame, key: list[str], text: str = "text", shard: int = automaton.SHARD) -> DataFrame:
    """key columns, attack_id, type, canonical, n, strategy and context of every entity in every text.

    n adds the matches of code names (exact) and of other aliases (any case) that stand as words; each search goes from left to
    right and takes the longest alias at a place. strategy and context are those of the first exact match if there is one.
    """
    asked = aliases.select("attack_id", "type", "canonical", "exact", F.trim("alias").alias("alias")).filter("alias <> ''")
    built = []
    for part in automaton.shards(asked, ["attack_id", "type", "canonical"], "alias", shard):
        held: tuple[dict, dict] = ({}, {})
        for row in part.to_pylist():
            alias = row["alias"] if row["exact"] else automaton.folded(row["alias"])
            held[0 if row["exact"] else 1].setdefault(alias, (len(alias), set()))[1].add((row["attack_id"], row["type"], row["canonical"]))
        built.append((automaton.automaton(held[0]), automaton.automaton(held[1])))

    def found(t: str, both) -> list[tuple]:
        spans: dict[tuple, tuple[list, list]] = {}
        for k, (search, seen) in enumerate(zip(both, (t, automaton.folded(t)))):
            for end, (size, entities) in search.iter(seen) if search else ():
                start, end = end - size + 1, end + 1
                if automaton.is_word(t, start, end):
                    for e in entities:
                        spans.setdefault(e, ([], []))[k].append((start, end))
        rows = []
        for e, lists in spans.items():
            exact, other = map(automaton.disjoint, lists)
            rows.append((*e, len(exact) + len(other), "case-sensitive" if exact else "case-insensitive", _around(t, *(exact or other)[0])))
        return rows

    kind = aliases.limit(0).select("attack_id", "type", "canonical", F.lit(0).alias("n"), F.lit("").alias("strategy"), F.lit("").alias("context"))
    return automaton.scanned(chunks, key, text, kind, built, found)


def _around(text: str, start: int, end: int, window: int = 100) -> str:
    """As functions.text.snippet."""
    a, b = max(0, start - window), min(len(text), end + window)
    return "..." * (a > 0) + text[a:b].replace("\n", " ").strip(" ") + "..." * (b < len(text))


def entity_totals(mentions: DataFrame, order: list[str], source: str, section: str) -> DataFrame:
    """Per entity (canonical): count, chunks, and attack_id, type, strategy, sample, source, section of its first mention by `order`."""
    first = F.min_by(F.struct("attack_id", "type", "strategy", F.col("context").alias("sample"), F.col(source).alias("source"), F.col(section).alias("section")), F.struct(*order))
    return mentions.groupBy("canonical").agg(F.sum("n").alias("count"), F.count("*").alias("chunks"), first.alias("_f")).select("canonical", "count", "chunks", "_f.*")


def corpus_totals(chunks: DataFrame, totals: DataFrame, text: str, record: str, technique: str) -> DataFrame:
    """One row: chunks, entities (matched), records and techniques (distinct ids in the texts)."""
    ids = lambda pattern, name: chunks.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("id")).agg(F.countDistinct("id").alias(name))
    parts = [chunks.agg(F.count("*").alias("chunks")), totals.agg(F.count("*").alias("entities")), ids(record, "records"), ids(technique, "techniques")]
    return parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # one row each


def match_report(totals: DataFrame, records: DataFrame, techniques: DataFrame, corpus: DataFrame, version: str = "unknown", top: int = 50) -> str:
    """The match report as Markdown: the `top` entities with sample contexts, and the id counts. Only these rows reach the driver."""
    ranked = totals.orderBy(F.desc("count"), "canonical").limit(top).collect()
    c = corpus.first()
    rule = lambda names: [f"| {' | '.join(names)} |", "|-" * len(names) + "|"]
    lines = ["# Entity match report", "", f"Dictionary version: {version}", f"{c.chunks} chunks, {c.entities} entities, {c.records} record ids, {c.techniques} technique ids", "", f"## Top {top} entities", ""]
    lines += rule(["rank", "entity", "id", "type", "strategy", "occurrences", "chunks"])
    lines += [f"| {k} | {r.canonical} | {r.attack_id} | {r.type} | {r.strategy} | {r['count']} | {r.chunks} |" for k, r in enumerate(ranked, 1)]
    lines += ["", "## Samples", ""]
    for k, r in enumerate(ranked, 1):
        lines += [f"{k}. **{r.canonical}** in {r.source} ({r.section or '-'}): {(r['sample'] or '').replace('`', chr(39))}"]
    for title, counts in (("Record ids", records), ("Technique ids", techniques)):
        lines += ["", f"## {title}", "", *rule(["rank", "id", "occurrences"]), *[f"| {k} | {r.id} | {r.n} |" for k, r in enumerate(counts.collect(), 1)]]
    return "\n".join(lines) + "\n"


def keyword_map(path: str) -> tuple[dict[str, list[str]], list[str]]:
    """(categories, exclude), lower-cased, of a YAML or JSON file with `categories: {name: [pattern]}` and `exclude: [pattern]`."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            held = json.load(f)
        else:
            import yaml

            held = yaml.safe_load(f)
    low = lambda patterns: [str(p).lower() for p in patterns or []]
    return {name: low(patterns) for name, patterns in (held.get("categories") or {}).items()}, low(held.get("exclude"))


ENTITY = "canonical string, attack_id string, type string, aliases array<string>"


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The entities (canonical, attack_id, type, aliases) of alias dictionary files."""
    each = ",".join(f.replace(" ", ":", 1) for f in ENTITY.split(", "))
    return spark.read.schema(f"version string, entities array<struct<{each}>>").option("multiLine", True).json(path).select(F.explode("entities").alias("e")).select("e.*")


def entities_of(nodes: DataFrame, stoplist: DataFrame, least: int = 4) -> DataFrame:
    """Entities of the group and software nodes (label, name, attack_id, aliases). Aliases are stripped, `least` characters
    long at least, no stop words (key), and distinct in any case: the first spelling stays, in its place."""
    own = nodes.filter(F.col("label").isin("Group", "Software")).select(F.col("name").alias("canonical"), "attack_id", F.lower("label").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    each = own.select("attack_id", "canonical", "type", F.posexplode("aliases").alias("pos", "alias")).withColumn("alias", stripped(F.col("alias"))).filter(F.length("alias") >= least)
    each = each.withColumn("key", F.lower("alias")).join(stoplist.select(F.lower("key").alias("key")).distinct(), "key", "left_anti")
    first = each.groupBy("attack_id", "canonical", "type", "key").agg(F.min(F.struct("pos", "alias")).alias("x"))
    kept = first.groupBy("attack_id", "canonical", "type").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["alias"]).alias("kept"))
    named = own.join(kept, ["attack_id", "canonical", "type"], "left")
    return named.select("canonical", "attack_id", "type", F.coalesce("kept", F.array().cast("array<string>")).alias("aliases"))


def alias_audit(nodes: DataFrame, common_words: DataFrame, least: int = 4, short: int = 5) -> DataFrame:
    """(problem, alias, length, entity, type): aliases of up to `short` characters (`short`), and those that are one word of letters in
    `common_words` (word) (`common`); in order of problem, length of the short ones, and spelling."""
    raw = nodes.filter(F.col("label").isin("Group", "Software")).select(F.explode("aliases").alias("alias"), F.col("name").alias("entity"), F.lower("label").alias("type"))
    raw = raw.withColumn("alias", stripped(F.col("alias"))).withColumn("length", F.length("alias")).filter(F.col("length") >= least)
    known = raw.filter(F.col("alias").rlike("^[A-Za-z]+$")).join(common_words.select(F.lower("word").alias("_w")).distinct(), F.lower("alias") == F.col("_w"), "left_semi")
    both = raw.filter(F.col("length") <= short).withColumn("problem", F.lit("short")).unionByName(known.withColumn("problem", F.lit("common")))
    return both.select("problem", "alias", "length", "entity", "type").orderBy(F.desc("problem"), F.when(F.col("problem") == "short", F.col("length")), F.lower("alias"), "entity")


def alias_stats(entities: DataFrame) -> DataFrame:
    """n_groups, n_software, n_aliases_total: one row."""
    return entities.agg(F.count_if(F.col("type") == "group").alias("n_groups"), F.count_if(F.col("type") == "software").alias("n_software"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("n_aliases_total"))


def write_aliases(entities: DataFrame, path: str, version: str = "unknown") -> None:
    """The dictionary as one JSON file under `path`: version, entities in order (groups first, by id) and _stats.

    A dictionary is one document by format; its entities are the named groups and programs, a few thousand.
    """
    rows = entities.agg(F.transform(F.array_sort(F.collect_list(F.struct("type", "attack_id", "canonical", "aliases"))), lambda e: F.struct(e["canonical"].alias("canonical"), e["attack_id"].alias("attack_id"), e["type"].alias("type"), e["aliases"].alias("aliases"))).alias("entities"))
    whole = rows.join(alias_stats(entities).select(F.struct("*").alias("_stats")))  # one row by one row
    whole.select(F.lit(version).alias("version"), "entities", "_stats").coalesce(1).write.mode("overwrite").json(path)
