"""Property graphs as node and edge tables: hops, counts, keyed upserts, edge derivation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threatloom.functions.text import uuid5
from threatloom.operators.numbersets import counted_members, pieces, whole


def hop(edges: DataFrame, nodes: DataFrame, on: str, key: str) -> DataFrame:
    """Edges with the columns of the node they end in; edges without that node go."""
    return edges.join(nodes, edges[on] == nodes[key]).drop(nodes[key]) if on != key else edges.join(nodes, key)


def neighbours(edges: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """`by`, and the sorted array of distinct `value`s."""
    return edges.filter(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(value)).alias(into))


def two_hops(first: DataFrame, second: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Distinct (start, end) over first (start, middle) and second (middle, end). Both sides are made distinct before they meet.

    What meets is dealt by `start`, so that it becomes distinct there and can be grouped by `start` without another shuffle.
    """
    return first.select(start, middle).distinct().join(second.select(middle, end).distinct(), middle).select(start, end).repartition(start).distinct()


def two_hop_counts(first: DataFrame, second: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """start, n and least: how many distinct ends two_hops gives of each start (null is one), and the least of them.

    Ends that are integers travel as compact sets, each `middle`'s sorted once, so that no pair is shuffled; others as pairs.
    """
    kind = second.schema[end].dataType
    if not whole(kind) or not (whole(first.schema[start].dataType) or isinstance(first.schema[start].dataType, T.StringType)):
        return two_hops(first, second, start, middle, end).groupBy(start).agg(F.count("*").alias("n"), F.min(end).alias("least"))
    sets = pieces(second.filter(F.col(middle).isNotNull()), [middle], end, "_ends")
    met = first.select(start, middle).distinct().join(sets, middle)
    return counted_members(met, start, "_ends").withColumn("least", F.col("least").cast(kind))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """label, n: rows of each table, most first."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("n"), "label")


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; Spark limits per partition before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_nodes(old: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Upsert by key. Null properties keep the old value, unless `overwrite`; columns of either side survive."""
    n, o = new.alias("n"), old.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c == key:
            continue
        if c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}").alias(c))
        else:
            out.append((F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if overwrite else F.coalesce(f"n.{c}", f"o.{c}")).alias(c))
    return both.select(*out)


def merge_edges(old: DataFrame, new: DataFrame, key: list[str], sources: DataFrame, targets: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Upsert edges (src, dst, ...) whose ends exist; of several rows of a key in `new` the last by `order` wins over `old`.

    Without an order, the largest row (by all its columns) is the last. Columns of `old` decide what is kept.
    """
    ends = new.join(sources.select(F.col(sources.columns[0]).alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col(targets.columns[0]).alias("dst")).distinct(), "dst", "left_semi")
    rest = F.struct(*ends.columns)
    ranked = F.struct(F.struct(*order).alias("by"), rest.alias("row")) if order else F.struct(rest.alias("row"))
    fresh = ends.groupBy(*key).agg(F.max(ranked).alias("_last")).select("_last.row.*")
    return old.join(fresh, key, "left_anti").unionByName(fresh.select(*old.columns))


#: Edge types that extracted relationships may have.
EXTRACTED = ("EXPLOITS", "AFFECTS", "TARGETS", "USES", "RELATED_TO")


def merge_document_edges(old: DataFrame, new: DataFrame, kind: str, sources: DataFrame, targets: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Upsert extracted edges of one allowed type, one a (src, dst, source_doc): null texts become empty, null confidences 0."""
    if kind not in EXTRACTED:
        raise ValueError(f"not an allowed edge type: {kind}")
    filled = new.withColumns({"description": F.coalesce("description", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "source_doc": F.coalesce("source_doc", F.lit(""))})
    return merge_edges(old, filled.withColumn("type", F.lit(kind)), ["type", "src", "dst", "source_doc"], sources, targets, order)


def mention_edges(mentions: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """MENTIONS edges (type, src, dst, chunk_count, contexts) of per-report mentions (source, attack_id, type, chunk_count,
    contexts) to the node (label, attack_id, stix_id) with that id and the type's label; without both ends there is no edge."""
    ends = nodes.select("attack_id", F.lower("label").alias("type"), F.col("stix_id").alias("dst"))
    known = reports.select(F.col("source").alias("src")).distinct()
    return mentions.withColumnRenamed("source", "src").join(known, "src", "left_semi").join(ends, ["attack_id", "type"]).select(F.lit("MENTIONS").alias("type"), "src", "dst", "chunk_count", "contexts")


def label_scan(nodes: DataFrame, label: str, *columns: str, order: str = "attack_id") -> DataFrame:
    """The nodes of one label in order; the filter and the columns (all by default) reach the scan. Ids that tie, and null ones first, go by name."""
    return nodes.filter(F.col("label") == label).orderBy(F.asc_nulls_first(order), "name").select(*(columns or nodes.columns))


def technique_map(spark: SparkSession, path: str) -> DataFrame:
    """(cwe, techniques in order of priority) of a JSON object {cwe: [technique, ...]}; of a repeated key the last counts."""
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("pos", "e"))
    return each.groupBy(F.upper(F.col("e.key")).alias("cwe")).agg(F.max_by("e.value", "pos").alias("techniques"))


def named(nodes: DataFrame, part: str, name: str = "name") -> DataFrame:
    """Nodes whose name holds `part` (case counts)."""
    return nodes.filter(F.contains(name, F.lit(part)))


def collected(edges: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """`by`, and the sorted array of `value`s with repeats."""
    return edges.filter(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(into))


def top_names(edges: DataFrame, by: str, name: str, n: int = 20) -> DataFrame:
    """(by, name): the first n distinct names of each key in order; Spark limits per partition before it shuffles."""
    order = Window.partitionBy(by).orderBy(name)
    return edges.select(by, name).distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def counted(edges: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """`by`, and how many distinct `value`s it meets."""
    return edges.select(by, value).distinct().groupBy(by).agg(F.count(value).alias(into))


#: Fixed value: namespace of the ids of vulnerability and relationship objects.
OBJECT_NAMESPACE = "4f6e8b2a1c3d5e7f9a0b2c4d6e8f1a3b"


def vulnerabilities(records: DataFrame) -> DataFrame:
    """Vulnerability objects of records (cve_id, description, cvss_score, severity, cwe_ids, published_date): id, name, description,
    created (start of the day of publication, null if that is no date), external_references and the x_ properties."""
    ids = F.coalesce("cwe_ids", F.array().cast("array<string>"))
    reference = lambda source, key, url: F.struct(F.lit(source).alias("source_name"), key.alias("external_id"), url.alias("url"))
    own = F.array(reference("cve", F.col("cve_id"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cve_id")))
    others = F.transform(ids, lambda c: reference("cwe", c, F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.replace(c, F.lit("CWE-"), F.lit("")), F.lit(".html"))))
    return records.select(
        F.concat(F.lit("vulnerability--"), uuid5(OBJECT_NAMESPACE, F.col("cve_id"))).alias("id"), F.lit("vulnerability").alias("type"), F.col("cve_id").alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.col("published_date").try_cast("date").alias("created"), F.concat(own, others).alias("external_references"),
        F.col("cvss_score").alias("x_cvss_score"), F.col("severity").alias("x_severity"), ids.alias("x_cwe_ids"), F.col("published_date").alias("x_published_date"),
    )


def relationships(derived: DataFrame, techniques: DataFrame) -> DataFrame:
    """Relationship objects of derived edges (cve_id, technique, cwe_id) to techniques (attack_id, stix_id)."""
    met = derived.join(techniques.select(F.col("attack_id").alias("technique"), F.col("stix_id").alias("target_ref")), "technique")
    source = F.concat(F.lit("vulnerability--"), uuid5(OBJECT_NAMESPACE, F.col("cve_id")))
    met = met.withColumn("source_ref", source)
    key = F.concat_ws(":", "source_ref", F.lit("pattern-of"), "target_ref")
    text = F.concat("cve_id", F.lit(" ("), "cwe_id", F.lit(") maps to ATT&CK "), "technique")
    return met.select(F.concat(F.lit("relationship--"), uuid5(OBJECT_NAMESPACE, key)).alias("id"), F.lit("pattern-of").alias("relationship_type"), "source_ref", "target_ref", text.alias("description"), F.col("cwe_id").alias("x_cwe_id"), F.col("technique").alias("x_attack_technique_id"))


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and their edges."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    kept = edges.join(ids, edges.src == ids["_gone"], "left_anti").join(ids, F.col("dst") == ids["_gone"], "left_anti")
    return nodes.join(ids, nodes[key] == ids["_gone"], "left_anti"), kept


def derive_edges(records: DataFrame, mapping: DataFrame, techniques: DataFrame) -> DataFrame:
    """(cve_id, technique, cwe_id): records' weaknesses through the mapping (cwe, techniques in order of
    priority) to known techniques; of several ways to one technique the first weakness counts."""
    each = records.select("cve_id", F.posexplode("cwe_ids").alias("cwe_pos", "cwe_id"))
    ways = mapping.select(F.col("cwe").alias("cwe_id"), F.posexplode("techniques").alias("tech_pos", "technique"))
    met = each.join(ways, "cwe_id").join(techniques.select(F.col("attack_id").alias("technique")).distinct(), "technique", "left_semi")
    return keep_first(met, ["cve_id", "technique"], ["cwe_pos", "tech_pos"]).select("cve_id", "technique", "cwe_id")


def coverage(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """total, covered (with repeats), pct, uncovered (distinct, sorted) of the records' weaknesses."""
    each = records.select(F.explode("cwe_ids").alias("cwe"))
    known = mapping.select("cwe", F.lit(1).alias("known")).distinct()
    joined = each.join(known, "cwe", "left")
    covered = F.count("known")
    pct = F.when(F.count("*") == 0, 0.0).otherwise(F.round(100.0 * covered / F.count("*"), 1))
    missing = F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("cwe"))))
    return joined.agg(F.count("*").alias("total"), covered.alias("covered"), pct.alias("pct"), missing.alias("uncovered"))
