"""Knowledge-graph bundles: objects to node tables and whitelisted edges. Document trees to items."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.functions.text import external_id, strip_citations
from threatloom.session import stored

OBJECT = (
    "type string, id string, name string, description string, created string, modified string, revoked boolean, x_mitre_deprecated boolean, x_mitre_version string, "
    "external_references array<struct<source_name:string,external_id:string>>, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, "
    "x_mitre_is_subtechnique boolean, x_mitre_platforms array<string>, x_mitre_detection string, aliases array<string>, x_mitre_aliases array<string>, "
    "x_mitre_shortname string, relationship_type string, source_ref string, target_ref string"
)
#: Node label of each object type, and the relationships that become edges.
LABELS = {"attack-pattern": "Technique", "intrusion-set": "Group", "tool": "Software", "malware": "Software", "course-of-action": "Mitigation", "x-mitre-tactic": "Tactic"}
EDGES = (("Group", "uses", "Technique"), ("Software", "uses", "Technique"), ("Group", "uses", "Software"), ("Mitigation", "mitigates", "Technique"), ("Technique", "subtechnique-of", "Technique"))
DOMAIN = "mitre-attack"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The live objects of bundle files; of several with one id the last counts."""
    bundle = spark.read.schema(f"objects array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields())}>>").option("multiLine", True).json(path)
    each = bundle.select(F.col("_metadata.file_path").alias("_file"), F.posexplode("objects").alias("_pos", "o"))
    return each.groupBy("o.id").agg(F.max_by("o", F.struct("_file", "_pos")).alias("o")).select("o.*")


def _fields() -> list[str]:
    out, depth, now = [], 0, ""
    for ch in OBJECT:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))


def nodes(all_objects: DataFrame) -> DataFrame:
    """label, stix_id, attack_id, name, description, ... of every live object with a label."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("type"))
    none = F.array().cast("array<string>")
    own = F.coalesce("aliases", none)
    return live(all_objects).filter(F.col("type").isin(*LABELS)).select(
        label.alias("label"), F.col("id").alias("stix_id"), external_id(F.col("external_references"), DOMAIN).alias("attack_id"), "name", strip_citations(F.col("description")).alias("description"), "created", "modified",
        F.col("x_mitre_version").alias("version"), F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"), F.coalesce("x_mitre_platforms", none).alias("platforms"),
        F.transform(F.filter(F.coalesce("kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"] == DOMAIN), lambda p: p["phase_name"]).alias("tactic_refs"),
        F.when(F.size(own) > 0, own).otherwise(F.coalesce("x_mitre_aliases", none)).alias("aliases"), F.col("x_mitre_shortname").alias("shortname"), F.when(F.col("type").isin("tool", "malware"), F.col("type")).alias("software_type"),
    )


def edges(all_objects: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """type, src, dst, stix_rel_id, description of live relationships of allowed kinds whose ends exist."""
    r = live(all_objects).filter("type = 'relationship'").select("source_ref", "relationship_type", "target_ref", F.col("id").alias("stix_rel_id"), strip_citations(F.col("description")).alias("description"))
    end = lambda name, ref: all_nodes.select(F.col("stix_id").alias(ref), F.col("label").alias(name))
    met = r.join(end("_from", "source_ref"), "source_ref").join(end("_to", "target_ref"), "target_ref")
    allowed = F.struct("_from", "relationship_type", "_to").isin(*[F.struct(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in EDGES])
    kind = F.upper(F.replace("relationship_type", F.lit("-"), F.lit("_")))
    return met.filter(allowed).select(kind.alias("type"), F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), "stix_rel_id", "description").dropDuplicates(["type", "src", "dst"])


def tactic_edges(all_nodes: DataFrame) -> DataFrame:
    """ENABLES_TACTIC: technique to tactic by short name; unknown phases give none."""
    phases = all_nodes.filter("label = 'Technique'").select(F.col("stix_id").alias("src"), F.explode("tactic_refs").alias("shortname"))
    tactics = all_nodes.filter("label = 'Tactic'").select("shortname", F.col("stix_id").alias("dst"))
    return phases.join(tactics, "shortname").select(F.lit("ENABLES_TACTIC").alias("type"), "src", "dst").distinct()


def tree_items(trees: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, label, level, text, page of a document tree in reading order.

    body.children references (`#/texts/3`, `#/groups/0`) are resolved by path doubling: each round puts what a group holds in the place of
    every group inside another, so groups of any depth d are open after log2(d) rounds, each one join and one stored table. Other and
    dangling references are skipped, and a group inside itself is an error.
    """
    number = lambda ref: F.when(F.col(ref).startswith("#/groups/"), F.regexp_extract(ref, r"(\d+)$", 1).cast("int"))
    texts = trees.select(key, F.posexplode("texts").alias("n", "x")).select(key, "n", "x.*")
    held = trees.select(key, F.posexplode("groups").alias("group", "g")).select(key, "group", F.posexplode("g.children").alias("i", "c"))
    held = stored(held.select(key, "group", F.array("i").alias("path"), F.array("group").alias("inside"), F.col("c.$ref").alias("ref")).withColumn("next", number("ref")), "tree-groups")
    while not (nested := held.filter("next is not null")).isEmpty():
        deeper = held.select(F.col(key).alias("_key"), F.col("group").alias("_group"), F.col("path").alias("_path"), F.col("inside").alias("_inside"), F.col("ref").alias("_ref"), F.col("next").alias("_next"))
        met = nested.join(deeper, (F.col(key) == F.col("_key")) & (F.col("next") == F.col("_group")))
        path = F.when(F.arrays_overlap("inside", "_inside"), F.raise_error(F.lit("a group is inside itself")).cast("array<int>")).otherwise(F.concat("path", "_path"))
        met = met.select(key, "group", path.alias("path"), F.concat("inside", "_inside").alias("inside"), F.col("_ref").alias("ref"), F.col("_next").alias("next"))
        held = stored(held.filter("next is null").unionByName(met), "tree-groups")
    body = trees.select(key, F.posexplode("body.children").alias("i", "c")).select(key, F.array("i").alias("path"), F.col("c.$ref").alias("ref")).withColumn("next", number("ref"))
    below = held.select(F.col(key).alias("_key"), "group", F.col("path").alias("_path"), F.col("ref").alias("_ref"))
    inner = body.join(below, (F.col(key) == F.col("_key")) & (F.col("next") == F.col("group"))).select(key, F.concat("path", "_path").alias("path"), F.col("_ref").alias("ref"))
    leaves = body.select(key, "path", "ref").unionByName(inner).filter(F.col("ref").startswith("#/texts/"))
    met = leaves.withColumn("n", F.regexp_extract("ref", r"(\d+)$", 1).cast("int")).join(texts, [key, "n"])
    page = F.get(F.filter(F.transform("prov", lambda p: p["page_no"]), lambda p: p.isNotNull()), F.lit(0))
    return met.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("path")) - 1).alias("pos"), "label", "level", "text", page.alias("page"))


def first_available(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The objects of the first path that can be read (a given file, then a cache, ...). Downloads are out of scope."""
    for path in paths:
        try:
            return objects(spark, path)
        except AnalysisException:  # no such path
            continue
    raise FileNotFoundError(", ".join(paths))


def document_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, json_path, md_path): parsed and Markdown files paired by stem; names that begin with `_` and run summaries are skipped."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.element_at(F.split(name, r"\."), -1)
    some = files.filter(suffix.isin("json", "md") & ~name.startswith("_") & ~F.contains(name, F.lit("parse_summary")))
    of = lambda kind: F.max(F.when(suffix == kind, F.col(path)))
    return some.groupBy(stem.alias("stem")).agg(of("json").alias("json_path"), of("md").alias("md_path"))
