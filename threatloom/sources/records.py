"""Vulnerability records (JSON 5.x, one file each): scan, normalise, count, derive identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.text import blank_to_null, english, iso_date, severity, stripped, uuid5, weaknesses

DESCRIPTIONS = "array<struct<lang:string,value:string>>"
SCORE = "struct<baseScore:string,baseSeverity:string,vectorString:string>"
METRICS = f"array<struct<cvssV3_1:{SCORE},cvssV3_0:{SCORE}>>"
PROBLEMS = "array<struct<descriptions:array<struct<cweId:string>>>>"
AFFECTED = "array<struct<vendor:string,product:string,versions:array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string>>>>"
ADP = f"array<struct<descriptions:{DESCRIPTIONS},metrics:{METRICS},problemTypes:{PROBLEMS}>>"
#: `adp` may be a list or one object: as a string, Spark hands its JSON text back.
SCHEMA = (
    "cveMetadata struct<cveId:string,state:string,datePublished:string>, "
    f"containers struct<cna:struct<descriptions:{DESCRIPTIONS},metrics:{METRICS},problemTypes:{PROBLEMS},affected:{AFFECTED}>,adp:string>, _corrupt_record string"
)


def scan(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw records of all CVE-*.json under a folder, with their file; the first `limit` by path."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "CVE-*.json").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    return raw.orderBy("file").limit(limit) if limit else raw


def best_score(metrics: Column) -> Column:
    """struct(score, severity, vector, version) of the highest base score; the first of equals; version 3.1 before 3.0."""
    option = lambda m, name, version: F.struct(m[name]["baseScore"].try_cast("double").alias("score"), m[name]["baseSeverity"].alias("severity"), m[name]["vectorString"].alias("vector"), F.lit(version).alias("version"))
    every = F.flatten(F.transform(metrics, lambda m: F.array(option(m, "cvssV3_1", "3.1"), option(m, "cvssV3_0", "3.0"))))
    known = F.filter(every, lambda x: x["score"].isNotNull())
    best = F.aggregate(F.slice(known, 2, 1_000_000), F.get(known, F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    named = F.struct(best["score"].alias("score"), F.coalesce(F.upper(F.nullif(best["severity"], F.lit(""))), severity(best["score"])).alias("severity"), best["vector"].alias("vector"), best["version"].alias("version"))
    return F.when(F.size(known) > 0, named)


def products(affected: Column) -> Column:
    """Products with a name; only non-blank version keys; versions without any key are dropped."""
    full = lambda v: F.struct(*[F.nullif(v[k], F.lit("")).alias(k) for k in ("version", "lessThan", "lessThanOrEqual", "status")])
    some = lambda v: F.coalesce(v["version"], v["lessThan"], v["lessThanOrEqual"], v["status"]).isNotNull()
    rows = F.transform(affected, lambda a: F.struct(stripped(F.coalesce(a["vendor"], F.lit(""))).alias("vendor"), stripped(F.coalesce(a["product"], F.lit(""))).alias("product"), F.filter(F.transform(F.coalesce(a["versions"], F.array().cast("array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string>>")), full), some).alias("versions")))
    return F.filter(rows, lambda a: a["product"] != "")


def normalised(raw: DataFrame, root: str = "", include_rejected: bool = False) -> DataFrame:
    """Flat records: cve_id, description, cvss_v3, cvss_score, severity, cwe_ids, affected_products, published_date, state, source_file. Corrupt files are skipped."""
    good = raw.filter(F.col("cveMetadata.cveId").isNotNull())
    if not include_rejected:
        good = good.filter(F.coalesce("cveMetadata.state", F.lit("")) != "REJECTED")
    adp = F.from_json(F.when(F.col("containers.adp").startswith("{"), F.concat(F.lit("["), F.col("containers.adp"), F.lit("]"))).otherwise(F.col("containers.adp")), ADP)
    good = good.withColumn("_adp", F.coalesce(adp, F.array().cast(ADP)))
    none = lambda kind: F.array().cast(kind)
    both = lambda name, kind: F.concat(F.coalesce(F.col(f"containers.cna.{name}"), none(kind)), F.flatten(F.transform("_adp", lambda a: F.coalesce(a[name], none(kind)))))
    own = english(F.col("containers.cna.descriptions"))
    others = F.filter(F.transform("_adp", lambda a: english(a["descriptions"])), lambda x: x.isNotNull())
    ids = F.flatten(F.transform(both("problemTypes", PROBLEMS), lambda p: F.transform(F.coalesce(p["descriptions"], F.array().cast("array<struct<cweId:string>>")), lambda d: F.coalesce(d["cweId"], F.lit("")))))
    out = good.select(
        F.col("cveMetadata.cveId").alias("cve_id"), F.coalesce(own, F.get(others, F.lit(0))).alias("description"), best_score(both("metrics", METRICS)).alias("cvss_v3"), weaknesses(ids).alias("cwe_ids"),
        F.coalesce(products(F.col("containers.cna.affected")), none(AFFECTED)).alias("affected_products"), iso_date(F.col("cveMetadata.datePublished")).alias("published_date"), F.col("cveMetadata.state").alias("state"),
        F.regexp_replace("file", "^.*?" + root.rstrip("/") + "/", "").alias("source_file"),
    )
    return out.withColumns({"cvss_score": F.col("cvss_v3.score"), "severity": F.col("cvss_v3.severity")})


def counters(raw: DataFrame, records: DataFrame) -> DataFrame:
    """total, written, skipped (rejected), errors (files that are no records), no_desc, no_cvss, no_cwe: one row."""
    a = raw.agg(F.count("*").alias("total"), F.count_if(F.col("cveMetadata.cveId").isNull()).alias("errors"))
    b = records.agg(F.count("*").alias("written"), F.count_if(F.col("description").isNull()).alias("no_desc"), F.count_if(F.col("cvss_v3").isNull()).alias("no_cvss"), F.count_if(F.size("cwe_ids") == 0).alias("no_cwe"))
    return a.join(b).withColumn("skipped", F.col("total") - F.col("written") - F.col("errors"))  # one row by one row


def write_normalised(raw: DataFrame, path: str, root: str = "", include_rejected: bool = False) -> dict[str, int]:
    """Write the normalised records as JSON lines and return their `counters`, observed on the way: one job, no second pass."""
    seen, made = Observation(), Observation()
    n = F.count(F.lit(1))
    every = raw.observe(seen, n.alias("total"), F.count_if(F.col("cveMetadata.cveId").isNull()).alias("errors"))
    out = normalised(every, root, include_rejected)
    out = out.observe(made, n.alias("written"), F.count_if(F.col("description").isNull()).alias("no_desc"), F.count_if(F.col("cvss_v3").isNull()).alias("no_cvss"), F.count_if(F.size("cwe_ids") == 0).alias("no_cwe"))
    out.write.mode("overwrite").json(path)
    counts = seen.get | made.get
    return counts | {"skipped": counts["total"] - counts["written"] - counts["errors"]}


def best_rows(df: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """(by, order, score): the row of the highest score of each key; the first by `order` of equals; null scores don't count."""
    best = F.max_by(F.struct(order, score), F.struct(score, (-F.col(order)).alias("_back")))
    return df.filter(F.col(score).isNotNull()).groupBy(by).agg(best.alias("_b")).select(by, "_b.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace the JSON lines at `path`."""
    df.write.mode("overwrite").json(path)


def cached(new: DataFrame, path: str, key: str, parse) -> DataFrame:
    """Rows parsed once: those of the table at `path`, after `parse` has added the rows of `new` that it lacks."""
    from threatloom.operators.vector import append_vectors

    return append_vectors(new, path, key, parse)


def point_ids(records: DataFrame) -> DataFrame:
    """`records` with their deterministic vector id."""
    from threatloom.functions.text import URL_NAMESPACE

    return records.withColumn("id", uuid5(URL_NAMESPACE, F.col("cve_id")))


def jsonl(spark: SparkSession, path: str, schema: str, skip_malformed: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones kept as nulls or dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_malformed else "PERMISSIVE").json(path)


def triples(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(software nodes, affects edges) of extracted triples (cve_id, triples array<struct<software, evidence, attack_class>>).

    Software is one node per name ignoring case, spelled as it first stands; blank names are skipped.
    """
    each = raw.select("cve_id", F.posexplode("triples").alias("pos", "t")).select("cve_id", "pos", stripped(F.coalesce("t.software", F.lit(""))).alias("name"), "t.evidence", "t.attack_class").filter("name <> ''")
    key = F.lower("name")
    nodes = each.groupBy(key.alias("key")).agg(F.min_by("name", F.struct("cve_id", "pos")).alias("name")).withColumn("stix_id", F.concat(F.lit("software--"), uuid5(F.lit("6ba7b8119dad11d180b400c04fd430c8"), F.col("key"))))
    text = F.btrim(F.concat(F.coalesce("evidence", F.lit("")), F.lit(" ["), F.coalesce("attack_class", F.lit("")), F.lit("]")), F.lit(" []"))
    edges = each.withColumn("key", key).join(nodes.select("key", "stix_id"), "key").select(F.col("cve_id").alias("src"), F.col("stix_id").alias("dst"), text.alias("description"), F.lit(0.85).alias("confidence"))
    return nodes.drop("key"), edges.dropDuplicates(["src", "dst", "description"])


def documents_without_json(parsed: DataFrame, markdown: DataFrame, key: str = "stem") -> DataFrame:
    """The parsed form of a document where there is one, else its Markdown form."""
    return parsed.unionByName(markdown.join(parsed.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def legacy_chunks(raw: DataFrame, body: str = "json", key: str = "stem", least: int = 80) -> DataFrame:
    """(key, pos, text, page) of parsed chunk files in any of their older shapes; texts of `least` characters at least. A file is parsed
    once, as a variant, and the shapes are looked up in it; what is no JSON has no chunks."""
    parsed = raw.select(key, F.try_parse_json(body).alias("_v"))
    listed = lambda path: F.try_variant_get("_v", path, "array<variant>")
    each = parsed.select(key, F.posexplode(F.coalesce(listed("$.chunks"), listed("$.body"), listed("$.content"), listed("$"))).alias("pos", "x"))
    got = lambda path, kind: F.try_variant_get("x", path, kind)
    text = F.coalesce(*[blank_to_null(got(p, "string")) for p in ("$.text", "$.content", "$.body")], F.when(F.schema_of_variant("x") == "STRING", blank_to_null(got("$", "string"))))
    page = F.coalesce(*[got(p, "int") for p in ("$.meta.page_no", "$.meta.page", "$.metadata.page_no", "$.metadata.page", "$.page_no")])
    return each.select(key, "pos", text.alias("text"), page.alias("page")).filter(F.length("text") >= least)
