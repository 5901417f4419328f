"""Hybrid retrieval: vector search with graph enrichment, pivots, expansion, merging, prompt context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threatloom.functions.text import confidence, hybrid_score, record_line
from threatloom.operators.graph import counted, neighbours, top_names
from threatloom.operators.numbersets import members, pieces, whole
from threatloom.operators.vector import filtered_nearest, nearest, nearest_batch

#: Texts in, vectors out: models work by batches.
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(size: int = 64) -> Embedder:
    """Deterministic stand-in for an embedding model: hashed word counts, unit length."""

    def one(text: str) -> list[float]:
        v = [0.0] * size
        for w in (text or "").lower().split():
            h = hashlib.sha1(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % size] += 1.0 if h[4] & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    return lambda texts: [one(t) for t in texts]


def embedded(df: DataFrame, text: str, embed: Embedder, into: str = "vector") -> DataFrame:
    """`df` with a vector per text; `embed` gets the texts of an Arrow batch in one call."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(column):
        import pandas as pd

        return pd.Series([[float(x) for x in v] for v in embed([t or "" for t in column])], dtype=object)

    return df.withColumn(into, run(F.col(text)))


def validated(top_k: int = 10, min_cvss: float | None = None, severity: str | None = None, alpha: float = 0.7) -> None:
    """Reject arguments outside their ranges before any job starts."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    if min_cvss is not None and not 0 <= min_cvss <= 10:
        raise ValueError("min_cvss must be from 0 to 10")
    if severity is not None and severity.upper() not in ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"):
        raise ValueError("unknown severity")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")


def similar(vectors: DataFrame, links: DataFrame, query: list[float], top_k: int = 10, early: Column | None = None, late: Column | None = None, alpha: float = 0.7, key: str = "cve_id", vector: str = "vector") -> DataFrame:
    """Nearest records with the array of what they link to, ranked by hybrid score.

    `early` filters reach the scan; `late` filters apply inside the first 2k hits. links: (key, attack_id, name).
    """
    hits = filtered_nearest(vectors.filter(early) if early is not None else vectors, query, top_k, key, vector, late)
    mine = links.join(hits.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("attack_id", "name"))).alias("techniques"))
    rich = hits.join(mine, key, "left").withColumn("techniques", F.coalesce("techniques", F.array().cast(mine.schema["techniques"].dataType)))
    final = F.round(hybrid_score(F.col("score"), F.size("techniques") > 0, alpha), 7)  # a digit more than the score: no ties to round
    return rich.withColumn("final_score", final).orderBy(F.desc("final_score"), key).limit(top_k)


def pivots(techniques: DataFrame, tactics: DataFrame, actors: DataFrame, records: DataFrame, n: int = 20) -> DataFrame:
    """attack_id, name, tactics, the first n groups and the first n programs by name, and record_count of every technique (attack_id, name).

    Names are cut to n in each partition before they are gathered, so no technique's actors stand in one row.
    """
    first = lambda kind: neighbours(top_names(actors.filter(F.col("kind") == kind).select("attack_id", "actor"), "attack_id", "actor", n), "attack_id", "actor", f"_{kind}")
    out = techniques.select("attack_id", "name").join(neighbours(tactics.select("attack_id", "tactic"), "attack_id", "tactic", "tactics"), "attack_id", "left")
    out = out.join(first("group"), "attack_id", "left").join(first("software"), "attack_id", "left").join(counted(records, "attack_id", "cve_id", "record_count"), "attack_id", "left")
    array = lambda c, into: F.coalesce(c, F.array().cast("array<string>")).alias(into)
    return out.select("attack_id", "name", array("tactics", "tactics"), array("_group", "groups"), array("_software", "software"), F.coalesce("record_count", F.lit(0)).alias("record_count"))


def pivot(technique: str, techniques: DataFrame, tactics: DataFrame, actors: DataFrame, records: DataFrame, vectors: DataFrame | None = None, embed: Embedder | None = None, k: int = 10) -> DataFrame:
    """pivots of one technique (no row if unknown), with `vectors` also similar records. The filter reaches every scan."""
    only = [df.filter(F.col("attack_id") == technique) for df in (techniques, tactics, actors, records)]
    out = pivots(*only)
    if vectors is None:
        return out
    name = only[0].first()
    near = nearest(vectors, (embed or hashing_embedder())([f"{technique} {name.name if name else ''}"])[0], k, "cve_id", "vector")
    return out.crossJoin(near.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cve_id"))), lambda s: s["cve_id"]).alias("similar")))  # one row by one row


def _graph_parts(pattern_of: DataFrame, tactics: DataFrame, actors: DataFrame) -> DataFrame:
    """cve_id, techniques, pieces of groups and of software, and how many pieces were seen, of all records that have a technique; actors are integers.

    Each technique's tactics and its actors, as sets of a few bytes each, stand side by side in numbered rows, so neither multiplies the other.
    """
    kind = F.when(F.col("kind") == "group", 0).when(F.col("kind") == "software", 1).cast("byte")
    sets = pieces(actors.select("attack_id", kind.alias("kind"), F.when(kind.isNotNull(), F.col("actor")).alias("actor")), ["attack_id", "kind"], "actor", "ends")
    tactic, piece = F.struct("tactic"), F.struct("kind", "ends")
    sides = tactics.select("attack_id", tactic.alias("_t")).unionByName(sets.select("attack_id", piece.alias("_a")), allowMissingColumns=True)
    about = sides.groupBy("attack_id").agg(F.arrays_zip(F.collect_set("_t").alias("t"), F.collect_list("_a").alias("a")).alias("_x"))
    met = pattern_of.join(about.select("attack_id", F.posexplode_outer("_x").alias("_n", "_x")), "attack_id", "left")
    own = (F.coalesce("_n", F.lit(0)) == 0) | F.col("_x.t").isNotNull()
    rows = met.select("cve_id", "attack_id", "cwe_id", F.col("_x.t.tactic").alias("tactic"), own.alias("_own"), F.col("_x.a.kind").alias("_kind"), F.col("_x.a.ends").alias("_ends")).repartition("cve_id")
    of = lambda kind: F.collect_list(F.when(F.col("_kind") == kind, F.col("_ends")))
    told = F.array_sort(F.collect_set(F.when(F.col("_own"), F.struct("attack_id", "cwe_id", "tactic"))))
    return rows.groupBy("cve_id").agg(told.alias("techniques"), of(0).alias("groups"), of(1).alias("software"), F.count("_ends").alias("_seen"))


def expand(ids: DataFrame | None, records: DataFrame, pattern_of: DataFrame, tactics: DataFrame, actors: DataFrame, vectors: DataFrame | None = None, embed: Embedder | None = None, k: int = 10) -> DataFrame:
    """Per record id of `ids` (None: of all records): its columns, techniques (technique, cwe, tactic), actors two hops away and, with `vectors`
    (cve_id, vector), similar: the k nearest other records (cve_id, score) of its description (its id, without one).

    Each side is aggregated before it joins, so groups never multiply software. Unknown ids give no row. Actors that are integers travel as
    compact sets, others one by one: over all records, give ids and look names up after.
    """
    asked, mine = records, pattern_of
    if ids is not None:
        ids = ids.select("cve_id").distinct()
        asked, mine = (df.join(ids, "cve_id", "left_semi") for df in (records, pattern_of))
    if whole(actors.schema["actor"].dataType):
        met = asked.join(_graph_parts(mine, tactics, actors), "cve_id", "left")  # before Python, which hides how rows are dealt
        numbers = lambda c: F.when(F.col("_seen") > 0, members(F.col(c)).cast(T.ArrayType(actors.schema["actor"].dataType)))
        out = met.withColumns({"groups": numbers("groups"), "software": numbers("software")}).drop("_seen")
    else:
        nested = mine.join(tactics, "attack_id", "left").groupBy("cve_id").agg(F.array_sort(F.collect_set(F.struct("attack_id", "cwe_id", "tactic"))).alias("techniques"))
        far = mine.select("cve_id", "attack_id").distinct().join(actors, "attack_id").groupBy("cve_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("kind") == "group", F.col("actor")))).alias("groups"), F.array_sort(F.collect_set(F.when(F.col("kind") == "software", F.col("actor")))).alias("software")
        )
        out = asked.join(nested, "cve_id", "left").join(far, "cve_id", "left")
    if vectors is None:
        return out
    said = asked.select("cve_id", F.coalesce(F.nullif("description", F.lit("")), F.col("cve_id").cast("string")).alias("_said"))
    near = nearest_batch(vectors, embedded(said, "_said", embed or hashing_embedder()), k, "cve_id", "vector")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").alias("cve_id"), "score")))
    near = near.groupBy(F.col("query").alias("cve_id")).agg(F.transform(ordered, lambda x: F.struct(x["cve_id"].alias("cve_id"), x["score"].alias("score"))).alias("similar"))
    return out.join(near, "cve_id", "left")


def merged(streams: list[DataFrame], top_k: int, score: str = "score") -> DataFrame:
    """Union of ranked streams by rounded score; ties keep the order of streams, then the rank within one."""
    from functools import reduce

    parts = [s.withColumn("_stream", F.lit(i)) for i, s in enumerate(streams)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.withColumn(score, F.round(score, 4)).orderBy(F.desc(score), "_stream", "rank").limit(top_k).drop("_stream")


def hybrid(vectors: DataFrame, links: DataFrame, chunks: DataFrame, query: list[float], source: str = "all", top_k: int = 10, report: str | None = None, **options) -> DataFrame:
    """Records (source `cve`), report chunks (`pdf`), or both merged (`all`); another source gives no rows. Chunk scores are plain cosines.

    Only chunks of source_type `pdf` (where there is one) and, if named, of one `report` take part: both filters reach the scan.
    """
    validated(top_k, options.get("min_cvss"), options.get("severity"), options.get("alpha", 0.7))
    early = F.lit(True)
    if options.get("min_cvss") is not None:
        early &= F.col("cvss_score") >= options["min_cvss"]
    if options.get("severity"):
        early &= F.col("severity") == options["severity"].upper()
    late = F.coalesce(F.col("published"), F.lit("0")) >= options["after_date"] if options.get("after_date") else None
    found = similar(vectors, links, query, top_k, early, late, options.get("alpha", 0.7))
    records = ranked(found.withColumn("score", F.col("final_score")).drop("vector", "final_score").withColumn("result_type", F.lit("cve")), "score", "cve_id")
    if "source_type" in chunks.columns:
        chunks = chunks.filter("source_type = 'pdf'")
    if report is not None:
        chunks = chunks.filter(F.col("source") == report)
    texts = ranked(nearest(chunks, query, top_k, "id", "vector").drop("vector").withColumn("result_type", F.lit("pdf")), "score", "id")
    if source == "cve":
        return records
    if source == "pdf":
        return texts
    both = merged([records, texts], top_k)
    return both if source == "all" else both.limit(0)


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """`df`, at most top-k rows, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def context_lines(df: DataFrame, by: list[str], order: list, line: Column, n: int = 5) -> DataFrame:
    """Per `by`: the first n rows' lines in order, as one string."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n)
    lines = F.array_sort(F.collect_list(F.struct("_n", line.alias("_t"))))
    return numbered.groupBy(*by).agg(F.array_join(F.transform(lines, lambda s: s["_t"]), "\n").alias("context"))


def technique_union(results: DataFrame, by: str, rank: str = "rank", n: int = 8, first: int = 5) -> DataFrame:
    """(by, techniques): of the `first` results of each query, the distinct techniques (attack_id, name) in order of their first place,
    each with its last name; the first n of them."""
    each = results.filter(F.col(rank) <= first).select(by, rank, F.posexplode("techniques").alias("_pos", "t")).filter("t.attack_id is not null")
    place = F.struct(rank, "_pos")
    one = each.groupBy(by, "t.attack_id").agg(F.min(place).alias("at"), F.max_by("t.name", place).alias("name"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("at", "attack_id", "name"))), 1, n)
    return one.groupBy(by).agg(F.transform(listed, lambda x: F.struct(x["attack_id"].alias("attack_id"), x["name"].alias("name"))).alias("techniques"))


def graph_context(techniques: Column, groups: Column, software: Column, n: int = 10) -> Column:
    """The graph's lines of a prompt for one record: techniques (attack_id, name), the first n groups and the first n programs."""
    named = F.transform(F.filter(techniques, lambda t: t["attack_id"].isNotNull()), lambda t: F.concat(t["attack_id"], F.lit(" ("), F.coalesce(t["name"], F.lit("")), F.lit(")")))
    line = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, ", ")))
    return F.coalesce(F.nullif(F.concat_ws("\n", line("Techniques: ", named), line("Threat groups: ", F.slice(groups, 1, n)), line("Malware and tools: ", F.slice(software, 1, n))), F.lit("")), F.lit(NO_GRAPH))


NO_RECORDS, NO_GRAPH = "No matching records.", "No graph context."
PROMPT = "Question: {query}\n\nMatching records ({n}):\n{records}\n\nKnowledge graph:\n{graph}\n\nWrite a short narrative from this evidence only. Last line: CONFIDENCE: HIGH, MEDIUM or LOW, and why."


def prompts(queries: DataFrame, results: DataFrame, details: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """(by, query, n, records, graph, prompt) of every query (by, query).

    results: by, rank, cve_id, severity, cvss_score, description, techniques (attack_id, name). The first five make the
    records' lines. The graph's lines come from `details` (by, techniques, groups, software) where a query has them, else
    from the techniques over its results.
    """
    line = record_line({c: F.col(c) for c in ("cve_id", "severity", "cvss_score", "description")} | {"techniques": F.filter(F.transform("techniques", lambda t: t["attack_id"]), lambda x: x.isNotNull())})
    lines = context_lines(results, [by], ["rank"], line).withColumnRenamed("context", "records")
    across = technique_union(results, by)
    some = F.array_join(F.transform("techniques", lambda t: F.concat(t["attack_id"], F.lit(" ("), F.coalesce(t["name"], F.lit("")), F.lit(")"))), ", ")
    across = across.select(by, F.concat(F.lit("Techniques across results: "), some).alias("_across"))
    out = queries.select(by, "query").join(results.groupBy(by).agg(F.count("*").alias("n")), by, "left").join(lines, by, "left").join(across, by, "left")
    own = F.lit(None).cast("string")
    if details is not None:
        out = out.join(details.select(by, graph_context(F.col("techniques"), F.col("groups"), F.col("software")).alias("_own")), by, "left")
        own = F.col("_own")
    out = out.select(by, "query", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("records", F.lit(NO_RECORDS)).alias("records"), F.coalesce(own, "_across", F.lit(NO_GRAPH)).alias("graph"))
    parts = [x for piece in PROMPT.split("{") for x in piece.split("}")]  # text, name, text, name, ..., text
    text = F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(F.col(x).cast("string"), F.lit("")) for i, x in enumerate(parts)])
    return out.withColumn("prompt", text)


def model_entities(chunks: DataFrame, model: Callable[[list[str]], list[list[dict]]], text: str = "text", threshold: float = 0.35, least: int = 30, cut: int = 300) -> DataFrame:
    """`chunks` with entities (text, label, confidence) that a batch model finds with `threshold` at least in the first `cut` characters
    (the model's own input limit) of texts longer than `least`; others have none."""
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]))

    @F.pandas_udf(kind)
    def run(column):
        import pandas as pd

        asked = [t for t in column if t is not None]
        found = iter(model(asked) if asked else [])
        keep = lambda es: [{"text": e["text"], "label": e["label"], "confidence": round(float(e["score"]), 4)} for e in es if e["score"] >= threshold]
        return pd.Series([[] if t is None else keep(next(found)) for t in column], dtype=object)

    body = F.trim(F.coalesce(text, F.lit("")))
    return chunks.withColumn("entities", run(F.when(F.length(body) > least, F.substring(body, 1, cut))))


def narrative(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """`prompts` with narrative and confidence; `model` gets the prompts of an Arrow batch in one call and returns a text for each."""

    @F.pandas_udf(T.StringType())
    def run(column):
        import pandas as pd

        return pd.Series(model([p or "" for p in column]), dtype=object)

    raw = prompts.withColumn("_raw", run(F.col(prompt)))
    body = F.regexp_replace(F.regexp_replace("_raw", r"(?is)\n?[ \t]*CONFIDENCE:[^\n]*\s*$", ""), r"\s+$", "")
    return raw.withColumns({"confidence": confidence(F.col("_raw")), "narrative": body}).drop("_raw")
