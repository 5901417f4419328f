"""Report text: paragraphs, sections, packing to a token budget, chunk statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threatloom.functions.text import is_noise, stripped, word_count
from threatloom.operators.evalkit import levels
from threatloom.operators.ranks import value_at

LEAST_CHARS, BUDGET = 80, 500
#: Positions of a document that are folded in one task; no level is beyond DEEPEST, no mark of a place beyond LAST.
PART, DEEPEST, LAST = 4096, (1 << 31) - 1, (1 << 31) - 1


def paragraphs(df: DataFrame, key: str, text: str, separator: str = "\n\n", least: int = LEAST_CHARS) -> DataFrame:
    """key, pos (counting dropped ones), paragraph, chunk_index (dense): paragraphs of `least` characters at least."""
    each = df.select(key, F.posexplode(F.split(text, separator)).alias("pos", "raw")).select(key, "pos", stripped(F.col("raw")).alias("paragraph"))
    kept = each.filter(F.length("paragraph") >= least)
    return kept.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)


def sections(items: DataFrame, key: str, pos: str, label: str, text: str, level: str | None = None, part: int = PART) -> DataFrame:
    """`items` with section_no (headings so far, empty ones too) and section_path.

    An empty heading starts a section but keeps the path; a heading of level n closes those of level n and deeper (levels below
    1 and null count as 1; there is no deepest). What a run of headings does to a path is the lowest level it closes and the
    headings that it leaves open, and two runs compose: a document is cut into parts by ranges of `part` positions, which are folded
    apart, then their effects in order, so a document is as many tasks as it has parts. Positions are integers; null ones come first.
    """
    each = items.withColumn("_part", F.coalesce(F.floor(F.col(pos) / part), F.lit(-1)).cast("long"))
    heading = F.coalesce(F.col(label) == "section_header", F.lit(False))
    name = F.nullif(stripped(F.coalesce(F.col(text), F.lit(""))), F.lit(""))
    depth = (F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)) if level else F.lit(1)).cast("int")
    head = F.struct(F.col(pos).cast("long").alias("at"), depth.alias("level"), name.alias("name"))
    runs = each.filter(heading).groupBy(key, "_part").agg(F.array_sort(F.collect_list(head)).alias("heads"))
    none = F.struct(F.lit(DEEPEST).alias("closes"), F.array().cast("array<struct<level:int,name:string>>").alias("open"))

    def then(state: Column, closes: Column, opens: Column) -> Column:
        kept = F.filter(state["open"], lambda x: x["level"] < closes)
        return F.struct(F.least(state["closes"], closes).alias("closes"), F.concat(kept, opens).alias("open"))

    def add(state: Column, x: Column) -> Column:
        return F.when(x["name"].isNull(), state).otherwise(then(state, x["level"], F.array(F.struct(x["level"].alias("level"), x["name"].alias("name")))))

    # what parts with headings leave, in order; each part begins with what the last such part before it left
    parts = runs.withColumn("_run", F.aggregate("heads", none, add))
    effects = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", F.size("heads").cast("long").alias("n"), F.col("_run").alias("run")))).alias("_parts"))
    begin = F.struct(none["open"].alias("open"), F.lit(0).cast("long").alias("n"))
    later = lambda s, x: F.struct(F.concat(F.filter(s["open"], lambda y: y["level"] < x["run"]["closes"]), x["run"]["open"]).alias("open"), (s["n"] + x["n"]).alias("n"))
    scanned = F.aggregate("_parts", F.array(begin), lambda states, x: F.concat(states, F.array(later(F.element_at(states, -1), x))))
    after = effects.select(key, F.explode(F.arrays_zip(F.transform("_parts", lambda x: x["_part"]).alias("_part"), F.slice(scanned, 2, F.size("_parts")).alias("_after"))).alias("_x"))
    own_parts = each.select(key, "_part").distinct().join(after.select(F.col(key).alias("_key"), "_x.*").withColumnRenamed("_part", "_p"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    so_far = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own_parts.select(key, "_part", F.coalesce(F.last("_after", ignorenulls=True).over(so_far), begin).alias("_s"))
    # inside a part: the run up to each heading, after what the part begins with
    walked = F.aggregate("heads", F.array(F.struct(F.lit(None).cast("long").alias("at"), none.alias("run"))), lambda states, x: F.concat(states, F.array(F.struct(x["at"].alias("at"), add(F.element_at(states, -1)["run"], x).alias("run")))))
    marks = starts.join(parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "heads"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    marks = marks.select(key, "_part", "_s", F.posexplode(F.when(F.col("heads").isNull(), F.array(F.struct(F.lit(None).cast("long").alias("at"), none.alias("run")))).otherwise(walked)).alias("_in", "_m"))
    path = F.concat(F.filter(F.col("_s.open"), lambda y: y["level"] < F.col("_m.run.closes")), F.col("_m.run.open"))
    marks = marks.select(key, "_part", F.col("_m.at").alias("_at"), "_in", F.transform(path, lambda y: y["name"]).alias("section_path"), (F.col("_s.n") + F.col("_in")).alias("section_no"))
    own = each.withColumn("_at", F.col(pos).cast("long")).withColumn("_in", F.lit(LAST).cast("int")).withColumn("_item", F.lit(True))
    w = Window.partitionBy(key, "_part").orderBy(F.asc_nulls_first("_at"), "_in").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(marks, allowMissingColumns=True)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("section_no", "section_path")}).filter("_item")
    return filled.select(*items.columns, "section_no", "section_path")


def packed(items: Column, tokens=lambda x: x["tokens"], budget: int = BUDGET) -> Column:
    """Greedy groups over an ordered array: an array of arrays of items.

    A group is closed when the next item would exceed the budget; an item over the budget stays whole. The fold keeps
    the starts of groups only; the groups are slices between them.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"))

    def add(state: Column, x: Column) -> Column:
        n = F.coalesce(tokens(x), F.lit(0)).cast("long")
        full = (state["used"] > 0) & (state["used"] + n > budget)
        starts = F.when(full | (state["at"] == 0), F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), F.when(full, n).otherwise(state["used"] + n).alias("used"), (state["at"] + 1).alias("at"))

    def cut(state: Column) -> Column:
        ends = F.concat(F.slice(state["starts"], 2, F.greatest(F.size(state["starts"]), F.lit(1))), F.array(state["at"]))
        return F.zip_with(state["starts"], F.slice(ends, 1, F.size(state["starts"])), lambda a, b: F.slice(items, a + 1, b - a))

    return F.aggregate(items, start, add, cut)


def pack_rows(items: DataFrame, by: list[str], pos: str, tokens: str, budget: int = BUDGET, part: int = PART) -> DataFrame:
    """`items` with `group`, the number of the greedy group (see `packed`) that an item of a sequence `by` falls in; null tokens are 0.

    Sequences are cut into parts by ranges of `part` positions. All that a part needs to know of those before it is how full the open group
    is, from 0 to budget, or over it; so its effect is a table of budget + 2 states: how full it leaves the
    group, and how many groups it begins. The tables of a sequence are composed in order, then each part numbers its items.
    """
    spot = items.withColumn("_part", F.coalesce(F.floor(F.col(pos) / part), F.lit(-1)).cast("long"))
    keys = [*by, "_part"]
    types = {f.name: f.dataType for f in spot.schema.fields}
    fields = [T.StructField(c, types[c]) for c in keys]

    def effect(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.minimum(rows.sort_values(pos, kind="stable")[tokens].fillna(0).to_numpy(np.int64), budget + 1)
        fill, new = group_states(n, budget)
        return pd.DataFrame({**{c: rows[c].iloc[:1] for c in keys}, "fill": [fill], "new": [new]})

    table = spot.select(*keys, pos, tokens).groupBy(*keys).applyInPandas(effect, T.StructType([*fields, T.StructField("fill", T.ArrayType(T.IntegerType())), T.StructField("new", T.ArrayType(T.LongType()))]))
    ordered = table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "fill", "new"))).alias("parts"))
    begin = F.struct(F.lit(0).alias("full"), F.lit(0).cast("long").alias("groups"))
    step = lambda s, x: F.struct(F.get(x["fill"], s["full"]).alias("full"), (s["groups"] + F.get(x["new"], s["full"])).alias("groups"))
    states = F.aggregate("parts", F.array(begin), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
    starts = ordered.select(*by, F.explode(F.arrays_zip(F.transform("parts", lambda x: x["_part"]).alias("_part"), F.slice(states, 1, F.size("parts")).alias("_s"))).alias("_x")).select(*by, "_x._part", "_x._s.full", "_x._s.groups")

    def number(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos, kind="stable")
        full, group, out = int(start["full"].iloc[0]) if len(start) else 0, int(start["groups"].iloc[0]) if len(start) else 0, []
        for x in np.minimum(rows[tokens].fillna(0).to_numpy(np.int64), budget + 1).tolist():
            if full > 0 and full + x > budget:
                full, group = 0, group + 1
            full = min(budget + 1, full + x)
            out.append(group)
        return rows.assign(group=np.array(out, np.int64))

    numbered = spot.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(number, T.StructType([*spot.schema.fields, T.StructField("group", T.LongType())]))
    return numbered.drop("_part")


def group_states(n: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fill from 0 to budget + 1 (over it) before the items: the fill after them, and how many groups they begin."""
    fill, new = np.arange(budget + 2, dtype=np.int32), np.zeros(budget + 2, np.int64)
    for x in n.tolist():
        closed = (fill > 0) & (fill + x > budget)
        new += closed
        fill = np.minimum(np.where(closed, 0, fill) + x, budget + 1).astype(np.int32)
    return fill, new


def pack_paragraphs(df: DataFrame, key: str, text: str, separator: str = "\n", budget: int = BUDGET, tokens=word_count) -> DataFrame:
    """key, group, paragraphs, tokens: paragraphs packed in order."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: tokens(x).cast("int")), lambda n: n > 0)
    each = df.select(key, parts.alias("parts")).select(key, F.posexplode(packed(F.col("parts"), lambda n: n, budget)).alias("group", "p"))
    return each.select(key, "group", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, n: a + n).alias("tokens"))


def chunks(items: DataFrame, key: str, budget: int = BUDGET, least: int = LEAST_CHARS, tokens=word_count) -> DataFrame:
    """Section-aware chunks of document items (key, pos, label, text, page): key, chunk_index, text, section_path, page, token_count.

    Text, list items and captions of a section are packed to the budget; short and noisy chunks go.
    """
    placed = sections(items, key, "pos", "label", "text", "level" if "level" in items.columns else None)
    body = placed.filter(F.col("label").isin("text", "list_item", "caption") & (stripped(F.coalesce("text", F.lit(""))) != ""))
    sized = body.select(key, "section_no", "pos", tokens(F.col("text")).cast("int").alias("tokens"), stripped(F.col("text")).alias("text"), "page", "section_path")
    by = [key, "section_no"]
    long = sized.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > PART).select(*by)
    some = not long.isEmpty()
    item = F.struct("pos", "tokens", "text", "page", "section_path")
    # short sections are folded as one array; long ones are packed part by part, and a group is gathered only then
    short = (sized.join(long, by, "left_anti") if some else sized).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    made = short.select(*by, F.posexplode(packed(F.col("items"), budget=budget)).alias("part", "g"))
    if some:
        grouped = pack_rows(sized.join(long, by, "left_semi"), by, "pos", "tokens", budget)
        made = made.unionByName(grouped.groupBy(*by, F.col("group").cast("int").alias("part")).agg(F.array_sort(F.collect_list(item)).alias("g")))
    pages = F.filter(F.transform("g", lambda x: x["page"]), lambda p: p.isNotNull())
    made = made.select(
        key, "section_no", "part", F.transform("g", lambda x: x["text"]).alias("texts"), F.get("g", F.lit(0))["section_path"].alias("section_path"), F.get(pages, F.lit(0)).alias("page"),
        F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("token_count"),
    )
    made = made.withColumn("text", F.array_join("texts", "\n\n")).filter((F.length("text") >= least) & ~is_noise(F.col("text")))
    index = F.row_number().over(Window.partitionBy(key).orderBy("section_no", "part")) - 1
    return made.withColumn("chunk_index", index).select(key, "chunk_index", "text", "section_path", "page", "token_count")


def chunk_stats(df: DataFrame, by: str, size: Column, page: Column | None = None, empty_path: Column | None = None) -> DataFrame:
    """Per key and overall (null key): n, least, median, p95, most, pct_empty, pages (distinct in a key; with `page` only), and a
    six-bucket histogram of sizes. All but pages come from the counts of each size."""
    rows = df.select(by, size.alias("size"), (empty_path if empty_path is not None else F.lit(False)).alias("empty"))
    counts = rows.groupBy(by, "size").agg(F.count("*").alias("_n"), F.count_if("empty").alias("_empty"))
    n = F.sum("_n")
    edges = (0, 50, 100, 200, 350, 500)
    bucket = lambda a, b: F.coalesce(F.sum(F.when((F.col("size") >= a) & (F.col("size") < b), F.col("_n"))), F.lit(0))
    out = levels(
        counts, by, [], n.alias("n"), F.min("size").alias("least"), F.floor(F.expr("percentile(size, 0.5, _n)")).cast("int").alias("median"), F.max("size").alias("most"),
        F.round(100.0 * F.sum("_empty") / n, 1).alias("pct_empty"), *[bucket(a, b).alias(f"from_{a}") for a, b in zip(edges, (*edges[1:], 1 << 30))],
    )
    both = levels(counts.filter("size is not null"), by, [F.col("size")], F.sum("_n").alias("_n"))
    parts = [value_at(both, [by, "overall"], "size", "_n", 0.95, "p95")]
    if page is not None:
        pages = df.select(by, page.alias("_page")).filter("_page is not null").distinct()
        parts.append(levels(pages, by, [], F.count("*").alias("pages")))
    for part in parts:
        part = part.withColumnsRenamed({by: "_by", "overall": "_overall"})
        out = out.join(part, F.col(by).eqNullSafe(F.col("_by")) & (F.col("overall") == F.col("_overall")), "left").drop("_by", "_overall")
    first = [by, "n", "least", "median", "p95", "most", "pct_empty", *(["pages"] if page is not None else [])]
    return out.select(*first, *[f"from_{a}" for a in edges])


def report_nodes(chunks: DataFrame, mentions: DataFrame, source: str = "source") -> DataFrame:
    """A node per report: source, chunk_count, year of its first chunk, n_entities (distinct attack_id among its mentions)."""
    own = chunks.groupBy(source).agg(F.count("*").alias("chunk_count"), F.min_by("year", "chunk_index").alias("year"))
    n = mentions.select(source, "attack_id").distinct().groupBy(source).agg(F.count("attack_id").alias("n_entities"))
    return own.join(n, source, "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def write_by_document(chunks: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Write chunks in a folder a document, and return the run's summary: key, chunks, tokens, status (`empty` if all are blank)."""
    chunks.write.mode("overwrite").partitionBy(key).json(path)
    some = F.count_if(stripped(F.coalesce("text", F.lit(""))) != "")
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.when(some > 0, "ok").otherwise("empty").alias("status"))


def markdown_paragraphs(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Fallback for documents without a parsed form: paragraphs of plain Markdown."""
    return paragraphs(pages, key, text, "\n\n")
