"""Removal of repeated line runs by a suffix array over line ids. DataFrame functions only.

The corpus is one sequence of line ids (128-bit, blank lines left out), ordered by doc_id, text hash
and line. Lines that occur once end every repeat, so only islands of repeated lines go on; each of
their lines has a place in the corpus, and begins a suffix that runs to the end of its island.

Prefix doubling: a suffix's rank is the number of suffixes that are smaller by their first 2**k lines. A round
sorts the distinct pairs (own rank, rank 2**k lines on) of suffixes that still share a rank, range-partitioned, and adds to the
rank the suffixes of smaller pairs. A suffix is done once no other shares its pair, or once its island ends there (suffixes that are
equal to the end stand in order of place). When all are done, (rank, place) is the order of the suffix array.

Longest common prefixes: with the suffix before it in the array, a suffix shares one line less than the suffix one place
earlier does with its own, wherever both pairs stand side by side; elsewhere (at the so-called irreducible places) lines are counted by
descending doubling: from the last round to the first, equal ranks at the lines reached mean 2**k more lines. Where
neighbours share `min_lines`, they are in one interval. The first occurrence of an interval stays; all others that don't overlap
it are later copies. What they cover together are the maximal repeated runs of min_lines at least, and is cut.

A pair with more than 1/SHARE of the rows is hot: of those there are at most SHARE, which are broadcast, and their rows are dealt
to SALTS tasks each. Running totals are taken in each range partition, and one row a partition goes through the driver.

Defined results: null text stays null; texts without repeats stay byte for byte; blank lines go
only between two lines that go; rows that repeat a document (same doc_id and text) are treated alike, as
one document; of texts under one doc_id the order is that of their hashes; columns pass through,
`text` is replaced and so are columns n_removed and longest_run; removing every line leaves the empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, stored

#: Runs of fewer lines stay. With 1 no later copy of any line is left.
MIN_LINES, BLANKS = 1, " \t\r\f\v\u00a0"
SHARE, SALTS = 1000, 64


def line_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th (hash of the text), seq (place among non-blank lines), line (place among all), id."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("x")))
    kept = F.filter(lines, lambda s: s["x"] != "")
    docs = df.select(F.col(key).alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("th"), kept.alias("kept"))  # below the explode: a text is hashed once, not once a line
    rows = docs.select("doc", "th", F.posexplode_outer("kept").alias("seq", "s")).filter("seq is not null")
    return rows.select("doc", "th", "seq", F.col("s.line").alias("line"), F.unhex(F.md5(F.col("s.x").cast("binary"))).alias("id"))


def met(rows: DataFrame, groups: DataFrame, by: list[str], total: int, most: int) -> DataFrame:
    """`rows` with the other columns of `groups`, which has a row for each `by`, and n, how many rows have it (`most`, the largest n)."""
    hot = F.col("n") > max(2.0, total / SHARE)
    if most <= max(2.0, total / SHARE):
        return rows.join(groups.hint("merge"), by)
    salts = F.broadcast(groups.filter(hot).select(*by, F.lit(SALTS).alias("salts")))  # SHARE rows at most
    each = groups.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    spread = F.xxhash64(*[c for c in rows.columns if c not in by])
    dealt = rows.join(salts, by, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(spread, F.lit(SALTS))).cast("int")).drop("salts")
    return dealt.join(each.hint("merge"), [*by, "salt"]).drop("salt")


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` sorted over ranges of `by`, stored, with part (range) and at (place, ascending over all)."""
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return stored(rows, name).withColumn("part", F.shiftright("at", 33))


def carried(rows: DataFrame, last: Column, over, start: int) -> Column:
    """For each part, what `over` (a Python function of two values) makes of `last` over all parts before it: one value a part, as a
    constant array."""
    return before_parts(dict(rows.groupBy("part").agg(last).collect()), over, start)


def before_parts(found: dict[int, int], over, start: int) -> Column:
    now, out = start, []
    for part in range(max(found, default=0) + 1):
        out.append(now)
        if part in found:
            now = over(now, found[part])
    return F.element_at(F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>"), (F.col("part") + 1).cast("int"))


def in_part():
    return Window.partitionBy("part").orderBy("at")


def totalled(groups: DataFrame, by: list[str], goes_on: Column) -> tuple[DataFrame, int, bool]:
    """`groups` with `before`: the sum of n over those that are smaller in `by`; the largest n; and whether `goes_on` holds anywhere."""
    rows = in_order(groups, by, "line-groups")
    found = rows.groupBy("part").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max(goes_on).alias("on")).collect()
    carry = before_parts({r.part: r.n for r in found}, lambda a, b: a + b, 0)
    inner = F.coalesce(F.sum("n").over(in_part().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inner", inner).select(*groups.columns, (carry + F.col("inner")).alias("before"))
    return rows, max((r.most for r in found), default=0), any(r.on for r in found)


def islands(lines: DataFrame) -> DataFrame:
    """The repeated lines: pos (place in the corpus, consecutive inside an island), isl and end (pos of the island's first and
    last line), rank (lines that are smaller), next (the rank of the next line in the island, else -1), doc, th, line."""
    total = lines.count()
    groups, most, _ = totalled(lines.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), ["id"], F.lit(True))
    rows = met(lines, groups, ["id"], total, most).select("doc", "th", "seq", "line", F.col("before").alias("rank"))
    rows = rows.repartitionByRange("doc", "th")  # documents in order; the windows need no other shuffle
    doc = Window.partitionBy("doc", "th").orderBy("seq")
    rows = rows.withColumn("before", F.lag("seq").over(doc)).filter(F.col("before").isNull() | (F.col("before") < F.col("seq")))
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    head = F.col("before").isNull() | (F.col("before") < F.col("seq") - 1)
    rows = rows.withColumn("isl", F.max(F.when(head, F.col("pos"))).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("doc", "th", "isl").orderBy("pos")
    rows = rows.withColumn("end", F.max("pos").over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("next", F.coalesce(F.lead("rank").over(island), F.lit(-1))).select("pos", "isl", "end", "rank", "next", "doc", "th", "line")


def doubled(suffixes: DataFrame, k: int, total: int) -> tuple[DataFrame, bool]:
    """Round k: the suffixes of islands that go on, with rank by 2**(k + 1) lines, open (whether others share it and go on), next (the rank 2**(k + 1) lines
    on, else -1) and goes_on (whether the island has an open suffix); and whether any goes on."""
    live = suffixes.filter("goes_on")
    shared = live.filter("open").select("pos", "isl", "rank", "next")
    still = (F.col("n") > 1) & (F.col("next") >= 0)
    pairs, most, more = totalled(shared.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank", "next"], still)
    first = pairs.groupBy("rank").agg(F.min("before").alias("first"))
    pairs = pairs.join(first, "rank").withColumn("new", F.col("rank") + F.col("before") - F.col("first")).select("rank", "next", "n", "new")
    split = met(shared, pairs, ["rank", "next"], total, most).select("pos", "isl", F.col("new").alias("rank"), still.alias("open"))
    rows = live.filter("not open").select("pos", "isl", "rank", "open").unionByName(split)
    island = Window.partitionBy("isl").orderBy("pos")
    rows = rows.withColumn("next", F.coalesce(F.max("rank").over(island.rangeBetween(2 << k, 2 << k)), F.lit(-1)))
    rows = rows.withColumn("goes_on", F.max("open").over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return stored(rows, "line-ranks"), more


def common_prefixes(base: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The suffix array: part and at (its order), pos, isl, and lcp, the lines shared with the suffix before (0 at the start), which begins in
    the island `beside`. A round holds the islands that went on; the last ranks of the others stand in the round before.

    Where one place is in no later round, nothing is missed: what it shares then is below 2**k lines, or runs to the end of its island, as round k says.
    """
    last = reduce(DataFrame.unionByName, [r.filter("not goes_on").select("pos", "rank") for r in rounds])
    here = last.join(base.select("pos", "isl", "end", F.col("rank").alias("line")).hint("merge"), "pos")
    array = in_order(here, ["rank", "pos"], "line-suffixes")
    other = F.struct("pos", "isl", "line", "end")
    edge = {r.part: r.x for r in array.groupBy("part").agg(F.max_by(other, "at").alias("x")).collect()}  # one row a part
    parts = sorted(edge)
    ends = array.sparkSession.createDataFrame([(p, tuple(edge[q])) for q, p in zip(parts, parts[1:])], "part long, edge struct<pos:bigint,isl:bigint,line:bigint,end:bigint>")
    rows = array.join(F.broadcast(ends), "part", "left").withColumn("o", F.coalesce(F.lag(other).over(in_part()), "edge")).drop("edge")
    by_place = Window.partitionBy("isl").orderBy("pos")
    before = F.lag(F.struct("pos", "line", "o")).over(by_place)
    follows = (F.col("o.pos") == before["o"]["pos"] + 1) & (F.col("o.isl") == before["o"]["isl"]) & (before["line"] == before["o"]["line"])
    rows = stored(rows.withColumn("direct", ~F.coalesce(follows, F.lit(False))), "line-neighbours")
    # irreducible places: lines are counted round by round, the longest first
    counted = rows.filter("direct and o is not null").select("pos", F.col("pos").alias("a"), F.col("o.pos").alias("b"), (F.col("end") + 1).alias("stop"), (F.col("o.end") + 1).alias("halt"))
    for k in range(len(rounds) - 1, -1, -1):
        ends = counted.filter("a < stop and b < halt").select("pos", F.explode(F.array("a", "b")).alias("at"))
        ranks = ends.join(rounds[k].select(F.col("pos").alias("at"), "rank").hint("merge"), "at")
        equal = ranks.groupBy("pos").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).filter("n = 2 and low = high")
        counted = counted.join(equal.select("pos", F.lit(True).alias("same")).hint("merge"), "pos", "left")
        step = F.when(F.col("same"), F.least(F.lit(1 << k), F.col("stop") - F.col("a"))).otherwise(0)
        counted = stored(counted.select("pos", "stop", "halt", (F.col("a") + step).alias("a"), (F.col("b") + step).alias("b")), "line-counts")
    known = rows.join(counted.select("pos", (F.col("a") - F.col("pos")).alias("n")).hint("merge"), "pos", "left")
    known = known.withColumn("n", F.when(F.col("direct"), F.coalesce("n", F.lit(0))))
    lcp = F.last(F.col("n") + F.col("pos"), ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("pos")
    return known.select("part", "at", "pos", "isl", F.col("o.isl").alias("beside"), F.greatest(lcp, F.lit(0)).alias("lcp"))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """A row for each text with repeated lines: doc, th, longest_run (lines of its longest run that stands twice), runs (to delete: sorted array of line, last_line)."""
    base = stored(islands(lines), "line-islands")
    total, rounds = base.count(), [base.select("pos", "isl", "rank", "next", F.lit(True).alias("open"), F.lit(True).alias("goes_on"))]
    more = total > 0
    while more:
        ranks, more = doubled(rounds[-1], len(rounds) - 1, total)
        rounds.append(ranks)
    array = stored(common_prefixes(base, rounds), "line-prefixes") if total else base.select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("at"), "pos", "isl", F.col("isl").alias("beside"), F.lit(0).cast("long").alias("lcp"))
    # an interval begins where neighbours share less
    begins = F.when(F.col("lcp") < min_lines, F.col("at"))
    carry = carried(array, F.max(begins), lambda a, b: a if b is None else b, 0)
    named = array.withColumn("in", F.max(begins).over(in_part().rowsBetween(Window.unboundedPreceding, 0)))
    named = stored(named.select("pos", "isl", "beside", "lcp", F.coalesce(F.col("in"), carry).alias("interval")), "line-intervals")
    first = stored(named.groupBy("interval").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1"), "line-firsts")
    most = first.agg(F.max("n")).first()[0] or 0
    copies = met(named.select("pos", "isl", "interval"), first, ["interval"], total, most).filter(F.col("pos") >= F.col("first") + min_lines)
    covering = copies.select("isl", "pos", (F.col("pos") + min_lines).alias("reach"))
    both = base.select("isl", "pos", "doc", "th", "line").unionByName(covering, allowMissingColumns=True)
    w = Window.partitionBy("isl").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    covered = both.withColumn("reach", F.max("reach").over(w)).filter("line is not null and reach > pos")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("isl").orderBy("pos"))
    runs = covered.withColumn("run", run).groupBy("doc", "th", "isl", "run").agg(F.min("line").alias("line"), F.max("line").alias("last_line"))
    both = named.select("isl", "lcp").union(named.select("beside", "lcp"))  # what neighbours share stands in both
    longest = both.groupBy("isl").agg(F.max("lcp").alias("longest"))
    texts = base.select("doc", "th", "isl").distinct().join(longest, "isl").select("doc", "th", "longest")
    each = runs.select("doc", "th", F.struct("line", "last_line").alias("r")).unionByName(texts, allowMissingColumns=True)
    return each.groupBy("doc", "th").agg(F.max("longest").alias("longest_run"), F.array_sort(F.collect_list("r")).alias("runs"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """`df` with later copies of repeated line runs cut from `text`, n_removed (lines), and longest_run: the lines of the longest run in the
    text that stands elsewhere too (0 if none).

    The last join sorts both sides at any size: the runs grow with the corpus and are never broadcast.
    """
    runs = stored(later_copies(stored(line_ids(df, key, text), "line-ids"), min_lines), "line-runs")
    th, cuts, doc, lines, n, longest = (fresh(df, x) for x in ("th", "runs", "doc", "lines", "removed", "longest"))
    runs = runs.select(F.col("doc").alias(doc), F.col("th").alias(f"{th}_"), F.col("runs").alias(cuts), F.col("longest_run").alias(longest))
    docs = df.withColumn(th, F.unhex(F.md5(F.col(text).cast("binary"))))
    cut = docs.join(runs.hint("merge"), F.col(key).eqNullSafe(F.col(doc)) & (F.col(th) == F.col(f"{th}_")), "left")
    some = F.size(cuts) > 0
    cut = cut.withColumn(lines, F.when(some, F.split(F.col(text), "\n")))
    # what stays stands between two runs: from behind one to before the next
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["last_line"] + 1)), F.concat(F.transform(cuts, lambda r: r["line"]), F.array(F.size(lines))),
        lambda a, b: F.slice(lines, a + 1, b - a),
    )
    new = F.when(some, F.array_join(F.flatten(gaps), "\n")).otherwise(F.col(text))
    removed = F.coalesce(F.aggregate(cuts, F.lit(0).cast("long"), lambda a, r: a + r["last_line"] - r["line"] + 1), F.lit(0).cast("long"))
    cut = cut.withColumn(n, removed).withColumn(longest, F.coalesce(F.col(longest), F.lit(0)).cast("long"))
    return cut.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c not in ("n_removed", "longest_run")], F.col(n).alias("n_removed"), F.col(longest).alias("longest_run"))
