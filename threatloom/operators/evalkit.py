"""Retrieval evaluation: runner, recall, hits and latency summaries, outputs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.ranks import value_at

ANSWERS = "id long, blob string, n_results int, pdf_hit boolean, latency double, error string"


def blob(*columns: str) -> Column:
    """The lower-cased JSON text of a response's columns (all of a row by default)."""
    return F.lower(F.to_json(F.struct(*(columns or ("*",)))))


def recall(expected: Column, text: Column) -> Column:
    """Share of the expected strings that the text holds; 1.0 if nothing is expected."""
    found = F.size(F.filter(expected, lambda x: F.contains(text, x)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def hit(expected: Column, text: Column) -> Column:
    return (F.size(expected) == 0) | F.exists(expected, lambda x: F.contains(text, x))


def answered(queries: DataFrame, answer: Callable[[str, str], object]) -> DataFrame:
    """Ask every query (id, query, hit_endpoint) once: id, blob, n_results, pdf_hit, latency (s), error.

    `answer(endpoint, query)` is any callable that returns a response that JSON can hold; what it raises is the
    row's error. Ids are upper-cased for the endpoints that take one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, query, endpoint in zip(batch["id"], batch["query"], batch["hit_endpoint"]):
                began = time.perf_counter()
                try:
                    out = answer(endpoint, query.upper() if endpoint in ("cve", "technique") else query)
                    some = out if isinstance(out, list) else (out.get("top_cves") or [] if isinstance(out, dict) else [])
                    found = any(isinstance(x, dict) and x.get("result_type", "").startswith("pdf") for x in some)
                    row = (number, json.dumps(out, default=str).lower(), len(some), found, None)
                except Exception as e:  # noqa: BLE001  an endpoint may fail in any way; the row says how
                    row = (number, None, 0, False, str(e) or type(e).__name__)
                rows.append((*row[:4], round(time.perf_counter() - began, 3), row[4]))
            yield pd.DataFrame(rows, columns=["id", "blob", "n_results", "pdf_hit", "latency", "error"])

    return queries.select("id", "query", "hit_endpoint").mapInPandas(run, ANSWERS)


def scored(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Per query: its columns with the answer's and technique_recall, technique_hit, actor_recall, actor_hit, cve_hit (0 and false on errors)."""
    rows = queries.join(answers.hint("merge"), "id")
    good, low = F.col("error").isNull(), lambda c: F.transform(c, F.lower)
    out = {"cve_hit": good & hit(low("expected_cves"), F.col("blob"))}
    for kind, expected in (("technique", "expected_techniques"), ("actor", "expected_groups")):
        out[f"{kind}_recall"] = F.when(good, F.round(recall(low(expected), F.col("blob")), 3)).otherwise(0.0)
        out[f"{kind}_hit"] = good & hit(low(expected), F.col("blob"))
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) if k.endswith("hit") else v for k, v in out.items()})


def levels(rows: DataFrame, by: str, keys: list[Column] = (), *measures: Column) -> DataFrame:
    """`measures` per `by` (overall: false) and over all rows (overall: true, null key)."""
    return rows.groupingSets([[F.col(by), *keys], list(keys)], F.col(by), *keys).agg(F.grouping(by).cast("boolean").alias("overall"), *measures)


def summary(rows: DataFrame, by: str, latency: str, digits: int = 2) -> DataFrame:
    """Per `by` and overall: n, n_ok, n_errors; over the rows without error: mean recall, hit rate in %, mean and p95 of
    `latency`. rows: by, expected, blob, latency and, where there may be errors, error."""
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    good = error.isNull()
    each = rows.select(by, F.when(good, recall(F.col("expected"), F.col("blob"))).alias("r"), (good & hit(F.col("expected"), F.col("blob"))).alias("h"), F.when(good, F.col(latency)).alias("_latency"), good.alias("_ok"))
    n, ok = F.count("*"), F.count_if("_ok")
    out = levels(each, by, [], n.alias("n"), ok.alias("n_ok"), (n - ok).alias("n_errors"), F.round(F.avg("r"), 4).alias("recall"), F.round(F.try_divide(100.0 * F.count_if("h"), ok), 1).alias("hit_rate"), F.round(F.avg("_latency"), digits).alias("mean"))
    counts = levels(each.filter("_ok").groupBy(by, "_latency").agg(F.count("*").alias("_n")), by, [F.col("_latency")], F.sum("_n").alias("_n"))
    p95 = value_at(counts, [by, "overall"], "_latency", "_n", 0.95, "p95").withColumnsRenamed({by: "_by", "overall": "_overall"})
    return out.join(p95, F.col(by).eqNullSafe(F.col("_by")) & (F.col("overall") == F.col("_overall")), "left").drop("_by", "_overall", "overall")


def efficiency(manual_minutes: Column, seconds: Column) -> Column:
    """Manual seconds per system second, null if there are none."""
    return F.round(F.try_divide(manual_minutes * 60.0, seconds), 1)


def outputs(per_query: DataFrame, summaries: DataFrame, by: str, path: str) -> None:
    """Write the rows as JSON lines (`path`/per_query) and the summary (a row a category) as JSON and as text."""
    spark = per_query.sparkSession
    per_query.write.mode("overwrite").json(f"{path}/per_query")
    summaries.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows = summaries.orderBy(F.col(by).isNull(), by).collect()  # one row a category
    columns = [c for c in summaries.columns if c != by]
    lines = [" ".join([f"{'category':<20}", *(f"{c:>12}" for c in columns)])]
    lines += [" ".join([f"{'overall' if r[by] is None else r[by]!s:<20}", *(f"{'-' if r[c] is None else r[c]!s:>12}" for c in columns)]) for r in rows]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")
