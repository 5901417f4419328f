"""Heading stacks and packing of sequences that are cut into parts, against plain loops."""

import random

import numpy as np
import pytest

from threatloom.operators import reports


def brute_sections(rows):
    out, state = {}, {}
    for d, i, label, text, level in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = state.setdefault(d, [0, []])
        if label == "section_header":
            s[0] += 1
            if text and text.strip():
                s[1] = [x for x in s[1] if x[0] < max(1, level or 1)] + [(max(1, level or 1), text.strip())]
        out[d, i] = (s[0], [x[1] for x in s[1]])
    return out


@pytest.mark.parametrize("part", [4096, 7, 1])
def test_heading_stack_of_any_depth(spark, part):
    r = random.Random(part)
    rows = [(d, i, *(("section_header", r.choice(["", " ", None, *[f"h{i}"] * 6]), r.choice([None, 0, 1, 2, 3, 5, 17, 39, 1000])) if r.random() < 0.4 else (r.choice(["text", None]), "t", 3))) for d in [None, *range(12)] for i in range(r.randrange(90))]
    rows += [(50, i, "section_header", f"d{i}", i + 1) for i in range(40)] + [(50, 40, "text", "deep", None), (50, 41, "section_header", "up", 20), (51, 10_000, "text", "alone", None)]
    df = spark.createDataFrame(rows, "d int, i int, label string, text string, level int").repartition(5)
    got = reports.sections(df, "d", "i", "label", "text", "level", part).collect()
    assert {(x.d, x.i): (x.section_no, x.section_path) for x in got} == brute_sections(rows) and len(got) == len(rows)
    deep = {x.i: x.section_path for x in got if x.d == 50}
    assert len(deep[40]) == 40 and deep[41] == [f"d{i}" for i in range(19)] + ["up"]
    assert reports.sections(df.limit(0), "d", "i", "label", "text", "level").count() == 0


def brute_groups(tokens, budget):
    out, full, group = [], 0, 0
    for n in tokens:
        if full > 0 and full + (n or 0) > budget:
            full, group = 0, group + 1
        full += n or 0
        out.append(group)
    return out


@pytest.mark.parametrize("part", [4096, 5])
def test_rows_are_packed_across_parts(spark, part):
    r = random.Random(part)
    docs = {d: [r.choice([None, 0, 1, 5, 40, 499, 500, 501, 2000]) for _ in range(r.randrange(1, 60))] for d in range(15)}
    df = spark.createDataFrame([(d, "x", i, n) for d, ns in docs.items() for i, n in enumerate(ns)], "d long, x string, i int, n long").repartition(4)
    got = {(x.d, x.i): x.group for x in reports.pack_rows(df, ["d", "x"], "i", "n", 500, part).collect()}
    assert got == {(d, i): g for d, ns in docs.items() for i, g in enumerate(brute_groups(ns, 500))}


def test_one_long_document(spark):
    """One document of 300,000 paragraphs: no task holds more than a part of it."""
    n = 300_000
    df = spark.range(n).selectExpr("1 as d", "id as i", "1 + id * 7919 % 120 as n")
    got = reports.pack_rows(df, ["d"], "i", "n", 500).select("i", "group").toArrow().sort_by("i")
    tokens = 1 + np.arange(n) * 7919 % 120
    assert got.column("group").to_pylist() == brute_groups(tokens.tolist(), 500)


def test_long_sections_are_chunked_like_short_ones(spark, monkeypatch):
    rows = [("a", i, "section_header" if i == 100 else "text", f"number {'abcdefghij'[i % 10]} " * (1 + i % 13) + "and so on until it is long enough to be kept as a chunk", i // 9) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos int, label string, text string, page int")
    whole = [tuple(x) for x in reports.chunks(df, "k", budget=60).orderBy("chunk_index").collect()]
    monkeypatch.setattr(reports, "PART", 16)
    assert [tuple(x) for x in reports.chunks(df, "k", budget=60).orderBy("chunk_index").collect()] == whole and len(whole) > 40
