"""Domain operators on small hand-written fixtures."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from threatloom.functions import text as X
from threatloom.operators import evalkit, graph, match, reports, search, vector
from threatloom.sources import bundles, records
from threatloom.streaming import sync


def score(base, sev=None, name="cvssV3_1"):
    return {name: {"baseScore": base, "baseSeverity": sev, "vectorString": "V"}}


@pytest.fixture
def landing(tmp_path):
    def put(n, state="PUBLISHED", cna=None, adp=None, folder="a"):
        d = tmp_path / "in" / folder
        d.mkdir(parents=True, exist_ok=True)
        body = {"cveMetadata": {"cveId": f"CVE-2024-{n}", "state": state, "datePublished": "2024-01-02T03:04:05Z"}, "containers": {"cna": cna or {}}}
        if adp is not None:
            body["containers"]["adp"] = adp
        (d / f"CVE-2024-{n}.json").write_text(json.dumps(body))

    put(1, cna={"descriptions": [{"lang": "de", "value": "Nein"}, {"lang": "en-US", "value": " Yes "}], "metrics": [score(5.0), score("7.5", "high", "cvssV3_0"), score(7.5, "OTHER")], "problemTypes": [{"descriptions": [{"cweId": "cwe-79"}, {"cweId": "CWE-20"}, {"cweId": "x"}]}], "affected": [{"vendor": " v ", "product": "p", "versions": [{"version": "1"}, {"version": ""}]}, {"vendor": "v"}]})
    put(2, cna={"descriptions": [{"lang": "en", "value": " "}]}, adp={"descriptions": [{"lang": "en", "value": "From adp"}], "metrics": [score(0.0)], "problemTypes": [{"descriptions": [{"cweId": "CWE-79"}]}]})
    put(3, state="REJECTED")
    put(4, cna={"descriptions": [{"lang": "fr", "value": "Oui"}]}, adp=[{"metrics": [score(9.8)]}], folder="b")
    (tmp_path / "in" / "CVE-2024-5.json").write_text("{broken")
    return tmp_path / "in"


def test_normalise(spark, landing):
    raw = records.scan(spark, str(landing))
    out = {r.cve_id: r for r in records.normalised(raw, str(landing)).collect()}
    assert set(out) == {"CVE-2024-1", "CVE-2024-2", "CVE-2024-4"}
    a, b, c = (out[f"CVE-2024-{n}"] for n in (1, 2, 4))
    assert (a.description, a.cvss_score, a.severity, a.cvss_v3.version, a.cwe_ids) == ("Yes", 7.5, "HIGH", "3.0", ["CWE-20", "CWE-79"])
    assert [(p.vendor, p.product, [v.version for v in p.versions]) for p in a.affected_products] == [("v", "p", ["1"])]
    assert (b.description, b.cvss_score, b.severity, b.cwe_ids, b.published_date) == ("From adp", 0.0, "NONE", ["CWE-79"], "2024-01-02")
    assert (c.description, c.severity, c.source_file) == ("Oui", "CRITICAL", "b/CVE-2024-4.json")
    n = records.counters(raw, records.normalised(raw)).first()
    assert (n.total, n.written, n.skipped, n.errors, n.no_cvss, n.no_cwe) == (5, 3, 1, 1, 0, 1)
    counted = records.write_normalised(raw, str(landing.parent / "out"), str(landing))  # one job
    assert counted == n.asDict() and spark.read.json(str(landing.parent / "out")).count() == 3
    assert records.normalised(raw, include_rejected=True).count() == 4 and records.scan(spark, str(landing), 2).count() == 2
    assert {r.cve_id: r.id for r in records.point_ids(records.normalised(raw)).collect()}["CVE-2024-1"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "CVE-2024-1"))


def test_derived_edges_and_coverage(spark):
    r = spark.createDataFrame([("c1", ["CWE-1", "CWE-2"]), ("c2", ["CWE-9"])], "cve_id string, cwe_ids array<string>")
    m = spark.createDataFrame([("CWE-1", ["T2", "T1"]), ("CWE-2", ["T1", "T3", "TX"])], "cwe string, techniques array<string>")
    t = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "attack_id string")
    assert sorted(map(tuple, graph.derive_edges(r, m, t).collect())) == [("c1", "T1", "CWE-1"), ("c1", "T2", "CWE-1"), ("c1", "T3", "CWE-2")]
    assert tuple(graph.coverage(r, m).first()) == (3, 2, 66.7, ["CWE-9"])


def test_label_scan_and_map_file(spark, tmp_path):
    nodes = spark.createDataFrame([("Group", "G2", "b"), ("Group", "G1", "z"), ("Tactic", "G0", "t"), ("Group", None, "n"), ("Group", "G2", "a")], "label string, attack_id string, name string")
    assert [tuple(r) for r in graph.label_scan(nodes, "Group", "attack_id", "name").collect()] == [(None, "n"), ("G1", "z"), ("G2", "a"), ("G2", "b")]
    (tmp_path / "m.json").write_text('{"cwe-1": ["T2", "T1"],\n "CWE-2": ["T9"], "CWE-2": ["T1", "T3", "TX"]}')
    assert {r.cwe: r.techniques for r in graph.technique_map(spark, str(tmp_path / "m.json")).collect()} == {"CWE-1": ["T2", "T1"], "CWE-2": ["T1", "T3", "TX"]}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, extra string")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, name string, rank int")
    once = graph.merge_nodes(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x", None), (2, "b", "y", 5), (3, "c", None, 6)]
    assert sorted(map(tuple, graph.merge_nodes(once, new, "id").collect())) == sorted(map(tuple, once.collect()))
    assert {r.id: r.name for r in graph.merge_nodes(old, new, "id", overwrite=True).collect()}[2] is None
    edges = spark.createDataFrame([(1, 2, "k"), (1, 9, "k")], "src int, dst int, note string")
    kept = graph.merge_edges(edges.limit(0), edges, ["src", "dst"], old.select("id"), old.select("id"))
    assert [tuple(r) for r in kept.select("src", "dst").collect()] == [(1, 2)]
    left, links = graph.drop_nodes(old, kept, old.filter("id = 2"), "id")
    assert left.count() == 1 and links.count() == 0


def test_bundle(spark, tmp_path):
    o = lambda kind, i, **k: {"type": kind, "id": f"{kind}--{i}", "name": f"{kind}{i}", **k}
    ref = [{"source_name": "other", "external_id": "Z"}, {"source_name": "mitre-attack", "external_id": "T1"}]
    phases = [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}, {"kill_chain_name": "x", "phase_name": "y"}, {"kill_chain_name": "mitre-attack", "phase_name": "gone"}]
    rel = lambda i, a, k, b, **m: {"type": "relationship", "id": f"relationship--{i}", "source_ref": a, "relationship_type": k, "target_ref": b, **m}
    objects = [
        o("attack-pattern", 1, description="old"), o("attack-pattern", 1, description="Does (Citation: X) harm ", external_references=ref, kill_chain_phases=phases), o("attack-pattern", 2, revoked=True),
        o("intrusion-set", 1, aliases=["A"]), o("tool", 1, x_mitre_aliases=["B"]), o("tool", 2), o("x-mitre-tactic", 1, x_mitre_shortname="impact"),
        rel(1, "intrusion-set--1", "uses", "attack-pattern--1"), rel(2, "tool--1", "uses", "tool--2"), rel(3, "intrusion-set--1", "uses", "attack-pattern--2"), rel(4, "tool--1", "uses", "attack-pattern--1", x_mitre_deprecated=True), rel(5, "intrusion-set--1", "uses", "nothing--1"),
    ]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}))
    every = bundles.objects(spark, str(tmp_path / "b.json"))
    nodes = bundles.nodes(every)
    n = {r.stix_id: r for r in nodes.collect()}
    assert len(n) == 5 and n["attack-pattern--1"].description == "Does  harm" and n["attack-pattern--1"].attack_id == "T1" and n["tool--1"].aliases == ["B"]
    assert [(r.type, r.src, r.dst) for r in bundles.edges(every, nodes).collect()] == [("USES", "intrusion-set--1", "attack-pattern--1")]
    assert [(r.src, r.dst) for r in bundles.tactic_edges(nodes).collect()] == [("attack-pattern--1", "x-mitre-tactic--1")]


def test_sections_and_chunks(spark):
    long = "word " * 30
    items = [("section_header", 1, "One", None), ("text", None, long + "a", 1), ("section_header", 2, "Sub", None), ("text", None, long + "b", None), ("text", None, long + "c", 3), ("page_header", None, long, 3), ("section_header", 1, " ", None), ("text", None, long + "d", 4), ("section_header", 1, "Two", None), ("text", None, "short", 5), ("text", None, "x ....... " + long, 6)]
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(items)], "doc_id string, pos int, label string, level int, text string, page int")
    out = reports.chunks(df, "doc_id", budget=40).orderBy("chunk_index").collect()
    assert [(r.section_path, r.page, r.chunk_index) for r in out] == [(["One"], 1, 0), (["One", "Sub"], None, 1), (["One", "Sub"], 3, 2), (["One", "Sub"], 4, 3)]
    assert all(r.token_count == 31 for r in out)
    stats = {r.doc_id: r for r in reports.chunk_stats(spark.createDataFrame([("d", n) for n in range(1, 101)], "doc_id string, n int"), "doc_id", F.col("n")).collect()}
    assert (stats["d"].p95, stats["d"].median, stats[None].n, stats["d"].from_50) == (95, 50, 100, 50)


def test_tree_walk(spark):
    schema = "doc_id string, body struct<children:array<struct<`$ref`:string>>>, texts array<struct<label:string,level:int,text:string,prov:array<struct<page_no:int>>>>, groups array<struct<label:string,children:array<struct<`$ref`:string>>>>"
    ref = lambda *x: [(y,) for y in x]
    tree = [("d", (ref("#/texts/0", "#/groups/0", "#/texts/9", "#/texts/2"),), [("text", None, "a", [(1,)]), ("text", None, "b", None), ("text", None, "c", [(None,), (2,)]), ("text", None, "e", [])], [("list", ref("#/texts/1", "#/groups/1")), ("list", ref("#/texts/3", "#/tables/0"))])]
    out = bundles.tree_items(spark.createDataFrame(tree, schema)).orderBy("pos").collect()
    assert [(r.text, r.page) for r in out] == [("a", 1), ("b", None), ("e", None), ("c", 2)]


def test_legacy_chunks(spark):
    t = "z" * 90
    rows = [("a", json.dumps({"chunks": [{"text": t, "meta": {"page_no": 3}}, {"text": "", "content": t + "1"}]})), ("b", json.dumps({"body": [{"body": t, "page_no": 7}]})), ("c", json.dumps([t, "short"]))]
    out = records.legacy_chunks(spark.createDataFrame(rows, "stem string, json string")).orderBy("stem", "pos").collect()
    assert [(r.stem, r.page, len(r.text)) for r in out] == [("a", 3, 90), ("a", None, 91), ("b", 7, 90), ("c", None, 90)]


def test_matching(spark):
    e = spark.createDataFrame([("Emotet", "S1", "software", ["Geodo", "geodo", "APT28x"]), ("Wizard Spider", "G1", "group", ["page", "abc"])], "canonical string, attack_id string, type string, aliases array<string>")
    aliases = match.alias_dictionary(e, spark.createDataFrame([("Page",)], "key string"))
    assert [(r.alias, r.exact) for r in aliases.collect()] == [("Wizard Spider", False), ("APT28x", True), ("Emotet", False), ("Geodo", False)]
    chunks = spark.createDataFrame([(1, "EMOTET and emotet, apt28x"), (2, "wizard spider\nAPT28x éAPT28x"), (3, "page abc")], "id int, text string")
    found = {(r.id, r.attack_id): r.n for r in match.entity_mentions(chunks, aliases, ["id"]).collect()}
    assert found == {(1, "S1"): 2, (2, "G1"): 1, (2, "S1"): 1}
    c = match.classified(spark.createDataFrame([("An MSP  statistics",), ("lorem ipsum",), ("lorem ics",), ("",), (None,)], "t string"), "t", {"x": [" msp "], "y": ["ics", "ICS"]}, ["lorem"]).collect()
    assert [(r.categories, r.excluded) for r in c] == [(["x", "y"], False), ([], True), (["y"], False), ([], True), ([], True)]


def test_phrases_need_no_whole_words(spark):
    docs = spark.createDataFrame([(1, "pre one two threepost"), (2, "one  two"), (3, "xx yy")], "d int, t string")
    p = spark.createDataFrame([(1, "one two three"), (2, "x y"), (3, "one"), (4, "")], "i int, p string")
    assert sorted((r.d, r.i) for r in match.phrase_mentions(docs, p, "d", "t", "i", "p").collect()) == [(1, 1), (1, 3), (2, 3), (3, 2)]


def test_search(spark):
    vectors = spark.createDataFrame([(f"c{i}", [1.0, i / 10], 7.0 if i % 2 else None, "HIGH", None if i == 1 else f"2024-0{i + 1}") for i in range(6)], "cve_id string, vector array<float>, cvss_score double, severity string, published string")
    links = spark.createDataFrame([("c5", "T1", "n"), ("c5", "T2", "m"), ("c9", "T1", "n")], "cve_id string, attack_id string, name string")
    chunks = spark.createDataFrame([("p1", [1.0, 0.0], "text")], "id string, vector array<float>, text string")
    out = search.similar(vectors, links, [1.0, 0.0], 3)
    # of the first three by cosine none has links: 0.7 times the cosine, and 0.15
    assert [(r.cve_id, r.final_score) for r in out.collect()] == [("c0", 0.85), ("c1", 0.8465259), ("c2", 0.8364067)]
    assert [r.cve_id for r in search.similar(vectors, links, [1.0, 0.0], 6, alpha=1.0).collect()] == [f"c{i}" for i in range(6)]
    assert search.similar(vectors, links, [1.0, 0.0], 6, alpha=0.0).first().cve_id == "c5"
    late = search.hybrid(vectors, links, chunks, [1.0, 0.0], "cve", 2, after_date="2024-03")
    assert {r.cve_id for r in late.collect()} == {"c2", "c3"}
    both = search.hybrid(vectors, links, chunks, [1.0, 0.0], "all", 3, min_cvss=5).collect()
    assert both[0].id == "p1" and search.hybrid(vectors, links, chunks, [1.0, 0.0], "none").count() == 0
    with pytest.raises(ValueError):
        search.hybrid(vectors, links, chunks, [1.0], top_k=0)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert vector.nearest_batch(v, v.filter("vec_id < 2"), 3, "vec_id", "embedding").count() == 6
    reports_ = spark.createDataFrame([("p1", [1.0, 0.0], "a", "pdf"), ("p2", [1.0, 0.1], "b", "pdf"), ("p3", [1.0, 0.0], "a", "web")], "id string, vector array<float>, source string, source_type string")
    assert [r.id for r in search.hybrid(vectors, links, reports_, [1.0, 0.0], "pdf").collect()] == ["p1", "p2"]
    assert [r.id for r in search.hybrid(vectors, links, reports_, [1.0, 0.0], "pdf", report="b").collect()] == ["p2"]
    told = search.narrative(spark.createDataFrame([("q",)], "prompt string"), lambda ps: ["Body\nmore\nConfidence: high (sure)" for _ in ps]).first()
    assert (told.narrative, told.confidence) == ("Body\nmore", "HIGH")


def test_pivot_and_expand(spark):
    tech = spark.createDataFrame([("T1", "One"), ("T2", "Two")], "attack_id string, name string")
    tactics = spark.createDataFrame([("T1", "x"), ("T1", "y")], "attack_id string, tactic string")
    actors = spark.createDataFrame([("T1", "group", "g2"), ("T1", "group", "g1"), ("T1", "software", "s")], "attack_id string, kind string, actor string")
    pattern = spark.createDataFrame([("c1", "T1", "CWE-1"), ("c2", "T1", "CWE-1"), ("c1", "T2", "CWE-2")], "cve_id string, attack_id string, cwe_id string")
    p = search.pivot("T1", tech, tactics, actors, pattern).first()
    assert (p.tactics, p.groups, p.software, p.record_count) == (["x", "y"], ["g1", "g2"], ["s"], 2)
    assert search.pivot("T9", tech, tactics, actors, pattern).count() == 0
    e = search.expand(pattern.select("cve_id").filter("cve_id = 'c1'"), spark.createDataFrame([("c1", "d"), ("c3", "d")], "cve_id string, description string"), pattern, tactics, actors).first()
    assert len(e.techniques) == 3 and e.groups == ["g1", "g2"]


def test_sync_three_calls(spark, tmp_path):
    schema, args = "id int, v string, at int", dict(key="id", order=["at"])
    (tmp_path / "in").mkdir()

    table = sync.VersionedTable(spark, str(tmp_path / "t"), "id")
    assert table.read() is None

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("id", "v", "at"), r))) for r in rows))

    def run():
        sync.sync(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c"), **args)
        return sorted((r.id, r.v) for r in table.read().collect())

    put("a.json", (1, "x", 1), (1, "y", 2), (2, "z", 1))
    assert run() == [(1, "y"), (2, "z")]
    assert run() == [(1, "y"), (2, "z")] and table.versions() == [1]
    put("b.json", (2, "new", 3), (3, "q", 1))
    assert run() == [(1, "y"), (2, "new"), (3, "q")]
    kept = [p for p in (tmp_path / "t" / "v=2").glob("b=*")]
    assert len(kept) == 2 and table.versions() == [1, 2]  # only the buckets of 2 and 3 were written again
    gone = spark.createDataFrame([(1,)], "id int")
    table.upsert(table.read().limit(0), gone)
    assert sorted(r.id for r in table.read().collect()) == [2, 3]
    (tmp_path / "t" / "m=4").mkdir()  # a version that was not finished
    assert table.versions() == [1, 2, 3]
    assert (sync.health({"a": 1, "b": 2}), sync.health({"a": 0, "b": 2}), sync.health({"a": None})) == ("ok", "degraded", "not_ready")


def test_text_functions(spark):
    df = spark.createDataFrame([("é x", "HIGH", ["a"], "say CONFIDENCE: low\nCONFIDENCE: LOW it")], "t string, s string, i array<string>, c string")
    r = df.select(X.uuid5(X.URL_NAMESPACE, F.col("t")), X.embed_text(F.col("s"), F.col("i"), F.lit(None)), X.embed_text(F.lit(""), F.array().cast("array<string>"), F.lit("d")), X.confidence(F.col("c")), X.year_of(F.lit("ENISA_2025")), X.source_label(F.lit("My-Report x"), {"report": "R"})).first()
    assert tuple(r) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "é x")), "HIGH a", "d", "LOW", 2025, "R")
    s = spark.createDataFrame([(["T1"], "has t1 T1"), ([], "none"), (["a", "b"], "a")], "e array<string>, b string").select(evalkit.recall(F.col("e"), F.col("b")), evalkit.hit(F.col("e"), F.col("b"))).collect()
    assert [tuple(x) for x in s] == [(1.0, True), (1.0, True), (0.5, True)]


def test_triples(spark):
    raw = spark.createDataFrame([("c1", [("Foo", "e", "rce"), ("foo", "", ""), (" ", "x", "y")])], "cve_id string, triples array<struct<software:string,evidence:string,attack_class:string>>")
    nodes, edges = records.triples(raw)
    assert [r.name for r in nodes.collect()] == ["Foo"] and sorted(r.description for r in edges.collect()) == ["", "e [rce"]


def test_entity_mentions_add_all_aliases(spark, tmp_path):
    e = spark.createDataFrame([("Emotet", "S1", "software", ["Geodo", "Emo Net", "Emo"]), ("APT29", "G1", "group", ["CozyBear", "Cozy Bear"])], match.ENTITY)
    aliases = match.alias_dictionary(e, spark.createDataFrame([], "key string"))
    chunks = spark.createDataFrame([(1, "s1", "A > B", "Emotet and Geodo and emotet, emo net"), (2, "s2", "", "x" * 150 + " cozy bear or APT29 or apt29 or CozyBear"), (3, "s3", "", "geodot apt29"), (4, "s1", "C", "GEODO\nCVE-2024-1234 CVE-2024-1234 T1059.001 T12345")], "id int, source string, section string, text string")
    found = match.entity_mentions(chunks, aliases, ["id", "source", "section"])
    rows = {(r.id, r.attack_id): (r.n, r.strategy) for r in found.collect()}
    assert rows == {(1, "S1"): (4, "case-insensitive"), (2, "G1"): (3, "case-sensitive"), (4, "S1"): (1, "case-insensitive")}
    assert {r.id: r.context for r in found.collect()}[2].startswith("..." + "x" * 86 + " cozy bear or APT29")
    totals = match.entity_totals(found, ["id"], "source", "section")
    t = {r.canonical: r for r in totals.collect()}
    assert (t["Emotet"]["count"], t["Emotet"].chunks, t["Emotet"].source, t["Emotet"].section, t["APT29"]["count"]) == (5, 2, "s1", "A > B", 3)
    corpus = match.corpus_totals(chunks, totals, "text", X.RECORD_ID, X.TECHNIQUE_ID)
    assert tuple(corpus.first()) == (4, 2, 1, 1)
    report = match.match_report(totals, match.id_counts(chunks, "text", X.RECORD_ID), match.id_counts(chunks, "text", X.TECHNIQUE_ID), corpus, "v1")
    assert "| 1 | Emotet | S1 | software | case-insensitive | 5 | 2 |" in report and "| 1 | CVE-2024-1234 | 2 |" in report and "T1059.001" in report
    nodes = spark.createDataFrame([("Group", "G", "G1", [" Bear ", "bear", "BEAR2", "abc", "Word"]), ("Software", "S", "S1", None), ("Tactic", "T", "x", ["long name"])], "label string, name string, attack_id string, aliases array<string>")
    entities = match.entities_of(nodes, spark.createDataFrame([("WORD",)], "key string"))
    assert {r.attack_id: (r.type, r.aliases) for r in entities.collect()} == {"G1": ("group", ["Bear", "BEAR2"]), "S1": ("software", [])}
    match.write_aliases(entities, str(tmp_path / "d"))
    assert {r.canonical: r.aliases for r in match.read_aliases(spark, str(tmp_path / "d")).collect()} == {"G": ["Bear", "BEAR2"], "S": []}
    assert tuple(match.alias_stats(entities).first()) == (1, 1, 2)
    audit = match.alias_audit(nodes, spark.createDataFrame([("bear",), ("word",)], "word string")).collect()
    assert [(r.problem, r.alias) for r in audit] == [("short", "Bear"), ("short", "bear"), ("short", "Word"), ("short", "BEAR2"), ("common", "Bear"), ("common", "bear"), ("common", "Word")]
    (tmp_path / "k.json").write_text(json.dumps({"categories": {"x": ["A b"]}, "exclude": ["C"]}))
    assert match.keyword_map(str(tmp_path / "k.json")) == ({"x": ["a b"]}, ["c"])


def test_expand_with_similar_records(spark):
    records_ = spark.createDataFrame([("c1", "alpha beta"), ("c2", "alpha beta"), ("c3", "gamma"), ("c4", None)], "cve_id string, description string")
    embed = search.hashing_embedder()
    vectors = search.embedded(records_.withColumn("t", F.coalesce("description", "cve_id")), "t", embed)
    none = spark.createDataFrame([], "cve_id string, attack_id string, cwe_id string, tactic string, kind string, actor string")
    args = [none.select("cve_id", "attack_id", "cwe_id"), none.select("attack_id", "tactic"), none.select("attack_id", "kind", "actor"), vectors, embed]
    out = {r.cve_id: [x.cve_id for x in r.similar] for r in search.expand(records_.filter("cve_id in ('c1', 'c4')"), records_, *args, k=2).collect()}
    assert out["c1"][0] == "c2" and len(out["c1"]) == 2 and "c4" not in out["c4"] and set(out) == {"c1", "c4"}


def test_nearest_batch_keeps_ties_by_key(spark):
    v = spark.createDataFrame([(99 - i, [1.0, 0.0]) for i in range(60)] + [(200, [0.0, 1.0]), (201, None)], "id long, v array<float>").repartition(5)
    out = vector.nearest_batch(v, v.filter("id in (99, 200)"), 5, "id", "v").collect()
    assert sorted((r["query"], r["rank"], r.neighbour) for r in out) == [(99, k + 1, 40 + k) for k in range(5)] + [(200, k + 1, 40 + k) for k in range(5)]


def test_prompts(spark):
    t = "array<struct<attack_id:string,name:string>>"
    rows = [("q1", k + 1, f"c{k}", None if k else "HIGH", 9.81 if k == 0 else 0.0, "d" * 300 if k == 0 else None, [("T2", f"n{k}"), (None, "x"), (f"T9{k}", "m")] if k % 2 == 0 else None) for k in range(7)]
    results = spark.createDataFrame(rows, f"query_id string, rank int, cve_id string, severity string, cvss_score double, description string, techniques {t}")
    details = spark.createDataFrame([("q2", [("T1", "One")], [f"g{i}" for i in range(12)], [])], f"query_id string, techniques {t}, groups array<string>, software array<string>")
    out = {r.query_id: r for r in search.prompts(spark.createDataFrame([("q1", "what {n}?"), ("q2", "x"), ("q3", None)], "query_id string, query string"), results, details).collect()}
    lines = out["q1"].records.split("\n")
    assert lines[0] == f"- c0 [HIGH, CVSS 9.8]: {'d' * 200}..." and lines[1] == "  ATT&CK: T2, T90" and lines[2] == "- c1 [UNKNOWN, CVSS N/A]: ..." and lines[3] == "  ATT&CK: none mapped" and len(lines) == 10
    assert out["q1"].graph == "Techniques across results: T2 (n4), T90 (m), T92 (m), T94 (m)" and out["q1"].n == 7
    assert out["q2"].graph == "Techniques: T1 (One)\nThreat groups: " + ", ".join(f"g{i}" for i in range(10)) and out["q2"].records == search.NO_RECORDS
    assert out["q3"].graph == search.NO_GRAPH and "what {n}?" in out["q1"].prompt and out["q1"].prompt.count("CONFIDENCE") == 1
    model = lambda texts: [[{"text": x[:3], "label": "L", "score": 0.36}, {"text": "no", "label": "L", "score": 0.3}] for x in texts]
    found = search.model_entities(spark.createDataFrame([("abc" * 200,), ("short",), (None,)], "text string"), model).collect()
    assert [[(e.text, e.confidence) for e in r.entities] for r in found] == [[("abc", 0.36)], [], []]


def test_eval_runner(spark, tmp_path):
    rows = [(1, "cve-1", "cve", ["T1"], ["Bear"], [], "a"), (2, "free", "search", ["T1", "T2"], [], ["C9"], "a"), (3, "bad", "investigate", [], [], [], "b")]
    queries = spark.createDataFrame(rows, "id long, query string, hit_endpoint string, expected_techniques array<string>, expected_groups array<string>, expected_cves array<string>, category string")

    def answer(endpoint, query):
        if endpoint == "investigate":
            raise ValueError("down")
        return {"id": query, "groups": ["BEAR"], "t": "t1"} if endpoint == "cve" else [{"result_type": "pdf_chunk", "text": "T1"}, {}]

    out = evalkit.scored(queries, evalkit.answered(queries, answer))
    r = {x.id: x for x in out.collect()}
    assert "cve-1" in r[1].blob and (r[1].technique_recall, r[1].actor_hit, r[1].cve_hit, r[1].n_results) == (1.0, True, True, 0)
    assert (r[2].technique_recall, r[2].technique_hit, r[2].cve_hit, r[2].pdf_hit, r[2].n_results) == (0.5, True, False, True, 2)
    assert (r[3].error, r[3].technique_recall, r[3].actor_hit) == ("down", 0.0, False)
    low = F.transform("expected_techniques", F.lower)
    total = evalkit.summary(out.select("category", low.alias("expected"), "blob", "latency", "error"), "category", "latency", 3)
    t = {x.category: x for x in total.collect()}
    assert (t[None].n, t[None].n_ok, t[None].n_errors, t[None].recall, t["a"].hit_rate, t["b"].n_ok, t["b"].p95) == (3, 2, 1, 0.75, 100.0, 0, None)
    evalkit.outputs(out, total, "category", str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/per_query")).count() == 3 and "overall" in "".join(x.value for x in spark.read.text(str(tmp_path / "e/text")).collect())
    assert spark.createDataFrame([(1, "A")], "x int, y string").select(evalkit.blob().alias("b")).first().b == '{"x":1,"y":"a"}'


def test_ranked_value(spark):
    from threatloom.operators.ranks import ranked_value

    rows = [("a", float(n)) for n in range(1, 101)] + [("b", 7.0), (None, 1.0), (None, 2.0), ("c", None)]
    out = {r.k: r.p95 for r in ranked_value(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert out == {"a": 95.0, "b": 7.0, None: 1.0}


def test_last_edge_wins_and_document_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    edges = spark.createDataFrame([(1, 2, w, 5 - w) for w in range(6)], "src int, dst int, w int, at int").repartition(6)
    assert [tuple(r) for r in graph.merge_edges(edges.limit(0), edges, ["src", "dst"], nodes, nodes, ["at"]).collect()] == [(1, 2, 0, 5)]
    assert [r.w for r in graph.merge_edges(edges.limit(0), edges, ["src", "dst"], nodes, nodes).collect()] == [5]
    new = spark.createDataFrame([(1, 2, None, None, "d1"), (1, 2, "x", 0.5, "d2"), (1, 3, "y", 0.5, "d1")], "src int, dst int, description string, confidence double, source_doc string")
    old = new.withColumn("type", F.lit("USES")).limit(0)
    out = graph.merge_document_edges(old, new, "USES", nodes, nodes)
    assert sorted((r.source_doc, r.description, r.confidence) for r in out.collect()) == [("d1", "", 0.0), ("d2", "x", 0.5)]
    with pytest.raises(ValueError):
        graph.merge_document_edges(old, new, "OWNS", nodes, nodes)


def test_object_projections(spark):
    space = uuid.UUID(graph.OBJECT_NAMESPACE)
    r = spark.createDataFrame([("CVE-2024-1", None, 5.0, "LOW", ["CWE-79"], "2024-01-02"), ("CVE-2024-2", "d", None, None, None, "soon")], "cve_id string, description string, cvss_score double, severity string, cwe_ids array<string>, published_date string")
    v = {x.name: x for x in graph.vulnerabilities(r).collect()}
    one = v["CVE-2024-1"]
    assert one.id == f"vulnerability--{uuid.uuid5(space, 'CVE-2024-1')}" and one.description == "" and [x.url for x in one.external_references] == ["https://nvd.nist.gov/vuln/detail/CVE-2024-1", "https://cwe.mitre.org/data/definitions/79.html"]
    assert v["CVE-2024-2"].created is None and v["CVE-2024-2"].x_cwe_ids == []
    rel = graph.relationships(spark.createDataFrame([("CVE-2024-1", "T1", "CWE-79"), ("CVE-2024-1", "T2", "CWE-79")], "cve_id string, technique string, cwe_id string"), spark.createDataFrame([("T1", "attack-pattern--x")], "attack_id string, stix_id string")).collect()
    key = f"{one.id}:pattern-of:attack-pattern--x"
    assert [x.id for x in rel] == [f"relationship--{uuid.uuid5(space, key)}"] and rel[0].description == "CVE-2024-1 (CWE-79) maps to ATT&CK T1"


def test_vectors_resume_and_count(spark, tmp_path):
    r = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "cve_id string, t string")
    calls = []

    def into(df):
        calls.append(sorted(x.cve_id for x in df.collect()))
        return search.embedded(df, "t", search.hashing_embedder(4)).drop("t")

    assert vector.append_vectors(r, str(tmp_path / "v"), "cve_id", into).count() == 2
    whole = vector.append_vectors(r.union(spark.createDataFrame([("c", "z")], r.schema)), str(tmp_path / "v"), "cve_id", into)
    assert calls == [["a", "b"], ["c"]] and vector.aligned(whole, whole) == 3
    with pytest.raises(ValueError):
        vector.aligned(whole, whole.limit(1))


def test_files_changes_and_reports(spark, tmp_path):
    paths = ["in/a.json", "in/b/a.md", "in/_x.json", "in/parse_summary.json", "in/c.md", "in/d.pdf", "in/e.v2.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.stem: (r.json_path, r.md_path) for r in bundles.document_files(files).collect()} == {"a": ("in/a.json", "in/b/a.md"), "c": (None, "in/c.md"), "e.v2": ("in/e.v2.json", None)}
    h = lambda *rows: spark.createDataFrame(list(rows), "path string, hash string")
    assert {r.path: r.change for r in sync.changes(h(("a", "1"), ("b", "2"), ("n", "1")), h(("a", "1"), ("b", "1"), ("g", "1"))).collect()} == {"b": "changed", "n": "new", "g": "deleted"}
    chunks = spark.createDataFrame([("d1", "s", 2024, 1, "x", 3), ("d1", "s", 2023, 0, " ", 1), ("d2", "t", 2020, 0, "", None)], "doc_id string, source string, year int, chunk_index int, text string, token_count int")
    mentions = spark.createDataFrame([("s", "A"), ("s", "A"), ("s", "B")], "source string, attack_id string")
    assert {r.source: (r.chunk_count, r.year, r.n_entities) for r in reports.report_nodes(chunks, mentions).collect()} == {"s": (2, 2023, 2), "t": (1, 2020, 0)}
    per = match.first_contexts(spark.createDataFrame([("s", "A", "group", 2, "x"), ("s", "A", "group", 1, "y"), ("s", "B", "software", 1, "z"), ("u", "A", "group", 1, "w")], "source string, attack_id string, type string, id int, context string"), ["source", "attack_id", "type"], ["id"], "context")
    nodes = spark.createDataFrame([("Group", "A", "g-a"), ("Group", "B", "g-b")], "label string, attack_id string, stix_id string")
    assert [tuple(r) for r in graph.mention_edges(per, nodes, chunks.select("source")).collect()] == [("MENTIONS", "s", "g-a", 2, ["y", "x"])]
    summary = {r.doc_id: (r.chunks, r.tokens, r.status) for r in reports.write_by_document(chunks, str(tmp_path / "out")).collect()}
    assert summary == {"d1": (2, 4, "ok"), "d2": (1, 0, "empty")} and (tmp_path / "out" / "doc_id=d1").is_dir()
    (tmp_path / "b.json").write_text(json.dumps({"objects": [{"type": "tool", "id": "t", "name": "n"}]}))
    assert bundles.first_available(spark, [str(tmp_path / "no.json"), str(tmp_path / "b.json")]).count() == 1
    with pytest.raises(FileNotFoundError):
        bundles.first_available(spark, [str(tmp_path / "no.json")])
    rows = records.cached(files, str(tmp_path / "cache"), "path", lambda df: df.withColumn("n", F.length("path")))
    assert rows.count() == 7 and records.cached(files, str(tmp_path / "cache"), "path", lambda df: df.withColumn("n", F.length("path"))).count() == 7
    records.write_jsonl(files, str(tmp_path / "j"))
    assert records.jsonl(spark, str(tmp_path / "j"), "path string").count() == 7


def test_ids_and_technique_texts(spark):
    df = spark.createDataFrame([(" cve-2024-12345 ", ["a", "b"], "N", "d" * 600), ("xCVE-2024-1234", None, None, None)], "i string, t array<string>, n string, d string")
    r = df.select(X.is_record_id(F.col("i")), X.path_id(F.col("i")), X.technique_text(F.col("t"), F.col("n"), F.col("d"))).collect()
    assert tuple(r[0]) == (True, "CVE-2024-12345", "a | b | N: " + "d" * 500) and tuple(r[1]) == (False, "XCVE-2024-1234", ": ")
    with pytest.raises(Exception, match="no year"):
        df.select(X.year_of(F.col("n"), strict=True)).collect()


def test_deep_groups_and_cycles(spark):
    schema = "doc_id string, body struct<children:array<struct<`$ref`:string>>>, texts array<struct<label:string,level:int,text:string,prov:array<struct<page_no:int>>>>, groups array<struct<label:string,children:array<struct<`$ref`:string>>>>"
    tree = lambda n, last: [("d", ([("#/groups/0",)],), [("text", None, "deep", None)], [("g", [(f"#/groups/{i + 1}" if i + 1 < n else last,)]) for i in range(n)])]
    assert [r.text for r in bundles.tree_items(spark.createDataFrame(tree(9, "#/texts/0"), schema)).collect()] == ["deep"]
    with pytest.raises(Exception, match="inside itself"):
        bundles.tree_items(spark.createDataFrame(tree(3, "#/groups/0"), schema)).collect()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "a tree of 30 levels")
    assert [r.text for r in bundles.tree_items(spark.createDataFrame(tree(30, "#/texts/0"), schema)).collect()] == ["deep"]
    assert len(jobs.getJobIdsForGroup("deep")) <= 40  # rounds grow with the logarithm of the depth
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_short_phrases_meet_by_characters(spark):
    docs = spark.createDataFrame([(1, "a, b\nxyz"), (2, "é−é"), (3, None)], "d int, t string")
    p = spark.createDataFrame([(1, ", "), (2, "\nx"), (3, "é−"), (4, "zz"), (5, "b\nxyz")], "i int, p string")
    assert sorted((r.d, r.i, r["at"]) for r in match.phrase_mentions(docs, p, "d", "t", "i", "p").collect()) == [(1, 1, 2), (1, 2, 5), (1, 5, 4), (2, 3, 1)]


def test_packing_long_documents(spark):
    sizes = [1 + (i * 7) % 9 for i in range(3000)]
    df = spark.createDataFrame([(1, "\n".join("w " * n for n in sizes)), (2, ""), (3, None)], "d int, t string")
    groups, used = [[]], 0
    for n in sizes:
        if used and used + n > 50:
            groups.append([])
            used = 0
        groups[-1].append(n)
        used += n
    out = reports.pack_paragraphs(df, "d", "t", budget=50).orderBy("group").collect()
    assert [(r["group"], r.paragraphs, r.tokens) for r in out] == [(i, len(g), sum(g)) for i, g in enumerate(groups)]


def test_stored_tables_can_be_cleaned(spark):
    from pathlib import Path

    from threatloom import session

    session.cleaned(spark)
    out = session.stored(spark.range(3).toDF("n"), "case")
    folder = Path(session.shared_dir(spark).removeprefix("file://"))
    assert out.count() == 3 and len(list(folder.glob("case-*"))) == 1
    assert session.cleaned(spark) == 1 and not list(folder.glob("case-*"))
