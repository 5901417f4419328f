"""Near duplicates, line runs, search, URLs, personal data, chats, pipeline: against brute force."""

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threatloom.llm import chat, linededup, neardup, pii, queries, topk, urlfilter
from threatloom.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_kmers(text):
    words = text.lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute_similar(x, y):
    """Whether two lists of k-mers (as strings) align to 0.8: the longest common subsequence, as an increasing chain of places
    where no k-mer repeats, by the plain table else."""
    if not x or not y:
        return not x and not y
    needed = 0.8 / 1.8 * (len(x) + len(y)) - 1e-9
    if min(len(x), len(y)) < needed or sum((Counter(x) & Counter(y)).values()) < needed:
        return False
    if len(set(x)) == len(x) and len(set(y)) == len(y):
        place, tails = {k: i for i, k in enumerate(x)}, []
        for i in (place[k] for k in y if k in place):
            at = bisect_left(tails, i)
            tails[at : at + 1] = [i]
        return len(tails) >= needed
    row = [0] * (len(y) + 1)
    for a in x:
        last, row = row, [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1] >= needed


def brute_classes(docs):
    """Union-find over all pairs of different texts."""
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(d, t, brute_kmers(t)) for d, t in docs if t is not None]
    for i, (a, s, x) in enumerate(known):
        for b, t, y in known[:i]:
            if s == t or brute_similar(x, y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in root}


def test_near_duplicates_on_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert {r.doc_id: r.class_id for r in queries.op6_near_duplicates(spark, SF).collect()} == brute_classes(docs)


def test_near_duplicate_cases(spark):
    r = random.Random(2)
    base = [r.choice("abcdefghij") * 3 + str(k) for k in range(200)]
    edit = lambda n: " ".join("new" if i in n else w for i, w in enumerate(base))
    docs = [(1, edit(())), (2, edit((50,))), (3, edit((50, 100))), (4, " ".join(reversed(base))), (5, edit(range(0, 200, 9))), (6, edit(()).upper()), (7, None), (8, ""), (9, ""), (10, "one two"), (11, "One  two"), (12, "x " * 300), (13, "x " * 310), (14, edit(()))]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs] + [(2, docs[1][1], 1), (None, "x", 0)], "doc_id long, text string, class_id int")
    out = [(x.doc_id, x.class_id) for x in neardup.classes(df).collect()]
    expected = brute_classes(docs)
    assert dict(out) == expected | {None: None} and len(out) == 16
    assert expected[3] == expected[6] == expected[14] == 1 and expected[4] == 4 and expected[5] == 5 and expected[13] == 12
    kept = {x.doc_id for x in neardup.one_of_each(df).collect()}
    assert kept == {k for k, v in expected.items() if k == v} | {None}
    assert neardup.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("original", [0, 30, 60])
def test_copies_hang_together_through_their_original(spark, original):
    """Copies with edits of their own are similar to the original only, wherever its doc_id stands."""
    r = random.Random(original)
    base = ["w%d" % r.randrange(10**6) for _ in range(300)]
    docs = []
    for k in range(61):
        new = base.copy()
        if k != original:
            for i in range(6):
                new[i * 48 + r.randrange(40)] = f"edit{k}x{i}"
        docs.append((k, " ".join(new)))
    docs += [(100 + k, " ".join(base[:100] + [f"other{k}x{i}" for i in range(200)])) for k in range(20)]
    expected = brute_classes(docs)
    assert {expected[k] for k in range(61)} == {0} and len(set(expected.values())) == 21
    out = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in out} == expected


def test_pairs_in_a_template_family(spark):
    """Copies that share their buckets with a large family, of which no hub is similar to them."""
    r = random.Random(7)
    say = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    template = say(343)
    docs = [(k, " ".join(template[:150] + say(57) + template[150:])) for k in range(300)]
    for k in range(300, 340, 2):
        both = say(22)
        docs += [(k + i, " ".join(template[:150] + both + say(35) + template[150:])) for i in range(2)]
    r.shuffle(docs)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    expected = brute_classes(docs)
    assert len(set(expected.values())) == 320
    out = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in out} == expected


@pytest.mark.parametrize("shared", [255, 258, 260])
def test_links_inside_a_family_that_shares_a_long_passage(spark, shared):
    """Pairs at 0.81 to 0.85 among hundreds that share a passage of `shared` words at less than 0.8."""
    r = random.Random(shared)
    say = lambda n: ["w%d" % r.randrange(10**7) for _ in range(n)]
    passage, own = say(shared), 300 - shared
    docs = [passage[:128] + say(own) + passage[128:] for _ in range(300)]
    docs = [d if brute_ratio(d, docs[0]) < 0.8 else d + say(60) for d in docs]
    both = int(own * 0.45)
    for _ in range(40):
        common = say(both)
        docs += [passage[:128] + common + say(own - both) + passage[128:] for _ in range(2)]
    r.shuffle(docs)
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    expected = brute_classes(rows)
    linked = {d for d, c in expected.items() if sum(x == c for x in expected.values()) > 1}
    assert len(linked) >= 80
    assert {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def brute_ratio(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(a & b) / len(a | b)


def brute_similarity(s, t):
    """Of two texts, with strings as k-mers and the plain table of the longest common subsequence."""
    x, y = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in (s.lower().split(), t.lower().split()))
    row = [0] * (len(y) + 1)
    for a in x:
        last = row
        row = [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def test_similarity_equals_brute_force():
    r = random.Random(9)
    seen = set()
    for k in range(300):
        pool = ["w%d" % i for i in range(r.choice([1, 2, 3, 40]))]
        header = [r.choice(pool) for _ in range(8)]
        s = [w for _ in range(r.randrange(1, 9)) for w in header + ["o%d" % r.randrange(10**6) for _ in range(r.randrange(4))]]
        t = s.copy()
        for _ in range(r.randrange(4)):
            at, n = r.randrange(len(t)), r.randrange(9)
            t[at : at + n] = r.choice([[], header, ["new"]])
            t = t or ["x"]
        s, t = " ".join(s), " ".join(t)
        exact, own = brute_similarity(s, t), neardup.similarity(neardup.kmers(s), neardup.kmers(t))
        assert own == (pytest.approx(exact) if exact >= 0.8 - 1e-12 else 0.0), (s, t)
        seen.add(exact >= 0.8)
    assert seen == {True, False}


def test_recurring_passage_with_an_early_one_left_out(spark):
    r = random.Random(3)
    say = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    header = say(10)
    parts = [w for _ in range(100) for w in (header, say(20))]
    docs = [(k, " ".join(w for i, p in enumerate(parts) if i != 4 * k for w in p)) for k in range(1, 4)] + [(4, " ".join(w for p in parts for w in p))]
    assert brute_similarity(docs[0][1], docs[3][1]) > 0.98
    out = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.class_id for x in out} == {1} and len(out) == 4


def brute_runs(docs, least):
    """From each line, the longest run that stands earlier without overlap is cut if it has enough lines."""
    seen, places, out = [], defaultdict(list), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        own = [x.strip() for x in (t or "").split("\n") if x.strip()]
        gone = set()
        for a, x in enumerate(own):
            longest = 0
            for k, b in places[x]:
                other, n = seen[k] if k < len(seen) else own, 0
                while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n] and (k < len(seen) or b + n < a):
                    n += 1
                longest = max(longest, n)
            if longest >= least:
                gone.update(range(a, a + longest))
            places[x].append((len(seen), a))
        seen.append(own)
        kept, n = [], 0  # blank lines between two lines that go, go
        for x in (t or "").split("\n"):
            if x.strip():
                n += 1
            if not (n - 1 in gone if x.strip() else n - 1 in gone and n in gone):
                kept.append(x)
        out[d] = "\n".join(kept) if gone else t
    return out


def brute_longest(docs):
    """Lines of the longest run of each text that stands at another place too."""
    own = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in docs}
    places = defaultdict(list)
    for d, x in own.items():
        for a, line in enumerate(x):
            places[line].append((d, a))
    out = dict.fromkeys(own, 0)
    for d, x in own.items():
        for a, line in enumerate(x):
            for e, b in places[line]:
                n = 0
                while (d, a) != (e, b) and a + n < len(x) and b + n < len(own[e]) and x[a + n] == own[e][b + n]:
                    n += 1
                out[d] = max(out[d], n)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 7])
def test_line_runs_equal_brute_force(spark, least):
    r = random.Random(least)
    pool = [" ".join(r.choice("abc") + str(k) for _ in range(r.randrange(1, 4))) for k in range(12)]
    docs = []
    for d in range(60):
        text = [r.choice(pool) for _ in range(r.randrange(0, 12))]
        if r.random() < 0.4:
            text += ["", *pool[2:8]]
        docs.append((d, "\n".join(text)))
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, "\n".join([pool[0]] * 40)), (104, docs[3][1]), (105, "\n".join(pool[k % 5] for k in range(300))), (106, "own\n" + "\n".join(pool[k % 5] for k in range(1, 290)) + "\nend")]
    df = spark.createDataFrame([(d, t, "x", 3, 4) for d, t in docs], "doc_id long, text string, runs string, _th int, n_removed int")
    out = linededup.dedup_lines(df, min_lines=least).collect()
    assert {x.doc_id: x.text for x in out} == brute_runs(docs, least) and len(out) == len(docs)
    assert {x.doc_id: x.longest_run for x in out} == brute_longest(docs)
    assert out[0].asDict().keys() == {"doc_id", "text", "runs", "_th", "n_removed", "longest_run"} and all(x.runs == "x" and x["_th"] == 3 for x in out)


def test_line_runs_repeated_rows_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (1, long), (2, "own\n" + long), (None, long)], "doc_id long, text string")
    out = sorted((x.doc_id is not None, x.doc_id or 0, x.text) for x in linededup.dedup_lines(df).collect())
    assert out == [(False, 0, long), (True, 1, ""), (True, 1, ""), (True, 2, "own")]  # the null id comes first
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_texts_are_hashed_once(spark):
    """The hash of a whole text is taken below the explode: above it, it was taken once a line."""
    df = spark.createDataFrame([(1, "a\nb"), (2, " \n"), (3, None)], "doc_id long, text string")
    plan = linededup.line_ids(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    at = [line for line in plan.split("\n")]
    explode = next(k for k, line in enumerate(at) if "Generate" in line)
    assert not any("md5(cast(text" in line for line in at[:explode]) and any("md5(cast(text" in line for line in at[explode:])
    assert sorted((r.doc, r.seq, r.line) for r in linededup.line_ids(df, "doc_id", "text").collect()) == [(1, 0, 0), (1, 1, 1)]


def test_line_rounds_leave_finished_islands(spark):
    """Rounds read and write only islands that go on: a long pair of copies doesn't bring every short one along."""
    docs = [(k, f"short {k // 2}") for k in range(40)] + [(50 + k, "\n".join(f"long {i}" for i in range(20))) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    base = linededup.islands(linededup.line_ids(df, "doc_id", "text")).cache()
    rows, more, sizes = base.select("pos", "isl", "rank", "next", F.lit(True).alias("open"), F.lit(True).alias("goes_on")), True, []
    while more:
        rows, more = linededup.doubled(rows, len(sizes), 80)
        sizes.append(rows.count())
    assert sizes == [80, 40, 40, 40, 40, 40]
    out = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert {d: r.longest_run for d, r in out.items()} == brute_longest(docs) and {d: r.text for d, r in out.items()} == brute_runs(docs, 1)


def test_line_runs_on_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    rows = queries.op7_line_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.text for r in rows} == brute_runs(docs, 1) and {r.doc_id: r.longest_run for r in rows} == brute_longest(docs)
    lines = [x.strip() for r in rows for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))  # no later copy of a line is left


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(230)] + [(i, [0.5, 0.5, -0.5, 0.1, 0.2]) for i in range(300, 340)]
    rows += [(400, [nan] * 5), (401, [inf, 0.0, 0.0, 0.0, 0.0]), (402, None), (403, [None, 1.0, 1.0, 1.0, 1.0]), (404, [1.0]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    found = defaultdict(list)
    for x in topk.top_k(v, v.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        found[x.query_id].append((x["rank"], x.vec_id, x.score))
    whole = [(x.vec_id, x.v) for x in v.collect() if len(x.v) == 5]
    for q in (0, 100, 200, 300):
        a = next(w for i, w in whole if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, w)), i) for i, w in whole if i != q)[:10]
        assert found[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(found) == {0, 100, 200, 300}
    few = v.filter("vec_id < 4")
    assert topk.top_k(few, few.filter("vec_id = 0"), 10).count() == 3 and topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_copies_and_large_values(spark):
    """Repeated ids and vectors, and scores beyond 53 and 64 bits."""
    r = random.Random(5)
    pool = [[r.randrange(-3, 4) for _ in range(3)] for _ in range(6)]
    rows = [(r.randrange(12), r.choice(pool)) for _ in range(90)] + [(20, [3 * 10**8] * 3), (21, [2**60, 1, -(2**60)]), (22, [-(2**62), 0, 0]), (0, [7, 0, 0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, v array<long>, u int")
    got = defaultdict(list)
    for x in topk.top_k(df, df.filter("vec_id % 4 = 0"), 5).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for q in {i for i, _ in rows if i % 4 == 0}:
        a = min(v for i, v in rows if i == q)
        local = lambda w: long(long(a[0] * w[0] + a[1] * w[1]) + long(a[2] * w[2]))  # noqa: E731, B023
        best = sorted((-local(w), i) for i, w in rows if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    big = topk.integer_vectors(spark.createDataFrame([(1, [3e38, -3e38, 3e8])], "vec_id long, embedding array<float>")).first().v
    assert big == [(1 << 63) - 1, -(1 << 63), 1024 * 300000000]


def test_url_rules(spark):
    rows = [("http://a.EXAMPLE.org/es/1", "block", "example.org/es/"), ("http://example.org/en/12", "block", "example.org/en/1"), ("http://badexample.org/es/", "allow", "org/"), ("x://A.com/de/?q", "block", "com/de/"), ("x://a.com/fr/", "allow", "com/fr/"), ("http://a.org", None, None), (None, None, None), ("nothing", None, None), ("a://b.net/x#y", None, None), ("a://b.net/x#y", None, None)]
    df = spark.createDataFrame([(i, u, "word words bad", "z") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, html string, label string")
    out = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(out) == len(rows)
    for i, (_, verdict, rule) in enumerate(rows):
        assert out[i]["rule"] == rule and out[i].verdict in ("allow", "block") and (verdict is None or out[i].verdict == verdict)
    assert (out[0].host, out[0].path, out[5].path, out[6].host, out[8].path) == ("a.example.org", "/es/1", "", "", "/x")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_split_label():
    counts = {"the": 50, "red": 20, "car": 10, "there": 5, "d": 1}
    assert urlfilter.split_label("theredcar", counts, 86) == ["the", "red", "car"]
    assert urlfilter.split_label("zq", counts, 86) == ["zq"]


def test_url_long_labels_and_clashing_columns(spark):
    """A label of 100,000 letters is split in linear time; the table has the operator's own names."""
    rows = [(1, "http://" + "goodword" * 12_500 + ".net/", "good word good word", "x", 1), (2, "http://org/", None, "y", 2), (3, None, "word", None, None)]
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, u string, _u int")).collect()}
    assert (out[1].u, out[1]["_u"], out[2].u, out[3].u) == ("x", 1, "y", None) and out[2].verdict == "allow" and len(out[1].host) == 100_004
    assert urlfilter.split_label("goodword" * 12_500, {"good": 2, "word": 3}, 5) == ["good", "word"] * 12_500


def brute_bayes(pages):
    words = Counter(w for _, _, h in pages for w in re.split("[^a-z]+", (h or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))) if 1 <= len(w) <= 20)
    total = sum(words.values())
    parsed, seen, n = [], {"block": Counter(), "allow": Counter()}, Counter()
    for page, url, _ in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        tokens = [w for x in re.split(r"[^\w]+|_+", host) if x for w in urlfilter.split_label(x, words, total)]
        tokens += ["/" + x for x in re.split(r"[^\w#]+|_+", re.sub("[0-9]", "#", path.lower())) if x]
        fits = [(len(h + p), v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fits)[1] if fits else None
        if verdict:
            seen[verdict].update(tokens)
            n[verdict] += 1
        parsed.append((page, tokens, verdict))
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    b, a = (sum(seen[k].values()) + size for k in ("block", "allow"))
    out = {}
    for page, tokens, verdict in parsed:
        odds = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log((seen["block"][t] + 1) / b) - math.log((seen["allow"][t] + 1) / a) for t in tokens)
        out[page] = verdict or ("block" if round(odds, 9) > 0 else "allow")
    return out


def test_url_verdicts_on_tables(spark):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    out = {r.page_id: r.verdict for r in queries.op8_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert out == brute_bayes(pages)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d(m)) <= 19 and pii.luhn(d(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(d(m)) <= 15])


def test_base_spans_equal_patterns():
    r = random.Random(4)
    parts = ["a.b@c.de", "@", ".", "+", "-", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8.9", "+49 (30) 1234-5678", "é", "x", "\n", "12", "@x.y@z.w", "0", "000255"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 12)))
        assert pii.base_spans(t) == brute_spans(t), t


def brute_class(kind, value):
    if kind == 0:
        return value.split("@")[-1]
    return ".".join(value.split(".")[:2]) if kind == 1 else "".join(c for c in value if c.isdigit())[: 6 if kind == 2 else 4]


def brute_terms(docs):
    """(doc, start, end) of the disclosing terms, by counting texts one by one."""
    texts = sorted({t for _, t in docs if t is not None})
    near = {t: set() for t in texts}
    for t in texts:
        base = brute_spans(t)
        for start, kind, end in base:
            for m in re.finditer(r"[^\W\d_]{3,}", t):
                inside = start - 100 <= m.start() and m.end() <= start or end <= m.start() and m.end() <= end + 100
                if inside and "\n" not in t[min(start, m.start()) : max(end, m.end())] and not any(a < m.end() and m.start() < b for a, _, b in base):
                    near[t] |= {(c, m.group().lower(), *m.span()) for c in (kind, (kind, t[start:end].lower()), (kind, "class", brute_class(kind, t[start:end].lower())))}
    n_t, n_c, n_tc = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in texts:
        for w in {m.group() for m in re.finditer(r"[^\W\d_]{3,}", t.lower())}:
            n_t[w] += 1
        for c in {c for c, _, _, _ in near[t]}:
            n_c[c] += 1
        for pair in {(c, w) for c, w, _, _ in near[t]}:
            n_tc[pair] += 1
    n = len(texts)
    tested = sum(k >= 2 for k in n_tc.values())
    chance = lambda k, e: math.exp(k - e - k * math.log(k / e))
    likely = {(c, w) for (c, w), k in n_tc.items() if k >= 2 and chance(k, n_t[w] * n_c[c] / n) <= 0.05 / tested * (1 + 1e-9)}
    reveals = {(c, w) for (c, w), k in n_tc.items() if (c, w) in likely and math.log(n * k / (n_t[w] * n_c[c])) / math.log(n / min(n_c[c], n - 1)) >= 0.5 - 1e-9}
    return {(d, a, b) for d, t in docs if t is not None for c, w, a, b in near[t] if (c, w) in reveals}


def found_terms(rows):
    return {(r.doc_id, s["start"], s["end"]) for r in rows for s in r.spans if s["kind"] == 4}


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "office", "mail"] * 6 + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}x" for k in range(100)] + ["é" * 4, "ab", "x" * 150])
    docs = []
    for i in range(260):
        words = [word() for _ in range(r.randrange(30))]
        if i % 3 == 0:
            who = r.randrange(9)
            words.insert(r.randrange(len(words) + 1), f"zorbl{'abcdefghi'[who]}x boss{who}@x.org" + r.choice(["", " +49 30 1234-5678", "\n"]))
        docs.append((i, r.choice([" ", " ", "\n"]).join(words)))
    docs += [(300, None), (301, ""), (302, docs[0][1]), (302, docs[0][1])]
    df = spark.createDataFrame([(d, t, "y", 7) for d, t in docs], "doc_id long, text string, near string, doc int").repartition(3)
    out = pii.find(df).collect()
    assert len(out) == len(docs) and all((r.near, r.doc) == ("y", 7) for r in out)
    assert found_terms(out) == brute_terms(docs) and len(found_terms(out)) > 20
    assert all([tuple(s) for s in r.base] == brute_spans(r.text or "") for r in out)
    clean = {r.doc_id: r.sanitised for r in pii.sanitised(pii.find(df)).collect()}
    assert "@" not in "".join(x or "" for x in clean.values()) and clean[300] is None and any("[TERM] [EMAIL]" in x for x in clean.values() if x)
    assert pii.sanitise("a b@c.de f", [(2, 0, 8), (3, 4, 5)]) == "a [EMAIL] f" and pii.sanitise(None, []) is None
    assert pii.find(df.limit(0)).count() == 0


def test_planted_terms_at_several_supports(spark):
    """Terms by one address, by a domain and by a kind, in 2 to 12 texts among 3,000: all are found, and of chance words next to none."""
    r = random.Random(11)
    filler = lambda n: " ".join(f"w{''.join(r.choice('abcdefghijkl') for _ in range(3))}" for _ in range(n))
    code = lambda i: "".join("abcdefghij"[int(x)] for x in f"{i:04d}")
    texts, planted = [], set()
    for i, support in enumerate([2, 3, 5, 12] * 10):
        for k in range(support):
            who = f"person{code(i)}@mail{i}.org" if i % 2 else f"u{code(100 * i + k)}x@firm{code(i)}.org"  # one value, or one domain
            planted.add((len(texts), f"zor{code(i)}"))
            texts.append(f"{filler(15)} zor{code(i)} {who} {filler(15)}")
    for k in range(20):
        planted.add((len(texts), "hotline"))
        texts.append(f"{filler(15)} hotline +49 30 {r.randrange(10**6, 10**7)} {filler(15)}")
    for k in range(300):
        texts.append(f"{filler(15)} x{code(k)}@other{code(k)}.org +1 555 {r.randrange(10**6, 10**7)} {filler(15)}")
    texts += [filler(30) for _ in range(2500)]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(d, texts[d][a:b]) for d, a, b in found_terms(rows)}
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(found)


@pytest.mark.parametrize("copies", [1, 3])
def test_terms_are_found_with_and_without_copies(spark, copies):
    """A term that stands with its entity only, in two texts; copies of the documents change nothing."""
    texts = [f"mail boss@x.org the zorblax number{'abc'[i]}" for i in range(2) for _ in range(copies)]
    texts += [f"the common office mail number{'abc'[i % 3]} {i}" for i in range(600)]
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    terms = {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == 4] for r in out}
    assert len(out) == len(texts) and all(t == (["zorblax"] if d < 2 * copies else []) for d, t in terms.items())


def test_long_lines_of_personal_data():
    """One line with 2,000 addresses and 60,000 words: what is emitted grows with the text, not with its square."""
    text = " ".join(" ".join(["word"] * 30) + f" a{i}@b.org" for i in range(2000))
    spans = pii.base_spans(text)
    assert len(spans) == 2000 and sum(1 for _ in pii.near_terms(text, spans)) <= 2000 * 2 * pii.CONTEXT // 4


def test_pii_on_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    expected = brute_terms(docs)
    out = {r.doc_id: r for r in queries.op9_pii(spark, "/root/testdata/sf0.01").collect()}
    assert {(d, int(a), int(b)) for d, r in out.items() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} == expected
    for d in table(spark, "/root/testdata/sf0.01", "documents").collect():
        spans = brute_spans(d.text)
        r = out[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in spans) for x in range(4))
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(r.spans.split(",")) | {""}
        every = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert r.sanitised_sha256 == (hashlib.sha256(pii.sanitise(d.text, every).encode()).hexdigest() if d.text is not None else None)


def test_chat_events(spark):
    rows = [(1, 0, "delta", 0, "user", "He"), (1, 1, "delta", 0, None, "llo # <\\"), (1, 2, "delta", 1, "assistant", "bad"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, "good"), (1, 5, "edit", 0, None, "Hi </turn> ok"), (1, 6, "delta", 2, "user", "x"), (1, 7, "delete", 2, None, None), (2, 0, None, 0, None, None), (None, 1, "delta", 0, "user", "x"), (3, 0, "delete", 5, None, None), (3, 1, "edit", 4, "assistant", "late"), (3, 2, "delete", 6, None, None)]
    events = spark.createDataFrame([(*r, "y") for r in rows], "conv long, seq long, kind string, turn long, role string, text string, piece string").repartition(3)
    pieces = chat.render(events)
    by = defaultdict(str)
    for r in pieces.orderBy("conv_id", "turn_no").collect():
        by[r.conv_id] += r.piece
    assert chat.parse(by[1]) == [("user", "Hi </turn> ok"), ("assistant", "good")] and chat.parse(by[2]) == [("user", "")] and chat.parse(by[3]) == [("assistant", "late")] and chat.parse(by[None]) == [("user", "x")]
    back = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert back[1].loss_chars == 4 and back[1].loss_sha256 == hashlib.sha256(b"good").hexdigest() and back[1].n_turns == 2 and len(back) == 4
    assert chat.read_back(chat.render(events.limit(0))).count() == 0


def test_chat_messages_repeat(spark):
    """Rows that share a turn stay messages of their own."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, 2, "user", None)]
    df = spark.createDataFrame([(c, t, "message", t, r, x) for c, t, r, x in rows], "conv long, seq long, kind string, turn long, role string, text string").repartition(2)
    pieces = chat.render(df)
    whole = "".join(r.piece for r in pieces.orderBy("turn_no", "part").collect())
    assert chat.parse(whole) == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c"), ("user", "")]
    assert chat.read_back(pieces).first().loss_sha256 == hashlib.sha256(b"cc").hexdigest()


def test_chat_log_folds_back(spark):
    """The log of a conversation holds every kind of change, and its fold is the conversation."""
    r = random.Random(8)
    rows = [(c, r.randrange(9), r.choice(["user", "assistant", None, ""]), r.choice([None, "", "a", "# <\\ é" * r.randrange(9)])) for c in (1, 2, None) for _ in range(25)]
    log = queries.conversation_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {x.kind for x in log.collect()} == {"delta", "edit", "regenerate", "delete"}
    got = defaultdict(list)
    for x in chat.render(log).orderBy("turn_no", "part").collect():
        got[x.conv_id] += chat.parse(x.piece)
    key = lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    assert got == {c: [(role or "user", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=key)] for c in (1, 2, None)}


def test_chat_escapes():
    r = random.Random(6)
    for _ in range(3000):
        role, text = ("".join(r.choice(["\\", "#", "<", ": ", " </turn>\n", "### Assistant: ", "a", "\n", ":"]) for _ in range(r.randrange(0, 6))) for _ in range(2))
        piece, a, b = chat.render_turn(role, text)
        assert chat.parse(piece + piece) == [(role, text)] * 2 and chat.unescape(piece[a:b]) == text


def test_chat_ties_go_by_kind_whatever_the_input_order(spark):
    events = [(1, 5, "delta", 0, "user", "a"), (1, 5, "delete", 0, "user", "a"), (2, 5, "edit", 0, "user", "b"), (2, 5, "delta", 0, "user", "a"), (3, 1, "delta", 0, "user", "x"), (3, 2, "regenerate", 0, None, None), (3, 2, "delta", 0, "user", "y"), (4, 1, None, 0, "user", "p"), (4, 1, "message", 0, "user", "q")]
    expected = {2: ["b"], 3: [""], 4: ["qp"]}
    for turned in (events, events[::-1]):
        df = spark.createDataFrame(turned, "conv long, seq long, kind string, turn long, role string, text string").coalesce(1)
        out = defaultdict(list)
        for r in chat.render(df).collect():
            out[r.conv_id] += [t for _, t in chat.parse(r.piece)]
        assert out == expected


def test_chat_on_tables(spark):
    turns = defaultdict(list)
    for r in table(spark, SF, "conversations").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    out = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    assert set(out) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        learned = "".join(t for _, role, t in rows if role == "assistant")
        r = out[conv]
        assert r.n_turns == len(rows) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in rows).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline
    from threatloom.llm import bpe, decontam, langid

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs.filter(~langid.held_out()))
    judged = {d: model.predict(r.text) for d, r in rows.items()}
    texts = {d: r.text for d, r in rows.items() if judged[d][0] != "und" and judged[d][2] >= model.least}
    cut = brute_runs(list(texts.items()), linededup.MIN_LINES)
    texts = {d: t for d, t in cut.items() if t == texts[d] or t.strip()}
    found = brute_classes(list(texts.items()))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    left = {d: t for d, t in texts.items() if found[d] == d and not decontam.contamination_of(t, items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(left) and all(r.round_trip for r in out.values())
    for d, t in left.items():
        assert out[d].ids == bpe.encode_texts([t], queries.BYTE_BPE)[0].tolist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_pipeline_learns_from_every_labelled_row(spark):
    """A language of which op2's contract would hold out every row, and rows without an id, are learned; missing labels are filled, given ones stay."""
    import zlib

    import corpus_pipeline

    r = random.Random(9)
    words = ["".join(r.choice("бвгджзклмнпрст") + r.choice("аеиоуы") for _ in range(r.randrange(1, 4))) for _ in range(80)]
    held = [k for k in range(10**6, 10**6 + 400) if zlib.crc32(str(k).encode()) % 4 == 2][:60]
    docs = table(spark, SF, "documents").filter("lang in ('en', 'fr')")
    own = [(k, " ".join(r.choices(words, k=80)), "xx", "s", 0) for k in held] + [(None, " ".join(r.choices(words, k=80)), "xx", "s", 0)]
    told = docs.filter("lang = 'fr' and length(text) > 400").first().text
    own += [(-1, told, None, "s", 0), (-2, told, "en", "s", 0), (-3, " ".join(r.choices(words, k=80)), None, "s", 0), (-4, "12 345", None, "s", 0)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"))
    out = corpus_pipeline.language_id(spark, every, SF)
    assert out.columns == every.columns
    got = {x.doc_id: x.lang for x in out.collect()}
    assert set(held) | {None} <= set(got) and {got[k] for k in held} == {"xx"}
    assert (got[-1], got[-2], got[-3], -4 in got) == ("fr", "en", "xx", False)
