"""Token blocks, BPE, language ID, decontamination: against libraries and brute force."""

import math
import random
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from threatloom.llm import bpe, decontam, langid, queries, token_blocks

WORD, BYTE = queries.WORD_BPE, queries.BYTE_BPE
ODD = [None, "", " ", "\n\n", "a" * 5000, "I'll they're 's 'st x'sx''s", "é😀 　x\xa0y", "!" * 700 + " \n 12ab", "it's\n's 're", "<|endoftext|> A", "\x00 \x1c\x85"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="'stmdrevl aZ1é９!? \n\t\xa0\x85\x1c\x00😀", max_size=60), max_size=8))
def test_bpe_equals_library(texts):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE), special_tokens={})
    flat, per_text, per_slice, slices = bpe.encode_texts(texts, BYTE)
    ends = np.cumsum(per_text)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, per_text)] == [own.encode_ordinary(t) for t in texts]
    assert per_slice.sum() == per_text.sum() and slices.sum() == len(per_slice)


def test_bpe_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, ODD[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and sum(r.slice_ids) == len(r.ids)
    assert bpe.encode(df.limit(0), BYTE).count() == 0
    checked = bpe.encode(df.withColumn("same", F.lit(1)), BYTE, round_trip="same").collect()
    assert [(r.doc_id, r.ids) for r in checked] == [(r.doc_id, r.ids) for r in out] and all(r["same"] is True for r in checked)


def test_long_merge_equals_library(library):
    text = "".join(random.Random(3).choice("abcdeé") for _ in range(3000))
    assert bpe.encode_texts([text], BYTE)[0].tolist() == library.encode_ordinary(text)


def test_blocks_round_trip():
    random_ids = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 1000, 70_000):
        ids = np.minimum(random_ids.zipf(1.3, n), 49_407)
        block = token_blocks.encode_block(ids, 49_408, b"head")
        back, head = token_blocks.decode_block(block)
        assert (back == ids).all() and head == b"head"
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        token_blocks.decode_block(bytes(damaged))
    assert len(token_blocks.encode_block(np.tile(np.arange(100), 1000), 49_408)) < 50_000  # adapts: 200,000 bytes raw


def test_texts_with_more_words_than_the_table(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_blocks, "SLOTS", 1 << 8)
    token_blocks._words.cache_clear()
    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = [" ".join(f"w{k}x, É{k}!!" for k in range(700)), None, "", "\n  a.", "q" * 40]
    got = [np.frombuffer(x, "<u2").tolist() for x in token_blocks.encode_texts(texts, queries.WORD_BPE, 1)]
    token_blocks._words.cache_clear()
    assert got == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_token_blocks(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    rows = [(9 - i, t) for i, t in enumerate(ODD)] + [(100, "Hello the World"), (100, "Hello the World")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_blocks.write_blocks(df, str(tmp_path / "b"), WORD, 1, shards=4)
    out = token_blocks.read_blocks(spark, str(tmp_path / "b")).orderBy("start").collect()
    start = 0
    for r, (doc, text) in zip(out, sorted(rows, key=lambda x: x[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids)) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    assert len(out) == len(rows)
    token_blocks.write_blocks(df.limit(0), str(tmp_path / "e"), WORD, 1)
    assert token_blocks.read_blocks(spark, str(tmp_path / "e")).count() == 0


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    from threatloom.llm.common import table

    out = queries.op2_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_id_cases(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "12 !?", "de"), (52, "the dog", None), (53, "", None), (None, "und der", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    assert [out[i].lang_pred for i in (50, 51, 53)] == ["und"] * 3 and out[52].lang_pred == "en" and out[None].lang_pred == "de"
    empty = langid.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, empty).collect()} == {("und", 0.0)}


def _contamination(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumnRenamed("doc_id", "n_hit").selectExpr("n_hit as doc_id", "text", "n_hit as items")
    bench = spark.createDataFrame(items, "item_id long, text string")

    out = decontam.contamination(df, bench, part_words=12).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"), "contaminated")
    return [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    words = ["a", "B", "c", "é", "d1", "x"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 25])] + [(20, None), (21, "One, two; three"), (22, "one two three"), (110, "zz " * 12)]
    docs = [None, "", "!!", *(say(r.randrange(0, 60)) for _ in range(40)), *(say(8) + ". " + items[k][1].upper() + " - " + say(5) for k in (4, 5, 6, 7, 8)), "x one TWO three", "zz " * 30]
    docs += docs[-3:]
    assert _contamination(spark, docs, items) == [decontam.brute_force(d, items) for d in docs]
    assert _contamination(spark, docs[:3], items[:1]) == [decontam.brute_force(d, items[:1]) for d in docs[:3]]


def test_decontamination_on_tables(spark):
    from threatloom.llm.common import table

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    out = {r.doc_id: r for r in queries.op5_decontamination(spark, sf).collect()}
    for d in table(spark, sf, "documents").filter("length(text) < 3000").collect():
        r = out[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == decontam.brute_force(d.text, items)


def test_decontamination_null_ids_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, b"x", 5, ["a"], 7), (2, "clean", None, None, None, 8), (None, text.upper(), b"y", 6, [], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hit_words binary, n_words int, items array<string>, _n_hit int")
    bench = spark.createDataFrame([(None, text, 1), (None, "two", 2), (3, text, 3), (3, text, 4)], "item_id long, text string, hit_words int")
    for words in (2_000_000, 11):
        out = {r.doc_id: r for r in decontam.contamination(df, bench, part_words=words).collect()}
        assert (out[1].n_hit, out[1].n_items, out[1]["items"], bytes(out[1].hit_words), out[1]["_n_hit"]) == (11, 2, ["3", None], b"x", 7) and out[None].n_hit == 11 and not out[2].contaminated
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [rows[1]]


def test_blocks_keep_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(3, "a b"), (None, "c"), (None, None), (-5, "")], "doc_id long, text string")
    token_blocks.write_blocks(df, str(tmp_path / "n"), WORD, 1, shards=3)
    out = token_blocks.read_blocks(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, -5, 3] and out[-1].start + out[-1].n_tokens == sum(r.n_tokens for r in out)


def test_token_blocks_query_equals_library(spark):
    from tokenizers import Tokenizer

    from threatloom.llm.common import table

    sf, tokenizer, start = "/root/testdata/sf0.001", Tokenizer.from_file(WORD), 0
    out = {r.doc_id: r for r in queries.op1_token_blocks(spark, sf).collect()}
    docs = sorted(table(spark, sf, "documents").collect(), key=lambda r: r.doc_id)
    assert len(out) == len(docs)
    for d in docs:
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(out[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe_query_equals_library(spark, library):
    import hashlib

    from threatloom.llm.common import table

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in queries.op4_byte_bpe(spark, sf).collect()}
    for d in table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(d.text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(out.pop(d.doc_id)) == (d.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((d.text or "").encode()))
    assert not out


def brute_language(model, text):
    """A prediction from the definition: every n-gram hashed and weighed one by one."""
    points, ngrams = [ord(c) for c in text.lower()], []
    m = 1 << 32
    for i, c in enumerate(points):
        ngrams.append((c * 2654435761 + 12345) * 2246822519 % m >> 16)
        if i + 1 < len(points):
            two = (c * 3266489917 + points[i + 1]) * 668265263 % m
            ngrams.append((two ^ two >> 15) >> 16)
            if i + 2 < len(points):
                three = (two + points[i + 2] * 374761393) * 2654435761 % m
                ngrams.append((three ^ three >> 13) >> 16)
    logits = np.mean([model.table[b].astype(np.float64) for b in ngrams], axis=0) + model.bias
    p = np.exp(logits / model.temperature)
    return model.languages[int(p.argmax())], p.max() / p.sum()


def test_language_query_equals_brute_force(spark):
    import unicodedata

    from threatloom.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    out = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    for d in docs.filter("length(text) < 20000 or text is null").collect():
        lettered = d.text and any(unicodedata.category(c)[0] == "L" for c in d.text)
        lang, score = brute_language(model, d.text) if lettered else ("und", 0.0)
        r = out[d.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and r.score == pytest.approx(score, abs=1e-5)


def test_language_rejects_by_the_model_of_the_tables(spark):
    """Learned prose, mixed texts and texts with numbers stay; random letters, code and languages that weren't learned go."""
    from threatloom.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    r = random.Random(5)
    own = {x.lang: x.text for x in docs.filter("length(text) between 200 and 2000").collect()}
    drawn = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    letters = string.ascii_lowercase + " "
    ascii_ = "".join(map(chr, range(33, 127))) + " "
    strange = {
        "letters": [drawn(letters, n) for n in (40, 80, 300) for _ in range(60)], "ascii": [drawn(ascii_, n) for n in (80, 200, 500) for _ in range(60)],
        "polish": ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."], "finnish": ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."],
        "russian": ["Все люди рождаются свободными и равными в своем достоинстве и правах."],
        "code": ['#include <stdio.h>\nint main(void) { for (int i = 0; i < 10; i++) { printf("%d", i * i); } return 0; }', "def f(x):\n    return [y for y in x if y is not None and len(y) > 3]\n\nclass A(object):\n    def __init__(self):\n        self.x = {}"],
    }
    mixed = [a + " " + b for a in own.values() for b in own.values()] + [own["en"] + " 8316107434564120 a9f3c2e1 +1 (984) 555-5227"]
    rows = [(k, x) for k, xs in strange.items() for x in xs] + [("mixed", x) for x in mixed]
    kept = Counter(x.kind for x in langid.accepted(spark.createDataFrame(rows, "kind string, text string"), model).collect())
    assert kept["mixed"] == len(mixed) and kept["letters"] + kept["ascii"] <= 3 and set(kept) <= {"mixed", "letters", "ascii"}
    held = docs.filter(langid.held_out())
    assert langid.accepted(held, model).count() == held.filter("text rlike '\\\\p{L}'").count()


def test_language_model_learns_from_every_row(spark):
    """Weights, and the cut of what is familiar, come from all labelled rows, however many: each row has a character of its own."""
    r, words = random.Random(2), {"en": "the and of to with that".split(), "de": "der die und das nicht mit".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)) + " " + chr(0x4E00 + i), k) for i in range(2400) for k in (["en", "de"][i % 2],)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    own = [next(langid.buckets(chr(0x4E00 + i)))[0] for i in range(2400)]
    assert sum(bool(model.table[b].any()) for b in own) > 0.75 * 2400  # all but the fifth that fits the temperature
    known = [model.familiar.of_text(t) for _, t, _ in rows]
    assert model.least == pytest.approx(np.mean(known) - langid.SPREAD * np.std(known), rel=1e-6)


def test_language_query_learns_what_it_returns():
    """Evidence takes little more than a text's features, and no familiarity is learned or told where no column reads it."""
    r, words = random.Random(3), "the and der die und das of to nicht mit river été 1".split()
    texts = [" ".join(r.choice(words) for _ in range(800)) for _ in range(100)]
    model = langid.Model(list("abcd"), np.random.default_rng(3).normal(size=(langid.BUCKETS, 4)).astype(np.float32), np.ones(4))

    def seconds(work):
        took = []
        for _ in range(7):
            began = time.process_time()
            for t in texts:
                work(t)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(model.evidence) < 1.9 * seconds(langid.features)
    for t in texts[:5]:
        every = np.concatenate(list(langid.buckets(t)))
        assert model.evidence(t) == pytest.approx(model.table[every].mean(axis=0, dtype=np.float64) + 1, abs=1e-12)
    assert model.predict(texts[0])[2] is None


def test_language_model_without_familiarity(spark):
    """Weights and temperature are those of the whole model; accepted refuses a model that can't tell."""
    r, words = random.Random(4), {"en": "the and of to with that".split(), "de": "der die und das nicht mit".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i in range(300) for k in (["en", "de"][i % 2],)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    whole, part = langid.train(df), langid.train(df, familiar=False)
    assert part.languages == whole.languages and np.array_equal(part.table, whole.table) and np.array_equal(part.bias, whole.bias)
    assert part.temperature == pytest.approx(whole.temperature, rel=1e-9) and part.familiar is None and whole.familiar is not None
    assert langid.predict(df, part).filter("familiarity is not null").count() == 0
    with pytest.raises(ValueError):
        langid.accepted(df, part)


def test_temperature_is_a_least_value():
    r = np.random.default_rng(3)
    for scale, noise in ((1.0, 0.0), (1e-3, 0.0), (50.0, 0.0), (1.0, 1.0)):  # told apart without a fault, and not
        y = r.integers(0, 3, 300)
        scored = [(scale * (np.eye(3)[k] + noise * r.normal(size=3)), int(k)) for k in y]
        t = langid.temperature(scored)
        assert all(langid.log_loss(scored, t) <= langid.log_loss(scored, t * f) for f in (0.5, 0.9, 1.1, 2.0))
        if not noise:
            assert t == pytest.approx(scale / math.log(2 * (1 - 1 / 302) * 302), rel=0.01)  # odds of the smoothed targets
    assert langid.temperature([]) == langid.temperature([(np.zeros(3), 1)]) == langid.temperature([(np.ones(1), 0)]) == 1.0


def test_language_letters_and_rejects(spark):
    """Digits and numerals are no letters; texts in no learned language are unfamiliar, mixed ones aren't."""
    r = random.Random(1)
    words = {"en": "the and of to with that this cat dog house river".split(), "de": "der die und das nicht mit ein haus katze hund fluss".split()}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, say("en" if i % 2 else "de", 30), "en" if i % 2 else "de", 7) for i in range(200)]
    more = [(900, "½ ²", None, 1), (901, "①", "en", 2), (902, say("en", 20) + " " + say("de", 20), None, 3), (903, "щука быстро плывет вниз", None, 4), (904, "qxzj vvkq zzxq jqqx wxyq", None, 5), (905, None, None, 6), (906, "", None, None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, score int")
    model = langid.train(df)
    out = {x.doc_id: x for x in langid.predict(df, model).collect()}
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (900, 901, 905, 906))
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and {(x.doc_id, x.score) for x in kept.collect()} == {(i, 7) for i in range(200)} | {(902, 3)}
