"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Texts become blocks of about BLOCK bytes: a block has the distinct words of its documents and their tokens as places
in that list, so what travels afterwards are distinct words and n-grams of blocks, sorted, delta coded and compressed.

Level 1: blocks send their words, with how often training documents hold them, to the words' shards; a shard adds up, numbers its words by
falling count, and answers each block with numbers and counts. Level k: blocks send their distinct k-grams of known words
whose parts level k - 1 holds (no other can be in the corpus), with training counts and the context's backoff weight, to shards; a shard adds
up, builds its part of level k as a trie (ngram_trie: Elias-Fano pointers, quantised probabilities), maps it, and answers every
block by searching the trie. The tries are the model: they grow with the corpus, are written to the shared folder where the model is kept, and no
task holds more than a part of about SHARD keys. Blocks are bucketed by number, so only the answers travel to them. Contexts whose words all stand more than SHARD times in training are dealt to several
shards by the last word, however many rows they have.

Smoothing is interpolated Witten-Bell with the number of words seen after a context h by Heaps' law, t(h) = c(h) ** GROWTH:
p(w | h) = (c(h w) + t(h) p(w | shorter h)) / (c(h) + t(h)), down to (c(w) + 1/2) / (N + (V + 1) / 2), which gives all unknown words together the share of one.
It needs counts of h alone, so parts of a context agree. The trie holds c(h w) / (c(h) + t(h)) in PROB_MOST steps of log10 (at most
0.024 off) and, per k-gram as a context to come, t / (c + t). A document is its words and one end, which also stands before the first word as context.

Defined results: null text is empty and scores its end alone; documents with a null id are learned from; without any training document every
token has probability 1 (N = V = 0); repeated rows count and are scored each; words are cut at ASCII white space only; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_path, slices, stored
from .ngram_trie import BACK_MOST, PROB_MOST, Trie, grouped, mapped, pack, pack_columns, quantised, unpack, unpack_columns, value_of

ORDER, BLOCK, SHARD, GROWTH = 3, 8 << 20, 1 << 20, 0.75
END = b"\n"  # no word holds white space
KEYS, ANSWERS = "shard long, block long, keys binary, n binary", "shard long, block long, answer binary, level binary, n_keys long"


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def backoff(count: np.ndarray) -> np.ndarray:
    """Codes of t / (c + t); 0 where nothing was counted."""
    c = np.maximum(np.asarray(count, np.float64), 1.0)
    return np.where(np.asarray(count) > 0, quantised(c**GROWTH / (c + c**GROWTH), BACK_MOST), 0)


def context_count(code: np.ndarray) -> np.ndarray:
    """The count that a backoff code stands for."""
    weight = value_of(code, BACK_MOST)
    return np.where(code > 0, np.maximum(1.0, np.rint(((1 - weight) / np.maximum(weight, 1e-12)) ** (1 / (1 - GROWTH)))), 0.0)


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A hash of rows of integers."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(29))
    return h


class Places(dict):
    """Words, numbered as they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(df: DataFrame, held: Column, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """block, doc, held, sizes (tokens, ends included), tokens (places in words), words, end_place, n_words, n_tokens, n_train (tokens)."""
    kind = df.schema[key].dataType.simpleString()
    c = lambda data: zstandard.ZstdCompressor(level=1).compress(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, docs, helds, tokens, held_bytes = Places(), [], [], [], 0
        number = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            sizes, flat, words = np.array([len(t) for t in tokens]), np.concatenate(tokens), list(places)
            order = np.argsort(-np.bincount(flat), kind="stable")  # frequent words get short places
            turned = np.empty(len(order), np.int64)
            turned[order] = np.arange(len(order))
            train = int(sizes[~np.array(helds, bool)].sum())
            row = ([number], [docs], [helds], [pack(sizes)], [pack(turned[flat])], [c(b" ".join([words[i] for i in order]))], [int(turned[places[END]])], [len(places)], [int(sizes.sum())], [train])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names)

        types = None
        names = ["block", "doc", "held", "sizes", "tokens", "words", "end_place", "n_words", "n_tokens", "n_train"]
        for batch in slices(batches, 64):
            types = types or [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            for doc, is_held, said in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens.append(np.array([*map(places.__getitem__, (said or b"").lower().split()), places[END]], np.uint32))
                docs.append(doc)
                helds.append(is_held)
                held_bytes += len(said or b"") + 64
                if held_bytes >= size:
                    yield done()
                    places, docs, helds, tokens, held_bytes, number = Places(), [], [], [], 0, number + 1
        if docs:
            yield done()

    rows = df.select(F.col(key).alias("doc"), held.alias("held"), F.col(text).cast("binary").alias("said"))
    schema = f"block long, doc array<{kind}>, held array<boolean>, sizes binary, tokens binary, words binary, end_place long, n_words long, n_tokens long, n_train long"
    made, spark = bounded_batches(rows).mapInArrow(run, schema), df.sparkSession
    path, parts = held_path(spark, "lm_blocks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    made.write.bucketBy(parts, "block").sortBy("block").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; what was read from them knows its buckets
    return table


@dataclass
class Block:
    """A block with what the levels answered."""

    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray  # places, with an end before each document
    docs: np.ndarray  # document of each token
    since: np.ndarray  # place in its document, 0 for the end before it
    number: np.ndarray  # of each word of the block: id + 1, or 0 if no training document holds it
    count: np.ndarray  # of each word
    rank: np.ndarray  # of each token: place of its id among the block's, from 1; 0 if unknown
    known: np.ndarray  # the block's ids, ascending

    @classmethod
    def of(cls, row: pd.Series, answers: pd.DataFrame) -> Block:
        number, count = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.int64)
        for answer in answers["answer"]:
            step, own_number, own_count = unpack(answer).reshape(3, -1)
            own = np.cumsum(step)
            number[own], count[own] = own_number, own_count
        sizes, flat = unpack(row["sizes"]), unpack(row["tokens"])
        begin = np.cumsum(sizes) - sizes
        tokens = np.insert(flat, begin, row["end_place"])
        docs = np.repeat(np.arange(len(sizes)), sizes + 1)
        since = np.arange(len(tokens)) - (begin + np.arange(len(sizes)))[docs]
        known = np.unique(number[number > 0]) - 1
        rank = np.where(number > 0, np.searchsorted(known, number - 1) + 1, 0)
        return cls(np.array(row["held"], bool), sizes, tokens, docs, since, number, count, rank[tokens], known)

    def asked(self, k: int, within: np.ndarray, before: np.ndarray, backs: np.ndarray, shards: int, size: int, send: bool) -> dict:
        """The distinct k-grams that end at the tokens `within`, to `send`: keys (ids), n, back (of their contexts), shard; and of each of
        those tokens the place of its k-gram. `before` is the sorted place of the context that ends before a token."""
        ends = np.flatnonzero(within)
        code = (before[ends] << max(1, len(self.known).bit_length())) | self.rank[ends]
        first, place = grouped(code)
        tails = ends[first]
        words = [self.tokens[tails - j] for j in range(k - 1, -1, -1)]
        columns = [self.number[w] - 1 for w in words]
        least = np.minimum.reduce([self.count[w] for w in words[:-1]])
        part = mixed(columns[-1]) % (1 + least // size).astype(np.uint64) if (least >= size).any() else np.zeros(1, np.uint64)
        shard = (mixed(*columns[:-1], part) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        turned = np.empty(len(order), np.int64)
        turned[order] = np.arange(len(order))
        spot = np.zeros(len(self.tokens), np.int64)
        spot[ends] = place
        out = {"ends": ends, "place": turned[place], "spot": spot}
        if send:
            n = np.bincount(place[~self.held[self.docs[ends]]], minlength=len(first))
            out |= {"keys": np.stack([c[order] for c in columns], axis=1), "n": n[order], "back": backs[tails[order]], "shard": shard[order]}
        return out


def coded(keys: np.ndarray, n: np.ndarray, back: np.ndarray) -> bytes:
    """Sorted keys by differences, counts, and each context's weight once."""
    same, columns = np.zeros(len(keys), bool), []
    same[1:] = True
    for j in range(keys.shape[1]):
        if j == keys.shape[1] - 1:
            columns += [np.where(same, 0, back)]
        step = keys[:, j].copy()
        step[1:] -= np.where(same[1:], keys[:-1, j], 0)
        columns.append(step)
        same[1:] &= keys[1:, j] == keys[:-1, j]
    return pack_columns([*columns, n])


def decoded(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fields = unpack_columns(data)
    n, columns, back = fields[-1], [], None
    new = np.zeros(len(n), bool)
    new[0] = True
    for j, step in enumerate([*fields[: k - 1], fields[k]]):
        begin = np.flatnonzero(new)
        total, run = np.cumsum(step), np.cumsum(new) - 1
        if j == k - 1:
            back = fields[k - 1][begin][run]
        columns.append(total - (total[begin] - step[begin])[run])
        new[1:] |= columns[-1][1:] != columns[-1][:-1]
    return np.stack(columns, axis=1), n, back


def _word_keys(shards: int):
    """Level 1: a block's words, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
                learned = np.repeat(~np.array(row["held"], bool), unpack(row["sizes"]))
                n = np.bincount(unpack(row["tokens"])[learned], minlength=len(words))
                at = np.array([zlib.crc32(w) % shards for w in words])
                for shard in np.unique(at):
                    own = np.flatnonzero(at == shard)
                    sent = zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in own]))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([sent], pa.binary()), pa.array([pack(np.concatenate([np.diff(own, prepend=0), n[own]]))], pa.binary())], ["shard", "block", "keys", "n"])

    return run


def _word_shard(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, words, steps, counts = int(rows["shard"].iloc[0]), [], [], []
        for keys, n in zip(rows["keys"], rows["n"]):
            words.append(pa.array(zstandard.ZstdDecompressor().decompress(keys).split(b" "), pa.large_binary()))
            step, count = unpack(n).reshape(2, -1)
            steps.append(step)
            counts.append(count)
        every = pa.chunked_array(words).combine_chunks().dictionary_encode()
        index, ends = every.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1]
        total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)
        by_word = pc.array_sort_indices(every.dictionary).to_numpy()
        order = by_word[np.argsort(-total[by_word], kind="stable")]
        order = order[total[order] > 0]
        number = np.zeros(len(total), np.int64)
        number[order] = np.arange(len(order)) * shards + shard + 1
        answers = [pack(np.concatenate(x)) for x in zip(steps, np.split(number[index], ends), np.split(total[index], ends))]
        level = zstandard.ZstdCompressor().compress(b" ".join(every.dictionary.take(pa.array(order)).to_pylist()))
        own = pd.DataFrame({"shard": shard, "block": rows["block"], "answer": answers, "level": None, "n_keys": None})
        return pd.concat([own, pd.DataFrame({"shard": [shard], "block": [None], "answer": [pack(total[order])], "level": [level], "n_keys": [len(order)]})])

    return run


def _gram_shard(k: int, last: bool, keep: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [decoded(x, k) for x in rows["keys"]]
        keys, n, back = (np.concatenate(x) for x in zip(*parts))
        bits, code = max(1, int(keys.max(initial=0)).bit_length()), keys[:, 0]
        for j in range(1, k):
            if int(code.max(initial=0)).bit_length() + bits > 62:
                code = grouped(code)[1]
            code = (code << bits) | keys[:, j]
        first, place = grouped(code)
        keys, back, total = keys[first], back[first], np.bincount(place, weights=n).astype(np.int64)
        held = total > 0
        context = context_count(back[held])
        probs = quantised(total[held] * (1 - value_of(back[held], BACK_MOST)) / np.maximum(context, 1), PROB_MOST)
        level = Trie.of(keys[held], probs, np.zeros(0) if last else backoff(total[held])).to_bytes()
        prob, weight = Trie.open(mapped(level)).codes(keys)  # what was built is what answers
        ends = np.cumsum([len(p[1]) for p in parts])[:-1]
        answers = [pack(x) if last else pack(np.concatenate([x, y])) for x, y in zip(np.split(prob[place], ends), np.split(weight[place], ends))]
        own = pd.DataFrame({"shard": rows["shard"], "block": rows["block"], "answer": answers, "level": None, "n_keys": None})
        return pd.concat([own, pd.DataFrame({"shard": rows["shard"].iloc[:1], "block": [None], "answer": [None], "level": [level if keep else None], "n_keys": [int(held.sum())]})])

    return run


@dataclass
class Levels:
    """Per token, from the answers: its probability so far, and the codes of the k-gram that ends there."""

    block: Block
    probability: np.ndarray
    prob: np.ndarray
    back: np.ndarray
    spot: np.ndarray  # place among the block's distinct k-grams

    @classmethod
    def first(cls, row: pd.Series, answers: pd.DataFrame, tokens: int, words: int) -> Levels:
        block = Block.of(row, answers)
        share = (block.count + 0.5) / (tokens + 0.5 * (words + 1)) if tokens else np.ones(len(block.count))
        return cls(block, share[block.tokens], (block.count > 0).astype(np.int64)[block.tokens], backoff(block.count)[block.tokens], block.rank)

    def asked(self, k: int, shards: int, size: int, send: bool = False) -> dict:
        before = lambda x: np.concatenate(([0], x[:-1]))
        within = (self.block.since >= k - 1) & (self.prob > 0) & (before(self.prob) > 0)
        return self.block.asked(k, within, before(self.spot), before(self.back), shards, size, send)

    def answered(self, k: int, keys: dict, answers: pd.DataFrame, last: bool) -> Levels:
        """Weights of known contexts apply wherever the context was counted."""
        prob, back = np.zeros(len(self.prob), np.int64), np.zeros(len(self.prob), np.int64)
        if len(keys["ends"]):
            ordered = answers.sort_values("shard")
            got = [unpack(x).reshape(1 if last else 2, -1) for x in ordered["answer"]]
            both = np.concatenate(got, axis=1)[:, keys["place"]]
            prob[keys["ends"]] = both[0]
            back[keys["ends"]] = 0 if last else both[1]
        context = np.where(self.block.since >= k - 1, np.concatenate(([0], self.back[:-1])), 0)
        lower = np.where(context > 0, value_of(context, BACK_MOST), 1.0) * self.probability
        return Levels(self.block, lower + value_of(prob, PROB_MOST), prob, back, keys["spot"])


def _block_levels(row: pd.Series, answers: pd.DataFrame, facts: dict, until: int) -> Levels:
    """What is known of a block after level `until`."""
    of = lambda k: answers[answers["k"] == k]
    now = Levels.first(row, of(1), facts["tokens"], facts["words"])
    for k in range(2, until + 1):
        now = now.answered(k, now.asked(k, facts["shards"], facts["size"]), of(k), k == facts["order"])
    return now


def _gram_keys(k: int, facts: dict):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = {"shard": [], "block": [], "keys": [], "n": []}
        for _, row in block.iterrows():
            asked = _block_levels(row, answers, facts, k - 1).asked(k, facts["shards"], facts["size"], True)
            cut = np.flatnonzero(np.diff(asked["shard"])) + 1
            for keys, n, back, shard in zip(*(np.split(asked[c], cut) for c in ("keys", "n", "back", "shard"))):
                if len(n):
                    out["shard"].append(int(shard[0]))
                    out["block"].append(row["block"])
                    out["keys"].append(coded(keys, n, back))
                    out["n"].append(None)
        return pd.DataFrame(out)

    return run


def _scores(facts: dict):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in block.iterrows():
            done = _block_levels(row, answers, facts, facts["order"])
            b, said = done.block, done.block.since > 0
            begin = np.cumsum(b.sizes) - b.sizes
            summed = lambda x: np.add.reduceat(x[said].astype(np.longdouble), begin)  # noqa: B023, E731
            base = np.log10((b.count + 0.5) / (facts["tokens"] + 0.5 * (facts["words"] + 1)))[b.tokens]
            out.append(pd.DataFrame({
                "doc": pd.Series(list(row["doc"]), dtype=object), "held": b.held, "n_tokens": b.sizes, "n_known": np.add.reduceat((b.count > 0).astype(np.int64)[b.tokens][said], begin),
                "base_score": summed(base).astype(np.float64), "score": summed(np.log10(done.probability)).astype(np.float64),
            }))
        return pd.concat(out)

    return run


def score(df: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the rows that `held` leaves."""
    return Model(df, held, key, text, order, block, shard, keep=False).scores()


class Model:
    """The levels of a corpus: `levels[k]` has a row without a block for each shard, with its number of keys and, to `keep`, its trie
    as bytes (words and counts at level 1); its other rows are the answers to blocks."""

    def __init__(self, df: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, block: int = BLOCK, shard: int = SHARD, keep: bool = True):
        self.key, self.order = key, order
        self.kind = df.schema[key].dataType.simpleString()
        self.blocks = blocks(df, held, key, text, block)
        pairs, every, tokens = (x or 0 for x in self.blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first())
        self.facts = {"order": order, "size": shard, "tokens": tokens, "words": 0, "shards": max(1, -(-every // shard))}
        words = max(1, -(-pairs // shard))
        keys = self.blocks.select("block", "held", "sizes", "tokens", "words").mapInArrow(_word_keys(words), KEYS)
        self.levels = {1: stored(keys.groupBy("shard").applyInPandas(_word_shard(words), ANSWERS), "lm-level-1")}
        self.facts["words"] = self.levels[1].filter("block is null").agg(F.sum("n_keys")).first()[0] or 0
        for k in range(2, order + 1):
            keys = self._with_answers(self.blocks.drop("doc", "words"), k - 1).applyInPandas(_gram_keys(k, self.facts), KEYS)
            self.levels[k] = stored(keys.groupBy("shard").applyInPandas(_gram_shard(k, k == order, keep), ANSWERS), f"lm-level-{k}")

    def _with_answers(self, rows: DataFrame, until: int):
        """Blocks met with the answers of the levels up to `until`."""
        answers = [self.levels[k].filter("block is not null").select("block", "shard", "answer", "n_keys", F.lit(k).alias("k")) for k in range(1, until + 1)]
        every = answers[0]
        for x in answers[1:]:
            every = every.unionByName(x)
        return rows.groupBy("block").cogroup(every.groupBy("block"))

    def scores(self) -> DataFrame:
        scored = self._with_answers(self.blocks.drop("words"), self.order).applyInPandas(_scores(self.facts), f"doc {self.kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
        return scored.select(F.col("doc").alias(self.key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(self.facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
