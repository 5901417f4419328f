"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 1-, 2- and 3-grams of the lower-cased code points, hashed to BUCKETS; term frequency is
relative (count / n-grams of the text), inverse document frequency counts every document that may
be learned from. Weights come from follow-the-regularised-leader with elastic-net penalties over all labelled rows but a fifth (by
a hash of doc_id), whole texts, in EPOCHS passes: every partition goes on from the same state, and the states they
reach are averaged (iterative parameter mixing). The softmax temperature is fitted on that whole fifth, which training did not see, against smoothed targets (a
share of 1 in N + 2 for the other languages), so that it has an optimum where the rows are told apart without a fault.
States depend on how rows lie in partitions, so probabilities may differ in late digits, or more on small tables, when those change.

Probabilities say which of the learned languages a text is, not whether it is one of them. That is
told by its familiarity: the mean over its letter trigrams (runs of other characters, and words with digits, are one space) of the log
ratio between their share in all learned texts and what its letters alone would give (a letter counts
as one in RARE at least, so rare letters are no evidence), each within CLIP, plus LENIENT / sqrt(n) for few trigrams. A text
that lies SPREAD standard deviations below the mean of all labelled rows with a letter is in no learned language: whatever the
distribution, that holds for less than one learned text in 1 + SPREAD ** 2 (Cantelli), for bell-shaped ones far fewer.

Defined results: a text that is null or holds no letter (Unicode L*) is `und` with score 0; with no labelled
row at all every text is `und`; ties go to the alphabetically first language; repeated rows are
judged alike; columns pass through (clashing names are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, slices, stored

BUCKETS, EPOCHS, CHUNK = 1 << 16, 4, 1 << 20
#: Rows above this share (by a hash) fit the temperature; sums of states are integers of 1 / FIXED.
CALIBRATE, FIXED = 0.8, 1 << 20
ALPHA, BETA, L1, L2, GAIN = 0.5, 1.0, 1e-4, 1e-3, 10.0
TRIGRAMS, CLIP, RARE, LENIENT, SPREAD = 1 << 17, 6.0, 64, 4.0, 7.0
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def _hashed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 2-grams and of the 3-grams of some code points."""
    two = c[:-1] * np.uint32(3266489917)
    two += c[1:]
    two *= np.uint32(668265263)
    three = c[2:] * np.uint32(374761393)
    three += two[:-1]
    three *= np.uint32(2654435761)
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(13)
    return two, three


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, a bounded piece at a time."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), CHUNK):
        c = points[at : at + CHUNK + 2]  # n-grams that begin in this piece
        one = (c * np.uint32(2654435761) + np.uint32(12345)) * np.uint32(2246822519)
        last = at + CHUNK >= len(points)
        for h in (one, *_hashed(c)):
            yield (h if last else h[:CHUNK]) >> np.uint32(16)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, relative frequencies) of a text."""
    found = buckets(text)
    if len(text) < BUCKETS // 4:  # a sort of 16-bit numbers takes less than counts of all buckets
        b = np.concatenate([*found, np.empty(0, np.uint32)], dtype=np.uint16, casting="unsafe")
        b.sort(kind="stable")
        new = np.ones(len(b) + 1, bool)
        np.not_equal(b[1:], b[:-1], out=new[1:-1])
        first = np.flatnonzero(new)  # and the end
        return b[first[:-1]].astype(np.int64), np.diff(first) / max(1, len(b))
    n = np.zeros(BUCKETS, np.int64)
    for b in found:
        n += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at] / max(1, n.sum())


@cache
def _classes() -> np.ndarray:
    """1 for letters, 2 for digits, else 0, by code point."""
    return np.array([1 if c.isalpha() else 2 if c.isdigit() else 0 for c in map(chr, range(0x110000))], np.uint8)


def trigrams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of the letter trigrams, code points) of a text, a bounded piece at a time. Ends of pieces are word ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), CHUNK):
        c = np.full(min(CHUNK, len(points) - at) + 2, 32, np.uint32)
        c[1:-1] = points[at : at + CHUNK]
        kind = _classes().take(c)
        letter, digits = kind == 1, np.flatnonzero(kind == 2)
        if len(digits):  # no letters are left to the words before the gaps that follow digits
            gaps = np.flatnonzero(kind == 0)
            numbered = np.zeros(len(gaps), bool)
            numbered[gaps.searchsorted(digits)] = True
            letter &= ~np.repeat(numbered, np.diff(gaps, prepend=-1))
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] = True  # one space before, and one after each run
        c = np.where(letter, c, np.uint32(32))[kept]
        if len(c) > 2:
            yield _hashed(c)[1] >> np.uint32(15), c


def _letter(points: np.ndarray) -> np.ndarray:
    return (points * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Familiar:
    """Log shares of trigrams, and of letters by bucket."""

    three: np.ndarray
    one: np.ndarray

    @classmethod
    def of(cls, three: np.ndarray, one: np.ndarray) -> Familiar:
        shares = lambda n: np.log((n + 0.5) / (n.sum() + 0.5 * len(n))).astype(np.float32)
        return cls(shares(three), np.maximum(shares(one), -np.log(RARE)).astype(np.float32))

    def of_text(self, text: str) -> float:
        total, n = 0.0, 0
        for b, c in trigrams(text):
            o, ratio = self.one.take(_letter(c)), self.three.take(b)
            for part in (o[:-2], o[1:-1], o[2:]):
                ratio -= part
            np.clip(ratio, -CLIP, CLIP, out=ratio)
            total += float(ratio.sum(dtype=np.float64))
            n += len(b)
        return total / n + LENIENT / n**0.5 if n else LENIENT


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: weight x idf x gain
    bias: np.ndarray
    temperature: float = 1.0
    familiar: Familiar | None = None
    least: float = -math.inf  # familiarity

    def evidence(self, text: str) -> np.ndarray:
        """The logits: a text's buckets are looked up once each."""
        at, v = features(text)
        return v @ self.table.take(at, axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """(language, calibrated probability, familiarity if that was learned)"""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        p = _softmax(self.evidence(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), self.familiar.of_text(text) if self.familiar else None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def document_frequencies(df: DataFrame, text: str, familiar: bool = True) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """How many texts hold each bucket, how many texts there are, and (if `familiar`) counts of letter trigrams and of letters. What leaves a
    task is one row a bucket at most."""
    sizes = (BUCKETS, TRIGRAMS, 1 << 16, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, three, one, texts = (np.zeros(k, np.int64) for k in sizes)
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                n[features(t)[0]] += 1
                texts += 1
                for b, c in trigrams(t) if familiar else ():
                    np.add.at(three, b, 1)
                    np.add.at(one, _letter(c), 1)
        every = np.concatenate((n, three, one, texts))
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(every[at], pa.int64())})

    rows = bounded_batches(df.select(F.col(text))).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(sum(sizes), np.int64)
    every[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    n, three, one, texts = np.split(every, np.cumsum(sizes)[:-1])
    return n, int(texts[0]), three, one


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return w / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl(at: np.ndarray, x: np.ndarray, y: int, state: np.ndarray) -> None:
    """Follow the regularised leader by one example (features at, values x, class y): `state`, a row z then n a bucket, changes in place."""
    own = state.take(at, axis=0).T.copy()  # a row a class: long rows make short work
    z, n = np.split(own, 2)
    root = np.sqrt(n)
    rate = root + BETA
    rate /= ALPHA
    rate += L2
    minus = np.abs(z)  # the weights, but for their sign
    minus -= L1
    np.maximum(minus, 0, out=minus)
    minus /= rate
    np.copysign(minus, z, out=minus)
    p = _softmax(-(minus @ x))
    p[y] -= 1
    g = p[:, None] * x
    z += g
    g *= g
    n += g
    grown = np.sqrt(n)
    grown -= root
    grown /= ALPHA
    z += minus * grown
    state[at] = own.T


def _marked(df: DataFrame, key: str, text: str, lang: str, languages: list[str]) -> DataFrame:
    """text, y (place of the language), calibrate (a fifth of all rows, by a hash of the key)."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(lang)) - 1
    return df.select(F.col(text).alias("text"), place.cast("int").alias("y"), (u >= CALIBRATE).alias("calibrate"))


def _epoch(rows: DataFrame, idf: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One pass over all rows: every partition follows the regularised leader from `state`, and what they reach is averaged, for each
    bucket by how often a partition met it. A task sends one row a bucket at most; sums are of integers, so that their order doesn't matter."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, state))
    names = [f"s{k}" for k in range(state.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, state = shared.value
        state, met, random = state.astype(np.float32), np.zeros(BUCKETS + 1, np.int64), np.random.default_rng(7)
        for batch in slices(batches):
            texts, ys = (batch.column(k).to_pylist() for k in range(2))
            for k in random.permutation(len(texts)):
                at, v = features(texts[k])
                met[at] += 1
                met[BUCKETS] += 1
                ftrl(np.append(at, BUCKETS), np.append(v * idf[at] * GAIN, 1.0).astype(np.float32), ys[k], state)
        at = np.flatnonzero(met)
        sums = np.rint(state[at].astype(np.float64) * met[at, None] * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "met": pa.array(met[at], pa.int64()), **{c: pa.array(sums[:, k], pa.int64()) for k, c in enumerate(names)}})

    schema = ", ".join(f"{c} long" for c in ["met", *names])
    each = bounded_batches(rows.filter("not calibrate").select("text", "y")).mapInArrow(run, f"bucket int, {schema}")
    found = each.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["met", *names]]).toArrow()
    shared.unpersist()
    state, at, met = state.copy(), found.column("bucket").to_numpy(), found.column("met").to_numpy()
    for k, c in enumerate(names):
        state[at, k] = found.column(c).to_numpy() / FIXED / met
    return state


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    """For each row: y, its familiarity (null without a letter) and, if it is to calibrate, its logits. Kept in the shared folder. A model
    without familiarity judges the rows that calibrate alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, calibrate = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            familiar = shared.value.familiar
            known = [familiar.of_text(t) if familiar and LETTER.search(t) else None for t in texts]
            logits = [shared.value.evidence(t).tolist() if c else None for t, c in zip(texts, calibrate)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(known, pa.float64()), pa.array(logits, pa.list_(pa.float64()))], ["y", "familiarity", "logits"])

    rows = rows if model.familiar else rows.filter("calibrate")
    return stored(bounded_batches(rows).mapInArrow(run, "y int, familiarity double, logits array<double>"), "langid-judged")


def _losses(judged: DataFrame) -> tuple[int, Callable[[list[float]], list[float]]]:
    """How many rows calibrate, and their mean log loss at each of some temperatures, one pass for all."""
    rows = judged.filter("logits is not null").select("y", "logits")
    total = rows.count()

    def losses(ts: list[float]) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                if batch.num_rows:
                    y, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
                    yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(ts)), pa.int32()), "loss": pa.array([float(_loss(x, y, t, total).sum()) for t in ts], pa.float64())})

        found = dict(rows.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss")).collect())
        return [found[k] / total for k in range(len(ts))]

    return total, losses


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", familiar: bool = True) -> Model:
    """Learn from all rows of `df` whose text and lang are not null. Without `familiar`, what only `accepted` reads isn't learned; predictions
    are the same."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(key, text, lang)
    languages = sorted(r[0] for r in rows.select(lang).distinct().collect())  # one row a language
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    n, texts, three, one = document_frequencies(rows, text, familiar)
    idf, marked = np.log((1 + texts) / (1 + n)) + 1, _marked(rows, key, text, lang, languages)
    state = np.zeros((BUCKETS + 1, 2 * len(languages)))
    for _ in range(EPOCHS):
        state = _epoch(marked, idf, state)
    weights = _weights(*np.split(state, 2, axis=1))
    model = Model(languages, (weights[:-1] * idf[:, None] * GAIN).astype(np.float32), weights[-1], familiar=Familiar.of(three, one) if familiar else None)
    judged = _judged(marked, model)
    total, losses = _losses(judged)
    if total and len(languages) > 1:
        model.temperature = _least(losses)
    count, mean, spread = judged.agg(F.count("familiarity"), F.avg("familiarity"), F.stddev_pop("familiarity")).first()
    if count > 1:
        model.least = float(mean - SPREAD * spread)
    return model


def _loss(x: np.ndarray, y: np.ndarray, t: float, n: int) -> np.ndarray:
    """Log loss of each row of logits at a temperature, against targets that leave 1 in n + 2 to the other languages."""
    x = x / t
    x = x - x.max(axis=1, keepdims=True)
    minus = np.log(np.exp(x).sum(axis=1, keepdims=True)) - x
    true, others = minus[np.arange(len(y)), y], max(1, x.shape[1] - 1)
    rest = 1 / (n + 2)
    return (1 - rest) * true + rest * (minus.sum(axis=1) - true) / others


def log_loss(scored: list[tuple[np.ndarray, int]], t: float) -> float:
    """Mean log loss of logits at a temperature."""
    return float(_loss(np.array([s for s, _ in scored]), np.array([k for _, k in scored]), t, len(scored)).mean())


def _least(losses: Callable[[list[float]], list[float]]) -> float:
    """The temperature of least loss, which has one valley: four grids on the logarithm, each between the neighbours of the last one's
    least. Without anything to tell apart it is 1."""
    middle, step = 0.0, 2.0
    for _ in range(4):
        grid = [middle + step * k for k in range(-20, 21)]
        found = losses([math.exp(g) for g in grid])
        if step == 2.0 and max(found) - min(found) < 1e-12:
            return 1.0
        middle, step = grid[int(np.argmin(found))], step / 20
    return math.exp(middle)


def temperature(scored: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss of some scored rows."""
    if not scored or len(scored[0][0]) < 2 or not np.ptp([s for s, _ in scored], axis=1).any():
        return 1.0
    return _least(lambda ts: [log_loss(scored, t) for t in ts])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with lang_pred, score and familiarity (null if the model hasn't learned it)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiarity", T.DoubleType())]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    read = text if text in names else fresh(df, "text")  # the texts are sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(zip(*[shared.value.predict(t) for t in batch.column(read).to_pylist()])) or [(), (), ()]
            own = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())], [*names, *(a.name for a in added)])

    schema = T.StructType([*kept, *added])
    return bounded_batches(df.select(*names, *([] if read == text else [F.col(text).alias(read)]))).mapInArrow(run, schema)


def accepted(df: DataFrame, model: Model, least: float = 0.0, text: str = "text", into: str | None = None) -> DataFrame:
    """Documents in a learned language: determined, familiar, and with a calibrated probability of `least` at least. Nulls of the column `into`
    become the language found.

    A text that mixes learned languages has a low probability for each, but is familiar. The model must have learned what is.
    """
    if model.languages and model.familiar is None:
        raise ValueError("train the model with familiar=True")
    names = {n: fresh(df, n) for n in ("lang_pred", "score", "familiarity")}
    own = [c for c in df.columns if c in names]
    found = predict(df.select("*", *[F.col(c).alias(fresh(df, "own") + c) for c in own]), model, text)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least) & (F.col("familiarity") >= model.least))
    as_given = {c: F.col(fresh(df, "own") + c if c in own else f"`{c}`") for c in df.columns}
    return kept.select(*[(F.coalesce(x, "lang_pred") if c == into else x).alias(c) for c, x in as_given.items()])
