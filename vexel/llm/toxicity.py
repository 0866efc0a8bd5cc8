"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A text is a bag of sentences. Sentence j scores s_j = sigmoid(bias + sum of its features' weights); the text scores
1 - prod(1 - s_j). Only texts carry labels; the gradient of the text's loss reaches each sentence through the noisy-or,
so the weights come to rest on the sentences that make a text toxic, which are reported with their places.

Features of a sentence: its distinct words and their first 4, 5 and 6 bytes, A-Z lower-cased. Those are kept that
`least` toxic training texts hold and that are `lift` times as frequent among toxic ones. Training uses at most `sample`
labelled texts and `sample_bytes` of them, the first by a hash of their ids (a single text beyond `sample_bytes` is not
among them); one task reads them and fits, and the driver sees the model alone. Scoring reads every sentence of every
text. There, sentences without a kept feature contribute nothing, so that no text is called toxic for its length.

Null or empty texts have no sentence and score 0. A null id is not held out. Labels that are null are not used; of several
for one id, the highest. Without labels of both kinds every text scores 0. Repeated rows are each reported; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import Points, Words, mix, raw, runs

#: Labelled texts that training reads at most, and their bytes.
SAMPLE, SAMPLE_BYTES = 12_000, 128 << 20
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
_BITS = 20
#: Bits of the first, coarse count of features.
_COARSE = 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Bags:
    """Features of texts: `feature` (64 bits) with the number of its sentence; `text` of each sentence with words.

    known: only these features (sorted) are kept, by their number in it."""

    def __init__(self, texts: list[bytes], known: np.ndarray | None = None, bits: np.ndarray | None = None):
        w = Words(texts, _TABLE)
        a = np.frombuffer(b" " + b".".join(texts) + b".", np.uint8)
        self.words, counts = w, w.counts()
        ends = np.cumsum(_ENDS[a], dtype=np.int32)[w.start] if len(w.start) else np.empty(0, np.int32)
        new = np.concatenate([[True], ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, bool)
        sentence = np.cumsum(new) - 1
        self.first_word = np.flatnonzero(new)
        self.text = np.repeat(np.arange(len(texts)), counts)[self.first_word]
        eight = np.ndarray((len(w.buffer) - 7,), "<u8", w.buffer, 0, (1,))[w.start]
        size = w.end - w.start
        made = [(w.hashes(), None)]
        for k in PREFIXES:
            ok = np.flatnonzero(size >= k)
            made.append((mix((eight[ok] & np.uint64((1 << 8 * k) - 1)) ^ np.uint64(k << 56)), ok))
        feats, where = [], []
        for f, ok in made:
            if known is not None:
                hit = np.flatnonzero(bits[f >> np.uint64(64 - _BITS)])
                at = np.minimum(np.searchsorted(known, f[hit]), max(0, len(known) - 1))
                hit, at = (hit[known[at] == f[hit]], at[known[at] == f[hit]]) if len(known) else (hit[:0], at[:0])
                f, ok = at, hit if ok is None else ok[hit]
            feats.append(f)
            where.append(sentence if ok is None else sentence[ok])
        f, s = np.concatenate(feats), np.concatenate(where)
        o = np.lexsort((f, s))
        f, s = f[o], s[o]
        once = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]) if len(f) else np.empty(0, bool)
        self.feature, self.sentence = f[once], s[once]

    def spans(self, sentences: list[int]) -> list[tuple[int, int]]:
        """First and last byte in the joined buffer of each sentence."""
        last = np.append(self.first_word[1:], len(self.words.start)) - 1
        return [(int(self.words.start[self.first_word[j]]), int(self.words.end[last[j]])) for j in sentences]


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """log(1 - score) of each text, from its sentences' logits."""
    return np.bincount(text, -np.logaddexp(0, z), n)


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.known >> np.uint64(64 - _BITS)] = True

    def logits(self, bags: Bags) -> np.ndarray:
        """Of each sentence; those without a feature have none (minus infinity)."""
        z = np.full(len(bags.text), -np.inf)
        live = np.unique(bags.sentence)
        if len(live):
            z[live] = self.bias + np.bincount(bags.sentence, self.weights[bags.feature], len(z))[live]
        return z

    def score(self, texts: list[bytes], offending: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and for each text its sentences that score `offending` at least: code points and score."""
        bags = Bags(texts, self.known, self.bits)
        z = self.logits(bags)
        scores = -np.expm1(noisy_or(z, bags.text, len(texts))) if len(z) else np.zeros(len(texts))
        places: list[list[dict]] = [[] for _ in texts]
        bad = np.flatnonzero(z >= np.log(offending / (1 - offending))).tolist()
        starts = np.concatenate([[1], 1 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        d, point = -1, None
        for j, (a, b) in zip(bad, bags.spans(bad), strict=True):
            if d != int(bags.text[j]):
                d = int(bags.text[j])
                point = Points(texts[d])
            places[d].append({"start": point(a - int(starts[d])), "stop": point(b - int(starts[d])), "score": float(1 / (1 + np.exp(-z[j])))})
        return np.clip(scores, 0, 1), places


def _held(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text)."""
    b = Bags(texts)
    f, d = b.feature, b.text[b.sentence] if len(b.feature) else np.empty(0, np.int64)
    o = np.lexsort((d, f))
    f, d = f[o], d[o]
    once = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])]) if len(f) else np.empty(0, bool)
    return f[once], d[once]


def fit(texts: list[bytes], labels: np.ndarray, least: int = 4, lift: float = 3.0, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    nothing = Model(np.empty(0, np.uint64), np.empty(0), -20.0)
    if not (0 < labels.sum() < len(labels)):
        return nothing
    parts = [texts[i : i + 200] for i in range(0, len(texts), 200)]
    base = np.cumsum([0, *map(len, parts)])
    # how many toxic and other texts hold each feature: toxic ones first by a hash of the feature, in fixed memory, then
    # exactly, and part by part, for features whose hash may do
    low = lambda f: (f & np.uint64((1 << _COARSE) - 1)).astype(np.int64)
    coarse = np.zeros(1 << _COARSE, np.int32)
    for p, at in zip(parts, base, strict=False):
        f, of = _held(p)
        coarse += np.bincount(low(f[labels[of + at] == 1]), minlength=1 << _COARSE).astype(np.int32)
    known, toxic, other = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    for p, at in zip(parts, base, strict=False):
        f, of = _held(p)
        ok = coarse[low(f)] >= least
        f, y = f[ok], labels[of[ok] + at]
        known, which = np.unique(np.concatenate([known, f]), return_inverse=True)
        toxic = np.bincount(which, np.concatenate([toxic, y]), len(known))
        other = np.bincount(which, np.concatenate([other, 1 - y]), len(known))
    rate_t, rate_c = (toxic + 0.5) / (labels.sum() + 1), (other + 0.5) / (len(labels) - labels.sum() + 1)
    keep = (toxic >= least) & (rate_t >= lift * rate_c)
    model = Model(known[keep], np.zeros(int(keep.sum())), -6.0)
    text, sentence, feat, n = [], [], [], 0
    for p, at in zip(parts, base, strict=False):
        b = Bags(p, model.known, model.bits)
        text.append((b.text + at).astype(np.int32))
        sentence.append((b.sentence + n).astype(np.int32))
        feat.append(b.feature.astype(np.int32))
        n += len(b.text)
    text, sentence, feat = map(np.concatenate, (text, sentence, feat))
    # sentences without a feature differ in nothing but their text
    live = np.unique(sentence)
    plain = np.bincount(text, minlength=len(texts)) - np.bincount(text[live], minlength=len(texts))
    text, sentence = text[live], np.searchsorted(live, sentence)
    model.weights += 1.0
    m, v, mb, vb = np.zeros_like(model.weights), np.zeros_like(model.weights), 0.0, 0.0
    for step in range(1, steps + 1):
        _, g, gb = slope(model.weights, model.bias, text, sentence, feat, plain, labels, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        model.weights = model.weights - rate * (m / a) / (np.sqrt(v / c) + 1e-12)
        model.bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-12)
    return model


def slope(weights: np.ndarray, bias: float, text: np.ndarray, sentence: np.ndarray, feat: np.ndarray, plain: np.ndarray, labels: np.ndarray, decay: float) -> tuple[float, np.ndarray, float]:
    """The mean loss of the texts' labels with its slopes by weights and bias. text: of each sentence that has features;
    sentence, feat: each feature's; plain: how many sentences without features a text has."""
    n = len(labels)
    z = bias + np.bincount(sentence, weights[feat], len(text))
    s, s0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
    rest = np.minimum(noisy_or(z, text, n) + plain * np.log1p(-s0), -1e-12)
    loss = -np.where(labels == 1, np.log(-np.expm1(rest)), rest).sum() / n + decay * (weights**2).sum() / 2 / n
    pull = np.where(labels == 1, -np.exp(rest) / -np.expm1(rest), 1.0) / n
    gz = pull[text] * s
    return loss, np.bincount(feat, gz[sentence], len(weights)) + decay * weights / n, gz.sum() + (pull * plain).sum() * s0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """From labelled rows outside the held-out quarter."""
    order = [F.xxhash64("_id"), F.col("_id")]
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("_y")).orderBy(*order).limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    got = texts.join(F.broadcast(rows), "_id").groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    upto = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = got.filter(size <= sample_bytes).withColumn("_upto", upto).filter(F.col("_upto") <= sample_bytes).select("_y", "_text")

    def work(batches):
        held, y = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            held += raw(b.column(1))
        m = fit(held, np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.known.astype("<u8").tobytes()]), pa.array([m.weights.astype("<f8").tobytes()]), pa.array([float(m.bias)])], names=["known", "weights", "bias"])

    r = got.mapInArrow(work, "known binary, weights binary, bias double").first()  # the window has made it one task
    return fit([], np.empty(0, np.int64)) if r is None else Model(np.frombuffer(r.known, "<u8"), np.frombuffer(r.weights, "<f8"), r.bias)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, sentences (start, stop, score of the offending ones): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def work(batches):
        for big in batches:
            for b in runs(big, 1):
                scores, places = shared.value.score(raw(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(scores, 9)), pa.array(places, pa.list_(place))], names=["doc_id", "score", "sentences"])

    docs = docs.select(F.col(id_col).alias("doc_id"), text_col)
    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<start: bigint, stop: bigint, score: double>>")


def digest(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_sentences"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score under the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        for big in batches:
            for b in runs(big, at):
                yield b.filter(pa.array(shared.value.score(raw(b.column(at)))[0] < threshold))

    return docs.mapInArrow(work, docs.schema)
