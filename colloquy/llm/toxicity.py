"""Toxicity of whole texts: logistic regression over hashed word n-grams, learned by FTRL-proximal.

Features are a text's distinct words, word pairs, pairs with one word between, and triples,
each hashed to a slot. Every slot has a learning rate of its own, and the L1 term keeps all but
the telling slots at exactly zero, so that what is broadcast is a short list of (slot, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import hashed_span, materialise, small

SLOTS = 1 << 20
#: Most training documents with label 1 and with label 0, and most characters of one: what the driver may hold.
SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 6_000
SAMPLE_CHARS = 12_000
#: Values of the hash that chooses them.
HASHES = 1 << 40
#: Bytes that are hashed at a time.
SLICE_BYTES = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = [np.uint64(k) for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
#: Bytes of words: digits, letters, and all of a character outside ASCII.
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyz'", *range(128, 256)]] = True


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams with repeats, and the text that each belongs to, in no special order."""
    joined = b"\n".join([t.lower().encode("utf-8", "surrogatepass") for t in texts] + [b""])
    data = np.frombuffer(b"\n" + joined, np.uint8)
    lengths = [len(t.lower().encode("utf-8", "surrogatepass")) + 1 for t in texts]
    inside = _WORD_BYTES[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * power[:n])])
    # Dividing by the power at the word's start makes the hash one of its letters alone.
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
    word = (sums[end] - sums[start]) * back[start]
    word = (word ^ (word >> np.uint64(32))) * _MIX[0]
    owner = np.searchsorted(np.cumsum([1, *lengths]), start, side="right") - 1
    found, owners = [word], [owner]
    for gap in (1, 2):
        if len(word) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = word[:-gap] * _MIX[gap] + (word[gap:] ^ (word[gap:] >> np.uint64(29)))
            if gap == 2:
                found.append((pair * _P + word[1:-1])[same])
                owners.append(owner[gap:][same])
            found.append(pair[same])
            owners.append(owner[gap:][same])
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(31))) * _MIX[3]
    return (h >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64), np.concatenate(owners)


@dataclass
class ToxicityModel:
    """Bias, and the slots whose weight is not zero."""

    bias: float
    slot: np.ndarray
    weight: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; an empty text has that of the bias alone."""
        margins = np.full(len(texts), self.bias)
        if len(self.slot):
            table = np.zeros(SLOTS, np.int32)
            table[self.slot] = np.arange(1, len(self.slot) + 1)
            i = 0
            while i < len(texts):
                stop, size = i + 1, len(texts[i])
                while stop < len(texts) and size + len(texts[stop]) <= SLICE_BYTES // 2:
                    size += len(texts[stop])
                    stop += 1
                slot, owner = slots(texts[i:stop])
                rank = table[slot]
                told = rank > 0
                # Only telling slots are made distinct within a text.
                keys = np.unique(owner[told] * (len(self.slot) + 1) + rank[told])
                margins[i:stop] += np.bincount(keys // (len(self.slot) + 1), self.weight[keys % (len(self.slot) + 1) - 1], stop - i)
                i = stop
        return 1 / (1 + np.exp(-np.clip(margins, -35, 35)))


def train(sample: list[tuple[int, str]], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0, seed: int = 3) -> ToxicityModel:
    """FTRL-proximal over (label, text); no rows give a model that says one half."""
    if not sample:
        return ToxicityModel(0.0, np.zeros(0, np.int64), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(0, len(sample), 200):
        slot, owner = slots([text for _, text in sample[i : i + 200]])
        keys = np.unique(owner * SLOTS + slot)
        cuts = np.searchsorted(keys, np.arange(len(sample[i : i + 200]) + 1) * SLOTS)
        keys = (keys % SLOTS).astype(np.int32)
        rows += [keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    labels = np.array([label for label, _ in sample], float)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = np.where(at == SLOTS, 0.0, l1)  # the bias isn't shrunk
        return np.where(np.abs(z[at]) <= own, 0.0, (np.sign(z[at]) * own - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], SLOTS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(SLOTS + 1))
    kept = np.flatnonzero(every[:-1])
    return ToxicityModel(float(every[-1]), kept, every[kept])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_toxic: int, most_clean: int, most_chars: int) -> list[tuple[int, str]]:
    """A bounded sample of the labelled documents: of each label those of least hashed id, a span of each text.

    Labels are joined to the documents' ids before anything is chosen, so labels of other
    documents take no place. Only ids are shuffled; texts are read once, those of the chosen ids.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).where(F.col("k").isNotNull())
    # A merge join: ids take little room in files, by which Spark would size what it broadcasts.
    ids = materialise(own.select("k").distinct().join(known.hint("merge"), "k").withColumn("h", F.pmod(F.xxhash64("k"), F.lit(HASHES))))
    # The labels' counts say how small a hash has to be to come into question, so that few rows are ranked.
    wanted = F.lit(False)
    most = {1: most_toxic, 0: most_clean}
    for label, n in ids.groupBy("label").count().collect():
        below = HASHES if n <= 8 * most[label] else -(-HASHES * 4 * most[label] // n)
        wanted = wanted | ((F.col("label") == label) & (F.col("h") < below))
    ranked = Window.partitionBy("label").orderBy("h", "k")
    enough = F.when(F.col("label") == 1, most_toxic).otherwise(most_clean)
    chosen = ids.where(wanted).withColumn("rank", F.row_number().over(ranked)).where((F.col("rank") <= max(most.values())) & (F.col("rank") <= enough)).select("k", "label")
    # At most most_toxic + most_clean rows of two numbers; a repeated id counts once.
    rows = own.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "k").groupBy("k", "label").agg(F.min(hashed_span("text", most_chars, "k")).alias("text"))
    return [(r.label, r.text) for r in sorted(rows.collect(), key=lambda r: (-r.label, str(r.k)))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN, most_chars: int = SAMPLE_CHARS, **options) -> ToxicityModel:
    """Learn from a bounded sample of the labelled rows.

    Texts of all lengths come in alike; of one with more than ``most_chars`` characters a span of
    so many is learned from, which begins anywhere, by hash. Null or missing labels, ids and texts
    teach nothing, though a null text may take a place in the sample; an id labelled more than once
    counts once, as toxic if any of its labels is.
    """
    return train(training_sample(docs, labels, id_col, text_col, label_col, most_toxic, most_clean, most_chars), **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, score, predicted), one for each row of ``docs``; the text is all that is looked at.

    Null texts count as empty and get the score of the bias. Map-only: repeated rows and null ids
    need no care; memory grows with the longest text, not with the number of rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold.

    Null text counts as empty; it has the score of a text without features. Rows are judged one by
    one: repeated ones share their fate, ids are not looked at, and an empty table gives no rows.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(shared.value.score([t or "" for t in batch.column(place).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
