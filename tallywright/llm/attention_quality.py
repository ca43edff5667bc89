"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by counts of its bytes, byte pairs and repeated words; gated attention,
learned from labels of whole documents, weighs the passages; the weighted mean of their representations gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import held_out

#: A passage is so many bytes; the last of a document may be shorter.
PASSAGE_BYTES = 512
PAIR_BUCKETS = 256
SMOOTH = 64
HIDDEN, ATTENTION = 24, 12

#: Learning looks at so many documents of each label at most, and at so many passages of each (hashes pick both); it leaves out no
#: document for its length. Scoring looks at all passages of all documents.
SAMPLE_DOCS, SAMPLE_PASSAGES = 1200, 32
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.004, 1e-4, 7

#: Bytes of text that are encoded at a time, but for a longer document's own.
CHUNK_BYTES = 2 << 20


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and each document's number of passages; an empty text is one passage of zeros."""
    counts = np.array([max(1, -(-len(t) // PASSAGE_BYTES)) for t in texts])
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    first = np.cumsum(counts) - counts
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + inside // PASSAGE_BYTES
    n = int(counts.sum())
    single = np.bincount(passage * 256 + data, minlength=n * 256).reshape(n, 256)
    pair = (data[1:].astype(np.uint32) * 31 + data[:-1].astype(np.uint32) * 131) % PAIR_BUCKETS
    together = passage[1:] == passage[:-1]
    double = np.bincount(passage[1:][together] * PAIR_BUCKETS + pair[together], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
    length = np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
    smooth = length + SMOOTH  # so that chance counts of a few bytes don't stand out
    varied = (single > 0).sum(axis=1, keepdims=True) / 64
    repeated = np.sqrt((double.astype(np.float64) ** 2).sum(axis=1, keepdims=True)) / smooth
    return np.hstack([np.sqrt(single / smooth), np.sqrt(double / smooth), varied, repeated, np.log2(length) / 9]).astype(np.float32), counts


@dataclass
class Model:
    """Encoder (w, b), gated attention (v, u, a) and classifier (c, d), after features are centred and scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @cached_property
    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        w = (self.weights["w"] / self.scale[:, None]).astype(np.float32)
        return w, (self.weights["b"] - self.mean @ w).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        features, counts = encode(texts)
        w, b = self.folded
        h = np.tanh(features @ w + b)
        return _pooled(h, counts, self.weights)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts, some megabytes at a time."""
        out, some, held = [], [], 0
        for t in texts:
            if some and held + len(t) > CHUNK_BYTES:
                out.append(self.score(some))
                some, held = [], 0
            some.append(t)
            held += len(t)
        return np.concatenate([*out, self.score(some)]) if some else np.zeros(0)


def _pooled(h: np.ndarray, counts: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Scores from passages' representations, and what the gradient needs."""
    starts = np.cumsum(counts) - counts
    gate, tone = 1 / (1 + np.exp(-(h @ p["u"]))), np.tanh(h @ p["v"])
    logit = (gate * tone) @ p["a"]
    weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
    weight /= np.repeat(np.add.reduceat(weight, starts), counts)
    pooled = np.add.reduceat(weight[:, None] * h, starts)
    return 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"], -30, 30))), pooled, weight, gate, tone, starts


def fit(texts: list[bytes], labels: np.ndarray, importance: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Gradient descent (Adam) on the weighted log loss of documents; runs on the driver, over the bounded sample."""
    features, counts = encode(texts)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 0.02
    x = (features - mean) / scale
    rng = np.random.default_rng(SEED)
    p = {"w": rng.normal(0, 0.5 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    first, step = np.cumsum(counts) - counts, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            n = counts[docs]
            rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            grad = _gradient(x[rows], n, labels[docs], importance[docs], p)
            step += 1
            for k, g in grad.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def _gradient(x: np.ndarray, n: np.ndarray, labels: np.ndarray, importance: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["w"] + p["b"])
    score, pooled, weight, gate, tone, starts = _pooled(h, n, p)
    e = (score - labels) * importance / len(n)
    d_pooled = np.repeat(e[:, None] * p["c"], n, axis=0)
    along = (d_pooled * h).sum(axis=1)
    d_logit = weight * (along - np.repeat(np.add.reduceat(weight * along, starts), n))
    d_mix = d_logit[:, None] * p["a"]
    d_gate, d_tone = d_mix * tone * gate * (1 - gate), d_mix * gate * (1 - tone**2)
    d_h = weight[:, None] * d_pooled + d_gate @ p["u"].T + d_tone @ p["v"].T
    d_in = d_h * (1 - h**2)
    return {"w": x.T @ d_in, "b": d_in.sum(axis=0), "u": h.T @ d_gate, "v": h.T @ d_tone, "a": (gate * tone).T @ d_logit, "c": pooled.T @ e, "d": e.sum(keepdims=True)}


def drawn_passages(text: Column, doc_id: Column, most: int = SAMPLE_PASSAGES) -> Column:
    """binary: a text's passages one after the other, all or the ``most`` that a hash picks, in their order."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.ceil(F.octet_length(raw) / PASSAGE_BYTES).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(doc_id, i).alias("at"), i.alias("i")))), 1, most)
    chosen = F.array_sort(F.transform(F.when(n > most, drawn).otherwise(F.transform(places, lambda i: F.struct(F.lit(0).cast("long").alias("at"), i.alias("i")))), lambda x: x["i"]))
    return F.aggregate(chosen, F.lit(b""), lambda out, i: F.concat(out, F.substring(raw, i * PASSAGE_BYTES + 1, F.lit(PASSAGE_BYTES))))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fits on docs (doc_id, text) joined to labels (doc_id, label_col 0 or 1) that aren't held out; null ids and labels teach nothing.

    A label's documents weigh as its share of all of them; of rows with one id the smallest bag counts; null texts count as empty.
    With one label only, or none, there is no model (None).
    """
    known = labels.where(~held_out()).where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (0, 1)]
    some = F.broadcast(drawn[0].union(drawn[1]))  # sample_docs rows a label at most, so no text is shuffled but theirs
    bags = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "label", drawn_passages(F.col("text"), F.col("doc_id")).alias("bag"))
    rows = bags.groupBy("doc_id", "label").agg(F.min("bag").alias("bag")).orderBy("doc_id", "label").collect()
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    share = {k: sizes[k] / sum(sizes.values()) / max(1, int((y == k).sum())) * len(y) for k in sizes}
    return fit([bytes(r.bag) for r in rows], y, np.array([share[int(k)] for k in y]))


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier of label 1) of the whole text. Null texts score as empty ones; without a model all score 0.5.

    Rows, repeated ones too, stay where they are; an empty table gives an empty result. A column named score is an error, so none is lost.
    """
    if "score" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column score already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series([0.5] * len(texts))
        return pd.Series(shared.value.scores([(t or "").encode() for t in texts]), dtype="float64")

    return docs.withColumn("score", of(F.col(text_col)))
