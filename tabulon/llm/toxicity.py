"""Toxicity by non-negative positive-unlabelled learning (operator 3).

Confirmed toxic texts are the positives; texts drawn from the corpus, whatever they are, the unlabelled set.
With class prior ``p`` the risk is ``p * R_pos(+1) + max(0, R_unl(-1) - p * R_pos(-1))``; where the second
part falls below zero its gradient is followed upwards instead, which keeps it from overfitting.  Features
are words and word beginnings that are clearly more frequent among the positives than in the corpus.

Only ids, feature hashes and the reduced sample reach the driver; texts are never collected.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Generations, held_out, lowest_by_hash, through_table, worker_state

#: Bounds of the sample that the classifier is fitted on: confirmed toxic, unlabelled and labelled rows.
MAX_POSITIVE, MAX_UNLABELLED, MAX_LABELLED = 4000, 12000, 6000
#: A feature is kept if its document frequency among the positives is this many standard errors above that in
#: the unlabelled set, met in at least so many of them and this share of them, and among the strongest so many.
MIN_Z, MIN_MET, MIN_SHARE, MAX_FEATURES = 5.0, 3, 0.02, 2048
#: Lengths of word beginnings that are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6)
MEMO = 400_000
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and its beginnings."""
    return [zlib.crc32(f"={word}".encode()), *(zlib.crc32(word[:n].encode()) for n in BEGINNINGS if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Linear scorer on ``log(1 + count)`` of its features and, last, of all words; the mean of its members."""

    features: list[int] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(1))
    cut: float = 0.0
    prior: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Mean margin of the members for rows of feature values."""
        return (x @ self.weights.T + self.biases).mean(axis=1)

    def score_column(self, text: Column) -> Column:
        """Score from 0 to 1 of each whole text; ``THRESHOLD`` is where the calibrated cut lies.  Null and empty
        texts score as texts without any feature; a model without features scores 0 everywhere."""
        from pyspark.sql.functions import arrow_udf

        slot = {f: i for i, f in enumerate(self.features)}
        weights, bias, cut = self.weights.mean(axis=0), float(self.biases.mean()), self.cut
        key, shift, known = hash((tuple(self.features), weights.tobytes())), math.log(THRESHOLD / (1 - THRESHOLD)), bool(slot)

        @arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            state = worker_state("toxicity")
            if state.get("key") != key:
                state.update(key=key, memo=Generations(lambda w: tuple(slot[f] for f in word_features(w) if f in slot), MEMO))
            memo = state["memo"]
            for batch in batches:
                out = []
                for t in batch.to_pylist():
                    words = WORDS((t or "").lower())
                    met = Counter(i for found in map(memo.__getitem__, words) if found for i in found)
                    z = bias + sum(weights[i] * math.log1p(n) for i, n in met.items()) + weights[-1] * math.log1p(len(words)) - cut + shift
                    out.append(1 / (1 + math.exp(-min(max(z, -60.0), 60.0))) if known else 0.0)
                yield pa.array(out, pa.float64())

        return score(text)


class Rows:
    """Feature rows held by their non-zero entries: few words of a text are features."""

    def __init__(self, x: np.ndarray):
        self.shape = x.shape
        self.row, self.col = np.nonzero(x)
        self.value = x[self.row, self.col].astype(float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam on all rows."""
    p, u = Rows(pos), Rows(unl)
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        # gradients of the mean logistic losses by the margin
        gp, gn, gu = (sigma(zp) - 1) / len(zp), sigma(zp) / len(zp), sigma(zu) / len(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            by_pos, by_unl = prior * (gp - gn), gu
        else:
            by_pos, by_unl = prior * gn, -gu
        grad = np.append(p.back(by_pos) + u.back(by_unl) + decay * w, by_pos.sum() + by_unl.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap at which F1 on labelled rows is highest."""
    order = np.argsort(-margin, kind="stable")
    z, y = margin[order], toxic[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # a cut never parts equal margins
    k = int(np.argmax(f1))
    return float(z[k] - 0.5 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
        members: int = 4, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
        max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on rows that are not held out (``common.held_out``), on the rows of lowest id hash up to the bounds.

    The class prior is the share of toxic among all labelled rows used.  Null labels and ids are passed over;
    several labels of one id count as its highest.  Without a confirmed toxic row the model has no features.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic"))
             .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    prior, confirmed = known.agg(F.avg("toxic"), F.sum("toxic")).first()
    if not confirmed:
        return ToxicityModel()
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).filter(F.col("id").isNotNull() & ~held_out("id"))
    part = lambda df, n, kind: lowest_by_hash(df.select("id"), "id", n).withColumn("kind", F.lit(kind))
    # at most 2 * max_labelled + ... ids, so the broadcast is bounded by the parameters
    chosen = (part(known.filter("toxic = 1"), max_positive, "p").unionByName(part(ids.distinct(), max_unlabelled, "u"))
              .unionByName(part(known.filter("toxic = 1"), max_labelled // 2, "1"))
              .unionByName(part(known.filter("toxic = 0"), max_labelled // 2, "0")))
    wanted = chosen.groupBy("id").agg(F.collect_set("kind").alias("kinds"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            met, n_words = [], []
            for t in batch.column(1).to_pylist():
                words = Counter(WORDS((t or "").lower()))
                found: Counter = Counter()
                for w, n in words.items():
                    for f in word_features(w):
                        found[f] += n
                met.append(list(found.items()))
                n_words.append(sum(words.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(met, pa.map_(pa.int64(), pa.int32())), pa.array(n_words, pa.int64()), batch.column(2)],
                ["kinds", "met", "n_words", "id"])

    sample = through_table(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(wanted), "id").select("kinds", "text", F.col("id").cast("long"))
        .mapInArrow(features, "kinds array<string>, met map<bigint,int>, n_words long, id long"), "toxicity_sample")
    n_p, n_u = sample.agg(*(F.sum(F.array_contains("kinds", k).cast("int")) for k in "pu")).first()
    if not n_p or not n_u:
        return ToxicityModel()
    met = sample.select("kinds", F.explode(F.map_keys("met")).alias("f")).groupBy("f").agg(
        *(F.sum(F.array_contains("kinds", k).cast("int")).alias(k) for k in "pu"))
    share = (F.col("u") + 1) / F.lit(n_u + 2)
    z = (F.col("p") / F.lit(n_p) - share) / F.sqrt(share * (1 - share) / F.lit(n_p))
    top = (met.withColumn("z", z).filter((F.col("z") >= MIN_Z) & (F.col("p") >= max(MIN_MET, MIN_SHARE * n_p)))
           .orderBy(F.desc("z"), "f").limit(MAX_FEATURES).select("f").collect())
    feats = [r["f"] for r in top]
    if not feats:
        return ToxicityModel(prior=prior)
    slot = {f: i for i, f in enumerate(feats)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            values = []
            for met in batch.column(1).to_pylist():
                values.append([y for f, n in sorted(met) if f in slot for y in (slot[f], n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int32())), batch.column(2), batch.column(3)],
                                             ["kinds", "met", "n_words", "id"])

    # at most the sample's rows, each with its hits among the features
    rows = sample.mapInArrow(reduce, "kinds array<string>, met array<int>, n_words long, id long").collect()
    rows.sort(key=lambda r: (r["id"], r["n_words"], r["met"]))  # the fit doesn't depend on partitions
    x = np.zeros((len(rows), len(feats) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, -1] = math.log1p(r["n_words"])
        x[i, r["met"][0::2]] = np.log1p(r["met"][1::2])
    kind = {k: np.array([k in r["kinds"] for r in rows]) for k in "pu01"}
    rng = np.random.default_rng(0)
    fits = []
    for _ in range(members):
        half = lambda rows: rows[rng.permutation(len(rows))[: max(1, len(rows) * 3 // 4)]]
        fits.append(nn_pu(half(x[kind["p"]]), half(x[kind["u"]]), prior))
    model = ToxicityModel(feats, np.array([w for w, _ in fits]), np.array([b for _, b in fits]), 0.0, prior)
    judged = kind["0"] | kind["1"]
    model.cut = _cut(model.margins(x[judged]), kind["1"][judged].astype(float)) if kind["0"].any() else 0.0
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the model's score in column ``out`` (replaced if it is there)."""
    return docs.withColumn(out, model.score_column(F.col(f"`{text_col}`")))
