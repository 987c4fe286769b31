"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of hashed words and beginnings of words (of
4 to 8 bytes) is trained from confirmed toxic documents (P) and unlabelled
ones (U) by the risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose second term, an estimate of the risk on clean text, can't truly be
negative; where a batch has it below zero, the step goes the other way.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .features import first_ids, joined, matching, sum_by, train_in_one_task

BITS = 22
BUCKETS = 1 << BITS
BEGINNINGS = (4, 5, 6, 7, 8)


def present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each distinct word, and of each distinct beginning of a longer word."""
    words = kit.Words(texts)
    h, doc = [words.hash], [words.doc]
    for k in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > k)
        h.append(words.beginning(k, long) * kit.SALTS[k])
        doc.append(words.doc[long])
    key = np.unique((np.concatenate(doc) << BITS) | (np.concatenate(h) >> kit.U64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & (BUCKETS - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(positive: np.ndarray, doc: np.ndarray, idx: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.05, sparsity: float = 2e-3, false_alarm_cost: float = 6.0, least_docs: int = 8, seed: int = 3) -> dict:
    """The model from texts' word buckets, and the threshold; positive says which texts are confirmed. Buckets in fewer than least_docs texts get no weight, nor do those whose gradient stays within sparsity.

    A sixth of the texts is held out for the threshold, which minimises the
    same risk in counts: prior * (missed confirmed) + false_alarm_cost *
    max(0, unlabelled above - prior * confirmed above); of equals, the highest.
    It is at least midway from the intercept, the score of a text without
    evidence, to the score that all but a fiftieth of the confirmed exceed.
    """
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(np.bincount(idx, minlength=BUCKETS) >= least_docs)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[idx] >= 0
    doc, col = doc[keep], place[idx[keep]]
    at = np.searchsorted(doc, np.arange(len(positive) + 1))
    w, b = np.zeros(len(used)), -1.0
    seen, seen_b = np.full(len(used), 1e-2), 1e-2
    p, u = rng.permutation(np.flatnonzero(positive)), rng.permutation(np.flatnonzero(~positive))
    held_p, p, held_u, u = p[: len(p) // 6], p[len(p) // 6 :], u[: len(u) // 6], u[len(u) // 6 :]
    steps = max(1, max(len(p), len(u)) // 256)

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = np.concatenate([np.arange(at[i], at[i + 1]) for i in which])
        return np.repeat(np.arange(len(which)), at[which + 1] - at[which]), col[take]

    for _ in range(epochs):
        for bp, bu in zip(np.array_split(rng.permutation(p), steps) if len(p) >= steps else [rng.choice(p, 1) for _ in range(steps)], np.array_split(rng.permutation(u), steps), strict=True):
            dp, cp = rows(bp)
            du, cu = rows(bu)
            fp, fu = sum_by(dp, w[cp], len(bp)) + b, sum_by(du, w[cu], len(bu)) + b
            clean_risk = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
            plus, minus_p, minus_u = -prior * sigmoid(-fp) / len(bp), -prior * sigmoid(fp) / len(bp), sigmoid(fu) / len(bu)
            gp, gu = (plus + minus_p, minus_u) if clean_risk >= 0 else (-minus_p, -minus_u)
            g = np.bincount(cp, gp[dp], len(w)) + np.bincount(cu, gu[du], len(w))
            gb = gp.sum() + gu.sum()
            seen += g**2
            seen_b += gb**2
            step = rate / np.sqrt(seen)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
            b -= rate * gb / np.sqrt(seen_b)
    out = sum_by(doc, w[col], len(positive)) + b
    threshold = 0.0
    if len(held_p) and len(held_u):
        tries = np.linspace(min(out[held_p].min(), out[held_u].min()), out[held_p].max(), 400)
        above = lambda rows: (out[rows][:, None] >= tries).mean(0)
        risk = prior * (1 - above(held_p)) + false_alarm_cost * np.maximum(0, above(held_u) - prior * above(held_p))
        best = np.flatnonzero(risk <= risk.min() + 1e-9)
        threshold = max(tries[best[-1]], (b + max(b, np.quantile(out[held_p], 0.02))) / 2 + 1e-3)
    at = np.flatnonzero(w)
    return {"at": used[at], "w": w[at].astype(np.float32), "b": float(b), "threshold": float(threshold)}


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 12000, seed: int = 3) -> dict | None:
    """The model; None without confirmed toxic texts or without others.

    P: documents labelled toxic = 1, at most max_positive. U: documents that
    aren't, at most max_unlabelled. Both are evenly drawn by the hash of
    doc_id, and each text counts once. prior: the share of toxic documents in
    U; None takes their share of all labelled documents.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") >= 1).alias("p"))
    if prior is None:
        row = known.agg(F.avg(F.col("p").cast("double")).alias("m")).first()
        prior = row.m
    if not prior:
        return None
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    toxic = known.filter("p").select("doc_id")
    ids = first_ids(toxic, max_positive, seed).withColumn("p", F.lit(True)).unionByName(first_ids(slim, max_unlabelled, seed, toxic).withColumn("p", F.lit(False)))

    def rows(batches):
        for b in kit.slices(batches):
            doc, idx = present(b.column("text"))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("p"), kit.binary([idx[at[k] : at[k + 1]].astype(np.int32) for k in range(b.num_rows)])], ["p", "idx"])

    def fit(t: pa.Table) -> pa.Table:
        sets: dict[bytes, bool] = {}
        for p, x in zip(t.column("p").to_pylist(), t.column("idx").to_pylist(), strict=True):
            sets[x] = sets.get(x, False) or p
        names = sorted(sets)
        positive = np.array([sets[x] for x in names], bool)
        if not positive.any() or positive.all():
            return pa.table({"model": [pickle.dumps(None)]})
        idx, doc = joined(names, np.int32)
        return pa.table({"model": [pickle.dumps(fit_nnpu(positive, doc, idx, prior, seed=seed))]})

    row = train_in_one_task(matching(slim, ids).select("p", "text").mapInArrow(kit.batchwise(rows), "p boolean, idx binary"), fit, "model binary")
    return pickle.loads(row.model) if row else None


def dense(model: dict) -> np.ndarray:
    w = np.zeros(BUCKETS, np.float32)
    w[model["at"]] = model["w"]
    return w


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, toxicity (0.5 at the threshold) and toxic of every row of docs.

    Null text: null toxicity, not toxic. Empty text: the model's intercept.
    Very long texts are scored whole. Null doc_id: scored, with null doc_id,
    but no example. Repeated rows and ties are scored alike. Without confirmed examples
    nothing is learnt: null toxicity, none toxic. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        model = shared.value
        w = dense(model) if model else None
        for b in kit.slices(batches):
            none = pc.is_null(b.column("text")).to_numpy(zero_copy_only=False) | (model is None)
            p = np.zeros(b.num_rows)
            if model:
                doc, idx = present(b.column("text"))
                p = sigmoid(sum_by(doc, w[idx], b.num_rows) + model["b"] - model["threshold"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, mask=none), pa.array((p >= 0.5) & ~none)], ["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kit.batchwise(run), "doc_id long, toxicity double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of score() that are toxic."""
    return score(docs, labels, **options).filter("toxic")
