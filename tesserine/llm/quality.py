"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is all pairwise interactions of rank `factors` in time linear in the
number of features. It is fitted by AdaGrad on at most max_rows labelled
documents, in one executor task; every document is then scored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .features import BUCKETS, STATS, first_ids, flat, matching, split_rows, structure, sum_by, train_in_one_task, word_counts

META = 1 << 10
SIZE = BUCKETS + META + len(STATS)


def featurise(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """doc, index and value of the sparse features, the structure statistics, and the number of texts."""
    raw, off = kit.string_bytes(batch.column("text"))
    words = kit.Words(batch.column("text"))
    n = words.n
    doc, idx, count = word_counts(words)
    norm = np.sqrt(np.bincount(doc, count.astype(np.float64) ** 2, n))
    val = (count / norm[doc]).astype(np.float32)
    meta = []
    for c in ("source", "lang"):
        codes = pc.fill_null(batch.column(c), "").dictionary_encode()
        names = np.array([hash_text(f"{c}={x}") % META for x in codes.dictionary.to_pylist()], np.int64)
        meta.append(BUCKETS + names[codes.indices.to_numpy(zero_copy_only=False)])
    ids = np.arange(n)
    doc, idx, val = np.concatenate([doc, ids, ids]), np.concatenate([idx, *meta]), np.concatenate([val, np.full(2 * n, 0.3, np.float32)])
    order = np.argsort(doc, kind="stable")
    return doc[order], idx[order].astype(np.int32), val[order], structure(raw, off, words, np.bincount(word_counts_doc(doc, idx), minlength=n)), n


def word_counts_doc(doc: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return doc[idx < BUCKETS]


def hash_text(s: str) -> int:
    h = 1469598103934665603
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return h >> 20


def with_stats(doc: np.ndarray, idx: np.ndarray, val: np.ndarray, stats: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features with the standardised statistics put at each text's end."""
    n, k = stats.shape
    z = np.clip((stats - model["mean"]) / model["sd"], -4, 4).astype(np.float32) / 2
    doc = np.concatenate([doc, np.repeat(np.arange(n), k)])
    idx = np.concatenate([idx, np.tile(np.arange(BUCKETS + META, SIZE, dtype=np.int32), n)])
    val = np.concatenate([val, z.ravel()])
    order = np.argsort(doc, kind="stable")
    return doc[order], idx[order], val[order]


def raw_scores(model: dict, doc: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    """y(x) of n texts."""
    vx = model["v"][idx] * val[:, None]
    sums = sum_by(doc, vx, n)
    squares = sum_by(doc, (vx * vx).sum(1), n)
    return model["w0"] + sum_by(doc, model["w"][idx] * val, n) + 0.5 * ((sums**2).sum(1) - squares)


def fit_machine(y: np.ndarray, doc: np.ndarray, idx: np.ndarray, val: np.ndarray, stats: np.ndarray, factors: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, loss_of_good: float = 0.002, seed: int = 5) -> dict:
    """The model. A fifth of the rows is held out and sets the threshold, at which no more than loss_of_good of the good rows go, 0.5 at most."""
    rng = np.random.default_rng(seed)
    n = len(y)
    model = {"w0": 0.0, "w": np.zeros(SIZE, np.float32), "v": rng.normal(0, 0.02, (SIZE, factors)).astype(np.float32), "mean": stats.mean(0), "sd": stats.std(0) + 1e-3}
    doc, idx, val = with_stats(doc, idx, val, stats, model)
    at = split_rows(doc, n)
    held = rng.permutation(n)
    held, own = held[: n // 5], held[n // 5 :]
    good = y[own].mean()
    weight = np.where(y > 0, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3))
    seen_w, seen_v, seen_0 = np.full(SIZE, 1e-6), np.full((SIZE, factors), 1e-6), 1e-6

    def rows_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        take = np.concatenate([np.arange(at[i], at[i + 1]) for i in which]) if len(which) else np.empty(0, np.int64)
        return np.repeat(np.arange(len(which)), at[which + 1] - at[which]), idx[take], val[take]

    for _ in range(epochs):
        rng.shuffle(own)
        for b in np.array_split(own, max(1, len(own) // 128)):
            d, i, x = rows_of(b)
            vx = model["v"][i] * x[:, None]
            sums = sum_by(d, vx, len(b))
            out = model["w0"] + sum_by(d, model["w"][i] * x, len(b)) + 0.5 * ((sums**2).sum(1) - sum_by(d, (vx * vx).sum(1), len(b)))
            g = weight[b] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[b]) / len(b) * 8
            used, inv = np.unique(i, return_inverse=True)
            gx = g[d] * x
            gw = np.bincount(inv, gx) + decay * model["w"][used]
            gv = np.stack([np.bincount(inv, gx * (sums[d, f] - vx[:, f])) for f in range(factors)], 1) + decay * model["v"][used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_0 += g.sum() ** 2
            model["w"][used] -= (rate * gw / np.sqrt(seen_w[used])).astype(np.float32)
            model["v"][used] -= (rate / 4 * gv / np.sqrt(seen_v[used])).astype(np.float32)
            model["w0"] -= float(rate * g.sum() / np.sqrt(seen_0))
    p = 1 / (1 + np.exp(-np.clip(raw_scores(model, *rows_of(held), len(held)), -30, 30)))
    kept = p[y[held] > 0]
    model["threshold"] = float(min(0.5, np.quantile(kept, loss_of_good))) if len(kept) else 0.5
    model["held_out_accuracy"] = float(np.mean((p >= model["threshold"]) == (y[held] > 0))) if len(held) else float("nan")
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, seed: int = 5) -> dict | None:
    """The model from labels(doc_id, quality), 1 good and 0 bad; None where no labelled document has a text.

    max_rows bounds the labelled documents that are used, evenly drawn by the
    hash of doc_id. Labels that contradict each other: the mean, rounded up.
    """
    given = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"))
    ids = given.join(F.broadcast(first_ids(given, max_rows, seed)), "doc_id")

    def rows(batches):
        for b in kit.slices(batches):
            doc, idx, val, stats, n = featurise(b)
            at = split_rows(doc, n)
            own = kit.binary([idx[at[k] : at[k + 1]] for k in range(n)])
            key = pa.array([zlib.crc32(x.as_buffer()) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("y"), key, own, kit.binary([val[at[k] : at[k + 1]] for k in range(n)]), kit.binary(list(stats))], ["y", "key", "idx", "val", "stats"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column("key").to_numpy(), t.column("y").to_numpy()))))  # the order in which rows come doesn't matter
        idx, doc = flat(t.column("idx"), np.int32)
        val, _ = flat(t.column("val"), np.float32)
        stats = flat(t.column("stats"), np.float32)[0].reshape(t.num_rows, -1)
        return pa.table({"model": [pickle.dumps(fit_machine(t.column("y").to_numpy().astype(float), doc, idx, val, stats, seed=seed))]})

    sample = matching(prepared(docs).filter("text is not null"), ids.select("doc_id", "y")).select("doc_id", "text", "source", "lang", "y")
    row = train_in_one_task(sample.mapInArrow(kit.batchwise(rows), "y int, key long, idx binary, val binary, stats binary"), fit, "model binary")
    return pickle.loads(row.model) if row else None


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and lang of docs by their own types; a column that is missing is null."""
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string"), ("lang", "string"))))


def probabilities(b: pa.RecordBatch, model: dict) -> np.ndarray:
    """Of each text, the probability that it is good."""
    doc, idx, val, stats, n = featurise(b)
    return 1 / (1 + np.exp(-np.clip(raw_scores(model, *with_stats(doc, idx, val, stats, model), n), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, quality_score and kept of every row of docs.

    Null text: null score, not kept. Empty text: scored by its metadata and
    structure. Very long texts are scored whole. Null doc_id: scored, with
    null doc_id, but no example. Null source or lang: as the empty name. Repeated rows and tied
    scores are scored alike. Without labelled texts nothing is learnt: null
    scores, all rows with a text kept. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = train(docs, labels, **options)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in kit.slices(batches):
            null = pc.is_null(b.column("text")).to_numpy(zero_copy_only=False)
            p = probabilities(b, model) if model else np.zeros(b.num_rows)
            keep = ~null & ((p >= model["threshold"]) if model else True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, mask=null | (model is None)), pa.array(keep)], ["doc_id", "quality_score", "kept"])

    return prepared(docs).mapInArrow(kit.batchwise(run), "doc_id long, quality_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns; one pass and no join.

    Null texts go; empty and very long texts, null doc_id, source or lang,
    ties and repeated rows as in score(). Without labelled texts all rows with
    a text stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        model = shared.value
        for b in kit.slices(batches):
            text = pc.cast(b.column("text"), pa.string())
            names = b.schema.names
            own = lambda c: pc.cast(b.column(c), pa.string()) if c in names else pa.nulls(b.num_rows, pa.string())
            keep = ~pc.is_null(text).to_numpy(zero_copy_only=False)
            if model:
                keep &= probabilities(pa.RecordBatch.from_arrays([text, own("source"), own("lang")], ["text", "source", "lang"]), model) >= model["threshold"]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(kit.batchwise(run), docs.schema)
