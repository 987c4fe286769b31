"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of words, each word between two
blanks. All orders' n-grams, of every language, lie in sorted arrays of
64-bit hashes; beside each hash stands a row with its log-probability in
every language, already interpolated, so a character costs one search per
order whatever the number of languages. A text's language is the one with
the lowest cross-entropy per character.

Rejection is calibrated by held-out texts, whole and cut into pieces of about
SIZES characters that count: of each size and language, the median cross-entropy and the
distance from it to the 95th percentile, WIDTH at least (a text may quote
another tongue). A text is rejected as "und" if it is further above the
median than SLACK times that distance, at its length (between sizes, by the
logarithm of the length; below the least, widened by the root of it).

Words with ASCII digits and all other ASCII characters say nothing about
language and are left out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kit
from .features import train_in_one_task

ORDER = 5
SIZES, LEAST, SLACK, WIDTH = (50, 100, 200, 400, 800, 1600), 20, 4.0, 0.15
STEPS = 10_000  # of a nat
#: Of a language with as many labelled rows or fewer, every fifth document in the order of a hash is held out; of others those whose hash is divisible by five, which takes no ranks.
FEW = 2000
U64 = kit.U64


def distinct_words(words: kit.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words among those at keep: one place of each, and for each of keep which it is."""
    _, first, which = np.unique(words.hash[keep], return_index=True, return_inverse=True)
    return keep[first], which


def characters(words: kit.Words, which: np.ndarray) -> np.ndarray:
    """Code points of the words at which, a blank before each and one after the last."""
    size = words.end[which] - words.start[which] + 1
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()) + 1, 32, np.uint8)
    at = np.arange(len(out) - 1) - np.repeat(begin, size)
    inner = np.flatnonzero(at > 0)
    out[inner] = words.data[np.repeat(words.start[which], size)[inner] + at[inner] - 1]
    return np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


class Grams:
    """Hashes of the n-grams that end at each character of a stream; those that reach over a blank into another word don't exist."""

    def __init__(self, cp: np.ndarray) -> None:
        blank = cp == 32
        last = np.maximum.accumulate(np.where(blank, np.arange(len(cp)), 0))
        self.at = np.arange(1, len(cp))
        self.room = self.at - last[:-1] + 1  # characters up to the one at hand, from the word's blank on
        self.word = np.cumsum(blank)[:-1] - 1
        c = cp.astype(U64) + U64(1)
        self.h = [None]
        total = np.zeros(len(cp), U64)
        for n in range(1, ORDER + 1):
            total = total.copy()
            if n <= len(cp):
                total[n - 1 :] += c[: len(cp) - n + 1] * kit.SALTS[n - 1]
            self.h.append(kit.mix(total + kit.SALTS[40 + n]))

    def of(self, n: int, where: np.ndarray) -> np.ndarray:
        return self.h[n][self.at[where]]

    def before(self, n: int, where: np.ndarray) -> np.ndarray:
        return self.h[n][self.at[where] - 1]


def digits_in(words: kit.Words) -> np.ndarray:
    digit = (words.data >= 48) & (words.data <= 57)
    total = np.zeros(len(digit) + 1, np.int64)
    np.cumsum(digit, out=total[1:])
    return total[words.end] > total[words.start]


def grams(texts: pa.Array) -> list[np.ndarray]:
    """n, hash, hash without the last character, hash without the first, whether it begins with a blank, and count of each distinct n-gram in the words of texts without digits."""
    words = kit.Words(texts)
    which, inv = distinct_words(words, np.flatnonzero(~digits_in(words)))
    count = np.bincount(inv, minlength=len(which))
    g = Grams(characters(words, which))
    out = []
    for n in range(1, ORDER + 1):
        ok = np.flatnonzero(g.room >= n)
        h, first, inv = np.unique(g.of(n, ok), return_index=True, return_inverse=True)
        at = ok[first]
        ctx, suffix = (g.before(n - 1, at), g.of(n - 1, at)) if n > 1 else (np.zeros(len(h), U64), np.zeros(len(h), U64))
        out.append((np.full(len(h), n), h, ctx, suffix, g.room[at] == n, np.bincount(inv, count[g.word[ok]], len(h)).astype(np.int64) if len(h) else np.empty(0, np.int64)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def fit(languages: dict[str, list[str]], held: dict[str, list[str]]) -> dict:
    """The model of texts by language; held texts calibrate the rejection."""
    model = fit_grams({name: grams(pa.array(texts, pa.string())) for name, texts in languages.items()})
    for j, name in enumerate(model["names"]):
        rows = piece_counts(model, pa.array(held[name] or languages[name], pa.string()), np.full(len(held[name] or languages[name]), j))
        model["limits"][j] = limits([limit(*rows[2:, rows[1] == part]) for part in range(len(SIZES) + 1)])
    return model


def fit_grams(languages: dict[str, list[np.ndarray]]) -> dict:
    """The model of each language's grams(); it rejects nothing yet."""
    names = sorted(languages)
    stats = []
    symbols = {kit.mix(np.array([33], U64) * kit.SALTS[0] + kit.SALTS[41])[0]}  # the blank's hash
    for name in names:
        own = []
        for n in range(1, ORDER + 1):
            each = [c[languages[name][0] == n] for c in languages[name][1:]]
            order = np.argsort(each[0])
            own.append([c[order] for c in each])
        symbols |= set(own[0][0].tolist())
        orders = []
        for n, (h, ctx, suffix, starts, raw) in enumerate(own, 1):
            if n < ORDER:  # how many different characters stand before it; what begins with a blank keeps its count
                left = np.bincount(np.searchsorted(h, own[n][2]), minlength=len(h)) if len(h) else raw
                raw = np.where(starts & (n > 1), raw, left)
            orders.append((h, raw.astype(float), ctx, suffix))
        stats.append(orders)
    base = -np.log(len(symbols) + 1.0)
    grams, contexts = [], []
    lower = None
    for n in range(1, ORDER + 1):
        h = np.unique(np.concatenate([s[n - 1][0] for s in stats]))
        ctx, suffix = np.zeros(len(h), U64), np.zeros(len(h), U64)
        for s in stats:
            at = np.searchsorted(h, s[n - 1][0])
            ctx[at], suffix[at] = s[n - 1][2], s[n - 1][3]
        c = np.unique(ctx)
        p, bow = np.zeros((len(h), len(names))), np.zeros((len(c), len(names)))
        below = np.full((len(h), len(names)), np.exp(base)) if n == 1 else np.exp(lower[1][np.searchsorted(lower[0], suffix)])
        for j, s in enumerate(stats):
            gh, raw, gctx, _ = s[n - 1]
            raw = np.maximum(raw, 1e-9)
            ones, twos = np.count_nonzero(np.round(raw) == 1), np.count_nonzero(np.round(raw) == 2)
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            cat = np.searchsorted(c, gctx)
            total, kinds = np.bincount(cat, raw, len(c)), np.bincount(cat, minlength=len(c))
            back = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
            own = np.zeros(len(h))
            own[np.searchsorted(h, gh)] = np.maximum(raw - d, 0)
            hat = np.searchsorted(c, ctx)
            p[:, j] = np.where(total[hat] > 0, own / np.maximum(total[hat], 1e-9), 0) + np.minimum(back[hat], 1) * below[:, j]
            bow[:, j] = np.log(np.clip(back, 1e-6, 1))
        lp = np.log(np.maximum(p, 1e-12)).astype(np.float32)
        grams.append((h, lp))
        contexts.append((c, bow.astype(np.float32)))
        lower = (h, lp)
    return {"names": names, "base": float(base), "grams": grams, "contexts": contexts, "limits": [limits([]) for _ in names]}


def piece_counts(model: dict, texts: pa.Array, language: np.ndarray) -> np.ndarray:
    """Language, part, kind, value and number of pieces, in five rows: of the texts, each by the model of its language, cut into pieces of whole words, of SIZES[part] characters or just over (what is left at a text's end is too short), and, as the last part, whole. Kind 0 is the cross-entropy in steps of 1 / STEPS nats, kind 1 the characters."""
    words = kit.Words(texts)
    keep = np.flatnonzero(~digits_in(words))
    if not len(keep):
        return np.empty((5, 0), np.int64)
    which, inv = distinct_words(words, keep)
    lp, size = word_scores(model, words, which)
    doc = words.doc[keep]
    cost, chars = np.r_[0, np.cumsum(-lp[inv, language[doc]])], np.r_[0, np.cumsum(size[inv])]
    at = np.searchsorted(doc, np.arange(words.n + 1))
    out = []
    for part in range(len(SIZES) + 1):
        if part == len(SIZES):
            x, y = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
        else:  # from each word to behind the last of a piece that begins with it
            after = np.searchsorted(chars, chars[:-1] + SIZES[part]).tolist()
            begins, ends = [], []
            for k, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                while k < end and after[k] <= end:
                    begins.append(k)
                    k = after[k]
                    ends.append(k)
            x, y = np.array(begins, np.int64), np.array(ends, np.int64)
        n = chars[y] - chars[x]
        j = language[doc[x]]
        for kind, value in enumerate((np.round((cost[y] - cost[x]) / n * STEPS).astype(np.int64), n)):
            (*key,), count = np.unique(np.stack([j, value]), axis=1, return_counts=True)
            out.append(np.stack([key[0], np.full(len(count), part), np.full(len(count), kind), key[1], count]))
    return np.concatenate(out, axis=1).astype(np.int64)


def quantile(value: np.ndarray, count: np.ndarray, q: float) -> float:
    """numpy's quantile of values that occur count times."""
    order = np.argsort(value)
    value, upto = value[order], np.cumsum(count[order])
    place = q * (upto[-1] - 1)
    low, high = value[np.searchsorted(upto, [np.floor(place), np.ceil(place)], "right")]
    return float(low + (high - low) * (place - np.floor(place)))


def limit(kind: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[float, float] | None:
    """The length of the pieces counted, and the highest cross-entropy accepted at it; None if there are too few to tell."""
    h, n = kind == 0, kind == 1
    if count[h].sum() < LEAST:
        return None
    middle, high = (quantile(value[h], count[h], q) / STEPS for q in (0.5, 0.95))
    return quantile(value[n], count[n], 0.5), middle + SLACK * max(high - middle, WIDTH)


def limits(each: list[tuple[float, float] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, ascending, and the highest cross-entropy accepted at each."""
    sizes, tops = np.array(sorted(x for x in each if x), float).reshape(-1, 2).T
    return sizes, tops


def accepted(model: dict, best: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether texts with a cross-entropy of h over size characters are of language best."""
    out = size > 0
    for j, (sizes, tops) in enumerate(model["limits"]):
        own = np.flatnonzero((best == j) & out)
        if len(sizes) and len(own):
            top = np.interp(np.log(size[own]), np.log(sizes), tops) * np.sqrt(np.maximum(sizes[0] / size[own], 1))
            out[own] = h[own] <= top
    return out


def word_scores(model: dict, words: kit.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word at which, the log-probability in every language and the number of characters, the closing blank included."""
    g = Grams(characters(words, which))
    lp = np.full((len(g.at), len(model["names"])), model["base"], np.float32)
    for n in range(1, ORDER + 1):
        ok = np.flatnonzero(g.room >= n)
        h, table = model["grams"][n - 1]
        hit, at = kit.in_sorted(g.of(n, ok), h)
        lp[ok[hit]] = table[at[hit]]
        miss = ok[~hit]
        c, bow = model["contexts"][n - 1]
        known, at = kit.in_sorted(g.before(n - 1, miss) if n > 1 else np.zeros(len(miss), U64), c)
        lp[miss[known]] += bow[at[known]]
    n = len(which)
    first = np.searchsorted(g.word, np.arange(n))
    return (np.add.reduceat(lp, first, axis=0, dtype=np.float64) if n else np.zeros((0, lp.shape[1]))), np.bincount(g.word, minlength=n)[:n]


def text_scores(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each text in every language, and its number of characters that count."""
    words = kit.Words(texts)
    keep = np.flatnonzero(~digits_in(words))
    which, inv = distinct_words(words, keep)
    lp, size = word_scores(model, words, which)
    doc = words.doc[keep]
    total = np.stack([np.bincount(doc, lp[inv, j], words.n) for j in range(lp.shape[1])], 1) if len(keep) else np.zeros((words.n, lp.shape[1]))
    return total, np.bincount(doc, size[inv], words.n) if len(keep) else np.zeros(words.n)


def train(docs: DataFrame, max_langs: int = 256, seed: int = 11) -> dict | None:
    """The model from all of docs(doc_id, text, lang), lang being the label; None where no row has both.

    N-grams are counted over every labelled row, but for the fifth of the
    documents that is held out, all of which calibrate the rejection; a
    language of under five documents is calibrated by them. max_langs bounds
    the languages to those with the most labelled rows. What one task holds
    are the distinct n-grams.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null and lang <> '' and text is not null and text <> ''")
    top = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(max_langs).collect()
    if not top:
        return None
    names = sorted(r.lang for r in top)
    place = {name: j for j, name in enumerate(names)}
    langs = docs.sparkSession.createDataFrame([(r.lang, place[r.lang], r._n <= FEW) for r in top], "lang string, j int, few boolean")
    slim = slim.join(F.broadcast(langs), "lang")
    h = F.xxhash64("doc_id", F.lit(seed))
    rank = F.row_number().over(Window.partitionBy("j").orderBy(h, "doc_id"))
    ranks = kit.cut(slim.filter("few").select("doc_id", "j").distinct().withColumn("rank", rank))
    tiny = [r.j for r in ranks.groupBy("j").agg(F.max("rank").alias("m")).filter("m < 5").collect()]
    fifth = ranks.filter("rank % 5 = 0").select("doc_id", "j", F.lit(True).alias("mark"))  # FEW / 5 of each language at most
    held = F.when(F.col("few"), F.col("mark").isNotNull()).otherwise(F.pmod(h, F.lit(5)) == 0)
    rows = slim.join(F.broadcast(fifth), ["doc_id", "j"], "left").select("j", "text", held.alias("held"))

    fields = ["j", "n", "h", "ctx", "suffix", "starts", "count"]

    def count_grams(batches):
        for b in kit.slices(batches, most=4 << 20):
            j = b.column("j").to_numpy()
            for k in np.unique(j).tolist():
                n, h, ctx, suffix, starts, count = grams(b.column("text").filter(pa.array(j == k)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(n), k, np.int32), n.astype(np.int32), h.view(np.int64), ctx.view(np.int64), suffix.view(np.int64), starts, count)], fields)

    def one(t: pa.Table) -> pa.Table:
        j, n, h, ctx, suffix, starts, count = (t.column(c).to_numpy() for c in fields)
        own = n, h.view(U64), ctx.view(U64), suffix.view(U64), starts, count
        return pa.table({"model": [pickle.dumps(fit_grams({name: [c[j == k] for c in own] for k, name in enumerate(names)}))]})

    counted = rows.filter("not held").select("j", "text").mapInArrow(kit.batchwise(count_grams), "j int, n int, h long, ctx long, suffix long, starts boolean, count long")
    counted = counted.groupBy("j", "n", "h").agg(F.min("ctx").alias("ctx"), F.min("suffix").alias("suffix"), F.max("starts").alias("starts"), F.sum("count").alias("count"))
    row = train_in_one_task(counted, one, "model binary")
    if not row:  # labelled texts without words
        return fit_grams({name: grams(pa.array([], pa.string())) for name in names})
    model = pickle.loads(row.model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches):
        for b in kit.slices(batches, most=4 << 20):
            out = piece_counts(shared.value, b.column("text"), b.column("j").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["j", "part", "kind", "value", "n"])

    def top_of(t: pa.Table) -> pa.Table:
        found = limit(*(t.column(c).to_numpy() for c in ("kind", "value", "n")))
        return pa.table({"j": t.column("j").slice(0, 1), "size": [found and found[0]], "top": [found and found[1]]}, pa.schema([("j", pa.int64()), ("size", pa.float64()), ("top", pa.float64())]))

    pieces = rows.filter(F.col("held") | F.col("j").isin(tiny)).select("j", "text").mapInArrow(kit.batchwise(calibrate), "j long, part long, kind long, value long, n long")
    tops = pieces.groupBy("j", "part", "kind", "value").agg(F.sum("n").alias("n")).groupBy("j", "part").applyInArrow(kit.groupwise(top_of), "j long, size double, top double").filter("size is not null").collect()
    model["limits"] = [limits([(r["size"], r.top) for r in tops if r.j == j]) for j in range(len(names))]
    shared.unpersist()
    return model


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, language, cross_entropy (nats per character), and margin to the second-best language, of every row of docs.

    Null texts, empty texts and texts without letters: language "und", null
    cross_entropy and margin. Rejected texts: "und", with the figures of the
    best language. Ties go to the name that sorts first. Null or empty lang: the
    row is no example to learn from, but is identified; so is one with null
    doc_id. Very long texts are identified by all they have. Without labelled texts
    all are "und". Repeated rows stay. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def run(batches):
        model = shared.value
        for b in kit.slices(batches, most=4 << 20):
            n = b.num_rows
            if model is None:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["und"] * n), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], ["doc_id", "language", "cross_entropy", "margin"])
                continue
            total, size = text_scores(model, b.column("text"))
            h = -total / np.maximum(size, 1)[:, None]
            best = np.argmin(h, 1)
            own = h[np.arange(n), best]
            taken = accepted(model, best, own, size)
            second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else np.full(n, np.nan)
            names = np.array([*model["names"], "und"], object)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[np.where(taken, best, len(names) - 1)], pa.string()), pa.array(own, mask=size == 0), pa.array(second - own, mask=(size == 0) | np.isnan(second))], ["doc_id", "language", "cross_entropy", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kit.batchwise(run), "doc_id long, language string, cross_entropy double, margin double")
