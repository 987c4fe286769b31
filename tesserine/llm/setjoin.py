"""Self-join of sets of 64-bit tokens by Jaccard similarity, rare tokens first.

1. Each document's tokens go to buckets of the token space, packed in arrays;
   a bucket counts in how many documents each token occurs and sends back
   those that more than one has. The others can match nothing and are but
   counted.
2. Tokens are ordered by document frequency (in steps of half a power of
   two), then by hash. Two sets with a Jaccard similarity of t or more share
   a token of both prefixes, the first n - ceil(t n) + 1 of each in that
   order. Prefix tokens meet by token; a pair is a candidate if the sizes
   allow t (length filter), if what is left of both after the token does
   (positional filter), and if the counts of both sets' tokens in eight parts
   of the token space do (suffix filter: a lower bound of the symmetric
   difference).
3. Of sets that are the same, one stands for all.
4. Candidates that hang together form components. The sets of a component
   meet in one place, or, where it is large, in pairs of blocks of its sets,
   and every pair's intersection is counted once, over whole sets. Tokens are
   compared by 58 bits there.

Nothing is capped: a frequent token in a prefix yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .components import components, link

U64 = kit.U64
#: text batch -> tokens and the text of each, distinct in a text, in the order of texts
Tokenise = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
#: rows, other rows (None: the same) -> similarity of each with each
Similarity = Callable[[pa.Table, pa.Table | None], np.ndarray]
#: rows, other rows (None: the same), their similarities -> columns
Answer = Callable[[pa.Table, pa.Table | None, np.ndarray], tuple[np.ndarray, ...]]
BLOCK = 1024
PACK = "bucket int, batch long, low binary, high binary, code binary, doc binary"


def at_least(t: float, n: np.ndarray) -> np.ndarray:
    """ceil(t * n), safe from rounding."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def shared_sets(rows: DataFrame, column: str, tokenise: Tokenise, tokens: int, threshold: float, bucket_tokens: int = 1_000_000) -> DataFrame:
    """Of rows(doc_id, column), what the search needs. tokens is about how many tokens there are, and sets but the number of buckets.

    doc_id, n, own (tokens that no other has), live (prefix tokens that another has), near (counts by part), keys (tokens that another has, rarest first) of the documents with any in the prefix.
    """
    buckets = min(kit.parts(tokens, bucket_tokens), 1 << 24)
    lost = max(0, (buckets - 1).bit_length() - 18)  # of 40 bits beside the bucket's, so that a key has 58 in all

    def spread(batches):
        task = TaskContext.get()
        batch = (task.partitionId() if task else 0) << 28
        for b in kit.slices(batches, column, 2 << 20):
            h, doc = tokenise(b)
            n = np.bincount(doc, minlength=b.num_rows).astype(np.int32)
            near = np.bincount(doc * 8 + ((h >> U64(37)) & U64(7)).astype(np.int64), minlength=8 * b.num_rows)
            rows = [(-1 - batch % buckets, batch, b.column("doc_id").to_numpy().tobytes(), n.tobytes(), b"", np.minimum(near, 65535).astype(np.uint16).tobytes())]
            bucket = (((h >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, doc, bucket = h[order], doc[order].astype(np.uint16), bucket[order]
            low, high = (h & U64(0xFFFFFFFF)).astype(np.uint32), ((h >> U64(32)) & U64(255)).astype(np.uint8)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            for x, y in zip(first, [*first[1:], len(h)][: len(first)], strict=True):  # none, if no text has tokens
                rows.append((int(bucket[x]), batch, low[x:y].tobytes(), high[x:y].tobytes(), b"", doc[x:y].tobytes()))
            yield packed(rows)
            batch += 1

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return t
        low, high = (t.column(c).to_pylist() for c in ("low", "high"))
        token = np.frombuffer(b"".join(low), np.uint32).astype(U64) | (np.frombuffer(b"".join(high), np.uint8).astype(U64) << U64(32))
        _, inv, df = np.unique(token, return_inverse=True, return_counts=True)
        df = df[inv]
        code = np.minimum(63, (2 * np.log2(df)).astype(np.int64)).astype(np.uint8)
        rows, at = [], 0
        for batch, lo, hi, doc in zip(t.column("batch").to_pylist(), low, high, t.column("doc").to_pylist(), strict=True):
            keep = df[at : at + len(hi)] > 1
            if keep.any():
                rows.append((bucket, batch, np.frombuffer(lo, np.uint32)[keep].tobytes(), np.frombuffer(hi, np.uint8)[keep].tobytes(), code[at : at + len(hi)][keep].tobytes(), np.frombuffer(doc, np.uint16)[keep].tobytes()))
            at += len(hi)
        return pa.Table.from_batches([packed(rows)])

    def gather(t: pa.Table) -> pa.Table:
        keys, docs_of = [], []
        ids = n = near = None
        for bucket, low, high, code, doc in zip(*(t.column(c).to_pylist() for c in ("bucket", "low", "high", "code", "doc")), strict=True):
            if bucket < 0:
                ids, n, near = np.frombuffer(low, np.int64), np.frombuffer(high, np.int32), np.frombuffer(doc, np.uint16).reshape(-1, 8)
                continue
            token = (np.frombuffer(high, np.uint8).astype(U64) << U64(32)) | np.frombuffer(low, np.uint32).astype(U64)
            keys.append((np.frombuffer(code, np.uint8).astype(U64) << U64(58)) | (U64(bucket) << U64(40 - lost)) | (token >> U64(lost)))
            docs_of.append(np.frombuffer(doc, np.uint16))
        key, doc = (np.concatenate(keys), np.concatenate(docs_of)) if keys else (np.empty(0, U64), np.empty(0, np.uint16))
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        own = n - np.diff(at)
        live = np.minimum(np.diff(at), n - at_least(threshold, n) + 1 - own)
        some = np.flatnonzero((live > 0) & (n > 0))
        return pa.table({"doc_id": ids[some], "n": n[some], "own": own[some].astype(np.int32), "live": live[some].astype(np.int32), "near": pa.array([near[k].tobytes() for k in some], pa.binary()), "keys": pa.array([key[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())})

    counted = rows.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).mapInArrow(kit.batchwise(spread), PACK).groupBy("bucket").applyInArrow(kit.groupwise(count), PACK)
    return kit.cut(counted.groupBy("batch").applyInArrow(kit.groupwise(gather), "doc_id long, n int, own int, live int, near binary, keys binary"))


def packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "batch", "low", "high", "code", "doc"])


PAIRS = 1 << 21  # as many pairs are looked at together


def candidate_edges(key: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, near: np.ndarray, threshold: float, labels: np.ndarray) -> np.ndarray:
    """labels after joining the candidates among prefix tokens; doc are places in labels.

    Length and positional filter need nothing but n and pos, so they are put to
    classes of documents with the same, not to pairs. A key whose documents
    are already joined up is done; so a token of g like documents takes g steps
    and not g squared.
    """
    order = np.lexsort((pos, n, key))
    key, doc, n, pos, near = key[order], doc[order], n[order].astype(np.int64), pos[order].astype(np.int64), near[order]
    part = threshold / (1 + threshold)
    new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
    first = np.flatnonzero(new_key | np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])][: len(key)])
    size = np.diff(np.r_[first, len(key)])
    cn, cpos, of_key = n[first], pos[first], (np.cumsum(new_key) - 1)[first]
    end = np.searchsorted(of_key, of_key, "right")
    key_first = np.flatnonzero(new_key)

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(cn[i] - cpos[i], cn[j] - cpos[j]) >= at_least(part, cn[i] + cn[j])

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal labels
        new = labels[doc[i]] != labels[doc[j]]
        i, j = i[new], j[new]
        if len(i):
            ok = np.abs(near[i] - near[j]).sum(1) <= n[i] + n[j] - 2 * at_least(part, n[i] + n[j])
            labels = link(labels, doc[i[ok]], doc[j[ok]])

    def apart(of: np.ndarray) -> np.ndarray:
        """Whether documents of the keys at hand are still apart."""
        own = labels[doc]
        return (np.minimum.reduceat(own, key_first) != np.maximum.reduceat(own, key_first))[of]

    if len(key):  # each with the next of its class; then what is left
        same = np.flatnonzero(np.r_[np.repeat(np.arange(len(first)), size)[1:] == np.repeat(np.arange(len(first)), size)[:-1], False])
        c = np.searchsorted(first, same, "right") - 1
        same = same[fits(c, c)]
        join(same, same + 1)
    alive, step = np.arange(len(first)), 0
    while len(alive):
        if step & (step - 1) == 0:
            alive = alive[apart(of_key[alive])]
        alive = alive[alive + step < end[alive]]
        # a pair's shorter set is at alive; beyond the length filter all later ones are too long as well
        alive = alive[cn[alive] >= at_least(threshold, cn[alive + step])]
        i = alive[fits(alive, alive + step)]
        if step == 0:
            i = i[size[i] > 1]
        total = size[i] * size[i + step]
        for wide in (False, True):
            own = i[(total > PAIRS // 16) == wide]
            if not len(own):
                continue
            if wide:  # one class after the other, some of its documents at a time
                for c in own.tolist():
                    d, rows = c + step, max(1, PAIRS // int(size[c + step]))
                    for x in range(first[c], first[c] + size[c], rows):
                        members = labels[doc[np.r_[x : first[c] + size[c], first[d] : first[d] + size[d]]]]
                        if members.min() == members.max():
                            break
                        y = min(x + rows, first[c] + size[c])
                        k, m = np.repeat(np.arange(x, y), size[d]), np.tile(np.arange(first[d], first[d] + size[d]), y - x)
                        join(k[k < m], m[k < m])
                continue
            each = size[own] * size[own + step]
            for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(each) // PAIRS)) + 1):
                each = size[some] * size[some + step]
                at, row = kit.ranges(each), np.repeat(np.arange(len(some)), each)
                k, m = first[some][row] + at // size[some + step][row], first[some + step][row] + at % size[some + step][row]
                join(k[k < m], m[k < m])
        step += 1
    return labels


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges a, b that join up whatever candidates hang together."""
    total = sets.agg(F.sum("live")).first()[0] or 0
    groups = kit.parts(total, 250_000)

    def prefixes(batches):
        for b in batches:
            live = b.column("live").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), live)
            key = np.concatenate([np.frombuffer(k, U64)[:m] for k, m in zip(b.column("keys").to_pylist(), live.tolist(), strict=True)] or [np.empty(0, U64)])
            pos = np.arange(len(row)) - np.repeat(np.cumsum(live) - live, live) + b.column("own").to_numpy()[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array((kit.mix(key) % U64(groups)).astype(np.int32)), pa.array(key.view(np.int64)), b.column("doc_id").take(take), b.column("n").take(take), pa.array(pos.astype(np.int32)), b.column("near").take(take)], ["part", "key", "doc_id", "n", "pos", "near"])

    def meet(t: pa.Table) -> pa.Table:
        ids, doc = np.unique(t.column("doc_id").to_numpy(), return_inverse=True)
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint16).reshape(-1, 8).astype(np.int32)
        labels = candidate_edges(t.column("key").to_numpy().view(U64), doc, t.column("n").to_numpy(), t.column("pos").to_numpy(), near, threshold, np.arange(len(ids)))
        some = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"a": ids[some], "b": ids[labels[some]]})

    return sets.mapInArrow(kit.batchwise(prefixes), "part int, key long, doc_id long, n int, pos int, near binary").groupBy("part").applyInArrow(kit.groupwise(meet), "a long, b long")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets in left with all in right, or among left."""
    if right is None and len(left) == 2:
        m = len(np.intersect1d(left[0], left[1], assume_unique=True))
        return np.array([[len(left[0]), m], [m, len(left[1])]], np.float64)
    both = left if right is None else left + right
    key, inv, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    keep = count[inv] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[keep], place[inv[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    m = len(left)
    out = np.zeros((m, m if right is None else len(right)), np.float64)
    width = max(256, (8 << 20) // len(both))
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        x, y = np.searchsorted(col, [c, c + width])
        dense = np.zeros((len(both), min(width, int(place[-1]) + 1 - c)), np.float32)
        dense[row[x:y], col[x:y] - c] = 1
        out += dense[:m] @ (dense if right is None else dense[m:]).T
    return out


def of_sets():
    """Similarity of the sets in two tables, or of all in one."""

    def similarity(left: pa.Table, right: pa.Table | None) -> np.ndarray:
        read = lambda t: [np.frombuffer(k, U64) for k in t.column("keys").to_pylist()]
        m = intersections(read(left), None if right is None else read(right))
        n = left.column("n").to_numpy()[:, None] + (left if right is None else right).column("n").to_numpy()[None, :]
        return m / np.maximum(n - m, 1)

    return similarity


def twins(rows: DataFrame, column: str) -> DataFrame:
    """doc_id and rep, the smallest doc_id with the same binary column, of those that aren't that one. Documents of several rows that differ are left out."""
    both = rows.select("doc_id", F.xxhash64(column).alias("_x"), F.xxhash64(F.lit(1), column).alias("_y"))
    single = both.groupBy("doc_id").agg(F.min(F.struct("_x", "_y")).alias("_h"), F.max(F.struct("_x", "_y")).alias("_g")).filter("_h = _g")
    groups = single.groupBy("_h").agg(F.min("doc_id").alias("rep"), F.collect_list("doc_id").alias("_ids")).filter(F.size("_ids") > 1)
    return kit.cut(groups.select("rep", F.explode("_ids").alias("doc_id")).filter("doc_id <> rep").select("doc_id", "rep"))


def verified(payload: DataFrame, size: str, roots: DataFrame, same: DataFrame, similarity: Similarity, threshold: float, spanning: bool = False) -> DataFrame:
    """a < b and similarity of the pairs of payload rows in the same component that reach the threshold.

    payload has doc_id and what similarity() needs; size is its binary
    column; same are the twins, which have the similarities of their rep, and
    1 to each other. With spanning, only as many pairs as join up the same
    documents.
    """
    n_same = same.count()
    gone = kit.if_small(same.select(F.col("doc_id").alias("id")), n_same)
    pairs = among(payload, size, roots.join(gone, "id", "left_anti"), similarity, pairs_of(threshold, spanning), "a long, b long, similarity double")
    if spanning:
        return pairs.unionByName(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))
    if not n_same:
        return pairs
    groups = kit.cut(same.groupBy("rep").agg(F.array_append(F.collect_list("doc_id"), F.first("rep")).alias("ids")))
    groups = kit.if_small(groups, n_same)
    of = lambda c: groups.select(F.col("rep").alias(c), F.col("ids").alias(f"_{c}"))
    spread = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    spread = spread.select(F.explode(F.coalesce("_a", F.array("a"))).alias("a"), "b", "_b", "similarity").select("a", F.explode(F.coalesce("_b", F.array("b"))).alias("b"), "similarity")
    within = groups.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b"), F.lit(1.0).alias("similarity")).filter("a < b")
    return spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(within)


def classes(payload: DataFrame, size: str, roots: DataFrame, same: DataFrame, similarity: Similarity, threshold: float) -> DataFrame:
    """id, class_id and links of the documents of verified()'s pairs, a row each: the smallest doc_id among those that hang together by pairs, and how many pairs the document is in.

    No pair is written: a block gives its documents' counts, in which a rep
    weighs as much as its twins and itself, and what joins them up.
    """
    n_same = same.count()
    gone = kit.if_small(same.select(F.col("doc_id").alias("id")), n_same)
    more = kit.cut(same.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("more")))
    weighed = roots.join(gone, "id", "left_anti").join(kit.if_small(more, n_same), "id", "left").select("id", "root", (F.coalesce("more", F.lit(0)) + 1).alias("weight"))
    found = kit.cut(among(payload, size, weighed, similarity, links_of(threshold), "id long, near long, links long"))
    whole = components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = links.join(more, "id", "full_outer").join(whole, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))
    reps = kit.cut(reps)
    return reps.unionByName(same.join(reps.withColumnRenamed("id", "rep"), "rep").select(F.col("doc_id").alias("id"), "class_id", "links"))


def pairs_of(threshold: float, spanning: bool) -> Answer:
    """a < b and similarity of the pairs that reach the threshold; for among()."""

    def answer(left: pa.Table, right: pa.Table | None, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        doc = np.concatenate([t.column("doc_id").to_numpy() for t in (left, right) if t is not None])
        p, q = np.nonzero(np.triu(sim >= threshold, 1) if right is None else sim >= threshold)
        s, q = sim[p, q], q + (0 if right is None else left.num_rows)
        if spanning:
            labels = link(np.arange(len(doc)), p, q)
            p = np.flatnonzero(labels != np.arange(len(doc)))
            q, s = labels[p], np.ones(len(p))
        a, b = doc[p], doc[q]
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], s[a != b]

    return answer


def links_of(threshold: float) -> Answer:
    """Of each document with pairs that reach the threshold: id, near (the first in the blocks that it hangs together with) and links, the sum of the others' weights; for among()."""

    def documents(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's first row, for rows of one doc_id are one document, its id and weight."""
        doc = t.column("doc_id").to_numpy()
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        return first, doc[first], t.column("weight").to_numpy()[first]

    def answer(left: pa.Table, right: pa.Table | None, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        first, doc, weight = documents(left)
        over, other, far = (first, doc, weight) if right is None else documents(right)
        ok = np.logical_or.reduceat(np.logical_or.reduceat(sim >= threshold, first, axis=0), over, axis=1)
        if right is None:
            np.fill_diagonal(ok, False)
        p, q = np.nonzero(ok)
        count = np.bincount(p, far[q], len(doc))
        if right is not None:
            doc, count, q = np.concatenate([doc, other]), np.concatenate([count, np.bincount(q, weight[p], len(other))]), q + len(doc)
        labels = link(np.arange(len(doc)), p, q)
        some = np.flatnonzero(count)
        return doc[some], doc[labels[some]], count[some].astype(np.int64)

    return answer


def among(payload: DataFrame, size: str, roots: DataFrame, similarity: Similarity, answer: Answer, schema: str) -> DataFrame:
    """What answer gives for the rows of payload of every component, in blocks if there are many of them, each block against itself and each of the others. roots may have columns for answer beside id and root."""
    extra = [c for c in roots.columns if c not in ("id", "root")]
    sized = kit.cut(roots.join(roots.groupBy("root").count(), "root").select("id", "root", *extra, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    rows = sized.count()
    groups = kit.parts(payload.agg(F.sum(F.octet_length(size))).first()[0] or 0, 4 << 20)
    columns = [*(c for c in payload.columns if c != "doc_id"), *extra]
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = payload.join(kit.if_small(sized, rows), payload["doc_id"] == sized["id"]).select("doc_id", *columns, "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("doc_id", *columns, "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(groups)))
    fields = [x.split() for x in schema.split(", ")]

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("root", "i", "j", "own", "doc_id")]).combine_chunks()
        root, i, j, own = (t.column(c).to_numpy() for c in ("root", "i", "j", "own"))
        t = t.select(["doc_id", *columns])
        new = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        out: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, np.int64 if kind == "long" else np.float64) for _, kind in fields)]
        for x, y in zip(new.tolist(), [*new[1:].tolist(), len(root)], strict=True):
            cross = i[x] != j[x]
            mid = x + int(np.count_nonzero(own[x:y] == i[x])) if cross else y
            if y - x < 2 or cross and mid in (x, y):
                continue
            left, right = t.slice(x, mid - x), t.slice(mid, y - mid) if cross else None
            out.append(answer(left, right, similarity(left, right)))
        return pa.table({name: np.concatenate(c) for (name, _), c in zip(fields, zip(*out, strict=True), strict=True)})

    return spread.groupBy("part").applyInArrow(kit.groupwise(meet), schema)


def search(rows: DataFrame, column: str, tokenise: Tokenise, tokens: int, threshold: float) -> tuple[DataFrame, str, DataFrame, DataFrame, Similarity, float]:
    """What verified() and classes() take."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    sets = shared_sets(rows, column, tokenise, tokens, threshold)
    roots = components(candidates(sets, threshold))
    return sets.select("doc_id", "n", "keys"), "keys", roots, twins(sets.filter("own = 0"), "keys"), of_sets(), threshold


def set_join(rows: DataFrame, column: str, tokenise: Tokenise, tokens: int, threshold: float, spanning: bool = False) -> DataFrame:
    """a < b and similarity of every pair of doc_id whose sets reach the threshold, each pair once."""
    pairs = verified(*search(rows, column, tokenise, tokens, threshold), spanning)
    return pairs if spanning else pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
