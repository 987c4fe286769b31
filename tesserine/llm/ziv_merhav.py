"""Language-model scoring by Ziv-Merhav cross-parsing, over words.

A suffix automaton of reference text yields, from any point of a document,
the longest stretch that occurs in the reference; taken greedily these
phrases factor the document. With c phrases in n words, N words of reference
and c_self phrases of the document's own incremental (LZ78) parsing, the
estimates are

    cross_entropy    = c * log2(N) / n
    relative_entropy = (c * log2(N) - c_self * log2(c_self)) / n

bits per word. Words are those of kit.

Every document is reference text, and every one is parsed against all others
of its group, its own text left out. Groups are of one language and gather
what is alike: documents with the same least hash of five words in a row (a
min-hash) meet, hence all copies and, as often as they have that share of
their five-word runs in common, near copies. A language with B bytes of text
has groups of about GROWTH * cube root of B bytes: the reference grows with
the input, and what a task holds stays bounded (2 MB at 0.1 GB of text a
language, 9 MB at 12 GB, 120 MB at 25 TB). A class of like documents larger
than a group is parted by the hash of the whole text, so that copies still
meet, and a text whose copies fill more than a group by doc_id, TOGETHER of
them or more in each part, so that none is without another.

The automaton's states are sets of places where a string ends; here the
prefixes of all texts are sorted by their words read backwards, so that a
state is an interval of that order and a transition is two binary searches
(the rank of a symbol among the words that follow the prefixes). All documents
of a group walk through it in step. A state counts only if its interval holds
another text than the walker's, which one look at the next entry of another
text tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

GROWTH = 4096
RUN = 5
SEGMENT = 256
TOGETHER = 32
SCHEMA = "doc_id long, n_words long, phrases long, own_phrases long, reference_words long, cross_entropy double, relative_entropy double"
U64 = kit.U64


def sorted_prefixes(sym: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The places of sym in the order of the words up to and including each, read backwards to the beginning of their text; equal ones by place.

    Every text begins with a 0, words are 1 and more; room is the distance to
    the text's 0.
    """
    n = len(sym)
    bits = max(1, int(sym.max(initial=0)).bit_length())
    h = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[k:] |= np.where(room[k:] >= k, sym[: n - k], 0)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    size = np.diff(np.r_[head, n])
    act = order[np.repeat(size > 1, size)]
    act = act[room[act] >= h]
    while len(act):
        key = rank[act] * n + rank[act - h]
        order = np.argsort(key)
        act, key = act[order], key[order]
        old = rank[act]
        at = np.arange(len(act))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[act] = old + head - group
        many = np.bincount(head, minlength=len(act))[head] > 1
        h *= 2
        act = act[many & (room[act] >= h)]
    return np.argsort(rank * n + np.arange(n))


class Automaton:
    """The suffix automaton of texts, given as one array of words (1 and more) and where each text begins and ends in it."""

    def __init__(self, words: np.ndarray, first: np.ndarray) -> None:
        size = np.diff(first)
        texts = len(size)
        n = len(words) + texts
        start = first[:-1] + np.arange(texts)
        sym = np.zeros(n, np.int64)
        doc = np.repeat(np.arange(texts), size + 1)
        room = np.arange(n) - start[doc]
        sym[room > 0] = words
        order = sorted_prefixes(sym, room)
        follow = np.zeros(n, np.int64)
        follow[:-1] = sym[1:]
        self.n, self.start = n, start + 1
        self.sym = sym
        self.follow = follow[order] * (n + 1) + np.arange(n)
        self.follow.sort()
        self.doc = doc[order]
        change = np.flatnonzero(self.doc[1:] != self.doc[:-1]) + 1
        self.other = np.repeat(np.r_[change, n], np.diff(np.r_[0, change, n]))

    def phrases(self, which: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the texts at which, with size words each, the phrases of the greedy parse by longest matches with other texts; a word that the others lack is one by itself.

        Where a phrase ends depends on nothing but where it begins. So walkers
        set out from every SEGMENT-th word at once, and one that comes to where
        another began a phrase stops: from there on both are the same.
        """
        at = kit.ranges(-(-size // SEGMENT))
        start = np.repeat(self.start[which], -(-size // SEGMENT)) + at * SEGMENT
        own = np.repeat(which, -(-size // SEGMENT))
        last = np.repeat(self.start[which] + size, -(-size // SEGMENT))
        then = np.zeros(self.n + 1, np.int64)
        taken = np.full(self.n + 1, -1)
        taken[start] = 0
        pos, low, high = start.copy(), np.zeros(len(start), np.int64), np.full(len(start), self.n)
        while len(pos):
            s = self.sym[pos] * (self.n + 1)
            a, b = np.searchsorted(self.follow, s + low), np.searchsorted(self.follow, s + high)
            c = np.minimum(a, self.n - 1)
            on = (b > a) & ((self.doc[c] != own) | (self.other[c] < b))
            pos += on | (pos == start)
            low, high = np.where(on, a, 0), np.where(on, b, self.n)
            stop = np.flatnonzero(~on | (pos == last))
            if len(stop):
                then[start[stop]] = pos[stop]
                start[stop], low[stop], high[stop] = pos[stop], 0, self.n
                free = stop[(taken[pos[stop]] < 0) & (pos[stop] < last[stop])]
                taken[pos[free]] = free
                keep = np.ones(len(pos), bool)
                keep[stop] = False
                keep[free] = taken[pos[free]] == free
                if not keep.all():
                    pos, start, low, high, own, last = (x[keep] for x in (pos, start, low, high, own, last))
        out = np.zeros(len(which), np.int64)
        now, end, of = self.start[which], self.start[which] + size, np.arange(len(which))
        while len(now):
            now = then[now]
            out[of] += 1
            on = now < end
            now, end, of = now[on], end[on], of[on]
        return out


def own_phrases(words: list[int]) -> int:
    """Phrases of the incremental parsing of a text, each the shortest that hasn't been one before."""
    root: dict = {}
    t, c = root, 0
    for w in words:
        if w in t:
            t = t[w]
        else:
            t[w] = {}
            c += 1
            t = root
    return c + (t is not root)


def whole_hash(words: kit.Words) -> np.ndarray:
    """A hash of each text's words in their order."""
    up, down = kit.powers(len(words.hash))
    total = np.zeros(len(words.hash) + 1, U64)
    np.cumsum(words.hash * up[: len(words.hash)], out=total[1:])
    x, y = words.first[:-1], words.first[1:]
    return kit.mix((total[y] - total[x]) * down[x] + (y - x).astype(U64))


def least_hash(words: kit.Words) -> np.ndarray:
    """The least hash of RUN words in a row of each text, 0 for texts without words."""
    h, doc, _ = words.grams(RUN, short=True)
    out = np.zeros(words.n, U64)
    if len(h):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[at]] = np.minimum.reduceat(h, at)
    return out


def parse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a group: words, phrases (-1 where there is no reference), own phrases, and words of reference."""
    words = kit.Words(texts)
    size = np.diff(words.first)
    _, first, same, copies = np.unique(np.stack([whole_hash(words), size.astype(U64)], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    same = same.ravel()
    symbols = np.unique(words.hash, return_inverse=True)[1] + 1
    own_size = size[first]
    at = np.r_[0, np.cumsum(own_size)]
    inner = np.arange(at[-1]) - np.repeat(at[:-1], own_size) + np.repeat(words.first[:-1][first], own_size)
    machine = Automaton(symbols[inner], at)
    reference = at[-1] - np.where(copies > 1, 0, own_size)
    phrases = np.minimum(own_size, 1)  # a text that has a copy occurs elsewhere as a whole
    single = np.flatnonzero((copies == 1) & (own_size > 0))
    phrases[single] = machine.phrases(single, own_size[single])
    phrases[(reference == 0) & (own_size > 0)] = -1
    own = np.array([own_phrases(symbols[words.first[k] : words.first[k + 1]].tolist()) for k in first.tolist()], np.int64)
    return size, phrases[same], own[same], reference[same]


def score(docs: DataFrame, growth: float = GROWTH) -> DataFrame:
    """doc_id, n_words, phrases, own_phrases, reference_words, cross_entropy and relative_entropy of every row of docs.

    Null texts, empty texts and texts without words: 0 words and phrases, null
    entropies. Null lang: a language by itself. A document for which there is
    no reference besides itself, as the only one of its language: null
    phrases and entropies. Null doc_id: scored, with null doc_id. Repeated rows
    are documents each, so that all are one phrase of another. Very long
    texts are parsed whole (about 150 bytes of memory a word). An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))

    def sign(batches, keep: bool):
        for b in kit.slices(batches):
            words = kit.Words(b.column("text"))
            like, whole = pa.array(least_hash(words).view(np.int64)), pa.array(whole_hash(words).view(np.int64))
            if keep:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("lang"), like, whole], ["doc_id", "text", "lang", "like", "whole"])
            else:
                t = pa.table([b.column("lang"), like, whole, pc.cast(pc.fill_null(pc.binary_length(b.column("text")), 0), pa.int64())], names=["lang", "like", "whole", "b"]).group_by(["lang", "like", "whole"]).aggregate([("b", "sum"), ("b", "count")])
                yield from t.rename_columns(["lang", "like", "whole", "b", "n"]).combine_chunks().to_batches()

    wholes = kit.cut(slim.mapInArrow(kit.batchwise(lambda batches: sign(batches, False)), "lang string, like long, whole long, b long, n long").groupBy("lang", "like", "whole").agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
    per_lang = wholes.groupBy("lang").agg(F.sum("b").alias("_b")).select("lang", F.greatest(F.lit(1.0), growth * F.cbrt("_b")).alias("_size"), "_b").withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("_b") / F.col("_size"))).cast("long")).drop("_b")
    per_lang = kit.cut(per_lang)
    sized = kit.if_small(per_lang, per_lang.count())
    likes = kit.cut(wholes.groupBy("lang", "like").agg(F.sum("b").alias("b")).join(sized, "lang").filter("b > _size").select("lang", "like", F.lit(True).alias("_parted")))
    times = F.least(F.ceil(F.col("b") / F.col("_size")), F.floor(F.col("n") / TOGETHER)).cast("long")
    many = kit.cut(wholes.join(sized, "lang").select("lang", "like", "whole", times.alias("_times")).filter("_times > 1"))
    rows = slim.mapInArrow(kit.batchwise(lambda batches: sign(batches, True)), "doc_id long, text string, lang string, like long, whole long")
    rows = rows.join(sized, "lang").join(kit.if_small(likes, likes.count()), ["lang", "like"], "left").join(kit.if_small(many, many.count()), ["lang", "like", "whole"], "left")
    key = F.xxhash64("like", F.when(F.col("_parted"), F.col("whole")).otherwise(0), F.when(F.col("_times").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_times"))).otherwise(0))
    grouped = rows.withColumn("part", F.pmod(key, F.col("_groups"))).select("doc_id", "text", "lang", "part")

    def one(t: pa.Table) -> pa.Table:
        n, c, own, reference = parse(t.column("text").combine_chunks())
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = c * np.log2(np.maximum(reference, 2)) / n
            relative = cross - own * np.log2(np.maximum(own, 1)) / n
        none = (n == 0) | (c < 0)
        return pa.table([t.column("doc_id"), pa.array(n), pa.array(c, mask=c < 0), pa.array(own), pa.array(reference), pa.array(cross, mask=none), pa.array(relative, mask=none)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return grouped.groupBy("lang", "part").applyInArrow(kit.groupwise(one), SCHEMA)
