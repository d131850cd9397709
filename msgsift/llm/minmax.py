"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct five-word shingles. One multiplication
per shingle and permutation gives two signature values, the minimum and the
maximum of the permuted hashes, so ``permutations`` evaluations yield twice as
many values (the maximum under a is the minimum under -a). Values are banded
four by four. With 64 permutations, 32 bands: two sets at similarity 0.75
share a band with probability 1 - (1 - 0.75^4)^32 = 0.999995.

1. One pass over the texts: shingle count, 128-bit fingerprint of the set,
   band keys and a 128-byte signature sketch (low byte of each value).
2. Rows with equal sets are one class; a class goes on as one row.
3. Classes that share a band meet in that bucket. Sketches that agree in at
   least half their bytes (0.75 expected: 6 standard deviations) tie classes
   into families. No pair list is made: a bucket yields a forest.
4. Families read their texts again and link classes whose full shingle sets
   have 100 * intersection >= 75 * union, exactly. A class is compared
   with all others of its family unless both already hang together.
5. Connected components of the verified links; the smallest id names them.

Buckets and families above a bound do not meet in one task. Their members are
dealt to slices and every slice gets a copy of one representative: who is near
it hangs together with it and needs no other comparison. The others, usually
few, are dealt to blocks, and each pair of a block and a slice is a group of
its own. So the work is linear in a group whose members resemble its
representative, no task holds an unbounded group, and no pair is left out.

Defined cases
    null text, no words: empty set, linked with nothing. fewer than five words: the whole sequence is one shingle.
    null id: ignored when the smallest id is taken; a component of null ids only has component_id null.
    repeated rows: same class. very long texts: one set each, read whole. empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import flag_keys, join_by_key, keep_rows, small_batches
from .graph import components
from .textbytes import SPACE_WORDS, Words, batch_words, hash_words, mix, shingle_hashes

SHINGLE = 5
PERCENT = 75            # links: 100 * intersection >= PERCENT * union
PERMUTATIONS = 64
ROWS_PER_BAND = 4
BUCKET_ROWS = 8_192     # classes of a bucket (shingles of a family) that meets whole in one task
FAMILY_SHINGLES = 32_768
SLICES = 4              # a slice is the bound's SLICES-th part
BLOCK_SLICES = 64       # slices of a block of members that are compared with all others
_WORK = 1 << 15         # shingles hashed at a time


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def text_shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): shingles of text i are hashes[first[i]:first[i + 1]]."""
    h = w.hashes()
    n_words = np.diff(w.first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    first = np.r_[0, np.cumsum(counts)]
    sh = shingle_hashes(h, size)
    text = np.repeat(np.arange(len(counts)), counts)
    src = w.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    out = np.empty(len(src), dtype=np.uint64)
    long = n_words[text] >= size
    out[long] = sh[src[long]]
    for i in np.flatnonzero(~long):                # texts of fewer words: one shingle, the whole sequence
        t = text[i]
        out[i] = shingle_hashes(h[w.first[t]:w.first[t + 1]], int(n_words[t]))[0]
    return out, first


def min_max(sh: np.ndarray, first: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Signature (texts x 2 len(mult)): minimum and maximum per permutation. Every text has a shingle."""
    n = len(first) - 1
    out = np.empty((n, 2 * len(mult)), dtype=np.uint64)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(first, first[i] + _WORK, side="right")) - 1, i + 1)
        x = sh[first[i]:first[j]]
        at = (first[i:j] - first[i]).astype(np.int64)
        y = np.empty_like(x)
        for p, a in enumerate(mult):
            np.multiply(x, a, out=y)
            out[i:j, 2 * p] = np.minimum.reduceat(y, at)
            out[i:j, 2 * p + 1] = np.maximum.reduceat(y, at)
        i = j
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band's number is part of it."""
    n, k = sig.shape
    bands = sig[:, :k - k % rows].reshape(n, -1, rows)
    out = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(rows):
        out = mix(out ^ bands[:, :, r])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, permutations: int, rows_per_band: int,
               shingle: int) -> DataFrame:
    """(rid, doc_id, th, n, lo, hi, bands, sketch) per row; no bands for an empty set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        mult = multipliers(permutations)
        for b in batches:
            for w in batch_words(b.column(3), SPACE_WORDS):
                sh, first = text_shingles(w, shingle)
                n = w.hi - w.lo
                size, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for t in range(n):
                    u = np.unique(sh[first[t]:first[t + 1]])
                    size[t], lo[t], hi[t] = len(u), mix(u).sum(), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum()
                some = np.flatnonzero(size > 0)
                bands: list = [[]] * n
                sketch: list = [None] * n
                if len(some):
                    sig = min_max(sh, np.r_[first[some], first[-1]], mult)
                    keys = band_keys(sig, rows_per_band).view(np.int64)
                    low = mix(sig).astype(np.uint8)
                    for k, t in enumerate(some.tolist()):
                        bands[t], sketch[t] = keys[k], low[k].tobytes()
                head = [b.column(k).slice(w.lo, n) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(size), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                     pa.array(bands, type=pa.list_(pa.int64())), pa.array(sketch, type=pa.binary())],
                    names=["rid", "doc_id", "th", "n", "lo", "hi", "bands", "sketch"])
    src = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"),
                      F.xxhash64(docs[text_col]).alias("th"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"rid bigint, doc_id {id_type}, th bigint, n bigint, lo bigint, hi bigint, "
                               "bands array<bigint>, sketch binary")


class _Forest:
    """Union-find over 0 .. n-1 that records the links it needed."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = r[i]
        return int(i)

    def join(self, i: int, others) -> None:
        for j in others:
            a, b = self.find(i), self.find(int(j))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((i, int(j)))


def link_group(n: int, queries, near, tied=()) -> list[tuple[int, int]]:
    """Forest of the links that ``near(i)`` finds on 0 .. n-1, asking for as few of ``queries`` as needed.

    ``tied`` hang together already; without them the first query gathers a
    component. Whoever is not in that component when visited is compared with
    all others, so every pair with a query has been compared unless both ends
    are in the component.
    """
    f = _Forest(n)
    if len(tied):
        f.root[tied] = first = min(tied)
    else:
        first = queries[0]
        f.join(first, near(first))
    for i in queries:
        if f.find(i) != f.find(first):
            f.join(i, near(i))
    return f.links


def _sorted_groups(batches, keys: int):
    """Yield (tables of one group) from batches sorted by their first ``keys`` columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(keys)])
        cuts = np.r_[0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, b.num_rows]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(k[:, s].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_LINKS = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _whole(graph):
    """Links of a group that is here whole."""
    def link(t: pa.Table):
        node, near, order = graph(t)
        return [(node[i], node[j]) for i, j in link_group(len(node), order(), near)] if len(node) > 1 else []
    return link


def _star(graph):
    """Links of a slice's members to the representative."""
    def link(t: pa.Table):
        node, near, _ = graph(t)
        if len(node) < 2:
            return []
        rep = t.column("rep")[0].as_py()
        return [(rep, node[j]) for j in near(int(np.searchsorted(node, rep)))]
    return link


def _rest(graph):
    """Links between a block's members that the representative left over and all members of a slice."""
    def link(t: pa.Table):
        node, near, _ = graph(t)
        at = np.searchsorted(node, t.column("node").to_numpy())
        left, query = np.zeros(len(node), bool), np.zeros(len(node), bool)
        left[at[t.column("left").to_numpy()]] = True
        query[at[t.column("query").to_numpy()]] = True
        if len(node) < 2 or not query.any():
            return []
        links = link_group(len(node), np.flatnonzero(query).tolist(), near, np.flatnonzero(~left))
        return [(node[i], node[j]) for i, j in links]
    return link


def _link_batches(groups, link):
    rows: list[tuple[int, int, int]] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))],
                                          schema=_LINKS)
    for t in groups:
        g = t.column("g")[0].as_py()
        rows += [(g, int(x), int(y)) for x, y in link(t)]
        if len(rows) > 50_000:
            yield batch()
            rows = []
    yield batch()


def _linked(rows: DataFrame, keys: list[str], link) -> DataFrame:
    """(g, a, b): what ``link`` finds in each group of ``keys``."""
    n = len(keys)
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(lambda it: _link_batches(_sorted_groups(it, n), link), "g bigint, a bigint, b bigint"))


def group_links(who: DataFrame, groups: DataFrame, bound: int, rows_of, graph, name: str) -> DataFrame:
    """(a, b): a forest of the links inside each group, every pair judged by ``graph``.

    who: g, node and what ``rows_of`` needs, one narrow row per member.
    groups: g, rep (a member), members, weight, a written table. ``rows_of``
    adds to rows of ``who`` what ``graph`` reads and keeps all but its own
    columns; it is called with the rows of small and of large groups apart, so
    wide columns are fetched once. Groups of more than ``bound`` weight go
    through their representative, see the module's notes.
    """
    is_big = F.col("weight") > bound
    small = rows_of(who.join(groups.where(~is_big).select("g"), "g"))
    found = materialize(_linked(small, ["g"], _whole(graph)).select("a", "b").distinct(), f"minmax-{name}-links")
    big = groups.where(is_big)
    if big.isEmpty():
        return found
    per = max(bound // SLICES, 1)
    slices = F.least(F.ceil(F.col("weight") / per), F.col("members"))
    rows = materialize(rows_of(who.join(big.select("g", "rep", slices.alias("slices")), "g")), f"minmax-{name}-big")
    mine = F.pmod(F.xxhash64("node"), F.col("slices"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)
    dealt = rows.withColumn("sl", F.explode(F.when(F.col("node") == F.col("rep"), every).otherwise(F.array(mine))))
    star = materialize(_linked(dealt.drop("slices"), ["g", "sl"], _star(graph)), f"minmax-{name}-star")
    left = materialize(rows.where("node <> rep").select("g", "node").join(
        star.select("g", F.col("b").alias("node")), ["g", "node"], "left_anti"), f"minmax-{name}-left")
    # few members left: they go to every slice; many: to few, large slices, so that no more than a copy of the group moves
    share = F.col("n_left") / F.col("members")
    least = F.ceil(F.col("weight") / (per * BLOCK_SLICES))
    blocks = left.groupBy("g").agg(F.count(F.lit(1)).alias("n_left")).join(big, "g").select(
        "g", F.ceil(share * F.col("weight") / (per * BLOCK_SLICES)).alias("blocks"),
        F.least(slices, F.greatest(least, F.floor(1 / share))).alias("slices"))
    again = rows.drop("rep", "slices").join(blocks, "g").join(left.withColumn("left", F.lit(True)), ["g", "node"], "left").withColumn(
        "left", F.coalesce("left", F.lit(False)))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    members = again.withColumn("sl", mine).withColumn(
        "bl", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("query", F.lit(False))
    queries = again.where("left").withColumn("bl", block).withColumn("sl", F.explode(every)).withColumn("query", F.lit(True))
    both = members.unionByName(queries).drop("slices", "blocks")
    rest = materialize(_linked(both, ["g", "sl", "bl"], _rest(graph)), f"minmax-{name}-rest")
    return found.unionByName(star.select("a", "b")).unionByName(rest.select("a", "b"))


def _sketch_graph(least: int):
    """Members of a bucket are near when their sketches agree in ``least`` bytes and their sizes allow a link."""
    def graph(g: pa.Table):
        node, at = np.unique(g.column("node").to_numpy(), return_index=True)
        raw = g.column("sketch").combine_chunks()
        sk = np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        n = g.column("n").to_numpy()[at]

        def near(i):
            fit = (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
            hit = np.flatnonzero(fit)
            hit = hit[(sk[hit] == sk[i]).sum(axis=1) >= least]
            return hit[hit != i]

        def order():            # the class closest to the bucket's most common bytes goes first
            if len(node) < 3:
                return list(range(len(node)))
            common = np.array([np.bincount(sk[:, c], minlength=256).argmax() for c in range(sk.shape[1])], dtype=np.uint8)
            return np.argsort(-(sk == common).sum(axis=1), kind="stable").tolist()
        return node, near, order
    return graph


def _set_graph(shingle: int, percent: int):
    """Members of a family are near when their full sets are similar enough."""
    def graph(g: pa.Table):
        node, at = np.unique(g.column("node").to_numpy(), return_index=True)
        text = g.column("text").combine_chunks().take(pa.array(at))
        parts, sizes = [], []
        for w in batch_words(text, SPACE_WORDS):
            sh, first = text_shingles(w, shingle)
            for t in range(w.hi - w.lo):
                u = np.unique(sh[first[t]:first[t + 1]])
                parts.append(u)
                sizes.append(len(u))
        n = np.array(sizes, dtype=np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        vocab, term = np.unique(np.concatenate(parts), return_inverse=True)
        term = term.astype(np.int32)
        del parts
        by_term = np.argsort(term, kind="stable")
        holders = owner[by_term].astype(np.int32)
        del by_term
        df = np.bincount(term, minlength=len(vocab))
        begin = np.r_[0, np.cumsum(df)]
        off = np.r_[0, np.cumsum(n)]

        def near(i):
            t = term[off[i]:off[i + 1]]
            t = t[df[t] > 1]
            m = df[t]
            if not len(m):
                return []
            pick = np.repeat(begin[t] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            both = np.bincount(holders[pick], minlength=len(n))
            hit = np.flatnonzero(100 * both >= percent * (n + n[i] - both))
            return hit[(hit != i) & (both[hit] > 0)]

        def order():            # the class whose shingles are the most common goes first
            weight = np.bincount(owner, weights=df[term], minlength=len(n)) / np.maximum(n, 1)
            return np.argsort(-weight, kind="stable").tolist()
        return node, near, order
    return graph


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS,
            rows_per_band: int = ROWS_PER_BAND, percent: int = PERCENT, shingle: int = SHINGLE,
            bucket_rows: int = BUCKET_ROWS, family_shingles: int = FAMILY_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(rows, comps).

    rows: rid, doc_id, th, n, lo, hi per document row. comps: n, lo, hi,
    members, node, min_id, component_id per class of equal sets.
    """
    small_batches(docs.sparkSession)
    sig = materialize(signatures(docs, id_col, text_col, permutations, rows_per_band, shingle), "minmax-sig")
    rep = F.min_by(F.struct("doc_id", "th", "bands", "sketch"), "rid")
    cls = materialize(sig.where("n > 0").groupBy("n", "lo", "hi").agg(
        F.count(F.lit(1)).alias("members"), F.min("rid").alias("node"), F.min("doc_id").alias("min_id"),
        rep.alias("rep")), "minmax-classes")

    # buckets with at least two classes
    at = cls.select(F.explode("rep.bands").alias("g"), "node")
    buckets = materialize(at.groupBy("g").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("members"))
                          .where("members > 1").withColumn("weight", F.col("members")), "minmax-buckets")
    least = permutations * 2 * percent * 2 // 300        # half of the bytes at 75 percent
    sketches = cls.select("node", "n", F.col("rep.sketch").alias("sketch"))
    tied = materialize(group_links(at, buckets, bucket_rows, lambda who: who.join(sketches, "node"),
                                   _sketch_graph(least), "bucket").distinct(), "minmax-tied")
    family = components(tied)

    # families verify full sets; texts are read again for their classes only
    degree = tied.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("ties"))
    of = materialize(family.select(F.col("comp").alias("g"), "node").join(
        cls.select("node", "n", F.col("rep.doc_id").alias("v_doc"), F.col("rep.th").alias("v_th")), "node").join(
        degree, "node"), "minmax-families")
    families = materialize(of.groupBy("g").agg(
        F.max_by("node", F.struct("ties", "node")).alias("rep"), F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("weight")), "minmax-family-sizes")
    src = docs.select(docs[id_col].alias("t_doc"), F.xxhash64(docs[text_col]).alias("t_th"),
                      docs[text_col].cast("string").alias("text"))

    def with_texts(who: DataFrame) -> DataFrame:
        here = flag_keys(src, F.xxhash64("t_doc", "t_th"), who, F.xxhash64("v_doc", "v_th")).where("_in").drop("_in")
        return here.join(who, F.col("t_doc").eqNullSafe(F.col("v_doc")) & (F.col("t_th") == F.col("v_th"))).drop(
            "t_doc", "t_th", "v_doc", "v_th")
    links = group_links(of.drop("n", "ties"), families, family_shingles, with_texts, _set_graph(shingle, percent), "family")
    comp = components(links.distinct())
    named = (cls.select("n", "lo", "hi", "members", "node", "min_id").join(comp, "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    smallest = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    return sig.select("rid", "doc_id", "th", "n", "lo", "hi"), named.join(smallest, "comp").drop("comp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: one row per document row; ``th`` is xxhash64 of the text."""
    rows, comps = classes(docs, id_col, text_col, **options)
    comps = materialize(comps.select("n", "lo", "hi", "members", "component_id"), "minmax-comps")
    total = rows.count()
    full = join_by_key(rows.where("n > 0"), comps, ["n", "lo", "hi"], "members", total)
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "th", F.col("n").alias("n_shingles"), "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return full.select(cols).unionByName(empty.select(cols))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents whose id is the smallest of their group, all columns unchanged."""
    v = materialize(near_groups(docs, id_col, text_col, **options).where("not kept").select("doc_id", "th"), "minmax-dropped")
    return keep_rows(docs, v, {"doc_id": docs[id_col], "th": F.xxhash64(docs[text_col])})
