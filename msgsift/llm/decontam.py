"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window). Each window is a set of ``shingle``-word shingles and must be
contained whole (containment 1), so the necessary prefix of the set join is its
single rarest shingle, by count over all documents. Steps:

1. One pass over the documents keeps the places whose shingle may belong to an
   item (a fixed-size bit filter built from the items, no false negatives),
   with the words around them.
2. Their counts order the shingles by rarity; each window is represented by its
   rarest one.
3. Places join windows on that shingle. Its position inside the window gives
   the only possible start (positional bound), which must leave room for the
   whole window (length bound).
4. The candidate's words are compared with the window's words exactly.

The filter has ``2 ** filter_bits`` bits whatever the benchmark's size: a large
benchmark passes more places on, never fewer. Nothing else leaves the tasks.

Defined cases
    null or wordless text: 0 words, not contaminated. null or wordless item: no window.
    null item id: counts as the empty id. items that share an id: one id.
    repeated documents: each row gets its own, equal result. empty benchmark: nothing is hit.
    very long texts: read whole; only the places found are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches
from .textbytes import ALNUM_WORDS, batch_words, shingle_hashes

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 24     # 2 MiB filter sent to the tasks
SEGMENT = 16         # found places kept together with one stretch of words

_SEGMENT_TYPE = "array<struct<pos:bigint,first:int,size:int,hs:array<bigint>,words:array<string>>>"


def item_windows(bench: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, wlen, size, words, hs): every window of every item; hs are its shingles in order."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows: dict[str, list] = {"item": [], "wlen": [], "size": [], "words": [], "hs": []}
            for w in batch_words(b.column(1), ALNUM_WORDS):
                h = w.hashes()
                for t in range(w.hi - w.lo):
                    a, z = int(w.first[t]), int(w.first[t + 1])
                    n = min(z - a, window)
                    if n == 0:
                        continue
                    size = min(n, shingle)
                    hs = shingle_hashes(h[a:z], size).view(np.int64)
                    words = [bytes(w.buf[s:e]).decode("utf-8", "replace") for s, e in zip(w.starts[a:z], w.ends[a:z])]
                    for k in range(z - a - n + 1):
                        for name, v in (("item", ids[w.lo + t] or ""), ("wlen", n), ("size", size),
                                        ("words", words[k:k + n]), ("hs", hs[k:k + n - size + 1].tolist())):
                            rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_WINDOW_ARROW)
    return (bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "item string, wlen int, size int, words array<string>, hs array<bigint>"))


_WINDOW_ARROW = pa.schema([("item", pa.string()), ("wlen", pa.int32()), ("size", pa.int32()),
                           ("words", pa.list_(pa.string())), ("hs", pa.list_(pa.int64()))])


def _probes(h, bits: int):
    """Two bit positions of a shingle hash (columns)."""
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - bits)]


def bit_filter(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bits of all shingle hashes ``h``: at most 2^(bits - 6) words reach the driver."""
    pos = shingles.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("p"))
    words = (pos.groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect())
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[[r["w"] for r in words]] = [r["v"] for r in words]
    return out.view(np.uint64)


def _may_hold(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Positions of ``h`` that pass both probes."""
    def probe(p):
        return (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    one = np.flatnonzero(probe(h & np.uint64((1 << bits) - 1)))
    return one[probe(h[one] >> np.uint64(64 - bits))]


def find_places(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, bits: int,
                shortest_run: dict[int, int], window: int) -> DataFrame:
    """(rid, doc_id, th, n_words, segs): per row its word count and the stretches that may belong to items.

    ``shortest_run``: per shingle length in use, how many consecutive shingles
    its shortest window has; shorter runs cannot hold a window.
    """
    small_batches(docs.sparkSession)
    bm = docs.sparkSession.sparkContext.broadcast(bitmap)

    def segments(w, h):
        out: list[list] = [[] for _ in range(w.hi - w.lo)]
        text = w.text_of()
        for size, least in shortest_run.items():
            sh = shingle_hashes(h, size)
            at = _may_hold(bm.value, bits, sh)
            at = at[text[at] == text[at + size - 1]]
            if not len(at):
                continue
            new = np.r_[True, (np.diff(at) > 1) | (np.diff(text[at]) > 0)]
            begins = np.flatnonzero(new)
            lens = np.diff(np.r_[begins, len(at)])
            for b, n in zip(begins[lens >= least].tolist(), lens[lens >= least].tolist()):
                t = int(text[at[b]])
                lo, hi = int(at[b]), int(at[b]) + n - 1 + size      # words of the run
                for s in range(0, n, SEGMENT):
                    p = lo + s
                    k = min(SEGMENT, n - s)
                    a, z = max(lo, p - window + size), min(hi, p + k - 1 + window)
                    out[t].append({"pos": a - int(w.first[t]), "first": p - a, "size": size,
                                   "hs": sh[p:p + k].view(np.int64).tolist(), "words": [
                                       bytes(w.buf[x:y]).decode("utf-8", "replace")
                                       for x, y in zip(w.starts[a:z].tolist(), w.ends[a:z].tolist())]})
        return out

    def run(batches):
        seg = pa.list_(pa.struct([("pos", pa.int64()), ("first", pa.int32()), ("size", pa.int32()),
                                  ("hs", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))]))
        for b in batches:
            for w in batch_words(b.column(3), ALNUM_WORDS):
                n = pa.array(np.diff(w.first).astype(np.int64))
                segs = segments(w, w.hashes()) if shortest_run else [[] for _ in range(w.hi - w.lo)]
                head = [b.column(k).slice(w.lo, w.hi - w.lo) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*head, n, pa.array(segs, type=seg)],
                                                 names=["rid", "doc_id", "th", "n_words", "segs"])
    src = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"),
                      F.xxhash64(docs[text_col]).alias("th"), docs[text_col].cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"rid bigint, doc_id {id_type}, th bigint, n_words bigint, segs {_SEGMENT_TYPE}")


def find_windows(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, members).

    rows: rid, doc_id, th, n_words, one per document row. hits: rid, wid, start,
    wlen, one per occurrence of a window (start counts words from 0).
    members: wid, item, the items of each window.
    """
    from pyspark.sql import Window
    wins = materialize(item_windows(bench, item_id_col, item_text_col, window, shingle), "decon-windows")
    distinct = materialize(wins.groupBy("words", "wlen", "size").agg(F.first("hs").alias("hs"))
                           .withColumn("wid", F.monotonically_increasing_id()), "decon-distinct")
    members = wins.join(distinct.select("words", "wid"), "words").select("wid", "item").distinct()

    shingles = distinct.select("size", F.explode("hs").alias("h")).distinct()
    bitmap = bit_filter(shingles, filter_bits)
    shortest = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(
        F.min(F.size("hs")).alias("n")).collect()}                                  # at most `shingle` rows
    rows = materialize(find_places(docs, id_col, text_col, bitmap, filter_bits, shortest, window), "decon-places")

    seg = rows.select("rid", F.explode("segs").alias("g"))
    places = seg.select("rid", F.col("g.size").alias("size"), F.col("g.pos").alias("pos"), F.col("g.first").alias("first"),
                        F.col("g.words").alias("around"), F.posexplode("g.hs").alias("k", "h"))
    # rarity over all documents, then the rarest shingle of each window; a shingle never seen rules the window out
    counts = rows.select(F.explode("segs").alias("g")).select(F.explode("g.hs").alias("h")).groupBy("h").count()
    per = distinct.select("wid", "wlen", "size", "words", F.posexplode("hs").alias("off", "h"))
    rare = Window.partitionBy("wid").orderBy(F.col("count").asc_nulls_first(), "h", "off")
    prefix = materialize(per.join(counts, "h", "left").withColumn("r", F.row_number().over(rare))
                         .where("r = 1 and count is not null").drop("r", "count"), "decon-prefix")

    cand = places.join(prefix, ["h", "size"]).withColumn("at", F.col("first") + F.col("k") - F.col("off"))
    hits = (cand.where("at >= 0 and at + wlen <= size(around)")
            .where(F.slice("around", F.col("at") + 1, F.col("wlen")) == F.col("words"))
            .select("rid", "wid", (F.col("pos") + F.col("at")).alias("start"), F.col("wlen").cast("bigint").alias("wlen")))
    return rows.drop("segs"), hits, members


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row.

    ``th`` is xxhash64 of the text. Contaminated: at least one word is hit and
    the hit words are at least a twentieth of all words.
    """
    rows, hits, members = find_windows(docs, bench, **options)
    hits = materialize(hits, "decon-hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("wlen")).alias("end")))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0).cast("bigint")))
                              .alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"])
    words = hits.groupBy("rid").agg(covered.alias("n_hit"))
    items = (hits.select("rid", "wid").distinct().join(members, "wid").groupBy("rid")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = rows.join(words, "rid", "left").join(items, "rid", "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
