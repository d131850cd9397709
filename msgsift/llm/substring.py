"""Substring dedup by recompression.

Removes every word that lies in a window of ``window`` words whose word
sequence starts at another place too, in the same or any other text.

1. Each text is recompressed (``recompress.py``): runs and pairs of symbols are
   named round by round. Names are hashes of their content, so a global naming
   needs no exchange, and equal windows hold equal symbols wherever they are.
2. A window is represented by one of its high-level symbols, chosen from its
   own words alone. Neighbouring windows with the same symbol are one range,
   one entry for about ten words.
3. Entries are counted over all texts, twice: by symbol (the words it rests
   on) and by all words of the range. A symbol seen once clears its windows. A
   range seen twice is a repeat as a whole. What is left, ranges that share a
   symbol but not all of their words, are the borders of repeats.
4. The windows of those ranges, and of one example of each repeated range that
   shares a symbol with them, are counted one by one. This gives every repeat
   to the word.

Only digests are exchanged: a task packs the distinct entries of about
``CHUNK_BYTES`` of text into one block per owner, so a passage that is in a
third of all texts reaches its owner once per block, not once per text. Texts
move only if they have borders to look at or lose a part of their words.
Sequences are compared by 128 bits: two independent 64-bit hashes.

Defined cases
    null, empty or wordless text: no words, nothing removed, an empty text is kept.
    shorter texts than a window: kept. null id: passed on. empty table: no rows.
    repeated rows and equal texts: each of at least a window loses all its words.
    overlapping places of one text count as two. ties between symbols: the first in the window.
    very long texts: worked on whole by one task. further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import flag_keys, small_batches
from .recompress import anchors, rounds
from .textbytes import Words, batch_words, mix
from .wordstream import PLAIN_WORDS, covered, kept_digests, kept_texts

WINDOW = 35
ROUNDS = 5                 # symbols of four to five words, resting on about thirteen
CHUNK_BYTES = 16 << 20     # text whose entries are packed together
OWNERS_PER_PARTITION = 4   # ranges of digests, per shuffle partition of the session

_SPANS = "array<struct<start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BLOCKS = "array<struct<kind:int,owner:int,data:binary>>"
_BLOCKS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("owner", pa.int32()), ("data", pa.binary())]))

SYMBOLS, RANGES, WINDOWS = 0, 1, 2       # kinds of entries: (key, range), (key, range), (hash, hash)

_FACTORS = (0x9DDFEA08EB382D69, 0xD6E8FEB86659FD93)      # odd, one per hash
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


class RangeHash:
    """Hash of any range of a slice's words, from running sums of a polynomial over the words' hashes."""

    def __init__(self, h: np.ndarray, factor: int):
        n = len(h) + 1
        self._back = _powers(pow(factor, -1, 1 << 64), n)
        self._sum = np.zeros(n, dtype=np.uint64)
        np.cumsum(h * _powers(factor, n)[:-1], out=self._sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sum[b] - self._sum[a]) * self._back[a] + (b - a).astype(np.uint64) * _SALT)


def _powers(factor: int, n: int) -> np.ndarray:
    p = np.full(n, factor, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class SliceHash:
    """Two independent range hashes of a slice's words."""

    def __init__(self, w: Words):
        h = w.hashes()
        self.words = h
        self.one, self.two = RangeHash(h, _FACTORS[0]), RangeHash(second_hashes(w), _FACTORS[1])


def second_hashes(w: Words) -> np.ndarray:
    """Another 64-bit hash of each word: a polynomial over its bytes with another factor."""
    out = np.zeros(len(w.starts), dtype=np.uint64)
    size = w.ends - w.starts
    at, left = np.arange(len(size)), w.starts.copy()
    while len(at):                                         # byte by byte of all words that still have one
        out[at] = (out[at] + w.buf[left].astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        left = left + 1
        more = left < w.ends[at]
        at, left = at[more], left[more]
    return mix(out)


def _pack(kind: int, a: np.ndarray, b: np.ndarray, owners: int) -> tuple[list[dict], np.ndarray]:
    """Blocks of the distinct entries (a, b, whether more than once) per owner, and each entry's place among them all."""
    by = (a if kind == SYMBOLS else mix(a + b * _SALT)) >> np.uint64(32)
    owner = ((by * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((b, a, owner))
    a, b, owner = a[order], b[order], owner[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(a)]
    at = np.flatnonzero(new)
    more = (np.diff(np.r_[at, len(a)]) > 1).astype(np.uint8)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    a, b, owner = a[at], b[at], owner[at]
    cut = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
    blocks = [{"kind": kind, "owner": int(owner[s]), "data": a[s:e].tobytes() + b[s:e].tobytes() + more[s:e].tobytes()}
              for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()) if e > s]
    return blocks, place


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    return (np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n))


def _settle(group: pa.Table) -> pa.Table:
    """Flags of one owner's blocks of one kind. Bit 0: the entry is elsewhere too (for a symbol: in another range).
    Bit 1: the block is the first to hold it."""
    group = group.sort_by("chunk")
    parts = [_unpack(d) for d in group.column("data").to_pylist()]
    a, b, more = (np.concatenate([p[k] for p in parts]) for k in range(3))
    kind = group.column("kind")[0].as_py()
    order = np.lexsort((b, a))                              # stable: blocks stay in order
    new_a = np.r_[True, a[order][1:] != a[order][:-1]]
    new = new_a | np.r_[True, b[order][1:] != b[order][:-1]]
    if kind == SYMBOLS:                                     # different ranges of one symbol
        which = np.cumsum(new_a) - 1
        yes = np.bincount(which, weights=new)[which] > 1
    else:
        which = np.cumsum(new) - 1
        yes = np.bincount(which, weights=1 + more[order])[which] > 1
    flags = np.empty(len(a), dtype=np.uint8)
    flags[order] = yes + 2 * new
    cut = np.cumsum([0] + [len(p[0]) for p in parts])
    return pa.table({"chunk": group.column("chunk"), "kind": group.column("kind"), "owner": group.column("owner"),
                     "flags": pa.array([flags[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary())})


def _answers(blocks: DataFrame) -> DataFrame:
    """(chunk, kind, owner, flags) for the blocks of all chunks."""
    dealt = blocks.select("chunk", F.explode("blocks").alias("x")).select("chunk", "x.*")
    return dealt.groupBy("kind", "owner").applyInArrow(_settle, "chunk bigint, kind int, owner int, flags binary")


def _flags_of(answers: pa.Table, kind: int) -> np.ndarray:
    """All flags of a chunk's entries of a kind, in the order of :func:`_pack`."""
    mine = answers.filter(pa.array(answers.column("kind").to_numpy() == kind)).sort_by("owner")
    return np.frombuffer(b"".join(mine.column("flags").to_pylist()), dtype=np.uint8)


def _starts(w: Words, window: int) -> np.ndarray:
    """First words of all windows of a slice."""
    return np.flatnonzero(np.arange(len(w.starts)) + window <= np.repeat(w.first[1:], np.diff(w.first)))


def _entries(w: Words, window: int, n_rounds: int):
    """(text, first start, windows, symbol key, range hash) of each range of a slice."""
    s = _starts(w, window)
    hs = SliceHash(w)
    text = w.text_of()
    levels = rounds(hs.words, text, n_rounds)
    level, symbol = anchors(levels, s, window)
    new = np.r_[True, (np.diff(s) > 1) | (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1])][:len(s)]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(s)])
    a, lv, sy = s[at], level[at], symbol[at]
    key, where = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.int64)
    for k, x in enumerate(levels):
        sel = np.flatnonzero(lv == k)
        y = sy[sel]
        key[sel] = mix(hs.one.of(x.lo[y], x.hi[y]) + x.name[y])
        where[sel] = x.start[y] - a[sel]
    whole = mix(hs.two.of(a, a + n + window - 1) + where.astype(np.uint64) * _SALT)
    return text[a] if len(a) else a, a, n, key, whole


def _merge(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Ranges in order of their start, the touching ones made one."""
    if not len(start):
        return []
    far = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
    return [{"start": a, "end": z} for a, z in zip(start[new].tolist(), far[np.r_[new[1:], len(far)] - 1].tolist())]


def _chunk_id(k: int) -> int:
    return (TaskContext.get().partitionId() << 32) + k


def _survey(docs: DataFrame, window: int, n_rounds: int, owners: int, chunk_bytes: int) -> DataFrame:
    """One row per chunk: what its texts are, and the blocks of their entries."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, k, size, arrow_id = [], 0, 0, None

        def close():
            counts = [x[0] for x in held]
            text = np.concatenate([x[1] + off for x, off in zip(held, np.cumsum([0] + counts[:-1]))])
            key, whole = (np.concatenate([x[c] for x in held]) for c in (3, 4))
            blocks, sym = _pack(SYMBOLS, key, whole, owners)
            more, rng = _pack(RANGES, key, whole, owners)
            ranges = np.bincount(text, minlength=sum(counts)).astype(np.int64)
            cols = [pa.array([_chunk_id(k)], pa.int64())]
            for c in range(4):                              # doc_id, th, n_words, digest
                whole_col = pa.concat_arrays([x[5][c] for x in held])
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(whole_col)], pa.int32()), whole_col))
            for values in (ranges.astype(np.int32), np.concatenate([x[2] for x in held]).astype(np.uint16),
                           sym.astype(np.int32), rng.astype(np.int32)):
                cols.append(pa.array([values.tobytes()], pa.binary()))
            cols.append(pa.array([blocks + more], _BLOCKS_ARROW))
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_id", "th", "n_words", "digest", "ranges", "len", "sym",
                                                           "rng", "blocks"])
        for b in batches:
            for w in batch_words(b.column(2), PLAIN_WORDS):
                text, _, n, key, whole = _entries(w, window, n_rounds)
                info = [b.column(c).slice(w.lo, w.hi - w.lo) for c in (0, 1)]
                info += [pa.array(np.diff(w.first).astype(np.int64)), pa.array(kept_digests(w, np.ones(len(w.starts), dtype=bool)))]
                held.append((w.hi - w.lo, text, n, key, whole, info))
                size += len(w.buf)
                if size >= chunk_bytes:
                    yield close()
                    held, k, size = [], k + 1, 0
        if held:
            yield close()

    return docs.mapInArrow(run, f"chunk bigint, doc_id array<{doc_type}>, th array<bigint>, n_words array<bigint>, digest array<string>, "
                                f"ranges binary, len binary, sym binary, rng binary, blocks {_BLOCKS}")


def _judge(window: int):
    """Per text of a chunk: the repeated spans, and the ranges whose windows must be looked at one by one."""
    def run(key, mine: pa.Table, answers: pa.Table) -> pa.Table:
        sym_flags, rng_flags = _flags_of(answers, SYMBOLS), _flags_of(answers, RANGES)
        docs, ths, words, digests = (mine.column(c).combine_chunks().flatten() if mine.num_rows else None
                                     for c in ("doc_id", "th", "n_words", "digest"))
        get = lambda c, t: np.frombuffer(mine.column(c)[0].as_py(), dtype=t).astype(np.int64)
        per, n, sym, rng = get("ranges", np.int32), get("len", np.uint16), get("sym", np.int32), get("rng", np.int32)
        text = np.repeat(np.arange(len(per)), per)
        upto = np.r_[0, np.cumsum(n)]
        start = upto[:-1] - upto[np.r_[0, np.cumsum(per)][text]]          # windows of a text follow one another
        twice = rng_flags[rng] & 1 > 0
        first = np.zeros(len(rng), dtype=bool)
        first[np.unique(rng, return_index=True)[1]] = True                # one example of each range in this chunk
        example = first & (rng_flags[rng] & 2 > 0)
        look = (sym_flags[sym] & 1 > 0) & (~twice | example)
        spans, fine = [], []
        for lo, hi in zip(np.r_[0, np.cumsum(per)][:-1].tolist(), np.cumsum(per).tolist()):
            t, f = twice[lo:hi], look[lo:hi]
            a, z = start[lo:hi], start[lo:hi] + n[lo:hi]
            spans.append(_merge(a[t], z[t] + window - 1) if t.any() else [])
            fine.append(_merge(a[f], z[f]) if f.any() else [])
        return pa.table({"doc_id": docs, "th": ths, "n_words": words, "digest": digests,
                         "spans": pa.array(spans, _SPANS_ARROW), "fine": pa.array(fine, _SPANS_ARROW)})
    return run


def _windows(work: DataFrame, window: int, owners: int, chunk_bytes: int) -> DataFrame:
    """One row per chunk of the texts with ranges to look at: the blocks of the single windows in them."""
    def run(batches):
        held, k, size = [], 0, 0

        def close():
            wid = np.concatenate([x[0] for x in held])
            start, a, z = (np.concatenate([x[c] for x in held]) for c in (1, 2, 3))
            blocks, place = _pack(WINDOWS, a, z, owners)
            return pa.RecordBatch.from_arrays(
                [pa.array([_chunk_id(k)], pa.int64()), *[pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in (wid, start, place)],
                 pa.array([blocks], _BLOCKS_ARROW)], names=["chunk", "wid", "start", "place", "blocks"])
        for b in batches:
            ids, fine = b.column(0).to_numpy(), b.column(2)
            for w in batch_words(b.column(1), PLAIN_WORDS):
                look = fine.slice(w.lo, w.hi - w.lo)
                owner = np.repeat(np.arange(w.hi - w.lo), np.diff(np.asarray(look.offsets)))
                flat = look.flatten()
                a, z = (w.first[owner] + flat.field(c).to_numpy() for c in ("start", "end"))
                s = np.repeat(a, z - a) + np.arange((z - a).sum()) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
                hs = SliceHash(w)
                text = np.repeat(owner, z - a)
                held.append((ids[w.lo + text], s - w.first[text], hs.one.of(s, s + window), hs.two.of(s, s + window)))
                size += len(s) * 32
                if size >= chunk_bytes:
                    yield close()
                    held, k, size = [], k + 1, 0
        if held:
            yield close()

    return (work.where("size(fine) > 0").select("wid", "text", "fine")
            .mapInArrow(run, f"chunk bigint, wid binary, start binary, place binary, blocks {_BLOCKS}"))


def _repeated(window: int):
    """(wid, more): per text the spans of the single windows that are elsewhere too."""
    def run(key, mine: pa.Table, answers: pa.Table) -> pa.Table:
        wid, start, place = (np.frombuffer(mine.column(c)[0].as_py(), dtype=np.int64) for c in ("wid", "start", "place"))
        yes = _flags_of(answers, WINDOWS)[place] & 1 > 0
        wid, start = wid[yes], start[yes]
        order = np.lexsort((start, wid))
        wid, start = wid[order], start[order]
        cut = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]][:len(wid)])
        bounds = np.r_[cut, len(wid)].tolist()
        return pa.table({"wid": pa.array(wid[cut], pa.int64()), "more": pa.array(
            [_merge(start[a:z], start[a:z] + window) for a, z in zip(bounds[:-1], bounds[1:])], _SPANS_ARROW)})
    return run


def _rebuild(work: DataFrame, with_text: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of texts with known spans."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", *["kept_text"] * with_text]

    def run(batches):
        for b in batches:
            spans = b.column(2)
            for w in batch_words(b.column(1), PLAIN_WORDS):
                mine = spans.slice(w.lo, w.hi - w.lo)
                owner = np.repeat(np.arange(w.hi - w.lo), np.diff(np.asarray(mine.offsets)))
                flat = mine.flatten()
                gone = covered(w.first[owner] + flat.field("start").to_numpy(), w.first[owner] + flat.field("end").to_numpy(),
                               len(w.starts))
                n = np.add.reduceat(np.r_[gone, False].astype(np.int64), w.first[:-1]) * (np.diff(w.first) > 0)
                merged = [_merge(x[:, 0], x[:, 1]) for x in _pairs_of(mine)]
                out = [b.column(0).slice(w.lo, w.hi - w.lo), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n),
                       pa.array(kept_digests(w, ~gone)), pa.array(merged, _SPANS_ARROW)]
                if with_text:
                    out.append(pa.array([t.decode("utf-8", "replace") for t in kept_texts(w, ~gone)]))
                yield pa.RecordBatch.from_arrays(out, names=names)

    id_type = work.schema["doc_id"].dataType.simpleString()
    return work.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, spans {_SPANS}" + ", kept_text string" * with_text)


def _pairs_of(spans: pa.ListArray):
    """Per text its spans as an array of (start, end), by start."""
    at = np.asarray(spans.offsets)
    flat = spans.flatten()
    both = np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], axis=1).reshape(-1, 2)
    for a, z in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()):
        x = both[a:z]
        yield x[np.argsort(x[:, 0], kind="stable")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_rounds: int = ROUNDS,
                   with_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (and ``kept_text`` with ``with_text``), one row per row.

    spans: the removed ranges of words, in order. The kept text is the other
    words joined by one space.
    """
    if not 1 <= window < 1 << 16:
        raise ValueError("a window has 1 to 65,535 words")
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].cast("string").alias("text"))
    owners = max(64, OWNERS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    survey = materialize(_survey(d, window, n_rounds, owners, chunk_bytes), "substring-survey")
    answers = _answers(survey.select("chunk", "blocks"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    seen = materialize(
        survey.drop("blocks").groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInArrow(_judge(window), f"doc_id {id_type}, th bigint, n_words bigint, digest string, spans {_SPANS}, fine {_SPANS}"),
        "substring-seen")

    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    seen = seen.withColumn("n_removed", gone)
    open_rows = (F.size("fine") > 0) | ((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words")))
    if not with_text:
        done = seen.where(~open_rows)
    need = materialize(
        (seen if with_text else seen.where(open_rows)).groupBy("doc_id", "th")
        .agg(F.first("spans").alias("spans"), F.flatten(F.collect_list("fine")).alias("fine")), "substring-open")

    # only the texts that can lose a part of their words move
    theirs = need.select(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th"), "spans", "fine")
    asked = flag_keys(d, F.col("th"), theirs, F.col("n_th")).where("_in").drop("_in")
    work = materialize(asked.join(theirs, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("th") == F.col("n_th")))
                       .select(F.monotonically_increasing_id().alias("wid"), "doc_id", "text", "spans", "fine"), "substring-work")
    singles = materialize(_windows(work, window, owners, chunk_bytes), "substring-windows")
    more = (singles.drop("blocks").groupBy("chunk").cogroup(_answers(singles.select("chunk", "blocks")).groupBy("chunk"))
            .applyInArrow(_repeated(window), f"wid bigint, more {_SPANS}"))
    more = more.groupBy("wid").agg(F.flatten(F.collect_list("more")).alias("more"))
    known = work.join(more, "wid", "left").select(
        "doc_id", "text", F.concat("spans", F.coalesce("more", F.array().cast(_SPANS))).alias("spans"))
    out = _rebuild(known, with_text)
    if with_text:
        return out
    kept = F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(F.sha2(F.lit("").cast("binary"), 256))
    return out.unionByName(done.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"), "spans"))

