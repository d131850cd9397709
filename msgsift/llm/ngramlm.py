"""Bigram language model in an Elias-Fano trie, and scores of whole texts.

Unigram level: the sorted 64-bit word hashes of the training tokens, cut into
shards by their top bits. A shard is a monotone sequence in Elias-Fano form
plus its counts; a word's id is its rank. Bigram level: contexts (word ids) in
Elias-Fano form, monotone pointers to their successors, and the successors
themselves, made monotone by adding the context's place times the vocabulary
size, so a bigram is found by a successor search inside its context's range.
Probabilities and back-off weights are quantised to 1/2048 of a decade.
Levels are files in ``spark.checkpoint.dir`` that tasks map into memory (or
read, where the folder is no mounted file system).

Smoothing (Witten-Bell): p(w|h) = (c(hw) + T(h) p(w)) / (c(h) + T(h)) with T(h)
the distinct successors of h and p(w) = (c(w) + 1) / (N + V + 1). The first
token, and tokens after an unknown word, take p(w). The successors of a context
with more than ``shard_tokens / 8`` occurrences are dealt to 64 places by word
id, so a word that makes up a third of all tokens is not in one task; the
formula is the same, with c(h) and T(h) of the whole context at every place.

Data flow: one pass counts words (partial sums per slice of text, then per
task). Where there are frequent contexts, a pass over their training pairs
(distinct per slice, packed) counts T(h), at most 8 rows per ``shard_tokens``
tokens. A last pass sends every (context, word) pair once to the task that
owns it, packed per slice (sorted, as small integers, compressed). That task
builds its part of the trie from the training pairs, writes it, maps it and
scores all its pairs; packed sums per 4,096 row ids come back and are added up. What is gathered
grows with the input; nothing is pruned, capped or sampled.

Defined cases
    null or empty text: one token, the end. no training rows: N = V = 0, every token has probability 1.
    null id: training row unless the held-out remainder is 0. repeated rows: each scored and counted.
    very long texts: whole, in slices of their own. ties do not arise. empty table: no rows.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .common import crc_mod, small_batches
from .textbytes import SPACE_WORDS, batch_words, mix

END = mix(np.array([0x454E44], dtype=np.uint64))[0]     # the end token's hash
SHARD_TOKENS = 1_000_000     # pairs owned by one task
SHARD_WORDS = 1 << 20        # words of one unigram shard
BATCH_ROWS = 2_000           # rows of an Arrow batch; pairs are packed per batch
BUCKET_BITS = 12             # row ids whose scores are added up together: 4,096
GROUPS = 64                  # places that the successors of a frequent context are dealt to
STEPS = 2048                 # quantisation steps per decade


# ---- Elias-Fano ----------------------------------------------------------

class EliasFano:
    """Monotone sequence of 64-bit integers: low bits in a plain array, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        low = v & np.uint64((1 << low_bits) - 1)
        width = next(w for w in (8, 16, 32, 64) if low_bits <= w)
        hi = (v >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(hi[-1]) if n else 0) + 1, dtype=np.uint8)
        bits[hi + np.arange(n)] = 1
        return {"low": low.astype(f"uint{width}"), "high": np.packbits(bits, bitorder="little"),
                "meta": np.array([low_bits, n, len(bits)], dtype=np.int64)}

    @staticmethod
    def load(part: dict[str, np.ndarray]) -> "EliasFano":
        low_bits, n, size = (int(x) for x in part["meta"])
        ef = EliasFano()
        ef.low, ef.low_bits, ef.n = part["low"], low_bits, n
        bits = np.unpackbits(part["high"], bitorder="little")[:size]
        zeros = np.flatnonzero(bits == 0)                     # zero number b ends bucket b: values with high part <= b
        ef.ends = (zeros - np.arange(len(zeros))).astype(np.int32 if n < 1 << 31 else np.int64)
        return ef

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if none), for every x."""
        x = x.astype(np.uint64)
        b = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = b < len(self.ends)
        bb = np.where(inside, b, 0)
        lo = np.where(inside, np.where(bb > 0, self.ends[np.maximum(bb - 1, 0)], 0), self.n)
        hi = np.where(inside, self.ends[bb], self.n)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:                                            # binary search inside the bucket
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low[mid].astype(np.uint64) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def get(self, i: np.ndarray) -> np.ndarray:
        b = np.searchsorted(self.ends, i, side="right").astype(np.uint64)
        return (b << np.uint64(self.low_bits)) | self.low[i].astype(np.uint64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, -1 where it is no value."""
        i = self.successor(x)
        ok = i < self.n
        ok[ok] = self.get(i[ok]) == x[ok].astype(np.uint64)
        return np.where(ok, i, -1)


# ---- level files ---------------------------------------------------------

def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else
                                  ("file://" + uri if uri.startswith("/") else uri))


def write_level(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays; written aside and renamed, so a retried task leaves a whole file."""
    system, path = _file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    head, at = [], 0
    for k, a in arrays.items():
        head.append([k, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    h = json.dumps(head).encode().ljust(4096)
    if len(h) > 4096:
        raise ValueError("too many arrays in a level")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as f:
        f.write(h)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    system.move(tmp, path)


def map_level(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a level file: mapped into memory if it is a local path, else read."""
    from pyarrow import fs
    system, path = _file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), dtype=np.uint8)
    out = {}
    for k, kind, n, at in json.loads(bytes(raw[:4096])):
        dt = np.dtype(kind)
        out[k] = raw[4096 + at:4096 + at + n * dt.itemsize].view(dt)
    return out


def _parts(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k[len(name) + 1:]: v for k, v in arrays.items() if k.startswith(name + ".")}


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


class Unigrams:
    """All unigram shards of a model; opens a shard when it is first asked for."""

    def __init__(self, root: str, bits: int, first_id: list[int], n_tokens: int):
        self.root, self.bits, self.first_id, self.n_tokens = root, bits, first_id, n_tokens
        self.n_words = first_id[-1]
        self.total = n_tokens + self.n_words + 1
        self.split_ids, self.split_kinds = np.zeros(0, np.int64), np.zeros(0, np.int64)     # T(h) of frequent contexts
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _shard(self, s: int):
        if s not in self._open:
            a = map_level(f"{self.root}/unigram-{s}.lvl")
            self._open[s] = (EliasFano.load(_parts(a, "words")), a["counts"])
        return self._open[s]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word id per hash, ``n_words`` (the unknown word) where it has none."""
        out = np.full(len(h), self.n_words, dtype=np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s in np.unique(shard).tolist():
            if self.first_id[s] == self.first_id[s + 1]:
                continue
            at = np.flatnonzero(shard == s)
            i = self._shard(s)[0].find(h[at])
            out[at] = np.where(i >= 0, i + self.first_id[s], self.n_words)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        shard = np.searchsorted(self.first_id, ids, side="right") - 1
        for s in np.unique(shard).tolist():
            if s < len(self.first_id) - 1:
                at = np.flatnonzero(shard == s)
                out[at] = self._shard(s)[1][ids[at] - self.first_id[s]]
        return out

    def kinds(self, ids: np.ndarray) -> np.ndarray:
        """Distinct successors of frequent contexts, 0 for any other word."""
        if not len(self.split_ids):
            return np.zeros(len(ids), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.split_ids, ids), len(self.split_ids) - 1)
        return np.where(self.split_ids[at] == ids, self.split_kinds[at], 0)


# ---- training: unigram level ---------------------------------------------

def _tokens(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first of its text) of all tokens of a slice, the end token after each text's words."""
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    h = np.empty(len(text), dtype=np.uint64)
    is_end = np.zeros(len(text), dtype=bool)
    is_end[last] = True
    h[is_end] = END
    h[~is_end] = w.hashes()
    begins = np.zeros(len(text), dtype=bool)
    begins[np.r_[0, last[:-1] + 1]] = True
    return h, text, begins


def train_unigrams(src: DataFrame, root: str, shard_words: int = SHARD_WORDS) -> tuple[Unigrams, dict[str, float]]:
    """Count the training rows of ``src`` (rid, train, text) and write the unigram level."""
    def count(batches):
        for b in batches:
            for w in batch_words(b.column(0), SPACE_WORDS):
                u, c = np.unique(_tokens(w)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])
    words = materialize(src.where("train").select("text").mapInArrow(count, "h bigint, c bigint")
                        .groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    n_words, n_tokens, most = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    bits = max(3, math.ceil(math.log2(max(1, n_words) / shard_words)) if n_words else 3)
    shard = F.shiftrightunsigned("h", 64 - bits)

    def build(batches):
        held: dict[int, list] = {}
        for b in batches:
            s = b.column("s").to_numpy()
            for k in np.unique(s).tolist():
                at = s == k
                held.setdefault(k, []).append((b.column("h").to_numpy()[at].view(np.uint64), b.column("c").to_numpy()[at]))
        for k, got in held.items():
            h, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.argsort(h)
            write_level(f"{root}/unigram-{k}.lvl", {**_named("words", EliasFano.encode(h[order])),
                                                    "counts": c[order].astype(np.uint32 if c.max() < 1 << 32 else np.uint64)})
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(h)], pa.int64())], names=["s", "n"])
    sizes = {r["s"]: r["n"] for r in words.withColumn("s", shard).repartition(1 << bits, "s").select("s", "h", "c")
             .mapInArrow(build, "s bigint, n bigint").collect()}          # 2^bits rows
    first_id = [0]
    for k in range(1 << bits):
        first_id.append(first_id[-1] + sizes.get(k, 0))
    model = Unigrams(root, bits, first_id, int(n_tokens))
    return model, {"tokens": int(n_tokens), "words": int(n_words), "most": int(most)}


# ---- pairs ---------------------------------------------------------------

def group_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)


def context_key(ctx: np.ndarray, word: np.ndarray, c_ctx: np.ndarray, hot: int, unknown: int) -> np.ndarray:
    """Trie context of each pair: ctx * (GROUPS + 1), plus 1 + group where the context is frequent and the word known."""
    split = (c_ctx > hot) & (word != unknown)
    return ctx * (GROUPS + 1) + np.where(split, 1 + group_of(word), 0)


def _pack(*cols: np.ndarray) -> bytes:
    """Integer columns as one compressed blob; the first is sorted and stored as steps."""
    out = []
    for k, c in enumerate(cols):
        c = c.astype(np.int64)
        if k == 0:
            c = np.diff(c, prepend=0)
        top = int(c.max()) if len(c) else 0
        wide = next(x for x in (1, 2, 3, 4, 8) if top < 1 << (8 * x) or x == 8)
        raw = c.view(np.uint8).reshape(-1, 8)[:, :wide]
        out.append(np.ascontiguousarray(raw.T).tobytes())         # bytes of one weight together: compresses well
    head = np.array([len(cols[0]), *[len(o) for o in out]], dtype=np.int64).tobytes()
    body = head + b"".join(out)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes, n_cols: int) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    body = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    head = np.frombuffer(body[:8 * (n_cols + 1)], dtype=np.int64)
    n, at, out = int(head[0]), 8 * (n_cols + 1), []
    for k in range(n_cols):
        raw = np.frombuffer(body[at:at + int(head[1 + k])], dtype=np.uint8)
        full = np.zeros((n, 8), dtype=np.uint8)
        if n:
            full[:, :len(raw) // n] = raw.reshape(-1, n).T
        v = full.view(np.int64).ravel()
        out.append(np.cumsum(v) if k == 0 else v)
        at += int(head[1 + k])
    return out


_TEXT = ["rid", "doc_id", "train", "n_tokens", "n_known", "base", "s"]     # what one row per text carries


def _text_rows(id_type: pa.DataType, n: int, **cols) -> list[pa.Array]:
    types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return [pa.nulls(n, t) if k not in cols else cols[k] if isinstance(cols[k], pa.Array) else pa.array(cols[k], t)
            for k, t in zip(_TEXT, types)]


def count_kinds(src: DataFrame, uni: Unigrams, shards: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distinct successors) of the contexts with more than ``hot`` occurrences, ids ascending."""
    def pairs(batches):
        for b in batches:
            for w in batch_words(b.column(0), SPACE_WORDS):
                h, _, begins = _tokens(w)
                u, inv = np.unique(h, return_inverse=True)
                uid = uni.ids(u)
                ids, frequent = uid[inv], (uni.counts(uid) > hot)[inv]
                at = np.flatnonzero(frequent[:-1] & ~begins[1:])
                if not len(at):
                    continue
                key = ids[at] * (GROUPS + 1) + 1 + group_of(ids[at + 1])
                owner = (mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((ids[at + 1], key, owner))
                cols = np.stack([owner, key, ids[at + 1]])[:, order]
                cols = cols[:, np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)]]
                cut = np.r_[0, np.flatnonzero(np.diff(cols[0])) + 1, cols.shape[1]]
                blobs = [_pack(cols[1, i:j], cols[2, i:j]) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0, cut[:-1]]), pa.array(blobs, pa.binary())], names=["owner", "pairs"])

    def flush(blobs):
        key, word = map(np.concatenate, zip(*(_unpack(p, 2) for p in blobs)))
        order = np.lexsort((word, key))
        key, word = key[order], word[order]
        key = key[np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1])]]
        ctx, n = np.unique(key // (GROUPS + 1), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(n.astype(np.int64))], names=["ctx", "n"])

    def count(batches):
        owner, blobs = None, []
        for b in batches:
            for o, p in zip(b.column("owner").to_pylist(), b.column("pairs").to_pylist()):
                if blobs and o != owner:
                    yield flush(blobs)
                    blobs = []
                owner = o
                blobs.append(p)
        if blobs:
            yield flush(blobs)

    dealt = (src.where("train").select("text").mapInArrow(pairs, "owner bigint, pairs binary")
             .repartition(shards, "owner").sortWithinPartitions("owner"))
    rows = dealt.mapInArrow(count, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n")).collect()   # at most tokens / hot
    rows.sort()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def scatter(src: DataFrame, uni: Unigrams, shards: int, hot: int, schema: str) -> DataFrame:
    """Per text one row of counts, base score and the score of tokens without a known context (owner: spread evenly);
    per slice and owner one row with a packed blob of (context key, word, text, times) and its texts."""
    def run(batches):
        for b in batches:
            rid_all, train_all = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for w in batch_words(b.column(3), SPACE_WORDS):
                n = w.hi - w.lo
                rid, train = rid_all[w.lo:w.hi], train_all[w.lo:w.hi]
                h, text, begins = _tokens(w)
                u, inv = np.unique(h, return_inverse=True)
                uid = uni.ids(u)
                uc = uni.counts(uid)
                ids, c = uid[inv], uc[inv]
                logp = np.log10((uc + 1) / uni.total)[inv]
                ctx, c_ctx = np.r_[uni.n_words, ids[:-1]], np.r_[0, c[:-1]]
                free = begins | (ctx == uni.n_words)
                head = _text_rows(b.schema.field(1).type, n, rid=rid, doc_id=b.column(1).slice(w.lo, n), train=train,
                                  n_tokens=np.bincount(text, minlength=n),
                                  n_known=np.bincount(text, weights=c > 0, minlength=n).astype(np.int64),
                                  base=np.bincount(text, weights=logp, minlength=n),
                                  s=np.bincount(text[free], weights=logp[free], minlength=n))
                yield _with_blobs(rid % shards, head, [None] * n, [None] * n)
                pair = np.flatnonzero(~free)
                if not len(pair):
                    continue
                key = context_key(ctx[pair], ids[pair], c_ctx[pair], hot, uni.n_words)
                owner = (mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((text[pair], ids[pair], key, owner))
                cols = np.stack([owner, key, ids[pair], text[pair]])[:, order]
                new = np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)]
                times = np.diff(np.r_[np.flatnonzero(new), len(order)])
                cols = cols[:, new]
                cut = np.r_[0, np.flatnonzero(np.diff(cols[0])) + 1, cols.shape[1]]
                texts, pairs = [], []
                for i, j in zip(cut[:-1], cut[1:]):
                    some, local = np.unique(cols[3, i:j], return_inverse=True)      # row ids rise within a task
                    texts.append(_pack(rid[some], train[some]))
                    pairs.append(_pack(cols[1, i:j], cols[2, i:j], local, times[i:j]))
                none = _text_rows(b.schema.field(1).type, len(texts))
                yield _with_blobs(cols[0, cut[:-1]], none, texts, pairs)
    return src.mapInArrow(run, f"owner bigint, {schema}, texts binary, pairs binary")


def _with_blobs(owner, rows: list, texts: list, pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *rows, pa.array(texts, pa.binary()),
                                       pa.array(pairs, pa.binary())], names=["owner", *_TEXT, "texts", "pairs"])


# ---- bigram level --------------------------------------------------------

def build_bigrams(key: np.ndarray, word: np.ndarray, times: np.ndarray, uni: Unigrams) -> dict[str, np.ndarray]:
    """Arrays of one owner's bigram level from its training pairs (any order, repeats allowed)."""
    order = np.lexsort((word, key))
    k, w, t = key[order], word[order], times[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])] if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    c = np.add.reduceat(t, at) if len(at) else np.zeros(0, np.int64)
    k, w = k[at], w[at]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    ctx = k[first]
    kinds = np.diff(np.r_[first, len(k)])
    total = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
    whole, split = ctx // (GROUPS + 1), ctx % (GROUPS + 1) > 0
    total = np.where(split, uni.counts(whole), total)          # of the whole context, not of the part that is here
    distinct = np.where(split, uni.kinds(whole), kinds)
    place = np.repeat(np.arange(len(ctx)), kinds)
    p_word = (uni.counts(w) + 1) / uni.total
    p = (c + distinct[place] * p_word) / (total + distinct)[place]
    back = distinct / (total + distinct)
    vocab = uni.n_words + 1
    return {**_named("ctx", EliasFano.encode(ctx)), **_named("begin", EliasFano.encode(np.r_[first, len(k)])),
            **_named("next", EliasFano.encode(place * vocab + w)),
            "p": _quantise(np.log10(p)), "back": _quantise(np.log10(back))}


def _quantise(logs: np.ndarray) -> np.ndarray:
    steps = np.rint(-logs * STEPS)
    if len(steps) and not 0 <= steps.min() <= steps.max() <= 65_535:
        raise ValueError("a probability is above 1 or below 1e-31")
    return steps.astype(np.uint16)


class Bigrams:
    """A mapped bigram level."""

    def __init__(self, arrays: dict[str, np.ndarray], uni: Unigrams):
        self.uni = uni
        self.ctx, self.begin, self.next = (EliasFano.load(_parts(arrays, k)) for k in ("ctx", "begin", "next"))
        self.p, self.back = arrays["p"], arrays["back"]

    def log10(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context) for pairs whose context word is known."""
        out = np.empty(len(key))
        vocab = self.uni.n_words + 1
        low = np.log10((self.uni.counts(word) + 1) / self.uni.total)
        at = self.ctx.find(key)
        seen = at >= 0
        i = np.full(len(key), -1, dtype=np.int64)
        a = at[seen]
        x = (a * vocab + word[seen]).astype(np.uint64)
        pos = self.next.successor(x)                          # successor search; the context's range bounds it
        inside = pos < self.begin.get(a + 1).astype(np.int64) if len(a) else np.zeros(0, bool)
        hit = inside.copy()
        hit[inside] = self.next.get(pos[inside]) == x[inside]
        i[np.flatnonzero(seen)[hit]] = pos[hit]
        found = i >= 0
        out[found] = -self.p[i[found]].astype(np.float64) / STEPS
        backed = seen & ~found
        out[backed] = -self.back[at[backed]].astype(np.float64) / STEPS + low[backed]
        none = ~seen                                          # a frequent context without a successor at this place,
        whole = key[none] // (GROUPS + 1)                     # or an unknown word after one: backed off like any other
        kinds = self.uni.kinds(whole)
        out[none] = low[none] + np.log10(kinds / (self.uni.counts(whole) + kinds))
        return out


def owner_scores(uni: Unigrams, root: str):
    """mapInArrow function over rows sorted by owner: per owner build, write, map and query the bigram level.

    Rows of texts pass through; each owner adds, per ``2 ** BUCKET_BITS`` row
    ids, one packed row of the scores of the texts it has pairs of.
    """
    def flush(owner, blobs, id_type):
        key, word, text, times, train, rids = [], [], [], [], [], []
        at = 0
        for t, p in blobs:
            k, w, x, n = _unpack(p, 4)
            rid, tr = _unpack(t, 2)
            key.append(k)
            word.append(w)
            text.append(x + at)
            times.append(n)
            train.append(tr.astype(bool)[x])
            rids.append(rid)
            at += len(rid)
        key, word, text, times, train, rids = map(np.concatenate, (key, word, text, times, train, rids))
        path = f"{root}/bigram-{owner}.lvl"
        write_level(path, build_bigrams(key[train], word[train], times[train], uni))
        level = Bigrams(map_level(path), uni)
        total = np.bincount(text, weights=times * level.log10(key, word), minlength=at)
        order = np.argsort(rids)
        rids, total = rids[order], total[order].astype(np.float32)
        bucket = rids >> BUCKET_BITS
        cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(rids)]
        parts = [_pack(rids[i:j]) + total[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
        sizes = (np.diff(cut) * 4).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *_text_rows(id_type, len(parts)),
                                           pa.array(parts, pa.binary()), pa.array(sizes, pa.int64())], names=_PART)

    def run(batches):
        owner, blobs, id_type = None, [], None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            texts = b.filter(b.column("pairs").is_null()).select(_TEXT)
            if texts.num_rows:
                n = texts.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(texts.column("rid").to_numpy() >> BUCKET_BITS), *texts.columns,
                                                  pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=_PART)
            for o, t, p in zip(b.column("owner").to_pylist(), b.column("texts").to_pylist(), b.column("pairs").to_pylist()):
                if p is None:
                    continue
                if blobs and o != owner:
                    yield flush(owner, blobs, id_type)
                    blobs = []
                owner = o
                blobs.append((t, p))
        if blobs:
            yield flush(owner, blobs, id_type)
    return run


_PART = ["bucket", *_TEXT, "part", "tail"]


def add_parts(batches):
    """Rows sorted by bucket -> one row per text with the scores of all owners added."""
    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        texts = t.filter(t.column("part").is_null()).combine_chunks()
        parts = t.filter(t.column("part").is_valid())
        rid = texts.column("rid").to_numpy()
        order = np.argsort(rid)
        s = texts.column("s").to_numpy().copy()
        for blob, tail in zip(parts.column("part").to_pylist(), parts.column("tail").to_pylist()):
            at = order[np.searchsorted(rid, _unpack(blob[:-tail], 1)[0], sorter=order)]
            s[at] += np.frombuffer(blob[-tail:], dtype=np.float32)        # a row id occurs once in a blob
        cols = [pa.array(s) if k == "s" else texts.column(k).combine_chunks() for k in _TEXT]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=_TEXT)

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        k = b.column("bucket").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(k)) + 1, len(k)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i == j:
                continue
            if held and k[i] != last:
                yield flush(held)
                held = []
            held.append(b.slice(i, j - i))
            last = k[i]
    if held:
        yield flush(held)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7,
                  held_out_rest: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    root = shared_path(spark, "lm")
    src = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"),
                      (crc_mod(docs[id_col], held_out_mod) != held_out_rest).alias("train"),
                      docs[text_col].cast("string").alias("text"))
    uni, size = train_unigrams(src, root)
    shards, hot = max(1, math.ceil(size["tokens"] / shard_tokens)), max(1, shard_tokens // 8)
    if size["most"] > hot:
        uni.split_ids, uni.split_kinds = count_kinds(src, uni, shards, hot)
    schema = (f"rid bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, train boolean, n_tokens bigint, "
              "n_known bigint, base double, s double")
    dealt = (scatter(src, uni, shards, hot, schema)
             .repartition(shards, "owner").sortWithinPartitions("owner"))
    parts = dealt.mapInArrow(owner_scores(uni, root), f"bucket bigint, {schema}, part binary, tail bigint")
    rows = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_parts, schema)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                       F.lit(size["tokens"]).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
                       F.col("s").alias("score"))
