"""Exact dedup over an extendible-hash index kept in shared files (DataFrame operations only).

Every row gets a 64-bit hash of its text (A-Z lower-cased). The hash space is
cut by an extendible-hash directory: it doubles while a bucket holds more than
``bucket_rows`` keys, and only the overfull buckets split, so a bucket is a
hash prefix of its own local depth. Each bucket, a key range, belongs to one
owner task, which chains the entries that share a hash. Rows whose hash occurs
once need no comparison; all others go to the bucket that the directory names
for their hash and are compared there byte by byte: grouped by bucket, hash
and whole text, where Spark's aggregation compares the key bytes. That grouping
is partial before the shuffle, so a text that fills a third of the table sends
one row per task, not one per copy.

The index is one table in ``spark.checkpoint.dir``: bucket, h, chain,
text_sha256, n_bytes, keep_id, group_size. A lost executor rereads it. A row's
verdict is looked up in it like any key: directory slot, bucket, hash, text.

Defined cases
    null text: an empty text. Empty texts are equal to each other.
    null id: never larger than an id; a group of null ids only has keep_id null and keeps its rows.
    repeated rows: ``exact_groups`` gives them the same verdict; ``drop_duplicates`` leaves one.
    very long texts: compared whole.
    empty table: no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, flag_keys, join_by_key, keep_rows

BUCKET_ROWS = 32_768   # keys a bucket may hold before it splits
MAX_DEPTH = 16         # directory of at most 65,536 slots; a bucket still overfull there spills in its task


def text_hash(text: Column, hash_bits: int = 64) -> Column:
    """Hash key of the normalised text; fewer bits only to provoke collisions in tests."""
    h = F.xxhash64(ascii_lower(text))
    return h if hash_bits >= 64 else h.bitwiseAND(F.lit((1 << hash_bits) - 1)) * F.lit(1 << (63 - hash_bits))


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


def split_buckets(counts: dict[int, int], bucket_rows: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(bucket prefix, local depth, keys) after doubling until nothing splits; ``counts`` by prefix of max_depth bits."""
    level, leaves, depth = {0: sum(counts.values())}, [], 0
    while level:
        full = {p for p, n in level.items() if n > bucket_rows and depth < max_depth}
        leaves += [(p, depth, n) for p, n in level.items() if p not in full]
        depth += 1                                     # the directory doubles; only full buckets move on
        level = {q: 0 for p in full for q in (2 * p, 2 * p + 1)}
        for slot, n in counts.items() if level else ():
            p = slot >> (max_depth - depth)
            if p in level:
                level[p] += n
    return leaves


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS,
                max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(entries: doc_id, h, th, text_sha256, n_bytes; directory: slot, bucket; index; number of rows).

    Entries and index are written to the shared folder; the directory has 2^max_depth rows.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].alias("doc_id"), ascii_lower(docs[text_col]).alias("norm"),
                    text_hash(docs[text_col], hash_bits).alias("h"), F.xxhash64(docs[text_col]).alias("th"))
    entries = materialize(d.select("doc_id", "h", "th", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                                   F.octet_length("norm").cast("bigint").alias("n_bytes")), "dedup-entries")
    keys = materialize(entries.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"),
        F.max("n_bytes").alias("n_bytes")), "dedup-keys")

    # directory: at most 2^max_depth counts reach the driver
    hist = keys.groupBy(_prefix(F.col("h"), max_depth).alias("p")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).collect()
    leaves = split_buckets({r["p"]: r["keys"] for r in hist}, bucket_rows, max_depth)
    n_rows = sum(r["rows"] for r in hist)
    directory = spark.createDataFrame(leaves, "prefix bigint, depth int, n_keys bigint").select(
        "prefix", "depth", F.expr(f"shiftleft(prefix, {max_depth} - depth)").alias("bucket"),
        F.explode(F.expr(f"sequence(shiftleft(prefix, {max_depth} - depth), "
                         f"shiftleft(prefix + 1, {max_depth} - depth) - 1)")).alias("slot"))

    # bytes decide among rows that share a hash. Only those texts are normalised again (bit filter on the raw text's
    # hash); hashes of very many rows are picked out by broadcast, so their copies meet in the partial aggregation
    multi = keys.where("n > 1").select("h", "n")
    theirs = flag_keys(entries, F.col("h"), multi, F.col("h")).where("_in").select(F.col("th").alias("m_th"))
    raw = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    some = flag_keys(raw, F.col("th"), theirs, F.col("m_th")).where("_in").select(
        "doc_id", ascii_lower(F.col("text")).alias("norm"), text_hash(F.col("text"), hash_bits).alias("h"))
    shared = join_by_key(some, multi, ["h"], "n", n_rows)
    groups = (owned_by(directory, shared, max_depth).groupBy("bucket", "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("bucket", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                      F.octet_length("norm").cast("bigint").alias("n_bytes"), "keep_id", "group_size"))
    single = owned_by(directory, keys.where("n = 1"), max_depth).select(
        "bucket", "h", "text_sha256", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    index = groups.unionByName(single).repartition("bucket").withColumn("chain", F.row_number().over(chain))
    return entries, directory, materialize(index, "dedup-index"), n_rows


def owned_by(directory: DataFrame, rows: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``rows`` with the bucket that the directory names for the leading bits of their hash ``h``."""
    slots = F.broadcast(directory.select("slot", "bucket"))
    return rows.withColumn("slot", _prefix(F.col("h"), max_depth)).join(slots, "slot").drop("slot")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """doc_id, th, keep_id, group_size, kept, text_sha256; one row per input row. ``th`` is xxhash64 of the raw text."""
    entries, directory, index, n_rows = build_index(docs, id_col, text_col, **options)
    groups = index.select("bucket", "h", "text_sha256", "keep_id", "group_size")
    asked = owned_by(directory, entries.select("doc_id", "h", "th", "text_sha256"), options.get("max_depth", MAX_DEPTH))
    out = join_by_key(asked, groups, ["bucket", "h", "text_sha256"], "group_size", n_rows)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the largest id is kept."""
    return _verdicts(docs, id_col, text_col, **options).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The kept rows with all their columns. Of kept rows that repeat an id and text, one stays."""
    v = materialize(_verdicts(docs, id_col, text_col, **options).select("doc_id", "text_sha256", "th", "kept"),
                    "dedup-verdicts")
    out = keep_rows(docs, v.where("not kept"), {"doc_id": docs[id_col], "th": F.xxhash64(docs[text_col])})
    kept = v.where("kept")
    repeated = materialize(kept.join(kept.groupBy("doc_id", "text_sha256").count().where("count > 1").select(
        F.col("doc_id").alias("r_id"), F.col("text_sha256").alias("r_sha")),
        F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha")), "left_semi")
        .select("doc_id", "th"), "dedup-repeated")
    if repeated.isEmpty():      # the same rows either way; this only spares a second read
        return out
    key = {"doc_id": out[id_col], "th": F.xxhash64(out[text_col])}
    again = out.select(F.struct("*").alias("_row"), out[id_col].alias("_i"), ascii_lower(out[text_col]).alias("_t"),
                       F.xxhash64(out[text_col]).alias("_th")).join(
        repeated.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")),
        F.col("_i").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")), "left_semi")
    return keep_rows(out, repeated, key).unionByName(again.dropDuplicates(["_i", "_t"]).select("_row.*"))
