"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in the order of a hash of their id, form blocks of
``block_rows``. Source i with weight w_i (an exact fraction, all weights
summing to 1) releases its block j at slot floor((j - 1) / w_i) and must place
it before slot ceil(j / w_i); earliest deadline first over these windows keeps
every source less than one block from its target share at every slot.

The slots are cut into frames, which are scheduled independently of each
other. At a frame's first slot t every source has placed floor(w_i t) or
ceil(w_i t) blocks: the ceilings go to the largest remainders, as many as make
the sum t. The remainder is carried over exactly, never rounded into the
weights. With such boundaries the blocks of a frame always fit their windows
(between any two slots x and y at most sum of floor(w_i y) - ceil(w_i x) <= y - x
blocks must be placed), so earliest deadline first finds a place for each.
Frames are rows of a Spark range; each task schedules its own.

A source with fewer blocks than its share simply ends; the others keep their
order and relative weights. No row is dropped or repeated. ``on_target`` marks
the slots before the first source ends.

Rows are ranked inside hash ranges sized from the source's row count. Slots
come to a range as one array, joined on the range, so rows move once.

Defined cases
    null source: a source of its own. null id: placed by hash like any id. null text: not read.
    repeated rows: placed separately. ties of the hash: by id.
    source without a target weight: raises ValueError; weight 0: placed after all others (slot null).
    any number of sources: a frame has at least two slots per source. empty table: no rows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FRAME = 4_096         # slots scheduled together
BLOCK_ROWS = 16       # rows of one source that stay together
RANGE_ROWS = 4_096    # rows of a source per hash range


def shares_of(weights: dict) -> dict:
    """Exact shares summing to 1, of the sources with a positive weight."""
    pos = {k: Fraction(w) for k, w in weights.items() if w > 0}
    total = sum(pos.values())
    return {k: w / total for k, w in pos.items()}


def placed_before(shares: list[Fraction], t: int) -> list[int]:
    """Blocks of each source placed before slot ``t``: floor or ceiling of share * t, summing to t."""
    whole = [s.numerator * t // s.denominator for s in shares]
    rest = [s * t - n for s, n in zip(shares, whole)]
    up = sorted((k for k, r in enumerate(rest) if r), key=lambda k: (-rest[k], k))
    for k in up[:t - sum(whole)]:
        whole[k] += 1
    return whole


def schedule_frame(shares: list[Fraction], blocks: list[int], start: int, size: int) -> list[tuple]:
    """(source, j, slot, release, deadline) of the blocks placed in slots ``start .. start + size``, by earliest
    deadline first over released blocks; source k has ``blocks[k]`` blocks."""
    end = start + size
    first, last = placed_before(shares, start), placed_before(shares, end)
    waiting = []
    for k, s in enumerate(shares):
        for j in range(first[k] + 1, min(last[k], blocks[k]) + 1):
            release, deadline = (j - 1) * s.denominator // s.numerator, -(-j * s.denominator // s.numerator)
            waiting.append((max(release, start), min(deadline, end), k, j, release, deadline))
    waiting.sort(reverse=True)
    ready: list[tuple] = []
    out, slot = [], start
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[-1][0])
        while waiting and waiting[-1][0] <= slot:
            _, dead, k, j, release, deadline = waiting.pop()
            heapq.heappush(ready, (dead, k, j, release, deadline))
        _, k, j, release, deadline = heapq.heappop(ready)
        out.append((k, j, slot, release, deadline))
        slot += 1
    return out


def tempered_weights(counts: dict, temperature: float = 0.5) -> dict:
    """Target weights proportional to count ** temperature (0.5 lifts small sources)."""
    return {k: n ** temperature for k, n in counts.items()}


def nested_weights(counts: dict, temperature: float = 0.5) -> dict:
    """Target weights of (source, group) pairs: a source has the weight that :func:`tempered_weights` gives it, shared among
    its groups in proportion to group count ** temperature."""
    of_source: dict = {}
    for (source, _), n in counts.items():
        of_source[source] = of_source.get(source, 0) + n
    whole, part = tempered_weights(of_source, temperature), tempered_weights(counts, temperature)
    total: dict = {}
    for (source, _), w in part.items():
        total[source] = total.get(source, 0.0) + w
    return {k: whole[k[0]] * w / total[k[0]] for k, w in part.items()}


def _schedule(spark, shares: list[Fraction], blocks: list[int], frame: int) -> DataFrame:
    """(si, j, slot, release, deadline) of every block of every source."""
    ends = [-(-n * s.denominator // s.numerator) for s, n in zip(shares, blocks) if n]
    frames = -(-max(ends, default=0) // frame)
    plan = spark.sparkContext.broadcast((shares, blocks))

    def run(batches):
        shares, blocks = plan.value
        names = ["si", "j", "slot", "release", "deadline"]
        for b in batches:
            for f in b.column(0).to_pylist():
                rows = schedule_frame(shares, blocks, f * frame, frame)
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)
    tasks = max(1, min(frames, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, frames, 1, tasks).mapInArrow(run, "si int, j bigint, slot bigint, release bigint, deadline bigint")


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = BLOCK_ROWS, frame: int = FRAME, temperature: float = 0.5, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``mix_block, mix_slot, mix_pos, mix_release, mix_deadline, mix_on_target``.

    ``mix_pos`` orders the stream: slot * block_rows + place in the block.
    ``weights`` maps a source to its target weight; by default they are tempered
    from the row counts. Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    added = ["mix_block", "mix_slot", "mix_pos", "mix_release", "mix_deadline", "mix_on_target"]
    counts = {r["s"]: r["n"] for r in docs.groupBy(docs[source_col].alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = tempered_weights(counts, temperature)
    missing = [k for k in counts if k not in weights]
    if missing:
        raise ValueError(f"no target weight for {missing[:5]}")
    exact = shares_of({k: weights[k] for k in counts})
    order = sorted(counts, key=lambda k: (k not in exact, k is not None, str(k)))       # sources with a share come first
    shares = [exact[k] for k in order if k in exact]
    blocks = [-(-counts[k] // block_rows) for k in order if k in exact]
    frame = max(frame, 2 * len(shares))

    # one row per source: its number and the bits of its hash ranges
    bits = [max(0, min(24, math.ceil(math.log2(counts[k] / range_rows)))) for k in order]
    source_type = docs.schema[source_col].dataType.simpleString()
    sources = F.broadcast(spark.createDataFrame([(k, i, b) for i, (k, b) in enumerate(zip(order, bits))],
                                                f"o_s {source_type}, si int, bits int"))
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in added]).alias("_row"),
                    docs[source_col].alias("s"), docs[id_col].alias("i"), F.xxhash64(docs[id_col]).alias("k"))
    bucket = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(k, 64 - bits)")).otherwise(F.lit(0).cast("bigint"))
    d = d.join(sources, F.col("s").eqNullSafe(F.col("o_s"))).select("_row", "si", "i", "k", bucket.alias("bucket"))

    # ranges: rows before each, then the blocks it touches and their slots
    ranges = d.groupBy("si", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("si").orderBy("bucket")
    ranges = materialize(ranges.withColumn("offset", F.sum("n").over(before) - F.col("n")), "mix-ranges")
    pattern = materialize(_schedule(spark, shares, blocks, frame), "mix-slots")
    lasts = pattern.groupBy("si").agg(F.max("slot").alias("last")).agg(F.min("last")).first()[0]
    first_end = 0 if lasts is None else lasts + 1                 # the first source to end: the slot after its last block
    touched = ranges.select("si", "bucket", F.explode(F.expr(
        f"sequence(offset div {int(block_rows)} + 1, (offset + n - 1) div {int(block_rows)} + 1)")).alias("j"))
    slots = touched.join(pattern, ["si", "j"]).groupBy("si", "bucket").agg(F.array_sort(F.collect_list(
        F.struct("j", "slot", "release", "deadline"))).alias("slots"))
    of_range = materialize(ranges.join(slots, ["si", "bucket"], "left").select("si", "bucket", "offset", "slots"), "mix-range-slots")

    inside = Window.partitionBy("si", "bucket").orderBy("k", F.col("i").asc_nulls_first())
    ranked = (d.withColumn("place", F.row_number().over(inside)).join(of_range, ["si", "bucket"])
              .withColumn("rank", F.col("offset") + F.col("place") - 1)
              .withColumn("block", F.expr(f"rank div {int(block_rows)}") + 1))
    at = F.expr(f"get(slots, cast(block - (offset div {int(block_rows)} + 1) as int))")
    out = ranked.withColumn("at", at)
    return out.select("_row.*", F.col("block").alias("mix_block"), F.col("at.slot").alias("mix_slot"),
                      (F.col("at.slot") * block_rows + F.col("rank") % block_rows).alias("mix_pos"),
                      F.col("at.release").alias("mix_release"), F.col("at.deadline").alias("mix_deadline"),
                      F.coalesce(F.col("at.slot") < first_end, F.lit(False)).alias("mix_on_target"))
