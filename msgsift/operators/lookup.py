"""Dictionary lookups for token arrays when the dictionary is too big to ship.

A *page* is a stretch of rows that one task read, of about ``page_tokens``
tokens. It writes its rows as codes and its distinct tokens once; only those
are joined with the dictionary, and the answers come back to the page as one
group. The joins carry one row per page and distinct token, not one per
occurrence, and the rows travel as packed integers, one row per page.

The dictionary's *head* (a bounded number of frequent tokens, checked by the
caller) travels with the tasks, so that pages only ask for rarer tokens. These
are spread over ``salts`` copies of the dictionary: a token that most pages
ask for is still answered by several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import small_batches

PAGE_TOKENS = 1 << 18
SALTS = 8


def slices(sizes: np.ndarray, limit: int):
    """``(lo, hi)`` stretches of rows that hold at most ``limit`` in all, or one row."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def _shape(schema: StructType) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)


def paged(df: DataFrame, cols: list[str], tokens_col: str, head: pa.Table | None = None,
          page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """One row per page: ``page``, ``rows`` (the ``cols``), ``sizes`` (tokens per row), ``codes``, ``words``.

    A code of 0 and more is the head's ``code`` of the token; ``-1 - k`` is the
    page's k-th word.
    """
    if head is not None and head.num_rows:
        known = head.column("token").combine_chunks().cast(pa.string())
        values = head.column("code").combine_chunks().cast(pa.int64()).to_numpy()
    else:
        known, values = None, None

    def page(k: int, held: list) -> pa.RecordBatch:
        rows = pa.concat_arrays([pa.StructArray.from_arrays([b.column(i) for i in range(len(cols))], names=cols) for b in held])
        lists = [b.column(len(cols)) for b in held]
        sizes = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists])
        tokens = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists])
        codes = np.full(len(tokens), -1, dtype=np.int64)
        if known is not None:
            at = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy(zero_copy_only=False)
            codes[at >= 0] = values[at[at >= 0]]
        ask = np.flatnonzero(codes < 0)
        coded = pc.dictionary_encode(tokens.take(pa.array(ask)))
        codes[ask] = -1 - coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays(
            [pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()), one(rows), one(pa.array(sizes, pa.int32())),
             one(pa.array(codes, pa.int32())), one(coded.dictionary)], names=["page", "rows", "sizes", "codes", "words"])

    def run(batches):
        k, held, n = 0, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += len(b.column(len(cols)).flatten())
            if n >= page_tokens:
                yield page(k, held)
                k, held, n = k + 1, [], 0
        if held:
            yield page(k, held)

    small_batches(df.sparkSession)
    src = df.select(*cols, tokens_col)
    rows = _shape(df.select(*cols).schema)
    return src.mapInArrow(run, f"page bigint, rows array<struct<{rows}>>, sizes array<int>, codes array<int>, words array<string>")


def answered(pages: DataFrame, dictionary: DataFrame, cols: StructType, run: Callable, result: str, salts: int = SALTS) -> DataFrame:
    """``(*cols, result)`` per row of the (written) ``pages``; ``dictionary`` has ``token`` and value columns.

    ``run(rows, sizes, codes, answers)`` gives the result column of a page.
    ``answers`` is a struct array with the values of the page's k-th word at
    k, null where the dictionary does not have it.
    """
    values = [c for c in dictionary.columns if c != "token"]
    asks = (pages.select("page", F.posexplode("words").alias("k", "token"))
            .withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int")))
    copies = dictionary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = asks.join(copies, ["token", "salt"]).select(F.col("page").alias("_of"), "k", *values)
    names = [f.name for f in cols.fields]

    def attach(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, sizes, codes, words = (mine.column(c).combine_chunks().flatten() for c in ("rows", "sizes", "codes", "words"))
        at = np.full(len(words), -1, dtype=np.int64)
        at[theirs.column("k").to_numpy()] = np.arange(theirs.num_rows)
        take = pa.array(at, mask=at < 0)
        got = pa.StructArray.from_arrays([theirs.column(v).combine_chunks().take(take) for v in values], names=values)
        out = run(rows, sizes.to_numpy(), codes.to_numpy().astype(np.int64), got)
        return pa.table([*[rows.field(n) for n in names], out], names=[*names, result.split(" ", 1)[0]])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.fields)
    return pages.groupBy("page").cogroup(found.groupBy("_of")).applyInArrow(attach, f"{shape}, {result}")
