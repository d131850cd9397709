"""Tokens, vocabulary, ids, markers, padding and attention masks.

Whole texts are tokenised. ``max_tokens`` (250, markers included) is the
model-input width: a longer text becomes several chunks of
``max_tokens - 2`` content tokens each, so nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOS_ID, EOS_ID, FIRST_TOKEN_ID, MAX_TOKENS, PAD_ID, UNK_ID
from ..functions.text import token_array
from ..session import materialize, small_batches
from .lookup import answered, paged
from .ranking import sorted_rank


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep_empty: bool = False, extra: list[str] | None = None) -> DataFrame:
    """``(id, *extra, pos, token)``, one row per token (narrow, no shuffle).

    ``keep_empty`` keeps a text without tokens as one row with null pos/token.
    """
    gen = F.posexplode_outer if keep_empty else F.posexplode
    cols = [id_col] + list(extra or [])
    return (df.select(*cols, gen(token_array(text_col)).alias("pos", "token"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def build_vocab(tokens: DataFrame, id_col: str = "doc_id", min_df: int = 1,
                max_vocab: int | None = None) -> DataFrame:
    """``(token, token_id, df, tf)``, every token by default.

    Ids go from 4 on by falling frequency (tf desc, token asc). ``min_df``
    and ``max_vocab`` (the most frequent tokens only, planned as a
    distributed top-k) are there for models that want a smaller vocabulary.
    """
    pairs = tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("_tf"))
    return vocab_from_pairs(pairs, "_tf", min_df, max_vocab)


def vocab_from_pairs(pairs: DataFrame, tf_col: str = "tf", min_df: int = 1,
                     max_vocab: int | None = None) -> DataFrame:
    """T3 from per-(text, token) counts: one row per pair, so ``df = count``."""
    stats = pairs.groupBy("token").agg(F.sum(tf_col).alias("tf"), F.count(F.lit(1)).alias("df"))
    return _top(stats, min_df, max_vocab)


def _top(stats: DataFrame, min_df: int, max_vocab: int | None) -> DataFrame:
    top = stats.where(F.col("df") >= min_df) if min_df > 1 else stats
    if max_vocab is not None:
        top = top.orderBy(F.desc("tf"), F.asc("token")).limit(max_vocab)
        w = Window.orderBy(F.desc("tf"), F.asc("token"))   # <= max_vocab rows
        ranked = top.withColumn("_rank", F.row_number().over(w))
    else:
        # ranks inside ranges of (frequency, token) cut at sampled points: no global sort in one task
        ranked = sorted_rank(top, [F.desc("tf"), F.asc("token")], "_rank", name="vocab")
    return ranked.select("token", (F.col("_rank") - 1 + FIRST_TOKEN_ID).cast("int").alias("token_id"), "df", "tf")


def vocab_from_texts(df: DataFrame, text_col: str = "text", min_df: int = 1,
                     max_vocab: int | None = None) -> DataFrame:
    """T3 straight from texts with ONE aggregation on ``token``.

    Each text is tokenised once and contributes one row per token occurrence
    (tf) and one per distinct token (``array_distinct``, df), tagged in one
    generator; both sum per token with partial aggregation, so the shuffle
    carries per-partition partial counts only, instead of every distinct
    (text, token) pair.
    """
    return _top(token_stats(df, text_col), min_df, max_vocab)


def token_stats(df: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(token, *by, tf, df)``: occurrences and texts containing the token, per ``by`` group.

    Each text is tokenised once and contributes one row per occurrence (tf)
    and one per distinct token (df), tagged in one generator; both sum with
    partial aggregation, so the shuffle carries per-partition partial counts.
    """
    by = list(by or [])
    arr = df.select(*by, token_array(text_col).alias("_t"))

    def tag(tokens, occ: int):
        return F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(occ).alias("_o"),
                                                      F.lit(1 - occ).alias("_d")))

    rows = arr.select(*by, F.inline(F.concat(tag(F.col("_t"), 1), tag(F.array_distinct("_t"), 0))))
    return rows.groupBy("token", *by).agg(F.sum("_o").cast("bigint").alias("tf"),
                                          F.sum("_d").cast("bigint").alias("df"))


def vocab_from_stats(stats: DataFrame, min_df: int = 1, max_vocab: int | None = None) -> DataFrame:
    """T3 from per-(token, group) stats: sums over the groups (a text is in one group)."""
    per_token = stats.groupBy("token").agg(F.sum("tf").cast("bigint").alias("tf"),
                                           F.sum("df").cast("bigint").alias("df"))
    return _top(per_token, min_df, max_vocab)


def token_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token -> id through the vocabulary; unknown tokens get id 3.

    No broadcast hint: Catalyst broadcasts a vocabulary under its threshold
    and joins a bigger one by shuffle, where AQE splits frequent tokens.
    """
    lut = vocab.select("token", "token_id")
    return tokens.join(lut, "token", "left").withColumn(
        "token_id", F.when(F.col("token").isNull(), F.lit(None).cast("int"))
        .otherwise(F.coalesce(F.col("token_id"), F.lit(UNK_ID))))


def chunk_ids(ids: DataFrame, id_col: str = "doc_id", max_tokens: int = MAX_TOKENS,
              extra: list[str] | None = None) -> DataFrame:
    """``(id, *extra, chunk, ids, n_tokens)`` with at most ``max_tokens-2`` ids per chunk."""
    keys = [id_col, *(extra or [])]
    body = max_tokens - 2
    rows = ids.withColumn("chunk", F.coalesce(F.expr(f"pos div {body}"), F.lit(0)).cast("bigint"))
    grouped = rows.groupBy(*keys, "chunk").agg(
        F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("pos", "token_id"))).alias("_p"))
    return grouped.select(*keys, "chunk",
                          F.transform(F.array_sort("_p"), lambda s: s["token_id"]).alias("ids"))\
        .withColumn("n_tokens", F.size("ids").cast("bigint"))


def lookup_ids(df: DataFrame, vocab: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text",
               max_vocab_rows: int = 1_000_000) -> DataFrame | None:
    """T1-T3 without a shuffle: ``(id, ids)`` with the id array of each whole text (``id_col``: one column or several).

    Tokens come from the JVM regex; each Arrow batch maps them to ids with one
    vectorised hash lookup (``pyarrow.compute.index_in``) against the
    vocabulary, which travels with the tasks. It is fetched with
    ``limit(max_vocab_rows + 1)``: a bigger vocabulary returns ``None`` (use
    the join path) and never reaches the driver whole. Unknown tokens get 3.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    cols = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = vocab.select("token", "token_id").limit(max_vocab_rows + 1).toArrow()
    if rows.num_rows > max_vocab_rows:
        return None
    tokens = rows.column("token").combine_chunks().cast(pa.string())
    ids = rows.column("token_id").combine_chunks().cast(pa.int32())

    def to_ids(batches):
        for b in batches:
            lists = b.column(len(cols))
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            found = pc.fill_null(pc.take(ids, pc.index_in(lists.flatten(), value_set=tokens)), UNK_ID)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, found)],
                                             names=[*cols, "ids"])

    small_batches(df.sparkSession)
    arr = df.select(*cols, F.coalesce(token_array(text_col), F.array().cast("array<string>")).alias("_t"))
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    return arr.mapInArrow(to_ids, f"{keys}, ids array<int>")


def ask_ids(df: DataFrame, vocab: DataFrame, cols: list[str], text_col: str = "text", head_rows: int = 1_000_000) -> DataFrame:
    """T1-T3 for a vocabulary of any size: ``(*cols, ids)`` with the id array of each whole text.

    The ``head_rows`` most frequent tokens (ids are ranks) travel with the
    tasks; the others are asked for once per page (:mod:`.lookup`).
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    words = vocab.select("token", F.col("token_id").cast("bigint").alias("code"))
    head = words.where(F.col("code") < FIRST_TOKEN_ID + head_rows).toArrow()

    def ids(codes, answers):
        own = pc.fill_null(answers.field("code"), UNK_ID).to_numpy(zero_copy_only=False)
        out = codes.copy()
        ask = codes < 0
        out[ask] = own[-1 - codes[ask]]
        return out

    def run(rows, sizes, codes, answers):
        at = pa.array([0, *sizes.cumsum()], pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(ids(codes, answers), pa.int32()))

    src = df.select(*cols, F.coalesce(token_array(text_col), F.array().cast("array<string>")).alias("_t"))
    pages = materialize(paged(src, cols, "_t", head), "token-pages")
    return answered(pages, words, df.select(*cols).schema, run, "ids array<int>")


def text_ids(df: DataFrame, vocab: DataFrame, cols: list[str], text_col: str = "text", max_lookup_rows: int = 1_000_000) -> DataFrame:
    """``(*cols, ids)`` by :func:`lookup_ids`, or by :func:`ask_ids` beyond its bound."""
    found = lookup_ids(df, vocab, cols, text_col, max_lookup_rows)
    return ask_ids(df, vocab, cols, text_col, max_lookup_rows) if found is None else found


def chunk_arrays(ids: DataFrame, id_col: str = "doc_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """T2 in-row: ``(id, chunk, ids, n_tokens)``, consecutive slices of ``max_tokens-2`` ids
    (a text without tokens keeps one empty chunk)."""
    body = max_tokens - 2
    n_chunks = F.greatest(F.lit(1), F.expr(f"(size(ids) + {body - 1}) div {body}"))
    pieces = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda k: F.slice("ids", k * body + 1, body))
    return (ids.select(id_col, F.posexplode(pieces).alias("chunk", "ids"))
            .select(id_col, F.col("chunk").cast("bigint"), "ids", F.size("ids").cast("bigint").alias("n_tokens")))


def add_markers(ids_col: str = "ids"):
    """T4: begin and end markers around the content ids."""
    return F.concat(F.array(F.lit(BOS_ID)), F.col(ids_col), F.array(F.lit(EOS_ID)))


def pad_and_mask(chunks: DataFrame, width: int, ids_col: str = "ids") -> DataFrame:
    """``input_ids`` padded with 1 to ``width``; ``attention_mask`` 1 then 0."""
    full = add_markers(ids_col)
    n = F.size(full)
    return (chunks.withColumn("input_ids", F.concat(full, F.array_repeat(F.lit(PAD_ID), F.lit(width) - n)))
            .withColumn("attention_mask",
                        F.transform(F.sequence(F.lit(1), F.lit(width)),
                                    lambda i: F.when(i <= n, 1).otherwise(0))))


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           max_tokens: int = MAX_TOKENS, pad_to: str = "longest",
           max_lookup_rows: int = 1_000_000) -> DataFrame:
    """Texts -> ``(id, chunk, input_ids, attention_mask, n_tokens)``.

    Ids come from :func:`lookup_ids` (no shuffle) when the vocabulary fits the
    bound, else from :func:`ask_ids`: the same chunks.

    ``pad_to="longest"`` pads to the longest example of this set (one small
    aggregate); ``"max_len"`` pads to ``max_tokens`` without the extra pass.
    """
    chunks = chunk_arrays(text_ids(df, vocab, [id_col], text_col, max_lookup_rows), id_col, max_tokens)
    if pad_to == "longest":
        # written once: the width aggregate and the padded output both read it
        chunks = materialize(chunks, "encoded-chunks")
        longest = chunks.agg(F.max("n_tokens")).first()[0]
        width = int(longest or 0) + 2
    elif pad_to == "max_len":
        width = max_tokens
    else:
        raise ValueError("pad_to must be 'longest' or 'max_len'")
    return pad_and_mask(chunks, width).select(id_col, "chunk", "input_ids", "attention_mask", "n_tokens")
