"""M1, M3, M4: multinomial Naive Bayes as DataFrame aggregates.

Training is two grouped counts: ``(token, label) -> n_tc`` and per-class
document counts. The model is

* ``classes``: one row per class ``(label, intent, n_docs, n_tokens, log_prior)``,
  collected to the driver (its size is the class count);
* ``weights``: one row per vocabulary token with a dense array of
  ``log p(token | class)`` over the classes.

Scoring joins each token occurrence of a text to its weight row and sums the
arrays per text with partial (map-side) aggregation: one shuffle on the text
key, one output row per text. Texts without a known token keep the prior.
The weight table is broadcast only when its size bound (rows x classes x 8
bytes) is below ``broadcast_bytes``; otherwise pages of texts ask for the
weight rows of their distinct tokens.

Smoothing: ``kind="add_one"`` gives ``(n_tc + a) / (N_c + a V)``;
``kind="background"`` (M3) gives ``(n_tc + mu p_bg(t)) / (N_c + mu)`` with
``p_bg`` the add-one unigram model of an unlabelled corpus (Dirichlet prior,
Zhai & Lafferty 2001).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOG_FLOOR
from ..functions.text import argmax, softmax, token_array
from ..session import materialize
from .lookup import answered, paged
from .tokens import token_stats, vocab_from_stats

BROADCAST_BYTES = 256 << 20
LOOKUP_BYTES = 64 << 20     # weight matrix shipped with the tasks for in-batch scoring
SCORE_SLICE_TOKENS = 1 << 20   # tokens per bincount slice (bounds task memory)


@dataclass
class NBModel:
    weights: DataFrame                 # (token, w array<double>)
    counts: DataFrame                  # (token, label, n_tc) non-zero pairs
    vocab: DataFrame | Callable        # (token, token_id, df, tf), or a function building it on first use
    labels: list[int]                  # class label ids, array position = class index
    intents: list[str]
    log_prior: list[float]
    n_tokens: list[int]
    vocab_size: int
    kind: str = "add_one"
    params: dict = field(default_factory=dict)

    @property
    def n_classes(self) -> int:
        return len(self.labels)

    def vocabulary(self) -> DataFrame:
        """The vocabulary table; scoring needs no token ids, so they are ranked only when asked for."""
        if not isinstance(self.vocab, DataFrame):
            self.vocab = self.vocab()
        return self.vocab

    def classes(self, spark) -> DataFrame:
        rows = list(zip(self.labels, self.intents, self.n_tokens, self.log_prior))
        return spark.createDataFrame(rows, "label INT, intent STRING, n_tokens BIGINT, log_prior DOUBLE")


def _class_arrays(train: DataFrame, counts: DataFrame, label_col: str, intent_col: str):
    """Collect the per-class table (one row per class); ``train`` needs the two class columns only."""
    docs = train.groupBy(label_col, intent_col).agg(F.count(F.lit(1)).alias("n_docs"))
    toks = counts.groupBy(label_col).agg(F.sum("n_tc").alias("n_tok"))
    rows = (docs.join(toks, label_col, "left").orderBy(label_col)
            .select(label_col, intent_col, "n_docs", F.coalesce("n_tok", F.lit(0)).alias("n_tok"))
            .collect())
    total = sum(r["n_docs"] for r in rows)
    labels = [int(r[label_col]) for r in rows]
    intents = [r[intent_col] for r in rows]
    prior = [math.log(r["n_docs"] / total) for r in rows]
    ntok = [int(r["n_tok"]) for r in rows]
    return labels, intents, prior, ntok


def _dense(count_map, labels: list[int], numer_add, denom: list[float]):
    """``[ln(count[label_k] + numer_add) - denom_k for k]`` as one array expression."""
    lab = F.array(*[F.lit(x) for x in labels])
    den = F.array(*[F.lit(float(x)) for x in denom])
    return F.transform(F.sequence(F.lit(1), F.lit(len(labels))),
                       lambda i: F.log(F.coalesce(F.element_at(count_map, F.element_at(lab, i)).cast("double"),
                                                  F.lit(0.0)) + numer_add) - F.element_at(den, i))


def train_nb(train: DataFrame, vocab: DataFrame | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "label", intent_col: str = "intent",
             smoothing: float = 1.0, min_df: int = 1, max_vocab: int | None = None,
             background: DataFrame | None = None, mu: float = 1000.0,
             members: DataFrame | None = None) -> NBModel:
    """M1 (and M3 when ``background`` texts are given).

    ``members`` may give the ``(label, intent)`` rows of ``train`` without the
    texts, so counting the classes does not touch the text table.

    One tokenising pass over the training (and background) texts gives
    ``(token, label, tf, df)`` with a null label for background texts; it is
    written once, and the token-class counts, the background counts, the
    weights and (when asked for) the vocabulary are all read from it.
    """
    src = train.select(F.col(label_col).cast("int").alias(label_col), text_col)
    if background is not None:
        src = src.unionByName(background.select(F.lit(None).cast("int").alias(label_col), text_col))
    stats = materialize(token_stats(src, text_col, [label_col]), "nb-token-stats")
    every = vocab is None and min_df <= 1 and max_vocab is None      # then all counted tokens are known
    if every:
        def vocab():
            return materialize(vocab_from_stats(stats), "nb-vocab")
        known, tokens = stats, None
        v = stats.select("token").distinct().count()
    else:
        vocab = materialize(vocab_from_stats(stats, min_df, max_vocab) if vocab is None else vocab, "nb-vocab")
        tokens = vocab.select("token")
        known = materialize(stats.join(tokens, "token"), "nb-known")
        v = vocab.count()
    counts = known.where(F.col(label_col).isNotNull()).select("token", label_col, F.col("tf").alias("n_tc"))
    labels, intents, prior, ntok = _class_arrays(train if members is None else members, counts, label_col, intent_col)
    # one row per token: its class counts (at most one entry per class) and its background count
    in_class = F.when(F.col(label_col).isNotNull(), F.struct(F.col(label_col).alias("label"), F.col("tf").alias("n_tc")))
    base = known.groupBy("token").agg(F.map_from_entries(F.collect_list(in_class)).alias("_m"),
                                      F.max(F.when(F.col(label_col).isNull(), F.col("tf"))).alias("c_bg"))
    if tokens is not None:      # a given vocabulary may hold tokens that no text has
        base = tokens.join(base, "token", "left")
    if background is None:
        denom = [math.log(n + smoothing * v) for n in ntok]
        w = _dense(F.col("_m"), labels, F.lit(float(smoothing)), denom)
        weights = materialize(base.select("token", w.alias("w")), "nb-weights")
        kind, params = "add_one", {"smoothing": smoothing}
    else:
        n_bg = known.where(F.col(label_col).isNull()).agg(F.sum("tf")).first()[0] or 0
        p_bg = (F.coalesce(F.col("c_bg"), F.lit(0)) + 1.0) / F.lit(float(n_bg + v))
        denom = [math.log(n + mu) for n in ntok]
        w = _dense(F.col("_m"), labels, F.lit(float(mu)) * F.col("_p"), denom)
        weights = (base.withColumn("_p", p_bg)
                   .select("token", w.alias("w"), F.col("_p").alias("p_bg")))
        weights = materialize(weights, "nb-weights")
        kind, params = "background", {"mu": mu, "n_bg": int(n_bg)}
    return NBModel(weights=weights, counts=counts, vocab=vocab, labels=labels, intents=intents,
                   log_prior=prior, n_tokens=ntok, vocab_size=int(v), kind=kind, params=params)


def _lookup_score(model: NBModel, df: DataFrame, cols: list[str], text_col: str,
                  max_bytes: int) -> DataFrame | None:
    """See :func:`batch_scorer`; ``None`` when the weight matrix exceeds ``max_bytes``."""
    scorer = batch_scorer(model, max_bytes)
    return None if scorer is None else scorer(df, cols, text_col)


def batch_scorer(model: NBModel, max_bytes: int | None = None):
    """M4 without exploding tokens: a function ``(df, cols, text_col) -> (*cols, scores)``
    computing scores by Arrow batches, built once per model (the weights are read
    once, e.g. for every micro-batch of a stream); ``None`` above ``max_bytes``.

    The weight matrix (``vocabulary x classes`` doubles, checked against
    ``max_bytes``) travels with the tasks. Per batch, one vectorised hash
    lookup (``pyarrow.compute.index_in``) finds each token's row, and the
    per-text sums are ``np.bincount`` per class over slices of at most
    ``2^20`` tokens. A task holds one Arrow batch of tokens at a time (Spark
    bounds its rows and bytes; one text is never cut).
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    max_bytes = LOOKUP_BYTES if max_bytes is None else max_bytes
    c = model.n_classes
    if model.vocab_size * max(c, 1) * 8 > max_bytes:
        return None
    rows = model.weights.select("token", "w").toArrow()        # bounded by the check above
    tokens = rows.column("token").combine_chunks().cast(pa.string())
    v = rows.num_rows
    # one row per class; column v is the zero row of unknown tokens
    w_by_class = np.zeros((c, v + 1))
    if v:
        w_by_class[:, :v] = rows.column("w").combine_chunks().flatten().to_numpy().reshape(v, c).T
    prior = np.asarray(model.log_prior, dtype=np.float64)
    slice_tokens = SCORE_SLICE_TOKENS

    def to_scores(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            lengths = np.diff(offsets)
            n = len(lengths)
            idx = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens), v).to_numpy(zero_copy_only=False)
            row_of = np.repeat(np.arange(n), lengths)
            sums = np.zeros((n, c))
            for t0 in range(0, len(idx), slice_tokens):
                part, rows_part = idx[t0:t0 + slice_tokens], row_of[t0:t0 + slice_tokens]
                for k in range(c):
                    sums[:, k] += np.bincount(rows_part, weights=w_by_class[k][part], minlength=n)
            scores = (sums + prior).ravel()
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c, dtype=np.int32)), pa.array(scores))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [arr],
                                             names=b.schema.names[:-1] + ["scores"])

    def apply(df: DataFrame, cols: list[str], text_col: str = "text") -> DataFrame:
        arr = df.select(*cols, F.coalesce(token_array(text_col), F.array().cast("array<string>")).alias("_t"))
        schema = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in cols)
        return arr.mapInArrow(to_scores, f"{schema}, scores array<double>")

    return apply


def score(model: NBModel, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None,
          lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """M4: ``(id, *keep, scores)`` with ``scores[k]`` the log joint of class ``labels[k]``.

    ``keep`` columns (functions of the id, e.g. the true label) ride along,
    so callers need no join back to the input. With a weight matrix of at
    most ``lookup_bytes`` the scores are computed per Arrow batch with no
    shuffle (:func:`_lookup_score`); below ``broadcast_bytes`` each token
    occurrence joins its broadcast weight row and the rows are summed per text
    with partial aggregation; beyond, see :func:`_asked_score`.
    """
    c = model.n_classes
    cols = [id_col] + list(keep or [])
    fast = _lookup_score(model, df, cols, text_col, lookup_bytes)
    if fast is not None:
        return fast
    if model.vocab_size * max(c, 1) * 8 > broadcast_bytes:
        return _asked_score(model, df, cols, text_col, lookup_bytes)
    # a row key keeps rows that share an id apart, as the in-batch path does
    toks = (df.select(*cols, F.monotonically_increasing_id().alias("_row"), text_col)
            .select(*cols, "_row", F.explode_outer(token_array(text_col)).alias("token")))
    j = toks.join(F.broadcast(model.weights.select("token", "w")), "token", "left")
    sums = j.groupBy(*cols, "_row").agg(*[F.sum(F.col("w")[k]).alias(f"_s{k}") for k in range(c)])
    prior = model.log_prior
    scores = F.array(*[F.lit(prior[k]) + F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) for k in range(c)])
    return sums.select(*cols, scores.alias("scores"))


def _asked_score(model: NBModel, df: DataFrame, cols: list[str], text_col: str, head_bytes: int) -> DataFrame:
    """M4 for a weight table of any size: ``(*cols, scores)``.

    Every page of texts asks once per distinct token for its weight row
    (:mod:`.lookup`) and sums in place. The tokens with the highest counts, as
    many as fit ``head_bytes``, travel with the tasks.
    """
    import numpy as np
    import pyarrow as pa

    c = model.n_classes
    n_head = head_bytes // (8 * max(c, 1))
    tops = model.counts.groupBy("token").agg(F.sum("n_tc").alias("n")).orderBy(F.desc("n"), "token").limit(n_head)
    head = tops.join(model.weights, "token").select("token", "w").toArrow() if n_head else None     # at most n_head rows
    mine = np.zeros((0, c))
    if head is not None and head.num_rows:
        mine = head.column("w").combine_chunks().flatten().to_numpy().reshape(-1, c)
        head = head.select(["token"]).append_column("code", pa.array(np.arange(head.num_rows)))
    prior = np.asarray(model.log_prior, dtype=np.float64)

    def run(rows, sizes, codes, answers):
        w = answers.field("w")
        there = np.asarray(w.is_valid())
        own = np.zeros((len(w), c))
        own[there] = w.drop_null().flatten().to_numpy().reshape(-1, c)
        every = np.concatenate([mine, own])
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.where(codes >= 0, codes, len(mine) - 1 - codes)
        sums = np.tile(prior, (len(sizes), 1))
        for k in range(c):
            sums[:, k] += np.bincount(row, weights=every[at, k], minlength=len(sizes))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * c + 1, c), pa.int32()), pa.array(sums.ravel()))

    src = df.select(*cols, F.coalesce(token_array(text_col), F.array().cast("array<string>")).alias("_t"))
    pages = materialize(paged(src, cols, "_t", head), "score-pages")
    return answered(pages, model.weights.select("token", "w"), df.select(*cols).schema, run, "scores array<double>")


def predict(model: NBModel, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, *kept, scores, proba, pred_label, pred_intent, p_top)`` from score arrays."""
    lab = F.array(*[F.lit(x) for x in model.labels])
    ints = F.array(*[F.lit(x) for x in model.intents])
    idx = argmax("scores") + 1
    kept = [c for c in scored.columns if c not in (id_col, "scores")]
    with_p = scored.select(id_col, *kept, "scores", softmax("scores").alias("proba"), idx.alias("_i"))
    return with_p.select(id_col, *kept, "scores", "proba",
                         F.element_at(lab, F.col("_i")).alias("pred_label"),
                         F.element_at(ints, F.col("_i")).alias("pred_intent"),
                         F.element_at("proba", F.col("_i")).cast("double").alias("p_top"))


def truth_probability(model: NBModel, pred: DataFrame, id_col: str = "doc_id",
                      label_col: str = "label") -> DataFrame:
    """``(id, label, p_true)`` from predictions that kept the true label: the
    probability of the true class, read in-row from the ``proba`` array. A true
    class the model never saw has no entry and gets the floor ``LOG_FLOOR``."""
    lab = F.array(*[F.lit(x) for x in model.labels])
    k = F.array_position(lab, F.col(label_col)).cast("int")      # 0 when absent
    p = F.when(k > 0, F.element_at("proba", F.greatest(k, F.lit(1))))
    return pred.select(id_col, label_col,
                       F.greatest(F.coalesce(p, F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR)).alias("p_true"))


def truth_loss(model: NBModel, pred: DataFrame, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """``(id, label, loss)``: cross-entropy ``logsumexp(scores) - scores[true]`` per row, never clamped.

    Only a true class the model never saw has no score; it gets ``-ln(LOG_FLOOR)``.
    """
    lab = F.array(*[F.lit(x) for x in model.labels])
    k = F.array_position(lab, F.col(label_col)).cast("int")      # 0 when absent
    top = F.array_max("scores")
    lse = top + F.log(F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    own = F.when(k > 0, lse - F.element_at("scores", F.greatest(k, F.lit(1))))
    return pred.select(id_col, label_col, F.coalesce(own, F.lit(-math.log(LOG_FLOOR))).alias("loss"))


def long_form(model: NBModel, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """D8 long form ``(id, label, intent, score, p)``, one row per class."""
    with_p = scored.withColumn("proba", softmax("scores"))
    lab = F.array(*[F.lit(x) for x in model.labels])
    ints = F.array(*[F.lit(x) for x in model.intents])
    z = F.arrays_zip(lab.alias("label"), ints.alias("intent"), F.col("scores").alias("score"),
                     F.col("proba").alias("p"))
    return (with_p.select(id_col, F.inline(z))
            .select(id_col, "label", "intent", "score", "p"))
