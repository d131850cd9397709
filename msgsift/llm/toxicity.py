"""Toxicity by a counterfactual-regularised linear classifier.

Features are whole words and word beginnings (4, 5 and 6 bytes) that occur in
enough training texts and lean to one label. A logistic regression over their
presence is fitted to labelled texts with one more penalty: sentences that
mention a group are copied with the identity term swapped for another one, and
any change of the score between the copies is penalised. As few corpora
mention groups often enough, every term is also appended to a fixed number of
labelled sentences and swapped there. Weights that hang on the mention itself
are driven to zero, so a neutral mention does not raise the score.

Training reads the whole texts of at most ``rows_per_class`` labelled documents
per label, drawn by a hash of the id. Every sentence of them that mentions a
group is swapped, one mention at a time. Scores read whole texts and nothing
but the text.

Defined cases
    null or wordless text: the score of a text without features. null label: not used.
    only one label, or none, in training: every score is the add-one rate of label 1.
    ids with several labels: each pair of row and label counts. ties in the sample: by id.
    very long texts: read whole. empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .textbytes import ALNUM_WORDS, batch_words, hash_words, mix

ROWS_PER_CLASS = 3_000
MAX_FEATURES = 20_000
MIN_TEXTS = 3              # training texts a feature must occur in
Z_LEAST = 3.0              # lean to one label, in standard deviations
PREFIXES = (4, 5, 6)
SWAP_PENALTY = 1.0
SENTENCES = 200            # labelled sentences that get each identity term appended
# Identity terms, one group per line of meaning and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "straight", "lesbian", "transgender", "black", "white", "asian", "muslim",
     "christian", "jewish", "hindu", "atheist", "immigrant", "refugee", "disabled", "deaf", "old", "young"),
    ("frauen", "männer", "schwul", "lesbisch", "schwarz", "weiß", "muslimisch", "christlich", "jüdisch", "flüchtling"),
    ("femmes", "hommes", "gai", "lesbienne", "noir", "blanc", "musulman", "chrétien", "juif", "réfugié"),
    ("mujeres", "hombres", "gay", "lesbiana", "negro", "blanco", "musulmán", "cristiano", "judío", "refugiado"),
)


def word_features(w) -> np.ndarray:
    """(1 + len(PREFIXES)) x words feature hashes; 0 where a word is no longer than the prefix."""
    out = np.zeros((1 + len(PREFIXES), len(w.starts)), dtype=np.uint64)
    out[0] = w.hashes()
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(w.ends - w.starts > n)
        out[k, long] = mix(hash_words(w.buf, w.starts[long], w.starts[long] + n) ^ np.uint64(n))
    return out


def _pairs(texts: list[str], short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature hash) pairs; ``short``: only the shortest feature of each word."""
    rows, feats = [], []
    for w in batch_words(pa.array(texts, pa.string()), ALNUM_WORDS):
        f = word_features(w)
        if short:
            f = np.where(f[1] != 0, f[1], f[0])[None, :]
        t = np.broadcast_to(w.text_of() + w.lo, f.shape)
        keep = f != 0
        u = np.unique(np.stack([t[keep].astype(np.uint64), f[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
        rows.append(u[0].astype(np.int64))
        feats.append(u[1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(feats)


def swapped_sentences(texts: list[str], sentences: int = SENTENCES) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in the identity term only."""
    import re
    group = {t: g for g in IDENTITY_TERMS for t in g}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, group), key=len, reverse=True)) + r")\b", re.I)
    out, plain = [], []
    for text in texts:
        for s in re.split(r"(?<=[.!?\n])\s+", text):
            mentions = list(pattern.finditer(s))
            for m in mentions:
                g = group[m.group(0).lower()]
                at = g.index(m.group(0).lower())
                for step in (1, 2):
                    out.append((s, s[:m.start()] + g[(at + step) % len(g)] + s[m.end():]))
            if not mentions and len(plain) < sentences and s.strip():
                plain.append(s)
    for s in plain:
        for g in IDENTITY_TERMS:
            out += [(s, f"{s} {a}") for a in g]
    return out


class ToxicityModel:
    """Sorted feature hashes, their weights and the intercept."""

    def __init__(self, feats: np.ndarray, weights: np.ndarray, bias: float):
        self.feats, self.weights, self.bias = feats, weights, bias
        self.seen = np.zeros(1 << 18, dtype=bool)      # first look: top 18 bits of the hash
        self.seen[(feats >> np.uint64(46)).astype(np.int64)] = True

    def logits(self, col) -> np.ndarray:
        out = []
        for w in batch_words(col, ALNUM_WORDS):
            f = word_features(w)
            kind, word = np.nonzero(self.seen[(f >> np.uint64(46)).astype(np.int64)])
            h = f[kind, word]
            at = np.minimum(np.searchsorted(self.feats, h), max(len(self.feats) - 1, 0))
            ok = self.feats[at] == h if len(self.feats) else np.zeros(len(h), dtype=bool)
            n = len(self.feats) + 1
            pair = np.unique(w.text_of()[word[ok]] * n + at[ok])     # a feature counts once per text
            out.append(self.bias + np.bincount(pair // n, weights=self.weights[pair % n], minlength=w.hi - w.lo))
        return np.concatenate(out) if out else np.zeros(0)


def fit_texts(texts: list[str], y: np.ndarray, penalty: float = SWAP_PENALTY, steps: int = 200,
              l2: float = 1e-3) -> ToxicityModel:
    """Gradient descent (Adam) on log loss + l2 + penalty * mean squared score change between swapped sentences."""
    n, pos = len(y), int(y.sum())
    base = (pos + 1) / (n + 2)
    flat = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(base / (1 - base))))
    if pos == 0 or pos == n:
        return flat
    row, feat = _pairs(texts)
    uniq, inv = np.unique(feat, return_inverse=True)
    df, dp = np.bincount(inv), np.bincount(inv, weights=y[row])
    rate = pos / n
    z = np.abs(dp - df * rate) / np.sqrt(df * rate * (1 - rate) + 1e-9)
    good = np.flatnonzero((df >= MIN_TEXTS) & (z >= Z_LEAST))
    good = np.sort(good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]])
    if not len(good):
        return flat
    index = np.full(len(uniq), -1)
    index[good] = np.arange(len(good))
    keep = index[inv] >= 0
    row, col = row[keep], index[inv[keep]]
    # every text once more by its words' beginnings alone, so that these carry the label without the whole word
    row2, feat2 = _pairs(texts, short=True)
    at = np.minimum(np.searchsorted(uniq, feat2), len(uniq) - 1)
    ok = (uniq[at] == feat2) & (index[at] >= 0)
    row, col, y = np.r_[row, row2[ok] + n], np.r_[col, index[at[ok]]], np.r_[y, y]
    n, pos = 2 * n, 2 * pos
    # differences between swapped sentences: +1 for features only in the first, -1 only in the second
    a, b = zip(*swapped_sentences(texts)) if texts else ((), ())
    d_row, d_col, d_val = [], [], []
    for side, sign in ((a, 1.0), (b, -1.0)):
        r, f = _pairs(list(side))
        at = np.minimum(np.searchsorted(uniq[good], f), len(good) - 1)
        ok = uniq[good][at] == f
        d_row.append(r[ok])
        d_col.append(at[ok])
        d_val.append(np.full(int(ok.sum()), sign))
    d_row, d_col, d_val = map(np.concatenate, (d_row, d_col, d_val))
    m = max(1, len(a))
    w, bias, k = np.zeros(len(good)), flat.bias, len(good)
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos))           # both labels weigh the same
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights=w[col], minlength=n))))
        e = weight * (p - y)
        g = np.bincount(col, weights=e[row], minlength=k) + l2 * w
        diff = np.bincount(d_row, weights=d_val * w[d_col], minlength=m)
        g += penalty * 2 / m * np.bincount(d_col, weights=d_val * diff[d_row], minlength=k)
        g = np.append(g, e.sum())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return ToxicityModel(uniq[good], w, float(bias))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out_mod: int,
           rows_per_class: int) -> tuple[list[str], np.ndarray]:
    """Labelled texts: per label the documents with the smallest hashes, never a held-out one, nor a label without a document."""
    lab = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (crc_mod(F.col("i"), held_out_mod) != 0))
    lab = lab.join(docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("i")), "i", "left_semi")
    # ids first (at most 2 * rows_per_class), so only their texts are joined
    picked = None
    for v in (0, 1):
        part = lab.where(F.col("y") == v).orderBy(F.xxhash64("i"), "i").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
            .join(F.broadcast(picked), "i").where(F.col("t").isNotNull())
            .orderBy(F.xxhash64("i"), "i", "y", "t").limit(2 * rows_per_class).collect())
    return [r["t"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        held_out_mod: int = 5, rows_per_class: int = ROWS_PER_CLASS, penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Model of the labelled rows whose crc32(id) mod ``held_out_mod`` is not 0."""
    texts, y = sample(docs, labels, id_col, text_col, label_col, held_out_mod, rows_per_class)
    return fit_texts(texts, y, penalty)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            z = shared.value.logits(b.column(1))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return (docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, score double, predicted int"))
