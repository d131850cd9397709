"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every
substring of that text. Parsing a document against it takes the longest match
from the current place, closes a phrase, and goes on after it: a text in the
same language needs few, long phrases. Phrases are normalised to bits per
character, phrases * log2(training characters) / characters, and the language
with the fewest wins. ``score`` is the winner's share of 2 ** -bits over all
languages sharpened by ``SHARPNESS``.

The automaton is stored as a dense table (state, letter) -> next state and
"phrase closed", so a batch of texts is parsed in step, one NumPy gather per
character position for all (text, language) pairs of the batch.

Training reads a bounded sample: at most ``rows_per_language`` labelled rows
per language, drawn by a hash of the id; equal texts count once. Every drawn
row gives an equal piece of whole words, at a place chosen by the hash, so
that ``train_chars`` characters over all languages go into the automata.
Predictions read whole texts.

Defined cases
    null text or no letter: ``und`` with score 0. no labelled row at all: everything ``und``
    (:func:`drop_undetermined` drops texts without a letter only, also then, and leaves a missing language missing).
    very long texts: parsed whole; a phrase also ends every ``SEGMENT`` characters.
    ties: the language that sorts first. letters never seen in training: phrases of one letter.
    repeated rows and null ids: predicted like any row. empty table: no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

UNDETERMINED = "und"
TRAIN_CHARS = 128_000        # characters in all automata together
ROWS_PER_LANGUAGE = 256      # labelled rows read per language
LETTERS = 126                # most frequent letters get their own code, the rest share codes
SEGMENT = 2_048
PIECE_WORDS = 3              # training text is cut after so many words: a copied passage cannot match as one phrase
SLICE_CHARS = 1 << 20
SHARPNESS = 8.0
_OTHER = 0                   # everything that is not a letter


def letter_codes(texts: list[str], letters: int = LETTERS) -> tuple[np.ndarray, int]:
    """(code of each code point, alphabet size): 0 no letter, 1 a letter unseen in training, then the letters."""
    table = np.zeros(0x110000, dtype=np.uint8)
    cps, counts = np.unique(_points("".join(texts)), return_counts=True)
    is_letter = np.array([chr(c).isalpha() for c in cps.tolist()], dtype=bool)
    seen = cps[is_letter][np.argsort(-counts[is_letter], kind="stable")]
    table[seen] = 2 + np.arange(len(seen)) % letters
    return table, 3 + min(len(seen), letters)          # the last code, the break between pieces, is in no text


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def encode(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, has a letter) of lower-cased texts; runs of non-letters become one."""
    low = [t.lower() for t in texts]
    cp = _points("".join(low))
    code = table[cp]
    odd = np.flatnonzero((code == 0) & (cp > 127))
    if len(odd):                                       # letters that training never saw
        u, inv = np.unique(cp[odd], return_inverse=True)
        code[odd] = np.array([chr(c).isalpha() for c in u.tolist()], dtype=np.uint8)[inv]
    ascii_letter = (code == 0) & (cp >= 97) & (cp <= 122)
    code[ascii_letter] = 1
    offs = np.r_[0, np.cumsum([len(t) for t in low])].astype(np.int64)
    begin = np.zeros(len(code) + 1, dtype=bool)
    begin[offs] = True
    keep = (code != _OTHER) | begin[:-1]
    keep[1:] |= code[:-1] != _OTHER
    total = np.r_[0, np.cumsum(keep)]
    letters = np.r_[0, np.cumsum(code != _OTHER)]
    return code[keep], total[offs], np.diff(letters[offs]) > 0


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``seq``, state 0 first."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def parse_table(seq: np.ndarray, alphabet: int) -> np.ndarray:
    """Flat table: entry state * alphabet + letter is next state * alphabet * 2 + 1 if a phrase closes there."""
    nxt = suffix_automaton(seq.tolist())
    lone = len(nxt)                                    # the phrase is one letter that training never saw
    step = np.full((len(nxt) + 1, alphabet), -1, dtype=np.int64)
    for s, out in enumerate(nxt):
        for c, t in out.items():
            step[s, c] = t
    start = np.where(step[0] >= 0, step[0], lone)      # after a closed phrase the letter begins the next one
    closed = step < 0
    closed[0] = False                                  # state 0 only stands before the first letter
    return (np.where(step < 0, start[None, :], step) * alphabet * 2 + closed).astype(np.int32).ravel()


class CrossParser:
    """The automata of all languages; ``bits`` gives the normalised phrase count per text and language."""

    def __init__(self, samples: dict[str, list[str]], train_chars: int = TRAIN_CHARS, letters: int = LETTERS):
        self.langs = sorted(samples)
        share = max(1, train_chars // max(1, len(self.langs)))    # of a language
        self.codes, self.alphabet = letter_codes([t.lower() for v in samples.values() for t in v], letters)
        tables, self.base, self.log_n, at = [], [], [], 0
        for lang in self.langs:
            seq, _, _ = encode(_pieces(samples[lang], share), self.codes)
            gaps = np.flatnonzero(seq == _OTHER)[PIECE_WORDS - 1::PIECE_WORDS]
            tab = parse_table(np.insert(seq, gaps + 1, self.alphabet - 1), self.alphabet)
            self.base.append(at)
            self.log_n.append(math.log2(len(seq) + 2))
            tables.append(tab)
            at += len(tab)
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)

    def phrases(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each stretch (begin, length) in each language, all parsed in step."""
        n_l = len(self.langs)
        order = np.argsort(-length, kind="stable")
        b, ln = begin[order], length[order]
        base = np.repeat(np.array(self.base, dtype=np.int64)[:, None], len(b), axis=1)
        state = np.zeros((n_l, len(b)), dtype=np.int64)
        count = np.zeros((n_l, len(b)), dtype=np.int32)
        alive = len(b)
        for t in range(int(ln[0]) if len(ln) else 0):
            while alive and ln[alive - 1] <= t:
                alive -= 1
            c = codes[b[:alive] + t]
            v = self.table[base[:, :alive] + state[:, :alive] + c]
            count[:, :alive] += v & 1
            state[:, :alive] = v >> 1
        out = np.empty_like(count)
        out[:, order] = count + (ln > 0)               # the phrase that the end closes
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages bits per character, has a letter)."""
        codes, offs, letter = encode(texts, self.codes)
        n = np.diff(offs)
        pieces = np.maximum(1, -(-n // SEGMENT))
        text = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(text)) - np.r_[0, np.cumsum(pieces)[:-1]][text]
        begin = offs[:-1][text] + k * SEGMENT
        length = np.minimum(SEGMENT, offs[1:][text] - begin)
        ph = self.phrases(codes, begin, length)
        total = np.zeros((len(self.langs), len(n)))
        for i in range(len(self.langs)):
            total[i] = np.bincount(text, weights=ph[i], minlength=len(n))
        return (total * np.array(self.log_n)[:, None] / np.maximum(n, 1)).T, letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, has a letter) of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), encode(texts, self.codes)[2]
        bits, letter = self.bits(texts)
        best = bits.argmin(axis=1)
        z = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        score = np.where(letter, 1.0 / z.sum(axis=1), 0.0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letter.tolist())], score, letter


def _pieces(texts: list[str], limit: int) -> list[str]:
    """Of each text an equal share of ``limit`` characters, in whole words, from a place that its hash chooses."""
    out, left = [], limit
    order = sorted(set(texts), key=len)                      # what short texts leave over goes to the longer ones
    for k, t in enumerate(order):
        size = max(1, left // (len(order) - k))
        if len(t) > size:
            a = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (len(t) - size + 1)
            piece = t[a:a + size]
            whole = piece.split(None, 1)[-1] if a and not t[a - 1].isspace() else piece
            if a + size < len(t) and not t[a + size].isspace():
                whole = (whole.rsplit(None, 1) or [whole])[0]
            t = whole or piece
        out.append(t + "\n")
        left -= len(t)
    return out


def sample_rows(labelled: DataFrame, lang_col: str, text_col: str, rows_per_language: int, max_chars: int) -> dict:
    """{language: texts}: at most ``rows_per_language`` rows each, drawn by a hash of the id.

    Of a text longer than ``max_chars``, which is more than any row can give, a
    stretch of that length from a place chosen by the hash travels to the driver.
    """
    lang = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in lang.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    key = F.xxhash64(F.col("_id"), F.lit(7))
    share = F.lit(0.0)                     # a row is drawn when its hash, as a share of all, is under its language's rate
    for k, n in counts.items():
        share = F.when(F.col(lang_col) == F.lit(k), F.lit(min(1.0, rows_per_language / n))).otherwise(share)
    u = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    begin = F.pmod(F.xxhash64("_id", F.lit(11)), F.greatest(F.char_length(text_col) - max_chars + 1, F.lit(1))) + 1
    rows = (lang.where(u < share).select(F.col(lang_col).alias("l"),
                                         F.substr(text_col, begin.cast("int"), F.lit(max_chars)).alias("t"), key.alias("k"))
            .orderBy("k").limit(2 * rows_per_language * len(counts)).collect())
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in rows:
        if len(out[r["l"]]) < rows_per_language:
            out[r["l"]].append(r["t"])
    return {k: v for k, v in out.items() if any(any(c.isalpha() for c in t) for t in v)}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        held_out_mod: int | None = 5, train_chars: int = TRAIN_CHARS,
        rows_per_language: int = ROWS_PER_LANGUAGE) -> CrossParser:
    """Automata of the labelled rows; rows whose crc32(id) mod ``held_out_mod`` is 0 are left out."""
    d = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[lang_col].alias("_lang"))
    if held_out_mod:
        d = d.where(crc_mod(F.col("_id"), held_out_mod) != 0)
    return CrossParser(sample_rows(d, "_lang", "_text", rows_per_language, train_chars), train_chars)


def predict(docs: DataFrame, model: CrossParser, text_col: str = "text", out_lang: str = "lang_pred",
            out_score: str = "score", keep: list[str] | None = None, out_letter: str | None = None) -> DataFrame:
    """``keep`` columns (all by default) and the predicted language and score, read from the text only;
    with ``out_letter`` also whether the text has a letter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in (docs.columns if keep is None else keep) if c not in (out_lang, out_score, out_letter)]
    kept = [docs[f"`{c}`"] for c in cols]
    schema = docs.select(kept).schema.add(out_lang, "string").add(out_score, "double")
    if out_letter:
        schema = schema.add(out_letter, "boolean")
    if text_col in cols and docs.schema[text_col].dataType.simpleString() == "string":
        at = cols.index(text_col)              # the text travels once
    else:
        at = len(cols)
        kept.append(docs[text_col].cast("string").alias("_parse_text"))

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores, letters = [], [], []
            for lo, hi in _slices([len(t or "") for t in texts]):
                p, s, has = m.predict([t or "" for t in texts[lo:hi]])
                langs += p
                scores.append(s)
                letters += has.tolist()
            score = np.concatenate(scores) if scores else np.zeros(0)
            added = [pa.array(langs, pa.string()), pa.array(score), *([pa.array(letters, pa.bool_())] if out_letter else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(cols)], *added], names=schema.names)
    return docs.select(kept).mapInArrow(run, schema)


def _slices(sizes: list[int]):
    lo, used = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and used + s > SLICE_CHARS:
            yield lo, i
            lo, used = i, 0
        used += s
    if sizes:
        yield lo, len(sizes)


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      out_lang: str | None = None) -> DataFrame:
    """Rows whose text has a letter, each with a language; all other columns unchanged.

    A row that comes with a language keeps it. A row without one gets the
    predicted language (none where no language could be learned). Rows without
    a letter are undetermined and go. With ``out_lang`` every row's text is
    parsed and the last column of this name has its predicted language
    (``und`` where none could be learned); otherwise rows that come with a
    language are only looked at for a letter.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])       # no name can clash with the added columns
    text, lang = f"c{names.index(text_col)}", f"c{names.index(lang_col)}"
    said = plain.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    model = fit(docs, id_col, text_col, lang_col)
    found = F.when(F.col("_lang") != UNDETERMINED, F.col("_lang")).cast(docs.schema[lang_col].dataType)
    parse = plain.where(F.col(lang).isNull()) if out_lang is None else plain.where(F.col(lang).isNull()).unionByName(said)
    out = predict(parse, model, text, "_lang", "_score", out_letter="_letter").drop("_score")
    out = out.where(F.col("_letter") | F.col(lang).isNotNull()).withColumn(lang, F.coalesce(F.col(lang), found)).drop("_letter")
    if out_lang is None:
        return said.unionByName(out.drop("_lang")).toDF(*names)
    kept = [k for k, c in enumerate(names) if c != out_lang]
    return out.select(*[F.col(f"c{k}").alias(names[k]) for k in kept], F.col("_lang").alias(out_lang))
