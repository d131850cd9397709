"""Secret scan with a random forest that removes false positives (DataFrame and Spark ML operations only).

Candidates, in whitespace-separated words of the whole text, are
    runs of at least ``MIN_LENGTH`` key characters with a digit or an upper-case
    letter beyond the first place;
    matches of a published key format, whatever their length;
    what follows a name such as ``password`` or ``token`` and ``=`` or ``:``, at
    any length and of any non-space characters: between quotes, else to the end
    of the word without closing commas and semicolons.
Features: length; shares of digits, upper-case letters and hex
digits; runs of one character class per character and distinct characters
(character transitions); how far the candidate's four-letter stretches are
those of the corpus' own words; whether the word looks like a path, an
address or a URL; and whether the words before it name a secret or assign it.

The dictionary counts the four-letter stretches of the lower-case words of all
texts (words are partially aggregated; at most 26^4 stretches exist, none is
left out). A stretch weighs n / (n + noise), with noise the count it would have
if a share ``NOISE`` of all stretches were random letters: a weight that does
not move with the size of the corpus.

Training findings are labelled from the corpus itself, there being no labelled
table: a candidate in a published key format, or assigned to a name such as
``password`` or ``token``, is a finding; prose in capitals, addresses, paths and
bare numbers are not; the rest stays unlabelled and is judged by the forest, also
short, numeric or plain-word values that are assigned to such a name.
At most ``TRAIN_ROWS`` labelled candidates, drawn by hash, train it; those of documents
whose crc32(doc_id) mod 5 is 0 are held out.

The label rule reads names, assignments, paths and addresses, and so could the
forest. Every training row is therefore there twice, once with those EVIDENCE
features withheld (set to 0): the forest has to find the same answer in length,
transitions and dictionary alone, and a candidate without evidence is judged by
them. :func:`quality` holds the forest against the held-out labels with the
evidence withheld.

Defined cases
    null or empty text: no candidate. one label only in training: the label rule decides, score 0 or 1.
    very long texts: whole. repeated rows: each gives its candidates. empty table: no rows.
    ties at 0.5: a secret. null id: not held out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .common import crc_mod

MIN_LENGTH = 16
TRAIN_ROWS = 20_000
NOISE = 0.01                 # share of random letters at which a stretch of them weighs one half
TREES, DEPTH = 20, 6
# Published key formats and the names that secrets are assigned to.
KEY_FORMATS = (r"^(AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
               r"^sk_live_[A-Za-z0-9]{16,}$", r"^AIza[0-9A-Za-z_-]{35}$", r"^eyJ[A-Za-z0-9_-]{10,}$")
SECRET_NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|bearer|credential|private[_-]?key)"

_RUN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH
_KEYS = "(?<![A-Za-z0-9])(?:" + "|".join(f.strip("^$") for f in KEY_FORMATS) + ")(?![A-Za-z0-9])"
KEY_LENGTH = 13              # shortest match of a key format
_NAME = SECRET_NAMES + r"[A-Za-z0-9_-]{0,64}+[\"'`)\]]*"
_TO = r"\s?[=:]+>?\s?"        # between a name and its value; the value is group 3 or, in quotes, group 4
_PLAIN, _QUOTED = r"[\"'`(\[{]*([^\s\"'`=:]\S*?)[,;]*$", r"([\"'`])(\S+?)\3\S*$"
_WHOLE_NAME = SECRET_NAMES + r"s?(?-i:(?![a-z]))[A-Za-z0-9_-]{0,64}+[\"'`)\]]*"       # password, token_2; not author
FEATURES = ["length", "digits", "upper", "hex", "transitions", "distinct", "dictionary", "path", "url", "address",
            "named", "assigned", "quoted"]
EVIDENCE = ["path", "url", "address", "named", "assigned", "quoted"]     # what the label rule reads beside the value's own letters
HELD_OUT_MOD = 5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_no, word, before, value, by_name): one row per candidate, in whole texts."""
    text = docs[text_col].cast("string")
    d = docs.select(docs[id_col].alias("doc_id"), F.split(text, r"\s+").alias("w"), text.rlike(_NAME + r"\s*[=:]").alias("names"))
    numbered = F.transform("w", lambda x, i: F.struct(i.alias("word_no"), x.alias("word")))
    some = F.filter(numbered, lambda s: _has_run(s["word"]) | _has_key(s["word"])
                    | (F.col("names") & _after_name(F.col("w"), s["word_no"], s["word"])))
    one = d.select("doc_id", "w", F.explode(some).alias("s")).select(
        "doc_id", F.col("s.word_no").alias("word_no"), F.col("s.word").alias("word"),
        _before(F.col("w"), F.col("s.word_no")).alias("before"))
    near = F.concat_ws(" ", "before", "word")
    quoted, plain = F.regexp_extract(near, _NAME + _TO + _QUOTED, 4), F.regexp_extract(near, _NAME + _TO + _PLAIN, 3)
    one = one.withColumn("named_value", F.when(quoted != "", quoted).otherwise(plain))
    runs = F.filter(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)), lambda v: v.rlike(r"[0-9]|.[A-Z]"))
    keys = F.regexp_extract_all("word", F.lit(_KEYS), F.lit(0))
    named = F.filter(F.array("named_value"), lambda v: v != "")
    out = one.withColumn("value", F.explode(F.array_distinct(F.concat(runs, keys, named))))
    by_name = (F.col("value") == F.col("named_value")) & near.rlike(_WHOLE_NAME + _TO + r"[\"'`(\[{]*\S+$")
    return out.select("doc_id", "word_no", "word", "before", "value", by_name.alias("by_name"))


def _has_run(word: Column) -> Column:
    return (F.char_length(word) >= MIN_LENGTH) & word.rlike(_RUN) & word.rlike(r"[0-9]|.[A-Z]")


def _has_key(word: Column) -> Column:
    return (F.char_length(word) >= KEY_LENGTH) & word.rlike(_KEYS)


def _before(words: Column, word_no: Column) -> Column:
    """The one or two words before, joined."""
    return F.concat_ws(" ", F.slice(words, F.greatest(word_no - 1, F.lit(1)), F.least(word_no, F.lit(2))))


def _after_name(words: Column, word_no: Column, word: Column) -> Column:
    last = F.coalesce(F.get(words, word_no - 1), F.lit(""))
    return ((word.contains("=") | word.contains(":") | last.contains("=") | last.contains(":"))
            & F.concat_ws(" ", _before(words, word_no), word).rlike(_NAME + _TO + r"(?:[\"'`(\[{]*[^\s\"'`=:]|[\"'`])\S*$"))


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, weight): the four-letter stretches of lower-case words, counted over all texts; at most 26^4 rows."""
    words = docs.select(F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    grams = words.select(F.explode(_grams(F.col("w"))).alias("gram"), "c").groupBy("gram").agg(F.sum("c").alias("n"))
    grams = materialize(grams, "secret-dictionary")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return grams.select("gram", (F.col("n") / (F.col("n") + F.lit(NOISE * total / 26 ** 4))).alias("weight"))


def _grams(word: Column) -> Column:
    stretches = F.regexp_extract_all(word, F.lit("(?s)(?=(.{4}))"), F.lit(1))
    return F.when(F.char_length(word) < 4, F.array(word)).otherwise(stretches)


def _share(value: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(value, f"[^{chars}]", "")) / F.char_length(value)


def with_features(cand: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates (keyed ``cid``) with the feature columns; ``words`` is the dictionary (at most 26^4 rows, broadcast)."""
    value, word, before = F.col("value"), F.col("word"), F.col("before")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    grams = cand.select("cid", F.explode(F.array_distinct(_grams(F.lower(value)))).alias("gram"))
    held = (grams.join(F.broadcast(words), "gram", "left").groupBy("cid")
            .agg(F.round(F.avg(F.coalesce("weight", F.lit(0.0))), 9).alias("dictionary")))
    flag = lambda c: c.cast("double")
    return cand.join(held, "cid").select(
        *cand.columns, F.char_length(value).cast("double").alias("length"), _share(value, "0-9").alias("digits"),
        _share(value, "A-Z").alias("upper"), _share(value, "0-9a-fA-F").alias("hex"),
        (F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")) / F.char_length(value)).alias("transitions"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.char_length(value)).alias("distinct"),
        "dictionary",
        flag(value.rlike("/.*/|^/") | word.rlike(r"\.[a-z]{2,4}$")).alias("path"),
        flag(word.rlike("://|www\\.")).alias("url"), flag(word.contains("@")).alias("address"),
        flag(F.col("by_name") | before.rlike(SECRET_NAMES) | _assigned_name(word).rlike(SECRET_NAMES)).alias("named"),
        flag(F.col("by_name") | word.rlike("^[^=:]+[=:]") | before.rlike("[=:]$")).alias("assigned"),
        flag(word.rlike("^[\"'`]")).alias("quoted"))


def _assigned_name(word: Column) -> Column:
    return F.regexp_extract(word, r"^([A-Za-z_-]+)[=:]", 1)


def weak_label(found: DataFrame) -> Column:
    """1 finding, 0 false positive, null not labelled."""
    key = F.lit(False)
    for f in KEY_FORMATS:
        key = key | F.col("value").rlike(f)
    prose = (F.col("digits") == 0) & (F.col("dictionary") >= 0.5) & ~F.col("by_name")
    number = (F.col("digits") == 1) & ~F.col("by_name")
    harmless = (((F.col("address") == 1) | (F.col("url") == 1)) & ~F.col("by_name")) | number | ((F.col("path") == 1) & (F.col("named") == 0))
    assigned = (F.col("length") >= MIN_LENGTH) & (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("digits") < 1)
    return F.when(key | (assigned & (F.col("dictionary") < 0.5)), 1.0).when(prose | harmless, 0.0)


def withheld(found: DataFrame) -> DataFrame:
    """The rows without the features that the label rule reads."""
    return found.withColumns({c: F.lit(0.0) for c in EVIDENCE})


def labelled_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its features, its label (null: no evidence) and whether it is held out, written once."""
    cand = materialize(candidates(docs, id_col, text_col).withColumn("cid", F.monotonically_increasing_id()), "secret-candidates")
    found = with_features(cand, dictionary(docs, text_col))
    held = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == 0)
    return materialize(found.withColumn("label", weak_label(found)).withColumn("held_out", held), "secret-features")


def fit(found: DataFrame, train_rows: int = TRAIN_ROWS):
    """The forest of the labelled rows that are not held out; None when they have one label only."""
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier

    train = (found.where("label is not null and not held_out")
             .orderBy(F.xxhash64("doc_id", "word_no", "value"), "doc_id", "word_no", "value").limit(train_rows))
    train = train.select("label", *FEATURES)
    train = materialize(_vectors(train.unionByName(withheld(train))).select("label", "features"), "secret-train")
    if train.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42, featureSubsetStrategy="sqrt").fit(train)
    path = shared_path(found.sparkSession, "secret-forest")        # read back: without its training summary it can be sent to tasks
    forest.write().save(path)
    return RandomForestClassificationModel.load(path)


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def judged(found: DataFrame, forest) -> DataFrame:
    """``found`` with the forest's ``score`` and ``secret``; without a forest the label rule decides."""
    from pyspark.ml.functions import vector_to_array
    if forest is None:
        score = F.coalesce("label", F.lit(0.0))
        return found.withColumn("score", score).withColumn("secret", F.col("score") >= 0.5)
    p = vector_to_array(F.col("probability"))[1]
    out = forest.transform(_vectors(found))
    return out.withColumn("score", p).withColumn("secret", F.col("score") >= 0.5).select(*found.columns, "score", "secret")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, word_no, value, score, secret: every candidate with the forest's probability of a real secret."""
    found = labelled_candidates(docs, id_col, text_col)
    return judged(found, fit(found, train_rows)).select("doc_id", "word_no", "value", "score", "secret")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """n, n_secret, n_flagged, precision, recall of the forest on held-out labelled rows, their evidence withheld."""
    found = labelled_candidates(docs, id_col, text_col)
    rows = judged(withheld(found.where("label is not null and held_out")), fit(found, train_rows))
    hit = F.sum(((F.col("label") == 1) & F.col("secret")).cast("bigint"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("n_secret"),
                    F.sum(F.col("secret").cast("bigint")).alias("n_flagged"),
                    (hit / F.sum(F.col("secret").cast("bigint"))).alias("precision"),
                    (hit / F.sum((F.col("label") == 1).cast("bigint"))).alias("recall"))
