"""Language ID, token counts, secret scan, WARC, toxicity and LM scores against brute force or exact round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsift.llm import langid, ngramlm, queries, secrets, tokencount, toxicity, warc
from msgsift.session import shared_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- language ID

def _phrases(text: str, train: str) -> int:
    """Cross parsing by definition: longest match, at least one letter, then on."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in train and text[i:j] in train:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parse_counts_longest_matches():
    rng = random.Random(1)
    train = "".join(rng.choice("abc ") for _ in range(400)).strip()
    seq = np.array([ord(c) % 7 for c in train], dtype=np.uint8)
    model = langid.CrossParser({"x": ["abc"]})
    model.alphabet = 8
    model.table, model.base = langid.parse_table(seq, 8), [0]
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (1, 2, 17, 300)]
    codes = np.concatenate([[ord(c) % 7 for c in t] for t in texts]).astype(np.uint8)
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = model.phrases(codes, offs[:-1], np.diff(offs))[0]
    keyed = "".join(chr(65 + c) for c in seq)
    assert got.tolist() == [_phrases("".join(chr(65 + ord(c) % 7) for c in t), keyed) for t in texts]


def test_language_id_learns_and_handles_odd_rows(spark):
    rng = random.Random(4)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "schnell gruß über weg klein".split(), "cc": "пример слово язык дом".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(3, 60))), k, 1.0) for i, k in
            enumerate(rng.choices(list(words), k=300))]
    rows += [(900, None, "aa", 1.0), (901, "", "aa", 1.0), (902, "123 !?", "aa", 1.0), (None, "dolor sit", None, 1.0),
             (903, " ".join(words["bb"] * 20_000), None, 1.0), (904, "漢字", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs), keep=["doc_id", "lang"]).collect()}
    assert all(r.lang_pred == r.lang for i, r in out.items() if i is not None and i < 900)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[902].score == 0.0
    assert out[None].lang_pred == "aa" and out[903].lang_pred == "bb" and out[904].lang_pred in words
    kept = langid.drop_undetermined(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(none, langid.fit(none), keep=["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs), keep=["doc_id"]).count() == 0


def test_every_drawn_row_gives_a_piece_of_whole_words():
    texts = [" ".join("%s%d" % ("abcdefghij"[k], i) for i in range(n)) for k, n in enumerate([1, 2, 30, 400, 400, 400, 5_000])]
    texts.append("z" * 900)                                  # no place to cut at a word
    pieces = langid._pieces(texts + texts, 1_600)            # equal texts count once
    assert len(pieces) == len(texts) and sum(map(len, pieces)) <= 1_600 + len(texts)
    for t in texts[:-1]:
        mine = [p.strip() for p in pieces if p[0] == t[0]]
        assert len(mine) == 1 and mine[0] and set(mine[0].split()) <= set(t.split())
    long = [len(p) for p in pieces if p[0] in "defg"]
    assert min(long) > 0.8 * max(long)                       # equal shares, not the first rows' whole texts
    assert all(not t.startswith(p.strip()) for t in texts for p in pieces if p[0] == t[0] == "g")


def test_rows_without_a_language_get_the_predicted_one(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "schnell gruß über weg klein"}
    rows = [(i, words[k] * (i % 5 + 1), k) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(900, "dolor amet ipsum", None), (901, "über gruß klein", None), (902, "12 !", None), (903, None, None), (904, "!", "aa"),
             (905, "schnell klein", "aa"), (906, "é", "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang for r in langid.drop_undetermined(docs).collect()}
    assert (got[900], got[901], got[905], got[906]) == ("aa", "bb", "aa", "bb") and not {902, 903, 904} & set(got)
    assert len(got) == len(rows) - 3
    unknown = langid.drop_undetermined(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == len(rows) - 3 and {r.lang for r in unknown} == {None}


# ---- token counts

def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab = tokencount.load_vocabulary(queries.VOCABULARY)
    lib = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(3)
    texts = ["", " ", "a", " a", "a  b ", "Hello, world!\nNew line\tTab", "naïve café 漢字 😀😀 x", "▁mark ▁", "<s> </s> <0x41>",
             "x" * 500, "\u0000 \u0001", "The quick brown fox " * 300]
    texts += ["".join(rng.choice("ab etions\n.éß漢 ") for _ in range(rng.randrange(80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, None, 5)], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, queries.VOCABULARY).collect()}
    score = dict(vocab)
    for i, t in enumerate(texts):
        enc = lib.encode(t, add_special_tokens=False)
        assert got[i].n_tokens == len(enc.ids), t
        if t and not any(x.startswith("<0x") for x in enc.tokens):
            assert got[i].score == pytest.approx(sum(score[x] for x in enc.tokens)), t
    assert got[None].n_tokens == 0 and got[None].score == 0
    assert tokencount.count_tokens(docs.limit(0), queries.VOCABULARY).count() == 0


def test_token_ties_keep_the_piece_that_begins_first():
    c = tokencount.UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)])
    assert c.segment("▁aaa") == (2, -4.0)        # ▁ + aaa, not one of the longer ways of equal score
    assert c.segment("▁aé") == (3, -2.0 - 13.0)  # é: two bytes
    small = tokencount.UnigramCounter([("a", -1.0)], cache_words=2)
    assert [small.count("a a b a c a d a")[0] for _ in range(2)] == [small.count("a a b a c a d a")[0]] * 2


# ---- secrets

def test_secret_scan_keeps_findings_and_drops_prose(spark):
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    prose = "the administration understanding internationalisation of characterisation and responsibilities "
    rows, truth = [], {}
    for i in range(400):
        kind = i % 5
        secret = {0: f"password={hexa(18)}", 1: f'token = "{hexa(40)}"', 2: "AKIA" + base(), 3: "4" + str(rng.randrange(10 ** 14, 10 ** 15)),
                  4: prose.split()[3].upper() + "S"}[kind]
        rows.append((i, prose + secret + " " + prose, "v", True))
        truth[i] = kind < 3
    rows += [(900, None, "v", True), (901, "", "v", True), (None, f"password={hexa(18)}", "v", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, value string, secret boolean")
    got = secrets.scan(docs)
    flagged = {r.doc_id for r in got.where("secret").collect()}
    assert flagged - {None} == {i for i, t in truth.items() if t} and None in flagged
    assert not {"mapInArrow", "Python"} & set(re.findall(r"mapInArrow|Python", got._jdf.queryExecution().toString()))
    assert secrets.scan(docs.limit(0)).count() == 0
    one = secrets.scan(docs.where("doc_id % 5 = 2"))        # findings only: the label rule decides
    assert {r.secret for r in one.collect()} == {True}


def test_secret_candidates_of_any_length_after_a_name_and_in_key_formats(spark):
    slack = "xoxb" + "-1234567890"          # 15 characters
    values = {"password=Hunter2!": "Hunter2!", "the pin token: 4711 is": "4711", 'pwd = "p@$$.w#rd!"; next': "p@$$.w#rd!",
              "passphrase=correcthorse": "correcthorse", "db.API_KEY_2=>'a1'": "a1", "secret:\n  x9, then": "x9",
              f"see {slack} there": slack, f"({slack})": slack, '{"password":"ab.c!1","n":2}': "ab.c!1",
              "sk_live_" + "a" * 16: "sk_live_" + "a" * 16, "password=abcdefghijklmnop1!": "abcdefghijklmnop1!"}
    none = ["password", "a password is needed", "time: 12:30 and x=1", "password= "]
    docs = spark.createDataFrame(list(enumerate([*values, *none])), "doc_id bigint, text string")
    got = defaultdict(set)
    for r in secrets.candidates(docs).collect():
        got[r.doc_id].add(r.value)
    assert all(v in got[i] for i, v in enumerate(values.values())), got
    assert not any(got[i] for i in range(len(values), len(values) + len(none))), got


def test_short_secrets_after_a_name_are_found(spark):
    rng = random.Random(3)
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    prose = "the administration understanding internationalisation of characterisation and responsibilities "
    kinds = [lambda: f"password={mixed(24)}", lambda: "INTERNATIONALISATIONS", lambda: "4" + str(rng.randrange(10 ** 14, 10 ** 15))]
    rows = [(i, prose + kinds[i % 3]() + " " + prose) for i in range(300)]
    rows += [(1_000, prose + "password=Hunter2!"), (1_001, prose + "password=correcthorse"), (1_002, prose + "token: 4711")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = secrets.scan(docs).collect()
    got = {r.doc_id for r in out if r.secret}
    assert (1_001, "correcthorse") in {(r.doc_id, r.value) for r in out}          # plain words: scored, the forest decides
    assert {1_000, 1_002} <= got and {i for i in got if i < 1_000} == {i for i in range(300) if i % 3 == 0}


def test_forest_finds_held_out_secrets_without_the_label_rules_evidence(spark):
    rng = random.Random(5)
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    prose = "the administration understanding internationalisation of characterisation and responsibilities "
    kinds = [lambda: f"password={mixed(24)}", lambda: "INTERNATIONALISATIONS", lambda: "4" + str(rng.randrange(10 ** 14, 10 ** 15)),
             lambda: f"token: {mixed(30)}", lambda: "https://example.org/understanding/administration"]
    rows = [(i, prose + kinds[i % 5]() + " " + prose) for i in range(600)]
    bare = {1_000 + i: mixed(28) for i in range(20)}                            # no name, no format: nothing labels them
    rows += [(i, f"{prose} {v} {prose}") for i, v in bare.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    q = secrets.quality(docs).first()
    assert q.n >= 80 and q.n_secret >= 20 and q.precision >= 0.9 and q.recall >= 0.9, q
    found = secrets.labelled_candidates(docs)
    assert {r.label for r in found.where("doc_id >= 1000").collect()} == {None}
    got = {r.doc_id: r.secret for r in secrets.scan(docs).collect() if r.value in bare.values()}
    assert sum(got[i] for i in bare) >= 18


def test_secret_dictionary_counts_every_text(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [" ".join(word(rng.randrange(4, 9)) for _ in range(4)) for _ in range(6_000)] + [None, "", "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n = Counter(w[i:i + 4] for t in texts for w in (t or "").split() for i in range(len(w) - 3))
    noise = secrets.NOISE * sum(n.values()) / 26 ** 4
    got = {r.gram: r.weight for r in secrets.dictionary(docs, "text").collect()}
    assert got.keys() == n.keys()
    assert all(w == pytest.approx(n[g] / (n[g] + noise)) for g, w in got.items())


# ---- WARC

def _pages(spark):
    big = "<p>" + "é word " * 300_000
    rows = [(5, "http://a/5", "x" * 100), (3, "http://a/3", "x" * 100), (9, "http://a/9", "x" * 100), (1, None, "short"),
            (2, "http://a/2\r\nEvil: 1", "short"), (7, "u7", None), (8, "u8", ""), (10, "u10", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9),
            (11, "u11", big), (12, "u12", big), (None, "n1", "y" * 200), (None, "n2", "y" * 200), (13, "u13", "z\u0000" * 60), (14, "u14", "y" * 200)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")


def test_warc_round_trip_and_revisits(spark):
    rows, pages = _pages(spark)
    got = warc.archive_pages(pages).collect()
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        lead = first.get(h)
        revisit = lead is not None and lead != i
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_index_reads_selected_ranges(spark):
    rows, pages = _pages(spark)
    path = warc.write_archives(pages, path=shared_path(spark, "warc-test"))
    index = warc.build_index(spark, path)
    assert index.count() == len(rows)
    ends = index.groupBy("path").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end").count() == 0
    some = warc.read_records(index.where("page in ('10', '13', '1')"), with_payload=True).collect()
    by_id = {r[0]: r[2] for r in rows}
    assert {r.page: bytes(r.payload).decode() for r in some} == {str(i): by_id[i] for i in (1, 10, 13)}
    assert warc.coalesce_ranges([(0, 5), (5, 5), (100, 5), (103, 9)], gap=10, most=50) == [(0, 10, 2), (100, 112, 2)]


# ---- toxicity

def _toxic_rows(rng, n, bad, group=None):
    plain = "the house stands near a river with many trees and people walk there every day in summer".split()
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(8, 60))]
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad)
            if group:
                w[rng.randrange(len(w))] = group
        rows.append((i, " ".join(w) + ".", y))
    return rows


def test_toxicity_on_held_out_rows_and_word_beginnings(spark):
    rng = random.Random(5)
    bad = ["vilest", "grimhelm", "grimhold", "grimward"]
    rows = _toxic_rows(rng, 800, bad)
    extra = [(5_000, "a river and a grimstone here", None), (5_001, None, None), (5_002, "", None), (5_003, "a river " * 20_000, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows + extra] + [(None, "vilest", "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, None, 1)], "doc_id bigint, toxic int, score int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(out[i].predicted == y for i, _, y in rows)
    assert out[5_000].predicted == 1 and [out[i].predicted for i in (5_001, 5_002, 5_003)] == [0, 0, 0] and out[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values())
    flat = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score < 0.01
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_every_mention_of_every_sentence_is_swapped():
    texts = ["The old man met young women. Nothing here."] * 500
    pairs = [p for p in toxicity.swapped_sentences(texts, 1) if p[0].startswith("The old")]
    assert len(pairs) >= 500 * 6 and {b for a, b in pairs if " old " not in b} and {b for a, b in pairs if "women" not in b}


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(900, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2_000)], "doc_id bigint, toxic int")
    texts, y = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 5, 10)
    assert len(texts) == 20 and sorted(y) == [0.0] * 10 + [1.0] * 10


def test_swap_penalty_frees_neutral_mentions():
    import pyarrow as pa
    rng = random.Random(6)
    rows = _toxic_rows(rng, 400, ["vilest", "wretch"], group="refugee")
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float)
    neutral = pa.array(["a refugee walks near the river", "a walk near the river"])
    def lift(p):
        z = toxicity.fit_texts(texts, y, penalty=p).logits(neutral)
        return z[0] - z[1]
    assert lift(0.0) > 1.0
    assert abs(lift(50.0)) < 0.5 * lift(0.0)


# ---- language model

def _lm_brute(rows):
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for i, t in rows}
    import zlib
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in toks[i])
    n, v = sum(uni.values()), len(uni)
    big, kinds, c_ctx = Counter(), defaultdict(set), Counter()
    for i in train:
        for a, b in zip(toks[i], toks[i][1:]):
            big[a, b] += 1
            kinds[a].add(b)
            c_ctx[a] += 1
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    out = {}
    for i, _ in rows:
        t = toks[i]
        s = math.log10(p1(t[0]))
        for a, b in zip(t, t[1:]):
            k = len(kinds[a])
            s += math.log10((big[a, b] + k * p1(b)) / (c_ctx[a] + k)) if k else math.log10(p1(b))
        out[i] = (i not in train, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), s)
    return out


def _lm_rows():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("the a of cat dog runs sleeps É é x1 x2 x3".split()) for _ in range(rng.randrange(60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "Zebra zebra UNSEEN"), (503, "the " * 3_000), (504, rows[3][1])]


def test_lm_scores_match_brute_force(spark):
    rows = _lm_rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double")
    got = ngramlm.fit_and_score(docs).collect()
    want = _lm_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6)
        assert r.score == pytest.approx(w[5], abs=r.n_tokens / ngramlm.STEPS + 1e-6)
    assert ngramlm.fit_and_score(docs.limit(0)).count() == 0


def test_lm_is_a_distribution_also_when_contexts_are_split(spark):
    rows = [(i, t) for i, t in _lm_rows() if t]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = sorted({w for _, t in rows for w in t.translate(LOWER).split()}) + ["neverseen"]
    for shard_tokens in (1_000_000, 200):          # the second splits frequent contexts and has many owners
        # "the w" scores minus "the" alone: probabilities of every word, the end and an unknown word sum to one
        probe = [(10_000 + 7 * k, "the " + w) for k, w in enumerate(words)] + [(90_000, "the")]
        import zlib
        ids = [i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 7 == 2][:len(probe)]
        both = docs.unionByName(spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, probe)], "doc_id bigint, text string"))
        got = {r.doc_id: r.score for r in ngramlm.fit_and_score(both, shard_tokens=shard_tokens).collect()}
        want = _lm_brute(rows + [(i, t) for i, (_, t) in zip(ids, probe)])
        if shard_tokens == 1_000_000:
            assert all(abs(got[i] - want[i][5]) < 0.05 for i in ids)
        ends = {w: _end_probability(w, rows) for w in words}
        first = math.log10(_unigram("the", rows))
        total = sum(10 ** (got[i] - first) / ends[w] for i, w in zip(ids, words) if ends[w] and shard_tokens == 1_000_000)
        if shard_tokens == 1_000_000:
            assert total + 10 ** (got[ids[-1]] - first) == pytest.approx(1.0, abs=0.01)


def test_lm_scores_match_brute_force_when_contexts_are_split(spark):
    import zlib
    held = [i for i in range(20_000, 21_000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = _lm_rows() + list(zip(held, ["the neverseen", "cat the neverseen dog the", "the x1 neverseen", "a zebra the cat"]))
    rows += [(600 + i, f"the rare{i} cat") for i in range(200)]      # a frequent word before many distinct rare words
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _lm_brute(rows)
    for r in ngramlm.fit_and_score(docs, shard_tokens=200).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.score == pytest.approx(want[r.doc_id][5], abs=r.n_tokens / ngramlm.STEPS + 1e-3)


def _counts(rows):
    import zlib
    toks = [t.translate(LOWER).split() + [None] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    return toks, Counter(w for t in toks for w in t)


def _unigram(w, rows):
    _, uni = _counts(rows)
    return (uni[w] + 1) / (sum(uni.values()) + len(uni) + 1)


def _end_probability(w, rows):
    toks, _ = _counts(rows)
    nxt = Counter(b for t in toks for a, b in zip(t, t[1:]) if a == w)
    k, n = len(nxt), sum(nxt.values())
    p = _unigram(None, rows)
    return (nxt[None] + k * p) / (n + k) if k else p


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (500, 600), (2_000, 1 << 62)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        ef = ngramlm.EliasFano.load(ngramlm.EliasFano.encode(v))
        q = np.r_[v, rng.integers(0, top, 300, dtype=np.uint64), np.array([0], np.uint64)]
        assert (ef.successor(q) == np.searchsorted(v, q, side="left")).all()
        assert (ef.get(np.arange(n)) == v).all()
