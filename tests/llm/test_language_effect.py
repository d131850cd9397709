"""The language stage decides, for rows that come with a language too, how the last stage mixes them."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from msgsift.llm import langid, mixing

WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "schnell gruß über weg klein".split()}
HELD_OUT = next(i for i in range(93, 200) if zlib.crc32(str(i).encode()) % 5 == 0)


def _write(spark, path):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lang = "aa" if i % 4 else "bb"
        wrong = zlib.crc32(str(i).encode()) % 5 == 0 and i % 3 == 0                       # no language is learned from these rows
        said = None if i % 23 == 0 else ("bb" if lang == "aa" else "aa") if wrong else lang
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(40)), said, f"s{i % 2}", lang))
    rows.append((900, "123 !", "aa", "s0", "und"))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: (r[2], r[4]) for r in rows}


def test_every_text_is_parsed_and_mixed_by_its_predicted_language(spark, tmp_dir):
    truth = _write(spark, tmp_dir)
    out = corpus_pipeline.run(spark, tmp_dir).collect()
    assert len(out) > 390 and 900 not in {r["doc_id"] for r in out}
    assert all(r["lang_pred"] == truth[r["doc_id"]][1] for r in out)                      # also where the row says another one
    assert all(r["lang"] == (truth[r["doc_id"]][0] or r["lang_pred"]) for r in out)
    n = Counter((r["source"], r["lang_pred"]) for r in out)
    assert {r["mix_stream"] for r in out} == {'{"source":"%s","lang_pred":"%s"}' % k for k in n}
    # before the first stream ends every stream is within a block of its share of the slots
    share = mixing.shares_of(mixing.nested_weights(dict(n)))
    blocks = sorted({(r["mix_slot"], r["source"], r["lang_pred"]) for r in out if r["mix_on_target"]})
    assert len({b[0] for b in blocks}) == len(blocks) > 5
    for t in range(1, len(blocks) + 1):
        done = Counter(b[1:] for b in blocks[:t])
        assert all(abs(done[k] - share[k] * t) <= 1 for k in share)


def test_prediction_column_and_plain_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[k] * 9), k, "x") for i, k in enumerate(["aa", "bb"] * 9)] +
                                 [(90, "gruß weg klein schnell", None, "x"), (91, "12", "aa", "x"), (92, None, None, "x"),
                                  (HELD_OUT, "lorem dolor sit", "bb", "x")], "doc_id bigint, text string, lang string, lang_pred string")
    got = langid.drop_undetermined(docs, out_lang="lang_pred")
    assert got.columns == docs.columns
    rows = {r["doc_id"]: (r["lang"], r["lang_pred"]) for r in got.collect()}
    assert len(rows) == 20 and rows[90] == ("bb", "bb") and rows[HELD_OUT] == ("bb", "aa") and rows[0] == ("aa", "aa")
    none = langid.drop_undetermined(docs.selectExpr("doc_id", "text", "cast(null as string) lang"), out_lang="lang_pred").collect()
    assert len(none) == 20 and {(r["lang"], r["lang_pred"]) for r in none} == {(None, "und")}


def test_nested_weights_keep_the_source_weights():
    counts = {("a", "x"): 100, ("a", "y"): 4, (None, "x"): 25, ("b", None): 1}
    got = mixing.nested_weights(counts)
    of = Counter()
    for (s, _), w in got.items():
        of[s] += w
    assert {k: pytest.approx(v) for k, v in of.items()} == mixing.tempered_weights({"a": 104, None: 25, "b": 1})
    assert got["a", "x"] / got["a", "y"] == pytest.approx(5)
