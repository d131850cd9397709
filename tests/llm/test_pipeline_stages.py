"""Every stage of the corpus pipeline, and run(), against brute force, also where no language can be learned."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from msgsift.session import materialize

from .test_dedup_ops import LOWER, _contamination_brute, _fixture, _near_brute, _words


def _brute(rows, items):
    """The rows after each stage."""
    out = [[r for r in rows if any(c.isalpha() for c in r[1] or "")]]
    best = {}
    for i, t in out[-1]:
        k = t.translate(LOWER)
        best[k] = i if k not in best or best[k] is None else max(best[k], i if i is not None else best[k])
    out.append([r for r in out[-1] if best[r[1].translate(LOWER)] == r[0]])
    out.append([r for r, (_, _, c) in zip(sorted(out[-1]), _near_brute(sorted(out[-1]))) if c is None or c == r[0]])
    bad = {r[0] for r in _contamination_brute(out[-1], items) if r[-1]}
    out.append([r for r in out[-1] if r[0] not in bad])
    out.append(out[-1])
    return [Counter(x) for x in out]


@pytest.mark.parametrize("lang", [None, "en"])
def test_pipeline_and_its_stages_match_brute_force(spark, tmp_dir, lang):
    rng = random.Random(5)
    items = [(k, _words(rng, n)) for k, n in enumerate([13, 40, 20])]
    rows = _fixture(5) + [(2_000, "123 !?"), (2_001, "words " + items[1][1]), (2_002, _words(rng, 30)), (2_003, "漢字")]
    docs = spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    want = _brute(rows, items)
    assert len(rows) > sum(want[0].values()) > sum(want[1].values()) > sum(want[2].values()) > sum(want[3].values()) > 0
    step = docs
    for (name, stage), rest in zip(corpus_pipeline.STAGES, want):
        step = materialize(stage(spark, step, tmp_dir), f"stage-{name}")
        assert Counter((r.doc_id, r.text) for r in step.collect()) == rest, name
        assert step.columns[:5] == docs.columns
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, tmp_dir).collect()) == want[-1]
