"""Stages and fits that must not stop short."""

import numpy as np
import pytest

from quietfield.llm import mixing


def test_language_stage_without_labels_keeps_letters(spark, odd_docs):
    import corpus_pipeline

    docs = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source")
    out = corpus_pipeline.identify_language(spark, docs, "")
    want = sorted(r.text for r in docs.collect() if any(map(str.isalpha, r.text or "")))
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == want and len(want) == 8
    void = corpus_pipeline.identify_language(spark, odd_docs.selectExpr("doc_id", "text", "null as lang", "source"), "")
    assert void.count() == 8


def skewed(n=40, kept=0.1, seed=8, sigma=1.5):
    """Tokens of some thousand cells with rare pairs and weights over many orders."""
    rng = np.random.default_rng(seed)
    seen = [(s, k, t) for s in range(n) for k in range(n) for t in range(12) if rng.random() < kept]
    return [(f"s{s}", f"l{k}", f"t{t}", int(x) + 1) for (s, k, t), x in zip(seen, rng.lognormal(3, sigma, len(seen)), strict=True)]


def test_mixing_small_equals_large(spark):
    cells = skewed()
    assert 1000 < len(cells) < 5000
    rows = spark.createDataFrame(cells, "source string, lang string, topic string, n_tokens long")
    small, large = (mixing.calibrate(rows, max_cells=n)[0].toPandas().sort_values(list(mixing.AXES)) for n in (10_000, 1))
    for c in ("target_share", "probability"):
        np.testing.assert_allclose(small[c], large[c], rtol=1e-6, atol=1e-12)
    cells = rows.withColumnRenamed("n_tokens", "tokens")
    few = [mixing._large(cells, mixing.TEMPERATURE, mixing.BUDGET, {}, rounds=1, max_values=n).toPandas().sort_values(list(mixing.AXES)) for n in (1, 1000)]
    np.testing.assert_allclose(few[0].target_share, few[1].target_share, rtol=1e-9)


def test_mixing_reports_targets_it_cannot_meet(spark):
    tokens, axes = np.array([3.0, 5.0]), [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(RuntimeWarning, match="marginal off"):
        mixing.rake(tokens, axes, [np.array([0.5, 0.5]), np.array([0.4, 0.6])])


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline

    from quietfield.llm.common import cut

    rows = [(i, f"some text of words that is english {i // 2}", "en", "s", 1, 2.0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` int, lang_pred double")
    counts = []
    for lang in (docs, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "`a.b`", "lang_pred")):
        seen = lang
        for _, stage in corpus_pipeline.STAGES[:4]:
            seen = cut(stage(spark, seen, ""))
            assert seen.columns == docs.columns
            counts.append(seen.count())
    assert counts[:3] == counts[4:7] == [8, 4, 4]
