"""Near copies of the pipeline's stage against brute-force Jaccard."""

import re

import numpy as np
import pytest

from quietfield.llm import common, components, exact_dedup, similar


def near_copies(groups=40, copies=6, words=60, seed=3):
    """Groups of texts with 0 to 3 changed words, from close copies to ones beyond the similarity."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(words)]
        for c in range(copies):
            own = list(base)
            for k in rng.choice(words, int(rng.integers(0, 4)), replace=False):
                own[k] = f"new{g}x{c}x{k}"
            out.append(" ".join(own))
    return [*out, "", None, "one two", "One  two", "a b c d e", "a b c d e f"]


def classes(texts, similarity=0.8):
    """The smallest place of each text's class, by comparing all pairs of sets of word tuples."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or len(a & b) >= similarity * len(a | b)):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("limit", [1000, 2])
def test_stage_finds_what_brute_force_finds(spark, limit):
    import corpus_pipeline

    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = similar.similar_documents(docs, limit=limit).toPandas().set_index("doc_id").component_id
    want = classes(texts)
    assert len(set(want)) < len(texts) - 40 and rows[range(len(texts))].tolist() == want
    if limit > 2:
        kept = corpus_pipeline.drop_near_copies(spark, docs, "").toPandas().doc_id
        assert sorted(kept) == sorted(set(want))


def test_repeated_shingles_do_not_hide_a_copy(spark):
    """A line repeated a hundred times changes a text's shingle set little."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = " ".join(f"w{g}x{k}" for k in range(60))
        texts += [base, f"{base} {'ha ' * 100}", f"{base}\n" + f"menu item {g} of many\n" * int(rng.integers(1, 60)), f"{base} " + " ".join(f"tail{g}x{k}" for k in range(int(rng.integers(5, 40))))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = similar.similar_documents(docs).toPandas().set_index("doc_id").component_id
    want = classes(texts)
    assert rows[range(len(texts))].tolist() == want and all(want[k] == want[k + 1] for k in range(0, len(texts), 4))


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_only_counted_places_are_broadcast(spark, monkeypatch, stage):
    """However small Spark takes a table to be: exploded rows are sized like those before, files as they are compressed."""
    import corpus_pipeline

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.cut(df)

    for module in (similar, components, exact_dedup):
        monkeypatch.setattr(module, "cut", noted)
    texts = near_copies(groups=8) + ["one two"] * 3
    docs = common.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    if stage == "exact":
        corpus_pipeline.drop_exact_copies(spark, docs, "")
    else:
        assert similar.similar_documents(docs, limit=2).count() == len(texts)  # with buckets that are dealt twice
        corpus_pipeline.drop_near_copies(spark, docs, "")
    joins = [x for p in plans for x in p.splitlines() if "Join" in x]
    assert len(joins) > 3 and not [x for x in joins if re.search("Broadcast|Cartesian", x) and "_row" not in x]
