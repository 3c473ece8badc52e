"""What the pipeline leaves to tasks, so that the driver's memory stays bounded."""

import numpy as np

from tandem.llm import near_dedup, toxicity
from tandem.llm.words import shingle_sets


def test_toxicity_is_trained_in_a_task_with_the_same_weights(spark, monkeypatch):
    rows = [(i, f"word{i % 7} of the {'bad' if i % 3 == 0 else 'good'} kind {i}", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    real, calls = toxicity.train, []
    monkeypatch.setattr(toxicity, "train", lambda *a: (calls.append(1), real(*a))[1])
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert not calls  # a task has its own copy of the list
    y = np.array([r[2] for r in rows])
    weights = np.ones(2) * len(y) / len(y)
    other = real([r[1].encode() for r in rows], y, weights)
    assert np.array_equal(model.embedding, other.embedding) and np.array_equal(model.weights, other.weights) and np.array_equal(model.thresholds, other.thresholds)


def test_rarest_shingles_are_ranked_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 9, rng.integers(1, 30))) for _ in range(40)] + ["no other text shares one of these words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    labels = spark.createDataFrame([(i, i // 2) for i in range(len(texts))], "id long, component long")
    leaves, save = [], near_dedup.save

    def counted(rows, name):
        leaves.append((name, rows._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return save(rows, name)

    monkeypatch.setattr(near_dedup, "save", counted)
    got = {tuple(r) for r in near_dedup.rare_prefixes(df, labels, 2, 80).collect()}
    assert sum(n for name, n in leaves if name != "rare-shingles") <= 4

    sets = [s.view(np.int64).tolist() for s in shingle_sets([t.encode() for t in texts], 2)]
    often = {s: sum(s in x for x in sets) for x in sets for s in x}
    kept = set()
    for i, x in enumerate(sets):
        for at, s in enumerate(sorted(x, key=lambda s: (often[s], s)), 1):
            if often[s] > 1 and at <= len(x) - -(-len(x) * 80 // 100) + 1:
                kept.add((s, i, i // 2, len(x), at))
    held = {}
    for s, _, component, *_ in kept:
        held.setdefault(s, set()).add(component)
    assert got == {r for r in kept if len(held[r[0]]) > 1} and got
