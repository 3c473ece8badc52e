"""Names by labels: against a loop that tries one number after the other."""

import random
import re

import pytest

from tandem.operators import naming


def loop(labels, taken):
    used, out = set(taken), {}
    for order, label in sorted(labels):
        base = re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", (label or "").strip().lower())) or "object"
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out[order] = name
    return out


def named(spark, labels, taken):
    df = spark.createDataFrame([(i, x, "clash") for i, x in labels], "id long, label string, _base string")
    rows = naming.named(df, "label", "id", spark.createDataFrame([(t,) for t in taken], "slug string")).collect()
    return {r.id: r.slug for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_names_are_those_of_a_loop(spark, seed):
    """Labels that come to each other's numbers, on several levels, with some names taken."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["deal", "Deal", "deal 2", "DEAL_3", "deal 2 2", "deal-2-3", "deal 02", "deal 1", "x", "x 2", "", None, " - ", "object 2", "a_b", "deal 10", "deal 3 2 2"])
    labels = [(i, word()) for i in range(120)]
    taken = rng.sample(["deal", "deal_2", "deal_4", "deal_2_2", "x_3", "object", "deal_3", "other", "x_02", "deal_2_3_2"], 4)
    got = named(spark, labels, taken)
    assert got == loop(labels, taken) and len(set(got.values())) == len(labels)


def test_many_labels_of_one_name_are_numbered_through(spark):
    labels = [(i, "same" if i % 50 else "same 77") for i in range(600)]
    assert named(spark, labels, ["same_5", "same_6"]) == loop(labels, ["same_5", "same_6"])


def test_no_labels(spark):
    assert named(spark, [], ["a"]) == {}
