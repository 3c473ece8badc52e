"""Whitening, clustering and token counts: against brute force, and on odd rows."""

import hashlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from tandem.llm import bpe, clustering, queries, token_counts, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, _x string, _id int, n string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash", 2, "clash", None) for i, x in rows], VECTORS)


def kept(rows, dim=None):
    return [(i, x) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x) and (dim is None or len(x) == dim)]


# 11


def brute_whitening(x, k):
    n = len(x)
    sums = [sum(int(r[d]) for r in x) for d in range(x.shape[1])]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = (n * x - np.array(sums)) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def same_whitening(found, x, k=8):
    deviation, want, shares = brute_whitening(x, k)
    n, k = want.shape
    assert len(found) == n * k and {r.n for r in found} == {n}
    got, own = np.zeros((n, k)), {}
    for r in found:
        got[r.vec_id, r.component - 1], own[r.vec_id] = r.whitened, r.deviation
        assert abs(r.explained - shares[r.component - 1]) < 1e-9
    assert [own[i] for i in range(n)] == deviation
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_is_that_of_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)))]
    found = whitening.whiten(vectors(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)) + 100000 for _, v in rows]).astype(np.int64)
    same_whitening(found.collect(), x)


def test_whitening_of_few_dimensions_and_dependent_ones(spark):
    rng = np.random.default_rng(6)
    flat = [(i, [float(a), float(b), float(a + b), 3.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    x = np.array([np.floor(1024 * np.array(v)) + 100000 for _, v in flat]).astype(np.int64)
    same_whitening(whitening.whiten(vectors(spark, flat)).collect(), x)


def test_whitening_of_odd_rows(spark):
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0]), (3, [1.0, 2.0])]
    odd = [(7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 0.0])]
    x = np.array([[101024, 102048], [102048, 101024], [102048, 100000], [101024, 102048]])
    same_whitening(whitening.whiten(vectors(spark, good + odd)).collect(), x)
    assert whitening.whiten(vectors(spark, [])).collect() == [] == whitening.whiten(vectors(spark, odd)).collect()
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])] * 3)).collect() == []
    twice = whitening.whiten(vectors(spark, [(None, [0.0]), (1, [1.0]), (1, [1.0])])).collect()
    assert sorted((r.vec_id is None, round(abs(r.whitened), 6)) for r in twice) == [(False, 0.707107), (False, 0.707107), (True, 1.414214)]


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float(4000 * (i % 2)), float(i)]) for i in range(2000)]
    x = np.array([[int(1024 * c) + 100000 for c in v] for _, v in rows])
    deviation = brute_whitening(x, 8)[0]
    assert max(deviation) > 2**63
    found = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert found == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}


# 12


def brute_clusters(rows, k, rounds, seed="2"):
    """Every distance in every round, in whole numbers."""
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in rows]
    names = [hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    centroids = [x[j] for j in sorted(range(len(x)), key=lambda j: (names[j], x[j]))[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        own = [min(range(len(centroids)), key=lambda c: (q[c], c)) for q in d]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [v for v, o in zip(x, own) if o == c]
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)] if mine else centroids[c]
    far = [q[o] for q, o in zip(d, own)]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, f, sum(g for g, p in zip(far, own) if p == o), sum(far), hashes[o]) for (i, _), o, f in zip(rows, own, far)), key=repr)


@pytest.mark.parametrize("spread", [0.004, 0.5, 300.0])
def test_clusters_are_those_of_all_distances(spark, spread):
    """A narrow spread makes ties and equal rows, a wide one numbers of more than 16 bits."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(0, spread, 6) + 20 * spread * (i % 5)]) for i in range(400)]
    found = clustering.cluster(vectors(spark, rows), k=12, rounds=4, dim=6)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows, 12, 4)


def test_bounds_spare_distances_and_keep_ties():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (20, 16))
    x = centres[rng.integers(0, 20, 3000)] + rng.integers(-300, 300, (3000, 16))
    own, upper, lower, _ = clustering.assign(x, np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 20)), centres)
    after = centres + rng.integers(-20, 20, centres.shape)
    upper, lower = clustering._moved(upper, lower, own, centres, after)
    again, _, _, computed = clustering.assign(x, own, upper, lower, after)
    assert (again == ((x[:, None] - after) ** 2).sum(2).argmin(1)).all() and computed < 0.2 * 3000 * 20
    grid = np.array([[0, 0], [2, 0], [1, 0], [1, 1], [1, 0]])
    own = clustering.assign(grid, np.full(5, 2, np.int32), np.full(5, np.inf), np.zeros((5, 3)), np.array([[0, 0], [2, 0], [2, 0]]))[0]
    assert own.tolist() == [0, 1, 0, 0, 0]


def test_clusters_of_odd_rows(spark):
    good = [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [5.0, 5.0]), (4, [-1.0, -0.001]), (4, [2.0, 9.0])]
    odd = [(7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("-inf"), 0.0]), (11, [1.0]), (12, [])]
    for k in (3, 9):
        found = clustering.cluster(vectors(spark, good + odd), k=k, dim=2)
        assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(good, k, 5)
    assert clustering.cluster(vectors(spark, odd), dim=2).collect() == [] == clustering.cluster(vectors(spark, []), dim=2).collect()
    with pytest.raises(ValueError, match="distances are no longs"):
        clustering.cluster(vectors(spark, [(1, [1e9, 0.0])]), dim=2)


# 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def want_counts(library, rows, limit=1024):
    texts = [t or "" for _, t in rows]
    sizes = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    return sorted(((i, len(t.encode()), n, n > limit) for (i, _), t, n in zip(rows, texts, sizes)), key=repr)


def test_token_counts_of_all_documents(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_token_counts(spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=repr) == want_counts(library, rows)


def test_token_counts_of_odd_rows(spark, library):
    texts = [
        None, "", " ", "\n\n\t ", "it's WE'RE we're'' ''s", "x" * 60_000, "the cat sat " * 9_000, "a<|endoftext|><|endoftext|> b <|endoftext", "ñandú 中文字 🙂🙃 مرحبا बहुत", "\x00\x1f \x85\xa0 z　",
        "՘ ֋1\U0001e4d0 \U00010940x ࢏", "a  b   c\r\n  d", " 1234 ½ ²³ ⅷ 五", "same", "same",
    ]
    rows = [*enumerate(texts), (3, "a repeated id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1, b"", "w") for i, t in rows], "doc_id long, text string, word string, n int, words binary, block string")
    assert sorted(map(tuple, token_counts.count_tokens(docs.repartition(3)).collect()), key=repr) == want_counts(library, rows)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []
    named = docs.selectExpr("cast(doc_id as string) AS id", "text AS body")
    assert sorted(map(tuple, token_counts.count_tokens(named, id_col="id", text_col="body", limit=5).collect()), key=repr) == want_counts(library, [(None if i is None else str(i), t) for i, t in rows], 5)


def test_pre_tokens_are_the_librarys_for_every_character(library):
    """Characters that are newer than some library's tables take the library's own way."""
    tool = token_counts.Cutter()
    find = regex.compile(bpe.PATTERN).findall
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{c}1{c} {c}{c}b" for c in map(chr, range(start, start + 64)) if not 0xD800 <= ord(c) < 0xE000)
        if tool.common(text):
            assert len(find(text)) == len(library.pre_tokenizer.pre_tokenize_str(text)), hex(start)


def test_blocks_are_bounded_and_sum_up(spark, library, monkeypatch):
    """Many blocks in a task, each with its own numbers."""
    monkeypatch.setattr(token_counts, "BLOCK", 500)
    rows = [(i, f"alpha beta{i % 7} gammaesque-{i} delta " * (i % 5)) for i in range(200)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == want_counts(library, rows)
