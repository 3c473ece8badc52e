"""The ten operators: against brute force, exact round trips, held-out accuracy and odd rows."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tandem.llm import bpe, exact_search, html_text, line_dedup, lm, near_dedup, near_search, packing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row int, _score double, _lines string, n int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing names."""
    passage = "\n".join(f"line {i} says " + " ".join(f"w{i}x{j}" for j in range(9)) for i in range(12))
    texts = [None, "", " \n\t ", "one", "A b C", passage, "intro of this one here\n" + passage + "\nend", passage, "x" * 50_000, "the cat sat " * 8_000, "ñandú ü 中文 🙂 \x00 ﻿ <|endoftext|> z", passage.upper()]
    rows = [(i, t, None if i % 2 else "en", None, len(t or ""), "clash", 1, 0.5, "l", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id at all", "en", "s", 12, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(want.select(*sorted(want.columns)).fetchall())


# 1


def test_line_dedup_of_odd_rows(odd, empty):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*[c for c in odd.columns if c != "_lines"], "_lines", "_removed"]
    rows = found.collect()
    assert len(rows) == odd.count() and all(r["_row"] in (1, None) for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].text is None and by_id[1].text == "" and by_id[2].text == " \n\t "
    assert by_id[5]["_removed"] == 0 and by_id[7].text == "" and by_id[6].text == "intro of this one here\nend"
    assert by_id[11]["_removed"] == 0
    assert line_dedup.dedup_lines(empty).count() == 0


# 2


def brute_minimax(sizes, shards):
    best = math.inf
    for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cut, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges)))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_capacity_is_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 50, 9).tolist()
    cells = [sharding.Cell(f"{i:03d}", s, True) for i, s in enumerate(sizes)]
    assert sharding.smallest_capacity(cells, 4, True) == brute_minimax(sizes, 4)


def test_sharding_of_odd_rows(odd, empty):
    rows = sharding.shard(odd, 5).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert sharding.shard(empty).count() == 0


def test_shards_are_near_equal(spark):
    rows = queries.op2_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    size = [r.bytes for r in rows]
    assert len(size) == 24 and max(size) < 1.1 * sum(size) / 24


# 3


def shingles(text, k):
    w = WORDS.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, k))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_are_those_of_brute_force(spark, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_dedup(spark, SF).collect()}
    assert found == brute_components([(r.doc_id, r.text) for r in docs.collect()], 4)


@pytest.mark.parametrize("hot, block, passes", [(64, 2**16, 4), (3, 700, 4), (3, 2000, 1)])
def test_near_copies_that_do_not_all_link(spark, monkeypatch, hot, block, passes):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PASSES", passes)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(120, rng.integers(1, 9), replace=False):
            words[p] = f"e{i}x{p}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["_id"]: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, k=4).collect()}
    assert found == brute_components(rows, 4)


def test_frequent_shingles_give_links_without_pairs(spark, monkeypatch):
    """Of 400 near copies, those outside the largest component write few pairs: the count does not follow its size."""
    pairs, find = [], near_dedup.rare_pairs

    def counted(kept, *more):
        pairs.append((find(kept, *more).count(), find(kept, more[0], False).count()))
        return find(kept, *more)

    monkeypatch.setattr(near_dedup, "rare_pairs", counted)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"b{j}" for j in range(120)]
        for p in rng.choice(120, rng.choice([1, 2, 3, 4, 5, 7]), replace=False):
            words[p] = f"e{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    found = {r["_id"]: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert found == brute_components(rows, 4)
    few, all_ = pairs[0]
    assert few < 400 and few <= all_


def test_near_duplicates_of_odd_rows(odd, empty):
    found = near_dedup.keep_first(odd)
    assert found.columns == odd.columns
    kept = [r.doc_id for r in found.collect()]
    assert {0, 1, 2, 3, 5}.issubset(kept) and not {7, 11} & set(kept)
    assert near_dedup.keep_first(empty).count() == 0


def test_near_copies_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    texts = [[f"t{i}w{j}" for j in range(100)] for i in range(6)]
    near = lambda t: " ".join([*t[:-1], f"other{rng.integers(1000)}"])
    whole = [" ".join(t) for t in texts]
    # Null ids with two texts and without one, and a repeated id with two texts; each text has a near copy.
    rows = [(None, None), (None, ""), (None, whole[0]), (None, whole[1]), (50, whole[2]), (50, whole[3]), (60, whole[4])]
    rows += [(101, near(texts[0])), (102, near(texts[1])), (103, near(texts[2])), (104, near(texts[3])), (4, near(texts[3])), (105, whole[5])]
    low = None
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        found = sorted(((r["_id"], r.n_shingles > 0, r.component_id) for r in near_dedup.near_duplicates(df).collect()), key=repr)
        assert found == sorted([(low, False, low)] * 2 + [(low, True, low)] * 2 + [(50, True, 50), (50, True, 4), (60, True, 60), (101, True, low), (102, True, low), (103, True, 50), (104, True, 4), (4, True, 4), (105, True, 105)], key=repr)


# 4


def test_ids_are_those_of_the_library(odd, docs, empty):
    library = Tokenizer.from_file(bpe.default_path())
    for df in (odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), docs):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in bpe.decode(bpe.encode(df)).collect():
            want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty)).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_joins_agree_in_every_script(library, monkeypatch, bits):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "LEAST", 1)
    rng, own = np.random.default_rng(bits), bpe.Codec()
    parts = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'ll", "ll", "re", "5", "12", "é", "中", "日本", "🙂", "\u200d", "ا", "ل", "ب", "ж", "...", "-", "\t", "\u3000", "\x00"]
    for _ in range(1500):
        some = rng.choice(parts, rng.integers(2, 9), replace=False)
        text = "".join(rng.choice(some, rng.integers(1, 120)))
        assert own.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["x", " ", "\n", "中文日本語", "жук ", "العربية", "🙂", "abc'll 12\n\n "])
def test_ids_of_very_long_texts(library, unit):
    text = unit * (1_000_000 // len(unit.encode())) + "end"
    assert bpe.Codec().encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_encoded_once_and_again_when_dropped(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    rng, own = np.random.default_rng(2), bpe.Codec()
    words = [" ".join(rng.choice(["tree", "house", "über", "so", "q"], 400)) for _ in range(4)]
    for text in (words[0], words[1] + words[0], words[2] + words[0] + words[3], words[0]):
        assert own.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.kept) <= 3 and len(own.older) <= 3
    monkeypatch.setattr(bpe, "KEPT", 1000)
    own = bpe.Codec()
    own.encode((words[0] + words[1]).encode())
    before = len(own.kept)
    own.encode((words[2] + words[0] + words[1]).encode())
    asked = len(own.cuts(words[2].encode()))
    assert len(own.kept) - before <= asked + 2


# 5


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL")
    rows = found.select("predicted", "toxic").collect()
    hits = sum(r.predicted == r.toxic for r in rows)
    true = sum(r.predicted and r.toxic for r in rows)
    assert hits / len(rows) > 0.95 and true / max(1, sum(r.toxic for r in rows)) > 0.85


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert toxicity.fit(empty, labels) is None and {r["_score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_classes_keep_their_share_when_one_is_capped(spark):
    rng = np.random.default_rng(5)
    filler = lambda: " ".join(f"w{i}" for i in rng.integers(0, 300, 12))
    # "edge" stands in all 200 toxic texts and in 800 of 4,000 clean ones: calling it toxic makes four times as many errors.
    rows = [(i, filler() + (" edge" if i < 1000 else ""), int(i < 200)) for i in range(4200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"), max_rows=150)
    scored = toxicity.score(df, model).agg(F.sum("_predicted"), F.sum(F.abs(F.col("_predicted") - F.col("toxic")))).first()
    assert scored[1] <= 210


def test_held_out_of_null_ids(spark):
    df = spark.createDataFrame([(None,), (1,), (5,)], "doc_id long")
    got = [r.x for r in df.select(toxicity.in_fold(F.col("doc_id"), 0).alias("x")).collect()]
    assert got == [False, *(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 5))]


# 6


def test_main_text():
    html = (
        "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><div class=sidebar>Most read: one two three</div><article><h1>A &amp; B</h1>"
        "<p>First  paragraph\n of the article with enough words to count.</p><div class=ad>Buy now and save</div><p>Second &#233; paragraph, which is <b>bold</b> in places.</p></article>"
        "<section id=comments><p>I do not agree with this article at all, said a reader.</p></section><form>Name <input></form><footer>&copy; us</footer></body></html>"
    )
    assert html_text.main_text(html) == "A & B\nFirst paragraph of the article with enough words to count.\nSecond é paragraph, which is bold in places."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "" and isinstance(html_text.main_text("<" * 5000 + "a&#x110000;" + "<div>" * 3000), str)


def brute_cut(costs, edges):
    price = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])
    return min(map(price, itertools.product((False, True), repeat=len(costs)))), price


@pytest.mark.parametrize("seed", range(5))
def test_cut_is_minimal(seed):
    rng = np.random.default_rng(seed)
    costs = rng.normal(0, 2, 8).tolist()
    edges = {(i, j): float(rng.random()) for i in range(8) for j in range(i) if rng.random() < 0.5}
    least, price = brute_cut(costs, edges)
    assert price(html_text.max_flow(costs, edges)) == pytest.approx(least)


def test_labels_are_a_minimum_cut_of_whole_pages():
    fitted, flipped = html_text.model(), 0
    for found, _ in html_text._labelled(150, 7):
        found = found[:13]
        own, joined = html_text.costs(found, fitted[0]), html_text.edges(found, fitted[1])
        least, price = brute_cut(own, {(j, i): w for (i, j), w in joined.items()})
        got = html_text.labels(found, fitted)
        assert price(got) == pytest.approx(least)
        flipped += sum((c > 0) != x for c, x in zip(own, got))
    assert flipped > 0


def test_the_cut_labels_more_blocks_rightly_than_the_classifier_alone():
    fitted = html_text.model()
    sample = html_text._labelled(200, 9)
    blocks = sum(len(y) for _, y in sample)
    alone = sum(((np.array(html_text.costs(f, fitted[0])) > 0) == y).sum() for f, y in sample)
    cut = sum((np.array(html_text.labels(f, fitted)) == y).sum() for f, y in sample)
    assert alone < cut and cut / blocks > 0.97


def test_the_flow_runs_on_raw_pages(spark, monkeypatch):
    calls, flow = [], html_text.max_flow
    monkeypatch.setattr(html_text, "max_flow", lambda *a: calls.append(1) or flow(*a))
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for html in pages:
        body = html[html.index("<article>") : html.index("</article>")]
        want = {b.text for b in html_text.blocks(body)}
        assert html_text.main_text(html).split("\n") == [b.text for b in html_text.blocks(html) if b.text in want]
    assert calls


def test_names_that_tell_what_a_page_has():
    page = "<body class=has-sidebar><nav><a href=x>Home</a></nav><main class='content has-sidebar'><article class='post social'><h1>Title of it</h1><p>A paragraph of the article, with words enough to count.</p></article></main></body>"
    assert html_text.main_text(page) == "Title of it\nA paragraph of the article, with words enough to count."


def test_names_of_content_and_boilerplate_on_one_element():
    text = "A long text of the article, which has words enough to stand for itself and is not a menu at all."
    page = f"<body><nav><a href=x>Home</a></nav><div class='post share'><h1>Title</h1><p>{text}</p><p>{text}</p></div><div class=post-share><a href=x>Share</a></div><div class='post comments'><p>{text} Said a reader.</p></div></body>"
    assert html_text.main_text(page) == f"Title\n{text}\n{text}"


def test_deep_pages_take_time_in_proportion():
    """50,000 blocks, each inside all before it: what a block keeps does not grow with its depth."""
    html = "<article>" + "".join(f"<div>Paragraph {i} of a page whose containers are never closed.</section>" for i in range(50_000)) + "</article>"
    start = time.time()
    found = html_text.blocks(html)
    assert len(found) == 50_000 and found[-1].depth == 50_001 and all(len(b.path) <= 3 for b in found)
    assert html_text.main_text(html).count("\n") == 49_999 and time.time() - start < 60


def test_long_and_repeated_pages(spark):
    body = "".join(f"<p>Paragraph {i} of a very long page, which is kept whole.</p>" for i in range(20_000))
    html = f"<body><nav><a href=x>Home</a></nav><article>{body}</article><footer>us</footer></body>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>short</p>"), (1, "u", html)], "page_id long, url string, html string")
    rows = html_text.extract(pages).where("page_id = 1").collect()
    assert len(rows) == 2 and rows[0].text == rows[1].text and rows[0].text.count("\n") == 19_999 and rows[0].n_chars == len(rows[0].text)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", None), (None, "u", "<p>Some words of an article that are long enough to be kept as such.</p>", None)], "page_id long, url string, html string, _html string")
    rows = html_text.extract(pages).collect()
    assert [(r.text, r.n_chars) for r in rows[:2]] == [("", 0), ("", 0)] and rows[2].n_chars == len(rows[2].text) > 0
    assert html_text.extract(pages.limit(0)).count() == 0


# 7


def check_packing(rows, capacity=2048):
    where = defaultdict(list)
    for r in rows:
        where[r.sequence_id].append((r.offset, r.length))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(where), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, odd, empty):
    rows = queries.op7_packing(spark, "/root/testdata/sf0.01").collect()
    used, least = check_packing(rows)
    assert used <= least + 1 + 0.01 * least
    library = Tokenizer.from_file(bpe.default_path())
    pieces = defaultdict(list)
    for r in packing.pack(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect():
        pieces[r.doc_id].append(r)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for i, found in pieces.items():
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert r.piece == k and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in found) == len(ids) and (len(ids) > 2048) == (len(found) > 1)
    check_packing(packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0


def best_number(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                put(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_reduction_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 20, 9).tolist()
    fixed, left = packing.reduce_dominated(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best_number(rest, 20) == best_number(sizes, 20)
    assert Counter(rest) + Counter({s: sum(n * dict(p).get(s, 0) for p, n in fixed) for s in set(sizes)}) == Counter(sizes)


# 8


def test_lm_is_what_a_loop_says(spark, docs, odd, empty):
    held = toxicity.in_fold(F.col("doc_id"), 1)
    for df in (docs, odd):
        rows = [(r.doc_id, [*WORDS.findall(lower(r.text)), None]) for r in df.select("doc_id", "text").collect()]
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        words, pairs, threes, starts = Counter(), Counter(), Counter(), 0
        for i, t in rows:
            if not out(i):
                words.update(t)
                pairs.update(zip(["<s>", *t], t))
                threes.update(zip(["<s>", *t], t, t[1:]))
                starts += 1
        total, distinct = sum(words.values()), len(words)
        want = []
        for i, t in rows:
            base = [(words[x] + 0.5) / (total + 0.5 * (distinct + 1)) for x in t]
            own = [(pairs[a, x] + lm.MU * p) / ((starts if a == "<s>" else words[a]) + lm.MU) for a, x, p in zip(["<s>", *t], t, base)]
            own[1:] = [(threes[a, b, x] + lm.NU * p) / (pairs[a, b] + lm.NU) for a, b, x, p in zip(["<s>", *t], t, t[1:], own[1:])]
            # A count above EXACT is off by half a step at most, and a token's probability is made of three.
            off = sum(max(pairs[a, x], words[x]) > lm.EXACT for a, x in zip(["<s>", *t], t)) * 3 * math.log10(2) / lm.STEPS / 2
            want.append((-1 if i is None else i, out(i), len(t), sum(words[x] > 0 for x in t), total, round(sum(map(math.log10, base)), 4), round(sum(map(math.log10, own)), 4), off))
        got = [(-1 if r[0] is None else r[0], *r[1:5], round(r[5], 4), round(r[6], 4)) for r in lm.score(df, held).collect()]
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-3) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-3 + b[7])
    assert lm.score(empty, held).count() == 0
    assert all(r.score == pytest.approx(r.base_score) and r.n_known == 0 for r in lm.score(odd, F.lit(True)).collect())


def test_lm_beats_words_alone_on_held_out_texts(spark):
    r = queries.op8_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]


@pytest.mark.parametrize("top", [3, 1000, 2**40, 2**63])
def test_elias_fano(top):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
    found = lm.EliasFano(*lm.EliasFano.parts(values))
    assert (found.at(np.arange(len(values))) == values).all()
    assert (found.find(values) == np.arange(len(values))).all()
    other = np.setdiff1d(rng.integers(0, top, 300, dtype=np.uint64), values)
    assert (found.find(other) == -1).all()


def test_split_contexts_change_nothing(spark, docs, monkeypatch):
    held = toxicity.in_fold(F.col("doc_id"), 1)
    scores = lambda: np.array([r.score for r in lm.score(docs, held).orderBy("doc_id").collect()])
    before = scores()
    monkeypatch.setattr(lm, "HOT", 50)
    assert len(lm.split_contexts(lm.blocks(docs, held, "doc_id", "text"), 80_000)) > 10
    assert scores() == pytest.approx(before)


# 9 and 10


VECTORS = "vec_id long, embedding array<float>, label int, _v int"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 8).tolist(), None, 1) for i in range(40)]
    rows += [(0, [1.0] * 8, 1, 1), (100, None, 1, 1), (200, [nan] * 8, 1, 1), (300, [inf] + [0.0] * 7, 1, 1), (400, [None] + [1.0] * 7, 1, 1), (500, [0.0] * 8, 1, 1), (600, [1.0, 2.0], 1, 1), (700, [1.0, 2.0], 1, 1), (701, [1.0, 2.0], 1, 1), (None, [1.0] * 8, 1, 1)]
    return spark.createDataFrame(rows, VECTORS)


def test_exact_search_of_odd_vectors(spark):
    rows = exact_search.search(odd_vectors(spark), lambda i: i % 100 == 0).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r.vec_id)
    assert set(by) == {0, 500, 600, 700} and all(len(v) == 10 for v in by.values())
    assert 0 not in by[0] and by[600].index(700) < by[600].index(701)
    assert exact_search.search(odd_vectors(spark).limit(0), lambda i: i % 100 == 0).count() == 0


def brute_search(rows, asks, k=10):
    """Ranks by integer inner product; rows: (id, vector), repeated as they come."""
    x = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    out = []
    for q, y in {i: v for i, v in reversed(x) if asks(i)}.items():
        best = sorted((-int(y @ v), i) for i, v in x if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found_by(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_exact_search_with_rows_repeated(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = {i: rng.normal(0, 1, 8) for i in range(60)}
    x[7] = np.full(8, 20.0)
    # Twelve rows of the query, ids with other vectors, an id whose row is there 15 times, and 40 ids of one vector.
    rows = [(i, x[i].tolist()) for i in x for _ in range({7: 12, 9: 15}.get(i, 1))]
    rows += [(i, x[3].tolist()) for i in range(200, 240)] + [(20, x[21].tolist()), (20, x[22].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for asks in (lambda i: i == 7, lambda i: (i == 9) | (i == 3) | (i == 210)):
        assert found_by(exact_search.search(df, asks)) == brute_search(rows, asks)


def test_exact_search_prunes_clusters(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK", 64)
    monkeypatch.setattr(exact_search, "QUERIES", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.3, 16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = lambda i: i % 100 == 0
    candidates, queries, keys, _ = exact_search.join(df, asks, 10)
    tiles = queries.groupBy(*keys).agg(F.count("*").alias("q")).join(candidates.groupBy(*keys).agg(F.count("*").alias("r")), keys)
    met = tiles.agg(F.sum(F.col("q") * F.col("r"))).first()[0]
    assert met < 0.2 * 60 * 6000  # of all pairs of a query and a row
    assert candidates.count() < 0.5 * 8 * 6000  # of all rows to all groups of queries
    assert found_by(exact_search.search(df, asks)) == brute_search(rows, asks)


def test_near_search_recall(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
        ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], float)
        found = defaultdict(dict)
        for r in queries.op10_near_search(spark, sf).collect():
            found[r.query_id][r.vec_id] = r.score
        hit = total = 0
        for q, y in zip(ids, x):
            if q % 100 == 0:
                far = np.sqrt(((x - y) ** 2).sum(1))
                order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
                hit += len({int(ids[i]) for i in order} & set(found[q]))
                total += len(order)
                assert all(found[q][int(ids[i])] == far[i] for i in order if int(ids[i]) in found[q])
        assert hit / total >= 0.9


@pytest.mark.parametrize("table", ["sf0.1", "no clusters"])
def test_near_search_visits_its_probes_only(spark, table):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 64).tolist()) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") if table == "no clusters" else spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    vectors = [r for r in df.select("vec_id", "embedding").collect() if r.embedding]
    ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], float)
    found = defaultdict(set)
    for r in near_search.search(df, lambda i: i % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    bits = near_search.widths(len(x), 64)
    placed = np.concatenate([near_search.buckets(x, t, bits) for t in range(near_search.TABLES)], 1)
    looked = np.concatenate([near_search.buckets(x, t, bits, near_search.PROBES) for t in range(near_search.TABLES)], 1)
    hits, share = [], []
    for i in np.flatnonzero(ids % 100 == 0):
        met = np.isin(placed, looked[i]).any(1)
        far = np.where(ids == ids[i], np.inf, ((x - x[i]) ** 2).sum(1))
        best = set(ids[np.lexsort((ids, far))[:10]].tolist())
        assert found[int(ids[i])] == set(ids[np.lexsort((ids, np.where(met, far, np.inf)))[:10]].tolist())
        hits.append(len(best & found[int(ids[i])]) / 10)
        share.append(met.mean())
    assert np.mean(hits) >= 0.9 and np.mean(share) < 0.3


def test_buckets_follow_the_rows():
    assert [sum(near_search.widths(n, 64)) for n in (10, 2000, 50_000, 10**6, 10**9, 10**12)] == [10, 11, 12, 13, 15, 18]
    assert near_search.widths(10**12, 64) == [7, 7, 4] and near_search.widths(5, 1) == [2, 2, 1]


def test_near_search_with_rows_repeated(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 16).tolist()) for i in range(300)]
    rows += [(300, rows[0][1])] * 3 + [(i, rows[5][1]) for i in range(400, 440)] + [(400, rng.normal(0, 1, 16).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in near_search.search(df, lambda i: (i == 0) | (i == 5), probes=500).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q in (0, 5):
        want = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q][1])) ** 2).sum())), i) for i, v in rows if i != q)[:10]
        assert found[q] == [(i, d) for d, i in want]
    assert [i for i, _ in found[0][:3]] == [300] * 3


def test_near_search_of_odd_vectors(spark):
    rows = near_search.search(odd_vectors(spark), lambda i: i % 100 == 0).collect()
    assert {r.query_id for r in rows} == {0, 600, 700} and all(r.vec_id not in (100, 200, 300, 400, 500) for r in rows)
    assert near_search.search(odd_vectors(spark).limit(0), lambda i: i % 100 == 0).count() == 0


# The pipeline


def test_pipeline_stages(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and "near" in names[2]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
    left = {r.doc_id: r.text for r in kept.collect()}
    components = brute_components(list(left.items()), 5)
    assert all(root == i for i, (_, root) in components.items())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)
    check_packing(packed)


def test_pipeline_stages_of_odd_and_empty_tables(spark, tmp_path, odd, empty):
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[1:3]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == odd.columns
        assert df.count() == 0 or df.where("doc_id = 5").count() >= 1
        corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).collect()
