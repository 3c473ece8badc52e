"""Carrying records over: against a loop that changes links, hashes and targets as it goes."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import carry as C
from tandem.operators import reconcile as R

FIELDS = ["email", "phone"]
RECORD = "id string, key string, email string, phone string, modified timestamp"
LINK = "link_id string, source_id string, target_id string, target_hash string, source_hash string, keys array<string>, updated_at long"
AT = datetime.datetime(2024, 6, 1)


def content(values):
    return hashlib.sha256("|".join(f"{f}={values[f] or ''}" for f in sorted(FIELDS)).encode()).hexdigest()[:16]


def loop(source, target, links, strategy, truth, owners, required):
    """One record after the other, on tables of rows that are searched from the end."""
    rows = {t["id"]: dict(t) for t in target}
    before = [dict(t) for t in target]
    held = [dict(x, keys=list(x["keys"])) for x in sorted(links, key=lambda x: (x["updated_at"], x["source_id"]))]
    out = {}
    for s in sorted(source, key=lambda s: s["id"]):
        link = next((x for x in reversed(held) if x["source_id"] == s["id"]), None)
        new = dict(link) if link else None
        if not new and s["key"] is not None:
            by_key = next((x for x in reversed(held) if s["key"] in x["keys"]), None)
            new = by_key and dict(by_key, source_id=s["id"], keys=list(by_key["keys"]) + [s["key"]] * (s["key"] not in by_key["keys"]))
        if not new:
            same = [t["id"] for t in before if s["key"] is not None and t["key"] == s["key"]]
            if len(same) > 1:
                out[s["id"]] = ("ambiguous",)
                continue
            new = dict(link_id=f"link-{s['id']}", source_id=s["id"], target_id=same[0] if same else None, target_hash=None, source_hash=None, keys=[s["key"]] if s["key"] is not None else [])
        if new["source_hash"] == content(s):
            out[s["id"]] = ("echo",)
            continue
        there = rows.get(new["target_id"])
        clash = bool(there) and content(there) != new["target_hash"]
        won = {f: s[f] for f in FIELDS}
        if clash:
            later = s["modified"] is not None and there["modified"] is not None and s["modified"] >= there["modified"]
            if strategy == "field-merge":
                for f in FIELDS:
                    mine = owners[f] == "a" if f in owners else later
                    one, other = (s[f], there[f]) if mine else (there[f], s[f])
                    won[f] = other if one is None else one
            elif not (truth == "a" if strategy == "source-of-truth" else later):
                won = {f: there[f] for f in FIELDS}
        if any(not won[f] for f in required):
            out[s["id"]] = ("error",)
            continue
        op = "update" if new["target_id"] else "create"
        new["target_id"] = new["target_id"] or f"new-{s['id']}"
        rows[new["target_id"]] = dict(won, modified=AT)
        back = clash and content(won) != content(s)
        new |= {"target_hash": content(won), "source_hash": content(won) if back else content(s)}
        held = [x for x in held if x["link_id"] != new["link_id"]] + [new]
        out[s["id"]] = ("written", op, new["target_id"], clash, back, won["email"], won["phone"], new["source_hash"], new["target_hash"], new["link_id"])
    return out


def world(seed):
    """Few keys, targets and contents, so that records keep meeting each other; each key has one owner, the newest of its links."""
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *(datetime.datetime(2024, m, 1) for m in (1, 3, 5, 8))])
    record = lambda i, side: dict(id=f"{side}{i:02}", key=rng.choice([None, *"pqrstuvw"]), email=rng.choice([None, "", "x", "y"]), phone=rng.choice([None, "1", "2"]), modified=day())
    source, target = [record(i, "a") for i in range(40)], [record(i, "b") for i in range(8)]
    links = []
    for n, i in enumerate(rng.sample(range(50), 14)):
        s, t = (source[i] if i < 40 else None), rng.choice(target)
        links.append(dict(
            link_id=f"l{n}", source_id=f"a{i:02}", target_id=rng.choice([t["id"], t["id"], t["id"], "gone", None]), target_hash=rng.choice(["stale", content(t), None]),
            source_hash=rng.choice(["old", content(s) if s else None]), keys=rng.sample("pqrstuvw", rng.choice([0, 0, 1, 2])), updated_at=rng.randrange(3),
        ))
    return source, target, links


def frames(spark, source, target, links):
    of = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    return of(source, RECORD), of(target, RECORD), of(links, LINK)


@pytest.mark.parametrize("seed, strategy, truth, owners, required", [
    (1, "last-write-wins", "a", {}, []), (2, "source-of-truth", "b", {}, []), (3, "field-merge", "a", {"phone": "b"}, []), (4, "last-write-wins", "a", {"phone": "b"}, ["email"]), (5, "field-merge", "a", {}, ["phone"]),
])
def test_records_see_what_earlier_ones_left(spark, seed, strategy, truth, owners, required):
    for s in (seed, seed + 100):
        source, target, links = world(s)
        done = C.reconciled(*frames(spark, source, target, links), FIELDS, strategy, truth, owners, required, F.lit(AT)).collect()
        got = {r.source_id: (r.status,) if r.status != "written" else (r.status, r.op, r.target_id, r.conflict, r.write_back, r.email, r.phone, r.source_hash, r.target_hash, r.link_id) for r in done}
        assert got == loop(source, target, links, strategy, truth, owners, required)
        assert all((r.missing is not None) == (r.status == "error") for r in done)


def test_first_agreement_of_a_key(spark):
    """A record with one candidate loses to its newer state and is written back; the next one of the key meets no conflict, and an equal one is an echo."""
    day = lambda n: datetime.datetime(2024, 1, n)
    source = [dict(id="a1", key="p", email="x", phone="1", modified=day(1)), dict(id="a2", key="p", email="y", phone="2", modified=day(1)), dict(id="a3", key="p", email="y", phone="2", modified=day(1))]
    target = [dict(id="b1", key="p", email="z", phone="9", modified=day(2))]
    done = {r.source_id: r for r in C.reconciled(*frames(spark, source, target, []), FIELDS).collect()}
    assert (done["a1"].conflict, done["a1"].email, done["a1"].write_back, done["a1"].op) == (True, "z", True, "update")
    assert (done["a2"].conflict, done["a2"].email, done["a2"].linked_by, done["a2"].link_id) == (False, "y", "key", "link-a1")
    assert done["a3"].status == "echo"


def test_a_merge_is_written_back_and_then_an_echo(spark):
    a, b, links = frames(spark, [dict(id="a1", key="p", email="p", phone=None, modified=datetime.datetime(2024, 2, 1))], [dict(id="b1", key="p", email="q", phone="5", modified=datetime.datetime(2024, 1, 1))],
                         [dict(link_id="l", source_id="a1", target_id="b1", target_hash="stale", source_hash="old", keys=[], updated_at=0)])
    done = C.reconciled(a, b, links, FIELDS, "field-merge").first()
    assert (done.conflict, done.email, done.phone, done.write_back, done.source_hash) == (True, "p", "5", True, done.target_hash)
    kept = C.links_carried(links, C.reconciled(a, b, links, FIELDS, "field-merge"), a)
    merged = spark.createDataFrame([("a1", "p", "p", "5", None)], RECORD)
    assert C.reconciled(merged, merged.withColumn("id", F.lit("b1")), kept, FIELDS).first().status == "echo"


def test_one_rule_for_links_by_key(spark):
    """Where a key has two links, the preview and the write go by the newest."""
    source, target, links = frames(
        spark, [dict(id="a9", key="p", email="n", phone="1", modified=None)], [dict(id=b, key=None, email=b, phone="1", modified=None) for b in ("b1", "b2")],
        [dict(link_id=n, source_id=s, target_id=b, target_hash=None, source_hash=None, keys=["o", "p"], updated_at=t) for n, s, b, t in (("l1", "x", "b1", 2), ("l2", "y", "b2", 1))],
    )
    done = C.reconciled(source, target, links, FIELDS)
    assert (done.first().target_id, R.preview(source, target, links, FIELDS).first().target_id) == ("b1", "b1")
    moved = {r.link_id: (r.source_id, r.target_id, r["keys"]) for r in C.links_carried(links, done, source).collect()}
    assert moved == {"l1": ("a9", "b1", ["o", "p"]), "l2": ("y", "b2", ["o", "p"])}


def test_nothing_and_unknown_strategies(spark):
    a, b, links = frames(spark, [], [], [])
    assert C.reconciled(a, b, links, FIELDS).collect() == []
    with pytest.raises(ValueError):
        C.reconciled(a, b, links, FIELDS, "coin-toss")


def test_a_key_with_very_many_records(spark):
    """All of one key: the first finds the only target, each later one what the one before has left."""
    rng = random.Random(9)
    source = [dict(id=f"a{i:05}", key="p", email=rng.choice(["x", "y", None]), phone="1", modified=datetime.datetime(2024, 1, 1)) for i in range(3000)]
    target = [dict(id="b1", key="p", email="z", phone="9", modified=datetime.datetime(2024, 2, 1))]
    done = C.reconciled(*frames(spark, source, target, []), FIELDS, required=["email"], at=F.lit(AT)).collect()
    want = loop(source, target, [], "last-write-wins", "a", {}, ["email"])
    assert {r.source_id: r.status for r in done} == {i: w[0] for i, w in want.items()}
    assert {r.source_id: (r.target_hash, r.link_id) for r in done if r.status == "written"} == {i: w[-2:] for i, w in want.items() if w[0] == "written"}
