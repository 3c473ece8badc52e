"""Rows of Arrow batches as the run of records reads them."""

import datetime
import random

import pyarrow as pa

from tandem.operators import carry as C

LINK = pa.struct([("link_id", pa.string()), ("keys", pa.list_(pa.string()))])
PAIR = pa.struct([("email", pa.struct([("v", pa.int64()), ("x", pa.string())]))])
KINDS = {"id": pa.string(), "own": LINK, "targets": pa.list_(pa.struct([("id", pa.string()), ("w", PAIR)])), "w": PAIR, "at": pa.timestamp("us", "UTC")}


def test_columns_give_the_rows_of_to_pylist():
    rng = random.Random(1)
    maybe = lambda v: rng.choice([None, v])
    pair = lambda: maybe({"email": maybe({"v": maybe(2**60 + 1), "x": maybe("é")})})
    rows = [{"id": maybe(str(i)), "own": maybe({"link_id": maybe("l"), "keys": maybe([maybe("p") for _ in range(rng.randrange(3))])}), "targets": maybe([maybe({"id": "b", "w": pair()}) for _ in range(rng.randrange(3))]),
             "w": pair(), "at": maybe(datetime.datetime(2024, 1, 1, 0, 0, 0, i, datetime.timezone.utc))} for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in KINDS.items()], names=list(KINDS))
    for part in (batch, batch.slice(7, 100), batch.slice(5, 0)):
        assert [dict(zip(KINDS, row)) for row in zip(*map(C._plain, part.columns))] == part.to_pylist()
