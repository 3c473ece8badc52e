"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks, so that equal passages are cut alike wherever they stand. A
chunk is encoded once per task, and its ids are reused by all documents there. A cut may fall inside a word, so every join of
two chunks is repaired: the last tokens of what stands before it and the first of what follows are decoded, and their
text is encoded anew. When this begins with the first and ends with the last of the tokens that it replaces, both sides
agree; until then the window grows to twice as many tokens. Two neighbouring tokens are right wherever they are what
their joint text is encoded as, so ids that agree at both ends of a window are those of the whole text, in every script.

Encoding uses the tokenizer's merge ranks; ids are those of the tokenizers library. Special tokens written in a text are taken as
such, as that library does. A task keeps at most 2 * KEPT chunks, those met last; one that is not kept is encoded again.

Null texts count as empty. Repeated rows, ties and other columns need no care: rows are independent.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .tables import map_arrow

#: The pre-tokenizer's pattern, and the library's display alphabet for bytes (printable ones stand for themselves).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: One place in 2**CUT_BITS is a cut; least and most bytes of a chunk; chunks in each of the two generations that a task keeps;
#: tokens on each side of a join that are encoded anew at first.
CUT_BITS, LEAST, MOST, KEPT, WINDOW = 9, 32, 4096, 20_000, 4


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file, found where the package is installed on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes bytes, keeping what it has encoded."""

    def __init__(self, path: str | None = None):
        import tiktoken

        path = path or default_path()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet = _byte_alphabet()
        words = {bytes(alphabet[c] for c in w): i for w, i in file["model"]["vocab"].items() if all(c in alphabet for c in w)}
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        ranks = {w: i for w, i in words.items() if w not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (1 + max(*words.values(), *self.special.values()))
        for w, i in [*words.items(), *self.special.items()]:
            self.table[i] = w
        self.inner = [0x80 <= w[0] < 0xC0 if w else False for w in self.table]  # tokens that begin inside a character
        self.kept: dict[bytes, array] = {}
        self.older: dict[bytes, array] = {}
        self.gear = np.random.default_rng(1).integers(1, 2**32, 256, dtype=np.uint32)

    def cuts(self, data: bytes) -> list[int]:
        """Where the chunks begin and end: places told by the 16 bytes before them, moved to the next character."""
        n = len(data)
        if n <= LEAST:
            return [0, n]
        h = self.gear[np.frombuffer(data, np.uint8)]
        for step, mult in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):
            h = h[:-step] * np.uint32(mult) + h[step:]  # h[i]: of the bytes i to i + 2 * step - 1
        out, a = [0], 0
        for x in [*(np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 16).tolist(), n]:
            while x - a > MOST:
                a = self._character(data, a + MOST)
                out.append(a)
            if x - a >= LEAST and x < n:
                a = self._character(data, x)
                out.append(a)
        return [*out, n] if out[-1] < n else out

    @staticmethod
    def _character(data: bytes, at: int) -> int:
        while at < len(data) and 0x80 <= data[at] < 0xC0:
            at += 1
        return at

    def chunk(self, piece: bytes) -> array:
        """Ids of a chunk, from what is kept if it is."""
        got = self.kept.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = array("I", self.fast.encode_ordinary(piece.decode()))
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[piece] = got
        return got

    def join(self, done: array, more: array) -> None:
        """Appends the ids of a chunk to those of the text before it, with the join repaired."""
        table, inner, width = self.table, self.inner, WINDOW
        while True:
            i, j = max(len(done) - width, 0), min(width, len(more))
            while i and inner[done[i]]:
                i -= 1
            while j < len(more) and inner[more[j]]:
                j += 1
            old = [*done[i:], *more[:j]]
            new = self.fast.encode_ordinary(b"".join([table[t] for t in old]).decode())
            if (not i or new[0] == old[0]) and (j == len(more) or new[-1] == old[-1]):
                break
            width *= 2
        if new != old:
            done[i:] = array("I", new)
            done += more[j:]
        else:
            done += more

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text given in UTF-8, as little-endian unsigned 32-bit integers."""
        for mark, number in self.special.items():
            if mark in data:
                parts = [self.encode(p) for p in data.split(mark)]
                own = np.array([number], "<u4")
                return np.concatenate([x for p in parts for x in (p, own)][:-1])
        edges = self.cuts(data)
        done = array("I")
        for a, e in zip(edges, edges[1:]):
            more = self.chunk(data[a:e])
            if done:
                self.join(done, more)
            else:
                done += more
        return np.frombuffer(done, np.uint32).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8; bytes that are no text become the replacement character."""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str | None) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def over_texts(docs: DataFrame, columns: list[str], text_col: str, extra: str, per_batch: Callable) -> DataFrame:
    """Runs per_batch(list of UTF-8 texts) over the rows: it returns (row numbers, arrays of the extra columns)."""
    kept = [c for c in columns if c != text_col]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [x or b"" for x in part.column(len(kept)).cast(pa.binary()).to_pylist()]
                rows, arrays = per_batch(texts)
                own = [part.column(i).take(pa.array(rows)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[str(i) for i in range(len(own) + len(arrays))])

    return map_arrow(docs.select(*kept, docs[text_col].cast("string").alias("_text")), _named(run, fields), fields)


def _named(run: Callable, fields: str) -> Callable:
    names = StructType.fromDDL(fields).names

    def renamed(batches):
        for b in run(batches):
            yield b.rename_columns(names)

    return renamed


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (id, ids)."""

    def ids(texts):
        found = [codec(path).encode(t) for t in texts]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32)
        return range(len(texts)), [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

    return over_texts(docs, [id_col], text_col, "ids array<int>", ids)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids; the other columns stay."""
    columns = encoded.columns
    at = columns.index(ids_col)
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = part.column(at)
                lists = lists.cast(pa.list_(pa.int32())) if not pa.types.is_list(lists.type) else lists
                edge, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = [codec(path).decode(values[a:b]).decode() for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return map_arrow(encoded, run, schema)
