"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces, and how many
pieces a pre-token has does not depend on where it stands.

1. Texts are cut into pre-tokens, in blocks of some megabytes of text. A pre-token that is an entry of the vocabulary has one piece, and is
   only added up. A block's other distinct pre-tokens are numbered, and each document keeps the numbers of its own with how often they come.
2. The blocks' pre-tokens meet, sorted, and each distinct one of the corpus is encoded once, to count its pieces.
3. The counts are joined back by block to the documents' frequencies, by number, and summed.

A pre-token comes at most once a block, so that no key holds more rows than there are blocks, however frequent a word is; what meets
in one group is one block. No token ids are made but those of step 2, and none is kept.

Counts are those of the tokenizers library with add_special_tokens=False: special tokens written in a text are one token each. Null
texts count as empty: 0 bytes, 0 tokens. Null and repeated ids are kept as they are, rows being independent; bytes that are no text count as the
replacement character; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import PATTERN, default_path
from .tables import map_arrow, save

#: Bytes of text, with 64 more for each, after which a block ends (a longer text is a block of its own), pre-tokens encoded at a time, and
#: rows after which counts go back to their blocks: the more at once, the fewer bytes.
BLOCK, BATCH, BACK = 64 << 20, 4096, 1 << 18


class Cutter:
    """Cuts texts into pre-tokens as the tokenizers library does."""

    def __init__(self, path: str | None = None):
        import regex
        from tokenizers import Tokenizer

        path = path or default_path()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["normalizer"] or file["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("pieces are counted by pre-token for byte-level vocabularies without normalizer and prefix space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(PATTERN).findall
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take their surroundings with them are not supported")
        marks = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, marks))).split if marks else lambda text: [text]
        self.known: set[str] = set()
        vocabulary = [self.library.decode([i], skip_special_tokens=False) for i in range(self.library.get_vocab_size())]
        own = [w for w, n in zip(vocabulary, self.pieces(vocabulary)) if n == 1 and "\ufffd" not in w]
        self.single = frozenset(own)  # pre-tokens of one piece

    def common(self, text: str) -> bool:
        """Whether all characters have been in Unicode for so long that every library knows their classes."""
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.known |= new
        return True

    def cut(self, text: str) -> tuple[int, Counter]:
        """The number of special tokens, and the pre-tokens with how often they come."""
        parts = self.split(text)
        words: Counter = Counter()
        for part in parts:
            if part.isascii() or self.common(part):
                words.update(self.find(part))
            else:
                words.update(part[a:e] for _, (a, e) in self.library.pre_tokenizer.pre_tokenize_str(part))
        return len(parts) - 1, words

    def pieces(self, words: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        return [len(x.ids) for x in self.library.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def cutter(path: str | None) -> Cutter:
    """One per worker process and file."""
    return Cutter(path)


def _packed(own: list[int] | np.ndarray, times: list[int] | np.ndarray) -> bytes:
    """Numbers in order, as steps, and how often each comes."""
    own, times = np.array(own, np.int32), np.array(times, np.int32)
    order = np.argsort(own)
    return zlib.compress(np.diff(own[order], prepend=np.int32(0)).tobytes() + times[order].tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = np.frombuffer(zlib.decompress(data), np.int32).reshape(2, -1)
    return np.cumsum(steps), times.astype(np.int64)


def _blocks(docs: DataFrame, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows by block: (block, number, word), and (block, _id, n_bytes, n_words, words) with numbers and frequencies packed."""
    fields = StructType.fromDDL("block long, number int, word string, n_bytes long, n_words long, words binary")
    schema = StructType([*fields.fields, StructField("_id", docs.schema[id_col].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        numbers: dict[str, int] = {}
        held: list[tuple] = []
        ids: list[pa.Array] = []

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                n = len(part)
                columns = [pa.array([block] * n, pa.int64()), pa.array(range(a, a + n), pa.int32()), pa.array(part, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, ids[0].type)], names=schema.names)
            n = len(held)
            columns = [pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), *columns, pa.concat_arrays(ids)], names=schema.names)

        tool = cutter(path)
        for batch in batches:
            for i, raw in enumerate(batch.column(1).cast(pa.binary())):
                data = raw.as_py() or b""
                if size and size + len(data) > BLOCK:
                    yield from rows()
                    block, size, numbers, held, ids = block + 1, 0, {}, [], []
                marks, words = tool.cut(data.decode("utf-8", "replace"))
                several = [(numbers.setdefault(w, len(numbers)), n) for w, n in words.items() if w not in tool.single]
                held.append((len(data), marks + words.total(), _packed(*map(list, zip(*several))) if several else None))
                ids.append(batch.column(0).slice(i, 1))
                size += len(data) + 64
                if len(ids) >= 4096:
                    ids = [pa.concat_arrays(ids)]
        if held:
            yield from rows()

    return map_arrow(docs.select(docs[id_col], docs[text_col].cast("string")), run, schema)


def _counted(words: DataFrame, path: str | None) -> DataFrame:
    """(_block, counts) of rows in which equal pre-tokens come one after the other: numbers and their pieces, packed, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last, known, held, size = cutter(path), None, 0, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            block, number, n = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(block, kind="stable")
            blocks, at = np.unique(block[order], return_index=True)
            found = [_packed(number[i], n[i]) for i in np.split(order, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(found, pa.binary())], names=["_block", "counts"])

        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                words = part.column(2).to_pylist()
                first = np.array([w != v for w, v in zip(words, [last, *words])])
                new = np.array([known, *tool.pieces([w for w, f in zip(words, first) if f])], np.int32)
                counts = new[np.cumsum(first)]
                last, known = words[-1], counts[-1]
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), counts))
                size += len(words)
                if size >= BACK:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    return map_arrow(words, run, "_block long, counts binary")


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; path: a byte-level vocabulary file that every machine can open."""
    blocks = save(_blocks(docs, path, id_col, text_col), "token-blocks")
    words = blocks.where(F.col("word").isNotNull()).select("block", "number", "word")
    found = _counted(words.repartition("word").sortWithinPartitions("word"), path)
    texts = blocks.where(F.col("word").isNull()).select("block", "n_bytes", "n_words", "words", "_id")
    schema = StructType([StructField(id_col, blocks.schema["_id"].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def add_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
        found = [_unpacked(x.as_py()) for x in counts["counts"]]
        extra = np.zeros(1 + max((own[-1] for own, _ in found), default=0), np.int64)
        for own, n in found:
            extra[own] = n - 1
        total = rows["n_words"].to_numpy().copy()
        for i, packed in enumerate(rows["words"]):
            if packed.is_valid:
                own, times = _unpacked(packed.as_py())
                total[i] += extra[own] @ times
        return pa.table([rows["_id"], rows["n_bytes"], pa.array(total)], names=schema.names)

    counted = texts.groupBy("block").cogroup(found.groupBy("_block")).applyInArrow(add_up, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
