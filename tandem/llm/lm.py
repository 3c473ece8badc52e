"""LM scoring with an Elias-Fano n-gram trie.

The model is a trigram model. Each order is smoothed by a Dirichlet prior around the one below: p(w | u v) = (c(u v w) + nu p(w | v)) /
(c(u v) + nu), p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu), and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A text begins in a
start context and ends with an end token; its first token has no trigram.

The trie is dealt over shards by the first word; a word that holds a large share of all tokens is split over several shards
by its successors. A shard is one flat buffer of levels, which can be memory-mapped: the sorted first words, monotone pointers from
each to its range of second words, the second words, pointers from each to its range of third words, and the third words, all in
Elias-Fano form, and one quantised count for each node, from which probabilities are made. Words are named relative to their
context, by 32 bits of a hash of both. A query finds its first word, then searches for the second in that word's range
only, then for the third in the range of that.

1. Tasks turn documents into blocks: a dictionary and the texts as numbers. The blocks are saved once.
2. Each block sends its distinct bigrams and trigrams, with their counts in its training texts, to the shards; nothing is cut off.
   A shard adds them up, builds its levels and answers every block from them.
3. Blocks meet their answers and add up the scores of their texts.

What is broadcast is the list of split contexts: those seen at least HOT times, of which there are at most 2**20.

Null texts count as empty: one end token. Null ids count as training rows. Repeated rows are scored, and learned from,
each. Without training rows all words are equally unknown. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, save
from .words import MULT, hashed_words, mix

#: Ids of the token that ends a text and of the context that starts one.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
#: Tokens of a block, tokens to a shard, least number of shards, and the least count of a context that is split.
BLOCK, SHARD, SHARDS, HOT = 1_000_000, 500_000, 256, 16_384
#: Weights of the priors of bigrams and trigrams, in tokens.
MU, NU = 150.0, 30.0
#: Quantised values: counts up to EXACT stand for themselves, larger ones are rounded to a 1,024th of a doubling.
EXACT, STEPS = 4096, 1024


def quantised(counts: np.ndarray) -> np.ndarray:
    """16-bit codes of counts; monotone."""
    large = EXACT + np.rint(np.log2(np.maximum(counts, EXACT) / EXACT) * STEPS)
    return np.where(counts < EXACT, counts, large).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    """The counts that codes stand for."""
    c = codes.astype(float)
    return np.where(c < EXACT, c, EXACT * 2 ** (np.maximum(c - EXACT, 0) / STEPS))


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of values, one after the other, in bytes."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, bit = at >> np.uint64(6), at & np.uint64(63)
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    np.bitwise_or.at(out, word.astype(np.int64), values << bit)
    over = np.flatnonzero(bit + np.uint64(width) > 64)
    np.bitwise_or.at(out, word[over].astype(np.int64) + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out.view(np.uint8)


class EliasFano:
    """A sorted sequence of unsigned integers: low bits as they are, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low.view(np.uint64), high, n, width
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        self.tops = ones - np.arange(n)  # the high bits of each value: what select gives on the unary part
        self.mask = np.uint64((1 << width) - 1)

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Encodes sorted values."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (top >> width) + 8) // 8 + 1, np.uint8)
        spots = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, spots >> 3, np.left_shift(1, spots & 7).astype(np.uint8))
        return _packed_bits(values & np.uint64((1 << width) - 1), width), high, n, width

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        top = self.tops[i].astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return top
        bits = i.astype(np.uint64) * np.uint64(self.width)
        word, bit = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
        low = self.low[word] >> bit
        low |= np.where(bit > 0, self.low[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
        return top | (low & self.mask)

    def search(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where each x stands in its range of positions [low, high), or -1."""
        a, b = low.copy(), high.copy()
        while len(going := np.flatnonzero(a < b)):
            middle = (a[going] + b[going]) >> 1
            less = self.at(middle) < x[going]
            a[going], b[going] = np.where(less, middle + 1, a[going]), np.where(less, b[going], middle)
        found = a < high
        found[found] = self.at(a[found]) == x[found]
        return np.where(found, a, -1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each x stands in the whole sequence, or -1: only values with its high bits are looked at."""
        top = np.minimum(x >> np.uint64(self.width), np.uint64(2**62)).astype(np.int64)
        return self.search(x, np.searchsorted(self.tops, top, "left"), np.searchsorted(self.tops, top, "right"))


class Trie:
    """The levels of a shard, read from one buffer (bytes or a memory map)."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 20)
        at = 160
        found = []
        for k in range(5):
            n, width, low, high = head[4 * k : 4 * k + 4].tolist()
            found.append(EliasFano(np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low), n, width))
            at += low + -(-high // 8) * 8
        self.contexts, self.pointers, self.successors, self.pointers2, self.thirds = found
        self.codes = np.frombuffer(buffer, np.uint16, self.successors.n, at)
        self.codes2 = np.frombuffer(buffer, np.uint16, self.thirds.n, at + 2 * self.successors.n)

    @staticmethod
    def build(contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, keys2: np.ndarray, counts2: np.ndarray) -> bytes:
        """Levels of sorted first words and of sorted keys (rank in the level above in the upper, the word in the lower 32 bits)."""
        edges = lambda n, k: np.searchsorted(k, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint64)
        head, body = [], []
        for values in (contexts, edges(len(contexts), keys), keys, edges(len(keys), keys2), keys2):
            low, high, n, width = EliasFano.parts(values)
            head += [n, width, len(low), len(high)]
            body += [low.tobytes(), high.tobytes(), b"\0" * (-len(high) % 8)]
        return np.array(head, np.int64).tobytes() + b"".join(body) + quantised(counts).tobytes() + quantised(counts2).tobytes()

    def ranks(self, contexts: np.ndarray) -> np.ndarray:
        """The rank of each context, -1 where it is unknown."""
        return self.contexts.find(contexts)

    def below(self, ranks: np.ndarray, words: np.ndarray, level: int) -> np.ndarray:
        """Where each word stands in the level below, searched for in the range of its context there; -1 where it does not, or the context is -1."""
        pointers, nodes = ((self.pointers, self.successors), (self.pointers2, self.thirds))[level]
        out = np.full(len(ranks), -1)
        known = np.flatnonzero(ranks >= 0)
        r = ranks[known]
        low, high = pointers.at(r).astype(np.int64), pointers.at(r + 1).astype(np.int64)
        out[known] = nodes.search(r.astype(np.uint64) << np.uint64(32) | words[known].astype(np.uint64), low, high)
        return out

    def values(self, places: np.ndarray, level: int) -> np.ndarray:
        """The codes of nodes; 0 for -1."""
        codes = (self.codes, self.codes2)[level]
        return np.where(places >= 0, codes[np.maximum(places, 0)], np.uint16(0)) if len(codes) else np.zeros(len(places), np.uint16)


def narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest type that holds all of them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """Reads n integers written by narrow."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _small(values: np.ndarray) -> bytes:
    """Mostly small integers, compressed, with the width of each in front."""
    data = narrow(values)
    return bytes([len(data) // max(len(values), 1)]) + pa.compress(data, codec="zstd", asbytes=True) if len(values) else b""


def _smalls(data: bytes, n: int) -> np.ndarray:
    return wide(pa.decompress(data[1:], n * data[0], codec="zstd", asbytes=True), n) if n else np.zeros(0, np.int64)


def _squeezed(numbers: np.ndarray) -> bytes:
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, held, id_col: str, text_col: str) -> DataFrame:
    """Documents by blocks: ids, whether held out, tokens in each, the dictionary (most frequent words first), and the texts as numbers in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "ids", "held", "sizes", "n", "words", "counts", "tokens"]

    def row(parts: list) -> list:
        sizes = np.concatenate([p[2] for p in parts])
        words, tokens, counts = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = pa.concat_arrays([p[0] for p in parts])
        held_ = pa.concat_arrays([p[1] for p in parts])
        return [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], held_), pa.array([sizes.tolist()], pa.list_(pa.int64())),
                pa.array([len(tokens)], pa.int64()), pa.array([words[order].tobytes()], pa.binary()), pa.array([narrow(counts[order])], pa.binary()), pa.array([_squeezed(place[tokens])], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, edge = hashed_words([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()])
                parts.append((part.column(0), part.column(1), np.diff(edge) + 1, np.insert(words, edge[1:], END)))
                n += len(parts[-1][3])
                if n >= BLOCK:
                    yield pa.RecordBatch.from_arrays(row(parts), names=names)
                    parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(row(parts), names=names)

    schema = f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, n long, words binary, counts binary, tokens binary"
    return map_arrow(docs.select(F.col(id_col), F.coalesce(held, F.lit(False)).alias("_held"), F.col(text_col).cast("string").alias("_text")), run, schema)


def split_contexts(found: DataFrame, total: int) -> dict[int, int]:
    """Contexts to split and the number of their parts: at most total / HOT, or 2**20, of them."""
    least = max(HOT, total >> 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = wide(counts, len(words) // 8)
                often = int((counts >= least * n / max(total, 1)).sum())  # the most frequent come first
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)[:often]), pa.array(counts[:often])], names=["word", "c"])

    rows = found.select("words", "counts", "n").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    out = {r.word: -(-2 * r.c // least) for r in rows.collect()}
    start = found.agg(F.sum(F.size("ids"))).first()[0] or 0
    if start >= least:
        out[int(START.view(np.int64))] = -(-2 * start // least)
    return out


class Asked:
    """The distinct bigrams of a block, dealt over shards: what a block asks, in the order in which answers come."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, shards: int, split: tuple[np.ndarray, np.ndarray]):
        size = len(words) + 1  # the start context has the last number
        self.words, self.tokens, self.sizes = words, tokens, sizes
        self.before = np.empty(len(tokens), np.int64)
        self.before[1:] = tokens[:-1]
        self.before[np.cumsum(sizes) - sizes] = size - 1
        bigrams, self.which = np.unique(self.before * size + tokens, return_inverse=True)
        a, b = bigrams // size, bigrams % size
        ids = np.append(words, START)
        self.successors = (mix(ids[a] * np.uint64(MULT) + mix(words[b])) >> np.uint64(32)).astype(np.uint32)
        keys, parts = split
        spot = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
        n_parts = np.where(keys[spot] == ids, parts[spot], 1) if len(keys) else np.ones(size, np.int64)
        part = self.successors.astype(np.int64) % n_parts[a]
        shard = self._shard(ids[a], part, shards)
        self.home = self._shard(ids, np.zeros(size, np.int64), shards) * size + np.arange(size)
        pairs = shard * size + a
        entries = np.union1d(self.home, pairs)
        place = np.searchsorted(entries, pairs)
        self.order = np.argsort(place, kind="stable")
        self.per_entry = np.bincount(place, minlength=len(entries))
        # Trigrams, named by their first two words' bigram; a text's first token has none.
        self.second = np.ones(len(tokens), bool)
        self.second[np.cumsum(sizes) - sizes] = False
        at = np.flatnonzero(self.second)
        trigrams, self.which3 = np.unique(self.which[at - 1] * size + tokens[at], return_inverse=True)
        upper, third = trigrams // size, trigrams % size
        self.thirds = (mix(self.successors[upper].astype(np.uint64) * np.uint64(MULT) + mix(words[third] + ids[a[upper]])) >> np.uint64(32)).astype(np.uint32)
        rank = np.empty(len(bigrams), np.int64)
        rank[self.order] = np.arange(len(bigrams))
        self.order3 = np.argsort(rank[upper], kind="stable")
        self.per_bigram = np.bincount(rank[upper], minlength=len(bigrams))  # in the order of answers
        self.at_home = np.searchsorted(entries, self.home)
        self.entry_ids, self.entry_shards = ids[entries % size], entries // size

    @staticmethod
    def _shard(ids: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
        return (mix(ids + part.astype(np.uint64) * np.uint64(MULT)) % np.uint64(shards)).astype(np.int64)

    def rows(self, block: int, train: np.ndarray) -> pa.RecordBatch:
        """One row for each shard: first words with their counts and numbers of second words, those with theirs, and the third words."""
        own = np.zeros(len(self.entry_ids), np.int64)
        own[self.at_home[:-1]] = np.bincount(self.tokens[train], minlength=len(self.words))
        counts = np.bincount(self.which[train], minlength=len(self.successors))[self.order]
        successors = self.successors[self.order]
        counts3 = np.bincount(self.which3[train[self.second]], minlength=len(self.thirds))[self.order3]
        thirds = self.thirds[self.order3]
        edge, upto, upto3 = self.edges()
        columns: list[list] = [[] for _ in range(8)]
        for x, y in zip(edge[:-1], edge[1:]):
            s, t = slice(upto[x], upto[y]), slice(upto3[upto[x]], upto3[upto[y]])
            for c, v in zip(columns, (self.entry_ids[x:y].tobytes(), narrow(own[x:y]), narrow(self.per_entry[x:y]), successors[s].tobytes(), narrow(counts[s]), _small(self.per_bigram[s]), thirds[t].tobytes(), _small(counts3[t]))):
                c.append(v)
        shard = self.entry_shards[edge[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(shard), block)), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "block", "contexts", "own", "sizes", "successors", "counts", "sizes3", "thirds", "counts3"])

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each shard's first words begin, each first word's second words, and each second word's third words."""
        edge = np.append(np.flatnonzero(np.diff(self.entry_shards, prepend=-1)), len(self.entry_ids))
        return edge, np.concatenate(([0], np.cumsum(self.per_entry))), np.concatenate(([0], np.cumsum(self.per_bigram)))


def _read(row: dict, shards: int, split) -> tuple[Asked, np.ndarray]:
    sizes = np.array(row["sizes"], np.int64)
    asked = Asked(np.frombuffer(row["words"], np.uint64), _numbers(row["tokens"], row["n"]), sizes, shards, split)
    return asked, np.repeat(~np.array(row["held"], bool), sizes)


def answer(rows: pa.Table) -> pa.Table:
    """A shard: adds up what blocks sent, builds the levels, and looks up all that was asked."""
    rows = rows.to_pylist()
    contexts = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
    own = [wide(r["own"], len(c)) for r, c in zip(rows, contexts)]
    sizes = [wide(r["sizes"], len(c)) for r, c in zip(rows, contexts)]
    successors = [np.frombuffer(r["successors"], np.uint32) for r in rows]
    counts = np.concatenate([wide(r["counts"], len(s)) for r, s in zip(rows, successors)])
    known, rank = np.unique(np.concatenate(contexts), return_inverse=True)
    word_counts = np.bincount(rank, np.concatenate(own)).astype(np.int64)
    keys = np.repeat(rank, np.concatenate(sizes)).astype(np.uint64) << np.uint64(32) | np.concatenate(successors)
    learned = np.flatnonzero(counts)
    nodes, node = np.unique(keys[learned], return_inverse=True)
    sums = np.bincount(node, counts[learned], len(nodes)).astype(np.int64)
    place = np.full(len(keys), -1)
    place[learned] = node
    del keys, node, rank
    sizes3 = [_smalls(r["sizes3"], len(s)) for r, s in zip(rows, successors)]
    counts3 = [_smalls(r["counts3"], int(n.sum())) for r, n in zip(rows, sizes3)]
    thirds = [np.frombuffer(r["thirds"], np.uint32) for r in rows]
    seen = np.concatenate(counts3)
    new = np.flatnonzero(seen)
    parents = np.repeat(place, np.concatenate(sizes3))[new]
    nodes3, node = np.unique(parents.astype(np.uint64) << np.uint64(32) | np.concatenate(thirds)[new], return_inverse=True)
    trie = Trie(Trie.build(known, nodes, sums, nodes3, np.bincount(node, seen[new], len(nodes3)).astype(np.int64)))
    del place, parents, node, nodes, nodes3, seen, new
    out: list[list] = [[], [], []]
    for c, n, s, n3, t in zip(contexts, sizes, successors, sizes3, thirds):
        ranks = trie.ranks(c)
        out[0].append(narrow(word_counts[ranks]))
        found = trie.below(np.repeat(ranks, n), s, 0)
        out[1].append(narrow(trie.values(found, 0)))
        out[2].append(_small(trie.values(trie.below(np.repeat(found, n3), t, 1), 1)))
    zeros = [0] * (len(rows) - 1)
    columns = {"block": [r["block"] for r in rows], "shard": [r["shard"] for r in rows], "own": out[0], "codes": out[1], "codes3": out[2], "known": [int((word_counts > 0).sum()), *zeros], "total": [int(word_counts.sum()), *zeros]}
    return pa.table(columns, pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("own", pa.binary()), ("codes", pa.binary()), ("codes3", pa.binary()), ("known", pa.int64()), ("total", pa.int64())]))


def score(docs: DataFrame, held, mu: float = MU, nu: float = NU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score; held: a condition for rows that are not learned from."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = save(blocks(docs, held, id_col, text_col), "lm-blocks")
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = split_contexts(found, total)
    keys = np.array(sorted(parts), np.int64).view(np.uint64)
    order = np.argsort(keys)
    split = keys[order], np.array([parts[k] for k in sorted(parts)], np.int64)[order]
    shards = max(SHARDS, total // SHARD)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asked, train = _read(row, shards, split)
                yield asked.rows(row["block"], train)

    wanted = "shard long, block long, contexts binary, own binary, sizes binary, successors binary, counts binary, sizes3 binary, thirds binary, counts3 binary"
    dealt = found.select("block", "held", "sizes", "n", "words", "tokens").mapInArrow(ask, wanted)
    answers = save(dealt.groupBy("shard").applyInArrow(answer, "block long, shard long, own binary, codes binary, codes3 binary, known long, total long"), "lm-answers")
    known, train_tokens = (x or 0 for x in answers.agg(F.sum("known"), F.sum("total")).first())

    def finish(block: pa.Table, rows: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        asked, _ = _read(row, shards, split)
        rows = sorted(rows.to_pylist(), key=lambda r: r["shard"])
        edge, upto, upto3 = asked.edges()
        own = np.concatenate([wide(r["own"], y - x) for r, x, y in zip(rows, edge[:-1], edge[1:])])
        codes = np.empty(len(asked.successors), np.int64)
        codes[asked.order] = np.concatenate([wide(r["codes"], upto[y] - upto[x]) for r, x, y in zip(rows, edge[:-1], edge[1:])])
        codes3 = np.empty(len(asked.thirds), np.int64)
        codes3[asked.order3] = np.concatenate([_smalls(r["codes3"], upto3[upto[y]] - upto3[upto[x]]) for r, x, y in zip(rows, edge[:-1], edge[1:])])
        count = own[asked.at_home]
        count[-1] = count[np.flatnonzero(asked.words == END)[0]]  # as many texts start as end
        c = count[asked.tokens]
        base = (c + 0.5) / (train_tokens + 0.5 * (known + 1))
        pair = restored(codes)[asked.which]
        p = np.minimum((pair + mu * base) / (count[asked.before] + mu), 1.0)
        at = np.flatnonzero(asked.second)
        p[at] = np.minimum((restored(codes3)[asked.which3] + nu * p[at]) / (pair[at - 1] + nu), 1.0)
        first = np.cumsum(asked.sizes) - asked.sizes
        n = len(asked.sizes)
        arrays = [pa.array(row["ids"], block.schema.field("ids").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(asked.sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(n, train_tokens)), pa.array(np.add.reduceat(np.log10(base), first)), pa.array(np.add.reduceat(np.log10(p), first))]
        return pa.Table.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scores = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = found.select("block", "ids", "held", "sizes", "n", "words", "tokens")
    return texts.groupBy("block").cogroup(answers.select("block", "shard", "own", "codes", "codes3").groupBy("block")).applyInArrow(finish, scores).withColumnRenamed("id", id_col)
