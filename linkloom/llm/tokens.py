"""Encoding of texts with a byte-level BPE vocabulary.

The JVM splits texts into pre-tokens. Those that a batch holds are encoded once each, all together: their bytes form
linked lists in a few arrays, and a queue of merge ranks holds, per rank, the list positions
whose pair has it. A hierarchical bitmap gives the next rank that holds any; entries that a
merge has overtaken are recognised as stale and skipped. Each merge is done once, so the
work grows with the length of a pre-token and not with its square.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies if no path is given: that of the installed package.
VOCABULARY_PACKAGE = "public_tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k"

#: Pre-tokens that one worker remembers from batch to batch; beyond it starts anew.
REMEMBERED = 400_000

#: Fixed value, the vocabulary's pattern that splits text before the merges, in the JVM's notation.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)


class RankBitmap:
    """A set of ranks with find-first-set: words of 64 bits, and levels above that mark non-empty words."""

    def __init__(self, size: int) -> None:
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                return

    def add(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            before = level[word]
            if before & bit:
                return
            level[word] = before | bit
            if before:
                return
            rank = word

    def take_first(self) -> int:
        """The least rank, which is removed; -1 if there is none."""
        top = self.levels[-1][0]
        if not top:
            return -1
        rank = (top & -top).bit_length() - 1
        for level in reversed(self.levels[:-1]):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        place = rank
        for level in self.levels:
            word, bit = place >> 6, 1 << (place & 63)
            level[word] &= ~bit
            if level[word]:
                break
            place = word
        return rank


class PairTable:
    """Merged id of two ids, looked up for whole arrays: open addressing in two arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left = ranks.get(token[:at])
                right = ranks.get(token[at:]) if left is not None else None
                if right is not None:
                    pairs[left << 20 | right] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        merged = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.probes = 0
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]] = keys[won]
            self.merged[slots[won]] = merged[won]
            keys, merged, slots = keys[~won], merged[~won], (slots[~won] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; -1 where the two don't merge."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slot(keys)
        seen = self.keys[slots]
        result = np.where(seen == keys, self.merged[slots], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            result[open_[hit]] = self.merged[slots[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return result


class BytePairEncoder:
    """Encodes pre-tokens as the public tokenizer whose ranks it is given."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def merge(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens written one after the other, and how many ids each has.

        ends: where each pre-token ends in data; none is empty.
        """
        n = len(data)
        ids = np.empty(n + 2, np.int32)
        ids[:n] = self.bytes[np.frombuffer(data, np.uint8)]
        ids[n:] = -1
        after = np.arange(1, n + 3)
        after[ends - 1] = n  # the sentinels: n after the last of a pre-token, n + 1 before the first
        before = np.arange(-1, n + 1)
        before[np.concatenate(([0], ends[:-1]))] = n + 1
        pair = np.full(n + 2, -1, np.int32)
        inner = np.flatnonzero(after[:n] != n)
        pair[inner] = self.pairs(ids[inner], ids[inner + 1])
        queue = RankBitmap(self.size)
        buckets: dict[int, list[np.ndarray]] = {}
        self._push(queue, buckets, inner, pair[inner])
        while (rank := queue.take_first()) >= 0:
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1:
                chained = right[:-1] == at[1:]
                if chained.any():  # of overlapping pairs every other one, from the left
                    fresh = np.concatenate(([True], ~chained))
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
                    right = after[at]
            beyond = after[right]
            ids[at] = rank
            after[at] = beyond
            pair[right] = -1
            before[beyond] = at
            before[n + 1] = after[n] = n  # of the sentinels only their id counts
            left = before[at]
            left = left[left <= n - 1]
            touched = np.concatenate((left, at))
            touched = touched[after[touched] != n]
            pair[at] = -1
            merged = self.pairs(ids[touched], ids[after[touched]])
            pair[touched] = merged
            self._push(queue, buckets, touched, merged)
        alive = np.zeros(n, bool)
        first = np.concatenate(([0], ends[:-1])).astype(np.int64)
        at = first
        while len(at):  # a step along all lists at once
            alive[at] = True
            at = after[at]
            at = at[at < n]
        counts = np.add.reduceat(alive, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        return ids[:n][alive], counts

    @staticmethod
    def _push(queue: RankBitmap, buckets: dict[int, list[np.ndarray]], at: np.ndarray, ranks: np.ndarray) -> None:
        real = ranks >= 0
        at, ranks = at[real], ranks[real]
        if not len(at):
            return
        keys = np.unique(ranks.astype(np.int64) << 40 | at)
        at, ranks = keys & ((1 << 40) - 1), keys >> 40
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begin = 0
        for rank, end in zip(ranks[np.concatenate(([0], cuts))].tolist(), [*cuts.tolist(), len(at)]):
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = [at[begin:end]]
                queue.add(rank)
            else:
                held.append(at[begin:end])
            begin = end

    def _learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens that aren't known yet and remember them."""
        coded = [t.encode() for t in tokens]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        values, counts = self.merge(b"".join(coded), ends)
        base = len(self.values)
        self.codes.update(zip(tokens, range(len(self.starts), len(self.starts) + len(tokens))))
        self.starts = np.concatenate((self.starts, base + np.cumsum(counts) - counts))
        self.lengths = np.concatenate((self.lengths, counts))
        self.values = np.concatenate((self.values, values))

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct pre-tokens start in self.values, and how many they are."""
        if len(self.codes) > REMEMBERED or len(self.values) > 8 * REMEMBERED:
            self._forget()
        new = [t for t in tokens if t not in self.codes]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        return self.starts[codes], self.lengths[codes]

    def encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of pre-tokens, one after the other, and how many each list has; none for a null."""
        offsets = lists.offsets.to_numpy()
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        kinds = flat.indices.to_numpy(zero_copy_only=False)
        starts, lengths = self.look_up(flat.dictionary.to_pylist())
        lengths = lengths[kinds]
        total = np.concatenate(([0], np.cumsum(lengths)))
        place = np.repeat(starts[kinds] - total[:-1], lengths)
        place += np.arange(total[-1])
        return self.values[place], np.diff(total[offsets - offsets[0]])

    def count(self, lists: pa.ListArray) -> np.ndarray:
        """How many ids each list of pre-tokens has."""
        offsets = lists.offsets.to_numpy()
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        lengths = self.look_up(flat.dictionary.to_pylist())[1][flat.indices.to_numpy(zero_copy_only=False)]
        return np.diff(np.concatenate(([0], np.cumsum(lengths)))[offsets - offsets[0]])


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    return importlib.import_module(VOCABULARY_PACKAGE).path(f"{name}.tiktoken")


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file of lines `base64-token rank`; one per worker."""
    if path not in _encoders:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        _encoders[path] = BytePairEncoder(ranks)
    return _encoders[path]


def _pre_tokens(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return documents.select(
        F.col(id_column).alias("id"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("tokens")
    )


def token_ids(documents: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """(id_column, ids): the token ids of each text, without special tokens.

    An empty and a null text have an empty list; blank texts are encoded like any other. A
    row with a null id comes out as well; repeated rows come out repeatedly. Texts may be
    of any length. Other columns are ignored. path: the vocabulary file; by default
    byte_bpe_50k of the installed package.
    """
    at = path or vocabulary_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(at)
        for batch in batches:
            values, counts = tool.encode(batch.column(1))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    split = _pre_tokens(documents, id_column, text_column)
    schema = T.StructType(
        [T.StructField("id", split.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    return split.mapInArrow(encoded, schema).select(F.col("id").alias(id_column), "ids")


def token_counts(documents: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """(id_column, n_tokens): how many tokens each text has; 0 for an empty and for a null text."""
    at = path or vocabulary_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(at)
        for batch in batches:
            counts = pa.array(tool.count(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["id", "n_tokens"])

    split = _pre_tokens(documents, id_column, text_column)
    schema = T.StructType([T.StructField("id", split.schema["id"].dataType), T.StructField("n_tokens", T.LongType())])
    return split.mapInArrow(counted, schema).select(F.col("id").alias(id_column), "n_tokens")
