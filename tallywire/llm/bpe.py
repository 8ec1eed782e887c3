"""Byte-level BPE by two tiers of lookup.

A pre-token that is a vocabulary entry as a whole is resolved by a minimal perfect hash over the vocabulary. Any other
is merged over a doubly linked list of its bytes, where a heap gives the pair of least rank, leftmost first.

Defined cases: null and empty texts give no ids; texts of any length are encoded whole; repeated rows are encoded
once each; special-token strings are ordinary text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import id_type, map_steps, narrow


class PerfectHash:
    """A minimal perfect hash: n keys to the slots 0..n-1, by a pair of displacements for each bucket of keys.

    A bucket for which no displacement is left, or two keys of one 64-bit hash, make the construction start again under
    the next seed. Repeated keys are refused.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4, seeds: int = 10_000):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.n = len(keys)
        self.buckets = self.n // per_bucket + 1
        if not any(self._place(keys, seed) for seed in range(seeds)):
            raise ValueError("no displacement found")

    def _place(self, keys: list[bytes], seed: int) -> bool:
        n, self.seed = self.n, seed
        hashes = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != n:
            return False
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        first = ((hashes >> np.uint64(20)) % np.uint64(max(1, n))).astype(np.int64)
        second = ((hashes >> np.uint64(42)) % np.uint64(max(1, n - 1))).astype(np.int64) + 1
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift, self.step = [0] * self.buckets, [0] * self.buckets
        self.slot_key = np.full(n, -1, dtype=np.int64)
        free = np.ones(2 * n, dtype=bool)  # twice over, so that a rotation is a slice
        for b in np.argsort(-np.diff(starts), kind="stable").tolist():
            members = order[starts[b] : starts[b + 1]]
            if not len(members):
                break
            for step in range(n):
                at = (first[members] + step * second[members]) % n
                if len(set(at.tolist())) < len(members):
                    continue
                fits = free[at[0] : at[0] + n].copy()
                for x in at[1:]:
                    fits &= free[x : x + n]
                shift = int(fits.argmax())
                if fits[shift]:
                    break
            else:
                return False
            self.shift[b], self.step[b] = shift, step
            slots = (at + shift) % n
            self.slot_key[slots] = members
            free[slots] = free[slots + n] = False
        return True

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for what is no key; -1 without keys."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        b = h % self.buckets
        return ((h >> 20) % self.n + self.step[b] * ((h >> 42) % max(1, self.n - 1) + 1) + self.shift[b]) % self.n


#: Bytes of the longest piece that is counted without a heap, and the rank of what is no entry.
SCANNED_BYTES, NO_RANK = 32, 1 << 62


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.slot_token = [tokens[i] for i in self.hash.slot_key.tolist()]
        self.slot_rank = [self.ranks[t] for t in self.slot_token]
        self.token = {r: t for t, r in self.ranks.items()}

    @functools.cached_property
    def two_bytes(self) -> list[int]:
        """Rank of each two bytes."""
        return [self.ranks.get(bytes((a, b)), NO_RANK) for a in range(256) for b in range(256)]

    def whole(self, piece: bytes) -> int | None:
        slot = self.hash.slot(piece)
        return self.slot_rank[slot] if slot >= 0 and self.slot_token[slot] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: merge linked bytes, least rank first and leftmost among equals.

        A node is known by its start; ``end`` links to the next node, ``before`` to the last one. A heap entry packs
        rank, start and stop in an integer, and is stale unless node and next node still span start to stop.
        """
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 2)), list(range(-1, n))
        bits = n.bit_length() + 1
        wide, mask = 2 * bits, (1 << bits) - 1
        heap = [rank << wide | i << bits | i + 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, stop = entry >> bits & mask, entry & mask
            mid = end[i]
            if mid >= stop or end[mid] != stop:
                continue
            end[mid] = n + 2  # no longer a node
            end[i] = stop
            if stop < n:
                before[stop] = i
                rank = get(piece[i : end[stop]])
                if rank is not None:
                    push(heap, rank << wide | i << bits | end[stop])
            if i:
                left = before[i]
                rank = get(piece[left:stop])
                if rank is not None:
                    push(heap, rank << wide | left << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.whole(raw)
        return [rank] if rank is not None else self.merge(raw)

    def n_ids(self, piece: str) -> int:
        """How many ids a piece has. Of few bytes the least pair is found by looking through all of them."""
        raw, get = piece.encode("utf-8", "surrogatepass"), self.ranks.get
        if raw in self.ranks:
            return 1
        if not 2 <= len(raw) <= SCANNED_BYTES:
            return len(self.merge(raw))
        at = list(range(len(raw) + 1))
        two = self.two_bytes
        pairs = [two[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        while (least := min(pairs)) != NO_RANK:
            k = pairs.index(least)  # the leftmost among equals
            del at[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = get(raw[at[k] : at[k + 2]], NO_RANK)
            if k:
                pairs[k - 1] = get(raw[at[k - 1] : at[k + 1]], NO_RANK)
        return len(at) - 1


#: Code points of the longest pre-token that is remembered: longer ones are computed each time.
REMEMBERED_CHARS = 64


class Remembered(dict):
    """Values by text, computed on a miss. Two generations of at most ``most`` short keys: what is used stays, memory is
    bounded."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(key) > REMEMBERED_CHARS:
            return self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Read and hashed once in each Python worker."""
    return Vocabulary(path)


@functools.cache
def piece_ids(path: str, most: int = 250_000) -> Remembered:
    return Remembered(vocabulary(path).ids, most)


@functools.cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text of ``docs`` as ids: the id column and ids array<int>."""
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def work(ids, texts):
        import pyarrow as pa

        known, find = piece_ids(ranks_path), splitter(pattern).findall
        flat, ends = [], [0]
        for text in texts:
            if text:
                flat.extend(chain.from_iterable(map(known.__getitem__, find(text))))
            ends.append(len(flat))
        return {id_col: ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))}

    return map_steps(narrow(docs, id=id_col, text=text_col), work, schema)


def decode(frame: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to a frame of ids; null ids decode to null, unknown ids raise."""
    schema = T.StructType([frame.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        token = vocabulary(ranks_path).token
        for batch in batches:
            ids = batch.column(1)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            texts = [b"".join(map(token.__getitem__, flat[a:b].tolist())) if k else None for a, b, k in zip(ends, ends[1:], known, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], names=schema.names)

    return narrow(frame, **{id_col: id_col, "ids": ids_col}).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
