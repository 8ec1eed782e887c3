"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

A task tokenises its rows, gathers them into blocks of a fixed number of windows, and packs each block on its own:

* a document of several windows gives whole windows first; what is left over is one item;
* items start as partitions with one filled slot; the two partitions with the largest imbalance are merged, the
  fullest slot of one with the emptiest of the other, until one partition of near-equal windows remains;
* when a window exceeds the capacity, the count rises and the block is packed again, until every window holds;
* whole items stay like that. Items that may be cut do so only to take the padding out: the smallest windows, as many as
  the rise was more than the tokens need, are dealt out into the room that the others have left.

Nothing is shuffled and no state outlives a block, so memory is bounded by a block and a lost task is simply run again.

Defined cases: a null text is an empty one (one closing id); repeated rows are packed once each; an empty table gives
no pieces; ties between equal sizes follow the order of rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import STEP_BYTES, id_type, narrow, parts

CAPACITY = 4096
#: Windows in a block: enough for near-equal sums, few enough for small merges.
BLOCK_WINDOWS = 64
#: Code points of the longest chunk that is remembered.
REMEMBERED_CHARS = 64


class ChunkIds:
    """Ids of texts under a tokenizer whose tokens never span a blank: each chunk between blanks is encoded once.

    Texts of plain Latin letters are lower-cased first, and a stop or comma between a letter and a blank is set apart,
    so that a word has one entry whatever its case and place; new words are encoded together, a blank between each two.
    Any other text or chunk (other scripts, combining marks, special tokens) is encoded by the tokenizer as it stands.
    """

    def __init__(self, path: str, most: int = 900_000):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path) as f:
            form = json.load(f)
        parts = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = parts[0].get("pattern", {}).get("Regex")
        # chunks stand for themselves only if the text is lower-cased and split by a pattern that drops blanks
        steps = (form.get("normalizer") or {}).get("normalizers") or [form.get("normalizer") or {}]
        splits = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
        self.chunked = bool(pattern and splits and any(s.get("type") == "Lowercase" for s in steps))
        self.pieces = regex.compile(pattern or ".").findall
        self.plain = regex.compile(r"[!-~\u00c0-\u012f\u0131-\u017e]*+").fullmatch
        self.plain_text = regex.compile(r"[\n -~\u00c0-\u012f\u0131-\u017e]*+").fullmatch
        self.run = re.compile(r"[!-/:-@\[-`{-~][.,][ \n]").search
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        self.long += [w for w in words if len(w) > REMEMBERED_CHARS]
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.searchsorted(np.array(got.word_ids), np.arange(len(some)), side="right") * 4
            raw, begin = np.array(got.ids, dtype="<u4").tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.known[word] = raw[begin:end]
                begin = end

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) + len(chunks) > self.most:
            self.old, self.known = self.known, {}
        known, old, plain, words, cut = self.known, self.old, self.plain, [], {}
        for c in chunks.difference(known):
            if len(c) > REMEMBERED_CHARS:
                self.long.append(c)
            if c in old:
                known[c] = old[c]
            elif c.isalpha() and c.islower() and plain(c):  # a word as it stands
                words.append(c)
            elif plain(c) and "<|" not in c:
                cut[c] = self.pieces(c.lower())
            else:
                known[c] = self._alone(c)
        self._learn_words(words)
        self._learn_words([w for w in set().union(*cut.values()) if w not in known])
        for c, parts in cut.items():
            known[c] = b"".join([known[w] for w in parts])

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        blank = text.replace("\n", " ")
        if self.plain_text(text) and not self.run(text) and "<|" not in text:
            blank = blank.lower().replace(", ", " , ").replace(". ", " . ")
        return blank.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.chunked:
            return [self._alone(t or "") for t in texts]
        cut = [self._chunks(t) for t in texts]
        self.learn(set().union(*cut))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for long in self.long:
            self.known.pop(long, None)
        self.long.clear()
        return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for k windows: the items (by index) of each window."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # a partition: its filled slots in falling order of sum, each (sum less the smallest of all k, items as nested pairs)
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    n, by_sum = len(sizes), itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(b)  # the fullest slots of one meet the emptiest of the other, which are empty as far as that
        if len(a) <= free:
            merged = a + b
        else:
            both = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[free:], reversed(b[k - len(a) :]), strict=True)]
            merged = a[:free] + b[: k - len(a)] + both
        merged.sort(key=by_sum, reverse=True)
        if len(merged) == k and (least := merged[-1][0]):
            merged = [(x - least, p) for x, p in merged]
        heapq.heappush(heap, (-merged[0][0], n, merged))
        n += 1
    windows = [_leaves(p) for _, p in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)
    return sorted(out)


def whole_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of uncut items, none larger than the capacity; the count rises until every window holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity or len(w) == 1 for w in windows):
            return [w for w in windows if w]
        k += max(1, k // 64)


def cut_windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length). All are full but for what is left over in the end, which
    is cut into windows whose lengths are powers of two, so that no window has any padding."""
    out, items = [], []
    for i, size in enumerate(sizes):
        whole = size // capacity
        out += [[(i, j * capacity, capacity)] for j in range(whole)]
        if size > whole * capacity:
            items.append((i, whole * capacity, size - whole * capacity))
    if not items:
        return out
    rest = [x[2] for x in items]
    windows = [[items[i] for i in w] for w in whole_windows(rest, capacity)]
    windows.sort(key=lambda w: -sum(x[2] for x in w))
    full = sum(rest) // capacity
    windows, spare = windows[:full], [x for w in windows[full:] for x in w]  # pieces without a window

    def fill(w: list[tuple[int, int, int]], room: int) -> None:
        while room:
            i, start, n = spare.pop()
            if n > room:
                spare.append((i, start + room, n - room))
                n = room
            w.append((i, start, n))
            room -= n

    for w in windows:
        fill(w, capacity - sum(x[2] for x in w))
    left = sum(x[2] for x in spare)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        windows.append(w := [])
        fill(w, room)
    return out + windows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    closing_id: int = 2,
    block_windows: int = BLOCK_WINDOWS,
    cut: bool = True,
) -> DataFrame:
    """Pack every document of ``docs`` into windows.

    Returns a row per piece: the id column, start, length, ids (binary, little-endian unsigned 32-bit ids of the
    piece), doc_tokens, sequence_id, offset. ``cut=False`` keeps documents whole: those above the capacity get a
    window of their own, and the window count rises until all others fit. ``sequence_id`` is unique, not gapless: its
    high part is the number of the task, so it depends on how the input is split, as the windows do.
    """
    frame = narrow(docs, id=id_col, text=text_col)
    schema = T.StructType(
        [T.StructField(id_col, id_type(docs, id_col))]
        + [T.StructField(c, T.LongType()) for c in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )
    block = block_windows * capacity
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        ids_of = ChunkIds(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[object, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, tokens
            sizes = [len(raw) // 4 for _, raw in held]
            if cut:
                windows = cut_windows(sizes, capacity)
            else:
                windows = [[(i, 0, sizes[i]) for i in w] for w in whole_windows(sizes, capacity)]
            columns: list[list] = [[] for _ in schema]
            for w in windows:
                offset = 0
                for i, start, n in w:
                    key, raw = held[i]
                    for column, value in zip(columns, (key, start, n, raw[4 * start : 4 * (start + n)], sizes[i], number, offset), strict=True):
                        column.append(value)
                    offset += n
                number += 1
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in parts(batch, STEP_BYTES):
                for key, raw in zip(part.column(0).to_pylist(), ids_of.encode(part.column(1).to_pylist()), strict=True):
                    held.append((key, raw + closing))
                    tokens += len(raw) // 4 + 1
                    if tokens >= block:
                        yield flush()
        if held:
            yield flush()

    return frame.mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
