"""Token counts that follow edits.

The pre-tokens of a document are the leaves of a segment tree, in runs; every node holds the sums of characters and
tokens below it. Trees are a table, a row per document: the text, sizes and counts of its pre-tokens, where its runs
end, and the sums of all nodes. ``plant`` makes it, ``apply_edits`` takes it and gives the trees of the documents that
were edited; a further batch of edits starts from these, and reads and encodes no other document.

An edit finds the leaves it touches by a descent on character sums, takes one pre-token more of
context where a boundary could depend on the edited place, splits the text again from there until a boundary falls on an
old one, and encodes the new pre-tokens only. The sums on the paths of the changed runs are then brought up to date.
Runs that no edit touches stay slices of what was read.

What makes that exact: the splitting pattern has no look-behind, so from a boundary on the split depends on the text
after it alone; and a pre-token that ends at ``e`` depends on no character behind ``e + 1``.

Defined cases: a null text is an empty one; null edits are none; positions are in code points of the text as it is when
the edit's turn comes, and are moved into the text where they lie outside; repeated rows are counted once each, and each
gets all edits of its id; edits without a tree are left out; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import STEP_BYTES, id_type, map_steps, narrow, parts
from tallywire.llm.bpe import Remembered, splitter, vocabulary
from tallywire.llm.shared import written

#: Pre-tokens in a run when the tree is built; a run may grow to four times that before the tree is built again.
RUN = 64
#: Counts of pre-tokens that a worker remembers in a generation.
REMEMBERED = 400_000


def node_sums(leaves: np.ndarray) -> np.ndarray:
    """Sums of a segment tree over leaves: node 1 is the root, 2n and 2n + 1 are below n."""
    width = 1 << max(0, (len(leaves) - 1).bit_length())
    out = np.zeros(2 * width, dtype=np.int64)
    out[width : width + len(leaves)] = leaves
    while width > 1:
        out[width // 2 : width] = out[width : 2 * width : 2] + out[width + 1 : 2 * width : 2]
        width //= 2
    return out


class CountTree:
    """Pre-tokens of one text with their token counts, under sums of characters and tokens."""

    def __init__(self, split, count):
        self.split, self.count, self.encoded = split, count, 0

    @classmethod
    def planted(cls, text: str, split, count) -> CountTree:
        tree = cls(split, count)
        pieces = split(text)
        tree.encoded = n = len(pieces)
        tree._grow(text, np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(count, pieces), np.int32, n))
        return tree

    def _grow(self, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        starts = np.arange(0, max(1, len(sizes)), RUN)
        sums = [np.add.reduceat(x, starts, dtype=np.int64) if len(x) else np.zeros(1, np.int64) for x in (sizes, counts)]
        self.load(text, sizes, counts, np.append(starts[1:], len(sizes)).astype(np.int32), node_sums(sums[0]), node_sums(sums[1]))

    def load(self, text: str, sizes: np.ndarray, counts: np.ndarray, run_ends: np.ndarray, chars: np.ndarray, tokens: np.ndarray) -> CountTree:
        """Take over what ``state`` returned: nothing is split, encoded or summed again."""
        self.raw, self.sizes, self.counts, self.run_ends = text, sizes, counts, run_ends
        self.n_runs, self.width = len(run_ends), len(chars) // 2
        self.chars, self.tokens = chars.tolist(), tokens.tolist()
        self.begins = np.cumsum(np.append(0, chars[self.width : self.width + self.n_runs])).tolist()
        self.changed: dict[int, list[tuple[str, int]]] = {}
        return self

    def run(self, r: int) -> list[tuple[str, int]]:
        """The pre-tokens of a run, with their counts."""
        if r not in self.changed:
            first, last = int(self.run_ends[r - 1]) if r else 0, int(self.run_ends[r])
            stops = list(accumulate(self.sizes[first:last].tolist(), initial=self.begins[r]))
            pieces = [self.raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]
            self.changed[r] = list(zip(pieces, self.counts[first:last].tolist(), strict=True))
        return self.changed[r]

    def state(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, sizes, counts, ends of runs, sums of characters, sums of tokens."""
        if self.changed:
            texts, sizes, counts, at = [], [], [], 0
            for r in sorted(self.changed):
                first = int(self.run_ends[r - 1]) if r else 0
                texts += [self.raw[self.begins[at] : self.begins[r]], *(p for p, _ in self.changed[r])]
                begin = int(self.run_ends[at - 1]) if at else 0
                sizes += [self.sizes[begin:first], np.array([len(p) for p, _ in self.changed[r]], np.int32)]
                counts += [self.counts[begin:first], np.array([n for _, n in self.changed[r]], np.int32)]
                at = r + 1
            begin = int(self.run_ends[at - 1])
            lengths = np.diff(self.run_ends, prepend=0)
            lengths[list(self.changed)] = [len(x) for x in self.changed.values()]
            text = "".join([*texts, self.raw[self.begins[at] :]])
            sizes, counts = np.concatenate([*sizes, self.sizes[begin:]]), np.concatenate([*counts, self.counts[begin:]])
            self.load(text, sizes, counts, np.cumsum(lengths).astype(np.int32), np.array(self.chars), np.array(self.tokens))
        return self.raw, self.sizes, self.counts, self.run_ends, np.array(self.chars), np.array(self.tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _update(self, r: int) -> None:
        node, run = self.width + r, self.run(r)
        chars, tokens = sum([len(p) for p, _ in run]) - self.chars[node], sum([n for _, n in run]) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def _update_all(self, runs: set[int]) -> None:
        for r in runs:
            self._update(r)

    def _find(self, position: int) -> tuple[int, int, int]:
        """Run, index and begin of the first pre-token that ends at ``position`` or behind it; past the last one, if none."""
        node, begin = 1, 0
        if position > self.length:
            last = self.n_runs - 1
            return last, len(self.run(last)), self.length
        while node < self.width:
            node *= 2
            if begin + self.chars[node] < position:
                begin += self.chars[node]
                node += 1
        r = min(node - self.width, self.n_runs - 1)
        for k, (piece, _) in enumerate(self.run(r)):
            if begin + len(piece) >= position:
                return r, k, begin
            begin += len(piece)
        return r, len(self.run(r)), begin

    def _from(self, r: int, k: int):
        while r < self.n_runs:
            for j in range(k, len(self.run(r))):
                yield r, j, self.run(r)[j]
            r, k = r + 1, 0

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        r, k, begin = self._find(start - 1)
        kept, old_end = start - begin, end - begin  # within the window
        old = self._from(r, k)
        window, taken, ends, whole = "", [], [], False
        need = old_end + 2
        while True:
            while len(window) < need:
                step = next(old, None)
                if step is None:
                    whole = True
                    break
                window += step[2][0]
                taken.append(step)
                ends.append(len(window))
            fresh = window[:kept] + replacement + window[old_end:]
            moved = len(replacement) - (old_end - kept)
            pieces = self.split(fresh)
            stops = list(accumulate(map(len, pieces)))
            boundaries = {0, *ends} if old_end == 0 else set(ends)
            # the first new boundary behind the edit that is an old one, and that nothing behind the window could change
            used = next((i for i, p in enumerate(stops) if p - moved >= old_end and p - moved in boundaries and (whole or p + 1 < len(fresh))), None)
            if used is not None:
                stop, pieces = stops[used] - moved, pieces[: used + 1]
                break
            if whole:
                stop = len(window)
                break
            need = 2 * max(need, len(window), 16)
        counted = list(zip(pieces, map(self.count, pieces), strict=True))
        self.encoded += len(pieces)
        gone = [x for x, e in zip(taken, ends, strict=True) if e <= stop]
        by_run: dict[int, list[int]] = {}
        for run, j, _ in gone:
            by_run.setdefault(run, []).append(j)
        for run, js in by_run.items():
            del self.run(run)[js[0] : js[-1] + 1]
        self.run(r)[k:k] = counted
        if len(self.run(r)) > 4 * RUN:
            self._update_all({r, *by_run})
            self._grow(*self.state()[:3])
        else:
            self._update_all({r, *by_run})

    def text(self) -> str:
        return self.state()[0]


EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
#: Columns of a tree beside the id.
TREE = "text string, sizes binary, counts binary, run_ends binary, chars binary, tokens binary"
COUNTS = ["n_pieces", "n_tokens", "edited_tokens", "edited_chars", "encoded_again"]


@functools.cache
def _counter(ranks_path: str, pattern: str):
    """Splits a text into pre-tokens; counts the tokens of one. Made once in each Python worker."""
    return splitter(pattern).findall, Remembered(vocabulary(ranks_path).n_ids, REMEMBERED).__getitem__


def packed(values: np.ndarray) -> bytes:
    """A byte for each number if that is enough, else little-endian 64-bit numbers; the first byte tells which."""
    small = not len(values) or values.max() < 256
    return (b"\1" if small else b"\x08") + values.astype("u1" if small else "<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="u1" if raw[0] == 1 else "<i8", offset=1).astype(np.int64)


def _tree_columns(trees: list[CountTree]) -> dict:
    states = [t.state() for t in trees]
    return {"text": [s[0] for s in states]} | {n: [packed(s[i]) for s in states] for i, n in enumerate(("sizes", "counts", "run_ends", "chars", "tokens"), 1)}


def plant(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segment tree of each document: the id column, text (null: empty), and as ``packed`` numbers sizes, counts, run_ends,
    chars, tokens."""
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), *T._parse_datatype_string(TREE)])

    def work(ids, texts):
        split, count = _counter(ranks_path, pattern)
        return {id_col: ids} | _tree_columns([CountTree.planted(t or "", split, count) for t in texts])

    return map_steps(narrow(docs, id=id_col, text=text_col), work, schema)


def edits_by_document(edits: DataFrame, *, id_col: str = "doc_id", order_col: str = "edit") -> DataFrame:
    """(id, edits) of a table of edits (id, order, start, end, replacement), in order; ties go by start, end, replacement."""
    one = F.struct(F.col(f"`{order_col}`").alias("o"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("replacement").alias("replacement"))
    ordered = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement")))
    return edits.groupBy(F.col(f"`{id_col}`")).agg(ordered.alias("edits"))


def apply_edits(trees: DataFrame, edits: DataFrame | Column, ranks_path: str, pattern: str, *, id_col: str = "doc_id", keep_trees: bool = False) -> DataFrame:
    """Token counts of trees after edits, applied in order.

    ``edits`` is a table (id, edits) as ``edits_by_document`` makes it, which picks the documents that are read, or a
    column of such arrays over the trees, one for every document. Returns the id column, n_pieces and n_tokens of the
    text before, edited_tokens, edited_chars, and encoded_again: the pre-tokens that edits made the counter encode; with
    ``keep_trees`` also the columns of the tree, which take the place of the old ones.
    """
    names = T._parse_datatype_string(TREE).names
    tree = [F.col(c) for c in names]
    if isinstance(edits, Column):
        frame = trees.select(F.col(f"`{id_col}`").alias("id"), *tree, edits.cast(EDITS).alias("edits"))
    else:
        chosen = edits.select(F.col(f"`{id_col}`").alias("_id"), F.col("edits").cast(EDITS).alias("edits"))
        frame = trees.join(chosen, F.col(f"`{id_col}`").eqNullSafe(F.col("_id"))).select(F.col(f"`{id_col}`").alias("id"), *tree, "edits")
    schema = T.StructType([T.StructField(id_col, id_type(trees, id_col)), *[T.StructField(n, T.LongType()) for n in COUNTS]])
    if keep_trees:
        schema = T.StructType([*schema, *T._parse_datatype_string(TREE)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        split, count = _counter(ranks_path, pattern)
        for part in (part for batch in batches for part in parts(batch, STEP_BYTES)):
            arrays = [c.to_pylist() for c in part.columns[2:7]]
            done, rows = [], []
            for i, (text, script) in enumerate(zip(part.column(1).to_pylist(), part.column(7).to_pylist(), strict=True)):
                grown = CountTree(split, count).load(text, *(unpacked(a[i]) for a in arrays))
                before = len(grown.sizes), grown.total
                for e in script or ():
                    if e is not None:
                        grown.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                rows.append((*before, grown.total, grown.length, grown.encoded))
                done += [grown] if keep_trees else []
            columns = dict(zip(COUNTS, zip(*rows, strict=True), strict=True)) | (_tree_columns(done) if keep_trees else {})
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(columns[f.name], type=f.type) for f in list(arrow)[1:]]], schema=arrow)

    return frame.mapInArrow(run, schema)


def sample_edits(text: Column) -> Column:
    """The edits of the query: 24 code points a third into the text in capitals, seven deleted at half of it, a phrase put
    in at its begin, another at its end."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    third, half = F.floor(n / 3), F.floor(n / 2)
    make = lambda a, b, s: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), s.alias("replacement"))
    return F.array(
        make(third, third + 24, F.upper(F.substring(text, (third + 1).cast("int"), F.lit(24)))),
        make(half, half + 7, F.lit("")),
        make(F.lit(0), F.lit(0), F.lit("It's 12 o'clock:\n ")),
        make(n + 1000, n + 1000, F.lit("  -- the end")),
    )


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    trees = written(plant(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), "trees", "zstd")
    return apply_edits(trees, sample_edits(F.col("text")), path, public_tokenizers.PATTERN)
