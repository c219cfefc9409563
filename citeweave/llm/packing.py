"""Hierarchical residual packing of tokenised documents into sequences.

Round 0 deals items over tasks of bounded size; each task packs its own by
best fit decreasing, emits bins that are nearly full, and keeps the rest as
*residual bins*.  Residual bins are the items of the next round, over fewer
tasks, and so on up the tree until one task has packed all that is left or no
two residual bins fit together.  A bin carries its members (at most
``capacity`` of them), and tasks are dealt by members as well as by bins, so
none holds more than its share of either.

A null text is the empty document (its ids are the end id alone); a null key is
a document like others; equal and repeated rows are separate items; very long
texts are cut into pieces; an empty table gives no sequences; other columns are
dropped.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, texts_of
from ..storage import Store
from .tables import read_table

CAPACITY = 2048
END_ID = 0
ITEMS_PER_TASK = 100_000
#: Members of the bins of a task: bins of very short documents have many.
MEMBERS_PER_TASK = 2_000_000
#: A bin is nearly full, and emitted at once, with at most this many free places.
SLACK = 8
_ENCODERS: dict[tuple[str, str], object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Paths of the public vocabulary: the tokenizers file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as the tokenizers file gives them without special tokens.

    The rank file holds the same vocabulary and its encoder is about half again
    as fast, so it does the work; a text it refuses goes to the other.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.path, self.slow = tokenizer_path, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:
            return self._other(text)
        except BaseException as e:  # the encoder's own panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self._other(text)

    def _other(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(paths: tuple[str, str]) -> Encoder:
    """One encoder per worker process."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be short of ``capacity``."""
    first = total % capacity or capacity
    if total <= capacity:
        return [(0, total)]
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def token_pieces(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    paths = paths or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(paths)
        for b in bounded_slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                ids = np.append(coder.ids(text), END_ID).astype("<u4")
                rows += [(doc, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cut(len(ids), capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins as lists of item indexes.  Ties go to the earlier item and the later bin."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    free_mask, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = free_mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            bin_id = open_bins[free].pop()
            if not open_bins[free]:
                free_mask &= ~(1 << free)
            bins[bin_id].append(i)
        else:
            free, bin_id = capacity, len(bins)
            bins.append([i])
        left = free - size
        if left:
            open_bins[left].append(bin_id)
            free_mask |= 1 << left
    return bins


_BIN = "bin long, fill int, done boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def _pack_round(items: DataFrame, number: int, capacity: int, slack: int) -> DataFrame:
    """Best fit within each partition of (fill, members) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        members = table.column("members").combine_chunks()
        sizes = table.column("fill").to_numpy().astype(np.int64)
        bins = best_fit(sizes, capacity)
        order = pa.array(np.concatenate([np.array(b, np.int64) for b in bins]))
        taken = members.take(order)
        lengths = np.diff(taken.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(b) for b in bins])])]
        fill = np.add.reduceat(sizes[order.to_numpy()], np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]))
        base = (number << 52) | (TaskContext.get().partitionId() << 28)
        joined = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken.flatten())
        whole = pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(bins))), pa.array(fill, pa.int32()), pa.array(fill >= capacity - slack), joined], ["bin", "fill", "done", "members"])
        for at in range(0, whole.num_rows, 8192):
            yield whole.slice(at, 8192)

    return items.select("fill", "members").mapInArrow(run, _BIN)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, slack: int = SLACK) -> DataFrame:
    """Pieces with sequence_id and offset, packed level by level."""
    store = Store(pieces.sparkSession, "packing")
    pieces = store.put(pieces, "pieces")
    members = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32"))
    items = pieces.select(F.col("length").cast("int").alias("fill"), members.alias("members"))
    count, number, finished = items.count(), 0, []
    while count:
        members = items.agg(F.sum(F.size("members"))).first()[0]
        tasks = max(-(-count // items_per_task), -(-members // MEMBERS_PER_TASK))
        packed = store.put(_pack_round(items.repartition(tasks), number, capacity, slack), f"round{number}")
        rest = packed.filter(~F.col("done"))
        left = rest.count()
        finished.append(packed.filter("done"))
        smallest = [r.fill for r in rest.select("fill").orderBy("fill").limit(2).collect()]
        # The root of the tree has packed all there is, or no two residual bins fit together any more.
        if tasks == 1 or left < 2 or sum(smallest) > capacity or left == count:
            finished.append(rest)
            break
        items, count, number = rest, left, number + 1
    if not finished:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins = finished[0]
    for more in finished[1:]:
        bins = bins.unionByName(more)
    ends = F.expr("aggregate(members, array(0L), (a, m) -> concat(a, array(element_at(a, -1) + m.length)))")
    placed = bins.select(F.col("bin").alias("sequence_id"), "members", ends.alias("ends")).select("sequence_id", F.posexplode("members").alias("i", "m"), "ends")
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", F.element_at("ends", F.col("i") + 1).alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenise all documents and pack their pieces."""
    return pack_pieces(token_pieces(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 2048 tokens as the tree of best fits finds."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
