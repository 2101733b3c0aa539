"""Training-order materialisation: a keyed permutation gives every sequence its slot in fixed-stride binary shards.

A Feistel network over the smallest even number of bits that holds all sequences permutes their numbers; a result outside
is permuted again until it falls inside (cycle-walking). So slots need no sort and no table, and the number of the
sequence in a slot can be computed back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, map_rows, projected, shared_folder
from .tokens import vocabulary, word_tokens

ROUNDS = 6
#: Write tasks at most; more shards are written one after the other by the same task.
MAX_RANGES = 100_000
#: Slots of a written shard that are read back together.
READ_SLOTS = 4096


@dataclass(frozen=True)
class Permutation:
    """Bijection of ``0 .. size - 1`` chosen by ``key``; works on numpy arrays."""

    size: int
    key: int

    @property
    def half(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[int]:
        import hashlib

        # Digits are taken from a digest of key and round, so that neighbouring keys have nothing in common.
        return [
            int.from_bytes(hashlib.blake2b(f"{self.key}:{i}".encode(), digest_size=8).digest(), "little")
            for i in range(ROUNDS)
        ]

    def _mixed(self, x: np.ndarray, key: int) -> np.ndarray:
        """A round function: multiply, xor and shift; it need not be invertible."""
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & low
        for key in reversed(self._keys()) if back else self._keys():
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << bits) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers).astype(np.uint64)
        if len(x) and int(x.max()) >= self.size:
            raise ValueError("a number is outside the permutation")
        x = self._once(x, back)
        while len(out := np.flatnonzero(x >= np.uint64(self.size))):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, back=False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, back=True)


@dataclass(frozen=True)
class Layout:
    """Slots of ``stride`` ids, two bytes each, ``per_shard`` slots in a file; a slot is filled up with ``pad``."""

    stride: int = 256
    per_shard: int = 1 << 16
    pad: int = 0xFFFF

    @property
    def slot_bytes(self) -> int:
        return 2 * self.stride

    def pieces(self, n_ids: int) -> int:
        return max(1, -(-n_ids // self.stride))


def materialised(
    documents: DataFrame,
    key: int = 42,
    folder: str | None = None,
    tokenizer: str | None = None,
    layout: Layout = Layout(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Writes all sequences into shards; ``doc_id, piece, slot, shard, byte_offset, n_ids, ids_crc32`` of each.

    Sequences are a document's ids in pieces of at most ``stride``; null and empty texts are one empty sequence. Documents
    are encoded once, into a compressed table in the shared folder, whose rows carry their number within their partition;
    the sizes of the partitions, one row each, give the first number of each. Sequences then move once, those of a task
    and a shard as one compressed row, to the range of shards that holds their slot. Each shard is put together in memory,
    written by one task under a name of its own and renamed, so a task that runs again or twice leaves the same file. Rows
    come back as read from the written shards. Repeated rows and null ids are sequences like any other. An empty table
    writes no shard and gives no rows.
    """
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    path = tokenizer or vocabulary()
    kind = dict(documents.dtypes)[id_column]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokens, part, first = word_tokens(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1))):
                if len(ids) and int(ids.max()) >= layout.pad:
                    raise ValueError("ids do not fit two bytes")
                yield part, first, doc_id, ids.astype("<u2").tobytes()
                first += layout.pieces(len(ids))

    given = projected(documents, doc_id=id_column, text=text_column)
    encoded = durable(
        map_rows(given, encode, f"part int, first bigint, doc_id {kind}, ids binary", arrow_in=True), compression="zstd"
    )
    pieces = F.greatest(F.lit(1), F.ceil(F.length("ids") / layout.slot_bytes))
    sizes = encoded.groupBy("part").agg(F.max(F.col("first") + pieces).alias("n")).collect()
    firsts, total = {}, 0
    for part, n in sorted(map(tuple, sizes)):
        firsts[part], total = total, total + n
    # One number for each partition, however many tasks read them.
    held = spark.sparkContext.broadcast(firsts)
    order, shards = Permutation(max(1, total), key), -(-total // layout.per_shard)

    dealt = map_batches(
        encoded,
        lambda batches: _dealt(batches, held.value, order, layout),
        f"shard bigint, slots array<bigint>, doc_ids array<{kind}>, pieces array<int>, sizes array<int>, ids binary",
    )
    # Ranges are computed, not sampled: a range holds whole shards that follow one another.
    ranges = max(1, min(shards, MAX_RANGES))
    placed = dealt.repartitionById(ranges, F.floor(F.col("shard") * ranges / max(1, shards)).cast("int"))
    return map_batches(
        placed.sortWithinPartitions("shard"),
        lambda batches: _written(batches, folder, total, layout),
        f"doc_id {kind}, piece int, slot bigint, shard bigint, byte_offset bigint, n_ids bigint, ids_crc32 bigint",
    )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places ``start .. start + size - 1`` of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _dealt(
    batches: Iterator[pa.RecordBatch], firsts: dict[int, int], order: Permutation, layout: Layout
) -> Iterator[list]:
    """For each batch and shard one row with all sequences of the batch that belong there."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        if not batch.num_rows:
            continue
        part, first, doc_ids, ids = batch.columns
        base = np.array([firsts[p] for p in part.to_pylist()], dtype=np.int64) + first.to_numpy()
        bytes_of = pc.binary_length(ids).to_numpy().astype(np.int64)
        flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<u2")
        count = np.maximum(1, -(-bytes_of // layout.slot_bytes))
        document = np.repeat(np.arange(len(count)), count)
        piece = _ranges(np.zeros_like(count), count)
        numbers = base[document] + piece
        begin = (np.cumsum(bytes_of) - bytes_of)[document] // 2 + piece * layout.stride
        size = np.minimum(bytes_of[document] // 2 - piece * layout.stride, layout.stride)
        slots = order.slots(numbers)
        by_slot = np.argsort(slots)
        slots, size, piece = slots[by_slot], size[by_slot], piece[by_slot]
        moved = flat[_ranges(begin[by_slot], size)]
        owners = doc_ids.take(pa.array(document[by_slot]))
        shard = slots // layout.per_shard
        starts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1))
        bounds = pa.array(np.append(starts, len(shard)), pa.int32())
        ends = np.concatenate(([0], np.cumsum(size)))[bounds.to_numpy()].tolist()

        def lists(values) -> pa.Array:
            return pa.ListArray.from_arrays(bounds, values)

        pressed = [press.compress(moved[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield [shard[starts], *map(lists, (slots, owners, piece, size)), pressed]


def shard_path(folder: str, shard: int) -> tuple[pyarrow.fs.FileSystem, str]:
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    return files, f"{root.rstrip('/')}/shard-{shard:08d}.bin"


def _written(batches: Iterator[pa.RecordBatch], folder: str, total: int, layout: Layout) -> Iterator[list]:
    """Puts the shards of one task together, one at a time, writes them and gives what is read from them."""
    unpress = zstandard.ZstdDecompressor()
    rows = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
    for shard, given in groupby(rows, key=lambda row: row.column(0)[0].as_py()):
        first = shard * layout.per_shard
        filled = np.full((min(layout.per_shard, total - first), layout.stride), layout.pad, dtype="<u2")
        owner = np.full(len(filled), -1, dtype=np.int64)
        doc_ids, pieces, known = [], [], 0
        for row in given:
            slots, own, piece, size = (row.column(i).flatten() for i in range(1, 5))
            place, size = slots.to_numpy() - first, size.to_numpy()
            ids = np.frombuffer(unpress.decompress(row.column(5)[0].as_py()), dtype="<u2")
            filled[np.repeat(place, size), _ranges(np.zeros_like(size), size)] = ids
            owner[place] = known + np.arange(len(place))
            known += len(place)
            doc_ids.append(own)
            pieces.append(piece)
        if known != len(filled) or (owner < 0).any():
            raise RuntimeError("a slot is empty or filled twice")
        files, name = shard_path(folder, shard)
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        temporary = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(temporary) as out:
            out.write(memoryview(filled).cast("B"))
        files.move(temporary, name)
        order = pa.array(owner)
        doc_ids, pieces = pa.concat_arrays(doc_ids).take(order), pa.concat_arrays(pieces).take(order)
        with files.open_input_stream(name) as stream:
            for at in range(0, len(filled), READ_SLOTS):
                many = min(READ_SLOTS, len(filled) - at)
                read = np.frombuffer(stream.read(many * layout.slot_bytes), dtype="<u2").reshape(many, layout.stride)
                size = (read != layout.pad).sum(axis=1)
                wide = read.astype("<u4")
                crc = [zlib.crc32(memoryview(ids)[:n]) for ids, n in zip(wide, size.tolist())]
                place = at + np.arange(many)
                yield [
                    doc_ids.slice(at, many),
                    pieces.slice(at, many),
                    first + place,
                    np.full(many, shard),
                    place * layout.slot_bytes,
                    size,
                    crc,
                ]


def unpadded(raw: bytes, layout: Layout) -> np.ndarray:
    ids = np.frombuffer(raw, dtype="<u2")
    return ids[ids != layout.pad]


def read_slots(folder: str, first: int, stop: int, layout: Layout = Layout()) -> Iterator[np.ndarray]:
    """Ids of the slots ``first`` to ``stop - 1``, read one after the other: a reader resumes at any slot by seeking."""
    slot = first
    while slot < stop:
        files, name = shard_path(folder, slot // layout.per_shard)
        with files.open_input_file(name) as shard:
            shard.seek(slot % layout.per_shard * layout.slot_bytes)
            for _ in range(min(stop, (slot // layout.per_shard + 1) * layout.per_shard) - slot):
                yield unpadded(shard.read(layout.slot_bytes), layout)
                slot += 1
