"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints within ``2q + 1`` bits agree, outside one block of bits, up to ``2q`` bits: if they differ at all, take
a block with a differing bit. So for each block every *distinct* fingerprint emits, with that block masked out, all its
variants within ``q`` bits, half the radius. Equal variants meet in a shuffle; what meets is verified on all bits.
The mask takes up the odd bit of the radius: 4 blocks of 16 bits need 196 variants for radius 3, where unmasked balls
of radius 2 would need 2,081. An even radius needs no mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows, plain_words, projected
from .components import components

SEED = 42
BITS = 64
BLOCKS = 4
#: Buckets up to this size are compared by shifted copies of one array; larger ones by variants within the bucket.
DENSE = 64
#: Buckets over this size are dealt to several tasks before.
SPLIT = 16_384
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """Bit set if set in over half the shingle hashes; fewer words: the whole sequence; none: zero."""
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    # Bits are summed in slices, so that a very long text needs no 64-fold copy of itself.
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, fingerprint`` (signed long with the 64 bits) of each row. Null and empty texts get zero."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, key in given:
            value = fingerprint(plain_words(text.translate(_LOWER)) if text else [], shingle)
            yield doc_id, key, value - ((value >> (BITS - 1)) << BITS)

    kind = dict(documents.dtypes)[id_column]
    keyed = projected(documents, doc_id=id_column, text=text_column).withColumn("text_key", F.xxhash64("text"))
    return map_rows(keyed, rows, f"doc_id {kind}, text_key bigint, fingerprint bigint")


def _balls(radius: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    """For each block the mask of the other bits, and the flips of up to ``radius // 2`` of them."""
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)] if radius % 2 else [0, 0]
    found = []
    for low, high in zip(bounds, bounds[1:]):
        free = [b for b in range(BITS) if not low <= b < high]
        flips = [sum(1 << b for b in c) for n in range(radius // 2 + 1) for c in combinations(free, n)]
        found.append((sum(1 << b for b in free), np.array(flips, dtype=np.uint64)))
    return found


def variants(distinct: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """``block, variant, fingerprint``: all variants of each fingerprint within half the radius, by masked block."""
    balls = _balls(radius, blocks)
    schema = pa.schema([("block", pa.int8()), ("variant", pa.int64()), ("fingerprint", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for block, (mask, flips) in enumerate(balls):
                step = max(1, (1 << 18) // len(flips))
                for at in range(0, len(values), step):
                    part = values[at : at + step]
                    keys = ((part & np.uint64(mask))[:, None] ^ flips[None, :]).reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), block, dtype=np.int8)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.repeat(part, len(flips)).view(np.int64)),
                        ],
                        schema=schema,
                    )

    return distinct.select("fingerprint").mapInArrow(emit, "block tinyint, variant bigint, fingerprint bigint")


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within one large bucket that connect all that are within the radius: at most one link for each value.

    Linear in the bucket: each value is looked up under the variants of a second, finer family of balls, and only the
    first value found under a variant within the radius is linked to, unless both are already connected.
    """
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    near, far = (
        np.array([sum(1 << b for b in c) for n in range(r + 1) for c in combinations(range(BITS), n)], dtype=np.uint64)
        for r in (radius // 2, radius - radius // 2)
    )
    # y within `far` of v and x within `near` of v are within the radius: no pair needs to be written out.
    step = max(1, (1 << 20) // len(near))
    keys, owners = [], []
    for at in range(0, len(values), step):
        part = values[at : at + step]
        keys.append((part[:, None] ^ near[None, :]).reshape(-1))
        owners.append(np.repeat(np.arange(at, at + len(part)), len(near)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    heads, head_owner = key[first], owner[first]
    # All owners of one variant are connected through its first owner: two balls of radius `near` meet there.
    pairs = [np.stack([np.repeat(head_owner, np.diff(np.append(np.flatnonzero(first), len(key)))), owner], axis=1)]
    for at in range(0, len(values), max(1, (1 << 20) // len(far))):
        part = values[at : at + max(1, (1 << 20) // len(far))]
        wide = (part[:, None] ^ far[None, :]).reshape(-1)
        place = np.searchsorted(heads, wide)
        place[place == len(heads)] = 0
        met = heads[place] == wide
        pairs.append(np.stack([head_owner[place[met]], np.repeat(np.arange(at, at + len(part)), len(far))[met]], axis=1))
        if len(pairs) > 8 or at + len(part) >= len(values):
            for a, b in np.unique(np.concatenate(pairs), axis=0).tolist():
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((a, b))
            pairs = []
    return links


def _runs(block: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal (block, variant) in sorted arrays."""
    change = (block[1:] != block[:-1]) | (variant[1:] != variant[:-1])
    starts = np.concatenate(([0], np.flatnonzero(change) + 1))
    return starts, np.diff(np.append(starts, len(block)))


def _bucket_links(
    value: np.ndarray, starts: np.ndarray, lengths: np.ndarray, radius: int, dense: int, split: int | None
) -> Iterator[np.ndarray]:
    """Verified links ``(n, 2)`` within the runs of up to ``split`` values."""
    run, size = np.repeat(np.arange(len(starts)), lengths), np.repeat(lengths, lengths)
    for shift in range(1, int(min(lengths.max(), dense))):
        at = np.flatnonzero((run[shift:] == run[:-shift]) & (size[shift:] <= dense))
        a, b = value[at], value[at + shift]
        close = np.bitwise_count(a ^ b) <= radius
        if close.any():
            yield np.stack([a[close], b[close]], axis=1)
    for k in np.flatnonzero((lengths > dense) & (lengths <= (split or lengths.max()))):
        members = value[starts[k] : starts[k] + lengths[k]]
        if links := _spanning(members, radius):
            a, b = np.array(links).T
            yield np.stack([members[a], members[b]], axis=1)


def _verified(keyed: DataFrame, radius: int, dense: int, split: int | None) -> DataFrame:
    """``src, dst, block, variant``: verified links within buckets of ``keyed`` (``block, variant, fingerprint``).

    The members of buckets over ``split`` come out as ``src``, with their bucket and without ``dst``.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("block", pa.int8()), ("variant", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(*columns) -> pa.RecordBatch:
            size = len(columns[0])
            arrays = [pa.nulls(size, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def found(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            block, variant, value = (np.concatenate(x) for x in zip(*parts))
            starts, lengths = _runs(block, variant)
            for pairs in _bucket_links(value, starts, lengths, radius, dense, split):
                signed = pairs.view(np.int64)
                yield rows(signed.min(axis=1), signed.max(axis=1), None, None)
            large = np.repeat(lengths > (split or lengths.max()), lengths)
            if large.any():
                yield rows(value[large].view(np.int64), None, block[large], variant[large])

        held: list[list[np.ndarray]] = []  # of the last bucket, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            last = (part[0] == part[0][-1]) & (part[1] == part[1][-1])
            cut = len(last) - int(last.sum())
            if cut or held and (held[0][0][0], held[0][1][0]) != (part[0][0], part[1][0]):
                yield from found([*held, [x[:cut] for x in part]])
                held = []
            held.append([x[cut:] for x in part])
        if held:
            yield from found(held)

    dealt = keyed.repartition("block", "variant").sortWithinPartitions("block", "variant")
    return dealt.mapInArrow(verify, "src bigint, dst bigint, block tinyint, variant bigint")


def _dealt(members: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Members (``block, variant, fingerprint``) of large buckets, each in ``radius + 1`` smaller ones.

    The bits in which a bucket's members may differ freely are parted in ``radius + 1`` ranges. Two members within the
    radius agree in one of them at least, so they meet in the bucket of that range and its bits.
    """
    masks = []
    for free, _ in _balls(radius, blocks):
        bits = [b for b in range(BITS) if not free >> b & 1] or list(range(BITS))
        ends = [round(i * len(bits) / (radius + 1)) for i in range(radius + 2)]
        own = [sum(1 << b for b in bits[low:high]) for low, high in zip(ends, ends[1:])]
        masks.append([m - (1 << BITS) if m >> (BITS - 1) else m for m in own])
    literal = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in own]) for own in masks])
    ranged = members.select("*", F.posexplode(literal[F.col("block").cast("int")]).alias("range", "mask"))
    bits = F.col("fingerprint").bitwiseAND(F.col("mask"))
    return ranged.select(F.col("range").cast("tinyint").alias("block"), F.xxhash64("block", "variant", "range", bits).alias("variant"), "fingerprint")


def links(distinct: DataFrame, radius: int = 3, blocks: int = BLOCKS, dense: int = DENSE, split: int = SPLIT) -> DataFrame:
    """Distinct ``src < dst`` links between distinct fingerprints within ``radius`` bits, enough to connect all of them.

    Small buckets give all their verified links, large ones a spanning forest, so the rows are linear in the
    fingerprints; buckets over ``split`` are dealt to several tasks by further bits. A bucket's size has a proven bound
    for an odd radius: its members agree outside one block up to ``radius - 1`` bits, so with 16-bit blocks and radius 3
    it has fewer than 49 x 65,536 distinct members, and one that was dealt fewer than 49 x 4,096.
    """
    first = durable(_verified(variants(distinct, radius, blocks), radius, dense, split).distinct())
    members = first.where("block IS NOT NULL").select("block", "variant", F.col("src").alias("fingerprint"))
    within = _verified(_dealt(members, radius, blocks), radius, dense, None)
    return first.where("block IS NULL").select("src", "dst").union(within.select("src", "dst")).distinct()


def near_duplicates(
    documents: DataFrame,
    shingle: int = 3,
    radius: int = 3,
    blocks: int = BLOCKS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: connected components of fingerprints within ``radius`` bits.

    Texts are lower-cased in A-Z and cut into words at the six ASCII white-space bytes; shingles count as often as they
    occur. ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id of the component, its own
    included. Exact copies share a fingerprint and are folded before variants are made. Null or empty texts have
    fingerprint zero and link like any other. Repeated rows are all returned. A null id is a member without a number:
    ``component_id`` is null only if all ids of the component are. An empty table gives an empty result; other columns
    are ignored.
    """
    prints = durable(fingerprints(documents, shingle, id_column, text_column))
    roots = durable(_roots(prints, radius, blocks))
    smallest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = roots.join(smallest, "root").select(F.col("fingerprint").alias("label"), "component_id")
    # Many copies may share one fingerprint: that side is split by adaptive execution, the other has unique keys.
    return prints.join(labels, prints.fingerprint == labels.label).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _roots(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fingerprint, low, root``: each distinct fingerprint, its smallest id, its component's smallest fingerprint."""
    distinct = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    linked = components(links(distinct, radius, blocks))
    return distinct.join(linked, distinct.fingerprint == linked.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )


def one_of_each(
    documents: DataFrame,
    shingle: int = 3,
    radius: int = 3,
    blocks: int = BLOCKS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``documents``, all columns, that stand for their component: one each.

    It is the row with the smallest id; of rows that share it, that with the smallest text hash, then the smallest
    values. A row without an id stays only if no row of the component has one.
    """
    prints = durable(fingerprints(documents, shingle, id_column, text_column))
    roots = _roots(prints, radius, blocks).select(F.col("fingerprint").alias("label"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    chosen = (
        prints.join(roots, prints.fingerprint == roots.label)
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    )
    packed = documents.select(F.struct("*").alias("_row")).withColumn("_own_key", F.xxhash64(f"_row.`{text_column}`"))
    own = [F.col(f"_row.`{id_column}`").alias("_own_id"), F.col("_own_key")]
    found = packed.join(chosen, own[0].eqNullSafe(F.col("_id")) & (own[1] == F.col("_key")), "left_semi")
    return found.groupBy(*own).agg(F.min("_row").alias("_row")).select("_row.*")
