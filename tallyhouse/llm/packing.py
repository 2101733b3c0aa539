"""Best-fit packing of documents into sequences by bin completion with branch and bound.

Pieces of one length are interchangeable, so the search runs over the histogram of lengths: at most as many rows as a
sequence has tokens, whatever the corpus. Its result, a list of fillings with multiplicities, is laid over the pieces by
their rank within a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_rows, projected
from .tokens import vocabulary, word_tokens

CAPACITY = 2048
#: Nodes of the search for one filling, and of the whole search. Beyond them what is best so far holds; it is complete.
FILLING_NODES = 20_000
SEARCH_NODES = 3_000_000
#: Fillings tried at one step, by waste.
CHOICES = 5
#: Rows in one group when ranks within a length are dealt out.
GROUP_ROWS = 100_000
DEAL_SEED = 42

Filling = tuple[int, ...]


def pieces(
    documents: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of every document.

    A document is its ids without special tokens, then ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` ids. Null and empty texts are the end id alone.
    """
    path = tokenizer or vocabulary()
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokens = word_tokens(path)
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1))):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for number, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    yield doc_id, number, at, len(part), part.tobytes()

    kind = dict(documents.dtypes)[id_column]
    return map_rows(
        projected(documents, doc_id=id_column, text=text_column),
        rows,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids binary",
        arrow_in=True,
    )


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the histogram: bins of the same content are kept as one with a multiplicity."""
    bins: dict[int, dict[Filling, int]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                content, number = (), left
                per = capacity // length
                # A new bin is the best fit for the next equal pieces only until it is full.
                number, rest = divmod(left, per)
                for size, many in ((per, number), (rest, 1)):
                    if size and many:
                        bins.setdefault(capacity - size * length, {}).setdefault((length,) * size, 0)
                        bins[capacity - size * length][(length,) * size] += many
                left = 0
                continue
            content, number = next(iter(bins[room].items()))
            used = min(number, left)
            bins[room][content] -= used
            if not bins[room][content]:
                del bins[room][content]
            if not bins[room]:
                del bins[room]
            to = bins.setdefault(room - length, {})
            to[content + (length,)] = to.get(content + (length,), 0) + used
            left -= used
    return [(content, n) for group in bins.values() for content, n in group.items()]


def fillings(counts: dict[int, int], room: int, keep: int = 1, spent: list[int] | None = None) -> list[Filling]:
    """Undominated fillings of ``room`` from the histogram, fullest first, at most ``keep``.

    Depth first from the longest piece that fits: the first leaf is the best fit and the incumbent. A branch ends when
    all that can still be added leaves more waste than the fillings kept. A filling is
    dominated if one of its pieces could be exchanged for a longer one that is there: such have more waste, so those
    kept by waste are undominated.
    """
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x]]
    if not lengths:
        return [()]
    total_from = list(accumulate((x * counts[x] for x in reversed(lengths))))[::-1] + [0]
    found: dict[Filling, int] = {}
    worst, nodes, smallest = room, 0, lengths[-1]
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and nodes < FILLING_NODES:
        at, rest, content = stack.pop()
        nodes += 1
        while at < len(lengths) and lengths[at] > rest:
            at += 1
        if at == len(lengths) or rest < smallest:
            if rest <= worst or not found:
                found[content] = rest
                if len(found) > keep:
                    del found[max(found, key=found.get)]
                if len(found) == keep:
                    worst = max(found.values()) - 1
                    if worst < 0:
                        break
            continue
        if found and rest - total_from[at] > worst:
            continue
        length = lengths[at]
        most = min(counts[length], rest // length)
        # Popped last in, first out: the most copies of the longest piece come first, none of it last.
        for number in range(0, most + 1):
            stack.append((at + 1, rest - number * length, content + (length,) * number))
    if spent is not None:
        spent[0] += nodes + len(lengths)
    return sorted(found, key=lambda c: (found[c], [-x for x in c]))


def completed(
    counts: dict[int, int], capacity: int, limit: int, path: list[int], spent: list[int]
) -> list[tuple[Filling, int]] | None:
    """Bin completion around the largest piece left; None once the waste is more than fewer than ``limit`` bins allow.

    ``path`` says which filling to take at the first steps, best first; beyond it the fullest is taken. A filling is used
    for as many bins as its pieces last.
    """
    left = {x: n for x, n in counts.items() if n}
    allowed = (limit - 1) * capacity - sum(x * n for x, n in left.items())
    result: list[tuple[Filling, int]] = []
    waste = 0
    step = 0
    while left:
        largest = max(left)
        left[largest] -= 1
        choice = path[step] if step < len(path) else 0
        options = fillings(left, capacity - largest, choice + 1, spent)
        content = (largest, *options[min(choice, len(options) - 1)])
        left[largest] += 1
        step += 1
        need = {x: content.count(x) for x in set(content)}
        number = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * number
            if not left[x]:
                del left[x]
        result.append((content, number))
        waste += (capacity - sum(content)) * number
        # The waste of the last bin is free: it does not make one more.
        if waste - (capacity - sum(content)) > allowed and left:
            return None
    return result


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on the bins: for each limit, what pieces above half leave free must hold those from the limit to half."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    many = np.array([counts[x] for x in sizes.tolist()], dtype=np.int64)
    best = -(-int((sizes * many).sum()) // capacity)
    for limit in {0, *(x for x in sizes.tolist() if 2 * x <= capacity)}:
        alone, large = sizes > capacity - limit, (2 * sizes > capacity) & (sizes <= capacity - limit)
        small = (sizes >= limit) & (2 * sizes <= capacity)
        free = int((many[large] * (capacity - sizes[large])).sum())
        rest = int((many[small] * sizes[small]).sum()) - free
        best = max(best, int(many[alone].sum() + many[large].sum()) + max(0, -(-rest // capacity)))
    return best


def packed_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that use up the histogram, in as few bins as the search finds.

    The incumbent is best-fit decreasing. While it has more bins than the lower bound, bin completion is run, first with
    the fullest filling at every step, then with other choices at one step, at two steps, and so on. What has fewer bins
    is the incumbent from then on, and further choices start from its own. The search ends at the bound, with all choices
    tried, or when ``SEARCH_NODES`` are spent. It is not exhaustive: a step takes one of the ``CHOICES`` fullest fillings,
    among those that ``FILLING_NODES`` nodes find, and a filling is used for as many bins as its pieces last.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    best, spent = best_fit(counts, capacity), [0]
    least = least_bins(counts, capacity)
    bins = lambda plan: sum(n for _, n in plan)
    tries = _deviations([], len(best))
    while bins(best) > least and spent[0] < SEARCH_NODES:
        path = next(tries, None)
        if path is None:
            break
        found = completed(counts, capacity, bins(best), path, spent)
        if found is not None and bins(found) < bins(best):
            best, tries = found, _deviations(path, len(found))
    return best


def _deviations(base: list[int], steps: int) -> Iterator[list[int]]:
    """Choices at each step: those of ``base``, then with other choices at one step, at two steps and so on."""
    base = (base + [0] * steps)[:steps]
    for many in range(steps + 1):
        for places in combinations(range(steps), many):
            for others in product(range(1, CHOICES), repeat=many):
                path = list(base)
                for place, other in zip(places, others):
                    path[place] = (path[place] + other) % CHOICES
                yield path


def slots(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length the slots in order: columns first rank, first sequence, offset."""
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, number in plan:
        offset = 0
        for length in content:
            by_length.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + number
            offset += length
        sequence += number
    return {x: np.array(rows, dtype=np.int64) for x, rows in by_length.items()}


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (``doc_id, piece, start, length, ...``, lengths of 1 to ``capacity``) with ``sequence_id, offset``.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver. Ranks within a length are counted in
    groups of bounded size. Rows are dealt to groups by a random number that is written with them, so that neither a
    length nor an id, null or repeated, that holds a third of all rows is in one group. Ties of identical rows may change
    places, which makes no difference.
    """
    spark = rows.sparkSession
    written = durable(rows.withColumn("_deal", F.floor(F.rand(DEAL_SEED) * (1 << 31)).cast("int")))
    total = written.count()
    groups = max(1, -(-total // GROUP_ROWS))
    keys = [F.col(c) for c in ("doc_id", "piece", "start")]
    dealt = written.withColumn("_group", F.pmod("_deal", F.lit(groups))).drop("_deal")
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    plan = spark.sparkContext.broadcast(slots(packed_counts(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy(*keys)) - 1
    ranked = dealt.withColumn("_rank", rank).join(firsts, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_first"))

    names = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty_like(at), np.empty_like(at)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                table = plan.value[int(x)]
                k = np.searchsorted(table[:, 0], at[own], side="right") - 1
                sequence[own] = table[k, 1] + at[own] - table[k, 0]
                offset[own] = table[k, 2]
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def packed_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    Null and empty texts are pieces of one token, repeated rows are packed each, a null id is kept. Empty tables give no
    rows. The pieces' rows, without their ids, are written to the shared folder, so the tokenizer runs once.
    """
    rows = digested(pieces(documents, tokenizer, capacity, **options))
    return packed(rows, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def digested(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
