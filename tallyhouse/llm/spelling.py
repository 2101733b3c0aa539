"""Spelling variants: words one edit apart are found in a bit-sliced position index of the vocabulary.

For every (position, letter) a bitset tells which words hold that letter there. A query word is read letter by letter
while two bitsets are kept for all words at once: those without an error so far, and those with one. Positions of the
second set are shifted by one where a letter was inserted or deleted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows, projected

#: A-Z become lower-case; no other letter changes.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many (document, run) pairs loses a letter, as planted misspellings.
DAMAGE = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Words indexed together: a larger bucket is cut into blocks of about this size, each read by all words of the bucket.
BLOCK = 8192
#: Letters of a word that a block is sized for; blocks of longer words hold fewer.
LETTERS = 12
#: Beyond all code points: marks a length in place of a letter.
LENGTH = 0x110000
#: Words read through the index together, fewer if they are long.
TOGETHER = 256
#: Distinct words counted in a task before they are passed on.
HELD = 200_000


def occurrences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``word, n``: words of at least ``MIN_LENGTH`` code points and their occurrences, partly added up.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z in lower case. ``damage`` takes a letter
    from the runs of a document whose checksum it divides; 0 takes none. A null text has no words, a null id is empty in
    the checksum, repeated rows count again, other columns are ignored, an empty table gives no rows.
    """
    given = projected(documents, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("string"), "text")

    def rows(documents: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[str, int] = {}
        for doc_id, text in documents:
            if not text:
                continue
            own: dict[str, int] = {}
            for run in RUN.findall(text.encode().translate(LOWER).decode()):
                own[run] = own.get(run, 0) + 1
            salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in own.items():
                if damage:
                    h = zlib.crc32(run.encode(), salt)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                if len(run) >= MIN_LENGTH:
                    total[run] = total.get(run, 0) + n
            if len(total) >= HELD:
                yield from total.items()
                total = {}
        yield from total.items()

    return map_rows(given, rows, "word string, n bigint")


def vocabulary(documents: DataFrame, min_count: int = MIN_COUNT, **options) -> DataFrame:
    """``word, n`` of all words with at least ``min_count`` occurrences overall."""
    return occurrences(documents, **options).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)


class PositionIndex:
    """Bitsets of words by (position, letter) and by length, as rows of one table; row 0 is the empty set."""

    def __init__(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        member = np.repeat(np.arange(len(words)), sizes)
        position = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Letters have their code point and a position from 1 on; lengths stand for a letter beyond all code points.
        keys = np.concatenate((self._key(position, _code_points(words)), self._key(sizes, LENGTH)))
        members = np.concatenate((member, np.arange(len(words))))
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        bounds = [*first.tolist(), len(keys)]
        members = members[order]
        self.sets = np.zeros((len(self.keys) + 1, -(-len(words) // 64)), dtype=np.uint64)
        flags = np.zeros(self.sets.shape[1] * 64, dtype=bool)
        for row, (start, stop) in enumerate(zip(bounds, bounds[1:]), 1):
            own = members[start:stop]
            flags[own] = True
            self.sets[row] = np.packbits(flags, bitorder="little").view(np.uint64)
            flags[own] = False

    @staticmethod
    def _key(position, letter):
        return (position + 1) * (LENGTH + 1) + letter

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)

    def one_error(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in ``words``, number in the index) of words that differ by exactly one inserted, deleted or
        replaced letter; ``words`` are of one length.

        ``exact`` and the three others are the zero-error and one-error sets after each letter, for all ``words`` at once.
        """
        size = len(words[0])
        letters = _code_points(words).reshape(len(words), size).T
        position = np.arange(size)[:, None]
        at, before, after = (self._rows(self._key(position + d, letters)) for d in (0, -1, 1))
        same, longer, shorter = self.sets[self._rows(self._key(np.array([size, size + 1, size - 1]), LENGTH))]
        exact = np.repeat((same | longer | shorter)[None, :], len(words), axis=0)
        replaced, inserted, deleted = (np.zeros_like(exact) for _ in range(3))
        for i in range(size):
            here = self.sets[at[i]]
            # The indexed word has a letter more before this one; has not this one; has another one instead.
            inserted |= exact & longer
            inserted &= self.sets[after[i]]
            deleted &= self.sets[before[i]]
            deleted |= exact & shorter
            replaced &= here
            replaced |= exact & same & ~here
            exact &= here
        found = replaced | inserted | (exact & longer) | deleted
        asking, at = np.nonzero(found)
        bits = np.unpackbits(found[asking, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return asking[which], at[which] * 64 + bit


def halves(words: DataFrame) -> DataFrame:
    """``side, k, half, word, n``: keys under which a word meets all words one edit away, its first or last k letters.

    Of two such words the shorter one, of l letters, shares its first or its last k = l // 2 letters with the other. Each
    word may be the shorter or the longer one.
    """
    size = F.length("word")
    lengths = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")))
    sides = F.array(
        F.struct(F.lit("first").alias("side"), F.left("word", F.col("k")).alias("half")),
        F.struct(F.lit("last").alias("side"), F.right("word", F.col("k")).alias("half")),
    )
    return words.select("word", "n", F.explode(lengths).alias("k")).select(F.inline(sides), "k", "word", "n")


def _meet(word: str, other: str, side: str, k: int) -> bool:
    """True in just one of the buckets where two near words meet."""
    return k == min(len(word), len(other)) // 2 and (side == "first" or word[:k] != other[:k])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, form, form_n`` of every word with a near word; ``words`` has distinct ``word`` and ``n``.

    ``form`` is the near word of largest count, ties by code points. Words meet by one half of their letters; a bucket
    larger than ``block`` is cut into blocks by hash, so a hot half becomes many tasks, each of one index and a stream of
    the bucket's words. Only a count and the best near word leave a block.
    """

    bucket = ["side", "k", "half"]
    emitted = halves(words)
    sizes = emitted.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("word")).alias("letters"))
    shared = sizes.where("members > 1").select(*bucket, F.ceil(F.col("letters") / (block * LETTERS)).cast("int").alias("blocks"))
    sized = emitted.join(shared, bucket)
    own = F.pmod(F.xxhash64("word"), "blocks").cast("int")
    # An indexed word comes before the words that ask, in the block of its own; every word asks every block of its bucket.
    asked = sized.select(*bucket, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "word", "n")
    indexed = sized.select(*bucket, own.alias("block"), F.lit(False).alias("asks"), "word", "n")
    ordered = (
        indexed.unionByName(asked).repartition(*bucket, "block").sortWithinPartitions(*bucket, "block", "asks", "word")
    )

    def matched(rows: Iterator[tuple]) -> Iterator[tuple]:
        # Small buckets share an index; ``places`` numbers the buckets held. A large one is answered in parts.
        key, place, index, letters = None, 0, None, 0
        members: list[tuple[str, int]] = []
        places: list[int] = []
        asking: list[tuple[str, int, str, int]] = []

        def answers() -> Iterator[tuple]:
            nonlocal index
            if not members:
                asking.clear()
                return
            if index is None:
                index = PositionIndex([w for w, _ in members])
            place_of = np.array(places)
            asking.sort(key=lambda x: len(x[0]))
            at = 0
            while at < len(asking):
                size = len(asking[at][0])
                stop = at + max(1, min(TOGETHER, TOGETHER * 256 // size))
                some = [x for x in asking[at:stop] if len(x[0]) == size]
                at += len(some)
                q, m = index.one_error([x[0] for x in some])
                own = np.array([x[1] for x in some])[q] == place_of[m]
                best: dict[int, list] = {}
                for q, m in zip(q[own].tolist(), m[own].tolist()):
                    word, _, side, k = some[q]
                    other, n = members[m]
                    if _meet(word, other, side, k):
                        known = best.setdefault(q, [0, 0, ""])
                        known[0] += 1
                        if n > known[1] or (n == known[1] and other < known[2]):
                            known[1:] = n, other
                for q, (n_near, form_n, form) in best.items():
                    yield some[q][0], n_near, form, form_n
            asking.clear()

        for side, k, half, number, asks, word, n in rows:
            if key != (side, k, half, number):
                if letters >= block * LETTERS:
                    yield from answers()
                    members.clear()
                    places.clear()
                    index, letters = None, 0
                key, place = (side, k, half, number), place + 1
            if not asks:
                members.append((word, n))
                places.append(place)
                index, letters = None, letters + len(word)
                continue
            asking.append((word, place, side, k))
            if len(asking) >= 4 * block:
                yield from answers()
        if asking:
            yield from answers()

    part = map_rows(ordered, matched, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return (
        part.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: the end of its chain, whose steps double in each round.

    Counts grow along a chain by ``RATIO``, so chains end, and five or so rounds reach any end.
    """
    reached = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further, "root", "left")
        step = durable(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        reached = step.drop("moved")
        if not moved:
            return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words``, which has distinct ``word`` and count ``n``.

    A word's form is its near word of largest count if that is at least ``ratio`` times its own; its root is the end of
    the chain of forms, or the word itself.
    """
    if ratio < 2:
        raise ValueError("forms must occur more often than their variants")
    words = durable(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    found = durable(
        near.select(
            "word",
            F.when(formed, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
