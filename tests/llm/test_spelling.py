"""Spelling variants against plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import FIXTURE, LOWER, collected, same

from tallyhouse.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count, ratio=5):
    by_skip = {}
    for w in count:
        for i in range(len(w)):
            by_skip.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    rows, forms = {}, {}
    for w, n in count.items():
        others = set().union(by_skip.get(w, ()), *(by_skip[w[:i] + w[i + 1 :]] for i in range(len(w))))
        others |= {w[:i] + w[i + 1 :] for i in range(len(w))} & count.keys()
        others = [x for x in others if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        if best and (ratio is None or count[best] >= ratio * n):
            forms[w] = best
        rows[w] = len(others)
    found = []
    for w, n in count.items():
        root = w
        while ratio and root in forms:
            root = forms[root]
        found.append((w, forms.get(w), root, n, rows[w], count.get(forms.get(w))))
    return found


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return Counter({w: n for w, n in total.items() if len(w) >= 6 and n >= 5})


def test_index():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(500)} | {"z" * 5000, "z" * 5001})
    index = spelling.PositionIndex(words)
    for size in {*map(len, words)}:
        asked = [w for w in words if len(w) == size]
        found = [(asked[q], words[m]) for q, m in zip(*index.one_error(asked))]
        same(found, [(a, b) for a in asked for b in words if near(a, b)])


@pytest.mark.parametrize("block", [1, 3, 50, 8192])
def test_variants_of_hot_halves(spark, block):
    """A third of the words share a half; a bucket is cut into many blocks."""
    r = random.Random(2)
    count = {"".join(r.choice("ab") for _ in range(r.randint(1, 7))): r.randint(5, 90) for _ in range(100)}
    count |= {"sharedhalf" + "".join(r.choice("xyz") for _ in range(r.randint(5, 9))): r.randint(5, 5000) for _ in range(150)}
    count |= {"\U0001f600éa": 6, "\U0001f600é": 30, "\U0001f600": 150}
    words = spark.createDataFrame([(w, n, 1) for w, n in count.items()], "word string, n long, root int")
    found = spelling.near_words(words, block=block)
    # Without a ratio the best near word is the form.
    expected = [(w, n, form, m) for w, form, _, _, n, m in plain_variants(count, None) if n]
    same(collected(found), expected)
    if block == 3:
        same(collected(spelling.variants(words)), plain_variants(count))


def test_words_of_odd_documents(docs, rows):
    given = docs.withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    found = spelling.vocabulary(given)
    same(collected(found), plain_words([r[:2] for r in rows]).items())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "text").collect()]
    count = plain_words(rows)
    expected = plain_variants(count)
    assert any(r[1] for r in expected)
    same(collected(queries.op12_spelling_variants(spark, FIXTURE)), expected)


def test_empty_tables(spark, empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
