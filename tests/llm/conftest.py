from __future__ import annotations

import random

import pytest

FIXTURE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Whole fixture documents, and rows that operators must bear: nulls, empty and long texts, repeats, near copies."""
    base = spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "text", "source")
    r = random.Random(3)
    words = [f"w{r.randint(0, 400)}" for _ in range(30_000)]
    long = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    near = " ".join(words[:300])
    odd = [
        (9001, None, "src1"),
        (9002, "", "src1"),
        (9003, "  \n\t ", None),
        (9004, long, "src2"),
        (9005, near, "src3"),
        (9006, near.replace("w1 ", "w2 ", 1), "src3"),
        (9006, near.replace("w1 ", "w2 ", 1), "src3"),
        (9007, "Under the MIT License, CC-BY-NC 4.0; ÉÀ x", None),
        (9008, "Apache License, Version 2.0. under the mit license", "src4"),
        (None, "a b c", "src5"),
        (None, None, None),
    ]
    return base.union(spark.createDataFrame(odd, "doc_id bigint, text string, source string")).coalesce(4)


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string, n_chars bigint")


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named like results and internals."""
    names = "doc_id bigint, text string, source string, n_words bigint, kept boolean, component_id string, spans int, _row int, host int, gone int, `a.b` int, words int, fingerprint int, segment int, length int"
    row = (1, "one two three four\nfive six", "s", 5, True, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9)
    return spark.createDataFrame([row, row], names)
