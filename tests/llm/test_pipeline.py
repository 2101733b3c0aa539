"""Pipeline stages on what the stage before kept, each against its plain version; and the registered queries."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import FIXTURE, linked, plain_deduplicated, plain_fingerprint, plain_measures, same

from tallyhouse.llm import decontamination, oracles, packing, queries, tokens


def test_stages(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").select("item_id", "text").collect()]
    searches = decontamination.machines(benchmark)
    for name, stage in corpus_pipeline.STAGES:
        given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        found = stage(spark, docs, FIXTURE)
        if name == "quality_rules":
            good = [d for d, t, _ in given if (m := plain_measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
            same([r.doc_id for r in found.select("doc_id").collect()], good)
        elif name == "line_dedup":
            same([tuple(r) for r in found.select("doc_id", "text").collect()], [x[:2] for x in plain_deduplicated(given)])
            assert found.where(F.col("n_chars") != F.length("text")).count() == 0
        elif name == "simhash_near_dedup":
            prints = {d: plain_fingerprint(t) for d, t, _ in given}
            roots = linked(prints.values())
            first = {}
            for d in sorted(prints):
                first.setdefault(roots[prints[d]], d)
            same([r.doc_id for r in found.select("doc_id").collect()], first.values())
        elif name == "benchmark_decontamination":
            clean = [d for d, t, _ in given if not decontamination.hits(decontamination.search_words(t), searches)[0]]
            assert len(clean) < len(given)
            same([r.doc_id for r in found.select("doc_id").collect()], clean)
        else:
            cache = tokens.PieceCache(tokens.vocabulary())
            lengths = Counter()
            for _, text, _ in given:
                n = len(cache.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
                lengths[2048] += n // 2048
                lengths[n % 2048] += n % 2048 > 0
            rows = found.collect()
            assert Counter(r.length for r in rows) == +lengths
            assert len({r.sequence_id for r in rows}) == packing.least_bins(+lengths, 2048)
            return
        assert found.columns == columns
        folder = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{id(found)}"
        found.write.parquet(folder)
        docs = spark.read.parquet(folder)


def test_run_and_empty_stages(spark):
    assert corpus_pipeline.run(spark, FIXTURE).count() > 0
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").limit(0)
    assert [stage(spark, docs, FIXTURE).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FIXTURE}/{table}.parquet'")
    found = queries.QUERIES[name](spark, FIXTURE)
    expected = con.execute(oracles.SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    same([tuple(r) for r in found.select(*names).collect()], expected.fetchall())
