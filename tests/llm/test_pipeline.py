"""The pipeline's stages keep their promises, and every registered query runs."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from geofold.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_return_documents_and_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "source_mixing", "vector_packing"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and len(set(now)) == len(now)
        ids = set(now)
    pieces = corpus_pipeline.run(spark, SF)
    ends = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert ends.where("n != all").count() == 0 and {r.doc_id for r in ends.collect()} == ids


def test_queries_are_named_by_number_and_return_all_rows(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1", "op3", "op4", "op5", "op7", "op10", "op11", "op12"):
        q = next(f for k, f in QUERIES.items() if k.startswith(name + "_"))
        assert q(spark, SF).count() == n, name


@pytest.mark.parametrize("name", ["op11_suffix_array_resampling", "op13_spelling_automata"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want)) and want


def test_stages_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    prose = lambda n: "\n".join(" ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(12)) for _ in range(n))
    rows = [(i, prose(6), "en", ["a", None, "b"][i % 3], 0) for i in range(60)]
    again = prose(8)
    rows += [(100, again, "en", "a", 0)] * 3 + [(None, prose(7), None, None, None), (None, prose(7), "en", "a", 0), (200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", "en", "a", 0), (203, prose(4000), "en", "a", 0)]
    names = ["row_id", "host", "key", "node", "root", "text_hash", "score", "g", "__text"]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    docs, sizes = plain, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == plain.columns, name
        docs = spark.createDataFrame(found := docs.collect(), plain.schema)
        sizes[name] = Counter(r.doc_id for r in found)
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in found) and not {200, 201, 202} & set(sizes[name])
    assert sizes["quality_rules"][100] == 3 and sizes["quality_rules"][None] == 2 and sizes["quality_rules"][203] == 1
    assert sizes["near_duplicates"].get(100, 0) <= 1 and max(sizes["source_mixing"].values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(sizes["source_mixing"])


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []
