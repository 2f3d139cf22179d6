"""The corpus pipeline, stage by stage: every row that a stage drops is accounted for."""

from collections import Counter

import corpus_pipeline
from edgewise.llm import toxicity

from .test_documents import base_of, check_dropped, check_pieces


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0").selectExpr("doc_id", "concat(text, ' x y z')", "lang", "source", "n_chars"))
    docs = docs.union(docs.where("doc_id % 11 = 0")).union(docs.limit(1).selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "NULL", "n_chars"))
    docs = docs.selectExpr("*", "'c' AS component", "1 AS kept", "2 AS text_hash").cache()
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_dedup", "packing"]

    good = stages["quality"](spark, docs, sf_dir)
    wanted = [r for r in rows if base_of(r[1] or "")[6]]
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == Counter(wanted)

    good = spark.createDataFrame(wanted, docs.schema)
    clean = stages["toxicity"](spark, good, sf_dir)
    model = toxicity.learn(good, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = [r for r in wanted if model.score(r[1]) < 0.5]
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == Counter(wanted)

    clean = spark.createDataFrame(wanted, docs.schema)
    once = stages["near_dedup"](spark, clean, sf_dir)
    left = once.collect()
    assert once.columns == docs.columns and not Counter(map(tuple, left)) - Counter(wanted)
    check_dropped(left, [r[:2] for r in wanted])
    assert 0 < len(left) < len(wanted) < len(rows)

    check_pieces(stages["packing"](spark, spark.createDataFrame(left, docs.schema), sf_dir).collect(), [(r["doc_id"], r["text"]) for r in left])


def test_pipeline_of_whole_tables(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert packed and {r["doc_id"] for r in packed} < ids
