from itertools import accumulate

import corpus_pipeline
from pyspark.sql import functions as F

from tidefold.llm import mixing, ngram_join


def test_stages(spark, sf_dir, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    foul = documents.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit("you worthless idiot, pathetic moron and scum").alias("text"), "lang", "source", "n_chars")
    docs, seen = documents.unionByName(foul), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == documents.columns and out.dtypes == documents.dtypes
        seen.append(out.cache())
        docs = out
    clean, lines, single, mixed, pieces = seen
    assert clean.where("doc_id = 1000000").isEmpty() and clean.count() > 0.8 * documents.count()
    assert lines.count() == clean.count() and lines.where("n_chars <> char_length(text)").isEmpty()
    assert ngram_join.join_similar(single).where("n_links > 0").isEmpty() and single.count() == single.select("text").distinct().count()
    counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert max(counts) <= 2 and set(counts) == {1, 2}
    assert pieces.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    for df in seen:
        df.unpersist()


def test_whole_run_and_edge_cases(spark, sf_dir, edge, nothing):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100 and corpus_pipeline.ORACLE_SQL is None
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() > 0 or docs.columns


def test_packing_keeps_the_order_of_training(spark, sf_dir, documents, tmp_path):
    """However the scan deals the mixed table's files: many of them, the last the largest, cut at 64 kB."""
    order = [r.doc_id for r in documents.orderBy(F.length("text"), "doc_id").collect()]
    docs = documents.repartitionByRange(6, F.length("text"), "doc_id").sortWithinPartitions(F.length("text"), "doc_id")
    docs.write.option("parquet.block.size", 32_768).parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), sf_dir).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.doc_id for r in rows if r.start == 0] == order
    assert all(r.sequence_id * 1024 + r.offset == sum_ for r, sum_ in zip(rows, [0, *accumulate(x.length for x in rows)]))


def test_mixing_writes_in_order_of_training(spark, sf_dir, documents, tmp_path):
    corpus_pipeline.mix_sources(spark, documents, sf_dir).write.parquet(str(tmp_path / "mixed"))
    rows = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), sf_dir).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in rows if r.start == 0] == [r.doc_id for r in mixing.curriculum(documents).orderBy("position", "doc_id", "copy").collect()]
