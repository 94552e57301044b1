import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_simhash import alike
from tokenizers import Tokenizer

from veritrace.llm import mixing, severity

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], DATA).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(s.columns == columns for s in steps[:4])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:3]]
    # Rejected documents go, by the model that the labelled ones give.
    model = severity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(texts[1]) == {d for d, t in texts[0].items() if model.above(t)[0] < severity.REJECT}
    # Of each class of near copies the smallest stays.
    assert set(texts[2]) == set(alike(list(texts[1].items())).values())
    # Sources come to their targets.
    words = collections.Counter()
    for r in steps[3].collect():
        words[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix(steps[2]).collect()}
    assert all(abs(words[s] - t) < 3 for s, t in targets.items())
    # Every token of every row is in one piece.
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = collections.Counter(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[3].collect())
    assert sum(r.length for r in steps[4].collect()) == sum(n * k for n, k in lengths.items())
    assert all(len(r.ids) == 4 * r.length for r in steps[4].collect())
    assert np.array_equal(sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32").collect())), sorted(map(tuple, steps[4].select("doc_id", "start", "length", "ids_crc32").collect())))


def test_extra_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", True, 0.5), (1, "a b c d e f", "s", True, 0.5), (2, None, None, False, 1.0)], "doc_id long, text string, source string, rejected boolean, p_toxic double")
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == 3
    one = corpus_pipeline.drop_near_copies(spark, kept, DATA)
    assert one.columns == docs.columns and one.count() == 2
    assert corpus_pipeline.mix_sources(spark, one, DATA).columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, docs.withColumn("length", F.lit(1)).withColumn("part", F.lit("p")).withColumn("ids", F.lit(2)), DATA).collect()
    assert len(packed) == 3 and {r.doc_tokens for r in packed if r.doc_id == 2} == {1}


def test_empty_tables_nulls_and_ties(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    rows = [(1, None, None, None), (2, "", "s", "x"), (None, "some words here", "s", None), (None, None, None, None), (3, " \n", "t", "y"), (4, "word " * 30_000, "t", "y"), (5, "word " * 30_000, "t", "y")]
    docs = spark.createDataFrame(rows, empty.schema)
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.count() == len(rows)
    one = corpus_pipeline.drop_near_copies(spark, kept, DATA)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "4", "None", "None"]
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {4, 5, None}
    packed = corpus_pipeline.pack_sequences(spark, docs, DATA).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and sum(r.start == 0 for r in packed) == len(rows)
