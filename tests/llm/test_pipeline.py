"""The pipeline's stages on a small table against brute force."""
import random

import pytest

import corpus_pipeline
from postern.llm import op5_mix, op6_near_dup, op7_quality, op8_sentencepiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    path = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(400):
        text = " ".join(f"w{r.randrange(400)}" for _ in range(30)) + "."
        if i % 4 == 3:
            text = "!! ".join(text.upper().split()) + " ###"
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
    rows += [(1000 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(20)]
    rows += [(None, "words without an id of their own here", "en", "s1", 0), (None, None, None, None, None), (2000, "", "en", None, 0), rows[0]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, folder)
    assert good.columns == docs.columns
    ids = [r.doc_id for r in good.collect()]
    assert all(i % 4 != 3 for i in ids if i is not None and i < 1000) and set(range(0, 400, 4)) <= set(ids)
    once = corpus_pipeline.near_dedup(spark, good, folder)
    near = {r.doc_id: r.kept for r in op6_near_dup.near_duplicates(good).collect() if r.doc_id is not None}
    got = [r.doc_id for r in once.collect()]
    assert once.columns == docs.columns and sorted(i for i in got if i is not None) == sorted(i for i, k in near.items() if k)
    assert len(got) == len({i for i in got if i is not None}) + got.count(None) and not any(i is not None and 1000 <= i < 1020 for i in got)
    mixed = corpus_pipeline.mix(spark, once, folder)
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in op5_mix.mix(once).collect():
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert times == want and mixed.columns == docs.columns
    assert corpus_pipeline.encode(spark, mixed, folder).count() == mixed.count()


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.round_trip for r in rows) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mix", "encode"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_worker_memory(spark, folder):
    """a worker that turns from encoding to scoring or near-dedup drops the piece tables, and no batch is large."""
    import pyarrow as pa

    from postern.llm import unigram

    class Plan:
        schema = None

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    model = op7_quality.Model(0.0, 0, *[op7_quality.np.zeros(0, int)] * 6)
    texts = pa.record_batch({"doc_id": [1, 2], "text": ["one two", None], "row": [1, 2]})
    for run in (op7_quality.keep_good(Plan(), model), op7_quality.classify(Plan(), model), op6_near_dup.sketches(Plan()), op6_near_dup.full_sets(Plan())):
        assert unigram.lattice(unigram.MODEL).count("word")[1] and unigram._loaded
        assert sum(b.num_rows for b in run(iter([texts]))) == 2 and not unigram._loaded

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"bytes": pa.array([batch.nbytes], pa.int64()), "rows": pa.array([batch.num_rows], pa.int64())})

    long = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 1500) as text")
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.encode):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(50), folder)
        got = long.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 2000 and max(r.bytes for r in got) < 3 << 20
