"""What a Python worker holds at once: bounded by the texts handled together, not by the batch."""

import random
import tracemalloc

import pyarrow as pa

from metricspark.llm.decontamination import Benchmark, _search
from metricspark.llm.jaccard import _gram_sets, _sketch


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / (1 << 20)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    return [" ".join(r.choices(words, k=300)) for _ in range(n)]


def test_leaks_of_a_batch_in_little_memory():
    rows = texts(1000)

    class Held:
        value = ([7], Benchmark([rows[900]], 5))

    batch, found = pa.array(rows), []
    run = _search(Held, 0.5, pa.int64())
    run(batch[:1])  # tables that every worker keeps
    assert peak_mb(lambda: found.extend(run(batch).to_pylist())) < 20
    assert [i for i, x in enumerate(found) if x] == [900]


def test_sketches_of_a_batch_in_little_memory():
    rows = texts(2000)
    ids = pa.array(range(len(rows)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(rows), ids], names=["id", "text", "text_hash"])
    run = _sketch(2, 3, 5)
    some = list(run([batch]))  # tables that every worker keeps
    assert sum(len(b) for b in some) == len(rows)
    classes = pa.concat_batches(some).column("text_class")
    assert peak_mb(lambda: [None for _ in run([batch])]) < 20
    given = pa.RecordBatch.from_arrays([classes, pa.array(rows)], names=["text_class", "text"])
    sets = []
    assert peak_mb(lambda: sets.extend(_gram_sets(5)([given]))) < 20
    assert sum(len(b) for b in sets) == len(rows)


def test_ids_are_written_before_they_are_decoded(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words, some more"), (2, None)], "doc_id long, text string")
    encoded = corpus_pipeline.encode(spark, docs, "")
    assert encoded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.doc_id, r.n_tokens > 0, r.round_trip) for r in encoded.orderBy("doc_id").collect()] == [(1, True, True), (2, False, True)]
