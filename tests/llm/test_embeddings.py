"""The range join of embeddings: what it writes, and its groups, panels and strips against all pairs."""

import hashlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest

from metricspark.llm import embeddings
from metricspark.llm.embeddings import range_join


class Held:
    def __init__(self, value):
        self.value = value


def batches(vectors, dtype, n=40):
    vec = [np.asarray(v, dtype).tobytes() for v in vectors]
    keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vec]
    return [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + n], pa.binary()), pa.array(vec[i : i + n], pa.binary())], names=["key", "vec"])
        for i in range(0, len(vec), n)
    ]


def written(spark):
    folder = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    return sum(p.stat().st_size for p in folder.rglob("*") if p.suffix in (".parquet", ".blocks"))


def test_evenly_spread_vectors_are_written_a_fixed_number_of_times(spark, monkeypatch):
    # what has served is removed meanwhile; here it stays, to be counted
    monkeypatch.setattr(embeddings, "remove_folders", lambda *_: None, raising=False)
    x = np.random.default_rng(3).normal(size=(3000, 64))
    x[7], x[9] = x[8], x[2500] + 0.01
    before = written(spark)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in range_join(frame, cell=50).collect() if r.n_links]
    assert sorted(got) == [7, 8, 9, 2500]
    assert written(spark) - before < 5 * x.nbytes


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_groups_panels_and_strips_meet_each_pair_once(tmp_path, monkeypatch, dtype):
    for name, value in {"PANEL": 32, "STRIP": 8, "LINKS": 50, "PART_BYTES": 1, "PARTS": 6, "MOST_TASKS": 9}.items():
        monkeypatch.setattr(embeddings, name, value)
    r = np.random.default_rng(1)
    n = 600
    x = r.normal(size=(50, 20))[r.integers(0, 50, n)] + r.normal(size=(n, 20)) * r.choice([0.02, 0.2, 0.5], size=(n, 1))
    x[:60] = x[0] + r.normal(size=(60, 20)) * 0.001
    x[60:70] = x[70:80]
    x = x.astype(dtype)
    unit = embeddings._unit(x)
    distinct = {v.tobytes(): i for i, v in enumerate(x)}
    pivots = unit[list(distinct.values())[:12]]
    for basis in (embeddings._basis(r.permutation(unit), 0.9), np.linalg.qr(r.normal(size=(20, 5)))[0].T):
        held = Held({x.itemsize * 20: embeddings.Space(pivots, basis)})
        homes = pa.Table.from_batches(embeddings._homes(held, dtype)(batches(x, dtype)))
        cut = pa.array([k[0] % 2 for k in homes["key"].to_pylist()], pa.int32())
        homes = homes.append_column("part", cut).select(["size", "cell", "part", "key", "copies", "vec", "near"])
        homes = homes.sort_by([(c, "ascending") for c in ("size", "cell", "part", "key")])
        folder = str(tmp_path / str(basis is None or len(basis)))
        blocks = pa.Table.from_batches(embeddings._pack(folder)(homes.to_batches(max_chunksize=30))).to_pylist()
        groups, tasks = plan = embeddings._plan([embeddings.Block(**b) for b in blocks])
        assert len(groups) > 3 and max(len(g) for g in groups) > 1 and max(len(t) for _, t in tasks) > 1
        assert sum(b["n"] for b in blocks) == len(distinct) == n - 10
        numbers = pa.RecordBatch.from_arrays([pa.array(range(len(tasks)), pa.int64())], names=["id"])
        rows = pa.Table.from_batches(embeddings._meet(held, Held(plan), folder, 0.9, dtype)([numbers])).to_pylist()
        key = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
        link = unit @ unit.T >= 0.9
        want = {key[i]: int(sum(link[i, j] for j in range(n) if key[j] != key[i])) for i in range(n)}
        count, parent = Counter(), {k: k for k in key}

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for row in rows:
            count[row["key"]] += row["links"]
            parent[root(row["key"])] = root(row["root"])
        assert count == Counter({k: c for k, c in want.items() if c})
        least = np.arange(n)
        while ((new := np.where(link, least[None], n).min(axis=1)) != least).any():
            least = new
        assert len({root(k) for k in key}) == len(set(least.tolist()))
        assert all(root(key[i]) == root(key[least[i]]) for i in range(n))


def test_repeated_vectors_are_sent_once_by_a_task_and_counted(tmp_path, monkeypatch):
    monkeypatch.setattr(embeddings, "SEEN", 30)
    x = np.random.default_rng(2).normal(size=(50, 4))
    x = np.concatenate([x, x[[3] * 500], x[:20], 2 * x[:5]])
    held = Held({32: embeddings.Space(embeddings._unit(x[:6]), None)})
    tasks = [pa.Table.from_batches(embeddings._homes(held, np.float64)(batches(some, np.float64))) for some in (x[:300], x[300:])]
    assert all(t["vec"].null_count < 40 and t.num_rows < 120 for t in tasks)
    rows = pa.concat_tables(tasks)
    rows = rows.append_column("part", pa.array([0] * len(rows), pa.int32())).select(["size", "cell", "part", "key", "copies", "vec", "near"])
    rows = rows.sort_by([(c, "ascending") for c in ("size", "cell", "part", "key")])
    blocks = pa.Table.from_batches(embeddings._pack(str(tmp_path))(rows.to_batches(max_chunksize=7))).to_pylist()
    fs, path = embeddings.opened(str(tmp_path))
    held_rows = embeddings.Rows(fs, path, [embeddings.Block(**b) for b in blocks], None, np.float64)
    got = dict(zip((bytes(k) for k in held_rows.keys), held_rows.copies.tolist()))
    assert got == Counter(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x)


def test_vectors_of_floats(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [3e38, 3e38]), (4, [1e-40, 1e-40]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, -0.0]), (8, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(frame).collect()}
    want = {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False)}
    assert got == want | {i: (0, i, True) for i in (5, 6, 7, 8)}
