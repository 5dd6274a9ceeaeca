"""The pipeline against the same stages by brute force, and each stage's contract."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("strandline.llm")
import corpus_pipeline  # noqa: E402
from strandline.llm import mixing, packing, quality  # noqa: E402
from strandline.llm.words import buffers  # noqa: E402
from strandline.session import table  # noqa: E402

#: The last columns are not of documents; their names are some that operators might use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _epoch long, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(120):
        body = " ".join(rng.choice(vocabulary, int(rng.integers(8, 90)))) + "."
        rows.append((i, body, "en", f"s{i % 5}", len(body)))
    for i in range(120, 160):
        rows.append((i, "BUY!!! NOW!!! " * 15, "en", "s1", 0))
    rows += [(200 + k, rows[k][1], "en", "s2", 0) for k in range(6)] + [(210 + k, rows[k + 10][1] + " end", "en", "s0", 0) for k in range(6)]
    rows += [(300, None, "en", None, None), (301, "", "en", "s0", 0), rows[3]]
    rows = [(*r, 7, "x") for r in rows]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def brute(spark, path, rows):
    docs = table(spark, path, "documents")
    model = quality.fitted(docs, table(spark, path, "labels"))
    kept = []
    for r in rows:
        raw, off = buffers(pa.array([r[1]], pa.string()))
        if model.scores(quality.statistics(raw, off))[0] >= 0.5:
            kept.append(r)
    yield kept
    first = {}
    for r in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0], r))
    kept = [min(g, key=lambda x: x[:2])[2] for g in first.values()]
    yield kept
    sets = {r[0]: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())) for r in kept}
    up = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    kept = [r for r in kept if up[r[0]] == r[0]]
    yield kept
    goal = {r.doc_id: r.target for r in mixing.mixed(spark.createDataFrame(kept, SCHEMA)).select("doc_id", "target").collect()}
    out = []
    for s in {r[3] for r in kept}:
        own = sorted((hashlib.md5(f"{mixing.SALT}{r[0]}".encode()).hexdigest(), r) for r in kept if r[3] == s)
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for _, r in own]
        whole, at = sum(sizes), 0
        for (_, r), n in zip(own, sizes):
            target = int(goal[r[0]])
            epochs = target // whole if whole else 0
            times = epochs + (2 * at + n <= 2 * (target - epochs * whole))
            out += [r] * (times if n else 0)
            at += n
    yield out


def test_stages_and_result(spark, folder):
    path, rows = folder
    key = lambda r: str(tuple(r))
    docs, want = table(spark, path, "documents"), None
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(spark, path, rows)):
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), SCHEMA)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert sorted(map(key, docs.collect())) == sorted(map(key, want)), name
    got = corpus_pipeline.run(spark, path).collect()
    ids = packing.Ids(packing.tokenizer_path())
    pieces = []
    for r in want:
        raw = next(ids.of([(r[1] or "").encode()])) + b"\0\0\0\0"
        pieces.append((r[0], 0, 0, len(raw) // 4, zlib.crc32(raw)))
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    assert len({r.sequence_id for r in got}) <= -(-sum(p[3] for p in pieces) // 2048) + 1


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder[0], "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
