"""Each operator against brute force, on rows with nulls, blanks, ties, repeats, long texts and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandline.llm")
from strandline.llm import ann, chat, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, sharding, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, component_id long, keep_id long, key string, block int, size long"
BASE = " ".join(f"w{i}" for i in range(60))
LINE = "a line of text that is surely longer than forty characters"


def texts():
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(400)]
    out = [BASE, BASE, BASE + " tail", BASE.upper(), "  " + BASE.replace(" ", "\n"), "", None, " \t\n", "one", "one", "two words", "Ünïcode straße 'tis <|endoftext|> 12", "x" * 40_000, BASE.replace("w30", "CHANGED")]
    for i in range(60):
        body = " ".join(rng.choice(words, 30 + i))
        out += [body, body + " more"] if i % 3 == 0 else [body]
    for i in range(7):
        out.append(f"own {i}\n {LINE.upper() if i % 2 else LINE} \nend {i}\n\n")
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 1, 2, 3, 4, "k", 5, 6) for i, t in enumerate(texts())]
    return out + [(None, "a null id", None, "s1", None, None, None, None, None, None, None), out[9]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_near_groups(docs, none, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = sorted(((i, len(sets[i]), top(i) if i is not None else None) for i, *_ in rows), key=str)
    got = near_dedup.near_groups(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(none).count() == 0


def test_near_copies_under_one_doc_id(spark):
    """Rows of one doc_id are judged by their own text; other columns stay, whatever their names."""
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(5, BASE + " more"), (5, other), (1, BASE), (7, other + " tail"), (None, BASE), (9, "short"), (9, "short"), (12, None)]
    docs = spark.createDataFrame([(*r, 1, "n", 0.5) for r in rows], "doc_id long, text string, th int, node string, row double")
    got = near_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 56, 1, True), (5, 36, 5, True), (5, 57, 1, False), (7, 37, 5, False), (9, 1, 9, True), (9, 1, 9, True), (12, 0, 12, True)]
    left = near_dedup.without_near_copies(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None and r.text) == [(1, BASE), (5, other), (9, "short"), (9, "short")] and left.count() == 6


def test_long_texts_in_pieces():
    """Words, shingle sets and statistics are the same however small the pieces of a long text are."""
    import random

    import pyarrow as pa
    from strandline.llm import words as W

    r = random.Random(3)
    for _ in range(150):
        t = "".join(r.choice("aB c\n\td é") for _ in range(r.randint(0, 300)))
        raw, off = W.buffers(pa.array([t]))
        for piece in (1, 3, 7, 64):
            assert all((a == b).all() for a, b in zip(W.words_of(raw, off), W.words_of(raw, off, piece=piece)))
        raw2, off2 = W.buffers(pa.array([t, "x y"]))
        assert np.allclose(quality.statistics(raw2, off2)[0], quality.statistics(raw, off)[0])
        both, sizes = near_dedup.shingle_sets(raw2, off2)
        assert (both[: sizes[0]] == near_dedup.shingle_sets(raw, off)[0]).all()
    long = "x" * (3 << 20) + " " + "word " * 300_000  # a word of several pieces
    raw, off = W.buffers(pa.array([long]))
    hashes, size, per = W.words_of(raw, off)
    assert per.tolist() == [300_001] and size[0] == 3 << 20 and len(set(hashes.tolist())) == 2


def test_dense_regions_lose_no_link(spark):
    """A star of near copies that offer only one pair each still becomes what brute force finds."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 9), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), region=40, offers=1).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    up = list(range(80))
    for _ in range(80):
        for a in range(80):
            for b in range(80):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    assert got == dict(enumerate(up))


def test_overfull_regions_lose_no_link(spark):
    """A star of texts at about 0.78 from its middle and 0.6 from each other, whose regions are overfull at depths 3 and 6."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for k in rng.choice(300, 8, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), region=40).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    up = list(range(400))
    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    assert len(set(up)) < 40
    assert got == dict(enumerate(up))


def test_golomb():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        x = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64))
        x = np.sort(np.concatenate([x, x[:3]]))
        for rice in (0, 7, 30) if n < 3 else (25, 30, 36):
            if n and rice == 0:
                x = np.sort(x % np.uint64(1000))
            assert (exact_dedup.golomb_decoded(exact_dedup.golomb_coded(x, rice), len(x), rice) == x).all()


def test_exact_groups(docs, none, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = {}
    for i, t, *_ in rows:
        by.setdefault(norm(t), []).append((-len(t or ""), -1 if i is None else i, i))
    want = sorted(((i, min(by[norm(t)])[2], len(by[norm(t)]), i == min(by[norm(t)])[2], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=str) == want
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns and left.count() == len(by)


def test_copies_under_one_doc_id(spark):
    """Rows that repeat a doc_id are judged by their own text; whole repeats leave one row; clashing names stay."""
    rows = [(1, "long text here"), (5, "longtexthere"), (5, "unique other words"), (7, "a b"), (7, "ab"), (9, "q"), (9, "q"), (None, None), (None, ""), (None, "zz"), (11, " ")]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], "doc_id long, text string, sha string, row int, key0 string, hit double").repartition(3)
    kept = sorted(((r.doc_id, r.text, r.sha, r.row, r.key0, r.hit) for r in exact_dedup.without_copies(docs).collect()), key=str)
    assert kept == sorted(((i, t, "x", 1, "y", 0.5) for i, t in [(1, "long text here"), (5, "unique other words"), (7, "a b"), (9, "q"), (None, "zz"), (11, " ")]), key=str)
    flags = sorted((r.text_sha256[:4], r.doc_id, r.kept, r.keep_id) for r in exact_dedup.exact_groups(docs).collect() if r.doc_id in (5, 7))
    assert [f[1:] for f in flags if f[1] == 5] == [(5, True, 5), (5, False, 1)] and [f[2] for f in flags if f[1] == 7] == [False, True]


def test_equal_fingerprints_travel_once(monkeypatch):
    """A message names each fingerprint once, and says which it has more than once."""
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    texts = ["same"] * 500 + ["other", "third"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(502)), pa.array(texts)], ["doc_id", "text"])
    (message,) = list(exact_dedup._messages(1)(iter([batch])))
    assert message.column("n").to_pylist() == [3] and len(message.column("payload")[0].as_py()) < 40
    answer = next(exact_dedup._bitmaps(iter([message.select(["owner", "block", "n", "rice", "payload", "often"])])))
    whole = pa.RecordBatch.from_arrays([*message.columns, answer.column("bitmap")], [*message.schema.names, "bitmap"])
    out = next(exact_dedup._documents(iter([whole])))
    assert {i for i, s in zip(out.column(0).to_pylist(), out.column(3).to_pylist()) if s} == set(range(500))


def test_picking(spark):
    from strandline.llm import picking

    rows = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i}", i, i, i) for i in range(400)], "doc_id long, text string, row int, place int, own0 int")
    keys = spark.createDataFrame([(3,), (8,), (None,), (999,), (3,)], "k long")
    for words in (1, 4, picking.WORDS):  # a full bitmap lets everything through, and the join decides
        got = picking.picked(rows, [F.col("doc_id")], keys, words)
        rest = picking.without(rows, [F.col("doc_id")], keys, words)
        want = {r.text for r in rows.collect() if r.doc_id in (3, 8, None)}
        assert got.columns == rest.columns == rows.columns
        assert {r.text for r in got.collect()} == want and {r.text for r in rest.collect()} == {f"t{i}" for i in range(400)} - want


def test_mix(docs, none, rows):
    got = mixing.mixed(docs).collect()
    size = {}
    for i, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s], left = 2.0 * size[s], left - 2 * size[s]
        free -= over
    taken = {}
    src = {i: s for i, _, _, s, *_ in rows}
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in names) and len(got) == len(rows)
    small = mixing.mixed(docs, rows_per_block=2).select("doc_id", "taken").collect()
    assert sorted(map(tuple, small), key=str) == sorted(((r.doc_id, r.taken) for r in got), key=str)
    assert mixing.mixed(none).count() == 0
    assert mixing.mixture(docs).columns == docs.columns


def test_mixture_takes_whole_rows(docs, rows, spark):
    """As often as ``mixed`` says for whole documents, each with its own columns, whatever their names."""
    clashing = docs.withColumnsRenamed({"lang": "_hash", "n_chars": "_epoch", "key": "row", "block": "times", "keep_id": "src", "component_id": "last"})
    times = {}
    for r in mixing.mixed(docs, whole=True).collect():
        times[r.doc_id, r.text_hash] = max(times.get((r.doc_id, r.text_hash), 0), r.taken // r["size"] if r["size"] else 0)
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", mixing.text_hash(F.col("text")).alias("h")).collect()}
    want = sorted([r for r in rows for _ in range(times[r[0], hashes[r[0], r[1]]])], key=str)
    got = mixing.mixture(clashing)
    assert got.columns == clashing.columns and got.schema == clashing.schema
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > len(rows)
    assert sorted(map(tuple, mixing.mixture(clashing, rows_per_block=2).collect()), key=str) == want
    assert mixing.mixture(clashing.limit(0)).count() == 0


def test_mixture_of_null_ids(spark):
    """Null doc_ids are told apart by their texts, so they don't share one place of the order."""
    docs = spark.createDataFrame([(None, f"word{i} b c", "s") for i in range(64)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, rows_per_block=4).collect()
    assert len(got) == 64 and {r.taken for r in got} == {3, 6} and sum(r.taken for r in got) == 288


def test_quality(spark, none):
    good = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(40)) + ".", None) for i in range(150)]
    bad = [(i, ("BUY!!! NOW!!! " * 20), None) for i in range(150, 260)]
    odd = [(900, "", None), (901, None, None), (None, "null id", None), (902, "z" * 50_000, None)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 260)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, labels, 200)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert len(got) == 264 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == int(i < 150) for i, r in got.items() if i is not None and i < 900 and r.held_out]) > 0.95
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.scored(none, quality.fitted(none, labels.limit(0))).count() == 0
    flat = quality.scored(docs, quality.fitted(docs, labels.filter("quality = 1"))).select("score").distinct().count()
    assert flat == 1


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(docs, none, rows, shards):
    got = sharding.balanced_shards(sharding.measured(docs), shards).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    total, biggest, sums = sum(r["size"] for r in got), max(r["size"] for r in got), {}
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and 0 <= s < shards
        sums[s] = sum(r["size"] for r in own)
        assert abs(sums[s] - total / shards) <= biggest
        keys = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert keys == sorted(keys)
    assert sharding.balanced_shards(sharding.measured(none), shards).count() == 0


def test_lines(docs, none, rows):
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(-1 if i is None else i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != (-1 if i is None else i))]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = sorted((tuple(r) for r in line_dedup.without_common_lines(docs).collect()), key=str)
    assert got == sorted(want, key=str) and sum(r[2] for r in got) == 6
    assert line_dedup.without_common_lines(none).count() == 0


def test_lines_of_repeated_documents(spark):
    """Rows of one doc_id are one document, also where its rows lie in several partitions."""
    rows = [(i % 4, f"{LINE}\nrow {i}") for i in range(200)] + [(None, f"{LINE} {i}\n{LINE} five") for i in range(3)] + [(i, f"{LINE} five\nend") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.without_common_lines(docs).collect()
    # The first line is in four documents only; the other in five, of which the largest is 3.
    assert sum(r.n_dropped for r in got) == 3 + 3 and all("five" not in r.text for r in got if r.doc_id in (None, 0, 1, 2))
    assert line_dedup.without_common_lines(docs, min_docs=4).filter("doc_id = 3 and n_dropped > 0").count() == 0


def test_hot_line_over_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "\nown "), "id").alias("text"))
    got = line_dedup.without_common_lines(docs).filter("n_dropped = 0").collect()
    assert [r.doc_id for r in got] == [2999]


def test_packing(docs, none, rows):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.packed(packing.pieces(docs, path, 64), 64).collect()
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= plain_best_fit([w[3] for w in want], 64)
    assert packing.packed(packing.pieces(none, path)).count() == 0


def plain_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((size if fit is None else fit) - n)
    return len(rooms)


def test_best_fit_plan():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 65, 300).tolist()
        hist = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.best_fit(hist, 64)
        bins = {}
        for n, rank, number, first, per, offset in plan:
            for k in range(number):
                bins.setdefault(first + k // per, []).append((offset + k % per * n, n))
        assert sum(p[2] for p in plan) == 300 and len(bins) == plain_best_fit(lengths, 64)
        for own in bins.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 64


def test_tokenizer_chunks():
    import random

    ids = packing.Ids(packing.tokenizer_path())
    parts = list("aBcÉéΣσςİıß'’\"!.,|<>_-09²½٣ \t\n\x0b\x1c\xa0　×÷字́̇") + ["'s", "'LL", "<|endoftext|>", "<|StartOfText|>", "!!", "..."]
    r = random.Random(3)
    xs = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for x, got in zip(xs, ids.of([x.encode() for x in xs])):
        assert got == np.array(ids.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer that keeps case, or has no mark at the end of words, is never fed by chunks."""
    import json

    path = packing.tokenizer_path()
    assert packing.Ids(path).by_chunks
    form = json.load(open(path))
    cased = form | {"normalizer": None}
    unmarked = form | {"model": form["model"] | {"end_of_word_suffix": None}}
    for name, other in (("cased", cased), ("unmarked", unmarked)):
        (tmp_path / name).write_text(json.dumps(other))
        ids = packing.Ids(str(tmp_path / name))
        texts = ["Some Text, with CASE", "a  b\nC", "", "don't!"]
        assert not ids.by_chunks
        assert list(ids.of([t.encode() for t in texts])) == [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_gives_memory_back(monkeypatch):
    """A worker tokenises about a megabyte at a time, and returns unused memory before a task, after each batch and after the task."""
    from types import SimpleNamespace

    from strandline.llm import lean

    given, groups = [], []
    monkeypatch.setattr(lean, "give_back", lambda: given.append("task"))
    monkeypatch.setattr(packing, "give_back", lambda: given.append("batch"))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "ids_of", lambda path: SimpleNamespace(of=lambda texts: (groups.append(sum(map(len, texts))), iter([b""] * len(texts)))[1]))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50), pa.int64()), "text": ["x" * 100_000] * 50})
    rows = list(packing._pieces("", 64, 0, False)(iter([batch, batch])))
    assert sum(r.num_rows for r in rows) == 100 and sum(groups) == 10_000_000
    assert max(groups) < (1 << 20) + 100_000
    assert given == ["task", "batch", "batch", "task"]


def test_unused_memory_is_returned():
    from strandline.llm.lean import lean

    pool = pa.default_memory_pool()
    run = lean(lambda batches: batches)
    batch = pa.RecordBatch.from_pydict({"x": pa.array(range(1000), pa.int64())})
    assert [b.num_rows for b in run(iter([batch, batch]))] == [1000, 1000]
    assert list(run(iter([]))) == [] and pool.bytes_allocated() >= batch.nbytes


def test_trees_against_plain_traversal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7))
    trees = quality.Trees(0.3, rng.integers(0, 7, (9, 7)), rng.normal(size=(9, 7)), rng.normal(size=(9, 8)))
    for row, score in zip(x, trees.scores(x)):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - 7]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_splits_against_plain_search():
    """One tree of depth 2: each node's split has the greatest gain of all features and thresholds, tried one by one."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 2] > 0.2) & (x[:, 0] < 0.5) | (rng.random(300) < 0.1)).astype(float)
    bins = 16
    model = quality.trained(x, y, trees=1, depth=2, bins=bins)
    share = (y.sum() + 0.5) / 301
    grad, hess = y - share, np.full(300, share * (1 - share))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(4)]
    value = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + quality.L2)
    rows = {0: np.ones(300, bool)}
    for node in range(3):
        own, best = rows[node], 0.0
        for j in range(4):
            for c in cuts[j]:
                low = own & (x[:, j] <= c)
                high = own & ~(x[:, j] <= c)
                if min(hess[low].sum(), hess[high].sum()) >= quality.LEAST / 4:
                    best = max(best, value(low) + value(high) - value(own))
        f, t = model.feature[0, node], model.threshold[0, node]
        rows[2 * node + 1], rows[2 * node + 2] = own & (x[:, f] <= t), own & (x[:, f] > t)
        got = value(rows[2 * node + 1]) + value(rows[2 * node + 2]) - value(own) if np.isfinite(t) else 0.0
        assert abs(got - best) < 1e-9 and (node or best > 1)
    for leaf in range(4):
        m = rows[3 + leaf]
        assert abs(model.leaf[0, leaf] - quality.RATE * grad[m].sum() / (hess[m].sum() + quality.L2)) < 1e-12


VECS = "vec_id long, embedding array<float>, label int, score double"


def brute(vecs, queries, k):
    use = [(i, np.array(v, float)) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = []
    for q, v in use:
        if q % queries == 0:
            near = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), i) for i, w in use if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def odd_vectors():
    rng = np.random.default_rng(4)
    vecs = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    vecs += [(i, vecs[7][1]) for i in range(200, 260)]
    return vecs + [(300, None), (310, [0.0] * 8), (320, [float("nan")] * 8), (330, [1.0, None] + [1.0] * 6), (None, [1.0] * 8), (340, [1.0, 2.0]), (350, [float("inf")] + [1.0] * 7)]


@pytest.mark.parametrize("schema, per_block", [(VECS, 50_000), (VECS.replace("float", "double"), 20)])
def test_search_that_visits_everything(spark, schema, per_block):
    vecs = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in vecs], schema)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(df, F.col("vec_id") % 10 == 0, 5, scale=1e9, per_block=per_block).orderBy("query_id", "rank").collect()]
    want = brute(vecs, 10, 5)
    assert got == [(q, r, v, round(s, 12)) for q, r, v, s in sorted(want)]


def test_search_of_few(spark):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in odd_vectors()], VECS)
    assert ann.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 10 == 0).count() == 2
    assert ann.search(df.filter("vec_id = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_search_recall(spark):
    """With the defaults, at least 0.9 of all queries' true neighbours, although well below half of the vectors are visited."""
    rng = np.random.default_rng(8)
    n, dim = 12_000, 24
    x = rng.normal(size=(n, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    assert ann.visits(n) < 0.4 * n and ann.visits(10**9) < 0.05 * 10**9
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = unit[::20] @ unit.T
    near[np.arange(n // 20), np.arange(0, n, 20)] = -2
    true = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(got[20 * q] & set(t.tolist())) for q, t in enumerate(true))
    assert len(got) == n // 20 and hits / true.size >= 0.9


def test_block_plan():
    sizes = np.array([3, 4, 3, 25, 0, 1, 9, 2])
    first, parts, place = ann.block_plan(sizes, 10)
    homes = {}
    for c, n in enumerate(sizes.tolist()):
        assert n <= 10 * parts[c]
        for p in range(parts[c]):
            homes.setdefault(int(first[c]) + p, []).append(c)
    assert all(len(own) == 1 or sum(sizes[own]) <= 10 for own in homes.values())
    assert all(sorted(place[own].tolist()) == list(range(len(own))) for own in homes.values()) and [3] in homes.values() and sum(own == [3] for own in homes.values()) == 3


def test_walk_is_ordered():
    """As if all pairs were sorted by their sum, whatever the tiles."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        d1, d2 = rng.random(rng.integers(1, 21)), rng.random(rng.integers(1, 19))
        counts = rng.integers(0, 3, (len(d1), len(d2)))
        counts[0, 0] = 1
        every = sorted((d1[a] + d2[b], a, b) for a, b in zip(*np.nonzero(counts)))
        for enough in (1, 5, int(counts.sum() * 0.4), int(counts.sum()), 10_000):
            want, held = [], 0
            for _, a, b in every:
                if held >= enough:
                    break
                want.append((a, b))
                held += counts[a, b]
            for tile in (1, 3, 8):
                assert [tuple(x) for x in ann.walk(d1, d2, counts, enough, tile).tolist()] == want or not enough


def test_chat(spark):
    forged = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", forged), (1, 2, "user", None), (1, 3, "assistant", "b\\b\\h###</turn>"), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, 0, None, "x"), (4, None, "as:sis\ntant", "y"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    segs = chat.segments(turns)
    exs, texts = chat.examples(segs), chat.written(segs)
    got = {r.conv_id: r for r in chat.read_back(texts, exs).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.rendered(segs, exs).orderBy("conv_id", "example").collect()
    assert len(ex) == 5
    for c in {r[0] for r in rows}:
        rest = sum(len(s.segment) for s in segs.collect() if s.conv_id == c) - max([len(r.text) for r in ex if r.conv_id == c], default=0)
        assert got[c].formatted_chars == sum(len(r.text) for r in ex if r.conv_id == c) + rest
    # An example with a wrong context, target or mask shows in the result.
    of = lambda e: {r.conv_id: (r.loss_sha256, r.n_examples) for r in chat.read_back(texts, e).collect()}
    second = (F.col("conv_id") == 1) & (F.col("example") == 1)
    right = of(exs)
    for column, wrong in [("context_chars", F.col("context_chars") + 1), ("context_chars", F.lit(0).cast("long")), ("loss_from", F.col("loss_from") - 1), ("loss_chars", F.col("loss_chars") + 1), ("segment", F.concat(F.col("segment"), F.lit("x")))]:
        bent = of(exs.withColumn(column, F.when(second, wrong).otherwise(F.col(column))))
        assert bent[1] != right[1] and {c: v for c, v in bent.items() if c != 1} == {c: v for c, v in right.items() if c != 1}
    two = [r for r in ex if r.conv_id == 1][1]
    assert two.text.startswith("### user: hi</turn>\n") and two.text.count("### ") == 4 and two.text.count("</turn>") == 4
    assert two.text[two.loss_from :][: two.loss_chars] == "b\\bb\\bh\\h\\e"
    none = chat.segments(turns.limit(0))
    assert chat.read_back(chat.written(none), chat.examples(none)).count() == 0


def test_chat_writes_every_example_out(spark):
    forged = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", forged), (1, 2, "user", None), (1, 3, "assistant", "b\\b\\h###</turn>"), (1, 4, "assistant", "é\n"), (1, 5, "user", "bye"), (1, 6, "user", forged), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, 0, None, "x"), (4, None, "as:sis\ntant", "y"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "assistant: ", "no"), (6, 1, None, None)]
    segs = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.output(segs).cache()
    whole = {r.conv_id: r.text for r in chat.written(segs).collect()}
    got = {c: sorted((r for r in out.collect() if r.conv_id == c), key=lambda r: (r.example is None, r.example)) for c in whole}
    for c, text in whole.items():
        shown = [r for r in got[c] if r.example is not None]
        assert [r.example for r in shown] == list(range(sum(1 for x in rows if x[0] == c and x[2] == "assistant")))
        assert all(text.startswith(r.text) and r.text.endswith("</turn>\n") for r in shown)
        assert "".join(r.text for r in got[c] if r.example is None) == text[len(shown[-1].text) if shown else 0 :]
    assert [r.text.count("### ") for r in got[1]] == [2, 4, 5, 2]
    result = lambda o: {r.conv_id: tuple(r) for r in chat.read_examples(o).collect()}
    right = result(out)
    short = chat.read_back(chat.written(segs), chat.examples(segs)).collect()
    assert right == {r.conv_id: tuple(r) for r in short}
    second = (F.col("conv_id") == 1) & (F.col("example") == 1)
    bends = [("text", F.expr("substr(text, 21)")), ("text", F.expr("replace(text, '### user: hi<', '### user: ho<')")), ("loss_from", F.col("loss_from") - 1), ("loss_chars", F.col("loss_chars") + 1), ("text", F.concat("text", F.lit("### user: x</turn>\n")))]
    for column, wrong in bends:
        bent = result(out.withColumn(column, F.when(second, wrong).otherwise(F.col(column))))
        assert bent[1] != right[1] and {c: v for c, v in bent.items() if c != 1} == {c: v for c, v in right.items() if c != 1}
    assert result(out.filter(~F.coalesce(second, F.lit(False))))[1] != right[1]
    assert chat.read_examples(chat.output(segs.limit(0))).count() == 0


def test_warc(spark):
    big = "é" * 300_000
    rows = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "ü", big), (None, "n", "same"), (7, "u", "own"), (7, "u", "own")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        first = min(same)
        want.append((i, len(raw), warc.base32_sha1(raw), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert sorted((tuple(r) for r in warc.round_trip(pages, file_bytes=1).collect()), key=str) == got  # a file for each record


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Pages that don't compress, of very different sizes: no file has more than the bound and one record."""
    import os
    import random

    r = random.Random(5)
    sizes = [200, 300_000, 50, 80_000, 80_000, 10] * 5
    rows = [(i, "u", "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3))) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, f"{tmp_path}/w", file_bytes=100_000)
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/w") for f in names if f.startswith("part-")]
    assert len(files) > 5 and max(map(os.path.getsize, files)) < 100_000 + 310_000
    back = {x.page_id: x.payload for x in warc.read_archives(spark, f"{tmp_path}/w", payloads=True).collect()}
    assert back == {i: h.encode() for i, _, h in rows}


def test_warc_member_of_any_last_byte():
    """Members that don't end in zero (16 MiB and more) are followed by an empty one."""
    import gzip

    content = warc.record(1, "u", b"abc", None, False)
    member = gzip.compress(content)
    for odd in (member, member[:-1] + b"\1"):
        row = warc.row_of(odd) + b"\0"
        assert row.startswith(odd) and row[-1] == 0 and (row == odd) == (odd[-1] == 0)
    big = warc.record(2, "u", b"z" * (17 << 20), None, False)
    row = warc.row_of(gzip.compress(big, 1)) + b"\0"
    found = [warc.parsed(x) for x in warc.members(row)]
    assert [x["payload_bytes"] for x in found if x] == [17 << 20] and found[1:] == [None]


def test_warc_checks():
    member = __import__("gzip").compress(warc.record(1, "u", b"abc", None, False))
    row = warc.row_of(member) + b"\0"
    assert warc.parsed(next(warc.members(row)))["payload"] == b"abc"
    with pytest.raises(warc.WarcError):
        list(warc.members(member[:-9]))
    with pytest.raises(warc.WarcError):
        warc.parsed(warc.record(1, "u", b"abc", None, False).replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
