"""Base operators: registered queries against their SQL, and worked examples."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import assemble as A
from strandline.operators import compare as C
from strandline.operators import graph as G
from strandline.operators import kmers as K
from strandline.operators import phase as H
from strandline.operators import pipelines as P
from strandline.operators import reads as R
from strandline.operators import variants as V
from strandline.operators import windows as W
from strandline.operators.components import components
from strandline.plans import ORACLES, QUERIES, load_all
from strandline.sources import formats, sinks

load_all()
SF = "/root/testdata/sf0.001"
SOME = ["A4_kmer_histogram", "A1_read_stats", "F4_clip", "F6_clip_to_window", "J1_read_windows", "A9_window_coverage", "W8_segments", "W2_context_numbers", "C1_greedy_repair", "X7_normalised", "A21_snp_calls", "J12_J13_incidents", "A12_deduplicated", "U1_intersection", "F9_edge_prune", "J9_H3_paired_edges", "S10_S11_vcf", "W9_event_windows", "A2_kmer_canonical", "A20_position_coverage", "G12_without_dead_ends", "J15_Y4_majority_repair", "H1_adjacent_edges", "H2_homozygous", "H5_H7_phased", "P1_phased_vcf", "G18_spelled_haplotypes", "X10_alignment_gaps", "Y1_Y2_simulated_reads", "Y3_recovered", "H6_paired_conflicts", "K5_variant_dot", "G13_contracted", "K4_dot_vertices", "K4_edges_by_stage", "A18_changes_per_read", "A18_planted_by_distance", "A18_removed_shortened", "C4_recoded_quality", "C5_C6_trimmed_after"]


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in ("region", "lineitem", "events", "orders"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols and got
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert [str(x) for x in got] == [str(x) for x in want] or got == want


def test_reference_vertices_of_a_repeat(spark):
    rows = G.reference_vertices(spark.createDataFrame([(0, "ATCTGTATATATG")], "contig int, seq string"), 5, ["contig"]).orderBy("pos").collect()
    assert [(r.kmer, r.ctx) for r in rows] == [("BATCT", 0), ("ATCTG", 0), ("TCTGT", 0), ("CTGTA", 0), ("TGTAT", 0), ("GTATA", 0), ("TATAT", 0), ("ATATA", 0), ("TATAT", 1), ("ATATG", 0), ("TATGB", 0)]


def test_clip_by_cigar(spark):
    df = spark.createDataFrame([("4M2I3M1D1M", "ACGTACGTAC"), ("2S3M5S", "ACGTACGTAC"), ("3N7M", "ACGTACGTAC"), ("*", "ACGTACGTAC"), (None, "AC"), ("2H2S6M2S3H", "ACGTACGTAC")], "cigar string, seq string").withColumn("qual", F.col("seq"))
    assert [r.seq for r in R.without_clips(df).collect()] == ["ACGTACGTAC", "GTA", "ACGTACGTAC", "ACGTACGTAC", "AC", "GTACGT"]


def test_quality_cap_equals_value_by_value(spark):
    marks = "".join(map(chr, range(33, 128)))
    rows = [(q, m) for q in (marks, "I", "#5I~I#", "é!I", "Iñ5") for m in (None, 0, 10, 60, 93, 94, 200, -1)] + [(None, 5), ("", 5)]
    df = R.capped_quality(spark.createDataFrame(rows, "qual string, mapq int"))
    want = [q and "".join(c if m is None else chr(min(ord(c), m + 33)) for c in q) for q, m in rows]
    assert [r.qual for r in df.collect()] == want
    many = spark.range(20000).select(F.repeat(F.lit("I5#"), 400).alias("qual"), (F.col("id") % 5 + 30).cast("int").alias("mapq"))
    assert R.capped_quality(many).groupBy("qual").count().count() == 5


def odd_window():
    """A reference with a repeat, and reads of two haplotypes over it, many alike, with bad bases and an id of two rows."""
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    ref = base[:200] + base[60:110] + base[200:]
    snp = ref[:140] + "ACGT"[("ACGT".index(ref[140]) + 1) % 4] + ref[141:]
    more = snp[:290] + "GATTA" + snp[290:]
    rows = []
    for n in range(900):
        hap, at = (ref, snp, more)[n % 3], rng.randrange(0, 270)
        qual = [40] * 60 if n % 7 else [40] * 30 + [5] + [40] * 29
        rows.append((at, f"r{n if n % 50 else 0}", hap[at : at + 60], qual if n % 5 else [rng.choice([2, 30]) for _ in range(60)], 0))
    return ref, sorted(rows, key=lambda r: r[:2])


@pytest.mark.parametrize("repeat, twice", [(True, True), (True, False), (False, True), (False, False)])
def test_alike_reads_as_one_give_the_variants_of_all(repeat, twice):
    ref, rows = odd_window()
    if not repeat:
        ref, rows = ref[:200], [r for r in rows if r[0] < 140]
    if not twice:
        rows = [r for r in rows if r[1] != "r0"]
    each = [A.Read(i, s, q, o) for _, i, s, q, o in rows]
    groups = {}
    for at, i, s, q, o in rows:
        groups.setdefault((s, o, tuple(x >= A.GOOD for x in q)), A.Alike(s, q, o, [])).reads.append((at, i))
    options = A.Options(k=15)
    want = A.window_variants(ref, 7, "c", each, options)
    assert want and len(groups) < len(each) and A.window_variants(ref, 7, "c", list(groups.values())[::-1], options) == want


def test_window_starts(spark):
    rows = spark.createDataFrame([(2000,), (2001,), (5000,), (1999,)], "n bigint").select(W.window_starts(F.col("n"), 2000, 1500).alias("w")).collect()
    assert [r.w for r in rows] == [[0], [0, 1], [0, 1500, 3000], []]


def test_grid_equals_brute_force(spark):
    pos = spark.range(0, 5000, 7).withColumn("w", W.grid_starts(F.col("id"), F.lit(60), F.lit(5060), 500, 375))
    starts = [*range(0, 4560, 375), 4560]
    for r in pos.collect():
        assert sorted(r.w) == [s for s in starts if s <= r.id < s + 500 or s <= r.id + 60 < s + 500]


def test_alignment():
    assert A.alignment("ACGTACGT", "ACGTACGT") == "MMMMMMMM"
    assert A.alignment("ACGTACGTACGT", "ACGTTCGTACGT") == "MMMMXMMMMMMM"
    assert A.alignment("AACCGGTTAACC", "AACCGGAACC").count("D") == 2
    assert A.alignment("", "AC") == "II" and A.alignment("AC", "") == "DD"


def test_planted_variants_are_recovered():
    import random

    r = random.Random(11)
    ref = "".join(r.choice("ACGT") for _ in range(600))
    alt = ref[:200] + ref[204:350] + "GATTACA" + ref[350:]
    snp = alt[:120] + ("A" if alt[120] != "A" else "C") + alt[121:]
    reads = [A.Read(f"{k}{i}", s[i : i + 80], [40] * 80) for k, s in enumerate((ref, snp)) for i in range(0, len(s) - 80, 3)]
    calls = A.window_variants(ref, 0, "c", reads)
    hap = ref
    for c in sorted(calls, key=lambda c: -c["pos"]):
        assert hap[c["pos"] - 1 : c["pos"] - 1 + len(c["ref"])] == c["ref"]
        hap = hap[: c["pos"] - 1] + c["alt"] + hap[c["pos"] - 1 + len(c["ref"]) :]
    assert hap == snp and len(calls) == 3


def test_repeat_reads_are_kept_apart():
    w = A.Window("A" * 10, 3, A.Options(threshold=1))
    for u, v, x in (("p", "r", "q"), ("s", "r", "t")):
        for i in range(3):
            w.edges.setdefault((u, v), []).append((f"{u}{i}", 5, 40))
            w.edges.setdefault((v, x), []).append((f"{u}{i}", 6, 40))
    w.split_repeats()
    assert sorted((u[0], v[0]) for u, v in w.edges) == [("p", "r"), ("r", "q"), ("r", "t"), ("s", "r")]
    assert len({v for u, v in w.edges if u in "ps"}) == 2


def test_components_by_both_ways(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 300), (500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert {r.node: r.component for r in components(df, finish=0).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_two_colours():
    assert H.two_colours([1, 2, 3, 4], {4}, [(1, 1, 2, 1, 5), (2, 1, 3, 0, 6), (3, 0, 4, 1, 9)]) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert dict(H.two_colours([1, 2, 3], set(), [(1, 1, 2, 1, 5), (2, 1, 3, 1, 5), (1, 1, 3, 0, 5)]))[3] in (0, 1, 2)


def test_binomial_agrees(spark):
    rows = spark.createDataFrame([(r, a) for r in range(0, 30, 3) for a in range(0, 60, 7)], "r int, a int").select("r", "a", V.binomial_percent(F.col("r"), F.col("a")).alias("b")).collect()
    assert all(r.b == A.binomial_percent(r.r, r.a) for r in rows)


def test_haplotype_containment():
    ref = "ACGTACGTTTGGCCAATTGG"
    assert C.spelled(ref, 1, [(4, "T", "G")], [(4, "T", "G")]) == [True]
    assert C.spelled(ref, 1, [(4, "T", "G")], []) == [False]
    assert C.spelled(ref, 1, [(4, "TACG", "T")], [(4, "TACG", "T")]) == [True]
    assert C.spelled(ref, 1, [(4, "TA", "GC")], [(4, "T", "G"), (5, "A", "C")]) == [True]


def test_peeling():
    edges = [("s", "a"), ("a", "b"), ("b", "e"), ("a", "x"), ("x", "y"), ("z", "b")]
    assert G.peeled(edges, {"s", "e"}) == [True, True, True, False, False, False]


def test_automatic_k():
    assert [K.automatic_k(n) for n in (100, 5000, 10**6, 10**9)] == [11, 13, 17, 21]


def test_bad_sam_lines(spark):
    good = "r\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII"
    df = spark.createDataFrame([("@HD",), (good,), (good.replace("IIII", "III"),), (good.replace("\t0\tc", "\t0x10\tc"),)], "value string")
    rows = formats.parse_sam(df, strict=False).collect()
    assert [r.corrupt for r in rows] == [False, True, False] and rows[2].flag == 16 and rows[0].pos0 == 4
    with pytest.raises(Exception, match="malformed"):
        formats.parse_sam(df).collect()


def test_vcf_of_many_alleles(spark):
    df = spark.createDataFrame([("#CHROM",), ("1\t5\t.\tA\tC,GT\t.\t.\t.",)], "value string")
    assert [(r.alt, r.allele) for r in formats.parse_vcf(df).collect()] == [("C", 0), ("GT", 1)]


def test_stream_equals_batch(spark):
    from strandline.functions.bridge import reads
    from strandline.streaming.reads import good_read_counts, run_once

    path = f"/tmp/strandline-test-{id(spark)}"
    table = reads(spark, SF)
    table.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    want = sorted(map(tuple, good_read_counts(table).collect()))
    assert sorted(map(tuple, run_once(good_read_counts(stream), "good_counts").collect())) == want


def test_fasta_lines_wrap(spark):
    df = spark.createDataFrame([("c:101", "A" * 130)], "name string, seq string")
    assert [len(x) for x in sinks.fasta_lines(df).first().value.split("\n")] == [6, 60, 60, 10]


def test_normalised_prefix(spark):
    df = spark.createDataFrame([(10, "ACGT", "ACT"), (10, "A", "AC"), (10, "AAA", "AAA"), (5, "GT", "CT")], "pos int, ref string, alt string")
    assert [tuple(r) for r in V.normalised(df).collect()] == [(12, "GT", "T"), (10, "A", "AC"), (12, "A", "A"), (5, "GT", "CT")]


def test_planted_errors_are_repaired():
    import random

    from strandline.operators import correct as X

    r = random.Random(4)
    ref = "".join(r.choice("ACGT") for _ in range(400))
    counts = {}
    for i in range(len(ref) - 14):
        counts[X.canonical(ref[i : i + 15])] = (20, 20)
    for start in range(0, 340, 5):
        read = ref[start : start + 60]
        assert X.both_ways(read, [40] * 60, 15, counts, 8) == (read, 0)
        at = 20 + start % 25
        bad = read[:at] + ("A" if read[at] != "A" else "C") + read[at + 1 :]
        fixed, n = X.both_ways(bad, [40] * 60, 15, counts, 8)
        assert n == 1 and fixed.upper() == read and fixed[at].islower()


def test_two_errors_within_a_kmer_are_repaired(spark):
    import random

    from strandline.operators import correct as X

    r = random.Random(6)
    ref = "".join(r.choice("ACGT") for _ in range(300))
    clean = [(f"c{i}", ref[i : i + 60], "I" * 60, ref[i : i + 60]) for i in range(241)]
    wrong = lambda s, at: s[:at] + {"A": "G", "C": "T", "G": "A", "T": "C"}[s[at]] + s[at + 1 :]
    bad = [(f"b{i}", wrong(wrong(ref[i : i + 60], 20 + i % 15), 30 + i % 15 + i % 5), "I" * 60, ref[i : i + 60]) for i in range(60, 180, 7)]
    bad += [(f"n{i}", ref[i : i + 25] + "N" + ref[i + 26 : i + 29] + "N" + ref[i + 30 : i + 60], "I" * 60, ref[i : i + 60]) for i in range(60, 180, 30)]
    rows = spark.createDataFrame(clean + bad, "id string, seq string, qual string, truth string")
    counts = K.count_canonical(rows.filter("id like 'c%'"), 15)
    got = {x.id: x.fixed.upper() for x in X.corrected(rows, counts, 15, 8).collect()}
    assert got == {x[0]: x[3] for x in clean[8:-8] + bad} | {k: got[k] for k in [x[0] for x in clean[:8] + clean[-8:]]}


def test_more_ways_than_most_paths():
    import itertools
    import random

    r = random.Random(12)
    ref = "".join(r.choice("ACGT") for _ in range(300))
    sites, reads = [140, 145, 150, 155, 160], []
    for n, swap in enumerate(itertools.product([False, True], repeat=5)):
        hap = list(ref)
        for at, s in zip(sites, swap):
            if s:
                hap[at] = {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[at]]
        reads += [A.Read(f"{n}-{i}", "".join(hap[i : i + 80]), [40] * 80) for i in range(0, 221, 3)]
    hap = ref[:230] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[230]] + ref[231:]
    reads += [A.Read(f"h{i}", hap[i : i + 80], [40] * 80) for i in range(0, 221, 3)]
    calls = A.window_variants(ref, 0, "c", reads)
    want = {(at + 1, ref[at], {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[at]]) for at in [*sites, 230]}
    assert {(c["pos"], c["ref"], c["alt"]) for c in calls} == want
    assert all(c["ks"] == 21 for c in calls)


@pytest.mark.parametrize("name", ["J4_support_intersection", "J5_support_difference", "U3_support_union", "U4_support_merge", "A10_O6_supporting_reads"])
def test_supports_of_all_successive_edges(spark, con, name):
    """Counts and hashes, for there are many rows."""
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    n = con.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0]
    key = "array_join(reads, ',')" if "reads" in cols else "concat(read, '/', pos, '/', q)"
    got = {r[0] for r in df.select(F.md5(F.concat_ws("/", "contig", "src", "dst", "next", F.expr(key)))).collect()}
    text = key.replace("array_join", "array_to_string") if "reads" in cols else "read || '/' || pos || '/' || q"
    want = {r[0] for r in con.execute(f"select md5(contig || '/' || src || '/' || dst || '/' || next || '/' || {text}) from ({ORACLES[name]})").fetchall()}
    assert df.count() == n > 0 and got == want


def test_windows_of_segments(spark):
    """Reads meet the windows of their own segment, wherever runs of N begin and end."""
    import random

    from strandline.operators import pipelines as P

    r = random.Random(21)
    body = "".join(r.choice("ACGT") for _ in range(4000))
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    for lead, gap in ((0, 0), (100, 0), (100, 57), (0, 3000)):
        # A run of N in the middle, and one site in each half.
        ref = "N" * lead + body[:2000] + "N" * gap + body[2000:]
        sites = [lead + 700, lead + gap + 2700]
        hap = "".join(swap[c] if i in sites else c for i, c in enumerate(ref))
        reads = [(f"{i}", 0, i, hap[i : i + 100], "I" * 100) for i in range(0, len(hap) - 100, 7) if "N" not in hap[i : i + 100] and lead + 300 < i < lead + gap + 3300]
        df = spark.createDataFrame(reads, "id string, contig int, pos0 long, seq string, qual string")
        # Windows at the contig's ends, and in a gap, have no reads.
        calls = P.called(df, spark.createDataFrame([(0, ref)], "contig int, seq string"), 1000).collect()
        assert sorted((c.pos, c.ref, c.alt) for c in calls) == [(s + 1, ref[s], swap[ref[s]]) for s in sites]


def test_assigned_in_equals_brute_force(spark):
    segs = [("c", 0, 700, True), ("c", 700, 50, False), ("c", 750, 1300, True), ("c", 2050, 10, False), ("c", 2060, 400, True), ("d", 0, 500, True)]
    wins = {("c", o + s) for c, o, n, v in segs if c == "c" and v and n >= 500 for s in [*range(0, n - 500, 375), n - 500]} | {("d", 0)}
    reads = [(f"{c}{p}", c, p, "A" * 60) for c in "cd" for p in range(0, 2500, 3)]
    got = W.assigned_in(spark.createDataFrame(reads, "id string, contig string, pos0 long, seq string"), spark.createDataFrame(segs, "contig string, offset long, length long, valid boolean"), 500, 375).collect()
    want = sorted((i, w) for i, c, p, s in reads for d, w in wins if c == d and (w <= p < w + 500 or w <= p + 60 < w + 500))
    assert sorted((r.id, r.win) for r in got) == want


def test_scratch_is_removed(spark):
    import os

    from strandline.session import scratch, scratch_path, staged

    place = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with scratch(spark):
        with scratch(spark):
            gone, kept = staged(spark.range(3), "gone"), staged(spark.range(4), "kept", keep=True)
            paths = place(gone), place(kept)
            assert all(map(os.path.isdir, paths)) and gone.count() == 3
        assert [os.path.isdir(p) for p in paths] == [False, True] and kept.count() == 4
    assert not os.path.isdir(paths[1])
    assert scratch_path(spark, "free") != scratch_path(spark, "free")


def test_packed_kmers_equal_strings(spark):
    """The numbers' kernel against plain strings, with other letters, short and null reads, however small the pieces are."""
    import random

    import numpy as np
    from strandline.operators import packed as P

    r = random.Random(2)
    seqs = ["".join(r.choice("ACGTACGTACGTN") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "ACGT", "acgtacgtacgt", "GATTACA" * 9]
    rows = [(i, i % 3 if i % 7 else None, s, "".join(chr(r.randint(35, 73)) for _ in s or "") if s is not None else None) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "id long, contig int, seq string, qual string").repartition(3)
    for k in (1, 5, 31):
        want = {}
        for s in seqs:
            for i in range(len(s or "") - k + 1):
                want[s[i : i + k]] = want.get(s[i : i + k], 0) + 1
        assert {x.kmer: x.n for x in K.count_plain(df, k).collect()} == want
    comp = str.maketrans("ACGT", "TGCA")
    canon, flags = {}, {}
    for i, _, s, q in rows:
        for a in range(len(s or "") - 6):
            x = s[a : a + 7]
            plain = set(x) <= set("ACGT")
            flags[i, a] = plain
            if plain:
                e = canon.setdefault(min(x, x[::-1].translate(comp)), [0, 0])
                e[0] += 1
                e[1] += all(ord(c) - 33 >= 20 for c in q[a : a + 7])
    counted = K.count_canonical(df, 7)
    assert {x.kmer: (x.occ, x.occ_hi) for x in counted.collect()} == {x: (min(a, 255), min(b, 63)) for x, (a, b) in canon.items()}
    assert {(x.id, x.i): bool(x.solid) for x in K.solid(df, counted, 7, 1).collect()} == flags
    steps = G.edge_support(G.read_edges(df.withColumnRenamed("id", "read"), 6, ["contig"]), ["contig"])
    assert sorted(map(str, G.support_of_reads(df, 6, ["contig"]).select(*steps.columns).collect())) == sorted(map(str, steps.collect()))
    off = np.cumsum([0, 9, 0, 30, 3, 12])
    for piece in (1, 4, 100):
        got = [(a, b) for row, i, _, _ in P.windows(off, 5, piece) for a, b in zip(row.tolist(), i.tolist())]
        assert got == [(a, b) for a, n in enumerate([9, 0, 30, 3, 12]) for b in range(n - 4)]


def test_position_coverage_by_differences(spark):
    import random

    r = random.Random(9)
    B = W.COVERAGE_BLOCK
    rows = [(r.choice("xy"), p, "A" * n) for p, n in [(0, 5), (3, 5), (B - 3, 10), (B - 3, 3), (B, 2), (5 * B - 1, 2 * B + 5), (7 * B, 0), (9 * B, 7)] for _ in range(3)]
    want = {}
    for c, p, s in rows:
        for i in range(p, p + len(s)):
            want[c, i] = want.get((c, i), 0) + 1
    got = W.position_coverage(spark.createDataFrame(rows, "contig string, pos0 long, seq string")).collect()
    assert len(got) == len(want) and {(x.contig, x.pos): x.depth for x in got} == want


def test_alternates_on_both_by_pairs():
    """Of every small graph without noise, the variants planted on both haplotypes come out as 3, the rest by their side."""
    import itertools

    for kinds in itertools.product((1, 2, 3), repeat=4):
        if kinds[0] != 1:
            continue
        edges = []
        for (a, ka), (b, kb) in itertools.combinations(enumerate(kinds), 2):
            for hap in (1, 2):
                edges.append((a, int(ka in (hap, 3)), b, int(kb in (hap, 3)), 5))
        edges = sorted(set(edges))
        assert dict(H.without_conflicts([0, 1, 2, 3], set(), edges, [True] * len(edges))) == dict(enumerate(kinds))
    tie = [(0, 1, 1, 1, 5), (0, 1, 1, 0, 5), (0, 0, 1, 0, 5)]
    assert dict(H.without_conflicts([0, 1], set(), tie, [False] * 3))[1] in (0, 1)


def joined_by_force(edges, ranked):
    """One vertex at a time, looked for among all edges."""
    edges = list(edges)
    for v in ranked:
        into, out = [e for e in edges if e[1] == v], [e for e in edges if e[0] == v]
        if len(into) == len(out) == 1 and into[0] != out[0]:
            (u, _, x, n, s), (_, w, y, m, t) = into[0], out[0]
            if u != w and not any(e[:2] == (u, w) for e in edges):
                edges = [e for e in edges if e not in (into[0], out[0])] + [(u, w, x + y, max(n, m), s + t)]
    return sorted(edges)


def test_joined_equals_brute_force():
    import random

    r = random.Random(5)
    for _ in range(300):
        names = "abcdefgh"[: r.randint(2, 8)]
        pairs = {(r.choice(names), r.choice(names)) for _ in range(r.randint(1, 10))}
        edges = [(a, b, b, r.randint(1, 9), 1) for a, b in sorted(pairs)]
        ranked = r.sample(names, len(names))
        assert sorted(G.joined(edges, ranked)) == joined_by_force(edges, ranked)


def test_contracted_tables(spark):
    empty = spark.createDataFrame([], "contig int, src string, dst string, n bigint")
    ref = spark.createDataFrame([(0, "AA")], "contig int, kmer string")
    assert G.contracted(empty, ["contig"], ref).count() == 0
    rows = spark.createDataFrame([(0, "AA", "AC", 5), (0, "AC", "CG", 7), (1, "AA", "AA", 2)], "contig int, src string, dst string, n bigint")
    got = sorted(map(tuple, G.contracted(rows, ["contig"], ref).collect()))
    assert got == [(0, "AA", "CG", "CG", 7, 2), (1, "AA", "AA", "A", 2, 1)]


def test_trim_and_recoded_quality(spark):
    from strandline.operators import correct as X

    rows = spark.createDataFrame([("r", "ACGTN", "AcGTa", "I#I#I"), ("e", "", "", "")], "id string, seq string, fixed string, qual string")
    got = {r.id: r.q for r in rows.select("id", X.recoded_quality(F.col("seq"), F.col("fixed"), F.col("qual")).alias("q")).collect()}
    assert got == {"r": "?#?+&", "e": ""}
    ref = "ACGGTCATTGCAAGCTTACCGAT"
    rows = [("a", ref, ref), ("b", ref, "a" + ref[1:]), ("c", ref[:20] + "TTT", ref[:20] + "TTT"), ("d", "GGGGGCCCCCATATATATTTTAA", "GGGGGCCCCCATATATATTTTAA"), ("s", "ACG", "ACG"), ("e", ref[:20] + "TTA", ref[:20] + "TTA")]
    df = spark.createDataFrame([(i, s, f, "I" * len(s)) for i, s, f in rows], "id string, seq string, fixed string, qual string")
    out = X.trimmed(df, 7).cache()
    got = {r.id: (r.fixed, len(r.qual), r.n_changes) for r in out.collect()}
    assert got == {"a": (ref, 23, 0), "b": ("a" + ref[1:], 23, 1), "c": (ref[:20] + "TT", 22, 0), "e": (ref[:20] + "TT", 22, 0), "s": ("ACG", 3, 0)}
    assert X.statistics(out, df).first().asDict() == {"reads": 6, "bases": 118, "removed": 1, "shortened": 2, "repaired_reads": 1, "repaired_bases": 1}


def odd_reads(spark):
    """Reads on two contigs: an id of two rows at different places, alike rows, two alternates at one position, short, empty and null ones."""
    ref = [(0, "ACGTACGTAC" * 60), (1, "TTGCATTGCA" * 60)]
    rows = []
    for c, seq in ref:
        for n in range(180):
            at = (n * 37) % 540
            s = list(seq[at : at + 60])
            for p, alt, every in ((250, "G", 2), (251, "A", 3), (258, "T", 2), (258, "C", 5), (300, "G", 2), (511, "A", 2), (513, "C", 3)):
                if at <= p < at + 60 and n % every == 0 and seq[p] != alt:
                    s[p - at] = alt
            rows += [(f"{c}r{n}", f"q{n // 3}", c, at, "".join(s))] * (2 if n % 20 == 8 else 1)
    rows += [("0r4", "q9", 0, 230, ref[0][1][230:290]), ("0x", "q1", 0, 300, ""), ("0y", "q1", 0, 512, None), ("0z", "q1", 0, 256, "A"), ("0n", "q1", 0, None, "ACGT")]
    return spark.createDataFrame(rows, "id string, qname string, contig int, pos0 bigint, seq string"), spark.createDataFrame(ref, "contig int, seq string")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_sites(spark):
    """Reads, sites by counts, and the same calls with their lists of reads."""
    own, ref = odd_reads(spark)
    vid = F.col("chrom").cast("bigint") * 100000 + F.col("pos")
    lists = V.snp_calls(V.pileup(own), ref, 2).withColumn("vid", vid).cache()
    return own, V.sites(own, ref, 2).withColumn("vid", vid).cache(), lists


def test_touches_of_sites_equal_those_of_lists(spark, odd_sites):
    own, places, lists = odd_sites
    assert rows_of(places, "chrom", "pos", "ref", "alt", "rc", "ac") == rows_of(lists, "chrom", "pos", "ref", "alt", "rc", "ac")
    assert lists.count() > 8 and lists.groupBy("chrom", "pos").count().filter("count > 1").count()
    assert rows_of(V.touches(own, places), "read", "vid", "side") == rows_of(H.touched(lists), "read", "vid", "side")
    assert "collect_list(id" not in QUERIES["J8_touched"](spark, SF)._jdf.queryExecution().toString()


def test_pairs_of_sites_equal_those_of_lists(spark, odd_sites):
    own, places, lists = odd_sites
    names = own.select(F.col("id").alias("read"), "qname")
    got = rows_of(H.paired_touches(V.named_touches(own, places)), "v1", "s1", "v2", "s2", "n")
    assert got and got == rows_of(H.paired_edges(lists, names), "v1", "s1", "v2", "s2", "n")


def test_shared_reads_of_sites_equal_those_of_lists(spark, odd_sites):
    own, places, lists = odd_sites
    cols = ["v1", "s1", "v2", "s2", "n"]
    assert any(n > 1 for n in [r["n"] for r in H.site_edges(V.shared(own, places), 0).collect()])
    assert rows_of(H.site_edges(V.shared(own, places), 0), *cols) == rows_of(H.adjacent_edges(lists, 0), *cols)


def test_shared_reads_by_numbers_equal_those_by_joins(spark, odd_sites, monkeypatch):
    own, places, _ = odd_sites
    cols = ["chrom", "nth", "v1", "s1", "v2", "s2", "n"]
    own = own.unionByName(spark.createDataFrame([("0é", "q1", 0, 249, "éG" * 8), ("0back", "q1", 0, -3, "ACGTACGT"), ("none", "q1", None, 250, "GA"), ("far", "q1", 7, 250, "GA")], own.schema))
    numbers = V.shared(own, places)
    monkeypatch.setattr(V, "MOST_SITES", 0)
    assert numbers.schema == V.shared(own, places).schema
    assert rows_of(numbers, *cols) == rows_of(V.shared(own, places), *cols) != []
    assert V.shared(own, places.limit(0)).count() == 0
    monkeypatch.undo()
    assert V.shared(own, places.limit(0)).count() == 0


def test_touches_by_numbers_equal_those_by_joins(spark, odd_sites, monkeypatch):
    own, places, _ = odd_sites
    cols = ["read", "qname", "chrom", "nth", "vid", "v2", "side"]
    numbers = V.touches(own, places, keep=("qname",))
    monkeypatch.setattr(V, "MOST_SITES", 0)
    joined = V.touches(own, places, keep=("qname",))
    assert numbers.select(cols).dtypes == joined.select(cols).dtypes and "MapInArrow" not in joined._jdf.queryExecution().toString()
    assert rows_of(numbers, *cols) == rows_of(joined, *cols) != []


def test_pile_counts_equal_the_pileup(spark, odd_sites, monkeypatch):
    own = odd_sites[0].unionByName(spark.createDataFrame([("0é", "q1", 0, 249, "éNn-"), ("0back", "q1", 0, -3, "ACGT"), ("far", "q1", 1, 1 << 33, "ACGT")], odd_sites[0].schema))
    cols = ["contig", "pos", "base", "n"]
    want = rows_of(V.pileup(own.filter("pos0 is not null")), *cols)
    assert rows_of(V.pile_counts(own), *cols) == want
    monkeypatch.setattr(V, "PILE", -(1 << 40))
    monkeypatch.setattr(V, "PENDING", 3)
    assert rows_of(V.pile_counts(own), *cols) == want


def test_adjacent_edges_look_at_each_read_once(spark):
    plan = QUERIES["H1_adjacent_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan.split("MapInArrow")[0]


def test_read_edges_of_sites_equal_those_of_lists(spark, odd_sites):
    own, places, lists = odd_sites
    cols = ["chrom", "pos", "alt", "pos2", "alt2", "rr", "ra", "ar", "aa"]
    assert rows_of(V.site_edges(own, places), *cols) == rows_of(V.read_edges(lists), *cols)


def test_homozygous_by_counts(spark, odd_sites):
    own, places, lists = odd_sites
    bare = places.withColumn("rc", F.when(F.col("pos") == 251, 0).otherwise(F.col("rc")))
    named = lists.withColumn("ref_reads", F.when(F.col("pos") == 251, F.array().cast("array<string>")).otherwise(F.col("ref_reads")))
    got = rows_of(H.homozygous(bare, H.site_edges(V.shared(own, bare), 0)), "vid")
    assert got and got == rows_of(H.homozygous(named, H.adjacent_edges(lists, 0)), "vid")


@pytest.mark.parametrize("name", ["H5_H7_phased", "H6_paired_conflicts"])
def test_phasing_makes_no_lists_of_reads(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("lists of reads")

    monkeypatch.setattr(V, "snp_calls", refuse)
    assert QUERIES[name](spark, SF).count() == 90


def streak_reads(spark):
    """Reads with unknown letters, alike and short ones, and one that nothing shares."""
    seqs = ["ACGTTGCAAGCTAGCTTACG", "ACGTTGCAAGCTAGCTTACG", "ACGTTGCAANCTAGCTTACG", "TTTTGCAAGCTAGCTTTTTT", "CGTAAGCTAGCTTGCAACGT", "GGGGGGGCCCACATATAGAT", "ACGT", "", None]
    rows = [(f"r{i}", s, s and "I" * len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "id string, seq string, qual string")


@pytest.mark.parametrize("most", [1 << 22, 3])
def test_streaks_and_cover_by_either_way(spark, monkeypatch, most):
    """Reads looked over in their rows, and met by joins where k-mers are too many, say what the tables of flags say."""
    from strandline.operators import packed

    monkeypatch.setattr(packed, "MOST_KNOWN", most)
    own = streak_reads(spark)
    counts = K.count_canonical(own, 7)
    flags = K.solid(own.filter("length(seq) >= 7"), counts, 7, 2)
    got = K.with_streaks(own, counts, 7, 2)
    plan = got._jdf.queryExecution().toString()
    assert ("Join" in plan) == (most == 3)
    want = rows_of(K.longest_run(flags), "id", "start", "streak")
    assert rows_of(got.filter("streak is not null"), "id", "start", "streak") == want and {x[2] for x in want} >= {0, 14}
    assert rows_of(K.solid_coverage(own, counts, 7, 2), "id", "pos", "cover") == rows_of(K.base_coverage(flags, 7, F.length("seq")), "id", "pos", "cover")
    assert rows_of(K.cut_to_streak(got, 7, 0.5), "id", "seq", "qual") == rows_of(K.trimmed_by_streak(own, K.longest_run(flags), 7, 0.5), "id", "seq", "qual")


def test_numbers_of_windows():
    """Numbers made by doubling are those made base by base, for every k."""
    import numpy as np
    from strandline.operators import packed

    codes = np.random.default_rng(4).integers(0, 4, 40).astype(np.int64)
    for k in range(1, packed.MOST_K + 1):
        windows = [codes[i : i + k].tolist() for i in range(len(codes) - k + 1)]
        assert packed.forward(codes, k).tolist() == [sum(c << 2 * (k - 1 - j) for j, c in enumerate(w)) for w in windows]
        assert packed.backward(codes, k).tolist() == [sum((3 - c) << 2 * j for j, c in enumerate(w)) for w in windows]


@pytest.mark.parametrize("k", [7, 33])
def test_known_kmers_without_qualities(spark, k):
    """Counts for those who ask for no quality are the same, and take nothing but the sequence along."""
    own = streak_reads(spark).union(spark.createDataFrame([("long", "ACGTTGCAAGCTAGCTTACGACGTTGCAAGCTAGCTTACG", "I" * 40)] * 2, "id string, seq string, qual string"))
    assert rows_of(K.count_known(own.drop("qual"), k), "kmer", "occ") == rows_of(K.count_canonical(own, k), "kmer", "occ") != []


@pytest.mark.parametrize("name", ["A18_removed_shortened", "C5_C6_trimmed_after", "C5_streak_trim", "W6_base_coverage"])
def test_known_kmers_take_no_qualities(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("qualities")

    monkeypatch.setattr(K, "count_canonical", refuse)
    assert not QUERIES[name](spark, SF).isEmpty()


def test_right_reads_are_not_taken_apart(spark):
    """Only a read that differs from its truth is marked letter by letter."""
    from strandline.plans import correct

    plan = correct.planted(spark, SF).select("fixed")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN \(seq#\d+ = truth#\d+\) THEN truth|if \(\(seq#\d+ = truth#\d+\)\) truth", plan)


def test_cover_leaves_python_as_a_row_for_each_read(spark):
    own = streak_reads(spark)
    plan = K.solid_coverage(own, K.count_known(own, 7), 7, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow")


@pytest.mark.parametrize("most", [1 << 21, 2])
def test_majority_by_either_way(spark, monkeypatch, most):
    """Low bases, ties, unknown letters, null and short qualities, reads without place or name, alike ids."""
    monkeypatch.setattr(V, "MOST_SENT", most)
    rows = [("a", 0, 5, "ACGTA", "IIIII"), ("b", 0, 5, "ACGTA", "IIIII"), ("c", 0, 6, "CGAAN", "II#II"), ("d", 0, 7, "GTT", "I"), ("e", 0, 7, "GAT", None), ("f", 0, -2, "TTTT", "####"), ("g", 0, -2, "CCCC", "IIII"),
            ("h", 1, 5, "TTTTT", "IIIII"), ("i", 1, 5, "GGGGG", "#####"), ("j", 1, 5, "GTGTG", "IIII#"), ("k", None, 5, "AA", "##"), ("l", 0, None, "AA", "##"), ("m", 0, 5, None, None), ("n", 0, 5, "", ""), ("c", 1, 6, "AGAAN", "#####")]
    own = spark.createDataFrame(rows, "id string, contig int, pos0 bigint, seq string, qual string")
    votes = {}
    for _, c, p, s, q in rows:
        for i, b in enumerate(s or "" if c is not None and p is not None else ""):
            n = votes.setdefault((c, p + i), dict.fromkeys("ACGT", 0) | {"low": 0})
            if q is not None:
                good = i < len(q) and ord(q[i]) - 33 > 20
                if not good:
                    n["low"] += 1
                elif b in "ACGT":
                    n[b] += 1
    best = {}
    for at, n in votes.items():
        top = sorted((n[b] for b in "ACGT"), reverse=True)
        if n["low"] and top[0] and top[1] * 2 <= top[0]:
            best[at] = next(b for b in "ACGT" if n[b] == top[0])
    want = sorted((r, i, b, best[c, p + i]) for r, c, p, s, _ in rows if c is not None and p is not None for i, b in enumerate(s or "") if best.get((c, p + i), b) != b)
    assert len(want) > 8 and rows_of(V.majority(own), "id", "i", "base", "best") == sorted(want, key=repr)
    if most > 2:
        fixed = sorted(("".join(best.get((c, p + i), b) if c is not None and p is not None else b for i, b in enumerate(s)) if s is not None else None for _, c, p, s, _ in rows), key=repr)
        assert sorted((r.seq for r in V.majority_repaired(own).collect()), key=repr) == fixed


@pytest.mark.parametrize("most", [200_000, 2])
def test_successive_supports_of_odd_reads(spark, monkeypatch, most):
    """Ids of two rows, k-mers met twice, runs of one base, short, empty and null reads: as by joins of all steps."""
    monkeypatch.setattr(G, "MOST_SENT", most)
    seqs = ["ACGTTGCA", "ACGTTGCA", "AAAAAAA", "ACGACGACG", "TTGCAAG", "GTTGNAC", "ACG", "", None, "ACGTT", "CCCCAAAA", "GCAAGT"]
    rows = [(i % 2, f"r{i}", s, s and "".join("5I#"[(i + j) % 3] for j in range(len(s)))) for i, s in enumerate(seqs * 2)]
    rows += [(0, "r0", "TACGTT", "IIIIII"), (0, "r4", "TTGCAAG", "IIIIIII"), (0, "r4", "TTGCAAG", "IIIIIII")]
    reads, k, keys = spark.createDataFrame(rows, "contig int, read string, seq string, qual string"), 3, ["contig"]
    a, b = (x.cache() for x in G.successive(G.read_edges(reads, k, keys), keys))
    new, pair = G.Successive(reads, k, keys), ("contig", "src", "dst", "next")
    cols = [*pair, "read", "pos", "q"]
    plain, more = G.plain_reads(reads, k)
    assert plain.count() > 3 and more.count() > 6
    for got, want in [(new.intersection(), G.support_intersection(a, b, 1, pair)), (new.difference(), G.support_difference(b, a, 1, pair)), (new.union(), G.support_union(a, b)), (new.merge(), G.support_merge(a, b, pair))]:
        assert rows_of(got, *cols) == rows_of(want, *cols) and want.count()
    assert rows_of(G.read_weights(reads, k, keys), "contig", "src", "dst", "weight") == rows_of(G.edge_weights(G.read_edges(reads, k, keys), keys), "contig", "src", "dst", "weight")


def shuffles(df):
    """Of a plan that hasn't run."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_reads_are_shuffled_once_to_meet_their_mates(spark):
    rnd = random.Random(3)
    rows = []
    for n in range(400):
        at, size = rnd.randrange(30), rnd.choice([0, 1, 12, 20, 25])
        seq = "".join("ACGT"[(at + i) % 4 if rnd.random() < 0.99 else rnd.randrange(4)] for i in range(size))
        rows.append((rnd.choice([f"i{n}", f"i{n}", f"again{n % 90}", None]), rnd.choice([None, *[f"q{rnd.randrange(90)}"] * 9]), rnd.choice([None, *[at] * 9]), rnd.choice([None, *[seq] * 20]), "I" * size, 0, 60, "*"))
    kinds = "id string, qname string, pos0 bigint, seq string, qual string, flag int, mapq int, cigar string"
    for some in (rows, [r for r in rows if r[0] and r[0][0] == "i"]):
        df = spark.createDataFrame(some, kinds)
        good = [r for r in some if r[2] is not None]
        sure = {
            a[0] for a in good for b in good
            if a[0] and b[0] and a[0] != b[0] and a[1] and a[1] == b[1] and a[3] is not None and b[3] is not None
            and a[2] <= b[2] < a[2] + len(a[3]) <= b[2] + len(b[3]) and b[3].startswith(a[3][b[2] - a[2] :])
        }
        assert len(sure) > 5
        want = [(r[0], r[3] if r[3] is None or len(r[3]) <= 10 or r[0] in sure else r[3][:-5]) for r in good]
        found = P.prepared(df)
        assert sorted(map(str, want)) == sorted(str((r.id, r.seq)) for r in found.collect())
    assert shuffles(found) == 1  # four of whole reads before, where no id is repeated


def test_touches_are_shuffled_once_to_be_paired(spark):
    rnd = random.Random(4)
    rows = [(f"r{rnd.randrange(60)}", rnd.choice([None, *[f"q{rnd.randrange(12)}"] * 9]), rnd.randrange(9), rnd.randrange(2)) for _ in range(300)]
    want = {}
    for r1, q1, v1, s1 in rows:
        for r2, q2, v2, s2 in rows:
            if q1 and q1 == q2 and r1 < r2 and v1 != v2:
                key = (*min((v1, s1), (v2, s2)), *max((v1, s1), (v2, s2)))
                want[key] = want.get(key, 0) + 1
    found = H.paired_touches(spark.createDataFrame(rows, "read string, qname string, vid bigint, side int"), 1)
    assert {tuple(r[:4]): r.n for r in found.collect()} == {k: n for k, n in want.items() if n > 1}
    assert shuffles(found) == 2  # with the counts'; three before


@pytest.fixture(scope="module")
def wrong_often(tmp_path_factory):
    """The tables with every read of a wrong base six times, under six names: so often that the wrong bases are calls."""
    at = tmp_path_factory.mktemp("wrong")
    c = duckdb.connect()
    again = 53 * 240 * 1809  # leaves contig, position, haplotype and wrong base as they are
    c.sql(f"create table orders as select * from '{SF}/orders.parquet' union all select * exclude (i) replace (o_orderkey + i * {again} as o_orderkey) from '{SF}/orders.parquet', range(1, 6) t(i) where o_orderkey % 53 = 3")
    c.sql(f"create table region as select * from '{SF}/region.parquet'")
    for t in ("orders", "region"):
        c.sql(f"copy {t} to '{at}/{t}.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", ["H5_H7_phased", "P1_phased_vcf", "H6_paired_conflicts", "G18_spelled_haplotypes", "K1_vcf_header", "K5_variant_dot"])
def test_wrong_bases_read_often_change_no_phase(spark, wrong_often, name):
    at, c = wrong_often
    rel = c.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, at).select(*cols).collect()) == want
    assert name != "H5_H7_phased" or len(want) > 90


def test_piles_count_good_bases(spark):
    rows = [(0, 5, "ACG", "I5#"), (0, 5, "ACG", "#6I"), (0, 6, "CG", "I"), (0, 6, "CT", None)]
    got = V.pile_counts(spark.createDataFrame(rows, "contig int, pos0 long, seq string, qual string"), good=21).collect()
    want = {(5, "A", 2, 1), (6, "C", 4, 2), (7, "G", 3, 1), (7, "T", 1, 0)}
    assert {(r.pos, r.base, r.n, r.n_good) for r in got} == want


def test_bases_of_low_quality_make_no_variant():
    rng = random.Random(11)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    hap = ref[:150] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[150]] + ref[151:]
    for q, n in ((2, 0), (20, 0), (21, 1)):
        reads = [A.Read(f"r{i}", ref[i : i + 80], [40] * 80) for i in range(0, 221, 2)]
        reads += [A.Read(f"w{i}", hap[i : i + 80], [q if i + j == 150 else 40 for j in range(80)]) for i in range(72, 150)]
        assert len(A.window_variants(ref, 0, "c", reads)) == n


@pytest.mark.parametrize("what", ["intersection", "difference", "union", "merge"])
def test_supports_looked_up_equal_those_worked_out(spark, monkeypatch, what):
    """Reads alike, an id of two rows, a read that meets k-mers twice, short and missing qualities."""
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    rows = [(0, f"r{i}", ref[i % 30 : i % 30 + 20], "I" * (20 - i % 3)) for i in range(60)]
    rows += [(0, "r4", ref[7:30], "#" * 23), (0, "twice", "ACACACACACGT", "IIIIII#IIIII"), (1, "n", "ACGTNACGTTAC", "I" * 12), (1, "short", "ACGT", "IIII"), (1, "none", "ACGTTACGTACG", None), (None, "x", ref[:20], "I" * 20)]
    own = spark.createDataFrame(rows, "contig int, read string, seq string, qual string")
    cols = ["contig", "src", "dst", "next", "read", "pos", "q"]
    found = getattr(G.Successive(own, 5, ["contig"]), what)()
    assert G.Successive(own, 5, ["contig"]).kinds is not None and "told" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(G, "MOST_STEPS", 3)
    worked = getattr(G.Successive(own, 5, ["contig"]), what)()
    assert "told" not in worked._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(found, *cols) == rows_of(worked.filter("contig is not null"), *cols) != []  # no name meets no edge


def test_reads_are_gathered_by_sequence_for_their_pairs(spark):
    """An id of two rows counts once, and neighbouring pairs lie together."""
    rng = random.Random(8)
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    rows = [(0, f"r{i % 190}", ref[i % 95 : i % 95 + 25], "I" * 25) for i in range(200)]
    own = spark.createDataFrame(rows, "contig int, read string, seq string, qual string")
    want = {}
    for r in G.Successive(own, 5, ["contig"]).merge().collect():
        want.setdefault(tuple(r[:4]), set()).add(r.read)
    found = G.reads_of_pairs(own, 5, ["contig"])
    assert {tuple(r[:4]): r.reads for r in found.collect()} == {x: sorted(y) for x, y in want.items()}
    assert shuffles(found) == 2  # by sequence and by block, not once for each pair
    import numpy as np
    place = G.neighbours_first([np.arange(i, i + 4) for i in (0, 6, 2, 4)])
    assert place.tolist() in ([0, 3, 1, 2], [3, 0, 2, 1])
