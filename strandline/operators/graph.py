"""The assembly graph as tables: reference vertices, read edges, support, pruning.

``keys`` name one graph, such as a contig and a window; all steps keep it.
Vertices are (kmer, ctx); edges carry support entries (read, pos, q).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import packed
from strandline.operators.kmers import explode_kmers
from strandline.operators.variants import by_id
from strandline.session import staged

LIMIT_Q = 21


def reference_vertices(ref: DataFrame, k: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, pos, kmer, ctx, vtype: the start vertex led by B, one vertex for each k-mer, the end vertex closed by B.

    pos is the index of a k-mer's last base; equal k-mers are numbered by ctx.
    """
    s = F.col(seq)
    start = F.struct((F.lit(k) - 2).alias("pos"), F.concat(F.lit("B"), F.substr(s, F.lit(1), F.lit(k - 1))).alias("kmer"), F.lit("start").alias("vtype"))
    end = F.struct(F.length(s).alias("pos"), F.concat(F.substr(s, F.length(s) - k + 2), F.lit("B")).alias("kmer"), F.lit("end").alias("vtype"))
    middle = F.transform(F.sequence(F.lit(k), F.length(s)), lambda i: F.struct((i - 1).alias("pos"), F.substr(s, i - k + 1, F.lit(k)).alias("kmer"), F.lit("middle").alias("vtype")))
    rows = ref.filter(F.length(s) >= k).select(*keys, F.inline(F.concat(F.array(start), middle, F.array(end))))
    return rows.withColumn("ctx", (F.row_number().over(Window.partitionBy(*keys, "kmer").orderBy("pos")) - 1).cast("int"))


def reference_edges(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, src_ctx, dst, dst_ctx: the chain of the reference."""
    w = Window.partitionBy(*keys).orderBy("pos")
    e = vertices.select(*keys, F.col("kmer").alias("src"), F.col("ctx").alias("src_ctx"), F.lead("kmer").over(w).alias("dst"), F.lead("ctx").over(w).alias("dst_ctx"))
    return e.filter(F.col("dst").isNotNull())


def vertex_sets(read_kmers: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Read k-mers with the vertices of their string, whatever their context; new ones have vtype read and ctx 0."""
    met = read_kmers.join(vertices.select(*keys, "kmer", "ctx", "vtype", "pos"), [*keys, "kmer"], "left")
    return met.withColumns({"ctx": F.coalesce("ctx", F.lit(0)), "vtype": F.coalesce("vtype", F.lit("read"))})


def read_edges(reads: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, src, dst, read, pos, q: one row for each step of each read; q is the quality of the base that the step adds.

    A read's k-mers are made in its own row, so nothing is shuffled for this.
    """
    q = F.ascii(F.substr("qual", F.col("i") + k + 1, F.lit(1))) - 33
    each = explode_kmers(reads.filter(F.length("seq") > k).select(*keys, "read", "seq", "qual"), k + 1)
    return each.select(*keys, F.substr("kmer", F.lit(1), F.lit(k)).alias("src"), F.substr("kmer", F.lit(2)).alias("dst"), "read", (F.col("i") + k).alias("pos"), q.alias("q"))


def support_of_reads(reads: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, src, dst, n, last_pos straight from reads (keys, seq): what ``edge_support`` says of their ``read_edges``, counted as numbers within each batch."""
    if k < packed.MOST_K:
        return packed.step_support(reads.filter(F.length("seq") > k), k, keys)
    return edge_support(read_edges(reads.select(*keys, F.lit(0).alias("read"), "seq", F.col("seq").alias("qual")), k, keys), keys)


def edge_support(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst, n, last_pos: entries behind each edge, and the greatest position among them."""
    return steps.groupBy(*keys, "src", "dst").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def supported(edges: DataFrame, k: int, threshold: int = 4) -> DataFrame:
    """Edges of more entries than the threshold; for k up to 21 also with an entry at 2 k or later."""
    return edges.filter((F.col("n") > threshold) & ((F.col("last_pos") >= 2 * k) if k <= 21 else F.lit(True)))


def edge_weights(steps: DataFrame, keys: list[str], good: int = LIMIT_Q) -> DataFrame:
    """keys, src, dst, weight: 100 for each read whose first entry has a good base."""
    first = steps.groupBy(*keys, "src", "dst", "read").agg(F.min(F.struct("pos", "q"))["q"].alias("q"))
    return first.groupBy(*keys, "src", "dst").agg(F.sum(F.when(F.col("q") >= good, 100).otherwise(0)).alias("weight"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kmer, din, dout."""
    ends = edges.select(*keys, F.col("src").alias("kmer"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(*keys, F.col("dst").alias("kmer"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(*keys, "kmer").agg(F.sum("i").alias("din"), F.sum("o").alias("dout"))


def edge_types(edges: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Add etype: reference for steps that the reference makes too, read for the rest."""
    known = reference.select(*keys, "src", "dst").distinct().withColumn("etype", F.lit("reference"))
    return edges.join(known, [*keys, "src", "dst"], "left").withColumn("etype", F.coalesce("etype", F.lit("read")))


def type_counts(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    return rows.groupBy(*keys, col).agg(F.count("*").alias("n"))


def peeled(edges: list[tuple], fixed: set) -> list[bool]:
    """Which edges (src, dst) stay when vertices that nothing enters or nothing leaves go, over and over; fixed vertices stay."""
    out: dict[str, set[int]] = {}
    into: dict[str, set[int]] = {}
    for i, (a, b) in enumerate(edges):
        out.setdefault(a, set()).add(i)
        into.setdefault(b, set()).add(i)
    stay = [True] * len(edges)
    todo = [v for v in {*out, *into} if v not in fixed and not (out.get(v) and into.get(v))]
    while todo:
        v = todo.pop()
        for i in [*out.pop(v, ()), *into.pop(v, ())]:
            stay[i] = False
            for side, w in ((out, edges[i][0]), (into, edges[i][1])):
                if w in side:
                    side[w].discard(i)
                    if not side[w] and w not in fixed:
                        todo.append(w)
    return stay


def without_dead_ends(edges: DataFrame, keys: list[str], fixed: DataFrame) -> DataFrame:
    """Drop edges at vertices that nothing enters or nothing leaves, again and again; ``fixed`` vertices (kmer) may be ends.

    A graph is one window's, so its size is bounded; each is peeled in one
    task, in time linear in its edges.
    """
    ends = fixed.select(*keys, F.col("kmer").alias("src"), F.lit(None).cast("string").alias("dst"))
    rows = edges.select(*keys, "src", "dst").unionByName(ends)

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.dst.notna()]
        stay = peeled(list(zip(own.src, own.dst)), set(pdf.src[pdf.dst.isna()]))
        return own[np.array(stay, bool)]

    return rows.groupBy(*keys).applyInPandas(peel, rows.schema)


def joined(edges: list[tuple], ranked: list[str]) -> list[tuple]:
    """Edges (src, dst, bases, n, steps) after each of the ``ranked`` vertices, in that order, with one edge in and one out is replaced by one edge.

    A vertex stays where the edge that would replace it begins and ends at
    one vertex, or is there already. Bases and steps add up, the greatest
    support stays. Joining changes no degree of another vertex, so one pass is all there is.
    """
    out: dict[str, dict[str, tuple]] = {}
    into: dict[str, set[str]] = {}
    for a, b, *data in edges:
        out.setdefault(a, {})[b] = tuple(data)
        into.setdefault(b, set()).add(a)
    for v in ranked:
        if len(out.get(v, ())) != 1 or len(into.get(v, ())) != 1:
            continue
        (u,), ((w, (bases, n, steps)),) = into[v], out[v].items()
        if u == w or v in (u, w) or w in out[u]:
            continue
        before, m, done = out[u].pop(v)
        del out[v], into[v]
        out[u][w] = (before + bases, max(n, m), done + steps)
        into[w].discard(v)
        into[w].add(u)
    return [(a, b, *data) for a, ends in out.items() for b, data in ends.items()]


def contracted(edges: DataFrame, keys: list[str], reference: DataFrame) -> DataFrame:
    """keys, src, dst, bases, n, steps: linear stretches of edges (src, dst, n) as one edge each.

    Vertices of reads go first, then those inside the ``reference`` (kmer), each by their k-mers. A
    graph is one window's, so its size is bounded; each is worked off in one task, in time linear in its edges.
    """
    ends = reference.select(*keys, F.col("kmer").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("bigint").alias("n"))
    rows = edges.select(*keys, "src", "dst", F.col("n").cast("bigint").alias("n")).unionByName(ends)
    of_keys = [f for f in rows.schema if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in of_keys] + ["src string", "dst string", "bases string", "n bigint", "steps bigint"])

    def contract(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, known = pdf[pdf.dst.notna()], set(pdf.src[pdf.dst.isna()])
        ranked = sorted({*own.src, *own.dst}, key=lambda v: (v in known, v))
        made = joined([(a, b, b[-1], int(n), 1) for a, b, n in zip(own.src, own.dst, own.n)], ranked)
        out = pd.DataFrame(made, columns=["src", "dst", "bases", "n", "steps"])
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    return rows.groupBy(*keys).applyInPandas(contract, schema)


#: Edges that are sent to every executor; more are joined by a shuffle.
MOST_SENT = 200_000


def plain_reads(reads: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Reads (read, seq) whose id no other row has and that meet no k-mer twice; and the rest.

    What such a read supports is told by its own row. The rest is found by
    hashes, so some single rows may be among it; all that is said of it is said by joins.
    """
    once, more = by_id(reads.filter(F.length("seq") > k), "read")
    if k <= packed.MOST_K:
        once = packed.met_once(once, k)
    else:
        each = F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k)))
        once = once.withColumn("alone", F.size(F.array_distinct(each)) == F.length("seq") - k + 1)
    return once.filter("alone").drop("alone"), more.unionByName(once.filter("not alone").drop("alone"))


def plain_steps(plain: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, before, src, dst, next, read, pos, q: the steps of ``plain_reads`` with the k-mers around them in the read, null at its ends."""
    i, at = F.col("i"), lambda n: F.substr(F.col("seq"), F.col("i") + n, F.lit(k))
    each = plain.select(*keys, "read", "seq", "qual", F.explode(F.sequence(F.lit(0), F.length("seq") - k - 1)).alias("i"))
    return each.select(*keys, F.when(i > 0, at(0)).alias("before"), at(1).alias("src"), at(2).alias("dst"), F.when(i + k + 2 <= F.length("seq"), at(3)).alias("next"), "read", (i + k).alias("pos"), (F.ascii(F.substr("qual", i + k + 1, F.lit(1))) - 33).alias("q"))


#: Steps of different sequences that are sent to every executor, with what each of them supports.
MOST_STEPS = 1 << 20


def kinds_of(reads: DataFrame, k: int, keys: list[str]) -> DataFrame | None:
    """keys, seq, read (a number): the different sequences of more than k letters, or nothing if they have more than ``MOST_STEPS`` steps."""
    found = staged(reads.filter(F.length("seq") > k).select(*keys, "seq").distinct().withColumn("read", F.monotonically_increasing_id()), "kinds")
    return found if (found.agg(F.sum(F.length("seq") - k)).first()[0] or 0) <= MOST_STEPS else None


class Successive:
    """Supports of every two edges that follow each other (src to dst to next), and what is said of them, for reads (keys, read, seq, qual).

    Plain reads answer in their own rows, given the edges around their steps;
    the rest goes through ``successive``. No id is in both parts. Where few
    sequences differ, what each of them supports is worked out
    by ``successive``, and reads of one row look that up by their sequence.
    """

    def __init__(self, reads: DataFrame, k: int, keys: list[str]) -> None:
        self.keys, self.names = keys, [*keys, "src", "dst", "next", "read", "pos", "q"]
        self.kinds = kinds_of(reads, k, keys)
        if self.kinds is not None:
            steps = read_edges(self.kinds.withColumn("qual", F.col("seq")), k, keys)
            edges = staged(steps.select(*keys, "src", "dst").distinct(), "edges")
            self.once, more = by_id(reads.select(*keys, "read", "seq", "qual").filter(F.length("seq") > k), "read")
            self.of_kinds, self.of_more = successive(steps, keys, edges), successive(read_edges(more, k, keys), keys, edges)
            return
        edges = staged(support_of_reads(reads, k, keys).select(*keys, "src", "dst"), "edges")
        plain, more = plain_reads(reads.select(*keys, "read", "seq", "qual"), k)
        self.steps = plain_steps(plain, k, keys)
        self.a, self.b = successive(read_edges(more, k, keys), keys, edges)
        sent = F.broadcast if edges.count() <= MOST_SENT else lambda df: df
        self.into = sent(edges.groupBy(*keys, F.col("dst").alias("src")).agg(F.collect_list("src").alias("into")))
        self.out = sent(edges.groupBy(*keys, F.col("src").alias("dst")).agg(F.collect_list("dst").alias("out")))

    def first(self) -> DataFrame:
        """Plain steps as the first edge of each of their pairs."""
        return self.steps.drop("next").join(self.out, [*self.keys, "dst"]).withColumn("next", F.explode("out")).select(self.names)

    def second(self, others: bool) -> DataFrame:
        """Plain steps as the second edge of each of their pairs; with ``others`` of those only whose first edge the read doesn't take before."""
        met = self.steps.join(self.into, [*self.keys, "src"])
        into = F.filter("into", lambda w: ~w.eqNullSafe(F.col("before"))) if others else F.col("into")
        return met.select(*self.keys, F.explode(into).alias("a"), F.col("src").alias("b"), F.col("dst").alias("next"), "read", "pos", "q").withColumnsRenamed({"a": "src", "b": "dst"}).select(self.names)

    def pair(self) -> tuple[str, ...]:
        return (*self.keys, "src", "dst", "next")

    def looked_up(self, entries: DataFrame) -> DataFrame:
        """The entries of all kinds, as entries of each read of one row that has the kind's sequence."""
        told = entries.groupBy("read").agg(F.collect_list(F.struct("src", "dst", "next", "pos")).alias("told"))
        table = staged(self.kinds.join(told, "read").drop("read"), "told")
        met = self.once.join(F.broadcast(table), [*self.keys, "seq"]).select(*self.keys, "read", "qual", F.inline("told"))
        return met.withColumn("q", F.ascii(F.substr("qual", F.col("pos") + 1, F.lit(1))) - 33).select(self.names)

    def intersection(self) -> DataFrame:
        if self.kinds is not None:
            own, more = (support_intersection(a, b, 1, self.pair()) for a, b in (self.of_kinds, self.of_more))
            return self.looked_up(own).unionByName(more.select(self.names))
        own = self.steps.filter("next is not null").select(self.names)
        return own.unionByName(support_intersection(self.a, self.b, 1, self.pair()).select(self.names))

    def difference(self) -> DataFrame:
        if self.kinds is not None:
            own, more = (support_difference(b, a, 1, self.pair()) for a, b in (self.of_kinds, self.of_more))
            return self.looked_up(own).unionByName(more.select(self.names))
        return self.second(True).unionByName(support_difference(self.b, self.a, 1, self.pair()).select(self.names))

    def union(self) -> DataFrame:
        if self.kinds is not None:
            return self.looked_up(support_union(*self.of_kinds)).unionByName(support_union(*self.of_more).select(self.names))
        return self.first().unionByName(self.second(False)).unionByName(support_union(self.a, self.b))

    def merge(self) -> DataFrame:
        if self.kinds is not None:
            own, more = (support_merge(a, b, self.pair()) for a, b in (self.of_kinds, self.of_more))
            return self.looked_up(own).unionByName(more.select(self.names))
        return self.first().unionByName(self.second(True)).unionByName(support_merge(self.a, self.b, self.pair()).select(self.names))


#: Pairs of edges whose lists of reads are made together.
PAIRS = 16


def neighbours_first(kinds: list[np.ndarray]) -> np.ndarray:
    """A number for each pair, given the kinds that support it: after a pair comes the one that shares most kinds with it."""
    n = np.array([len(x) for x in kinds], np.int64)
    every, of = np.unique(np.concatenate([np.zeros(0, np.int64), *kinds]), return_inverse=True)
    own = np.split(of, np.cumsum(n)[:-1])
    order = np.argsort(of, kind="stable")
    pairs = np.split(np.repeat(np.arange(len(n)), n)[order], np.cumsum(np.bincount(of, minlength=len(every)))[:-1])
    place = np.full(len(n), -1)
    at, first = 0, 0
    for i in range(len(n)):
        place[at] = i
        near = np.concatenate([pairs[j] for j in own[at]])
        near, times = np.unique(near[place[near] < 0], return_counts=True)
        while not len(near) and first < len(n) and place[first] >= 0:
            first += 1
        at = near[times.argmax()] if len(near) else first
    return place


def reads_of_pairs(reads: DataFrame, k: int, keys: list[str]) -> DataFrame | None:
    """keys, src, dst, next, reads: the sorted distinct reads behind every two edges that follow each other; nothing where too many sequences differ.

    Reads are gathered by sequence. A sequence's list then goes once to each
    block of neighbouring pairs that it supports, where the lists of the pairs are merged as numbers.
    """
    if (kinds := kinds_of(reads, k, keys)) is None:
        return None
    steps = read_edges(kinds.withColumn("qual", F.col("seq")), k, keys)
    a, b = successive(steps, keys, staged(steps.select(*keys, "src", "dst").distinct(), "edges"))
    pairs = a.unionByName(b).groupBy(*keys, "src", "dst", "next").agg(F.collect_set("read").alias("kinds"))
    pairs = staged(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    known = pairs.select("pair", "kinds").toPandas()
    if known.empty:
        return pairs.select(*keys, "src", "dst", "next", F.array().cast("array<string>").alias("reads"))
    blocks = pd.DataFrame({"pair": known.pair, "block": neighbours_first([np.asarray(x, np.int64) for x in known.kinds]) // PAIRS})
    goes = pairs.join(F.broadcast(reads.sparkSession.createDataFrame(blocks, "pair long, block long")), "pair")
    goes = staged(goes.select("pair", "block", F.explode("kinds").alias("kind")).groupBy("kind", "block").agg(F.collect_list("pair").alias("pairs")), "goes")
    lists = reads.select(*keys, "seq", F.col("read").alias("id")).join(F.broadcast(kinds.withColumnRenamed("read", "kind")), [*keys, "seq"]).groupBy("kind").agg(F.collect_list("id").alias("ids"))

    def merged(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, of = block["ids"].chunk(0), block["pairs"].to_pylist()
        off, code = ids.offsets.to_numpy(), ids.values.dictionary_encode()
        order = pc.sort_indices(code.dictionary)
        texts, rank = code.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        rank = rank[code.indices.to_numpy()]
        rows: dict[int, list[int]] = {}
        for row, own in enumerate(of):
            for pair in own:
                rows.setdefault(pair, []).append(row)
        batches = []
        for pair, own in rows.items():
            found = texts.take(pa.array(np.unique(np.concatenate([rank[off[r] : off[r + 1]] for r in own]))))
            batches.append(pa.RecordBatch.from_arrays([pa.array([pair], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], ["pair", "reads"]))
        return pa.Table.from_batches(batches)

    made = lists.join(F.broadcast(goes), "kind").select("block", "pairs", "ids").groupBy("block").applyInArrow(merged, "pair long, reads array<string>")
    return made.join(F.broadcast(pairs.drop("kinds")), "pair").select(*keys, "src", "dst", "next", "reads")


def read_weights(reads: DataFrame, k: int, keys: list[str], good: int = LIMIT_Q) -> DataFrame:
    """``edge_weights`` of reads (keys, read, seq, qual): plain reads are counted before anything is shuffled."""
    plain, more = plain_reads(reads.select(*keys, "read", "seq", "qual"), k)
    if k < packed.MOST_K:
        other = F.col("seq").rlike("[^ACGT]")
        more = more.unionByName(plain.filter(other))
        own = packed.step_weights(plain.filter(~other), k, keys, good)
    else:
        own = plain_steps(plain, k, keys).select(*keys, "src", "dst", F.when(F.col("q") >= good, 100).otherwise(0).alias("weight"))
    both = own.unionByName(edge_weights(read_edges(more, k, keys), keys, good))
    return both.groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight"))


def successive(steps: DataFrame, keys: list[str], edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """keys, src, dst, next, read, pos, q: for each pair of edges that follow each other (src to dst to next), the support of the first and that of the second. ``edges``: of all reads, where steps are of some."""
    edges = steps.select(*keys, "src", "dst").distinct() if edges is None else edges
    pairs = edges.join(edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("next")), [*keys, "dst"])
    names = [*keys, "src", "dst", "next", "read", "pos", "q"]
    second = steps.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("next"), "read", "pos", "q")
    return steps.join(pairs, [*keys, "src", "dst"]).select(*names), second.join(pairs, [*keys, "dst", "next"]).select(*names)


def support_intersection(a: DataFrame, b: DataFrame, distance: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a whose read is in b ``distance`` further on."""
    return a.join(b.select(*keys, "read", (F.col("pos") - distance).alias("pos")).distinct(), [*keys, "read", "pos"], "left_semi")


def support_difference(a: DataFrame, b: DataFrame, distance: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a that have no entry of b ``distance`` before them."""
    return a.join(b.select(*keys, "read", (F.col("pos") + distance).alias("pos")).distinct(), [*keys, "read", "pos"], "left_anti")


def support_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def support_merge(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One entry for each read: the first by position."""
    return a.unionByName(b).groupBy(*keys, "read").agg(F.min(F.struct("pos", "q")).alias("x")).select(*keys, "read", "x.pos", "x.q")


def supporting_reads(path: Column) -> Column:
    """Sorted distinct reads of an array of support arrays."""
    return F.array_sort(F.array_distinct(F.transform(F.flatten(path), lambda e: e.read)))


def spelled(path: Column) -> Column:
    """The bases that a path of k-mers adds: the first k-mer, then the last base of each one after it."""
    return F.concat(path[0], F.array_join(F.transform(F.slice(path, 2, F.size(path)), lambda x: F.right(x, F.lit(1))), ""))


def dot(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line: edges as Graphviz statements, coloured by type."""
    colour = F.when(F.col("etype") == "reference", "green").otherwise("red")
    return edges.select(*keys, F.format_string('"%s" -> "%s" [color=%s,label="%d"];', "src", "dst", colour, "n").alias("line"))


def dot_vertices(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line: vertices as Graphviz statements; those of the reference say where they lie and whether their k-mer is unique there."""
    known = vertices.withColumn("times", F.count("*").over(Window.partitionBy(*keys, "kmer")))
    label = F.format_string("%s\\nRef\\nPOS: %d\\n%s", "kmer", "pos", F.when(F.col("times") == 1, "unique").otherwise("repeat"))
    colour = F.when(F.col("vtype") == "start", "yellow").when(F.col("vtype") == "middle", "lightgreen").otherwise("blue")
    line = lambda name, label, colour: F.format_string('"%s"[label="%s",style=filled,color=%s];', name, label, colour).alias("line")
    name = F.when(F.col("ctx") > 0, F.format_string("%s#%d", "kmer", "ctx")).otherwise(F.col("kmer"))
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("kmer")).distinct().join(known.select(*keys, "kmer"), [*keys, "kmer"], "left_anti")
    return known.select(*keys, line(name, label, colour)).unionByName(ends.select(*keys, line(F.col("kmer"), F.concat("kmer", F.lit("\\nRead")), F.lit("red"))))


def stages(vertices: DataFrame, edges: DataFrame, k: int, keys: list[str], threshold: int = 4) -> dict[str, DataFrame]:
    """Edges by stage of a graph's life: as read, of enough support, without dead ends, and in one edge for each linear stretch."""
    found = {"read": edges, "supported": supported(edges, k, threshold)}
    kept = without_dead_ends(found["supported"], keys, vertices.filter("vtype = 'middle'").select(*keys, "kmer"))
    found["trimmed"] = found["supported"].join(kept, [*keys, "src", "dst"], "left_semi")
    found["contracted"] = contracted(found["trimmed"], keys, vertices.select(*keys, "kmer").distinct())
    return found
