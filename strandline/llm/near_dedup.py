"""Near-duplicates by an LSH forest over MinHash signatures.

1. Each text becomes the set of its distinct shingles of five words, hashed;
   of the set stay its size, a 128-bit sum that identifies it, and a signature
   of minima. Equal sets are one node from here on.
2. The forest sorts the nodes in several orders. An order (tree) begins at its
   own place of the signature, which it reads round as a ring. Nodes that
   agree on a tree's first three minima are a region. Where a region has more
   than ``region`` nodes, its depth grows for a first look, and only nodes that
   agree on more minima stay together; at the last depth, an overfull region is
   cut into overlapping runs of its sorted order. This first look may miss
   pairs; all that share an overfull region of depth three meet in step 6.
3. In a region, neighbours by longest common prefix and by the number of equal
   signature bytes are candidates, unless sizes rule a link out or too few
   bytes agree (about five standard deviations below the threshold). Each node
   offers its best few, and says whether it had more.
4. Offered pairs are confirmed on the full shingle sets of both texts, and
   links are joined to components. Only texts of nodes in some pair are picked
   out (``picking``: a bounded filter before the exchange); one text stands for
   all that have its set.
5. Nodes that had more meet again, region by region, but only those with a
   candidate in another component, and with their sets in hand: there, sets
   outside a region's largest component are held against all sets of other
   components, and what links two components comes out. These few links are
   confirmed as before. So a large group of copies never becomes a list of
   pairs, and no candidate of a region that isn't overfull is dropped.
6. Overfull regions of depth three meet again as a whole in step 5, whether
   their nodes had more or not. First all nodes of such a region are held
   against the one with most links. Then nodes outside the region's largest
   component are dealt into blocks, and so are those inside; each block of the
   former meets every other block. What is in one component isn't compared.

A pair at the threshold shares a region in some tree with probability
1 - (1 - 0.75 ** 3) ** 20, over 0.99998, however many nodes the region has.

Defined results: null and empty texts, and texts of blanks, have no shingles
and are linked with nothing; rows with a null doc_id are linked with nothing
and have a null component; rows of one doc_id are judged by their own text
each, and rows that repeat a doc_id and a set are one document; an empty table
gives no rows; columns besides doc_id and text are not looked at. Sets are
compared by 64-bit hashes of their shingles, and told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.lean import lean
from strandline.llm.picking import marked, marks, without
from strandline.llm.words import _mixed, buffers, distinct_in_text, shingle_hashes, slices, word_hashes
from strandline.operators.components import components
from strandline.session import staged

WORDS, LEAST_OVER_UNION = 5, (75, 100)
TREES, STEP, DEPTHS, REGION, OFFERS = 20, 3, (3, 6, 12, 24, 60), 4_096, 3
HASHES = TREES * STEP
#: Equal bytes of a signature that a candidate needs: 0.75 * 60 less 4.8 standard deviations.
LEAST_EQUAL = 29

_SEEDS = _mixed(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_SET = "doc_id long, th long, n_shingles long, s1 long, s2 long, sig binary, sketch binary"


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their number."""
    words, per = word_hashes(raw, off)
    return distinct_in_text(*shingle_hashes(words, per, WORDS))


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits for each nonempty set."""
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]
    out = np.empty((len(first), HASHES), ">u4")
    for k in range(HASHES if len(first) else 0):
        out[:, k] = np.minimum.reduceat(sets * _SEEDS[k], first) >> np.uint64(32)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers(batch.column(2))
        for a, b in slices(off):
            sets, sizes = shingle_sets(raw, off[a : b + 1])
            some = sizes > 0
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1][some]
            sums = [np.zeros(b - a, np.uint64) for _ in range(2)]
            sigs: list[bytes | None] = [None] * (b - a)
            sketches = list(sigs)
            if len(first):
                sums[0][some] = np.add.reduceat(sets, first)
                sums[1][some] = np.add.reduceat(_mixed(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                for i, s in zip(np.flatnonzero(some), signatures(sets, sizes)):
                    sigs[i], sketches[i] = s.tobytes(), s.astype(np.uint8).tobytes()
            cols = [*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(sizes.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_shingles", "s1", "s2", "sig", "sketch"])


def _key(depth: int):
    """What nodes of one region of a tree agree on: ``depth`` minima from the tree's place on."""
    return F.xxhash64("t", F.lit(depth), F.substr(F.concat("sig", "sig"), F.col("t") * (4 * STEP) + 1, F.lit(4 * depth)))


def _records(nodes: DataFrame) -> DataFrame:
    """A record for each node and tree, with the key of its region at the first depth."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    return nodes.withColumn("t", trees).withColumn("key", _key(DEPTHS[0]))


def _overfull(records: DataFrame, region: int) -> DataFrame:
    """Keys of regions with too many nodes."""
    return staged(records.groupBy("key").count().filter(F.col("count") > region).select("key"), "forest-heavy")


def _regions(nodes: DataFrame, heavy: DataFrame, region: int) -> DataFrame:
    """key, last, t, node, n, comp, sketch: a record for each node and tree, with the key at the depth that its region needs; heavy: the overfull keys of the first depth."""
    records, done = _records(nodes), []
    for depth in DEPTHS[1:]:
        if heavy.isEmpty():
            done.append(records.withColumn("last", F.lit(False)))
            break
        done.append(records.join(heavy, "key", "left_anti").withColumn("last", F.lit(False)))
        records = records.join(heavy, "key", "left_semi").withColumn("key", _key(depth))
        heavy = _overfull(records, region) if depth < DEPTHS[-1] else heavy
    else:
        done.append(records.withColumn("last", F.lit(True)))
    out = done[0].drop("sig")
    for more in done[1:]:
        out = out.unionByName(more.drop("sig"))
    return out


def _blocks(dense: DataFrame, region: int) -> DataFrame:
    """Records (with comp) of overfull regions, each with the key of every pair of blocks that its own block is in.

    A block holds about half as many nodes as a region may, either of the
    region's largest component or of the others; of two blocks of the largest
    component there is no pair. The broadcast has one row for each overfull
    region.
    """
    parts = dense.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all"))
    few, half = F.col("all") - F.col("top.count"), F.lit(region // 2)
    parts = staged(parts.filter(few > 0).select("key", F.col("top.comp").alias("top"), F.ceil(few / half).alias("n_few"), F.ceil(F.col("top.count") / half).alias("n_top")), "forest-parts")
    mine, turn = F.col("comp") == F.col("top"), F.xxhash64(F.lit("block"), "node")
    block = F.when(mine, F.col("n_few") + F.pmod(turn, "n_top")).otherwise(F.pmod(turn, "n_few"))
    others = F.sequence(F.lit(0).cast("long"), F.when(mine, F.col("n_few")).otherwise(F.col("n_few") + F.col("n_top")) - 1)
    rows = dense.join(F.broadcast(parts), "key").withColumn("block", block).withColumn("other", F.explode(others)).filter("block <> other")
    return rows.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).drop("top", "n_few", "n_top", "block", "other")


def _like_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, sketch, hub's sketch) whose sketches agree enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
        keep = pa.array((x == y).sum(1) >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])


def _hub_pairs(dense: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a region's node with most links and each node of another component that may be linked with it; the broadcast has one row for each overfull region."""
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    hub = dense.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("count", F.lit(0)).alias("links"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("sketch").alias("hub_sketch"))).alias("h"))
    rows = dense.join(F.broadcast(staged(hub.select("key", "h.*"), "forest-hubs")), "key")
    fits = LEAST_OVER_UNION[1] * F.least("n", "hub_n") >= LEAST_OVER_UNION[0] * F.greatest("n", "hub_n")
    rows = rows.filter((F.col("comp") != F.col("hub_comp")) & fits)
    return rows.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "sketch", "hub_sketch").mapInArrow(_like_hub, _PAIR).distinct()


_PAIR = "a long, b long"


def _agreeing(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of the rows ``who``: these rows, how many signature bytes agree with every node, and which nodes are candidates."""
    rows = max(1, (4 << 20) // (len(n) * HASHES))
    for s in range(0, len(who), rows):
        own = who[s : s + rows]
        equal = (sketch[own, None, :] == sketch[None, :, :]).sum(2, dtype=np.uint8)
        small, large = np.minimum(n[own, None], n), np.maximum(n[own, None], n)
        yield own, equal, (equal >= LEAST_EQUAL) & (LEAST_OVER_UNION[1] * small >= LEAST_OVER_UNION[0] * large) & (comp[own, None] != comp)


def _by_region(work, schema: pa.Schema, region: int, columns: tuple[str, ...]):
    """Run ``work`` on every region of batches sorted by key; regions that had to stay overfull come in overlapping runs."""

    def done(held: list[pa.RecordBatch], whole: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        ends, rest = np.append(starts[1:], len(key)), None
        if not whole:  # the last region may go on in the next batch
            rest, starts, ends = t.slice(int(starts[-1])).to_batches(), starts[:-1], ends[:-1]
        many = ends - starts > 1
        out: list[list[np.ndarray]] = [[] for _ in schema]
        if many.any():
            cols = [t.column(c).to_numpy() for c in columns]
            last = t.column("last").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), HASHES)
            spans = []
            for a, b in zip(starts[many], ends[many]):
                for s in range(a, b, region // 2) if last[a] and b - a > region else (a,):
                    spans.append((s, min(b, s + region) if last[a] else b))
                    if spans[-1][1] == b:
                        break
            work(spans, cols, sketch, key, out)
        made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        if len(made[0]):
            made = list(np.unique(np.column_stack(made), axis=0).T)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), f.type) for x, f in zip(made, schema)], schema=schema), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= 20_000:
                made, rest = done(held, False)
                held, size = rest, sum(x.num_rows for x in rest)
                yield made
        if held:
            yield done(held, True)[0]

    return run


def _offers(offers: int):
    """Pairs (a, b) that each node offers to its best candidates; a pair (a, a) says that a had more."""

    def work(spans, cols, sketch, key, out):
        n, node = cols
        a, b = (np.array([s for s in spans if s[1] - s[0] == 2], np.int64).reshape(-1, 2).T[0] + i for i in (0, 1))
        if len(a):  # most regions
            ok = ((sketch[a] == sketch[b]).sum(1) >= LEAST_EQUAL) & (LEAST_OVER_UNION[1] * np.minimum(n[a], n[b]) >= LEAST_OVER_UNION[0] * np.maximum(n[a], n[b]))
            x, y = node[a][ok], node[b][ok]
            out[0].append(np.minimum(x, y))
            out[1].append(np.maximum(x, y))
        for s, e in spans:
            if e - s == 2:
                continue
            own = node[s:e]
            for rows, equal, ok in _agreeing(n[s:e], own, sketch[s:e], np.arange(e - s)):
                for i in np.flatnonzero(ok.any(1)):
                    other = np.flatnonzero(ok[i])
                    me = own[rows[i]]
                    if len(other) > offers:
                        other = other[np.lexsort((own[other], -equal[i, other].astype(np.int16)))[:offers]]
                        out[0].append(np.array([me]))
                        out[1].append(np.array([me]))
                    out[0].append(np.minimum(me, own[other]))
                    out[1].append(np.maximum(me, own[other]))

    return work


def _undecided(spans, cols, sketch, key, out):
    """(key, node) of nodes that have candidates in other components; it is enough to look from those outside the largest."""
    n, node, comp = cols
    for s, e in spans:
        if (comp[s:e] == comp[s]).all():
            continue
        hit = np.zeros(e - s, bool)
        group = np.unique(comp[s:e], return_inverse=True)[1]
        for rows, _, ok in _agreeing(n[s:e], comp[s:e], sketch[s:e], np.flatnonzero(group != np.bincount(group).argmax())):
            hit[rows] |= ok.any(1)
            hit |= ok.any(0)
        out[0].append(np.full(int(hit.sum()), key[s]))
        out[1].append(node[s:e][hit])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and its set, as sorted distinct hashes."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for a, b in slices(off):
            sets, sizes = shingle_sets(raw, off[a : b + 1])
            ends = np.cumsum(sizes)
            out = [sets[e - k : e].astype("<u8").tobytes() for e, k in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], ["node", "hashes"])


def linked_in_region(comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different components among the sets of one region, none that follows from others.

    Every set outside the largest component is held against all sets of other
    components, with one lookup in a table of the region's shared hashes.
    """
    sizes = np.array([len(s) for s in sets])
    values, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[ids] > 1
    flat, owner = ids[shared], np.repeat(np.arange(len(sets)), sizes)[shared]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    group = np.unique(comp, return_inverse=True)[1]
    least, of = LEAST_OVER_UNION
    mark, found = np.zeros(len(values), bool), []
    biggest = np.bincount(group).argmax()
    for i in np.flatnonzero(group != biggest):
        mine = flat[first[i] : first[i + 1]]
        if not len(mine):
            continue
        mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(mark[flat])])
        mark[mine] = False
        both = hits[first[1:]] - hits[first[:-1]]
        for j in np.flatnonzero((of * both >= least * (sizes + sizes[i] - both)) & (group != group[i])):
            if group[j] != group[i]:
                found.append((int(i), int(j)))
                group[group == group[i]] = group[j]
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of each region, from batches sorted by key."""
    held: list = []

    def links_of():
        own = {h[1]: h for h in held}  # a node of an overlapping run counts once
        rows = list(own.values())
        pairs = linked_in_region(np.array([r[2] for r in rows]), [np.frombuffer(r[3], "<u8") for r in rows]) if len(rows) > 1 else []
        ends = [(min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])) for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and row[0] != held[0][0]:
                yield links_of()
                held = []
            held.append(row)
    if held:
        yield links_of()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts that share enough shingles."""
    least, of = LEAST_OVER_UNION
    for batch in batches:
        sides = [buffers(batch.column(i)) for i in (2, 3)]
        flags = np.zeros(batch.num_rows, bool)
        both = sides[0][1] - sides[0][1][0] + sides[1][1] - sides[1][1][0]
        for a, b in slices(both):
            sets = [shingle_sets(raw, off[a : b + 1]) for raw, off in sides]
            pair = np.concatenate([np.repeat(np.arange(b - a), sizes) for _, sizes in sets])
            values = np.concatenate([v for v, _ in sets])
            order = np.lexsort((values, pair))
            v, p = values[order], pair[order]
            twice = (v[1:] == v[:-1]) & (p[1:] == p[:-1])
            shared = np.bincount(p[1:][twice], minlength=b - a)
            union = sets[0][1] + sets[1][1] - shared
            flags[a:b] = (of * shared >= least * union) & (union > 0)
        keep = pa.array(flags)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])


def _met(pairs: DataFrame, own: DataFrame, label: str) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; own: node, text of all that are in pairs."""
    a, b = (own.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    met = a.join(pairs.hint("shuffle_hash"), "a").join(b.hint("merge"), "b")
    return staged(met.select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirmed), _PAIR), f"{label}-links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text for the wanted (node, doc_id, th), one row each. docs: doc_id, th, text.

    The plan is the same at every size: a bounded filter, then an exchange by
    doc_id and hash of what it lets through, whose small side is a hash table.
    """
    keys = staged(wanted.select("node", F.col("doc_id").alias("wid"), F.col("th").alias("wth")), "forest-wanted")
    may = marked(docs, [F.col("doc_id"), F.col("th")], marks(keys.select("wid", "wth")))
    met = may.join(keys.hint("shuffle_hash"), (may.doc_id == keys.wid) & (may.th == keys.wth))
    return staged(met.groupBy("wid", "wth", "node").agg(F.first("text").alias("text")).select("node", "text"), "forest-texts")


def links(docs: DataFrame, nodes: DataFrame, region: int = REGION, offers: int = OFFERS) -> DataFrame:
    """node, component for those of the nodes (node, doc_id, th, n, sig, sketch) that have links.

    docs (doc_id, th, text) has a text for the doc_id and the hash of each node.
    """
    places = nodes.select("node", "doc_id", "th")
    nodes = nodes.select("node", "n", "sig", "sketch")
    order = F.substr(F.concat("sketch", "sketch"), F.col("t") * STEP + 1, F.lit(HASHES))
    long2 = lambda *names: pa.schema([(c, pa.int64()) for c in names])

    def sorted_(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", order).select("key", "last", "sketch", "n", "node", *more)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    heavy = _overfull(_records(nodes), region)
    crowded = None if heavy.isEmpty() else staged(_records(nodes).join(heavy, "key", "left_semi").select("node").distinct(), "forest-crowded")
    offered = sorted_(_regions(nodes, heavy, region)).mapInArrow(lean(_by_region(_offers(offers), long2("a", "b"), region, ("n", "node"))), _PAIR)
    offered = staged(offered.distinct(), "forest-offers")
    pairs = offered.filter("a <> b")
    members = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    members = (members if crowded is None else members.unionByName(crowded)).distinct()
    own = _texts(docs, places.join(members.hint("shuffle_hash"), "node", "left_semi"))
    found = _met(pairs, own, "forest")
    labels = components(found)
    more = offered.filter("a = b").select(F.col("a").alias("node"))
    if crowded is not None:
        dense = lambda: _records(labelled(nodes.join(crowded, "node", "left_semi"))).join(heavy, "key", "left_semi").drop("sig")
        found = found.unionByName(_met(staged(_hub_pairs(dense(), found), "forest-hub-pairs"), own, "forest-hub"))
        labels = components(found)
        wanted = more.unionByName(crowded).distinct()
    elif more.isEmpty():
        return labels
    else:
        wanted = more
    # A pair that wasn't offered is one of two nodes that both had more, or of an overfull region.
    asked = staged(labelled(nodes.join(wanted, "node", "left_semi")), "forest-asked")
    met = _records(asked.join(more, "node", "left_semi")).join(heavy, "key", "left_anti").drop("sig")
    if crowded is not None:
        met = met.unionByName(_blocks(_records(asked).join(heavy, "key", "left_semi").drop("sig"), region))
    open_ = sorted_(met.withColumn("last", F.lit(False)), "comp").mapInArrow(_by_region(_undecided, long2("key", "node"), region, ("n", "node", "comp")), "key long, node long")
    open_ = staged(open_.distinct(), "forest-open")
    if open_.isEmpty():
        return labels
    members = open_.select("node").distinct()
    # Whoever had more is in a pair, so its text is among those already picked out, as are those of overfull regions.
    sets = own.join(members.hint("shuffle_hash"), "node", "left_semi").mapInArrow(lean(_hashes), "node long, hashes binary")
    sets = staged(sets.join(asked.select("node", "comp").hint("shuffle_hash"), "node"), "forest-sets")
    rows = sets.join(open_.hint("shuffle_hash"), "node").select("key", "node", "comp", "hashes").repartition("key").sortWithinPartitions("key")
    late = staged(rows.mapInArrow(lean(_joined), _PAIR).distinct(), "forest-late")
    if late.isEmpty():
        return labels
    return components(found.unionByName(_met(late, own, "forest-late")))


def _th(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, region: int, offers: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept for each row of doc_id and text; th is a hash of the text."""
    docs = docs.select("doc_id", _th(F.col("text")).alias("th"), "text")
    sets = staged(docs.mapInArrow(lean(_sets), _SET), "near-sets")
    # A set is one node, whichever documents have it; one of them, with one of its texts, stands for all.
    same = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("s1", "s2", "n_shingles")
    same = same.agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    same = staged(same.select("s1", "s2", "n_shingles", F.xxhash64("s1", "s2", "n_shingles").alias("node"), "least.doc_id", "least.th", "sig", "sketch"), "near-nodes")
    found = links(docs, same.select("node", "doc_id", "th", F.col("n_shingles").alias("n"), "sig", "sketch"), region, offers)
    # Components have the name of a node; documents are named by the smallest doc_id.
    linked = staged(same.select("s1", "s2", "n_shingles", "node", "doc_id").join(found, "node"), "near-linked")
    named = linked.groupBy("component").agg(F.min("doc_id").alias("name"))
    alone = same.select("s1", "s2", "n_shingles", "node", "doc_id").join(found.select("node").hint("shuffle_hash"), "node", "left_anti")
    named = linked.join(named, "component").select("s1", "s2", "n_shingles", "name").unionByName(alone.select("s1", "s2", "n_shingles", F.col("doc_id").alias("name")))
    out = sets.select("doc_id", "th", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("name", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def near_groups(docs: DataFrame, region: int = REGION, offers: int = OFFERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of doc_id and text."""
    return _grouped(docs, region, offers).drop("th")


def without_near_copies(docs: DataFrame, region: int = REGION, offers: int = OFFERS) -> DataFrame:
    """The documents, with all their columns, less those whose component holds a smaller doc_id."""
    gone = staged(_grouped(docs, region, offers).filter("not kept").select("doc_id", "th"), "near-gone")
    return without(docs, [F.col("doc_id"), _th(F.col("text"))], gone)
