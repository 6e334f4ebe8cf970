"""Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

Documents with equal shingle sets are one class (node). All shingles are ordered from rare to frequent (by a table of
bucket counts over all documents). Two sets of Jaccard similarity t share at least ``m`` shingles among
their first n - ceil(t*n) + m ones, for every m up to ceil(t*n). Each set picks its own m: where
many candidates are foretold the prefix is lengthened, and a pair must then share the smaller m of its two
sets before anything else is looked at. They are foretold by the bucket counts and, as these drown in noise when the corpus has far more shingles than
there are buckets, by exact counts of a few shingles of each set: its smallest hashes, which near copies mostly share. The most frequent of these (``HEAVY`` at
most) are known to every task, so the largest groups are foretold at any size of the corpus. Pairs that share enough pass two exact upper bounds (sizes, and the Hamming distance of
parity bitmaps) before the sets themselves are compared.

Sets that meet are kept together: each set belongs to a block, named by the prefix shingle that it shares with the
most others and a part of that name's sets, of a bounded number of sets and shingles. A prefix shingle is dealt to every pair of
blocks in which it occurs, so a pair of sets is counted, tested and verified in one place only, and a set goes to a pair of blocks once
however many of its pairs lie there. A large group of near copies costs its square in comparisons, spread over pairs of blocks, but
only a row for each set and pair of blocks: pairs themselves stay lists inside these rows.

Every link between distinct sets is found and verified. Components are derived from the links.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles are 64-bit hashes of ``width`` words, and a text of fewer words is
one shingle. A null text or one without words has an empty set, links with nothing and is its own component. A very long text is read
whole; its set stands in a block of its own. Rows that repeat an id and text are alike; rows that repeat an id with other texts are
other documents; a null id gets its class's component. Only the id and text columns are read, so other columns may have any name. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, fresh, materialize, may_be_in
from millrace.llm.shingles import mix, shingle_set, split_words

BUCKET_BITS, CHUNKS = 21, 64
#: Shingles of each set that are counted exactly, the least count that tells anything, and the most of them that tasks get.
LOWEST, LEAST, HEAVY = 8, 3, 1 << 17
#: The share of a set by which its prefix may be lengthened, in steps; and the cost of verifying a pair against listing it.
STEPS, VERIFY_COST = (0.0, 0.02, 0.05, 0.1), 20.0
#: Sets of a block, and shingles in it.
BLOCK_SETS, BLOCK_SHINGLES = 256, 500_000
#: Cells of a block's 0/1 matrices, and words of compared bitmaps, that are held at a time.
MATRIX_CELLS, BITMAP_WORDS = 1 << 20, 1 << 19
COUNTS = "chunk int, slot int, counts binary, lowest array<bigint>"
PASSED = "doc_id long, key long, n int, node long, m int, bitmap binary, token long"
MATCHED = "low long, high long, node long, others array<bigint>"
LINKED = "node long, n_links long, root long, others array<bigint>, shared array<int>"
SIGNED = np.int64


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any set of that similarity."""
    return (n * percent + 99) // 100


def sets_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(split_words(text, lower=True), width)


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit number."""
    mixed = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    with np.errstate(over="ignore"):
        total = mixed.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(mixed) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(SIGNED)[0])


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit b is the parity of the number of shingles that hash to b; a power of two bits, about two a shingle."""
    bits = max(256, 1 << int(2 * len(shingles) - 1).bit_length())
    hits = np.bincount((shingles >> np.uint64(3)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").tobytes()


def buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def count_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each batch's lowest shingles of its sets; at the end this task's number of sets for each bucket of shingles, in compressed chunks."""
    names, types = [c.split()[0] for c in COUNTS.split(", ")], (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    counts, slot = np.zeros(1 << BUCKET_BITS, np.uint32), 0
    for batch in batches:
        sets = list(sets_of(batch.column(0).to_pylist(), width))
        found = [buckets(s) for s in sets]
        if found:
            lowest = np.concatenate([s[:LOWEST] for s in sets]).view(SIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([None], [None], [None], [lowest]), types)], names)
            at, times = np.unique(np.concatenate(found), return_counts=True)
            counts[at] += times.astype(np.uint32)
            slot = (slot * 31 + int(at.sum()) + len(at)) % 251
    rows = [(k, slot, zlib.compress(part.tobytes(), 1), None) for k, part in enumerate(np.split(counts, CHUNKS)) if part.any()]
    columns = list(zip(*rows)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def add_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << BUCKET_BITS) // CHUNKS, np.uint64)
    for packed in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(packed), np.uint32)
    packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [packed]})


def bucket_table(chunks: DataFrame) -> np.ndarray:
    """Sum of all tasks' counts, in two rounds so that no group grows with the number of tasks; a table of fixed size."""
    schema = "chunk int, counts binary"
    halves = chunks.groupBy("chunk", "slot").applyInPandas(lambda pdf: add_chunks(pdf), schema)
    table = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.uint32)
    for chunk, packed in halves.groupBy("chunk").applyInPandas(lambda pdf: add_chunks(pdf), schema).collect():
        table[chunk] = np.frombuffer(zlib.decompress(packed), np.uint32)
    return table.ravel()


class Rarity(NamedTuple):
    """How many sets hold a shingle: counts by bucket, and exact ones of the most frequent lowest shingles (sorted). A fixed size."""

    table: np.ndarray
    heavy: np.ndarray
    held: np.ndarray

    def others(self, lowest: np.ndarray) -> np.ndarray:
        """Of a set's lowest shingles how many other sets hold each, ascending; 0 where it isn't known to be frequent."""
        if not len(self.heavy):
            return np.zeros(len(lowest))
        at = np.minimum(np.searchsorted(self.heavy, lowest), len(self.heavy) - 1)
        return np.sort(np.where(self.heavy[at] == lowest, self.held[at] - 1.0, 0.0))


def heavy_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``HEAVY`` most frequent of the sets' lowest shingles, sorted, and how many sets hold them."""
    times = counted.where("lowest is not null").select(F.explode("lowest").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    most = times.where(F.col("held") >= LEAST).orderBy(F.desc("held"), "token").limit(HEAVY).toArrow()
    token = most.column("token").to_numpy().astype(SIGNED).view(np.uint64)
    order = np.argsort(token)
    return token[order], most.column("held").to_numpy().astype(np.float64)[order]


def foretold(lowest: np.ndarray, share: float) -> float:
    """What the rarest ``share`` of a set adds up to, as a share of the whole, if its shingles are as its lowest ones (ascending counts)."""
    k = len(lowest)
    return float((np.clip(share * k - np.arange(k), 0, 1) * lowest).sum()) / k


def prefix(shingles: np.ndarray, table: np.ndarray, noise: float, percent: int, lowest: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The set's prefix in global order, and the number m of it that a similar set shares at least. ``lowest``: what is known of its lowest shingles."""
    n = len(shingles)
    frequency = table[buckets(shingles)]
    order = np.lexsort((shingles, frequency))
    must = int(needed(n, percent))
    others = np.maximum(frequency[order].astype(np.float64) - noise, 0)
    summed = np.cumsum(others)
    best, cost = 1, np.inf
    for step in STEPS:
        m = min(must, 1 + int(step * n))
        length = n - must + m
        listed = max(summed[length - 1], 0.0 if lowest is None else n * foretold(lowest, length / n))
        estimate = listed * (1 + VERIFY_COST / m)
        if estimate < cost:
            best, cost = m, estimate
    return shingles[order[: n - must + best]], best


def prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, shared) -> Iterator[pa.RecordBatch]:
    """A row of PASSED for each document, and one for each prefix shingle of its set; a set met lately gives only the former."""
    rarity = shared.value
    noise = float(np.median(rarity.table[:: max(1, len(rarity.table) >> 16)])) * 1.5 + 2
    recent: set[int] = set()
    fields = [c.split() for c in PASSED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    for batch in batches:
        docs, tokens, nodes = [], [], []
        for doc_id, key, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2).to_pylist(), width)):
            if not len(shingles):
                docs.append((doc_id, key, 0, None, None, None))
                continue
            node = node_of(shingles)
            if node in recent:
                docs.append((doc_id, key, len(shingles), node, None, None))
                continue
            if len(recent) >= 100_000:
                recent.clear()
            recent.add(node)
            first, m = prefix(shingles, rarity.table, noise, percent, rarity.others(shingles[:LOWEST]))
            docs.append((doc_id, key, len(shingles), node, m, parity_bitmap(shingles)))
            tokens.append(first)
            nodes.append(np.full(len(first), node, SIGNED))
        if docs:
            columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*docs), fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(docs), pa.int64())], [name for name, _ in fields])
        if tokens:
            token, node = np.concatenate(tokens).view(SIGNED), np.concatenate(nodes)
            given = {"node": pa.array(node), "token": pa.array(token)}
            yield pa.RecordBatch.from_arrays([given[name] if name in given else pa.nulls(len(token), kinds[k]) for name, k in fields], [name for name, _ in fields])


def numbers(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """low, high and rows of each pair of blocks. Rows come sorted by these two columns; lists come as arrays."""
    key, held = None, []
    for batch in batches:
        low, high, *rest = (numbers(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns)
        for at, row in zip(zip(low, high), zip(*rest)):
            if at != key:
                if len(held) > 1:
                    yield *key, held
                key, held = at, []
            held.append(row)
    if len(held) > 1:
        yield *key, held


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets share, as a square of counts."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, n], [n, 0]])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = count > 1
    use = kept[column]
    row, column = row[use], (np.cumsum(kept) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column, total = row[order], column[order], np.zeros((len(sets), len(sets)), np.int64)
    step = max(1, MATRIX_CELLS // len(sets))
    for low in range(0, int(kept.sum()), step):
        i, j = np.searchsorted(column, (low, low + step))
        present = np.zeros((len(sets), step), np.float32)
        present[row[i:j], column[i:j] - low] = 1
        total += (present @ present.T).astype(np.int64)
    return total


def distances(bitmaps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the symmetric differences: Hamming distances of the parities, the longer one folded to the other's length."""
    words, out = np.array([len(x) // 8 for x in bitmaps]), np.zeros(len(a), np.int64)
    least = np.minimum(words[a], words[b])
    for width in np.unique(least):
        which = np.flatnonzero(least == width)
        used, place = np.unique(np.concatenate([a[which], b[which]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, width), axis=0) for i in used])
        x, y = place[: len(which)], place[len(which) :]
        for at in range(0, len(which), step := max(1, BITMAP_WORDS // int(width))):
            part = slice(at, at + step)
            out[which[part]] = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1, dtype=np.int64)
    return out


def match(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of MATCHED: of each pair of blocks the sets that have candidates there, and their later candidates.

    A candidate pair shares the smaller m of its two sets, and sizes and bitmaps leave room for the similarity.
    """
    out, size = [], 0
    for low, high, rows in meetings(batches):
        rows.sort(key=lambda r: r[0])
        node, block, n, m, bitmap, tokens = zip(*rows)
        counts = shared_counts(list(tokens))
        sizes, wanted, own = np.array(n), np.array(m), np.array(block)
        good = np.triu(counts >= np.minimum(wanted[:, None], wanted[None, :]), 1)
        good &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
        if low != high:
            good &= own[:, None] != own[None, :]
        a, b = np.nonzero(good)
        if not len(a):
            continue
        both, apart = sizes[a] + sizes[b], distances(list(bitmap), a, b)
        kept = 100 * (both - apart) >= percent * (both + apart)
        a, b = a[kept], b[kept]
        names, cuts = np.array(node, SIGNED), np.searchsorted(a, np.arange(len(node) + 1))
        for i in np.union1d(a, b).tolist():
            out.append((low, high, node[i], names[b[cuts[i] : cuts[i + 1]]]))
            size += 8 + int(cuts[i + 1] - cuts[i])
        if size >= 1 << 18:
            yield table_of(out, MATCHED)
            out, size = [], 0
    yield table_of(out, MATCHED)


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


def verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of LINKED: of each pair of blocks the sets that have links there, how many, their smallest node within reach, and their later partners."""
    out, size = [], 0
    for _, _, rows in meetings(batches):
        rows.sort(key=lambda r: r[0])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        names, sizes = np.array([r[0] for r in rows], SIGNED), np.array([len(s) for s in sets])
        a = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        b = np.searchsorted(names, np.concatenate([r[1] for r in rows]))
        shared = shared_counts(sets)[a, b]
        good = 100 * shared >= percent * (sizes[a] + sizes[b] - shared)
        a, b, shared = a[good], b[good], shared[good]
        held = np.bincount(np.concatenate([a, b]), minlength=len(rows))
        root = smallest_reached(len(rows), a, b)
        order = np.argsort(a, kind="stable")
        a, b, shared = a[order], b[order], shared[order]
        cuts = np.searchsorted(a, np.arange(len(rows) + 1))
        for i in np.flatnonzero(held).tolist():
            own = slice(cuts[i], cuts[i + 1])
            out.append((int(names[i]), int(held[i]), int(names[root[i]]), names[b[own]], shared[own].astype(np.int32)))
            size += 8 + int(cuts[i + 1] - cuts[i])
        if size >= 1 << 18:
            yield table_of(out, LINKED)
            out, size = [], 0
    yield table_of(out, LINKED)


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the pairs a, b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(root, before):
            return root


def own_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose text has the node's set: keys of texts are hashes, too."""
    for batch in batches:
        nodes, texts = (c.to_pylist() for c in batch.columns)
        found = [(node, s.tobytes()) for node, s in zip(nodes, sets_of(texts, width)) if len(s) > 0 and node_of(s) == node]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["node", "shingles"])


def by_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("low", "high").sortWithinPartitions("low", "high")


def candidates(tokens: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """MATCHED rows from the prefix rows (token, node). Only shingles that two sets have are looked at further."""
    repeated = tokens.groupBy("token").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low < _high").select("token")
    shared = materialize(tokens.join(repeated, "token", "left_semi").distinct(), "shared-prefixes")
    sized = shared.join(shared.groupBy("token").agg(F.count(F.lit(1)).alias("_held")), "token")
    leads = sized.groupBy("node").agg(F.max(F.struct("_held", "token")).alias("_top")).join(nodes, "node")
    leads = materialize(leads.select("node", F.col("_top.token").alias("lead"), "n", "m"), "leads")
    parts = leads.groupBy("lead").agg(F.expr(f"greatest(count(1) div {BLOCK_SETS}, sum(n) div {BLOCK_SHINGLES}) + 1").alias("_parts"))
    blocks = leads.join(parts, "lead").select("node", F.expr("xxhash64(lead, pmod(xxhash64(node), _parts))").alias("block"))
    placed = materialize(shared.join(blocks, "node"), "placed-prefixes")
    there = placed.groupBy("token", "block").agg(F.count(F.lit(1)).alias("_held")).withColumnRenamed("block", "_other")
    dealt = placed.join(there, "token").where("block <> _other or _held > 1")
    dealt = dealt.select(F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "node", "block", "token")
    listed = dealt.groupBy("low", "high", "node", "block").agg(F.collect_list("token").alias("tokens"))
    known = listed.join(nodes.select("node", "n", "m", "bitmap"), "node").select("low", "high", "node", "block", "n", "m", "bitmap", "tokens")
    return materialize(by_blocks(known).mapInArrow(partial(match, percent=percent), MATCHED), "candidates")


def links_of(found: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """LINKED rows of the candidates whose sets are similar, by the text of one document of each set."""
    wanted = materialize(nodes.join(found.select("node").distinct(), "node", "left_semi").select("node", F.col("best.key").alias("_key")), "candidate-nodes")
    likely = may_be_in(docs, "key", wanted, "_key").where("may_be_in").join(wanted, F.col("key") == F.col("_key"))
    sets = materialize(likely.select("node", "text").mapInArrow(partial(own_sets, width=width), "node long, shingles binary").dropDuplicates(["node"]), "candidate-sets")
    rows = found.join(sets, "node").select("low", "high", "node", "others", "shingles")
    return materialize(by_blocks(rows).mapInArrow(partial(verify, percent=percent), LINKED), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest that it reaches) of the nodes of ``edges`` (u, v).

    Large-star and small-star steps in turn: each node's neighbours move to its smallest one until only
    stars are left. A step costs a few shuffles of the edges, and the number of steps grows as the logarithm of the size.
    """

    def seen(edges):
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % F.lit(1 << 31))).first())

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = seen(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        before, after = seen(edges), before
        if before == after:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Join(NamedTuple):
    """``links``: rows of LINKED, each link once, in the list of its smaller node; a node may have several rows.
    ``classes``: node, doc_id (its smallest id), n (shingles). ``members``: doc_id, key, n, node of every document; node is null without words."""

    links: DataFrame
    classes: DataFrame
    members: DataFrame

    def by_id(self) -> DataFrame:
        """id_a, id_b, n_a, n_b, shared: the links between the smallest ids of the classes, a row each."""
        pairs = self.links.select(F.col("node").alias("a"), F.explode(F.arrays_zip("others", "shared")).alias("p")).select("a", F.col("p.others").alias("b"), F.col("p.shared").alias("shared"))
        sides = [self.classes.select(F.col("node").alias(x), F.col("doc_id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("id_a", "id_b", "n_a", "n_b", "shared")

    def by_document(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id, n_links (classes that this one links with) of every document."""
        roots = components(self.links.select(F.col("node").alias("u"), F.col("root").alias("v")))
        held = self.links.groupBy("node").agg(F.sum("n_links").alias("n_links")).join(roots, "node")
        linked = materialize(self.classes.select("node", "doc_id").join(held, "node"), "linked-classes")
        smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        marked = linked.join(smallest, "root").select("node", "n_links", "component_id")
        labels = self.classes.select("node", "doc_id").join(marked, "node", "left")
        labels = labels.select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        # a class may hold a large share of the documents: nothing needs its rows together, so the join can split it
        known = self.members.where("node is not null").join(labels, "node", "left")
        alone = self.members.where("node is null").select("*", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        columns = ["doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links"]
        return known.select(columns).unionByName(alone.select(columns))


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> Join:
    """All links between distinct sets, with the membership of the documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    counted = materialize(docs.select("text").mapInArrow(partial(count_buckets, width=width), COUNTS), "counted")
    table = spark.sparkContext.broadcast(Rarity(bucket_table(counted.where("chunk is not null").select("chunk", "slot", "counts")), *heavy_shingles(counted)))
    passed = materialize(docs.mapInArrow(partial(prefixes, width=width, percent=percent, shared=table), PASSED), "passed")
    table.unpersist()
    members = passed.where("token is null").select("doc_id", "key", "n", "node")
    best = F.min(F.struct("doc_id", "key")).alias("best")  # a null id comes first
    named = F.min("doc_id").alias("doc_id")
    nodes = passed.where("token is null and node is not null").groupBy("node").agg(best, named, F.max("n").alias("n"), F.max("m").alias("m"), F.max("bitmap").alias("bitmap"))
    nodes = materialize(nodes, "nodes")
    found = candidates(passed.where("token is not null").select("token", "node"), nodes, percent)
    return Join(links_of(found, docs, nodes, width, percent), nodes.select("node", "doc_id", "n"), members)


def text_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included), n_links."""
    return ngram_join(docs, width, percent, id_col, text_col).by_document().drop("key")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component; rows without words all stay.

    Rows that repeat an id and text stay together or go together; exact deduplication comes first. Rows go by id and text, so another
    text with the same id stays.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    groups = ngram_join(docs, **options).by_document()
    key, gone_id, flag = (fresh(docs, x) for x in ("text_key", "gone_id", "may_go"))
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id), F.col("key").alias(key))
    gone = materialize(gone.distinct(), "gone")
    keyed = may_be_in(docs.withColumn(key, text_key(id_col, text_col)), key, gone, key, flag)
    doubtful = keyed.where(flag).withColumn(gone_id, F.col(id_col).cast("long")).join(gone, [key, gone_id], "left_anti")
    return keyed.where(f"not {flag}").select(docs.columns).unionByName(doubtful.select(docs.columns))
