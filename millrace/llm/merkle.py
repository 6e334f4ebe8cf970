"""A Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources' roots, and a proof for every row.

Superblock reduction: nodes get gapless indexes within their tree; those with the same ``index // fanout**levels`` form a bucket, and
one group function collapses a bucket by ``levels`` levels at once. The buckets' roots are the nodes of the next pass, so a tree of n leaves takes
log(n) / (levels * log(fanout)) passes, and a task never holds more than fanout**levels nodes of a tree. A row's proof is the path within its
bucket, then that of its bucket's root, and so on up through the tree of sources.

A bucket needs no knowledge of the tree's size: only bucket 0 may be a whole tree, and then it collapses until one node is left, which for a
full bucket takes ``levels`` levels as well. Every other bucket belongs to a larger tree and collapses by exactly ``levels``.

Indexes come from a range partition by (source, id, leaf): a row's index is its position in its partition plus the number of its source's rows in
earlier ones, so a source that holds most rows is spread over many tasks. No task and no driver holds a tree; only the one root is collected.

Null ids come first and null sources are a source of their own, which comes first. Rows that repeat an id are leaves of their own, ordered by their
hashes; rows that are alike are leaves with equal hashes. Null columns count as ``-``. Texts are hashed whole in the JVM. Only the named columns are read, so
other columns may have any name. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize

#: Children of a node, and the levels that a group collapses at once: 3**7 = 2187 nodes a group.
FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)).cast("binary"), 256))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def step(run: list[bytes], place: int) -> bytes:
    """A level of a path: a byte with the place in the run and the run's length, then the siblings from left to right."""
    return bytes([place << 4 | len(run)]) + b"".join(run[:place] + run[place + 1 :])


def siblings_of(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place and siblings of each level of a path, from the leaf up."""
    at = 0
    while at < len(path):
        place, n = path[at] >> 4, (path[at] & 15) - 1
        at += 1
        yield place, [path[i : i + DIGEST] for i in range(at, at + n * DIGEST, DIGEST)]
        at += n * DIGEST


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path lead to."""
    for place, others in siblings_of(path):
        node = parent([*others[:place], node, *others[place:]])
    return node


def path_digest(path: bytes) -> str:
    return hashlib.sha256("".join(s.hex() for _, others in siblings_of(path) for s in others).encode()).hexdigest()


def collapsed(nodes: list[bytes], fanout: int, levels: int | None) -> tuple[bytes, list[bytes]]:
    """The root of a bucket after ``levels`` levels (None: until one node is left), and each node's path to it."""
    paths, width, done = [[] for _ in nodes], 1, 0
    while len(nodes) > 1 if levels is None else done < levels:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        steps = [step(run, place) for run in runs for place in range(len(run))]
        for i, path in enumerate(paths):
            path.append(steps[i // width])
        nodes, width, done = [parent(run) for run in runs], width * fanout, done + 1
    return nodes[0], [b"".join(p) for p in paths]


def bucket_collapser(fanout: int, levels: int):
    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        """Adds path to each node of a bucket, and root to its first."""
        rows = rows.sort_values("idx")
        root, paths = collapsed(rows["node"].tolist(), fanout, levels if rows["bucket"].iloc[0] else None)
        return rows.assign(path=paths, root=[root] + [None] * (len(rows) - 1))

    return collapse


def indexed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with idx: the gapless place from 0 within ``tree``, by ``order``.

    The table of starts has a row for each tree and each partition that a tree reaches into; Spark broadcasts it or not by its size.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("_run", F.shiftright("_at", 33))
    earlier = Window.partitionBy("tree").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("tree", "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = runs.select("tree", "_run", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ranged.join(starts, ["tree", "_run"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")


def reduced(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Collapse trees (tree, idx, node, others) pass by pass: each pass's nodes with bucket and path, and tree and node of the roots."""
    passes = []
    while True:
        dealt = nodes.withColumn("bucket", F.expr(f"idx div {fanout**levels}"))
        schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", path binary, root binary"
        done = dealt.groupBy("tree", "bucket").applyInPandas(bucket_collapser(fanout, levels), schema)
        passes.append(materialize(done, "superblocks"))
        roots = passes[-1].where("root is not null")
        if roots.where("bucket > 0").isEmpty():
            return passes, roots.select("tree", F.col("root").alias("node"))
        nodes = roots.select("tree", F.col("bucket").alias("idx"), F.col("root").alias("node"))


def upper_paths(passes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, bucket and upper (the path of the bucket's root to the top) for the buckets of the first pass, and what else ``tops`` has a tree."""
    found = tops.withColumn("bucket", F.lit(0).cast("long"))
    for done in reversed(passes[1:]):
        lower = done.select("tree", "bucket", "idx", "path")
        joined = lower.join(found, ["tree", "bucket"]).withColumn("upper", F.concat("path", "upper"))
        found = joined.drop("bucket", "path").withColumnRenamed("idx", "bucket")
    return found


def check_rows(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    """Fold each row's leaf, or its tampered one, along its path."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, leaf, tampered, path, upper, subroot in zip(*(c.to_pylist() for c in batch.columns)):
            path += upper
            reached = folded(tampered or leaf, path)
            rows.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), path_digest(path), reached.hex(), reached == root))
        columns = list(zip(*rows)) or [[]] * len(names)
        types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def dataset_leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """tree (orders as the sources do, null first), doc_id, node, and tampered: the leaf with ``tampered_text``, null where it isn't given."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    tampered = F.lit(None).cast("binary") if tampered_text is None else F.when(tampered_text.isNotNull(), leaf_hash(doc_id, source, lang, n_chars, tampered_text))
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0")).alias("tree"),
        doc_id.cast("long").alias("doc_id"),
        leaf_hash(doc_id, source, lang, n_chars, text).alias("node"),
        tampered.alias("tampered"),
    )


def manifest(docs: DataFrame, tampered_text: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a document.

    Where ``tampered_text`` isn't null the proof is checked against a document with that text, else against the document itself.
    """
    if not 2 <= fanout <= 15 or levels < 1:
        raise ValueError("fanout is 2 to 15 and levels at least 1")
    leaves = indexed(materialize(dataset_leaves(docs, tampered_text), "leaves"), ["doc_id", "node"])
    passes, subroots = reduced(leaves, fanout, levels)
    sources = indexed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"])
    top_passes, top = reduced(sources, fanout, levels)
    root = top.select("node").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    over = upper_paths(top_passes, top.select("tree", F.lit(b"").alias("upper")))
    tops = top_passes[0].join(over, ["tree", "bucket"]).select(F.col("source").alias("tree"), F.col("node").alias("subroot"), F.concat("path", "upper").alias("upper"))
    proofs = passes[0].join(upper_paths(passes, tops), ["tree", "bucket"])
    rows = proofs.select("doc_id", F.col("node").alias("leaf"), "tampered", "path", "upper", "subroot")
    return rows.mapInArrow(partial(check_rows, root=bytes(root["node"])), RESULT)


def newlines_deleted(doc_id: Column, text: Column) -> Column:
    """``text`` without its line feeds where 2 divides the checksum of the id; elsewhere null, as where the text is null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
