"""Near-duplicate groups: b-bit MinHash signatures and a multi-index Hamming join.

A signature has ``k`` symbols of 16 bits. It is split into chunks so that two signatures that
differ in at most T symbols differ in at most one symbol of some chunk (pigeonhole). Each chunk
is indexed once per symbol with that symbol masked, which enumerates the allowed error: every
pair within the distance T shares a key. T is the smallest distance that a pair at the wanted
similarity exceeds with a chance below ``MISS``. All links are confirmed on the full shingle sets.

Pairs inside a key's bucket are not listed. First each document is compared with the smallest
document it shares a bucket with. In buckets whose documents then lie in one component every
link is implied; in the others, documents outside the bucket's largest component are compared
with all that lie in another component, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import if_small, materialise, slices, tidy
from caseloom.operators.skew import lookup_join

SYMBOLS = 64
MISS = 1e-5
BLOCK = 256
SEED = 0x9E3779B97F4A7C15
FIELDS = "_id bigint, n_shingles bigint, _set_a bigint, _set_b bigint, _sig array<int>"


def largest_distance(threshold: float, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The smallest T that the distance of a pair at ``threshold`` exceeds with chance <= miss."""
    p, within = 1 - threshold, 0.0
    for distance in range(symbols + 1):
        within += comb(symbols, distance) * p**distance * (1 - p) ** (symbols - distance)
        if 1 - within <= miss:
            return distance
    return symbols


def chunks(symbols: int, distance: int) -> list[list[int]]:
    """Symbol positions by chunk: so many chunks that one has at most one of ``distance`` errors."""
    n = min(distance // 2 + 1, symbols)
    return [[int(p) for p in part] for part in np.array_split(np.arange(symbols), n)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    Bytes are lower-cased and split as ASCII, which leaves other letters alone. With fewer words
    than ``width`` the whole sequence is the one shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    total = np.full(n, SEED + span, np.uint64)
    for k in range(span):
        total = mixed(total + hashes[k : k + n] * np.uint64(2 * k + 3))
    return np.unique(total)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The low 16 bits of the shingle with the smallest hash, for each hash function."""
    best = np.empty(len(factors), np.uint64)
    # In blocks, so that a long text needs no more memory than a short one.
    for start in range(0, len(shingles), 4096):
        block = shingles[start : start + 4096]
        smallest = (block[None, :] * factors[:, None]).min(axis=1)
        best = smallest if start == 0 else np.minimum(best, smallest)
    return (mixed(best) & np.uint64(0xFFFF)).astype(np.int32)


def signatures(docs: DataFrame, width: int, symbols: int) -> DataFrame:
    """``_id, n_shingles``, two hashes of the shingle set and the signature (null if it is empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mixed(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "_text"):
                sizes, first, second, signed = [], [], [], []
                for text in part.column("_text").to_pylist():
                    own = shingle_set(text, width)
                    sizes.append(len(own))
                    first.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(np.bitwise_xor.reduce(mixed(own + np.uint64(1))).view(np.int64)) if len(own) else 0)
                    signed.append(signature(own, factors) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(second, pa.int64()), pa.array(signed, pa.list_(pa.int32()))],
                    ["_id", "n_shingles", "_set_a", "_set_b", "_sig"],
                )

    return docs.select("_id", F.col("_text").cast("binary").alias("_text")).mapInArrow(tidy(sign), FIELDS)


def keyed_sets(docs: DataFrame, columns: list[str], width: int) -> DataFrame:
    """``columns`` and ``_set``, the shingle set of ``_text``, for texts that have one."""
    schema = ", ".join([f"{c} bigint" for c in columns] + ["_set array<bigint>"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = [shingle_set(text, width).view(np.int64) for text in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [pa.array(sets, pa.list_(pa.int64()))], [*columns, "_set"]
                )

    return docs.select(*columns, F.col("_text").cast("binary").alias("_text")).mapInArrow(tidy(build), schema).where(F.size("_set") > 0)


def masked_keys(symbols: int, distance: int) -> Column:
    """An array of keys: every chunk once per symbol, without that symbol."""
    keys = []
    for number, chunk in enumerate(chunks(symbols, distance)):
        for masked in chunk if len(chunk) > 1 else [None]:
            kept = [F.get("_sig", F.lit(p)) for p in chunk if p != masked]
            keys.append(F.xxhash64(F.lit(number), F.lit(-1 if masked is None else masked), *kept))
    return F.array(*keys)


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (_id, _to) with 100 * intersection >= percent * union of their full sets."""
    pairs = materialise(pairs, "pairs")
    n = pairs.count()
    ends = pairs.select("_to").distinct()
    left = keyed_sets(docs.join(if_small(pairs, n), "_id"), ["_id", "_to"], width)
    right = keyed_sets(docs.join(if_small(ends, n), docs["_id"] == ends["_to"], "left_semi"), ["_id"], width)
    both = left.join(right.select(F.col("_id").alias("_to"), F.col("_set").alias("_other")), "_to")
    shared = F.size(F.array_intersect("_set", "_other"))
    union = F.size("_set") + F.size("_other") - shared
    return materialise(both.where(100 * shared >= percent * union).select("_id", "_to"), "links")


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``buckets`` (_key, _id, ...) whose bucket spans several components.

    Adds ``_root``, the row's component, and ``_main``, the largest one of the bucket.
    """
    labelled = buckets.join(labels, "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
    parts = labelled.groupBy("_key", "_root").agg(F.count("*").alias("_rows"))
    open_ = (
        parts.groupBy("_key")
        .agg(F.max_by("_root", F.struct("_rows", "_root")).alias("_main"), F.count("*").alias("_parts"))
        .where("_parts > 1")
        .select("_key", "_main")
    )
    return materialise(labelled.join(open_, "_key"), "open")


def missing_links(
    docs: DataFrame, buckets: DataFrame, signs: DataFrame, width: int, percent: int, distance: int
) -> DataFrame:
    """Links (_id, _to) that join the components of ``buckets`` (_key, _id, _root, _main) further.

    Buckets with one largest component are taken together. The documents outside of it meet all
    documents of these buckets, in pairs of blocks of about ``BLOCK`` documents: signatures first,
    then full sets. A block pair returns a link only if it joins two of its components, so its
    links are no more than its documents.
    """
    rows = materialise(buckets.select("_main", "_id", "_root").distinct(), "outsiders")
    sizes = rows.groupBy("_main").agg(
        F.ceil(F.count("*") / BLOCK).alias("_all"), F.ceil(F.count_if(F.col("_root") != F.col("_main")) / BLOCK).alias("_out")
    )
    # One component may be the largest of most buckets.
    sizes = materialise(sizes, "main-sizes")
    few = if_small(sizes, sizes.count())
    dealt = rows.join(few, "_main") if few is not sizes else lookup_join(rows, sizes, "_main", "_id", "inner")
    place = F.xxhash64("_id")
    out = dealt.where("_root <> _main").select(
        "_main", "_id", "_root", F.lit(True).alias("_asks"), F.pmod(place, "_out").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_j"),
    )
    every = dealt.select(
        "_main", "_id", "_root", F.lit(False).alias("_asks"),
        F.explode(F.sequence(F.lit(0), F.col("_out") - 1)).alias("_i"), F.pmod(place, "_all").alias("_j"),
    )
    ids = materialise(rows.select("_id").distinct(), "ids")
    found = docs.join(if_small(ids, ids.count()), "_id", "left_semi")
    sets = materialise(keyed_sets(found, ["_id"], width).join(signs, "_id"), "sets")

    def link(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(
            joining_links(table, percent, distance), pa.schema([("_id", pa.int64()), ("_to", pa.int64())])
        )

    blocks = out.union(every).join(sets, "_id").groupBy("_main", "_i", "_j")
    return materialise(blocks.applyInArrow(link, "_id bigint, _to bigint"), "links")


def joining_links(table: pa.Table, percent: int, distance: int) -> list[dict[str, int]]:
    """A spanning set of the links between the asking and the other rows of a pair of blocks."""
    ids = table.column("_id").to_numpy()
    roots = table.column("_root").to_numpy().copy()
    asks = table.column("_asks").to_numpy(zero_copy_only=False)
    signs = np.array(table.column("_sig").to_pylist(), np.int32)
    sets = [np.array(s, np.int64).view(np.uint64) for s in table.column("_set").to_pylist()]
    lengths = np.array([len(s) for s in sets])
    others, links = np.nonzero(~asks)[0], []
    for x in np.nonzero(asks)[0]:
        near = others[(signs[others] != signs[x]).sum(axis=1) <= distance]
        near = near[roots[near] != roots[x]]
        if not len(near):
            continue
        flat = np.concatenate([sets[y] for y in near])
        at = np.minimum(np.searchsorted(sets[x], flat), lengths[x] - 1)
        starts = np.cumsum(lengths[near]) - lengths[near]
        shared = np.add.reduceat((sets[x][at] == flat).astype(np.int64), starts)
        linked = near[100 * shared >= percent * (lengths[x] + lengths[near] - shared)]
        for y in linked:
            if roots[y] != roots[x]:
                roots[roots == roots[y]] = roots[x]
                links.append({"_id": int(ids[x]), "_to": int(ids[y])})
    return links


def components(links: DataFrame) -> DataFrame:
    """``_id, _root``: the smallest id reachable over ``links`` (_id, _to), for all linked ids.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of a chain's length.
    """
    edges = materialise(
        links.select("_id", "_to").union(links.select(F.col("_to").alias("_id"), F.col("_id").alias("_to"))).distinct(),
        "edges",
    )
    labels = materialise(
        edges.groupBy("_id").agg(F.min("_to").alias("_n")).select("_id", F.least("_id", "_n").alias("_root")), "labels"
    )
    while True:
        offered = (
            edges.join(labels.select(F.col("_id").alias("_to"), F.col("_root").alias("_near")), "_to")
            .groupBy("_id")
            .agg(F.min("_near").alias("_near"))
        )
        nearer = labels.join(offered, "_id", "left").select(
            "_id", "_root", F.least("_root", F.coalesce("_near", "_root")).alias("_next")
        )
        jumped = nearer.join(
            nearer.select(F.col("_id").alias("_next"), F.col("_next").alias("_far")), "_next", "left"
        ).select("_id", F.col("_root").alias("_old"), F.least("_next", F.coalesce("_far", "_next")).alias("_root"))
        moved = materialise(jumped, "labels")
        labels = moved.select("_id", "_root")
        if not moved.where("_old <> _root").limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, symbols: int = SYMBOLS, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Links join documents whose sets of ``width``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100; ``component_id`` is the smallest id reachable and ``kept`` marks it.
    A link with a similarity of at least ``percent`` / 100 is missed with a chance below ``miss``.

    Null, empty and blank texts have no shingles and no links. Rows with one id are one document,
    each with its own size, linked over any of its texts. A row with a null id has no links, a null
    component and is kept. Texts of any length are read whole. An empty table gives an empty result.
    Other columns are ignored.
    """
    distance = largest_distance(percent / 100, symbols, miss)
    plain = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    signed = materialise(signatures(plain, width, symbols), "signatures")
    sets = signed.where("n_shingles > 0 and _id is not null")
    # Equal sets are linked, so one document stands for all of them: the one with the smallest id.
    classes = materialise(
        sets.groupBy("_set_a", "_set_b", "n_shingles").agg(F.min("_id").alias("_rep"), F.min("_sig").alias("_sig")),
        "classes",
    )
    members = sets.select("_id", "_set_a", "_set_b", "n_shingles").join(
        classes.drop("_sig"), ["_set_a", "_set_b", "n_shingles"]
    )
    equal = members.where("_id <> _rep").select("_id", F.col("_rep").alias("_to"))
    texts = plain.where("_id is not null")

    keys = classes.select(F.col("_rep").alias("_id"), F.explode(masked_keys(symbols, distance)).alias("_key"))
    shared = (
        keys.groupBy("_key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low < _high")
    )
    placed = materialise(keys.join(shared.select("_key", "_low"), "_key"), "buckets")
    first = placed.groupBy("_id").agg(F.min("_low").alias("_to")).where("_to < _id")
    links = confirmed(texts, first, width, percent)

    left_open = unsettled(placed.select("_key", "_id"), components(links))
    signs = classes.select(F.col("_rep").alias("_id"), "_sig")
    links = links.union(missing_links(texts, left_open, signs, width, percent, distance)).union(equal)
    labels = components(links)
    return (
        signed.join(labels, "_id", "left")
        .select(
            F.col("_id").alias("doc_id"), "n_shingles", F.coalesce("_root", "_id").alias("component_id"),
            (F.col("_id") == F.coalesce("_root", "_id")).alias("kept"),
        )
        .withColumn("kept", F.coalesce("kept", F.lit(True)))
    )
