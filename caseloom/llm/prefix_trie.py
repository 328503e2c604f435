"""The prefix trie of conversations, with a count-min screen before the shuffle.

A node of the trie is a distinct sequence of first turns. Each conversation has one prefix a turn,
known by a 128-bit digest. A count-min sketch of all digests never estimates too low, so a prefix
with an estimate of one belongs to one conversation only: its node is written where the row is.
Only the other prefixes, possibly shared, are shuffled and grouped exactly.

Figures of subtrees need no walk through the tree. A node's smallest member represents it, and
whoever represents a node represents every longer prefix of its own that it shares. So what a
subtree sums is a sum over the node's members of what each has from some depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import if_small, materialise
from caseloom.operators.skew import lookup_join, number_rows

# A conversation is summed up in blocks of so many turns, which a long one has many of.
BLOCK_TURNS = 4096
# Rows of the sketch, and the logarithm of the most cells (of a byte) in one: 32 MB in all.
ROWS = 2
MAX_LOG_CELLS = 24
# Cells a prefix, as long as the bound allows.
CELLS_PER_PREFIX = 8
# The sketch travels in slices of so many cells, from at most so many tasks.
SLICE_CELLS = 1 << 16
SKETCH_TASKS = 1024
# Ids of conversations that are joined to one text before they are put into order across tasks.
CHUNK_IDS = 8192

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass
class Trie:
    """``shared`` and ``single``: one row a node that was, or was not, grouped exactly.

    Their columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends, and the node's digest ``_a, _b``. ``ends`` has ``_a, _b, conv_id``, the members
    that end at nodes of ``shared``; those of ``single`` have the one member conv_id.
    """

    shared: DataFrame
    single: DataFrame
    ends: DataFrame


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, words`` by turn, position from 1.

    Turns are ordered by ``turn``, null first, and by their digest where it is the same. Rows
    without a conv_id are left out. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    numbered = number_rows(rows, [F.asc_nulls_first("turn"), F.asc("digest")], "conv_id")
    return materialise(numbered.select("conv_id", "position", "digest", "words"), "turns")


def rebuilt(turns: DataFrame, every: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their family's head.

    Conversation c takes the first h turns of conversation ``c - c % every`` (all if it has fewer,
    none if there is no such conversation), then its own turns after its first h; h is the
    checksum of its id modulo ``choices``. Returns ``conv_id, depth, digest, words, n_turns`` by turn
    and ``conv_id, n_turns`` by conversation, also for one that is left without a turn.
    """
    heads = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("position") < choices))
        .groupBy(F.col("conv_id").alias("_base"))
        # Less than ``choices`` entries.
        .agg(F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("_head"))
    )
    own = turns.groupBy("conv_id").agg(F.max("position").alias("_own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % choices).cast("int")
    convs = (
        own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every)
        .withColumn("_h", h)
        .join(heads, "_base", "left")
        .withColumn("_head", F.slice(F.coalesce("_head", F.array().cast(heads.schema["_head"].dataType)), F.lit(1), F.col("_h")))
        .withColumn("_taken", F.size("_head"))
        .withColumn("n_turns", (F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).cast("bigint"))
    )
    convs = materialise(convs.select("conv_id", "_h", "_head", "_taken", "n_turns"), "families")
    first = convs.select("conv_id", "n_turns", F.posexplode("_head").alias("_at", "_turn")).select(
        "conv_id", (F.col("_at") + 1).cast("bigint").alias("depth"), "_turn.digest", "_turn.words", "n_turns"
    )
    later = lookup_join(turns, convs.select("conv_id", "_h", "_taken", "n_turns"), "conv_id", "position", "inner").where(
        "position > _h"
    ).select(
        "conv_id", (F.col("position") - F.col("_h") + F.col("_taken")).cast("bigint").alias("depth"), "digest", "words", "n_turns"
    )
    return first.union(later), convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per prefix of ``turns`` (conv_id, depth, digest, words, n_turns).

    Columns: conv_id, depth, words (of its last turn), ``_upto`` (words of the whole prefix), its
    digest ``_a, _b``, that of the prefix one turn shorter ``_pa, _pb``, and ``_last``, whether the
    conversation ends with it. A digest is the sum without carry of hashes of place and turn, so the
    blocks of a long conversation are summed up apart and put together.
    """
    keyed = turns.select(
        "conv_id", "depth", "words", (F.col("depth") == F.col("n_turns")).alias("_last"), "n_turns",
        F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("_block"),
        F.xxhash64("depth", "digest").alias("_h1"), F.xxhash64(F.lit("second"), "digest", "depth").alias("_h2"),
    )
    so_far = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_a": F.bit_xor("_h1"), "_b": F.bit_xor("_h2"), "_upto": F.sum("words")}
    # A row for BLOCK_TURNS turns of the conversations with more than one block.
    blocks = (
        keyed.where(F.col("n_turns") > BLOCK_TURNS).groupBy("conv_id", "_block")
        .agg(F.bit_xor("_h1").alias("_h1"), F.bit_xor("_h2").alias("_h2"), F.sum("words").alias("words"))
    )
    offsets = materialise(
        blocks.select("conv_id", "_block", *[v.over(before).alias("_before" + k) for k, v in sums.items()]).where("_block > 0"),
        "offsets",
    )
    placed = keyed.select("*", *[v.over(so_far).alias(k) for k, v in sums.items()]).join(
        if_small(offsets, offsets.count()), ["conv_id", "_block"], "left"
    )
    a, b = (F.col(k).bitwiseXOR(F.coalesce("_before" + k, F.lit(0))) for k in ("_a", "_b"))
    whole = placed.select(
        "conv_id", "depth", "words", (F.col("_upto") + F.coalesce("_before_upto", F.lit(0))).alias("_upto"),
        a.alias("_a"), b.alias("_b"), a.bitwiseXOR(F.col("_h1")).alias("_pa"), b.bitwiseXOR(F.col("_h2")).alias("_pb"), "_last",
    )
    return materialise(whole, "prefixes")


def cells(a: np.ndarray, b: np.ndarray, log_cells: int) -> Iterator[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    for row in range(ROWS):
        own = (a + np.uint64(row) * b) * np.uint64(0x9E3779B97F4A7C15)
        yield (own >> np.uint64(64 - log_cells)).astype(np.int64) + (row << log_cells)


def count_min(rows: DataFrame, n_rows: int) -> tuple[np.ndarray, int]:
    """The sketch of the digests in ``rows`` (_a, _b), counting up to 255, and the logarithm of its cells.

    Tasks fill sketches of their own, which are added slice by slice; the driver gets the one sum,
    of at most ``ROWS << MAX_LOG_CELLS`` bytes.
    """
    log_cells = min(MAX_LOG_CELLS, max(10, (max(n_rows, 1) * CELLS_PER_PREFIX - 1).bit_length()))
    step = min(SLICE_CELLS, ROWS << log_cells)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS << log_cells, np.uint8)
        for batch in batches:
            for own in cells(batch.column("_a").to_numpy(), batch.column("_b").to_numpy(), log_cells):
                at, n = np.unique(own, return_counts=True)
                total[at] = np.minimum(total[at] + n, 255)
        for k in range(0, len(total), step):
            if total[k : k + step].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // step], pa.int32()), pa.array([total[k : k + step].tobytes()], pa.binary())], ["slice", "counts"]
                )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint16)
        for counts in table.column("counts"):
            total = np.minimum(total + np.frombuffer(counts.as_buffer(), np.uint8), 255)
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.astype(np.uint8).tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    found = (
        rows.select("_a", "_b").coalesce(SKETCH_TASKS).mapInArrow(fill, schema).groupBy("slice").applyInArrow(add, schema).toArrow()
    )
    sketch = np.zeros(ROWS << log_cells, np.uint8)
    for k, counts in zip(found.column("slice").to_pylist(), found.column("counts").to_pylist()):
        sketch[k * step : (k + 1) * step] = np.frombuffer(counts, np.uint8)
    return sketch, log_cells


def screened(rows: DataFrame) -> DataFrame:
    """Add ``_alone`` and ``_parent_alone``: the prefix, or that one turn shorter, has one conversation for certain."""
    sketch, log_cells = count_min(rows, rows.count())
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    names = [*rows.columns, "_alone", "_parent_alone"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _alone boolean, _parent_alone boolean"

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            column = {name: batch.column(name).to_numpy() for name in ("_a", "_b", "_pa", "_pb", "depth")}
            alone, above = (
                np.min([counts[own] for own in cells(column[a], column[b], log_cells)], axis=0) == 1 for a, b in (("_a", "_b"), ("_pa", "_pb"))
            )
            # The root is above the first turn and everyone's.
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above & (column["depth"] > 1))], names)

    return materialise(rows.mapInArrow(test, schema), "screened")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of ``turns`` (conv_id, depth, digest, words, n_turns) of ``conversations`` (conv_id, n_turns).

    ``n_convs`` are a node's members, ``n_children`` the nodes one turn longer, ``n_leaves`` the nodes
    without children in its subtree, itself included, ``n_ends`` the members that end at it.
    ``saved_tokens`` sums, over the subtree, (members - 1) times the words of a node's last turn: what
    need not be computed again if each prefix is computed once.

    Conversations without a turn are members of the root, which has depth 0 and no parent. Equal
    conversations are members of the same nodes. No table, no node. Other columns are ignored.
    """
    tested = screened(prefixes(turns))
    roots = conversations.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("words", "_upto", "_a", "_b", "_pa", "_pb")],
        (F.col("n_turns") == 0).alias("_last"), F.lit(False).alias("_alone"), F.lit(False).alias("_parent_alone"),
    )
    maybe = tested.where("not _alone").union(roots)
    local = tested.where("_alone")
    key = ["_a", "_b"]
    start = F.col("_upto") - F.col("words")

    grouped = materialise(
        maybe.groupBy(*key).agg(
            F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.min("_pa").alias("_pa"), F.min("_pb").alias("_pb"), F.bool_or("_parent_alone").alias("_parent_alone"),
            F.min_by(start, "conv_id").alias("_start"), F.count_if("_last").alias("n_ends"),
        ),
        "shared-nodes",
    )
    below = "depth > 0 and not _parent_alone"
    children = (
        grouped.where(below).select("_pa", "_pb").union(local.where(below).select("_pa", "_pb"))
        .groupBy(F.col("_pa").alias("_a"), F.col("_pb").alias("_b")).agg(F.count("*").alias("n_children"))
    )
    nodes = materialise(
        grouped.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"
    )

    # By conversation: the words before the first prefix that it represents, all words, and whether
    # it represents a node without children.
    no, none = F.lit(False), F.lit(None).cast("bigint")
    top = ~F.col("_parent_alone")
    said = (
        nodes.select("conv_id", "depth", "_start", none.alias("_all"), (F.col("n_children") == 0).alias("_leaf"))
        .union(local.where(top | F.col("_last")).select("conv_id", F.when(top, F.col("depth")), start, none, "_last"))
        .union(maybe.where("_last").select("conv_id", none, none, "_upto", no))
    )
    members = said.groupBy("conv_id").agg(
        F.coalesce(F.min_by("_start", "depth"), F.max("_all")).alias("_until"), F.bool_or("_leaf").cast("bigint").alias("_leaf")
    )
    tallies = (
        lookup_join(maybe.select("conv_id", "depth", start.alias("_from"), *key), materialise(members, "members"), "conv_id", "depth", "inner")
        .groupBy(*key)
        .agg(F.sum("_leaf").alias("n_leaves"), F.sum(F.greatest(F.col("_until") - F.col("_from"), F.lit(0))).alias("saved_tokens"))
    )
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", *key, "_pa", "_pb", "_parent_alone"]
    one = F.lit(1).cast("bigint")
    tails = local.select(
        "conv_id", "depth", one.alias("n_convs"), F.when(F.col("_last"), 0).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), F.col("_last").cast("bigint").alias("n_ends"), *columns[7:],
    )
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.select(F.struct(*key).alias("_parent"), F.col("conv_id").alias("parent_conv_id"))

    def with_parents(rows: DataFrame) -> DataFrame:
        asking = "depth > 1 and not _parent_alone"
        known = F.when(F.col("_parent_alone"), F.col("conv_id")).when(F.col("depth") == 1, F.lit(root[0] if root else None))
        result = [*columns[:2], "parent_conv_id", *columns[2:9]]
        direct = rows.where(f"not ({asking})").withColumn("parent_conv_id", known.cast("bigint"))
        looked_up = lookup_join(
            rows.where(asking).withColumn("_parent", F.struct(F.col("_pa").alias("_a"), F.col("_pb").alias("_b"))), parents, "_parent", "conv_id"
        )
        return direct.select(*result).union(looked_up.select(*result))

    shared = with_parents(materialise(nodes.join(tallies, key).select(*columns), "tallied"))
    return Trie(shared, with_parents(tails), maybe.where("_last").select(*key, "conv_id"))


def runs(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple[int, int], list]]:
    """The ``value`` entries of rows (_a, _b, ...) that are sorted by ``_a, _b``, key by key and batch by batch."""
    for batch in batches:
        a, b = batch.column("_a").to_numpy(), batch.column("_b").to_numpy()
        values = batch.column(value).to_pylist()
        cuts = [0, *(np.nonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))[0] + 1).tolist(), len(a)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                yield (int(a[start]), int(b[start])), values[start:end]


def ends_digests(ends: DataFrame) -> DataFrame:
    """``_a, _b, ends_sha256``: the SHA-256 of a node's sorted ids (conv_id), joined by commas.

    A digest is made from the first id to the last, so the ids of one node meet in one task, but as
    texts of up to ``CHUNK_IDS`` ids: a range sort deals the ids out to all tasks first, also those of
    a node that holds most of them. No task holds more than one such text.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int, str]] = []
        key, held = None, []

        def rows() -> pa.RecordBatch:
            names = ["_a", "_b", "_first", "_ids"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)
            done.clear()
            return batch

        for own, ids in runs(batches, "conv_id"):
            if key is not None and (own != key or len(held) >= CHUNK_IDS):
                done.append((*key, held[0], ",".join(map(str, held))))
                held = []
            key = own
            held += ids
            while len(held) > CHUNK_IDS:
                done.append((*key, held[0], ",".join(map(str, held[:CHUNK_IDS]))))
                held = held[CHUNK_IDS:]
            if len(done) >= 1000:
                yield rows()
        if held:
            done.append((*key, held[0], ",".join(map(str, held))))
        if done:
            yield rows()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple[int, int, str]] = []

        def rows() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], ["_a", "_b", "ends_sha256"])
            done.clear()
            return batch

        for own, texts in runs(batches, "_ids"):
            if own == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(",".join(texts).encode())
            if len(done) >= 1000:
                yield rows()
        if key is not None:
            done.append((*key, state.hexdigest()))
        if done:
            yield rows()

    dealt = ends.select("_a", "_b", "conv_id").repartitionByRange("_a", "_b", "conv_id").sortWithinPartitions("_a", "_b", "conv_id")
    chunks = dealt.mapInArrow(chunk, "_a bigint, _b bigint, _first bigint, _ids string")
    ordered = chunks.repartition("_a", "_b").sortWithinPartitions("_a", "_b", "_first")
    return ordered.mapInArrow(digest, "_a bigint, _b bigint, ends_sha256 string")


def with_ends(trie: Trie) -> DataFrame:
    """All nodes with ``ends_sha256``, the digest of the ids that end there; of the empty text if none does."""
    shared = trie.shared.join(ends_digests(trie.ends), ["_a", "_b"], "left").select(
        *trie.shared.columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
    own = F.when(F.col("n_ends") == 1, F.col("conv_id").cast("string")).otherwise("")
    return shared.union(trie.single.withColumn("ends_sha256", F.sha2(own, 256)))
