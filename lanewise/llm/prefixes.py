"""Prefix trie of conversations, summed in flat tables of minimal perfect hashes.

A node is a distinct sequence of first turns, known by a digest chained over the
turns.  Nodes are grouped into pieces of the trie of bounded size; pieces share
shards, and in a shard every digest has a slot of a minimal perfect hash.  A slot
keeps its digest, so a digest from elsewhere is told apart.  Counts are
scattered into arrays by slot and summed upwards through the array of parent
slots, deepest nodes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import followed
from lanewise.llm.stages import WORD, staged
from lanewise.operators.skew import hot_keys, salted_join

#: A piece holds nodes whose conversations number the same power of this.
TIER = 1_000
#: Nodes that one task keeps in arrays at a time, about.
NODES_PER_SHARD = 200_000
#: Slots offered for each digest still without one.
ROOM = 2

NODE = "hi long, lo long, parent_hi long, parent_lo long"


# --- Paths --------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` of all rows with a conversation.

    Texts stay where they are: the digest of role and text stands for them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    spoken = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(spoken.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def halves(digest: bytes) -> tuple[int, int]:
    return (
        int.from_bytes(digest[:8], "big", signed=True),
        int.from_bytes(digest[8:16], "big", signed=True),
    )


class Path:
    """The nodes of one conversation, from the root down."""

    def __init__(self, conv_id: int):
        self.conv_id, self.depth, self.digest = conv_id, 0, bytes(16)

    def root(self) -> tuple:
        return (self.conv_id, 0, *halves(self.digest), None, None, 0)

    def down(self, digest: bytes, words: int) -> tuple:
        above = halves(self.digest)
        self.digest = hashlib.sha256(self.digest + digest).digest()[:16]
        self.depth += 1
        return (self.conv_id, self.depth, *halves(self.digest), *above, words)


PATH = f"conv_id long, depth long, {NODE}, words long, last boolean"
BATCH = 20_000


def in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH:
            yield pd.DataFrame(batch, columns=columns, dtype=object)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns, dtype=object)


@dataclass(frozen=True)
class Heads:
    """Conversations that start with turns of another.

    A conversation ``c`` starts with the first ``taken(c)`` turns of the first
    of its ``family`` neighbouring ids, and goes on with its own turns after as
    many of its own.  ``taken`` is at most ``most``.
    """

    family: int
    most: int
    taken: Callable[[int], int]


OWN = Heads(1, 0, lambda conv_id: 0)


def paths(spoken: DataFrame, heads: Heads = OWN) -> DataFrame:
    """The node of every conversation at every depth; ``last`` marks its end.

    Turns go by number (null first), then by digest.  A family's turns pass one
    task in order; the task holds one row, and the few turns that heads take.
    """
    family, most = heads.family, heads.most

    def rebuilt(rows: Iterator[tuple]) -> Iterator[tuple]:
        of, base, start = None, None, []
        path, held, seen, take = None, None, 0, 0
        for conv_id, digest, words in rows:
            first = conv_id - conv_id % family
            if first != of:
                of, base, start = first, None, []
            if path is None or path.conv_id != conv_id:
                if held:
                    yield (*held, True)
                path, seen = Path(conv_id), 0
                take = heads.taken(conv_id)
                held = path.root()
                if conv_id != first:
                    for turn in start[:take]:
                        yield (*held, False)
                        held = path.down(*turn)
            seen += 1
            if conv_id == first:
                if len(start) < most:
                    start.append((digest, words))
            elif seen <= take:
                continue
            yield (*held, False)
            held = path.down(digest, words)
        if held:
            yield (*held, True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            row
            for batch in batches
            for row in zip(
                batch["conv_id"].tolist(), batch["digest"], batch["words"].tolist(), strict=True
            )
        )
        return in_batches(rebuilt(rows), [c.split()[0] for c in PATH.split(", ")])

    family_of = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(family))
    return (
        spoken.withColumn("family", family_of)
        .repartition("family")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
        .select("conv_id", "digest", "words")
        .mapInPandas(task, PATH)
    )


# --- Slots --------------------------------------------------------------------


def mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """One of a family of 64-bit hashes of the digests."""
    with np.errstate(over="ignore"):
        x = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= lo.astype(np.uint64) + np.uint64((level * 0xD1B54A32D192ED03) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash of distinct digests, which it keeps by slot.

    Level by level, the digests that are alone at their bit keep it and the others
    go on.  A digest's slot is the number of kept bits before its own.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.kept: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, used = np.arange(len(hi)), 0
        while len(left):
            bits = mixed(hi[left], lo[left], len(self.kept)) % np.uint64(ROOM * len(left) + 1)
            bits = bits.astype(np.int64)
            alone = np.bincount(bits, minlength=ROOM * len(left) + 1) == 1
            self.kept.append(alone)
            self.before.append(used + np.cumsum(alone) - alone)
            used += int(alone.sum())
            left = left[~alone[bits]]
        self.hi, self.lo = np.zeros(used, np.int64), np.zeros(used, np.int64)
        slots = self._slots(hi, lo)
        self.hi[slots], self.lo[slots] = hi, lo

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (kept, before) in enumerate(zip(self.kept, self.before, strict=True)):
            bits = mixed(hi[left], lo[left], level) % np.uint64(len(kept))
            bits = bits.astype(np.int64)
            here = kept[bits]
            found[left[here]] = before[bits[here]]
            left = left[~here]
        return found

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not of the table."""
        slots = self._slots(hi, lo)
        own = slots >= 0
        own[own] = (self.hi[slots[own]] == hi[own]) & (self.lo[slots[own]] == lo[own])
        return np.where(own, slots, -1)


SUMS = ("n_children", "n_leaves", "saved_tokens")
SUMMED = "hi long, lo long, " + ", ".join(f"{c} long" for c in SUMS)


def summed_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Children, leaves and savings of the nodes of a shard's pieces.

    ``n_children``, ``n_leaves`` and ``saved_tokens`` come with what lower pieces
    and the node itself give; those of the shard are added in depth order.
    """
    hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
    table = Slots(hi, lo)
    slot = table.find(hi, lo)
    parent = np.full(len(rows), -1)
    parent[slot] = table.find(rows["parent_hi"].to_numpy(), rows["parent_lo"].to_numpy())
    flat = {}
    for name in ("depth", "single", *SUMS):
        flat[name] = np.zeros(len(rows), np.int64)
        flat[name][slot] = rows[name].to_numpy()
    # The root has no parent; its empty one may be any digest.
    inside = np.flatnonzero((parent >= 0) & (flat["depth"] > 0))
    np.add.at(flat["n_children"], parent[inside], 1)
    flat["n_leaves"][(flat["n_children"] == 0) | (flat["single"] == 1)] = 1
    inside = inside[np.argsort(-flat["depth"][inside], kind="stable")]
    ends = np.flatnonzero(np.diff(flat["depth"][inside])) + 1
    for level in np.split(inside, ends):
        for name in ("n_leaves", "saved_tokens"):
            np.add.at(flat[name], parent[level], flat[name][level])
    return pd.DataFrame({"hi": table.hi, "lo": table.lo, **{c: flat[c] for c in SUMS}})


# --- Trie ---------------------------------------------------------------------


def sha_of_ends(path: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of nodes at which conversations end.

    The digest of a node reads its ids in order, so one task reads them, one by
    one and sorted on disk if need be; only ids travel.
    """

    def shas(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        node, sha = None, None
        for batch in batches:
            for hi, lo, conv_id in zip(
                batch["hi"].tolist(), batch["lo"].tolist(), batch["conv_id"].tolist(), strict=True
            ):
                if (hi, lo) != node:
                    if node is not None:
                        yield (*node, sha.hexdigest())
                    node, sha = (hi, lo), hashlib.sha256(str(conv_id).encode())
                else:
                    sha.update(b",%d" % conv_id)
        if node is not None:
            yield (*node, sha.hexdigest())

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(shas(batches), ["hi", "lo", "ends_sha256"])

    return (
        path.where("last")
        .select("hi", "lo", "conv_id")
        .repartition("hi", "lo")
        .sortWithinPartitions("hi", "lo", "conv_id")
        .mapInPandas(task, "hi long, lo long, ends_sha256 string")
    )


def trie_nodes(path: DataFrame) -> DataFrame:
    """Every distinct node with its members, from the rows of :func:`paths`."""
    return path.groupBy("hi", "lo").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent_hi").alias("parent_hi"),
        F.min("parent_lo").alias("parent_lo"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        F.sum(F.col("last").cast("long")).alias("n_ends"),
    )


def shared_part(nodes: DataFrame) -> DataFrame:
    """Nodes of two conversations or more, and the first of each lone rest.

    Below that first node a conversation is alone: one leaf, nothing to save.
    """
    shared = nodes.where("n_convs > 1")
    at = ("depth", "hi", "lo", "parent_hi", "parent_lo", "words", "n_ends")
    lone = nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min(F.struct(*at)).alias("at"))
    lone = lone.select("conv_id", "at.*", F.lit(1).cast("long").alias("n_convs"))
    return shared.unionByName(lone)


def placed(part: DataFrame) -> DataFrame:
    """Nodes with their parent's ``parent_conv_id``, their tier and their piece.

    A piece holds the nodes below one node whose member counts are of the same
    tier; at each depth there are fewer than ``TIER`` of them.
    """
    # Powers of TIER by comparison: a logarithm would round.
    powers = [TIER**k for k in range(1, 7)]
    tier = sum(((F.col("n_convs") >= F.lit(p)).cast("int") for p in powers), F.lit(0))
    part = part.withColumn("tier", tier)
    heads = part.where("n_convs > 1").select(
        F.col("hi").alias("parent_hi"),
        F.col("lo").alias("parent_lo"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("tier").alias("parent_tier"),
    )
    keys = ["parent_hi", "parent_lo"]
    known = part.where("depth > 0")
    below = salted_join(known, heads, keys, "left", ["hi", "lo"], hot_keys(known, keys))
    top = part.where("depth = 0").withColumns(
        {"parent_conv_id": F.lit(None).cast("long"), "parent_tier": F.lit(None).cast("int")}
    )
    part = staged(below.unionByName(top), "trie-part")
    node, above = F.struct("hi", "lo"), F.struct(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))
    up = F.when(F.col("parent_tier") == F.col("tier"), above).otherwise(node)
    ends = followed(part.select(node.alias("node"), up.alias("root")))
    roots = ends.select("node.hi", "node.lo", F.xxhash64("root").alias("piece"))
    return staged(part.join(roots, ["hi", "lo"]), "trie-pieces")


def summed(pieces: DataFrame) -> DataFrame:
    """``hi, lo`` with the sums of every node, tier by tier from the smallest."""
    spark = pieces.sparkSession
    tiers = {r["tier"]: r["count"] for r in pieces.groupBy("tier").count().collect()}
    done = spark.createDataFrame([], f"{SUMMED}, tier int")
    for tier in sorted(tiers):
        # What finished pieces hand to the nodes above them.
        given = (
            pieces.where((F.col("tier") < tier) & (F.col("parent_tier") == tier))
            .join(done.drop("tier"), ["hi", "lo"])
            .groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))
            .agg(
                F.count(F.lit(1)).alias("n_children"),
                F.sum("n_leaves").alias("n_leaves"),
                F.sum("saved_tokens").alias("saved_tokens"),
            )
        )
        single = (F.col("n_convs") == 1).cast("long")
        own = (F.col("n_convs") - 1) * F.col("words")

        def with_zero(name):
            return F.coalesce(name, F.lit(0)).alias(name)

        shards = max(1, tiers[tier] // NODES_PER_SHARD)
        rows = (
            pieces.where(F.col("tier") == tier)
            .join(given, ["hi", "lo"], "left")
            .select(
                "hi",
                "lo",
                F.coalesce("parent_hi", F.lit(0)).alias("parent_hi"),
                F.coalesce("parent_lo", F.lit(0)).alias("parent_lo"),
                "depth",
                single.alias("single"),
                F.when(single == 1, 1 - F.col("n_ends"))
                .otherwise(with_zero("n_children"))
                .alias("n_children"),
                with_zero("n_leaves"),
                (F.coalesce("saved_tokens", F.lit(0)) + own).alias("saved_tokens"),
                F.pmod("piece", F.lit(shards)).cast("int").alias("shard"),
            )
        )
        sums = rows.groupBy("shard").applyInPandas(summed_up, SUMMED)
        sums = staged(sums.withColumn("tier", F.lit(tier)), "trie-sums")
        done = done.unionByName(sums)
    return done.drop("tier")


def prefix_trie(conversations: DataFrame, heads: Heads = OWN) -> DataFrame:
    """One row for each distinct sequence of first turns, the root included.

    ``conversations`` has ``conv_id, turn, role, text``; ``heads`` says which of
    them start with turns of another.  Columns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` (over the subtree, members less one times the words of the
    last text) and ``ends_sha256`` (of the ids that end there, ascending, with
    commas).

    Rows with a null ``conv_id`` belong to no conversation; a null role or text
    is empty; null turns come first and rows of one turn go by a digest of role
    and text, so repeated rows are turns of their own.  An empty table has no
    node.  Texts of any length are read whole; other columns are ignored.
    """
    path = staged(paths(turns(conversations), heads), "trie-paths")
    nodes = staged(trie_nodes(path), "trie-nodes")
    pieces = placed(staged(shared_part(nodes), "trie-shared"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    wide = pieces.where("n_convs > 1").join(summed(pieces), ["hi", "lo"])
    wide = wide.join(sha_of_ends(path), ["hi", "lo"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        *SUMS,
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    firsts = pieces.where("n_convs = 1").select(
        "conv_id", F.col("depth").alias("first"), F.col("parent_conv_id").alias("above")
    )
    alone = nodes.where("n_convs = 1").join(firsts, "conv_id")
    parent = F.when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv_id"))
    own_sha = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    lone = alone.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("n_ends") == 1, own_sha).otherwise(none).alias("ends_sha256"),
    )
    return wide.unionByName(lone)
