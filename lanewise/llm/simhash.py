"""Near duplicates by SimHash, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into ``max_bits + 1`` segments on a ring.  If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
in which every run of ``n`` consecutive segments differs in at most
``n * max_bits / (max_bits + 1)`` bits, rounded down: none in the first, one in
the first two, and so on.  So the first segment is equal, and one half of the
second is: that pair of pieces is the key under which fingerprints meet.  Pairs
that meet must pass the rest of the chain, whose last link is the full Hamming
check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import components
from lanewise.llm.stages import row_key, staged

BITS = 64
SEED = 42
#: Fingerprints under one key beyond which the key is cut into slices that meet
#: pair by pair, each pair in a task of its own.
SLICE = 2000
#: Keys with at most so many fingerprints are compared all at once.
SMALL = 16


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles, repeats included; 0 if there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = ends[min(shingle, len(words)) - 1 :]
    spans = zip(starts[: len(last)].tolist(), last.tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(last)
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(text: Column, shingle: int) -> Column:
    """Fingerprint of a text column as a long."""

    def batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    return F.pandas_udf(batch, "long")(text)


def segments(max_bits: int) -> list[int]:
    """Bit masks of the ring's segments, all but equally wide."""
    edges = np.linspace(0, BITS, max_bits + 2).round().astype(int)
    return [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:], strict=False)]


def halves(mask: int) -> list[int]:
    """The lower and the upper half of a segment."""
    low = (mask & -mask).bit_length() - 1
    width = mask.bit_count()
    half = ((1 << width // 2) - 1) << low
    return [x for x in (half, mask ^ half) if x]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring_keys(max_bits: int) -> list[tuple[int, int]]:
    """The segment that starts a chain, and the mask of the bits equal there."""
    ring = segments(max_bits)
    if max_bits == 0:
        return [(0, ring[0])]
    return [
        (i, ring[i] | half)
        for i in range(len(ring))
        for half in halves(ring[(i + 1) % len(ring)])
    ]


def chains(max_bits: int) -> np.ndarray:
    """For each start the masks of its chain: one segment, two, ..., all."""
    ring = segments(max_bits)
    return np.array(
        [list(accumulate([*ring[i:], *ring[:i]], or_)) for i in range(len(ring))],
        np.uint64,
    )


def linked(differ: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Whether differences pass every link of a chain: n - 1 bits in n segments."""
    ok = np.ones(differ.shape, bool)
    for budget, mask in enumerate(chain):
        ok &= np.bitwise_count(differ & mask) <= budget
    return ok


def links_in_cells(max_bits: int):
    """Links within runs of rows with one key, reduced to a tree for each run."""
    chain = chains(max_bits)

    def tree(prints: np.ndarray, start: int):
        rest = prints
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                one = front.pop()
                near = linked(rest ^ one, chain[start])
                found, rest = rest[near], rest[~near]
                front.extend(found)
                yield np.full(len(found), one), found

    def small(prints: np.ndarray, group: np.ndarray, start: np.ndarray):
        for step in range(1, SMALL):
            at = np.flatnonzero(group[step:] == group[:-step])
            if not len(at):
                return
            a, b = prints[at], prints[at + step]
            differ, by = a ^ b, start[at]
            for s in np.unique(by):
                of = np.flatnonzero(by == s)
                of = of[linked(differ[of], chain[s])]
                yield a[of], b[of]

    def found_in(rows: pd.DataFrame):
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        start = rows["start"].to_numpy()
        keys = rows[["ring", "key", "cell"]].to_numpy()
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        edges = np.r_[0, new, len(rows)]
        size = np.diff(edges)
        group = np.repeat(np.arange(len(size)), size)
        few = (size <= SMALL)[group]
        yield from small(prints[few], group[few], start[few])
        for g in np.flatnonzero(size > SMALL):
            yield from tree(prints[edges[g] : edges[g + 1]], start[edges[g]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for rows in batches:
            if not len(rows):
                continue
            tail = rows[["ring", "key", "cell"]].iloc[-1]
            same = (rows[["ring", "key", "cell"]] == tail).all(axis=1).to_numpy()
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from emitted(pd.concat([*waiting, rows.iloc[:cut]]))
                waiting = []
            waiting.append(rows.iloc[cut:])
        if waiting:
            yield from emitted(pd.concat(waiting))

    def emitted(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pairs = list(found_in(rows))
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
            yield pd.DataFrame({"a": a, "b": b})

    return run


def print_links(prints: DataFrame, max_bits: int, slice_rows: int = SLICE) -> DataFrame:
    """Links ``a, b`` that join exactly the ``print`` values a chain of links joins.

    ``prints`` holds distinct fingerprints.  A key with more than ``slice_rows``
    of them is cut into slices by a hash, and each two slices meet in a cell of
    their own, so no task gets more than two slices at a time.
    """
    ring = ring_keys(max_bits)
    keys = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(n).alias("ring"),
                    F.lit(start).alias("start"),
                    F.col("print").bitwiseAND(F.lit(signed(mask))).alias("key"),
                )
                for n, (start, mask) in enumerate(ring)
            )
        )
    )
    rows = prints.select("print", keys.alias("k")).select("print", "k.*")
    crowded = (
        rows.groupBy("ring", "key")
        .count()
        .where(F.col("count") > slice_rows)
        .select("ring", "key", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    )
    rows = rows.join(crowded, ["ring", "key"], "left")
    slices = F.coalesce("slices", F.lit(1))
    own = F.pmod(F.xxhash64("print"), slices).cast("int")
    rows = rows.withColumn("slices", slices).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    cell = F.least("own", "other") * F.col("slices") + F.greatest("own", "other")
    cells = rows.select("ring", "key", cell.alias("cell"), "start", "print")
    cells = cells.repartition("ring", "key", "cell")
    cells = cells.sortWithinPartitions("ring", "key", "cell")
    return cells.mapInPandas(links_in_cells(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, row, print, root, component_id`` of every row of ``docs``.

    ``print`` is the fingerprint as a long, ``root`` the fingerprint that names
    the component, and ``component_id`` the smallest id that links of at most
    ``max_bits`` differing bits reach from the row, itself included.  ``row`` is
    the row's :func:`row_key`.  Equal fingerprints meet once, as one value with
    its smallest id; links join values, never copies.

    A null or empty text has fingerprint zero and is linked like any other.  A
    null id never is the smallest; a component of null ids has a null
    ``component_id``.  Repeated rows and repeated ids give one row each.  An
    empty table gives an empty table.  Other columns are not read.
    """
    seen = docs.select(
        F.col(doc_id).alias("doc_id"),
        row_key(F.col(doc_id), F.col(text)).alias("row"),
        fingerprints(F.col(text), shingle).alias("print"),
    )
    seen = staged(seen, "prints")
    values = staged(seen.groupBy("print").agg(F.min("doc_id").alias("first_id")), "values")
    roots = components(print_links(values.select("print"), max_bits))
    named = values.join(roots.withColumnRenamed("node", "print"), "print", "left")
    named = named.withColumn("root", F.coalesce("root", "print"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(smallest, "root").select("print", "root", "component_id"), "named")
    return seen.join(named, "print").select(
        "doc_id", "row", "print", "root", "component_id"
    )


def one_of_each(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row of ``docs`` for each component: that with its smallest id.

    Among rows that share this id the one with the smallest hash of its text
    stays, and of repeats of that row one.  In a component of null ids the hash
    alone decides.  All columns of ``docs`` are returned as they are.
    """
    found = near_duplicates(docs, shingle, max_bits, doc_id, text)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "row")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    kept = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text)))
    kept = kept.join(first.select(F.col("first.row").alias("__row")), "__row")
    return kept.dropDuplicates(["__row"]).drop("__row")
