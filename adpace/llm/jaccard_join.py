"""N-gram Jaccard join: exact links of shingle sets over a prefix tree, and their components.

1. Shingles in the lowest quarter of the hash space are counted over all documents. Two
   bit tables of fixed size tell which of them occur twice or more, and which are heavy.
2. The global order puts light low shingles first, heavy ones last; any fixed order is
   right, this one keeps common passages out of prefixes. Linked sets share a shingle in
   their prefixes, so each set enters the index with its prefix alone. Equal sets are one.
   A large corpus fills the tables, which would let nearly every set into the index; then
   the sets whose low shingles occur elsewhere are found by joins instead (``dense_sets``).
3. In each prefix shingle's group every set is tried against the group's smallest set;
   what links is one component. Then the pairs of a group that are still apart are tried,
   after a count over their shared prefix shingles; groups of over ``LARGE`` sets in blocks,
   each pair of blocks once, so pairs are not written out. No link between different
   components is left out.
4. Sets to try are stored in a trie of their global order: sets below a node share its
   overlap with the probe, and a node from which the remaining lengths cannot reach the
   threshold prunes all sets below it. For one probe the sorted sets are walked depth first.

Components need a spanning forest of links only. ``jaccard_links`` gives every link between
different sets, and ``jaccard_link_counts`` their number: there every pair of each prefix
shingle's group that can link is tried, none left out because its sets are joined already.

Defined results: a document without words, null text included, has no shingles, links
with nothing and is its own component. Rows with equal doc_id and text are one node. The
component of a document with null doc_id is the smallest id it reaches, or null. Columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace.llm.common import batch_parts, table
from adpace.llm.shingles import Shingler
from adpace.scratch import discarded, work_dir, written

WIDTH = 4
PERCENT = 85
#: Bits of each table, whatever the input.
TABLE_BITS = 1 << 26
#: Share of the bits from which a table tells too little and joins take its place.
DENSE = 1 / 16
HEAVY = 64
#: Sets seen by a task whose copies it leaves out; forgotten when so many.
RECENT = 100_000
#: Sets tried against one set in one task.
GROUP = 512
#: Groups of more sets are tried in blocks of about ``BLOCK`` sets, not pair by pair.
LARGE = 48
BLOCK = 256
#: Rows of a batch that a task returns.
ROWS = 8192
_BUCKET = 32_768


def least_overlap(x: int, y: int, percent: int) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def smallest_linked(percent: int) -> int:
    """Smaller sets link with equal sets only."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 60


def signature(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


class _Recent:
    """Whether a signature is new to this task, as far as it remembers."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def new(self, sig: bytes) -> bool:
        if sig in self.seen:
            return False
        if len(self.seen) >= RECENT:
            self.seen.clear()
        self.seen.add(sig)
        return True


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def low_shingles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``shingle``: those in the lowest quarter, of sets that can link with different ones."""
    least = smallest_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(width), _Recent()
        for batch in (part for whole in batches for part in batch_parts(whole)):
            parts = [
                keys[: np.searchsorted(keys, np.uint64(1 << 62))]
                for keys in shingler.sets(_texts(batch))
                if len(keys) >= least and recent.new(signature(keys))
            ]
            all_keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(all_keys.view(np.int64))], names=["shingle"])

    return docs.select("text").mapInArrow(run, "shingle bigint")


def bit_tables(docs: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of low shingles found at least twice, and ``HEAVY`` times."""
    counted = low_shingles(docs, width, percent).groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 2")
    shared, heavy = _bits(counted, "shingle", {"shared": F.lit(True), "heavy": F.col("n") >= HEAVY})
    return shared, heavy


def _bits(rows: DataFrame, key: str, wanted: dict) -> list[np.ndarray]:
    """A bit table for each condition in ``wanted``, of the keys of the rows that meet it."""
    slot = F.pmod(key, F.lit(TABLE_BITS)) + 1
    bits = rows.select(
        F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"), *[c.alias(n) for n, c in wanted.items()]
    )
    # At most TABLE_BITS / 32768 rows of 4 KB for each table.
    parts = bits.groupBy("bucket").agg(*[F.bitmap_construct_agg(F.when(F.col(n), F.col("bit"))).alias(n) for n in wanted])
    tables = {n: np.zeros(TABLE_BITS // 8, dtype=np.uint8) for n in wanted}
    for row in parts.toLocalIterator():
        at = slice((row["bucket"] - 1) * _BUCKET // 8, row["bucket"] * _BUCKET // 8)
        for n in wanted:
            tables[n][at] = np.frombuffer(row[n], dtype=np.uint8)
    return list(tables.values())


def _bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(TABLE_BITS - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def in_global_order(keys: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order keys of a set, and the original key of each."""
    tier = np.ones(len(keys), dtype=np.uint64)
    low = int(np.searchsorted(keys, np.uint64(1 << 62)))
    tier[:low] = np.where(_bit(heavy, keys[:low]), 2, 0)
    order_keys = (tier << np.uint64(62)) | (keys >> np.uint64(2))
    order = np.argsort(order_keys, kind="stable")
    return order_keys[order], keys[order]


_INDEXED = "doc_id bigint, n int, sig binary, prefix array<bigint>, path binary"


def indexed(docs: DataFrame, width: int, percent: int, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: size and signature of its set; for sets that may link with different
    ones also the shared shingles of its prefix and the set in global order, big-endian."""
    shared_tables = docs.sparkSession.sparkContext.broadcast(tables)
    least = smallest_linked(percent)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64())), ("path", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, heavy = shared_tables.value
        shingler, recent = Shingler(width), _Recent()
        for batch in (part for whole in batches for part in batch_parts(whole)):
            sizes, sigs, prefixes, paths = [], [], [], []
            for keys in shingler.sets(_texts(batch)):
                sig = signature(keys) if len(keys) else None
                prefix = path = None
                # Low shingles found nowhere else are outside every intersection.
                low = keys[: np.searchsorted(keys, np.uint64(1 << 62))]
                spare = prefix_length(len(keys), percent) - 1
                if len(keys) >= least and np.count_nonzero(~_bit(shared, low)) <= spare and recent.new(sig):
                    ordered, original = in_global_order(keys, heavy)
                    p = prefix_length(len(keys), percent)
                    head = original[:p]
                    kept = (head >= np.uint64(1 << 62)) | _bit(shared, head)
                    if kept.any():
                        prefix = ordered[:p][kept].view(np.int64)
                        path = ordered.astype(">u8").tobytes()
                sizes.append(len(keys))
                sigs.append(sig)
                prefixes.append(prefix)
                paths.append(path)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            arrays = [ids, pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _INDEXED)


def overlaps(probe: np.ndarray, paths: Iterator[tuple[bytes, np.ndarray]], percent: int) -> Iterator[tuple[bytes, int]]:
    """``id, overlap`` of the sets that link with the probe; sets come in global order, as a trie's leaves.

    ``seen[d]`` is the overlap of the current path's first ``d`` shingles.
    """
    before = np.zeros(0, dtype=np.uint64)
    seen = np.zeros(1, dtype=np.int64)
    #: The depth from which the current path is too poor for sets of at least the given size.
    dead, dead_size = -1, 0
    for name, path in paths:
        n = len(path)
        m = min(n, len(before))
        differ = np.flatnonzero(path[:m] != before[:m])
        shared = int(differ[0]) if len(differ) else m
        need = least_overlap(len(probe), n, percent)
        if 0 <= dead <= shared and n >= dead_size:
            continue
        at = np.searchsorted(probe, path[shared:])
        hit = np.zeros(n - shared, dtype=np.int64)
        inside = at < len(probe)
        hit[inside] = probe[at[inside]] == path[shared:][inside]
        seen = np.concatenate([seen[: shared + 1], seen[shared] + np.cumsum(hit)])
        before = path
        dead = -1
        if seen[n] >= need:
            yield name, int(seen[n])
            continue
        # At depth d the overlap can still grow by what is left of the path and of the probe.
        left = np.minimum(n - np.arange(shared + 1, n + 1), len(probe) - np.searchsorted(probe, path[shared:], side="right"))
        poor = np.flatnonzero(seen[shared + 1 :] + left < need)
        if len(poor):
            d = int(poor[0]) + shared + 1
            # Below depth d any set can gain at most what the probe has left there, if that is too little for its size.
            if seen[d] + (len(probe) - np.searchsorted(probe, path[d - 1], side="right")) < need:
                dead, dead_size = d, n


class Trie:
    """Sets in global order as a trie, level by level. Rows are sorted, so a node's sets are neighbours."""

    def __init__(self, names: list[bytes], paths: list[np.ndarray]):
        self.names = names
        self.sizes = np.array([len(p) for p in paths])
        depth = int(self.sizes.max())
        padded = np.zeros((len(paths), depth), dtype=np.uint64)
        for i, path in enumerate(paths):
            padded[i, : len(path)] = path
        self.shingles, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        # A row starts new nodes from the first level at which it differs from the row before.
        new = np.ones(padded.shape, dtype=bool)
        new[1:] = np.logical_or.accumulate(padded[1:] != padded[:-1], axis=1)
        self.levels = []
        above = np.zeros(len(paths), dtype=np.int64)
        for d in range(depth):
            rows = np.flatnonzero(new[:, d] & (self.sizes > d))
            if not len(rows):
                break
            node = np.searchsorted(rows, np.arange(len(paths)), side="right") - 1
            ends = np.flatnonzero(self.sizes == d + 1)
            low, high = np.minimum.reduceat(self.sizes, rows), np.maximum.reduceat(self.sizes, rows)
            self.levels.append((ids[rows, d], above[rows], low, high, node[ends], ends))
            above = node

    def linked_with(self, probe: np.ndarray, percent: int) -> list[bytes]:
        """The sets that link with the probe."""
        return [name for name, _ in self.overlaps_with(probe, percent)]

    def overlaps_with(self, probe: np.ndarray, percent: int) -> list[tuple[bytes, int]]:
        """``id, overlap`` of the sets that link with the probe. All sets below a node share its overlap;
        a node whose remaining length cannot reach the threshold prunes them all."""
        known = np.zeros(len(self.shingles), dtype=bool)
        at = np.searchsorted(self.shingles, probe)
        at[at == len(self.shingles)] = 0
        known[at[self.shingles[at] == probe]] = True
        out: list[tuple[bytes, int]] = []
        overlap, alive = np.zeros(1, dtype=np.int64), np.ones(1, dtype=bool)
        for d, (shingle, above, low, high, ends_at, ends) in enumerate(self.levels):
            overlap = overlap[above] + known[shingle]
            # The smallest set below needs least; the largest has most to come.
            need = -(-percent * (len(probe) + np.maximum(low, d + 1)) // (100 + percent))
            alive = alive[above] & (overlap + np.minimum(high - d - 1, len(probe) - overlap) >= need)
            if not alive.any():
                break
            for node, row in zip(ends_at.tolist(), ends.tolist()):
                if overlap[node] >= least_overlap(len(probe), d + 1, percent):
                    out.append((self.names[row], int(overlap[node])))
        return out


def spanning(links: Iterator[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Those links that join sets not yet joined: as good for components, and fewer than the sets."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    kept = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def task_links(probes: list, members: list, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """``a, b, overlap``: the links of a task's probes with its members. A link of two sets that
    are both on both sides comes twice."""
    if len(probes) > 1 and members:
        trie = Trie([sig for sig, _ in members], [path for _, path in members])
        for a, probe in probes:
            yield from ((a, b, n) for b, n in trie.overlaps_with(probe, percent) if a != b)
    else:
        for a, probe in probes:
            yield from ((a, b, n) for b, n in overlaps(probe, iter(members), percent) if a != b)


def _tried(tasks: DataFrame, sets: DataFrame, output, schema: str) -> DataFrame:
    """What ``output(probes, members)`` gives for each task of ``task, member, sig``: rows of ``schema``."""
    paths = tasks.join(sets.select("sig", "path"), "sig").select("task", "member", "sig", "path")
    # A task's probes come first, then its members in global order.
    dealt = paths.repartition("task").sortWithinPartitions("task", "member", "path", "sig")
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.binary() if field.endswith("binary") else pa.int64() for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for whole in batches for part in batch_parts(whole))
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))
        for _, group in groupby(rows, key=lambda row: row[0]):
            sides: tuple[list, list] = ([], [])
            for _, member, sig, path in group:
                sides[member].append((sig, np.frombuffer(path, dtype=">u8").astype(np.uint64)))
            found = iter(output(*sides))
            while part := list(islice(found, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    return dealt.mapInArrow(run, schema)


def linked(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between the probes and the members of each task, given as ``task, member, sig``.

    Of a task's links a spanning forest is returned, so a task of like sets gives a row for each
    set, not for each pair.
    """

    def output(probes: list, members: list) -> list[tuple[bytes, bytes]]:
        return spanning((a, b) for a, b, _ in task_links(probes, members, percent))

    return _tried(tasks, sets, output, "a binary, b binary")


def links_once(probes: list, members: list, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """``a, b, overlap`` with ``a < b``: every link of a task, once."""
    names = {sig for sig, _ in probes}
    for a, b, n in task_links(probes, members, percent):
        if a < b or b not in names:
            yield min(a, b), max(a, b), n


def every_link(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, overlap``: every link of each task, one row for each pair."""
    return _tried(tasks, sets, lambda probes, members: links_once(probes, members, percent), "a binary, b binary, overlap bigint")


def link_sums(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``sig, n``: the number of links of each set in each task; no row for each pair."""

    def output(probes: list, members: list) -> list[tuple[bytes, int]]:
        counts: Counter = Counter()
        for a, b, _ in links_once(probes, members, percent):
            counts[a] += 1
            counts[b] += 1
        return list(counts.items())

    return _tried(tasks, sets, output, "sig binary, n bigint")


def _task(*columns: str):
    """One key of several columns."""
    return F.to_binary(F.md5(F.concat_ws(",", *[F.hex(F.col(c).cast("binary")) if c in ("a",) else F.col(c).cast("string") for c in columns])), F.lit("hex"))


def pair_tasks(pairs: DataFrame) -> DataFrame:
    """``task, member, sig`` that try each ``a`` against its ``b``, at most about ``GROUP`` at a time."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    members = dealt.select(_task("a", "part").alias("task"), F.lit(1).alias("member"), F.col("b").alias("sig"))
    probes = dealt.select(_task("a", "part").alias("task"), F.lit(0).alias("member"), F.col("a").alias("sig")).distinct()
    return probes.unionByName(members)


def met_blocks(entries: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """``sig, block`` and ``x, y, task``: the block of each set of large groups, and the blocks that meet, ``x <= y``.

    ``entries``: ``shingle, sig, size``. A set belongs to the largest group it is in, and there
    to one of its blocks; two blocks meet if any group holds sets of both.
    """
    own = entries.groupBy("sig").agg(F.max(F.struct("size", "shingle"))["shingle"].alias("home"))
    homes = own.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.struct("home", F.pmod(F.xxhash64("sig"), F.col("parts")).alias("part"))
    placed = written(own.join(homes, "home").select("sig", block.alias("block")), f"{root}/blocks")
    present = written(entries.join(placed, "sig").select("shingle", "block").distinct(), f"{root}/present")
    met = (
        present.select("shingle", F.col("block").alias("x"))
        .join(present.select("shingle", F.col("block").alias("y")), "shingle")
        .filter("x <= y").select("x", "y").distinct()
    )
    met = met.select("x", "y", F.xxhash64("x.home", "x.part", "y.home", "y.part").alias("task"))
    return placed, written(met, f"{root}/met")


def block_tasks(placed: DataFrame, met: DataFrame) -> DataFrame:
    """``task, member, sig`` that try all sets of large groups against each other, each pair of blocks once."""
    side = lambda name, member: met.select("task", F.col(name).alias("block")).join(placed, "block").select(
        F.to_binary(F.hex("task"), F.lit("hex")).alias("task"), F.lit(member).alias("member"), "sig"
    )
    return side("x", 0).unionByName(side("y", 1))


def components(links: DataFrame, root: str) -> DataFrame:
    """``sig, label``: the smallest signature that each linked set reaches."""
    both = links.select(F.col("a").alias("sig"), F.col("b").alias("to")).union(links.select("b", "a")).distinct()
    edges = written(both, f"{root}/edges")
    labels = written(
        edges.groupBy("sig").agg(F.min("to").alias("to")).select("sig", F.least("sig", "to").alias("label")), f"{root}/labels-0"
    )
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("sig").alias("to"), "label"), "to").groupBy("sig").agg(F.min("label").alias("near"))
        lower = labels.join(near, "sig").select("sig", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        lower = written(lower, f"{root}/lower-{step}")
        # Each label jumps to its own label.
        jump = lower.select(F.col("sig").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(jump, "label", "left").select(
            "sig", F.least("label", F.coalesce("further", "label")).alias("label"), "old"
        )
        labels = written(jumped, f"{root}/labels-{step}")
        if labels.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("sig", "label")


def _sizes_fit(x: str, y: str, percent: int):
    return 100 * F.least(F.col(x), F.col(y)) >= percent * F.greatest(F.col(x), F.col(y))


def possible_pairs(met: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of ``shingle, x, x_n, y, y_n`` that share enough prefix shingles to link."""
    a, b = F.least("x", "y"), F.greatest("x", "y")
    common = met.groupBy(a.alias("a"), b.alias("b")).agg(
        F.count_distinct("shingle").alias("common"), F.max("x_n").alias("x_n"), F.max("y_n").alias("y_n")
    )
    # Beyond the shorter prefix at most the rest of that set can match.
    rest = lambda n: F.floor(F.lit(percent) * F.col(n) / 100 + F.lit(0.999)) - 1  # noqa: E731  n - prefix_length(n)
    need = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / (100 + percent) - F.lit(1e-6))
    return common.filter(F.col("common") + F.greatest(rest("x_n"), rest("y_n")) + 1 >= need).select("a", "b")


def set_components(sets: DataFrame, percent: int, root: str) -> DataFrame:
    """``sig, label`` of all sets that link with a different one; ``sets``: ``sig, n, prefix, path``."""
    entries = written(sets.select("sig", "n", F.explode("prefix").alias("shingle")), f"{root}/entries")
    groups = written(
        entries.groupBy("shingle").agg(F.count("*").alias("size"), F.min(F.struct("sig", "n")).alias("first")).filter("size > 1")
        .select("shingle", F.col("first.sig").alias("a"), F.col("first.n").alias("a_n")),
        f"{root}/groups",
    )
    tried = (
        entries.join(groups, "shingle")
        .filter((F.col("sig") != F.col("a")) & _sizes_fit("n", "a_n", percent))
        .select("a", F.col("sig").alias("b")).distinct()
    )
    tried = written(tried, f"{root}/first-pairs")
    first_links = written(linked(pair_tasks(tried), sets, percent), f"{root}/first-links")
    first = components(first_links, f"{root}/first")
    # What is still apart: per prefix shingle, everything outside its largest component against the rest.
    marked = entries.join(first, "sig", "left").select("shingle", "sig", "n", F.coalesce("label", "sig").alias("label"))
    marked = written(marked, f"{root}/marked")
    counted = marked.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    largest = counted.groupBy("shingle").agg(
        F.count("*").alias("labels"), F.sum("size").alias("size"), F.max(F.struct("size", "label")).alias("top")
    )
    mixed_groups = largest.filter("labels > 1").select("shingle", "size", F.col("top.label").alias("top"))
    apart = written(marked.join(written(mixed_groups, f"{root}/mixed"), "shingle"), f"{root}/apart")
    large = apart.filter(F.col("size") > LARGE).select("shingle", "sig", "size")
    large_links = written(linked(block_tasks(*met_blocks(large, root)), sets, percent), f"{root}/large-links")
    apart = apart.filter(F.col("size") <= LARGE)
    few = apart.filter("label <> top").select(
        "shingle", F.col("sig").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label")
    )
    other = apart.select(
        "shingle", F.col("sig").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"), (F.col("label") == F.col("top")).alias("y_top")
    )
    met = few.join(other, "shingle").filter(
        (F.col("x_label") != F.col("y_label")) & (F.col("y_top") | (F.col("x") < F.col("y"))) & _sizes_fit("x_n", "y_n", percent)
    )
    pairs = possible_pairs(met, percent)
    small_links = linked(pair_tasks(written(pairs, f"{root}/more-pairs")), sets, percent)
    links = written(first_links.union(large_links).union(small_links), f"{root}/links")
    return components(links, f"{root}/all")


def link_tasks(sets: DataFrame, percent: int, root: str) -> list[DataFrame]:
    """Tasks that try every pair of different sets that can link, each pair in one task only."""
    entries = written(sets.select("sig", "n", F.explode("prefix").alias("shingle")), f"{root}/entries")
    sizes = entries.groupBy("shingle").agg(F.count("*").alias("size")).filter("size > 1")
    entries = written(entries.join(sizes, "shingle"), f"{root}/sized")
    placed, blocks = met_blocks(entries.filter(F.col("size") > LARGE).select("shingle", "sig", "size"), root)
    few = entries.filter(F.col("size") <= LARGE)
    met = (
        few.select("shingle", F.col("sig").alias("x"), F.col("n").alias("x_n"))
        .join(few.select("shingle", F.col("sig").alias("y"), F.col("n").alias("y_n")), "shingle")
        .filter((F.col("x") < F.col("y")) & _sizes_fit("x_n", "y_n", percent))
    )
    pairs = possible_pairs(met, percent)
    # Pairs of blocks that meet are tried there.
    for side in ("a", "b"):
        pairs = pairs.join(placed.select(F.col("sig").alias(side), F.col("block").alias(f"{side}_block")), side, "left")
    swapped = F.col("a_block") > F.col("b_block")
    x, y = F.when(swapped, F.col("b_block")).otherwise(F.col("a_block")), F.when(swapped, F.col("a_block")).otherwise(F.col("b_block"))
    pairs = pairs.select("a", "b", x.alias("x"), y.alias("y")).join(blocks.select("x", "y"), ["x", "y"], "left_anti").select("a", "b")
    return [block_tasks(placed, blocks), pair_tasks(written(pairs, f"{root}/pairs"))]


def sized(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: size and signature of its set, and its low shingles if it may link with different ones."""
    least = smallest_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(width), _Recent()
        for batch in (part for whole in batches for part in batch_parts(whole)):
            sets = shingler.sets(_texts(batch))
            sigs = [signature(keys) if len(keys) else None for keys in sets]
            low = [
                keys[: np.searchsorted(keys, np.uint64(1 << 62))].view(np.int64) if len(keys) >= least and recent.new(sig) else None
                for keys, sig in zip(sets, sigs)
            ]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            arrays = [ids, pa.array(map(len, sets), pa.int32()), pa.array(sigs, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "sig", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, sig binary, low array<bigint>")


def _low_entries(sets: DataFrame, shared: np.ndarray) -> DataFrame:
    """``id, shingle``: the low shingles of ``id, low`` that the bit table holds."""
    table = sets.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batch_parts(whole)):
            low = batch.column(1)
            keys = low.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(low.offsets.to_numpy()))
            kept = _bit(table.value, keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(keys[kept])], names=["id", "shingle"])

    return sets.select("id", "low").mapInArrow(run, "id bigint, shingle bigint")


#: The number that stands for a signature in a bit table: its first seven bytes.
_SIG_BYTES = 7


def _chosen(docs: DataFrame, width: int, percent: int, names: np.ndarray) -> DataFrame:
    """``sig, keys``: the sets whose signature the bit table holds, copies included."""
    table, least = docs.sparkSession.sparkContext.broadcast(names), smallest_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(width), _Recent()
        for batch in (part for whole in batches for part in batch_parts(whole)):
            found = [(signature(keys), keys) for keys in shingler.sets(_texts(batch)) if len(keys) >= least]
            slots = np.array([int.from_bytes(sig[:_SIG_BYTES], "big") for sig, _ in found], dtype=np.uint64)
            held = _bit(table.value, slots).tolist()
            found = [x for x, there in zip(found, held) if there and recent.new(x[0])]
            arrays = [pa.array([sig for sig, _ in found], pa.binary()), pa.array([k.tobytes() for _, k in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["sig", "keys"])

    return docs.select("text").mapInArrow(run, "sig binary, keys binary")


def _ordered(chosen: DataFrame, percent: int, heavy: np.ndarray) -> DataFrame:
    """``sig, n, prefix, path`` of ``sig, keys, shared``: as ``indexed`` gives them."""
    table = chosen.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batch_parts(whole)):
            sigs, sizes, prefixes, paths = [], [], [], []
            for sig, raw, shared in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = np.frombuffer(raw, dtype=np.uint64)
                ordered, original = in_global_order(keys, table.value)
                p = prefix_length(len(keys), percent)
                head = original[:p]
                kept = (head >= np.uint64(1 << 62)) | np.isin(head, np.array(shared, dtype=np.int64).view(np.uint64))
                if kept.any():
                    sigs.append(sig)
                    sizes.append(len(keys))
                    prefixes.append(ordered[:p][kept].view(np.int64))
                    paths.append(ordered.astype(">u8").tobytes())
            arrays = [pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["sig", "n", "prefix", "path"])

    return chosen.select("sig", "keys", "shared").mapInArrow(run, "sig binary, n int, prefix array<bigint>, path binary")


def dense_sets(
    docs: DataFrame, width: int, percent: int, tables: tuple[np.ndarray, np.ndarray], root: str
) -> tuple[DataFrame, DataFrame]:
    """What ``indexed_sets`` gives, for corpora that fill the bit tables.

    Equal sets become one before their low shingles are counted, so copies of a text make none of
    them shared. The shared ones of each set come from joins by shingle; a bit table that is not
    full leaves out some of the rest before. Only the sets that can link are made from their
    texts again: a bit table of their signatures keeps most others out of that shuffle.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs, width, percent), f"{root}/sized")
    rows = written(sizes.select("doc_id", "n", "sig"), f"{root}/rows")
    once = sizes.filter("low IS NOT NULL").select("sig", "n", "low").dropDuplicates(["sig"])
    # Written with its ids, which are the same for every reader from then on.
    once = written(once.withColumn("id", F.monotonically_increasing_id()), f"{root}/once")
    discarded(spark, f"{root}/sized")
    low = written(
        _low_entries(once, tables[0]).groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 2").select("shingle"),
        f"{root}/low",
    )
    shared = _low_entries(once, tables[0]).join(low, "shingle").groupBy("id").agg(F.collect_list("shingle").alias("shared"))
    named = once.select("id", "sig", "n", F.size("low").alias("low")).join(shared, "id", "left")
    # As in ``indexed``: low shingles found nowhere else are outside every intersection.
    others = F.col("low") - F.when(F.col("shared").isNull(), 0).otherwise(F.size("shared"))
    able = named.filter(others <= F.expr(f"n - ({percent} * CAST(n AS BIGINT) + 99) DIV 100"))
    able = written(able.select("sig", F.coalesce("shared", F.array().cast("array<bigint>")).alias("shared")), f"{root}/able")
    discarded(spark, f"{root}/once")
    number = F.conv(F.hex(F.substring("sig", 1, _SIG_BYTES)), 16, 10).cast("bigint")
    (names,) = _bits(able.select(number.alias("number")), "number", {"able": F.lit(True)})
    chosen = _chosen(docs, width, percent, names).dropDuplicates(["sig"]).join(able, "sig")
    sets = written(_ordered(chosen, percent, tables[1]), f"{root}/sets")
    for name in ("low", "able"):
        discarded(spark, f"{root}/{name}")
    return rows, sets


def indexed_sets(docs: DataFrame, width: int, percent: int, root: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, sig`` of all documents, and ``sig, n, prefix, path`` of the different sets that can link."""
    tables = bit_tables(docs, width, percent)
    if np.bitwise_count(tables[0]).sum() > DENSE * TABLE_BITS:
        return dense_sets(docs, width, percent, tables, root)
    rows = written(indexed(docs, width, percent, tables), f"{root}/indexed")
    sets = rows.filter("path IS NOT NULL").select("sig", "n", "prefix", "path").dropDuplicates(["sig"])
    return rows, written(sets, f"{root}/sets")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    root = work_dir(docs.sparkSession, "jaccard-join")
    rows, sets = indexed_sets(docs, width, percent, root)
    labels = set_components(sets, percent, root)
    members = rows.select("doc_id", "n", "sig").join(labels, "sig", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("label", "sig").alias("label")
    )
    members = written(members, f"{root}/members")
    smallest = written(
        members.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component")), f"{root}/components"
    )
    return members.join(smallest, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``a, b, overlap`` and ``doc_id, n_shingles, class``: every link between different sets, ``a < b``,
    each once, and the class of each document.

    A class is named by the signature of its set, so copies are not written out; it is null
    for documents without words.
    """
    root = work_dir(docs.sparkSession, "jaccard-links")
    rows, sets = indexed_sets(docs, width, percent, root)
    blocks, pairs = (every_link(tasks, sets, percent) for tasks in link_tasks(sets, percent, root))
    members = rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("sig").alias("class"))
    return written(blocks.unionByName(pairs), f"{root}/links"), members


def jaccard_link_counts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class, n_links`` per document: its class, in hexadecimal, and the number of
    other classes that link with it. Links are summed in their tasks."""
    root = work_dir(docs.sparkSession, "jaccard-link-counts")
    rows, sets = indexed_sets(docs, width, percent, root)
    blocks, pairs = (link_sums(tasks, sets, percent) for tasks in link_tasks(sets, percent, root))
    sums = written(blocks.unionByName(pairs).groupBy("sig").agg(F.sum("n").alias("n_links")), f"{root}/sums")
    return rows.join(sums, "sig", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.lower(F.hex("sig")).alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The documents, every column, one of each component: that of the smallest doc_id.

    Rows with a null doc_id, and documents without words, stay. Of rows with equal doc_id
    one stays.
    """
    found = jaccard_components(docs, width, percent)
    root = work_dir(docs.sparkSession, "jaccard-keep")
    state = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), F.min("component_id").alias("component")
    )
    odd = state.filter((F.col("component") != F.col("doc_id")) | (F.col("n_rows") > 1))
    odd = written(odd.select(F.col("doc_id").alias("odd_id"), (F.col("component") == F.col("doc_id")).alias("stays")), f"{root}/odd")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    plain = rows.join(odd, F.col("doc.doc_id") == F.col("odd_id"), "left_anti")
    # Repeated ids: one row each.
    again = rows.join(odd.filter("stays"), F.col("doc.doc_id") == F.col("odd_id"), "left_semi")
    again = again.groupBy(F.col("doc.doc_id").alias("same_id")).agg(F.first("doc").alias("doc")).select("doc")
    return plain.unionByName(again).select("doc.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_link_counts(table(spark, sf_dir, "documents"))


#: The rows of op9_jaccard_join in DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM word
), shingle AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS a_n, any_value(b.n) AS b_n, count(*) AS common
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edge AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM shingled s JOIN reach r USING (doc_id) GROUP BY ALL
"""
