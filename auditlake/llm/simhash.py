"""SimHash near-duplicates: 64-bit fingerprints, linked at a small bit distance through BK-trees.

1. Fingerprints: one Arrow pass over the texts; distinct fingerprints are counted with a
   partial aggregate, so thousands of copies become one row before any search.
2. Shards: fingerprints at distance <= r agree on at least one of r + 1 bit blocks, so a
   shard is (block, value) and a linked pair meets in at least one. A shard above SHARD_MAX
   is split again by blocks of its remaining bits, level after level; after the last level
   at most 13 bits are free, so no shard can exceed 2**13 distinct fingerprints whatever the data.
3. Search: in each shard a BK-tree (children keyed by their Hamming distance to the parent);
   a lookup follows only edges within the radius. The trees are built where their shard
   lands instead of being broadcast: all trees together grow with the corpus. A shard reports
   a spanning forest of its links (union-find), never all pairs.
4. Components: star rounds over the links, in Spark.

Defined results: words are split at the six ASCII separators after lower-casing A-Z; a null,
empty or wordless text has fingerprint 0 and links like any other; rows that repeat a doc_id
each get a row; null doc_ids take part in links but are no component_id (null if a component
has no other); other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import connected_components, id_and_text, pieces, text_bytes, unpack, with_row_struct, written

SHINGLE = 3
RADIUS = 2
SEED = 42
SHARD_MAX = 1024
LEVELS = 5
_CHUNK = 65_536  # shingles hashed at a time: bounds the memory of a very long text


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingle hashes (XXH64, seed 42)."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _CHUNK):
        part = words[a:min(a + _CHUNK, n) + shingle - 1]
        if len(words) <= shingle:
            grams = [b" ".join(words)]
        elif shingle == 3:
            grams = [b"%b %b %b" % g for g in zip(part, part[1:], part[2:])]
        else:
            grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(shingle)))]
        h = np.array([digest(g, SEED) for g in grams], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    value = 0
    for bit in (ones * 2 > n).tolist():
        value = value << 1 | bit
    return value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, fp): fp is the fingerprint as a signed long, tie a hash of the text."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                fps = np.array([fingerprint(t, shingle) for t in text_bytes(piece)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tie"), pa.array(fps)],
                                                 names=["doc_id", "tie", "fp"])

    d = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


def _paths(radius: int) -> list[list[int]]:
    """Masks of the shard levels: level 0 has one mask per block, each further level splits
    the bits that a mask leaves free into radius + 1 blocks again."""
    levels: list[list[int]] = [[0]]
    for _ in range(LEVELS):
        nxt = []
        for mask in levels[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            for part in np.array_split(np.array(free), radius + 1):
                nxt.append(mask | sum(1 << int(b) for b in part))
        levels.append(nxt)
    return levels[1:]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def shards(fps: DataFrame, radius: int = RADIUS, shard_max: int = SHARD_MAX) -> DataFrame:
    """Distinct fingerprints ``fp`` to rows (path, value, fp): one shard per (path, value)."""
    def keyed(d, masks, first):
        at = F.array(*[F.lit(_signed(m)) for m in masks])
        return d.select(F.explode(first).alias("slot"), "fp") \
            .select("slot", F.expr("fp").bitwiseAND(F.get(at, F.col("slot"))).alias("value"), "fp")

    out, cur = None, None
    levels = _paths(radius)
    for depth, masks in enumerate(levels):
        children = F.array(*[F.lit(i) for i in range(radius + 1)]) if cur is None else F.transform(
            F.array(*[F.lit(i) for i in range(radius + 1)]), lambda i: F.col("slot") * (radius + 1) + i)
        rows = keyed(fps if cur is None else cur, masks, children)
        sizes = rows.groupBy("slot", "value").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes, ["slot", "value"]), "shards")
        last = depth == len(levels) - 1
        done = (rows if last else rows.where(F.col("n") <= shard_max)) \
            .select(F.lit(depth).alias("depth"), "slot", "value", "fp")
        out = done if out is None else out.unionByName(done)
        cur = rows.where(F.col("n") > shard_max)
        if last or not cur.limit(1).count():
            return out
    return out


class BKTree:
    """Integer keys; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, key: int) -> int:
        me = len(self.keys)
        self.keys.append(key)
        self.children.append({})
        at = 0
        while at != me:
            at = self.children[at].setdefault((self.keys[at] ^ key).bit_count(), me)
        return me

    def within(self, key: int, radius: int) -> list[int]:
        """Positions of all keys at distance <= radius."""
        hits, stack = [], [0] if self.keys else []
        keys, children = self.keys, self.children
        while stack:
            at = stack.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                hits.append(at)
            below = children[at]
            if below:
                for e in range(max(0, d - radius), d + radius + 1):
                    if e in below:
                        stack.append(below[e])
        return hits


def shard_links(keys: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one shard."""
    if len(keys) == 2:
        return [(keys[0], keys[1])] if (keys[0] ^ keys[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(), [], []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for key in keys:
        near = tree.within(key, radius)
        me = tree.insert(key)
        parent.append(me)
        for other in near:
            a, b = root(other), root(me)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((key, keys[other]))
    return out


def links(fps: DataFrame, radius: int = RADIUS, shard_max: int = SHARD_MAX) -> DataFrame:
    """Distinct fingerprints to spanning links (u, v)."""
    import pyarrow as pa

    sh = shards(fps, radius, shard_max)

    def run(batches):
        key, group = None, []

        def flush():
            found = shard_links([k & (1 << 64) - 1 for k in group], radius) if len(group) > 1 else []
            return [(_signed(a), _signed(b)) for a, b in found]

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("depth", "slot", "value", "fp")]
            out = []
            for depth, slot, value, fp in zip(*cols):
                if key != (depth, slot, value):
                    out += flush()
                    key, group = (depth, slot, value), []
                group.append(fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)],
                                                 names=["u", "v"])
        out = flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)],
                                         names=["u", "v"])

    placed = sh.repartition("depth", "slot", "value").sortWithinPartitions("depth", "slot", "value", "fp")
    return placed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    shard_max: int = SHARD_MAX) -> DataFrame:
    """(doc_id, tie, fp, root, component_id): root names the component by its smallest fingerprint."""
    fps = written(fingerprints(docs, shingle), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius, shard_max))
    # only linked fingerprints need their component's smallest id
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    low = linked.groupBy("root").agg(F.min("low").alias("component_low"))
    of = linked.join(low, "root").select("fp", "root", "component_low")
    names = nodes.join(of, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_low", "low").alias("component_id"))
    return fps.join(names, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, input columns unchanged. Of rows that
    repeat an id inside one component the first by text hash stays, of those alike in id and text the first by a
    hash of all columns, then by all columns; rows without an id stay
    only where no row of the component has one (one per component)."""
    named = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), "text"), shingle, radius)
    chosen = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .groupBy("doc_id", "root").agg(F.min("tie").alias("tie"), F.count("*").alias("n_rows"))
    d = with_row_struct(docs).select("row", F.col("row").getField(id_col).alias("_id"),
                                     F.xxhash64(F.col("row.text")).alias("_tie"))
    kept = d.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")))
    # ids are unique in a sound table; only repeated ids need a choice inside their group
    first = kept.where("n_rows > 1").select("row", F.row_number().over(
        Window.partitionBy("_id", "_tie").orderBy("root", F.xxhash64("row"), F.to_json("row"))).alias("rn")).where("rn = 1")
    return unpack(kept.where("n_rows = 1").select("row").unionByName(first.select("row")), docs.columns)
