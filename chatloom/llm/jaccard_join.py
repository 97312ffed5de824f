"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact intersections.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their distinct 5-word shingles. Nodes are
distinct shingle sets, so exact copies meet in one node before anything is compared.

1. Every set lists its shingles in one global order, by hash, with shingles that are frequent in a
   1/16 sample of the documents moved to the end. The order only steers cost: with any order, two
   sets that link share one of the first n - ceil(0.75 n) + 1 shingles of each.
2. A tile holds the sets that share such a shingle, sorted by size, hence in size bands. Tiles of up
   to SMALL_TILE sets give every pair whose sizes allow a link. Larger tiles give each set's pair with
   its band's first set, and one in NEIGHBOUR_TILES of them the pair with the set before it.
3. A pair is compared by bitmaps first: each bit of one that the other lacks is a shingle the other
   lacks, which bounds the overlap from above. Survivors are intersected as sorted arrays.
4. Components are contracted: every set that shares a large tile with another component goes to
   one such tile, is compared by bitmaps with a block of the sets that went there, and offers its
   NEAREST best partners of other components. So a group of thousands of near copies grows together at
   a few pairs a set.
5. What then still lies in different components of a tile is compared in whole, in blocks, bitmaps
   first: a tile's largest component with its other sets, and these with each other. Tiles with the
   same largest component that hold much the same sets are one group, in which a set stands once with
   its list of tiles. Pairs inside a component need no test, so no link between components is lost.

Null or blank texts have an empty set and link with nothing. Nothing is capped, sampled or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import mix, shingle_sets, text_slices
from .workspace import Workspace

PERCENT = 75
WIDTH = 5
SMALL_TILE = 12
#: Sets of a block and bytes of its bitmaps; two blocks meet in a task.
BLOCK = 500
BLOCK_BYTES = 16 << 20
#: Rounds of contraction before the rest is compared, and partners that a set offers in one.
CONTRACTIONS = 1
NEAREST = 2
#: Tiles are one group where that takes at most so many times the comparisons of tile by tile.
GROUPED = 4
#: Tasks that the sets around one component meet its decision in.
SALTS = 64
#: Keys of sets (shingle, set) that a task sorts into tiles.
KEYS_PER_TASK = 4_000_000
NEIGHBOUR_TILES = np.uint64(4)
#: One document in so many is counted to find frequent shingles, and a shingle in so many of those counts as frequent.
ORDER_SAMPLE, ORDER_COUNT = 16, 12
#: Most shingles that are moved to the end of the order: a bound for what is broadcast, not for what is compared.
ORDER_LIMIT = 500_000
#: Rows of two numbers that are broadcast at most; more are a shuffled join.
BROADCAST_ROWS = 300_000


def links(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


def sizes_allow(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def fingerprint(one: np.ndarray) -> int:
    """64 bits of a sorted set, as a signed number."""
    a = mix(one + np.arange(1, len(one) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([a.sum(dtype=np.uint64) + np.uint64(len(one))]))[0].astype(np.int64))


def bitmap(one: np.ndarray) -> np.ndarray:
    """2n to 4n bits, at least 256, packed; a shingle's bit is the low bits of its mixed hash, so halves fold onto each other."""
    bits = max(256, 1 << int(2 * len(one) - 1).bit_length())
    out = np.zeros(bits // 64, np.uint64)
    at = mix(one ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _base_rows(frequent: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                n, fps, keys, bits = [], [], [], []
                for one in shingle_sets(buffer, begins, WIDTH):
                    n.append(len(one))
                    fp = fingerprint(one) if len(one) else None
                    fps.append(fp)
                    if fp is None or fp in seen:
                        keys.append(None)
                        bits.append(None)
                        continue
                    if len(seen) < 1_000_000:  # memory; beyond it a set may be listed twice, which changes nothing
                        seen.add(fp)
                    p = prefix_length(len(one))
                    head = one[:p]
                    if len(frequent):
                        rare = one[frequent[np.minimum(np.searchsorted(frequent, one), len(frequent) - 1)] != one]
                        if len(rare) < len(one):
                            head = rare[:p] if len(rare) >= p else np.concatenate([rare, np.setdiff1d(one, rare, assume_unique=True)[: p - len(rare)]])
                    keys.append(head.astype(np.int64))
                    bits.append(bitmap(one).tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("mark"), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=schema)

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buffer, begins in text_slices(batch):
            values, counts = np.unique(np.concatenate(shingle_sets(buffer, begins, WIDTH)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "c"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many sampled documents hold; at most ORDER_LIMIT (4 MB)."""
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("order")), F.lit(ORDER_SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(_all_shingles, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= ORDER_COUNT)
    top = counted.orderBy(F.desc("c"), "h").limit(ORDER_LIMIT).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).astype(np.uint64))


_TILE = "kind byte, h long, a long, b long, n long"


def _tile_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, n, fp) rows in; kind 0: a pair to test; kind 1: a set of a large tile. Memory: a batch and SMALL_TILE rows."""
    carry: pd.DataFrame | None = None
    large: int | None = None  # the key whose run is known to be large and goes on
    leader: tuple[int, int] | None = None  # its band's first set, as (n, fp)

    def pack(kind, h, a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pd.DataFrame({"kind": np.full(len(h), kind, np.int8), "h": h, "a": a, "b": b, "n": n}), preserve_index=False)

    def settle(x: pd.DataFrame, more: bool):
        """Rows of whole runs, but that the last may go on (more)."""
        nonlocal large, leader
        h, n, fp = (x[c].to_numpy() for c in ("h", "n", "fp"))
        begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        lengths = np.diff(np.r_[begins, len(h)])
        big = lengths > SMALL_TILE
        if large is not None:
            big[0] = True  # the first run goes on from the rows before
        size = np.repeat(lengths, lengths)
        in_big = np.repeat(big, lengths)
        at = np.flatnonzero(~in_big & (size > 1))
        d = 1
        while len(at):
            at = at[at + d < len(h)]
            at = at[h[at] == h[at + d]]
            ok = at[sizes_allow(n[at], n[at + d]) & (fp[at] != fp[at + d])]
            if len(ok):
                yield 0, h[ok], fp[ok], fp[ok + d], n[ok]
            d += 1
        for k in np.flatnonzero(big):
            lo, hi = begins[k], begins[k] + lengths[k]
            if large is None or h[lo] != large:
                leader = None
            i = lo
            while i < hi:
                if leader is None or not sizes_allow(np.int64(leader[0]), n[i]):
                    leader = (int(n[i]), int(fp[i]))
                to = lo + int(np.searchsorted(n[lo:hi], 100 * leader[0] // PERCENT, "right"))
                own = np.arange(i, to)
                own = own[fp[own] != leader[1]]
                yield 0, h[own], np.full(len(own), leader[1], np.int64), fp[own], n[own]
                i = to
            if mix(h[lo : lo + 1].astype(np.uint64))[0] % NEIGHBOUR_TILES == 0:
                i = np.arange(lo + 1, hi)
                i = i[sizes_allow(n[i - 1], n[i]) & (fp[i - 1] != fp[i])]
                yield 0, h[i], fp[i - 1], fp[i], n[i]
            yield 1, h[lo:hi], fp[lo:hi], fp[lo:hi], n[lo:hi]
        large = int(h[-1]) if more and (big[-1]) else None

    def out(x: pd.DataFrame, more: bool = False):
        got = list(settle(x, more))
        for kind in (0, 1):
            if own := [g for g in got if g[0] == kind]:
                h, a, b, n = (np.concatenate([g[j] for g in own]) for j in (1, 2, 3, 4))
                if kind == 0:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    keep = ~pd.DataFrame({"a": a, "b": b}).duplicated().to_numpy()
                    h, a, b, n = h[keep], a[keep], b[keep], n[keep]
                yield pack(kind, h, a, b, n)

    for batch in frames:
        x = batch.to_pandas()
        if carry is not None:
            x = pd.concat([carry, x], ignore_index=True)
        x = x[~x.duplicated()].reset_index(drop=True)
        if not len(x):
            continue
        last = int(np.searchsorted(x["h"].to_numpy(), x["h"].iat[-1], "left"))
        if len(x) - last > 4 * SMALL_TILE:  # a large run that may go on: settle it now, keep its last row
            yield from out(x, more=True)
            carry = x.iloc[-1:]
        else:
            if last:
                yield from out(x.iloc[:last])
                large = None
            carry = x.iloc[last:]
    if carry is not None and (len(carry) > 1 or large is not None):
        yield from out(carry)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def bound(x: bytes, y: bytes, n: int, m: int) -> int:
    """The most shingles that sets of n and m with these bitmaps can share."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return int(min(n - np.bitwise_count(a & ~_wide(b, len(a))).sum(), m - np.bitwise_count(b & ~_wide(a, len(b))).sum()))


def _wide(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at another width; wider: every bit that the narrower one cannot tell from a set one counts as set."""
    return _fold(bits, words) if len(bits) >= words else np.tile(bits, words // len(bits))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        keep = []
        for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")), strict=True):
            most = bound(x, y, n, m)
            keep.append(100 * most >= PERCENT * (n + m - most))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([a, b]))
            keep.append(bool(links(np.count_nonzero(both[1:] == both[:-1]), len(a), len(b))))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buffer, begins in text_slices(batch):
            own = [x for x in shingle_sets(buffer, begins, WIDTH) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["fp", "shingles"])


def _tile_masks(tiles: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, one for each of the tiles that the sets stand in."""
    every, at = np.unique(np.concatenate(tiles), return_inverse=True)
    masks = np.zeros((len(tiles), -(-len(every) // 64)), np.uint64)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(tiles)), [len(t) for t in tiles]), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return masks


def block_pairs(n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[np.ndarray], across: bool, tiles: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, most shingles in common) of the pairs of different components that sizes and bitmaps allow, given sets in order of size.

    across: only pairs of different sides. tiles: only pairs that share one of these. A partner's bitmap is at most twice as wide, so each width is
    stacked with the next one folded onto it.
    """
    width = np.array([len(b) for b in bits])
    masks = _tile_masks(tiles) if tiles is not None else None
    out = [(np.zeros(0, np.int64),) * 3]
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        stack = np.stack([_fold(bits[i], w) for i in own])
        count = np.bitwise_count(stack).sum(1, dtype=np.int64)
        m, group, part = n[own], root[own], side[own]
        for k in range(int((width == w).sum())):
            j = np.arange(k + 1, int(np.searchsorted(m, 100 * m[k] // PERCENT, "right")))
            j = j[(group[j] != group[k]) & ((part[j] != part[k]) if across else True)]
            if masks is not None and len(j):
                j = j[(masks[own[k]] & masks[own[j]]).any(1)]
            if not len(j):
                continue
            shared = np.bitwise_count(stack[k] & stack[j]).sum(1, dtype=np.int64)
            most = np.minimum(m[k] - count[k] + shared, m[j] - count[j] + shared)
            ok = links(most, m[k], m[j])
            if ok.any():
                out.append((np.full(int(ok.sum()), own[k]), own[j[ok]], most[ok]))
    i, j, most = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j, most


def _block(x: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    x = x.sort_values(["n", "fp"], ignore_index=True)
    tiles = x["tiles"].tolist() if "tiles" in x and x["grouped"].iat[0] else None
    return x, *block_pairs(x["n"].to_numpy(), x["root"].to_numpy(), x["side"].to_numpy(), [np.frombuffer(b, np.uint64) for b in x["bits"]], bool(x["across"].iat[0]), tiles)


def _as_pairs(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(fp[i], fp[j]), "b": np.maximum(fp[i], fp[j])})


def _all_pairs(x: pd.DataFrame) -> pd.DataFrame:
    x, i, j, _ = _block(x)
    return _as_pairs(x["fp"].to_numpy(), i, j)


def _nearest_pairs(x: pd.DataFrame) -> pd.DataFrame:
    x, i, j, most = _block(x)
    n = x["n"].to_numpy()
    ratio = most / (n[i] + n[j] - most)
    ends = pd.DataFrame({"own": np.r_[i, j], "i": np.r_[i, i], "j": np.r_[j, j], "ratio": np.r_[ratio, ratio]})
    best = ends.sort_values(["own", "ratio", "i", "j"], ascending=[True, False, True, True]).groupby("own").head(NEAREST)
    return _as_pairs(x["fp"].to_numpy(), best["i"].to_numpy(), best["j"].to_numpy()).drop_duplicates()


_CELL = "a long, b long"


def _open_members(members: DataFrame, roots: DataFrame, work: Workspace, name: str) -> DataFrame:
    """h, fp, n, root of the sets of tiles that hold more than one component; of tiles with the same sets one stays."""
    placed = work.save(members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"{name}-placed")
    mark = F.xxhash64("fp")
    tiles = placed.groupBy("h").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y")).where("lo <> hi")
    return work.save(placed.join(tiles.groupBy("size", "x", "y").agg(F.min("h").alias("h")).select("h"), "h", "left_semi"), name)


def _merged(roots: DataFrame, found: DataFrame, work: Workspace, name: str) -> DataFrame:
    """roots (node, root) once the components that found (a, b) links are one."""
    up = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    joined = found.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = work.save(connected_components(joined, work, name), f"{name}-above")
    raised = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return work.save(raised.union(above.join(roots, "node", "left_anti").select("node", "root")), name)


def _blocks(rows: str, size: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(BLOCK)), F.ceil(F.col(size) / F.lit(BLOCK_BYTES))).cast("int")


def _dealt(cells: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by key to a number of tasks that is not cut down for few bytes: comparing takes much longer than reading."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _contraction(open_: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each set with its best partners in a block of one of its tiles."""
    chosen = open_.groupBy("fp", "n", "root").agg(F.min(F.struct(F.xxhash64("h", F.lit(turn)).alias("draw"), "h")).alias("one")).select("fp", "n", "root", F.col("one.h").alias("h"))
    held = chosen.join(nodes.select("fp", "bits"), "fp")
    sizes = chosen.groupBy("h").agg(F.count("*").alias("rows"), F.sum(F.col("n") / 2).alias("bytes")).select("h", _blocks("rows", "bytes").alias("blocks"))
    held = held.join(sizes, "h").withColumn("i", F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("blocks")).cast("int"))
    return held.select("h", "i", "fp", "n", "root", F.lit(0).alias("side"), F.lit(False).alias("across"), "bits").transform(_dealt, "h", "i").groupBy("h", "i").applyInPandas(_nearest_pairs, _CELL).distinct()


def _remainder(open_: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """Every pair (a, b) of a tile's sets in different components that sizes and bitmaps allow."""
    tiles = open_.groupBy("h", "root").agg(F.count("*").alias("rows")).groupBy("h").agg(F.max(F.struct("rows", "root")).alias("top"), F.sum("rows").alias("size"))
    placed = work.save(open_.join(tiles.select("h", F.col("top.root").alias("top"), "size"), "h"), "placed")
    cost = placed.groupBy("top").agg(F.sum("size").alias("cost"))  # each tile's size squared
    sets = placed.groupBy("top", "fp").agg(F.lit(1)).groupBy("top").agg(F.count("*").alias("sets"))
    grouped = cost.join(sets, "top").select("top", (F.col("sets") * F.col("sets") <= GROUPED * F.col("cost")).alias("grouped"))
    key = F.when(F.col("grouped"), F.col("top")).otherwise(F.col("h")).alias("g")
    salted = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one component may hold a third of all rows
    held = placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["top", "salt"])
    held = held.select("h", "fp", "n", "root", "grouped", key, (F.col("root") == F.col("top")).alias("is_top"))
    held = work.save(held.groupBy("g", "grouped", "fp", "n", "root", "is_top").agg(F.collect_list("h").alias("tiles")), "held")  # as many as a set has keys

    rows, size = (lambda x: F.count_if(x)), (lambda x: F.sum(F.when(x, F.col("n") / 2).otherwise(0)))
    groups = held.groupBy("g", "grouped").agg(rows(F.col("is_top")).alias("r0"), size(F.col("is_top")).alias("s0"), rows(~F.col("is_top")).alias("r1"), size(~F.col("is_top")).alias("s1"))
    groups = groups.select("*", (F.col("r0") + F.col("r1")).alias("r2"), (F.col("s0") + F.col("s1")).alias("s2"))
    groups = groups.select("g", "grouped", (_blocks("r2", "s2") == 1).alias("whole"), _blocks("r0", "s0").alias("tops"), _blocks("r1", "s1").alias("others"))
    held = held.join(groups, ["g", "grouped"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))  # noqa: E731  0: others with the largest component, 1: others with others, 2: a small group by itself
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    salt = F.col("salt")
    of_top = F.transform(upto("others"), lambda k: cell(0, k, salt))
    of_other = F.concat(F.transform(upto("tops"), lambda k: cell(0, salt, k)), F.transform(upto("others"), lambda k: cell(1, F.least(salt, k), F.greatest(salt, k))))
    cells = F.when(F.col("whole"), F.array(cell(2, F.lit(0), F.lit(0)))).when(F.col("is_top"), of_top).otherwise(of_other)
    held = held.select("g", "grouped", "fp", "n", "root", "tiles", F.when(F.col("is_top"), -1).otherwise(salt).alias("side"), F.explode(cells).alias("cell"))
    held = held.select("g", "grouped", "cell.*", "fp", "n", "root", "side", "tiles").join(nodes.select("fp", "bits"), "fp").withColumn("across", (F.col("kind") == 0) | (F.col("i") != F.col("j")))
    keys = ["g", "grouped", "kind", "i", "j"]
    return _dealt(held, *keys).groupBy(*keys).applyInPandas(_all_pairs, _CELL).distinct()


def jaccard_components(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, fp (id of the distinct set, null if empty), root (of the component), component_id of every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id that links reach; rows without a set get their own doc_id.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    frequent = frequent_shingles(docs)
    base = work.save(docs.mapInArrow(_base_rows(frequent), "doc_id long, mark long, n long, fp long, keys array<long>, bits binary"), "base")
    nodes = work.save(base.where("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits")).select("fp", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n", "bits"), "nodes")

    keys_held = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(keys_held) // KEYS_PER_TASK))
    keys = base.where("keys is not null").select(F.explode("keys").alias("h"), "n", "fp")
    tiles = work.save(keys.repartition(parts, "h").sortWithinPartitions("h", "n", "fp").mapInArrow(_tile_rows, _TILE), "tiles")

    first = _verified(docs, nodes, _bounded_pairs(nodes, tiles.where("kind = 0").select("a", "b").distinct()), work, "first")
    roots = work.save(connected_components(first, work, "components-0"), "roots-0")
    open_ = tiles.where("kind = 1").select("h", F.col("a").alias("fp"), "n")
    for turn in range(CONTRACTIONS + 1):
        open_ = _open_members(open_.select("h", "fp", "n"), roots, work, f"open-{turn}")
        if open_.isEmpty():
            break
        pairs = _contraction(open_, nodes, turn) if turn < CONTRACTIONS else _remainder(open_, nodes, work)
        roots = _merged(roots, _verified(docs, nodes, pairs, work, f"turn-{turn}"), work, f"roots-{turn + 1}")

    smallest = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "root", "rep")
    lowest = smallest.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = smallest.join(lowest, "root").select("fp", "root", "component_id")
    rows = base.select("doc_id", "mark", F.col("n").alias("n_shingles"), "fp").join(placed, "fp", "left")
    return rows.select("doc_id", "mark", "n_shingles", "fp", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The rows of docs, as they are, without all but one of each component: the smallest doc_id, then the smallest hash of the text.

    Rows without a set stay. A null doc_id counts as larger than any other; of repeated rows one stays.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "one-of-each")
    found = work.save(jaccard_components(docs, work), "components").where("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    shared = kept.where("size > 1").select("root", "best")
    others = found.select("root", "doc_id", "mark").join(shared, "root")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    gone = work.save(others.where(~is_best).select("doc_id", "mark").distinct(), "gone")
    repeated = work.save(others.where(is_best).groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"), "repeated")
    bound = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    mark = "mark"
    while mark in docs.columns:
        mark += "_"
    docs = docs.withColumn(mark, F.xxhash64("text"))
    same = lambda x: docs["doc_id"].eqNullSafe(x["doc_id"]) & (docs[mark] == x["mark"])
    left = docs.join(bound(gone), same(gone), "left_anti")
    if repeated.isEmpty():
        return left.drop(mark)
    again = left.join(bound(repeated), same(repeated), "left_semi").dropDuplicates(["doc_id", mark])
    return left.join(bound(repeated), same(repeated), "left_anti").unionByName(again).drop(mark)


def _bounded_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose sizes and bitmaps leave room for a link."""
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded, _CELL)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of sets that link, by exact intersections."""
    left = work.save(pairs, f"{name}-pairs")
    needed = left.select(F.col("a").alias("fp")).union(left.select(F.col("b").alias("fp"))).distinct()
    reps = nodes.join(needed, "fp", "left_semi").select("rep", F.col("mark").alias("rep_mark")).distinct()
    sets = docs.join(reps, (F.col("mark") == F.col("rep_mark")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(_sets, "fp long, shingles binary")
    sets = work.save(sets.join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles")), f"{name}-sets")
    one = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}"))
    out = work.save(left.join(one("a"), "a").join(one("b"), "b").mapInArrow(_exact, _CELL), f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-pairs")
    return out


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
