"""SimHash near-duplicates: exact Hamming links by tiled XOR and bit counts, then components.

1. One pass per text gives its fingerprint: XXH64 of every word shingle, a bit set where
   over half of the hashes have it. Further lanes of 64 bits use a remix of the same hashes.
2. Equal fingerprints are folded to the smallest id (pre-aggregated before the shuffle).
3. Fingerprints of radius r or less over L lanes differ in r // L bits or fewer of some lane. A
   lane is cut into blocks; if b blocks are compared, b - r // L or more agree, every choice
   of so many blocks names a table, and linked fingerprints meet under an equal key of one.
   This splits the all-pairs comparison without losing a link.
4. Rows of a key form tiles. In a tile, fingerprints are ordered by population count; numpy
   XORs and counts bits of block against block and skips block pairs whose counts differ
   beyond the radius. Keys with many rows are dealt over several tiles, each pair of parts
   meeting in one. A tile returns a spanning forest of its links, never all pairs.
5. Components by alternating large-star and small-star rounds, each written to the shared folder.

one_of_each_group links by the similarity of shingle sets itself, in two tiled steps. Fingerprints
(of the different shingles, LANES lanes) give clusters: rows that agree in some bits of a lane in one
of several fixed choices (key_plan derives both numbers from the row count) and differ in CLOSE or fewer of the first FILTER_LANES lanes' bits are in one,
and a tile returns a spanning forest. Inside a cluster, parts of TILE_SETS rows meet in tiles that
hold their sets: all pairs within CLOSE_ALL bits of all lanes that are not linked yet are compared
exactly. Parts of a large cluster meet its smallest id first, and each other only where that leaves
rows outside the largest component. No list of pairs is made, and a link never depends on other rows.

Edge cases: null and blank texts have fingerprint zero and link like others; a text shorter
than a shingle is one shingle; a null id is never the smallest, and the component is null if no
other is reachable; texts that share an id are linked by their fingerprints alone; repeated
rows keep a row each; an empty table gives an empty one. A very long text is hashed in parts of
its shingles, with under 20 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log, log1p, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as tw
from .shared import NO_ID, map_texts, quoted, saved, solid_id

#: Shingles that one numpy pass hashes or counts at a time.
PART = 1 << 16
#: Rows of a key beyond which it is dealt over several tiles; side of a compared block.
TILE_ROWS, BLOCK = 8192, 512
#: Clusters of one_of_each_group: lanes of 64 bits, and the bits of the first FILTER_LANES lanes that may differ.
LANES, FILTER_LANES, CLOSE = 8, 2, 32
#: At the least similarity of those clusters so many bits agree. Keys have KEY_BITS bits up to KEY_ROWS
#: texts and one more for each doubling, so that the rows of a key do not grow with the corpus; there are
#: as many choices of bits as let MISSED pairs of that similarity share no key.
LEAST, AGREE, KEY_BITS, KEY_ROWS, MISSED = 0.8, 0.85, 14, 1 << 20, 0.001
#: Bits of all lanes that a compared pair may differ in (at 0.8: 78 of 512, 8 up or down), and rows of a part of a cluster.
CLOSE_ALL, TILE_SETS = 112, 256
#: Stand-in ids, of fingerprints with null or taken ids only, begin here; real ids are smaller.
NO_ID_FROM = 1 << 62


def shingle_hashes(column, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word shingle, texts one after another, and how many each text has."""
    w = tw.split(column, lower=True)
    n = np.minimum(w.counts, shingle)
    count = np.where(w.counts > 0, w.counts - n + 1, 0)
    ends = np.cumsum(count)
    out, digest = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64), xxhash.xxh64_intdigest
    for lo in range(0, len(out), PART):
        seat = np.arange(lo, min(lo + PART, len(out)))
        owner = np.searchsorted(ends, seat, side="right")
        head = w.first[owner] + seat - (ends - count)[owner]
        tail = head + n[owner] - 1
        base, top = int(head[0]), int(tail[-1]) + 1
        start, size = w.start[base:top], (w.end - w.start)[base:top]
        at = np.cumsum(size + 1) - size - 1  # of each word in these words joined by one space
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(at, size) + inside] = w.buf[np.repeat(start, size) + inside]
        data, a, b = joined.tobytes(), at[head - base].tolist(), (at + size)[tail - base].tolist()
        out[seat] = np.fromiter((digest(data[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    return out, count


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_hashes, for the different shingles of each text in ascending order."""
    h, count = shingle_hashes(column, shingle)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(count))


def fingerprints(column, shingle: int, lanes: int, seed: int = 42) -> list[np.ndarray]:
    """For each lane, the 64-bit fingerprint of each text."""
    return majorities(*shingle_hashes(column, shingle, seed), lanes)


def majorities(first: np.ndarray, count: np.ndarray, lanes: int) -> list[np.ndarray]:
    """For each lane, the bits that over half of each text's hashes have."""
    owner, out = np.repeat(np.arange(len(count)), count), []
    for lane in range(lanes):
        ones = np.zeros((len(count), 64), np.int64)
        for lo in range(0, len(first), PART):
            h, own = first[lo : lo + PART], owner[lo : lo + PART]
            h = tw.mix(h + np.uint64(lane)) if lane else np.ascontiguousarray(h)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edge = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(count)))
    return out


def with_fingerprints(docs: DataFrame, text: str, shingle: int, lanes: int, keep: list[str]) -> DataFrame:
    names = {f"fp{i}": "long" for i in range(lanes)}
    return map_texts(docs, text, lambda c: {f"fp{i}": f.view(np.int64) for i, f in enumerate(fingerprints(c, shingle, lanes))}, names, keep, most=1 << 20)


def tables(radius: int, rows: int) -> tuple[int, int]:
    """Blocks and how many must agree: the cheapest choice for so many fingerprints."""

    def cost(blocks: int, agree: int) -> float:
        key_bits = agree * 64 / blocks
        return comb(blocks, agree) * (rows * 3e-6 + rows * rows / 2 ** (key_bits + 1) * 3e-9)

    return min(((radius + k, k) for k in range(1, 5)), key=lambda x: cost(*x))


def _masks(blocks: int, agree: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(part[i] for i in c)) for c in combinations(range(blocks), agree)]


def _distance(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)


def _hit_pairs(fp: np.ndarray, own: np.ndarray, pop: np.ndarray, near: int, radius: int):
    """Index pairs of linked rows of one tile; own is the tile's lane, rows are ordered by its bit count."""
    n = len(fp)
    for a in range(0, n, BLOCK):
        x = own[a : a + BLOCK, None]
        for b in range(a, n, BLOCK):
            if pop[b] - pop[min(a + BLOCK, n) - 1] > near:
                break
            i, j = np.nonzero(np.bitwise_count(x ^ own[None, b : b + BLOCK]) <= near)
            if a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                i, j = i + a, j + b
                hit = _distance(fp, i, j) <= radius
                yield i[hit], j[hit]


def _forest(n: int, pairs) -> np.ndarray:
    """For each of n rows the smallest row of its component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _link_tiles(near: int, radius: int, lanes: int):
    def tile(ids: np.ndarray, fp: np.ndarray, own: np.ndarray):
        pop = np.bitwise_count(own).astype(np.int64)
        order = np.lexsort((ids, pop))
        ids, fp, own, pop = ids[order], fp[order], own[order], pop[order]
        root = _forest(len(ids), _hit_pairs(fp, own, pop, near, radius))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return ids[own], ids[root[own]]

    def small(key, ids, fp):
        """All tiles of up to 32 rows at once: compare each row with the s-th after it."""
        out, s = [], 1
        while s < len(key):
            same = np.flatnonzero(key[s:] == key[:-s])
            if not len(same):
                break
            hit = same[_distance(fp, same, same + s) <= radius]
            out.append((ids[hit], ids[hit + s]))
            s += 1
        return out

    def link(own: list[tuple[int, int]], key, t: pa.Table, few):
        ids, lane, fp = t.column("id").to_numpy(), t.column("lane").to_numpy(), _stacked(t, lanes)
        out = small(key[few], ids[few], fp[few])
        for a, b in own:
            out.append(tile(ids[a:b], fp[a:b], fp[a:b, int(lane[a])]))
        return out

    return _by_tiles(link)


def _close_tiles(close: int, lanes: int):
    """Edges that span the rows of a tile within close bits over the lanes, each to the smallest id reached; rows of one id are one node."""

    def find(own: list[tuple[int, int]], key, t: pa.Table, few):
        ids, node = np.unique(t.column("id").to_numpy(), return_inverse=True)
        fp = _stacked(t, lanes)

        def pairs():
            small, s = np.flatnonzero(few), 1
            while s < len(small):
                i, j = small[:-s], small[s:]
                same = key[i] == key[j]
                if not same.any():
                    break
                i, j = i[same], j[same]
                hit = _distance(fp, i, j) <= close
                yield node[i[hit]], node[j[hit]]
                s += 1
            for a, b in own:
                for i, j in _close_pairs(fp[a:b], close):
                    yield node[a + i], node[a + j]

        root = _forest(len(ids), pairs())
        at = np.flatnonzero(root != np.arange(len(ids)))
        return [(ids[at], ids[root[at]])]

    return _by_tiles(find)


def _close_pairs(fp: np.ndarray, close: int):
    """Index pairs within close bits: all of a block; of more rows pairs that connect what all would, a row once reached meets only rows not reached."""
    near = lambda i, j: sum(np.bitwise_count(fp[i, k, None] ^ fp[None, j, k]).astype(np.int16) for k in range(fp.shape[1])) <= close
    left = np.arange(len(fp))
    if len(fp) <= BLOCK:
        i, j = np.nonzero(near(left, left))
        yield i[i < j], j[i < j]
        return
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:BLOCK], front[BLOCK:]
            met = near(some, left)
            hit = met.any(axis=0)
            yield some[met.argmax(axis=0)[hit]], left[hit]
            front, left = np.concatenate([front, left[hit]]), left[~hit]


def _similar_tiles(close: int, lanes: int, least: float):
    """Edges that span the rows of a tile whose shingle sets have a similarity (shared of all) of least or more; rows of one id are one node."""

    def tile(ids: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """For each row, by ascending ids, the first row of its group."""
        size, label = np.array([len(x) for x in sets]), np.searchsorted(ids, ids)
        for i in range(1, len(sets)):
            near = np.bitwise_count(fp[:i] ^ fp[i]).sum(axis=1, dtype=np.int64) <= close
            near &= np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i])
            for j in np.flatnonzero(near).reshape(-1, 1) if near.sum() < 4 else np.array_split(np.flatnonzero(near), -(-near.sum() // 64)):
                j = j[label[j] != label[i]]
                if not len(j):
                    continue
                other = np.concatenate([sets[k] for k in j])
                at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
                both = np.add.reduceat((sets[i][at] == other).astype(np.int64), np.cumsum(size[j]) - size[j])
                for k in j[both >= least * (size[i] + size[j] - both) - 1e-9]:
                    low, high = sorted((label[i], label[k]))
                    label[label == high] = low
        return label

    def find(own, key, t: pa.Table, few):
        ids, fp = t.column("id").to_numpy(), _stacked(t, lanes)
        column = t.column("shingles").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, o = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        edge, out = [*np.flatnonzero(np.diff(key, prepend=key[0] - 1)).tolist(), len(key)], []
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                row = a + np.argsort(ids[a:b], kind="stable")
                label = tile(ids[row], fp[row], [values[o[k] : o[k + 1]] for k in row])
                at = np.flatnonzero(label != np.arange(b - a))
                out.append((ids[row[at]], ids[row[label[at]]]))
        return out

    return _by_tiles(find)


def _stacked(t: pa.Table, lanes: int) -> np.ndarray:
    return np.stack([t.column(f"fp{i}").to_numpy().view(np.uint64) for i in range(lanes)], axis=1)


def _by_tiles(find):
    """Rows sorted by tile -> pairs u > v; find gets the ends of tiles of over 32 rows, and which rows are in smaller ones."""

    def run(batches):
        rest = None
        for last, batch in _marked(batches):
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = t.column("tile").to_numpy()
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            upto = len(key) if last else int(other[-1]) + 1 if len(other) else 0
            rest = t.slice(upto).combine_chunks()
            key = key[:upto]
            if not len(key):
                continue
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [upto]])
            size = np.repeat(np.diff(edge), np.diff(edge))
            few = (size > 1) & (size <= 32)
            large = np.flatnonzero(np.diff(edge) > 32)
            out = find(list(zip(edge[large].tolist(), edge[large + 1].tolist(), strict=True)), key, t.slice(0, upto), few)
            u, v = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return run


def _marked(batches):
    """(is it the last, batch) for each batch."""
    held = None
    for batch in batches:
        if held is not None:
            yield False, held
        held = batch
    if held is not None:
        yield True, held


def links(prints: DataFrame, radius: int, near: int, lanes: int, rows: int) -> DataFrame:
    """Edges u > v that span every component of prints (id, fp0, ...) under the radius, found by lanes within near."""
    masks, fps = _masks(*tables(near, rows)), [f"fp{i}" for i in range(lanes)]
    keys = [F.struct(F.lit(k).alias("lane"), F.xxhash64(F.lit(k * len(masks) + i), F.col(f"fp{k}").bitwiseAND(F.lit(m))).alias("key")) for k in range(lanes) for i, m in enumerate(masks)]
    keyed = prints.select("*", F.explode(F.array(*keys)).alias("k")).select("id", *fps, "k.lane", "k.key")
    return _dealt(keyed, ["lane", *fps]).mapInArrow(_link_tiles(near, radius, lanes), "u long, v long")


def _dealt(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """(tile, id, columns) sorted by tile: rows of a key, or parts of `most` rows of it of which each two meet."""
    most = TILE_ROWS
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    crowded = saved(crowded, "crowded")  # a key of over `most` rows each: a small table, or a join that AQE can split
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiled = keyed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tiled = tiled.select("id", *columns, "key", "parts", part.alias("part"), other)
    tiled = tiled.withColumn("tile", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))))
    return tiled.select("tile", "id", *columns).repartition("tile").sortWithinPartitions("tile")


def _spanned(keyed: DataFrame, columns: list[str], most: int, find) -> DataFrame:
    """Edges u > v that span the links of rows (id, key, columns) of one key; find links the rows of a tile.

    Parts of a key of over `most` rows meet its smallest id only. That joins a group of near copies with work in
    proportion to its rows. What is not one component then is compared in full: rows outside the key's largest
    component with all of it and with each other, under their component's id, so that a tile gives edges between components only.
    """
    tiles = lambda rows, tile: find(rows.select(tile.alias("tile"), "id", *columns).repartition("tile").sortWithinPartitions("tile"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where(F.col("n") > most)
    crowded = saved(crowded.select("key", "hub", F.ceil(F.col("n") / most).cast("int").alias("parts")), "crowded")  # keys of over `most` rows: a small table, or a join that AQE can split
    if crowded.isEmpty():
        return tiles(keyed, F.col("key"))
    part = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    upto = lambda parts: F.sequence(F.lit(0), parts - 1)
    seats = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("id") == F.col("hub"), upto(F.col("parts"))).otherwise(F.array(part(F.col("parts"))))
    dealt = keyed.join(crowded, "key", "left").withColumn("seat", F.explode(seats))
    edges = saved(tiles(dealt, F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", "seat"))), "edges-to-hubs")
    joined = saved(components(edges), "joined")
    label = F.coalesce("component", "id").alias("label")
    sizes = keyed.join(crowded, "key", "left_semi").select("key", "id").join(joined, "id", "left").groupBy("key", label).agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).where(F.col("n") > F.col("main.n"))
    parts = lambda n: F.ceil(n / most).cast("int")
    sizes = saved(sizes.select("key", F.col("main.label").alias("main"), parts(F.col("main.n")).alias("mains"), parts(F.col("n") - F.col("main.n")).alias("rests")), "apart")
    rows = keyed.join(sizes, "key").join(joined, "id", "left").withColumn("label", label)
    own = part(F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    cross = lambda m, r: F.xxhash64("key", F.lit(0), m, r)
    inside = F.transform(upto(F.col("rests")), lambda r: F.xxhash64("key", F.lit(1), F.least(r, own), F.greatest(r, own)))
    seats = F.when(F.col("label") == F.col("main"), F.transform(upto(F.col("rests")), lambda r: cross(own, r)))
    seats = seats.otherwise(F.concat(F.transform(upto(F.col("mains")), lambda m: cross(m, own)), inside))
    rest = rows.withColumn("seat", F.explode(seats)).withColumn("id", F.col("label"))
    return joined.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(tiles(rest, F.col("seat")).where("u <> v"))


def key_plan(rows: int) -> tuple[int, int]:
    """Bits of a key and the number of choices for so many different texts."""
    bits = KEY_BITS + max(0, ceil(log2(max(1, rows) / KEY_ROWS)))
    return bits, ceil(log(MISSED) / log1p(-(AGREE**bits)))


def _bit_choices(bits: int, tables: int) -> list[tuple[int, int]]:
    """(lane, mask of so many bits) of each table, the same in every process."""
    rng = np.random.default_rng(42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(t % LANES, signed(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))) for t in range(tables)]


def clusters(prints: DataFrame) -> DataFrame:
    """(id, component) of prints (id, fp0, ...) that are close to others."""
    fps = [f"fp{i}" for i in range(FILTER_LANES)]
    keys = F.array(*(F.xxhash64(F.lit(t), F.col(f"fp{k}").bitwiseAND(F.lit(m))) for t, (k, m) in enumerate(_bit_choices(*key_plan(prints.count())))))
    keyed = prints.select("id", *fps, F.explode(keys).alias("key"))
    linked = components(_spanned(keyed, fps, TILE_ROWS, lambda rows: rows.mapInArrow(_close_tiles(CLOSE, FILTER_LANES), "u long, v long")))
    return saved(linked.unionByName(linked.select(F.col("component").alias("id"), "component").distinct()), "clusters")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (u > v): alternating large-star and small-star.

    A round joins each edge with the smallest neighbour of an end, so a hub's edges stay
    separate rows. Ends when the edges form stars, which the edge set's checksum shows.
    """
    edges = saved(edges.distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = saved(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def _grouped(docs: DataFrame, text: str, keep: list[str], shingle: int, radius: int, lanes: int) -> DataFrame:
    """keep (first of them _id), fingerprints, _group (a number of its own) and _least, the smallest id reachable."""
    fps = [f"fp{i}" for i in range(lanes)]
    marked = saved(with_fingerprints(docs, text, shingle, lanes, keep), "fingerprints")
    stand_in = F.shiftrightunsigned(F.xxhash64(*fps), 2) + F.lit(NO_ID_FROM)
    distinct = marked.groupBy(*fps).agg(F.min(F.col("_id").cast("long")).alias("low")).withColumn("id", F.coalesce("low", stand_in))
    first = F.row_number().over(Window.partitionBy("id").orderBy(*fps)) == 1  # texts of one id are nodes apart
    distinct = saved(distinct.select(*fps, "low", F.when(first, F.col("id")).otherwise(stand_in).alias("id")), "distinct")
    linked = components(links(distinct.select("id", *fps), radius, radius // lanes, lanes, max(1, distinct.count())))
    members = linked.unionByName(linked.select(F.col("component").alias("id"), "component").distinct())
    lows = members.join(distinct.select("id", "low"), "id").groupBy("component").agg(F.min("low").alias("least"))
    rep = distinct.join(linked, "id", "left").select(*fps, "low", F.coalesce("component", "id").alias("component"))
    rep = rep.join(lows, "component", "left").select(*fps, F.col("component").alias("_group"), F.coalesce("least", "low").alias("_least"))
    return marked.join(rep, fps, "left")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, lanes: int = 1) -> DataFrame:
    """id, fingerprint (hex, a lane after another) and component_id, the smallest id reachable by links."""
    found = _grouped(docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")), "_text", ["_id"], shingle, radius, lanes)
    hexed = F.concat(*(F.lower(F.lpad(F.hex(f"fp{i}"), 16, "0")) for i in range(lanes)))
    return found.select(F.col("_id").alias(id), hexed.alias("fingerprint"), F.col("_least").alias("component_id"))


def similar_groups(rows: DataFrame, shingle: int, least: float, exact: bool = False) -> DataFrame:
    """_id, _mark and _group of rows (_id, _text, _mark): links are pairs of shingle sets of a similarity of least or more.

    exact: pairs meet under one of the smallest hashes of their sets. Of a set of n, any that is so similar shares one of the
    n - ceil(least n) + 1 smallest, so no link is lost; each copy of a row carries its set.
    """
    fps = [f"fp{i}" for i in range(LANES)]

    def prints(column):
        h, count = shingle_sets(column, shingle)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tw.mix(h + np.uint64(LANES)))])  # sums wrap around
        ends = np.cumsum(count)
        node = total[ends] - total[ends - count]
        return {"id": node.view(np.int64)} | {f: p.view(np.int64) for f, p in zip(fps, majorities(h, count, LANES), strict=True)}

    marked = saved(map_texts(rows, "_text", prints, dict.fromkeys(["id", *fps], "long"), ["_id", "_mark"], most=1 << 20), "fingerprints")
    key = F.struct("_mark", solid_id("_id").alias("_key"))
    nodes = saved(marked.groupBy("id", *fps).agg(F.min(key).alias("k")).select("id", *fps, "k.*").where("id <> 0"), "distinct")  # equal sets are one node; 0: no words
    members = nodes.withColumn("component", F.lit(None).cast("long")) if exact else saved(nodes.join(clusters(nodes), "id"), "members")  # its size is then known: texts are shuffled only if it is too large to broadcast

    def sets(column):
        h, count = shingle_sets(column, shingle)
        return {"shingles": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), h.view(np.int64))}

    texts = rows.select("_mark", solid_id("_id").alias("_key"), "_text").join(members, ["_mark", "_key"])
    held = saved(map_texts(texts, "_text", sets, {"shingles": "array<long>"}, ["id", "component", *fps], most=1 << 20).withColumnRenamed("component", "key"), "sets")
    if exact:
        first = F.slice("shingles", F.lit(1), (F.size("shingles") - F.ceil(F.lit(least) * F.size("shingles") - 1e-9) + 1).cast("int"))
        held = held.withColumn("key", F.explode(first))
    similar = _similar_tiles(64 * LANES if exact else CLOSE_ALL, LANES, least)
    linked = components(_spanned(held, [*fps, "shingles"], TILE_SETS, lambda rows: rows.mapInArrow(similar, "u long, v long").where("u <> v")))
    return marked.join(linked, "id", "left").select("_id", "_mark", F.coalesce("component", "id").alias("_group"))


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = LEAST, exact: bool = False) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest id, then the smallest text hash, then the smallest hash of other columns.

    Texts are linked if their sets of five-word shingles have a similarity (shared of all) of 0.8
    or more; groups are what links connect. Texts without words are one group. Pairs of exactly that similarity are
    found with a probability of 0.99 or more, closer ones almost surely; exact finds every pair, at a higher cost, and
    is needed for a smaller least (ValueError without it).
    """
    if not exact and least < LEAST:
        raise ValueError(f"similarities under {LEAST} need exact=True: keys are made for {LEAST}")
    mark = F.xxhash64(quoted(text))
    rows = docs.select(quoted(id).alias("_id"), quoted(text).cast("string").alias("_text"), mark.alias("_mark"))
    found = similar_groups(rows, shingle, least, exact)
    first = found.groupBy("_group").agg(F.min(F.struct("_id", "_mark")).alias("first"))
    first = first.select(F.coalesce(F.col("first._id").cast("long"), F.lit(NO_ID)).alias("_key"), F.col("first._mark").alias("_mark"))
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *(quoted(c) for c in docs.columns if c not in (id, text)))))
    marked = docs.select(F.struct(*map(quoted, docs.columns)).alias("_in"), solid_id(id).alias("_key"), mark.alias("_mark"), rest.alias("_rest"))
    # rows of one id and text: one stays, by its other columns
    return marked.join(first, ["_key", "_mark"], "left_semi").groupBy("_key", "_mark").agg(F.min_by("_in", "_rest").alias("_in")).select("_in.*")
