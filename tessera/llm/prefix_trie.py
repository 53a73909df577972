"""A trie of conversations by their first turns, built by distributed MSD radix partitioning.

A turn is a pair of role and text. Distinct turns get whole numbers in a saved dictionary (by
SHA-256 of role and text; texts are read where they lie and not shuffled), so a conversation
travels as an array of numbers and one of text sizes. Conversations of equal turns are merged
first: one row each with its count, its smallest id and the digest of its sorted ids, which
are sorted by ranges over all tasks, packed in chunks and streamed through the hash in order.

The radix step deals distinct sequences into buckets by the key of a prefix (a 128-bit hash of
its numbers). A bucket is local when it has LOCAL_TURNS turns below its prefix at most, or one
sequence; the others are split by the next turns. A round looks at a range of depths that
doubles from round to round, so there are about log2(depth) rounds, and counts rows of a
prefix in the tasks before it shuffles. Larger prefixes are the crown of the trie: they are
nodes themselves and a table of their own. Each local bucket is finished in one task by a
multikey quicksort (three-way by the turn at the current depth); each group of equal turns is
a node. Node sums go up inside the bucket, and from its top to the crown as a row per ancestor
and task.

Bounds: a task holds one local bucket at a time, or the numbers of one conversation (its
turns times 12 bytes; texts are never collected). Any number of equal conversations or of
conversations with the same first turns is dealt over tasks. Only the hash of a node's ids is
sequential: it streams them as text.

Edge cases: null turns come first; equal turns are ordered by role, then text; a null role or
text is empty; rows of a null conversation id belong to no conversation and make no node (they
have no id to be a member by); repeated rows are repeated turns; conversations without turns
are members of the root, which is a node if there is any conversation; an empty table gives
an empty one; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, saved

LOCAL_TURNS = 1 << 14
#: Ids of a chunk of a node's sorted ids, and nodes of a batch that a task returns.
CHUNK_IDS, BATCH_NODES = 4096, 1 << 14

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and seq, the conversation's turns in order, each as id in the dictionary and size of the text in bytes."""
    rows = turns.select(
        quoted(conv).cast("long").alias("conv_id"), quoted(turn).alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")
    ).where("conv_id IS NOT NULL")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("key")
    rows = rows.select("conv_id", "turn", "role", "text", key, F.octet_length("text").cast("int").alias("size"))
    keyed = saved(rows.select("conv_id", "turn", "key", "size"), "turns")
    ids = saved(keyed.select("key").distinct().select("key", F.monotonically_increasing_id().alias("id")), "turn_ids")

    def ordered(place: str, numbered: DataFrame) -> DataFrame:
        return numbered.join(ids, "key").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), "id", "size"))).alias("seq"))

    own = saved(ordered("turn", keyed), "sequences")
    at = lambda i: F.col("seq")[i]
    same = lambda i: at(i - 1)["place"].eqNullSafe(at(i)["place"]) & (at(i - 1)["id"] != at(i)["id"])
    tied = own.where((F.size("seq") > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("seq") - 1, F.lit(1))), same)).select("conv_id")
    bare = lambda df: df.select("conv_id", F.transform("seq", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("seq"))
    if tied.isEmpty():
        return bare(own)
    # different turns at one place: their texts decide
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    again = rows.join(tied, "conv_id", "left_semi").withColumn("place", place).select("conv_id", "place", "key", "size")
    return bare(own.join(tied, "conv_id", "left_anti")).unionByName(bare(ordered("place", again)))


def rebuilt(seqs: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % group; h is the CRC-32 of c in decimal, modulo most + 1."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("seq", 1, most).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    seq = F.concat(F.when(F.col("_head").isNull(), F.slice("seq", 1, 0)).otherwise(F.slice("_head", F.lit(1), h)), F.slice("seq", h + 1, F.size("seq")))
    return seqs.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", seq.alias("seq"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column without nulls, and the bounds of its rows."""
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _with_paths(seqs: DataFrame) -> DataFrame:
    """conv_id, ids, sizes and path: the keys of the prefixes of 0, 1, 2 ... turns."""
    flat = seqs.select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.size").alias("sizes"))

    def run(batches):
        for batch in batches:
            ids, bounds = _lists(batch.column(1))
            raw, keys, ends = ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes(), [], [0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                state = hashlib.blake2b(digest_size=16)
                keys.append(state.digest())
                for i in range(a, b):
                    state.update(raw[8 * i : 8 * i + 8])
                    keys.append(state.digest())
                ends.append(len(keys))
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, path], names=["conv_id", "ids", "sizes", "path"])

    return flat.mapInArrow(run, "conv_id long, ids array<long>, sizes array<int>, path array<binary>")


def _ends(found: DataFrame) -> DataFrame:
    """conv_id (the smallest), n and sha of the ids of equal sequences: key, conv_id."""

    def chunks(batches):
        for batch in batches:
            keys, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, a = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[a] or i - a == CHUNK_IDS:
                    out.append((keys[a], convs[a], i - a, ",".join(map(str, convs[a:i]))))
                    a = i
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "n", "part"])

    def hashed(batches):
        key, state, first, n = None, None, None, 0
        for batch in batches:
            out = []
            for k, f, m, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append((first, n, state.hexdigest()))
                    key, state, first, n = k, hashlib.sha256(part.encode()), f, m
                else:
                    state.update(b"," + part.encode())
                    n += m
            yield _batch(out)
        if key is not None:
            yield _batch([(first, n, state.hexdigest())])

    def _batch(out):
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "n", "sha"])

    dealt = found.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = dealt.mapInArrow(chunks, "key binary, first long, n long, part string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "conv_id long, n long, sha string")


def finished(rows: list[tuple], top: int, parent: int | None) -> list[list]:
    """The nodes of a local bucket, in the order of NODE, its top first.

    rows: (conv_id, n, sha, ids, sizes), different sequences whose first top ids are equal.
    A multikey quicksort: groups wait on a stack, each with the depth at which it is split next.
    """
    nodes, above = [], []

    def node(group: list[tuple], depth: int, over: int) -> list[tuple]:
        """Adds the node of a group and returns those that go on below it."""
        ended = [r for r in group if len(r[3]) == depth]
        n, size = sum(r[1] for r in group), group[0][4][depth - 1] if depth else 0
        nodes.append([min(r[0] for r in group), depth, nodes[over][0] if over >= 0 else parent, n, 0, 0, (n - 1) * size, ended[0][2] if ended else NOTHING])
        above.append(over)
        return [r for r in group if len(r[3]) > depth] if ended else group

    waiting = [(node(rows, top, -1), top, 0)]
    while waiting:
        group, depth, over = waiting.pop()
        while len(group) == 1:  # a chain
            group, depth, over = node(group, depth + 1, over), depth + 1, len(nodes) - 1
        if not group:
            continue
        pivot = group[len(group) // 2][3][depth]
        less, equal, more = [], [], []
        for r in group:
            digit = r[3][depth]
            (equal if digit == pivot else less if digit < pivot else more).append(r)
        waiting += [(part, depth, over) for part in (more, less) if part]
        below = node(equal, depth + 1, over)
        if below:
            waiting.append((below, depth + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):
        x, over = nodes[i], above[i]
        x[5] = x[5] or 1
        if over >= 0:
            up = nodes[over]
            up[4] += 1
            up[5] += x[5]
            up[6] += x[6]
    return nodes


def _buckets(batches) -> Iterator[list[dict]]:
    """The rows of each bucket; rows come sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _finish(batches):
    """Nodes of local buckets; rows with a key: what a crown node gets from below, or the digest of the conversations that end at it."""
    names = ["key", *(c.split()[0] for c in NODE.split(", "))]
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out, ups = [], {}

    def drained():
        rows = [(k, None, None, None, None, *v, None) for k, v in ups.items()]
        ups.clear()
        return rows

    for group in _buckets(batches):
        top, parent, path = group[0]["top"], group[0]["parent"], group[0]["path"]
        if top >= len(path):
            out += [(r["bucket"], None, None, None, None, None, None, None, r["sha"]) for r in group]
        else:
            nodes = finished([(r["conv_id"], r["n"], r["sha"], r["ids"], r["sizes"]) for r in group], top, parent)
            out += [(None, *x) for x in nodes]
            for j in range(top):
                up = ups.setdefault(path[j], [0, 0, 0])
                up[0] += j == top - 1
                up[1] += nodes[0][5]
                up[2] += nodes[0][6]
        if len(ups) > BATCH_NODES:
            out += drained()
        if len(out) >= BATCH_NODES:
            yield batch(out)
            out = []
    out += drained()
    if out:
        yield batch(out)


def crown_of(rows: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame | None:
    """The prefixes whose buckets are not local: key, depth, n_convs, first (smallest conv_id), size of the last text. None if there is none."""
    found, open_, low, high = [], rows, 0, 2
    while True:
        each = open_.select("conv_id", "n", "sizes", F.size("ids").alias("len"), F.posexplode(F.slice("path", low + 1, high - low)).alias("i", "key"))
        each = each.select("key", (F.col("i") + low).alias("depth"), "conv_id", "n", (F.col("len") - F.col("i") - low + 1).alias("turns"), F.when(F.col("i") + low > 0, F.get("sizes", F.col("i") + low - 1)).otherwise(0).alias("size"))
        sums = each.groupBy("key", "depth").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"), F.max("size").alias("size"), F.count("*").alias("rows"), F.sum("turns").alias("turns"))
        large = saved(sums.where((F.col("rows") > 1) & (F.col("turns") > local_turns)).drop("rows", "turns"), "crown")
        last = large.where(F.col("depth") == high - 1)
        if large.isEmpty():
            break
        found.append(large)
        if last.isEmpty():
            break
        open_ = rows.join(last.select("key"), F.get(rows["path"], F.lit(high - 1)) == last["key"], "left_semi")
        low, high = high, 2 * high
    if not found:
        return None
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(seqs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row per node (NODE) of the trie of conv_id, seq as sequences() gives them; conv_id names each row once."""
    paths = saved(_with_paths(seqs), "paths")
    ends = _ends(paths.select(F.element_at("path", -1).alias("key"), "conv_id"))
    rows = saved(paths.join(ends, "conv_id"), "distinct")
    crown = crown_of(rows, local_turns)
    if crown is None:
        dealt = rows.withColumns({"top": F.lit(0), "parent": F.lit(None).cast("long")})
    else:
        deepest = crown.agg(F.max("depth")).first()[0]
        met = rows.select("conv_id", F.explode(F.slice("path", 1, deepest + 1)).alias("key")).join(crown.select("key", "depth", "first"), "key")
        under = met.groupBy("conv_id").agg(F.max(F.struct("depth", "first")).alias("_under"))
        dealt = rows.join(under, "conv_id").select(*rows.columns, (F.col("_under.depth") + 1).alias("top"), F.col("_under.first").alias("parent"))
    bucket = F.element_at("path", F.least(F.col("top") + 1, F.size("path")))
    local = dealt.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket")
    parts = saved(local.mapInArrow(_finish, f"key binary, {NODE}"), "nodes")
    nodes = parts.where("key IS NULL").drop("key")
    if crown is None:
        return nodes
    told = crown.join(rows.select(F.col("conv_id").alias("first"), "path"), "first").withColumn("path", F.slice("path", F.lit(1), F.col("depth") + 1))
    told = saved(told.withColumn("own", (F.col("n_convs") - 1) * F.col("size")), "crown_paths")
    each = told.select("depth", "own", F.posexplode("path").alias("j", "key"))
    inner = each.select("key", (F.col("j") == F.col("depth") - 1).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    below = parts.where("key IS NOT NULL AND ends_sha256 IS NULL").select("key", "n_children", "n_leaves", "saved_tokens").unionByName(inner)
    sums = below.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    over = crown.select(F.col("key").alias("_over"), F.col("first").alias("parent_conv_id"))
    top = told.withColumn("_over", F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))).join(over, "_over", "left").join(sums, "key")
    top = top.join(parts.where("key IS NOT NULL AND ends_sha256 IS NOT NULL").select("key", "ends_sha256"), "key", "left")
    first = F.col("first").alias("conv_id")
    return nodes.unionByName(top.select(first, F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
