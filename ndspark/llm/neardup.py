"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

1. Each text becomes the set of its word shingles (64-bit hashes), a digest of it and a signature. Texts
   with equal sets are one class at once, however many they are.
2. The forest: the signature's values, cut into several orders ("trees"). All classes are sorted by each order, in
   ranges over the cluster, and each is compared with the WINDOW neighbours before it that share a prefix of at least
   SHORTEST values. These are the neighbours of the longest common prefixes, so that the depth adapts to the
   region: a sparse one is compared down to SHORTEST values, a crowded one only as deep as its own longest prefixes.
   Regions go on across the borders of ranges. A spanning forest of the likely links is kept: never all pairs.
3. These links give clusters, searched exactly on full sets: from one class to all not reached yet, and so on.
   One of more than CLUSTER classes, or ROOM shingles, is dealt into stretches of three of the sorted orders.
4. Classes of regions with more neighbours than were compared, and those of large clusters, may have more links. Two linked sets
   share one of the rarest shingles of each, so these classes meet by these (prefix filtering): a class goes once to each
   small group of classes where another has one of them, and what isn't joined yet and isn't ruled out by the signatures is
   compared on full sets. No list of a shingle is cut.

A link is lost only where the forest or a signature misses it: see likely and README.

Null and empty texts and those without words have the empty set and link with nothing. Texts with fewer
words than a shingle are one shingle. Rows with a null id take no part: their component is null and
they are kept. Repeated rows share a class. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices

TREES, DEPTH = 16, 8
N_HASHES = TREES * DEPTH
#: Values of the shortest prefix of a region; neighbours that a class is compared with in an order; classes and
#: shingles that are searched at once; the sorted orders in which large clusters are searched.
SHORTEST, WINDOW, CLUSTER, ROOM, SEARCHED = 3, 32, 400, 1_000_000, (0, 5, 10)
#: Classes of a group whose sets wait in one task, groups in an array; classes and shingles that tell which shingles are common (any order would do).
GROUP, PARTS, ORDER_CLASSES, ORDER_SHINGLES = 128, 1024, 2000, 50_000
#: Ids that may be broadcast; links that one task may join.
BROADCAST_IDS, ONE_TASK = 500_000, 100_000
_RNG = np.random.default_rng(8)
FLIP = _RNG.integers(0, 2**32, N_HASHES, np.uint32)
SPIN = _RNG.integers(0, 2**31, N_HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
PLACE = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """The distinct shingles as sorted hashes. bytes.lower and bytes.split know ASCII only, as is wanted."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        mixed += h[k : len(h) - size + 1 + k] * PLACE[k]
        mixed ^= mixed >> np.uint64(29)
    mixed *= PLACE[-1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """N_HASHES minima over the set, folded to 16 bits. All of a value makes an order, its lower byte suffices to estimate."""
    low, x = np.full(N_HASHES, 2**32 - 1, np.uint32), hashes.astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = (x[at : at + 2048, None] ^ FLIP) * SPIN
        np.minimum(low, part.min(0), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def digest_of(text_col: str) -> Column:
    """Of a text; a null one counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def with_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n_shingles, node, sig, orders): digest is of the text, node names the set (a hash of it), null for the empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in slices(batches):
            sets = [shingles(t, size, words) for t in b.column("text").to_pylist()]
            values = [signature(s) if len(s) else None for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())]
            cols += [pa.array([None if v is None else v.astype(kind).tobytes() for v in values], pa.binary()) for kind in (np.uint8, "<u2")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), *cols], ["doc_id", "digest", "n_shingles", "node", "sig", "orders"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest_of(text_col).alias("digest"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, n_shingles long, node long, sig binary, orders binary")


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def likely(threshold: float) -> int:
    """Equal bytes of two signatures below which a link as strong as threshold is practically impossible."""
    p = threshold + (1 - threshold) / 256
    return int(N_HASHES * (p - 4.7 * (p * (1 - p) / N_HASHES) ** 0.5))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each key in turn; equal keys must be neighbours."""
    held: list[dict] = []
    for b in slices(batches, 256):
        for row in b.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def rooted(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def near(nodes: np.ndarray, before: np.ndarray, sigs: np.ndarray, least: int, window: int, begin: int = 0) -> np.ndarray:
    """Links (a, b) that hold together what is alike among rows of a sorted order and the `window` rows before them.

    before: how many rows before a row are in its region. The nearest rows, those of the longest common
    prefixes, come first, and rows that are together already aren't compared again. Rows under begin only help."""
    names, label = np.unique(nodes, return_inverse=True)
    root, out = np.arange(len(names)), []
    for k in range(1, window + 1):
        i = np.flatnonzero(before >= k)
        i = i[i >= begin]
        if not len(i):
            break
        i = i[label[i] != label[i - k]]
        i = i[(sigs[i] == sigs[i - k]).sum(1) >= least]
        if len(i):
            ends = np.unique(np.sort(np.stack([label[i], label[i - k]], 1), 1), axis=0, return_index=True)[1]
            for j in i[ends].tolist():
                a, b = rooted(root, int(label[j])), rooted(root, int(label[j - k]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((nodes[j], nodes[j - k]))
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    return np.array(out, np.int64).reshape(-1, 2)


def as_bytes(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


FOUND = "a long, b long, region binary, sig binary, part int, n long"


def found(links: np.ndarray, crowded: np.ndarray, border: list[tuple] | None = None) -> pa.RecordBatch:
    """Rows of FOUND: links (a, b), crowded nodes (a alone) and border rows (with a region)."""
    n, border = len(links) + len(crowded), border or []
    cols = [[*links[:, 0].tolist(), *crowded.tolist()], [*links[:, 1].tolist(), *[None] * len(crowded)], *([None] * n for _ in range(4))]
    for row in border:
        for c, x in zip(cols, row, strict=True):
            c.append(x)
    types = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["a", "b", "region", "sig", "part", "n"])


def forest_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): likely links that hold together whatever the forest finds alike; and (node) of the crowded regions,
    whose classes have more neighbours than were compared. classes: (node, sig, orders)."""
    least, wide = likely(threshold), 1 + 2 * SHORTEST
    each = classes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "orders")
    key = F.expr(f"concat(unhex(lpad(hex(tree), 2, '0')), substring(orders, tree * {2 * DEPTH} + 1, {2 * DEPTH}))")
    ordered = each.select(key.alias("key"), "node", "sig").repartitionByRange("key", "node").sortWithinPartitions("key", "node")

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nodes, sigs, keys = np.zeros(0, np.int64), np.zeros((0, N_HASHES), np.uint8), np.zeros((0, wide), np.uint8)
        before, first, n_first, opening = np.zeros(0, np.int64), [], 0, True
        for b in slices(batches, 8192):
            if not b.num_rows:
                continue
            held = len(nodes)
            nodes = np.concatenate([nodes, b.column("node").to_numpy()])
            sigs = np.concatenate([sigs, as_bytes(b.column("sig"), N_HASHES)])
            keys = np.concatenate([keys, as_bytes(b.column("key"), 1 + 2 * DEPTH)[:, :wide]])
            same = np.concatenate([[False], (keys[1:] == keys[:-1]).all(1)])
            at = np.arange(len(nodes))
            starts = np.maximum.accumulate(np.where(same, 0, at))
            before = np.where(starts > 0, at - starts, at + (before[0] if held else 0))
            if opening:  # the region that the partition begins with
                own = np.flatnonzero(starts[held:] == 0) + held
                first += [(keys[k].tobytes(), int(nodes[k]), sigs[k].tobytes()) for k in own[: max(0, WINDOW + 1 - len(first))]]
                n_first += len(own)
                opening = len(own) == b.num_rows
            full = np.flatnonzero(before > WINDOW)
            whole = np.unique(np.concatenate([full, *(full[before[full] == WINDOW + 1] - k for k in range(1, WINDOW + 2))]))
            yield found(near(nodes, np.minimum(before, at), sigs, least, WINDOW, held), np.unique(nodes[whole[whole >= 0]]))
            rest = max(0, len(nodes) - WINDOW - 1)
            nodes, sigs, keys, before = nodes[rest:], sigs[rest:], keys[rest:], before[rest:]
        if len(nodes):
            n_last = int(before[-1]) + 1
            last = [(keys[k].tobytes(), int(nodes[k]), sigs[k].tobytes()) for k in range(max(0, len(nodes) - n_last), len(nodes))]
            if keys[-1].tobytes() == first[0][0]:
                last = last[max(0, len(last) + len(first) - n_first) :]  # the same region: each row once
            rows = [(x, n_first) for x in first] + [(x, n_last) for x in last]
            none = np.zeros((0, 2), np.int64)
            yield found(none, none[:, 0], [(node, None, region, sig, part, n) for (region, node, sig), n in rows])

    result = cut(ordered.mapInArrow(neighbours, FOUND))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "region"):
            parts = {r["part"]: r["n"] for r in rows}
            if len(parts) > 1:
                nodes = np.array([r["a"] for r in rows], np.int64)
                sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
                links = near(nodes, np.arange(len(rows)), sigs, least, WINDOW)
                yield found(links, nodes if sum(parts.values()) > WINDOW + 1 else nodes[:0])

    # a region goes on in the next partition; at most 2 * (WINDOW + 1) rows of each partition stand at its borders
    border = result.where("region is not null").withColumn("place", F.monotonically_increasing_id())
    beyond = cut(border.repartition("region").sortWithinPartitions("region", "place").mapInArrow(across, FOUND))
    both = result.where("region is null").unionByName(beyond)
    links = both.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links, both.where("b is null").select(F.col("a").alias("node")).distinct()


def rare_first(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set, rarest first. One order for all sets is all that prefix filtering needs; counts only make it fast."""
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    seen = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(len(hashes))
    return hashes[np.lexsort((hashes, seen))]


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles a set of n shares one of with any larger or equal set that it links with; with any set.

    A link of sizes n <= m has at least percent * m / 100 and 2 * percent * n / (100 + percent) shingles in common."""
    return n + 1 + -2 * percent * n // (100 + percent), n + 1 + -percent * n // 100


def full_sets(docs: DataFrame, classes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """classes (node, rep, more columns) with the set as bytes."""
    names = [k for k in classes.columns if k != "rep"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in slices(batches):
            sets = [shingles(t, size, words) for t in b.column("text").to_pylist()]
            true = [node_of(s) == k if len(s) else False for s, k in zip(sets, b.column("node").to_pylist(), strict=True)]  # a repeated id may have brought other texts
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "set"]).filter(pa.array(true, pa.bool_()))

    few = classes.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(classes) if few else classes, "rep").select(*names, "text")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInArrow(run, f"{schema}, set binary").dropDuplicates(["node"])


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def stretches(batches: Iterable[pa.RecordBatch], most: int, most_room: int) -> Iterator[list[dict]]:
    """Neighbouring rows of one cluster, as many as are searched at once."""
    held: list[dict] = []
    room = 0
    for b in slices(batches, 64):
        for row in b.to_pylist():
            size = len(row["set"]) // 8
            if held and (held[0]["cluster"] != row["cluster"] or len(held) == most or room + size > most_room):
                yield held
                held, room = [], 0
            held.append(row)
            room += size
    if held:
        yield held


def search_stretches(members: DataFrame, tree: int, percent: int) -> DataFrame:
    """(a, b) links of large clusters, searched in stretches of one sorted order. members: (cluster, node, orders, set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, CLUSTER, ROOM):
            label = searched([as_set(r["set"]) for r in rows], percent)
            pairs = [(rows[k]["node"], rows[j]["node"]) for j, k in enumerate(label) if k != j]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in pairs], pa.int64()) for e in (0, 1)], ["a", "b"])

    key = F.expr(f"substring(orders, {tree * 2 * DEPTH + 1}, {2 * DEPTH})").alias("key")
    dealt = members.select("cluster", key, "node", "set").repartitionByRange("cluster", "key", "node")
    return dealt.sortWithinPartitions("cluster", "key", "node").mapInArrow(run, "a long, b long")


def rare_meetings(members: DataFrame, percent: int) -> DataFrame:
    """(node, group): a member and a group where another, of a different cluster, shares one of the rarest shingles of
    each. members: (node, cluster, group, set). A leader meets the groups of a shingle, not their members one by one."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(as_set(b"".join(b.column("set").to_pylist())).view(np.int64))], ["shingle"])

    some = members.orderBy(F.xxhash64("node"), "node").limit(ORDER_CLASSES).select("set")
    seen = some.mapInArrow(listed, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    order = sorted((r.shingle % 2**64, r.n) for r in seen.orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).collect())
    common, counts = np.array([x for x, _ in order], np.uint64), np.array([n for _, n in order], np.int64)

    def rarest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own, rest = [], []
            for s in map(as_set, b.column("set").to_pylist()):
                few, many = prefixes(len(s), percent)
                first = rare_first(s, common, counts)[:many].view(np.int64)
                own.append(first[:few].tolist())
                rest.append(first[few:].tolist())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cluster"), b.column("group"), *(pa.array(x, pa.list_(pa.int64())) for x in (own, rest))], ["node", "cluster", "group", "own", "rest"])

    firsts = members.select("node", "cluster", "group", "set").mapInArrow(rarest, "node long, cluster long, group int, own array<long>, rest array<long>")
    marked = lambda k, own: F.transform(k, lambda x: F.struct(x.alias("shingle"), F.lit(own).alias("own")))
    rows = cut(firsts.select("node", "cluster", "group", F.explode(F.concat(marked("own", True), marked("rest", False))).alias("p")).select("p.shingle", "p.own", "node", "cluster", "group"))
    # a pair to compare has an end that owns the shingle and an end outside the list's largest cluster: the fewer lead
    per = rows.groupBy("shingle", "cluster").agg(F.count("*").alias("n"), F.count_if("own").alias("owners"))
    per = per.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("owners").alias("owners"), F.max(F.struct("n", "cluster")).alias("top"), F.count("*").alias("clusters")).where("clusters > 1 and owners > 0")
    lists = cut(per.select("shingle", F.col("top.cluster").alias("largest"), (F.col("owners") <= F.col("n") - F.col("top.n")).alias("by_owner")))
    few = lists.count() <= BROADCAST_IDS
    shared = rows.join(F.broadcast(lists) if few else lists, "shingle")
    leads = F.when(F.col("by_owner"), F.col("own")).otherwise(F.col("cluster") != F.col("largest"))
    part = F.floor(F.col("group") / PARTS).cast("int").alias("part")  # bounds the arrays
    of_list = shared.groupBy("shingle", part).agg(F.collect_set("group").alias("groups"))
    of_node = shared.where(leads).select("shingle", "node").join(of_list, "shingle").groupBy("node", "part").agg(F.array_distinct(F.flatten(F.collect_list("groups"))).alias("groups"))
    return of_node.select("node", F.explode("groups").alias("group"))


def hosted(meetings: DataFrame, members: DataFrame, more: list[str], look: Callable[[dict, list[dict]], list[tuple[int, int]]], names: list[str], percent: int) -> DataFrame:
    """What look finds for each of meetings (node, group) and the members of the group that are of other clusters and that
    neither size nor signature rules out. A group's members wait in one task for its guests."""
    least, columns = likely(percent / 100), ["group", "node", "cluster", "sig", "n", *more]
    hosts = members.select(*columns, F.lit(False).alias("guest"))
    guests = meetings.join(members.drop("group"), "node").select(*columns, F.lit(True).alias("guest"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sigs = None, [], None
        for b in slices(batches, 64):
            out: list[tuple[int, int]] = []
            for r in b.to_pylist():
                if r["group"] != at:
                    at, held, sigs = r["group"], [], None
                if not r["guest"]:
                    held.append(r)
                    continue
                if sigs is None:
                    sigs = np.frombuffer(b"".join(x["sig"] for x in held), np.uint8).reshape(len(held), -1)
                    of, sizes = (np.array([x[k] for x in held]) for k in ("cluster", "n"))
                able = (of != r["cluster"]) & (100 * np.minimum(sizes, r["n"]) >= percent * np.maximum(sizes, r["n"]))
                able &= (sigs == np.frombuffer(r["sig"], np.uint8)).sum(1) >= least
                if able.any():
                    out += look(r, [held[k] for k in np.flatnonzero(able)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in out], pa.int64()) for e in (0, 1)], names)

    rows = hosts.unionByName(guests).repartition("group").sortWithinPartitions("group", "guest")
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in names))


def confirmed(meetings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of different clusters on the full sets of members (node, cluster, sig, n, group, set), one for each
    member of meetings (node, group) and cluster in the group. Sets go only to groups where the signatures leave something to compare."""

    def links(guest: dict, able: list[dict]) -> list[tuple[int, int]]:
        near = Linked([as_set(x["set"]) for x in able], percent).to(as_set(guest["set"]))
        return [*{x["cluster"]: (guest["node"], x["node"]) for x, yes in zip(able, near, strict=True) if yes}.values()]

    left = hosted(cut(meetings), members, [], lambda guest, able: [(guest["node"], able[0]["group"])], ["node", "group"], percent)
    return hosted(cut(left), members, ["set"], links, ["a", "b"], percent)


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges (u, v) of one task, by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["node", "component"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the least node reached.

    Alternating stars: all larger neighbours, then all smaller ones, are linked to the least neighbour,
    until nothing changes; the number of rounds grows with the logarithm of the longest path. Links that
    are counted to be few enough for one task are joined there, which saves the rounds."""
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(joined, "node long, component long")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


class Linked:
    """Whether 100 * intersection >= percent * union, for one set against many."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets])
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.firsts = self.sizes.cumsum() - self.sizes

    def to(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, self.all), len(own) - 1)
        shared = np.add.reduceat((own[at] == self.all).astype(np.int64), self.firsts)
        return 100 * shared >= self.percent * (self.sizes + len(own) - shared)


def searched(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first one of its component, all links confirmed."""
    label, rest = [-1] * len(sets), np.arange(len(sets))
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        label[first], front = first, [first]
        while front and len(rest):
            own = sets[front.pop()]
            sizes = np.array([len(sets[k]) for k in rest])
            able = 100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))
            if able.any():
                near = rest[able][Linked([sets[k] for k in rest[able]], percent).to(own)]
                for k in near.tolist():
                    label[k] = first
                    front.append(k)
                rest = rest[~np.isin(rest, near)]
    return label


def cluster_texts(docs: DataFrame, clustered: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cluster, node, text) for (cluster, node, rep): texts of the classes' first documents."""
    few = clustered.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(clustered) if few else clustered, "rep").select("cluster", "node", "text")


def search_clusters(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links that hold the components of each cluster together; clusters are small."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for rows in runs(batches, "cluster"):
            sets = {}
            for r in rows:  # a repeated id may have brought other texts
                s = shingles(r["text"], size, words)
                if node_of(s) == r["node"]:
                    sets[r["node"]] = s
            nodes = sorted(sets)
            label = searched([sets[k] for k in nodes], percent)
            pairs = [(nodes[k], nodes[j]) for j, k in enumerate(label) if k != j]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in pairs], pa.int64()) for e in (0, 1)], ["a", "b"])

    return texts.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    return judged(docs, shingle, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The same with the digest of the text and the group: a node of the component, null for the empty set.

    Components may share an id, where it is repeated with different texts; they never share a group."""
    rows = cut(with_sets(docs, shingle, id_col, text_col))
    classes = cut(rows.where("node is not null and doc_id is not null").groupBy("node", "sig", "orders", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    likely_links, crowded = forest_links(classes.select("node", "sig", "orders"), percent / 100)
    clusters = cut(components(likely_links).withColumnRenamed("component", "cluster").join(classes.select("node", "rep", "n_shingles"), "node"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("room"))
    sized = cut(clusters.join(sizes, "cluster").select("cluster", "node", "rep", ((F.col("members") > CLUSTER) | (F.col("room") > ROOM)).alias("large")))
    links = cut(search_clusters(cluster_texts(docs, sized.where("not large").select("cluster", "node", "rep"), id_col, text_col), shingle, percent))
    large = sized.where("large").select("node", "cluster")
    open_ = crowded.join(large, "node", "full_outer").join(classes.select("node", "rep", "sig", "orders"), "node")
    if not open_.isEmpty():
        members = cut(full_sets(docs, open_.select("node", "rep", "sig", "orders", "cluster"), shingle, id_col, text_col))
        inside = members.where("cluster is not null")
        for tree in SEARCHED:
            links = links.unionByName(search_stretches(inside, tree, percent))
        links = cut(links)
        so_far = components(links).withColumnRenamed("component", "cluster")
        group = F.pmod(F.xxhash64("node"), F.lit(1 + members.count() // GROUP)).cast("int").alias("group")
        grouped = cut(members.drop("cluster").join(so_far, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"), "sig", (F.octet_length("set") / 8).cast("long").alias("n"), group, "set"))
        links = links.unionByName(confirmed(rare_meetings(grouped, percent), grouped, percent))
    joined = components(links).join(classes.select("node", "rep"), "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("first"))
    first_of = joined.join(least, "component").select("node", "first", "component")
    named = cut(classes.join(first_of, "node", "left").select("node", "n", F.coalesce("first", "rep").alias("first"), F.coalesce("component", "node").alias("group")))
    # sets of very many copies: at most 8 * partitions of them, whose rows needn't be shuffled
    many = F.col("n") > rows.count() // (8 * partitions(docs.sparkSession))
    hot, plain = named.where(many).select("node", "first", "group"), named.where(~many).select("node", "first", "group")
    alone = rows.where("node is null").select("doc_id", "digest", "n_shingles", F.lit(None).cast(named.schema["first"].dataType).alias("first"), F.lit(None).cast("long").alias("group"))
    some = rows.where("node is not null").select("doc_id", "digest", "n_shingles", "node")
    copies = some.join(F.broadcast(hot), "node").drop("node")
    others = some.join(F.broadcast(hot.select("node")), "node", "left_anti").join(plain, "node", "left").drop("node")
    result = alone.unionByName(copies).unionByName(others)
    own: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return result.select("doc_id", "digest", "group", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates; rows with a null id stay.

    Rows are told by id and text: of one id, texts that aren't alike all stay. The rows to drop go to the documents:
    broadcast only where they are counted to be few."""
    found = cut(judged(docs, shingle, percent, id_col, text_col).where("doc_id is not null"))
    keys = found.groupBy("doc_id", "digest", "group", "kept").agg(F.count("*").alias("n"))
    # a group's kept rows have one id; of their texts one stays
    stays = keys.where("kept").groupBy("doc_id", "group").agg(F.min(F.struct("digest", "n")).alias("first"))
    staying = stays.select("doc_id", "first.digest", "first.n")
    drop = keys.select("doc_id", "digest").join(staying, ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("__copy"), F.col("digest").alias("__text"))
    drop = cut(drop)
    few = drop.count() <= BROADCAST_IDS
    digest = digest_of(text_col)
    rest = docs.join(F.broadcast(drop) if few else drop, (docs[id_col] == F.col("__copy")) & (digest == F.col("__text")), "left_anti")
    repeated = cut(staying.where("n > 1").select(F.col("doc_id").alias("__again"), F.col("digest").alias("__text")))
    if repeated.isEmpty():
        return rest
    again = F.col("__again").isNotNull()
    marked = rest.join(repeated, (rest[id_col] == F.col("__again")) & (digest == F.col("__text")), "left")
    return marked.where(~again).unionByName(marked.where(again).dropDuplicates([id_col, "__text"])).drop("__again", "__text")
