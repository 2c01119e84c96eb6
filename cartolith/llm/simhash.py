"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

1. A text's fingerprint: A-Z in lower case, shingles of three words (repeats count), XXH64 of each with seed 42; a bit
   is set if it is set in over half of the hashes. Equal fingerprints are one node from here on.
2. A shard tree is fitted on a bounded sample of fingerprints: each node holds a vantage point and a radius, chosen so
   that few fingerprints lie near the border. Every fingerprint goes to its own leaf. As a query, it goes to each leaf
   that a ball of ``distance`` around it reaches (the triangle bound |d(x, v) - radius| <= distance); at a node where it
   is at home outside, that is the inside, while the inside asks nothing of the outside, so a pair meets once. Leaves that
   are still over-full get a tree of their own, fitted on a sample of them, until none is.
3. In its leaf a fingerprint tree is built again, down to small blocks, and searched with the same bounds; where no
   radius prunes, fingerprints ask for all within ``distance`` of theirs by name. A leaf gives a spanning forest of its
   links, not all pairs, so a group of n near copies gives at most n - 1 edges a leaf.
4. The forests' components are found by star contraction, see :mod:`cartolith.llm.components`.

Rows get their component by a join on the fingerprint; fingerprints that hold a ``HOT``-th of all rows or more, at most
``HOT`` of them, are broadcast, so that no task gathers the rows of one.

A text without words (null, empty, white space) has fingerprint zero and is linked like any other. A null doc_id is
never the least of a component unless all of its doc_ids are null. Repeated rows give repeated results. Other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, about, col, fresh, map_blocks, map_texts, quoted, split_words, stored, stored_from
from .components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}
SHINGLE, SEED = 3, 42


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = WORD.findall(_lowered(text)) if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [" ".join(words)]
    else:
        shingles = [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(x.encode("utf-8", "surrogatepass"), SEED) for x in shingles])  # big-endian, so bit 63 is first
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): fingerprints as signed longs, one per row."""
    return map_texts(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), ["doc_id"], "text", "fp long", lambda texts: [np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)])


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _split(points: np.ndarray, distance: int, rng: np.random.Generator, tries: int = 12) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius and distances such that few points are near the border and both sides are large; None if all coincide."""
    best = None
    few = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        count = np.bincount(distances(few, v), minlength=65).cumsum()
        n = count[-1]
        fair = np.flatnonzero((count >= n * 0.2) & (count <= n * 0.8))
        for r in fair if len(fair) else np.flatnonzero((count > 0) & (count < n)):
            inside, outside = count[min(64, r + distance)] / n, 1 - (count[r - distance] if r >= distance else 0) / n
            # points that each side searches, weighted by what the side holds
            cost = inside * count[r] / n + outside * (1 - count[r] / n)
            if best is None or cost < best[0]:
                best = cost, v, int(r)
    return best and (best[1], best[2], distances(points, best[1]))


def fit_tree(points: np.ndarray, leaves: int, distance: int, least: int = 16) -> list[tuple]:
    """A shard tree of up to ``leaves`` leaves as rows (vantage, radius, inside, outside); a negative child -1-k is leaf k."""
    rng = np.random.default_rng(7)
    nodes: list[list] = []
    parts, made = [(np.unique(points), None)], 0
    queue = list(parts)
    open_leaves = 1
    place: list[tuple] = []
    while queue:
        queue.sort(key=lambda x: -len(x[0]))
        own, slot = queue.pop(0)
        found = _split(own, distance, rng) if open_leaves < leaves and len(own) >= 2 * least else None
        if found is None:
            place.append((slot, made))
            made += 1
            continue
        v, r, d = found
        inside, outside = own[d <= r], own[d > r]
        if not len(inside) or not len(outside):
            place.append((slot, made))
            made += 1
            continue
        k = len(nodes)
        nodes.append([np.uint64(v), r, None, None])
        if slot is not None:
            nodes[slot[0]][slot[1]] = k
        queue += [(inside, (k, 2)), (outside, (k, 3))]
        open_leaves += 1
    for slot, leaf in place:
        if slot is not None:
            nodes[slot[0]][slot[1]] = -1 - leaf
    return [tuple(x) for x in nodes]


def route(tree: list[tuple], points: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where points go: (index of the point, leaf, whether it is the point's own leaf).

    ``own`` tells which points are at home in the tree; the others are queries. A point at home inside a node's radius
    asks nothing outside, as those outside ask inside.
    """
    if not tree:
        return np.arange(len(points)), np.zeros(len(points), np.int64), own
    rows, leaves, owns = [], [], []
    stack = [(0, np.arange(len(points)), own)]
    while stack:
        k, at, home = stack.pop()
        if not len(at):
            continue
        if k < 0:
            rows.append(at)
            leaves.append(np.full(len(at), -1 - k))
            owns.append(home)
            continue
        v, r, inside, outside = tree[k]
        d = distances(points[at], v).astype(np.int64)
        reach = d <= r + distance
        stack.append((inside, at[reach], (home & (d <= r))[reach]))
        reach = np.where(home, d > r, d > r - distance)
        stack.append((outside, at[reach], (home & (d > r))[reach]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(owns)


class Forest:
    """Union-find that keeps the edges which joined two sets."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def neighbours(distance: int) -> np.ndarray:
    """All 64-bit patterns of 1 to ``distance`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(1, distance + 1) for bits in combinations(range(64), n)], np.uint64)


def leaf_forest(points: np.ndarray, own: np.ndarray, distance: int, block: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links, within ``distance``, between a leaf's own points and all that came to it.

    Points are different from each other. A block is searched pair by pair if that is less work than to look all
    neighbours of its own points up by name.
    """
    forest, rng = Forest(len(points)), np.random.default_rng(11)
    names = neighbours(distance) if distance <= 2 else None
    stack = [(np.flatnonzero(own), np.arange(len(points)), 0)]  # own points of a subtree, all whose ball reaches it, and splits that pruned nothing
    while stack:
        mine, near, idle = stack.pop()
        if not len(mine) or len(near) < 2:
            continue
        found = _split(points[mine], distance, rng, 4) if len(mine) > block and idle < 3 else None
        if found is not None:
            v, r, d = found
            far = distances(points[near], v).astype(np.int64)
            parts = [(mine[d <= r], near[far <= r + distance]), (mine[d > r], near[far > r - distance])]
            stack += [(m, n, idle + 1 if 10 * len(n) > 9 * len(near) else 0) for m, n in parts]
            continue
        few = points[near]
        if names is not None and len(few) > 4 * len(names):
            order = np.argsort(few)
            sorted_few = few[order]
            for a in mine:
                asked = names ^ points[a]
                at = np.minimum(np.searchsorted(sorted_few, asked), len(few) - 1)
                for b in near[order[at[sorted_few[at] == asked]]]:
                    forest.link(int(a), int(b))
            continue
        for a in mine:
            for b in near[np.bitwise_count(few ^ points[a]) <= distance]:
                if a != b:
                    forest.link(int(a), int(b))
    return forest.edges


#: A fingerprint is hot if it holds this share of all rows, so there are at most so many.
HOT = 1000
#: Over-full leaves that get a tree in one round; their trees are broadcast.
ROUND = 1024


def sharded(nodes: DataFrame, count: int, distance: int, sample: int, leaf: int) -> DataFrame:
    """The table (leaf long, fp long, own boolean) of ``nodes`` (fp), ``count`` of them, by trees of the sort that :func:`fit_tree` fits.

    Leaves have about ``leaf`` own fingerprints, twice as many at most unless they can't be parted.
    """
    spark = nodes.sparkSession
    few = about(nodes.select("fp"), sample, count).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = fit_tree(few, max(1, -(-count // leaf)), distance)

    def first(frames):
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            at, where, own = route(tree, points, np.ones(len(points), bool), distance)
            yield pd.DataFrame({"leaf": where, "fp": points[at].view(np.int64), "own": own})

    schema = "leaf long, fp long, own boolean"
    rows = nodes.select("fp").mapInPandas(first, schema)
    if count <= 2 * leaf:
        return rows
    rows, base, stuck = stored(rows, "leaves"), len(tree) + 1, []
    while True:
        sizes = rows.where("own").groupBy("leaf").count().where(F.col("count") > 2 * leaf)
        sizes = sizes.where(~F.col("leaf").isin(stuck)) if stuck else sizes
        full = {r["leaf"]: r["count"] for r in sizes.orderBy(F.desc("count")).limit(ROUND).collect()}
        if not full:
            return rows
        most = max(256, sample // len(full))
        rates = F.create_map(*(F.lit(x) for k, n in full.items() for x in (k, min(1.0, most / n))))
        drawn = rows.where("own").where(F.rand(29) < F.coalesce(rates[F.col("leaf")], F.lit(0.0))).select("leaf", "fp").toPandas()  # about ``sample`` at most
        trees = {k: fit_tree(g["fp"].to_numpy(np.int64).view(np.uint64), min(64, -(-full[k] // leaf)), distance) for k, g in drawn.groupby("leaf")}
        stuck += [k for k in full if not trees.get(k)]
        trees = {k: (base + 64 * i, t) for i, (k, t) in enumerate((k, t) for k, t in trees.items() if t)}
        base += 64 * len(trees)
        shared = spark.sparkContext.broadcast(trees)

        def again(frames):
            for frame in frames:
                place, points, own = frame["leaf"].to_numpy(np.int64).copy(), frame["fp"].to_numpy(np.int64).view(np.uint64), frame["own"].to_numpy(bool)
                keep = ~np.isin(place, list(shared.value))
                out = [(place[keep], points[keep], own[keep])]
                for k in np.unique(place[~keep]).tolist():
                    here = np.flatnonzero(place == k)
                    start, t = shared.value[k]
                    at, where, home = route(t, points[here], own[here], distance)
                    out.append((start + where, points[here][at], home))
                leaf_of, fps, owns = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"leaf": leaf_of, "fp": fps.view(np.int64), "own": owns})

        rows = stored(rows.mapInPandas(again, schema), "leaves")
        shared.destroy()


def link(every: DataFrame, distance: int = 2, sample: int = 32_768, leaf: int = 16_384) -> DataFrame:
    """(fp, root, component_id, n) for each fingerprint of ``every`` (doc_id, fp): its component's least fingerprint and least doc_id, and its rows; a stored table.

    ``sample`` bounds the fingerprints that a round's shard trees are fitted on, ``leaf`` is the aim for a leaf's own ones.
    """
    return stored_from(every.sparkSession, lambda: _linked(every, distance, sample, leaf), "linked")


def tree_links(nodes: DataFrame, distance: int = 2, sample: int = 32_768, leaf: int = 16_384) -> DataFrame:
    """(a, b): forests, one a leaf of the vantage-point trees, of the links between the different fingerprints of ``nodes`` (fp), a stored table."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64)
        edges = leaf_forest(points.view(np.uint64), frame["own"].to_numpy(bool), distance)
        a, b = (np.array(edges, np.int64).reshape(-1, 2)).T
        return pd.DataFrame({"a": points[a], "b": points[b]})

    return sharded(nodes, nodes.count(), distance, sample, leaf).groupBy("leaf").applyInPandas(links, "a long, b long").distinct()


def _linked(every: DataFrame, distance: int, sample: int, leaf: int) -> DataFrame:
    nodes = stored(every.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    edges = tree_links(nodes, distance, sample, leaf)
    joined = stored(connected_components(edges, "a", "b").withColumnsRenamed({"node": "fp", "component": "root"}), "components")
    first = nodes.join(joined, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = joined.join(first, "root").select("fp", "root", "component_id")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), "n")


def joined_by_node(every: DataFrame, named: DataFrame) -> DataFrame:
    """``every`` (.., fp) with the columns of ``named`` (fp, n, ..), a stored table; hot fingerprints meet theirs by broadcast."""
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(named.where(F.col("n") * HOT >= total))  # HOT rows at most
    rest = named.where(F.col("n") * HOT < total)
    return every.join(hot, "fp").unionByName(every.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp")).drop("n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, fingerprint string, component_id) for every row; ``options`` are those of :func:`link`."""
    every = stored(fingerprints(docs, doc_id, text), "fingerprints")
    rows = joined_by_node(every, link(every, **options).select("fp", "component_id", "n"))
    return rows.select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the near copies: one row of each component stays, with all its columns.

    It is the row with the least doc_id (a null one last), of those the one with the least fingerprint, then the one
    whose text has the least XXH64; of rows that are equal in these one stays.
    """
    every = stored(fingerprints(docs, doc_id, text), "fingerprints")
    return _first_rows(docs, every, link(every, **options).select("fp", "root"), fingerprint, doc_id, text)


def _text_hash(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), SEED)


def _first_rows(docs: DataFrame, every: DataFrame, roots: DataFrame, node, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` of each root; ``every`` (doc_id, fp) has the node of each row, ``node`` tells it of a text."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    least = every.groupBy("fp").agg(F.min(order).alias("r"))  # before the join, so that a group of copies is one row in it
    stay = least.join(roots, "fp").groupBy("root").agg(F.min("r").alias("r"))
    names = [fresh(docs.columns, x) for x in ("own_node", "own_hash", "stay_id", "stay_node", "place")]
    own, digest, stay_id, stay_node, place = names
    stay = stored(stay.select(F.col("r.doc_id").alias(stay_id), F.col("r.fp").alias(stay_node)), "representatives")
    told = map_texts(docs, docs.columns, text, f"{own} long, {digest} long", lambda texts: [np.array([f(x) for x in texts], np.uint64).view(np.int64) for f in (node, _text_hash)])
    kept = told.join(stay, (told[own] == stay[stay_node]) & told[quoted(doc_id)].eqNullSafe(stay[stay_id]), "left_semi")
    if not every.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():  # repeated ids: rows are told apart by their texts, then by their place
        kept = stored(kept.withColumn(place, F.monotonically_increasing_id()), "kept")
        first = kept.groupBy(col(doc_id).alias(stay_id), own).agg(F.min(F.struct(digest, place)).alias("r")).select(F.col("r")[place].alias(place))
        kept = kept.join(first, place, "left_semi")
    return kept.select(*map(col, docs.columns))


# Near copies by shingles of five words: SimHashes of them, searched within ``NEAR`` bits, and each link verified on the
# shingles themselves. A ball of six bits reaches most leaves of a tree over all 64, so trees are built over parts of the
# bits, of which fingerprints so near have one in common. At Jaccard 0.8 SimHashes differ in about 10 of 64 bits and in up
# to 18, where nothing prunes, so what the trees leave apart is looked for in banded minima of the shingles, and verified as well.

FIVE, BANDS, ROWS, NEAR = 5, 24, 4, 6
_FACTORS = np.random.default_rng(17).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX32 = np.uint32(0x85EBCA6B)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 32-bit hashes of the shingles of a text's word hashes, sorted; of all its words, if they are fewer than five."""
    size = min(FIVE, len(x))
    out = np.full(len(x) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ x[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(_lowered(word).encode("utf-8", "surrogatepass"), SEED)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The different shingles of five words of each text (of all its words, if they are fewer), with each different word hashed once."""
    codes, begin, words = split_words(texts)
    hashes = np.array([*map(_word_hash, words)], np.uint64)[codes]
    return [_mixed(hashes[a:b]) if b > a else np.zeros(0, np.uint32) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def set_name(own: np.ndarray) -> int:
    """A 64-bit name of a set of shingles; zero if it is empty."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def set_fingerprint(own: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles: a bit is set if it is set in over half of their hashes; zero if it is empty."""
    x = (own.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ x >> np.uint64(32)) * _MIX
    x ^= x >> np.uint64(29)
    ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big")


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` min-hashes; sets of Jaccard 0.8 share none of ``BANDS`` once in 300,000 pairs."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(own), 512):
        part = own[k : k + 512] * _FACTORS[:, None]
        part ^= part >> np.uint32(15)
        part *= _MIX32
        np.minimum(least, part.min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(similarity: float):
    """Rows (a, b, set of a, set of b) to the pairs (a, b) that are similar."""

    def run(batches):
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint32) for x in batch.column(k).to_pylist()] for k in (2, 3))
            fine = pa.array([jaccard(x, y) >= similarity for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(fine) for c in batch.columns[:2]], names=["a", "b"])

    return run


def bucket_forest(frame: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links between components of a bucket: of rows (fp, root, probe, set) each probe is held against all that are none.

    Only links that join two components are told, so there are fewer of them than components.
    """
    base, probes = frame[~frame["probe"]], frame[frame["probe"]]
    if not len(base):
        return []
    sets = [np.frombuffer(x, np.uint32) for x in base["set"]]
    sizes = np.array([*map(len, sets)])
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    flags = np.zeros(len(known), np.int32)
    fps, group = base["fp"].to_numpy(), base["root"].to_numpy().copy()
    at_home = {int(f): k for k, f in enumerate(fps)}
    other = {int(r): int(r) for r in probes["root"]}  # the component of a probe, where its root is not in the base
    out = []
    for fp, root, raw in zip(probes["fp"].tolist(), probes["root"].tolist(), probes["set"]):
        own = int(group[at_home[fp]]) if fp in at_home else other[root]
        if not (group != own).any():
            continue
        x = np.frombuffer(raw, np.uint32)
        at = np.searchsorted(known, x)
        at = at[known[np.minimum(at, len(known) - 1)] == x] if len(known) else at
        flags[at] = 1
        both = np.add.reduceat(flags[codes], begin)
        flags[at] = 0
        for k in np.flatnonzero((both / (len(x) + sizes - both) >= similarity) & (group != own)).tolist():
            gone = int(group[k])
            if gone != own:
                out.append((fp, int(fps[k])))
                group[group == gone] = own
                other = {r: own if g == gone else g for r, g in other.items()}
    return out


#: Nodes of a bucket that are held against each other in one task.
BUCKET = 2048


def bit_parts(bits: np.uint64, parts: int) -> list[np.uint64]:
    """The set bits of a mask, dealt to ``parts`` masks of nearly equal size, runs of neighbouring bits."""
    places = [k for k in range(64) if int(bits) >> k & 1]
    cuts = [len(places) * k // parts for k in range(parts + 1)]
    return [np.uint64(sum(1 << k for k in places[a:b])) for a, b in zip(cuts, cuts[1:])]


def equal_groups(keys: np.ndarray) -> list[np.ndarray]:
    """The places of equal keys, for each key that is there twice or more."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [x for x in np.split(order, cuts) if len(x) > 1]


def part_forest(points: np.ndarray, part: np.uint64, distance: int, block: int = 1024) -> list[tuple[int, int]]:
    """Spanning forest of the links, within ``distance``, between points whose bits of the mask ``part`` are equal.

    Groups of more than ``block`` equal ones are cut again by ``distance`` + 1 parts of their other bits, of which linked
    points have one in common; unless a part would leave over half of a group together, as in groups of near copies.
    """
    label, members, edges = np.arange(len(points)), {}, []
    stack = [(at, ~part) for at in equal_groups(points & part)]
    while stack:
        at, free = stack.pop()
        if len(at) > block and int(free).bit_count() > distance:
            cut = [(at[g], free & ~mask) for mask in bit_parts(free, distance + 1) for g in equal_groups(points[at] & mask)]
            if all(2 * len(g) <= len(at) for g, _ in cut):
                stack += cut
                continue
        own = points[at]
        for k in range(0, len(at), 64):
            i, j = np.nonzero(np.bitwise_count(own[k : k + 64, None] ^ own[k:]) <= distance)
            one, two = at[k:][i], at[k:][j]
            new = (i < j) & (label[one] != label[two])
            for a, b in zip(one[new].tolist(), two[new].tolist()):
                x, y = int(label[a]), int(label[b])
                if x != y:
                    edges.append((a, b))
                    few, many = sorted((members.pop(x, [x]), members.pop(y, [y])), key=len)
                    label[few] = label[many[0]]
                    members[int(label[many[0]])] = many
                    many += few
    return edges


def part_links(nodes: DataFrame, distance: int = NEAR, sample: int = 32_768, leaf: int = 16_384) -> DataFrame:
    """(a, b): forests of the links between the different fingerprints of ``nodes`` (fp), for radii at which no tree over all bits prunes.

    Of ``distance`` + 1 parts of the bits, linked fingerprints have one in common. Each part has a vantage-point tree over
    the fingerprints' bits in it, fitted on about ``sample`` of them, in which a ball has radius zero; so a fingerprint
    goes to one leaf a part, and rows are in proportion to ``nodes``. Leaves have about ``leaf`` fingerprints, or more
    that are equal in the part. No link is lost; forests of several leaves may tell one.
    """
    count = nodes.count()
    few = about(nodes.select("fp"), sample, count).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = bit_parts(~np.uint64(0), distance + 1)
    trees = [fit_tree(few & part, max(1, -(-count // leaf)), 0, 1) for part in parts]

    def deal(frames):
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for k, (part, tree) in enumerate(zip(parts, trees)):
                at, where, _ = route(tree, points & part, np.ones(len(points), bool), 0)
                yield pd.DataFrame({"part": k, "leaf": where, "fp": points[at].view(np.int64)})

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64)
        edges = part_forest(points.view(np.uint64), parts[int(frame["part"].iloc[0])], distance)
        a, b = points[np.array(edges, np.int64).reshape(-1, 2)].T
        return pd.DataFrame({"a": a, "b": b})

    rows = nodes.select("fp").mapInPandas(deal, "part int, leaf long, fp long")
    return rows.groupBy("part", "leaf").applyInPandas(links, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(nodes: DataFrame, distance: int = NEAR, **options) -> DataFrame:
    """(a, b): candidates among ``nodes`` (fp, print): those of one SimHash with the least of them, and the least ones of SimHashes that :func:`part_links` links."""
    prints = stored(nodes.groupBy("print").agg(F.min("fp").alias("r")), "prints")
    alike = nodes.join(prints, "print").where("fp <> r").select(F.col("r").alias("a"), F.col("fp").alias("b"))
    edges = part_links(prints.select(F.col("print").alias("fp")), distance, **options)
    one, two = (prints.select(F.col("print").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
    return alike.unionByName(edges.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def _roots(edges: DataFrame) -> DataFrame:
    """(fp, root) of the edges (a, b), a stored table."""
    return stored(connected_components(edges, "a", "b").withColumnsRenamed({"node": "fp", "component": "root"}), "components")


def similar_roots(nodes: DataFrame, sets_of, similarity: float, bucket: int = BUCKET, **options) -> DataFrame:
    """(fp, root) for each of ``nodes`` (fp, print, keys): components of the pairs that have ``similarity`` or more.

    ``sets_of`` gives the sets (fp, set binary) of a table of fp. Verified on the sets are first the links of the
    vantage-point trees over the SimHashes ``print``, see :func:`near_pairs`, and, of the pairs that share a key, those of
    each node with the least of its buckets. Then, in buckets that still hold several components, each node outside the
    largest is held against all others, ``bucket`` by ``bucket`` nodes in a task. So no pair of a bucket that could join
    two components is left out; but what is shuffled are nodes, once for each such block, and what comes out are the
    links of a forest, whose components are found over those of the first links.
    """
    near = stored(near_pairs(nodes.select("fp", "print"), **options), "near")
    buckets = nodes.select("fp", F.explode("keys").alias("key"))
    least = buckets.groupBy("key").agg(F.min("fp").alias("r"), F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.join(least, "key"), "buckets")
    wanted = shared.select("fp").union(near.select("a")).union(near.select("b")).distinct()
    sets = stored(sets_of(wanted), "sets")
    one, two = sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("set").alias("sb"))
    pairs = near.union(shared.where("fp <> r").select("r", "fp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = _roots(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(similarity), "a long, b long"))
    parts = shared.join(joined, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    sizes = parts.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "root")).alias("most"))
    mixed = stored(parts.join(sizes.where("parts > 1").select("key", "most"), "key").select("key", "fp", "root", "n", (F.col("n") - F.col("most.m")).alias("outside"), (F.col("root") != F.col("most.root")).alias("out")), "mixed")
    blocks = lambda n: F.ceil(F.col(n) / bucket).cast("int")
    own = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    base = mixed.select("key", "fp", "root", F.lit(False).alias("probe"), every("outside").alias("j"), own("n").alias("i"))
    probes = mixed.where("out").select("key", "fp", "root", F.lit(True).alias("probe"), own("outside").alias("j"), every("n").alias("i"))

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        root = dict(zip(frame["fp"].tolist(), frame["root"].tolist()))
        a, b = np.array([(root[x], root[y]) for x, y in bucket_forest(frame, similarity)], np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": a, "b": b})

    across = base.unionByName(probes).join(sets, "fp").groupBy("key", "j", "i").applyInPandas(links, "a long, b long").distinct()
    above = _roots(across).select(F.col("fp").alias("root"), F.col("root").alias("top"))
    found = nodes.select("fp").join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return found.join(above, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


#: Keys that are broadcast to pick rows by them; of more, the rows are joined.
PICKED = 1_000_000


def picked(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` whose key is in ``keys``, a stored table (how: left_semi), or is not (left_anti)."""
    few = keys.count() <= PICKED
    return rows.join(F.broadcast(keys) if few else keys, key, how)


def keep_dissimilar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component of texts whose shingles of five words have Jaccard ``similarity`` or more.

    The row that stays is told as in :func:`keep_first`. Texts without words are one component.
    """
    names = [fresh(docs.columns, x) for x in ("node", "digest", "print", "keys", "place")]
    node, digest, print_, keys, place = names

    def sketch(texts: pa.Array) -> list:
        sets = shingle_sets(texts)
        hashes = [np.array(x, np.uint64).view(np.int64) for x in ([*map(set_name, sets)], [*map(_text_hash, texts.to_pylist())], [*map(set_fingerprint, sets)])]
        return [*hashes, [band_keys(x) if len(x) else [] for x in sets]]

    rows = map_blocks(docs, docs.columns, text, f"{node} long, {digest} long, {print_} long, {keys} array<long>", lambda: sketch)
    rows = stored(rows.withColumn(place, F.monotonically_increasing_id()), "sketches")
    order = F.struct(col(doc_id).isNull().alias("no_id"), col(doc_id).alias("doc_id"), F.col(digest).alias("digest"), F.col(place).alias("place"))

    def representatives() -> DataFrame:
        nodes = stored(rows.groupBy(F.col(node).alias("fp")).agg(F.min(order).alias("first"), F.first(print_).alias("print"), F.first(keys).alias("keys")), "nodes")

        def sets_of(wanted: DataFrame) -> DataFrame:
            places = stored(nodes.join(wanted, "fp").select(F.col("first.place").alias(place)), "wanted")
            texts = picked(rows.select(F.col(node).alias("fp"), place, col(text).alias("text")), places, place, "left_semi")
            return map_blocks(texts, ["fp"], "text", "set binary", lambda: lambda texts: [[x.tobytes() for x in shingle_sets(texts)]])

        roots = similar_roots(nodes.select("fp", "print", "keys"), sets_of, similarity, bucket)
        return nodes.select("fp", "first").join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.place").alias(place))

    stay = stored_from(docs.sparkSession, representatives, "representatives")
    gone = stored(rows.select(place).join(stay, place, "left_anti"), "gone")
    kept = picked(rows, gone, place, "left_anti") if gone.count() <= PICKED else picked(rows, stay, place, "left_semi")
    return kept.select(*map(col, docs.columns))
