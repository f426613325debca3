"""Exact n-gram Jaccard self-join by signature trees.

Every text is the set of its distinct word shingles.  Equal sets are one node.  Two
sets with a Jaccard similarity of t share one of the first ``n - ceil(t n) + 1``
shingles in any common order, which puts shingles that are frequent in prefixes last.
The sets that share a prefix shingle go to the group of the least id among them; as
similar sets share many shingles with the same least id, a set is in few groups.

Inside a group a signature tree finds the candidates: leaves are sets, with a
bitmap of hashed shingles and their number; an inner node holds the OR of its
children's bitmaps and the range of their sizes.  Two trees are traversed together,
and a pair of nodes is left as soon as the greatest overlap that its bitmaps and
sizes allow is too small, or if all its sets are in one component already.
Candidates are then compared set by set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, doc_out, hot_keys, id_and_text, join_counted, partitions, release, ship, written
from factloom.llm.components import components
from factloom.llm.textvec import buffers, mix, shingle_sets, slices

MIN_BITS = 64
#: A group up to this size is one leaf; all of its pairs are looked at, without a tree.
LEAF = 16
#: A group up to this size gives all of its candidates in the first round.
FEW = 4
#: Sets in one block of a larger group.
GROUP = 512
#: A shingle in more prefixes than this is put last in the order; at most this many shingles are (a broadcast of 32 MB).
FREQUENT = 100
FREQUENT_KEPT = 1 << 22
#: The filter on ids whose sets are computed again for the comparison has 8 bits for each id, up to this many (32 MB); for
#: more ids the texts are joined to them instead.
FILTER_BITS_MOST = 1 << 28


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per hashed shingle; twice as many bits as shingles, rounded up to a power of two, however many there are."""
    bits = MIN_BITS
    while bits < 2 * len(hashes):
        bits *= 2
    out = np.zeros(bits, dtype=bool)
    out[((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of half, a quarter, ... the width."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def overlap_possible(size_a, size_b, only_a, only_b, percent: int):
    """Whether sets may reach the similarity if so many bits are set in the one bitmap alone.

    Each such bit stands for at least one shingle that the other set lacks.
    """
    overlap = np.minimum(size_a - only_a, size_b - only_b)
    return (100 + percent) * overlap >= percent * (size_a + size_b)


class Sets:
    """Sizes, labels and bitmaps of some sets; bitmaps of one width are rows of one array."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, bitmaps: list[bytes]):
        self.sizes, self.labels = sizes.astype(np.int64), labels
        self.words = np.fromiter((len(b) // 8 for b in bitmaps), dtype=np.int64, count=len(bitmaps))
        self.row = np.zeros(len(bitmaps), dtype=np.int64)
        self.by_width: dict[int, np.ndarray] = {}
        for w in np.unique(self.words):
            at = np.flatnonzero(self.words == w)
            self.row[at] = np.arange(len(at))
            self.by_width[int(w)] = np.frombuffer(b"".join([bitmaps[i] for i in at]), dtype="<u8").reshape(len(at), int(w))

    def similar(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs may be similar, by sizes first and bitmaps then."""
        sa, sb = self.sizes[a], self.sizes[b]
        out = 100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)
        at = np.flatnonzero(out)
        code = (self.words[a[at]] << 32) + self.words[b[at]]
        for c in np.unique(code):
            here = at[code == c]
            wa, wb = int(c) >> 32, int(c) & 0xFFFFFFFF
            w = min(wa, wb)
            step = max(1, (1 << 22) // max(wa, wb))
            for lo in range(0, len(here), step):
                part = here[lo : lo + step]
                x = fold(self.by_width[wa][self.row[a[part]]], w)
                y = fold(self.by_width[wb][self.row[b[part]]], w)
                only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
                out[part] = overlap_possible(self.sizes[a[part]], self.sizes[b[part]], only_x, only_y, percent)
        return out


class SignatureTree:
    """A tree over sets whose bitmaps have one width; level 0 are the sets, in the order of their sizes."""

    FANOUT = 8

    def __init__(self, sets: Sets, members: np.ndarray, words: int):
        sizes = sets.sizes[members]
        bitmaps = fold(sets.by_width[int(sets.words[members[0]])][sets.row[members]], words)
        order = np.lexsort((*bitmaps.T[: min(4, words)], sizes))
        self.members = members[order]
        labels = sets.labels[self.members]
        level = (bitmaps[order], sizes[order], sizes[order], labels, labels)
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), self.FANOUT)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.minimum.reduceat(level[3], at), np.maximum.reduceat(level[4], at))
            self.levels.append(level)


def dual_traversal(one: SignatureTree, other: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (of ``one``, of ``other``) that no bound excludes; pairs of one label are excluded."""
    depth_a, depth_b = len(one.levels) - 1, len(other.levels) - 1
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        bits_a, low_a, high_a, label_a, label_top_a = (x[a] for x in one.levels[depth_a])
        bits_b, low_b, high_b, label_b, label_top_b = (x[b] for x in other.levels[depth_b])
        keep = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
        keep &= ~((label_a == label_top_a) & (label_b == label_top_b) & (label_a == label_b))
        # An OR may have bits that one child lacks, so only a node of one set tells what the other side lacks.
        if depth_a == 0:
            only = np.bitwise_count(bits_a & ~bits_b).sum(axis=1, dtype=np.int64)
            keep &= (100 + percent) * (low_a - only) >= percent * (low_a + np.maximum(low_b, (percent * low_a + 99) // 100))
        if depth_b == 0:
            only = np.bitwise_count(bits_b & ~bits_a).sum(axis=1, dtype=np.int64)
            keep &= (100 + percent) * (low_b - only) >= percent * (low_b + np.maximum(low_a, (percent * low_b + 99) // 100))
        shared = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
        keep &= shared > 0
        a, b = a[keep], b[keep]
        if depth_a == depth_b == 0 or not len(a):
            return one.members[a], other.members[b]
        if depth_a >= depth_b:
            a, b = _children(a, len(one.levels[depth_a - 1][1])), np.repeat(b, SignatureTree.FANOUT)
            depth_a -= 1
            a, b = a[a >= 0], b[a >= 0]
        else:
            b, a = _children(b, len(other.levels[depth_b - 1][1])), np.repeat(a, SignatureTree.FANOUT)
            depth_b -= 1
            a, b = a[b >= 0], b[b >= 0]


def _children(nodes: np.ndarray, n: int) -> np.ndarray:
    """The children of each node, -1 beyond the last."""
    out = (nodes[:, None] * SignatureTree.FANOUT + np.arange(SignatureTree.FANOUT)).reshape(-1)
    out[out >= n] = -1
    return out


def tree_candidates(sets: Sets, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs between ``left`` and ``right`` (or within, if they are the same)."""
    out_a, out_b = [], []
    for wa in np.unique(sets.words[left]):
        for wb in np.unique(sets.words[right]):
            if max(wa, wb) > 2 * min(wa, wb):  # sizes differ by more than the similarity allows
                continue
            w = int(min(wa, wb))
            one = SignatureTree(sets, left[sets.words[left] == wa], w)
            other = SignatureTree(sets, right[sets.words[right] == wb], w)
            a, b = dual_traversal(one, other, percent)
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return a[a != b], b[a != b]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs that join two trees of what came before."""
    parent = list(range(n))
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.asarray(keep, dtype=np.int64)


_NODE = "doc_id long, n_shingles long, d1 long, d2 long, bitmap binary, prefix array<long>"
_GROUPED = "key long, side int, id long, n long, label long, bitmap binary"


def set_nodes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Size, digest, bitmap and prefix (in the order of hashes) of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import jaccard as j

        for batch in batches:
            data, offsets = j.buffers(batch.column(1))
            for lo, hi in j.slices(offsets):
                values, edges = j.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                n = np.diff(edges)
                sizes = np.array([min(j.prefix_size(int(x), percent), int(x)) for x in n], dtype=np.int64)
                take = np.repeat(edges[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values[take].view(np.int64)))
                with np.errstate(over="ignore"):
                    sums = [np.r_[np.uint64(0), np.cumsum(j.mix(values ^ np.uint64(s)), dtype=np.uint64)] for s in (0x1234567, 0x89ABCDEF01)]
                    d1, d2 = (pa.array((s[edges[1:]] - s[edges[:-1]]).view(np.int64)) for s in sums)
                maps = pa.array([j.bitmap(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), d1, d2, maps, prefix], ["doc_id", "n_shingles", "d1", "d2", "bitmap", "prefix"])

    return texts.mapInArrow(run, _NODE)


def prefixes(texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, prefix) of every text that has words, in the order that puts frequent shingles last.

    Shingles count as frequent by how many prefixes they are in over the whole
    corpus.  Only texts with such a shingle in their prefix are hashed once more.
    """
    spark = texts.sparkSession
    counts = nodes.select(F.explode("prefix").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
    top = counts.orderBy(F.desc("n"), "sig").limit(FREQUENT_KEPT).select("sig").toArrow().column(0).to_numpy()
    del counts  # or its shuffle files would stay
    release(spark)
    known = spark.sparkContext.broadcast(np.sort(np.ascontiguousarray(top, dtype=np.int64).view(np.uint64)))

    def lists(sigs, sizes):
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(sigs))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1)
            values = prefix.flatten().to_numpy(zero_copy_only=False)
            sizes = prefix.value_lengths().to_numpy(zero_copy_only=False)
            hit = np.zeros(len(sizes), dtype=bool)
            hit[np.repeat(np.arange(len(sizes)), sizes)[np.isin(values.view(np.uint64), known.value)]] = True
            yield batch.filter(pa.array(~hit & (sizes > 0)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import jaccard as j

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = j.buffers(batch.column(1))
            for lo, hi in j.slices(offsets):
                values, edges = j.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                late = np.isin(values, known.value)
                sigs, owners = [], []
                for r in np.unique(np.searchsorted(edges, np.flatnonzero(late), side="right") - 1):
                    x, f = values[edges[r] : edges[r + 1]], late[edges[r] : edges[r + 1]]
                    size = j.prefix_size(len(x), percent)
                    if f[:size].any():
                        sigs.append(np.concatenate((x[~f], x[f]))[:size].view(np.int64))
                        owners.append(ids[lo + r])
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), lists(np.concatenate(sigs), [len(x) for x in sigs])], ["id", "prefix"])

    rows = nodes.select(F.col("doc_id").alias("id"), "prefix").mapInArrow(plain, "id long, prefix array<long>")
    if not len(top):
        return rows
    return rows.unionByName(texts.mapInArrow(again, "id long, prefix array<long>"))


def _pairs(percent: int, across: bool):
    """Candidates (a, b) of groups whose rows come together: within side 0, or across sides 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import jaccard as j

        def search(rows: list[pa.RecordBatch]):
            t = pa.Table.from_batches(rows).combine_chunks()
            key, side, ids, n, label = (t.column(i).to_numpy() for i in range(5))
            sets = j.Sets(n, label, t.column(5).to_pylist())
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            sizes = np.diff(edges)
            out_a, out_b = [], []
            if across:
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    at = np.arange(lo, hi)
                    a, b = j.tree_candidates(sets, at[side[lo:hi] == 0], at[side[lo:hi] == 1], percent)
                    out_a.append(a)
                    out_b.append(b)
            else:
                for m in np.unique(sizes[(sizes > 1) & (sizes <= j.LEAF)]):
                    first = edges[:-1][sizes == m]
                    i, k = np.triu_indices(int(m), 1)
                    out_a.append((first[:, None] + i).reshape(-1))
                    out_b.append((first[:, None] + k).reshape(-1))
                if out_a:
                    a, b = np.concatenate(out_a), np.concatenate(out_b)
                    ok = sets.similar(a, b, percent)
                    a, b = a[ok], b[ok]
                    few = np.repeat(sizes, sizes)[a] <= j.FEW
                    many = np.flatnonzero(~few)
                    keep = np.concatenate((np.flatnonzero(few), many[j.forest(a[many], b[many], len(ids))]))  # groups have no row in common
                    out_a, out_b = [a[keep]], [b[keep]]
                for lo, hi in zip(edges[:-1][sizes > j.LEAF], edges[1:][sizes > j.LEAF], strict=True):
                    at = np.arange(lo, hi)
                    a, b = j.tree_candidates(sets, at, at, percent)
                    order = np.lexsort((ids[b], ids[a]))
                    a, b = a[order], b[order]
                    keep = j.forest(a - lo, b - lo, int(hi - lo))
                    out_a.append(a[keep])
                    out_b.append(b[keep])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
            pair = np.unique(np.stack((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])), axis=1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch.column(0)[-1].as_py()
            cut = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), last, side="left"))
            if cut:
                yield search([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != last:
                yield search(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield search(held)

    return run


def _candidates(grouped: DataFrame, percent: int, across: bool) -> DataFrame:
    n = partitions(grouped.sparkSession)
    together = grouped.repartition(n, "key").sortWithinPartitions("key")
    return together.mapInArrow(_pairs(percent, across), "a long, b long").distinct()


def verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that reach the similarity, comparing their whole sets.

    Sets are computed again for the ids in ``pairs`` only.  A filter of 8 bits an id, on
    hashed ids, goes to the tasks that read the texts, up to FILTER_BITS_MOST; for more
    ids the texts are joined to them.  The join of sets and pairs is exact either way.
    """
    spark = texts.sparkSession
    ids = written(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    bits = 1 << max(10, (8 * ids.count()).bit_length())
    filtered = bits <= FILTER_BITS_MOST
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    if filtered:
        mask = np.zeros(bits, dtype=bool)
        for part in ids.select(slot("id").alias("slot")).distinct().toArrow().column("slot").chunks:
            mask[part.to_numpy(zero_copy_only=False)] = True
        wanted = spark.sparkContext.broadcast(np.packbits(mask))
        source = texts.select("doc_id", "text", slot("doc_id").alias("slot"))
    else:
        wanted = None
        source = texts.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text", F.lit(0).cast("long").alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import jaccard as j

        for batch in batches:
            part = batch
            if wanted is not None:
                slots = batch.column(2).to_numpy(zero_copy_only=False)
                part = batch.take(pa.array(np.flatnonzero((wanted.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1)))
            if not len(part):
                continue
            data, offsets = j.buffers(part.column(1))
            for lo, hi in j.slices(offsets):
                values, edges = j.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), lists], ["id", "shingles"])

    sets = written(spark, source.mapInArrow(run, "id long, shingles array<long>"), "sets")
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    second = first.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    similar = second.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()
    similar = written(spark, similar, "similar")
    discard(sets, ids)
    return similar


def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, id) of every row (sig, id) whose sig has another row; rows come sorted, so the first id of a sig is the least.

    Only the last sig, its first id and whether that one was given stay in memory.
    """
    last, first, alone = None, 0, False
    for batch in batches:
        if not len(batch):
            continue
        sig, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.r_[sig[0] != last if last is not None else True, sig[1:] != sig[:-1]]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        heads = ids[begin] if len(begin) else np.zeros(0, np.int64)
        hub = np.where(group >= 0, heads[np.maximum(group, 0)] if len(heads) else first, first)
        rest = ~new
        out_hub, out_id = hub[rest], ids[rest]
        follows = np.flatnonzero(np.r_[rest[1:], False] & new)  # heads with a second row in this batch
        out_hub, out_id = np.concatenate((out_hub, ids[follows])), np.concatenate((out_id, ids[follows]))
        if rest[0] and alone:
            out_hub, out_id = np.append(out_hub, first), np.append(out_id, first)
        alone = bool(new[-1]) if len(begin) else (alone and not rest[0])
        if len(begin):
            first = int(heads[-1])
        last = sig[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_hub, pa.int64()), pa.array(out_id, pa.int64())], ["hub", "id"])


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by
    links, itself included.  Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z to lower case.

    Two rounds.  The first deals groups of more than GROUP sets into blocks, each with
    the group's first set; a block yields a forest of its candidates at most, whose
    similar pairs give components.  The second takes the groups that still hold several
    components, and traverses the trees of all their sets with those of the sets outside
    the component of the group's first.
    No link between different components is lost, and no copies are paired.

    A null or empty text has no shingles and links with nothing, also not with another
    one.  Rows with one id count as one document.  Null ids are one id that sorts
    first, and come back as null.  No documents: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = id_and_text(docs)
    every = written(spark, set_nodes(texts, k, percent), "sets-of-texts")
    total = every.count()
    keys = ["d1", "d2", "n_shingles"]
    classes = written(spark, every.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    members = join_counted(every.select("doc_id", *keys), classes, keys, "copies", total, "left") if total else every.select("doc_id", *keys, F.col("doc_id").alias("rep"))
    members = written(spark, members.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = members.where("doc_id = rep and n_shingles > 0").select(F.col("doc_id").alias("id")).distinct()

    # Everything that shares a shingle of a prefix with the least id among those that do.  A class's first document is in
    # each group of its copies: those of large classes leave at once, the others with the join that is needed anyway.
    hot = F.broadcast(classes.where(hot_keys(classes, "copies", total)).select(*keys, "rep"))
    nodes = every.join(hot, keys, "left").where("rep is null or rep = doc_id").drop("rep")
    dealt = prefixes(texts, nodes, k, percent).select(F.explode("prefix").alias("sig"), "id").repartition(partitions(spark), "sig").sortWithinPartitions("sig", "id")
    rows = dealt.mapInArrow(hubs, "hub long, id long").distinct().join(reps, "id", "left_semi")
    first_rows = written(spark, rows.join(every.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")).distinct(), "id"), "groups")
    release(spark)

    # A set stays in a group only if the group has another one whose size allows the similarity.
    step = 1.001 * math.log(100 / percent) if percent < 100 else 1.0
    sized = first_rows.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    n_rows = first_rows.count()
    near = sized.groupBy("hub", "size").agg(F.count("*").alias("m")).select("hub", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)).alias("size"), "m").groupBy("hub", "size").agg(F.sum("m").alias("m")).where("m > 1")
    rows = written(spark, join_counted(sized, near, ["hub", "size"], "m", n_rows, "left_semi").select("hub", "id"), "groups")
    groups = written(spark, rows.groupBy("hub").agg(F.count("*").alias("m"), F.min("id").alias("first")).where("m > 1").select(F.col("hub").alias("group_id"), F.col("first").alias("hub"), "m"), "groups")
    rows = written(spark, join_counted(rows.select(F.col("hub").alias("group_id"), "id"), groups, ["group_id"], "m", n_rows).select("group_id", "hub", "id", "m"), "groups")
    described = every.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bitmap").join(rows.select("id").distinct(), "id", "left_semi")
    described = written(spark, described, "bitmaps")
    discard(every, first_rows)
    release(spark)

    blocks = F.ceil(F.col("m") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    block = F.explode(F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("block")
    grouped = rows.select("group_id", "id", block).select(F.xxhash64("group_id", "block").alias("key"), F.lit(0).alias("side"), "id").join(described, "id").select("key", "side", "id", "n", F.col("id").alias("label"), "bitmap")
    pairs = written(spark, _candidates(grouped, percent, across=False), "candidates")
    links = verified(texts, pairs, k, percent)
    roots = components(links)
    release(spark)

    # Of each group the sets outside the component of its first.
    heads = groups.where(F.col("m") > min(FEW, GROUP)).join(roots.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").select("group_id", "m", F.coalesce("hub_root", "hub").alias("hub_root"))
    label = rows.where(F.col("m") > min(FEW, GROUP)).join(roots, "id", "left").select("group_id", "id", F.coalesce("root", "id").alias("label"))
    label = written(spark, join_counted(label, heads, ["group_id"], "m", n_rows).select("group_id", "id", "label", "m", (F.col("label") != F.col("hub_root")).alias("outside")), "labels")
    mixed = label.groupBy("group_id").agg(F.first("m").alias("m"), F.sum(F.col("outside").cast("long")).alias("o")).where("o > 0")
    split = join_counted(label.drop("m"), mixed, ["group_id"], "m", n_rows).withColumn("rows", F.ceil(F.col("m") / GROUP).cast("int")).withColumn("columns", F.ceil(F.col("o") / GROUP).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    whole = split.select("group_id", "id", "label", place("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(0).alias("side"))
    rest = split.where("outside").select("group_id", "id", "label", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), place("columns").alias("j"), F.lit(1).alias("side"))
    crossed = whole.unionByName(rest).select(F.xxhash64("group_id", "i", "j").alias("key"), "side", "id", "label").join(described, "id").select("key", "side", "id", "n", "label", "bitmap")
    more = written(spark, _candidates(crossed, percent, across=True).join(pairs, ["a", "b"], "left_anti"), "candidates")
    if more.isEmpty():
        all_roots = roots
    else:
        all_roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found := verified(texts, more, k, percent)))
        discard(found)
    discard(rows, groups, classes, described, pairs, links, label, more)
    release(spark)
    reached = all_roots.select(F.col("id").alias("rep"), "root")
    out = members.join(reached, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.select(doc_out(), "n_shingles", doc_out("component_id"))
