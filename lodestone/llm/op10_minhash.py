"""Near-dedup by a containment ensemble of MinHash indexes, and an exact index for what it misses.

Two documents are near copies if the smaller one's set of word 5-grams lies in the larger one's to
`containment` or more, and the larger has at most `ratio` times as many. Groups are the connected components. A document that lies in one
of more than `ratio` times its size to `containment` or more is held by it. That has a direction and joins no groups: else all texts that share
a short passage would be one group through it. Of those that hold a document the largest is named.

1. Documents with the very same set collapse into the one of lowest id.
2. The rest are partitioned by set size, in powers of `ratio`, so that near copies lie in the same or the next
   partition. For a query of at least q shingles and a partition of at most u, containment t is a Jaccard index of
   t / (u / q + 1 - t) or more. `tune` turns each such bound into its own bands and rows. A document
   enters the index of its partition and of the pair with the next one, and queries the next. Each bucket's members are checked
   against one of them. This finds most groups at little cost, but no bands find every pair.
3. `shared` counts in how many rows each shingle stands. A document of n shingles can lie in another only if t n of
   them stand elsewhere too, and then one of its rarest r - t n + 1 of those r is among the other's. By these probes documents meet
   all others, of whatever size. Left out are pairs within one group, which would change nothing, so groups of copies cost only their size.
   The largest document of a probe's list is tried first as the one that holds it; the others only if that fails.
4. Every pair is checked by intersecting the sets. So the result is that of comparing all pairs, but for shingles being 40-bit hashes.

Defined results: words are runs without ASCII white space, ASCII letters without case; a text of
fewer than 5 words is one shingle; one without words (null, empty) or without an id is no copy of anything;
rows that share an id are one document, whose sets are all compared; ties go to the lowest id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.names import col
from lodestone.llm.scratch import Scratch

SHINGLE, CONTAINMENT, RATIO, PERMUTATIONS, RECALL = 5, 0.6, 1.5, 64, 0.9
#: Of a shingle's 40 bits, those that stay within one of the buckets that count them; characters of text that are sorted together.
LOW, BUCKETS, SORTED = 29, 1 << 11, 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tune(jaccard: float, permutations: int = PERMUTATIONS, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the most rows, then the fewest bands, that find pairs of this index with `recall`."""
    for rows in range(8, 0, -1):
        chance = min(jaccard, 1 - 1e-9) ** rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
        if bands * rows <= permutations:
            return bands, rows
    return permutations, 1


def bounds(ratio: float, largest: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the partitions; the last is beyond any set."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return np.array(out)


def index_threshold(p: int, step: int, edges: np.ndarray, containment: float, ratio: float) -> float:
    """The least Jaccard index of a pair to find between a query of partition p - step and partition p."""
    u, q = int(edges[p + 1]) - 1, int(edges[p - step])
    return containment / (min(u / q, ratio) + 1 - containment)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each of up to 2**24 texts as 40-bit hashes, ascending within it, and where each text's begin."""
    start, end, first = A.words(data, off)
    h = A.word_hashes(_LOWER[data], start, end)
    n = np.diff(first)
    up, down = A.powers(len(h) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = A.ragged(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    x = A.span_hash(prefix, at, np.minimum(at + size, first[1:][doc]))
    # 24 bits for the text and 40 of the hash: the same for a shingle wherever it stands
    low = np.uint64(40)
    key = np.sort((doc.astype(np.uint64) << low) | (x >> np.uint64(24)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    owner = (key >> low).astype(np.int64)
    return key & ((np.uint64(1) << low) - np.uint64(1)), np.searchsorted(owner, np.arange(len(n) + 1))


def set_hashes(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole set (texts without shingles aren't allowed)."""
    return np.add.reduceat(A.mix(x), first[:-1]).view(np.int64)


def signatures(x: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """MinHash values (a row for each text; texts without shingles aren't allowed)."""
    rng = np.random.default_rng(20)
    flip = rng.integers(0, 1 << 32, permutations, np.uint64).astype(np.uint32)
    times = (rng.integers(0, 1 << 32, permutations, np.uint64) | np.uint64(1)).astype(np.uint32)
    v = A.mix(x).astype(np.uint32)
    out = np.empty((len(first) - 1, permutations), np.uint32)
    for k in range(permutations):
        out[:, k] = np.minimum.reduceat((v ^ flip[k]) * times[k], first[:-1])
    return out


def _band_keys(sig: np.ndarray, p: int, step: int, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands of one index (a row for each text)."""
    h = np.full((len(sig), bands), np.uint64((p * 2 + step + 1) * int(A.BASE) & (1 << 64) - 1), np.uint64)
    h += A.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        h = A.mix(h + sig[:, r : bands * rows : rows].astype(np.uint64))
    return h


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, containment: float, ratio: float, permutations: int) -> DataFrame:
    """doc_id, n, set (a hash of the whole set), and keys by role: both, small, large."""
    edges = bounds(ratio)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        for i, j in A.chunks(off):
            x, first = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
            n = np.diff(first)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            n, begin = n[some], np.append(first[:-1][some], first[-1])
            sig = signatures(x, begin, permutations)
            part = np.searchsorted(edges, n, "right") - 1
            keys: list[list] = [[None] * len(some) for _ in range(3)]
            for p in np.unique(part).tolist():
                here = np.flatnonzero(part == p)
                for role, at, step in ((0, p, 0), (1, p + 1, 1), (2, p, 1)):
                    if at - step < 0:
                        found = np.zeros((len(here), 0), np.uint64)
                    else:
                        found = _band_keys(sig[here], at, step, *tune(index_threshold(at, step, edges, containment, ratio), permutations))
                    for k, row in zip(here.tolist(), found.view(np.int64)):
                        keys[role][k] = row
            whole = set_hashes(x, begin)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n), pa.array(whole), *(pa.array(k, pa.list_(pa.int64())) for k in keys)],
                ["doc_id", "n", "set", "both", "small", "large"],
            )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return A.map_batches(rows, run, "doc_id long, n long, set long, both array<long>, small array<long>, large array<long>")


def _packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def shared(docs: DataFrame, id_col: str, text_col: str, size: int, containment: float) -> DataFrame:
    """doc_id, n, set, items (those of its shingles that stand in other rows too, ascending) and probes, for rows with any.

    Each batch's shingles are sorted and cut into buckets, each bucket of all batches is counted, and what is repeated goes back to its batch.
    """

    def spread(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        for i, j in ((k, min(k + (1 << 16), j)) for i, j in A.chunks(off, SORTED) for k in range(i, j, 1 << 16)):
            part = off[i : j + 1] - off[i]
            parts = [shingles(data[off[i + k] : off[i + e]], part[k : e + 1] - part[k], size) for k, e in A.chunks(part)]
            x, n = np.concatenate([v for v, _ in parts]), np.concatenate([np.diff(v) for _, v in parts])
            first = np.append(0, np.cumsum(n))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            ids = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)[some]
            n, begin = n[some], np.append(first[:-1][some], first[-1])
            whole = set_hashes(x, begin)
            # of the contents, so that a task that runs again gives the same name
            place = A.mix(np.arange(1, len(some) + 1, dtype=np.uint64))
            chunk = int(A.mix(ids.view(np.uint64) * A.BASE + A.mix(whole.view(np.uint64) + place)).sum().astype(np.int64))
            order = np.argsort(x)
            x, who = x[order], np.repeat(np.arange(len(some), dtype="<u2"), n)[order]
            cut = np.searchsorted(x, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(LOW))
            planes = (x & np.uint64((1 << LOW) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
            full = np.flatnonzero(np.diff(cut)).tolist()
            cut = cut.tolist()
            bucket = [*full, BUCKETS + chunk % BUCKETS]
            low = [*(planes[:, cut[k] : cut[k + 1]].tobytes() for k in full), np.stack((ids, n, whole)).astype("<i8").tobytes()]
            owner = [*(who[cut[k] : cut[k + 1]].tobytes() for k in full), b""]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk] * len(bucket), pa.int64()), pa.array(low, pa.binary()), pa.array(owner, pa.binary())], ["bucket", "chunk", "low", "owner"])

    def count(t: pa.Table) -> pa.Table:
        low, owner, chunks = t["low"].to_pylist(), t["owner"].to_pylist(), t["chunk"].to_pylist()
        bucket = t["bucket"][0].as_py()
        if bucket >= BUCKETS:  # ids, sizes and hashes of batches
            out = [(chunk, a, b"", b"") for chunk, a in zip(chunks, low)]
        else:
            parts = [np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for b in low]
            v = np.concatenate(parts)
            order = np.argsort(v, kind="stable")
            run = v[order]
            run = np.diff(np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)))
            often = np.empty(len(v), np.int64)
            often[order] = np.repeat(run, run)
            out, at = [], 0
            for chunk, part, who in zip(chunks, parts, owner):
                n = often[at : at + len(part)]
                at += len(part)
                more = n > 1
                if more.any():
                    out.append((chunk, part[more].tobytes(), np.frombuffer(who, "<u2")[more].tobytes(), np.minimum(n[more], 65535).astype("<u2").tobytes()))
        pa.default_memory_pool().release_unused()
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays([pa.array([bucket] * len(out), pa.int32()), *columns], ["bucket", "chunk", "low", "owner", "often"])

    def gather(t: pa.Table) -> pa.Table:
        bucket, low = t["bucket"].to_pylist(), t["low"].to_pylist()
        ids, n, whole = np.frombuffer(next(b for k, b in zip(bucket, low) if k >= BUCKETS), "<i8").reshape(3, -1)
        parts = [(np.frombuffer(b, "<u4").astype(np.uint64) | np.uint64(k << LOW)) for k, b in zip(bucket, low) if k < BUCKETS]
        h = np.concatenate([np.zeros(0, np.uint64), *parts])
        who, often = (np.frombuffer(b"".join(t[c].to_pylist()), "<u2") for c in ("owner", "often"))
        order = np.lexsort((h, who))
        h, who, often = h[order], who[order], often[order]
        own = np.append(True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]))[: len(h)]  # two batches of the same contents have one name
        h, who, often = h[own], who[own], often[own]
        some, first, r = np.unique(who, return_index=True, return_counts=True)
        m = np.maximum(r - np.ceil(containment * n[some]).astype(np.int64) + 1, 0)
        rare = np.lexsort((h, often, who))
        probes = h[rare][np.arange(len(h)) - np.repeat(first, r) < np.repeat(m, r)]
        pa.default_memory_pool().release_unused()
        items, probes, ends, to = _packed(h), _packed(probes), (np.append(first, len(h)) * 5).tolist(), (np.append(0, np.cumsum(m)) * 5).tolist()
        cut = lambda b, at: pa.array([b[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())
        return pa.Table.from_arrays([*(pa.array(v[some], pa.int64()) for v in (ids, n, whole)), cut(items, ends), cut(probes, to)], ["doc_id", "n", "set", "items", "probes"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    counted = A.map_batches(rows, spread, "bucket int, chunk long, low binary, owner binary").groupBy("bucket").applyInArrow(count, "bucket int, chunk long, low binary, owner binary, often binary")
    return counted.groupBy("chunk").applyInArrow(gather, "doc_id long, n long, set long, items binary, probes binary")


def entries(items: DataFrame, ratio: float, only: bool = False) -> DataFrame:
    """h (a shingle), doc_id, n, part (its partition by size) and whether it probes with h; or only the h of probes."""
    edges = bounds(ratio)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        probes = b.column(3).to_pylist()
        p = _unpacked(b"".join(probes))
        if only:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(p).astype(np.int64))], ["h"])
            return
        items = b.column(2).to_pylist()
        ids, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        h, rows = _unpacked(b"".join(items)), np.arange(len(n), dtype=np.uint64) << np.uint64(40)
        count = np.array([len(x) // 5 for x in items], np.int64)
        probing = np.zeros(len(h), bool)
        probing[np.searchsorted(h + np.repeat(rows, count), p + np.repeat(rows, [len(x) // 5 for x in probes]))] = True
        part = np.searchsorted(edges, n, "right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *(pa.array(np.repeat(v, count)) for v in (ids, n, part)), pa.array(probing)], ["h", "doc_id", "n", "part", "probe"])

    return A.map_batches(items.select("doc_id", "n", "items", "probes"), run, "h long" if only else "h long, doc_id long, n long, part int, probe boolean")


def verified(pairs: DataFrame, items: DataFrame, containment: float, ratio: float, across: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets fulfil the definition of near copies, or those of which b holds a, by intersecting them; and b's size."""
    both = pairs.select("a", "b").join(items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"), F.col("n").alias("m")), "a")
    both = both.join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"), "n"), "b").select("a", "b", "x", "y", "m", "n")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good = []
        for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            if not across and m > n:
                x, y, m, n = y, x, n, m
            fit = min(len(x), len(y)) // 5 >= containment * m and (n > ratio * m if across else n <= ratio * m)
            if fit:
                x, y = _unpacked(x), _unpacked(y)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                fit = int((y[at] == x).sum()) >= containment * m
            good.append(fit)
        keep = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1, 5)], ["a", "b", "n"])

    return A.map_batches(both, run, "a long, b long, n long")


def components(edges: DataFrame, disk: Scratch, name: str) -> DataFrame:
    """node and group (its lowest node), for the nodes of edges (a, b): each round, nodes take the lowest label around them, and then that label's own."""
    links = disk.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-links")
    labels = disk.keep(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("group")), f"{name}-0")
    k = 0
    while True:
        near = links.join(labels, links.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        step = labels.join(near, "node").select("node", F.col("group").alias("old"), F.least("group", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("group").alias("up"))
        step = step.join(up, "next").select("node", F.least("next", "up").alias("group"), (F.least("next", "up") != F.col("old")).alias("moved"))
        k += 1
        step = disk.keep(step, f"{name}-{k}")
        disk.drop(f"{name}-{k - 1}")
        labels = step.select("node", "group")
        if step.filter("moved").isEmpty():
            disk.drop(f"{name}-links")
            return labels


def _written(disk: Scratch, df: DataFrame, name: str) -> DataFrame:
    """Keeps df, and frees at once the disk of what was shuffled for it."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return disk.keep(df, name)
    finally:
        conf.set(key, before)


def met(hot: DataFrame, groups: DataFrame, ratio: float) -> DataFrame:
    """The pairs (a, b) of no one group and fitting sizes of which the smaller probes with a shingle of the larger."""
    labelled = hot.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))
    mixed = labelled.groupBy("h").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 <> g1").select("h")
    labelled = labelled.join(mixed, "h", "left_semi")
    small = labelled.filter("probe").select("h", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("group").alias("gx"))
    large = labelled.select("h", "part", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("group").alias("gy"))
    pairs = small.join(large, ["h", "part"]).filter((F.col("gx") != F.col("gy")) & (F.col("ny") >= F.col("nx")) & (F.col("ny") <= ratio * F.col("nx")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def holders(hot: DataFrame, items: DataFrame, containment: float, ratio: float, disk: Scratch) -> DataFrame:
    """rep and top, the size and id (its bits inverted) of the largest document that holds it, of those in hot."""
    size = F.struct("n", F.bitwise_not("doc_id").alias("other"))  # of equal sizes the lowest id
    top = hot.groupBy("h").agg(F.max(size).alias("top"))
    probes = hot.filter("probe").select("h", F.col("doc_id").alias("a"), F.col("n").alias("na"))
    best = probes.join(top, "h").filter(F.col("top.n") > ratio * F.col("na")).groupBy("a").agg(F.max("top").alias("top"))
    best = _written(disk, best.select("a", F.bitwise_not("top.other").alias("b")), "largest")
    good = _written(disk, verified(best.filter("a <> b"), items, containment, ratio, True), "held")
    # what the largest doesn't hold is compared with all it meets
    left = probes.join(best.join(good, "a", "left_anti").select("a"), "a", "left_semi")
    pairs = left.join(hot.select("h", F.col("doc_id").alias("b"), "n"), "h").filter((F.col("n") > ratio * F.col("na")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    found = good.unionAll(verified(pairs, items, containment, ratio, True)).groupBy("a").agg(F.max(F.struct("n", F.bitwise_not("b").alias("other"))).alias("top"))
    return found.select(F.col("a").alias("rep"), "top")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, containment: float = CONTAINMENT, ratio: float = RATIO, permutations: int = PERMUTATIONS, held: str | None = "all") -> DataFrame:
    """doc_id, group_id (the lowest id of its group, or its own) and container_id (the largest document that holds it, or null), for every document
    of a group of two or more and every one that is held. With held="firsts" only each group's document of lowest id may hold or be held; with None none is."""
    disk = Scratch(docs.sparkSession)
    sketches = _written(disk, sketch(docs, id_col, text_col, size, containment, ratio, permutations), "sketches")
    same = sketches.groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    single = same.select("set", "n", F.col("rep").alias("doc_id"))
    items = _written(disk, shared(docs, id_col, text_col, size, containment).join(single, ["set", "n", "doc_id"], "left_semi"), "items")
    reps = sketches.join(single, ["set", "n", "doc_id"], "left_semi")
    keyed = [reps.select("doc_id", F.lit(role).alias("role"), F.explode(c).alias("key")) for role, c in ((0, "both"), (1, "small"), (2, "large"))]
    entered = keyed[0].unionAll(keyed[1]).unionAll(keyed[2])
    # the members to check a bucket's others against, by an aggregate that is combined before the shuffle: a hot bucket meets in no one task
    buckets = entered.groupBy("key").agg(
        F.min(F.when(F.col("role") != 1, F.col("doc_id"))).alias("first"), F.min(F.when(F.col("role") == 1, F.col("doc_id"))).alias("first_small"), F.max(F.when(F.col("role") == 0, F.col("doc_id"))).alias("last")
    )
    buckets = buckets.filter("first <> last OR first IS NOT NULL AND first_small IS NOT NULL").select("key", "first", "first_small")
    star = entered.join(buckets, "key").select(F.col("doc_id").alias("x"), F.when(F.col("role") == 2, F.col("first_small")).otherwise(F.col("first")).alias("y"))
    star = star.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = _written(disk, verified(star, items, containment, ratio).select("a", "b"), "first")
    groups = components(first, disk, "groups-first")
    # what no band found: whoever meets by a shingle and is in no one group yet
    hot = _written(disk, entries(items, ratio).join(entries(items, ratio, only=True).distinct(), "h", "left_semi"), "hot")
    second = verified(met(hot, groups, ratio), items, containment, ratio).select("a", "b")
    # copies of the very same set join their representative's group; an id with several sets joins the groups of all
    copies = sketches.select("doc_id", "set", "n").join(same, ["set", "n"]).select("doc_id", "rep", (F.col("rep") != F.col("last")).alias("copied"))
    several = copies.groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 <> r1").select("doc_id")
    joined = copies.filter("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    merged = _written(disk, first.union(second).union(joined), "edges")
    groups = components(merged, disk, "groups")
    out = copies.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    if held is None:
        out = out.withColumn("top", F.lit(None).cast("struct<n: long, other: long>"))
    else:
        among = hot.join(groups.filter("node <> group").select(F.col("node").alias("doc_id")), "doc_id", "left_anti") if held == "firsts" else hot
        out = out.join(_written(disk, holders(among, items, containment, ratio, disk), "holders"), "rep", "left")
    disk.drop("items", "hot", "first", "edges", "groups-first")
    top = F.max(F.when(F.bitwise_not("top.other") != F.col("doc_id"), F.col("top"))).alias("top")
    out = out.filter("copied OR group IS NOT NULL OR top IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("group", "rep")).alias("group_id"), top)
    return out.select("doc_id", "group_id", F.bitwise_not("top.other").alias("container_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and group_id, the lowest id of its group, for every document of a group of two or more."""
    return duplicates(docs, id_col, text_col, held=None, **options).select("doc_id", "group_id")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near copy or is held by a larger one, with its group and the largest that holds it."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE: dict[str, str] = {}
