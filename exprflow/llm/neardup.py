"""Near-duplicate groups by HyperMinHash registers, banding and exact confirmation.

1. Each text becomes its set of word-shingle hashes. The set is split over ``REGISTERS`` buckets;
   a bucket's smallest hash is kept as one byte, four bits of leading zeros and four bits of mantissa.
   An empty bucket borrows the register of a fixed random bucket, so each register of two texts
   agrees with the probability of their Jaccard similarity, whatever their lengths.
2. ``ROWS`` registers make a band. Texts that agree in any band meet; at a similarity of 0.8
   (1 - 0.8**8)**64 = 8e-6 of the pairs miss each other. Texts that meet, directly or through others,
   form a cell; ids alone are moved to find the cells.
3. Each text's full set travels once to a block of its cell, with the cell's hubs. In a block the
   registers give a Jaccard estimate, corrected for registers that agree by chance; pairs above a bound
   five deviations below the threshold are confirmed on the full sets, and a spanning forest of links leaves
   the block: no pair list of a group exists.
4. Blocks whose texts aren't one component yet are confirmed against each other, if they share a
   band value. Cells are bounded by nothing; blocks are, in rows and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .arrowtext import mix64, shingle_sets, slices, split_words

REGISTERS, ROWS = 512, 8
BANDS = REGISTERS // ROWS
PROBES = 64
#: Set keys that a task remembers, to give each set's bands once; then it starts anew.
SEEN_SETS = 1 << 20
#: Texts and bytes of sets in a block; texts of a cell that are put into each of its blocks.
BLOCK_ROWS, BLOCK_BYTES, HUBS = 384, 12 << 20, 8
_DONORS = np.random.default_rng(7).integers(0, REGISTERS, (PROBES, REGISTERS)).astype(np.int16)
EMPTY = 255


def registers(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The register bytes of each set; rows of empty sets are EMPTY throughout."""
    n = len(offsets) - 1
    h = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = np.repeat(np.arange(n), np.diff(offsets)) * REGISTERS + (h >> np.uint64(55)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, low = cell[order], (h[order] << np.uint64(9)).astype(np.uint64)
    first = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
    cell, low = cell[first], low[first]
    # floor(log2) by exponent of the double; the 52 upper bits are exact enough for 15 zeros and 4 bits
    mantissa, exponent = np.frexp((low >> np.uint64(11)).astype(np.float64) + 0.5)
    zeros = np.clip(53 - exponent, 0, 14)
    packed = (zeros << 4 | np.minimum((mantissa * 32).astype(np.int64) - 16, 15)).astype(np.uint8)
    out = np.full(n * REGISTERS, EMPTY, np.uint8)
    out[cell] = packed
    out = out.reshape(n, REGISTERS)
    own = out.copy()
    r, c = np.nonzero((out == EMPTY) & (np.diff(offsets) > 0)[:, None])
    for donors in _DONORS:
        got = own[r, donors[c]]
        hit = got != EMPTY
        out[r[hit], c[hit]] = got[hit]
        r, c = r[~hit], c[~hit]
    if len(r):  # few hashes: the next register that has one
        rows = np.unique(r)
        twice = np.concatenate((own[rows], own[rows]), axis=1)
        at = np.where(twice != EMPTY, np.arange(2 * REGISTERS), 2 * REGISTERS)
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
        i = np.searchsorted(rows, r)
        out[r, c] = twice[i, following[i, c]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    words = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    with np.errstate(over="ignore"):
        return mix64(words + mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def chance(n: float) -> float:
    """Probability that registers of two disjoint sets of about ``n`` hashes agree."""
    k = max(n / REGISTERS, 1e-3)
    z = np.arange(15)
    low = 2.0 ** -(z[:, None] + 1) * (1 + np.arange(16) / 16)
    p = np.exp(-k * low) - np.exp(-k * (low + 2.0 ** -(z[:, None] + 5)))
    return float(np.square(p / p.sum()).sum())


def _sketch(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes) of the shingle sets, their registers, and a 64-bit key of each set."""
    offsets, h = shingle_sets(split_words(texts, lower=True), shingle)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)))
        own = mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))
    return offsets, h, registers(offsets, h), own.view(np.int64)


def _bands(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            offsets, _, regs, own = _sketch(part.column("text"), shingle)
            n = np.diff(offsets)
            new = np.zeros(len(n), bool)  # copies of a set say nothing new
            for i in np.flatnonzero(n > 0):
                if (k := int(own[i])) not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(k)
                    new[i] = True
            ends = np.concatenate(([0], np.where(new, BANDS, 0).cumsum()))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(regs[new]).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "h1", "h2")), pa.array(n, pa.int64()), pa.array(own, mask=n == 0), bands],
                names=["doc_id", "h1", "h2", "n_shingles", "set_key", "bands"],
            )

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets, h, regs, own = _sketch(part.column("text"), shingle)
            raw = h.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            out = pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("set_key", "cell", "parts")]
                + [pa.array(np.diff(offsets), pa.int64()), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                names=["set_key", "cell", "parts", "n_shingles", "shingles", "registers"],
            )
            yield out.filter(pa.array(own == part.column("set_key").to_numpy()))

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _confirm(regs: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, threshold: int, found: list) -> None:
    """Append the links (i, j) that join components, of pairs with i in ``left``; best estimates first."""
    n = np.array([len(x) for x in sets])
    forest, firsts = _Forest(len(sets)), {}
    for i, c in enumerate(comp):
        forest.join(firsts.setdefault(c, i), i)
    pairs = []
    for i in np.flatnonzero(left):
        j = np.flatnonzero((comp != comp[i]) & (np.arange(len(sets)) > i if left.all() else ~left))
        j = j[(100 * np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]))]
        if not len(j):
            continue
        same = (regs[j] == regs[i]).mean(1)
        p = chance(float(n[i]))
        s = threshold / 100
        independent = REGISTERS * (1 - np.exp(-np.minimum(n[j], n[i]) / REGISTERS))
        est = (same - p) / (1 - p)
        good = est >= s - 5.5 * np.sqrt(s * (1 - s) / independent)
        pairs += [(-e, int(i), int(k)) for e, k in zip(est[good], j[good], strict=True)]
    for _, i, j in sorted(pairs):
        if forest.find(i) == forest.find(j):
            continue
        a, b = (sets[i], sets[j]) if len(sets[i]) >= len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        both = int((a[at] == b).sum())
        if 100 * both >= threshold * (len(a) + len(b) - both):
            forest.join(i, j)
            found.append((i, j))


def _block_links(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("cell", sort=False):
            g = g.drop_duplicates("set_key", ignore_index=True)
            if len(g) < 2 or g["side"].min():
                continue
            regs = np.frombuffer(b"".join(g["registers"]), np.uint8).reshape(len(g), REGISTERS)
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            left = (g["side"] == 0).to_numpy()
            found: list = []
            _confirm(regs, sets, g["comp"].to_numpy(), left, threshold, found)
            k = g["set_key"].to_numpy()
            out += [(k[i], k[j]) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the nodes of undirected ``edges`` (a, b); root is a node of the component.

    Roots hook onto the smallest root that an edge leads to, chains of hooks are shortened by joins,
    and rounds repeat until no edge joins two roots. Each round is written to the shared folder.
    """
    edges = materialize(edges.select("a", "b"), f"{name}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    parent = nodes.select("node", F.col("node").alias("root"))  # read from the edges once more, if there is a round at all
    live, done = edges.where("a <> b"), (edges,)
    while True:
        hooks = (
            live.select(F.greatest("a", "b").alias("r"), F.least("a", "b").alias("to"))
            .groupBy("r")
            .agg(F.min("to").alias("to"))
        )
        for _ in range(2):
            nxt = hooks.select(F.col("r").alias("to"), F.col("to").alias("far"))
            hooks = hooks.join(nxt, "to", "left").select("r", F.coalesce("far", "to").alias("to"))
        hooks = materialize(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            return parent
        hop = hooks.select(F.col("r").alias("root"), F.col("to"))
        roots = materialize(parent.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots")
        pa_, pb = hooks.select(F.col("r").alias("a"), F.col("to").alias("a2")), hooks.select(F.col("r").alias("b"), F.col("to").alias("b2"))
        moved = materialize(
            live.join(pa_, "a", "left").join(pb, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct(),
            f"{name}-live",
        )
        discard(hooks, *done)
        parent, live, done = roots, moved, (roots, moved)


def _parts(members: DataFrame, unit: list[str]) -> DataFrame:
    """Add ``parts``: how many blocks the members of a unit need."""
    size = members.groupBy(*unit).agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("hashes"))
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("hashes") * 8 / BLOCK_BYTES)).cast("long")
    return members.join(size.select(*unit, parts.alias("parts")), unit)


def _row_key() -> dict[str, Column]:
    """Two hashes of doc_id and text that name a row, whether its doc_id is null, repeated or neither."""
    return {"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64(F.lit(1), "doc_id", "text")}


def _components_of_rows(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Per row of ``docs``: doc_id, h1, h2, n_shingles, set_key, and of its component the root and the smallest doc_id; these three are null without words."""
    texts = docs.select("doc_id", "text").withColumns(_row_key())
    ids = materialize(
        texts.mapInArrow(_bands(shingle), "doc_id long, h1 long, h2 long, n_shingles long, set_key long, bands array<long>"), "neardup-bands"
    )
    # counted before the shuffle, so the sets of a frequent band don't meet; the join back splits such a band
    bands = ids.select(F.explode("bands").alias("band"), "set_key")
    shared = bands.groupBy("band").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("top")).where("hub <> top").select("band", "hub")
    shared = materialize(shared, "neardup-bands-shared")
    met = bands.join(shared, "band").select("band", "set_key", "hub").distinct()
    met = materialize(met, "neardup-met")
    cells = components(met.select(F.col("set_key").alias("a"), F.col("hub").alias("b")).distinct(), "neardup-cells")

    per_set = (
        ids.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("h1", "h2")).alias("row"), F.max("n_shingles").alias("n_shingles"))
        .select("set_key", "least", "row.h1", "row.h2", "n_shingles")
    )
    per_set = materialize(per_set, "neardup-per-set")
    one_row = per_set.select("set_key", "h1", "h2", "n_shingles")
    members = _parts(cells.select(F.col("node").alias("set_key"), F.col("root").alias("cell")).join(one_row, "set_key"), ["cell"])
    sets = materialize(
        texts.join(members.select("h1", "h2", "set_key", "cell", "parts"), ["h1", "h2"])
        .select("text", "set_key", "cell", "parts")
        .mapInArrow(_full_sets(shingle), "set_key long, cell long, parts long, n_shingles long, shingles binary, registers binary"),
        "neardup-sets",
    )

    # cells that fit a block share one; a larger cell is split, with some of its sets in each of its blocks
    small = sets.where("parts = 1").agg(F.sum("n_shingles")).first()[0] or 0
    shared = 1 + small * 8 // (BLOCK_BYTES // 4)
    block = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cell"), F.lit(shared))).otherwise(
        F.xxhash64("cell", F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("parts")))
    )
    large = sets.where("parts > 1").select("cell", "set_key", "parts", F.xxhash64("set_key", F.lit(2)).alias("order"))
    salted = Window.partitionBy("cell", F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("parts"))).orderBy("order", "set_key")
    hubs = (
        large.withColumn("k", F.row_number().over(salted))
        .where(F.col("k") <= HUBS)
        .withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("order", "set_key")))
        .where(F.col("k") <= HUBS)
        .select("cell", "set_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
        .select("set_key", F.xxhash64("cell", "p").alias("block"))
    )
    columns = ["cell", "set_key", F.col("set_key").alias("comp"), F.lit(0).alias("side"), "shingles", "registers"]
    placed = sets.select(block.alias("block"), *columns).union(
        sets.where("parts > 1").join(hubs, "set_key").select("block", *columns)
    )
    links = materialize(placed.groupBy("block").applyInPandas(_block_links(threshold), "a long, b long"), "neardup-links")

    # between the blocks of a cell, where its texts aren't one component yet
    roots = components(links, "neardup-near")
    inside = (
        sets.where("parts > 1").select("cell", "set_key", "n_shingles").distinct()
        .join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
        .select("cell", "set_key", "n_shingles", F.coalesce("root", "set_key").alias("comp"))
    )
    inside = materialize(inside, "neardup-inside")
    several = inside.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cell")
    by_comp = inside.groupBy("cell", "comp").agg(F.count("*").alias("of_comp"))
    pure = F.when(F.col("of_comp") >= BLOCK_ROWS // 4, F.col("comp"))
    split = inside.join(several, "cell", "left_semi").join(by_comp, ["cell", "comp"]).withColumn("pure", pure)
    split = _parts(split.withColumn("unit", F.coalesce("pure", F.lit(0).cast("long"))), ["cell", "unit"])
    at = F.pmod(F.xxhash64("set_key", F.lit(5)), F.col("parts"))
    split = materialize(split.select("cell", "set_key", "comp", "pure", F.xxhash64("cell", "unit", at).alias("block")), "neardup-split")
    touch = met.join(split.select("set_key", "block", "pure"), "set_key").select("band", "block", "pure").distinct()
    other = touch.select("band", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    tasks = (
        touch.join(other, "band")
        .where("block <= block2 and not (pure is not null and pure2 is not null and pure = pure2)")
        .select("block", "block2").distinct()
        .select("block", "block2", F.xxhash64("block", "block2").alias("task"))
    )
    tasks = materialize(tasks, "neardup-tasks")
    sides = tasks.select("task", "block", F.lit(0).alias("side")).union(
        tasks.where("block <> block2").select("task", F.col("block2").alias("block"), F.lit(1).alias("side"))
    )
    both = split.select("cell", "set_key", "comp", "block").join(sides, "block").select("task", "cell", "set_key", "comp", "side")
    both = both.join(sets.where("parts > 1").select("set_key", "shingles", "registers"), "set_key")
    more = both.groupBy("task").applyInPandas(_block_links(threshold), "a long, b long")
    roots = components(links.union(materialize(more, "neardup-more")), "neardup-all")

    # the smallest doc_id by set, then by component; each join has one row a key on its right and can split a hot key on its left
    linked = per_set.select("set_key", "least").join(roots.withColumnRenamed("node", "set_key"), "set_key")
    linked = materialize(linked, "neardup-linked")
    of_root = materialize(linked.groupBy("root").agg(F.min("least").alias("first")), "neardup-firsts")
    found = linked.select("set_key", "root").join(of_root, "root").select("set_key", "root", "first")
    every = per_set.select("set_key", "least").join(found, "set_key", "left")
    every = materialize(every.select("set_key", F.coalesce("root", "set_key").alias("root"), F.coalesce("first", "least").alias("least")), "neardup-sets-rooted")
    return ids.drop("bands").join(every, "set_key", "left").select("doc_id", "h1", "h2", "n_shingles", "set_key", "root", "least")


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 80) -> DataFrame:
    """Return per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A text of fewer words than
    ``shingle`` has one shingle, its word sequence; a null text or one without words has none, is linked with nothing
    and kept. Rows link if 100 * intersection >= threshold * union; component_id is the smallest
    doc_id reachable. Repeated rows are copies of each other; of rows with one doc_id in one component all or none are
    kept. A null doc_id is larger than all others: its row is kept where no other doc_id is reachable.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    ids = _components_of_rows(docs, shingle, threshold)
    first = F.coalesce("least", "doc_id")
    return ids.select("doc_id", "n_shingles", first.alias("component_id"), F.col("doc_id").eqNullSafe(first).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id, nulls last, and among rows with
    that doc_id of the smallest set key.

    A doc_id may be null or name several texts; each text is judged by itself. Rows without words are all kept.
    """
    ids = _components_of_rows(docs, shingle, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_key", "h1", "h2")
    kept = ids.where("root is not null").groupBy("root").agg(F.min(order).alias("row")).select("row.h1", "row.h2")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = docs.where(has_words).withColumns(_row_key()).join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return one.select(docs.columns).unionByName(docs.where(~has_words))
