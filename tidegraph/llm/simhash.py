"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks. On each block the words of a covering
code of radius one are anchors: the direct sum of Hamming codes [15, 11] (or
[31, 26]) and free bits, so that each value lies within one bit of an anchor.
Two fingerprints that differ in at most ``threshold`` bits differ in at most
``threshold // blocks`` bits on some block. There, the anchor that covers the
one is within one bit more of the other: replicated to all anchors within that
radius, the two meet at one anchor, and nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegraph.llm.common import claim, documents, materialize, spread_join
from tidegraph.llm.components import connected_components

BITS = 64
#: What moving a replica costs, in comparisons of fingerprints.
REPLICA_COST = 200
#: Homes of an anchor that one task compares; an anchor with more is dealt to several.
HOMES = 2048
#: Crowded anchors (12 bytes each) that are broadcast; more of them are joined by a shuffle.
BROADCAST = 1 << 18


def fingerprint(text: bytes | None, words: int) -> int:
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8")
    half, total = len(hashes) / 2, np.zeros(BITS, "i8")
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(total > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, *others: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, ...)``: the SimHash of the word shingles,
    as a signed long, and the columns ``others``.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``words`` long and counted as often as they occur, each hashed by XXH64 with
    seed 42. A bit is set where more than half of the hashes have it. A text of
    fewer words is one shingle; null and empty texts have fingerprint 0. Whole texts
    count, however long.
    """
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *others)
    schema = StructType([wanted.schema[0], StructField("fp", LongType()), *wanted.schema[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(x, words) for x in part.column(1).cast(pa.binary()).to_pylist()], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *part.columns[2:]], names=schema.names)

    return wanted.mapInArrow(run, schema)


class CoveringCode:
    """Covering code of radius one on ``width`` bits: a Hamming code on the low
    ``n`` bits, all values on the others."""

    def __init__(self, width: int):
        self.width, self.n = width, 31 if width >= 31 else 15
        # Bit i is the column i + 1 of the parity check, so a syndrome names the bit to flip.
        table = np.zeros((4, 256), "u1")
        for byte in range(4):
            for v in range(256):
                s = 0
                for bit in range(8):
                    if v >> bit & 1 and byte * 8 + bit < self.n:
                        s ^= byte * 8 + bit + 1
                table[byte, v] = s
        self.table = table
        self.masks: dict[int, dict[int, np.ndarray]] = {}

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.table[0, v & 255] ^ self.table[1, v >> 8 & 255] ^ self.table[2, v >> 16 & 255] ^ self.table[3, v >> 24 & 255]

    def home(self, v: np.ndarray) -> np.ndarray:
        """The anchor that covers each value."""
        s = self.syndrome(v).astype("u8")
        return np.where(s > 0, v ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), v)

    def within(self, radius: int) -> dict[int, np.ndarray]:
        """By syndrome, the changes of at most ``radius`` bits that lead to an anchor."""
        if radius not in self.masks:
            changes = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(self.width), r)], "u8")
            s = self.syndrome(changes)
            self.masks[radius] = {k: changes[s == k] for k in range(self.n + 1)}
        return self.masks[radius]


def cheapest(n: int, threshold: int) -> int:
    """Two or three blocks, whichever moves and compares less for ``n`` fingerprints.

    Both find every link. On wider blocks a fingerprint goes to more anchors (at a
    threshold of 4, 343 against 45), but there are 2^27 anchors a block against 2^17,
    so far fewer fingerprints meet at each: with three blocks, comparisons grow with
    n^2 / 2^17, and from some 2^24 fingerprints on they cost more than the replicas that two
    blocks add. Cost a fingerprint: its replicas, each moved once and compared with the homes of its anchor.
    """

    def cost(blocks: int) -> float:
        total = 0.0
        for _, width in layout(blocks):
            code = CoveringCode(width)
            replicas = sum(map(len, code.within(1 + threshold // blocks).values())) / (code.n + 1)
            total += replicas * (REPLICA_COST + n / 2 ** (width - (code.n + 1).bit_length() + 1))
        return total

    return min((3, 2), key=cost)


def layout(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def meetings(fps: DataFrame, threshold: int, blocks: int, homes_only: bool = False) -> DataFrame:
    """``fps(fp)`` -> ``(anchor, fp, home)``: every anchor that a fingerprint goes to, or only its home on each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [(i, np.uint64(shift), np.uint64((1 << width) - 1), CoveringCode(width)) for i, (shift, width) in enumerate(layout(blocks))]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view("u8")
                for i, shift, mask, code in codes:
                    v = x >> shift & mask
                    s, home = code.syndrome(v), code.home(v)
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array((home | np.uint64(i << 60)).view("i8")), pa.array(x.view("i8")), pa.array(np.ones(len(x), bool))], names=["anchor", "fp", "home"])
                        continue
                    near = code.within(1 + threshold // blocks)
                    for k in np.unique(s).tolist():
                        own = np.flatnonzero(s == k)
                        anchors = (v[own, None] ^ near[k][None, :]).ravel()
                        rows = np.repeat(own, len(near[k]))
                        yield pa.RecordBatch.from_arrays([pa.array((anchors | np.uint64(i << 60)).view("i8")), pa.array(x[rows].view("i8")), pa.array(anchors == home[rows])], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_edges(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between homes and all others at an anchor, as few as keep its
    components: not one for each pair of a group."""
    out: list[tuple[int, int]] = []
    label = np.arange(len(fps))
    forest = Forest(len(fps))
    done = np.zeros(len(fps), bool)
    for i in np.flatnonzero(home):
        hits = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold)
        if len(hits) < 2:
            continue
        mine = forest.root(int(label[i]))
        fresh = hits[~done[hits]]
        out += [(int(i), int(j)) for j in fresh if j != i]
        label[fresh] = mine
        for other in {int(x) for x in np.unique(label[hits[done[hits]]])}:
            r = forest.root(other)
            if r != mine:
                j = int(hits[done[hits] & (label[hits] == other)][0])
                if j != i:
                    out.append((int(i), j))
                forest.up[r] = mine
        done[hits] = True
    return out


def links(fps: DataFrame, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct ``fps(fp)`` -> ``(a, b)``: links of at most ``threshold`` bits that
    have the same components as all such links."""
    if blocks is None:
        blocks = cheapest(fps.count(), threshold)
    met = meetings(fps, threshold, blocks)
    # Homes of a crowded anchor are dealt to several tasks, and its other fingerprints go to each of them.
    heavy = meetings(fps, threshold, blocks, homes_only=True).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOMES)
    heavy = materialize(heavy.select("anchor", F.ceil(F.col("n") / HOMES).cast("int").alias("ways")), "heavy-anchors")
    crowded = heavy.count()
    if crowded:
        dealt = met.join(F.broadcast(heavy) if crowded <= BROADCAST else heavy, "anchor", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    else:
        dealt = met.withColumn("ways", F.lit(1))
    chosen = F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("ways") - 1))
    dealt = dealt.select("anchor", "fp", "home", chosen.alias("own"), every.alias("way")).select("anchor", "fp", (F.col("home") & (F.col("own") == F.col("way"))).alias("home"), "way")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Compares the anchors that are complete; keeps the rest."""
            nonlocal held
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            anchor, fp, home, way = (t.column(k).to_numpy() for k in range(4))
            fp = fp.view("u8")
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (way[1:] != way[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            stop = len(bounds) - 1 if last else len(bounds) - 2
            a, b = [], []
            n_home = np.add.reduceat(home.astype("i8"), bounds[:-1]) if len(fp) else []
            for k in range(stop):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if hi - lo > 1 and n_home[k]:
                    x = fp[lo:hi]
                    for i, j in tree_edges(x, home[lo:hi], threshold):
                        a.append(x[i])
                        b.append(x[j])
            held = [] if last else t.slice(int(bounds[stop])).to_batches()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, "u8").view("i8")), pa.array(np.array(b, "u8").view("i8"))], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 100_000:
                yield from flush(False)
                size = held[0].num_rows if held else 0
        yield from flush(True)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "anchor", "way").sortWithinPartitions("anchor", "way").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 4, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, a row per row.

    Fingerprints that differ in at most ``threshold`` bits link, copies
    included; ``component_id`` is the smallest doc_id that links reach, the own
    one included. Copies share a fingerprint and are compared once. Null and
    empty texts have fingerprint 0 and link like others. A null doc_id stays
    null and is never a component's id, unless all of the component's are null.
    Rows that repeat a doc_id each get their row. Other columns are ignored.
    """
    each = materialize(fingerprints(docs, words), "fingerprints")
    return _classes(each, threshold, blocks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(each: DataFrame, threshold: int, blocks: int | None) -> DataFrame:
    """Written ``each(doc_id, fp, ...)`` with ``component_id`` and ``root``, its component's own number."""
    groups = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "groups")
    rooted = materialize(connected_components(links(groups, threshold, blocks)), "rooted")
    # Only fingerprints with a link have to learn their component's least id.
    linked = materialize(groups.join(rooted, groups["fp"] == rooted["id"]).select("fp", "low", "root"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "least")
    known = spread_join(linked.select("fp", "root"), least, "root", "n").select(F.col("fp").alias("f"), F.col("root").alias("r"), F.col("component_id").alias("c"))
    of = groups.join(known, F.col("fp") == F.col("f"), "left").select("fp", "n", F.when(F.col("f").isNull(), F.col("low")).otherwise(F.col("c")).alias("component_id"), F.coalesce("r", "fp").alias("root"))
    return spread_join(each, materialize(of, "components"), "fp", "n")


def keep_one(docs: DataFrame, *, words: int = 4, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each component of ``docs``, all columns.

    It is that of the smallest doc_id (a null one is larger than all others); of rows that share that id
    too, that of the smallest hash of its text; of rows that are alike in both, one.
    Null and empty texts have one fingerprint and so are one component. Rows that repeat an
    id are judged by their own texts. An empty table gives no rows; no column name clashes.
    """
    # A row is known by its id and its text's hash, so that texts need not be written.
    names = [c for i in range(len(docs.columns) + 2) if (c := f"known_{i}") not in docs.columns][:2]
    row = [F.col("doc_id").cast("long"), F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))]
    each = materialize(fingerprints(docs.select("doc_id", "text", row[1].alias("sha")), words, "sha"), "fingerprints")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), F.col("doc_id").isNull().alias("no_id"), "sha")
    firsts = _classes(each, threshold, blocks).groupBy("root").agg(F.min(order).alias("first"))
    kept = firsts.select(F.when(~F.col("first.no_id"), F.col("first.i")).alias(names[0]), F.col("first.sha").alias(names[1]))
    kept = materialize(kept, "kept").alias("kept")
    out = docs.withColumns(dict(zip(names, row, strict=True))).alias("row").join(kept, F.col(f"row.{names[0]}").eqNullSafe(F.col(f"kept.{names[0]}")) & (F.col(f"row.{names[1]}") == F.col(f"kept.{names[1]}")), "left_semi")
    if not each.groupBy("doc_id", "sha").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
