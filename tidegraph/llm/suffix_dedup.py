"""Suffix-array removal of repeated byte strings.

A byte goes if a ``length``-byte string that covers it also starts earlier: in a
document of smaller id, or earlier in its own. Only suffixes that can have a
twin are sorted:

1. Copies of a whole text are found by SHA-256; one of each goes on.
2. A minimizer of 20 bytes stands for each window of ``length`` bytes, so that
   equal windows have equal anchors at equal places. Anchors that occur once
   are dropped.
3. What lies around a repeated anchor is its context: the suffix that starts there and
   the reversed text before it. An aggregate puts equal contexts together; all places but the first repeat it.
4. The different contexts of an anchor are sorted by ``deepshallow``. Orders and
   common prefixes give the class of each window; all but its first place are
   repeats. An anchor with very many different contexts is split by the bytes next to it, again
   and again, until each part fits a task.
5. Spans are merged per document and cut out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import claim, documents, fresh_path, materialize, spread_join
from tidegraph.llm.deepshallow import deep_shallow, lcp_array
from tidegraph.store import delete, release

LENGTH = 100
GRAM = 20
#: Different contexts that are sorted together in one task; larger groups are split.
GROUP = 2_048
#: Counters of a task's summary of its anchors, for each shuffle partition.
COUNTERS = 8
SALTS = 1 << 20
BLOCK = 1 << 19
#: Contexts that are classed at once.
PENDING = 40_000
NO_ID = (1 << 63) - 1

_BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, from those of halves."""
    done, size, total = None, 1, 0
    level = _BYTES[data]
    while True:
        if gram & size:
            if done is None:
                done, total = level, size
            else:  # [size bytes][total bytes]
                n = len(data) - (total + size) + 1
                done = level[:n] * np.uint64(pow(int(_BASE), total, 1 << 64)) + done[size : size + n]
                total += size
        if size * 2 > gram:
            break
        n = len(data) - 2 * size + 1
        level = level[:n] * np.uint64(pow(int(_BASE), size, 1 << 64)) + level[size : size + n]
        size *= 2
    done = (done ^ (done >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(29))


def minimizers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): the leftmost smallest gram of every window."""
    found, values, w = [], [], length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = gram_hashes(part, gram)
        key = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype="u8")
        low, size = key, 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(key) - w + 1], low[w - size : len(key) - size + 1])
        p = (low & np.uint64((1 << 20) - 1)).astype("i8")
        p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        found.append(p + at)
        values.append(h[p])
    if not found:
        return np.empty(0, "i8"), np.empty(0, "u8")
    p, v = np.concatenate(found), np.concatenate(values)
    keep = np.concatenate([[True], p[1:] != p[:-1]])
    return p[keep], v[keep]


def same_text(repeats_id: bool) -> Column:
    """``(uid, th)`` against ``(u, t)``: the keys that texts are bucketed by. Where ids are unique, th is none of them."""
    same = F.col("uid") == F.col("u")
    return same & (F.col("th") == F.col("t")) if repeats_id else same


def frequent(h: np.ndarray, c: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """A Misra-Gries summary of hashes ``h`` with counts ``c``: at most ``counters``
    of them, with counts too low by at most a ``counters + 1``-th of all."""
    h, at = np.unique(h, return_inverse=True)
    c = np.bincount(at, c, len(h)).astype("i8")
    if len(c) > counters:
        c = c - np.partition(c, -counters - 1)[-counters - 1]
    return h[c > 0], c[c > 0]


def hot_anchors(work: DataFrame, length: int) -> np.ndarray:
    """Anchors that have more places than half of an average task's.

    Every one of them is among what is returned, and a few others may be: two for each shuffle
    partition on average, or fewer, whatever the size of the table. Tasks send summaries of so many counters.
    """
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counters, share = COUNTERS * parts, 1 / (2 * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, new, waiting, total = np.empty(0, "u8"), np.empty(0, "i8"), [], 0, 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i in range(batch.num_rows):
                new.append(minimizers(np.frombuffer(texts[i].as_buffer(), "u1"), length)[1])
                waiting += len(new[-1])
                if waiting >= BLOCK:
                    h, c = frequent(np.concatenate([h, *new]), np.concatenate([c, np.ones(waiting, "i8")]), counters)
                    new, waiting, total = [], 0, total + waiting
        h, c = frequent(np.concatenate([h, *new]), np.concatenate([c, np.ones(waiting, "i8")]), counters)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total + waiting], pa.int64())], names=["h", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(c)], names=["h", "c"])

    sums = materialize(work.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent-anchors")
    total = sum(r["c"] for r in sums.where("h is null").collect())  # one row at most
    least = max(1, total * (share - 1 / (counters + 1)))
    return np.array([r["h"] for r in sums.where(F.col("h").isNotNull() & (F.col("c") > least)).collect()], "i8").view("u8")


def anchors(work: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """Each anchor's hash and place; ``salt`` is 0, or for ``hot`` ones a number above that spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                hs, ids, ths, ps = [], [], [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    p, h = minimizers(np.frombuffer(texts[i].as_buffer(), "u1"), length)
                    hs.append(h)
                    ps.append(p)
                    ids.append(np.full(len(p), batch.column(0)[i].as_py(), "i8"))
                    ths.append(np.full(len(p), batch.column(1)[i].as_py(), "i8"))
                h, uid, th, p = map(np.concatenate, (hs, ids, ths, ps))
                salt = np.where(np.isin(h, hot), 1 + (uid + p) % SALTS, 0).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(salt), pa.array(uid), pa.array(th), pa.array(p.astype("i4"))], names=["h", "salt", "uid", "th", "pos"])

    return work.select("uid", "th", "text").mapInArrow(run, "h long, salt int, uid long, th long, pos int")


def repeated(places: DataFrame) -> DataFrame:
    """``(uid, th, pos)`` of anchors that occur twice or more; those that are spread by a salt do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by anchor: one repeats if its neighbour has the same. The last row waits for the next batch.
        held: pa.Table | None = None
        before = None

        def chosen(t: pa.Table, after: int | None) -> list[pa.RecordBatch]:
            h, salt = t["h"].to_numpy(), t["salt"].to_numpy()
            same = h[1:] == h[:-1]
            keep = np.concatenate([[before is not None and h[0] == before], same]) | np.concatenate([same, [after is not None and h[-1] == after]]) | (salt > 0)
            return t.filter(pa.array(keep)).select(["uid", "th", "pos"]).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield from chosen(held, batch.column(0)[0].as_py())
                before = held["h"][-1].as_py()
            held = pa.Table.from_batches([batch])
        if held is not None:
            yield from chosen(held, None)

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(n, "h", "salt").sortWithinPartitions("h").mapInArrow(run, "uid long, th long, pos int")


def contexts(work: DataFrame, spots: DataFrame, length: int, repeats_id: bool) -> DataFrame:
    """What lies before and after each repeated anchor: all that a window over it can hold."""
    both = work.join(spots, same_text(repeats_id)).select("uid", "th", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            lefts, rights, ids, ths, ps, size = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ps, pa.int32())], names=["before", "after", "uid", "th", "pos"])  # noqa: B023

            for i in range(batch.num_rows):
                s, spots = texts[i].as_py(), batch.column(3)[i].as_py()
                lefts += [s[max(0, p - length + GRAM) : p][::-1] for p in spots]
                rights += [s[p : p + length] for p in spots]
                ids += [batch.column(0)[i].as_py()] * len(spots)
                ths += [batch.column(1)[i].as_py()] * len(spots)
                ps += spots
                if len(ps) >= 20_000:
                    yield out()
                    lefts, rights, ids, ths, ps = [], [], [], [], []
            if ps:
                yield out()

    return both.mapInArrow(run, "before binary, after binary, uid long, th long, pos int")


def repeated_windows(groups: list[list[tuple]], length: int) -> np.ndarray:
    """``groups``: of each, its different contexts ``(reversed before, after)`` in order of
    their first places, after ``(lo, hi)``. Returns a row for each context: at ``a``, between ``lo`` and ``hi``,
    whether the window that starts ``a`` bytes before the anchor also starts earlier.

    All contexts of a group share ``lo`` bytes before and ``length - hi`` bytes from the anchor on.
    """
    n, reach = sum(len(g) - 1 for g in groups), length - GRAM
    order = [np.empty(n, "i8"), np.empty(n, "i8")]
    lcps = [np.empty(n, "i8"), np.empty(n, "i8")]
    span = np.empty((n, 2), "i8")
    at = 0
    for (lo, hi), *group in groups:
        for side, skip in ((0, lo), (1, length - hi)):
            strings = [c[side] for c in group]
            got = deep_shallow(strings, skip)
            order[side][at : at + len(group)] = np.array(got) + at
            lcps[side][at : at + len(group)] = lcp_array(strings, got)
            lcps[side][at] = -1  # never one class with the group before
        span[at : at + len(group)] = lo, hi
        at += len(group)
    before = np.array([len(c[0]) for g in groups for c in g[1:]])
    after = np.array([len(c[1]) for g in groups for c in g[1:]])
    out = np.zeros((n, reach + 1), bool)
    left, right = np.empty(n, "i8"), np.empty(n, "i8")
    for a in range(reach + 1):
        left[order[0]] = np.cumsum(lcps[0] < a)
        right[order[1]] = np.cumsum(lcps[1] < length - a)
        fits = np.flatnonzero((before >= a) & (after >= length - a) & (span[:, 0] <= a) & (a <= span[:, 1]))
        if len(fits) < 2:
            continue
        key = right[fits] * (n + 1) + left[fits]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(fits), bool)
        again[first] = False
        out[fits[again], a] = True
    return out


def sorted_spans(different: DataFrame, length: int) -> DataFrame:
    """``(uid, th, start, stop)``: bytes that repeat earlier ones, group by group of contexts with one ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        places: list[tuple[int, int, int]] = []
        group: list[tuple] = []
        own: list[tuple[int, int, int]] = []
        key, held = None, 0

        def close() -> None:
            nonlocal held
            if len(own) > 1:
                groups.append(group)
                places.extend(own)
                held += len(own)

        def classed() -> pa.RecordBatch:
            again = repeated_windows(groups, length)
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype("i1"), axis=1)
            row, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            at = np.array(places, "i8").reshape(-1, 3)[row]
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(at[:, 2] - b + 1), pa.array(at[:, 2] - a + length)], names=["uid", "th", "start", "stop"])

        for batch in batches:
            for k, lo, hi, before, after, uid, th, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key, group, own = k, [(lo, hi)], []
                    if held >= PENDING:
                        yield classed()
                        groups, places, held = [], [], 0
                group.append((before, after))
                own.append((uid, th, pos))
        close()
        if groups:
            yield classed()

    n = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = different.select("key", "lo", "hi", "before", "after", "uid", "th", "pos")
    return rows.repartition(n, "key").sortWithinPartitions("key", "uid", "th", "pos").mapInArrow(run, "uid long, th long, start long, stop long")


def first_contexts(ctx: DataFrame, length: int) -> DataFrame:
    """Of equal rows ``(lo, hi, before, after)``, the first place; and the ``key`` of the row."""
    firsts = ctx.groupBy("lo", "hi", "before", "after").agg(F.min(F.struct("uid", "th", "pos")).alias("p"))
    key = F.concat(F.concat_ws(" ", "lo", "hi", F.lit("")).cast("binary"), F.substring(F.col("before"), F.lit(1), F.col("lo")), F.substring(F.col("after"), F.lit(1), F.lit(length) - F.col("hi")))
    return materialize(firsts.select(key.alias("key"), "lo", "hi", "before", "after", "p.uid", "p.th", "p.pos"), "first-contexts")


def spans_of(firsts: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``(uid, th, start, stop)``: bytes of windows that start earlier, from the first places of different contexts.

    A row is responsible for the windows that start ``lo`` to ``hi`` bytes before its
    anchor, at first all of them. Windows of that range can only be equal where ``lo`` bytes before and
    ``length - hi`` bytes from the anchor on are: that is the row's ``key``. Rows with a key that over
    ``group`` different contexts have are dealt to both halves of the range, whose keys are longer; a range of one
    window has the whole window as its key, and so one context. No key is ever one task's
    alone: equal contexts are combined map-side, and ``spread_join`` finds the rows to split.
    """
    out = None

    def add(found: DataFrame) -> None:
        nonlocal out
        out = found if out is None else out.unionByName(found)

    while True:
        sizes = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = materialize(sizes.select("key", "n", (F.col("n") > group).alias("crowded")), "context-counts")
        if sizes.where("crowded").isEmpty():
            add(sorted_spans(firsts, length))
            return out
        marked = materialize(spread_join(firsts, sizes, "key", "n"), "marked-contexts")
        add(sorted_spans(marked.where("not crowded"), length))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        half = F.explode(F.array(F.struct(F.col("lo").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("hi").alias("h"))))
        halves = marked.where("crowded").select("before", "after", "uid", "th", "pos", half.alias("half")).select("half.*", "before", "after", "uid", "th", "pos")
        # What no window of the range can hold is left out, so that more contexts are equal.
        halves = halves.where((F.length("before") >= F.col("l")) & (F.length("after") >= F.lit(length) - F.col("h")))
        level = materialize(halves.select(F.col("l").alias("lo"), F.col("h").alias("hi"), F.substring(F.col("before"), F.lit(1), F.col("h")).alias("before"), F.substring(F.col("after"), F.lit(1), F.lit(length) - F.col("l")).alias("after"), "uid", "th", "pos"), "split-contexts")
        firsts = first_contexts(level, length)
        # All places but the first repeat the windows of their whole context.
        least, most = F.greatest("lo", F.lit(length) - F.length("after")), F.least("hi", F.length("before"))
        whole = level.select("lo", "hi", "uid", "th", "pos", least.alias("least"), most.alias("most")).where("least <= most").join(firsts.select("lo", "hi", "uid", "th", "pos"), ["lo", "hi", "uid", "th", "pos"], "left_anti")
        add(whole.select("uid", "th", (F.col("pos") - F.col("most")).cast("long").alias("start"), (F.col("pos") - F.col("least") + length).cast("long").alias("stop")))


def whole_contexts(spots: list[int], firsts: list[int] | None, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the contexts of anchors that aren't the first of theirs: all their windows are repeats."""
    pos = np.setdiff1d(np.array(spots, "i8"), np.array(firsts or [], "i8"))
    start, stop = np.maximum(pos - length + GRAM, 0), np.minimum(pos + length, size)
    return start[stop - start >= length], stop[stop - start >= length]


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])]


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """(rest, bytes removed, runs removed)."""
    if not len(lo):
        return text, 0, 0
    lo, hi = merged(lo, hi)
    edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
    rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return rest, int((hi - lo).sum()), len(lo)


def text_hash(rows: DataFrame) -> Column:
    """A number from ``sha`` that tells texts of one ``uid`` apart: the first of four parts of it that does."""
    for k in range(4):
        part = F.conv(F.substring("sha", 1 + 16 * k, 15), 16, 10).cast("long")
        if rows.select("uid", "sha").distinct().groupBy("uid", part).count().where("count > 1").isEmpty():
            return part
    raise ValueError("texts of one id differ in no part of their SHA-256")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_text: bool = False, group: int = GROUP) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``,
    a row per row; or, with ``with_text``, the columns of ``docs`` with the rest of
    each text as ``text``.

    Texts are UTF-8 bytes, null is empty; matches don't cross documents. Texts may be as
    long as a row can be. Code points that a cut splits are dropped from the text as a string, not from
    ``kept_sha256``. Of equal texts, that of the smallest
    doc_id is the first. A null doc_id comes after all others. Rows that repeat
    a doc_id are ordered by a hash of their texts, and count as earlier and
    later like others; of wholly equal rows, one is the first. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("uid"), text.alias("text"), F.struct(*others).alias("row")).withColumn("sha", F.sha2("text", 256))
    n_bytes = F.octet_length("text").cast("long")
    extra = [F.when(F.octet_length("text") < length, F.col("text")).alias("short"), "row"] if with_text else []
    small = materialize(base.select("uid", "sha", n_bytes.alias("n_bytes"), F.monotonically_increasing_id().alias("rid"), *extra), "texts")
    repeats_id = not small.groupBy("uid").count().where("count > 1").isEmpty()
    th = text_hash(small) if repeats_id else F.lit(0).cast("long")
    # The first row of each text, and the text itself: bucketed, so that the two later joins with texts move none of them.
    firsts = small.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min(F.struct("uid", th.alias("th"), "rid")).alias("p"))
    firsts = firsts.select(F.col("p.uid").alias("u"), F.col("p.th").alias("t"), "p.rid")
    texts = base.where(F.octet_length("text") >= length).select("uid", th.alias("th"), "text")
    if repeats_id:
        texts = texts.dropDuplicates(["uid", "th"])
    work = texts.join(firsts, same_text(repeats_id)).select("uid", "th", "rid", "text")
    name, n = f"suffix_texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "suffix-texts")
    work.write.bucketBy(n, *["uid", "th"][: 1 + repeats_id]).option("path", path).option("compression", "zstd").saveAsTable(name)
    work = spark.table(name)

    lists = lambda df, what, name: df.groupBy("uid", "th").agg(F.collect_list(what).alias(name)).withColumnsRenamed({"uid": "u", "th": "t"})
    # All lists below are of one text, and shorter than it.
    spots = materialize(lists(repeated(anchors(work, length, hot_anchors(work, length))), "pos", "spots"), "spots")
    ctx = contexts(work, spots, length, repeats_id).select(F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), "before", "after", "uid", "th", "pos")
    different = first_contexts(ctx, length)
    spans = lists(spans_of(different, length, group), F.struct("start", "stop"), "spans")
    known = spots.join(lists(different, "pos", "firsts"), ["u", "t"], "left").join(spans, ["u", "t"], "left")
    both = work.join(known, same_text(repeats_id), "left").select("rid", "text", "spots", "firsts", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            removed, runs, shas, kept = [], [], [], []
            for i in range(batch.num_rows):
                text, (spots, firsts, spans) = texts[i].as_py(), (batch.column(c)[i].as_py() for c in (2, 3, 4))
                lo, hi = whole_contexts(spots or [], firsts, len(text), length)
                more = np.array([(x["start"], x["stop"]) for x in spans or []], "i8").reshape(-1, 2)
                rest, gone, n_spans = cut(text, np.concatenate([lo, more[:, 0]]), np.concatenate([hi, more[:, 1]]))
                removed.append(gone)
                runs.append(n_spans)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if with_text else None)
            out = [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["first", "removed", "runs", "kept", "rest"])

    done = materialize(both.mapInArrow(run, "first long, removed long, runs long, kept string, rest string"), "cut")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, path)
    release(spots, different)
    rows = small.join(done, F.col("rid") == F.col("first"), "left")
    short, found = F.col("n_bytes") < length, F.col("first").isNotNull()
    if with_text:
        kept = F.when(short, F.col("short")).when(found, F.col("rest")).otherwise("")
        return rows.select(*(kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return rows.select(
        F.when(F.col("uid") == NO_ID, None).otherwise(F.col("uid")).alias("doc_id"),
        "n_bytes",
        F.when(short, 0).when(found, F.col("removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(short, 0).when(found, F.col("runs")).otherwise(1).cast("long").alias("n_spans"),
        F.when(short, F.col("sha")).when(found, F.col("kept")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
