"""Best-fit packing by the sum-of-squares rule.

Tokenise every document, cut what is longer than a sequence, and place each
piece so that the sum of the squared counts of open bins per residual gap
becomes smallest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import claim, documents, materialize

CAPACITY = 2048
#: Pieces that one task packs; the number of shards grows with the input.
SHARD_PIECES = 4096
#: Words that a worker's cache holds before it is emptied.
CACHE = 500_000
#: Bytes of text that are encoded at once (or one document, if it is longer).
STEP_BYTES = 4 << 20
#: Words that are given to the tokenizer's model as one text.
JOINED = 512


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(values: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(256, "u1")
    for some, v in values.items():
        out[np.frombuffer(some, "u1")] = v
    return out


#: What a byte is to the tokenizer: 0 white space, 1 letter, 2 digit, 3 other sign, 4 what it alone can judge.
_KIND = _table({b" \t\n\x0b\x0c\r": 0, bytes(range(0x21, 0x7F)): 3, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ": 1, b"0123456789": 2, b"'\x7f" + bytes(set(range(0x20)) - set(b"\t\n\x0b\x0c\r")): 4, bytes(range(0x80, 0x100)): 4})
#: Second bytes of letters after 0xC3 (all but the signs of multiplication and division), and capitals among them.
_LATIN = _table({bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}): 1})
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Ids of texts, as one array and the number of ids of each text.

    No token of a tokenizer that drops white space crosses ASCII white space, so
    the ids of a text are those of its chunks in turn. A chunk of ASCII and Latin
    letters is cut further, as the tokenizer cuts it: runs of letters, single digits,
    runs of other signs, in lower case. Words that a bounded cache doesn't hold go to
    the tokenizer's model, many in one text. Other chunks (with an apostrophe, other
    letters, a special token) go to the whole tokenizer, as do all chunks where the
    tokenizer's normaliser and cutting rule aren't those that this knows.
    """

    #: The rules that cutting here repeats: fixed values of the tokenizer's file.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        norm, pre, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told["model"]
        same = [x["type"] for x in norm.get("normalizers", [])] == self.NORMALIZERS and [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])] == [self.CUT, None] and model.get("end_of_word_suffix") == "</w>"
        self.model = None
        if same:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        self.empty()

    def empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts = np.zeros(1 << 12, "i8")

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.number), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + k + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + k + 1] = self.used + np.cumsum(lengths)
        self.number.update(zip(words, range(n, n + k), strict=True))
        self.used += len(ids)

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that the cache doesn't hold."""
        plain = [w for w in words if PLAIN.fullmatch(w) and b"<|" not in w] if self.model else []
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            got = np.array(self.model.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[got])
            if len(last) == len(some):  # each word ends in a token that ends words
                self._keep(some, got, np.diff(last, prepend=-1))
        others = [w for w in words if w not in self.number] if len(plain) < len(words) or len(self.number) < len(words) else []
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            got = [g.ids for g in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
            self._keep(some, np.array([i for g in got for i in g], "<u4"), np.array([len(g) for g in got], "i8"))

    def words(self, data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that lie one after another, and how many each text has."""
        kind = _KIND[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[_LATIN[data[latin + 1]] == 1]
        kind[latin] = kind[latin + 1] = 1
        data = data.copy()
        solid = kind > 0
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[edges[:-1][edges[:-1] < len(data)]] = True  # a text's start cuts
        starts &= solid
        signs = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.ones(len(data), bool) if self.model is None else kind == 4
        odd[signs] = True
        if odd.any():  # whole chunks around
            chunk = np.cumsum(starts) - 1
            whole = np.zeros(chunk[-1] + 2, bool)
            whole[chunk[odd & solid]] = True
            odd = whole[chunk] & solid
        lower = _LOWER[data]
        capital = latin[(data[latin + 1] < 0x9F)] + 1
        lower[capital] += 32
        data = np.where(odd, data, lower)
        cut = kind == 2
        cut[1:] |= kind[1:] != kind[:-1]
        starts |= cut & solid & ~odd
        at = np.flatnonzero(starts)
        kept = np.cumsum(solid, dtype="i4")
        offsets = np.concatenate([kept[at] - 1, kept[-1:]]).astype("i4")
        found = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))])
        return found, np.diff(np.searchsorted(at, edges))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of a string array without nulls."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8")
        edges = np.concatenate([[0], np.cumsum(sizes)])
        if not edges[-1]:
            return np.empty(0, "<u4"), np.zeros(len(texts), "i8")
        raw = texts.cast(pa.binary())
        begin = np.frombuffer(raw.buffers()[1], "<i4", 1, 4 * raw.offset)[0]
        words, n_words = self.words(np.frombuffer(raw.buffers()[2], "u1", edges[-1], begin), edges)
        if not len(words):
            return np.empty(0, "<u4"), np.zeros(len(texts), "i8")
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.number) + len(known) > self.limit:
            self.empty()
        number = self.number
        self.learn([w for w in known if w not in number])
        codes = np.fromiter(map(number.__getitem__, known), "i8", len(known))[coded.indices.to_numpy()]
        first = self.starts[codes]
        n = self.starts[codes + 1] - first
        ends = np.cumsum(n)
        where = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return self.ids[where], np.diff(total)


#: One encoder for each tokenizer file in a Python worker.
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))


def forget() -> None:
    """Empties what this worker holds; a function of the module, so that tasks reach the module's own table."""
    _encoders.clear()


def _steps(sizes: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``step`` bytes."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, side="right")))
        yield lo, hi
        lo = hi


def tokenize_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32[, ids])``.

    A null or empty text has only the end id. A document that is longer than
    ``capacity`` is cut; its last piece may be shorter. Other columns are
    ignored. Repeated rows give repeated pieces. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", forget)
        encode = encoder(path).encode
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in _steps(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                ids, n = encode(texts.slice(lo, hi - lo))
                last = np.cumsum(n)
                ids, n = np.insert(ids, last, end_id), n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                edges = np.concatenate([[0], np.cumsum(length)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                out = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edges.astype("i4")), pa.array(ids.astype("i4"))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed longest first.

    Of the open bins that fit, the one is taken whose change of gap lowers the
    sum of squared gap counts most (the tightest among equals). A bin is opened
    only when none fits. Weighed by the rule too, an opening sometimes wins
    while a bin fits, and that costs sequences: 18005 against 17953 on 37925
    pieces of check_l, where 17952 is the least possible.
    """
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    counts = np.zeros(capacity + 1, "i8")  # open bins per gap; full bins aren't open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        gaps = s + np.flatnonzero(counts[s:])
        if len(gaps):
            # (N[g]-1)^2 + (N[g-s]+1)^2 - N[g]^2 - N[g-s]^2 = 2 (N[g-s] - N[g]) + 2, or 1 - 2 N[g] where the bin fills up
            change = 2 * (counts[gaps - s] - counts[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * counts[s]
            g = int(gaps[np.argmin(change)])
            b = stacks[g].pop()
            counts[g] -= 1
        else:
            g, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            counts[g - s] += 1
            stacks[g - s].append(b)
    return bins, offsets


def plan(lengths: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``lengths(key, length)`` with unique keys -> ``(key, sequence_id, offset)``.

    A hash of the key deals pieces to shards of about ``shard_pieces``, whose
    number follows the input, and each is packed alone. Longest first, nearly all
    of a shard's bins end full. The pieces of the others, from all shards,
    are dealt and packed anew, round by round while they become fewer by a quarter at
    least, in the end in one shard. So about as many sequences come out as from one packing
    of all pieces (77592 from 40 shards of half of check_l, where 77586 is the least
    possible), and no task packs all.
    """

    def packing(number: int):
        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "descending"), ("key", "ascending")]))
            size = rows["length"].to_numpy()
            bins, offsets = sum_of_squares(size, capacity)
            full = np.bincount(bins, size)[bins] >= capacity
            return pa.table([rows["key"], rows["length"], pa.array((number << 56) + (key[0].as_py() << 24) + bins), pa.array(offsets), pa.array(full)], names=["key", "length", "sequence_id", "offset", "full"])

        return pack

    left, n, out, number = lengths.select("key", "length"), lengths.count(), None, 0
    while True:
        shards = max(1, -(-n // shard_pieces))
        keyed = left.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(number)), F.lit(shards)))
        packed = materialize(keyed.groupBy("shard").applyInArrow(packing(number), "key long, length long, sequence_id long, offset long, full boolean"), "packed")
        rest = packed.where("not full").count() if shards > 1 else 0
        more = 0 < rest <= 0.75 * n
        # What isn't full is placed by a later round, if there is one.
        kept = packed.where("full") if more else packed
        kept = kept.select("key", "sequence_id", "offset")
        out = kept if out is None else out.unionAll(kept)
        if not more:
            return out
        left, n, number = packed.where("not full").select("key", "length"), rest, number + 1


def place(pieces: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length``, all other columns kept.

    Rows are numbered as they are written, so that equal rows have places of their own
    and a task that runs again numbers nothing anew. Sequences are planned over
    lengths alone; rows move once, to meet their places. Rows of an empty table: none.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialize(pieces.select(*names, F.monotonically_increasing_id().alias("__key")), "pieces")
    places = plan(rows.select(F.col("__key").alias("key"), "length"), capacity=capacity, shard_pieces=shard_pieces)
    return rows.join(places, F.col("__key") == F.col("key")).select(*names, "sequence_id", "offset")


def digested(placed: DataFrame) -> DataFrame:
    """``placed`` without its ``ids``; ``length`` and ``ids_crc32`` are taken anew from them."""
    names = [c for c in placed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(names))
            at = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            new = {"length": np.diff(at).astype("i8"), "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], "i8")}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(i) for i, c in enumerate(names)], names=names)

    return placed.select(*names, "ids").mapInArrow(run, placed.select(*names).schema)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset``. Empty table: no rows. See ``tokenize_pieces`` for
    nulls, empty and long texts; ties and repeated rows are placed like others.
    """
    return place(tokenize_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), capacity=capacity, shard_pieces=shard_pieces)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece, and the digest of the ids that are packed there."""
    return digested(place(tokenize_pieces(documents(spark, sf_dir))))
