"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Documents longer than a sequence are cut into pieces of its capacity; what is left over is their first piece. Best-fit
decreasing runs over counts of equal lengths, not over pieces: all pieces of one length are placed by a few records,
each of which says which sequences take how many of them, and where. Pieces then take the planned places by their rank
within their length, and carry their ids there. The histogram and the plan are bounded by the capacity, whatever the
number of documents.

Edge cases: a null text is empty, and an empty document is its closing id alone; a text of any length is tokenised
whole; repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, lean

CAPACITY = 1024
END_ID = 2
#: Parts of a length's pieces that are ranked apart, so that a common length is ranked by many tasks.
PARTS = 64
#: There are more of them if all pieces were of one length and a part had more than so many of them.
PART_ROWS = 1 << 18
#: Pieces of text whose ids a worker remembers; further ones are encoded each time.
CACHE = 400_000
CACHED_CHARS = 64
#: Pieces that a worker gives back at once: with their ids, 8 MB at most at a capacity of 1024.
OUT_ROWS = 2048
#: The byte-level tokenizer's split of a text; no merge crosses it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit integers. Pieces of a text are encoded once and remembered."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex

        self.path = path
        self.cut = regex.compile(PIECES).findall
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.merge = self._ranked(path)

    @functools.cached_property
    def model(self) -> object:
        """The tokenizer itself, which few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(path: str) -> Callable[[str], list[int]] | None:
        """The same merges by rank tables, which take a tenth of the time a piece, where ids ascend as merges do."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab["".join(m)] for m in pairs]
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        if ids != sorted(set(ids)) or ids and max(vocab.get(c, 0) for c in byte) > ids[0]:
            return None
        merged = set(ids)
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece)).tobytes() if self.merge and LITTLE else self.whole(piece)
        if len(self) < CACHE and len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # these are cut out before the split
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.cut(text)))


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of every piece; the first piece of a long document has what is left
    over. Ids are little-endian unsigned 32-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            rows: list[tuple[int, int, int, int, int, bytes]] = []
            for i, text in enumerate(b.column("text")):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                lo, k = 0, 0
                hi = n % capacity or min(n, capacity)
                while lo < n:
                    own = ids[4 * lo : 4 * hi]
                    rows.append((i, k, lo, hi - lo, zlib.crc32(own), own))
                    lo, hi, k = hi, hi + capacity, k + 1
                    if len(rows) == OUT_ROWS:
                        yield as_batch(b, rows)
                        rows = []
            yield as_batch(b, rows)

    def as_batch(b: pa.RecordBatch, rows: list[tuple[int, int, int, int, int, bytes]]) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(ids, pa.binary())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


#: A record of the plan: pieces of this length with ranks from first to end go, each at a time, to sequences from
#: sequence on, at this offset.
Place = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Place]:
    """Best-fit decreasing over counts: (length, first, end, each, sequence, offset) records.

    Pieces of one length go, one by one, to the open sequence with the least room that suffices. A sequence that took
    one has less room and, if still enough, is the best fit again; so sequences of equal room are filled in a row with
    room // length pieces each, and a whole class of them is one record.
    """
    rooms: list[int] = []  # rooms that open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of sequences)
    out: list[Place] = []
    new = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted((x for x, c in counts.items() if c > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, new
                n = -(-left // (capacity // length))
                new += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - full_length(each, length), first, full)
            first, n = first + full, n - full
            if left and n:  # the last sequence takes fewer
                out.append((length, rank, rank + left, left, first, capacity - room))
                put(room - full_length(left, length), first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return out


def full_length(each: int, length: int) -> int:
    return each * length


class Lookup:
    """The plan by length, for searching ranks in it."""

    def __init__(self, places: list[Place]) -> None:
        self.by: dict[int, np.ndarray] = {}
        for length in {p[0] for p in places}:
            self.by[length] = np.array(sorted(p[1:] for p in places if p[0] == length), dtype=np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for x in np.unique(length):
            own = length == x
            rows = self.by[int(x)]
            at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
            i = rank[own] - at[:, 0]
            sequence[own] = at[:, 3] + i // at[:, 2]
            offset[own] = at[:, 4] + i % at[:, 2] * x
        return sequence, offset


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and ids of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, path or tokenizer_path(), capacity, end_id)
    cut = scratch.save(cut, "pieces")  # texts are tokenised once
    # so many parts of a length that none has many more than PART_ROWS rows, even if all pieces are of one length
    parts = max(PARTS, -(-cut.count() // PART_ROWS))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    sent = spark.sparkContext.broadcast(Lookup(plan(total, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("r", F.row_number().over(inside)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("r") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = sent.value
        for b in batches:
            sequence, offset = look(b.column("length").to_numpy(), b.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), b.column("ids")], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every packed sequence, from the rows of packed(). A sequence has no more pieces
    than its capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.unhex(F.array_join(F.transform(own, lambda x: F.hex(x["ids"])), ""))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
