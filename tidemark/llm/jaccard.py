"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two documents link when den * |intersection| >= num * |union| of their shingle sets. Sets that are equal are taken as
one. Let c(a) be the least overlap of a set of size a with any partner, and d = a - c(a) the most that it can lack.
Shingles have one order for all sets: those found frequent go last, by frequency, the rest by the frequency of their
rarest word, which bounds their own, and by hash. Then the k smallest
shared shingles of a linked pair are among the first d + k of either set.

* Light sets enumerate the subsets of two among their first d + 2 shingles; a linked pair shares one of them.
* Heavy sets, and light ones large enough to link with a heavy one, enter the inverted lists of their first d + 1
  shingles, which are scanned.
* The boundary between light and heavy is where the estimated cost is least: rows of subsets for light sets against
  rows of lists and pairs scanned in them for heavy ones, from counts over all sets by size.

A row stays in its list only if some other row there may link with it by sizes and by places in the order. Lists with the
same leader, their smallest set, make a group, to which each of its sets is sent once and whole. All pairs that a group's
lists allow are verified in its task, so that nothing but links leaves it: each set's tie to the smallest set that it reaches there, and its
number of links. A pair that several lists hold is counted in the list of its first shared shingle only.

A group of more sets or shingles than a task may hold is dealt out as pairs of blocks of its sets, each a task of its
own; so is a list of more than LIST_ROWS sets, without a look at its rows before. No pair is left out, whatever the size.

In a task, sketches save most of the work: a sketch has two to four bits for each shingle, the parity of the shingles
whose hash falls on it. Each bit in which two sketches differ stands for a shingle that only one of the sets has, so their
number bounds the overlap from above.

Words are lower-cased in A-Z only. A document with fewer words than a shingle has its whole sequence as one. Edge cases:
documents without words have an empty set and link with nothing, and a null text is one of them; a text of any length is
read whole; rows that repeat, with the same or another doc_id, are rows of their own in one class; null doc_ids are
never a class's smallest unless it has no other; doc_ids must be integers or cast to them; an empty table gives an empty
result; other columns, of whatever names and types, change neither classes nor links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import Bitmap, Scratch, lean, row_key
from .components import components

#: Shingles of so many documents of one stretch are counted at once.
COUNT_TOKENS = 1 << 20
#: Frequent shingles that go last in the order, and frequent words: at most HOT_LIST of either, found HOT_MIN times or more.
HOT_LIST, HOT_MIN = 1 << 18, 8
#: Cost of a pair that is met in a list, in rows of a list or of a subset.
PAIR_COST = 2.0
#: The longest sketch has 2**MOST_BITS bits.
MOST_BITS = 16
#: A longer list makes a group of its own, whose rows aren't looked at before it is dealt out.
LIST_ROWS = 4096
#: Sets and shingles of a group that one task may hold; a larger group is dealt out as pairs of blocks.
GROUP_SETS, GROUP_TOKENS = 4096, 1 << 21
#: Rows, and bytes of sets, that a task works on at once, or one group.
ROWS_AT_ONCE, BYTES_AT_ONCE = 30_000, 8 << 20
PAIRS_AT_ONCE = 1 << 18
U64 = np.uint64


@dataclass(frozen=True)
class Join:
    """Shingles of n words; the threshold is num / den, above one half."""

    n: int = 4
    num: int = 85
    den: int = 100

    def __post_init__(self) -> None:
        if not self.den < 2 * self.num <= 2 * self.den:
            raise ValueError("the threshold must be above 1/2 and at most 1")

    def overlap(self, a: int) -> int:
        """The least overlap of a set of this size with any partner."""
        return -(-self.num * a // self.den)

    def lacks(self, a: int) -> int:
        return a - self.overlap(a)

    def largest(self, a: int) -> int:
        """The largest size of a partner."""
        return self.den * a // self.num

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def kept_prefix(self, a: int) -> int:
        """How many of its first shingles are kept of a set, for lists and subsets."""
        return min(a, self.lacks(a) + 2)


@dataclass(frozen=True)
class Order:
    """What the order of shingles goes by: frequent shingles with their counts and frequent words with theirs, sorted by
    hash. It is the same for all sets; any other would give the same links at another cost."""

    hot: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        """A class of frequency of each word, 0 for words that aren't frequent; below 64."""
        return _found(self.words, self.word_counts, hashes)

    def of_shingles(self, tokens: np.ndarray) -> np.ndarray:
        return _found(self.hot, self.counts, tokens)


def _found(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(at), dtype=np.int64)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[i] == at, values[i], 0)


@dataclass(frozen=True)
class Sets:
    """The shingle sets of a chunk of rows, one after the other: row i (of the batch: base + i) has the sorted distinct
    hashes tokens[edge[i] : edge[i + 1]]."""

    base: int
    edge: np.ndarray
    tokens: np.ndarray
    rarest: np.ndarray | None  # of each token, with an order: the class of its rarest word
    words: np.ndarray  # hashes of all words, in the order of the texts
    whole: np.ndarray  # a hash of each row's words

    def __len__(self) -> int:
        return len(self.edge) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.edge)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as two signed numbers."""
        out = []
        for x in (self.tokens ^ U64(0x5851F42D4C957F2D), self.tokens + U64(0x14057B7EF767814F)):
            sums = np.zeros(len(x) + 1, dtype=U64)
            np.cumsum(_text.mixed(x), out=sums[1:])
            out.append((sums[self.edge[1:]] - sums[self.edge[:-1]]).view(np.int64))
        return out[0], out[1]

    def prefixes(self, order: Order, join: Join) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of each set in the order, one after the other, and their edges."""
        size = self.sizes()
        row = np.repeat(np.arange(len(self)), size)
        # by row, then by count, then by the rarest word; the sort is stable, and tokens of a row are sorted by hash
        rank = np.minimum(order.of_shingles(self.tokens), (1 << 36) - 1) << 6 | self.rarest
        at = np.argsort(rank | row << 42 if len(self) < 1 << 21 else rank, kind="stable")
        if len(self) >= 1 << 21:
            at = at[np.argsort(row[at], kind="stable")]
        keep = np.array([join.kept_prefix(a) for a in size.tolist()], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(keep)])
        pick = np.repeat(self.edge[:-1], keep) + np.arange(edge[-1]) - np.repeat(edge[:-1], keep)
        return self.tokens[at[pick]], edge


def shingle_sets(texts: pa.Array, n: int, order: Order | None = None) -> Iterator[Sets]:
    for base, buf, offs in _text.chunks(texts):
        buf = _text.lowered(buf)
        starts, ends, at = _text.words(buf, offs)
        of_words = _text.word_hashes(buf, starts, ends)
        count = np.diff(at)
        own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        row = np.repeat(np.arange(len(own)), own)
        first = np.repeat(at[:-1], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        size = np.repeat(np.minimum(count, n), own)
        grams = _text.Grams(of_words)
        hashes = grams(first, size)
        by = np.argsort(hashes)
        if len(own) < 1 << 16:
            by = by[np.argsort(row[by].astype(np.uint16), kind="stable")]  # by radix
        else:
            by = by[np.argsort(row[by], kind="stable")]
        hashes, row = hashes[by], row[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        rarest = None
        if order is not None:
            classes = order.of_words(of_words)
            first, size = first[by][new], size[by][new]
            rarest = classes[first]
            for k in range(1, n):
                rarest = np.minimum(rarest, classes[first + np.minimum(k, size - 1)])
        yield Sets(base, np.searchsorted(row[new], np.arange(len(own) + 1)), hashes[new], rarest, of_words, grams(at[:-1], count))


def frequent(docs: DataFrame, join: Join) -> Order:
    """Shingles that many documents have and words that occur often, as counted in stretches of the input. Only the order
    depends on them, never what links; both lists are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, total, seen = [], [], 0, set()

        def counted() -> Iterator[pa.RecordBatch]:
            for is_word, x in ((False, held), (True, words)):
                h, n = np.unique(np.concatenate(x) if x else np.zeros(0, U64), return_counts=True)
                own = n > 1 + is_word
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), is_word)), pa.array(h[own].view(np.int64)), pa.array(n[own])], names=["is_word", "h", "n"])

        for b in batches:
            for s in shingle_sets(b.column("text"), join.n):
                new = np.zeros(len(s), dtype=bool)  # equal texts of a stretch count once
                for i, x in enumerate(s.whole.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                held.append(s.tokens[np.repeat(new, s.sizes())])
                words.append(s.words)
                total += len(s.tokens)
                if total >= COUNT_TOKENS:
                    yield from counted()
                    held, words, total, seen = [], [], 0, set()
        yield from counted()

    found = docs.select("text").mapInArrow(lean(run), "is_word boolean, h long, n long").groupBy("is_word", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_MIN)
    scratch = Scratch(docs.sparkSession, "frequent")
    found = scratch.save(found, "found")
    out = []
    for is_word in (False, True):
        top = found.where(F.col("is_word") == is_word).orderBy(F.desc("n"), "h").limit(HOT_LIST).select("h", "n").toArrow()  # bounded
        h, n = top.column("h").to_numpy().view(U64), top.column("n").to_numpy()
        order = np.argsort(h)
        # words by classes of frequency: factors of two
        out += [h[order], np.floor(np.log2(n[order])).astype(np.int64) if is_word else n[order]]
    scratch.drop("found")
    return Order(*out)


def profiles(docs: DataFrame, join: Join, sent: object) -> DataFrame:
    """doc_id, row_key, n, fp_a, fp_b and prefix of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for b in batches:
            for s in shingle_sets(b.column("text"), join.n, order):
                fp_a, fp_b = s.fingerprints()
                values, edge = s.prefixes(order, join)
                rows = b.slice(s.base, len(s))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("row_key"), pa.array(s.sizes()), pa.array(fp_a), pa.array(fp_b), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["doc_id", "row_key", "n", "fp_a", "fp_b", "prefix"],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(lean(run), "doc_id long, row_key long, n long, fp_a long, fp_b long, prefix array<long>")


def boundary(sets: DataFrame, join: Join) -> int:
    """The size up to which sets are light: where the cost of all sets is least. Costs are by classes of sizes."""
    d = F.col("n") - F.ceil(F.col("n") * join.num / join.den)
    own = sets.withColumn("class", F.floor(F.log(1.1, F.col("n")))).withColumn("d", d)
    by_class = own.select("class", "n", "d", F.explode(F.slice("prefix", F.lit(1), (d + 1).cast("int"))).alias("t")).groupBy("class")
    rows = by_class.agg(F.max("n").alias("size"), F.count("*").alias("rows"), F.approx_count_distinct("t").alias("lists"), F.sum((F.col("d") + 2) / 2).alias("subsets"))
    light, heavy = 0.0, []
    for r in sorted(rows.collect(), key=lambda r: r["size"]):  # a few hundred classes at any size of the corpus
        length = max(1.0, r["rows"] / max(1, r["lists"]))
        heavy.append((r["size"], r["subsets"], r["rows"] * (1 + PAIR_COST * (length - 1))))
    left = sum(h for *_, h in heavy)
    best = (left, 0)
    for size, subsets, cost in heavy:
        light += subsets
        left -= cost
        best = min(best, (light + left, size))
    return best[1]


def subsets(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a light set's subsets of two among its first shingles, and their places: even numbers."""
    x, y = np.triu_indices(len(first), 1)
    p, q = np.minimum(first[x], first[y]), np.maximum(first[x], first[y])
    return _text.mixed(_text.mixed(p) + q) & ~U64(1), y - 1


def list_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists of shingles: odd numbers."""
    return _text.mixed(tokens) | U64(1)


def list_rows(sets: DataFrame, join: Join, light: int, sent: object) -> DataFrame:
    """key, n, place, sid, hot: rows of the inverted lists and of the subsets of two. place is such that a pair whose
    smallest shared shingles these are overlaps in n - place at most. hot are rows of lists that are known to be long."""
    border = join.overlap(light + 1)
    limit = LIST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for b in batches:
            sid, n = b.column("sid").to_numpy(), b.column("n").to_numpy()
            lists = b.column("prefix")
            edge, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            is_hot = order.of_shingles(values) > limit
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i in range(b.num_rows):
                a = int(n[i])
                d = join.lacks(a)
                if d == 0 and join.largest(a) == a:
                    continue  # only an equal set could link
                tokens = values[edge[i] : edge[i + 1]]
                if a <= light:
                    key, place = subsets(tokens[: d + 2])
                    out[0].append(key)
                    out[1].append(place)
                    out[2].append(np.full(len(key), i))
                    out[3].append(np.zeros(len(key), dtype=bool))
                if a >= border:
                    out[0].append(list_keys(tokens[: d + 1]))
                    out[1].append(np.arange(len(tokens[: d + 1])))
                    out[2].append(np.full(len(tokens[: d + 1]), i))
                    out[3].append(is_hot[edge[i] : edge[i] + d + 1])
            key, place, own, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(n[own].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sid[own]), pa.array(far.astype(bool))],
                names=["key", "n", "place", "sid", "hot"],
            )

    return sets.select("sid", "n", "prefix").mapInArrow(lean(run), "key long, n int, place int, sid long, hot boolean")


def allowed(join: Join, light: int, key: np.ndarray, n: np.ndarray, place: np.ndarray, new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list that may link by their sizes and places, the smaller set's row first. Rows are sorted by
    list and n; new marks the first row of each list. Pairs of light sets are left to the subsets."""
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(key)))
    end = np.repeat(at + size, size)
    n = n.astype(np.int64)
    largest = join.den * n // join.num
    # needed(a, b) <= a - place holds for b up to this
    most = (n - place) * (join.num + join.den) // join.num - n
    single = (key & 1).astype(bool)
    i, d = np.arange(len(key)), 1
    while len(i):
        i = i[i + d < end[i]]
        i = i[n[i + d] <= largest[i]]
        j = i + d
        ok = (n[j] <= most[i]) & (n[i] <= most[j]) & ~(single[i] & (n[j] <= light))
        yield i[ok], j[ok]
        d += 1


def grouped(rows: DataFrame, join: Join, light: int) -> DataFrame:
    """grp, key, n, place, sid: rows of lists that have a partner there, by the list's leader, the smallest sid among
    them. A list of more than LIST_ROWS rows passes as it is, in chunks, and is a group of its own."""
    limit = LIST_ROWS

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
        held: list[pa.RecordBatch] = []
        count, long = 0, None  # the key of a list that is passing
        for b in batches:
            while b.num_rows:
                if long is not None:
                    own = int(np.searchsorted(b.column("key").to_numpy(), long, side="right"))
                    if own:
                        yield pa.Table.from_batches([b.slice(0, own)]), True
                    long, b = (long if own == b.num_rows else None), b.slice(own)
                    continue
                held.append(b)
                count += b.num_rows
                b = b.slice(b.num_rows)
                if count > 2 * limit:
                    t = pa.Table.from_batches(held)
                    key = t.column("key").to_numpy()
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield t.slice(0, cut), False
                    rest = t.slice(cut)
                    if rest.num_rows > limit:
                        yield rest, True
                        held, count, long = [], 0, key[-1]
                    else:
                        held, count = rest.to_batches(), rest.num_rows
        if count:
            yield pa.Table.from_batches(held), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "key", "n", "place", "sid"]
        for t, long in lists(batches):
            key, n, place, sid = (t.column(c).to_numpy() for c in names[1:])
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, key, n, place, sid)], names=names)
                continue
            new = np.append(True, key[1:] != key[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(key)))
            keep = np.repeat(size > 1, size)
            key, n, place, sid, new = key[keep], n[keep], place[keep], sid[keep], new[keep]
            if not len(key):
                continue
            size = size[size > 1]
            grp = key.copy()
            far = np.repeat(size > limit, size)
            keep = far.copy()
            near = np.flatnonzero(~far)
            for i, j in allowed(join, light, key[near], n[near], place[near], new[near]):
                keep[near[i]] = keep[near[j]] = True
            of = np.cumsum(new) - 1
            some = np.flatnonzero(keep & ~far)
            if len(some):
                at = np.flatnonzero(np.append(True, of[some][1:] != of[some][:-1]))
                lead = np.minimum.reduceat(sid[some], at)
                grp[some] = np.repeat(lead, np.diff(np.append(at, len(some))))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (grp, key, n, place, sid)], names=names)

    schema = "grp long, key long, n int, place int, sid long"
    near = rows.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(lean(run), schema)
    return near.union(rows.where("hot").select(F.col("key").alias("grp"), "key", "n", "place", "sid"))


def dealt(lists: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of lists, and distinct grp, sid, with part and block: a group that is too large for a task is cut into blocks
    of its sets, and each pair of blocks is a part. A set goes to all parts of its block."""
    own = lists.select("grp", "sid", "n").distinct()
    weight = own.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(2 * F.col("sets") / GROUP_SETS, 2 * F.col("tokens") / GROUP_TOKENS)).cast("int")
    large = weight.where((F.col("sets") > GROUP_SETS) | (F.col("tokens") > GROUP_TOKENS)).select(F.col("grp").alias("g"), blocks.alias("blocks"))
    large = scratch.save(large, "large")
    if large.isEmpty():
        whole = {"part": F.lit(0).cast("long"), "block": F.lit(-1)}
        return lists.withColumns(whole), own.withColumns(whole)

    def parts(df: DataFrame) -> DataFrame:
        df = df.join(large, F.col("grp") == F.col("g"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        df = df.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")
        # in a part of two blocks only pairs of sets of either are compared
        return df.withColumn("part", part).withColumn("block", F.when(F.expr("part % blocks = part div blocks"), -1).otherwise(F.col("block"))).drop("g", "blocks", "other")

    return parts(lists), parts(own)


def whole_sets(docs: DataFrame, join: Join, bitmap: object) -> DataFrame:
    """fp_a, fp_b and tokens of the documents whose row_key is in the bitmap. Other texts aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.flatnonzero(bitmap.value.has(b.column("row_key").to_numpy().view(U64)))
            if not len(own):
                continue
            for s in shingle_sets(b.column("text").take(pa.array(own)), join.n):
                fp_a, fp_b = s.fingerprints()
                edge = pa.array((8 * s.edge).astype(np.int32))
                blobs = pa.Array.from_buffers(pa.binary(), len(s), [None, edge.buffers()[1], pa.py_buffer(s.tokens.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(fp_a), pa.array(fp_b), blobs], names=["fp_a", "fp_b", "tokens"])

    return docs.select("row_key", "text").mapInArrow(lean(run), "fp_a long, fp_b long, tokens binary")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by the low bits of their hashes, as 64-bit words; their number is a power of two."""
    bits = 1 << max(6, min(MOST_BITS, (len(tokens) - 1).bit_length() + 1))
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Sketches in rows, of that many words: what shorter sketches of the same sets would be."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def overlaps(tokens: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in pairs, for x in ascending order."""
    out = np.empty(len(x), dtype=np.int64)
    edge = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        own = tokens[x[lo]]
        at = lo
        while at < hi:  # some partners at once
            to = min(hi, at + max(1, PAIRS_AT_ONCE // max(1, len(own))))
            theirs = [tokens[k] for k in y[at:to]]
            every = np.concatenate(theirs)
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            out[at:to] = np.add.reduceat(hit, np.concatenate([[0], np.cumsum([len(t) for t in theirs])[:-1]]), dtype=np.int64)
            at = to
    return out


def tied(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """parent, with the ends of these pairs tied together: each node's root, the smallest node that it reaches."""
    up = parent.tolist()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    parent = np.array(up, dtype=np.int64)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


class Group:
    """The sets of some groups, each group's own, with their lists, in one task."""

    def __init__(self, sets: pa.Table, join: Join, light: int) -> None:
        self.join, self.light = join, light
        self.sid = sets.column("sid").to_numpy()
        self.copies = sets.column("copies").to_numpy()
        self.tokens = [np.frombuffer(x.as_buffer(), dtype=U64) for c in sets.column("tokens").chunks for x in c]
        self.prefix = [x.values.to_numpy().view(U64) for c in sets.column("prefix").chunks for x in c if x.is_valid]
        self.n = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.block = sets.column("block").to_numpy()
        self._sketches: dict[int, np.ndarray] = {}

    def may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs may link by their sketches."""
        need = 2 * self.join.needed(self.n[x], self.n[y])
        differ = np.empty(len(x), dtype=np.int64)
        width = np.frompyfunc(lambda a: 1 << max(0, min(MOST_BITS, (a - 1).bit_length() + 1) - 6), 1, 1)(np.minimum(self.n[x], self.n[y])).astype(np.int64)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            met, at = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
            rows = np.stack([folded(sketch(self.tokens[k]), int(w)) for k in met])
            step = max(1, BYTES_AT_ONCE // (8 * int(w)))
            for lo in range(0, len(own), step):
                i, j = at[: len(own)][lo : lo + step], at[len(own) :][lo : lo + step]
                differ[own[lo : lo + step]] = np.bitwise_count(rows[i] ^ rows[j]).sum(1, dtype=np.int64)
        return self.n[x] + self.n[y] - differ >= need

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = overlaps(self.tokens, x, y)
        return self.join.den * both >= self.join.num * (self.n[x] + self.n[y] - both)

    def first_shared(self, x: int, y: int) -> int:
        """The key of the list in which a linked pair is counted: of its first shared shingle, or first two if both are
        light."""
        a, b = self.prefix[x], self.prefix[y]
        if self.n[x] <= self.light and self.n[y] <= self.light:
            a, b = a[: self.join.lacks(len(self.tokens[x])) + 2], b[: self.join.lacks(len(self.tokens[y])) + 2]
            two = a[np.isin(a, b)][:2]
            return int(subsets(two)[0][0])
        a, b = a[: self.join.lacks(len(self.tokens[x])) + 1], b[: self.join.lacks(len(self.tokens[y])) + 1]
        return int(list_keys(a[np.isin(a, b)][:1])[0])


def _pairs(group: Group, key: np.ndarray, n: np.ndarray, place: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Distinct pairs x < y of sets that share a list, as x * number of sets + y, sorted."""
    every, fresh, count = [np.zeros(0, np.int64)], [], 0
    total = len(group.n)
    for i, j in allowed(group.join, group.light, key, n, place, new):
        x, y = at[i], at[j]
        ok = (group.block[x] == -1) | (group.block[x] != group.block[y])
        fresh.append(np.minimum(x, y)[ok] * total + np.maximum(x, y)[ok])
        count += len(fresh[-1])
        if count > 8 * PAIRS_AT_ONCE:
            every, fresh, count = [np.unique(np.concatenate(every + fresh))], [], 0
    return np.unique(np.concatenate(every + fresh))


def _links(t: pa.Table, join: Join, light: int, count: bool) -> pa.RecordBatch:
    """Of whole groups: a, b, for each set that has a link the smallest of those that it reaches by links of its group,
    if that isn't itself; with count also a, null, n: a set's number of links to other sets' documents."""
    grp, part = t.column("grp").to_numpy(), t.column("part").to_numpy()
    number = np.cumsum(np.append(False, (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])))
    is_set = t.column("key").is_null().to_numpy()
    of_set = np.flatnonzero(is_set)
    sid = t.column("sid").to_numpy()
    again = np.append(False, (number[of_set][1:] == number[of_set][:-1]) & (sid[of_set][1:] == sid[of_set][:-1]))
    of_set = of_set[~again]  # a set that several equal rows gave
    group = Group(t.take(pa.array(of_set)), join, light)
    lists = t.filter(pa.array(~is_set))
    key, n, place = (lists.column(c).to_numpy() for c in ("key", "n", "place"))
    known, dense = np.unique(sid, return_inverse=True)
    code = number * len(known) + dense
    order = np.argsort(code[of_set])
    at = order[np.searchsorted(code[of_set], code[~is_set], sorter=order)] if len(of_set) else np.zeros(0, np.int64)
    if not np.array_equal(code[of_set][at], code[~is_set]):
        raise RuntimeError("a set of a list is missing")
    own = number[~is_set]
    new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    pairs = _pairs(group, key, n, place, at, new)
    total = len(group.n)
    parent, degree = np.arange(total), np.zeros(total, dtype=np.int64)
    heads = np.unique(np.stack([own, key]), axis=1) if count and len(key) else None
    codes = set(zip(*heads.tolist(), strict=True)) if heads is not None else set()
    for lo in range(0, len(pairs), PAIRS_AT_ONCE):
        x, y = np.divmod(pairs[lo : lo + PAIRS_AT_ONCE], max(1, total))
        ok = group.may(x, y)
        x, y = x[ok], y[ok]
        at, step = 0, len(x) if count else 512
        while at < len(x):
            i, j = x[at : at + step], y[at : at + step]
            at += step
            if not count:  # pairs of one class needn't be looked at
                step = min(2 * step, PAIRS_AT_ONCE)
                ok = parent[i] != parent[j]
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            ok = group.linked(i, j)
            i, j = i[ok], j[ok]
            parent = tied(i, j, parent)
            if count:
                home = number[of_set]
                here = np.array([(home[p], np.uint64(group.first_shared(p, q)).view(np.int64)) in codes for p, q in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
                np.add.at(degree, i[here], group.copies[j[here]])
                np.add.at(degree, j[here], group.copies[i[here]])
    some = np.flatnonzero(degree)
    # stars around the smallest sid, so that what is left to do across groups takes few steps
    least = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(least, parent, group.sid)
    far = np.flatnonzero(least[parent] != group.sid)
    ends = pa.concat_arrays([pa.array(least[parent][far], pa.int64()), pa.nulls(len(some), pa.int64())])
    times = np.concatenate([np.ones(len(far), dtype=np.int64), degree[some]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([group.sid[far], group.sid[some]]), pa.int64()), ends, pa.array(times)], names=["a", "b", "n"])


def linked(rows: DataFrame, join: Join, light: int, count: bool) -> DataFrame:
    """a, b, n as ``_links`` has them, of all groups. rows has a group's sets (key null) and the rows of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows * BYTES_AT_ONCE // ROWS_AT_ONCE + b.column("tokens").nbytes
            if size >= BYTES_AT_ONCE:
                t = pa.Table.from_batches(held)
                grp, part = t.column("grp").to_numpy(), t.column("part").to_numpy()
                last = np.flatnonzero((grp != grp[-1]) | (part != part[-1]))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield _links(t.slice(0, cut), join, light, count)
                    rest = t.slice(cut)
                    held = rest.to_batches()
                    size = rest.num_rows * BYTES_AT_ONCE // ROWS_AT_ONCE + sum(x.column("tokens").nbytes for x in held)
        if held:
            yield _links(pa.Table.from_batches(held), join, light, count)

    return rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "key", "n", "sid").mapInArrow(lean(run), "a long, b long, n long")


def classed(docs: DataFrame, join: Join, count: bool = False) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and root, a number of the class, null for empty sets; with count also
    n_links, the number of documents that the document links with."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), "text")
    scratch = Scratch(spark, "jaccard")
    sent = spark.sparkContext.broadcast(frequent(docs, join))  # at most HOT_LIST shingles and words
    rows = scratch.save(profiles(docs, join, sent), "profiles")
    own = rows.where("n > 0").groupBy("fp_a", "fp_b").agg(
        F.min("doc_id").alias("rep"), F.min("row_key").alias("rep_key"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    sets = scratch.save(own.withColumn("sid", F.monotonically_increasing_id()), "sets")
    light = boundary(sets, join)
    lists = scratch.save(grouped(list_rows(sets, join, light, sent), join, light), "lists")
    of_lists, of_sets = dealt(lists, scratch)
    extra = ["prefix"] if count else []  # what tells in which list a link is counted
    there = scratch.save(of_sets.join(sets.select("sid", "fp_a", "fp_b", "rep_key", "copies", *extra), "sid"), "wanted")
    # the other prefixes have done their part, and most of the space is theirs
    rows = scratch.save(rows.drop("prefix"), "members")
    sets = scratch.save(sets.select("sid", "fp_a", "fp_b", "rep", "copies"), "classes-of")
    scratch.drop("profiles", "sets")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(there.select("rep_key").distinct()))  # of bounded size
    whole = whole_sets(docs, join, bitmap)
    none = lambda kind: F.lit(None).cast(kind)
    prefix = F.col("prefix") if count else none("array<long>").alias("prefix")
    of_sets = there.join(whole, ["fp_a", "fp_b"]).select("grp", "part", none("long").alias("key"), F.col("n").cast("int").alias("n"), none("int").alias("place"), "sid", "block", "copies", prefix, "tokens")
    of_lists = of_lists.select("grp", "part", "key", "n", "place", "sid", "block", none("long").alias("copies"), none("array<long>").alias("prefix"), none("binary").alias("tokens"))
    found = scratch.save(linked(of_sets.union(of_lists), join, light, count), "links")
    scratch.drop("lists", "wanted")
    roots = components(found.where("b is not null").select("a", "b"), scratch, "classes")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    of_set = sets.select("sid", "fp_a", "fp_b", "rep", "copies").join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
    least = of_set.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least, "root").join(degree, F.col("sid") == F.col("node"), "left")
    of_set = of_set.select("fp_a", "fp_b", "component_id", "root", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "row_key", "n", "fp_a", "fp_b").join(of_set, ["fp_a", "fp_b"], "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return out if count else out.drop("n_links")


def classes(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, the smallest doc_id that the document reaches by links, itself included, and
    n_links, the number of other documents that it links with. Documents of equal sets link."""
    return classed(docs, join or Join(), count=True).select("doc_id", "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """One row of docs for each class, with all of its columns: that of the smallest doc_id. Of rows without words that
    are equal in all columns but maps, one stays; other rows without words stay."""
    found = classed(docs, join or Join())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    keep = found.where(F.col("root").isNotNull()).groupBy("root").agg(first.alias("f")).select("f.doc_id", "f.row_key")
    keep = keep.union(found.where(F.col("root").isNull()).select("doc_id", "row_key").distinct())
    keep = keep.select(F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key"))
    # the row is one column beside the helpers, whatever its own columns are called
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("of_text"))
    kept = rows.join(keep, (F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return kept.dropDuplicates(["key", "id", "of_text"]).select("row.*")
