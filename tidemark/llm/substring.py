"""Removal of passages that an earlier document has, over a log-structured fingerprint index.

A window is WINDOW consecutive words of one document; a word goes when a window that covers it also starts in a document
with a smaller doc_id. Windows are judged on the input.

Every window has an anchor: the gram of ANCHOR words in it with the smallest hash. Equal windows have equal anchors, and
neighbouring windows mostly share theirs, so an index of anchors is a small part of an index of windows and misses none
of them. The index is a log of immutable runs, sorted by hash: which documents have which anchors. It lives in a folder,
with a manifest for each version, and can be opened again.

A batch of documents, whose ids are above all earlier ones, is joined with the index: its anchors are merge-joined with
each run. Anchors that a run has too, or several documents of the batch, are the candidates. They are verified by the
hashes of whole windows, which are independent of the anchors' hashes: two windows are taken as equal when both are. For
that, earlier documents are read again from the archive, but only those are hashed that a run names for a candidate.
The batch's marks are the result; its own anchors become a new run, without those all of whose windows an earlier
document has, so that a passage that everyone quotes stays in the index once. Runs of one level are compacted into one of
the next.

Anchors of more rows than a group may have are hot. Their windows are compared by a pre-aggregated minimum and a join
that can be split, not in a group.

Edge cases: a null text has no words; documents of fewer words than a window lose nothing; documents without an id lose
nothing and take nothing; documents that share an id never take words from one another, and rows that repeat lose the
same words; a text of any length is read whole; doc_ids must be integers or cast to them; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._store import Bitmap, Scratch, lean

WINDOW, ANCHOR = 50, 16
#: Windows of one row: their marks are the bits of a long.
UNIT = 60
#: A group of more rows is hot.
GROUP_ROWS = 2000
BATCHES = 2
FANOUT = 2
#: Rows whose windows are compared at once, or one group.
COMPARE_ROWS = 20_000


def anchored(buf: np.ndarray, offs: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Windows' first words, rows, hashes and anchors; then the index of each row's first word."""
    starts, ends, at = _text.words(buf, offs)
    hashes = _text.word_hashes(buf, starts, ends)
    n = len(hashes)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), at
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least = _text.Grams(hashes, seed=1)(np.arange(n - anchor + 1), anchor)
    span, step = window - anchor + 1, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: -(span - step)], least[span - step :])
    first = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    return first, row[first], _text.Grams(hashes)(first, window), least[first], at


def units(row: np.ndarray, first: np.ndarray, anchor: np.ndarray, most: int) -> np.ndarray:
    """Starts of stretches of at most that many windows of one row and anchor that follow each other."""
    if not len(row):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(row)))
    parts = -(-size // most)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(at, parts) + k * most


def anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """h, doc, n: the anchors of each document and how many windows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for base, buf, offs in _text.chunks(b.column("text")):
                first, row, _, least, _ = anchored(buf, offs, window, anchor)
                at = units(row, first, least, UNIT)
                size = np.diff(np.append(at, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(ids[base + row[at]].astype(np.int64)), pa.array(size)], names=["h", "doc", "n"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(lean(run), "h long, doc long, n long")
    return rows.groupBy("h", "doc").agg(F.sum("n").alias("n"))


class FingerprintIndex:
    """Which documents have which anchors, as a log of runs in a folder: anchor (h) and doc, sorted by h."""

    SCHEMA = "h long, doc long"

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, anchor: int = ANCHOR) -> None:
        """Opens the folder's latest version, or begins anew where it has none."""
        self.spark, self.folder, self.window, self.anchor = spark, folder.rstrip("/"), window, anchor
        self.version, self.written, self.last = 0, 0, None
        self.runs: list[tuple[int, str]] = []  # (level, name), oldest first
        versions = [int(n[1:]) for n in self._names("manifest") if n[:1] == "v"]
        if versions:
            x = json.loads(spark.read.text(f"{self.folder}/manifest/v{max(versions):06d}").head()[0])
            if (x["window"], x["anchor"]) != (window, anchor):
                raise ValueError(f"the index in {folder} has windows of {x['window']} words with anchors of {x['anchor']}")
            self.version, self.written, self.last = x["version"], x["written"], x["last"]
            self.runs = [(level, name) for level, name in x["runs"]]

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"run-{self.written:05d}-level-{level}"
        self.written += 1
        df.select("h", "doc").repartition("h").sortWithinPartitions("h", "doc").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        self.runs.append((level, name))

    def _commit(self) -> None:
        """A new manifest; runs that it doesn't name any more go after it is there."""
        self.version += 1
        x = {"version": self.version, "written": self.written, "last": self.last, "window": self.window, "anchor": self.anchor, "runs": self.runs}
        self.spark.createDataFrame([(json.dumps(x),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v{self.version:06d}")
        for name in set(self._names("")) - {name for _, name in self.runs} - {"manifest"}:
            path, fs = self._path(name)
            fs.delete(path, True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{name}")

    def join(self, batch: DataFrame, archive: DataFrame | None = None) -> DataFrame:
        """The batch's marks: doc, th, pos and mask. Both have doc_id, text and th, a hash of the text; the archive has all
        documents that were joined before. Afterwards the index holds the batch too."""
        scratch = Scratch(self.spark, "fingerprints")
        ends = batch.agg(F.min("doc_id"), F.max("doc_id")).head()
        if ends[0] is None:
            return self.spark.createDataFrame([], "doc long, th long, pos long, mask long")
        if self.last is not None and ends[0] <= self.last:
            raise ValueError(f"a batch must have ids above {self.last}")
        own = scratch.save(anchor_rows(batch, self.window, self.anchor), "own")
        heads = own.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
        heads = scratch.save(heads, "heads")
        # each run is sorted by h; a run has an anchor as often as documents have it
        hits = None
        for _, name in self.runs:
            met = self.read(name).hint("merge").join(heads.select("h"), "h", "left_semi")
            hits = met if hits is None else hits.union(met)
        shared = heads.where("lo < hi").select("h", "n")
        older = None
        if hits is not None:
            hits = scratch.save(hits, "hits")
            met = hits.groupBy("h").agg(F.count("*").alias("n"))
            shared = shared.union(met).union(heads.where("lo = hi").join(met.select("h"), "h", "left_semi").select("h", "n")).groupBy("h").agg(F.sum("n").alias("n"))
            older = archive.where(F.col("doc_id").isNotNull())
        shared = scratch.save(shared, "shared")
        sc = self.spark.sparkContext
        sent = sc.broadcast((Bitmap.of(shared.select("h")), Bitmap.of(shared.where(F.col("n") > GROUP_ROWS).select("h"))))
        any_hot = not shared.where(F.col("n") > GROUP_ROWS).isEmpty()
        named = sc.broadcast(Bitmap.of(hits.select(F.xxhash64("doc").alias("doc")).distinct())) if hits is not None else None
        marks = marked(batch, older, named, sent, any_hot, self.window, self.anchor)
        if self.last is not None:
            marks = marks.where(F.col("doc") > self.last)
        marks = scratch.save(marks, "marks")
        # an anchor all of whose windows in a document are marked isn't needed there
        gone = marks.groupBy(F.col("anchor").alias("a"), F.col("doc").alias("d")).agg(F.sum(F.bit_count("mask")).alias("m"))
        left = own.join(gone, (F.col("h") == F.col("a")) & (F.col("doc") == F.col("d")), "left").where(F.coalesce("m", F.lit(0)) < F.col("n"))
        self._write(left, 0)
        self.last = ends[1]
        while len(self.runs) >= FANOUT and len({level for level, _ in self.runs[-FANOUT:]}) == 1:
            self.compact(FANOUT)
        self._commit()
        scratch.drop("own", "heads", "hits", "shared")
        return marks.drop("anchor")

    def compact(self, newest: int) -> None:
        """The newest runs become one."""
        old = self.runs[-newest:]
        out = self.read(old[0][1])
        for _, name in old[1:]:
            out = out.union(self.read(name))
        del self.runs[-newest:]
        self._write(out, max(level for level, _ in old) + 1)


def shared_windows(docs: DataFrame, named: object | None, sent: object, want_hot: bool, window: int, anchor: int) -> DataFrame:
    """anchor, doc, th, pos, w: stretches of windows with a candidate as their anchor, and the windows' hashes. Documents
    that named hasn't, where it is given, aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hots = sent.value
        for b in batches:
            if named is not None:
                b = b.filter(pa.array(named.value.has(b.column("key").to_numpy().view(np.uint64))))
            if not b.num_rows:
                continue
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            for base, buf, offs in _text.chunks(b.column("text")):
                first, row, hashes, least, at = anchored(buf, offs, window, anchor)
                start = units(row, first, least, UNIT)
                keep = bitmap.has(least[start])
                keep &= hots.has(least[start]) == want_hot
                end = np.append(start, len(first))[1:][keep]
                start = start[keep]
                blobs = [hashes[i:j].tobytes() for i, j in zip(start, end, strict=True)]
                own = row[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[start].view(np.int64)), pa.array(ids[base + own].astype(np.int64)), pa.array(th[base + own]), pa.array((first[start] - at[own]).astype(np.int64)), pa.array(blobs, pa.binary())],
                    names=["anchor", "doc", "th", "pos", "w"],
                )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "th", "text", F.xxhash64("doc_id").alias("key"))
    return rows.mapInArrow(lean(run), "anchor long, doc long, th long, pos long, w binary")


def _marks(rows: pa.Table) -> pa.RecordBatch:
    """Of whole groups: the rows with windows that a smaller doc has, and a bit for each such window."""
    anchor, doc = rows.column("anchor").to_numpy(), rows.column("doc").to_numpy()
    blobs = rows.column("w").to_pylist()
    n = np.array([len(x) // 8 for x in blobs])
    hashes = np.frombuffer(b"".join(blobs), dtype=np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
    order = np.lexsort((doc[row], hashes, group[row]))
    g, h, d = group[row][order], hashes[order], doc[row][order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(row), dtype=np.int64)
    gone[order] = d > least
    mask = np.add.reduceat(gone << bit, np.cumsum(n) - n)
    keep = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(keep)) for c in ("anchor", "doc", "th", "pos")] + [pa.array(mask[keep])], names=["anchor", "doc", "th", "pos", "mask"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole groups are compared, many small ones at once."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= COMPARE_ROWS:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # signed order, as Spark sorts
            if cut:
                yield _marks(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
    if count:
        yield _marks(pa.Table.from_batches(held))


def marked(batch: DataFrame, older: DataFrame | None, named: object | None, sent: object, any_hot: bool, window: int, anchor: int) -> DataFrame:
    """anchor, doc, th, pos, mask: windows to remove, of the batch and of the earlier documents that it is compared with."""

    def rows(hot: bool) -> DataFrame:
        out = shared_windows(batch, None, sent, hot, window, anchor)
        return out if older is None else out.union(shared_windows(older, named, sent, hot, window, anchor))

    out = rows(False).repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(lean(_compared), "anchor long, doc long, th long, pos long, mask long")
    if any_hot:
        each = rows(True).mapInArrow(lean(_exploded), "anchor long, w long, doc long, th long, pos long")
        least = each.groupBy("anchor", "w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi")
        gone = each.join(least, ["anchor", "w"]).where("doc > lo")
        out = out.unionByName(gone.select("anchor", "doc", "th", "pos", F.lit(1).cast("long").alias("mask")))
    return out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = b.column("w").to_pylist()
        n = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, d, t = (b.column(c).take(row) for c in ("anchor", "doc", "th"))
        pos = b.column("pos").to_numpy()[row.to_numpy()] + bit
        yield pa.RecordBatch.from_arrays([a, pa.array(np.frombuffer(b"".join(blobs), dtype=np.int64)), d, t, pa.array(pos)], names=["anchor", "w", "doc", "th", "pos"])


def batches_of(docs: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame]]:
    """The documents in at most n batches of ascending doc_id, each with the documents before it."""
    cuts = [int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01)] if n > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    some = docs.where(F.col("doc_id").isNotNull())
    above = lambda df, x: df if x is None else df.where(F.col("doc_id") > x)
    upto = lambda df, x: df if x is None else df.where(F.col("doc_id") <= x)
    return [(upto(above(some, lo), hi), upto(some, lo)) for lo, hi in zip(edges, edges[1:], strict=False)]


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with texts also kept, the words that stay, joined by one space."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    index = FingerprintIndex(spark, scratch.path("index"), window, anchor)
    marks = None
    for part, before in batches_of(docs, batches):
        new = index.join(part, before)
        marks = new if marks is None else marks.union(new)
    marks = marks.distinct().groupBy("doc", "th").agg(F.collect_list("pos").alias("pos"), F.collect_list("mask").alias("mask"))
    met = docs.join(marks, (F.col("doc_id") == F.col("doc")) & (docs["th"] == marks["th"]), "left").select("doc_id", "text", "pos", "mask")
    bits = np.arange(UNIT)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n_words, n_removed, sha, kept = [], [], [], []
            pos_of, mask_of = b.column("pos").to_pylist(), b.column("mask").to_pylist()
            for base, buf, offs in _text.chunks(b.column("text")):
                raw = buf.tobytes()
                starts, ends, at = _text.words(buf, offs)
                for i in range(len(at) - 1):
                    lo, hi = at[i], at[i + 1]
                    s, e = starts[lo:hi], ends[lo:hi]
                    pos = pos_of[base + i]
                    if pos:
                        set_ = (np.array(mask_of[base + i], dtype=np.int64)[:, None] >> bits) & 1 > 0
                        where = (np.array(pos, dtype=np.int64)[:, None] + bits)[set_]
                        edge = np.zeros(hi - lo + 1, dtype=np.int64)
                        np.add.at(edge, where, 1)
                        np.add.at(edge, where + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        s, e = s[stay], e[stay]
                    text = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    n_words.append(int(hi - lo))
                    n_removed.append(int(hi - lo) - len(s))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept.append(text.decode())
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * texts, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    return met.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
