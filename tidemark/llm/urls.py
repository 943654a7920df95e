"""URL filters over a sorted digest array.

Rules are pairs of a host and a path prefix. Their 64-bit xxhash keys are kept as one sorted array beside the rules'
full strings. The whole index is one block of bytes, which a worker spools into a file of its own and memory-maps. A
URL is judged by probing the keys of all its host suffixes with all path prefixes of the lengths that occur among the
rules, by vectorised binary search; a hit counts only when the stored string equals the probed one, so colliding
digests do no harm.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty host fits none; a
URL of any length is read whole; rows are judged one by one, so repeated rows get the same verdict; without rules every
URL gets the default verdict.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, lean

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
#: An index beyond this many bytes isn't sent to all workers: each range of digests goes to one task instead.
BROADCAST_BYTES = 256 << 20
_HEAD = 4


def pack(rules: tuple[tuple[str, str, str], ...]) -> bytes:
    """The index: counts, sorted keys, flags, offsets, strings; then the path lengths that occur."""
    texts = [f"{host}{path}".encode() for _, host, path in rules]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0, *(len(texts[i]) for i in order)]).astype(np.int64)
    flags = np.array([rules[i][0] == "allow" for i in order], dtype=np.uint8)
    host_len = np.array([len(rules[i][1].encode()) for i in order], dtype=np.int64)
    lengths = np.array(sorted({len(r[2].encode()) for r in rules}), dtype=np.int64)
    head = np.array([len(texts), len(lengths), ends[-1], 0], dtype=np.int64)
    return b"".join([head.tobytes(), keys[order].tobytes(), ends.tobytes(), host_len.tobytes(), lengths.tobytes(), flags.tobytes(), b"".join(texts[i] for i in order)])


class DigestArray:
    """A packed index, memory-mapped."""

    def __init__(self, packed: bytes) -> None:
        fd, name = tempfile.mkstemp(prefix="digests-")
        with os.fdopen(fd, "wb") as f:
            f.write(packed)
        raw = np.memmap(name, dtype=np.uint8, mode="r")
        os.unlink(name)  # the mapping keeps it
        n, m, size, _ = raw[: 8 * _HEAD].view(np.int64)
        at = 8 * _HEAD
        parts = []
        for count, kind in ((n, np.uint64), (n + 1, np.int64), (n, np.int64), (m, np.int64)):
            parts.append(raw[at : at + 8 * count].view(kind))
            at += 8 * int(count)
        self.keys, self.ends, self.host_len, self.lengths = parts
        self.host_lengths, self.lengths = frozenset(self.host_len.tolist()), tuple(self.lengths.tolist())
        self.flags = raw[at : at + n]
        self.text = raw[at + int(n) : at + int(n) + int(size)]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of each probe's rule, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1, dtype=np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else ():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal digests stand side by side
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def rule(self, j: int) -> str:
        return self.text[self.ends[j] : self.ends[j + 1]].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of each URL and its verdict."""
        probes, owner, host_of = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for probe, n in probes_of(host.encode(), path.encode(), self.host_lengths, self.lengths):
                probes.append(probe)
                owner.append(i)
                host_of.append(n)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for k in np.flatnonzero((found := self.find(probes)) >= 0):
            i, j = owner[k], int(found[k])
            if self.host_len[j] == host_of[k] and (rules[i] is None or len(self.rule(j)) > len(rules[i])):
                rules[i], verdicts[i] = self.rule(j), "allow" if self.flags[j] else "block"
        return rules, verdicts


def probes_of(host: bytes, path: bytes, host_lengths: frozenset[int], lengths: tuple[int, ...]) -> Iterator[tuple[bytes, int]]:
    """What a URL may have among the rules: the host and its parent domains, of lengths that occur there, each with the
    path's beginnings of lengths that occur; and the length of the host part. No more of a host is looked at than the
    longest of the rules', so a host of any length takes few probes."""
    if not host or not host_lengths:
        return
    tail = host[-max(host_lengths) - 1 :]
    ends = [len(host)] if len(host) in host_lengths else []
    ends += [n for k, c in enumerate(tail) if c == 46 and (n := len(tail) - k - 1) in host_lengths]
    for n in ends:
        for m in lengths:
            if m <= len(path):
                yield host[len(host) - n :] + path[:m], n


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict. rules are tuples, or a DataFrame of verdict, host and path."""
    host, path = host_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    Scratch(spark, "urls")
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 40)).head()[0] or 0
        if size > BROADCAST_BYTES:
            return _ranged(cut, rules, size, default)
        rules = tuple((r["verdict"], r["host"], r["path"]) for r in rules.select("verdict", "host", "path").collect())  # of a checked size
    packed = pack(rules)
    if len(packed) > BROADCAST_BYTES:
        return _ranged(cut, spark.createDataFrame(rules, "verdict string, host string, path string"), len(packed), default)
    sent = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(sent.value)
        for b in batches:
            rule, verdict = index.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(cut.dtypes)["page_id"]
    return cut.mapInArrow(lean(run), f"page_id {kind}, host string, path string, rule string, verdict string")


def _ranged(cut: DataFrame, rules: DataFrame, size: int, default: str) -> DataFrame:
    """The same for rules too many to send to every worker: they are cut into ranges of a hash, each a sorted digest
    array of its own that one task maps, and to which the probes of its range come, each distinct one once."""
    ranges = 4 * -(-size // max(1, BROADCAST_BYTES)) + 1
    rules = rules.select("verdict", "host", "path")
    longest = rules.agg(F.collect_set(F.octet_length("host")), F.collect_set(F.octet_length("path"))).head()  # lengths: few
    hosts, lengths = frozenset(longest[0]), tuple(sorted(longest[1]))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                out += [(h, p, q.decode(errors="surrogateescape"), n) for q, n in probes_of(h.encode(), p.encode(), hosts, lengths) if _whole(q)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["host", "path", "probe", "n"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, own, waiting = None, None, [], []
        for b in batches:
            for r, is_probe, text, n, verdict in zip(*(b.column(c).to_pylist() for c in ("range", "is_probe", "text", "n", "verdict")), strict=True):
                if r != now:
                    if waiting:
                        yield hits(index, waiting)
                    index, now, own, waiting = None, r, [], []
                if not is_probe:
                    own.append((verdict, text.encode()[:n].decode(), text.encode()[n:].decode()))
                    continue
                if index is None:
                    index = DigestArray(pack(tuple(own)))
                waiting.append((text, n))
                if len(waiting) >= 4096:
                    yield hits(index, waiting)
                    waiting = []
        if waiting:
            yield hits(index, waiting)

    rule_rows = rules.select(F.lit(False).alias("is_probe"), F.concat("host", "path").alias("text"), F.octet_length("host").alias("n"), "verdict")
    probes = cut.select("host", "path").where("host <> ''").distinct().mapInArrow(lean(asked), "host string, path string, probe string, n int")
    probe_rows = probes.select(F.lit(True).alias("is_probe"), F.col("probe").alias("text"), "n", F.lit(None).cast("string").alias("verdict")).distinct()
    rows = rule_rows.union(probe_rows).withColumn("range", (F.shiftrightunsigned(F.xxhash64("text"), 32) * ranges / 2**32).cast("int"))
    rows = rows.repartition("range").sortWithinPartitions("range", "is_probe")
    hit = rows.mapInArrow(lean(found), "text string, n int, verdict string")
    best = (
        probes.join(hit.withColumnsRenamed({"text": "probe", "n": "rule_n"}), "probe")
        .where("n = rule_n")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("probe", "verdict"), F.octet_length("probe")).alias("b"))
    )
    return cut.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.probe").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict")
    )


def _whole(probe: bytes) -> bool:
    """Not cut within a character, as no rule's path is."""
    try:
        probe.decode()
    except UnicodeDecodeError:
        return False
    return True


def hits(index: DigestArray, probes: list[tuple[str, int]]) -> pa.RecordBatch:
    at = index.find([t.encode() for t, _ in probes])
    own = [(t, n, "allow" if index.flags[j] else "block") for (t, n), j in zip(probes, at.tolist(), strict=True) if j >= 0 and index.host_len[j] == n]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], names=["text", "n", "verdict"])
