"""Near-duplicate texts with small edits (problem 3): vantage-point trees over lossless fingerprints.

A text is the set of its runs of three words, each a 40-bit hash; similarity is
that of the sets (Jaccard). Its *fingerprint* is a parity sketch: every run
flips one of at least 1.5 bits per run, 128 at least (a power of two, so that
halves may be folded onto each other to compare sketches of two lengths). Two sets that differ in d runs have sketches at a
Hamming distance of at most d, and similarity t of sets with a and b runs means
d <= (1-t)/(1+t) * (a+b). So a search within that radius loses nothing, and
because the Hamming distance is a metric, the triangle inequality may prune.

One tree over all texts cannot prune: unrelated texts all lie at about the same
distance from any vantage point (README, "Near duplicates"). The top level of
the search therefore routes texts into shards by their rarest runs - two similar
sets share k runs among the first n - ceil(t*n) + k in any fixed order of runs -
and vantage-point trees search inside shards. Where a shard has so few pairs of
like sizes that naming them takes less room than sending sketches to it, the
pairs are named and counted over all shards, those that share fewer runs than a
similar pair must fall away, and the rest is searched as a ball around its
first member. A shard too large for a task is
partitioned by the distance to a vantage point, texts in the boundary zone going
to both sides, until the parts are small; a part that does not shrink is
compared block by block. Pairs that pass the tree are compared exactly, run by run. Every step is exact
up to collisions of 40-bit hashes within a pair of texts and of the 64-bit
hashes that stand for whole sets.

What is shuffled by run is packed: a task sends one compressed block of sorted
columns to each target instead of a row for each run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.session import Scratch

THRESHOLD = 0.7
WORDS = 3
LEAST_WORDS = 30
BITS = 128
#: Counters of the table that orders runs: a power of two from half the number of runs, within these bounds (one byte each).
LEAST_COUNTERS, MOST_COUNTERS = 1 << 22, 1 << 27
#: Members up to which one task searches a shard.
SHARD = 2000
#: Members up to which the pairs of a shard are looked at, and pairs of like sizes per member up to which they are named
#: instead of sending sketches: a pair takes some ten bytes, a sketch some forty.
SMALL, NAMED = 64, 4
#: Runs that similar sets must share in their prefixes (fewer for tiny sets); prefixes are longer by as much.
SHARED = 4
_PASS = 1 << 20
#: Runs that one target may get, which bounds the memory of its task.
_TARGET = 2_000_000
_U = np.uint64
#: Bits of a set's short name, by which shards know it; sets with one short name are told apart before the exact comparison.
_SHORT = _U((1 << 40) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class Shingler:
    """Sets of hashed word runs, computed for many texts at once."""

    def __init__(self) -> None:
        self.word = np.zeros(256, bool)
        self.word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        self._powers(_PASS)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sets(self, texts: list[str | None], words: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, sorted distinct hashes) of every text with at least ``least`` words."""
        group: list[bytes] = []
        numbers: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not t or len(t) < 2 * least - 1:
                continue
            raw = t.lower().encode("utf-8", "replace")
            if group and size + len(raw) > _PASS - 1:
                yield from self._pass(group, numbers, words, least)
                group, numbers, size = [], [], 0
            group.append(raw)
            numbers.append(i)
            size += len(raw) + 1
        if group:
            yield from self._pass(group, numbers, words, least)

    def _pass(self, group: list[bytes], numbers: list[int], words: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
        data = np.frombuffer(b"\0".join(group) + b"\0", np.uint8)
        if len(data) > len(self.up):
            self._powers(2 * len(data))
        inside = self.word[data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[: len(data)], out=run[1:])
        h = _mix((run[e] - run[s]) * self.down[s] ^ ((e - s).astype(_U) << _U(56)))
        ends = np.cumsum([len(g) + 1 for g in group])
        first = np.concatenate([[0], np.searchsorted(s, ends)])
        n = len(h) - words + 1
        if n <= 0:
            return
        joint = np.zeros(n, _U)
        for k in range(words):
            joint = _mix(joint + h[k : k + n] * _U(2 * k + 0x9E3779B1))
        for g, number in enumerate(numbers):
            a, b = first[g], first[g + 1]
            if b - a >= max(least, words):
                yield number, np.unique(joint[a : b - words + 1] >> _U(24))


def sketch(runs: np.ndarray) -> bytes:
    bits = BITS
    while bits < 1.5 * len(runs) and bits < 1 << 22:
        bits *= 2
    return np.packbits((np.bincount((runs >> _U(8)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sk: bytes | np.ndarray, size: int = BITS // 8) -> np.ndarray:
    """A sketch in ``size`` bytes: still at most as far from another as the sets differ."""
    a = np.frombuffer(sk, np.uint8) if isinstance(sk, bytes) else sk
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def pack_runs(runs: np.ndarray) -> bytes:
    """Five bytes per run."""
    return runs.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack_runs(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(_U).ravel()


def set_id(runs: np.ndarray) -> int:
    """64-bit identity of a set; equal sets are exact copies of each other."""
    n = _U(len(runs))
    a = _mix(runs + _U(0x632BE59BD9B4E019)).sum(dtype=_U)
    return int((_mix(np.array([a ^ (n << _U(48))]))[0]).astype(np.int64))


def shared_runs(n: np.ndarray | int, t: float):  # noqa: ANN201 - as n
    """How many runs of their prefixes two similar sets share at least, by the smaller set's size."""
    return np.minimum(SHARED, np.ceil(t * n - 1e-9)).astype(np.int64)


def prefix_length(n: int, t: float) -> int:
    """Similar sets share ``shared_runs`` of their first so many runs, in any fixed order of all runs."""
    return n - math.ceil(t * n - 1e-9) + int(shared_runs(n, t))


def needed_runs(least: np.ndarray, most: np.ndarray, t: float) -> np.ndarray:
    """How many runs the prefixes of two similar sets of these sizes share at least.

    Of all common runs those beyond the prefix that ends first are at most the
    rest of its set; the others are in both prefixes.
    """
    common = np.ceil(t / (1 + t) * (least + most) - 1e-9).astype(np.int64)
    rest = [np.ceil(t * n - 1e-9).astype(np.int64) - shared_runs(n, t) for n in (least, most)]
    return np.maximum(shared_runs(least, t), common - np.maximum(*rest))


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers byte by byte, compressed; the first is to be ascending and is stored by its steps."""
    planes = []
    for i, c in enumerate(columns):
        c = c.astype(_U)
        planes.append((np.diff(c, prepend=_U(0)) if i == 0 else c).view(np.uint8).reshape(-1, 8).T.tobytes())
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_columns(packed: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=size, codec="zstd"), np.uint8).reshape(columns, 8, -1) if size else np.zeros((columns, 8, 0), np.uint8)
    out = [np.ascontiguousarray(p.T).view(_U).ravel() for p in planes]
    out[0] = np.cumsum(out[0], dtype=_U)
    return out


def text_sets(texts: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """(id, cls, n, sketch, runs): one row per text with enough words; ``cls`` is equal for equal sets."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            at, cls, n, sk, raw = [], [], [], [], []
            for i, runs in shingler.sets(batch.column(1).to_pylist(), words, least):
                at.append(i)
                cls.append(set_id(runs))
                n.append(len(runs))
                sk.append(sketch(runs))
                raw.append(pack_runs(runs))
            ids = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), pa.array(raw, pa.binary())],
                names=[id_col, "cls", "n", "sketch", "runs"],
            )

    return texts.select(id_col, text_col).where(F.length(text_col) >= 2 * least - 1).mapInArrow(
        run, f"`{id_col}` {kind}, cls bigint, n int, sketch binary, runs binary"
    )


def _counters(values: DataFrame, places, size: int, names: str = "block int, counts binary") -> np.ndarray:  # noqa: ANN001
    """How often each of ``size`` places occurs, as eighths of its logarithm (0 never, 8 once, from 9 on more often).

    ``places`` gives the places of a batch. Tasks send what they counted in
    compressed blocks, blocks are added up in tasks of their own, and the
    driver gets ``size`` bytes.
    """
    block = min(size, 1 << 18)

    def blocks(at: np.ndarray) -> Iterator[pa.RecordBatch]:
        where, n = np.unique(at, return_counts=True)
        cut = np.searchsorted(where, np.arange(0, size + block, block))
        some = np.flatnonzero(np.diff(cut))
        if len(some):
            packed = [pack_columns(where[cut[b] : cut[b + 1]] - b * block, n[cut[b] : cut[b + 1]]) for b in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        for batch in batches:
            held.append(places(batch, seen))
            if sum(map(len, held)) > 4_000_000:
                yield from blocks(np.concatenate(held))
                held = []
        if held:
            yield from blocks(np.concatenate(held))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for v in pdf["counts"]:
            where, n = unpack_columns(v, 2)
            total[where.astype(np.int64)] += n.astype(np.int64)
        logs = np.where(total > 0, np.minimum(8 * np.log2(np.maximum(total, 1)) + 8, 255), 0).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [pa.compress(logs.tobytes(), codec="zstd", asbytes=True)]})

    out = np.zeros(size, np.uint8)
    for r in values.mapInArrow(count, names).groupBy("block").applyInPandas(add, names).collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(pa.decompress(r.counts, decompressed_size=block, codec="zstd"), np.uint8)
    return out


def _power(n: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def frequencies(sets: DataFrame, runs: int) -> np.ndarray:
    """How often runs occur over all texts (copies within a task counted once), by hash.

    The table orders the runs: any order is exact, a rare-first one is fast.
    Different runs may share a counter, which only makes them seem more
    frequent. So a run that was counted once is in one set and leads nowhere.
    """
    size = _power(runs // 2, LEAST_COUNTERS, MOST_COUNTERS)

    def places(batch: pa.RecordBatch, seen: set[int]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c not in seen:
                if len(seen) < 1_000_000:
                    seen.add(c)
                out.append((unpack_runs(v) % _U(size)).astype(np.int64))
        return np.concatenate(out)

    return _counters(sets.select("cls", "runs"), places, size)


def _keys(sets: DataFrame, table: np.ndarray, t: float, hot: int, targets: int) -> DataFrame:
    """The rarest runs of every set as (target, packed) blocks, or (shard, short) rows for runs that are common everywhere.

    Runs that were counted once are left out. Copies inside a task are passed over.
    """
    shared = sets.sparkSession.sparkContext.broadcast(table)  # at most MOST_COUNTERS bytes
    often = 8 * math.log2(hot) + 8

    def blocks(names: list[int], sizes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        lengths = [len(k) for k in keys]
        key, at = np.concatenate(keys), np.repeat(np.arange(len(keys)), lengths)
        order = np.argsort(key % _U(targets) << _U(40) | key, kind="stable")  # keys have 40 bits, targets fewer than 2^24
        key, at = key[order], at[order]
        cut = np.searchsorted((key % _U(targets)).astype(np.int64), np.arange(targets + 1))
        short, size = np.array(names, np.int64).view(_U) & _SHORT, np.array(sizes, _U)
        some, packed, tables = np.flatnonzero(np.diff(cut)), [], []
        for b in some.tolist():
            members, own = np.unique(at[cut[b] : cut[b + 1]], return_inverse=True)
            by_name = np.argsort(short[members], kind="stable")
            place = np.empty(len(members), np.int64)
            place[by_name] = np.arange(len(members))
            packed.append(pack_columns(key[cut[b] : cut[b + 1]], place[own]))
            tables.append(pack_columns(short[members][by_name], size[members][by_name]))
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary()), pa.array(tables, pa.binary()), none, none], names=["target", "packed", "members", "shard", "short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        names: list[int] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            common = [(np.zeros(0, _U), np.zeros(0, np.int64))]
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                runs = unpack_runs(raw)
                df = counts[(runs % _U(len(counts))).astype(np.int64)]
                order = np.lexsort((runs, df))[: prefix_length(len(runs), t)]
                own, f = runs[order], df[order]
                if (f > often).any():
                    common.append((own[f > often], np.full(int((f > often).sum()), c & int(_SHORT))))
                own = own[(f > 8) & (f <= often)]
                if len(own):
                    names.append(c)
                    sizes.append(len(runs))
                    keys.append(own)
            if len(common) > 1:
                k, c = (np.concatenate(x) for x in zip(*common))
                none = pa.nulls(len(k), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), none, none, pa.array(k.view(np.int64)), pa.array(c)], names=["target", "packed", "members", "shard", "short"])
            if sum(map(len, keys)) > 2_000_000:
                yield blocks(names, sizes, keys)
                names, sizes, keys = [], [], []
        if keys:
            yield blocks(names, sizes, keys)

    return sets.select("cls", "runs").mapInArrow(run, "target int, packed binary, members binary, shard bigint, short bigint")


def _shards(keys: DataFrame, small: int, t: float, targets: int) -> DataFrame:
    """What sets that share keys: (target, pairs, shard, short).

    A key with up to ``small`` members and few pairs of like sizes gives these
    pairs, in packed blocks (a, b, how often seen, number of shared keys of a
    similar pair) for ``targets`` targets. Any other key gives a shard with a
    row for each member; equal lists of members make one shard. A similar pair
    either shares a shard or is counted often enough: nothing is lost. A target
    has ``_TARGET`` runs on average, and a run that more than ``hot`` sets have
    is not among them, so a task holds one target at a time.
    """
    names = ["target", "pairs", "shard", "short"]
    ordered = keys.repartition("target").sortWithinPartitions("target")

    def pairs_of(c: np.ndarray, n: np.ndarray, lo: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """(lists that become shards, pairs of the others) of lists of one size."""
        i, j = np.triu_indices(size, 1)
        large, out = [], []
        for k in range(0, len(lo), max(1, 1_000_000 // len(i))):
            at = lo[k : k + max(1, 1_000_000 // len(i)), None] + np.arange(size)
            nn = n[at]
            least, most = np.minimum(nn[:, i], nn[:, j]), np.maximum(nn[:, i], nn[:, j])
            like = least >= t * most - 1e-9
            many = like.sum(1) > NAMED * size
            large.append(at[many, 0])
            like[many] = False
            row, col = np.nonzero(like)
            cc = c[at]
            out.append((cc[row, i[col]], cc[row, j[col]], needed_runs(least[row, col], most[row, col], t)))
        return np.concatenate(large), out

    def digest(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((c, k))
        k, c, n = k[order], c[order], n[order]
        own = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])  # copies from other tasks
        k, c, n = k[own], c[own], n[own].astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        m = np.diff(np.append(lo, len(k)))
        found, large = [], [lo[m > small]]
        for size in np.unique(m[(m > 1) & (m <= small)]).tolist():
            more, pairs = pairs_of(c, n, lo[m == size], size)
            large.append(more)
            found += pairs
        if found:
            a, b, need = (np.concatenate(x) for x in zip(*found))
            target = (_mix(a ^ _mix(b)) % _U(targets)).astype(np.int64)
            order = np.lexsort((b, a, target))
            a, b, need, target = a[order], b[order], need[order], target[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            seen = np.diff(np.append(first, len(a)))
            a, b, need, target = a[first], b[first], np.minimum(need[first], 65535), target[first]
            cut = np.searchsorted(target, np.arange(targets + 1))
            some = np.flatnonzero(np.diff(cut))
            packed = [pack_columns(*(x[cut[g] : cut[g + 1]] for x in (a, b, seen, need))) for g in some.tolist()]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary()), none, none], names=names)
        length = dict(zip(lo.tolist(), m.tolist()))
        lists: dict[int, np.ndarray] = {}
        for at in np.concatenate(large).tolist():
            members = c[at : at + length[at]]
            lists.setdefault(set_id(members), members)
        if lists:
            g = np.repeat(np.fromiter(lists, np.int64, len(lists)), [len(x) for x in lists.values()])
            none = pa.nulls(len(g), pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(np.concatenate(list(lists.values())).astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for target, packed, members in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if target != current and held:
                    yield from digest(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                current = target
                key, at = unpack_columns(packed, 2)
                short, n = unpack_columns(members, 2)
                held.append((key, short[at.astype(np.int64)], n[at.astype(np.int64)]))
        if held:
            yield from digest(*(np.concatenate(x) for x in zip(*held)))

    return ordered.select("target", "packed", "members").mapInArrow(run, "target int, pairs binary, shard bigint, short bigint")


def _counted(shared: DataFrame) -> DataFrame:
    """(a, b), short names, of the pairs that were seen often enough over all targets."""
    ordered = shared.repartition("target").sortWithinPartitions("target")

    def digest(a: np.ndarray, b: np.ndarray, seen: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a))
        a, b, seen, need = a[order], b[order], seen[order].astype(np.int64), need[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        # Of sets with one short name the least need counts.
        ok = first[np.add.reduceat(seen, first) >= np.minimum.reduceat(need, first)]
        return pa.RecordBatch.from_arrays([pa.array(a[ok].astype(np.int64)), pa.array(b[ok].astype(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for target, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if target != current and held:
                    yield digest(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                current = target
                held.append(unpack_columns(packed, 4))
        if held:
            yield digest(*(np.concatenate(x) for x in zip(*held)))

    return ordered.select("target", "pairs").mapInArrow(run, "a bigint, b bigint")


def _close_pairs(pairs: DataFrame, sketches: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: classes of the pairs of short names whose sketches lie in the ball of a similar pair around the first."""
    one = sketches.select(F.col("short").alias("a"), F.col("cls").alias("c_a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("short").alias("b"), F.col("cls").alias("c_b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))

    @F.pandas_udf("int")
    def hamming(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            size = min(len(p), len(q))
            out.append(int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum()))
        return pd.Series(out, dtype="int32")

    near = F.lit((1 - t) / (1 + t)) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-9)
    found = pairs.join(one, "a").join(two, "b").where(hamming("x", "y") <= near)
    return found.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))


def _distances(rows: DataFrame) -> DataFrame:
    """Adds ``d``, the Hamming distance of ``sketch`` and ``vantage``."""

    @F.pandas_udf("int")
    def hamming(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.stack([fold(s) for s in a]) ^ np.stack([fold(s) for s in b]) if len(a) else np.zeros((0, 1), np.uint8)
        return pd.Series(np.bitwise_count(x).sum(1).astype(np.int32))

    return rows.withColumn("d", hamming("sketch", "vantage"))


def divide(shards: DataFrame, points: DataFrame, scratch: Scratch, limit: int, t: float, rounds: int = 16) -> DataFrame:
    """Shards of more than ``limit`` members, cut by vantage points with overlapping boundaries.

    Round by round every large shard takes its member of least ``cls`` as
    vantage point and the median distance mu as radius. Members within mu go
    inside, the others outside; an outer member goes inside as well if a similar
    inner one could exist, d <= mu + radius(n), n runs allowing no partner
    farther than (1-t)/(1+t) * (n + n/t). What has not shrunk, and what is still
    large after the last round, is compared in pairs of blocks of ``limit``
    members. Yields (shard, cls), no pair lost.
    """
    widest = (1 - t) / (1 + t) * (1 + 1 / t)
    done: list[DataFrame] = []
    live = shards
    for k in range(rounds):
        size = live.groupBy("shard").agg(F.count("*").alias("m"))
        sized = scratch.save(live.join(size, "shard"), f"sized-{k}")
        done.append(sized.where(F.col("m") <= limit).select("shard", "cls"))
        large = sized.where(F.col("m") > limit)
        if not large.limit(1).count():
            break
        placed = large.join(points.select("cls", "n", "sketch"), "cls")
        vantage = placed.groupBy("shard").agg(F.min(F.struct("cls", "sketch")).alias("v")).select("shard", F.col("v.sketch").alias("vantage"))
        far = scratch.save(_distances(placed.join(vantage, "shard")).select("shard", "cls", "n", "m", "d"), f"far-{k}")
        middle = far.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("mu"))
        inside = F.col("d") <= F.col("mu")
        guest = ~inside & (F.col("d") <= F.col("mu") + F.lit(widest) * F.col("n"))
        split = far.join(middle, "shard")
        sides = split.withColumn("side", F.explode(F.when(inside, F.array(F.lit(0))).when(guest, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
        child = sides.select(F.xxhash64("shard", "side", F.lit(k)).alias("shard"), "cls", "m")
        count = child.groupBy("shard").agg(F.count("*").alias("c"), F.first("m").alias("parent"))
        child = scratch.save(child.select("shard", "cls").join(count, "shard"), f"child-{k}")
        stuck = (F.col("c") > limit) & ((F.col("c") > 0.9 * F.col("parent")) | F.lit(k == rounds - 1))
        blocks = child.where(stuck).withColumn("b", F.ceil(F.col("c") * 2 / limit)).withColumn("i", F.pmod(F.xxhash64("cls", F.lit(k)), "b"))
        both = blocks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1)))
        done.append(both.select(F.xxhash64("shard", F.least("i", "j"), F.greatest("i", "j")).alias("shard"), "cls"))
        live = child.where(~stuck).select("shard", "cls")
    else:
        done.append(live)  # the small parts of the last round, the large ones are blocks
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


class Tree:
    """A vantage-point tree over sketches with the size of each set."""

    LEAF = 32

    def __init__(self, sketches: np.ndarray, n: np.ndarray, t: float) -> None:
        self.sk, self.n, self.ratio, self.t = sketches, n, (1 - t) / (1 + t), t
        self.visited = 0

    def _far(self, i: int, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.sk[j] ^ self.sk[i]).sum(1).astype(np.int64)

    def _close(self, i: int, j: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
        d = self._far(i, j) if d is None else d
        self.visited += len(j)
        lo, hi = np.minimum(self.n[j], self.n[i]), np.maximum(self.n[j], self.n[i])
        return j[(d <= self.ratio * (self.n[j] + self.n[i]) + 1e-9) & (lo >= self.t * hi - 1e-9)]

    def _each(self, own: np.ndarray, guests: np.ndarray) -> Iterator[tuple[int, int]]:
        """All pairs of a leaf, in blocks of its members."""
        every = np.concatenate([own, guests])
        for lo in range(0, len(own), self.LEAF):
            part = own[lo : lo + self.LEAF]
            d = np.bitwise_count(self.sk[part][:, None, :] ^ self.sk[every][None, :, :]).sum(2)
            self.visited += d.size
            x, y = self.n[part][:, None], self.n[every][None, :]
            near = (d <= self.ratio * (x + y) + 1e-9) & (np.minimum(x, y) >= self.t * np.maximum(x, y) - 1e-9)
            near &= np.arange(len(every))[None, :] > np.arange(lo, lo + len(part))[:, None]
            i, j = np.nonzero(near)
            yield from zip(part[i].tolist(), every[j].tolist())

    def pairs(self, own: np.ndarray, guests: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of two members of ``own``, or of one and a guest, that may be similar.

        A pair counts if it is within the radius by sketch and by size; no
        similar pair is missing.
        """
        reach = self.ratio * (1 + 1 / self.t)
        stack = [(own[np.argsort(self.n[own], kind="stable")], guests)]
        while stack:
            own, guests = stack.pop()
            if len(own) <= self.LEAF:
                yield from self._each(own, guests)
                continue
            v, rest = int(own[0]), own[1:]
            d, dg = self._far(v, rest), self._far(v, guests)
            for j in np.concatenate([self._close(v, rest, d), self._close(v, guests, dg)]).tolist():
                yield v, j
            mu = np.median(d)
            inner, outer = rest[d <= mu], rest[d > mu]
            if not len(outer):  # all at one distance from here: nothing to cut
                yield from self._each(rest, guests)
                continue
            # Triangle bound: |d(v,x) - d(v,y)| <= d(x,y) <= radius for a similar pair.
            edge = outer[d[d > mu] - reach * self.n[outer] <= mu]
            stack.append((inner, np.concatenate([edge, guests[dg - reach * self.n[guests] <= mu]])))
            stack.append((outer, guests[dg + reach * self.n[guests] > mu]))


def tree_pairs(sketches: list[bytes], n: list[int], t: float) -> Iterator[tuple[int, int]]:
    """Pairs of a shard that may be similar. Sketches of one length share a tree.

    Similar sets differ in size by less than a factor of two (t > 0.5), so
    their sketches are of the same or of neighbouring lengths; the longer ones
    visit the tree of the shorter ones as guests, folded.
    """
    size, sizes = np.array([len(s) for s in sketches]), np.array(n)
    if len(set(size.tolist())) == 1 and len(n) <= Tree.LEAF:
        tree = Tree(np.frombuffer(b"".join(sketches), _U).reshape(len(n), -1), sizes, t)
        yield from tree._each(np.arange(len(n)), np.zeros(0, np.int64))
        return
    for length in np.unique(size).tolist():
        own, guests = np.flatnonzero(size == length), np.flatnonzero(size == 2 * length)
        if len(own) + len(guests) < 2:
            continue
        rows = np.concatenate([own, guests])
        folded = np.stack([fold(sketches[i], length) for i in rows.tolist()]).view(_U)
        tree = Tree(folded, sizes[rows], t)
        for i, j in tree.pairs(np.arange(len(own)), np.arange(len(own), len(rows))):
            yield int(rows[i]), int(rows[j])


def _search(members: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: pairs of sets inside shards that the trees let through."""
    ordered = members.repartition("shard").sortWithinPartitions("shard", "cls")

    def shard(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        for i, j in tree_pairs([r[2] for r in rows], [r[1] for r in rows], t):
            yield min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        found: set[tuple[int, int]] = set()

        def take() -> pa.RecordBatch:
            a, b = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, c, n, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != current:
                    if len(rows) > 1:
                        found.update(shard(rows))
                    current, rows = g, []
                if not rows or rows[-1][0] != c:
                    rows.append((c, n, s))
            if len(found) > 100_000:
                yield take()
        if len(rows) > 1:
            found.update(shard(rows))
        if found:
            yield take()

    return ordered.select("shard", "cls", "n", "sketch").mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, common, n_a, n_b) of the pairs that are similar by their runs."""
    one = sets.select(F.col("cls").alias("a"), F.col("runs").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("runs").alias("y"))

    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(unpack_runs(p), unpack_runs(q), assume_unique=True)) for p, q in zip(x, y)], dtype="int32")

    both = pairs.join(one, "a").join(two, "b").select(
        "a", "b", common("x", "y").alias("common"), (F.length("x") / 5).cast("bigint").alias("n_a"), (F.length("y") / 5).cast("bigint").alias("n_b")
    )
    return both.where(F.col("common") >= F.lit(t) * (F.col("n_a") + F.col("n_b") - F.col("common")) - F.lit(1e-9))


def similar_sets(
    texts: DataFrame, scratch: Scratch, id_col: str = "id", text_col: str = "content", t: float = THRESHOLD,
    words: int = WORDS, least: int = LEAST_WORDS, limit: int = SHARD, small: int = SMALL,
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, cls) of every text that takes part, and (a, b, common, n_a, n_b) of similar classes.

    A class is a set of exact copies (equal sets of runs); ``members`` lists
    each id once per class. Null, empty and short texts take no part. Rows of
    one id with different texts are members of different classes. An empty
    table gives empty results.
    """
    if not 0.5 < t <= 1:
        raise ValueError("the threshold must be above one half")
    sets = scratch.save(text_sets(texts, id_col, text_col, words, least).withColumn("short", F.col("cls").bitwiseAND(int(_SHORT))), "sets")
    runs = sets.agg(F.sum("n")).first()[0] or 0
    targets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs / _TARGET))
    keys = _keys(sets, frequencies(sets, runs), t, 50 * limit, targets)
    # Runs that are common everywhere are not brought together by key: they are large shards from the start.
    hot = scratch.save(keys.where("target is null").select("shard", "short"), "hot")
    shared = scratch.save(_shards(keys.where("target is not null"), small, t, targets), "shared")
    scratch.release()
    large = shared.where("target is null").select("shard", "short").unionByName(hot)
    size = large.groupBy("shard").agg(F.count("*").alias("m"))
    name = "short"
    if size.where(F.col("m") > limit).limit(1).count():
        name = "cls"  # from here on sets with one short name go separate ways
        points = scratch.save(sets.select("short", "cls", "n", "sketch").dropDuplicates(["cls"]), "points")
        whole = large.distinct().join(points.select("short", "cls"), "short").select("shard", "cls")
        large = divide(whole, points, scratch, limit, t).distinct().withColumn("short", F.col("cls").bitwiseAND(int(_SHORT)))
        large = scratch.save(large, "divided")
        for done in ("points", *(f"{x}-{k}" for x in ("sized", "far", "child") for k in range(16))):
            scratch.drop(done)
    counted = scratch.save(_counted(shared.where("target is not null")), "counted")
    # Only sets in a shard or pair, then only those in a close pair, are needed: a filter keeps the others from the shuffle.
    ends = counted.select(F.col("a").alias("short")).unionByName(counted.select(F.col("b").alias("short"))).unionByName(large.select("short"))
    sketches = scratch.save(_sieve(ends, sets.select("short", "cls", "n", "sketch"), "short").dropDuplicates(["cls"]), "sketches")
    placed = large.join(sketches.drop("short") if name == "cls" else sketches, name)
    passed = _search(placed, t).unionByName(_close_pairs(counted, sketches, t))
    passed = scratch.save(passed.distinct(), "passed")
    for done in ("hot", "shared", "divided", "counted", "sketches"):
        scratch.drop(done)
    scratch.release()
    ends = passed.select(F.col("a").alias("cls")).unionByName(passed.select(F.col("b").alias("cls")))
    payload = scratch.save(_sieve(ends, sets.select("cls", "runs"), "cls").dropDuplicates(["cls"]), "payload")
    pairs = scratch.save(_verify(passed, payload, t), "pairs")
    members = scratch.save(sets.select(id_col, "cls").distinct(), "members")
    for done in ("sets", "passed", "payload"):
        scratch.drop(done)
    return members, pairs


def _sieve(wanted: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Rows of ``sets`` whose ``name`` is wanted, and a few more: a table of about 16 bits a wanted row, 64 MB at most."""
    bits = _power(16 * wanted.count(), 1 << 18, 1 << 29)

    def places(batch: pa.RecordBatch, _: set[int]) -> np.ndarray:
        return (_mix(batch.column(0).to_numpy().view(_U)) % _U(bits)).astype(np.int64)

    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(_counters(wanted.select(name), places, bits) > 0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema.fields)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = (_mix(batch.column(name).to_numpy().view(_U)) % _U(bits)).astype(np.int64)
            hit = table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            if hit.any():
                yield batch.filter(pa.array(hit.astype(bool)))

    return sets.mapInArrow(keep, fields)


def id_pairs(members: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id_a, id_b), id_a < id_b: similar classes expanded to their members, and the copies of each class."""
    a = members.select(F.col(id_col).alias("x"), F.col("cls").alias("a"))
    b = members.select(F.col(id_col).alias("y"), F.col("cls").alias("b"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").where("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    # The copies of a class meet in parts of about a thousand: one side is dealt out, the other goes to every part.
    parts = F.ceil(F.col("count") / 1000).cast("int")
    copies = members.groupBy("cls").count().where("count > 1").select(F.col("cls").alias("a"), parts.alias("parts"))
    one = a.join(copies, "a").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    two = b.withColumnRenamed("b", "a").join(copies, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    within = one.join(two, ["a", "part"]).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within).distinct()


def groups(members: DataFrame, pairs: DataFrame, scratch: Scratch, id_col: str = "id") -> DataFrame:
    """(id, class_id, group_id, links): one row per text that takes part.

    Groups are the connected components of similar classes; labels fall to the
    least class by alternating neighbours' labels and label-of-label jumps, so
    the number of rounds follows the logarithm of a chain's length. ``links``
    is the number of similar other classes.
    """
    edge = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edge = scratch.save(edge, "edges")
    label = scratch.save(edge.select(F.col("a").alias("v"), F.col("a").alias("l")).distinct(), "label-0")
    k = 0
    while True:
        k += 1
        near = edge.join(label.select(F.col("v").alias("b"), F.col("l").alias("o")), "b").groupBy("a").agg(F.min("o").alias("o"))
        hop = label.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("l").alias("old"), F.least("l", "o").alias("l"))
        jump = label.select(F.col("v").alias("l"), F.col("l").alias("far"))
        new = scratch.save(hop.join(jump, "l").select("v", "old", F.least("l", "far").alias("l")), f"label-{k}")
        changed = new.where("l != old").limit(1).count()
        label = new.select("v", "l")
        if not changed:
            break
    links = edge.groupBy("a").agg(F.count("*").alias("links"))
    facts = label.join(links.withColumnRenamed("a", "v"), "v").select(F.col("v").alias("cls"), F.col("l").alias("group_id"), "links")
    return members.join(facts, "cls", "left").select(
        id_col, F.col("cls").alias("class_id"), F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
