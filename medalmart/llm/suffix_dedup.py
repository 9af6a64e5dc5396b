"""Removal of repeated 400-byte strings, exactly, by suffix arrays over shards.

A string of ``LENGTH`` bytes is repeated if it starts anywhere else, in the same text or another.
Every byte that a repeated string covers goes.

*Shards.* Each string has a minimizer: the leftmost smallest hash among its runs of ``GRAM`` bytes.
Equal strings have equal minimizers, so a shard that holds all strings with a minimizer needs no
other shard. Neighbouring strings mostly share theirs: a text falls into slices, each a run of
starts with one minimizer. A slice that occurs twice as a whole is repeated, and a minimizer that
occurs once is not; only distinct slices with a minimizer in common are left, the edges of repeats.
Shards are filled with those up to ``SHARD_BYTES``.

*Suffix array.* Within a shard, suffixes are ranked by their first 8 bytes and the ranks refined by
doubling (Larsson and Sadakane: only suffixes that are still tied, numbered by the start of their
group), up to exactly ``LENGTH`` bytes. Neighbours in that order have a common prefix of ``LENGTH``
bytes if and only if they are still tied; as nothing but this is asked of the common prefixes, there
is no separate pass for them.

*Merging.* A minimizer with more bytes than a shard holds is spread over several. Each of these
reports one 128-bit key for every group of equal strings, sorted and packed by range of keys; where
the packs of a range meet, they are merged by binary search, and keys that several shards report are
repeated as well. Slices of hot minimizers stay where they are when frequent ones are told. Hashes of 128 bits
stand for equal strings here and for equal slices.

Defined results: a null text is an empty one; texts below 400 bytes stay whole; repeated rows lose
all bytes if they have 400; an empty table gives no rows; long texts are cut into pieces that
overlap, and none is left out; columns other than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medalmart.operators.lookup import HOT_SHARE

from .common import slices, stored, table
from .texts import mixed

LENGTH, GRAM = 400, 48
#: Bytes of slices in a shard, about; a minimizer with more is spread over several.
SHARD_BYTES = 3 << 19
#: Bytes worked on at once, each with some hundred bytes of numbers; longer texts are cut into overlapping pieces.
AT_ONCE = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> dict[str, np.ndarray]:
    """For two polynomial hashes: a number for each byte, powers of the base and of its inverse."""
    if len(_TABLES.get("power0", ())) < n:
        for k, base in enumerate(_ODD):
            _TABLES[f"byte{k}"] = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 1))
            for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                _TABLES[f"{name}{k}"] = np.multiply.accumulate(steps)
    return _TABLES


def prefix_sums(octets: np.ndarray, k: int) -> np.ndarray:
    t = _tables(max(len(octets) + 1, AT_ONCE + LENGTH + 1))
    out = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(t[f"byte{k}"][octets] * t[f"power{k}"][: len(octets)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _TABLES[f"inverse{k}"][start] + (end - start).astype(np.uint64))


def string_hashes(octets: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the strings of ``length`` bytes at places in ascending order; powers are kept for a piece, not for all."""
    out = np.empty((2, len(place)), np.uint64)
    for at in range(0, len(octets), AT_ONCE):
        a, b = np.searchsorted(place, (at, at + AT_ONCE))
        if a < b:
            piece, own = octets[at : at + AT_ONCE + length - 1], place[a:b] - at
            for k in (0, 1):
                out[k, a:b] = range_hash(prefix_sums(piece, k), k, own, own + length)
    return out[0], out[1]


def _sliding(values: np.ndarray, width: int, best, fill) -> np.ndarray:
    """``best`` (minimum or maximum) of every run of ``width`` values, from running bests of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[: n - width + 1], ahead[width - 1 : n])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest hash of every run of ``width`` hashes."""
    least = _sliding(h, width, np.minimum, np.iinfo(h.dtype).max)
    # A hash is some run's smallest if it equals the largest of the minima of the runs it is in.
    edge = np.zeros(width - 1, h.dtype)
    most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
    chosen = np.flatnonzero(h == most)
    at = np.searchsorted(chosen, np.arange(len(least)))
    wrong = np.flatnonzero(h[chosen[at]] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != least[wrong]]
    return chosen[at]


def cut(octets: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Slices of several texts laid end to end: first start, number of starts, minimizer, digest."""
    empty = np.empty(0, np.int64)
    if len(octets) < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = prefix_sums(octets, 0)
    place = np.arange(len(octets) - gram + 1)
    h = range_hash(sums, 0, place, place + gram)
    low = minimizers(h, length - gram + 1)
    start = np.arange(len(low))
    whole = ends[np.searchsorted(ends, start, "right")] - start >= length
    new = np.flatnonzero(np.diff(np.where(whole, low, -1), prepend=-2))
    n = np.diff(np.append(new, len(low)))
    new, n = new[whole[new]], n[whole[new]]
    digest = range_hash(prefix_sums(octets, 1), 1, new, new + n - 1 + length)
    return new, n, h[low[new]], digest


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes to work on at once, ends of the texts in them, their numbers, their offsets in the text."""
    parts = [(i, at) for i, t in enumerate(texts) if len(t) >= length for at in range(0, len(t) - length + 1, AT_ONCE)]
    held = [texts[i][at : at + AT_ONCE + length - 1] for i, at in parts]
    for a, b in slices([len(x) for x in held], AT_ONCE):
        octets = np.frombuffer(b"".join(held[a:b]), np.uint8)
        ends = np.append(np.cumsum([len(x) for x in held[a:b]]), np.iinfo(np.int64).max)
        yield octets, ends, np.array([i for i, _ in parts[a:b]]), np.array([at for _, at in parts[a:b]])


def _slicer(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(pc.binary_length(whole.column(1)).to_pylist(), AT_ONCE):
                batch = whole.slice(a, b - a)
                for octets, ends, text, offset in _pieces(batch.column(1).to_pylist(), length):
                    start, n, low, digest = cut(octets, ends, length, gram)
                    own = np.searchsorted(ends, start, "right")
                    first = np.concatenate(([0], ends[:-1]))[own]
                    content = batch.column(0).take(pa.array(text[own]))
                    yield pa.RecordBatch.from_arrays([content, *(pa.array(x) for x in (low.view(np.int64), digest.view(np.int64), start - first + offset[own], n))], ["content", "low", "digest", "start", "n"])
            pa.default_memory_pool().release_unused()

    return run


def ranks(octets: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Rank of each place by its first ``length`` bytes; ``room``: bytes from there to its slice's end.

    Places without room for as many bytes keep the rank of fewer; nothing looks at it.
    """
    n = len(octets)
    kind = np.int32 if n < 1 << 31 else np.int64
    padded = np.concatenate([octets, np.zeros(8, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        np.left_shift(keys, np.uint64(8), out=keys)
        np.bitwise_or(keys, padded[k : k + n], out=keys)
    order = np.argsort(keys)
    rank = np.empty(n, kind)
    rank[order] = _firsts(keys[order], kind)
    depth = 8
    while depth < length:
        deeper = min(2 * depth, length)
        # Ranks are starts of groups: a place is tied if its group's first is not its only one.
        size = np.bincount(rank, minlength=n) > 1
        tied = np.flatnonzero((room >= deeper) & size[rank])
        old = rank[tied]
        keys = old * np.int64(n + 1) + rank[tied + (deeper - depth)]
        order = np.argsort(keys)
        old, part = old[order], _firsts(keys[order], kind)
        rank[tied[order]] = old + part - _firsts(old, kind)
        depth = deeper
    return rank


def _firsts(values: np.ndarray, kind: type) -> np.ndarray:
    """For each of sorted values the place of the first that equals it."""
    at = np.zeros(len(values), kind)
    new = np.flatnonzero(values[1:] != values[:-1]) + 1
    at[new] = new
    return np.maximum.accumulate(at, out=at)


TOLD = T.StructType([
    T.StructField("group", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType()),
    T.StructField("k1", T.ArrayType(T.LongType())), T.StructField("k2", T.ArrayType(T.LongType())), T.StructField("owner", T.ArrayType(T.LongType())),
    T.StructField("start", T.ArrayType(T.LongType())), T.StructField("contents", T.ArrayType(T.BinaryType())),
])
_ARROW = pa.schema([("group", pa.int64()), ("content", pa.binary()), ("from", pa.int64()), ("to", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("k1", "k2", "owner", "start")), ("contents", pa.list_(pa.binary()))])


def _sharded(length: int, groups: int):
    def run(shard: pa.Table) -> pa.Table:
        """Repeated runs of starts; for spread minimizers also packed keys, a row for each group."""
        octets = np.frombuffer(b"".join(shard.column("octets").to_pylist()), np.uint8)
        kind = np.int32 if len(octets) < 1 << 31 else np.int64
        n, seen = shard.column("n").to_numpy(), shard.column("copies").to_numpy()
        size = n + length - 1
        first = np.cumsum(size) - size
        room = np.repeat((first + size).astype(kind), size)
        room -= np.arange(len(octets), dtype=kind)
        rank = ranks(octets, room, length)
        del room
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.repeat(np.arange(len(n)), n)
        mine = rank[place]
        repeated = (np.bincount(mine, minlength=len(octets))[mine] > 1) | (seen[own] > 1)
        start = shard.column("start").to_numpy()[own] + place - first[own]
        content = shard.column("content").combine_chunks()
        # Runs of neighbouring starts of a slice; what occurs as a whole elsewhere is told already.
        hit = np.flatnonzero(repeated & (seen[own] == 1))
        ends = np.concatenate(((np.diff(hit) != 1) | (np.diff(own[hit]) != 0), [True])) if len(hit) else np.empty(0, bool)
        new, last = hit[np.concatenate(([True], ends[:-1]))] if len(hit) else hit, hit[ends]
        told = {"group": np.arange(len(new)) % groups, "content": content.take(pa.array(own[new])), "from": start[new], "to": start[last] + length}
        out = [_told(len(new), told)]
        spread = np.array(shard.column("spread").to_pylist(), np.bool_)[own]
        if spread.any():
            # One of each group of equal strings. A group that is repeated already only tells the others.
            order = np.argsort(mine, kind="stable")
            at = np.sort(order[np.concatenate(([True], mine[order][1:] != mine[order][:-1])) & spread[order]])
            k1, k2 = string_hashes(octets, place[at], length)
            to, owner = (k1 % np.uint64(groups)).astype(np.int64), np.where(repeated[at], -1, own[at])
            by = np.lexsort((k2, k1, to))
            to, at, owner = to[by], at[by], owner[by]
            packs = np.flatnonzero(np.diff(to, prepend=-1))
            cuts = np.append(packs, len(to))
            codes, names = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                used, code = np.unique(owner[a:b], return_inverse=True)
                codes.append(code - (used[0] < 0))  # -1 still is nobody
                names.append(used[used >= 0])
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            keys = {"k1": k1[by].view(np.int64), "k2": k2[by].view(np.int64), "owner": np.concatenate(codes), "start": start[at]}
            named = lists(np.cumsum([0, *map(len, names)]), content.take(pa.array(np.concatenate(names))))
            out.append(_told(len(packs), {"group": to[packs], **{c: lists(cuts, pa.array(x)) for c, x in keys.items()}, "contents": named}))
        return pa.concat_tables(out)

    return run


def _told(n: int, columns: dict) -> pa.Table:
    return pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def merged(keys: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Places of keys in order, from lists of places that are in order each.

    Two lists become one by binary search: a key's place is its own plus the number of keys before it in the other.
    """
    while len(lists) > 1:
        pairs = list(zip(lists[::2], lists[1::2], strict=False))
        rest = lists[-1:] if len(lists) % 2 else []
        lists = []
        for one, two in pairs:
            both = np.empty(len(one) + len(two), np.int64)
            both[np.arange(len(one)) + np.searchsorted(keys[two], keys[one], "left")] = one
            both[np.arange(len(two)) + np.searchsorted(keys[one], keys[two], "right")] = two
            lists.append(both)
        lists += rest
    return lists[0]


def _merged(length: int):
    def run(group: pa.Table) -> pa.Table:
        """The runs as they are, and strings of spread minimizers that several shards have."""
        packed = group.filter(pc.is_valid(group.column("k1")))
        plain = group.filter(pc.is_null(group.column("k1"))).select(["content", "from", "to"])
        if not len(packed):
            return plain
        lists = [packed.column(n).combine_chunks() for n in ("k1", "k2", "owner", "start")]
        counts = pc.list_value_length(lists[0]).to_numpy()
        shard = np.repeat(np.arange(len(packed)), counts)
        k1, k2, owner, start = (x.flatten().to_numpy() for x in lists)
        keys = np.stack([k1.view(np.uint64), k2.view(np.uint64)], 1).astype(">u8").view("S16").ravel()
        order = merged(keys, [*np.split(np.arange(len(keys)), np.cumsum(counts)[:-1])])
        same = keys[order][1:] == keys[order][:-1]
        found = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        found = found[owner[found] >= 0]
        base = np.cumsum([0, *pc.list_value_length(packed.column("contents").combine_chunks()).to_pylist()])
        names = packed.column("contents").combine_chunks().flatten().take(pa.array(base[shard[found]] + owner[found]))
        at = start[found]
        return pa.concat_tables([plain, pa.table({"content": names, "from": at, "to": at + length}, schema=plain.schema)])

    return run


def content(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def among(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Those of the ``total`` rows whose key is in ``keys`` (once each, with its number of rows ``n``).

    Rows don't move if their key has more than one in ``HOT_SHARE`` of all: fewer than ``HOT_SHARE`` keys have.
    """
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(keys.where(is_hot).select(*on))
    rest = rows.join(hot, on, "left_anti").join(keys.where(~is_hot).select(*on).hint("merge"), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(rest)


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Each distinct text with its content hash; and ``content, from, to`` of bytes to remove, which may overlap."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("octets")).select(F.unhex(F.md5("octets")).alias("content"), "octets")
    once = rows.where(F.length("octets") >= length).groupBy("content").agg(F.any_value("octets").alias("octets"))
    found = stored(rows.mapInArrow(_slicer(length, gram), "content binary, low bigint, digest bigint, start bigint, n bigint"), "slices")
    often = found.groupBy("low").agg(F.count("*").alias("n")).where("n > 1")
    found = stored(among(found, often, ["low"], found.rows), "shared-slices")
    distinct = stored(found.groupBy("low", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("content", "start", "n")).alias("one")), "distinct-slices")
    twice = distinct.where("copies > 1").select("low", "digest", F.col("copies").alias("n"))
    whole = among(found, twice, ["low", "digest"], found.rows).select("content", F.col("start").alias("from"), (F.col("start") + F.col("n") + (length - 1)).alias("to")).distinct()
    # Shards: by minimizer; those with too many bytes by minimizer and text.
    sizes = distinct.groupBy("low").agg(F.count("*").alias("c"), F.sum(F.col("one.n") + (length - 1)).alias("size")).where("c > 1")
    edges = stored(distinct.join(sizes, "low").select("low", "copies", "one.*", "size"), "edges")
    total = edges.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    spread = F.col("size") > shard_bytes
    parts = F.when(spread, F.ceil(F.col("size") / shard_bytes)).otherwise(1)
    shard = F.when(spread, F.xxhash64("low", F.pmod(F.xxhash64("content"), parts))).otherwise(F.pmod(F.xxhash64("low"), F.lit(total // shard_bytes + 1)))
    per_text = edges.select("content", F.struct(shard.alias("shard"), spread.alias("spread"), "copies", "start", "n").alias("slice")).groupBy("content").agg(F.collect_list("slice").alias("slices"))
    piece = F.transform("slices", lambda s: F.struct(s["shard"].alias("shard"), s["spread"].alias("spread"), s["copies"].alias("copies"), s["start"].alias("start"), s["n"].alias("n")))
    cut_out = once.join(per_text, "content").select("content", "octets", F.explode(piece).alias("s")).select("content", "s.*", F.substring(F.col("octets"), (F.col("s.start") + 1).cast("int"), (F.col("s.n") + (length - 1)).cast("int")).alias("octets"))
    groups = total // shard_bytes + 1
    told = cut_out.groupBy("shard").applyInArrow(_sharded(length, groups), TOLD)
    # Shards of one minimizer meet here, their keys sorted and dealt by value.
    edge = told.groupBy("group").applyInArrow(_merged(length), "content binary, from bigint, to bigint")
    return once, whole.unionByName(edge)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a, b in slices(pc.binary_length(whole.column(1)).to_pylist(), AT_ONCE):
            batch = whole.slice(a, b - a)
            out: list[tuple] = []
            for octets, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for x, y in sorted((s["from"], s["to"]) for s in spans or ()):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
                edges = [0, *(x for run in runs for x in run), len(octets)]
                kept = b"".join(octets[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if runs else octets
                out.append((len(octets), kept, hashlib.sha256(kept).hexdigest(), [{"from": x, "to": y} for x, y in runs]))
            types = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_bytes", "kept", "kept_sha256", "removed"])
            del out, columns
            pa.default_memory_pool().release_unused()  # workers live on; others need the memory


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every document's key, n_bytes, ``kept`` (remaining bytes), their kept_sha256, and ``removed``: maximal runs of removed bytes, in order."""
    _, spans = repeats(docs, text, **options)
    # Stored, so that the join reads it anew and a text with very many rows can be split.
    per_text = stored(spans.groupBy("content").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")
    octets = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), octets.alias("octets")).withColumn("content", F.unhex(F.md5("octets")))
    joined = rows.join(per_text.hint("merge"), "content", "left").select("key", "octets", "spans")
    kind = rows.schema["key"].dataType.simpleString()
    result = f"key {kind}, n_bytes bigint, kept binary, kept_sha256 string, removed array<struct<from: bigint, to: bigint>>"
    return joined.mapInArrow(_digest, result).withColumnRenamed("key", key)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    # Bytes may be cut within a character; the text shows what is left of it as U+FFFD.
    kept_text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", kept_text.alias("kept_text"))
