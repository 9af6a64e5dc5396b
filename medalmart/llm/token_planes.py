"""Token ids in binary shards, shuffled into planes.

Documents are range-partitioned by key, so a shard holds a range of keys in ascending order. Its
ids are cut into blocks of a fixed number of ids, whatever the documents. A block is transposed
into byte planes (or bit planes): all lowest bytes, then all second bytes, and so on. Equal high
bits so lie side by side, and each plane is compressed by itself with zstandard. The end of a shard
holds an index of its blocks and the list of its documents, so that any range of ids can be read
without the rest::

    "BPL1" | planes of block 0 | planes of block 1 | ... | index | length of the index (8 bytes) | "BPL1"

The index is a zstandard frame of two Arrow streams: blocks (offset, n_ids, plane lengths) and
documents (key, n_tokens). A plane of zeros has length 0 and no bytes.

A task writes to a name of its own and renames it when whole, so a repeated task leaves one shard
with the same content. Nothing depends on a previous attempt.

Defined results: a null text is an empty one (just the end id); a null key comes first; rows with
the same key follow each other by hash of the text; an empty table makes no shard and no rows;
other columns don't matter.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medalmart.sources.scratch import scratch_path

from .common import slices, stored, table

MAGIC = b"BPL1"
#: Ids in a block.
BLOCK = 1 << 16
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that a worker encodes at once; a longer text alone.
AT_ONCE = 12 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- the format -----------------------------------------------------------------------------


def to_planes(ids: np.ndarray, unit: str) -> np.ndarray:
    """4 byte planes or 32 bit planes of 32-bit ids, one in each row, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


class ShardWriter:
    """Writes ids document by document; holds a block of them and the list of documents."""

    def __init__(self, sink, unit: str = "byte", block: int = BLOCK, level: int = 1) -> None:
        self.sink, self.unit, self.block = sink, unit, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.at = sink.write(MAGIC) or len(MAGIC)

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(ids[i : i + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p.tobytes()) if p.any() else b"" for p in to_planes(ids, self.unit)]
        self.blocks.append((self.at, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self, key_type: pa.DataType) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        blocks = pa.table({"offset": pa.array([b[0] for b in self.blocks], pa.int64()), "n_ids": pa.array([b[1] for b in self.blocks], pa.int64()), "planes": pa.array([b[2] for b in self.blocks], pa.list_(pa.int64()))})
        docs = pa.table({"key": pa.chunked_array(self.keys, key_type), "n_tokens": pa.array(np.concatenate(self.counts) if self.counts else [], pa.int64())})
        out = io.BytesIO()
        for part in (blocks, docs):
            with pa.ipc.new_stream(out, part.schema) as stream:
                stream.write_table(part)
        index = self.packer.compress(out.getvalue())
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)


class ShardReader:
    """Reads any range of a shard's ids, block by block."""

    def __init__(self, source, size: int) -> None:
        self.source, tail = source, 8 + len(MAGIC)
        source.seek(size - tail)
        end = source.read(tail)
        if end[8:] != MAGIC:
            raise ValueError("not a whole shard")
        (length,) = struct.unpack("<Q", end[:8])
        source.seek(size - tail - length)
        self.unpacker = zstandard.ZstdDecompressor()
        both = io.BytesIO(self.unpacker.decompress(source.read(length)))
        self.blocks = pa.ipc.open_stream(both).read_all().to_pylist()
        self.docs = pa.ipc.open_stream(both).read_all()
        self.first = np.cumsum([0] + [b["n_ids"] for b in self.blocks])

    def block(self, i: int) -> np.ndarray:
        b = self.blocks[i]
        self.source.seek(b["offset"])
        n, width = b["n_ids"], len(b["planes"])
        each = n if width == 4 else -(-n // 8)
        planes = np.zeros((width, each), np.uint8)
        for k, length in enumerate(b["planes"]):
            if length:
                planes[k] = np.frombuffer(self.unpacker.decompress(self.source.read(length)), np.uint8)
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` to before ``stop``, in pieces of a block at most."""
        i = int(np.searchsorted(self.first, start, "right")) - 1
        while start < stop and i < len(self.blocks):
            own = self.block(i)[start - self.first[i] : stop - self.first[i]]
            yield own
            start += len(own)
            i += 1


# -- tokens ---------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, each distinct piece of many texts encoded once.

    White space ends a word of this tokenizer, and so does a comma or stop between a letter and
    white space. Pieces of Latin letters alone need none of its clean-up but lower case; they go
    to the same vocabulary and merges in long rows, in which each word's last id tells its end.
    """

    #: Lower-case letters for which lower case and composition change nothing else.
    LATIN = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
    ROW = 2000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _latin(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [" ".join(pieces[i : i + self.ROW]) for i in range(0, len(pieces), self.ROW)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(rows, add_special_tokens=False)])
        return np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0), ids

    def _other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter((i for x in ids for i in x), np.uint32, lengths.sum())

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; every text ends with ``end_id``."""
        # Added tokens are matched before the tokenizer's clean-up: texts that may hold one keep their case for it.
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # U+0130 is the one letter that ends in a mark once it is lower case; what follows it stays with it.
        spaced = pc.replace_substring_regex(lowered, r"([^\PL\x{130}])([.,])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(spaced)
        n_pieces = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(pieces, self.LATIN)
        lengths, flats = np.zeros(len(pieces), np.int64), []
        order = []
        for mask, encode in ((latin, self._latin), (pc.invert(latin), self._other)):
            at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if len(at):
                lengths[at], flat = encode(pieces.filter(mask).to_pylist())
                flats.append(flat)
                order.append(at)
        starts = np.zeros(len(pieces), np.int64)
        if order:
            at = np.concatenate(order)
            starts[at] = np.cumsum(lengths[at]) - lengths[at]
        first, length = starts[codes], lengths[codes]
        upto = np.concatenate(([0], np.cumsum(length)))
        text_end = upto[np.cumsum(n_pieces)]
        counts = np.diff(text_end, prepend=0) + 1
        ids = np.full(counts.sum(), end_id, np.uint32)
        own = np.ones(len(ids), np.bool_)
        own[np.cumsum(counts) - 1] = False
        if order:
            place = np.repeat((first - upto[:-1]).astype(np.int32), length)
            place += np.arange(upto[-1], dtype=np.int32)
            ids[own] = np.concatenate(flats)[place]
        return counts, ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- the jobs -------------------------------------------------------------------------------


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _writer(folder: str, path: str, unit: str, block: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _filesystem(folder)
        name = f"part-{task.partitionId():06d}.bpl"
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        shard = sink = None
        n_docs = 0
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            if shard is None:
                store.create_dir(root, recursive=True)
                sink, key_type = store.open_output_stream(draft), keys.type
                shard = ShardWriter(sink, unit, block)
            n_docs += len(keys)
            for a, b in slices(pc.binary_length(texts).to_pylist(), AT_ONCE):
                shard.add(keys.slice(a, b - a), *encoder(path)(texts.slice(a, b - a), end_id))
                pa.default_memory_pool().release_unused()  # workers live on; others need the memory
        if shard is not None:
            shard.close(key_type)
            sink.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [f"{folder.rstrip('/')}/{name}"], "n_docs": [n_docs], "n_ids": [shard.n_ids]})

    return write


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, unit: str = "byte", block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """Write the shards; one row for each: number, file, documents, ids. Reading it writes nothing again."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie)
    write = _writer(folder, tokenizer or tokenizer_path(), unit, block, end_id)
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _digests(first: int, reader: ShardReader) -> Iterator[pa.RecordBatch]:
    """Of each document of a shard: its start among all ids, its length and the crc32 of its ids."""
    keys, counts = reader.docs.column("key").combine_chunks(), reader.docs.column("n_tokens").to_numpy()
    ends = np.cumsum(counts)
    starts, crcs = ends - counts, np.zeros(len(counts), np.int64)
    doc, at = 0, 0
    for piece in reader.ids(0, int(ends[-1]) if len(ends) else 0):
        octets = memoryview(piece.astype("<u4").tobytes())
        used = 0
        while used < len(piece):
            take = min(len(piece) - used, int(ends[doc]) - at)
            crcs[doc] = zlib.crc32(octets[4 * used : 4 * (used + take)], int(crcs[doc]))
            used += take
            at += take
            doc += at == ends[doc]
    for i in range(0, len(counts), 10_000):
        yield pa.RecordBatch.from_arrays([keys.slice(i, 10_000), *(pa.array(x[i : i + 10_000], pa.int64()) for x in (first + starts, counts, crcs))], ["key", "start", "n_tokens", "ids_crc32"])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = _filesystem(row["file"])
            with store.open_input_file(path) as source:
                yield from _digests(row["before"], ShardReader(source, source.size()))


def read_digests(manifest: DataFrame, key_type: T.DataType) -> DataFrame:
    """Documents as the shards hold them. A shard is read by one task, block by block.

    The ids before a shard come from one row for each shard, which the writing tasks have left.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    placed = manifest.select("file", before.alias("before"))
    schema = T.StructType([T.StructField("key", key_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    return placed.repartition(max(1, manifest.count())).mapInArrow(_read, schema)


def token_planes(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, **options) -> DataFrame:
    """Write all documents and read them back: key, start, n_tokens, ids_crc32."""
    manifest = write_shards(docs, folder or scratch_path(docs.sparkSession, "token-planes"), key, text, **options)
    return read_digests(manifest, docs.schema[key].dataType).withColumnRenamed("key", key)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_planes(docs)


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(table(spark, sf_dir, "documents").select("doc_id", "text"))
