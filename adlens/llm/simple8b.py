"""Token ids in Simple-8b words: codec, shard files, writer and reader.

A word has a selector in its top 4 bits and 60 bits of payload: ``COUNT[s]``
ids of ``WIDTH[s]`` bits each, the first in the lowest bits.  Selector 0 is the
escape for an id of more than 60 bits: its payload is the index of the id in
the file's list of raw 64-bit values.  Ids are cut into blocks of ``BLOCK``; a
block starts at a new word, and the file lists the word offset of each block,
so blocks are encoded and decoded side by side.

A shard file: ``MAGIC``; the words; the raw values; block offsets; document ids
(int64); null flags of these (uint8); document lengths (int64); then six
uint64 (words, raw values, blocks, documents, ids, block size) and ``MAGIC``.
All numbers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import one_each, run_path, save, text_batches, tokenizer

COUNT = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
WIDTH = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BLOCK = 1024
MAGIC = b"S8BIDS01"
_PAD = int(COUNT.max()) - 1
_TAIL = 6 * 8 + len(MAGIC)


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    if not len(values) or values.max() < len(_SMALL):
        return _SMALL[values.astype(np.int64)]
    out = np.zeros(values.shape, dtype=np.uint8)
    v = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = v >= (np.uint64(1) << np.uint64(step))
        out += big.astype(np.uint8) * np.uint8(step)
        v = np.where(big, v >> np.uint64(step), v)
    return out + (v > 0).astype(np.uint8)


def encode(ids: np.ndarray, raw_base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, raw values) of the ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + _PAD), dtype=np.uint64)
    full = np.zeros(blocks * BLOCK, dtype=np.uint64)
    full[:len(ids)] = ids
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    flat = grid.reshape(-1)
    wide = _bits(flat)
    # fits[p] counts the selectors whose window from p on fits; they are nested
    fits = (wide <= 60).astype(np.uint8)
    window, span = wide, 1
    for s in range(2, len(COUNT)):
        for k in range(span, int(COUNT[s])):
            window = np.maximum(window[:-1], wide[k:])
        span = int(COUNT[s])
        ok = window <= WIDTH[s]
        if not ok.any():
            break
        fits[:len(ok)] += ok
    size = np.full(blocks, BLOCK, dtype=np.int64)
    size[-1] = len(ids) - (blocks - 1) * BLOCK
    base = np.arange(blocks, dtype=np.int64) * (BLOCK + _PAD)
    at, live, steps = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):
        here = base[live] + at[live]
        sel = fits[here]
        steps.append((live, here, sel))
        at[live] += COUNT[sel]
        live = live[at[live] < size[live]]
    block = np.concatenate([s[0] for s in steps])
    place = np.concatenate([s[1] for s in steps])
    sel = np.concatenate([s[2] for s in steps]).astype(np.int64)
    order = np.lexsort((place, block))
    place, sel = place[order], sel[order]
    per_block = np.bincount(block, minlength=blocks)
    words = np.zeros(len(place), dtype=np.uint64)
    raw = np.zeros(0, dtype=np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            raw = flat[place[mine]]
            words[mine] = np.uint64(raw_base) + np.arange(len(mine), dtype=np.uint64)
            continue
        word = np.full(len(mine), np.uint64(int(s) << 60))
        for k in range(int(COUNT[s])):
            word |= flat[place[mine] + k] << np.uint64(k * int(WIDTH[s]))
        words[mine] = word
    return words, np.cumsum(per_block) - per_block, raw


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int, raw: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``offsets`` are their first words here."""
    if not n_ids:
        return np.zeros(0, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[sel]
    per_block = np.diff(np.concatenate([offsets, [len(words)]]))
    block = np.repeat(np.arange(len(offsets)), per_block)
    cum = np.cumsum(count) - count
    at = block * BLOCK + cum - np.repeat(cum[offsets], per_block)
    out = np.zeros(len(offsets) * BLOCK + _PAD + 1, dtype=np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            out[at[mine]] = raw[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask, ends = np.uint64((1 << int(WIDTH[s])) - 1), (block[mine] + 1) * BLOCK
        for k in range(int(COUNT[s])):
            put = at[mine] + k
            inside = put < ends
            value = (words[mine] >> np.uint64(k * int(WIDTH[s]))) & mask
            out[put[inside]] = value[inside]
    return out[:n_ids]


class ShardWriter:
    """Streams ids of documents into one shard file."""

    def __init__(self, path: str):
        filesystem, name = pafs.FileSystem.from_uri(path)
        filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = filesystem.open_output_stream(name, compression=None)
        self.out.write(MAGIC)
        self.rest = np.zeros(0, dtype=np.uint64)
        self.offsets, self.raw, self.docs, self.nulls, self.lengths = [], [], [], [], []
        self.words = self.raws = self.ids = 0

    def _put(self, ids: np.ndarray) -> None:
        words, offsets, raw = encode(ids, self.raws)
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets + self.words)
        self.raw.append(raw)
        self.words, self.raws, self.ids = self.words + len(words), self.raws + len(raw), self.ids + len(ids)

    def add(self, doc_ids, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([0 if d is None else d for d in doc_ids], dtype=np.int64))
        self.nulls.append(np.array([d is None for d in doc_ids], dtype=np.uint8))
        self.lengths.append(np.asarray(lengths, dtype=np.int64))
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK * 1024):
            self._put(ids[at:min(whole, at + BLOCK * 1024)])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self._put(self.rest)
        parts = [(self.raw, "<u8"), (self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"),
                 (self.lengths, "<i8")]
        sizes = []
        for arrays, kind in parts:
            joined = np.concatenate(arrays) if arrays else np.zeros(0)
            sizes.append(len(joined))
            self.out.write(joined.astype(kind).tobytes())
        tail = [self.words, sizes[0], sizes[1], sizes[2], self.ids, BLOCK]
        self.out.write(np.array(tail, dtype="<u8").tobytes() + MAGIC)
        self.out.close()
        return sizes[2], self.ids


def read_shard(path: str, blocks_at_once: int = 2048):
    """Batches of blocks of a shard file, in order: (doc ids, null flags,
    document lengths, position of the batch's first id, ids)."""
    filesystem, name = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as f:
        size = f.size()
        tail = f.read_at(_TAIL, size - _TAIL)
        if tail[-len(MAGIC):] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a complete id shard")
        n_words, n_raw, n_blocks, n_docs, n_ids, block = np.frombuffer(tail[:48], dtype="<u8").astype(int).tolist()
        if block != BLOCK:
            raise ValueError(f"{path} has blocks of {block} ids")
        at = len(MAGIC) + 8 * n_words

        def section(n, kind):
            nonlocal at
            width = np.dtype(kind).itemsize
            got = np.frombuffer(f.read_at(n * width, at), dtype=kind) if n else np.zeros(0, kind)
            at += n * width
            return got

        raw, offsets = section(n_raw, "<u8"), section(n_blocks, "<u8").astype(np.int64)
        docs, nulls, lengths = section(n_docs, "<i8"), section(n_docs, "u1"), section(n_docs, "<i8")
        ends = np.append(offsets, n_words)
        for b in range(0, n_blocks, blocks_at_once):
            e = min(n_blocks, b + blocks_at_once)
            words = np.frombuffer(f.read_at(8 * int(ends[e] - ends[b]), len(MAGIC) + 8 * int(ends[b])),
                                  dtype="<u8")
            here = min(n_ids, e * BLOCK) - b * BLOCK
            yield docs, nulls, lengths, b * BLOCK, decode(words, offsets[b:e] - offsets[b], here, raw)
        if not n_blocks:
            yield docs, nulls, lengths, 0, np.zeros(0, dtype=np.uint64)


def shard_documents(path: str):
    """(doc_id, start in the file, length, crc32 of the ids) of every document."""
    doc = done = crc = 0
    starts = None
    for docs, nulls, lengths, base, ids in read_shard(path):
        if starts is None:
            starts = np.cumsum(lengths) - lengths
        le = ids.astype("<u4")
        while doc < len(docs) and starts[doc] + done <= base + len(ids):
            left = int(lengths[doc]) - done
            at = int(starts[doc]) + done - base
            part = le[at:at + left]
            crc = zlib.crc32(part.data, crc) if len(part) else crc
            done += len(part)
            if done < lengths[doc]:
                break
            yield (None if nulls[doc] else int(docs[doc])), int(starts[doc]), int(lengths[doc]), crc & 0xFFFFFFFF
            doc, done, crc = doc + 1, 0, 0


def write_ids(df: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id",
              text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text, write id shards, return the manifest: shard,
    path, n_docs, n_ids, base (ids in earlier shards).

    Documents are range-partitioned and sorted by id, so the shards in order
    hold them in ascending order (null ids first; rows with the same id in the
    order of a hash of their text).  A task writes its file under a name of its own
    and reports it in the manifest, which is written as a table: files of lost
    or repeated attempts are never read.  Null text counts as empty; an empty
    table gives no shard.  Other columns are ignored.
    """
    spark = df.sparkSession
    folder = path or run_path(spark, "ids")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = "shard int, path string, n_docs long, n_ids long"

    def write(batches):
        from pyspark import TaskContext

        shard, name, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for a, b in text_batches(texts, 8_000_000):
                    if out is None:
                        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.s8b"
                        out = ShardWriter(name)
                    flat, sizes = tokenizer(tokenizer_path).encode(texts[a:b])
                    if end_id is not None:
                        flat = np.insert(flat, np.cumsum(sizes), end_id)
                        sizes = sizes + 1
                    out.add(ids[a:b], sizes, flat)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "path": [name],
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    made = save(rows.mapInArrow(write, schema), "ids-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids before it in all files),
    n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = []
                for row in shard_documents(path):
                    got.append(row)
                    if len(got) == 20_000:
                        yield pack(got, base)
                        got = []
                if got:
                    yield pack(got, base)

    def pack(got, base):
        doc, start, n, crc = zip(*got)
        return pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array([base + s for s in start], pa.int64()),
            pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = one_each(manifest, "path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("doc_id", id_col)
