"""Packing documents into fixed-length sequences: shortest-pack-first over
the histogram of lengths.

A document's ids are cut into full sequences and one rest.  The rests are
packed on their histogram (at most ``seq_len`` counts, whatever the data):
lengths are placed longest first, each into the emptiest pack that fits, by
updating counts of packs with the same free space.  Every placement is a slot
row "ranks lo..hi of length l go to sequences s.. at this offset", and documents
find their slot by their rank among the rests of the same length.  Since
documents may be cut, a share of the longest rests is given up to pieces of
power-of-two lengths first, which close the gaps of the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.ranking import global_running_sums
from adlens.llm.common import crc32_ids, save, text_batches, tokenizer

#: Shares of the rests that may be given up to power-of-two pieces, tried in order.
SHARES = (0, 1 / 512, 1 / 128, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4)


def spf_histogram(counts: dict[int, int], seq_len: int) -> tuple[list[tuple], int, int]:
    """(slots, sequences, padding) of packing ``counts[length]`` pieces.

    A slot is (length, lo, hi, sequence, offset): the pieces of that length
    with rank lo <= r < hi go to sequence + r - lo, at offset.  Placing one by one,
    longest first, each into the emptiest open pack that fits (a new one if
    none does), gives the same result.  A sequence whose used length is a power of
    two needs no padding.
    """
    free: dict[int, list[list[int]]] = {}  # free space -> runs of sequences [first, count]
    slots, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = max((f for f, runs in free.items() if runs), default=0)
            if room < length:  # no open pack fits: fill new ones, one after another
                each = seq_len // length
                packs, more = divmod(left, each)
                for n, deep in ((packs, each), (1, more)):
                    if n and deep:
                        for k in range(deep):
                            slots.append((length, rank, rank + n, used, k * length))
                            rank += n
                        free.setdefault(seq_len - deep * length, []).append([used, n])
                        used += n
                left = 0
                break
            first, count = free[room].pop()
            n = min(left, count)
            slots.append((length, rank, rank + n, first, seq_len - room))
            free.setdefault(room - length, []).append([first, n])
            if n < count:
                free[room].append([first + n, count - n])
            rank, left = rank + n, left - n
    padding = sum(f * n for f, runs in free.items() for _, n in runs
                  if (seq_len - f) & (seq_len - f - 1))
    return slots, used, padding


def plan(counts: dict[int, int], seq_len: int, enough: float = 0.0005):
    """(given up per length, slots, sequences, padding): the least share of
    rests given up to power-of-two pieces with little padding."""
    total, tokens, best = sum(counts.values()), sum(k * n for k, n in counts.items()), None
    for share in SHARES:
        wanted, given = int(-(-total * share // 1)), {}
        for length in sorted(counts, reverse=True):
            if wanted and length & (length - 1):
                given[length] = min(wanted, counts[length])
                wanted -= given[length]
        pieces = {k: n - given.get(k, 0) for k, n in counts.items()}
        for length, n in given.items():
            for bit in range(length.bit_length()):
                if length >> bit & 1:
                    pieces[1 << bit] = pieces.get(1 << bit, 0) + n
        slots, used, padding = spf_histogram({k: n for k, n in pieces.items() if n}, seq_len)
        if best is None or padding < best[3]:
            best = (given, slots, used, padding)
        if padding <= enough * tokens:
            break
    return best


def _parts(counts: dict[int, int], given: dict[int, int]) -> list[tuple]:
    """Rows (rest, cut, piece start, piece length, rank shift, piece index):
    the pieces of a rest, whole or given up."""
    rows, at = [], {k: n - given.get(k, 0) for k, n in counts.items()}
    for length in sorted(counts):
        rows.append((length, False, 0, length, -given.get(length, 0), -1))
        start = 0
        if given.get(length):
            for i, bit in enumerate(b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1):
                size = 1 << bit
                rows.append((length, True, start, size, at.get(size, 0), i))
                at[size] = at.get(size, 0) + given[length]
                start += size
    return rows


def tokenize_pieces(df: DataFrame, tokenizer_path: str, end_id: int | None, seq_len: int,
                    id_col: str, text_col: str) -> DataFrame:
    """Per document: id, n, full (crc32 of each full sequence), rest, rest_crc,
    cut_crcs (crc32 of the rest's power-of-two pieces, longest first)."""
    schema = "id long, n long, full array<long>, rest int, rest_crc long, cut_crcs array<long>"

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for a, b in text_batches(texts, 4_000_000):
                    flat, sizes = tokenizer(tokenizer_path).encode(texts[a:b])
                    if end_id is not None:
                        flat = np.insert(flat, np.cumsum(sizes), end_id)
                        sizes = sizes + 1
                    yield pack(ids[a:b], flat.astype("<u4"), sizes)

    def pack(ids, flat, sizes):
        full, rest, rest_crc, cut = [], [], [], []
        at = 0
        for n in sizes.tolist():
            doc, at = flat[at:at + n], at + n
            whole = n // seq_len * seq_len
            full.append([crc32_ids(doc[i:i + seq_len]) for i in range(0, whole, seq_len)])
            tail = doc[whole:]
            rest.append(len(tail))
            rest_crc.append(crc32_ids(tail))
            start, crcs = 0, []
            for bit in range(len(tail).bit_length() - 1, -1, -1):
                if len(tail) >> bit & 1:
                    crcs.append(crc32_ids(tail[start:start + (1 << bit)]))
                    start += 1 << bit
            cut.append(crcs)
        many = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(full, many),
            pa.array(rest, pa.int32()), pa.array(rest_crc, pa.int64()), pa.array(cut, many)],
            names=["id", "n", "full", "rest", "rest_crc", "cut_crcs"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int | None = 0,
                   seq_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Tokens are made once; what travels are lengths and checksums.  Ranks come
    from a range sort with offsets per partition, so a length that a third of the
    documents share is spread.  The histogram (at most ``seq_len`` rows) goes
    to the driver; the tables of pieces and slots grow with the number of
    lengths, not of documents, and are joined by broadcast.

    Null text counts as empty (its end id alone is packed; without ``end_id``
    it has no piece).  Null ids and repeated rows are packed like others; of
    rows with equal id and ids, either may get either place.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    spark = df.sparkSession
    docs = save(tokenize_pieces(df, tokenizer_path, end_id, seq_len, id_col, text_col)
                .withColumn("one", F.lit(1).cast("bigint"))
                .withColumn("many", F.size("full").cast("bigint")), "pack-docs")
    counts = {r[0]: r[1] for r in docs.where("rest > 0").groupBy("rest").count().collect()}
    given, slots, used, _ = plan(counts, seq_len)
    ranked = global_running_sums(docs, ["rest", "id", "n", "rest_crc"], ["one", "many"])
    ranked = save(ranked, "pack-ranked")
    skip, base = int(docs.where("rest = 0").count()), {}
    for length in sorted(counts):
        base[length] = skip
        skip += counts[length]
    parts = spark.createDataFrame(
        [(*r, base[r[0]], given.get(r[0], 0)) for r in _parts(counts, given)],
        "rest int, cut boolean, p_start long, length long, shift long, crc_at int, base long, given long")
    slot_rows = spark.createDataFrame(
        slots, "length long, lo long, hi long, seq long, offset long")
    rank = F.col("cum_one") - 1 - F.col("base")
    pieces = ranked.join(F.broadcast(parts), "rest").where(F.col("cut") == (rank < F.col("given")))
    pieces = pieces.select(
        "id", "n", (F.col("n") - F.col("rest") + F.col("p_start")).alias("start"), "length",
        F.when(F.col("cut"), F.element_at("cut_crcs", F.col("crc_at") + 1)).otherwise(
            F.col("rest_crc")).alias("crc"), (rank + F.col("shift")).alias("r"))
    placed = pieces.join(F.broadcast(slot_rows), "length").where("lo <= r and r < hi").select(
        "id", "start", "length", "crc", "n", (F.col("seq") + F.col("r") - F.col("lo")).alias("seq"), "offset")
    whole = ranked.select("id", "n", (F.col("cum_many") - F.col("many") + used).alias("seq"),
                          F.posexplode("full").alias("i", "crc"))
    whole = whole.select("id", (F.col("i") * F.lit(seq_len)).cast("bigint").alias("start"),
                         F.lit(seq_len).cast("bigint").alias("length"), "crc", "n",
                         (F.col("seq") + F.col("i")).alias("seq"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(whole).select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), F.col("seq").alias("sequence_id"), "offset")
