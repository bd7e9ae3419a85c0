"""Helpers shared by the training-data operators.

* ``save`` cuts lineage with a written table in the shared checkpoint folder.
* ``join_salted`` joins a frame with hot keys to a keyed summary; ``join_hot`` does so by
  the number of rows, and repeats the summary of hot keys only.
* ``ChunkTokenizer`` encodes whole texts exactly as the ``tokenizers`` file
  does, paying the slow path once per distinct word of a batch.
* ``word_hashes`` turns texts into 64-bit word hashes without a Python loop
  per word.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, one per call."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result survives
    lost executors and is computed once."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_each(files: DataFrame, *cols: str) -> DataFrame:
    """The rows of a small table of files, one per task.  (The number is
    given, since adaptive coalescing would see a few bytes and put all files into one task.)"""
    return files.select(*cols).repartition(max(1, files.count()))


def join_salted(left: DataFrame, right: DataFrame, key: str, spread, how: str = "left",
                salts: int = 32) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may have hot keys and ``right`` has
    one row per key.  Rows of ``left`` are dealt over ``salts`` sub-keys by
    the hash of ``spread``; ``right`` is repeated once per sub-key."""
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"], how).drop("_salt")


#: 8-byte words of a table that may be sent whole to all executors (16 MB).
SENT_WORDS = 1 << 21


def fits(rows: int, width: int) -> bool:
    """Whether ``rows`` rows of ``width`` words, with their entries in a hash table, may be sent whole."""
    return rows * (width + 8) <= SENT_WORDS


def sized(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` as a side of a join: sent whole to all executors if its counted rows fit, else both sides
    are shuffled.  Left alone, Spark guesses from compressed files, takes an array for one entry and
    the rows of an explode for as many as before it, and sends tables the driver can't hold."""
    return df.hint("broadcast" if fits(rows, width) else "merge")


def join_hot(left: DataFrame, right: DataFrame, rows: int, key: str, spread, hot, how: str = "left",
             salts: int = 32) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may have hot keys and ``right`` has one row per key, at
    most ``rows`` of two or three numbers.  If they don't fit, both are shuffled, and rows of the keys
    that ``hot()`` lists are dealt over ``salts`` sub-keys by the hash of ``spread``."""
    keys = [] if fits(rows, 3) else hot()
    if not keys:
        return left.join(sized(right, rows, 3), key, how)
    is_hot, last = F.col(key).isin(keys), F.lit(salts - 1)
    l = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, last).otherwise(0))))
    return l.join(r.hint("merge"), [key, "_salt"], how).drop("_salt")


def hot_bound(rows: int) -> int:
    """Keys with more of ``rows`` rows than this are hot: fewer than 512 of them, whatever the data."""
    return max(64, rows // 512)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data) & 0xFFFFFFFF


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 of every i, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def text_batches(texts, max_chars: int = 2_000_000):
    """Slices (from, to) of a list of texts, each of about ``max_chars``
    characters (a longer text alone is a slice)."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > max_chars:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


# --- tokenising -----------------------------------------------------------

#: Texts where a cut before a space or line break could change the pieces:
#: neighbouring white space, other white space or control characters, and
#: strings of special tokens.
_ODD = ("[ \\n][ \\n]|^[ \\n]|[ \\n]$|[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}]|\\x{1680}|\\x{180e}"
        "|[\\x{2000}-\\x{200f}]|[\\x{2028}-\\x{202f}]|\\x{205f}|\\x{3000}|\\x{feff}|<\\|")
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def _byte_letters() -> dict[int, str]:
    """The byte-to-letter table of byte-level BPE: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


#: ASCII letters, and ASCII marks other than the apostrophe (which begins contractions).
_ASCII_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True


def cut_texts(texts: pa.Array, blanks: bool) -> pa.Array:
    """The texts with a zero byte where an ASCII letter and an ASCII mark meet, and for each space and
    line break (``blanks``) or before it."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return texts.cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    letter, mark, blank = _ASCII_LETTER[data], _MARK[data], (data == 32) | (data == 10)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    cut[offsets[(offsets > 0) & (offsets < len(data))]] = False     # a text begins: nothing meets there
    if blanks:
        data = np.where(blank, np.uint8(0), data)
    else:
        cut |= blank
    at = np.flatnonzero(cut)
    offsets = offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                 pa.py_buffer(np.insert(data, at, 0))])


class ChunkTokenizer:
    """Whole-text encoding with a tokenizers file, by distinct word.

    Both tokenizers cut a text before every single space or line break that
    stands between non-blank characters, and between an ASCII letter and an ASCII mark other than
    the apostrophe, and encode the pieces independently,
    so the ids of a text are the joined ids of these pieces.  Each distinct
    piece of a batch is encoded once and remembered (up to ``keep`` pieces).
    Texts in which such a cut is not certain go to the tokenizer whole; long
    ones in segments cut where a letter, one space and a letter meet.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.lower = (json.load(f).get("normalizer") or {}).get("type") is not None
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.keep = keep
        self.index: dict[str, int] = {}
        self.start = np.zeros(1024, dtype=np.int64)
        self.length = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _word(self, piece: str):
        """Ids of a piece that is one pre-token of Latin letters, else None."""
        if self.lower:
            word = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).lower()
        else:
            word = piece[1:] if piece[:1] == " " else piece
        if not word.isalpha() or max(word) >= "ɐ":
            return None
        raw = (word if self.lower else piece).encode().decode("latin-1")
        return [t.id for t in self.model.tokenize(raw.translate(self.letters))]

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        out = [self._word(p) for p in pieces]
        hard = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(hard), 512):
            part = hard[at:at + 512]
            enc = self.tok.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, enc):
                out[i] = e.ids
        return out

    def _add(self, new: list[list[int]], base: int) -> None:
        lens = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        total = int(lens.sum())
        while base + len(new) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.fromiter(
            (x for ids in new for x in ids), dtype=np.uint32, count=total)
        self.start[base:base + len(new)] = self.used + np.cumsum(lens) - lens
        self.length[base:base + len(new)] = lens
        self.used += total

    def _whole(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > 200_000:
                m = _SAFE_CUT.search(text, at + 100_000)
                end = m.start() if m else end
            enc = self.tok.encode_batch_fast([text[at:end]], add_special_tokens=False)[0]
            parts.append(np.array(enc.ids, dtype=np.uint32))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, length of each text's ids)."""
        arr = pa.array(texts, type=pa.large_string())
        if self.lower:  # a capital sigma is lowered by what follows it
            odd = pc.match_substring_regex(arr, "<\\||\\x00|\u03a3")
        else:
            odd = pc.match_substring_regex(arr, _ODD)
        odd = np.asarray(odd.to_numpy(zero_copy_only=False), dtype=bool)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), arr)
        lists = pc.split_pattern(cut_texts(plain, self.lower), "\0")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        idx = np.fromiter((self.index.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(idx < 0)
        kept_used, base = self.used, len(self.index)
        if len(missing):
            pieces = [words[i] for i in missing]
            self._add(self._encode(pieces), base)
            idx[missing] = base + np.arange(len(missing))
        of_piece = idx[coded.indices.to_numpy()]
        lens = self.length[of_piece]
        ids = self.flat[ragged(self.start[of_piece], lens)]
        bounds = lists.offsets.to_numpy()
        cum = np.concatenate([[0], np.cumsum(lens)])
        sizes = cum[bounds[1:]] - cum[bounds[:-1]]
        if len(missing):
            room = max(0, self.keep - base)
            for k, w in enumerate(pieces[:room]):
                self.index[w] = base + k
            if room < len(missing):  # full: forget what does not fit
                self.used = int(self.start[base + room]) if room else kept_used
        if odd.any():
            parts, at = [], np.concatenate([[0], np.cumsum(sizes)])
            for i in range(len(texts)):
                parts.append(self._whole(texts[i]) if odd[i] else ids[at[i]:at[i + 1]])
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ids = np.concatenate(parts)
        return ids, sizes


_TOKENIZERS: dict[str, ChunkTokenizer] = {}
_KEPT: dict[str, object] = {}


def keep_one(key: str, make):
    """One large object per Python worker, made once, until another key's takes its place,
    a tokenizer is loaded or words are hashed (other operators' work).  Tokenizers go before it is made."""
    if key not in _KEPT:
        let_go()
        _TOKENIZERS.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what ``keep_one`` holds."""
    _KEPT.clear()


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker and file.  Spark uses a worker again
    for other operators, so what these keep is let go here, and the tokenizer there."""
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _POWERS.clear()
        let_go()
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


# --- word hashes ----------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    if size not in _POWERS:
        _POWERS.clear()
        _TOKENIZERS.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(_BASE))
            up[0] = 1
            down = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
            down[0] = 1
            _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


#: Bytes between letter runs: ASCII other than letters.
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[[*range(65), *range(91, 97), *range(123, 128)]] = True


def letter_terms(texts: list[str], stem: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter runs of all texts, and of the first ``stem`` bytes
    of longer ones; and the text each belongs to.  Letters are A-Z, a-z and all
    characters beyond ASCII, lowered."""
    terms, owner = [], []
    for a, b in text_batches(texts, 1 << 20):
        blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts[a:b]]
        raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _NO_LETTER[raw], [True]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            continue
        ends = np.cumsum(np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) + 1)
        of = a + np.searchsorted(ends, first, side="right")
        up, down = _powers(len(raw))
        with np.errstate(over="ignore"):
            pre = np.empty(len(raw) + 1, dtype=np.uint64)
            pre[0] = 0
            np.cumsum(_BYTES[raw] * up[:len(raw)], out=pre[1:])
            long = np.flatnonzero(last - first > stem)
            terms.append(mix64((pre[last] - pre[first]) * down[first] ^ (last - first).astype(np.uint64)))
            terms.append(mix64((pre[first[long] + stem] - pre[first[long]]) * down[first[long]] ^ np.uint64(1 << 40)))
        owner += [of, of[long]]
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(terms), np.concatenate(owner)


def _segment_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64), first
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        pre = np.empty(len(raw) + 1, dtype=np.uint64)
        pre[0] = 0
        np.cumsum(_BYTES[_LOWER[raw]] * up[:len(raw)], out=pre[1:])
        h = (pre[last] - pre[first]) * down[first]
        return mix64(h ^ (last - first).astype(np.uint64)), first


def word_hashes(texts: list[str], segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of characters other than space and
    tab to carriage return, A-Z lowered) of all texts joined, and the number of
    words of each text.  Long texts are hashed in segments cut at a blank."""
    let_go()
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    for a, b in text_batches(texts, segment):
        blobs = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        if b - a == 1 and len(blobs[0]) > 4 * segment:
            raw, at = np.frombuffer(blobs[0], dtype=np.uint8), 0
            while at < len(raw):
                end = min(len(raw), at + segment)
                if end < len(raw):
                    more = np.flatnonzero(_SPACE[raw[end:end + 64 * segment]])
                    end = end + int(more[0]) if len(more) else len(raw)
                h, _ = _segment_hashes(raw[at:end])
                hashes.append(h)
                counts[a] += len(h)
                at = end
            continue
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) + 1
        raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
        h, first = _segment_hashes(raw)
        hashes.append(h)
        counts[a:b] = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)])))
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


_C = mix64(np.arange(11, 16, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``width``
    words; with fewer words the whole sequence is one shingle; none without
    words."""
    h, counts = word_hashes(texts)
    c = [_C[i % len(_C)] * np.uint64(2 * (i // len(_C)) + 1) for i in range(width)]
    with np.errstate(over="ignore"):
        if len(h) >= width:
            n = len(h) - width + 1
            s = np.zeros(n, dtype=np.uint64)
            for i in range(width):
                s += h[i:i + n] * c[i]
            s = mix64(s)
        out, at = [], 0
        for k in counts.tolist():
            if k >= width:
                out.append(np.unique(s[at:at + k - width + 1]))
            elif k:
                v = (h[at:at + k] * np.array(c[:k])).sum(dtype=np.uint64)
                out.append(mix64(np.array([v ^ np.uint64(k)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += k
    return out


# --- sorted streams -------------------------------------------------------

def sorted_groups(batches, keys: int):
    """Whole groups (one Arrow table each) of batches sorted by their first
    ``keys`` columns.  One group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
