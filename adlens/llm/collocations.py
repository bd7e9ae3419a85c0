"""Collocations: phrases whose words occur together far more than apart.

Counting is level by level.  Each task counts word sequences in a shallow trie
over task-local word ids: a node holds a hash container (suffix of ids -> count)
that bursts into one container per next word when it grows.  Beyond a bound of
entries whole subtrees leave as sorted runs of (phrase, count), one compressed block per
prefix partition; a prefix partition gets its blocks of all tasks and sums them.  It holds
the sequences that agree in all words but the last two and in a few bits of the next
word, so the subtree of a hot prefix is dealt over many.  A sequence is counted only if its parts may be frequent: bit
filters of bounded size, made of the level before, say so.  They
only steer: a false hit costs a row and never changes a count.
"""

from __future__ import annotations

import json
import zlib
from collections import _count_elements
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import mix64, save, sorted_groups

#: Entries of a task's trie before subtrees leave, of a container before it bursts,
#: and bytes of text that are cut into words at once.
MAX_ENTRIES, BURST, SLICE = 600_000, 4_096, 4 << 20
#: Local word ids have 16 bits (a few are kept free); 0 is no word.
MAX_IDS = (1 << 16) - 64
#: Bits of a word that cut the subtree below a prefix; prefix partitions per shuffle partition.
NEXT_BITS, SHARES = np.uint64(63), 4
#: Least and most bits of a filter (at most 16 MB), and bits per entry between.
FILTER_BITS = (1 << 16, 1 << 27, 16)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


# --- words ----------------------------------------------------------------

def _segments(raw: np.ndarray, ends: np.ndarray):
    """Slices (from, to) of the bytes of joined texts, of about SLICE bytes, cut at the
    end of a text or, in a long text, at a break character."""
    at = 0
    while at < len(raw):
        to = at + SLICE
        if to >= len(raw):
            to = len(raw)
        else:
            k = int(np.searchsorted(ends, to, side="right")) - 1
            if k >= 0 and ends[k] > at:
                to = int(ends[k])
            else:
                limit, step = int(ends[np.searchsorted(ends, at, side="right")]), to
                to = limit
                while step < limit:
                    hit = np.flatnonzero(_BREAK[raw[step:min(limit, step + SLICE)]])
                    if len(hit):
                        to = step + int(hit[0])
                        break
                    step += SLICE
        yield at, to
        at = to


def word_batches(texts: pa.Array):
    """(codes, words, same) of slices of texts: the word of each place as a position in
    ``words``, and whether the next place is in the same piece."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    ends = np.unique(offsets[1:] - offsets[0])
    for a, b in _segments(data, ends[ends > 0]):
        raw = _LOWER[data[a:b]]
        word, cut = _WORD[raw], np.cumsum(_BREAK[raw], dtype=np.int32)
        joint = ends[(ends > a) & (ends < b)] - a       # texts begin here
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[joint] |= word[joint]
        last[joint - 1] |= word[joint - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        if not len(first):
            continue
        text = np.searchsorted(joint, first, side="right")
        bounds = np.concatenate([[0], np.cumsum(last - first + 1)])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)),
                                                                      pa.py_buffer(raw[word])]).dictionary_encode()
        same = np.zeros(len(first), dtype=bool)
        same[:-1] = (cut[first[1:]] == cut[first[:-1]]) & (text[1:] == text[:-1])
        yield words.indices.to_numpy(), words.dictionary.to_pylist(), same


def by_lang(batch: pa.RecordBatch):
    """(lang, texts) of the rows of each language of a batch (lang, text)."""
    langs = batch.column(0).dictionary_encode()
    codes = langs.indices.to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pa.array(codes == i))


# --- the trie -------------------------------------------------------------

class HatTrie:
    """Counts of sequences of two to four word ids, packed to 16 bits a word."""

    def __init__(self):
        self.root: dict[int, tuple[bool, dict]] = {}    # id -> (burst, container or id -> container)
        self.entries = 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        head = keys >> np.uint64(48)
        at = np.flatnonzero(np.diff(head, prepend=head[:1] + np.uint64(1)))
        suffix = keys & np.uint64((1 << 48) - 1)
        for first, a, b in zip(head[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]):
            burst, node = self.root.get(first) or (False, {})
            if burst:
                self._below(node, suffix[a:b])
                continue
            before = len(node)
            _count_elements(node, suffix[a:b].tolist())
            self.entries += len(node) - before
            if len(node) > BURST:
                burst, node = True, self._burst(node)
            self.root[first] = burst, node

    @staticmethod
    def _burst(container: dict) -> dict:
        out: dict[int, dict] = {}
        for key, n in container.items():
            out.setdefault(key >> 32, {})[key & 0xFFFFFFFF] = n
        return out

    def _below(self, children: dict, suffix: np.ndarray) -> None:
        head = suffix >> np.uint64(32)
        at = np.flatnonzero(np.diff(head, prepend=head[:1] + np.uint64(1)))
        tail = (suffix & np.uint64(0xFFFFFFFF)).tolist()
        for second, a, b in zip(head[at].tolist(), at.tolist(), [*at[1:].tolist(), len(suffix)]):
            node = children.setdefault(second, {})
            before = len(node)
            _count_elements(node, tail[a:b])
            self.entries += len(node) - before

    def spill(self, keep: int):
        """Whole subtrees, largest first, until ``keep`` entries are left: one sorted
        run of (keys, counts)."""
        size = {first: sum(map(len, node.values())) if burst else len(node) for first, (burst, node) in self.root.items()}
        heads, containers = [], []
        for first in sorted(size, key=lambda x: (-size[x], x)):
            if self.entries <= keep:
                break
            burst, node = self.root.pop(first)
            self.entries -= size[first]
            heads += [first << 48 | second << 32 for second in node] if burst else [first << 48]
            containers += node.values() if burst else [node]
        lengths = np.fromiter(map(len, containers), dtype=np.int64, count=len(containers))
        total = int(lengths.sum())
        keys = np.fromiter(chain.from_iterable(containers), dtype=np.uint64, count=total)
        keys |= np.repeat(np.array(heads, dtype=np.uint64), lengths)
        counts = np.fromiter(chain.from_iterable(x.values() for x in containers), dtype=np.int64, count=total)
        order = np.argsort(keys)
        return keys[order], counts[order]


# --- filters --------------------------------------------------------------

def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, zlib.crc32(lang.encode("utf-8", "surrogatepass")))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b))


def bit_filter(frequent: DataFrame, words: int) -> np.ndarray:
    """Bits of the hashes of phrases of ``words`` (1 or 2) words, as 64-bit words; the size
    follows the number of phrases up to a bound."""
    low, high, each = FILTER_BITS
    bits = min(high, max(low, 1 << (each * frequent.count()).bit_length()))

    def slots(batches):
        for batch in batches:
            lang, phrase = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [[word_hash(w, g) for w in p.encode("utf-8", "surrogatepass").split(b" ")] for g, p in zip(lang, phrase)]
            h = np.array(parts, dtype=np.uint64).reshape(len(parts), words)
            slot = (h[:, 0] if words == 1 else pair_hash(h[:, 0], h[:, 1])) % np.uint64(bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)),
                                              pa.array((slot & np.uint64(63)).astype(np.int32))], ["at", "bit"])

    held = frequent.select("lang", "phrase").mapInArrow(slots, "at long, bit int").groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[held["at"].to_numpy()] = held["word"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h % np.uint64(len(bits) << 6)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


# --- levels ---------------------------------------------------------------

def _run(lang: str, phrases, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                       pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def blocks(runs: list[tuple[pa.Array, np.ndarray, np.ndarray]], parts: int):
    """Runs (keys, counts, hashes of the prefixes) as rows (part, size, body): the lengths, counts and bytes of
    the keys of a prefix partition, compressed."""
    if not sum(len(n) for _, n, _ in runs):
        return
    keys = pa.concat_arrays([k.cast(pa.large_binary()) for k, _, _ in runs])
    counts, part = np.concatenate([n for _, n, _ in runs]), np.concatenate([h for _, _, h in runs]) % np.uint64(parts)
    order = np.argsort(part, kind="stable")             # keys stay in order inside a part
    keys, counts, part = keys.take(pa.array(order)), counts[order], part[order].astype(np.int32)
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset:keys.offset + len(keys) + 1]
    data, lengths = memoryview(keys.buffers()[2]), np.diff(offsets).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
    rows = ([], [], [])
    for a, b in zip(cuts, cuts[1:]):
        body = lengths[a:b].tobytes() + counts[a:b].astype(np.uint64).tobytes() + bytes(data[offsets[a]:offsets[b]])
        for col, x in zip(rows, (part[a], b - a, np.uint32(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True))):
            col.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())],
                                     ["part", "size", "body"])


def unpacked(size: int, body: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(body[4:], int(np.frombuffer(body[:4], np.uint32)[0]), "zstd", asbytes=True)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, size), dtype=np.int64)])
    keys = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(raw[12 * size:])])
    return keys, np.frombuffer(raw, np.uint64, size, 4 * size).astype(np.int64)


def sum_blocks(least: int):
    """Sums the blocks of each prefix partition; keys with ``least`` or more as (lang, phrase, n)."""
    def run(batches):
        for group in sorted_groups(batches, 1):
            parts = [unpacked(n, body) for n, body in zip(group["size"].to_pylist(), group["body"].to_pylist())]
            keys = pa.concat_arrays([k for k, _ in parts]).dictionary_encode()
            total = np.zeros(len(keys.dictionary), dtype=np.int64)
            np.add.at(total, keys.indices.to_numpy(), np.concatenate([n for _, n in parts]))
            often = np.flatnonzero(total >= least)
            named = [k.split(b"\n", 1) for k in keys.dictionary.take(pa.array(often)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([json.loads(g) for g, _ in named], pa.string()),
                                              pa.array([p for _, p in named], pa.binary()).cast(pa.string()),
                                              pa.array(total[often])], ["lang", "phrase", "n"])
    return run


def count_words(batches):
    """Sorted runs of the words of a task's rows (lang, text)."""
    held: dict[str, dict[bytes, int]] = {}

    def leave():
        for lang, counts in held.items():
            words = sorted(counts)
            for k in range(0, len(words), 100_000):
                part = words[k:k + 100_000]
                yield _run(lang, part, [counts[w] for w in part])
        held.clear()

    for batch in batches:
        for lang, texts in by_lang(batch):
            for codes, words, _ in word_batches(texts):
                counts = held.setdefault(lang, {})
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    counts[w] = counts.get(w, 0) + n
        if sum(map(len, held.values())) > MAX_ENTRIES:
            yield from leave()
    yield from leave()


class LocalCounter:
    """The trie and word ids of one language in one task."""

    def __init__(self, lang: str, single: np.ndarray, pairs: np.ndarray | None):
        self.lang, self.single, self.pairs = lang, single, pairs
        self.forget()

    def forget(self):
        self.index: dict[bytes, int] = {}       # 0: not frequent
        self.words, self.hashes = [b""], [0]
        self.trie = HatTrie()

    def add(self, codes: np.ndarray, words: list[bytes], same: np.ndarray):
        """Counts a slice; yields the runs that leave (keys, counts, hashes of the prefixes)."""
        unknown = [w for w in words if w not in self.index]
        h = np.fromiter((word_hash(w, self.lang) for w in unknown), dtype=np.uint64, count=len(unknown))
        maybe = passes(self.single, h)
        if len(self.words) + int(maybe.sum()) > MAX_IDS or len(self.index) + len(unknown) > 4 * MAX_ENTRIES:
            yield from self.leave(0)
            self.forget()
            if len(words) > MAX_IDS and int(np.unique(codes).size) > 1:  # more words than ids: halves, sharing three places
                half = len(codes) // 2
                for a, b in ((0, half), (half, len(codes))):
                    used, part = np.unique(codes[a:b], return_inverse=True)
                    inner = same[a:b].copy()
                    inner[-1] = False
                    yield from self.add(part, [words[i] for i in used], inner)
                a, b = max(0, half - 3), min(len(codes), half + 3)
                yield from self._count(self._ids(codes[a:b], words), same[a:b], half - a)
                return
            unknown = words
            h = np.fromiter((word_hash(w, self.lang) for w in unknown), dtype=np.uint64, count=len(unknown))
            maybe = passes(self.single, h)
        for w, x, ok in zip(unknown, h.tolist(), maybe.tolist()):
            self._learn(w, x, ok)
        yield from self._count(self._ids(codes, words), same, None)

    def _learn(self, word: bytes, h: int, frequent: bool) -> None:
        self.index[word] = len(self.words) if frequent else 0
        if frequent:
            self.words.append(word)
            self.hashes.append(h)

    def _ids(self, codes, words) -> np.ndarray:
        for i in np.unique(codes).tolist() if len(codes) <= 6 else ():
            if words[i] not in self.index:
                h = word_hash(words[i], self.lang)
                self._learn(words[i], h, bool(passes(self.single, np.array([h], dtype=np.uint64))[0]))
        get = self.index.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))[codes]

    def _count(self, ids: np.ndarray, same: np.ndarray, over: int | None):
        """Counts sequences of the ids; with ``over`` only those across that place."""
        zero = np.uint64(0)
        pair = same[:-1] & (ids[:-1] > zero) & (ids[1:] > zero)
        place = np.arange(len(pair))
        across = lambda n: True if over is None else (place[:len(pair) - n + 2] < over) & (place[:len(pair) - n + 2] + n > over)
        keys = []
        if self.pairs is None:
            at = np.flatnonzero(pair & across(2))
            keys.append(ids[at] << np.uint64(48) | ids[at + 1] << np.uint64(32))
        elif len(pair) > 1:
            h = np.array(self.hashes, dtype=np.uint64)[ids]
            pair = pair.copy()
            at = np.flatnonzero(pair)
            pair[at] = passes(self.pairs, pair_hash(h[at], h[at + 1]))
            three = pair[:-1] & pair[1:]
            at = np.flatnonzero(three & across(3))
            keys.append(ids[at] << np.uint64(48) | ids[at + 1] << np.uint64(32) | ids[at + 2] << np.uint64(16))
            at = np.flatnonzero(three[:-1] & pair[2:] & across(4))
            keys.append(ids[at] << np.uint64(48) | ids[at + 1] << np.uint64(32) | ids[at + 2] << np.uint64(16) | ids[at + 3])
        if sum(map(len, keys)):
            self.trie.add(np.concatenate(keys))
            if self.trie.entries > MAX_ENTRIES:
                yield from self.leave(MAX_ENTRIES // 2)

    def leave(self, keep: int):
        """The run of (keys, counts, hashes of the prefixes) that leaves; a key is the language and the phrase."""
        keys, counts = self.trie.spill(keep)
        words, hashes = pa.array(self.words, pa.binary()), np.array(self.hashes, dtype=np.uint64)
        heads = pc.binary_join_element_wise(json.dumps(self.lang).encode(), words, b"\n")
        ids = [(keys >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int64) for s in (48, 32, 16, 0)]
        length = 2 + (ids[2] > 0) + (ids[3] > 0)
        h = [hashes[x] for x in ids[:3]]
        parts = np.where(length == 2, pair_hash(h[0], h[1] & NEXT_BITS), pair_hash(pair_hash(h[0], h[1]), h[2] & NEXT_BITS))
        for m in (2, 3, 4):
            mine = np.flatnonzero(length == m)
            if len(mine):
                at = [pa.array(x[mine]) for x in ids[:m]]
                yield pc.binary_join_element_wise(heads.take(at[0]), *[words.take(x) for x in at[1:]], b" "), counts[mine], parts[mine]


def count_phrases(parts: int, single, pairs=None):
    """Sorted runs, as blocks, of the two-word phrases of frequent words, or, with the filter of
    frequent pairs, of three and four words."""
    def run(batches):
        counters: dict[str, LocalCounter] = {}

        def leave():
            yield from blocks([r for x in counters.values() for r in x.leave(0)], parts)
            counters.clear()

        for batch in batches:
            for lang, texts in by_lang(batch):
                for part in word_batches(texts):
                    if lang not in counters:
                        counters[lang] = LocalCounter(lang, single.value, pairs.value if pairs else None)
                    yield from blocks(list(counters[lang].add(*part)), parts)
            if sum(x.trie.entries for x in counters.values()) > 2 * MAX_ENTRIES or len(counters) > 64:
                yield from leave()
        yield from leave()
    return run


def merged(blocks_of: DataFrame, least: int, name: str) -> DataFrame:
    """(lang, phrase, n) with n >= ``least``: the blocks, summed in their prefix partitions."""
    dealt = blocks_of.repartition("part").sortWithinPartitions("part")
    return save(dealt.mapInArrow(sum_blocks(least), "lang string, phrase string, n long"), name)


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, words, n) of every phrase of one to four
    words that occurs ``least`` times."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a word is a subtree of its own; the table of all words also gives the totals
    words = save(rows.mapInArrow(count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n")), "phrase-words")
    totals, one = words.groupBy("lang").agg(F.sum("n").alias("n")), words.where(F.col("n") >= least)
    schema, parts = "part int, size int, body binary", SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = spark.sparkContext.broadcast(bit_filter(one, 1))
    two = merged(rows.mapInArrow(count_phrases(parts, single), schema), least, "phrase-2")
    pairs = spark.sparkContext.broadcast(bit_filter(two, 2))
    more = merged(rows.mapInArrow(count_phrases(parts, single, pairs), schema), least, "phrase-34")
    every = one.unionByName(two).unionByName(more)
    return totals, every.withColumn("words", F.split("phrase", " "))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, num: int = 80, den: int = 100,
                 scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Words are runs of characters other than space and tab, A-Z lowered, inside pieces
    cut at ``.,;:!?`` and line ends.  A phrase of two to four words with a >=
    ``least`` occurrences is a candidate.  Its score is floor(scale * a / (l + r)) at the
    cut into a first part (l occurrences) and a rest (r) where that is lowest, ties
    to the shortest first part.  A candidate inside a longer one (dropped or
    not) goes if den * f(longer) >= num * a.  Order: score, then a, then the phrase's bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows
    count each.  An empty table gives an empty result; other columns are ignored.
    """
    totals, every = phrase_counts(docs, least, text_col, lang_col)
    f = every.select("lang", "phrase", "n")
    cand = every.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = cand.select("lang", "phrase", "a", F.size("words").alias("m"), "words",
                       F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        f.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = "cast({} as decimal(20,0))"
    score = F.expr(f"(cast({scale} as decimal(10,0)) * {wide.format('a')}) div ({wide.format('l')} + {wide.format('r')})")
    scored = cuts.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    # every shorter phrase inside a longer candidate, with the largest count of these
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = cand.where(F.size("words") > 2).select("lang", F.explode(inside).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"longest is null or {den} * {wide.format('longest')} < {num} * {wide.format('a')}"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
