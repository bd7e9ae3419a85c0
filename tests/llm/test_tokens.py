"""Packing (3), Simple-8b (6) and the chunk tokenizer."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from adlens.llm import packing, simple8b
from adlens.llm.common import ChunkTokenizer, crc32_ids, shingle_sets
from tests.llm.frames import awkward, docs, prose

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("keep", [0, 5, 200_000])
def test_chunks_equal_the_tokenizer(path, keep):
    texts = [t or "" for _, t, _ in awkward()] + ["a\nb", "x  y", " lead", "trail ", "it's 'tis 12 1.5 é ß ﬁ ½", "\n\n"]
    plain, chunk = Tokenizer.from_file(path), ChunkTokenizer(path, keep)
    for _ in range(2):  # the second time from memory
        ids, sizes = chunk.encode(texts)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for t, p in zip(texts, parts):
            assert p.tolist() == plain.encode(t, add_special_tokens=False).ids, t[:50]


def test_long_odd_text_is_cut_safely():
    text = "a  b " + prose(5, 120_000)
    ids, _ = ChunkTokenizer(BYTE).encode([text])
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_long_text_has_the_words_of_its_parts():
    text = " ".join(prose(k, 1000, 100_000) for k in range(900))
    words = text.lower().split()
    assert len(shingle_sets([text])[0]) == len({tuple(words[i:i + 5]) for i in range(len(words) - 4)})


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 1 << 31, 1 << 63])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    if n > 3:
        ids[:: max(1, n // 3)] = (1 << 64) - 1 if top > 1 << 40 else 0
    words, offsets, raw = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, n, raw) == ids).all()
    assert len(offsets) == -(-n // simple8b.BLOCK)


def test_shards_hold_every_document(spark):
    rows = awkward() + [(100 + k, prose(k, 30), "a") for k in range(200)]
    manifest = simple8b.write_ids(docs(spark, rows), WORD, end_id=2)
    got = simple8b.read_ids(manifest).orderBy("start", "n_tokens").collect()
    plain = Tokenizer.from_file(WORD)
    want = sorted(((i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows),
                  key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(x), crc32_ids(np.array(x))) for i, x in want)
    assert simple8b.read_ids(simple8b.write_ids(docs(spark, []), WORD, 2)).collect() == []


def test_a_document_over_many_read_batches(tmp_path):
    ids = np.random.default_rng(0).integers(0, 49408, 3_000_000).astype(np.uint32)
    w = simple8b.ShardWriter(f"{tmp_path}/x.s8b")
    w.add([None, 5, 6], np.array([1, 2_999_999, 0]), ids)
    assert w.close() == (3, 3_000_000)
    assert list(simple8b.shard_documents(f"{tmp_path}/x.s8b")) == [
        (None, 0, 1, crc32_ids(ids[:1])), (5, 1, 2_999_999, crc32_ids(ids[1:])), (6, 3_000_000, 0, 0)]
    with open(f"{tmp_path}/x.s8b", "r+b") as f:
        f.truncate(1000)
    with pytest.raises(ValueError):
        list(simple8b.shard_documents(f"{tmp_path}/x.s8b"))


def one_by_one(counts, seq_len):
    """Longest first, each into the emptiest open pack that fits."""
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = max(range(len(free)), key=lambda i: free[i], default=None)
            if best is None or free[best] < length:
                free.append(seq_len - length)
            else:
                free[best] -= length
    return sorted(free)


def test_histogram_packing_is_shortest_pack_first():
    r = np.random.default_rng(3)
    for _ in range(30):
        counts = {int(k): int(r.integers(1, 40)) for k in r.integers(1, 64, 12)}
        slots, used, _ = packing.spf_histogram(counts, 64)
        load, place = [0] * used, {}
        for length, lo, hi, seq, offset in slots:
            for k in range(lo, hi):
                place.setdefault(seq + k - lo, []).append((offset, length))
                load[seq + k - lo] += length
        for pieces in place.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
        assert sorted(64 - x for x in load) == one_by_one(counts, 64)


def test_packing_awkward_rows(spark):
    rows = awkward() + [(100 + k, prose(k, 1 + k % 90), "a") for k in range(300)]
    got = packing.pack_documents(docs(spark, rows), BYTE, end_id=0, seq_len=128).collect()
    plain = Tokenizer.from_file(BYTE)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    seqs, per = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per.setdefault(r.doc_id, []).append(r)
        assert 1 <= r.length <= 128
        assert any(len(x) == r.doc_tokens and crc32_ids(np.array(x[r.start:r.start + r.length])) == r.ids_crc32
                   for x in want[r.doc_id])
    for i, x in want.items():
        assert sum(r.length for r in per[i]) == sum(map(len, x))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
        padding += (128 - at) if at & (at - 1) else 0
    assert padding <= 0.02 * sum(r.length for r in got)
    assert packing.pack_documents(docs(spark, []), BYTE).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_cut_at_marks_equal_the_library(name):
    """Texts of odd neighbours: letters, marks, apostrophes, composing characters, blanks."""
    import random

    from tokenizers import Tokenizer

    from adlens.llm.common import ChunkTokenizer
    r = random.Random(1)
    parts = ["a", "B", "the", "it's", "'s", "''s", ",", ".", "!", "-", " ", "  ", "\n", "\t", "é", "é", "Σ", "ΑΣ.",
             "ς", "漢", "1", "23", "<", "=", "̸", "…", "\"", "İ", " ", "\x00", "<|endoftext|>", "ß",
             "’", "don't", "x.y", "(a)", "_", "@"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(4000)] + ["", "word, and (more)! it's 'quoted'.\nx; y"]
    mine, theirs = ChunkTokenizer(public_tokenizers.path(name), keep=200), Tokenizer.from_file(public_tokenizers.path(name))
    for at in range(0, len(texts), 700):
        ids, sizes = mine.encode(texts[at:at + 700])
        ends = np.cumsum(sizes)
        for text, a, b in zip(texts[at:at + 700], ends - sizes, ends):
            assert ids[a:b].tolist() == theirs.encode(text, add_special_tokens=False).ids, text
