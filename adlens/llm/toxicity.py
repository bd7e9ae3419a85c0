"""Toxicity by the nearest labelled examples.

Documents and examples are TF-IDF vectors over all terms of the examples (words
and their first bytes); a term's link with the label adds to its weight.  The
examples with the largest cosines are found exactly with an inverted index and a
matrix of the frequent terms; the largest sum of each block of examples bounds the
k-th best, so few examples are looked at again.  Each worker builds the index from
vectors in the shared folder.  The votes of
the nearest, weighted by cosine and by class, are calibrated on the examples
themselves, each scored without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import keep_one, let_go, letter_terms, run_path, save, text_batches

#: Bounds of what is fitted: examples with label 1 and 0.
MAX_POSITIVE, MAX_NEGATIVE = 8_192, 16_384
EXAMPLES_PER_BLOCK = 64
#: Terms of so large a part (1/n) of the examples are scored by a matrix product, for so many queries at once.
FREQUENT, QUERIES = 16, 256
#: Postings summed at once.
ROOM = 1 << 18
#: More than the rounding of single-precision sums of cosines.
SLACK = 1e-4


class BlockMaxIndex:
    """Exact cosine top-k over unit vectors of examples.

    Terms of at least one in ``FREQUENT`` examples are columns of a dense matrix, so that
    one product per batch of queries scores all examples on them in single precision; the others
    have postings, whose weights are summed in double precision.  The largest sums of blocks of
    examples bound the k-th best; the candidates at or over that bound get the cosine on the
    frequent terms in double precision too.
    """

    def __init__(self, terms, weights, lengths, labels, ids, n_terms: int):
        self._build([(terms, weights, lengths, labels, ids)], n_terms, weights.dtype)

    @classmethod
    def of_batches(cls, batches, n_terms: int, kind=np.float32, scale=None) -> "BlockMaxIndex":
        """The index of batches (terms, weights, lengths, labels, ids), gone through twice and never
        held together: every worker holds an index.  Postings are multiplied by ``scale`` (one number a
        term): with a query's TF-IDF factor there, all terms that it holds once need no further product."""
        index = cls.__new__(cls)
        index._build(batches, n_terms, kind, scale)
        return index

    def _build(self, batches, n_terms: int, kind, scale=None) -> None:
        self.scale = np.ones(n_terms) if scale is None else scale
        held = np.zeros(n_terms, dtype=np.int64)
        heavy, labels, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for terms, weights, lengths, y, who in batches:
            held += np.bincount(terms, minlength=n_terms)
            heavy.append(np.array([terms[e - n + np.argmax(weights[e - n:e])] if n else -1
                                   for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist())], dtype=np.int64))
            labels.append(y)
            ids.append(who)
        # examples with the same heaviest term become neighbours, so that few blocks hold the best
        heavy, labels, ids = np.concatenate(heavy), np.concatenate(labels), np.concatenate(ids)
        order = np.lexsort((ids, heavy))
        self.labels, self.ids = labels[order], ids[order]
        self.blocks = len(order) // EXAMPLES_PER_BLOCK + 1
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        often = held >= max(EXAMPLES_PER_BLOCK, len(order) // FREQUENT)
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.dense = np.zeros((len(order), int(self.row.max(initial=-1)) + 1), dtype=kind)
        self.postings = np.concatenate([[0], np.cumsum(np.where(often, 0, held))])
        # a posting is one number: example and weight side by side
        self.pair = np.dtype([("example", np.int32), ("weight", kind)])
        self.flat = np.empty(int(self.postings[-1]), dtype=np.int64 if self.pair.itemsize == 8 else f"V{self.pair.itemsize}")
        view, filled, at = self.flat.view(self.pair), self.postings[:-1].copy(), 0
        for terms, weights, lengths, y, _ in batches:
            example = np.repeat(place[at:at + len(y)], lengths)
            at += len(y)
            row = self.row[terms]
            self.dense[example[row >= 0], row[row >= 0]] = weights[row >= 0]
            rare = np.flatnonzero(row < 0)
            rare = rare[np.argsort(terms[rare], kind="stable")]
            found, first, count = np.unique(terms[rare], return_index=True, return_counts=True)
            to = np.arange(len(rare)) + np.repeat(filled[found] - first, count)
            view["example"][to], view["weight"][to] = example[rare], weights[rare] * self.scale[terms[rare]]
            filled[found] += count
        # kept from query to query: new memory costs more than the sums
        self.score, self.base = np.zeros((self.blocks, EXAMPLES_PER_BLOCK)), np.empty((0, 0), dtype=kind)
        self.held, self.at, self.value = (np.empty(ROOM, x) for x in (self.flat.dtype, np.int64, float))

    def bases(self, terms, weights, lengths) -> np.ndarray:
        """Sums of the frequent terms of some queries, a row of all examples each, until the next call."""
        q = np.zeros((len(lengths), self.dense.shape[1]), dtype=self.dense.dtype)
        row = self.row[terms]
        often = row >= 0
        q[np.repeat(np.arange(len(lengths)), lengths)[often], row[often]] = weights[often]
        if len(self.base) < len(q):
            self.base = np.empty((len(q), len(self.ids)), dtype=self.dense.dtype)
        return np.matmul(q, self.dense.T, out=self.base[:len(q)])

    def _sums(self, terms, weights) -> np.ndarray:
        """Sums of the other terms of a query, in double precision."""
        n = int((self.postings[terms + 1] - self.postings[terms]).sum())
        if not n:
            return np.zeros(len(self.ids))
        if n > ROOM:  # a long text: its terms by halves (no term is that long, see FREQUENT)
            half = len(terms) // 2
            return self._sums(terms[:half], weights[:half]) + self._sums(terms[half:], weights[half:])
        weights = weights / self.scale[terms]
        unit = weights.min()
        more = weights > unit * (1 + 1e-9)
        order = np.argsort(more, kind="stable")
        terms, weights = terms[order], weights[order] / unit
        start, end = self.postings[terms], self.postings[terms + 1]
        length, once = end - start, len(more) - int(more.sum())
        held, at, value = self.held[:n], self.at[:n], self.value[:n]
        np.concatenate([self.flat[a:b] for a, b in zip(start.tolist(), end.tolist())], out=held)
        pair = held.view(self.pair)
        if held.dtype == at.dtype:
            np.bitwise_and(held, 0xFFFFFFFF, out=at)
        else:
            np.copyto(at, pair["example"])
        np.copyto(value, pair["weight"])
        value[n - int(length[once:].sum()):] *= np.repeat(weights[once:], length[once:])
        total = np.bincount(at, weights=value, minlength=len(self.ids))
        total *= unit
        return total

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, base=None):
        """(examples, cosines) of the k best with a cosine over 0, best first,
        ties to the smaller id's place; example ``without`` is passed over.
        ``base`` is the query's row of ``bases``."""
        k = k + (without >= 0)
        if base is None:
            base = self.bases(terms, weights, np.array([len(terms)]))[0]
        row = self.row[terms]
        often = row >= 0
        total = self._sums(terms[~often], weights[~often])
        score = self.score.reshape(-1)[:len(total)]
        np.copyto(score, base)
        score += total
        # k blocks hold an example of that sum at least
        most = self.score.max(1)
        block = np.flatnonzero(most >= self._least(most, k) - SLACK)
        score = self.score[block]
        score = np.where(score > 0, score, -1.0)
        at, place = np.nonzero(score >= self._least(score.ravel(), k) - SLACK)
        at, place = at[score[at, place] > 0], place[score[at, place] > 0]
        who = block[at] * EXAMPLES_PER_BLOCK + place
        exact = (self.dense[who[:, None], row[often]] * weights[often]).T.copy().sum(0) if len(who) else 0.0
        cosine = np.minimum(total[who] + exact, 1.0)
        best = np.lexsort((who, -cosine))[:k]
        best = best[who[best] != without][:k - (without >= 0)]
        return who[best], cosine[best]

    @staticmethod
    def _least(score, k: int) -> float:
        return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else 0.0


class Vocabulary:
    """Terms (hashes) in ascending order with their weights; the first bits of a hash lead to its place."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray):
        order = np.argsort(terms)
        self.size, self.idf = len(terms), idf[order]
        self.terms = np.append(terms[order], np.uint64((1 << 64) - 1))
        bits = max(1, len(terms).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(terms[order] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the term is there) of each hash."""
        at = self.first[(hashes >> self.shift).view(np.int64)].astype(np.int64)
        left = np.flatnonzero(self.terms[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.terms[at[left]] < hashes[left]]
        return at, (self.terms[at] == hashes) & (at < self.size)


def doc_vectors(texts: list[str], words: Vocabulary, stem: int = 5):
    """(terms, weights, lengths): unit TF-IDF vectors, ragged."""
    hashes, owner = letter_terms(texts, stem)
    if not words.size or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(texts), np.int64)
    at, hit = words.find(hashes)
    pair, tf = np.unique(owner[hit] * words.size + at[hit], return_counts=True)
    doc, term = pair // words.size, pair % words.size
    weight = (1 + np.log(tf)) * words.idf[term]
    norm = np.sqrt(np.bincount(doc, weights=weight * weight, minlength=len(texts)))
    return term, weight / norm[doc], np.bincount(doc, minlength=len(texts))


def _files(path: str):
    """Open files of a table in the shared folder, as tasks read them."""
    filesystem, name = pafs.FileSystem.from_uri(path)
    for info in sorted(filesystem.get_file_info(pafs.FileSelector(name)), key=lambda f: f.path):
        if info.base_name.startswith("part-"):
            with filesystem.open_input_file(info.path) as f:
                yield pq.ParquetFile(f)


def read_vocabulary(path: str) -> Vocabulary:
    """The terms that ``toxicity_scores`` wrote."""
    parts = [f.read(use_threads=False) for f in _files(path)]
    terms, idf = (np.concatenate([np.zeros(0, kind), *(p[c].to_numpy() for p in parts)])
                  for c, kind in (("term", np.int64), ("idf", float)))
    return Vocabulary(terms.view(np.uint64), idf)


class _Vectors:
    """Batches of the vectors that ``toxicity_scores`` wrote, read anew each time."""

    def __init__(self, path: str):
        self.path = path

    def __iter__(self):
        for f in _files(self.path):
            for batch in f.iter_batches(1024, use_threads=False):
                t, w = batch.column("t"), batch.column("w")
                yield (t.flatten().to_numpy(), w.flatten().to_numpy(), np.diff(t.offsets.to_numpy()).astype(np.int64),
                       batch.column("y").to_numpy().astype(np.int64), batch.column("id").to_numpy())


def read_index(path: str, words: Vocabulary) -> tuple[BlockMaxIndex, dict[int, tuple[int, int]]]:
    """The index over the vectors that ``toxicity_scores`` wrote, and place and mark of the text by id."""
    index = BlockMaxIndex.of_batches(_Vectors(path), words.size, scale=words.idf)
    pa.default_memory_pool().release_unused()
    marks = {}
    for f in _files(path):
        rows = f.read(columns=["id", "mark"], use_threads=False)
        marks.update(zip(rows["id"].to_pylist(), rows["mark"].to_pylist()))
    return index, {i: (k, marks[i]) for k, i in enumerate(index.ids.tolist())}


def votes(labels: np.ndarray, cosines: np.ndarray, counts: np.ndarray, class_weight) -> np.ndarray:
    """Share of label 1 among the nearest of each query (``counts`` in a row), by class and by the odds of the
    cosine, so that copies outweigh the rest; -1 without any."""
    w = cosines / np.maximum(1.001 - cosines, 0.001) * np.where(labels == 1, class_weight[1], class_weight[0])
    of = np.repeat(np.arange(len(counts)), counts)
    mass, ones = np.bincount(of, weights=w, minlength=len(counts)), np.bincount(of, weights=w * labels, minlength=len(counts))
    return np.where(counts > 0, ones / np.where(counts > 0, mass, 1.0), -1.0)


def calibration(raw: np.ndarray, labels: np.ndarray, class_weight) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the vote: (votes, scores), both
    increasing, to interpolate between.  Each level is drawn toward the prior
    by one observation."""
    w = np.where(labels == 1, class_weight[1], class_weight[0])
    prior = float((w * labels).sum() / w.sum()) if len(w) else 0.5
    values, inverse = np.unique(raw, return_inverse=True)
    mass, ones = np.bincount(inverse, weights=w), np.bincount(inverse, weights=w * labels)
    levels: list[list[float]] = []  # [mass, ones, lowest vote, highest vote]
    for v, m, o in zip(values, mass, ones):
        levels.append([m, o, v, v])
        while len(levels) > 1 and levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0]:
            m2, o2, _, high = levels.pop()
            levels[-1][0] += m2
            levels[-1][1] += o2
            levels[-1][3] = high
    x, y = [], []
    for m, o, low, high in levels:
        score = (o + prior) / (m + 1)
        x += [low, high]
        y += [score, score]
    if not x:
        return np.array([-1.0, 1.0]), np.array([prior, prior])
    y = np.maximum.accumulate(y)
    # a slight slope keeps the order of votes inside a level
    return np.array(x) + np.arange(len(x)) * 1e-12, np.clip(y * 0.999 + 0.001 * np.clip(x, 0, 1), 0, 1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                    text_col: str = "text", neighbours: int = 16, link_weight: float = 8.0,
                    stem: int = 5, folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score, predicted, evidence (ids of
    the nearest examples) and their cosines.

    Rows whose crc32 of the id as text is divisible by ``folds`` are held out:
    their labels are not read.  Of the others at most MAX_POSITIVE and
    MAX_NEGATIVE, by a hash of the id, are the examples; class weights restore
    the share of each label among all of them.  All terms of the examples count;
    TF-IDF weights are multiplied by 1 + ``link_weight`` * phi, where phi (root of
    chi2 over the number of examples, 0 to 1) is the term's link with the label.
    A text that equals examples (cosine 1) is drawn to their labels.  Label, language, source
    and id are no input of a score.

    Null and empty texts, and texts without a term of the examples, get the rate
    of such texts among the examples, drawn to the prior.  Rows with a null id are scored, never held out and
    never examples.  A label given twice counts with its larger value, a null label
    not at all; without labels every score is 0.5.  Repeated rows get equal
    scores.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col("id").cast("string")) % folds
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id is not null and y is not null").where(crc != 0).groupBy("id").agg(F.max("y").alias("y"))
    known = save(known, "toxic-known")
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(most)
              for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    picked = save(picked[0].unionByName(picked[1]), "toxic-picked")
    rows = rows.withColumn("mark", F.xxhash64("text"))
    examples = save(rows.join(F.broadcast(picked), "id").dropDuplicates(["id"]), "toxic-examples")

    def count_terms(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts, y = part.column(0).to_pylist(), part.column(1).to_numpy()
                for a, b in text_batches(texts, 2_000_000):
                    hashes, owner = letter_terms(texts[a:b], stem)
                    order = np.lexsort((owner, hashes))
                    h, o = hashes[order], owner[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                    terms, inverse = np.unique(h[new], return_inverse=True)
                    ones = np.bincount(inverse, weights=y[a:b][o[new]], minlength=len(terms))
                    both = np.bincount(inverse, minlength=len(terms))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(terms.view(np.int64)), pa.array(ones.astype(np.int64)),
                         pa.array((both - ones).astype(np.int64))], ["term", "n1", "n0"])

    size = {r[0]: r[1] for r in examples.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    weight = (totals.get(0, 0) / max(n0, 1), totals.get(1, 0) / max(n1, 1))
    counts = examples.select("text", "y").mapInArrow(count_terms, "term long, n1 long, n0 long").groupBy("term").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))

    def weigh(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(float) for c in (1, 2))
            below = (a + b) * (n1 + n0 - a - b) * float(n1 or 1) * float(n0 or 1)
            phi = np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.where(below > 0, below, np.inf))
            idf = (np.log((1 + n1 + n0) / (1 + a + b)) + 1) * (1 + link_weight * phi)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idf)], ["term", "idf"])

    # terms and vectors of the examples stay in the shared folder: tasks read them there, the driver holds neither
    words_path, vectors_path = run_path(spark, "toxic-terms"), run_path(spark, "toxic-vectors")
    counts.mapInArrow(weigh, "term long, idf double").write.parquet(words_path)

    def vectors(batches):
        words = keep_one(words_path, lambda: read_vocabulary(words_path))
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                t, w, n = doc_vectors(part.column(3).to_pylist(), words, stem)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(t.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(w.astype(np.float32)))], ["id", "y", "mark", "t", "w"])

    # bounded: MAX_POSITIVE + MAX_NEGATIVE rows, weights in single precision
    examples.select("id", "y", "mark", "text").mapInArrow(
        vectors, "id long, y int, mark long, t array<int>, w array<float>").write.parquet(vectors_path)

    def load():
        words = read_vocabulary(words_path)
        return words, *read_index(vectors_path, words)

    def search(batches):
        words, index, examples_at = keep_one(vectors_path, load)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts = part.column(1).to_pylist()
                for a, b in text_batches(texts, 2_000_000):
                    t, w, n = doc_vectors(texts[a:b], words, stem)
                    ends = np.cumsum(n)
                    known = [examples_at.get(i, (-1, 0)) for i in part.column(0).to_pylist()[a:b]]
                    own = [p if m == mark else -1 for (p, m), mark in zip(known, part.column(2).to_pylist()[a:b])]
                    found = []
                    for c in range(0, len(n), QUERIES):
                        base = index.bases(t[ends[c] - n[c]:ends[min(c + QUERIES, len(n)) - 1]],
                                           w[ends[c] - n[c]:ends[min(c + QUERIES, len(n)) - 1]], n[c:c + QUERIES])
                        # an example is among its own nearest: one more is looked up, to leave it out
                        found += [index.nearest(t[e - m:e], w[e - m:e], neighbours + (x >= 0), base=q) if m else (
                            np.zeros(0, np.int64), np.zeros(0))
                            for e, m, x, q in zip(ends[c:c + QUERIES], n[c:c + QUERIES], own[c:c + QUERIES], base)]
                    yield tally(index, part.column(0).slice(a, b - a), found, np.array(own, dtype=np.int64))

    def tally(index, ids, found, own):
        """A row per query from its nearest examples."""
        counts = np.array([len(i) for i, _ in found], dtype=np.int64)
        who, cosine = (np.concatenate([np.zeros(0, kind), *(x[j] for x in found)]) for j, kind in ((0, np.int64), (1, float)))
        of, y = np.repeat(np.arange(len(found)), counts), index.labels[who]

        def first(keep, n):
            """The first ``n`` of those kept, of each query."""
            upto = np.cumsum(keep)
            before = np.concatenate([[0], upto])[np.cumsum(counts) - counts]
            keep = keep & (upto - before[of] <= n)
            return keep, np.bincount(of[keep], minlength=len(found))

        keep, n = first(np.ones(len(of), dtype=bool), neighbours)
        raw = votes(y[keep], cosine[keep], n, weight)
        same = keep & (cosine >= 1 - 1e-6)
        others, m = first((who != own[of]) & (own[of] >= 0), neighbours)
        shown, k = first(keep, 3)
        ends = pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(raw), pa.array(votes(y[others], cosine[others], m, weight), mask=own < 0),
             pa.array((index.labels[own] if len(index.labels) else own).astype(np.int32), mask=own < 0),
             *(pa.array(np.bincount(of[x], minlength=len(found)).astype(np.int32)) for x in (same, same & (y == 1))),
             pa.ListArray.from_arrays(ends, pa.array(index.ids[who[shown]])), pa.ListArray.from_arrays(ends, pa.array(cosine[shown]))],
            ["id", "raw", "left_out", "y", "same", "ones", "evidence", "cosines"])

    # one search of every row; rows that are examples also get the vote without themselves
    found = save(rows.select("id", "text", "mark").mapInArrow(
        search, "id long, raw double, left_out double, y int, same int, ones int, evidence array<long>, cosines array<double>"), "toxic-votes")
    loo = found.where("y is not null").dropDuplicates(["id"]).orderBy("id").select("left_out", "y").toArrow()
    raw, y = loo["left_out"].to_numpy(), loo["y"].to_numpy()
    curve = calibration(raw[raw >= 0], y[raw >= 0], weight) if (raw >= 0).any() else (
        np.array([-1.0, 1.0]), np.array([0.5, 0.5]))
    mass = np.where(y == 1, weight[1], weight[0])
    prior = float((mass * y).sum() / mass.sum()) if len(y) else 0.5
    blank = float(((mass * y)[raw < 0].sum() + prior) / (mass[raw < 0].sum() + 1))

    def scored(batches):
        let_go()
        for batch in batches:
            raw, same, ones = (batch.column(c).to_numpy() for c in (1, 2, 3))
            # drawn to the labels of the examples that equal the text in their terms
            score = (np.where(raw < 0, blank, np.interp(raw, *curve)) + ones) / (1 + same)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(4), batch.column(5)],
                                             ["id", "score", "evidence", "cosines"])

    out = found.select("id", "raw", "same", "ones", "evidence", "cosines").mapInArrow(
        scored, "id long, score double, evidence array<long>, cosines array<double>")
    return out.select(F.col("id").alias(id_col), F.coalesce(crc == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")
