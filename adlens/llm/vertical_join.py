"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The order: n-grams that few documents hold first (by hash), those that many
hold last (by their count).  Two sets that overlap enough share an n-gram in
their prefixes of that order, so only prefixes are shuffled to find candidate pairs.
A pair is then counted by fragments: the order is cut into ranges, each
candidate's set is cut at the same places, the overlap inside each fragment is
counted on its own, and the partial counts are summed per pair.  Before that,
the sizes of many small fragments bound the overlap (it is at most the sum of the smaller
sizes), which settles most pairs that only share a passage without their sets.

Equal sets are one class, so copies are never paired.  Classes that share a
prefix n-gram are first paired with one of them only (a star per n-gram; its centre is drawn
anew from all classes of the n-gram in each round), which
joins large groups of near copies with a number of pairs in proportion to the
prefixes; after each such round pairs inside a component of the links found
need no count any more.  What is left of the pairs
that share a prefix n-gram is then counted in full, so no link between
components is lost and the components are exact.  There a pair is made only if
its sizes, its places in the order and the parity bits of both sets allow a
link, and once for all crowded n-grams that both list.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import fits, hot_bound, join_hot, save, shingle_sets, sized, text_batches
from adlens.llm.graph import components

#: Entries of the broadcast list of frequent n-grams, and of bits in the
#: filter of candidate documents (both bounds hold whatever the data).
MAX_FREQUENT, MAX_FILTER_BITS = 1 << 17, 1 << 24
_P = 2147483647
_MULT = (48271, 69621)


def _sets(batches, width: int, wanted=None):
    """(ids, sets) of the documents of Arrow batches; ``wanted`` may pass over
    documents by id before their text is read."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            if wanted is not None:
                ids = part.column(0).to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(wanted(part.column(0), ids)))
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in text_batches(texts):
                yield ids[a:b], shingle_sets(texts[a:b], width)


def _class_key(s: np.ndarray, seed: int) -> tuple[int, int]:
    """A 128-bit digest of a set as two signed 64-bit numbers."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return tuple(np.frombuffer(d, dtype="<i8").tolist())


def _profile(s: np.ndarray) -> list[int]:
    """Number of n-grams in each of 2**k equal ranges of the hash, two to four
    in each (eight ranges at least)."""
    k = max(3, (len(s) // 2).bit_length() - 1)
    return np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).tolist()


#: Words of a set's parity bits, and entries of a class's list of crowded n-grams.
_WORDS, _LISTED, _CROWD = 8, 16, 32


def _parity(s: np.ndarray) -> list[int]:
    """Whether the number of n-grams in each of 512 ranges of the hash is odd.
    Each n-gram that only one of two sets holds changes one bit, so they
    differ in at least as many n-grams as their parities in bits."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _differ(a: str, b: str):
    """Number of bits in which two parities differ."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(_WORDS)]
    return sum(bits[1:], bits[0])


def _most_shared(a: str, b: str):
    """Upper bound of the overlap of two sets from their profiles; the longer
    profile is folded to the length of the shorter."""
    fold = ("case when size({x}) > size({y}) then transform({y}, (_, i) -> aggregate(slice({x}, "
            "int(i * (size({x}) div size({y})) + 1), int(size({x}) div size({y}))), 0, (t, v) -> t + v)) else {x} end")
    return F.expr(f"aggregate(zip_with({fold.format(x=a, y=b)}, {fold.format(x=b, y=a)}, (x, y) -> least(x, y)), "
                  "0L, (t, v) -> t + v)")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _class_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Rows (id, n, k1, k2, profile, parity) per document, and rows (token, count) of
    n-grams that a batch of a task holds more than once."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("profile", pa.list_(pa.int32())), ("parity", pa.list_(pa.int64())), ("token", pa.int64()), ("count", pa.int64())])

    def tokens(held):
        t, c = np.unique(np.concatenate(held), return_counts=True)
        t, c = t[c > 1], c[c > 1]
        none = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(len(t), pa.list_(pa.int32())), pa.nulls(len(t), pa.list_(pa.int64())), pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for ids, sets in _sets(batches, width):
            keys = [_class_key(s, seed) if len(s) else (None, None) for s in sets]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([_profile(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                 pa.array([_parity(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                 none, none], schema=schema)
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                yield tokens(held)
                held, size = [], 0
        if held:
            yield tokens(held)

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, profile array<int>, parity array<long>, token long, count long")


def _frequent(counts: DataFrame, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, at most MAX_FREQUENT, sorted by hash, with
    their counts.  The bound on the count is the smallest power of two that
    leaves so few; any choice gives an order, and so the same links."""
    per = save(counts.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= least), "frequent")
    levels = {r[0]: r[1] for r in per.groupBy(F.floor(F.log2("count")).alias("l")).count().collect()}
    bound, held = 64, 0
    for level in sorted(levels, reverse=True):
        if held + levels[level] > MAX_FREQUENT:
            break
        held, bound = held + levels[level], level
    got = per.where(F.col("count") >= 2 ** bound).toArrow() if held else None
    if got is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t, c = got["token"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


def _count_of(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each n-gram in the list of frequent ones, else 0."""
    if not len(tokens) or not len(s):
        return np.zeros(len(s), dtype=np.int64)
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    return np.where(tokens[at] == s, counts[at], 0)


def _prefixes(docs: DataFrame, width: int, seed: int, frequent, num: int, den: int,
              hot: int = 2048, salts: int = 64) -> DataFrame:
    """Prefix entries (token, salt, cls, n, pos).  Entries of the most frequent
    n-grams are dealt over the sub-keys 1..``salts`` by class; others have 0."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()),
                        ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        tokens, counts = frequent.value
        for _, sets in _sets(batches, width):
            rows, seen = [], set()
            for s in sets:
                n = len(s)
                key = _class_key(s, seed)[0] if n else None
                if not n or key in seen:
                    continue
                seen.add(key)
                c = _count_of(s, tokens, counts)
                p = n - (num * n + den - 1) // den + 1
                if c.any():
                    order = np.argsort(c, kind="stable")[:p]
                    t, c = s[order], c[order]
                else:
                    t, c = s[:p], c[:p]
                salt = np.where(c >= hot, 1 + key % salts, 0)
                rows.append((t, salt, key, n))
            if rows:
                sizes = [len(r[0]) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)),
                    pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)),
                    pa.array(np.repeat([r[2] for r in rows], sizes).astype(np.int64)),
                    pa.array(np.repeat([r[3] for r in rows], sizes).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k) for k in sizes]).astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "token long, salt int, cls long, n int, pos int")


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit filter of the ids: built by aggregation, at most MAX_FILTER_BITS."""
    n = ids.count()
    bits = min(MAX_FILTER_BITS, 1 << max(10, (8 * n).bit_length()))
    spots = F.explode(F.array(*[F.pmod(F.pmod(F.col("id"), F.lit(_P)) * m, F.lit(_P)) % bits for m in _MULT]))
    words = ids.where("id is not null").select(spots.alias("p")).groupBy((F.col("p") / 32).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 32, dtype=np.int64)
    out[words["w"].to_numpy()] = words["x"].to_numpy()
    return out, bits


def _segments(docs: DataFrame, width: int, seed: int, frequent, id_filter, fragments: int) -> DataFrame:
    """(id, cls, frag, tokens) of the documents that pass the filter: fragments
    0.. are equal ranges of the hash, the last holds the frequent n-grams."""
    schema = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("frag", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        (tokens, counts), (words, bits) = frequent.value, id_filter.value

        def wanted(col, _):
            null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            ids = col.fill_null(0).to_numpy()
            keep = np.ones(len(ids), dtype=bool)
            for m in _MULT:
                p = (ids % _P) * m % _P % bits
                keep &= (words[p // 32] >> (p % 32)) & 1 == 1
            return keep | null

        for ids, sets in _sets(batches, width, wanted):
            doc, cls, frag, parts = [], [], [], []
            for i, s in zip(ids, sets):
                if not len(s):
                    continue
                key = _class_key(s, seed)[0]
                often = _count_of(s, tokens, counts) > 0
                rare = s[~often]
                cuts = np.searchsorted(rare, np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments))
                for f, part in enumerate([*np.split(rare, cuts), s[often]]):
                    if len(part):
                        doc.append(i)
                        cls.append(key)
                        frag.append(f)
                        parts.append(part)
            if cls:
                flat = np.concatenate(parts).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64()), pa.array(cls, pa.int64()), pa.array(frag, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return docs.mapInArrow(run, "id long, cls long, frag int, tokens array<long>")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               num: int = 80, den: int = 100, fragments: int = 4, rounds: int = 3, few: int = 16) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id that
    links reach).  Two documents link when den * |A and B| >= num * |A or B|
    of their sets of distinct ``width``-word shingles.  Stars go on for at most ``rounds``
    rounds, or until the n-grams still shared across what is joined have ``few`` classes
    each (in the mean over their entries); then all their pairs are counted.

    Null and empty texts have no shingle and link with nothing.  Null ids
    take part; a component of null ids only has a null id.  Repeated rows are
    copies of each other.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    docs = _documents(df, id_col, text_col)
    for seed in range(8):
        both = save(_class_rows(docs, width, seed), "join-classes")
        rows = both.where("n is not null")
        sets = rows.select("id", "n", "k1", "k2")
        classes = save(rows.where("n > 0").groupBy("k1", "k2").agg(
            F.min("id").alias("rep"), F.first("profile").alias("profile"),
            F.first("parity").alias("parity"), F.count(F.lit(1)).alias("copies")), "join-reps")
        # the first 64 bits stand for the class from here on, if they are unique
        if classes.groupBy("k1").count().where("count > 1").isEmpty():
            break
    frequent = spark.sparkContext.broadcast(_frequent(both.where("token is not null").select("token", "count")))
    postings = _prefixes(docs, width, seed, frequent, num, den)
    run = Window.partitionBy("token", "salt")
    postings = postings.withColumn("anchor", F.first(F.struct("cls", "n")).over(run.orderBy("cls"))).withColumn(
        "last", F.max("cls").over(run.orderBy("cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # an n-gram that one class alone holds pairs nothing; a salted one may still meet other salts
    postings = postings.where("anchor.cls <> last or salt <> 0").drop("last").distinct()
    postings = save(postings, "join-postings")

    close = (den * F.least("n", "other_n") >= num * F.greatest("n", "other_n"))
    ordered = [F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")]
    sizes = [F.when(F.col("cls") < F.col("other"), F.col("n")).otherwise(F.col("other_n")).alias("na"),
             F.when(F.col("cls") < F.col("other"), F.col("other_n")).otherwise(F.col("n")).alias("nb")]

    def as_pairs(rows: DataFrame) -> DataFrame:
        return rows.where("cls <> other").where(close).select(*ordered, *sizes).distinct()

    def count_links(pairs: DataFrame, n_pairs: int) -> DataFrame:
        # profiles are long: they are shuffled, those of few pairs' classes only
        of = classes.select("k1", "rep", "profile")
        if fits(2 * n_pairs, 1):
            of = of.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()), "k1", "left_semi")
        pairs = pairs.join(of.toDF("a", "rep_a", "profile_a").hint("merge"), "a").join(
            of.toDF("b", "rep_b", "profile_b").hint("merge"), "b")
        pairs = save(pairs.where((num + den) * _most_shared("profile_a", "profile_b") >= num * (F.col("na") + F.col("nb")))
                     .drop("profile_a", "profile_b"), "join-bounded")
        ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        id_filter = spark.sparkContext.broadcast(_filter_of(ids))
        parts = save(_segments(docs, width, seed, frequent, id_filter, fragments), "join-segments")
        by_part = sized(pairs.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(fragments)))),
                        (fragments + 1) * pairs.count(), 7)
        left = parts.select(F.col("cls").alias("a"), F.col("id").alias("rep_a"), "frag", F.col("tokens").alias("ta"))
        right = parts.select(F.col("cls").alias("b"), F.col("id").alias("rep_b"), "frag", F.col("tokens").alias("tb"))
        meet = by_part.join(left, (by_part["a"] == left["a"]) & (by_part["frag"] == left["frag"])
                            & by_part["rep_a"].eqNullSafe(left["rep_a"])).select(by_part["*"], "ta")
        meet = meet.join(right.hint("merge"), (meet["b"] == right["b"]) & (meet["frag"] == right["frag"])
                         & meet["rep_b"].eqNullSafe(right["rep_b"])).select(meet["*"], "tb")
        # a repeated row gives its fragments again: a set, of at most one count per fragment
        partial = meet.select("a", "b", "na", "nb", F.struct(
            "frag", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("shared")).alias("part"))
        total = partial.groupBy("a", "b", "na", "nb").agg(F.collect_set("part").alias("parts")).withColumn(
            "shared", F.aggregate("parts", F.lit(0).cast("bigint"), lambda t, x: t + x["shared"]))
        union = F.col("na") + F.col("nb") - F.col("shared")
        return total.where(den * F.col("shared") >= num * union).select("a", "b")

    pairs = save(as_pairs(postings.select("cls", "n", F.col("anchor.cls").alias("other"),
                                          F.col("anchor.n").alias("other_n"))), "join-pairs")
    n_tried = pairs.count()
    links = save(count_links(pairs, n_tried), "join-links")
    tried, label = pairs, components(links)
    # Of a pair, the set whose prefix ends first in the order has every shared
    # prefix n-gram inside both prefixes; those that no other prefix holds are not
    # shared, so the overlap is at most its ``reach``, or the larger of both.
    held = postings.groupBy("cls").agg(F.count(F.lit(1)).alias("held"))
    prefix = F.col("n") - F.floor((num * F.col("n") + den - 1) / den) + 1
    live = save(postings.drop("anchor").join(held, "cls").withColumn(
        "reach", F.col("n") - prefix + F.col("held")).drop("held"), "join-reach")
    for step in range(rounds):
        named = live.drop("comp", "x").join(label.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
            "comp", F.coalesce("root", "cls")).drop("root")
        # a star's centre is drawn from all classes of the n-gram, anew in each round
        centre = F.struct(F.xxhash64(F.lit(step), "token", "cls").alias("draw"), "cls", "n", "comp", "reach")
        mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(centre).alias("x")).where("lo <> hi")
        live = save(named.join(mixed.select("token", "x"), "token"), "join-live")
        if live.isEmpty():
            break
        load = live.groupBy("token").count().agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
        last = step == rounds - 1 or load[0] <= few * load[1]
        if not last:  # another star per n-gram
            found = live.where("comp <> x.comp")
            found = found.where((num + den) * F.greatest("reach", "x.reach") >= num * (F.col("n") + F.col("x.n"))).select(
                "cls", "n", F.col("x.cls").alias("other"), F.col("x.n").alias("other_n"))
        else:  # all pairs that are left
            crowded = live.join(live.groupBy("token").count().where(F.col("count") >= _CROWD).select("token"), "token", "left_semi")
            listed = crowded.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("token")), 1, _LISTED).alias("listed"))
            live = save(sized(live.drop("x"), load[1], 7).join(classes.select(F.col("k1").alias("cls"), "parity"), "cls").join(
                sized(listed, load[1], _LISTED + 3), "cls", "left"), "join-signed")
            right = live.select("token", F.col("parity").alias("other_parity"), F.col("listed").alias("other_listed"), F.col("cls").alias("other"), F.col("n").alias("other_n"),
                                F.col("comp").alias("other_comp"), F.col("pos").alias("other_pos"),
                                F.col("reach").alias("other_reach"))
            most = F.least(F.least("pos", "other_pos") + 1 + F.least(
                F.col("n") - F.col("pos") - 1, F.col("other_n") - F.col("other_pos") - 1), F.greatest("reach", "other_reach"))
            enough = (num + den) * most >= num * (F.col("n") + F.col("other_n"))
            alike = (num + den) * _differ("parity", "other_parity") <= (den - num) * (F.col("n") + F.col("other_n"))
            # a pair that meets at several listed n-grams is made at the first
            first = F.coalesce(F.array_min(F.array_intersect("listed", "other_listed")) >= F.col("token"), F.lit(True))
            found = live.join(sized(right, load[1], _WORDS + _LISTED + 12), "token").where((F.col("cls") < F.col("other")) & (
                F.col("comp") != F.col("other_comp")) & close & enough & alike & first)
        new = save(as_pairs(found).join(sized(tried.select("a", "b"), n_tried, 2), ["a", "b"], "left_anti"), "join-pairs")
        n_new = new.count()
        if n_new:  # else the components are those of the round before
            links = links.unionByName(save(count_links(new, n_new), "join-links"))
            tried, n_tried = tried.unionByName(new), n_tried + n_new
            label = components(links)
        if last:
            break

    # only classes with a link need their component's smallest id
    linked = save(label.join(classes.select(F.col("k1").alias("node"), "rep"), "node"), "join-linked")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    n_linked, n_classes = linked.count(), classes.count()

    def hot_roots() -> list[int]:
        return [r[0] for r in linked.groupBy("root").count().where(F.col("count") > hot_bound(n_linked)).collect()]

    def hot_classes() -> list[int]:
        n = classes.agg(F.sum("copies")).first()[0]
        return [r[0] for r in classes.where(F.col("copies") > hot_bound(n)).select("k1").collect()]

    moved = join_hot(linked.select("node", "root"), smallest, n_linked, "root", ["node"], hot_roots, "inner").select(
        F.col("node").alias("k1"), "component_id", F.lit(True).alias("linked"))
    of_class = classes.select("k1", "rep").join(sized(moved, n_linked, 3), "k1", "left").select(
        "k1", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    own = join_hot(sets.where("n > 0"), of_class, n_classes, "k1", ["id"], hot_classes).select("id", "n", "component_id")
    none = sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return own.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
