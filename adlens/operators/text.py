"""Competitor ad copy: M6-M9, A10, A11, A25, A26, J11, T3, W10.

TF-IDF takes three passes over the texts.  The vocabulary is the top 500 terms by corpus
frequency: one pass counts document and corpus frequency of all words, one of the
pairs whose words are both frequent enough for a pair to be among the top (a
pair is never more frequent than its words, so no other can be); the
last counts, weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) and norms inside each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.text import with_terms, with_words
from adlens.operators import cluster as C
from adlens.operators import terms as TM
from adlens.session import ensure_checkpoint_dir

MAX_FEATURES = 500
MAX_DF = 0.85
N_CLUSTERS = 5
N_TOP_TERMS = 10
#: Words whose pairs are counted by code; of more words, all pairs are counted as text.
MAX_CODED = 1 << 16

# Strategy buckets and their keywords for cluster labelling.
LABEL_KEYWORDS = {
    "Price & Deals": ["save", "sale", "deal", "discount", "price", "off", "clearance",
                      "lowest", "cheap", "value", "flash", "coupon", "free shipping"],
    "Features & Specs": ["hz", "ghz", "ram", "ssd", "display", "resolution", "processor",
                         "battery", "sensor", "usb", "calibrated", "dpi", "refresh"],
    "Lifestyle & Brand": ["experience", "feel", "designed", "crafted", "world", "silence",
                          "immersive", "premium", "comfort", "create", "life", "moments"],
    "Urgency & Scarcity": ["limited", "only", "last", "hurry", "gone", "stock", "ending",
                           "remaining", "sold out", "reserve", "pre-order", "few left"],
    "Comparison & Authority": ["rated", "best", "winner", "award", "review", "beats", "vs",
                               "outperforms", "benchmark", "editor", "top pick", "proven"],
}
OTHER_LABEL = "Other"


def term_statistics(docs: DataFrame, id_col: str = "ad_id", text_col: str = "ad_copy") -> DataFrame:
    """(term, df, corpus_tf) in one pass over the texts: each document gives
    its terms and its distinct terms, counted together per term.  Counts are
    combined before the shuffle, which is by term only."""
    d = with_terms(docs.select(F.col(text_col).alias("_text")), "_text").select("terms")
    both = F.array(F.struct(F.lit(False).alias("once"), F.col("terms").alias("t")),
                   F.struct(F.lit(True).alias("once"), F.array_distinct("terms").alias("t")))
    t = d.select(F.explode(both).alias("x")).select("x.once", F.explode("x.t").alias("term"))
    return t.groupBy("term").agg(F.count_if("once").alias("df"), F.count_if(~F.col("once")).alias("corpus_tf"))


def _bytes(term: str) -> bytes:
    """Terms are ordered as Spark orders them."""
    return term.encode("utf-8", "surrogatepass")


def _top_terms(docs: DataFrame, id_col: str, text_col: str, n: int, least: int, most: float, coded: int = MAX_CODED) -> list:
    """The n terms of the highest corpus frequency (ties by term) among those in ``least`` to
    ``most`` documents, exactly."""
    ensure_checkpoint_dir(docs.sparkSession)

    def top(stats):
        kept = stats.where((F.col("df") >= least) & (F.col("df") <= most))
        return kept.orderBy(F.col("corpus_tf").desc(), F.col("term")).limit(n).collect()

    words = with_words(docs.select(F.col(text_col).alias("_text")), "_text")
    stats = TM.word_statistics(words).checkpoint(eager=True)     # read twice: one row per word
    best = top(stats)
    # n words are kept: a pair that ranks before one of them occurs as often, and so do its words
    floor = best[-1]["corpus_tf"] if 0 < n == len(best) else 0
    known = [r["term"] for r in stats.where(F.col("corpus_tf") >= floor).select("term").limit(coded + 1).collect()]
    if len(known) > coded:
        return top(term_statistics(docs, id_col, text_col))
    best += top(TM.pair_statistics(words, known)) if known else []
    return sorted(best, key=lambda r: (-r["corpus_tf"], _bytes(r["term"])))[:n]


def tfidf(docs: DataFrame, id_col: str = "ad_id", text_col: str = "ad_copy",
          max_features: int = MAX_FEATURES, max_df: float = MAX_DF) -> dict:
    """M6: ``sparse`` (doc_id, idx, val: the places in the vocabulary of a document's terms and
    their weights), ``weights`` (doc_id, term, term_index, weight) and ``vocabulary`` (term,
    term_index, df, corpus_tf).

    min_df is 2 when there are more than 10 documents, else 1; terms in more
    than 85 % of documents are dropped.  The vocabulary (at most
    ``max_features`` rows) comes to the driver; terms are then counted,
    weighted and normed inside each row, with no exchange, and only those that occur.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    least = 2 if n_docs > 10 else 1
    top = _top_terms(docs, id_col, text_col, max_features, least, n_docs * max_df)
    rows = [(r["term"], i, r["df"], r["corpus_tf"])
            for i, r in enumerate(sorted(top, key=lambda r: _bytes(r["term"])))]
    vocab = spark.createDataFrame(rows, "term string, term_index int, df bigint, corpus_tf bigint")
    d = with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    if rows:
        d = TM.term_counts(d, [r[0] for r in rows])
        idf = F.array(*[F.ln(F.lit(1.0 + n_docs) / F.lit(1.0 + r[2])) + 1.0 for r in rows])
        raw = F.zip_with("idx", "n", lambda i, n: (1.0 + F.ln(n)) * F.element_at(idf, i + 1))
        d = d.select("doc_id", "idx", raw.alias("raw"))
        norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
        d = d.select("doc_id", "idx", "raw", norm.alias("norm"))
        sparse = d.select("doc_id", "idx", F.transform("raw", lambda x: x / F.col("norm")).alias("val"))
    else:
        sparse = d.select("doc_id", F.array().cast("array<int>").alias("idx"), F.array().cast("array<double>").alias("val"))
    return {"sparse": sparse, "weights": term_weights(sparse, [r[0] for r in rows]), "vocabulary": vocab, "n_docs": n_docs,
            "dim": len(rows), "terms": [r[0] for r in rows]}


def term_weights(sparse: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, term_index, weight) of the terms each document has; ``terms`` is the
    vocabulary in order, a literal array."""
    # outer: no filter on the size is derived, which would repeat the whole text work below it
    w = sparse.select("doc_id", F.explode_outer(F.arrays_zip("idx", "val")).alias("x"))
    w = w.select("doc_id", F.col("x.idx").alias("term_index"), F.col("x.val").alias("weight")).where("weight > 0")
    named = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return w.select("doc_id", F.get(named, F.col("term_index")).alias("term"), "term_index", "weight")


# ── A25 / A26 / T3 ───────────────────────────────────────────────────

def mean_tfidf_per_group(weights: DataFrame, assignment: DataFrame, group: str = "cluster") -> DataFrame:
    """Mean weight of every term over *all* documents of the group."""
    size = assignment.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"))
    s = weights.join(assignment.select("doc_id", group), "doc_id").groupBy(group, "term").agg(
        F.sum("weight").alias("_s"))
    return s.join(size, group).select(group, "term", (F.col("_s") / F.col("n_docs")).alias("mean_weight"))


def group_sizes(assignment: DataFrame, group: str = "cluster") -> DataFrame:
    """Documents per group."""
    return assignment.groupBy(group).agg(F.count(F.lit(1)).alias("n_ads"))


def top_terms(mean_weights: DataFrame, group: str = "cluster", n: int = N_TOP_TERMS) -> DataFrame:
    """The n highest mean-weight terms per group, as an ordered array."""
    # rank on 12 places so float noise in the sums cannot reorder near-ties
    w = Window.partitionBy(group).orderBy(F.round("mean_weight", 12).desc(), F.col("term"))
    r = mean_weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return r.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))),
                                            lambda x: x["term"]).alias("top_terms"))


# ── J11 / M9 labelling ───────────────────────────────────────────────

def label_scores(tops: DataFrame, group: str = "cluster") -> DataFrame:
    """Per group and label, how many of the label's keywords match some top
    term (keyword in term or term in keyword); each keyword counts once."""
    kw = F.array(*[F.struct(F.lit(lbl).alias("label"), F.lit(k).alias("keyword"))
                   for lbl, ks in LABEL_KEYWORDS.items() for k in ks])
    t = tops.select(group, F.explode("top_terms").alias("term"))
    x = t.select(group, "term", F.explode(kw).alias("_k"))
    hit = x.where(F.contains(F.col("term"), F.col("_k.keyword")) | F.contains(F.col("_k.keyword"), F.col("term")))
    return hit.groupBy(group, F.col("_k.label").alias("label")).agg(
        F.count_distinct(F.col("_k.keyword")).alias("score"))


def assign_labels(scores: DataFrame, groups: DataFrame, group: str = "cluster") -> DataFrame:
    """M9: one label per row of ``groups``, taken in the order of the group.

    A group prefers its labels by score, ties in the listed order, and takes the first
    that no earlier group took; without one it is 'Other'.  A label that is taken
    again gets ' (2)'.  The choices depend on each other, so they are one fold: the
    groups, a handful, with their preferences (at most five each) as an ordered
    array, and the labels taken so far as the state."""
    kind = groups.schema[group].dataType.simpleString()
    place = F.create_map(*[F.lit(x) for lbl, i in zip(LABEL_KEYWORDS, range(len(LABEL_KEYWORDS))) for x in (lbl, i)])
    liked = scores.where("score > 0").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), place[F.col("label")].alias("i"), "label"))), lambda x: x["label"]).alias("liked"))
    row = F.struct(group, F.coalesce("liked", F.array().cast("array<string>")).alias("liked"))
    every = groups.select(group).distinct().join(liked, group, "left").agg(F.array_sort(F.collect_list(row)).alias("every"))

    def take(state, g):
        free = F.filter(g["liked"], lambda x: ~F.array_contains(state["taken"], x))
        first = F.coalesce(F.get(free, F.lit(0)), F.lit(OTHER_LABEL))
        label = F.when(F.array_contains(state["taken"], first), F.concat(first, F.lit(" (2)"))).otherwise(first)
        return F.struct(F.array_append(state["taken"], label).alias("taken"), F.array_append(
            state["made"], F.struct(g[group].alias(group), label.alias("label"))).alias("made"))

    start = F.struct(F.array().cast("array<string>").alias("taken"),
                     F.array().cast(f"array<struct<{group}:{kind},label:string>>").alias("made"))
    return every.select(F.explode(F.aggregate("every", start, take, lambda x: x["made"])).alias("x")).select("x.*")


# ── A10 / A11 ────────────────────────────────────────────────────────

def crosstab(df: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    """A10: zero-filled counts of ``row`` x ``col`` (pass ``values`` to skip the
    job that finds the pivot values)."""
    g = df.groupBy(row)
    piv = g.pivot(col, values) if values is not None else g.pivot(col)
    return piv.count().fillna(0)


def dominant(df: DataFrame, row: str, col: str) -> DataFrame:
    """Most frequent ``col`` per ``row``; ties go to the first alphabetically."""
    c = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(row).orderBy(F.col("n").desc(), F.col(col))
    return (c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(row, F.col(col).alias(f"dominant_{col}"), "n"))


def analyze_ads(ads: DataFrame, k: int = N_CLUSTERS, restarts: int = 10, seed: int = 42) -> dict:
    """The whole ad-copy pipeline: TF-IDF -> KMeans -> PCA -> labels -> cross-tab."""
    ensure_checkpoint_dir(ads.sparkSession)
    tf = tfidf(ads)
    # the rows feed KMeans, PCA and the per-cluster terms: compute them once
    # and keep them in the shared checkpoint folder (cuts the text lineage)
    sparse = tf["sparse"].checkpoint(eager=True)
    weights = term_weights(sparse, tf["terms"])
    assignment, _centres = C.kmeans(sparse, tf["dim"], k, restarts, seed)
    assignment = assignment.checkpoint(eager=True)
    mean, axes, explained = C.principal_axes(sparse, tf["dim"])
    coords = C.project(sparse, mean, axes)
    explained = [*explained.tolist(), 0.0, 0.0][:2]
    mw = mean_tfidf_per_group(weights, assignment)
    tops = top_terms(mw)
    labels = assign_labels(label_scores(tops), assignment.select("cluster").distinct())
    clusters = group_sizes(assignment).join(tops, "cluster", "left").join(labels, "cluster")
    ads_out = (ads.join(assignment.withColumnRenamed("doc_id", "ad_id"), "ad_id")
               .join(coords.withColumnRenamed("doc_id", "ad_id"), "ad_id")
               .join(labels.withColumnRenamed("label", "cluster_label"), "cluster"))
    return {"ads": ads_out, "clusters": clusters, "explained_variance": explained,
            "strategy_matrix": crosstab(ads_out, "advertiser_name", "cluster_label"),
            "vocabulary": tf["vocabulary"]}
