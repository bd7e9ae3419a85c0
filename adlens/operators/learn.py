"""Learn (click-through): S2, A21-A24, A30, M2-M5, W6.

* Vocabulary (A21/W6): top-K values per categorical column by frequency,
  exact, via a salted two-level top-K (no column's values sorted in one task).
* Transform (M2/J6): numerics -> log1p(|x|) with 0 for null; categoricals ->
  code by broadcast join against the vocabulary (at most K rows per column, a
  proven size bound), unseen -> 0.
* Split (M3): stratified 70/15/15 by a portable hash, exact per-label counts; a
  histogram of the hash finds the cuts and only rows near one are ranked.
* Model (M4): Spark ML GBTClassifier with a validation column (early
  stopping), or logistic regression on hashed features for very wide logs.
* Evaluation (M5): AUC and average precision from scores grouped to distinct
  values plus distributed running sums; log loss; calibration (A23).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from adlens.session import ensure_checkpoint_dir
from adlens.functions.ranking import (global_running_sums, lowest_draws, part_by_rank, portable_hash,
                                      row_draw, top_k_per_group)
from adlens.functions.ratios import round_half_up

MISSING = "__MISSING__"
MAX_CARDINALITY = 10_000
LOGLOSS_EPS = 2.220446049250313e-16   # float64 machine epsilon, the clip of the reference metric

# Criteo-style click log layout (S2): label, 13 numeric, 26 hashed categoricals.
CRITEO_NUM = [f"I{i}" for i in range(1, 14)]
CRITEO_CAT = [f"C{i}" for i in range(1, 27)]
CRITEO_SCHEMA = TT.StructType(
    [TT.StructField("label", TT.IntegerType())]
    + [TT.StructField(c, TT.DoubleType()) for c in CRITEO_NUM]
    + [TT.StructField(c, TT.StringType()) for c in CRITEO_CAT])


def read_click_log(spark: SparkSession, path: str, sample_size: int | None = None, seed: int = 42,
                   partitions: int | None = None, schema: TT.StructType = CRITEO_SCHEMA) -> DataFrame:
    """Headerless TSV (gz allowed), explicit 40-field schema, '' -> NULL.

    With ``sample_size``: an exact, seeded sample of n rows (all rows when
    the file has fewer), those with the lowest draws, a hash of the seed and
    the row.  A histogram of the draws finds the threshold, so nothing but the rows
    at the threshold is sorted; equal rows are interchangeable.  The original's
    read cap of 3n rows was a single-machine memory guard and is
    not needed.  A .gz file is one split: pass ``partitions`` to spread it.
    """
    df = (spark.read.schema(schema).option("sep", "\t").option("nullValue", "")
          .option("header", False).csv(path))
    if partitions:
        df = df.repartition(partitions)
    if sample_size is not None:
        df = lowest_draws(df, sample_size, row_draw(seed, *df.columns))
    return df


# ── A21 / W6 vocabulary ──────────────────────────────────────────────

def fit_vocabulary(df: DataFrame, cat_cols: list[str], max_cardinality: int = MAX_CARDINALITY,
                   buckets: int = 64) -> DataFrame:
    """(column, value, code): code 1..K by descending frequency, ties by value."""
    vals = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cat_cols])
    long = vals.unpivot([], cat_cols, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(counts, "column", [F.col("n").desc(), F.col("value")], max_cardinality,
                          ["value"], buckets, name="code")
    # at most max_cardinality rows per column, read once per column by the
    # transform: computed once, and kept in the shared checkpoint folder
    ensure_checkpoint_dir(df.sparkSession)
    return top.select("column", "value", F.col("code").cast("int").alias("code"), "n").checkpoint(eager=True)


def transform(df: DataFrame, vocab: DataFrame, num_cols: list[str], cat_cols: list[str],
              keep: list[str] | None = None) -> DataFrame:
    """M2 transform: log1p(|x|) numerics and vocabulary codes (0 = unseen)."""
    keep = list(keep or [])
    out = df.select(*keep, *num_cols, *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)
                                        for c in cat_cols])
    for c in cat_cols:
        v = F.broadcast(vocab.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("code").alias(f"_code_{c}")))
        out = out.join(v, c, "left")
    return out.select(
        *keep,
        *[F.log1p(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c in num_cols],
        *[F.coalesce(F.col(f"_code_{c}"), F.lit(0)).alias(c) for c in cat_cols])


# ── M3 split ─────────────────────────────────────────────────────────

def stratified_split(df: DataFrame, label: str, key_cols: list[str], seed: int = 42,
                     test_frac: float = 0.15, val_frac: float = 0.176) -> DataFrame:
    """Adds ``split`` in {train, val, test}: per label, the first ceil(.15 n)
    rows by hash go to test, the next ceil(.176 * rest) to val, the rest to
    train (the reference's 70/15/15 two-step split).

    Rows of a label are ordered by (hash of keys, keys, all other columns by
    name), so rows that share a key still get a fixed order; only rows equal
    in every column can trade places, and those are interchangeable.  Ranks are
    taken near the cuts alone (``part_by_rank``): the table is neither sorted nor stored."""
    def cuts(n):
        n_test = F.ceil(n * test_frac)
        return [n_test, n_test + F.ceil((n - n_test) * val_frac)]

    parts = part_by_rank(df, label, portable_hash(*key_cols, seed=seed), key_cols, cuts, "_part")
    return parts.select(*df.columns, F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train")),
                                                  F.col("_part") + 1).alias("split"))


# ── M4 model ─────────────────────────────────────────────────────────

def train_gbt(train_val: DataFrame, feature_cols: list[str], label: str = "label",
              max_iter: int = 100, max_depth: int = 5, step: float = 0.1, seed: int = 42):
    """M4: GBT with early stopping on the rows where split = 'val'."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    data = train_val.withColumn("_is_val", F.col("split") == "val")
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed, validationIndicatorCol="_is_val", maxBins=64)
    return Pipeline(stages=[asm, gbt]).fit(data)


def train_hashed_logistic(train: DataFrame, feature_cols: list[str], label: str = "label",
                          num_features: int = 1 << 18, reg: float = 1e-4, categorical=()):
    """M4 wide path: features hashed into a sparse vector and a logistic regression on it (no
    vocabulary, so any number of distinct values).  Numbers are hashed by column, text and the
    columns in ``categorical`` by (column, value); a null adds nothing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher
    fh = FeatureHasher(inputCols=feature_cols, outputCol="features", numFeatures=num_features,
                       **({"categoricalCols": list(categorical)} if categorical else {}))
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=50)
    return Pipeline(stages=[fh, lr]).fit(train)


def log_numbers(df: DataFrame, num_cols: list[str]) -> DataFrame:
    """Numeric columns as log1p(|x|), null as 0 (M2), in place; others untouched."""
    return df.withColumns({c: F.log1p(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) for c in num_cols})


def score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """Positive-class probability as a DOUBLE column ``score``."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(df)
    return p.select(*keep, vector_to_array("probability")[1].alias("score"))


def feature_importance(model, feature_cols: list[str], top: int = 15) -> DataFrame:
    """Top features of the fitted trees (a table the size of the feature list)."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(feature_cols, imp), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(f, round(float(v), 6)) for f, v in rows], "feature string, importance double")


# ── M5 evaluation ────────────────────────────────────────────────────

def binary_metrics(scored: DataFrame, label: str = "label", score_col: str = "score") -> DataFrame:
    """AUC-ROC, average precision, log loss, base rate and size (one row).

    Scores are grouped to distinct values first; AUC counts half of every tie.
    """
    y = F.col(label).cast("bigint")
    g = scored.groupBy(F.col(score_col).alias("s")).agg(
        F.sum(y).alias("pos"), (F.count(F.lit(1)) - F.sum(y)).alias("neg"))
    c = global_running_sums(g, [F.col("s").desc()], ["pos", "neg"])
    p_tot = g.select(F.sum("pos")).scalar()
    n_tot = g.select(F.sum("neg")).scalar()
    agg = c.agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("_auc"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))))
         .alias("_ap"))
    p = F.least(F.greatest(F.col(score_col), F.lit(LOGLOSS_EPS)), F.lit(1 - LOGLOSS_EPS))
    ll = scored.select(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).scalar()
    # one class only: AUC (and AP without positives) are undefined -> NULL
    return agg.select(
        round_half_up(F.try_divide(F.col("_auc"), (p_tot * n_tot).cast("double")), 4).alias("auc_roc"),
        round_half_up(F.try_divide(F.col("_ap"), p_tot.cast("double")), 4).alias("pr_auc"),
        round_half_up(ll, 4).alias("log_loss"),
        round_half_up(F.try_divide(p_tot.cast("double"), (p_tot + n_tot).cast("double")), 4).alias("base_rate"),
        (p_tot + n_tot).alias("test_size"))


def calibration(scored: DataFrame, label: str = "label", score_col: str = "score",
                n_bins: int = 10) -> DataFrame:
    """Uniform bins (empty bins absent) and the expected calibration error.

    ECE pairs each bin's count with its own means (D8: joined by bin number).
    """
    b = F.least(F.floor(F.col(score_col) * n_bins), F.lit(n_bins - 1)).cast("int")
    t = scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(score_col)).alias("_mp"),
        F.avg(F.col(label).cast("double")).alias("_fp"))
    total = scored.select(F.count(F.lit(1))).scalar()
    ece = t.select(F.sum(F.col("n") / total * F.abs(F.col("_fp") - F.col("_mp")))).scalar()
    return t.select("bin", "n", round_half_up("_mp", 4).alias("mean_predicted"),
                    round_half_up("_fp", 4).alias("fraction_positive"),
                    round_half_up(ece, 4).alias("ece"))


def evaluation_report(scored: DataFrame, importance: DataFrame, label: str = "label", score_col: str = "score") -> DataFrame:
    """M5: the whole evaluation of one model as rows (section, item, value): the metrics (A22) with the
    calibration error, the calibration bins (A23), and the features' importance (A24).  ``scored`` is read
    several times: pass a stored frame."""
    metrics, bins = binary_metrics(scored, label, score_col), calibration(scored, label, score_col)
    names = ["auc_roc", "pr_auc", "log_loss", "base_rate", "test_size"]

    def rows(df, section, item, values):
        pairs = F.array(*[F.struct(F.concat(item, F.lit(n)).alias("item"), F.col(c).cast("double").alias("value")) for n, c in values])
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("x")).select("section", "x.item", "x.value")

    out = rows(metrics, "metrics", F.lit(""), [(n, n) for n in names])
    out = out.unionByName(rows(bins.agg(F.max("ece").alias("ece")), "metrics", F.lit(""), [("calibration_error", "ece")]))
    out = out.unionByName(rows(bins, "calibration", F.concat(F.lit("bin "), F.col("bin").cast("string"), F.lit(" ")), [
        ("n", "n"), ("mean predicted", "mean_predicted"), ("fraction positive", "fraction_positive")]))
    return out.unionByName(rows(importance, "importance", F.col("feature"), [("", "importance")]))
