"""Language identification in two steps: the family, then the language in it.

Texts are relative frequencies of byte windows (one to four bytes of the lowered
letters, blanks between words included), hashed into a fixed number of features.  One linear
support vector machine stands between every two families, and one between every two
languages of a family; each is trained by dual coordinate descent in a task of its
own on a bounded sample, and its margins are made probabilities by a logistic curve
fitted on margins of left-out folds.  Most wins decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import save, text_batches

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "semitic": "ar he mt am",
    "indo-iranian": "fa ur hi bn pa gu mr ne si ps ku tg",
    "turkic": "tr az kk ky uz tk tt ug",
    "dravidian": "ta te kn ml",
    "sino-tibetan": "zh my bo",
    "austronesian": "id ms tl jv su mg mi",
}
#: Features of each window length, and the lengths.
FEATURES, LENGTHS = 1 << 13, (1, 2, 3, 4)
DIM = FEATURES * len(LENGTHS)

_LETTER = np.ones(256, dtype=bool)
_LETTER[:128] = False
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    """The family of a language code (its part before ``-`` or ``_``); ``other`` if unlisted."""
    code = lang.replace("_", "-").split("-")[0].lower()
    return next((f for f, codes in families.items() if code in codes.split()), "other")


# --- features -------------------------------------------------------------

def windows(texts: list[str]):
    """For each window length: (feature of each window, text it belongs to)."""
    blobs = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)))
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                 # one blank after each word
    keep[np.flatnonzero(np.diff(owner, prepend=-1))] = True  # and one before the first
    code, owner = np.where(letter, raw, 32)[keep].astype(np.uint32), owner[keep]
    packed = np.zeros(len(code), dtype=np.uint32)
    for at, n in enumerate(LENGTHS):
        packed = packed[:len(code) - n + 1] << np.uint32(8) | code[n - 1:]
        own = owner[:len(packed)]
        inside = own == owner[n - 1:]
        feature = (packed * np.uint32(2654435761) + np.uint32(at)) >> np.uint32(32 - FEATURES.bit_length() + 1)
        yield feature.astype(np.int64)[inside] + at * FEATURES, own[inside]


def frequencies(texts: list[str]):
    """(features, values, lengths): ragged relative frequencies, windows of a length
    adding up to 1 in each text."""
    parts = []
    for at, (feature, owner) in enumerate(windows(texts)):
        pair, n = np.unique(owner * np.int64(DIM) + feature, return_counts=True)
        doc = pair // DIM
        total = np.bincount(doc, weights=n, minlength=len(texts))
        parts.append((pair, n / total[doc]))
    pair, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(pair, kind="stable")
    return (pair % DIM)[order], value[order], np.bincount(pair // DIM, minlength=len(texts))


def margins(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margin of every text (rows) by every machine."""
    out = np.tile(bias, (len(texts), 1))
    for feature, owner in windows(texts):
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        for m, w in enumerate(weights):
            out[:, m] += np.bincount(owner, weights=w[feature], minlength=len(texts)) / count
    return out


# --- training -------------------------------------------------------------

def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 3):
    """Weights and bias of an L2-regularised, squared-hinge linear machine."""
    w, alpha = np.zeros(DIM + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1 for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[DIM]) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[DIM] += step
                alpha[i] = new
    return w[:DIM], w[DIM]


def logistic_curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-a m - b)) by damped Newton steps; a is not negative."""
    x, t = np.stack([m, np.ones(len(m))], axis=1), (y > 0).astype(float)
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 1e-2 * c
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        c = c - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(c[0]), 1e-3), float(c[1])


def train_machine(group: pd.DataFrame) -> pd.DataFrame:
    """One machine from the rows (side, feat, val) of its two sides."""
    group = group.sort_values(["id", "side"], kind="stable")
    y = group["side"].to_numpy(dtype=float)
    rows = [(np.asarray(f, dtype=np.int64), np.asarray(v, dtype=np.float64)) for f, v in zip(group["feat"], group["val"])]
    mean = np.zeros(DIM)
    for f, v in rows:
        mean[f] += v / len(rows)
    scale = 1 / np.sqrt(mean + 1e-5)                    # rare windows count for more
    rows = [(f, v * scale[f] / 2) for f, v in rows]
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    fold, m = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        rest = np.flatnonzero(fold != k)
        w, b = dual_descent([rows[i] for i in rest], y[rest], cost[rest])
        for i in np.flatnonzero(fold == k):
            m[i] = w[rows[i][0]] @ rows[i][1] + b
    a, c = logistic_curve(m, y, cost)
    w, b = dual_descent(rows, y, cost)
    first = group.iloc[0]
    return pd.DataFrame([{"step": first["step"], "left": first["left"], "right": first["right"],
                          "weights": (w * scale / 2 * a).astype(np.float32), "bias": b * a + c}])


def pairs_of(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def decide(p_left: np.ndarray, names: list[str], pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the winner among ``names``, its mean probability): most wins, then the
    larger mean, then the first name."""
    wins, total = np.zeros((len(p_left), len(names))), np.zeros((len(p_left), len(names)))
    for k, (a, b) in enumerate(pairs):
        i, j, p = names.index(a), names.index(b), p_left[:, k]
        wins[:, i] += p >= 0.5
        wins[:, j] += p < 0.5
        total[:, i] += p
        total[:, j] += 1 - p
    mean = total / (len(names) - 1) if len(names) > 1 else np.ones_like(total)
    best = np.argmax(wins + mean / 2, axis=1)
    return best, mean[np.arange(len(best)), best]


def language_sample(rows: DataFrame, per_language: int, seed: int) -> DataFrame:
    """(id, lang, text): of each language the ``per_language`` rows with the lowest
    draws, a hash of the id.  Draws beyond the share that is needed are dropped before
    the ranking, so it never meets a whole language."""
    drawn = rows.select("id", "lang", (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)).alias("draw")).distinct()
    counts = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    margin = per_language + 8 * per_language ** 0.5 + 32
    few = drawn.join(counts, "lang").where(F.col("draw") * F.col("n") < margin)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    picked = few.withColumn("r", place).where(F.col("r") <= per_language).select("id", "lang")
    one = F.row_number().over(Window.partitionBy("id", "lang").orderBy("text"))
    return save(rows.join(save(picked, "lang-picked"), ["id", "lang"]).withColumn("r", one).where("r = 1").drop("r"), "lang-sample")


def identify_languages(docs: DataFrame, per_language: int = 1200, folds: int = 4, left_out: int = 2,
                       families: dict[str, str] = FAMILIES, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", seed: int = 13) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, family.

    Rows whose crc32 of the id as text is ``left_out`` modulo ``folds`` are held out: their
    languages are not read.  Of the other rows with an id, a language and a letter, at
    most ``per_language`` of each language are examples (a bounded sample; side by side
    families get the same bound, dealt over their languages).  Language, source and id are no
    input of a prediction.  The score is the probability of the family times that of
    the language in it, each the mean over the pairs that the winner is in.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no
    language is known; with one language all others are that language.  Repeated rows get
    equal results; a repeated id with one language gives one example, its smallest text.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col("id").cast("string")) % folds
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    known = rows.where("id is not null and lang is not null").where(crc != left_out).where(F.rlike("text", F.lit(r"\p{L}")))
    sample = language_sample(known, per_language, seed)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family_of(lang, families), []).append(lang)
    names = sorted(members)
    steps = [("family", a, b) for a, b in pairs_of(names)] + [(f, a, b) for f in names for a, b in pairs_of(members[f])]

    def features(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_batches(texts, 500_000):
                f, v, n = frequencies(texts[a:b])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.ListArray.from_arrays(offsets, pa.array(f.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.float32)))], ["id", "lang", "feat", "val"])

    machines, weights, bias = [], np.zeros((0, DIM), np.float32), np.zeros(0)
    if steps:
        uses = []   # (language, step, left, right, side, share of the sample)
        for step, a, b in steps:
            for side, name in ((1, a), (-1, b)):
                group = members[name] if step == "family" else [name]
                uses += [(lang, step, a, b, side, max(1, per_language // len(group))) for lang in group]
        uses = spark.createDataFrame(uses, "lang string, step string, left string, right string, side int, most int")
        ranked = sample.select("id", "lang", "text").mapInArrow(
            features, "id long, lang string, feat array<int>, val array<float>").withColumn(
            "r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")))
        fitted = ranked.join(F.broadcast(uses), "lang").where(F.col("r") <= F.col("most")).groupBy("step", "left", "right").applyInPandas(
            train_machine, "step string, left string, right string, weights array<float>, bias double").collect()
        machines = [(r["step"], r["left"], r["right"]) for r in fitted]
        weights, bias = np.array([r["weights"] for r in fitted], dtype=np.float32), np.array([r["bias"] for r in fitted])
    model = spark.sparkContext.broadcast((machines, weights, bias))

    def predict(batches):
        made, w, b0 = model.value
        place = {m: k for k, m in enumerate(made)}
        at = {s: [place[s, a, b] for a, b in pairs_of(m)] for s, m in [("family", names), *members.items()]}
        for batch in batches:
            texts = [t if ok else "" for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for a, b in text_batches(texts, 500_000):
                part, ok = texts[a:b], np.array(batch.column(2).slice(a, b - a).to_pylist(), dtype=bool) & bool(langs)
                lang, family, score = np.full(b - a, "und", dtype=object), np.full(b - a, None, dtype=object), np.zeros(b - a)
                if ok.any():
                    p = 1 / (1 + np.exp(-np.clip(margins(part, w, b0), -30, 30)))
                    which, sure = decide(p[:, at["family"]], names, pairs_of(names))
                    for k, f in enumerate(names):
                        mine = np.flatnonzero(ok & (which == k))
                        best, inner = decide(p[mine][:, at[f]], members[f], pairs_of(members[f]))
                        lang[mine] = np.array(members[f], dtype=object)[best]
                        family[mine], score[mine] = f, sure[mine] * inner
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lang.tolist(), pa.string()), pa.array(score),
                     pa.array(family.tolist(), pa.string())], ["id", "lang_pred", "score", "family"])

    asked = rows.select("id", "text", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("ok"))
    out = asked.mapInArrow(predict, "id long, lang_pred string, score double, family string")
    return out.select(F.col("id").alias(id_col), F.coalesce(crc == left_out, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "family")
