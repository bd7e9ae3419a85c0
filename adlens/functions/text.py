"""Text helpers for ad copy: tokenising, stop words, n-grams (M6).

Tokens come from ``regexp_extract_all`` (JVM regex over the whole text);
stop-word removal and bigrams use Spark ML's ``StopWordsRemover`` and
``NGram`` transformers, which run natively over the token arrays.  (The
column-expression form below is kept for small inputs; with higher-order
lambdas it is about 10x slower on long documents.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark ML's default English stop words
# (StopWordsRemover.loadDefaultStopWords("english")), in their natural order.
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
""".split())

# A token is a maximal run of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text) -> Column:
    """Lower-cased word tokens of the whole text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def with_words(df: DataFrame, text_col: str, out_col: str = "words",
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Adds ``out_col``: the tokens in order, stop words removed."""
    from pyspark.ml.feature import StopWordsRemover
    x = df.withColumn("_tok", tokens(text_col))
    x = StopWordsRemover(inputCol="_tok", outputCol=out_col, stopWords=list(stop_words),
                         caseSensitive=True).transform(x)
    return x.drop("_tok")


def with_terms(df: DataFrame, text_col: str, out_col: str = "terms",
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Adds ``out_col``: unigrams (stop words removed) followed by bigrams of
    the remaining tokens, so that bigrams skip over stop words."""
    from pyspark.ml.feature import NGram
    x = with_words(df, text_col, "_uni", stop_words)
    x = NGram(n=2, inputCol="_uni", outputCol="_bi").transform(x)
    return x.withColumn(out_col, F.concat("_uni", "_bi")).drop("_uni", "_bi")
