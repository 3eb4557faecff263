"""Text expressions: tokens, stop words, token-set similarity, sentences. All are columns evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the search index.
STOP_WORDS = (
    "a an the is it in on at to for of and or not but with by from as be was were been being have has had do does did will would could should may "
    "might shall can this that these those am are if then than so no nor up out about into over after before between under above such each which their "
    "we he she they me him her us them my his its our your all any both few more most other some what when where who how i you just also very too"
).split()
MIN_LENGTH, MAX_LENGTH = 2, 50
#: A token is a run of letters and digits; Java and RE2 read the pattern alike.
TOKEN = r"([\p{L}\p{N}]+)"


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens in order; the place in the array is the token's position, dropped tokens included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def is_term(token: Column) -> Column:
    """Whether a token is indexed: long enough, not too long, an ASCII letter in it, no stop word."""
    return F.length(token).between(MIN_LENGTH, MAX_LENGTH) & token.rlike("[a-zA-Z]") & ~token.isin(*STOP_WORDS)


def terms(text: Column) -> Column:
    return F.filter(raw_tokens(text), is_term)


def words(text: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens with no filter, as the similarity measures take them."""
    return F.array_distinct(raw_tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def bigrams(text: Column) -> Column:
    """Distinct adjacent pairs of tokens."""
    t = raw_tokens(text)
    return F.array_distinct(F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)
    ))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """What a language model would count, at 1.3 tokens a word; 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * F.lit(1.3)).cast("int"))


def positions(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, term, pos: one row for each indexed token; positions count dropped tokens as well."""
    return df.select(*keys, F.posexplode(raw_tokens(F.col(text))).alias("pos", "term")).where(is_term(F.col("term")))
