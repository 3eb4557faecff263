"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, then the rules run
in order of rejections per second, and a text stops at the first that it fails. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of the sample on which the rules are timed, about, and the longest text in it, which bounds its bytes; runs over it,
#: of which the last is timed. The order of the rules depends on it; the verdict doesn't.
SAMPLE_ROWS, SAMPLE_CHARS, RUNS = 1000, 32_768, 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _without(text: Column, char: str) -> Column:
    return F.replace(text, F.lit(char), F.lit(""))


def word_chars(w: Column) -> Column:
    """Code points of an array of words."""
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def n_repeated(x: Column) -> Column:
    """Elements of an array that are equal to an earlier one."""
    return F.size(x) - F.size(F.array_distinct(x))


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long")


def grams(w: Column) -> Column:
    """A hash of each window of three words."""
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))


#: Bits of a window's place in what is sorted; the others are of its hash.
_PLACE = 20
_MASK = (1 << _PLACE) - 1


def packed(g: Column) -> Column:
    """The hashes with their places in the lowest bits, in order: equal windows stand together, by place."""
    return F.sort_array(F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i)))


def _joined(values: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """Those of a sorted array that are equal to a neighbour."""
    near = lambda x, y: F.coalesce(equal(x, y), F.lit(False))
    return F.filter(values, lambda x, j: near(x, F.get(values, j - 1)) | near(x, F.get(values, j + 1)))


def _same(x: Column, y: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), _PLACE) == 0


def _merged(places: Column) -> Column:
    """Words in windows that begin at the sorted places."""
    ahead = F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3))))
    return F.aggregate(ahead, F.lit(0).cast("long"), lambda a, b: a + b)


def _slowly(g: Column) -> Column:
    """Words in windows whose hash is there twice, by sorting hash and place as pairs."""
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.cast("long").alias("i"))))
    return _let(_let(pairs, lambda s: F.sort_array(F.transform(_joined(s, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))), _merged)


def covered(g: Column, p: Column) -> Column:
    """Words in windows whose hash is there twice; p: packed(g). Where the bits of the hash that were sorted are equal and the
    others aren't, or there are too many places for their bits, pairs are sorted instead."""
    at = lambda x: F.get(g, x.bitwiseAND(F.lit(_MASK)).cast("int"))

    def count(found: Column) -> Column:
        mixed = F.exists(
            F.transform(found, lambda x, j: F.coalesce(_same(x, F.get(found, j + 1)) & (at(x) != at(F.get(found, j + 1))), F.lit(False))), lambda x: x
        )
        places = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit(_MASK))))
        return F.when(mixed, _slowly(g)).otherwise(_let(places, _merged))

    return F.when(F.size(g) > _MASK, _slowly(g)).otherwise(_let(_joined(p, _same), count))


def repeated(w: Column) -> Column:
    """Of an array of words, those in a window of three that is there twice."""
    return _let(grams(w), lambda g: F.when(n_repeated(g) == 0, F.lit(0)).otherwise(_let(packed(g), lambda p: covered(g, p)))).cast("long")


def n_repeat_words(text: Column) -> Column:
    return _let(words(text), repeated)


def repeats_much(w: Column) -> Column:
    """Whether over three tenths of the words repeat. A window that is like an earlier one has at most one other that isn't,
    and each covers three words; this bound decides for most texts, without a sort."""
    much = lambda n, g: 10 * n > 3 * (F.size(g) + 2)
    return _let(grams(w), lambda g: F.when(~much(6 * n_repeated(g), g), F.lit(False)).otherwise(much(_let(packed(g), lambda p: covered(g, p)), g)))


@dataclass(frozen=True)
class Facts:
    """What the rules ask of a text: of its own text and words, so that a text which stopped before costs nothing, unless it
    has been counted already."""

    text: Column
    w: Column
    counted: bool = False

    def _count(self, name: str, value: Callable[[], Column]) -> Column:
        return F.col(name) if self.counted else value()

    def n_words(self) -> Column:
        return self._count("n_words", lambda: F.size(self.w))

    def word_chars(self) -> Column:
        return self._count("word_chars", lambda: word_chars(self.w))

    def n_symbols(self) -> Column:
        return self._count("n_symbols", lambda: n_symbols(self.text))

    def repeats_much(self) -> Column:
        return 10 * F.col("n_repeat_words") > 3 * F.col("n_words") if self.counted else repeats_much(self.w)

    def repeats_lines(self) -> Column:
        if self.counted:  # without repeated lines the rule holds; the lines are split again for the others alone
            return F.when(F.col("n_dup_lines") == 0, F.lit(False)).otherwise(10 * F.col("n_dup_lines") > 4 * F.size(lines(self.text)))
        return _let(lines(self.text), lambda x: 10 * n_repeated(x) > 4 * F.size(x))


@dataclass(frozen=True)
class Rule:
    name: str
    #: Whether a text fails.
    fails: Callable[[Facts], Column]


def few_words(least: int) -> Rule:
    return Rule("few_words", lambda x: x.n_words() < least)


#: What says that a text isn't prose, however short it is.
SHAPE = (
    Rule("word_length", lambda x: _let(x.word_chars(), lambda n: (10 * n < 25 * x.n_words()) | (n > 12 * x.n_words()))),
    Rule("symbols", lambda x: 10 * x.n_symbols() > x.n_words()),
    Rule("exclamations", lambda x: 5 * (F.length(x.text) - F.length(_without(x.text, "!"))) > x.n_words()),
    Rule("upper_case", lambda x: 10 * n_upper(x.text) > 3 * x.word_chars()),
    Rule("repeated_lines", lambda x: x.repeats_lines()),
    Rule("repeated_words", lambda x: x.repeats_much()),
)
RULES = (few_words(50), *SHAPE)
#: For a corpus: a short text isn't a bad one; of the texts labelled good, one in twenty has fewer than 50 words.
CORPUS_RULES = (few_words(1), *SHAPE)


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """The texts of about so many rows, the same ones each time, from all of docs: by hash, in one task, without very long
    ones."""
    n = docs.count()
    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    some = docs.where(key.bitwiseAND(F.lit(2**62 - 1)) < F.lit(min(2**62, 2**62 * rows // max(n, 1)))) if n > rows else docs
    text = F.coalesce("text", F.lit(""))
    return some.where(F.length(text) <= SAMPLE_CHARS).select(text.alias("text")).limit(2 * rows)


def measure(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, counted: Callable[[DataFrame], DataFrame] | None = None
) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds on the sample) for each rule, the most rejections per second first; in one job, in which
    the clock is read before and after each rule. counted adds the counts that the rules read where they are there
    already; without it they count for themselves."""
    sample = _sample(docs, rows)
    held = sample.withColumn("w", words(F.col("text"))) if counted is None else counted(sample)
    # Nothing is moved across the explode, and nothing that is random is moved at all: a rule is computed between two clocks.
    again = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(RUNS))).alias("run"))
    facts = Facts(F.col("text"), F.col("w"), counted is not None)
    clock = lambda: F.call_function("reflect", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    timed = [clock().alias("t0")]
    for i, r in enumerate(rules):
        timed += [F.when(F.rand(i) >= 0, r.fails(facts)).alias(f"v{i}"), clock().alias(f"t{i + 1}")]
    last = F.col("run") == RUNS
    got = again.select("run", *timed).agg(*[x for i in range(len(rules)) for x in (
        F.avg(F.when(last, F.col(f"v{i}").cast("int"))), F.sum(F.when(last, F.col(f"t{i + 1}") - F.col(f"t{i}")))
    )]).first()
    found = [(r, float(got[2 * i] or 0.0), max(got[2 * i + 1] or 0, 1) / 1e9) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(rules: list[Rule], facts: Facts) -> Column:
    """The name of the first of the rules that a text fails, null for none. CASE evaluates one condition after another, so
    a rule runs only for texts that all rules before it have passed."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.fails(facts), F.lit(rule.name))
    return out


def verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the rule that rejects a row of docs, in the measured order; null: kept."""
    order, text = [r for r, _, _ in measure(docs, rules)], F.coalesce("text", F.lit(""))
    return _let(words(text), lambda w: cascade(order, Facts(text, w)))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs (any columns; text is read) that pass all rules, as they are.

    Null and empty texts have no words and go where a rule asks for words; repeated rows share their fate; no column is
    added; an empty table gives an empty one."""
    return docs.where(verdict(docs, rules).isNull())


def counts(docs: DataFrame) -> DataFrame:
    """docs (text, not null, any more) with w (the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Each
    step is a column of its own, so that what two others read is computed once."""
    w, g = F.col("_w"), F.col("_g")
    rows = docs.withColumn("_w", words(F.col("text"))).withColumn("_g", grams(w))
    rows = rows.withColumn("_p", F.when(n_repeated(g) > 0, packed(g)))
    return rows.select(
        *docs.columns, w.alias("w"), F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"),
        _let(lines(F.col("text")), n_repeated).cast("long").alias("n_dup_lines"), F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered(g, F.col("_p"))).cast("long").alias("n_repeat_words"),
    )


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every row of documents. Null text: no words; repeated rows have a row
    each; an empty table gives an empty one. The counts are columns of the result, so rules that read them cost little,
    and come first as far as they reject; upper case, exclamations and the number of lines are computed for the texts
    left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [r for r, _, _ in measure(docs, counted=counts)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & cascade(order, Facts(F.col("text"), F.col("w"), True)).isNull()
    return counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept")
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
k AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
        length(text) - length(replace(text, '!', '')) AS n_excl, len(ls) AS n_lines,
        length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
    OR 5 * n_excl > n_words OR 10 * n_upper > 3 * word_chars OR 10 * n_dup_lines > 4 * n_lines
    OR 10 * n_repeat_words > 3 * n_words) AS kept
FROM b
"""
