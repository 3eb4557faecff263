"""Homomorphic multiset fingerprints: wide vectors hashed from paragraphs are added modulo powers of two, so equality
doesn't depend on the paragraphs' order, and paragraphs can be put in and taken out without reading the others."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table

#: Lanes of 64 bits from each paragraph's digest: equality. Lanes of 32 bits that count its byte shingles with signs: likeness.
#: A cell holds less than 2**31 bytes, so the count of no text leaves the range of a signed lane.
EXACT, SKETCH = 16, 256
#: Bytes in a shingle (about three words).
SHINGLE = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Fingerprint:
    """A sum of paragraph vectors; + and - of fingerprints are those of the multisets."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact  # modulo 2**64
        self.sketch = np.zeros(SKETCH, np.uint32) if sketch is None else sketch  # modulo 2**32

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.exact == other.exact).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def text(self) -> str:
        """All lanes in base 64."""
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, said: str) -> Fingerprint:
        raw = base64.b64decode(said)
        return cls(np.frombuffer(raw, "<u8", EXACT).astype(np.uint64), np.frombuffer(raw, "<u4", SKETCH, 8 * EXACT).astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, about 0 for such as share nothing: the lanes' squares estimate the squared sizes of the
        two shingle multisets and of their difference (deviation about the root of 2 / SKETCH)."""
        if self == other:
            return 1.0
        a, b = (x.sketch.view(np.int32).astype(np.float64) for x in (self, other))
        both = float((a * a).sum() + (b * b).sum())
        return min(1.0, max(0.0, 1.0 - float(((a - b) ** 2).sum()) / both)) if both else 0.0


def paragraphs(text: bytes) -> list[bytes]:
    """Every line, empty ones included: together with their number they give the text back but for the order."""
    return text.split(b"\n")


def _sum(parts: list[bytes]) -> Fingerprint:
    """The sum of the paragraphs' vectors."""
    exact = np.frombuffer(b"".join([hashlib.shake_128(p).digest(8 * EXACT) for p in parts]), "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    long = [p for p in parts if len(p) >= SHINGLE]
    h = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts if 0 < len(p) < SHINGLE), np.uint64)
    lanes = np.zeros(SKETCH, np.int64)
    for i in range(0, len(long), 512):
        some = long[i : i + 512]
        raw = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
        # Eight bytes from each place on, as one number; a shingle is two of them. Those across two paragraphs don't count.
        for a in range(0, len(raw) - SHINGLE + 1, 1 << 20):
            own = raw[a : a + (1 << 20) + SHINGLE - 1]
            at = np.lib.stride_tricks.as_strided(own, (len(own) - 7, 8), (1, 1)).copy().view("<u8").ravel()
            n = len(own) - SHINGLE + 1
            x = (at[:n] * _A) ^ ((at[8 : 8 + n] + _C) * _B)
            lanes += _count(x[_inside(a, n, ends)])
    return Fingerprint(exact, (lanes + _count(h)).astype(np.uint32))


def _inside(a: int, n: int, ends: np.ndarray) -> np.ndarray:
    ok = np.ones(n, bool)
    for e in ends[(ends > a) & (ends < a + n + SHINGLE)].tolist():
        ok[max(0, e - a - SHINGLE + 1) : max(0, e - a)] = False
    return ok


def _count(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C
    x ^= x >> np.uint64(32)
    both = np.bincount((x & np.uint64(2 * SKETCH - 1)).astype(np.int64), minlength=2 * SKETCH)
    return both[:SKETCH] - both[SKETCH:]


def of(text: bytes) -> Fingerprint:
    return _sum(paragraphs(text))


def edit(fp: Fingerprint, text: bytes, at: int, new: bytes) -> Fingerprint:
    """The fingerprint of text[:at] + new from that of text: the paragraphs behind the edit are taken out and the new
    ones put in; those before it aren't read."""
    line = text.rfind(b"\n", 0, at) + 1
    return fp - _sum(paragraphs(text[line:])) + _sum(paragraphs(text[line:at] + new))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint string for every row of docs (doc_id, text). Null and empty texts: one empty paragraph; repeated
    rows: a row each; extra columns are left out; an empty table gives an empty one."""

    def run(batches):
        for b in batches:
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([of(t).text() for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    ).transform(by_arrow, run, "doc_id long, fingerprint string")


#: Stretches of doc_id for each shuffle partition, and how many there are at most: their ends are all that is collected.
STRETCHES, MOST = 4, 16_384
#: Texts that are Python objects at one time.
BLOCK = 256


def _bisect(cuts, step: int):
    return lambda p: p + F.when(F.coalesce(F.get(cuts, p + (step - 1)) < F.col("doc_id"), F.lit(False)), step).otherwise(0)


def with_next(docs: DataFrame, made, run, schema: str) -> DataFrame:
    """Runs run(doc_id, own, next) -> row of `schema` over docs in descending doc_id (null last, ties by text); the one after
    the last is the first. own and next are what made(text) gives, once for each text.

    The ids are cut into stretches at their quantiles. The row behind a stretch is the one with the largest id of the next
    stretch, which one pass over the ids finds; that row alone is dealt out twice. So texts are shuffled once, and a
    task holds two of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(MOST, STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # A stretch is found by bisection in the sorted cuts; each step binds the last one's result, so the expression stays
    # as long as the number of steps.
    array, place = F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0)
    step = 1 << max(0, len(cuts).bit_length() - 1)
    while cuts and step:
        place = F.element_at(F.transform(F.array(place), _bisect(array, step)), 1)
        step //= 2
    stretch = F.when(F.col("doc_id").isNull(), 0).otherwise(place + 1).cast("int")
    tops = [(r[0], r[1]) for r in ids.groupBy(stretch.alias("s")).agg(F.max("doc_id").alias("top")).orderBy(F.desc("s")).collect()]
    if not tops:
        return spark.createDataFrame([], schema)
    # The largest id of each stretch also ends the one above it; that of the first ends the last.
    above, top = [0] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (s, t) in enumerate(tops):
        above[s], top[s] = tops[i - 1][0], t
    held = rows.withColumn("s", stretch)
    is_top = F.col("doc_id").eqNullSafe(F.get(F.array(*[F.lit(t).cast("long") for t in top]), "s"))
    own = F.struct(F.col("s").alias("s"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(F.array(*[F.lit(x) for x in above]), "s").alias("s"), F.lit(True).alias("ghost"))
    dealt = held.select(
        "doc_id", "text", F.explode(F.when(is_top, F.array(own, ghost)).otherwise(F.array(own))).alias("d")
    ).select("d.s", "d.ghost", "doc_id", "text")
    parted = dealt.repartition("s").sortWithinPartitions("s", "ghost", F.desc_nulls_last("doc_id"), "text")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        held = None  # (stretch, doc_id, own) that waits for the text behind it
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                out = []
                for s, g, i, t in zip(*(c.to_pylist() for c in b.slice(at, BLOCK).columns)):
                    waits = held is not None and held[0] == s
                    own = made(t) if waits or not g else None
                    if waits:
                        out.append(run(held[1], held[2], own))
                    held = None if g else (s, i, own)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return parted.transform(by_arrow, work, schema)


def edited(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): the digest of its edited text (the last third replaced by as much of the
    beginning of the next document in descending doc_id), its fingerprint, that of the edited text, and how like its
    fingerprint those of the edited text and of the next document are.

    Null text: empty, and the edited text is the text itself; ties in doc_id are in order of text, so repeated rows follow
    each other; null doc_id: last; a single row is its own next; extra columns are left out; an empty table gives an
    empty one."""

    def made(text):
        raw = text.encode()
        return text, raw, of(raw)

    def run(doc_id, own, after):
        (text, raw, fp), (follows, _, behind) = own, after
        n = len(text)
        third = n // 3
        kept, new = text[: n - third].encode(), follows[:third].encode()
        changed = edit(fp, raw, len(kept), new)
        return doc_id, n, hashlib.sha256(kept + new).hexdigest(), fp.text(), changed.text(), fp.likeness(changed), fp.likeness(behind)

    return with_next(
        docs, made, run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
