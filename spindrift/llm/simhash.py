"""SimHash near-dedup by the generalised pigeonhole principle: correlated bits are grouped into partitions, each partition
gets a threshold of its own by dynamic programming on estimated candidate counts, and buckets of equal partition values
(up to the threshold) are probed and verified."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, hot_join, shared, small, table

BITS = 64
#: Distinct fingerprints on which the partitions and thresholds are chosen; they decide the cost, not the result.
PLAN_ROWS = 20_000
#: What a bucket row costs against one comparison in a bucket.
ROW_COST = 1_000.0


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of `words` words, repeats included; of the whole sequence if there are fewer."""
    w = text.lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(w) - words + 1
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; none: 0."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, th (hash of the text), fp: the 64-bit SimHash of the text's word shingles (ASCII letters in lower case)."""

    def run(batches):
        for b in batches:
            fp = [majority(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("th"), _signed(fp)], ["doc_id", "th", "fp"])

    return _bytes(docs).transform(by_arrow, run, "doc_id long, th long, fp long")


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )


# -- the plan


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal size; each grows by the bit most correlated with what it has."""
    x = bits - bits.mean(0)
    norm = np.sqrt((x * x).sum(0)) + 1e-9
    corr = np.abs(x.T @ x) / norm[:, None] / norm[None, :]
    left, out = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(left)
        own = [max(rest, key=lambda i: corr[i, rest].sum())]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(left), key=lambda i: corr[i, own].sum())
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds for n distinct fingerprints like those of the sample: thresholds plus one add up to
    tau + 1, so two fingerprints at most tau apart are within the threshold on one partition at least. -1: not probed."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, len(sample), (2, 400_000))
    pairs = pairs[:, pairs[0] != pairs[1]]
    differ = sample[pairs[0]] ^ sample[pairs[1]]
    best: tuple[float, list] = (np.inf, [])
    for m in range(2, tau + 2):
        groups = _groups(bits, m) if len(sample) > 1 else [list(range(g, BITS, m)) for g in range(m)]
        cost = []
        for own in groups:
            mask, w = np.uint64(sum(1 << i for i in own)), len(own)
            found = np.bincount(np.bitwise_count(differ & mask), minlength=w + 1)
            share = [(found[d] + comb(w, d) / 2**w) / (found.sum() + 1) for d in range(w + 1)]
            row = [0.0]
            for t in range(min(tau, w - 1) + 1):
                met = sum(share[d] * comb(w - d, t - d) for d in range(t + 1))  # masks of t bits that hide what differs
                row.append(ROW_COST * n * comb(w, t) + met * n * n / 2)
            cost.append(row + [np.inf] * (tau + 2 - len(row)))
        # least[s]: the least cost at which the first partitions have s in thresholds plus one, and those thresholds
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t in range(tau + 2 - s):
                    if c + row[t] < nxt.get(s + t, (np.inf,))[0]:
                        nxt[s + t] = (c + row[t], [*ts, t - 1])
            least = nxt
        got = least.get(tau + 1)
        if got and got[0] < best[0]:
            best = (got[0], list(zip(groups, got[1])))
    return best[1]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """What is left of a fingerprint in each bucket key: a partition without as many of its bits as its threshold says."""
    out = []
    for own, t in parts:
        for gone in combinations(own, t) if t >= 0 else ():
            out.append(sum(1 << i for i in own if i not in gone))
    return [x - 2**64 if x >= 2**63 else x for x in out]


# -- buckets

#: Rows of a bucket that one task compares with each other, and those of two blocks of a larger one.
BLOCK = 16_384
#: Cells of a matrix of comparisons.
CELLS = 4_000_000


def bucket_links(fp: np.ndarray, tau: int, direct: bool = False) -> list[tuple[int, int]]:
    """Links (root, member) that join exactly what is within tau bits in the bucket: a search from each root compares the
    members found with those that haven't been yet, so a bucket of b near copies gives b - 1 links, not b * b / 2. With
    direct, each link is of two fingerprints that are within tau bits themselves."""
    n = len(fp)
    step = max(1, min(256, CELLS // max(n, 1)))
    some = np.zeros(n, bool)
    for i in range(0, n, step):
        own = np.arange(i, min(i + step, n))
        if n <= step or not some[own].all():
            hit = np.bitwise_count(fp[own][:, None] ^ fp[None, :]) <= tau
            hit[np.arange(len(own)), own] = False
            some |= hit.any(0)
            some[own] |= hit.any(1)
    left, out = np.flatnonzero(some), []
    while len(left):
        todo, left = left[:1], left[1:]
        root = int(todo[0])
        while len(todo) and len(left):
            own, todo = todo[:step], todo[step:]
            hit = np.bitwise_count(fp[own][:, None] ^ fp[left][None, :]) <= tau
            found = hit.any(0)
            near = own[hit.argmax(0)[found]].tolist() if direct else [root] * int(found.sum())
            out += zip(near, left[found].tolist())
            todo = np.r_[todo, left[found]]
            left = left[~found]
    return out


def whole_runs(batches, keys: int):
    """The rows of sorted batches as tables in which every run of equal values of the first `keys` columns is whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        other = np.logical_or.reduce([k != k[-1] for k in key])
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and any(h.column(i)[-1] != b.column(i)[0] for h in held[-1:] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame, total: int, member: str) -> DataFrame:
    """rows with p and q: of a key whose rows make more than one block (sizes: keys, n, blocks), a row is dealt to each pair
    of blocks that has its own, so that any two rows meet and no task holds more than two blocks; else both are 0. Rows
    whose key isn't in sizes are left out."""
    met = hot_join(rows, sizes, keys, "n", total)
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda x: F.struct(F.least(own, x).alias("p"), F.greatest(own, x).alias("q"))
    )
    return met.select(*rows.columns, F.explode(pair).alias("b")).select(*rows.columns, "b.p", "b.q")


def links(nodes: DataFrame, tau: int, block: int = BLOCK, direct: bool = False) -> DataFrame:
    """Links (u, v) among nodes (node, fp), each once: as many as join what is within tau bits; with direct, each of two that
    are."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.select("fp").limit(PLAN_ROWS).collect()], np.int64).view(np.uint64)
    keys = masks(plan(sample, n, tau)) if n > 1 else []
    if not keys:
        return nodes.where("false").select(F.col("node").alias("u"), F.col("node").alias("v"))
    place = F.transform(F.array(*[F.lit(k) for k in keys]), lambda m, j: F.struct(j.alias("j"), F.col("fp").bitwiseAND(m).alias("m")))
    held = nodes.select("node", "fp", F.explode(place).alias("k")).select("k.j", "k.m", "node", "fp")
    # Every fingerprint is in a bucket of each mask; those that are alone there meet nobody.
    sizes = held.groupBy("j", "m").agg(F.count("*").alias("n"))
    big = shared(sizes.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block)))
    zero = F.lit(0).alias("p"), F.lit(0).alias("q")
    if big.isEmpty():
        dealt = held.select("j", "m", *zero, "node", "fp")
    else:
        rest = held.join(small(big.select("j", "m")), ["j", "m"], "left_anti")
        dealt = in_blocks(held, ["j", "m"], big, n * len(keys), "node").select("j", "m", "p", "q", "node", "fp").unionByName(rest.select("j", "m", *zero, "node", "fp"))

    def run(batches):
        for t in whole_runs(batches, 4):
            j, m, p, q, node, fp = (c.to_numpy() for c in t.columns)
            fp = fp.view(np.uint64)
            first = np.flatnonzero(np.r_[True, (j[1:] != j[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            size = np.diff(np.r_[first, len(j)])
            close = np.zeros(len(first), bool)
            run_of = np.repeat(np.arange(len(first)), size)
            for s in range(1, min(int(size.max()), 33)):  # small buckets: which have a link at all, for all of them at once
                i = np.flatnonzero((run_of[:-s] == run_of[s:]) & (size[run_of[:-s]] <= 32))
                close[run_of[i[np.bitwise_count(fp[i] ^ fp[i + s]) <= tau]]] = True
            pairs = set()
            for r in np.flatnonzero(close | (size > 32)).tolist():
                a, e = first[r], first[r] + size[r]
                pairs.update((int(a + x), int(a + y)) for x, y in bucket_links(fp[a:e], tau, direct))
            if pairs:
                u, v = (node[[x[k] for x in pairs]] for k in (0, 1))
                yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    key = ["j", "m", "p", "q"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "node").transform(by_arrow, run, "u long, v long").distinct()


# -- components


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable, for every vertex of the links (u, v) that has a smaller one. Large-star and
    small-star steps in turn, until all links are stars; every step is an aggregate and a join, and is written to the shared
    folder, so no plan holds two steps: each reads what it starts from several times."""
    pairs = shared(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = pairs.select(F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )).alias("e"))
        at = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
        # A star: no vertex has two smaller ones, or a smaller and a larger one.
        n, unlike = at.agg(F.sum("up"), F.max(F.col("up") + F.least("up", "down") > 1)).first()
        if not unlike:
            return pairs.select(F.col("u").alias("v"), F.col("v").alias("root"))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        large = shared(hot_join(both, low, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small_star = hot_join(large, low, "u", "n", 2 * n).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("p"))
        pairs = shared(small_star.select("p.u", "p.v").where("u != v").distinct())


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, rep, n) with root: one vertex of each component of the links, and its own where it has none; top: the
    smallest rep of the component, null if it has none."""
    roots = components(edges).select(F.col("v").alias("node"), "root")
    named = shared(nodes.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tops = named.groupBy("root").agg(F.min("rep").alias("top"), F.count("*").alias("m"))
    return shared(hot_join(named, tops, "root", "m", named.count()))


def link(docs: DataFrame, words: int = 4, tau: int = 4) -> DataFrame:
    """doc_id, th, fp, component_id for every row of docs (doc_id, text): fingerprints link at tau or fewer differing
    bits, and links are followed on.

    Null and empty texts have no words and fingerprint 0, which links like any other; a null doc_id is larger than every
    other and stands for a group only where there is none else (component_id null); repeated rows have a row each; extra
    columns are left out; an empty table gives an empty one."""
    prints = shared(fingerprints(docs, words))
    nodes = shared(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    named = classes(nodes, links(nodes.select("node", F.col("node").alias("fp")), tau))
    found = hot_join(
        prints.withColumn("node", F.col("fp")), named.select("node", "n", F.col("top").alias("component_id")), "node", "n", prints.count()
    )
    return found.select("doc_id", "th", "fp", "component_id")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = link(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
