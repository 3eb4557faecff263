"""Near-dedup of whole documents on word shingles: the SimHash operator's pigeonhole probe and band keys of the shingles
propose, the sets of shingles themselves decide, and one document of each group stays.

SimHash proposes by the fingerprint of a text's distinct words, on which scattered edits change few bits; of the shingles'
own, texts of which 0.8 are shared differ in ten bits of 64, which no probe reaches. Blocks that are put in, cut off or
replaced bring many words at once; such texts share a band key of their shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, hot_join, shared, small
from .simhash import _bytes, _signed, classes, in_blocks, links, majority, shingle_hashes, whole_runs

#: Words of a shingle, and the similarity (shared shingles to all shingles) from which texts link, as a fraction.
WORDS, LIKE = 5, (4, 5)
#: Bits in which the fingerprints of the words of linked texts differ at most: about 4 at 0.8 for scattered edits.
TAU = 9
#: Keys of a text, and minima in a key. Two texts of similarity s share a key with probability 1 - (1 - s^5)^20, wherever
#: they differ: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
_ODD = np.random.default_rng(7).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Texts, and shingles, of a key that one task compares with each other, and with those of another block of a larger key.
BLOCK, SHINGLES = 1_024, 2_000_000


def band_keys(own: np.ndarray) -> list[int]:
    """The keys of a set of shingle hashes, by its least hashes in so many orders; none of an empty set."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 1 << 12):
        low = np.minimum(low, (_ODD[:, None] * own[i : i + (1 << 12)]).min(1))
    return [xxhash.xxh64_intdigest(low[j * ROWS : (j + 1) * ROWS].tobytes(), j) for j in range(BANDS)]


def prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), sid and size of the set of its shingles, fp: the SimHash of its distinct words, keys:
    its band keys."""
    out = "doc_id long, th long, sid long, size int, fp long, keys array<long>"

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                w = list(set(t.lower().split()))
                one = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in w), np.uint64, len(w))
                own = np.unique(shingle_hashes(t, words))
                rows.append((xxhash.xxh64_intdigest(own.tobytes()), len(own), majority(one), np.array(band_keys(own), np.uint64).view(np.int64)))
            sid, size, fp, keys = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch(
                [
                    b.column("doc_id"), b.column("th"), _signed(list(sid)), pa.array(size, pa.int32()), _signed(list(fp)),
                    pa.array(keys, pa.list_(pa.int64()))
                ],
                [x.split()[0] for x in out.split(", ")]
            )

    return _bytes(docs).transform(by_arrow, run, out)


def sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """sid, own: the shingles of the texts (sid, doc_id, th) asked for, from docs, once each."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("sid"), pa.array(got, pa.list_(pa.int64()))], ["sid", "own"])

    named = small(shared(asked.select("sid", F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"))))
    texts = _bytes(docs).join(named, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("th") == F.col("a_th"))).select("sid", "text")
    return shared(texts.transform(by_arrow, run, "sid long, own array<long>").dropDuplicates(["sid"]))


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) of which the sets (sid, own) are alike."""
    pairs = shared(pairs)
    total = pairs.count()
    met = pairs
    for end in ("u", "v"):
        n = pairs.groupBy(end).agg(F.count("*").alias("n")).join(held.select(F.col("sid").alias(end), F.col("own").alias(f"{end}_own")), end)
        met = hot_join(met, n, end, "n", total)
    common = F.size(F.array_intersect("u_own", "v_own"))
    return met.where(LIKE[1] * common >= LIKE[0] * (F.size("u_own") + F.size("v_own") - common)).select("u", "v")


def alike(values: np.ndarray, offsets: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links of roots that join all components with two sets that are alike; set i is values[offsets[i]:offsets[i + 1]], of
    component root[i]. Every two sets are compared, by products of the matrix of the shingles that several sets have."""
    n, size = len(root), np.diff(offsets)
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times > 1
    column = np.cumsum(several) - 1
    row = np.repeat(np.arange(n), size)[several[at]]
    column = column[at[several[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for c in range(0, int(several.sum()), 2048):
        a, e = np.searchsorted(column, (c, c + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[row[a:e], column[a:e] - c] = 1
        common += part @ part.T
    near = (LIKE[0] + LIKE[1]) * common >= LIKE[0] * (size[:, None] + size[None, :])
    near |= root[:, None] == root[None, :]
    out, left = [], np.ones(n, bool)
    for i in range(n):
        if left[i]:
            todo, known = [i], {int(root[i])}
            left[i] = False
            while todo:
                new = np.flatnonzero(near[todo].any(0) & left)
                left[new] = False
                todo = new.tolist()
                out += [(int(root[i]), r) for r in set(root[new].tolist()) - known]
                known.update(root[new].tolist())
    return out


def band_links(docs: DataFrame, own: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """Links (u, v) of roots of own (sid, root, size, keys, doc_id, th: one row for each set) that hold alike sets which share
    a band key. held: sets (sid, own) that are known already.

    Only keys that texts of different components share are looked into, and of keys with the same texts one."""
    keyed = own.select("sid", "root", "size", F.explode("keys").alias("m"))
    mixed = keyed.groupBy("m").agg(
        F.min("root").alias("a"), F.max("root").alias("e"), F.count("*").alias("n"), F.sum("size").alias("w"),
        F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("who")
    )
    once = mixed.where("a != e").groupBy("who", "n", "w").agg(F.min("m").alias("m"))
    buckets = shared(once.select("m", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / SHINGLES)).alias("blocks")))
    if buckets.isEmpty():
        return own.where("false").select(F.col("root").alias("u"), F.col("root").alias("v"))
    dealt = shared(in_blocks(keyed, ["m"], buckets, keyed.count(), "sid").select("m", "p", "q", "sid", "root"))
    asked = dealt.select("sid").distinct().join(held.select("sid"), "sid", "left_anti")
    every = held.unionByName(sets(docs, own.select("sid", "doc_id", "th").join(asked, "sid", "left_semi"), words))
    times = dealt.groupBy("sid").agg(F.count("*").alias("n")).join(every, "sid")
    rows = hot_join(dealt, times, "sid", "n", dealt.count()).select("m", "p", "q", "root", "own")

    def run(batches):
        for t in whole_runs(batches, 3):
            m, p, q, root = (t.column(c).to_numpy() for c in range(4))
            lists = pa.concat_arrays(t.column(4).cast(pa.large_list(pa.int64())).chunks)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            found = set()
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(m)]):
                if (root[a:e] != root[a]).any():
                    found.update(alike(values[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], root[a:e]))
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows.repartition("m", "p", "q").sortWithinPartitions("m", "p", "q").transform(by_arrow, run, "u long, v long").distinct()


def members(docs: DataFrame, words: int = WORDS, tau: int = TAU) -> DataFrame:
    """doc_id, th, root, component_id for every row of docs (doc_id, text): texts link if 0.8 or more of their shingles of
    `words` words are shared, and links are followed on; component_id is the smallest doc_id of a group."""
    made = shared(prints(docs, words))
    nodes = shared(made.groupBy(F.col("sid").alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("fp").alias("fp")))
    one = made.groupBy("sid").agg(F.first(F.struct("size", "keys", "doc_id", "th")).alias("x")).select("sid", "x.*")
    near = shared(links(nodes.select("node", "fp"), tau, direct=True))
    ends = near.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    held = sets(docs, one.join(ends, "sid", "left_semi"), words)
    sure = shared(verified(near, held))
    named = classes(nodes, sure)
    stars = named.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    own = shared(one.join(named.select(F.col("node").alias("sid"), "root"), "sid"))
    named = classes(nodes, stars.unionByName(band_links(docs, own, held, words)))
    found = hot_join(
        made.withColumnRenamed("sid", "node"), named.select("node", "n", F.col("root").alias("group"), F.col("top").alias("component_id")), "node",
        "n", made.count()
    )
    return found.select("doc_id", "th", F.col("group").alias("root"), "component_id")


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")


def dedup(docs: DataFrame, words: int = WORDS, tau: int = TAU) -> DataFrame:
    """The rows of docs (doc_id, text, any more), one of each group of near duplicates: that with the smallest doc_id.

    Texts of fewer words than a shingle have one shingle, all their words; texts without words, null and empty ones
    included, are one group. Equal rows (doc_id and text) leave one; of rows that share a doc_id but not the text, the
    one with the smaller hash of the text comes first; a null doc_id stays only if its group has none else; no column is
    added; an empty table gives an empty one."""
    got = shared(members(docs, words, tau))
    total = got.count()
    kept = got.groupBy("root").agg(F.min(_first()).alias("k"), F.count("*").alias("n"))
    out = hot_join(got, kept, "root", "n", total).where(~_first().eqNullSafe(F.col("k"))).select(F.col("doc_id").alias("o_doc"), F.col("th").alias("o_th")).distinct()
    many = shared(
        got.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th"))
    )
    key = [F.struct("*").alias("row"), F.xxhash64("text").alias("th")]
    left = docs.select(*key).join(small(shared(out)), F.col("row.doc_id").eqNullSafe(F.col("o_doc")) & (F.col("th") == F.col("o_th")), "left_anti")
    if many.isEmpty():
        return left.select("row.*")
    same = F.col("row.doc_id").eqNullSafe(F.col("m_doc")) & (F.col("th") == F.col("m_th"))
    once = left.join(small(many), same, "left_semi").groupBy("row.doc_id", "th").agg(F.first("row").alias("row")).select("row.*")
    return left.join(small(many), same, "left_anti").select("row.*").unionByName(once)
