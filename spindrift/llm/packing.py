"""Best-fit packing in a tree: each task packs its own pieces best-fit and emits the nearly full bins; the underfull ones
are merged, as items, in groups of tasks, then groups of groups.

A merge works on the counts of items of each fill, at most 4096 of a part, so a group's plan has the same size however many
items it has; the items find their places by their number within their part and fill."""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, shared, table

SIZE = 4096
#: Bins at least this full are emitted; the others are items of the next round.
NEARLY_FULL = 4032
FAN = 16
#: Pieces that a task packs together: a leaf of the tree. A task of more has more leaves, and all their underfull bins go on.
LEAF = 1_000_000
#: Rows of a plan that are broadcast; a larger plan meets its items by a shuffle.
PLAN_ROWS = 200_000
#: A bin's name: level (5 bits), part (22) and number in the part (36).
_LEVEL, _PART = 58, 36
#: Texts that are encoded together.
BLOCK = 256


class WordCoder:
    """Ids of a word-end BPE file. Texts that hold only characters below U+0250 whose classes every regular-expression
    library has alike are split here, first at white space, which no piece holds, and each distinct word is encoded once;
    all others go to the library whole."""

    #: Outside U+024F; the separators FS to US and NEL, which libraries class differently; a letter whose lower case is two.
    _ODD = re.compile("[^\x00-\u024f]|[\x1c-\x1f\x85\u0130]")
    #: Words that are held, those that are held between tasks, and characters of a word that is.
    CACHE, BETWEEN, LONGEST = 600_000, 200_000, 64

    def __init__(self, vocab: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocab)
        self.tok.encode_special_tokens = True
        # Fixed value: the split pattern of the vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        names = self.tok.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def _odd(self, text: str) -> bool:
        return any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else self._ODD.search(text) is not None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: set[str], into: dict[str, bytes]) -> None:
        """Ids of the words, each of which is the ids of its pieces. The pieces are encoded as one text; each ends with
        the only token in it that ends a word."""
        parts = {w: self.split(w) for w in words if not w.isalpha()}
        pieces = list({w for w in words if w.isalpha()} | {p for ps in parts.values() for p in ps if p not in into})
        ids = self._ids(" ".join(pieces))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(pieces) and (not len(ids) or cuts[-1] == len(ids)):
            raw = ids.tobytes()
            into.update(zip(pieces, (raw[a:e] for a, e in zip([0, *(4 * cuts[:-1]).tolist()], (4 * cuts).tolist()))))
        else:
            into.update((p, self._ids(p).tobytes()) for p in pieces)
        into.update((w, b"".join([into[p] for p in ps])) for w, ps in parts.items() if len(ps) != 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [None if self._odd(t) else t.lower().split() for t in texts]
        if len(self.cache) > self.CACHE:  # the words that came first are the frequent ones
            self.cache = dict(islice(self.cache.items(), self.CACHE // 2))
        new = set().union(*(ws for ws in words if ws)).difference(self.cache)
        if new:
            self._learn(new, self.cache)
        out = [self._ids(t).tobytes() if ws is None else b"".join(map(self.cache.__getitem__, ws)) for t, ws in zip(texts, words)]
        for w in new:
            if len(w) > self.LONGEST:
                self.cache.pop(w, None)
        return out


    def rest(self) -> None:
        """Holds the words that came first, which are the frequent ones, until the next task."""
        if len(self.cache) > self.BETWEEN:
            self.cache = dict(islice(self.cache.items(), self.BETWEEN))


@functools.lru_cache(2)
def word_coder(vocab: str) -> WordCoder:
    return WordCoder(vocab)


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill: longest first, each to the fullest bin that it fits."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what they still hold
    some = 0  # bit r is set if room[r] has a bin
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        if fits := some >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b = size, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    return where, offset, np.array(fill, np.int64)


def merge_counts(count: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best fit, longest first, of count[n] items of each length n: (length, from, to, bin, per bin, offset) for runs of a
    length's items, numbered from 0: item k of a run is in bin + (k - from) // per_bin, at offset + (k - from) % per_bin *
    length; and (first bin, end, fill) of the bins.

    Bins that hold the same are one range of numbers, which a run of equal items goes through as a whole, so the work
    depends on the number of different lengths and not on that of items."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # ranges of bins by what they still hold
    some, bins = 0, 0  # bit r of some is set if room[r] has a range

    def put(r: int, a: int, e: int) -> None:
        nonlocal some
        if a < e:
            room[r].append((a, e))
            some |= 1 << r

    for n in sorted(count, reverse=True):
        done, last = 0, count[n]
        while done < last:
            if fits := some >> n:
                r = n + (fits & -fits).bit_length() - 1
                a, e = room[r].pop()
                if not room[r]:
                    some ^= 1 << r
            else:
                r, a = size, bins
                bins = e = bins - (done - last) // (size // n)  # as many as the items left need
            per = r // n
            whole = min(e - a, (last - done) // per)
            if whole:
                runs.append((n, done, done + whole * per, a, per, size - r))
                put(r - per * n, a, a + whole)
                done += whole * per
            if a + whole < e and done < last:
                runs.append((n, done, last, a + whole, last - done, size - r))
                put(r - (last - done) * n, a + whole, a + whole + 1)
                done, whole = last, whole + 1
            put(r, a + whole, e)
    return runs, sorted((a, e, size - r) for r, own in enumerate(room) for a, e in own)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, part int, number long"


def _local(docs: DataFrame, vocab: str, end: int, size: int, with_ids: bool, leaf: int) -> DataFrame:
    """Every piece of docs, packed within its task; number: its bin's among the part's bins of that fill."""
    tail = np.array([end], "<u4").tobytes()
    out = _PIECE + ", ids array<int>" * with_ids

    def pack(doc, piece, start, ids, n, first, part, seen):
        length = np.array(n, np.int64)
        where, offset, fill = best_fit(length, size)
        order = np.argsort(fill, kind="stable")
        count = np.bincount(fill, minlength=size + 1)
        number = np.empty(len(fill), np.int64)
        number[order] = np.arange(len(fill)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
        seen += count
        crc = [zlib.crc32(x) for x in ids] if with_ids else ids
        cols = [
            pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()),
            pa.array(where + first), pa.array(offset), pa.array(fill[where]), pa.array(np.full(len(n), part), pa.int32()), pa.array(number[where]),
        ]
        if with_ids:
            cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
        names = [x.split()[0] for x in out.split(", ")]
        whole = pa.record_batch(cols, names)
        return len(fill), [whole.slice(i, 10_000) for i in range(0, len(n), 10_000)]

    def run(batches):
        c, part = word_coder(vocab), TaskContext.get().partitionId()
        first, seen = part << _PART, np.zeros(size + 1, np.int64)
        rows: list[list] = [[], [], [], [], []]
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                for doc, ids in zip(some.column("doc_id").to_pylist(), c.encode(some.column("text").to_pylist())):
                    ids += tail
                    for k in range(0, len(ids), 4 * size):
                        own = ids[k : k + 4 * size]
                        for to, x in zip(rows, (doc, k // (4 * size), k // 4, own if with_ids else zlib.crc32(own), len(own) // 4)):
                            to.append(x)
                if len(rows[0]) >= leaf:
                    made, got = pack(*rows, first, part, seen)
                    first, rows = first + made, [[], [], [], [], []]
                    yield from got
        if rows[0]:
            yield from pack(*rows, first, part, seen)[1]
        c.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).transform(by_arrow, run, out)


_PLAN = "part int, fill long, lo long, hi long, shift long, per long, bin long, at long, new_fill long, number long"


def _plan(counts: DataFrame, fan: int, size: int) -> DataFrame:
    """Where the items lo to hi of each part and fill go in the merge of their group: item k is the (k + shift)-th of a run
    that begins at `bin`, with `per` items a bin, the first at `at`; new_fill and number: the bin's fill, and the number
    of the run's first bin among the group's bins of that fill."""

    def run(t: pa.Table) -> pa.Table:
        part, fill, n = (t.column(c).to_numpy() for c in ("part", "fill", "n"))
        order = np.lexsort((part, fill))
        held: dict[int, list[tuple[int, int, int]]] = {}  # of each fill, its parts' ranges in the group
        for p, f, k in zip(part[order].tolist(), fill[order].tolist(), n[order].tolist()):
            own = held.setdefault(f, [])
            begin = own[-1][2] if own else 0
            own.append((p, begin, begin + k))
        runs, bins = merge_counts({f: own[-1][2] for f, own in held.items()}, size)
        starts, seen, named = [a for a, _, _ in bins], {}, []
        for a, e, f in bins:
            named.append(seen.get(f, 0))
            seen[f] = seen.get(f, 0) + e - a
        rows = []
        for f, a, e, first, per, at in runs:
            k = bisect_right(starts, first) - 1
            while k < len(bins) and bins[k][0] < first - (a - e) // per:
                x = max(bins[k][0], first)
                lo, hi = a + (x - first) * per, min(e, a + (bins[k][1] - first) * per)
                own = held[f]
                i = bisect_right(own, lo, key=lambda r: r[1]) - 1
                while i < len(own) and own[i][1] < hi:
                    p, u, v = own[i]
                    rows.append((p, f, max(lo, u) - u, min(hi, v) - u, u - lo, per, x, at, bins[k][2], named[k] + x - bins[k][0]))
                    i += 1
                k += 1
        cols = list(zip(*rows)) or [()] * 10
        kinds = [pa.int32(), *[pa.int64()] * 9]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds)], [x.split()[0] for x in _PLAN.split(", ")])

    return counts.withColumn("group", F.floor(F.col("part") / fan).cast("int")).groupBy("group").applyInArrow(run, _PLAN)


def _merge(items: DataFrame, level: int, fan: int, size: int) -> DataFrame:
    """bin, parent, at, new_fill, part (the group), number for each of the items (bin, fill, part, number)."""
    plan = shared(_plan(items.groupBy("part", "fill").agg(F.count("*").alias("n")), fan, size)).withColumnRenamed("bin", "to")
    named = plan.withColumnRenamed("number", "first")
    met = items.join(F.broadcast(named) if plan.count() <= PLAN_ROWS else named, ["part", "fill"]).where("number >= lo AND number < hi")
    k, group = F.col("number") + F.col("shift"), F.floor(F.col("part") / fan)
    step = F.expr("(number + shift) div per")
    parent = F.lit(level << _LEVEL) + group * F.lit(1 << _PART) + F.col("to") + step
    return met.select(
        "bin", parent.cast("long").alias("parent"), (F.col("at") + (k - step * F.col("per")) * F.col("fill")).cast("long").alias("at"),
        "new_fill", group.cast("int").alias("part"), (F.col("first") + step).cast("long").alias("number"),
    )


def pack(
    docs: DataFrame, vocab: str | None = None, end: int = 1, size: int = SIZE, fan: int = FAN, leaf: int = LEAF, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of docs (doc_id, text).

    A document is its ids and `end`; only one that is longer than `size` is cut, into pieces of that size. Rounds go on
    until one group is left, and every underfull bin takes part in every round. Null text: empty, one id; repeated rows:
    pieces of their own; extra columns are left out; an empty table gives an empty one."""
    if vocab is None:
        import public_tokenizers

        vocab = public_tokenizers.path("word_bpe_49k.json")
    full = NEARLY_FULL * size // SIZE
    pieces = shared(_local(docs, vocab, end, size, with_ids, leaf))
    # One row for each underfull bin: that of the piece at its start.
    items = pieces.where((F.col("offset") == 0) & (F.col("fill") < full)).select("bin", "fill", "part", "number")
    top = items.agg(F.max("part")).first()[0]
    rounds: list[DataFrame] = []
    while top is not None:
        top //= fan
        made = shared(_merge(items, len(rounds) + 1, fan, size))
        rounds.append(made)
        if not top:
            break
        items = made.where((F.col("at") == 0) & (F.col("new_fill") < full)).select(
            F.col("parent").alias("bin"), F.col("new_fill").alias("fill"), "part", "number"
        )
    moved = None
    for made in reversed(rounds):
        step = made.select("bin", "parent", "at")
        if moved is not None:
            up = moved.select(F.col("bin").alias("parent"), F.col("parent").alias("up"), F.col("at").alias("up_at"))
            step = step.join(up, "parent", "left").select(
                "bin", F.coalesce("up", "parent").alias("parent"), (F.col("at") + F.coalesce("up_at", F.lit(0))).alias("at")
            )
        moved = step
    ids = ["ids"] * with_ids
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset", *ids)
    found = pieces.join(moved, "bin", "left")
    return found.select(
        *columns, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"), *ids
    )


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
