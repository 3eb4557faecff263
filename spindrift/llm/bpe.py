"""Byte-level BPE by overlapping chunks: chunks of long texts are pre-tokenised apart from each other, stitched at the
first pre-token boundary that both neighbours see, and the pieces are encoded; decoding concatenates raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table

CHUNK, OVERLAP = 65_536, 2_048
#: Texts, and chunks, whose ids are Python objects at one time.
ROWS, CHUNKS = 64, 8


class Coder:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, vocab: str, pattern: str):
        import regex
        import tiktoken

        with open(vocab, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pat = regex.compile(pattern)

    def bounds(self, text: str) -> list[int]:
        """Ends of the pre-tokens that don't end in white space. Cutting a text there leaves every match as it was:
        only a run of white space looks past its own end."""
        return [e for m in self.pat.finditer(text) if not text[(e := m.end()) - 1].isspace()]

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.enc.decode_bytes(ids)

    def sync(self, piece: str, chunk: int) -> int | None:
        """Where a chunk and the one that starts at `chunk` agree on a boundary, as seen in the chunk's own text. The
        last two boundaries of the text are left out: what follows could still change them."""
        own = set(self.bounds(piece)[:-2])
        fresh = [chunk + b for b in self.bounds(piece[chunk:])[:-2]]
        return next((b for b in fresh if b in own), None)

    def chunk(self, piece: str, k: int, last: bool, chunk: int, overlap: int) -> tuple[int | None, list[int], list[list[int]]]:
        """The sync point behind the chunk (relative; None: none found, or the text ends), the boundaries in its head
        and, for each stretch between them, its ids; the last stretch ends at the sync point or at the text's end."""
        end = len(piece) if last else self.sync(piece, chunk)
        if end is None:
            return None, [], []
        heads = [b for b in self.bounds(piece[: overlap + 256]) if b <= overlap and b < end] if k else []
        cuts = [0, *heads, end]
        return (None if last else end), heads, [self.encode(piece[a:b]) for a, b in zip(cuts, cuts[1:])]


def stitch(coder: Coder, rows: list[tuple[int, str, int | None, list[int], list[list[int]]]], chunk: int) -> list[int]:
    """Ids of one text from its chunks (k, its text without the overlap, sync, heads, ids), in order of k. A chunk that
    found no sync point, or a boundary that its neighbour doesn't have, makes the whole text be encoded at once."""
    ids: list[int] = []
    start = 0  # in this chunk, where the chunk before it stopped
    for i, (_, _, sync, heads, parts) in enumerate(rows):
        last = i == len(rows) - 1
        if not parts or (i and start not in heads):
            return coder.encode("".join(r[1] for r in rows))
        for part in parts[heads.index(start) + 1 if i else 0 :]:
            ids += part
        if not last:
            start = sync - chunk
    return ids


@functools.lru_cache(2)
def coder(vocab: str, pattern: str) -> Coder:
    return Coder(vocab, pattern)


def _where(vocab: str | None, pattern: str | None) -> tuple[str, str]:
    if vocab is None or pattern is None:
        import public_tokenizers

        vocab, pattern = vocab or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return vocab, pattern


def encode(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text).

    Texts of up to `chunk` code points are encoded where they lie. Longer ones become chunk rows with an overlap, which
    are dealt over the cluster, pre-tokenised and encoded apart, and stitched: one text's ids meet in one task, texts
    don't. Null text: empty, no ids; repeated rows: one result each; extra columns are left out; an empty table gives an
    empty one."""
    where = _where(vocab, pattern)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = "doc_id long, ids array<int>"

    def whole(batches):
        c = coder(*where)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = b.slice(at, ROWS)
                ids = [c.encode(t) for t in own.column("text").to_pylist()]
                yield pa.record_batch([own.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def pieces(batches):
        c = coder(*where)
        for b in batches:
            for at in range(0, b.num_rows, CHUNKS):
                own = b.slice(at, CHUNKS)
                piece, k, last = (own.column(x).to_pylist() for x in ("piece", "k", "last"))
                got = [c.chunk(t, i, x, chunk, overlap) for t, i, x in zip(piece, k, last)]
                sync, heads, parts = ([g[x] for g in got] for x in range(3))
                yield pa.record_batch(
                    [
                        own.column("row"), own.column("doc_id").cast(pa.int64()), own.column("k"), pa.array([t[:chunk] for t in piece], pa.string()),
                        pa.array(sync, pa.int32()), pa.array(heads, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.list_(pa.int32())))
                    ],
                    ["row", "doc_id", "k", "piece", "sync", "heads", "parts"],
                )

    def one(t: pa.Table) -> pa.Table:
        r = sorted(t.to_pylist(), key=lambda x: x["k"])
        ids = stitch(coder(*where), [(x["k"], x["piece"], x["sync"], x["heads"], x["parts"]) for x in r], chunk)
        return pa.table({"doc_id": pa.array([r[0]["doc_id"]], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    short = rows.where(F.length("text") <= chunk).transform(by_arrow, whole, out)
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    long = (
        rows.where(F.length("text") > chunk)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("n", n)
        .select("row", "doc_id", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .select(
            "row", "doc_id", "k", (F.col("k") == F.col("n") - 1).alias("last"),
            F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("piece")
        )
        .repartition("row", "k")
        .transform(by_arrow, pieces, "row long, doc_id long, k int, piece string, sync int, heads array<int>, parts array<array<int>>")
        .groupBy("row")
        .applyInArrow(one, out)
    )
    return short.unionByName(long)


def digests(encoded: DataFrame, vocab: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of encode(): the number of ids, the digest of the ids and that of the bytes they decode to."""
    where = _where(vocab, pattern)

    def run(batches):
        c, dec = coder(*where), [str(i) for i in range(1 << 17)]
        for b in batches:
            n, sha, back = [], [], []
            for x in b.column("ids"):
                ids = x.values.to_numpy().tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join([dec[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return encoded.transform(by_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
