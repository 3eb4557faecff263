"""Chat formatting by columnar byte assembly: segment lengths, running offsets and scatter indices in numpy, headers and
contents copied into one preallocated Arrow buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table

#: A turn is PRE role MID content END. Inside roles and contents a backslash behind the first bracket keeps a control
#: string apart; one more is put where there are some already, so that taking one away gives the text back.
PRE, MID, END = b"<s>[INST] ", b" [/INST]", b"</s>"
_ESC, _UNESC = r"([<\[])(\\*)(/?(?:s>|INST\]))", re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_BLOCK = 4 << 20
#: Bytes of conversations in an output batch, unless one alone has more; offsets of 32 bits reach twice as far.
_BATCH = 1 << 30


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESC, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESC.sub(r"\1\2\3", text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins (one more at the end)."""
    flat = pa.concat_arrays([texts.cast(pa.large_string())])
    at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)
    data = flat.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def _scatter(to: np.ndarray, begin: np.ndarray, src: np.ndarray, at: np.ndarray) -> None:
    """Copies text i, src[at[i]:at[i+1]], to to[begin[i]:], by index arrays over blocks of a bounded size."""
    n, i = len(begin), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
        j = min(j, n)
        if j == i + 1:
            to[begin[i] : begin[i] + at[j] - at[i]] = src[at[i] : at[j]]
        else:
            lens = np.diff(at[i : j + 1])
            to[np.repeat(begin[i:j] - at[i:j], lens) + np.arange(at[i], at[j])] = src[at[i] : at[j]]
        i = j


def assemble(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """conv_id, formatted, and the loss mask as byte spans in it, from whole conversations in order (conv_id, role, text), in
    batches of a bounded size that share one buffer. One conversation of 2 GiB or more is no string, and an error."""
    col = lambda c, kind: pa.concat_arrays(rows.column(c).cast(kind).chunks)
    ids, roles, texts = col("conv_id", pa.int64()), col("role", pa.large_string()), col("text", pa.large_string())
    role, role_at = _bytes(escape(roles))
    text, text_at = _bytes(escape(texts))
    n = rows.num_rows
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 2], lens[:, 4] = len(PRE), len(MID), len(END)
    lens[:, 1], lens[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lens.ravel()).reshape(n, 5)
    begin = ends - lens
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, const in ((0, PRE), (2, MID), (4, END)):
        out[begin[:, k, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    _scatter(out, begin[:, 1], role, role_at)
    _scatter(out, begin[:, 3], text, text_at)
    value, gone = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (gone[1:] != gone[:-1])])
    starts = begin[first, 0]
    ends_at = np.r_[starts[1:], len(out)]
    loss = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False).astype(bool)
    conv = np.searchsorted(first, np.arange(n), "right") - 1
    per = np.r_[0, np.cumsum(np.bincount(conv[loss], minlength=len(first)))]
    spans = [x[loss, 3] - starts[conv[loss]] for x in (begin, ends)]
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends_at, starts[i] + _BATCH, "right")))
        offsets = np.r_[starts[i:j], ends_at[j - 1]] - starts[i]
        if offsets[-1] >= 1 << 31:
            raise ValueError(f"a formatted conversation has {offsets[-1]} bytes; a string holds less than 2 GiB")
        formatted = pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[starts[i] : ends_at[j - 1]]))
        mask = [pa.ListArray.from_arrays(pa.array((per[i : j + 1] - per[i]).astype(np.int32)), pa.array(x[per[i] : per[j]])) for x in spans]
        yield pa.record_batch([ids.take(pa.array(first[i:j])), formatted, *mask], ["conv_id", "formatted", "loss_from", "loss_to"])
        i = j


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_from and loss_to array<long> (byte spans of the assistant's contents) for each
    conversation of rows (conv_id, turn, role, text).

    Turns are in order of turn, then role, then text, so ties have a defined order and repeated rows are turns of their
    own. Null role or text: empty; null conv_id: a conversation of its own; an empty text: an empty turn; extra columns
    are left out; an empty table gives an empty one. A conversation is one output cell, so its rows meet in one task; only
    one conversation at a time is held beside the current batch."""
    col = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    parted = rows.select(
        F.col("conv_id").cast("long"), "turn", col("role"), col("text")
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(["conv_id", "role", "text"])
            ids = b.column(0)
            last = ids[-1]
            before = pc.index(pc.is_valid(ids), True).as_py() if not last.is_valid else None
            if last.is_valid:
                cut = pc.index(ids, last).as_py()
            else:
                cut = 0 if before == -1 else b.num_rows  # nulls sort first, so a null at the end means nulls only
            if held and cut == 0 and held[-1].column(0)[-1] == last and held[-1].column(0)[-1].is_valid == last.is_valid:
                held.append(b)
                continue
            if held and cut == 0:
                yield from assemble(pa.Table.from_batches(held))
                held = [b]
                continue
            yield from assemble(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield from assemble(pa.Table.from_batches(held))

    return parted.transform(by_arrow, run, "conv_id long, formatted string, loss_from array<long>, loss_to array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of each formatted conversation, taken from the output alone."""

    def run(batches):
        for b in batches:
            out = []
            for conv, text, a, e in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
                raw = text.encode()
                loss = "".join(unescape(raw[x:y].decode()) for x, y in zip(a, e))
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch(
                [pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return formatted.transform(
        by_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
