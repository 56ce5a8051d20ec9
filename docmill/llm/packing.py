"""Harmonic packing of tokenized documents into fixed-length sequences.

A document is its token ids and one end id. It is cut into full sequences, then into halves, quarters and so on down to
``least`` ids, and a rest shorter than that. A piece of length n belongs to the reciprocal-capacity class floor(capacity/n):
so many pieces fill one of its sequences. Each task fills the sequences of every class on its own, with that fixed number of
pieces; ids need no shuffle. The pieces of sequences that a task could not fill are counted by task and class, take a place
in their class from running sums over these counts, and fill sequences across tasks in the same way. What is left then is
less than one sequence for each class, a number of pieces that does not depend on the input (at most the sum of all class
capacities); one group packs it first-fit, longest first.

Padding is below 1/least of the rest pieces' share plus one or two sequences in all. Null and empty texts hold the end id only. Rows that
repeat, or share a doc_id, are packed each on its own; pieces of one length need no order among themselves. A very long text is a
batch of its own. An empty table gives no sequence. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import batch, by_bytes, sliced, stored

#: Words whose ids a task keeps, and the longest of them: together a bound in bytes.
_CACHED_WORDS = 150_000
_CACHED_LENGTH = 64
_PIECES = "task long, cls int, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
_PIECES_ARROW = pa.schema([(n, pa.int32() if n == "cls" else pa.int64()) for n in ("task", "cls", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Sequence ids of a task's own sequences are task * 2**_TASK_BITS + n; later ones have the top bits below.
_TASK_BITS = 36
_ACROSS, _LAST = 1 << 61, 1 << 62


class _Odd(Exception):
    """A word that does not stand on its own."""


class Words(dict):
    """Token ids of a word with the space before it, as little-endian bytes. A text falls apart into these before each space that stands before
    anything but white space: the tokenizer's pattern always starts anew there."""

    def __init__(self, tokenizer, ranks):
        super().__init__()
        self.tokenizer, self.ranks = tokenizer, ranks

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or "<|" in word:
            raise _Odd
        ids = self.encode(" " + word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # the same vocabulary as ranks is faster on short plain words (the tests prove equal ids over the vocabulary and the words of a
        # table); anything else goes to the tokenizer itself
        ids = self.ranks.encode_ordinary(text) if self.ranks is not None and len(text) < 64 and max(text) < "\u0250" and "<|" not in text else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def document(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if "<|" in first:
                raise _Odd
            return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))
        except _Odd:  # runs of white space, a space at the end, or a special token: the text as a whole
            return self.encode(text)


@lru_cache(maxsize=2)
def tokenizer_words(name: str, ranks_name: str | None) -> Words:
    import public_tokenizers
    from tokenizers import Tokenizer

    ranks = None
    if ranks_name:
        import tiktoken

        with open(public_tokenizers.path(ranks_name), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = tiktoken.Encoding(ranks_name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Words(Tokenizer.from_file(public_tokenizers.path(name)), ranks)


def cut_lengths(tokens: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document: full sequences, halves of them down to least, a rest."""
    full, rest = divmod(tokens, capacity)
    out, part = [capacity] * full, capacity
    while part > least:
        part //= 2
        if rest >= part:
            out.append(part)
            rest -= part
    return out + [rest] * (rest > 0)


def pack_pieces(capacity: int, least: int, end_id: int, name: str, ranks_name: str | None):
    def pieces(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        words = tokenizer_words(name, ranks_name)
        end = np.array([end_id], "<u4").tobytes()
        waiting: dict[int, list[tuple]] = {}
        sequence = 0
        for b in (part for whole in batches for part in by_bytes(whole, 1, 2 << 20)):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(words.document(text or "") + end)
                tokens, start = len(ids) // 4, 0
                for n in cut_lengths(tokens, capacity, least):
                    piece = (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens)
                    start += n
                    cls = capacity // n
                    bin_ = waiting.setdefault(cls, [])
                    bin_.append(piece)
                    if len(bin_) == cls:
                        offset = 0
                        for p in bin_:
                            rows.append((task, cls, None, *p, (task << _TASK_BITS) + sequence, offset))
                            offset += p[2]
                        sequence += 1
                        waiting[cls] = []
            if rows:
                yield from sliced(batch(_PIECES_ARROW, *map(list, zip(*rows))))
        rows = [(task, cls, i, *p, None, None) for cls, bin_ in waiting.items() for i, p in enumerate(bin_)]
        if rows:
            yield batch(_PIECES_ARROW, *map(list, zip(*rows)))

    return pieces


def first_fit(capacity: int):
    """Packs one bounded group: longest pieces first, each into the first sequence with room."""

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(_OUT[:5]).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        used: list[int] = []
        for r in rows:
            at = next((i for i, n in enumerate(used) if n + r["length"] <= capacity), None)
            if at is None:
                at = len(used)
                used.append(0)
            r["sequence_id"], r["offset"] = _LAST + at, used[at]
            used[at] += r["length"]
        return pa.Table.from_pylist(rows, schema=pa.schema([(n, pa.int64()) for n in _OUT]))

    return pack


def harmonic_pack(docs: DataFrame, capacity: int = 2048, least: int = 64, end_id: int = 1, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(rows.mapInArrow(pack_pieces(capacity, least, end_id, tokenizer, ranks), _PIECES), "pieces")
    placed = pieces.where("sequence_id is not null").select(*_OUT)
    waiting = pieces.where("sequence_id is null").drop("sequence_id", "offset")
    counts = waiting.groupBy("cls", "task").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cls", "task", start.alias("before"), F.sum("n").over(Window.partitionBy("cls")).alias("all"))
    ranked = waiting.join(counts.hint("merge"), ["cls", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # classes are at most capacity; a class's sequences get ids of their own
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("cls")).cast("long")).withColumn("full", (F.col("bin") + 1) * F.col("cls") <= F.col("all"))
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("cls", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = stored(ranked.withColumn("sequence_id", F.lit(_ACROSS) + F.col("cls").cast("long") * F.lit(1 << 40) + F.col("bin")).withColumn("offset", offset), "waiting")
    across = ranked.where("full").select(*_OUT)
    last = ranked.where("not full").groupBy(F.lit(0).alias("__one")).applyInArrow(first_fit(capacity), ", ".join(f"`{n}` long" for n in _OUT))
    return placed.unionByName(across).unionByName(last)
