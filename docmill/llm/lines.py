"""Line dedup: hashes range-partitioned, sorted by document and position, answered by per-document keep bitmaps.

Each task first looks at its own batch of documents (cut by bytes, so very long texts are batches of their own). A line key that is frequent in the batch alone is settled there and
sends one summary row; all others send their (hash, document, position) rows. So a line that a third of all documents
hold costs a few rows a batch, not one task. The rows are range-partitioned by hash, all rows of a hash in one range, and sorted
by hash, document and position; one pass counts the documents of each key and streams out the lines to drop, buffering fewer than ``min_docs``
documents. With ``keep_first`` the first line of a frequent key stays, by document (least id, no id last, then hash of the text) and
position; a batch that settles a key sends its own first line in the summary row, so the pass sees the first of all. Only positions travel back, packed as one compressed bitmap a document.

Null and empty texts hold one empty line. Keys shorter than ``min_chars`` code points never count. Every row is a
document of its own, also where doc_id repeats or is null or the whole row repeats; rows of one id and text lose the same lines, so
where one of them holds a first line, all do. Lines are kept in their order; there are no
ties to break. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import KEY, KEY_ARROW, batch, bounded, by_bytes, keyed, named, row_key, sliced, texts

_ROWS = "kind int, h1 long, h2 long, no boolean, rid long, th long, pos int, docs int"
_ROWS_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), *KEY_ARROW, ("pos", pa.int32()), ("docs", pa.int32())])
_DROPS_ARROW = pa.schema([*KEY_ARROW, ("pos", pa.int32())])
#: The range of hashes is cut into so many parts of one width as 2 to this power.
_RANGE_BITS = 16


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _line_rows(min_docs: int, min_chars: int, keep_first: bool):
    def rows(batches):
        for b in (part for whole in batches for part in by_bytes(whole, 3)):
            no, rid, th = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            seen: dict[bytes, list] = {}
            for i, text in enumerate(texts(b.column(3))):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
                        continue
                    if (e := seen.get(key)) is None:
                        seen[key] = [1, i, [i], [pos]]
                    else:
                        if e[1] != i:
                            e[0] += 1
                            e[1] = i
                        e[2].append(i)
                        e[3].append(pos)
            if not seen:
                continue
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, seen)), dtype="<i8").reshape(-1, 2)
            found = list(seen.values())
            n_docs = np.array([e[0] for e in found])
            n_rows = np.array([len(e[2]) for e in found])
            of = np.repeat(np.arange(len(found)), n_rows)
            doc = np.fromiter((x for e in found for x in e[2]), np.int64, len(of))
            pos = np.fromiter((x for e in found for x in e[3]), np.int32, len(of))
            first = np.ones(len(of), bool)
            first[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
            local = n_docs[of] >= min_docs
            hot = np.flatnonzero(n_docs >= min_docs)
            summary = [np.zeros(len(hot), bool), np.full(len(hot), -(2**63)), np.zeros(len(hot), np.int64), np.full(len(hot), -1, np.int32)]
            if keep_first and len(hot):
                # the first line of each settled key goes with its summary, not with the lines to drop
                order = np.lexsort((pos, th[doc], rid[doc], no[doc], of))
                at = order[np.searchsorted(of, np.arange(len(found)))]
                own = at[of]
                is_first = (no[doc] == no[doc[own]]) & (rid[doc] == rid[doc[own]]) & (th[doc] == th[doc[own]]) & (pos == pos[own])
                summary = [no[doc[at[hot]]], rid[doc[at[hot]]], th[doc[at[hot]]], pos[at[hot]]]
                stay = ~(local & is_first)
                of, doc, pos, first, local = of[stay], doc[stay], pos[stay], first[stay], local[stay]
            spread = np.where(local, rid[doc] * np.int64(-7046029254386353131) + pos, digest[of, 0])
            out = batch(
                _ROWS_ARROW,
                np.concatenate([local.astype(np.int32), np.zeros(len(hot), np.int32)]),
                np.concatenate([spread, digest[hot, 0]]),
                np.concatenate([digest[of, 1], digest[hot, 1]]),
                *(np.concatenate(pair) for pair in zip((no[doc], rid[doc], th[doc], pos), summary)),
                np.concatenate([first.astype(np.int32), n_docs[hot].astype(np.int32)]),
            )
            yield from sliced(out)

    return rows


def _stream_drops(min_docs: int, keep_first: bool):
    """Rows come sorted by kind, hash, document and position. An open run is buffered only until it reaches min_docs."""

    def drops(batches):
        open_key, open_docs, open_head, held = None, 0, None, []
        for b in batches:
            kind, h1, h2, no, rid, th, pos, docs = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            n = len(h1)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (kind[1:] != kind[:-1])
            starts = np.flatnonzero(new)
            total = np.add.reduceat(docs.astype(np.int64), starts)
            heads = [c[starts].copy() for c in (no, rid, th, pos)]
            if open_key == (kind[0], h1[0], h2[0]):
                total[0] += open_docs
                for column, value in zip(heads, open_head):
                    column[0] = value
            else:
                held = []
            run = np.cumsum(new) - 1
            may_go = pos >= 0
            if keep_first:
                is_head = np.logical_and.reduce([c == head[run] for c, head in zip((no, rid, th, pos), heads)])
                may_go &= ~is_head | (kind == 1)
            drop = ((total[run] >= min_docs) | (kind == 1)) & may_go
            if held and total[0] >= min_docs:
                for part in held:
                    yield part
                held = []
            if drop.any():
                yield batch(_DROPS_ARROW, no[drop], rid[drop], th[drop], pos[drop])
            last = starts[-1]
            if len(starts) > 1:
                held = []
            open_key, open_docs, open_head = (kind[-1], h1[-1], h2[-1]), total[-1], [head[-1] for head in heads]
            if open_docs < min_docs and kind[-1] == 0:
                keep = np.flatnonzero(may_go[last:]) + last
                if len(keep):
                    held.append(batch(_DROPS_ARROW, no[keep], rid[keep], th[keep], pos[keep]))

    return drops


def _pack(batches):
    schema = pa.schema([*KEY_ARROW, ("n_dropped", pa.int64()), ("keep", pa.binary())])
    for b in batches:
        packed, counts = [], []
        for positions in b.column(3).to_pylist():
            bits = np.ones(-(-(max(positions) + 1) // 8) * 8, bool)
            bits[positions] = False
            packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            counts.append(len(positions))
        yield batch(schema, *b.columns[:3], counts, packed)


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(__no, __rid, __th, n_dropped, keep) for each document that loses lines. keep: zlib of one bit a line, low bit first,
    1 for a line that stays; lines past its last bit stay."""
    rows = keyed(docs).select(*KEY, "text").mapInArrow(_line_rows(min_docs, max(1, min_chars), keep_first), _ROWS)
    rows = rows.withColumn("range", F.shiftrightunsigned("h1", 64 - _RANGE_BITS)).repartition("range").sortWithinPartitions("kind", "h1", "h2", "no", "rid", "th", "pos")
    drops = rows.drop("range").mapInArrow(_stream_drops(min_docs, keep_first), "no boolean, rid long, th long, pos int")
    dropped = drops.groupBy("no", "rid", "th").agg(F.collect_set("pos").alias("pos"))
    return dropped.mapInArrow(_pack, "no boolean, rid long, th long, n_dropped long, keep binary").withColumnsRenamed(dict(zip(("no", "rid", "th"), KEY)))


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """What stays of a text, its number of lines, and how many go."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)].tolist()
    stay = [line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for b in (part for whole in batches for part in by_bytes(whole, 1)):
        done = [kept_lines(t, k) for t, k in zip(texts(b.column(1)), b.column(2).to_pylist())]
        yield batch(schema, b.column(0), [x[1] for x in done], [x[2] for x in done], [hashlib.sha256(x[0]).hexdigest() for x in done])


def line_dedup_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256."""
    maps = line_keep_bitmaps(docs, min_docs, min_chars)
    joined = keyed(docs).join(maps.hint("merge"), list(KEY), "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs, all columns, with the frequent lines taken out of text, but for the first of each with keep_first. A text that loses no line
    stays as it is, null included."""
    maps = line_keep_bitmaps(docs, min_docs, min_chars, keep_first).select(*KEY, "keep")
    rest = F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("__rest")
    rows = bounded(docs).select(*row_key(), F.col("text").cast("string").alias("__text"), rest).join(maps.hint("merge"), list(KEY), "left").select("__text", "keep", "__rest")

    def apply(batches):
        for b in (part for whole in batches for part in by_bytes(whole, 0)):
            old, keep = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()
            new = [t if k is None else kept_lines(t or b"", k)[0] for t, k in zip(old, keep)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()).cast(pa.string()), b.column(2)], names=["__text", "__rest"])

    done = rows.mapInArrow(apply, rows.drop("keep").schema)
    kind = docs.schema["text"].dataType
    return done.select(*[F.col("__text").cast(kind).alias(c) if c == "text" else F.col("__rest")[c].alias(c) for c in docs.columns])
