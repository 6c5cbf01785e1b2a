"""Line dedup: hashes of lines, dealt by ranges and sorted, are streamed once; the result is a bitmap a document.

1. Each document gives one row for each different long line: a 128-bit hash of its key and its positions.
2. The rows are dealt by ranges of (hash, document descending) and sorted. A task streams its rows: the first
   document of a hash is its keeper, the following ones lose the line once enough documents are seen.
   A hot hash may spread over several tasks. A task's first hash may have begun earlier and its last may go on,
   so those rows are left open and settled by sums over at most two hashes a task.
3. Dropped positions are gathered by document into a compressed keep bitmap. No text is shuffled for that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyspan.llm.common import discard, fields, flat_map, id_type, map_rows, materialise

BLANKS = " \t\n\r\x0b\x0c"
#: A line row; n_lines is set only in the one row that each document has for itself.
_LINES = {"hi": "long", "lo": "long", "doc": "long", "th": "long", "pos": "binary", "n_lines": "long"}
_SEEN = {"kind": "int", "hi": "long", "lo": "long", "doc": "long", "th": "long", "pos": "binary", "part": "long"}
DROP, OPEN = 0, 1


def _line_rows(min_chars: int):
    import xxhash

    def run(docs, ths, texts):
        out: list[list] = [[] for _ in _LINES]
        for doc, th, text in zip(docs, ths, texts, strict=True):
            lines = (text or "").split("\n")
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(lines):
                if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                    found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
            for h, pos in found.items():
                row = (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), doc, th, np.array(pos, "<i4").tobytes(), None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            for c, v in zip(out, (None, None, doc, th, None, len(lines)), strict=True):
                c.append(v)
        return out

    return run


def _stream(min_docs: int, seen: T.StructType):
    names, types = seen.names, [to_arrow_type(f.dataType) for f in seen.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, first, docs, last, waiting = None, True, 0, None, []

        def flush(least: int):
            if len(out) >= least and out:
                cols = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            for hi, lo, doc, th, pos in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (hi, lo) != key:
                    if key is not None:
                        first = False
                    key, docs, last, waiting = (hi, lo), 0, None, []
                new = not docs or doc != last
                docs, last = docs + new, doc
                if first:
                    out.append((OPEN, hi, lo, doc, th, pos, int(new)))
                elif docs >= min_docs:
                    out.extend((DROP, None, None, d, h, p, 0) for d, h, p in waiting)
                    waiting = []
                    out.append((DROP, None, None, doc, th, pos, 0))
                elif docs > 1:
                    waiting.append((doc, th, pos))
                if docs == 1 and new:
                    keeper = doc
            yield from flush(20_000)
        if key is not None and not first:
            # The last hash may go on in the next task: its documents so far, its keeper and what is undecided.
            out.append((OPEN, *key, keeper, None, None, docs))
            out.extend((OPEN, *key, d, h, p, 0) for d, h, p in waiting)
        yield from flush(1)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, n_lines, n_dropped, bitmap), written: for every different (id, text hash) of ``docs`` its kept lines.

    bitmap is zlib-compressed, a bit a line, 1 for kept. A line's key is the line without ASCII white space at
    both ends, A-Z in lower case. Keys of ``min_chars`` code points or more found in ``min_docs`` documents or
    more are dropped everywhere but in the largest id that holds them; all lines there stay. Null and empty
    texts are one empty line, which stays. Rows that share an id are one document for the count; a null id
    is one document, smaller than all others. Equal rows get the same bitmap. Ids are whole numbers or texts. A very long
    text is held whole with its lines while they are hashed. Only the two named columns are read, so others may have any name.
    """
    kind = id_type(docs, doc)
    rows, marks = (fields(**(x | {"doc": kind})) for x in (_LINES, _SEEN))
    src = docs.select(F.col(doc).cast(kind).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    lines = materialise(flat_map(src, ["doc", "th", "text"], rows, lambda: _line_rows(min_chars)), "lines")
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        lines.where("n_lines is null").select("hi", "lo", "doc", "th", "pos")
        .repartitionByRange(n, F.col("hi"), F.col("lo"), F.col("doc").desc_nulls_last())
        .sortWithinPartitions(F.col("hi"), F.col("lo"), F.col("doc").desc_nulls_last(), F.col("th"))
    )
    seen = materialise(dealt.mapInArrow(_stream(min_docs, marks), marks), "seen")
    opened = seen.where(F.col("kind") == OPEN)
    # At most two hashes for each of the n tasks above.
    settled = opened.groupBy("hi", "lo").agg(F.sum("part").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)
    late = opened.where("pos is not null").join(F.broadcast(settled), ["hi", "lo"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    drops = seen.where(F.col("kind") == DROP).select("doc", "th", "pos").unionByName(late.select("doc", "th", "pos"))
    # Positions of one document only; equal rows repeat them, which the bitmap absorbs.
    by_doc = drops.groupBy("doc", "th").agg(F.collect_list("pos").alias("gone"))
    every = lines.where("n_lines is not null").groupBy("doc", "th").agg(F.max("n_lines").alias("n_lines"))
    joined = every.join(by_doc, every.doc.eqNullSafe(by_doc.doc) & every.th.eqNullSafe(by_doc.th), "left").select(every.doc, every.th, "n_lines", "gone")

    def make():
        def run(counts, gone):
            dropped, maps = [], []
            for n, g in zip(counts, gone, strict=True):
                keep = np.ones(n, bool)
                for p in g or ():
                    keep[np.frombuffer(p, "<i4")] = False
                dropped.append(int(n - keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            return dropped, maps

        return run

    out = materialise(map_rows(joined, ["doc", "th", "n_lines"], ["n_lines", "gone"], fields(n_dropped="long", bitmap="binary"), make), "bitmaps")
    discard(lines, seen)
    return out


def kept_lines(text: str | None, bitmap: bytes) -> str:
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc: str, text: str) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with their text and bitmap."""
    left = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"), F.col(doc).cast(id_type(docs, doc)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    right = bitmaps.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), "n_lines", "n_dropped", "bitmap")
    return left.join(right, F.col("doc").eqNullSafe(F.col("d2")) & F.col("th").eqNullSafe(F.col("t2")))


def digests(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""
    j = _with_bitmaps(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), bitmaps, "doc_id", "text")

    def make():
        return lambda texts, maps: [[hashlib.sha256(kept_lines(t, b).encode()).hexdigest() for t, b in zip(texts, maps, strict=True)]]

    return map_rows(j.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", "text", "bitmap"), ["doc_id", "n_lines", "n_dropped"], ["text", "bitmap"], fields(kept_sha256="string"), make)


def apply(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each text reduced to its kept lines; a null text stays null. Other columns are unchanged."""
    j = _with_bitmaps(docs, bitmaps, doc, text)

    def make():
        return lambda texts, maps: [[None if t is None else kept_lines(t, b) for t, b in zip(texts, maps, strict=True)]]

    done = map_rows(j, ["row"], ["text", "bitmap"], fields(new_text="string"), make)
    return done.select(*[F.col("new_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
