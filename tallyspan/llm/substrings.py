"""Substring dedup by recompression: removal of words in windows of 13 that start in an earlier document.

Recompression shortens a word sequence in rounds: runs of one symbol become one symbol, then pairs (a, b) with a
coin of a = 0 and of b = 1 become one, and so on. A symbol's name is a 64-bit hash of what it replaces and
its coin a bit of that, so names agree over all documents without a dictionary. Where two documents have equal
words, they get equal symbols but for a few at the ends: what a symbol is depends on a known span of words, its
context, tracked through the rounds. A window that holds a symbol with its whole context holds it wherever
the window occurs. Each window takes one such symbol of the highest level there, by least name, as its anchor;
a window inside a long run has none, and is its own anchor.

Consecutive windows of one anchor are a segment, named by all words that they cover.

Spark rounds: (1) Each document emits its segments; those whose anchor is in no other document are dropped. (2) Equal
segments: all windows of one start in the smallest document that has it, so all others repeat them. (3) Where an anchor has different
segments, at the ends of common passages, the smallest document of each of these names its windows one by one by 128 bits
of their 13 words, and each name's first document is found. (4) Names only propose: what a document repeats of a smaller one is merged into long
repeats, cut at blocks of the smaller document's words, and these are compared word by word. (5) Each document drops the
words of the windows that are equal. A name that stands for two texts can so never remove a word; at worst, where 64 + 64 or 128 bits
collide, a repeat is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.llm.common import discard, fields, flat_map, id_type, map_rows, materialise

WINDOW = 13
ROUNDS = 2
#: Words that a symbol may stand for; longer ones would not fit into a window with their contexts.
LONGEST = 5
_B1, _B2, _B3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_FAR = np.int64(1) << np.int64(40)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Names(dict):
    """64-bit hash of a word, remembered; starts over when it grows large."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = self.hash(word)
        return got


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def recompress(w: np.ndarray, begins: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (name, context start, context end) by symbol, lowest first, for documents laid end to end.

    ``w`` has the names of all words, ``begins`` the place where each document begins; none is empty. Context
    ends are exclusive; a context that depends on an end of its document reaches far outside.
    """
    n = len(w)
    if not n:
        return []
    first = np.ones(n, bool)
    first[1:] = w[1:] != w[:-1]
    first[begins] = True
    start = np.nonzero(first)[0]
    end = np.append(start[1:], n)
    opens = np.zeros(n + 1, bool)
    opens[begins] = opens[n] = True
    head, tail = opens[start], opens[end]
    length = end - start
    name = _mix(w[start] + np.where(length > 1, length, 0).astype(np.uint64) * _B3)
    # A run ends where other words begin, so it depends on a word at either side.
    lo, hi = np.where(head, -_FAR, start - 1), np.where(tail, _FAR, end + 1)
    levels = [(name, lo, hi)]
    for r in range(rounds):
        m = len(name)
        coin = ((name >> np.uint64(7 + 11 * r)) & np.uint64(1)).astype(bool)
        left = np.zeros(m, bool)
        left[:-1] = ~coin[:-1] & coin[1:] & (length[:-1] + length[1:] <= LONGEST) & ~tail[:-1]
        right = np.zeros(m, bool)
        right[1:] = left[:-1]
        alone = ~left & ~right
        # A pair depends on both; one left alone on the neighbour that it could have been joined with.
        nlo, nhi = lo.copy(), hi.copy()
        on = left | (alone & ~coin)
        nhi[on & tail] = _FAR
        i = np.nonzero(on & ~tail)[0]
        nhi[i] = np.maximum(hi[i], hi[i + 1])
        nlo[i] = np.minimum(lo[i], lo[i + 1])
        on = alone & coin
        nlo[on & head] = -_FAR
        i = np.nonzero(on & ~head)[0]
        nlo[i] = np.minimum(lo[i], lo[i - 1])
        nhi[i] = np.maximum(hi[i], hi[i - 1])
        i = np.nonzero(left)[0]
        new, grown, ends = name.copy(), length.copy(), tail.copy()
        new[i] = _mix(name[i] * _B1 + name[i + 1] * _B2 + np.uint64(r + 1))
        grown[i] += length[i + 1]
        ends[i] = tail[i + 1]
        stay = ~right
        name, length, lo, hi, head, tail = new[stay], grown[stay], nlo[stay], nhi[stay], head[stay], ends[stay]
        levels.append((name, lo, hi))
    return levels


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(w: np.ndarray, begins: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows that lie in one document, and the hash of each one's anchor."""
    ends = np.append(begins[1:], len(w))
    room = np.zeros(len(w) + 1, np.int64)
    fit = np.maximum(ends - begins - window + 1, 0)
    room[begins] += 1
    room[begins + fit] -= 1
    inside = np.cumsum(room[:-1]) > 0
    n = len(w)
    out = np.zeros(n, np.uint64)
    open_ = inside.copy()
    total, back = _sums(w, _B1)
    for depth, (name, lo, hi) in reversed(list(enumerate(recompress(w, begins)))):
        use = (lo >= 0) & (hi <= n) & (hi - lo <= window)
        name, lo, hi = name[use], lo[use], hi[use]
        if not len(name):
            continue
        # Windows p with hi - window <= p <= lo hold the symbol and its context; of equal names the first counts.
        best = np.full(n, ~np.uint64(0))
        place = np.full(n, -1)
        for d in range(int((lo - hi).max()) + window + 1):
            i = np.nonzero((lo - d >= hi - window) & (lo >= d))[0]
            q = lo[i] - d
            better = (name[i] < best[q]) & open_[q]
            i, q = i[better], q[better]
            np.minimum.at(best, q, name[i])
            least = name[i] == best[q]
            place[q[least]] = i[least]
        take = open_ & (place >= 0)
        i = place[take]
        span = (total[hi[i]] - total[lo[i]]) * back[lo[i]]
        salt = np.uint64(int(_B2) * depth & 0xFFFFFFFFFFFFFFFF)
        out[take] = _mix(span + salt + (hi[i] - lo[i]).astype(np.uint64) * _B3)
        open_ &= ~take
        if not open_.any():
            break
    if open_.any():
        at = np.nonzero(open_)[0]
        out[at] = _ranges(w, at, at + window, _B2)
    at = np.nonzero(inside)[0]
    return at, out[at]


def _sums(w: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of word * base^place, and the inverse powers that move a difference of them to a common place."""
    total = np.zeros(len(w) + 1, np.uint64)
    np.add.accumulate(w * _powers(int(base), len(w) + 1)[:-1], out=total[1:])
    return total, _powers(pow(int(base), -1, 1 << 64), len(w) + 1)


def _ranges(w: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _B3) -> np.ndarray:
    """Hash of the words in each range."""
    total, back = _sums(w, base)
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _B2)


_SEGMENTS = {"anchor": "long", "whole": "long", "doc": "long", "th": "long", "pos": "int", "n": "int"}
_WINDOWS = {"x": "long", "y": "long", "doc": "long", "th": "long", "pos": "int"}
_REPEATS = {"doc": "long", "th": "long", "r": "int", "pos": "int", "n": "int", "low": "long", "lth": "long", "lpos": "int", "block": "int"}
_LATE = ["doc", "th", "pos", "n", "low", "lth", "lpos"]
#: Words of a block, the unit in which words of earlier documents are fetched for comparison.
BLOCK = 64
#: Words of documents that are handled at once; a larger document goes alone.
GROUP = 100_000


def _groups(texts: list[str | None], names: _Names, spans: list | None = None):
    """Lists of row numbers with words, and these rows' word names end to end with their beginnings.

    With ``spans``, for each text (start, end) places in order, only words within them are named; others are 0.
    """
    name = names.__getitem__
    rows, parts, n = [], [], 0
    for k, t in enumerate(texts):
        words = split_words(t)
        if not words:
            continue
        if rows and n + len(words) > GROUP:
            yield rows, np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])
            rows, parts, n = [], [], 0
        rows.append(k)
        if spans is None:
            parts.append(np.fromiter(map(name, words), np.uint64, len(words)))
        else:
            own, done = np.zeros(len(words), np.uint64), 0
            for a, b in spans[k]:
                if b > done:
                    a = max(a, done)
                    own[a:b] = np.fromiter(map(name, words[a:b]), np.uint64, b - a)
                    done = b
            parts.append(own)
        n += len(words)
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])


def repeats(docs: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, at array of (r, pos, n, lpos, block, words)), written: what each document repeats of smaller ones.

    Repeat r has n windows from word pos on that look like those from word lpos on in a smaller document; words are that
    document's in one block of BLOCK. Documents that repeat nothing have no row. Rows that share an id are one document, which
    can't repeat itself; rows with a null id take no part. Texts that are null or shorter than a window have no windows.
    """
    kind = id_type(docs, doc)
    segments, windows, found_repeats = (fields(**{k: kind if k in ("doc", "low") else v for k, v in x.items()}) for x in (_SEGMENTS, _WINDOWS, _REPEATS))
    numbers = np.int64 if isinstance(kind, T.LongType) else object
    src = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast(kind).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))

    def emit():
        names = _Names()

        def run(ids, ths, texts):
            cols: list[list] = [[] for _ in _SEGMENTS]
            ids, ths = np.array(ids, numbers), np.array(ths, np.int64)
            for rows, w, begins in _groups(texts, names):
                at, found = anchors(w, begins, window)
                if not len(at):
                    continue
                which = np.searchsorted(begins, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (which[1:] != which[:-1]) | (found[1:] != found[:-1])
                first = np.nonzero(new)[0]
                count = np.append(first[1:], len(at)) - first
                start, which = at[first], which[first]
                row = np.array(rows)[which]
                whole = _ranges(w, start, start + count + window - 1)
                for c, v in zip(cols, (found[first].view(np.int64), whole.view(np.int64), ids[row], ths[row], (start - begins[which]).astype(np.int32), count.astype(np.int32)), strict=True):
                    c.append(v)
            return [np.concatenate(c) if c else [] for c in cols]

        return run

    # The smallest document of a group and a place there; both are of one row, as they are chosen by one comparison.
    earliest = F.min("doc").alias("low"), F.max("doc").alias("high"), F.min_by("th", "doc").alias("lth"), F.min_by("pos", "doc").alias("lpos")
    found = materialise(flat_map(src, ["doc", "th", "text"], segments, emit), "segments")
    kinds = found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    # Written, so that the join reads both sides plainly and Spark can split the partition of a hot anchor.
    kinds = materialise(kinds.where("low <> high").select("anchor", (F.col("a") == F.col("b")).alias("same")), "shared-anchors")
    common = materialise(found.join(kinds, "anchor"), "shared-segments")
    discard(found, kinds)
    equal = materialise(common.groupBy("anchor", "whole").agg(*earliest), "equal-segments")
    judged = materialise(common.join(equal, ["anchor", "whole"]).where("low <> high or not same"), "judged-segments")
    discard(common, equal)
    # Segments of one document only.
    ranges = judged.where("not same and doc = low").groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "n")).alias("at"))
    right = ranges.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), F.col("at.pos").alias("first"), F.col("at.n").alias("count"))
    suspects = src.join(right, (F.col("doc") == F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc", "th", "text", "first", "count")

    def name():
        names = _Names()

        def run(ids, ths, texts, firsts, counts):
            cols: list[list] = [[] for _ in _WINDOWS]
            ids, ths = np.array(ids, numbers), np.array(ths, np.int64)
            spans = [sorted((a, a + n + window - 1) for a, n in zip(f, c, strict=True)) for f, c in zip(firsts, counts, strict=True)]
            for rows, w, begins in _groups(texts, names, spans):
                each = np.concatenate([np.array(counts[k], np.int64) for k in rows])
                start = np.concatenate([np.array(firsts[k], np.int64) + b for k, b in zip(rows, begins.tolist(), strict=True)])
                at = np.repeat(start, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                which = np.searchsorted(begins, at, "right") - 1
                row = np.array(rows)[which]
                x, y = _ranges(w, at, at + window, _B1), _ranges(w, at, at + window)
                for c, v in zip(cols, (x.view(np.int64), y.view(np.int64), ids[row], ths[row], (at - begins[which]).astype(np.int32)), strict=True):
                    c.append(v)
            return [np.concatenate(c) if c else [] for c in cols]

        return run

    wins = materialise(flat_map(suspects, ["doc", "th", "text", "first", "count"], windows, name), "windows")
    first = materialise(wins.groupBy("x", "y").agg(*earliest).where("low <> high"), "first-documents")
    late = [judged, wins.join(first, ["x", "y"]).withColumn("n", F.lit(1))]
    late = late[0].select(_LATE).where("doc > low").unionByName(late[1].select(_LATE).where("doc > low"))
    # Of one document only.
    by_doc = late.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "n", "low", "lth", "lpos")).alias("at"))
    by_doc = by_doc.select("doc", "th", *[F.col(f"at.{c}").alias(c) for c in ("pos", "n", "low", "lth", "lpos")])

    def merge():
        def run(ids, ths, *parts):
            out = [x for row in zip(ids, ths, *parts, strict=True) for x in _merged(*row, window)]
            return list(zip(*out, strict=True)) if out else [[] for _ in _REPEATS]

        return run

    long = materialise(flat_map(by_doc, _LATE, found_repeats, merge), "repeats")
    discard(judged, wins, first)
    # No more blocks than a document has.
    wanted = long.select("low", "lth", "block").distinct().groupBy("low", "lth").agg(F.collect_list("block").alias("blocks"))
    wanted = src.join(wanted, (F.col("doc") == F.col("low")) & (F.col("th") == F.col("lth"))).select("low", "lth", "text", "blocks")

    def cut():
        def run(lows, lths, texts, blocks):
            out = []
            for low, lth, t, bs in zip(lows, lths, texts, blocks, strict=True):
                words = split_words(t)
                out += [(low, lth, b, b" ".join(words[b * BLOCK : (b + 1) * BLOCK]).decode()) for b in bs]
            return list(zip(*out, strict=True)) if out else [[], [], [], []]

        return run

    words = flat_map(wanted, ["low", "lth", "text", "blocks"], fields(low=kind, lth="long", block="int", words="string"), cut).distinct()
    words = materialise(words, "earlier-words")
    # Words that a document repeats: no more than it has, but for the ends of blocks and repeats.
    got = long.join(words, ["low", "lth", "block"]).groupBy("doc", "th").agg(F.collect_list(F.struct("r", "pos", "n", "lpos", "block", "words")).alias("at"))
    got = materialise(got, "document-repeats")
    discard(long, words)
    return got


def _merged(doc, th, pos, n, low, lth, lpos, window):
    """Rows of _REPEATS: windows that follow each other in both documents as one repeat, once for each block that it touches."""
    out, runs = [], {}
    for k in sorted(range(len(pos)), key=pos.__getitem__):
        key = (low[k], lth[k], lpos[k] - pos[k])
        run = runs.get(key)
        if run is not None and pos[k] <= run[1]:
            run[1] = max(run[1], pos[k] + n[k])
        else:
            runs[key] = run = [pos[k], pos[k] + n[k]]
            out.append((key, run))
    rows = []
    for r, ((d, t, shift), (a, b)) in enumerate(out):
        for block in range((a + shift) // BLOCK, (b + shift + window - 2) // BLOCK + 1):
            rows.append((doc, th, r, a, b - a, d, t, a + shift, block))
    return rows


def _kept(text: str | None, at: list[dict] | None, window: int) -> tuple[list[bytes], int]:
    """The words that are left, and how many there were: each window is compared with that of the earlier document."""
    words = split_words(text)
    if not at:
        return words, len(words)
    starts = np.zeros(len(words) + 1, np.int64)
    wrong: dict[int, list[int]] = {}
    spans = {}
    for x in at:
        spans[x["r"]] = x["pos"], x["n"]
        theirs = x["words"].encode().split(b" ")
        first = x["block"] * BLOCK
        a, b = max(first, x["lpos"]), min(first + len(theirs), x["lpos"] + x["n"] + window - 1)
        shift = x["pos"] - x["lpos"]
        if words[a + shift : b + shift] != theirs[a - first : b - first]:
            wrong.setdefault(x["r"], []).extend(j + shift for j in range(a, b) if j + shift >= len(words) or words[j + shift] != theirs[j - first])
    for r, (pos, n) in spans.items():
        if r not in wrong:
            starts[pos] += 1
            starts[min(pos + n, len(words))] -= 1
            continue
        equal = np.ones(n, bool)
        for j in wrong[r]:
            equal[max(0, j - window + 1 - pos) : j + 1 - pos] = False
        for k in np.nonzero(equal)[0].tolist():
            starts[pos + k] += 1
            starts[pos + k + 1] -= 1
    at = np.nonzero(np.cumsum(starts)[:-1])[0]
    edge = np.zeros(len(words) + window + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    keep = (np.cumsum(edge)[: len(words)] == 0).tolist()
    return [w for w, k in zip(words, keep, strict=True) if k], len(words)


def dedup(docs: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 or kept_text) for every row of ``docs``; equal rows get equal results.

    Null and empty texts have no words; ids are whole numbers or texts, rows without one keep all. A very long text is held
    whole with its words. Only the two named columns are read, so others may have any name.
    """
    found = repeats(docs, window, doc, text)
    left = docs.select(F.col(doc).cast(id_type(docs, doc)).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    right = found.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), "at")
    j = left.join(right, (F.col("doc_id") == F.col("d2")) & (F.col("th") == F.col("t2")), "left")

    def make():
        def run(texts, marks):
            n, gone, kept = [], [], []
            for t, s in zip(texts, marks, strict=True):
                words, total = _kept(t, s, window)
                n.append(total)
                gone.append(total - len(words))
                joined = b" ".join(words)
                kept.append(joined.decode() if with_text else hashlib.sha256(joined).hexdigest())
            return n, gone, kept

        return run

    out = fields(n_words="long", n_removed="long", **{"kept_text" if with_text else "kept_sha256": "string"})
    return map_rows(j, ["doc_id"], ["text", "at"], out, make)
