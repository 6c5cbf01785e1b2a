"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at 3 or fewer differing bits are linked; equal ones are one node. Half of the radius is one flip, and
one flip from either end meets only at two bits. So the word is cut in thirds: leaving out one of them leaves two or
fewer of three bits in the others. For each third left out, a fingerprint emits the rest of its bits and all
variants of these at one flip: 132 rows. Those shuffled to one variant are candidates; they are verified.

A group of up to PAIRED fingerprints compares its members. The members of larger groups, which only dense
clusters of near copies make, go another exact way, in which no pairs are compared: variants of the whole
word. A fingerprint with an even number of set bits emits itself and its variants at one flip; an odd one
also those at two. At distance 1 or 3 one end is even and the other odd, so 1 + 2 flips meet; at distance 2 both
ends meet halfway. Of three flipped bits two lie in the same half of the word, so pairs of flips need not
cross the halves. All members of such a group at one flip or less and any other member are within three bits, so one
edge a member to the smallest of the former keeps all links. Members at two flips that only meet each
other are linked through another variant if at all. Such a group has at most 1 + 64 + 992 members.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import connected_components, discard, fields, map_rows, materialise

RADIUS = 3


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash, signed: a bit is set if it is set in over half the shingles' XXH64 (seed 42)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        values = [h(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: n - width + 1].tolist()
        values = [h(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(values), 65536):
        part = np.array(values[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; words are split at ASCII white space, A-Z lower-cased; null: fp 0."""
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(src, ["doc_id"], ["text"], fields(fp="long"), lambda: lambda texts: [[fingerprint(t, width) for t in texts]])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ONE = [_signed(1 << i) for i in range(64)]
_TWO = [_signed(1 << i | 1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]


def _longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


#: Members up to which a group of candidates compares each with each. It sets the cost only: both ways give edges that
#: join the same components, as shown above, and a test runs either of them.
PAIRED = 32
_THIRDS = ((0, 21), (21, 43), (43, 64))


def _cuts():
    """(out, flips): for each third, its bits, and no flip or one of the others."""
    for a, b in _THIRDS:
        yield _signed((1 << b) - (1 << a)), [0, *[_signed(1 << i) for i in range(64) if not a <= i < b]]


def _exploded(df: DataFrame, flips: bool) -> DataFrame:
    """``df`` once for each third, as column out, and with ``flips`` for each flip outside of it."""
    pair = lambda out, flip: F.struct(F.lit(out).cast("long").alias("out"), F.lit(flip).cast("long").alias("flip"))
    made = [pair(out, flip) for out, all_flips in _cuts() for flip in (all_flips if flips else [0])]
    return df.select("*", F.explode(F.array(*made)).alias("v")).select(*df.columns, "v.*")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each third left out, here set to ones, the rest and its variants at one flip."""
    return _exploded(fps, True).select(F.col("fp").bitwiseOR(F.col("out")).bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _members(fps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, fp, n) for few keys (key, n): the ball is put around the keys, so each fingerprint is dealt thrice only."""
    centres = _exploded(keys, True).where(F.col("key").bitwiseAND(F.col("out")) == F.col("out")).select(F.col("key").bitwiseXOR(F.col("flip")).alias("at"), "key", "n")
    plain = _exploded(fps, False).select(F.col("fp").bitwiseOR(F.col("out")).alias("at"), "fp")
    return plain.join(centres, "at").select("key", "fp", "n").distinct()


def _close(a, b):
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), written, between different fingerprints ``fp`` (each there once) that join all within three bits."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = _variants(fps.repartition(parts)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1 and a <> b")
    sizes = materialise(sizes, "variant-groups")
    twos = sizes.where("n = 2").select("a", "b").where(_close(F.col("a"), F.col("b"))).distinct()
    members = materialise(_members(fps, sizes.where("n > 2").select("key", "n")), "members")
    # At most PAIRED members.
    some = members.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_set("fp").alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b > a) & _close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    some = some.select(F.explode_outer(pairs).alias("p")).where("p is not null").select("p.*").distinct()
    dense = materialise(members.where(F.col("n") > PAIRED).select("fp").distinct(), "dense")
    out = materialise(twos.unionByName(some).unionByName(_dense_links(dense)).distinct(), "links")
    discard(sizes, members, dense)
    return out


def _dense_links(fps: DataFrame) -> DataFrame:
    one, two = _longs([0, *_ONE]), _longs(_TWO)
    near = fps.select("fp", F.explode(one).alias("flip"), F.lit(True).alias("close"))
    far = fps.where(F.bit_count("fp") % 2 == 1).select("fp", F.explode(two).alias("flip"), F.lit(False).alias("close"))
    variants = near.unionByName(far).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", "close")
    groups = variants.groupBy("variant").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("members"))
    edges = groups.where("a is not null and size(members) > 1").select("a", F.explode("members").alias("b")).where("a <> b")
    return edges.where(_close(F.col("a"), F.col("b")))


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest id reachable over links of 3 bits or fewer.

    Every row comes back. Rows with equal fingerprints are linked whatever their ids; null ids take part but
    are never the smallest, so a component of null ids only has a null component_id. ``prints`` is read several
    times and should be a written table.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = materialise(nodes, "nodes")
    roots = connected_components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialise(placed.join(lowest, "root").select(F.col("fp").alias("fp2"), "component_id"), "components")
    discard(nodes, roots, placed)
    return prints.join(of, prints.fp == F.col("fp2")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``.

    Equal rows get equal results; a null or wordless text has fingerprint zero. A very long text is held whole, its shingles'
    hashes are counted in parts. Only the two named columns are read, so others may have any name.
    """
    prints = materialise(fingerprints(docs, width, doc, text), "prints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
