"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of 10 words, a window into shingles of 3. Full containment needs every shingle of a window, so
one of them is a sufficient prefix, and the rarest one is taken: shingles are ordered by how often the documents hold their
rarest word, which one count of words tells. A window with a word that no document has is dropped at once. Of the
documents only (id, position, hash) rows are joined with these prefixes. A candidate must fit into the document at its
position; those left are gathered by document and compared there, word by word, with the words of their windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import discard, materialise, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the one row that each document has for itself; no window has this id.
ITSELF = -1
SALTS = 256


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    parts = F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def _hashes(words: str, size: int) -> Column:
    """By word, the hash of the shingle that starts there; at the end shingles are cut short."""
    return F.transform(words, lambda _, i: _hash(F.col(words), i, size))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, th, n_words, n_hit, n_items, items array<string>) for every row of ``docs``; th is the text's hash.

    A word is hit if an occurrence of any window covers it. Items with fewer than ``window`` words are one
    window; those without words have none. Null texts have no words; null ids are ids like any other;
    equal rows get equal results; an empty benchmark hits nothing. Null item ids are left out of ``items``.
    Only the four named columns are read, so others may have any name. A text is one row of words in memory
    while it is read; what is shuffled of it is a few bytes a word at most, and itself once where candidates are many.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    wins = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    wins = materialise(wins.select("item", F.slice("w", F.col("i"), F.lit(window)).alias("ww")).distinct(), "item-windows")
    named = materialise(wins.select("ww").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    items_of = materialise(wins.join(named, "ww").select("wid", "item"), "items-of")

    # Rarity: how often the documents hold each word of the benchmark.
    words = named.select(F.explode("ww").alias("word")).distinct()
    counts = src.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(words.join(counts, "word"), "word-counts")
    each = named.select("wid", F.size("ww").alias("len"), F.posexplode("ww").alias("i", "word")).join(small(counts), "word", "left")
    # At most ``window`` words a group.
    each = each.groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ws"))
    size = F.least(F.col("len"), F.lit(shingle))
    parts = F.transform(
        F.sequence(F.lit(0), F.col("len") - size),
        lambda k: F.struct(F.array_min(F.transform(F.slice("ws", k + 1, size), lambda x: x["n"])).alias("n"), F.transform(F.slice("ws", k + 1, size), lambda x: x["word"]).alias("sw"), k.alias("k")),
    )
    prefix = each.where(F.forall("ws", lambda x: x["n"] > 0)).select("wid", "len", F.array_min(parts).alias("p"))
    prefix = materialise(prefix.select("wid", "len", F.col("p.k").alias("k"), F.size("p.sw").alias("size"), _hash(F.col("p.sw"), F.lit(0), shingle).alias("h")), "prefixes")
    sizes = sorted(r[0] for r in prefix.select("size").distinct().collect())  # at most ``shingle`` values

    # For each document and shingle size an array of hashes by word, and one entry for itself.
    base = src.select("doc_id", "th", words_of(F.col("text")).alias("w")).select("doc_id", "th", "w", F.size("w").alias("n_words"))
    own = F.array(-1 - F.pmod("th", F.lit(SALTS)))  # spread, for where the join below is a shuffle
    base = base.select("doc_id", "th", "n_words", F.concat(*[_hashes("w", s) for s in sizes], own).alias("hs"))
    rows = base.select("doc_id", "th", "n_words", F.posexplode_outer("hs").alias("at", "h"))  # outer: else a filter that repeats the whole expression goes below
    none = [F.lit(None).cast("int").alias(c) for c in ("len", "k", "size")]
    lookup = prefix.select("wid", "len", "k", "size", "h").unionByName(spark.range(SALTS).select(F.lit(ITSELF).cast("long").alias("wid"), *none, (-1 - F.col("id")).alias("h")))
    lookup = materialise(lookup, "lookup")
    one = F.greatest("n_words", F.lit(1))
    pos = F.col("at") % one
    which = F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("at") / one).cast("int") + 1) if sizes else F.lit(0)
    last = F.col("at") == F.col("n_words") * len(sizes)
    start = pos - F.col("k")
    fits = (which == F.col("size")) & (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    hits = rows.join(small(lookup), "h").where(F.when(F.col("wid") == ITSELF, last).otherwise(~last & fits))
    hits = materialise(hits.select("doc_id", "th", "n_words", "wid", F.when(F.col("wid") != ITSELF, start).alias("start")), "candidates")
    every = hits.where(F.col("wid") == ITSELF).select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"))

    # Verified where the words are; the candidates of one document only are gathered.
    cand = hits.where(F.col("wid") != ITSELF).select("doc_id", "th", "wid", "start").join(small(named), "wid")
    cand = materialise(cand.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "wid", "ww")).alias("cs")).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "cs"), "by-document")
    here = src.join(small(cand), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", "cs", words_of(F.col("text")).alias("w"))
    true = F.filter("cs", lambda c: F.slice("w", c["start"] + 1, F.size(c["ww"])) == c["ww"])
    found = F.transform(true, lambda c: F.struct(c["wid"].alias("wid"), c["start"].alias("start"), (c["start"] + F.size(c["ww"])).alias("end")))
    whole = here.select("doc_id", "th", F.explode_outer(found).alias("c")).where("c is not null")
    whole = materialise(whole.select("doc_id", "th", "c.*").distinct(), "occurrences")

    # Words of one document only: the length of the union of its intervals.
    spans = whole.select("doc_id", "th", "start", "end").distinct()
    before = F.expr("max(end) over (partition by doc_id, th order by start, end rows between unbounded preceding and 1 preceding)")
    spans = spans.withColumn("before", before)
    covered = spans.groupBy("doc_id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    # As many ids as the benchmark has items, at most.
    per_item = whole.select("doc_id", "th", "wid").distinct().join(small(items_of), "wid").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    got = covered.join(per_item, covered.doc_id.eqNullSafe(per_item.doc_id) & (covered.th == per_item.th)).select(covered.doc_id.alias("d2"), covered.th.alias("t2"), "n_hit", "items")
    out = every.join(got, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"))
    out = materialise(out, "contamination")
    discard(wins, named, items_of, counts, prefix, lookup, hits, cand, whole)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit word, all columns unchanged."""
    bad = materialise(contamination(docs, benchmark, doc=doc, text=text).where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct(), "bad")
    return docs.join(bad, F.col(doc).eqNullSafe(bad["__d"]) & (F.xxhash64(F.col(text)) == bad["__t"]), "left_anti")
