"""Language ID: multinomial naive Bayes over hashed character 1- to 3-grams.

Counts are summed in Spark by (language, bucket); the log-probability matrix is broadcast, with a size fixed by
the number of buckets and languages. Texts are scored in numpy: one gather of matrix rows by their n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import fields, map_rows
from tallyspan.llm.samples import fold, labelled

BITS = 15
#: Documents of each language that training takes at most.
PER_LANG = 800
UNKNOWN = "und"
#: Letters, and signs of numbers such as fractions and numerals, which str.isalpha tells apart.
_LETTER = re.compile(r"[^\W\d_]")
#: Code points handled at once; longer texts go in parts that overlap by two.
PART = 1 << 19


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, part by part."""
    low = text.lower()
    for at in range(0, max(1, len(low)), PART):
        c = np.frombuffer(low[at : at + PART + 2].encode("utf-32-le"), "<u4")
        two = c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:] * np.uint32(0xC2B2AE35)
        three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        yield np.concatenate([(x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) for x in (c[:PART], two[:PART], three[:PART])])


def fit(docs: DataFrame, labels: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(bucket | language) as float32 [bucket, language], add-one smoothed."""
    sample = labelled(docs, labels, "lang", per_lang)
    names = ["label", "bucket", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = total.setdefault(label, np.zeros(1 << BITS, np.int64))
                for g in grams(text or ""):
                    t += np.bincount(g, minlength=1 << BITS)
        for label, t in total.items():
            at = np.nonzero(t)[0]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], names=names)

    counts = sample.mapInArrow(count, fields(label="string", bucket="int", n="long")).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label = np.array(counts["label"].to_pylist(), object)
    langs = sorted(set(label.tolist()))
    n = np.ones((1 << BITS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(n, (counts["bucket"].to_numpy(), np.array([place[x] for x in label], np.int64)), counts["n"].to_numpy())
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus lang_pred and score: the posterior of the language under equal priors, ``und`` with 0 where unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        langs, logp = shared.value

        def one(t):
            if not t or not langs or not has_letter(t):
                return UNKNOWN, 0.0
            s = np.zeros(len(langs))
            for g in grams(t):
                s += logp[g].sum(0, dtype=np.float64)
            best = int(s.argmax())
            return langs[best], float(1 / np.exp(s - s[best]).sum())

        return lambda texts: list(zip(*[one(t) for t in texts], strict=True))

    return map_rows(docs, keep, [text], fields(lang_pred="string", score="double"), make)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learnt from rows that are not held out.

    Rows with a null language are not learnt from. Texts that are null or have no letter are ``und``; so is all
    if nothing was learnt. Ties go to the first language in order. Equal rows get equal results; a very long text is
    taken in parts of PART code points. Only doc_id, text and lang are read, so other columns may have any name.
    """
    known = docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "lang")
    got = predict(docs.select("doc_id", "text"), fit(docs, known, per_lang))
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
