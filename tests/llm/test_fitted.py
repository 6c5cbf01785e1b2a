"""Fitted operators: held-out accuracy, statistics against brute force, defined results at the edges; the pipeline."""

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspan.llm import bpe, langid, quality, queries, rules
from tallyspan.llm.common import connected_components, table

SF = Path("/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")
ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "word"), (5, "long " * 50000), (5, "long " * 50000), (None, "no id")]


@needs_tables
def test_quality_held_out(spark):
    got = quality.classify(table(spark, str(SF), "documents"), table(spark, str(SF), "labels"))
    assert got.count() == 1000
    j = got.join(table(spark, str(SF), "labels"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in j)
    good, bad = [r.score for r in j if r.quality == 1], [r.score for r in j if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in j)


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs(ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs(ODD), one).collect())
    assert quality.classify(docs([]), none).count() == 0


def test_ftrl_learns_a_sign():
    rng = np.random.default_rng(0)
    rows = [(k % 2, np.array([k % 2, 2 + int(rng.integers(5))]), np.array([0.7, 0.7])) for k in range(200)]
    w, _ = quality.train(rows)
    assert w[1] > 0 > w[0]


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=0.02, l2=0.01, epochs=8):
    """FTRL-proximal for logistic loss, coordinate by coordinate, with a bias."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, index, x = rows[k]
            v = [*zip(map(int, index), map(float, x), strict=True), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in v}
            p = 1 / (1 + np.exp(-sum(w[i] * a for i, a in v)))
            for i, a in v:
                g = (p - y) * a
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_against_plain_ftrl(spark, docs):
    rng = np.random.default_rng(3)
    words = {0: [f"b{i}" for i in range(30)], 1: [f"g{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choice(words[i % 2] + words[0][:9], rng.integers(1, 30)))) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    known = [(i % 2, *quality.features(t, quality._Ids())) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    known = [(y, i, x.astype("<f4").astype(float)) for y, i, x in known]
    known.sort(key=lambda r: (r[0], r[1].astype("<i4").tobytes(), r[2].astype("<f4").tobytes()))
    want = plain_ftrl(known)
    w, bias = quality.train(known)
    assert abs(bias - want["bias"]) < 1e-6 and all(abs(w[i] - want.get(i, 0)) < 1e-5 for i in range(len(w)) if w[i] or i in want)
    for r in quality.classify(docs(rows), labels).collect():
        i, x = quality.features(rows[r.doc_id][1], quality._Ids())
        assert abs(r.score - 1 / (1 + np.exp(-(sum(want.get(int(a), 0) * b for a, b in zip(i, x, strict=True)) + want["bias"])))) < 1e-5


def test_language_against_plain_bayes(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcde é" if i % 2 else "cdefg ñ"), rng.integers(3, 40))), "xy"[i % 2]) for i in range(60)] + [(60, None, "x"), (61, "½ ² Ⅷ", "y"), (62, "12 !", None)]
    counts = {"x": Counter(), "y": Counter()}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(g for part in langid.grams(t or "") for g in part.tolist())
    size = 1 << langid.BITS
    logp = {k: {g: np.log((c[g] + 1) / (c.total() + size)) for g in range(size)} for k, c in counts.items()}
    for r in langid.identify(docs(rows, ", lang string")).collect():
        t = rows[r.doc_id][1] or ""
        if not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = {k: sum(p[g] for part in langid.grams(t) for g in part.tolist()) for k, p in logp.items()}
        best = max(s, key=s.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(v - s[best]) for v in s.values())) < 1e-3


@needs_tables
def test_language_held_out(spark):
    d = table(spark, str(SF), "documents")
    j = langid.identify(d).join(d, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in j]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in j)


def test_language_edges(spark, docs):
    rows = [(*r, lang) for r, lang in zip([*ODD, (10, "uno dos"), (11, "one two")], ["x", None, "x", "x", "y", "y", None, "es", "en"], strict=True)]
    got = langid.identify(docs(rows, ", lang string")).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs([(1, "a", None)], ", lang string")).collect()} == {"und"}
    assert langid.identify(docs([], ", lang string")).count() == 0


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = "abc defé ghi" * 20
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "PART", 7)
    parts = np.sort(np.concatenate(list(langid.grams(text))))
    assert (whole == parts).all()


def brute_statistics(t):
    t = t or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    covered = {p for i, x in enumerate(three) if n[x] > 1 for p in range(i, i + 3)}
    lines = t.split("\n")
    dup = sum(bool(x.strip(" \t\r\x0b\x0c")) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rule_statistics(rng):
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "#", " ", "\n", "é", "a b a ", " ", "\x1c", "\t"]) for _ in range(rng.randint(0, 60)))
        assert rules.statistics(t)[:5] == brute_statistics(t)
    assert rules.statistics(None)[:5] == (0, 0, 0, 0, 0)


@needs_tables
def test_rules_keep_clean_documents_and_match_python(spark):
    d, labels = table(spark, str(SF), "documents"), table(spark, str(SF), "labels")
    learnt = rules.fit(d, labels)
    assert learnt
    got = rules.verdicts(d, learnt).collect()
    for r, row in ((r, r.asDict()) for r in got):
        s = rules.ratios({k: float(row[k]) for k in rules.STATS})
        first = next((i for i, rule in enumerate(learnt, 1) if all(c.holds(s) for c in rule)), 0)
        assert (r.rule, r.kept) == (first, not r.base_failed and first == 0)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    j = {r.doc_id: r for r in got}
    known = [(j[x.doc_id], x.quality) for x in labels.collect()]
    assert np.mean([r.kept for r, q in known if q == 1 and not r.base_failed]) > 0.99
    assert np.mean([r.kept for r, q in known if q == 0]) < 0.05


def test_rules_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.fit(docs(ODD), none) == []
    df = docs([(1, "w" + " w".join(map(str, range(60))), 9), (2, "few", 8)], ", n_words long")
    kept = rules.clean(df, none)
    assert kept.columns == ["doc_id", "text", "n_words"] and [tuple(r)[::2] for r in kept.collect()] == [(1, 9)]


def test_components_match_brute_force(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(2000, 2300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@needs_tables
def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, str(SF))
        rel = con.sql(sql)
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall()), name


@needs_tables
def test_base_of_rules_with_sql(spark):
    """The columns of op8 that SQL can say, over whole texts of the table."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(r"""
        with d as (select doc_id, text t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w, string_split(coalesce(text, ''), chr(10)) ls from documents),
        g as (select doc_id, i, list_slice(w, i, i + 2) x from d, unnest(range(1, len(w) - 1)) u(i)),
        m as (select doc_id, i from (select *, count(*) over (partition by doc_id, x) n from g) where n > 1),
        r as (select doc_id, count(distinct p) n from m, unnest(range(i, i + 3)) u(p) group by doc_id),
        l as (select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(ls) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
        select d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(coalesce(t, '')) - length(regexp_replace(coalesce(t, ''), '[#*$%&|<>]', '', 'g')) n_symbols,
               coalesce(l.n, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words, len(w) < 50 or 100 * coalesce(r.n, 0) > 50 * len(w) base_failed
        from d left join r on r.doc_id = d.doc_id left join l on l.doc_id = d.doc_id""")
    got = queries.op8_quality_rules(spark, str(SF)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@needs_tables
def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision on its own input."""
    from tests.llm.test_exact import brute_components, brute_print

    sf, docs = str(SF), table(spark, str(SF), "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokens"]
    a = stage["quality_rules"](spark, docs, sf).cache()
    verdict = queries.op8_quality_rules(spark, sf)
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in verdict.where("kept").collect()}
    b = stage["line_dedup"](spark, a, sf).cache()
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower()
    before, seen = {r.doc_id: r.text for r in a.collect()}, {}
    for i, t in before.items():
        for x in t.split("\n"):
            seen.setdefault(key(x), set()).add(i)
    drop = lambda x, i: len(key(x).decode()) >= 40 and len(seen[key(x)]) >= 5 and max(seen[key(x)]) != i
    assert {r.doc_id: r.text for r in b.collect()} == {i: "\n".join(x for x in t.split("\n") if not drop(x, i)) for i, t in before.items()}
    assert all(len(r.text) == r.n_chars for r in b.collect())
    rows = [(r.doc_id, brute_print(r.text)) for r in b.collect()]
    c = stage["near_dedup"](spark, b, sf).cache()
    assert {r.doc_id for r in c.collect()} == {i for (i, _), low in zip(rows, brute_components(rows), strict=True) if i == low}
    d = stage["decontamination"](spark, c, sf).cache()
    assert a.columns == b.columns == c.columns == d.columns == columns
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())
    wins = {tuple(w[k : k + 10]) for r in table(spark, sf, "benchmark").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in wins}
    hit = lambda w: any(tuple(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect() if not hit(words(r.text))}
    assert 0 < d.count() < c.count()
    e = stage["tokens"](spark, d, sf)
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in d.collect()}
    assert e.join(d, "doc_id").where(F.col("decoded_sha256") != F.sha2(F.col("text").cast("binary"), 256)).count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, e.collect()))


@needs_tables
def test_pipeline_on_empty_documents(spark, docs):
    empty = docs([], ", lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(SF)).count() == 0
    assert bpe.read_ranks.cache_info() is not None


def test_near_dedup_of_repeated_ids(docs, spark):
    a, b, c = "one two three four five six seven", "quite another text of other words here", "and a third that has nothing to do with them"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, c), (4, c), (4, c), (5, a), (None, a), (None, a)]
    extra = [(*r, "en", "s", len(r[1])) for r in rows]
    left = corpus_pipeline.near_dedup(spark, docs(extra, ", lang string, source string, n_chars long"), "")
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", a), ("2", b), ("4", c), ("None", a), ("None", a)])
    near = [(7, "Same Words But Not The Same Text"), (7, "same words but not the same text"), (8, "same words but not the same text")]
    left = corpus_pipeline.near_dedup(spark, docs([(*r, "en", "s", 1) for r in near], ", lang string, source string, n_chars long"), "").collect()
    assert len(left) == 1 and left[0].doc_id == 7
