"""Operators with an exact result, against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from collections import defaultdict

import pytest

from tallyspan.llm import decontaminate, linededup, simhash, substrings
from tests.llm.conftest import random_texts

BLANKS = " \t\n\r\x0b\x0c"
ODD = [None, "", " ", "\n\n", "a", "x" * 50, "\n".join(["y" * 45] * 3), "a" * 20000, "w " * 3000, "    É"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(rng, n=80):
    texts = random_texts(rng, n) + ODD + ["z" * 41 + "\n" + "common line that is long enough to be counted by rule\nq"] * 7
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_line_dedup(docs, rng):
    rows = corpus(rng)
    df = docs(rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digests(df, linededup.keep_bitmaps(df)).collect()}
    key = lambda x: x.strip(BLANKS).encode().lower()
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(BLANKS)) >= 40:
                seen[key(x)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(x.strip(BLANKS)) < 40 or len(seen[key(x)]) < 5 or max(seen[key(x)]) == i]
        assert got[i] == (len(lines), len(lines) - len(kept), sha("\n".join(kept))), i


def test_line_dedup_with_null_and_repeated_ids(docs):
    line = "l" * 40
    df = docs([(None, line), (None, line + "\nb"), (1, line), (1, line), (1, line + "\nc"), (2, line), (3, line), (4, line)])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped) for r in linededup.digests(df, linededup.keep_bitmaps(df)).collect())
    assert got == [(-1, 1, 1), (-1, 2, 1), (1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0)]
    df = docs([(None, line), (1, line), (1, line), (2, line), (3, line)])  # four documents only
    assert {r.n_dropped for r in linededup.digests(df, linededup.keep_bitmaps(df)).collect()} == {0}
    assert linededup.digests(df.limit(0), linededup.keep_bitmaps(df.limit(0))).count() == 0


def test_line_dedup_over_many_partitions(spark, docs):
    line = "m" * 60
    df = docs([(i, f"{line}\nown line of document number {i:09d} and more words") for i in range(500)]).repartition(20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = linededup.apply(df.withColumnRenamed("doc_id", "doc_id"), linededup.keep_bitmaps(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id for r in out if line in r.text} == {499}


def windows_of(text, pattern):
    return pattern.findall((text or "").encode().lower().decode())


def test_decontamination(spark, docs, rng):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    rows = corpus(rng)
    long = [t for _, t in rows if t and len(windows_of(t, pattern)) > 40]
    items = [(i, " ".join(rng.choice(long).split()[5:35])) for i in range(6)] + [(20, "a"), (21, "É"), (22, None), (23, "..."), (24, "th TH"), (25, "no such words here"), (10, " ".join(["w"] * 12))]
    rows += [(900, rng.choice(long)), (900, rng.choice(long)), (None, rng.choice(long))]
    rows += [rows[-1], rows[-2]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs(rows), bench).collect())
    wins = defaultdict(set)
    for i, t in items:
        w = windows_of(t, pattern)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in rows:
        w = windows_of(t, pattern)
        hit, found = set(), set()
        for win, names in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= names
        want.append((-1 if i is None else i, len(w), len(hit), tuple(sorted(found))))
    assert got == sorted(want)
    assert sum(x[2] > 0 for x in got) > 5


def test_decontamination_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs([(1, "a b")]), bench).first()
    assert (got.n_words, got.n_hit, got["items"]) == (2, 0, [])
    assert decontaminate.contamination(docs([]), bench).count() == 0
    df = docs([(1, "a b", 5)], ", th long")
    assert decontaminate.clean(df, bench).columns == ["doc_id", "text", "th"]


def test_decontamination_runs_no_python(spark, docs, monkeypatch):
    plans = []
    keep = decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string").coalesce(1)
    assert decontaminate.clean(docs([(1, "x a b c"), (2, "d")]), bench).count() == 1
    assert len(plans) > 8 and not any(re.search("Python|Pandas|MapInArrow", p) for p in plans)


def test_decontamination_without_broadcasts(spark, docs, rng, monkeypatch):
    """The plan of a benchmark that is too large to be sent around gives the same rows, on a long document too."""
    from tallyspan.llm import common

    long = " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(20_000))
    rows = [(1, long), (1, long), (2, long[5000:6000]), (None, "q " + long[300:900]), (3, None)]
    bench = spark.createDataFrame([(i, long[i * 700 : i * 700 + 300].strip()) for i in range(60)], "item_id long, text string")
    shown = lambda: sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs(rows), bench).collect())
    want = shown()
    assert want[0][2] > 1000
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shown() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id of each row's component, from (id, print) rows."""
    keys = sorted({p for _, p in prints})
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return [low.get(find(p)) for _, p in prints]


def test_simhash(docs, rng):
    rows = corpus(rng) + [(3, "repeated row"), (3, "repeated row"), (None, None)]
    got = simhash.near_duplicates(docs(rows)).collect()
    want = [(i, brute_print(t)) for i, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for i, p in want)
    roots = {(str(i), p): c for (i, p), c in zip(want, brute_components(want), strict=True)}
    assert all(r.component_id == roots[str(r.doc_id), int(r.fingerprint, 16)] for r in got)
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("paired", [2, 32])
def test_simhash_links_dense_clusters(spark, rng, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {b for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, simhash._signed(p)) for i, p in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute_components(rows), strict=True)}


def test_substring_dedup(docs, rng):
    rows = corpus(rng)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs(rows)).collect()}
    first = {}
    for i, t in sorted(rows):
        w = substrings.split_words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    removed = 0
    for i, t in rows:
        w = substrings.split_words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        removed += len(gone)
        assert got[i] == (len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))), i
    assert removed > 500


def test_substring_dedup_compares_words_before_it_removes_any(rng):
    """Repeats that names propose wrongly: only windows that are equal word by word go."""
    for _ in range(200):
        early = [rng.choice("ab").encode() for _ in range(rng.randint(20, 300))]
        late = list(early)
        for _ in range(rng.randint(0, 4)):
            late[rng.randrange(len(late))] = b"x"
        cut = rng.randint(0, 5)
        late = late[cut:]
        proposed = []
        for _ in range(rng.randint(1, 3)):
            pos = rng.randrange(len(late) - 13) if len(late) > 13 else 0
            lpos = min(pos + rng.choice([cut, cut, 0]), len(early) - 13)
            n = rng.randint(1, max(1, min(len(late) - pos, len(early) - lpos) - 12))
            proposed.append((pos, n, lpos))
        at = sorted({(p, n, "d", 0, q) for p, n, q in proposed})
        rows = substrings._merged("late", 1, *map(list, zip(*at, strict=True)), 13) if len(late) > 13 else []
        pieces = [{"r": r, "pos": p, "n": n, "lpos": q, "block": k, "words": b" ".join(early[k * substrings.BLOCK : (k + 1) * substrings.BLOCK]).decode()} for _, _, r, p, n, _, _, q, k in rows]
        kept, total = substrings._kept(b" ".join(late).decode(), pieces, 13)
        gone = {x for p, n, q in proposed for k in range(n) if rows and late[p + k : p + k + 13] == early[q + k : q + k + 13] for x in range(p + k, p + k + 13)}
        assert total == len(late) and kept == [w for i, w in enumerate(late) if i not in gone]


def test_text_ids(spark):
    a, line = " ".join(map(str, range(20))), "l" * 40
    df = spark.createDataFrame([("b", a), ("a", a), ("c", "x"), (None, a)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.dedup(df).collect()) == [("None", 0), ("a", 0), ("b", 20), ("c", 0)]
    df = spark.createDataFrame([(x, line) for x in "abcde"], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in linededup.digests(df, linededup.keep_bitmaps(df)).collect()) == [*((x, 1) for x in "abcd"), ("e", 0)]


def test_clashing_columns(spark):
    """Further columns of any name change nothing and come back where rows do."""
    extra = ["th", "doc", "low", "n_words", "row", "__in0", "bitmap", "start"]
    long = "some words that are here more than once in all of these documents and a few more\n"
    more = ", ".join(f"`{x}` long" for x in extra)
    df = spark.createDataFrame([(i, long * 3 + str(i), *range(len(extra))) for i in range(6)], f"doc_id long, text string, {more}")
    bench = spark.createDataFrame([(1, long, *range(len(extra)))], f"item_id long, text string, {more}")
    plain = df.drop(*extra)
    same = lambda f: sorted(map(str, f(df).collect())) == sorted(map(str, f(plain).collect()))
    assert same(lambda d: linededup.digests(d, linededup.keep_bitmaps(d)))
    assert linededup.apply(df, linededup.keep_bitmaps(df)).columns == df.columns and decontaminate.clean(df, bench).count() == 0
    assert same(substrings.dedup) and same(simhash.near_duplicates) and same(lambda d: decontaminate.contamination(d, bench))


def test_substring_dedup_with_null_and_repeated_ids(docs):
    a = " ".join(map(str, range(20)))
    df = docs([(None, a), (None, a), (1, a), (1, a), (1, "x " + a), (2, a + " y"), (3, "z")])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [(-1, 20, 0), (-1, 20, 0), (1, 20, 0), (1, 20, 0), (1, 21, 0), (2, 21, 20), (3, 1, 0)]
    assert substrings.dedup(docs([])).count() == 0
    assert substrings.dedup(docs([(1, "é b")]), with_text=True).first().kept_text == "é b"


def test_anchors_depend_on_the_window_only(rng):
    import numpy as np

    names = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    zero = np.array([0])
    for v in (1, 2, 5, 300):
        a, b = (names[np.array([rng.randrange(v) for _ in range(n)])] for n in (200, 150))
        b[30:80] = a[100:150]
        x, y = substrings.anchors(a, zero)[1], substrings.anchors(b, zero)[1]
        assert (x[100:138] == y[30:68]).all()
        at, both = substrings.anchors(np.concatenate([b, a]), np.array([0, 150]))
        assert (both == np.concatenate([y, x])).all() and at.tolist() == [*range(138), *range(150, 338)]
