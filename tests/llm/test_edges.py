"""Null, empty and long values, ties, repeated rows, empty tables and clashing columns; brute-force versions."""

import io
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourwise.llm import ctw, decontaminate, embeddings, licenses, minhash, mixing, pii, toxicity, urlfilter
from hourwise.llm.license_texts import CATALOGUE

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
NOTICE = "x y. Permission is hereby GRANTED, free of charge, to any person obtaining a copy of this software and associated documentation files z"
TEXTS = [
    (1, WORDS, "en", "src0"), (1, WORDS, "en", "src0"), (2, WORDS.upper() + " nu", "en", "src10"), (3, None, None, None), (4, "", "en", "src0"),
    (5, " \t\n", "de", None), (None, WORDS, None, "src0"), (6, LONG, "en", "src0"), (7, LONG + " end", "en", "src0"), (8, "one two", "fr", "src1"),
    (9, "one  TWO", "fr", "src1"), (10, "é ß " + NOTICE, "de", "src11"), (11, "Licensed under CC BY-NC 4.0", "en", "src2"), (None, None, None, None),
    (12, "Licensed under the MIT BY-NC 4.0", "en", "src2"),
]
#: Names that the operators use themselves.
CLASH = ["rk", "node", "n", "token", "block", "component", "words", "name", "weight", "budget", "llm_score", "key", "held_out", "x"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.select("*", F.lit(0).alias("n_chars"), *[F.lit("?").alias(c) for c in CLASH])


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(request, spark):
    return docs_of(spark, TEXTS if request.param == "rows" else [])


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, "one two"), (4, "one two")], "item_id long, text string")
    for bench in (items.withColumn("rk", F.lit(1)), items.limit(0)):
        got = decontaminate.contamination(docs, bench).collect()
        assert len(got) == docs.count()
        for r in got:
            if bench is not items and r.doc_id in (1, 2, 8, 9) and r.n_items:
                assert (r.n_hit, r.item_ids) == ((12, ["1"]) if r.doc_id < 3 else (2, ["4"]))
    hit = {r.doc_id for r in decontaminate.contamination(docs, items).where("n_hit > 0").collect()}
    assert hit == ({1, 2, None, 8, 9} if docs.count() else set())


def test_minhash(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    if not docs.count():
        assert got == set()
        return
    assert {g[0]: g[2] for g in got if g[0]} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12}
    assert (None, 8, 1, False) in got and (None, 0, None, False) in got and (8, 1, 8, True) in got


def test_mixing(spark, docs):
    weights = spark.createDataFrame([("core", None, None, 2.0), ("web", None, None, -1.0), (None, None, None, None)], "domain string, lang string, source string, weight double")
    for w in (weights, weights.limit(0)):
        got = mixing.mix_sources(docs, w)
        total = got.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        assert total <= 0.6 * sum(len((t or "").split()) for _, t, _, _ in TEXTS)
        assert got.where("n_tokens = 0").count() == 0
        assert bool(total) == bool(docs.count())


def brute_licenses(text, templates=CATALOGUE):
    """Names, sorted and joined, by comparison with all templates."""
    word = re.compile(r"[a-z0-9\x80-\U0010ffff]+")

    def shingles(t):
        w = word.findall((t or "").translate(LOW))
        return set(zip(w, w[1:], w[2:]))

    held, share = shingles(text), defaultdict(list)
    for name, x, least, family in templates:
        if (of := shingles(x)) and (c := len(of & held) / len(of)) >= least:
            share[family].append((c, name))
    return ",".join(sorted(n for found in share.values() for c, n in found if c == max(found)[0]))


def test_licenses(spark, docs):
    tpl = licenses.catalogue(spark)
    got = sorted((r.doc_id or 0, r.licenses) for r in licenses.scan(docs, tpl).collect())
    assert got == sorted((i or 0, brute_licenses(t)) for i, t, _, _ in TEXTS if docs.count())
    assert licenses.scan(docs, tpl.limit(0)).where("n_licenses > 0").count() == 0
    # without thresholds and families of their own; a template without text or words is passed over
    plain = tpl.select("license", "text").unionByName(spark.createDataFrame([("none", None), ("two", "a b")], "license string, text string"))
    got = sorted((r.doc_id or 0, r.licenses) for r in licenses.scan(docs, plain).collect())
    alone = [(n, t, 0.8, n) for n, t, _, _ in CATALOGUE]
    assert got == sorted((i or 0, brute_licenses(t, alone)) for i, t, _, _ in TEXTS if docs.count())


def test_every_license_of_the_catalogue(spark, monkeypatch):
    """Each template inside other words at every place in a window, whole and with one word in 25 replaced."""
    rng, rows = np.random.default_rng(3), []
    for n, (name, text, _, _) in enumerate(CATALOGUE):
        for shift in range(licenses.STRIDE):
            for edited in (False, True):
                w = text.split()
                for j in rng.choice(len(w), len(w) // 25, replace=False) if edited else ():
                    w[j] = "EDITED"
                rows.append((len(rows), " ".join([*(f"p{i}" for i in range(shift + 9)), *w, *(f"q{i}" for i in range(9))])))
    d = spark.createDataFrame([*rows, (10**6, " ".join(t for _, t, _, _ in CATALOGUE))], "doc_id long, text string").repartition(8)
    want = {i: brute_licenses(t) for i, t in d.collect()}
    assert {r.doc_id: r.licenses for r in licenses.scan(d, licenses.catalogue(spark)).collect()} == want
    whole = {want[i] for i in range(0, len(rows), 2)}
    assert all(any(name in w.split(",") for w in whole) for name, _, _, _ in CATALOGUE)
    # past the limit of the broadcast the same rows come by shuffles
    monkeypatch.setattr(licenses, "INDEX_ROWS", 0)
    assert {r.doc_id: r.licenses for r in licenses.scan(d, licenses.catalogue(spark)).collect()} == want


def brute_ctw(rows, folds=7):
    """The same mixture by plain recursion over dictionaries."""
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == 2 for i, _ in rows]
    coded = [b"\0" * ctw.DEPTH + (t or "").translate(LOW).encode() + b"\0" for _, t in rows]

    def decisions(x):
        for at in range(ctw.DEPTH, len(x)):
            for j in range(8):
                yield x[at - ctw.DEPTH : at], (1 << j) | (x[at] >> (8 - j)), x[at] >> (7 - j) & 1

    n = defaultdict(lambda: [0, 0])
    for x, h in zip(coded, held):
        for c, node, bit in decisions(x) if not h else ():
            for d in range(ctw.DEPTH + 1):
                n[c[ctw.DEPTH - d :], node][bit] += 1
    children = defaultdict(list)
    for c, node in n:
        if c:
            children[c[1:], node].append((c, node))
    log, stay = {}, {}
    for k in sorted(n, key=lambda k: -len(k[0])):
        a, b = n[k]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(k[0]) == ctw.DEPTH:
            log[k], stay[k] = kt, 1.0
        else:
            below = sum(log[c] for c in children[k])
            high = max(kt, below)
            log[k] = high + math.log(math.exp(kt - high) + math.exp(below - high)) - math.log(2)
            stay[k] = 1 / (1 + math.exp(min(700, below - kt)))
    out = []
    for x in coded:
        total = 0.0
        for c, node, bit in decisions(x):
            p, mixed, left = 0.5, 0.0, 1.0
            for d in range(ctw.DEPTH + 1):
                k = c[ctw.DEPTH - d :], node
                if k not in n:
                    break
                one = (n[k][1] + 0.5) / (sum(n[k]) + 1)
                p = mixed + left * one
                mixed, left = mixed + left * stay[k] * one, left * (1 - stay[k])
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return held, out


def test_language_model(docs):
    rows = [(i, t) for i, t, _, _ in TEXTS] if docs.count() else []
    got = sorted(((r.doc_id or 0, r.score, r.held_out, r.n_tokens) for r in ctw.score_texts(docs).collect()), key=lambda r: (r[0], r[1]))
    held, score = brute_ctw(rows)
    want = sorted(zip([i or 0 for i, _ in rows], score, held, [len((t or "").split()) + 1 for _, t in rows]), key=lambda r: (r[0], r[1]))
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 1, 0), (None, 1, 1), (8, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, known).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def labelled_docs(spark, rows):
    """Documents and labels of (text, toxic), all outside the held-out fold."""
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, t, y) for i, (t, y) in zip(ids, rows)]
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))


def test_toxicity_counts_distinct_texts(spark):
    plain = [(f"calm{i % 7} sun{i % 5} n{i}", 0) for i in range(40)] + [(f"vile{i % 3} sun{i % 5} m{i}", 1) for i in range(15)]
    long = " ".join(f"z{i}q" for i in range(3000))
    once, model = toxicity.fit(*labelled_docs(spark, [*plain, (long, 0)]))
    many, again = toxicity.fit(*labelled_docs(spark, [*plain, *[(long, 0)] * 30]))
    assert len(once) and list(once) == list(many)
    a, b = (np.load(io.BytesIO(m)) for m in (model, again))
    assert all((a[k] == b[k]).all() for k in ("w0", "w", "v"))
    # of copies with unlike labels the larger counts, once
    unlike, other = toxicity.fit(*labelled_docs(spark, [*plain, *[(long, 0)] * 30, (long, 1)]))
    want, same = toxicity.fit(*labelled_docs(spark, [*plain, (long, 1)]))
    assert list(unlike) == list(want) and (np.load(io.BytesIO(other))["w"] == np.load(io.BytesIO(same))["w"]).all()


@pytest.mark.parametrize("toxic", [12, 40, 90])
def test_texts_without_inputs_are_not_toxic(spark, toxic):
    """Whatever share of the labels is toxic; the pipeline keeps such rows."""
    d, y = labelled_docs(spark, [(f"calm{i % 7} sun{i % 5} n{i}", 0) for i in range(100 - toxic)] + [(f"vile{i % 3} sun{i % 5} m{i}", 1) for i in range(toxic)])
    terms, model = toxicity.fit(d, y)
    assert model
    known = [(-5, "vile0 sun1"), (-6, "calm0 sun1")]
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \t\n"), (-4, "qqxz zzqj"), *known], "doc_id long, text string")
    got = {r.doc_id: r.llm_score for r in toxicity.score(more, terms, model).collect()}
    assert [got[i] for i in (-1, -2, -3, -4)] == [0.0] * 4
    assert got[-5] >= toxicity.THRESHOLD and got[-5] > got[-6] > 0


def test_pii(docs):
    assert pii.find_pii(docs).count() == docs.count()


def test_embeddings(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(1, a), (2, [2.0, 0.0, 0.0]), (3, b), (3, b), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [None, 1.0, 0.0]),
            (9, [float("inf"), 0.0, 0.0]), (10, [1.0, 0.0]), (None, a), (11, [0.0, 1.0, 0.0]), (12, [1e300, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("node"), F.lit(1).alias("mult"), F.lit(1).alias("label"))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(v).collect()}
    assert got == {(i, 5, 1, i == 1) for i in (1, 2, 3, None, 12)} | {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert embeddings.near_vectors(v.limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    rows = [(1, None), (2, ""), (3, "http://A.Example.ORG/es/x?y"), (4, "http://example.org/en/1#"), (5, "x://net"), (5, "x://net"), (None, "http://b.org"),
            (6, "http://a.com/fr"), (7, "http://a.com/fr/"), (8, "http://" + "a." * 5000 + "org/" + "p" * 5000), (9, "http://org.com/de/"), (10, "http://xexample.org/es/")]
    p = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit("?").alias("host"), F.lit("?").alias("rule"), F.lit("?").alias("path"), F.lit("?").alias("key"))
    got = [(r.page_id, r.rule, r.verdict) for r in urlfilter.url_verdicts(p, rules).collect()]
    assert len(got) == len(rows)
    rule = {g[0]: g[1] for g in got}
    assert [rule[i] for i in range(1, 11)] == [None, None, "example.org/es/", "example.org/en/1", None, None, "com/fr/", "org/", "com/de/", "org/"]
    assert urlfilter.url_verdicts(p.limit(0), rules).count() == 0
    assert {r.rule for r in urlfilter.url_verdicts(p, rules.limit(0)).collect()} == {None}
