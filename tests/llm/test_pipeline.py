"""The pipeline's stages keep columns, what the operators decide takes effect, and the run equals plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hourwise.llm import pii, toxicity
from hourwise.llm.queries import table

SF = "/root/testdata/sf0.001"
CLASH = ["llm_score", "LLM_RK", "rk", "Score", "node", "carried", "domain", "epoch", "n_tokens"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= kept
        kept = docs.count()
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "text", "n_chars"]
    assert last.select("doc_id", "text").distinct().join(docs, ["doc_id", "text"]).count() == last.select("doc_id").distinct().count()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a benchmark and labels, and documents with nulls, repeats, copies and clashing columns."""
    d = str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "ro", "tu", "sa")]
    text = lambda i, n=40: " ".join(words[(7 * i + 11 * j * (i % 5 + 1) + j * j) % 30] + str((i * j) % 9) for j in range(n))
    rows = [(i, text(i)) for i in range(40)] + [(40, text(3)), (3, text(3)), (41, None), (41, None), (42, ""), (None, text(5)), (None, text(77))]
    rows += [(43, "write to someone@example.org or call"), (44, "one two three four five six seven eight nine ten eleven"), (45, text(60) + " foul foul")]
    rows += [(100 + i, text(200 + i) + " foul word") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 12}", len(t or "")) for i, t in rows], FIELDS)
    spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]).write.parquet(f"{d}/documents.parquet")
    return d, rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_run_equals_plain_python(spark, small):
    d, rows = small
    docs = table(spark, d, "documents")
    # 1: the machine's own scores decide
    terms, model = toxicity.fit(docs, table(spark, d, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), terms, model).collect()
    toxic = {(r.doc_id, r.text) for r in scored if r.llm_score >= toxicity.THRESHOLD}
    assert len(toxic) >= 15 and all("foul" in t for _, t in toxic)
    left = [r for r in rows if r not in toxic]
    # 2: one row of each group; all rows without words
    group, sets = {}, {t: shingles(t) for _, t in left if shingles(t)}
    for t, s in sets.items():
        same = {t} | {u for u, v in sets.items() if 100 * len(s & v) >= 85 * len(s | v)}
        whole = set().union(*[group.get(x, {x}) for x in same])
        for x in whole:
            group[x] = whole
    first = {}
    for i, t in left:
        if t in group:
            k = min(group[t])
            if k not in first or (i is None, i or 0) < (first[k][0] is None, first[k][0] or 0):
                first[k] = (i, t)
    left = list(first.values()) + [r for r in left if r[1] not in group]
    # 3: windows of ten words of the item
    item = "zero one two three four five six seven eight nine ten".split()
    left = [(i, t) for i, t in left if not any(" ".join(item[k : k + 10]) in " ".join((t or "").lower().split()) for k in (0, 1))]
    assert 44 not in {i for i, _ in left}
    # 4
    machine = pii.automaton()
    left = [(i, t if t is None else pii.redact(t, pii.find(t, machine))) for i, t in left]
    before_mix = docs
    for _, stage in cp.STAGES[:-1]:
        before_mix = cp.staged(stage(spark, before_mix, d))
    assert sorted(map(str, ((r.doc_id, r.text) for r in before_mix.collect()))) == sorted(map(str, left))
    # 5: the mix takes rows of these as they are, with every column
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "text", "n_chars", "llm_score", "LLM_RK", "rk", "Score", "node",
                           "carried", "domain_", "epoch_", "n_tokens_"]
    got = out.collect()
    assert got and {(r.doc_id, r.text) for r in got} <= set(left)
    assert all(r.n_tokens == len(r.text.split()) and r.n_chars == len(r.text) for r in got)
    assert all(r[c if c not in ("domain", "epoch", "n_tokens") else c + "_"] == f"own {c}" for r in got for c in CLASH)
    budget = 0.6 * sum(len((t or "").split()) for _, t in left)
    assert 0.5 * budget <= sum(r.n_tokens for r in got) <= budget


@pytest.mark.parametrize("stage", [s for s in cp.STAGES], ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, small, stage):
    docs = table(spark, small[0], "documents").limit(0)
    out = stage[1](spark, docs, small[0])
    assert out.count() == 0
    if stage[0] != "mixing":
        assert out.columns == docs.columns
