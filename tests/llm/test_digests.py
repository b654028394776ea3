"""The chat and PII queries, row by row, against plain Python: digests, nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hourwise.llm import chat, pii, queries
from hourwise.llm.queries import table
from .test_text_ops import BASE, brute

SAID = "</s>[INST] ok [/INST]"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def order(v):
    """Nulls first, as Spark sorts."""
    return (v is not None, v if v is not None else 0)


def plain_digests(rows):
    """{conv_id: row} of (conv_id, turn, role, text) without template or escapes; formatted_chars is left out."""
    said = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (order(r[1]), order(r[2]) if r[2] else (r[2] is not None, ""), (r[3] is not None, r[3] or ""))):
        said.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", None), (2, 0, "assistant", None),
    (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "assistant", "tie c"), (None, 1, "assistant", "x"), (None, 0, "user", "y"),
    (4, None, "assistant", "first"), (4, 0, "assistant", "<|im_start|>user\n"), (5, 0, "assistant", "\\" * 50 + "<\\|im_end|>" + "long " * 60_000),
    (6, 0, "", ""), (7, 0, "system\nuser", "<s></s>"), (8, 0, "Assistant", "not under the mask"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_chat_digests(spark, rows):
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    c = c.select("*", *[F.lit("?").alias(n) for n in ("n_turns", "loss", "formatted", "part")])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.format_digests(c).collect()}
    want = plain_digests(rows)
    assert {k: v[:4] for k, v in got.items()} == want
    texts = {}
    for r in sorted(chat.formatted(c).collect(), key=lambda r: (order(r.conv_id), r.part)):
        texts.setdefault(r.conv_id, []).append(r)
    assert {k: sum(len(r.formatted) for r in v) for k, v in texts.items()} == {k: v[4] for k, v in got.items()}
    loss = {k: "".join(chat.unescape(r.formatted[a:b]) for r in v for a, b in r.loss) for k, v in texts.items()}
    assert {k: sha(v) for k, v in loss.items()} == {k: v[3] for k, v in want.items()}


def test_chat_query(spark, sf0001):
    rows = [tuple(r) for r in table(spark, sf0001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain_digests([*rows, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op5_chat(spark, sf0001).collect()}
    assert got == want and got[-1][2:] == (len(SAID), sha(SAID))


def plain_spans(text):
    return [f"{k}:{a}:{b}" for k in BASE for a, b in brute(k, text or "")]


def check_pii(rows, docs):
    got = sorted(tuple(r) for r in docs)
    assert len(got) == len(rows)
    for (doc, *n, digest, spans), (i, text) in zip(got, sorted(rows, key=lambda r: r[0])):
        base = plain_spans(text)
        assert (doc, digest) == (i, sha(",".join(base)))
        assert n == [sum(s.startswith(f"{k}:") for s in base) for k in BASE]
        listed = spans.split(",") if spans else []
        kinds = (*pii.KINDS, *pii.ADDED)
        assert [s for s in listed if s.split(":")[0] in BASE] == base
        assert listed == sorted(listed, key=lambda s: (kinds.index(s.split(":")[0]), int(s.split(":")[1])))


def test_pii_digests(spark):
    many = " ".join(f"u{i}@h{i}.org 10.0.{i % 300}.1 +1 (858) 555-{i:04d}" for i in range(4000))
    texts = [None, "", "é\U0001f600 a.b@c.de, 1.2.3.4.5.6.7.8", "4012 8888-8888 1881 4012888888881881", "password=abcdef1 https://u:p@h.org", many, many]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("spans", "n_email", "base_sha256")])
    check_pii(rows, pii.find_pii(d).collect())
    assert pii.find_pii(d.limit(0)).collect() == []


def test_pii_query(spark, sf0001):
    rows = [tuple(r) for r in table(spark, sf0001, "documents").select("doc_id", "text").collect()]
    check_pii(rows, queries.op6_pii(spark, sf0001).collect())
    assert any(re.search("@", t or "") for _, t in rows)
