"""Queries over whole texts against brute force, which doesn't share their SQL."""

import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def f1(common, n, m):
    return 1.0 if n == m == 0 else 0.0 if n * m == 0 else 2 * common / (n + m)


def free_tokens(text):
    bare = re.sub(r"\b(a|an|the)\b", " ", text.lower())
    return bare.translate(str.maketrans("", "", string.punctuation)).split()


def test_pairs_are_scored_on_whole_texts(spark, data):
    rows = c.read(spark, data, "conversations").select("conv_id", "turn", "text", T.answer_tokens(F.col("text")).alias("short")).collect()
    assert any(len(r.text) > 200 for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.turn), []).append(r)
    want, joint, rouge, cond, whole = [], [], [], [], []
    for (k, t), xs in by.items():
        for x in xs:
            for y in by.get((k, t + 1), []):
                a, b = free_tokens(x.text), free_tokens(y.text)
                score = f1(sum((Counter(a) & Counter(b)).values()), len(a), len(b))
                want.append((k, t, score))
                rouge.append((k, t, f1(lcs(a, b), len(a), len(b))))
                said, should = (not z or any(m in " ".join(z) for m in T.ABSTENTIONS) for z in (a, b))
                should = should or t % 5 == 0
                cond.append((k, t, 1.0 if said and should else 0.0 if said or should else score))
                source, answer = " ".join(a if t % 2 == 0 else b), " ".join(free_tokens((re.split(r"(?<=[.!?])\s+|\n+", x.text.strip()) or [""])[0]))
                held = float(source == answer) if not source or not answer else 1.0 if answer in source else f1(lcs(source.split(), answer.split()), len(source.split()), len(answer.split()))
                whole.append((k, t, held))
                a, b = x.short, y.short
                n, m, common, hit = len(a), len(b), sum((Counter(a) & Counter(b)).values()), len(set(a) & set(b))
                closed = a != b and bool({" ".join(a), " ".join(b)} & {"yes", "no", "noanswer"})
                p, r = (common / n * hit / len(set(a)), common / m * hit / len(set(b))) if n and m and not closed else (0.0, 0.0)
                joint.append((k, t, 2 * p * r / (p + r) if p + r else 0.0))
    for name, column, rows in (("token_f1", "f1", want), ("rouge_l", "rouge_l", rouge), ("conditioned_scores", "f1", cond), ("joint_metrics", "joint_f1", joint), ("extractive_answers", "score", whole)):
        got = sorted((r.conv_id, r.turn, r[column]) for r in c.QUERIES[name](spark, data).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(rows)], name
        assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(rows)], abs=2e-6), name
