import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M


def pour(budget, children):
    """Whole budgets of (name, capacity, weight): the full ones first, what is left over one each."""
    order = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    out, rest, weight = {}, budget, sum(c[2] for c in order)
    for i, (name, capacity, w) in enumerate(order):
        if Fraction(rest * w, weight) < capacity:
            parts = {n: rest * x // weight for n, _, x in order[i:]}
            extra = rest - sum(parts.values())
            return out | {n: p + (k < extra) for k, (n, p) in enumerate(parts.items())}
        out[name], rest, weight = capacity, rest - capacity, weight - w
    return out


@pytest.mark.parametrize("budget", [0, 1, 7, 100, 333, 10_000])
def test_budgets_by_hand(spark, budget):
    leaves = [("=a", "=x", 50, 3), ("=a", "=y", 5, 1), ("=b", "=x", 100, 9), ("=b", "=z", 1, 1), ("", "=x", 11, 2)]
    weights = {"p": {"a": 3}, "q": {"x": 2}}
    rows = spark.createDataFrame(leaves, "p string, q string, supply bigint, docs bigint")
    got = {(r["p"], r["q"]): r["budget"] for r in M.leaf_budgets(rows, ["p", "q"], weights, budget, 2).collect()}
    tops = {}
    for p, _, supply, _ in leaves:
        tops[p] = tops.get(p, 0) + 2 * supply
    first = pour(min(budget, sum(tops.values())), [(p, c, 3 if p == "=a" else 1) for p, c in tops.items()])
    want = {}
    for p, part in first.items():
        for q, own in pour(part, [(q, 2 * s, 2 if q == "=x" else 1) for x, q, s, _ in leaves if x == p]).items():
            want[p, q] = own
    assert got == want


def tree():
    return {"lang": F.col("lang"), "source": F.col("source")}


@pytest.mark.parametrize("share,epochs,bucket", [(0.5, 1, 2), (1.5, 3, 4096), (0.9, 2, 5), (9.0, 1, 2)])
def test_prefixes_of_epochs(spark, monkeypatch, share, epochs, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    data = [(i, " ".join(["w"] * (i % 7)), ["en", "de", None][i % 3], f"s{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    got = M.mix(docs, tree(), {"lang": {"en": 5}}, share=share, max_epochs=epochs).collect()
    total = sum(i % 7 for i in range(120))
    assert sum(r["used_tokens"] for r in got) == min(int(total * share), total * epochs)
    leaves = {}
    for i, text, lang, source in data:
        leaves.setdefault((lang, source), []).append((i, len(text.split())))
    for leaf, own in leaves.items():
        rows = {r["doc_id"]: r for r in got if (r["lang"], r["source"]) == leaf}
        supply, used = sum(n for _, n in own), sum(r["used_tokens"] for r in rows.values())
        whole, prefix = divmod(used, supply)
        at = 0
        for _, i, n in sorted((hashlib.md5(f"mix:{whole}:{i}".encode()).hexdigest(), i, n) for i, n in own):
            part = min(n, prefix - at) if at < prefix else None
            want = (whole + (part is not None), whole * n + (part or 0))
            assert ((rows[i]["copies"], rows[i]["used_tokens"]) if i in rows else (0, 0)) == want
            at += n


def test_odd_rows(odd, none):
    docs = odd.withColumn("copies", F.lit("mine"))
    got = M.mix(docs, tree(), {}, share=1.0)
    assert got.columns == ["doc_id", "text", "n_chars", "lang", "source", "n_tokens", "copies", "used_tokens"]
    assert got.agg(F.sum("used_tokens")).first()[0] == 30_000 + 33 + 5 + 4
    assert M.in_epochs(got).count() == got.agg(F.sum("copies")).first()[0]
    assert M.mix(none, tree(), {}, share=1.0).count() == 0
    assert M.mix(odd, tree(), {}, budget=0).count() == 0
    with pytest.raises(ValueError):
        M.mix(odd, tree(), {"lang": {"en": 0}}, budget=5)
