"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest

from graphloom.llm import mixing, quality, secrets

from .test_operators import check_packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(60)]
    texts += texts[:10] + [None, "", texts[3] + " more", "token = 9fQx71LmZk20 " + " ".join(rng.choices(words, k=70)), "$$$ " * 50]
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)], SCHEMA)


def test_stages(spark, docs, tmp_path):
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    rows = [tuple(r) for r in docs.collect()]

    good = stages["quality rules"](spark, docs, sf)
    ok = {r["doc_id"] for r in quality.digest(docs).where("kept").collect()}
    assert good.columns == COLUMNS and sorted(tuple(r) for r in good.collect()) == sorted(r for r in rows if r[0] in ok)

    one = stages["near-duplicates"](spark, good, sf)
    left = sorted(tuple(r) for r in good.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[1].split() for r in left)]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(not 0.6 < alike(i, j) < 0.85 for i in range(len(left)) for j in range(i))  # no pair near the threshold
    first = [r for i, r in enumerate(left) if not any(alike(i, j) >= 0.8 for j in range(i))]
    assert one.columns == COLUMNS and sorted(tuple(r) for r in one.collect()) == first

    clean = stages["secret scan"](spark, one, sf)
    assert clean.columns == COLUMNS and clean.count() == one.count()
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any("9fQx71LmZk20" in t for t in text.values()) and sum("[secret]" in t for t in text.values()) == 1
    assert all(text[r["doc_id"]] == r["text"] for r in one.collect() if "token" not in r["text"])

    mixed = stages["mixture"](spark, clean, sf)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.digest(clean).collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == COLUMNS and all(copies[d] * size == n for d, (n, size) in taken.items())

    packed = stages["packing"](spark, mixed, sf).collect()
    check_packed([(r["doc_id"], r["text"]) for r in mixed.collect()], packed)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r["doc_id"] for r in packed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mix", "pack"]
    assert secrets.KINDS[-1] == "live"
