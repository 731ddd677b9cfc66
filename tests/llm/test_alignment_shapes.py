"""The relations of op12 hold distinct shapes and are not shuffled; what a worker holds at once is bounded."""

import random

import numpy as np
import public_tokenizers
import pytest

from lexiform.llm import token_alignment
from lexiform.llm.common import bucketed

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def content():
    return tuple(open(p, "rb").read() for p in PATHS)


@pytest.fixture(scope="module")
def chunks(spark, content):
    rng = random.Random(4)
    words = [f"{rng.randrange(10**6):06d}{rng.choice('xyz')}" for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)] + [None, "", " odd  ends ", "a▁b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return bucketed(token_alignment.chunked(docs, spark.sparkContext.broadcast(content)), "chunks", "chunk", 3)


def test_relations_hold_distinct_shapes_without_shuffles(spark, chunks):
    row = chunks.collect()[0]
    shapes = token_alignment.unpacked(row.shapes)
    seen = {(tuple(a), tuple(b)) for a, b in zip(row.a, row.b, strict=True)}
    assert len(seen) == len(row.a) == shapes.max() + 1 and len(shapes) > 10 * len(seen)
    rows = token_alignment.aligned(chunks)
    assert rows.count() == sum(len({*np.cumsum(a), *np.cumsum(b)}) for a, b in seen)
    plan = token_alignment.composed(chunks, rows)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks")]


def test_blocks_of_a_chunk_agree(chunks, monkeypatch):
    left, right = chunks.toArrow(), token_alignment.aligned(chunks).toArrow()

    def row():
        found = token_alignment._of_chunk(left, right)
        return [x.to_pylist() if hasattr(x, "to_pylist") else [y.tolist() if hasattr(y, "tolist") else y for y in x] for x in found]

    one = row()
    monkeypatch.setattr(token_alignment, "SAID", 7)
    monkeypatch.setattr(token_alignment, "COUNTED", 11)
    assert row() == one


def test_few_joined_texts_are_tokenized_at_a_time(content, monkeypatch):
    both, sizes = token_alignment.Tokenizers(*content), []
    words = [f"w{i}" for i in range(500)] + ["a b", " x"]
    one = both.units(words, part=10**6)
    encode = both.encode
    monkeypatch.setattr(both, "encode", lambda texts: sizes.append(len(texts)) or encode(texts))
    monkeypatch.setattr(token_alignment, "PARTS", 4, raising=False)
    order, joined, ids = both.units(words, part=10)
    assert (order, joined) == one[:2] and max(sizes) == 4
    assert all(np.array_equal(x, y) for own, other in zip(ids, one[2], strict=True) for x, y in zip(own, other, strict=True))
