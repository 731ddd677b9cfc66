"""Filter audit, token alignment and additive quantisation against brute force, and their awkward rows."""

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate, permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexiform.llm import additive_ann, filter_audit, registry, token_alignment

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- 11


def audited(docs, labels):
    """From plain loops over all orders."""
    least, marks, out = {}, defaultdict(set), Counter()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, good, toxic in labels:
        marks[i] |= {k for k, v in (("good", good), ("toxic", toxic)) if v == 1 and i is not None}
    for i, text, part in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and i > least[t],
        }
        failed = [f for f in "ABCDE" if fails[f]]
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part or "", order, step)
                out[*key, "redundant"] += gone and fails[f]
                out[*key, "unique_fails"] += failed == [f]
                if not gone and fails[f]:
                    gone = True
                    out[*key, "removed"] += 1
                    out[part or "", f, "shapley"] += 1
                    for k in marks[i] if i is not None else ():
                        out[*key, k + "_lost"] += 1
                out[*key, "kept"] += not gone
    return out


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(3)
    texts = [None, "", "ABC # x", "w " * 250, "a b c", " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)) + " $", "\t\n", "É" * 5]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice(["s", None, "", "t"])) for _ in range(40)] + [(3, "w" * 400_000, "s"), (7, "a " * 200_000, "u")]
    labels = [(rng.choice([None, *range(12)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(14)]
    return docs, labels


def test_filter_audit_equals_brute_force(spark, audit_rows, monkeypatch):
    docs, labels = audit_rows
    extra = ", part string, words string, n string, good string, sha string, held string, `doc_id.x` string"
    df = spark.createDataFrame([(*r, *["x"] * 7) for r in docs], "doc_id long, text string, source string" + extra)
    lf = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, good string")
    want = audited(docs, labels)
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)  # counts are sent several times a task
    got = filter_audit.audit(df, lf).collect()
    parts = {p or "" for *_, p in docs}
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len(parts)
    for r in got:
        key = (r.part, r.filter_order, r.step)
        assert tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == tuple(want[*key, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), key
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]
    assert filter_audit.audit(df.limit(0), lf.limit(0)).count() == 0


def test_bitmaps_of_parts_are_ranges_of_words():
    rng = np.random.default_rng(1)
    part, fails, good, toxic = rng.integers(0, 5, 1000), rng.integers(0, 32, 1000), rng.integers(0, 2, 1000), rng.integers(0, 2, 1000)
    got = filter_audit.Bitmap(part, 5, fails, good, toxic).counts()
    for p in range(5):
        for held in range(32):
            alive = (part == p) & (fails & held == 0)
            assert got[p, held].tolist() == [alive.sum(), (alive & (good == 1)).sum(), (alive & (toxic == 1)).sum()]


# ---------------------------------------------------------------- 12


def alignment(texts):
    """Results by place in texts: both tokenizers over whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    both = token_alignment.Tokenizers(*(open(p, "rb").read() for p in PATHS))
    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    out, links, held = [], [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        if not text or any(b"".join(t[i] for i in ids) != want for ids, t in ((a, both.a_bytes), (b, both.b_bytes))):
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = (list(accumulate(len(t[i]) for i in ids)) for ids, t in ((a, both.a_bytes), (b, both.b_bytes)))
        said, own, i, j = [], [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            i2, j2 = bisect.bisect_right(ea, cut), bisect.bisect_right(eb, cut)
            said.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            own += [(a[x], b[y]) for x, y in itertools.product(range(i, i2), range(j, j2)) if (ea[x - 1] if x else 0) < eb[y] and (eb[y - 1] if y else 0) < ea[x]]
            i, j = i2, j2
        out.append((len(a), len(b), len(said), len(own), hashlib.sha256(";".join(said).encode()).hexdigest()))
        links.append(own)
        held.update(set(own))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*o[:4], sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), o[4]) for o, own in zip(out, links, strict=True)]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\tb c", "▁", "x▁y z", "<|endoftext|> and <s> </s> <0x41>", "日本語 テキスト です", "🙂🙂 ok é́", "a b c d", "don't we'll I'M", "\x00 \x01", "naïve café",
    "12345 67890 3.14", "​ zero", "é combining", "\x1c sep \x1f", "def f(x):\n    return x\n\n\n", "\r\n\r\n", "١٢٣ ع", "ﬁ ligature ①",
]


def figures(rows):
    return Counter(tuple(r)[1:] for r in rows)


def aligned_frame(spark, texts):
    extra = ", chunk string, at string, a string, unit string, links string, sizes string"
    return spark.createDataFrame([(None if i % 5 == 0 else i % 7, t, *["x"] * 6) for i, t in enumerate(texts)], "doc_id long, text string" + extra)


@pytest.mark.parametrize("by_words", [True, False])
def test_alignment_of_awkward_texts(spark, monkeypatch, by_words):
    rng = random.Random(2)
    texts = ODD * 2 + ["".join(rng.choice("ab é ▁\n  .,'🙂x1") for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["The quick brown fox. " * 15_000, "a" * 20_000]
    if not by_words:
        texts = texts[:100]
        monkeypatch.setattr(token_alignment.Tokenizers, "segments", lambda self, text: [text])
        monkeypatch.setattr(token_alignment, "CHUNK", 200)
        texts += ["one text that repeats"] * 3
    docs = aligned_frame(spark, texts)
    got = token_alignment.align_documents(docs, *PATHS).collect()
    assert figures(got) == Counter((*w[:6], w[6]) for w in alignment(texts))
    assert Counter(r.doc_id for r in got) == Counter(None if i % 5 == 0 else i % 7 for i in range(len(texts)))
    if by_words:
        assert token_alignment.align_documents(docs.limit(0), *PATHS).count() == 0


def test_alignment_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), alignment([r.text for r in docs]), strict=True))
    got = registry.op12_token_alignment(spark, SF).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == want[r.doc_id] for r in got)


def test_vocabularies_prove_the_split_at_words():
    both = token_alignment.Tokenizers(*(open(p, "rb").read() for p in PATHS))
    assert both.by_words and both.segments("a b  c\td e") == ["a", "b  c\td", "e"]
    words = ["fox", " fox", "x▁", "", "a b"]
    order, joined, ids = both.units(words)
    assert sorted(order) == list(range(5)) and [words[i] for i in order[:joined]] == ["fox", "a b"] and len(ids) == 4


# ---------------------------------------------------------------- 13


def exact(rows, k):
    """(query, [(candidate, score)]) of all usable rows."""
    use = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = Counter(len(v) for *_, v in use).most_common(1)[0][0]
    use = [u for u in use if len(u[2]) == size]
    return [(i, sorted(((-float(v @ w), j) for m, j, w in use if m != n))[:k]) for n, i, v in use if i % 20 == 0]


def test_all_neighbours_of_few_rows(spark):
    """Fewer candidates than the shortlist: exact, with ties, repeats and unusable rows."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(20, [1.0, 1.0, 0.0, 0.0]), (20, [1.0, 1.0, 0.0, 0.0]), (7, [1e200, 0.0, 0.0, 0.0]), (8, [1e-200, 0.0, 0.0, 0.0])]
    rows += [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 0.0]), (180, [float("nan")] * 4), (200, [float("inf"), 0.0, 0.0, 0.0]), (220, [1.0] * 5), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, rid string, v string")
    got = additive_ann.neighbours(df, F.col("vec_id") % 20 == 0, k=5, words=16, books=4).collect()
    want = exact(rows, 5)
    lists = Counter((q, tuple(j for _, j in near)) for q, near in want)
    by = defaultdict(list)
    for r in got:
        by[r.query_id, r["rank"]].append((r.vec_id, r.score))
    assert len(got) == sum(len(n) for _, n in want)
    for (q, rank), found in by.items():
        near = sorted((near[rank - 1][1], -near[rank - 1][0]) for own, near in want if own == q)
        assert [j for j, _ in sorted(found)] == [j for j, _ in near], (q, rank)
        assert [s for _, s in sorted(found)] == pytest.approx([s for _, s in near], rel=1e-12)
    assert {q for q, _ in lists} == {r.query_id for r in got}
    assert additive_ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert additive_ann.neighbours(df.limit(1), F.col("vec_id") >= 0).count() == 0


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = dict(exact(rows, 20))
    got = defaultdict(dict)
    for r in registry.op13_additive_ann(spark, d).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    hits = sum(len({j for _, j in want[q]} & {j for j, _ in found.values()}) for q, found in got.items())
    assert hits >= 0.97 * 20 * len(want)
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        order = [found[k] for k in range(1, 21)]
        assert [j for j, _ in order] == [j for j, _ in sorted(order, key=lambda x: (-x[1], x[0]))]
        assert all(s == pytest.approx(float(vectors[q] @ vectors[j]), abs=1e-12) for j, s in order)


def test_beam_search_is_no_worse_and_stripes_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive_ann.Codebooks.fit(x[:1000], books=6, words=32)
    errors = [((x - books.sums(books.encode(x, beam))) ** 2).sum(1).mean() for beam in (1, 4)]
    assert errors[1] < errors[0] < 1
    codes = books.encode(x[:50])
    assert np.allclose(additive_ann.looked_up(books.tables(x[:7]), codes, np.ones(50)), x[:7] @ books.sums(codes).T, atol=1e-4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    ask = lambda: [tuple(r) for r in additive_ann.neighbours(df, F.col("vec_id") % 100 == 0, books=8, words=32).orderBy("query_id", "rank").collect()]
    one = ask()
    monkeypatch.setattr(additive_ann, "STRIPE", 700)
    monkeypatch.setattr(additive_ann, "CODE_BLOCK", 100)
    assert ask() == one
