"""Each operator against brute force, exact round trips or held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiform.llm import chat_format, decontaminate, exact_dedup, ngram_join, pii_feistel, prefix_bpe, quality_fm, secrets, sharding, toxicity
from lexiform.llm.common import drop_ids, held_out
from lexiform.llm.wordhash import NOT_ALNUM, SPACES, blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, slot string, maybe string, key string"
LABELS = "doc_id long, quality int, toxic int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, ids=None, source=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", source(i) if source else "s", None if t is None else len(t), "r", "s", "m", "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(5, 90)) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c", "A b  c", "x" * 5000, "é ü 漢字 \u00a0 z", *base]
    for t in base[:20]:
        w = t.split()
        for _ in range(rng.randrange(1, 5)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [base[0]] * 40 + [base[1].upper()] * 3 + ["", None]
    return texts


# ---------------------------------------------------------------- words


def test_word_hashes_follow_words():
    texts = ["a b", "", None, "B  a\tc\x0b", "c", "ünï ÜNÏ", "tail "]
    seen = {}
    for size in (1, 1 << 20):
        at = 0
        for first, block in blocks(pa.array(texts, pa.string()), size):
            starts, ends, ptr = block.words(SPACES)
            hashes = block.hashes(starts, ends)
            for i in range(block.n):
                own = re.findall(r"[^\x20\x09-\x0D]+", texts[first + i] or "")
                got = hashes[ptr[i] : ptr[i + 1]].tolist()
                assert len(own) == len(got)
                for w, h in zip(own, got, strict=True):
                    assert seen.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), w), h) == h
                at += 1
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- 10


def test_exact_dedup_matches_brute_force(spark, awkward):
    ids = list(range(len(awkward)))
    ids[-1] = ids[-2] = 7  # repeated ids with one text, and one that another text has
    df = frame(spark, awkward, ids)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_groups(df).collect())
    groups = defaultdict(list)
    for i, t in zip(ids, awkward, strict=True):
        groups[t or ""].append(i)
    want = Counter()
    for t, own in groups.items():
        done = False
        for i in own:
            kept = i == max(own) and not done
            done |= kept
            want[i, max(own), len(own), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((max(own), t) for t, own in groups.items())


def test_exact_dedup_with_a_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "shape", lambda n: (1, 64))
    rng = random.Random(1)
    texts = [words(rng, 3, 9) for _ in range(300)]
    kept = [r.doc_id for r in exact_dedup.duplicate_groups(frame(spark, texts)).filter("kept").collect()]
    assert sorted(kept) == sorted({t: i for i, t in enumerate(texts)}.values())


def test_exact_dedup_of_null_ids_and_no_rows(spark):
    df = frame(spark, ["a", "a", "a", "b"], [None, 4, None, None])
    assert Counter((r.doc_id, r.kept) for r in exact_dedup.duplicate_groups(df).collect()) == Counter({(None, False): 2, (4, True): 1, (None, True): 1})
    assert Counter(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == Counter({4: 1, None: 1})
    assert exact_dedup.duplicate_groups(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


@pytest.fixture(scope="module")
def codec():
    return prefix_bpe.Codec(prefix_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.load_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("abc defthe'sINGnt\n 12!", max_size=80)))
def test_bpe_equals_the_library(codec, reference, text):
    ids = codec.encode(text)
    assert list(ids) == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_bpe_appends_and_edits(codec, data):
    old = data.draw(st.text("abcdeingth", max_size=60)).encode()
    start = data.draw(st.integers(0, len(old)))
    stop = data.draw(st.integers(start, len(old)))
    new = data.draw(st.text("abcdeingth", max_size=8)).encode()
    bpe = codec.bpe
    table = bpe.extend(old, [])
    changed, edited = bpe.edit(old, table, start, stop, new)
    assert changed == old[:start] + new + old[stop:] and edited == bpe.extend(changed, [])
    longer = old + new
    assert bpe.extend(longer, list(table)) == bpe.extend(longer, [])


def test_bpe_query(spark, awkward, reference):
    got = {r.doc_id: r for r in prefix_bpe.encode_documents(frame(spark, awkward), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(awkward):
        ids = reference.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


# ---------------------------------------------------------------- 4


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(texts)):
        least[find(i)].append(ids[i])
    return {i: (len(sets[k]), min(least[find(k)]) if sets[k] else i) for k, i in enumerate(ids)}


def check_components(spark, texts):
    ids = [1000 - i for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(frame(spark, texts, ids)).collect()}
    assert got == brute_components(texts, ids)


def test_ngram_join_matches_brute_force(spark, awkward):
    check_components(spark, awkward)


def test_ngram_join_of_long_lists(spark, monkeypatch):
    """Many near copies of one text, a passage that unrelated texts share, and tiles that have to be split."""
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rng = random.Random(5)
    base, passage = words(rng, 80).split(), words(rng, 60)
    texts = []
    for _ in range(70):
        v = list(base)
        for _ in range(rng.randrange(0, 4)):
            v[rng.randrange(len(v))] = words(rng, 1, 10**6)
        texts.append(" ".join(v))
    texts += [passage + " " + words(rng, rng.randrange(1, 30), 10**6) for _ in range(40)]
    check_components(spark, texts)


def brute_links(texts):
    """Each text's number of links of its set with other sets."""
    sets = [shingles(t) for t in texts]
    degree = {s: sum(a != s and 100 * len(a & s) >= 85 * len(a | s) for a in set(sets)) for s in set(sets) if s}
    return [degree.get(s, 0) for s in sets]


def test_ngram_join_counts_all_links(spark, awkward, monkeypatch):
    rng = random.Random(6)
    base, passage = words(rng, 80).split(), words(rng, 60)
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in (0, 1, 79)]
    for short, tile in ((32, 2048), (4, 8)):
        monkeypatch.setattr(ngram_join, "SHORT", short)
        monkeypatch.setattr(ngram_join, "TILE", tile)
        texts = near + awkward
        if short == 4:
            for _ in range(30):
                v = list(base)
                for _ in range(rng.randrange(0, 4)):
                    v[rng.randrange(len(v))] = words(rng, 1, 10**6)
                texts.append(" ".join(v))
            texts += [passage + " " + words(rng, rng.randrange(1, 30), 10**6) for _ in range(20)]
        got = {r.doc_id: r.n_links for r in ngram_join.near_copies(frame(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_links(texts)
        if short == 32:
            assert [got[i] for i in range(3)] == [2, 2, 2]


def test_divide_skip_finds_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    for percent in (50, 85):
        want = {(i, j) for i in range(80) for j in range(80) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert set(ngram_join.divide_skip(sets, sets, percent)) == want
        assert {(i, j) for i in range(80) for j in range(80) if ngram_join.linked(sets[i], sets[j], percent)} == want


def test_near_copies_leave_one_of_each(spark, awkward):
    df = frame(spark, awkward)
    left = ngram_join.drop_near_copies(df)
    want = brute_components(awkward, list(range(len(awkward))))
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ngram_join.near_copies(df.limit(0)).count() == 0


def test_pipeline_drops_copies_at_five_words_and_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = []
    for n, at in ((50, [25]), (100, [30, 70]), (150, [30, 70, 110]), (50, [15, 35])):  # the last: 5-word Jaccard 36 / 56
        base = words(rng, n, 10**6).split()
        texts += [" ".join(base), " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))]
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 6, 7]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.v: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200 and 300 not in got


def test_drop_ids(spark):
    df = frame(spark, ["a", "b", "c", "d"], [1, 2, 2, None])
    assert sorted(str(r.doc_id) for r in drop_ids(df, spark.createDataFrame([(2,), (9,)], "doc_id long")).collect()) == ["1", "None"]


# ---------------------------------------------------------------- 6


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    return [words(rng, n, 5000) for n in (40, 25, 17, 12, 7, 3, 1)] + ["", "Mixed, CASE! words? " + words(rng, 20, 5000)]


def test_decontamination_finds_planted_overlaps(spark, passages):
    rng = random.Random(9)
    texts, want = [], []
    for k, p in enumerate(passages):
        if not p:
            continue
        around = words(rng, 30, 10**6), words(rng, 30, 10**6)
        texts += [f"{around[0]} {p} {around[1]}", p.upper()]
        want += [k, k]
        w = p.split()
        if len(w) >= 16:  # any 3 substitutions among the first 16 words leave a match
            for _ in range(6):
                v = list(w)
                for i in rng.sample(range(16), 3):
                    v[i] = words(rng, 1, 10**6)
                texts.append(f"{around[1]} {' '.join(v[:16])}")
                want.append(k)
    clean = [words(rng, 50, 10**6) for _ in range(10)] + [None, "", " ".join(passages[0].split()[:6] + passages[1].split()[:6])]
    bench = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(None, None)], "item_id long, text string")
    df = frame(spark, texts + clean)
    got = {r.doc_id: r for r in decontaminate.find_overlaps(df, bench).collect()}
    for i, k in enumerate(want):
        assert k in got[i].item_ids and got[i].contaminated and got[i].best_overlap >= 0.8
    assert not any(got[i].contaminated for i in range(len(texts), len(texts) + len(clean)))
    hit = next(h for h in got[0].hits if h.item_id == 0)
    assert texts[0][hit.start : hit.end] in passages[0]
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == list(range(len(texts), len(texts) + len(clean)))
    assert decontaminate.find_overlaps(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_overlaps(df.limit(0), bench).count() == 0


def test_decontamination_in_several_blocks(spark, passages, monkeypatch):
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    df = frame(spark, passages)
    whole = decontaminate.find_overlaps(df, bench).drop("hits").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 40)
    assert sorted(map(str, decontaminate.find_overlaps(df, bench).drop("hits").collect())) == sorted(map(str, whole))


def test_masks_cover_three_substitutions():
    from itertools import combinations

    for k in range(4):
        for wrong in map(set, combinations(range(16), k)):
            assert any(all(s + o not in wrong for o in m) for m in decontaminate.MASKS for s in range(16 - m[-1]))


def hits(items, texts):
    index = decontaminate.Index(list(enumerate(items)))
    held = [decontaminate._Texts(block) for _, block in blocks(pa.array(texts, pa.string()), 1 << 20)]
    return {d for t in held for d, *_ in index.hits((t.h, t.first), t.n)}


def test_short_items_are_found_with_every_substitution():
    from itertools import combinations

    for n in range(1, 17):
        item = [f"t{i}" for i in range(n)]
        texts = [" ".join(["before", *("x" if i in wrong else w for i, w in enumerate(item)), "after"]) for wrong in combinations(range(n), n // 5)]
        assert hits([" ".join(item)], texts) == set(range(len(texts))), n
        texts = [" ".join(["before", *("x" if i in wrong else w for i, w in enumerate(item)), "after"]) for wrong in combinations(range(n), n // 5 + 1)]
        assert not hits([" ".join(item)], texts), n


def test_short_texts_are_found_as_parts_of_items():
    from itertools import combinations

    for length in (12, 40):
        item = [f"t{i}" for i in range(length)]
        for n in range(decontaminate.FRAGMENT, min(16, length)):
            texts = [" ".join("x" if i in wrong else w for i, w in enumerate(item[at : at + n])) for at in (0, 3, length - n) if at + n <= length for wrong in combinations(range(n), n // 5)]
            assert hits([" ".join(item)], texts) == set(range(len(texts))), n
            assert not hits([" ".join(item)], [" ".join("x" if i <= n // 5 else w for i, w in enumerate(item[:n]))])
        assert not hits([" ".join(item)], [" ".join(item[: decontaminate.FRAGMENT - 1]), "", "t1"])


# ---------------------------------------------------------------- 1 and 7


def labelled(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        toxic = not bad and rng.random() < 0.5  # no toxic words in texts that are labelled clean
        sentences = [words(rng, rng.randrange(4, 12), 300) for _ in range(rng.randrange(1, 9))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vilest", "nasty", "rotten"])
        text = ". ".join(sentences) + "."
        if bad:
            text = " ".join(w + "***" for w in text.upper().split()[:8] * 6)
        rows.append(text)
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, [*rows, "", None], [*range(n), n, n + 1]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS), labels


def test_toxicity_learns_and_locates(spark):
    docs, labels, truth = labelled(spark, 1500)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [(i, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) >= len(held)
    assert np.mean([got[i].predicted == t for i, t in held]) >= 0.95
    assert got[1500].score == 0.0 == got[1501].score
    shown = [texts[i][s.start : s.end] for i, t in held if t for s in got[i].offending]
    assert shown and np.mean([any(w in x for w in ("vilest", "nasty", "rotten")) for x in shown]) >= 0.9
    left = {r.doc_id for r in toxicity.drop_toxic(spark, docs, labels).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}


def test_noisy_or_equals_its_definition(spark):
    docs, labels, _ = labelled(spark, 120)
    w = toxicity.train(docs, labels)
    text = "One two three four five six seven eight nasty. Nine ten eleven twelve thirteen fourteen fifteen vilest. End"
    (_, block), = blocks(pa.array([text]))
    score, p, spans, _ = toxicity.score_block(block, w)
    assert len(p) == len(spans) and np.isclose(score[0], 1 - np.prod(1 - p))


def test_quality_learns(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in quality_fm.classify(docs, labels).collect()}
    held = [(i, q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == q for i, q in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 602


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine()
    m.w = rng.normal(size=quality_fm.DIM).astype(np.float32)
    index, x = rng.choice(quality_fm.DIM, 12, replace=False), rng.normal(size=12).astype(np.float32)
    z, _, _ = m.score(index, x, np.array([0, 12]))
    pairs = sum(float(m.v[index[i]] @ m.v[index[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(z[0], float(m.w[index] @ x) + pairs, atol=1e-4)


@pytest.mark.parametrize("classify", [toxicity.classify, quality_fm.classify])
def test_classifiers_without_labels_or_rows(spark, classify):
    docs, labels = frame(spark, ["a b", None]), spark.createDataFrame([], LABELS)
    assert classify(docs, labels).count() == 2
    assert classify(docs.limit(0), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_held_out_rule(spark):
    ids = [0, 1, 2, 3, 4, 5, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out(F.col("doc_id"))).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


# ---------------------------------------------------------------- 2


def test_shards_are_even_and_keep_groups(spark, awkward):
    rows = sharding.shard_documents(frame(spark, awkward)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(len(awkward)))
    count = Counter(r.shard for r in rows)
    assert set(count) <= set(range(16)) and max(count.values()) - min(count[s] for s in range(16)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    for r in rows:
        raw = (awkward[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    groups = defaultdict(set)
    for r in rows:
        groups[awkward[r.doc_id] or ""].add(r.shard)
    small = [g for t, g in groups.items() if t != awkward[10]]  # the group of 41 is larger than a shard
    assert all(len(g) == 1 for g in small)
    assert len(groups[awkward[10]]) <= 8


def test_shards_of_repeats_and_no_rows(spark):
    df = frame(spark, ["a"] * 20 + ["b"] * 3, [1] * 20 + [2, 2, None])
    rows = sharding.shard_documents(df, n_shards=4).collect()
    assert len(rows) == 23 and len({(r.shard, r.slot) for r in rows}) == 23
    assert sharding.shard_documents(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets_match_brute_force(spark):
    rng = random.Random(6)
    pieces = ["password=", "Token: ", "api_key = '", "APIKEY:\"", "secret", "=", "abcd1234", "AKIA", "ABCDEFGH1234", "AKIAAKIA", "0123456789abcdef" * 2, "deadbeef" * 5, " ", "\n", "é漢", "token=secret=abcdefgh", "short=1", "passwd : x.y/z+12=="]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(250)] + [None, ""]
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(base.split(",")) - {""} <= set(got[i].spans.split(","))


def test_ownership_separates_examples_from_live_tokens(spark):
    live, example = "Zx9kQpLm27TtUv01WwYz", "Ex4mpleT0kenThatAllCopy"
    texts = [f"use {example} here"] * 6 + [f"our {live} key", f"again {live}", "none"]
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, texts, source=lambda i: f"owner{i}" if i < 6 else "owner6")).collect()}
    assert all(got[i].spans == "" for i in (*range(6), 8))
    assert got[6].spans == f"owned:4:{4 + len(live)}" and got[7].n_owned == 1
    assert secrets.find_secrets(frame(spark, texts).limit(0)).count() == 0


# ---------------------------------------------------------------- 8

TEXTS = ["", None, "plain", "</turn>", "<turn>user\n", "\\### x", "\\b\\c\\h\\n\\\\", "### Assistant: </turn> ok\n\n", "<<turn>>", "\\</turn", "漢字 é\n", " a ", "</turn>\n</turn>\n"]


def test_chat_round_trip(spark):
    rows = [(i % 5, i, ("user", "assistant", "sys\ntem", "<turn>", None)[i % 5], t) for i, t in enumerate(TEXTS * 5)] + [(None, None, None, None), (3, 1, "user", "tie"), (3, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.conversation_records(df))
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    shown = {r.conv_id: r.formatted for r in chats.collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(shown[c]) and shown[c].count("</turn>\n") == len(own)
    assert chat_format.digests(chat_format.format_chats(chat_format.conversation_records(df.limit(0)))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"instruction":"q","output":"a"}',
        '{"instruction":"q","input":"more","output":"a","system":"s"}',
        '{"prompt":"q","completion":"a"}',
        '{"question":"q","answer":"a"}',
        '{"question":"q"}',
        "not json",
    ]
    raw = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, raw string")
    df = raw.select("id", F.from_json("raw", chat_format.RECORD_SCHEMA).alias("r")).select("id", "r.*")
    got = {r.id: r for r in chat_format.canonical_turns(df).collect()}
    plain = lambda i: [(t.role, t.text) for t in got[i].turns]
    assert [got[i].layout for i in range(8)] == ["messages", "conversations", "instruction", "instruction", "prompt", "question", None, None]
    assert all(plain(i) == [("user", "q"), ("assistant", "a")] for i in (0, 1, 2, 4, 5))
    assert plain(3) == [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")] and plain(6) == [] == plain(7)
    assert got[2].fingerprint != got[3].fingerprint
    assert got[6].unmapped == '{"question":"q"}' and got[7].unmapped == "{}" and got[0].unmapped is None


# ---------------------------------------------------------------- 9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.binary(min_size=1, max_size=8))
def test_permutations_are_bijections(n, key):
    assert sorted(pii_feistel.permute(i, n, key, "t") for i in range(n)) == list(range(n))


def valid_card(digits):
    return digits + str(pii_feistel.luhn(digits))


def test_luhn():
    assert valid_card("411111111111111") == "4111111111111111" and pii_feistel.luhn("7992739871") == 3


def test_pseudonyms_keep_formats_and_links(spark):
    card = valid_card("453201511283036")
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    texts = [f"pay {card} on 2021-02-28, call +1 (784) 555-8120", f"card {spaced} mail Jo.n91@mail7.example.com ip 12.197.240.125", "GB82 WEST 1234 5698 7654 32 and 219-09-9999", f"bad {card[:-1]}{(int(card[-1]) + 1) % 10} 2021-02-30 999.1.1.1 000-12-3456", None, "", "no numbers"]
    got = {r.doc_id: r for r in pii_feistel.pseudonymise(frame(spark, texts), b"k").collect()}
    new = re.search(r"pay (\d{16}) on (\d{4}-\d{2}-\d{2}), call (\+1 \(\d{3}\) \d{3}-\d{4})$", got[0].text)
    assert new and new[1] != card and valid_card(new[1][:-1]) == new[1] and new[2] != "2021-02-28"
    again = re.search(r"card ([\d ]{19}) mail (\S+) ip (\S+)$", got[1].text)
    assert again[1].replace(" ", "") == new[1] and re.fullmatch(r"[A-Z][a-z]\.[a-z]\d\d@mail7\.example\.com", again[2]) and again[3] != "12.197.240.125"
    assert got[2].n_iban == 1 and got[2].n_ssn == 1 and "1234 5698" not in got[2].text and "219-09-9999" not in got[2].text
    assert got[3].text == texts[3] and got[4].text is None and got[5].text == "" and got[6].text == "no numbers"
    close, n = pii_feistel.Pseudonyms(b"k")(f"12.42 {card} 53.121.55.90 {spaced} 7")
    assert n["card"] == 2 and n["ip"] == 1 and card not in close and spaced not in close
    other = pii_feistel.pseudonymise(frame(spark, texts), b"another").filter("doc_id = 0").first().text
    assert other != got[0].text
    assert pii_feistel.pseudonymise(frame(spark, texts).limit(0), b"k").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dates())
def test_dates_are_permuted_within_their_format(day):
    text = day.strftime("%d/%m/") + f"{day.year:04d}"
    new = pii_feistel.date(text, b"k")
    assert (new is None) == (not 1000 <= day.year < 3000) and (new is None or re.fullmatch(r"\d\d/\d\d/\d{4}", new))


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(spark, tmp_path, awkward):
    import corpus_pipeline
    docs, labels, truth = labelled(spark, 300)
    texts = [r.text for r in docs.collect()]
    rng = random.Random(2)
    item = words(rng, 30, 5000)
    extra = [texts[0], "lead " + item + " tail", words(rng, 40), item.upper()]
    all_texts = texts + extra
    d = str(tmp_path)
    frame(spark, all_texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    now, left = spark.read.parquet(f"{d}/documents.parquet"), dict(enumerate(all_texts))
    scores = {r.doc_id: r.predicted for r in toxicity.classify(now, labels).collect()}
    left = {i: t for i, t in left.items() if not scores[i]}
    last = {}
    for i, t in left.items():
        last[t or ""] = max(i, last.get(t or "", -1))
    left = {i: t for i, t in left.items() if last[t or ""] == i}
    comp = brute_components(list(left.values()), list(left))
    left = {i: t for i, t in left.items() if comp[i][1] == i}
    left = {i: t for i, t in left.items() if item not in (t or "").lower()}
    got = corpus_pipeline.run(spark, d)
    assert sorted(r.doc_id for r in got.collect()) == sorted(left)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, d)
        assert out.columns == now.columns and out.schema == now.schema


def test_registry_names():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= names
    assert NOT_ALNUM[32] and not NOT_ALNUM[200]


def test_cards_and_dates_behind_and_inside_other_text():
    run = pii_feistel.Pseudonyms(b"k")
    long = f"4111 1111 1111 1112 34{pii_feistel.luhn('411111111111111234')}"
    for text, kind in (("2024 4111 1111 1111 1111", "card"), (long, "card"), ("4111 1111 1111 1111 7", "card"), ("2024-01-02T10:00:00Z", "date")):
        out, count = run(text)
        assert count[kind] == 1 and out != text, text
    assert "4111 1111 1111 1111" not in run("2024 4111 1111 1111 1111")[0] and run("2024-01-02Tx")[1]["date"] == 0
