"""Golden values, hand-written source files and invariants."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.functions import text as T
from lexiform.operators import bounded as B
from lexiform.operators import classes as C
from lexiform.operators import encoders as E
from lexiform.operators import features as X
from lexiform.operators import losses as L
from lexiform.operators import metrics as M
from lexiform.operators import pairs as P
from lexiform.operators import ranking as R
from lexiform.operators import splits as S
from lexiform.sources import files, registry, synthetic
from lexiform.sources import quoted as Q
from lexiform.streaming import forms as streaming

HGNC = ["hgnc_id", "symbol", "name", "locus_group", "locus_type", "status", "location", "alias_symbol", "alias_name", "prev_symbol", "prev_name", "refseq_accession", "uniprot_ids", "mane_select", "entrez_id", "ensembl_gene_id"]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def hgnc_file(tmp_path, rows):
    lines = ["\t".join(HGNC)] + ["\t".join(r.get(c, "") for c in HGNC) for r in rows]
    path = tmp_path / "hgnc.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def gz(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def forms_of(df):
    return {r.fact_id: [(f.text, f.notation) for f in r.forms] for r in df.collect()}


# ------------------------------------------------------------- scalars


@pytest.mark.parametrize(
    ("raw", "want"),
    [("NP_1.1:p.Val600Glu", 600), ("NP_1.1:p.(Arg97*)", 97), ("p.Val600Glu", None), ("", None), (None, None), ("NP_1:p.Met1_Lys3del", 1)],
)
def test_protein_positions(spark, raw, want):
    assert one(spark, T.protein_position(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("NM_1.1:c.1799T>A", 1799), ("NM_1.1:c.-5G>A", -5), ("NM_1.1:c.*37A>G", 37), ("c.5A>G", None), ("NC_1:g.99999999999999999999A>G", None)])
def test_nucleotide_positions(spark, raw, want):
    assert one(spark, T.nucleotide_position(F.lit(raw))) == want


def test_cleaning_keeps_inner_space(spark):
    assert one(spark, T.clean(F.lit(' " x " '))) == " x "
    assert [one(spark, T.clean(F.lit(v))) for v in ("-", "na", " - ")] == ["", "na", ""]
    assert [one(spark, T.clean_summary(F.lit(v))) for v in ("-", "na", '"na"')] == ["", "", ""]
    assert one(spark, T.split_values(F.lit("A1|A2|| A3 |-"))) == ["A1", "A2", "A3", "-"]
    assert one(spark, T.split_values(F.lit("A1|na|-"), "|", ("-", "na"))) == ["A1"]


@pytest.mark.parametrize(("raw", "want"), [(" 1.5 ", 1.5), ("-2e3", -2000.0), (".5", 0.5), ("1_0", None), ("1d", None), ("nan", None), ("", None), ("x", None)])
def test_numbers(spark, raw, want):
    assert one(spark, T.number(F.lit(raw))) == want


@pytest.mark.parametrize(("value", "digits"), [(126.0, 6), (85.0, 3), (4.7175, 3), (0.0, 6), (0.6, 6), (282.88, 3), (3.441, 3), (53.04, 3), (1200.5, 6), (0.05, 6)])
def test_format_g(spark, value, digits):
    assert one(spark, T.format_g(F.lit(value), digits)) == f"{value:.{digits}g}"


def test_byte_ids_of_multibyte_text(spark):
    raw = "é1".encode()
    assert one(spark, T.byte_ids(F.lit("é1"), 5)) == [b + 1 for b in raw] + [0, 0]
    assert one(spark, T.byte_ids(F.lit(None).cast("string"), 2)) == [0, 0]


def test_char_ngrams(spark):
    t = " ab "
    assert sorted(one(spark, T.char_ngrams(F.lit("Ab")))) == sorted(t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1))


# ------------------------------------------------------------- classes


def test_hgnc_classes(spark, tmp_path):
    rows = [
        {"hgnc_id": "HGNC:1", "symbol": "A", "name": "gene a", "alias_symbol": '"A1|A2|| A3 "', "prev_symbol": "A|B", "uniprot_ids": "na", "entrez_id": "7"},
        {"hgnc_id": "HGNC:2", "symbol": "ONLY"},
    ]
    got = forms_of(C.hgnc_classes(files.read_hgnc(spark, hgnc_file(tmp_path, rows))))
    assert got == {"gene:HGNC:1:A": [("A", "approved_symbol"), ("gene a", "approved_name"), ("7", "entrez_gene_id"), ("A1", "alias_symbol"), ("A2", "alias_symbol"), ("A3", "alias_symbol"), ("B", "prev_symbol"), ("na", "uniprot_ids")]}


def test_last_row_of_an_entrez_id_wins(spark, tmp_path):
    path = hgnc_file(tmp_path, [{"hgnc_id": "1", "entrez_id": "7"}, {"hgnc_id": "2", "entrez_id": " 7 "}, {"hgnc_id": "3"}])
    assert [(r.entrez_id, r.hgnc_id) for r in files.by_entrez(files.read_hgnc(spark, path)).collect()] == [("7", "2")]


def test_allele_classes(spark, tmp_path):
    hgnc = files.by_entrez(files.read_hgnc(spark, hgnc_file(tmp_path, [{"hgnc_id": "HGNC:1", "symbol": "A", "name": "gene a", "alias_symbol": "X|Y", "entrez_id": "7"}])))
    text = "#AlleleID\tGeneID\tSymbol\tName\tGenesPerAlleleID\tCategory\tSource\n1\t7\tA\tgene a\t1\tc\ts\n1\t7\tA\tother\t1\tc\ts\n2\t7\tA\t\t2\tc\ts\n3\t9\tQ\t\t1\tc\ts\n4\t\tQ\t\t1\n"
    rows = files.read_allele_gene(spark, gz(tmp_path, "a.txt.gz", text))
    got = forms_of(C.allele_classes(rows, hgnc))
    assert set(got) == {"clinvar_gene:1:7", "clinvar_gene:3:9"}
    assert got["clinvar_gene:1:7"] == [("1", "clinvar_allele_id"), ("ClinVar AlleleID 1", "clinvar_allele_text"), ("7", "entrez_gene_id"), ("A", "gene_symbol"), ("gene a", "gene_name"), ("HGNC:1", "hgnc_id"), ("X", "hgnc_alias_symbol"), ("Y", "hgnc_alias_symbol")]
    assert len(got["clinvar_gene:3:9"]) == 4  # no gene row: the class stays
    assert set(forms_of(C.allele_classes(rows, hgnc, single_gene=False))) == {*got, "clinvar_gene:2:7"}


def hgvs_line(variation, ne="NM_1.1:c.10A>G", nc="-", pe="NP_1.1:p.Val4Glu", pc="-", symbol="A", gene="7", allele="1"):
    return "\t".join([symbol, gene, variation, allele, "coding", "na", ne, nc, pe, pc, "No", "No", "No"])


def test_hgvs_classes(spark, tmp_path):
    hgnc = files.by_entrez(files.read_hgnc(spark, hgnc_file(tmp_path, [{"hgnc_id": "HGNC:1", "name": "gene a", "entrez_id": "7"}])))
    lines = ["# comment", hgvs_line("1"), hgvs_line("1", ne="NC_1.1:g.3del", pe="-", allele="2"), hgvs_line("2", symbol="-"), "a\tb", hgvs_line("1", ne="NM_1.1:c.-5A>G")]
    rows = files.read_hgvs(spark, gz(tmp_path, "h.txt.gz", "\n".join(lines) + "\n"))
    whole = C.hgvs_classes(rows, hgnc).collect()
    assert [r.fact_id for r in whole] == ["clinvar_hgvs:1"]
    a = whole[0].attrs
    assert (a["protein_position"], a["nucleotide_position"], a["cdna_position"], a["genomic_position"]) == ("4", "-5", "-5", "3")
    assert whole[0].attr_lists["allele_ids"] == ["1", "2"] and a["hgnc_name"] == "gene a"
    assert len(C.hgvs_classes(rows, hgnc, by_runs=True).collect()) == 2
    assert {r.fact_id for r in C.hgvs_classes(rows, hgnc, require_gene=False).collect()} == {"clinvar_hgvs:1", "clinvar_hgvs:2"}


def test_summary_classes(spark, tmp_path):
    names = ["#AlleleID", "Type", "Name", "GeneID", "GeneSymbol", "HGNC_ID", "ClinicalSignificance", "RS# (dbSNP)", "RCVaccession", "PhenotypeList", "Assembly", "Chromosome", "Start", "Stop", "Cytogenetic", "ReviewStatus", "OtherIDs", "VariationID", "PositionVCF", "ReferenceAlleleVCF", "AlternateAlleleVCF"]
    row = ["5", "snv", "n1", "7", "A", "-", "Benign", "na", "RCV1|RCV2", "p1|na|p2", "GRCh38", "7", "10", "", "7q", "one star", "-", "99", "10", "A", "T"]
    other = ["5", "snv", "n1", "7", "A", "-", "Benign", "na", "RCV1", "p0", "GRCh37", "7", "9", "12", "7q", "one star", "-", "99", "na", "na", "T"]
    rows = files.read_variant_summary(spark, gz(tmp_path, "v.txt.gz", "\n".join("\t".join(r) for r in (names, row, other)) + "\n"))
    got = C.summary_classes(rows).first()
    forms = [(f.text, f.notation) for f in got.forms]
    assert ("GRCh38:7:10-10", "genomic_coordinate") in forms and ("GRCh37:7:9-12", "genomic_coordinate") in forms
    assert ("7:10:A>T", "vcf_allele") in forms and [t for t, n in forms if n == "phenotype"] == ["p1", "p2", "p0"]
    assert got.attr_lists["assemblies"] == ["GRCh37", "GRCh38"] and got.attr_lists["phenotypes"] == ["p0", "p1", "p2"]


@pytest.fixture
def small_splits(spark):
    """Splits of text files of a few bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_table_in_splits(spark, tmp_path, small_splits):
    """Line breaks, separators and doubled quotes inside quotes, records over several splits: as one task reads them."""
    rng = np.random.default_rng(4)
    rows = [["x", "y", "z"]]
    for i in range(60):
        rows.append([str(i), "".join(rng.choice(["a", "bc", "\n", "\t", '"', "\n\n", " "]) for _ in range(rng.integers(0, 30))), "w" * int(rng.integers(0, 9))])
    shown = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('\n\t"') else v
    for k, part in enumerate((rows[:30], rows[:1] + rows[30:])):
        (tmp_path / f"{k}.txt").write_text("\n".join("\t".join(map(shown, r)) for r in part) + "\n")
    df = Q.read_quoted(spark, str(tmp_path))
    assert Q.quoted_records(spark, str(tmp_path)).select("ord.row").distinct().count() > 20
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = [tuple(r) for r in df.orderBy("ord").select("x", "y", "z").collect()]
    assert sorted((a, b or "", c or "") for a, b, c in got) == sorted((a, b, c) for a, b, c in rows[1:])
    whole = spark.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in whole.collect())
    assert [int(a) for a, *_ in got if int(a) < 29] == sorted(int(a) for a, *_ in got if int(a) < 29)


def test_members_of_packed_files(spark, tmp_path):
    """Members that end inside lines, comments, rows of another arity; any split size gives each row once; filters reach the reader."""
    lines = ["# comment"] + ["\t".join([f"S{i % 5}", str(i), *(f"v{i}c{k}" for k in range(11))]) for i in range(3000)] + ["a\tb"]
    text = ("\n".join(lines) + "\n").encode()
    cuts = [0, 1, *range(700, len(text), 7001), len(text)]
    (tmp_path / "h.gz").write_bytes(b"".join(gzip.compress(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))
    path = str(tmp_path / "h.gz")
    for split in (500, 3000, 40_000, 1 << 30):
        rows = files.read_hgvs(spark, path, split)
        assert sorted(int(r.GeneID) for r in rows.collect()) == list(range(3000))
        assert [int(r.GeneID) for r in rows.orderBy("ord").collect()] == list(range(3000))
    many = files.read_hgvs(spark, path, 3000)
    assert many.rdd.getNumPartitions() >= (tmp_path / "h.gz").stat().st_size // 3000
    found = many.filter((F.col("GeneID").isin("7", "8", "2999")) & (F.col("Symbol") == "S4"))
    assert [r.GeneID for r in found.collect()] == ["2999"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "gene_table" in plan and "Filter (" not in plan.replace("PushedFilters", "")
    one = spark.read.format("gene_table").option("path", gz(tmp_path, "n.gz", "#A\tB\n1\t2\n3\n4\t5\n")).load()
    assert one.columns == ["A", "B"] and [tuple(r) for r in one.collect()] == [("1", "2"), ("4", "5")]


def test_first_classes_stop_early(spark, tmp_path):
    """Two splits of many are read for a few classes; a run over the edge of the scan is finished; too high a limit reads all."""
    hgnc = files.by_entrez(files.read_hgnc(spark, hgnc_file(tmp_path, [{"hgnc_id": "HGNC:1", "name": "gene a", "entrez_id": "7"}])))
    lines = [hgvs_line(str(i // 3), ne=f"NM_1.1:c.{i}A>G") for i in range(3000)]
    path = tmp_path / "h.gz"
    path.write_bytes(b"".join(gzip.compress(("\n".join(lines[k : k + 100]) + "\n").encode()) for k in range(0, 3000, 100)))
    split = path.stat().st_size // 12
    for limit, most in ((5, 1), (120, 4), (5000, 13)):
        read = []
        got = C.first_hgvs_classes(spark, str(path), hgnc, limit, split_bytes=split, splits_read=read).collect()
        assert sorted(int(r.fact_id.split(":")[1]) for r in got) == list(range(min(limit, 1000))) and max(read) <= most
        assert all(sum(f.notation == "nucleotide_expression" for f in r.forms) == 3 for r in got)


def test_file_runs_over_splits(spark):
    keys = ["a", "a", "b", "b", "b", "a", "c", "c"]
    rows = [((f"f{i // 5}", (i % 5 // 2 << 33) + i), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "ord struct<file:string,row:long>, k string")
    got = [r.run for r in C.file_runs(df, "k").orderBy("ord").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 4, 4]


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    classes = synthetic.labs(spark)
    files.write_jsonl(classes, path)
    back = files.read_jsonl(spark, path)
    assert sorted(map(str, back.select("fact_id", "forms").collect())) == sorted(map(str, classes.select("fact_id", "forms").collect()))


def test_synthetic_classes(spark):
    labs = forms_of(synthetic.labs(spark))
    assert len(labs) == 14 and labs["lab:glucose:126:mg/dL"] == [("glucose 126 mg/dL", "canonical_unit"), ("glucose 6.99 mmol/L", "alternate_unit"), ("glucose reference range 70-99 mg/dL", "reference_range"), ("glucose is high", "text_interpretation")]
    rows = synthetic.variants(spark, 300).collect()
    assert len(rows) == 300 and rows == synthetic.variants(spark.newSession(), 300).collect()
    for r in rows:
        a = r.attrs
        assert a["reference_aa_1"] != a["alternate_aa_1"] and 5 <= int(a["protein_position"]) <= 1200 and 0 <= 3 * int(a["protein_position"]) - int(a["cdna_position"]) <= 2


def test_registry(spark):
    assert registry.registry(spark).count() == 9
    assert registry.selected(spark, ["clinvar_hgvs"]).first().filename == "hgvs4variation.txt.gz"
    with pytest.raises(ValueError):
        registry.selected(spark, ["nothing"])


# ------------------------------------------------------------- splits, pools


def chat(spark):
    rows = [(f"f{i}", "t", [(f"u{i}", "user"), (f"a{i}", "assistant")], {"k": str(i)}) for i in range(10)]
    return spark.createDataFrame(rows, "fact_id string, track string, forms array<struct<text:string,notation:string>>, attrs map<string,string>")


def test_splits_are_disjoint(spark):
    split = S.by_fact(chat(spark), 0.3)
    assert sorted(r.n for r in S.counts(split).collect()) == [3, 7]
    clean = S.audit(C.flatten(split.filter("split = 'train'")), C.flatten(split.filter("split = 'test'")))
    assert [r.n for r in clean.collect()] == [0]
    with pytest.raises(ValueError):
        S.by_range(C.flatten(chat(spark)), "k", 100, 200)
    with pytest.raises(ValueError):
        S.by_range(C.flatten(chat(spark)), "k", 2, 1)


def test_missing_attribute_reads_none(spark):
    got = S.by_attribute(C.flatten(chat(spark)), "absent", "None")
    assert got.filter("split = 'test'").count() == 20


def test_hard_pools_shape(spark):
    rows = [(f"f{i}", "t", [(f"q{i}", "q"), (f"c{i}", "c")], {"g": str(i % 3)} if i != 9 else {}) for i in range(10)]
    df = spark.createDataFrame(rows, "fact_id string, track string, forms array<struct<text:string,notation:string>>, attrs map<string,string>")
    pools = P.hard_pools(df, "q", "c", ["g"], max_candidates=5, fill_random=True)
    for r in pools.groupBy("benchmark_id").agg(F.count("*").alias("n"), F.count_if(F.col("decoy_kind") == "positive").alias("p"), F.countDistinct("cand_fact").alias("d")).collect():
        assert (r.n, r.p, r.d) == (5, 1, 5)
    assert pools.filter("fact_id = 'f9'").isEmpty()
    with pytest.raises(ValueError):
        P.hard_pools(df, "q", "c", ["g"], max_candidates=1)


# ------------------------------------------------------------- metrics, rankings


def test_golden_metrics(spark):
    m = M.evaluate(spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", None)][:3], "q string, rank int")).first()
    assert m.top1 == pytest.approx(2 / 3, abs=1e-9) and m.top5 == 1.0 and m.mean_reciprocal_rank == pytest.approx((1 + 1 + 1 / 3) / 3, abs=1e-9)
    assert M.evaluate(spark.createDataFrame([], "rank int")).first().query_count == 0


def test_within_distances(spark):
    rows = [("f", "0", [1.0, 0.0]), ("f", "1", [0.0, 1.0]), ("f", "2", [1.0, 0.0])]
    got = M.within_distances(spark.createDataFrame(rows, "fact_id string, form_id string, dense array<double>")).orderBy("i", "j").collect()
    assert [r.distance for r in got] == [1.0, 0.0, 1.0]


def test_between_distances_are_capped_and_repeat(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{i}", E.unit(rng.normal(size=3)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "fact_id string, c array<double>")
    assert M.between_distances(df).count() == 780
    some = [sorted(map(str, M.between_distances(df, 50, 7).collect())) for _ in range(2)]
    assert len(some[0]) == 50 and some[0] == some[1]


def test_canonical_teacher_is_perfect_when_keyed_by_relevance(spark):
    forms = C.flatten(chat(spark))
    ranks = R.canonical_ranks(forms.filter("notation = 'user'"), forms.filter("notation = 'assistant'"), "fact_id", "fact_id")
    m = M.evaluate(ranks).first()
    assert (m.top1, m.top5, m.mean_reciprocal_rank) == (1.0, 1.0, 1.0)


def test_first_match_ranks_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vec = [(f"{i:03d}", str(i % 7), E.unit(rng.normal(size=4)).round(2).tolist()) for i in range(60)]
    df = spark.createDataFrame(vec, "form_id string, fact_id string, dense array<double>")
    want = {}
    for f, fact, v in vec:
        score = {g: round(float(np.dot(v, w)), 9) for g, _, w in vec if g != f}
        order = sorted(score, key=lambda g: (-score[g], g))
        want[f] = next(k for k, g in enumerate(order, 1) if dict((a, b) for a, b, _ in vec)[g] == fact)
    monkeypatch.setattr(B, "QUERY_BLOCK", 16)
    monkeypatch.setattr(B, "BLOCK", 16)
    for size in (5, 16, 1000):
        got = {r.form_id: r.ranks[0] for r in B.first_match(df, df, [1.0], size=size).collect()}
        assert got == want
        top = {(r.q_form, r["rank"]): r.c_form for r in B.top_k(df, df, 1.0, 3, size=size).collect()}
        scores = {f: sorted((-round(float(np.dot(v, w)), 9), g) for g, _, w in vec if g != f) for f, _, v in vec}
        assert top == {(f, k): scores[f][k - 1][1] for f in scores for k in (1, 2, 3)}


def pools_by_hand(rows, blends, tasks):
    """Ranks and numbers of candidates from plain loops. rows: form_id, fact_id, sparse dict, dense, task, serves."""
    out = {}
    for f, fact, s, d, task, _ in rows:
        for i, b in enumerate(blends):
            score = {g: round((1 - b) * sum(s.get(k, 0) * x for k, x in s2.items()) + b * float(np.dot(d, d2)), 9) for g, _, s2, d2, _, serves in rows if g != f and task in serves}
            order = sorted(score, key=lambda g: (-score[g], g))
            facts = {g: h for g, h, *_ in rows}
            out[f, i] = next((k for k, g in enumerate(order, 1) if facts[g] == fact), None)
    return out


@pytest.mark.parametrize("spread_out", [0.02, 1.0])
def test_bounds_leave_ranks_exact(spark, spread_out):
    """Tight and loose clusters, ties at the threshold, repeated vectors, zero vectors, several blends and tasks at once."""
    rng = np.random.default_rng(7)
    centres, rows = rng.normal(size=(6, 5)), []
    for i in range(150):
        c = i % 6
        d = np.round(centres[c] + spread_out * rng.normal(size=5), 3) * (0.0 if i % 40 == 39 else rng.choice([0.5, 1.0, 2.0]))
        s = {int(k): round(float(w), 2) for k, w in zip(rng.integers(c * 5, c * 5 + 8, 4), rng.random(4), strict=True)} if i % 25 else {}
        if i % 10 == 3:
            s, d = rows[-1][2], rows[-1][3]  # a tie
        rows.append((f"{i:03d}", str(rng.integers(0, 30)), s, d, int(rng.integers(0, 2)), [[0], [1], [0, 1], []][int(rng.integers(0, 4))]))
    frame = [(f, k, list(s), list(s.values()), d.tolist(), t, v) for f, k, s, d, t, v in rows]
    df = spark.createDataFrame(frame, "form_id string, fact_id string, g array<long>, w array<double>, dense array<double>, task int, serves array<int>")
    blends = [0.0, 1.0, 0.7]
    want = pools_by_hand(rows, blends, 2)
    got = B.first_match(df.drop("serves"), df.drop("task"), blends, n_tasks=2, size=8).collect()
    assert len(got) == 150 and {(r.form_id, i): r.ranks[i] if r.ranks else None for r in got for i in range(3)} == want
    pairs, asked = sum(r.scored or 0 for r in got), sum(sum(r[4] in v for *_, v in rows) for r in rows if want[r[0], 0] is not None)
    assert pairs < asked if spread_out < 0.5 else pairs <= asked  # bounds tell tight clusters apart


def test_dense_blocks_are_counted_without_scores(spark):
    """Blocks before and behind the threshold: of 40 clusters on a circle a few are scored for each query."""
    rng = np.random.default_rng(3)
    at = np.repeat(np.arange(40) * np.pi / 40, 25) + rng.normal(size=1000) * 1e-3
    rows = [(f"{i:04d}", str((i // 25 * 7 + i) % 90), [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(at)]
    df = spark.createDataFrame(rows, "form_id string, fact_id string, dense array<double>")
    got = B.first_match(df, df, [1.0], size=25).collect()
    x = np.array([v for *_, v in rows])
    score = np.round(x @ x.T, 9)
    facts, forms = np.array([f for _, f, _ in rows]), np.arange(1000)
    for r in got:
        i = int(r.form_id)
        order = [j for j in np.lexsort((forms, -score[i])) if j != i]
        assert (r.ranks[0] if r.ranks else None) == next((k for k, j in enumerate(order, 1) if facts[j] == facts[i]), None)
    assert sum(r.scored or 0 for r in got) < 0.2 * 1000 * 1000


def test_teacher_golden(spark):
    ids = lambda s: [ord(c) + 1 for c in s] + [0] * (4 - len(s))
    df = spark.createDataFrame([(0, ids("A12"), ids("BA1"))], "pair int, source array<int>, target array<int>")
    p = {(r.i, r.j): r.p for r in X.teacher(df).collect()}
    assert p[0, 1] == 1.0 and p[1, 2] == 1.0 and p[2, 2] == 1.0
    assert sum(p[0, j] for j in range(3)) == 1.0 and p[1, 2] > p[1, 0]


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(3)
    x, y, fact = E.unit(rng.normal(size=(6, 5))), E.unit(rng.normal(size=(6, 5))), np.array([0, 0, 1, 2, 2, 3])
    df = lambda v: spark.createDataFrame([(i, int(fact[i]), v[i].tolist()) for i in range(6)], "row int, fact_id int, v array<double>")
    z, pos = x @ y.T / 0.07, (fact[:, None] == fact[None]).astype(float)
    ls = lambda s, a: s - s.max(a, keepdims=True) - np.log(np.exp(s - s.max(a, keepdims=True)).sum(a, keepdims=True))
    want = (-(ls(z, 1) * pos).sum(1) / pos.sum(1)).mean() / 2 + (-(ls(z, 0) * pos).sum(0) / pos.sum(0)).mean() / 2
    assert L.contrastive(L.logits(df(x), df(y))).first().loss == pytest.approx(want)
    kl = L.attention_kl(spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.5)], "pair int, i int, j int, p double"), spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.1)], "pair int, i int, j int, q double")).first().loss
    assert kl == pytest.approx(0.5 * np.log(0.5 / 0.9) + 0.5 * np.log(0.5 / 0.1))


# ------------------------------------------------------------- encoders, streams


@pytest.mark.parametrize("encoder", [E.MeanEncoder(), E.ConvEncoder(), E.AttentionEncoder()])
def test_encoders_ignore_padding_and_are_unit(encoder):
    texts = ["BRAF V600E", "TP53", "é"]
    a, b = encoder(E.byte_matrix(texts, 15)), encoder(E.byte_matrix(texts, 35))
    assert a.shape == (3, 64) and np.allclose(np.linalg.norm(a, axis=1), 1) and np.allclose(a, b, atol=1e-8)


def test_student_learns(spark):
    pairs = [(f"f{i}", f"gene {i} alpha", f"{i} alpha!") for i in range(120)]
    df = spark.createDataFrame(pairs, "fact_id string, left_text string, right_text string")
    rank = lambda m: np.mean([(np.argsort(-(m(E.byte_matrix([l])) @ m(E.byte_matrix([p[2] for p in pairs])).T)[0]) == i).argmax() for i, (_, l, _) in enumerate(pairs)])
    assert rank(E.fit_student(df, epochs=8)) < rank(E.MeanEncoder())


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    files.write_jsonl(synthetic.labs(spark).repartition(3), path)
    q = streaming.form_counts(streaming.read_classes(spark, path, 1)).writeStream.outputMode("complete").format("memory").queryName("form_counts").start()
    q.processAllAvailable()
    q.stop()
    batch = C.flatten(files.read_jsonl(spark, path)).groupBy("track", "notation").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("form_counts").collect())) == sorted(map(tuple, batch.collect()))
