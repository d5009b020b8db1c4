"""Every registered domain query equals its DuckDB twin on the smallest tables, and golden values hold."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from modcall.functions import sequence, signal, stats
from modcall.operators import readlevel, sites
from modcall.operators.ranking import step_up
from modcall.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "part orders lineitem events documents embeddings labels".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _normal(rows):
    def one(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return format(float(v), ".6g")
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twin(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert _normal(tuple(r) for r in df.select(*cols).collect()) == _normal(want)


def test_sites_on_the_cutoff_and_deep_ones(spark, tmp_path):
    """A mean of exactly one half is not above it, and sites of any depth count with all their reads."""
    numbers = np.random.default_rng(5)
    half = [tuple(numbers.integers(0, 99, 13)) for _ in range(400)]
    counts = np.array([np.bincount([*b, *(99 - x for x in b)], minlength=100) for b in half], float)
    assert not (1 - sites.linear_scorer(counts) > 0.5).any()
    lines = f"SELECT i AS l_orderkey, i % 7 AS l_linenumber, i % 2 AS l_partkey, i % 11 AS l_suppkey, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(600) t(i) WHERE i % 2 = 0 OR i < 60"
    duckdb.execute(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = catalogue.QUERIES["site_prob_cutoff"](spark, str(tmp_path)).select("pos", "coverage", "probability").collect()
    assert got and _normal(got) == _normal(c.execute(f"select pos, coverage, probability from ({catalogue.ORACLE_SQL['site_prob_cutoff']})").fetchall())


def test_draws_are_made_where_reads_meet(spark, monkeypatch):
    """No read moves again for its draws; those of hot sites, drawn read by read, are the same."""
    calls = spark.range(5000).selectExpr("id % 9 AS pos", "id", "cast(id * 7919 % 1001 AS double) / 1000 AS prob").where("pos < 7 or id < 900")
    calls = calls.withColumn("prob", F.when(F.col("id") % 50 != 0, F.col("prob")))
    rows = lambda: sorted((r.pos, r.coverage, round(r.probability, 12)) for r in sites.site_probabilities(calls, ["pos"], [F.col("id").cast("string")]).collect())
    monkeypatch.setattr(sites, "HOT", 200)
    want = rows()
    assert len(want) == 9 and min(w[1] for w in want) <= 150
    monkeypatch.setattr(sites, "HOT", 1 << 20)
    monkeypatch.setattr(sites, "draws", None)
    assert rows() == want


def test_feature_parts_are_made_once(spark):
    """Tiles come from one pass over a contig, and qualities are adjusted once a window, not once a zero."""
    seqs = ["ACGTN" * 500, "A" * 1024, "C" * 1025, "G" * 1033, "T", "AC" * 1020]
    rows = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "contig string, seq string")
    tiles = readlevel.reference_tiles(rows)
    want = {(str(i), t): s[t * 1024 : t * 1024 + 1032] for i, s in enumerate(seqs) for t in range(-(-len(s) // 1024))}
    assert {(r.contig, r.tile): r.part for r in tiles.collect()} == want
    assert not re.search(r"substr\w*\(seq", tiles._jdf.queryExecution().optimizedPlan().toString())
    q = spark.createDataFrame([([0, 10, 20],), ([0, 0],)], "q array<int>")
    full = q.select(signal.fill_zeros(F.transform("q", lambda x: signal.phred_adjust(x, F.lit("A"), F.lit("C")))).alias("f"))
    assert full._jdf.queryExecution().optimizedPlan().toString().lower().count("log10") == 1
    got = [r.f for r in full.collect()]
    assert got[1] is None and got[0][0] == pytest.approx((got[0][1] + got[0][2]) / 2)


def test_keys(spark):
    rows = spark.createDataFrame([("ENST00000390289.2_53_TCCCTCTCC_3f1d-036e_326_28_T",), ("chr_1_7_ACGTACGTA_r1",), ("bad",)], "k string")
    got = rows.select(sequence.parse_key(F.col("k")).alias("p")).select("p.*").collect()
    assert tuple(got[0]) == ("ENST00000390289.2", 53, "TCCCTCTCC", "3f1d-036e", 326, 28, "T")
    assert tuple(got[1]) == ("chr_1", 7, "ACGTACGTA", "r1", None, None, None)
    assert got[2].contig is None


def test_alignment_strings(spark):
    row = spark.createDataFrame([("3S5M2I4M3D2M10N4M", "5,3I4,2D6,7,")], "c string, s string")
    got = row.select(sequence.cigar_starts(sequence.cigar_ops(F.col("c"))).alias("c"), sequence.signal_ranges(F.col("s")).alias("s")).first()
    assert [(r.op, r.ref_start, r.read_start) for r in got.c] == [("S", 0, 0), ("M", 0, 3), ("I", 5, 8), ("M", 5, 10), ("D", 9, 14), ("M", 12, 14), ("N", 14, 16), ("M", 24, 16)]
    assert [(r.kmer, r.raw_start, r.raw_end) for r in got.s] == [(0, 0, 5), (1, 8, 12), (4, 12, 18), (5, 18, 25)]
    tags = spark.createDataFrame([([3, 4, 9],), ([0, 5],)], "p array<int>").select(sequence.mm_text(F.col("p"))).collect()
    assert [t[0] for t in tags] == ["N+N,3,0,4;", "N+N,0,4;"]


def test_resampling(spark):
    rows = spark.createDataFrame([(1, [float(i) for i in range(1, 65)]), (2, [float(i) for i in range(1, 21)]), (3, [7.0]), (4, []), (5, [0.0, 1.0])], "i int, x array<double>")
    got = {r.i: r.y for r in rows.select("i", signal.resample(F.col("x")).alias("y")).collect()}
    assert (got[1][0], got[1][27], got[1][28], got[1][-1], sum(got[1])) == (1.5, 55.5, 57.0, 64.0, 1282.0)
    assert got[2][:4] == [1, 1.5, 2, 2.5] and got[2][-1] == 20 and sum(got[2]) == 354 and got[3] == [7.0] * 36 and got[4] is None
    assert len(got[5]) == 36 and math.isclose(got[5][1], 1 / 35)


def test_tails(spark):
    rows = spark.createDataFrame([(10.128, 3), (18.513, 2), (7.709, 4), (6.608, 5)], "f double, d int")
    for fast in (stats.f_tail_one(F.col("f"), F.col("d")), stats.f_tail(F.col("f"), F.lit(1.0), F.col("d").cast("double"))):
        assert all(abs(r[0] - 0.05) < 1e-4 for r in rows.select(fast).collect())
    chi = spark.createDataFrame([(3.841458820694124,)], "g double").select(stats.chi2_tail_one("g"), stats.chi2_tail(F.col("g"), F.lit(1.0)), stats.chi2_tail(F.col("g"), F.lit(2.0)), stats.chi2_tail_two(F.col("g"))).first()
    assert abs(chi[0] - 0.05) < 1e-9 and abs(chi[1] - 0.05) < 1e-9 and abs(chi[2] - chi[3]) < 1e-12


def test_step_up(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.2)], "i int, p double")
    assert [round(r.q, 9) for r in step_up(rows, "p", "q", ["i"]).orderBy("i").collect()] == [0.04, 0.04, 0.04, 0.2]


def test_sources(spark, tmp_path):
    from modcall.sources import sequences, tables

    (tmp_path / "a.fa").write_text(">c1 x\nACGT\nAC\n>c2\nGG\n")
    assert {(r.contig, r.seq) for r in sequences.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("c1", "ACGTAC"), ("c2", "GG")}
    sam = "@HD\tVN:1\nr1\t0\tc1\t1\t60\t2M1D1M\t*\t0\t0\tACG\tIII\tsi:Z:0,9,3,0\tss:Z:3,3,3,\tsc:f:1.5\tsh:f:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    (tmp_path / "a.sam").write_text(sam)
    rows = sequences.usable(sequences.sam(spark, str(tmp_path / "a.sam")))
    assert [(r.ref_pos, r.base, r.q) for r in sequences.aligned_bases(rows).orderBy("ref_pos").collect()] == [(0, "A", 40), (1, "C", 40), (2, None, 0), (3, "G", 40)]
    (tmp_path / "t.bed").write_text("chrom pos\nc1 5\nc1\tx\n")
    assert [tuple(r) for r in tables.targets(spark, str(tmp_path / "t.bed")).collect()] == [("c1", 5)]


def test_tables(spark, tmp_path):
    from modcall.sources import sequences, tables

    def text(name, *lines):
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        return str(tmp_path / name)

    calls = tables.read_calls(spark, text("calls.tsv", "c_1_5_ACGTACGTA_r1_9\t0.25\t3", "bad\t0.5\t3"))
    assert [(r.contig, r.pos, r.read_pos, r.prob) for r in calls.collect()] == [("c_1", 5, 9, 0.25), (None, None, None, 0.5)] and tables.one_model(calls) == "3"
    with pytest.raises(ValueError):
        tables.one_model(calls.unionByName(calls.withColumn("model_code", F.lit("4"))))
    head = "contig\tposition\tsite\tcoverage\tstoichiometry\tprobability"
    one, two = text("one.tsv", head, "c\t1\tACGTACGTA\t20\t0.5\t0.9"), text("two.tsv", head, "c\t1\tACGTACGTA\t30\t\t0.8")
    listed = text("manifest.tsv", "path\treplicate\tcondition", f"{one}\tr1\tWT_x", f"{two}\tr2\tKO")
    assert sorted((r.rep, r.condition, r.coverage, r.stoichiometry) for r in tables.from_manifest(spark, listed).collect()) == [("r1", "WT_x", 20, 0.5), ("r2", "KO", 30, None)]
    assert tables.from_manifest(spark, text("none.tsv", "path\treplicate\tcondition")).count() == 0
    row = "c\t7\tACGTA\tr1\tt\t1\t80.5\t1.0\t0.01\tACGTA\t1,2.5,3"
    assert [(r.pos, r.kmer, r.samples) for r in tables.event_align(spark, text("events.tsv", "contig\tposition" + "\tx" * 9, row)).collect()] == [(7, "ACGTA", [1.0, 2.5, 3.0])]
    assert tables.kmer_model(spark, text("model.csv", "model_kmer,model_mean,model_stdv", "ACGTA,80.5,1.5")).first().mean == 80.5
    assert [(r.ninemer, r.max_n) for r in tables.quotas(spark, text("quota.txt", "ACGTACGTA 5", "header x")).collect()] == [("ACGTACGTA", 5)]
    assert tables.counts(spark, text("counts.tsv", "ACGTACGTA\t4")).first().n == 4 and tables.percentile_edges(spark, text("edges.txt", "0.5", "0.1")) == [0, 0.1, 0.5, 1]
    tables.write_tsv(spark.createDataFrame([("a", [1, None, 3])], "k string, v array<int>"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[1].value == "a\t1,,3"
    rows = spark.createDataFrame([(b, [float(i)] * 4) for i, b in enumerate("AACG")], "base string, features array<float>")
    tables.write_features(rows.coalesce(1), str(tmp_path / "feats"), "base", 1)
    assert len(list((tmp_path / "feats" / "base=A").glob("*.parquet"))) == 2 and tables.features(spark, str(tmp_path / "feats"), 4).count() == 4
    with pytest.raises(Exception, match="not 5 numbers"):
        tables.features(spark, str(tmp_path / "feats"), 5).collect()
    slow = text("a.slow5", "#slow5_version\t0.2.0", "@sequencing_kit\tsqk-rna004", "#read_id", "r1\t0\t8192\t10\t1400\t3000\t3\t1,2,3")
    got = sequences.slow5(spark, slow).first()
    assert (got.read_id, got.raw, got.digitisation, got.offset, got.range) == ("r1", [1, 2, 3], 8192, 10, 1400) and sequences.sequencing_kit(spark, slow) == "RNA004"
    assert {(r.contig, r.seq) for r in sequences.fasta(spark, text("b.fa", ">c1 a>b", "acg", ">c2", "GG")).collect()} == {("c1", "ACG"), ("c2", "GG")}


def test_read_level(spark, tmp_path):
    """A read of twelve events on a contig of twenty bases: windows, qualities and currents by hand."""
    from modcall.operators import readlevel
    from modcall.sources import sequences

    seq = "ACGTTGCAACGTAGCTAGGA"
    (tmp_path / "a.fa").write_text(f">c1 x\n{seq}\n")
    moves = "2," * 3 + "1I" + "3," * 9  # k-mers 15 down to 4
    line = f"r1\t0\tc1\t3\t60\t8M1D9M\t*\t0\t0\t{seq[2:10]}{seq[11:20]}\t{'5' * 17}\tsi:Z:1,35,16,4\tss:Z:{moves}\tsc:f:2\tsh:f:1\n"
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:20\n" + line)
    (tmp_path / "a.slow5").write_text("#h\n" + "r1\t0\t100\t0\t100\t3000\t35\t" + ",".join(map(str, range(35))) + "\n")
    reads, signals = sequences.usable(sequences.sam(spark, str(tmp_path / "a.sam"))), sequences.slow5(spark, str(tmp_path / "a.slow5"))
    events = {r.pos: r.samples for r in readlevel.signal_events(reads, signals).collect()}
    assert sorted(events) == list(range(4, 16)) and events[15] == [(2 - 1) / 2, (1 - 1) / 2] and events[12] == [(10 - 1) / 2, (9 - 1) / 2, (8 - 1) / 2]
    model = spark.createDataFrame([(seq[i : i + 5], float(i)) for i in range(16)], "kmer string, mean double")
    got = readlevel.aligned_features(reads, signals, sequences.aligned_bases(reads), sequences.fasta(spark, str(tmp_path / "a.fa")), model, "A").collect()
    assert {(r.start, r.ninemer) for r in got} == {(i, seq[i : i + 9]) for i in range(4, 12) if seq[i + 4] == "A"}
    one = next(r for r in got if r.start == 4)  # its centre is base 8, deleted: base 10
    assert one.tag == "20_A" and len(one.features) == 180 and all(len(x) == 7 for x in one.features)
    assert one.features[0][0] == events[4][0] and one.features[0][1] == 4.0 - events[4][0] and one.features[0][5] == 3 and one.features[0][6] == 20
    assert readlevel.reference_ninemers(spark.createDataFrame([("c1", 11), ("c1", 12), ("c1", -1)], "contig string, start int"), sequences.fasta(spark, str(tmp_path / "a.fa"))).count() == 1


def test_first_by_hash(spark):
    """Large and small groups, whole groups and repeated hashes, against a plain sort."""
    import hashlib

    from modcall.operators.ranking import first_by_hash

    rows = [(g, f"{g}-{i}") for g, n in ((1, 4000), (2, 30), (3, 1)) for i in range(n)]
    groups = [(1, 100, 4000), (2, 50, 30), (3, 0, 1)]
    got = first_by_hash(spark.createDataFrame(rows, "g int, id string"), spark.createDataFrame(groups, "g int, need int, size int"), ["g"], F.lit(None).cast("string"), [F.col("id")], ["id"], "need", "size").collect()
    want = [x for g, need, _ in groups for x in sorted((hashlib.md5(i.encode()).hexdigest(), i) for h, i in rows if h == g)[:need]]
    assert sorted(r.id for r in got) == sorted(i for _, i in want)


def test_vectors_are_cut_from_arrays_of_any_depth(spark):
    from modcall.operators import training

    rows = spark.createDataFrame([(1, [[1, 2], [3, 4], [5, 6]]), (2, [[7, 8]]), (3, None), (4, [])], "id int, features array<array<int>>")
    got = training.vectors(rows, 2).collect()
    assert sorted((r.id, r.vector, r.features) for r in got) == [(1, 0, [1, 2]), (1, 1, [3, 4]), (1, 2, [5, 6]), (2, 0, [7, 8])]
    with pytest.raises(Exception, match="whole number of vectors"):
        training.vectors(rows, 4).collect()


def test_fallback_ranges_and_given_up_mixtures(spark):
    """Too few reads for any plan: a set of 100 values in the ranges of its kind."""
    from modcall.operators import training

    few = [spark.createDataFrame([("AAAAACAAA", f"{s}{i}", 0.5, "A") for i in range(3)], "kmer string, id string, prob double, base string") for s in "mu"]
    for kind, (low, others, first, second) in training.FALLBACK.items():
        got = training.mixtures(*few, kind, 2, "C").collect()
        assert len(got) == 200 and {(r.origin, r.base) for r in got} == {("fallback", "C")}
        made = training.fallback(few[0], kind).collect()
        assert sum(first[0] <= r.prob < first[1] for r in made if r.origin == "low") == low and sum(second[0] <= r.prob < second[1] for r in made if r.origin == "mid") == others


def test_quotas_beyond_a_thousand_rows(spark):
    from modcall.operators import events

    rows = spark.range(5000).selectExpr("CASE WHEN id % 5 < 4 THEN 'hot' ELSE 'cold' END AS ninemer", "id")
    quotas = spark.createDataFrame([("hot", 10, 0), ("hot", 1500, 1), ("cold", 3, 0), ("none", 5, 0)], "ninemer string, max_n int, line_no int")
    got = {r.ninemer: r.n for r in events.within_quota(rows, quotas, ["id"]).groupBy("ninemer").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 1500, "cold": 3}
    assert events.within_quota(rows, quotas.limit(0), ["id"]).count() == 0
