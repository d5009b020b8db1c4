"""Compressed and text formats: ranges of a file, order, damage, fields at the edges."""

import random

import pytest
from pyspark.sql import functions as F

from modcall.operators import modtags
from modcall.scratch import children
from modcall.sources import bam, sequences

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:5000\n@SQ\tSN:chr2\tLN:7000\n"


def sam_rows(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([0, 1, 9, 10, 200])
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        qual = "*" if size == 0 or rng.random() < 0.2 else "".join(chr(rng.randint(33, 126)) for _ in range(size))
        tags = ["NM:i:-3", f"si:Z:{i},2,3,4", "ss:Z:" + "12,3I" * rng.choice([1, 5, 400]), "sc:f:0.1", "sh:f:-2.5", "XC:A:q", "XH:H:1AE3", "XB:B:c,-1,2", "XF:B:f,1.5,0.25", "XU:i:4000000000"][: rng.randint(0, 10)]
        out.append([f"read{i}", str(rng.choice([0, 16, 4])), rng.choice(["chr1", "chr2", "*"]), str(rng.randint(0, 4000)), "60", f"{size}M" if size else "*", rng.choice(["*", "=", "chr2"]), "0", "0", seq, qual, *tags])
    # a mate on the same contig is always written as "="
    return [r[:6] + ["*" if r[2] == "*" and r[6] == "=" else "=" if r[6] == r[2] != "*" else r[6]] + r[7:] for r in out]


def write_file(path, rows, header=HEADER):
    def fields(r):
        return (r[0], int(r[1]), r[2], int(r[3]) - 1, int(r[4]), r[5], r[6], int(r[7]) - 1, int(r[8]), r[9], r[10], r[11:])

    with open(path, "wb") as out:
        bam.write_records(out, bam.header_bytes(header, [("chr1", 5000), ("chr2", 7000)]), (bam.encode(fields(r), {"chr1": 0, "chr2": 1}) for r in rows))


def everything(df):
    return sorted(map(repr, df.select(*[c.split()[0] for c in bam.SCHEMA.split(", ")]).collect()))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    rows = sam_rows(3000)
    write_file(folder / "a.bam", rows)
    (folder / "a.sam").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows))
    return folder


def test_ranges_give_every_alignment_once(spark, both):
    want = everything(sequences.sam_fields(spark.read.text(str(both / "a.sam"))))
    for size in (1 << 25, 100_000, 20_000, 777):
        got = bam.read_bam(spark, str(both / "a.bam"), size)
        assert got.rdd.getNumPartitions() >= min(40, (both / "a.bam").stat().st_size // size)
        assert everything(got) == want
    assert sequences.bam(spark, str(both / "a.bam")).exceptAll(sequences.sam(spark, str(both / "a.sam"))).count() == 0


def test_records_that_span_many_blocks_and_long_headers(spark, tmp_path):
    rows = [[f"r{i}", "0", "chr1", "7", "9", "300000M", "*", "0", "0", "ACGTT" * 60_000, "*", f"XZ:Z:{i}"] for i in range(5)] + sam_rows(50)
    write_file(tmp_path / "b.bam", rows, HEADER + "@CO\t" + "x" * 200_000 + "\n")
    for size in (1 << 20, 30_000):
        got = bam.read_bam(spark, str(tmp_path / "b.bam"), size)
        assert sorted(r.read_id for r in got.select("read_id").collect()) == sorted(r[0] for r in rows)
    assert got.where("length(seq) = 300000").count() == 5


def test_damage_is_an_error(spark, both, tmp_path):
    whole = (both / "a.bam").read_bytes()
    for name, data in (("flip", whole[:60_000] + bytes([whole[60_000] ^ 0x55]) + whole[60_001:]), ("cut", whole[: len(whole) // 2]), ("none", b"@HD\tVN:1.6\n" * 9)):
        (tmp_path / f"{name}.bam").write_bytes(data)
        with pytest.raises(Exception, match="damaged|no block|cut off|not a BAM"):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam"), 50_000).collect()


def test_writing_and_empty_files(spark, both, tmp_path):
    rows = bam.read_bam(spark, str(both / "a.bam"))
    bam.write_bam(rows.repartition(3), f"file://{tmp_path}/out", HEADER)
    assert len(children(spark, f"file://{tmp_path}/out")) == 4 and everything(bam.read_bam(spark, f"{tmp_path}/out", 40_000)) == everything(rows)
    write_file(tmp_path / "empty.bam", [])
    assert bam.read_bam(spark, str(tmp_path / "empty.bam")).count() == 0
    broken = rows.withColumn("cigar", F.when(F.col("read_id") == "read7", "5?").otherwise(F.col("cigar")))
    with pytest.raises(Exception):  # noqa: B017
        bam.write_bam(broken, f"file://{tmp_path}/bad", HEADER)
    assert not [x for x in children(spark, f"file://{tmp_path}/bad") if not x.startswith(".")]


def test_fields_at_the_edges(spark, tmp_path):
    many = [f"X{i % 10}:i:{i}" for i in range(1500)] + ["si:Z:1,2,3,4"]
    (tmp_path / "m.sam").write_text("@HD\tVN:1.6\n" + "\t".join(["r", "0", "chr1", "1", "9", "3M", "*", "0", "0", "ACG", "*", *many]) + "\nshort\tline\n")
    row = sequences.sam(spark, str(tmp_path / "m.sam")).first()
    assert row.qual is None and row.si == "1,2,3,4" and row.ss is None
    assert sequences.sam_fields(spark.read.text(str(tmp_path / "m.sam"))).first().tags == many


def test_a_rewritten_file_differs_by_its_tags_only(spark, tmp_path):
    rng, rows = random.Random(4), sam_rows(400, 2)
    rng.shuffle(rows)
    for r in rows[::3]:
        r[11:] = ["MM:Z:old", *r[11:], "ML:B:C,9"]
    rows[5][10], rows[5][9] = "MM:", "ACG"  # a quality is no tag
    (tmp_path / "a.sam").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows))
    tagged = {r[0] for r in rows if rng.random() < 0.7} | {rows[5][0]}
    tags = spark.createDataFrame([(x, f"N+N,{i};", [i % 256]) for i, x in enumerate(sorted(tagged))], "read_id string, mm string, ml array<int>")
    number = {x: i for i, x in enumerate(sorted(tagged))}
    kept = [r[:11] + [t for t in r[11:] if t[:3] not in ("MM:", "ML:")] + [f"MM:Z:N+N,{number[r[0]]};", f"ML:B:C,{number[r[0]] % 256}"] for r in rows if r[0] in tagged]
    want = HEADER + "".join("\t".join(r) + "\n" for r in kept)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = sequences.ordered_lines(spark, str(tmp_path / "a.sam"))
        assert lines.rdd.getNumPartitions() > 3
        modtags.write_in_order(modtags.rewrite_sam(lines, tags), str(tmp_path / "made"))
        modtags.write_in_order(modtags.rewrite_sam(lines, tags.limit(0)), str(tmp_path / "none"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("made") == want and read("none") == HEADER


@pytest.mark.parametrize("end", ["\n", ""])
def test_indexed_references_read_wanted_contigs_only(spark, tmp_path, end):
    from modcall.sources import fasta

    rng, contigs = random.Random(3), {}
    for i, n in enumerate([5000, 60, 61, 0, 1, 2049, 1024, 1032, 300_000, 17]):
        contigs[f"c{i}"] = "".join(rng.choice("acgtN") for _ in range(n))
    text = "".join(f">{name} some > words\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60)) for name, seq in contigs.items())
    path = tmp_path / "r.fa"
    path.write_text(text[:-1] + end)
    fasta.write_index(spark, str(path), str(tmp_path / "index"), 7000)
    listed = {r._c0: int(r._c1) for r in spark.read.csv(str(tmp_path / "index"), sep="\t").collect()}
    assert listed == {k: len(v) for k, v in contigs.items()}
    tiles = fasta.read_tiles(spark, str(path), str(tmp_path / "index"), 5000)
    got = {(r.contig, r.tile): r.part for r in tiles.collect()}
    assert got == {(k, t): v.upper()[t * 1024 : t * 1024 + 1032] for k, v in contigs.items() for t in range(-(-len(v) // 1024))}
    some = tiles.where(F.col("contig").isin("c1", "c8") & (F.col("tile") < 2))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "c8" not in plan and "Filter" in plan and "tile" in plan  # the source has taken the contigs, Spark filters the rest
    assert sorted((r.contig, r.tile) for r in some.collect()) == [("c1", 0), ("c8", 0), ("c8", 1)]
    one = tiles.where("contig = 'c0'")
    path.write_text(text.replace(contigs["c8"][:100].replace("\n", ""), "x"))  # damage elsewhere is not even looked at
    assert one.count() == 5
    # an index of five columns, as other tools write it, and windows on the tiles
    path.write_text(">a x\nACGTACGTAC\nGTACGTTTTT\nAC\n")
    (tmp_path / "r.fa.fai").write_text("a\t22\t5\t10\t11\n")
    from modcall.operators import readlevel

    rows = spark.createDataFrame([("a", 0), ("a", 13), ("a", 14), ("b", 0)], "contig string, start int")
    found = {r.start: r.reference_ninemer for r in readlevel.reference_ninemers(rows, fasta.read_tiles(spark, str(path))).collect()}
    assert found == {0: "ACGTACGTA", 13: "CGTTTTTAC"}


def test_pushed_filters_leave_other_contigs_out(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from modcall.sources.fasta import FastaSource

    (tmp_path / "x.fa").write_text(">a\nAC\n>b\nGT\n>c\nTT\n")
    (tmp_path / "x.fa.fai").write_text("a\t2\t3\t2\t3\nb\t2\t9\t2\t3\nc\t2\t15\t2\t3\n")
    reader = FastaSource({"path": str(tmp_path / "x.fa")}).reader(None)
    rest = list(reader.pushFilters([In(("contig",), ("a", "b")), GreaterThan(("tile",), 0), EqualTo(("contig",), "b")]))
    assert rest == [GreaterThan(("tile",), 0)]
    assert [piece[1] for part in reader.partitions() for piece in part.pieces] == ["b"]


def test_short_ranges_do_not_make_a_task_each(tmp_path):
    header = bam.header_bytes("@SQ\tSN:c\tLN:9\n", [("c", 9)])
    rows = [(f"r{i * 7919 % 100003}", 0, "c", i, 0, "4M", "*", -1, 0, "ACGT", "*", []) for i in range(20000)]
    with open(tmp_path / "a.bam", "wb") as out:
        bam.write_records(out, header, (bam.encode(r, {"c": 0}) for r in rows))
    reader = bam._Reader({"path": str(tmp_path / "a.bam"), "rangebytes": "500"})
    parts = reader.partitions()
    assert 10 < len(parts) <= 66
    assert [n for p in parts for b in reader.read(p) for n in b.column(0).to_pylist()] == [r[0] for r in rows]
