"""Readers, writers, store changes, streaming, and tables built out of files."""

import gzip

import pytest
from pyspark.sql import functions as F

from lociq.functions import render
from lociq.ingest import build, sequence_set
from lociq.operators import filters, matrix, sequences, store
from lociq.sources import catalog, readers, runs, sinks, tables
from lociq.streaming import ingest

REPORT = """# search :: search profile(s) against a sequence database
Query:       AprM  [M=120]
Scores for complete sequences (score includes all domains):
   --- full sequence ---   --- best 1 domain ---    -#dom-
    E-value  score  bias    E-value  score  bias    exp  N  Sequence Description
    ------- ------ -----    ------- ------ -----   ---- --  -------- -----------
    1.2e-30  105.7   0.1    1.5e-30  105.4   0.1    1.1  1  p1       first protein
    2.0e-05   30.2   0.0    2.5e-05   30.0   0.0    1.0  1  p2

Domain annotation for each sequence (and alignments):
>> p1  first protein
   #    score  bias  c-Evalue  i-Evalue hmmfrom  hmm to    alifrom  ali to    envfrom  env to     acc
 ---   ------ ----- --------- --------- ------- -------    ------- -------    ------- -------    ----
   1 !   20.0   0.1   1.5e-10   1.5e-09       2      40 ..       1      39 [.       1      40 [. 0.90
   2 !   85.4   0.1   1.5e-30   1.5e-29       2     118 ..      51     170 ..      50     172 .. 0.98

>> p2
   #    score  bias  c-Evalue  i-Evalue hmmfrom  hmm to    alifrom  ali to    envfrom  env to     acc
 ---   ------ ----- --------- --------- ------- -------    ------- -------    ------- -------    ----
   1 ?   30.0   0.0   2.5e-05   2.5e-04       5      60 ..      11      66 ..      10      70 .. 0.80

Query:       AsrA  [M=90]
Scores for complete sequences (score includes all domains):
   --- full sequence ---   --- best 1 domain ---    -#dom-
    E-value  score  bias    E-value  score  bias    exp  N  Sequence Description
    ------- ------ -----    ------- ------ -----   ---- --  -------- -----------
    3.0e-20   80.0   0.0    3.0e-20   80.0   0.0    1.0  1  p2

Domain annotation for each sequence (and alignments):
>> p2
   #    score  bias  c-Evalue  i-Evalue hmmfrom  hmm to    alifrom  ali to    envfrom  env to     acc
 ---   ------ ----- --------- --------- ------- -------    ------- -------    ------- -------    ----
   1 !   80.0   0.0   3.0e-20   3.0e-19       1      90 []     101     190 ..     101     190 .. 0.99
//
"""
GFF = """##gff-version 3
NC_1\tx\tCDS\t100\t400\t.\t+\t0\tID=cds-p1;locus_tag=L_1;product=a
NC_1\tx\tCDS\t600\t900\t.\t-\t0\tID=p2;Name=b;locus_tag=L_2
NC_1\tx\tCDS\t605\t905\t.\t-\t0\tID=p2;Name=b;locus_tag=L_2b
NC_1\tx\tgene\t1\t9\t.\t-\t0\tName=none
"""
FASTA = ">p1 first protein\nMKV\nLL*\n>p2\r\nACD EF\r\n>p3 empty\n"


@pytest.fixture
def inputs(tmp_path):
    for d in ("reports", "features", "proteins"):
        (tmp_path / d).mkdir()
    (tmp_path / "reports/G1.1.txt").write_text(REPORT)
    (tmp_path / "features/G1.1.gff").write_text(GFF)
    with gzip.open(tmp_path / "proteins/G1.1.faa.gz", "wt", newline="") as f:
        f.write(FASTA)
    (tmp_path / "thresholds").write_text("AprM\t40\t100\t35.2\nAsrA\t50\t90\t40\nbad line\n")
    (tmp_path / "patterns").write_text("apr\tAprM\tAsrA\n\n two words \t A sr A\tX\n")
    return tmp_path


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fasta(spark, inputs):
    f = readers.fasta(spark, str(inputs / "proteins"))
    assert rows(f, "id", "description", "seq") == [("p1", "p1 first protein", "MKVLL*"), ("p2", "p2", "ACDEF"), ("p3", "p3 empty", "")]


def test_gff_last_line_counts(spark, inputs):
    g = readers.gff(spark, str(inputs / "features"))
    assert rows(g, "id", "contig", "start", "end", "strand", "locustag") == [("p1", "NC_1", 100, 400, "+", "L_1"), ("p2", "NC_1", 605, 905, "-", "L_2b")]


def test_report(spark, inputs):
    h = readers.hmmer_report(spark, str(inputs / "reports"))
    assert rows(h, "query", "hit_id", "hit_score", "evalue", "hsp_ord", "hsp_score", "hsp_start", "hsp_end") == [
        ("AprM", "p1", 105.7, 1.2e-30, 1, 20.0, 0, 39), ("AprM", "p1", 105.7, 1.2e-30, 2, 85.4, 50, 170),
        ("AprM", "p2", 30.2, 2e-5, 1, 30.0, 10, 66), ("AsrA", "p2", 80.0, 3e-20, 1, 80.0, 100, 190),
    ]
    assert readers.significant(h, 1e-10).count() == 3


def test_attributes(spark):
    v = spark.createDataFrame([("Parent=ID=x; ID = y",), ("xID=no;locus_tag=L 1; ID=cds-z=1",), ("",), (None,)], "v string")
    assert [tuple(r) for r in v.select(readers.attribute("v", "ID"), readers.attribute("v", "locus_tag")).collect()] == [(None, None), ("cds-z=1", "L 1"), (None, None), (None, None)]


def test_dictionaries(spark, inputs):
    assert rows(readers.threshold_table(spark, str(inputs / "thresholds")), "hmm", "optimized", "trusted", "noise") == [("AprM", 40.0, 100.0, 35.2), ("AsrA", 50.0, 90.0, 40.0)]
    p = readers.pattern_table(spark, str(inputs / "patterns"))
    assert [(r.keyword, r.genes) for r in p.orderBy("pattern_id").collect()] == [("apr", ["AprM", "AsrA"]), ("twowords", ["AsrA", "X"])]
    c = readers.combination_table(spark, str(inputs / "patterns"))
    assert [r.features for r in c.orderBy("combo_id").collect()][0] == ["apr", "AprM", "AsrA"]


def test_pairing_of_files(spark, inputs):
    faa, gff = readers.files(spark, str(inputs / "proteins"), "*.faa*"), readers.files(spark, str(inputs / "features"))
    assert rows(readers.queue(faa, gff), "stem") == [("G1",)]
    assert readers.unmatched(faa, gff).count() == 0
    assert readers.queue(faa, gff, spark.createDataFrame([("G1",)], "genomeID string")).count() == 0


def test_prodigal_headers(spark):
    r = spark.createDataFrame([("NC_2_7 # 10 # 90 #  1  # ID=1_7",), ("NC_2_8 # 100 # 190 # -1 # ID=1_8",), ("plain",)], "description string")
    assert rows(readers.prodigal_features(r), "id", "contig", "start", "end", "strand") == [("NC_2_7", "NC_2", 10, 90, "+"), ("NC_2_8", "NC_2", 100, 190, "-")]


def test_metadata(spark, tmp_path):
    names = ["accession", "gtdb_taxonomy", "checkm_completeness", "checkm_contamination", "ncbi_taxid", "ncbi_bioproject", "ncbi_biosample", "ncbi_genbank_assembly_accession", "gtdb_type_designation", "ncbi_strain_identifiers", "other"]
    row = ["RS_GCF_1.1", "d__B;p__P;c__C;o__O;f__F;g__G;s__G s", "99.5", "x", "7", "PR", "BS", "GCA_1.1", "type strain of species", "S 1", "-"]
    (tmp_path / "m.tsv").write_text("\t".join(names) + "\n" + "\t".join(row) + "\n" + "\t".join(["RS_GCF_2.1", *row[1:]]) + "\n")
    g = readers.gtdb_metadata(spark, str(tmp_path / "m.tsv"), spark.createDataFrame([("RS_GCF_1",)], "genomeID string"))
    r = g.collect()
    assert len(r) == 1 and tuple(r[0])[:9] == ("RS_GCF_1", "B", "", "P", "C", "O", "F", "G", "G s") and r[0].TypeStrain == 1 and r[0].Completeness == 99.5 and r[0].Contamination is None
    cols = "genomeID superkingdom clade phylum class order family genus species strain taxid biosample bioproject genbank refseq completeness contamination typestrain".split()
    (tmp_path / "c.tsv").write_text("\t".join(cols) + "\n" + "\t".join(["G.1", "B", "", "P", "C", "O", "F", "G", "s", "S", "7", "", "", "", "", "9.5", "1", "yes"]) + "\n")
    r = readers.custom_metadata(spark, str(tmp_path / "c.tsv")).first()
    assert (r.genomeID, r.Class, r.NCBITaxon, r.TypeStrain, r.Completeness) == ("G", "C", 7, 1, 9.5)
    (tmp_path / "rep").mkdir()
    (tmp_path / "rep/G7_assembly_report.txt").write_text("# Taxid:          1234\n# BioSample:      SAMN1\n# GenBank assembly accession: GCA_9.1\n")
    r = readers.assembly_reports(spark, str(tmp_path / "rep")).first()
    assert (r.taxid, r.biosample, r.genbank, r.refseq) == (1234, "SAMN1", "GCA_9.1", None)
    (tmp_path / "s.tsv").write_text("Assembly Accession\tTaxonomy id\nGCF_1.2\t77\n")
    assert tuple(readers.assembly_summary(spark, str(tmp_path / "s.tsv")).first()) == ("GCF_1", "GCF_1.2", 77)
    (tmp_path / "log.tsv").write_text("G1\tdone\nG1\tdone\nG2\tdone\n")
    assert readers.processed(spark, str(tmp_path / "log.tsv")).count() == 2
    (tmp_path / "m.hmm").write_text("HMMER3/f\nNAME  AprM\nLENG  120\nALPH  amino\nNSEQ  9\nHMM  A C\n")
    assert tuple(readers.models(spark, str(tmp_path / "m.hmm")).first())[1:] == ("AprM", 120, "amino", 9)


def test_lineages(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "superkingdom"), (3, 2, "phylum"), (4, 3, "species")], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(1, "root"), (2, "B"), (3, "P"), (4, "s")], "taxid int, name string")
    out = readers.lineages(nodes, names, spark.createDataFrame([(4,), (3,), (9,)], "taxid int"))
    assert rows(out, "taxid", "rank", "name") == [(3, "phylum", "P"), (3, "superkingdom", "B"), (4, "phylum", "P"), (4, "species", "s"), (4, "superkingdom", "B")]
    assert {r.taxid: r.phylum for r in readers.by_rank(out).collect()} == {3: "P", 4: "P"}
    with pytest.raises(ValueError):
        readers.lineages(spark.createDataFrame([(1, 2, "x"), (2, 1, "x")], "taxid int, parent int, rank string"), names, spark.createDataFrame([(1,)], "taxid int"), depth=5)


def test_tables_out_of_files(spark, inputs):
    t = build(spark, str(inputs / "reports"), str(inputs / "features"), str(inputs / "proteins"), str(inputs / "thresholds"), str(inputs / "patterns"))
    assert rows(t["proteins"], "proteinID", "genomeID", "clusterID", "contig", "start", "sequence") == [("G1-p1", "G1", "G1_1", "NC_1", 100, "MKVLL*"), ("G1-p2", "G1", "G1_1", "NC_1", 605, "ACDEF")]
    assert rows(t["domains"], "proteinID", "domain", "score", "domStart", "domEnd") == [("G1-p1", "AprM", 105, 50, 170), ("G1-p2", "AsrA", 80, 100, 190)]
    assert rows(t["keywords"], "clusterID", "keyword", "completeness", "collinearity") == [("G1_1", "apr", 1.0, True)]


def test_rescued_hit_has_the_score_of_its_best_part(spark, inputs):
    """AsrA of p2 falls below the cutoff; the block of p1 and p2 (named by AprM of both) lacks it."""
    (inputs / "thresholds").write_text("AprM\t20\t100\t35.2\nAsrA\t90\t90\t40\n")
    (inputs / "reports/G1.1.txt").write_text(REPORT.replace("3.0e-20   80.0   0.0    3.0e-20   80.0", "3.0e-20   80.0   0.0    3.0e-20   77.0").replace("1 !   80.0", "1 !   77.0"))
    (inputs / "patterns").write_text("apr\tAprM\tAsrA\tX\n")
    args = (spark, *(str(inputs / x) for x in ("reports", "features", "proteins", "thresholds", "patterns")))
    known = build(*args, least=0.3)
    assert rows(known["domains"], "proteinID", "domain", "score") == [("G1-p1", "AprM", 105), ("G1-p2", "AprM", 30), ("G1-p2", "AsrA", 77)]
    assert rows(build(*args, least=0.3, complete=False)["domains"], "domain", "score") == [("AprM", 30), ("AprM", 105)]
    n = known["keywords"].first()
    assert (n.keyword, round(n.completeness, 3)) == ("apr", 0.333)  # p2 is a fusion now and no gene of a pattern


def test_store_answers_queries_from_its_files(spark, inputs, tmp_path):
    """Tables built from files are stored and queried; predicates reach the scan."""
    from lociq.__main__ import run
    from lociq.plans import fetch, fetch_queries, gene_queries, output_queries, record_queries

    out = str(tmp_path / "store")
    run(spark, ["build", *(str(inputs / x) for x in ("reports", "features", "proteins", "thresholds", "patterns")), out, "--log", str(tmp_path / "log")])
    assert tables.is_store(spark, out) and rows(readers.processed(spark, str(tmp_path / "log")), "genomeID") == [("G1",)]
    assert rows(gene_queries.int1_overlap_fold(spark, out), "proteinID", "domain", "score") == [("G1-p1", "AprM", 105), ("G1-p2", "AsrA", 80)]
    hit = gene_queries.snk1_hit_table(spark, out).collect()
    assert [(h.proteinID, h.arch, h.keywords, h.completeness, h.csb, h.lineage) for h in hit] == [(f"G1-p{i}", a, "apr", "1.0", "1", "_".join(["NULL"] * 8)) for i, a in ((1, "AprM"), (2, "AsrA"))]
    assert rows(fetch_queries.jn4_keywords_of_genomes(spark, out), "keyword", "genomeID") == [("apr", "G1")]
    assert rows(fetch_queries.agg2_domain_counts(spark, out), "domain", "n") == [("AprM", 1), ("AsrA", 1)]
    assert record_queries.p1_found(spark, out).count() == 0
    assert rows(output_queries.prj7_header_tokens(spark, out), "id", "keywords") == [("G1-G1-p1", "apr"), ("G1-G1-p2", "apr")]
    assert rows(fetch.fetch(spark, out, domains=["sra"]), "proteinID") == [("G1-p2",)]
    plan = lambda q: q(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(dom_count,1)" in plan(fetch_queries.flt12_multi_domain) and "Exchange" not in plan(fetch_queries.flt12_multi_domain)
    for more in (["redo", out, str(inputs / "patterns"), str(tmp_path / "again")], ["redo", out, str(inputs / "patterns"), str(tmp_path / "names"), "--names-only"], ["compact", out, str(tmp_path / "copy")]):
        run(spark, more)
        assert rows(gene_queries.snk1_hit_table(spark, more[-1] if more[-1][0] == "/" else more[-2]), "proteinID", "clusterID", "keywords", "csb") == [(f"G1-p{i}", "G1_1", "apr", "1") for i in (1, 2)]
    run(spark, ["delete", out, str(tmp_path / "less"), "--proteins", "G1-p1"])
    assert rows(fetch_queries.jn1_left_join(spark, str(tmp_path / "less")), "proteinID", "domain") == [("G1-p2", "AsrA")]
    run(spark, ["delete", out, str(tmp_path / "none"), "--genomes", "G1"])
    assert fetch_queries.jn1_left_join(spark, str(tmp_path / "none")).count() == 0


def test_filters_of_raw_tables_reach_the_scan(spark, tables_dir):
    from lociq.plans import fetch_queries

    for q, predicate in ((fetch_queries.flt12_multi_domain, "GreaterThan(dom_count,1)"), (fetch_queries.flt3_or_ilike_domain, "wexa")):
        plan = q(spark, tables_dir)._jdf.queryExecution().executedPlan().toString()
        at = plan.rindex(predicate) if predicate in plan else plan.lower().rindex(predicate)
        assert plan[at:].count("Exchange") == 0, plan  # nothing is shuffled below it
        assert "sequence" not in plan


def test_commands(spark, inputs, tmp_path, tables_dir, capsys):
    from lociq.__main__ import run

    out = str(tmp_path / "f")
    run(spark, ["fetch", tables_dir, out, "--domain", "Drai", "--keyword", "mt", "ox", "--limit-rank", "Superkingdom", "bacteria"])
    hits = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/hits")
    assert hits.count() > 0 and hits.where("arch LIKE '%Drai%'").count() == hits.count() and hits.where("keywords IS NULL").count() < hits.count()
    records = readers.fasta(spark, f"{out}/architectures")
    assert records.count() > 0 and records.where("id NOT LIKE '%-%'").count() == 0
    assert spark.read.text(f"{out}/keywords").count() > 0
    run(spark, ["dataset", tables_dir, f"{out}/d", "--domain", "BruaN", "PhooI", "--fusion", "BruaN+PhooI", "--in-block", "SteoI", "mt", "--combine", "2"])
    m = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/d/matrix")
    assert m.columns[:5] == ["genomeID", "BruaN", "PhooI", "BruaN+PhooI", "SteoI@mt"] and len(m.columns) == 10
    run(spark, ["stats", tables_dir, "--out", f"{out}/s"])
    assert "Domains" in capsys.readouterr().out and spark.read.option("sep", "\t").option("header", True).csv(f"{out}/s/Species").count() > 0
    (tmp_path / "h.faa").write_text(">NC_2_7 # 10 # 90 # 1 # ID=1_7\nMK\n")
    run(spark, ["features", str(tmp_path / "h.faa"), str(tmp_path / "g")])
    assert rows(readers.gff(spark, str(tmp_path / "g")), "id", "contig", "start", "end", "strand") == [("NC_2_7", "NC_2", 10, 90, "+")]
    cols = "genomeID superkingdom clade phylum class order family genus species strain taxid biosample bioproject genbank refseq completeness contamination typestrain".split()
    g = catalog.genomes(spark, tables_dir).orderBy("genomeID").first().genomeID
    (tmp_path / "c.tsv").write_text("\t".join(cols) + "\n" + "\t".join([g, "B", "", "New", "C", "O", "F", "G", "s", "S", "7", "", "", "", "", "9.5", "1", "yes"]) + "\n")
    run(spark, ["taxonomy", tables_dir, "custom", str(tmp_path / "c.tsv"), str(tmp_path / "t")])
    assert rows(catalog.genomes(spark, str(tmp_path / "t")).where("Phylum = 'New'"), "genomeID", "NCBITaxon") == [(g, 7)]


def test_result_folders(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 2, 3, 4, 5)
    a, b = (runs.result_folder(spark, str(tmp_path), at=at) for _ in range(2))
    assert a.endswith("run_2024-01-02_03-04-05") and b == a + "_2"
    (tmp_path / "x").mkdir()
    (tmp_path / "x/part-1").write_text("")
    (tmp_path / "x/part-2").write_text("a")
    assert sinks.remove_empty(spark, str(tmp_path / "x")) == 1 and (tmp_path / "x/part-2").exists()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "A", "MK*"), ("b", "B-A", "LL")], "id string, arch string, seq string")
    sinks.write_fasta(df, str(tmp_path / "f"), ["id", "arch"], by="arch")
    back = readers.fasta(spark, str(tmp_path / "f"))
    assert rows(back, "description", "seq") == [("a A", "MK"), ("b B-A", "LL")]
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["arch=A", "arch=B-A"]
    m = spark.createDataFrame([("g", 1, 0)], "genomeID string, x int, y int")
    g = spark.createDataFrame([("g", *["r"] * 8)], "genomeID string, Superkingdom string, Clade string, Phylum string, Class string, Ordnung string, Family string, Genus string, Species string")
    line = sinks.binary_rows(m, g, ["x", "y"])
    assert line.first().line == "g_" + "_".join("r" * 8) + "\t1\t0"
    sinks.write_dataset(line, str(tmp_path / "d"), sinks.binary_header(["x", "y"]))
    head = [r[0] for r in spark.read.text(str(tmp_path / "d/header")).collect()]
    # Every line but the first and the last is a setting and its values, all under one separator.
    assert head[0] == "DATASET_BINARY" and head[1] == "SEPARATOR TAB" and head[-1] == "DATA" and "FIELD_LABELS\tx\ty" in head and "FIELD_SHAPES\t2\t2" in head
    assert all("\t" in x and "," not in x for x in head[2:-1])
    assert "LEGEND_TITLE\tmine" in sinks.binary_header(["x"], legend="mine") and sinks.symbol_header()[0] == "DATASET_SYMBOL" and sinks.domain_header()[-1] == "DATA"
    assert [sinks.color(s) for s in (0, 42, 84)] == ["#c53edf", "#390062", "#913274"]
    c = {r.label: r.color for r in sinks.colors(df.withColumn("o", F.monotonically_increasing_id()), "arch", ["o"]).collect()}
    assert c == {"A": "#c53edf", "B-A": "#390062"}
    assert sinks.symbol_rows(spark.createDataFrame([("n", "#ff0000")], "n string, c string"), "n", "c").first().line == "n\t2\t10\t#ff0000\t1\t1"
    p = spark.sql("SELECT 'p' AS proteinID, 'ABCDEFGH' AS sequence, array(named_struct('start', 0, 'end', 3, 'domain', 'X', 'score', 1), named_struct('start', 4, 'end', 6, 'domain', 'Y', 'score', 1)) AS domains")
    assert rows(sinks.fusion_parts(p), "domain", "part") == [("X", "ABC"), ("Y", "EF")]
    stats = spark.createDataFrame([("Phylum", "P", "x", 1)], "level string, taxon string, feature string, n int")
    sinks.write_rank_counts(stats, str(tmp_path / "r"), "n")
    assert (tmp_path / "r/level=Phylum").is_dir()


def test_matrix_keeps_zeros(spark):
    g = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q")], "genomeID string, Phylum string")
    f = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("a", "z")], "genomeID string, feature string")
    m = matrix.presence(g, f, ["x", "y"])
    assert rows(m, "*") == [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]
    assert rows(matrix.combined(m, ["x", "y"]), "genomeID", F.col("`x+y`")) == [("a", 1), ("b", 0), ("c", 0)]
    s = matrix.rank_statistics(g, m.where("genomeID <> 'c'"), ["x"], ["Phylum"])
    assert sorted(((r.taxon, r.n_present, r.n_selected, r.ratio) for r in s.collect()), key=str) == [("P", 1, 2, 0.5), ("Q", 0, 0, None)]


def test_sequence_sets(spark):
    r = spark.createDataFrame([("x", 2, "B"), ("x", 1, "A"), ("y", 1, "C")], "id string, ord int, seq string")
    assert rows(sequences.merge_first(r, ["ord"]), "id", "seq") == [("x", "A"), ("y", "C")]
    m = spark.createDataFrame([("f", 2, "g", "AA"), ("f", 1, "g", "CCCC"), ("h", 1, "g", "E"), ("f", 3, "k", "CC")], "file string, ord int, genome string, seq string")
    assert rows(sequences.concatenated(m, ["f", "h"]), "*") == [("g", "CCCCAAE")]
    assert rows(sequences.concatenated(m, ["h", "f"], gaps=True), "*") == [("g", "ECCCCAA"), ("k", "-CC")]
    n = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 1)], "g string, o int")
    assert rows(sequences.occurrence_names(n, "g", ["o"], "g"), "label") == [("g",), ("g_2",), ("g_3",), ("h",)]


def test_store_changes(spark):
    a = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    b = spark.createDataFrame([("b", "2"), ("c", "3"), ("c", "3")], "k string, v string")
    assert rows(store.insert_absent(a, b, "k"), "k") == [("a",), ("b",), ("c",)]
    assert rows(store.update(a, b, "k", ["v"]), "*") == [("a", "1"), ("b", "2")]
    assert rows(store.replace_for(a, b, spark.createDataFrame([("b",)], "k string"), "k"), "k") == [("a",), ("b",), ("c",), ("c",)]
    assert rows(store.rename_where(b, "v", "3", "4", spark.createDataFrame([("c",)], "k string"), "k"), "*") == [("b", "2"), ("c", "4"), ("c", "4")]


def test_predicates(spark):
    k = spark.createDataFrame([("a", "oxDsr"), ("a", "mtSo"), ("b", "OXD"), ("c", "x_y")], "g string, w string")
    assert rows(filters.has_all(k, "g", "w", ["ox", "MT"]), "g") == [("a",)]
    assert rows(k.where(filters.any_like("w", ["x_y"])), "g") == [("c",)]
    assert k.where(filters.any_like("w", [])).count() == 0
    words = spark.createDataFrame([(["abc", "x"],), (["zabc"],)], "w array<string>")
    assert words.where(filters.any_word("w", "ab")).count() == 1
    assert spark.range(1).select(render.genome_of(F.lit("a.b"))).first()[0] == "a"


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_stream_keeps_all_rows_of_a_genome(spark, tmp_path, per_batch):
    """A genome whose files fall into several batches loses nothing; of a protein stored twice the first row stays whole."""
    from lociq.schemas import DOMAINS, PROTEINS

    def put(*proteins):
        r = [(f"{g}-{p}", g, None, tag, "c", 1, 2, "+", 1, None if tag == "old" else "MK", None) for g, p, tag in proteins]
        spark.createDataFrame(r, PROTEINS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(("a", "p", "old"))
    put(("a", "q", "x"), ("b", "p", "x"))
    go = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=per_batch).awaitTermination()
    go()
    put(("b", "r", "x"), ("a", "p", "new"))
    go()
    go()
    assert rows(ingest.stored(spark, str(tmp_path / "out")), "proteinID", "locustag") == [("a-p", "old"), ("a-q", "x"), ("b-p", "x"), ("b-r", "x")]
    assert ingest.stored(spark, str(tmp_path / "out")).where("proteinID = 'a-p'").first().sequence is None
    assert ingest.stored(spark, str(tmp_path / "out"), latest=True).where("proteinID = 'a-p'").first().locustag == "new"
    spark.createDataFrame([(1, "a-p", "X", 5, 1, 9), (1, "a-p", "X", 5, 1, 9), (2, "a-p", "Y", 5, 1, 9)], DOMAINS).write.parquet(str(tmp_path / "din"))
    ingest.ingest(spark, str(tmp_path / "din"), str(tmp_path / "dout"), str(tmp_path / "dcheck"), "domains").awaitTermination()
    assert rows(ingest.stored(spark, str(tmp_path / "dout"), "domains"), "domain") == [("X",), ("Y",)]
    t = spark.sql("SELECT timestamp_ntz'2024-01-05 00:00:00' AS loaded_at")
    assert ingest.arrivals(t).first().n == 1


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.faa").write_text(">g-1 x\nAA\n>g-2\nCCCC\n>h-1\nDD\n")
    (tmp_path / "b.faa").write_text(">g-1 y\nEE\n>k-1\nFFF\n>h-2\nHH\n")
    files = [str(tmp_path / "a.faa"), str(tmp_path / "b.faa")]
    run = lambda action, **kw: sequence_set(spark, action, files, **kw)[1]
    assert rows(run("merge"), "id", "seq") == [("g-1", "AA"), ("g-2", "CCCC"), ("h-1", "DD"), ("h-2", "HH"), ("k-1", "FFF")]
    assert rows(run("filter", limits=(2, 4)), "id") == [("k-1",)]
    assert rows(run("singletons"), "id") == [("g-1",), ("h-1",), ("h-2",), ("k-1",)]
    assert rows(run("duplicates"), "id") == [("g-1",), ("g-2",)]
    assert rows(run("concat"), "genome", "seq") == [("g", "AACCCCEE"), ("h", "DDHH")]
    assert rows(run("concat-gaps"), "genome", "seq") == [("g", "AACCCCEE"), ("h", "DDHH"), ("k", "----FFF")]
