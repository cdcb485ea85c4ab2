"""Registered queries on records longer than any cut."""

from lociq.plans import fetch_queries, output_queries
from lociq.sources import catalog

GENES = [(1, "BruaN", "g", "g-1", "M" * 70), (2, "PhooI", "g", "g-2", "K" * 45), (3, "ZmoJ", "g", "g-3", "L" * 100), (4, "BruaN", "h", "h-1", "A" * 90), (5, "ZmoJ", "h", "h-2", "C" * 31), (6, "SteoI", "k", "k-1", "D" * 50), (7, "BruaN", "g", "g-4", "E" * 40)]


def test_markers_are_joined_whole(spark, monkeypatch):
    df = spark.createDataFrame(GENES, "ID int, domain string, genomeID string, proteinID string, sequence string")
    monkeypatch.setattr(fetch_queries, "_genes_with_domains", lambda *_: df)
    whole = {"g": "M" * 70 + "E" * 40 + "K" * 45 + "L" * 100}
    assert dict(map(tuple, fetch_queries.jn16_concat_inner(spark, "").collect())) == whole
    assert dict(map(tuple, fetch_queries.jn16_concat_gapfill(spark, "").collect())) == whole | {"h": "A" * 90 + "-" * 45 + "C" * 31}


def test_keyword_files_hold_records(spark, tables):
    rows = output_queries.snk4_keyword_fasta(spark, tables).collect()
    genes = {p.proteinID: p for p in catalog.proteins(spark, tables).where("sequence IS NOT NULL").collect()}
    blocks = fetch_queries.cmb2_keyword_subsets(spark, tables).collect()
    assert rows and sorted((r.subset, r.proteinID) for r in rows) == sorted((b.subset, i) for b in blocks for i, p in genes.items() if p.clusterID == b.clusterID)
    for r in rows:
        header, sequence = r.record.split("\n")
        assert header.split(" ")[0] == f">{genes[r.proteinID].genomeID}-{r.proteinID}"
        assert sequence == genes[r.proteinID].sequence.replace("*", "")
    known = {r.record for r in output_queries.snk2_architecture_fasta(spark, tables).collect()}
    assert any(r.record in known for r in rows)
