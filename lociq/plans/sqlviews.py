"""SQL of the catalog's tables, put before the oracle of a query."""

from lociq.schemas import RANKS

_T = "trim({}, ' ' || chr(9))".format

PROTEIN = f"""protein AS (
  SELECT proteinID, min(genomeID) AS genomeID, min(clusterID) AS clusterID, min(locustag) AS locustag, min(contig) AS contig, min(s) AS s, min(e) AS e, min(strand) AS strand, min(dom_count) AS dom_count, min(sequence) AS sequence
  FROM (SELECT proteinID, {_T('genomeID')} AS genomeID, CASE WHEN {_T('clusterID')} NOT IN ('', 'NULL') THEN {_T('clusterID')} END AS clusterID, nullif(locustag, '') AS locustag, nullif({_T('contig')}, '') AS contig,
    CASE WHEN "start" IS NULL OR "end" IS NULL THEN coalesce("start", "end") ELSE least("start", "end") END AS s, CASE WHEN "start" IS NULL OR "end" IS NULL THEN coalesce("start", "end") ELSE greatest("start", "end") END AS e,
    nullif(strand, '') AS strand, dom_count, nullif(regexp_replace(upper(regexp_replace(sequence, '\\s', '', 'g')), '\\*$', ''), '') AS sequence FROM proteins) GROUP BY proteinID)"""
PLACED = "placed AS (SELECT * FROM protein WHERE contig IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL)"
DOMAIN = f"""domain_ AS (
  SELECT ID, min(proteinID) AS proteinID, min({_T('domain')}) AS domain, min(score) AS score, min(least(domStart, domEnd)) AS domStart, min(greatest(domStart, domEnd)) AS domEnd
  FROM domains WHERE {_T('domain')} <> '' GROUP BY ID)"""
GENOME = f"""genome AS (
  SELECT {_T('genomeID')} AS genomeID, {', '.join(f"min(coalesce({r}, 'NULL')) AS {r}" for r in RANKS)}, min(Strain) AS Strain, min(TypeStrain) AS TypeStrain, min(Completeness) AS Completeness, min(Contamination) AS Contamination,
    min(NCBITaxon) AS NCBITaxon, min(NCBIBioproject) AS NCBIBioproject, min(NCBIBiosample) AS NCBIBiosample, min(NCBIAssembly) AS NCBIAssembly FROM genomes WHERE deleted_at IS NULL GROUP BY 1)"""
CLUSTER = f"cluster_ AS (SELECT DISTINCT {_T('clusterID')} AS clusterID, split_part({_T('genomeID')}, '.', 1) AS genomeID FROM clusters WHERE deleted_at IS NULL)"
KEYWORD = f"""keyword_ AS (SELECT ID, min({_T('clusterID')}) AS clusterID, min(keyword) AS keyword, min(completeness) AS completeness, min(collinearity) AS collinearity FROM keywords
  WHERE {_T('clusterID')} NOT IN ('', 'NULL') AND keyword IS NOT NULL GROUP BY ID)"""
PATTERN = "pattern AS (SELECT pattern_id, keyword, list_filter([gene_1, gene_2, gene_3, gene_4, gene_5, gene_6, gene_7, gene_8, gene_9], lambda g: g IS NOT NULL) AS genes FROM patterns)"
#: Blocks of placed proteins at most 3500 apart: block, and what names them.
BLOCK = """stepped AS (
  SELECT *, CASE WHEN s - lag(e) OVER w <= 3500 THEN 0 ELSE 1 END AS brk FROM placed WINDOW w AS (PARTITION BY genomeID, contig ORDER BY s, e, proteinID)),
island AS (SELECT *, sum(brk) OVER (PARTITION BY genomeID, contig ORDER BY s, e, proteinID ROWS UNBOUNDED PRECEDING) AS island FROM stepped),
sized AS (SELECT *, count(*) OVER (PARTITION BY genomeID, contig, island) AS members FROM island),
block AS (SELECT proteinID, genomeID, contig, s, e, genomeID || '_' || dense_rank() OVER (PARTITION BY genomeID ORDER BY contig, island) AS block FROM sized WHERE members > 1)"""
#: Kept domains of each protein by the overlap fold, in input order.
FOLD = """ordered AS (
  SELECT proteinID, list({'s': domStart, 'e': domEnd, 'd': domain, 'c': CAST(score AS DOUBLE)} ORDER BY ID) AS xs FROM domain_ WHERE domStart IS NOT NULL AND domEnd IS NOT NULL AND score IS NOT NULL GROUP BY proteinID),
folded AS (
  SELECT proteinID, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE
      WHEN len(list_filter(a, lambda y: y.s <= b[1].e AND b[1].s <= y.e AND NOT (floor(y.c) < b[1].c))) > 0 THEN a
      ELSE list_concat(list_filter(a, lambda y: NOT (y.s <= b[1].e AND b[1].s <= y.e)), b) END) AS kept FROM ordered),
fold AS (SELECT proteinID, unnest(list_sort(kept)) AS k FROM folded),
arch AS (
  SELECT proteinID, string_agg(k.d, '-' ORDER BY k.s, k.e, k.d) AS arch, string_agg(k.s || ':' || k.e, '-' ORDER BY k.s, k.e, k.d) AS coords, string_agg(CAST(floor(k.c) AS INTEGER), '-' ORDER BY k.s, k.e, k.d) AS scores, count(*) AS n_domains FROM fold GROUP BY proteinID)"""
#: Tokens of the genes of each block, in order.
TOKEN = """token AS (
  SELECT proteinID, CASE WHEN regexp_matches(arch, '\\w+_(\\w+$)') THEN regexp_extract(arch, '\\w+_(\\w+$)', 1) ELSE arch END AS token FROM arch),
blocktok AS (SELECT block, list(token ORDER BY s, e, proteinID) AS tokens FROM block JOIN token USING (proteinID) GROUP BY block)"""
MATCH = """cand AS (SELECT b.block, b.tokens, p.* FROM blocktok b JOIN pattern p ON len(list_filter(p.genes, lambda g: list_contains(b.tokens, g))) > 0),
scored AS (
  SELECT block, tokens, pattern_id, keyword, genes, len(list_filter(list_distinct(genes), lambda g: list_contains(tokens, g))) / len(list_distinct(genes)) AS completeness,
    list_transform(list_filter(genes, lambda g: list_contains(tokens, g)), lambda g: list_position(tokens, g)) AS places FROM cand),
match_ AS (SELECT block, tokens, pattern_id, keyword, genes, completeness, (places = list_sort(places) OR places = list_reverse_sort(places)) AS collinear FROM scored WHERE completeness > 0.5),
named AS (SELECT block, keyword, arg_max(completeness, pattern_id) AS completeness, arg_max(collinear, pattern_id) AS collinear FROM match_ GROUP BY block, keyword)"""


def sql(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
