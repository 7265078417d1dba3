"""The same results in DuckDB SQL, written independently of the library."""

from __future__ import annotations

# Each lens is one common table expression; a statement names the ones it uses.
_LENSES = {
    "gene2pubmed": """
        SELECT CAST(substr(p_brand, 7) AS INT) AS tax_id, l_partkey AS gene_id, l_orderkey AS pmid
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "gene_info": """
        SELECT CAST(substr(p_brand, 7) AS INT) AS tax_id, p_partkey AS gene_id, p_name AS symbol,
               p_name || ' ' || p_brand AS description, p_type AS type_of_gene, p_type || ' ' || p_name AS full_name
        FROM part""",
    "pmid_dates": """
        SELECT o_orderkey AS pmid, CAST(year(o_orderdate) AS INT) AS year FROM orders""",
    "pmid_dates_multi": """
        SELECT l_orderkey AS pmid, CAST(year(l_shipdate) AS INT) AS year FROM lineitem""",
    "gene2refseq": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS tax_id, l_partkey AS gene_id,
               CASE WHEN l_suppkey % 13 = 0 THEN '-'
                    ELSE 'NM_' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.' || CAST(l_linenumber AS VARCHAR)
               END AS accession
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "named": """
        SELECT tax_id, gene_id, split_part(accession, '.', 1) AS refseq_id FROM gene2refseq""",
    "refgene": """
        SELECT name, chrom, strand, tx_start, tx_end, tx_start AS cds_start, tx_end AS cds_end, 2 AS exon_count,
               concat(tx_start, ',', tx_end - 1, ',') AS exon_starts, concat(tx_start + 1, ',', tx_end, ',') AS exon_ends,
               gene_name
        FROM (SELECT 'NM_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS name,
                     concat('chr', s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN '_alt' ELSE '' END) AS chrom,
                     CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, s_suppkey * 1000 AS tx_start,
                     s_suppkey * 1000 + CAST(floor(abs(s_acctbal)) AS BIGINT) + 1 AS tx_end, s_name AS gene_name
              FROM supplier)""",
    "exons": """
        SELECT l_partkey AS gene_id, concat('chr', l_partkey % 25) AS chrom,
               CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               l_partkey * 10000 + l_linenumber * 70 AS exon_start,
               l_partkey * 10000 + l_linenumber * 70 + CAST(floor(l_quantity) AS BIGINT)
                 + CASE WHEN l_linenumber % 3 = 0 THEN 30 ELSE 0 END AS exon_end
        FROM lineitem""",
    "chrom_info": """
        SELECT concat('chr', n_nationkey) AS chrom, CAST((n_nationkey * 37 % 11 + 1) * 1000000 AS BIGINT) AS length
        FROM nation""",
    "gene_diseases": """
        SELECT l_partkey AS "geneId", l_suppkey AS "diseaseId",
               CASE l_returnflag WHEN 'A' THEN 'GeneticVariation' WHEN 'N' THEN 'Biomarker' ELSE 'Therapeutic'
               END AS "associationType", count(*) AS "NumberOfPubmeds"
        FROM lineitem GROUP BY 1, 2, 3""",
    "links": """
        SELECT DISTINCT src, dst
        FROM (SELECT CAST(l_partkey AS VARCHAR) AS src,
                     CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN '-'
                          ELSE CAST(l_suppkey * 25 AS VARCHAR) END AS dst
              FROM lineitem)
        WHERE src <> '-' AND dst <> '-'""",
    # derived tables
    "dated": "SELECT pmid, max(year) AS year FROM pmid_dates GROUP BY pmid",
    "cited": """
        SELECT g.tax_id, g.gene_id, g.pmid, d.year, i.symbol, i.description, i.type_of_gene
        FROM gene2pubmed g JOIN gene_info i ON g.tax_id = i.tax_id AND g.gene_id = i.gene_id
             JOIN dated d ON g.pmid = d.pmid""",
    "by_year": """
        SELECT tax_id, gene_id, year, symbol, description, type_of_gene, count(*) AS citations
        FROM cited GROUP BY ALL""",
    "fanout": """
        SELECT i.gene_id, i.symbol, i.description, i.tax_id, d.year, count(*) AS citations
        FROM gene2pubmed g JOIN gene_info i ON g.gene_id = i.gene_id JOIN pmid_dates d ON g.pmid = d.pmid
        GROUP BY ALL""",
    "top20": """
        SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY citations DESC, gene_id, tax_id) - 1 AS INT) AS pos
        FROM by_year QUALIFY pos < 20""",
    "pairs": "SELECT DISTINCT gene_id, refseq_id FROM named WHERE refseq_id <> '-'",
    "owned": """
        SELECT refseq_id, min(gene_id) AS gene_id, arg_min(tax_id, gene_id) AS tax_id FROM named GROUP BY refseq_id""",
    "one_refseq": """
        SELECT tax_id, gene_id,
               coalesce(min(CASE WHEN refseq_id <> '-' THEN refseq_id END), '-') AS refseq_id
        FROM owned GROUP BY tax_id, gene_id""",
    "counts": "SELECT tax_id, gene_id, count(*) AS citations FROM gene2pubmed GROUP BY 1, 2",
    "counts_id": "SELECT gene_id, count(*) AS citations FROM gene2pubmed GROUP BY 1",
    "refseq_counts": """
        SELECT c.tax_id, c.gene_id, r.refseq_id, c.citations
        FROM counts c JOIN one_refseq r ON c.tax_id = r.tax_id AND c.gene_id = r.gene_id""",
    "offsets": """
        SELECT chrom, length, CAST(coalesce(sum(length) OVER (ORDER BY length DESC, chrom
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chrom_offset
        FROM chrom_info""",
    "positions": """
        SELECT r.*, o.chrom_offset, o.chrom_offset + tx_start AS genome_tx_start,
               o.chrom_offset + tx_end AS genome_tx_end, tx_end - tx_start AS gene_length
        FROM refgene r JOIN offsets o ON r.chrom = o.chrom
        WHERE NOT contains(r.chrom, '_') AND r.name <> ''""",
    "refgene_counts": """
        SELECT name, chrom, strand, tx_start, tx_end, genome_tx_start, genome_tx_end, cds_start, cds_end, exon_count,
               exon_starts, exon_ends, gene_name, citations,
               sha256(concat_ws('|', name, chrom, strand, tx_start, tx_end, citations)) AS uid
        FROM positions JOIN refseq_counts ON name = refseq_id""",
    "annotations": """
        SELECT r.chrom, r.tx_start, r.tx_end, i.symbol, c.citations, r.strand, p.refseq_id, p.gene_id, i.type_of_gene,
               i.full_name, r.cds_start, r.cds_end, r.exon_starts, r.exon_ends
        FROM pairs p JOIN counts_id c ON p.gene_id = c.gene_id JOIN gene_info i ON p.gene_id = i.gene_id
             JOIN refgene r ON r.name = p.refseq_id""",
    "transcript_years": """
        SELECT c.tax_id, c.gene_id, c.year, t.refseq_id, r.chrom, r.tx_start, r.tx_end, i.symbol, i.description,
               i.type_of_gene, c.citations
        FROM (SELECT g.tax_id, g.gene_id, d.year, count(DISTINCT g.pmid) AS citations
              FROM gene2pubmed g JOIN dated d ON g.pmid = d.pmid GROUP BY 1, 2, 3) c
             JOIN gene_info i ON i.tax_id = c.tax_id AND i.gene_id = c.gene_id
             JOIN (SELECT tax_id, gene_id, min(refseq_id) AS refseq_id FROM named
                   WHERE refseq_id IN (SELECT name FROM refgene WHERE NOT contains(chrom, '_')) GROUP BY 1, 2) t
               ON t.tax_id = c.tax_id AND t.gene_id = c.gene_id
             JOIN refgene r ON r.name = t.refseq_id""",
    "exon_marks": """
        SELECT *, CASE WHEN exon_start > max(exon_end) OVER (PARTITION BY gene_id, chrom, strand
                  ORDER BY exon_start, exon_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens
        FROM (SELECT DISTINCT * FROM exons)""",
    "exon_islands": """
        SELECT *, sum(opens) OVER (PARTITION BY gene_id, chrom, strand ORDER BY exon_start, exon_end
                  ROWS UNBOUNDED PRECEDING) AS island
        FROM exon_marks""",
    "exon_unions": """
        SELECT gene_id, chrom, strand, min(exon_start) AS exon_start, max(exon_end) AS exon_end
        FROM exon_islands GROUP BY gene_id, chrom, strand, island""",
    "bounds_of_years": "SELECT min(year) AS lo, max(year) AS hi FROM by_year",
    "type_values": """
        SELECT s.series, x.x, CAST(coalesce(sum(b.citations), 0) AS BIGINT) AS value
        FROM (SELECT DISTINCT type_of_gene AS series FROM by_year) s
             CROSS JOIN (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS x FROM bounds_of_years) x
             LEFT JOIN by_year b ON b.type_of_gene = s.series AND b.year = x.x
        GROUP BY 1, 2""",
    "symbol_values": """
        SELECT s.series, x.x, CAST(coalesce(min(b.citations), 0) AS BIGINT) AS value
        FROM (SELECT DISTINCT symbol AS series FROM top20) s
             CROSS JOIN (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS x FROM bounds_of_years) x
             LEFT JOIN top20 b ON b.symbol = s.series AND b.year = x.x
        GROUP BY 1, 2""",
    "layers": """
        SELECT series, x, CAST(value AS DOUBLE) AS value, p.position
        FROM type_values JOIN (
            SELECT series, row_number() OVER (ORDER BY onset NULLS LAST, series) - 1 AS position
            FROM (SELECT series, min(CASE WHEN value > 0 THEN x END) AS onset FROM type_values GROUP BY 1)) p
        USING (series)""",
    "stacked": """
        SELECT series, position, x, value, coalesce(sum(value) OVER (PARTITION BY x ORDER BY position
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM layers""",
    "changes": """
        SELECT *, value - lag(value, 1, 0) OVER (PARTITION BY position ORDER BY x) AS change FROM layers""",
    "wiggle": """
        SELECT x, sum(step) OVER (ORDER BY x) AS baseline
        FROM (SELECT x, CASE WHEN sum(value) = 0 THEN 0
                        ELSE -sum((change / 2 + below) * value) / sum(value) END AS step
              FROM (SELECT *, coalesce(sum(change) OVER (PARTITION BY x ORDER BY position
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM changes)
              GROUP BY x)""",
    "alternating": """
        SELECT series, position, x, value,
               CASE WHEN position % 2 = 0 THEN near ELSE -(near + value) END AS lower,
               CASE WHEN position % 2 = 0 THEN near + value ELSE -near END AS upper
        FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY x, position % 2 ORDER BY position
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS near FROM layers)""",
    "signed": """
        SELECT *, CASE WHEN position % 2 = 0 THEN value ELSE -value END AS s FROM alternating""",
    "signed_changes": """
        SELECT *, coalesce(s - lag(s) OVER (PARTITION BY position ORDER BY x), 0) AS change FROM signed""",
    "alt_wiggle": """
        SELECT x, sum(step) OVER (ORDER BY x) AS baseline
        FROM (SELECT x, CASE WHEN max(upper) = min(lower) THEN 0
                        ELSE -sum((change / 2 + below) * s) / (max(upper) - min(lower)) END AS step
              FROM (SELECT *, coalesce(sum(change) OVER (PARTITION BY x ORDER BY position
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM signed_changes)
              GROUP BY x)""",
}

_USES = {
    "named": ["gene2refseq"],
    "dated": ["pmid_dates"],
    "cited": ["gene2pubmed", "gene_info", "dated"],
    "by_year": ["cited"],
    "fanout": ["gene2pubmed", "gene_info", "pmid_dates"],
    "top20": ["by_year"],
    "pairs": ["named"],
    "owned": ["named"],
    "one_refseq": ["owned"],
    "counts": ["gene2pubmed"],
    "counts_id": ["gene2pubmed"],
    "refseq_counts": ["counts", "one_refseq"],
    "offsets": ["chrom_info"],
    "positions": ["refgene", "offsets"],
    "refgene_counts": ["positions", "refseq_counts"],
    "annotations": ["pairs", "counts_id", "gene_info", "refgene"],
    "transcript_years": ["gene2pubmed", "dated", "gene_info", "named", "refgene"],
    "exon_marks": ["exons"],
    "exon_islands": ["exon_marks"],
    "exon_unions": ["exon_islands"],
    "bounds_of_years": ["by_year"],
    "type_values": ["bounds_of_years"],
    "symbol_values": ["bounds_of_years", "top20"],
    "layers": ["type_values"],
    "stacked": ["layers"],
    "changes": ["layers"],
    "wiggle": ["changes"],
    "alternating": ["layers"],
    "signed": ["alternating"],
    "signed_changes": ["signed"],
    "alt_wiggle": ["signed_changes"],
}


def _statement(uses: list[str], body: str, **replaced: str) -> str:
    """``body`` behind the definitions it uses; ``replaced`` puts another text in place of a definition."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in [] if name in replaced else _USES.get(name, []):
            visit(needed)
        order.append(name)

    for name in uses:
        visit(name)
    parts = [f"{name} AS ({replaced.get(name, _LENSES.get(name, ''))})" for name in order]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


# The columns that the queries find in the order dates of the test data; other dates would show as a mismatch.
_YEARS = range(1995, 2002)
_DECADES = (1990, 2000)


def _cells(agg: str, label: str, labels) -> str:
    return ", ".join(f'CAST({agg}(CASE WHEN {label} = {n} THEN citations END) AS BIGINT) AS "{n}"' for n in labels)


def _stacked(baseline: str, uses: list[str]) -> str:
    return _statement(
        ["stacked", *uses],
        f"""SELECT s.series, s.position, s.x, round(b.baseline + below, 6) + 0.0 AS lower,
                   round(b.baseline + below + value, 6) + 0.0 AS upper
            FROM stacked s JOIN ({baseline}) b ON s.x = b.x""",
    )


def _alternating(baseline: str, uses: list[str] | None = None) -> str:
    return _statement(
        ["alternating", *(uses or [])],
        f"""SELECT a.series, a.position, a.x, round(lower - baseline, 6) + 0.0 AS lower,
                   round(upper - baseline, 6) + 0.0 AS upper
            FROM alternating a JOIN ({baseline}) b ON a.x = b.x""",
    )


def _pagerank(rounds: int) -> str:
    parts = ["r0 AS (SELECT DISTINCT src AS node, CAST(1 AS DOUBLE) AS rank FROM links)"]
    parts.append("degree AS (SELECT src, count(*) AS d FROM links GROUP BY src)")
    for n in range(1, rounds + 1):
        parts.append(
            f"""r{n} AS (SELECT l.dst AS node, sum(r.rank / g.d) * 0.85 + 0.15 AS rank
                FROM links l JOIN degree g ON l.src = g.src JOIN r{n - 1} r ON l.src = r.node GROUP BY l.dst)"""
        )
    head = _statement(["links"], "")
    return f"{head}, {', '.join(parts)} SELECT node, round(rank, 6) + 0.0 AS rank FROM r{rounds}"


def _coverage(k: int) -> str:
    return _statement(
        ["annotations", "gene2pubmed"],
        f"""SELECT (SELECT count(DISTINCT gene_id) FROM ({_top_genes(k)})) AS genes,
                   (SELECT count(DISTINCT pmid) FROM gene2pubmed
                    WHERE gene_id IN (SELECT gene_id FROM ({_top_genes(k)}))) AS gene_papers,
                   (SELECT count(DISTINCT pmid) FROM gene2pubmed WHERE tax_id = 9) AS species_papers""",
    )


def _top_genes(k: int) -> str:
    return f"""SELECT gene_id FROM annotations
               ORDER BY citations DESC, gene_id DESC, refseq_id DESC, chrom DESC, tx_start DESC LIMIT {k}"""


_ATTRIBUTES = "tax_id, gene_id, symbol, description, type_of_gene"

_ANNOTATION_EXONS = """
    SELECT gene_id, chrom, strand, CAST(exon_start AS BIGINT) AS exon_start, CAST(exon_end AS BIGINT) AS exon_end
    FROM (SELECT gene_id, chrom, strand, unnest(string_split(trim(exon_starts, ','), ',')) AS exon_start,
                 unnest(string_split(trim(exon_ends, ','), ',')) AS exon_end FROM annotations)"""

STATEMENTS: dict[str, str] = {
    "gene_total": _statement(
        ["by_year"], f"SELECT {_ATTRIBUTES}, '-' AS year, CAST(sum(citations) AS BIGINT) AS citations FROM by_year GROUP BY ALL"
    ),
    "gene_by_year": _statement(["by_year"], "SELECT * FROM by_year"),
    "gene_by_year_species": _statement(["by_year"], "SELECT * FROM by_year WHERE tax_id = 9"),
    "gene_total_from_years": _statement(["cited"], f"SELECT {_ATTRIBUTES}, count(*) AS citations FROM cited GROUP BY ALL"),
    "most_cited_genes": _statement(
        ["cited"],
        f"""SELECT {_ATTRIBUTES}, count(*) AS citations FROM cited GROUP BY ALL
            ORDER BY citations DESC, tax_id, gene_id LIMIT 10""",
    ),
    "gene_by_year_fanout": _statement(
        ["fanout"], "SELECT * FROM fanout", pmid_dates=_LENSES["pmid_dates_multi"]
    ),
    "cited_dates": _statement(
        ["pmid_dates", "gene2pubmed"],
        "SELECT pmid, year FROM pmid_dates WHERE pmid IN (SELECT pmid FROM gene2pubmed)",
    ),
    "genes_per_year": _statement(["cited"], "SELECT year, count(DISTINCT gene_id) AS genes FROM cited GROUP BY 1"),
    "citations_per_year": _statement(["cited"], "SELECT year, count(*) AS citations FROM cited GROUP BY 1"),
    "genes_per_paper_top10": _statement(
        ["cited"], "SELECT pmid, count(*) AS genes FROM cited GROUP BY 1 ORDER BY genes DESC, pmid LIMIT 10"
    ),
    "genes_per_paper": _statement(["cited"], "SELECT pmid, count(*) AS genes FROM cited GROUP BY 1"),
    "citations_by_type": _statement(["cited"], "SELECT type_of_gene, count(*) AS citations FROM cited GROUP BY 1"),
    "genes_by_type": _statement(
        ["cited"], "SELECT type_of_gene, count(DISTINCT gene_id) AS genes FROM cited GROUP BY 1"
    ),
    "yearly_statistics": _statement(
        ["cited"],
        """SELECT 'year' AS statistic, year, NULL AS type_of_gene, count(DISTINCT gene_id) AS genes, count(*) AS citations
           FROM cited GROUP BY year
           UNION ALL SELECT 'type', NULL, type_of_gene, count(DISTINCT gene_id), count(*) FROM cited GROUP BY type_of_gene""",
    ),
    "type_rows": _statement(["by_year"], "SELECT * FROM by_year WHERE type_of_gene = 'PROMO'"),
    "papers_per_species": _statement(
        ["gene2pubmed"], "SELECT tax_id, count(DISTINCT pmid) AS papers FROM gene2pubmed GROUP BY 1"
    ),
    "publications_per_year": _statement(
        ["pmid_dates"], "SELECT year, count(*) AS publications FROM pmid_dates GROUP BY 1"
    ),
    "pubs_with_year": _statement(
        ["gene2pubmed", "pmid_dates"],
        "SELECT gene_id, tax_id, g.pmid, year FROM gene2pubmed g JOIN pmid_dates d ON g.pmid = d.pmid",
    ),
    "dates_last_year": _statement(
        ["pmid_dates_multi"], "SELECT pmid, max(year) AS year FROM pmid_dates_multi GROUP BY 1"
    ),
    "year_range": _statement(["cited"], "SELECT min(year) AS min_year, max(year) AS max_year FROM cited"),
    "row_counts": _statement(["by_year"], "SELECT count(*) AS row_count FROM by_year"),
    "distinct_symbols": _statement(["cited"], "SELECT DISTINCT symbol FROM cited"),
    "type_index": _statement(
        ["cited"],
        """SELECT type_of_gene, dense_rank() OVER (ORDER BY type_of_gene) - 1 AS category_index
           FROM (SELECT DISTINCT type_of_gene FROM cited)""",
    ),
    "symbol_index": _statement(
        ["cited"],
        "SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS category_index FROM (SELECT DISTINCT symbol FROM cited)",
    ),
    **{
        name: _statement(
            ["fanout"],
            f"""SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY citations DESC, gene_id DESC,
                       symbol DESC, description DESC, CAST(tax_id AS VARCHAR) DESC) - 1 AS INT) AS pos,
                       citations, gene_id, symbol, description, tax_id
                FROM fanout WHERE citations > {least} QUALIFY pos < 20""",
        )
        for name, least in (("top_genes_by_year", 10), ("top_genes_by_year_min3", 3))
    },
    "gene_lists_by_year": _statement(
        ["fanout"],
        """SELECT year, block, CAST(count(*) AS INT) AS genes, string_agg(CAST(gene_id AS VARCHAR), ',' ORDER BY pos) AS gene_ids
           FROM (SELECT *, pos // 100 AS block FROM (
             SELECT year, gene_id, row_number() OVER (PARTITION BY year ORDER BY citations DESC, gene_id DESC, symbol DESC,
                    description DESC, CAST(tax_id AS VARCHAR) DESC) - 1 AS pos FROM fanout WHERE citations > 3))
           GROUP BY 1, 2""",
    ),
    "symbol_lookup": _statement(["by_year"], "SELECT * FROM by_year WHERE symbol = 'red widget'"),
    "paper_lookup": _statement(["gene2pubmed"], "SELECT DISTINCT pmid FROM gene2pubmed WHERE pmid = 7"),
    "symbol_by_year": _statement(
        ["by_year"], f"SELECT symbol, {_cells('min', 'year', _YEARS)} FROM by_year GROUP BY symbol"
    ),
    "symbol_by_decade": _statement(
        ["by_year"], f"SELECT symbol, {_cells('sum', 'year // 10 * 10', _DECADES)} FROM by_year GROUP BY symbol"
    ),
    "top_symbols_by_decade": _statement(
        ["top20"], f"SELECT symbol, {_cells('sum', 'year // 10 * 10', _DECADES)} FROM top20 GROUP BY symbol"
    ),
    "top_by_year": _statement(["top20"], "SELECT * FROM top20"),
    "symbol_totals": _statement(["cited"], "SELECT symbol, count(*) AS citations FROM cited GROUP BY 1"),
    "paper_coverage_top100": _coverage(100),
    "paper_coverage_top10": _coverage(10),
    "papers_of_top10": _statement(
        ["annotations", "gene2pubmed"],
        f"SELECT DISTINCT pmid FROM gene2pubmed WHERE gene_id IN (SELECT gene_id FROM ({_top_genes(10)}))",
    ),
    "gene_of_refseq": _statement(["owned"], "SELECT refseq_id, tax_id, gene_id FROM owned"),
    "refseq_of_gene": _statement(["one_refseq"], "SELECT * FROM one_refseq"),
    "gene_refseq_pairs": _statement(["pairs"], "SELECT * FROM pairs"),
    "located_refseq": _statement(
        ["named", "refgene"],
        "SELECT DISTINCT tax_id, gene_id, refseq_id FROM named WHERE refseq_id IN (SELECT name FROM refgene WHERE NOT contains(chrom, '_') AND name <> '')",
    ),
    "gene_transcripts": _statement(
        ["named", "gene_info"],
        """SELECT n.tax_id, n.gene_id, symbol, description, type_of_gene, refseq_id
           FROM named n JOIN gene_info i ON n.tax_id = i.tax_id AND n.gene_id = i.gene_id""",
    ),
    "transcript_by_year": _statement(["transcript_years"], "SELECT * FROM transcript_years"),
    "transcript_totals": _statement(
        ["transcript_years"],
        """SELECT tax_id, gene_id, refseq_id, chrom, tx_start, tx_end, symbol, description, type_of_gene,
                  CAST(sum(citations) AS BIGINT) AS citations FROM transcript_years GROUP BY ALL""",
    ),
    "transcripts_with_gene": _statement(
        ["refgene", "owned"], "SELECT o.gene_id, r.* FROM refgene r JOIN owned o ON r.name = o.refseq_id"
    ),
    "transcripts_unmatched": _statement(
        ["refgene", "named"], "SELECT name FROM refgene WHERE name NOT IN (SELECT refseq_id FROM named)"
    ),
    "chrom_offsets": _statement(["offsets"], "SELECT * FROM offsets"),
    "refgene_positions": _statement(["positions"], "SELECT * FROM positions"),
    "gene_row_counts": _statement(["counts_id"], "SELECT * FROM counts_id"),
    "gene_counts": _statement(["counts"], "SELECT * FROM counts"),
    "refseq_counts": _statement(["refseq_counts"], "SELECT * FROM refseq_counts"),
    "refgene_counts": _statement(["refgene_counts"], "SELECT * FROM refgene_counts"),
    "refgene_counts_plus": _statement(["refgene_counts"], "SELECT * FROM refgene_counts WHERE strand = '+'"),
    "refgene_counts_minus": _statement(["refgene_counts"], "SELECT * FROM refgene_counts WHERE strand = '-'"),
    "refgene_one_locus": _statement(
        ["refgene", "refseq_counts"],
        """SELECT r.*, c.citations
           FROM (SELECT * FROM refgene WHERE NOT contains(chrom, '_') AND name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY chrom, tx_start, tx_end) = 1) r
                JOIN refseq_counts c ON r.name = c.refseq_id""",
    ),
    "refseq_citations": _statement(
        ["pairs", "counts_id"],
        "SELECT p.gene_id, p.refseq_id, c.citations FROM pairs p JOIN counts_id c ON p.gene_id = c.gene_id",
    ),
    "cited_genes": _statement(
        ["gene_info", "counts_id"],
        """SELECT i.gene_id, symbol, type_of_gene, full_name, citations
           FROM gene_info i JOIN counts_id c ON i.gene_id = c.gene_id""",
    ),
    "gene_annotations": _statement(["annotations"], "SELECT * FROM annotations"),
    "exon_array": _statement(
        ["refgene"],
        """SELECT name, trim(exon_ends, ',') AS exon_ends, CAST(exon - 1 AS INT) AS exon,
                  CAST(starts[exon] AS BIGINT) AS exon_start
           FROM (SELECT name, exon_ends, string_split(trim(exon_starts, ','), ',') AS starts,
                        unnest(range(1, len(string_split(trim(exon_starts, ','), ',')) + 1)) AS exon FROM refgene)""",
    ),
    "exon_union": _statement(["exon_unions"], "SELECT * FROM exon_unions"),
    "annotation_exon_unions": _statement(
        ["annotations", "exon_unions"], "SELECT * FROM exon_unions", exons=_ANNOTATION_EXONS
    ),
    "transcript_bounds": _statement(
        ["exons"],
        """SELECT gene_id, chrom, strand, min(exon_start) AS tx_start, max(exon_end) AS tx_end
           FROM exons GROUP BY 1, 2, 3""",
    ),
    "pagerank3": _pagerank(3),
    "link_lists": _statement(
        ["links"],
        """SELECT src, block, string_agg(dst, ',' ORDER BY dst) AS targets FROM (
             SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 8 AS block FROM links)
           GROUP BY 1, 2""",
    ),
    "gene_disease_top": _statement(
        ["gene_diseases"],
        """SELECT * FROM gene_diseases WHERE "associationType" = 'GeneticVariation'
           ORDER BY "NumberOfPubmeds" DESC, "geneId", "diseaseId" LIMIT 1""",
    ),
    "gene_disease_genes": _statement(
        ["gene_diseases"], """SELECT "geneId" FROM gene_diseases WHERE "associationType" = 'GeneticVariation'"""
    ),
    "disease_by_month": _statement(
        ["gene2pubmed", "gene_diseases"],
        """SELECT disease_id, month, count(*) AS genes, CAST(sum(citations) AS BIGINT) AS citations
           FROM (SELECT DISTINCT "geneId" AS gene_id, "diseaseId" AS disease_id FROM gene_diseases)
           JOIN (SELECT gene_id, strftime(day, '%Y-%m') AS month, count(*) AS citations
                 FROM gene2pubmed JOIN (SELECT l_orderkey AS pmid, max(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1) USING (pmid)
                 GROUP BY 1, 2) USING (gene_id)
           GROUP BY 1, 2""",
    ),
    "column_frequency": """
        SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS occurrences FROM lineitem GROUP BY 1""",
    "daily_ids": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS pub_date, o_orderkey AS pmid FROM orders
        UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), o_custkey FROM orders""",
    "dates_union": _statement(
        ["pmid_dates", "pmid_dates_multi"],
        "SELECT pmid, year FROM pmid_dates UNION ALL SELECT pmid, year FROM pmid_dates_multi",
    ),
    "type_year_dense": _statement(["type_values"], "SELECT * FROM type_values"),
    "non_type_by_year": _statement(
        ["cited"],
        """SELECT type_of_gene, year, count(*) AS citations FROM cited
           WHERE type_of_gene <> 'STANDARD' GROUP BY 1, 2""",
    ),
    "top_symbol_layers": _statement(
        ["symbol_values"],
        """SELECT * FROM symbol_values
           WHERE x BETWEEN (SELECT min(year) FROM top20) AND (SELECT max(year) FROM top20)""",
    ),
    "series_onset": _statement(
        ["symbol_values"],
        """SELECT series, onset, row_number() OVER (ORDER BY onset NULLS LAST, series) - 1 AS position
           FROM (SELECT series, min(CASE WHEN value > 0 THEN x END) AS onset FROM symbol_values GROUP BY 1)""",
    ),
    "layers_symmetric": _stacked("SELECT x, -sum(value) / 2 AS baseline FROM layers GROUP BY x", ["layers"]),
    "layers_zero": _stacked("SELECT DISTINCT x, 0 AS baseline FROM layers", ["layers"]),
    "layers_wiggle": _stacked("SELECT * FROM wiggle", ["wiggle"]),
    "layers_alternating": _alternating("SELECT DISTINCT x, 0 AS baseline FROM alternating"),
    "layers_alt_symmetric": _alternating(
        "SELECT x, (min(lower) + max(upper)) / 2 AS baseline FROM alternating GROUP BY x"
    ),
    "layers_alt_positive": _alternating("SELECT x, min(lower) AS baseline FROM alternating GROUP BY x"),
    "layers_alt_wiggle": _alternating("SELECT * FROM alt_wiggle", ["alt_wiggle"]),
}
