"""Readers and writers on small files in the real layouts."""

import gzip

import pytest
from pyspark.sql import functions as F

from citetide import sinks, sources, streaming
from citetide.functions import filters, scalars
from citetide.operators import counting, pivots
from citetide.plans import annotations, citations, columns, coverage, daily, disease, ranking, refgene, transcripts


def text(folder, name, lines):
    path = folder / name
    data = "".join(line + "\n" for line in lines)
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(data.encode()))
    else:
        path.write_text(data)
    return str(path)


def tab(*fields):
    return "\t".join(map(str, fields))


def gene_line(tax, gene, symbol, description, kind, full):
    return tab(tax, gene, symbol, *["-"] * 5, description, kind, "-", full, "O", "-", "20170101")


def refgene_line(name, chrom, strand, start, end, starts, ends, gene):
    return tab(585, name, chrom, strand, start, end, start, end, 2, starts, ends, 0, gene, "cmpl", "cmpl", "0,")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    paths = {
        "gene2pubmed": text(
            folder,
            "gene2pubmed",
            ["#tax_id\tGeneID\tPubMed_ID", tab(9606, 1, 100), tab(9606, 1, 100), tab(9606, 1, 101), tab(9606, 2, 100),
             tab(9606, 3, 999), tab(10090, 4, 101), tab(10090, 5, 102), tab(9606, 6, 100)],
        ),
        "gene_info": text(
            folder,
            "gene_info.gz",
            ["#tax_id\tGeneID\tSymbol", gene_line(9606, 1, "AA", 'first "gene', "protein-coding", "gene A"),
             gene_line(9606, 2, "BB", "second gene", "rRNA", "gene B"),
             gene_line(9606, 3, "CC", "third gene", "pseudo", "gene C"),
             gene_line(10090, 4, "AA", "mouse gene", "protein-coding", "gene a"),
             gene_line(10090, 5, "DD", "undated", "protein-coding", "gene d")],
        ),
        "gene2refseq": text(
            folder,
            "gene2refseq",
            ["#tax_id\tGeneID\tstatus\taccession", tab(9606, 1, "REVIEWED", "NM_1.3", "x"), tab(9606, 1, "-", "NM_1.4", "x"),
             tab(9606, 1, "-", "NM_2.1", "x"), tab(9606, 2, "-", "NM_2.1", "x"), tab(9606, 3, "-", "-", "x"),
             tab(10090, 4, "-", "NM_9.1", "x")],
        ),
        "refgene": text(
            folder,
            "refGene.txt.gz",
            [refgene_line("NM_1", "chr2", "+", 10, 40, "10,30,", "20,40,", "AA"),
             refgene_line("NM_1", "chr1", "+", 5, 35, "5,30,", "12,35,", "AA"),
             refgene_line("NM_2", "chr1", "-", 100, 140, "100,110,", "110,140,", "BB"),
             refgene_line("NM_3", "chr1_random", "-", 1, 9, "1,", "9,", "EE"),
             refgene_line("", "chr1", "-", 1, 9, "1,", "9,", "FF"),
             refgene_line("NM_4", "chr2", "-", 1, 9, "1,", "9,", "GG")],
        ),
        "chrom_info": text(
            folder, "chromInfo.txt.gz", [tab("chr1", 500, "/a"), tab("chr2", 800, "/a"), tab("chr1_random", 500, "/a")]
        ),
        "dates": text(folder, "years.ssv", ["2001 100", "2003 101", "1999 101", "2005 7", ""]),
        "slashed": text(folder, "slashed.ssv", ["2001/02/03 100", " 1999/12/31   101"]),
        "interactions": text(
            folder,
            "interactions",
            [tab("#a", "b"), *[tab(9606, s, *["."] * 4, d, "z") for s, d in (("1", "2"), ("2", "-"), ("x-y", "1"))]],
        ),
        "disease": text(
            folder,
            "disease.txt",
            [tab("geneId", "geneSymbol", "geneName", "diseaseId", "diseaseName", "score", "NumberOfPubmeds",
                 "associationType"),
             tab(1, "AA", "a", "C1", "d1", 0.1, 5, "GeneticVariation"), tab(2, "BB", "b", "C2", "d2", 0.1, 50, "Biomarker"),
             tab(3, "CC", "c", "C3", "d3", 0.1, 11, "GeneticVariation")],
        ),
        "ids": text(folder, "ids", ["1", " 2 ", "2", ""]),
    }
    days = folder / "days" / "2017"
    days.mkdir(parents=True)
    text(days, "2017_01_02.ssv", ["2017-01-01 11", "2017-01-01 12"])
    text(days, "2017_01_03.ssv", ["2017-01-02 13"])
    text(days, "notes.txt", ["not a date file"])
    return paths | {"days": str(folder / "days")}


@pytest.fixture
def tables(spark, files):
    read = {
        "gene2pubmed": sources.read_gene2pubmed,
        "gene_info": sources.read_gene_info,
        "gene2refseq": sources.read_gene2refseq,
        "refgene": sources.read_refgene,
        "chrom_info": sources.read_chrom_info,
        "dates": sources.read_pub_dates,
    }
    return {name: reader(spark, files[name]) for name, reader in read.items()}


def test_tables(tables, values):
    assert tables["gene2pubmed"].count() == 8
    assert values(tables["gene_info"].filter("gene_id = 1")) == [
        (9606, 1, "AA", 'first "gene', "protein-coding", "gene A")
    ]
    assert tables["gene2refseq"].columns == ["tax_id", "gene_id", "accession"]
    assert values(tables["refgene"].filter("name = 'NM_2'"), "exon_starts", "exon_ends", "gene_name") == [
        ("100,110", "110,140", "BB")
    ]
    assert tables["refgene"].filter("name = ''").count() == 1


def test_bad_number_stops_the_job(spark, tmp_path):
    path = text(tmp_path, "bad", [tab(1, "x", 3)])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|x"):
        sources.read_gene2pubmed(spark, path).collect()


def test_only_needed_columns_are_parsed(tables):
    plan = tables["gene_info"].select("symbol")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol:string>" in plan


def test_date_layouts(spark, files, values):
    assert values(sources.read_pub_dates(spark, files["dates"]), "pmid", "year") == [
        (100, 2001), (101, 1999), (101, 2003), (7, 2005)
    ]
    slashed = sources.read_pub_dates(spark, files["slashed"]).withColumn("day", F.col("pub_date").cast("string"))
    assert values(slashed, "pmid", "year", "day") == [(100, 2001, "2001-02-03"), (101, 1999, "1999-12-31")]
    assert values(sources.read_daily_dates(spark, files["days"]), "pmid", "year") == [(11, 2017), (12, 2017), (13, 2017)]


def test_lists_and_columns(spark, files, values):
    assert values(sources.read_id_list(spark, files["ids"])) == [(1,), (2,)]
    lines = sources.read_columns(spark, files["dates"]).filter("value != ''")
    counted = columns.count_by_column(lines, 2).collect()
    assert [tuple(r) for r in counted] == [("100", 1), ("7", 1), ("101", 2)]
    spine = sources.date_spine(spark, "2000-02-28", "2000-03-01")
    assert [str(r.pub_date) for r in spine.collect()] == ["2000-02-28", "2000-02-29", "2000-03-01"]


def test_interactions_and_missing_ends(spark, files, values):
    edges = sources.read_interactions(spark, files["interactions"])
    assert values(filters.drop_missing_edges(edges)) == [("1", "2"), ("x-y", "1")]


def test_totals(tables, values):
    totals = citations.gene_totals(tables["gene_info"], tables["gene2pubmed"], tables["dates"])
    # a repeated source row counts twice; a paper without a date and a gene without attributes do not count
    assert values(totals, "tax_id", "gene_id", "citations") == [(10090, 4, 1), (9606, 1, 3), (9606, 2, 1)]
    human = citations.gene_by_year(tables["gene_info"], tables["gene2pubmed"], tables["dates"], 9606)
    assert values(human, "gene_id", "year", "citations") == [(1, 2001, 2), (1, 2003, 1), (2, 2001, 1)]


def test_repeated_gene_rows_multiply(tables, values):
    twice = tables["gene_info"].union(tables["gene_info"].filter("gene_id = 2"))
    totals = citations.gene_totals(twice, tables["gene2pubmed"], tables["dates"])
    assert values(totals, "gene_id", "citations") == [(1, 3), (2, 2), (4, 1)]


def test_every_date_counts(tables, values):
    fanned = citations.gene_by_year_fanout(tables["gene_info"], tables["gene2pubmed"], tables["dates"])
    assert values(fanned, "gene_id", "year", "citations") == [
        (1, 1999, 1), (1, 2001, 2), (1, 2003, 1), (2, 2001, 1), (4, 1999, 1), (4, 2003, 1)
    ]


def test_corpus_statistics(tables, values):
    stats = citations.corpus_stats(tables["gene_info"], tables["gene2pubmed"], tables["dates"])
    assert values(stats["genes_per_year"]) == [(2001, 2), (2003, 2)]
    assert values(stats["citations_per_year"]) == [(2001, 3), (2003, 2)]
    assert values(stats["genes_per_paper"]) == [(100, 3), (101, 2)]
    assert values(stats["citations_by_type"]) == [("protein-coding", 4), ("rRNA", 1)]
    assert values(stats["genes_by_type"]) == [("protein-coding", 2), ("rRNA", 1)]


def test_statistics_with_spread_keys(tables, values, salted):
    test_totals(tables, values)
    test_every_date_counts(tables, values)
    test_corpus_statistics(tables, values)


def test_ranking_threshold_and_ties(spark, tables, values):
    ranked = ranking.top_genes_by_year(tables["gene_info"], tables["gene2pubmed"], tables["dates"], k=1, min_count=0)
    assert values(ranked, "year", "pos", "gene_id", "citations") == [(1999, 0, 4, 1), (2001, 0, 1, 2), (2003, 0, 4, 1)]
    none = ranking.top_genes_by_year(tables["gene_info"], tables["gene2pubmed"], tables["dates"], min_count=2)
    assert none.count() == 0


def test_transcripts(tables, values):
    args = (tables["gene_info"], tables["gene2pubmed"], tables["dates"], tables["gene2refseq"])
    by_year = transcripts.transcript_by_year(*args, filters.primary_chromosomes(tables["refgene"]))
    # the repeated row counts once; the first accession stands for the gene, at its first locus
    assert values(by_year, "gene_id", "year", "refseq_id", "chrom", "tx_start", "citations") == [
        (1, 2001, "NM_1", "chr1", 5, 1), (1, 2003, "NM_1", "chr1", 5, 1), (2, 2001, "NM_2", "chr1", 100, 1)
    ]
    assert values(transcripts.transcript_totals(by_year), "gene_id", "citations") == [(1, 2), (2, 1)]
    matched, unmatched = transcripts.add_gene_id(tables["refgene"], tables["gene2refseq"])
    assert values(matched, "gene_id", "name", "chrom") == [(1, "NM_1", "chr1"), (1, "NM_1", "chr2"), (1, "NM_2", "chr1")]
    assert values(unmatched) == [("",), ("NM_3",), ("NM_4",)]


def test_genome_positions(spark, tables, values):
    offsets = refgene.cumulative_offsets(tables["chrom_info"])
    assert values(offsets) == [("chr1", 500, 800), ("chr1_random", 500, 1300), ("chr2", 800, 0)]
    assert values(refgene.cumulative_offsets(tables["chrom_info"], small=False)) == values(offsets)
    placed = refgene.with_genome_coords(filters.primary_chromosomes(tables["refgene"]), offsets)
    assert values(placed, "name", "genome_tx_start", "genome_tx_end", "gene_length") == [
        ("NM_1", 10, 40, 30), ("NM_1", 805, 835, 30), ("NM_2", 900, 940, 40), ("NM_4", 1, 9, 8)
    ]


def test_unknown_chromosome_is_an_error(tables):
    known = refgene.cumulative_offsets(tables["chrom_info"].filter("chrom != 'chr1_random'"))
    later = filters.primary_chromosomes(refgene.with_genome_coords(tables["refgene"], known))
    with pytest.raises(Exception, match="unknown chromosome: chr1_random"):
        later.collect()
    assert filters.primary_chromosomes(refgene.with_genome_coords(tables["refgene"], known, strict=False)).count() == 4


def test_refgene_counts(tables, values):
    offsets = refgene.cumulative_offsets(tables["chrom_info"])
    args = (tables["refgene"], offsets, tables["gene2pubmed"], tables["gene2refseq"])
    counted = refgene.refgene_counts(*args, keys=["name", "chrom", "tx_start"])
    # both loci of the transcript are kept, with undated citations included
    assert values(counted, "name", "chrom", "citations") == [("NM_1", "chr1", 3), ("NM_1", "chr2", 3)]
    assert counted.select("uid").distinct().count() == 2
    assert refgene.refgene_counts(*args).select("uid").distinct().count() == 2
    one = refgene.attach_counts(tables["refgene"], refgene.refseq_counts(*args[2:]), one_locus=True)
    assert values(one, "name", "chrom") == [("NM_1", "chr1")]


def test_annotations(tables, values):
    table = annotations.gene_annotations(
        tables["gene_info"], tables["gene2pubmed"], tables["gene2refseq"], tables["refgene"]
    )
    assert table.columns == list(annotations.COLUMNS)
    assert values(table, "refseq_id", "gene_id", "chrom", "citations", "full_name") == [
        ("NM_1", 1, "chr1", 3, "gene A"), ("NM_1", 1, "chr2", 3, "gene A"), ("NM_2", 1, "chr1", 3, "gene A"),
        ("NM_2", 2, "chr1", 1, "gene B"),
    ]
    unions = annotations.exon_unions(annotations.exon_intervals(table))
    assert values(unions.filter("gene_id = 2")) == [(2, "chr1", "-", 100, 140)]
    bounds = annotations.transcript_bounds(unions)
    assert values(bounds.filter("chrom = 'chr2'")) == [(1, "chr2", "+", 10, 40)]
    top = coverage.top_transcript_genes(table, 2)
    assert values(top) == [(1,), (1,)]
    covered = coverage.paper_coverage(tables["gene2pubmed"], top, 9606).first()
    assert (covered.genes, covered.gene_papers, covered.species_papers) == (1, 2, 3)
    assert coverage.papers_of_genes(tables["gene2pubmed"], top).count() == 2


def test_species_and_years(tables):
    assert [tuple(r) for r in citations.papers_per_species(tables["gene2pubmed"]).collect()] == [(10090, 2), (9606, 3)]
    assert [tuple(r) for r in citations.publications_per_year(tables["dates"]).collect()] == [
        (1999, 1), (2001, 1), (2003, 1), (2005, 1)
    ]


def test_disease_views(spark, files, values, capsys):
    table = sources.read_gene_disease(spark, files["disease"])
    assert table.schema["NumberOfPubmeds"].dataType.simpleString() == "int"
    assert disease.top_association(table).first().geneId == "3"
    assert values(disease.associated_genes(table)) == [("1",), ("3",)]
    assert values(spark.table("results")) == [("1",), ("3",)]
    assert filters.for_association(table, "Biomarker").count() == 1
    table.printSchema()
    assert "NumberOfPubmeds: integer" in capsys.readouterr().out


def test_responses(spark, tmp_path, values):
    responses = spark.createDataFrame(
        [("2017-01-01", "<IdList><Id>5</Id>\n<Id>6</Id><Id>x</Id></IdList>"), ("2017-01-02", "<IdList/>"),
         ("2017-01-04", "<Id>7</Id>")],
        "day string, text string",
    ).select(F.to_date("day").alias("pub_date"), "text")
    days = sources.date_spine(spark, "2017-01-01", "2017-01-03")
    found = daily.pub_dates_from_responses(responses, days)
    assert values(found, "pmid") == [(5,), (6,)]
    folder = tmp_path / "out"
    sources.write_daily_dates(daily.pub_dates_from_responses(responses), str(folder))
    assert sorted(p.name for p in folder.iterdir() if p.is_dir()) == ["pub_date=2017-01-01", "pub_date=2017-01-04"]
    again = sources.read_daily_dates(spark, str(folder)).withColumn("day", F.col("pub_date").cast("string"))
    assert values(again, "pmid", "day") == [(5, "2017-01-01"), (6, "2017-01-01"), (7, "2017-01-04")]


def lines(path):
    return sorted(line for part in path.glob("part-*") for line in part.read_text().splitlines())


def test_text_sinks(spark, tables, tmp_path, values):
    args = (tables["gene_info"], tables["gene2pubmed"], tables["dates"])
    by_year = citations.gene_by_year(*args)
    for _ in range(2):  # the second write replaces the first
        sinks.write_by_year(by_year, str(tmp_path / "years"))
    assert tab(9606, 1, 2001, "AA", 'first "gene', "protein-coding", 2) in lines(tmp_path / "years")
    assert values(sources.read_by_year(spark, str(tmp_path / "years"))) == values(by_year)
    sinks.write_totals(citations.gene_totals(*args), str(tmp_path / "totals"))
    assert lines(tmp_path / "totals")[-1] == tab(9606, 2, "-", "BB", "second gene", "rRNA", 1)
    ranked = ranking.top_genes_by_year(*args, min_count=0).filter("year = 2003 and pos = 0")
    sinks.write_ranked(ranked, str(tmp_path / "ranked"))
    assert set(lines(tmp_path / "ranked")) == {
        tab("year", "pos", "count", "geneid", "symbol", "name", "taxid"), tab(2003, 0, 1, 4, "AA", "mouse gene", 10090)
    }
    assert values(counting.row_count(by_year)) == [(4,)]


def test_wide_sink(spark, tables, tmp_path, values):
    from citetide.operators import pivots

    by_year = citations.gene_by_year(tables["gene_info"], tables["gene2pubmed"], tables["dates"])
    wide = pivots.pivot_years(by_year)
    assert wide.columns == ["symbol", "2001", "2002", "2003"]
    # two genes share the symbol in 2003: the smaller count is shown
    assert values(wide) == [("AA", 2, None, 1), ("BB", 1, None, None)]
    sinks.write_wide(wide.coalesce(1), str(tmp_path / "wide"))
    assert lines(tmp_path / "wide") == sorted([tab("gene", 2001, 2002, 2003), "AA\t2\t\t1", "BB\t1\t\t"])
    assert values(pivots.pivot_decades(by_year)) == [("AA", 4), ("BB", 1)]
    early = by_year.withColumn("year", F.col("year") - 2)
    assert pivots.pivot_decades(early).columns == ["symbol", "1990", "2000"]
    assert values(pivots.pivot_top(by_year, 1)) == [("AA", 3)]
    assert values(pivots.symbol_totals(by_year)) == [("AA", 4), ("BB", 1)]


def test_table_sinks(spark, tables, tmp_path, values):
    offsets = refgene.cumulative_offsets(tables["chrom_info"])
    counted = refgene.refgene_counts(tables["refgene"], offsets, tables["gene2pubmed"], tables["gene2refseq"], ["name"])
    sinks.write_by_strand(counted, str(tmp_path / "strands"))
    assert [p.name for p in (tmp_path / "strands").iterdir() if p.is_dir()] == ["strand=+"]
    table = annotations.gene_annotations(
        tables["gene_info"], tables["gene2pubmed"], tables["gene2refseq"], tables["refgene"]
    )
    sinks.write_annotations(table, str(tmp_path / "annotations"))
    assert values(sources.read_annotations(spark, str(tmp_path / "annotations"))) == values(table)
    assert values(sinks.register(table, "annotations").sparkSession.table("annotations")) == values(table)


def test_text_keeps_its_values(spark, tmp_path):
    rows = [("  lead", 1), ("trail  ", 2), ("#5", 3), ('a "quoted" \\ word', 4), ("a\tb\nc\rd", 5), (None, 6), ("", 7)]
    sinks.write_tsv(spark.createDataFrame(rows, "name string, n int"), str(tmp_path / "text"))
    assert lines(tmp_path / "text") == sorted(
        ["  lead\t1", "trail  \t2", "#5\t3", 'a "quoted" \\ word\t4', "a b c d\t5", "\t6", "\t7"]
    )


def test_daily_files_keep_earlier_days(spark, tmp_path, values):
    for day, pmid in (("2000-01-01", 1), ("2000-01-02", 2), ("2000-01-02", 3)):
        ids = spark.createDataFrame([(day, pmid)], "day string, pmid bigint")
        sources.write_daily_dates(ids.select(F.to_date("day").alias("pub_date"), "pmid"), str(tmp_path / "days"))
    assert values(sources.read_daily_dates(spark, str(tmp_path / "days")), "pmid") == [(1,), (3,)]


def test_transcript_writers(spark, tmp_path):
    row = spark.sql(
        """SELECT 9606 AS tax_id, 1L AS gene_id, 1999 AS year, 'NM_1' AS refseq_id, 'chr1' AS chrom, 5L AS tx_start,
                  9L AS tx_end, 'A1' AS symbol, 'first' AS description, 'coding' AS type_of_gene, 4L AS citations"""
    )
    sinks.write_transcript_by_year(row, str(tmp_path / "years"))
    sinks.write_transcript_totals(row, str(tmp_path / "totals"))
    assert lines(tmp_path / "years") == ["9606\t1\t1999\tNM_1\tchr1\t5\t9\tA1\tfirst\tcoding\t4"]
    assert lines(tmp_path / "totals") == ["9606\t1\tNM_1\tchr1\t5\t9\tA1\tfirst\tcoding\t4"]


def test_short_association_lines_stop_the_job(spark, tmp_path):
    path = tmp_path / "short.tsv"
    path.write_text("geneId\tdiseaseId\tNumberOfPubmeds\n1\tD1\t3\n2\tD2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_gene_disease(spark, str(path)).collect()


def test_wide_table_has_every_year(spark):
    rows = spark.createDataFrame([("a", 1801, 2), ("a", 1803, 1)], "symbol string, year int, citations bigint")
    wide = pivots.pivot_years(rows)
    assert wide.columns == ["symbol", "1801", "1802", "1803"]
    assert tuple(wide.first()) == ("a", 2, None, 1)


def test_daily_stream(spark, files, tmp_path, values):
    for _ in range(2):  # the second run finds nothing new
        query = streaming.append_daily_dates(
            streaming.stream_daily_dates(spark, files["days"]), str(tmp_path / "table"), str(tmp_path / "state")
        )
        query.awaitTermination(60)
    assert values(spark.read.parquet(str(tmp_path / "table")), "pmid", "year") == [(11, 2017), (12, 2017), (13, 2017)]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.strip_version(F.lit("NM_000020.3")).alias("version"),
        scalars.pub_year(F.lit("1999/12/31")).alias("year"),
        scalars.decade(F.lit(1999)).alias("decade"),
        scalars.int_list(F.lit("1,22,3,")).alias("ints"),
        scalars.trim_commas(F.lit("1,2,")).alias("trimmed"),
        scalars.iso_day(F.lit("2001-02-03").cast("date")).alias("day"),
        scalars.gene_length(F.lit(5), F.lit(9)).alias("length"),
        scalars.delimited(F.lit("a"), F.lit(None), F.lit(3)).alias("line"),
    ).first()
    assert tuple(row) == ("NM_000020", 1999, 1990, [1, 22, 3], "1,2", "2001-02-03", 4, "a\t\t3")
