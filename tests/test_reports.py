"""How reports read and move their tables: one scan, one join, no exchange; and the rows they give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from catalog.queries import REGISTRY
from citetide import sinks, streaming
from citetide.operators import skew
from citetide.plans import citations, disease, increments, ranking, transcripts


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def yearly(spark):
    """A third of the rows is one year, a third one gene; ids, years and types are null in some."""
    rows = []
    for n in range(600):
        gene = None if n % 41 == 0 else (7 if n % 3 == 0 else n % 50)
        year = None if n % 37 == 0 else (2001 if n % 3 == 1 else 1990 + n % 20)
        rows.append((n % 4, gene, year, f"s{n % 5}", "d", None if n % 29 == 0 else f"t{n % 6}", n % 9 + 1))
    schema = "tax_id int, gene_id bigint, year int, symbol string, description string, type_of_gene string, citations bigint"
    return spark.createDataFrame(rows, schema)


def test_yearly_statistics_scan_once(spark, large, values, tmp_path):
    sinks.write_table(yearly(spark), str(tmp_path / "by_year"))
    by_year = spark.read.parquet(str(tmp_path / "by_year"))
    rows, plan = final_plan(citations.yearly_statistics(by_year))
    assert plan.count("FileScan") == 1
    parts = {"year": [], "type": []}
    for r in rows:
        parts[r.statistic].append((r.year if r.statistic == "year" else r.type_of_gene, r.genes, r.citations))
        assert (r.type_of_gene if r.statistic == "year" else r.year) is None
    for kind, column in (("year", "year"), ("type", "type_of_gene")):
        expected = by_year.groupBy(column).agg(F.countDistinct("gene_id"), F.sum("citations"))
        assert sorted(parts[kind], key=repr) == values(expected)
    assert citations.yearly_statistics(by_year.limit(0)).count() == 0


def test_corpus_statistics_equal_the_single_reports(spark, values):
    by_year = yearly(spark)
    genes = spark.createDataFrame([(0, 7, "a", "b", "c")], "tax_id int, gene_id bigint, symbol string, description string, type_of_gene string")
    pairs, dates = spark.createDataFrame([(0, 7, 1)], "tax_id int, gene_id bigint, pmid bigint"), spark.createDataFrame([(1, 2000)], "pmid bigint, year int")
    found = citations.corpus_stats(genes, pairs, dates, by_year)
    for name in ("genes_per_year", "citations_per_year", "citations_by_type", "genes_by_type"):
        assert values(found[name]) == values(getattr(citations, name)(by_year))
    assert values(found["genes_per_paper"]) == [(1, 1)]


def located(spark):
    """A third of the transcripts share one name; some have none."""
    rows = [("NM_1" if n % 3 == 0 else (None if n % 10 == 1 else f"NM_{n % 40}"), "chr1", n) for n in range(300)]
    refgene = spark.createDataFrame(rows, "name string, chrom string, tx_start bigint")
    pairs = [(9, n, f"NM_{n}.2") for n in range(0, 40, 2)] + [(9, 1, "NM_1.1"), (9, 5, "NM_1.3"), (9, None, "NM_3.1"), (9, 6, "-")]
    return refgene, spark.createDataFrame(pairs, "tax_id int, gene_id bigint, accession string")


@pytest.mark.parametrize("keys", ["plain", "spread"])
def test_transcripts_meet_their_genes_in_one_join(spark, values, request, keys):
    if keys == "spread":
        request.getfixturevalue("salted")
    refgene, pairs = located(spark)
    marked = transcripts.mark_gene_ids(refgene, pairs)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    matched, unmatched = transcripts.add_gene_id(refgene, pairs)
    assert "PartitionFilters: [isnotnull(has_gene" in matched._jdf.queryExecution().executedPlan().toString()
    genes = {f"NM_{n}": n for n in range(0, 40, 2)} | {"NM_1": 1, "NM_3": None}
    rows = [tuple(r) for r in refgene.collect()]
    assert matched.columns == ["gene_id", "name", "chrom", "tx_start"]
    assert values(matched) == sorted(((genes[r[0]], *r) for r in rows if r[0] in genes), key=repr)
    assert values(unmatched) == sorted(((r[0],) for r in rows if r[0] not in genes), key=repr)


@pytest.fixture
def bucketed(spark, large, tmp_path):
    pairs = spark.range(5000).select(
        F.lit(9).alias("tax_id"), (F.col("id") % 300).alias("gene_id"), (F.col("id") * 7 % 9000).alias("pmid")
    )
    dates = spark.range(9000).select(F.col("id").alias("pmid"), (F.col("id") % 9 + 1995).cast("int").alias("year"))
    genes = spark.range(250).select(
        F.lit(9).alias("tax_id"), F.col("id").alias("gene_id"), F.lit("s").alias("symbol"), F.lit("d").alias("description"), F.lit("t").alias("type_of_gene")
    )
    made = {"pairs": (pairs, ["pmid"]), "dates": (dates, ["pmid"]), "genes": (genes, ["tax_id", "gene_id"]), "more": (pairs, ["tax_id", "gene_id"])}
    tables = {n: sinks.write_bucketed(df, f"bucketed_{n}", by, 6, str(tmp_path / n)) for n, (df, by) in made.items()}
    yield {n: df for n, (df, _) in made.items()}, tables
    for name in made:
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_bucketed_tables_join_without_an_exchange(spark, bucketed, values):
    plain, tables = bucketed
    dated = citations.dated_pairs(tables["pairs"], tables["dates"], ["tax_id", "gene_id"], True)
    rows, plan = final_plan(dated)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    expected = citations.dated_pairs(plain["pairs"], plain["dates"], ["tax_id", "gene_id"], True)
    assert "Exchange" in final_plan(expected)[1]
    assert values(dated) == values(expected)
    attributes = tables["more"].join(tables["genes"], ["tax_id", "gene_id"]).groupBy("tax_id", "gene_id").count()
    assert "Exchange" not in final_plan(attributes)[1]
    by_year = citations.gene_by_year(tables["genes"], tables["pairs"], tables["dates"])
    assert final_plan(by_year)[1].count("Exchange hashpartitioning") <= 2  # of the counts, never of the rows or the genes
    assert values(by_year) == values(citations.gene_by_year(plain["genes"], plain["pairs"], plain["dates"]))


def test_gene_lists_of_a_year(spark, values):
    pairs = spark.createDataFrame([(9, g, p) for g in range(40) for p in range(g % 7 + 1)], "tax_id int, gene_id bigint, pmid bigint")
    dates = spark.createDataFrame([(p, 2000) for p in range(8)], "pmid bigint, year int")
    genes = spark.createDataFrame([(9, g, "s", "d") for g in range(40)], "tax_id int, gene_id bigint, symbol string, description string")
    lists = ranking.gene_lists_by_year(genes, pairs, dates, min_count=2, size=6).orderBy("block").collect()
    assert [len(r.genes) for r in lists[:-1]] == [6] * (len(lists) - 1) and [r.block for r in lists] == list(range(len(lists)))
    whole = [(g.citations, g.gene_id) for r in lists for g in r.genes]
    assert whole == sorted(((g % 7 + 1, g) for g in range(40) if g % 7 >= 2), reverse=True)
    top = ranking.top_genes_by_year(genes, pairs, dates, k=5, min_count=2).orderBy("pos").collect()
    assert [(r.citations, r.gene_id) for r in top] == whole[:5]


def citing(spark):
    """A third of the citations go to one paper, a third come from one gene; some rows are repeated."""
    rng = random.Random(12)
    rows = [(9, rng.randrange(20), 5) for _ in range(100)] + [(9, 3, rng.randrange(60)) for _ in range(100)]
    rows += [(rng.choice([9, 10]), rng.randrange(20), rng.randrange(60)) for _ in range(100)]
    return spark.createDataFrame(rows, "tax_id int, gene_id bigint, pmid bigint")


def test_batches_of_dates_add_up_to_a_full_count(spark, values, tmp_path):
    """In any number of batches, with papers dated twice and later, undated papers, and batches run again."""
    pairs, rng = citing(spark), random.Random(4)
    batches = [[(rng.choice([None, *range(70)]), rng.choice([None, 1999, 2000, 2001, 2002])) for _ in range(40)] for _ in range(5)] + [[]]
    frames = [spark.createDataFrame(rows, "pmid bigint, year int") for rows in batches]
    store, states = str(tmp_path / "store"), []
    for number, frame in enumerate(frames):
        increments.add_batch(pairs, frame, store, number)
        whole = spark.createDataFrame([r for rows in batches[: number + 1] for r in rows if None not in r], "pmid bigint, year int")
        states.append(values(increments.current_counts(spark, store)))
        assert states[-1] == values(citations.citation_counts(pairs, whole))
    for number in (2, 5, 0, 4):  # run again, in any order
        increments.add_batch(pairs, frames[number], store, number)
        assert values(increments.current_counts(spark, store)) == states[-1]
    assert increments.current_counts(spark, str(tmp_path / "none")).count() == 0


def test_a_corrected_batch_is_taken_over(spark, values, tmp_path):
    pairs, store = citing(spark), str(tmp_path / "store")
    first, second, better = ([(p, y) for p in range(60)] for y in (2000, 2001, 1999))
    for number, rows in ((0, first), (1, second), (1, better)):
        increments.add_batch(pairs, spark.createDataFrame(rows, "pmid bigint, year int"), store, number)
    assert values(increments.current_counts(spark, store)) == values(citations.citation_counts(pairs, spark.createDataFrame(first, "pmid bigint, year int")))


def test_counts_follow_the_daily_files(spark, values, tmp_path):
    pairs, days = citing(spark), tmp_path / "days"
    for day, ids in (("2001-01-05", range(30)), ("2002-03-01", range(20, 50)), ("2000-07-07", range(60))):
        (days / day).mkdir(parents=True)
        (days / day / "ids.ssv").write_text("".join(f"{day} {i}\n" for i in ids))
        for _ in range(2):  # the second run finds nothing new
            stream = streaming.stream_daily_dates(spark, str(days))
            increments.follow(pairs, stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    rows = [(i, 2002 if 20 <= i < 50 else 2001 if i < 30 else 2000) for i in range(60)]
    whole = spark.createDataFrame(rows, "pmid bigint, year int")
    assert values(increments.current_counts(spark, str(tmp_path / "store"))) == values(citations.citation_counts(pairs, whole))


@pytest.mark.parametrize("keys", ["plain", "spread"])
def test_months_of_diseases(spark, values, request, keys):
    if keys == "spread":
        request.getfixturevalue("salted")
    pairs = citing(spark)
    days = [(n % 60, None if n % 9 == 0 else datetime.date(2000 + n % 2, n % 12 + 1, n % 28 + 1)) for n in range(150)]
    dates = spark.createDataFrame(days, "pmid bigint, pub_date date")
    held = [(g, f"d{g % 4}", k) for g in range(25) for k in ("a", "b")] + [(3, f"d{n}", "a") for n in range(40)] + [(None, "d1", "a")]
    links = spark.createDataFrame(held, "geneId bigint, diseaseId string, associationType string")
    latest = {}
    for pmid, day in days:
        if day:
            latest[pmid] = max(day, latest.get(pmid, day))
    months = {}
    for _, gene, pmid in pairs.collect():
        if pmid in latest:
            key = gene, latest[pmid].replace(day=1)
            months[key] = months.get(key, 0) + 1
    expected = {}
    for gene, named in {(g, d) for g, d, _ in held}:
        for (of, month), n in months.items():
            if of == gene:
                genes, count = expected.get((named, month), (0, 0))
                expected[named, month] = genes + 1, count + n
    found = disease.disease_by_month(disease.gene_by_month(pairs, dates), links)
    assert values(found) == sorted(((*k, *v) for k, v in expected.items()), key=repr)


@pytest.mark.parametrize("name, dealt", [("gene_by_year_fanout", 2), ("disease_by_month", 4), ("annotation_exon_unions", 4)])
def test_reports_are_dealt_by_the_rows_of_their_tables(spark, large, values, name, dealt):
    """Narrow rows would else be merged by their bytes into tasks of millions."""
    folder = "/root/testdata/sf0.001"
    expected = REGISTRY[name](spark, folder)
    assert "REPARTITION_BY_NUM" not in expected._jdf.queryExecution().executedPlan().toString()
    expected = values(expected)
    large.setattr(skew, "TASK_ROWS", 100)
    found = REGISTRY[name](spark, folder)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= dealt
    assert values(found) == expected
