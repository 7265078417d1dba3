"""Every named query against its SQL equivalent on the smallest tables."""

import compare
import pytest

import __spark_entry__ as driver
from catalog.oracle import STATEMENTS
from catalog.queries import REGISTRY as QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    result = QUERIES[name](spark, FOLDER)
    assert compare.spark_types(result) == compare.duckdb_types(oracle, STATEMENTS[name])
    assert compare.spark_rows(result) == compare.duckdb_rows(oracle, STATEMENTS[name])


HEAVY = ["gene_by_year", "gene_by_year_fanout", "genes_per_paper", "pubs_with_year", "gene_annotations", "refgene_counts",
         "paper_coverage_top10", "transcript_by_year", "transcripts_unmatched", "pagerank3", "symbol_index"]


@pytest.mark.parametrize("name", HEAVY)
def test_query_with_spread_keys(spark, oracle, salted, name):
    found = compare.spark_rows(QUERIES[name](spark, FOLDER))
    assert found == compare.duckdb_rows(oracle, STATEMENTS[name])


@pytest.mark.parametrize("name, sketches", [("gene_annotations", 1), ("refseq_citations", 0), ("cited_genes", 0)])
def test_sketches_of_a_report(spark, salted, monkeypatch, name, sketches):
    from citetide.operators import skew

    ran, whole = [], skew._sketched
    monkeypatch.setattr(skew, "_sketched", lambda sources: ran.append(1) or whole(sources))
    QUERIES[name](spark, FOLDER)
    assert len(ran) == sketches


def test_entry(spark):
    assert driver.entry(spark).columns[-1] == "citations"


def test_identities(spark):
    def total(name, column="citations"):
        return QUERIES[name](spark, FOLDER).agg({column: "sum"}).first()[0]

    whole = total("gene_total")
    assert total("gene_by_year") == whole
    assert total("citations_by_type") == whole
    assert total("citations_per_year") == whole
    assert total("type_year_dense", "value") == whole
    assert total("gene_row_counts") == total("gene_counts")
