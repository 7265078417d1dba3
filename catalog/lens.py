"""The given order tables read as the library's domain tables.

A part is a gene (its brand the species, its type the gene type), an order is a paper, a supplier a
transcript and a nation a chromosome. Every lens covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetide.functions.scalars import iso_day
from citetide.operators.skew import deal


#: Layouts of the tables that are read, so that no job is spent on inferring them.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


class Lens:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def rows(self, name: str) -> int:
        """Number of rows of a table, from the files' footers."""
        return self.table(name).count()

    def _parts(self) -> DataFrame:
        return self.table("part").select(
            F.substring("p_brand", 7, 10).cast("int").alias("tax_id"), F.col("p_partkey").alias("gene_id")
        )

    def gene2pubmed(self) -> DataFrame:
        rows = self.table("lineitem").select(F.col("l_partkey").alias("gene_id"), F.col("l_orderkey").alias("pmid"))
        return rows.join(self._parts(), "gene_id").select("tax_id", "gene_id", "pmid")

    def gene_info(self) -> DataFrame:
        return self.table("part").select(
            F.substring("p_brand", 7, 10).cast("int").alias("tax_id"),
            F.col("p_partkey").alias("gene_id"),
            F.col("p_name").alias("symbol"),
            F.concat_ws(" ", "p_name", "p_brand").alias("description"),
            F.col("p_type").alias("type_of_gene"),
            F.concat_ws(" ", "p_type", "p_name").alias("full_name"),
        )

    def pmid_dates(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("pmid"),
            F.year("o_orderdate").alias("year"),
            F.to_date("o_orderdate").alias("pub_date"),
        )

    def pmid_dates_multi(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("pmid"),
            F.year("l_shipdate").alias("year"),
            F.to_date("l_shipdate").alias("pub_date"),
        )

    def gene2refseq(self) -> DataFrame:
        """Some suppliers stand for genes without an accession, so their transcripts have no gene."""
        number = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
        accession = F.concat(F.lit("NM_"), number, F.lit("."), F.col("l_linenumber").cast("string"))
        missing = F.col("l_suppkey") % 13 == 0
        rows = self.table("lineitem").select(
            F.col("l_partkey").alias("gene_id"), F.when(missing, "-").otherwise(accession).alias("accession")
        )
        rows = deal(rows, self.rows("lineitem"), "gene_id", "accession").distinct()
        return rows.join(self._parts(), "gene_id").select("tax_id", "gene_id", "accession")

    def refgene(self) -> DataFrame:
        alt = F.when(F.col("s_suppkey") % 9 == 0, "_alt").otherwise("")
        rows = self.table("supplier").select(
            F.concat(F.lit("NM_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("name"),
            F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"), alt).alias("chrom"),
            F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"),
            (F.col("s_suppkey") * 1000).alias("tx_start"),
            (F.col("s_suppkey") * 1000 + F.floor(F.abs("s_acctbal")) + 1).alias("tx_end"),
            F.col("s_name").alias("gene_name"),
        )
        start, end = F.col("tx_start"), F.col("tx_end")
        return rows.select(
            "name",
            "chrom",
            "strand",
            "tx_start",
            "tx_end",
            start.alias("cds_start"),
            end.alias("cds_end"),
            F.lit(2).alias("exon_count"),
            F.concat(start.cast("string"), F.lit(","), (end - 1).cast("string"), F.lit(",")).alias("exon_starts"),
            F.concat((start + 1).cast("string"), F.lit(","), end.cast("string"), F.lit(",")).alias("exon_ends"),
            "gene_name",
        )

    def exons(self) -> DataFrame:
        start = F.col("l_partkey") * 10000 + F.col("l_linenumber") * 70
        longer = F.when(F.col("l_linenumber") % 3 == 0, 30).otherwise(0)
        return self.table("lineitem").select(
            F.col("l_partkey").alias("gene_id"),
            F.concat(F.lit("chr"), (F.col("l_partkey") % 25).cast("string")).alias("chrom"),
            F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
            start.alias("exon_start"),
            (start + F.floor("l_quantity") + longer).alias("exon_end"),
        )

    def chrom_info(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("chrom"),
            ((F.col("n_nationkey") * 37 % 11 + 1) * 1000000).cast("bigint").alias("length"),
        )

    def gene_diseases(self) -> DataFrame:
        kind = (
            F.when(F.col("l_returnflag") == "A", "GeneticVariation")
            .when(F.col("l_returnflag") == "N", "Biomarker")
            .otherwise("Therapeutic")
        )
        rows = self.table("lineitem").select(
            F.col("l_partkey").alias("geneId"), F.col("l_suppkey").alias("diseaseId"), kind.alias("associationType")
        )
        # nearly all rows differ, so counting them before the shuffle would only fill the memory of the scan
        keys = ["geneId", "diseaseId", "associationType"]
        return deal(rows, self.rows("lineitem"), *keys).groupBy(*keys).agg(F.count("*").alias("NumberOfPubmeds"))

    def interactions(self) -> DataFrame:
        """Parts point at every 25th part number through their suppliers; numbers beyond the last part have
        no out-links, and some links have no target."""
        missing = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
        target = F.when(missing, "-").otherwise((F.col("l_suppkey") * 25).cast("string"))
        return self.table("lineitem").select(F.col("l_partkey").cast("string").alias("src"), target.alias("dst"))

    def lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat_ws(" ", "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber").alias("value")
        )

    def responses(self) -> DataFrame:
        """One search response per order, holding the order and customer numbers as ids."""
        ids = F.concat(
            F.lit("<IdList><Id>"), F.col("o_orderkey"), F.lit("</Id>\n<Id>"), F.col("o_custkey"), F.lit("</Id></IdList>")
        )
        return self.table("orders").select(iso_day(F.col("o_orderdate")).alias("pub_date"), ids.alias("text"))
