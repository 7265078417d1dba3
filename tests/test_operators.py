"""Operators against brute force, on small inputs laid out as large ones."""

import random

import pytest
from pyspark.sql import functions as F

from citetide import session
from citetide.operators import counting, dedupe, graph, intervals, lists, running, skew, topk
from citetide.plans import citations


def facts(spark, rows=900):
    """A third of the rows share one key, some are copies, some keys are null."""
    data = []
    for n in range(rows):
        key = 7 if n % 3 == 0 else (None if n % 50 == 1 else n % 40)
        data.append((key, n // 2, f"v{n % 5}"))
    return spark.createDataFrame(data, "k bigint, a bigint, v string"), data


def test_hot_key_is_found(spark):
    df, _ = facts(spark, 9000)
    hot = skew.hot_keys(df.filter("k is not null"), ["k"])
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    assert seven in hot


def test_hot_paper_is_spread_and_counted(spark, large, values):
    """A third of the rows cite one paper, and a third are copies of one row."""
    data = [(1, 5, 8)] * 3000 + [(1, n, 7) for n in range(3000)] + [(1, n % 50, 100 + n) for n in range(3000)]
    rows = spark.createDataFrame(data, "tax_id int, gene_id bigint, pmid bigint")
    dates = spark.createDataFrame([(p, 2000 + p % 3) for p in range(0, 3000)], "pmid bigint, year int")
    hot = skew.hot_keys(rows, ["pmid"])
    assert len(hot) == 2
    spread = skew.spread(rows.distinct(), ["pmid"], hot, "salt", ["gene_id"])
    assert spread.groupBy("pmid", "salt").count().agg({"count": "max"}).first()[0] < 60
    expected = {}
    for tax, gene, pmid in data:
        if pmid < 3000:
            key = (tax, gene, 2000 + pmid % 3)
            expected[key] = expected.get(key, 0) + 1
    counts = citations.citation_counts(rows, dates)
    assert "_salt_left" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert values(counts) == sorted(((*key, n) for key, n in expected.items()), key=repr)


def test_tables_are_pinned_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_folder(spark)
    assert named is None or named.rstrip("/") in folder
    pinned = session.pin(spark.range(5).withColumn("t", F.lit("x")))
    assert folder.split(":")[-1] in pinned.inputFiles()[0]
    assert pinned.count() == 5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, salted, values, how):
    df, _ = facts(spark)
    dim = spark.createDataFrame([(k, f"d{k}") for k in (None, 7, 3, 5, 99)], "k bigint, d string")
    joined = skew.skew_join(df, dim, "k", how)
    assert "_salt_left" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert values(joined) == values(df.join(dim, "k", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("kinds", [("int", "bigint"), ("bigint", "int"), ("int", "string"), ("decimal(9,2)", "bigint")])
def test_skew_join_of_keys_with_different_types(spark, salted, values, how, kinds):
    df, _ = facts(spark)
    dim = spark.createDataFrame([(k, f"d{k}") for k in (None, 7, 3, 5, 99)], "k bigint, d string")
    df, dim = df.withColumn("k", F.col("k").cast(kinds[0])), dim.withColumn("k", F.col("k").cast(kinds[1]))
    joined, plain = skew.skew_join(df, dim, "k", how), df.join(dim, "k", how)
    assert "_salt_left" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.schema == plain.schema
    assert values(joined) == values(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_of_collated_keys(spark, salted, values, how):
    df = spark.range(400).select(F.expr("if(id % 3 = 0, 'Ab', 'aB') collate utf8_lcase").alias("k"), "id")
    dim = spark.sql("select 'AB' collate utf8_lcase as k, 1 as d")
    assert values(skew.skew_join(df, dim, "k", how)) == values(df.join(dim, "k", how))


def test_first_row_prefers_values_to_nulls(spark, values):
    df = spark.createDataFrame([(1, "a", "x"), (1, None, "q"), (2, None, None)], "k int, s string, t string")
    assert values(counting.first_by(df, ["k"], ["s", "t"])) == [(1, "a", "x"), (2, None, None)]


def test_skew_join_spreads_both_sides(spark, salted, values):
    df, _ = facts(spark, 120)
    other = df.select("k", F.col("v").alias("w"))
    joined = skew.skew_join(df, other, "k", both=True)
    assert "_salt_right" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert values(joined) == values(df.join(other, "k"))
    with pytest.raises(ValueError):
        skew.skew_join(df, other, "k", "left", both=True)


def test_uniform_keys_are_not_salted(spark, large):
    df = spark.range(20000).select(F.col("id").alias("k"))
    plan = skew.skew_join(df, df.select("k"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan


def test_running_in_chunks(spark, values):
    data = [(g, n, n * 3 % 11) for g in ("a", "b") for n in range(25)]
    df = spark.createDataFrame(data, "g string, n bigint, v bigint")
    chunk = F.floor(F.col("n") / 4)
    for inclusive in (False, True):
        whole = running.running(df, ["g"], ["n"], "v", "s", None, inclusive)
        chunked = running.running(df, ["g"], ["n"], "v", "s", chunk, inclusive)
        assert values(whole, "g", "n", "s") == values(chunked, "g", "n", "s")
        expected = [(g, n, sum(v for h, m, v in data if h == g and (m < n or inclusive and m == n))) for g, n, _ in data]
        assert values(chunked, "g", "n", "s") == sorted(expected, key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_global_index(spark, values, small):
    words = sorted({f"w{n * 37 % 211}" for n in range(300)})
    df = spark.createDataFrame([(w,) for w in random.Random(1).sample(words, len(words))], "w string")
    numbered = running.global_index(df, [F.col("w")], small=small)
    assert values(numbered) == sorted(((w, n) for n, w in enumerate(words)), key=repr)


def brute_unions(rows):
    merged = []
    for start, end in sorted(rows):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(pair) for pair in merged]


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_interval_unions(spark, monkeypatch, values, bits):
    monkeypatch.setattr(intervals, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    data = []
    for group in range(12):
        for _ in range(rng.choice([1, 5, 40])):
            start = rng.randrange(0, 120)
            data.append((group, start, start + rng.choice([0, 1, 3, 30])))
    data += data[:50]
    df = spark.createDataFrame(data, "g int, s bigint, e bigint")
    expected = [(g, *pair) for g in range(12) for pair in brute_unions([(s, e) for h, s, e in data if h == g])]
    assert values(intervals.union_intervals(df, ["g"], "s", "e")) == sorted(expected, key=repr)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("reach", [1, 500])
def test_interval_windows_run_once(spark, large, monkeypatch, reach):
    """Two windows over the intervals, two over the chunks; none over the chunks if no interval leaves its chunk."""
    monkeypatch.setattr(intervals, "CHUNK_BITS", 6)
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") % 900 * 64).alias("s"))
    plan = final_plan(intervals.union_intervals(df.withColumn("e", F.col("s") + reach), ["g"], "s", "e"))
    assert plan.count("Window [") == (4 if reach > 64 else 2)
    assert plan.count("ReusedExchange") == 1 or reach == 1


def test_hot_keys_of_many_empty_partitions(spark, large):
    df = spark.range(10_000, numPartitions=3).select((F.col("id") % 2 * F.col("id")).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert skew.hot_keys(df, ["k"]) == [spark.range(1).select(F.xxhash64(F.lit(0).cast("bigint"))).first()[0]]
        assert skew.hot_keys(df.limit(0), ["k"]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_joins_share_key_statistics(spark, salted, values, monkeypatch):
    """Two joins over three columns of two tables run one sketch; a column that must be cast runs its own."""
    df, _ = facts(spark, 120)
    dim = spark.createDataFrame([(k, f"d{k}") for k in (None, 7, 3, 5, 99)], "k bigint, d string")
    ran = []
    whole = skew._sketched
    monkeypatch.setattr(skew, "_sketched", lambda sources: ran.append(sorted(sources)) or whole(sources))
    known = skew.KeyStatistics({"a": (df, ["k"]), "b": (dim, ["k"]), "v": (df, ["v"])})
    assert ran == []
    joined = skew.skew_join(df, dim, "k", both=True, probe=known["a"], probe_right=known["b"])
    assert values(joined) == values(df.join(dim, "k"))
    more = skew.skew_join(joined, df.select("v").distinct(), "v", probe=known["v"])
    assert values(more) == values(joined.join(df.select("v").distinct(), "v"))
    assert ran == [["a", "b", "v"]]
    text = df.withColumn("k", F.col("k").cast("string"))  # compared as a number
    typed = skew.KeyStatistics({"t": (text, ["k"]), "v": (text, ["v"])})
    for how in ("left", "left_semi"):
        assert values(skew.skew_join(text, dim, "k", how, probe=typed["t"])) == values(text.join(dim, "k", how))
    assert ran[1:] == [[""]]
    with pytest.raises(KeyError):
        known["c"]


def test_a_unique_side_needs_no_sketch(spark, salted, values):
    df, _ = facts(spark)
    dim = spark.createDataFrame([(k, f"d{k}") for k in (None, 7, 3, 5, 99)], "k bigint, d string")
    joined = skew.skew_join(df, dim, "k", unique=True)
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert values(joined) == values(df.join(dim, "k"))


def test_touching_intervals_merge(spark, values):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 2, 3)], "g int, s bigint, e bigint")
    assert values(intervals.union_intervals(df, ["g"], "s", "e")) == [(1, 0, 9), (1, 10, 12)]


def brute_ranks(edges, rounds, damping=0.85):
    links = {}
    for src, dst in {e for e in edges if "-" not in e}:
        links.setdefault(src, []).append(dst)
    ranks = dict.fromkeys(links, 1.0)
    for _ in range(rounds):
        got = {}
        for src in links:
            if src in ranks:
                for dst in links[src]:
                    got[dst] = got.get(dst, 0.0) + ranks[src] / len(links[src])
        ranks = {node: damping * value + 0.15 for node, value in got.items()}
    return ranks


EDGES = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "sink"), ("source", "a"), ("-", "a"), ("b", "-"),
         ("x-y", "a"), ("c", "x-y")]


@pytest.mark.parametrize("rounds", [0, 1, 3, 7])
def test_pagerank(spark, rounds):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    ranks = dict(map(tuple, graph.pagerank(edges, rounds, checkpoint_every=2).collect()))
    assert ranks == pytest.approx(brute_ranks(EDGES, rounds))
    assert ("source" in ranks) == (rounds == 0)
    assert ("sink" in ranks) == (rounds > 0)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_pagerank_of_a_hub(spark, salted, block):
    edges = [("hub", f"n{n}") for n in range(60)] + [(f"n{n}", "hub") for n in range(0, 60, 7)]
    df = spark.createDataFrame(edges, "src string, dst string")
    ranks = dict(map(tuple, graph.pagerank(df, 4, block=block).collect()))
    assert ranks == pytest.approx(brute_ranks(edges, 4))


def test_a_hub_is_split_into_blocks(spark):
    """A third of all links leave one source; no block is longer than asked, and the blocks are dealt out."""
    edges = [("hub", f"n{n:04d}") for n in range(3000)] * 2 + [(f"n{n % 1500:04d}", f"n{n}") for n in range(6000)]
    blocks = graph.adjacency(spark.createDataFrame(edges + [("-", "x"), ("x", "-")], "src string, dst string"), 100)
    held = {}
    for r in blocks.collect():
        assert 1 <= len(r.targets) <= 100
        held.setdefault(r.src, []).append((r.block, r.targets))
    assert [b for b, _ in sorted(held["hub"])] == list(range(30))
    targets = {}
    for src, dst in set(edges):
        targets.setdefault(src, []).append(dst)
    assert {src: [t for _, part in sorted(parts) for t in part] for src, parts in held.items()} == {s: sorted(t) for s, t in targets.items()}


def test_blocked_lists(spark, values):
    data = [(n % 3 or None, n % 7, f"v{n % 50}" if n % 50 else None) for n in range(400)]
    df = spark.createDataFrame(data, "k int, a int, v string")
    blocks = lists.blocked_lists(df, ["k"], ["v", "a"], [F.desc("v"), F.asc("a")], size=9, name="found")
    rows = {}
    for r in blocks.collect():
        assert len(r.found) <= 9
        rows.setdefault(r.k, []).append((r.block, [(x.v, x.a) for x in r.found]))
    for k, parts in rows.items():
        assert all(len(part) == 9 for _, part in sorted(parts)[:-1])
        whole = [x for _, part in sorted(parts) for x in part]
        mine = {(v, a) for key, a, v in data if key == k}
        assert whole == sorted(sorted(mine, key=lambda x: x[1]), key=lambda x: x[0] or "", reverse=True)
    assert values(lists.unblocked(blocks, "found").select("k", "found.v", "found.a")) == values(df.select("k", "v", "a").distinct())
    assert lists.blocked_lists(df.limit(0), ["k"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        lists.blocked_lists(df, ["k"], ["v"], size=0)


def test_top_per_group(spark, values):
    data = [(n % 3, n * 7 % 23, n) for n in range(90)]
    df = spark.createDataFrame(data, "g int, v int, n int")
    order = [F.desc("v"), F.asc("n")]
    expected = []
    for g in range(3):
        ranked = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:5]
        expected += [(*r, pos) for pos, r in enumerate(ranked)]
    assert values(topk.top_per_group(df, "g", order, 5)) == sorted(expected, key=repr)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        assert values(topk.top_per_group(df, "g", order, 5)) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS v")
    plan = topk.top_per_group(df, "g", [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_survivors(spark, values):
    g2r = spark.createDataFrame(
        [(9, 1, "NM_2.1"), (9, 1, "NM_2.2"), (9, 1, "NM_1.1"), (9, 2, "NM_2.1"), (9, 2, "-"), (9, 3, "-"), (9, 1, "-")],
        "tax_id int, gene_id bigint, accession string",
    )
    assert values(dedupe.gene_of_refseq(g2r)) == [("-", 9, 1), ("NM_1", 9, 1), ("NM_2", 9, 1)]
    assert values(dedupe.refseq_of_gene(g2r)) == [(9, 1, "NM_1")]
    assert values(dedupe.gene_refseq_pairs(g2r)) == [(1, "NM_1"), (1, "NM_2"), (2, "NM_2")]
    only = g2r.filter("gene_id = 3")
    assert values(dedupe.refseq_of_gene(only)) == [(9, 3, "-")]


def test_category_index(spark, values):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "t string")
    assert values(counting.index_categories(df, "t")) == [("a", 0), ("b", 1), ("c", 2)]


def test_joins_are_dealt_by_their_rows(spark, large, values):
    """A known number of rows sets the tasks of a join, with and without hot keys; the rows stay the same."""
    large.setattr(skew, "TASK_ROWS", 10)
    left = spark.range(2000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    expected = values(left.join(right, "k"))
    two = [row.key for row in left.filter("v < 2").select(F.xxhash64("k").alias("key")).collect()]
    for more in ({"unique": True}, {"hot": two}, {"hot": []}, {"both": True}):
        joined = skew.skew_join(left, right, "k", rows=2000, **more)
        assert final_plan(joined).count("200), REPARTITION_BY_NUM") == 2
        assert values(joined) == expected
    assert "REPARTITION_BY_NUM" not in final_plan(skew.deal(left, 80, "k"))
