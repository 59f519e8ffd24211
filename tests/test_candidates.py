from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from claimsieve.catalog import queries
from claimsieve.operators import candidates as cand

FITNESS = "search_id string, generation int, ind bigint, fitness double"


def population(spark, size=6, genes=30):
    features = spark.range(genes).select(F.lit("s").alias("search_id"), F.col("id").alias("gene"))
    return cand.init_subsets(features, size)


def bits(df, member="ind"):
    out = defaultdict(dict)
    for r in df.collect():
        out[r[member]][r["gene"]] = r["bit"]
    return out


def test_population_rates(spark):
    rate = {r["ind"]: r["selection_rate"] for r in cand.selection_rate(population(spark, 9, 3000)).collect()}
    assert all(0.07 < rate[i] < 0.33 for i in range(3))
    assert all(0.27 < rate[i] < 0.63 for i in range(3, 6))
    assert all(0.57 < rate[i] < 0.93 for i in range(6, 9))


def test_tournament_draws_different_members(spark):
    fitness = spark.createDataFrame([("s", 0, i, float(i)) for i in range(5)], FITNESS)
    won = cand.tournament(fitness, 3).collect()
    # the winner of three different members of five is at least the third weakest
    assert len(won) == 5 and all(r["ind"] >= 2 for r in won)
    alone = cand.tournament(spark.createDataFrame([("s", 0, 0, 1.0)], FITNESS), 3).collect()
    assert [r["ind"] for r in alone] == [0]


def test_pairs_are_of_two_slots(spark):
    pool = spark.range(4).select(
        F.lit("s").alias("search_id"), F.lit(0).alias("generation"), F.col("id").alias("slot"), F.col("id").alias("ind")
    )
    pairs = cand.draw_pairs(pool, 50).collect()
    assert len(pairs) == 50 and all(r["parent1"] != r["parent2"] for r in pairs)
    assert len(Counter((r["parent1"], r["parent2"]) for r in pairs)) > 8


def test_children_come_from_their_parents(spark):
    people = population(spark).cache()
    pool = people.select("search_id", "generation", F.col("ind").alias("slot"), "ind").distinct()
    pairs = cand.draw_pairs(pool, 3).cache()
    old, new = bits(people), bits(cand.cross_subsets(pairs, people), "child")
    for p in pairs.collect():
        a, b = old[p["parent1"]], old[p["parent2"]]
        for gene in a:
            one, two = new[2 * p["pair"]][gene], new[2 * p["pair"] + 1][gene]
            assert sorted((one, two)) == sorted((a[gene], b[gene]))


def test_next_generation_keeps_size_and_elites(spark):
    people = population(spark).cache()
    fitness = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate([0.1, 0.9, 0.9, 0.3, 0.2, 0.8])], FITNESS)
    top = cand.elites(fitness)
    assert [r["ind"] for r in top.orderBy("place").collect()] == [1, 2]
    pairs = cand.draw_pairs(cand.tournament(fitness), 2)
    children = cand.flip_bits(cand.cross_subsets(pairs, people), 30)
    nxt = cand.next_generation(top, children, people, 6, ["gene", "bit"]).cache()
    assert nxt.select("generation", "ind").distinct().count() == 6
    assert bits(nxt)[0] == bits(people)[1] and bits(nxt)[1] == bits(people)[2]
    assert nxt.first()["generation"] == 1


def test_equal_subsets_are_scored_once(spark):
    rows = [("s", 0, i, g, b) for i, code in enumerate(["101", "011", "101"]) for g, b in enumerate(map(int, code))]
    df = spark.createDataFrame(rows, "search_id string, generation int, ind bigint, gene int, bit int")
    assert {r["ind"]: r["scored_ind"] for r in cand.distinct_candidates(df).collect()} == {0: 0, 1: 1, 2: 0}


def test_running_best_never_falls_and_keeps_the_earliest(spark):
    rows = [("s", 0, 0, 0.5), ("s", 0, 1, 0.5), ("s", 1, 0, 0.4), ("s", 2, 3, 0.5), ("s", 3, 2, 0.7)]
    got = cand.running_best(spark.createDataFrame(rows, FITNESS)).orderBy("generation").collect()
    assert [(r["best_generation"], r["best_ind"], r["best_fitness"]) for r in got] == [
        (0, 0, 0.5),
        (0, 0, 0.5),
        (0, 0, 0.5),
        (3, 2, 0.7),
    ]


def test_settings_stay_in_range(spark):
    searches = spark.createDataFrame([("s",)], "search_id string")
    start = cand.init_settings(searches, 30)
    shaken = cand.shake_settings(start.withColumnRenamed("ind", "child"), 20, rate=1.0, strength=5.0)
    for df in (start, shaken):
        for gene in cand.SETTING_GENES:
            low, high = df.agg(F.min(gene), F.max(gene)).first()
            assert 0.0 <= low and high <= 1.0
    kernels = [r["kernel"] for r in cand.decode_settings(start).orderBy("ind").collect()]
    assert set(kernels[:10]) == {"linear"} and set(kernels[10:20]) == {"rbf"}


def test_elite_filter_runs_before_the_shuffle(spark):
    fitness = spark.createDataFrame([("s", 0, 0, 1.0)], FITNESS)
    assert "WindowGroupLimit" in cand.elites(fitness)._jdf.queryExecution().optimizedPlan().toString()


def unpacked(df, n, member="ind"):
    """Bit sets as a mapping like :func:`bits`."""
    return {r[member]: {g: int(g in set(cand.genes_of(r["bits"]))) for g in range(n)} for r in df.collect()}


def test_bitsets_equal_gene_rows(spark):
    for n in (130,):
        rows = population(spark, 7, n)
        packed = cand.init_bitsets(rows.select("search_id"), n, 7)
        assert unpacked(packed, n) == bits(rows)
        counted = {r["ind"]: r["n_selected"] for r in cand.selection_rate(rows).collect()}
        assert {r["ind"]: r["n"] for r in packed.select("ind", cand.bit_count("bits").alias("n")).collect()} == counted
        fitness = spark.createDataFrame([("s", 0, i, i / 10) for i in range(7)], FITNESS)
        pairs = cand.draw_pairs(cand.tournament(fitness), 4)
        crossed, crossed_bits = cand.cross_subsets(pairs, rows), cand.cross_bitsets(pairs, packed, n)
        assert unpacked(crossed_bits, n, "child") == bits(crossed, "child")
        flipped, flipped_bits = cand.flip_bits(crossed, 4, 0.4), cand.flip_bitsets(crossed_bits, n, 4, 0.4)
        assert unpacked(flipped_bits, n, "child") == bits(flipped, "child")
        top = cand.elites(fitness)
        after = cand.next_generation(top, flipped, rows, 7, ["gene", "bit"])
        assert unpacked(cand.next_generation(top, flipped_bits, packed, 7, ["bits"]), n) == bits(after)


def many_members(spark):
    """More rows than the optimizer believes: candidates exploded from a small table of searches."""
    searches = spark.range(20).select(F.col("id").cast("string").alias("search_id"), F.lit(0).alias("generation"))
    return searches.withColumn("ind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_members_are_never_broadcast(spark):
    members = many_members(spark)
    fitness = members.withColumn("fitness", F.lit(0.5))
    subsets = members.withColumns({"gene": F.col("ind"), "bit": F.lit(1)})
    settings = members.withColumns({g: F.lit(0.5) for g in cand.SETTING_GENES})
    pairs = cand.draw_pairs(members.withColumn("slot", F.col("ind")), 2)
    children = cand.cross_subsets(pairs, subsets)
    built = [
        pairs,
        children,
        cand.cross_settings(pairs, settings),
        cand.tournament(fitness),
        cand.next_generation(cand.elites(fitness), children, subsets, 5, ["gene", "bit"]),
    ]
    for df in built:
        assert "Join" in plan_of(df) and "Broadcast" not in plan_of(df)
    assert cand.cross_settings(pairs, settings).count() == 20 * 4


def test_catalog_members_are_dealt_out_before_they_are_exploded(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = queries.members(spark, str(tmp_path))
    assert rows.count() == 600
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
