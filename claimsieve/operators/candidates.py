"""One generation of an evolutionary search, as table operations.

Populations are tables keyed by ``search_id`` so that any number of searches move forward together.
Subset candidates are stored as one row per gene: ``(search_id, generation, ind, gene, bit)``; ``gene``
is a feature name or position. In a search whose genes are positions 0..n-1 a candidate is one row with a bit set:
``(search_id, generation, ind, bits)``, 64 genes a number, drawn by the same keys as the gene rows. Setting candidates have one row each, with ``c_norm``, ``gamma_norm`` and
``kernel_norm``. ``ind`` runs from 0 to the population size less 1. No step pairs rows of a search with
each other: partners are drawn as indices and fetched by equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions import scores
from claimsieve.functions.draws import SEED, normal, uniform, uniform_between, with_distinct_picks
from claimsieve.operators.layout import unbounded

SETTING_GENES = ("c_norm", "gamma_norm", "kernel_norm")


def _numbers(count: int) -> Column:
    """Generator of 0..count-1 as bigint."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def _members(df: DataFrame, population: int) -> DataFrame:
    return df.withColumn("ind", _numbers(population))


def init_subsets(features: DataFrame, population: int, seed: int = SEED) -> DataFrame:
    """First generation over ``features(search_id, gene)``: low, medium and high selection rates by thirds."""
    ind, search = F.col("ind"), F.col("search_id")
    # the rate belongs to the candidate, so it is drawn once per candidate and not once per gene
    members = _members(features.select("search_id").distinct(), population)
    members = members.withColumn("_rate", _starting_rate(population, seed))
    rates = members.groupBy("search_id").agg(
        F.array_sort(F.collect_list(F.struct("ind", "_rate"))).alias("_rates")
    )
    genes = features.join(rates, "search_id").select("search_id", "gene", F.inline("_rates"))
    bit = (uniform("gene", search, ind, F.col("gene"), seed=seed) < F.col("_rate")).cast("int")
    return genes.select("search_id", F.lit(0).alias("generation"), "ind", "gene", bit.alias("bit"))


def init_settings(searches: DataFrame, population: int, ranges=scores.SvmRanges(), seed: int = SEED) -> DataFrame:
    """First generation of SVM settings: thirds of linear, rbf and free candidates."""
    third, two_thirds = population // 3, 2 * population // 3
    ind, search = F.col("ind"), F.col("search_id")

    def decade(low: float, high: float, tag: str) -> Column:
        u = uniform(tag, search, ind, seed=seed)
        return F.pow(F.lit(10.0), scores.log10(low) + u * (scores.log10(high) - scores.log10(low)))

    first, second = ind < third, (ind >= third) & (ind < two_thirds)
    c = F.when(first, decade(0.5, 2.0, "c")).otherwise(decade(*ranges.c, "c"))
    gamma = F.when(second, decade(0.01, 0.1, "gamma")).otherwise(decade(*ranges.gamma, "gamma"))
    coin = F.when(uniform("kernel", search, ind, seed=seed) < 0.5, 0.0).otherwise(1.0)
    kernel = F.when(first, 0.0).when(second, 1.0).otherwise(coin)
    return _members(searches.select("search_id").distinct(), population).select(
        "search_id",
        F.lit(0).alias("generation"),
        "ind",
        scores.encode_log(c, ranges.c).alias("c_norm"),
        scores.encode_log(gamma, ranges.gamma).alias("gamma_norm"),
        kernel.alias("kernel_norm"),
    )


def encode_settings(df: DataFrame, ranges=scores.SvmRanges()) -> DataFrame:
    return df.withColumns(
        {
            "c_norm": scores.encode_log(F.col("c"), ranges.c),
            "gamma_norm": scores.encode_log(F.col("gamma"), ranges.gamma),
            "kernel_norm": scores.encode_kernel(F.col("kernel")),
        }
    )


def decode_settings(df: DataFrame, ranges=scores.SvmRanges()) -> DataFrame:
    return df.withColumns(
        {
            "c": scores.decode_log(F.col("c_norm"), ranges.c),
            "gamma": scores.decode_log(F.col("gamma_norm"), ranges.gamma),
            "kernel": scores.decode_kernel(F.col("kernel_norm")),
        }
    )


# ---- subsets as bit sets ------------------------------------------------------------------------------


def bits_where(n_genes: int, chosen: Callable[[Column], Column]) -> Column:
    """Packed bits of the genes 0..n_genes-1 for which a condition on the gene's number holds."""

    def word(first: Column) -> Column:
        genes = F.sequence(first, F.least(first + 63, F.lit(n_genes - 1).cast("bigint")))
        one = F.lit(1).cast("bigint")
        bit = lambda g: F.when(chosen(g), F.call_function("shiftleft", one, (g - first).cast("int"))).otherwise(0)
        return F.aggregate(genes, F.lit(0).cast("bigint"), lambda acc, g: acc.bitwiseOR(bit(g)))

    firsts = F.sequence(F.lit(0).cast("bigint"), F.lit(n_genes - 1).cast("bigint"), F.lit(64).cast("bigint"))
    return F.transform(firsts, word)


def bit_count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, word: total + F.bit_count(word))


def genes_of(bits: Sequence[int]) -> list[int]:
    """The numbers of the genes of one candidate's bit set."""
    words = np.array(bits, dtype=np.int64).view(np.uint8)
    return np.flatnonzero(np.unpackbits(words, bitorder="little")).tolist()


def _starting_rate(population: int, seed: int) -> Column:
    """Share of genes that a first member selects: low, medium and high by thirds."""
    third, two_thirds = population // 3, 2 * population // 3
    ind, search = F.col("ind"), F.col("search_id")

    def rate(low: float, high: float) -> Column:
        return uniform_between(low, high, "rate", search, ind, seed=seed)

    return F.when(ind < third, rate(0.1, 0.3)).when(ind < two_thirds, rate(0.3, 0.6)).otherwise(rate(0.6, 0.9))


def init_bitsets(searches: DataFrame, n_genes: int, population: int, seed: int = SEED) -> DataFrame:
    """:func:`init_subsets` for genes 0..n_genes-1, as bit sets."""
    members = _members(searches.select("search_id").distinct(), population)
    members = members.withColumn("_rate", _starting_rate(population, seed))
    bits = bits_where(n_genes, lambda g: uniform("gene", F.col("search_id"), F.col("ind"), g, seed=seed) < F.col("_rate"))
    return members.select("search_id", F.lit(0).alias("generation"), "ind", bits.alias("bits"))


def cross_bitsets(pairs: DataFrame, population: DataFrame, n_genes: int, rate: float = 0.8, seed: int = SEED) -> DataFrame:
    """:func:`cross_subsets` by masks: (search_id, generation, child, bits)."""
    both = _parents(pairs, population, [], ["bits"])
    keys = (F.col("search_id"), F.col("generation"), F.col("pair"))
    mask = bits_where(n_genes, lambda g: uniform("mask", *keys, g, seed=seed) <= 0.5)
    none = F.transform("bits_1", lambda _: F.lit(0).cast("bigint"))
    both = both.withColumn("_mask", F.when(uniform("cross", *keys, seed=seed) <= rate, mask).otherwise(none))

    def child(a: str, b: str) -> Column:
        def word(m: Column, i: Column) -> Column:
            return F.get(a, i).bitwiseAND(F.bitwise_not(m)).bitwiseOR(F.get(b, i).bitwiseAND(m))

        return F.transform("_mask", word)

    both = both.withColumns({"_first": child("bits_1", "bits_2"), "_second": child("bits_2", "bits_1")})
    return both.select("search_id", "generation", _both_children([F.col("_first")], [F.col("_second")], ["bits"]))


def flip_bitsets(children: DataFrame, n_genes: int, generations: int, rate: float = 0.05, seed: int = SEED) -> DataFrame:
    """:func:`flip_bits` by a mask."""
    keys = (F.col("search_id"), F.col("generation"), F.col("child"))
    decayed = scores.decayed(rate, F.col("generation"), generations)
    flips = bits_where(n_genes, lambda g: uniform("flip", *keys, g, seed=seed) < decayed)
    return children.withColumn("bits", F.zip_with("bits", flips, lambda a, b: a.bitwiseXOR(b)))


# ---- what a population says of itself ----------------------------------------------------------------


def selection_rate(population: DataFrame) -> DataFrame:
    """Number and share of selected features per candidate."""
    return population.groupBy("search_id", "generation", "ind").agg(
        F.sum(F.col("bit").cast("bigint")).alias("n_selected"),
        F.count(F.lit(1)).alias("n_total"),
        F.avg(F.col("bit").cast("double")).alias("selection_rate"),
    )


def _signature() -> Column:
    """Equal exactly for equal subsets of a candidate's genes.

    Adds up two independent 48-bit hashes of the selected genes: a plain map-side aggregate.
    """
    digest = F.md5(F.col("gene").cast("string"))

    def part(start: int) -> Column:
        word = F.conv(F.substring(digest, start, 12), 16, 10).cast("bigint")
        return F.sum(F.when(F.col("bit") == 1, word).otherwise(0).cast("decimal(20,0)")).cast("string")

    n = F.sum(F.col("bit").cast("bigint")).cast("string")
    return F.concat_ws("-", n, part(1), part(13))


def signatures(population: DataFrame) -> DataFrame:
    """(search_id, generation, ind, signature)."""
    return population.groupBy("search_id", "generation", "ind").agg(_signature().alias("signature"))


def describe_subsets(population: DataFrame) -> DataFrame:
    """(search_id, generation, ind, signature, n_selected, n_total, genes): one row per candidate.

    ``genes`` holds the selected genes, at most as many as there are features.
    """
    chosen = F.collect_list(F.when(F.col("bit") == 1, F.col("gene")))
    return population.groupBy("search_id", "generation", "ind").agg(
        _signature().alias("signature"),
        F.sum(F.col("bit").cast("bigint")).alias("n_selected"),
        F.count(F.lit(1)).alias("n_total"),
        F.sort_array(chosen).alias("genes"),
    )


def distinct_candidates(population: DataFrame) -> DataFrame:
    """(search_id, generation, ind, signature, scored_ind): the member that is scored for each candidate."""
    signed = signatures(population)
    same = Window.partitionBy("search_id", "generation", "signature")
    return signed.withColumn("scored_ind", F.min("ind").over(same))


def generation_best(fitness: DataFrame) -> DataFrame:
    """(search_id, generation, ind, fitness): fittest member, the lower ``ind`` on ties."""
    best = F.max_by(F.struct("ind", "fitness"), F.struct("fitness", -F.col("ind"))).alias("_b")
    return fitness.groupBy("search_id", "generation").agg(best).select("search_id", "generation", "_b.*")


def running_best(fitness: DataFrame) -> DataFrame:
    """(search_id, generation, best_generation, best_ind, best_fitness): best so far, the earliest on ties."""
    best = generation_best(fitness)
    so_far = (
        Window.partitionBy("search_id")
        .orderBy("generation")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rank = F.struct("fitness", -F.col("generation"), -F.col("ind"))
    top = F.max_by(F.struct("generation", "ind", "fitness"), rank).over(so_far)
    return best.select("search_id", "generation", top.alias("_b")).select(
        "search_id",
        "generation",
        F.col("_b.generation").alias("best_generation"),
        F.col("_b.ind").alias("best_ind"),
        F.col("_b.fitness").alias("best_fitness"),
    )


def setting_history(fitness: DataFrame, settings: DataFrame, ranges=scores.SvmRanges()) -> DataFrame:
    """Best settings so far per generation, decoded."""
    best = running_best(fitness)
    named = settings.select(
        "search_id", F.col("generation").alias("best_generation"), F.col("ind").alias("best_ind"), *SETTING_GENES
    )
    joined = best.join(unbounded(named), ["search_id", "best_generation", "best_ind"])
    return decode_settings(joined, ranges).select(
        "search_id", "generation", "c", "gamma", "kernel", F.col("best_fitness").alias("fitness")
    )


def elites(fitness: DataFrame, count: int = 2) -> DataFrame:
    """(search_id, generation, place, ind, fitness): the fittest members; ``place`` starts at 0."""
    order = Window.partitionBy("search_id", "generation").orderBy(F.desc("fitness"), F.asc("ind"))
    ranked = fitness.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= count)
    return ranked.select(
        "search_id", "generation", (F.col("_r") - 1).cast("bigint").alias("place"), "ind", "fitness"
    )


def tournament(fitness: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """(search_id, generation, slot, ind): as many slots as members, each won by the fittest of ``size``
    different members drawn for it (all of them if there are fewer); the first drawn wins ties."""
    members = fitness.groupBy("search_id", "generation").agg(F.count(F.lit(1)).alias("_n"))
    slots = fitness.select("search_id", "generation", F.col("ind").alias("slot"))
    slots = slots.join(unbounded(members), ["search_id", "generation"])
    slots = with_distinct_picks(slots, "_picks", size, "_n", "tour", ["search_id", "generation", "slot"], seed)
    drawn = slots.select("search_id", "generation", "slot", F.posexplode_outer("_picks").alias("_draw", "ind"))
    entered = drawn.join(unbounded(fitness), ["search_id", "generation", "ind"])
    winner = F.max_by("ind", F.struct("fitness", -F.col("_draw")))
    return entered.groupBy("search_id", "generation", "slot").agg(winner.alias("ind"))


def draw_pairs(pool: DataFrame, pairs: int, seed: int = SEED) -> DataFrame:
    """(search_id, generation, pair, parent1, parent2): winners of two different slots for every pair.

    The only slot of a one-member pool is its own partner.
    """
    size = pool.groupBy("search_id", "generation").agg(F.count(F.lit(1)).alias("_n"))
    numbered = size.withColumn("pair", _numbers(pairs))
    numbered = with_distinct_picks(numbered, "_picks", 2, "_n", "pair", ["search_id", "generation", "pair"], seed)
    drawn = numbered.select("search_id", "generation", "pair", F.posexplode_outer("_picks").alias("_side", "slot"))
    won = drawn.join(unbounded(pool), ["search_id", "generation", "slot"])
    first = F.max(F.when(F.col("_side") == 0, F.col("ind")))
    second = F.max(F.when(F.col("_side") == 1, F.col("ind")))
    return won.groupBy("search_id", "generation", "pair").agg(
        first.alias("parent1"), F.coalesce(second, first).alias("parent2")
    )


def _parents(pairs: DataFrame, population: DataFrame, extra: list[str], values: list[str]) -> DataFrame:
    """Both parents' values side by side: one join per parent, on equal keys."""
    out = pairs
    for side in (1, 2):
        named = population.select(
            "search_id",
            "generation",
            F.col("ind").alias(f"parent{side}"),
            *extra,
            *[F.col(v).alias(f"{v}_{side}") for v in values],
        )
        on = ["search_id", "generation", f"parent{side}"] + (extra if side == 2 else [])
        out = out.join(unbounded(named), on)
    return out


def _both_children(first: list[Column], second: list[Column], names: list[str]) -> Column:
    def child(number: int, values: list[Column]) -> Column:
        ind = (F.col("pair") * 2 + number).alias("child")
        return F.struct(ind, *[v.alias(n) for v, n in zip(values, names, strict=True)])

    return F.inline(F.array(child(0, first), child(1, second)))


def cross_subsets(pairs: DataFrame, population: DataFrame, rate: float = 0.8, seed: int = SEED) -> DataFrame:
    """(search_id, generation, child, gene, bit): two complementary children per pair, or copies."""
    both = _parents(pairs, population, ["gene"], ["bit"])
    keys = (F.col("search_id"), F.col("generation"), F.col("pair"))
    mixed = uniform("cross", *keys, seed=seed) <= rate
    swap = mixed & (uniform("mask", *keys, F.col("gene"), seed=seed) <= 0.5)
    both = both.withColumn("_swap", swap)
    first = F.when(F.col("_swap"), F.col("bit_2")).otherwise(F.col("bit_1"))
    second = F.when(F.col("_swap"), F.col("bit_1")).otherwise(F.col("bit_2"))
    return both.select("search_id", "generation", "gene", _both_children([first], [second], ["bit"]))


def cross_settings(pairs: DataFrame, population: DataFrame, rate: float = 0.7, seed: int = SEED) -> DataFrame:
    """(search_id, generation, child, genes): each pair's blend and its mirror, or copies."""
    both = _parents(pairs, population, [], list(SETTING_GENES))
    keys = (F.col("search_id"), F.col("generation"), F.col("pair"))
    blend = F.when(uniform("cross", *keys, seed=seed) <= rate, uniform("blend", *keys, seed=seed)).otherwise(1.0)
    both = both.withColumn("_a", blend)
    a, b = F.col("_a"), F.lit(1.0) - F.col("_a")
    first = [a * F.col(f"{g}_1") + b * F.col(f"{g}_2") for g in SETTING_GENES]
    second = [a * F.col(f"{g}_2") + b * F.col(f"{g}_1") for g in SETTING_GENES]
    return both.select("search_id", "generation", _both_children(first, second, list(SETTING_GENES)))


def flip_bits(children: DataFrame, generations: int, rate: float = 0.05, seed: int = SEED) -> DataFrame:
    """Flip each bit with the decaying rate."""
    keys = (F.col("search_id"), F.col("generation"), F.col("child"), F.col("gene"))
    flip = uniform("flip", *keys, seed=seed) < scores.decayed(rate, F.col("generation"), generations)
    return children.withColumn("bit", F.when(flip, 1 - F.col("bit")).otherwise(F.col("bit")))


def shake_settings(
    children: DataFrame, generations: int, rate: float = 0.1, strength: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add clipped Gaussian noise of decaying size to each gene with the given rate."""
    size = scores.decayed(strength, F.col("generation"), generations)
    moved = {}
    for gene in SETTING_GENES:
        keys = (F.col("search_id"), F.col("generation"), F.col("child"), F.lit(gene))
        noisy = scores.clip01(F.col(gene) + size * normal("noise", *keys, seed=seed))
        hit = uniform("shake", *keys, seed=seed) < rate
        moved[gene] = F.when(hit, noisy).otherwise(F.col(gene))
    return children.withColumns(moved)


def next_generation(
    top: DataFrame, children: DataFrame, population: DataFrame, size: int, values: list[str]
) -> DataFrame:
    """Elites first, then children, cut to ``size`` members of the next generation.

    ``values`` are the columns of a candidate: gene and bit, or the three settings.
    """
    places = top.select("search_id", "generation", "place", "ind")
    kept = population.join(unbounded(places), ["search_id", "generation", "ind"])
    kept = kept.select("search_id", "generation", F.col("place").alias("ind"), *values)
    offset = top.groupBy("search_id", "generation").agg(F.count(F.lit(1)).alias("_k"))
    born = children.join(unbounded(offset), ["search_id", "generation"]).select(
        "search_id", "generation", (F.col("child") + F.col("_k")).alias("ind"), *values
    )
    members = kept.unionByName(born).filter(F.col("ind") < size)
    return members.withColumn("generation", F.col("generation") + 1)
