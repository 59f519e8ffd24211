"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Signature trees in three steps.

1. Trees. All shingles have one order, common ones last. Two sets that link share a shingle within the first
   quarter of each. So each such shingle is the root of a tree over the sets that have it there, and every
   linked pair meets in some tree. A shingle that only one set has there is no tree. Trees over the same sets
   are one tree, that of their rarest shingle. From the first shingle two sets share on, they have no more in
   common than either has left, its ``reach``: so a pair is looked for in trees both are left enough in, and a
   set without such a partner is not in the tree.
2. Stars. The members of a tree are dealt out at random, some to each star. Each set is compared with the one head of
   its stars that stands for most of its trees, in large trees with several by further draws. That joins a group of near copies
   without all its pairs, also one in which a member links with a small share of the others.
3. Dual traversal. A tree whose members are all joined is done. In the others the sets of one size band and
   hash range form a leaf and the leaves of a band form higher nodes; only neighbouring bands can meet. A node holds the OR of its sets' bitmaps, the range of
   their sizes and of their components. From the roots down, pairs of nodes are dropped when the most they can
   share is below what their sizes need, or when both hold one and the same component. Pairs of sets that
   remain are compared shingle by shingle, first a few for every two components, then the rest.

Before shingles are compared, sets are told apart by their parities: one bit for each of about as many cells as
the set has shingles, set where an odd number of shingles fall. Each cell in which two sets differ holds a
shingle that only one of them has, so the number of such cells bounds what they share from above, for
long texts too, whose bitmaps are full. Only pairs near the limit or beyond it go to the comparison.

Equal sets are one set from the start. Only components are asked for, so pairs inside a component need no
comparison; every link between two components is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimsieve.llm.common import FACTORS, WordHashes, mixed, text_or_empty
from claimsieve.operators.layout import BROADCAST_ROWS, reliable

WIDTH = 5
PERCENT = 75
CELLS = 1 << 20  # of the table of common shingles
LOCAL = 3  # sets of one task that have a shingle before it counts as common
WORDS = 16  # longs of a bitmap: 1,024 bits
FAN_OUT = 16
BAND = 1.34  # ratio of the sizes in a band; linked sizes differ by 100 / PERCENT at most, so by one band
LEAF = 64
STAR_ROUNDS = 3
STARS = (1, 64), (4, 16), (8, 16)  # of each round: draws, and sets of a star; after the first round only trees that make several


def shingles(text: str, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes.

    bytes.lower() lowers A-Z only and bytes.split() splits at [\\x20\\x09-\\x0D] only. A text with fewer words
    than a shingle is one shingle, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(n))
    total = n[: len(n) - size + 1] * FACTORS[0]
    for k in range(1, size):
        total += n[k : len(n) - size + 1 + k] * FACTORS[k]
    total += np.uint64(size)
    return np.unique(mixed(total))


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """How common shingles are, in ``CELLS`` cells, as powers of two.

    Each task counts the shingles of its different sets and passes on those that ``LOCAL`` sets or more have,
    added up by cell: at most ``CELLS`` rows a task and ``CELLS`` bytes in the end, whatever the input. The
    counts only order the shingles: any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, cells = WordHashes(), set(), [], np.zeros(CELLS, dtype=np.int64)

        def add_up() -> None:
            if held:
                tokens, times = np.unique(np.concatenate(held), return_counts=True)
                often = times >= LOCAL
                np.add.at(cells, (tokens[often] & np.uint64(CELLS - 1)).astype(np.int64), times[often])
                held.clear()

        n = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), hashes)
                key = set_key(tokens)
                if key in seen:
                    continue
                seen.add(key)
                held.append(tokens)
                n += len(tokens)
                if n > 4_000_000:
                    add_up()
                    seen.clear()
                    n = 0
        add_up()
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": used, "n": cells[used]})

    table = docs.select(text_or_empty(docs)).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = table.select("cell", F.floor(F.log2("n")).cast("int").alias("n")).toPandas()
    out = np.zeros(CELLS, dtype=np.uint8)
    out[table.cell.to_numpy(dtype=np.int64)] = table.n.to_numpy(dtype=np.uint8)
    return out


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of a set of which any linked set has one in its own prefix: the rarest n - ceil(0.75 n) + 1."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    rank = common[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
    return tokens[np.lexsort((tokens, rank))[:size]]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(WORDS * 64, dtype=np.uint8)
    bits[(tokens >> np.uint64(32)).astype(np.int64) % (WORDS * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each cell of the hash range, set where an odd number of the set's shingles fall: 2^k cells, one for
    every shingle at least. Folding its halves together gives the parity over half as many cells."""
    cells = 1 << max(10, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_cells(x: np.ndarray, y: np.ndarray) -> int:
    """In how many cells two parities (as bytes) differ, over the cells of the smaller one."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(p.reshape(-1, size), axis=0) for p in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def sets_of(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, s, pop, bits, roots, parity): one row per document.

    ``s`` names the set, ``roots`` is its prefix, ``bits`` its bitmap with ``pop`` bits set. All are null for an
    empty set. Of equal sets a task gives roots, bits and parity once, on a row with a doc_id; other rows link nothing.
    """
    kind = "doc_id bigint, text_hash bigint, n bigint, s bigint, pop bigint, bits array<bigint>, roots array<bigint>, parity binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(2), strict=True):
                tokens = shingles(text.as_py(), hashes)
                if not len(tokens):
                    rows.append((0, None, None, None, None, None))
                    continue
                key = set_key(tokens)
                if key in seen or not doc.is_valid:
                    rows.append((len(tokens), key, None, None, None, None))
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                bits = bitmap(tokens)
                pop = int(np.bitwise_count(bits.view(np.uint64)).sum())
                rows.append((len(tokens), key, pop, bits, prefix(tokens, common).view(np.int64), parity(tokens)))
            n, keys, pops, bits, roots, parities = zip(*rows, strict=True) if rows else ([],) * 6
            numbers = [pa.array(c, pa.int64()) for c in (n, keys, pops)]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (bits, roots)]
            names = ["doc_id", "text_hash", "n", "s", "pop", "bits", "roots", "parity"]
            odd = pa.array(parities, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *lists, odd], names=names)

    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(describe, kind)


def linked(n_a: np.ndarray, n_b: np.ndarray, shared: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * shared >= percent * (n_a + n_b - shared)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of sets that link, compared shingle by shingle on the texts of one document each."""
    text = docs.select(F.col("doc_id").cast("long").alias("d"), text_or_empty(docs).alias("text")).filter("d is not null")
    one = sets.select("s", F.col("rep").alias("d"))
    ends = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = reliable(ends.join(one, "s"))
    if wanted.count() <= BROADCAST_ROWS:  # two numbers a row; beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = wanted.join(text, "d").select("s", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, data = [], []
            for s, t in zip(batch.column(0), batch.column(1), strict=True):
                tokens = shingles(t.as_py(), hashes)
                if set_key(tokens) == s.as_py():  # another row with the same doc_id has another text
                    keys.append(s.as_py())
                    data.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["s", "tokens"])

    packed = texts.mapInArrow(pack, "s bigint, tokens binary").groupBy("s").agg(F.first("tokens").alias("tokens"))
    packed = reliable(packed)
    both = pairs.join(packed.withColumnsRenamed({"s": "a", "tokens": "t_a"}), "a")
    both = both.join(packed.withColumnsRenamed({"s": "b", "tokens": "t_b"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("t_a"), batch.column("t_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                keep.append(bool(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "t_a", "t_b").mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(s, c): the smallest set name reachable from each set that has a link, by alternating large and small stars.

    Every round writes its edges to the shared folder. The number of rounds grows with the logarithm of the
    longest path; a run that does not settle fails instead of giving half a result. Edges are distinct, so two
    rounds with the same count and the same two 64-bit sums of hashes have the same edges.
    """

    def sign(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(F.lit(k), "a", "b")) for k in range(2)]).first())

    edges = reliable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("s"), F.col("b").alias("c"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = reliable(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        fresh = reliable(small.filter("a <> b").distinct())
        edges, after = fresh, sign(fresh)
        if after == before:
            break
        before = after
    else:
        raise ValueError("components did not settle")
    return edges.select(F.col("a").alias("s"), F.col("b").alias("c"))


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``c``; a set without a link is its own component."""
    named = labels.withColumnsRenamed({"s": "l_s", "c": "l_c"})
    return rows.join(named, rows.s == named.l_s, "left").withColumn("c", F.coalesce("l_c", "s")).drop("l_s", "l_c")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels as :func:`components` gives them, after further links (a, b): only the components that these join are
    gone through, so later rounds are as large as what they find."""
    ends = with_component(links.select(F.col("a").alias("s"), "b"), labels).select(F.col("c").alias("c_a"), F.col("b").alias("s"))
    ends = with_component(ends, labels).select(F.col("c_a").alias("a"), F.col("c").alias("b"))
    joined = components(ends)
    moved = with_component(labels.select(F.col("c").alias("s"), F.col("s").alias("member")), joined)
    return reliable(moved.select(F.col("member").alias("s"), "c").unionByName(joined))


def shared_bits(a: str, b: str) -> Column:
    """Bits that two bitmaps share, written out word by word so that it is compiled."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range(1, WORDS)),
               F.bit_count(F.get(a, F.lit(0)).bitwiseAND(F.get(b, F.lit(0)))))


def needed(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """Shared shingles that sets of these sizes need: percent / (100 + percent) of the sum."""
    return F.ceil(percent * (n_a + n_b) / (100 + percent))


def possible(left: str, right: str) -> Column:
    """Whether some set of one node may link with some set of another, by sizes, bitmaps and components."""
    a, b = (lambda n, p=left: F.col(f"{p}.{n}")), (lambda n, p=right: F.col(f"{p}.{n}"))
    shared = shared_bits(f"{left}.bits", f"{right}.bits")
    need = needed(a("low"), b("low"))
    sizes = (100 * a("high") >= PERCENT * b("low")) & (100 * b("high") >= PERCENT * a("low"))
    sizes = sizes & (F.least(a("reach"), b("reach")) >= need)
    same = (a("c_low") == a("c_high")) & (b("c_low") == b("c_high")) & (a("c_low") == b("c_low"))
    return sizes & ~same & (F.least(a("high") - a("pop"), b("high") - b("pop")) + shared >= need)


def worth_comparing(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave a link possible. Parities hold one bit or two a shingle, so
    they are a thirtieth of the sets."""
    ends = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    signs = described.filter("parity is not null").select("s", "n", "parity").join(ends, "s", "left_semi").groupBy("s")
    signs = reliable(signs.agg(F.first("n").alias("n"), F.first("parity").alias("parity")))
    near = pairs.join(signs.select(F.col("s").alias("a"), F.col("n").alias("n_a")), "a")
    near = near.join(signs.select(F.col("s").alias("b"), F.col("n").alias("n_b")), "b")
    near = near.filter(F.least("n_a", "n_b") >= needed(F.col("n_a"), F.col("n_b")))
    both = near.join(signs.select(F.col("s").alias("a"), F.col("parity").alias("p_a")), "a")
    both = both.join(signs.select(F.col("s").alias("b"), F.col("parity").alias("p_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            cells = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column("p_a"), batch.column("p_b"), strict=True)):
                cells[i] = differing_cells(*(np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y)))
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield rows.filter(pa.array(linked(n_a, n_b, (n_a + n_b - cells) // 2), pa.bool_()))

    return reliable(both.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(compare, "a bigint, b bigint"))


def star_pairs(trees: DataFrame, labels: DataFrame, number: int) -> DataFrame:
    """(a, b): each set and, for every draw of the round, the head in another component that stands for most of its trees.

    The stars of a tree are the ranges of a hash, so trees of like size with the same sets have the same stars and
    heads; a star has a bounded number of sets, however large its tree. Of the pairs between two components those
    that meet in most trees are compared, two or as many as there are draws.
    """
    draws, members = STARS[number]
    rows = with_component(trees.filter(F.col("size") > members) if number else trees, labels)
    rows = rows.withColumn("draw", F.explode(F.array(*[F.lit(100 * number + k) for k in range(draws)])))
    doublings = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("size") / members))).cast("int")
    order = F.xxhash64("draw", "s")
    star = Window.partitionBy("token", "draw", order.bitwiseAND(F.expr("shiftleft(1L, doublings)") - 1))
    rows = rows.withColumn("doublings", doublings).withColumn("head", F.min(F.struct(F.xxhash64("draw", "s", F.lit(1)).alias("nth"), "s", "c")).over(star))
    met = rows.filter(F.col("c") != F.col("head.c")).groupBy("s", "c", "draw", "head").agg(F.sum("weight").alias("met"))
    best = met.groupBy("s", "c", "draw").agg(F.max_by("head", F.struct("met", "head")).alias("head"), F.max("met").alias("met"))
    best = best.groupBy("s", "c", "head.s", "head.c").agg(F.max("met").alias("met")).toDF("s", "c", "head", "head_c", "met")
    sides = Window.partitionBy(F.least("c", "head_c"), F.greatest("c", "head_c")).orderBy(F.desc("met"), "s", "head")
    best = best.withColumn("nth", F.row_number().over(sides)).filter(F.col("nth") <= max(2, draws))
    return reliable(best.select(F.col("head").alias("a"), F.col("s").alias("b")))


def next_pairs(pairs: DataFrame, labels: DataFrame, at_once: int | None) -> tuple[DataFrame, DataFrame]:
    """The pairs that are left, and those to compare now: some for every two components, all if ``at_once`` is None.

    A link found joins two components and makes their other pairs needless."""
    rows = with_component(pairs.select(F.col("a").alias("s"), "b"), labels).withColumnsRenamed({"s": "a", "c": "c_a"})
    rows = with_component(rows.withColumnRenamed("b", "s"), labels).withColumnsRenamed({"s": "b", "c": "c_b"})
    sides = Window.partitionBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).orderBy(F.xxhash64("a", "b"), "a", "b")
    rows = reliable(rows.filter("c_a <> c_b").withColumn("nth", F.row_number().over(sides)).select("a", "b", "nth"))
    if at_once is None:
        return rows.select("a", "b").limit(0), rows.select("a", "b")
    return rows.filter(F.col("nth") > at_once).select("a", "b"), rows.filter(F.col("nth") <= at_once).select("a", "b")


def nodes_above(nodes: DataFrame, keys: list[str]) -> DataFrame:
    bits = F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(WORDS)])
    return nodes.groupBy(*keys).agg(
        bits.alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach"),
        F.min("slack_pop").alias("slack_pop"), F.min("c_low").alias("c_low"), F.max("c_high").alias("c_high"),
    )


def bridges(trees: DataFrame, labels: DataFrame, described: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of different components that the traversal of the trees can't rule out."""
    rows = with_component(trees, labels)
    open_ = rows.groupBy("token", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("token")  # as many rows as a tree has size bands
    open_ = open_.withColumns({"lo": F.min("lo").over(tree), "hi": F.max("hi").over(tree)})
    open_ = reliable(open_.filter("lo <> hi").select("token", "band", "n"))
    if not open_.take(1):
        return trees.select(F.col("s").alias("a"), F.col("s").alias("b")).limit(0)
    largest = open_.agg(F.max("n")).first()[0]
    levels = 0
    while LEAF * FAN_OUT**levels < largest:
        levels += 1
    named = open_.withColumnsRenamed({"token": "o_token", "band": "o_band", "n": "o_n"})
    rows = rows.join(named, (F.col("token") == F.col("o_token")) & (F.col("band") == F.col("o_band")))
    needed_sets = rows.select("s").distinct()
    signs = described.filter("bits is not null").select("s", "n", "bits", "pop").join(needed_sets, "s", "left_semi")
    signs = reliable(signs.groupBy("s").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("pop").alias("pop")))
    rows = rows.select("token", "s", "c", "band", "reach", "o_n").join(signs, "s")
    leaves = F.greatest(F.lit(1), F.ceil(F.col("o_n") / LEAF))
    spread = F.pmod(F.xxhash64("s"), leaves)
    leaf = F.col("band") * FAN_OUT**levels + spread
    rows = rows.withColumn("leaf", leaf)
    rows = rows.withColumns({"low": F.col("n"), "high": F.col("n"), "slack_pop": F.col("pop"), "c_low": F.col("c"), "c_high": F.col("c")})
    members = reliable(rows.select("token", "leaf", "s", "n", "bits", "pop", "c", "low", "high", "reach", "slack_pop", "c_low", "c_high"))

    def level_nodes(level: int) -> DataFrame:
        return nodes_above(members.withColumn("node", F.floor(F.col("leaf") / FAN_OUT**level)), ["token", "node"])

    def packed(nodes: DataFrame, name: str) -> DataFrame:
        fields = [F.col(c).alias("pop" if c == "slack_pop" else c) for c in ("node", "bits", "low", "high", "reach", "slack_pop", "c_low", "c_high")]
        return nodes.select(F.col("token").alias(f"{name}_token"), F.col("node").alias(f"{name}_node"), F.struct(*fields).alias(name))

    pairs = None
    for level in range(levels, -1, -1):
        nodes = level_nodes(level)
        left, right = packed(nodes, "x"), packed(nodes, "y")
        if pairs is None:  # the top: one node for each size band of a tree
            both = left.join(right, (F.col("x_token") == F.col("y_token")) & F.col("y_node").between(F.col("x_node"), F.col("x_node") + 1))
        else:  # the children of pairs that passed
            up_x, up_y = F.floor(F.col("x_node") / FAN_OUT), F.floor(F.col("y_node") / FAN_OUT)
            both = pairs.join(left.withColumn("ux", up_x), (F.col("p_token") == F.col("x_token")) & (F.col("p_x") == F.col("ux")))
            both = both.join(right.withColumn("uy", up_y), (F.col("p_token") == F.col("y_token")) & (F.col("p_y") == F.col("uy")))
            both = both.filter(F.col("x_node") <= F.col("y_node"))
        pairs = both.filter(possible("x", "y")).select(F.col("x_token").alias("p_token"), F.col("x_node").alias("p_x"), F.col("y_node").alias("p_y"))
        pairs = reliable(pairs)
    x = members.select(F.col("token").alias("x_token"), F.col("leaf").alias("x_leaf"), F.struct("s", "bits", "low", "high", "reach", "pop", "c_low", "c_high").alias("x"))
    y = members.select(F.col("token").alias("y_token"), F.col("leaf").alias("y_leaf"), F.struct("s", "bits", "low", "high", "reach", "pop", "c_low", "c_high").alias("y"))
    both = pairs.join(x, (F.col("p_token") == F.col("x_token")) & (F.col("p_x") == F.col("x_leaf")))
    both = both.join(y, (F.col("p_token") == F.col("y_token")) & (F.col("p_y") == F.col("y_leaf")))
    once = (F.col("p_x") < F.col("p_y")) | (F.col("x.s") < F.col("y.s"))  # a leaf meets itself both ways round
    both = both.filter(once & (F.col("x.c_low") != F.col("y.c_low"))).filter(possible("x", "y"))
    return both.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def trees_of(known: DataFrame) -> DataFrame:
    """(token, s, band, reach, weight, size): the trees, one row per set (s, n, roots) of each.

    Trees over the same sets are told by two 64-bit hashes of every set, added up; ``weight`` is how many trees became
    one, ``size`` how many rows it had. The shingles they have in common stand in the same order in all their sets, so
    the tree of the first one has the largest ``reach`` everywhere, and no pair that meets in another is lost. The
    postings go over the network once: both the sums and the join below read the same columns of the same exchange.
    """
    postings = known.select("s", F.posexplode_outer("roots").alias("place", "token")).filter("token is not null").repartition("token")
    hashes = [F.xxhash64(F.lit(k), "s") for k in range(2)]
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]  # sums stay longs
    names = ["size", "lo", "hi", *(f"sum_{i}" for i in range(len(halves)))]
    sums = [F.sum(half).alias(name) for half, name in zip(halves, names[3:], strict=True)]
    roots = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("place").alias("places"), *sums
    )
    roots = roots.filter("lo <> hi").groupBy(*names).agg(F.min_by("token", "places").alias("r_token"), F.count(F.lit(1)).alias("weight"))
    kept = postings.join(roots.select("r_token", "weight", "size"), F.col("token") == F.col("r_token"))
    kept = reliable(kept.select("token", "s", "place", "weight", "size").distinct())
    sizes = known.groupBy(F.col("s").alias("n_s")).agg(F.first("n").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("long")
    rows = kept.join(sizes, F.col("s") == F.col("n_s")).select("token", "s", "n", band.alias("band"), (F.col("n") - F.col("place")).alias("reach"), "weight", "size")
    return with_partner(reliable(rows)).drop("n")


def with_partner(rows: DataFrame) -> DataFrame:
    """The rows of trees without those whose set can't link with any other one of its tree, by size and reach.

    A row is held against each size band that its partners may be in: their sizes and the largest reach of them."""
    bands = rows.groupBy("token", "band").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("far"), F.min("s").alias("lo"), F.max("s").alias("hi")
    ).withColumnsRenamed({"token": "t_token", "band": "t_band"})
    near = (F.col("token") == F.col("t_token")) & F.col("t_band").between(F.col("band") - 1, F.col("band") + 1)
    alone = (F.col("t_band") == F.col("band")) & (F.col("lo") == F.col("hi"))
    sizes = (100 * F.col("high") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("low"))
    smallest = F.greatest("low", F.ceil(PERCENT * F.col("n") / 100))
    enough = F.least("reach", "far") >= needed(F.col("n"), smallest)
    return rows.join(bands, near & ~alone & sizes & enough, "left_semi")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, s) per row of ``docs``, see :func:`near_copies_of_texts`."""
    return near_copies_of_texts(docs).drop("text_hash")


def near_copies_of_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, s) per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. component_id is the smallest doc_id that
    links reach, the row itself included. A null text counts as empty; a text without words links with nothing
    and is its own component. A row without doc_id keeps a null component and links nothing. Rows that repeat
    share their component. Other columns are not touched.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    described = reliable(sets_of(docs, common_shingles(named)))
    rows = described.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "s")
    known = described.filter("doc_id is not null and s is not null")
    sets = reliable(known.groupBy("s").agg(F.min("doc_id").alias("rep")))
    trees = reliable(trees_of(known))
    labels = components(trees.select(F.col("s").alias("a"), F.col("s").alias("b")).limit(0))
    for number in range(STAR_ROUNDS):
        stars = worth_comparing(star_pairs(trees, labels, number), known)
        found = reliable(verified(stars, named, sets))
        if not found.take(1):
            break
        labels = merged(labels, found)
    crossing = worth_comparing(reliable(bridges(trees, labels, known)), known)
    for at_once in (2, 64, None):
        crossing, chosen = next_pairs(crossing, labels, at_once)
        if not chosen.take(1):
            break
        labels = merged(labels, verified(chosen, named, sets))
    label_of = with_component(sets, labels)
    smallest = label_of.groupBy("c").agg(F.min("rep").alias("component")).withColumnRenamed("c", "m_c")
    label_of = label_of.join(smallest, F.col("c") == F.col("m_c")).select(F.col("s").alias("k_s"), "component")
    out = rows.join(label_of, F.col("s") == F.col("k_s"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "s")


def one_per_component(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with its columns; rows without doc_id stay.

    Of a doc_id with different texts only the rows go whose own text links to a smaller doc_id."""
    gone = near_copies_of_texts(docs).filter("component_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    same = (docs.doc_id == gone.g_id) & (F.xxhash64(text_or_empty(docs)) == gone.g_hash)
    return docs.join(gone, same, "left_anti").select(*docs.columns)
