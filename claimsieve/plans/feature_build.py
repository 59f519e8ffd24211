"""Fit all feature blocks on one table and apply them to another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions import text as words
from claimsieve.operators import dictionary, features, metadata, terms, vectors
from claimsieve.operators.layout import BROADCAST_ROWS, reliable, reliable_all, spread

# Names of the readability features.
READABILITY = ("avg_sentence_length", "avg_word_length", "unique_word_ratio")


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns feed which block, and the limits of each block."""

    key: str = "doc_id"
    text: str = "text"
    categorical: Sequence[str] = ()
    numeric: Sequence[str] = ()
    embedding: str | None = None
    readability: str = "cleaned"  # "cleaned", "raw" or "none"
    stopwords: Sequence[str] = words.STOPWORDS
    stem: bool = True
    min_token_length: int = 3
    longest_gram: int = 3
    min_df: int = 2
    max_df: float = 0.95
    max_terms: int = 5000
    max_categories: int = 50

    def other_columns(self) -> list[str]:
        """The columns, besides the tokens, that features are made from."""
        text = [self.text] if self.readability == "raw" else []
        return [*text, *([self.embedding] if self.embedding else []), *self.categorical, *self.numeric]

    @property
    def max_features(self) -> int:
        """Bound of the fitted tables, apart from the width of the embedding."""
        return self.max_terms + self.max_categories * len(self.categorical) + len(self.numeric) + 3


def token_table(
    df: DataFrame, spec: FeatureSpec, lemmas: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep, tokens) of every row, through cleaning, stop words, stems, lemmas and the length limit."""
    keep = [c for c in dict.fromkeys(keep) if c != spec.key]
    rows = spread(df.select(spec.key, *keep, *([] if spec.text in keep else [spec.text])), spec.key)
    shortest = 1 if spec.stem or lemmas is not None else spec.min_token_length
    tokens = words.tokens(F.col(spec.text), spec.stopwords, shortest).alias("tokens")
    out = rows.select(spec.key, *keep, tokens)
    if spec.stem:
        out = dictionary.stem_tokens(out, "tokens", spec.min_token_length if lemmas is None else 1)
    if lemmas is not None:
        out = dictionary.lemma_lookup(out, lemmas, "tokens", spec.min_token_length)
    return out


@dataclass(frozen=True)
class FeatureModel:
    """Fitted state, as tables: vocabulary, categories, known categories, column and vector statistics."""

    spec: FeatureSpec
    tables: dict[str, DataFrame]
    lemmas: DataFrame | None = None

    def index(self) -> DataFrame:
        """(position, block, feature) of every fitted feature."""
        parts = [
            self.tables["vocabulary"].select(
                F.lit("tfidf").alias("block"), F.col("term").alias("feature"), F.col("pos").cast("bigint").alias("place")
            )
        ]
        if "vector_stats" in self.tables:
            pos = F.col("pos")
            parts.append(
                self.tables["vector_stats"].select(
                    F.lit("embedding").alias("block"), pos.cast("string").alias("feature"), pos.cast("bigint").alias("place")
                )
            )
        for block, table, columns, within in (
            ("categorical", "categories", self.spec.categorical, F.col("pos")),
            ("numeric", "numeric_stats", self.spec.numeric, F.lit(0)),
        ):
            if table in self.tables:
                rank = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
                name = F.col("out_name") if block == "categorical" else F.col("column")
                place = (rank * 1_000_000 + within).cast("bigint").alias("place")
                parts.append(self.tables[table].select(F.lit(block).alias("block"), name.alias("feature"), place))
        names = parts[0]
        for part in parts[1:]:
            names = names.unionByName(part)
        if self.spec.readability != "none":
            cells = [
                F.struct(F.lit("readability").alias("block"), F.lit(n).alias("feature"), F.lit(i).cast("bigint").alias("place"))
                for i, n in enumerate(READABILITY)
            ]
            spark = names.sparkSession
            names = names.unionByName(spark.range(1).select(F.inline(F.array(*cells))))
        return features.number_features(names)

    def blocks(self, df: DataFrame, tokens: DataFrame, fitted_rows: bool = False) -> dict[str, DataFrame]:
        """The long rows of each block but tfidf, for a table with the fitted columns."""
        spec, out = self.spec, {}
        if "vector_stats" in self.tables:
            given = df.select(spec.key, spec.embedding).filter(F.col(spec.embedding).isNotNull())
            scaled = vectors.standardize(given, self.tables["vector_stats"], spec.key, spec.embedding)
            out["embedding"] = scaled.select(spec.key, F.col("pos").cast("string").alias("feature"), "value")
        if "categories" in self.tables:
            known = None if fitted_rows else self.tables["known_categories"]
            hot = metadata.onehot(
                df, self.tables["categories"], spec.categorical, spec.key, spec.max_categories, known
            )
            out["categorical"] = hot.select(spec.key, "feature", "value")
        if "numeric_stats" in self.tables:
            out["numeric"] = metadata.zscore(df, self.tables["numeric_stats"], spec.numeric, spec.key)
        if spec.readability == "raw":
            out["readability"] = readability_rows(spread(df, spec.key), spec.key, F.col(spec.text))
        elif spec.readability == "cleaned":
            out["readability"] = readability_rows(tokens, spec.key, F.array_join("tokens", " "))
        return out

    def transform(self, df: DataFrame, tokens: DataFrame | None = None, fitted_rows: bool = False) -> DataFrame:
        """(key, block, feature, value); ``fitted_rows`` says that ``df`` is the fitted table itself."""
        spec = self.spec
        tokens = token_table(df, spec, self.lemmas) if tokens is None else tokens
        scored = terms.tfidf(
            tokens, self.tables["vocabulary"], spec.key, "tokens", spec.longest_gram, spec.max_terms
        )
        blocks = {"tfidf": scored.select(spec.key, F.col("term").alias("feature"), "value")}
        blocks.update(self.blocks(df, tokens, fitted_rows))
        return features.concat_blocks(blocks, spec.key)

    def pack(self, df: DataFrame, tokens: DataFrame, index: DataFrame, fitted_rows: bool = False) -> DataFrame:
        """(key, indices, values) for every row of ``df``, in position order.

        Everything happens inside the row: each block's entries are written at its positions into one array. If ``tokens``
        carries the columns of the other blocks (see :func:`token_table`), nothing is joined or shuffled; otherwise it is
        joined to ``df`` once. Only categories beyond the dictionary need a table of their own where there are
        more than ``BROADCAST_ROWS`` of them.
        """
        spec = self.spec
        needed = spec.other_columns()
        rows = tokens if set(needed) <= set(tokens.columns) else df.select(spec.key, *needed).join(tokens.select(spec.key, "tokens"), spec.key)
        if "categories" in self.tables and not fitted_rows and self.tables["known_categories"].count() > BROADCAST_ROWS:
            return self.pack_joined(df, tokens, index, fitted_rows)
        rows = rows.select(spec.key, "tokens", self.entries(rows, index, fitted_rows).alias("_e"))
        words_, weights = terms.vocabulary_list(self.tables["vocabulary"])
        out = terms.tfidf_rows(rows, words_, weights, spec.key, "tokens", spec.longest_gram, ["_e"])
        return out.select(
            spec.key,
            F.concat("indices", F.col("_e.position")).alias("indices"),
            F.concat("values", F.col("_e.value")).alias("values"),
        )

    def entries(self, rows: DataFrame, index: DataFrame, fitted_rows: bool) -> Column:
        """The non-zero entries (position, value) of all blocks but the terms, in position order, as one expression.

        Fitted tables become constants of it: a row per category of the dictionary, column and vector element.
        """
        spec = self.spec
        place: dict[str, dict[str, int]] = {}
        for r in index.filter(F.col("block") != "tfidf").collect():
            place.setdefault(r["block"], {})[r["feature"]] = r["position"]
        cells = []
        if "vector_stats" in self.tables:
            fitted = sorted((r["pos"], r["mean"], r["std"]) for r in self.tables["vector_stats"].collect())
            at = [place["embedding"][str(p)] for p, _, _ in fitted]
            mean, std = ([r[i] for r in fitted] for i in (1, 2))

            def element(x: Column, i: Column) -> Column:
                return features.entry(F.get(F.lit(at), i), (x.cast("double") - F.get(F.lit(mean), i)) / F.get(F.lit(std), i))

            cells.append(F.coalesce(F.transform(spec.embedding, element), features.no_entries()))
        if "categories" in self.tables:
            cells.append(F.array(*[features.entry(p, F.lit(1.0)) for p in self.category_places(place["categorical"], fitted_rows)]))
        if "numeric_stats" in self.tables:
            for r in self.tables["numeric_stats"].collect():
                value = metadata.standard_score(F.col(r["column"]).cast("double"), F.lit(r["mean"]), F.lit(r["std_pop"]))
                cells.append(F.array(features.entry(F.lit(place["numeric"][r["column"]]), value)))
        if spec.readability != "none":
            text = F.col(spec.text) if spec.readability == "raw" else F.array_join("tokens", " ")
            scores = words.readability(text)
            cells.append(F.array(*[features.entry(F.lit(place["readability"][n]), scores[n]) for n in READABILITY]))
        if not cells:
            return features.no_entries()
        return F.array_sort(F.filter(F.concat(*cells), lambda e: e["position"].isNotNull() & (e["value"] != 0)))

    def category_places(self, place: dict[str, int], fitted_rows: bool) -> list[Column]:
        """Per categorical column the position of a row's category: its own, that of the infrequent ones, or null."""
        named: dict[str, dict] = {c: {} for c in self.spec.categorical}
        rare: dict[str, int] = {}
        for r in self.tables["categories"].collect():
            if r["is_infrequent"]:
                rare[r["column"]] = place[r["out_name"]]
            else:
                named[r["column"]][r["category"]] = place[r["out_name"]]
        if rare and not fitted_rows:
            for r in self.tables["known_categories"].collect():
                if r["column"] in rare:
                    named[r["column"]].setdefault(r["category"], rare[r["column"]])
        out = []
        for c in self.spec.categorical:
            given, otherwise = F.col(c).cast("string"), F.lit(rare.get(c) if fitted_rows else None).cast("int")
            known = {k: p for k, p in named[c].items() if k is not None}
            found = otherwise
            if known:
                table = F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values())))
                found = F.coalesce(F.try_element_at(table, given), otherwise)
            out.append(F.when(given.isNull(), F.lit(named[c].get(None)).cast("int") if None in named[c] else otherwise).otherwise(found))
        return out

    def pack_joined(self, df: DataFrame, tokens: DataFrame, index: DataFrame, fitted_rows: bool = False) -> DataFrame:
        """:meth:`pack` by joins, for any number of known categories.

        The terms come first in the feature order, so their arrays (made inside each row) and the few
        entries of the other blocks are put one after the other.
        """
        spec = self.spec
        limit = self.spec.max_features
        words_, weights = terms.vocabulary_list(self.tables["vocabulary"])
        first = terms.tfidf_rows(tokens, words_, weights, spec.key, "tokens", spec.longest_gram)
        parts = [first.withColumnsRenamed({"indices": "_i0", "values": "_v0"})]
        others = self.blocks(df, tokens, fitted_rows)
        if others:
            rest = features.pack_rows(features.concat_blocks(others, spec.key), index, spec.key, limit)
            parts.append(rest.withColumnsRenamed({"indices": "_i1", "values": "_v1"}))
        out = df.select(spec.key)
        for part in parts:
            out = out.join(part, spec.key, "left")
        none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
        return out.select(
            spec.key,
            F.concat(*[F.coalesce(f"_i{n}", none_i) for n in range(len(parts))]).alias("indices"),
            F.concat(*[F.coalesce(f"_v{n}", none_v) for n in range(len(parts))]).alias("values"),
        )

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, spec: FeatureSpec, lemmas: DataFrame | None = None) -> FeatureModel:
    names = ["vocabulary"]
    names += ["vector_stats"] if spec.embedding else []
    names += ["categories", "known_categories"] if spec.categorical else []
    names += ["numeric_stats"] if spec.numeric else []
    return FeatureModel(spec, {n: spark.read.parquet(f"{path}/{n}") for n in names}, lemmas)


def readability_rows(df: DataFrame, key: str, text) -> DataFrame:
    """(key, feature, value) of the three readability scores."""
    scored = df.select(key, *[c.alias(n) for n, c in words.readability(text).items()])
    cells = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in READABILITY]
    return scored.select(key, F.inline(F.array(*cells)))


def fit(
    df: DataFrame, spec: FeatureSpec, tokens: DataFrame | None = None, lemmas: DataFrame | None = None
) -> FeatureModel:
    """Fit every block on ``df``; ``tokens`` are its rows from :func:`token_table`, if at hand.

    The fitted tables are computed once and written to the shared folder.
    """
    tokens = reliable(token_table(df, spec, lemmas)) if tokens is None else tokens
    n_docs = terms.row_count(tokens)
    limits = (spec.longest_gram, spec.min_df, spec.max_df, spec.max_terms)
    tables = {"vocabulary": terms.token_vocabulary(tokens, n_docs, spec.key, "tokens", *limits)}
    if spec.embedding:
        tables["vector_stats"] = vectors.vector_stats(df, spec.embedding)
    if spec.categorical:
        seen = reliable(metadata.category_counts(df, spec.categorical, spec.key))
        tables["known_categories"] = seen.select("column", "category")
        tables["categories"] = metadata.frequent_categories(seen, spec.max_categories)
    if spec.numeric:
        tables["numeric_stats"] = metadata.numeric_stats(df, spec.numeric)
    return FeatureModel(spec, reliable_all(tables), lemmas)
