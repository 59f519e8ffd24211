"""Queries: each takes (spark, folder of parquet tables) and returns a DataFrame.

Stand-ins: documents are statements, labels.quality is the label, lang and source are categories, n_chars
is a number, embeddings are vectors. Searches: a customer is a search with six candidates, a user is a
search whose events are candidates over days, a line item is a candidate with settings of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions import scores, text
from claimsieve.functions.draws import uniform
from claimsieve.operators import candidates as cand
from claimsieve.operators import dictionary, features, metadata, metrics, ranking, svm, terms, vectors
from claimsieve.operators.layout import reliable, shared_folder, spread, unpack
from claimsieve.plans import feature_build, run, search
from claimsieve.plans.feature_build import FeatureSpec
from claimsieve.session import ship
from claimsieve.sources import statements

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

VOCABULARY = 5_000
SPEC = FeatureSpec(
    categorical=("lang", "source"),
    numeric=("n_chars",),
    embedding="embedding",
    readability="raw",
    max_terms=VOCABULARY,
    max_categories=10,
)
WORD_SPEC = FeatureSpec(stem=False)


def query(function: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return function(ship(spark), folder)

    REGISTRY[function.__name__] = prepared
    return function


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def r6(column) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, tokens) without stemming."""
    return feature_build.token_table(documents(spark, folder), WORD_SPEC)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(words(spark, folder))


def n_documents(spark: SparkSession, folder: str) -> Column:
    return terms.row_count(documents(spark, folder))


def with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vector = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return documents(spark, folder).join(vector, "doc_id", "left")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    label = read(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return with_vectors(spark, folder).join(label, "doc_id")


# ---- sources --------------------------------------------------------------------------------------


@query
def scan_tsv(spark, folder):
    path = shared_folder(spark, "tsv")
    rows = documents(spark, folder).select("doc_id", "text", "lang", "source", "n_chars")
    writer = rows.write.option("sep", "\t").option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return statements.read_tsv(spark, path, rows.schema)


@query
def na_normalize(spark, folder):
    choices = F.array(*[F.lit(t) for t in text.MISSING_TOKENS], F.lit("none"), F.col("source"))
    raw = F.get(choices, (F.col("doc_id") % F.size(choices)).cast("int"))
    df = documents(spark, folder).select("doc_id", raw.alias("raw"))
    return df.withColumn("value", text.normalize_missing(F.col("raw")))


@query
def filter_nonnull(spark, folder):
    df = documents(spark, folder).withColumn("statement", F.when(F.col("n_chars") % 5 > 0, F.col("text")))
    return df.filter(F.col("statement").isNotNull()).select("doc_id", "statement")


@query
def binarize_label(spark, folder):
    label = text.binarize_label(F.col("event_type"), ("purchase", "signup"))
    return read(spark, folder, "events").select("event_id", label.alias("label"))


@query
def align_labels(spark, folder):
    labels = read(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, folder).select("doc_id", "source").join(labels, "doc_id")


# ---- text -----------------------------------------------------------------------------------------


@query
def remove_urls(spark, folder):
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return df.select("doc_id", text.remove_urls(F.lower("text")).alias("text"))


@query
def remove_mentions(spark, folder):
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return df.select("doc_id", text.remove_mentions(F.lower("text")).alias("text"))


@query
def remove_punct_digits(spark, folder):
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return df.select("doc_id", text.remove_punct_digits(F.col("text")).alias("text"))


@query
def text_clean(spark, folder):
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return df.select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query
def stopword_union(spark, folder):
    """Number of documents that hold each word of the united stop-word list."""
    rows = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    found = F.filter(F.array_distinct(text.raw_tokens(F.col("text"))), lambda t: t.isin(*text.STOPWORDS))
    held = unpack(rows, [], found, "word")
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def stopword_anti(spark, folder):
    rows = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    kept = text.drop_stopwords(text.raw_tokens(F.col("text")))
    return rows.select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query
def tokens(spark, folder):
    df = words(spark, folder)
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query
def stem_tokens(spark, folder):
    df = feature_build.token_table(documents(spark, folder), FeatureSpec(stem=True))
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def lemma_lookup(spark, folder):
    """The lexicon maps the longer words of the benchmark passages to their first four letters."""
    passages = read(spark, folder, "benchmark").select(text.tokens(F.col("text")).alias("tokens"))
    lexicon = dictionary.distinct_tokens(passages).filter(F.length("token") > 4)
    lexicon = lexicon.withColumn("lemma", F.left("token", F.lit(4)))
    df = dictionary.lemma_lookup(words(spark, folder), lexicon)
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def readability(spark, folder):
    """Scores of the raw text, and of the cleaned text as in a run that cleans first."""
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    df = df.select("doc_id", "text", F.array_join(text.tokens(F.col("text")), " ").alias("clean"))
    raw = {n: r6(c) for n, c in text.readability(F.col("text")).items()}
    clean = {f"clean_{n}": r6(c) for n, c in text.readability(F.col("clean")).items()}
    return df.withColumns({**raw, **clean}).drop("text", "clean")


# ---- terms ----------------------------------------------------------------------------------------


@query
def ngrams(spark, folder):
    return terms.ngrams(words(spark, folder))


@query
def term_freq(spark, folder):
    return counts(spark, folder)


@query
def doc_freq_prune(spark, folder):
    return terms.token_frequency(reliable(words(spark, folder)), n_documents(spark, folder))


@query
def idf(spark, folder):
    n = n_documents(spark, folder)
    kept = terms.token_frequency(reliable(words(spark, folder)), n)
    return kept.select("term", "df", r6(terms.idf(F.col("df"), n)).alias("idf"))


@query
def vocab_topk(spark, folder):
    vocab = terms.token_vocabulary(reliable(words(spark, folder)), n_documents(spark, folder))
    return vocab.select("term", F.col("pos").cast("bigint").alias("pos"), "df", "total")


@query
def tfidf(spark, folder):
    """The whole term table of the documents, weighted and scaled to unit rows."""
    rows = reliable(words(spark, folder))
    vocab = terms.token_vocabulary(rows, n_documents(spark, folder))
    return rounded(terms.tfidf(rows, vocab), "value")


# ---- metadata and vectors ---------------------------------------------------------------------------


@query
def category_cap(spark, folder):
    seen = reliable(metadata.category_counts(documents(spark, folder), SPEC.categorical, "doc_id"))
    top = metadata.frequent_categories(seen, SPEC.max_categories)
    return top.withColumn("pos", F.col("pos").cast("bigint"))


@query
def onehot(spark, folder):
    df = documents(spark, folder)
    seen = reliable(metadata.category_counts(df, SPEC.categorical, "doc_id"))
    top = metadata.frequent_categories(seen, SPEC.max_categories)
    return metadata.onehot(df, top, SPEC.categorical, "doc_id", SPEC.max_categories)


@query
def onehot_unknown(spark, folder):
    """Categories fitted on the documents labelled toxic, applied to all documents."""
    toxic = read(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    df = documents(spark, folder)
    fitted = df.join(toxic, "doc_id", "left_semi")
    seen = reliable(metadata.category_counts(fitted, SPEC.categorical, "doc_id"))
    top = metadata.frequent_categories(seen, SPEC.max_categories)
    known = seen.select("column", "category")
    return metadata.onehot(df, top, SPEC.categorical, "doc_id", SPEC.max_categories, known)


@query
def numeric_stats(spark, folder):
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(metadata.numeric_stats(read(spark, folder, "lineitem"), columns), "mean", "std_pop")


@query
def zscore(spark, folder):
    df, columns = read(spark, folder, "part"), ("p_size", "p_retailprice")
    return rounded(metadata.zscore(df, metadata.numeric_stats(df, columns), columns, "p_partkey"), "value")


@query
def mean_pool(spark, folder):
    return rounded(vectors.mean_pool(read(spark, folder, "embeddings"), "label", "embedding"), "value")


@query
def embedding_standardize(spark, folder):
    df = read(spark, folder, "embeddings")
    return rounded(vectors.standardize(df, vectors.vector_stats(df, "embedding"), "vec_id", "embedding"), "value")


def hashing_model():
    """A stand-in text model: 32 buckets of word hashes, each text of unit length."""
    import zlib

    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 32), np.float32)
        for row, value in enumerate(texts):
            for word in str(value or "").split():
                out[row, zlib.crc32(word.encode()) % 32] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return predict


@query
def embed_batch(spark, folder):
    df = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    out = vectors.embed_batch(df, "text", hashing_model)
    return out.select("doc_id", F.posexplode("embedding").alias("pos", "value"))


# ---- features -----------------------------------------------------------------------------------------


@query
def hybrid_features(spark, folder):
    df = with_vectors(spark, folder)
    tokens = reliable(feature_build.token_table(df, SPEC))
    model = feature_build.fit(df, SPEC, tokens)
    return rounded(model.transform(df, tokens, fitted_rows=True), "value")


def plain_features(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(long features, index) without stems and with a small vocabulary."""
    df = with_vectors(spark, folder)
    spec = FeatureSpec(**{**SPEC.__dict__, "stem": False})
    tokens = reliable(feature_build.token_table(df, spec))
    model = feature_build.fit(df, spec, tokens)
    return model.transform(df, tokens, fitted_rows=True), model.index()


@query
def feature_concat(spark, folder):
    long, index = plain_features(spark, folder)
    placed = long.join(F.broadcast(index), ["block", "feature"])
    return placed.select("doc_id", F.col("position").cast("bigint").alias("position"), r6("value").alias("value"))


@query
def feature_counts(spark, folder):
    return features.feature_counts(plain_features(spark, folder)[1])


@query
def feature_slice(spark, folder):
    """Entries of a random third of the features."""
    long, index = plain_features(spark, folder)
    chosen = index.filter(uniform("pick", F.col("block"), F.col("feature")) < F.lit(1 / 3))
    sliced = features.slice_features(long, chosen)
    return rounded(sliced.select("doc_id", "block", "feature", "value"), "value")


# ---- splits and metrics -------------------------------------------------------------------------------


def label_rows(spark, folder) -> DataFrame:
    return read(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))


@query
def class_counts(spark, folder):
    return metrics.class_counts(read(spark, folder, "labels"), "quality")


@query
def stratified_split(spark, folder):
    return ranking.stratified_split(label_rows(spark, folder))


@query
def train_val_union(spark, folder):
    return ranking.train_and_val(ranking.stratified_split(label_rows(spark, folder)))


@query
def stratified_kfold(spark, folder):
    label = text.binarize_label(F.col("event_type"), ("purchase", "signup"))
    rows = read(spark, folder, "events").select("event_id", label.alias("label"))
    return ranking.stratified_folds(rows, 3, "label", "event_id")


@query
def binary_metrics(spark, folder):
    rows = read(spark, folder, "labels").withColumnsRenamed({"quality": "label", "toxic": "prediction"})
    measured = metrics.metrics(metrics.confusion(rows, []))
    return rounded(measured, "accuracy", "precision", "recall", "f1")


def line_metrics(spark, folder, key: str) -> DataFrame:
    """Mean fold metrics per supplier or part: is a returned line also a finished one?"""
    rows = read(spark, folder, "lineitem").select(
        F.col(key).cast("bigint").alias("ind"),
        (F.col("l_linenumber") % 3).alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_linestatus") == "F").cast("int").alias("prediction"),
    )
    per_fold = metrics.metrics(metrics.confusion(rows, ["ind", "fold"]))
    return metrics.fold_means(per_fold, ["ind"])


@query
def cv_metrics(spark, folder):
    return rounded(line_metrics(spark, folder, "l_suppkey"), "accuracy", "precision", "recall", "f1")


@query
def subset_fitness(spark, folder):
    """Each part is a candidate that selects p_size of 50 features."""
    sizes = read(spark, folder, "part").select(F.col("p_partkey").alias("ind"), F.col("p_size").alias("n"))
    scored = sizes.join(line_metrics(spark, folder, "l_partkey"), "ind", "left")
    value = scores.subset_fitness(
        F.col("accuracy"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("n"), F.lit(50)
    )
    return scored.select("ind", r6(value).alias("fitness"))


@query
def hp_fitness(spark, folder):
    settings = read(spark, folder, "part").select(
        F.col("p_partkey").alias("ind"),
        (F.col("p_size") / 5.0).alias("c"),
        (F.col("p_size") * F.col("p_size") / 2500.0).alias("gamma"),
    )
    scored = settings.join(line_metrics(spark, folder, "l_partkey"), "ind", "left")
    value = scores.setting_fitness(F.col("f1"), F.col("c"), F.col("gamma"))
    return scored.select("ind", r6(value).alias("fitness"))


# ---- candidates -----------------------------------------------------------------------------------------


def event_fitness(spark, folder) -> DataFrame:
    """A user is a search, a day a generation, an event a candidate."""
    day = F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    return read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("search_id"),
        day.alias("generation"),
        F.col("event_id").alias("ind"),
        F.col("value").alias("fitness"),
    )


MEMBERS = 6


def members(spark, folder) -> DataFrame:
    """A customer is a search with six candidates in generation 0.

    A split of the table holds many more candidates than bytes, so the customers are spread before they are exploded.
    """
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(MEMBERS - 1).cast("bigint"))
    customers = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("search_id"))
    return spread(customers, "search_id").select("search_id", F.lit(0).alias("generation"), F.explode(ids).alias("ind"))


def member_fitness(spark, folder) -> DataFrame:
    """One of eight values, so that ties are common."""
    level = F.floor(uniform("fit", F.col("search_id"), F.col("ind")) * 8) / 8.0
    return members(spark, folder).withColumn("fitness", level)


def member_subsets(spark, folder) -> DataFrame:
    genes = members(spark, folder).withColumn("gene", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = uniform("bit", F.col("search_id"), F.col("ind"), F.col("gene")) < 0.5
    return genes.withColumn("bit", bit.cast("int"))


def member_settings(spark, folder) -> DataFrame:
    drawn = {g: uniform(g, F.col("search_id"), F.col("ind")) for g in cand.SETTING_GENES}
    return members(spark, folder).withColumns(drawn)


def member_pairs(spark, folder) -> DataFrame:
    """Two pairs per search, drawn among its members."""
    pool = members(spark, folder).withColumn("slot", F.col("ind"))
    return cand.draw_pairs(pool, 2)


@query
def running_best(spark, folder):
    return cand.running_best(event_fitness(spark, folder))


@query
def generation_best(spark, folder):
    return cand.generation_best(event_fitness(spark, folder))


@query
def param_history(spark, folder):
    fitness = event_fitness(spark, folder)
    drawn = fitness.select(
        "search_id",
        "generation",
        "ind",
        *[uniform(g, F.col("ind")).alias(g) for g in cand.SETTING_GENES],
    )
    return rounded(cand.setting_history(fitness, drawn), "c", "gamma")


@query
def elite_topk(spark, folder):
    return cand.elites(event_fitness(spark, folder))


@query
def tournament(spark, folder):
    return cand.tournament(member_fitness(spark, folder))


@query
def selection_rate(spark, folder):
    return rounded(cand.selection_rate(member_subsets(spark, folder)), "selection_rate")


@query
def distinct_candidates(spark, folder):
    return cand.distinct_candidates(member_subsets(spark, folder)).drop("signature")


@query
def subset_init(spark, folder):
    """A language is a search, its distinct words are the features."""
    rows = documents(spark, folder).select("doc_id", "lang", "text")
    rows = spread(rows, "doc_id").withColumnRenamed("lang", "search_id")
    found = unpack(rows, ["search_id"], F.array_distinct(text.tokens(F.col("text"))), "gene")
    return cand.init_subsets(found.distinct(), 6)


@query
def uniform_crossover(spark, folder):
    return cand.cross_subsets(member_pairs(spark, folder), member_subsets(spark, folder))


@query
def bitflip_mutation(spark, folder):
    return cand.flip_bits(member_subsets(spark, folder).withColumnRenamed("ind", "child"), 30)


@query
def next_generation(spark, folder):
    population = member_subsets(spark, folder)
    children = cand.cross_subsets(member_pairs(spark, folder), population)
    top = cand.elites(member_fitness(spark, folder))
    return cand.next_generation(top, children, population, 5, ["gene", "bit"])


@query
def hp_init(spark, folder):
    """A customer is a search."""
    customers = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("search_id"))
    return rounded(cand.init_settings(customers, 6), "c_norm", "gamma_norm")


def line_settings(spark, folder) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 5.0).alias("c"),
        (F.lit(0.001) + F.col("l_discount") * 9.99).alias("gamma"),
        F.when(F.col("l_returnflag") == "R", "linear").otherwise("rbf").alias("kernel"),
    )


@query
def hp_encode(spark, folder):
    coded = cand.encode_settings(line_settings(spark, folder)).drop("c", "gamma", "kernel")
    return rounded(coded, "c_norm", "gamma_norm")


@query
def hp_decode(spark, folder):
    coded = read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_quantity") / 50.0).alias("c_norm"),
        (F.col("l_discount") * 10.0).alias("gamma_norm"),
        (F.col("l_tax") * 12.5).alias("kernel_norm"),
    )
    return rounded(cand.decode_settings(coded).drop(*cand.SETTING_GENES), "c", "gamma")


@query
def arithmetic_crossover(spark, folder):
    born = cand.cross_settings(member_pairs(spark, folder), member_settings(spark, folder))
    return rounded(born, *cand.SETTING_GENES)


@query
def gaussian_mutation(spark, folder):
    shaken = cand.shake_settings(member_settings(spark, folder).withColumnRenamed("ind", "child"), 20)
    return rounded(shaken, *cand.SETTING_GENES)


@query
def decay_schedule(spark, folder):
    generation = F.dayofmonth("ts") - 1
    return read(spark, folder, "events").select(
        "event_id",
        r6(scores.decayed(0.05, generation, 30)).alias("flip_rate"),
        r6(scores.decayed(0.1, generation, 20)).alias("noise_std"),
    )


# ---- models ---------------------------------------------------------------------------------------------

# whole searches: populations, generations, vocabulary and training are the library's
SUBSETS = search.SubsetSearch()
SETTINGS = search.SettingSearch()
RUN_SPEC = FeatureSpec(**{**SPEC.__dict__, "readability": "cleaned"})


def packed_rows(spark, folder) -> tuple[DataFrame, int]:
    """(doc_id, label, fold, indices, values) of all labelled documents, and the number of features."""
    df = labelled(spark, folder).withColumn("split", F.lit("train"))
    _, _, packed, n_features = run.fitted_vectors(df, SPEC, False)
    rows = df.select("doc_id", "label").join(packed, "doc_id")
    return ranking.stratified_folds(reliable(rows)), n_features


def held_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col("fold") != 0), rows.filter(F.col("fold") == 0)


@query
def svm_linear(spark, folder):
    rows, n_features = packed_rows(spark, folder)
    train, test = held_out(rows)
    data = features.to_vectors(train, n_features).persist()
    model = svm.linear_svc(1.0, data.count()).fit(data)
    data.unpersist()
    scored = model.transform(features.to_vectors(test, n_features))
    return scored.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query
def svm_rbf(spark, folder):
    rows, n_features = packed_rows(spark, folder)
    width = svm.TrainingPlan().fourier
    waves = svm.fourier_features(rows, n_features, gamma=0.01, width=width)
    train, test = held_out(waves)
    data = features.to_vectors(train, width).persist()
    model = svm.linear_svc(1.0, data.count()).fit(data)
    data.unpersist()
    scored = model.transform(features.to_vectors(test, width))
    return scored.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query
def svm_probability(spark, folder):
    rows, n_features = packed_rows(spark, folder)
    laid_out = svm.prepare(rows, n_features)
    models = svm.fit_models(laid_out, [svm.Candidate(0)], [0, 1, 2])
    margins = reliable(svm.predict_rows(laid_out.df, models))
    laid_out.release()
    scored = svm.with_probability(margins, svm.platt_scaler(margins))
    return scored.select("doc_id", "label", "prediction", "probability")


@query
def cv_predictions(spark, folder):
    """Three candidates, trained together with each fold held out."""
    rows, n_features = packed_rows(spark, folder)
    laid_out = svm.prepare(rows, n_features)
    tried = [svm.Candidate(0), svm.Candidate(1, c=0.1), svm.Candidate(2, 1.0, "rbf", 0.01)]
    models = svm.fit_models(laid_out, tried, [0, 1, 2])
    out = reliable(svm.predict_rows(laid_out.df, models))
    laid_out.release()
    return out.select("ind", "fold", "doc_id", "label", "prediction")


@query
def subset_search(spark, folder):
    rows, n_features = packed_rows(spark, folder)
    laid_out = svm.prepare(rows, n_features)
    _, log = search.subset_search(laid_out, SUBSETS)
    laid_out.release()
    return cand.running_best(log)


@query
def hp_search(spark, folder):
    rows, n_features = packed_rows(spark, folder)
    laid_out = svm.prepare(rows, n_features)
    history, _ = search.setting_search(laid_out, SETTINGS)
    laid_out.release()
    return history


RUNS: dict[tuple[str, str], run.RunOutput] = {}


def whole_run(spark, folder) -> run.RunOutput:
    """One run per application and folder; three queries read its output tables."""
    this = (spark.sparkContext.applicationId, folder)
    if this not in RUNS:
        options = run.RunSettings(RUN_SPEC)  # both searches whole
        RUNS[this] = run.run(labelled(spark, folder), options)
    return RUNS[this]


@query
def end_to_end_run(spark, folder):
    return whole_run(spark, folder).report


@query
def run_result(spark, folder):
    return whole_run(spark, folder).result.select("run_id", "dataset.*", "features.*")


@query
def predictions(spark, folder):
    return whole_run(spark, folder).predictions


@query
def run_summary(spark, folder):
    """The dataset and feature sections of the report, fitted on all labelled rows."""
    df = labelled(spark, folder)
    spec = FeatureSpec(**{**SPEC.__dict__, "stem": False})
    split = ranking.stratified_split(df.select("doc_id", "label"))
    dataset = run.report_rows(run.dataset_summary(split), "1 dataset")
    return dataset.unionByName(
        run.report_rows(run.feature_summary(feature_build.fit(df, spec).index()), "2 features")
    )
