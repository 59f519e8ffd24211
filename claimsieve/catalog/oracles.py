"""DuckDB SQL for every query that SQL can express, written step by step from the definitions."""

from __future__ import annotations

from claimsieve.functions import stem as stem_rules
from claimsieve.functions import text

WS = r"\t-\r\x1c-\x20\x85\p{Z}"
GENES = ("c_norm", "gamma_norm", "kernel_norm")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def u(tag: str, *keys: str) -> str:
    """Uniform draw keyed by tag and columns."""
    parts = ", ".join(["'42'", f"'{tag}'", *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE)"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def no_urls(x: str) -> str:
    return f"regexp_replace({x}, 'http[^{WS}]+|www[^{WS}]+', '', 'g')"


def no_mentions(x: str) -> str:
    return rf"regexp_replace({x}, '[@#][\p{{L}}\p{{N}}_]+', '', 'g')"


def no_punct_digits(x: str) -> str:
    spaced = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{WS}]', ' ', 'g')"
    return rf"regexp_replace({spaced}, '\p{{Nd}}+', ' ', 'g')"


def cleaned(x: str) -> str:
    return no_punct_digits(no_mentions(no_urls(f"lower(coalesce({x}, ''))")))


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: length(t) > 0)"


# words: every cleaned word with its place; tokens: those that are no stop words and long enough
WORDS = f"""
word_lists AS (SELECT doc_id, lang, {split_words(cleaned('text'))} AS ws FROM documents),
words AS (SELECT doc_id, lang, unnest(ws) AS token, generate_subscripts(ws, 1) AS place FROM word_lists),
kept AS (SELECT * FROM words WHERE token NOT IN ({quoted(text.STOPWORDS)}))"""
TOKENS = f"""{WORDS},
tokens AS (
  SELECT doc_id, lang, token, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos
  FROM kept WHERE length(token) > 2)"""


def swap_ending(source: str, name: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{end}' THEN '{new}'" for end, new in table.items())
    ends = "|".join(table)
    return f"""
{name}_e AS (SELECT *, regexp_extract(w, '^(.*?)({ends})$', 2) AS e FROM {source}),
{name}_s AS (SELECT *, left(w, length(w) - length(e)) AS s FROM {name}_e),
{name} AS (SELECT token, CASE WHEN e <> '' AND regexp_matches(s, '{stem_rules.MEASURE_ABOVE_0}')
  THEN s || CASE e {cases} END ELSE w END AS w FROM {name}_s)"""


M0, M1, M2 = stem_rules.MEASURE_ABOVE_0, stem_rules.MEASURE_IS_1, stem_rules.MEASURE_ABOVE_1
IRREGULAR = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stem_rules.IRREGULAR.items())
STEMS = rf"""
s0 AS (SELECT DISTINCT token, regexp_replace(token, '^y', 'Y') AS w FROM kept),
s1 AS (SELECT token, CASE
  WHEN regexp_matches(w, '^.ies$') THEN left(w, 3)
  WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2)
  WHEN w LIKE '%ss' THEN w
  WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS w FROM s0),
s2 AS (SELECT token, w, CASE
  WHEN w LIKE '%ied' OR w LIKE '%eed' THEN NULL
  WHEN w LIKE '%ed' AND regexp_matches(left(w, length(w) - 2), '{stem_rules.HAS_VOWEL}') THEN left(w, length(w) - 2)
  WHEN w LIKE '%ing' AND regexp_matches(left(w, length(w) - 3), '{stem_rules.HAS_VOWEL}') THEN left(w, length(w) - 3)
  END AS b FROM s1),
s3 AS (SELECT token, CASE
  WHEN regexp_matches(w, '^.ied$') THEN left(w, 3)
  WHEN w LIKE '%ied' THEN left(w, length(w) - 2)
  WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{M0}') THEN left(w, length(w) - 1) ELSE w END
  WHEN b IS NULL THEN w
  WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND NOT regexp_matches(right(b, 1), '[aeiouyY]')
    THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END
  WHEN regexp_matches(b, '{M1}') AND regexp_matches(b, '{stem_rules.SHORT_END}') THEN b || 'e'
  ELSE b END AS w FROM s2),
s4 AS (SELECT token, CASE WHEN regexp_matches(w, '^.+[^aeiouy]y$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT token, CASE
  WHEN w LIKE '%alli' AND regexp_matches(left(w, length(w) - 4), '{M0}') THEN left(w, length(w) - 2)
  WHEN w LIKE '%logi' AND regexp_matches(left(w, length(w) - 3), '{M0}') THEN left(w, length(w) - 1)
  ELSE w END AS w FROM s4),
{swap_ending('s5', 's6', stem_rules.STEP_2)},
{swap_ending('s6', 's7', stem_rules.STEP_3)},
s8_e AS (SELECT *, regexp_extract(w, '^(.*?)({"|".join(stem_rules.STEP_4)})$', 2) AS e FROM s7),
s8_s AS (SELECT *, left(w, length(w) - length(e)) AS s FROM s8_e),
s8 AS (SELECT token, CASE WHEN e <> '' AND regexp_matches(s, '{M2}') AND (e <> 'ion' OR s LIKE '%s' OR s LIKE '%t')
  THEN s ELSE w END AS w FROM s8_s),
s9 AS (SELECT token, CASE WHEN w LIKE '%e' AND (regexp_matches(left(w, length(w) - 1), '{M2}')
    OR (regexp_matches(left(w, length(w) - 1), '{M1}') AND NOT regexp_matches(left(w, length(w) - 1), '{stem_rules.SHORT_END}')))
  THEN left(w, length(w) - 1) ELSE w END AS w FROM s8),
s10 AS (SELECT token, CASE WHEN w LIKE '%ll' AND regexp_matches(left(w, length(w) - 1), '{M2}')
  THEN left(w, length(w) - 1) ELSE w END AS w FROM s9),
stems AS (SELECT token, CASE token {IRREGULAR} ELSE
  CASE WHEN length(token) <= 2 THEN token ELSE lower(w) END END AS stem FROM s10)"""
STEMMED = f"""{WORDS},{STEMS},
tokens AS (
  SELECT doc_id, stem AS token, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos
  FROM kept JOIN stems USING (token) WHERE length(stem) > 2)"""

GRAMS = """
runs AS (
  SELECT doc_id, token AS a, lead(token, 1) OVER w AS b, lead(token, 2) OVER w AS c
  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
  SELECT doc_id, a AS term FROM runs
  UNION ALL SELECT doc_id, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL)"""
COUNTS = f"{GRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term)"
FREQUENT = f"""{COUNTS},
n AS (SELECT count(*) AS n FROM documents),
frequent AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT n FROM n))"""
IDF = "ln((1.0::DOUBLE + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1"


def tfidf_ctes(size: int) -> str:
    return f"""{FREQUENT},
top AS (SELECT * FROM frequent ORDER BY total DESC, term LIMIT {size}),
vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS pos, {IDF} AS idf FROM top),
weighted AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, w / norm AS value FROM weighted JOIN norms USING (doc_id))"""


def category_ctes(source: str, cap: int = 10) -> str:
    return f"""
cells AS (
  SELECT doc_id, 'lang' AS "column", lang AS category FROM {source}
  UNION ALL SELECT doc_id, 'source', source FROM {source}),
sizes AS (SELECT "column", category, count(*) AS n FROM cells GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, category DESC NULLS FIRST) AS r,
    count(*) OVER (PARTITION BY "column") AS k FROM sizes),
marked AS (SELECT *, k <= {cap} OR r < {cap} AS frequent FROM ranked),
outputs AS (
  SELECT "column", category, n, "column" || '=' || coalesce(category, '<null>') AS out_name, false AS is_infrequent
  FROM marked WHERE frequent
  UNION ALL
  SELECT "column", NULL, sum(n)::BIGINT, "column" || '=<infrequent>', true FROM marked WHERE NOT frequent GROUP BY 1),
categories AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY is_infrequent, category NULLS LAST) - 1 AS pos FROM outputs),
names AS (
  SELECT "column", category, CASE WHEN frequent THEN "column" || '=' || coalesce(category, '<null>')
    ELSE "column" || '=<infrequent>' END AS feature FROM marked)"""


def sentence_scores(x: str) -> dict[str, str]:
    words = split_words(x)
    sentences = f"list_filter(string_split_regex({x}, '[.!?]+'), lambda t: regexp_matches(t, '[^{WS}]'))"
    defined = f"len({words}) > 0 AND len({sentences}) > 0"
    scores = {
        "avg_sentence_length": f"len({words})::DOUBLE / len({sentences})",
        "avg_word_length": f"list_sum(list_transform({words}, lambda t: length(t)))::DOUBLE / len({words})",
        "unique_word_ratio": f"len(list_distinct({words}))::DOUBLE / len({words})",
    }
    return {name: f"CASE WHEN {defined} THEN {score} ELSE 0 END" for name, score in scores.items()}


VECTOR_CELLS = """
cells_v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM {source}),
stats_v AS (
  SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS std FROM cells_v GROUP BY pos),
scaled_v AS (SELECT vec_id, pos, (x - mean) / std AS value FROM cells_v JOIN stats_v USING (pos))"""


def block_ctes(tokens: str) -> str:
    """All feature blocks of the documents, numbered side by side."""
    raw = sentence_scores("coalesce(text, '')")
    return f"""{tokens},{tfidf_ctes(5000)},{category_ctes('documents')},
{VECTOR_CELLS.format(source="(SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)")},
moments AS (SELECT avg(n_chars) AS mean, stddev_pop(n_chars) AS std FROM documents),
reading AS (SELECT doc_id, {", ".join(f"{s} AS {n}" for n, s in raw.items())} FROM documents),
features AS (
  SELECT doc_id, 'tfidf' AS block, term AS feature, value FROM tfidf
  UNION ALL SELECT vec_id, 'embedding', pos::VARCHAR, value FROM scaled_v
  UNION ALL SELECT c.doc_id, 'categorical', m.feature, 1.0 FROM cells c
    JOIN names m ON m."column" = c."column" AND m.category IS NOT DISTINCT FROM c.category
  UNION ALL SELECT doc_id, 'numeric', 'n_chars', (n_chars - mean) / (std + 1e-8) FROM documents, moments
  UNION ALL SELECT doc_id, 'readability', 'avg_sentence_length', avg_sentence_length FROM reading
  UNION ALL SELECT doc_id, 'readability', 'avg_word_length', avg_word_length FROM reading
  UNION ALL SELECT doc_id, 'readability', 'unique_word_ratio', unique_word_ratio FROM reading),
feature_places AS (
  SELECT 1 AS b, 'tfidf' AS block, term AS feature, pos AS place FROM vocab
  UNION ALL SELECT 2, 'embedding', pos::VARCHAR, pos FROM stats_v
  UNION ALL SELECT 3, 'categorical', out_name, CASE "column" WHEN 'lang' THEN 1 ELSE 2 END * 1000 + pos FROM categories
  UNION ALL SELECT 4, 'numeric', 'n_chars', 0
  UNION ALL SELECT 5, 'readability', 'avg_sentence_length', 0
  UNION ALL SELECT 5, 'readability', 'avg_word_length', 1
  UNION ALL SELECT 5, 'readability', 'unique_word_ratio', 2),
feature_index AS (SELECT row_number() OVER (ORDER BY b, place) - 1 AS position, block, feature FROM feature_places)"""


def metric_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    def ratio(a, b):
        return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"

    return {
        "accuracy": ratio(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"),
        "precision": ratio(tp, f"{tp} + {fp}"),
        "recall": ratio(tp, f"{tp} + {fn}"),
        "f1": ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
    }


def confusion_columns(label: str, prediction: str) -> str:
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {t} AND {prediction} = {g}) AS {name}" for name, (t, g) in cells.items()
    )


def line_metrics(key: str) -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in metric_columns().items())
    means = ", ".join(f"avg({n}) AS {n}" for n in metric_columns())
    return f"""
lines AS (
  SELECT {key}::BIGINT AS ind, l_linenumber % 3 AS fold, (l_returnflag = 'R')::INT AS label,
    (l_linestatus = 'F')::INT AS prediction FROM lineitem),
fold_counts AS (SELECT ind, fold, {confusion_columns('label', 'prediction')} FROM lines GROUP BY ind, fold),
fold_metrics AS (SELECT ind, fold, {columns} FROM fold_counts),
means AS (SELECT ind, {means} FROM fold_metrics GROUP BY ind)"""


LABELLED = "labelled AS (SELECT doc_id, quality AS label FROM labels)"
SPLIT = f"""
{LABELLED},
ranked_l AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u('split', 'doc_id')}, doc_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM labelled),
sized AS (SELECT *, floor(n * 0.2::DOUBLE + 0.5)::BIGINT AS n_test FROM ranked_l),
split AS (
  SELECT doc_id, label, CASE WHEN r <= n_test THEN 'test'
    WHEN r <= n_test + floor((n - n_test) * 0.25::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split FROM sized)"""

EVENT_FITNESS = """
fitness AS (
  SELECT user_id::VARCHAR AS search_id, date_diff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS generation,
    event_id AS ind, value AS fitness FROM events)"""
MEMBERS = f"""
members AS (
  SELECT c_custkey::VARCHAR AS search_id, 0 AS generation, ind FROM customer, (SELECT unnest(range(6))::BIGINT AS ind)),
fitness AS (
  SELECT search_id, generation, ind, floor({u('fit', 'search_id', 'ind')} * 8) / 8.0::DOUBLE AS fitness FROM members)"""
SUBSETS = f"""{MEMBERS},
genes AS (SELECT unnest(range(8))::INTEGER AS gene),
subsets AS (
  SELECT search_id, generation, ind, gene, ({u('bit', 'search_id', 'ind', 'gene')} < 0.5)::INTEGER AS bit FROM members, genes)"""
SETTINGS = f"""{MEMBERS},
settings AS (SELECT *, {", ".join(f"{u(g, 'search_id', 'ind')} AS {g}" for g in GENES)} FROM members)"""
PAIRS = f"""
pool AS (SELECT search_id, generation, count(*) AS n FROM fitness GROUP BY ALL),
pair_draws AS (
  SELECT *, floor({u('pair', 'search_id', 'generation', 'pair', "'0'")} * n)::BIGINT AS p1,
    floor({u('pair', 'search_id', 'generation', 'pair', "'1'")} * (n - 1))::BIGINT AS q
  FROM pool, (SELECT unnest([0, 1])::BIGINT AS pair)),
pairs AS (
  SELECT search_id, generation, pair, p1 AS parent1,
    CASE WHEN n = 1 THEN p1 WHEN q >= p1 THEN q + 1 ELSE q END AS parent2 FROM pair_draws)"""
CROSSED = f"""
parents AS (
  SELECT p.search_id, p.generation, pair, a.gene, a.bit AS bit1, b.bit AS bit2,
    {u('cross', 'p.search_id', 'p.generation', 'pair')} <= 0.8
      AND {u('mask', 'p.search_id', 'p.generation', 'pair', 'a.gene')} <= 0.5 AS swap
  FROM pairs p
  JOIN subsets a ON a.search_id = p.search_id AND a.generation = p.generation AND a.ind = p.parent1
  JOIN subsets b ON b.search_id = p.search_id AND b.generation = p.generation AND b.ind = p.parent2 AND b.gene = a.gene),
children AS (
  SELECT search_id, generation, gene, pair * 2 AS child, CASE WHEN swap THEN bit2 ELSE bit1 END AS bit FROM parents
  UNION ALL
  SELECT search_id, generation, gene, pair * 2 + 1, CASE WHEN swap THEN bit1 ELSE bit2 END FROM parents)"""
BEST = """
best AS (
  SELECT search_id, generation, ind, fitness FROM fitness
  QUALIFY row_number() OVER (PARTITION BY search_id, generation ORDER BY fitness DESC, ind) = 1)"""
RUNNING = f"""{BEST},
running AS (
  SELECT a.search_id, a.generation, b.generation AS best_generation, b.ind AS best_ind, b.fitness AS best_fitness
  FROM best a JOIN best b ON a.search_id = b.search_id AND b.generation <= a.generation
  QUALIFY row_number() OVER (
    PARTITION BY a.search_id, a.generation ORDER BY b.fitness DESC, b.generation, b.ind) = 1)"""
ELITES = """
top AS (
  SELECT search_id, generation, place::BIGINT AS place, ind, fitness FROM (
    SELECT *, row_number() OVER (PARTITION BY search_id, generation ORDER BY fitness DESC, ind) - 1 AS place FROM fitness)
  WHERE place < 2)"""


def decade(low: float, high: float, tag: str) -> str:
    draw = u(tag, "search_id", "ind")
    return f"pow(10, log10({low}) + {draw} * (log10({high}) - log10({low})))"


def encoded(value: str, low: float, high: float) -> str:
    return f"(log10({value}) - log10({low})) / (log10({high}) - log10({low}))"


def decoded(value: str, low: float, high: float) -> str:
    clipped = f"least(greatest({value}, 0), 1)"
    return f"pow(10, log10({low}) + {clipped} * (log10({high}) - log10({low})))"


def decay(start: float, generation: str, generations: int) -> str:
    return f"greatest({start}::DOUBLE * (1 - {generation} / {generations}.0::DOUBLE), 0.01)"


def normal(tag: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(tag + '-u1', *keys)})) * cos(2 * pi() * {u(tag + '-u2', *keys)}))"


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}

    out["scan_tsv"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    missing = f"[{quoted(text.MISSING_TOKENS)}]"
    size = len(text.MISSING_TOKENS) + 2
    out["na_normalize"] = f"""
WITH raw AS (
  SELECT doc_id, CASE doc_id % {size} WHEN {size - 2} THEN 'none' WHEN {size - 1} THEN source
    ELSE ({missing})[doc_id % {size} + 1] END AS raw FROM documents)
SELECT doc_id, raw, CASE WHEN raw IN ({quoted(text.MISSING_TOKENS)}) THEN NULL ELSE raw END AS value FROM raw"""
    out["filter_nonnull"] = "SELECT doc_id, text AS statement FROM documents WHERE n_chars % 5 > 0"
    out["binarize_label"] = (
        "SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label FROM events"
    )
    out["align_labels"] = (
        "SELECT doc_id, source, quality AS label FROM documents JOIN labels USING (doc_id)"
    )

    out["remove_urls"] = f"SELECT doc_id, {no_urls('lower(text)')} AS text FROM documents"
    out["remove_mentions"] = f"SELECT doc_id, {no_mentions('lower(text)')} AS text FROM documents"
    out["remove_punct_digits"] = f"SELECT doc_id, {no_punct_digits('text')} AS text FROM documents"
    out["text_clean"] = f"SELECT doc_id, array_to_string({split_words(cleaned('text'))}, ' ') AS text FROM documents"
    out["stopword_union"] = select(
        WORDS,
        f"SELECT token AS word, count(DISTINCT doc_id) AS n_docs FROM words WHERE token IN ({quoted(text.STOPWORDS)}) GROUP BY 1",
    )
    joined = "SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY {at}), '') AS tokens{more} FROM documents d LEFT JOIN {source} t USING (doc_id) GROUP BY d.doc_id"
    out["stopword_anti"] = select(WORDS, joined.format(at="place", more="", source="kept"))
    out["tokens"] = select(TOKENS, joined.format(at="pos", more=", count(token)::INTEGER AS n_tokens", source="tokens"))
    out["stem_tokens"] = select(STEMMED, joined.format(at="pos", more="", source="tokens"))
    lexicon = cleaned("text")
    out["lemma_lookup"] = select(
        f"""{TOKENS},
lexicon AS (
  SELECT DISTINCT token, left(token, 4) AS lemma FROM (SELECT unnest({split_words(lexicon)}) AS token FROM benchmark)
  WHERE length(token) > 4 AND token NOT IN ({quoted(text.STOPWORDS)})),
mapped AS (SELECT doc_id, pos, coalesce(lemma, token) AS token FROM tokens LEFT JOIN lexicon USING (token))""",
        joined.format(at="pos", more="", source="mapped"),
    )
    raw = ", ".join(r6(s, n) for n, s in sentence_scores("text").items())
    clean = ", ".join(r6(s, f"clean_{n}") for n, s in sentence_scores("clean").items())
    out["readability"] = select(
        f"""{TOKENS},
clean_texts AS ({joined.format(at="pos", more="", source="tokens")}),
both_texts AS (SELECT doc_id, coalesce(text, '') AS text, tokens AS clean FROM documents JOIN clean_texts USING (doc_id))""",
        f"SELECT doc_id, {raw}, {clean} FROM both_texts",
    )

    out["ngrams"] = select(f"{TOKENS},{GRAMS}", "SELECT doc_id, term FROM grams")
    out["term_freq"] = select(f"{TOKENS},{COUNTS}", "SELECT doc_id, term, tf FROM tf")
    out["doc_freq_prune"] = select(f"{TOKENS},{FREQUENT}", "SELECT term, df, total FROM frequent")
    out["idf"] = select(f"{TOKENS},{FREQUENT}", f"SELECT term, df, {r6(IDF, 'idf')} FROM frequent")
    out["vocab_topk"] = select(f"{TOKENS},{tfidf_ctes(5000)}", "SELECT term, pos, df, total FROM vocab")
    out["tfidf"] = select(f"{TOKENS},{tfidf_ctes(5000)}", f"SELECT doc_id, term, {r6('value', 'value')} FROM tfidf")

    out["category_cap"] = select(
        category_ctes("documents"), 'SELECT "column", category, n, out_name, is_infrequent, pos FROM categories'
    )
    hot = 'JOIN names m ON m."column" = c."column" AND m.category IS NOT DISTINCT FROM c.category'
    out["onehot"] = select(
        category_ctes("documents"),
        f'SELECT doc_id, c."column", feature, 1.0::DOUBLE AS value FROM cells c {hot}',
    )
    toxic = "(SELECT d.* FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id))"
    out["onehot_unknown"] = select(
        f"""{category_ctes(toxic)},
all_cells AS (
  SELECT doc_id, 'lang' AS "column", lang AS category FROM documents
  UNION ALL SELECT doc_id, 'source', source FROM documents)""",
        f'SELECT doc_id, c."column", feature, 1.0::DOUBLE AS value FROM all_cells c {hot}',
    )
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out["numeric_stats"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r6(f'avg({c}::DOUBLE)', 'mean')}, {r6(f'stddev_pop({c}::DOUBLE)', 'std_pop')} FROM lineitem"""
        for c in numbers
    )
    out["zscore"] = " UNION ALL ".join(
        f"""SELECT p_partkey, '{c}' AS feature,
  {r6(f'({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / (stddev_pop({c}::DOUBLE) OVER () + 1e-8)', 'value')} FROM part"""
        for c in ("p_size", "p_retailprice")
    )
    cells = "SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos FROM embeddings"
    out["mean_pool"] = f"SELECT label, pos, {r6('avg(x)', 'value')} FROM ({cells}) GROUP BY label, pos"
    out["embedding_standardize"] = select(
        VECTOR_CELLS.format(source="embeddings"),
        f"SELECT vec_id, pos::INTEGER AS pos, {r6('value', 'value')} FROM scaled_v",
    )

    out["hybrid_features"] = select(
        block_ctes(STEMMED), f"SELECT doc_id, block, feature, {r6('value', 'value')} FROM features"
    )
    out["feature_concat"] = select(
        block_ctes(TOKENS),
        f"SELECT doc_id, position, {r6('value', 'value')} FROM features JOIN feature_index USING (block, feature)",
    )
    out["feature_counts"] = select(
        block_ctes(TOKENS),
        "SELECT coalesce(block, 'total') AS block, count(*) AS n_features FROM feature_index GROUP BY ROLLUP (block)",
    )
    out["feature_slice"] = select(
        block_ctes(TOKENS),
        f"""SELECT doc_id, block, feature, {r6('value', 'value')} FROM features
SEMI JOIN (SELECT * FROM feature_index WHERE {u('pick', 'block', 'feature')} < 1.0::DOUBLE / 3) p USING (block, feature)""",
    )

    out["class_counts"] = """SELECT count(*) AS total, sum(quality)::BIGINT AS positives,
  (count(*) - sum(quality))::BIGINT AS negatives FROM labels"""
    out["stratified_split"] = select(SPLIT, "SELECT doc_id, label, split FROM split")
    out["train_val_union"] = select(SPLIT, "SELECT doc_id, label, split FROM split WHERE split <> 'test'")
    out["stratified_kfold"] = f"""
WITH rows AS (SELECT event_id, (event_type IN ('purchase', 'signup'))::INTEGER AS label FROM events)
SELECT event_id, label,
  ((row_number() OVER (PARTITION BY label ORDER BY {u('fold', 'event_id')}, event_id) - 1) % 3)::INTEGER AS fold FROM rows"""
    rounded_metrics = ", ".join(r6(e, n) for n, e in metric_columns().items())
    out["binary_metrics"] = f"""
WITH c AS (SELECT {confusion_columns('quality', 'toxic')} FROM labels) SELECT tp, fp, fn, tn, {rounded_metrics} FROM c"""
    out["cv_metrics"] = select(
        line_metrics("l_suppkey"), "SELECT ind, " + ", ".join(r6(n, n) for n in metric_columns()) + " FROM means"
    )
    penalty = "least(sqrt(p_size) / sqrt(50), 0.3)"
    out["subset_fitness"] = select(
        line_metrics("l_partkey"),
        f"""SELECT p_partkey AS ind, CASE WHEN p_size < 5 THEN 0 ELSE
  round(greatest(coalesce(0.35 * f1 + 0.20 * accuracy + 0.15 * "precision" + 0.15 * recall - 0.15 * {penalty}, 0), 0), 6)
  END AS fitness FROM part LEFT JOIN means ON ind = p_partkey""",
    )
    out["hp_fitness"] = select(
        line_metrics("l_partkey"),
        """SELECT p_partkey AS ind, round(greatest(coalesce(
  f1 - 0.01 * abs(log10(p_size / 5.0::DOUBLE)) - 0.01 * abs(log10(p_size * p_size / 2500.0::DOUBLE / 0.1)), 0), 0), 6)
  AS fitness FROM part LEFT JOIN means ON ind = p_partkey""",
    )

    out["generation_best"] = select(f"{EVENT_FITNESS},{BEST}", "SELECT * FROM best")
    out["running_best"] = select(f"{EVENT_FITNESS},{RUNNING}", "SELECT * FROM running")
    draws = {g: u(g, "best_ind") for g in GENES}
    out["param_history"] = select(
        f"{EVENT_FITNESS},{RUNNING}",
        f"""SELECT search_id, generation, {r6(decoded(draws['c_norm'], 0.1, 10.0), 'c')},
  {r6(decoded(draws['gamma_norm'], 0.001, 1.0), 'gamma')},
  CASE WHEN {draws['kernel_norm']} < 0.5 THEN 'linear' ELSE 'rbf' END AS kernel, best_fitness AS fitness FROM running""",
    )
    out["elite_topk"] = select(f"{EVENT_FITNESS},{ELITES}", "SELECT * FROM top")
    keys = ("search_id", "generation", "slot")
    out["tournament"] = select(
        f"""{MEMBERS},
slots AS (SELECT search_id, generation, ind AS slot, count(*) OVER (PARTITION BY search_id, generation) AS n FROM fitness),
draws AS (
  SELECT *, floor({u('tour', *keys, "'0'")} * n)::BIGINT AS p1, floor({u('tour', *keys, "'1'")} * (n - 1))::BIGINT AS q2,
    floor({u('tour', *keys, "'2'")} * (n - 2))::BIGINT AS q3 FROM slots),
two AS (SELECT *, CASE WHEN q2 >= p1 THEN q2 + 1 ELSE q2 END AS p2 FROM draws),
low AS (SELECT *, CASE WHEN q3 >= least(p1, p2) THEN q3 + 1 ELSE q3 END AS q FROM two),
three AS (SELECT *, CASE WHEN q >= greatest(p1, p2) THEN q + 1 ELSE q END AS p3 FROM low),
entered AS (
  SELECT search_id, generation, slot, 0 AS draw, p1 AS ind FROM three
  UNION ALL SELECT search_id, generation, slot, 1, p2 FROM three WHERE n > 1
  UNION ALL SELECT search_id, generation, slot, 2, p3 FROM three WHERE n > 2)""",
        """SELECT search_id, generation, slot, ind FROM entered JOIN fitness USING (search_id, generation, ind)
QUALIFY row_number() OVER (PARTITION BY search_id, generation, slot ORDER BY fitness DESC, draw) = 1""",
    )
    out["selection_rate"] = select(
        SUBSETS,
        f"""SELECT search_id, generation, ind, sum(bit)::BIGINT AS n_selected, count(*) AS n_total,
  {r6('avg(bit)', 'selection_rate')} FROM subsets GROUP BY ALL""",
    )
    out["distinct_candidates"] = select(
        f"""{SUBSETS},
bits AS (SELECT search_id, generation, ind, string_agg(bit::VARCHAR, '' ORDER BY gene) AS bits FROM subsets GROUP BY ALL)""",
        """SELECT search_id, generation, ind, min(ind) OVER (PARTITION BY search_id, generation, bits) AS scored_ind FROM bits""",
    )
    def rate(low, width):
        return f"{low}::DOUBLE + {width}::DOUBLE * {u('rate', 'search_id', 'ind')}"

    out["subset_init"] = select(
        f"""{TOKENS},
found AS (SELECT DISTINCT lang AS search_id, token AS gene FROM tokens),
members AS (SELECT search_id, gene, ind FROM found, (SELECT unnest(range(6))::BIGINT AS ind)),
rated AS (SELECT *, CASE WHEN ind < 2 THEN {rate(0.1, 0.2)} WHEN ind < 4 THEN {rate(0.3, 0.3)} ELSE {rate(0.6, 0.3)} END AS rate FROM members)""",
        f"SELECT search_id, 0 AS generation, ind, gene, ({u('gene', 'search_id', 'ind', 'gene')} < rate)::INTEGER AS bit FROM rated",
    )
    out["uniform_crossover"] = select(
        f"{SUBSETS},{PAIRS},{CROSSED}", "SELECT search_id, generation, gene, child, bit FROM children"
    )
    out["bitflip_mutation"] = select(
        SUBSETS,
        f"""SELECT search_id, generation, ind AS child, gene,
  CASE WHEN {u('flip', 'search_id', 'generation', 'ind', 'gene')} < {decay(0.05, 'generation', 30)} THEN 1 - bit ELSE bit END AS bit
FROM subsets""",
    )
    out["next_generation"] = select(
        f"""{SUBSETS},{PAIRS},{CROSSED},{ELITES},
kept AS (
  SELECT s.search_id, s.generation, place AS ind, gene, bit FROM subsets s JOIN top t
  ON s.search_id = t.search_id AND s.generation = t.generation AND s.ind = t.ind),
offsets AS (SELECT search_id, generation, count(*) AS k FROM top GROUP BY ALL),
assembled AS (
  SELECT * FROM kept UNION ALL
  SELECT search_id, generation, child + k, gene, bit FROM children JOIN offsets USING (search_id, generation))""",
        "SELECT search_id, generation + 1 AS generation, ind, gene, bit FROM assembled WHERE ind < 5",
    )
    c = f"CASE WHEN ind < 2 THEN {decade(0.5, 2.0, 'c')} ELSE {decade(0.1, 10.0, 'c')} END"
    gamma = f"CASE WHEN ind >= 2 AND ind < 4 THEN {decade(0.01, 0.1, 'gamma')} ELSE {decade(0.001, 1.0, 'gamma')} END"
    out["hp_init"] = f"""
WITH members AS (
  SELECT c_custkey::VARCHAR AS search_id, ind FROM customer, (SELECT unnest(range(6))::BIGINT AS ind)),
plain AS (SELECT *, {c} AS c, {gamma} AS gamma FROM members)
SELECT search_id, 0 AS generation, ind, {r6(encoded('c', 0.1, 10.0), 'c_norm')}, {r6(encoded('gamma', 0.001, 1.0), 'gamma_norm')},
  CASE WHEN ind < 2 THEN 0 WHEN ind < 4 THEN 1 WHEN {u('kernel', 'search_id', 'ind')} < 0.5 THEN 0 ELSE 1 END::DOUBLE AS kernel_norm
FROM plain"""
    out["hp_encode"] = f"""
SELECT l_orderkey, l_linenumber, {r6(encoded('(l_quantity / 5.0::DOUBLE)', 0.1, 10.0), 'c_norm')},
  {r6(encoded('(0.001::DOUBLE + l_discount * 9.99::DOUBLE)', 0.001, 1.0), 'gamma_norm')},
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END::DOUBLE AS kernel_norm FROM lineitem"""
    out["hp_decode"] = f"""
SELECT l_orderkey, l_partkey, {r6(decoded('(l_quantity / 50.0::DOUBLE)', 0.1, 10.0), 'c')},
  {r6(decoded('(l_discount * 10.0::DOUBLE)', 0.001, 1.0), 'gamma')},
  CASE WHEN l_tax * 12.5::DOUBLE < 0.5 THEN 'linear' ELSE 'rbf' END AS kernel FROM lineitem"""
    first = ", ".join(r6(f"a * {g}_1 + (1 - a) * {g}_2", g) for g in GENES)
    second = ", ".join(r6(f"a * {g}_2 + (1 - a) * {g}_1", g) for g in GENES)
    both = ", ".join(f"x.{g} AS {g}_1, y.{g} AS {g}_2" for g in GENES)
    pair = ("p.search_id", "p.generation", "pair")
    out["arithmetic_crossover"] = select(
        f"""{SETTINGS},{PAIRS},
parents AS (
  SELECT p.search_id, p.generation, pair, {both},
    CASE WHEN {u('cross', *pair)} <= 0.7 THEN {u('blend', *pair)} ELSE 1 END AS a
  FROM pairs p
  JOIN settings x ON x.search_id = p.search_id AND x.generation = p.generation AND x.ind = p.parent1
  JOIN settings y ON y.search_id = p.search_id AND y.generation = p.generation AND y.ind = p.parent2)""",
        f"""SELECT search_id, generation, pair * 2 AS child, {first} FROM parents
UNION ALL SELECT search_id, generation, pair * 2 + 1, {second} FROM parents""",
    )
    moved = []
    for g in GENES:
        k = ("search_id", "generation", "ind", f"'{g}'")
        noisy = f"least(greatest({g} + {decay(0.1, 'generation', 20)} * {normal('noise', *k)}, 0), 1)"
        moved.append(r6(f"CASE WHEN {u('shake', *k)} < 0.1 THEN {noisy} ELSE {g} END", g))
    out["gaussian_mutation"] = select(
        SETTINGS, f"SELECT search_id, generation, ind AS child, {', '.join(moved)} FROM settings"
    )
    out["decay_schedule"] = f"""
SELECT event_id, {r6(decay(0.05, '(day(ts) - 1)', 30), 'flip_rate')},
  {r6(decay(0.1, '(day(ts) - 1)', 20), 'noise_std')} FROM events"""

    sections = [f"SELECT '1 dataset' AS section, '{n}' AS metric, ({e})::VARCHAR AS value FROM split" for n, e in {
        "total_samples": "count(*)", "positives": "sum(label)::BIGINT", "negatives": "sum(1 - label)::BIGINT",
        **{s: f"count(*) FILTER (WHERE split = '{s}')" for s in ("train", "val", "test")},
    }.items()]
    sections.append("SELECT '2 features', 'total_features', count(*)::VARCHAR FROM feature_index")
    for block in ("tfidf", "embedding", "categorical", "numeric", "readability"):
        sections.append(
            f"SELECT '2 features', '{block}', count(*) FILTER (WHERE block = '{block}')::VARCHAR FROM feature_index"
        )
    # the same feature SQL, over the labelled documents only
    labelled_only = block_ctes(TOKENS).replace("FROM documents", "FROM labelled_documents").replace(
        "JOIN documents d", "JOIN labelled_documents d"
    )
    out["run_summary"] = select(
        f"labelled_documents AS (SELECT d.* FROM documents d SEMI JOIN labels USING (doc_id)),{labelled_only},{SPLIT}",
        "\nUNION ALL ".join(sections),
    )
    return out
