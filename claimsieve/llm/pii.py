"""Replace personal data and secrets by surrogates of the same kind.

Mentions are found by one pattern. Each distinct entity gets one surrogate, drawn by a keyed hash: mail
addresses, numbers and keys keep length, case, separators and check digit, addresses stay valid, names keep
title, gender, script, initials, particles and number of parts. Mentions of one entity, also in another case or
punctuation, get one surrogate; a surrogate that two entities share, or that is itself an entity of the table, is
drawn again. Given and family names are entities of their own, so a short mention keeps the family of the long one.

Everything is DataFrame code; the executors run no Python.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import null_safe, packed, text_or_empty, unpacked
from claimsieve.operators.layout import reliable

#: What stands before a name, and the gender it tells ("n": none).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Doña", "Madame", "Mme", "Госпожа"),
    "m": ("Mr", "Sir", "Herr", "Señor", "Don", "Monsieur", "Господин"),
    "n": ("Dr", "Doctor", "Prof", "Professor"),
}
GAP = r"[ \u00A0]"
TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + r")(?!\p{L})"
INITIAL = rf"\p{{Lu}}(?:\.|(?={GAP}))"
#: Small words that belong to the family name after them.
PARTICLES = rf"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|ter|zu|zur){GAP}){{0,4}}"
#: One given or family name: inner capitals, hyphens and apostrophes belong to it, a title and a final 's do not.
PART = rf"(?!{TITLE}){PARTICLES}(?:[dD]['’]|al-|el-)?\p{{Lu}}(?:['’](?=\p{{Lu}}))?[\p{{L}}\p{{M}}]+(?:(?:-|['’](?!s(?!\p{{L}})))\p{{L}}[\p{{L}}\p{{M}}]*){{0,9}}"
LED_PART = rf"(?:{INITIAL}{GAP}?){{0,9}}{PART}"
#: A name has at most 64 parts: the matcher goes one call deeper for each, so a heading of any length must end.
#: kind, pattern; an earlier one wins where two match at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}",
    "secret": r"AKIA[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|password[=:]\"?[^\s\"',;]{6,}+|(?:token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_+/=-]{16,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,14}(?![0-9])",
    "name": rf"{TITLE}\.?{GAP}{LED_PART}(?:{GAP}{LED_PART}){{0,63}}",
}
GIVEN = {
    ("Latn", "f"): "Anna Clara Elena Greta Ines Julia Laura Maria Nora Olga Paula Rosa Sara Teresa Vera Lucia".split(),
    ("Latn", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Marco Oscar Paul Simon Tomas Victor".split(),
    ("Cyrl", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("Cyrl", "m"): "Антон Борис Виктор Иван Максим Олег Павел Роман".split(),
}
SYLLABLES = {"Latn": "ba de fi go la me ni ro sa te vi zu kar len mor tan".split(), "Cyrl": "ба де ви го ла ме ни ро са те кар лен мор тан".split()}
#: Mentions start where no letter or digit stands before, so most places of a text are passed at once.
EVERY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A text without any of this has no mention; far cheaper than the patterns.
HINT = rf"[0-9@]|(?<!\p{{L}}){TITLE}\.?{GAP}\p{{L}}|password|token|secret|api_key|gh[pousr]_|sk-"
#: What comes before a secret and stays.
SECRET_HEAD = r"^(?:password[=:]\"?|(?:token|secret|api_key) ?[=:] ?\"?)"
DIGIT_KINDS = ("card", "phone", "ssn")
NAME_KINDS = ("given", "family")
TITLE_HEAD = rf"^\p{{L}}+\.?{GAP}"
CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")


def kind_of(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("secret"))


def essence(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common; names are taken apart by :func:`name_parts` instead."""
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(mention, r"[^0-9]", ""))
        .when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.regexp_replace(mention, SECRET_HEAD, ""))
        .otherwise(mention)
    )


def name_parts(mention: Column) -> Column:
    """array of (kind, core, head, form): the parts of a name in order; ``head`` is what stands before a part and stays.

    The last part is the family name. ``form`` is the part as it stands in the text, without its particles.
    """
    titled = F.regexp_extract(mention, TITLE_HEAD, 0)
    units = F.regexp_extract_all(F.regexp_replace(mention, TITLE_HEAD, ""), F.lit(rf"(?:{PART}|{INITIAL}){GAP}?"), F.lit(0))

    def one(unit: Column, i: Column) -> Column:
        word = F.regexp_replace(unit, rf"{GAP}$", "")
        before = F.when(i == 0, titled).otherwise(F.regexp_extract(F.get(units, i - 1), rf"{GAP}$", 0))
        particles = F.regexp_extract(word, rf"^{PARTICLES}", 0)
        kind = F.when(word.rlike(r"^\p{Lu}\.?$"), "initial").when(i == F.size(units) - 1, "family").otherwise("given")
        core = F.regexp_replace(F.lower(word), "’", "'")
        form = F.substring(word, F.length(particles) + 1, F.length(word))
        return F.struct(kind.alias("kind"), core.alias("core"), F.concat(before, particles).alias("head"), form.alias("form"))

    return F.transform(units, one)


def gender_of(mention: Column) -> Column:
    title = F.regexp_extract(mention, r"^\p{L}+", 0)
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m")


def draw(seed: Column, at, size: int) -> Column:
    return F.pmod(F.xxhash64(seed, at if isinstance(at, Column) else F.lit(at)), F.lit(size)).cast("int")


def letter(alphabet: str, seed: Column, at: Column) -> Column:
    return F.substring(F.lit(alphabet), draw(seed, at, len(alphabet)) + 1, F.lit(1))


def reshaped(text: Column, seed: Column) -> Column:
    """Each digit, small and capital letter by another of its kind; all else stays."""
    hexadecimal = text.rlike("^[0-9a-f]+$") & text.rlike("[a-f]")

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(hexadecimal, letter("0123456789abcdef", seed, i))
            .when(c.rlike("[0-9]"), letter("0123456789", seed, i))
            .when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz", seed, i))
            .when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, doubled at every second place from the right, beginning with the last but one."""
    values = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    n = F.size(values)

    def one(v: Column, i: Column) -> Column:
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((n - i) % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.transform(values, one), F.lit(0), lambda a, b: a + b)


def with_check_digit(original: Column, drawn: Column) -> Column:
    """``drawn`` with a valid last digit where the original number has one."""
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.pmod(10 - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(luhn_sum(original) % 10 == 0, F.concat(head, last.cast("string"))).otherwise(drawn)


def name_surrogate(kind: Column, core: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """A made-up family name, or a given name of the gender; every attempt beyond the first adds to the length."""

    def sounds(script: str, tag: str, least: int) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        numbers = F.sequence(F.lit(1), F.lit(least) + attempt)
        return F.array_join(F.transform(numbers, lambda i: F.get(parts, draw(seed, F.concat(F.lit(tag), i), len(SYLLABLES[script])))), "")

    def given(script: str) -> Column:
        def listed(sex: str) -> Column:
            names = GIVEN[script, sex]
            return F.get(F.array(*map(F.lit, names)), draw(seed, "given", len(names)))

        ends = {"f": "ra", "m": "n"} if script == "Latn" else {"f": "ра", "m": "н"}
        more = F.initcap(F.concat(sounds(script, "given", 2), F.when(gender == "f", ends["f"]).when(gender == "m", ends["m"]).otherwise("")))
        return F.when((attempt > 0) | gender.isNull(), more).when(gender == "f", listed("f")).otherwise(listed("m"))

    def family(script: str) -> Column:
        first, second = (F.initcap(sounds(script, tag, 4)) for tag in ("family", "second"))
        return F.when(core.contains("-"), F.concat_ws("-", first, second)).otherwise(first)

    def person(script: str) -> Column:
        return F.when(kind == "given", given(script)).otherwise(family(script))

    return F.when(core.rlike(r"\p{IsCyrillic}"), person("Cyrl")).otherwise(person("Latn"))


def initial(form: Column, key: str) -> Column:
    """An initial by another letter: the alphabet moved on by a step of the key, so different ones stay different."""
    out = form
    for number, letters in enumerate(CAPITALS):
        step = F.pmod(F.xxhash64(F.sha2(F.lit(f"{key}\x1f{number}"), 256)), F.lit(len(letters) - 1)) + 1
        at = F.instr(F.lit(letters), F.substring(form, 1, 1))
        moved = F.substring(F.lit(letters), (F.pmod(at - 1 + step, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        out = F.when(at > 0, F.concat(moved, F.substring(form, F.lit(2), F.length(form)))).otherwise(out)
    return out


def surrogate(kind: Column, core: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """The surrogate of an entity's essence, in the same form."""
    tld = F.regexp_extract(core, r"\.[a-z]+$", 0)
    body = F.substring(core, F.lit(1), F.length(core) - F.length(tld))
    ip = F.concat_ws(".", (draw(seed, 0, 223) + 1).cast("string"), *[draw(seed, i, 256).cast("string") for i in (1, 2, 3)])
    mark = F.when(core.rlike("^AKIA"), F.lit(4)).when(core.rlike("^(?:gh[pousr]_)"), F.lit(4)).when(core.rlike("^sk-"), F.lit(3))
    mark = F.coalesce(mark, F.lit(0))
    key = F.concat(F.substring(core, F.lit(1), mark), reshaped(F.substring(core, mark + 1, F.length(core)), seed))
    country = F.concat(F.substring(core, 1, 2), reshaped(F.substring(core, F.lit(3), F.length(core)), seed))
    return (
        F.when(kind == "email", F.concat(reshaped(body, seed), tld))
        .when(kind == "ip", ip)
        .when(kind == "card", with_check_digit(core, reshaped(core, seed)))
        .when(kind.isin("phone", "ssn"), F.concat(F.substring(core, 1, 1), reshaped(F.substring(core, F.lit(2), F.length(core)), seed)))
        .when(kind == "iban", country)
        .when(kind.isin(*NAME_KINDS), name_surrogate(kind, core, gender, seed, attempt))
        .otherwise(key)
    )


def rendered(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the form of one mention: its separators, its case."""
    separators = F.split(mention, "")

    def digit(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(made, nth, F.lit(1))).otherwise(c)

    return (
        F.when(kind.isin(*DIGIT_KINDS), F.array_join(F.transform(separators, digit), ""))
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(made))
        .when(kind.isin(*NAME_KINDS) & (F.length(mention) > 1) & (mention == F.upper(mention)), F.upper(made))
        .when((kind == "iban") & mention.contains(" "), F.trim(F.regexp_replace(made, "(.{4})", "$1 ")))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, SECRET_HEAD, 0), made))
        .otherwise(made)
    )


def mentions_of(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0)))


def drawn(entities: DataFrame, key: str) -> DataFrame:
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "core", F.col("attempt").cast("string")), 256)
    # a column of its own: inside the lambdas of the surrogate the digest would be computed per letter
    rows = entities.withColumn("seed", seed)
    return rows.withColumn("made", surrogate(*map(F.col, ("kind", "core", "gender", "seed", "attempt")))).drop("seed")


def surrogate_table(entities: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """(kind, core, gender, attempt, made): one surrogate per distinct entity, all different, none itself an entity.

    ``entities`` has kind and core, for given names also gender (f, m or null). Of entities that drew one surrogate
    the first keeps it, the others draw again. Names grow with the attempt, so their space never ends; a kind of a
    fixed form stops the run if collisions are left after ``rounds`` rounds.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    # given and family names are one space: no made name is a real one of either kind
    space = F.when(F.col("kind").isin(*NAME_KINDS), "name").otherwise(F.col("kind"))
    plain = F.when(F.col("kind").isin(*NAME_KINDS), F.lower("made")).otherwise(F.col("made"))
    real = reliable(entities.select(space.alias("r_space"), F.col("core").alias("r_core")).distinct())
    table = reliable(drawn(entities.select("kind", "core", "gender", F.lit(0).alias("attempt")), key))
    for _ in range(rounds):
        shared = table.groupBy(space.alias("s_space"), F.col("made").alias("s_made")).agg(
            F.min(F.struct("kind", "core")).alias("winner"), F.count(F.lit(1)).alias("n")
        )
        shared = shared.filter("n > 1").drop("n")
        rows = table.withColumns({"space": space, "as_core": plain})
        checked = rows.join(shared, (F.col("space") == F.col("s_space")) & (F.col("made") == F.col("s_made")), "left")
        checked = checked.join(real, (F.col("space") == F.col("r_space")) & (F.col("as_core") == F.col("r_core")), "left")
        again = (F.col("winner").isNotNull() & (F.col("winner") != F.struct("kind", "core"))) | F.col("r_core").isNotNull()
        checked = reliable(checked.select("kind", "core", "gender", "attempt", "made", again.alias("again")))
        if not checked.filter("again").take(1):
            return table
        fresh = drawn(checked.filter("again").select("kind", "core", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        table = reliable(checked.filter(~F.col("again")).drop("again").unionByName(fresh))
    raise ValueError("surrogates still collide; the space of one kind is too small for its entities")


def mapping_key(docs: DataFrame) -> str:
    """The session's ``claimsieve.surrogate.key``; without one a fresh random key, so no key is public."""
    return docs.sparkSession.conf.get("claimsieve.surrogate.key", None) or secrets.token_hex(32)


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities long and kinds string.

    ``key`` is the secret of the mapping: same key and same table, same surrogates (see :func:`mapping_key` for none).
    Texts without a mention, empty and null texts stay as they are (null stays null). ``kinds`` lists the distinct
    kinds, sorted and joined by commas, empty without a mention; ``n_entities`` counts mentions. Rows that share
    doc_id and text share their result. Columns of ``docs`` that carry the names of the added columns are replaced,
    all others stay, whatever their names.
    """
    key = key or mapping_key(docs)
    text = text_or_empty(docs)
    found = docs.select(F.col("doc_id").alias("l_id"), F.xxhash64(text).alias("l_check"), mentions_of(text).alias("found"))
    found = found.filter(F.size("found") > 0)
    found = found.select("l_id", "l_check", F.posexplode_outer("found").alias("nth", "mention"))
    found = found.withColumn("says", kind_of(F.col("mention")))
    whole = F.array(
        F.struct(
            F.col("says").alias("kind"), essence(F.col("says"), F.col("mention")).alias("core"),
            F.lit("").alias("head"), F.col("mention").alias("form"),
        )
    )
    found = found.withColumn("gender", F.when(F.col("says") == "name", gender_of(F.col("mention"))))
    parts = F.when(F.col("says") == "name", name_parts(F.col("mention"))).otherwise(whole)
    found = found.select("l_id", "l_check", "nth", "says", "gender", F.posexplode_outer(parts).alias("part", "of"))
    found = reliable(found.select("l_id", "l_check", "nth", "says", "gender", "part", "of.*"))

    entities = found.filter("kind != 'initial'").groupBy("kind", "core").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    sure = (F.col("kind") == "given") & (F.col("low") == F.col("high"))  # a name with titles of both genders tells none
    table = surrogate_table(entities.select("kind", "core", F.when(sure, F.col("low")).alias("gender")), key)
    table = table.select(F.col("kind").alias("t_kind"), F.col("core").alias("t_core"), "made")
    found = found.join(table, (F.col("kind") == F.col("t_kind")) & (F.col("core") == F.col("t_core")), "left")
    new = F.when(F.col("kind") == "initial", initial(F.col("form"), key)).otherwise(rendered(F.col("kind"), F.col("form"), F.col("made")))
    found = found.withColumn("new", F.concat("head", new))
    lists = found.groupBy("l_id", "l_check").agg(F.collect_set(F.struct("nth", "part", "new", "says")).alias("news"))

    own = ("n_entities", "kinds")
    rest = [c for c in docs.columns if c not in own]
    rows = docs.select(packed(docs, rest), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_check"))
    rows = rows.join(lists, null_safe(rows, lists, [("own_id", "l_id"), ("own_check", "l_check")]), "left")
    # the text between mentions and the surrogates, in order: piece i stands before mention i
    between = F.transform(
        F.split(F.col("row.text"), EVERY, -1), lambda p, i: F.struct(i.alias("nth"), F.lit(-1).alias("part"), p.alias("new"))
    )
    made = F.transform("news", lambda x: F.struct(x.nth.alias("nth"), x.part.alias("part"), x.new.alias("new")))
    joined = F.array_join(F.transform(F.array_sort(F.concat(between, made)), lambda x: x.new), "")
    text = F.when(F.col("news").isNotNull(), joined).otherwise(F.col("row.text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col("news.says"), F.array().cast("array<string>")))), ",")
    n_entities = F.greatest(F.size(F.filter("news", lambda x: x.part == 0)), F.lit(0)).cast("long")
    rows = rows.select("row", F.struct(text.alias("text"), n_entities.alias("n_entities"), kinds.alias("kinds")).alias("made"))
    return rows.select(*unpacked(rest, {"text": F.col("made.text")}), "made.n_entities", "made.kinds")
