"""Free text against a catalog: keyword tags, similarity, the mapping ladder, search relaxation, presence in a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from cutline.functions import columns as C

#: Fixed values of the ladder.
LEAST, MARGIN, AMBIGUOUS, BOOK_EDGE = 0.55, 0.06, 0.70, 0.02


@pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts, for which Spark has no function."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Token overlap, string ratio and letters-only ratio, 0.35, 0.35 and 0.30; 0 if either has no token."""
    na, nb = C.normal_label(a), C.normal_label(b)
    ta, tb = C.label_tokens(a), C.label_tokens(b)
    letters = lambda x: F.regexp_replace(x, "[^A-Z0-9]", "")
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    blend = 0.35 * jaccard + 0.35 * sequence_ratio(na, nb) + 0.30 * sequence_ratio(letters(na), letters(nb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(blend)


def place_similarity(a: Column, b: Column) -> Column:
    """Token overlap and the letters' ratio of the tokens in order, half each: the order of words doesn't count."""
    ta, tb = C.label_tokens(a), C.label_tokens(b)
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    joined = lambda t: F.array_join(F.array_sort(t), "")
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(0.5 * jaccard + 0.5 * sequence_ratio(joined(ta), joined(tb)))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
#: Labels of one key that meet the catalog's rows of that key in one task.
SPLIT = 10_000


def _bag(text: Column) -> Column:
    """How often each of the usual letters occurs, and all others together."""
    counts = F.transform(F.array(*map(F.lit, _LETTERS)), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0), lambda x, y: x + y)))


def _at_most(bag: Column, other: Column) -> Column:
    """What the string ratio of two texts with these bags of letters can reach."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda m, n: m + n)
    return F.coalesce(F.try_divide(2 * total(F.zip_with(bag, other, lambda m, n: F.least(m, n))), total(bag) + total(other)), F.lit(1.0))


def _letters_only(normal: Column) -> Column:
    return F.regexp_replace(normal, "[^A-Z0-9]", "")


def _described(df: DataFrame, text: str, side: str) -> DataFrame:
    """A text's tokens, its normalised and its letters-only form, and the bags of letters of both."""
    forms = df.withColumns({f"__{side}t": C.label_tokens(F.col(text)), f"__{side}f": C.normal_label(F.col(text))}).withColumn(f"__{side}o", _letters_only(F.col(f"__{side}f")))
    return forms.withColumns({f"__{side}n": _bag(F.col(f"__{side}f")), f"__{side}b": _bag(F.col(f"__{side}o"))})


def _keys(side: str) -> Column:
    """What two texts share if their blend reaches ``LEAST - MARGIN``: a token, or two letters in a row of one form, or a letter of a short form."""

    def runs(form: str, mark: str) -> Column:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(form, i, F.lit(n))))
        none = F.array().cast("array<string>")
        return F.concat(F.when(F.length(form) > 1, cut(2)).otherwise(none), F.when(F.length(form).between(1, 4), cut(1)).otherwise(none))

    return F.array_distinct(F.concat(F.transform(f"__{side}t", lambda t: F.concat(F.lit("t^"), t)), runs(f"__{side}f", "n^"), runs(f"__{side}o", "o^")))


def _by_keys(texts: DataFrame, text: str, side: str) -> DataFrame:
    sizes = [F.size(f"__{side}t").alias(f"{side}_t"), F.length(f"__{side}f").alias(f"{side}_n"), F.length(f"__{side}o").alias(f"{side}_o")]
    return texts.select(text, F.explode(_keys(side)).alias("__key"), *sizes)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of texts with a common key; the left rows of a frequent key are dealt out, the right ones go to each part.

    Sizes rule out pairs before they are made: they bound the shared tokens and both ratios. A pair without a common
    token is met by the form whose ratio is over 0.75.
    """
    parts = left.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("__key", F.ceil(F.col("n") / SPLIT).cast("int").alias("__parts"))
    dealt = left.join(parts, "__key", "left").withColumn("__part", F.pmod(F.xxhash64("__l"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = right.join(parts, "__key", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    of = lambda f, c: f(f"l_{c}", f"r_{c}")
    ratio = {c: 2.0 * of(F.least, c) / (F.col(f"l_{c}") + F.col(f"r_{c}")) for c in "no"}
    blend = 0.35 * of(F.least, "t") / of(F.greatest, "t") + 0.35 * ratio["n"] + F.coalesce(0.30 * F.try_divide(2.0 * of(F.least, "o"), F.col("l_o") + F.col("r_o")), F.lit(0.30))
    alone = (LEAST - MARGIN) / 0.65 - 1e-9
    kind = F.left("__key", F.lit(1))
    fits = F.when(kind == "t", blend >= LEAST - MARGIN - 1e-9).when(kind == "n", ratio["n"] >= alone).otherwise(ratio["o"] >= alone)
    return dealt.join(copied, ["__key", "__part"]).where(fits).select("__l", "__r").distinct()


def fuzzy_best(labels: DataFrame, label_key: str, label: str, catalog: DataFrame, code: str, name: str, place: str | None = None) -> DataFrame:
    """The best catalog code of each label with its score and whether another code comes within the margin.

    With ``place``, a column of both sides, the score is the names' similarity times the places'. Scores under
    ``LEAST - MARGIN`` count as none: best is null and the score 0. Labels that are equal are scored once. Texts meet by
    keys, at every size of the catalog: a blend of 0.49 without a common token takes a string ratio over 0.75 of the
    normalised or of the letters-only form; two such forms have two letters in a row in common, or, having two matching
    letters at most, five characters together, which leaves no form of over three. Of the pairs that meet, those are
    scored that lengths, shared tokens and bags of letters let reach ``LEAST - MARGIN``, which rules out no other pair.
    """
    least = LEAST - MARGIN
    places = [place] if place else []
    cleaned = labels.select(label_key, F.regexp_replace(label, r"\[[^\]]*\]", " ").alias("__l"), *(F.col(p).alias("__at") for p in places))
    left = _described(cleaned.select("__l").distinct(), "__l", "l")
    right = catalog.select(code, F.coalesce(name, F.lit("")).alias("__r"), *(F.col(p).alias("__place") for p in places)).distinct()
    names = _described(right.select("__r").distinct(), "__r", "r")
    met = _met(_by_keys(left, "__l", "l"), _by_keys(names, "__r", "r"))
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("__lt", "__rt")), F.size(F.array_union("__lt", "__rt"))), F.lit(0.0))
    may = 0.35 * jaccard + 0.35 * _at_most(F.col("__ln"), F.col("__rn")) + 0.30 * _at_most(F.col("__lb"), F.col("__rb")) >= least - 1e-9
    pairs = met.join(left, "__l").join(names, "__r").where(may).select("__l", "__r")
    alike = pairs.withColumn("__s", similarity(F.col("__l"), F.col("__r"))).where(F.col("__s") >= least)
    asked = cleaned.select("__l", *(["__at"] if place else [])).distinct()
    scored = alike.join(right, "__r").join(asked, "__l")
    score = F.col("__s") * place_similarity(F.col("__at"), F.col("__place")) if place else F.col("__s")
    same = ["__l", *(["__at"] if place else [])]
    scored = scored.withColumn("score", score).where(F.col("score") >= least).groupBy(*same, code).agg(F.max("score").alias("score"))
    order = Window.partitionBy(*same).orderBy(F.desc("score"), code)
    ranked = scored.select(*same, code, "score", F.row_number().over(order).alias("n"), F.coalesce(F.lead("score").over(order), F.lit(0.0)).alias("second")).where("n = 1")
    found = ranked.select(*(F.col(c).alias(f"{c}_") for c in same), F.col(code).alias("best"), "score", ((F.col("score") - F.col("second")) < MARGIN).alias("ambiguous"))
    on = F.col("__l") == F.col("__l_")
    if place:
        on = on & F.col("__at").eqNullSafe(F.col("__at_"))
    best = cleaned.distinct().join(found, on, "left")
    # a key with several labels takes the best of them
    top = best.groupBy(label_key).agg(F.max_by(F.struct("best", "score", "ambiguous"), F.struct(F.coalesce("score", F.lit(0.0)), "best")).alias("top"))
    return top.select(label_key, "top.best", F.coalesce("top.score", F.lit(0.0)).alias("score"), F.coalesce("top.ambiguous", F.lit(False)).alias("ambiguous"))


def exact_lookup(entries: DataFrame, key: Column, code: str) -> DataFrame:
    """Normalised keys with one distinct code; ambiguous keys are left out."""
    grouped = entries.select(key.alias("key"), code).groupBy("key").agg(F.collect_set(code).alias("__c"))
    return grouped.where(F.size("__c") == 1).select("key", F.element_at("__c", 1).alias("found"))


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """alias_text and course_code; a text with several codes takes that of the highest alias_id."""
    return aliases.groupBy("alias_text").agg(F.max_by("course_code", "alias_id").alias("course_code"))


def mapping_ladder(columns: DataFrame, catalog: DataFrame, aliases: DataFrame, book: DataFrame) -> DataFrame:
    """The first rung that holds: printed code, exact book name, alias, track variant, fuzzy book or catalog, none.

    columns: column_key, raw_label, code; catalog: course_code, name; aliases: alias_id, alias_text, course_code;
    book: code, name and, if its names hold at several places, university: then a label's last parenthetical is its
    university, and labels without one match no book row loosely. Returns column_key, suggested, confidence, source.
    """
    c = columns.select("column_key", F.coalesce("raw_label", F.lit("")).alias("label"), F.col("code").alias("printed"))
    codes = catalog.select(F.col("course_code").alias("__code")).distinct()
    norm = C.normal_label(F.col("label"))
    exact = exact_lookup(book, C.normal_label(F.col("name")), "code")
    base = exact_lookup(book, C.normal_label(F.col("name")), "code").select(F.col("key").alias("base_key"), F.col("found").alias("base_found"))
    alias = alias_lookup(aliases)
    if "university" in book.columns:
        split = c.withColumn("__s", C.last_parenthetical(F.col("label"))).select("column_key", F.col("__s.base").alias("label"), F.col("__s.inner").alias("university"))
        loose = fuzzy_best(split, "column_key", "label", book, "code", "name", "university")
    else:
        loose = fuzzy_best(c, "column_key", "label", book, "code", "name")
    fuzzy_book = loose.select("column_key", F.col("best").alias("book_code"), F.col("score").alias("book_score"), F.col("ambiguous").alias("book_ambiguous"))
    fuzzy_catalog = fuzzy_best(c, "column_key", "label", catalog, "course_code", "name").select("column_key", F.col("best").alias("cat_code"), F.col("score").alias("cat_score"), F.col("ambiguous").alias("cat_ambiguous"))

    def known(column: str, flag: str, df: DataFrame) -> DataFrame:
        return df.join(codes.select(F.col("__code").alias(column), F.lit(True).alias(flag)), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    out = c.withColumn("key", norm).withColumn("base_key", C.normal_label(C.without_variant(F.col("label"))))
    out = out.join(exact, "key", "left").join(base, "base_key", "left")
    by_label = alias.select(F.trim("alias_text").alias("__t"), F.col("course_code").alias("alias_a"))
    by_code = alias.select(F.col("alias_text").alias("printed"), F.col("course_code").alias("alias_b"))
    out = out.withColumn("__t", F.trim("label")).join(by_label, "__t", "left").join(by_code, "printed", "left").withColumn("alias_code", F.coalesce("alias_a", "alias_b"))
    out = out.join(fuzzy_book, "column_key", "left").join(fuzzy_catalog, "column_key", "left")
    for column, flag in (("printed", "k_printed"), ("found", "k_found"), ("alias_code", "k_alias"), ("base_found", "k_base"), ("book_code", "k_book")):
        out = known(column, flag, out)
    rung = lambda code, confidence, source: F.struct(code.alias("suggested"), F.round(confidence, 3).alias("confidence"), F.lit(source).alias("source"))
    one = F.lit(1.0)
    book_conf = F.when(F.col("book_ambiguous"), F.least("book_score", F.lit(AMBIGUOUS))).otherwise(F.col("book_score"))
    cat_conf = F.when(F.col("cat_ambiguous"), F.least("cat_score", F.lit(AMBIGUOUS))).otherwise(F.col("cat_score"))
    prefer_book = (F.col("book_score") >= LEAST) & (F.col("book_score") >= F.coalesce("cat_score", F.lit(0.0)) - BOOK_EDGE)
    variant = F.col("printed").isNull() & F.col("label").rlike(r"\s*-\s*[A-Z]\b") & F.col("k_base")
    step = (
        F.when(F.col("k_printed"), rung(F.col("printed"), one, "code"))
        .when(F.col("found").isNotNull() & F.col("k_found"), rung(F.col("found"), one, "book"))
        .when(F.col("found").isNotNull(), rung(F.col("found"), F.lit(0.99), "book_new"))
        .when(F.col("k_alias"), rung(F.col("alias_code"), one, "alias"))
        .when(variant, rung(F.col("base_found"), F.lit(0.95), "book_variant"))
        .when(prefer_book & F.col("k_book"), rung(F.col("book_code"), book_conf, "book"))
        .when(prefer_book, rung(F.col("book_code"), F.least(book_conf, F.lit(0.9)), "book_new"))
        .when(F.col("cat_score") >= LEAST, rung(F.col("cat_code"), cat_conf, "name"))
    )
    return out.withColumn("step", step).select("column_key", "step.suggested", "step.confidence", "step.source")


#: Words that say nothing about a name, and abbreviations with what they stand for.
NOISE = ("OF", "THE", "AND", "SRI", "LANKA", "UNIVERSITY", "A", "B")
ABBREVIATIONS = {"BIO": "BIOLOGICAL", "SC": "SCIENCE", "PHY": "PHYSICAL", "TECH": "TECHNOLOGY"}


def significant_words(text: Column, noise: Sequence[str] = NOISE, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """The distinct upper-case words of a text without noise, abbreviations spelled out."""
    full = F.create_map(*(F.lit(x) for kv in abbreviations.items() for x in kv))
    words = F.filter(F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]+"), F.lit(0)), lambda w: ~w.isin(*noise))
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w)))


def verify_codes(codes: DataFrame, catalog: DataFrame, headers: DataFrame) -> DataFrame:
    """Printed codes (page, code) that nothing supports: page, code, reason.

    catalog: code, name; headers: page, text. A code that the catalog lacks is unknown; one is unsupported if no header
    of its page holds all significant words of its name. Names without any fit every page that has a header.
    """
    names = catalog.groupBy("code").agg(F.max_by(significant_words(F.col("name")), "name").alias("words"))
    known = codes.select("page", "code").distinct().join(names, "code", "left")
    said = headers.select("page", F.array_sort(significant_words(F.col("text"))).alias("said")).distinct()
    held = known.where("words IS NOT NULL").join(said, "page").where(F.size(F.array_except("words", "said")) == 0).select("page", "code").distinct().withColumn("held", F.lit(True))
    reason = F.when(F.col("words").isNull(), "unknown").when(F.col("held").isNull(), "unsupported")
    return known.join(held, ["page", "code"], "left").select("page", "code", reason.alias("reason")).where("reason IS NOT NULL")


def claims(label: Column, keywords: Sequence[tuple[str, str]], open_pattern: str) -> Column:
    """struct(codes, is_open) of the bracketed tags of a label; keywords are patterns with their codes."""
    tags = F.regexp_extract_all(label, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    is_open = F.exists(tags, lambda t: F.rlike(t, F.lit(f"(?i){open_pattern}")))
    closed = F.filter(tags, lambda t: ~F.rlike(t, F.lit(f"(?i){open_pattern}")))
    codes = F.array_compact(F.array(*(F.when(F.exists(closed, _has(p)), F.lit(c)) for p, c in keywords)))
    return F.struct(codes.alias("codes"), F.coalesce(is_open, F.lit(False)).alias("is_open"))


def _has(pattern: str):
    return lambda t: F.rlike(t, F.lit(f"(?i){pattern}"))


def disjoint_claims(columns: DataFrame, group: str, codes: str, is_open: str, universe: Sequence[str]) -> DataFrame:
    """Open members get the universe without what their group's other members claim: rows with column ``streams``."""
    taken = columns.where(~F.col(is_open)).groupBy(group).agg(F.array_distinct(F.flatten(F.collect_list(codes))).alias("__t"))
    pool = F.array(*map(F.lit, universe))
    rest = F.array_except(pool, F.coalesce("__t", F.array().cast("array<string>")))
    return columns.join(taken, group, "left").withColumn("streams", F.when(F.col(is_open), rest).otherwise(F.col(codes))).drop("__t")


def keyword_tags(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Sorted distinct tags whose keyword occurs in the text."""
    hits = [F.when(C.keyword_hit(text, word), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for word, tags in rules]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))


def relaxed_search(rows: DataFrame, text: str, query: str, key: str, abbreviations: dict[str, str] | None = None, most: int = 20) -> DataFrame:
    """All terms; or else, of three and more, all but one in turn; or else single terms of over three letters.

    The stage of each row is a column, the least stage that any row reaches is kept: one pass over the rows.
    """
    expanded = (abbreviations or {}).get(query.strip().upper(), query)
    terms = [x for x in expanded.replace(",", " ").split() if len(x) > 1]
    has = [F.ilike(F.col(text), F.lit(f"%{x}%")) for x in terms]
    stages = [C.all_of(*has)] if terms else []
    if len(terms) >= 3:
        stages += [C.all_of(*(h for i, h in enumerate(has) if i != skip)) for skip in range(len(has))]
    stages += [h for h, x in zip(has, terms, strict=True) if len(x) > 3]
    stage = F.lit(None).cast("int")
    for i in reversed(range(len(stages))):
        stage = F.when(stages[i], i).otherwise(stage)
    staged = rows.withColumn("stage", stage).where("stage IS NOT NULL")
    first = staged.agg(F.min("stage").alias("__first"))
    return staged.join(first, F.col("stage") == F.col("__first"), "left_semi").orderBy(key).limit(most)


def present_in(entries: DataFrame, code: str, name: str, text: str, least: int = 4) -> DataFrame:
    """Flag entries whose code (as a word) or name (without parentheses) stands in a text, read forward or backward."""
    raw = C.normal_label(F.lit(text))
    plain = C.normal_label(C.without_parentheses(F.lit(text)))
    base = C.normal_label(C.without_parentheses(F.col(name)))
    seen = F.lit(False)
    for body in (raw, plain, F.reverse(raw), F.reverse(plain)):
        by_code = F.regexp_like(body, F.concat(F.lit(r"\b\Q"), F.upper(code), F.lit(r"\E\b")))
        seen = seen | by_code | ((F.length(base) >= least) & body.contains(base))
    return entries.withColumn("present", F.coalesce(seen, F.lit(False)))


def trusted_first(results: DataFrame, url: str, source: str, position: str, trusted: Sequence[str], home: Sequence[str], top: int = 7) -> DataFrame:
    """Dedupe by URL in order of source and position; trusted hosts score 2, home suffixes 1; the best ``top`` in order."""
    order = Window.partitionBy(url).orderBy(source, position)
    first = results.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    h = C.host(F.col(url))
    is_trusted = C.any_of(*((h == x) | h.endswith("." + x) for x in trusted))
    score = F.when(is_trusted, 2).when(C.any_of(*(h.endswith(x) for x in home)), 1).otherwise(0)
    return first.withColumn("score", score).orderBy(F.desc("score"), source, position).limit(top)
