"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

Emails, IP addresses, payment cards and phone numbers are found by pattern. What is protected are their single values
and, one step broader, their kinds and personal data as such. The words of texts that mention any of these, but for
those inside the patterns, are counted.

A term t discloses a value e as far as its pointwise mutual information with e comes near the information content of e
itself, ``log(p(t | e) / p(t)) / log(1 / p(e))``, over all different texts, so that copies of a document count once in
each part; values of fewer than ``SUPPORT`` texts say nothing by themselves and count in their kinds only. The same
ratio holds for a kind, written as ``1 - log(1 / p(e | t)) / log(1 / p(e))`` over all documents, with p(e | t) drawn
to p(e) as if ``PRIOR`` more documents with t were like all others; a kind takes terms of ``KIND_SUPPORT`` documents
that mention it, but for those that a single value accounts for. A term whose neighbouring words hardly change from one mention to the other is part of a copied
passage and gives nothing away: it needs as many different surroundings as its support, and ``VARIED`` of its documents.

A term whose disclosure reaches ``GENERALISE`` is replaced in all documents by the kind of what it gives away, or by
[PERSONAL] if that is more than one, and removed from ``REMOVE`` on.

Null texts are empty. Repeated rows get repeated results; rows of one doc_id with different texts are told apart by a
hash of both. Spans are code points, end exclusive. Matches that fail their check are dropped and not tried again
elsewhere. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, small, stash

KINDS = ("email", "ip", "card", "phone")
#: The patterns, with possessive runs and without inner starts that can't succeed: the matches are those of the plain forms.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What separates runs of digits: anything but a single space or hyphen.
CARD_GAP = r"[^0-9]{2,}|[^0-9\x20-]"
CARD_GUARD = r"[0-9](?:[\x20-]?[0-9]){12}"
TERM = r"\p{L}{3,}"
SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.9
KIND_SUPPORT, PRIOR, VARIED = 5, 5.0, 0.25
#: Stands for all kinds together.
PERSONAL = "personal"
_KEY = ["k1", "k2"]
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _walk(gaps: Column, values: Column, keep) -> Column:
    """Spans of ``values`` where each follows the gap of the same place; ``keep`` says which are wanted."""
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(F.coalesce(pair["gap"], F.lit("")))
        value = F.coalesce(pair["value"], F.lit(""))
        span = F.array(F.struct(begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value")))
        return F.struct((begin + F.length(value)).alias("at"), F.when(keep(value), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), values.alias("value")), start, step)["spans"]


def _matches(text: Column, pattern: str, guard: Column, keep) -> Column:
    found = _walk(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: (v != "") & keep(v))
    return F.when(guard, found).otherwise(_none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(place: Column) -> Column:
        d = F.substring(digits, -place, F.lit(1)).cast("int")
        return F.when(place % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def find(text: Column) -> dict[str, Column]:
    """The spans of each kind in a text."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip_ok = lambda v: F.forall(F.split(v, r"\."), lambda p: part(p).rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    phone_ok = lambda v: F.length(_digits(v)).between(9, 15)
    card_ok = lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(CARD_GAP), F.lit(0)))
    runs = _walk(gaps, F.split(text, CARD_GAP, -1), card_ok)

    def trimmed(s: Column) -> Column:
        """Only at the ends of the text can a separator stand beside the digits."""
        lead, trail = s["value"].rlike(r"^[\x20-]").cast("int"), s["value"].rlike(r"[\x20-]$").cast("int")
        return F.struct((s["start"] + lead).alias("start"), (s["end"] - trail).alias("end"), F.regexp_replace(s["value"], r"^[\x20-]|[\x20-]$", "").alias("value"))

    return {
        "email": _matches(text, EMAIL, text.contains("@"), lambda v: F.lit(True)),
        "ip": _matches(text, IP, text.rlike(r"[0-9]\.[0-9]"), ip_ok),
        "card": F.when(text.rlike(CARD_GUARD), F.transform(runs, trimmed)).otherwise(_none()),
        "phone": _matches(text, PHONE, text.contains("+"), phone_ok),
    }


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _surroundings(text: Column) -> Column:
    """The terms of a text in order, each with a hash of the words before and after it."""
    none = F.lit("")

    def of(words: Column) -> Column:
        around = lambda i: F.xxhash64(F.coalesce(F.get(words, i - 1), none), F.coalesce(F.get(words, i + 1), none))
        said = F.transform(words, lambda w, i: F.struct(w.alias("term"), around(i).alias("around")))
        return F.filter(said, lambda x: F.length(x["term"]) >= 3)

    # the words stand in an array of one, so that they are found once and not again for each of them
    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))), of)[0]


def _text_key(text: Column) -> Column:
    """The same for copies of a text, whatever their doc_id."""
    return F.struct(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))


def detect(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, k1, k2, spans (kind, start, end of the patterns), entities, what is said (terms, surroundings) beside them and text_key."""
    both = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.xxhash64(*both).alias("k1"), F.hash(*both).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    # the matches are stored first: otherwise each of their uses below would look for them again in all texts
    found = rows.select("doc_id", *_KEY, _text_key(F.col("text")).alias("text_key"), *(v.alias(k) for k, v in find(F.col("text")).items()))
    found = stash(found, "matches")

    def span_of(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def entity_of(kind: str):
        return lambda s: _entity(kind, s["value"])

    spans = F.concat(*(F.transform(k, span_of(k)) for k in KINDS))
    entities = F.array_distinct(F.concat(*(F.transform(k, entity_of(k)) for k in KINDS)))
    held = found.select("doc_id", *_KEY, spans.alias("spans"), entities.alias("entities"), "text_key")
    mentioning = stash(held.where(F.size("entities") > 0).select(*_KEY, "spans").dropDuplicates(_KEY), "mentioning")
    texts = rows.select(*_KEY, "text").join(small(mentioning), _KEY).dropDuplicates(_KEY)
    said = stash(texts.select(*_KEY, _surroundings(sanitised(F.col("text"), F.col("spans"), F.lit(" "))).alias("said")), "said")
    personal = stash(held.join(small(said), _KEY, "left"), "personal")
    drop(found, mentioning, said)
    return personal


def _varied(judged: DataFrame, mentions: DataFrame) -> DataFrame:
    """The rows of ``judged`` (entity, term, both, least, ...) whose terms have enough different surroundings in ``mentions`` (entity, said)."""
    wanted = stash(judged, "judged")
    pairs = small(stash(wanted.select("entity", "term"), "judged_pairs"))
    met = mentions.select("entity", F.inline("said")).join(pairs, ["entity", "term"]).distinct().groupBy("entity", "term").agg(F.count("*").alias("surroundings"))
    return wanted.join(met, ["entity", "term"]).where(F.col("surroundings") >= F.greatest("least", F.col("both") * VARIED))


def _of_values(docs: DataFrame, found: DataFrame, support: int, generalise: float) -> DataFrame:
    """entity, term and disclosure of the terms that give single values away."""
    total = found.select("text_key").distinct().count()
    mentioning = found.where(F.size("entities") > 0)
    entities = mentioning.select("text_key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n"))
    entities = stash(entities.where(F.col("n") >= support), "entities")
    once = stash(mentioning.dropDuplicates(["text_key"]).select("entities", "said", F.array_distinct("said.term").alias("terms")), "contexts")
    mentions = once.select(F.explode("entities").alias("entity"), "said", "terms").join(small(entities), "entity")
    pairs = mentions.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "n", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    # A term is in no fewer texts than mention an entity beside it: those that this alone rules out aren't counted further.
    near = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("near"))
    most = F.col("both") * F.pow(F.lit(max(total, 1)) / F.col("n"), F.lit(1 - generalise))
    pairs = pairs.join(near, "term").where(F.col("near") <= most * (1 + 1e-9)).drop("near").withColumn("least", F.lit(support))
    pairs = stash(_varied(pairs, mentions), "pairs")
    terms = stash(pairs.select("term").distinct(), "pair_terms")
    text = F.coalesce("text", F.lit(""))
    said = docs.select(_text_key(text).alias("text_key"), F.array_distinct(_terms(text)).alias("terms")).select("text_key", F.explode("terms").alias("term")).join(small(terms), "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    gain = F.log(F.col("both") / F.col("n") / (F.col("df") / F.lit(total)))
    ratio = F.when(F.col("n") < total, gain / F.log(F.lit(total) / F.col("n"))).otherwise(F.lit(0.0))
    return pairs.join(said, "term").select("entity", "term", ratio.alias("disclosure"))


def _of_kinds(docs: DataFrame, found: DataFrame, support: int) -> DataFrame:
    """entity (a kind, or PERSONAL), term and disclosure of the terms that give kinds of personal data away."""
    total = found.count()
    kinds = F.array_union(F.array_distinct(F.transform("spans", lambda s: s["kind"])), F.array(F.lit(PERSONAL)))
    mentions = stash(found.where(F.size("entities") > 0).select(F.explode(kinds).alias("entity"), "said"), "kinds")
    n = {r["entity"]: r["count"] for r in mentions.groupBy("entity").count().collect()}  # as many rows as there are kinds
    share = {e: c / total for e, c in n.items() if c < total}
    if not share:
        return found.limit(0).select(F.lit("").alias("entity"), F.lit("").alias("term"), F.lit(0.0).alias("disclosure"))
    prior = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("entity")]
    pairs = mentions.where(F.col("entity").isin(*share)).select("entity", F.explode(F.array_distinct("said.term")).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = stash(_varied(pairs.where(F.col("both") >= support).withColumn("least", F.lit(support)), mentions), "kind_pairs")
    terms = small(stash(pairs.select("term").distinct(), "kind_terms"))
    said = docs.select(F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("df"))
    likely = (F.col("both") + PRIOR * prior) / (F.col("df") + PRIOR)
    return pairs.join(said, "term").select("entity", "term", (1 - F.log(likely) / F.log(prior)).alias("disclosure"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, kind_support: int = KIND_SUPPORT) -> DataFrame:
    """Stored: entity, term, disclosure and action ('generalise' or 'remove') of the terms over the threshold."""
    values = stash(_of_values(docs, found, support, generalise).where(F.col("disclosure") >= generalise), "of_values")
    kinds = _of_kinds(docs, found, kind_support).where(F.col("disclosure") >= generalise).join(values.select("term"), "term", "left_anti")
    judged = values.unionByName(kinds)
    return stash(judged.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")), "disclosing")


def term_spans(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """k1, k2 and the spans (kind 'gone', or 'term-' and what it is generalised to; start, end) of disclosing terms in all documents."""
    kinds = F.collect_set(F.substring_index("entity", ":", 1))
    label = F.when(F.max(F.col("action") == "remove"), "gone").when(F.size(kinds) == 1, F.concat(F.lit("term-"), kinds[0])).otherwise(f"term-{PERSONAL}")
    marked = stash(disclosing.groupBy("term").agg(label.alias("label")), "marked_terms")
    both = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    rows = docs.select(F.xxhash64(*both).alias("k1"), F.hash(*both).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    said = rows.select(*_KEY, F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(small(marked), "term").distinct()
    wanted = stash(said.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "label"))).alias("all")), "wanted_terms")
    texts = rows.join(small(wanted), _KEY).dropDuplicates(_KEY)
    words = _walk(F.split("text", r"\p{L}+", -1), F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda v: F.map_contains_key("all", F.lower(v)))
    return texts.select(*_KEY, F.transform(words, lambda s: F.struct(F.col("all")[F.lower(s["value"])].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("term_spans"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, spans of the patterns and term_spans of every document."""
    found = detect(docs)
    disclosing = disclosing_terms(docs, found)
    added = term_spans(docs, disclosing)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.select("doc_id", *_KEY, "spans").join(added, _KEY, "left").withColumn("term_spans", F.coalesce("term_spans", none))


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined; disclosing terms are 'removed' or 'generalised'."""
    name = lambda s: F.when(s["kind"] == "gone", "removed").when(s["kind"].startswith("term-"), "generalised").otherwise(s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, instead: Column | None = None) -> Column:
    """The text with each span replaced by its class in brackets, by nothing, or by ``instead``; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        shown = instead if instead is not None else F.when(s["kind"] == "gone", "").otherwise(F.concat(F.lit("["), F.upper(F.replace(s["kind"], F.lit("term-"), F.lit(""))), F.lit("]")))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), shown)).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their personal data and disclosing terms replaced; all columns stay, a null text stays null."""
    both = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    spans = stash(find_spans(docs).where((F.size("spans") > 0) | (F.size("term_spans") > 0)).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.concat("spans", "term_spans").alias("__spans")).distinct(), "spans")
    keyed = docs.withColumns({"__k1": F.xxhash64(*both), "__k2": F.hash(*both)}).join(small(spans), ["__k1", "__k2"], "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("__spans")))
    return keyed.withColumn("text", text).select(*docs.columns)
