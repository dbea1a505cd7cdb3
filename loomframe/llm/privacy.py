"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Emails, IP addresses, card and phone numbers are found by pattern with their places. Each value is a protected entity.
All words of the texts that hold an entity, but those of entities, are candidate terms. How strongly a term discloses an
entity is estimated by co-occurrence over the whole corpus, in bits: an entity's information content is -log2 P(entity),
a term tells log2 (P(entity | term) / P(entity)) of it, and -log2 P(entity | term) stays unknown. P(entity | term) is
(together + weight * P(entity)) / (texts + weight), both counted in distinct whole texts: the share of the texts with the
term that hold the entity too, smoothed towards the entity's share of all texts, which counts as ``weight`` further texts.
It never exceeds 1, so no more than the whole content is told. A term that leaves at most ``LEFT`` = 1 bit of some entity
unknown (a strength of ``GENERALISE`` = 1/2 or more) is a span of its own everywhere in the corpus and gives way to its
class; one that leaves at most 0.15 bit (``REMOVE`` = 0.9) is cut out.

Terms are counted before anything is joined to them, so a term too common for the entities of its text meets none of
them. Entities that occur in the same texts are as strongly disclosed by any term, so one of them stands for all.

Built-in functions only. Matches are located through the gaps between them: ``split`` gives the gaps, so a place is a
running sum of lengths, summed in blocks so that thousands of matches in a text stay cheap.

Defined cases: a null text counts as empty; rows that repeat a doc_id are judged each by its text; null doc_ids are
kept; an empty table gives an empty result; further columns pass through ``sanitise``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import WORD, bounded, stored, table

#: Fixed values. The kinds of personal data, in the order of their listing.
KINDS = ("email", "ip", "card", "phone", "term")
#: Each pattern matches what the plain one does, without its backtracking: the last quantifiers are possessive, and an
#: address starts where a run of its characters or the search starts, as later starts in the run fail alike.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"

WEIGHT, LEFT, REMOVE = 1.0, 1.0, 0.9
GENERALISE = 2.0**-LEFT
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_sum(sizes: Column, block: int = 256) -> Column:
    """Sums of the first 1, 2, ... elements."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
    sums = F.transform(starts, lambda b: total(F.slice(sizes, b * block + 1, block)))

    def inside(before: Column) -> Column:
        at = lambda i: F.floor(i / block).cast("int")
        return F.transform(sizes, lambda _, i: before[at(i)] + total(F.slice(sizes, at(i) * block + 1, i % block + 1)))

    before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b))))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(before, inside))


def located(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` that are valid, leftmost and not overlapping, with their code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sizes = lambda s: F.transform(s["m"], lambda m, i: s["g"][i] + F.length(m))

    def spans(s: Column) -> Column:
        ends = lambda e: F.transform(s["m"], lambda m, i: F.struct((e[i] - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e[i].alias("end"), m.alias("value")))
        return let(let(sizes(s), lambda z: running_sum(z)), ends)

    found = let(F.struct(matches.alias("m"), gaps.alias("g")), spans)
    return F.filter(found, lambda v: valid(v["value"])).cast(SPAN)


def luhn(digits: Column) -> Column:
    size = F.length(digits)
    digit = lambda i: F.substring(digits, size - i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).otherwise(twice(digit(i))))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All spans of the four patterns, by start and then by kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    card = lambda v: let(digits(v), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    none = F.array().cast(SPAN)
    found = [
        F.when(F.contains(text, F.lit("@")), located(text, "email", EMAIL, lambda v: F.lit(True))).otherwise(none),
        F.when(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), located(text, "ip", IP, lambda v: F.regexp_like(v, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")))).otherwise(none),
        F.when(F.regexp_like(text, F.lit(r"(?:[0-9][\x20-]?){11}[0-9]")), located(text, "card", CARD, card)).otherwise(none),
        F.when(F.regexp_like(text, F.lit(r"\+[0-9]")), located(text, "phone", PHONE, lambda v: F.length(digits(v)).between(9, 15))).otherwise(none),
    ]
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), F.array_sort(F.concat(*found))).otherwise(none)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def term(word: Column) -> Column:
    """A word as a term: lower case, without marks at its ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.filter(F.array_distinct(F.transform(words(text), term)), lambda t: t != "")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` with a space for each of its entities."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(" "))
        return F.struct(more.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return let(F.aggregate(spans, start, step), lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text))))


def term_counts(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(term, texts): in how many distinct texts of ``docs`` (key, text) a term stands outside entities.

    Only texts of ``again``, the keys of several rows, are made distinct; all others are counted where they lie.
    """
    has = F.regexp_like("text", F.lit("[0-9@]"))
    bare = F.when(has, without_spans(F.col("text"), base_spans(F.col("text")))).otherwise(F.col("text"))
    once = docs.join(again, "key", "left_anti").select(F.explode(terms_of(bare)).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    many = docs.join(again, "key", "left_semi").select("key", F.explode(terms_of(bare)).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("texts"))
    return once.unionByName(many).groupBy("term").agg(F.sum("texts").alias("texts"))


def cohorts(found: DataFrame) -> DataFrame:
    """(key, entity, n) of the stored ``found`` (key, spans): one entity for each set of texts that entities have in
    common, in each of its ``n`` texts. Sets are told apart by their size and 128 bits of digests."""
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])))
    one = stored(found.select("key", F.explode(entities).alias("entity")), "entities-of-texts")
    sets = one.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    heads = stored(sets.groupBy("n", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n"), "cohorts")
    return one.join(bounded(heads), "entity").select("key", "entity", "n")


def disclosing_terms(found: DataFrame, docs: DataFrame, weight: float = WEIGHT, threshold: float = GENERALISE) -> DataFrame:
    """Stored (term, strength): the terms that disclose an entity.

    ``found`` is stored (text, spans) of the distinct texts with spans; ``docs`` has all texts as ``text``. A pair is
    passed over only where its strength cannot reach ``threshold``.
    """
    keyed = docs.select("text", F.xxhash64("text").alias("key"))
    copies = keyed.groupBy("key").count()
    total = float(max(copies.count(), 1))
    again = bounded(stored(copies.where("count > 1").select("key"), "repeated-texts"))
    held = found.withColumn("key", F.xxhash64("text"))
    one = stored(cohorts(held), "cohorts-of-texts")
    strength = lambda together, n, texts: (together + weight * n / total) / (texts + weight)
    least = lambda n, texts: strength(F.least(n, texts), n, texts) >= threshold
    most = one.groupBy("key").agg(F.max("n").alias("most"))
    here = held.select("key", F.explode(terms_of(without_spans(F.col("text"), F.col("spans")))).alias("term"))
    rare = here.join(term_counts(keyed, again), "term").join(bounded(stored(most, "most"), 1_000_000), "key").where(least(F.col("most"), F.col("texts")))
    terms = stored(rare.select("key", "term", "texts"), "rare-terms")
    pairs = terms.join(one, "key").where(least(F.col("n"), F.col("texts")))
    told = pairs.groupBy("entity", "term").agg(F.first("n").alias("n"), F.first("texts").alias("texts"), F.count("*").alias("together"))
    strong = told.select("term", strength(F.col("together"), F.col("n"), F.col("texts")).alias("strength")).where(F.col("strength") >= threshold)
    return stored(strong.groupBy("term").agg(F.max("strength").alias("strength")), "terms")


def marked(docs: DataFrame, weight: float = WEIGHT, threshold: float = GENERALISE) -> DataFrame:
    """``docs`` with ``base`` and ``added``: spans of the patterns and of disclosing terms (value: the term), and the
    terms of each text with their strength as ``terms``. Columns of these names are replaced; ``sanitise`` keeps them."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"))
    found = stored(texts.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["text"]), "texts-with-spans")
    terms = disclosing_terms(found, texts, weight, threshold)
    none = F.array().cast(SPAN)
    if terms.isEmpty():
        empty = F.create_map().cast("map<string,double>")
        return docs.withColumns({"base": base_spans(text), "added": none, "terms": empty})
    here = texts.select(F.xxhash64("text").alias("key"), F.explode(terms_of(F.col("text"))).alias("term")).join(bounded(terms), "term")
    held = stored(here.groupBy("key").agg(F.collect_set(F.struct("term", "strength")).alias("held")), "texts-with-terms")
    joined = docs.join(bounded(held, 1_000_000, "held"), F.xxhash64(text) == held["key"], "left").drop("key")
    all_words = F.filter(located(text, "term", WORD, lambda v: F.lit(True)), lambda s: F.exists("held", lambda h: h["term"] == term(s["value"])))
    trimmed = F.transform(all_words, _trim)
    return joined.withColumns({"base": base_spans(text), "added": F.when(F.col("held").isNull(), none).otherwise(trimmed.cast(SPAN)), "terms": F.map_from_entries(F.coalesce("held", F.array().cast("array<struct<term:string,strength:double>>")))}).drop("held")


def _trim(s: Column) -> Column:
    """A word's span without the marks at its ends."""
    lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}]*", 0))
    bare = term(s["value"])
    return F.struct((s["start"] + lead).alias("start"), s["kind"].alias("kind"), (s["start"] + lead + F.length(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))).alias("end"), bare.alias("value"))


def sanitise(docs: DataFrame, weight: float = WEIGHT, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, and strongly disclosing terms removed."""
    k = "p" + uuid.uuid4().hex
    inner = docs.withColumn(k, F.struct(*[F.col(c) for c in docs.columns])).select(k, F.col("text"))
    spans = marked(inner, weight, threshold)
    text = F.coalesce("text", F.lit(""))
    names = F.array(*[F.lit(f"<{n.upper()}>") for n in KINDS])
    stand_in = lambda s: F.when((s["kind"] == KINDS.index("term")) & (F.col("terms")[s["value"]] >= remove), "").otherwise(names[s["kind"]])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), stand_in(s))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, more).otherwise(acc["out"]).alias("out"), F.when(fresh, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"))

    whole = F.aggregate(F.array_sort(F.concat("base", "added")), start, step)
    new = F.when(F.size("base") + F.size("added") == 0, F.col("text")).otherwise(let(whole, lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text)))))
    out = spans.withColumn(f"{k}_new", new)
    return out.select(*[F.col(f"{k}_new").alias("text") if c == "text" else F.col(k)[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: personal data in every document."""
    spans = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    once = spans.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return once.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
