"""Operator 6: personal data, by patterns and by information-theoretic sanitisation. SQL functions only.

Patterns find emails, addresses, cards and phone numbers: the protected
entities. Words near an entity's mentions may give it away as well. How strongly
a term t reveals an entity e is estimated from the corpus: with n_te documents
that mention t near e, n_t documents that hold t, n_e that hold e, of N in all,

    disclosure = PMI(t; e) / IC(e) = log2(N n_te / (n_t n_e)) / log2(N / n_e),

1 if t never occurs without e, 0 if independent. Terms that disclose
``GENERALISE`` or more in at least ``MIN_CONTEXTS`` different surroundings (copies
of one text are one) are generalised, from ``REMOVE`` on removed; both add spans
of kind ``term`` to the pattern spans, wherever in any text the term stands. Only
the estimate looks at surroundings. Terms are words of letters and digits, two
characters and more.

All counts cover all documents: words are counted per task before the shuffle;
entities and pairs are equi-joins that Spark may split.

Defined results: null text counts as empty; empty texts have no spans; repeated
rows are found each and, as documents, counted once; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import staged
from spanpref.llm.spans import KIND_SPAN, by_patterns, count_of, listed, located, replaced

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats and starts at a run's beginning or the last match's end (\G) find the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW, MIN_CONTEXTS, GENERALISE, REMOVE = 60, 3, 0.85, 0.98
TERM_RANK = len(KINDS)
_BYTE_RE = r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$"
_TERM_RE = r"[\p{L}\p{N}]{2,}+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(d, i):
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    values = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), part)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


KEEP = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(_BYTE_RE),
    "card": lambda v: F.length(digits_of(v)).between(12, 19) & luhn(digits_of(v)),
    "phone": lambda v: F.length(digits_of(v)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Sorted pattern spans of a text."""
    return by_patterns(text, PATTERNS, KEEP)


def _around(text: Column, spans: Column) -> Column:
    """Per span its entity and the words up to ``WINDOW`` characters before and after it, whole words only."""

    def words(begin, piece, cut_left, cut_right):
        inside = located(piece, _TERM_RE)
        whole = F.filter(inside, lambda w: ~(cut_left & (w["start"] == 0)) & ~(cut_right & (w["end"] == F.length(piece))))
        return F.transform(whole, lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + begin).alias("start"), (w["end"] + begin).alias("end")))

    def one(s):
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = words(begin, F.substring(text, begin + 1, s["start"] - begin), begin > 0, F.lit(False))
        after = words(s["end"], F.substring(text, s["end"] + 1, F.lit(WINDOW)), F.lit(False), s["end"] + WINDOW < F.length(text))
        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.concat(before, after).alias("words"))

    return F.transform(spans, one)


def _terms(text: Column) -> Column:
    """The different words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM_RE), F.lit(0)), F.lower))


def _marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans, around)`` of every row; the text stays behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), base_spans(text).alias("spans"))
    return found.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, _around(F.col("text"), F.col("spans"))).alias("around"))


def disclosures(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs at or over ``GENERALISE``; ``mentions`` as of ``term_spans``."""
    seen = mentions.groupBy("entity", "term", "doc_id", "text_hash").agg(F.min("context").alias("context"))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.min("context").alias("low"), F.max("context").alias("high"))
    pairs = pairs.where((F.col("n_te") >= MIN_CONTEXTS) & (F.col("low") != F.col("high"))).select("entity", "term", "n_te")
    pairs = staged(pairs, "pii-pairs")
    exact = seen.join(pairs.select(F.col("entity").alias("e"), F.col("term").alias("t")), (F.col("entity") == F.col("e")) & (F.col("term") == F.col("t")), "left_semi")
    contexts = exact.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_contexts"))
    pairs = pairs.join(contexts.where(F.col("n_contexts") >= MIN_CONTEXTS), ["entity", "term"]).select("entity", "term", "n_te")
    pairs = staged(pairs, "pii-supported")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.explode(_terms(text)).alias("w")).groupBy("w").agg(F.count("*").alias("n_t"))
    entities = mentions.select(F.col("entity").alias("e"), "doc_id", "text_hash").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    total = docs.agg(F.count("*").alias("n"))
    joined = pairs.join(words, F.col("term") == F.col("w")).join(entities, F.col("entity") == F.col("e")).crossJoin(F.broadcast(total))
    # repeated rows count in n_t but once in n_te, hence at most 1
    share = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    rare = F.greatest(F.log2(F.col("n") / F.col("n_e")), F.lit(1e-9))
    return joined.select("entity", "term", (1 + F.log2(share) / rare).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans, base)`` per row: all spans and the pattern spans, sorted."""
    marked = staged(_marked(docs), "pii-marked")
    near = marked.where(F.size("spans") > 0).select("doc_id", "text_hash", F.explode("around").alias("a"))
    context = F.xxhash64(F.transform("a.words", lambda w: w["term"]))
    mentions = near.select("doc_id", "text_hash", F.col("a.entity").alias("entity"), context.alias("context"), F.explode("a.words").alias("w"))
    mentions = staged(mentions.select("doc_id", "text_hash", "entity", "context", "w.term", "w.start", "w.end"), "pii-mentions")
    known = disclosures(docs, mentions).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    known = staged(known, "pii-known")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(_terms(text)).alias("w"))
    held = words.join(known, F.col("w") == F.col("term")).groupBy("doc_id", "text_hash", "term").agg(F.max("disclosure").alias("disclosure"))
    held = held.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    held = staged(held, "pii-held")
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    holders = texts.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "text", "known")

    def one(s):
        value = F.when(F.element_at("known", F.lower(s["value"])) >= REMOVE, "remove").otherwise("generalise")
        return F.struct(s["start"].alias("start"), F.lit(TERM_RANK).alias("rank"), s["end"].alias("end"), F.lit("term").alias("kind"), value.alias("value"))

    terms = F.transform(located(F.col("text"), _TERM_RE, lambda v: F.map_contains_key("known", F.lower(v))), one).cast(KIND_SPAN)
    # repeated rows have the same terms
    added = holders.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), terms.alias("terms")).groupBy("d", "h").agg(F.min("terms").alias("terms"))
    both = marked.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    everything = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(KIND_SPAN))))
    return both.select("doc_id", "text_hash", everything.alias("spans"), F.col("spans").alias("base"))


def result(docs: DataFrame) -> DataFrame:
    base = F.col("base")
    return find(docs).select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span taken out of the texts: entities and generalised terms by a mark of their kind.

    All columns as they came; ``n_chars``, where there is one, follows the text.
    """
    found = find(docs).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.min("spans").alias("spans"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_text"), F.col("spans").alias("found_spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (plain[names[docs.columns.index(c)]] for c in ("doc_id", "text"))
    both = plain.join(found, doc_id.eqNullSafe(F.col("found_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("found_text")), "left")

    def tag(s):
        return F.when(s["kind"] == "term", F.when(s["value"] == "remove", "").otherwise("<TERM>")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))

    new = F.when(F.col("found_spans").isNull(), text).otherwise(replaced(text, F.col("found_spans"), tag))
    done = both.select(*names, new.alias("new_text"))
    columns = []
    for name, c in zip(docs.columns, names):
        if name == "text":
            columns.append(F.col("new_text").alias(c))
        elif name == "n_chars":
            columns.append(F.length("new_text").cast(docs.schema[name].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return done.select(*columns).toDF(*docs.columns)
