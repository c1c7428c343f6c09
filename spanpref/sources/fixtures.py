"""Derived extraction fixtures (FIXTURES.md section 3).

The driver tables hold no annotated extractions, so examples are derived
deterministically from ``conversations`` (one example per turn) or from
``documents`` (one example per non-empty line).  Every random choice is a
keyed md5 draw (``spanpref.functions.draws``), so the rows are identical on any
partitioning and in the DuckDB twin of this recipe (``spanpref.plans.oracle``).

Output tables:

* ``examples``:   ``ex_id, query, answer`` (+ ``grp, seq``)
* ``predictions``: ``model, ex_id, pred_text`` - two models (seeds 42, 43)
  with realistic label, span and format noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanpref.functions import vocab
from spanpref.functions.draws import draw
from spanpref.lineage import staged

GOLD_SEED = 42
MODELS = (("model_a", 42), ("model_b", 43))
INSTRUCTION = "Label the current sentence with Code, Sub-code and Span."
#: Lines of a text and turns of a conversation are fewer than 2^30 (a string holds
#: less than 2^31 bytes, a line takes two), so ``grp * stride + seq`` is unique; with
#: two negatives an example, pair ids stay in 64 bits for ``grp`` below 2^32.
CONV_ID_STRIDE = DOC_ID_STRIDE = 1 << 30
#: Every fifth current sentence carries a tab, a no-break space and a carriage return.
PADDED = (5, 2)
#: Share of examples a model leaves without a prediction.
LOST_SHARE = 0.01
#: Gold answers that can't be used, by upper bounds of a draw: cut off, results that are null, a root that is no object.
BROKEN_GOLD = (("cut", 0.01), ("null", 0.015), ("array", 0.02))
NULL_RESULTS, ROOT_ARRAY = '{"results":null}', "[]"


def sentences_from_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("grp"), F.col("turn").alias("seq"), "role", "text", F.lit(CONV_ID_STRIDE).alias("stride")
    )


def sentences_from_documents(documents: DataFrame) -> DataFrame:
    """One sentence per non-empty line of a document; roles alternate by line."""
    lines = documents.select("doc_id", F.split("text", "\n").alias("lines"))
    rows = lines.select("doc_id", "lines", F.posexplode("lines").alias("seq", "text")).where(F.trim("text") != "")

    def near(step: int):
        # the lines before and after are in the row; a blank one is no sentence
        at = F.col("seq") + step
        line = F.when(at >= 0, F.get("lines", at))
        return F.when(F.trim(line) != "", line)

    return rows.select(
        F.col("doc_id").alias("grp"),
        F.col("seq").cast("bigint").alias("seq"),
        F.when(F.col("seq") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        "text",
        F.lit(DOC_ID_STRIDE).alias("stride"),
        near(-1).alias("prev_text"),
        near(1).alias("next_text"),
    )


def _letters_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L} ]", " "), " "), lambda w: w != F.lit(""))


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _answer_text(annots: Column) -> Column:
    items = F.transform(
        annots,
        lambda a: F.concat(
            F.lit('{"Code":"'), a["code"], F.lit('","Sub-code":"'), a["sub_code"], F.lit('","Span":"'), a["span"], F.lit('"}')
        ),
    )
    return F.concat(F.lit('{"results":['), F.array_join(items, ","), F.lit("]}"))


def _flat(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(""))


def examples(sentences: DataFrame, seed: int = GOLD_SEED) -> DataFrame:
    """Examples with prompt context and gold annotations.

    Lines of a document bring their neighbours along.  Those of a conversation's
    turns come from two equi-joins on the unique key ``(grp, seq)`` rather than a
    window over ``grp``, which would put one very long conversation into a single task.
    """
    b = sentences
    # Spread the sentences by id before the draws: making gold, like everything downstream
    # (parsing, negative generation, token weighting), is CPU-heavy per row, and a small or
    # single-file source would otherwise keep it all in one task.  An explicit
    # partition count is kept by AQE (it does not coalesce it back to one).
    n_parts = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "prev_text" not in b.columns:
        prev = sentences.select("grp", (F.col("seq") + 1).alias("seq"), F.col("text").alias("prev_text"))
        nxt = sentences.select("grp", (F.col("seq") - 1).alias("seq"), F.col("text").alias("next_text"))
        b = b.join(prev, ["grp", "seq"], "left").join(nxt, ["grp", "seq"], "left")
    b = b.repartition(n_parts, "grp", "seq")

    def u(*k):
        return draw(seed, F.col("grp"), F.col("seq"), *k)

    pairs = vocab.hierarchy_pairs_array()
    b = b.withColumn("words", _letters_words(F.col("text")))
    nw = F.size("words")
    n = F.floor(u("n") * 4).cast("int")
    # stage 1: the draws of each annotation, computed once
    b = b.withColumn(
        "gold_draws",
        F.transform(
            _range(n),
            lambda k: F.struct(
                F.floor(u("pair", k) * 36).cast("int").alias("pair"),
                (F.floor(u("s", k) * F.greatest(nw - 5, F.lit(1))) + 1).cast("int").alias("start"),
                (F.floor(u("l", k) * 5) + 1).cast("int").alias("len"),
            ),
        ),
    )
    # stage 2: labels and spans from the draws
    gold = F.transform(
        F.col("gold_draws"),
        lambda d: F.struct(
            F.get(pairs, d["pair"])["code"].alias("code"),
            F.get(pairs, d["pair"])["sub_code"].alias("sub_code"),
            F.array_join(F.slice(F.col("words"), d["start"], d["len"]), " ").alias("span"),
        ),
    )
    b = b.withColumn("gold", gold)
    b = b.withColumn(
        "gold",
        F.when((u("dup") < 0.05) & (F.size("gold") > 0), F.concat("gold", F.array(F.get("gold", 0)))).otherwise(
            F.col("gold")
        ),
    )
    yn = F.when(F.col("role") == "assistant", F.lit("Y")).otherwise(F.lit("N"))
    padded = F.col("seq") % PADDED[0] == PADDED[1]
    query = F.concat(
        F.lit(INSTRUCTION + "\nTO_PAT_YN: "), yn,
        F.lit("\nPrevious sentence: "), _flat(F.col("prev_text")),
        F.lit("\nCurrent sentence: "), F.when(padded, F.lit("\t")).otherwise(""), _flat(F.col("text")),
        F.when(padded, F.lit("\u00a0\r")).otherwise(""),
        F.lit("\nNext sentence: "), _flat(F.col("next_text")),
    )
    b = b.withColumn("answer", _answer_text(F.col("gold"))).withColumn("broken", u("broken"))
    cut, null, array = (bound for _, bound in BROKEN_GOLD)
    answer = (
        F.when(F.col("broken") < cut, F.left("answer", F.floor(F.length("answer") * 0.8).cast("int")))
        .when(F.col("broken") < null, F.lit(NULL_RESULTS))
        .when(F.col("broken") < array, F.lit(ROOT_ARRAY))
        .otherwise(F.col("answer"))
    )
    return b.select(
        (F.col("grp") * F.col("stride") + F.col("seq")).alias("ex_id"),
        "grp",
        "seq",
        query.alias("query"),
        answer.alias("answer"),
        "gold",
        "words",
    )


def _noisy_annotations(df: DataFrame, model_seed: int) -> DataFrame:
    """Add ``pred_annots``: per gold annotation keep / other sub-code / other code /
    drop / shorter span, with label case noise, plus an occasional extra annotation.

    Built in stages (draws first, then labels) so every draw and lookup is
    computed once per annotation instead of once per use.
    """

    def u(*k):
        return draw(model_seed, F.col("grp"), F.col("seq"), *k)

    codes = vocab.code_vocab_array()
    pairs = vocab.hierarchy_pairs_array()

    def stage1(a, k):
        ci = F.array_position(codes, a["code"]).cast("int") - 1
        alt = u("alt", k)
        new_code = F.get(codes, ((ci + 1 + F.floor(alt * 7)) % 8).cast("int"))
        return F.struct(
            a["code"].alias("code"),
            a["sub_code"].alias("sub_code"),
            a["span"].alias("span"),
            u("fate", k).alias("fate"),
            alt.alias("alt"),
            u("alt2", k).alias("alt2"),
            (u("case", k) < 0.10).alias("noisy"),
            vocab.valid_subs(a["code"]).alias("subs"),
            new_code.alias("new_code"),
            vocab.valid_subs(new_code).alias("new_subs"),
        )

    def stage2(d):
        fate, subs, nsubs = d["fate"], d["subs"], d["new_subs"]
        ns = F.size(subs)
        old = F.array_position(subs, d["sub_code"]).cast("int") - 1
        other_sub = F.when(
            ns > 1, F.get(subs, ((old + 1 + F.floor(d["alt"] * (ns - 1))) % ns).cast("int"))
        ).otherwise(d["sub_code"])
        new_sub = F.when(F.array_contains(nsubs, d["sub_code"]), d["sub_code"]).otherwise(
            F.get(nsubs, F.floor(d["alt2"] * F.size(nsubs)).cast("int"))
        )
        sw = F.split(d["span"], " ")
        short = F.array_join(F.slice(sw, F.lit(2), F.greatest(F.size(sw) - 1, F.lit(0))), " ")
        recode = (fate >= 0.70) & (fate < 0.85)
        return F.struct(
            (~((fate >= 0.85) & (fate < 0.95))).alias("keep"),
            d["noisy"].alias("noisy"),
            F.when(recode, d["new_code"]).otherwise(d["code"]).alias("code"),
            F.when((fate >= 0.55) & (fate < 0.70), other_sub).when(recode, new_sub).otherwise(d["sub_code"]).alias("sub_code"),
            F.when(fate >= 0.95, short).otherwise(d["span"]).alias("span"),
        )

    def stage3(a):
        return F.struct(
            F.when(a["noisy"], F.concat(F.lit(" "), F.lower(a["code"]), F.lit("  "))).otherwise(a["code"]).alias("code"),
            F.when(a["noisy"], F.upper(a["sub_code"])).otherwise(a["sub_code"]).alias("sub_code"),
            a["span"].alias("span"),
        )

    df = df.withColumn("_d1", F.transform(F.col("gold"), stage1))
    df = df.withColumn("_d2", F.filter(F.transform(F.col("_d1"), stage2), lambda a: a["keep"]))
    df = df.withColumn("_kept", F.transform(F.col("_d2"), stage3))
    df = df.withColumn("_xp", F.get(pairs, F.floor(u("xp") * 36).cast("int")))
    df = df.withColumn("_xs", (F.floor(u("xs") * F.greatest(F.size("words") - 3, F.lit(1))) + 1).cast("int"))
    extra = F.struct(
        F.col("_xp.code").alias("code"),
        F.col("_xp.sub_code").alias("sub_code"),
        F.array_join(F.slice(F.col("words"), F.col("_xs"), F.lit(2)), " ").alias("span"),
    )
    df = df.withColumn("pred_annots", F.when(u("x") < 0.12, F.concat("_kept", F.array(extra))).otherwise(F.col("_kept")))
    return df.drop("_d1", "_d2", "_kept", "_xp", "_xs")


def _format_noise(json_text: Column, fmt: Column) -> Column:
    return (
        F.when(fmt < 0.70, json_text)
        .when(fmt < 0.80, F.concat(json_text, F.lit(" done")))
        .when(fmt < 0.88, F.concat(F.lit("```json\n"), json_text, F.lit("\n```")))
        .when(fmt < 0.94, F.replace(json_text, F.lit('"'), F.lit("'")))
        .when(fmt < 0.97, F.replace(json_text, F.lit('"'), F.lit("&quot;")))
        .otherwise(F.left(json_text, F.floor(F.length(json_text) * 0.8).cast("int")))
    )


def predictions(ex: DataFrame, models=MODELS) -> DataFrame:
    """Model outputs for all but ``LOST_SHARE`` of the examples: ``(model, ex_id, pred_text)``.

    The model loop is a union of narrow projections over the same examples
    (no shuffle); a real run gets these rows from the inference hook instead.
    """
    out = None
    for name, mseed in models:
        m = _noisy_annotations(ex.select("ex_id", "grp", "seq", "gold", "words"), mseed)
        m = m.withColumn("pred_json", _answer_text(F.col("pred_annots")))
        m = m.withColumn("fmt", draw(mseed, F.col("grp"), F.col("seq"), "fmt"))
        m = m.where(draw(mseed, F.col("grp"), F.col("seq"), "lost") >= LOST_SHARE)
        m = m.select(F.lit(name).alias("model"), "ex_id", _format_noise(F.col("pred_json"), F.col("fmt")).alias("pred_text"))
        out = m if out is None else out.unionByName(m)
    return out


def extraction_fixture(sentences: DataFrame, keep_query: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(examples[ex_id, query, answer], predictions[model, ex_id, pred_text])``.

    The examples are written to the shared folder: every model's predictions and all
    that a query reads of the examples come from there, so they are made once.
    ``keep_query=False`` leaves the prompts out, for queries that don't read them.
    """
    ex = examples(sentences)
    ex = staged(ex if keep_query else ex.drop("query"), "examples")
    return ex.select("ex_id", *(["query"] if keep_query else []), "answer"), predictions(ex)
