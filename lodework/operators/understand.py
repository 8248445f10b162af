"""Understanding queries: what is asked for, how, and which paths should run. The plan is data: columns per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions import text as tx

# Fixed values of the query model.
ANAPHORIC = "it that this they them those these he she him her his hers its their theirs".split()
CONTINUATION = "more next another again continue else other others further additional rest remaining".split()
BARE = "herbs herb documents document data info information stuff things items entries records results everything anything something".split()
ANAPHORIC_PHRASE = r"(?i)^\s*(?:what about|how about|and|but|ok|okay|then|so)?\s*(?:that|this|it|those|these|them|they)\s*\??\s*$"
GLOBAL = r"(?i)\b(?:overall|in general|generally|main|major|key|common|overview|summar(?:y|ise|ize)|themes?|topics?|patterns?|trends?|categories|what kinds? of|what types? of|across (?:the|all)|most (?:common|frequent)|how many|list all|everything about|broadly)\b"
LOCAL = r"(?i)\b(?:who|which|what) (?:is|are|was|were|treats?|causes?|directed|released|made|wrote|composed|developed|created)\b|\b(?:tell me about|explain|describe|details? (?:of|about)|used for|related to|connected to|associated with)\b"
MULTIHOP = r"(?i)\b(?:other|also|both|besides|apart from|as well as|else|the (?:director|author|creator|maker|company|organization) of|who (?:directed|wrote|created|released) .{0,40}(?:also|other)|connect(?:s|ed|ion)|relationship between|link between|same .{0,20}as|shared|in common)\b"
QUOTED = r"\"[^\"]{2,80}\"|'[^']{2,80}'"
IDENTIFIER = r"\b(?:[A-Z]{2,}[-_]?\d*|\w+[-_]\d+|\d+[A-Za-z]+)\b"
MENTION = r"\b[A-Z][a-zA-Z0-9'’\-]*(?:\s+[A-Z][a-zA-Z0-9'’\-]*)*\b"
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
STOP = (
    "what which who whom whose when where why how is are was were be been being am do does did done doing can could shall should will would may might must have has had "
    "the a an and or but if then than that this these those there here of in on at to for with by from about into over after before also all any some other another same such only own "
    "me my you your them they their it its show tell give list find get make made used things stuff info information main key common"
).split()
MOST_MENTIONS, MOST_IDENTIFIERS, MARGIN = 8, 6, 0.75
_ALT = "|".join(STOP)
LEADING, TRAILING = rf"(?i)^(?:(?:{_ALT})(?:\s+|$))+", rf"(?i)(?:(?:^|\s+)(?:{_ALT}))+$"


def _first_of(items: Column, key) -> Column:  # noqa: ANN001
    """items without later ones of an equal key."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def mentions(text: Column) -> Column:
    """Names in a query: capitalised runs without question words at their ends; failing these, its content words."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, LEADING, ""), TRAILING, "")))
    runs = _first_of(F.filter(runs, lambda p: F.length(tx.normalize_name(p)) > 1), tx.normalize_name)
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(STOP))
    words = _first_of(F.filter(words, lambda w: F.length(tx.normalize_name(w)) > 0), tx.normalize_name)
    return F.slice(F.when(F.size(runs) > 0, runs).otherwise(words), 1, MOST_MENTIONS)


def identifiers(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(STOP))
    return F.slice(F.array_distinct(found), 1, MOST_IDENTIFIERS)


def underspecified(text: Column) -> Column:
    """Why a query can't be resolved as it is written; null where it can."""
    plain = F.lower(F.regexp_replace(F.trim(text), r"^[?!.]+|[?!.]+$", ""))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    one, two = F.size(words) == 1, F.size(words) == 2
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return (
        F.when(text.rlike(ANAPHORIC_PHRASE), "anaphora_without_antecedent")
        .when(one & first.isin(ANAPHORIC), "anaphora_without_antecedent")
        .when(one & first.isin(CONTINUATION), "continuation_without_prior_turn")
        .when(one & first.isin(BARE), "category_without_entity")
        .when(two & first.isin(CONTINUATION) & second.isin(BARE), "category_without_entity")
    )


def resolve_context(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, text) with resolved_text: a turn that can't be resolved as written takes over the last one.

    A continuation ("more herbs") and a reference ("it") become the last turn; a bare category is put after it.
    """
    before = F.trim(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = turns.withColumns({"reason": underspecified(F.col("text")), "before": before})
    first = F.get(F.split(F.lower(F.regexp_replace(F.trim("text"), r"^[?!.]+|[?!.]+$", "")), r"\s+"), F.lit(0))
    inherits = first.isin(CONTINUATION) | first.isin(ANAPHORIC) | F.col("text").rlike(ANAPHORIC_PHRASE)
    text = F.when(F.col("reason").isNull() | F.col("before").isNull() | (F.col("before") == ""), F.col("text")).when(inherits, F.col("before")).otherwise(F.concat_ws(" ", "before", "text"))
    return rows.withColumn("resolved_text", text).drop("before")


def analyse(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """queries with mentions, identifiers, quoted, hops, the three scores, intent and confidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = queries.withColumns({
        "reason": underspecified(t), "mentions": mentions(t), "identifiers": identifiers(t), "quoted": F.transform(F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)),
        "is_global": t.rlike(GLOBAL), "is_local": t.rlike(LOCAL), "is_multihop": t.rlike(MULTIHOP), "n_words": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")),
    })
    n = F.size("mentions")
    short = (F.col("n_words") <= 3) & (n > 0)
    points = lambda c, x: F.when(c, x).otherwise(0.0)
    rows = rows.withColumns({
        "global_score": points(F.col("is_global"), 3.0) + points(n == 0, 1.0),
        "local_score": F.round(points(F.col("is_local"), 1.5) + F.when((n > 0) & ~F.col("is_global"), 1.0 + F.least(n, F.lit(3)) * 0.3).otherwise(0.0) + points(short, 0.5) + points(F.col("is_multihop"), 1.0), 4),
        "lexical_score": F.round(points(F.size("quoted") > 0, 2.5) + points(F.size("identifiers") > 0, 1.5) + points(short, 0.8), 4),
        "hops": F.when(F.col("is_multihop"), 2).otherwise(1),
    })
    ordered = F.sort_array(F.array("global_score", "local_score", "lexical_score"), asc=False)
    best, margin = ordered[0], F.round(ordered[0] - ordered[1], 4)
    unsure = (best <= 0) | (margin < MARGIN)
    name = F.when(F.col("global_score") == best, "global").when(F.col("local_score") == best, "local").otherwise("lexical")
    intent = F.when(F.col("reason").isNotNull(), "clarify").when(unsure, "hybrid").otherwise(name)
    confidence = F.when(F.col("reason").isNotNull(), 0.9).when(unsure, 0.4).otherwise(F.least(F.lit(1.0), best / 4))
    return rows.withColumns({"intent": intent, "confidence": F.round(confidence, 4), "has_anchor": (n > 0) | (F.size("identifiers") > 0)})


def plan(analysed: DataFrame, top_k: int = 5) -> DataFrame:
    """The retrieval plan per query: which paths run, how many candidates, how deep, and the weights of the fusion."""
    many = max(4 * top_k, 20)
    i, anchor, deeper = F.col("intent"), F.col("has_anchor"), F.least(F.col("hops") + 1, F.lit(3))
    pick = lambda local, lexical, hybrid, wide, none: F.when(i == "local", local).when(i == "lexical", lexical).when(i == "hybrid", hybrid).when(i == "global", wide).otherwise(none)
    l, f = F.lit, F.lit(False)  # noqa: E741
    return analysed.withColumns({
        "use_vector": pick(l(True), l(True), l(True), l(True), f), "use_lexical": pick(l(True), l(True), l(True), f, f),
        "use_graph": pick(anchor, anchor, anchor, f, f), "use_community": pick(f, f, ~anchor, l(True), f), "use_expansion": pick(l(True), f, anchor, f, f),
        "vector_k": pick(l(many), l(max(many // 2, 10)), l(many), l(many), l(0)), "lexical_k": pick(l(many), l(many), l(many), l(0), l(0)),
        "graph_depth": pick(deeper, l(1), deeper, l(0), l(0)), "expansion_hops": pick(F.when(F.col("hops") > 1, 2).otherwise(1), l(0), l(1), l(0), l(0)),
        "community_k": pick(l(0), l(0), l(max(top_k, 3)), l(max(top_k, 5)), l(0)),
        "w_vector": pick(l(1.0), l(0.7), l(1.0), l(1.0), l(0.0)), "w_lexical": pick(l(0.8), l(1.6), l(1.0), l(0.0), l(0.0)),
        "w_graph": pick(l(1.4), l(0.6), l(1.0), l(0.0), l(0.0)), "w_community": pick(l(0.0), l(0.0), l(0.8), l(1.5), l(0.0)),
    })


def clarification(reason: Column, text: Column) -> Column:
    """What to ask back; null where nothing is unclear."""
    return (
        F.when(reason == "anaphora_without_antecedent", F.format_string("What does \"%s\" refer to?", text))
        .when(reason == "continuation_without_prior_turn", F.lit("There is no earlier question to continue. What would you like to know?"))
        .when(reason == "category_without_entity", F.format_string("\"%s\" names a kind of thing. Which one do you mean?", text))
    )
