"""Relevance of posts for a question, engagement ranking, label attachment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.functions import anchors
from postpulse.functions import dictionaries as D
from postpulse.functions.authors import author_tier, in_curated_universe, is_curated
from postpulse.functions.text import (
    NOT_SPACE, SPACE, any_substring, hits, let, text_or_empty, tokens,
)
from postpulse.operators.joins import keep_first, keep_last, spread_join, top_k

LABEL_COLUMNS = ("is_noise", "relevance_score", "noise_reason")
_FIVE_WORDS = rf"(?U){NOT_SPACE}+(?:{SPACE}+{NOT_SPACE}+){{4}}"


def heuristic_label(text: Column, question: Column, curated: Column, tier: Column) -> Column:
    """``struct(is_noise, relevance_score, noise_reason)`` of one post for its question."""
    asked = F.transform(
        tokens(F.lower(text_or_empty(question)), "[a-z0-9$]+"),
        lambda t: F.replace(t, F.lit("$"), F.lit("")),
    )

    lists = {
        "finance": D.RELEVANCE_FINANCE, "strong": D.RELEVANCE_STRONG, "noise": D.RELEVANCE_NOISE,
        "social": D.RELEVANCE_SOCIAL_NOISE,
    }

    def flags(seen: Column) -> Column:
        return F.struct(
            *[F.array_contains(seen["hits"], i).alias(name) for i, name in enumerate(lists)],
            F.exists(asked, lambda t: F.contains(seen["lowered"], t)).alias("asked"),
            (~seen["lowered"].rlike(_FIVE_WORDS)).alias("short"),
        )

    def label(f: Column) -> Column:
        on_topic = f["finance"] & f["asked"]
        market = f["strong"] | on_topic
        is_noise = f["noise"] | f["short"] | ~market | (f["social"] & ~f["strong"])
        is_curated_author = F.coalesce(curated, F.lit(False))
        tier_name = F.coalesce(tier, F.lit(D.UNKNOWN_TIER))
        return F.struct(
            is_noise.alias("is_noise"),
            F.when(is_noise, F.when(f["social"], 0.10).otherwise(0.20))
            .when(is_curated_author, 0.92)
            .when(on_topic, 0.85)
            .otherwise(0.70)
            .alias("relevance_score"),
            F.when(is_noise, "heuristic_noise_no_market_context")
            .when(
                is_curated_author,
                F.concat(F.lit("heuristic_curated_author_"), tier_name, F.lit("_market_context")),
            )
            .otherwise("heuristic_financial_or_macro_relevance")
            .alias("noise_reason"),
        )

    lowered = F.lower(text_or_empty(text))
    found = hits(lowered, [any_substring(terms) for terms in lists.values()])
    return let(let(F.struct(found.alias("hits"), lowered.alias("lowered")), flags), label)


def with_author_reliability(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "author_reliability_tier": author_tier(F.col("author_username")),
        "is_curated_market_author": is_curated(F.col("author_username")),
    })


def with_heuristic_labels(df: DataFrame, question: Column | str) -> DataFrame:
    """Label every post for its question: a column of the row, or one fixed question."""
    question = F.lit(question) if isinstance(question, str) else question
    curated = (
        F.col("is_curated_market_author") if "is_curated_market_author" in df.columns
        else F.lit(False)
    )
    tier = (
        F.col("author_reliability_tier") if "author_reliability_tier" in df.columns
        else F.lit(D.UNKNOWN_TIER)
    )
    labelled = df.withColumn("_label", heuristic_label(F.col("text"), question, curated, tier))
    return labelled.withColumns({c: F.col("_label")[c] for c in LABEL_COLUMNS}).drop("_label")


def attach_labels(df: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Left lookup of labels by id; the later duplicate label wins.

    A post without a label is noise with score 0 and reason 'unlabeled'.
    """
    latest = keep_last(labels, ["tweet_id"], [order]).select(
        F.coalesce(F.col("tweet_id"), F.lit("")).alias("_key"),
        *[F.col(c).alias(f"_l_{c}") for c in LABEL_COLUMNS],
        F.lit(True).alias("_hit"),
    )
    keyed = df.withColumn("_key", text_or_empty(F.col("tweet_id")))
    joined = spread_join(keyed, latest, ["_key"], "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({
        "is_noise": F.when(hit, F.col("_l_is_noise")).otherwise(F.lit(True)),
        "relevance_score": F.when(hit, F.col("_l_relevance_score")).otherwise(F.lit(0.0)),
        "noise_reason": F.when(hit, F.col("_l_noise_reason")).otherwise(F.lit("unlabeled")),
    }).drop("_key", "_hit", *[f"_l_{c}" for c in LABEL_COLUMNS])


def attach_call_labels(
    df: DataFrame, labels: DataFrame, question: Column | str, call: str, order: str
) -> DataFrame:
    """Labels of several calls, looked up by (call, id); the later duplicate label wins.

    A call without a usable label (``is_noise`` is null in all of its rows, or it has no rows)
    failed: its posts get the heuristic.  In a call that gave labels, a post without one is
    noise with score 0 and reason 'unlabeled'.
    """
    usable = labels.filter(F.col("is_noise").isNotNull()).withColumn("_id", text_or_empty(F.col("tweet_id")))
    latest = keep_last(usable, [call, "_id"], [order]).select(
        F.col(call).alias("_call"), F.col("_id"), F.struct(*LABEL_COLUMNS).alias("_told")
    )
    answered = usable.select(F.col(call).alias("_call")).distinct().withColumn("_answered", F.lit(True))
    keyed = df.withColumns({"_call": F.col(call), "_id": text_or_empty(F.col("tweet_id"))})
    joined = with_heuristic_labels(spread_join(keyed, latest, ["_call", "_id"], "left"), question)
    joined = spread_join(joined, answered, ["_call"], "left")
    told, unlabeled = F.col("_told").isNotNull(), (F.lit(True), F.lit(0.0), F.lit("unlabeled"))
    return joined.withColumns({
        c: F.when(told, F.col("_told")[c]).when(F.col("_answered"), none).otherwise(F.col(c))
        for c, none in zip(LABEL_COLUMNS, unlabeled, strict=True)
    }).drop("_call", "_id", "_told", "_answered")


def label_posts(
    df: DataFrame, question: Column | str, labels: DataFrame | None = None, order: str | None = None,
    call: str | None = None,
) -> DataFrame:
    """External labels when there are any for the run, else the heuristic.

    ``labels`` is what an external labeller returned (possibly nothing); it is used
    as a whole or not at all, like one call that either succeeds or fails.  With ``call``, a
    column of both tables, each call is used or not on its own.
    """
    if labels is None:
        return with_heuristic_labels(df, question)
    if call is not None:
        return attach_call_labels(df, labels, question, call, order or "tweet_id")
    return attach_labels(df, labels, order or "tweet_id")


_LABEL_OBJECT = r'\{(?:[^{}"]++|"(?:[^"\\]|\\.)*+"|\{[^{}]*+\})*+\}'
_WRAPPER_KEYS = ("results", "items", "tweets", "labels", "data")
_LABEL_KEYS = ("index", "tweet_id", "is_noise", "relevance_score")
_ITEM = T.MapType(T.StringType(), T.StringType())
REASON_LENGTH = 300


def parse_labels(responses: DataFrame, column: str = "response") -> DataFrame:
    """One row per label object found in free-text labeller responses.

    Tried in turn, of the whole text and then of each fenced block: all of it, its outermost
    array, its outermost object (bare or wrapping a list); and finally every complete
    object of a truncated array.  Other columns are carried along; ``label_pos`` is the
    position within the response.
    """
    def outer(text: Column, opening: str, closing: str) -> Column:
        start = F.instr(text, opening)
        length = F.length(text) - F.instr(F.reverse(text), closing) + 2 - start
        return F.when((start > 0) & (F.instr(text, closing) > 0) & (length > 0),
                      F.substr(text, start, length))

    def items(text: Column) -> Column:
        """Labels of one complete JSON text, or null."""
        # Wrapped in an array: trailing text makes it invalid, a list of objects gives
        # it a second element; both are not one complete JSON text.
        wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        valid = wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "string").isNull()

        def of_object(single: Column) -> Column:
            wrapped = F.coalesce(*[
                F.from_json(F.try_element_at(single, F.lit(key)), T.ArrayType(_ITEM))
                for key in _WRAPPER_KEYS
            ])
            own = F.arrays_overlap(F.map_keys(single), F.array(*[F.lit(k) for k in _LABEL_KEYS]))
            return let(wrapped, lambda w: F.when(F.size(w) > 0, w).when(own, F.array(single)))

        found = F.when(text.startswith("["), F.from_json(text, T.ArrayType(_ITEM))).when(
            text.startswith("{"), let(F.from_json(text, _ITEM), of_object)
        )
        return let(F.when(valid, found), lambda f: F.when(F.size(f) > 0, f))

    # Staged columns: each text is built once, however often the next step reads it.
    staged = responses.withColumn("_raw", F.trim(text_or_empty(F.col(column)))).withColumns({
        "_whole": F.regexp_replace(
            F.regexp_replace("_raw", r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""),
        "_blocks": F.transform(
            F.regexp_extract_all("_raw", F.lit(r"(?is)```(?:json)?\s*(.*?)(?:```|$)"), F.lit(1)), F.trim),
    })
    attempts = F.flatten(F.transform(
        F.concat(F.array("_whole"), F.filter("_blocks", lambda b: b != "")),
        lambda source: F.array(source, outer(source, "[", "]"), outer(source, "{", "}")),
    ))
    salvaged = F.filter(
        F.transform(
            F.regexp_extract_all(F.col("_raw"), F.lit(_LABEL_OBJECT), F.lit(0)),
            lambda text: F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, _ITEM)),
        ),
        lambda item: item.isNotNull(),
    )
    tried = F.filter(F.transform(attempts, items), lambda found: found.isNotNull())
    labels = let(tried, lambda t: F.when(F.size(t) > 0, F.get(t, F.lit(0))).otherwise(salvaged))

    def field(name: str) -> Column:
        return F.try_element_at(F.col("_item"), F.lit(name))

    flag = F.lower(field("is_noise"))
    exploded = staged.withColumn("_labels", labels).select(
        *[F.col(c) for c in responses.columns if c != column],
        F.posexplode("_labels").alias("label_pos", "_item"),
    )
    return exploded.withColumns({
        "tweet_id": F.coalesce(field("tweet_id"), F.lit("")),
        "is_noise": F.when(~F.map_contains_key("_item", "is_noise"), True).otherwise(
            F.coalesce(~flag.isin("false", "0", "0.0", "", "null"), F.lit(False))
        ),
        "relevance_score": F.coalesce(field("relevance_score").try_cast("double"), F.lit(0.0)),
        "noise_reason": F.substring(F.coalesce(field("reason"), F.lit("external")), 1, REASON_LENGTH),
    }).drop("_item")


def _count(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.nanvl(F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def with_engagement_ranking(df: DataFrame) -> DataFrame:
    """Seven ranking columns; the caller sorts by ``ranking_score`` (see ``ranked``)."""
    engagement = sum(
        (F.lit(weight) * _count(df, name) for name, weight in D.ENGAGEMENT_WEIGHTS.items()),
        F.lit(0.0),
    )
    author = F.col("author_username") if "author_username" in df.columns else F.lit("")
    text = text_or_empty(F.col("text")) if "text" in df.columns else F.lit("")
    scored = df.withColumn("engagement_score", engagement).withColumn(
        "_hits", hits(F.lower(text), [any_substring(D.RANKING_FINANCE), any_substring(D.RANKING_NOISE)])
    )
    scored = scored.withColumns({
        "engagement_rank_score": F.lit(6.0) * F.log1p("engagement_score"),
        "source_score": F.when(in_curated_universe(author), 25.0).otherwise(0.0),
        "finance_relevance_score": F.when(F.array_contains("_hits", 0), 45.0)
        .otherwise(0.0),
        "noise_penalty": F.when(F.array_contains("_hits", 1), -120.0).otherwise(0.0),
    })
    on_topic = (F.col("finance_relevance_score") > 0) | (F.col("source_score") > 0)
    scored = scored.withColumn("off_topic_penalty", F.when(on_topic, 0.0).otherwise(-80.0))
    return scored.withColumn(
        "ranking_score",
        F.col("finance_relevance_score") + F.col("source_score") + F.col("engagement_rank_score")
        + F.col("noise_penalty") + F.col("off_topic_penalty"),
    ).drop("_hits")


def ranking_order() -> list[Column]:
    return [F.col("ranking_score").desc_nulls_last(), F.col("tweet_id").asc_nulls_last()]


def clamp_results(requested: int) -> int:
    return max(3, min(int(requested), 25))


def pool_size(requested: int) -> int:
    """How many candidates to fetch for a requested number of results."""
    wanted = clamp_results(requested)
    return 10 if wanted <= 5 else 15 if wanted <= 10 else 20


def ranked(df: DataFrame, k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    scored = with_engagement_ranking(df)
    return scored if k is None else top_k(scored, k, ranking_order(), by)


def merge_candidates(
    df: DataFrame, k: int, *, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Candidates of several passes: one row per id (the earliest pass wins), author
    reliability, curated authors first, then plain engagement, first ``k``."""
    key = "tweet_id" if "tweet_id" in df.columns else "text"
    unique = with_author_reliability(keep_first(df, [*by, key], order))
    plain = sum((_count(df, c) for c in ("like_count", "retweet_count", "reply_count", "quote_count")),
                F.lit(0.0))
    ordered = unique.withColumn("_eng", plain)
    return top_k(
        ordered, k,
        [F.col("is_curated_market_author").desc(), F.col("_eng").desc(), F.col(key).asc_nulls_last()],
        by,
    ).drop("_eng")


def evaluated_once(df: DataFrame, name: str, rule: Column) -> DataFrame:
    """``rule`` as a column that a filter on it does not evaluate (and plan) a second time: a
    filter is pushed through a projection, but not through a generator."""
    return df.withColumn(name, F.explode(F.array(rule)))


def anchor_filter(df: DataFrame, question: Column | str) -> DataFrame:
    """Keep posts that preserve enough of the question's anchors.

    A question without anchors passes everything through.  The question may be a
    column; for one fixed question only its own groups are looked for in the posts.
    """
    if isinstance(question, str):
        return _fixed_anchor_filter(df, question)
    groups = anchors.with_implied_context(anchors.anchor_groups(question))
    asked = evaluated_once(df, "_groups", groups)
    counted = evaluated_once(asked, "_anchors", F.struct(
        anchors.match_count(F.col("text"), F.col("_groups")).alias("found"),
        anchors.required_count(F.col("_groups")).alias("required"),
    ))
    return counted.filter(F.col("_anchors.found") >= F.col("_anchors.required")).withColumn(
        "anchor_match_count", F.col("_anchors.found")
    ).drop("_groups", "_anchors")


def _fixed_anchor_filter(df: DataFrame, question: str) -> DataFrame:
    groups = anchors.with_implied_context(anchors.anchor_groups(F.lit(question)))
    asked = df.sparkSession.range(1).select(groups.alias("g")).select(
        anchors.names(F.col("g")).alias("names"), anchors.required_count(F.col("g")).alias("required")
    ).first()
    if asked["required"] == 0:
        return df.withColumn("anchor_match_count", F.lit(0))
    rows = [g for g in D.ANCHOR_GROUPS if g[0] in asked["names"]]
    found = anchors.anchor_groups(F.col("text"), with_implied=True, groups=rows)
    return evaluated_once(df, "anchor_match_count", F.size(found)).filter(
        F.col("anchor_match_count") >= asked["required"]
    )


def join_back(left: DataFrame, right: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Replace ``columns`` of the left side by the right side's, one right row per id.

    The left side is processed rows, which have one row per id already, so no key is hot.
    """
    wanted = [c for c in columns if c in right.columns and c != "tweet_id"]
    picked = keep_first(right, ["tweet_id"], [order]).select("tweet_id", *wanted)
    kept = left.drop(*[c for c in wanted if c in left.columns])
    return kept.join(picked, "tweet_id", "left")
