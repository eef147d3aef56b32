"""Image assets: newest per character, attempts, transitions, approval, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions import status
from plotweave.functions.text import is_blank
from plotweave.plans.pick import earliest, latest, top_per_key
from plotweave.plans.scan import prefix_scan, slice_of


def latest_assets(assets: DataFrame) -> DataFrame:
    return latest(assets, ["char_id"], ["created_at", "id"])


def character_status(characters: DataFrame, assets: DataFrame) -> DataFrame:
    """Characters with their newest asset, if any."""
    newest = latest_assets(assets).select(
        "char_id", F.col("id").alias("asset_id"), F.col("role").alias("asset_role"), F.col("status").alias("asset_status")
    )
    return characters.join(newest, characters["id"] == newest["char_id"], "left").select(
        "id", "character_id", "book_id", "name", "is_main", "profile_image", "image_status", "asset_id", "asset_role", "asset_status"
    )


def book_status(books: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reference state of each book's image profile."""
    state = F.coalesce("reference_status", F.lit("NONE"))
    return books.select("book_id").join(profiles, "book_id", "left").select(
        "book_id",
        state.alias("reference_status"),
        "active_asset_id",
        "reference_char_id",
        F.coalesce("reference_version", F.lit(0)).alias("reference_version"),
        ((state == "APPROVED") & F.col("active_asset_id").isNotNull()).alias("can_fanout"),
    )


def max_attempts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("char_id", "role").agg(F.max("attempt_no").alias("max_attempt"))


def numbered_attempts(requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Attempt number of each new asset: one more than before it, per (character, role)."""
    rows = requests.withColumn("_slice", slice_of(F.col("id")))
    numbered = prefix_scan(rows, ["char_id", "role"], ["_slice"], ["id"], {"attempt_no": ("count", F.lit(1))}).drop("_slice")
    if stored is None:
        return numbered
    joined = numbered.join(max_attempts(stored), ["char_id", "role"], "left")
    return joined.withColumn("attempt_no", F.col("attempt_no") + F.coalesce("max_attempt", F.lit(0))).drop("max_attempt")


def characters_with_status(assets: DataFrame, statuses: list[str]) -> DataFrame:
    """Characters that have an asset in one of the statuses, with the newest such asset's time."""
    return assets.filter(F.col("status").isin(statuses)).groupBy("book_id", "char_id").agg(
        F.max("created_at").alias("newest")
    )


# ----------------------------------------------------------------- transitions

# The status each action sets.
ACTION_STATUS = {
    "generated": "QA_PENDING",
    "qa_pass": "QA_PASSED",
    "qa_fail": "QA_FAILED",
    "approve": "APPROVED",
    "reject": "REJECTED",
    "fail": "FAILED",
    "stale_reference": "STALE_REFERENCE",
    "supersede": "SUPERSEDED",
}


def replay_assets(assets: DataFrame, actions: DataFrame) -> DataFrame:
    """Asset rows after ordered actions (id, seq, action, url, failure_code).

    All actions but ``publish`` set a fixed status, so the last one decides. ``publish``
    needs a publishable status and an image; it is judged against the last other
    action before it, which is one aggregate per asset and no replay.
    """
    target = F.create_map(*[F.lit(x) for pair in ACTION_STATUS.items() for x in pair])
    plain = F.col("action") != "publish"
    sets_code = F.col("action").isin("qa_pass", "qa_fail", "fail")
    code = F.when(F.col("action") != "qa_pass", F.col("failure_code"))
    ends = actions.groupBy("id").agg(
        F.max(F.when(plain, F.struct("seq", target[F.col("action")].alias("status")))).alias("_plain"),
        F.max(F.when(~plain, F.col("seq"))).alias("_publish"),
        F.max_by(F.struct("url"), F.when(F.col("action") == "generated", F.col("seq"))).alias("_generated"),
        F.max_by(F.struct(code.alias("code")), F.when(sets_code, F.col("seq"))).alias("_code"),
    )
    joined = assets.join(ends, "id", "left")
    base = F.coalesce("_plain.status", "status")
    url = F.when(F.col("_generated").isNotNull(), F.col("_generated.url")).otherwise(F.col("url"))
    published = (
        F.col("_publish").isNotNull()
        & (F.col("_plain").isNull() | (F.col("_publish") > F.col("_plain.seq")))
        & status.is_publishable(base)
        & ~is_blank(url)
    )
    return joined.select(
        *[
            F.when(published, "PUBLISHED").otherwise(base).alias(c) if c == "status"
            else url.alias(c) if c == "url"
            else F.when(F.col("_code").isNotNull(), F.col("_code.code")).otherwise(F.col(c)).alias(c) if c == "failure_code"
            else F.col(c)
            for c in assets.columns
        ]
    )


def replay_profiles(profiles: DataFrame, actions: DataFrame) -> DataFrame:
    """Reference profiles after ordered actions (book_id, seq, action, asset_id, char_id).

    Actions: generating, qa_pass, qa_fail, approve, reject. Each sets the status; approval
    and QA also set the asset; approval raises the version, unless it approves the asset that
    is approved already. ``seq`` is unique in a book.
    """
    # Fixed values.
    target = F.create_map(
        *[F.lit(x) for x in ("generating", "CANDIDATE_GENERATING", "qa_pass", "QA_PASSED", "qa_fail", "QA_FAILED",
                             "approve", "APPROVED", "reject", "REJECTED")]
    )
    sets_asset = F.col("action").isin("qa_pass", "approve")
    # What an approval meets is the action before it, else the stored profile.
    scanned = prefix_scan(
        actions.withColumn("_slice", slice_of(F.col("seq"))),
        ["book_id"],
        ["_slice"],
        ["seq"],
        {"_before": ("max", F.struct("seq", "action", "asset_id"))},
        inclusive=False,
    )
    held = profiles.select("book_id", F.col("reference_status").alias("_state"), F.col("active_asset_id").alias("_active"))
    first = F.col("_before").isNull()
    again = F.when(first, (F.col("_state") == "APPROVED") & (F.col("_active") == F.col("asset_id"))).otherwise(
        (F.col("_before.action") == "approve") & (F.col("_before.asset_id") == F.col("asset_id"))
    )
    met = scanned.join(held, "book_id", "left").withColumn("_raises", (F.col("action") == "approve") & ~F.coalesce(again, F.lit(False)))
    ends = met.groupBy("book_id").agg(
        F.max_by(target[F.col("action")], "seq").alias("_status"),
        F.max_by("asset_id", F.when(sets_asset, F.col("seq"))).alias("_asset"),
        F.max_by("char_id", F.when(F.col("action") != "reject", F.col("seq"))).alias("_char"),
        F.count_if("_raises").alias("_approvals"),
    )
    joined = profiles.join(ends, "book_id", "full")
    return joined.select(
        "book_id",
        F.coalesce("_status", "reference_status").alias("reference_status"),
        F.coalesce("_asset", "active_asset_id").alias("active_asset_id"),
        F.coalesce("_char", "reference_char_id").alias("reference_char_id"),
        (F.coalesce("reference_version", F.lit(0)) + F.coalesce("_approvals", F.lit(0))).cast("int").alias("reference_version"),
    )


def _judged(assets: DataFrame, profiles: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals in their order with a verdict; a refused one changes nothing.

    An asset that passes the rules of its own is approved when it is first asked for and
    replaces the one before it, which is superseded from then on and can never be approved
    again. So an approval is judged by two places in its book's order: where its asset was
    first approved, and where the next asset was.
    """
    candidate = assets.select(
        F.col("id").alias("asset_id"), "book_id", F.col("char_id").alias("_char"), F.col("role").alias("_role"),
        F.col("status").alias("_status"), F.col("url").alias("_url"),
    )
    # Profile columns are renamed, as the candidate rows carry the book id as well.
    held = profiles.select("book_id", F.col("active_asset_id").alias("_previous"), F.col("reference_status").alias("_state"))
    ordered = approvals if "seq" in approvals.columns else approvals.withColumn("seq", F.lit(0))
    asked = (
        ordered.dropDuplicates(["book_id", "seq", "asset_id"])
        .join(candidate, ["book_id", "asset_id"], "left")
        .join(held, "book_id", "left")
        .withColumns(
            {
                "_at": F.struct(F.col("seq").cast("long").alias("seq"), "asset_id"),
                "_is_previous": F.coalesce(F.col("_previous") == F.col("asset_id"), F.lit(False)),
                "refusal": F.when(F.col("_role").isNull(), "not in book")
                .when(F.col("_role") != "REFERENCE_SEED", "role")
                .when(~status.is_publishable(F.col("_status")), "status")
                .when(is_blank(F.col("_url")), "no image"),
            }
        )
    )
    firsts = asked.filter(F.col("refusal").isNull()).groupBy("book_id", "asset_id", "_is_previous").agg(F.min("_at").alias("_first"))
    fresh = firsts.filter(~F.col("_is_previous")).drop("_is_previous")
    scanned = prefix_scan(
        fresh.withColumn("_slice", slice_of(F.col("_first.seq"))), ["book_id"], ["_slice"], ["_first"], {}, following={"_next": "_first"}
    ).drop("_slice")
    known = scanned.unionByName(firsts.filter("_is_previous").drop("_is_previous"), allowMissingColumns=True)
    opening = fresh.groupBy("book_id").agg(F.min("_first").alias("_opening"))
    placed = asked.join(known, ["book_id", "asset_id"], "left").join(opening, "book_id", "left")
    # The stored reference holds until the first other approval; one that is not approved can be.
    early = F.col("_opening").isNull() | (F.col("_at") < F.col("_opening"))
    standing = F.col("_is_previous") & (F.coalesce(F.col("_state"), F.lit("")) == "APPROVED")
    is_first = F.col("_at") == F.col("_first")
    return placed.withColumn(
        "verdict",
        # A superseded asset is refused for its status before its image is looked at.
        F.when((F.col("refusal") == "no image") & F.col("_is_previous") & ~early, "status")
        .when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("_is_previous"), F.when(~early, "status").when(standing | ~is_first, "again").otherwise("approved"))
        .when(is_first, "approved")
        .when(F.col("_next").isNull() | (F.col("_at") < F.col("_next")), "again")
        .otherwise("status"),
    )


def approve_references(assets: DataFrame, profiles: DataFrame, approvals: DataFrame) -> dict[str, DataFrame]:
    """Reference approvals (book_id, seq, asset_id) in order; without ``seq`` by asset.

    The approved seed is published; the previous reference is superseded and its published
    derivatives go stale; the version rises with each approval. Approving the active reference
    again only publishes it. A seed of another role, another book, without passed QA or already
    superseded is refused.
    """
    judged = _judged(assets, profiles, approvals)
    approved = judged.filter("verdict = 'approved'")
    ends = approved.groupBy("book_id").agg(
        F.max_by("asset_id", "_at").alias("_new_asset"), F.max_by("_char", "_at").alias("_new_char"), F.count("*").alias("_approvals")
    )
    accepted = judged.filter("verdict IN ('approved', 'again')")
    published = accepted.select(F.col("asset_id").alias("id")).distinct().withColumn("_publish", F.lit(True))
    # Whoever was the reference, before or in between, and is not at the end.
    was = approved.select("book_id", F.col("asset_id").alias("id")).unionByName(
        approved.filter("_previous IS NOT NULL").select("book_id", F.col("_previous").alias("id"))
    )
    replaced = was.join(ends.select("book_id", "_new_asset"), "book_id", "inner").filter("id <> _new_asset").select("id").distinct()
    marks = replaced.withColumn("_superseded", F.lit(True))
    stale = replaced.select(F.col("id").alias("source_asset_id"), F.lit(True).alias("_stale"))
    marked = assets.join(published, "id", "left").join(marks, "id", "left").join(stale, "source_asset_id", "left")
    new_assets = marked.select(
        *[
            F.when(F.col("_superseded"), "SUPERSEDED")
            .when(F.col("_publish"), "PUBLISHED")
            .when(F.col("_stale") & status.is_publishable(F.col("status")), "STALE_REFERENCE")
            .otherwise(F.col("status"))
            .alias(c)
            if c == "status" else F.col(c)
            for c in assets.columns
        ]
    )
    joined = profiles.join(ends, "book_id", "full")
    hit = F.col("_new_asset").isNotNull()
    new_profiles = joined.select(
        "book_id",
        F.coalesce("_new_asset", "active_asset_id").alias("active_asset_id"),
        F.coalesce("_new_char", "reference_char_id").alias("reference_char_id"),
        (F.coalesce("reference_version", F.lit(0)) + F.coalesce("_approvals", F.lit(0))).cast("int").alias("reference_version"),
        F.when(hit, "APPROVED").otherwise(F.col("reference_status")).alias("reference_status"),
    )
    # A character that several approvals show gets the last one's image.
    images = accepted.groupBy(F.col("_char").alias("id")).agg(F.max_by("_url", "_at").alias("profile_image"))
    return {
        "assets": new_assets,
        "profiles": new_profiles,
        "character_images": images,
        "verdicts": judged.select("book_id", "seq", "asset_id", "verdict"),
    }


def publish_images(characters: DataFrame, images: DataFrame) -> DataFrame:
    """Characters with new image urls, now COMPLETED."""
    joined = characters.join(images.select("id", F.col("profile_image").alias("_image")), "id", "left")
    hit = F.col("_image").isNotNull()
    return joined.select(
        *[
            F.coalesce("_image", c).alias(c) if c == "profile_image"
            else F.when(hit, "COMPLETED").otherwise(F.col(c)).alias(c) if c == "image_status" else F.col(c)
            for c in characters.columns
        ]
    )


def fail_images(characters: DataFrame, failed: DataFrame, fallback: str) -> DataFrame:
    """Characters whose generation failed get the fallback image and FAILED."""
    marks = failed.select("id").distinct().withColumn("_f", F.lit(True))
    hit = F.col("_f").isNotNull()
    return characters.join(marks, "id", "left").select(
        *[
            F.when(hit, F.lit(fallback)).otherwise(F.col(c)).alias(c) if c == "profile_image"
            else F.when(hit, "FAILED").otherwise(F.col(c)).alias(c) if c == "image_status" else F.col(c)
            for c in characters.columns
        ]
    )


def without_finished(characters: DataFrame) -> DataFrame:
    """Characters still to generate: no image yet, or not COMPLETED."""
    finished = F.col("profile_image").isNotNull() & (F.col("profile_image") != "") & (F.col("image_status") == "COMPLETED")
    return characters.filter(~F.coalesce(finished, F.lit(False)))


# --------------------------------------------------------------------- fan-out


def default_reference(characters: DataFrame) -> DataFrame:
    """First character of each book: main before others, then by name."""
    return earliest(
        characters.withColumn("_side", ~F.col("is_main")), ["book_id"], ["_side", "name", "id"]
    ).drop("_side")


def check_selection(selection: DataFrame, characters: DataFrame) -> DataFrame:
    """Selected ids that do not exist or belong to another book."""
    owner = characters.select(F.col("id").alias("char_id"), F.col("book_id").alias("_owner"))
    joined = selection.join(owner, "char_id", "left")
    return joined.filter(F.col("_owner").isNull() | (F.col("_owner") != F.col("book_id"))).select(
        "book_id", "char_id", F.when(F.col("_owner").isNull(), "unknown").otherwise("other book").alias("problem")
    )


def fanout_problems(
    requests: DataFrame, characters: DataFrame, profiles: DataFrame, selection: DataFrame | None = None
) -> DataFrame:
    """Requests that are refused (book_id, problem), each with the first rule it breaks.

    In order: scope, publish policy (where requests carry one), approved reference, a selection
    for SELECTED, its characters known, its characters of this book.
    """
    policy = status.publish_policy(F.col("policy")).isNull() if "policy" in requests.columns else F.lit(False)
    approved = profiles.filter((F.col("reference_status") == "APPROVED") & F.col("active_asset_id").isNotNull())
    asked = requests.select("book_id", status.fanout_scope(F.col("scope")).alias("_scope"), policy.alias("_bad_policy")).join(
        approved.select("book_id", F.lit(True).alias("_approved")), "book_id", "left"
    )
    if selection is None:
        asked = asked.withColumns({"_chosen": F.lit(0), "_unknown": F.lit(0), "_other": F.lit(0)})
    else:
        bad = check_selection(selection.select("book_id", "char_id"), characters)
        counts = (
            selection.select("book_id", F.lit("chosen").alias("_kind"))
            .unionByName(bad.select("book_id", F.col("problem").alias("_kind")))
            .groupBy("book_id")
            .agg(*[F.count_if(F.col("_kind") == k).alias(n) for k, n in (("chosen", "_chosen"), ("unknown", "_unknown"), ("other book", "_other"))])
        )
        asked = asked.join(counts, "book_id", "left")
    selected = F.col("_scope") == "SELECTED"
    problem = (
        F.when(F.col("_scope").isNull(), "scope")
        .when(F.col("_bad_policy"), "policy")
        .when(F.col("_approved").isNull(), "no approved reference")
        .when(selected & (F.coalesce("_chosen", F.lit(0)) == 0), "no characters")
        .when(selected & (F.col("_unknown") > 0), "unknown character")
        .when(selected & (F.col("_other") > 0), "character of another book")
    )
    return asked.select("book_id", problem.alias("problem")).filter("problem IS NOT NULL")


def fanout_targets(
    requests: DataFrame, characters: DataFrame, assets: DataFrame, profiles: DataFrame, selection: DataFrame | None = None
) -> DataFrame:
    """Characters each request (book_id, scope, overwrite, max_targets) regenerates.

    Requests of `fanout_problems` bring none. The reference's own character is left out;
    ``skipped`` marks those that keep the image they have. ``max_targets`` is the request's own
    top-k. A selection (book_id, char_id) may carry ``position``: its characters then come in
    the order of their first mention.
    """
    refused = fanout_problems(requests, characters, profiles, selection)
    asked = (
        requests.withColumn("scope", status.fanout_scope(F.col("scope")))
        .join(refused.select("book_id"), "book_id", "left_anti")
        .join(profiles.select("book_id", "reference_char_id"), "book_id", "inner")
    )
    people = characters.select("id", "book_id", "name", "is_main", "profile_image")
    stale = characters_with_status(assets, status.STALE).select(F.col("char_id").alias("id"), F.col("newest").alias("_stale"))
    failed = characters_with_status(assets, status.RETRYABLE).select(F.col("char_id").alias("id"), F.col("newest").alias("_failed"))
    joined = asked.join(people, "book_id", "inner").join(stale, "id", "left").join(failed, "id", "left")
    if selection is None:
        joined = joined.withColumn("_mention", F.lit(None).cast("long"))
    else:
        mentioned = F.col("position").cast("long") if "position" in selection.columns else F.lit(0).cast("long")
        chosen = selection.groupBy("book_id", F.col("char_id").alias("id")).agg(F.min(mentioned).alias("_mention"))
        joined = joined.join(chosen, ["book_id", "id"], "left")
    by_scope = (
        F.when(F.col("scope") == "MAIN_ONLY", F.col("is_main"))
        .when(F.col("scope").isin("GRAPH_VISIBLE", "ALL"), F.lit(True))
        .when(F.col("scope") == "SELECTED", F.col("_mention").isNotNull())
        .when(F.col("scope") == "STALE_ONLY", F.col("_stale").isNotNull())
        .when(F.col("scope") == "FAILED_ONLY", F.col("_failed").isNotNull())
        .otherwise(F.lit(False))
    )
    wanted = joined.filter(by_scope & ~F.col("id").eqNullSafe(F.col("reference_char_id")))
    # Stale and failed scopes go by the newest asset, a selection by its own order, the others by the cast order.
    recency = F.when(F.col("scope") == "STALE_ONLY", F.col("_stale")).when(F.col("scope") == "FAILED_ONLY", F.col("_failed"))
    mention = F.when(F.col("scope") == "SELECTED", F.col("_mention"))
    order = [F.desc("_recency"), F.asc("_place"), F.desc("is_main"), F.asc("name"), F.asc("id")]
    wanted = wanted.withColumns({"_recency": recency, "_place": mention})
    capped = F.coalesce(F.col("max_targets") > 0, F.lit(False))
    some = top_per_key(wanted.filter(capped), ["book_id"], order, "max_targets", "id").drop("rank")
    limited = wanted.filter(~capped).unionByName(some)
    keeps = ~F.col("overwrite") & status.has_image(F.col("profile_image")) & ~F.col("scope").isin("STALE_ONLY", "FAILED_ONLY")
    return limited.select("book_id", "scope", "id", keeps.alias("skipped"))


def fanout_totals(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Targets, successes, failures and skips per book; ``outcomes`` has (id, status)."""
    made = targets.join(outcomes.select("id", F.col("status").alias("_status")), "id", "left")
    ok = ~F.col("skipped") & F.col("_status").isin("PUBLISHED", "QA_PASSED")
    return made.groupBy("book_id").agg(
        F.count("*").alias("target_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~F.col("skipped") & ~F.coalesce(ok, F.lit(False))).alias("failed_count"),
        F.count_if("skipped").alias("skipped_count"),
    )
