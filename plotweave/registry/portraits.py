"""Image assets and fan-out."""

from pyspark.sql import functions as F

from plotweave.functions import status
from plotweave.operators import images
from plotweave.plans.pick import top_per_key
from plotweave.registry.base import query
from plotweave.views import Views

C = F.col

NEWEST = "SELECT * FROM asset QUALIFY row_number() OVER (PARTITION BY char_id ORDER BY created_at DESC, id DESC) = 1"
PROFILE = """SELECT DISTINCT o_orderkey // 128 AS book_id,
    (['APPROVED', 'APPROVED', 'QA_PASSED', 'NONE'])[o_orderkey // 128 % 4 + 1] AS reference_status,
    CASE WHEN o_orderkey // 128 % 4 = 3 THEN NULL ELSE o_orderkey // 128 * 3 END AS active_asset_id,
    o_orderkey // 128 * 100 + 1 AS reference_char_id, CAST(o_orderkey // 128 % 4 AS INT) AS reference_version FROM orders"""


def profiles(v: Views):
    return v.event.select("book_id").distinct().selectExpr(
        "book_id",
        "element_at(array('APPROVED', 'APPROVED', 'QA_PASSED', 'NONE'), int(book_id % 4) + 1) AS reference_status",
        "if(book_id % 4 = 3, null, book_id * 3) AS active_asset_id",
        "book_id * 100 + 1 AS reference_char_id",
        "int(book_id % 4) AS reference_version",
    )


@query(
    "prj_8_character_image_status",
    """SELECT c.id, c.character_id, c.name, c.image_status, n.id AS asset_id, n.role AS asset_role, n.status AS asset_status
       FROM story_character c LEFT JOIN newest n ON n.char_id = c.id""",
    newest=NEWEST,
)
def _(v: Views):
    return images.character_status(v.character, v.asset).select(
        "id", "character_id", "name", "image_status", "asset_id", "asset_role", "asset_status"
    )


@query(
    "jn_7_latest_asset_and_profile",
    """SELECT b.book_id, coalesce(p.reference_status, 'NONE') AS reference_status, p.active_asset_id, coalesce(p.reference_version, 0) AS reference_version,
         coalesce(p.reference_status, 'NONE') = 'APPROVED' AND p.active_asset_id IS NOT NULL AS can_fanout
       FROM book b LEFT JOIN profile p USING (book_id)""",
    profile=PROFILE,
)
def _(v: Views):
    return images.book_status(v.book, profiles(v)).drop("reference_char_id")


@query("flt_15_skip_finished", "SELECT id FROM story_character WHERE NOT coalesce(profile_image <> '' AND image_status = 'COMPLETED', false)")
def _(v: Views):
    return images.without_finished(v.character).select("id")


@query(
    "ag_16_max_attempt",
    "SELECT char_id, role, CAST(max(id % 6) AS BIGINT) AS max_attempt FROM asset GROUP BY 1, 2",
)
def _(v: Views):
    return images.max_attempts(v.asset.withColumn("attempt_no", C("id") % 6))


@query(
    "wn_5_attempt_number",
    """SELECT id, row_number() OVER (PARTITION BY char_id, role ORDER BY id) + coalesce(m.prior, 0) AS attempt_no FROM asset
       LEFT JOIN (SELECT char_id, role, CAST(char_id % 3 AS BIGINT) AS prior FROM asset GROUP BY 1, 2) m USING (char_id, role)""",
)
def _(v: Views):
    stored = v.asset.select("char_id", "role").distinct().withColumn("attempt_no", C("char_id") % 3)
    return images.numbered_attempts(v.asset, stored).select("id", "attempt_no")


@query("se_3_characters_by_asset_status", "SELECT book_id, char_id, max(created_at) AS newest FROM asset WHERE status IN ('FAILED', 'QA_FAILED', 'REVIEW_REQUIRED') GROUP BY 1, 2")
def _(v: Views):
    return images.characters_with_status(v.asset, status.RETRYABLE)


SELECTION = "SELECT DISTINCT user_id // 25 AS book_id, user_id // 25 * 100 + k % 40 + CASE WHEN k % 7 = 0 THEN 100 ELSE 0 END AS char_id FROM activity"


def selection(v: Views):
    return v.activity.selectExpr("user_id div 25 AS book_id", "user_id div 25 * 100 + k % 40 + if(k % 7 = 0, 100, 0) AS char_id").distinct()


CHECKED = """SELECT s.book_id, s.char_id, CASE WHEN c.id IS NULL THEN 'unknown' ELSE 'other book' END AS problem FROM selection s
    LEFT JOIN story_character c ON c.id = s.char_id WHERE c.id IS NULL OR c.book_id <> s.book_id"""


@query("jn_23_selected_characters", CHECKED, selection=SELECTION)
def _(v: Views):
    return images.check_selection(selection(v), v.character)


@query("se_4_missing_ids", "SELECT char_id FROM selection WHERE char_id NOT IN (SELECT id FROM story_character)", selection=SELECTION)
def _(v: Views):
    return selection(v).select("char_id").join(v.character.select(C("id").alias("char_id")), "char_id", "left_anti")


@query("st_10_default_reference", "SELECT book_id, id FROM story_character QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY is_main DESC, name, id) = 1")
def _(v: Views):
    return images.default_reference(v.character).select("book_id", "id")


@query("st_11_limit_per_book", "SELECT book_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY is_main DESC, name, id) AS rank FROM story_character) WHERE rank <= book_id % 5 + 2")
def _(v: Views):
    rows = v.character.withColumn("allowed", C("book_id") % 5 + 2)
    order = [F.desc("is_main"), F.asc("name"), F.asc("id")]
    return top_per_key(rows, ["book_id"], order, "allowed", "id").select("book_id", "id", F.col("rank").cast("bigint").alias("rank"))


# Characters asked for by name; one book in three names some that it does not have.
FAN_SELECTION = """SELECT event_id // 85 AS book_id, event_id // 85 * 100 + event_id * event_id % 13 + CASE WHEN event_id // 85 % 9 = 4 AND k % 7 = 0 THEN 101
    WHEN event_id // 85 % 9 = 7 AND k % 7 = 0 THEN 51 ELSE 1 END AS char_id, event_id AS position FROM activity WHERE event_id // 85 % 12 <> 4"""
FAN_ASSET = "SELECT id // 85 * 100 + id % 25 + 1 AS char_id, status, created_at FROM asset"
REQUEST = """SELECT book_id, ([' ', 'ALL', ' STALE_ONLY', 'FAILED_ONLY', 'SELECTED', 'page', 'SELECTED'])[book_id % 7 + 1] AS scope,
    book_id % 2 = 0 AS overwrite, CASE WHEN book_id % 3 = 0 THEN 4 END AS max_targets, CASE WHEN book_id % 13 = 7 THEN 'LATER' END AS policy FROM profile"""
PROBLEM = """SELECT r.book_id, CASE WHEN r.scope = 'page' THEN 'scope' WHEN r.policy = 'LATER' THEN 'policy'
      WHEN p.reference_status <> 'APPROVED' OR p.active_asset_id IS NULL THEN 'no approved reference'
      WHEN r.scope <> 'SELECTED' THEN NULL WHEN r.book_id NOT IN (SELECT book_id FROM fan_selection) THEN 'no characters'
      WHEN r.book_id IN (SELECT book_id FROM fan_selection WHERE char_id NOT IN (SELECT id FROM story_character)) THEN 'unknown character'
      WHEN r.book_id IN (SELECT q.book_id FROM fan_selection q JOIN story_character c ON c.id = q.char_id WHERE c.book_id <> q.book_id) THEN 'character of another book'
    END AS problem FROM request r JOIN profile p USING (book_id)"""
TARGET = """SELECT book_id, id, scope, NOT overwrite AND profile_image IS NOT NULL AND trim(profile_image) <> '' AND scope NOT IN ('STALE_ONLY', 'FAILED_ONLY') AS skipped FROM (
    SELECT r.book_id, c.id, r.scope, r.overwrite, c.profile_image, r.max_targets, row_number() OVER (PARTITION BY r.book_id ORDER BY
        CASE r.scope WHEN 'STALE_ONLY' THEN s.newest WHEN 'FAILED_ONLY' THEN f.newest END DESC NULLS LAST,
        CASE r.scope WHEN 'SELECTED' THEN q.position END, c.is_main DESC, c.name, c.id) AS rank
    FROM (SELECT * REPLACE (coalesce(nullif(trim(scope), ''), 'MAIN_ONLY') AS scope) FROM request
      WHERE book_id IN (SELECT book_id FROM problem WHERE problem IS NULL)) r JOIN profile p ON p.book_id = r.book_id
    JOIN story_character c ON c.book_id = r.book_id
    LEFT JOIN (SELECT char_id, max(created_at) AS newest FROM fan_asset WHERE status IN ('STALE_REFERENCE', 'STALE_PROMPT') GROUP BY 1) s ON s.char_id = c.id
    LEFT JOIN (SELECT char_id, max(created_at) AS newest FROM fan_asset WHERE status IN ('FAILED', 'QA_FAILED', 'REVIEW_REQUIRED') GROUP BY 1) f ON f.char_id = c.id
    LEFT JOIN (SELECT book_id, char_id, min(position) AS position FROM fan_selection GROUP BY 1, 2) q ON q.book_id = r.book_id AND q.char_id = c.id
    WHERE c.id <> p.reference_char_id AND CASE r.scope WHEN 'MAIN_ONLY' THEN c.is_main WHEN 'ALL' THEN true WHEN 'STALE_ONLY' THEN s.newest IS NOT NULL
        WHEN 'FAILED_ONLY' THEN f.newest IS NOT NULL ELSE q.char_id IS NOT NULL END)
    WHERE max_targets IS NULL OR rank <= max_targets"""
FANOUT = {"profile": PROFILE, "fan_selection": FAN_SELECTION, "fan_asset": FAN_ASSET, "request": REQUEST, "problem": PROBLEM, "target": TARGET}


def fan_selection(v: Views):
    return v.activity.filter("event_id div 85 % 12 <> 4").selectExpr(
        "event_id div 85 AS book_id",
        """event_id div 85 * 100 + event_id * event_id % 13 + CASE WHEN event_id div 85 % 9 = 4 AND k % 7 = 0 THEN 101
           WHEN event_id div 85 % 9 = 7 AND k % 7 = 0 THEN 51 ELSE 1 END AS char_id""",
        "event_id AS position",
    )


def requests(v: Views):
    return profiles(v).selectExpr(
        "book_id",
        "element_at(array(' ', 'ALL', ' STALE_ONLY', 'FAILED_ONLY', 'SELECTED', 'page', 'SELECTED'), int(book_id % 7) + 1) AS scope",
        "book_id % 2 = 0 AS overwrite",
        "if(book_id % 3 = 0, 4, null) AS max_targets",
        "if(book_id % 13 = 7, 'LATER', null) AS policy",
    )


def fan_assets(v: Views):
    return v.asset.withColumns({"book_id": F.expr("id div 85"), "char_id": F.expr("id div 85 * 100 + id % 25 + 1")})


def targets(v: Views):
    return images.fanout_targets(requests(v), v.character, fan_assets(v), profiles(v), fan_selection(v))


@query("mu_17_fanout_problems", "SELECT book_id, problem FROM problem WHERE problem IS NOT NULL", **FANOUT)
def _(v: Views):
    return images.fanout_problems(requests(v), v.character, profiles(v), fan_selection(v))


@query("mu_17_fanout_targets", "SELECT book_id, id, scope, skipped FROM target", **FANOUT)
def fanout(v: Views):
    return targets(v)


@query(
    "ag_15_fanout_totals",
    """SELECT book_id, count(*) AS target_count, count(*) FILTER (NOT skipped AND id % 3 <> 0) AS success_count,
         count(*) FILTER (NOT skipped AND id % 3 = 0) AS failed_count, count(*) FILTER (skipped) AS skipped_count FROM target GROUP BY 1""",
    **FANOUT,
)
def _(v: Views):
    outcomes = v.character.selectExpr("id", "element_at(array('FAILED', 'QA_PASSED', 'PUBLISHED'), int(id % 3) + 1) AS status")
    return images.fanout_totals(targets(v), outcomes)


ACTION = """SELECT event_id // 4 AS id, event_id AS seq, (['generated', 'qa_pass', 'qa_fail', 'publish', 'approve', 'reject', 'fail', 'publish'])[k % 8 + 1] AS action,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || event_id END AS url, 'F' || event_id AS failure_code FROM activity"""


@query(
    "mu_14_asset_transitions",
    """SELECT a.id, CASE WHEN p.seq IS NOT NULL AND (l.seq IS NULL OR p.seq > l.seq) AND coalesce(l.status, a.status) IN ('QA_PASSED', 'APPROVED', 'PUBLISHED')
           AND trim(coalesce(CASE WHEN g.seq IS NULL THEN a.url ELSE g.url END, '')) <> '' THEN 'PUBLISHED' ELSE coalesce(l.status, a.status) END AS status,
         CASE WHEN g.seq IS NULL THEN a.url ELSE g.url END AS url,
         CASE WHEN c.seq IS NOT NULL AND c.action <> 'qa_pass' THEN c.failure_code END AS failure_code
       FROM asset a
       LEFT JOIN (SELECT id, seq, CASE action WHEN 'generated' THEN 'QA_PENDING' WHEN 'qa_pass' THEN 'QA_PASSED' WHEN 'qa_fail' THEN 'QA_FAILED'
            WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE 'FAILED' END AS status FROM action WHERE action <> 'publish'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l USING (id)
       LEFT JOIN (SELECT id, max(seq) AS seq FROM action WHERE action = 'publish' GROUP BY 1) p USING (id)
       LEFT JOIN (SELECT * FROM action WHERE action = 'generated' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) g USING (id)
       LEFT JOIN (SELECT * FROM action WHERE action IN ('qa_pass', 'qa_fail', 'fail') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) c USING (id)""",
    action=ACTION,
)
def asset_transitions(v: Views):
    actions = v.activity.selectExpr(
        "event_id div 4 AS id",
        "event_id AS seq",
        "element_at(array('generated', 'qa_pass', 'qa_fail', 'publish', 'approve', 'reject', 'fail', 'publish'), k % 8 + 1) AS action",
        "if(event_id % 3 = 0, null, concat('u', event_id)) AS url",
        "concat('F', event_id) AS failure_code",
    )
    stored = v.asset.withColumn("failure_code", F.lit(None).cast("string"))
    return images.replay_assets(stored, actions).select("id", "status", "url", "failure_code")


PACTION = """SELECT user_id // 25 AS book_id, event_id AS seq, (['generating', 'qa_pass', 'qa_fail', 'approve', 'reject'])[k % 5 + 1] AS action,
    event_id % 2 AS asset_id, user_id AS char_id FROM activity"""


@query(
    "mu_15_profile_transitions",
    """SELECT coalesce(p.book_id, l.book_id) AS book_id, coalesce((['CANDIDATE_GENERATING', 'QA_PASSED', 'QA_FAILED', 'APPROVED', 'REJECTED'])[list_position(['generating', 'qa_pass', 'qa_fail', 'approve', 'reject'], l.action)], p.reference_status) AS reference_status,
         coalesce(s.asset_id, p.active_asset_id) AS active_asset_id, coalesce(h.char_id, p.reference_char_id) AS reference_char_id,
         CAST(coalesce(p.reference_version, 0) + coalesce(n.approvals, 0) AS INT) AS reference_version
       FROM profile p FULL JOIN (SELECT * FROM paction QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) = 1) l ON l.book_id = p.book_id
       LEFT JOIN (SELECT * FROM paction WHERE action IN ('qa_pass', 'approve') QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) = 1) s ON s.book_id = coalesce(p.book_id, l.book_id)
       LEFT JOIN (SELECT * FROM paction WHERE action <> 'reject' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) = 1) h ON h.book_id = coalesce(p.book_id, l.book_id)
       LEFT JOIN (SELECT book_id, count(*) FILTER (action = 'approve' AND NOT coalesce(asset_id = held, false)) AS approvals
          FROM (SELECT a.*, CASE coalesce(lag(a.action) OVER w, p.reference_status) WHEN 'approve' THEN lag(a.asset_id) OVER w WHEN 'APPROVED' THEN p.active_asset_id END AS held
                FROM paction a LEFT JOIN profile p USING (book_id) WINDOW w AS (PARTITION BY a.book_id ORDER BY a.seq)) GROUP BY 1) n ON n.book_id = coalesce(p.book_id, l.book_id)""",
    profile=PROFILE,
    paction=PACTION,
)
def _(v: Views):
    actions = v.activity.selectExpr(
        "user_id div 25 AS book_id", "event_id AS seq",
        "element_at(array('generating', 'qa_pass', 'qa_fail', 'approve', 'reject'), k % 5 + 1) AS action",
        "event_id % 2 AS asset_id", "user_id AS char_id",
    )
    return images.replay_profiles(profiles(v), actions)


def approval_tables(v: Views):
    """Eight assets make a book; three books in four have a reference, each asks for four approvals in order."""
    assets = v.asset.selectExpr(
        "id", "id div 8 AS book_id", "char_id", "role", "status", "url", "id div 8 * 8 + id * 3 % 8 AS source_asset_id"
    )
    books = assets.select("book_id").distinct()
    held = books.filter("book_id % 4 <> 3").selectExpr(
        "book_id", "book_id * 8 + book_id % 8 AS active_asset_id", "if(book_id % 5 = 0, 'REJECTED', 'APPROVED') AS reference_status", "2 AS reference_version", "0L AS reference_char_id"
    )
    asked = books.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    approvals = asked.selectExpr("book_id", "seq", "book_id * 8 + (book_id * 5 + seq * seq * (book_id % 3)) % 8 + if(book_id % 11 = seq, 8, 0) AS asset_id")
    return assets, held, approvals


APPROVAL_VIEWS = {
    "seed": "SELECT id, id // 8 AS book_id, char_id, role, status, url, id // 8 * 8 + id * 3 % 8 AS source_asset_id FROM asset",
    "held": """SELECT DISTINCT book_id, book_id * 8 + book_id % 8 AS active_asset_id, CASE WHEN book_id % 5 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS state
        FROM seed WHERE book_id % 4 <> 3""",
    "approval": """SELECT book_id, seq, book_id * 8 + (book_id * 5 + seq * seq * (book_id % 3)) % 8 + CASE WHEN book_id % 11 = seq THEN 8 ELSE 0 END AS asset_id
        FROM (SELECT DISTINCT book_id FROM seed), range(4) numbers(seq)""",
    # One approval after another, each on the state that the one before has left.
    "judged": """WITH RECURSIVE step AS (
          SELECT book_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS asset_id, CAST(NULL AS VARCHAR) AS verdict, h.active_asset_id AS active,
            h.state, coalesce(h.version, 0) AS version, CAST([] AS BIGINT[]) AS gone
          FROM (SELECT DISTINCT book_id FROM seed) b LEFT JOIN (SELECT *, 2 AS version FROM held) h USING (book_id)
          UNION ALL
          SELECT book_id, seq, asset_id, verdict, CASE WHEN verdict = 'approved' THEN asset_id ELSE active END,
            CASE WHEN verdict = 'approved' THEN 'APPROVED' ELSE state END, version + CASE WHEN verdict = 'approved' THEN 1 ELSE 0 END,
            CASE WHEN verdict = 'approved' AND active <> asset_id THEN list_append(gone, active) ELSE gone END
          FROM (SELECT p.book_id, p.seq, p.asset_id, t.active, t.state, t.version, t.gone,
              CASE WHEN s.role IS NULL THEN 'not in book' WHEN s.role <> 'REFERENCE_SEED' THEN 'role'
                WHEN list_contains(t.gone, p.asset_id) OR s.status NOT IN ('QA_PASSED', 'APPROVED', 'PUBLISHED') THEN 'status'
                WHEN trim(coalesce(s.url, '')) = '' THEN 'no image' WHEN t.state = 'APPROVED' AND t.active = p.asset_id THEN 'again' ELSE 'approved' END AS verdict
            FROM step t JOIN approval p ON p.book_id = t.book_id AND p.seq = t.seq + 1 LEFT JOIN seed s ON s.id = p.asset_id AND s.book_id = p.book_id))
        SELECT * FROM step""",
    "ended": "SELECT * FROM judged WHERE seq = 3",
    "replaced": "SELECT DISTINCT unnest(gone) AS id FROM ended",
}


@query("mu_13_approval_verdicts", "SELECT book_id, seq, asset_id, verdict FROM judged WHERE seq >= 0", **APPROVAL_VIEWS)
def _(v: Views):
    return images.approve_references(*approval_tables(v))["verdicts"].withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "mu_13_reference_approval",
    """SELECT s.id, CASE WHEN s.id IN (SELECT id FROM replaced) THEN 'SUPERSEDED'
         WHEN s.id IN (SELECT asset_id FROM judged WHERE verdict IN ('approved', 'again')) THEN 'PUBLISHED'
         WHEN s.source_asset_id IN (SELECT id FROM replaced) AND s.status IN ('QA_PASSED', 'APPROVED', 'PUBLISHED') THEN 'STALE_REFERENCE' ELSE s.status END AS status
       FROM seed s""",
    **APPROVAL_VIEWS,
)
def _(v: Views):
    return images.approve_references(*approval_tables(v))["assets"].select("id", "status")


@query(
    "mu_13_reference_versions",
    """SELECT book_id, active AS active_asset_id, state AS reference_status, CAST(version AS INT) AS reference_version FROM ended WHERE active IS NOT NULL""",
    **APPROVAL_VIEWS,
)
def _(v: Views):
    return images.approve_references(*approval_tables(v))["profiles"].select("book_id", "active_asset_id", "reference_status", "reference_version")


@query(
    "mu_20_publish_images",
    """SELECT c.id, coalesce(n.url, c.profile_image) AS profile_image, CASE WHEN n.url IS NOT NULL THEN 'COMPLETED' ELSE c.image_status END AS image_status
       FROM story_character c LEFT JOIN (SELECT * FROM newest WHERE status = 'PUBLISHED' AND trim(url) <> '') n ON n.char_id = c.id""",
    newest=NEWEST,
)
def _(v: Views):
    fresh = images.latest_assets(v.asset).filter((C("status") == "PUBLISHED") & status.has_image(C("url")))
    return images.publish_images(v.character, fresh.select(C("char_id").alias("id"), C("url").alias("profile_image"))).select(
        "id", "profile_image", "image_status"
    )


@query(
    "mu_14_failed_fallback",
    """SELECT c.id, CASE WHEN n.id IS NOT NULL THEN 'fallback.png' ELSE c.profile_image END AS profile_image,
         CASE WHEN n.id IS NOT NULL THEN 'FAILED' ELSE c.image_status END AS image_status
       FROM story_character c LEFT JOIN (SELECT * FROM newest WHERE status = 'FAILED') n ON n.char_id = c.id""",
    newest=NEWEST,
)
def _(v: Views):
    failed = images.latest_assets(v.asset).filter(C("status") == "FAILED").select(C("char_id").alias("id"))
    return images.fail_images(v.character, failed, "fallback.png").select("id", "profile_image", "image_status")
