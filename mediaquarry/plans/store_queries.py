"""Record tables, edits, history, requests, cache and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.capture import wall_clock_ms
from ..functions.paths import supports_embedded_write
from ..operators import cache, lineage, manifest, projection, requests, versions
from ..operators.ordering import ordered_positions
from ..session import cut_lineage, shared_dir
from ..sources import adapters, records as record_files
from . import base_sql as q
from .registry import query

_d = lambda: F.substring("id", 2, 20).cast("bigint")


# --- record files and projection ------------------------------------------------------------


@query(f"""WITH {q.DOC} SELECT id, CASE WHEN doc_id % 41 = 3 THEN 'corruptData' WHEN doc_id % 41 = 7 THEN 'invalidId' ELSE 'none' END AS problem,
  CASE WHEN doc_id % 41 IN (3, 7) THEN -1 ELSE size_bytes END AS size_bytes,
  CASE WHEN doc_id % 41 IN (3, 7) THEN '' ELSE text END AS caption,
  CASE WHEN doc_id % 41 IN (3, 7) THEN -1 ELSE coalesce(wall_ms, -1) END AS wall_ms,
  CASE WHEN doc_id % 41 IN (3, 7) THEN -1 ELSE coalesce(last_modified_ms, -1) END AS last_modified_ms,
  CAST(CASE WHEN doc_id % 41 IN (3, 7) OR doc_id % 4 = 0 THEN 0 ELSE 3 END AS INTEGER) AS operations,
  CASE WHEN doc_id % 41 IN (3, 7) THEN '' ELSE CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END END AS extra,
  CASE WHEN doc_id % 41 IN (3, 7) THEN '' ELSE {q.kind('file_name')} END AS kind FROM doc""")
def scan_records(t):
    """Record JSON read back with the explicit schema; broken files become problem rows."""
    n = _d()
    texts = adapters.records(t).select("id", record_files.record_json().alias("json")).select(
        F.col("id").alias("key"),
        F.when(n % 41 == 3, F.substring("json", 1, 30)).when(n % 41 == 7, "{}").otherwise(F.col("json")).alias("json"),
    )
    parsed = record_files.parse_records(texts)
    good = F.col("problem").isNull()
    return parsed.select(
        F.col("key").alias("id"), F.coalesce("problem", F.lit("none")).alias("problem"),
        F.col("identity.size_bytes").alias("size_bytes"), F.col("metadata.caption").alias("caption"),
        F.coalesce(wall_clock_ms(F.col("metadata.capture_time.wall_clock")), F.lit(-1)).alias("wall_ms"),
        F.coalesce("identity.last_modified_ms", F.lit(-1)).alias("last_modified_ms"),
        F.size("recipe.operations").alias("operations"),
        F.coalesce(F.get_json_object(F.col("extras")["x-lang"], "$.lang"), F.lit("")).alias("extra"),
        F.when(good, F.col("metadata.kind")).otherwise("").alias("kind"),
    )


@query(f"""WITH {q.DOC} SELECT id, size_bytes, text AS caption, coalesce(wall_ms, -1) AS wall_ms,
  coalesce(last_modified_ms, -1) AS last_modified_ms, {q.kind('file_name')} AS kind FROM doc""")
def write_records(t):
    """Every record written to the packed table and read back from it."""
    folder = f"{shared_dir(t.spark)}/records-{uuid.uuid4().hex}"
    record_files.write_records(adapters.records(t), folder)
    good, _ = record_files.scan_records(t.spark, folder, packed=True)
    return good.select(
        "id", F.col("identity.size_bytes").alias("size_bytes"), F.col("metadata.caption").alias("caption"),
        F.coalesce(wall_clock_ms(F.col("metadata.capture_time.wall_clock")), F.lit(-1)).alias("wall_ms"),
        F.coalesce("identity.last_modified_ms", F.lit(-1)).alias("last_modified_ms"), F.col("metadata.kind").alias("kind"),
    )


@query(f"""WITH {q.MEDIA} SELECT 'media' AS tbl, count(*) AS rows FROM media
UNION ALL SELECT 'media_tag', count(*) FROM (SELECT DISTINCT id, unnest([lang, source]) AS tag FROM media)
UNION ALL SELECT 'media_len', count(*) FROM media""")
def build_projection(t):
    """Write a snapshot, swap the pointer, read it back."""
    base = f"{shared_dir(t.spark)}/projection-{uuid.uuid4().hex}"
    projection.build_projection(adapters.records(t), base)
    tables = projection.open_projection(t.spark, base)
    counts = [
        tables[name].agg(F.lit(name).alias("tbl"), F.count("*").alias("rows"))
        for name in ("media", "media_tag", "media_len")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {q.DOC} SELECT true AS reordered_is_same, true AS edited_differs, true AS doubled_differs, count(*) AS records FROM doc")
def state_token(t):
    r = adapters.records(t)
    edited = r.withColumn("original_storage", F.when(_d() == 1, "edited").otherwise(F.col("original_storage")))
    doubled = r.unionByName(r.where(_d() == 1))
    token = lambda df: projection.state_token(df).scalar()
    return projection.state_token(r).select(
        (F.col("state_token") == token(r.repartition(7, "id"))).alias("reordered_is_same"),
        (F.col("state_token") != token(edited)).alias("edited_differs"),
        (F.col("state_token") != token(doubled)).alias("doubled_differs"),
        F.split_part("state_token", F.lit(":"), F.lit(1)).cast("bigint").alias("records"),
    )


@query(f"WITH {q.DOC} SELECT step, true AS as_whole_table, step > 0 AS moved_on, (SELECT count(*) FROM doc WHERE doc_id % 4 <> 3 OR step > 1) AS records FROM range(3) s(step)")
def state_token_kept_up(t):
    """The token carried from batch to batch equals the token of the whole table after each."""
    r, d = adapters.records(t), F.substring("id", 2, 20).cast("bigint")
    edited = lambda rows, by: rows.withColumn("original_storage", F.lit(by))
    table = r.where(d % 4 != 3)
    batches = [r.limit(0), edited(r.where(d % 4 == 1), "first"), edited(r.where(d % 4 != 0), "second")]
    token = start = projection.state_token(table).first()[0]
    rows = []
    for step, batch in enumerate(batches):
        table, after = versions.apply_with_token(table, batch, token)
        token = after.first()[0]
        rows.append(projection.state_token(table).select(
            F.lit(step).cast("bigint").alias("step"), (F.col("state_token") == token).alias("as_whole_table"),
            F.lit(token != start).alias("moved_on"), F.split_part("state_token", F.lit(":"), F.lit(1)).cast("bigint").alias("records"),
        ))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- upsert and commit ------------------------------------------------------------------------


def _simple(t):
    return t.documents.select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("id"), "text", F.lit(0).alias("version"))


_SIMPLE = f"WITH {q.DOC}"


@query(f"""{_SIMPLE} SELECT id, CASE WHEN doc_id % 2 = 0 THEN text || '/2' ELSE text END AS text,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS version FROM doc WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def apply_records(t):
    base = _simple(t)
    batch = base.where(_d() % 2 == 0).select(
        "id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "text"
    ).select("id", F.concat("text", F.lit("/"), F.col("version").cast("string")).alias("text"), "version", F.col("version").alias("seq"))
    return versions.apply_records(base.where(_d() % 3 != 0), batch, "seq")


@query(f"""{_SIMPLE} SELECT id, CASE WHEN doc_id % 4 = 1 THEN text || '!' ELSE text END AS text,
  CAST(CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS version FROM doc
WHERE doc_id % 4 = 1 OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0)""")
def commit_staged(t):
    base = _simple(t)
    staged = base.where(_d() % 4 == 1).select("id", F.concat("text", F.lit("!")).alias("text"), F.lit(1).alias("version"))
    return versions.commit_staged(base.where(_d() % 3 != 0), staged, base.where(_d() % 5 == 0))


@query(f"{_SIMPLE} SELECT id, text, CAST(0 AS INTEGER) AS version FROM doc WHERE doc_id % 3 <> 0")
def restore_version(t):
    """Commit twice, then point back at the first version."""
    base = f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    rows = _simple(t)
    nothing = rows.limit(0).select("id")
    first = versions.commit(t.spark, base, rows.where(_d() % 3 != 0), nothing)
    versions.commit(t.spark, base, rows.where(_d() % 3 == 0), rows.where(_d() % 2 == 0).select("id"))
    versions.restore(t.spark, base, first)
    return versions.read_version(t.spark, base)


# --- edits ------------------------------------------------------------------------------------


def _staged_edits(t):
    r = adapters.records(t)
    wanted = t.labels.select(
        F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("id"), "quality", "toxic"
    )
    edits = wanted.join(r.select("id", "metadata", "recipe"), "id", "left").select(
        "id", F.col("metadata").withField("rating", (F.col("quality") * 7 - 1).cast("int")).alias("metadata"),
        F.when(F.col("toxic") == 1, F.col("recipe").withField("operations", F.array(F.struct(
            F.lit("rotate").alias("kind"), F.lit('{"degrees":90}').alias("parameters")
        )))).otherwise(F.col("recipe")).alias("recipe"),
    )
    return versions.stage_edits(edits, r), r


_EDIT = f"""WITH {q.DOC}, e AS (SELECT d.*, l.quality, l.toxic, d.doc_id % 6 <> 0 AS managed,
  l.toxic = 1 AS recipe_changed, greatest(0, least(5, l.quality * 7 - 1)) AS new_rating FROM doc d JOIN labels l USING (doc_id)),
g AS (SELECT *, CASE WHEN doc_id % 43 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'changed' WHEN doc_id % 17 = 0 THEN 'content' ELSE 'none' END AS conflict FROM e WHERE managed)"""


@query(f"""{_EDIT} SELECT id, CAST(new_rating AS INTEGER) AS rating, CAST(doc_id % 4 + CAST(recipe_changed AS INTEGER) AS INTEGER) AS revision,
  CASE WHEN managed THEN 'none' ELSE 'unsupportedMedia' END AS problem FROM e""")
def stage_edits(t):
    staged, _ = _staged_edits(t)
    return staged.select(
        "id", "metadata.rating", "recipe.revision", F.coalesce("problem", F.lit("none")).alias("problem")
    )


@query(f"""{_EDIT} SELECT id, CAST(greatest(0, least(5, quality * 3 - 1)) AS INTEGER) AS rating,
  CAST(greatest(0, least(5, doc_id % 9 - 2)) AS INTEGER) AS base_rating FROM e WHERE managed""")
def stage_edits_again(t):
    """A second edit, while the records have changed, against the base of the first one."""
    first, r = _staged_edits(t)
    asked = first.where("problem IS NULL").select(
        "id", F.col("metadata").withField("rating", F.when(F.col("metadata.rating") > 0, 2).otherwise(-1)).alias("metadata"), "recipe"
    )
    changed = r.withColumn("metadata", F.col("metadata").withField("rating", F.lit(4)))
    again = versions.stage_edits(asked, changed, first)
    return again.select("id", "metadata.rating", F.greatest(F.lit(0), F.least(F.lit(5), F.col("base_metadata.rating"))).alias("base_rating"))


def _checked(t):
    staged, r = _staged_edits(t)
    n = _d()
    now = r.where(n % 43 != 0).withColumn("metadata", F.when(
        n % 13 == 0, F.col("metadata").withField("caption", F.lit("edited elsewhere"))
    ).otherwise(F.col("metadata")))
    contents = r.select("id", F.when(n % 17 == 0, F.lit("other")).otherwise(F.col("fingerprint.digest")).alias("digest"))
    return versions.edit_conflicts(staged.where("problem IS NULL"), now, contents)


@query(f"{_EDIT} SELECT id, conflict FROM g")
def edit_conflicts(t):
    return _checked(t).select("id", F.coalesce("conflict", F.lit("none")).alias("conflict"))


@query(f"""{_EDIT}, u AS (SELECT *, doc_id % 37 <> 0 AND {q.suffix('file_name')} IN ({q.quoted(fv.EMBEDDED_WRITE_EXTENSIONS)}) AS writable,
  true AS rewritten FROM g)
SELECT count(*) AS edits, CAST(count(*) FILTER (conflict <> 'none') AS BIGINT) AS conflicts,
  CAST(count(*) FILTER (conflict = 'none' AND {q.suffix("regexp_extract(file_name, '[^/]*$')")} NOT IN ({q.quoted(fv.EMBEDDED_WRITE_EXTENSIONS)})) AS BIGINT) AS unsupported,
  'conflict' AS error FROM u""")
def save_gate(t):
    return versions.save_gate(_checked(t))


@query(f"""{_EDIT} SELECT d.id, CAST(CASE WHEN s.id IS NULL THEN d.doc_id % 9 - 2 ELSE s.new_rating END AS INTEGER) AS rating,
  CASE WHEN s.id IS NULL THEN d.digest ELSE sha256(d.lang) END AS digest
FROM doc d LEFT JOIN (SELECT * FROM g WHERE conflict = 'none' AND {q.suffix('file_name')} IN ({q.quoted(fv.EMBEDDED_WRITE_EXTENSIONS)})) s ON s.id = d.id""")
def save_edits(t):
    """The part of the batch that has no conflict and a writable format, saved as one batch."""
    clean = _checked(t).where(F.col("conflict").isNull() & supports_embedded_write(F.col("base_path")))
    r = adapters.records(t)
    digests = clean.select("id", F.sha2(F.col("metadata.tags")[0], 256).alias("digest"))
    saved = versions.save_edits(clean, r, digests)
    return saved.select("id", "metadata.rating", "fingerprint.digest")


@query("""SELECT step, error, changed, (SELECT count(*) FROM conversations) + CAST(changed AS BIGINT) AS checkpoints
FROM (VALUES ('whole', 'conflict', false), ('clean', 'none', true)) v(step, error, changed)""")
def save_gated(t):
    """The whole batch holds conflicts, so it is refused and leaves records and checkpoints as they
    were; its clean part is saved and adds its checkpoint."""
    checked, r = cut_lineage(_checked(t)), adapters.records(t)
    clean = checked.where(F.col("conflict").isNull() & supports_embedded_write(F.col("base_path")))
    log = t.conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("message"), (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("created_at_ms"),
    )
    token, rows = projection.state_token(r).first()[0], []
    for step, part in (("whole", checked), ("clean", clean)):
        digests = part.select("id", F.sha2(F.col("metadata.tags")[0], 256).alias("digest"))
        try:
            saved, after = versions.save_with_checkpoint(
                part, r, digests, log, "edits", None, "1.0", "saved", 9_000_000_000, "checkpoint:"
            )
            error = "none"
        except versions.Conflict as refused:
            saved, after, error = r, log, str(refused).split(":")[0]
        count = after.agg(F.count("*")).scalar()
        rows.append(projection.state_token(saved).select(
            F.lit(step).alias("step"), F.lit(error).alias("error"), (F.col("state_token") != token).alias("changed"),
            count.alias("checkpoints"),
        ))
    return rows[0].unionByName(rows[1])


@query(f"""WITH {q.DOC} SELECT '/library/' || source || '/' || file_name || '#' || id AS path, doc_id % 4 <> 1 AND doc_id % 9 <> 5 AND doc_id % 8 <> 6 AS verified FROM doc""")
def verify_written(t):
    n = _d()
    m = F.col("metadata")
    path = F.concat("identity.absolute_path", F.lit("#"), "id").alias("path")
    r = adapters.records(t)
    asked = r.select(path, m["rating"].alias("rating"), m["caption"].alias("caption"), m["tags"].alias("tags"))
    reread = r.where(n % 8 != 6).select(
        path, F.when(n % 4 == 1, 9).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), m["rating"]))).alias("rating"),
        F.when(n % 9 == 5, F.concat(m["caption"], F.lit("?"))).otherwise(m["caption"]).alias("caption"),
        F.array_distinct(m["tags"]).alias("tags"),
    )
    return versions.verify_written(asked, reread)


# --- originals --------------------------------------------------------------------------------


def _originals(t):
    n = _d()
    r = adapters.records(t).select(
        "id", F.col("original_storage").alias("storage"),
        F.concat(F.lit("originals/"), F.col("id")).alias("managed_path"), F.col("fingerprint.digest").alias("digest"),
    )
    committed = r.where(n % 3 != 0).withColumn("digest", F.when(n % 7 == 0, F.lit("old")).otherwise(F.col("digest")))
    staged_files = r.where(n % 2 == 0).select(
        F.lit("staged").alias("area"),
        F.when(n % 12 == 0, F.concat("managed_path", F.lit(".part"))).when(n % 20 == 0, F.concat("managed_path", F.lit("-lost")))
        .otherwise(F.col("managed_path")).alias("managed_path"), "digest",
    )
    committed_files = r.where(n % 5 != 0).select(
        F.lit("committed").alias("area"), "managed_path", F.when(n % 14 == 7, F.lit("old")).otherwise(F.col("digest")).alias("digest")
    )
    return r, committed, staged_files, committed_files


@query(f"""WITH {q.DOC}, s AS (SELECT *, doc_id % 2 = 0 AND doc_id % 12 <> 0 AND doc_id % 20 <> 0 AS has_staged,
  doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS keeps FROM doc WHERE doc_id % 6 <> 0)
SELECT id, 'originals/' || id AS managed_path, CASE WHEN NOT keeps THEN 'corruptData' ELSE 'conflict' END AS problem
FROM s WHERE NOT has_staged AND (NOT keeps OR (doc_id % 7 = 0 AND doc_id % 14 = 7))""")
def staged_original_check(t):
    staged, committed, staged_files, committed_files = _originals(t)
    return versions.staged_original_check(staged, committed, staged_files.unionByName(committed_files))


@query(f"""WITH {q.DOC}, s AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'originals/' || id || '.part'
  WHEN doc_id % 20 = 0 THEN 'originals/' || id || '-lost' ELSE 'originals/' || id END AS managed_path FROM doc WHERE doc_id % 2 = 0)
SELECT managed_path FROM s WHERE doc_id % 12 = 0 OR doc_id % 20 = 0 OR doc_id % 6 = 0""")
def orphan_originals(t):
    staged, _, staged_files, _ = _originals(t)
    return versions.orphan_originals(staged_files, staged)


# --- history ----------------------------------------------------------------------------------


def _checkpoints(t):
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return t.conversations.select(
        key.alias("id"), F.col("text").alias("message"),
        (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("created_at_ms"),
    )


_CHECKPOINT = """c AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, text AS message,
  turn * 1000000 + conv_id AS created_at_ms, conv_id, turn, role FROM conversations)"""


@query(f"WITH {_CHECKPOINT} SELECT id, message, created_at_ms FROM c ORDER BY created_at_ms DESC, id DESC LIMIT 25")
def history(t):
    return versions.history(_checkpoints(t), 25)


@query(f"""WITH {_CHECKPOINT} SELECT id, message, 'unknown' AS author_id, '' AS application_version, '' AS parent_id, created_at_ms FROM c
UNION ALL SELECT 'next', 'Scan: /library', 'me', '1.0', (SELECT id FROM c ORDER BY created_at_ms DESC, id DESC LIMIT 1), 9000000000""")
def checkpoint_append(t):
    prefix = "mediaquarry-checkpoint-v1:"
    grown = versions.checkpoint_append(_checkpoints(t), "Scan: /library", "me", "1.0", "next", 9_000_000_000, prefix)
    return versions.decode_history(grown, prefix)


@query(f"""WITH {_CHECKPOINT}, p AS (SELECT *, CASE WHEN turn = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) || '/' || CAST(turn - 1 - CAST(turn % 5 = 4 AS INTEGER) AS VARCHAR) END AS parent_id FROM c)
SELECT conv_id AS library, id, parent_id = coalesce(lag(id) OVER (PARTITION BY conv_id ORDER BY created_at_ms, id), '') AS linked FROM p""")
def history_chain(t):
    skip = F.when(F.col("turn") % 5 == 4, 1).otherwise(0)
    parent = F.when(F.col("turn") == 0, "").otherwise(
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") - 1 - skip).cast("string"))
    )
    rows = t.conversations.select(
        F.col("conv_id").alias("library"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"),
        parent.alias("parent_id"), (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("created_at_ms"),
    )
    return versions.history_chain(rows).select("library", "id", "linked")


_LINKS = f"""{_CHECKPOINT}, p AS (SELECT conv_id AS library, id, CASE
  WHEN turn = 0 AND conv_id % 7 = 3 THEN CAST(conv_id AS VARCHAR) || '/2'
  WHEN turn = 0 THEN '' WHEN turn = 1 AND conv_id % 11 = 5 THEN CAST(conv_id AS VARCHAR) || '/gone'
  ELSE CAST(conv_id AS VARCHAR) || '/' || CAST(turn - 1 - CAST(turn % 5 = 4 AS INTEGER) AS VARCHAR) END AS parent_id FROM c)"""


@query(f"""WITH RECURSIVE {_LINKS}, steps AS (SELECT library, count(*) AS most FROM p GROUP BY library),
walk AS (SELECT library, id, id AS cur, CAST(0 AS BIGINT) AS hops FROM p
  UNION ALL SELECT w.library, w.id, p.parent_id, w.hops + 1 FROM walk w JOIN p ON p.library = w.library AND p.id = w.cur
    JOIN p up ON up.library = p.library AND up.id = p.parent_id JOIN steps s ON s.library = w.library WHERE w.hops <= s.most),
ends AS (SELECT library, id, max(hops) AS hops, bool_or(hops > 0 AND cur = id) AS ring FROM walk GROUP BY library, id)
SELECT p.library, p.id, p.parent_id, CASE WHEN e.hops <= s.most THEN e.hops END AS depth, CASE WHEN e.hops <= s.most THEN w.cur END AS start_id,
  CASE WHEN p.parent_id = '' THEN 1 ELSE (SELECT count(*) FROM p b WHERE b.library = p.library AND b.parent_id = p.parent_id) END AS siblings,
  p.parent_id <> '' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.library = p.library AND b.id = p.parent_id) AS lost,
  CASE WHEN e.ring THEN 'on' WHEN e.hops > s.most THEN 'below' END AS cycle
FROM p JOIN ends e USING (library, id) JOIN steps s USING (library) JOIN walk w ON w.library = p.library AND w.id = p.id AND w.hops = e.hops""")
def history_links(t):
    """Depth, forks, lost parents and rings of every history, by its parent links alone."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    before = turn - 1 - F.when(turn % 5 == 4, 1).otherwise(0)
    parent = (
        F.when((turn == 0) & (F.col("conv_id") % 7 == 3), F.concat(conv, F.lit("/2"))).when(turn == 0, "")
        .when((turn == 1) & (F.col("conv_id") % 11 == 5), F.concat(conv, F.lit("/gone")))
        .otherwise(F.concat(conv, F.lit("/"), before.cast("string")))
    )
    return lineage.history_links(t.conversations.select(
        F.col("conv_id").alias("library"), F.concat(conv, F.lit("/"), turn.cast("string")).alias("id"), parent.alias("parent_id"),
    ))


# --- requests ---------------------------------------------------------------------------------


def _incoming(t):
    queue = adapters.work_requests(t)
    return queue.where(F.substring("id", 2, 20).cast("bigint") % 2 == 0).select(
        F.concat(F.lit("n"), F.col("id")).alias("id"), "kind", "priority",
        F.when(F.col("priority") == 0, "running").otherwise("pending").alias("state"),
        F.when(F.col("coalescing_key") == "", "").when(F.col("priority") == 2, F.concat("coalescing_key", F.lit("-new")))
        .otherwise(F.col("coalescing_key")).alias("coalescing_key"),
        "payload", "attempts", "max_attempts", "created_at_ms", "not_before_ms", "last_error_code",
        F.col("id").alias("seq"),
    )


_INCOMING = f"""{q.REQUESTS}, inc AS (SELECT 'n' || id AS id, id AS seq, CASE WHEN priority = 0 THEN 'running' ELSE 'pending' END AS state,
  CASE WHEN coalescing_key = '' THEN '' WHEN priority = 2 THEN coalescing_key || '-new' ELSE coalescing_key END AS k FROM job WHERE event_id % 2 = 0),
pend AS (SELECT coalescing_key AS k, min(id) AS pid FROM job WHERE state = 'pending' AND coalescing_key <> '' GROUP BY 1),
fst AS (SELECT k, min(seq) AS fseq, arg_min(id, seq) AS fid FROM inc WHERE state = 'pending' AND k <> '' GROUP BY 1),
eff AS (SELECT id, CASE WHEN k = '' THEN id WHEN pid IS NOT NULL THEN pid WHEN fseq < seq THEN fid ELSE id END AS effective_id
  FROM inc LEFT JOIN pend USING (k) LEFT JOIN fst USING (k))"""


@query(f"WITH {_INCOMING} SELECT id, effective_id FROM eff")
def enqueue_coalesced(t):
    _, mapping = requests.enqueue_coalesced(adapters.work_requests(t), _incoming(t))
    return mapping


@query(f"WITH {_INCOMING} SELECT id FROM eff WHERE id = effective_id")
def enqueue_inserts(t):
    rows, _ = requests.enqueue_coalesced(adapters.work_requests(t), _incoming(t))
    return rows.select("id")


@query(f"""WITH {q.REQUESTS} SELECT id, priority FROM job WHERE state = 'pending' AND (not_before_ms IS NULL OR not_before_ms <= 1705000000000)
ORDER BY priority, created_at_ms NULLS FIRST, id LIMIT 100""")
def claimable(t):
    return requests.claimable(adapters.work_requests(t), 1_705_000_000_000, 100).select("id", "priority")


@query(f"""WITH {q.REQUESTS} SELECT id, row_number() OVER (ORDER BY priority, created_at_ms NULLS FIRST, id) - 1 AS pos FROM job WHERE state = 'pending'""")
def list_pending(t):
    waiting = adapters.work_requests(t).where("state = 'pending'").select("id", "priority", "created_at_ms")
    return ordered_positions(waiting, requests.claim_order()).select("id", "pos")


@query(f"WITH {q.REQUESTS} SELECT CAST(count(*) FILTER (state = 'pending') AS BIGINT) AS pending FROM job")
def pending_count(t):
    return requests.pending_count(adapters.work_requests(t))


@query(f"""WITH {q.REQUESTS}, o AS (SELECT *, (['succeeded', 'failed', 'cancelled', 'claimed', 'failed'])[CAST(event_id % 5 AS INTEGER) + 1] AS o,
  (['timeout', 'corruptData', 'interrupted'])[CAST(event_id % 3 AS INTEGER) + 1] AS e, event_id % 7 <> 0 AS has FROM job),
a AS (SELECT *, has AND o = 'failed' AND state = 'running' AS failed, has AND o = 'succeeded' AND state = 'running' AS won,
  has AND o = 'failed' AND state = 'running' AND e IN ('timeout', 'interrupted') AND attempts + 1 < max_attempts AS again FROM o)
SELECT id, CASE WHEN again THEN 'pending' WHEN failed THEN 'failed' WHEN won THEN 'succeeded'
    WHEN has AND o = 'cancelled' AND state IN ('pending', 'running') THEN 'cancelled'
    WHEN has AND o = 'claimed' AND state = 'pending' THEN 'running' ELSE state END AS state,
  CAST(attempts + CAST(failed OR won AS INTEGER) AS INTEGER) AS attempts,
  coalesce(CASE WHEN again THEN NULL ELSE not_before_ms END, -1) AS not_before_ms,
  CASE WHEN failed THEN e ELSE last_error_code END AS last_error_code FROM a""")
def transition(t):
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    e = F.col("event_id")
    outcomes = t.events.where(e % 7 != 0).select(
        F.concat(F.lit("w"), F.lpad(e.cast("string"), 20, "0")).alias("id"),
        pick(["succeeded", "failed", "cancelled", "claimed", "failed"], e).alias("outcome"),
        pick(["timeout", "corruptData", "interrupted"], e).alias("error_code"),
    )
    moved = requests.transition(adapters.work_requests(t), outcomes)
    return moved.select("id", "state", "attempts", F.coalesce("not_before_ms", F.lit(-1)).alias("not_before_ms"), "last_error_code")


@query(f"WITH {q.REQUESTS} SELECT id, CASE WHEN state = 'running' THEN 'pending' ELSE state END AS state FROM job")
def recover_interrupted(t):
    return requests.recover_interrupted(adapters.work_requests(t)).select("id", "state")


# --- cache ------------------------------------------------------------------------------------


@query(f"""WITH {q.CACHE} SELECT DISTINCT k AS cache_key FROM (SELECT CASE WHEN size_bytes % 300 = 0 THEN replace(cache_key, '/thumbnail/', '/preview/') ELSE cache_key END AS k FROM entry)
WHERE k NOT IN (SELECT cache_key FROM entry WHERE size_bytes > 0)""")
def cache_misses(t):
    entries = adapters.cache_entries(t)
    wanted = F.when(
        F.col("size_bytes") % 300 == 0, F.replace("cache_key", F.lit("/thumbnail/"), F.lit("/preview/"))
    ).otherwise(F.col("cache_key"))
    return cache.cache_misses(entries.select(wanted.alias("cache_key")), entries)


@query(f"WITH {q.CACHE} SELECT CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM entry")
def cache_total_size(t):
    return cache.cache_total_size(adapters.cache_entries(t))


@query(f"""WITH {q.CACHE} SELECT cache_key, sum(size_bytes) OVER (ORDER BY last_modified_ms DESC, cache_key DESC ROWS UNBOUNDED PRECEDING) > 5000000 AS evicted FROM entry""")
def cache_trim(t):
    return cache.cache_trim(adapters.cache_entries(t), 5_000_000).select("cache_key", "evicted")


@query(f"""WITH {q.CACHE} SELECT cache_key, size_bytes, last_modified_ms FROM entry
WHERE split_part(cache_key, '/', 1) NOT IN (SELECT 'sha256-' || sha256(CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size % 4 = 0)""")
def invalidate_fingerprint(t):
    gone = t.part.select(F.when(
        F.col("p_size") % 4 == 0, F.concat(F.lit("sha256-"), F.sha2(F.col("p_partkey").cast("string"), 256))
    ).otherwise("").alias("fingerprint_key"))
    return cache.invalidate_fingerprint(adapters.cache_entries(t), gone)


# --- manifests --------------------------------------------------------------------------------


def _archive(t):
    d = F.col("doc_id")
    name = F.when(d % 50 == 49, "writer.lock").otherwise(F.concat(d.cast("string"), F.lit(".bin")))
    return t.documents.select(
        "doc_id", F.concat(F.lit("store/"), "source", F.lit("/"), d.cast("string"), F.lit("/"), name).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


_ARCHIVE = """a AS (SELECT doc_id, 'store/' || source || '/' || CAST(doc_id AS VARCHAR) || '/' || CASE WHEN doc_id % 50 = 49 THEN 'writer.lock'
  ELSE CAST(doc_id AS VARCHAR) || '.bin' END AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents)"""


@query(f"WITH {_ARCHIVE} SELECT path, size_bytes, sha256 FROM a WHERE doc_id % 50 <> 49")
def backup_manifest(t):
    return manifest.backup_manifest(_archive(t))


@query(f"WITH {_ARCHIVE} SELECT count(*) AS entries, count(*) <= 1000000 AS within_limit FROM a WHERE doc_id % 50 <> 49")
def manifest_size(t):
    return manifest.check_manifest_size(manifest.backup_manifest(_archive(t)))


@query(f"""WITH {_ARCHIVE}, l AS (SELECT CASE WHEN doc_id % 11 = 10 THEN replace(path, 'store/', 'store/../') ELSE path END AS path,
    size_bytes + CAST(doc_id % 7 = 3 AS INTEGER) AS size_bytes, CASE WHEN doc_id % 8 = 3 THEN 'bad' ELSE sha256 END AS sha256,
    CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM a WHERE doc_id % 3 <> 0),
p AS (SELECT * FROM a WHERE doc_id % 4 <> 0)
SELECT coalesce(l.path, p.path) AS path, CASE WHEN l.path IS NULL THEN 'unlisted' WHEN l.path LIKE '%/../%' THEN 'unsafe' WHEN n > 1 THEN 'duplicate'
  WHEN p.path IS NULL THEN 'missing' WHEN l.size_bytes <> p.size_bytes THEN 'size' WHEN l.sha256 <> p.sha256 THEN 'digest' ELSE 'ok' END AS status
FROM l FULL JOIN p ON l.path = p.path""")
def manifest_verify(t):
    d = F.col("doc_id")
    rows = _archive(t).select(
        "doc_id", "path", F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )
    copies = F.when(d % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    listed = rows.where(d % 3 != 0).select(
        F.when(d % 11 == 10, F.replace("path", F.lit("store/"), F.lit("store/../"))).otherwise(F.col("path")).alias("path"),
        (F.col("size_bytes") + (d % 7 == 3).cast("int")).alias("size_bytes"),
        F.when(d % 8 == 3, "bad").otherwise(F.col("sha256")).alias("sha256"), F.explode(copies).alias("copy"),
    )
    return manifest.manifest_verify(listed, rows.where(d % 4 != 0))
