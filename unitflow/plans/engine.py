"""Queries over layouts, spans, profiles, structures, tables with versions and running numbers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from unitflow.functions.written import shared_dir
from unitflow.operators import batching, fitting, numbering, prefixes, profiles, store, workspace
from unitflow.plans.formats import BARE_SQL, LINES_SQL, TREE_SQL, bare, game_files, made
from unitflow.plans.queries import NUMBERED_SQL, UNITS_SQL, numbered, query, table, units
from unitflow.sinks import games as game_sink
from unitflow.sinks import render
from unitflow.sources import games, nested, spans
from unitflow.sources import lines as line_sources

GAME_LABEL, GAME_CONTROL = r"^[【〖〔《〈［\[]([^】〗〕》〉］\]\r\n]+)[】〗〕》〉］\]]", r"\\{2}|\\[A-Za-z]+\[[^\]\r\n]*\]|\\[A-Za-z]"


def spoken(spark, sf_dir):
    """Each line of a text as one said by its source: a label and the line together, for a source that has the label in a slot of its own."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("domain"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    label = F.concat(F.lit("【"), "source", F.lit("】"))
    return lines.select("doc_id", "pos", "domain", "line", label.alias("label"), F.array(F.lit("【名】"), F.lit("本文")).alias("original_lines"), F.array(F.concat(label, "line")).alias("lines"))


@query(LINES_SQL + r"""
SELECT doc_id, (pos - 1)::INTEGER AS pos, 4 AS slots, CASE WHEN regexp_full_match(line, '\s*') THEN '【' || source || '】' || line ELSE '【' || source || '】' END AS label, CASE WHEN regexp_full_match(line, '\s*') THEN '' ELSE line END AS body FROM l JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
def layout_fit(spark, sf_dir):
    """Lines in four slots of 44 cells: the label has the first, and no character of the text is lost."""
    out = fitting.fitted(spoken(spark, sf_dir), [fitting.Rule(GAME_LABEL, GAME_CONTROL, 44)], F.lit(4))
    lines = F.col("fit.lines")
    return out.select("doc_id", "pos", F.size(lines).alias("slots"), lines[0].alias("label"), F.array_join(F.slice(lines, 2, 3), "").alias("body"))


@query(r"""
WITH l AS (SELECT lang AS domain, length(t) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents))
SELECT domain, count(*) AS units, count(*) AS reflowed, count(*) FILTER (n > 66) AS overflow_units, count(*) FILTER (n > 66) AS overflow_lines FROM l GROUP BY domain""")
def layout_overflow(spark, sf_dir):
    """Lines as wide characters alone, in three slots of 22: units that had to be broken, and slots too wide."""
    own = spoken(spark, sf_dir).withColumn("lines", F.array(F.regexp_replace("line", "(?s).", "字")))
    return fitting.overflow_counts(fitting.fitted(own, [fitting.Rule(width=44)], F.lit(3)))


#: What reads like text, of the column own.
HUMAN_SQL = r"""(regexp_matches(own, '[A-Za-z]') AND NOT (lower(own) IN ('true', 'false', 'null', 'none', 'nil', 'yes', 'no', 'on', 'off', 'nan', 'inf') OR regexp_matches(own, '://|@|[\\/{}`<>]|=>|==|^(www\.|[.$%])') OR regexp_full_match(own, '[0-9A-Fa-f-]{8,}')
  OR NOT contains(own, ' ') AND NOT regexp_matches(own, '[^\x00-\x7F]') AND (regexp_matches(own, '[-_.:=+\[\]0-9]') OR NOT regexp_matches(own, '[a-z]') AND regexp_matches(own, '[A-Z][^A-Z]*[A-Z]') OR regexp_matches(own, '[a-z][A-Z]'))))"""
SPAN_SQL = TREE_SQL + r""", s AS (SELECT doc_id, pos, english, trim(regexp_replace(line, '\s+', ' ', 'g')) AS own FROM k), h AS (SELECT *, english AND """ + HUMAN_SQL + r""" AS people, replace(replace(own, '\', '\\'), '"', '\"') AS esc FROM s)"""


def span_files(spark, sf_dir):
    """A text's lines as a list of records in JSON, each with a key for people and one for programs."""
    esc = lambda x: F.replace(F.replace(bare(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = lambda x, i: F.concat(F.lit('  {"text" : "'), esc(x), F.lit('", "imageUrl": "'), esc(x), F.lit('"}'))
    return made(spark, sf_dir, line, '{ "events": [\n', "\n] }\n", ",\n").withColumnRenamed("doc_id", "file")


def span_edits_of(spark, sf_dir):
    files = span_files(spark, sf_dir)
    own = spans.span_units(files, F.lit("en"))
    return files, own.select("file", "hash", "start", "end", "style", F.concat(F.lit("«"), F.col("original_lines")[0], F.lit('" »')).alias("translation"))


@query(SPAN_SQL + r"""
SELECT doc_id AS file, '{ "events": [' || chr(10) || string_agg('  {"text" : "' || CASE WHEN people THEN '«' || esc || '\" »' ELSE esc END || '", "imageUrl": "' || esc || '"}', ',' || chr(10) ORDER BY pos) || chr(10) || '] }' || chr(10) AS text, NULL::VARCHAR AS reason FROM h GROUP BY doc_id""")
def span_edits(spark, sf_dir):
    """Files of no declared format with a translation in the place of each text for people; all other bytes as they were."""
    return spans.edited(*span_edits_of(spark, sf_dir))


@query(SPAN_SQL + r"""
, g AS (SELECT doc_id, count(*) AS n FROM h WHERE people GROUP BY doc_id)
SELECT CASE doc_id % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'no span at these bytes' WHEN 2 THEN 'the file has changed' ELSE 'another style' END AS reason, sum(n)::BIGINT AS anchors, count(*) AS files FROM g GROUP BY ALL""")
def span_refusals(spark, sf_dir):
    """Anchors of three quarters of the files shifted, out of date or of another style: each is refused for its reason."""
    files, edits = span_edits_of(spark, sf_dir)
    quarter = F.col("file") % 4
    edits = edits.withColumn("start", F.col("start") + F.when(quarter == 1, 1).otherwise(0)).withColumn("hash", F.when(quarter == 2, "x").otherwise(F.col("hash"))).withColumn("style", F.when(quarter == 3, "xml").otherwise(F.col("style")))
    return spans.resolved(edits, files).groupBy(F.coalesce("reason", F.lit("met")).alias("reason")).agg(F.count("*").alias("anchors"), F.count_distinct("file").alias("files"))


GAME_SQL = LINES_SQL + rf"""
, c AS (SELECT *, (pos - 1) // 4 AS block, (pos - 1) % 4 AS k FROM e),
 said AS (SELECT doc_id, block, count(*) AS n, string_agg({BARE_SQL}, '' ORDER BY pos) AS joined, bool_or(english) AS english, string_agg({BARE_SQL}, chr(10) ORDER BY pos) AS text FROM c WHERE k < 2 GROUP BY ALL),
 done AS (SELECT doc_id, block, english, CASE WHEN english AND n = 2 THEN '<one>' || chr(10) || joined || '<two>' WHEN english THEN '<one>' || joined || '<two>' ELSE text END AS text FROM said)"""


@query(GAME_SQL + rf"""
SELECT doc_id, 'dialogue' AS domain, 'Map001.json/7/0/' || (block * 6) AS location, 'Bob' AS role, text FROM done WHERE english
UNION ALL SELECT doc_id, 'namebox', 'Map001.json/7/0/' || (block * 6) || '/namebox', 'namebox', 'Bob' FROM done
UNION ALL SELECT doc_id, 'choices', 'Map001.json/7/0/' || (block * 6 + 3), '旁白', 'Choose: ' || {BARE_SQL} || chr(10) || 'Choose: No' FROM c WHERE k = 2 AND english
UNION ALL SELECT doc_id, 'scroll', 'Map001.json/7/0/' || (block * 6 + 4), '旁白', {BARE_SQL} || chr(10) || '...' FROM c WHERE k = 3 AND english""")
def game_write(spark, sf_dir):
    """Game files with translations in their slots, read again: messages of three lines for two slots, choices, names; scrolling texts without a translation."""
    files = game_files(spark, sf_dir)
    own = games.game_units(files, F.lit("en"), "name", "text", "doc_id")
    many = F.array(F.lit("<one>"), F.array_join("original_lines", ""), F.lit("<two>"))
    lines = F.when(F.col("domain") == "dialogue", many).when(F.col("domain") == "namebox", F.array(F.lit("Bob"))).when(F.col("domain") == "choices", F.transform("original_lines", lambda x: F.concat(F.lit("Choose: "), x)))
    done = own.select("doc_id", "location", "domain", lines.alias("lines")).where("lines is not null")
    out = game_sink.game_files(files, done, game_sink.anchors(files, "doc_id"), keep=("doc_id",)).where("reason is null")
    again = games.game_units(out, F.lit("en"), "name", "text", "doc_id")
    return again.select("doc_id", "domain", "location", "role", F.array_join("original_lines", "\n").alias("text"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'the structure has changed' END AS reason FROM documents""")
def game_anchors(spark, sf_dir):
    """Files that changed since they were read: in texts alone (written), or by a command put in, of another code, of other parameters, or a condition (refused)."""
    files = game_files(spark, sf_dir)
    stored = game_sink.anchors(files, "doc_id")
    first = '{"code":101,"parameters":["",0,0,2,"Ann"]}'
    swap = lambda a, b: F.replace(F.col("text"), F.lit(a), F.lit(b))
    kind = F.col("doc_id") % 6
    live = F.when(kind == 0, F.col("text")).when(kind == 1, swap('"Ann"', '"Eve"')).when(kind == 2, swap(first, first + ',{"code":401,"parameters":["new"]}')).when(kind == 3, swap('"code":401', '"code":405'))
    live = live.when(kind == 4, swap('["",0,0,2,', '["",0,0,3,')).otherwise(swap('{"list":[', '{"conditions":{"switch1Valid":true},"list":['))
    own = games.game_units(files, F.lit("en"), "name", "text", "doc_id").where("domain = 'namebox'").select("doc_id", "location", "domain", F.array(F.lit("Bob")).alias("lines"))
    return game_sink.game_files(files.withColumn("text", live), own, stored, keep=("doc_id",)).select("doc_id", "reason")


@query("""
WITH f AS (SELECT DISTINCT source || '#' || lang AS file FROM documents WHERE doc_id % 3 <> 0 UNION SELECT DISTINCT source FROM documents UNION SELECT 'nowhere#x'),
 u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'lost/' ELSE '' END || source || '#' || lang || CASE WHEN doc_id % 2 = 0 THEN '#' ELSE '' END || 'L1' AS location FROM documents)
SELECT doc_id, location, (SELECT arg_max(file, length(file)) FROM f WHERE starts_with(location, file || '#')) AS file FROM u""")
def file_of_location(spark, sf_dir):
    """Locations with their files: the longest name before a sign; some names hold a sign themselves, some locations have no file."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("#", "source", "lang")
    files = docs.where("doc_id % 3 <> 0").select(name.alias("file")).union(docs.select("source")).union(spark.createDataFrame([("nowhere#x",)], "file string"))
    location = F.concat(F.when(F.col("doc_id") % 5 == 0, "lost/").otherwise(""), name, F.when(F.col("doc_id") % 2 == 0, "#").otherwise(""), F.lit("L1"))
    return prefixes.file_of(docs.select("doc_id", location.alias("location")), files)


@query(UNITS_SQL + """
SELECT doc_id, pos, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id, pos) AS nth FROM units""")
def running_numbers(spark, sf_dir):
    """A number for each unit through all formats, in order, from ranges that are counted and summed by levels."""
    own = units(spark, sf_dir).select("lang", "doc_id", "pos")
    return numbering.numbered(own, "lang", "doc_id", "pos", name="nth", fan=4).select("doc_id", "pos", (F.col("nth") + 1).alias("nth"))


@query(NUMBERED_SQL + """
, s AS (SELECT 1 AS step, count(*) AS units, 0 AS translations FROM numbered UNION ALL SELECT 2, count(*), count(*) FILTER (found) FROM numbered UNION ALL SELECT 3, count(*) FILTER (lang <> 'fr'), count(*) FILTER (found AND lang <> 'fr') FROM numbered)
SELECT step, units::BIGINT AS units, translations::BIGINT AS translations, CASE WHEN step < 3 THEN 'first' ELSE 'second' END AS snapshot FROM s""")
def workspace_versions(spark, sf_dir):
    """A workspace's versions: units, their translations, and units read again without the French ones. Between them a record with an unknown id is refused, with
    all that came with it, and a dry run is made; neither is a version."""
    ws = workspace.Workspace(spark, f"{shared_dir(spark)}/unitflow/workspace-{uuid.uuid4().hex}")
    own, done = numbered(units(spark, sf_dir))
    own = own.withColumn("location", F.col("id")).withColumn("item_type", F.lit("short_text")).withColumn("original_lines", F.array("line"))
    workspace.replace_units(ws, own, "first")
    workspace.save_translations(ws, done)
    records = own.select(F.when(F.col("pos") == 1, "nowhere").otherwise(F.col("id")).alias("id"), F.col("line").alias("text"), F.array("line").alias("lines"))
    try:
        workspace.import_records(ws, records)
    except workspace.Refused:
        pass
    workspace.replace_units(ws, own.limit(0), "none", dry_run=True)
    workspace.replace_units(ws, own.where("lang <> 'fr'"), "second")
    rows = []
    for v in ws.versions():
        translations = ws.table("translations", v)
        rows.append((v, ws.table("units", v).count(), 0 if translations is None else translations.count(), ws.manifest(v)["facts"]["snapshot"]))
    return spark.createDataFrame(rows, "step int, units long, translations long, snapshot string")


@query(NUMBERED_SQL + """
, p AS (SELECT doc_id, pos, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id, pos) AS nth FROM numbered WHERE NOT found OR passthrough)
SELECT doc_id, pos, nth FROM p WHERE nth <= 500""")
def first_pending(spark, sf_dir):
    """The first units that are pending or were passed through, in order of units."""
    own, done = numbered(units(spark, sf_dir))
    open_ = store.matched(own, done.select("unit_id", "source_hash", "passthrough").withColumn("found", F.lit(True))).where("found is null or passthrough")
    ranked = numbering.numbered(open_.select("lang", "doc_id", "pos"), "lang", "doc_id", "pos", name="nth")
    return ranked.where("nth < 500").select("doc_id", "pos", (F.col("nth") + 1).alias("nth"))


def nested_files(spark, sf_dir):
    """A text's lines as parameters of a game's plugin: JSON in strings of JSON, three levels deep."""
    esc = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    inner = lambda x, i: F.concat(F.lit('"{\\"text\\": \\"'), esc(esc(bare(x))), F.lit('\\", \\"icon_url\\": \\"some words here\\"}"'))
    parts = F.array_join(F.transform(F.split("text", "\n"), inner), ",")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit('{"id":"plugin","parameters":"'), esc(F.concat(F.lit("["), parts, F.lit("]"))), F.lit('"}')).alias("text"))


@query(SPAN_SQL + r"""
, f AS (SELECT doc_id, string_agg('"' || replace(replace('{"text": "' || CASE WHEN people THEN replace(replace('«' || own || '" »', '\', '\\'), '"', '\"') ELSE esc END || '", "icon_url": "some words here"}', '\', '\\'), '"', '\"') || '"', ',' ORDER BY pos) AS list FROM h GROUP BY doc_id)
SELECT doc_id AS file, '{"id":"plugin","parameters":"' || replace(replace('[' || list || ']', '\', '\\'), '"', '\"') || '"}' AS text, NULL::VARCHAR AS reason FROM f""")
def nested_texts(spark, sf_dir):
    """Texts three levels deep in strings of JSON, translated and put back at their depth; strings beside them as they were."""
    files = nested_files(spark, sf_dir)
    own = nested.nested_units(files, F.lit("en"), "text", "file")
    return nested.written_back(files, own.select("file", "location", F.concat(F.lit("«"), F.array_join("original_lines", "\n"), F.lit('" »')).alias("translation")), "file")


def line_profile(name, signature, prefix_kept=True):
    """A profile of plain lines; one that drops the indentation of its lines loses bytes."""

    def reader(files, source):
        return line_sources.txt_units(files, source, "text", "path").select("path", "pos", "location", "original_lines")

    def writer(files, done):
        own = files if prefix_kept else files.withColumn("text", F.regexp_replace("text", r"(?m)^ +", ""))
        rows = done.select("path", "pos", F.lit("").alias("prefix"), F.col("translation_lines")[0].alias("target"))
        return render.lines(own, rows, ["path"])

    return profiles.Profile(name, "txt", signature, reader, writer, 3)


@query(r"""
SELECT unnest(['sound', 'lossy', 'other', 'silent']) AS profile, unnest([TRUE, TRUE, FALSE, FALSE]) AS detected, unnest([0, (SELECT count(*) FROM documents), NULL, NULL]) AS faulty_files""")
def profile_trials(spark, sf_dir):
    """Profiles over all texts as files: those whose signatures are shown are detected; one whose writer takes blanks away is refused for every file."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id", F.concat(F.lit("  Some line here, at the start\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    listed = [line_profile("sound", ("[A-Z]", "at the start")), line_profile("lossy", (), False), line_profile("other", ("no such words anywhere",)), profiles.Profile("silent", "bin", (), lambda f, s: f)]
    found = profiles.detected(files, listed, F.lit("en"))
    rows = [(p.name, p.name in found, profiles.validated(files, p, F.lit("en")).select("path").distinct().count() if p.name in found else None) for p in listed]
    return spark.createDataFrame(rows, "profile string, detected boolean, faulty_files long")


@query(UNITS_SQL + """
, s AS (SELECT doc_id, pos, CASE doc_id % 3 WHEN 0 THEN pos WHEN 1 THEN -pos ELSE -pos END AS place FROM units)
SELECT doc_id, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY place)""")
def scene_order(spark, sf_dir):
    """Units read backwards: numbered locations of one sequence are neighbours by number; those of several, or without a number, as they were read."""
    own = units(spark, sf_dir).select("doc_id", "pos", (-F.col("pos")).alias("ordinal"))
    kind = F.col("doc_id") % 3
    location = F.when(kind == 0, F.concat(F.lit("Map/"), "pos", F.lit("/x"))).when(kind == 1, F.concat(F.when(F.col("pos") % 2 == 0, "A").otherwise("B"), "pos")).otherwise(F.lit("name"))
    # A document of one unit, or of units of one kind alone, has the same neighbours either way only if its order is that of numbers; so two more are added.
    more = own.select("doc_id").distinct().where("doc_id % 3 = 1").select("doc_id", F.explode(F.array(F.lit(1 << 20).cast("long"), F.lit((1 << 20) + 1).cast("long"))).alias("pos")).withColumn("ordinal", -F.col("pos"))
    df = batching.in_unit_order(own.unionByName(more).withColumn("location", location), ["doc_id"])
    out = batching.neighbours(df, ["doc_id"], ["sort_key", "ordinal"], "pos").where(f"pos < {1 << 20}")
    inside = lambda c: F.when(F.col(c) < (1 << 20), F.col(c)).alias(c)
    return out.select("doc_id", "pos", inside("prev_pos"), inside("next_pos"))
