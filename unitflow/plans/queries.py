"""Queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitflow.functions import ids, kana, masks, quality, scripts
from unitflow.operators import batching, glossary, layout, review, rules, store
from unitflow.sinks import render
from unitflow.sources import lines as line_sources
from unitflow.sources import markup, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The relation of line units, and translations that are pure functions of its keys.

UNITS_SQL = r"""
WITH raw AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts FROM documents WHERE text <> ''),
 lines AS (SELECT doc_id, lang, source, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM raw),
 units AS (SELECT doc_id, lang, source, pos, 'L' || lpad(pos::VARCHAR, 6, '0') AS location, 's' || lpad(((pos - 1) // 50)::VARCHAR, 6, '0') AS context, line,
   left(sha256('txt' || chr(0) || 'L' || lpad(pos::VARCHAR, 6, '0') || chr(0) || line || chr(10)), 24) AS id, sha256(line || chr(10)) AS source_hash
  FROM lines WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3),
 translations AS (SELECT doc_id, pos, id, source_hash, doc_id % 7 = 0 AS passthrough, CASE WHEN doc_id % 11 = 0 THEN line ELSE '<' || line || '>' END AS target FROM units WHERE doc_id % 5 <> 0)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_sources.txt_units(docs, F.lit("en"), "text", "doc_id", "lang", "source")
    return out.withColumn("line", F.col("original_lines")[0])


def translations(own: DataFrame) -> DataFrame:
    """Deterministic stand-ins for a model: absent, passed through, identical or marked by the document's id."""
    target = F.when(F.col("doc_id") % 11 == 0, F.col("line")).otherwise(F.concat(F.lit("<"), "line", F.lit(">")))
    return own.where("doc_id % 5 <> 0").select("doc_id", "pos", "id", "source_hash", (F.col("doc_id") % 7 == 0).alias("passthrough"), target.alias("target"))


def numbered(own: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Units and translations whose id also names the document, as the store keeps them."""
    full = own.withColumn("id", F.concat_ws("/", "doc_id", "id"))
    done = translations(full).select(F.col("id").alias("unit_id"), "source_hash", "passthrough", "target")
    return full, done


NUMBERED_SQL = UNITS_SQL + """, numbered AS (SELECT u.*, t.passthrough, t.target, t.id IS NOT NULL AS found
  FROM units u LEFT JOIN translations t ON u.doc_id = t.doc_id AND u.pos = t.pos AND u.source_hash = t.source_hash)
"""


@query(UNITS_SQL + "SELECT doc_id, pos, id, location, context, line, source_hash FROM units")
def units_txt(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "pos", "id", "location", "context", "line", "source_hash")


@query(UNITS_SQL + "SELECT lang, count(*) AS n_units, sum(length(line))::BIGINT AS n_chars, count(DISTINCT source_hash) AS n_sources FROM units GROUP BY lang")
def units_by_lang_domain(spark, sf_dir):
    return units(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_units"), F.sum(F.char_length("line")).alias("n_chars"), F.count_distinct("source_hash").alias("n_sources"))


@query(UNITS_SQL + "SELECT id, doc_id, pos, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC, pos DESC) AS k FROM units) WHERE k = 1")
def unit_dedupe_last(spark, sf_dir):
    return ids.dedupe_last(units(spark, sf_dir), "id", "doc_id", "pos").select("id", "doc_id", "pos", "source_hash")


@query(r"SELECT doc_id, sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: x || chr(10)), '')) AS source_hash FROM documents")
def source_hash_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.source_hash(F.split(F.coalesce("text", F.lit("")), "\n")).alias("source_hash"))


@query(NUMBERED_SQL + "SELECT doc_id, pos, source_hash FROM numbered WHERE NOT found")
def pending_units(spark, sf_dir):
    own, done = numbered(units(spark, sf_dir))
    return store.pending(own, done).select("doc_id", "pos", "source_hash")


COUNTS_SQL = "count(*) AS total, count(*) FILTER (found AND NOT passthrough) AS translated, count(*) FILTER (found AND passthrough) AS passthrough, count(*) FILTER (NOT found) AS pending FROM numbered"


@query(NUMBERED_SQL + "SELECT " + COUNTS_SQL)
def status_counts(spark, sf_dir):
    return store.counts(*numbered(units(spark, sf_dir)))


@query(NUMBERED_SQL + "SELECT lang, source, " + COUNTS_SQL + " GROUP BY lang, source")
def domain_counts(spark, sf_dir):
    own, done = numbered(units(spark, sf_dir))
    return store.counts(own, done, "lang", "source")


@query(NUMBERED_SQL + "SELECT doc_id, pos, passthrough FROM numbered WHERE found AND lang <> 'fr'")
def cache_purge(spark, sf_dir):
    """Translations left after the French units have gone."""
    own, done = numbered(units(spark, sf_dir))
    kept = store.purge(done, own.where("lang <> 'fr'"))
    return own.select(F.col("id").alias("unit_id"), "doc_id", "pos").join(kept, "unit_id").select("doc_id", "pos", "passthrough")


@query(NUMBERED_SQL + """
SELECT 'pending' AS which, doc_id, pos FROM numbered WHERE NOT found UNION ALL SELECT 'translated', doc_id, pos FROM numbered WHERE found
UNION ALL SELECT 'passthrough', doc_id, pos FROM numbered WHERE found AND passthrough UNION ALL SELECT 'all', doc_id, pos FROM numbered""")
def export_filters(spark, sf_dir):
    own, done = numbered(units(spark, sf_dir))
    first, *rest = (store.export(own, done, w).select(F.lit(w).alias("which"), "doc_id", "pos") for w in ("pending", "translated", "passthrough", "all"))
    for r in rest:
        first = first.unionByName(r)
    return first


@query("""
WITH ranked AS (SELECT *, count(*) OVER (PARTITION BY conv_id, text) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n > 1 THEN 'duplicate' WHEN text = '' THEN 'empty' WHEN role NOT IN ('user', 'assistant') THEN 'unknown' END AS violation FROM ranked""")
def import_violations(spark, sf_dir):
    """The first fault of each record, duplicates before emptiness."""
    n = F.count("*").over(Window.partitionBy("conv_id", "text"))
    fault = F.when(n > 1, "duplicate").when(F.col("text") == "", "empty").when(~F.col("role").isin("user", "assistant"), "unknown")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fault.alias("violation"))


LATIN_SQL = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}]"


@query(rf"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' ひらがな漢字' WHEN doc_id % 3 = 1 THEN ' привет' ELSE '' END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 3 AS en, regexp_matches(t, '{LATIN_SQL}') AS fr, doc_id % 3 = 0 AS ja, doc_id % 3 = 0 AS zh, doc_id % 3 = 1 AS ru,
 regexp_matches(t, '\pL') AS other FROM d""")
def script_flags(spark, sf_dir):
    more = F.when(F.col("doc_id") % 3 == 0, " ひらがな漢字").when(F.col("doc_id") % 3 == 1, " привет").otherwise("")
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t"))
    return df.select("doc_id", *(scripts.needs_translation(F.col("t"), F.lit(tag)).alias(name) for name, tag in (("en", "en"), ("fr", "fr-CA"), ("ja", "jp"), ("zh", "zh_TW"), ("ru", "ru"), ("other", "auto"))))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'kana' WHEN 1 THEN 'hangul' WHEN 2 THEN 'Cyrillic' WHEN 3 THEN 'Thai' WHEN 4 THEN 'CJK' END AS residual,
 CASE doc_id % 6 WHEN 5 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 ELSE doc_id % 6 <> 4 OR TRUE END AS identical FROM documents""")
def residual_and_identical(spark, sf_dir):
    """A letter of the source's script after each text: kana, Hangul, Cyrillic, Thai, Han, or none for English."""
    k = F.col("doc_id") % 6
    letter = F.when(k == 0, "ひ").when(k == 1, "한").when(k == 2, "ж").when(k == 3, "ก").when(k == 4, "漢").otherwise("")
    tag = F.when(k == 0, "ja").when(k == 1, "ko").when(k == 2, "ru").when(k == 3, "th").when(k == 4, "zh").otherwise("en")
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", letter).alias("t"), tag.alias("tag"))
    return df.select("doc_id", scripts.residual_script(F.col("t"), F.col("tag"), F.lit("fr")).alias("residual"), scripts.identical_requires_translation(F.col("t"), F.col("tag"), F.lit("fr")).alias("identical"))


TOKENS_SQL = r"SELECT DISTINCT unnest(string_split(regexp_replace(text, '\s', ' ', 'g'), ' ')) AS token FROM documents"


@query(rf"""
WITH t AS ({TOKENS_SQL} UNION SELECT event_type FROM events UNION SELECT value::DECIMAL(18,2)::VARCHAR FROM events UNION SELECT unnest(['', 'true', 'null', '1e5', '.5', '5.', '+3', 'NaN', 'inf', '1d', '0x1p3', 'a.png', 'A.JSON', '$gameMap', 'function(x)', 'return 1', 'png', '-', 'TRUE', 'Undefined', 'x$gameVariables', 'b.gif']))
SELECT token, token = '' OR lower(token) IN ('true', 'false', 'null', 'undefined') OR regexp_full_match(token, '(?i)[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)')
 OR list_contains(['png','jpg','jpeg','ogg','m4a','wav','json','js','css','webm'], lower(string_split(token, '.')[-1]))
 OR contains(token, '$game') OR starts_with(token, 'function') OR contains(token, 'return ') AS machine FROM t""")
def machine_literal(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\t\n\f\r ]")).alias("token"))
    events = table(spark, sf_dir, "events")
    made = ["", "true", "null", "1e5", ".5", "5.", "+3", "NaN", "inf", "1d", "0x1p3", "a.png", "A.JSON", "$gameMap", "function(x)", "return 1", "png", "-", "TRUE", "Undefined", "x$gameVariables", "b.gif"]
    values = events.select(F.col("value").cast("decimal(18,2)").cast("string").alias("token"))
    all_tokens = tokens.union(events.select("event_type")).union(values).union(spark.createDataFrame([(x,) for x in made], "token string")).distinct()
    return all_tokens.select("token", scripts.machine_literal(F.col("token")).alias("machine"))


@query(UNITS_SQL + r"""
, w AS (SELECT doc_id, pos, list_filter(regexp_extract_all('訳 ' || line || ' OK NASA extra', '[A-Za-z]{2,}'), lambda w: NOT regexp_full_match(w, '[A-Z]{2,4}') AND contains(lower(line), lower(w))) AS words FROM units)
SELECT doc_id, pos, array_to_string(list_slice(list_filter(words, lambda w, i: list_position(list_transform(words, lambda x: lower(x)), lower(w)) = i), 1, 3), ',') AS residue FROM w""")
def latin_residue(spark, sf_dir):
    own = units(spark, sf_dir)
    made = F.concat(F.lit("訳 "), "line", F.lit(" OK NASA extra"))
    return own.select("doc_id", "pos", F.array_join(scripts.latin_residue(made, F.col("line")), ",").alias("residue"))



@query(UNITS_SQL + r"""
, s AS (SELECT replace(replace(regexp_replace(regexp_replace(left(line, 160), '[\pL]+', chr(1), 'g'), '[0-9]+', chr(2), 'g'), chr(1), '<w>'), chr(2), '<n>') AS shape, line FROM lines WHERE trim(line) <> '')
SELECT shape, count(*) AS n, min(left(line, 160)) AS sample FROM s GROUP BY shape ORDER BY n DESC, shape LIMIT 12""")
def line_shape_top12(spark, sf_dir):
    """The twelve most frequent shapes of non-blank lines: a report whose length is the feature."""
    own = line_sources.lines(table(spark, sf_dir, "documents"), "text").where(F.trim("line") != "")
    return own.groupBy(scripts.line_shape(F.col("line")).alias("shape")).agg(F.count("*").alias("n"), F.min(F.left("line", F.lit(160))).alias("sample")).orderBy(F.desc("n"), "shape").limit(12)


@query(r"""
WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events)
SELECT key AS path, count(*) AS n, count(*) FILTER (json_type(json_extract(props, '$."' || key || '"')) = 'VARCHAR') AS strings FROM k GROUP BY key""")
def json_text_paths(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("props", F.explode(F.json_object_keys("props")).alias("path"))
    parsed = F.from_json("props", "map<string,string>")[F.col("path")]
    raw = F.call_function("regexp_extract", "props", F.concat(F.lit(r'"\Q'), "path", F.lit(r'\E"\s*:\s*(.)')), F.lit(1))
    return keys.groupBy("path").agg(F.count("*").alias("n"), F.count_if((raw == '"') & parsed.isNotNull()).alias("strings"))


LOCATION_SQL = """CASE doc_id % 4 WHEN 0 THEN 'Map' || lpad(doc_id::VARCHAR, 3, '0') || '.json/' || pos || '/Name' WHEN 1 THEN 'js/plugins.js/' || pos || '/param' || (pos % 5) || '#data/0/helpText' WHEN 2 THEN 'System.json/terms/' || (pos % 3) ELSE 'Items.json/' || pos || '/note' END"""
FIELD_SQL = """CASE doc_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'helptext' WHEN 2 THEN 'terms' ELSE 'note' END"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at locations of four kinds of game files."""
    k, pos = F.col("doc_id") % 4, F.col("pos").cast("string")
    location = (
        F.when(k == 0, F.concat(F.lit("Map"), F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(3), F.char_length(F.col("doc_id").cast("string"))), F.lit("0")), F.lit(".json/"), pos, F.lit("/Name")))
        .when(k == 1, F.concat(F.lit("js/plugins.js/"), pos, F.lit("/param"), (F.col("pos") % 5).cast("string"), F.lit("#data/0/helpText")))
        .when(k == 2, F.concat(F.lit("System.json/terms/"), (F.col("pos") % 3).cast("string")))
        .otherwise(F.concat(F.lit("Items.json/"), pos, F.lit("/note")))
    )
    own = units(spark, sf_dir).withColumn("location", location)
    return own.withColumn("field", scripts.field_of(F.col("location"))).withColumn("domain", F.col("source"))


@query(UNITS_SQL + f"SELECT doc_id, pos, {FIELD_SQL} AS field FROM units")
def field_of(spark, sf_dir):
    return located(spark, sf_dir).select("doc_id", "pos", "field")


@query(UNITS_SQL + f"""
, f AS (SELECT doc_id, pos, source AS domain, {FIELD_SQL} AS field FROM units)
SELECT field, domain, count(*) AS n, count(*) FILTER (field = 'note' OR (field = 'helptext' AND domain <> 'src1')) AS skipped FROM f GROUP BY field, domain""")
def experience_filter(spark, sf_dir):
    """Five rules in two layers: notes and help texts are skipped, but one domain's help texts are taken."""
    made = [(0, 0, "note", None, "extract"), (1, 1, "note", None, "skip"), (0, 2, "*text", None, "skip"), (1, 3, "*text", "src1", "extract"), (1, 4, "*", None, "skip")]
    own = spark.createDataFrame(made, "layer int, position int, pattern string, rule_domain string, verdict string")
    df = rules.apply_rules(located(spark, sf_dir), own)
    return df.groupBy("field", "domain").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "skip").alias("skipped"))


STATS_SQL = UNITS_SQL + f"""
, f AS (SELECT u.doc_id, u.source AS domain, {FIELD_SQL.replace('doc_id', 'u.doc_id')} || '_' || (u.doc_id % 11) AS field, u.line, t.passthrough, t.target FROM units u JOIN translations t ON u.doc_id = t.doc_id AND u.pos = t.pos),
 stats AS (SELECT field, count(*) AS total, 0::BIGINT AS machine, count(*) FILTER (NOT passthrough AND line = target) AS identical, count(*) FILTER (passthrough) AS passthrough, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains
  FROM f GROUP BY field)
"""


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = located(spark, sf_dir).withColumn("field", F.concat_ws("_", "field", F.col("doc_id") % 11))
    done = translations(own).select("doc_id", "pos", "passthrough", F.col("target").alias("target_text"))
    return rules.field_stats(own.join(done, ["doc_id", "pos"]).withColumn("source_text", F.col("line")))


@query(STATS_SQL + "SELECT * FROM stats")
def learn_field_stats(spark, sf_dir):
    return learned(spark, sf_dir)


@query(STATS_SQL + """SELECT field, total, CASE WHEN machine = greatest(machine, passthrough, identical) THEN 'machine' WHEN passthrough = greatest(machine, passthrough, identical) THEN 'passthrough' ELSE 'identical' END AS reason,
 greatest(machine, passthrough, identical) / total AS share, CASE WHEN NOT contains(domains, ',') THEN domains END AS domain FROM stats WHERE total >= 4 AND greatest(machine, passthrough, identical) / total >= 0.75""")
def learn_proposals(spark, sf_dir):
    return rules.propose_skips(learned(spark, sf_dir))


@query("""
SELECT conv_id, turn, role, left(lag(text) OVER w, 120) AS prev_text, left(lead(text) OVER w, 120) AS next_text, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def scene_neighbors(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("text", F.left("text", F.lit(120)))
    return batching.neighbours(df, ["conv_id"], ["turn"], "text", "role").select("conv_id", "turn", "role", "prev_text", "next_text", "prev_role", "next_role")


@query("""
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 p AS (SELECT conv_id, turn, k, size AS used, 1 AS n, 0 AS batch FROM r WHERE k = 1
  UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN p.used + r.size > 2500 OR p.n >= 6 THEN r.size ELSE p.used + r.size END,
   CASE WHEN p.used + r.size > 2500 OR p.n >= 6 THEN 1 ELSE p.n + 1 END, p.batch + CASE WHEN p.used + r.size > 2500 OR p.n >= 6 THEN 1 ELSE 0 END FROM p JOIN r ON r.conv_id = p.conv_id AND r.k = p.k + 1)
SELECT conv_id, turn, batch::BIGINT AS batch FROM p""")
def batch_pack(spark, sf_dir):
    """Batches of up to 2,500 characters and six turns within a conversation."""
    df = table(spark, sf_dir, "conversations").withColumn("size", F.char_length("text"))
    return batching.pack(df, ["conv_id"], "turn", "size", 2500, 6)


@query("""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
 r AS (SELECT doc_id, pos, length(line) + 1 AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM raw WHERE line <> ''),
 p AS (SELECT doc_id, pos, k, size AS used, 0 AS batch FROM r WHERE k = 1
  UNION ALL SELECT r.doc_id, r.pos, r.k, CASE WHEN p.used + r.size > 3500 THEN r.size ELSE p.used + r.size END, p.batch + CASE WHEN p.used + r.size > 3500 THEN 1 ELSE 0 END FROM p JOIN r ON r.doc_id = p.doc_id AND r.k = p.k + 1)
SELECT doc_id, batch::BIGINT AS batch, count(*) AS n_lines, sum(used * 0 + 1)::BIGINT AS n, min(pos)::BIGINT AS first_pos FROM p GROUP BY ALL""")
def glossary_source_batches(spark, sf_dir):
    """Trimmed lines of a document joined up to 3,500 characters, each line feed counted."""
    own = line_sources.lines(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("line", F.trim("line")).where("line <> ''")
    packed = batching.pack(own.withColumn("size", F.char_length("line") + 1), ["doc_id"], "pos", "size", 3500, 1 << 30)
    return packed.groupBy("doc_id", "batch").agg(F.count("*").alias("n_lines"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))


TERMS_SQL = "terms AS (SELECT DISTINCT lower(w) AS src FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w FROM benchmark))"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the benchmark as a glossary."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.lower("w").alias("src")).distinct()


OCCURS_SQL = f"WITH {TERMS_SQL}, o AS (SELECT src, doc_id FROM documents, terms WHERE contains(text, src)), c AS (SELECT src, count(*) AS count FROM o GROUP BY src) "


@query(OCCURS_SQL + "SELECT src, count FROM c")
def glossary_occurrences(spark, sf_dir):
    hits = glossary.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), terms(spark, sf_dir))
    return hits.groupBy("src").agg(F.count("*").alias("count"))


@query(OCCURS_SQL + ", k AS (SELECT * FROM c ORDER BY count DESC, src LIMIT 20) SELECT src, count, upper(left(src, 1)) || substr(src, 2) AS dst FROM k WHERE NOT ends_with(src, 's')")
def glossary_topk(spark, sf_dir):
    """The twenty most frequent terms, then those without a translation of their own dropped: fewer than twenty may remain."""
    top = glossary_occurrences(spark, sf_dir).orderBy(F.desc("count"), "src").limit(20)
    dst = F.when(~F.endswith("src", F.lit("s")), F.concat(F.upper(F.left("src", F.lit(1))), F.substring("src", 2, 1000)))
    return top.select("src", "count", dst.alias("dst")).where("dst is not null")


@query("""
WITH v AS (SELECT user_id AS src, event_type AS dst FROM events), n AS (SELECT src, dst, count(*) AS votes FROM v GROUP BY ALL)
SELECT src, dst, votes, n_cast FROM (SELECT *, sum(votes) OVER (PARTITION BY src)::BIGINT AS n_cast, row_number() OVER (PARTITION BY src ORDER BY votes DESC, dst) AS k FROM n) WHERE k = 1""")
def glossary_vote_winner(spark, sf_dir):
    return glossary.vote_winner(table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst")), "src", "dst")


@query(f"WITH {TERMS_SQL}" + """, o AS (SELECT src, doc_id % 3 <> 0 AS used FROM documents, terms WHERE contains(text, src))
SELECT src, count(*) AS occurrences, count(*) FILTER (used) AS applied, count(*) FILTER (NOT used) AS missed FROM o GROUP BY src HAVING count(*) FILTER (NOT used) > 0""")
def glossary_check(spark, sf_dir):
    """Whether translations use the terms of their sources; here every third document's translation lacks them."""
    done = F.when(F.col("doc_id") % 3 != 0, F.upper("text")).otherwise("")
    known = terms(spark, sf_dir).withColumn("dst", F.upper("src"))
    hits = glossary.applied(table(spark, sf_dir, "documents").select("doc_id", "text", done.alias("done")), known, "text", "done")
    return hits.groupBy("src").agg(F.count("*").alias("occurrences"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("missed")).where("missed > 0")


@query(OCCURS_SQL + """, h AS (SELECT doc_id, src, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, src) AS rank FROM o JOIN c USING (src)) SELECT doc_id, src, count, rank FROM h WHERE rank <= 3""")
def glossary_batch_select(spark, sf_dir):
    counted = glossary_occurrences(spark, sf_dir)
    return glossary.select_for(table(spark, sf_dir, "documents").select("doc_id", "text"), counted, ["doc_id"], 3)


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS own FROM documents),
 d AS (SELECT doc_id, own, CASE doc_id % 5 WHEN 0 THEN list_transform(own, lambda x: ' ') WHEN 1 THEN own[2:] WHEN 2 THEN list_concat(own[:len(own) - 1], [' ']) WHEN 3 THEN list_concat(own, ['more']) ELSE own END AS done FROM l)
SELECT doc_id, CASE WHEN len(list_filter(done, lambda x: regexp_matches(x, '[^\s]'))) = 0 THEN 'translation is empty'
 WHEN doc_id % 5 <> 3 AND len(own) <> len(done) THEN 'line count differs'
 WHEN doc_id % 5 = 2 AND regexp_matches(own[-1], '[^\s]') THEN 'a line is blank'
 WHEN doc_id % 5 = 3 AND len(done) <> 1 THEN 'more than one line' END AS error FROM d""")
def structure_check(spark, sf_dir):
    """Each text's lines against themselves with all of them blank, the first gone, the last blank or one more."""
    k, own = F.col("doc_id") % 5, F.col("own")
    made = F.when(k == 0, F.transform(own, lambda x: F.lit(" "))).when(k == 1, F.slice(own, F.lit(2), F.size(own))).when(k == 2, F.concat(F.slice(own, F.lit(1), F.size(own) - 1), F.array(F.lit(" ")))).when(k == 3, F.concat(own, F.array(F.lit("more")))).otherwise(own)
    df = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("own"))
    return df.select("doc_id", review.structure_error(F.when(k == 3, "short_text").otherwise("array"), own, made).alias("error"))


# Translations of all kinds: lines with kana of each kind, copies, lost literals, Latin words kept, by position and document.
SHOWN_SQL = NUMBERED_SQL + r"""
, made AS (SELECT *, CASE WHEN passthrough THEN line WHEN doc_id % 11 = 0 THEN line WHEN pos % 6 = 0 THEN '你们好っ' WHEN pos % 6 = 1 THEN '你们好っす' WHEN pos % 6 = 2 THEN 'これは' || line WHEN pos % 6 = 3 THEN '译文 ' || line ELSE '译文' || repeat('%%', len(string_split(line, '%%')) - 1) END AS shown, len(string_split(line, '%%')) - 1 AS n_literals FROM numbered WHERE found),
 flagged AS (SELECT *, array_to_string(string_split(shown, '%%'), ' ') AS seen, NOT passthrough AND doc_id % 11 <> 0 AS other FROM made),
 flags AS (SELECT doc_id, pos, passthrough, NOT other AS identical, other AND pos % 6 = 0 AS kana_edge, other AND pos % 6 = 1 AS kana_mixed, other AND pos % 6 = 2 AS kana_untranslated, other AND pos % 6 IN (0, 1) AND n_literals > 0 AS control_loss,
   NOT passthrough AND len(list_filter(regexp_extract_all(seen, '[A-Za-z]{2,}'), lambda w: NOT regexp_full_match(w, '[A-Z]{2,4}'))) > 0 AS residual_latin FROM flagged)
"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, done = numbered(units(spark, sf_dir))
    df = store.matched(own, done)
    k, percent = F.col("pos") % 6, F.repeat(F.lit("%%"), F.size(F.split("line", "%%")) - 1)
    target = F.when((k == 0), "你们好っ").when(k == 1, "你们好っす").when(k == 2, F.concat(F.lit("これは"), "line")).when(k == 3, F.concat(F.lit("译文 "), "line")).otherwise(F.concat(F.lit("译文"), percent))
    target = F.when(F.col("doc_id") % 11 == 0, F.col("line")).otherwise(target)
    return df.select("doc_id", "pos", "passthrough", F.lit("short_text").alias("item_type"), F.array("line").alias("original_lines"), F.when(F.col("passthrough").isNotNull(), F.array(target)).alias("translation_lines"))


@query(SHOWN_SQL + """
, rows AS (SELECT doc_id, pos, unnest(['identical', 'kana_edge', 'kana_mixed', 'kana_untranslated', 'control_loss', 'residual_latin', 'residual_source']) AS bucket, unnest([identical, kana_edge, kana_mixed, kana_untranslated, control_loss, residual_latin, kana_edge OR kana_mixed OR kana_untranslated]) AS hit FROM flags
  UNION ALL SELECT doc_id, pos, 'passthrough', passthrough FROM flags UNION ALL SELECT doc_id, pos, 'pending', NOT found FROM numbered),
 top AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, pos) AS k FROM rows WHERE hit)
SELECT bucket, count(*) AS n, max(CASE WHEN k <= 40 THEN doc_id END) AS last_doc, count(*) FILTER (k <= 40) AS n_samples FROM top GROUP BY bucket""")
def review_buckets(spark, sf_dir):
    """All buckets of a review with the first forty units of each."""
    df = review.inspected(reviewed(spark, sf_dir), F.lit("en"), F.lit("zh"))
    named = {b: F.col(b) for b in review.BUCKETS} | {"passthrough": F.col("passthrough"), "pending": F.col("passthrough").isNull()}
    found = review.buckets(df, named, "doc_id", "pos")
    return found.select("bucket", "n", F.array_max(F.transform("sample", lambda x: x["doc_id"])).alias("last_doc"), F.size("sample").cast("long").alias("n_samples"))


@query(SHOWN_SQL + "SELECT doc_id, pos FROM flags WHERE passthrough OR identical OR control_loss OR kana_edge OR kana_mixed OR kana_untranslated")
def blocking_ids(spark, sf_dir):
    """Units that may not be written, by the whole check."""
    return review.blocking(reviewed(spark, sf_dir), F.lit("en"), F.lit("zh")).select("doc_id", "pos")


@query(SHOWN_SQL + """SELECT doc_id, pos, CASE WHEN control_loss THEN 'literals lost' WHEN identical AND NOT passthrough THEN 'same as the source' WHEN kana_edge OR kana_mixed OR kana_untranslated THEN 'kana in Chinese' END AS fault FROM flags WHERE NOT passthrough""")
def translation_fault(spark, sf_dir):
    """The first fault of every translation."""
    df = review.with_masks(reviewed(spark, sf_dir).where("not passthrough").withColumn("lines", F.col("translation_lines")))
    return df.select("doc_id", "pos", review.fault(F.lit("en"), F.lit("zh")).alias("fault"))


@query(UNITS_SQL + r"""
, a AS (SELECT doc_id, pos, line, len(string_split(line, '%%')) - 1 AS n FROM units),
 m AS (SELECT *, array_to_string(list_transform(generate_series(0, n), lambda k: '[CTRL_' || CASE WHEN pos % 4 = 1 AND k > 0 THEN k - 1 WHEN pos % 4 = 2 THEN n - k ELSE k END || ']'), ' ') AS answer FROM a)
SELECT doc_id, pos, CASE WHEN pos % 4 = 1 AND n > 0 THEN 'mask twice' WHEN pos % 4 = 2 AND n > 0 THEN 'masks out of order' WHEN pos % 4 = 3 THEN 'unknown mask' END AS fault,
 CASE WHEN pos % 4 = 0 OR n = 0 AND pos % 4 <> 3 THEN '译 ' || '\C[1]' || repeat(' %%', n) END AS target FROM m""")
def accepted_answers(spark, sf_dir):
    """A model's answers for each line after a control: masks in order, one twice, reversed, or one that is unknown."""
    own = units(spark, sf_dir).select("doc_id", "pos", F.array(F.concat(F.lit("\\C[1]"), "line")).alias("original_lines"), (F.size(F.split("line", "%%")) - 1).alias("n"), F.lit("short_text").alias("item_type"))
    k = F.col("pos") % 4
    number = lambda i: F.when((k == 1) & (i > 0), i - 1).when(k == 2, F.col("n") - i).otherwise(i)
    answer = F.array_join(F.transform(F.sequence(F.lit(0), "n"), lambda i: F.concat(F.lit("[CTRL_"), number(i), F.lit("]"))), " ")
    answer = F.concat(F.lit("译 "), answer, F.when(k == 3, " [CTRL_999]").otherwise(""))
    out = review.accepted(own.withColumn("answer", F.array(answer)), F.lit("en"), F.lit("zh"))
    return out.select("doc_id", "pos", "fault", F.when(F.col("fault").isNull(), F.col("lines")[0]).alias("target"))


@query(UNITS_SQL + r"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'short_text' ELSE 'long_text' END AS item_type, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE len(parts) + 1 END::BIGINT AS n_lines,
 CASE WHEN doc_id % 2 = 0 THEN regexp_replace(array_to_string(parts, chr(10)), '\n+', ' ', 'g') || ' 你们好哦～' ELSE array_to_string(parts, chr(10)) || chr(10) || '你们好哦～' END AS text
FROM (SELECT doc_id, string_split(regexp_replace(text, '[ \t]*\n[ \t]*', chr(10), 'g'), chr(10)) AS parts FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x{024F}]'))""")
def normalised_lines(spark, sf_dir):
    """Each text in one string with carriage returns, a Chinese line with sounds, and blank lines at the end: as one line, or as lines."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x{024F}]"))
    text = F.regexp_replace("text", r"[ \t]*\n[ \t]*", "\n")
    short = F.col("doc_id") % 2 == 0
    made = F.concat(F.replace(text, F.lit("\n"), F.lit("\r\n")), F.when(short, "\r").otherwise("\n"), F.lit("你们好っすっー"), F.when(short, "").otherwise("\n\r\n "))
    df = docs.select("doc_id", F.when(short, "short_text").otherwise("long_text").alias("item_type"), F.array(made).alias("lines"))
    df = df.withColumn("out", quality.normalised(F.col("lines"), F.col("item_type"), F.array(F.lit("x")), F.array(F.lit("x")), F.lit("zh")))
    return df.select("doc_id", "item_type", F.size("out").cast("long").alias("n_lines"), F.array_join("out", "\n").alias("text"))


@query(r"""
WITH made AS (SELECT doc_id, string_split('# ' || replace(text, chr(10), chr(10) || '```' || chr(10) || '> - '), chr(10)) AS parts FROM documents),
 l AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM made),
 f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM l),
 b AS (SELECT doc_id, pos, regexp_replace(line, '^(# |> - )', '') AS line, CASE WHEN starts_with(line, '# ') THEN 2 ELSE 4 END AS prefix FROM f WHERE fences % 2 = 0 AND NOT starts_with(line, '```'))
SELECT doc_id, pos, prefix::BIGINT AS prefix, line FROM b WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3""")
def md_lines(spark, sf_dir):
    """Each text as a heading, then its lines as quoted list items with fences between them."""
    made = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n```\n> - ")))
    df = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return line_sources.md_units(df, F.lit("en"), "text", "doc_id").select("doc_id", "pos", "prefix", F.col("original_lines")[0].alias("line"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 b AS (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM l)
SELECT doc_id, i::BIGINT AS pos, 'c' || lpad(i::VARCHAR, 5, '0') AS location, 's' || lpad((i // 40)::VARCHAR, 4, '0') AS context, line FROM b WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3""")
def srt_cues(spark, sf_dir):
    """Each line of a text as a cue with a number and a timing line."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), F.trim(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))))
    df = table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, "\n\n").alias("text"))
    return line_sources.cue_units(df, F.lit("en"), "text", "doc_id").select("doc_id", "pos", "location", "context", F.array_join("original_lines", "\n").alias("line"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, pos + 1 AS pos, line FROM l WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 AND pos % 2 = 1""")
def lrc_lines(spark, sf_dir):
    """A metadata line, then lines of which every other one has time tags."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, "[00:12.00][01:15]").otherwise("[ti:x]"), x))
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[ar:someone]\n"), F.array_join(parts, "\n")).alias("text"))
    return line_sources.lrc_units(df, F.lit("en"), "text", "doc_id").select("doc_id", "pos", F.col("original_lines")[0].alias("line"))


@query(r"SELECT doc_id, 2 * length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS width FROM documents")
def layout_width(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scripts.display_width(F.col("text")).alias("width"))


@query("""
WITH p AS (SELECT string_split(string_split(url, '?')[1], '/')[-1] AS name FROM pages)
SELECT CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS extension, count(*) AS n FROM p GROUP BY 1""")
def dir_extension_counts(spark, sf_dir):
    name = F.substring_index(F.substring_index("url", "?", 1), "/", -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return table(spark, sf_dir, "pages").groupBy(extension.alias("extension")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, 1000 + turn, role, 'new' FROM conversations WHERE turn = 0")
def upsert_latest(spark, sf_dir):
    """Every other turn replaced, and a new turn for each first one."""
    df = table(spark, sf_dir, "conversations")
    new = df.where("turn % 2 = 0").withColumn("text", F.upper("role"))
    added = df.where("turn = 0").withColumn("turn", F.col("turn") + 1000).withColumn("text", F.lit("new"))
    return store.upsert(df, new.unionByName(added), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(UNITS_SQL + """, a AS (SELECT DISTINCT id FROM units), b AS (SELECT DISTINCT left(sha256('txt' || chr(0) || location || chr(0) || (CASE WHEN doc_id % 10 = 0 THEN upper(left(line, 3)) || substr(line, 4) ELSE line END) || chr(10)), 24) AS id FROM units WHERE NOT regexp_matches(left(line, 3), '[^A-Za-z ]'))
SELECT 'gone' AS side, id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'new', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def snapshot_diff(spark, sf_dir):
    """Ids that a second reading of changed sources lacks or adds."""
    own = units(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.upper(F.left("line", F.lit(3))), F.substring(F.col("line"), F.lit(4), F.char_length("line")))).otherwise(F.col("line"))
    again = own.where(~F.left("line", F.lit(3)).rlike("[^A-Za-z ]")).select(ids.unit_id(F.lit("txt"), F.col("location"), F.array(changed)).alias("id"))
    a, b = own.select("id").distinct(), again.distinct()
    return a.join(b, "id", "left_anti").select(F.lit("gone").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("new").alias("side"), "id"))


@query("""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM r WHERE turn % 3 <> 1)
SELECT conv_id, turn, (k // greatest(1, n // 2))::BIGINT AS batch FROM f""")
def retry_split(spark, sf_dir):
    """Conversations as batches: the turns that a model got wrong, in batches half as wide as the one they came from."""
    df = table(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).where("turn % 3 <> 1")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return df.select("conv_id", "turn", F.floor(k / F.greatest(F.lit(1), F.floor(F.col("n") / 2))).cast("long").alias("batch"))


@query(UNITS_SQL + f"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY lpad(pos::VARCHAR, 20, '0')) AS rank FROM units")
def natural_order(spark, sf_dir):
    """Units of a document ranked by location with its numbers taken as numbers."""
    own = units(spark, sf_dir).withColumn("bare", F.concat(F.lit("Map/"), "pos", F.lit("/x")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(scripts.natural_key(F.col("bare"))))
    return own.select("doc_id", "pos", rank.cast("long").alias("rank"))


@query()
def html_leaf_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return markup.html_units(pages, F.lit("auto"), "html", "page_id").select("page_id", "index", "location", "context", "id", F.array_join("original_lines", "\n").alias("text"))


# Of the literals that the grammar knows, the texts hold doubled percent signs alone; the queries add others.
PERCENT_SQL = "string_split(line, '%%') AS parts"


@query(UNITS_SQL + f"""
, p AS (SELECT doc_id, pos, line, {PERCENT_SQL} FROM units)
SELECT doc_id, pos, '[CTRL_0]' || array_to_string(list_transform(generate_series(1, len(parts)), lambda k: CASE WHEN k = 1 THEN parts[1] ELSE '[CTRL_' || (k - 1) || ']' || parts[k] END), '') || ' [CTRL_' || len(parts) || ']' AS masked,
 (len(parts) + 1)::BIGINT AS n_literals, 1::BIGINT AS lost, '\\C[' || pos || ']' || line || ' {{name}}' AS back, ' ' || array_to_string(parts, ' ') || '  ' AS visible FROM p""")
def mask_and_lost_tokens(spark, sf_dir):
    """A control and a placeholder around each line, whatever literals it has: masked, restored, and the control lost."""
    own = units(spark, sf_dir).withColumn("full", F.concat(F.lit("\\C["), "pos", F.lit("]"), "line", F.lit(" {name}"))).withColumn("m", masks.masked(F.array("full")))
    done = F.array(F.concat(F.lit("{name} "), F.upper("line")))
    own = own.select("doc_id", "pos", "m", masks.lost(done, F.col("m.literals")).alias("lost"), masks.unmasked(F.col("m.masked"), F.col("m.literals")).alias("back"))
    return own.select("doc_id", "pos", F.col("m.masked")[0].alias("masked"), F.size("m.literals").cast("long").alias("n_literals"), "lost", F.col("back")[0].alias("back"), F.col("m.visible")[0].alias("visible"))


@query(r"""
SELECT doc_id, 'r000000/1' AS location, 'short_text' AS item_type, 'text' AS cell FROM documents
UNION ALL SELECT doc_id, 'r000001/1', CASE WHEN contains(text, chr(10)) THEN 'long_text' ELSE 'short_text' END, text FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3""")
def csv_cells(spark, sf_dir):
    """Each text as a quoted cell after its id, under a header."""
    made = F.concat(F.lit("id,text\r\n"), F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n'))
    df = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return tables.csv_units(df, F.lit("en"), "text", "doc_id").select("doc_id", "location", "item_type", F.array_join("original_lines", "\n").alias("cell"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, 'e' || lpad(k::VARCHAR, 5, '0') AS location, 's' || lpad((k // 40)::VARCHAR, 4, '0') AS context, line AS msgid FROM l WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3""")
def po_entries(spark, sf_dir):
    """Each line of a text as a catalogue's entry, after a header."""
    quoted = lambda x: F.concat(F.lit('msgid "'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"\nmsgstr ""'))
    made = F.concat(F.lit('msgid ""\nmsgstr "x"\n\n'), F.array_join(F.transform(F.split("text", "\n"), quoted), "\n\n"))
    df = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return tables.po_units(df, F.lit("en"), "text", "doc_id").select("doc_id", "location", "context", F.array_join("original_lines", "\n").alias("msgid"))


@query(r"""
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events), v AS (SELECT event_id, path, json_extract(props, '$."' || path || '"') AS j FROM k)
SELECT event_id, path, CASE WHEN json_type(j) = 'VARCHAR' THEN 'string' WHEN json_type(j) = 'BOOLEAN' THEN 'boolean' WHEN json_type(j) = 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' END AS value FROM v""")
def json_leaves(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props")
    return tables.exploded(df, "props", ("event_id",), "leaf long, path string, value string, kind string", tables.json_leaves).select("event_id", "path", "kind", "value")


@query(UNITS_SQL + """
, new AS (SELECT l.doc_id, l.pos, CASE WHEN u.pos IS NOT NULL THEN '<' || l.line || '>' ELSE l.line END AS line FROM lines l LEFT JOIN units u ON u.doc_id = l.doc_id AND u.pos = l.pos)
SELECT d.doc_id, coalesce(x.text || CASE WHEN ends_with(d.text, chr(10)) THEN chr(10) ELSE '' END, d.text) AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM new GROUP BY doc_id) x ON x.doc_id = d.doc_id""")
def render_txt(spark, sf_dir):
    """Texts with each unit's line replaced."""
    own = units(spark, sf_dir).select("doc_id", "pos", F.lit("").alias("prefix"), F.concat(F.lit("<"), "line", F.lit(">")).alias("target"))
    return render.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), own, ["doc_id"])


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'edge' WHEN 1 THEN 'mixed' WHEN 2 THEN 'untranslated' WHEN 3 THEN 'mixed' END AS kind FROM documents""")
def kana_kind(spark, sf_dir):
    """A line of each kind after each text's first line; one in five has none."""
    k = F.col("doc_id") % 5
    made = F.when(k == 0, "你好っ").when(k == 1, "你们好っす").when(k == 2, "これはテストです").when(k == 3, "hello ね").otherwise("plain")
    target = F.when(k == 3, "en").otherwise("zh")
    df = table(spark, sf_dir, "documents").select("doc_id", F.array(F.regexp_extract("text", r"\A[^\n]*", 0), made).alias("lines"), target.alias("target"))
    return df.select("doc_id", kana.kana_kind(F.col("lines"), F.col("target")).alias("kind"))


@query("""
WITH l AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN '【' || source || '】' ELSE '[' || lang || ']' END AS label FROM documents)
SELECT left(label, 1) AS open, right(label, 1) AS close, count(*) AS n_units, count(DISTINCT label) AS n_labels, array_to_string(list_sort(list(DISTINCT source)), ',') AS domains, min(label) AS sample FROM l GROUP BY 1, 2""")
def layout_shapes(spark, sf_dir):
    """Each document under a label of its source or language."""
    label = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("【"), "source", F.lit("】"))).otherwise(F.concat(F.lit("["), "lang", F.lit("]")))
    df = table(spark, sf_dir, "documents").select(F.array(label, "text").alias("original_lines"), F.col("source").alias("domain"))
    return layout.propose(layout.label_shapes(df))


@query("""
WITH d AS (SELECT lang, doc_id, len(string_split(text, '%%')) - 1 AS n FROM documents)
SELECT lang, count(*) AS n_units, sum(n + 2)::BIGINT AS n_controls, count(*) FILTER (doc_id % 3 = 0) AS lossy_units, sum(CASE WHEN doc_id % 3 = 0 THEN n + 1 ELSE 0 END)::BIGINT AS lost FROM d GROUP BY lang""")
def control_loss_rate(spark, sf_dir):
    """Two controls before each text; every third translation keeps the first alone."""
    source = F.array(F.concat(F.lit("\\C[1]{name} "), "text"))
    done = F.array(F.when(F.col("doc_id") % 3 == 0, F.lit("\\C[1] done")).otherwise(F.concat(F.lit("{name} \\C[1] "), F.upper("text"))))
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", masks.masked(source).alias("m"), done.alias("done"))
    df = df.select("lang", F.size("m.literals").alias("n"), masks.lost("done", "m.literals").alias("lost"))
    return df.groupBy("lang").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_controls"), F.count_if(F.col("lost") > 0).alias("lossy_units"), F.sum("lost").alias("lost"))


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER w - 1 AS k, role || ' 「' || replace(left(lag(text) OVER w, 120), chr(10), ' / ') || '」' AS prev, lag(role) OVER w AS prev_role, role || ' 「' || replace(left(lead(text) OVER w, 120), chr(10), ' / ') || '」' AS next, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 b AS (SELECT *, k // 3 AS batch, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
 g AS (SELECT *, CASE WHEN k % 3 = 0 AND k > 0 THEN prev_role || substr(prev, length(split_part(prev, ' ', 1)) + 1) END AS p, CASE WHEN k % 3 = 2 AND k < n - 1 THEN next_role || substr(next, length(split_part(next, ' ', 1)) + 1) END AS x FROM b),
 s AS (SELECT *, max(CASE WHEN p IS NOT NULL THEN 54 + least(length(p), 240, 150 - 54) ELSE 0 END) OVER (PARTITION BY conv_id, batch) AS used FROM g)
SELECT conv_id, turn, batch::BIGINT AS batch, left(p, least(150 - 54, 240)) AS prev, CASE WHEN 150 - used > 54 THEN left(x, least(150 - used - 54, 240)) END AS next FROM s""")
def context_budget(spark, sf_dir):
    """What each turn of a batch of three is shown of the turns beside the batch, of a budget of 150 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumn("batch", F.floor((F.row_number().over(w) - 1) / 3))
    inside = [F.coalesce(f("batch").over(w) == F.col("batch"), F.lit(False)).alias(f"{side}_inside") for side, f in (("prev", F.lag), ("next", F.lead))]
    df = df.select("conv_id", "turn", "batch", *inside, "role", F.array("text").alias("original_lines"), F.array().cast("array<string>").alias("translation_lines"), F.lit(None).cast("boolean").alias("passthrough"))
    own = batching.snapshots(df, ["conv_id"], ["turn"])
    own = own.withColumn("prev", batching.context_text(F.col("prev"))).withColumn("next", batching.context_text(F.col("next")))
    return batching.contexts(own, ["conv_id", "batch"], "turn", 150)


SHAPES_SQL = """CASE doc_id % 6 WHEN 0 THEN 'paratranz' WHEN 1 THEN 'vnt' WHEN 2 THEN 'mtool' WHEN 3 THEN CASE WHEN len(string_split(text, chr(10))) >= 4 THEN 'i18next' END WHEN 5 THEN 'mtool' END"""


@query(f"SELECT doc_id, {SHAPES_SQL} AS shape FROM documents UNION ALL SELECT event_id, NULL FROM events")
def json_shape_detect(spark, sf_dir):
    """Each text in a JSON file of one of the exchange formats, or of none; and the events' properties, which are none."""
    text, k = F.col("text"), F.col("doc_id") % 6
    made = (
        F.when(k == 0, F.to_json(F.array(F.struct(F.lit("a").alias("key"), text.alias("original")))))
        .when(k == 1, F.to_json(F.array(F.struct(F.lit("A").alias("name"), text.alias("message")))))
        .when(k == 2, F.to_json(F.create_map(text, text)))
        .when(k == 3, F.to_json(F.struct(F.split(text, "\n").alias("lines"), F.lit(1).alias("n"))))
        .when(k == 4, F.concat(F.lit("{"), F.to_json(F.create_map(F.lit("x"), text))))
        .otherwise(F.to_json(F.create_map(F.lit("名前"), text)))
    )
    df = table(spark, sf_dir, "documents").select("doc_id", made.alias("json"))
    df = df.unionByName(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json")))
    return df.select("doc_id", tables.json_shapes(F.col("json")).alias("shape"))
