"""Registered queries of text and number forms, readers and writers, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import numbers, text
from tamiz.operators import audit, governance
from tamiz.plans.catalogue import _TOKENS, _WORDS, query
from tamiz.session import load, new_folder
from tamiz.sources import files, scans


@query(rf"""SELECT doc_id, array_to_string(list_transform(q, lambda w: '"' || w || '"'), ' OR ') AS expression, len(q) AS n_terms FROM (
  SELECT doc_id, list_filter(list_transform(t, lambda w, i: CASE WHEN list_position(t, w) = i THEN w END), lambda w: w IS NOT NULL) AS q FROM (SELECT doc_id, list_filter({_TOKENS}, lambda w: length(w) > 2) AS t FROM documents))""")
def match_expressions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.match_expression(F.col("text")).alias("expression"), F.size(text.query_terms(F.col("text"))).alias("n_terms"))


@query(rf"""SELECT doc_id, array_to_string(list_transform(list_filter({_WORDS}, lambda w: length(w) > 2), lambda w: lower(regexp_replace(w, '^[.,;:¿?¡!]+|[.,;:¿?¡!]+$', '', 'g'))), ' ') AS keywords,
  trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS collapsed, regexp_matches(lower(text), 'caus|efect|effect|increas') AS stem FROM documents""")
def keyword_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(t), " ").alias("keywords"), text.collapse(t).alias("collapsed"), text.has_stem(t, ["caus", "efect", "effect", "increas"]).alias("stem"))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.1000/ab' || o_custkey WHEN 1 THEN '10.1000/ab' || o_custkey ELSE 'ab' || o_custkey END AS doi, CASE WHEN o_orderkey % 2 = 0 THEN 'W' || o_custkey ELSE 'w x' END AS work_id,
  lower(o_orderpriority)[1:0] || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', ' ', 'g')) AS match_key, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') || '.' || substr(sha256(o_orderstatus), 1, 12) || '.jsonl' AS cache_name,
  CASE WHEN o_orderkey % 3 < 2 THEN 'doi:10.1000/ab' || o_custkey ELSE 'doi:ab' || o_custkey END || '|id:' || CASE WHEN o_orderkey % 2 = 0 THEN 'w' || o_custkey ELSE 'w x' END AS record_keys FROM orders""")
def identifier_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' numbers as identifiers in several spellings."""
    n, key = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    cited = F.when(key % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/AB"), n)).when(key % 3 == 1, F.concat(F.lit(" doi:10.1000/ab"), n)).otherwise(F.concat(F.lit("AB"), n, F.lit("  ")))
    work = F.when(key % 2 == 0, F.concat(F.lit("https://openalex.org/W"), n)).otherwise(F.lit("w  x"))
    keys = text.record_keys(cited, work, F.lit("unused"))
    return load(spark, sf, "orders").select(
        "o_orderkey", text.doi(cited).alias("doi"), text.work_id(work).alias("work_id"), text.match_key(F.concat(F.lit("a b/"), "o_orderpriority", F.lit(".PDF"))).alias("match_key"),
        text.cache_name(F.col("o_orderpriority"), F.sha2("o_orderstatus", 256)).alias("cache_name"), F.array_join(F.transform(keys, lambda x: F.concat_ws(":", x["kind"], x["v"])), "|").alias("record_keys"),
    )


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' (' || (1900 + c_nationkey) || ')' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS cited,
  CASE WHEN c_custkey % 4 = 0 THEN 'p. ' || c_custkey ELSE 'pp. ' || c_custkey || '–' || (c_custkey + c_custkey % 4) END AS pages,
  '[' || (c_nationkey + 1) || '] ' || c_name || ' — ' || c_mktsegment || ' — p. 1' AS line, 'API ***, c ' || c_custkey AS hidden, '10.1234/x' || c_custkey || '|10.1234/y' AS found, 'http://a.b/' || c_custkey AS url, 'uno dos ' || c_custkey AS quote, c_mktsegment || '|B' AS items FROM customer""")
def citation_forms(spark: SparkSession, sf: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    said = F.concat(F.lit("See 10.1234/X"), n, F.lit("). and 10.1234/y, (10.1234/y); [z](http://a.b/"), n, F.lit(") > “uno dos "), n, F.lit("” and > “" + "w " * 26 + "”"))
    author = F.when(key % 3 < 2, F.col("c_mktsegment")).otherwise("")
    return load(spark, sf, "customer").select(
        "c_custkey", text.citation(author, F.when(key % 3 == 0, (1900 + F.col("c_nationkey")).cast("string")), F.col("c_name")).alias("cited"), text.page_range(key, key + key % 4).alias("pages"),
        text.source_line(F.col("c_nationkey") + 1, F.col("c_name"), F.col("c_mktsegment"), F.lit("p. 1")).alias("line"), text.redact(F.concat(F.lit("API s3cr3t, c "), n), "s3cr3t").alias("hidden"),
        F.array_join(text.identifiers(said), "|").alias("found"), F.array_join(text.urls(said), "|").alias("url"), F.array_join(text.quoted(said), "|").alias("quote"), F.array_join(text.items(F.concat(F.lower("c_mktsegment"), F.lit(" ,, b "))), "|").alias("items"),
    )


@query(r"""WITH x AS (SELECT p_partkey, CASE WHEN last >= a THEN range(a, last + 1) ELSE [] END AS pages FROM (SELECT p_partkey, p_size % 7 + 1 AS a, least(p_size, p_size % 7 + 1 + p_partkey % 30) AS last FROM part))
  SELECT p_partkey, len(pages) AS n_pages, coalesce(list_sum(pages), 0)::BIGINT AS page_sum,
    array_to_string(CASE WHEN len(pages) <= 5 THEN pages ELSE list_sort(list_distinct(list_transform(range(5), lambda i: pages[1 + round_even(i * (len(pages) - 1) / 4.0, 0)::INT]))) END, ',') AS sample FROM x""")
def page_windows(spark: SparkSession, sf: str) -> DataFrame:
    start, size = (F.col("p_size") % 7 + 1).cast("int"), F.col("p_size").cast("int")
    pages = numbers.page_window(size, start, (F.col("p_partkey") % 30 + 1).cast("int"), F.lit(None).cast("int"))
    return load(spark, sf, "part").select("p_partkey", pages.alias("p")).select(
        "p_partkey", F.size("p").alias("n_pages"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("page_sum"), F.array_join(numbers.sample_positions(F.col("p"), 5).cast("array<string>"), ",").alias("sample")
    )


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN nullif(user_id, 0) END AS budget, greatest(0.25, least(0.75, value / 100)) AS clamped, (floor(value)::INT // 60) || ':' || lpad((floor(value)::INT % 60)::VARCHAR, 2, '0') AS minutes,
  'a:' || event_type || ',b:2' AS filter, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 25 END AS per_page FROM events""")
def number_forms(spark: SparkSession, sf: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    asked = F.when(key % 4 == 0, F.lit(" Todo ")).when(key % 4 == 1, user).otherwise("x")
    given = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("event_type"))
    return load(spark, sf, "events").select(
        "event_id", numbers.page_budget(asked).alias("budget"), numbers.clamp(F.col("value") / 100, 0.25, 0.75).alias("clamped"), numbers.minutes(F.col("value")).alias("minutes"), numbers.sorted_filter(given).alias("filter"),
        numbers.limit_or(F.when(key % 2 == 0, user).otherwise(" "), 25).alias("per_page"),
    )


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text, coalesce(lang, '') AS lang, n_chars % 1000 AS n FROM documents")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the CSV sink and its strict reader."""
    path = new_folder(spark, "csv")
    files.write_csv(load(spark, sf, "documents").select("doc_id", "text", "lang", (F.col("n_chars") % 1000).alias("n")), path, ["doc_id", "lang", "text", "n", "note"])
    back = files.read_csv(spark, path, ("doc_id", "text", "note"))
    return files.integers(back, "doc_id", "n").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("n").cast("long").alias("n"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def jsonl_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Events through JSON lines; each user's last record."""
    path = new_folder(spark, "jsonl")
    files.write_jsonl(load(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), path)
    return files.last_per_key(files.read_jsonl(spark, path, "user_id long, event_id long, event_type string, value double"), "user_id", "event_id")


_KIND = lambda c: f"bit_or(CASE WHEN trim({c}) = '' THEN 0 WHEN regexp_full_match(trim({c}), '(?i)true|false') THEN 1 WHEN regexp_full_match(trim({c}), '[+-]?[0-9]{{1,18}}') THEN 2 WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 4 ELSE 8 END)"
_TYPED = {"o_orderkey": "o_orderkey::VARCHAR", "o_totalprice": "o_totalprice::VARCHAR", "o_custkey": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey::VARCHAR END", "mixed": "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice::VARCHAR ELSE o_custkey::VARCHAR END",
          "late": "CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'x' ELSE '1' END", "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END", "none": "''", "odd": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '1' END"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'boolean' WHEN 2 THEN 'bigint' WHEN 4 THEN 'double' WHEN 6 THEN 'double' ELSE 'string' END AS kind FROM (SELECT {_KIND(v)} AS k FROM orders)" for c, v in _TYPED.items()))
def typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV: the type of each column, from every row; one late word makes a column text."""
    path, key = new_folder(spark, "csv"), F.col("o_orderkey")
    orders = load(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    made = {
        "o_orderkey": key, "o_totalprice": F.col("o_totalprice"), "o_custkey": F.when(key % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")), "mixed": F.when(key % 50 == 0, F.col("o_totalprice").cast("string")).otherwise(F.col("o_custkey").cast("string")),
        "late": F.when(key == last, "x").otherwise("1"), "flag": F.when(key % 2 == 0, "true").otherwise("False"), "none": F.lit(""), "odd": F.when(key % 2 == 0, "true").otherwise("1"),
    }
    files.write_csv(orders.select(*[v.cast("string").alias(c) for c, v in made.items()]), path, list(made))
    return files.inferred(files.read_csv(spark, path))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def jsonl_last_line(spark: SparkSession, sf: str) -> DataFrame:
    """Events through JSON lines in several files, without their order as a column: each user's last line."""
    path = new_folder(spark, "jsonl")
    files.write_jsonl(load(spark, sf, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("user_id", "event_type", "value"), path)
    return files.last_line_per_key(spark, path, "user_id long, event_type string, value double", "user_id")


@query("""SELECT 'T' || n_nationkey AS section, key, CASE key WHEN 'name' THEN n_name ELSE r_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey, unnest(['name', 'region']) t(key)""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sections of one Markdown file, written and read as lines."""
    path = new_folder(spark, "markdown")
    each = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("## T"), "n_nationkey", F.lit("\n\n- name: "), "n_name", F.lit("\n- region:  "), "r_name", F.lit(" \n"))
    each.select(F.concat(F.lit("# Head\nno field\n"), part).alias("value")).write.text(path)
    return files.sections(files.lines(spark, path)).select("section", "key", "text")


def _as_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("line"), "role", F.col("conv_id").alias("c"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn, CASE role WHEN 'user' THEN 'Host' ELSE 'Guest' END AS speaker, 'says ' || turn AS text FROM conversations WHERE role <> 'system'")
def dialogue_turns(spark: SparkSession, sf: str) -> DataFrame:
    who = F.when(F.col("role") == "user", "Host: ").when(F.col("role") == "assistant", "Guest:").otherwise("Note: ")
    return files.turns(_as_lines(spark, sf).withColumn("value", F.concat(who, F.lit("says "), F.col("line").cast("string"))))


@query("""SELECT 'id' AS kind, CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INT) AS line, 'R' || conv_id || '-' || turn AS a, role || ' | x' AS b FROM conversations UNION ALL
  SELECT 'cell', CAST(conv_id AS VARCHAR), CAST(turn AS INT), role, CAST(turn AS VARCHAR) FROM conversations WHERE turn % 2 = 0 UNION ALL
  SELECT CASE turn % 3 WHEN 0 THEN 'removed' ELSE 'added' END, CAST(conv_id AS VARCHAR), CAST(turn AS INT), role, '' FROM conversations WHERE turn % 3 < 2""")
def line_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Identified lines, pipe tables and diffs."""
    of, n = _as_lines(spark, sf), F.col("line").cast("string")
    ids = files.id_lines(of.withColumn("value", F.concat(F.lit("R"), "path", F.lit("-"), n, F.lit(" | "), "role", F.lit(" | x "))))
    rows = files.cells(of.withColumn("value", F.when(F.col("line") % 2 == 0, F.concat(F.lit("| "), "role", F.lit(" | "), n, F.lit(" | c |"))).otherwise("|---|:-:|---|")), 3)
    sign = F.when(F.col("line") % 3 == 0, F.concat(F.lit("-"), "role")).when(F.col("line") % 3 == 1, F.concat(F.lit("+"), "role")).otherwise("--- a/file")
    changed = files.diff(of.withColumn("value", sign))
    return ids.select(F.lit("id").alias("kind"), "path", "line", F.col("id").alias("a"), F.col("text").alias("b")).unionByName(
        rows.select(F.lit("cell").alias("kind"), "path", "line", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))).unionByName(changed.select("kind", "path", "line", F.col("text").alias("a"), F.lit("").alias("b")))


@query("SELECT source AS name, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM documents WHERE source IS NOT NULL GROUP BY 1")
def lock_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A lock file of the documents' sources, written and read."""
    path = new_folder(spark, "lock")
    ids = F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")
    files.write_lock(load(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.sha2(ids, 256).alias("digest")), path)
    return files.lock(files.lines(spark, path))


@query("""WITH r AS (SELECT lang, avg((l.doc_id IS NOT NULL)::INT) AS rate FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1), t AS (SELECT avg((l.doc_id IS NOT NULL)::INT) AS rate FROM documents LEFT JOIN labels l USING (doc_id))
  SELECT 'rows-kept' AS rule, true AS holds UNION ALL SELECT 'key-unique', true UNION ALL SELECT 'coverage', rate >= 0.7 FROM t UNION ALL SELECT 'rate-band', rate BETWEEN 0.7 AND 0.85 FROM t
  UNION ALL SELECT 'gap', (SELECT rate FROM r WHERE lang = 'en') - (SELECT rate FROM r WHERE lang = 'de') >= 0.15""")
def merge_assertions(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = load(spark, sf, "documents").select("doc_id", "lang"), load(spark, sf, "labels").select("doc_id")
    return audit.merge_report(docs, audit.with_indicator(docs, labels, ["doc_id"]), ["doc_id"], F.col("lang"), "en", "de")


@query("SELECT source, round(avg((l.doc_id IS NOT NULL)::INT), 6) AS match_rate, CAST(row_number() OVER (ORDER BY round(avg((l.doc_id IS NOT NULL)::INT), 6), source) AS INT) AS place FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def lowest_rates(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source")
    return audit.by_rate(audit.rates(audit.with_indicator(docs, load(spark, sf, "labels").select("doc_id"), ["doc_id"]), ["source"]), "match_rate", "source").select("source", "match_rate", "place")


@query("""SELECT conv_id, min(s) AS start_s, max(e) AS end_s, count(*) AS n, round(100 / (sum(e - s) + 0.4 * (count(*) - 1)), 6) AS scale FROM (SELECT conv_id, turn * 2.0::DOUBLE AS s, turn * 2.0::DOUBLE + 1.5 AS e FROM conversations) GROUP BY 1""")
def segment_groups(spark: SparkSession, sf: str) -> DataFrame:
    segments = load(spark, sf, "conversations").select("conv_id", (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1.5).alias("end_s"))
    return audit.segments(segments, "conv_id", F.lit(100.0))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'vocabulary' ELSE 'reference' END AS rule FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL
  SELECT event_id, 'reference' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""")
def clip_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as clips: kinds outside a vocabulary, and users that are no customers of the first nations."""
    known = load(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"))
    return governance.clip_problems(load(spark, sf, "events"), "event_id", {"event_type": ("click", "view")}, known, "user_id")


@query("""SELECT conv_id, NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn > 3) AND count(*) = 4 AS same FROM conversations c GROUP BY 1""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a conversation's turns are exactly 0 to 3."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn")
    wanted = turns.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("turn"))
    return audit.same_sets(turns, wanted, "conv_id", "turn")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'corrected ' || doc_id ELSE text END AS text FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND lang = 'en'""")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """English documents as proposals; toxic ones are rejected, good ones corrected; those without a label stay pending."""
    proposals = load(spark, sf, "documents").select("doc_id", "text", "lang")
    verdicts = load(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise("verified").alias("verdict"), F.when(F.col("quality") == 1, F.concat(F.lit("corrected "), "doc_id")).alias("human_correction"))
    screened = proposals.select("doc_id", F.when(F.col("lang") == "en", "include").otherwise("exclude").alias("decision"))
    return governance.verify(proposals.select("doc_id", "text"), verdicts, screened, "doc_id", "text").select("doc_id", "text")


@query("SELECT p_brand AS id, count(*) AS n, min(p_name) AS name FROM part WHERE p_brand = 'Brand#12' GROUP BY 1")
def catalogue_entry(spark: SparkSession, sf: str) -> DataFrame:
    listed = load(spark, sf, "part").select(F.upper("p_brand").alias("id"), "p_name", "p_brand")
    return audit.entry(listed, "id", "brand#12").groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("n"), F.min("p_name").alias("name"))


@query("SELECT query_id, n, CASE WHEN query_id % 2 = 0 THEN 'live' ELSE 'recorded' END AS served_from FROM (SELECT item_id AS query_id, length(text) AS n FROM benchmark)")
def replayed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Even items answered live; the others from a recording that is written and read."""
    path = new_folder(spark, "replay")
    every = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.length("text").cast("long").alias("n"))
    scans.write_replay(every.withColumn("served_from", F.lit("live")), path)
    return scans.served(every.where("query_id % 2 = 0"), files.read_jsonl(spark, path, "query_id long, n long"))


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(" + _TOKENS + ") AS term FROM documents) GROUP BY 1")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of an index that is written and read, by term."""
    from tamiz.operators import retrieval

    path = new_folder(spark, "index")
    scans.write_index({"postings": retrieval.postings(load(spark, sf, "documents").select("doc_id", "text"))}, path)
    return scans.read_index(spark, path, "postings").groupBy("term").agg(F.count("*").alias("df"))
