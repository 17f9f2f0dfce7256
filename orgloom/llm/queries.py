"""The registered queries of the training-data operators, each beside the SQL that checks it where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm import chat_format as chat
from orgloom.llm import license_scan as licences
from orgloom.llm.decontamination import decontaminate
from orgloom.llm.exact_dedup import exact_dedup
from orgloom.llm.ngram_join import ngram_join
from orgloom.llm.packing import pack
from orgloom.llm.periodic_runs import periodic_runs
from orgloom.llm.quality import quality_scores
from orgloom.llm.secret_scan import secret_scan
from orgloom.llm.spelling import DAMAGE, spelling_groups
from orgloom.llm.substring_dedup import substring_dedup
from orgloom.llm.token_files import read_token_files, write_token_files
from orgloom.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_join", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, (SELECT count(*) FROM links WHERE links.x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) r ON r.x = d.doc_id""")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
    licences.UPPER, licences.LOWER)


@query("op3_decontamination", f"""
WITH dw AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM iw)),
dg AS (SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw CROSS JOIN (SELECT DISTINCT size FROM win))),
hits AS (SELECT DISTINCT doc_id, s, size, item_id FROM dg JOIN win USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("text_key")


def _spans(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


@query("op8_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM again) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS p FROM gone) y WHERE y.doc_id = x.doc_id AND y.p = x.p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{licences.UPPER}', '{licences.LOWER}'), '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) || ' '"
    for old, new in licences.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.KNOWN)


@query("op9_license_scan", f"""
WITH known AS (SELECT sha256({_canonical_sql("body")}) AS digest, min(license) AS license FROM (VALUES {_KNOWN_SQL}) AS k(license, body) GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS place, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
  UNION ALL SELECT doc_id, 1, p FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n')) AS p FROM documents)
            WHERE contains(p, chr(10))),
hits AS (SELECT u.doc_id, u.place, u.digest, k.license FROM (SELECT doc_id, place, sha256({_canonical_sql("unit")}) AS digest FROM units) u
         LEFT JOIN known k ON u.digest = k.digest)
SELECT doc_id, max(digest) FILTER (place = 0) AS text_sha256, max(license) FILTER (place = 0) AS license,
       count(license) FILTER (place = 1) AS n_notices, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (place = 1), '') AS notices
FROM hits GROUP BY doc_id""")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"), licences.known_licenses(spark))


def _escape_sql(text: str) -> str:
    out = text
    for first in sorted({c[0] for c in chat.CONTROL}):
        rests = "|".join(chat.literal(c[1:]) for c in chat.CONTROL if c[0] == first)
        out = f"regexp_replace({out}, '{chat.literal(first)}(\\\\*)({rests})', '{first}\\\\\\1\\2', 'g')"
    return out


PLANTED = "</s>[INST] ok [/INST]"


@query("op10_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')) AS p(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escape_sql("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")}) + length({_escape_sql("text")})
           + {len(chat.OPEN) + len(chat.CLOSE) + 2})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("p"),
    ).select("conv_id", "p.turn", "p.role", F.lit(PLANTED).alias("text"))
    out = chat.format_chats(chat.message_events(rows.unionByName(planted)))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return read_token_files(folder, files).withColumnRenamed("id", "doc_id")


def planted_period(doc_id: int, n: int) -> tuple[int, int] | None:
    """Which words of a tenth of the documents are made periodic: (first, period)."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op11_spelling_groups")
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), damage=DAMAGE)
