"""The registered queries of this subpackage: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.token_codes import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.byte_bpe import decode, encode

    path = vocabulary_file("byte_bpe_50k.tiktoken")
    tokens = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.substring import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), r"^ | \z", "")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.toxicity import held_out, scored, train_model, training_rows

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_model(training_rows(documents, table(spark, sf_dir, "labels")))
    scores = scored(documents, model)
    return scores.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.chat import format_windows, parse_windows

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    windows = parse_windows(format_windows(given.unionByName(more)))
    ordered = windows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("cell", "part", "turns", "loss_texts", F.length("text").alias("size")))).alias("w"))
    flat = ordered.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.flatten(F.col("w.loss_texts")), "").alias("loss"), F.aggregate(F.col("w.size"), F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return flat.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query
def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.quality import judged

    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.warc import page_number, read_warc, write_warc

    read = read_warc(spark, write_warc(table(spark, sf_dir, "pages")))
    return read.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
b AS (SELECT page_id, octet_length(body) AS payload_bytes, from_hex(sha1(body)) AS digest, min(page_id) OVER (PARTITION BY sha1(body)) AS head FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(20), lambda i: bin(ascii(chr(('0x' || substr(hex(digest), CAST(2 * i + 1 AS BIGINT), 2))::INT + 256)) % 256 + 256)[2:]), '') AS s FROM b)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + list_sum(list_transform(range(5), lambda k: (substr(s, CAST(5 * i + k + 1 AS BIGINT), 1) = '1')::BIGINT * (16 >> k::BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM bits"""


def number_of(name: str) -> str:
    return f"cast(conv(substring(md5({name}), 1, 6), 16, 10) as int)"


@query
def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated lists made from the hosts of the table: some hosts blocked for a while, some of their sites for good, some language
    folders allowed twice; every page is fetched on a day that follows from its id."""
    from gridlocus.llm.url_lists import host_of, judge_captures

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 365 as int))").alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    day = lambda n: f"date_add(date'2024-01-01', {n})"
    sites = hosts.select(F.expr("regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1)").alias("host")).where("host <> ''").distinct()
    hosts, sites = hosts.withColumn("v", F.expr(number_of("host"))), sites.withColumn("v", F.expr(number_of("host")))
    event = lambda kind, entry, action, at, lst="block": f"struct('{lst}' as list, '{kind}' as kind, {entry} as entry, '{action}' as action, {day(at)} as at)"
    dated = [
        hosts.where("v % 4 = 0").select(F.expr(f"explode(array({event('host', 'host', 'add', 'v % 300')}, {event('host', 'host', 'remove', 'v % 300 + 30 + v % 50')}))").alias("e")),
        sites.where("v % 3 = 0").select(F.expr(event("domain", "host", "add", "v % 200")).alias("e")),
        hosts.where("v % 5 = 0").select(F.expr(f"""explode(array({event("prefix", "host || '/en/'", "add", "v % 100", "allow")}, {event("prefix", "host || '/en/'", "remove", "v % 100 + 60", "allow")},
            {event("prefix", "host || '/en/'", "add", "v % 100 + 150", "allow")}))""").alias("e")),
    ]
    events = dated[0].unionByName(dated[1]).unionByName(dated[2]).select("e.*")
    return judge_captures(pages, events).select("page_id", "fetched", "blocked", "block_entry", "allow_entry")


ORACLES["op5_url_lists"] = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::INT AS v FROM p WHERE host <> ''),
s AS (SELECT DISTINCT site, ('0x' || substr(md5(site), 1, 6))::INT AS v FROM (SELECT regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS site FROM h) WHERE site <> ''),
l AS (SELECT 'block' AS list, 'host' AS kind, host AS entry, v % 300 AS since, v % 300 + 30 + v % 50 AS until FROM h WHERE v % 4 = 0
  UNION ALL SELECT 'block', 'domain', site, v % 200, 100000 FROM s WHERE v % 3 = 0
  UNION ALL SELECT 'allow', 'prefix', host || '/en/', v % 100, v % 100 + 60 FROM h WHERE v % 5 = 0
  UNION ALL SELECT 'allow', 'prefix', host || '/en/', v % 100 + 150, 100000 FROM h WHERE v % 5 = 0),
m AS (SELECT p.page_id, p.fetched, min(kind || ':' || entry) FILTER (list = 'block') AS block_entry, min(kind || ':' || entry) FILTER (list = 'allow') AS allow_entry
  FROM p LEFT JOIN l ON date_diff('day', DATE '2024-01-01', fetched) >= since AND date_diff('day', DATE '2024-01-01', fetched) < until
    AND ((kind = 'host' AND host = entry) OR (kind = 'domain' AND (host = entry OR ends_with(host, '.' || entry))) OR (kind = 'prefix' AND starts_with(host || path, entry)))
  GROUP BY p.page_id, p.fetched)
SELECT page_id, fetched, block_entry IS NOT NULL AND allow_entry IS NULL AS blocked, block_entry, allow_entry FROM m"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op11_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, phrase, size, count(*) AS f FROM (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE len(words) >= size) o) q GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM g WHERE size > 1),
inside AS (SELECT DISTINCT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, a AS f FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2) x) y),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100::HUGEINT * i.f >= 80::HUGEINT * c.a),
cut AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c ANTI JOIN gone USING (lang, phrase)) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1 : c.size], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) b JOIN n USING (lang) WHERE rank <= 2000"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(terms) AS term FROM d) x GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT k.lang, s.source, k.term, k.n AS all_n, coalesce(sum(t.n), 0) AS n FROM k JOIN s ON s.lang = k.lang LEFT JOIN t ON t.lang = k.lang AND t.source = s.source AND t.term = k.term GROUP BY ALL),
p AS (SELECT lang, source, term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (sum(c.n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (v.n + 5 * v) AS q FROM c JOIN v USING (lang)),
two AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) u
QUALIFY part = 'pair' OR rank <= 50"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlocus.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))
