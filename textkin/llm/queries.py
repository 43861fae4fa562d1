"""The registered queries of the subpackage and their SQL (DuckDB)."""

import uuid

from pyspark.sql import functions as F

from textkin.llm import (chat, conversation_repair, decontaminate, filter_audit, language_id, line_dedup, mixing, near_dedup, packing,
                         substring_dedup, topk, toxicity, warc)
from textkin.llm.tables import table
from textkin.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def _fold(k):
    """Remainder of the checksum of the id; null ids are in no fold."""
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_language_id(spark, sf):
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf, "documents")
    model = language_id.fit(docs.where(_fold(4) != 2))
    return language_id.predict(docs.withColumn("held_out", F.coalesce(_fold(4) == 2, F.lit(False))), model, keep=("doc_id", "held_out"))


def op6_toxicity(spark, sf):
    """Toxicity of every document, learned from the labels of four of five folds."""
    docs = table(spark, sf, "documents")
    grammar = toxicity.fit(docs, table(spark, sf, "labels").where(_fold(5) != 0))
    return toxicity.score(docs.withColumn("held_out", F.coalesce(_fold(5) == 0, F.lit(False))), grammar, keep=("doc_id", "held_out"))


def op2_near_dedup(spark, sf):
    """Component of near copies of every document."""
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


OP2_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM w),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
                        GROUP BY x.doc_id, y.doc_id) c
  JOIN size p ON p.doc_id = c.a JOIN size q ON q.doc_id = c.b WHERE 100 * c.c >= 75 * (p.n + q.n - c.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN size z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


def op4_substring_dedup(spark, sf):
    """Every document without the 13-word windows that an earlier one holds."""
    out = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
origin AS (SELECT seq, min(doc_id) AS lowest FROM win GROUP BY seq),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM (SELECT w.doc_id, w.i FROM win w JOIN origin o USING (seq) WHERE o.lowest < w.doc_id)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS kept, count(*) AS n
         FROM each e ANTI JOIN covered c ON c.doc_id = e.doc_id AND c.j = e.j GROUP BY e.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


#: How speakers are marked in the four styles of raw transcripts that op3 is given.
STYLES = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
          {"system": "Setup: ", "user": "Human: ", "assistant": "AI: "},
          {"system": "<|rules|> ", "user": "<|person|> ", "assistant": "<|bot|> "},
          {"system": "[S] ", "user": "[Q] ", "assistant": "[A] "}]


def raw_turns(spark, sf):
    """``conversations`` as raw transcripts have them: a style per conversation, and no marker on a fifth of the turns."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, mark in marks.items():
            marker = F.when((style == k) & (F.col("role") == role), mark).otherwise(marker)
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(bare, "").otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit("")))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", F.split(text, "\n", -1).alias("lines"))


def recovered_lines(spark, sf):
    turns = raw_turns(spark, sf)
    model = chat.fit(turns.where(F.crc32(F.col("conv").cast("string")) % 4 != 2))
    lines = turns.select("conv", F.col("turn").alias("major"), F.posexplode("lines").alias("minor", "line"))
    return chat.recover_roles(lines, model)


def op3_chat_format(spark, sf):
    """Canonical turns of every conversation, recovered from its raw transcript."""
    return chat.render(recovered_lines(spark, sf)).withColumnRenamed("conv", "conv_id")


def op5_top_k(spark, sf):
    """The five largest inner products of every fiftieth vector with all others."""
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
best AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v))::BIGINT AS score
         FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best) WHERE rank <= 5
"""


def op7_mix_to_targets(spark, sf):
    """Raked sampling probability and draw of every document."""
    out = mixing.mix_to_targets(table(spark, sf, "documents"))
    return out.select("doc_id", "tokens", "topic", F.round("p", 6).alias("p"), F.round("weight", 6).alias("weight"), "sampled")


def _rake_sql():
    """The rounds of ``mixing.rake`` written out: each step scales the weights of one dimension."""
    dims, parts, last = mixing.DIMENSIONS, [], "w0"
    for d in dims:
        parts.append(f"target_{d} AS (SELECT {d}, pow(sum(n), {mixing.FLATTEN}) / sum(pow(sum(n), {mixing.FLATTEN})) OVER () AS share "
                     f"FROM cells GROUP BY {d})")
    for k in range(mixing.ROUNDS * len(dims)):
        d = dims[k % len(dims)]
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (w), c.w * t.share / sum(c.w) OVER (PARTITION BY c.{d}) AS w "
                     f"FROM {last} c JOIN target_{d} t ON c.{d} = t.{d})")
        last = f"w{k + 1}"
    return ",\n".join(parts), last


_steps, _last = _rake_sql()
OP7_SQL = f"""
WITH tagged AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens,
         CASE WHEN text IS NULL THEN '(none)' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, 'http') OR contains(text, '@') THEN 'contact'
              WHEN contains(text, 'icense') THEN 'legal'
              WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'markup'
              WHEN NOT regexp_matches(text, '[a-z]') THEN 'shouted' ELSE 'prose' END AS topic
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, greatest(sum(tokens)::DOUBLE, {mixing.SMALLEST}) AS n
                       FROM tagged GROUP BY source, lang, topic),
w0 AS (SELECT source, lang, topic, n, n / sum(n) OVER () AS w FROM cells),
{_steps},
factors AS (SELECT source, lang, topic, n, w / n AS f FROM {_last}),
-- With the cells of the k largest factors filled: c for the rest. The right k is the first whose c fills no further cell.
filled AS (SELECT f, ({mixing.KEEP} * sum(n) OVER () - coalesce(sum(n) OVER before, 0)) / (sum(n * f) OVER () - coalesce(sum(n * f) OVER before, 0)) AS c
           FROM (SELECT f, sum(n) AS n FROM factors GROUP BY f) WINDOW before AS (ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT c FROM filled WHERE c * f < 1 ORDER BY f DESC LIMIT 1),
cell AS (SELECT source, lang, topic, least(c * f, 1) AS p, greatest(c * f, 1) AS weight FROM factors, rate)
SELECT doc_id, tokens, topic, round(p, 6) AS p, round(weight, 6) AS weight,
       ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0 < p AS sampled
FROM tagged JOIN cell USING (source, lang, topic)
"""


def op8_warc(spark, sf):
    """Every page from the archives it was written to, with its place in the history of its URL."""
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf, "pages"), at)
    out = warc.merge_index(warc.read_archives(spark, at))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture")


OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, url, strlen(payload) AS payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
        regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', '', 's'), '^.*?://', '', 's') AS rest FROM p),
k AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host, substr(rest, 1 + length(regexp_extract(rest, '^[^/?]*'))) AS path FROM d),
s AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':.*$', '')), '^www\\.', '') AS name FROM k),
u AS (SELECT *, array_to_string(list_reverse(string_split(name, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS url_key FROM s),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key,
       row_number() OVER (PARTITION BY url_key ORDER BY page_id % 315360000, page_id) AS capture
FROM f
"""


def op9_decontaminate(spark, sf):
    """Benchmark items that every document contains."""
    return decontaminate.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _words_sql(source, id):
    return f"""SELECT {id}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS ws
    FROM {source}"""


def _runs_sql(source, id):
    """Distinct runs of each length of interest; a run's length is that of a short item, or five."""
    return f"""SELECT DISTINCT {id}, k, array_to_string(ws[i:i + k - 1], ' ') AS run
    FROM (SELECT {id}, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM {source}, lengths WHERE len(ws) >= k)"""


OP9_SQL = f"""
WITH iw AS MATERIALIZED ({_words_sql("benchmark", "item_id")}),
dw AS MATERIALIZED ({_words_sql("documents", "doc_id")}),
lengths AS (SELECT DISTINCT least(len(ws), 5) AS k FROM iw WHERE len(ws) > 0),
i AS MATERIALIZED (SELECT r.* FROM ({_runs_sql("iw", "item_id")}) r JOIN iw USING (item_id) WHERE r.k = least(len(ws), 5)),
d AS MATERIALIZED ({_runs_sql("dw", "doc_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) AS shared, n.n_item
FROM d JOIN i ON i.run = d.run AND i.k = d.k JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n_item HAVING 100 * count(*) >= {decontaminate.PERCENT} * n.n_item
"""


def op10_line_dedup(spark, sf):
    """Every document without the boilerplate lines of its source."""
    out = line_dedup.drop_boilerplate(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


OP10_SQL = f"""
WITH pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source),
held AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line
         FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
bad AS (SELECT h.source, list(h.line) AS lines
        FROM (SELECT source, line, count(*) AS n FROM held GROUP BY source, line HAVING count(*) >= {line_dedup.MIN_PAGES}) h
        JOIN pages p ON p.source = h.source WHERE h.n > {line_dedup.RATIO} * p.pages GROUP BY h.source),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
                 list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(b.lines, trim(x)), false)) AS kept
          FROM documents d LEFT JOIN bad b ON b.source = d.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) - len(kept) END AS n_dropped,
       md5(array_to_string(kept, chr(10))) AS kept_md5
FROM split
"""

#: Tokenizer file and end id of packed documents.
PACK_TOKENIZER, PACK_END = "word_bpe_49k.json", 2


def op11_packing(spark, sf):
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    out = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(PACK_TOKENIZER), PACK_END)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def damaged(turns):
    """``conversations`` with faults: a twentieth each without row, text, sentence ends, as two rows, or with another role."""
    def word(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf):
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    turns = table(spark, sf, "conversations")
    return conversation_repair.summarise(conversation_repair.repair(damaged(turns)), turns)


#: CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1),
  lambda i: [ascii(substr({0}, i::INT, 1))::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]))),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH RECURSIVE ids AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT i.cid, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text,
          coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(c.turn::VARCHAR, ' ') AS key
          FROM conversations c JOIN ids i ON i.conv_id IS NOT DISTINCT FROM c.conv_id),
kinds AS MATERIALIZED (SELECT *, {_CRC.format('key')} % 20 AS kind FROM keyed),
after AS MATERIALIZED (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM after)),
f AS MATERIALIZED (
  SELECT *, CASE WHEN ink = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
         left(role, 1) AS initial FROM numbered),
stats AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (NOT coalesce(before || initial IN ('su', 'ua', 'au'), true)) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY i) AS before FROM f) GROUP BY cid),
-- States: 0 start, 1 after system, 2 after user, 3 after assistant.
inserts AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:\n'),
  (0, 3, 4, 'II', 'user:\nassistant:\n'), (1, 2, 2, 'I', 'user:\n'), (1, 3, 4, 'II', 'user:\nassistant:\n'), (2, 3, 2, 'I', 'assistant:\n'),
  (3, 2, 2, 'I', 'user:\n')) t(a, b, price, edits, lines)),
ops AS (SELECT * FROM (VALUES ('K', 's', 0, 1, 0, ''), ('K', 'u', 0, 2, 0, ''), ('K', 'u', 1, 2, 0, ''), ('K', 'a', 2, 3, 0, ''), ('K', 'u', 3, 2, 0, ''),
  ('R', '', 0, 2, 2, 'user'), ('R', '', 1, 2, 2, 'user'), ('R', '', 2, 3, 2, 'assistant'), ('R', '', 3, 2, 2, 'user'),
  ('D', '', 0, 0, 3, ''), ('D', '', 1, 1, 3, ''), ('D', '', 2, 2, 3, ''), ('D', '', 3, 3, 3, '')) t(op, initial, a, b, price, role)),
dp AS (
  SELECT cid, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS x FROM ids
  UNION ALL
  SELECT p.cid, f.i, o.b AS s, min({{'cost': p.x.cost + n.price + o.price + (o.op <> 'D' AND f.fault = 't')::INT,
    'audit': p.x.audit || n.edits || o.op,
    'lines': p.x.lines || n.lines || CASE o.op WHEN 'K' THEN f.role || ':' || f.text || chr(10) WHEN 'R' THEN o.role || ':' || f.text || chr(10) ELSE '' END}}) AS x
  FROM dp p JOIN f ON f.cid = p.cid AND f.i = p.i + 1 JOIN inserts n ON n.a = p.s
  JOIN ops o ON o.a = n.b AND (o.op = 'D' OR f.fault NOT IN ('b', 'd') AND (o.op = 'R' OR o.initial = f.initial))
  GROUP BY p.cid, f.i, o.b),
last AS (SELECT cid, max(i) AS i FROM dp GROUP BY cid),
ended AS (
  SELECT p.cid, min({{'cost': p.x.cost + n.price, 'audit': p.x.audit || n.edits, 'lines': p.x.lines || n.lines}}) AS x
  FROM dp p JOIN last l ON l.cid = p.cid AND l.i = p.i JOIN inserts n ON n.a = p.s WHERE n.b IN (0, 3) GROUP BY p.cid)
SELECT ids.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
       coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, e.x.cost AS cost, e.x.audit AS audit,
       sha256(left(e.x.lines, greatest(length(e.x.lines) - 1, 0))) AS repaired_sha256
FROM ids JOIN ended e USING (cid) LEFT JOIN stats s USING (cid)
"""


def op13_filter_audit(spark, sf):
    """Every count of the five filters in all their orders, per source."""
    return filter_audit.audit(filter_audit.flag_documents(table(spark, sf, "documents"), table(spark, sf, "labels")))


OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, part, text, regexp_extract_all(text, '{WORD}') AS ws FROM t),
first AS MATERIALIZED (SELECT text, min(doc_id) AS lowest FROM t GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM (
    SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
           (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
           + 4 * (100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 2 * length(w.text))::INT
           + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > f.lowest, false)::INT AS mask
    FROM w JOIN first f ON f.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT '' AS filter_order, 0 AS taken
           UNION ALL SELECT filter_order || x, taken + bit FROM orders, letters WHERE taken & bit = 0),
steps AS MATERIALIZED (
  SELECT o.filter_order, s.step, l.bit, p.taken AS earlier
  FROM orders o, (SELECT unnest(range(1, 6))::INT AS step) s, letters l, orders p
  WHERE length(o.filter_order) = 5 AND l.x = substr(o.filter_order, s.step, 1) AND p.filter_order = substr(o.filter_order, 1, s.step - 1)),
counts AS MATERIALIZED (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts
"""


QUERIES = {
    "op1_language_id": op1_language_id, "op2_near_dedup": op2_near_dedup, "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup, "op5_top_k": op5_top_k, "op6_toxicity": op6_toxicity,
    "op7_mix_to_targets": op7_mix_to_targets, "op8_warc": op8_warc, "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_packing": op11_packing, "op12_conversation_repair": op12_conversation_repair, "op13_filter_audit": op13_filter_audit}
ORACLE = {
    "op2_near_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op5_top_k": OP5_SQL, "op7_mix_to_targets": OP7_SQL,
    "op8_warc": OP8_SQL, "op9_decontaminate": OP9_SQL, "op10_line_dedup": OP10_SQL,
    "op12_conversation_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
