"""The registered queries of this package and, where SQL can express them, the SQL that must give the same rows."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import functions as F

from tableglass.llm import bpe, collocations, decontaminate, exact_dedup, language, line_dedup, near_dedup, periodic_runs, substring_dedup, suffix_tree, toxicity, url_filter, warc
from tableglass.llm.common import fold, shared_path, table

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1(s, d):
    path = shared_path(s, "warc")
    warc.write_archives(table(s, d, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return warc.read_archives(s, path, with_payload=False).filter("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"))


def op3(s, d):
    """The outcome of a page is the toxic label of the document whose number its path holds."""
    outcomes = table(s, d, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("bad"))
    shown = F.try_to_number(F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    return url_filter.judge(table(s, d, "pages"), outcomes, RULES, key=shown)


def op7(s, d):
    docs = table(s, d, "documents")
    profiles = language.learn(docs.filter(fold() != 0))
    texts = docs.select("doc_id", "text", (fold() == 0).alias("held_out"))
    return language.predict(texts, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op12(s, d):
    docs = table(s, d, "documents")
    model = toxicity.learn(docs, table(s, d, "labels").filter(fold() != 0))
    texts = docs.select("doc_id", "text", (fold() == 0).alias("held_out"))
    return toxicity.score(texts, model).select("doc_id", "held_out", "score", "predicted")


def pipeline(s, d):
    return importlib.import_module("corpus_pipeline").run(s, d)


QUERIES = {
    "op1_warc": op1,
    "op2_lm_score": lambda s, d: suffix_tree.score(table(s, d, "documents")),
    "op3_url_filter": op3,
    "op4_decontaminate": lambda s, d: decontaminate.contamination(table(s, d, "documents"), table(s, d, "benchmark"), 10).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op5_exact_dedup": lambda s, d: exact_dedup.decisions(table(s, d, "documents")),
    "op6_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents")),
    "op7_language_id": op7,
    "op8_line_dedup": lambda s, d: line_dedup.drop_shared_lines(table(s, d, "documents"), 10).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256"),
    "op9_substring_dedup": lambda s, d: substring_dedup.remove_repeats(table(s, d, "documents"), 20, with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"),
    "op10_bpe": lambda s, d: bpe.encode_decode(
        table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, with_decoded=False).select(
            "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op11_collocations": lambda s, d: collocations.collocations(table(s, d, "documents")),
    "op12_toxicity": op12,
    "op13_periodic_runs": lambda s, d: periodic_runs.digests(periodic_runs.find_runs(
        periodic_runs.with_planted_runs(table(s, d, "documents").select("doc_id", "text")))),
    "pipeline": pipeline,
}

SQL = {
    "op1_warc": """SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS payload_digest,
      CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < last THEN last END AS refers_to
      FROM (SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""",
    "op4_decontaminate": """WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
      b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
      v AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS win
        FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(ws) - 9))) AS p) WHERE len(ws) > 0),
      h AS (SELECT DISTINCT doc_id, p, v.n, item_id FROM (SELECT DISTINCT n FROM v) k, t,
        LATERAL (SELECT unnest(generate_series(1, len(ws) - k.n + 1)) AS p) JOIN v ON v.n = k.n AND v.win = array_to_string(ws[p:p + k.n - 1], ' ')),
      c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h),
        LATERAL (SELECT unnest(generate_series(p, p + n - 1)) AS q) GROUP BY doc_id),
      i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM t LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_line_dedup": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
      k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
      c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
      SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
      FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op9_substring_dedup": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
      w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM d),
      s AS (SELECT d.doc_id, a.pos, md5(array_to_string(ws[a.pos:a.pos + 19], ' ')) AS seq
        FROM d, LATERAL (SELECT unnest(generate_series(1, len(ws) - 19)) AS pos) a),
      r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1 AS again FROM s),
      c AS (SELECT w.doc_id, w.pos, word, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (
        PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
        FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos)
      SELECT doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256
      FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
    "op5_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
      o AS (SELECT lang, word, lead(word, 1) OVER k AS second, lead(word, 2) OVER k AS third
        FROM (SELECT lang, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) WINDOW k AS (PARTITION BY id ORDER BY pos)),
      f AS (SELECT lang, 1 AS size, word AS phrase, count(*) AS f FROM o GROUP BY ALL UNION ALL
        SELECT lang, 2, concat(word, ' ', second), count(*) FROM o WHERE second IS NOT NULL GROUP BY ALL UNION ALL
        SELECT lang, 3, concat(word, ' ', second, ' ', third), count(*) FROM o WHERE third IS NOT NULL GROUP BY ALL),
      t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
      g AS (SELECT concat(lang, chr(10), phrase) AS key, f FROM f),
      c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 10),
      k AS (SELECT *, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
        FROM c, LATERAL (SELECT unnest(generate_series(1, size - 1)) AS k)),
      s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM k JOIN g x ON x.key = concat(k.lang, chr(10), first) JOIN g y ON y.key = concat(k.lang, chr(10), rest)),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(unnest([ws[1:2], ws[2:3]]), ' ') AS phrase
        FROM c WHERE size = 3) GROUP BY lang, phrase)
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
      FROM b LEFT JOIN i USING (lang, phrase) JOIN t USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000""",
    # h: CRC-32 of the id's digits, bit by bit
    "op13_periodic_runs": """WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8),
          lambda b: CAST((ascii(c) >> CAST(b AS INTEGER)) & 1 AS BIGINT)))),
          lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1)), 4294967295), 4294967295) AS h FROM documents),
      g AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, h, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a, h // 10 AS g FROM c),
      d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CAST(
        CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS BIGINT) + 1]) ELSE ws END AS ws FROM g),
      s AS (SELECT doc_id, n, pos, array_to_string(ws[pos:pos + 5], ' ') AS six FROM d, LATERAL (SELECT unnest(generate_series(1, n - 5)) AS pos)),
      m AS (SELECT x.doc_id, x.pos, x.pos - y.pos AS lag FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.six = y.six
        AND x.pos > y.pos AND 2 * (x.pos - y.pos) <= x.n),
      k AS (SELECT doc_id, lag, min(pos) - 1 AS i, count(*) + 5 AS same FROM (
          SELECT *, pos - row_number() OVER (PARTITION BY doc_id, lag ORDER BY pos) AS diagonal FROM m)
        GROUP BY doc_id, lag, diagonal HAVING count(*) + 5 >= greatest(lag, 12 - lag)),
      r AS (SELECT doc_id, i - lag AS start, same + lag AS length, min(lag) AS period FROM k GROUP BY doc_id, i - lag, same + lag),
      w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
      x AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS pos FROM r),
      t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN x USING (doc_id, pos) GROUP BY doc_id),
      b AS (SELECT doc_id, count(*) AS n_runs, arg_max(r, (length, -start, -period)) AS best,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id)
      SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
        CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
      FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
