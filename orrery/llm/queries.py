"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import neighbours

    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter("vec_id % 50 = 0"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import anonymise

    return anonymise(table(spark, sf_dir, "documents"), key="orrery")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .word_bpe import round_trips

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    from pyspark.sql import functions as F

    from .merkle import digest, manifest

    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    original, tampered = (digest([*columns, text]) for text in (F.col("text"), F.translate("text", "\n", "")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(hit, tampered).otherwise(original), **more)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup as d
    from . import mixing as m

    weigh = "CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    rounds = "".join(
        f"""a{k} AS (SELECT r, p, arg_min(i, (s, i)) AS i FROM (SELECT r, p, i, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c{k} USING (p, j) GROUP BY ALL) GROUP BY r, p),
c{k + 1} AS (SELECT c.p, c.i, c.j, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT p, i, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{k} USING (r, p) GROUP BY ALL) m USING (p, i, j)),
"""
        for k in range(2)
    )
    return {
        "op11_vector_codes": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS e, len(embedding) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS (SELECT r, (j - 1) * 16 // d AS p, j, floor(256 * e[j]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(1, d + 1)) AS j FROM v)),
c0 AS (SELECT p, i, j, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS i FROM v) USING (r) WHERE i < 64),
""" + rounds + """
a2 AS (SELECT r, p, min(s) AS s, arg_min(i, (s, i)) AS i FROM (SELECT r, p, i, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c2 USING (p, j) GROUP BY ALL) GROUP BY r, p),
o AS (SELECT r, vec_id, label, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM v JOIN a2 USING (r) GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, i, j)) FROM c2) AS codebooks_sha256 FROM o""",
        "op13_merkle_manifest": f"""
WITH RECURSIVE step(i, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS now FROM documents, tbl),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, lvl, pos, n, d) AS (SELECT g, 0, pos, n, leaf FROM placed UNION ALL
  SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, n, pos // 3),
subs AS (SELECT g, d, lvl, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, d) AS (SELECT 0, pos, n, d FROM subs UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 3),
every AS (SELECT g, lvl, pos, n, d FROM tree UNION ALL SELECT NULL, lvl, pos, n, d FROM top),
sib AS (SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.g IS NOT DISTINCT FROM b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk(doc_id, leaf, g, place, k, lvl, pos, top_pos, cur, path) AS (SELECT doc_id, leaf, p.g, p.pos, p.g, 0, p.pos, s.pos, now, '' FROM placed p JOIN subs s ON p.g = s.g UNION ALL
  SELECT doc_id, leaf, w.g, place, CASE WHEN x.l IS NULL THEN NULL ELSE k END, CASE WHEN x.l IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN x.l IS NULL THEN top_pos ELSE w.pos // 3 END, top_pos,
    CASE WHEN x.l IS NULL THEN cur ELSE sha256(x.l || cur || x.r) END, path || coalesce(x.l || x.r, '')
  FROM walk w LEFT JOIN sib x ON w.k IS NOT DISTINCT FROM x.g AND w.lvl = x.lvl AND w.pos = x.pos WHERE x.l IS NOT NULL OR k IS NOT NULL),
done AS (SELECT * FROM walk WHERE k IS NULL QUALIFY row_number() OVER (PARTITION BY g, place ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(path) AS proof_sha256, cur AS folded_root, cur = t.d AS verified
FROM done JOIN subs s ON done.g = s.g, (SELECT d FROM top WHERE n = 1) t""",
        "op1_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT r, doc_id, len(w) - 4 AS m, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
si AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(w) - 4 AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM i WHERE len(w) >= 5) GROUP BY ALL),
hit AS (SELECT r, doc_id, m, p, item_id, n, s, c FROM ds JOIN si USING (s)),
win AS (SELECT r, doc_id, item_id, n, w, a, s, c, count(*) AS k FROM (SELECT *, unnest(range(greatest(0, p - w + 1), least(p, m - w) + 1)) AS a FROM (SELECT *, least(m, n) AS w FROM hit)) GROUP BY ALL),
com AS (SELECT r, doc_id, item_id, n, w, a, sum(least(c, k))::DOUBLE AS x FROM win GROUP BY ALL),
sim AS (SELECT r, doc_id, item_id, n, w, a, x / (n + w - x) AS j FROM com WHERE x / (n + w - x) >= 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item_id, n ORDER BY j DESC, a) AS o FROM sim)
SELECT doc_id, item_id, j AS similarity, a::INT AS start_word, (w + 4)::INT AS n_words FROM best WHERE o = 1""",
        "op9_sharding": """
WITH RECURSIVE step(i, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
b AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, hex(encode(text)) AS h, coalesce(md5(text), '') AS key FROM documents),
crc AS (SELECT doc_id, n + 8 AS size, key, CASE WHEN h IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) END AS text_crc32 FROM b, tbl),
laid AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS position, row_number() OVER w - 1 AS r, sum(size) OVER () AS total FROM crc WINDOW w AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least(23, (2 * position + size) * 24 // (2 * total))::INT AS shard FROM laid)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, r - min(r) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard, position FROM cut""",
        "op2_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, {weigh} AS w, 2 * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w
  WINDOW o AS (ORDER BY cap / w, coalesce('=' || source, ''))),
l AS (SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM w) - c)::DOUBLE / ((SELECT sum(w) FROM w) - b)::DOUBLE) AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM w, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {m.ONE})::BIGINT ELSE 0 END AS step,
  ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 6))::BIGINT AS start FROM t),
n AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS i FROM d)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT n.doc_id, n.size, k.source_size, k.target, (start + (i + 1) * step) // {m.ONE} - (start + i * step) // {m.ONE} AS copies
  FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source)""",
        "op8_line_dedup": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{d.HOST}', 1)) AS host, coalesce(list_filter(list_transform(string_split(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{d.SILENT}', '', 'g'), '{d.SPACE}', ' ', 'g'), '{d.BREAKS}', chr(10), 'g'), '{d.TAG}', '', 'g'),
  chr(10)), lambda x: trim(x)), lambda x: x <> ''), []) AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host),
e AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
b AS (SELECT e.host, list(line) AS gone FROM (SELECT host, line, count(*) AS n FROM e GROUP BY ALL) e JOIN t ON e.host = t.host WHERE n > pages * {d.RATIO} AND n >= {d.SEEN} GROUP BY e.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text
FROM (SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN b ON p.host = b.host)""",
    }
