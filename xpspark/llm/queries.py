"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, decontaminate, embedding_dedup, line_dedup, minhash, pii, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.report(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(spans, ","))


#: Weight of a list of words; %s is the list.
WEIGHT = r"coalesce(list_sum(list_transform(%s, lambda w: greatest(1, len(regexp_extract_all(w, '[\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]')) // 2, CASE WHEN length(w) > 40 THEN length(w) // 5 ELSE 0 END))), 0)"
OP1 = (
    r"""
WITH u AS (
  SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][\x09-\x0D\x20]+|[。！？][\x09-\x0D\x20]*|\n[\x09-\x0D\x20]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents)
), w AS (
  SELECT *, regexp_extract_all(unit, '^[\x09-\x0D\x20]*[^\x09-\x0D\x20]+[\x09-\x0D\x20]*|[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') AS ws, WEIGHT_UNIT AS weight FROM u
), atoms AS (
  SELECT doc_id, i, unnest(ws) AS atom, unnest(list_transform(ws, lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '))) AS hashed, generate_subscripts(ws, 1) AS k FROM w WHERE weight > 30 AND len(ws) > 30
  UNION ALL SELECT doc_id, i, CASE WHEN k = 1 THEN substr(unit, 1, 3) ELSE substr(unit, k + 2, 1) END, substr(unit, k, 3), k
  FROM (SELECT doc_id, i, unit, unnest(range(1, length(unit) - 1)) AS k FROM w WHERE weight > 30 AND len(ws) <= 30)
), valued AS (
  SELECT *, CAST('0x' || substr(md5(hashed), 1, 7) AS BIGINT) AS v FROM atoms
), cuts AS (
  SELECT *, k < max(k) OVER (PARTITION BY doc_id, i) AND v = min(v) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS cut FROM valued
), grouped AS (
  SELECT doc_id, i, k, atom, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM cuts
), p AS (
  SELECT doc_id, i, 0 AS g, unit AS piece FROM w WHERE weight <= 30
  UNION ALL SELECT doc_id, i, g, string_agg(atom, '' ORDER BY k) FROM grouped GROUP BY doc_id, i, g
), s AS (
  SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i, g) - 1 AS place, list_filter(string_split_regex(piece, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM p
), t AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place) AS stop FROM s
), parts AS (
  SELECT doc_id, place, array_to_string(words, ' ') AS body, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r, sum(WEIGHT_WORDS) OVER (PARTITION BY doc_id ORDER BY place) AS total, WEIGHT_WORDS AS weight FROM s WHERE len(words) > 0
), spread AS (
  SELECT a.doc_id, a.r AS x, b.r AS y, min(b.r) OVER (PARTITION BY a.doc_id, a.r) AS stop, max(a.r) OVER (PARTITION BY a.doc_id, b.r) AS start
  FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r + 1 AND a.r + 12 WHERE b.total - a.total + a.weight >= 12
), runs AS (
  SELECT DISTINCT doc_id, x, y FROM spread WHERE y = stop OR x = start
), bodies AS (
  SELECT runs.doc_id, x, y, string_agg(body, ' ' ORDER BY r) AS run, min(place) AS place, max(place) AS last FROM runs JOIN parts ON parts.doc_id = runs.doc_id AND r BETWEEN x AND y GROUP BY ALL
), f AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, place) AS first_doc, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS n FROM bodies
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS place FROM f WHERE n > 1
), m AS (
  SELECT t.*, gone.place IS NOT NULL AS gone FROM t LEFT JOIN gone USING (doc_id, place)
), islands AS (
  SELECT doc_id, min(stop - length(piece)) AS a, max(stop) AS b
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM m WHERE gone) GROUP BY doc_id, island
), spans AS (
  SELECT doc_id, string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a) AS spans FROM islands GROUP BY doc_id
), firsts AS (
  SELECT doc_id, list_sort(list(DISTINCT first_doc)) AS first_ids FROM f WHERE n > 1 GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(piece, '' ORDER BY place) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(n_sentences, 0) END AS n_sentences, CASE WHEN d.text IS NOT NULL THEN coalesce(n_removed, 0) END AS n_removed, coalesce(spans, '') AS spans,
  coalesce(first_ids, []) AS first_ids, CASE WHEN n_removed > 0 THEN counted.text ELSE d.text END AS text
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""
).replace("WEIGHT_UNIT", WEIGHT % r"list_filter(string_split_regex(unit, '[\x09-\x0D\x20]+'), lambda x: x <> '')").replace("WEIGHT_WORDS", WEIGHT % "words")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(own)))


OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(regexp_replace(role, '(\[/?INST|</s)(\\*)([\]>])', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '(\[/?INST|</s)(\\*)([\]>])', '\1\2\\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"), common.shared_path(spark, "warc"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(table(spark, sf_dir, "embeddings"))


OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(node, root) AS (
  SELECT vec_id, vec_id FROM good UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
), c AS (
  SELECT node, min(root) AS component FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, coalesce(coalesce(c.component, vec_id) = vec_id, true) AS kept
FROM v LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_near")


OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS gram FROM i
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hits AS (
  SELECT g.doc_id, g.p, x.size, x.item_id
  FROM (SELECT doc_id, p, s.size, array_to_string(w[p:p + s.size - 1], ' ') AS gram FROM places, (SELECT DISTINCT size FROM windows) s WHERE p + s.size - 1 <= len(w)) g
  JOIN windows x ON x.size = g.size AND x.gram = g.gram
), terms AS (
  SELECT row_number() OVER () AS item, item_id, w FROM b WHERE len(w) > 0
), places2 AS (
  SELECT item, len(w) AS n, unnest(range(0, len(w))) AS off, unnest(w) AS term FROM terms
), words2 AS (
  SELECT doc_id, p - 1 AS pos, w[p] AS term FROM places
), found AS (
  SELECT doc_id, item, n, off, pos - off - late AS diagonal, min(late) AS late FROM words2 JOIN places2 USING (term), (VALUES (0), (1)) AS v(late) GROUP BY ALL
), near AS (
  SELECT doc_id, item, diagonal, win, least(10, n) AS size, count(*) AS met, count(*) FILTER (late = 0) AS in_place
  FROM (SELECT *, unnest(range(greatest(0, off - least(10, n) + 1), least(greatest(0, n - 10), off) + 1)) AS win FROM found) GROUP BY ALL HAVING count(*) FILTER (late = 0) = least(10, n) OR (count(*) * 10 >= least(10, n) * 8 AND least(10, n) >= 5)
), nears AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item FROM near GROUP BY ALL HAVING NOT bool_or(in_place = size)) GROUP BY doc_id
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), words=3, percent=85)


OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], chr(1)) AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), r(node, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
), c AS (
  SELECT node, min(root) AS component FROM r GROUP BY node
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = doc_id
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(pii.find(table(spark, sf_dir, "documents")))
    return found.withColumn("base_sha256", F.sha2("base_text", 256)).drop("base_text")


def held_out(key: Column) -> Column:
    """A row without id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels")
    return toxicity.train(toxicity.draw(docs, labels.where(~held_out(F.col("doc_id")))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, details=True).select("doc_id", "n_lines", "n_removed", "text")


OP10 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), w AS (
  SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l
), f AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(body, '\\S')) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i, true AS gone FROM f, (VALUES (0), (1)) AS v(d)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone IS NOT NULL) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '') AS text
FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substrings": OP1, "op2_chat": OP2, "op3_embeddings": OP3, "op4_decontaminate": OP4, "op5_minhash": OP5, "op9_warc": OP9, "op10_lines": OP10}
