"""The text operators bound to the test tables, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import LOWER, UPPER, lower_ascii
from . import bpe, cotrain, decontaminate, licenses, linededup, merkle, mixture, passages, rules, simhash, spelling, spots, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = f"translate({{x}}, '{UPPER}', '{LOWER}')"


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = cotrain.score(docs, cotrain.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", "text_score", "page_score", "score", "kept")


def op2_rules(spark: SparkSession, folder: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = rules.with_measures(table(spark, folder, "documents").select("doc_id", "text"), base)
    known = {name: F.col(name) for name in base}
    failed = [rule.fails(known) for rule in rules.BASE_RULES]
    judged = rules.cascade(docs, known=known)
    return judged.select("doc_id", *base, (failed[0] | failed[1]).alias("base_failed"), "kept")


RULES = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (
  SELECT doc_id, pos, [w[pos], w[pos + 1], w[pos + 2], w[pos + 3], w[pos + 4]] AS five
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM cut)),
twice AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT at_word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS at_word FROM twice)
  GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS bigint) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS bigint) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
         CAST(coalesce(n, 0) AS bigint) AS n_repeat_words, len(lines) AS n_lines,
         len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS n_stutters,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals
  FROM cut LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR 5 * n_stutters > n_words OR 10 * n_capitals > 4 * word_chars) AS kept
FROM judged"""


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    base, own = F.col("places.label"), F.col("blocks.template")
    joined = F.array_join(F.array_sort(F.array_distinct(base)), ",")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined.alias("base_labels"),
        labels.alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}', {licenses.REQUIRED[name].split()})" for name, text in licenses.TEMPLATES.items())
PHRASE_ROWS = ", ".join(f"({len(phrase.split())}, {phrase.split()}, '{label}')" for phrase, label in licenses.PHRASES.items())
PLAIN_WORDS = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSES = f"""
WITH low AS (SELECT doc_id, {LOWER_SQL.format(x="coalesce(text, '')")} AS t FROM documents),
words AS (SELECT doc_id, {PLAIN_WORDS.format(x="t")} AS w FROM low),
phrases(size, words, label) AS (VALUES {PHRASE_ROWS}),
spots AS (SELECT doc_id, unnest(range(len(w))) AS pos, w FROM words),
places AS (SELECT doc_id, pos, label FROM spots JOIN phrases ON w[pos + 1] = words[1] AND w[pos + 1 : pos + size] = words),
base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY doc_id),
templates AS (
  SELECT name, list_distinct({PLAIN_WORDS.format(x=LOWER_SQL.format(x="body"))}) AS tw, must FROM (VALUES {TEMPLATE_ROWS}) AS v(name, body, must)),
cut AS (SELECT doc_id, string_split(t, chr(10)) AS parts FROM low),
lines AS (
  SELECT doc_id, pos, list_distinct({PLAIN_WORDS.format(x="line")}) AS lw
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut)),
paragraphs AS (SELECT *, count(*) FILTER (WHERE len(lw) = 0) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM lines),
shared AS (
  SELECT doc_id, para, pos, name, must, tw, list_intersect(lw, list_concat(tw, must)) AS w1
  FROM paragraphs, templates WHERE len(lw) > 0),
wider AS (
  SELECT *, list_concat(w1, coalesce(lag(w1) OVER near, [])) AS w2,
         list_concat(w1, coalesce(lag(w1) OVER near, []), coalesce(lag(w1, 2) OVER near, [])) AS w3
  FROM shared WINDOW near AS (PARTITION BY doc_id, para, name ORDER BY pos)),
counted AS (
  SELECT doc_id, para, pos, name, len(tw) AS size,
         CASE WHEN list_has_all(w1, must) THEN len(list_intersect(tw, w1)) ELSE 0 END AS n1,
         CASE WHEN list_has_all(w2, must) THEN len(list_intersect(tw, w2)) ELSE 0 END AS n2,
         CASE WHEN list_has_all(w3, must) THEN len(list_intersect(tw, w3)) ELSE 0 END AS n3
  FROM wider),
seen AS (
  SELECT doc_id, name, size, n1, n2, n3, n1 >= 0.8 * size AS s1, n2 >= 0.8 * size AS s2, n3 >= 0.8 * size AS s3,
         coalesce(lag(n1) OVER near, 0) >= 0.8 * size AS b1, coalesce(lag(n2) OVER near, 0) >= 0.8 * size AS b2
  FROM counted WINDOW near AS (PARTITION BY doc_id, para, name ORDER BY pos)),
found AS (
  SELECT doc_id, name, n1 / size AS share FROM seen WHERE s1
  UNION ALL SELECT doc_id, name, n2 / size FROM seen WHERE s2 AND NOT s1 AND NOT b1
  UNION ALL SELECT doc_id, name, n3 / size FROM seen WHERE s3 AND NOT s2 AND NOT b2),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, name FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, folder, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, {LOWER_SQL.format(x=f"trim(line, {BLANKS_SQL})")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f IS NULL OR f = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id"""

def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("kept_ids").alias("kept_doc_ids"))


URL_RULES = (
    urls.UrlRule("block", "net", "/"),
    urls.UrlRule("allow", "example.net", "/en/"),
    urls.UrlRule("block", "example.com", "/de/"),
    urls.UrlRule("allow", "org", "/fr/"),
)


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


URLS = f"""
WITH rules AS (
  SELECT unnest({[r.host for r in URL_RULES]}) AS h, unnest({[r.path for r in URL_RULES]}) AS p,
         unnest({[r.verdict for r in URL_RULES]}) AS v),
parts AS (
  SELECT page_id, {LOWER_SQL.format(x="coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts"""


def op8_spots(spark: SparkSession, folder: str) -> DataFrame:
    return spots.compare_edited(table(spark, folder, "documents"))


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixture.mix_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(CAST(doc_id AS varchar), md5(text), '') AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS bigint) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
                   row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, nr) AS pos FROM weighed),
levels AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
open AS (SELECT min_by(level, pos) AS level, min(pos) AS pos FROM levels WHERE CAST(level AS double) * w <= 2.0 * n),
rates AS (
  SELECT source, n, CAST(CASE WHEN pos >= (SELECT pos FROM open) THEN CAST((SELECT level FROM open) AS double) * w
                              ELSE 2.0 * n END AS double) AS target FROM levels),
taken AS (
  SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE least(target / n, 2) END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || k), 1, 13) AS bigint) AS double) / pow(16, 13) AS chance
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS bigint) AS taken FROM taken"""


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path, round_trip=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    values = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in MANIFEST_COLUMNS]
    docs = docs.withColumn("tampered", F.when(changed, merkle.leaf_of(values)))
    found = merkle.manifest(docs, MANIFEST_COLUMNS, keep=["tampered"])
    made = merkle.folded(F.col("path"), F.coalesce("tampered", "leaf"))
    folded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), made.alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 in DuckDB, bit by bit: a byte is taken in, then the register is shifted eight times.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, flatten([
    [b::bigint, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN [ascii(c) FOR c IN string_split({x}, '')]])),
    lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295)"""


def _marked_sql(column: str) -> str:
    value = f"CAST({column} AS varchar)"
    return f"coalesce(CAST(strlen({value}) AS varchar) || ':' || {value}, '-')"


LEAF_SQL = " || ".join(map(_marked_sql, MANIFEST_COLUMNS))

MANIFEST = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source, sha256({LEAF_SQL}) AS leaf,
         CASE WHEN {CRC32_SQL.format(x="CAST(doc_id AS varchar)")} % 5 = 0
              THEN sha256({LEAF_SQL.replace("CAST(text AS varchar)", LOWER_SQL.format(x="text"))}) END AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
up(lvl, source, pos, n, d) AS (
  SELECT 0, source, pos, n, leaf FROM leaves UNION ALL
  SELECT lvl + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
subroots AS (
  SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, d) AS (
  SELECT 0, pos, n, d FROM subroots UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
heights AS (SELECT source, max(lvl) AS height FROM up GROUP BY source),
steps AS (
  SELECT l.doc_id, u.lvl,
         coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos < l.pos // (16 ** u.lvl)::bigint), '') AS l,
         coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos > l.pos // (16 ** u.lvl)::bigint), '') AS r
  FROM leaves l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.n > 1 AND u.pos // 16 = l.pos // (16 ** (u.lvl + 1))::bigint
  GROUP BY l.doc_id, u.lvl
  UNION ALL
  SELECT l.doc_id, h.height + t.lvl,
         coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (16 ** t.lvl)::bigint), ''),
         coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (16 ** t.lvl)::bigint), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN heights h ON h.source IS NOT DISTINCT FROM l.source
       JOIN top t ON t.n > 1 AND t.pos // 16 = s.pos // (16 ** (t.lvl + 1))::bigint
  GROUP BY l.doc_id, h.height, t.lvl),
proofs AS (SELECT doc_id, max(lvl) AS last, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM steps GROUP BY doc_id),
folds(doc_id, lvl, d) AS (
  SELECT doc_id, 0, coalesce(tampered, leaf) FROM leaves UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(s.l || f.d || s.r) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.lvl = f.lvl)
SELECT l.doc_id, leaf, s.d AS subroot, t.d AS root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = t.d AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, (SELECT d FROM top WHERE n = 1) t,
     (SELECT doc_id, max_by(d, lvl) AS d FROM folds GROUP BY doc_id) f LEFT JOIN proofs p ON p.doc_id = f.doc_id
WHERE f.doc_id = l.doc_id"""


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


DECONTAMINATION = f"""
WITH words AS (SELECT doc_id, {PLAIN_WORDS.format(x=LOWER_SQL.format(x="coalesce(text, '')"))} AS w FROM documents),
item_words AS (SELECT item_id, {PLAIN_WORDS.format(x=LOWER_SQL.format(x="coalesce(text, '')"))} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[pos + 1 : pos + least(len(w), 10)] AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, least(len(w), 1)))) AS pos FROM item_words)),
spots AS (
  SELECT doc_id, pos, size, w[pos + 1 : pos + size] AS win
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS pos FROM words, (SELECT DISTINCT size FROM windows))),
found AS (SELECT doc_id, pos, size, item_id FROM spots JOIN windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT at_word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS at_word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

SLIPS = 199


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.runs(table(spark, folder, "documents")).filter(F.length("word") >= spelling.LEAST_LENGTH)
    h, size = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word"))), F.length("word")
    at = (h % size).cast("int")
    slipped = F.concat(F.substr("word", F.lit(1), at), F.substr(F.col("word"), at + 2))
    words = runs.select(F.when(h % SLIPS == 0, slipped).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(spelling.counted(words))


SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {LOWER_SQL.format(x="unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS r FROM documents),
each AS (SELECT doc_id, r, length(r) AS size, count(*) AS k FROM runs WHERE length(r) >= 6 GROUP BY doc_id, r),
coded AS (SELECT *, encode(CAST(doc_id AS varchar) || ':' || r) AS bytes FROM each),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::bigint, flatten([
      [('0x' || substr(hex(bytes), 2 * i + 1, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(octet_length(bytes))])),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
  FROM coded),
slipped AS (SELECT k, CASE WHEN h % {SLIPS} = 0 THEN r[1 : h % size] || r[h % size + 2 :] ELSE r END AS word FROM hashed),
words AS (
  SELECT word, CAST(sum(k) AS bigint) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, length(word) AS size, i, word[1 : i] || word[i + 2 :] AS rest
         FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.size = b.size AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * words.n THEN other END AS form,
         CASE WHEN m >= 5 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, at_word) AS (
  SELECT word, word FROM forms UNION ALL
  SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at_word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, at_word AS root FROM walk JOIN forms ON forms.word = at_word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""


BINDINGS = {
    "op1_quality": (op1_quality, None),
    "op2_rules": (op2_rules, RULES),
    "op3_simhash": (op3_simhash, None),
    "op4_licenses": (op4_licenses, LICENSES),
    "op5_line_dedup": (op5_line_dedup, LINE_DEDUP),
    "op6_urls": (op6_urls, URLS),
    "op7_passages": (op7_passages, None),
    "op8_spots": (op8_spots, None),
    "op9_mix": (op9_mix, MIX),
    "op10_bpe": (op10_bpe, None),
    "op11_manifest": (op11_manifest, MANIFEST),
    "op12_decontamination": (op12_decontamination, DECONTAMINATION),
    "op13_spelling": (op13_spelling, SPELLING),
}
