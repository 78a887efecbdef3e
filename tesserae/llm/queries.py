"""Queries of the operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, fim, jaccard_join, langid, mixing, ngram_lm, pii, prefix_trie, quality, sharding, substring_dedup, toxicity, warc
from tesserae.llm.shared import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, part: int):
    """Whether the CRC-32 of doc_id as text leaves this remainder; false for null ids."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~_held_out(4, 2)))
    return langid.identify(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences to a first occurrence elsewhere (or earlier in themselves); others have no row."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels.where(~_held_out(3, 1)))
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(_table(spark, sf_dir, "documents"), jaccard_join.Near(3, 90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(pii.find_pii(_table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and the item it holds; clean documents have none."""
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, then read every record back."""
    ws = Workspace(spark, "warc")
    archives = ws.path("archives")
    archives = archives if "://" in archives else archives.replace("file:", "file://") if archives.startswith("file:") else f"file://{archives}"
    pages = _table(spark, sf_dir, "pages")
    revisits = ws.save(warc.refer(pages), "revisits")
    index = ws.save(warc.write_archives(pages, archives, revisits=revisits), "index")
    back = warc.read_records(index, archives, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.withColumns({"weight": F.round("weight", 9), "probability": F.round("probability", 9)})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law held is ``bytes``; the position within the shard is the slot.  The map is stored and loaded again by the operator."""
    placed, _ = sharding.shard_documents(_table(spark, sf_dir, "documents"), store=Workspace(spark, "slot_map").root)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op11_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(_table(spark, sf_dir, "documents"), ~_held_out(7, 2))
    scores = (F.round(c, 6).alias(c) for c in ("base_score", "score"))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *scores)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every output and of the text restored from it."""
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = (F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (back, "restored_sha256")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), every=20).drop("digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_pii": op5_pii,
        "op6_decontaminate": op6_decontaminate,
        "op7_warc": op7_warc,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding,
        "op11_ngram_lm": op11_ngram_lm,
        "op12_fim": op12_fim,
        "op13_prefix_trie": op13_prefix_trie,
    }


def _mixing_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {k + 1}, 1)) - 1) * {16.0 ** (11 - k):.0f}.0" for k in range(12))
    dims = mixing.DIMS
    own = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS own_{d}" for d in dims)
    once = ", ".join(f"sum(pow(own_{d}, {mixing.POWERS[d]}) * tokens / own_{d}) AS all_{d}" for d in dims)
    targets = ", ".join(f"pow(own_{d}, {mixing.POWERS[d]}) / all_{d} AS to_{d}" for d in dims)
    steps, last = [], "start"
    for turn in range(mixing.ROUNDS):
        for d in dims:
            name = f"r{turn}_{d}"
            steps.append(f"""s_{name} AS (SELECT *, sum(CASE WHEN weight >= most THEN most ELSE 0 END) OVER w AS fixed, sum(CASE WHEN weight >= most THEN 0 ELSE weight END) OVER w AS free, sum(weight) OVER w AS sum_all FROM {last} WINDOW w AS (PARTITION BY {d})),
{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, all_tokens, most, to_source, to_lang, to_topic,
  least(most, weight * CASE WHEN to_{d} - fixed <= 0 THEN to_{d} / sum_all WHEN weight >= most THEN 1 ELSE (to_{d} - fixed) / free END) AS weight FROM s_{name})""")
            last = name
    stem = f"(\\p{{L}}{{{mixing.STEM}}})\\p{{L}}*"
    return f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, text,
         trim(coalesce(text, ''), {spaces}) AS bare
  FROM documents),
stems AS MATERIALIZED (SELECT r, lang, unnest(regexp_extract_all(lower(text), '{stem}', 1)) AS stem FROM texts WHERE text IS NOT NULL),
size AS (SELECT count(text)::DOUBLE AS n FROM texts),
langs AS (SELECT lang, count(text) AS n FROM texts GROUP BY lang),
counts AS (SELECT stem, sum(cf) AS cf, sum(df) AS df, max(df * {mixing.COMMON} - n) AS over
           FROM (SELECT stem, lang, count(*) AS cf, count(DISTINCT r) AS df FROM stems GROUP BY ALL) JOIN langs USING (lang) GROUP BY stem),
bursts AS (SELECT stem, round(ln(n / df) + ln(1 - exp(-cf / n)), 6) AS burst FROM counts, size WHERE df * {mixing.RARE} >= n AND over <= 0 AND df < cf),
anchors AS MATERIALIZED (SELECT stem, row_number() OVER (ORDER BY burst DESC, stem) AS k FROM bursts QUALIFY k <= {mixing.TOPICS}),
topics AS (SELECT r, stem AS topic FROM (SELECT r, stem, k, count(*) AS c FROM stems JOIN anchors USING (stem) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r ORDER BY c DESC, k) = 1),
features AS MATERIALIZED (
  SELECT r, doc_id, source, lang, coalesce(topic, '{mixing.OTHER}') AS topic,
         CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[ \t\n\x0b\x0c\r]+')) END::BIGINT AS tokens,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h
  FROM texts LEFT JOIN topics USING (r)),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM features GROUP BY ALL HAVING sum(tokens) > 0),
owned AS (SELECT *, {own} FROM cells),
sums AS (SELECT sum(tokens) AS all_tokens, {once} FROM owned),
start AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / all_tokens AS weight, tokens / (all_tokens * {mixing.BUDGET}) AS most, all_tokens, {targets} FROM owned, sums),
{", ".join(steps)},
shares AS (SELECT source, lang, topic, weight, least(1.0, {mixing.BUDGET} * all_tokens * weight / tokens) AS probability FROM {last})
SELECT doc_id, f.source, f.lang, f.topic, f.tokens, round(coalesce(weight, 0), 9) AS weight, round(coalesce(probability, 0), 9) AS probability,
       f.tokens > 0 AND ({digits}) / {float(1 << 48):.0f}.0 < coalesce(probability, 0) AS sampled
FROM features f LEFT JOIN shares s USING (source, lang, topic)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JACCARD_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
keyed AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets),
reps AS MATERIALIZED (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY k),
grams AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets WHERE doc_id IN (SELECT rep FROM reps)),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN reps p ON p.rep = a JOIN reps q ON q.rep = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS id, rep AS root FROM reps UNION SELECT sym.b AS id, reach.root FROM reach JOIN sym ON sym.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, keyed.n AS n_shingles, CASE WHEN keyed.n = 0 THEN doc_id ELSE root END AS component_id
FROM keyed LEFT JOIN reps ON reps.k = keyed.k AND keyed.n > 0 LEFT JOIN roots ON roots.id = reps.rep"""


def _warc_sql() -> str:
    part = lambda k: f"('0x' || substr(h, {5 * k + 1}, 5))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part(k)} >> {15 - 5 * j}) & 31)::INTEGER + 1, 1)" for k in range(8) for j in range(4))
    return f"""
WITH hashed AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM hashed)
SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to FROM firsts"""


#: A table t of the values that a byte gives in CRC-32 of the reflected polynomial 0xEDB88320.
_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (SELECT range AS i, list_reduce(list_concat([range], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256))"""


def _crc_sql(digits: str) -> str:
    """CRC-32 of ASCII text by the table t."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({digits}, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: xor(x >> 8, t[((xor(x, b)) & 255) + 1])), 4294967295)"


def _lm_sql() -> str:
    smoothing = ngram_lm.Smoothing()
    white = "[ \\t\\n\\x0b\\x0c\\r]"
    # an end is a blank, which no word is
    steps, chance = [], "p1"
    for k in range(2, smoothing.order + 1):
        mu, gram = smoothing.strength[k - 2], ", ".join(f"w{j}" for j in range(k - 1, -1, -1))
        context = " AND ".join(f"t.w{j} = c{k - 1}.w{j - 1}" for j in range(1, k))
        same = " AND ".join(f"t.w{j} = c{k}.w{j}" for j in range(k))
        steps.append(f"""c{k} AS MATERIALIZED (SELECT {gram}, count(*) AS n FROM t1 WHERE NOT held_out AND w{k - 1} IS NOT NULL GROUP BY ALL),
t{k} AS MATERIALIZED (SELECT t.*, CASE WHEN c{k - 1}.n >= {smoothing.least} THEN (coalesce(c{k}.n, 0) + {mu} * p{k - 1}) / (c{k - 1}.n + {mu}) ELSE p{k - 1} END AS p{k}
  FROM t{k - 1} t LEFT JOIN c{k - 1} ON {context} LEFT JOIN c{k} ON {same})""")
        chance = f"p{k}"
    lags = ", ".join(f"lag(w, {j}) OVER o AS w{j}" for j in range(1, smoothing.order))
    return f"""
WITH crc AS ({_CRC_TABLE}),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_crc_sql("doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
    [' '] || list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{white}+'), lambda x: x <> '') || [' '] AS s
  FROM documents, crc),
words AS (SELECT r, held_out, unnest(s) AS w, generate_subscripts(s, 1) AS place FROM texts),
places AS MATERIALIZED (SELECT r, held_out, place, w AS w0, {lags} FROM words WINDOW o AS (PARTITION BY r ORDER BY place)),
t0 AS (SELECT * FROM places WHERE place > 1),
c1 AS MATERIALIZED (SELECT w0, count(*) AS n FROM t0 WHERE NOT held_out GROUP BY ALL),
size AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS seen FROM c1),
t1 AS MATERIALIZED (SELECT t0.*, n > 0 AS known, (coalesce(n, 0) + 1) / (tokens + seen + 1) AS p1 FROM t0 LEFT JOIN c1 USING (w0), size),
{", ".join(steps)},
sums AS (SELECT r, count(*) AS n_tokens, count(known) AS n_known, sum(log10(p1)) AS base, sum(log10({chance})) AS model FROM t{smoothing.order} GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, tokens AS train_tokens, round(base, 6) AS base_score, round(model, 6) AS score FROM texts JOIN sums USING (r), size"""


def _fim_sql() -> str:
    plan, white = fim.Plan(), "[ \\t\\n\\x0b\\x0c\\r]"
    unit = f"{white}*{white.replace('[', '[^')}+|{white}+"
    h = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    holds = " OR ".join(f"strpos(text, '{x}') > 0" for x in fim.SENTINELS)
    p, s, m = (f"'{x}'" for x in fim.SENTINELS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{plan.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '{unit}') AS u, {h} FROM texts),
cuts AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
           CASE WHEN text = '' OR {holds} OR h3 % 100 >= {plan.rate} THEN 'plain' WHEN h4 % 100 < {plan.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE {p} || prefix || {s} || suffix || {m} || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


_TRIE_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
ids AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
hashed AS MATERIALIZED (SELECT conv_id, {_crc_sql("conv_id::VARCHAR")} % 4 AS h FROM ids, crc),
turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS MATERIALIZED (
  SELECT t.conv_id, pos, said, words FROM turns t JOIN hashed USING (conv_id) WHERE pos > h
  UNION ALL SELECT x.conv_id, pos, said, words FROM hashed x JOIN turns t ON t.conv_id = x.conv_id - x.conv_id % 20 WHERE pos <= h),
lists AS MATERIALIZED (SELECT ids.conv_id, coalesce(list(md5(said) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id),
prefixes AS MATERIALIZED (SELECT conv_id, d, s[:d] AS p, s[:d - 1] AS up, coalesce(w[d], 0) AS words, d = len(s) AS at_end FROM lists, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
nodes AS MATERIALIZED (
  SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS MATERIALIZED (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN children USING (d, p)),
sums AS (SELECT e AS d, p[:e] AS p, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM counted, LATERAL (SELECT unnest(range(counted.d + 1)) AS e) GROUP BY ALL)
SELECT c.conv_id, c.d::BIGINT AS depth, o.conv_id AS parent_conv_id, c.n_convs, c.kids::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (d, p) LEFT JOIN nodes o ON c.d > 0 AND o.d = c.d - 1 AND o.p = c.up"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force or held-out rows."""
    return {"op4_jaccard_join": _JACCARD_SQL, "op7_warc": _warc_sql(), "op8_mixing": _mixing_sql(), "op11_ngram_lm": _lm_sql(), "op12_fim": _fim_sql(), "op13_prefix_trie": _TRIE_SQL}
