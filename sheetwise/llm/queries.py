"""Registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, fingerprints, jaccard, mix, neighbours, packing, pii, quality, shards, turns, vectors, warc
from .common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_EXTRA = "</s>[INST] ok [/INST]"


@register(
    "op1_chat_format",
    rf"""WITH rows AS (
           SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_EXTRA}'), (-1, 1, 'assistant', '{_EXTRA}')),
         sized AS (
           SELECT *, length(x) + length(x) - length(replace(x, '\', ''))
                  + len(regexp_extract_all(x, '<\|turn\|>|<\|text\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS escaped
           FROM (SELECT *, concat(role, chr(0), text) AS x FROM rows))
         SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(escaped + 23)::BIGINT AS formatted_chars
         FROM sized GROUP BY conv_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 with control strings in its texts, formatted and read back."""
    extra = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{_EXTRA}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat.render(chat.to_turns(rows)).select("conv_id", "formatted", "loss_spans")
    out = out.withColumns({"back": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@register(
    "op5_source_mix",
    r"""WITH sized AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
        run AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio,
                  sum(3 * source_size) OVER o AS caps, sum(w) OVER o AS used, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
                FROM src WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        capped AS (SELECT *, caps::DOUBLE + ratio * (weights - used)::DOUBLE <= total::DOUBLE AS capped FROM run),
        goal AS (SELECT source, source_size,
                   CASE WHEN capped THEN cap::DOUBLE ELSE least(cap::DOUBLE,
                     (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE * w) END AS target
                 FROM capped),
        part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
        leant AS (SELECT *, length(bin(greatest(size, 1))) - 1 + 8 AS g FROM sized),
        class AS (SELECT k.source, g, words, target - whole * source_size AS lft
                  FROM (SELECT source, g, sum(size)::BIGINT AS words FROM leant GROUP BY source, g) k JOIN part q ON k.source IS NOT DISTINCT FROM q.source),
        level AS (SELECT *, lft > 0 AND (sum(words) OVER o)::DOUBLE + ((sum(g * words) OVER w)::BIGINT - (sum(g * words) OVER o)::BIGINT)::DOUBLE / g <= lft AS sure
                  FROM class WINDOW w AS (PARTITION BY source), o AS (PARTITION BY source ORDER BY g DESC ROWS UNBOUNDED PRECEDING)),
        left_over AS (SELECT *, lft - coalesce(sum(words) FILTER (sure) OVER w, 0)::BIGINT AS rest, (coalesce(sum(g * words) FILTER (NOT sure) OVER w, 0))::BIGINT AS free
                  FROM level WINDOW w AS (PARTITION BY source)),
        chance AS (SELECT source, g, rest, CASE WHEN sure THEN 1 WHEN free > 0 THEN least(rest / free * g, 1 - 1e-12::DOUBLE) ELSE 0 END::DOUBLE AS p FROM left_over),
        ranked AS (
          SELECT doc_id, size, s.source, source_size, target, whole, p, rest,
                 (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
          FROM leant s JOIN part q ON s.source IS NOT DISTINCT FROM q.source JOIN chance c ON s.source IS NOT DISTINCT FROM c.source AND s.g = c.g),
        odds AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked),
        placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY floor(q / (1 + q) * 4096), q, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM odds WHERE q IS NOT NULL
                   UNION ALL SELECT *, NULL FROM odds WHERE q IS NULL)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN p >= 1 OR before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM placed""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register(
    "op6_warc_archive",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
         f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
       SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS verified
       FROM f""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive in the shared folder and read back from it."""
    path = shared_dir(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@register("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document text: the patterns' spans and those the field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@register("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document text scored for quality by the compression classifier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op3_vector_near_dup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of equal label."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op8_shingle_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by the similarity of their five-word shingles."""
    return jaccard.similar(table(spark, sf_dir, "documents"))


@register("op7_nearest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


#: Parts in which the documents arrive, by doc_id.
ARRIVALS = 12


@register("op4_shard_compaction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as arrivals of small shards, compacted as they come; a row for each document with its shard in the final manifest."""
    _, rows = shards.shard(shards.arrivals(table(spark, sf_dir, "documents"), "doc_id", ARRIVALS), shared_dir(spark))
    text = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return rows.select("doc_id", F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"), F.col("_version").alias("version"), text)


@register(
    "op13_filter_audit",
    r"""WITH words AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        least_id AS (SELECT t, min(doc_id) AS m FROM words GROUP BY t),
        marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        fails AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                        CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END,
                        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > m THEN 'E' ELSE '' END) AS f
          FROM words JOIN least_id USING (t) LEFT JOIN marked USING (doc_id)),
        cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        perms AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM letters a, letters b, letters c, letters d, letters e
                  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, k, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before FROM perms, range(1, 6) r(k)),
        hits AS (SELECT part, o, k, x, n, good, toxic, f, contains(f, x) AS fails_x, len(translate(f, before, '')) < len(f) AS gone FROM cells, steps),
        per_step AS (
          SELECT part, o, k, x, sum(n) FILTER (NOT gone AND NOT fails_x) AS kept, sum(n) FILTER (NOT gone AND fails_x) AS removed, sum(n) FILTER (gone AND fails_x) AS redundant,
                 sum(n) FILTER (f = x) AS unique_fails, sum(good) FILTER (NOT gone AND fails_x) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_x) AS toxic_lost
          FROM hits GROUP BY part, o, k, x)
        SELECT part, o AS filter_order, k::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley
        FROM per_step""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in every order."""
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@register(
    "op11_turn_repair",
    r"""WITH RECURSIVE hashed AS (
          SELECT *, xor(list_reduce(list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::BIGINT),
                    lambda x, b: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(x, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS lot
          FROM conversations),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                 CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
          FROM hashed, (VALUES (1), (2)) twice(i) WHERE lot <> 0 AND (i = 1 OR lot = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
        told AS (
          SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
                 CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                      WHEN right(regexp_replace(text, '[ 	-
]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f
          FROM placed),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                 count(*) FILTER (f = 't') AS truncated, count(*) FILTER (r0 IS NOT NULL AND concat(r0, r) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
          FROM told GROUP BY conv_id),
        walk AS (
          SELECT conv_id, 0::BIGINT AS i, 'n' AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counts
          UNION ALL
          SELECT conv_id, i, s, min(best) FROM (
            SELECT t.conv_id, t.i,
                   CASE WHEN op = 'D' THEN at_s WHEN op = 'S' THEN 's' ELSE need END AS s,
                   {'cost': w.best.cost + 3 * k + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN op <> 'D' AND t.f = 't' THEN 3 ELSE 0 END,
                    'audit': concat(w.best.audit, repeat('I', k), CASE op WHEN 'S' THEN 'K' ELSE op END),
                    'lines': list_concat(w.best.lines, [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(added, '') IF x <> ''],
                      CASE op WHEN 'D' THEN [] WHEN 'R' THEN [concat(CASE need WHEN 'u' THEN 'user:' ELSE 'assistant:' END, t.text)] ELSE [concat(t.role, ':', t.text)] END)} AS best
            FROM (SELECT *, CASE WHEN k = 0 THEN s ELSE right(added, 1) END AS at_s,
                         CASE WHEN CASE WHEN k = 0 THEN s ELSE right(added, 1) END = 'u' THEN 'a' ELSE 'u' END AS need
                  FROM (SELECT *, CASE WHEN s = 'u' THEN substr('au', 1, k) ELSE substr('ua', 1, k) END AS added FROM walk, (VALUES (0), (1), (2)) inserts(k))) w
            JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
            JOIN (VALUES ('K'), ('S'), ('R'), ('D')) ops(op)
              ON op = 'D' OR t.f NOT IN ('b', 'd') AND (op = 'R' OR op = 'K' AND t.r = need OR op = 'S' AND t.r = 's' AND at_s = 'n'))
          GROUP BY conv_id, i, s),
        ends AS (
          SELECT w.conv_id, min({'cost': best.cost + 3 * k, 'audit': concat(best.audit, repeat('I', k)), 'lines': list_concat(best.lines, (['user:', 'assistant:'])[3 - k:2])}) AS best
          FROM (SELECT *, CASE s WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END AS k FROM walk) w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n GROUP BY w.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
               sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired at the least cost."""
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))
