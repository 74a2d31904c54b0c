"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import chat, decontaminate, exact_dedup, fill_in_middle, license_scan, line_dedup, mixing, quality, sharding, simhash, substring_dedup, vector_codes, warc
from hyperloom.llm.common import scratch_path
from hyperloom.sources import table

MIX_ROUNDS = 10


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = chat.repair(table(spark, sf_dir, "conversations"))
    return repaired.select("conv_id", "turn", "role", "new_role", "action", "inserted", "tail", "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.classify(documents, model, threshold=0.3)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(documents, benchmark, window=13, gram=5, share=20)
    return found.drop("_k1", "_k2")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    read = warc.read_archive(spark, path)
    return read.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "complete",
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), topic=mixing.by_length(F.col("text")), temper=0.5, rounds=MIX_ROUNDS)
    return mixed.withColumn("probability", F.round("probability", 9))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    rebuilt = fill_in_middle.restore(examples)
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rebuilt.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slots(table(spark, sf_dir, "documents"), weights=sharding.EQUAL, added=(1.0,))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash,
        op2_chat_format,
        op3_exact_dedup,
        op4_license_scan,
        op5_quality,
        op6_decontaminate,
        op7_line_dedup,
        op8_warc,
        op9_substring_dedup,
        op10_mixing,
        op11_fill_in_middle,
        op12_vector_codes,
        op13_sharding,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Alphanumeric words and non-blank words of a text, in order.
_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_TOKENS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _license_sql() -> str:
    """Brute force: every template against every block of its own width."""
    widths = sorted({(t.stride(), t.width()) for t in license_scan.STATEMENTS})
    classes = ", ".join(f"({s}, {n})" for s, n in widths)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"('{t.label}', {quoted(t.words)})" for t in license_scan.BASE)
    other = ", ".join(f"('{t.label}', {quoted(sorted(set(t.words)))}, {t.needed}, {t.stride()}, {t.width()})" for t in license_scan.STATEMENTS)
    return f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, label, i FROM (SELECT *, unnest(generate_series(0, len(w) - 1)) AS i FROM d), (VALUES {base}) t(label, ws)
              WHERE list_slice(w, i + 1, i + len(ws)) = ws),
        b AS (SELECT doc_id, st, wide, list_distinct(list_slice(w, k * st + 1, k * st + wide)) AS s
              FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // st)) AS k FROM d, (VALUES {classes}) c(st, wide) WHERE len(w) > 0)),
        m AS (SELECT doc_id, label, len(list_intersect(s, ws)) AS n, len(ws) AS whole, need FROM b JOIN (VALUES {other}) t(label, ws, need, st, wide) USING (st, wide)),
        f AS (SELECT doc_id, label, false AS base, NULL AS i, n / whole AS share FROM m WHERE n >= need
              UNION ALL SELECT doc_id, label, true, i, 1.0 FROM p),
        g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) AS first_word, max(i) AS last_word,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
                     array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM f GROUP BY doc_id)
        SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word,
               last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::double AS score
        FROM d LEFT JOIN g USING (doc_id)"""


def _mixing_sql(rounds: int = MIX_ROUNDS) -> str:
    """The same rounds, one common table expression for each scaling."""
    steps, last = [], "c0"
    for k in range(rounds):
        for d in mixing.DIMENSIONS:
            steps.append(
                f"c_{k}_{d} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 "
                f"THEN w * (t_{d} / s_{d}) / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})"
            )
            last = f"c_{k}_{d}"
    share = ", ".join(f"sqrt(sum(tokens) OVER (PARTITION BY {d})::double) AS t_{d}" for d in mixing.DIMENSIONS)
    sums = ", ".join(f"(SELECT sum(t_{d}) FROM (SELECT DISTINCT {d}, t_{d} FROM a)) AS s_{d}" for d in mixing.DIMENSIONS)
    return f"""
        WITH n AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len({_TOKENS}) AS k FROM documents),
        r AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN k < 100 THEN 'note' WHEN k < 600 THEN 'article' ELSE 'long' END AS topic,
              greatest(k, 1)::bigint AS n_tokens FROM n),
        c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL),
        a AS MATERIALIZED (SELECT *, {share} FROM c),
        c0 AS MATERIALIZED (SELECT *, {sums}, tokens::double AS w FROM a),
        {", ".join(steps)},
        p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS probability FROM {last})
        SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability,
               ('0x' || substr(md5('42|' || doc_id::varchar), 1, 13))::bigint / 4503599627370496.0 < probability AS sampled
        FROM r JOIN p USING (source, lang, topic)"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, one pair of common table expressions for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, d * 1000 + entry) AS entry FROM (SELECT vec_id, part, entry, "
            f"list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint AS d FROM p JOIN b{k} USING (part)) GROUP BY ALL)"
        )
        if k < rounds:
            steps.append(
                f"s{k} AS (SELECT part, entry, i, sum(x[i])::bigint AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL)"
            )
            steps.append(f"m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x
              FROM v, (SELECT unnest(range({parts})) AS part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
              WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),
        {", ".join(steps)},
        f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM f JOIN v USING (vec_id)"""


def _shards_sql(shards: int = 16) -> str:
    """Every id against every shard, and CRC-32 byte by byte over a table made by its rule."""
    draw = "('0x' || substr(md5('42|' || {} || '|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint"
    return f"""
        WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
              FROM range(256) r(i)),
        d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce(list_prepend(4294967295::bigint,
                  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint AS text_crc32 FROM documents, t),
        r AS (SELECT *, list_transform(range({shards + 1}), lambda i: -ln(({draw.format("i::varchar")} + 0.5::double) / 4503599627370496.0::double)) AS s FROM d),
        a AS (SELECT *, list_position(s[:{shards}], list_min(s[:{shards}])) - 1 AS shard, list_position(s, list_min(s)) - 1 AS grown_shard FROM r)
        SELECT doc_id, size::bigint AS size, text_crc32, 'key' AS law, shard::int AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY {draw.format("shard::varchar")}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
               grown_shard::int AS grown_shard
        FROM a"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_fill_in_middle": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
            w AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::bigint) AS r FROM d),
            c AS (SELECT *, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
                         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM w),
            p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
            SELECT doc_id, len(u)::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
                   CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
            FROM p""",
        "op12_vector_codes": _codes_sql(),
        "op13_sharding": _shards_sql(),
        "op3_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
            FROM d WINDOW g AS (PARTITION BY t)""",
        "op8_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep, sha1(h) AS hex FROM p)
            SELECT page_id, strlen(h)::bigint AS payload_bytes,
                   list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((('0x' || substr(hex, (i // 4)::int * 5 + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS complete
            FROM g""",
        "op4_license_scan": _license_sql(),
        "op10_mixing": _mixing_sql(),
        "op6_decontaminate": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
                  FROM (SELECT *, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
            e AS (SELECT DISTINCT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
                  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM g))),
            m AS (SELECT DISTINCT doc_id, p, n, item_id FROM e JOIN g USING (n, k)),
            h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS i FROM m) GROUP BY doc_id),
            t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
                  FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM m) GROUP BY doc_id)
            SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op9_substring_dedup": f"""
            WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
            e AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS k
                  FROM (SELECT *, unnest(generate_series(1, len(w) - 34)) AS p FROM d)),
            r AS (SELECT doc_id, p FROM e JOIN (SELECT k FROM e GROUP BY k HAVING count(*) > 1) USING (k)),
            g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS i FROM r),
            t AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM d),
            k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
            SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN k USING (doc_id)""",
        "op7_line_dedup": f"""
            WITH l AS (
                SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line,
                       trim(string_split({_LOWER}, chr(10))[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
                FROM (SELECT *, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
            f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM f)) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM f)), '')) AS kept_sha256
            FROM l GROUP BY doc_id""",
    }
