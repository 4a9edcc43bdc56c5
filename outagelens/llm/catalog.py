"""The registered queries of the numbered operators: thin queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .common import documents, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op2(spark, sf):
    from .exact_dedup import duplicate_groups

    return duplicate_groups(documents(spark, sf), digests=True)


@query("op3_quality_rules")
def op3(spark, sf):
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_url_filter")
def op4(spark, sf):
    from .url_filter import judge, train

    return judge(spark.read.parquet(f"{sf}/pages.parquet"), train(spark))


@query("op6_sharding")
def op6(spark, sf):
    from .sharding import shard_rows

    return shard_rows(documents(spark, sf)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mixing")
def op10(spark, sf):
    from .mixing import mix

    return mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_quality_model")
def op5(spark, sf):
    from .quality_model import quality_scores

    return quality_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


#: Key of the registered query's pseudonyms; a user passes an own secret.
PII_KEY = "registered query"


@query("op8_pii")
def op8(spark, sf):
    from .pii import pseudonyms

    return pseudonyms(documents(spark, sf), PII_KEY)


@query("op9_bpe")
def op9(spark, sf):
    import public_tokenizers

    from . import bpe

    docs = documents(spark, sf)
    shared = bpe.load(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.decode(bpe.encode(docs, shared), shared).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_jaccard_join")
def op7(spark, sf):
    from .jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf))


@query("op1_suffix_dedup")
def op1(spark, sf):
    from .suffix_dedup import repeated_spans

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeated_spans(documents(spark, sf)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op11_merkle_manifest", """
WITH RECURSIVE
coded AS (SELECT doc_id, source, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS front,
    list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(0, 8),
        lambda k: (ascii(substr(doc_id::VARCHAR, i::INT, 1)) >> k::INT) & 1)))),
        lambda c, bit: xor(c >> 1, CASE WHEN xor(c, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents),
leaves AS (SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS changed,
    xor(crc, 4294967295) % 2 = 0 AS tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM coded),
tree AS (SELECT source, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, lvl, i, h, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, lvl + 1 AS lvl, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM tree WHERE n > 1 GROUP BY source, lvl, i // 3)),
tops AS (SELECT source, lvl AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM tree WHERE n = 1),
crown AS (SELECT 0 AS lvl, s AS i, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT lvl, i, h, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM crown WHERE n > 1 GROUP BY lvl, i // 3)),
nodes AS (SELECT t.s, lvl, i, h FROM tree JOIN tops t ON tree.source IS NOT DISTINCT FROM t.source WHERE n > 1),
path AS (SELECT l.doc_id, n.lvl, n.i, n.h, l.i // (3 ** n.lvl)::BIGINT AS mine FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
    JOIN nodes n ON n.s = t.s AND n.i // 3 = l.i // (3 ** (n.lvl + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, t.height + c.lvl, c.i, c.h, t.s // (3 ** c.lvl)::BIGINT FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
    JOIN crown c ON c.n > 1 AND c.i // 3 = t.s // (3 ** (c.lvl + 1))::BIGINT),
runs AS (SELECT doc_id, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < mine), '') AS before,
    coalesce(string_agg(h, '' ORDER BY i) FILTER (i > mine), '') AS after FROM path GROUP BY doc_id, lvl),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256, max(lvl) + 1 AS steps FROM runs GROUP BY doc_id),
folded AS (SELECT doc_id, 0::BIGINT AS lvl, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(r.before || f.h || r.after) FROM folded f JOIN runs r ON r.doc_id = f.doc_id AND r.lvl = f.lvl)
SELECT l.doc_id, l.leaf, t.subroot, c.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = c.h AS verified
FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source JOIN crown c ON c.n = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN folded f ON f.doc_id = l.doc_id AND f.lvl = coalesce(p.steps, 0)""")
def op11(spark, sf):
    from .merkle import manifest

    docs = documents(spark, sf)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    rows = manifest(docs, tampered={"text": F.translate("text", "\n", "")}, where=tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


@query("op12_byte_bpe")
def op12(spark, sf):
    import public_tokenizers

    from . import byte_bpe

    docs = documents(spark, sf)
    shared = byte_bpe.load(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.decode(byte_bpe.encode(docs, shared), shared).select(
        "doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
sequences AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i::BIGINT, (i + k - 1)::BIGINT), ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sequences, range(1, 5) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM (
    SELECT lang, a, unnest(list_transform(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: [i, m]))),
        lambda x: array_to_string(list_slice(w, x[1]::BIGINT, (x[1] + x[2] - 1)::BIGINT), ' '))) AS part FROM candidates WHERE k > 2) o
    JOIN candidates c ON c.lang = o.lang AND c.phrase = o.part AND 100 * o.a >= 80 * c.a),
frequent AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
cuts AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(list_slice(w, 1, i::BIGINT), ' ') AS head,
    array_to_string(list_slice(w, (i + 1)::BIGINT, k::BIGINT), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates)),
scored AS (SELECT c.lang, c.phrase, c.a, c.i, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts c
    JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (SELECT b.* FROM best b ANTI JOIN inside d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000""")
def op13(spark, sf):
    from .collocations import collocations

    return collocations(documents(spark, sf))
