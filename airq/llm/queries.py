"""The queries of this package over the test tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airq.llm import collocations, decontam, exact, minhash, mixing, quality, ring, simhash, suffix, tokens, trie, urls, words
from airq.llm.shared import documents

#: The rules of the url query, as (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
TOKENIZER = "word_bpe_49k.json"
N_SHARDS = 16
#: Target shares of the expected tokens, by language.
DOMAIN_WEIGHTS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the middle are the stored snapshot, the later ones arrive as a batch."""
    docs = documents(spark, sf_dir)
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"]
    late = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    groups = exact.exact_dedup(docs.filter(late), exact.build_snapshot(docs.filter(~late)))
    return exact.with_groups(docs, groups)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring_shards(documents(spark, sf_dir), N_SHARDS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(documents(spark, sf_dir)).drop("kept_bytes")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(documents(spark, sf_dir), tokenizer_path()))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, urls.rule_table(spark, URL_RULES)).drop("url")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.substring_dedup(documents(spark, sf_dir)).drop("kept_text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are the domains; those of the labelled documents are trusted."""
    return mixing.mixture(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), DOMAIN_WEIGHTS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(documents(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_simhash": op3_simhash,
        "op4_ring_shards": op4_ring_shards,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_token_shards": op6_token_shards,
        "op7_url_filter": op7_url_filter,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_collocations": op11_collocations,
        "op12_minhash": op12_minhash,
        "op13_prefix_trie": op13_prefix_trie,
    }


EXACT_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

URL_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES {', '.join(str(rule) for rule in URL_RULES)}
), parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path,
       (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(verdict, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM parts
"""


COLLOCATION_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), counts AS (
    SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f
    FROM words, unnest(range(1, 6)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)
    GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT lang, p, k, f AS a, array_to_string(p, ' ') AS phrase FROM counts WHERE k > 1
), kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
        AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, cut,
           CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM kept c JOIN totals t ON t.lang = c.lang, unnest(range(1, c.k)) AS u(cut)
    JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:cut] JOIN counts r ON r.lang = c.lang AND r.p = c.p[cut + 1:]
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM lowest QUALIFY rank <= 2000
"""

MINHASH_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON u = doc_id
"""

#: A conversation's digits, each followed by seven more steps of the CRC.
_STEP = "xor({a} >> 1, 3988292384 * ({a} & 1))"
_CRC = (
    "xor(list_reduce(flatten([[4294967295], flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), "
    "lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1]))]), "
    f"lambda a, x: CASE WHEN x >= 0 THEN {_STEP.format(a='xor(a, x)')} ELSE {_STEP.format(a='a')} END), 4294967295) % 6"
)

TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), asked AS (
    SELECT c, own, {_CRC} AS h FROM turns
), built AS (
    SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS seq
    FROM asked a LEFT JOIN turns b ON b.c = a.c - a.c % 100
), members AS (
    SELECT c, len(seq) AS length, d, seq[1:d] AS node FROM built, unnest(range(len(seq) + 1)) AS t(d)
), nodes AS (
    SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, node[1:d - 1] AS above,
           CASE WHEN d > 0 THEN (count(*) - 1) * length(node[d].text) ELSE 0 END AS saving,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = d), '')) AS ends_sha256
    FROM members GROUP BY node, d
), kids AS (
    SELECT above, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above
), subtree AS (
    SELECT n.node[1:k] AS node, sum(saving) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
    FROM nodes n LEFT JOIN kids ON kids.above = n.node, unnest(range(n.d + 1)) AS t(k) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
       coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.node = n.node LEFT JOIN kids ON kids.above = n.node LEFT JOIN nodes p ON p.node = n.above
"""


def oracle_sql() -> dict[str, str]:
    """The other queries hash in ways, or keep state, that SQL does not express."""
    return {"op1_exact_dedup": EXACT_SQL, "op7_url_filter": URL_SQL, "op11_collocations": COLLOCATION_SQL,
            "op12_minhash": MINHASH_SQL, "op13_prefix_trie": TRIE_SQL}
