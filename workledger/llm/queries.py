"""One thin query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from workledger.llm.common import read, shared_dir, shared_root
from workledger.llm.decontaminate import decontaminate
from workledger.llm.html import main_text
from workledger.llm.lines import line_report
from workledger.llm.manifest import manifest
from workledger.llm.minhash import MinHashConfig, near_duplicates
from workledger.llm.mixing import MixConfig, mix
from workledger.llm.quality import quality
from workledger.llm.simhash import simhash_groups
from workledger.llm.token_blocks import read_documents, write_token_blocks
from workledger.llm.token_counts import token_counts
from workledger.llm.tokens import tokenizer_digest
from workledger.llm.toxicity import toxicity
from workledger.llm.trie import prefix_trie
from workledger.llm.warc import archived


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 4-word shingles at Jaccard 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), MinHashConfig(width=4))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to segmented archives and read back; a broken record fails the query."""
    found = archived(read(spark, sf_dir, "pages", "page_id", "url", "html"), shared_dir(spark, "warc"))
    digest = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("payload_digest"))
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from rows that are not held out."""
    return toxicity(
        read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near copies among the lines of every text."""
    return line_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and calibrated isolation forest."""
    return quality(
        read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule that mixes the sources at 95 % of the entropy of equal weights."""
    return mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"), MixConfig(entropy_share=0.95))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text under the word-end vocabulary, with one cache for all runs that share a folder."""
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = f"{shared_root(spark)}/token-cache-{tokenizer_digest(path)[:16]}"
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), path, cache)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of the 5-word shingles of a benchmark item."""
    return decontaminate(
        read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    ).withColumn("item_ids", F.array_join("item_ids", ","))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as range-coded blocks and read back."""
    path = shared_dir(spark, "token-blocks")
    write_token_blocks(
        read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_documents(spark, path)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, and what its subtree holds."""
    return prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 64-bit fingerprints at three bits."""
    return simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of every document, and which ones tampering breaks."""
    return manifest(read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_token_blocks": op10_token_blocks,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_manifest": op13_manifest,
}

# runs of letters and digits; an item's shingles are its 5-word windows, or all its words if they are fewer
_GRAMS = r"""
    SELECT DISTINCT id, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
        SELECT id, w, unnest({widths}) AS k FROM (
            SELECT {id} AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
            FROM {table} WHERE {id} IS NOT NULL) WHERE w <> ['']) WHERE len(w) >= k)
"""

# unsigned CRC-32 of a number's decimal form: eight shifts for each of its characters
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({n} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))))"""


def _leaf(**changed: str) -> str:
    parts = (changed.get(c, c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || {p}, '-')" for p in parts) + ")"


# nodes of binary trees over rows (part, i, n, h): runs of two become one node, level by level, while there are several
_TREE = """SELECT part, 0 AS l, i, n, h FROM {rows}
        UNION ALL SELECT part, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY part, l, n, i // 2"""
# rows (part, i, n, h) carried up a tree with the siblings that they had
_FOLD = """SELECT part, i, 0 AS l, n, h FROM {rows}
        UNION ALL SELECT f.part, f.i, f.l + 1, (f.n + 1) // 2, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN (f.i >> f.l) & 1 = 1 THEN t.h || f.h ELSE f.h || t.h END)
        FROM {name} f LEFT JOIN {tree} t ON t.part IS NOT DISTINCT FROM f.part AND t.l = f.l AND t.i = xor(f.i >> f.l, 1) WHERE f.n > 1"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        cut AS (SELECT c, s, c - c % 5 AS b, {_CRC.format(n="c")} % 9 AS h FROM own),
        rebuilt AS (
            SELECT k.c, list_concat(coalesce(o.s[1:k.h], k.s[1:0]), k.s[k.h + 1:]) AS s FROM cut k LEFT JOIN own o ON o.c = k.b),
        members AS (
            SELECT c, d, s[1:d] AS p, len(s) = d AS ends, CASE WHEN d > 0 THEN strlen(s[d].x) ELSE 0 END AS bytes
            FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT p, d, min(c) AS c, count(*) AS n, (count(*) - 1) * max(bytes) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ids
            FROM members GROUP BY p, d),
        kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
        sums AS (
            SELECT p[1:a] AS p, a AS d, sum(saved) AS saved, count(*) FILTER (k IS NULL) AS leaves
            FROM (SELECT n.p, n.saved, kids.k, unnest(range(0, n.d + 1)) AS a FROM nodes n LEFT JOIN kids USING (p, d)) GROUP BY ALL)
        SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children,
            CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ids AS ends_sha256
        FROM nodes n JOIN sums USING (p, d) LEFT JOIN kids USING (p, d) LEFT JOIN nodes up ON up.p = n.p[1:n.d - 1] AND up.d = n.d - 1
    """,
    "op13_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang AS part, {_leaf()} AS h, CASE WHEN {_CRC.format(n="doc_id")} % 7 = 0 THEN {_leaf(n_chars="n_chars + 1")} ELSE {_leaf()} END AS touched FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM d),
        tree AS ({_TREE.format(rows="r", name="tree")}),
        sub AS (SELECT part AS lang, 0 AS part, h, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS ({_TREE.format(rows="sub", name="top")}),
        root AS (SELECT h AS root FROM top WHERE n = 1),
        low AS (
            SELECT r.part, r.i, string_agg(t.h, '' ORDER BY t.l) AS s FROM r JOIN tree t ON t.part IS NOT DISTINCT FROM r.part AND t.i = xor(r.i >> t.l, 1) AND t.n > 1 GROUP BY ALL),
        high AS (SELECT sub.lang, string_agg(t.h, '' ORDER BY t.l) AS s FROM sub JOIN top t ON t.i = xor(sub.i >> t.l, 1) AND t.n > 1 GROUP BY ALL),
        start AS (SELECT part, i, n, touched AS h FROM r),
        fold AS ({_FOLD.format(rows="start", name="fold", tree="tree")}),
        -- the rows of a language meet again in its subroot's place; i tells them apart there
        mid AS (SELECT fold.part AS lang, fold.i AS leaf_i, sub.i, sub.n, fold.h, 0 AS l FROM fold JOIN sub ON sub.lang IS NOT DISTINCT FROM fold.part WHERE fold.n = 1),
        climb AS (
            SELECT lang, leaf_i, i, n, h, l FROM mid
            UNION ALL SELECT f.lang, f.leaf_i, f.i, (f.n + 1) // 2, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN (f.i >> f.l) & 1 = 1 THEN t.h || f.h ELSE f.h || t.h END), f.l + 1
            FROM climb f LEFT JOIN top t ON t.l = f.l AND t.i = xor(f.i >> f.l, 1) WHERE f.n > 1)
        SELECT r.doc_id, r.h AS leaf, sub.h AS subroot, root, sha256(coalesce(low.s, '') || coalesce(high.s, '')) AS proof_sha256,
            c.h AS folded_root, c.h = root AS verified
        FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.part CROSS JOIN root
            JOIN climb c ON c.n = 1 AND c.lang IS NOT DISTINCT FROM r.part AND c.leaf_i = r.i
            LEFT JOIN low ON low.part IS NOT DISTINCT FROM r.part AND low.i = r.i LEFT JOIN high ON high.lang IS NOT DISTINCT FROM r.part
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM o
    """,
    "op5_line_dedup": r"""
        WITH o AS (
            SELECT doc_id, i, s[i] AS line FROM (
                SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
            WHERE regexp_matches(s[i], '[^\x20\x09-\x0D]')),
        f AS (
            SELECT line, min(doc_id * 1000000 + i) AS place, length(line) AS n FROM o GROUP BY line),
        late AS (
            SELECT b.line FROM f a JOIN f b
            ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.place < b.place AND a.n >= 40 AND b.n >= 40
            AND (contains(b.line, left(a.line, a.n // 3)) OR contains(b.line, right(a.line, a.n // 3))
                OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n - 2 * (a.n // 3))))
            AND levenshtein(a.line, b.line) <= 2
            UNION SELECT if(a.place < b.place, b.line, a.line) FROM f a JOIN f b
            ON a.n BETWEEN b.n - 1 AND b.n AND a.n < 40 AND (a.n < b.n OR a.place < b.place) AND a.line <> b.line
            AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2))
            AND len(list_filter(range(0, b.n), lambda p: left(a.line, p) = left(b.line, p)
                AND substr(a.line, p + 2 - (b.n - a.n)) = substr(b.line, p + 2))) > 0),
        l AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id),
        g AS (
            SELECT place // 1000000 AS doc_id, count(*) AS n, count(late.line) AS near
            FROM f LEFT JOIN late ON late.line = f.line GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
            CAST(coalesce(l.n, 0) - coalesce(g.n, 0) AS BIGINT) AS n_exact,
            CAST(coalesce(g.near, 0) AS BIGINT) AS n_near,
            CAST(coalesce(g.n, 0) - coalesce(g.near, 0) AS BIGINT) AS n_kept
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
    "op9_decontamination": f"""
        WITH d AS ({_GRAMS.format(id="doc_id", table="documents", widths="[1, 2, 3, 4, 5]")}),
        b AS ({_GRAMS.format(id="item_id", table="benchmark", widths="[least(len(w), 5)]")}),
        sizes AS (SELECT id, count(*) AS size FROM b GROUP BY id),
        pairs AS (
            SELECT d.id AS doc_id, b.id AS item_id FROM d JOIN b USING (gram) JOIN sizes ON sizes.id = b.id
            GROUP BY d.id, b.id, size HAVING 100 * count(*) >= 80 * size),
        lists AS (
            SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids
            FROM pairs GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_items, coalesce(ids, '') AS item_ids,
            n IS NOT NULL AS contaminated
        FROM documents LEFT JOIN lists USING (doc_id)
    """,
}
