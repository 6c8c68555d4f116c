"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.link_trust import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op2_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.arrow_tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op3_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.unigram_pieces import encode_pieces

    docs = table(spark, sf_dir, "documents")
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.backoff_automaton import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.kneser_ney import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op9_recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_blocks import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.learned_partitions import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op11_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.positive_unlabelled import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.piece_table import fill_in_middle, restored

    digests = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restored(fill_in_middle(table(spark, sf_dir, "documents")), keep=digests, with_text=False)


def op13_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.max_sketches import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_link_trust": op1_link_trust,
    "op2_arrow_tokens": op2_arrow_tokens,
    "op3_unigram_pieces": op3_unigram_pieces,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_backoff_automaton": op6_backoff_automaton,
    "op7_warc_segments": op7_warc_segments,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_recurrent_blocks": op9_recurrent_blocks,
    "op10_learned_partitions": op10_learned_partitions,
    "op11_positive_unlabelled": op11_positive_unlabelled,
    "op12_piece_table": op12_piece_table,
    "op13_max_sketches": op13_max_sketches,
}


def _link_trust_sql(steps: int = 57) -> str:
    """The walks of ``op1_link_trust``, unrolled to the most steps that its tolerance allows."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    host = lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    target = lower.format(r"regexp_replace(regexp_replace(t, '^.*@', ''), ':[0-9]*$', '')")
    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", v, h + p) for v, h, p in rules]
    case = lambda at: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[at]}'" for f in fits) + " END"
    walk = [f"""s{n} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
        SELECT e.kind, e.b AS host, s.score * e.share AS score FROM s{n - 1} s JOIN e ON e.kind = s.kind AND e.a = s.host
        UNION ALL SELECT * FROM s0) GROUP BY 1, 2)""" for n in range(1, steps + 1)]
    return f"""
        WITH u AS (SELECT page_id, html, coalesce({host}, '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, {case(1)} AS ruled, {case(2)} AS rule FROM u),
        k AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust,
              avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust FROM r WHERE host <> '' GROUP BY 1),
        l AS (SELECT host AS src, {target} AS dst FROM (
              SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM r WHERE host <> '')),
        g AS (SELECT src, dst, count(*) AS n FROM l WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
        d AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM g UNION ALL SELECT 'distrust', dst, src, n FROM g),
        e AS MATERIALIZED (SELECT kind, a, b, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY kind, a) AS share FROM d),
        s0 AS MATERIALIZED (SELECT 'trust' AS kind, host, (1 - 0.85::DOUBLE) * trust AS score FROM k WHERE trust > 0
               UNION ALL SELECT 'distrust', host, (1 - 0.85::DOUBLE) * distrust FROM k WHERE distrust > 0),
        {", ".join(walk)},
        h AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust,
              coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s{steps} GROUP BY 1)
        SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
        FROM r LEFT JOIN h ON h.host = r.host"""


#: DuckDB SQL of the queries that SQL can express.
STATEMENTS = {
    "op1_link_trust": _link_trust_sql(),
    "op7_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        t AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to,
               TRUE AS complete
        FROM d LEFT JOIN t USING (payload_digest)""",
    "op12_piece_table": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
              ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
              least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
        p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_max_sketches": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        c AS (SELECT count(DISTINCT r)::BIGINT AS documents, count(*)::BIGINT AS terms FROM w),
        t AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY r, term),
        l AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
        i AS (SELECT DISTINCT * FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        d AS (SELECT term, count(*)::BIGINT AS df FROM t WHERE term IN (SELECT term FROM i) GROUP BY term),
        s AS (SELECT q, i.item_id, t.r, t.doc_id,
              sum(floor(1000 * ln((2.0::DOUBLE * c.documents + 2) / (2.0::DOUBLE * df + 1)))::BIGINT
                  * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c.documents) // c.terms))))::BIGINT AS score
              FROM i JOIN d USING (term) JOIN t USING (term) JOIN l USING (r), c GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}


def statements() -> dict[str, str]:
    return dict(STATEMENTS)
