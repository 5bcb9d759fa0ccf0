"""The queries over these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hardneg, htmltext, linededup, pieces, pii, quality, sharding, simhash, sketch, tokenalign, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_report(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "matched", "start")).alias("b")).select("doc_id", "item_id", "b.*")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.alignment_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mined(hardneg.turned(table(spark, sf_dir, "embeddings")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _url_sql() -> str:
    rest = "url, '(?s)^.*?://([^/?#]*)([^?#]*)'"
    order = [(h, p, h + p, v) for h, p, v in urlfilter.RULES]
    order.sort(key=lambda r: (-len(r[2]), r[2]))
    fit = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'" for h, p, r, _ in order)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for _, _, r, v in order)

    def hits(terms) -> str:
        # the letters and digits of a url, one space between their runs, so that a term stands alone where spaces do
        return "(" + " + ".join(f"CAST(contains(low, ' {t} ') AS INTEGER)" for t in terms) + ")"

    low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract({rest}, 1), ''), '{low}', '{low.lower()}') AS host, coalesce(regexp_extract({rest}, 2), '') AS path FROM pages),
      r AS (SELECT *, CASE {fit} END AS rule, ' ' || regexp_replace(lower(url_decode(coalesce(url, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS low FROM u),
      n AS (SELECT *, {hits(urlfilter.STRICT)} AS n_strict, {hits(urlfilter.SOFT)} AS n_soft FROM r)
      SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN n_strict >= 1 OR n_soft >= {urlfilter.SOFT_HITS} THEN 'block' ELSE 'allow' END END AS verdict, n_strict, n_soft FROM n"""


def _warc_sql() -> str:
    return f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
      f AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _line_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    white = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
      k AS (SELECT *, translate(trim(line, {white}), '{upper}', '{upper.lower()}') AS key FROM l),
      f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {linededup.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
      m AS (SELECT k.*, coalesce(f.first <> k.doc_id, false) AS lost FROM k LEFT JOIN f ON k.key = f.key)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def _negative_sql() -> str:
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({hardneg.SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
      p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hardneg.POSITIVES})
      SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND {hardneg.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {hardneg.HIGH} * positive_score
      WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= {hardneg.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; tests hold the others against brute force."""
    return {"op8_warc": _warc_sql(), "op10_url_filter": _url_sql(), "op12_hard_negatives": _negative_sql(), "op13_line_dedup": _line_sql()}
