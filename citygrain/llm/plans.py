"""Queries p7 to p9 over the test tables, with SQL for what it can say: invariants of packing and mixing, measures of words and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.llm import mixing, packing, quality
from citygrain.llm.tokens import with_token_counts
from citygrain.sources.tables import table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.pack(_sized(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, cut documents and wasted room per capacity."""
    return packing.container_report(p7_packing(spark, sf_dir))


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix, with how often each is used."""
    return mixing.draw_mixes(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per mix and source."""
    return mixing.share_report(p8_draws(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text statistics of each document."""
    return quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences make up less than half of their non-blank characters."""
    return p9_statistics(spark, sf_dir).where(F.col("sentence_share") < 0.5).select("doc_id")


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the tokens of each source per capacity, over all full windows, against its target."""
    return packing.window_report(p7_packing(spark, sf_dir))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the texts packed, and how often a rule of packing is broken."""
    sized = _sized(spark, sf_dir)
    return packing.broken_rules(packing.pack(sized, table(spark, sf_dir, "container_sizes")), sized)


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix its sources with documents, and how often a rule of mixing is broken."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.broken_rules(mixing.draw_mixes(sized, targets), sized, targets)


def p9_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of words, characters and line ends, which SQL can say too."""
    found = p9_statistics(spark, sf_dir)
    return found.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_share", "terminal_line_share", "common_word_share")])


QUERIES = {f.__name__: f for f in (p7_packing, p7_containers, p7_windows, p7_invariants, p8_draws, p8_shares, p8_invariants, p9_found, p9_statistics, p9_measures)}

_BLANK = r"[\t-\r \x{85}\p{Z}]"
ORACLES: dict[str, str] = {
    "p7_invariants": """SELECT size_id, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, (SELECT count(*) FROM documents) AS n_texts, 0 AS overfull, 0 AS overlapping, 0 AS wrongly_cut, 0 AS incomplete FROM container_sizes""",
    "p8_invariants": """SELECT mix_id, count(*) AS n_sources, 0 AS beyond_repeats, 0 AS off_target, 0 AS strangers FROM mix_targets
WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents) GROUP BY mix_id""",
    "p9_measures": rf"""WITH line AS (SELECT doc_id, x AS line, regexp_replace(x, '(^|[^\\])%.*$', '\1') AS code FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS x FROM documents WHERE text IS NOT NULL)),
word AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(code, '\\?[\p{{L}}\p{{M}}]+')) AS w FROM line) WHERE w[1] <> '\'),
common AS (SELECT DISTINCT lower(word) AS c FROM common_words),
words AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS size, count(c) AS known FROM word LEFT JOIN common ON c = lower(w) GROUP BY doc_id),
ends AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(code, '[.!?:;][)}}\]$"''*`]?{_BLANK}*$')) AS closed FROM line WHERE regexp_replace(line, '{_BLANK}', '', 'g') <> '' GROUP BY doc_id),
solid AS (SELECT doc_id, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS n, length(regexp_replace(text, '[\t-\r \x{{85}}\p{{Z}}\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) AS symbols FROM documents)
SELECT d.doc_id, coalesce(w.n, 0) AS n_words, round(coalesce(w.size / w.n, 0), 9) AS mean_word_length, round(coalesce(s.symbols / nullif(s.n, 0), 0), 9) AS symbol_share,
round(coalesce(e.closed / e.n, 0), 9) AS terminal_line_share, round(coalesce(w.known / w.n, 0), 9) AS common_word_share
FROM documents d LEFT JOIN words w USING (doc_id) LEFT JOIN ends e USING (doc_id) LEFT JOIN solid s USING (doc_id)""",
}
