"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import license_scan, substring_dedup, suffix_dedup
from wardlight.llm.fingerprints import fingerprints
from wardlight.llm.fingerprints import near_duplicates as band_join
from wardlight.llm.license_scan import license_columns
from wardlight.llm.line_dedup import EXACT_CHARS, dedup_digests
from wardlight.llm.lm_scoring import train_and_score
from wardlight.llm.mixing import mix
from wardlight.llm.ngram_join import near_duplicates
from wardlight.llm.packing import packed_documents
from wardlight.llm.quality_rules import BOILERPLATE, MAX_LOST, MAX_REPEAT_PERCENT, MIN_WORDS, SHORT_LINE, SYMBOLS, quality_columns
from wardlight.llm.shared import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir), order=3)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(documents(spark, sf_dir), shortest=EXACT_CHARS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_columns(documents(spark, sf_dir))
    return out.select("doc_id", "license", "license_kind", F.array_join("licenses", ",").alias("licenses"), F.array_join("license_sentences", ",").alias("sentence_ids"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_columns(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_share", F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(documents(spark, sf_dir))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by classes of near copies: bands of the fingerprints' signatures joined, pairs verified."""
    return band_join(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_fingerprints, op3_lm_scoring, op4_line_dedup, op5_mixing, op6_license_scan, op7_suffix_dedup, op8_packing, op9_quality_rules, op10_substring_dedup, fingerprint_classes)}
ORACLE: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE["op10_substring_dedup"] = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM ranked, (SELECT unnest(range(0, 20)) AS j) WHERE n > 1),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prior IS NULL OR prior < pos - 1) AS n_spans FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM gone) GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS t FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) AS w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos WHERE g.pos IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
ORACLE["op9_quality_rules"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (SELECT unnest(range(0, 3)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, line, i, lower(line) AS low, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d)),
judged AS (SELECT doc_id, line, i, len(w) AS n,
  len(list_filter(w, lambda x: regexp_full_match(x, '[|>»·•/\\~-]+'))) > 0.2 * len(w)
  OR len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&<>]{{2,}}[.,]?|!!+)$'))) > 0.3 * len(w)
  OR {_PHRASES}
  OR (NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}') AND len(w) >= 5)
  OR (NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '[.,;:!?]') AND len(w) < {SHORT_LINE}) AS fails
  FROM lines WHERE len(w) > 0),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
clean AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM lines l LEFT JOIN judged j ON j.doc_id = l.doc_id AND j.i = l.i WHERE NOT coalesce(fails, false) GROUP BY l.doc_id),
base AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, sha256(coalesce(clean.t, '')) AS clean_sha256, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(d.t) - length(translate(d.t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines,
  CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(coalesce(lost, 0) AS DOUBLE) / len(words) END AS lost_share
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN clean ON clean.doc_id = d.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_share <= {MAX_LOST} AS kept FROM base"""


def _license_sql() -> str:
    """The scan without looking around: every separator stands twice, so that a sentence can take one on each side."""
    mark, listed = license_scan.MARK, [*license_scan.SENTENCES.items(), *license_scan.VARIANTS]
    spelled = [(s, f"[ {mark}]{{2}}".join(s.split())) for _, s in listed]
    long, short = ("|".join(p for s, p in spelled if (len(s.split()) >= license_scan.LONG) == x) for x in (True, False))
    start = license_scan.SENTENCE_START.replace("(?=[\\x20\\x09])", "[\\x20\\x09]")
    known = ", ".join(f"'{s}': '{i}'" for i, s in listed)
    names = list(dict.fromkeys(n for n, _, _ in license_scan.RULES))
    met = {r: f"regexp_matches(ids, ' {' (?:[^ ]+ )*'.join(r[2])} ')" for r in license_scan.RULES}
    firsts = [" ".join(f"WHEN {met[r]} THEN '{r[k]}'" for r in license_scan.RULES) for k in (0, 1)]
    lists = ", ".join(f"CASE WHEN {' OR '.join(met[r] for r in license_scan.RULES if r[0] == n)} THEN '{n}' END" for n in names)
    return f"""WITH marked AS (SELECT doc_id, regexp_replace(chr(10) || lower(coalesce(text, '')) || chr(10), '{start}', '{mark}', 'g') AS t FROM documents),
spaced AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}{mark}]+', ' ', 'g'), ' ?{mark}[ {mark}]*', '{mark}', 'g'), '([ {mark}])', '\\1\\1', 'g') AS t FROM marked),
found AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?:[ {mark}](?:{long})|{mark}(?:{short}))[ {mark}]'), lambda x: trim(regexp_replace(x, '[ {mark}]+', ' ', 'g'))) AS s FROM spaced),
named AS (SELECT doc_id, list_transform(s, lambda x: MAP {{{known}}}[x]) AS l FROM found),
ruled AS (SELECT doc_id, l, ' ' || array_to_string(l, ' ') || ' ' AS ids FROM named)
SELECT doc_id, CASE {firsts[0]} END AS license, CASE {firsts[1]} END AS license_kind,
  array_to_string(list_filter([{lists}], lambda x: x IS NOT NULL), ',') AS licenses, array_to_string(l, ',') AS sentence_ids FROM ruled"""


ORACLE["op6_license_scan"] = _license_sql()
