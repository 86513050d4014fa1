"""SQL for the queries that SQL can express, written on its own terms: other formulas and plans where there is a choice."""

from __future__ import annotations

import re

from voxloom.functions.lexicon import DEVICES, ENGLISH, FRENCH, LEXICONS, PASSAGE_DEVICES, markers, preferences

_U = """u AS (SELECT utt_id, speaker_id, recording_id, "index", "start", text, replace(lower(text), '’', '''') AS norm
  FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at) AS d FROM utterances) WHERE d = 1 AND text IS NOT NULL)"""
_W = """p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at) AS d FROM parsed) WHERE d = 1),
w0 AS (SELECT utt_id, speaker_id, recording_id, unnest(words) AS raw, generate_subscripts(words, 1) - 1 AS pos FROM p1),
w AS (SELECT utt_id, speaker_id, recording_id, pos, regexp_replace(replace(lower(raw), '’', ''''), '^-+', '') AS w FROM w0
  WHERE regexp_matches(regexp_replace(replace(lower(raw), '’', ''''), '^-+', ''), '\\p{L}'))"""


def _lang(code: str) -> str:
    names = {"fr": "'fr','french','français','fra','fre'", "en": "'en','english','eng'"}
    other = "fr"
    case = " ".join(f"WHEN lower(trim(language)) IN ({names[c]}) OR regexp_split_to_array(lower(trim(language)), '[-_ ]')[1] IN ({names[c]}) THEN '{c}'" for c in (other, "en"))
    return f"l AS (SELECT recording_id FROM (SELECT recording_id, min(CASE {case} END) AS lang FROM transcripts GROUP BY 1) WHERE lang = '{code}')"


def _standalone_count(column: str, words: list[str]) -> str:
    """Occurrences of words that stand alone, without look-around: separators are doubled, so neighbours never share one."""
    inner = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}''’"
    doubled = f"regexp_replace(' ' || {column} || ' ', '([^{inner}])', '\\1\\1', 'g')"
    alternatives = "|".join(_escape(w) for w in words)
    return f"len(regexp_extract_all({doubled}, '[^{inner}](?:{alternatives})[^{inner}]'))"


def _escape(word: str) -> str:
    out = word.replace("'", "''")
    for separator in " -":
        out = out.replace(separator, separator * 2)
    return out


SQL: dict[str, str] = {}
SQL["agg2_corpus_totals"] = f"""WITH {_W} SELECT speaker_id, count(DISTINCT recording_id) AS recordings, count(DISTINCT utt_id) AS utterances, count(*) AS words, count(DISTINCT w) AS types FROM w GROUP BY 1"""
SQL["agg3_word_counts"] = f"""WITH {_W} SELECT speaker_id, w, count(*) AS count, count(DISTINCT recording_id) AS recordings FROM w GROUP BY 1, 2"""
SQL["agg7_mattr"] = f"""WITH {_W}, s AS (SELECT speaker_id, w, row_number() OVER (PARTITION BY speaker_id ORDER BY utt_id, pos) - 1 AS j, count(*) OVER (PARTITION BY speaker_id) AS n FROM w),
t AS (SELECT *, coalesce(lag(j) OVER (PARTITION BY speaker_id, w ORDER BY j), -1) AS p FROM s),
g AS (SELECT speaker_id, max(n) AS words, count(DISTINCT w) AS types, sum(greatest(0, least(j, n - 100) - greatest(p + 1, j - 99, 0) + 1)) AS ds FROM t GROUP BY 1)
SELECT speaker_id, words, CAST(CASE WHEN words >= 100 THEN ds ELSE types END AS BIGINT) AS distinct_sum, round(CASE WHEN words >= 100 THEN ds::DOUBLE / (words - 99) / 100 ELSE types::DOUBLE / words END, 3) AS mattr FROM g"""
_RATED = f"""{_W}, b AS (SELECT w, count(*)::DOUBLE / (SELECT count(*) FROM w) AS freq FROM w GROUP BY 1),
z AS (SELECT speaker_id, count(*) AS n, count(DISTINCT recording_id) AS nr FROM w GROUP BY 1),
c AS (SELECT speaker_id, w, count(*) AS count, count(DISTINCT recording_id) AS recordings, min(utt_id * 1000000 + pos) AS first FROM w GROUP BY 1, 2),
r AS (SELECT c.*, nr, round(1000.0::DOUBLE * count / n, 2) AS per_1k, round(1000 * freq, 3) AS baseline_per_1k, round(log2(count::DOUBLE / n / freq), 2) AS log2_ratio
  FROM c JOIN z USING (speaker_id) JOIN b USING (w) WHERE count >= 3 AND length(w) >= 2 AND regexp_matches(replace(w, '''', ''), '^[\\p{{L}}\\p{{M}}]+$'))"""
SQL["agg8_log_ratios"] = f"WITH {_RATED} SELECT speaker_id, w, count, per_1k, baseline_per_1k, log2_ratio, recordings FROM r"
SQL["agg9_distinctive_words"] = f"""WITH {_RATED} SELECT speaker_id, CAST(rank AS INTEGER) AS rank, w, count, log2_ratio, recordings FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY log2_ratio DESC, first) AS rank FROM r
  WHERE log2_ratio > 1 AND recordings >= least(2, nr)) WHERE rank <= 20"""
SQL["agg10_underused_words"] = f"""WITH {_RATED} SELECT speaker_id, CAST(rank AS INTEGER) AS rank, w, count, log2_ratio FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY log2_ratio, first) AS rank FROM r
  WHERE baseline_per_1k >= 1 AND log2_ratio < -1 AND regexp_matches(w, '^[\\p{{L}}\\p{{M}}]+$')) WHERE rank <= 10"""
_PRONOUNS = ", ".join(f"({k}, '{p}')" for k, p in enumerate(ENGLISH.pronouns))
SQL["agg11_pronouns"] = f"""WITH {_lang("en")}, {_W}, e AS (SELECT w.* FROM w SEMI JOIN l USING (recording_id)), pr(ord, pronoun) AS (VALUES {_PRONOUNS}),
z AS (SELECT speaker_id, count(*) AS n FROM e GROUP BY 1), c AS (SELECT speaker_id, w AS pronoun, count(*) AS k FROM e GROUP BY 1, 2),
b AS (SELECT w AS pronoun, count(*)::DOUBLE / (SELECT count(*) FROM e) AS freq FROM e GROUP BY 1)
SELECT speaker_id, ord, pronoun, coalesce(k, 0) AS count, round(1000.0::DOUBLE * coalesce(k, 0) / n, 2) AS per_1k, round(1000 * freq, 2) AS baseline_per_1k
FROM z CROSS JOIN pr LEFT JOIN c USING (speaker_id, pronoun) LEFT JOIN b USING (pronoun)"""
_LEN = f"{_W}, n AS (SELECT speaker_id, utt_id, count(*) AS len FROM w GROUP BY 1, 2)"
SQL["agg12_length_stats"] = f"""WITH {_LEN}, a AS (SELECT speaker_id, count(*) AS utterances, list_sort(list(len)) AS d, avg(len) AS mean, median(len) AS median, avg((len >= 13)::INT) AS long_share, avg((len <= 7)::INT) AS short_share, stddev_pop(len) AS sd FROM n GROUP BY 1),
q AS (SELECT *, greatest(1, least((utterances + 1) // 10, utterances - 1)) AS j1, greatest(1, least((utterances + 1) * 9 // 10, utterances - 1)) AS j9 FROM a)
SELECT speaker_id, utterances, round(mean, 1) AS mean, median, CASE WHEN utterances >= 10 THEN round((d[j1] * (10 - (utterances + 1 - 10 * j1)) + d[j1 + 1] * (utterances + 1 - 10 * j1)) / 10, 4) END AS p10,
CASE WHEN utterances >= 10 THEN round((d[j9] * (10 - ((utterances + 1) * 9 - 10 * j9)) + d[j9 + 1] * ((utterances + 1) * 9 - 10 * j9)) / 10, 4) END AS p90,
round(long_share, 3) AS long_share, round(short_share, 3) AS short_share, round(sd / mean, 2) AS cv FROM q"""
SQL["agg13_length_histogram"] = f"""WITH {_LEN}, b(bin, words, lo, hi) AS (VALUES (0, '1-3', 1, 3), (1, '4-7', 4, 7), (2, '8-12', 8, 12), (3, '13-20', 13, 20), (4, '21-35', 21, 35), (5, '36+', 36, 1000000)),
t AS (SELECT speaker_id, count(*) AS k FROM n GROUP BY 1)
SELECT t.speaker_id, bin, words, count(n.len) AS count, round(count(n.len)::DOUBLE / max(k), 3) AS share FROM t CROSS JOIN b LEFT JOIN n ON n.speaker_id = t.speaker_id AND len BETWEEN lo AND hi GROUP BY 1, 2, 3"""
_FIRST = f"""{_W}, o AS (SELECT speaker_id, utt_id, w, row_number() OVER (PARTITION BY utt_id ORDER BY pos) AS k FROM w),
f AS (SELECT speaker_id, utt_id, max(CASE WHEN k = 1 THEN w END) AS a, max(CASE WHEN k = 2 THEN w END) AS b FROM o GROUP BY 1, 2), t AS (SELECT speaker_id, count(*) AS n FROM f GROUP BY 1)"""
SQL["agg16_openings"] = f"""WITH {_FIRST}, c AS (SELECT speaker_id, a AS words, count(*) AS count, min(utt_id) AS first_at FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY count DESC, first_at) AS rank FROM c)
SELECT speaker_id, CAST(rank AS INTEGER) AS rank, words, count, round(count::DOUBLE / n, 3) AS share FROM r JOIN t USING (speaker_id) WHERE rank <= 12"""
_JOINED = """CASE WHEN right(a, 1) IN ('''', '’') OR regexp_matches(b, '^[''’][\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]') OR regexp_matches(b, '^n''t([^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]|$)') THEN a || b ELSE a || ' ' || b END"""
SQL["agg17_opening_bigrams"] = f"""WITH {_FIRST}, c AS (SELECT speaker_id, {_JOINED} AS words, count(*) AS count, min(utt_id) AS first_at FROM f WHERE b IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY count DESC, first_at) AS rank FROM c)
SELECT speaker_id, CAST(rank AS INTEGER) AS rank, words, count, round(count::DOUBLE / n, 3) AS share FROM r JOIN t USING (speaker_id) WHERE rank <= 10"""
_TAGS = ENGLISH.tags.replace("'", "''")
SQL["agg18_questions"] = f"""WITH {_U}, {_lang("en")}, e AS (SELECT * FROM u SEMI JOIN l USING (recording_id)),
q AS (SELECT speaker_id, rtrim(text, ' ') LIKE '%?' AS asks, regexp_matches(norm, '{_TAGS}') AS tag FROM e)
SELECT speaker_id, count(*) AS utterances, CAST(sum(asks::INT) AS BIGINT) AS questions, CAST(sum((asks AND tag)::INT) AS BIGINT) AS tag_questions, round(avg(asks::INT), 3) AS share FROM q GROUP BY 1"""
SQL["win2_question_examples"] = f"""WITH {_U}, {_lang("en")}, q AS (SELECT *, CASE WHEN regexp_matches(norm, '{_TAGS}') THEN 'tag' ELSE 'other' END AS kind, len(list_filter(regexp_split_to_array(text, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')) BETWEEN 4 AND 30 AS ok FROM u SEMI JOIN l USING (recording_id) WHERE rtrim(text, ' ') LIKE '%?'),
r AS (SELECT *, min(utt_id) OVER (PARTITION BY speaker_id, kind, recording_id) AS f, row_number() OVER (PARTITION BY speaker_id, kind, recording_id ORDER BY NOT ok, "index", utt_id) AS rn FROM q),
s AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, kind, text ORDER BY rn, f) AS seen FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, kind ORDER BY rn, f) AS pick FROM s WHERE seen = 1)
SELECT speaker_id, kind, CAST(pick AS INTEGER) AS pick, recording_id, "index", text FROM t WHERE pick <= CASE WHEN kind = 'tag' THEN 4 ELSE 6 END"""
SQL["agg22_signature_phrases"] = f"""WITH p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at) AS d FROM parsed) WHERE d = 1),
a AS (SELECT speaker_id, recording_id, list_filter(list_transform(words, lambda x: regexp_replace(replace(lower(x), '’', ''''), '^-+', '')), lambda x: regexp_matches(x, '\\p{{L}}')) AS ws FROM p1),
g AS (SELECT speaker_id, recording_id, unnest(flatten([list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: ws[i:i + n - 1]) for n in [3, 4, 5]])) AS g FROM a),
z AS (SELECT speaker_id, count(DISTINCT recording_id) AS nr FROM a WHERE len(ws) > 0 GROUP BY 1),
k AS (SELECT speaker_id, g, count(*) AS count, count(DISTINCT recording_id) AS recordings FROM g GROUP BY 1, 2 HAVING count(*) >= 3),
kept AS (SELECT k.* FROM k JOIN z USING (speaker_id) WHERE recordings >= least(2, nr)),
parts AS (SELECT speaker_id, count AS c, unnest(flatten([list_transform(range(1, greatest(len(g) - n + 2, 1)), lambda i: g[i:i + n - 1]) for n in [3, 4]])) AS part, len(g) AS size FROM kept WHERE len(g) > 3),
longest AS (SELECT speaker_id, part AS g, max(c) AS c FROM parts WHERE len(part) < size GROUP BY 1, 2),
r AS (SELECT kept.*, row_number() OVER (PARTITION BY kept.speaker_id ORDER BY count * len(kept.g) DESC, kept.g) AS rank FROM kept LEFT JOIN longest ON kept.speaker_id = longest.speaker_id AND kept.g = longest.g WHERE longest.c IS NULL OR longest.c < 0.8 * count)
SELECT speaker_id, CAST(rank AS INTEGER) AS rank, regexp_replace(regexp_replace(regexp_replace(array_to_string(g, ' '), '([''’]) ', '\\1', 'g'), ' ([''’][\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}])', '\\1', 'g'), ' (n''t)([^\\p{{L}}\\p{{M}}\\p{{Nd}}]|$)', '\\1\\2', 'g') AS phrase, count, recordings FROM r WHERE rank <= 40"""
_EMPH, _OK = (", ".join(f"'{x}'" for x in sorted(s)) for s in (ENGLISH.emphatic, ENGLISH.repeat_ok))
SQL["agg23_repeats"] = f"""WITH {_U}, {_lang("en")}, t AS (SELECT speaker_id, utt_id, list_transform(regexp_extract_all(norm, '[\\p{{L}}\\p{{M}}\\p{{N}}''’-]+|[^\\s\\x0b\\p{{Z}}]'), lambda x: regexp_replace(x, '^-+', '')) AS k FROM u SEMI JOIN l USING (recording_id)),
e AS (SELECT speaker_id, k, unnest(range(1, len(k))) AS i FROM t WHERE len(k) >= 2),
r AS (SELECT speaker_id, k[i] AS word, 2 + len(list_filter(k[i + 2:i + 5], lambda x: x = k[i])) AS run FROM e WHERE k[i] = k[i + 1] AND regexp_matches(k[i], '\\p{{L}}') AND k[i] NOT IN ({_OK}))
SELECT speaker_id, CASE WHEN word IN ({_EMPH}) OR run >= 3 THEN 'emphatic' ELSE 'stutter' END AS kind, word, count(*) AS count, CAST(max(run) AS INTEGER) AS longest FROM r GROUP BY 1, 2, 3"""
SQL["agg27_address"] = f"""WITH {_U}, {_lang("en")}, {_W}, z AS (SELECT speaker_id, count(*) AS words FROM w SEMI JOIN l USING (recording_id) GROUP BY 1),
c AS (SELECT speaker_id, CAST(sum({_standalone_count("norm", ENGLISH.address.split("/"))}) AS BIGINT) AS count FROM u SEMI JOIN l USING (recording_id) GROUP BY 1)
SELECT speaker_id, count, round(1000.0::DOUBLE * count / words, 2) AS per_1k FROM c JOIN z USING (speaker_id)"""
SQL["flt1_kept_words"] = """WITH t AS (SELECT recording_id, segments FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY created_at DESC, loaded_at DESC) AS d FROM transcripts WHERE segments IS NOT NULL) WHERE d = 1),
s AS (SELECT recording_id, unnest(segments) AS s FROM t), x AS (SELECT recording_id, unnest(s.words) AS w FROM s WHERE NOT coalesce(s.no_speech_prob > 0.8 AND s.avg_logprob < -1.0, false)),
c AS (SELECT recording_id, count(*) AS n, sum(length(w.word)) AS letters FROM x WHERE w.word <> '' AND w.word <> '...' GROUP BY 1)
SELECT recording_id, CAST(coalesce(n, 0) AS INTEGER) AS words, CAST(coalesce(letters, 0) AS BIGINT) AS letters FROM t LEFT JOIN c USING (recording_id)"""
SQL["seg1_hard_breaks"] = """WITH t AS (SELECT recording_id, segments FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY created_at DESC, loaded_at DESC) AS d FROM transcripts WHERE segments IS NOT NULL) WHERE d = 1),
s AS (SELECT recording_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM t), x AS (SELECT recording_id, i, unnest(s.words) AS w, generate_subscripts(s.words, 1) AS j FROM s WHERE NOT coalesce(s.no_speech_prob > 0.8 AND s.avg_logprob < -1.0, false)),
k AS (SELECT recording_id, w, row_number() OVER (PARTITION BY recording_id ORDER BY i, j) - 1 AS pos FROM x WHERE w.word <> '' AND w.word <> '...'),
b AS (SELECT *, coalesce(right(w.word, 1) IN ('.', '?', '!', '…') OR lead(w."start") OVER (PARTITION BY recording_id ORDER BY pos) - w."end" > 0.5, false) AS brk FROM k),
g AS (SELECT *, coalesce(sum(brk::INT) OVER (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM b)
SELECT recording_id, CAST(island AS BIGINT) AS island, count(*) AS words, CAST(min(pos) AS INTEGER) AS first_pos FROM g GROUP BY 1, 2"""
SQL["agg29_corpus_stats"] = """SELECT speaker_id, CASE WHEN grouping(genre) = 0 THEN 'genre' WHEN grouping(register) = 0 THEN 'register' ELSE 'all' END AS kind, CASE WHEN grouping(genre) = 0 THEN genre WHEN grouping(register) = 0 THEN register ELSE '' END AS value,
count(*) AS recordings, round(sum(coalesce(duration_s, 0)), 2) AS total_s, CAST(sum(coalesce(multi_speaker, false)::INT) AS BIGINT) AS multi_speaker FROM recordings GROUP BY GROUPING SETS ((speaker_id), (speaker_id, genre), (speaker_id, register))"""
SQL["jn15_duplicate_content"] = """SELECT speaker_id, id, same_as FROM (SELECT *, row_number() OVER k AS n, first_value(id) OVER k AS same_as FROM recordings WHERE sha256 IS NOT NULL WINDOW k AS (PARTITION BY speaker_id, sha256 ORDER BY added_at, id)) WHERE n > 1"""
SQL["flt6_pending_recordings"] = """SELECT speaker_id, id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM transcripts t WHERE t.segments IS NOT NULL AND t.recording_id = r.id AND t.source_sha256 = r.sha256)"""
SQL["agg33_status"] = f"""WITH {_W}, rec AS (SELECT speaker_id, count(*) AS recordings, round(sum(coalesce(duration_s, 0)) / 60, 1) AS minutes, sum((id IN (SELECT recording_id FROM transcripts WHERE segments IS NOT NULL))::INT) AS transcribed FROM recordings GROUP BY 1)
SELECT s.id AS speaker_id, coalesce(recordings, 0) AS recordings, coalesce(minutes, 0.0) AS minutes, CAST(coalesce(transcribed, 0) AS BIGINT) AS transcribed, coalesce(k.words, 0) AS words, coalesce(a.n, 0) > 0 AS rhetoric, coalesce(v.g, 0) AS generations,
coalesce(k.words, 0) > 0 AS ready, coalesce(k.words, 0) > 0 AND coalesce(transcribed, 0) < coalesce(recordings, 0) AS stale FROM speakers s LEFT JOIN rec ON rec.speaker_id = s.id LEFT JOIN (SELECT speaker_id, count(*) AS words FROM w GROUP BY 1) k ON k.speaker_id = s.id
LEFT JOIN (SELECT speaker_id, count(*) AS n FROM annotations GROUP BY 1) a ON a.speaker_id = s.id LEFT JOIN (SELECT speaker_id, count(DISTINCT generation_id) AS g FROM versions GROUP BY 1) v ON v.speaker_id = s.id"""

_WS = "[\\s\\x{0b}\\x{85}\\p{Z}]"
_WORDY = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]"
SQL["seg4_text_utterances"] = f"""WITH m AS (SELECT version_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([.?!…]){_WS}+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda x: regexp_matches(x, '{_WORDY}'))) AS part,
  generate_subscripts(list_filter(regexp_split_to_array(regexp_replace(text, '([.?!…]){_WS}+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda x: regexp_matches(x, '{_WORDY}')), 1) - 1 AS i FROM versions WHERE text IS NOT NULL),
a AS (SELECT version_id, i, regexp_replace(regexp_replace(part, '{_WS}+([''’-])', '\\1', 'g'), '([''’]){_WS}+', '\\1', 'g') AS t FROM m)
SELECT version_id, CAST(i AS INTEGER) AS index, trim(regexp_replace(regexp_replace(regexp_replace(t, '{_WS}+([,.;:…])', '\\1', 'g'), '{_WS}+([?!])', '\\1', 'g'), '{_WS}+', ' ', 'g')) AS text FROM a"""
SQL["ctl5_catalogue_problems"] = """SELECT speaker_id, id, 'duplicate id' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, id ORDER BY added_at) AS n FROM recordings) WHERE n > 1
UNION ALL SELECT speaker_id, id, 'same content' FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, sha256 ORDER BY added_at, id) AS n FROM recordings WHERE sha256 IS NOT NULL) WHERE n > 1
UNION ALL SELECT speaker_id, id, 'unknown genre' FROM recordings WHERE genre IS NULL OR genre NOT IN ('speech', 'lecture', 'interview', 'podcast', 'conversation', 'debate', 'monologue', 'other')
UNION ALL SELECT speaker_id, id, 'unknown register' FROM recordings WHERE register IS NULL OR register NOT IN ('scripted', 'prepared', 'spontaneous')"""


def _plain_markers(lang: str) -> list[tuple[str, str, list[str]]]:
    """Markers that are only words standing alone; the others need look-around."""
    return [(c, label, form.split("/")) for c, label, form in markers(LEXICONS[lang]) if not set("^{|\\") & set(form)]


def _marker_sql(lang: str) -> str:
    counts = " UNION ALL ".join(f"SELECT speaker_id, recording_id, '{c}' AS category, '{_quote(label)}' AS marker, {_standalone_count('norm', ws)} AS n FROM e" for c, label, ws in _plain_markers(lang))
    return f"""WITH {_U}, {_lang(lang)}, {_W}, e AS (SELECT * FROM u SEMI JOIN l USING (recording_id)), z AS (SELECT speaker_id, count(*) AS words FROM w SEMI JOIN l USING (recording_id) GROUP BY 1), m AS ({counts})
SELECT speaker_id, category, marker, CAST(sum(n) AS BIGINT) AS count, round(1000.0::DOUBLE * sum(n) / max(words), 2) AS per_1k, count(DISTINCT recording_id) AS recordings FROM m JOIN z USING (speaker_id) WHERE n > 0 GROUP BY 1, 2, 3"""


def _quote(label: str) -> str:
    return label.replace("'", "''")


SQL["agg21_plain_markers_en"] = _marker_sql(ENGLISH.code)
SQL["agg21_plain_markers_fr"] = _marker_sql(FRENCH.code)

_FAMILIAR = " UNION ALL ".join(f"SELECT speaker_id, '{_quote(x)}' AS word, {_standalone_count('norm', [x])} AS n FROM e" for x in ENGLISH.familiar)
SQL["agg28_familiar_words"] = f"""WITH {_U}, {_lang("en")}, {_W}, e AS (SELECT * FROM u SEMI JOIN l USING (recording_id)), z AS (SELECT speaker_id, count(*) AS words FROM w SEMI JOIN l USING (recording_id) GROUP BY 1), m AS ({_FAMILIAR})
SELECT speaker_id, word, CAST(sum(n) AS BIGINT) AS count, round(1000.0::DOUBLE * sum(n) / max(words), 2) AS per_1k FROM m JOIN z USING (speaker_id) WHERE n > 0 GROUP BY 1, 2"""
SQL["fn1_slugs"] = """SELECT id, coalesce(nullif(rtrim(left(trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, '')), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-'), ''), 'recording') AS slug FROM recordings"""
SQL["src11_flat_transcripts"] = """SELECT DISTINCT recording_id, array_to_string(list_filter(list_transform(segments, lambda s: trim(s.text, ' ')), lambda t: t <> ''), ' ') AS text FROM transcripts WHERE segments IS NOT NULL"""
_COUNTED = "len(list_filter(regexp_split_to_array(text, '[\\s\\x{0b}\\x{85}\\p{Z}]+'), lambda x: x <> ''))"
_WINDOWS = """o AS (SELECT recording_id, "index" AS i, text, {count} AS words, row_number() OVER (PARTITION BY recording_id ORDER BY "index") AS rn FROM u),
r AS (SELECT recording_id, rn, 0 AS k, words AS n FROM o WHERE rn = 1 UNION ALL SELECT o.recording_id, o.rn, CASE WHEN r.n >= {most} THEN r.k + 1 ELSE r.k END, CASE WHEN r.n >= {most} THEN o.words ELSE r.n + o.words END FROM r JOIN o ON o.recording_id = r.recording_id AND o.rn = r.rn + 1)"""
SQL["seg6_chunks"] = f"""WITH RECURSIVE {_U}, {_WINDOWS.format(count=_COUNTED, most=350)}
SELECT recording_id, k AS number, left(sha256(string_agg(text, chr(10) ORDER BY rn)), 16) AS key, min(i) AS first_index, max(i) AS last_index, CAST(sum(words) AS BIGINT) AS words, CAST(least(3, min(rn) - 1) AS INTEGER) AS context_lines FROM r JOIN o USING (recording_id, rn) GROUP BY 1, 2"""
SQL["seg8_passages"] = f"""WITH RECURSIVE {_U}, {_WINDOWS.format(count=_COUNTED, most=130)},
g AS (SELECT recording_id, k, sum(words) AS w, min(i) AS a, max(i) AS b FROM r JOIN o USING (recording_id, rn) GROUP BY 1, 2), t AS (SELECT *, max(k) OVER (PARTITION BY recording_id) AS last FROM g),
m AS (SELECT recording_id, CASE WHEN k = last AND k > 0 AND w < 65 THEN k - 1 ELSE k END AS k, w, a, b FROM t), f AS (SELECT recording_id, k, sum(w) AS words, min(a) AS a, max(b) AS b FROM m GROUP BY 1, 2)
SELECT recording_id, k AS "window", CASE WHEN k = 0 THEN 'opening' WHEN k = max(k) OVER (PARTITION BY recording_id) THEN 'closing' ELSE 'middle' END AS role, a AS first_index, b AS last_index, CAST(words AS BIGINT) AS words FROM f"""
_NORM = "trim(regexp_replace(replace(lower({x}), '’', ''''), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}'']+', ' ', 'g'))"
_DEVICES = ", ".join(f"'{x}'" for x in DEVICES)
# The parts of a quote stand in a passage in order exactly if they match it with anything between them.
_PARTS = f"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(quote, ''), '\\[\\.\\.\\.\\]|\\.\\.\\.|…'), lambda x: {_NORM.format(x='x')}), lambda x: x <> ''), '.*')"
_VERIFIED = f"""{_U}, {_WINDOWS.format(count=_COUNTED, most=350)},
ln AS (SELECT o.recording_id, k, i, u."start" AS sec, {_NORM.format(x='o.text')} AS line FROM r JOIN o USING (recording_id, rn) JOIN u ON u.recording_id = o.recording_id AND u."index" = o.i),
ps AS (SELECT recording_id, k, string_agg(line, ' ' ORDER BY i) FILTER (WHERE line <> '') AS passage, list(i) AS held FROM ln GROUP BY 1, 2),
q AS (SELECT *, {_NORM.format(x="coalesce(quote, '')")} AS qn, {_PARTS} AS parts FROM annotations),
c AS (SELECT annotation_id, k, parts <> '' AND regexp_matches(coalesce(passage, ''), parts) AS found, len(list_intersect(coalesce(utterances, []), held)) > 0 AS own FROM q JOIN ps USING (recording_id)),
b AS (SELECT annotation_id, k FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY NOT own, k) AS n FROM c WHERE found) WHERE n = 1),
v AS (SELECT q.*, b.k, CASE WHEN coalesce(quote, '') = '' THEN 'empty quote' WHEN device IS NULL OR device NOT IN ({_DEVICES}) THEN 'unknown device' WHEN b.k IS NULL THEN 'quote not found' END AS reason FROM q LEFT JOIN b USING (annotation_id)),
sp AS (SELECT annotation_id, list_sort(list(DISTINCT i)) AS lines, arg_min(struct_pack(v := sec), i).v AS sec FROM v JOIN ln ON ln.recording_id = v.recording_id AND ln.k = v.k
  WHERE reason IS NULL AND (coalesce(list_contains(utterances, i), false) OR (line <> '' AND qn <> '' AND (contains(qn, line) OR contains(line, qn)))) GROUP BY 1)"""
SQL["fn4_verified_annotations"] = f"""WITH RECURSIVE {_VERIFIED} SELECT annotation_id, recording_id, device, quote, reason IS NULL AS kept, reason, coalesce(lines, []) AS lines, sec AS t FROM v LEFT JOIN sp USING (annotation_id)"""
SQL["agg30_device_summary"] = f"""WITH RECURSIVE {_VERIFIED}, z AS (SELECT speaker_id, sum({_COUNTED}) AS words FROM u GROUP BY 1)
SELECT speaker_id, device, count(*) AS count, round(1000.0::DOUBLE * count(*) / max(words), 2) AS per_1k, count(DISTINCT recording_id) AS recordings FROM v JOIN z USING (speaker_id) WHERE reason IS NULL GROUP BY 1, 2"""
SQL["win3_device_examples"] = f"""WITH RECURSIVE {_VERIFIED}, e AS (SELECT v.*, coalesce(sp.sec, 0) AS t0 FROM v LEFT JOIN sp USING (annotation_id) WHERE reason IS NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, device, recording_id ORDER BY t0, annotation_id) AS rn, row_number() OVER (PARTITION BY speaker_id, device ORDER BY t0, annotation_id) AS ord FROM e),
f AS (SELECT *, min(ord) OVER (PARTITION BY speaker_id, device, recording_id) AS first FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, device ORDER BY rn, first) AS pick FROM f)
SELECT speaker_id, device, CAST(pick AS INTEGER) AS pick, annotation_id, recording_id, quote FROM s WHERE pick <= 5"""
_TEXT = "regexp_replace(regexp_replace(regexp_replace(joined, '{ws}+([''’-])', '\\1', 'g'), '([''’]){ws}+', '\\1', 'g'), '{ws}+([,.;:…])', '\\1', 'g')".replace("{ws}", _WS)
SQL["seg1_pause_utterances"] = f"""WITH RECURSIVE t AS (SELECT recording_id, segments, coalesce(lower(trim(language)) IN ('fr','french','français','fra','fre') OR regexp_split_to_array(lower(trim(language)), '[-_ ]')[1] IN ('fr','french','français','fra','fre'), false) AS french FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY created_at DESC, loaded_at DESC) AS d FROM transcripts WHERE segments IS NOT NULL) WHERE d = 1),
s AS (SELECT recording_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM t), x AS (SELECT recording_id, i, unnest(s.words) AS w, generate_subscripts(s.words, 1) AS j FROM s WHERE NOT coalesce(s.no_speech_prob > 0.8 AND s.avg_logprob < -1.0, false)),
k0 AS (SELECT recording_id, w.word AS word, w."start" AS a, w."end" AS b, row_number() OVER (PARTITION BY recording_id ORDER BY i, j) AS pos FROM x WHERE w.word <> '' AND w.word <> '...'),
k AS MATERIALIZED (SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY pos) - b AS gap, lead(pos) OVER (PARTITION BY recording_id ORDER BY pos) IS NULL AS last, right(word, 1) IN ('.', '?', '!', '…') AS fin FROM k0),
r AS (SELECT recording_id, pos, 1 AS run, 0 AS u, CASE WHEN fin THEN 'punct' WHEN gap > 0.5 THEN 'pause' WHEN last THEN 'end' END AS why FROM k WHERE pos = 1
UNION ALL SELECT k.recording_id, k.pos, CASE WHEN r.why IS NULL THEN r.run + 1 ELSE 1 END, CASE WHEN r.why IS NULL THEN r.u ELSE r.u + 1 END, CASE WHEN k.fin THEN 'punct' WHEN k.gap > 0.5 OR ((CASE WHEN r.why IS NULL THEN r.run + 1 ELSE 1 END) >= 20 AND k.gap > 0.2) THEN 'pause' WHEN k.last THEN 'end' END FROM r JOIN k ON k.recording_id = r.recording_id AND k.pos = r.pos + 1),
g AS (SELECT recording_id, u, string_agg(word, ' ' ORDER BY pos) AS joined, arg_min(struct_pack(v := a), pos).v AS "start", arg_max(struct_pack(v := b), pos).v AS "end", max(why) AS split FROM r JOIN k USING (recording_id, pos) GROUP BY 1, 2),
f AS (SELECT recording_id, u, "start", "end", split, trim(regexp_replace(CASE WHEN french THEN regexp_replace({_TEXT}, '{_WS}*([?!])', ' \\1', 'g') ELSE regexp_replace({_TEXT}, '{_WS}+([?!])', '\\1', 'g') END, '{_WS}+', ' ', 'g')) AS text FROM g JOIN t USING (recording_id))
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY u) - 1 AS INTEGER) AS "index", "start", "end", text, split FROM f WHERE regexp_matches(text, '{_WORDY}')"""


def _in_french(name: str, *values: tuple[str, str]) -> None:
    """The SQL of a French twin: that of the English query with another language and other fixed values."""
    sql = SQL[name]
    for english, french in ((_lang("en"), _lang("fr")), *values):
        if english not in sql:
            raise ValueError(f"{name}: {english}")
        sql = sql.replace(english, french)
    SQL[f"{name}_fr"] = sql


_FR_TAGS = (_TAGS, FRENCH.tags.replace("'", "''").replace("\\s", _WS))
_FR_PRONOUNS = ", ".join(f"({k}, '{_quote(p)}', '{_quote(p).rstrip(chr(39))}')" for k, p in enumerate(FRENCH.pronouns))
SQL["agg11_pronouns_fr"] = f"""WITH {_lang("fr")}, {_W}, e AS (SELECT w.* FROM w SEMI JOIN l USING (recording_id)), pr(ord, pronoun, bare) AS (VALUES {_FR_PRONOUNS}),
z AS (SELECT speaker_id, count(*) AS n FROM e GROUP BY 1), c AS (SELECT speaker_id, w AS pronoun, count(*) AS k FROM e GROUP BY 1, 2),
b AS (SELECT w AS bare, count(*)::DOUBLE / (SELECT count(*) FROM e) AS freq FROM e GROUP BY 1)
SELECT speaker_id, ord, pronoun, coalesce(k, 0) AS count, round(1000.0::DOUBLE * coalesce(k, 0) / n, 2) AS per_1k, round(1000 * freq, 2) AS baseline_per_1k
FROM z CROSS JOIN pr LEFT JOIN c USING (speaker_id, pronoun) LEFT JOIN b USING (bare)"""
_in_french("agg18_questions", _FR_TAGS)
_in_french("win2_question_examples", _FR_TAGS)
_in_french("agg23_repeats", *((", ".join(f"'{x}'" for x in sorted(en)), ", ".join(f"'{x}'" for x in sorted(fr))) for en, fr in ((ENGLISH.emphatic, FRENCH.emphatic), (ENGLISH.repeat_ok, FRENCH.repeat_ok))))
_in_french("agg27_address", (_standalone_count("norm", ENGLISH.address.split("/")), _standalone_count("norm", FRENCH.address.split("/"))))
_in_french("agg28_familiar_words", (_FAMILIAR, " UNION ALL ".join(f"SELECT speaker_id, '{_quote(x)}' AS word, {_standalone_count('norm', [x])} AS n FROM e" for x in FRENCH.familiar)))

_WS_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda x: x <> ''))"


def _spread_sql(rows: str, feature: str, k: str) -> str:
    """Examples by feature from ``rows`` (feature columns, recording_id, utt_id, index, text), after the text of the survey: rounds over
    recordings in order of appearance, readable lengths first, texts once."""
    return f"""r AS (SELECT *, min(utt_id) OVER (PARTITION BY {feature}, recording_id) AS f, row_number() OVER (PARTITION BY {feature}, recording_id ORDER BY NOT {_WS_WORDS} BETWEEN 4 AND 30, "index", utt_id) AS rn FROM ({rows})),
s AS (SELECT *, row_number() OVER (PARTITION BY {feature}, text ORDER BY rn, f) AS seen FROM r), picks AS (SELECT *, row_number() OVER (PARTITION BY {feature} ORDER BY rn, f) AS pick FROM s WHERE seen = 1)
SELECT {feature}, CAST(pick AS INTEGER) AS pick, recording_id, "index", text FROM picks WHERE pick <= {k}"""


_TOP_OPENINGS = "c AS (SELECT speaker_id, a AS first, count(*) AS count, min(utt_id) AS first_at FROM f0 GROUP BY 1, 2), tops AS (SELECT speaker_id, first FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY count DESC, first_at) AS rank FROM c) WHERE rank <= 12)"
SQL["agg16_opening_examples"] = f"""WITH {_U}, {_FIRST.replace("f AS (", "f0 AS (").replace("FROM f GROUP", "FROM f0 GROUP")}, {_TOP_OPENINGS},
{_spread_sql('SELECT f0.speaker_id, f0.a AS first, u.recording_id, u.utt_id, u."index", u.text FROM f0 JOIN tops ON tops.speaker_id = f0.speaker_id AND tops.first = f0.a JOIN u USING (utt_id)', 'speaker_id, first', '2')}"""
SQL["jn6_spoken_minutes"] = f"""WITH {_U} SELECT speaker_id, count(*) AS recordings, round(sum(coalesce(duration_s, 0)) / 60, 1) AS minutes FROM recordings WHERE id IN (SELECT recording_id FROM u) GROUP BY 1"""


# Passages (SEG8) beside the chunks of _VERIFIED: the same recursion under other names.
_PASSAGES = re.sub(r"\br\b", "r2", re.sub(r"\bo\b", "o2", _WINDOWS.format(count=_COUNTED, most=130)))
SQL["jn7_passage_devices"] = f"""WITH RECURSIVE {_VERIFIED}, {_PASSAGES},
g2 AS (SELECT recording_id, k, sum(words) AS w FROM r2 JOIN o2 USING (recording_id, rn) GROUP BY 1, 2), t2 AS (SELECT *, max(k) OVER (PARTITION BY recording_id) AS last FROM g2),
m2 AS (SELECT recording_id, k AS k0, CASE WHEN k = last AND k > 0 AND w < 65 THEN k - 1 ELSE k END AS k, w FROM t2),
f2 AS (SELECT recording_id, k, sum(w) AS words FROM m2 GROUP BY 1, 2),
l2 AS (SELECT r2.recording_id, m2.k, o2.i FROM r2 JOIN o2 USING (recording_id, rn) JOIN m2 ON m2.recording_id = r2.recording_id AND m2.k0 = r2.k),
d2 AS (SELECT l2.recording_id, l2.k, list_sort(list(DISTINCT v.device)) AS devices FROM v JOIN sp USING (annotation_id) JOIN l2 ON l2.recording_id = v.recording_id AND list_contains(sp.lines, l2.i)
  WHERE reason IS NULL AND v.device IN ({", ".join(f"'{x}'" for x in PASSAGE_DEVICES)}) GROUP BY 1, 2)
SELECT recording_id, k AS "window", CASE WHEN k = 0 THEN 'opening' WHEN k = max(k) OVER (PARTITION BY recording_id) THEN 'closing' ELSE 'middle' END AS role, CAST(words AS BIGINT) AS words, coalesce(devices, []) AS devices FROM f2 LEFT JOIN d2 USING (recording_id, k)"""
_OUTER = "[\\s\\x{0b}\\x{85}\\p{Z}]"
SQL["fn5_clean_drafts"] = f"""WITH a AS (SELECT version_id, regexp_replace(regexp_replace(text, '(?m)^\\s*(?:#+ .*|\\*\\*.*\\*\\*|[-*] )', '', 'g'), '(?m)^\\s*[\\[(].*?[\\])]\\s*$', '', 'g') AS t FROM versions),
b AS (SELECT version_id, regexp_replace(regexp_replace(t, '^{_OUTER}+|{_OUTER}+$', '', 'g'), '^[«»"“”]+|[«»"“”]+$', '', 'g') AS t FROM a)
SELECT version_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_OUTER}+|{_OUTER}+$', '', 'g') AS clean FROM b"""
# Preferred forms: what must or must not follow is counted apart, since there is no look-around.
_FOLLOWED = {"going to": ("going  to  (?:the|a  |a''|my|your)", -1), "one (generic)": ("one  (?:can|should|must|might|would|could|has|needs)", 1)}


def _preference_sql(lang: str) -> str:
    inner = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}''’"
    doubled = f"regexp_replace(' ' || norm || ' ', '([^{inner}])', '\\1\\1', 'g')"

    def count(label: str, form: str) -> str:
        plain = _standalone_count("norm", form.split("{")[0].split("/"))
        if label not in _FOLLOWED:
            return plain
        pattern, sign = _FOLLOWED[label]
        followed = f"len(regexp_extract_all({doubled}, '[^{inner}]{pattern}'))"
        return f"{plain} - {followed}" if sign < 0 else followed

    rows = " UNION ALL ".join(
        f"""SELECT speaker_id, {k} AS ord, '{_quote(u)}' AS "use", '{_quote(a)}' AS avoid, CAST(sum({count(u, uf)}) AS BIGINT) AS use_count, CAST(sum({count(a, af)}) AS BIGINT) AS avoid_count FROM e GROUP BY 1"""
        for k, (u, uf, a, af) in enumerate(preferences(LEXICONS[lang]))
    )
    return f"WITH {_U}, {_lang(lang)}, e AS (SELECT * FROM u SEMI JOIN l USING (recording_id)) {rows}"


SQL["agg26_preferences"], SQL["agg26_preferences_fr"] = _preference_sql("en"), _preference_sql("fr")
