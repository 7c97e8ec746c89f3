"""DuckDB SQL for the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from .quality_rules import PHRASES, LineRules

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""
with recursive t as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []) as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from t where len(ws) > 0)),
n as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y
  where 100 * k >= 80 * (p.n + q.n - k)),
edge as (select x, y from link union all select y, x from link),
reach as (
  select doc_id, doc_id as r from t
  union select reach.doc_id, edge.y from reach join edge on edge.x = reach.r)
select t.doc_id, coalesce(n.n, 0) as n_shingles, min(reach.r) as component_id,
  case when n.h is null then t.doc_id else min(min(t.doc_id)) over (partition by n.h) end as class_id
from t join reach on reach.doc_id = t.doc_id left join n on n.doc_id = t.doc_id
group by t.doc_id, n.n, n.h"""

SUBSTRING_DEDUP = f"""
with t as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as ws from documents),
w as (
  select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from t where len(ws) >= 20)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from w) where k > 1),
gone as (select distinct doc_id, i + k as pos from later, (select unnest(range(20)) as k)),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from t),
kept as (
  select doc_id, string_agg(word, ' ' order by pos) as text, count(*) as k
  from word anti join gone using (doc_id, pos) group by doc_id)
select t.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k, 0) as bigint) as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from t left join kept on kept.doc_id = t.doc_id"""


_CRC32 = """xor(list_reduce(
  list_concat([4294967295], list_transform(range(8 * length(s)), lambda k: (ascii(s[k // 8 + 1]) >> (k % 8)) & 1)),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""

PERIODIC_RUNS = f"""
with w0 as (
  select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as ws, cast(doc_id as varchar) as s from documents),
w1 as (select doc_id, ws, len(ws) as n, cast({_CRC32} as bigint) as h from w0),
w2 as (select *, case when n > 0 then (h // 10) % n end as a from w1),
w3 as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from w2),
t as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) else ws end as ws
  from w3),
gram as (
  select doc_id, i, n, md5(array_to_string(ws[i + 1:i + 16], ' ')) as g, case when i > 0 then ws[i] end as before
  from (select doc_id, n, ws, unnest(range(n - 15)) as i from t where n >= 16)),
pair as (
  select x.doc_id, x.i, y.i - x.i as p from gram x join gram y
  on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i and x.before is distinct from y.before and 3 * (y.i - x.i) <= x.n - x.i),
far as (
  select doc_id, pair.i, pair.p, n, list_position(
    list_transform(range(16, n - pair.i - pair.p), lambda k: ws[pair.i + k + 1] = ws[pair.i + pair.p + k + 1]), false) as stop
  from pair join t using (doc_id)),
run as (
  select doc_id, i as start, min(p) as period, length from (
    select doc_id, i, p, coalesce(stop - 1 + 16, n - i - p) + p as length from far)
  where length >= 24 and length >= 3 * p group by doc_id, i, length),
best as (select * from run qualify row_number() over (
  partition by doc_id order by cast(length as double) / period desc, start, period) = 1),
gone as (
  select distinct doc_id, pos from (select doc_id, unnest(range(start + period, start + length)) as pos from run)),
word as (select doc_id, unnest(ws) as word, unnest(range(n)) as pos from t),
kept as (select doc_id, string_agg(word, ' ' order by pos) as text from word anti join gone using (doc_id, pos) group by doc_id),
listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text
  from run group by doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, best.start, best.length, best.period,
  1000 * best.length // best.period as exponent_milli, sha256(coalesce(listed.text, '')) as runs_sha256,
  sha256(coalesce(kept.text, '')) as collapsed_sha256
from t left join listed on listed.doc_id = t.doc_id left join best on best.doc_id = t.doc_id
left join kept on kept.doc_id = t.doc_id"""


def quality_rules(rules: LineRules = LineRules()) -> str:
    symbols = "[#*$%&|<>]"
    count = lambda text, pattern: f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"
    closing = """[.!?:;,"'')\\]…»”’][\\x20\\x09-\\x0D]*$"""
    phrases = "|".join(PHRASES.values()).replace("'", "''")
    return f"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
line as (
  select doc_id, l, len(regexp_extract_all(l, '{WORD}')) as n, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) as chars,
    {count('l', symbols)} as symbols
  from (select doc_id, unnest(string_split(text, chr(10))) as l from t)),
judged as (
  select doc_id, l, chars, symbols > {rules.max_symbols}::double * chars
      or (n <= {rules.nav_words} and not regexp_matches(l, '{closing}'))
      or len(regexp_extract_all(l, '\\||>{{1,2}}|»|›|·|•')) >= {rules.nav_marks}
      or (n <= {rules.boiler_words} and regexp_matches(translate(l, '{_UPPER}', '{_LOWER}'), '{phrases}')) as failed
  from line where n > 0),
lines as (
  select doc_id, count(*) - count(distinct l) as dup, coalesce(sum(chars) filter (failed), 0) as lost from judged group by doc_id),
g as (
  select doc_id, i, array_to_string(ws[i:i + 2], ' ') as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from t where len(ws) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as k from g) where k > 1),
repeated as (
  select doc_id, count(distinct i + k) as n from twice, (select unnest(range(3)) as k) group by doc_id),
f as (
  select t.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
    cast({count('text', symbols)} as bigint) as n_symbols, cast(coalesce(dup, 0) as bigint) as n_dup_lines,
    cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost, 0) as bigint) as lost_chars
  from t left join lines on lines.doc_id = t.doc_id left join repeated on repeated.doc_id = t.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= {rules.max_lost}::double * word_chars as kept,
  lost_chars
from f"""


ORACLES = {
    "op1_ngram_join": NGRAM_JOIN.strip(),
    "op4_substring_dedup": SUBSTRING_DEDUP.strip(),
    "op7_quality_rules": quality_rules().strip(),
    "op11_periodic_runs": PERIODIC_RUNS.strip(),
}
