"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.quality import RULES

_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

EXACT = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def quality(limit: float = 0.01, error: float = 0.05, cost: float = 20.0) -> str:
    grid = ",\n    ".join(f"('{rule}', {i + 1}, {cut}::double)" for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts))

    def rate(rule: str) -> str:
        above, below = (x.strip() for x in RULES[rule][0].split("/"))
        return f"case when {below} > 0 then {above}::double / {below}::double else 0.0 end"

    rates = ", ".join(f"'{r}': {rate(r)}" for r in RULES)
    value = "case rule " + " ".join(f"when '{r}' then {rate(r)}" for r in RULES) + " end"
    return f"""
with docs as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
split as (
  select *, list_filter(string_split_regex(t, '{_GAP}'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from docs),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, s) as n
  from (select doc_id, i, list_slice(w, i, i + 4) as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from split))),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from windows where n > 1) group by 1),
counts as (
  select s.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '{_GAP}', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from split s left join covered c using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
grid(rule, step, cutoff) as (values
    {grid}),
labelled as (select j.*, quality from judged j join (select doc_id, min(quality) as quality from labels where quality is not null group by 1) using (doc_id) where not base_failed),
tallied as (
  select stratum, rule, step, cutoff, count(*) filter (quality = 1) as good, count(*) filter (quality = 1 and v > cutoff) as gr, count(*) filter (quality = 0) as bad, count(*) filter (quality = 0 and v > cutoff) as br
  from (select *, {value} as v from labelled cross join grid) group by 1, 2, 3, 4),
tails as (
  select *, case when gr >= good * {limit}::double then 1.0 else list_sum(list_transform(range(0, gr + 1),
      lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({limit}::double) + (good - i) * ln(1 - {limit}::double)))) end as tail,
    {error}::double / ({len(RULES)} * (select count(distinct stratum) from labelled)) as level from tallied),
held as (select *, good > 0 and max(case when tail <= level then 0 else 1 end) over (partition by stratum, rule order by step) = 0 as holds from tails),
gains as (select *, br / greatest(bad, 1)::double - {cost}::double * gr / greatest(good, 1)::double as gain from held where holds and br > 0),
best as (select stratum, rule, arg_max(cutoff, gain - step * 1e-12) as cutoff from gains where gain > 0 group by 1, 2),
rejected as (select distinct j.doc_id from judged j join best b using (stratum) where {value} > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from rejected) as kept from judged
"""


WORD_REPEATS = f"""
with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, count(*) over (partition by s) as n
  from (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from docs))),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from windows where n > 1),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from docs),
kept as (select w.doc_id, string_agg(x, ' ' order by w.p) as t, count(*) as n from words w anti join gone g on w.doc_id = g.doc_id and w.p = g.p group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)
"""

BYTE_REPEATS = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, i, min(doc_id) over (partition by s) as first
  from (select doc_id, i, sha256(substr(h, 2 * i + 1, 100)) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from docs))),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows where first < doc_id),
runs as (select doc_id, count(*) as n, count(*) filter (p - 1 <> prev or prev is null) as spans from (select *, lag(p) over (partition by doc_id order by p) as prev from gone) group by 1),
bytes as (select doc_id, i as p, substr(h, 2 * i + 1, 2) as x from (select doc_id, h, unnest(range(0, len(h) // 2)) as i from docs)),
kept as (select b.doc_id, string_agg(x, '' order by b.p) as t from bytes b anti join gone g on b.doc_id = g.doc_id and b.p = g.p group by 1)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(t, ''))) as kept_sha256
from docs left join runs using (doc_id) left join kept using (doc_id)
"""

#: Base32 of a digest's 40 hex digits: each five of these are four letters.
WARC = """
with docs as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from docs
"""

ORACLES = {"op2_quality_rules": quality(), "op6_exact_dedup": EXACT, "op7_substring_dedup": WORD_REPEATS, "op8_warc": WARC, "op9_suffix_array_dedup": BYTE_REPEATS}
