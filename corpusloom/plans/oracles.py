"""DuckDB SQL for the queries over the test tables."""

from __future__ import annotations

from corpusloom.functions.ids import SEED
from corpusloom.operators.clean import CANONICAL_ORDER
from corpusloom.plans.views import COMMIT, MARKER, MODELS, RULES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_RAW = f"""
raw0 as (select doc_id, text, lang, source, cast(substr(source, 4) as integer) % 14 + 1 as d, (doc_id // 20) % 10 as k from documents),
raw as (
  select text, list_extract({_list(CANONICAL_ORDER)}, d) || '/' || lang || '/' || case when doc_id % 7 = 0 then '' else source || '/' end || doc_id
    || case when k = 0 then '.cpp' when k = 1 then '.hpp' when k <= 4 then '.h' else '.c' end as path
  from raw0)"""

_FILES = f"""{_RAW},
files as (
  select path, text, regexp_extract(path, '(\\.[^./]+)$', 1) as extension,
    case regexp_extract(path, '(\\.[^./]+)$', 1) when '.c' then 'c' when '.cpp' then 'cpp' when '.h' then 'c_header' else 'cpp_header' end as language,
    split_part(path, '/', 1) as top_level_directory, cast(octet_length(encode(text)) as bigint) as size_bytes,
    cast(case when text = '' then 0 else len(text) - len(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end as bigint) as line_count,
    sha256(text) as sha256, 'utf-8' as encoding_status, false as has_null_bytes, text <> '' as candidate, '{COMMIT}' as repository_commit
  from raw)"""

_SIGNALS = " + ".join(_count(p) for p in RULES.domain_patterns)

_CLEAN = f"""{_FILES},
measured as (
  select *, cast({_count(RULES.data_pattern)} as bigint) as hex_literal_count, regexp_extract(path, '^(.*)/[^/]*$', 1) as split_group,
    len(string_split(path, '/')) as depth, coalesce(list_position({_list(CANONICAL_ORDER)}, top_level_directory) - 1, 999) as place
  from files),
heavy as (
  select *, hex_literal_count::double / greatest(line_count, 1)::double as hex_literals_per_line,
    hex_literal_count >= {RULES.data_min_count} and hex_literal_count::double / greatest(line_count, 1)::double >= {RULES.data_per_line} as is_heavy,
    extension in ('.cpp', '.hpp') as is_cpp
  from measured),
reasoned as (
  select *,
    case when not candidate then case when size_bytes = 0 then 'empty-file' else 'encoding-or-binary' end
      when starts_with(path, '{RULES.exclude_path_prefixes[0]}') then 'excluded-path-prefix'
      when path in {_in(RULES.exclude_exact_paths)} then 'known-generated-or-vendored'
      when size_bytes > {RULES.max_file_bytes} then 'over-maximum-size'
      when is_heavy then 'hex-data-heavy' end as reason,
    case when top_level_directory in ('samples', 'tests', 'include', 'drivers', 'subsys', 'kernel', 'lib') then 'core'
      when top_level_directory in ('arch', 'soc', 'boards', 'dts') then 'platform' when top_level_directory = 'modules' then 'integration' else 'other' end as directory_tier,
    case when not is_cpp then 'not-cpp' when is_heavy then 'generated-or-data-heavy' when {_count(RULES.include)} > 0 then 'direct-{RULES.project}'
      when {_SIGNALS} >= {RULES.domain_threshold} then '{RULES.project}-patterns' else 'generic-or-third-party' end as cpp_relevance
  from heavy),
ranked_copies as (
  select path, row_number() over w as rn, first_value(path) over w as best from reasoned where reason is null
  window w as (partition by sha256 order by place, depth, path)),
cleaned as (
  select r.*, case when c.rn > 1 then c.best end as duplicate_of, case when c.rn > 1 then 'exact-duplicate' else reason end as exclusion_reason,
    case when c.rn > 1 then false else reason is null end as included,
    case when not is_cpp then 'not-cpp' when is_heavy then 'exclude' when starts_with(path, 'samples/cpp/') then 'high'
      when cpp_relevance in ('direct-{RULES.project}', '{RULES.project}-patterns') then 'high'
      when starts_with(path, 'lib/cpp/') or starts_with(path, 'tests/') then 'medium' else 'low' end as cpp_training_priority
  from reasoned r left join ranked_copies c using (path)),
included as (select * from cleaned where included)"""


def _hash16(*parts: str) -> str:
    return "substr(sha256(" + " || ':' || ".join([f"'{SEED}'", *parts]) + "), 1, 16)"


_GROUPS = f"""{_CLEAN},
stats as (
  select split_group, count(*) as files, cast(sum(size_bytes) as bigint) as bytes, count(*) filter (is_cpp) as cpp_count,
    count(*) filter (is_cpp and cpp_training_priority = 'high') as high_cpp_count
  from included group by 1)"""

_SPLITS = ("train", "validation", "evaluation")


def _score(i: int) -> str:
    part = lambda held, target: f"(case when {target}[{i}] <= 0 then 0.0::double else ({target}[{i}] - {held}[{i}]) / {target}[{i}] end)"
    return f"(1.0::double * {part('hb', 'tb')} + case when cpp_count > 0 then 2.0::double * {part('hc', 'tc')} else 0.0::double end) + case when high_cpp_count > 0 then 3.0::double * {part('hh', 'th')} else 0.0::double end"


def _added(held: str, size: str) -> str:
    return "[" + ", ".join(f"{held}[{i + 1}] + case when pick = '{s}' then {size} else 0 end" for i, s in enumerate(_SPLITS)) + "]"


_ASSIGN = f"""{_GROUPS},
totals as (select sum(bytes)::double as b, sum(cpp_count)::double as c, sum(high_cpp_count)::double as h from stats),
targets as (
  select [b * 0.8::double, b * 0.1::double, b * 0.1::double] as tb, [c * 0.7::double, c * 0.15::double, c * 0.15::double] as tc,
    [h * 0.7::double, h * 0.15::double, h * 0.15::double] as th from totals),
queue as (
  select *, row_number() over (order by high_cpp_count desc, cpp_count desc, bytes desc, {_hash16('split_group')}) as rn from stats),
fold as (
  select 0::bigint as rn, ''::varchar as split_group, ''::varchar as pick, [0.0::double, 0.0, 0.0] as hb, [0.0::double, 0.0, 0.0] as hc, [0.0::double, 0.0, 0.0] as hh
  union all
  select rn, split_group, pick, {_added('hb', 'bytes')}, {_added('hc', 'cpp_count')}, {_added('hh', 'high_cpp_count')}
  from (
    select q.rn, q.split_group, q.bytes, q.cpp_count, q.high_cpp_count, f.hb, f.hc, f.hh,
      list_extract(list_sort([{', '.join("{'score': " + _score(i + 1) + ", 'hex': " + _hash16('q.split_group', f"'{s}'") + f", 'name': '{s}'" + "}" for i, s in enumerate(_SPLITS))}]), 3).name as pick
    from fold f join queue q on q.rn = f.rn + 1 cross join targets)),
assigned as (select split_group, pick as split from fold where rn > 0),
split_files as (select i.*, a.split from included i join assigned a using (split_group))"""

#: DuckDB wants "recursive" for the fold.
_LINES = "regexp_extract_all(body, '[^\\n]*\\n')"
_EXAMPLES = f"""{_ASSIGN},
bodies as (
  select path, sha256, split, extension, language, cpp_training_priority, split_group,
    case when b = '' then '' else b || chr(10) end as body
  from (select *, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), '\\s+$', '') as b from split_files)),
lined as (select *, {_LINES} as lines, len({_LINES}) as n from bodies),
cuts as (
  select *, unnest(list_sort(list_distinct(list_filter(range(4, n, 16) || [greatest(1, n // 2), greatest(1, n - 16)], lambda x: x < n)))) as cut_line from lined where n > 4),
sliced as (
  select * exclude (lines, body), array_to_string(list_slice(lines, greatest(0, cut_line - 96) + 1, cut_line), '') as p0, array_to_string(list_slice(lines, cut_line + 1, least(n, cut_line + 16)), '') as c0 from cuts),
tokened as (
  select *, regexp_extract_all(p0, '\\w+|[^\\w\\s]+|\\s+') as pt, list_slice(regexp_extract_all(c0, '\\w+|[^\\w\\s]+|\\s+'), 1, 128) as ct from sliced),
windowed as (
  select * exclude (pt, ct, p0, c0), array_to_string(case when len(pt) > 896 then list_slice(pt, len(pt) - 895, len(pt)) else pt end, '') as prompt, array_to_string(ct, '') as completion from tokened),
counted as (
  select *, cast(len(regexp_extract_all(prompt, '\\w+|[^\\w\\s]+|\\s+')) as integer) as prompt_tokens, cast(len(regexp_extract_all(completion, '\\w+|[^\\w\\s]+|\\s+')) as integer) as completion_tokens from windowed),
usable as (
  select *, row_number() over (partition by path order by cut_line) - 1 as i, count(*) over (partition by path) as m, case when split = 'train' then 8 else 4 end as cap
  from counted where prompt_tokens >= 32 and completion_tokens >= 8 and trim(prompt, ' ' || chr(10) || chr(9)) <> '' and trim(completion, ' ' || chr(10) || chr(9)) <> ''),
capped as (
  select * from usable where m <= cap or list_contains(list_transform(range(0, cap), lambda q: round_even(q * (m - 1) / (cap - 1)::double, 0)::bigint), i)),
printed as (select *, sha256(prompt || chr(0) || completion) as fingerprint from capped),
examples as (
  select *, path as source_path, prompt_tokens + completion_tokens as total_tokens, substr(sha256('{COMMIT}:' || path || ':' || cut_line || ':' || fingerprint), 1, 24) as id,
    cast(case when split = 'train' then case cpp_training_priority when 'high' then 20 when 'medium' then 10 when 'low' then 4 else 1 end else 1 end as integer) as training_repeat,
    row_number() over (partition by fingerprint order by case split when 'train' then 0 when 'validation' then 1 else 2 end, path, cut_line) = 1 as claimed
  from printed),
kept as (select * from examples where claimed)"""

_HELD = f"""{_EXAMPLES},
cut_short as (
  select * exclude (id, completion, completion_tokens, total_tokens, fingerprint), id as original_id, regexp_extract(completion, '(?s)^(.*\\n)', 1) as completion from kept where split <> 'train'),
retokened as (select *, cast(len(regexp_extract_all(completion, '\\w+|[^\\w\\s]+|\\s+')) as integer) as completion_tokens, sha256(prompt || chr(0) || completion) as fingerprint from cut_short),
held as (
  select *, prompt_tokens + completion_tokens as total_tokens, substr(sha256('benchmark:' || original_id || ':' || fingerprint), 1, 24) as id
  from retokened where completion <> '' and completion_tokens >= 8 and trim(completion, ' ' || chr(10) || chr(9)) <> ''),
reps as (
  select * exclude (rn) from (
    select *, row_number() over (partition by source_path order by case when cpp_training_priority = 'high' then 0 else 1 end, abs(prompt_tokens - 400), abs(completion_tokens - 80), {_hash16('id')}) as rn from held)
  where rn = 1)"""

_GENERAL = f"""{_HELD},
quotas as (
  select *, row_number() over (partition by case when extension = '.c' then 1 when extension = '.h' then 2 else 0 end order by {_hash16('id')}) as rn,
    greatest(512 - count(*) filter (extension in ('.cpp', '.hpp')) over (), 0) as room from reps),
general as (
  select * from quotas
  where extension in ('.cpp', '.hpp') or (extension = '.c' and rn <= round_even(room * 0.65::double, 0)) or (extension = '.h' and rn <= room - round_even(room * 0.65::double, 0))),
numbered as (select *, cast(row_number() over (order by source_path, cut_line) - 1 as integer) as benchmark_index from general),
keyed as (
  select *, 'general:' || lpad(cast(benchmark_index as varchar), 5, '0') as evaluation_key,
    list_transform(regexp_extract_all(prompt, '\\w+|[^\\w\\s]+|\\s+'), lambda t: len(t)) as p, list_transform(regexp_extract_all(completion, '\\w+|[^\\w\\s]+|\\s+'), lambda t: len(t)) as c from numbered),
forced as (
  select evaluation_key, list_sum(c)::double / 16::double as negative_log_likelihood, cast(len(c) as bigint) as scored_tokens, cast(len(list_filter(c, lambda x: x % 2 = 0)) as bigint) as correct_tokens from keyed)"""

_TRAIN = f"""{_EXAMPLES},
weighted as (
  select *, case when language not in ('cpp', 'cpp_header') then 'non_cpp' else 'cpp_' || cpp_training_priority end as weight_group from kept where split = 'train'),
train as (
  select * exclude (training_repeat), case weight_group when 'cpp_high' then 112 when 'cpp_medium' then 16 when 'cpp_low' then 4 else 1 end as training_repeat from weighted)"""

_MODELS = ", ".join(f"('{m}', {'null' if s is None else s}, {a})" for m, s, a in MODELS)
_SCORES = f"""
scores as (
  select model, step, cast(doc_id as varchar) as evaluation_key, source as source_path,
    case doc_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'unknown' end as cpp_priority,
    (8 + doc_id % 121) * (400000 + (doc_id * 13 + coalesce(step, 350)) % 97 * 10000) as micro, 8 + doc_id % 121 as scored_tokens,
    (8 + doc_id % 121) * (50 + (doc_id * 7) % 50 + adj) // 100 as correct_tokens
  from documents cross join (values {_MODELS}) m(model, step, adj)),
grouped as (
  select model, step, g as "group", count(*) as examples, sum(scored_tokens) as st, sum(correct_tokens) as co, sum(micro::double / 1048576::double) as nll
  from (select *, unnest(['all_cpp', cpp_priority]) as g from scores) group by 1, 2, 3),
groups as (
  select model, step, "group", examples, cast(st as bigint) as scored_tokens, cast(co as bigint) as correct_tokens, nll as negative_log_likelihood,
    nll / st::double as mean_negative_log_likelihood, co::double / st::double as token_accuracy from grouped),
wide as (
  select model, step, max(token_accuracy) filter ("group" = 'all_cpp') as accuracy, max(mean_negative_log_likelihood) filter ("group" = 'high') as high_nll,
    max(mean_negative_log_likelihood) filter ("group" = 'all_cpp') as all_nll from groups group by 1, 2),
candidates as (
  select w.*, b.accuracy as base_accuracy, b.high_nll as base_high_nll, w.accuracy >= b.accuracy - 0.005::double as eligible
  from wide w cross join (select * from wide where model = 'base') b where w.model <> 'base'),
placed as (select *, case when eligible then row_number() over (partition by eligible order by high_nll, all_nll, step nulls last) end as rank from candidates),
pairs as (
  select b.evaluation_key, b.source_path, b.cpp_priority, b.micro::double / 1048576::double / b.scored_tokens::double as bn, t.micro::double / 1048576::double / t.scored_tokens::double as tn,
    b.correct_tokens::double / b.scored_tokens::double as ba, t.correct_tokens::double / t.scored_tokens::double as ta
  from scores b join scores t using (evaluation_key) where b.model = 'base' and t.model = 'checkpoint-100'),
lifted as (
  select evaluation_key, source_path, cpp_priority, bn as base_mean_negative_log_likelihood, ba as base_token_accuracy, tn as tuned_mean_negative_log_likelihood, ta as tuned_token_accuracy,
    bn - tn as mean_nll_reduction, (bn - tn) / bn * 100.0::double as mean_nll_reduction_percent, ta - ba as token_accuracy_delta from pairs)"""

_TURNS = """
replies as (
  select u.conv_id, u.turn, u.generated_text, a.reference_text
  from (select conv_id, turn, min(text) as generated_text from conversations where role = 'user' group by 1, 2) u
  join (select conv_id, turn - 1 as turn, min(text) as reference_text from conversations where role = 'assistant' group by 1, 2) a on u.conv_id = a.conv_id and u.turn = a.turn),
coded as (
  select *, list_transform(string_split(replace(generated_text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) as ls from replies)"""

#: Edit distance of token lists, a row of the table at a time; what comes from the left is a running minimum.
_SCORED = f"""{_TURNS},
pairs as (
  select conv_id, turn, generated_text as gt, reference_text as rt, regexp_extract_all(generated_text, '\\w+|[^\\w\\s]+|\\s+') as g, regexp_extract_all(reference_text, '\\w+|[^\\w\\s]+|\\s+') as r from replies),
edits as (
  select conv_id, turn, g, r, 0::bigint as i, range(0, len(r) + 1) as d from pairs
  union all
  select conv_id, turn, g, r, i + 1, list_transform(range(0, len(r) + 1), lambda j: list_min(list_slice(a, 1, j + 1)) + j)
  from (
    select *, list_transform(range(0, len(r) + 1), lambda j: case when j = 0 then d[1] + 1 else least(d[j] + case when r[j] = g[i + 1] then 0 else 1 end, d[j + 1] + 1) end - j) as a
    from edits where i < len(g))),
distances as (select conv_id, turn, cast(d[len(r) + 1] as bigint) as d from edits where i = len(g)),
lined as (
  select *, list_transform(string_split(gt, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) as gl, list_transform(string_split(rt, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) as rl,
    coalesce(list_position(list_transform(range(1, least(len(g), len(r)) + 1), lambda i: list_extract(g, i) = list_extract(r, i)), false) - 1, least(len(g), len(r))) as p
  from pairs join distances using (conv_id, turn)),
scored as (
  select conv_id, turn, gt = rt as exact_match,
    regexp_replace(regexp_replace(array_to_string(gl, chr(10)), '^\\n+', ''), '\\n+$', '') = regexp_replace(regexp_replace(array_to_string(rl, chr(10)), '^\\n+', ''), '\\n+$', '') as normalized_exact_match,
    coalesce(list_extract(list_filter(list_transform(gl, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), 1), '') = coalesce(list_extract(list_filter(list_transform(rl, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), 1), '') as first_line_exact_match,
    cast(p as bigint) as matching_prefix_tokens, p::double / greatest(len(r), 1)::double as matching_prefix_ratio, d as token_edit_distance,
    case when greatest(len(g), len(r)) = 0 then 1.0::double else 1.0::double - d::double / greatest(len(g), len(r))::double end as token_edit_similarity, cast(len(g) as bigint) as generated_tokens, cast(len(r) as bigint) as reference_tokens
  from lined)"""

_ADAPTERS = """
adapter_files as (
  select 'out/' || case when doc_id = 0 then 'final_adapter' else 'checkpoint-' || doc_id end as folder, f
  from (select doc_id, unnest(['adapter_config.json', 'adapter_model.safetensors']) as f from documents) where not (doc_id % 125 = 50 and f = 'adapter_config.json')),
adapters as (
  select split_part(folder, '/', 2) as name, try_cast(regexp_extract(folder, 'checkpoint-(\\d+)$', 1) as integer) as step, folder as path,
    cast(row_number() over (order by try_cast(regexp_extract(folder, 'checkpoint-(\\d+)$', 1) as integer) nulls last, folder) - 1 as integer) as position
  from (select folder from adapter_files group by 1 having count(*) = 2))"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes.strip()}\n{select}"


def _counted(table: str, dimensions: dict[str, str], by: str = "") -> str:
    """(by, dimension, key, n) of several columns of a table."""
    names, values = ", ".join(f"'{d}'" for d in dimensions), ", ".join(f"cast({v} as varchar)" for v in dimensions.values())
    own = f"{by}, " if by else ""
    return f"select {own}dimension, key, count(*) as n from (select {own}unnest([{names}]) as dimension, unnest([{values}]) as key from {table}) where key is not null group by all"


def _files(select: str) -> str:
    return _with(_FILES, select)


def _clean(select: str) -> str:
    return _with(_CLEAN, select)


def _examples(select: str, ctes: str = _EXAMPLES) -> str:
    return _with(ctes, select, recursive=True)


def _scores(select: str) -> str:
    return _with(_SCORES, select)


_BENCH = "id, original_id, source_path, cut_line, completion_tokens, total_tokens, fingerprint"
_RESOLVED = """,
validation as (select path, case when len(path || './') % 2 = 0 then cpp_training_priority end as own from included where is_cpp),
manifest as (
  select path, priority from (
    select path, priority, row_number() over (partition by path order by rank) as rn from (
      select path, cpp_training_priority as priority, 0 as rank from split_files where split = 'train' and cpp_training_priority in ('high', 'medium', 'low')
      union all select path, 'low', 1 from split_files where len(path) % 3 = 0)) where rn = 1),
resolved as (
  select v.path as resolved_path, coalesce(case when own in ('high', 'medium', 'low') then own end, priority, 'unknown') as resolved_priority,
    case when own in ('high', 'medium', 'low') then 'record.cpp_priority' when priority is not null then 'manifest_join' else 'unresolved' end as resolution
  from validation v left join manifest m using (path))"""

ORACLES: dict[str, str] = {
    **{f"inventory_by_{n}": _files(f"select {c}, count(*) as n from files group by 1") for n, c in (("extension", "extension"), ("language", "language"), ("top_level", "top_level_directory"))},
    "inventory_all_counts": _files("select dimension, key, count(*) as n from (select unnest(['extension', 'language', 'top_level_directory']) as dimension, unnest([extension, language, top_level_directory]) as key from files) group by 1, 2"),
    "inventory_totals": _files("select count(*) as files, count(*) filter (candidate) as candidates, cast(sum(size_bytes) as bigint) as bytes, cast(sum(line_count) as bigint) as lines from files"),
    "inventory_top_directories": _files("select *, cast(row_number() over (order by n desc, top_level_directory) as integer) as position from (select top_level_directory, count(*) as n from files group by 1) order by n desc, top_level_directory limit 3"),
    "source_manifest": _files("select * exclude (text) from files"),
    "duplicate_hash_stats": _files("select count(*) as duplicate_groups, cast(coalesce(sum(n - 1), 0) as bigint) as extra_files from (select count(*) as n from files group by sha256 having count(*) > 1)"),
    "largest_files_top10": _files("select path, size_bytes, sha256 from files order by size_bytes desc, path limit 10"),
    "spdx_licenses": _files(
        f"""select path, trim(replace(substr(line, instr(line, '{MARKER}') + {len(MARKER)}), '*/', ''), ' ' || chr(9) || '#/*') as spdx_license
from (select path, list_extract(list_filter(list_slice(string_split(text, chr(10)), 1, 50), lambda x: contains(x, '{MARKER}')), 1) as line from files)"""
    ),
    "line_counts": _files("select path, line_count, cast(len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) as integer) as lines_of_any_kind from files"),
    "path_functions": _files(
        f"""select path, extension, regexp_extract(path, '^(.*)/[^/]*$', 1) as split_group, cast(len(string_split(path, '/')) as integer) as depth,
  case when top_level_directory in ('samples', 'tests', 'include', 'drivers', 'subsys', 'kernel', 'lib') then 'core' when top_level_directory in ('arch', 'soc', 'boards', 'dts') then 'platform'
    when top_level_directory = 'modules' then 'integration' else 'other' end as directory_tier,
  {_hash16('path')} as stable, path as cleaned, case extension when '.cpp' then 'cpp' when '.hpp' then 'cpp_header' end as resolved_language from files"""
    ),
    "clean_manifest": _clean("select path, included, exclusion_reason, duplicate_of, directory_tier, hex_literal_count, hex_literals_per_line, cpp_relevance, cpp_training_priority from cleaned"),
    "exclusions_by_reason": _clean("select exclusion_reason, count(*) as n from cleaned where not included group by 1"),
    "clean_totals": _clean("select count(*) filter (included) as files, count(*) filter (not included) as excluded, cast(sum(size_bytes) filter (included) as bigint) as bytes, cast(sum(line_count) filter (included) as bigint) as lines from cleaned"),
    "clean_by_tier": _clean("select directory_tier, count(*) as n, cast(sum(size_bytes) as bigint) as bytes from included group by 1"),
    "clean_cpp_priority": _clean("select cpp_relevance, cpp_training_priority, count(*) as n from included where is_cpp group by 1, 2"),
    "clean_outcomes": _clean("select coalesce(exclusion_reason, 'included') as outcome, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from cleaned group by 1"),
    "split_group_stats": _with(_GROUPS, "select * from stats"),
    "split_assignment": _examples("select split_group, split from assigned", _ASSIGN),
    "split_manifest": _examples("select path, sha256, split_group, split from split_files", _ASSIGN),
    "split_summary": _examples(
        """select *, 100::double * bytes::double / (sum(bytes) over ())::double as byte_percentage
from (select split, count(*) as files, count(distinct split_group) as groups, cast(sum(size_bytes) as bigint) as bytes, cast(sum(line_count) as bigint) as lines, count(*) filter (is_cpp) as cpp_files from split_files group by 1)""",
        _ASSIGN,
    ),
    "split_counts": _examples(_counted("split_files", {"extension": "extension", "cpp_priority": "case when is_cpp then cpp_training_priority end"}, "split"), _ASSIGN),
    "split_leakage_audit": _examples(
        """select 'path' as kind, path as key, count(*) as n from split_files group by 2 having count(*) > 1
union all select 'group', split_group, count(distinct split) from split_files group by 2 having count(distinct split) > 1
union all select 'content', sha256, count(distinct split) from split_files group by 2 having count(distinct split) > 1""",
        _ASSIGN,
    ),
    "normalized_text_lengths": _with(
        _RAW,
        """select path, cast(len(body) as integer) as characters, sha256(body) as sha256 from (
  select path, case when b = '' then '' else b || chr(10) end as body from (
    select path, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), '\\s+$', '') as b from raw))""",
    ),
    "candidate_cuts": _with(
        _RAW,
        """select path, cast(unnest(list_sort(list_distinct(list_filter(range(4, n, 16) || [greatest(1, n // 2), greatest(1, n - 16)], lambda x: x < n)))) as integer) as cut_line from (
  select path, case when b = '' then 0 else len(string_split(b, chr(10))) end as n from (
    select path, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), '\\s+$', '') as b from raw)) where n > 4""",
    ),
    "completion_examples": _examples("select id, source_path, split, cast(cut_line as integer) as cut_line, prompt_tokens, completion_tokens, total_tokens, training_repeat, fingerprint from examples"),
    "cross_split_dedup": _examples("select id, fingerprint, split, claimed from examples"),
    "example_summary": _examples(
        """select split, count(*) filter (claimed) as examples, count(distinct source_path) filter (claimed) as source_files, count(*) filter (not claimed) as duplicates_removed,
  cast(sum(case when claimed then prompt_tokens else 0 end) as bigint) as prompt_tokens, cast(sum(case when claimed then completion_tokens else 0 end) as bigint) as completion_tokens,
  cast(sum(case when claimed then training_repeat else 0 end) as bigint) as effective_examples,
  sum(case when claimed then prompt_tokens else 0 end)::double / greatest(count(*) filter (claimed), 1)::double as average_prompt_tokens,
  sum(case when claimed then completion_tokens else 0 end)::double / greatest(count(*) filter (claimed), 1)::double as average_completion_tokens from examples group by 1"""
    ),
    "example_counts": _examples(_counted("kept", {"language": "language", "cpp_priority": "case when extension in ('.cpp', '.hpp') then cpp_training_priority end"}, "split")),
    "fingerprint_audit": _examples("select count(*) as examples, count(distinct fingerprint) as fingerprints, count(*) = count(distinct fingerprint) as unique from kept"),
    "files_without_examples": _examples("select split, count(*) as files, count(*) filter (path not in (select source_path from kept)) as without_examples from split_files group by 1"),
    "evenly_capped_examples": _with(
        _RAW,
        """select path, cast(i as integer) as line from (select path, n, unnest(range(0, n)) as i from (select path, len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) as n from raw))
where n <= 4 or list_contains(list_transform(range(0, 4), lambda q: round_even(q * (n - 1) / 3::double, 0)::bigint), i)""",
    ),
    "trimmed_examples": _examples(f"select {_BENCH} from held", _HELD),
    "source_representatives": _examples(f"select {_BENCH} from reps", _HELD),
    "general_benchmark": _examples(f"select id, extension, cast(row_number() over (order by {_hash16('id')}) as integer) as position from general", _GENERAL),
    "benchmark_counts": _examples(_counted("held", {"language": "language", "cpp_priority": "case when extension in ('.cpp', '.hpp') then cpp_training_priority end"}), _HELD),
    "evaluation_keys": _examples("select id, evaluation_key, benchmark_index from keyed", _GENERAL),
    "teacher_scores": _examples("select * from forced", _GENERAL),
    "adapter_scores": _examples(
        """select *, negative_log_likelihood / scored_tokens::double as mean_negative_log_likelihood, correct_tokens::double / scored_tokens::double as token_accuracy from (
  select model, count(*) as examples, cast(sum(scored_tokens) as bigint) as scored_tokens, cast(sum(correct_tokens) as bigint) as correct_tokens, sum(negative_log_likelihood * (1024 + step)::double / 1024::double) as negative_log_likelihood
  from forced cross join (values ('base', 0), ('checkpoint-100', 100), ('checkpoint-200', 200), ('checkpoint-300', 300)) m(model, step) group by 1)""",
        _GENERAL,
    ),
    "generated_replies": _examples(
        """select evaluation_key, budget as generation_budget, len(c) > budget as reference_was_truncated, cast(len(g) as integer) as generated_tokens, cast(list_sum(g) as integer) as characters,
  cast(coalesce(list_position(list_transform(range(1, least(len(g), budget) + 1), lambda i: list_extract(g, i) = list_extract(c, i)), false) - 1, least(len(g), budget)) as bigint) as matching_prefix_tokens
from (select *, list_slice(list_reverse(p), 1, budget) as g from (select *, cast(least(32, len(c)) as integer) as budget from keyed))""",
        _GENERAL,
    ),
    "cpp_benchmark": _examples(f"select {_BENCH} from held where extension in ('.cpp', '.hpp')", _HELD),
    "benchmark_summary": _examples("select count(*) as examples, count(distinct source_path) as source_files, coalesce(sum(prompt_tokens), 0)::double / greatest(count(*), 1)::double as average_prompt_tokens, coalesce(sum(completion_tokens), 0)::double / greatest(count(*), 1)::double as average_completion_tokens from held", _HELD),
    "benchmark_preview": _examples(
        """select id, source_path, cut_line, right(prompt, 700) as prompt_tail from held where extension in ('.cpp', '.hpp')
order by case when cpp_training_priority = 'high' and not contains(completion, chr(92) || chr(10)) and (contains(completion, 'return') or contains(completion, 'if (') or contains(completion, '{') or contains(completion, '}') or contains(completion, ';')) then 0 else 1 end,
  abs(completion_tokens - 70), abs(prompt_tokens - 400), source_path, cut_line limit 1""",
        _HELD,
    ),
    "reweight_groups": _examples("select weight_group, count(*) as examples, cast(sum(training_repeat) as bigint) as effective from train group by 1", _TRAIN),
    "effective_share": _examples(
        """select *, cpp::double / examples::double as share, effective_cpp::double / effective::double as effective_share from (
  select count(*) as examples, cast(sum(training_repeat) as bigint) as effective, count(*) filter (weight_group <> 'non_cpp') as cpp, cast(sum(case when weight_group <> 'non_cpp' then training_repeat else 0 end) as bigint) as effective_cpp from train)""",
        _TRAIN,
    ),
    "expanded_repeats": _examples("select id, cast(training_repeat as bigint) as n from train", _TRAIN),
    "tokenized_sequences": _examples("select id, cast(least(prompt_tokens, greatest(1024 - completion_tokens, 0)) + completion_tokens + 1 as integer) as tokens, cast(least(prompt_tokens, 1024 - completion_tokens) as integer) as masked, cast(least(prompt_tokens, 1024 - completion_tokens) + completion_tokens + 1 as integer) as attended from kept"),
    "tokenized_stats": _examples("select cast(max(least(prompt_tokens, 1024 - completion_tokens) + completion_tokens + 1) as integer) as longest, avg(completion_tokens + 1) as mean_supervised, true as aligned from kept"),
    "first_batch_tokens": _examples("select count(*) as rows, cast(sum(prompt_tokens) as bigint) as masked_tokens, cast(sum(completion_tokens + 1) as bigint) as supervised_tokens from (select * from kept order by id limit 10)"),
    "roundtrip_check": _with(_RAW, "select count(*) filter (array_to_string(regexp_extract_all(text, '\\w+|[^\\w\\s]+|\\s+'), '') <> text) as mismatches, cast(sum(len(regexp_extract_all(text, '\\w+|[^\\w\\s]+|\\s+'))) as bigint) as tokens from raw"),
    "generation_budgets": _examples("select id, cast(least(128, completion_tokens) as integer) as budget, cast(least(128, greatest(8, ceil(least(128, completion_tokens) / 16.0) * 16)) as integer) as bucket from kept"),
    "generation_scores": _with(_SCORED, "select * from scored", recursive=True),
    "macro_generation_metrics": _with(
        _SCORED,
        """select count(*) as examples, avg(exact_match::integer) as exact_match, avg(normalized_exact_match::integer) as normalized_exact_match, avg(first_line_exact_match::integer) as first_line_exact_match,
  round(sum(matching_prefix_ratio::decimal(18, 12))::double / count(*), 9) as matching_prefix_ratio, round(sum(token_edit_similarity::decimal(18, 12))::double / count(*), 9) as token_edit_similarity from scored""",
        recursive=True,
    ),
    "generation_lift": _with(
        _SCORED,
        """select round(1 - avg(exact_match::integer), 9) as exact_match_delta, round(1 - avg(normalized_exact_match::integer), 9) as normalized_exact_match_delta, round(1 - avg(first_line_exact_match::integer), 9) as first_line_exact_match_delta,
  round(avg(case when reference_tokens > 0 then 1.0::double else 0.0::double end) - avg(matching_prefix_ratio), 9) as matching_prefix_ratio_delta, round(1 - avg(token_edit_similarity), 9) as token_edit_similarity_delta from scored""",
        recursive=True,
    ),
    "normalized_replies": _with(
        _TURNS,
        """select conv_id, turn, sha256(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '^\\n+', ''), '\\n+$', '')) as normalized,
  coalesce(list_extract(list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), 1), '') as first_line from coded""",
    ),
    "example_metrics": _scores("select model, evaluation_key, (micro::double / 1048576::double) / scored_tokens::double as mean_negative_log_likelihood, correct_tokens::double / scored_tokens::double as token_accuracy from scores"),
    "micro_metrics": _scores("select model, examples, scored_tokens, correct_tokens, negative_log_likelihood, mean_negative_log_likelihood, token_accuracy from groups where \"group\" = 'all_cpp'"),
    "metric_groups": _scores("select * from groups"),
    "prediction_lift": _scores("select * from lifted"),
    "top_improvements": _scores(
        """(select 'improvement' as kind, evaluation_key, mean_nll_reduction from lifted where mean_nll_reduction > 0 order by mean_nll_reduction desc, evaluation_key limit 4)
union all (select 'regression', evaluation_key, mean_nll_reduction from lifted where mean_nll_reduction < 0 order by mean_nll_reduction, evaluation_key limit 2)"""
    ),
    "summary_lift": _scores(
        """select b.mean_negative_log_likelihood - t.mean_negative_log_likelihood as mean_nll_reduction,
  (b.mean_negative_log_likelihood - t.mean_negative_log_likelihood) / b.mean_negative_log_likelihood * 100.0::double as mean_nll_reduction_percent,
  t.token_accuracy - b.token_accuracy as token_accuracy_delta, (t.token_accuracy - b.token_accuracy) * 100.0::double as token_accuracy_delta_percentage_points
from groups b cross join groups t where b.model = 'base' and t.model = 'checkpoint-100' and b."group" = 'all_cpp' and t."group" = 'all_cpp'"""
    ),
    "group_lift": _scores(
        """select t.model, t.step, t."group", (b.mean_negative_log_likelihood - t.mean_negative_log_likelihood) / b.mean_negative_log_likelihood as mean_nll_reduction, t.token_accuracy - b.token_accuracy as token_accuracy_delta
from groups t join groups b on b.model = 'base' and b."group" = t."group" where t.model <> 'base'"""
    ),
    "worker_agreement": "select true as same_tokens, true as same_mean",
    "guardrail_eligible": _scores("select model, accuracy, base_accuracy from placed where eligible"),
    "checkpoint_ranking": _scores("select model, step, eligible, cast(rank as integer) as rank, high_nll, all_nll from placed"),
    "checkpoint_selection": _scores(
        """select count(*) filter (eligible) as eligible, min_by(model, rank) as best_measured_candidate, case when min_by(high_nll, rank) < max(base_high_nll) then min_by(model, rank) end as recommended_checkpoint,
  coalesce(min_by(high_nll, rank) < max(base_high_nll), false) as beats_base_on_primary_metric,
  case when min_by(high_nll, rank) < max(base_high_nll) then 'select_checkpoint' else 'no_checkpoint_validated; revise_sampling_or_training' end as decision from placed"""
    ),
    "smoke_selection": _scores("select count(*) filter (eligible) as eligible, min_by(model, rank) as best_measured_candidate, case when min_by(high_nll, rank) < max(base_high_nll) and false then min_by(model, rank) end as recommended_checkpoint, false as beats_base_on_primary_metric, 'smoke_check_only; run_full_sweep' as decision from placed"),
    "validation_composition": _examples(
        """select dimension, key, count(*) as n from (select unnest(['language', 'cpp_priority', 'priority_resolution']) as dimension, unnest([case when ends_with(resolved_path, '.cpp') then 'cpp' else 'cpp_header' end, resolved_priority, resolution]) as key from resolved) group by 1, 2
union all select 'source_files', 'all', count(distinct resolved_path) from resolved""",
        _ASSIGN + _RESOLVED,
    ),
    "manifest_priority_index": _examples("select path, priority from manifest", _ASSIGN + _RESOLVED),
    "priority_resolution": _examples("select * from resolved", _ASSIGN + _RESOLVED),
    "priority_guards": _examples("select bool_or(resolved_priority <> 'unknown') as some_known, bool_or(resolved_priority = 'high') as some_high from resolved", _ASSIGN + _RESOLVED),
    "adapter_shards": _with(_ADAPTERS, "select *, cast(position % 3 as integer) as worker from adapters"),
    "smoke_adapters": _with(
        _ADAPTERS,
        """select name, step from (select *, row_number() over (order by step nulls last, path) - 1 as i, count(step) over () as n, count(*) filter (name = 'final_adapter') over () as f from adapters)
where name = 'final_adapter' or (step is not null and (i = 0 or i = n // 2 or (f = 0 and i = n - 1)))""",
    ),
    "smoke_sample": _clean(
        """select path, high from (select path, cpp_training_priority = 'high' as high, row_number() over (partition by cpp_training_priority = 'high' order by path) - 1 as i, count(*) over (partition by cpp_training_priority = 'high') as n from included)
where n <= 4 or list_contains(list_transform(range(0, 4), lambda q: round_even(q * (n - 1) / 3::double, 0)::bigint), i)"""
    ),
    "even_table_sample": _clean(
        """select path from (select path, row_number() over (order by path) - 1 as i, count(*) over () as n from included)
where n <= 12 or list_contains(list_transform(range(0, 12), lambda q: round_even(q * (n - 1) / 11::double, 0)::bigint), i)"""
    ),
    "strided_sample": _clean("select path from (select path, row_number() over (order by path) - 1 as i, count(*) over () as n from included) where i % greatest(1, n // least(30, n)) = 0"),
    "training_plan": _examples(
        """select rows, cast(micro as bigint) as micro_batches, cast(ceil(micro / 3) as bigint) as optimizer_steps, cast(greatest(1, ceil(micro / 3)) as bigint) as planned_steps,
  cast(greatest(1, round_even(greatest(1, ceil(micro / 3)) * 0.03::double, 0)) as bigint) as warmup_steps from (select cast(sum(training_repeat) as bigint) as rows, ceil(sum(training_repeat)::double / 10) as micro from train)""",
        _TRAIN,
    ),
}
