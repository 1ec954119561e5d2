"""DuckDB SQL of the registered queries, over the driver's tables."""

from __future__ import annotations

from trailmill.functions import fixed


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {quoted(pattern)}, '{'i' if ignore_case else 'c'}')"


#: Shell commands for the query about reads: plain ones, chains and pipes, prefixes, redirects, listings, and such as change or follow something.
COMMANDS = [
    "jq .items data/list.json | sort | uniq", "sort names.txt > sorted.txt", "printf done >> notes.md", "md5sum dist/app.bin 2>&1", "find lib -name '*.ts' 2>/dev/null", "stat package.json", "tail -n 3 logs/today.txt",
    "LC_ALL=C B=2 timeout 9s egrep -c todo lib; git diff --stat", "ls -hl lib", "ls lib", "sed --in-place s/x/y/ conf.ini", "sed 4q conf.ini", "jq .script pkg.json | bash", "uniq names.txt | tee again.txt", "   ", "tree lib && dirname lib/x",
    "git blame lib/x.ts", "git commit -m done", "kubectl logs pod-7", "basename lib/x.ts", "make all", "realpath lib || cut -d, -f2 t.csv", "command head -2 t.csv", "df -h", "tr a-z A-Z < t.csv", "file lib/x.ts\nsha1sum lib/x.ts", "cat server.out",
]

CALLS = """
calls as (
  with e as (
    select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as k, md5(cast(event_id as varchar)) as h from events
  ), p as (select e.*, lag(h, 2) over (partition by user_id order by k) as h2 from e)
  select cast(user_id as varchar) as session, cast(k as bigint) as k, concat('toolu_', cast(event_id as varchar)) as tool_use_id,
    case event_type when 'view' then 'Read' when 'signup' then 'Grep' else 'Bash' end as tool,
    case event_type
      when 'view' then concat('{"file_path":"/repo/src/mod_', cast(event_id % 97 as varchar), '.rs"}')
      when 'signup' then concat('{"pattern":"w', cast(event_id % 13 as varchar), '"}')
      when 'error' then concat('{"command":"cargo test -p svc', cast(event_id % 7 as varchar), '"}')
      when 'click' then concat('{"command":"curl -s http://svc', cast(event_id % 7 as varchar), '/health"',
        case when k % 3 = 0 and h2 is not null then concat(',"description":"check req-', substr(h2, 1, 10), '"') else '' end, '}')
      else concat('{"command":"./deploy.sh svc', cast(event_id % 7 as varchar), '"}') end as input_json,
    concat('HTTP/1.1 503 request_id=req-', substr(h, 1, 10), chr(10),
      array_to_string(list_transform(string_split(coalesce(d.text, ''), chr(10)), lambda x, i: case when i % 4 = 0 then concat(x, chr(10), 'error: step ', cast(i as varchar),
        ' failed id=', substr(h, cast(1 + i % 20 as bigint), 8), ' in ', cast(event_id % 900 as varchar), 'ms') else x end), chr(10)),
      chr(10), 'pid ', cast(10000 + event_id % 80000 as varchar), ' exit code ', cast(event_id % 3 as varchar)) as result_text,
    event_type = 'error' as is_error, event_id
  from p left join documents d on d.doc_id = event_id % (select max(doc_id) + 1 from documents)
)"""
PROMPTS = """
prompts as (
  select cast(user_id as varchar) as session, concat(coalesce(said, ''), ' Start from req-', substr(md5(cast(event_id as varchar)), 1, 10), '.') as text
  from (select user_id, min(event_id) as event_id from events group by user_id) e
  left join (select conv_id, arg_min(text, turn) as said from conversations where role = 'user' group by conv_id) c
    on c.conv_id = e.user_id % (select max(conv_id) + 1 from conversations)
)"""


def tokens(text: str) -> str:
    """Distinct candidate tokens of a text."""
    digit = f"list_transform(list_filter(regexp_extract_all({text}, {quoted(fixed.DIGIT_TOKEN)}), lambda t: regexp_matches(t, '[0-9]')), lambda t: rtrim(t, '.:,'))"
    word = (
        f"list_transform(list_filter(regexp_extract_all({text}, {quoted(fixed.WORD_TOKEN)}), lambda t: regexp_matches(t, '[/_.]') "
        "and not regexp_matches(t, '[0-9]') and length(rtrim(t, '.:,')) >= 8), lambda t: rtrim(t, '.:,'))"
    )
    return f"list_distinct(list_concat({digit}, {word}))"


def estimate(text: str) -> str:
    cost = "case when regexp_matches(t, '^[A-Za-z]') then cast(1 + (length(t) - 1) // 6 as double) when regexp_matches(t, '^[0-9]') then length(t) / 2.0::double else 0.9::double end"
    runs = f"list_transform(regexp_extract_all({text}, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'), lambda t: {cost})"
    return f"cast(ceil(list_reduce(list_prepend(0.0::double, {runs}), lambda a, x: a + x)) as bigint)"


def score(line: str) -> str:
    return "case when length({0}) = 0 then 0 else {1} end".format(line, " + ".join(f"cast({has(line, p, i)} as int)" for p, i in fixed.FACT_PATTERNS))


INTRODUCED = f"""
introduced as (
  select session, token, min(2 * k) as introduced from (select session, k, unnest({tokens('result_text')}) as token from calls) group by session, token
)"""
USED = f"used as (select distinct session, 2 * k - 1 as used, token from (select session, k, unnest({tokens('input_json')}) as token from calls))"
FACTS = f"""{CALLS}, {INTRODUCED}, {USED},
facts as (select i.session, i.token, i.introduced, u.used from introduced i join used u on u.session = i.session and u.token = i.token and i.introduced < u.used)"""
SIZES = "sizes as (select session, 2 * max(k) + 1 as messages from calls group by session)"
LABELS = f"""{FACTS}, {SIZES}, cuts as (select session, messages, cast(round(messages * f) as bigint) as cut from sizes, (values (0.5), (0.75)) v(f)),
valid as (select * from cuts where cut >= 2 and cut < messages),
needed as (select distinct v.session, v.cut, c.tool_use_id from valid v join facts f on f.session = v.session and f.introduced < v.cut and f.used >= v.cut
  join calls c on c.session = f.session and 2 * c.k = f.introduced),
again as (select distinct v.session, v.cut, c.tool, c.input_json from valid v join calls c on c.session = v.session and 2 * c.k - 1 >= v.cut),
later as (select v.session, v.cut, string_agg(c.input_json, chr(10)) as text from valid v join calls c on c.session = v.session and 2 * c.k - 1 >= v.cut group by 1, 2),
judged_by_use as (select v.session, v.cut, c.tool_use_id, c.k, n.tool_use_id is not null or a.tool is not null as keep_result,
    len(list_filter({tokens('c.input_json')}, lambda t: contains(coalesce(l.text, ''), t))) > 0 as named
  from valid v join calls c on c.session = v.session and 2 * c.k - 1 < v.cut
  left join needed n on n.session = v.session and n.cut = v.cut and n.tool_use_id = c.tool_use_id
  left join again a on a.session = v.session and a.cut = v.cut and a.tool = c.tool and a.input_json = c.input_json
  left join later l on l.session = v.session and l.cut = v.cut),
labels as (select session, cut, tool_use_id, k, keep_result, keep_result or named as keep_call from judged_by_use),
records as (select session, cut, tool_use_id, kind, case when kind = 'call' then keep_call else keep_result end as truth,
    substr(sha256(concat(session, '|Some(', cast(cut as varchar), ')|', tool_use_id, '|', kind, '|hindsight')), 1, 12) as record_id,
    case when cast(('0x' || substr(sha256(session), 1, 2)) as bigint) < 0.1 * 256 then 'dev' else 'train' end as split
  from labels, (values ('call'), ('result')) v(kind) where 2 * k < cut and 2 * k + 6 < cut)"""

DECISION = """case when pinned then 'pinned' when reduced then 'reduced' when keep_result >= 0.5 then 'kept'
  when keep_call >= 0.5 then 'result_dropped' else 'call_dropped' end"""
JUDGED = f"""{CALLS}, {SIZES}, judged as (
  select c.session, c.tool_use_id, c.tool, c.k, 2 * c.k + 6 >= s.messages as pinned, c.event_id % 17 = 0 as reduced,
    cast(('0x' || substr(md5(c.tool_use_id), 1, 2)) as bigint) / 255.0::double as keep_result, cast(('0x' || substr(md5(c.tool_use_id), 3, 2)) as bigint) / 255.0::double as keep_call,
    length(c.input_json) as input_chars, length(c.result_text) as result_chars
  from calls c join sizes s on s.session = c.session)"""
GRID = "grid as (select c_custkey as id, case when c_custkey % 11 = 0 then null else c_custkey * 997 % 200000 end as tokens, case when c_custkey % 7 = 0 then null else 50000 * (c_custkey % 4) end as win, case when c_custkey % 5 = 0 then null else c_custkey * 331 % 180000 end as baseline, (c_custkey % 3) * 40 as pct, (c_custkey % 4) * 30000 as absolute from customer)"

#: The linear part of the token value model, over the columns of `f`.
_FEATURES = [
    "cast(regexp_matches(token, '[0-9]') as double)", "cast(regexp_matches(token, '[/\\\\]') as double)", "cast(regexp_matches(token, '\\.[A-Za-z]{1,5}$') as double)",
    "cast(regexp_matches(token, '^[0-9a-f]{8,}$', 'i') as double)", "ln(length(token))", "length(regexp_replace(token, '[^0-9]', '', 'g')) / length(token)",
    "ln(1 + (length(x) - length(replace(x, token, ''))) / length(token))", "cast(contains(input_json, token) as double)", "cast(contains(prompt, token) as double)", "ln(1 + distance)",
    "(strpos(x, token) - 1) / length(x)", "ln(length(x))", "cast(again as double)",
]
VALUE = " + ".join([repr(fixed.INTERCEPT), *(f"{b!r} * ({x} - {m!r}) / {d!r}" for x, m, d, b in zip(_FEATURES, fixed.MEANS, fixed.DEVIATIONS, fixed.COEFFICIENTS))])

SQL: dict[str, str] = {
    "facts_reused": f"with {FACTS} select session, token, cast(introduced as bigint) as introduced, cast(used as bigint) as used from facts",
    "facts_at_cut": f"with {LABELS} select v.session, cast(v.cut as bigint) as cut, count(distinct f.token) as at_stake from valid v join facts f on f.session = v.session and f.introduced < v.cut and f.used >= v.cut group by v.session, v.cut",
    "hindsight_labels": f"with {LABELS} select session, cast(cut as bigint) as cut, tool_use_id, keep_result, keep_call from labels",
    "call_pairs": f"with {CALLS}, {SIZES} select c.session, concat('t', cast(row_number() over (partition by c.session order by c.k) as varchar)) as id, c.tool_use_id, c.tool, cast(2 * c.k - 1 as bigint) as call_index, cast(2 * c.k as bigint) as result_index, cast(length(c.result_text) as bigint) as result_chars, c.is_error, 2 * c.k + 6 >= s.messages as pinned from calls c join sizes s on s.session = c.session",
    "candidates": f"with {JUDGED} select session, tool_use_id from judged where not pinned and keep_result < 0.9",
    "token_estimate": f"select doc_id, {estimate('text')} as tokens from documents",
    "token_estimate_by_session": f"with {CALLS} select session, cast(sum({estimate('input_json')} + {estimate('result_text')}) as bigint) as tokens, cast(sum(length(input_json) + length(result_text)) as bigint) as chars from calls group by session",
    "fact_score_hist": f"with {CALLS}, lines as (select unnest(string_split(result_text, chr(10))) as line from calls) select cast({score('line')} as int) as score, count(*) as lines from lines group by 1",
    "fact_tokens": f"select doc_id, array_to_string(list_sort({tokens('text')}), ' ') as tokens from documents",
    "value_contexts": f"""with {CALLS}, {PROMPTS}, {INTRODUCED}, {USED}, reused as (select distinct i.session, i.token from introduced i join used u on u.session = i.session and u.token = i.token and i.introduced < u.used)
      select c.session, c.tool_use_id, c.input_json as last_input, p.text as prompt, row_number() over (partition by c.session order by c.k desc) as distance,
        (select count(*) from reused r where r.session = c.session) as reused from calls c join prompts p on p.session = c.session""",
    "token_values": f"""with {CALLS}, {PROMPTS}, {INTRODUCED}, {USED}, reused as (select distinct i.session, i.token from introduced i join used u on u.session = i.session and u.token = i.token and i.introduced < u.used),
      r as (select c.session, c.tool_use_id, c.input_json, c.result_text as x, p.text as prompt, row_number() over (partition by c.session order by c.k desc) as distance from calls c join prompts p on p.session = c.session),
      t as (select *, unnest({tokens('x')}) as token from r), f as (select t.*, u.token is not null as again from t left join reused u on u.session = t.session and u.token = t.token)
      select session, tool_use_id, token, round(1 / (1 + exp(-({VALUE}))), 6) as p from f""",
    "goal_prompts": """with p as (select conv_id, turn, substr(text, 1, 500) as text, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'user' and trim(text) <> ''),
      g as (select conv_id, string_agg(text, chr(10) order by turn) as goal from p where n <= 3 group by conv_id)
      select distinct c.conv_id, coalesce(goal, '') as goal from conversations c left join g using (conv_id)""",
    "observation_reads": f"with {CALLS} select session, tool_use_id, {has('result_text', fixed.OBSERVATION, True)} as observed from calls where tool in ('Read', 'Grep')",
    "abridged_texts": "select doc_id, case when length(text) <= 590 then text else concat(left(text, 400), chr(10), '[… ', cast(length(text) - 550 as varchar), ' chars omitted …]', chr(10), right(text, 150)) end as short from documents",
    "truncated_inputs": f"with {CALLS} select tool_use_id, case when length(input_json) <= 40 then input_json else concat(left(input_json, 39), '…') end as shown from calls",
    "judged_decisions": f"with {JUDGED} select session, tool_use_id, {DECISION} as reason, case when {DECISION} in ('pinned', 'kept') then 'keep' when {DECISION} = 'call_dropped' then 'drop_call' else 'drop_result' end as action from judged",
    "rules_decisions": f"with {JUDGED} select session, case when pinned then 'pinned' when reduced then 'reduced' else 'rules' end as reason, count(*) as calls from judged group by 1, 2",
    "erase_baseline": f"""with {JUDGED}, {PROMPTS}, d as (select *, case when pinned or keep_result >= 0.5 then 'keep' when keep_call >= 0.5 then 'drop_result' else 'drop_call' end as action from judged),
      e as (select session, input_chars + result_chars as n, case action when 'keep' then input_chars + result_chars when 'drop_call' then 0 else input_chars + case when result_chars > 420
        then 300 + length(concat('x[condensed: truncated ', cast(result_chars - 300 as varchar), ' chars of this tool result; run the tool again if needed]')) else result_chars end end as left_over from d)
      select session, cast(sum(n) + any_value(length(p.text)) as bigint) as chars_before, cast(sum(left_over) + any_value(length(p.text)) as bigint) as chars_after from e join prompts p using (session) group by session""",
    "session_taint": f"""with {CALLS}, hit as (select session, tool_use_id, k from calls where tool = 'Grep' and event_id % 53 = 0)
      select session, count(*) as hits, arg_min(tool_use_id, k) as first_call from hit group by session""",
    "sticky_taint": f"with {CALLS} select session, k, bool_or(tool = 'Grep' and event_id % 53 = 0) over (partition by session order by k) as tainted from calls",
    "trigger_grid": f"""with {GRID}, t as (select *, case when pct > 0 and win > 0 then floor(win * pct / 100.0::double) end as by_pct, case when absolute > 0 then cast(absolute as double) end as by_abs from grid),
      n as (select *, least(by_pct, by_abs) as threshold from t), g as (select *, coalesce(ceil(threshold / 4), 0) as gap from n),
      h as (select *, case when baseline > 0 then case when threshold is null then null else greatest(threshold, baseline + gap) end else threshold end as need from g)
      select id, threshold, gap, need, case when tokens is null then 'no_usage' when threshold is null or tokens < threshold then 'below_threshold' when tokens < need then 'hysteresis' else 'threshold' end as reason from h""",
    "nudge_grid": """with g as (select c_custkey as id, case when c_custkey % 17 = 0 then 'nan'::double when c_custkey % 19 = 0 then -100.0::double else cast(c_custkey * 37 % 4000 as double) end as ttl, cast(c_custkey * 11 % 2500 as double) as margin from customer),
      h as (select id, case when isnan(ttl) then null when ttl > 2 * margin then ttl - margin else ttl / 2 end as seconds from g)
      select id, cast(greatest(coalesce(round(seconds * 1000), 0), 0) as bigint) as delay_ms from h""",
    "pressure_grid": """with g as (select c_custkey as id, case when c_custkey % 9 = 0 then null else cast(c_custkey * 1013 % 240000 as double) end as tokens, cast(c_custkey * 577 % 150000 as double) as line, c_custkey * 733 % 160000 as est from customer),
      n as (select *, coalesce(tokens > 0 and line > 0 and est > 0, false) as ok, greatest(tokens - est, 0) as overhead from g)
      select id, round(case when ok then least(greatest(1 - (line * 5 / 6 - overhead) / est, 0.05), 0.9) else 0.3 end, 9) as target, round(case when ok then least(greatest(1 - (line - overhead) / est, 0), 0.9) else 0.3 end, 9) as hard,
        round(case when ok then least(greatest(1 - (line - overhead) / est, 0), 0.9) else 0.25 end, 9) as gate from n""",
    "verdict_grid": """with g as (select o_orderkey as id, o_orderkey % 2 = 0 as enabled, o_orderkey % 3 > 0 as credentials, o_orderkey % 5 = 0 as tainted, o_orderkey % 7 < 3 as near, o_orderkey % 11 < 6 as rules from orders)
      select id, case when not enabled then 'switched_off' when not credentials then 'no_key' when tainted and near then 'ok_local' when tainted then 'tainted' else 'ok' end as reason,
        case when not enabled then 'builtin' when not credentials or (tainted and not near) then case when rules then 'rules' else 'builtin' end else 'model' end as judge from g""",
    "split_assignment": f"with {CALLS} select distinct session, case when cast(('0x' || substr(sha256(session), 1, 2)) as bigint) < 0.1 * 256 then 'dev' else 'train' end as split from calls",
    "record_ids": f"with {LABELS} select session, cast(cut as bigint) as cut, tool_use_id, kind, truth, record_id from records",
    "dataset_counts": f"""with {LABELS} select 'counts' as what, concat(split, '/', case when truth then 'true' else 'false' end) as name, count(*) as n from records group by 1, 2
      union all select 'labels', concat(split, '/hindsight'), count(*) from records group by 1, 2
      union all select 'transcripts', s.split, count(distinct r.session) from (values ('train'), ('dev')) s(split) left join records r on r.split = s.split group by 1, 2""",
    "stub_ranking": f"with {CALLS} select session, count_if(event_id % 19 = 0) as stubbed, count_if(event_id % 19 = 0 and is_error) as broken from calls group by session order by broken desc, stubbed desc, session limit 12",
    "answers_capped": """with a as (select user_id, event_id % 40 as item, max(event_id) as event_id from events group by 1, 2),
      b as (select *, row_number() over (partition by user_id order by event_id desc) as place from a) select user_id, cast(item as bigint) as item, event_id from b where place <= 20""",
    "latest_decision": "select cast(user_id as varchar) as session, event_type as outcome, epoch_us(ts) // 1000 as ts_ms, strftime(ts, '%Y-%m-%d') as day from events order by ts desc limit 1",
    "keep_refs": f"""with {JUDGED}, d as (select *, not pinned and keep_result < 0.5 and keep_call >= 0.5 and result_chars > 100 as short from judged)
      select distinct session, 0::bigint as msg_idx, 0::bigint as keep, null::varchar as tool_use_id, null::bigint as chars from d
      union all select session, 2 * k - 1, 2 * k - 1, null, null from d
      union all select session, 2 * k, case when not short then 2 * k end, case when short then tool_use_id end, case when short then 100 end from d""",
    "sanitised_names": "with n as (select page_id, regexp_replace(left(url, 200), '[^A-Za-z0-9_.-]', '_', 'g') as x from pages) select page_id, case when x = '' then '_' else regexp_replace(x, '^[.]', '_') end as name from n",
    "utc_day_files": "select event_id, concat(strftime(case when event_id % 5 = 0 then timestamp '1970-01-01' else ts end, '%Y-%m-%d'), '.jsonl') as file from events",
    "transcripts_from_logs": f"with {CALLS} select session, cast(2 * k - 2 as bigint) as msg_idx, cast(2 * k - 1 as bigint) as answered, tool_use_id, tool, input_json, md5(result_text) as digest, is_error from calls",
    "chat_messages": """select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as bigint) as msg_idx, role, text from conversations where role <> 'system'
      union all select conv_id, -1, 'system', text from conversations where role = 'system'""",
    "sampled_sessions": f"""with {CALLS}, s as (select session, count(*) as n from calls group by session)
      select session, concat('cc-', left(sha256(session), 12)) as name, sha256(unhex('0000000000000000') || encode(session)) as place from s where n >= 15 order by place limit 40""",
    "gate_check": f"""with {JUDGED}, d as (select *, {DECISION} as reason from judged), t as (select cast(sum(input_chars + result_chars) as double) as before, cast(sum(case when reason in ('pinned', 'kept') then input_chars + result_chars else input_chars + least(result_chars, 200) end) as double) as after,
        count(*) as n, count_if(reason in ('pinned', 'kept')) as whole, count_if(reason <> 'call_dropped') as known from d),
      f as (select known / n as rate, whole / n as rate_erase, (before - after) / before as reduction from t),
      c as (select 'fact_rate' as name, rate as x, 0.7::double - 0.005::double as least from f union all select 'reduction', reduction, 0.3::double - 0.005::double from f union all select 'erase_rule', rate, rate_erase from f)
      select name as "check", round(x, 9) as figure, round(least, 9) as at_least, x >= least as pass from c""",
    "tier_fact_loss": f"""with {CALLS}, v as (select tool_use_id, result_text as t, case when length(result_text) <= 590 then result_text
        else concat(left(result_text, 400), chr(10), '[… ', cast(length(result_text) - 550 as varchar), ' chars omitted …]', chr(10), right(result_text, 150)) end as short from calls),
      n as (select tool_use_id, list_distinct(regexp_extract_all(t, {quoted('(?i)' + fixed.FACT_TOKEN)})) as a, regexp_extract_all(short, {quoted('(?i)' + fixed.FACT_TOKEN)}) as b from v)
      select tool_use_id, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as bigint) as lost from n""",
    "next_fit_batches": f"""with recursive {CALLS}, c as (select session, k, tool_use_id, {estimate('input_json')} as cost from calls),
      f as (select *, row_number() over (partition by session order by k) as n from c where cost <= 60),
      r as (select session, n, k, cost as used, 0::bigint as request from f where n = 1
        union all select f.session, f.n, f.k, case when r.used + f.cost > 60 then f.cost else r.used + f.cost end, r.request + case when r.used + f.cost > 60 then 1 else 0 end from r join f on f.session = r.session and f.n = r.n + 1)
      select c.session, c.tool_use_id, r.request from c left join r on r.session = c.session and r.k = c.k""",
    "scope_grid": """with g as (select event_id as id, case when event_id % 5 = 0 then '' when event_id % 5 = 1 then 'agent' end as agent, case when event_id % 3 = 0 then 'precompute' else 'auto' end as trigger, case when event_id % 2 = 0 then 'answer' else 'tool' end as reason from events)
      select id, case when coalesce(agent, '') <> '' then 'subagent' when trigger = 'precompute' then 'precompute' else 'main' end as scope, coalesce(agent, '') = '' and reason = 'answer' as may_trigger from g""",
    "expired_keys": """with k as (select user_id, concat(case when event_id % 2 = 0 then 'taint:' when event_id % 3 = 0 then 'baseline:' else 'other:' end, cast(event_id as varchar)) as key, case when event_id % 13 = 0 then null else event_id * 1000 end as seen_at from events)
      select key from k where (key like 'taint:%' or key like 'baseline:%') and (seen_at is null or 9000000 - seen_at > 5000000)""",
    "judge_probability": "select event_id, round(1 / (1 + exp(cast(event_id % 7 as double) - cast(event_id % 11 as double) / 2)), 9) as p from events",
    "metadata_shape": f"""with {CALLS} select tool_use_id, concat('{{"kind":"object","keys":["', array_to_string(list_sort(json_keys(input_json)), '","'), '"],"chars":', cast(length(input_json) as varchar), '}}') as shape from calls""",
    "first_taint": f"with {CALLS} select session, min(k) as first_k, arg_min(tool_use_id, k) as first_call from calls where tool = 'Grep' and event_id % 53 = 0 group by session",
    "stub_layouts": f"""with {CALLS}, s as (select tool_use_id, result_text as t, length(result_text) as n, case when is_error then 2000 else 200 end as head from calls),
      c as (select *, head - strpos(reverse(left(t, head + 1)), chr(10)) + 1 as nl, strpos(reverse(left(t, head + 1)), chr(10)) > 0 as has_nl, strpos(substr(t, n - 119), chr(10)) as next_nl from s where n > head + 240)
      select tool_use_id, cast(case when has_nl and nl * 2 > head then nl else head end as bigint) as head_end,
        cast(case when next_nl > 0 and n - 120 + next_nl < n then n - 120 + next_nl else n - 120 end as bigint) as tail_start, cast(greatest(360, floor(n * 0.1::double)) as bigint) as budget from c""",
    "evictions": f"""with {JUDGED}, z as (select session, k, tool_use_id, not pinned as free, result_chars as before, case when reduced then least(result_chars, 1000) else result_chars end as size from judged),
      y as (select *, cast(floor(size * 0.8::double) as bigint) as first from z), x as (select *, least(first, 60) as second from y),
      w as (select *, case when free then greatest(size - first, 0) else 0 end as one, case when free then greatest(first - second, 0) else 0 end as two, sum(size) over (partition by session) as total, sum(before) over (partition by session) * (1 - 0.3::double) as need from x),
      r as (select *, coalesce(sum(one) over o, 0) as before_one, coalesce(sum(two) over o, 0) as before_two, sum(one) over (partition by session) as all_one from w window o as (partition by session order by k rows between unbounded preceding and 1 preceding)),
      q as (select session, tool_use_id, case when two > 0 and total - all_one - before_two > need then 2 when one > 0 and total - before_one > need then 1 end as step from r)
      select session, tool_use_id, cast(step as int) as step from q where step is not null""",
    "questions": f"""with {CALLS}, p as (select session, concat('t', cast(row_number() over (partition by session order by k) as varchar)) as id, tool, length(result_text) as chars from calls)
      select session, id, concat(kind, '_', id) as name, replace(replace(replace(wording, '{{id}}', id), '{{tool}}', tool), '{{chars}}', cast(chars as varchar)) as instructions
      from p, (values ('call', {quoted(fixed.CALL_QUESTION)}), ('result', {quoted(fixed.RESULT_QUESTION)})) v(kind, wording)""",
    "policy_options": """with g as (select event_id as id, case event_id % 8 when 0 then ' ON ' when 1 then 'disable' when 2 then '' when 3 then 'status' when 4 then 'what' when 5 then ' Full' when 6 then null else '0' end as word,
        case when event_id % 3 = 0 then null else event_id % 3 = 1 end as stored, case when event_id % 4 = 0 then null else event_id % 5 * 100 end as explicit, event_id % 2 as limits, event_id % 7 < 3 as has_key,
        case when event_id % 6 = 0 then null else event_id * 37 % 900 end as tokens, case when event_id % 5 = 0 then null else event_id * 11 % 700 end as baseline,
        case event_id % 5 when 0 then ' 12.5 ' when 1 then 'inf' when 2 then 'x' when 3 then 'NaN' else cast(event_id as varchar) end as number from events),
      k as (select *, nullif(lower(trim(word)), '') as w from g)
      select id, case when w in ('on', 'enable', '1', 'true') then 'on' when w in ('off', 'disable', '0', 'false') then 'off' when w is null or w = 'status' then 'status' else 'help' end as switch,
        case when w is null or w = 'full' then 'full' else 'metadata' end as egress,
        coalesce(stored, case when w in ('on', 'enable', '1', 'true') then true when w in ('off', 'disable', '0', 'false') then false end, true) as enabled,
        case when explicit > 0 then cast(explicit as double) when limits > 0 then 3600.0::double when has_key then 300.0::double else 3600.0::double end as ttl,
        coalesce(tokens >= 300 and (case when baseline > 0 then tokens >= baseline + 50 else true end), false) as nudge,
        case when try_cast(trim(number) as double) is not null and isfinite(try_cast(trim(number) as double)) then try_cast(trim(number) as double) end as n from k""",
    "health_urls": "select page_id, case when regexp_matches(url, '^[a-z]+://[^/?#]+') then concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/health') end as health from pages",
    "event_windows": "select time_bucket(interval 10 minutes, ts) as start, event_type, count(*) as n from events group by 1, 2",
}
for _name, _pattern, _ignore, _label in fixed.FAMILIES:
    _new, _how = ("\\1" if _label else "") + f"[REDACTED:{_name}]", "gi" if _ignore else "g"
    SQL[f"redact_family_{_name.replace('-', '_')}"] = f"select doc_id, regexp_replace(text, {quoted(_pattern.replace(chr(92) + 'Z', chr(92) + 'z'))}, {quoted(_new)}, '{_how}') as redacted from documents"

_REFS = f"""{CALLS}, refs as (select session, k, event_id,
    case when event_id % 53 = 0 then 'mcp__mail_send' when event_id % 59 = 0 then 'mcp__chat' when event_id % 31 = 0 then 'Skill' else tool end as tool,
    case when event_id % 31 = 0 then case when event_id % 2 = 0 then 'team:inbox' when event_id % 3 = 0 then 'inbox' when event_id % 5 = 0 then '' else 'mailinbox' end end as skill from calls),
  hits as (select * from refs where tool like 'mcp\\_\\_mail%' escape '\\' or tool like 'mcp\\_\\_chat%' escape '\\' or (tool = 'Skill' and (skill = 'inbox' or skill like '%:inbox'))),
  firsts as (select session, tool, min(k) as k, count(*) as n from hits group by 1, 2),
  ranked as (select *, row_number() over (partition by session order by k, tool) as r from firsts),
  scans as (select session, cast(sum(n) as bigint) as hits, list(tool order by k, tool) filter (where r <= 3) as sample from ranked group by session)"""

_ALL = f"""{CALLS}, {PROMPTS}, parts as (
    select session, 0 as m, 0 as kind, text from prompts
    union all select session, 2 * k - 1, 0, '' from calls union all select session, 2 * k - 1, 1, input_json from calls
    union all select session, 2 * k, 0, '' from calls union all select session, 2 * k, 2, result_text from calls)"""

_VERBS = lambda words: "(" + ", ".join(quoted(w) for w in words) + ")"
_WORDS = "trim(seg)"
for _prefix in fixed.PREFIXES:
    _WORDS = f"regexp_replace({_WORDS}, {quoted(_prefix)}, '')"



def reads(table: str) -> str:
    """Common table `reads` (key, reproducible) of a table with key, tool, command and source (its arguments' JSON)."""
    verb = "lower(regexp_replace(regexp_extract(words, '^([^ \\t]*)', 1), '^[\"'']+|[\"'']+$', '', 'g'))"
    measured = f"{verb} in {_VERBS(fixed.METADATA_VERBS)} or regexp_matches(words, {quoted(fixed.LONG_LISTING)}) or regexp_matches(words, {quoted(fixed.SED_IN_PLACE)})"
    shell = f"tool in {_VERBS(fixed.SHELL_TOOLS)} and command <> '' and not regexp_matches(quiet, {quoted(fixed.FILE_REDIRECT)}) and not regexp_matches(quiet, {quoted(fixed.TEE_OR_SHELL)}) and all_read"
    return f"""quieted as (select *, regexp_replace(command, {quoted(fixed.REDIRECT_NOISE)}, '', 'g') as quiet from {table}),
      segments as (select key, {_WORDS} as words from (select key, unnest(string_split_regex(command, {quoted(fixed.SEGMENTS)})) as seg from quieted)),
      judged_segments as (select key, bool_and(words = '' or regexp_matches(words, {quoted(fixed.GIT_READS)}) or (not ({measured}) and {verb} in {_VERBS(fixed.READ_VERBS)})) as all_read from segments group by key),
      reads as (select key, not {has('source', fixed.MUTABLE_SOURCE, True)} and (tool in {_VERBS(fixed.READ_TOOLS)} or ({shell})) as reproducible from quieted join judged_segments using (key))"""


SQL |= {
    "command_rules": f"""with c as (select n, command from (values {', '.join(f'({k}, {quoted(c)})' for k, c in enumerate(COMMANDS))}) v(n, command)),
      b as (select concat(n_nationkey, '/', n) as key, n_nationkey, n, command, case n_nationkey % 3 when 0 then 'Bash' when 1 then 'shell' else 'Write' end as tool, to_json({{'command': command}})::varchar as source from nation, c),
      {reads('b')} select n_nationkey, cast(n as int) as n, reproducible, regexp_matches(command, {quoted(fixed.FILE_REDIRECT)}) as writes from b join reads using (key)""",
    "reproducible_calls": f"""with {CALLS}, b as (select tool_use_id as key, session, tool_use_id, tool, input_json as source, coalesce(json_extract_string(input_json, '$.command'), '') as command from calls), {reads('b')}
      select session, tool_use_id, reproducible from b join reads using (key)""",
    "compact_stats": f"""with {CALLS}, {SIZES} select c.session, count(*) as calls, 0::bigint as kept, 0::bigint as result_dropped, 0::bigint as call_dropped, count_if(2 * k + 6 >= messages) as pinned, count_if(2 * k + 6 < messages) as rules, 0::bigint as reduced from calls c join sizes s on s.session = c.session group by c.session""",
    "decision_texts": f"""with d as (select doc_id, coalesce(text, '') as state, concat('Document ', cast(doc_id as varchar), ' is in ', coalesce(lang, '?')) as said from documents),
      e as (select *, concat('{{"state":', to_json(state), ',"question":', to_json(concat(said, {quoted(fixed.QUESTION_END)})), ',"options":', {quoted(fixed.OPTIONS_JSON)}, '}}') as decision from d)
      select doc_id, decision, concat('{{"messages":[{{"role":"system","content":', to_json({quoted(fixed.SYSTEM_PROMPT)}), '}},{{"role":"user","content":', to_json(decision), '}},{{"role":"assistant","content":"', case when doc_id % 2 = 0 then 'A' else 'B' end, '"}}]}}') as chat from e""",
    "judged_answers": f"""with {CALLS}, a as (select session, tool_use_id, case when event_id % 7 = 0 then 0.25::double else (event_id % 10) / 10 end as keep_call, case when event_id % 7 = 0 then 0.25::double when event_id % 9 = 0 then null else (event_id % 10) / 10 end as keep_result from calls)
      select *, keep_call is null or keep_result is null as failed from a""",
    "with_outcomes": f"with {CALLS} select session, tool_use_id, cast(case when 2 * k % 10 <> 0 then length(result_text) else -1 end as bigint) as chars, case when 2 * k % 10 <> 0 then is_error else false end as is_error from calls",
    "calls_by_message": f"with {CALLS} select session, cast(2 * k - 1 as bigint) as msg_idx, concat('t', cast(row_number() over (partition by session order by k) as varchar)) as ids from calls",
    "session_sizes": f"with {_ALL} select session, cast(sum(length(text)) as bigint) as chars, cast(sum({estimate('text')}) as bigint) as tokens from parts group by session",
    "visible_texts": f"with {_ALL}, v as (select session, string_agg(text, chr(10) order by m, kind) as text from parts group by session) select session, md5(text) as digest, cast(length(text) as bigint) as chars from v",
    "agent_texts": f"with {CALLS} select session, cast(2 * k - 1 as bigint) as msg_idx, concat(chr(10), input_json) as text from calls",
    "erased_messages": f"""with {JUDGED}, {PROMPTS}, d as (select *, {DECISION.replace("when reduced then 'reduced' ", "")} as reason from judged),
      e as (select session, case when reason = 'call_dropped' then 0 else 1 end as stays, input_chars, case when reason = 'result_dropped' and result_chars > 420 then 300 + length(concat('x[condensed: truncated ', cast(result_chars - 300 as varchar), ' chars of this tool result; run the tool again if needed]')) else result_chars end as n from d)
      select e.session, 1 + 2 * sum(stays)::bigint as messages, sum(stays)::bigint as calls, (any_value(length(p.text)) + sum(stays * (input_chars + n)))::bigint as chars from e join prompts p on p.session = e.session group by e.session""",
    "named_values": f"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {quoted('(?i)' + fixed.FACT_TOKEN)}))), ' ') as named,
      cast(len(list_filter({tokens('text')}, lambda t: regexp_matches(text, concat('(^|[^\\pL\\pN])', regexp_escape(t), '($|[^\\pL\\pN])')))) as bigint) as apart from documents""",
    "text_slices": """select doc_id, substr(text, 4, 6) as inside, '' as none, 'the full output stays in the transcript under `' || lang || '`' as kept, 'the full output is saved at ' || source || '; read it for what is not kept here' as saved,
      concat(cast(cast(coalesce(case when doc_id % 5 <> 0 then round(100.0::double * (doc_id % 7) / (doc_id % 5)) end, 0) as bigint) as varchar), '%') as share,
      case when ms >= 86400000 then concat(cast(ms // 86400000 as varchar), 'd') when ms >= 3600000 then concat(cast(ms // 3600000 as varchar), 'h') when ms >= 60000 then concat(cast(ms // 60000 as varchar), 'm') else concat(cast(ms // 1000 as varchar), 's') end as age
      from (select *, doc_id * doc_id * 977 as ms from documents)""",
    "taint_rules": f"with {_REFS} select session, hits, array_to_string(sample, ',') as sample from scans",
    "taint_records": f"""with {_REFS}, stored as (select cast(user_id as varchar) as session, case user_id % 4 when 0 then true else false end as held, case user_id % 4 when 0 then 2 else 1 end as kept from (select distinct user_id from events))
      select s.session, c.hits is not null or held as tainted, cast(case when c.hits is not null then c.hits when held then kept else 0 end as bigint) as count, held and c.hits is null as sticky,
        case when c.hits is not null and not held then concat('{{"tainted":true,"count":', cast(c.hits as varchar), ',"sample":["', array_to_string(sample, '","'), '"],"at":1000}}') end as "write" from stored s left join scans c on c.session = s.session""",
    "odds": """with g as (select event_id, case when event_id % 3 <> 0 then -(event_id % 11) / 4.0::double end as a, case when event_id % 4 <> 0 then -(event_id % 7) / 2.0::double end as b, event_id % 5 as r from events)
      select event_id, round(least(greatest(case when a is not null and b is not null then 1 / (1 + exp(b - a)) when a is not null then exp(a) when b is not null then 1 - exp(b) when r = 0 then 1 when r = 1 then 0 end, 0), 1), 9) as p from g""",
    "option_grid": """with g as (select event_id, case event_id % 6 when 0 then '"text"' when 1 then '12.5' when 2 then 'true' when 3 then '{"a":1}' when 4 then 'null' else '[1]' end as raw, case event_id % 4 when 0 then 1500.2 when 1 then -3 when 2 then null else event_id end as number from events)
      select event_id, case event_id % 6 when 0 then 'text' when 1 then '12.5' when 2 then 'true' end as text, cast(case when number > 0 then ceil(number) else 15000 end as bigint) as timeout,
        coalesce(case when event_id % 5 = 0 then cast(event_id % 50 as double) end, case when event_id % 3 <> 0 then ceil((event_id * 13 % 997) / 4) end, 0.0::double) as gap,
        case when event_id % 6 = 3 then raw else concat('{"raw":', to_json(raw), '}') end as object, concat('taint:', cast(event_id as varchar)) as key, concat('baseline:', cast(event_id as varchar)) as baseline from g""",
    "teacher_ids": """with r as (select concat('s', cast(doc_id % 50 as varchar)) as session, concat('u', cast(doc_id as varchar)) as tool_use_id, (doc_id % 10) / 10 as p from labels)
      select session, tool_use_id, p >= 0.5 as truth, substr(sha256(concat(session, '|None|', tool_use_id, '|result|teacher')), 1, 12) as record_id, case when cast(('0x' || substr(sha256(session), 1, 2)) as bigint) < 0.1 * 256 then 'dev' else 'train' end as split from r""",
    "stub_sums": f"with {CALLS} select count_if(event_id % 19 = 0) as stubbed, count_if(event_id % 19 = 0 and is_error) as broken from calls",
    "sticky_taint_stream": """with e as (select cast(user_id as varchar) as session, event_id, event_type = 'signup' and event_id % 53 = 0 as hit, row_number() over (partition by user_id order by ts, event_id) as n from events)
      select session, event_id, hit, bool_or(hit) over o as tainted, first_value(case when hit then event_id end ignore nulls) over o as first_event from e window o as (partition by session order by n rows between unbounded preceding and current row)""",
    "argument_stubs": f"""with {CALLS}, t as (select tool_use_id, case event_id % 10
        when 0 then concat('{{"given":', input_json, ',"edits":[1,{{"new":"x…[', cast(event_id as varchar), ' chars]"}}]}}') when 1 then concat('{{"x…[', cast(event_id as varchar), ' chars]":', input_json, '}}') else input_json end as x from calls),
      hits as (select distinct tool_use_id from t, json_tree(x) j where j.type = 'VARCHAR' and regexp_matches(j.atom, '…\\[[0-9]+ chars\\]'))
      select tool_use_id, h.tool_use_id is not null as stub from t left join hits h using (tool_use_id)""",
    "tool_references": """select event_id, case event_id % 4 when 0 then event_type when 1 then cast(event_id as varchar) else '' end as tool, case event_id % 4 when 1 then 'true' when 2 then event_type end as skill from events""",
    "session_events": """with recursive m as (
        select cast(user_id as varchar) as session, event_id as seq, epoch_us(ts) // 1000 as ms, event_type, cast(json_extract(props, '$.k') as int) as k, value from events),
      e as (select *, row_number() over (partition by session order by ms, seq) as n,
        case when event_type = 'purchase' then 'turn' when event_type <> 'click' then 'tool' when k < 20 then 'compacted' when k < 40 then 'command' else 'turn_start' end as kind,
        event_type = 'signup' and k < 3 as mail, event_type = 'error' and k % 10 = 0 as stub, case when k < 25 then 'off' when k < 30 then 'on' else 'status' end as args,
        case when k % 11 <> 0 then value * 1000 end as tokens, k % 9 = 0 as agent, k % 13 <> 0 as answer, k % 4 = 0 as skipped from m),
      r as (
        select session, 0::bigint as n, null::bigint as seq, null::bigint as ms, '' as kind, '' as action, null::varchar as reason, false as tainted, true as enabled, null::double as baseline, null::bigint as due_ms,
          null::bigint as taint_at, null::double as base, false as pending, null::bigint as base_at, false as running from e where n = 1
        union all
        select session, n, seq, ms, kind,
          case kind when 'tool' then case when stub then 'deny' else 'allow' end when 'command' then args when 'turn_start' then 'none' when 'compacted' then case when agent or skipped then 'none' else 'settled' end
            else case when why = 'threshold' then 'compact' when arms then 'nudge_armed' else 'wait' end end as action,
          case kind when 'tool' then case when stub then 'argument_stub' end when 'command' then case when not enabled then 'builtin: switched_off' when tainted then 'rules: tainted' else 'model: ok' end
            when 'compacted' then case when agent then 'subagent' when skipped then 'skipped' end when 'turn' then why end as reason,
          tainted, enabled, case when judged then held end as baseline, case when arms then ms + 3300000 end as due_ms, taint_at,
          case when settles then null when judged and reads then tokens else base end, case when settles then true when judged and reads then false else pending end, case when settles or judged and reads then ms else base_at end,
          case when kind = 'compacted' and not agent then false when kind = 'turn' and why = 'threshold' then true else running end
        from (select *, judged and why <> 'threshold' and tokens >= 30000 and not coalesce(held > 0 and tokens < held + 15000, false) as arms from (
          select *, case when agent then 'subagent' when running then 'busy' when not answer then 'not_an_answer' when not enabled then 'switched_off' when tokens is null then 'no_usage' when tokens < 60000 then 'below_threshold'
              when held > 0 and tokens < greatest(60000, held + 15000) then 'hysteresis' else 'threshold' end as why,
            kind = 'turn' and not agent and not running and answer and enabled as judged
          from (select *, case when reads then tokens when fresh then base end as held, kind = 'compacted' and not agent and not skipped as settles from (
            select e.*, coalesce(case when e.ms - r.taint_at <= 2592000000 then r.taint_at end, case when e.mail then e.ms end) as taint_at, r.base, r.pending, r.base_at, r.running, coalesce(e.ms - r.base_at <= 2592000000, false) as fresh,
              r.pending and coalesce(e.ms - r.base_at <= 2592000000, false) and e.tokens is not null as reads,
              coalesce(e.ms - r.taint_at <= 2592000000, false) or e.mail as tainted, case when e.kind = 'command' and e.args = 'on' then true when e.kind = 'command' and e.args = 'off' then false else r.enabled end as enabled
            from r join e on e.session = r.session and e.n = r.n + 1))))),
      quiet as (select a.session, a.seq, a.due_ms, max(s.n) as last from r a join r s on s.session = a.session and s.ms < a.due_ms
        where a.due_ms <= (select max(ms) from m) and not exists (select 1 from e c where c.session = a.session and c.n > a.n and c.ms < a.due_ms and (c.kind = 'turn_start' or c.kind = 'turn' and not c.agent)) group by all)
      select session, seq, kind, action, reason, tainted, enabled, baseline, due_ms from r where n > 0
      union all
      select q.session, q.seq, 'nudge', 'notify', 'cache_warm', coalesce(q.due_ms - s.taint_at <= 2592000000, false), s.enabled, null, q.due_ms from quiet q join r s on s.session = q.session and s.n = q.last""",
    "turn_verdicts": """with recursive t as (select cast(user_id as varchar) as session, event_id, case when event_id % 11 <> 0 then cast(event_id * 7919 % 120000 as double) end as tokens, row_number() over (partition by user_id order by ts, event_id) as n from events),
      r as (
        select session, 0::bigint as n, null::bigint as event_id, null::double as tokens, null::double as baseline, false as pending, false as run, '' as reason from t where n = 1
        union all
        select session, n, event_id, tokens, baseline, case when reason = 'no_usage' then pending else reason = 'threshold' end, reason = 'threshold', reason from (
          select *, case when tokens is null then 'no_usage' when tokens < 60000 then 'below_threshold' when baseline > 0 and tokens < greatest(60000, baseline + 15000) then 'hysteresis' else 'threshold' end as reason
          from (select t.session, t.n, t.event_id, t.tokens, case when r.pending and t.tokens is not null then t.tokens else r.baseline end as baseline, r.pending from r join t on t.session = r.session and t.n = r.n + 1)))
      select session, event_id, tokens, baseline, run, reason from r where n > 0""",
}
