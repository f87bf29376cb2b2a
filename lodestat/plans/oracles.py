"""DuckDB SQL of the session-analytics queries, from the flat columns of the star-schema tables.

The first part states the session tables as the adapters make them, without any JSON; a query follows.
"""

from __future__ import annotations

_BASE = """
sessions as (
  select cast(k as varchar) id, k,
    case when k % 97 = 0 then 'lost' || k when k % 101 = 0 then cast(k as varchar) when k % 206 = 0 then cast(k + 103 as varchar) when k % 206 = 103 then cast(k - 103 as varchar) when k >= 4 then cast(k // 4 as varchar) end parent_id,
    c_name title, 'm' || (k % 5) launch, 'p' || (k % 2) launch_provider, case when k % 13 = 0 then null when k % 13 = 1 then '' else c_mktsegment end agent,
    case when k % 17 = 0 then null when k % 17 = 1 then '' else '/n/' || n_name || '/' || c_mktsegment end directory,
    788918400000 + k * 3600000 time_created, case when k % 31 <> 0 then 788918400000 + k * 3600000 + (k % 40) * 90000 end time_updated,
    case when k % 5 = 0 then '' when k % 5 = 1 then null when k % 5 = 2 then 'done' else 'asked' end idle_outcome, cast(money as double) cost,
    money * 10 tokens_input, k % 1000 tokens_output, k % 50 tokens_reasoning, case when k % 19 <> 0 then money * 3 end tokens_cache_read, k % 70 tokens_cache_write,
    money * 10 + k % 1000 + case when k % 19 <> 0 then money * 3 else 0 end tokens
  from (select c_custkey k, cast(floor(abs(c_acctbal)) as bigint) money, * from customer) left join nation on c_nationkey = n_nationkey),
quantities as (select l_orderkey, cast(sum(l_quantity) as bigint) quantity from lineitem join part on l_partkey = p_partkey group by 1),
messages as (
  select cast(k as varchar) id, k, case when k % 97 = 0 then 'gone' else cast(o_custkey as varchar) end session_id,
    case when k % 61 = 5 then 'idle' when k % 61 = 6 then 'synthetic' when k % 11 = 0 then 'user' when k % 11 = 1 then 'compaction' when k % 11 = 2 then 'model-switched' when k % 11 = 3 then 'system' else 'assistant' end type, k seq,
    epoch_ms(o_orderdate) + (k % 86400) * 1000 time_created, make_timestamp((epoch_ms(o_orderdate) + (k % 86400) * 1000) * 1000) ts,
    o_orderpriority, o_orderstatus, cast(floor(o_totalprice) as bigint) % 5000 price, cast(floor(o_totalprice / 7) as bigint) % 9000 price7, coalesce(quantity, 0) quantity
  from (select o_orderkey k, * from orders) left join quantities on l_orderkey = k),
kept as (select * from messages where session_id in (select id from sessions)),
steps as (
  select id message_id, session_id, k, seq, time_created, ts, cast(ts as date) as day,
    case when k % 23 = 0 then 'unknown' else case k % 3 when 0 then 'build' when 1 then 'plan' else 'general' end end agent,
    case when k % 41 = 0 then null when k % 37 = 0 then '' else o_orderpriority end raw_model_id,
    case when k % 41 = 0 or k % 37 = 0 then 'unknown' else o_orderpriority end model_id, case when k % 41 = 0 then '' else o_orderstatus end provider_id,
    case when k % 41 = 0 or k % 2 = 0 then '' else 'v1' end variant,
    case when k % 43 = 0 or k % 47 = 0 then 0 else price end::double input, case when k % 47 = 0 then 0 else quantity end::double output, case when k % 47 = 0 then 0 else k % 300 end::double reasoning,
    case when k % 47 = 0 then 0 else price7 end::double cache_read, case when k % 47 = 0 then 0 else k % 200 end::double cache_write,
    k % 29 = 0 and k % 4 <> 0 has_error, case when k % 29 = 0 and k % 4 <> 0 and k % 3 = 1 then 'aborted' when k % 29 = 0 and k % 4 <> 0 and k % 3 = 2 then 'rate_limit' else '' end error_type
  from kept where type = 'assistant' and k % 53 <> 0 and k % 59 <> 0),
parts as (
  select s.message_id, s.session_id, s.k, s.time_created, s.day, p, row_number() over (partition by s.message_id order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 pos,
    case when p % 31 = 0 then 'image' when p % 37 = 0 then null when l_linenumber % 4 = 0 then 'text' when l_linenumber % 4 = 3 then 'reasoning' else 'tool' end kind,
    case p % 6 when 0 then 'read' when 1 then 'edit' when 2 then 'write' else p_brand end base_tool,
    case when p % 40 = 39 then 'unknown' when l_returnflag = 'R' then 'error' when l_linestatus = 'O' then 'running' else 'completed' end status,
    case when p % 9 = 8 then '' when p % 3 = 0 then '/home/u//d' || (p % 25) || '/' else '/srv/' || (p % 40) end path, p_name, p_type
  from (select l_partkey p, * from lineitem) join part on p = p_partkey join steps s on l_orderkey = s.k),
tool_parts as (select *, base_tool tool, '{"path":"' || path || '"}' taken from parts where kind = 'tool' and p % 50 <> 49),
as_of as (select date_trunc('day', max(o_orderdate)) + interval 12 hour t, cast(max(o_orderdate) as date) today from orders),
days as (select cast(today - cast(i as int) as date) as day, i from as_of, range(0, 30) r(i)),
todos as (select cast(o_custkey as varchar) session_id, 'todo ' || o_orderkey content, case when o_orderkey % 15 = 0 then 'cancelled' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'pending' else 'in_progress' end status, cast(o_orderkey % 100 as int) position from orders)
"""

_TREND = """
trend as (select d.day, count(s.k) steps, coalesce(sum(input), 0) input, coalesce(sum(cache_read), 0) cache_read, coalesce(sum(output), 0) output,
  case when coalesce(sum(cache_read + input), 0) > 0 then sum(cache_read) / sum(cache_read + input) else 0 end hit_rate from {days} d left join steps s on s.day = d.day group by d.day)"""

_BY_MODEL = """
win as (select s.* from steps s join days using (day)),
models as (select model_id, sum(input + output + cache_read) window_tokens, row_number() over (order by sum(input + output + cache_read) desc, model_id) model_rank from win group by 1),
cells as (select d.day, m.model_id, m.window_tokens, m.model_rank, count(w.k) steps, coalesce(sum(w.input + w.output + w.cache_read), 0) tokens
  from days d cross join models m left join win w on w.day = d.day and w.model_id = m.model_id group by 1, 2, 3, 4)"""

_BOARD = """
board as (select model_id, provider_id, variant, count(*) steps, sum(input + output + cache_read) tokens, sum(input) i, sum(cache_read) r, sum(output) o, sum(reasoning) why,
  avg(input + cache_read + cache_write) context_avg, quantile_disc(input + cache_read + cache_write, 0.5) context_median, quantile_disc(input + cache_read + cache_write, 0.95) context_p95,
  min(time_created) first_seen, max(time_created) last_seen from steps group by 1, 2, 3)"""

_TOOL_TOKENS = """
est as (select message_id, tool, sum(case when 1 = 1 then greatest(c - n, 0) / 4.0 + n end) weight from (
  select message_id, tool, (length(taken) + length(p_name))::double c, greatest((octet_length(encode(taken)) + octet_length(encode(p_name)) - length(taken) - length(p_name)) / 2.0, 0) n from tool_parts) group by 1, 2),
shares as (select s.message_id, floor(input + output + cache_read) t, coalesce(tool, '') tool, weight, sum(weight) over (partition by s.message_id) w, count(*) over (partition by s.message_id) n from steps s left join est using (message_id)),
exact as (select *, t * case when w > 0 then weight / w else 1.0::double / n end e from shares),
placed as (select *, row_number() over (partition by message_id order by e - floor(e) desc, tool) place, t - sum(floor(e)) over (partition by message_id) rest from exact),
tool_tokens as (select tool, cast(sum(floor(e) + case when place <= rest then 1 else 0 end) as bigint) tokens, count(*) steps from placed group by 1)"""

_BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# A tool's input is an object of one path: 16 characters more when it is indented.
_SIZED = """
costs as (select l_orderkey k, sum(case
    when l_partkey % 31 = 0 or l_partkey % 37 = 0 then 0 when l_linenumber % 4 = 0 then length(p_name) when l_linenumber % 4 = 3 then length(p_type) + 200
    else length(case when l_partkey % 9 = 8 then '' when l_partkey % 3 = 0 then '/home/u//d' || (l_partkey % 25) || '/' else '/srv/' || (l_partkey % 40) end) + 16 + length(p_name) + 200 end) c
  from lineitem join part on l_partkey = p_partkey group by 1),
sized as (select session_id, id, row_number() over (partition by session_id order by m.k) - 1 i,
    case when type = 'user' then length(o_orderpriority || ' order ' || m.k) when type <> 'assistant' then 200 when m.k % 53 = 0 or m.k % 59 = 0 then 0 else coalesce(c, 0) end c
  from messages m left join costs on costs.k = m.k where type not in ('idle', 'synthetic'))"""


def _packs(rows: int, chars: int) -> tuple[list[str], str]:
    packed = f"""packed(session_id, i, pack, n, size) as (
  select session_id, i, 0, 1, c from sized where i = 0
  union all
  select s.session_id, s.i, case when fits then pack else pack + 1 end, case when fits then n + 1 else 1 end, case when fits then size + s.c else s.c end
  from (select p.pack, p.n, p.size, s.session_id, s.i, s.c, n < {rows} and size + s.c <= {chars} fits from packed p join sized s on s.session_id = p.session_id and s.i = p.i + 1) s)"""
    return [_SIZED, packed], "select s.session_id, id, pack from sized s join packed p on s.session_id = p.session_id and s.i = p.i"


_LAST = "last as (select * from steps qualify row_number() over (partition by session_id order by seq desc, time_created desc, message_id desc) = 1)"

_COMPACTIONS = "compactions as (select *, case k % 3 when 0 then 'auto' when 1 then 'manual' else 'unknown' end reason from kept where type = 'compaction')"

_DISTRIBUTION = """
v as (select x::double x from ({0}) where x > 0),
w as (select count(*) n, quantile_disc(x, 0.5) p50, quantile_disc(x, 0.9) p90, quantile_disc(x, 0.99) p99, avg(x) mean, max(x) largest from v),
e as (select 0 bucket, 0::double low union all select kk + 1, case when kk = 0 then 1 else floor(pow(10, kk / 2.0) / pow(10, floor(log10(pow(10, kk / 2.0) + 1e-9)) - 2) + 0.5) * pow(10, floor(log10(pow(10, kk / 2.0) + 1e-9)) - 2) end
  from (select cast(greatest(1, ceil(log10(largest))) as bigint) d from w), range(0, 2 * d + 1) r(kk)),
b as (select cast(bucket as int) bucket, low, lead(low) over (order by bucket) high from e)
select bucket, low, high, (select count(*) from v where x >= low and (high is null or x < high)) count, n, p50, p90, p99, mean, largest from b, w where n > 0"""

_EVENTS = """
events as (select session_id, id event_id, k, seq, time_created, type kind,
  case type when 'compaction' then case k % 3 when 0 then 'auto' when 1 then 'manual' else 'unknown' end
    when 'system' then 'system note ' || k else case when k % 4 = 0 then 'unknown' else 'm' || (k % 4) end || ' → m' || (k % 5) end detail
  from kept where type in ('compaction', 'model-switched', 'system'))"""

_PROMPT = """
states as (select cast(c_custkey as varchar) session_id, n, c_custkey k, c_custkey + n * case when c_custkey % 2 = 0 then 1 else -1 end epoch from customer, (values (0), (3)) x(n)),
latest as (select * from states qualify row_number() over (partition by session_id order by epoch desc) = 1),
keyed as (select session_id, 'a' key, k + n h from latest union all select session_id, 'b', 2 * k + n from latest),
prompts as (select session_id, key, p_name "text" from keyed join part on p_partkey = h where p_partkey % 5 <> 0)"""

_TEXTS = """
bodies as (select m.id, m.session_id, m.type, m.seq, m.time_created, m.k, case when type = 'user' then o_orderpriority || ' order ' || k end user_text from kept m),
part_texts as (select message_id, pos, case kind when 'text' then p_name end own, case when kind = 'reasoning' then p_type when kind = 'tool' then case when p % 50 = 49 then 'unknown' else base_tool end || chr(10) || chr(10) || '{' || chr(10) || '  "path": "' || path || '"' || chr(10) || '}' || chr(10) || chr(10) || p_name end extra from parts),
step_texts as (select message_id, array_to_string(list_filter([string_agg(own, chr(10) || chr(10) order by pos), string_agg(extra, chr(10) || chr(10) order by pos)], lambda x: x is not null), chr(10) || chr(10)) txt from part_texts group by 1),
texts as (select b.id, b.session_id, b.type, b.seq, b.time_created, case when b.type in ('user', 'system') then coalesce(user_text, 'system note ' || b.k) else coalesce(txt, '') end txt from bodies b left join step_texts on message_id = b.id)"""

def _search(pattern: str) -> tuple[list[str], str]:
    """X1 from its rule, for a pattern without groups."""
    html = lambda t: f"replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
    return [_TEXTS], rf"""select id, session_id, title, type, time_created,
      case when low > 0 then '…' else '' end || {html("substr(txt, low + 1, spot - low)")} || '<mark>' || {html("substr(txt, spot + 1, least(spot + size, high) - spot)")} || '</mark>'
      || {html("substr(txt, least(spot + size, high) + 1, high - least(spot + size, high))")} || case when high < length(txt) then '…' else '' end snippet, matches, total, cast(null as varchar) error
    from (select *, least(low + 120, length(txt)) high from (select *, greatest(spot - (120 - size) // 2, 0) low from (
      select t.id, session_id, coalesce(title, '') title, type, t.time_created, txt, length(regexp_extract(txt, '(?i){pattern}')) size, length(string_split_regex(txt, '(?i){pattern}')[1]) spot,
        len(regexp_extract_all(txt, '(?i){pattern}')) matches, count(*) over () total
      from texts t left join sessions s on s.id = session_id where type in ('user', 'assistant') and regexp_matches(txt, '(?i){pattern}') order by t.time_created desc, t.id desc limit 200)))"""


_FOREST = """
nodes as (select s.id, case when s.parent_id = s.id or p.id is null then null else s.parent_id end parent, coalesce(s.parent_id = s.id, false) self_parent, s.parent_id is not null and p.id is null orphan from sessions s left join sessions p on p.id = s.parent_id),
walk(start, here, path, looped) as (
  select id, id, [id], false from nodes
  union all
  select start, n.parent, list_append(path, n.parent), list_contains(path, n.parent) from walk join nodes n on n.id = walk.here where not looped and n.parent is not null),
loops as (select start, here e, path[list_position(path, here):] ring from walk where looped),
named as (select start, e, list_min(ring) least from loops),
firsts as (select least, arg_min(e, start) e from named group by 1),
cuts as (select n.id from nodes n join firsts f on n.parent = f.e join named m on m.start = n.id and m.least = f.least where list_contains((select any_value(ring) from loops where e = f.e), n.id)),
trees as (select id, case when id in (select id from cuts) then null else parent end parent, id in (select id from cuts) cut from nodes),
up(id, ancestor, distance) as (select id, id, 0 from trees union all select up.id, t.parent, distance + 1 from up join trees t on t.id = up.ancestor where t.parent is not null),
shape as (select t.id, t.parent, (select max(distance) from up where up.id = t.id) depth, (select count(*) from up where ancestor = t.id) subtree_size, (select count(*) from trees c where c.parent = t.id) children from trees t)"""

_GRAPH = """
ranked as (select *, row_number() over (order by subtree_size desc, id) r from shape where parent is null),
l0 as (select id, parent, depth, subtree_size, row_number() over (order by subtree_size desc, id) - 1 position from ranked where r <= 100),
l1 as (select s.id, s.parent, s.depth, s.subtree_size, (select count(*) from l0) + row_number() over (order by l0.position, s.subtree_size desc, s.id) - 1 position from shape s join l0 on s.parent = l0.id),
l2 as (select s.id, s.parent, s.depth, s.subtree_size, (select count(*) from l0) + (select count(*) from l1) + row_number() over (order by l1.position, s.subtree_size desc, s.id) - 1 position from shape s join l1 on s.parent = l1.id),
l3 as (select s.id, s.parent, s.depth, s.subtree_size, (select count(*) from l0) + (select count(*) from l1) + (select count(*) from l2) + row_number() over (order by l2.position, s.subtree_size desc, s.id) - 1 position from shape s join l2 on s.parent = l2.id),
l4 as (select s.id, s.parent, s.depth, s.subtree_size, (select count(*) from l0) + (select count(*) from l1) + (select count(*) from l2) + (select count(*) from l3) + row_number() over (order by l3.position, s.subtree_size desc, s.id) - 1 position from shape s join l3 on s.parent = l3.id),
taken as (select * from (select * from l0 union all select * from l1 union all select * from l2 union all select * from l3 union all select * from l4) where position < 100)"""


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join([_BASE.strip(), *(c.strip() for c in ctes)]) + "\n"


_PLAIN: dict[str, str] = {
    "s01_scan_steps": "select message_id, session_id, seq, time_created, agent, model_id, raw_model_id, provider_id, variant, input, output, reasoning, cache_read, cache_write, has_error, error_type from steps",
    "s03_unnest_parts": "select message_id, session_id, pos, kind from parts",
    "s04_unnest_tool_parts": "select message_id, pos, tool, status from tool_parts",
    "s02_scan_sessions": "select id, title, launch model_id, launch_provider provider_id, coalesce(nullif(agent, ''), 'unknown') agent, directory, time_created, time_updated, case when time_updated > time_created then time_updated - time_created end duration_ms, tokens, cost from sessions",
    "p02_anchored_messages": "select id, session_id, type from kept",
    "p03_session_scope": "select message_id, session_id, seq from steps where session_id = '7'",
    "p07_window": "select message_id, time_created from steps, as_of where day >= today - 29",
    "f05_step_rates": "select message_id, case when cache_read + input > 0 then cache_read / (cache_read + input) else 0 end hit_rate, case when cache_read + input + cache_write > 0 then cache_read / (cache_read + input + cache_write) else 0 end strict_hit_rate, input + output + cache_read usage_tokens, input + cache_read + cache_write context_tokens from steps",
    "f09_local_times": "select message_id, strftime(ts, '%Y-%m-%d') day_key, dayofweek(ts) weekday, hour(ts) as hour from steps",
    "f13_redacted_paths": "select id, case when directory = '/n/NATION_2' then '~' when starts_with(directory, '/n/NATION_2/') then '~' || substr(directory, 12) else directory end path from sessions",
    "f33_csv_fields": "select doc_id, sha256(case when left(text, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || text else text end) field_sha256 from documents",
    "f38_wall_durations": "select id, case when time_updated > time_created then time_updated - time_created end duration_ms from sessions",
    "s05_session_messages": "select id, session_id, type, seq, time_created from kept where session_id = '7'",
    "s06_session_todos": "select session_id, content, status, position from todos where session_id = '7' and session_id in (select id from sessions)",
    "s08_session_exists": "select id from sessions where id in (select session_id from messages)",
    "k01_sessions_csv": "select id, title, launch \"modelId\", coalesce(nullif(agent, ''), 'unknown') agent, coalesce(directory, '') directory, time_created \"timeCreated\", time_updated \"timeUpdated\", tokens, cost from sessions",
    "p04_directory_filter": "select id, directory from sessions where directory = '/n/NATION_2/BUILDING'",
    "p05_range_filter": "select id, time_updated from sessions where time_updated >= 788918400000 + 1400 * 3600000::bigint - 30 * 86400000::bigint",
    "p06_day_filter": "select id, time_updated from sessions where cast(make_timestamp(time_updated * 1000) as date) = date '1995-01-11'",
    "p08_previous_window": "select message_id, time_created from steps, as_of where day between today - 59 and today - 30",
    "p14_model_drill_down": "select id session_id, ids model_ids from (select s.id, array_to_string(list_sort(list_distinct(list_append(coalesce(m, []), launch))), ',') ids from sessions s left join (select session_id, list(model_id) m from steps where raw_model_id is not null group by 1) on session_id = s.id) where list_contains(string_split(ids, ','), '2-HIGH')",
    "p15_visible_messages": "select type, count(*) n from messages where type not in ('idle', 'synthetic') group by 1",
    "f11_last_segment": "select id, case when directory is null then null when directory = '' then '' else list_last(string_split(directory, '/')) end segment from sessions",
    # the rule of names: blanks, forbidden characters, trim, 60 characters, no dot or blank at the end
    "f34_download_names": r"""select id, strftime(make_timestamp(time_created * 1000), '%Y-%m-%d') || '-' ||
      regexp_replace(left(trim(regexp_replace(regexp_replace(' a/b: ' || title || '  <' || coalesce(agent, '') || '> and some more words, so that it is cut. .', '[\\/:*?"<>|]', '-', 'g'), '\s+', ' ', 'g')), 60), '[. ]+$', '') || '.md' name from sessions""",
    "a01_overview": "select coalesce(sum(input + output + cache_read) filter (day >= today), 0) today_tokens, coalesce(sum(input + output + cache_read), 0) total_tokens, case when coalesce(sum(cache_read + input) filter (day >= today), 0) > 0 then sum(cache_read) filter (day >= today) / sum(cache_read + input) filter (day >= today) else 0 end today_hit_rate, count(*) step_count, (select count(*) from sessions) session_count, (select sum(cost) from sessions) total_cost from steps, as_of",
    "a06_agent_stats": "select agent, coalesce(n, 0) sessions, coalesce(steps, 0) steps, coalesce(tokens, 0) tokens, coalesce(tools, '') tools from (select agent, count(*) n from (select agent, id from sessions where agent <> '' union select agent, session_id from steps) group by 1) full join (select agent, count(*) steps, sum(input + output + cache_read) tokens from steps group by 1) using (agent) left join (select agent, string_agg(tool || '=' || n, ',' order by n desc, tool) tools from (select s.agent, tool, count(*) n from tool_parts join steps s using (message_id) group by 1, 2) group by 1) using (agent)",
    "a07_tool_health": "select tool, count(*) filter (status = 'completed') completed, count(*) filter (status = 'error') error, count(*) filter (status = 'running') running, count(*) total, count(*) filter (status = 'error') / count(*)::double error_rate from tool_parts group by 1",
    "a08_tool_error_trend": "select d.day, count(t.message_id) tool_calls, count(t.message_id) filter (status = 'error') errors, case when count(t.message_id) > 0 then count(t.message_id) filter (status = 'error') / count(t.message_id)::double else 0 end error_rate from days d left join tool_parts t on t.day = d.day group by 1",
    "a10_hour_heatmap": "select g.i // 24 weekday, g.i % 24 as hour, count(s.k) steps from range(168) g(i) left join (select * from steps, as_of where day > today - 90) s on dayofweek(s.ts) = g.i // 24 and hour(s.ts) = g.i % 24 group by 1, 2",
    "a11_session_survival": "select count(*) total, cast(floor(quantile_disc(d, 0.5) / 1000.0 + 0.5) as bigint) median_seconds, count(*) filter (d < 300000) / count(*)::double short_share from (select greatest(coalesce(time_updated - time_created, 0), 0) d from sessions)",
    "a11_idle_outcomes": "select coalesce(nullif(idle_outcome, ''), 'none') outcome, count(*) sessions from sessions group by 1",
    "a15_directory_stats": "select directory, count(*) sessions, cast(coalesce(sum(steps), 0) as bigint) steps, cast(sum(tokens_input) as bigint) tokens_input, cast(sum(tokens_output) as bigint) tokens_output, cast(coalesce(sum(tokens_cache_read), 0) as bigint) tokens_cache_read, max(time_updated) last_active, count(*) over () total_directories, cast(sum(count(*)) over () as bigint) total_sessions, list_last(string_split(directory, '/')) name from sessions left join (select session_id, count(*) steps from messages where type = 'assistant' and k % 53 <> 0 and k % 59 <> 0 group by 1) on session_id = id where directory <> '' group by 1 order by steps desc, sessions desc, directory limit 50",
    "a20_child_share": "select count(*) total, count(parent_id) children, count(*) - count(parent_id) roots, cast(coalesce(sum(tokens) filter (parent_id is not null), 0) as bigint) child_tokens, cast(coalesce(sum(tokens) filter (parent_id is null), 0) as bigint) root_tokens, case when sum(tokens) > 0 then coalesce(sum(tokens) filter (parent_id is not null), 0) / sum(tokens)::double else 0 end child_token_share from sessions",
    "a21_top_child_trees": "select t.parent_id, children, child_tokens, coalesce(title, '') title, coalesce(agent, '') agent from (select parent_id, count(*) children, cast(sum(tokens) as bigint) child_tokens from sessions where parent_id is not null group by 1 order by 3 desc, 1 limit 5) t left join sessions s on s.id = t.parent_id",
    "a25_token_ledger": "select s.id session_id, coalesce(tokens_input, 0) tokens_input, coalesce(tokens_cache_read, 0) tokens_cache_read, coalesce(tokens_cache_write, 0) tokens_cache_write, coalesce(tokens_output, 0) tokens_output, coalesce(messages, 0) messages, coalesce(i, 0) prompt_input, coalesce(r, 0) prompt_read, coalesce(w, 0) prompt_write, coalesce(o, 0) output, coalesce(g, 0) reasoning, coalesce(i + r + w, 0) prompt_total, case when i + r + w > 0 then r / (i + r + w) end cache_hit_rate from sessions s left join (select session_id, count(*) messages, sum(input) i, sum(cache_read) r, sum(cache_write) w, sum(output) o, sum(reasoning) g from steps group by 1) on session_id = s.id",
    "a29_todo_stats": "select count(*) total, count(*) filter (status = 'completed') completed, count(*) filter (status = 'pending') pending, count(*) filter (status = 'in_progress') in_progress, count(*) filter (status = 'cancelled') other, count(*) filter (status = 'completed') / count(*)::double completion_rate from todos",
    "a28_file_activity": "select path, reads, edits, writes, sessions, last_active, operations, count(*) over () total_files, cast(sum(operations) over () as bigint) total_operations from (select case when starts_with(path, '/home/u') then '~/d' || (p % 25) else path end path, count(*) filter (tool = 'read') reads, count(*) filter (tool = 'edit') edits, count(*) filter (tool = 'write') writes, count(distinct session_id) sessions, max(time_created) last_active, count(*) operations from (select *, base_tool tool from parts where kind = 'tool' and p % 50 <> 49 and p % 8 <> 7) where tool in ('read', 'edit', 'write') and path <> '' group by 1) order by operations desc, path limit 100",
    "a30_top_tools": "select tool, calls, calls / sum(calls) over ()::double share, errors / calls::double error_rate, sum(errors) over () / sum(calls) over ()::double global_error_rate, errors / calls::double >= 0.1 high_error from (select tool, count(*) calls, count(*) filter (status = 'error') errors from tool_parts group by 1) order by calls desc, tool limit 10",
    "a35_replay_summary": "select session_id, count(*) steps, sum(input + output + cache_read) tokens, case when sum(input + cache_read + cache_write) > 0 then sum(cache_read) / sum(input + cache_read + cache_write) end strict_hit_rate from steps group by 1",
    "a36_percentile_tier": "select id, tokens::double tokens, case when tokens >= p99 then 'p99' when tokens >= p90 then 'p90' when tokens >= p50 then 'p50' else 'below' end tier from sessions, (select quantile_disc(tokens, 0.5) p50, quantile_disc(tokens, 0.9) p90, quantile_disc(tokens, 0.99) p99 from sessions where tokens > 0)",
    "a37_session_enrichment": "select s.id session_id, s.parent_id, s.tokens_reasoning, s.tokens_cache_write, array_to_string(list_sort(list_distinct(list_append(coalesce(m, []), s.launch))), ',') model_ids, coalesce(step_count, 0) step_count, coalesce(child_count, 0) child_count, coalesce(child_tokens, 0) child_tokens from sessions s left join (select session_id, list(model_id) m from steps where raw_model_id is not null group by 1) a on a.session_id = s.id left join (select session_id, count(*) step_count from messages where type = 'assistant' group by 1) b on b.session_id = s.id left join (select parent_id, count(*) child_count, cast(sum(tokens) as bigint) child_tokens from sessions group by 1) c on c.parent_id = s.id",
    "a38_strict_hit_rate": "select id, case when tokens_cache_read + tokens_input + tokens_cache_write > 0 then tokens_cache_read / (tokens_cache_read + tokens_input + tokens_cache_write)::double end strict_hit_rate from sessions",
    "w03_token_curve": "select session_id, message_id, seq, output + reasoning delta, sum(output + reasoning) over w running, input + cache_read + cache_write context, max(input + cache_read + cache_write) over w peak_so_far from steps window w as (partition by session_id order by seq rows unbounded preceding)",
    "w04_peak_context": "select session_id, max(input + cache_read + cache_write) peak_context from steps group by 1",
    "w05_model_changes": "select session_id, message_id, seq, coalesce(m, '') model, coalesce(m <> last_value(m ignore nulls) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding), false) model_changed from (select *, nullif(raw_model_id, '') m from steps)",
    "w06_turn_costs": "select session_id, message_id, seq, cache_read, input, output, case when t > 0 then cache_read / t end read_share, case when t > 0 then input / t end paid_share, case when t > 0 then output / t end output_share from (select *, input + output + cache_read t from steps)",
    "t01_session_list": "select id, title, launch model_id, launch_provider provider_id, coalesce(nullif(agent, ''), 'unknown') agent, directory, time_created, time_updated, case when time_updated > time_created then time_updated - time_created end duration_ms, tokens, cost from sessions order by tokens desc, id limit 100 offset 5",
    "s07_session_summary_by_id": "select id, title, launch model_id, launch_provider provider_id, coalesce(nullif(agent, ''), 'unknown') agent, directory, time_created, time_updated, case when time_updated > time_created then time_updated - time_created end duration_ms, tokens, cost from sessions where id = '1499'",
    "t05_todo_view": "select session_id, content, status, position, cast(place as int) place, cast((place - 1) // 4 as int) page from (select *, row_number() over (partition by session_id order by r, position, content) place, min(r) over (partition by session_id) lowest from (select *, case status when 'in_progress' then 0 when 'pending' then 1 when 'completed' then 2 end r from todos) where r is not null) where lowest < 2",
    "t06_preferred_tools": "select * from (select s.agent, tool, count(*) calls, row_number() over (partition by s.agent order by count(*) desc, tool) place from tool_parts join steps s using (message_id) group by 1, 2) where place <= 3",
}

_STREAMS = {
    "r01_stream_daily_usage": "select cast(ts as date) as day, event_type model_id, count(*) steps, cast(sum(floor(abs(value))) as bigint) tokens from events group by 1, 2",
    "r02_stream_hourly_steps": "select date_trunc('hour', ts) hour_start, count(*) steps from events group by 1",
    "r03_stream_tool_errors": "select cast(ts as date) as day, count(*) tool_calls, count(*) filter (event_type = 'error') errors from events group by 1",
    "r04_stream_session_status": "select cast(user_id as varchar) session_id, count(*) steps, arg_max(event_id, (ts, event_id)) last_step, arg_max(event_type, (ts, event_id)) = 'error' last_has_error from events group by 1",
    "r05_stream_active_sessions": "select session_id, min(ts) \"begin\", max(ts) + interval 5 minute until, count(*) steps from (select *, sum(fresh) over (partition by session_id order by ts, event_id) n from (select cast(user_id as varchar) session_id, ts, event_id, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 5 minute then 0 else 1 end fresh from events)) group by session_id, n",
}

#: Columns of ratios and means, rounded to nine digits on both sides.
_ROUNDED = {
    "f05_step_rates": "hit_rate strict_hit_rate",
    "f18_estimate_tokens": "tokens",
    "f35_relative_delta": "relative_delta",
    "a01_overview": "today_hit_rate",
    "a02_daily_trend": "hit_rate",
    "a04_model_leaderboard": "context_avg hit_rate output_per_step reasoning_share token_share",
    "a07_tool_health": "error_rate",
    "a08_tool_error_trend": "error_rate",
    "a09_tool_tokens": "share",
    "a11_session_survival": "short_share",
    "a17_token_distribution": "high low mean",
    "a18_step_distribution": "high low mean",
    "a19_duration_distribution": "high low mean",
    "a20_child_share": "child_token_share",
    "a22_session_outcomes": "interrupted_share",
    "a25_token_ledger": "cache_hit_rate",
    "a26_token_ledger_totals": "residual_ratio",
    "a27_content_composition": "share tool_estimated_tokens",
    "a29_todo_stats": "completion_rate",
    "a30_top_tools": "error_rate global_error_rate share",
    "a33_overview_extension": "yesterday_hit_rate",
    "a35_replay_summary": "strict_hit_rate",
    "a38_strict_hit_rate": "strict_hit_rate",
    "a39_cache_support": "hit_rate",
    "w06_turn_costs": "output_share paid_share read_share",
    "t03_top_token_tools": "share",
}


def _rounded(name: str, query: str) -> str:
    columns = _ROUNDED.get(name, "").split()
    return f"select * replace ({', '.join(f'round({c}, 9) as {c}' for c in columns)}) from (\n{query}\n)" if columns else query


def sql() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return {name: _rounded(name, query) for name, query in _exact().items()}


def _exact() -> dict[str, str]:
    out = dict(_STREAMS)
    out |= {name: _with() + body for name, body in _PLAIN.items()}
    trend = _TREND.format(days="days")
    more = {
        "a02_daily_trend": ([trend], "select * from trend"),
        "a32_token_funnel": ([trend], "select sum(cache_read + input) supply, sum(cache_read) cached, sum(input) paid, sum(output) output from trend"),
        "a33_overview_extension": ([_TREND.format(days="(select * from days where i < 14)")], "select max(input) filter (day = today) today_input, max(output) filter (day = today) today_output, max(hit_rate) filter (day = today - 1) yesterday_hit_rate, max(steps) filter (day = today - 1) yesterday_steps, string_agg(cast(cast(input + output + cache_read as bigint) as varchar), ',' order by day) sparkline, round(max(input + output + cache_read) filter (day = today) / 1e6 * 0.13, 2) cost_estimate from trend, as_of"),
        "a34_calendar_levels": (
            [_TREND.format(days="(select cast(today - cast(j as int) as date) as day from as_of, range(0, 366) q(j))"), "t as (select day, input + output + cache_read tokens from trend)", "active as (select tokens, row_number() over (order by tokens) - 1 r, count(*) over () n from t where tokens > 0)", "marks as (select count(*) active_days, coalesce(sum(tokens), 0) year_tokens, " + ", ".join(f"max(tokens) filter (r = least(cast(floor({q} * n) as bigint), n - 1)) t{i}" for i, q in enumerate((0.25, 0.5, 0.75, 0.9))) + " from active)"],
            "select day, tokens, cast(case when tokens > 0 then (tokens >= t0)::int + (tokens >= t1)::int + (tokens >= t2)::int + (tokens >= t3)::int else 0 end as int) as level, active_days, year_tokens from t, marks",
        ),
        "a03_daily_trend_by_model": ([_BY_MODEL], "select day, model_id, window_tokens, cast(model_rank as int) model_rank, steps, tokens from cells"),
        "a31_stacked_models": ([_BY_MODEL], "select day, model_id series, cast(model_rank as int) place, tokens from cells where model_rank <= 3 union all select day, 'other', 4, greatest(sum(tokens) - coalesce(sum(tokens) filter (model_rank <= 3), 0), 0) from cells group by 1"),
        "a40_trend_pivot": ([_BY_MODEL], "select model_id, cast(model_rank as int) model_rank, string_agg(cast(cast(tokens as bigint) as varchar), ',' order by day) series from cells group by 1, 2"),
        "a04_model_leaderboard": ([_BOARD], "select model_id, provider_id, variant, steps, tokens, case when sum(tokens) over () > 0 then tokens / sum(tokens) over () else 0 end token_share, case when r + i > 0 then r / (r + i) else 0 end hit_rate, o / steps output_per_step, context_avg, context_median, context_p95, case when o + why > 0 then why / (o + why) else 0 end reasoning_share, first_seen, last_seen from board"),
        "a39_cache_support": ([_BOARD], "select model_id, provider_id, variant, tokens, h hit_rate, case when h = 0 and tokens > 0 then 'not_reported' when h = 0 then 'zero_denominator' when h >= 0.9 then 'high' else 'normal' end cache_support from (select *, case when r + i > 0 then r / (r + i) else 0 end h from board)"),
        "a05_model_comparison": (["now as (select model_id, provider_id, variant, sum(input + output + cache_read) tokens from steps join days using (day) group by 1, 2, 3)", "before as (select model_id, provider_id, variant, sum(input + output + cache_read) previous_tokens from steps, as_of where day between today - 59 and today - 30 group by 1, 2, 3)"], "select model_id, provider_id, variant, tokens, coalesce(previous_tokens, 0) previous_tokens from now left join before using (model_id, provider_id, variant)"),
        "a09_tool_tokens": ([_TOOL_TOKENS], "select tool, tokens, case when sum(tokens) over () > 0 then tokens / (sum(tokens) over ())::double else 0 end share, steps from tool_tokens"),
        "t03_top_token_tools": ([_TOOL_TOKENS], "select tool, tokens, tokens / (select sum(tokens) from tool_tokens)::double share, steps from tool_tokens where tool <> '' and tokens > 0 order by tokens desc, tool limit 10"),
        "a12_compaction_by_reason": ([_COMPACTIONS], "select reason, count(*) n, cast(sum(count(*)) over () as bigint) total from compactions group by 1"),
        "a13_compaction_daily": ([_COMPACTIONS], "select d.day, count(c.k) n from days d left join compactions c on cast(c.ts as date) = d.day group by 1"),
        "a14_compaction_top_sessions": ([_COMPACTIONS], "select session_id, count(*) n from compactions group by 1 order by 2 desc, 1 limit 10"),
        "a17_token_distribution": ([], _DISTRIBUTION.format("select tokens x from sessions")),
        "a18_step_distribution": ([], _DISTRIBUTION.format("select count(*) x from kept where type = 'assistant' group by session_id")),
        "a19_duration_distribution": ([], _DISTRIBUTION.format("select time_updated - time_created x from sessions")),
        "a22_session_outcomes": ([_LAST], "select (select count(*) from sessions) total_sessions, count(distinct session_id) sessions_with_steps, (select count(*) from last where has_error) interrupted, (select count(*) from last where has_error) / count(distinct session_id)::double interrupted_share from kept where type = 'assistant'"),
        "a23_outcome_error_types": ([_LAST], "select error_type, count(*) n from last where has_error and error_type <> '' group by 1"),
        "a24_recent_interrupted": ([_LAST], "select session_id, title, time_updated, error_type from last join sessions s on s.id = session_id where has_error order by time_updated desc nulls last, session_id limit 5"),
        "w01_last_steps": ([_LAST], "select session_id, seq, time_created, message_id, has_error, error_type from last"),
        "a26_token_ledger_totals": (["l as (" + _PLAIN["a25_token_ledger"] + ")"], "select count(*) sessions, cast(sum(messages) as bigint) messages, sum(prompt_total) prompt_total, sum(output) output, count(*) filter (least(prompt_input, prompt_read, prompt_write, output, reasoning, tokens_input, tokens_cache_read, tokens_cache_write, tokens_output) < 0) negative_components, count(*) filter (prompt_read > prompt_total) cache_read_exceeds_prompt, sum(tokens_input + tokens_cache_read + tokens_cache_write) - sum(prompt_total) residual, true balanced, (sum(tokens_input + tokens_cache_read + tokens_cache_write) - sum(prompt_total)) / sum(prompt_total) residual_ratio, abs((sum(tokens_input + tokens_cache_read + tokens_cache_write) - sum(prompt_total)) / sum(prompt_total)) <= 0.02 within_tolerance from l"),
        "a27_content_composition": (
            ["chars as (select session_id, case kind when 'text' then 'assistantText' when 'reasoning' then 'reasoning' else 'other' end category, case kind when 'text' then p_name when 'reasoning' then p_type else '{\"type\":\"image\",\"text\":\"x\"}' end t from parts where kind in ('text', 'reasoning', 'image') union all select session_id, 'toolInput', '{\"path\":\"' || path || '\"}' from parts where kind = 'tool' union all select session_id, 'toolOutput', p_name from parts where kind = 'tool' union all select session_id, 'userText', o_orderpriority || ' order ' || k from kept where type = 'user')", "sums as (select category, cast(sum(length(t)) as bigint) chars, cast(sum(octet_length(encode(t))) as bigint) octets, count(distinct session_id) sessions from chars group by 1)"],
            "select category, coalesce(chars, 0) chars, coalesce(chars, 0) / (sum(chars) over ())::double share, cast(sum(chars) over () as bigint) total, coalesce(sessions, 0) sessions, case when category in ('toolInput', 'toolOutput') then greatest(chars - greatest((octets - chars) / 2.0, 0), 0) / 4.0 + greatest((octets - chars) / 2.0, 0) else 0 end::double tool_estimated_tokens from (values ('assistantText'), ('toolOutput'), ('toolInput'), ('reasoning'), ('userText'), ('other')) c(category) left join sums using (category)",
        ),
        "k03_session_report": ([_PROMPT], "select s.id session_id, " + ", ".join(f"count(m.k) filter (type = '{t}') {t.replace('-', '_')}" for t in ("user", "assistant", "system", "model-switched", "compaction")) + ", cast(0 as bigint) other, coalesce(any_value(n), 0) prompt_chars from sessions s left join messages m on m.session_id = s.id left join (select session_id, cast(sum(length(\"text\")) as bigint) n from prompts group by 1) q on q.session_id = s.id group by 1"),
        "j08_system_prompt": ([_PROMPT], "select session_id, key, \"text\" from prompts"),
        "w09_session_events": ([_EVENTS], "select session_id, event_id, seq, time_created, kind, detail from events"),
        "j09_pinned_events": ([_EVENTS, "ordered as (select *, lag(input + cache_read + cache_write) over (partition by session_id order by seq) context_before from steps)"], "select e.session_id, event_id, kind, message_id step_id, o.seq step_seq, context_before from events e asof join ordered o on e.session_id = o.session_id and e.seq <= o.seq where kind <> 'system'"),
        # the window: 120 characters from so far before the match that it is in the middle, or from the start
        "x01_search_messages": _search("urgent"),
        "x01_indexed_search": _search("urgent"),
        "x01_search_inputs": _search(r'\{\s+"path": "/srv/1\d"'),
        "x02_session_find": ([_TEXTS, "placed as (select *, row_number() over (partition by session_id order by seq) - 1 place from texts where type not in ('idle', 'synthetic'))"], "select session_id, id, place from placed where contains(lower(txt), 'note 1')"),
        "g01_lineage_normalized": ([_FOREST], "select id, parent, self_parent, orphan from nodes"),
        "g02_lineage_forest": ([_FOREST], "select id, parent, cut from trees"),
        "g03_lineage": ([_FOREST], "select id, parent, depth, subtree_size, children from shape"),
        "g03_lineage_summary": ([_FOREST], "select (select count(*) from nodes) sessions, (select count(*) filter (self_parent) from nodes) self_parents, (select count(*) filter (orphan) from nodes) orphans, count(*) filter (cut) cycles_cut, count(*) filter (parent is null) roots, count(parent) children, (select max(depth) from shape) max_depth from trees"),
        "g04_lineage_focus": ([_FOREST], "select * from shape where id in (select ancestor from up where id = '7' union select id from up where ancestor = '7')"),
        "g05_lineage_graph": ([_FOREST, _GRAPH], "select id, parent, cast(position as int) position, depth, subtree_size, (select count(*) from shape) - (select count(*) from taken) omitted from taken"),
        "g05_lineage_edges": ([_FOREST, _GRAPH], "select parent, id from taken where parent in (select id from taken)"),
        "f29_markdown_texts": ([], rf"""select doc_id, sha256(regexp_replace(text, '([\\`*_\[\]<>#|~])', '\\\1', 'g')) escaped,
  sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when regexp_matches(l, '^{_BLANK}*$') then '>' else '> ' || l end), chr(10))) quoted,
  sha256(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g'), ' ')) line, sha256(fence || 'json' || chr(10) || t || chr(10) || fence) fenced,
  case when n_chars > 0 then strftime(make_timestamp(n_chars * 86399000000), '%Y-%m-%d %H:%M') else '-' end as minute,
  case when n_chars > 2000 then format('{{:,}}', n_chars * 1000 - 2000000) else '0' end thousands,
  case when n_chars % 8 = 0 then cast(n_chars // 8 as varchar) else cast(n_chars / 8.0::double as varchar) end number
from (select *, repeat('`', cast(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0)) as int)) fence from (select *, regexp_replace(text, '[aeiou]', '`', 'g') t from documents))"""),
        "f30_cut_texts": ([], "select doc_id, sha256(case when length(text) > 200 then text[:200] || '...' else text end) notice, sha256(case when length(text) > 1000 then text[:1000] || chr(10) || '...（截断，完整 ' || length(text) || ' 字符）' else text end) output from documents"),
        "w08_pack_messages": _packs(200, 300_000),
        "w08_small_packs": _packs(5, 700),
        "f18_estimate_tokens": ([], "select source, chars, octets, greatest(chars - greatest((octets - chars) / 2.0, 0), 0) / 4.0 + greatest((octets - chars) / 2.0, 0) tokens from (select source, cast(sum(length(coalesce(text, ''))) as bigint) chars, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) octets from documents group by 1)"),
    }
    comparison = more["a05_model_comparison"]
    board = "select tokens, previous_tokens, case when previous_tokens > 0 then (tokens - previous_tokens) / previous_tokens end relative_delta, tokens * 2 guess from (" + comparison[1] + ")"
    told = (("tokens", "exact", "null::varchar"), ("previous_tokens", "exact", "null::varchar"), ("relative_delta", "exact", "'there is no window before to compare with'"), ("guess", "estimate", "'the field was not recorded'"))
    more["f36_figures"] = (comparison[0], " union all ".join(f"select '{f}' figure, '{p}' \"precision\", {m} missing, count(*) \"rows\", count(*) - count({f}) nulls from ({board})" for f, p, m in told))
    more["f35_relative_delta"] = (comparison[0], "select *, case when previous_tokens > 0 then (tokens - previous_tokens) / previous_tokens end relative_delta from (" + comparison[1] + ")")
    return out | {name: (_with(*found[0]) if found[0] or "documents" not in found[1] else "") + ("" if not found[1].lstrip().startswith("v as") else ", ") + found[1] for name, found in more.items() if found}
