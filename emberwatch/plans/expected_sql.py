"""DuckDB statements every catalog query must agree with, written independently of the plans."""

from __future__ import annotations

DAY = 86_400_000_000
SPLIT_US, NOW_US = 1705363200000000, 1706659200000000
EXPECTED: dict[str, str] = {}

EV = """ev as (
  select event_id as seq, ts, epoch_us(ts) as us, user_id as uid, event_type as et,
    cast(json_extract(props, '$.k') as int) as k,
    'src' || (user_id % 5) as source_id, 'web' || (user_id % 5) as host, 'sshd' as app, 'u' || user_id as usr,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) as ip,
    case event_type when 'error' then 'failure' when 'purchase' then 'success' else '' end as auth,
    cast(round(value * 100) as bigint) * 10000 as bytes,
    'ev ' || event_id || ' ' || event_type as raw,
    epoch_us(ts)::hugeint * 10000000 + event_id as pos
  from events)"""

# --- parsing -------------------------------------------------------------------------------------

_IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FIELDS = rf"""
  case when regexp_matches(regexp_extract(m, '(?i)(?:from|rhost=|src=|client=)\s*[:\[]?([0-9a-fA-F\.:]+)', 1), '^{_IP}$')
    then regexp_extract(m, '(?i)(?:from|rhost=|src=|client=)\s*[:\[]?([0-9a-fA-F\.:]+)', 1)
    else regexp_extract(m, '\b(\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})\b', 1) end as src_ip,
  case when u0 <> '' and not regexp_matches(u0, '^{_IP}$') then u0
    else regexp_extract(m, '(?i)\bname=["'']?([A-Za-z0-9._\-\\$]+)', 1) end as "user",
  coalesce(case when try_cast(regexp_extract(m, '(?i)(?:DPT=|dport[ =])(\d{{1,5}})', 1) as int) between 1 and 65535
    then try_cast(regexp_extract(m, '(?i)(?:DPT=|dport[ =])(\d{{1,5}})', 1) as int) end, 0) as dst_port,
  coalesce(try_cast(regexp_extract(m, '(?i)(?:bytes[=:]?|sent[=:]?)\s*(\d{{2,}})', 1) as bigint), 0) as bytes_out"""
_USER0 = r"""regexp_extract(m, '(?i)(?:for(?: invalid user)?|user=?|account(?: name)?:?)\s+"?([A-Za-z0-9._\-\\$]+)"?', 1) as u0"""


def _id(n: str) -> str:
    return rf"((l like '%event%' or l like '%microsoft-windows%' or l like '%security%') and regexp_matches(m, '(?i)(?:event\s*id[:=]?\s*|eventid[:=]?\s*|\b){n}\b'))"


_AUTH = f"""
  case when {_id('4625')} then 'failure' when {_id('4624')} then 'success'
    when l like '%failed password%' or l like '%authentication failure%' or l like '%invalid user%'
      or l like '%failed publickey%' or l like '%permission denied%' then 'failure'
    when l like '%accepted password%' or l like '%accepted publickey%' or l like '%session opened for user%' then 'success'
    else '' end as auth,
  case when ({_id('(4720|4728|4732)')} and not {_id('4625')} and not {_id('4624')})
      or ((lower(app) = 'useradd' or l like '%useradd%') and (l like '%new user%' or l like '%new account%'))
      or ((l like '%usermod%' or l like '%gpasswd%') and (l like '%sudo%' or l like '%wheel%' or l like '%admin%'))
      or l like '%to group ''sudo''%' or l like '%to group ''wheel''%' then 'new_admin'
    when l like '% deny%' or l like '%blocked%' or l like '%drop%' then 'deny'
    when l like '% accept%' or l like '%allow%' or l like '%pass %' then 'accept' else '' end as action"""

LINES = """lines as (
  select event_id as seq, 'src' || (user_id % 5) as source_id, et, ts, uid, n, bsd, iso,
    case et when 'error' then '<38>' || bsd || ' web1 sshd[' || n || ']: Failed password for invalid user u' || uid || ' from 10.0.0.' || uid || ' port 2200 ssh2'
      when 'purchase' then '<38>' || bsd || ' web2 sshd: Accepted password for u' || uid || ' from 10.0.1.9 port ' || n || ' ssh2'
      when 'signup' then '<86>1 ' || iso || ' web3 useradd ' || n || ' - [meta seq="' || n || '"] new user: name=u' || uid || ', home=/home/u'
      when 'click' then '<134>1 ' || iso || ' fw1 - - - - OUT=eth0 SRC=192.168.7.' || uid || ' DPT=' || n || ' bytes=' || cents || ' deny'
      else '10.1.2.3 - - "GET /item/' || n || '" 200 sent=' || cents end as value
  from (select *, event_type as et, user_id as uid, event_id as n, cast(round(value * 100) as bigint) as cents,
      strftime(ts, '%b ') || lpad(cast(day(ts) as varchar), 2, ' ') || strftime(ts, ' %H:%M:%S') as bsd,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events))"""


def _syslog(source: str) -> str:
    # The shapes are known, so the frame is cut by position and pattern instead of a cascade.
    return f"""with {LINES}, framed as (
      select *, case when et in ('error', 'purchase') then epoch_us(make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))))
          when et = 'view' then 1706745600000000 else epoch_us(date_trunc('second', ts)) end as us,
        regexp_replace(value, '^<[0-9]+>', '') as rest,
        coalesce(try_cast(regexp_extract(value, '^<([0-9]+)>', 1) as int) % 8, -1) as severity
      from lines), split as (
      select *, case et when 'error' then 'web1' when 'purchase' then 'web2' when 'signup' then 'web3' when 'click' then 'fw1' else '' end as host,
        case et when 'error' then 'sshd' when 'purchase' then 'sshd' when 'signup' then 'useradd' else '' end as app,
        case when et in ('error', 'purchase') then regexp_extract(rest, '^.{{15}} [^ ]+ [^:]+: (.*)$', 1)
          when et = 'signup' then regexp_extract(rest, '\\] (.*)$', 1)
          when et = 'click' then regexp_extract(rest, ' - - - - (.*)$', 1) else rest end as message
      from framed), msgs as (select *, message as m, lower(message) as l from split), us0 as (select *, {_USER0} from msgs)
      select seq, us, '{source}' as source, source_id, host, app, severity, message, {_AUTH}, {_FIELDS}, et <> 'view' as parsed from us0"""


EXPECTED["parse_syslog"] = _syslog("syslog")
EXPECTED["parse_windows_source"] = _syslog("windows")
EXPECTED["parse_lines"] = f"""with {LINES}, plain as (
  select *, regexp_replace(value, '^<[0-9]+>', '') as rest, et in ('error', 'purchase') as hdr from lines), split as (
  select *, case when hdr then epoch_us(date_trunc('second', ts)) else 1706745600000000 end as us,
    case et when 'error' then 'web1' when 'purchase' then 'web2' else '' end as host, 'ctr' as app,
    case when hdr then regexp_extract(rest, '^.{{15}} [^ ]+ [^:]+: (.*)$', 1) else rest end as message from plain),
  msgs as (select *, message as m, lower(message) as l from split), us0 as (select *, {_USER0} from msgs)
  select seq, us, 'docker' as source, source_id, host, app, -1 as severity, message, {_AUTH}, {_FIELDS}, true as parsed from us0"""
EXPECTED["fan_in"] = f"""with {LINES}, body as (select *, case when seq % 2 = 1 or et = 'view' then value
      when et in ('error', 'purchase') then regexp_extract(value, '^.{{19}} [^ ]+ [^:]+: (.*)$', 1)
      when et = 'signup' then regexp_extract(value, '\\] (.*)$', 1) else regexp_extract(value, ' - - - - (.*)$', 1) end as m from lines),
    msgs as (select *, lower(m) as l, case when et = 'signup' and seq % 2 = 0 then 'useradd' else '' end as app from body),
    a as (select *, {_AUTH} from msgs)
  select case when seq % 2 = 0 then 'net' else source_id end as source_id, auth, action, seq % 2 = 1 or et <> 'view' as parsed, count(*) as n
  from a group by all"""
_DOCS = f"with msgs as (select doc_id, text as m, lower(text) as l, '' as app from documents), us0 as (select *, {_USER0} from msgs)"
EXPECTED["src_ip_documents"] = f"{_DOCS} select doc_id, {_FIELDS} from us0"
EXPECTED["auth_classify"] = f"{_DOCS} select doc_id, {_AUTH} from us0"
EXPECTED["is_ip_documents"] = f"""with words as (select unnest(regexp_split_to_array(text, '[ \\n]+')) as w from documents),
  g as (select w, count(*) as n from words group by w),
  p as (select *, regexp_matches(w, '^{_IP}$') as ip, try_cast(split_part(w, '.', 1) as int) as a, try_cast(split_part(w, '.', 2) as int) as b from g)
  select w, n, ip, ip and (a in (10, 127) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31)) as private from p"""
EXPECTED["actor"] = f"""with {EV} select case seq % 3 when 0 then ip when 1 then 'user:' || usr else host end as actor, count(*) as n from ev group by 1"""
EXPECTED["human_bytes"] = f"""with {EV}, s as (select seq, bytes * cast(pow(7, seq % 8) as bigint) as b from ev)
  select seq, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', b / 1024.0) when b < 1073741824 then printf('%.1f MB', b / 1048576.0)
    when b < 1099511627776 then printf('%.1f GB', b / 1073741824.0) when b < 1125899906842624 then printf('%.1f TB', b / 1099511627776.0)
    else printf('%.1f PB', b / 1125899906842624.0) end as size from s"""
_BAIT = EV + """, bait as (select *, case when k % 3 = 0 then 'trap' else 'rules' end as product,
    case k % 4 when 0 then 'critical' when 1 then 'high' else 'low' end as sev, case when k % 10 = 9 then 'resolved' else 'open' end as status from ev)"""
EXPECTED["forwarded_tokens"] = f"""with {_BAIT} select product, sev as severity, 'c.' || (k % 7) as "check", status, count(*) as n from bait group by all"""

# --- sliding windows -----------------------------------------------------------------------------


def _n(key: str, w: int) -> str:
    """Rows of the key in [us-w, us] less those that follow in the same microsecond."""
    return f"""(count(*) over (partition by {key} order by us range between {w} preceding and current row)
      - count(*) over (partition by {key}, us order by seq rows between 1 following and unbounded following))"""


def _total(w: int) -> str:
    return f"""(sum(bytes) over (partition by host order by us range between {w} preceding and current row)
      - coalesce(sum(bytes) over (partition by host, us order by seq rows between 1 following and unbounded following), 0))"""


def _distinct(rows: str, w: int) -> str:
    """Distinct v per row over [us-w, us] up to the row, by comparing rows directly."""
    return f"""(select a.k, a.seq, count(distinct b.v) as d from {rows} a join {rows} b
      on b.k = a.k and b.us >= a.us - {w} and b.pos <= a.pos group by a.k, a.seq)"""


EXPECTED["rolling_count"] = f"with {EV} select usr as k, us, seq, {_n('usr', DAY)} as n from ev"
EXPECTED["rolling_distinct"] = f"""with {EV}, r as (select host as k, us, seq, pos, ip as v from ev)
  select r.k, us, r.seq, d as n from r join {_distinct('r', DAY)} x on x.seq = r.seq"""
EXPECTED["rolling_sum"] = f"with {EV} select host as k, us, seq, cast({_total(3_600_000_000)} as bigint) as total from ev"


def _fires(d: int, cand: str = "cand") -> str:
    """Greedy thinning of (k, us) one fire per key and step."""
    return f"""fires as (select k, min(us) as us from {cand} group by k
      union all select f.k, min(c.us) from fires f join {cand} c on c.k = f.k and c.us >= f.us + {d} group by f.k, f.us)"""


EXPECTED["cooldown"] = f"""with recursive {EV}, cand as (select usr as k, us, min(seq) as seq from ev group by all), {_fires(2 * DAY)}
  select k, us, seq from fires join cand using (k, us)"""
_TOTALS = f"""tot as (select host as k, us, seq, pos, source_id, usr, raw, host, cast({_total(3_600_000_000)} as bigint) as total,
    row_number() over (partition by host order by us, seq) as rn from ev where bytes > 0),
  base as (select k, rn, 0::double as b0, total::double as b1 from tot where rn = 1
    union all select t.k, t.rn, b.b1, 0.8 * b.b1 + 0.2 * t.total from base b join tot t on t.k = b.k and t.rn = b.rn + 1)"""
EXPECTED["ewma_baseline"] = f"""with recursive {EV}, {_TOTALS}
  select k, us, seq, total, cast(round(b0 / 1000) as bigint) as base_before, cast(round(b1 / 1000) as bigint) as base_after from tot join base using (k, rn)"""

EXPECTED["rolling_hot"] = f"""with {EV}, r as (select 'all' as k, us, seq, pos, ip as v, bytes from ev),
  s as (select *, (count(*) over (order by pos range between unbounded preceding and current row)) as upto, sum(bytes) over (order by pos range between unbounded preceding and current row) as sum_upto from r),
  gone as (select a.seq, count(b.seq) as n, coalesce(sum(b.bytes), 0) as total from r a left join r b on b.us < a.us - {DAY} group by a.seq)
  select s.k, s.us, s.seq, upto - gone.n as n, cast(sum_upto - gone.total as bigint) as total, d as addresses from s join gone using (seq) join {_distinct('r', DAY)} x on x.seq = s.seq"""
EXPECTED["ewma_hot"] = f"""with recursive {EV}, r as (select us, seq, bytes, row_number() over (order by us, seq) as rn from ev),
  base as (select rn, 0::double as b0, bytes::double as b1 from r where rn = 1
    union all select r.rn, b.b1, 0.8 * b.b1 + 0.2 * r.bytes from base b join r on r.rn = b.rn + 1)
  select 'all' as k, us, seq, printf('%.6e', b0) as base_before, printf('%.6e', b1) as base_after from r join base using (rn)"""

# --- detectors -----------------------------------------------------------------------------------


EXPECTED["cooldown_dense"] = f"""with recursive {EV}, cand as (select host as k, us, min(seq) as seq from ev group by all), {_fires(3_600_000_000)}
  select k, us, seq from fires join cand using (k, us)"""


def _segments(rows: str = "rows") -> str:
    """The firing row of each fire and what it closes: cand has (k, us, seq, pos, n)."""
    return f"""one as (select k, us, min(pos) as pos from cand group by k, us),
    fr as (select f.k, one.pos, lag(one.pos) over (partition by f.k order by one.pos) as prev from fires f join one using (k, us)),
    seg as (select fr.k, fr.pos, min(r.us) as first_us, array_to_string(list(r.raw order by r.pos)[1:5], '|') as evidence
      from fr join {rows} r on r.k = fr.k and r.pos <= fr.pos and (fr.prev is null or r.pos > fr.prev) group by fr.k, fr.pos),
    hit as (select seg.*, c.* exclude (k, pos) from seg join cand c using (k, pos))"""


def _out(kind: str, order: int, severity: str, actor: str, target: str, user: str, title: str, detail: str, count: str, key: str,
         first: str = "first_us") -> str:
    return f"""select '{kind}' as kind, {severity} as severity, {actor} as actor, {target} as target, {user} as "user", {title} as title,
      {detail} as detail, cast({count} as bigint) as count, {first} as first_us, us as last_us, evidence, {key} as "key", source_id, {order} as ord"""


_BRUTE_CTE = f"""rows as (select *, ip as key_ from ev where auth = 'failure'),
  brows as (select key_ as k, us, seq, pos, host, usr, raw, source_id, {_n('key_', DAY)} as n from rows)"""
_BRUTE = _out("brute_force", 1, "'high'", "k", "host", "usr", "'Brute force: ' || n || ' failed logins from ' || k",
              "n || ' authentication failures within 24h0m0s (target ' || host || ').'", "n", "'brute|' || k")
_SCAN = _out("scan", 2, "'medium'", "k", "host", "''", "'Port scan: ' || k || ' hit ' || n || ' distinct ports'",
             "n || ' distinct destination ports within 24h0m0s.'", "n", "'scan|' || k")
_SCAN_ROWS = "srows as (select ip as k, us, seq, pos, host, usr, raw, source_id, k as v from ev)"
EXPECTED["brute_force"] = f"""with recursive {EV}, {_BRUTE_CTE}, cand as (select * from brows where n >= 3), {_fires(5 * DAY)}, {_segments('brows')} {_BRUTE} from hit"""
EXPECTED["port_scan"] = f"""with recursive {EV}, {_SCAN_ROWS}, cand as (select s.*, d as n from srows s join {_distinct('srows', DAY)} x on x.seq = s.seq where d >= 6),
  {_fires(5 * DAY)}, {_segments('srows')} {_SCAN} from hit"""
EXPECTED["brute_force_short_cooldown"] = f"""with recursive {EV},
  r as (select ip as k, us, seq, row_number() over (partition by ip order by us, seq) as i from ev where auth = 'failure'),
  fires as (select k, us, seq, i, cast(0 as bigint) as before from r where exists (select 1 from r o where o.k = r.k and o.i = r.i - 1 and o.us >= r.us - {4 * DAY})
      qualify i = min(i) over (partition by k)
    union all select n.k, n.us, n.seq, n.i, f.i from fires f join r n on n.k = f.k and n.i = (select min(x.i) from r x join r o on o.k = x.k and o.i = x.i - 1 and o.us >= x.us - {4 * DAY}
      where x.k = f.k and x.i >= f.i + 2 and x.us >= f.us + {DAY // 2}))
  select k as actor, us, seq, (select count(*) from r o where o.k = fires.k and o.i > fires.before and o.i <= fires.i and o.us >= fires.us - {4 * DAY}) as count from fires"""


def _restarting(rows: str, window: int, cooldown: int, need: int, values: int, count: str) -> str:
    """Row by row: (last_i, last_us) is the place of the fire before, and the window begins after it."""
    return f"""with recursive {EV}, {rows},
  walk(k, i, us, seq, last_i, last_us, count) as (
    select distinct k, 0::bigint, 0::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint from r
    union all select n.k, n.i, n.us, n.seq, case when w.count is null then w.last_i else w.i end, case when w.count is null then w.last_us else w.us end, c.count
      from walk w join r n on n.k = w.k and n.i = w.i + 1,
      lateral (select case when count(*) >= {need} and count(distinct o.v) >= {values} and coalesce(n.us - case when w.count is null then w.last_us else w.us end >= {cooldown}, true) then {count} end as count
        from r o where o.k = n.k and o.i <= n.i and o.us >= n.us - {window} and o.i > case when w.count is null then w.last_i else w.i end) c)
  select k as actor, us, seq, count from walk where count is not null"""


EXPECTED["port_scan_short_cooldown"] = _restarting(
    "r as (select ip as k, us, seq, ev.k as v, row_number() over (partition by ip order by us, seq) as i from ev)", 4 * DAY, DAY // 2, 1, 4, "count(distinct o.v)")
EXPECTED["auth_spike_short_cooldown"] = _restarting(
    "r as (select host || '/sshd' as k, us, seq, ip as v, row_number() over (partition by host order by us, seq) as i from ev where auth = 'failure')", 3 * DAY, DAY // 2, 4, 3, "count(*)")
_SIZE = "case when total < 1073741824 then printf('%.1f MB', total / 1048576.0) else printf('%.1f GB', total / 1073741824.0) end"
EXPECTED["exfil"] = f"""with recursive {EV}, {_TOTALS}, cand as (select * from tot join base using (k, rn) where total >= 52428800 and b0 <> 0 and total >= 4 * b0),
  {_fires(5 * DAY)}, {_segments('tot')}
  {_out('exfil', 3, "'high'", 'k', 'host', "''", f"'Abnormal egress from ' || k || ': ' || {_SIZE}",
        f"{_SIZE} || ' outbound within 1h0m0s — ~' || printf('%.1f', total / b0) || '× this host''s baseline.'", '1', "'exfil|' || k", 'us')} from hit"""
EXPECTED["new_admin"] = f"""with recursive {EV}, cand as (select 'newadmin|' || host || '|' || usr as k, us, min(seq) as seq from ev where et = 'signup' and ev.k < 10 group by all),
  {_fires(5 * DAY)}, hit as (select f.k as fk, e.*, e.raw as evidence from fires f join cand c using (k, us) join ev e on e.seq = c.seq)
  {_out('new_admin', 4, "'high'", 'ip', 'host', 'usr', "'New privileged account created: ' || usr",
        "'A new user/admin account or privilege grant was recorded — a classic persistence step. Confirm it was authorised.'", '1', 'fk', 'us')} from hit"""
EXPECTED["auth_spike"] = f"""with recursive {EV}, prow as (select host || '/sshd' as k, us, seq, pos, host, usr, raw, source_id, ip as v from ev where auth = 'failure'),
  counted as (select *, {_n('k', 3 * DAY)} as n from prow),
  cand as (select c.*, d from counted c join {_distinct('prow', 3 * DAY)} x on x.seq = c.seq where n >= 6 and d >= 3),
  {_fires(5 * DAY)}, {_segments('prow')}
  {_out('auth_spike', 5, "'medium'", 'k', 'host', "''", "'Distributed auth-failure spike on ' || k || ': ' || n || ' from ' || d || ' sources'",
        "n || ' auth failures on ' || k || ' from ' || d || ' distinct sources within 72h0m0s — looks like credential stuffing.'", 'n', "'spike|' || k")} from hit"""
_BAIT_HITS = f"""bmsg as (select *, 'sentinel|' || product || '|' || ip as key_,
    'bait | product=' || product || ' severity=' || sev || ' check=c.' || (k % 7) || ' target=t status=' || status || ' src=' || ip as message
    from bait where status <> 'resolved' and sev <> 'low'),
  bcand as (select key_ as k, us, min(seq) as seq from bmsg group by all)"""
_BAIT_FIRED = """bfired as (select b.*, row_number() over (partition by ip order by b.us, b.seq) as rn
    from bfires f join bcand c using (k, us) join bmsg b on b.seq = c.seq)"""
_BFIRES = _fires(5 * DAY, "bcand").replace("fires", "bfires")
EXPECTED["forwarded_finding"] = f"""with recursive {_BAIT}, {_BAIT_HITS}, {_BFIRES}, {_BAIT_FIRED},
  hit as (select a.*, array_to_string((select list(b.raw order by b.rn) from bfired b where b.ip = a.ip and b.rn <= least(a.rn, 5)), '|') as evidence from bfired a)
  {_out('sentinel_finding', 6, 'sev', 'ip', 'host', "''", "product || ' reported c.' || (k % 7) || ' from ' || ip",
        "'A ' || sev || ' finding from ' || product || ' arrived over syslog: ' || message", '1', 'key_', 'us')} from hit"""
EXPECTED["detect_all"] = " union all ".join(
    f"select * from ({EXPECTED[name]})" for name in ("brute_force", "port_scan", "exfil", "new_admin", "auth_spike", "forwarded_finding"))

# --- incidents -----------------------------------------------------------------------------------

_W, _COOL = 3 * DAY, 6 * DAY
_AGAIN = DAY + 1_000_000
# Places have the order of detectors on one event as their last digit.
EXPECTED["killchain_short_cooldown"] = f"""with recursive {_BAIT},
  {_BRUTE_CTE}, bc as (select k, us, min(pos) as pos from brows where n >= 2 group by all), {_fires(_AGAIN, "bc").replace("fires", "bf")},
  srows as (select ip as k, us, seq, pos, k as v from ev), sx as (select s.*, d from srows s join {_distinct('srows', DAY)} x on x.seq = s.seq where d >= 3),
  scn as (select k, us, min(pos) as pos from sx group by all), {_fires(_AGAIN, "scn").replace("fires", "sf")},
  b as (select bf.k, us, pos * 10 + 1 as pos from bf join bc using (k, us)), s as (select sf.k, us, pos * 10 + 2 as pos from sf join scn using (k, us)),
  {_BAIT_HITS}, {_fires(_AGAIN, "bcand").replace("fires", "bfires")}, {_BAIT_FIRED},
  ok as (select ip as k, e.us, e.pos * 10 + 7 as pos, e.host, e.source_id, max(b.pos) as bpos from ev e join b on b.k = e.ip and b.pos < e.pos * 10 + 7 where e.auth = 'success' group by all),
  look as (select a.ip as k, a.us, a.pos * 10 + 6 as pos, a.host, a.source_id, (select max(s.pos) from s where s.k = a.ip and s.pos < a.pos * 10 + 6) as spos,
      (select max(b.pos) from b where b.k = a.ip and b.pos < a.pos * 10 + 6) as bpos from bfired a),
  st as (select l.*, case when l.us - ss.us <= {_W} then l.spos end as lspos, case when l.us - bb.us <= {_W} then l.bpos end as lbpos
    from look l left join s ss on ss.k = l.k and ss.pos = l.spos left join b bb on bb.k = l.k and bb.pos = l.bpos),
  cand as (select ok.k, ok.us, ok.pos, host, source_id, 'success' as what, bpos as need from ok join b on b.k = ok.k and b.pos = ok.bpos where ok.us - b.us <= {_W}
    union all select k, us, pos, host, source_id, 'deception', greatest(coalesce(lspos, lbpos), coalesce(lbpos, lspos)) from st where lspos is not null or lbpos is not null),
  fires as (select k, min(pos) as pos, null::hugeint as prev from cand group by k
    union all select f.k, min(c.pos), f.pos from fires f join cand p on p.k = f.k and p.pos = f.pos
      join cand c on c.k = f.k and c.us >= p.us + {DAY // 4} and c.need > f.pos group by f.k, f.pos),
  inc as (select c.*, f.prev, (select max(s.pos) from s where s.k = c.k and s.pos <= c.pos and (f.prev is null or s.pos > f.prev)) as spos,
      (select max(b.pos) from b where b.k = c.k and b.pos <= c.pos and (f.prev is null or b.pos > f.prev)) as bpos from fires f join cand c on c.k = f.k and c.pos = f.pos),
  full_ as (select inc.*, ss.us as sus, bb.us as bus,
      case what when 'success' then coalesce(bb.us - ss.us between 0 and {_W}, false) else coalesce(inc.us - ss.us <= {_W}, false) end as has_s,
      what = 'success' or coalesce(inc.us - bb.us <= {_W}, false) as has_b
    from inc left join s ss on ss.k = inc.k and ss.pos = inc.spos left join b bb on bb.k = inc.k and bb.pos = inc.bpos)
  select case when has_s or what = 'deception' then 'critical' else 'high' end as severity, k as actor, host as target,
    case when has_s then 'scan>' else '' end || case when has_b then 'brute_force>' else '' end || what as stages,
    case when what = 'success' then least(bus, coalesce(sus, bus)) when has_s and has_b then least(sus, bus) when has_s then sus else bus end as first_us,
    us as last_us, source_id from full_"""
_STAGES = f"""br as (select * from ({EXPECTED['brute_force']})), sc as (select * from ({EXPECTED['port_scan']})),
  b as (select actor as k, last_us as us, last_us::hugeint * 10000000 + seq as pos, title, target from br join ev on ev.us = last_us and ev.ip = actor),
  s as (select actor as k, last_us as us, last_us::hugeint * 10000000 + seq as pos, title, target from sc join ev on ev.us = last_us and ev.ip = actor)"""
_LOGINS = f"""ok as (select ip as k, e.us, e.seq, e.pos, e.host, e.usr, e.raw, e.source_id, max(b.pos) as bpos from ev e join b on b.k = e.ip and b.pos < e.pos
    where e.auth = 'success' group by all),
  cand as (select ok.*, 'success' as what from ok join b on b.k = ok.k and b.pos = ok.bpos where ok.us - b.us <= {_W})"""
_CHAIN = f"""with recursive {EV}, {_STAGES}, {_LOGINS}, {_fires(_COOL)},
  inc as (select c.*, lag(c.pos) over (partition by c.k order by c.pos) as prev from fires f join cand c using (k, us)),
  full_ as (select i.*, bb.us as bus, bb.title as btitle, ss.us as sus, ss.title as stitle,
      coalesce(bb.us - ss.us between 0 and {_W}, false) as has
    from inc i join b bb on bb.k = i.k and bb.pos = i.bpos
    left join s ss on ss.k = i.k and ss.pos = (select max(x.pos) from s x where x.k = i.k and x.pos <= i.pos) and (i.prev is null or ss.pos > i.prev))"""
EXPECTED["killchain_success"] = f"""{_CHAIN}
  select case when has then 'critical' else 'high' end as severity, k as actor, host as target,
    case when has then 'Likely intrusion from ' || k || ': scan → brute force → successful login' else 'Successful login after brute force from ' || k end as title,
    k || ' authenticated successfully to ' || host || ' immediately after a brute-force attempt' || case when has then ', itself preceded by a port scan from the same source' else '' end
      || '. Treat as a possible account compromise: rotate the credential and review the session.' as detail,
    case when has then 'scan>brute_force>success' else 'brute_force>success' end as stages,
    least(bus, coalesce(sus, bus)) as first_us, us as last_us, 'killchain|' || k as "key", source_id from full_"""
_STAMP = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%SZ') || '  [{1}]  ' || {2}"
EXPECTED["incident_members"] = f"""{_CHAIN}, lines as (select k, source_id, case when has then 3 else 2 end as n, list_filter([
      case when has then {_STAMP.format('sus', 'scan', 'stitle')} end, {_STAMP.format('bus', 'brute_force', 'btitle')},
      {_STAMP.format('us', 'success', "'successful login as ' || usr || ' on ' || host")}], lambda x: x is not null) as ls from full_)
  select source_id, 'killchain|' || k as "key", 'incident.killchain' as "check", cast(n as bigint) as count,
    'Treat as a possible compromise: isolate the host, rotate the affected credential, and review the session.' as fix,
    cast(unnest(generate_series(0, len(ls) - 1)) as int) as pos, unnest(ls) as line from lines"""
EXPECTED["killchain_deception"] = f"""with recursive {_BAIT}, {_STAGES}, {_BAIT_HITS}, {_BFIRES}, {_BAIT_FIRED},
  look as (select a.ip as k, a.us, a.pos, a.host, a.source_id, (select max(s.pos) from s where s.k = a.ip and s.pos <= a.pos) as spos,
      (select max(b.pos) from b where b.k = a.ip and b.pos <= a.pos) as bpos from bfired a),
  st as (select l.*, ss.us as sus, bb.us as bus, coalesce(l.us - ss.us <= {_W}, false) as has_s, coalesce(l.us - bb.us <= {_W}, false) as has_b
    from look l left join s ss on ss.k = l.k and ss.pos = l.spos left join b bb on bb.k = l.k and bb.pos = l.bpos),
  cand as (select * from st where has_s or has_b), {_fires(_COOL)}, hit as (select c.* from fires f join cand c using (k, us))
  select 'critical' as severity, k as actor, host as target,
    'Confirmed intrusion from ' || k || ': ' || case when has_s and has_b then 'scan → brute_force' when has_s then 'scan' else 'brute_force' end || ' → bait touched' as title,
    k || ' tripped a decoy after ' || case when has_s and has_b then 'a port scan and a brute-force attempt' when has_b then 'a brute-force attempt' else 'a port scan' end
      || ' from the same source. Bait has no legitimate users, so this is not a heuristic: treat the host as compromised, isolate it, and review everything that source touched.' as detail,
    case when has_s and has_b then 'scan>brute_force>deception' when has_s then 'scan>deception' else 'brute_force>deception' end as stages,
    case when has_s and has_b then least(sus, bus) when has_s then sus else bus end as first_us, us as last_us, 'killchain|' || k as "key", source_id from hit"""

# --- records and findings ------------------------------------------------------------------------

_FIX_BRUTE = "Block the source IP and confirm no login succeeded. Enforce rate-limiting / fail2ban and key-only auth."
_FIX_ADMIN = "Verify this account/privilege grant was authorised and change-controlled. If not, disable it and investigate."
REC = EV + f""", rec as (
  select source_id, kind || '|' || usr || '|' || (k % 20) as "key", 'detect.' || kind as chk,
    case when k < 10 then 'critical' when k < 30 then 'high' when k < 60 then 'medium' when k < 95 then 'low' else 'odd' end as severity,
    ip as actor, case when k % 2 = 0 then host else '' end as target, case when k = 50 then '' else 'T ' || raw end as title,
    'k=' || k as detail, case when k % 5 = 0 then '' else raw end as evidence,
    case kind when 'brute_force' then '{_FIX_BRUTE}' else '{_FIX_ADMIN}' end as fix, cast(k as bigint) as count,
    us - k * 60000000::bigint as first_us, us as last_us, seq, pos
  from (select *, case when auth = 'failure' then 'brute_force' else 'new_admin' end as kind from ev))"""


def _upsert(src: str) -> str:
    return f"""select source_id, "key", min(first_us) as first_us, arg_max(severity, pos) as severity, arg_max(title, pos) as title, arg_max(detail, pos) as detail,
      arg_max(evidence, pos) as evidence, arg_max(count, pos) as count, max(last_us) as last_us, max(pos) as pos, arg_max(seq, pos) as seq,
      arg_min(chk, pos) as chk, arg_min(actor, pos) as actor, arg_min(target, pos) as target, arg_min(fix, pos) as fix from {src} group by 1, 2"""


def _finding(src: str) -> str:
    """Findings of records, evidence JSON written out by hand."""
    stamp = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%SZ')"
    return f"""select substr(sha256('emberwatch|' || source_id || '|' || chk || '|' || "key"), 1, 32) as fingerprint, source_id as target, chk as "check", title,
      case when severity = 'odd' then 'medium' else severity end as severity, fix as remediation,
      '{{"actor":"' || actor || '","count":' || count || ',"detail":"' || detail || '"' || case when evidence = '' then '' else ',"evidence":["' || evidence || '"]' end
        || ',"first_seen":"' || {stamp.format('first_us')} || '","last_seen":"' || {stamp.format('last_us')} || '"'
        || case when target = '' then '' else ',"target":"' || target || '"' end || '}}' as evidence, first_us, last_us, seq, pos from {src}"""


_B32 = "substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + cast(({0} // pow(32, i)::hugeint) % 32 as int), 1)"


def _sortable(us: str, seed: str) -> str:
    def part(number: str, width: int) -> str:
        return f"array_to_string(list_transform(range({width - 1}, -1, -1), lambda i: {_B32.format(number)}), '')"
    half = lambda at: f"cast('0x' || substr(sha256({seed}), {at}, 10) as bigint)::hugeint"
    return f"{part(f'({us} // 1000)::hugeint', 10)} || {part(half(1), 8)} || {part(half(11), 8)}"


TABLE = f"{REC}, tbl as ({_upsert('rec')})"
_REC_OUT = """select source_id, "key", chk as "check", severity, actor, target, title, detail, evidence, fix, count, first_us, last_us"""
EXPECTED["upsert_detections"] = f"with {TABLE} {_REC_OUT} from tbl"
EXPECTED["prune_detections"] = f"with {TABLE} {_REC_OUT} from tbl where last_us >= {NOW_US - 4 * DAY}"
EXPECTED["fingerprint"] = f"""with {REC} select seq, substr(sha256('emberwatch|' || source_id || '|' || chk || '|' || "key"), 1, 32) as fp, {_sortable('last_us', '"key"')} as id from rec"""
EXPECTED["severity_rank"] = f"""with {REC} select severity, count(*) as n, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else -1 end as rank,
  case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as alert_rank, severity <> 'odd' as valid,
  case severity when 'critical' then 130 when 'high' then 131 when 'medium' then 132 when 'low' then 133 else 134 end as priority from rec group by severity"""
EXPECTED["detection_finding"] = f"""with {REC} select fingerprint, target, "check", title, severity, remediation, evidence, seq from ({_finding('rec')})"""
EXPECTED["parse_rate"] = f"with {EV} select source_id, count(*) as lines, round(avg((k >= 35)::int), 6) as parse_rate from ev group by 1"
_SRC = """src as (select source_id as name, case right(source_id, 1) when '0' then 'file' when '1' then 'syslog' when '2' then 'journald' else 'docker' end as type,
    min(us) as created_at from ev where source_id <> 'src4' group by 1)"""
EXPECTED["source_list"] = f"""with {EV}, {_SRC} select name, type, '/logs/' || name as path, created_at,
  round(coalesce((select avg((k >= 35)::int) from ev where source_id = name and name <> 'src1'), 1.0), 6) as parse_rate from src"""

# First-half state with mixed statuses; blank titles are never stored.
STATE = f"""{REC}, old as (select * from rec where last_us < {SPLIT_US}), new as (select * from rec where last_us >= {SPLIT_US}),
  of_ as (select * from ({_finding('old')}) where title <> ''),
  s0 as (select fingerprint, arg_min(target, pos) as target, arg_min("check", pos) as "check", arg_max(title, pos) as title, arg_max(severity, pos) as severity,
      arg_max(remediation, pos) as remediation, arg_max(evidence, pos) as evidence, arg_min({_sortable('last_us', 'fingerprint')}, pos) as id,
      arg_min(first_us, pos) as first_seen, max(last_us) as last_seen from of_ group by 1),
  st as (select 'emberwatch' as module, *, case when last_seen % 10 < 2 then 'resolved' when last_seen % 10 = 2 then 'suppressed' when last_seen % 10 = 3 then 'acknowledged' else 'open' end as status,
      null::varchar as group_id, case when last_seen % 10 < 2 then last_seen end as resolved_at, case when last_seen % 10 = 4 then 1 else 0 end as absent_streak from s0)"""
_ST = """module, target, "check", fingerprint, title, severity, remediation, evidence, id, status, group_id, first_seen, last_seen, resolved_at, absent_streak"""
EXPECTED["finding_write"] = f"""with {STATE}, nf as (select * from ({_finding('new')}) where title <> ''),
  n as (select fingerprint, arg_min(target, pos) as target, arg_min("check", pos) as "check", arg_max(title, pos) as title, arg_max(severity, pos) as severity,
      arg_max(remediation, pos) as remediation, arg_max(evidence, pos) as evidence, arg_min({_sortable('last_us', 'fingerprint')}, pos) as id,
      arg_min(first_us, pos) as first_seen, max(last_us) as last_seen from nf group by 1)
  select 'emberwatch' as module, coalesce(st.target, n.target) as target, coalesce(st."check", n."check") as "check", fingerprint, coalesce(n.title, st.title) as title,
    coalesce(n.severity, st.severity) as severity, coalesce(n.remediation, st.remediation) as remediation, coalesce(n.evidence, st.evidence) as evidence,
    coalesce(st.id, n.id) as id, case when n.title is not null then 'open' else st.status end as status, null::varchar as group_id,
    coalesce(st.first_seen, n.first_seen) as first_seen, coalesce(n.last_seen, st.last_seen) as last_seen,
    case when n.title is null then st.resolved_at end as resolved_at, case when n.title is null then st.absent_streak else 0 end as absent_streak
  from st full join n using (fingerprint)"""
_RECON = f"""with {STATE}, nt as ({_upsert('new')}), fresh as (select * from ({_finding('nt')}) where target <> 'src2'),
  good as (select * from fresh where title <> ''),
  pairs as (select st.*, st.fingerprint is not null as had, g.fingerprint as gfp, g.target as gt, g."check" as gc, g.title as gtitle, g.severity as gsev, g.remediation as grem, g.evidence as gev,
      coalesce(st.fingerprint, g.fingerprint) as fp, coalesce(st.target, g.target) as tgt from st full join good g on g.fingerprint = st.fingerprint),
  done as (select *, case when tgt = 'src2' then 'untouched' when not had or had is null then 'new' when gfp is not null and status = 'resolved' then 'reopened' when gfp is not null then 'refreshed'
      when status in ('resolved', 'suppressed') then 'untouched' when absent_streak + 1 >= 2 then 'resolved' else 'absent' end as what from pairs),
  after_ as (select what, 'emberwatch' as module, tgt as target, coalesce("check", gc) as "check", fp as fingerprint, coalesce(gtitle, title) as title, coalesce(gsev, severity) as severity,
      coalesce(grem, remediation) as remediation, coalesce(gev, evidence) as evidence, coalesce(id, {_sortable(str(NOW_US), 'fp')}) as id,
      case when what in ('new', 'reopened') then 'open' when what = 'resolved' then 'resolved' else status end as status, null::varchar as group_id,
      coalesce(first_seen, {NOW_US}) as first_seen, case when what in ('new', 'reopened', 'refreshed') then {NOW_US} else last_seen end as last_seen,
      case when what = 'resolved' then {NOW_US} when what = 'reopened' then null else resolved_at end as resolved_at,
      case when what in ('new', 'reopened', 'refreshed') then 0 when what in ('resolved', 'absent') then absent_streak + 1 else absent_streak end as absent_streak from done)"""
EXPECTED["reconcile_state"] = f"{_RECON} select {_ST} from after_"
EXPECTED["reconcile_newly_open"] = f"{_RECON} select {_ST} from after_ where what in ('new', 'reopened')"
EXPECTED["reconcile_resolved"] = f"{_RECON} select {_ST} from after_ where what = 'resolved'"
EXPECTED["reconcile_rejected"] = f"""{_RECON} select fingerprint, target, "check", title, severity, remediation, evidence, 'title' as reject_field, 'empty' as reject_reason from fresh where title = ''"""
EXPECTED["evidence_cap"] = """with d as (select doc_id, '{"t":"' || repeat(source, n_chars) || '"}' as j from documents),
  c as (select doc_id, case when strlen(j) > 65536 then '{"_note":"evidence exceeded MaxEvidenceBytes and was dropped","_original_bytes":' || strlen(j) || ',"_truncated":true}' else j end as j from d)
  select doc_id, strlen(j) as bytes, md5(j) as digest from c"""
EXPECTED["active_findings"] = f"""with {TABLE}, {_SRC}, live as (select * from tbl where last_us >= {NOW_US - 2 * DAY} and source_id in (select name from src)),
  low as (select source_id, avg((k >= 35)::int) as rate from ev where k + 20 < 80 group by 1)
  select fingerprint, target, "check", title, severity, remediation from ({_finding('live')})
  union all select substr(sha256('emberwatch|' || source_id || '|ingest.parse_rate|'), 1, 32), source_id, 'ingest.parse_rate', 'Low parse rate on source ' || source_id, 'low',
    'Many lines from this source aren''t being parsed — check the source type and format. Unparsed lines are stored but not analysed.'
  from low where rate < 0.5 and source_id in (select name from src)"""
_CHANGES = f"""chg as (select fingerprint, seq, case seq % 4 when 0 then 'acknowledged' when 1 then 'suppressed' when 2 then 'open' else 'resolved' end as status from ({_finding('new')}))"""
EXPECTED["set_status"] = f"""with {STATE}, {_CHANGES}, w as (select fingerprint as wf, arg_max(status, seq) as to_ from chg where status <> 'resolved' group by 1)
  select {_ST.replace('status', 'coalesce(to_, status) as status')} from st left join w on wf = fingerprint"""
EXPECTED["set_status_refused"] = f"""with {STATE}, {_CHANGES} select fingerprint, status, seq, case when status = 'resolved' then 'status must be acknowledged, suppressed, or open' else 'finding not found' end as reason
  from chg where status = 'resolved' or fingerprint not in (select fingerprint from st)"""
EXPECTED["prune_resolved"] = f"""with {STATE}, x as (select *, coalesce(status = 'resolved' and resolved_at < {NOW_US - 20 * DAY}, false) as gone from st)
  select status, count(*) as n from x where not gone group by 1 union all select '(pruned)', count(*) from x where gone"""
EXPECTED["delete_source_cascade"] = f"""with {TABLE}, {_SRC} select 'source' as what, name, count(*) as n from src where type not in ('file', 'journald') group by 2
  union all select 'detection', source_id, count(*) from tbl where source_id not in ('src0', 'src2') group by 2"""
EXPECTED["diff_findings"] = f"""with {REC}, old as (select * from rec where last_us < {SPLIT_US}), new as (select * from rec where last_us >= {SPLIT_US}),
  ot as ({_upsert('old')}), nt as ({_upsert('new')}), a as ({_finding('ot')}), b as ({_finding('nt')}),
  j as (select a.fingerprint as af, b.fingerprint as bf, coalesce(b.target, a.target) as target, coalesce(a.fingerprint, b.fingerprint) as fingerprint, coalesce(b."check", a."check") as "check",
      coalesce(b.title, a.title) as title, coalesce(b.severity, a.severity) as severity, coalesce(b.remediation, a.remediation) as remediation, coalesce(b.evidence, a.evidence) as evidence,
      array_to_string(list_filter([case when a.title <> b.title then 'title' end, case when a.severity <> b.severity then 'severity' end,
        case when a.remediation <> b.remediation then 'remediation' end, case when a.evidence <> b.evidence then 'evidence' end], lambda x: x is not null), ',') as d
      from a full join b on a.fingerprint = b.fingerprint)
  select case when af is null then 'added' when bf is null then 'removed' else 'changed' end as kind, target, fingerprint, "check", title, severity, remediation, evidence,
    case when af is null or bf is null then '' else d end as detail from j where af is null or bf is null or d <> ''"""
_REQ = """req as (select page_id as seq, page_id as n, case when page_id % 11 = 0 then '' else 'p' || (page_id % 50) end as name,
    ['syslog', 'file', 'journald', 'docker', 'windows', 'ftp'][page_id % 6 + 1] as type, ['udp', 'path', 'unit', 'container', 'tcp'][page_id % 5 + 1] as pk,
    case when page_id % 7 = 0 then '' else url end as pv from pages)"""
_ERR = """case when name = '' then 'the name is empty'
    when type in ('syslog', 'windows') and not (pk in ('udp', 'tcp') and pv <> '') then type || ': give an address to listen on as udp or tcp'
    when type = 'file' and not (pk = 'path' and pv <> '') then 'file: give its path'
    when type = 'docker' and not (pk = 'container' and pv <> '') then 'docker: give the container'
    when type = 'ftp' then 'no such type: ftp' end"""
EXPECTED["validate_sources"] = f"with {_REQ} select seq, name, type, {_ERR} as error from req"
EXPECTED["put_sources"] = f"""with {EV}, {_SRC}, {_REQ}, named as (select * replace (case when n % 13 = 0 then 'src' || (n % 4) else name end as name) from req),
  chk as (select *, {_ERR} as error from named), good as (select name, arg_max(type, seq) as type, arg_max(pv, seq) as pv, min(seq) as first_ from chk where error is null group by 1),
  fresh as (select *, row_number() over (order by first_) as r from good where name not in (select name from src)),
  lim as (select *, r + (select count(*) from src) > 20 as over_ from fresh)
  select name, type, pv as value, {NOW_US} as created_at, 'kept' as what from lim where not over_
  union all select src.name, coalesce(good.type, src.type), coalesce(good.pv, '/logs/' || src.name), created_at, 'kept' from src left join good using (name)
  union all select name, type, '1', null, 'no room for another source' from lim where over_
  union all select name, type, cast(count(*) as varchar), null, error from chk where error is not null group by name, type, error"""

# --- alerts --------------------------------------------------------------------------------------

ALERTS = f"""{REC}, al as (select *, case when seq % 5 = 0 then 'resolved' else 'opened' end as kind, case when seq % 3 = 0 then 'trap' else 'emberwatch' end as module,
    last_us // 3600000000 as batch, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as rank from ({_finding('rec')})),
  dd as (select * from al qualify row_number() over (partition by batch, kind, module, fingerprint order by seq) = 1)"""


def _digest(opened: str, resolved: str) -> str:
    return f"""select module, batch, max(last_us) as "at", list({opened} order by -rank, seq) filter (kind = 'opened') as o,
      list({resolved} order by seq) filter (kind = 'resolved') as r from dd group by 1, 2"""


EXPECTED["alert_filter"] = f"with {ALERTS} select kind, severity, count(*) as n from al where kind = 'resolved' or rank >= 3 group by 1, 2"
_ITEM = "severity || ':' || title"
EXPECTED["digest"] = f"""with {ALERTS}, d as ({_digest(_ITEM, _ITEM)}) select module, batch, "at", coalesce(array_to_string(o, '|'), '') as opened, coalesce(array_to_string(r, '|'), '') as resolved from d"""
_BADGE = "case severity when 'critical' then '🟥 CRITICAL' when 'high' then '🟧 HIGH' when 'medium' then '🟨 MEDIUM' else '🟦 LOW' end"
_OPEN_TEXT = f"chr(10) || {_BADGE} || ' ' || target || chr(10) || '  ' || title || chr(10) || '  → ' || remediation || chr(10)"
_DONE_TEXT = "'  • ' || target || ' — ' || title || chr(10)"
EXPECTED["digest_text"] = f"""with {ALERTS}, d as ({_digest(_OPEN_TEXT, _DONE_TEXT)})
  select module, batch, rtrim(case when o is null then '' else case module when 'trap' then 'Trap' else module end || ' — ' || len(o) || ' new finding(s)' || chr(10) || array_to_string(o, '') end
    || case when r is null then '' else case when o is null then '' else chr(10) end || '✅ ' || len(r) || ' finding(s) resolved' || chr(10) || array_to_string(r, '') end, chr(10)) as text from d"""
EXPECTED["chat_json"] = EXPECTED["digest_text"]
_WIRE = "target || '/' || \"check\" || '/' || title"
EXPECTED["webhook_json"] = f"""with {ALERTS}, d as ({_digest(_WIRE, _WIRE)}) select module, batch, 1 as version, strftime(make_timestamp("at"), '%Y-%m-%dT%H:%M:%SZ') as "at",
  array_to_string(o, '|') as opened, array_to_string(r, '|') as resolved from d"""
_LINE = f"""{ALERTS}, ln as (select *, case when kind = 'resolved' then 133 when severity = 'critical' then 130 when severity = 'high' then 131 when severity = 'medium' then 132 else 133 end as pri,
    make_timestamp(last_us) as t, json_extract_string(evidence, '$.actor') as src from al)"""
EXPECTED["alert_lines"] = f"""with {_LINE} select seq, '<' || pri || '>' || strftime(t, '%b ') || lpad(cast(day(t) as varchar), 2, ' ') || strftime(t, ' %H:%M:%S') || ' collector ' || module || '[7]: '
  || case when kind = 'resolved' then 'RESOLVED: ' else '' end || title || ' | product=' || module || ' severity=' || severity || ' check=' || "check" || ' target=' || target
  || ' status=' || case when kind = 'resolved' then 'resolved' else 'open' end || ' src=' || src as value from ln"""
EXPECTED["alert_lines_reparsed"] = f"""with {_LINE}
  select seq, epoch_us(date_trunc('second', t)) as us, 'collector' as host, module as app, pri % 8 as severity, src as src_ip, module as product, severity as level,
    case when kind = 'resolved' then 'resolved' else 'open' end as status from ln"""
EXPECTED["sanitize_documents"] = """with d as (select doc_id, translate(text, chr(10) || chr(13), '  ') as t from documents),
  s as (select doc_id, case when strlen(t) > 1600 then left(t, (select max(i) from generate_series(400, 1600) g(i) where strlen(left(t, i)) <= 1600)) || '…' else t end as t from d) select doc_id, strlen(t) as bytes, md5(t) as digest from s"""

# --- read side and ownership ---------------------------------------------------------------------

EXPECTED["open_counts"] = f"with {STATE} select severity, count(*) as n from st where status = 'open' group by 1"
EXPECTED["summary"] = f"""with {STATE}, {_SRC}, c as (select severity, count(*) as n from st where status = 'open' group by 1)
  select 'Emberwatch' as product, (select string_agg(severity || '=' || n, ',' order by severity) from c) as counts, (select cast(coalesce(sum(n), 0) as bigint) from c) as open_total, (select count(*) from src) as targets"""
EXPECTED["findings_view"] = f"""with {STATE} select fingerprint, target, "check", title, severity, status, remediation, evidence, first_seen, last_seen from st
  where status <> 'suppressed' and not (status = 'resolved' and (resolved_at is null or {SPLIT_US + 3_600_000_000} - resolved_at > {DAY}))"""
EXPECTED["findings_list"] = EXPECTED["findings_view"].replace("status <> 'suppressed' and ", "")
EXPECTED["findings_of_target"] = f"with {STATE} select target, fingerprint, title, status from st where target = 'src1'"
EXPECTED["detections_of_source"] = f"with {TABLE} {_REC_OUT} from tbl where source_id = 'src1'"
EXPECTED["incidents_view"] = f"""with {TABLE}, {_SRC} select "key", source_id as source, chk as "check", severity, actor, target, title, detail, evidence, count,
  strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%SZ') as first_at, strftime(make_timestamp(last_us), '%Y-%m-%dT%H:%M:%SZ') as last_at, false as incident
  from tbl where last_us >= {NOW_US - 3 * DAY} and source_id in (select name from src)"""
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
EXPECTED["normalize_domain"] = f"select page_id, {_HOST} as domain, {_HOST} as ported, {_HOST} as dotted from pages"
EXPECTED["verify_challenges"] = f"""with p as (select *, {_HOST} as domain from pages), c as (select domain, min(page_id) as t from p group by 1),
  m as (select domain, cast(t as varchar) as token, 'pending' as state, case when exists (select 1 from p where p.domain = c.domain and p.page_id = c.t and t % 2 = 0) then 'dns'
    when exists (select 1 from p where p.domain = c.domain and p.page_id = c.t and t % 3 = 0) then 'http' else '' end as method from c)
  select domain, token, state, method <> '' as verified, method from m"""
EXPECTED["pending_challenges"] = f"select domain, token, 'pending' as state from ({EXPECTED['verify_challenges']}) where not verified"
