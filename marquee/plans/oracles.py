"""SQL equivalents of the registered queries, for a second engine to check them by."""

from __future__ import annotations

from marquee import config

ORACLES: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


WS = r"[\p{Z}\s\x1c-\x1f\x{85}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def ends(x: str) -> str:
    return rf"regexp_replace({x}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g')"


def norm(x: str, suffix: bool = True) -> str:
    base = f"regexp_replace({squeeze(f'lower({x})')}, '^the ', '')"
    if suffix:
        base = rf"regexp_replace({base}, ' *(?:live|concert|tour|show|presents?|featuring|feat\.?|ft\.?) *$', '')"
    return rf"trim(regexp_replace(regexp_replace({base}, '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' +', ' ', 'g'))"


def words(n: str) -> str:
    return f"list_filter(list_distinct(string_split({n}, ' ')), lambda w: w <> '')"


def match(na: str, wa: str, nb: str, wb: str) -> str:
    common = f"len(list_intersect({wa}, {wb}))"
    return (f"(contains({na}, {nb}) OR contains({nb}, {na}) OR (len({wa}) > 0 AND len({wb}) > 0 AND "
            f"CAST({common} AS DOUBLE) / CAST(len({wa}) + len({wb}) - {common} AS DOUBLE) > 0.6))")


def score() -> str:
    return ("(CASE WHEN length(coalesce(time,'')) > 0 THEN 2 ELSE 0 END + CASE WHEN length(coalesce(url,'')) > 0 THEN 1 ELSE 0 END"
            " + CASE WHEN length(artist) > 20 THEN 1 ELSE 0 END"
            " + CASE WHEN contains(source,'Ticketmaster') OR contains(source,'Venue:') THEN 1 ELSE 0 END)")


def fold(listing: str, where: str = "true") -> str:
    m = match("e.n", "e.w", "x[1].n", "x[1].w")
    at = f"coalesce(list_position(list_transform(acc, lambda e: {m}), true), 0)"
    return f"""WITH l AS ({listing}), k AS (SELECT *, {norm('venue')} AS vn, {norm('artist')} AS n, {score()} AS s FROM l WHERE {where}),
    kw AS (SELECT *, {words('n')} AS w FROM k),
    b AS (SELECT date, vn, list([{{'n': n, 'w': w, 's': s, 'p': pos}}] ORDER BY origin, pos) AS items FROM kw GROUP BY date, vn),
    f AS (SELECT unnest(list_reduce(items, lambda acc, x: CASE WHEN {at} = 0 THEN list_concat(acc, x)
       WHEN x[1].s > acc[{at}].s THEN list_concat(list_concat(acc[1:{at} - 1], x), acc[{at} + 1:]) ELSE acc END)).p AS p FROM b)
    SELECT l.date, l.venue, md5(l.artist) AS artist_md5, l.time, l.url, l.source, l.pos FROM l JOIN f ON l.pos = f.p"""


BASE = "DATE '2026-02-15'"


def plus(n: str) -> str:
    return f"({BASE} + CAST({n} AS INTEGER))"


def pick(values: list[str], n: str) -> str:
    return f"{lst(values)}[CAST(({n}) % {len(values)} AS INTEGER) + 1]"


DOCS = f"""SELECT text AS artist, lang AS venue, {plus('n_chars % 8')} AS date, CASE WHEN n_chars % 3 = 0 THEN '7 PM' END AS time,
 CASE WHEN doc_id % 2 = 0 THEN 'Venue: ' || source ELSE source END AS source, CASE WHEN n_chars % 5 = 0 THEN 'http://x/' || doc_id END AS url,
 source AS origin, doc_id AS pos FROM documents"""


def parts(venue: str, spread: int) -> str:
    return f"""SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || lower(p_type) WHEN p_partkey % 7 = 0 THEN 'The ' || p_name || ' Live' ELSE p_name END AS artist,
 {venue} AS venue, {plus(f'p_size % {spread}')} AS date, CASE WHEN p_partkey % 2 = 0 THEN '8 PM' END AS time,
 CASE WHEN p_partkey % 11 = 0 THEN 'Ticketmaster' ELSE 'Sheet' END AS source, CASE WHEN p_partkey % 5 = 0 THEN 'http://x/' || p_partkey END AS url,
 'part' AS origin, p_partkey AS pos FROM part"""


ORACLES["listing_dedup"] = fold(DOCS, f"date BETWEEN {BASE} AND {plus('7')}")
ORACLES["dedup_parts"] = fold(parts("p_brand", 8))
ORACLES["windowed_dedup"] = fold(parts("p_brand", 12), f"date BETWEEN {BASE} AND {plus('7')}")
ORACLES["dedup_crowded"] = fold(parts("p_type", 1))


def amatch(a: str, b: str) -> str:
    na, nb = norm(a), norm(b)
    return match(na, words(na), nb, words(nb))


ORACLES["artist_match"] = f"""SELECT p_partkey, {amatch('p_name', "'The ' || p_name || ' Tour'")} AS same,
 {amatch('p_name', "p_type || ' ' || p_brand")} AS other,
 {amatch("p_name || ' ' || p_type || ' ' || p_brand", "p_brand || ' ' || p_type || ' ' || split_part(p_name, ' ', 1)")} AS words FROM part"""
ORACLES["detail_score"] = f"SELECT pos, {score()} AS score FROM ({DOCS})"
ORACLES["text_normalize"] = f"""SELECT doc_id, md5({norm('text', False)}) AS identity_md5, md5({norm('text')}) AS match_md5,
 CAST(len({words(norm('text'))}) AS INTEGER) AS n_words FROM documents"""


def key(artist: str, venue: str, day: str) -> str:
    return f"{norm(artist, False)} || '|' || {norm(venue, False)} || '|' || strftime({day}, '%Y-%m-%d')"


ORACLES["identity_key"] = f"SELECT p_partkey, {key(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + '!' + chr(39), 'p_brand', plus('p_size'))} AS key FROM part"

_SAME = "strptime(nullif(strftime(o_orderdate, '2026-%m-%d'), '2026-02-29'), '%Y-%m-%d')::DATE"
_DATED = f"CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate::DATE ELSE {_SAME} END"


def date_oracle(yearless: list[int], none: list[int], as_written: list[int]) -> str:
    def ins(v: list[int]) -> str:
        return "(" + ", ".join(map(str, v)) + ")"
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 17 IN {ins(none)} THEN NULL WHEN o_orderkey % 17 IN {ins(as_written)} THEN o_orderdate::DATE
 WHEN o_orderkey % 17 IN {ins(yearless)} THEN {_SAME} ELSE {_DATED} END AS parsed FROM orders"""


ORACLES["date_parse"] = date_oracle([2, 9, 11, 12, 13], [14], [16])
ORACLES["sheet_date_parse"] = date_oracle([2, 11, 12], [7, 8, 9, 13, 14, 16], [99])
CLOCK = "replace(ltrim(strftime(ts, '%I:%M %p'), '0'), ':00 ', ' ')"
ORACLES["iso_parse"] = f"""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN ts::DATE END AS day,
 CASE WHEN event_id % 5 = 2 THEN '12 AM' WHEN event_id % 5 < 4 THEN {CLOCK} END AS time FROM events"""
HEADING = "upper(strftime({0}, '%A, %B ') || day({0}))"
ORACLES["time_display"] = f"SELECT event_id, {CLOCK} AS clock, {CLOCK} AS clock_text, {HEADING.format('ts')} AS heading FROM events"
_STAMP = "strftime({0}, '%B ') || day({0}) || strftime({0}, ', %Y at ') || ltrim(strftime({0}, '%I:%M %p'), '0')"
_DST = "((ts >= TIMESTAMP '2024-03-10 08:00:00' AND ts < TIMESTAMP '2024-11-03 07:00:00') OR (ts >= TIMESTAMP '2025-03-09 08:00:00' AND ts < TIMESTAMP '2025-11-02 07:00:00'))"
ORACLES["utc_to_local"] = f"""SELECT event_id, {_STAMP.format('loc')} || CASE WHEN dst THEN ' CDT' ELSE ' CST' END AS page_stamp, {_STAMP.format('ts')} || ' CT' AS build_stamp
 FROM (SELECT *, CASE WHEN dst THEN ts - INTERVAL 5 HOUR ELSE ts - INTERVAL 6 HOUR END AS loc FROM (SELECT *, {_DST} AS dst FROM
 (SELECT event_id, ts + to_days(CAST(event_id % 600 AS INTEGER)) AS ts FROM events)))"""
ORACLES["split_day_time"] = """SELECT event_id, strptime(strftime(ts, '2026-%m-%d'), '%Y-%m-%d')::DATE AS day,
 CASE WHEN event_id % 3 <> 0 THEN ltrim(strftime(ts, '%I:%M %p'), '0') || ' - late' END AS time FROM events"""
ORACLES["window_filter"] = "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-10-01' AND DATE '1998-10-08'"
ORACLES["radius_filter"] = f"""SELECT c_custkey, round(m, 3) AS miles FROM (SELECT c_custkey, 2 * 3958.7613 * asin(sqrt(least(1.0,
 pow(sin(radians(lat - {config.CENTER_LAT}) / 2), 2) + cos(radians({config.CENTER_LAT})) * cos(radians(lat)) * pow(sin(radians(lon - ({config.CENTER_LON})) / 2), 2)))) AS m
 FROM (SELECT c_custkey, {config.CENTER_LAT}::DOUBLE + ((c_custkey * 37) % 2001 - 1000) / 1000.0::DOUBLE AS lat,
 {config.CENTER_LON}::DOUBLE + ((c_custkey * 53) % 2003 - 1000) / 1000.0::DOUBLE AS lon FROM customer)) WHERE m <= {config.RADIUS_MILES}"""

ALIAS_ROWS = ", ".join(f"({r}, {q(a)}, {q(c)})" for r, a, c in config.venue_aliases())
ALIASES = [a for _, a, _ in config.venue_aliases()]


def venue_join(src: str, key_col: str, name_col: str) -> str:
    """(key, exact, contained, venue) of every row of ``src``."""
    return f"""SELECT s.{key_col}, x.canonical AS exact, c.canonical AS contained, coalesce(x.canonical, c.canonical, {ends('s.' + name_col)}) AS venue
 FROM ({src}) s LEFT JOIN (VALUES {ALIAS_ROWS}) x(r, alias, canonical) ON {ends(f'lower(s.{name_col})')} = x.alias
 LEFT JOIN (SELECT nm, arg_min(canonical, r) AS canonical FROM (SELECT DISTINCT {ends(f'lower({name_col})')} AS nm FROM ({src})) n
  JOIN (VALUES {ALIAS_ROWS}) v(r, alias, canonical) ON contains(nm, alias) OR contains(alias, nm) GROUP BY nm) c ON {ends(f'lower(s.{name_col})')} = c.nm"""


_ALIAS = pick(ALIASES, "o_orderkey // 5")
NAMES = f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN upper({_ALIAS}) WHEN 1 THEN '  ' || {_ALIAS} || ' ' WHEN 2 THEN {_ALIAS} || ' (main room)'
 WHEN 3 THEN split_part({_ALIAS}, ' ', 1) ELSE ' ' || o_orderpriority END AS name FROM orders"""
ORACLES["venue_resolve"] = venue_join(NAMES, "o_orderkey", "name")
ORACLES["venue_table"] = """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'hall nation_' || c_nationkey ELSE c_name END AS name FROM customer),
 a AS (SELECT n_nationkey AS r, lower(n_name) AS alias, 'N' || n_nationkey AS canonical FROM nation)
 SELECT c.c_custkey, coalesce((SELECT canonical FROM a WHERE alias = lower(c.name)), (SELECT arg_min(canonical, r) FROM a WHERE contains(lower(c.name), alias) OR contains(alias, lower(c.name))), c.name) AS venue FROM c"""


def any_of(t: str, values: list[str]) -> str:
    return f"(len(list_filter({lst(values)}, lambda k: contains({t}, k))) > 0)"


def music(title: str, cat: str = "''", desc: str = "''") -> str:
    t = f"lower({title} || ' ' || {cat} || ' ' || {desc})"
    inc, exc = any_of(t, config.INCLUDE_KEYWORDS), any_of(t, config.EXCLUDE_KEYWORDS)
    return f"({inc} OR (NOT {exc} AND ({any_of(f'lower({cat})', config.CATEGORY_KEYWORDS)} OR {any_of(t, ALIASES)})))"


_TITLE = f"(p_name || ' ' || {pick(config.EXCLUDE_KEYWORDS + [''] * 20, 'p_partkey')} || ' ' || {pick(config.INCLUDE_KEYWORDS + [''] * 60, 'p_partkey // 3')})"
ORACLES["rule_classify"] = f"""SELECT p_partkey, {music('title', 'cat', 'descr')} AS music FROM (SELECT p_partkey, {_TITLE} AS title,
 {pick(['music', '', 'Concerts', 'arts'], 'p_partkey // 7')} AS cat, {pick(['', 'at the shell', 'b-side', 'x'], 'p_partkey // 11')} AS descr FROM part)"""
ORACLES["rule_classify_documents"] = f"SELECT doc_id, {music('text', q('music'))} AS with_category, {music('text')} AS plain FROM documents"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def display() -> str:
    return "artist || ' — ' || venue || CASE WHEN coalesce(time, '') <> '' THEN ' (' || time || ')' ELSE '' END"


def page_line() -> str:
    body = (f"'<span class=\"artist\">' || {esc('artist')} || '</span> — <span class=\"venue\">' || {esc('venue')} || '</span>' || "
            f"CASE WHEN coalesce(time, '') <> '' THEN ' <span class=\"time\">(' || {esc('time')} || ')</span>' ELSE '' END")
    return (f"CASE WHEN coalesce(url, '') <> '' THEN '<li><a href=\"' || {esc('url')} || '\" target=\"_blank\" rel=\"noopener\">' || {body} || '</a></li>' "
            f"ELSE '<li>' || {body} || '</li>' END")


CONV = f"""SELECT conv_id, turn, text AS artist, 'A&B "' || role || '" <x>' AS venue, CASE WHEN (conv_id + turn) % 2 = 0 THEN '7 PM' WHEN (conv_id + turn) % 3 = 0 THEN '' END AS time,
 CASE WHEN (conv_id + turn) % 4 = 0 THEN 'http://x/?a=1&b=' || conv_id END AS url, {plus('(conv_id + turn) % 8')} AS date FROM conversations"""
ORACLES["listing_lines"] = f"SELECT conv_id, turn, md5({display()}) AS plain_md5, md5({page_line()}) AS page_md5, md5({esc('artist')}) AS escaped_md5 FROM ({CONV})"
RSS = (f"'<item><title>' || {esc(display())} || '</title><description>' || {esc(chr(39) + chr(39) + ' || strftime(date, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') || ' + chr(39) + ' ' + chr(39) + ' || venue')} || '</description>' || "
       f"CASE WHEN coalesce(url, '') <> '' THEN '<link>' || {esc('url')} || '</link>' ELSE '' END || '</item>'")
ORACLES["rss_items"] = f"SELECT conv_id, turn, md5({RSS}) AS item_md5 FROM ({CONV})"
ORACLES["url_clean"] = """SELECT page_id, split_part(url, '?', 1) AS clean, CASE WHEN starts_with(rel, 'http') THEN rel WHEN rel <> '' THEN 'https://base.example' || rel END AS prefixed,
 CASE WHEN starts_with(rel, 'http') THEN rel END AS absolute_only
 FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://[^/]*', '') END AS rel FROM pages)"""

# --- audit -----------------------------------------------------------------------------------------------------
AUDIT = """SELECT s.source_name, s.source_rank, s.success, coalesce(found, 0) AS events_found, coalesce(kept, 0) AS events_after_filter, coalesce(filt, 0) AS events_filtered,
 coalesce(s.error, CASE WHEN s.success AND coalesce(found, 0) = 0 THEN s.msg END) AS error
 FROM (VALUES ('view', 0, true, NULL, NULL), ('click', 1, true, NULL, NULL), ('purchase', 2, true, NULL, NULL), ('signup', 3, true, NULL, NULL),
  ('error', 4, false, 'Request failed: https://x.example/a?b=1 HTTPSConnectionPool(host=''x'')', NULL), ('absent', 5, true, NULL, 'no rows'), ('down', 6, false, NULL, NULL)) s(source_name, source_rank, success, error, msg)
 LEFT JOIN (SELECT event_type, count(*) AS found, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside AND value > 20) AS filt
  FROM (SELECT *, ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-17' AS inside FROM events) GROUP BY event_type) e ON s.source_name = e.event_type"""
ORACLES["source_audit"] = AUDIT
_ICON = "CASE WHEN NOT success THEN '❌' WHEN events_found = 0 THEN '⚠️' ELSE '✅' END"
ORACLES["source_status_lines"] = f"""SELECT source_rank, {_ICON} AS icon,
 CASE WHEN success THEN {_ICON} || ' ' || source_name || ': ' || events_found || ' event(s) found' || CASE WHEN events_filtered > 0 THEN ' (' || events_filtered || ' filtered as non-music)' ELSE '' END
 ELSE {_ICON} || ' ' || source_name || ': ERROR — ' || coalesce(error, 'None') END AS line,
 {_ICON} || ' ' || source_name || CASE WHEN NOT success THEN ': unavailable' WHEN events_found = 0 THEN ': no events this week' ELSE ': ' || events_found || ' event(s)' END AS public_line,
 substring(regexp_replace(regexp_replace(coalesce(error, 'unavailable'), 'https?://[^ ]+', '[url]', 'g'), 'HTTPSConnectionPool.*', 'connection failed', 'g'), 1, 80) AS public_error FROM ({AUDIT})"""
ORACLES["source_health"] = f"""SELECT source_rank, CASE WHEN NOT success THEN 'src-error' WHEN events_after_filter = 0 THEN 'src-warn' ELSE 'src-ok' END AS css_class, source_name,
 CASE WHEN success THEN events_after_filter::VARCHAR ELSE '—' END AS shown_count FROM ({AUDIT})"""
ORACLES["source_failures"] = f"SELECT source_rank, source_name, error FROM ({AUDIT}) WHERE NOT success"
ORACLES["source_rollup"] = f"""SELECT 'All sources' AS source_name, bool_or(success) AS success, sum(events_found)::BIGINT AS events_found, sum(events_after_filter)::BIGINT AS events_after_filter,
 sum(events_filtered)::BIGINT AS events_filtered, 'Some venues failed: ' || string_agg(source_name, ', ' ORDER BY source_rank) FILTER (WHERE NOT success) AS error FROM ({AUDIT})"""


def totals(deduped: str) -> str:
    return f"""SELECT *, total_deduped_events || ' events from ' || ok_sources || ' source' || CASE WHEN ok_sources = 1 THEN '' ELSE 's' END ||
 CASE WHEN error_sources > 0 THEN ' (' || error_sources || ' had errors)' ELSE '' END AS summary FROM (SELECT sum(events_after_filter)::BIGINT AS total_raw_events,
 count(*) FILTER (WHERE success AND events_after_filter > 0) AS ok_sources, count(*) FILTER (WHERE NOT success) AS error_sources,
 (SELECT count(*) FROM ({deduped})) AS total_deduped_events FROM ({AUDIT}))"""


ORACLES["run_totals"] = totals("SELECT DISTINCT user_id, event_type FROM events")
ORACLES["health_history"] = """SELECT source_name, run_ts, success, events_after_filter, lag(events_after_filter) OVER w AS previous,
 events_after_filter - lag(events_after_filter) OVER w AS change, coalesce(lag(success) OVER w <> success, false) AS state_changed
 FROM (SELECT event_type AS source_name, date_trunc('day', ts)::TIMESTAMP AS run_ts, count(*) AS events_after_filter, count(*) % 3 <> 0 AS success FROM events GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY source_name ORDER BY run_ts)"""
ORACLES["origin_status"] = """SELECT 2 AS source_rank, source AS origin, count(*) AS events_found, count(*) FILTER (WHERE n_chars % 3 <> 0) AS events_after_filter FROM documents GROUP BY source"""

# --- publishing ------------------------------------------------------------------------------------------------
ORACLES["by_day"] = f"SELECT ts::DATE AS date, {HEADING.format('ts::DATE')} AS heading, count(*) AS n FROM events GROUP BY 1, 2"
ORDERS = """SELECT 'Order ' || o_orderkey AS artist, o_orderpriority AS venue, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN '7 PM' END AS time,
 o_orderstatus AS source, CASE WHEN o_orderstatus = 'O' THEN 'http://x' END AS url, o_orderkey AS slot FROM orders"""
ORACLES["page_body"] = f"""SELECT {page_line()} AS line FROM ({ORDERS}) UNION ALL SELECT '<div class="day-section"><h2>' || {HEADING.format('date')} || '</h2><ul>' FROM (SELECT DISTINCT date FROM ({ORDERS}))
 UNION ALL SELECT '</ul></div>' FROM (SELECT DISTINCT date FROM ({ORDERS}))"""
ORACLES["page_document"] = f"""WITH t AS ({totals(ORDERS)}), h AS ({ORACLES["source_health"]})
 SELECT unnest(['<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8">', '<title>Orders &amp; more — Next 8 Days</title></head><body><header>', '<h1>ORDERS &amp; MORE</h1>',
 '<div class="updated">Updated January 10, 2024 at 6:00 AM CST</div>', '<div class="summary">' || total_deduped_events || ' shows over the next 8 days</div></header><main>',
 '</main><footer><div class="source-summary">' || summary || '</div>', '<details class="source-status"><summary>Source Details</summary><table class="source-table">',
 '<thead><tr><th></th><th>Source</th><th class="src-count">Events</th></tr></thead><tbody>', '</tbody></table></details>', 'Compiled daily<br>Last built January 10, 2024 at 6:00 AM CST', '</footer></body></html>']) AS line FROM t
 UNION ALL SELECT '<tr class="' || css_class || '"><td class="src-dot">&#x25CF;</td><td>' || source_name || '</td><td class="src-count">' || shown_count || '</td></tr>' FROM h
 UNION ALL {ORACLES["page_body"]}"""
ORACLES["text_summary"] = f"SELECT '  ' || {display()} AS line FROM ({ORDERS}) UNION ALL SELECT '━━━ ' || {HEADING.format('date')} || ' ━━━' FROM (SELECT DISTINCT date FROM ({ORDERS}))"
_FIRST = "CASE WHEN row_number() OVER (ORDER BY date, lower(venue), lower(artist), slot) = 1 THEN '' ELSE ',' END"
ORACLES["run_log"] = f"""WITH t AS ({totals(ORDERS)}), s AS (SELECT list({{'name': source_name, 'success': success, 'events_found': events_found, 'events_after_filter': events_after_filter,
 'events_filtered': events_filtered, 'error': error}} ORDER BY source_rank) AS ss FROM ({AUDIT})),
 h AS (SELECT to_json({{'run_timestamp': '2024-01-10T12:00:00', 'date_range': {{'start': '2024-01-10', 'end': '2024-01-17'}}, 'total_raw_events': total_raw_events,
 'total_deduped_events': total_deduped_events, 'sources': ss}})::VARCHAR AS j FROM t, s)
 SELECT left(j, length(j) - 1) || ',"events":[' AS line FROM h UNION ALL
 SELECT {_FIRST} || to_json({{'artist': artist, 'venue': venue, 'date': strftime(date, '%Y-%m-%d'), 'time': time, 'source': source}})::VARCHAR FROM ({ORDERS}) UNION ALL SELECT ']}}'"""
ORACLES["json_feed"] = f"""SELECT '{{"updated":"2026-02-15T05:58:42Z","date_range":{{"start":"2026-02-15","end":"2026-02-22"}},"events":[' AS line UNION ALL
 SELECT {_FIRST} || to_json({{'artist': artist, 'venue': venue, 'date': strftime(date, '%Y-%m-%d'), 'time': time, 'url': url, 'featured': false}})::VARCHAR FROM ({ORDERS}) UNION ALL SELECT ']}}'"""

# --- JSON ------------------------------------------------------------------------------------------------------
ORACLES["json_path"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.venue.name'), 'Unknown Venue') AS venue FROM events"
ORACLES["json_walk"] = """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, json(props)::VARCHAR AS p FROM events)
 SELECT event_id, u.n, u.value FROM (SELECT event_id, unnest([
 {'n': 0, 'value': '{"a":[' || p || ',' || event_id || '],"b":{"c":' || p || '}}'}, {'n': 1, 'value': '[' || p || ',' || event_id || ']'}, {'n': 2, 'value': p}, {'n': 3, 'value': k}, {'n': 4, 'value': event_id::VARCHAR},
 {'n': 5, 'value': '{"c":' || p || '}'}, {'n': 6, 'value': p}, {'n': 7, 'value': k}]) AS u FROM e)"""
_K = "(conv_id + turn)"
ORACLES["model_responses"] = f"""SELECT conv_id || '/' || turn AS origin, 0::BIGINT AS pos, md5({ends('text')}) AS artist_md5, 'Hi Tone' AS venue, {plus(_K + ' % 12')} AS date, '9 PM' AS time, 'Artifacts (' || role || ')' AS source,
 {_K} % 12 <= 7 AS kept FROM conversations WHERE {ends('text')} <> '' UNION ALL
 SELECT conv_id || '/' || turn, 2, md5(role), 'Venue TBA', DATE '2026-02-16', NULL, 'Artifacts (Vision-Extracted)', true FROM conversations"""

# --- sources ---------------------------------------------------------------------------------------------------
_T = "make_timestamp(o_orderkey * 61 * 1000000)"
_TIME = f"replace(ltrim(strftime({_T}, '%I:%M %p'), '0'), ':00 ', ' ')"
_SECOND_TITLE = pick(["", "Trivia Night", "Jazz Trivia", "Coldplay"], "o_orderkey")
ORACLES["api_ticketing"] = f"""SELECT o_orderkey::VARCHAR AS origin, 0::BIGINT AS pos, 'Order ' || o_orderkey AS artist, 'Growlers' AS venue, o_orderdate::DATE AS date, {_TIME} AS time, 'http://t/' || o_orderkey AS url, true AS kept, false AS filtered FROM orders
 UNION ALL SELECT o_orderkey::VARCHAR, 1, {_SECOND_TITLE}, v.venue, o_orderdate::DATE, NULL, 'http://t/' || o_orderkey, {_SECOND_TITLE} = 'Jazz Trivia', {_SECOND_TITLE} <> 'Jazz Trivia'
 FROM orders JOIN ({venue_join('SELECT DISTINCT o_orderpriority FROM orders', 'o_orderpriority', 'o_orderpriority')}) v USING (o_orderpriority)
 UNION ALL SELECT o_orderkey::VARCHAR, 2, 'No date', 'Unknown Venue', NULL, NULL, 'http://t/' || o_orderkey, false, o_orderkey % 2 <> 0 FROM orders"""
ORACLES["api_request"] = f"""WITH o AS (SELECT o_orderkey AS k, {config.CENTER_LAT}::DOUBLE + ((o_orderkey * 37) % 2001 - 1000) / 1000.0::DOUBLE AS lat, {config.CENTER_LON}::DOUBLE + ((o_orderkey * 53) % 2003 - 1000) / 1000.0::DOUBLE AS lon FROM orders),
 m AS (SELECT *, 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(lat - {config.CENTER_LAT}) / 2), 2) + cos(radians({config.CENTER_LAT})) * cos(radians(lat)) * pow(sin(radians(lon - ({config.CENTER_LON})) / 2), 2)))) AS miles FROM o)
 SELECT k::VARCHAR AS origin, 0::BIGINT AS pos, 'Order ' || k AS artist, 'Growlers' AS venue, {plus('k % 12')} AS date, true AS kept, false AS filtered FROM m
 WHERE k % 12 <= 7 AND (k % 5 = 0 OR k % 3 <> 1) AND (k % 10 IN (3, 4) OR miles <= {config.RADIUS_MILES})"""
_DOC = "'Doc ' || doc_id"
_CAT = pick(["Music", "", "Arts"], "doc_id")
ORACLES["api_second"] = f"""SELECT doc_id::VARCHAR AS origin, CASE WHEN ok THEN {_DOC} ELSE '' END AS artist,
 CASE WHEN doc_id % 2 = 0 THEN 'Germantown Performing Arts Center' WHEN doc_id % 4 = 1 THEN 'Street ' || doc_id ELSE 'Memphis, TN' END AS venue,
 {plus('n_chars % 8')} AS date, '7:30 PM' AS time, 'http://e' AS url, ok AND m AS kept, ok AND NOT m AS filtered
 FROM (SELECT *, doc_id % 9 <> 0 AS ok, {music(f'({_DOC})', _CAT, 'substring(text, 1, 200)')} AS m FROM documents)"""
ORACLES["sheet_rows"] = f"""SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 3 THEN 'Act, "' || o_orderkey || '"' ELSE 'Act ' || o_orderkey END AS artist,
 CASE o_orderkey % 5 WHEN 0 THEN 'Overton Park Shell' WHEN 2 THEN 'Growlers' WHEN 3 THEN 'B-Side Memphis' ELSE 'Venue TBA' END AS venue, {plus('o_orderkey % 12')} AS date,
 CASE o_orderkey % 5 WHEN 0 THEN '9 PM' WHEN 2 THEN '9 PM' WHEN 3 THEN '7, 8' END AS time,
 CASE o_orderkey % 5 WHEN 0 THEN 'Manual (flyer)' WHEN 2 THEN 'Manual (n)' ELSE 'Manual (Google Sheet)' END AS source
 FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey % 12 <= 7"""
ORACLES["archive_decode"] = "SELECT page_id, md5(html) AS html_md5 FROM pages"


def decode(x: str) -> str:
    # the references that the driver's pages hold; the operator decodes all
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return f"replace({x}, '&amp;', '&')"


def element(x: str) -> str:
    bare = rf"regexp_replace({x}, '\s*(?:<!--(?s:.*?)-->|<[^>]*>)\s*', '', 'g')"
    return "trim(" + decode(rf"regexp_replace({bare}, '^\s+|\s+$', '', 'g')") + ")"


TITLED = f"""SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title, {plus('page_id % 12')} AS day FROM pages"""
ORACLES["sheet_files"] = f"""WITH f AS (SELECT p_partkey AS k, {plus('p_partkey % 12')} AS date, 'Act "' || p_partkey || '", the' || chr(10) || p_name AS act FROM part WHERE p_partkey % 12 <= 7)
 SELECT k::VARCHAR AS origin, pos::BIGINT AS pos, coalesce(name, act) AS artist, venue, date, time, source FROM f,
 (VALUES (0, 0, NULL, 'Overton Park Shell', NULL, 'Manual (Google Sheet)'), (1, 0, NULL, 'Growlers', NULL, 'Manual (flyer)'), (1, 1, 'Long', 'Growlers', '7 PM', 'Manual (n)'), (2, 0, NULL, 'B-Side Memphis', '9 PM', 'Manual (Google Sheet)'))
 v(r, pos, name, venue, time, source) WHERE k % 3 = r"""
ORACLES["page_cards"] = f"""SELECT page_id::VARCHAR AS origin, 0::BIGINT AS pos, md5({element('raw_title')}) AS artist_md5, 'Growlers' AS venue, day AS date, NULL::VARCHAR AS time, NULL::VARCHAR AS url,
 'Venue: Growlers' AS source, page_id % 12 <= 7 AS kept, page_id % 12 > 7 AS filtered FROM ({TITLED})"""
ORACLES["page_jsonld"] = f"""SELECT page_id::VARCHAR AS origin, 0::BIGINT AS pos, url AS artist, 'Overton Park Shell' AS venue, day AS date, '7:30 PM' AS time, url, 'Venue: Growlers' AS source,
 page_id % 12 <= 7 AS kept, page_id % 12 > 7 AS filtered FROM ({TITLED})
 UNION ALL SELECT page_id::VARCHAR, 1, 'Plain', 'Growlers', DATE '2026-02-16', NULL, NULL, 'Venue: Growlers', true, false FROM pages"""
_NAME = "'Act ' || p_name || ' ' || p_partkey"
_N = "p_partkey % 9"
ORACLES["page_profiles"] = f"""WITH p AS (SELECT *, {_N} AS n, {plus('p_size % 12')} AS date, {_NAME} AS artist FROM part),
 r AS (SELECT p_partkey::VARCHAR AS origin, artist, date, n, p_size % 12 <= 7 AS inside, {music('artist', q('music'))} AS m, n IN (4, 5, 6, 8) AS ruled,
 CASE WHEN n IN (0, 1, 2) THEN 'House' WHEN n = 3 THEN 'Bar DKDC' WHEN n = 5 THEN 'B-Side Memphis' WHEN n = 6 THEN 'Bar DKDC' WHEN n = 7 THEN 'Growlers' ELSE 'Venue TBA' END AS venue,
 CASE WHEN n IN (2, 6) THEN '8 pm' WHEN n = 7 THEN '8:00 PM' WHEN n = 8 THEN '8 PM' END AS time,
 CASE n WHEN 0 THEN '/event/' || p_partkey WHEN 2 THEN '/event/' || p_partkey WHEN 4 THEN 'https://dice.fm/event/' || p_partkey WHEN 5 THEN 'https://www.bandsintown.com/event/' || p_partkey
  WHEN 6 THEN 'https://www.memphisflyer.com/event/' || p_partkey WHEN 7 THEN 'http://c/e/' || p_partkey END AS url,
 CASE WHEN n IN (0, 1, 2) THEN 'Venue: House' WHEN n = 3 THEN 'Artifacts (' || p_partkey || ')' WHEN n IN (4, 8) THEN 'DICE' WHEN n = 5 THEN 'Bandsintown' WHEN n = 6 THEN 'Memphis Flyer' ELSE 'Artifacts (Bandsintown page)' END AS source FROM p),
 s AS (SELECT *, (n <> 5 OR inside) AS found FROM r), t AS (SELECT *, found AND inside AND (NOT ruled OR m) AS kept FROM s)
 SELECT origin, artist, venue, date, time, url, source, found, kept, found AND NOT kept AND n NOT IN (3, 7) AS filtered FROM t"""
ORACLES["saved_city_links"] = f"""WITH p AS (SELECT p_partkey AS k, trim(p_name) AS a, {plus('p_size % 12')} AS date FROM part),
 r AS (SELECT k, date, unnest([
  {{'pos': 0, 'artist': a || ' é', 'venue': 'Growlers', 'time': '8:00 PM', 'url': 'https://c/e/' || k}},
  {{'pos': 1, 'artist': a, 'venue': 'Venue TBA', 'time': NULL, 'url': 'https://c/e/' || k}},
  {{'pos': 2, 'artist': a || 'x', 'venue': 'Venue TBA', 'time': 'late - night', 'url': '/e/' || k}},
  {{'pos': 3, 'artist': a, 'venue': 'Bar DKDC', 'time': NULL, 'url': '/e/' || k}},
  {{'pos': 4, 'artist': a, 'venue': 'Overton Park Shell', 'time': NULL, 'url': '/e/' || k}}]) AS e FROM p)
 SELECT k::VARCHAR AS origin, e.pos::BIGINT AS pos, e.artist AS artist, e.venue AS venue, date, e.time AS time, e.url AS url, 'Artifacts (Bandsintown page)' AS source,
 date <= DATE '2026-02-22' AS kept FROM r"""
_KEYS = [v[0] for v in config.VENUES]
_FAN = ", ".join(f"({i + 3}, {q(v[0])}, {q('Venue: ' + v[1])}, {q(v[4])})" for i, v in enumerate(config.VENUES) if v[3])
ORACLES["venue_fanout"] = f"""SELECT v.name AS source_name, v.rank AS source_rank, true AS success, count(*) FILTER (WHERE hit) AS events_found, count(*) FILTER (WHERE hit AND page_id % 12 <= 7) AS events_after_filter,
 count(*) FILTER (WHERE hit AND page_id % 12 > 7) AS events_filtered, CASE WHEN count(*) FILTER (WHERE hit) = 0 THEN '0 events parsed — page structure may have changed' END AS error
 FROM (SELECT *, kind NOT IN ('hi_tone', 'minglewood', 'hernandos') AND {element("coalesce(raw_title, '')")} <> '' AS hit FROM (VALUES {_FAN}) v(rank, key, name, kind) LEFT JOIN ({TITLED}) p ON {pick(_KEYS, 'p.page_id')} = v.key) v GROUP BY v.name, v.rank"""
ORACLES["venue_errors"] = f"""WITH p AS (SELECT *, (page_id % 11)::INTEGER AS n, {element("coalesce(raw_title, '')")} <> '' AS hit, lpad(page_id::VARCHAR, 12, '0') AS origin FROM ({TITLED})),
 e AS (SELECT *, CASE WHEN n = 5 OR page_id % 22 = 4 THEN 'Request failed: 404 for page ' || page_id WHEN n = 7 THEN 'Parse error: no profile unheard_of'
  WHEN n = 2 THEN 'Parse error: ValueError: selector ' || chr(39) || '>>' || chr(39) END AS error FROM p)
 SELECT n + 3 AS source_rank, 'Source ' || n AS source_name, count(error) = 0 AS success, count(*) FILTER (WHERE error IS NULL AND hit) AS events_found,
 count(*) FILTER (WHERE error IS NULL AND hit AND page_id % 12 <= 7) AS events_after_filter, count(*) FILTER (WHERE error IS NULL AND hit AND page_id % 12 > 7) AS events_filtered,
 coalesce(min_by(error, origin) FILTER (WHERE error IS NOT NULL), CASE WHEN count(*) FILTER (WHERE hit) = 0 THEN '0 events parsed — page structure may have changed' END) AS error,
 count(*) AS n_pages, count(error) AS n_failed FROM e GROUP BY n"""
ORACLES["bad_records"] = """SELECT 'Ticketmaster' AS source_name, 0 AS source_rank, o_orderkey::VARCHAR AS origin, CASE WHEN o_orderkey % 7 > 0 THEN 1 END::BIGINT AS pos,
 ['not JSON', 'no name', 'no date', 'bad date'][o_orderkey % 7 + 1] AS reason FROM orders WHERE o_orderkey % 7 < 4
 UNION ALL SELECT 'Manual (Google Sheet)', 1, 'orders', o_orderkey, ['too few cells', 'too many cells', 'no date', 'no name', 'bad date'][o_orderkey % 6 + 1] FROM orders WHERE o_orderkey % 6 < 5
 UNION ALL SELECT 'Pages', 5, page_id::VARCHAR, 1, CASE page_id % 4 WHEN 0 THEN 'not JSON' ELSE 'value of a wrong type' END FROM pages WHERE page_id % 4 < 3
 UNION ALL SELECT 'Pages', 5, page_id::VARCHAR, 2, 'not JSON' FROM pages WHERE page_id % 3 = 0"""
ORACLES["page_state_order"] = """SELECT p_partkey::VARCHAR AS origin, name || ' ' || p_partkey || ' "q" {x}' AS artist, pos::BIGINT AS pos, url, n FROM part,
 (VALUES (0, 'Act', 0, '/z', 2::BIGINT), (0, 'Other', 2, '/a', 1), (1, 'Act', 0, '/m', 2), (1, 'Other', 1, '/a', 1), (2, 'Act', 1, '/z', 2), (2, 'Other', 0, '/a', 1)) v(k, name, pos, url, n)
 WHERE k = p_partkey % 3"""
ORACLES["page_links"] = """SELECT page_id, (i - 1)::INTEGER AS pos, CASE WHEN starts_with(href, 'http') THEN href WHEN href <> '' THEN 'https://base.example' || href END AS link
 FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages))"""
ORACLES["page_text"] = f"""SELECT page_id, md5({element("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1_md5, md5({esc("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title_md5 FROM pages"""
ORACLES["strategy_fallback"] = """WITH r AS (SELECT page_id, 0 AS rank, regexp_extract_all(html, '<a class="x" href="([^"]*)"', 1) AS h FROM pages UNION ALL
 SELECT page_id, 1, regexp_extract_all(html, '<a href="(/[a-m][^"]*)"', 1) FROM pages UNION ALL SELECT page_id, 2, regexp_extract_all(html, '<a href="([^"]*)"', 1) FROM pages),
 b AS (SELECT page_id, min(rank) AS rank FROM r WHERE len(h) > 0 GROUP BY page_id)
 SELECT page_id, rank, (i - 1)::INTEGER AS pos, href FROM (SELECT page_id, rank, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM r JOIN b USING (page_id, rank))"""
ORACLES["run_log_scan"] = """SELECT day, source_name, (row_number() OVER (PARTITION BY day ORDER BY source_name) - 1)::INTEGER AS source_rank, n % 5 <> 0 AS success, n AS events_found, k AS events_after_filter, n - k AS events_filtered
 FROM (SELECT ts::DATE AS day, event_type AS source_name, count(*) AS n, count(*) FILTER (WHERE value > 20) AS k FROM events GROUP BY 1, 2)"""
ORACLES["status_scan"] = """SELECT ts::DATE::VARCHAR AS last_run, event_type AS source_name, CASE WHEN count(*) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS count, NULL::VARCHAR AS message FROM events GROUP BY ts::DATE, event_type"""

# --- files, overrides, limits ----------------------------------------------------------------------------------
_SAFE = r"nullif(trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}.\-_ ]', '', 'g')), '')"
_FILE = f"'Pägé (' || page_id // 3 || ')' || {pick(['.HTML', '.png', '.exe', '', '.mhtml'], 'page_id')}"
ORACLES["intake_manifest"] = f"""WITH f AS (SELECT page_id, {_FILE} AS name, CASE WHEN page_id % 17 = 0 THEN 0 ELSE length(html) * 1000 END::BIGINT AS length, (page_id * 7) % 100 AS modified, page_id % 5 AS x FROM pages),
 ok AS (SELECT *, {_SAFE.format('name')} AS file_name FROM f WHERE x NOT IN (2, 3) AND length > 0 AND length <= 20971520),
 l AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY modified DESC, name DESC) AS rn FROM ok)
 SELECT file_name, page_id, name, length, modified, file_name IN (SELECT 'Pägé ' || (page_id // 3) * 2 || '.png' FROM pages) AS updated FROM l WHERE rn = 1"""
ORACLES["manifest_merge"] = f"""WITH f AS (SELECT page_id, {_FILE} AS name, CASE WHEN page_id % 17 = 0 THEN 0 ELSE length(html) * 1000 END::BIGINT AS length, (page_id * 7) % 100 AS modified, page_id % 5 AS x FROM pages),
 ok AS (SELECT *, {_SAFE.format('name')} AS file_name FROM f WHERE x NOT IN (2, 3) AND length > 0 AND length <= 20971520),
 l AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY modified DESC, name DESC) AS rn FROM ok)
 SELECT file_name, page_id, name, length, modified, page_id % 2 = 1 AND file_name IN (SELECT file_name FROM ok WHERE page_id % 2 = 0) AS updated FROM l WHERE rn = 1"""
_RN = pick(["a.HTML", "(((.png", "b.exe", "c", ".htm", "é é.webp"], "page_id")
ORACLES["intake_rejections"] = f"""SELECT page_id, CASE WHEN n = 0 THEN 'No file provided' WHEN n > 20971520 THEN 'File too large (max 20 MB)' WHEN x = 2 THEN 'File type .exe not allowed' WHEN x IN (3, 4) THEN 'File type  not allowed' END AS reason,
 {_SAFE.format('name')} AS safe FROM (SELECT page_id, page_id % 6 AS x, {_RN} AS name, length(html) * (page_id % 4) * 3000 AS n FROM pages)"""
ORACLES["retention"] = "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00'"
ORACLES["latest_per_key"] = """SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
ORACLES["overrides_apply"] = f"""WITH l AS ({parts('p_brand', 8)}), k AS (SELECT *, {key('artist', 'venue', 'date')} AS key FROM l), d AS (SELECT DISTINCT key FROM k WHERE source = 'Ticketmaster'),
 e AS (SELECT key, 'edit ' || min(pos) AS artist FROM k WHERE time IS NULL GROUP BY key), p AS (SELECT key, 'note ' || max(pos) AS note FROM k WHERE url IS NOT NULL GROUP BY key)
 SELECT k.pos, k.key, coalesce(e.artist, k.artist) AS artist, k.venue, k.date, CASE WHEN e.key IS NOT NULL THEN 'late' ELSE k.time END AS time, k.url, p.key IS NOT NULL AS featured, p.note AS featured_note
 FROM k LEFT JOIN e ON k.key = e.key LEFT JOIN p ON k.key = p.key WHERE k.key NOT IN (SELECT key FROM d)"""
ORACLES["soonest"] = "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id LIMIT 100"
